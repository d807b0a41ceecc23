"""Lineage from given nodes and critical paths against plain searches."""

import random
from collections import deque

import pytest

from lodestone.operators import lineage

KIND = "artifact_id string, parent string, child string"


def plain_reach(edges, starts, down=True, most=None):
    out = {}
    for key, start in starts:
        seen, queue = {}, deque([(start, 0)])
        while queue:
            at, d = queue.popleft()
            if most is not None and d >= most:
                continue
            for k, a, b in edges:
                if k == key and (a if down else b) == at and (to := b if down else a) not in seen:
                    seen[to] = d + 1
                    queue.append((to, d + 1))
        out |= {(key, start, n): d for n, d in seen.items()}
    return out


def graph(rng, n, m, key):
    return [(key, f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)]


@pytest.mark.parametrize("chains", [False, True])
def test_reach_equals_a_plain_search(spark, chains):
    rng = random.Random(3)
    edges = graph(rng, 14, 15, "a") + graph(rng, 14, 9, None) + [("a", f"c{i}", f"c{i + 1}") for i in range(20)] + [("a", "n1", "c3"), ("a", "c9", "n2"), ("r", "x", "y"), ("r", "y", "z"), ("r", "z", "x"), ("r", "w", "x"), ("s", "p", "q"), ("s", "q", "p"), ("s", "l", "l")]
    starts = [("a", "n1"), ("a", "c2"), ("a", "c20"), (None, "n3"), ("r", "x"), ("r", "w"), ("s", "p"), ("s", "l"), ("a", "nowhere")]
    df = spark.createDataFrame(edges + edges[:3] + [("a", None, "n1")], KIND)
    nodes = spark.createDataFrame(starts, "artifact_id string, node string")
    for down in (True, False):
        for most in (None, 4):
            got = lineage.reach(df, nodes, down=down, most=most, keys=("artifact_id",), chains=chains)
            assert {(r.artifact_id, r.start, r.node): r.depth for r in got.collect()} == plain_reach(edges, starts, down, most)


def test_a_long_chain_takes_few_rounds(spark):
    edges = spark.range(999).selectExpr("cast(id as string) as parent", "cast(id + 1 as string) as child")
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("chain", "chain")
    got = lineage.reach(edges, spark.createDataFrame([("0",), ("990",)], "node string"), chains=True)
    assert {(r.start, int(r.node)): r.depth for r in got.collect()} == {**{("0", i): i for i in range(1, 1000)}, **{("990", i): i - 990 for i in range(991, 1000)}}
    assert len(jobs.getJobIdsForGroup("chain")) < 200
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_closure_keeps_documents_without_an_id(spark):
    edges = [(None, "a", "b"), (None, "b", "c"), ("x", "a", "b"), ("y", "b", "c")]
    got = lineage.closure(spark.createDataFrame(edges, KIND), keys=("artifact_id",))
    assert {(r.artifact_id, r.ancestor, r.descendant, r.depth) for r in got.collect()} == {(None, "a", "b", 1), (None, "b", "c", 1), (None, "a", "c", 2), ("x", "a", "b", 1), ("y", "b", "c", 1)}


def test_finish_times_of_chains_and_diamonds(spark):
    edges = [("r", "a", "b"), ("r", "a", "c"), ("r", "b", "d"), ("r", "c", "d"), ("r", "d", "e"), (None, "x", "y"), ("r", "a", "b")]
    seconds = [("r", "a", 1.0), ("r", "b", 2.0), ("r", "c", 5.0), ("r", "d", 1.0), ("r", "f", 7.0), ("r", "e", None), (None, "y", 2.0), (None, "y", 2.0), ("q", "lone", 3.0)]
    got = lineage.finish_times(spark.createDataFrame(edges, KIND), spark.createDataFrame(seconds, "artifact_id string, node string, seconds double"), keys=("artifact_id",))
    rows = {(r.artifact_id, r.node): (r.begins, r.ends, r.after, r.critical) for r in got.collect()}
    assert rows == {
        ("r", "a"): (0, 1, None, True), ("r", "b"): (1, 3, "a", False), ("r", "c"): (1, 6, "a", True), ("r", "d"): (6, 7, "c", True), ("r", "e"): (7, 7, "d", False), ("r", "f"): (0, 7, None, False),
        (None, "x"): (0, 0, None, True), (None, "y"): (0, 4, "x", True), ("q", "lone"): (0, 3, None, True),
    }
    with pytest.raises(ValueError, match="cycle"):
        lineage.finish_times(spark.createDataFrame([("r", "a", "b"), ("r", "b", "a"), ("r", "c", "a")], KIND), spark.createDataFrame([], "artifact_id string, node string, seconds double"), keys=("artifact_id",))
    none = spark.createDataFrame([], KIND)
    assert lineage.finish_times(none, spark.createDataFrame([], "node string, seconds double")).count() == 0


def test_graphs_are_not_broadcast(spark):
    # Tables made of documents are guessed far too small; broadcast, they would all pass through the driver.
    edges = spark.createDataFrame([("r", "a", "b"), ("r", "b", "c"), (None, "a", "b")], KIND)
    seconds = spark.createDataFrame([("r", "a", 1.0), (None, "b", 2.0)], "artifact_id string, node string, seconds double")
    starts = spark.createDataFrame([("r", "a")], "artifact_id string, node string")
    last = [lineage.finish_times(edges, seconds, keys=("artifact_id",)), lineage.reach(edges, starts, keys=("artifact_id",), chains=True)]
    last.append(lineage._joined(edges.select("artifact_id", "child"), lineage._marked(seconds.select("artifact_id"), ["artifact_id"]), ["artifact_id"], "left_anti"))
    for df in last:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_finish_times_of_more_rounds_than_tables(spark, monkeypatch):
    monkeypatch.setattr(lineage, "APART", 2)
    rng = random.Random(5)
    n = 6
    edges = [(k, f"n{i:02}", f"n{i + 1:02}") for k in ("a", "b") for i in range(n - 1)] + [("a", f"n{i:02}", f"n{rng.randrange(i + 1, n):02}") for i in range(n - 1)] + [("a", "x", f"n{n - 2:02}")]
    spent = {("a", f"n{i:02}"): float(rng.randrange(4)) for i in range(n)} | {("b", f"n{i:02}"): 1.0 for i in range(n)} | {("a", "x"): 1000.0}
    got = lineage.finish_times(spark.createDataFrame(edges, KIND), spark.createDataFrame([(*k, v) for k, v in spent.items()], "artifact_id string, node string, seconds double"), keys=("artifact_id",))
    ends, after = {}, {}
    for k, node in [("a", "x"), *sorted(x for x in spent if x != ("a", "x"))]:
        parents = {(-ends[k, a], a) for key, a, b in edges if key == k and b == node}
        after[k, node] = min(parents)[1] if parents else None
        ends[k, node] = spent[k, node] + (-min(parents)[0] if parents else 0)
    path = set()
    for k in ("a", "b"):
        at = min((-e, node) for (key, node), e in ends.items() if key == k)[1]
        while at is not None:
            path.add((k, at))
            at = after[k, at]
    assert {(r.artifact_id, r.node): (r.ends, r.after, r.critical) for r in got.collect()} == {x: (ends[x], after[x], x in path) for x in ends}
