"""Nearest neighbours against brute force."""

import math
import random

import numpy as np
import pytest

from lodestone.llm import neighbours, queries


def brute(rows, k=10, every=100):
    """For each query row, the k nearest other ids with their distances."""
    ok = sorted({(i, tuple(x + 0.0 for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)})
    out = {}
    for q, a in ok:
        if q % every == 0:
            near = sorted((math.dist(a, b), i) for i, b in ok if i != q)[:k]
            out[q] = [(i, d) for d, i in near]
    return out


def told(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r[2], r.score))
        assert len(got[r.query_id]) == r["rank"]
    return got


def recall(got, want):
    return sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in near}) for q, near in want.items()) / sum(len(near) for near in want.values())


def test_copies_ties_and_unusable_vectors(spark, tmp_path):
    rows = [(i, [float(i % 7), 1.0]) for i in range(300)]  # seven vectors, many copies
    rows += [(300, None), (301, [0.0, 0.0]), (302, [1.0, None]), (303, [float("nan"), 1.0]), (304, [float("inf"), 1.0]), (305, []), (None, [1.0, 1.0]), (306, [1.0]), (400, [-0.0, 1.0]), (400, [-0.0, 1.0]), (500, [2.5, 1.0]), (600, None)]
    df = spark.createDataFrame([(i, v, "c", "c", "c") for i, v in rows], "vec_id long, embedding array<double>, id string, vec string, class string").repartition(5)
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    out = queries.op13_neighbours(spark, str(tmp_path))
    assert out.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    want = brute([r for r in rows if r[0] != 306])
    got = told(out)
    assert set(got) == {0, 100, 200, 400, 500} == set(want)
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]], q
        assert np.allclose([d for _, d in got[q]], [d for _, d in want[q]], atol=0, rtol=1e-15)


@pytest.mark.parametrize("rows,queries_", [(0, 0), (1, 1), (4, 1)])
def test_few_vectors(spark, rows, queries_):
    df = spark.createDataFrame([(i * 25, [1.0 + i, 2.0]) for i in range(rows)], "vec_id long, embedding array<float>")
    got = told(neighbours.neighbours(df, neighbours.F.col("id") % 100 == 0).withColumnRenamed("id", "vec_id"))
    assert got == {q: v for q, v in brute([(i * 25, [1.0 + i, 2.0]) for i in range(rows)]).items() if v}


def test_recall_and_exact_distances_with_small_leaves_and_groups(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "TOGETHER", 8)
    monkeypatch.setattr(neighbours, "SAMPLE", 1500)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 12)) + 3 * rng.normal(size=(8, 12))[rng.integers(8, size=3000)]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    want = brute(rows, every=20)
    got = told(neighbours.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), neighbours.F.col("id") % 20 == 0))
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    assert recall(got, want) >= 0.9
    for q, near in got.items():
        assert near == sorted(near, key=lambda p: (p[1], p[0])) and all(abs(d - math.dist(rows[q][1], rows[i][1])) < 1e-12 for i, d in near)


def test_visits_come_nearest_first_and_begin_with_the_own_leaves():
    rng = np.random.default_rng(3)
    sample = rng.normal(size=(400, 6)).astype(np.float32)
    grown = [neighbours.grow(sample, 4, t) for t in range(3)]
    forest = neighbours.Forest(4, np.stack([w for w, _ in grown]), np.stack([b for _, b in grown]))
    for x in sample[:20].astype(float):
        seen = list(forest.visits(x, 1000))
        assert len(seen) == len(set(seen)) == 48
        far = forest.far(x)
        assert np.allclose([far[t, leaf] for t, leaf in seen], np.sort(far, axis=None), atol=1e-6)
        own = forest.leaves(x[None].astype(np.float32))[0]
        assert {(t, int(leaf)) for t, leaf in enumerate(own)} == set(seen[:3])
    assert all(len(set(np.bincount(forest.leaves(sample)[:, t], minlength=16))) <= 3 for t in range(3))


def test_ids_of_another_type(spark):
    rng = random.Random(1)
    rows = [(f"v{i:03}", [rng.random(), rng.random()]) for i in range(200)]
    out = neighbours.neighbours(spark.createDataFrame(rows, "vec_id string, embedding array<double>"), neighbours.F.col("id").endswith("7"), k=3)
    got = told(out)
    want = {q: [(i, d) for d, i in sorted((math.dist(a, b), i) for i, b in rows if i != q)[:3]] for q, a in rows if q.endswith("7")}
    assert set(got) == set(want) and recall(got, want) >= 0.85
