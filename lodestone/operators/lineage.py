"""What depends on what, at any distance, and how long that takes."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.shared import checkpoint_folder


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    """Equal in names, nulls included, which right has with an underscore before."""
    on = F.lit(True)
    for n in names:
        on = on & left[n].eqNullSafe(right[f"_{n}"])
    return on


def _joined(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "inner") -> DataFrame:
    """left joined with right where they are equal in names, nulls included, which right has with an underscore before.

    Both sides grow with the graphs, but Spark guesses tables made of documents far too small, so it is told not to broadcast
    them: that would take them through the driver.
    """
    return left.join(right.hint("merge"), _same(left, right, names), how)


def _marked(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(n).alias(f"_{n}") if n in names else F.col(n) for n in df.columns])


def _steps(edges: DataFrame, parent: str, child: str, keys: tuple[str, ...]) -> DataFrame:
    checkpoint_folder(edges.sparkSession)
    return edges.select(*keys, F.col(parent).alias("from"), F.col(child).alias("to")).where("from is not null and to is not null").distinct().checkpoint()


def closure(edges: DataFrame, parent: str = "parent", child: str = "child", most: int | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Columns of `keys`, ancestor, descendant, depth: all pairs that edges connect, with the least number of steps, up to `most` if given.

    Paths stay within rows of equal keys, nulls being equal, such as ("artifact_id",) where documents use the same names. Each
    round joins the pairs found last with the edges and drops known ones, so cycles end it. Lineage is cut by checkpoints,
    which need a checkpoint folder: what is known is one table after each round. All pairs are many: `reach` gives those of
    some nodes.
    """
    step = _steps(edges, parent, child, keys)
    return _spread(step, step.select(*keys, F.col("from").alias("start")).distinct().withColumn("node", F.col("start")), most, keys).where("depth > 0").select(*keys, F.col("start").alias("ancestor"), F.col("node").alias("descendant"), "depth")


#: Tables of rounds that are read one by one; more are put together.
APART = 8


def _added(parts: list[DataFrame], last: DataFrame) -> list[DataFrame]:
    """parts with one more round's table; written as one table when they are many, so that plans stay short."""
    return [*parts, last] if len(parts) < APART else [_whole([*parts, last]).checkpoint()]


def _whole(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _spread(step: DataFrame, starts: DataFrame, most: int | None, keys: tuple[str, ...]) -> DataFrame:
    """keys, start, node, depth of all nodes that are reached. A start that is reached again is there with that depth, too."""
    onward = step.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("from").alias("_node"), F.col("to").alias("_to"))
    last = starts.select(*keys, "start", "node").withColumn("depth", F.lit(0)).checkpoint()
    parts = [last]
    for depth in count(1):
        if most is not None and depth > most:
            break
        new = _joined(last, onward, [*keys, "node"]).select(*keys, "start", F.col("_to").alias("node")).distinct()
        old = _marked(_whole(parts).where("depth > 0").select(*keys, "start", "node"), [*keys, "start", "node"])
        last = _joined(new, old, [*keys, "start", "node"], "left_anti").withColumn("depth", F.lit(depth)).checkpoint()
        if last.isEmpty():
            break
        parts = _added(parts, last)
    return _whole(parts)


def reach(edges: DataFrame, starts: DataFrame, parent: str = "parent", child: str = "child", down: bool = True, most: int | None = None, keys: tuple[str, ...] = (), chains: bool = False) -> DataFrame:
    """Columns of `keys`, start, node, depth: what comes of the nodes in starts (a column `node` and those of keys), or, if
    not `down`, what they come from, with the least number of steps, up to `most` if given.

    A node that depends on itself is reached from itself. Paths stay within equal keys. The nodes found last are
    joined with the edges in each round, so the work is by what is reached. With `chains`, runs of nodes that have one way in
    and one way out are first made single steps, in as many rounds as doubling needs: then a chain of 1000 nodes takes
    some 10 rounds in place of 1000.
    """
    step = _steps(edges, *((parent, child) if down else (child, parent)), keys)
    first = starts.select(*keys, F.col("node").alias("start")).where("start is not null").distinct().withColumn("node", F.col("start"))
    if not chains:
        return _spread(step, first, most, keys).where("depth > 0")
    return _over_chains(step, first, most, keys)


def _over_chains(step: DataFrame, first: DataFrame, most: int | None, keys: tuple[str, ...]) -> DataFrame:
    # A link leads from a node with no other way on to one with no other way in; loops are none.
    ways = lambda c: Window.partitionBy(*keys, c)
    told = step.withColumn("_on", F.count("*").over(ways("from"))).withColumn("_in", F.count("*").over(ways("to")))
    told = told.withColumn("link", (F.col("_on") == 1) & (F.col("_in") == 1) & (F.col("from") != F.col("to"))).drop("_on", "_in").checkpoint()
    nodes = step.select(*keys, F.col("from").alias("node")).union(step.select(*keys, "to")).distinct()
    links = told.where("link").select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("from").alias("head"), F.col("to").alias("_node"))
    # Each node points back along its chain, each round twice as far.
    at = _joined(nodes, links, [*keys, "node"], "left").select(*keys, "node", F.coalesce("head", "node").alias("head"), F.when(F.col("head").isNotNull(), 1).otherwise(0).cast("long").alias("offset"))
    at = at.checkpoint()
    rounds = max(1, at.count()).bit_length() + 1
    for _ in range(rounds):
        back = at.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("node").alias("_head"), F.col("head").alias("_to"), F.col("offset").alias("_more"))
        after = _joined(at, back, [*keys, "head"]).select(*keys, "node", F.col("_to").alias("head"), (F.col("offset") + F.col("_more")).alias("offset"), (F.col("_more") > 0).alias("moved")).checkpoint()
        at = after.drop("moved")
        if after.where("moved").isEmpty():
            break
    # A ring has no head: its nodes are chains of their own.
    heads = _marked(at.where("offset = 0").select(*keys, F.col("node").alias("head")), [*keys, "head"])
    ringed = _joined(at, heads, [*keys, "head"], "left")
    at = ringed.select(*keys, "node", F.when(F.col("_head").isNull(), F.col("node")).otherwise(F.col("head")).alias("head"), F.when(F.col("_head").isNull(), 0).otherwise(F.col("offset")).cast("long").alias("offset")).checkpoint()
    ring = at.where("offset = 0").select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("node").alias("_to"))
    # What leads out of a chain leads from its last node; steps into heads, among them those within rings, are all there are.
    outward = _joined(told, ring, [*keys, "to"]).drop(*[f"_{k}" for k in keys], "_to")
    tails = at.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("node").alias("_from"), F.col("head"), F.col("offset"))
    ways_on = _joined(outward, tails, [*keys, "from"]).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("head").alias("_head"), (F.col("offset") + 1).alias("_length"), F.col("to").alias("_to")).checkpoint()
    # From where a start is in its chain.
    place = _marked(at, [*keys, "node"])
    begun = _joined(first, place, [*keys, "node"]).select(*keys, "start", "head", "offset").checkpoint()
    near = _joined(begun, ways_on, [*keys, "head"]).select(*keys, "start", F.col("_to").alias("head"), (F.col("_length") - F.col("offset")).alias("depth"))
    within = lambda df: df if most is None else df.where(F.col("depth") <= most)
    known = last = within(near).groupBy(*keys, "start", "head").agg(F.min("depth").alias("depth")).checkpoint()
    while not last.isEmpty():
        more = _joined(last, ways_on, [*keys, "head"]).select(*keys, "start", F.col("_to").alias("head"), (F.col("depth") + F.col("_length")).alias("depth"))
        better = within(more).groupBy(*keys, "start", "head").agg(F.min("depth").alias("depth"))
        old = known.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("start").alias("_start"), F.col("head").alias("_head"), F.col("depth").alias("_depth"))
        last = _joined(better, old, [*keys, "start", "head"], "left").where("_depth is null or depth < _depth").select(*keys, "start", "head", "depth").checkpoint()
        known = known.union(last).groupBy(*keys, "start", "head").agg(F.min("depth").alias("depth")).checkpoint()
    members = at.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("node"), F.col("head").alias("_head"), F.col("offset").alias("_offset"))
    far = _joined(known, members, [*keys, "head"]).select(*keys, "start", "node", (F.col("depth") + F.col("_offset")).alias("depth"))
    own = _joined(begun, members, [*keys, "head"]).where("_offset > offset").select(*keys, "start", "node", (F.col("_offset") - F.col("offset")).alias("depth"))
    return within(far.union(own)).groupBy(*keys, "start", "node").agg(F.min("depth").cast("int").alias("depth"))


def finish_times(edges: DataFrame, seconds: DataFrame, parent: str = "parent", child: str = "child", keys: tuple[str, ...] = (), value: str = "seconds") -> DataFrame:
    """Columns of `keys`, node, seconds, begins, ends, after, critical: when each node is done if it begins as soon as all that
    it depends on are done. `after` is the one that it waits for longest (the least name of those), null if none.

    seconds has columns of keys, node and `value`; nodes without take no time, and several rows of a node add up.
    critical tells the nodes of the longest path of each key (the one to the node of the least name, of equal ones).

    A node is settled in the round after the last of its parents, so rounds are as many as the graph is deep. Each edge is
    used once and then dropped, and the longest paths are followed back round by round, each node of them looked up once in
    the table of its round. A cycle is refused.
    """
    step = _steps(edges, parent, child, keys)
    kind, zero = seconds.schema[value].dataType, F.lit(0).cast("long")
    given = seconds.where("node is not null").select(*keys, "node", F.col(value).alias("seconds"), zero.alias("need"))
    nodes = step.select(*keys, F.col("from").alias("node"), F.lit(None).cast(kind).alias("seconds"), zero.alias("need")).union(step.select(*keys, "to", F.lit(None).cast(kind), zero + 1)).union(given)
    nodes = nodes.groupBy(*keys, "node").agg(F.coalesce(F.sum("seconds"), F.lit(0.0)).cast("double").alias("seconds"), F.sum("need").alias("need"))
    pending = nodes.withColumn("best", F.lit(None).cast("struct<ends:double,after:string,after_round:int>")).checkpoint()
    onward = step.select(*keys, F.col("from").alias("node"), "to")
    parts: list[DataFrame] = []
    rounds = 0
    while not pending.isEmpty():
        rounds += 1
        ready = pending.where("need = 0").select(*keys, "node", "seconds", F.coalesce("best.ends", F.lit(0.0)).alias("begins"), "best.after", "best.after_round", F.lit(rounds).alias("round"))
        ready = ready.withColumn("ends", F.col("begins") + F.col("seconds")).checkpoint()
        if ready.isEmpty():
            raise ValueError("A cycle of dependencies")
        parts = _added(parts, ready)
        met = _joined(onward, _marked(ready.select(*keys, "node", "ends"), [*keys, "node"]), [*keys, "node"], "left").select(*keys, "node", "to", "ends").checkpoint()
        onward = met.where("ends is null").select(*keys, "node", "to")
        # The latest parent; of equal ones that of the least name.
        told = met.where("ends is not null").groupBy(*keys, F.col("to").alias("node")).agg(F.count("*").alias("met"), F.max("ends").alias("latest"), F.min_by("node", F.struct(-F.col("ends"), "node")).alias("by"))
        told = _marked(told, [*keys, "node"])
        later = F.col("latest").isNotNull() & (F.col("best").isNull() | (F.col("latest") > F.col("best.ends")) | ((F.col("latest") == F.col("best.ends")) & (F.col("by") < F.col("best.after"))))
        best = F.when(later, F.struct(F.col("latest").alias("ends"), F.col("by").cast("string").alias("after"), F.lit(rounds).alias("after_round"))).otherwise(F.col("best"))
        pending = _joined(pending.where("need > 0"), told, [*keys, "node"], "left").select(*keys, "node", "seconds", (F.col("need") - F.coalesce("met", F.lit(0))).alias("need"), best.alias("best")).checkpoint()
    if not parts:
        return nodes.select(*keys, "node", *[F.lit(0.0).alias(c) for c in ("seconds", "begins", "ends")], F.lit("").alias("after"), F.lit(True).alias("critical"))
    done = _whole(parts)
    # Back from the last node of each key: path has the nodes and their rounds.
    path = [done.groupBy(*keys).agg(F.min_by(F.struct("node", "round"), F.struct(-F.col("ends"), "node")).alias("x")).select(*keys, "x.node", "x.round").checkpoint()]
    for r in range(rounds, 1, -1):
        # The first table may hold several rounds, each other one holds one.
        back = parts[max(0, r - 1 - (rounds - len(parts)))].where(F.col("round") == r).select(*keys, "node", "after", "after_round")
        at = _joined(_whole(path).where(F.col("round") == r).select(*keys, "node"), _marked(back, [*keys, "node"]), [*keys, "node"])
        path = _added(path, at.where("after is not null").select(*keys, F.col("after").alias("node"), F.col("after_round").alias("round")).checkpoint())
    marks = _marked(_whole(path).select(*keys, "node", F.lit(True).alias("critical")), [*keys, "node"])
    return _joined(done, marks, [*keys, "node"], "left").select(*keys, "node", "seconds", "begins", "ends", "after", F.coalesce("critical", F.lit(False)).alias("critical"))
