"""Nearest neighbours: a forest of random-projection trees searched through one priority queue, then exact distances."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import durable, release

TREES = 16
#: Different vectors that trees are fitted on at most, and bytes of them (as 32-bit floats); every vector is indexed.
SAMPLE, SAMPLE_BYTES = 8192, 1 << 26
#: Sampled vectors of a leaf, about: so trees have as many leaves as the sample allows, however many rows are indexed.
SAMPLE_LEAF = 16
#: Queries whose exact neighbours tell how many leaves must be searched, and the share of these that must be found.
TUNED, TARGET = 64, 0.96
#: Rows of a leaf, and queries that visit it, that meet in one group.
TOGETHER = 2048


@dataclass
class Forest:
    """Complete trees: node i of a level has the children 2i and 2i + 1. `normals` are unit vectors; levels follow each other."""

    depth: int
    normals: np.ndarray  # trees, nodes, dimensions
    offsets: np.ndarray  # trees, nodes

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        out = np.zeros((len(x), len(self.offsets)), np.int32)
        for t, (w, b) in enumerate(zip(self.normals, self.offsets)):
            node = out[:, t]
            for level in range(self.depth):
                at = node + (1 << level) - 1
                node[:] = 2 * node + (np.einsum("ij,ij->i", x, w[at]) >= b[at])
        return out

    def margins(self, x: np.ndarray) -> np.ndarray:
        """How far a vector is beyond each node's plane; negative on the left."""
        return self.normals @ x - self.offsets

    def visits(self, x: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
        """(tree, leaf) of the `most` leaves nearest to a vector: of all trees' open branches always the one whose farthest
        crossed plane is nearest. Every branch is at least that far from the vector."""
        margin = self.margins(x).tolist()
        heap = [(0.0, t, 0, 0) for t in range(len(margin))]
        while heap and most:
            far, t, level, node = heappop(heap)
            own = margin[t]
            while level < self.depth:
                m = own[(1 << level) - 1 + node]
                level, node = level + 1, 2 * node + (m >= 0)
                heappush(heap, (max(far, abs(m)), t, level, node ^ 1))
            most -= 1
            yield t, node

    def far(self, x: np.ndarray) -> np.ndarray:
        """How far the farthest crossed plane on the way to each tree's leaves is: `visits` goes by this."""
        margin = self.margins(x)
        far = np.zeros((len(margin), 1))
        for level in range(self.depth):
            m = margin[:, (1 << level) - 1 : (2 << level) - 1]
            far = np.stack([np.where(m >= 0, np.maximum(far, m), far), np.where(m < 0, np.maximum(far, -m), far)], 2).reshape(len(m), -1)
        return far


def grow(sample: np.ndarray, depth: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A tree over the sample: each node is cut at the median along the line between two random rows' neighbourhoods."""
    rng = np.random.default_rng(seed)
    normals, offsets = np.zeros(((1 << depth) - 1, sample.shape[1]), np.float32), np.zeros((1 << depth) - 1)
    own = [np.arange(len(sample))]
    for level in range(depth):
        after = []
        for node, rows in enumerate(own):
            at = (1 << level) - 1 + node
            if len(rows) > 1:
                some = sample[rng.choice(rows, min(256, len(rows)), replace=False)]
                a, b = some[0], some[1]
                for _ in range(3):
                    near = ((some - a) ** 2).sum(1) < ((some - b) ** 2).sum(1)
                    if near.all() or not near.any():
                        break
                    a, b = some[near].mean(0), some[~near].mean(0)
                size = np.linalg.norm(b - a)
                normals[at] = (b - a) / size if size > 0 else 0
                along = sample[rows] @ normals[at]
                offsets[at] = np.median(along)
                right = along >= offsets[at]
                after += [rows[~right], rows[right]]
            else:
                after += [rows, rows[:0]]
        own = after
    return normals, offsets


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of a list column as rows, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def usable(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """Different (id, vec) of the rows that take part, and the length of their vectors."""
    vec = F.col(f"`{vec_col}`")
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    own = df.select(F.col(f"`{id_col}`").alias("id"), vec.alias("vec")).where(F.col("id").isNotNull() & fine)
    top = own.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    width = top["n"] if top else 0
    # -0.0 is 0.0, so that equal vectors are one.
    return own.where(F.size("vec") == width).select("id", F.transform("vec", lambda x: F.when(x == 0, F.lit(0).cast(own.schema["vec"].dataType.elementType)).otherwise(x)).alias("vec")).distinct(), width


def fit(classes: DataFrame, width: int, total: int, trees: int = TREES) -> Forest:
    """A forest over a sample of the different vectors, drawn by their hashes; trees are grown in tasks."""
    spark = classes.sparkSession
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (4 * width)))
    hashed = classes.select(F.xxhash64("vec").alias("h"), "vec")
    if total > most:
        hashed = hashed.where(F.pmod("h", F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.1 * most / total)))
    got = hashed.toArrow()
    order = np.argsort(got.column("h").to_numpy(), kind="stable")[:most]
    sample = matrix(got.column("vec"), width).astype(np.float32)[order]
    depth = int(np.log2(max(1, len(sample) / SAMPLE_LEAF)))
    sent = spark.sparkContext.broadcast(sample)  # at most SAMPLE_BYTES

    def one(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [grow(sent.value, depth, int(t)) for t in frame["id"]]
            yield pd.DataFrame({"id": frame["id"], "normals": [w.tobytes() for w, _ in made], "offsets": [b.tobytes() for _, b in made]})

    grown = spark.range(0, trees, 1, trees).mapInPandas(one, "id long, normals binary, offsets binary").orderBy("id").collect()
    sent.unpersist()
    normals = np.stack([np.frombuffer(r.normals, np.float32).reshape(-1, width) for r in grown])
    return Forest(depth, normals, np.stack([np.frombuffer(r.offsets) for r in grown]))


def nearest(vectors: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of each query's k nearest rows, ties to the smaller `least`.

    Products find the rows that can be among them; their distances are then taken from the differences.
    """
    square, own = (vectors**2).sum(1), (queries**2).sum(1)
    about = own[:, None] + square[None, :] - 2 * (queries @ vectors.T)
    limit = np.partition(about, k - 1, axis=1)[:, k - 1] if len(vectors) > k else np.full(len(queries), np.inf)
    q, row = np.nonzero(about <= (limit + 1e-9 * (own + square.max()))[:, None])
    exact = np.sqrt(((vectors[row] - queries[q]) ** 2).sum(1))
    order = np.lexsort((least[row], exact, q))
    q, row, exact = q[order], row[order], exact[order]
    first = np.searchsorted(q, np.arange(len(queries)))
    keep = np.arange(len(q)) - first[q] < k
    return q[keep], row[keep], exact[keep]


def budget(indexed: DataFrame, asked: DataFrame, forest: Forest, width: int, k: int) -> int:
    """Leaves to visit, so that the share TARGET of the exact neighbours of TUNED queries is found.

    One pass over all vectors finds these neighbours and their leaves; only the nearest of each task leave it.
    """
    some = asked.orderBy(F.xxhash64("vec")).limit(TUNED).select("vec").toArrow()
    queries = matrix(some.column("vec"), width)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                q, row, score = nearest(matrix(batch.column("vec"), width), queries, batch.column("least").to_numpy(), k + 1)
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(score), batch.column("leaves").take(pa.array(row))], ["q", "score", "leaves"])

    own = Window.partitionBy("q").orderBy("score", "leaves")
    best = indexed.select("vec", F.xxhash64("vec").alias("least"), "leaves").mapInArrow(look, "q long, score double, leaves array<int>")
    found = best.withColumn("no", F.row_number().over(own)).where(F.col("no") <= k + 1).toArrow()
    if not found.num_rows:
        return 1
    leaves = np.stack(found.column("leaves").to_pylist())
    needed = []
    trees = np.arange(leaves.shape[1])
    for q in range(len(queries)):
        far = forest.far(queries[q])
        rank = np.searchsorted(np.sort(far, axis=None), far, "right")  # leaves visited when this one surely is
        mine = leaves[(found.column("q").to_numpy() == q) & (found.column("score").to_numpy() > 0)]
        needed += rank[trees, mine].min(1).tolist()
    needed.sort()
    return needed[int(np.ceil(TARGET * len(needed))) - 1] if needed else 1


def neighbours(df: DataFrame, wanted: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Columns query_id, rank (from 1), id, score: the k nearest found by Euclidean distance of the rows that `wanted` holds for.

    wanted is a condition on the column `id`. Candidates are all rows of other ids; fewer than k are all returned. Ties go to
    the smaller id. Rows without an id, and vectors that are null, zero, or hold nulls or numbers that are not finite, take no
    part, nor do vectors of another length than the commonest (the longest of those). Rows of equal id and vector are one; a
    query id of several vectors has an answer for each. Other columns, whatever their names, are left out.

    Equal vectors are indexed once, with their k + 1 least ids, which are all that an answer can hold. The trees are fitted
    on a bounded sample; how many leaves are visited is measured on each table, by `budget`. A leaf and its visitors
    meet in groups of at most TOGETHER rows and as many queries.
    """
    spark = df.sparkSession
    own, width = usable(df, id_col, vec_col)
    own = durable(own)
    by_id = Window.partitionBy("vec").orderBy("id")
    listed = own.withColumn("no", F.row_number().over(by_id)).where(F.col("no") <= k + 1).groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    classes = durable(listed.withColumn("class", F.monotonically_increasing_id()))
    total = classes.count()
    kind = own.schema["id"].dataType.simpleString()
    if not total:
        return own.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), "id", F.lit(0.0).alias("score"))
    forest = fit(classes, width, total)
    sent = spark.sparkContext.broadcast(forest)  # as many nodes as the sample has room for
    vec = classes.schema["vec"].dataType.simpleString()

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = sent.value.leaves(matrix(batch.column("vec"), width).astype(np.float32))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, leaves.size + 1, leaves.shape[1], dtype=np.int32)), pa.array(leaves.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, flat], ["class", "least", "vec", "leaves"])

    indexed = durable(classes.select("class", F.col("ids")[0].alias("least"), "vec").mapInArrow(route, f"class long, least {kind}, vec {vec}, leaves array<int>"))
    asked = durable(own.where(wanted).groupBy("vec").agg(F.count("*").alias("n")).withColumn("q", F.monotonically_increasing_id()))
    most = budget(indexed, asked, forest, width, k)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x in enumerate(matrix(batch.column("vec"), width)):
                seen = np.array(list(sent.value.visits(x, most)), np.int32)
                one = pa.array(np.full(len(seen), i))
                yield pa.RecordBatch.from_arrays([batch.column("q").take(one), pa.array(seen[:, 0]), pa.array(seen[:, 1])], ["q", "tree", "leaf"])

    visits = durable(asked.select("q", "vec").mapInArrow(walk, "q long, tree int, leaf int"))
    placed = indexed.select("class", "least", "vec", F.posexplode("leaves").alias("tree", "leaf"))
    # One row a leaf, so a table bounded by the trees' size: into how many parts its rows and its visitors are dealt.
    parts = lambda n: F.ceil(n / TOGETHER).cast("int")
    rows_of = placed.groupBy("tree", "leaf").agg(parts(F.count("*")).alias("parts"))
    seen_by = visits.groupBy("tree", "leaf").agg(parts(F.count("*")).alias("turns"))
    sizes = F.broadcast(rows_of.join(seen_by, ["tree", "leaf"]))
    dealt = lambda key, of: F.pmod(F.xxhash64(key), F.col(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    there = placed.join(sizes, ["tree", "leaf"]).select("tree", "leaf", dealt("class", "parts").alias("part"), each("turns").alias("turn"), "class", "least", "vec")
    here = visits.join(sizes, ["tree", "leaf"]).select("tree", "leaf", each("parts").alias("part"), dealt("q", "turns").alias("turn"), "q").join(asked.select("q", "vec"), "q")

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"q": pa.array([], pa.int64()), "class": pa.array([], pa.int64()), "least": left.column("least").slice(0, 0), "score": pa.array([], pa.float64())})
        # Ids are compared by their order, of whatever type they are.
        order = np.argsort(np.argsort(left.column("least").to_numpy(), kind="stable"), kind="stable")
        q, row, score = nearest(matrix(left.column("vec"), width), matrix(right.column("vec"), width), order, k + 1)
        return pa.table({"q": right.column("q").take(pa.array(q)), "class": left.column("class").take(pa.array(row)), "least": left.column("least").take(pa.array(row)), "score": pa.array(score)})

    groups = ("tree", "leaf", "part", "turn")
    met = there.groupBy(*groups).cogroup(here.groupBy(*groups)).applyInArrow(rank, f"q long, class long, least {kind}, score double")
    best = met.distinct().withColumn("no", F.row_number().over(Window.partitionBy("q").orderBy("score", "least", "class"))).where(F.col("no") <= k + 1)
    found = best.select("q", "class", "score").join(classes.select("class", "ids"), "class").select("q", "score", F.explode("ids").alias("id"))
    lists = durable(found.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "id"))), 1, k + 1).alias("near")))
    release(visits)
    queries = own.where(wanted).select(F.col("id").alias("query_id"), "vec").join(asked.select("q", "vec"), "vec").select("query_id", "q")
    out = queries.join(lists, "q").select("query_id", F.posexplode(F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)).alias("no", "x"))
    return out.select("query_id", (F.col("no") + 1).alias("rank"), F.col("x.id").alias("id"), F.col("x.score").alias("score"))
