"""Importance resampling towards a target text, over word n-grams hashed into buckets.

Each different n-gram is hashed once: texts are cut into blocks, whose different n-grams with their counts meet, by
n-gram, in a dictionary. That gives the buckets' sums, and each block gets the buckets of its own n-grams back.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, columns, durable, fresh, slices

BUCKETS = 10_000
#: Characters of the texts of a block, about; each text is whole.
BLOCK = 8_000_000
#: Words of all texts for each part that the dictionary is cut into, about.
PART_WORDS = 500_000
#: What is no word: ASCII but for digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def packed(data: np.ndarray | memoryview) -> bytes:
    return zstandard.compress(data.tobytes())


def unpacked(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def ended(strings: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The strings' bytes, each with a line feed behind it, and where each begins (with the end as last entry)."""
    whole = pc.binary_join_element_wise(strings.cast(pa.large_string()), pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    _, starts, data = whole.buffers()
    return memoryview(data or b""), np.frombuffer(starts, np.int64)[: len(whole) + 1]


def lines(data: bytes) -> pa.Array:
    """The strings that `ended` wrote."""
    return pc.split_pattern(pa.array([zstandard.decompress(data)[:-1]], pa.large_binary()).cast(pa.large_string()), "\n").flatten()


def blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """block, ids, sizes (words of each text), words (the different ones, in order), places (of each word of the texts in these)."""
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for some in slices(batch.column("text").to_pylist(), BLOCK):
                ids, texts = (batch.column(i).slice(some.start, some.stop - some.start) for i in (0, 1))
                plain = pc.replace_substring_regex(pc.ascii_lower(texts.fill_null("")), BETWEEN, " ")
                listed = pc.ascii_split_whitespace(plain)
                flat, text_of = listed.flatten(), pc.list_parent_indices(listed).to_numpy()
                word = pc.greater(pc.binary_length(flat), 0)
                flat, text_of = flat.filter(word), text_of[word.to_numpy(zero_copy_only=False)]
                coded = flat.dictionary_encode()
                order = pc.sort_indices(coded.dictionary).to_numpy()
                place = np.empty(len(order), np.int32)
                place[order] = np.arange(len(order), dtype=np.int32)
                sizes = np.bincount(text_of, minlength=len(texts)).astype(np.int32)
                words = ended(coded.dictionary.take(pa.array(order)))[0]
                row = [[(task << 32) + n], [ids.to_pylist()], [sizes.tolist()], [packed(words)], [packed(place[coded.indices.to_numpy()])]]
                yield pa.RecordBatch.from_arrays([pa.array(row[0]), pa.array(row[1], pa.list_(ids.type)), pa.array(row[2], pa.list_(pa.int32())), *map(pa.array, row[3:])], ["block", "ids", "sizes", "words", "places"])
                n += 1

    return own.mapInArrow(cut, f"block long, ids array<{own.schema['id'].dataType.simpleString()}>, sizes array<int>, words binary, places binary")


class Features:
    """The different features of a block: its words, then its pairs of adjacent words, each in order."""

    def __init__(self, sizes: np.ndarray, words: bytes, places: bytes, parts: int):
        self.places = unpacked(places, np.int32).astype(np.int64)
        self.words = lines(words) if len(self.places) else pa.array([], pa.large_string())
        self.ends = np.cumsum(sizes)
        inner = np.ones(max(0, len(self.places) - 1), bool)
        cuts = self.ends[(self.ends > 0) & (self.ends < len(self.places))]
        inner[cuts - 1] = False
        n = len(self.words)
        pair = (self.places[:-1] * n + self.places[1:])[inner]
        self.second = np.flatnonzero(inner) + 1  # where each pair ends
        self.pairs, self.pair_of, times = np.unique(pair, return_inverse=True, return_counts=True)
        self.first, self.last = np.divmod(self.pairs, max(n, 1))
        self.times = np.concatenate([np.bincount(self.places, minlength=n), times]).astype(np.int32)
        own = np.fromiter((crc32(x.encode()) for x in self.words.to_pylist()), np.int64, n)
        self.part = np.concatenate([own, own[self.first] * 31 + own[self.last]]) % parts
        self.order = np.argsort(self.part, kind="stable")  # by part, and there words before pairs

    def strings(self) -> pa.Array:
        return pa.concat_arrays([self.words, pc.binary_join_element_wise(self.words.take(pa.array(self.first)), self.words.take(pa.array(self.last)), pa.scalar(" ", pa.large_string()))])

    def sums(self, gains: np.ndarray) -> np.ndarray:
        """For each text, the sum over its features of what `gains` has for each different one."""
        n = len(self.words)
        each = gains[self.places]
        each[self.second] += gains[n + self.pair_of]
        total = np.concatenate([[0], np.cumsum(each)])
        return np.diff(np.concatenate([[0], total[self.ends]]))


def dictionary(cut: DataFrame, parts: int) -> DataFrame:
    """part, block, buckets (of the block's features of this part, in order), totals (of all buckets, in one row a part).

    A feature is a row of its block only, however often it occurs there; so a frequent one is as many rows as there are
    blocks at most. A part holds about PART_WORDS words' features.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = Features(np.array(row["sizes"], np.int64), row["words"], row["places"], parts)
                found, start = np.unique(own.part[own.order], return_index=True)
                ends = np.append(start[1:], len(own.order))
                data, begin = ended(own.strings().take(pa.array(own.order)))
                times = own.times[own.order]
                out = [pa.array(found.astype(np.int32)), pa.array(np.full(len(found), row["block"])), pa.array([packed(data[begin[a] : begin[b]]) for a, b in zip(start, ends)], pa.binary()), pa.array([packed(times[a:b]) for a, b in zip(start, ends)], pa.binary())]
                yield pa.RecordBatch.from_arrays(out, ["part", "block", "features", "times"])

    def merge(table: pa.Table) -> pa.Table:
        strings = [lines(x.as_py()) for x in table.column("features")]
        times = [unpacked(x.as_py(), np.int32) for x in table.column("times")]
        coded = pa.concat_arrays(strings).dictionary_encode()
        which = coded.indices.to_numpy()
        total = np.bincount(which, np.concatenate(times), len(coded.dictionary))
        # The one place where features are hashed: each different one of all texts once.
        bucket = np.fromiter((crc32(x.encode()) for x in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary)) % BUCKETS
        sums = np.bincount(bucket, total, BUCKETS).astype(np.int64)
        mine = np.split(bucket[which].astype(np.int32), np.cumsum([len(x) for x in times])[:-1])
        totals = pa.array([sums.tolist(), *[None] * (len(mine) - 1)], pa.list_(pa.int64()))
        return pa.table({"part": table.column("part"), "block": table.column("block"), "buckets": pa.array([packed(x) for x in mine]), "totals": totals})

    sent = cut.select("block", "sizes", "words", "places").mapInArrow(send, "part int, block long, features binary, times binary")
    return sent.groupBy("part").applyInArrow(merge, "part int, block long, buckets binary, totals array<long>")


def counted(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, int, np.ndarray]:
    """blocks and dictionary of texts, as written tables; into how many parts; and the features in each bucket."""
    with arrow_batches(docs.sparkSession, 2 * BLOCK):
        cut = durable(blocks(docs, id_col, text_col))
    words = cut.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    parts = 1 + words // PART_WORDS
    known = durable(dictionary(cut, parts))
    sums = known.where("totals is not null").select(F.posexplode("totals").alias("bucket", "n")).groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    held = np.zeros(BUCKETS, np.int64)  # of fixed size
    held[sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    return cut, known, parts, held


def weights(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, n_words, n_features, weight, one row for each of docs: the floored mean gain of a text's features.

    Features are the words and pairs of adjacent words of a text, A-Z as a-z; a bucket's gain is the floor of 1000 times the
    logarithm of its share in target over that in docs, each share with one more in every bucket. Null and empty texts, and
    texts without a word, have no features and weight 0; repeated rows count as often as they are there. Ids may be of any
    type, null or repeated. A text of any length is in one block. Empty tables have no features.
    """
    cut, known, parts, here = counted(docs, id_col, text_col)
    there = counted(target.select(F.lit(0).alias("id"), F.col(f"`{text_col}`").alias("text")), "id", "text")[3]
    ratio = (there + 1) * (here.sum() + BUCKETS).astype(np.float64) / ((here + 1) * (there.sum() + BUCKETS).astype(np.float64))
    gains = np.floor(1000 * np.log(ratio)).astype(np.int64)
    kind = cut.schema["ids"].dataType.elementType.simpleString()

    def weigh(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            sizes = np.array(row["sizes"], np.int64)
            own = Features(sizes, row["words"], row["places"], parts)
            told = {p: unpacked(b, np.int32) for p, b in zip(right.column("part").to_pylist(), right.column("buckets").to_pylist())}
            bucket = np.empty(len(own.order), np.int64)
            if told:
                bucket[own.order] = np.concatenate([told[p] for p in sorted(told)])
            n = np.maximum(2 * sizes - 1, 0)
            ids = left.column("ids").combine_chunks().flatten()
            out.append(pa.table({"id": ids, "n_words": sizes, "n_features": n, "weight": own.sums(gains[bucket]) // np.maximum(n, 1)}))
        return pa.concat_tables(out) if out else pa.table({"id": left.column("ids").combine_chunks().flatten(), **{c: pa.array([], pa.int64()) for c in ("n_words", "n_features", "weight")}})

    return cut.groupBy("block").cogroup(known.select("part", "block", "buckets").groupBy("block")).applyInArrow(weigh, f"id {kind}, n_words long, n_features long, weight long")


def noise(id_: Column, seed: int = 7) -> Column:
    """Gumbel noise times 1000, floored, by a hash of seed and id; a null id is written as nothing."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def drawn(weighed: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """weighed with score and rank: of the rows with `least_words`, the floor of `percent` % with the highest scores, ties to
    smaller ids, are drawn without replacement; the rank of others is null. Rows of one id come by weight, then features.

    Places are counted by score: there are as many different scores as the gains' and the noise's range has numbers, however
    many rows there are, and each has a small part of the rows.
    """
    rows = durable(weighed.withColumn("score", F.col("weight") + noise(F.col("id"), seed)).withColumn("able", F.col("n_words") >= least_words))
    able = rows.where("able").groupBy(F.col("score").alias("s")).agg(F.count("*").alias("n"))
    before = Window.orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, -1)
    starts = durable(able.select("s", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    most = (starts.agg(F.sum("n")).first()[0] or 0) * percent // 100
    within = Window.partitionBy("able", "score").orderBy("id", "weight", "n_features")
    met = rows.join(F.broadcast(starts.select("s", "start")), F.col("able") & (F.col("score") == F.col("s")), "left")
    place = F.col("start") + F.row_number().over(within)
    return met.select("id", "n_words", "n_features", "weight", "score", F.when(F.col("able") & (place <= most), place).cast("long").alias("rank"))


def resampled(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are drawn, with all their columns; of repeated ids, each row of a drawn one."""
    of = fresh(docs, "_of")
    ids = drawn(weights(docs, target, id_col, text_col), percent, least_words, seed).where("rank is not null").select(F.col("id").alias(of)).distinct()
    return docs.join(ids, F.col(f"`{id_col}`").eqNullSafe(F.col(of)), "left_semi").select(*columns(docs))
