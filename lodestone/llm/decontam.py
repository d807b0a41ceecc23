"""Benchmark passages in training documents, found with an FM-index for each shard of the documents."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, code_points, durable, fresh, release, runs, slices, span_hashes

WINDOW = 13
#: Words of items that are searched for in one pass over the indexes.
PASS_WORDS = 200_000
#: Words of a shard, about; a longer document is a shard of its own.
SHARD_SYMBOLS = 150_000
SAMPLE = 8
#: Bytes of texts or shards that a Python worker is handed at once, about; a longer one is handed alone.
BATCH_BYTES = 8 << 20

SPANS = "array<struct<first:long,last:long,from:long,to:long>>"


def words_of(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts: hash, row, start and end in the text, in code points.

    A-Z count as a-z; words are runs of 0-9, a-z and of code points above 127.
    """
    points, begin = code_points(texts)
    upper = (points >= 65) & (points <= 90)
    points = points + (upper * np.uint32(32)).astype(np.uint32)
    start, end = runs(((points >= 48) & (points <= 57)) | ((points >= 97) & (points <= 122)) | (points >= 128))
    row = np.searchsorted(begin, start, "right") - 1
    return span_hashes(points, start, end), row, start - begin[row], end - begin[row]


class FMIndex:
    """FM-index of a sequence of symbols 1..n_symbols in runs: suffix order, wavelet-tree ranks, sampled positions.

    A zero ends each run. The zeros differ in order, so no suffix comparison passes the end of a run, and are never
    searched for. Positions are sampled at each run's start and each `SAMPLE` symbols.
    """

    def __init__(self, text: np.ndarray, n_symbols: int):
        n = len(text)
        ends = np.flatnonzero(text == 0)
        code = text.astype(np.int64) + len(ends)
        code[ends] = np.arange(len(ends))
        # First by as many symbols as fit into one number, then doubling; suffixes that are told apart are not sorted again.
        base = int(code.max(initial=0)) + 1
        step = max(1, min(4, 62 // base.bit_length()))
        key = np.zeros(n, np.int64)
        for k in range(step):
            key *= base
            key[: max(n - k, 0)] += code[k:]
        order = np.argsort(key)
        fresh = np.concatenate(([True], np.diff(key[order]) != 0))
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        tied = np.flatnonzero(~(fresh & np.concatenate((fresh[1:], [True]))))
        while len(tied):
            some = order[tied]
            key = rank[some] * n + rank[some + step]
            by = np.argsort(key)
            some, key = some[by], key[by]
            fresh = np.concatenate(([True], np.diff(key) != 0))
            order[tied] = some
            rank[some] = np.maximum.accumulate(np.where(fresh, tied, 0))
            tied = tied[~(fresh & np.concatenate((fresh[1:], [True])))]
            step *= 2
        bwt = text[order - 1]
        self.counts = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=n_symbols + 1))))
        self.depth = max(1, int(n_symbols).bit_length())
        # Each level holds the ranks of one bit; rows with a 0 come first on the next level.
        self.ones, self.zeros = [], []
        level = bwt.astype(np.int32)
        for d in reversed(range(self.depth)):
            bit = (level >> d) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int32))
            self.zeros.append(int(n - bit.sum()))
            level = np.concatenate((level[bit == 0], level[bit == 1]))
        start = np.ones(n, bool)
        start[1:] = text[:-1] == 0
        sampled = (start | (np.arange(n) % SAMPLE == 0))[order]
        self.sampled, self.before, self.positions = sampled, np.concatenate(([0], np.cumsum(sampled))), order[sampled]

    def parts(self) -> dict:
        """What the index is stored as: its bits, and the sampled positions."""
        return {"ones": [np.packbits(np.diff(x) > 0) for x in self.ones], "zeros": self.zeros, "counts": self.counts.astype(np.uint32), "depth": self.depth, "sampled": np.packbits(self.sampled), "positions": self.positions.astype(np.uint32), "n": len(self.sampled)}

    @classmethod
    def of(cls, parts: dict) -> FMIndex:
        """The index that was stored as parts; nothing is sorted again."""
        self, n = cls.__new__(cls), parts["n"]
        self.ones = [np.concatenate(([0], np.cumsum(np.unpackbits(x, count=n), dtype=np.int32))) for x in parts["ones"]]
        self.zeros, self.depth, self.counts = parts["zeros"], parts["depth"], parts["counts"].astype(np.int64)
        self.sampled = np.unpackbits(parts["sampled"], count=n).astype(bool)
        self.before, self.positions = np.concatenate(([0], np.cumsum(self.sampled))), parts["positions"].astype(np.int64)
        return self

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each row of the last column."""
        low = np.zeros_like(at)
        for d, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            bit = (symbol >> (self.depth - 1 - d)) & 1
            low = np.where(bit == 1, zeros + ones[low], low - ones[low])
            at = np.where(bit == 1, zeros + ones[at], at - ones[at])
        return at - low

    def symbol(self, row: np.ndarray) -> np.ndarray:
        out = np.zeros_like(row)
        for ones, zeros in zip(self.ones, self.zeros):
            bit = ones[row + 1] - ones[row]
            out = out * 2 + bit
            row = np.where(bit == 1, zeros + ones[row], row - ones[row])
        return out

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows (low, high) of each pattern, by backward search. Patterns end at the right of the matrix."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(self.sampled), np.int64)
        for k in range(1, patterns.shape[1] + 1):
            live = np.flatnonzero((lengths >= k) & (low < high))
            if not len(live):
                break
            c = patterns[live, -k]
            low[live] = self.counts[c] + self.rank(c, low[live])
            high[live] = self.counts[c] + self.rank(c, high[live])
        return low, np.maximum(low, high)

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Positions in the sequence of rows, by steps to the left until one is sampled."""
        out, steps, live = np.zeros(len(row), np.int64), 0, np.arange(len(row))
        row = row.copy()
        while len(live):
            here = self.sampled[row[live]]
            done = live[here]
            out[done] = self.positions[self.before[row[done]]] + steps
            live = live[~here]
            c = self.symbol(row[live])
            row[live] = self.counts[c] + self.rank(c, row[live])
            steps += 1
        return out


def least_type(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


class Shard:
    """The words of some documents in an FM-index, and where each of them stands.

    Documents are cut into chunks that overlap by a window less one word, so that each window lies whole in one and no
    repeated passage makes suffixes long to compare; each chunk ends with a zero.
    """

    def __init__(self, hashes: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray, numbers: np.ndarray, window: int = WINDOW):
        step = max(116, 8 * window)
        self.vocabulary, symbol = np.unique(hashes, return_inverse=True)
        counts = np.bincount(row, minlength=len(numbers))
        many = np.maximum(1, -(-(counts - window + 1) // step)) * (counts > 0)
        self.row = np.repeat(np.arange(len(numbers)), many)
        self.first = (np.arange(len(self.row)) - np.repeat(np.cumsum(many) - many, many)) * step
        size = np.minimum(step + window - 1, counts[self.row] - self.first)
        self.begin = np.cumsum(size + 1) - size - 1
        at = np.arange(int((size + 1).sum())) - np.repeat(self.begin - (np.cumsum(counts) - counts)[self.row] - self.first, size + 1)
        at = np.minimum(at, max(len(symbol) - 1, 0))
        text = symbol[at] + 1
        text[self.begin + size] = 0
        self.index = FMIndex(text, len(self.vocabulary)) if len(text) else None
        self.row = numbers[self.row]
        # Where words stand: the start of a chunk's first word, then gaps and lengths.
        self.at = start[at[self.begin]] if len(text) else np.zeros(0, np.int64)
        gap = np.concatenate(([0], start[1:] - end[:-1])) if len(start) else start
        self.gap, self.long = np.maximum(gap, 0)[at], (end - start)[at]
        self.gap[self.begin] = 0

    def stored(self) -> bytes:
        parts = {k: least_type(getattr(self, k)) for k in ("row", "first", "begin", "at", "gap", "long")}
        return pickle.dumps(parts | {"vocabulary": self.vocabulary, "index": self.index.parts() if self.index else None}, 5)

    @classmethod
    def of(cls, stored: bytes) -> Shard:
        self, parts = cls.__new__(cls), pickle.loads(stored)
        for k in ("row", "first", "begin", "at"):
            setattr(self, k, parts[k].astype(np.int64))
        self.gap, self.long, self.vocabulary = parts["gap"], parts["long"], parts["vocabulary"]
        self.index = FMIndex.of(parts["index"]) if parts["index"] else None
        return self

    def occurrences(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, place in the indexed sequence) of all occurrences, by backward search and sampled positions."""
        none = np.zeros(0, np.int64)
        if self.index is None or not len(phrases.patterns):
            return none, none
        at = np.minimum(np.searchsorted(self.vocabulary, phrases.vocabulary), len(self.vocabulary) - 1)
        symbol = np.concatenate(([0], np.where(self.vocabulary[at] == phrases.vocabulary, at + 1, -1)))
        known = symbol >= 0
        live = np.flatnonzero(known[phrases.patterns].all(axis=1))
        low, high = self.index.search(symbol[phrases.patterns[live]], phrases.lengths[live])
        many = high - low
        rows = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - low, many)
        return np.repeat(live, many), self.index.locate(rows)

    def find(self, phrases: Phrases) -> dict[int, tuple[list, list]]:
        """For each document with hits: spans of words hit, merged (first word, word after the last, from, to), and item ids."""
        pattern, place = self.occurrences(phrases)
        if not len(pattern):
            return {}
        chunk = np.searchsorted(self.begin, place, "right") - 1
        row, first = self.row[chunk], self.first[chunk] + place - self.begin[chunk]
        last = first + phrases.lengths[pattern]
        # Character positions: from the start of the chunk over the gaps and words before.
        ends = np.cumsum(self.gap.astype(np.int64) + self.long)
        base = self.at[chunk] - (ends - self.long)[self.begin[chunk]]
        start, end = base + (ends - self.long)[place], base + ends[place + phrases.lengths[pattern] - 1]
        out: dict = {}
        order = np.lexsort((last, first, row))
        for r, a, b, c, d in zip(*(x[order].tolist() for x in (row, first, last, start, end))):
            spans = out.setdefault(r, ([], set()))[0]
            if spans and a <= spans[-1][1]:
                if b > spans[-1][1]:
                    spans[-1] = (spans[-1][0], b, spans[-1][2], d)
            else:
                spans.append((a, b, c, d))
        many = phrases.item_start[pattern + 1] - phrases.item_start[pattern]
        which = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - phrases.item_start[pattern], many)
        pairs = np.unique(np.stack([np.repeat(row, many), phrases.item_of[which]], axis=1), axis=0)
        for r, i in pairs.tolist():
            out[r][1].add(phrases.items[i])
        return {r: (spans, sorted(items)) for r, (spans, items) in out.items()}


class Phrases:
    """Distinct windows of items, as symbols (from 1) of the items' own words."""

    def __init__(self, ids: list[str | None], texts: list[str | None], window: int = WINDOW):
        hashes, row, _, _ = words_of(texts)
        self.vocabulary, symbols = np.unique(hashes, return_inverse=True)
        n = np.bincount(row, minlength=len(texts))
        begin = np.concatenate(([0], np.cumsum(n)))[:-1]
        many = np.maximum(n - window + 1, np.minimum(n, 1))
        item = np.repeat(np.arange(len(texts)), many)
        at = np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many) + begin[item]
        lengths = np.minimum(n[item], window)
        shift = np.arange(window) - window + lengths[:, None]
        table = np.where(shift >= 0, symbols[np.minimum(at[:, None] + np.maximum(shift, 0), max(len(symbols) - 1, 0))] + 1 if len(symbols) else 0, 0)
        self.patterns, which = np.unique(table.reshape(-1, window).astype(np.int32), axis=0, return_inverse=True)
        self.lengths = (self.patterns > 0).sum(axis=1)
        pair = np.unique(np.stack([which.ravel(), item], axis=1), axis=0) if len(item) else np.zeros((0, 2), np.int64)
        pair = pair[np.array([ids[i] is not None for i in pair[:, 1]], bool)]
        self.items, self.item_of = ids, pair[:, 1]
        self.item_start = np.searchsorted(pair[:, 0], np.arange(len(self.patterns) + 1))


def indexed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents' indexes as a table: a row (row, id, n_words) for each document, and one (shard) for each shard.

    Shards are made in the tasks that read the documents; nothing is shuffled. `row` numbers the documents. The table is
    written once, and read for each pass of a search and for any number of benchmarks.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = batch.column(1).to_pylist()
            numbers = number + np.arange(len(texts))
            number += len(texts)
            words = np.zeros(len(texts), np.int64)
            for part in slices(texts, 7 * SHARD_SYMBOLS):
                hashes, row, start, end = words_of(texts[part])
                words[part] = np.bincount(row, minlength=part.stop - part.start)
                shard = Shard(hashes, row, start, end, numbers[part], window).stored()
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, batch.column(0).type), pa.nulls(1, pa.int64()), pa.array([shard], pa.binary())], ["row", "id", "n_words", "shard"])
            yield pa.RecordBatch.from_arrays([pa.array(numbers), batch.column(0), pa.array(words), pa.nulls(len(texts), pa.binary())], ["row", "id", "n_words", "shard"])

    made = own.mapInArrow(build, f"row long, id {own.schema['id'].dataType.simpleString()}, n_words long, shard binary")
    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        return durable(made)


def passes(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[tuple[list, list]]:
    """The items in blocks of about PASS_WORDS words."""
    ids, texts, total = [], [], 0
    for r in benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null").toLocalIterator():
        ids.append(r.i)
        texts.append(r.t)
        total += len(r.t) // 6 + 1
        if total >= PASS_WORDS:
            yield ids, texts
            ids, texts, total = [], [], 0
    if ids:
        yield ids, texts


def united(spans: Column) -> Column:
    """An array of spans as the spans that they cover together, in order."""

    def add(out: Column, s: Column) -> Column:
        top = F.element_at(out, -1)
        wider = F.struct(top["first"].alias("first"), F.greatest(top["last"], s["last"]).alias("last"), top["from"].alias("from"), F.greatest(top["to"], s["to"]).alias("to"))
        joined = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(wider))
        return F.when((F.size(out) > 0) & (F.try_element_at(out, F.lit(-1))["last"] >= s["first"]), joined).otherwise(F.array_append(out, s))

    return F.aggregate(F.array_sort(spans), F.array().cast(SPANS), add)


def search(index: DataFrame, benchmark: DataFrame, item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Columns id, n_words, spans (words hit, merged, by words and by code points), items (sorted ids), for each document.

    A window is `window` consecutive words of an item; a shorter item with any word is one window. The items are taken
    in blocks of bounded size, each searched for in one pass over the stored indexes; what a pass finds is written, so
    that no block outlives its pass. Null texts have no words; null item ids are not listed; repeated ids are listed
    once. A benchmark without words hits nothing.
    """
    spark = index.sparkSession
    shards = index.where("shard is not null").select("shard")
    found = None
    for ids, texts in passes(benchmark, item_col, item_text):
        shared = spark.sparkContext.broadcast(Phrases(ids, texts, window))

        def look(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("first", "last", "from", "to")]))
            for batch in batches:
                for stored in batch.column(0):
                    got = Shard.of(stored.as_py()).find(shared.value)
                    if got:
                        spans = [[dict(zip(("first", "last", "from", "to"), s)) for s in spans] for spans, _ in got.values()]
                        yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int64()), pa.array(spans, kind), pa.array([items for _, items in got.values()], pa.list_(pa.string()))], ["row", "spans", "items"])

        with arrow_batches(spark, BATCH_BYTES):
            part = durable(shards.mapInArrow(look, f"row long, spans {SPANS}, items array<string>"))
        shared.destroy()
        found = part if found is None else found.unionByName(part)
    base = index.where("row is not null").select("row", "id", "n_words")
    if found is None:
        return base.select("id", "n_words", F.array().cast(SPANS).alias("spans"), F.array().cast("array<string>").alias("items"))
    found = found.groupBy(F.col("row").alias("_row")).agg(united(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    met = base.join(found, F.col("row") == F.col("_row"), "left")
    return met.select("id", "n_words", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def n_hit() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])


def contaminated(share: int = 20) -> Column:
    """Any word is hit, and at least one of `share` words is."""
    return (n_hit() > 0) & (share * n_hit() >= F.col("n_words"))


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, n_words, n_hit, items (sorted as strings), removal (spans of code points), contaminated, for every row."""
    found = search(indexed(docs, id_col, text_col), benchmark)
    return found.select("id", "n_words", n_hit().alias("n_hit"), "items", F.transform("spans", lambda s: F.struct(s["from"].alias("from"), s["to"].alias("to"))).alias("removal"), contaminated().alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the contaminated documents; all others stay as they are, null texts and repeated rows included.

    Whether a document is contaminated depends on its text alone, so that documents go by the digest of their text. The
    digests that go are written first: Spark broadcasts them if they are few, else both sides are joined by key.
    """
    digest = F.md5(F.col(f"`{text_col}`").cast("string"))
    index = indexed(docs.select(digest.alias("digest"), F.col(f"`{text_col}`").alias("text")), "digest", "text")
    name = fresh(docs, "_gone")
    gone = durable(search(index, benchmark).where(contaminated()).select(F.col("id").alias(name)).distinct())
    release(index)
    return docs.join(gone, digest == F.col(name), "left_anti")
