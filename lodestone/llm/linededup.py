"""Lines that repeat earlier lines, found by an exact set-similarity join."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, code_points, durable, fresh, mix, release, runs, slices, span_hashes

#: Counters of the rarity table, and counters that one row of it holds.
BUCKETS, SLAB = 1 << 19, 1 << 14
LOW = np.uint64((1 << 40) - 1)
#: Classes that a task remembers, so that it stores what is known of each once.
SEEN = 300_000
#: Lines that are ordered at once by one number for each token.
LINES = 1 << 19
#: Cells of the filters of a fixed size, and rows that hold one.
FILTER, SLABS = 1 << 25, 64
#: Rows of one token that a task holds while it looks for partners, and neighbours that it looks at for each.
HELD, LOOK = 500_000, 4096
#: Rows that are handed over at once where classes meet: each look at a neighbour is one step for all of them.
MEETING = 1 << 16
#: Classes that are compared with each other at a time, and pairs and tokens that are looked at together.
BLOCK, PAIRS, TOKENS = 4096, 200_000, 1_000_000
#: Sets of at least so many tokens have sketches of two and of four words.
TWO, FOUR = 96, 200
NEAR = 0.8

SKETCH = "s0 long, s1 long, s2 long, s3 long"


@cache
def spaces() -> np.ndarray:
    table = np.fromiter((chr(c).isspace() for c in range(0x110000)), bool, 0x110000)
    table[0] = True
    return table


def line_tokens(texts: Sequence[str | None], words: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of the lines of texts: 64-bit hash and line of each; row and number in its row of each line.

    A line's tokens are its lower-case words if `words`, else the adjacent pairs of these, or its word if it has one.
    Lines end at line feeds only; a NUL character is white space within its line.
    """
    points, begin = code_points([(t or "").lower() for t in texts])
    last = points == 10
    last[begin[1:] - 1] = True
    ends = np.flatnonzero(last)
    start, end = runs(~spaces()[points])
    of = np.searchsorted(ends, start)
    h = span_hashes(points, start, end)
    if words:
        token, line = h, of
    else:
        pair = of[1:] == of[:-1]
        alone = np.ones(len(h), bool)
        alone[1:] &= ~pair
        alone[:-1] &= ~pair
        token = np.concatenate([mix(h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:])[pair], h[alone]])
        line = np.concatenate([of[:-1][pair], of[alone]])
    row = np.searchsorted(begin, ends, "right") - 1
    first = np.searchsorted(row, np.arange(len(texts)))
    return token, line, row, np.arange(len(ends)) - first[row]


def ordered(token: np.ndarray, line: np.ndarray, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different tokens of each line, and the line of each: by line, then `rare`, then a fixed order of all tokens."""
    if len(line) and line.max() < LINES:
        code = line.astype(np.uint64) << np.uint64(45) | rare << np.uint64(40) | token & LOW
        order = np.argsort(code)
        code, one = code[order], token[order]
        same = code[1:] == code[:-1]
        if (one[1:][same] == one[:-1][same]).all():
            keep = np.concatenate(([True], ~same))
            return one[keep], line[order][keep]
    order = np.lexsort((token, token & LOW, rare, line))
    token, line = token[order], line[order]
    keep = np.ones(len(token), bool)
    keep[1:] = (token[1:] != token[:-1]) | (line[1:] != line[:-1])
    return token[keep], line[keep]


def rarity(docs: DataFrame, text_col: str = "text", words: bool = True) -> np.ndarray:
    """How often the tokens of each bucket occur in all lines: a table of fixed size, added up slab by slab."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for part in slices(texts):
                token, _, _, _ = line_tokens(texts[part], words)
                sums += np.bincount((token & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        yield pa.RecordBatch.from_pydict({"slab": pa.array(np.arange(BUCKETS // SLAB, dtype=np.int32)), "n": [s.astype("<u4").tobytes() for s in np.minimum(sums, 2**32 - 1).reshape(-1, SLAB)]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(b, "<u4") for b in pdf["n"]], axis=0, dtype=np.int64)
        return pd.DataFrame({"slab": pdf["slab"][:1], "n": [total.astype("<i8").tobytes()]})

    slabs = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(count, "slab int, n binary")
    found = slabs.groupBy("slab").applyInPandas(add, "slab int, n binary").collect()  # BUCKETS numbers in all
    table = np.zeros((BUCKETS // SLAB, SLAB), np.int64)
    for r in found:
        table[r.slab] = np.frombuffer(r.n, "<i8")
    return table.ravel()


def least_overlap(n, m, near: float = NEAR):
    """Tokens that sets of n and m tokens share at least if their Jaccard similarity is `near`."""
    return np.ceil(near / (1 + near) * (n + m) - 1e-9).astype(np.int64)


def prefix_length(n, near: float = NEAR):
    return n - np.ceil(near * n - 1e-9).astype(np.int64) + 1


def gathered(token: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first `size` tokens from each `start`, one after the other."""
    return token[np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)]


def common(token: np.ndarray, start: np.ndarray, i: np.ndarray, j: np.ndarray, of_i: np.ndarray, of_j: np.ndarray) -> np.ndarray:
    """How many of the first of_i tokens of sets i are among the first of_j tokens of sets j."""
    out = np.zeros(len(i), np.int64)
    ends = np.cumsum(of_i + of_j)
    cuts = np.searchsorted(ends, np.arange(TOKENS, int(ends[-1]) if len(ends) else 0, TOKENS))
    for s in np.split(np.arange(len(i)), np.unique(cuts)):
        code = np.concatenate([np.repeat(np.arange(len(s)), of[s]) << 40 | gathered(token, start[x[s]], of[s]) for x, of in ((i, of_i), (j, of_j))])
        code.sort()
        out[s] = np.bincount(code[1:][code[1:] == code[:-1]] >> 40, minlength=len(s))
    return out


def line_sets(token: np.ndarray, line: np.ndarray, rare: np.ndarray) -> tuple[np.ndarray, ...]:
    """Lines with tokens, tokens of all lines rarest first, start and number of each line's, and two hashes of its set."""
    token, line = ordered(token, line, rare)
    start = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1]))) if len(line) else np.zeros(0, np.int64)
    n = np.diff(np.append(start, len(line)))
    keys = [np.add.reduceat(mix(token + np.uint64(salt)), start).view(np.int64) if len(start) else np.zeros(0, np.int64) for salt in (1, 0xA5A5A5A5)]
    return line[start], token, start, n, keys[0], keys[1]


def sketches(token: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Four numbers for each set: for each of 64, 128 or 256 kinds of token, by size, whether it has an odd number of them.

    A token that two sets do not share flips one bit, so sets differ by as many tokens as their sketches by bits. The
    exclusive or of the numbers, and of their halves, are the sketches of fewer kinds.
    """
    out = np.zeros((len(start), 4), np.uint64)
    if not len(start):
        return out
    bit, word = np.uint64(1) << (token >> np.uint64(56) & np.uint64(63)), (token >> np.uint64(62)).astype(np.int64)
    out[:, 0] = np.bitwise_xor.reduceat(bit, start)
    wide = np.flatnonzero(n >= TWO)
    if len(wide):
        at = np.cumsum(n[wide]) - n[wide]
        bit, word = gathered(bit, start[wide], n[wide]), gathered(word, start[wide], n[wide])
        words = np.stack([np.bitwise_xor.reduceat(np.where(word == w, bit, np.uint64(0)), at) for w in range(4)], axis=1)
        two = n[wide] < FOUR
        words[two] = np.stack([words[two, 0] ^ words[two, 2], words[two, 1] ^ words[two, 3], np.zeros(two.sum(), np.uint64), np.zeros(two.sum(), np.uint64)], axis=1)
        out[wide] = words
    return out


def near_sketches(s: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether the sketches of sets i and j differ by no more than `most` bits, at the width that both have."""
    x = s[i] ^ s[j]
    least = np.minimum(n[i], n[j])
    # Where one set has fewer numbers, those of the other are folded by the exclusive or of all of them.
    near = np.bitwise_count(x[:, 0] ^ x[:, 1] ^ x[:, 2] ^ x[:, 3]) <= most
    near[near] &= (least[near] < TWO) | (np.bitwise_count(x[near, 0] ^ x[near, 2]) + np.bitwise_count(x[near, 1] ^ x[near, 3]) <= most[near])
    near[near] &= (least[near] < FOUR) | (np.bitwise_count(x[near]).sum(axis=1) <= most[near])
    return near


def packed(token: np.ndarray, start: np.ndarray, size: np.ndarray, of: np.ndarray, rows: int) -> pa.Array:
    """A binary array of `rows` values: for row of[k] the first size[k] tokens from start[k], 8 bytes each; others null."""
    long = np.zeros(rows + 1, np.int64)
    long[of + 1] = 8 * size
    there = np.zeros(rows, bool)
    there[of] = True
    data = gathered(token, start, size).astype("<u8").tobytes()
    return pa.Array.from_buffers(pa.binary(), rows, [pa.py_buffer(np.packbits(there, bitorder="little")), pa.py_buffer(np.cumsum(long).astype(np.int32)), pa.py_buffer(data)])


def unpacked(tokens: pa.Array) -> np.ndarray:
    """The tokens of a binary array as numbers, one value after the other."""
    return np.frombuffer(b"".join(tokens.to_pylist()), "<u8")


def lines(docs: DataFrame, table: np.ndarray, id_col: str = "doc_id", text_col: str = "text", near: float = NEAR, words: bool = True) -> DataFrame:
    """A row for each line that has tokens, and one (no = -1, n its lines) for each row of docs.

    k1, k2: hashes of the token set, its class. n: tokens of the set. heads, s0 to s3: the rarest tokens of the set, as many
    as its prefix has, and its sketch, for the first line of a class that a task meets. Sets too small to have a similar
    one but themselves have none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(np.log2(1 + np.minimum(table, 2**31 - 1)).astype(np.uint8))
    least = int(np.ceil(near / (1 - near) - 1e-9)) if near < 1 else 1 << 31

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            texts, ids = batch.column(1).to_pylist(), batch.column(0)
            many = np.zeros(len(texts), np.int32)
            for part in slices(texts):
                token, line, row, no = line_tokens(texts[part], words)
                # Rarest first: by the power of two of the count, then by hash; a fixed order for all lines.
                rare = shared.value[(token & np.uint64(BUCKETS - 1)).astype(np.int64)].astype(np.uint64)
                own, token, start, n, k1, k2 = line_sets(token, line, rare)
                many[part] = np.bincount(row[own], minlength=part.stop - part.start)
                rep = np.sort(np.unique(k1, return_index=True)[1])
                rep = rep[n[rep] >= least]
                rep = rep[np.fromiter((k not in seen for k in k1[rep].tolist()), bool, len(rep))]
                seen.update(k1[rep].tolist())
                if len(seen) > SEEN:
                    seen.clear()
                there = np.ones(len(own), bool)
                there[rep] = False
                kinds = np.zeros((len(own), 4), np.uint64)
                at = np.cumsum(n[rep]) - n[rep]
                kinds[rep] = sketches(gathered(token, start[rep], n[rep]), at, n[rep])
                heads = packed(token, start[rep], prefix_length(n[rep], near), rep, len(own))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row[own] + part.start)), pa.array(no[own].astype(np.int32)), pa.array(k1), pa.array(k2), pa.array(n.astype(np.int32)), heads, *(pa.array(kinds[:, i].view(np.int64), mask=there) for i in range(4))], NAMES)
            none = pa.nulls(len(texts), pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(texts), -1, np.int32)), none, none, pa.array(many), pa.nulls(len(texts), pa.binary()), none, none, none, none], NAMES)

    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return own.mapInArrow(cut, f"id {own.schema['id'].dataType.simpleString()}, no int, k1 long, k2 long, n int, heads binary, {SKETCH}")


NAMES = ["id", "no", "k1", "k2", "n", "heads", "s0", "s1", "s2", "s3"]


def place(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.astype(np.uint64)) & np.uint64(FILTER - 1)).astype(np.int64)


def seen_cells(rows: DataFrame, keys: Callable[[pa.RecordBatch], np.ndarray], times: int = 1) -> np.ndarray:
    """Packed bits of a table of fixed size: the cells that hold the keys of rows at least `times` (1 or 2) times.

    What is not set is no such key, whatever meets in a cell.
    """

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(FILTER, np.uint8)
        for batch in batches:
            cell, n = np.unique(place(keys(batch)), return_counts=True)
            table[cell] = np.minimum(table[cell] + n, 2)
        once, twice = (np.packbits(table >= k).reshape(SLABS, -1) for k in (1, 2))
        some = np.flatnonzero(once.any(axis=1))
        yield pa.RecordBatch.from_pydict({"slab": pa.array(some.astype(np.int32)), "once": pa.array([once[i].tobytes() for i in some], pa.binary()), "twice": pa.array([twice[i].tobytes() for i in some], pa.binary())})

    def unite(pdf: pd.DataFrame) -> pd.DataFrame:
        once = twice = np.zeros(FILTER // 8 // SLABS, np.uint8)
        for a, b in zip(pdf["once"], pdf["twice"]):
            a = np.frombuffer(a, np.uint8)
            once, twice = once | a, twice | np.frombuffer(b, np.uint8) | once & a
        return pd.DataFrame({"slab": pdf["slab"][:1], "b": [(once if times == 1 else twice).tobytes()]})

    out = np.zeros((SLABS, FILTER // 8 // SLABS), np.uint8)
    for r in rows.mapInArrow(bits, "slab int, once binary, twice binary").groupBy("slab").applyInPandas(unite, "slab int, b binary").collect():  # FILTER bits in all
        out[r.slab] = np.frombuffer(r.b, np.uint8)
    return out.ravel()


def is_set(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = place(keys)
    return (table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def numbers(column: pa.Array) -> np.ndarray:
    """A column of integers without nulls."""
    return column.to_numpy(zero_copy_only=False)


def joining(found: DataFrame, near: float = NEAR) -> DataFrame:
    """Prefix tokens (token, k1, n, at) of classes that meet another class there which the filters on length, position and
    sketch let through: one row a class and token, however many classes meet.

    A second look leaves out the rows whose partners there share the token before this one too: those have met there.
    Tokens that no two sets have in their prefixes are left out before the shuffle, as far as a table of fixed size tells.
    """
    own = found.where("heads is not null").select("k1", "n", "heads", "s0", "s1", "s2", "s3")
    shared = found.sparkSession.sparkContext.broadcast(seen_cells(own.select("heads"), lambda batch: unpacked(batch.column(0)), 2))
    kind = f"token long, k1 long, size long, {SKETCH}"

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = numbers(batch.column(1)).astype(np.int64)
            token, size = unpacked(batch.column(2)), prefix_length(n, near)
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            met = is_set(shared.value, token)
            of = np.repeat(np.arange(len(n)), size)[met]
            yield pa.RecordBatch.from_arrays([pa.array(token[met].view(np.int64)), pa.array(numbers(batch.column(0))[of]), pa.array(n[of] << 32 | at[met]), *(pa.array(numbers(batch.column(i))[of]) for i in range(3, 7))], ["token", "k1", "size", "s0", "s1", "s2", "s3"])

    def meet(out: str, prior: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        names = [c.split()[0] for c in out.split(", ")]

        def rows(a: dict[str, np.ndarray], keep) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a[c][keep]) for c in names], names)

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, hot = None, None
            for batch in batches:
                whole = {c: numbers(batch.column(i)) for i, c in enumerate(batch.schema.names)}
                if held is not None:
                    whole = {c: np.concatenate([held[c], whole[c]]) for c in whole}
                if hot is not None:  # the rest of a token that was too frequent to hold
                    same = whole["token"] == hot
                    yield rows(whole, same)
                    whole = {c: v[~same] for c, v in whole.items()}
                held = None
                if not len(whole["token"]):
                    continue
                last = int(np.searchsorted(whole["token"], whole["token"][-1], "left"))
                yield rows(first := {c: v[:last] for c, v in whole.items()}, partnered(first, near, prior))
                held = {c: v[last:] for c, v in whole.items()}
                if len(held["token"]) > HELD:
                    yield rows(held, slice(None))
                    held, hot = None, whole["token"][-1]
            if held is not None:
                yield rows(held, partnered(held, near, prior))

        return look

    dealt = own.mapInArrow(head, kind).repartition("token").sortWithinPartitions("token")
    # A class may come from several tasks, with the same tokens and sketch.
    some = dealt.mapInArrow(meet(kind, None), kind).groupBy("token", "k1").agg(F.any_value("size").alias("size"), *[F.any_value(f"s{i}").alias(f"s{i}") for i in range(4)])
    with arrow_rows(found.sparkSession, MEETING):
        some = durable(some)
    at = F.col("size").bitwiseAND(F.lit(0xFFFFFFFF))
    before = Window.partitionBy("k1").orderBy("at")
    follows = F.lag("at").over(before) == F.col("at") - 1
    some = some.withColumn("at", at).select(*[c for c in some.columns], F.coalesce(F.when(follows, F.lag("token").over(before)), F.lit(0)).alias("prior"), F.coalesce(follows, F.lit(False)).cast("long").alias("follows"))
    again = some.repartition("token").sortWithinPartitions("token").mapInArrow(meet("token long, k1 long, size long", "prior"), "token long, k1 long, size long")
    return again.select("token", "k1", F.shiftright("size", 32).cast("int").alias("n"), at.cast("int").alias("at"))


def fits(n: np.ndarray, at: np.ndarray, i: np.ndarray, j: np.ndarray, near: float) -> np.ndarray:
    """Whether what sets i and j hold from this token on can be overlap enough."""
    return np.minimum(n[i] - at[i], n[j] - at[j]) >= least_overlap(n[i], n[j], near)


def partnered(a: dict[str, np.ndarray], near: float = NEAR, prior: str | None = None) -> np.ndarray:
    """Rows that another class meets at the same token, not having met it at `prior` (if follows is 1). Rows that are
    undecided after LOOK neighbours count as met."""
    n, at = a["size"] >> 32, a["size"] & 0xFFFFFFFF
    order = np.lexsort((n, a["token"]))
    n, at, token, key = n[order], at[order], a["token"][order], a["k1"][order]
    sketch = np.stack([a[f"s{i}"][order].view(np.uint64) for i in range(4)], axis=1)
    met = np.zeros(len(order), bool)
    if prior:
        before, follows = a[prior][order], a["follows"][order] > 0
    # Rows are by token, then size: each looks at those after and before it until sizes are too far apart.
    open_ = {1: np.arange(len(order)), -1: np.arange(len(order))}
    for d in range(1, LOOK + 1):
        for way in open_:
            i = open_[way]
            i = i[~met[i] & (i + way * d >= 0) & (i + way * d < len(order))]
            j = i + way * d
            live = (token[i] == token[j]) & (np.minimum(n[i], n[j]) >= near * np.maximum(n[i], n[j]) - 1e-9)
            open_[way] = i = i[live]
            j = j[live]
            good = fits(n, at, i, j, near) & (key[i] != key[j])
            if prior:
                good &= (before[i] != before[j]) | ~(follows[i] & follows[j])
            i, j = i[good], j[good]
            good = near_sketches(sketch, n, i, j, n[i] + n[j] - 2 * least_overlap(n[i], n[j], near))
            met[i[good]] = met[j[good]] = True
        if not len(open_[1]) and not len(open_[-1]):
            break
    for i in open_.values():
        met[i] = True
    out = np.zeros(len(order), bool)
    out[order] = met
    return out


def token_sets(docs: DataFrame, table: np.ndarray, needed: DataFrame, found: DataFrame, id_col: str, text_col: str, near: float, words: bool) -> DataFrame:
    """Columns k1, k2, tokens (rarest first, 8 bytes each) for the classes of `needed` (column need).

    Only documents that hold the first line of such a class are taken apart again; filters of fixed size tell them.
    """
    spark = docs.sparkSession
    reps = found.where("no >= 0").join(needed, F.col("k1") == F.col("need")).groupBy("k1").agg(F.min("id").alias("id")).select(F.xxhash64("id").alias("h"))
    holders = spark.sparkContext.broadcast(seen_cells(reps, lambda batch: numbers(batch.column(0))))
    classes = spark.sparkContext.broadcast(seen_cells(needed.select("need"), lambda batch: numbers(batch.column(0))))
    shared = spark.sparkContext.broadcast(np.log2(1 + np.minimum(table, 2**31 - 1)).astype(np.uint8))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            here = is_set(holders.value, numbers(batch.column(0)))
            texts = batch.column(1).filter(pa.array(here)).to_pylist()
            for part in slices(texts):
                token, line, _, _ = line_tokens(texts[part], words)
                rare = shared.value[(token & np.uint64(BUCKETS - 1)).astype(np.int64)].astype(np.uint64)
                _, token, start, n, k1, k2 = line_sets(token, line, rare)
                rep = np.unique(k1, return_index=True)[1]
                rep = rep[is_set(classes.value, k1[rep])]
                rep = rep[np.fromiter((k not in seen for k in k1[rep].tolist()), bool, len(rep))]
                seen.update(k1[rep].tolist())
                if len(seen) > SEEN:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(k1[rep]), pa.array(k2[rep]), packed(token, start[rep], n[rep], np.arange(len(rep)), len(rep))], ["k1", "k2", "tokens"])

    some = docs.select(F.xxhash64(F.col(f"`{id_col}`")).alias("h"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(again, "k1 long, k2 long, tokens binary")
    return some.join(needed, F.col("k1") == F.col("need"), "left_semi").groupBy("k1", "k2").agg(F.any_value("tokens").alias("tokens"))


def links(docs: DataFrame, table: np.ndarray, found: DataFrame, classes: DataFrame, id_col: str, text_col: str, near: float = NEAR, words: bool = True) -> DataFrame:
    """For each class (k1, k2) with links: `links`, the number of different token sets with Jaccard >= near, and `other`,
    the earliest first line of these.

    Classes meet at a prefix token in blocks of about BLOCK; a pair counts at its rarest common token alone, and a block
    adds up its links, so that pairs are never rows.
    """
    met = durable(joining(found, near))
    needed = durable(met.select(F.col("k1").alias("need")).distinct())
    sets = token_sets(docs, table, needed, found, id_col, text_col, near, words)
    firsts = classes.select(F.col("k1").alias("f1"), F.col("k2").alias("f2"), F.col("first.id").isNotNull().cast("int").alias("known"), F.col("first.id").alias("id"), F.col("first.no").alias("no"))
    sets = durable(sets.join(firsts, (F.col("k1") == F.col("f1")) & (F.col("k2") == F.col("f2"))).select(F.col("k1").alias("s1"), "k2", "tokens", "known", "id", "no"))

    many = met.groupBy(F.col("token").alias("t")).count().where(F.col("count") > BLOCK)
    dealt = met.join(many, F.col("token") == F.col("t"), "left").withColumn("blocks", F.coalesce(F.ceil(F.col("count") / BLOCK), F.lit(1)).cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("k1"), F.col("blocks")).cast("int")).withColumn("facing", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("token", F.least("block", "facing").alias("p"), F.greatest("block", "facing").alias("q"), "block", "k1", "n", "at")
    rows = dealt.join(sets, F.col("k1") == F.col("s1")).drop("s1")
    rows = rows.repartition("token", "p", "q").sortWithinPartitions("token", "p", "q")
    id_type = sets.schema["id"].dataType.simpleString()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            whole = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if not len(whole):
                continue
            group = np.stack([numbers(whole[c].combine_chunks()) for c in ("token", "p", "q")], axis=1)
            last = int(np.flatnonzero((group != group[-1]).any(axis=1)).max(initial=-1)) + 1
            if last:
                yield from counted(whole[:last].combine_chunks(), near).to_batches()
            held = whole[last:]
        if held is not None:
            yield from counted(held.combine_chunks(), near).to_batches()

    parts = rows.mapInArrow(verify, f"k1 long, k2 long, links long, known int, id {id_type}, no int")
    least = parts.groupBy("k1", "k2").agg(F.sum("links").alias("links"), F.min(F.struct("known", "id", "no")).alias("least"))
    out = durable(least.select("k1", "k2", "links", F.struct(F.col("least.id").alias("id"), F.col("least.no").alias("no")).alias("other")))
    release(met, needed, sets)
    return out


def counted(rows: pa.Table, near: float = NEAR) -> pa.Table:
    """Links of the classes that meet in each (token, p, q), added up by class, and the earliest partner of each."""
    names = ["k1", "k2", "links", "known", "id", "no"]
    group = np.stack([numbers(rows[c].combine_chunks()) for c in ("token", "p", "q")], axis=1) if len(rows) else np.zeros((0, 3), np.int64)
    group = np.cumsum(np.concatenate(([0], (group[1:] != group[:-1]).any(axis=1))))[: len(rows)]
    order = np.lexsort((numbers(rows["n"].combine_chunks()), group))
    rows, group = rows.take(pa.array(order)).combine_chunks(), group[order]
    n, at, block, key = (numbers(rows[c].combine_chunks()).astype(np.int64) for c in ("n", "at", "block", "k1"))
    inner = numbers(rows["p"].combine_chunks()) == numbers(rows["q"].combine_chunks())
    # Ids are ordered as Spark orders their type; nulls are first.
    first = pa.table({"known": rows["known"], "id": rows["id"], "no": rows["no"]})
    rank = np.empty(len(rows), np.int64)
    rank[pc.sort_indices(first, sort_keys=[(c, "ascending") for c in ("known", "id", "no")]).to_numpy()] = np.arange(len(rows))
    token, start = unpacked(rows["tokens"].combine_chunks()), np.cumsum(n) - n
    sketch = sketches(token, start, n)
    token = np.unique(token, return_inverse=True)[1].astype(np.int64)  # small numbers, the same for the same token
    total, best = np.zeros(len(rows), np.int64), np.full(len(rows), len(rows))

    def settle(i: np.ndarray, j: np.ndarray) -> None:
        new = common(token, start, i, j, at[i], at[j]) == 0  # no rarer token in common: this is where the pair counts
        i, j = i[new], j[new]
        same = common(token, start, i, j, n[i], n[j])
        linked = same >= near * (n[i] + n[j] - same) - 1e-9
        i, j = i[linked], j[linked]
        for x, y in ((i, j), (j, i)):
            total[:] += np.bincount(x, minlength=len(total))
            np.minimum.at(best, x, rank[y])

    waiting, size = [], 0
    i, d = np.arange(len(rows)), 1
    # Rows are by group, then size: each is compared with those after it until sizes are too far apart.
    while len(i := i[i + d < len(rows)]):
        j = i + d
        live = (group[i] == group[j]) & (n[i] >= near * n[j] - 1e-9)
        i, j = i[live], j[live]
        pair = fits(n, at, i, j, near) & (inner[i] | (block[i] != block[j])) & (key[i] != key[j])
        a, b = i[pair], j[pair]
        pair = near_sketches(sketch, n, a, b, n[a] + n[b] - 2 * least_overlap(n[a], n[b], near))
        waiting.append((a[pair], b[pair]))
        size += int(pair.sum())
        if size > PAIRS:
            settle(*map(np.concatenate, zip(*waiting)))
            waiting, size = [], 0
        d += 1
    if waiting:
        settle(*map(np.concatenate, zip(*waiting)))
    some = np.flatnonzero(total)
    who = pa.array(np.argsort(rank)[best[some]] if len(some) else some)
    return pa.Table.from_arrays([pa.array(key[some]), rows["k2"].take(pa.array(some)), pa.array(total[some]), *(rows[c].take(who) for c in ("known", "id", "no"))], names)


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: float = NEAR, words: bool = True) -> DataFrame:
    """Columns id, n_lines (with a word), removed (numbers of lines, from 0), n_links, one row for each id.

    A line is removed if an earlier one (by id, then number) has the same token set or one of Jaccard similarity
    `near` or more. A line's tokens are its different words if `words`, else its adjacent word pairs. n_links adds up, over
    the document's lines, the different token sets linked to each. Null texts and texts without words have no lines. Rows
    of one id are taken together; lines of the same id and number are equally early. A null id comes first; ids keep
    their type.
    """
    table = rarity(docs, text_col, words)
    found = durable(lines(docs, table, id_col, text_col, near, words))
    classes = durable(found.where("no >= 0").groupBy("k1", "k2").agg(F.min(F.struct("id", "no")).alias("first"), F.count("*").alias("times")))
    near_ = links(docs, table, found, classes, id_col, text_col, near, words)
    told = classes.join(near_, ["k1", "k2"], "left").where("times > 1 or links is not null")
    told = durable(told.select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), F.least("first", F.coalesce("other", "first")).alias("first"), F.coalesce("links", F.lit(0)).alias("links")))
    again = docs.sparkSession.sparkContext.broadcast(seen_cells(told.select("c1"), lambda batch: numbers(batch.column(0))))

    def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(is_set(again.value, numbers(batch.column(2)))))

    some = found.where("no >= 0").select("id", "no", "k1", "k2")
    some = some.mapInArrow(maybe, some.schema).join(told, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")))
    late = F.struct("id", "no") > F.col("first")
    cut = some.groupBy(F.col("id").alias("_id")).agg(F.array_sort(F.collect_list(F.when(late, F.col("no")))).alias("removed"), F.sum("links").alias("n_links"))
    whole = found.where("no < 0").groupBy("id").agg(F.sum("n").alias("n_lines"))
    met = whole.join(cut, F.col("id").eqNullSafe(F.col("_id")), "left")
    return met.select("id", "n_lines", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: float = NEAR, words: bool = True) -> DataFrame:
    """docs with the repeated lines cut out of their texts; all columns, whatever their names, and all rows stay."""
    of, cut = fresh(docs, "_of"), fresh(docs, "_cut")
    found = repeated_lines(docs, id_col, text_col, near, words).select(F.col("id").alias(of), F.col("removed").alias(cut))
    text = F.col(f"`{text_col}`")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(cut, i)), "\n")
    met = docs.join(found, F.col(f"`{id_col}`").eqNullSafe(F.col(of)), "left")
    return met.select(*[F.when(F.size(cut) > 0, kept).otherwise(text).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
