"""Near-duplicate documents by SimHash, found by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, components, durable, fresh, spread_join

#: Longer runs of equal masked bits are split by further masks before their members are compared.
RUN_LIMIT = 4096


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of a text's word shingles; a text without words (null, empty) has 0.

    A-Z count as a-z; words are runs of other than ASCII white space; fewer words than `width` are one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: n - 1].tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[s:e], seed) for s, e in zip(starts, (ends[min(width, len(words)) - 1 :] - 1).tolist())), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 65_536):
        ones += np.unpackbits(hashes[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """Columns id (of its own type), tag (a hash of the text) and fp (the fingerprint as a signed long), for every row of docs."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column(2)), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp.view(np.int64))], ["id", "tag", "fp"])

    text = F.col(f"`{text_col}`").cast("string")
    part = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("tag"), text.alias("text"))
    return part.mapInArrow(sign, f"id {part.schema['id'].dataType.simpleString()}, tag long, fp long")


def covering_masks(radius: int, bits: int = 64, seed: int = 7) -> list[int]:
    """2**(radius+1) - 1 masks; two words that differ in at most `radius` bits agree under one of them.

    Each bit position has a vector of radius+1 binary digits. Mask v keeps the positions whose vector has an odd
    product with v. At most `radius` differing positions span less than the whole space, so some v is orthogonal to
    all of them and its mask keeps none of them. The vectors are dealt evenly, so each mask keeps about half the bits.
    """
    rng = np.random.default_rng(seed)
    size = 1 << (radius + 1)
    vectors = rng.permutation(np.resize(np.arange(size), bits))
    return [sum(1 << i for i, a in enumerate(vectors.tolist()) if (a & v).bit_count() % 2) for v in range(1, size)]


def spanning_links(values: np.ndarray, radius: int, masks: list[int] | None = None) -> list[np.ndarray]:
    """Links (rows a, b) that join what links of at most `radius` bits join among distinct `values`: a forest, not all pairs.

    A long run is first split by the covering masks, each part being joined on its own.
    """
    out = []
    if masks and len(values) > RUN_LIMIT:
        for m in masks:
            key = values & np.uint64(m)
            order = np.argsort(key, kind="stable")
            for part in np.split(values[order], np.flatnonzero(np.diff(key[order])) + 1):
                if 1 < len(part) < len(values):
                    out += spanning_links(part, radius, masks)
                elif len(part) == len(values):
                    return spanning_links(values, radius)
        return out
    left = values
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                found, left = left[near], left[~near]
                out.append(np.stack([np.full(len(found), x), found], axis=1))
                todo += list(found)
    return out


def split_groups(rows: DataFrame, masks: list[int], levels: int = 3) -> DataFrame:
    """rows (path, key, fp) with the groups of more than RUN_LIMIT rows split by each of the masks, up to `levels` times.

    Two fingerprints within the radius agree under one of the masks, in a group as well as among all; so they meet in
    a part. Only the numbers of the large groups' rows are counted, as sums.
    """
    table = F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(masks)]))
    done = None
    for _ in range(levels):
        large = durable(rows.groupBy(F.col("path").alias("_path"), F.col("key").alias("_key")).count().where(F.col("count") > RUN_LIMIT).drop("count"))
        if large.isEmpty():
            break
        on = (F.col("path") == F.col("_path")) & (F.col("key") == F.col("_key"))
        small = rows.join(large, on, "left_anti")
        done = small if done is None else done.unionByName(small)
        cut = rows.join(large, on, "left_semi").select("path", "key", "fp", table.alias("t"))
        rows = durable(cut.select(F.xxhash64("path", "key", "t.mask").alias("path"), F.col("t.bits").alias("key"), "fp"))
    return rows if done is None else done.unionByName(rows)


def links(distinct: DataFrame, radius: int = 4, fp: str = "fp") -> DataFrame:
    """Links a, b between distinct fingerprints: enough of the pairs within `radius` bits to join each component."""
    masks = covering_masks(radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    table = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("path"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)]))
    rows = distinct.select(F.col(fp).alias("fp")).where("fp is not null").select("fp", table.alias("t")).select("t.path", "t.key", "fp")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(group: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
            cuts = np.flatnonzero((np.diff(group, axis=0) != 0).any(axis=1)) + 1
            starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(value)]))
            n = ends - starts
            two = starts[n == 2]
            two = two[np.bitwise_count(value[two] ^ value[two + 1]) <= radius]
            found = [np.stack([value[two], value[two + 1]], axis=1)]
            for s, e in zip(starts[n > 2].tolist(), ends[n > 2].tolist()):
                found += spanning_links(value[s:e], radius, masks)
            out = np.concatenate(found).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(out.min(axis=1, initial=2**63 - 1)), pa.array(out.max(axis=1, initial=-(2**63)))], ["a", "b"])

        held: list[tuple[np.ndarray, np.ndarray]] = []  # parts of the group that is not over yet
        for batch in batches:
            path, key, value = (batch.column(i).to_numpy() for i in range(3))
            if not len(value):
                continue
            group = np.stack([path, key], axis=1)
            value = value.view(np.uint64)
            other = np.flatnonzero((group != group[-1]).any(axis=1))
            last = int(other[-1]) + 1 if len(other) else 0
            if last or held and (held[0][0][0] != group[0]).any():
                held.append((group[:last], value[:last]))
                yield close(*map(np.concatenate, zip(*held)))
                held = []
            held.append((group[last:], value[last:]))
        if held:
            yield close(*map(np.concatenate, zip(*held)))

    dealt = split_groups(rows, signed).repartition("path", "key").sortWithinPartitions("path", "key", "fp")
    return dealt.mapInArrow(join, "a long, b long").distinct()


def _classes(docs: DataFrame, id_col: str, text_col: str, width: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of docs, and for each fingerprint (node): n rows, its least row, its component's label and least row.

    A row goes by (whether its id is null, id, tag), so that null ids come last; the label is a fingerprint.
    """
    fps = durable(fingerprints(docs, id_col, text_col, width))
    row = F.struct(F.col("id").isNull().alias("no_id"), "id", "tag")
    nodes = durable(fps.groupBy(F.col("fp").alias("node")).agg(F.min(row).alias("least"), F.count("*").alias("n")))
    labels = components(links(nodes, radius, "node")).withColumnRenamed("node", "_node")
    nodes = durable(nodes.join(labels, F.col("node") == F.col("_node"), "left").select("node", "n", "least", F.coalesce("label", "node").alias("label")))
    tops = nodes.groupBy(F.col("label").alias("_label")).agg(F.min("least").alias("top"))
    return fps, durable(nodes.join(tops, F.col("label") == F.col("_label")).select("node", "n", "label", "top"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """Columns id, fp, component (the least id that links of at most `radius` bits reach) for every row of docs.

    Equal fingerprints are one node, so copies are never paired. Rows with a null id belong to the component of
    their fingerprint, whose least id is null if it has no other. Ids keep their type. Empty input gives an empty table.
    """
    fps, nodes = _classes(docs, id_col, text_col, width, radius)
    met = spread_join(fps, "fp", nodes, "node", "n", fps.count())
    return met.select("id", "fp", F.col("top.id").alias("component"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """docs with one row of each component: that of the least id, null ids last (of equal ids, of one text). All columns stay.

    Components go by a label of their own, so that repeated and null ids make no two of them one. Of rows that are equal
    in id and text, that of the least columns by text stays.
    """
    fps, nodes = _classes(docs, id_col, text_col, width, radius)
    names = {c: fresh(docs, c) for c in ("_id", "_tag", "_times", "_row")}
    tops = nodes.select("top.id", "top.tag").distinct()  # one for each component: rows of equal text have one fingerprint
    on = F.col("id").eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_tag"))
    times = fps.groupBy(F.col("id").alias("_id"), F.col("tag").alias("_tag")).agg(F.count("*").alias("_times"))
    stay = durable(tops.join(times, on).select(*[F.col(c).alias(names[c]) for c in ("_id", "_tag", "_times")]))
    one, tag = F.col(f"`{id_col}`"), F.xxhash64(F.col(f"`{text_col}`").cast("string"))
    same = one.eqNullSafe(F.col(names["_id"])) & (tag == F.col(names["_tag"]))
    alone = docs.join(stay.where(F.col(names["_times"]) == 1), same, "left_semi")
    # Repeated rows: partial minima meet, so that not even a third of all rows is one task.
    several = docs.join(stay.where(F.col(names["_times"]) > 1), same, "left_semi")
    first = several.groupBy(one.alias(names["_id"]), tag.alias(names["_tag"])).agg(F.min_by(F.struct(*columns(docs)), F.to_json(F.struct(*columns(docs)))).alias(names["_row"]))
    return alone.unionByName(first.select(f"{names['_row']}.*"))
