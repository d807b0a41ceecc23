"""Document fingerprints: threshold-scaled sketches of word shingles, by DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

#: Fraction of the hashes that a sketch keeps: all, so that comparisons of short texts are exact too.
SCALE = 1
#: What documents keep if the caller does not say; one in eight, too few for texts of some ten words.
SPARSE = 8
WIDTH = 5
#: Bytes of text in a range of ids, about.
PART_BYTES = 64 << 20


def let(value: Column, use) -> Column:
    """use(value), with value worked out once however often use refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """64-bit hashes of a text's shingles of `width` lower-case words; fewer words are one shingle, none give none."""
    parts = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def over(coded: Column) -> Column:
        last = F.greatest(F.size(coded) - width, F.lit(0))
        hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(coded, i + j) for j in range(width)]))
        return F.when(F.size(coded) > 0, hashes).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(parts, lambda w: F.xxhash64(w)), over)


def sketch(text: Column, scale: int = SCALE, width: int = WIDTH) -> Column:
    """Sorted distinct shingle hashes below the fixed fraction 1/scale of their range, and always the least one.

    So a text with any word has a sketch that is not empty; null and empty texts have an empty one.
    """
    return keep_low(shingle_hashes(text, width), scale)


def highest(scale: int) -> int:
    """The highest hash that is kept for being low."""
    return -(1 << 63) + (1 << 64) // scale - 1


def keep_low(hashes: Column, scale: int = SCALE) -> Column:
    """The hashes that a sketch retains of any collection of hashes."""
    limit = highest(scale)

    def least(all_: Column) -> Column:
        low = F.filter(all_, lambda h: h <= limit)
        return F.array_sort(F.array_distinct(let(low, lambda some: F.when((F.size(some) > 0) | (F.size(all_) == 0), some).otherwise(F.array(F.array_min(all_))))))

    return let(hashes, least)


def merge(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of the union of two shingle sets, from their sketches."""
    return keep_low(F.array_union(a, b), scale)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity, exact at scale 1 and estimated above it; 1 for two empty sketches."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def containment(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Share of a's shingles that b has, however unequal they are; 1 if a has none. Exact at scale 1.

    Above it, it is estimated from the hashes that are kept for being low. If a has only its least one, b may have it
    without keeping it: the share is null then, unless b has it.
    """
    low = F.filter(a, lambda h: h <= highest(scale))
    share = F.size(F.array_intersect(low, b)).cast("double") / F.size(low)
    return F.when(F.size(a) == 0, F.lit(1.0)).when(F.size(low) > 0, share).when(F.arrays_overlap(a, b) & (F.size(a) > 0), F.lit(1.0))


def as_text(sketch_: Column) -> Column:
    """A sketch as a string: its hashes in hexadecimal."""
    return F.array_join(F.transform(sketch_, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scale: int = SPARSE, width: int = WIDTH, parts: int | None = None) -> DataFrame:
    """Columns id, text, own (its sketch), next, own_next: text and sketch of the next document by descending id.

    After the last document comes the first.
    Null texts are empty. Rows are dealt by ranges of ids, cut at approximate quantiles; within a range the next row
    is looked up by a window, and between ranges the first row of the next range is joined. There are as many ranges as
    the texts' size asks for. Ids are integers (others fail). Equal ids go by text; null ids come last; the rows of one
    id, or without one, are one range.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    if parts is None:
        size = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES)
    cuts = own.select("id").where("id is not null").approxQuantile("id", [i / parts for i in range(1, parts)], 0.2 / parts)
    bounds = sorted({int(c) for c in cuts})  # fewer than `parts` numbers

    def position(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("id") < bounds[mid], position(lo, mid)).otherwise(position(mid + 1, hi))

    part = F.when(F.col("id").isNull(), F.lit(len(bounds) + 1)).otherwise(len(bounds) - position(0, len(bounds)))
    placed = own.withColumn("part", part)
    order = Window.partitionBy("part").orderBy(F.col("id").desc_nulls_last(), "text")
    first = placed.groupBy("part").agg(F.max(F.col("id")).alias("id"))
    tops = placed.join(F.broadcast(first.select(F.col("part").alias("_p"), F.col("id").alias("_i"))), (F.col("part") == F.col("_p")) & F.col("id").eqNullSafe(F.col("_i"))).groupBy("part").agg(F.min("text").alias("top"))
    tops = durable(tops)
    heads = Window.orderBy("part")
    ring = tops.withColumn("_after", F.lead("top").over(heads)).withColumn("_first", F.first("top").over(heads))
    follow = ring.select(F.col("part").alias("_part"), F.coalesce("_after", "_first").alias("_text")).withColumn("_own", sketch(F.col("_text"), scale, width))
    inside = placed.repartitionByRange(parts, "part").withColumn("own", sketch(F.col("text"), scale, width))
    inside = inside.withColumn("_next", F.lead(F.struct("text", "own")).over(order))
    met = inside.join(follow, F.col("part") == F.col("_part"), "left")
    return met.select("id", "text", "own", F.coalesce("_next.text", "_text").alias("next"), F.coalesce("_next.own", "_own").alias("own_next"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scale: int = SPARSE, width: int = WIDTH) -> DataFrame:
    """Columns id, n_chars, edited, fingerprint, edited_fingerprint (sketches as strings), near_edited, near_next.

    At scale 1 near_edited and near_next are exact; above it they are estimates, which short texts make coarse.
    The edited text has its last third of code points replaced by the first as many (or all) of the next text.
    """
    pairs = with_next(docs, id_col, text_col, scale, width)
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next"), F.lit(1), third))
    rows = pairs.select("id", n.cast("long").alias("n_chars"), edited.alias("edited"), "own", "own_next")
    rows = rows.withColumn("own_edited", sketch(F.col("edited"), scale, width))
    return rows.select("id", "n_chars", "edited", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("own_edited")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("own_edited")).alias("near_edited"), likeness(F.col("own"), F.col("own_next")).alias("near_next"))
