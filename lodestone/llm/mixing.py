"""Mixing sources to target weights, by DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, fresh, release, running_total

BLOCK = 64
ROUNDS = 12
#: Numbers that one row is made into.
PART = 4096


def words(text: Column) -> Column:
    """Number of runs of other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def shuffled(index: Column, n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """The image of index under a pseudorandom permutation of 0..n-1 that depends on key.

    Each round pairs x with (k - x) mod n and swaps a pair or not by a hash of its larger member, so any n will do.
    """

    def swap(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(key, r), n) - x, n)
        return F.when(F.pmod(F.xxhash64(key, -r - 1, F.greatest(x, other)), F.lit(2)) == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), index, swap)


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), total: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target: words that each source gives to the mix.

    sizes has source and source_size. Sources by code point, null last, take the weights in turn. They share `total`
    times all words by weight; a target stops at `most` times its source's size and the excess is shared by weight
    among the others, until none is above. So target = min(most * size, level * weight), where the level makes the
    targets add up; the sources that stop are those of the least size per weight. Sources of no words have target 0.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    fill = Window.orderBy(F.col("source_size") / F.col("_weight"), F.col("source").asc_nulls_last())
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    level = (total * F.sum("source_size").over(Window.partitionBy()) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("_weight").over(after)
    level = weighed.withColumn("_level", level).withColumn("_stops", most * F.col("source_size") <= F.col("_level") * F.col("_weight"))
    first_open = F.first(F.when(~F.col("_stops"), F.col("_level")), ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    at = F.coalesce(first_open, F.lit(float("inf")))
    return level.select("source", "source_size", F.least(at * F.col("_weight"), most * F.col("source_size")).cast("double").alias("target"))


def in_parts(first: Column, count: Column, name: str, df: DataFrame) -> DataFrame:
    """df with a row for each of the `count` numbers from `first`; ranges are cut and dealt before they are numbered."""
    cut = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((count - 1) / PART)))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("_part", cut).repartition(parts, F.xxhash64(*df.columns, "_part"))
    return dealt.withColumn(name, F.explode(F.sequence(first + F.col("_part") * PART, first + F.least((F.col("_part") + 1) * PART, count) - 1))).drop("_part")


def draws(plan: DataFrame, shards: int, seed: int) -> DataFrame:
    """plan (source, epoch, slots) with a row for each output shard: shard, count, first, place.

    All shards have the same number of slots, the last one what is left. A shard's counts by source are a multinomial draw of
    its slots under the condition that the sources' totals come out: the slots of all sources are dealt in the order of a
    pseudorandom permutation, so each shard draws from what the others leave. `first` numbers the source's slots shard by
    shard, `place` the slots of a shard, of all sources.
    """
    whole, before = Window.partitionBy(), Window.orderBy(F.col("source").asc_nulls_last(), "epoch").rowsBetween(Window.unboundedPreceding, -1)
    own = plan.select("source", "epoch", "slots", F.coalesce(F.sum("slots").over(before), F.lit(0)).alias("offset"), F.sum("slots").over(whole).alias("all"))
    each = in_parts(F.lit(0).cast("long"), F.col("slots"), "k", own)
    turn = shuffled(F.col("offset") + F.col("k"), F.col("all"), F.xxhash64(F.lit(seed), F.lit("shards")))
    drawn = each.groupBy("source", "epoch", F.floor(turn / F.ceil(F.col("all") / shards)).cast("int").alias("shard")).agg(F.count("*").alias("count"))
    sums = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("count").over(sums("source", "epoch").orderBy("shard")), F.lit(0))
    place = F.coalesce(F.sum("count").over(sums("shard").orderBy("source", "epoch")), F.lit(0))
    return durable(drawn.select("source", "epoch", "shard", "count", first.alias("first"), place.alias("place")))


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), total: float = 1.5, most: float = 2.0, block: int = BLOCK, shards: int = 64, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The mix of docs: (rows, pieces).

    rows: id, tag (a hash of id and text), source, size, source_size, target, start (words of the source before the row).
    pieces: words word_from to word_to of the row of source, id, tag and start, which slot `slot` of output shard `shard`
    takes in `epoch`.

    Each source's words, its rows in a fixed order, are packed into blocks of `block` words; the last may be short.
    Each output shard takes as many blocks of a source as it drew (`draws`); its slots go through the epoch's
    permutation of the source's blocks (the short one comes last), and blocks are joined by that index. The very last
    slot takes only the words that are left of the target, which is thereby met exactly once rounded. Epochs are whole
    passes, so no word is taken more than ceil(most) times. Null text has no words; null sources are a source of their
    own; rows that are equal are kept apart.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), words(F.col(text_col)).alias("size"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("tag"))
    own = durable(own)
    sizes = own.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = durable(targets(sizes, weights, total, most))
    placed = durable(running_total(own, ["source"], ["id", "tag", "size"], F.col("size"), "start"))
    release(own)
    goal = F.broadcast(goals.select(F.col("source").alias("_source"), "source_size", "target"))
    rows = placed.join(goal, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")

    cut = F.explode(F.sequence((F.col("start") / block).cast("long"), ((F.col("start") + F.col("size") - 1) / block).cast("long")))
    held = placed.where("size > 0").select("source", "id", "tag", "start", "size", cut.alias("block"))
    plan = goals.withColumn("words", F.round("target").cast("long")).where("words > 0 and source_size > 0")
    plan = plan.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("words") - 1) / F.col("source_size")))))
    plan = plan.withColumn("left", F.least(F.col("words") - F.col("epoch") * F.col("source_size"), F.col("source_size")))
    plan = plan.withColumn("slots", F.ceil(F.col("left") / block)).select("source", "epoch", F.floor(F.col("source_size") / block).alias("full"), "left", "slots")
    told = draws(plan, shards, seed)
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("epoch") == F.col("_epoch"))
    told = told.join(F.broadcast(plan.select(F.col("source").alias("_source"), F.col("epoch").alias("_epoch"), "full", "left")), same).drop("_source", "_epoch")
    slots = in_parts(F.col("first"), F.col("count"), "k", told)
    image = shuffled(F.col("k"), F.greatest(F.col("full"), F.lit(1)), F.xxhash64(F.lit(seed), "source", "epoch"))
    at = F.when(F.col("k") < F.col("full"), image).otherwise(F.col("k"))
    slots = slots.select(F.col("source").alias("_source"), "epoch", "shard", (F.col("place") + F.col("k") - F.col("first")).alias("slot"), at.alias("_block"), F.least(F.lit(block).cast("long"), F.col("left") - F.col("k") * block).alias("take"))
    # Both sides grow with the words, though the plan takes the slots for few; so neither is broadcast.
    met = held.join(slots.hint("merge"), (F.col("block") == F.col("_block")) & F.col("source").eqNullSafe(F.col("_source")))
    low = F.greatest(F.col("start"), F.col("block") * block)
    high = F.least(F.col("start") + F.col("size"), F.col("block") * block + F.col("take"))
    pieces = met.withColumn("_low", low).withColumn("_high", high).where("_high > _low")
    return rows, pieces.select("source", "id", "tag", "start", "epoch", "shard", "slot", (F.col("_low") - F.col("start")).alias("word_from"), (F.col("_high") - F.col("start")).alias("word_to"))


def words_taken(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """rows with `taken`, the words that pieces take of each, repeats counted, and `shard` and `slot`, the first that take some."""
    sums = pieces.groupBy(F.col("source").alias("_s"), F.col("start").alias("_b"), F.col("id").alias("_i")).agg(F.sum(F.col("word_to") - F.col("word_from")).alias("_taken"), F.min(F.struct("shard", "slot")).alias("_at"))
    on = F.col("source").eqNullSafe(F.col("_s")) & (F.col("start") == F.col("_b")) & F.col("id").eqNullSafe(F.col("_i")) & (F.col("size") > 0)
    return rows.join(sums, on, "left").withColumn("taken", F.coalesce("_taken", F.lit(0)).cast("long")).withColumn("shard", F.col("_at.shard")).withColumn("slot", F.col("_at.slot")).drop("_s", "_b", "_i", "_taken", "_at")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str | None = "n_chars", **settings) -> DataFrame:
    """docs as the mix takes them: a row for each document and epoch, with the words taken in their order.

    A text that is taken whole stays as it is; of others the taken runs of words are joined by a space, with the
    number of characters renewed. Documents of which nothing is taken, so also those without words, are left out.
    """
    rows, pieces = mixture(docs, id_col, text_col, source_col, **settings)
    names = {c: fresh(docs, c) for c in ("_i", "_t", "_s", "_copy", "_copies", "_epochs", "_e", "_listed", "_new")}
    size = rows.where("size > 0").select(F.col("id").alias("_i"), F.col("tag").alias("_t"), "size", F.col("start").alias("_b"), F.col("source").alias("_s"))
    taken = pieces.groupBy("source", "id", "tag", "start", "epoch").agg(F.sort_array(F.collect_list(F.struct("word_from", "word_to"))).alias("_runs"), F.sum(F.col("word_to") - F.col("word_from")).alias("_taken"))
    taken = taken.groupBy("source", "id", "tag", "start").agg(F.collect_list(F.struct("epoch", "_runs", "_taken")).alias("_epochs"))
    on = F.col("id").eqNullSafe(F.col("_i")) & (F.col("tag") == F.col("_t")) & (F.col("start") == F.col("_b")) & F.col("source").eqNullSafe(F.col("_s"))
    # Rows of equal id, text and source are interchangeable; they are numbered on both sides, so each is taken as itself.
    copies = rows.where("size > 0").groupBy("source", "id", "tag").agg(F.count("*").alias("_copies"))
    each = Window.partitionBy("source", "id", "tag").orderBy("start")
    listed = size.join(taken, on, "left").select(F.col("_s").alias("source"), F.col("_i").alias("id"), F.col("_t").alias("tag"), F.col("_b").alias("start"), "size", "_epochs").withColumn("_copy", F.row_number().over(each)).where("_epochs is not null")
    listed = listed.join(copies.withColumnsRenamed({"source": "_cs", "id": "_ci", "tag": "_ct"}), F.col("source").eqNullSafe(F.col("_cs")) & F.col("id").eqNullSafe(F.col("_ci")) & (F.col("tag") == F.col("_ct")))
    listed = durable(listed.select(F.col("source").alias(names["_s"]), F.col("id").alias(names["_i"]), F.col("tag").alias(names["_t"]), F.col("_copy").alias(names["_copy"]), F.col("_copies").alias(names["_copies"]), F.transform("_epochs", lambda e: F.struct(e["_runs"].alias("runs"), (e["_taken"] == F.col("size")).alias("whole"))).alias(names["_epochs"])))
    one = {"id": F.col(f"`{id_col}`"), "text": F.col(f"`{text_col}`"), "source": F.col(f"`{source_col}`").cast("string")}
    same = (F.xxhash64(one["id"], one["text"]) == F.col(names["_t"])) & one["id"].eqNullSafe(F.col(names["_i"])) & one["source"].eqNullSafe(F.col(names["_s"]))
    several = listed.where(F.col(names["_copies"]) > 1)
    copy = fresh(listed, fresh(docs, "_copy_of"))
    number = F.row_number().over(Window.partitionBy(one["id"], one["source"], F.xxhash64(one["id"], one["text"])).orderBy(F.lit(0)))
    some = docs.join(several.select(names["_t"], names["_i"], names["_s"]).distinct(), same, "left_semi").withColumn(copy, number)
    out = docs.join(listed.where(F.col(names["_copies"]) == 1), same).unionByName(some.join(several, same & (F.col(copy) == F.col(names["_copy"]))).drop(copy))
    e = names["_e"]
    out = out.withColumn(e, F.explode(names["_epochs"]))
    split = F.regexp_extract_all(one["text"], F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    joined = F.array_join(F.transform(F.col(f"{e}.runs"), lambda r: F.array_join(F.slice(F.col(names["_listed"]), (r["word_from"] + 1).cast("int"), (r["word_to"] - r["word_from"]).cast("int")), " ")), " ")
    out = out.withColumn(names["_listed"], F.when(~F.col(f"{e}.whole"), split)).withColumn(names["_new"], F.when(F.col(f"{e}.whole"), one["text"]).otherwise(joined))
    changed = {text_col: F.col(names["_new"])}
    if chars_col and chars_col in docs.columns:
        changed[chars_col] = F.when(F.col(f"{e}.whole"), F.col(f"`{chars_col}`")).otherwise(F.length(names["_new"]).cast("long"))
    return out.select(*[changed[c].cast(docs.schema[c].dataType).alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns])
