"""Balanced sharding of documents that keeps linked documents together, by label propagation."""

from __future__ import annotations

import itertools
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, running_total

#: Hash cells that moves between two shards of equal gain are dealt into; each is granted or not.
CELLS = 32
#: Rounds of propagation at most; without links between groups it ends by itself.
ROUNDS = 30
#: Groups above this fraction of a shard's room are placed one by one: fewer than LARGE for each shard, about.
LARGE = 64
#: What a shard may hold above its room while rows move, as a fraction of it; it is given back at the end.
SLACK = 64


def capacities(n: int, shards: int) -> list[int]:
    """Rows of each shard: at most one apart, the first shards holding the more."""
    return [n // shards + (s < n % shards) for s in range(shards)]


def ends(sizes: list[int]) -> list[int]:
    return [sum(sizes[: s + 1]) for s in range(len(sizes))]


def within(at, bounds: list[int]):
    """Number of the range, of those that end before each of bounds, that holds at; the last one holds all further."""
    into = F.lit(len(bounds) - 1)
    for s in range(len(bounds) - 2, -1, -1):
        into = F.when(at < bounds[s], F.lit(s)).otherwise(into)
    return into


def pack(groups: list[tuple[str, int]], free: list[int]) -> list[tuple[str, int, int, int]]:
    """Pieces (group, first row, row after the last, shard) that hold all groups; `free` is lowered by them.

    The largest group comes first, each whole in the shard it fills best. Groups that fit nowhere are then split over
    the shards with the most room.
    """
    pieces, rest = [], []
    for group, n in sorted(groups, key=lambda x: (-x[1], x[0])):
        fitting = [s for s in range(len(free)) if free[s] >= n]
        if not fitting:
            rest.append((group, n))
            continue
        s = min(fitting, key=lambda s: free[s])
        free[s] -= n
        pieces.append((group, 0, n, s))
    for group, n in rest:
        at = 0
        while at < n:
            s = max(range(len(free)), key=lambda s: free[s])
            take = min(free[s], n - at)
            pieces.append((group, at, at + take, s))
            free[s] -= take
            at += take
    return pieces


def in_pieces(rows: DataFrame, pieces: list[tuple[str, int, int, int]]) -> DataFrame:
    """The rows of the groups that pieces name, with their shard."""
    spark = rows.sparkSession
    parts = Counter(g for g, _, _, _ in pieces)
    whole = spark.createDataFrame([(g, s) for g, _, _, s in pieces if parts[g] == 1], "_g string, shard int")
    out = rows.join(F.broadcast(whole), F.col("group") == F.col("_g")).drop("_g")
    cut = [p for p in pieces if parts[p[0]] > 1]
    if cut:
        names = spark.createDataFrame([(g,) for g in {p[0] for p in cut}], "_g string")
        some = durable(rows.join(F.broadcast(names), F.col("group") == F.col("_g"), "left_semi"))
        ranges = spark.createDataFrame(cut, "_g string, _from long, _to long, shard int")
        on = (F.col("group") == F.col("_g")) & (F.col("at") >= F.col("_from")) & (F.col("at") < F.col("_to"))
        out = out.unionByName(running_total(some, ["group"], ["id"], F.lit(1), "at").join(F.broadcast(ranges), on).drop("_g", "_from", "_to", "at"))
    return out


def granted(asked: list[tuple[int, int, int, int, int]], load: list[int], room: list[int]) -> list[tuple[int, int, int, int]]:
    """Which of asked (from, to, gain, cell, rows) may move: those of the largest gain first, as long as the shard they go to
    has room; what leaves a shard makes room in it, so that full shards exchange rows. load is changed by the moves."""
    left, out, before = sorted(asked, key=lambda x: (-x[2], x[3], x[0], x[1])), [], -1
    while len(out) > before:
        before = len(out)
        for gain in sorted({x[2] for x in left}, reverse=True):
            mine, moved = [x for x in left if x[2] == gain], True
            while moved:
                moved = False
                for x in list(mine):
                    i, j, _, cell, n = x
                    if load[j] + n <= room[j] + max(1, room[j] // SLACK):
                        load[i] -= n
                        load[j] += n
                        out.append((i, j, gain, cell))
                        mine.remove(x)
                        moved = True
            left = [x for x in left if x[2] != gain] + mine
    return out


def propagate(state: DataFrame, room: list[int], rounds: int | None = None, edges: DataFrame | None = None) -> DataFrame:
    """Labels after propagation. state: group, shard, n rows of the group in the shard; room: rows a shard may hold; edges:
    a, b, weight of linked groups, both ways.

    In each round a group's rows elsewhere ask for the shard in which most of the group is and of the groups linked
    to it, by weight (of equal ones, a fixed choice by group); a group that is whole asks only if that holds more than its
    own shard. The moves asked for are summed by shards, gain and a hash cell, which is a table of fixed size, and
    granted under the shards' quotas by `granted`. It ends when no move is granted, or after `rounds`, ROUNDS if None.
    """
    spark = state.sparkSession
    shards = len(room)
    for _ in range(ROUNDS if rounds is None else rounds):
        votes = state
        if edges is not None:
            near = edges.join(state, F.col("b") == F.col("group")).groupBy("a", "shard").agg(F.sum(F.col("weight") * F.col("n")).alias("n"))
            votes = state.unionByName(near.withColumnRenamed("a", "group")).groupBy("group", "shard").agg(F.sum("n").alias("n"))
        best = votes.groupBy(F.col("group").alias("_g")).agg(F.max(F.struct(F.col("n").alias("most"), F.pmod(F.xxhash64("group", "shard"), F.lit(1 << 20)).alias("_tie"), F.col("shard").alias("to"))).alias("b"))
        own = state.groupBy(F.col("group").alias("_p")).agg(F.count("*").alias("parts"))
        had = votes.select(F.col("group").alias("_v"), F.col("shard").alias("_s"), F.col("n").alias("now"))
        ask = state.join(best, F.col("group") == F.col("_g")).where("shard != b.to").join(own, F.col("group") == F.col("_p"))
        ask = ask.join(had, (F.col("group") == F.col("_v")) & (F.col("shard") == F.col("_s"))).where("parts > 1 or b.most > now")
        gain = F.least(F.floor(F.log2(F.greatest(F.col("b.most") - F.col("now"), F.lit(1)).cast("double"))), F.lit(40)).cast("int")
        ask = durable(ask.select("group", "shard", F.col("b.to").alias("to"), "n", gain.alias("gain"), F.pmod(F.xxhash64("group"), F.lit(CELLS)).cast("int").alias("cell")))
        sums = [(r["shard"], r["to"], r["gain"], r["cell"], r["n"]) for r in ask.groupBy("shard", "to", "gain", "cell").agg(F.sum("n").alias("n")).collect()]
        load = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # one row a shard
        moves = granted(sums, [load.get(s, 0) for s in range(shards)], room)
        if not moves:
            break
        may = F.broadcast(spark.createDataFrame(moves, "_from int, _to int, _gain int, _cell int"))
        goes = ask.join(may, (F.col("shard") == F.col("_from")) & (F.col("to") == F.col("_to")) & (F.col("gain") == F.col("_gain")) & (F.col("cell") == F.col("_cell"))).select(F.col("group").alias("_g"), F.col("shard").alias("_s"), "to")
        after = state.join(goes, (F.col("group") == F.col("_g")) & (F.col("shard") == F.col("_s")), "left")
        state = durable(after.groupBy("group", F.coalesce("to", "shard").alias("shard")).agg(F.sum("n").alias("n")))
    return state


def settled(state: DataFrame, room: list[int]) -> tuple[DataFrame, list[tuple[str, int, int, int]], dict[str, int]]:
    """Columns group, shard for the groups that end whole, the pieces of the few others, and how many rows each step placed.

    Groups that propagation left split, and those above a shard's room, leave their shards and are laid end to end over
    the free rows of all shards, the largest first. Those across the border of two shards (fewer than there are shards)
    are packed into what is left.
    """
    shards = len(room)
    groups = durable(state.groupBy("group").agg(F.count("*").alias("parts"), F.min("shard").alias("shard"), F.sum("n").alias("n")))
    rooms = F.element_at(F.array(*[F.lit(r).cast("long") for r in room]), F.col("shard") + 1)
    one = durable(running_total(groups.where("parts = 1"), ["shard"], ["group"], F.col("n"), "at").withColumn("fits", F.col("at") + F.col("n") <= rooms))
    whole = one.where("fits")
    load = {r["shard"]: r["n"] for r in whole.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # one row a shard
    free = [room[s] - load.get(s, 0) for s in range(shards)]
    split = groups.where("parts > 1").select("group", "n").unionByName(one.where("not fits").select("group", "n")).select("group", "n", F.floor(F.log2(F.col("n").cast("double"))).cast("int").alias("power"))
    sizes = sorted(((r["power"], r["n"]) for r in split.groupBy("power").agg(F.sum("n").alias("n")).collect()), reverse=True)  # one row a power of two
    told = {"propagated": sum(load.values()), "laid": sum(n for _, n in sizes)}
    if not sizes:
        return whole.select("group", "shard"), [], told
    base = F.lit(0)
    for i, (power, _) in enumerate(sizes):
        base = F.when(F.col("power") == power, F.lit(sum(n for _, n in sizes[:i]))).otherwise(base)
    bounds = ends(free)
    laid = running_total(split, ["power"], ["group"], F.col("n"), "at").withColumn("at", F.col("at") + base)
    laid = durable(laid.select("group", "n", within(F.col("at"), bounds).alias("shard"), within(F.col("at") + F.col("n") - 1, bounds).alias("last")))
    fit = laid.where("shard = last")
    for r in fit.groupBy("shard").agg(F.sum("n").alias("n")).collect():  # one row a shard
        free[r["shard"]] -= r["n"]
    across = [(r["group"], r["n"]) for r in laid.where("shard != last").collect()]  # fewer rows than shards
    return whole.select("group", "shard").unionByName(fit.select("group", "shard")), pack(across, free), told


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8, rounds: int | None = None, links: DataFrame | None = None, told: dict[str, int] | None = None) -> DataFrame:
    """Columns id, size, text_crc32, law, shard, slot for every row of docs.

    Documents of equal text are linked, and so are those of the pairs a, b of ids in `links`, if given. Law `rows`: the
    shards' row counts are at most one apart. Groups of equal texts of more than 1/LARGE of a shard are packed first, the largest
    first; one that fits in no shard is split over as few as have room. The rows of the other linked groups are
    dealt over the room that is left, then move by label propagation under each shard's capacity: a group becomes whole, and comes
    to the groups linked to it. The few that end split or above a shard's room are laid whole over the room that
    they and the rows without links leave, so that fewer of them than there are shards end split. Rows without links
    fill the rest. `told` gets the rows that ended whole by propagation (propagated) and those that were laid (laid).

    slot numbers a shard's rows from 0 without gaps. A null text equals other null texts, has no bytes (size 1) and the CRC of nothing, 0.
    Repeated rows are rows of their own; links of an id are those of all its rows. Links to large groups, to ids that are
    not there and to nulls count for nothing.
    """
    text = F.col(f"`{text_col}`").cast("string")
    own = docs.select(F.col(f"`{id_col}`").alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"), F.coalesce(F.md5(text), F.lit("")).alias("group"))
    own = durable(own)
    counts, edges = own.groupBy(F.col("group").alias("_g")).agg(F.count("*").alias("n")), None
    if links is not None:
        of = lambda side: own.select(F.col("id").alias(side), F.col("group").alias(f"_{side}")).distinct()
        pairs = links.select("a", "b").join(of("a"), "a").join(of("b"), "b").where("_a != _b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
        edges = durable(pairs.union(pairs.select("b", "a")).groupBy("a", "b").agg(F.count("*").alias("weight")))
        near = edges.select(F.col("a").alias("_e")).distinct()
        counts = counts.join(near, F.col("_g") == F.col("_e"), "left").where("n > 1 or _e is not null").drop("_e")
    counts = durable(counts if links is not None else counts.where("n > 1"))
    total = own.count()
    room = capacities(total, shards)
    limit = max(1, total // shards // LARGE)
    pieces = pack([(r["_g"], r["n"]) for r in counts.where(F.col("n") > limit).collect()], room)  # about LARGE rows a shard
    small = counts.where(F.col("n") <= limit)
    # The few large groups are told by broadcast, so that no join deals one to a single task.
    large = docs.sparkSession.createDataFrame([(g,) for g in {p[0] for p in pieces}], "_g string")
    others = own.join(F.broadcast(large), F.col("group") == F.col("_g"), "left_anti")
    linked = durable(others.join(small, F.col("group") == F.col("_g"), "left_semi"))
    tied = linked.count()
    placed = in_pieces(own, pieces)
    if tied:
        share = [r * tied // sum(room) for r in room]
        for s in sorted(range(shards), key=lambda s: share[s] - room[s])[: tied - sum(share)]:
            share[s] += 1
        begun = running_total(linked, [], ["group", "id"], F.lit(1), "at").select("group", within(F.col("at"), ends(share)).alias("shard"))
        whole, across, counted = settled(propagate(durable(begun.groupBy("group", "shard").agg(F.count("*").alias("n"))), room, rounds, edges), room)
        if told is not None:
            told.update(counted)
        kept = linked.join(whole.withColumnRenamed("group", "_g"), F.col("group") == F.col("_g")).drop("_g")
        placed = placed.unionByName(kept)
        if across:
            placed = placed.unionByName(in_pieces(linked, across))
    placed = durable(placed)
    load = {r["shard"]: r["n"] for r in placed.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # one row a shard
    alone = others.join(small, F.col("group") == F.col("_g"), "left_anti")
    filler = running_total(alone, [], ["id", "group"], F.lit(1), "at")
    bounds = ends([r - load.get(s, 0) for s, r in enumerate(capacities(total, shards))])
    placed = durable(placed.unionByName(filler.withColumn("shard", within(F.col("at"), bounds)).drop("at")))
    numbered = running_total(placed, ["shard"], ["id", "group"], F.lit(1), "slot")
    return numbered.select("id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))
