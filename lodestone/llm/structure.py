"""Repair of the turn structure of conversations: A* search for the cheapest edits, in pieces of bounded length.

Rows of a conversation are kept, given another role, deleted, or preceded by inserted turns, so that the first letters of
its roles read `(s?(ua)+)?`. Costs: keep 0, rerole 2, delete 3, insert 2, and 1 for each truncated row that is not deleted.
Blank rows and rows that repeat an earlier one must be deleted.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

#: Rows searched together are 2 to the power of this at most; a longer conversation's pieces are joined by their ends.
PIECE_BITS = 8
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
#: States of the role sequence: nothing yet, after a system turn, after a user turn, after an assistant turn.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: What a role's first letter leads to from each state; other letters lead nowhere.
NEXT = {("s", NOTHING): SYSTEM, ("u", NOTHING): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
ENDS = (NOTHING, ASSISTANT)
#: The role that an inserted or reroled turn has in each state, and the state after it.
MISSING = {q: ("a", ASSISTANT) if q == USER else ("u", USER) for q in STATES}
#: Each row is one sign: its role's first letter (x: another than s, u, a), in capitals if truncated; a digit if it must go.
LETTERS, TRUNCATED, GONE = "suax", "SUAX", "1234"
PATHS = "array<struct<start:int,end:int,cost:long,audit:string>>"


@cache
def steps(sign: str, state: int) -> tuple[tuple[int, str, int], ...]:
    """(cost, edit, state after it) of what may be done with a row."""
    out = [(3, DELETE, state)]
    if sign not in GONE:
        extra = int(sign in TRUNCATED)
        kept = NEXT.get((sign.lower(), state))
        if kept is not None:
            out.append((extra, KEEP, kept))
        out.append((2 + extra, REROLE, MISSING[state][1]))
    return tuple(out)


def search(signs: str, start: int) -> dict[int, tuple[int, str]]:
    """(cost, audit) of the best path from `start` through all rows to each state: least cost, then least audit in ASCII order.

    A* over the lattice of rows done and states. The heuristic is the suffix sum of what no path avoids: 3 for each row
    that must go, 1 for each truncated row, which costs as much if it stays and more if it goes. It never falls by more
    than an edit costs, so each node's first visit, by (cost + heuristic, audit), is by its best path: a beginning of an
    audit comes before the audit, and of two equally dear paths to a node neither audit begins the other.
    """
    n = len(signs)
    ahead = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        ahead[i] = ahead[i + 1] + (3 if signs[i] in GONE else int(signs[i] in TRUNCATED))
    found: dict[int, tuple[int, str]] = {}
    done, heap = set(), [(ahead[0], "", 0, start)]
    while heap and len(found) < len(STATES):
        f, audit, i, state = heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        cost = f - ahead[i]
        if i == n:
            found[state] = (cost, audit)
        else:
            for more, edit, then in steps(signs[i], state):
                if (i + 1, then) not in done:
                    heappush(heap, (cost + more + ahead[i + 1], audit + edit, i + 1, then))
        if (i, MISSING[state][1]) not in done:
            heappush(heap, (f + 2, audit + INSERT, i, MISSING[state][1]))
    return found


def written(audit: str, signs: str, state: int) -> list[str]:
    """The turns in place of each row, and at the end: K for the row itself, u, a for new turns, U, A for the row reroled."""
    out, i = [""], 0
    for edit in audit:
        if edit == INSERT:
            letter, state = MISSING[state]
            out[i] += letter
            continue
        if edit == KEEP:
            out[i] += "K"
            state = NEXT[signs[i].lower(), state]
        elif edit == REROLE:
            letter, state = MISSING[state]
            out[i] += letter.upper()
        i += 1
        out.append("")
    return out


def signed(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, turn, role, text, at (numbers that go up in the rows' order), sign; equal rows are counted before they meet.

    The first copy of a role and text in a conversation is found by partial minima, not by a window over the conversation.
    """
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in (role_col, text_col))
    own = rows.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), role.alias("role"), text.alias("text"))
    own = own.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("copies"))
    own = durable(own.withColumn("print", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)))
    place = F.struct(F.col("turn").isNotNull().alias("told"), F.col("turn").alias("turn"))
    first = own.groupBy(F.col("conv").alias("c"), F.col("print").alias("p")).agg(F.min(place).alias("first"))
    met = own.join(first, F.col("conv").eqNullSafe(F.col("c")) & (F.col("print") == F.col("p")))
    met = met.withColumn("again", place != F.col("first")).select("conv", "turn", "role", "text", "again", F.posexplode(F.sequence(F.lit(1), F.col("copies"))).alias("copy", "_"))
    # In the order of a global sort, so that a conversation of any length is spread over as many tasks as it needs.
    placed = met.sort("conv", "turn", "role", "text", "copy").withColumn("at", F.monotonically_increasing_id())
    kind = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.translate(F.substring("role", 1, 1), "sua", "012").cast("int")).otherwise(3)
    end = F.right(F.rtrim("text", F.lit(" \t\n\x0b\f\r")), F.lit(1))
    fault = F.when(end == "", "blank").when(F.col("again") | (F.col("copy") > 0), "duplicate").when(~end.isin(".", "!", "?"), "truncated").otherwise("none")
    signs = F.when(F.col("fault").isin("blank", "duplicate"), F.lit(GONE)).when(F.col("fault") == "truncated", F.lit(TRUNCATED)).otherwise(F.lit(LETTERS))
    return placed.withColumn("fault", fault).withColumn("sign", F.substring(signs, kind + 1, F.lit(1))).select("conv", "turn", "role", "text", "at", "fault", "sign")


def pieces(rows: DataFrame) -> DataFrame:
    """conv, piece, signs: at most 2 ** PIECE_BITS rows of a conversation that follow each other; `rows` of `signed`."""
    piece = F.shiftright("at", PIECE_BITS).alias("piece")
    listed = F.array_sort(F.collect_list(F.struct("at", "sign")))
    return rows.groupBy("conv", piece).agg(F.array_join(F.transform(listed, lambda x: x["sign"]), "").alias("signs"), F.min("at").alias("first"))


def searched(parts: DataFrame) -> DataFrame:
    """parts with paths: the best way from each state to each other through the piece."""

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = cache(lambda signs: [(a, b, *path) for a in STATES for b, path in search(signs, a).items()])
        for frame in frames:
            known.cache_clear()
            yield frame.assign(paths=[[dict(zip(("start", "end", "cost", "audit"), x)) for x in known(s)] for s in frame["signs"]])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema)
    return parts.mapInPandas(look, f"{kept}, paths {PATHS}")


def joined(parts: DataFrame) -> DataFrame:
    """conv, cost, audit, illegal, edits (piece, first, turns) of each conversation: the best way through its pieces in order.

    The pieces' ends are the same four states, so the best path to each is kept, by (cost, audit) as in a piece.
    """
    listed = F.array_sort(F.collect_list(F.struct("piece", "first", "signs", "paths")))

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for own in frame["parts"]:
                best = {NOTHING: (0, "", [])}
                for part in own:
                    ahead: dict[int, tuple[int, str, list]] = {}
                    for path in part["paths"]:
                        if path["start"] in best:
                            cost, audit, way = best[path["start"]]
                            new = (cost + path["cost"], audit + path["audit"])
                            if path["end"] not in ahead or new < ahead[path["end"]][:2]:
                                ahead[path["end"]] = (*new, [*way, (path["start"], path["audit"])])
                    best = ahead
                cost, audit, way = min((best[q] for q in ENDS if q in best), key=lambda x: x[:2])
                edits = [{"piece": part["piece"], "first": part["first"], "turns": written(some, part["signs"], state)} for part, (state, some) in zip(own, way)]
                letters = "".join(part["signs"] for part in own).translate(str.maketrans(TRUNCATED + GONE, LETTERS + LETTERS))
                illegal = sum(letters[i : i + 2] not in ("su", "ua", "au") for i in range(len(letters) - 1))
                out.append((cost, audit, illegal, edits))
            yield pd.DataFrame({"conv": frame["conv"], **{k: [x[i] for x in out] for i, k in enumerate(("cost", "audit", "illegal", "edits"))}})

    kind = parts.schema["conv"].dataType.simpleString()
    own = parts.groupBy("conv").agg(listed.alias("parts"))
    return own.mapInPandas(look, f"conv {kind}, cost long, audit string, illegal long, edits array<struct<piece:long,first:long,turns:array<string>>>")


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The rows as they are, with their faults, and what is found for each conversation: see `signed` and `joined`.

    A row's fault is blank (no other sign than white space), else duplicate (an earlier row of the conversation has its role
    and text), else truncated (its last sign that is no white space is none of `.!?`), else none.

    Rows go by turn, nulls first; equal turns by role and text. A null role or text is one space. Equal rows are copies of
    each other, of which the first may stay. Rows of null conversations form one conversation. Other columns, whatever
    their names, are left out. A conversation is searched in pieces of bounded length, so its rows need never meet; only
    its signs' best paths, some bytes a row, do. An empty table gives empty results.
    """
    own = durable(signed(rows, conv_col, turn_col, role_col, text_col))
    return own, durable(joined(searched(pieces(own))))


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv, place (sorts the turns of a conversation), edit (K, R or I), role, text; rows and found are those of `repair`."""
    each = found.select(F.col("conv").alias("c"), F.inline("edits")).select("c", "piece", "first", F.posexplode("turns").alias("i", "turns")).where("turns <> ''")
    each = each.withColumn("no", F.explode(F.sequence(F.lit(1), F.length("turns"))))
    each = each.select("c", F.struct("piece", "i", "no").alias("place"), (F.col("first") + F.col("i")).alias("of"), F.substring("turns", F.col("no"), F.lit(1)).alias("turn"))
    new, kept = F.col("turn").isin("u", "a"), F.col("turn") == "K"
    other = F.when(F.lower("turn") == "u", "user").otherwise("assistant")
    added = each.where(new).select(F.col("c").alias("conv"), "place", F.lit(INSERT).alias("edit"), other.alias("role"), F.lit("").alias("text"))
    stay = each.where(~new).join(rows.select("conv", "at", "role", "text"), F.col("c").eqNullSafe(F.col("conv")) & (F.col("of") == F.col("at")))
    stay = stay.select("conv", "place", F.when(kept, KEEP).otherwise(REROLE).alias("edit"), F.when(kept, F.col("role")).otherwise(other).alias("role"), "text")
    return stay.unionByName(added)


def report(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation that has rows."""
    turn = F.col("turn").cast("long")
    gaps = F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn), F.lit(0))
    told = rows.groupBy(F.col("conv").alias("c")).agg(gaps.alias("gaps"), *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])
    met = found.join(told, F.col("conv").eqNullSafe(F.col("c")))
    return met.select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """rows with faults that crc32 of `conversation:turn`, modulo 20, puts in: for tests and measures of the repair.

    0 drops the row, 1 empties its text, 2 takes `.!?` out of it, 3 repeats the row, 4 makes its role user. Nulls are written
    as one space.
    """
    spaced = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(spaced(conv_col), F.lit(":"), spaced(turn_col))), F.lit(20))
    text = F.when(kind == 1, "").when(kind == 2, F.translate(spaced(text_col), ".!?", "")).otherwise(spaced(text_col))
    own = rows.where(kind != 0).select(F.col(f"`{conv_col}`").alias(conv_col), F.col(f"`{turn_col}`").alias(turn_col), F.when(kind == 4, "user").otherwise(spaced(role_col)).alias(role_col), text.alias(text_col), F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("times"))
    return own.select(conv_col, turn_col, role_col, text_col, F.explode("times")).drop("col")
