"""Chat formatting in budgeted windows, by DataFrame operations only.

A formatted turn is `### role: text</turn>` and a newline. In roles and texts `\\` is written `\\b`, `<` is `\\l` and `#` is
`\\h` (and `:` is `\\c` in roles), so neither `</turn>` nor `### ` occurs inside them and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the template.
OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))


def escape(text: Column, table: tuple = ESCAPES) -> Column:
    for raw, safe in table:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column, table: tuple = ESCAPES) -> Column:
    for raw, safe in reversed(table):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def windows(conversations: DataFrame, budget: int = 1024, history: int = 128, slack: int | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Columns conv, window, text, own_from, loss (spans of code points in text): the training windows of conversations.

    A turn's tokens are the white-space words of its formatted line. Each window has the system turns that come before its
    span, then the turns of the window before that begin within `history` tokens before it, then its span. A conversation's
    first system turn is kept so if it has half the budget at most, and further ones while the tokens of all so far are a
    quarter of the budget at most; the others, so also a first one that is too long to be repeated, are like any turn.

    Prefix sums of the tokens of all turns but kept ones choose spans. They are cut into lengths of `own` tokens: what the
    budget leaves beside the kept system turns, history and slack (as much as history if None), but at least the slack. A turn belongs to the length it
    begins in. If it ends in a later one and has more than `slack` tokens, it is a span of its own. So no window passes
    the budget, unless one turn is too long for it (or history and slack together are more than half the budget).

    Only assistant texts of the span are under the loss mask, so a repeated turn is never a target twice.

    Turns go by number; equal numbers by role and text; nulls first. Null texts and roles are empty. Rows of null
    conversations form one conversation. An empty table gives no windows.
    """
    slack = history if slack is None else slack
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    turns = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    turns = turns.withColumn("line", F.concat(F.lit(OPEN), escape(F.col("role"), ROLE_ESCAPES), F.lit(MIDDLE), escape(F.col("text")), F.lit(CLOSE)))
    turns = turns.withColumn("tokens", F.regexp_count("line", F.lit(r"\S+")).cast("long"))
    whole = Window.partitionBy("conv")
    order = whole.orderBy("turn", "role", "text")
    is_system, so_far = F.col("role") == "system", order.rowsBetween(Window.unboundedPreceding, 0)
    turns = turns.withColumn("no", F.row_number().over(order)).withColumn("systems", F.count(F.when(is_system, 1)).over(so_far)).withColumn("told", F.sum(F.when(is_system, F.col("tokens"))).over(so_far))
    turns = turns.withColumn("kept", is_system & (((F.col("systems") == 1) & (F.col("told") <= budget // 2)) | (F.col("told") <= budget // 4)))
    turns = turns.withColumn("cost", F.when(F.col("kept"), 0).otherwise(F.col("tokens"))).withColumn("before", F.sum("cost").over(so_far) - F.col("cost"))
    beside = F.coalesce(F.sum(F.when(F.col("kept"), F.col("tokens"))).over(whole), F.lit(0))
    turns = turns.withColumn("own_tokens", F.greatest(F.lit(max(slack, 1)), budget - history - slack - beside))
    length = F.floor(F.col("before") / F.col("own_tokens"))
    alone = (F.col("cost") > slack) & (F.col("before") + F.col("cost") > (length + 1) * F.col("own_tokens"))
    turns = turns.withColumn("span", 2 * length + alone.cast("long"))
    later = whole.orderBy("span").rangeBetween(1, Window.unboundedFollowing)
    turns = turns.withColumn("top", F.max("span").over(whole)).withColumn("next_span", F.min("span").over(later)).withColumn("next_before", F.min("before").over(later))
    # A turn is in its own span's window; near its end in the next one's, as history; a kept system turn in all later ones.
    near = F.col("next_before") - F.col("before") <= history
    placed = turns.withColumn("window", F.explode(F.when(F.col("kept"), F.sequence("span", "top")).when(near, F.array("span", "next_span")).otherwise(F.array("span"))))
    placed = placed.withColumn("own", F.col("window") == F.col("span"))
    parts = placed.groupBy("conv", "window").agg(F.array_sort(F.collect_list(F.struct("no", "own", (F.col("own") & (F.col("role") == "assistant")).alias("target"), "line", (F.length(F.lit(OPEN + MIDDLE)) + F.length(escape(F.col("role"), ROLE_ESCAPES))).alias("head")))).alias("p"))
    # A window in which no turn starts has nothing of its own.
    parts = parts.where(F.exists("p", lambda x: x["own"]))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss"), F.lit(None).cast("int").alias("first"))

    def add(s: Column, x: Column) -> Column:
        span = F.struct((s["at"] + x["head"]).cast("int").alias("start"), (F.length(x["line"]) - x["head"] - len(CLOSE)).cast("int").alias("length"))
        return F.struct((s["at"] + F.length(x["line"])).cast("int").alias("at"), F.when(x["target"], F.array_append(s["loss"], span)).otherwise(s["loss"]).alias("loss"), F.coalesce(s["first"], F.when(x["own"], s["at"])).cast("int").alias("first"))

    made = parts.withColumn("s", F.aggregate("p", zero, add))
    return made.select("conv", "window", F.array_join(F.transform("p", lambda x: x["line"]), "").alias("text"), F.col("s.first").alias("own_from"), F.col("s.loss").alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Columns conv, turns (array of role and text), targets (array of texts under the loss mask), formatted_chars.

    Everything is read from the formatted windows: each window's own part is split at the marks, and its loss spans
    are cut out and unescaped.
    """
    mine = F.substring(F.col("text"), F.col("own_from") + 1, F.length("text"))
    lines = F.filter(F.split(mine, F.lit(CLOSE)), lambda x: x != "")

    def turn(x: Column) -> Column:
        at = F.instr(x, MIDDLE)
        role = F.substring(x, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)
        return F.struct(unescape(role, ROLE_ESCAPES).alias("role"), unescape(F.substring(x, at + len(MIDDLE), F.length(x))).alias("text"))

    cut = F.transform("loss", lambda s: unescape(F.substring(F.col("text"), s["start"] + 1, s["length"])))
    rows = formatted.select("conv", "window", F.transform(lines, turn).alias("turns"), cut.alias("targets"), F.length("text").cast("long").alias("chars"))
    whole = rows.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("window", "turns", "targets"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    return whole.select("conv", F.flatten(F.transform("w", lambda x: x["turns"])).alias("turns"), F.flatten(F.transform("w", lambda x: x["targets"])).alias("targets"), "formatted_chars")


def digests(back: DataFrame) -> DataFrame:
    """Columns conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of what was read back."""
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    under = F.array_join("targets", "")
    return back.select("conv", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length(under).cast("long").alias("loss_chars"), F.sha2(under, 256).alias("loss_sha256"), "formatted_chars")
