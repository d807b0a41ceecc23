"""Rows of a history joined to events by the time at which they were valid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def valid_at(events: DataFrame, history: DataFrame, key: str, at: str, start: str, end: str, columns: list[str], history_key: str | None = None, slot: str = "month") -> DataFrame:
    """events with `columns` of the row of history that has their key and was valid at their time: start <= at < end.

    An end that is null is open. Of rows of a key that overlap, the one that began last counts, even if it has ended. Events
    without such a row, a key or a time get nulls; nothing is dropped or repeated. `columns` are no columns of events.

    Both sides are put in order once, by key and by slots of time, so that a key that holds most rows is many groups. Each
    slot begins with the row that was open before it, found from one row a key and slot.
    """
    kept = F.struct(*[F.col(f"`{c}`") for c in events.columns])
    row = F.struct(F.col(f"`{start}`").cast("timestamp").alias("start"), F.col(f"`{end}`").cast("timestamp").alias("end"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    began = history.select(F.col(f"`{history_key or key}`").alias("k"), row.alias("row")).where("k is not null and row.start is not null")
    came = events.select(F.col(f"`{key}`").alias("k"), F.col(f"`{at}`").cast("timestamp").alias("t"), kept.alias("event"))
    slotted = lambda t: F.date_trunc(slot, t).alias("slot")
    # What is open when a slot begins, from the last row of each slot before.
    ends = began.groupBy("k", slotted(F.col("row.start"))).agg(F.max_by("row", F.struct("row.start", F.coalesce(F.col("row.end"), F.lit("9999-12-31").cast("timestamp")))).alias("last"))
    seen = ends.unionByName(came.where("k is not null and t is not null").select("k", slotted(F.col("t"))).distinct(), allowMissingColumns=True)
    slots = seen.groupBy("k", "slot").agg(F.first("last", ignorenulls=True).alias("last"))
    before = Window.partitionBy("k").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    opened = slots.select("k", "slot", F.last("last", ignorenulls=True).over(before).alias("row")).where("row is not null")
    none = F.lit(None)
    whole = (
        opened.select("k", "slot", F.lit(0).alias("kind"), F.col("row.start").alias("t"), "row", none.cast(came.schema["event"].dataType).alias("event"))
        .union(began.select("k", slotted(F.col("row.start")), F.lit(0), F.col("row.start"), "row", none))
        .union(came.where("k is not null and t is not null").select("k", slotted(F.col("t")), F.lit(1), "t", none, "event"))
    )
    order = Window.partitionBy("k", "slot").orderBy("t", "kind", F.coalesce(F.col("row.end"), F.lit("9999-12-31").cast("timestamp"))).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = whole.withColumn("last", F.last(F.when(F.col("kind") == 0, F.col("row")), ignorenulls=True).over(order)).where("kind = 1")
    valid = F.col("last.end").isNull() | (F.col("t") < F.col("last.end"))
    found = met.select("event", F.when(valid, F.col("last")).alias("row")).unionByName(came.where("k is null or t is null").select("event"), allowMissingColumns=True)
    return found.select("event.*", *[F.col(f"row.c{i}").alias(c) for i, c in enumerate(columns)])
