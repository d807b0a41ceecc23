"""Snapshots: the history of a table's rows, kept as periods of validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VALID = ("valid_from", "valid_to")


def start(source: DataFrame, at: Column) -> DataFrame:
    """The first snapshot of a table: every row valid from `at`, with no end."""
    return source.select("*", at.cast("timestamp").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"))


def snapshot(history: DataFrame, source: DataFrame, key: str, at: Column, check: list[str] | None = None, updated_at: str | None = None, close_missing: bool = False) -> DataFrame:
    """history after the table is seen again. Keys are unique in source and among the open rows of history.

    A row has changed if updated_at is later than in the open row, or else if a column of `check` (all but the key, if none
    are given) differs, nulls being equal. The open row then ends and a new one begins: at updated_at, or at `at`. New keys
    begin; keys that are gone stay open unless close_missing. One join by key; closed rows only pass through.
    """
    names = [c for c in history.columns if c not in VALID]
    looked = check or [c for c in names if c != key]
    now = source.select(*[F.col(f"`{c}`").alias(f"_new_{c}") for c in names])
    met = history.where("valid_to is null").join(now, F.col(key) == F.col(f"_new_{key}"), "full_outer")
    differs = F.lit(False)
    for c in looked:
        differs = differs | ~F.col(f"`{c}`").eqNullSafe(F.col(f"`_new_{c}`"))
    changed = F.col(f"_new_{updated_at}") > F.col(updated_at) if updated_at else differs
    begins = (F.col(f"_new_{updated_at}") if updated_at else at).cast("timestamp")
    had, has = F.col(key).isNotNull(), F.col(f"_new_{key}").isNotNull()
    ended = F.when(had & has & F.coalesce(changed, F.lit(False)), begins).when(had & ~has & F.lit(close_missing), at.cast("timestamp"))
    old = F.when(had, F.struct(*[F.col(f"`{c}`") for c in names], F.col("valid_from"), ended.alias("valid_to")))
    new = F.when(has & (~had | F.coalesce(changed, F.lit(False))), F.struct(*[F.col(f"`_new_{c}`").alias(c) for c in names], begins.alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to")))
    out = met.select(F.explode(F.array_compact(F.array(old, new))).alias("r")).select("r.*")
    return history.where("valid_to is not null").unionByName(out)
