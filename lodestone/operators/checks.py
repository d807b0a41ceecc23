"""Generic tests and thresholds over tables: each is a DataFrame of the rows that fail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def some(df: DataFrame, where: str | None) -> DataFrame:
    """The rows that a test's own `where` lets through."""
    return df if where is None else df.where(F.expr(where))


def not_null(df: DataFrame, column: str, where: str | None = None) -> DataFrame:
    return some(df, where).where(F.col(column).isNull())


def unique(df: DataFrame, column: str, where: str | None = None) -> DataFrame:
    """Values that occur more than once, with how often."""
    return some(df, where).where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n_records")).where("n_records > 1")


def accepted_values(df: DataFrame, column: str, values: list, where: str | None = None) -> DataFrame:
    """Other values than the accepted, with how often; nulls are not judged."""
    return some(df, where).where(F.col(column).isNotNull() & ~F.col(column).isin(values)).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n_records"))


def relationships(df: DataFrame, column: str, to: DataFrame, field: str, where: str | None = None) -> DataFrame:
    """Rows of which the key is in no row of `to`."""
    return some(df, where).where(F.col(column).isNotNull()).join(to.select(F.col(field).alias("_to")), F.col(column) == F.col("_to"), "left_anti")


def outcome(failures: Column, severity: str = "error", warn_if: str = "!= 0", error_if: str = "!= 0") -> Column:
    """pass, warn or fail of a number of failures; the conditions are written as SQL comparisons."""
    def says(condition: str) -> Column:
        return F.expr(f"_failures {condition}")

    ask = F.when(says(error_if), "fail") if severity == "error" else F.when(F.lit(False), "fail")
    return ask.when(says(warn_if), "warn").otherwise("pass")


def summary(name: str, failing: DataFrame, severity: str = "error", warn_if: str = "!= 0", error_if: str = "!= 0", fail_calc: str = "count(*)", limit: int | None = None) -> DataFrame:
    """One row: test_name, failures, status. limit is the test's own limit of failing rows, if it has one."""
    rows = failing if limit is None else failing.limit(limit)
    got = rows.agg(F.coalesce(F.expr(fail_calc), F.lit(0)).cast("long").alias("_failures"))
    return got.select(F.lit(name).alias("test_name"), F.col("_failures").alias("failures"), outcome(F.col("_failures"), severity, warn_if, error_if).alias("status"))


def differences(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """What a unit test finds: rows that only one side has, as often as it has them more. Compared are expected's columns.

    Columns: side (actual: not expected; expected: missing) and those of expected.
    """
    mine = actual.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in expected.schema])
    part = lambda a, b, side: a.exceptAll(b).select(F.lit(side).alias("side"), "*")
    return part(mine, expected, "actual").union(part(expected, mine, "expected"))
