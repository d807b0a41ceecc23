"""Rules over tables, such as generic tests and constraints: all rules of a table are answered by one scan of it.

Each row of a table gives a pair (rule, key) for each rule that it matters to: keys that must be unique, values that are not
accepted, keys that must be elsewhere, or an empty key for a row that is wrong by itself. All pairs of all tables are counted
by one grouping, with partial counts before the shuffle, so that no frequent key is one task.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Tables = Mapping[str, DataFrame] | Callable[[str], DataFrame]


@dataclass(frozen=True)
class Rule:
    """kind: not_null (rows with a null in columns), check (rows for which expression is false), unique (keys that occur more
    than once; keys with a null do not count), primary_key (both), accepted (values that are not among `values`), key (rows
    whose key, if it has no null, is not a key of to_columns in the table `to`). where lets only some rows count."""

    id: str
    table: str
    kind: str
    columns: tuple[str, ...] = ()
    where: str | None = None
    values: tuple = ()
    to: str | None = None
    to_columns: tuple[str, ...] = ()
    expression: str | None = None


KINDS = ("not_null", "check", "unique", "primary_key", "accepted", "key")
#: Sides of a pair: a wrong row, a key to be counted, a key that is looked for elsewhere.
WRONG, OWN, ELSEWHERE = range(3)


def table_of(tables: Tables, name: str) -> DataFrame:
    """The table of a name, given by a mapping or a function."""
    if callable(tables):
        return tables(name)
    if name not in tables:
        raise ValueError(f"Unknown table: {name}")
    return tables[name]


def _key(columns: Sequence[str]) -> tuple[Column, Column]:
    """A key as text, and whether it has a null."""
    parts = [F.col(f"`{c}`") for c in columns]
    null = F.lit(False)
    for p in parts:
        null = null | p.isNull()
    return F.array(*[p.cast("string") for p in parts]), null


def _pairs(rule: Rule) -> list[Column]:
    """What a row of the rule's table gives: structs (rule, side, key), null where it does not matter."""
    counts = F.lit(True) if rule.where is None else F.coalesce(F.expr(rule.where), F.lit(False))
    pair = lambda side, key: F.struct(F.lit(rule.id).alias("rule"), F.lit(side).alias("side"), key.alias("key"))
    nothing = F.array().cast("array<string>")
    if rule.kind == "check":
        return [F.when(counts & ~F.expr(rule.expression), pair(WRONG, nothing))]
    key, null = _key(rule.columns)
    wrong, own = F.when(counts & null, pair(WRONG, nothing)), F.when(counts & ~null, pair(OWN, key))
    if rule.kind == "not_null":
        return [wrong]
    if rule.kind == "primary_key":
        return [wrong, own]
    if rule.kind == "accepted":
        # Values of any type are compared as text, as they are written in the declaration.
        return [F.when(counts & ~null & ~F.col(f"`{rule.columns[0]}`").cast("string").isin([text(v) for v in rule.values]), pair(OWN, key))]
    if rule.kind in ("unique", "key"):
        return [own]
    raise ValueError(f"Unknown rule: {rule.kind}")


def text(value: object) -> str:
    """A declared value as Spark writes it."""
    return str(value).lower() if isinstance(value, bool) else str(value)


def failures(spark: SparkSession, rules: Sequence[Rule], tables: Tables) -> DataFrame:
    """Columns rule, groups (failing keys, each once, or failing rows), n_rows (rows that fail): one row a rule, also with none.

    Rules without a table of theirs are refused. Rule ids must differ. Columns of any type are compared as text, so 1 is
    not 1.0. An empty table fails no rule.
    """
    ids = [r.id for r in rules]
    if len(set(ids)) < len(ids):
        raise ValueError("Rules with the same id")
    every = spark.createDataFrame([(r.id, r.kind) for r in rules], "rule string, kind string")
    given: dict[str, list[Column]] = {}
    for r in rules:
        given.setdefault(r.table, []).extend(_pairs(r))
        if r.kind == "key":
            key, null = _key(r.to_columns)
            given.setdefault(r.to, []).append(F.when(~null, F.struct(F.lit(r.id).alias("rule"), F.lit(ELSEWHERE).alias("side"), key.alias("key"))))
    pairs = None
    for name, columns in given.items():
        found = table_of(tables, name).select(F.inline(F.array_compact(F.array(*columns))))
        pairs = found if pairs is None else pairs.unionByName(found)
    if pairs is None:
        return every.select("rule", F.lit(0).cast("long").alias("groups"), F.lit(0).cast("long").alias("n_rows"))
    counted = pairs.groupBy("rule", "key").agg(*[F.count_if(F.col("side") == s).alias(n) for n, s in (("wrong", WRONG), ("own", OWN), ("there", ELSEWHERE))])
    counted = counted.join(F.broadcast(every), "rule")  # one row a rule
    kind, own = F.col("kind"), F.col("own")
    bad = kind.isin("unique", "primary_key") & (own > 1) | (kind == "accepted") & (own > 0) | (kind == "key") & (own > 0) & (F.col("there") == 0)
    got = counted.groupBy("rule").agg((F.count_if(bad) + F.sum("wrong")).alias("groups"), (F.sum(F.when(bad, own).otherwise(0)) + F.sum("wrong")).alias("n_rows"))
    return every.join(got, "rule", "left").select("rule", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("groups", "n_rows")])
