"""Artifact documents made of table rows, for the queries that compare the operators with SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

URL = "https://schemas.getdbt.com/dbt/"


def rows(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def envelope(kind: str, version: Column | int) -> Column:
    number = version if isinstance(version, Column) else F.lit(version)
    return F.struct(F.concat(F.lit(f"{URL}{kind}/v"), number.cast("string"), F.lit(".json")).alias("dbt_schema_version"), F.lit("1.11.0").alias("dbt_version"))


def document(artifact_id: Column, **parts: Column) -> list[Column]:
    """Columns artifact_id and body of a document with these root keys."""
    return [artifact_id.cast("string").alias("artifact_id"), F.to_json(F.struct(*[c.alias(k) for k, c in parts.items()])).alias("body")]


def order_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run-results document for each order: a result for each of its lines."""
    status = F.when(F.col("l_returnflag") == "A", "success").when(F.col("l_returnflag") == "N", "pass").otherwise("error")
    result = F.struct(F.concat(F.lit("model.shop.p"), F.col("l_partkey")).alias("unique_id"), status.alias("status"), F.lit("Thread-1").alias("thread_id"), F.col("l_quantity").alias("execution_time"), F.col("l_linenumber").cast("long").alias("failures"), F.col("l_linestatus").alias("message"))
    got = rows(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", result.alias("r")))).alias("rs"))
    return got.select(*document(F.col("l_orderkey"), metadata=envelope("run-results", 6), elapsed_time=F.lit(1.5), results=F.transform("rs", lambda x: x["r"])))


def event_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document for each event, of a kind and version by its id, with odd URLs among them."""
    n = F.col("event_id")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("manifest", "catalog", "run-results", "sources")]), (n % 4 + 1).cast("int"))
    number = F.concat(F.when(n % 7 == 3, F.lit("0")).otherwise(F.lit("")), (n % 14).cast("string"))
    end = F.when(n % 5 == 1, F.lit(".json?x")).when(n % 5 == 2, F.lit(".json\n")).otherwise(F.lit(".json"))
    url = F.concat(F.lit(URL), kind, F.lit("/v"), number, end)
    return rows(spark, sf_dir, "events").select("event_id", kind.alias("told"), *document(n, metadata=F.struct(url.alias("dbt_schema_version"))))


def node_map(key: Column, value: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.collect_list(F.struct(key.alias("k"), value.alias("v")))))
