"""Source freshness as tables. Input: artifact_id, body."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields of source freshness.
_TIME = "struct<count:bigint,period:string>"
FRESHNESS = f"elapsed_time double, results array<struct<unique_id:string,error:variant,status:string,max_loaded_at:string,snapshotted_at:string,max_loaded_at_time_ago_in_s:double,criteria:struct<warn_after:{_TIME},error_after:{_TIME},filter:string>,adapter_response:map<string,variant>,timing:array<struct<name:string,started_at:string,completed_at:string>>,thread_id:string,execution_time:double>>"


def freshness(docs: DataFrame) -> DataFrame:
    """A row for each source checked; errors are rows of status `runtime error`."""
    each = docs.select("artifact_id", F.posexplode(F.from_json("body", FRESHNESS)["results"]).alias("pos", "r"))
    plain = [F.col(f"r.{c}").alias(c) for c in ("unique_id", "status", "max_loaded_at", "snapshotted_at", "criteria", "adapter_response", "timing", "thread_id", "execution_time")]
    return each.select("artifact_id", "pos", *plain, F.col("r.max_loaded_at_time_ago_in_s").alias("ago_s"), F.try_variant_get("r.error", "$", "string").alias("error"))


def seconds(limit: Column) -> Column:
    """Seconds of (count, period); null if either is missing or the period unknown."""
    unit = F.when(limit["period"] == "minute", 60).when(limit["period"] == "hour", 3600).when(limit["period"] == "day", 86_400)
    return limit["count"] * unit


def freshness_status(ago_s: Column, criteria: Column) -> Column:
    """Status of a source of which the newest row is ago_s old: a limit counts once it is passed. Null if the age is not known."""
    return F.when(ago_s.isNull(), F.lit(None).cast("string")).when(ago_s > seconds(criteria["error_after"]), "error").when(ago_s > seconds(criteria["warn_after"]), "warn").otherwise("pass")
