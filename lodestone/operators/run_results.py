"""Run results as tables. Input: artifact_id, body."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.detect import let

#: Fields of run results.
RESULTS = (
    "elapsed_time double, args map<string,variant>, results array<struct<status:string,timing:array<struct<name:string,started_at:string,completed_at:string>>,"
    "thread_id:string,execution_time:double,message:variant,failures:bigint,adapter_response:map<string,variant>,unique_id:string,compiled:boolean,"
    "compiled_code:string,relation_name:string,batch_results:struct<successful:array<array<string>>,failed:array<array<string>>>,"
    "overload_results:struct<successful:array<string>,failed:array<string>>>>"
)

#: What adapters tell of a result.
_RESPONSE = {"_message": "string", "code": "string", "rows_affected": "bigint", "bytes_processed": "bigint", "query_id": "string"}


def run_results(docs: DataFrame, keep: tuple[str, ...] = (), totals: bool = False) -> DataFrame:
    """A row for each result of each document, with the columns of docs named by `keep`, such as version.

    message is text, also where version 1 has a number. With `totals` each row also tells elapsed_time and n_results of its
    document, which is parsed once for both, so that no join of documents with themselves is needed.
    """
    whole = (*keep, "elapsed_time", "n_results") if totals else keep
    parsed = F.from_json("body", RESULTS)
    if totals:
        told = lambda d: F.transform(d["results"], lambda r, i: F.struct(d["elapsed_time"].alias("elapsed_time"), F.size(d["results"]).alias("n_results"), i.alias("pos"), r.alias("r")))
        each = docs.select("artifact_id", *keep, F.inline(let(parsed, told)))
    else:
        each = docs.select("artifact_id", *keep, F.posexplode(parsed["results"]).alias("pos", "r"))
    plain = [F.col(f"r.{c}").alias(c) for c in ("unique_id", "status", "thread_id", "execution_time", "failures", "compiled", "compiled_code", "relation_name", "adapter_response", "timing", "batch_results", "overload_results")]
    return each.select("artifact_id", *whole, "pos", F.try_variant_get("r.message", "$", "string").alias("message"), *plain)


def run_totals(docs: DataFrame) -> DataFrame:
    """elapsed_time and number of results of each document."""
    got = F.from_json("body", RESULTS)
    return docs.select("artifact_id", got["elapsed_time"].alias("elapsed_time"), F.coalesce(F.size(got["results"]), F.lit(0)).alias("n_results"))


def run_timings(docs: DataFrame) -> DataFrame:
    """A row for each timing of each result, with the times also as timestamps and the time between in seconds."""
    each = run_results(docs).select("artifact_id", F.col("pos").alias("result_pos"), "unique_id", F.posexplode("timing").alias("pos", "t"))
    start, end = F.col("t.started_at").try_cast("timestamp"), F.col("t.completed_at").try_cast("timestamp")
    return each.select("artifact_id", "result_pos", "unique_id", "pos", "t.name", "t.started_at", "t.completed_at", start.alias("started_ts"), end.alias("completed_ts"), ((F.unix_micros(end) - F.unix_micros(start)) / 1e6).alias("seconds"))


def _outcomes(docs: DataFrame, parts: str, name: str) -> DataFrame:
    """The successful and the failed parts of each result, by outcome and place."""
    listed = lambda o: F.transform(F.coalesce(F.col(f"{parts}.{o}"), F.array()), lambda x, i: F.struct(F.lit(o).alias("outcome"), i.alias("pos"), x.alias(name)))
    return run_results(docs).select("artifact_id", F.col("pos").alias("result_pos"), F.inline(F.concat(listed("successful"), listed("failed"))))


def run_batches(docs: DataFrame) -> DataFrame:
    """A row for each batch of microbatch results, by outcome."""
    return _outcomes(docs, "batch_results", "batch")


def run_overloads(docs: DataFrame) -> DataFrame:
    """A row for each overload of function results, by outcome."""
    return _outcomes(docs, "overload_results", "overload")


def run_args(docs: DataFrame) -> DataFrame:
    """A row for each argument of each run; value as text."""
    each = docs.select("artifact_id", F.explode(F.from_json("body", "args map<string,variant>")["args"]).alias("name", "v"))
    return each.select("artifact_id", "name", F.try_variant_get("v", "$", "string").alias("value"))


def adapter_responses(docs: DataFrame) -> DataFrame:
    """What the database said of each result: rows_affected, bytes_processed, code, query_id, message, where it told them."""
    got = run_results(docs)
    told = [F.try_variant_get(F.col("adapter_response")[c], "$", kind).alias(c if c != "_message" else "response") for c, kind in _RESPONSE.items()]
    return got.select("artifact_id", "pos", "unique_id", *told)


def status_totals(results: DataFrame) -> DataFrame:
    """Results and seconds by status."""
    return results.groupBy("status").agg(F.count("*").alias("n_results"), F.round(F.sum("execution_time"), 2).alias("total_time"), F.coalesce(F.sum("failures"), F.lit(0)).cast("long").alias("n_failures"))
