"""The metadata of artifacts of all kinds as a table. Input: artifact_id, body."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fields of the metadata of artifacts.
FIELDS = ("dbt_schema_version", "dbt_version", "generated_at", "invocation_id", "invocation_started_at", "adapter_type", "project_name", "project_id", "user_id")


def metadata_table(docs: DataFrame) -> DataFrame:
    """A row for each document: the text fields of its metadata, generated_at also as a timestamp, and env as a map.

    What is absent is null; metadata that is no object gives a row of nulls. Runs are joined by invocation_id.
    """
    got = docs.select("artifact_id", F.from_json("body", "metadata variant")["metadata"].alias("m"))
    plain = [F.try_variant_get("m", f"$.{c}", "string").alias(c) for c in FIELDS]
    return got.select("artifact_id", *plain, F.try_variant_get("m", "$.env", "map<string,string>").alias("env")).withColumn("generated_ts", F.col("generated_at").try_cast("timestamp"))
