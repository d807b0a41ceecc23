"""New artifact files as a stream."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.detect import detect


def watch(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the JSON files that come into a folder: artifact_id, body, kind, version, schema_url, error."""
    files = spark.readStream.format("text").schema("value string").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(folder)
    return detect(files.select(F.col("_metadata.file_path").alias("artifact_id"), F.col("value").alias("body")))
