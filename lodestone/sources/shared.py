"""The folder that driver and executors share."""

import tempfile

from pyspark.sql import SparkSession


def checkpoint_folder(spark: SparkSession) -> None:
    """See that checkpoints have a folder: spark.checkpoint.dir, or a temporary one in local mode only."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lodestone-"))
