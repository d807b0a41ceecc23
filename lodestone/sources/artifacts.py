"""Artifact documents from folders, and paths of single ones."""

from __future__ import annotations

from functools import partial
from pathlib import Path
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.detect import parse_version

#: The part of a file name that tells a kind of artifact.
TOKENS = {"manifest": "manifest", "run-results": "run_results", "catalog": "catalog", "sources": "sources"}


def read_artifacts(spark: SparkSession, folder: str, kind: str | None = None) -> DataFrame:
    """Columns artifact_id (the path) and body of all JSON files below a folder; of one kind, by file name.

    A missing folder gives no rows. A document is one row, so later steps deal out its parts, not the document.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], "artifact_id string, body string")
    glob = f"*{TOKENS[kind]}*.json" if kind else "*.json"
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("artifact_id"), F.col("value").alias("body"))


def check_name(name: str) -> str:
    """name, if it can be one part of a path."""
    if not name.strip() or ".." in name or "/" in name or "\\" in name:
        raise ValueError(f"Invalid path component: {name!r}")
    return name


def clean_name(name: str) -> str:
    """name without parent references and separators."""
    return name.replace("..", "").replace("/", "").replace("\\", "")


def artifact_path(root: str, kind: str, version: str | int, project: str, filename: str) -> str:
    """Path of a document below root: kind, vN, project, file; it can't lead out of root."""
    number = str(version)
    number = number if number.startswith("v") else f"v{number}"
    path = Path(root, *(check_name(x) for x in (TOKENS[kind], number, project, filename))).resolve()
    if not path.is_relative_to(Path(root).resolve()):
        raise ValueError(f"{path} is outside {root}")
    return str(path)


def load_artifact(spark: SparkSession, root: str, kind: str, version: int, project: str, filename: str | None = None) -> DataFrame:
    """The document of a kind, version, project and file below root, as the parser of that version sees it.

    Without a file name it is that of the kind. A missing file gives no rows.
    """
    name = filename or f"{TOKENS[kind]}.json"
    path = artifact_path(root, kind, version, project, name)
    docs = read_artifacts(spark, str(Path(path).parent)).where(F.col("artifact_id").endswith("/" + quote(name)))
    return parse_version(docs, kind, int(str(version).removeprefix("v")))


load_manifest = partial(load_artifact, kind="manifest")
load_catalog = partial(load_artifact, kind="catalog")
load_run_results = partial(load_artifact, kind="run-results")
load_sources = partial(load_artifact, kind="sources")


def write_table(df: DataFrame, path: str, mode: str = "error") -> None:
    """A flattened table as Parquet."""
    df.write.mode(mode).parquet(path)


def export(df: DataFrame, name: str, export_as: str = "table", mode: str = "overwrite") -> None:
    """A saved query's result under a name: as a table of the catalog, or as a view of this session."""
    if export_as == "table":
        df.write.mode(mode).saveAsTable(name)
    elif export_as == "view":
        df.createOrReplaceTempView(name)
    else:
        raise ValueError(f"Unknown export: {export_as}")
