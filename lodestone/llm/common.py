"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from weakref import WeakKeyDictionary

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Parts into which a key's rows are dealt for running totals, so that a hot key is no single task.
CHUNKS = 1024


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="lodestone-")
    spark.conf.set("spark.checkpoint.dir", folder)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


#: Where the tables of `durable` are, and the folders of applications that are removed at the end.
_STORED: WeakKeyDictionary = WeakKeyDictionary()
_FOLDERS: set[str] = set()


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone, and then what is left is the cluster's to clear
        _remove(spark, path)


def durable(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the shared folder and read back: short lineage that survives lost executors.

    The tables of an application are in one folder, which is removed when its driver ends; `release` removes one before.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/lodestone-{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_remove_at_exit, spark, folder)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _STORED[out] = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove tables of `durable` that nothing reads any more: all that was made of them is written."""
    for df in tables:
        _remove(df.sparkSession, _STORED.pop(df))


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: int) -> Iterator[None]:
    """Within: jobs that start run under this setting."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(value))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def arrow_batches(spark: SparkSession, most: int) -> contextlib.AbstractContextManager[None]:
    """Within: jobs that start hand tasks' Python workers about `most` bytes at once, and at least one row."""
    return setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", most)


def arrow_rows(spark: SparkSession, most: int) -> contextlib.AbstractContextManager[None]:
    """Within: jobs that start hand tasks' Python workers up to `most` rows at once; for rows of few numbers."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", most)


def fresh(df: DataFrame, name: str) -> str:
    """name, with as many underscores behind it as make it no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def columns(df: DataFrame) -> list[Column]:
    """df's columns, whatever their names hold."""
    return [F.col(f"`{c}`") for c in df.columns]


def spread_join(rows: DataFrame, key: str, table: DataFrame, name: str, n: str, total: int) -> DataFrame:
    """rows joined with table, which has a row for each key (`name`), not null, and the number `n` of rows with it.

    Keys that over a 4096th of all `total` rows have are fewer than 4096: these are broadcast, so that no hot key is one
    task; the other keys are joined as Spark chooses.
    """
    on = F.col(key) == F.col(name)
    hot = table.where(F.col(n) > total / 4096)
    return rows.join(F.broadcast(hot), on).unionByName(rows.join(F.broadcast(hot.select(name)), on, "left_anti").join(table, on))


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], amount: Column, out: str) -> DataFrame:
    """df with `out`: the sum of `amount` over the rows of the same keys that come before, in a fixed order.

    Rows are dealt into chunks by a hash of `order`; the order is by chunk, then by the columns of `order`. Only
    sums by chunk meet per key, so a key that holds most rows is still spread. df is read twice: make it durable.
    Rows that are equal in `order` come in any order among themselves.
    """
    df = df.withColumn("_chunk", F.pmod(F.xxhash64(*order), F.lit(CHUNKS)).cast("int")).withColumn("_amount", amount.cast("long"))
    group = [*keys, "_chunk"]
    sums = df.groupBy(*group).agg(F.sum("_amount").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(group)], F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = df.withColumn("_within", F.coalesce(F.sum("_amount").over(within), F.lit(0)))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(group)]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return inner.join(starts, on).withColumn(out, F.col("_start") + F.col("_within")).drop("_chunk", "_amount", "_within", "_start", *[f"_k{i}" for i in range(len(group))])


def slices(texts: Sequence[str | None], most: int = 400_000) -> Iterator[slice]:
    """Slices of texts with about `most` characters each, so that work arrays stay small; each text is whole."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t or "") + 1
        if total >= most:
            yield slice(start, i + 1)
            start, total = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def code_points(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, a zero after each, and where each text begins (with the end as last entry)."""
    whole = "\0".join([t or "" for t in texts] + [""])
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t or "") + 1 for t in texts], out=starts[1:])
    return np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32), starts


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    wide = np.concatenate(([False], mask, [False]))
    edge = np.flatnonzero(wide[1:] != wide[:-1])
    return edge[::2], edge[1::2]


def mix(h: np.ndarray) -> np.ndarray:
    """Bits of 64-bit integers spread over all positions."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


#: Spans of more code points than this are hashed by sums over their places.
SHORT = 48


def span_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of code points; spans are not empty.

    A span's code points are mixed in one after the other, for all spans at once. In a long span each is mixed with its
    place, and the sums are mixed again. What stands before a span does not matter, and no structure makes spans alike.
    """
    size = ends - starts
    order = np.argsort(np.uint8(SHORT + 1) - np.minimum(size, SHORT + 1).astype(np.uint8), kind="stable")
    starts, size = starts[order], size[order]
    live = np.searchsorted(-size, -np.arange(SHORT + 2), "left")  # spans of more than k code points
    h = size.astype(np.uint64)
    long = slice(0, live[SHORT])
    for k in range(SHORT):
        m = live[k]
        if m == long.stop:
            break
        g = h[long.stop : m]
        g ^= points[starts[long.stop : m] + k]
        g *= np.uint64(0x9E3779B97F4A7C15)
        g ^= g >> np.uint64(29)
    if long.stop:
        first = np.cumsum(size[long]) - size[long]
        code = np.arange(int(size[long].sum()), dtype=np.uint64)
        source = code.astype(np.int64) + np.repeat(starts[long] - first, size[long])
        code -= np.repeat((first - 1).astype(np.uint64), size[long])
        h[long] += np.add.reduceat(mix(code << np.uint64(21) | points[source]), first)
    out = np.empty(len(h), np.uint64)
    out[order] = mix(h)
    return out


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of the graph of `edges`: columns node, label (the least node of the component).

    Each round takes the least label of the neighbours, then the label of the label; it ends when nothing changes.
    Only partial minima meet at a hub, and each round's labels are a written table. Nulls and loops link nothing.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a != b")
    both = durable(pairs.union(pairs.select("b", "a")).distinct())
    before = labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label")))
    while True:
        heard = both.join(labels, both.a == labels.node).groupBy(F.col("b").alias("to")).agg(F.min("label").alias("heard"))
        step = labels.join(heard, F.col("node") == F.col("to"), "left").select("node", F.col("label").alias("was"), F.least("label", "heard").alias("label"))
        up = labels.select(F.col("node").alias("via"), F.col("label").alias("up"))
        after = durable(step.join(up, F.col("label") == F.col("via"), "left").select("node", F.least("label", "up").alias("label"), "was"))
        release(before)
        before, labels = after, after.select("node", "label")
        if after.where("label != was").isEmpty():
            release(both)
            return labels
