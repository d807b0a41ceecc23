"""Queries over graphs of dependencies that documents hold, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import lineage, manifest, run_results

from .encode import document, envelope, rows


def _named(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def _parents(links: DataFrame, block: Column) -> DataFrame:
    """Manifests with maps of parents: one for each block of links (child, parent)."""
    listed = links.groupBy(block.alias("block"), "child").agg(F.array_sort(F.collect_list("parent")).alias("ps"))
    return listed.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("child", "ps"))).alias("m")).select(*document(F.col("block"), metadata=envelope("manifest", 12), parent_map=F.col("m")))


def lineage_from_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What comes of a region and of a nation, and what an order comes from, over manifests of a thousand links each."""
    n, c, o = rows(spark, sf_dir, "nation"), rows(spark, sf_dir, "customer"), rows(spark, sf_dir, "orders")
    links = n.select(_named("n", "n_nationkey").alias("child"), _named("r", "n_regionkey").alias("parent"), F.lit(0).cast("long").alias("k"))
    links = links.union(c.select(_named("c", "c_custkey"), _named("n", "c_nationkey"), F.col("c_custkey"))).union(o.select(_named("o", "o_orderkey"), _named("c", "o_custkey"), F.col("o_orderkey")))
    edges = manifest.edges(_parents(links, F.concat(F.substring("child", 1, 1), F.floor(F.col("k") / 1000).cast("string")))).where("origin = 'parent_map'")
    down = lineage.reach(edges, spark.createDataFrame([("r1",), ("n3",), ("nothing",)], "node string"))
    up = lineage.reach(edges, spark.createDataFrame([("o5",)], "node string"), down=False, most=2)
    return down.unionByName(up).groupBy("start", "depth").agg(F.count("*").alias("n_nodes"), F.min("node").alias("least"))


LINEAGE_FROM_NODES = """WITH c AS (SELECT c_custkey k, c_nationkey n FROM customer), o AS (SELECT o_orderkey k, o_custkey c FROM orders),
d AS (SELECT 'r1' AS "start", 1 AS "depth", 'n' || n_nationkey node FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'r1', 2, 'c' || c.k FROM c JOIN nation ON n_nationkey = n WHERE n_regionkey = 1
  UNION ALL SELECT 'r1', 3, 'o' || o.k FROM o JOIN c ON c.k = o.c JOIN nation ON n_nationkey = n WHERE n_regionkey = 1
  UNION ALL SELECT 'n3', 1, 'c' || k FROM c WHERE n = 3 UNION ALL SELECT 'n3', 2, 'o' || o.k FROM o JOIN c ON c.k = o.c WHERE n = 3
  UNION ALL SELECT 'o5', 1, 'c' || c FROM o WHERE k = 5 UNION ALL SELECT 'o5', 2, 'n' || n FROM o JOIN c ON c.k = o.c WHERE o.k = 5)
SELECT "start", "depth", count(*) n_nodes, min(node) AS "least" FROM d GROUP BY ALL"""


def lineage_of_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains as long as a brand has parts, each followed from its first and its hundredth part in a few rounds."""
    p = rows(spark, sf_dir, "part")
    listed = p.groupBy("p_brand").agg(F.array_sort(F.collect_list("p_partkey")).alias("ks"))
    text = lambda x: F.concat(F.lit("p"), x)
    at = lambda i: F.get(F.col("ks"), i)
    pair = F.transform(F.sequence(F.lit(1), F.greatest(F.size("ks") - 1, F.lit(1))), lambda i: F.struct(text(at(i)).alias("child"), text(at(i - 1)).alias("parent"), F.floor(i / 1000).alias("k")))
    links = listed.where("size(ks) > 1").select("p_brand", F.inline(pair))
    edges = manifest.edges(_parents(links, F.concat_ws(" ", "p_brand", "k"))).where("origin = 'parent_map'").select(F.substring_index("artifact_id", " ", 1).alias("brand"), "parent", "child")
    starts = listed.select(F.col("p_brand").alias("brand"), F.explode(F.array_compact(F.array(text(at(F.lit(0))), text(at(F.lit(99)))))).alias("node"))
    got = lineage.reach(edges, starts, keys=("brand",), chains=True)
    return got.groupBy("brand", "start").agg(F.count("*").alias("n_nodes"), F.max("depth").alias("depth"), F.sum("depth").alias("total"))


LINEAGE_OF_CHAINS = """WITH p AS (SELECT split_part(p_brand, ' ', 1) brand, p_partkey k, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) i FROM part)
SELECT a.brand, 'p' || a.k AS "start", count(*) n_nodes, max(b.i - a.i)::INT AS "depth", sum(b.i - a.i)::BIGINT total FROM p a JOIN p b ON b.brand = a.brand AND b.i > a.i WHERE a.i IN (1, 100) GROUP BY ALL"""


def critical_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each order: each line waits for the line two before, and for the line before if that has over 25 pieces.

    How long the run takes at least, by its results' times, and which lines that hangs on.
    """
    line = rows(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("q"))
    listed = line.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "q"))).alias("ls"))
    name = lambda x: F.concat(F.lit("l"), x["l_linenumber"])
    result = F.transform("ls", lambda x: F.struct(name(x).alias("unique_id"), F.lit("success").alias("status"), x["q"].alias("execution_time")))
    waits = lambda x, y: ((x["l_linenumber"] - y["l_linenumber"]) == 2) | (((x["l_linenumber"] - y["l_linenumber"]) == 1) & (y["q"] > 25))
    parents = F.transform("ls", lambda x: F.struct(name(x).alias("k"), F.transform(F.filter("ls", lambda y: waits(x, y)), name).alias("v")))
    runs = listed.select(*document(F.col("l_orderkey"), metadata=envelope("run-results", 6), results=result))
    graphs = listed.select(*document(F.col("l_orderkey"), metadata=envelope("manifest", 12), parent_map=F.map_from_entries(parents)))
    edges = manifest.edges(graphs).where("origin = 'parent_map'")
    seconds = run_results.run_results(runs).select("artifact_id", F.col("unique_id").alias("node"), F.col("execution_time").alias("seconds"))
    got = lineage.finish_times(edges, seconds, keys=("artifact_id",))
    path = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("critical"), F.struct("begins", "node")))), lambda x: x["node"]), " ")
    return got.groupBy("artifact_id").agg(F.max("ends").alias("seconds"), F.sum("seconds").alias("work"), path.alias("path"))


CRITICAL_PATH = """WITH RECURSIVE l AS (SELECT l_orderkey r, l_linenumber n, sum(l_quantity) q FROM lineitem GROUP BY ALL),
e AS (SELECT a.r, a.n a, b.n b FROM l a JOIN l b ON b.r = a.r AND (b.n = a.n + 2 OR (b.n = a.n + 1 AND a.q > 25))),
p AS (SELECT r, n, q AS total, 'l' || n AS way FROM l UNION ALL SELECT p.r, l.n, p.total + l.q, p.way || ' l' || l.n FROM p JOIN e ON e.r = p.r AND e.a = p.n JOIN l ON l.r = e.r AND l.n = e.b),
t AS (SELECT r, n, max(total) ends FROM p GROUP BY ALL),
b AS (SELECT e.r, e.b n, arg_min('l' || e.a, (-t.ends, 'l' || e.a)) AS via FROM e JOIN t ON t.r = e.r AND t.n = e.a GROUP BY ALL),
w AS (SELECT r, arg_min('l' || n, (-ends, 'l' || n)) AS node, arg_min('l' || n, (-ends, 'l' || n)) AS way, 0 AS k FROM t GROUP BY r
  UNION ALL SELECT w.r, b.via, b.via || ' ' || w.way, w.k + 1 FROM w JOIN b ON b.r = w.r AND 'l' || b.n = w.node),
f AS (SELECT r, arg_max(way, k) AS "path" FROM w GROUP BY r)
SELECT r::VARCHAR artifact_id, max(t.ends) AS "seconds", sum(l.q) AS "work", any_value("path") AS "path" FROM t JOIN l USING (r, n) JOIN f USING (r) GROUP BY r"""

QUERIES = (lineage_from_nodes, lineage_of_chains, critical_path)
SQL = {f.__name__: globals()[f.__name__.upper()] for f in QUERIES}
