"""The queries of the artifact operators over the tables in a folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.detect import detect, outcomes, parse, parse_version, read
from lodestone.operators import catalog, checks, freshness, lineage, manifest, metadata, run_results, semantic, snapshot

from . import declared, graphs
from .encode import document, envelope, event_urls, node_map, order_runs, rows

_SHOWN = "coalesce(error, 'ok') outcome, count(*) n_docs"
_EVENTS = """e AS (SELECT event_id, ['manifest','catalog','run-results','sources'][event_id % 4 + 1] told,
  CASE WHEN event_id % 7 = 3 THEN '0' ELSE '' END || (event_id % 14)::VARCHAR num, event_id % 14 v,
  CASE event_id % 5 WHEN 1 THEN '.json?x' WHEN 2 THEN '.json' || chr(10) ELSE '.json' END tail,
  [12, 1, 6, 3][event_id % 4 + 1] top FROM events),
auto AS (SELECT *, CASE WHEN tail <> '.json' THEN 'Not a ' || told || '.json'
  WHEN v NOT BETWEEN 1 AND top THEN 'Unsupported ' || told || ' version: ' || v
  WHEN num <> v::VARCHAR THEN 'Not a ' || told || '.json v' || v END error FROM e)"""


def detect_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(event_urls(spark, sf_dir)).groupBy("kind", "version", F.coalesce("error", F.lit("ok")).alias("outcome")).agg(F.count("*").alias("n_docs"))


DETECT_VERSIONS = f"""WITH {_EVENTS} SELECT told kind, CASE WHEN error IS NULL THEN v END::INT AS "version", {_SHOWN} FROM auto GROUP BY ALL"""


def pinned_vs_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of every automatic and every pinned parser over all documents."""
    return outcomes(event_urls(spark, sf_dir)).groupBy("parser", F.coalesce("error", F.lit("ok")).alias("outcome")).agg(F.count("*").alias("n_docs"))


PINNED_VS_AUTO = f"""WITH {_EVENTS}, k AS (SELECT * FROM (VALUES ('manifest', 12), ('catalog', 1), ('run-results', 6), ('sources', 3)) t(kind, m)),
p AS (SELECT kind, unnest(range(1, m + 1)) n FROM k),
r AS (SELECT kind || ' auto' parser, CASE WHEN kind = told THEN error ELSE 'Not a ' || kind || '.json' END error FROM auto, k
  UNION ALL SELECT kind || ' v' || n, CASE WHEN kind = told AND num = n::VARCHAR THEN NULL ELSE 'Not a ' || kind || '.json v' || n END FROM auto, p)
SELECT parser, {_SHOWN} FROM r GROUP BY ALL"""


def entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every parser that the package offers says of all documents, and the newest version of its kind.

    Documents are read once; as parsers judge by the facts read alone, each sees the different facts, with how many documents have them.
    """
    import lodestone

    docs, said = read(event_urls(spark, sf_dir)).groupBy("facts").agg(F.count("*").alias("n")), []
    kinds = {"manifest": lodestone.manifest, "catalog": lodestone.catalog, "run-results": lodestone.run_results, "sources": lodestone.freshness}
    roots = (lodestone.parse_manifest, lodestone.parse_catalog, lodestone.parse_run_results, lodestone.parse_sources)
    for (kind, own), root in zip(kinds.items(), roots):
        parsers = {"auto": root, **{f"v{v}": getattr(own, f"parse_v{v}") for v in range(1, own.LATEST_VERSION + 1)}}
        for name, parser in parsers.items():
            row = F.struct(F.lit(f"{kind} {name}").alias("parser"), F.lit(own.LATEST_VERSION).alias("latest"), F.coalesce("error", F.lit("ok")).alias("outcome"), "version")
            said.append(f"said_{len(said)}")
            docs = parser(docs, known="facts").select("facts", "n", *said[:-1], row.alias(said[-1]))
    each = docs.select("n", F.inline(F.array(*said)))
    return each.groupBy("parser", "latest", "outcome").agg(F.sum("n").alias("n_docs"), F.sum(F.when(F.col("version").isNotNull(), F.col("n")).otherwise(0)).alias("n_versions"))


ENTRY_POINTS = f"""WITH {_EVENTS}, k AS (SELECT * FROM (VALUES ('manifest', 12), ('catalog', 1), ('run-results', 6), ('sources', 3)) t(kind, m)),
p AS (SELECT kind, m, unnest(range(1, m + 1)) n FROM k),
r AS (SELECT kind || ' auto' parser, m latest, CASE WHEN kind = told THEN error ELSE 'Not a ' || kind || '.json' END error FROM auto, k
  UNION ALL SELECT kind || ' v' || n, m, CASE WHEN kind = told AND num = n::VARCHAR THEN NULL ELSE 'Not a ' || kind || '.json v' || n END FROM auto, p)
SELECT parser, latest::INT latest, {_SHOWN}, count(*) FILTER (error IS NULL) n_versions FROM r GROUP BY ALL"""


def metadata_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.element_at(F.array(*[F.lit(x) for x in ('{}', '{"metadata":null}', '{"metadata":{"foo":"bar"}}', '{"metadata":{"dbt_schema_version":5}}', '{"metadata":[1]}', '{"metadata":{"dbt_schema_version":["/manifest/v1.json"]}}', '{"metadata":{"dbt_schema_version":""}}', "null", '{"meta', '{"metadata":{"dbt_schema_version":"x/manifest/v12.json"}}')]), (F.col("event_id") % 10 + 1).cast("int"))
    docs = rows(spark, sf_dir, "events").select("event_id", body.alias("body"))
    return parse(docs, "manifest").groupBy((F.col("event_id") % 10).alias("which"), F.coalesce("error", F.lit("ok")).alias("outcome")).agg(F.count("*").alias("n_docs"))


METADATA_GUARD = """SELECT event_id % 10 which, CASE event_id % 10 WHEN 9 THEN 'ok' WHEN 8 THEN 'Malformed JSON' ELSE 'Not a manifest.json' END outcome, count(*) n_docs FROM events GROUP BY ALL"""


def run_status_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = parse_version(order_runs(spark, sf_dir), "run-results", 6).where("error is null")
    return run_results.status_totals(run_results.run_results(docs))


RUN_STATUS_TOTALS = """SELECT CASE l_returnflag WHEN 'A' THEN 'success' WHEN 'N' THEN 'pass' ELSE 'error' END status, count(*) n_results,
round(sum(l_quantity), 2) total_time, sum(l_linenumber)::BIGINT n_failures FROM lineitem GROUP BY 1"""


def run_first_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first result of each document, its number of results and whether its status is a known one."""
    first = run_results.run_results(order_runs(spark, sf_dir), totals=True).where("pos = 0")
    known = F.col("status").isin("success", "pass", "fail", "warn", "skipped").alias("known")
    return first.select(F.col("artifact_id").cast("long").alias("artifact_id"), "unique_id", "message", known, F.col("n_results").cast("long").alias("n_results"))


RUN_FIRST_RESULTS = """WITH l AS (SELECT l_orderkey, l_linenumber, 'model.shop.p' || l_partkey unique_id, l_linestatus message, l_quantity,
CASE l_returnflag WHEN 'A' THEN 'success' WHEN 'N' THEN 'pass' ELSE 'error' END status FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, unique_id, status, l_quantity, message) n, count(*) OVER (PARTITION BY l_orderkey) n_results FROM l)
SELECT l_orderkey artifact_id, unique_id, message, status <> 'error' known, n_results FROM r WHERE n = 1"""


def union_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version 1 documents, with a number as message, and version 6 documents as one table."""
    o = rows(spark, sf_dir, "orders")
    one = lambda message: F.array(F.struct(F.lit("m").alias("unique_id"), F.lit("success").alias("status"), message.alias("message")))
    old = o.where("o_orderkey % 2 = 0").select(*document(F.col("o_orderkey"), metadata=envelope("run-results", 1), results=one(F.col("o_custkey"))))
    new = o.where("o_orderkey % 2 = 1").select(*document(F.col("o_orderkey"), metadata=envelope("run-results", 6), results=one(F.col("o_orderpriority"))))
    docs = parse(old.union(new), "run-results").where("error is null")
    return run_results.run_results(docs, keep=("version",)).groupBy("version", "message").agg(F.count("*").alias("n_results"))


UNION_VERSIONS = """SELECT CASE o_orderkey % 2 WHEN 0 THEN 1 ELSE 6 END AS "version", CASE o_orderkey % 2 WHEN 0 THEN o_custkey::VARCHAR ELSE o_orderpriority END message, count(*) n_results FROM orders GROUP BY ALL"""


def run_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = rows(spark, sf_dir, "events")
    at = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    timing = F.array(F.struct(F.lit("compile").alias("name"), at(F.col("ts")).alias("started_at"), at(F.col("ts") + F.expr("make_interval(0, 0, 0, 0, 0, 0, event_id % 90)")).alias("completed_at")), F.struct(F.lit("execute").alias("name"), at(F.col("ts")).alias("started_at"), F.lit("never").alias("completed_at")))
    docs = e.select(*document(F.col("event_id"), metadata=envelope("run-results", 6), results=F.array(F.struct(F.col("event_type").alias("unique_id"), timing.alias("timing")))))
    got = run_results.run_timings(docs)
    return got.groupBy("unique_id", "name").agg(F.count("*").alias("n_timings"), F.count("seconds").alias("n_ended"), F.sum(F.col("seconds").cast("long")).alias("total_seconds"))


RUN_TIMINGS = """SELECT event_type unique_id, name, count(*) n_timings, count(*) FILTER (name = 'compile') n_ended, (sum(event_id % 90) FILTER (name = 'compile'))::BIGINT total_seconds
FROM events, (VALUES ('compile'), ('execute')) t(name) GROUP BY ALL"""


def _catalogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = rows(spark, sf_dir, "part")
    column = lambda name, kind, i: F.struct(F.lit(kind).alias("type"), F.lit(i).alias("index"), F.lit(name).alias("name"))
    columns = F.create_map(F.lit("p_name"), column("p_name", "VARCHAR", 1), F.lit("p_size"), column("p_size", "INTEGER", 2))
    stat = lambda value: F.concat(F.lit('{"id":"s","label":"S","include":true,"value":'), value, F.lit("}"))
    stats = F.concat(F.lit('{"rows":'), stat(F.col("p_size").cast("string")), F.lit(',"has":'), stat(F.when(F.col("p_size") > 25, "true").otherwise("false")), F.lit(',"brand":'), stat(F.concat(F.lit('"'), F.col("p_brand"), F.lit('"'))), F.lit(',"none":'), stat(F.lit("null")), F.lit("}"))
    table = F.concat(F.lit('"model.shop.p'), F.col("p_partkey"), F.lit('":{"metadata":'), F.to_json(F.struct(F.lit("BASE TABLE").alias("type"), F.col("p_brand").alias("schema"), F.col("p_name").alias("name"))), F.lit(',"columns":'), F.to_json(columns), F.lit(',"stats":'), stats, F.lit("}"))
    # Several documents of one id, so that none grows with the table.
    got = p.groupBy("p_brand", F.floor(F.col("p_partkey") / 1000)).agg(F.array_join(F.collect_list(table), ",").alias("nodes"))
    return got.select(F.col("p_brand").alias("artifact_id"), F.concat(F.lit('{"metadata":'), F.to_json(envelope("catalog", 1)), F.lit(',"errors":null,"sources":{},"nodes":{'), F.col("nodes"), F.lit("}}")).alias("body"))


def catalog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = parse(_catalogs(spark, sf_dir), "catalog").where("error is null")
    return catalog.catalog_columns(docs).groupBy("artifact_id", "column", "type", "index").agg(F.count("*").alias("n_tables"))


CATALOG_COLUMNS = """SELECT p_brand artifact_id, c AS "column", t AS "type", i AS "index", count(*) n_tables FROM part, (VALUES ('p_name', 'VARCHAR', 1::BIGINT), ('p_size', 'INTEGER', 2)) x(c, t, i) GROUP BY ALL"""


def catalog_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = catalog.catalog_stats(_catalogs(spark, sf_dir))
    return got.groupBy("stat", "value").agg(F.count("*").alias("n_stats"), F.sum("number").cast("long").alias("total"))


CATALOG_STATS = """SELECT stat, CASE stat WHEN 'rows' THEN p_size::VARCHAR WHEN 'has' THEN (p_size > 25)::VARCHAR WHEN 'brand' THEN p_brand END AS "value", count(*) n_stats,
(sum(p_size) FILTER (stat = 'rows'))::BIGINT total FROM part, (VALUES ('rows'), ('has'), ('brand'), ('none')) x(stat) GROUP BY ALL"""


def _manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest for each order priority and month: a node for each order, in the forms of old and new versions."""
    o = rows(spark, sf_dir, "orders").withColumn("old", F.col("o_orderkey") % 2 == 0)
    name = F.concat(F.lit("c"), F.col("o_custkey"))
    q = lambda c: F.concat(F.lit('"'), c.cast("string"), F.lit('"'))
    refs = F.when(F.col("old"), F.concat(F.lit('[["pkg",'), q(name), F.lit("],["), q(name), F.lit("]]"))).otherwise(F.concat(F.lit('[{"name":'), q(name), F.lit(',"package":"pkg","version":2}]')))
    code = F.when(F.col("old"), F.lit('"raw_sql":"old","tags":"one"')).otherwise(F.lit('"raw_code":"new","tags":["one","two"]'))
    node = F.concat(q(F.concat(F.lit("model.shop.o"), F.col("o_orderkey"))), F.lit(':{"resource_type":"model","name":"o","config":{"materialized":'), q(F.col("o_orderstatus")), F.lit('},"refs":'), refs, F.lit(","), code, F.lit(',"depends_on":{"nodes":['), q(F.concat(F.lit("source.shop."), name)), F.lit("]}}"))
    off = F.concat(q(F.concat(F.lit("off."), F.col("o_custkey"), F.lit("."), F.col("o_orderkey"))), F.lit(':[{"resource_type":"model","name":"a"},{"resource_type":'), F.when(F.col("old"), F.lit('"test"')).otherwise(F.lit('"seed"')), F.lit(',"name":"b"}]'))
    got = o.groupBy("o_orderpriority", F.date_trunc("month", "o_orderdate").alias("month")).agg(F.array_join(F.collect_list(node), ",").alias("nodes"), F.array_join(F.collect_list(off), ",").alias("off"))
    body = F.concat(F.lit('{"metadata":'), F.to_json(envelope("manifest", 12)), F.lit(',"nodes":{'), F.col("nodes"), F.lit('},"disabled":{'), F.col("off"), F.lit("}}"))
    return got.select(F.concat_ws(" ", "o_orderpriority", F.col("month").cast("string")).alias("artifact_id"), body.alias("body"))


def manifest_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = parse(_manifests(spark, sf_dir), "manifest").where("error is null")
    return manifest.nodes(docs).groupBy("resource_type", "config_materialized", "raw_code", F.array_join("tags", ",").alias("tags")).agg(F.count("*").alias("n_nodes"), F.count_distinct("artifact_id").alias("n_docs"))


MANIFEST_NODES = """SELECT 'model' resource_type, o_orderstatus config_materialized, CASE o_orderkey % 2 WHEN 0 THEN 'old' ELSE 'new' END raw_code, CASE o_orderkey % 2 WHEN 0 THEN 'one' ELSE 'one,two' END tags,
count(*) n_nodes, count(DISTINCT o_orderpriority || date_trunc('month', o_orderdate)) n_docs FROM orders GROUP BY ALL"""


def node_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as nodes: those found by id, and how many keys each document has."""
    n = rows(spark, sf_dir, "nation")
    node = F.struct(F.lit("model").alias("resource_type"), F.col("n_name").alias("name"))
    docs = n.groupBy("n_regionkey").agg(node_map(F.concat(F.lit("model.shop.n"), F.col("n_nationkey")), node).alias("m")).select(*document(F.col("n_regionkey"), metadata=envelope("manifest", 12), nodes=F.col("m")))
    got = manifest.nodes(docs)
    counts = got.groupBy("artifact_id").agg(F.count("*").alias("n_keys"))
    return got.where(F.col("unique_id").isin("model.shop.n3", "model.shop.n17")).join(counts, "artifact_id").select("artifact_id", "unique_id", "resource_type", "name", "n_keys")


NODE_LOOKUP = """SELECT n_regionkey::VARCHAR artifact_id, 'model.shop.n' || n_nationkey unique_id, 'model' resource_type, n_name AS "name", (SELECT count(*) FROM nation m WHERE m.n_regionkey = n.n_regionkey) n_keys FROM nation n WHERE n_nationkey IN (3, 17)"""


def node_refs_both_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.node_refs(_manifests(spark, sf_dir)).groupBy("name", "package", "version").agg(F.count("*").alias("n_refs"))


NODE_REFS_BOTH_FORMS = """WITH r AS (SELECT 'c' || o_custkey AS "name", 'pkg' package, CASE o_orderkey % 2 WHEN 1 THEN '2' END AS "version" FROM orders
UNION ALL SELECT 'c' || o_custkey, NULL, NULL FROM orders WHERE o_orderkey % 2 = 0) SELECT "name", package, "version", count(*) n_refs FROM r GROUP BY ALL"""


def disabled_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.disabled(_manifests(spark, sf_dir)).groupBy("pos", "resource_type", "name").agg(F.count("*").alias("n_nodes"))


DISABLED_NODES = """SELECT 0 AS pos, 'model' resource_type, 'a' AS "name", count(*) n_nodes FROM orders UNION ALL SELECT 1, CASE o_orderkey % 2 WHEN 0 THEN 'test' ELSE 'seed' END, 'b', count(*) FROM orders GROUP BY ALL"""


def manifest_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.edges(_manifests(spark, sf_dir)).groupBy("parent", "origin").agg(F.count("*").alias("n_children"))


MANIFEST_EDGES = """SELECT 'source.shop.c' || o_custkey parent, 'depends_on' origin, count(*) n_children FROM orders GROUP BY ALL"""


def lineage_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and customers as a map of parents: descendants of each region and nation by distance."""
    n, c = rows(spark, sf_dir, "nation"), rows(spark, sf_dir, "customer")
    links = n.select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("child"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("parent"), F.lit(0).cast("long").alias("block")).union(c.select(F.concat(F.lit("c"), F.col("c_custkey")), F.concat(F.lit("n"), F.col("c_nationkey")), F.floor(F.col("c_custkey") / 1000)))
    docs = links.groupBy("parent", "block").agg(F.map_from_entries(F.collect_list(F.struct("child", F.array("parent")))).alias("m")).select(*document(F.col("parent"), metadata=envelope("manifest", 12), parent_map=F.col("m")))
    got = lineage.closure(manifest.edges(docs).where("origin = 'parent_map'"))
    return got.groupBy("ancestor", "depth").agg(F.count("*").alias("n_nodes"))


LINEAGE_CLOSURE = """SELECT 'r' || n_regionkey ancestor, 1 AS depth, count(*) n_nodes FROM nation GROUP BY ALL
UNION ALL SELECT 'n' || c_nationkey, 1, count(*) FROM customer GROUP BY ALL UNION ALL SELECT 'r' || n_regionkey, 2, count(*) FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL"""


def freshness_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long before the newest event of all each user had one, judged by limits of 12 hours and 2 days."""
    e = rows(spark, sf_dir, "events")
    end = e.agg(F.max(F.col("ts").cast("timestamp")).alias("end"))
    last = e.groupBy("user_id").agg(F.max(F.col("ts").cast("timestamp")).alias("ts")).join(F.broadcast(end))  # end is one row
    ago = (F.unix_seconds("end") - F.unix_seconds("ts")).cast("double")
    limit = lambda n, p: F.struct(F.lit(n).alias("count"), F.lit(p).alias("period"))
    ok = F.struct(F.concat(F.lit("source.u"), F.col("user_id")).alias("unique_id"), F.lit("pass").alias("status"), ago.alias("max_loaded_at_time_ago_in_s"), F.struct(limit(12, "hour").alias("warn_after"), limit(2, "day").alias("error_after")).alias("criteria"), F.lit(None).cast("string").alias("error"))
    bad = F.struct(F.concat(F.lit("source.x"), F.col("user_id")).alias("unique_id"), F.lit("runtime error").alias("status"), F.lit(None).cast("double").alias("max_loaded_at_time_ago_in_s"), F.lit(None).cast("struct<warn_after:struct<count:int,period:string>,error_after:struct<count:int,period:string>>").alias("criteria"), F.lit("lost").alias("error"))
    docs = parse(last.select(*document(F.col("user_id"), metadata=envelope("sources", 3), elapsed_time=F.lit(1.0), results=F.array(ok, bad))), "sources").where("error is null")
    got = freshness.freshness(docs)
    status = F.when(F.col("status") == "runtime error", F.col("status")).otherwise(freshness.freshness_status(F.col("ago_s"), F.col("criteria")))
    return got.groupBy(status.alias("status"), "error").agg(F.count("*").alias("n_sources"))


FRESHNESS_STATUS = """WITH l AS (SELECT user_id, max(ts) ts FROM events GROUP BY 1), a AS (SELECT epoch(date_trunc('second', (SELECT max(ts) FROM events))) - epoch(date_trunc('second', ts)) s FROM l)
SELECT CASE WHEN s > 172800 THEN 'error' WHEN s > 43200 THEN 'warn' ELSE 'pass' END status, NULL::VARCHAR error, count(*) n_sources FROM a GROUP BY 1
UNION ALL SELECT 'runtime error', 'lost', count(*) FROM l"""


def generic_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = rows(spark, sf_dir, "orders"), rows(spark, sf_dir, "customer")
    out = [
        checks.summary("unique_orders_o_orderkey", checks.unique(o, "o_orderkey")),
        checks.summary("unique_orders_o_custkey", checks.unique(o, "o_custkey"), severity="warn"),
        checks.summary("not_null_orders_o_custkey", checks.not_null(o, "o_custkey")),
        checks.summary("accepted_values_orders_o_orderstatus", checks.accepted_values(o, "o_orderstatus", ["F", "O"]), warn_if="> 0", error_if="> 10", fail_calc="sum(n_records)"),
        checks.summary("relationships_orders_customer", checks.relationships(o, "o_custkey", c, "c_custkey")),
        checks.summary("relationships_customer_orders", checks.relationships(c, "c_custkey", o, "o_custkey")),
    ]
    whole = out[0]
    for x in out[1:]:
        whole = whole.union(x)
    return whole


GENERIC_TESTS = """WITH f AS (
SELECT 'unique_orders_o_orderkey' test_name, (SELECT count(*) FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1)) failures
UNION ALL SELECT 'unique_orders_o_custkey', (SELECT count(*) FROM (SELECT 1 FROM orders GROUP BY o_custkey HAVING count(*) > 1))
UNION ALL SELECT 'not_null_orders_o_custkey', (SELECT count(*) FROM orders WHERE o_custkey IS NULL)
UNION ALL SELECT 'accepted_values_orders_o_orderstatus', (SELECT count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O'))
UNION ALL SELECT 'relationships_orders_customer', (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))
UNION ALL SELECT 'relationships_customer_orders', (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)))
SELECT test_name, failures, CASE WHEN test_name LIKE 'acc%' THEN CASE WHEN failures > 10 THEN 'fail' WHEN failures > 0 THEN 'warn' ELSE 'pass' END
WHEN failures = 0 THEN 'pass' WHEN test_name = 'unique_orders_o_custkey' THEN 'warn' ELSE 'fail' END status FROM f"""


def measure_aggs(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = {"s_sum": ("sum", "l_quantity", {}), "s_min": ("min", "l_extendedprice", {}), "s_max": ("max", "l_extendedprice", {}), "s_count": ("count", "l_orderkey", {}), "s_distinct": ("count_distinct", "l_partkey", {}), "s_bool": ("sum_boolean", "l_discount > 0.05", {}), "s_avg": ("average", "l_quantity", {}), "s_median": ("median", "l_extendedprice", {}), "s_cont": ("percentile", "l_extendedprice", {"percentile": 0.9}), "s_disc": ("percentile", "l_extendedprice", {"percentile": 0.9, "discrete": True})}
    got = semantic.measures(rows(spark, sf_dir, "lineitem"), ["l_returnflag"], wanted)
    return got.select("l_returnflag", *[F.round(c, 4).alias(c) if c in ("s_sum", "s_avg", "s_median", "s_cont") else F.col(c) for c in wanted])


MEASURE_AGGS = """SELECT l_returnflag, round(sum(l_quantity), 4) s_sum, min(l_extendedprice) s_min, max(l_extendedprice) s_max, count(l_orderkey) s_count, count(DISTINCT l_partkey) s_distinct,
(count(*) FILTER (l_discount > 0.05))::BIGINT s_bool, round(avg(l_quantity), 4) s_avg, round(median(l_extendedprice), 4) s_median, round(quantile_cont(l_extendedprice, 0.9), 4) s_cont, quantile_disc(l_extendedprice, 0.9) s_disc
FROM lineitem GROUP BY l_returnflag"""


def metric_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = rows(spark, sf_dir, "orders")
    finished = F.count_if(F.col("o_orderstatus") == "F")
    got = semantic.ratio(o, "finished_share", finished, F.count("*"), [semantic.grain(F.col("o_orderdate"), "month").alias("month")])
    return got.select(F.date_format("month", "yyyy-MM").alias("month"), F.round("finished_share", 6).alias("finished_share"))


METRIC_RATIO = """SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m') AS "month", round((count(*) FILTER (o_orderstatus = 'F')) / count(*), 6) finished_share FROM orders GROUP BY 1"""


def metric_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = semantic.simple(rows(spark, sf_dir, "orders"), "n_orders", "count", "o_orderkey", [semantic.grain(F.col("o_orderdate"), "month").alias("month")], ["o_totalprice > 1000"])
    every = semantic.filled(totals, "month", "n_orders", "month")
    got = semantic.cumulative(semantic.cumulative(every, "so_far", "n_orders", "month"), "in_year", "n_orders", "month", grain_to_date="year")
    return got.select(F.date_format("month", "yyyy-MM").alias("month"), *[F.col(c).cast("long").alias(c) for c in ("n_orders", "so_far", "in_year")])


METRIC_CUMULATIVE = """WITH t AS (SELECT date_trunc('month', o_orderdate) m, count(*) n FROM orders WHERE o_totalprice > 1000 GROUP BY 1),
s AS (SELECT unnest(generate_series((SELECT min(m) FROM t)::TIMESTAMP, (SELECT max(m) FROM t)::TIMESTAMP, INTERVAL 1 MONTH)) m), f AS (SELECT s.m, coalesce(n, 0) n FROM s LEFT JOIN t ON s.m = t.m)
SELECT strftime(m, '%Y-%m') AS "month", n::BIGINT n_orders, (sum(n) OVER (ORDER BY m))::BIGINT so_far, (sum(n) OVER (PARTITION BY year(m) ORDER BY m))::BIGINT in_year FROM f"""


def saved_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = rows(spark, sf_dir, "orders")
    got = semantic.saved_query(o, {"revenue": F.sum(F.col("o_totalprice").cast("decimal(18,2)")), "n_orders": F.count("*")}, [F.col("o_custkey")], ["o_totalprice > 100", "o_orderstatus <> 'P'"], [F.desc("revenue"), F.asc("o_custkey")], 20)
    return got.select("o_custkey", F.col("revenue").cast("double").alias("revenue"), "n_orders")


SAVED_QUERY = """SELECT o_custkey, sum(o_totalprice::DECIMAL(18,2))::DOUBLE revenue, count(*) n_orders FROM orders WHERE o_totalprice > 100 AND o_orderstatus <> 'P' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"""

def artifact_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by invocation: one run-results document for each order, several of one invocation."""
    o = rows(spark, sf_dir, "orders")
    told = F.struct(F.lit("x/run-results/v6.json").alias("dbt_schema_version"), F.lit("1.11.0").alias("dbt_version"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("generated_at"), F.concat(F.lit("run"), F.col("o_custkey")).alias("invocation_id"), F.create_map(F.lit("TIER"), F.col("o_orderpriority")).alias("env"), F.when(F.col("o_orderkey") % 2 == 0, "spark").alias("adapter_type"))
    got = metadata.metadata_table(o.select(*document(F.col("o_orderkey"), metadata=told)))
    return got.groupBy("invocation_id", "dbt_version").agg(F.count("*").alias("n_docs"), F.count("adapter_type").alias("n_adapters"), F.count_distinct(F.col("env")["TIER"]).alias("n_tiers"), F.date_format(F.max("generated_ts"), "yyyy-MM-dd").alias("newest"))


ARTIFACT_METADATA = """SELECT 'run' || o_custkey invocation_id, '1.11.0' dbt_version, count(*) n_docs, count(*) FILTER (o_orderkey % 2 = 0) n_adapters, count(DISTINCT o_orderpriority) n_tiers, strftime(max(o_orderdate), '%Y-%m-%d') newest FROM orders GROUP BY 1"""


def entry_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first key of each document and its value, and the number of keys."""
    n = rows(spark, sf_dir, "nation")
    node = F.concat(F.lit('"n'), F.col("n_nationkey"), F.lit('":{"name":"'), F.col("n_name"), F.lit('"}'))
    listed = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct((-F.col("n_nationkey")).alias("k"), node.alias("j")))).alias("l"))
    docs = listed.select(F.col("n_regionkey").cast("string").alias("artifact_id"), F.concat(F.lit('{"nodes":{'), F.array_join(F.col("l.j"), ","), F.lit("}}")).alias("body"))
    got = manifest.entries(docs, "nodes")
    return got.groupBy("artifact_id").agg(F.min_by("unique_id", "pos").alias("first_key"), F.min_by(F.try_variant_get("value", "$.name", "string"), "pos").alias("first_name"), F.count("*").alias("n_keys"))


ENTRY_POSITIONS = """SELECT n_regionkey::VARCHAR artifact_id, 'n' || max(n_nationkey) first_key, arg_max(n_name, n_nationkey) first_name, count(*) n_keys FROM nation GROUP BY n_regionkey"""


def container_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the root keys of one document for each order hold."""
    o = rows(spark, sf_dir, "orders")
    odd = F.when(F.col("o_orderkey") % 3 == 0, F.lit("null")).when(F.col("o_orderkey") % 3 == 1, F.lit('"text"')).otherwise(F.lit("[1]"))
    docs = o.select(F.col("o_orderkey").cast("string").alias("artifact_id"), F.concat(F.lit('{"nodes":{"a":1},"results":[],"odd":'), odd, F.lit("}")).alias("body"))
    return manifest.containers(docs).groupBy("key", "container").agg(F.count("*").alias("n_docs"))


CONTAINER_KINDS = """SELECT 'nodes' AS "key", 'object' container, count(*) n_docs FROM orders UNION ALL SELECT 'results', 'array', count(*) FROM orders
UNION ALL SELECT 'odd', ['null', 'value', 'array'][o_orderkey % 3 + 1], count(*) FROM orders GROUP BY ALL"""


def _models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest for each hundred parts: models with a contract, constraints, an incremental configuration and unit tests."""
    p = rows(spark, sf_dir, "part")
    q = lambda c: F.concat(F.lit('"'), c.cast("string"), F.lit('"'))
    even = F.col("p_partkey") % 2 == 0
    key = F.when(even, q(F.lit("id"))).otherwise(F.lit('["id","day"]'))
    model = F.concat(q(F.concat(F.lit("model.p"), F.col("p_partkey"))), F.lit(':{"resource_type":"model","contract":{"enforced":'), F.when(even, F.lit("true")).otherwise(F.lit("false")), F.lit('},"config":{"materialized":"incremental","incremental_strategy":'), F.when(even, q(F.lit("merge"))).otherwise(q(F.lit("append"))), F.lit(',"on_schema_change":"fail","unique_key":'), key, F.lit(',"freshness":{"build_after":{"count":'), F.col("p_size").cast("string"), F.lit(',"period":"hour"}}},"constraints":[{"type":"primary_key","columns":["id"]}],"columns":{"id":{"name":"id","constraints":[{"type":"not_null"},{"type":"check","expression":"id > 0"}]},"day":{"name":"day"}}}'))
    test = F.concat(q(F.concat(F.lit("unit_test.p"), F.col("p_partkey"))), F.lit(':{"model":"m","given":[{"input":"ref(a)","rows":[{"id":'), F.col("p_size").cast("string"), F.lit('}]},{"input":"ref(b)","format":"csv","rows":"id"}],"expect":{"rows":[]}}'))
    got = p.groupBy(F.floor(F.col("p_partkey") / 100).alias("block")).agg(F.array_join(F.collect_list(model), ",").alias("nodes"), F.array_join(F.collect_list(test), ",").alias("tests"))
    return got.select(F.col("block").cast("string").alias("artifact_id"), F.concat(F.lit('{"nodes":{'), F.col("nodes"), F.lit('},"unit_tests":{'), F.col("tests"), F.lit("}}")).alias("body"))


def node_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = manifest.nodes(_models(spark, sf_dir))
    return got.groupBy("config_incremental_strategy", "config_on_schema_change", F.array_join("config_unique_key", ",").alias("unique_key"), "contract_enforced").agg(F.count("*").alias("n_nodes"), F.sum("config_freshness_build_after_count").alias("build_after"))


NODE_CONFIG = """SELECT CASE p_partkey % 2 WHEN 0 THEN 'merge' ELSE 'append' END config_incremental_strategy, 'fail' config_on_schema_change, CASE p_partkey % 2 WHEN 0 THEN 'id' ELSE 'id,day' END unique_key,
p_partkey % 2 = 0 contract_enforced, count(*) n_nodes, sum(p_size)::BIGINT build_after FROM part GROUP BY ALL"""


def node_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.constraints(_models(spark, sf_dir)).groupBy("enforced", "column", "type", "expression", F.array_join("columns", ",").alias("columns")).agg(F.count("*").alias("n_constraints"))


NODE_CONSTRAINTS = """SELECT p_partkey % 2 = 0 enforced, c AS "column", t AS "type", e AS "expression", l AS "columns", count(*) n_constraints
FROM part, (VALUES (NULL, 'primary_key', NULL, 'id'), ('id', 'not_null', NULL, NULL), ('id', 'check', 'id > 0', NULL)) x(c, t, e, l) GROUP BY ALL"""


def unit_test_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = manifest.unit_test_rows(_models(spark, sf_dir))
    return got.groupBy("part", "pos", "input", "format").agg(F.count("*").alias("n_parts"), F.sum(F.try_variant_get("rows", "$[0].id", "long")).alias("total"))


UNIT_TEST_PARTS = """SELECT 'given' part, 0 AS pos, 'ref(a)' AS "input", NULL::VARCHAR AS "format", count(*) n_parts, sum(p_size)::BIGINT total FROM part
UNION ALL SELECT 'given', 1, 'ref(b)', 'csv', count(*), NULL FROM part UNION ALL SELECT 'expect', 0, NULL, NULL, count(*), NULL FROM part"""


def unit_test_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by nation as a model, against those that are expected if one nation is left out and another counted twice."""
    c = rows(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment")
    expected = c.where("c_nationkey <> 3").union(c.where("c_nationkey = 7"))
    return checks.differences(c, expected).groupBy("side", "c_nationkey").agg(F.count("*").alias("n_rows"))


UNIT_TEST_DIFFERENCES = """SELECT 'actual' side, c_nationkey, count(*) n_rows FROM customer WHERE c_nationkey = 3 GROUP BY ALL UNION ALL SELECT 'expected', c_nationkey, count(*) FROM customer WHERE c_nationkey = 7 GROUP BY ALL"""


def snapshot_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers seen twice: some balances change, some customers are gone, others new."""
    c = rows(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    before = snapshot.start(c.where("c_custkey % 10 <> 1"), F.lit("2024-01-01"))
    after = c.where("c_custkey % 10 <> 2").withColumn("c_acctbal", F.when(F.col("c_custkey") % 10 == 3, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    got = snapshot.snapshot(before, after, "c_custkey", F.lit("2024-02-01"), close_missing=True)
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return got.groupBy((F.col("c_custkey") % 10).alias("digit"), day("valid_from").alias("valid_from"), day("valid_to").alias("valid_to")).agg(F.count("*").alias("n_rows"))


SNAPSHOT_HISTORY = """WITH c AS (SELECT c_custkey % 10 digit FROM customer)
SELECT digit, CASE digit WHEN 1 THEN '2024-02-01' ELSE '2024-01-01' END valid_from, CASE WHEN digit IN (2, 3) THEN '2024-02-01' END valid_to, count(*) n_rows FROM c GROUP BY ALL
UNION ALL SELECT digit, '2024-02-01', NULL, count(*) FROM c WHERE digit = 3 GROUP BY ALL"""


def tests_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = rows(spark, sf_dir, "orders")
    return checks.summary("unique_custkey_open", checks.unique(o, "o_custkey", where="o_orderstatus = 'O'")).union(checks.summary("accepted_priority_dear", checks.accepted_values(o, "o_orderpriority", ["1-URGENT"], where="o_totalprice > 200000"), severity="warn"))


TESTS_WHERE = """WITH f AS (SELECT 'unique_custkey_open' test_name, (SELECT count(*) FROM (SELECT 1 FROM orders WHERE o_orderstatus = 'O' AND o_custkey IS NOT NULL GROUP BY o_custkey HAVING count(*) > 1)) failures
UNION ALL SELECT 'accepted_priority_dear', (SELECT count(DISTINCT o_orderpriority) FROM orders WHERE o_totalprice > 200000 AND o_orderpriority <> '1-URGENT'))
SELECT test_name, failures, CASE WHEN failures = 0 THEN 'pass' WHEN test_name LIKE 'acc%' THEN 'warn' ELSE 'fail' END status FROM f"""


def metric_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by month against the month before and against the first month of the year."""
    totals = semantic.simple(rows(spark, sf_dir, "orders"), "n", "count", "o_orderkey", [semantic.grain(F.col("o_orderdate"), "month").alias("month"), F.col("o_orderstatus")])
    got = semantic.derived(totals, "growth", "n - before", "month", {"before": ("n", "1 month", None), "opening": ("n", None, "year")}, ["o_orderstatus"])
    return got.select(F.date_format("month", "yyyy-MM").alias("month"), "o_orderstatus", "n", "before", "opening", "growth")


METRIC_DERIVED = """WITH t AS (SELECT date_trunc('month', o_orderdate)::TIMESTAMP m, o_orderstatus, count(*) n FROM orders GROUP BY ALL)
SELECT strftime(t.m, '%Y-%m') AS "month", t.o_orderstatus, t.n, b.n AS "before", o.n opening, t.n - b.n growth FROM t
LEFT JOIN t b ON b.o_orderstatus = t.o_orderstatus AND b.m + INTERVAL 1 MONTH = t.m LEFT JOIN t o ON o.o_orderstatus = t.o_orderstatus AND o.m = date_trunc('year', t.m)"""


def metric_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases that follow a view of the same user within seven days."""
    e = rows(spark, sf_dir, "events")
    got = semantic.conversion(e.where("event_type = 'view'"), e.where("event_type = 'purchase'"), "conversions", "user_id", "ts", "7 days")
    return got.select("n_base", "conversions", F.round("conversions_rate", 6).alias("rate"))


METRIC_CONVERSION = """WITH b AS (SELECT user_id, ts FROM events WHERE event_type = 'view'), c AS (SELECT user_id, ts FROM events WHERE event_type = 'purchase'),
m AS (SELECT c.user_id, c.ts, b.ts last FROM c ASOF JOIN b ON b.user_id = c.user_id AND b.ts <= c.ts),
n AS (SELECT (SELECT count(*) FROM b) n_base, (SELECT count(*) FROM m WHERE ts <= last + INTERVAL 7 DAY) conversions)
SELECT n_base, conversions, round(conversions / n_base, 6) rate FROM n"""


def metric_non_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What customers paid on the last day on which they ordered, by status."""
    o = rows(spark, sf_dir, "orders").withColumn("day", F.date_trunc("day", "o_orderdate"))
    return semantic.simple(semantic.non_additive(o, "day", "max", ["o_custkey"]), "n_orders", "count", "o_orderkey", [F.col("o_orderstatus")])


METRIC_NON_ADDITIVE = """WITH o AS (SELECT *, date_trunc('day', o_orderdate) d, max(date_trunc('day', o_orderdate)) OVER (PARTITION BY o_custkey) top FROM orders) SELECT o_orderstatus, count(*) n_orders FROM o WHERE d = top GROUP BY 1"""


def lineage_by_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of two to six steps, one document for each nation, all documents using the same node names: no path leaves a document."""
    c = rows(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    step = F.transform(F.sequence(F.lit(1), F.lit(2) + F.col("k") % 5), lambda i: F.struct(F.concat(F.lit("n"), i).alias("k"), F.array(F.concat(F.lit("n"), i - 1)).alias("v")))
    docs = c.select(*document(F.col("k"), metadata=envelope("manifest", 12), parent_map=F.map_from_entries(step)))
    got = lineage.closure(manifest.edges(docs), keys=("artifact_id",))
    return got.groupBy("artifact_id").agg(F.count("*").alias("n_pairs"), F.max("depth").alias("depth"))


LINEAGE_BY_ARTIFACT = """SELECT n_nationkey::VARCHAR artifact_id, ((2 + n_nationkey % 5) * (3 + n_nationkey % 5) / 2)::BIGINT n_pairs, 2 + n_nationkey % 5 AS depth FROM nation"""


_QUERIES = (detect_versions, pinned_vs_auto, entry_points, metadata_guard, run_status_totals, run_first_results, union_versions, run_timings, catalog_columns, catalog_stats, manifest_nodes, node_lookup, node_refs_both_forms, disabled_nodes, manifest_edges, lineage_closure, freshness_status, generic_tests, measure_aggs, metric_ratio, metric_cumulative, saved_query, artifact_metadata, entry_positions, container_kinds, node_config, node_constraints, unit_test_parts, unit_test_differences, snapshot_history, tests_where, metric_derived, metric_conversion, metric_non_additive, lineage_by_artifact)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (*_QUERIES, *declared.QUERIES, *graphs.QUERIES)}


def oracle_sql() -> dict[str, str]:
    return {f.__name__: globals()[f.__name__.upper()] for f in _QUERIES} | declared.SQL | graphs.SQL
