"""Queries over what a manifest declares: metrics, tests, constraints and unit tests of the tables in a folder, and their SQL."""

from __future__ import annotations

import json
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import declared, metrics, snapshot
from lodestone.operators.validity import valid_at

from .encode import URL, rows


def _time(name: str, expr: str, grain: str = "day") -> dict:
    return {"name": name, "type": "time", "expr": expr, "type_params": {"time_granularity": grain}}


def _entity(name: str, kind: str, expr: str) -> dict:
    return {"name": name, "type": kind, "expr": expr}


def _label(name: str, expr: str) -> dict:
    return {"name": name, "type": "categorical", "expr": expr}


def _model(name: str, entities: list, dimensions: list, measures: list = (), time: str | None = None) -> dict:
    return {"name": name, "node_relation": {"alias": name, "schema_name": "shop"}, "defaults": {"agg_time_dimension": time}, "entities": entities, "dimensions": dimensions, "measures": list(measures)}


def _only(*filters: str) -> dict:
    return {"where_filters": [{"where_sql_template": f} for f in filters]}


#: The semantic layer of the tables in a folder.
MODELS = [
    _model(
        "orders",
        [_entity("order", "primary", "o_orderkey"), _entity("customer", "foreign", "o_custkey")],
        [_time("ordered_at", "o_orderdate"), _label("status", "o_orderstatus"), _label("priority", "o_orderpriority")],
        [{"name": "revenue", "agg": "sum", "expr": "o_totalprice"}, {"name": "n_orders", "agg": "count", "expr": "o_orderkey"}, {"name": "customers", "agg": "count_distinct", "expr": "o_custkey"}, {"name": "dearest", "agg": "max", "expr": "o_totalprice"}],
        "ordered_at",
    ),
    _model("customer", [_entity("customer", "primary", "c_custkey"), _entity("nation", "foreign", "c_nationkey")], [_label("segment", "c_mktsegment")], [{"name": "n_customers", "agg": "count", "expr": "c_custkey"}]),
    _model("nation", [_entity("nation", "primary", "n_nationkey"), _entity("region", "foreign", "n_regionkey")], [_label("name", "n_name")]),
    _model("region", [_entity("region", "primary", "r_regionkey")], [_label("name", "r_name")]),
    _model("views", [_entity("event", "primary", "event_id"), _entity("user", "foreign", "user_id")], [_time("at", "ts", "second"), _label("even", "event_id % 2 = 0")], [{"name": "n_views", "agg": "count", "expr": "event_id"}], "at"),
    _model("purchases", [_entity("event", "primary", "event_id"), _entity("user", "foreign", "user_id")], [_time("at", "ts", "second"), _label("even", "event_id % 2 = 0")], [{"name": "n_purchases", "agg": "count", "expr": "event_id"}], "at"),
]


def _metric(name: str, kind: str, filter_: dict | None = None, **params) -> dict:
    return {"name": name, "type": kind, "type_params": params, "filter": filter_}


METRICS = [
    _metric("revenue", "simple", measure={"name": "revenue"}),
    _metric("orders", "simple", measure={"name": "n_orders", "fill_nulls_with": 0}),
    _metric("urgent_orders", "simple", _only("{{ Dimension('order__priority') }} = '1-URGENT'"), measure={"name": "n_orders"}),
    _metric("urgent_share", "ratio", numerator={"name": "urgent_orders"}, denominator={"name": "orders"}),
    _metric("finished_revenue_share", "ratio", numerator={"name": "revenue", "filter": _only("{{ Dimension('order__status') }} = 'F'")}, denominator={"name": "revenue"}),
    _metric("urgent_share_growth", "derived", expr="urgent_share - before", metrics=[{"name": "urgent_share"}, {"name": "urgent_share", "alias": "before", "offset_window": {"count": 1, "granularity": "month"}}]),
    _metric("orders_since_opening", "derived", expr="orders - opening", metrics=[{"name": "orders"}, {"name": "orders", "alias": "opening", "offset_to_grain": "year"}]),
    _metric("revenue_of_three_months", "cumulative", measure={"name": "revenue"}, cumulative_type_params={"window": {"count": 3, "granularity": "month"}, "period_agg": "last"}),
    _metric("orders_in_year", "cumulative", measure={"name": "n_orders"}, cumulative_type_params={"grain_to_date": "year", "period_agg": "average"}),
    _metric("dearest_so_far", "cumulative", measure={"name": "dearest"}),
    _metric("customers_so_far", "cumulative", measure={"name": "customers"}, cumulative_type_params={"period_agg": "last"}),
    _metric("customers_of_thirty_days", "cumulative", measure={"name": "customers"}, cumulative_type_params={"window": {"count": 30, "granularity": "days"}, "period_agg": "last"}),
    _metric("purchase_rate", "conversion", conversion_type_params={"entity": "user", "base_measure": {"name": "n_views"}, "conversion_measure": {"name": "n_purchases"}, "window": {"count": 2, "granularity": "days"}, "constant_properties": [{"base_property": "event__even", "conversion_property": "event__even"}]}),
    _metric("purchases_after_view", "conversion", conversion_type_params={"entity": "user", "base_measure": {"name": "n_views"}, "conversion_measure": {"name": "n_purchases"}, "calculation": "conversions"}),
]

SAVED = [
    {
        "name": "busy_segments",
        "query_params": {
            "metrics": ["orders", "urgent_share"],
            "group_by": ["TimeDimension('metric_time', 'year')", "Dimension('customer__segment')"],
            "where": _only("{{ TimeDimension('metric_time', 'day') }} >= '1996-01-01'", "{{ Dimension('nation__name') }} <> 'NATION_1' and {{ Entity('customer') }} > 5"),
            "order_by": ["-orders", "metric_time__year", "customer__segment"],
            "limit": 12,
        },
    }
]


def manifest(spark: SparkSession, **roots: dict) -> DataFrame:
    """A manifest's document of these declarations, by root key."""
    body = json.dumps({"metadata": {"dbt_schema_version": f"{URL}manifest/v12.json"}, **roots})
    return spark.createDataFrame([("declared", body)], "artifact_id string, body string")


def _semantics(spark: SparkSession) -> DataFrame:
    named = lambda kind, x: {f"{kind}.shop.{v['name']}": v for v in x}
    return manifest(spark, semantic_models=named("semantic_model", MODELS), metrics=named("metric", METRICS), saved_queries=named("saved_query", SAVED))


def _tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in ("views", "purchases"):
        return rows(spark, sf_dir, "events").where(F.col("event_type") == name.removesuffix("s"))
    return rows(spark, sf_dir, name)


def metrics_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A derived metric over a ratio over two simple ones, and others, of one aggregation by month."""
    got = metrics.evaluate(_semantics(spark), ["revenue", "urgent_share", "urgent_share_growth", "finished_revenue_share", "orders_since_opening"], partial(_tables, spark, sf_dir), ["metric_time__month"])
    cut = lambda c, n: F.round(c, n).alias(c)
    return got.select(F.date_format("metric_time__month", "yyyy-MM").alias("month"), cut("revenue", 2), cut("urgent_share", 6), cut("urgent_share_growth", 6), cut("finished_revenue_share", 6), "orders_since_opening")


METRICS_BY_NAME = """WITH t AS (SELECT date_trunc('month', o_orderdate)::TIMESTAMP m, sum(o_totalprice) r, count(*) n, nullif(count(*) FILTER (o_orderpriority = '1-URGENT'), 0) u, sum(o_totalprice) FILTER (o_orderstatus = 'F') f FROM orders GROUP BY 1)
SELECT strftime(t.m, '%Y-%m') AS "month", round(t.r, 2) revenue, round(t.u / t.n, 6) urgent_share, round(t.u / t.n - b.u / b.n, 6) urgent_share_growth, round(t.f / t.r, 6) finished_revenue_share, t.n - y.n orders_since_opening
FROM t LEFT JOIN t b ON b.m + INTERVAL 1 MONTH = t.m LEFT JOIN t y ON y.m = date_trunc('year', t.m)"""


def metrics_over_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by a dimension one join away and one two joins away, filtered by one three joins away."""
    got = metrics.evaluate(_semantics(spark), ["revenue", "orders", "urgent_share"], partial(_tables, spark, sf_dir), ["customer__segment", "nation__name"], ["{{ Dimension('region__name') }} <> 'ASIA'"])
    return got.select("customer__segment", "nation__name", F.round("revenue", 2).alias("revenue"), "orders", F.round("urgent_share", 6).alias("urgent_share"))


METRICS_OVER_ENTITIES = """SELECT c_mktsegment customer__segment, n_name nation__name, round(sum(o_totalprice), 2) revenue, count(*) orders, round(nullif(count(*) FILTER (o_orderpriority = '1-URGENT'), 0) / count(*), 6) urgent_share
FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey WHERE r_name <> 'ASIA' GROUP BY 1, 2"""


def metrics_saved_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = metrics.saved(_semantics(spark), "busy_segments", partial(_tables, spark, sf_dir))
    return got.select(F.year("metric_time__year").alias("year"), "customer__segment", "orders", F.round("urgent_share", 6).alias("urgent_share"))


METRICS_SAVED_QUERY = """SELECT year(o_orderdate)::INT AS "year", c_mktsegment customer__segment, count(*) orders, round(nullif(count(*) FILTER (o_orderpriority = '1-URGENT'), 0) / count(*), 6) urgent_share
FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey WHERE o_orderdate >= '1996-01-01' AND n_name <> 'NATION_1' AND o_custkey > 5
GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 12"""


def metrics_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running metrics by day and segment, then one value a month; customers are counted exactly by first appearance."""
    names = ["revenue_of_three_months", "orders_in_year", "dearest_so_far", "customers_so_far"]
    got = metrics.evaluate(_semantics(spark), names, partial(_tables, spark, sf_dir), ["metric_time__month", "customer__segment"])
    return got.select(F.date_format("metric_time__month", "yyyy-MM").alias("month"), "customer__segment", *[F.round(n, 2).alias(n) for n in names[:2]], *names[2:])


METRICS_RUNNING = """WITH o AS (SELECT c_mktsegment s, o_orderdate::TIMESTAMP d, o_totalprice p, o_custkey c, o_orderkey k FROM orders LEFT JOIN customer ON c_custkey = o_custkey),
days AS (SELECT s, unnest(generate_series((SELECT min(d) FROM o), (SELECT max(d) FROM o), INTERVAL 1 DAY)) d FROM (SELECT DISTINCT s FROM o)),
t AS (SELECT s, d, sum(p) r, count(*) n, max(p) m FROM o GROUP BY ALL), f AS (SELECT s, first_d d, count(*) new FROM (SELECT s, c, min(d) first_d FROM o GROUP BY ALL) GROUP BY ALL),
v AS (SELECT days.s, days.d, sum(r) OVER (PARTITION BY days.s ORDER BY days.d RANGE BETWEEN INTERVAL '3 months -1 days' PRECEDING AND CURRENT ROW) r3,
  sum(n) OVER (PARTITION BY days.s, year(days.d) ORDER BY days.d) ny, max(m) OVER (PARTITION BY days.s ORDER BY days.d) top, sum(new) OVER (PARTITION BY days.s ORDER BY days.d) seen
  FROM days LEFT JOIN t ON t.s = days.s AND t.d = days.d LEFT JOIN f ON f.s = days.s AND f.d = days.d)
SELECT strftime(d, '%Y-%m') AS "month", s customer__segment, round(arg_max(r3, d) FILTER (r3 IS NOT NULL), 2) revenue_of_three_months, round(avg(ny), 2) orders_in_year, arg_min(top, d) FILTER (top IS NOT NULL) dearest_so_far, max(seen)::BIGINT customers_so_far FROM v GROUP BY 1, 2"""


def metrics_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases within two days of a view by the same user, both of even or both of odd number, and purchases after any view."""
    got = metrics.evaluate(_semantics(spark), ["purchase_rate", "purchases_after_view"], partial(_tables, spark, sf_dir), ["metric_time__day"])
    return got.select(F.date_format("metric_time__day", "yyyy-MM-dd").alias("day"), F.round("purchase_rate", 6).alias("purchase_rate"), "purchases_after_view")


METRICS_CONVERSION = """WITH b AS (SELECT user_id u, event_id % 2 e, ts FROM events WHERE event_type = 'view'), c AS (SELECT user_id u, event_id % 2 e, ts FROM events WHERE event_type = 'purchase'),
m AS (SELECT b.ts first, c.ts FROM c ASOF JOIN b ON b.u = c.u AND b.e = c.e AND b.ts <= c.ts), a AS (SELECT b.ts first FROM c ASOF JOIN b ON b.u = c.u AND b.ts <= c.ts),
n AS (SELECT date_trunc('day', ts) d, count(*) n FROM b GROUP BY 1), r AS (SELECT date_trunc('day', first) d, count(*) FILTER (ts <= first + INTERVAL 2 DAY) k FROM m GROUP BY 1), w AS (SELECT date_trunc('day', first) d, count(*) k FROM a GROUP BY 1)
SELECT strftime(n.d, '%Y-%m-%d') AS "day", round(coalesce(r.k, 0) / n.n, 6) purchase_rate, coalesce(w.k, 0)::BIGINT purchases_after_view FROM n LEFT JOIN r USING (d) LEFT JOIN w USING (d)"""


def _generic(kind: str, model: str, column: str, config: dict | None = None, **kwargs) -> dict:
    return {"name": f"{kind}_{model}_{column}", "resource_type": "test", "test_metadata": {"name": kind, "kwargs": {"column_name": column, "model": "{{ get_where_subquery(ref('" + model + "')) }}", **kwargs}}, "attached_node": f"model.shop.{model}", "config": config or {}}


def tests_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generic tests of a manifest, run: one scan a table, in the form of run results."""
    tests = {
        "test.a": _generic("unique", "orders", "o_orderkey"),
        "test.b": _generic("unique", "orders", "o_custkey", {"severity": "warn"}),
        "test.c": _generic("unique", "orders", "o_custkey", {"where": "o_orderstatus = 'P'", "fail_calc": "sum(n_records)", "warn_if": "> 0", "error_if": "> 1000000"}),
        "test.d": _generic("not_null", "orders", "o_custkey"),
        "test.e": _generic("accepted_values", "orders", "o_orderstatus", {"severity": "WARN", "limit": 1}, values=["F"]),
        "test.f": _generic("accepted_values", "customer", "c_nationkey", None, values=list(range(25))),
        "test.g": _generic("relationships", "orders", "o_custkey", None, to="ref('customer')", field="c_custkey"),
        "test.h": _generic("relationships", "customer", "c_custkey", {"warn_if": "> 0", "error_if": "> 1000000"}, to="ref('shop', 'orders')", field="o_custkey"),
        "test.i": _generic("not_null", "orders", "o_custkey", {"enabled": False}),
    }
    models = {f"model.shop.{m}": {"name": m, "resource_type": "model"} for m in ("orders", "customer")}
    return declared.run_tests(manifest(spark, nodes={**models, **tests}), partial(_tables, spark, sf_dir))


TESTS_DECLARED = """WITH f AS (SELECT 'test.a' id, (SELECT count(*) FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1)) n, 'fail' bad, 'fail if != 0' m
UNION ALL SELECT 'test.b', (SELECT count(*) FROM (SELECT 1 FROM orders GROUP BY o_custkey HAVING count(*) > 1)), 'warn', 'warn if != 0'
UNION ALL SELECT 'test.c', (SELECT coalesce(sum(n), 0) FROM (SELECT count(*) n FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey HAVING count(*) > 1)), 'warn', 'warn if > 0'
UNION ALL SELECT 'test.d', (SELECT count(*) FROM orders WHERE o_custkey IS NULL), 'fail', 'fail if != 0'
UNION ALL SELECT 'test.e', least(1, (SELECT count(DISTINCT o_orderstatus) FROM orders WHERE o_orderstatus <> 'F')), 'warn', 'warn if != 0'
UNION ALL SELECT 'test.f', (SELECT count(DISTINCT c_nationkey) FROM customer WHERE c_nationkey NOT BETWEEN 0 AND 24), 'fail', 'fail if != 0'
UNION ALL SELECT 'test.g', (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)), 'fail', 'fail if != 0'
UNION ALL SELECT 'test.h', (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)), 'warn', 'warn if > 0')
SELECT id unique_id, CASE WHEN n = 0 THEN 'pass' ELSE bad END status, n::BIGINT failures, CASE WHEN n > 0 THEN 'Got ' || n::BIGINT || CASE WHEN n = 1 THEN ' result' ELSE ' results' END || ', configured to ' || m END message FROM f"""


def constraints_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constraints of models and columns, held against the tables."""
    nodes = {
        "model.shop.orders": {
            "name": "orders",
            "contract": {"enforced": True},
            "constraints": [{"type": "primary_key", "columns": ["o_orderkey"]}, {"type": "unique", "columns": ["o_custkey", "o_orderdate"], "name": "one_a_day"}, {"type": "foreign_key", "columns": ["o_custkey"], "to": '"db"."shop"."customer"', "to_columns": ["c_custkey"]}, {"type": "custom", "expression": "x"}],
            "columns": {"o_totalprice": {"constraints": [{"type": "check", "expression": "o_totalprice > 1000"}, {"type": "not_null"}]}, "o_orderstatus": {"constraints": [{"type": "unique"}]}},
        },
        "model.shop.customer": {"name": "customer", "columns": {"c_nationkey": {"constraints": [{"type": "foreign_key", "expression": "nation (n_nationkey)"}]}, "c_custkey": {"constraints": [{"type": "foreign_key", "expression": "shop.orders(o_custkey)", "name": "buys"}, {"type": "not_null"}]}}},
    }
    return declared.run_constraints(manifest(spark, nodes=nodes), partial(_tables, spark, sf_dir))


CONSTRAINTS_DECLARED = """WITH f(unique_id, no, type, name, "column", enforced, violations) AS (
SELECT 'model.shop.orders', 0, 'primary_key', NULL::VARCHAR, NULL::VARCHAR, true, (SELECT count(*) FROM orders WHERE o_orderkey IS NULL) + (SELECT coalesce(sum(n), 0) FROM (SELECT count(*) n FROM orders WHERE o_orderkey IS NOT NULL GROUP BY o_orderkey HAVING n > 1))
UNION ALL SELECT 'model.shop.orders', 1, 'unique', 'one_a_day', NULL, true, (SELECT coalesce(sum(n), 0) FROM (SELECT count(*) n FROM orders WHERE o_custkey IS NOT NULL AND o_orderdate IS NOT NULL GROUP BY o_custkey, o_orderdate HAVING n > 1))
UNION ALL SELECT 'model.shop.orders', 2, 'foreign_key', NULL, NULL, true, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))
UNION ALL SELECT 'model.shop.orders', 5, 'check', NULL, 'o_totalprice', true, (SELECT count(*) FROM orders WHERE NOT o_totalprice > 1000)
UNION ALL SELECT 'model.shop.orders', 6, 'not_null', NULL, 'o_totalprice', true, (SELECT count(*) FROM orders WHERE o_totalprice IS NULL)
UNION ALL SELECT 'model.shop.orders', 4, 'unique', NULL, 'o_orderstatus', true, (SELECT coalesce(sum(n), 0) FROM (SELECT count(*) n FROM orders GROUP BY o_orderstatus HAVING n > 1))
UNION ALL SELECT 'model.shop.customer', 2, 'foreign_key', NULL, 'c_nationkey', false, (SELECT count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation))
UNION ALL SELECT 'model.shop.customer', 0, 'foreign_key', 'buys', 'c_custkey', false, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders))
UNION ALL SELECT 'model.shop.customer', 1, 'not_null', NULL, 'c_custkey', false, (SELECT count(*) FROM customer WHERE c_custkey IS NULL))
SELECT unique_id, no::INT AS "no", type AS "type", name AS "name", "column", enforced, violations::BIGINT violations FROM f"""


def unit_tests_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unit test for each region, of a model that counts nations: fixtures as CSV, lists and SQL, some of which expect too much."""
    n, r = rows(spark, sf_dir, "nation"), rows(spark, sf_dir, "region")
    grouped = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("ns"), F.count("*").alias("n"))
    key = F.col("n_regionkey")
    csv = F.concat(F.lit("n_nationkey,n_name\n"), F.array_join(F.transform("ns", lambda x: F.concat(x["n_nationkey"], F.lit(',"'), x["n_name"], F.lit('"'))), "\n"))
    given = F.when(key % 2 == 0, F.concat(F.lit('"format":"csv","rows":'), F.substring_index(F.substring(F.to_json(F.struct(csv.alias("x"))), 6, 1 << 30), "}", 1))).otherwise(F.concat(F.lit('"rows":'), F.to_json("ns")))
    sql = F.concat(F.lit("select "), key, F.lit(" as r_regionkey, '"), F.col("r_name"), F.lit("' as r_name"))
    many = F.col("n") + (key == 3).cast("int")
    test = F.concat(F.lit('{"model":"sizes","given":[{"input":"ref(\'nation\')",'), given, F.lit('},{"input":"source(\'s\', \'region\')","format":"sql","rows":"'), sql, F.lit('"}],"overrides":{"vars":{"least":'), F.when(key == 4, 1000).otherwise(0), F.lit('}},"expect":{"rows":[{"r_name":"'), F.col("r_name"), F.lit('","n":'), many, F.lit("}]}}"))
    tests = grouped.join(r, r.r_regionkey == grouped.n_regionkey).groupBy().agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('"unit_test.r'), key, F.lit('":'), test))), ",").alias("tests"))
    model = {"name": "sizes", "resource_type": "model", "raw_code": "{{ config(materialized='table') }} select r_name, count(*) as n, min(n_name) as first from {{ source('s', 'region') }} cross join {{ ref('nation') }} where n_nationkey >= {{ var('least', 5) }} group by r_name"}
    nodes = {"model.shop.sizes": model, "model.shop.nation": {"name": "nation", "columns": {"n_nationkey": {"data_type": "integer"}, "n_name": {"data_type": "varchar(25)"}}}}
    body = F.concat(F.lit('{"nodes":'), F.lit(json.dumps(nodes)), F.lit(',"unit_tests":{'), F.col("tests"), F.lit("}}"))
    return declared.run_unit_tests(tests.select(F.lit("m").alias("artifact_id"), body.alias("body")))


UNIT_TESTS_RUN = """SELECT 'unit_test.r' || r_regionkey unique_id, CASE WHEN r_regionkey IN (3, 4) THEN 'fail' ELSE 'pass' END status, (r_regionkey = 3)::BIGINT n_actual, (r_regionkey IN (3, 4))::BIGINT n_expected
FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)"""


def history_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the balance that their customer had at the time, from a history of two snapshots; customer 0 gets half the orders."""
    c = rows(spark, sf_dir, "customer").select("c_custkey", F.round("c_acctbal", 2).alias("c_acctbal"))
    then = snapshot.start(c.where("c_custkey % 10 <> 1"), F.lit("1996-01-01"))
    history = snapshot.snapshot(then, c.where("c_custkey % 10 <> 2").withColumn("c_acctbal", F.when(F.col("c_custkey") % 10 < 5, -1.0).otherwise(F.col("c_acctbal"))), "c_custkey", F.lit("1998-06-15"), close_missing=True)
    o = rows(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, 0).otherwise(F.col("o_custkey")).alias("cust"), "o_orderdate")
    got = valid_at(o, history, "cust", "o_orderdate", "valid_from", "valid_to", ["c_acctbal"], history_key="c_custkey")
    return got.groupBy(F.year("o_orderdate").alias("year"), F.col("c_acctbal").isNull().alias("unknown")).agg(F.count("*").alias("n_orders"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


HISTORY_JOIN = """WITH c AS (SELECT c_custkey k, round(c_acctbal, 2) b FROM customer),
two AS (SELECT k, CASE WHEN k % 10 < 5 THEN -1.0 ELSE b END b FROM c WHERE k % 10 <> 2),
h AS (SELECT c.k, c.b, TIMESTAMP '1996-01-01' a, CASE WHEN two.k IS NULL OR two.b <> c.b THEN TIMESTAMP '1998-06-15' END z FROM c LEFT JOIN two USING (k) WHERE c.k % 10 <> 1
  UNION ALL SELECT two.k, two.b, TIMESTAMP '1998-06-15', NULL FROM two LEFT JOIN c ON c.k = two.k AND c.k % 10 <> 1 WHERE c.k IS NULL OR two.b <> c.b),
o AS (SELECT o_orderkey, CASE o_orderkey % 2 WHEN 0 THEN 0 ELSE o_custkey END k, o_orderdate d FROM orders)
SELECT year(d)::INT AS "year", b IS NULL AS "unknown", count(*) n_orders, round(sum(b), 2) balance FROM o LEFT JOIN h ON h.k = o.k AND d >= a AND (z IS NULL OR d < z) GROUP BY ALL"""

def freshness_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How old the newest orders and events are, by declared fields, filters and limits."""
    limits = lambda w, e: {"warn_after": {"count": w, "period": "day"}, "error_after": {"count": e, "period": "day"}}
    sources = {
        "source.shop.orders": {"name": "orders", "loaded_at_field": "o_orderdate", "freshness": limits(10, 1000)},
        "source.shop.finished": {"name": "orders", "loaded_at_field": "o_orderdate + interval 1 hour", "freshness": {**limits(None, 10), "filter": "o_orderstatus = 'F'"}},
        "source.shop.events": {"name": "events", "loaded_at_field": "ts", "freshness": limits(100000, None)},
        "source.shop.none": {"name": "events", "loaded_at_field": "ts", "freshness": {**limits(1, 2), "filter": "event_id < 0"}},
        "source.shop.part": {"name": "part", "loaded_at_field": None, "freshness": limits(1, 2)},
    }
    got = declared.run_freshness(manifest(spark, sources=sources), partial(_tables, spark, sf_dir), "2001-12-01 00:00:00")
    return got.select("unique_id", "status", F.date_format("max_loaded_at", "yyyy-MM-dd HH:mm:ss").alias("newest"), F.round("ago_s", 0).cast("long").alias("ago_s"))


FRESHNESS_DECLARED = """WITH t AS (SELECT 'source.shop.orders' id, max(o_orderdate)::TIMESTAMP m, 10 w, 1000 e FROM orders UNION ALL SELECT 'source.shop.finished', max(o_orderdate + INTERVAL 1 HOUR) FILTER (o_orderstatus = 'F'), NULL, 10 FROM orders
UNION ALL SELECT 'source.shop.events', max(ts), 100000, NULL FROM events UNION ALL SELECT 'source.shop.none', NULL, 1, 2),
a AS (SELECT *, epoch_us(TIMESTAMP '2001-12-01') - epoch_us(m) us FROM t)
SELECT id unique_id, CASE WHEN m IS NULL OR us > e * 86400000000 THEN 'error' WHEN us > w * 86400000000 THEN 'warn' ELSE 'pass' END status, strftime(m, '%Y-%m-%d %H:%M:%S') newest, round(us / 1e6)::BIGINT ago_s FROM a"""


def snapshot_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A declared snapshot of customers by nation and number, run twice: the second time some balances are others."""
    nodes = {"snapshot.shop.c": {"name": "c", "resource_type": "snapshot", "raw_code": "select c_nationkey, c_custkey, c_acctbal from {{ ref('customer') }} where c_nationkey <> 3", "config": {"strategy": "check", "unique_key": ["c_nationkey", "c_custkey"], "check_cols": ["c_acctbal"], "hard_deletes": "invalidate"}}}
    docs, c = manifest(spark, nodes=nodes), rows(spark, sf_dir, "customer")
    first = declared.run_snapshot(docs, "c", {"customer": c}, "2024-01-01")
    later = c.where("c_custkey % 7 <> 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 5 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    got = declared.run_snapshot(docs, "c", {"customer": later}, "2024-02-01", first)
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return got.groupBy("c_nationkey", day("valid_from").alias("valid_from"), day("valid_to").alias("valid_to")).agg(F.count("*").alias("n_rows"))


SNAPSHOT_DECLARED = """WITH c AS (SELECT c_nationkey, c_custkey k FROM customer WHERE c_nationkey <> 3)
SELECT c_nationkey, '2024-01-01' valid_from, CASE WHEN k % 7 = 0 OR k % 5 = 0 THEN '2024-02-01' END valid_to, count(*) n_rows FROM c GROUP BY ALL
UNION ALL SELECT c_nationkey, '2024-02-01', NULL, count(*) FROM c WHERE k % 7 <> 0 AND k % 5 = 0 GROUP BY ALL"""

QUERIES = (metrics_by_name, metrics_over_entities, metrics_saved_query, metrics_running, metrics_conversion, tests_declared, constraints_declared, unit_tests_run, history_join, freshness_declared, snapshot_declared)
SQL = {f.__name__: globals()[f.__name__.upper()] for f in QUERIES}
