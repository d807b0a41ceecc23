"""Declared metrics, tests, constraints and unit tests over small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestone.operators import declared, metrics, rules, semantic
from lodestone.operators.validity import valid_at
from lodestone.plans.declared import _entity, _label, _metric, _model, _only, _time, manifest


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def tables(spark):
    return {
        "sales": spark.createDataFrame([(1, 10, 5.0, day(0)), (2, 10, 7.0, day(40)), (3, 11, 1.0, day(41)), (4, 12, 2.0, day(95)), (5, None, 4.0, day(95)), (6, 99, 8.0, None)], "id long, buyer long, price double, at timestamp"),
        "buyers": spark.createDataFrame([(10, "a", 1), (11, "b", 1), (12, None, 2), (None, "x", 1)], "id long, kind string, town long"),
        "towns": spark.createDataFrame([(1, "north"), (2, "south")], "id long, name string"),
        "visits": spark.createDataFrame([(1, 10), (2, 10)], "id long, buyer long"),
    }


def layer(extra=(), models=()):
    own = [
        _model("sales", [_entity("sale", "primary", "id"), _entity("buyer", "foreign", "buyer")], [_time("sold", "at"), _label("dear", "price > 4")], [{"name": "income", "agg": "sum", "expr": "price"}, {"name": "n", "agg": "count", "expr": "id"}, {"name": "half", "agg": "percentile", "expr": "price", "agg_params": {"percentile": 0.5, "use_discrete_percentile": True}}, {"name": "buyers", "agg": "count_distinct", "expr": "buyer"}, {"name": "last_income", "agg": "sum", "expr": "price", "non_additive_dimension": {"name": "sold", "window_choice": "max", "window_groupings": ["buyer"]}}], "sold"),
        _model("buyers", [_entity("buyer", "primary", "id"), _entity("town", "foreign", "town")], [_label("kind", "kind")]),
        _model("towns", [_entity("town", "unique", "id")], [_label("name", "name")]),
        _model("visits", [_entity("visit", "primary", "id"), _entity("buyer", "foreign", "buyer")], [_label("no", "id")], [{"name": "n_visits", "agg": "count", "expr": "id"}]),
        *models,
    ]
    told = [
        _metric("income", "simple", measure={"name": "income"}),
        _metric("n", "simple", measure={"name": "n"}),
        _metric("median", "simple", measure={"name": "half"}),
        _metric("last_income", "simple", measure={"name": "last_income"}),
        _metric("visits", "simple", measure={"name": "n_visits", "fill_nulls_with": 0}),
        _metric("dear", "simple", _only("{{ Dimension('sale__dear') }}"), measure={"name": "n"}),
        _metric("mean", "ratio", numerator={"name": "income"}, denominator={"name": "n"}),
        _metric("twice", "derived", expr="mean * 2 + coalesce(d, 0)", metrics=[{"name": "mean"}, {"name": "dear", "alias": "d"}]),
        _metric("loop", "derived", expr="pool", metrics=[{"name": "pool"}]),
        _metric("pool", "ratio", numerator={"name": "loop"}, denominator={"name": "n"}),
        *extra,
    ]
    return metrics.Layer({m["name"]: m for m in own}, {m["name"]: m for m in told}, {})


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_metrics_of_several_models_and_types_in_one_result(tables):
    got = metrics.evaluate(layer(), ["twice", "dear", "visits", "median"], tables, ["buyer__kind"])
    assert got.columns == ["buyer__kind", "twice", "dear", "visits", "median"]
    assert told(got) == sorted([("a", 14.0, 2, 2, 5.0), ("b", 2.0, None, 0, 1.0), (None, 2 * 14 / 3 + 1, 1, 0, 4.0)], key=repr)
    assert told(metrics.evaluate(layer(), ["mean", "visits"], tables)) == [(27 / 6, 2)]
    # All measures of a model come from one scan of it.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD [id") <= 4


def test_dimensions_over_two_joins_and_of_entities(tables):
    got = metrics.evaluate(layer(), ["n"], tables, ["town__name", "Entity('buyer')"], ["{{ Dimension('town__name') }} is not null"], ["-buyer"], 2)
    assert [tuple(r) for r in got.collect()] == [("south", 12, 1), ("north", 11, 1)]
    named = metrics.evaluate(layer(), ["n"], tables, ["Dimension('town__name', entity_path=['buyer'])"])
    assert named.columns[0] == "buyer__town__name" and sorted(r[1] for r in named.collect()) == [1, 2, 3]


def test_what_is_refused_before_anything_runs(tables):
    with pytest.raises(ValueError, match="multiply"):
        metrics.evaluate(layer(), ["visits"], tables, ["sale__dear"])
    with pytest.raises(ValueError, match="itself: loop of pool of loop"):
        metrics.evaluate(layer(), ["loop"], tables)
    for by, names, says in ((["buyer__nothing"], ["n"], "Unknown dimension"), ([], ["nothing"], "Unknown metric"), (["metric_time__day"], ["visits"], "No time dimension"), (["buyer__kind__day"], ["n"], "No time dimension"), (["Metric('n')"], ["n"], "Unknown template")):
        with pytest.raises(ValueError, match=says):
            metrics.evaluate(layer(), names, tables, by)
    with pytest.raises(ValueError, match="Unknown dimension"):
        metrics.evaluate(layer(), ["n"], tables, [], ["{{ Dimension('nope') }} > 1"])
    with pytest.raises(ValueError, match="Several ways"):
        metrics.evaluate(layer(models=[_model("others", [_entity("buyer", "unique", "id")], [_label("kind", "kind")])]), ["n"], tables, ["buyer__kind"])
    with pytest.raises(ValueError, match="Unknown order"):
        metrics.evaluate(layer(), ["n"], tables, [], [], ["income"])


def test_a_key_with_two_rows_fails_the_query(spark, tables):
    twice = {**tables, "buyers": tables["buyers"].union(spark.createDataFrame([(10, "z", 2)], tables["buyers"].schema))}
    with pytest.raises(Exception, match="buyers has several rows of one buyer"):
        metrics.evaluate(layer(), ["n"], twice, ["buyer__kind"]).collect()


def test_running_metrics_with_groups_a_calendar_and_each_period_agg(spark, tables):
    run = lambda name, **p: _metric(name, "cumulative", measure={"name": p.pop("m", "income")}, cumulative_type_params=p)
    own = layer([run("first", period_agg="first"), run("last", period_agg="last"), run("mean_", period_agg="average"), run("two", window={"count": 2, "granularity": "month"}, period_agg="last"), run("who", m="buyers", period_agg="last"), run("who30", m="buyers", window={"count": 30, "granularity": "day"}, period_agg="last")])
    got = metrics.evaluate(own, ["first", "last", "mean_", "two", "who", "who30"], tables, ["metric_time__month"], order_by=["metric_time__month"])
    rows = [tuple(r)[1:] for r in got.collect()]
    daily = {0: 5.0, 40: 12.0, 41: 13.0, 95: 19.0}
    running = [max(v for k, v in daily.items() if k <= d) for d in range(96)]
    months = [(0, 31), (31, 60), (60, 91), (91, 96)]
    assert [r[0] for r in rows] == [running[a] for a, _ in months] and [r[1] for r in rows] == [running[b - 1] for _, b in months]
    assert [r[2] for r in rows] == pytest.approx([sum(running[a:b]) / (b - a) for a, b in months])
    assert [r[3] for r in rows] == [5.0, 13.0, 8.0, 14.0]  # at last from February 6 to April 5
    assert [r[4] for r in rows] == [1, 2, 2, 3] and [r[5] for r in rows] == [1, 2, 1, 1]
    spine = spark.createDataFrame([(day(n),) for n in range(0, 120, 5)], "d timestamp")
    some = metrics.evaluate(own, ["last"], tables, ["metric_time__day", "buyer__kind"], spine=spine)
    days = {r[0] for r in some.collect()}
    assert days <= {day(n) for n in range(0, 96, 5)} and len(days) == 20
    with pytest.raises(ValueError, match="needs metric_time"):
        metrics.evaluate(own, ["last"], tables)


def test_grouped_spine_fills_inner_periods_of_each_group(spark):
    totals = spark.createDataFrame([("a", day(0), 1), ("a", day(2), 2), (None, day(3), 5)], "g string, d timestamp, n long")
    got = told(semantic.filled(totals, "d", "n", "day", by=["g"]))
    assert len(got) == 8 and sum(r[2] for r in got) == 8 and {(r[0], r[1].day) for r in got} == {(g, n) for g in ("a", None) for n in (1, 2, 3, 4)}
    assert [r[2] for r in told(semantic.filled(totals, "d", "n", "day", None, ["g"])) if r[0] is None and r[1].day < 4] == [None] * 3
    assert semantic.filled(totals.where("false"), "d", "n", "day", by=["g"]).count() == 0


def test_windows_of_every_unit(spark):
    rows = [(dt.datetime(2023, 11, 1) + dt.timedelta(days=n), n) for n in range(200)]
    totals = spark.createDataFrame(rows, "d timestamp, n long")
    for window, back in (("2 month", 2), ("1 quarter", 3)):
        got = {r.d: r.s for r in semantic.cumulative(totals, "s", "n", "d", window=window, agg="sum").collect()}
        for d, _ in rows:
            m = d.month - 1 - back
            year, month = d.year + m // 12, m % 12 + 1
            last = (dt.datetime(year + month // 12, month % 12 + 1, 1) - dt.timedelta(days=1)).day
            low = dt.datetime(year, month, min(d.day, last))
            assert got[d] == sum(n for e, n in rows if low < e <= d), (window, d)
    week = {r.d: r.s for r in semantic.cumulative(totals, "s", "n", "d", window="1 week", agg="max").collect()}
    assert all(week[d] == n for d, n in rows)
    by_month = spark.createDataFrame([(dt.datetime(2024, m, 1), m) for m in (1, 2, 4, 5)], "d timestamp, n long")
    assert [r.s for r in semantic.cumulative(by_month, "s", "n", "d", window="3 month", unit="month").orderBy("d").collect()] == [1, 3, 6, 9]


def test_every_window_choice(spark):
    df = spark.createDataFrame([("a", day(n), n) for n in (0, 1, 2, 9)] + [("b", day(5), 5), ("b", None, 7)], "g string, d timestamp, n long")
    got = {c: sorted(r.n for r in semantic.non_additive(df, "d", c, ["g"]).collect()) for c in ("max", "min", "median", "percentile", "average")}
    assert got == {"max": [5, 9], "min": [0, 5], "median": [1, 5], "percentile": [1, 5], "average": [2, 5]}
    with pytest.raises(ValueError, match="tells no time"):
        semantic.non_additive(df, "d", "sum")


def test_non_additive_measures_by_name(tables):
    got = metrics.evaluate(layer(), ["last_income"], tables, ["buyer"])
    assert told(got.where("last_income is not null")) == [(10, 7.0), (11, 1.0), (12, 2.0), (None, 4.0)]


def test_conversions_with_constant_properties(spark):
    base = spark.createDataFrame([(1, "x", day(0)), (1, "y", day(1)), (2, None, day(0))], "u long, p string, t timestamp")
    then = spark.createDataFrame([(1, "x", day(3)), (1, "z", day(3)), (2, None, day(9)), (2, None, None)], "u long, q string, t timestamp")
    any_ = semantic.conversion(base, then, "n", "u", "t").first()
    same = semantic.conversion(base, then, "n", "u", "t", "5 days", by=["p"], constant=[("p", "q")])
    assert (any_.n_base, any_.n) == (3, 3)
    assert {r.p: (r.n_base, r.n, r.n_rate) for r in same.collect()} == {"x": (1, 1, 1.0), "y": (1, 0, 0.0), None: (1, 0, 0.0)}


def test_estimates_of_distinct_counts_are_near(spark):
    df = spark.range(60_000).select((F.col("id") * 7919 % 20_011).alias("v"), F.timestamp_seconds(F.col("id") % 10 * 86_400).alias("t"))
    exact = {d: df.where((F.col("t") <= day_) & (F.col("t") > day_ - F.expr("interval 3 day"))).select("v").distinct().count() for d, day_ in ((k, F.timestamp_seconds(F.lit(k * 86_400))) for k in (0, 4, 9))}
    got = {round(r.period.timestamp() / 86_400): r.n for r in semantic.distinct_in_window(df, "n", F.col("v"), F.col("t"), "3 day").collect()}
    assert len(got) == 10 and all(abs(got[k] - n) <= 0.03 * n for k, n in exact.items())


def test_rows_valid_at_a_time_equal_a_range_join(spark):
    history = [(1, day(0), day(10), "a"), (1, day(10), None, "b"), (2, day(5), day(6), "c"), (3, day(1), day(200), "d"), (None, day(0), None, "e"), (4, None, None, "f")]
    events = [(k, day(n)) for k in (1, 1, 1, 2, 3, 4, 5, None) for n in (-1, 0, 5, 6, 9, 10, 70, 150, 210)] + [(1, None), (1, day(5))]
    h = spark.createDataFrame(history, "k long, a timestamp, z timestamp, v string")
    e = spark.createDataFrame(events, "k long, t timestamp")
    want = sorted(((k, t, next((v for hk, a, z, v in history if k is not None and t is not None and a is not None and hk == k and a <= t and (z is None or t < z)), None)) for k, t in events), key=repr)
    for slot in ("month", "day", "year"):
        got = valid_at(e, h, "k", "t", "a", "z", ["v"], slot=slot)
        assert got.columns == ["k", "t", "v"] and told(got) == want
    assert told(valid_at(e, h.where("false"), "k", "t", "a", "z", ["v"])) == sorted(((k, t, None) for k, t in events), key=repr)


def test_a_metric_by_a_dimension_that_is_valid_for_a_time(spark, tables):
    lived = _model("lived", [_entity("buyer", "natural", "buyer")], [_label("place", "place"), {**_time("from", "a"), "type_params": {"time_granularity": "day", "validity_params": {"is_start": True}}}, {**_time("to", "z"), "type_params": {"time_granularity": "day", "validity_params": {"is_end": True}}}])
    rows = [(10, day(0), day(20), "here"), (10, day(20), None, "there"), (12, day(96), None, "late")]
    where = {**tables, "lived": spark.createDataFrame(rows, "buyer long, a timestamp, z timestamp, place string")}
    assert told(metrics.evaluate(layer(models=[lived]), ["income"], where, ["buyer__place"])) == [("here", 5.0), ("there", 7.0), (None, 15.0)]


def _test(kind, config=None, **kwargs):
    return {"test_metadata": {"name": kind, "kwargs": {"model": "{{ get_where_subquery(ref('t')) }}", **kwargs}}, "config": config or {}}


def test_declared_tests_with_nulls_thresholds_and_limits(spark):
    t = spark.createDataFrame([(1, "a", True), (1, "b", False), (None, "c", None), (2, None, True), (3, "a", True), (3, "a", True)], "k long, v string, b boolean")
    u = spark.createDataFrame([(1,), (None,)], "k long")
    nodes = {
        "unique": _test("unique", column_name="k"),
        "rows": _test("unique", {"fail_calc": " SUM(n_records)"}, column_name="k"),
        "null": _test("not_null", {"where": "v is not null", "warn_if": ">= 1", "error_if": "> 1"}, column_name="k"),
        "values": _test("accepted_values", {"severity": "warn", "limit": 1}, column_name="v", values=["a"]),
        "boolean": _test("accepted_values", column_name="b", values=[True, False]),
        "key": _test("relationships", column_name="k", to="source('s', 'u')", field="k"),
        "newer": _test("relationships", arguments={"column_name": "k", "to": "ref('u')", "field": "k"}),
        "off": _test("nonsense", {"enabled": False}, column_name="k"),
    }
    got = {r.unique_id: (r.status, r.failures) for r in declared.run_tests(manifest(spark, nodes=nodes), {"t": t, "u": u}).collect()}
    assert got == {"unique": ("fail", 2), "rows": ("fail", 4), "null": ("warn", 1), "values": ("warn", 1), "boolean": ("pass", 0), "key": ("fail", 3), "newer": ("fail", 3)}
    empty = {r.unique_id: r.status for r in declared.run_tests(manifest(spark, nodes=nodes), {"t": t.where("false"), "u": u.where("false")}).collect()}
    assert set(empty.values()) == {"pass"} and len(empty) == 7
    assert declared.run_tests(manifest(spark, nodes={}), {}).count() == 0
    for bad, says in (({"x": _test("nonsense", column_name="k")}, "Unknown generic test"), ({"x": _test("unique")}, "no column"), ({"x": _test("unique", {"fail_calc": "max(1)"}, column_name="k")}, "fail_calc")):
        with pytest.raises(ValueError, match=says):
            declared.run_tests(manifest(spark, nodes=bad), {"t": t})
    with pytest.raises(ValueError, match="Unknown table"):
        declared.run_tests(manifest(spark, nodes={"x": _test("unique", column_name="k")}), {})


def test_constraints_are_answered_by_one_scan_a_table(spark, tmp_path):
    spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (None, 2, "c"), (2, None, None)], "a long, b long, c string").write.parquet(f"{tmp_path}/t")
    spark.createDataFrame([(1, 1), (7, 7)], "a long, b long").write.parquet(f"{tmp_path}/u")
    nodes = {"m": {"name": "t", "constraints": [{"type": "primary_key", "columns": ["a", "b"]}, {"type": "check", "expression": "c <> 'b'"}, {"type": "foreign_key", "columns": ["a", "b"], "expression": "s.u (a, b)"}], "columns": {"c": {"constraints": [{"type": "not_null"}, {"type": "unique"}]}, "b": {"constraints": [{"type": "foreign_key", "to": "ref('u')", "to_columns": ["b"]}]}}}}
    got = declared.run_constraints(manifest(spark, nodes=nodes), lambda name: spark.read.parquet(f"{tmp_path}/{name}"))
    assert {r.no: (r.type, r.column, r.violations) for r in got.collect()} == {0: ("primary_key", None, 4), 1: ("check", None, 1), 2: ("foreign_key", None, 0), 3: ("foreign_key", "b", 1), 4: ("not_null", "c", 1), 5: ("unique", "c", 0)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("FileScan parquet") == 2
    assert {"warn_unenforced", "warn_unsupported"} <= set(__import__("lodestone.operators.manifest", fromlist=["constraints"]).constraints(manifest(spark, nodes=nodes)).columns)
    with pytest.raises(ValueError, match="nowhere"):
        declared.run_constraints(manifest(spark, nodes={"m": {"name": "t", "constraints": [{"type": "foreign_key", "columns": ["a"]}]}}), {})
    with pytest.raises(ValueError, match="same id"):
        rules.failures(spark, [rules.Rule("x", "t", "unique", ("a",))] * 2, {})


def test_unit_tests_with_every_kind_of_fixture(spark):
    model = {"name": "m", "raw_code": "{# note #}{{ config(x=1) }} select t.k, upper(t.v) as v, s.w from {{ ref('pkg', 't') }} t left join {{ source('x', 's') }} s on s.k = t.k where t.k > {{ var('low') }} and '{{ env_var(\"WHO\", \"me\") }}' = 'me'"}
    base = {"m": model, "t": {"name": "t", "columns": {"k": {"data_type": "INTEGER"}, "v": {"data_type": "varchar(9)"}, "none": {"data_type": "date"}}}, "s": {"name": "s", "columns": {"w": {"data_type": "double"}, "k": {"data_type": "int"}}}}
    given = [{"input": "ref('t')", "rows": [{"k": 1, "v": "a"}, {"k": 2}, {"k": 3, "v": None}]}, {"input": "source('x', 's')", "format": "csv", "rows": "k,w\n1, 1.5\n3,\n"}]
    test = lambda expect, given_=given, **more: {"model": "m", "given": given_, "expect": expect, "overrides": {"vars": {"low": 0}}, **more}
    tests = {
        "csv": test({"format": "csv", "rows": "k,v,w\n1,A,1.5\n2,,\n3,,"}),
        "dict": test({"rows": [{"k": 1, "w": 1.5}, {"k": 2, "w": None}, {"k": 3, "w": None}]}),
        "sql": test({"format": "sql", "rows": "select 1 as k union all select 2 union all select 3"}),
        "wrong": test({"rows": [{"k": 1}, {"k": 1}, {"k": 2}]}),
        "empty": test({"rows": []}, [{"input": "ref('t')", "rows": []}, given[1]]),
        "off": test({"rows": []}, config={"enabled": False}),
    }
    got = {r.unique_id: (r.status, r.n_actual, r.n_expected) for r in declared.run_unit_tests(manifest(spark, nodes=base, unit_tests=tests)).collect()}
    assert got == {"csv": ("pass", 0, 0), "dict": ("pass", 0, 0), "sql": ("pass", 0, 0), "wrong": ("fail", 1, 1), "empty": ("pass", 0, 0)}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("given_")]
    with pytest.raises(ValueError, match="An input that no test gives: s"):
        declared.run_unit_tests(manifest(spark, nodes=base, unit_tests={"x": test({"rows": []}, given[:1])}))
    from_table = declared.run_unit_tests(manifest(spark, nodes=base, unit_tests={"x": test({"rows": [{"k": 1, "w": 9.0}, {"k": 2}, {"k": 3}]}, given[:1])}), {"s": spark.createDataFrame([(1, 9.0)], "k int, w double")})
    assert from_table.first().status == "pass"
    with pytest.raises(ValueError, match="not filled in"):
        declared.run_unit_tests(manifest(spark, nodes={"m": {"name": "m", "raw_code": "{% if x %} select 1 {% endif %}"}}, unit_tests={"x": test({"rows": []}, [])}))
    assert declared.run_unit_tests(manifest(spark, nodes={"m": {"name": "m", "raw_code": "{% if x %} {% endif %}", "compiled_code": "select 1 as k"}}, unit_tests={"x": {"model": "m", "given": [], "expect": {"rows": [{"k": 1}]}}})).first().status == "pass"


def test_saved_queries_and_newer_metrics(spark, tables):
    nodes = {m["name"]: m for m in layer().models.values()}
    newer = {"name": "big", "type": "simple", "type_params": {"metric_aggregation_params": {"semantic_model": "sales", "agg": "max", "agg_time_dimension": "sold"}, "expr": "price"}, "filter": {"where_sql_template": "{{ TimeDimension('metric_time', 'month') }} < '2024-02-01'"}}
    query = {"name": "q", "query_params": {"metrics": ["big", "n"], "group_by": ["TimeDimension('metric_time').grain('year')"], "where": None, "limit": None}}
    docs = manifest(spark, semantic_models=nodes, metrics={"big": newer, "n": layer().metrics["n"]}, saved_queries={"q": query})
    assert told(metrics.saved(docs, "q", tables)) == sorted([(dt.datetime(2024, 1, 1), 5.0, 5), (None, None, 1)], key=repr)
    with pytest.raises(ValueError, match="Unknown saved query"):
        metrics.saved(docs, "other", tables)
    with pytest.raises(ValueError, match="several manifests"):
        metrics.Layer.read(docs.union(docs.withColumn("artifact_id", F.lit("b"))))


def test_singular_tests_run_beside_generic_ones(spark):
    t = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    nodes = {
        "one": {"resource_type": "test", "raw_code": "select * from {{ ref('t') }} where v is null", "config": {"severity": "warn"}},
        "two": {"resource_type": "test", "raw_code": "{% if x %}{% endif %}", "compiled_code": "select 1 where false"},
        "null": _test("not_null", column_name="k"),
        "off": {"resource_type": "test", "raw_code": "select broken", "config": {"enabled": False}},
    }
    got = {r.unique_id: (r.status, r.failures) for r in declared.run_tests(manifest(spark, nodes=nodes), {"t": t}).collect()}
    assert got == {"one": ("warn", 1), "two": ("pass", 0), "null": ("pass", 0)}
    assert not [v for v in spark.catalog.listTables() if v.name.startswith("over_")]


def test_contracts_tell_how_tables_depart_from_them(spark):
    t = spark.createDataFrame([], "a int, b string, c decimal(10,2), e timestamp")
    columns = {"A": {"data_type": "INTEGER"}, "b": {"data_type": "varchar(3)"}, "c": {"data_type": "decimal(10, 3)"}, "d": {"data_type": "int"}, "e": {}}
    nodes = {"m": {"name": "t", "contract": {"enforced": True}, "columns": columns}, "n": {"name": "t", "contract": {"enforced": False}, "columns": {}}, "o": {"name": "t", "contract": {"enforced": True}, "columns": {k: {} for k in "abc"}}}
    got = {(r.unique_id, r.column): r.problem for r in declared.run_contracts(manifest(spark, nodes=nodes), {"t": t}).collect()}
    assert got == {("m", "c"): "type", ("m", "d"): "missing", ("o", "e"): "undeclared"}


def test_freshness_of_sources_by_their_limits(spark):
    t = spark.createDataFrame([(day(0), 1), (day(3), 2), (None, 1)], "at timestamp, k long")
    after = lambda n, p: {"count": n, "period": p}
    source = lambda w, e, **more: {"name": "t", "loaded_at_field": "at", "freshness": {"warn_after": w, "error_after": e, **more}}
    sources = {"pass": source(after(24, "hour"), after(2, "day")), "warn": source(after(1439, "minute"), None), "error": source(None, after(23, "hour")), "old": source(after(1, "day"), after(3, "day"), filter="k = 1"), "none": source(after(1, "day"), None, filter="k = 9"), "off": {"name": "t", "freshness": None}, "free": source(None, None)}
    got = {r.unique_id: (r.status, r.ago_s) for r in declared.run_freshness(manifest(spark, sources=sources), {"t": t}, str(day(4))).collect()}
    assert got == {"pass": ("pass", 86_400), "warn": ("warn", 86_400), "error": ("error", 86_400), "old": ("error", 4 * 86_400), "none": ("error", None)}
    assert declared.run_freshness(manifest(spark, sources={}), {}, "2024-01-01").count() == 0


def test_declared_snapshots_of_both_strategies(spark):
    node = lambda **c: {"name": "s", "resource_type": "snapshot", "raw_code": "select * from {{ ref('t') }}", "config": c}
    one = spark.createDataFrame([(1, "a", day(0)), (2, "b", day(0))], "k long, v string, u timestamp")
    two = spark.createDataFrame([(1, "z", day(0)), (3, "c", day(9)), (2, "b", day(5))], "k long, v string, u timestamp")
    run = lambda d: told(declared.run_snapshot(d, "s", {"t": two}, str(day(10)), declared.run_snapshot(d, "s", {"t": one}, str(day(1)))).select("k", "v", "valid_from", "valid_to"))
    timed = run(manifest(spark, nodes={"x": node(strategy="timestamp", unique_key="k", updated_at="u")}))
    assert timed == told(spark.createDataFrame([(1, "a", day(0), None), (2, "b", day(0), day(5)), (2, "b", day(5), None), (3, "c", day(9), None)], "k long, v string, a timestamp, z timestamp"))
    checked = run(manifest(spark, nodes={"x": node(strategy="check", unique_key="k", check_cols=["v"], invalidate_hard_deletes=True)}))
    assert checked == told(spark.createDataFrame([(1, "a", day(1), day(10)), (1, "z", day(10), None), (2, "b", day(1), None), (3, "c", day(10), None)], "k long, v string, a timestamp, z timestamp"))
    with pytest.raises(ValueError, match="Unknown strategy"):
        run(manifest(spark, nodes={"x": node(strategy="other", unique_key="k")}))
    with pytest.raises(ValueError, match="Unknown snapshot"):
        declared.run_snapshot(manifest(spark, nodes={}), "s", {}, "2024-01-01")


def test_exports_of_saved_queries_are_written(spark, tables):
    own = layer()
    own.saved = {"q": {"query_params": {"metrics": ["n"], "group_by": []}, "exports": [{"name": "e", "config": {"export_as": "view", "alias": "exported_n"}}]}, "none": {"query_params": {"metrics": ["n"]}}}
    assert metrics.run_exports(own, "q", tables) == ["exported_n"] and spark.table("exported_n").first().n == 6
    assert metrics.run_exports(own, "none", tables) == []
    spark.catalog.dropTempView("exported_n")
