"""Detection, parsing, flattening and what is asked of artifacts, on small documents."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone import catalog as catalogs, freshness as freshnesses, manifest as manifests, run_results as runs
from lodestone.functions.detect import detect, parse, parse_version
from lodestone.operators import catalog, checks, freshness, lineage, manifest, run_results, semantic
from lodestone.sources.artifacts import artifact_path, check_name, clean_name, read_artifacts, write_table
from lodestone.streaming.artifacts import watch

URL = "https://schemas.getdbt.com/dbt"


def body(kind, version, **parts):
    return json.dumps({"metadata": {"dbt_schema_version": f"{URL}/{kind}/v{version}.json"}, **parts})


def frame(spark, *bodies):
    return spark.createDataFrame([(str(i), b) for i, b in enumerate(bodies)], "artifact_id string, body string")


def errors(df):
    return [r.error for r in df.orderBy(F.col("artifact_id").cast("int")).select("error").collect()]


@pytest.mark.parametrize("text", ["{}", '{"metadata":{}}', '{"metadata":null}', '{"metadata":{"foo":"bar"}}', '{"metadata":{"dbt_schema_version":5}}', '{"metadata":{"dbt_schema_version":""}}', "null", "[]", "5"])
def test_documents_without_metadata(spark, text):
    df = frame(spark, text)
    assert errors(parse(df, "manifest")) == ["Not a manifest.json"]
    assert errors(parse_version(df, "manifest", 2)) == ["Not a manifest.json v2"]


def test_versions(spark):
    df = frame(spark, body("manifest", 12), body("manifest", 99), body("catalog", 1), body("manifest", 1), body("manifest", "0"), body("manifest", "01"), None, "{")
    assert errors(parse(df, "manifest")) == [None, "Unsupported manifest version: 99", "Not a manifest.json", None, "Unsupported manifest version: 0", "Not a manifest.json v1", "Not a manifest.json", "Malformed JSON"]
    assert errors(parse(frame(spark, body("catalog", 2), body("sources", 4), body("run-results", 6)), "catalog")) == ["Unsupported catalog version: 2", "Not a catalog.json", "Not a catalog.json"]
    assert errors(parse(frame(spark, body("sources", 4)), "sources")) == ["Unsupported sources version: 4"]


def test_odd_ends_pass_only_pinned_parsers(spark):
    odd = [json.dumps({"metadata": {"dbt_schema_version": f"{URL}/manifest/v1.json{end}"}}) for end in ("?x", "\n", "")]
    assert errors(manifests.parse(frame(spark, *odd))) == ["Not a manifest.json", "Not a manifest.json", None]
    assert errors(manifests.parse_v1(frame(spark, *odd))) == [None, None, None]
    assert errors(manifests.parse_v12(frame(spark, *odd))) == ["Not a manifest.json v12"] * 3


@pytest.mark.parametrize("module, top", [(manifests, 12), (catalogs, 1), (runs, 6), (freshnesses, 3)])
def test_each_version_has_a_parser(spark, module, top):
    assert module.LATEST_VERSION == top
    df = frame(spark, *[body(module.KIND, v) for v in range(1, top + 1)])
    assert errors(module.parse(df)) == [None] * top
    for v in range(1, top + 1):
        got = errors(getattr(module, f"parse_v{v}")(df))
        assert [e is None for e in got] == [n == v for n in range(1, top + 1)]


def test_strict_raises_and_lenient_keeps_the_document(spark):
    good, bad = body("manifest", 3, nodes={}), body("manifest", 77)
    assert parse(frame(spark, good), "manifest", strict=True).first().body == good
    assert parse(frame(spark, bad), "manifest").first().body == bad
    with pytest.raises(Exception, match="Unsupported manifest version: 77"):
        parse(frame(spark, bad), "manifest", strict=True).select("body").collect()


def test_detect(spark):
    df = detect(frame(spark, body("sources", 3), body("run-results", 9), "{}", "{", None))
    got = [(r.kind, r.version, r.error) for r in df.orderBy("artifact_id").collect()]
    assert got == [("sources", 3, None), ("run-results", None, "Unsupported run-results version: 9"), (None, None, "Not an artifact"), (None, None, "Malformed JSON"), (None, None, "Not an artifact")]


def test_run_results(spark):
    one = {"unique_id": "m", "status": "success", "message": 7, "execution_time": 1.5, "thread_id": "T", "timing": [{"name": "compile", "started_at": "2024-01-01T00:00:00.5Z", "completed_at": "2024-01-01T00:00:02Z"}, {"name": "execute", "started_at": None, "completed_at": "x"}]}
    two = {"unique_id": "t", "status": "fail", "message": "no", "failures": 3, "batch_results": {"successful": [["a", "b"]], "failed": []}, "overload_results": {"successful": ["f(int)"], "failed": ["f(text)"]}}
    df = frame(spark, body("run-results", 6, elapsed_time=2.0, results=[one, two]), body("run-results", 1, results=[]), None)
    got = run_results.run_results(df).orderBy("pos").collect()
    assert [(r.unique_id, r.status, r.message, r.failures) for r in got] == [("m", "success", "7", None), ("t", "fail", "no", 3)]
    assert [(r.name, r.seconds) for r in run_results.run_timings(df).orderBy("pos").collect()] == [("compile", 1.5), ("execute", None)]
    assert [(r.outcome, r.batch) for r in run_results.run_batches(df).collect()] == [("successful", ["a", "b"])]
    assert sorted((r.outcome, r.overload) for r in run_results.run_overloads(df).collect()) == [("failed", "f(text)"), ("successful", "f(int)")]
    assert sorted((r.artifact_id, r.n_results) for r in run_results.run_totals(df).collect()) == [("0", 2), ("1", 0), ("2", 0)]
    assert {r.status: r.n_failures for r in run_results.status_totals(run_results.run_results(df)).collect()} == {"success": 0, "fail": 3}


def test_catalog(spark):
    stat = {"id": "s", "label": "S", "include": True}
    node = {"metadata": {"type": "TABLE", "schema": "s", "name": "n"}, "columns": {"c": {"type": "INT", "index": 1, "name": "c"}}, "stats": {"rows": stat | {"value": 5}, "has": stat | {"value": False}, "text": stat | {"value": "5"}, "none": stat | {"value": None}}}
    df = frame(spark, body("catalog", 1, nodes={"m": node}, sources={"s": node | {"stats": {}}}, errors=["one", "two"]), body("catalog", 1, nodes={}, sources={}, errors=None))
    assert sorted((r.origin, r.unique_id, r.name, r.owner) for r in catalog.catalog_tables(df).collect()) == [("nodes", "m", "n", None), ("sources", "s", "n", None)]
    assert sorted((r.origin, r.column, r.type, r["index"]) for r in catalog.catalog_columns(df).collect()) == [("nodes", "c", "INT", 1), ("sources", "c", "INT", 1)]
    assert {r.stat: (r.value, r.number) for r in catalog.catalog_stats(df).collect()} == {"rows": ("5", 5.0), "has": ("false", None), "text": ("5", None), "none": (None, None)}
    assert [(r.pos, r.error) for r in catalog.catalog_errors(df).orderBy("pos").collect()] == [(0, "one"), (1, "two")]


def test_freshness(spark):
    limits = {"warn_after": {"count": 1, "period": "minute"}, "error_after": {"count": 1, "period": "day"}}
    at = lambda s: {"unique_id": f"s{s}", "status": "pass", "max_loaded_at_time_ago_in_s": s, "criteria": limits}
    df = frame(spark, body("sources", 3, results=[at(60.0), at(61.0), at(86401.0), {"unique_id": "x", "status": "runtime error", "error": 4}]), body("sources", 1, results=[]))
    got = freshness.freshness(df).withColumn("judged", freshness.freshness_status(F.col("ago_s"), F.col("criteria"))).orderBy("pos").collect()
    assert [(r.judged, r.error) for r in got] == [("pass", None), ("warn", None), ("error", None), (None, "4")]  # an age that is not known is not judged


def test_manifest_forms(spark):
    old = {"resource_type": "test", "raw_sql": "select 1", "refs": [["p", "a"], ["b"]], "tags": "x", "depends_on": {"nodes": ["a", "b"], "macros": ["m"]}, "columns": {"c": {"data_type": "INT", "tags": ["t"]}}}
    new = {"resource_type": "test", "raw_code": "select 2", "refs": [{"name": "a", "package": None, "version": 2}], "test_metadata": {"name": "unique"}}
    semantic_model = {"name": "s", "entities": [{"name": "e", "type": "primary"}], "measures": [{"name": "m", "agg": "sum"}], "dimensions": [{"name": "d", "type": "time", "type_params": {"time_granularity": "day"}}]}
    parts = dict(nodes={"old": old, "new": new}, parent_map={"b": ["a"]}, child_map={"a": ["b"]}, group_map={"g": ["n"]}, semantic_models={"s": semantic_model}, selectors={"sel": {"definition": "x"}}, disabled={"d": [{"resource_type": "model", "name": "one"}, {"name": "two"}]}, macros={"macro.a": {"name": "a", "macro_sql": "{% %}"}})
    df = frame(spark, body("manifest", 12, **parts), body("manifest", 1))
    nodes = {r.unique_id: (r.raw_code, r.tags, r.test_kind) for r in manifest.nodes(df).collect()}
    assert nodes == {"old": ("select 1", ["x"], "singular"), "new": ("select 2", None, "generic")}
    assert sorted(((r.unique_id, r.pos, r.name, r.package, r.version) for r in manifest.node_refs(df).collect()), key=repr) == [("new", 0, "a", None, "2"), ("old", 0, "a", "p", None), ("old", 1, "b", None, None)]
    assert [(r.column, r.data_type, r.tags) for r in manifest.node_columns(df).collect()] == [("c", "INT", ["t"])]
    assert sorted((r.parent, r.child, r.origin) for r in manifest.edges(df).collect()) == [("a", "b", "child_map"), ("a", "b", "parent_map"), ("a", "old", "depends_on"), ("b", "old", "depends_on"), ("g", "n", "group_map"), ("m", "old", "depends_on")]
    assert [r.type for r in manifest.semantic_parts(df, "entities").collect()] == ["primary"]
    assert [r.agg for r in manifest.semantic_parts(df, "measures").collect()] == ["sum"]
    assert [r.time_granularity for r in manifest.semantic_parts(df, "dimensions").collect()] == ["day"]
    assert [r.name for r in manifest.selectors(df).collect()] == ["sel"]
    assert [(r.pos, r.resource_type, r.name) for r in manifest.disabled(df).orderBy("pos").collect()] == [(0, "model", "one"), (1, None, "two")]
    assert [r.macro_sql for r in manifest.table(df, "macros").collect()] == ["{% %}"]


@pytest.mark.parametrize("root", sorted(manifest.FIELDS))
def test_each_root_is_a_table(spark, root):
    df = frame(spark, body("manifest", 12, **{root: {"k": {"name": "n", "resource_type": "r"}}}), body("manifest", 12, **{root: None}), body("manifest", 12))
    assert [(r.artifact_id, r.unique_id, r["name"]) for r in manifest.table(df, root).collect()] == [("0", "k", "n")]


def test_lineage_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("c", "d"), (None, "x")], "parent string, child string")
    got = {(r.ancestor, r.descendant): r.depth for r in lineage.closure(edges).collect()}
    assert got == {("a", "b"): 1, ("b", "c"): 1, ("c", "a"): 1, ("c", "d"): 1, ("a", "c"): 2, ("b", "a"): 2, ("b", "d"): 2, ("c", "b"): 2, ("a", "d"): 3, ("a", "a"): 3, ("b", "b"): 3, ("c", "c"): 3}
    assert lineage.closure(edges.limit(0)).count() == 0


def test_closure_has_no_limit_but_a_given_one(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(53)], "parent long, child long").coalesce(1)
    assert lineage.closure(chain).where("ancestor = 0 and descendant = 53").count() == 1
    assert lineage.closure(chain, most=3).agg({"depth": "max"}).first()[0] == 3


def test_generic_tests(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (2, None), (None, "z")], "k int, v string")
    to = spark.createDataFrame([(1,)], "id int")
    assert checks.not_null(df, "v").count() == 1
    assert [tuple(r) for r in checks.unique(df, "k").collect()] == [(1, 2)]
    assert sorted(r.value for r in checks.accepted_values(df, "v", ["x"]).collect()) == ["y", "z"]
    assert [r.k for r in checks.relationships(df, "k", to, "id").collect()] == [2]
    got = checks.summary("t", checks.not_null(df, "v"), severity="error", warn_if="> 0", error_if="> 5").first()
    assert tuple(got) == ("t", 1, "warn")
    assert checks.summary("t", checks.not_null(df, "v"), severity="warn").first().status == "warn"
    assert checks.summary("t", df.limit(0)).first().status == "pass"
    assert checks.summary("t", df, limit=2).first().failures == 2


def test_semantic(spark):
    df = spark.createDataFrame([("2024-01-01", 1.0, True), ("2024-01-01", 3.0, False), ("2024-03-01", 5.0, True)], "d string, x double, ok boolean").withColumn("d", F.to_timestamp("d"))
    aggs = {"sum": 9.0, "min": 1.0, "max": 5.0, "count": 3, "average": 3.0, "count_distinct": 3, "median": 3.0}
    got = df.agg(*[semantic.measure(a, "x").alias(a) for a in aggs], semantic.measure("sum_boolean", "ok").alias("b"), semantic.measure("percentile", "x", 0.25).alias("c"), semantic.measure("percentile", "x", 0.25, discrete=True).alias("e")).first()
    assert {a: got[a] for a in aggs} == aggs and (got.b, got.c, got.e) == (2, 2.0, 1.0)
    with pytest.raises(ValueError):
        semantic.measure("mode", "x")
    assert semantic.ratio(df, "r", F.sum("x"), F.lit(0)).first().r is None
    month = [semantic.grain(F.col("d"), "month").alias("month")]
    totals = semantic.filled(semantic.simple(df, "n", "count", "x", month, ["x > 0"]), "month", "n", "month")
    assert [r.n for r in totals.orderBy("month").collect()] == [2, 0, 1]
    assert [r.s for r in semantic.cumulative(totals, "s", "n", "month").orderBy("month").collect()] == [2, 2, 3]
    assert [r.s for r in semantic.cumulative(totals, "s", "n", "month", window_days=31).orderBy("month").collect()] == [2, 0, 1]
    got = semantic.saved_query(df, {"total": F.sum("x")}, [F.col("ok")], ["x > 1"], [F.desc("total")], 1).collect()
    assert [(r.ok, r.total) for r in got] == [(True, 5.0)]


def test_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "manifest_1.json").write_text(body("manifest", 12))
    (tmp_path / "run_results.json").write_text(body("run-results", 6) + "\n")
    (tmp_path / "note.txt").write_text("no")
    assert read_artifacts(spark, str(tmp_path)).count() == 2
    assert errors(parse(read_artifacts(spark, str(tmp_path), "manifest").withColumn("artifact_id", F.lit("0")), "manifest")) == [None]
    assert read_artifacts(spark, str(tmp_path / "missing")).count() == 0
    write_table(read_artifacts(spark, str(tmp_path)), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_paths(tmp_path):
    assert artifact_path(str(tmp_path), "run-results", 6, "shop", "a.json") == str(tmp_path / "run_results" / "v6" / "shop" / "a.json")
    assert artifact_path(str(tmp_path), "manifest", "v1", "shop", "a.json").endswith("/manifest/v1/shop/a.json")
    for bad in ("", "..", "a/b", "a\\b", "x..y"):
        with pytest.raises(ValueError):
            check_name(bad)
    assert clean_name("../a\\b") == "ab"


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "catalog.json").write_text(body("catalog", 1))
    q = watch(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.kind, r.version, r.error) for r in spark.table("seen").collect()] == [("catalog", 1, None)]


def test_documents_are_loaded_by_kind_version_project_and_file(spark, tmp_path):
    import lodestone
    from lodestone.sources.artifacts import load_manifest, load_run_results

    folder = tmp_path / "manifest" / "v12" / "shop one"
    folder.mkdir(parents=True)
    (folder / "manifest.json").write_text('{"metadata":{"dbt_schema_version":"x/manifest/v12.json"},"nodes":{}}')
    (folder / "manifest_1.8.json").write_text('{"metadata":{"dbt_schema_version":"x/manifest/v11.json"}}')
    got = load_manifest(spark, str(tmp_path), version=12, project="shop one").collect()
    assert [(r.version, r.error) for r in got] == [(12, None)]
    other = load_manifest(spark, str(tmp_path), version="v12", project="shop one", filename="manifest_1.8.json").first()
    assert other.error == "Not a manifest.json v12"
    assert load_run_results(spark, str(tmp_path), version=6, project="none").count() == 0
    with pytest.raises(ValueError):
        check_name("  ")
    assert lodestone.parse_manifest is lodestone.manifest.parse and lodestone.LATEST["manifest"] == 12


def test_metadata_of_odd_documents(spark):
    from lodestone.operators.manifest import containers as containers_of
    from lodestone.operators.metadata import metadata_table as metadata_of

    bodies = ['{"metadata":{"invocation_id":"i","env":{"A":"1"},"generated_at":"no time"}}', '{"metadata":[1]}', "{}", "null", None, '{"a']
    docs = spark.createDataFrame(list(enumerate(bodies)), "artifact_id long, body string")
    got = {r.artifact_id: r for r in metadata_of(docs).collect()}
    assert len(got) == 6 and got[0].invocation_id == "i" and got[0].env == {"A": "1"} and got[0].generated_ts is None
    assert all(got[i].invocation_id is None for i in range(1, 6))
    assert {(r.key, r.container) for r in containers_of(docs).collect()} == {("metadata", "object"), ("metadata", "array")}


def test_snapshots_by_update_time_and_exports(spark):
    from lodestone.operators import snapshot as s
    from lodestone.sources.artifacts import export

    old = spark.createDataFrame([(1, None, "2024-01-01"), (2, "b", "2024-01-01")], "id int, v string, at string")
    new = spark.createDataFrame([(1, "a", "2024-01-01"), (2, None, "2024-03-01"), (3, "c", "2024-02-01")], "id int, v string, at string")
    got = s.snapshot(s.start(old, F.lit("2024-01-01")), new, "id", F.lit("2024-04-01"), updated_at="at")
    rows = {(r.id, r.v, str(r.valid_from)[:10], str(r.valid_to)[:10]) for r in got.collect()}
    assert rows == {(1, None, "2024-01-01", "None"), (2, "b", "2024-01-01", "2024-03-01"), (2, None, "2024-03-01", "None"), (3, "c", "2024-02-01", "None")}
    again = s.snapshot(got, new, "id", F.lit("2024-05-01"), updated_at="at")
    assert again.count() == got.count()
    checked = s.snapshot(s.start(old, F.lit("2024-01-01")), new, "id", F.lit("2024-04-01"), check=["v"], close_missing=True)
    assert checked.where("id = 1").count() == 2
    export(new, "kept_view", "view")
    assert spark.table("kept_view").count() == 3
    with pytest.raises(ValueError):
        export(new, "x", "file")


def test_lineage_of_a_long_chain(spark):
    from lodestone.operators import lineage

    edges = spark.createDataFrame([(a, f"n{i}", f"n{i + 1}") for a in ("x", "y") for i in range(12)], "artifact_id string, parent string, child string")
    got = lineage.closure(edges.where("not (artifact_id = 'y' and parent = 'n5')"), keys=("artifact_id",))
    assert {(r.artifact_id, r["n"]) for r in got.groupBy("artifact_id").agg(F.count("*").alias("n")).collect()} == {("x", 78), ("y", 15 + 21)}


def test_totals_beside_results_parse_documents_once(spark):
    from lodestone.plans import queries

    df = frame(spark, body("run-results", 6, elapsed_time=2.0, results=[{"unique_id": "m", "message": 7}, {"unique_id": "t"}]), body("run-results", 1, results=[]), body("run-results", 6), None, "{")
    got = run_results.run_results(df.withColumn("kept", F.lit(1)), keep=("kept",), totals=True)
    assert [(r.artifact_id, r.kept, r.elapsed_time, r.n_results, r.pos, r.unique_id, r.message) for r in got.orderBy("pos").collect()] == [("0", 1, 2.0, 2, 0, "m", "7"), ("0", 1, 2.0, 2, 1, "t", None)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    # Sizes of documents are guessed too small, so a join of all with all was broadcast.
    plan = queries.queries()["run_first_results"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan


def test_parsers_share_one_reading(spark):
    from lodestone.functions.detect import read
    from lodestone.plans import queries

    df = frame(spark, body("manifest", 3), body("manifest", 77), body("sources", 2), "{}", "{", None, "null")
    for parser in (manifests.parse, manifests.parse_v3, freshnesses.parse, freshnesses.parse_v1):
        told = [tuple(r) for r in parser(df).orderBy("artifact_id").collect()]
        assert [tuple(r) for r in parser(read(df), known="facts").drop("facts").orderBy("artifact_id").collect()] == told
    plan = queries.queries()["entry_points"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
    assert plan.collectLeaves().size() == 1
