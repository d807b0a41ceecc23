"""Parts of documents that become columns: runs' arguments and responses, microbatch settings, external tables, constraints."""

import json

from lodestone.operators import catalog, manifest, run_results


def docs(spark, *bodies):
    return spark.createDataFrame([(str(i), json.dumps(b)) for i, b in enumerate(bodies)], "artifact_id string, body string")


def test_arguments_and_responses_of_runs(spark):
    run = {"args": {"which": "run", "threads": 4, "quiet": False, "none": None}, "results": [{"unique_id": "a", "adapter_response": {"_message": "SELECT 99", "code": "SELECT", "rows_affected": 99, "bytes_processed": 3254}}, {"unique_id": "b", "adapter_response": {}}, {"unique_id": "c"}]}
    got = docs(spark, run, {"results": []}, {})
    assert {r.name: r.value for r in run_results.run_args(got).collect()} == {"which": "run", "threads": "4", "quiet": "false", "none": None}
    told = {r.unique_id: (r.response, r.code, r.rows_affected, r.bytes_processed, r.query_id) for r in run_results.adapter_responses(got).collect()}
    assert told == {"a": ("SELECT 99", "SELECT", 99, 3254, None), "b": (None,) * 5, "c": (None,) * 5}


def test_batches_and_overloads_of_results(spark):
    run = {"results": [{"unique_id": "a", "batch_results": {"successful": [["x", "y"], ["y", "z"]], "failed": [["z", "w"]]}, "overload_results": {"successful": ["f"], "failed": None}}, {"unique_id": "b", "batch_results": None}]}
    df = docs(spark, run)
    assert [tuple(r)[1:] for r in run_results.run_batches(df).orderBy("result_pos", "outcome", "pos").collect()] == [(0, "failed", 0, ["z", "w"]), (0, "successful", 0, ["x", "y"]), (0, "successful", 1, ["y", "z"])]
    assert [tuple(r)[1:] for r in run_results.run_overloads(df).collect()] == [(0, "successful", 0, "f")]
    plan = run_results.run_batches(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1 and plan.count("LogicalRDD") == 1


def test_microbatch_settings_and_external_tables(spark):
    body = {"nodes": {"m": {"config": {"event_time": "at", "batch_size": "day", "begin": "2024-01-01", "lookback": 2, "concurrent_batches": True}}}, "sources": {"s": {"external": {"location": "s3://x", "file_format": "parquet", "row_format": "r", "tbl_properties": "p", "partitions": [{"name": "d"}]}}, "t": {"external": None}}}
    df = docs(spark, body)
    r = manifest.nodes(df).first()
    assert (r.config_event_time, r.config_batch_size, r.config_begin, r.config_lookback, r.config_concurrent_batches) == ("at", "day", "2024-01-01", 2, True)
    got = {r.unique_id: (r.external_location, r.external_file_format, r.external_row_format, r.external_tbl_properties, r.external_partitions is None) for r in manifest.table(df, "sources").collect()}
    assert got == {"s": ("s3://x", "parquet", "r", "p", False), "t": (None, None, None, None, True)}


def test_documents_are_parsed_once_for_each_table(spark):
    body = {"nodes": {"m": {"constraints": [{"type": "unique", "columns": ["a"], "warn_unenforced": True, "warn_unsupported": False}], "columns": {"a": {"constraints": [{"type": "not_null"}]}, "b": {}}}, "n": {}}, "sources": {"s": {"stats": {}}}, "unit_tests": {"u": {"given": [{"input": "x"}, {"input": "y", "format": "csv", "rows": "a"}], "expect": {"format": "dict", "rows": []}}, "v": {"given": None}}}
    df = docs(spark, body, {"nodes": {"k": {"columns": {"c": {"type": "INT", "index": 1}}}}}, {})
    assert sorted((r.unique_id, r.column or "", r.type, r.warn_unenforced) for r in manifest.constraints(df).collect()) == [("m", "", "unique", True), ("m", "a", "not_null", None)]
    assert sorted((r.unique_id, r.part, r.pos, r.input or "") for r in manifest.unit_test_rows(df).collect()) == [("u", "expect", 0, ""), ("u", "given", 0, "x"), ("u", "given", 1, "y")]
    assert sorted((r.origin, r.unique_id) for r in catalog.catalog_tables(df).collect()) == [("nodes", "k"), ("nodes", "m"), ("nodes", "n"), ("sources", "s")]
    for table in (manifest.constraints(df), manifest.unit_test_rows(df), catalog.catalog_tables(df)):
        plan = table._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json") == 1 and plan.count("LogicalRDD") == 1


def test_percentiles_by_ranges_of_values(spark):
    import random

    from lodestone.operators import semantic

    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1.5, 2.0, -3.0, None, rng.random()])) for _ in range(300)] + [("one", 7.0), ("none", None), ("two", 1.0), ("two", 2.0)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    wanted = {"n": ("count", "x", {}), "mid": ("median", "x", {}), "low": ("percentile", "x * 2", {"percentile": 0.0}), "most": ("percentile", "x", {"percentile": 0.9}), "disc": ("percentile", "x", {"percentile": 0.9, "discrete": True}), "near": ("percentile", "x", {"percentile": 0.4, "approximate": True}), "d": ("count_distinct", "x", {})}
    for by in (["g"], []):
        got = semantic.measures(df, by, wanted)
        want = df.groupBy(*by).agg(*[semantic.measure(a, e, **k).alias(n) for n, (a, e, k) in wanted.items()])
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
        # No aggregate holds all values of a group.
        assert "percentile(" not in got._jdf.queryExecution().optimizedPlan().toString() and "median(" not in got._jdf.queryExecution().optimizedPlan().toString()
