"""Manifests of all versions as tables. Input: artifact_id, body.

The parts whose shape differs between versions stay variants; columns are taken from whichever form is present.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Root keys of manifests, and the fields of each that are columns (name, path, type).
FIELDS = {
    "nodes": "resource_type name database schema package_name path original_file_path alias language description compiled:boolean relation_name access version group docs.node_color checksum.checksum config.materialized config.enabled:boolean config.incremental_strategy config.on_schema_change config.freshness.build_after.count:bigint config.freshness.build_after.period config.freshness.build_after.updates_on config.event_time config.batch_size config.begin config.lookback:bigint config.concurrent_batches:boolean contract.enforced:boolean created_at:double fqn:array<string> root_path",
    "sources": "resource_type name source_name identifier database schema package_name loader loaded_at_field relation_name description fqn:array<string> freshness:variant external:variant external.location external.file_format external.row_format external.tbl_properties external.partitions:variant created_at:double",
    "macros": "resource_type name package_name path macro_sql description arguments:variant created_at:double",
    "docs": "resource_type name package_name path block_contents",
    "groups": "resource_type name package_name path owner.name owner.email:variant",
    "exposures": "resource_type name package_name type maturity url description label owner.name owner.email:variant fqn:array<string>",
    "metrics": "resource_type name package_name type label description type_params:variant filter:variant calculation_method expression timestamp model created_at:double",
    "semantic_models": "resource_type name package_name model description primary_entity node_relation.relation_name node_relation.alias node_relation.schema_name",
    "saved_queries": "resource_type name package_name label description query_params:variant exports:variant",
    "unit_tests": "resource_type name package_name model given:variant expect:variant description",
    "functions": "resource_type name package_name description arguments:variant returns:variant overloads:variant config.type config.volatility",
}


def entries(docs: DataFrame, root: str) -> DataFrame:
    """A row for each key under a root key: artifact_id, pos (in the document, from 0), unique_id, value. Missing roots
    give none."""
    got = F.from_json("body", f"`{root}` map<string,variant>")[root]
    return docs.select("artifact_id", F.posexplode(got).alias("pos", "unique_id", "value"))


def containers(docs: DataFrame) -> DataFrame:
    """The root keys of each document and what each holds: object, array, null or value."""
    each = docs.select("artifact_id", F.explode(F.from_json("body", "map<string,variant>")).alias("key", "value"))
    kind = F.schema_of_variant("value")
    told = F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(F.is_variant_null("value") | F.col("value").isNull(), "null").otherwise("value")
    return each.select("artifact_id", "key", told.alias("container"))


def _get(value: str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(value, f"$.{path}", kind)


def text_list(value: str, path: str) -> Column:
    """A list of strings that may be written as one string; null if absent."""
    one = _get(value, path)
    return F.coalesce(_get(value, path, "array<string>"), F.when(one.isNotNull(), F.array(one)))


def table(docs: DataFrame, root: str) -> DataFrame:
    """The documents' entries of a root key as columns; value holds each whole."""
    out = [F.col("artifact_id"), F.col("unique_id")]
    for field in FIELDS[root].split():
        path, _, kind = field.partition(":")
        out.append(_get("value", path, kind or "string").alias(path.replace(".", "_")))
    return entries(docs, root).select(*out, "value")


def nodes(docs: DataFrame) -> DataFrame:
    """All nodes: raw and compiled code under either name, tags as a list, and the kind of a test."""
    code = [F.coalesce(_get("value", f"{a}_code"), _get("value", f"{a}_sql")).alias(f"{a}_code") for a in ("raw", "compiled")]
    test = F.when(F.col("resource_type") == "test", F.when(_get("value", "test_metadata", "variant").isNotNull(), "generic").otherwise("singular"))
    return table(docs, "nodes").select("*", *code, text_list("value", "tags").alias("tags"), test.alias("test_kind"), text_list("value", "config.unique_key").alias("config_unique_key"))


def node_columns(docs: DataFrame, root: str = "nodes") -> DataFrame:
    each = entries(docs, root).select("artifact_id", "unique_id", F.explode(_get("value", "columns", "map<string,variant>")).alias("column", "value"))
    return each.select("artifact_id", "unique_id", "column", *[_get("value", c).alias(c) for c in ("data_type", "description")], text_list("value", "tags").alias("tags"), *[_get("value", c, "variant").alias(c) for c in ("constraints", "dimension", "entity", "meta")])


def node_refs(docs: DataFrame) -> DataFrame:
    """References of nodes, whether written as lists (package and name, or name) or as objects."""
    each = entries(docs, "nodes").select("artifact_id", "unique_id", F.posexplode(_get("value", "refs", "array<variant>")).alias("pos", "ref"))
    listed = F.try_variant_get("ref", "$", "array<string>")
    return each.select("artifact_id", "unique_id", "pos", F.coalesce(F.element_at(listed, -1), _get("ref", "name")).alias("name"), F.coalesce(F.when(F.size(listed) > 1, listed[0]), _get("ref", "package")).alias("package"), _get("ref", "version").alias("version"))


def edges(docs: DataFrame) -> DataFrame:
    """Edges parent, child from depends_on of all entries and from the maps of parents, children and groups."""
    depending = ("nodes", "exposures", "metrics", "semantic_models", "saved_queries", "unit_tests", "functions")
    maps = ("parent_map", "child_map", "group_map")
    kinds = [*(f"{r} map<string,struct<depends_on:struct<nodes:array<string>,macros:array<string>>>>" for r in depending), *(f"{m} map<string,array<string>>" for m in maps)]

    def listed(entries_: Column, items, down: bool, origin: str) -> Column:
        """(parent, child, origin) for each item of each entry of a map."""
        pair = lambda e: lambda x: F.struct((x if down else e["key"]).alias("parent"), (e["key"] if down else x).alias("child"), F.lit(origin).alias("origin"))
        return F.flatten(F.transform(F.coalesce(F.map_entries(entries_), F.array()), lambda e: F.coalesce(F.transform(items(e["value"]), pair(e)), F.array())))

    # The body is parsed once, to the roots that hold edges; one array of all edges is exploded.
    got = docs.select("artifact_id", F.from_json("body", ", ".join(kinds)).alias("m"))
    arrays = [listed(F.col(f"m.{r}"), lambda v, w=w: v["depends_on"][w], True, "depends_on") for r in depending for w in ("nodes", "macros")]
    arrays += [listed(F.col(f"m.{m}"), lambda v: v, m == "parent_map", m) for m in maps]
    return got.select("artifact_id", F.inline(F.concat(*arrays)))


_CONSTRAINT = ("type", "name", "expression", "to")


def constraints(docs: DataFrame, root: str = "nodes") -> DataFrame:
    """Constraints of nodes (column is null; columns lists those named) and of their columns, with whether the contract is enforced."""
    each = lambda of, list_: F.transform(F.coalesce(list_, F.array()), lambda c: F.struct(of.cast("string").alias("column"), c.alias("value")))
    own = each(F.lit(None), _get("value", "constraints", "array<variant>"))
    inner = F.transform(F.coalesce(F.map_entries(_get("value", "columns", "map<string,variant>")), F.array()), lambda e: each(e["key"], F.try_variant_get(e["value"], "$.constraints", "array<variant>")))
    enforced = F.coalesce(_get("value", "contract.enforced", "boolean"), F.lit(False))
    found = entries(docs, root).select("artifact_id", "unique_id", enforced.alias("enforced"), F.inline(F.concat(own, F.flatten(inner))))
    warns = [_get("value", c, "boolean").alias(c) for c in ("warn_unenforced", "warn_unsupported")]
    return found.select("artifact_id", "unique_id", "enforced", "column", *[_get("value", c).alias(c) for c in _CONSTRAINT], *warns, _get("value", "columns", "array<string>").alias("columns"), _get("value", "to_columns", "array<string>").alias("to_columns"))


def unit_test_rows(docs: DataFrame) -> DataFrame:
    """What unit tests give and expect: part (given or expect), pos, input, format, rows (a variant)."""
    told = lambda part, pos, value: F.struct(F.lit(part).alias("part"), pos.alias("pos"), value.alias("value"))
    given = F.transform(F.coalesce(_get("value", "given", "array<variant>"), F.array()), lambda x, i: told("given", i, x))
    expect = F.array(told("expect", F.lit(0), _get("value", "expect", "variant")))
    each = entries(docs, "unit_tests").select("artifact_id", "unique_id", F.inline(F.concat(given, expect))).where("part = 'given' or value is not null")
    return each.select("artifact_id", "unique_id", "part", "pos", _get("value", "input").alias("input"), _get("value", "format").alias("format"), _get("value", "rows", "variant").alias("rows"))


def semantic_parts(docs: DataFrame, part: str) -> DataFrame:
    """Entities, measures or dimensions of semantic models."""
    each = entries(docs, "semantic_models").select("artifact_id", "unique_id", F.posexplode(_get("value", part, "array<variant>")).alias("pos", "value"))
    names = {"entities": ("name", "type", "expr", "role"), "measures": ("name", "agg", "expr", "agg_time_dimension"), "dimensions": ("name", "type", "expr", "type_params.time_granularity")}[part]
    return each.select("artifact_id", "unique_id", "pos", *[_get("value", n).alias(n.split(".")[-1]) for n in names], "value")


def selectors(docs: DataFrame) -> DataFrame:
    return entries(docs, "selectors").withColumnRenamed("unique_id", "name")


def disabled(docs: DataFrame) -> DataFrame:
    """Disabled entries: each id has a list of them."""
    got = docs.select("artifact_id", F.explode(F.from_json("body", "disabled map<string,array<variant>>")["disabled"]).alias("unique_id", "list"))
    each = got.select("artifact_id", "unique_id", F.posexplode("list").alias("pos", "value"))
    return each.select("artifact_id", "unique_id", "pos", _get("value", "resource_type").alias("resource_type"), _get("value", "name").alias("name"), "value")
