"""What a manifest declares about tables, run: tests, constraints, contracts, unit tests, freshness, snapshots, exports.

Input: artifact_id, body of one manifest. Declarations are read to the driver, as they tell what plans are made.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import checks, snapshot
from .freshness import freshness_status
from .manifest import entries
from .rules import Rule, Tables, failures, table_of

#: How code and declarations name a table: ref('name'), ref('package', 'name') or source('source', 'name').
NAMED = re.compile(r"""(?:ref|source)\(\s*(?:['"][^'"]*['"]\s*,\s*)?['"]([^'"]+)['"][^)]*\)""")


def listed(docs: DataFrame, root: str) -> dict[str, dict]:
    """The entries of a root key of one manifest, by id. These are declarations, which tell what plan is made."""
    rows = entries(docs, root).select("artifact_id", "unique_id", F.to_json("value").alias("value")).collect()
    if len({r.artifact_id for r in rows}) > 1:
        raise ValueError("Declarations of several manifests")
    return {r.unique_id: json.loads(r.value) for r in rows}


def named(said: str) -> str:
    """The table that a text names by ref, source or its own name, which may be qualified and quoted."""
    found = NAMED.search(said)
    return found[1] if found else said.strip().split(".")[-1].strip("`\"' ")


def model_of(test: Mapping, nodes: Mapping[str, Mapping]) -> str:
    """The name of the table that a generic test looks at."""
    kwargs = test["test_metadata"].get("kwargs") or {}
    if test.get("attached_node"):
        node = nodes.get(test["attached_node"], {})
        return node.get("name") or test["attached_node"].split(".")[-1]
    if kwargs.get("model"):
        return named(kwargs["model"])
    ids = (test.get("depends_on") or {}).get("nodes") or []
    if not ids:
        raise ValueError(f"A test of no table: {test.get('name')}")
    return ids[-1].split(".")[-1]


def test_rule(id_: str, test: Mapping, nodes: Mapping[str, Mapping]) -> Rule:
    """A generic test as a rule; the arguments of newer manifests may be below `arguments`."""
    meta = test["test_metadata"]
    kwargs = {**(meta.get("kwargs") or {}), **((meta.get("kwargs") or {}).get("arguments") or {})}
    column = kwargs.get("column_name") or test.get("column_name")
    table, where = model_of(test, nodes), (test.get("config") or {}).get("where")
    if not column:
        raise ValueError(f"A test of no column: {id_}")
    kind = meta.get("name")
    if kind in ("not_null", "unique"):
        return Rule(id_, table, kind, (column,), where)
    if kind == "accepted_values":
        return Rule(id_, table, "accepted", (column,), where, values=tuple(kwargs["values"]))
    if kind == "relationships":
        return Rule(id_, table, "key", (column,), where, to=named(kwargs["to"]), to_columns=(kwargs["field"],))
    raise ValueError(f"Unknown generic test: {kind}")


def run_tests(docs: DataFrame, tables: Tables) -> DataFrame:
    """Columns unique_id, status, failures, message, one row for each enabled generic test, in the form of run results.

    Failing rows are counted as the test's kind does: rows for not_null and relationships, values for unique and
    accepted_values; with the fail_calc sum(n_records), rows of such values. Its limit bounds the count. The
    severity, warn_if and error_if of its configuration give pass, warn or fail. Generic tests of other kinds, and other
    fail_calc, are refused. All generic tests of a table share one scan of it; a singular test is a query of its own, of
    which each row is a failure.
    """
    nodes = listed(docs, "nodes")
    on = lambda n: (n.get("config") or {}).get("enabled", True)
    tests = {i: n for i, n in nodes.items() if n.get("test_metadata") and on(n)}
    singular = {i: n for i, n in nodes.items() if n.get("resource_type") == "test" and not n.get("test_metadata") and on(n)}
    spark = docs.sparkSession
    kind = "unique_id string, severity string, warn_if string, error_if string, calc string, most long, by_value boolean"
    rows = []
    for i, t in {**tests, **singular}.items():
        c = t.get("config") or {}
        calc = re.sub(r"\s", "", c.get("fail_calc") or "count(*)").lower()
        if calc not in ("count(*)", "sum(n_records)"):
            raise ValueError(f"Unknown fail_calc: {c['fail_calc']}")
        by_value = i in tests and t["test_metadata"].get("name") in ("unique", "accepted_values") and calc == "count(*)"
        rows.append((i, (c.get("severity") or "error").lower(), c.get("warn_if") or "!= 0", c.get("error_if") or "!= 0", calc, c.get("limit"), by_value))
    said = spark.createDataFrame(rows, kind)
    found = failures(spark, [test_rule(i, t, nodes) for i, t in tests.items()], tables)
    for i, t in singular.items():
        found = found.unionByName(over_tables(spark, t, tables).agg(F.count("*").alias("groups")).select(F.lit(i).alias("rule"), "groups", F.col("groups").alias("n_rows")))
    met = said.join(found, said.unique_id == found.rule).withColumn("_failures", F.when(F.col("by_value"), F.col("groups")).otherwise(F.col("n_rows")))
    met = met.withColumn("_failures", F.least("_failures", F.coalesce("most", "_failures")))
    # Few different settings: each is one condition.
    status = F.lit(None).cast("string")
    for severity, warn_if, error_if in sorted({r[1:4] for r in rows}):
        same = (F.col("severity") == severity) & (F.col("warn_if") == warn_if) & (F.col("error_if") == error_if)
        status = F.when(same, checks.outcome(F.col("_failures"), severity, warn_if, error_if)).otherwise(status)
    message = F.when(F.col("status") != "pass", F.concat(F.lit("Got "), F.col("failures").cast("string"), F.when(F.col("failures") == 1, " result").otherwise(" results"), F.lit(", configured to "), F.when(F.col("status") == "warn", F.concat(F.lit("warn if "), F.col("warn_if"))).otherwise(F.concat(F.lit("fail if "), F.col("error_if")))))
    return met.select("unique_id", status.alias("status"), F.col("_failures").alias("failures"), "warn_if", "error_if").select("unique_id", "status", "failures", message.alias("message"))


def run_contracts(docs: DataFrame, tables: Tables) -> DataFrame:
    """Columns unique_id, column, declared, actual, problem: how tables depart from the enforced contracts of their models.

    problem is missing (the table lacks the column), undeclared (the model lacks it) or type. Types are compared as Spark
    names them; a column without a declared type may have any. Only schemas are read.
    """
    rows = []
    for id_, node in listed(docs, "nodes").items():
        if not (node.get("contract") or {}).get("enforced"):
            continue
        actual = {f.name.lower(): f.dataType.simpleString() for f in table_of(tables, node["name"]).schema}
        declared_ = {k.lower(): (types_of(node)[k] if v.get("data_type") else None) for k, v in (node.get("columns") or {}).items()}
        for name in sorted({*actual, *declared_}):
            want, have = declared_.get(name), actual.get(name)
            problem = "missing" if name not in actual else "undeclared" if name not in declared_ else "type" if want and _plain_type(want) != _plain_type(have) else None
            if problem:
                rows.append((id_, name, want, have, problem))
    return docs.sparkSession.createDataFrame(rows, "unique_id string, column string, declared string, actual string, problem string")


def _plain_type(kind: str) -> str:
    kind = re.sub(r"\s", "", kind.lower())
    return {"integer": "int", "long": "bigint", "short": "smallint", "byte": "tinyint", "real": "float", "decimal": "decimal(10,0)", "timestamp_ltz": "timestamp"}.get(kind, kind)


def run_freshness(docs: DataFrame, tables: Tables, now: str) -> DataFrame:
    """Columns unique_id, status, max_loaded_at, snapshotted_at, ago_s: how old the newest row of each source is.

    Sources are those with a loaded_at_field and a limit; rows count for which the declared filter holds. Status is
    pass, warn or error by the declared limits; a source without such a row is an error. Each table is scanned once.
    """
    limit = "struct<warn_after:struct<count:bigint,period:string>,error_after:struct<count:bigint,period:string>>"
    at, out = F.lit(now).cast("timestamp"), None
    for id_, source in listed(docs, "sources").items():
        told = source.get("freshness") or {}
        field = source.get("loaded_at_field")
        if not field or not any((told.get(k) or {}).get("count") for k in ("warn_after", "error_after")):
            continue
        time = F.expr(field).cast("timestamp")
        newest = table_of(tables, source.get("name")).agg(F.max(F.when(F.expr(told["filter"]), time) if told.get("filter") else time).alias("max_loaded_at"))
        ago = (F.unix_micros(at) - F.unix_micros("max_loaded_at")) / 1e6
        criteria = F.from_json(F.lit(json.dumps({k: told.get(k) for k in ("warn_after", "error_after")})), limit)
        status = F.when(F.col("max_loaded_at").isNull(), "error").otherwise(freshness_status(ago, criteria))
        row = newest.select(F.lit(id_).alias("unique_id"), status.alias("status"), "max_loaded_at", at.alias("snapshotted_at"), ago.alias("ago_s"))
        out = row if out is None else out.union(row)
    return docs.sparkSession.createDataFrame([], "unique_id string, status string, max_loaded_at timestamp, snapshotted_at timestamp, ago_s double") if out is None else out


def over_tables(spark: SparkSession, node: Mapping, tables: Tables) -> DataFrame:
    """The rows of a node's code over tables; code with control statements must be compiled."""
    code = node.get("raw_code") or node.get("raw_sql") or ""
    if "{%" in code:
        code = node.get("compiled_code") or node.get("compiled_sql") or code
    views = {}
    for k, name in enumerate(sorted({named(m[0]) for m in NAMED.finditer(code)})):
        views[name] = f"over_{uuid4().hex}_{k}"
        table_of(tables, name).createOrReplaceTempView(views[name])
    out = spark.sql(filled_in(code, views, {}))
    for view in views.values():  # the plan has been made
        spark.catalog.dropTempView(view)
    return out


def run_snapshot(docs: DataFrame, name: str, tables: Tables, at: str, history: DataFrame | None = None) -> DataFrame:
    """The history of a declared snapshot after its query is run over tables at a time; without a history, the first one.

    The strategy timestamp goes by updated_at, check by check_cols (a list, or all); keys of several columns are one key.
    Rows that are gone end with the strategy of hard deletes invalidate, or invalidate_hard_deletes.
    """
    found = [n for n in listed(docs, "nodes").values() if n.get("resource_type") == "snapshot" and n.get("name") == name]
    if not found:
        raise ValueError(f"Unknown snapshot: {name}")
    config = found[0]["config"]
    source, time = over_tables(docs.sparkSession, found[0], tables), F.lit(at).cast("timestamp")
    keys = [config["unique_key"]] if isinstance(config["unique_key"], str) else list(config["unique_key"])
    updated, strategy = config.get("updated_at"), config.get("strategy")
    if strategy not in ("timestamp", "check") or (strategy == "timestamp" and not updated):
        raise ValueError(f"Unknown strategy of a snapshot: {strategy}")
    if history is None:
        begins = F.col(updated) if strategy == "timestamp" else time
        return snapshot.start(source, begins)
    looked = config.get("check_cols")
    check = [c for c in source.columns if c not in keys] if looked in ("all", None) or looked == ["all"] else [looked] if isinstance(looked, str) else list(looked)
    gone = bool(config.get("invalidate_hard_deletes")) or config.get("hard_deletes") == "invalidate"
    if len(keys) == 1:
        return snapshot.snapshot(history, source, keys[0], time, None if strategy == "timestamp" else check, updated if strategy == "timestamp" else None, gone)
    one = F.to_json(F.struct(*[F.col(k) for k in keys]), {"ignoreNullFields": "false"})
    got = snapshot.snapshot(history.withColumn("_key", one), source.withColumn("_key", one), "_key", time, None if strategy == "timestamp" else check, updated if strategy == "timestamp" else None, gone)
    return got.select(*[F.col(f"`{c}`") for c in history.columns])


_ELSEWHERE = re.compile(r"^\s*(?:references\s+)?([\w.`\"]+)\s*\(([^)]*)\)\s*$", re.IGNORECASE)


def constraint_rules(id_: str, node: Mapping) -> list[tuple[Rule, dict]]:
    """The constraints of a model and of its columns as rules, each with what is told of it; custom ones are not evaluated."""
    own = [(c, c.get("columns") or [], None) for c in node.get("constraints") or []]
    own += [(c, [name], name) for name, column in (node.get("columns") or {}).items() for c in column.get("constraints") or []]
    out = []
    for no, (c, columns, of) in enumerate(own):
        kind = c["type"]
        told = {"unique_id": id_, "no": no, "type": kind, "name": c.get("name"), "column": of, "enforced": bool((node.get("contract") or {}).get("enforced"))}
        table, rule_id = node["name"], f"{id_}\t{no}"
        if kind == "check":
            out.append((Rule(rule_id, table, "check", expression=c["expression"]), told))
        elif kind == "foreign_key":
            to, to_columns = c.get("to"), c.get("to_columns") or []
            if not to:
                found = _ELSEWHERE.match(c.get("expression") or "")
                if not found:
                    raise ValueError(f"A foreign key to nowhere: {id_}")
                to, to_columns = found[1], [x.strip().strip('`"') for x in found[2].split(",")]
            out.append((Rule(rule_id, table, "key", tuple(columns), to=named(to), to_columns=tuple(to_columns)), told))
        elif kind in ("not_null", "unique", "primary_key"):
            out.append((Rule(rule_id, table, kind, tuple(columns)), told))
        elif kind != "custom":
            raise ValueError(f"Unknown constraint: {kind}")
    return out


def run_constraints(docs: DataFrame, tables: Tables) -> DataFrame:
    """Columns unique_id, no (of the constraint: the model's own first, then its columns', by name), type, name, column, enforced, violations.

    Violations are rows: with a null (not_null, primary_key), with a key that is not unique, for which the expression is
    false (check; null is no violation), or whose key is in no row of the other table (foreign_key; keys with a null
    are none). Each table is scanned once for all its constraints and for those of others that refer to it.
    """
    rules = [x for i, n in listed(docs, "nodes").items() for x in constraint_rules(i, n)]
    spark = docs.sparkSession
    told = spark.createDataFrame([(r.id, *t.values()) for r, t in rules], "rule string, unique_id string, no int, type string, name string, column string, enforced boolean")
    found = failures(spark, [r for r, _ in rules], tables)
    return told.join(found, "rule").select("unique_id", "no", "type", "name", "column", "enforced", F.col("n_rows").alias("violations"))


#: A place in a model's code that is filled in before it runs.
_PLACE = re.compile(r"\{\{(.*?)\}\}|\{%.*?%\}|\{#.*?#\}", re.DOTALL)
_VAR = re.compile(r"""^\s*(?:var|env_var)\(\s*['"]([^'"]+)['"]\s*(?:,\s*(.+?)\s*)?\)\s*$""", re.DOTALL)


def filled_in(code: str, views: Mapping[str, str], overrides: Mapping) -> str:
    """A model's code with ref and source as view names and var and env_var as given by a test's overrides or their default."""
    given = {**(overrides.get("vars") or {}), **(overrides.get("env_vars") or {})}

    def put(place: re.Match) -> str:
        said = place[1]
        if said is None:
            if place[0].startswith("{#"):
                return ""
            raise ValueError(f"Code that is not filled in: {place[0]}")
        if NAMED.search(said) or said.strip() == "this":
            name = named(said)
            if name not in views:
                raise ValueError(f"An input that no test gives: {name}")
            return views[name]
        variable = _VAR.match(said)
        if variable:
            if variable[1] in given:
                return text_of(given[variable[1]])
            if variable[2]:
                return variable[2].strip("'\"")
        if re.match(r"\s*config\(", said):
            return ""
        if said.strip() in (overrides.get("macros") or {}):
            return text_of(overrides["macros"][said.strip()])
        raise ValueError(f"Code that is not filled in: {place[0]}")

    return _PLACE.sub(put, code)


def text_of(value: object) -> str:
    return value if isinstance(value, str) else json.dumps(value)


def fixture(spark: SparkSession, part: Mapping, types: Mapping[str, str], views: Mapping[str, str]) -> DataFrame:
    """The rows of a fixture: a list of objects (dict), lines of CSV with a header (csv), or a query (sql).

    Columns get the types of the model, and are text where it tells none. What a row of a list does not have is null, and so
    is an empty field of CSV. Without rows a list has all the model's columns.
    """
    rows, form = part.get("rows"), part.get("format") or "dict"
    if form == "sql":
        return spark.sql(filled_in(rows, views, {}))
    if form == "csv":
        lines = [x.strip() for x in (rows or "").strip().splitlines()] if not isinstance(rows, list) else None
        if lines is not None:
            head = [c.strip().strip('"') for c in lines[0].split(",")] if lines else list(types)
            kind = ", ".join(f"`{c}` string" for c in head)
            read = spark.createDataFrame([(x,) for x in lines[1:]], "line string").select(F.from_csv("line", kind, {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}).alias("r")).select("r.*")
            return read.select(*[F.col(f"`{c}`").cast(types.get(c, "string")).alias(c) for c in head])
    elif form != "dict":
        raise ValueError(f"Unknown format: {form}")
    rows = rows or []
    names = list(dict.fromkeys(k for r in rows for k in r)) or list(types)
    plain = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
    read = spark.createDataFrame([tuple(plain(r.get(c)) for c in names) for r in rows], ", ".join(f"`{c}` string" for c in names) or "none string")
    return read.select(*[F.col(f"`{c}`").cast(types.get(c, "string")).alias(c) for c in names])


def types_of(node: Mapping) -> dict[str, str]:
    """The declared types of a model's columns; those that Spark does not know are text."""
    out = {}
    for name, column in (node.get("columns") or {}).items():
        kind = (column.get("data_type") or "string").lower()
        out[name] = _TYPES.get(kind.split("(")[0].strip(), kind)
    return out


#: Names of types in other databases.
_TYPES = {"varchar": "string", "text": "string", "char": "string", "integer": "int", "int64": "bigint", "hugeint": "decimal(38,0)", "float64": "double", "numeric": "decimal(38,9)", "bool": "boolean", "datetime": "timestamp", "timestamptz": "timestamp"}


def run_unit_tests(docs: DataFrame, tables: Tables | None = None) -> DataFrame:
    """Columns unique_id, status (pass or fail), n_actual (rows that were not expected), n_expected (rows that are missing).

    Each test's inputs are views of a session of their own, so that no view of the caller is touched; the model's code is
    run over them and held against the expected rows, as often as they occur, by the expected columns. A test takes an
    input that it does not give from `tables`, where there is one. Code with control statements must be compiled:
    compiled_code is taken if raw code has some.
    """
    nodes, tests = listed(docs, "nodes"), listed(docs, "unit_tests")
    by_name = {n.get("name"): n for n in [*nodes.values(), *listed(docs, "sources").values()]}
    spark, out = docs.sparkSession, None
    session = spark.newSession()
    for no, (id_, test) in enumerate(tests.items()):
        if not (test.get("config") or {}).get("enabled", True):
            continue
        model = by_name.get(test["model"])
        if model is None:
            raise ValueError(f"A test of no model: {id_}")
        views: dict[str, str] = {}
        for k, part in enumerate(test.get("given") or []):
            name = named(part["input"])
            fixture(session, part, types_of(by_name.get(name, {})), views).createOrReplaceTempView(f"given_{no}_{k}")
            views[name] = f"given_{no}_{k}"
        code = model.get("raw_code") or model.get("raw_sql") or ""
        for k, name in enumerate({m for m in NAMED.findall(code)} - set(views)):
            if tables is not None:
                table_of(tables, name).createOrReplaceGlobalTempView(f"table_{no}_{k}")
                views[name] = f"global_temp.table_{no}_{k}"
        if "{%" in code and (model.get("compiled_code") or model.get("compiled_sql")):
            code = model.get("compiled_code") or model.get("compiled_sql")
        actual = session.sql(filled_in(code, views, test.get("overrides") or {}))
        for view in views.values():
            if view.startswith("global_temp."):  # the plan has been made
                session.catalog.dropGlobalTempView(view.removeprefix("global_temp."))
        types = {f.name: f.dataType.simpleString() for f in actual.schema}
        expected = fixture(session, test["expect"], types, views)
        sides = checks.differences(actual, expected).agg(*[F.count_if(F.col("side") == s).alias(f"n_{s}") for s in ("actual", "expected")])
        told = sides.select(F.lit(id_).alias("unique_id"), F.when(F.col("n_actual") + F.col("n_expected") == 0, "pass").otherwise("fail").alias("status"), "n_actual", "n_expected")
        out = told if out is None else out.union(told)
    return spark.createDataFrame([], "unique_id string, status string, n_actual long, n_expected long") if out is None else out
