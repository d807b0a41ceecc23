"""Metrics by name, as the semantic models, metrics and saved queries of a manifest declare them.

A query is one plan: every semantic model that it needs is joined with the models that its dimensions come from and
grouped once for all measures taken from it; ratios and derived metrics are columns of the result. Manifests only declare
metrics; what they mean here is this module's and `semantic`'s own definition.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.sources.artifacts import export

from . import semantic
from .declared import listed
from .rules import Tables, table_of
from .validity import valid_at

#: Time granularities.
GRAINS = ("nanosecond", "microsecond", "millisecond", "second", "minute", "hour", "day", "week", "month", "quarter", "year")
TIME = "metric_time"
#: Types of an entity of which each key has one row, or one at a time.
ONE = ("primary", "unique", "natural")
#: Aggregates of which a running value can be made of the values of periods.
RUNNING = {"sum": "sum", "count": "sum", "sum_boolean": "sum", "min": "min", "max": "max"}


@dataclass(frozen=True)
class Asked:
    """A dimension or entity, seen from a model: the (entity, model) hops that lead to it, and where time is cut."""

    name: str
    hops: tuple[tuple[str, str], ...]
    element: str
    grain: str | None = None

    @property
    def column(self) -> str:
        return f"@{self.name}"


@dataclass(frozen=True)
class Leaf:
    """A measure of a model, under filters."""

    model: str
    measure: str
    agg: str
    expr: str
    settings: tuple[tuple[str, object], ...] = ()
    time: str | None = None
    filters: tuple[str, ...] = ()
    not_over: tuple[str, str, tuple[str, ...]] | None = None
    fill: float | None = None
    spine: bool = False


_CALL = re.compile(r"""^\s*(Dimension|TimeDimension|Entity)\(\s*(['"])(?P<name>[^'"]+)\2\s*(?P<rest>.*?)\)\s*(?:\.grain\(\s*['"](?P<grain>\w+)['"]\s*\))?\s*$""", re.DOTALL)
_PLACE = re.compile(r"\{\{(.*?)\}\}", re.DOTALL)


def element_name(said: str) -> str:
    """The name that Dimension('a__b'), TimeDimension('a__b', 'month') or Entity('a') ask for; a plain name is itself."""
    if "(" not in said:
        return said.strip()
    call = _CALL.match(said)
    if not call:
        raise ValueError(f"Unknown template: {said.strip()}")
    rest = call["rest"]
    path = re.search(r"entity_path\s*=\s*\[(.*?)\]", rest)
    hops = re.findall(r"""['"]([^'"]+)['"]""", path[1]) if path else []
    cut = call["grain"]
    if call[1] == "TimeDimension" and not cut:
        given = re.search(r"""^\s*,\s*(?:time_granularity_name\s*=\s*)?['"](\w+)['"]""", rest)
        cut = given[1] if given else None
    return "__".join([*hops, call["name"], *([cut] if cut else [])])


def template_names(sql: str) -> list[str]:
    return [element_name(x) for x in _PLACE.findall(sql)]


def template(sql: str) -> str:
    """A filter with the columns of what its templates ask for in their places."""
    return _PLACE.sub(lambda m: f"`@{element_name(m[1])}`", sql)


def filters_of(declared: Mapping | None) -> tuple[str, ...]:
    """The filters of a metric or an input: a list of templates that must all hold, or one (older manifests)."""
    if not declared:
        return ()
    if "where_sql_template" in declared:
        return (declared["where_sql_template"],)
    return tuple(f["where_sql_template"] for f in declared.get("where_filters") or [])


def window_of(declared: Mapping | None) -> str | None:
    return f"{declared['count']} {declared['granularity'].removesuffix('s')}" if declared else None


class Layer:
    """The semantic models, metrics and saved queries of one manifest."""

    def __init__(self, models: Mapping[str, Mapping], metrics: Mapping[str, Mapping], saved: Mapping[str, Mapping] = {}):
        self.models, self.metrics, self.saved = models, metrics, saved
        self.measures = {x["name"]: (m, x) for m, own in models.items() for x in own.get("measures") or []}

    @classmethod
    def read(cls, docs: DataFrame) -> Layer:
        """Of a manifest's document: artifact_id, body. Declarations are read to the driver, as they tell the plan."""
        return cls(*[{x["name"]: x for x in listed(docs, root).values()} for root in ("semantic_models", "metrics", "saved_queries")])

    def table(self, model: str, tables: Tables) -> DataFrame:
        own = self.models[model]
        return table_of(tables, (own.get("node_relation") or {}).get("alias") or own["name"])

    def entity(self, model: str, name: str) -> Mapping | None:
        return next((e for e in self.models[model].get("entities") or [] if e["name"] == name), None)

    def dimension(self, model: str, name: str) -> Mapping | None:
        return next((d for d in self.models[model].get("dimensions") or [] if d["name"] == name), None)

    def owns(self, model: str, entity: str) -> bool:
        e = self.entity(model, entity)
        return bool(e and e["type"] in ONE) or self.models[model].get("primary_entity") == entity

    def has(self, model: str, element: str) -> bool:
        return bool(self.dimension(model, element) or self.entity(model, element))

    def asked(self, model: str, name: str, time: str | None) -> Asked:
        """What a name such as customer__segment, metric_time__month or a__b__name means for a model's rows."""
        parts = name.split("__")
        cut = parts.pop() if len(parts) > 1 and parts[-1] in GRAINS else None
        *path, element = parts
        if not path and element == TIME:
            if not time:
                raise ValueError(f"No time dimension: {model}")
            return Asked(name, (), time, cut)
        if not path or (len(path) == 1 and self.owns(model, path[0]) and self.has(model, element)):
            if not self.has(model, element):
                raise ValueError(f"Unknown dimension: {name}")
            return Asked(name, (), element, cut)
        return Asked(name, self.way(model, path, element, name), element, cut)

    def way(self, model: str, path: list[str], element: str, name: str) -> tuple[tuple[str, str], ...]:
        """The shortest hops over entities to the model that owns the last entity of the path and has the element.

        A hop goes to a model of which each key has one row. Where only other hops lead there, rows would be multiplied:
        that is refused, and so are several shortest ways.
        """

        def search(wide: bool) -> list[tuple[tuple[str, str], ...]]:
            front, seen = [((), model)], {model}
            while front:
                after = [((*hops, (e["name"], to)), to) for hops, at in front for e in self.models[at].get("entities") or [] for to in self.models if to not in seen and self.entity(to, e["name"]) and (wide or self.owns(to, e["name"]))]
                goal = [hops for hops, to in after if self.has(to, element) and ([h for h, _ in hops][-len(path) :] == path or (wide and self.owns(to, path[-1])))]
                if goal:
                    return goal
                front = after
                seen |= {to for _, to in after}
            return []

        found = search(False)
        if not found:
            raise ValueError(f"{name} would multiply the rows of {model}" if search(True) else f"Unknown dimension: {name}")
        if len(found) > 1:
            raise ValueError(f"Several ways to {name}: {sorted(found)}")
        return found[0]

    def value(self, model: str, asked: Asked) -> Column:
        """The column of a dimension or entity in its own model's table."""
        own = self.dimension(model, asked.element) or self.entity(model, asked.element)
        got = F.expr(own.get("expr") or own["name"])
        timed = own["type"] == "time"
        if asked.grain and not timed:
            raise ValueError(f"No time dimension: {asked.name}")
        return semantic.grain(got, asked.grain) if asked.grain else got

    def joined(self, model: str, wanted: Sequence[Asked], tables: Tables, time: str | None = None) -> DataFrame:
        """A model's rows, all kept and none repeated, with a column for each of `wanted`.

        A model that is joined is first made one row a key by one aggregation, which fails if a key has two; the join
        uses the same partitioning. One whose rows are valid for a time is joined by `valid_at`, at the time `time`.
        """
        wanted = list(dict.fromkeys(wanted))
        table = self.table(model, tables)
        out = table.select("*", *[self.value(model, w).alias(w.column) for w in wanted if not w.hops])
        for entity, to in dict.fromkeys(w.hops[0] for w in wanted if w.hops):
            inner = [replace(w, hops=w.hops[1:]) for w in wanted if w.hops and w.hops[0] == (entity, to)]
            names = [w.column for w in inner]
            own = self.entity(model, entity)
            left = F.expr(own.get("expr") or own["name"])
            right = self.joined(to, inner, tables, time)
            there = self.entity(to, entity)
            ends = {k: next((d for d in self.models[to].get("dimensions") or [] if ((d.get("type_params") or {}).get("validity_params") or {}).get(k)), None) for k in ("is_start", "is_end")}
            key = (F.expr(there.get("expr") or there["name"]) if there else F.col(f"`{entity}`")).alias("@key")
            columns = [F.col(f"`{n}`") for n in names]
            if ends["is_start"]:
                if not time:
                    raise ValueError(f"No time at which rows of {to} are valid")
                at = self.dimension(model, time)
                bounds = [F.expr(d.get("expr") or d["name"]).alias(k) for k, d in (("@start", ends["is_start"]), ("@end", ends["is_end"] or {"name": "cast(null as timestamp)"}))]
                came = out.withColumns({"@left": left, "@at": F.expr(at.get("expr") or at["name"])})
                out = valid_at(came, right.select(key, *bounds, *columns), "@left", "@at", "@start", "@end", names, history_key="@key").drop("@left", "@at")
                continue
            row = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns)])
            twice = F.raise_error(F.lit(f"{to} has several rows of one {entity}"))
            right = right.select(key, row.alias("@row")).where("`@key` is not null").groupBy("`@key`").agg(F.when(F.count("*") == 1, F.first("`@row`")).otherwise(twice).alias("@row"))
            out = out.join(right, left == F.col("`@key`"), "left").select(*[F.col(f"`{c}`") for c in out.columns], *[F.col(f"`@row`.c{i}").alias(n) for i, n in enumerate(names)])
        return out

    def leaf(self, metric: Mapping, filters: tuple[str, ...]) -> Leaf:
        """The measure behind a simple (or cumulative) metric, under the metric's and more filters."""
        params = metric["type_params"]
        own = params.get("metric_aggregation_params")
        filters = (*filters, *filters_of(metric.get("filter")))
        if params.get("measure"):
            return self.measured(params["measure"], filters)
        if not own:
            raise ValueError(f"A metric of no measure: {metric['name']}")
        declared = {**own, "name": metric["name"], "expr": params.get("expr")}
        return self._leaf(own["semantic_model"], declared, filters, params)

    def measured(self, used: Mapping | str, filters: tuple[str, ...]) -> Leaf:
        used = {"name": used} if isinstance(used, str) else used
        if used["name"] not in self.measures:
            raise ValueError(f"Unknown measure: {used['name']}")
        model, declared = self.measures[used["name"]]
        return self._leaf(model, declared, (*filters, *filters_of(used.get("filter"))), used)

    def _leaf(self, model: str, declared: Mapping, filters: tuple[str, ...], used: Mapping) -> Leaf:
        if model not in self.models:
            raise ValueError(f"Unknown semantic model: {model}")
        params = declared.get("agg_params") or {}
        settings = {"percentile": params.get("percentile"), "discrete": params.get("use_discrete_percentile"), "approximate": params.get("use_approximate_percentile")}
        over = declared.get("non_additive_dimension")
        time = declared.get("agg_time_dimension") or (self.models[model].get("defaults") or {}).get("agg_time_dimension")
        return Leaf(model, declared["name"], declared["agg"], declared.get("expr") or declared["name"], tuple((k, v) for k, v in settings.items() if v is not None), time, filters, (over["name"], over.get("window_choice") or "max", tuple(over.get("window_groupings") or ())) if over else None, used.get("fill_nulls_with"), bool(used.get("join_to_timespine")))


class Query:
    """Metrics asked for together, by the same names."""

    def __init__(self, layer: Layer, tables: Tables, group_by: Sequence[str], where: Sequence[str], spine: DataFrame | None):
        self.layer, self.tables, self.spine = layer, tables, spine
        self.by, self.where = [element_name(g) for g in group_by], tuple(where)
        self.period = next((g for g in self.by if g.split("__")[0] == TIME), None)
        self.others = [g for g in self.by if g != self.period]
        self.columns: dict[tuple, str] = {}
        self.leaves: dict[Leaf, str] = {}
        self.parts: list[DataFrame] = []
        self.steps: list[Callable[[DataFrame], DataFrame]] = []
        self.open: list[str] = []

    def column(self, name: str, filters: tuple[str, ...] = ()) -> str:
        """The column that will hold a metric under filters; what it is made of is taken up first."""
        if name not in self.layer.metrics:
            raise ValueError(f"Unknown metric: {name}")
        if name in self.open:
            raise ValueError(f"A metric of itself: {' of '.join([*self.open[self.open.index(name) :], name])}")
        if (name, filters) in self.columns:
            return self.columns[name, filters]
        metric = self.layer.metrics[name]
        self.open.append(name)
        out = f"#{len(self.columns)}_{len(self.open)}"
        make = {"simple": self.simple, "ratio": self.ratio, "derived": self.derived, "cumulative": self.cumulative, "conversion": self.conversion}.get(metric["type"])
        if make is None:
            raise ValueError(f"Unknown type of metric: {metric['type']}")
        make(metric, filters, out)
        self.open.pop()
        self.columns[name, filters] = out
        return out

    def rows(self, leaf: Leaf, names: Sequence[str]) -> tuple[DataFrame, list[str]]:
        """The rows behind a measure with the columns of names and of all filters, and the conditions."""
        every = [*names, *[n for f in (*leaf.filters, *self.where) for n in template_names(f)]]
        asked = [self.layer.asked(leaf.model, n, leaf.time) for n in every]
        return self.layer.joined(leaf.model, asked, self.tables, leaf.time).where(" and ".join(f"({template(f)})" for f in self.where) or "true"), [template(f) for f in leaf.filters]

    def simple(self, metric: Mapping, filters: tuple[str, ...], out: str) -> None:
        kept = self.leaves.setdefault(self.layer.leaf(metric, filters), out)
        if kept != out:
            self.steps.append(lambda t: t.withColumn(out, F.col(f"`{kept}`")))

    def ratio(self, metric: Mapping, filters: tuple[str, ...], out: str) -> None:
        own = (*filters, *filters_of(metric.get("filter")))
        a, b = (self.column(x["name"], (*own, *filters_of(x.get("filter")))) for x in (metric["type_params"][k] for k in ("numerator", "denominator")))
        self.steps.append(lambda t: t.withColumn(out, F.try_divide(F.col(f"`{a}`"), F.col(f"`{b}`"))))

    def derived(self, metric: Mapping, filters: tuple[str, ...], out: str) -> None:
        own = (*filters, *filters_of(metric.get("filter")))
        inputs = {}
        for x in metric["type_params"].get("metrics") or []:
            offset = window_of(x.get("offset_window")), x.get("offset_to_grain")
            if any(offset) and not self.period:
                raise ValueError(f"{metric['name']} needs {TIME}")
            inputs[x.get("alias") or x["name"]] = (self.column(x["name"], (*own, *filters_of(x.get("filter")))), *offset)
        self.steps.append(lambda t: semantic.derived(t, out, metric["type_params"]["expr"], self.period, inputs, self.others).drop(*inputs))

    def cumulative(self, metric: Mapping, filters: tuple[str, ...], out: str) -> None:
        """A running value at the measure's own granularity, then one of it for each period that is asked for."""
        if not self.period:
            raise ValueError(f"{metric['name']} needs {TIME}")
        params = metric["type_params"]
        more = params.get("cumulative_type_params") or {}
        source = more.get("metric")
        if source:
            inner = self.layer.metrics[source["name"]]
            leaf = self.layer.leaf(inner, (*filters, *filters_of(metric.get("filter")), *filters_of(source.get("filter"))))
        else:
            leaf = self.layer.leaf(metric, filters)
        window, to_date = window_of(more.get("window") or params.get("window")), more.get("grain_to_date") or params.get("grain_to_date")
        time = self.layer.dimension(leaf.model, leaf.time)
        unit = (time.get("type_params") or {}).get("time_granularity") or "day"
        asked = self.period.split("__")[-1] if "__" in self.period else unit
        df, conditions = self.rows(leaf, [*self.others, f"{TIME}__{unit}"])
        df = df.where(" and ".join(f"({c})" for c in conditions) or "true")
        keys = [f"@{k}" for k in self.others]
        at = F.col(f"`@{TIME}__{unit}`").cast("timestamp")
        if leaf.agg == "count_distinct":
            if window:
                got = semantic.distinct_in_window(df, out, F.expr(leaf.expr), at, window, unit, keys)
            else:
                first = semantic.first_seen(df, out, F.expr(leaf.expr), at, keys, to_date)
                got = semantic.cumulative(semantic.filled(first, "period", out, unit, by=keys, spine=self.calendar("period")), out, out, "period", keys, grain_to_date=to_date)
        elif leaf.agg in RUNNING:
            totals = df.where(at.isNotNull()).groupBy(*[F.col(f"`{k}`") for k in keys], at.alias("period")).agg(semantic.measure(leaf.agg, leaf.expr, **dict(leaf.settings)).alias(out))
            got = semantic.cumulative(semantic.filled(totals, "period", out, unit, None, keys, self.calendar("period")), out, out, "period", keys, grain_to_date=to_date, window=window, unit=unit, agg=RUNNING[leaf.agg])
        else:
            raise ValueError(f"No running {leaf.agg}: {metric['name']}")
        if asked != unit:
            got = semantic.period_agg(got.where(F.col(f"`{out}`").isNotNull()), out, "period", asked, keys, more.get("period_agg") or "first")
        self.parts.append(got.where(F.col(f"`{out}`").isNotNull()).select(*[F.col(f"`@{k}`").alias(k) for k in self.others], F.col("period").alias(self.period), F.col(f"`{out}`")))

    def calendar(self, name: str) -> DataFrame | None:
        return None if self.spine is None else self.spine.select(F.col(self.spine.columns[0]).alias(name))

    def conversion(self, metric: Mapping, filters: tuple[str, ...], out: str) -> None:
        params = metric["type_params"]["conversion_type_params"]
        own, sides = (*filters, *filters_of(metric.get("filter"))), []
        for side, names in (("base", self.by), ("conversion", [])):
            used = params.get(f"{side}_measure")
            leaf = self.layer.measured(used, own) if used else self.layer.leaf(self.layer.metrics[params[f"{side}_metric"]["name"]], own)
            if not leaf.time:
                raise ValueError(f"No time dimension: {leaf.model}")
            kept = self.rows(leaf, names)
            entity, time = self.layer.entity(leaf.model, params["entity"]), self.layer.dimension(leaf.model, leaf.time)
            if not entity:
                raise ValueError(f"{leaf.model} has no entity {params['entity']}")
            wanted = [c[f"{side}_property"] for c in params.get("constant_properties") or []]
            extra = {f"@p{i}": self.layer.value(leaf.model, self.layer.asked(leaf.model, n, leaf.time)) for i, n in enumerate(wanted)}
            df = kept[0].where(" and ".join(f"({c})" for c in kept[1]) or "true")
            sides.append(df.withColumns({"@entity": F.expr(entity.get("expr") or entity["name"]), "@at": F.expr(time.get("expr") or time["name"]), **extra}))
        same = [(f"@p{i}", f"@p{i}") for i in range(len(params.get("constant_properties") or []))]
        renamed = sides[0].select("`@entity`", "`@at`", *[f"`{a}`" for a, _ in same], *[F.col(f"`@{k}`").alias(f"by{i}") for i, k in enumerate(self.by)])
        got = semantic.conversion(renamed, sides[1], "n", "`@entity`", "`@at`", window_of(params.get("window")), True, [f"by{i}" for i in range(len(self.by))], same)
        value = "n" if params.get("calculation") == "conversions" else "n_rate"
        self.parts.append(got.select(*[F.col(f"by{i}").alias(k) for i, k in enumerate(self.by)], F.col(value).alias(out)))

    def grouped(self) -> None:
        """One aggregation for each model, of all its measures that can be added over time; the others by themselves."""
        alone = [leaf for leaf in self.leaves if leaf.not_over]
        for group in [*[[x] for x in alone], *[[x for x in self.leaves if x not in alone and (x.model, x.time) == k] for k in dict.fromkeys((x.model, x.time) for x in self.leaves if x not in alone)]]:
            every = replace(group[0], filters=tuple(dict.fromkeys(f for x in group for f in x.filters)))
            df, _ = self.rows(every, [*self.by, *(group[0].not_over[2] if group[0].not_over else ())])
            holds = [" and ".join(f"({template(f)})" for f in x.filters) for x in group]
            if all(holds):
                df = df.where(" or ".join(f"({h})" for h in holds))
            keys = [F.col(f"`@{k}`").alias(k) for k in self.by]
            if group[0].not_over:
                name, choice, groupings = group[0].not_over
                own = self.layer.dimension(group[0].model, name)
                df = semantic.non_additive(df.withColumn("@over", F.expr(own.get("expr") or own["name"])), "@over", choice, [f"@{k}" for k in dict.fromkeys((*self.by, *groupings))])
            aggs = []
            for x, h in zip(group, holds):
                value = semantic.measure(x.agg, f"case when {h} then ({x.expr}) end" if h else x.expr, **dict(x.settings))
                aggs.append((F.when(F.count_if(F.expr(h)) > 0, value) if h else value).alias(self.leaves[x]))
            got = df.groupBy(*keys).agg(*aggs)
            for x in group:
                if x.spine and self.period:
                    unit = self.period.split("__")[-1] if "__" in self.period else "day"
                    got = semantic.filled(got.where(F.col(self.period).isNotNull()), self.period, self.leaves[x], unit, None, self.others, self.calendar(self.period))
            self.parts.append(got)

    def result(self, names: Sequence[str]) -> DataFrame:
        found = [self.column(n) for n in names]
        self.grouped()
        whole = self.parts[0]
        if len(self.parts) > 1:
            for p in self.parts[1:]:
                whole = whole.unionByName(p, allowMissingColumns=True)
            # Each metric comes from one part, with one row a group.
            whole = whole.groupBy(*self.by).agg(*[F.first(f"`{c}`", ignorenulls=True).alias(c) for c in whole.columns if c not in self.by])
        for leaf, c in self.leaves.items():
            if leaf.fill is not None:
                whole = whole.withColumn(c, F.coalesce(F.col(f"`{c}`"), F.lit(leaf.fill)))
        for step in self.steps:
            whole = step(whole)
        return whole.select(*self.by, *[F.col(f"`{c}`").alias(n) for n, c in zip(names, found)])


def evaluate(layer: Layer | DataFrame, names: Sequence[str], tables: Tables, group_by: Sequence[str] = (), where: Sequence[str] = (), order_by: Sequence[str] = (), limit: int | None = None, spine: DataFrame | None = None) -> DataFrame:
    """Columns of group_by and a column for each metric; layer may be a manifest's document.

    group_by takes names such as customer__segment and metric_time__month, or templates of these; where takes filter
    templates; order_by takes names of either, with a minus sign for descending. tables gives a DataFrame for the relation
    alias (or name) of each semantic model. spine is a calendar, of which the first column is used.

    A group has a row if any of the metrics has rows there. Unknown names, metrics of themselves, dimensions that would
    multiply rows and ones to which several ways lead are refused before anything runs; a key that has two rows where
    one is declared fails the query.
    """
    layer = layer if isinstance(layer, Layer) else Layer.read(layer)
    query = Query(layer, tables, group_by, where, spine)
    out = query.result(list(names))
    known = [*query.by, *names]
    order = []
    for o in order_by:
        name = element_name(o.lstrip("-"))
        if name not in known:
            raise ValueError(f"Unknown order: {o}")
        order.append(F.desc(f"`{name}`") if o.startswith("-") else F.asc(f"`{name}`"))
    out = out.orderBy(*order) if order else out
    return out if limit is None else out.limit(limit)


def saved(layer: Layer | DataFrame, name: str, tables: Tables, spine: DataFrame | None = None) -> DataFrame:
    """A saved query of a manifest by its name."""
    layer = layer if isinstance(layer, Layer) else Layer.read(layer)
    if name not in layer.saved:
        raise ValueError(f"Unknown saved query: {name}")
    asked = layer.saved[name]["query_params"]
    return evaluate(layer, asked["metrics"], tables, asked.get("group_by") or (), filters_of(asked.get("where")), asked.get("order_by") or (), asked.get("limit"), spine)


def run_exports(layer: Layer | DataFrame, name: str, tables: Tables, spine: DataFrame | None = None) -> list[str]:
    """Write the exports of a saved query, as tables or views; the names that they got: schema.alias."""
    layer = layer if isinstance(layer, Layer) else Layer.read(layer)
    result, out = saved(layer, name, tables, spine), []
    for x in layer.saved[name].get("exports") or []:
        config = x.get("config") or {}
        to = config.get("alias") or x["name"]
        kind = config.get("export_as") or "table"
        if kind == "table" and config.get("schema_name"):
            to = f"{config['schema_name']}.{to}"
        export(result, to, kind)
        out.append(to)
    return out
