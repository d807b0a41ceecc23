"""Aggregates, metrics and saved queries as manifests declare them.

Manifests only declare these; what they mean here is this module's own definition.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.shared import checkpoint_folder


def interval(window: str) -> Column:
    """The length of a window such as "3 month" or "2 quarters"."""
    n, unit = window.split()
    unit = unit.removesuffix("s")
    return F.expr(f"interval {3 * int(n)} month" if unit == "quarter" else f"interval {n} {unit}")


def measure(agg: str, expr: str, percentile: float = 0.5, discrete: bool = False, approximate: bool = False) -> Column:
    """The aggregate of a measure. percentile interpolates unless it is discrete or approximate."""
    e = F.expr(expr)
    plain = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "average": F.avg, "count_distinct": F.count_distinct, "median": F.median}
    if agg in plain:
        return plain[agg](e)
    if agg == "sum_boolean":
        return F.sum(F.when(e, 1).otherwise(0))
    if agg == "percentile":
        if approximate:
            return F.percentile_approx(e, percentile)
        return F.expr(f"percentile_{'disc' if discrete else 'cont'}({percentile}) within group (order by {expr})")
    raise ValueError(f"Unknown aggregate: {agg}")


def measures(df: DataFrame, by: list[str], wanted: Mapping[str, tuple[str, str, dict]]) -> DataFrame:
    """The columns named by `by` and a column for each name in wanted: (agg, expr, more), as `measure` takes them.

    Medians and percentiles of numbers are as exact as those of `measure`, which hold all different values of a group in one
    task: here each different value is counted, ranges of values are dealt out, and only the ranges that hold a wanted
    place are put in order. Needs a checkpoint folder if there are any.
    """
    ordered = {n: w for n, w in wanted.items() if w[0] == "median" or w[0] == "percentile" and not w[2].get("approximate")}
    out = df.groupBy(*by).agg(F.lit(None).alias("_none"), *[measure(a, e, **k).alias(n) for n, (a, e, k) in wanted.items() if n not in ordered]).drop("_none")
    for expr in dict.fromkeys(w[1] for w in ordered.values()):
        places = {n: (0.5 if a == "median" else k.get("percentile", 0.5), a == "percentile" and k.get("discrete", False)) for n, (a, e, k) in ordered.items() if e == expr}
        got = _placed(df.select(*by, F.expr(expr).cast("double").alias("_v")).where("_v is not null"), by, places)
        got = got.select(*[F.col(b).alias(f"_{b}") for b in by], *places)
        out = out.join(got, _alike(out, got, by), "left").drop(*[f"_{b}" for b in by])
    return out.select(*by, *wanted)


def _alike(left: DataFrame, right: DataFrame, by: list[str]) -> Column:
    return reduce(lambda on, b: on & left[b].eqNullSafe(right[f"_{b}"]), by, F.lit(True))


def _placed(df: DataFrame, by: list[str], places: Mapping[str, tuple[float, bool]]) -> DataFrame:
    """For each group the values `_v` at these shares (share, whether discrete)."""
    checkpoint_folder(df.sparkSession)
    counted = df.groupBy(*by, "_v").agg(F.count("*").alias("_n"))
    # Ranges follow each other: what comes before one is in the ranges with smaller numbers.
    counted = counted.repartitionByRange(*by, "_v").withColumn("_range", F.spark_partition_id()).checkpoint()
    group = Window.partitionBy(*by)
    ranges = counted.groupBy(*by, "_range").agg(F.sum("_n").alias("_size"))
    ranges = ranges.withColumn("_all", F.sum("_size").over(group)).withColumn("_before", F.sum("_size").over(group.orderBy("_range")) - F.col("_size"))
    # Places count from 0. A continuous one may lie between two values.
    at, ends = {}, {}
    for n, (share, discrete) in places.items():
        at[n] = F.greatest(F.ceil(share * F.col("_all")) - 1, F.lit(0)) if discrete else (F.col("_all") - 1) * share
        ends[n] = (F.floor(at[n]), F.ceil(at[n]))
    within = lambda place, first, size: (place >= first) & (place < first + size)
    some = lambda first, size: reduce(lambda a, b: a | b, [within(x, first, size) for pair in ends.values() for x in pair])
    held = ranges.where(some(F.col("_before"), F.col("_size"))).select(*[F.col(b).alias(f"_{b}") for b in by], F.col("_range").alias("_which"), "_all", "_before")
    each = counted.join(held, _alike(counted, held, by) & (F.col("_range") == F.col("_which"))).select(*by, "_range", "_v", "_n", "_all", "_before")
    each = each.withColumn("_first", F.col("_before") + F.sum("_n").over(Window.partitionBy(*by, "_range").orderBy("_v")) - F.col("_n"))
    found = [F.max(F.when(within(x, F.col("_first"), F.col("_n")), F.col("_v"))).alias(f"_{i}_{n}") for n, pair in ends.items() for i, x in enumerate(pair)]
    met = each.where(some(F.col("_first"), F.col("_n"))).groupBy(*by, "_all").agg(*found)
    low, high = (lambda n: F.col(f"_0_{n}")), (lambda n: F.col(f"_1_{n}"))
    between = lambda n: F.when(ends[n][0] == ends[n][1], low(n)).otherwise((ends[n][1] - at[n]) * low(n) + (at[n] - ends[n][0]) * high(n))
    return met.select(*by, *[between(n).alias(n) for n in places])


def where_all(df: DataFrame, filters: list[str]) -> DataFrame:
    """Rows for which all filters hold."""
    for f in filters:
        df = df.where(F.expr(f))
    return df


def grain(column: Column, granularity: str) -> Column:
    """Time cut to a granularity; nanoseconds are not kept."""
    return F.date_trunc("microsecond" if granularity == "nanosecond" else granularity, column)


def simple(df: DataFrame, name: str, agg: str, expr: str, by: list[Column] = (), filters: list[str] = (), **settings) -> DataFrame:
    return where_all(df, list(filters)).groupBy(*by).agg(measure(agg, expr, **settings).alias(name))


def ratio(df: DataFrame, name: str, numerator: Column, denominator: Column, by: list[Column] = ()) -> DataFrame:
    """Quotient of two aggregates; null where the denominator is 0."""
    return df.groupBy(*by).agg(F.try_divide(numerator, denominator).alias(name))


#: Seconds, and months, of time units.
_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400, "week": 604_800}
_MONTHS = {"month": 1, "quarter": 3, "year": 12}


def cumulative(totals: DataFrame, name: str, value: str, period: str, by: list[str] = (), window_days: int | None = None, grain_to_date: str | None = None, window: str | None = None, unit: str = "day", agg: str = "sum") -> DataFrame:
    """totals with a running sum (min, max) by period: of all time, of a window, or from the start of a longer period.

    A window such as "3 month" ends with the row's period, which is one `unit`, and does not hold the period that long before.
    Windows of months over shorter units are no frames of a fixed length: there each total is sent to the periods of which
    the window holds it, as many as such a window has.
    """
    if window_days is not None:
        window = f"{window_days} day"
    keys = [F.col(f"`{k}`") for k in by] + ([F.date_trunc(grain_to_date, f"`{period}`")] if grain_to_date else [])
    at, run = F.col(f"`{period}`").cast("timestamp"), {"sum": F.sum, "min": F.min, "max": F.max}[agg]
    order = Window.partitionBy(*keys)
    if window is None:
        return totals.withColumn(name, run(f"`{value}`").over(order.orderBy(at).rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    n, of = window.split()
    of = of.removesuffix("s")
    if of in _SECONDS:
        # Months as units: the window is at least one of them.
        length = int(n) * _SECONDS[of] - _SECONDS.get(unit, 0)
        return totals.withColumn(name, run(f"`{value}`").over(order.orderBy(F.unix_seconds(at)).rangeBetween(-max(length, 0), 0)))
    if unit in _MONTHS:
        month = F.year(at) * 12 + F.month(at)
        return totals.withColumn(name, run(f"`{value}`").over(order.orderBy(month).rangeBetween(-max(int(n) * _MONTHS[of] - _MONTHS[unit], 0), 0)))
    held = F.sequence(at, at + interval(window) + F.expr("interval 3 day"), interval(f"1 {unit}"))
    sent = totals.select(*[c.alias(f"_k{i}") for i, c in enumerate(keys)], at.alias("_from"), F.col(f"`{value}`").alias("_value"), F.explode(held).alias("_at")).where(F.col("_from") > F.col("_at") - interval(window))
    sums = sent.groupBy(*[f"_k{i}" for i in range(len(keys))], "_at").agg(run("_value").alias("_sum"))
    on = at == F.col("_at")
    for i, c in enumerate(keys):
        on = on & c.eqNullSafe(F.col(f"_k{i}"))
    return totals.join(sums, on, "left").select(*[F.col(f"`{c}`") for c in totals.columns if c != name], F.col("_sum").alias(name))


def filled(totals: DataFrame, period: str, value: str, unit: str, default: float | None = 0, by: list[str] = (), spine: DataFrame | None = None) -> DataFrame:
    """totals with a row for every period of each group of `by`; missing values get the default, or stay null if it is None.

    The periods are those of `spine`, a calendar with a column of the same name, between the first and the last of all
    totals; without a spine, every unit between these. Other columns than period, value and `by` are null in new rows.
    """
    ends = totals.agg(F.min(period).alias("_a"), F.max(period).alias("_b")).where("_a is not null")
    if spine is None:
        every = ends.select(F.explode(F.sequence("_a", "_b", interval(f"1 {unit}"))).alias(period))
    else:
        cut = F.date_trunc(unit, F.col(f"`{period}`")).cast(totals.schema[period].dataType)
        every = spine.select(cut.alias(period)).distinct().join(F.broadcast(ends), F.col(period).between(F.col("_a"), F.col("_b"))).drop("_a", "_b")  # ends is one row
    if not by:
        return every.join(totals, period, "left").withColumn(value, F.coalesce(value, F.lit(default)) if default is not None else F.col(value))
    # Each group gets the list of periods, which is as long as the calendar, by a join with its one row.
    listed = every.agg(F.array_sort(F.collect_list(period)).alias("_periods"))
    groups = totals.select(*[F.col(k).alias(f"_{k}") for k in by]).distinct().join(F.broadcast(listed)).select(*[f"_{k}" for k in by], F.explode("_periods").alias("_period"))
    on = F.col("_period") == F.col(period)
    for k in by:
        on = on & F.col(f"_{k}").eqNullSafe(F.col(k))
    met = groups.join(totals, on, "left")
    known = {period: F.col("_period"), **{k: F.col(f"_{k}") for k in by}}
    if default is not None:
        known[value] = F.coalesce(value, F.lit(default))
    return met.select(*[known.get(c, F.col(f"`{c}`")).alias(c) for c in totals.columns])


def period_agg(totals: DataFrame, value: str, period: str, grain_: str, by: list[str] = (), how: str = "first") -> DataFrame:
    """A running value at a longer period: its first, last or average value there."""
    ways = {"first": lambda: F.min_by(value, period), "last": lambda: F.max_by(value, period), "average": lambda: F.avg(value)}
    if how not in ways:
        raise ValueError(f"Unknown period_agg: {how}")
    return totals.groupBy(*by, grain(F.col(period), grain_).alias("_longer")).agg(ways[how]().alias(value)).withColumnRenamed("_longer", period)


def first_seen(df: DataFrame, name: str, value: Column, period: Column, by: list[str] = (), grain_to_date: str | None = None) -> DataFrame:
    """Columns of `by`, period, name: how many different values come up first in each period, of all time or of a longer
    period. Their running sum is the exact count of different values; sums of counts are not. Periods with values have a
    row, also if none is new."""
    own = df.select(*[F.col(f"`{k}`") for k in by], value.alias("_value"), period.alias("period")).where("_value is not null and period is not null")
    longer = [F.date_trunc(grain_to_date, "period").alias("_longer")] if grain_to_date else []
    first = own.groupBy(*by, *longer, "_value").agg(F.min("period").alias("period"))
    there = own.select(*by, "period", F.lit(0).alias("_new")).distinct()
    return first.select(*by, "period", F.lit(1).alias("_new")).union(there).groupBy(*by, "period").agg(F.sum("_new").alias(name))


def distinct_in_window(df: DataFrame, name: str, value: Column, period: Column, window: str, unit: str = "day", by: list[str] = (), lg_k: int = 14) -> DataFrame:
    """Columns of `by`, period, name: an estimate of how many different values the window that ends with each period holds.

    One sketch a period, merged for the windows it is in; the standard error is about 1.04 / sqrt(2 ** lg_k), 0.8 % by
    default. Periods within a window of one with values have a row, up to the last such period.
    """
    own = df.select(*[F.col(f"`{k}`") for k in by], value.cast("string").alias("_value"), period.cast("timestamp").alias("period")).where("_value is not null and period is not null")
    each = own.groupBy(*by, "period").agg(F.hll_sketch_agg("_value", lg_k).alias("_sketch"))
    last = own.agg(F.max("period").alias("_last"))
    ends = F.sequence("period", F.least(F.col("_last"), F.col("period") + interval(window) - interval(f"1 {unit}")), interval(f"1 {unit}"))
    spread = each.join(F.broadcast(last)).select(*[F.col(f"`{k}`") for k in by], F.explode(ends).alias("period"), "_sketch")  # last is one row
    return spread.groupBy(*by, "period").agg(F.hll_sketch_estimate(F.hll_union_agg("_sketch")).alias(name))


def saved_query(df: DataFrame, metrics: dict[str, Column], group_by: list[Column] = (), where: list[str] = (), order_by: list[Column] = (), limit: int | None = None) -> DataFrame:
    """A saved query over a table: filters, groups, aggregates, order and limit."""
    out = where_all(df, list(where)).groupBy(*group_by).agg(*[c.alias(n) for n, c in metrics.items()])
    out = out.orderBy(*order_by) if order_by else out
    return out if limit is None else out.limit(limit)


def derived(totals: DataFrame, name: str, expr: str, period: str, inputs: dict[str, tuple], by: list[str] = ()) -> DataFrame:
    """totals with a metric worked out of others by `expr`.

    inputs: by alias (metric, offset window, offset grain). A window such as "1 month" takes the metric of the period that
    long before; a grain that of the first period of the longer one; with neither, the metric itself. What is not there is
    null. Offsets are joins by period and `by`, not windows, so that gaps between periods do not shift them.
    """
    out = totals
    for alias, (metric, window, grain_) in inputs.items():
        if not window and not grain_:
            out = out.withColumn(alias, F.col(metric))
            continue
        at = F.col(period) + interval(window) if window else F.col(period)
        other = totals.select(*[F.col(k).alias(f"_{k}") for k in by], at.cast(totals.schema[period].dataType).alias("_at"), F.col(metric).alias(alias))
        on = F.date_trunc(grain_, period) == F.col("_at") if grain_ else F.col(period) == F.col("_at")
        for k in by:
            on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
        out = out.join(other, on, "left").drop("_at", *[f"_{k}" for k in by])
    return out.withColumn(name, F.expr(expr))


def conversion(base: DataFrame, conversions: DataFrame, name: str, entity: str, at: str, window: str | None = None, rate: bool = True, by: list[str] = (), constant: list[tuple[str, str]] = ()) -> DataFrame:
    """By columns of base: base events, conversions and, if `rate`, their quotient.

    A conversion counts for the last base event of its entity that is not later, if that is no longer than `window` before,
    and that agrees with it in the constant properties, pairs of a column of base and one of conversions (nulls agree).
    Events of an entity and properties are put in order once; no pairs of events are made.
    """
    keys = [f"_c{i}" for i in range(len(constant))]
    own = [F.col(f"`{a}`").alias(k) for k, (a, _) in zip(keys, constant)]
    other = [F.col(f"`{b}`").alias(k) for k, (_, b) in zip(keys, constant)]
    first = base.select(F.col(entity).alias("_e"), *own, F.col(at).cast("timestamp").alias("_at"), F.lit(0).alias("_kind"), F.struct(F.lit(1).alias("_"), *by).alias("_by"))
    then = conversions.select(F.col(entity).alias("_e"), *other, F.col(at).cast("timestamp").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(first.schema["_by"].dataType).alias("_by"))
    order = Window.partitionBy("_e", *keys).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mine = F.when(F.col("_kind") == 0, F.struct("_at", "_by"))
    met = first.union(then).where("_e is not null and _at is not null").withColumn("_base", F.last(mine, ignorenulls=True).over(order))
    near = F.col("_base").isNotNull() if window is None else F.col("_at") <= F.col("_base._at") + interval(window)
    got = met.where(F.col("_base").isNotNull()).groupBy(*[F.col(f"_base._by.{k}").alias(k) for k in by]).agg(F.count_if(F.col("_kind") == 0).alias("n_base"), F.count_if((F.col("_kind") == 1) & near).alias(name))
    return got.withColumn(f"{name}_rate", F.try_divide(name, "n_base")) if rate else got


def non_additive(df: DataFrame, time: str, choice: str = "max", groupings: list[str] = ()) -> DataFrame:
    """The rows that a measure which cannot be added over time is taken from: those of one time of each group.

    The choices max and min are the group's last and first time; median and percentile the time in the middle of its rows;
    average the last time that is not after the mean. The others (sum, count and the like) tell no time and are refused.
    """
    t = F.col(time).cast("timestamp")
    middle = F.timestamp_micros(F.expr(f"cast(percentile_disc(0.5) within group (order by unix_micros(cast(`{time}` as timestamp))) as bigint)"))
    ways = {"max": F.max(t), "min": F.min(t), "median": middle, "percentile": middle, "average": F.timestamp_micros(F.floor(F.avg(F.unix_micros(t))).cast("long"))}
    if choice not in ways:
        raise ValueError(f"A window_choice that tells no time: {choice}")

    def met(left: DataFrame, ends: DataFrame, how: str) -> DataFrame:
        on = F.col(time).cast("timestamp") == F.col("_end")
        for g in groupings:
            on = on & F.col(g).eqNullSafe(F.col(f"_{g}"))
        return left.join(ends, on, how)

    own = [F.col(g).alias(f"_{g}") for g in groupings]
    ends = df.groupBy(*own).agg(ways[choice].alias("_end"))
    if choice == "average":
        mean = ends.select(F.col("_end").alias("_mean"), *[F.col(f"_{g}").alias(f"_m_{g}") for g in groupings])
        on = t <= F.col("_mean")
        for g in groupings:
            on = on & F.col(g).eqNullSafe(F.col(f"_m_{g}"))
        ends = df.join(mean, on).groupBy(*own).agg(F.max(t).alias("_end"))
    return met(df, ends, "left_semi")
