"""Ordered-sequence operators: differences, repairs, sign continuity, ids, decimation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scale import numbered, previous, ranked_percentiles, running_sum, with_group


def _w(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def delta(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str = "delta") -> DataFrame:
    """First difference; null at the first row."""
    return df.withColumn(name, value - F.lag(value).over(_w(keys, order)))


def delta_stats(df: DataFrame, keys: list[str], order: list[str], value: Column) -> DataFrame:
    """Median, smallest and largest first difference by key."""
    own = delta(df, keys, order, value)
    rest = own.groupBy(*keys).agg(F.count("delta").alias("n"), F.min("delta").alias("min_delta"), F.max("delta").alias("max_delta"))
    middle = ranked_percentiles(own, "delta", (0.5,), keys).toDF(*keys, "median_delta")
    return with_group(rest, middle, keys).select(*keys, "n", "median_delta", "min_delta", "max_delta")


def repair_jump(df: DataFrame, keys: list[str], order: list[str], value: str, low: float, add: float) -> DataFrame:
    """From the first difference below ``low`` on, ``add`` is added: one jump per key."""
    w = _w(keys, order)
    gap = F.col(value) - F.lag(value).over(w)
    n = df.withColumn("__n", F.row_number().over(w)).withColumn("__d", gap)
    first = F.min(F.when(F.col("__d") < low, F.col("__n"))).over(Window.partitionBy(*keys))
    return n.withColumn("__f", first).withColumn(value, F.when(F.col("__n") >= F.col("__f"), F.col(value) + add).otherwise(F.col(value))).drop("__n", "__d", "__f")


def dedupe(df: DataFrame, keys: list[str], order: list[str], keep: str = "first") -> DataFrame:
    """One row per key, the first or last by ``order``; an aggregate, so tasks reduce before the shuffle."""
    value = F.struct(*[F.col(c) for c in df.columns])
    by = F.struct(*order)
    best = (F.min_by if keep == "first" else F.max_by)(value, by)
    return df.groupBy(*keys).agg(best.alias("__r")).select("__r.*")


def _place(df: DataFrame, order: list[str], keys: list[str], name: str) -> DataFrame:
    """Row numbers from 1: within each key, or, without keys, over the whole table (by ranges, not in one task)."""
    if keys:
        return df.withColumn(name, F.row_number().over(_w(keys, order)))
    return numbered(df, order, name)


def decimate(df: DataFrame, order: list[str], every: int, phase: str = "count", keys: list[str] = ()) -> DataFrame:
    """Every n-th row: phase='count' keeps rows n, 2n, ... ; phase='index' rows 1, n+1, ..."""
    n = F.col("__n") if phase == "count" else F.col("__n") - 1
    return _place(df, order, list(keys), "__n").where(n % every == 0).drop("__n")


def infer_unit(df: DataFrame, value: str, below: float, factor: float) -> DataFrame:
    """Multiplies the whole column where even its largest value is below a bound (seconds to ticks)."""
    top = df.agg(F.max(value).alias("__top"))
    return df.join(F.broadcast(top)).withColumn(value, F.when(F.col("__top") < below, F.col(value) * factor).otherwise(F.col(value))).drop("__top")  # one row


def rates_from_increments(df: DataFrame, time: str, values: list[str], digits: int = 6) -> DataFrame:
    """Increments to rates: times the rounded frequency of the mean time step; null where there is no step (one row, or one time)."""
    n = df.agg(F.try_divide(F.max(time) - F.min(time), F.count("*") - 1).alias("__dt"))
    f = F.rint(F.try_divide(F.lit(1.0), F.col("__dt")))
    return df.join(F.broadcast(n)).select(*[c for c in df.columns if c not in values], *[F.bround(F.col(v) * f, digits).alias(v) for v in values])  # one row


def sign_continuity(df: DataFrame, keys: list[str], order: list[str], parts: list[str]) -> DataFrame:
    """Quaternions flipped so that neighbours never oppose: the parity of negative dot products so far.

    Without keys the table is one series, which is scanned by ranges of its order.
    """
    rest = [c for c in df.columns if c not in parts]
    if keys:
        w = _w(keys, order)
        before = {p: F.lag(p).over(w) for p in parts}
        own = df
    else:
        own = previous(numbered(df, order, "__n"), "__n", parts, "__p_")
        before = {p: F.col(f"__p_{p}") for p in parts}
    d = None
    for p in parts:
        d = F.col(p) * before[p] if d is None else d + F.col(p) * before[p]
    negative = F.coalesce((d < 0).cast("long"), F.lit(0))
    if keys:
        own = own.withColumn("__neg", negative)
        own = own.withColumn("__s", F.sum("__neg").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    else:
        own = running_sum(own, "__n", negative, "__s")
    sign = F.when(F.col("__s") % 2 == 0, 1.0).otherwise(-1.0)
    return own.select(*rest, *[(F.col(p) * sign).alias(p) for p in parts])


def first_value_offset(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    return df.withColumn(name, F.col(value) - F.first(value).over(_w(keys, order).rowsBetween(Window.unboundedPreceding, 0)))


def slice_between(df: DataFrame, order: list[str], match: Column, buffer: int, keys: list[str] = ()) -> DataFrame:
    """Rows from the first to the last match, ``buffer`` rows more on each side; none without a match."""
    keys = list(keys)
    own = _place(df, order, keys, "__n")
    hit = F.when(match, F.col("__n"))
    edges = own.groupBy(*keys).agg((F.min(hit) - buffer).alias("__a"), (F.max(hit) + buffer).alias("__b"))
    return with_group(own, edges, keys).where("__n between __a and __b").drop("__n", "__a", "__b")


def named_ids(df: DataFrame, name: str, is_control: Column, base: int = 1000) -> DataFrame:
    """Ids by sorted name: control points from 1, others from ``base``. Numbers are given to the distinct names only, by ranges of them."""
    names = df.select(F.col(name), is_control.alias("__c")).distinct()
    ranked = numbered(names, [F.desc("__c"), F.asc(name)], "__n")
    controls = names.agg(F.count_if("__c").alias("__k"))
    ids = ranked.join(F.broadcast(controls)).withColumn("point_id", F.when(F.col("__c"), F.col("__n")).otherwise(F.col("__n") - F.col("__k") + (base - 1)))  # one row
    return df.join(ids.drop("__c", "__n", "__k"), name)


def merge_sorted(parts: list[DataFrame], order: list[str]) -> DataFrame:
    """All rows of several tables in one order; numbers in text columns are ordered as numbers where they are cast first."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(*order)


def stable_order(df: DataFrame, time: str, tie: str) -> DataFrame:
    """By time, equal times by ``tie`` (a file or line number): what a stable sort of a list gives."""
    return df.orderBy(time, tie)


def cumulative_share(df: DataFrame, keys: list[str], order: list, value: str, name: str) -> DataFrame:
    p = Window.partitionBy(*keys)
    return df.withColumn(name, F.sum(value).over(p.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) / F.sum(value).over(p))


def time_window(df: DataFrame, time: str, start, end, margin: str, required: bool = False) -> DataFrame:
    """Rows within the bounds widened by an interval; a plain filter, so that sources see it. With ``required`` an empty result is an error."""
    m = F.expr(f"INTERVAL {margin}")
    out = df.where(F.col(time).between(F.lit(start).cast("timestamp") - m, F.lit(end).cast("timestamp") + m))
    if required and out.isEmpty():
        raise ValueError(f"no rows between {start} and {end} (margin {margin})")
    return out
