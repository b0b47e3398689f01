"""As-of, nearest and positional joins of time series.

All are one shuffle by key: both sides are tagged, put together and scanned by a window
ordered by time. The side's rank at equal times says whether an equal epoch counts as
before or after. A series without a key is cut into time buckets (``bucketed``) with the
last and first epoch of the neighbouring buckets carried over, so it never becomes one
partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import staged
from ..functions.rotation import angle_lerp_deg, slerp


def bracket(left: DataFrame, right: DataFrame, keys: list[str], time: str, values: list[str], closed: str = "left") -> DataFrame:
    """Left rows with struct columns ``prev`` and ``next`` (time and values of the right side).

    closed='left': prev is strictly before, next at or after (search from the left).
    closed='right': prev is at or before, next strictly after.
    """
    pick = F.struct(F.col(time), *[F.col(v) for v in values])
    epochs = right.select(*keys, F.col(time).alias("__t"), pick.alias("__e"), F.lit(0 if closed == "right" else 1).alias("__s"), F.lit(None).cast(_row_type(left)).alias("__l"))
    probes = left.select(*keys, F.col(time).alias("__t"), F.lit(None).cast(epochs.schema["__e"].dataType).alias("__e"), F.lit(1 if closed == "right" else 0).alias("__s"), F.struct(*[F.col(c) for c in left.columns]).alias("__l"))
    w = Window.partitionBy(*keys).orderBy("__t", "__s")
    both = epochs.unionByName(probes)
    both = both.withColumn("prev", F.last("__e", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # The first epoch from here on is the last one of the reversed order.
    r = Window.partitionBy(*keys).orderBy(F.col("__t").desc(), F.col("__s").desc())
    both = both.withColumn("next", F.last("__e", ignorenulls=True).over(r.rowsBetween(Window.unboundedPreceding, 0)))
    return both.where("__l is not null").select("__l.*", "prev", "next")


def _row_type(df: DataFrame):
    return df.schema.__class__(df.schema.fields)


def asof(left: DataFrame, right: DataFrame, keys: list[str], time: str, values: list[str], direction: str = "backward", clamp: bool = False) -> DataFrame:
    """The epoch at or before (backward) or at or after (forward) each left row: columns r_<name>, null where there is none; with ``clamp`` the one at the series' end."""
    side, other = ("prev", "next") if direction == "backward" else ("next", "prev")
    both = bracket(left, right, keys, time, values, "right" if direction == "backward" else "left")
    found = F.coalesce(side, other) if clamp else F.col(side)
    return both.withColumn("__f", found).select(*left.columns, *[F.col(f"__f.{v}").alias(f"r_{v}") for v in [time, *values]])


def interpolate_attitude(left: DataFrame, right: DataFrame, keys: list[str], time: str, quaternion: tuple[str, str, str, str]) -> DataFrame:
    """Quaternions (scalar first) between the epochs at or before and after each left row, by the short way on the sphere; held at the series' ends: columns i_<name>."""
    both = bracket(left, right, keys, time, list(quaternion), "right")
    both = both.withColumn("__a", F.coalesce("prev", "next")).withColumn("__b", F.coalesce("next", "prev"))
    num = lambda c: c.cast("double")
    t0, t1 = num(F.col(f"__a.{time}")), num(F.col(f"__b.{time}"))
    k = F.coalesce(F.try_divide(num(F.col(time)) - t0, t1 - t0), F.lit(0.0))
    k = F.least(F.greatest(k, F.lit(0.0)), F.lit(1.0))
    both = staged(both.withColumn("__k", k), {f"__{s}{j}": F.col(f"__{s}.{q}") for s in "ab" for j, q in enumerate(quaternion)})
    mixed = slerp([F.col(f"__a{j}") for j in range(4)], [F.col(f"__b{j}") for j in range(4)], F.col("__k"))
    return both.select(*left.columns, *[c.alias(f"i_{q}") for c, q in zip(mixed, quaternion, strict=True)])


def require_inside(interpolated: DataFrame, value: str, time: str) -> DataFrame:
    """The rows of ``interpolate``, or an error naming a time that lies outside the series."""
    lost = interpolated.where(F.col(value).isNull()).select(time).first()
    if lost is not None:
        raise ValueError(f"{time} {lost[0]} is outside the trajectory")
    return interpolated


def nearest(left: DataFrame, right: DataFrame, keys: list[str], time: str, values: list[str], tolerance=None, as_number: Column | None = None) -> DataFrame:
    """The nearest epoch, ties to the earlier one; beyond ``tolerance`` (in the unit of ``distance``) null."""
    both = bracket(left, right, keys, time, values, "right")
    num = lambda c: c.cast("double")
    back, ahead = num(F.col(time)) - num(F.col(f"prev.{time}")), num(F.col(f"next.{time}")) - num(F.col(time))
    first = ahead.isNull() | (back <= ahead)
    best = F.when(first & back.isNotNull(), F.col("prev")).otherwise(F.col("next"))
    gap = F.when(first & back.isNotNull(), back).otherwise(ahead)
    if tolerance is not None:
        best = F.when(gap <= tolerance, best)
    return both.select(*left.columns, best.alias("__b")).select(*left.columns, *[F.col(f"__b.{v}").alias(f"r_{v}") for v in [time, *values]])


def interpolate(left: DataFrame, right: DataFrame, keys: list[str], time: str, values: list[str], angles: tuple[str, ...] = (), outside: str = "null") -> DataFrame:
    """Linear interpolation between the bracketing epochs; ``angles`` (degrees) go the short way.

    An exact hit gives that epoch; equal times give the earlier epoch; outside the series the
    result is null, or clamped to the nearest epoch with outside='clamp'.
    """
    both = bracket(left, right, keys, time, values)
    num = lambda c: c.cast("double")
    t0, t1 = num(F.col(f"prev.{time}")), num(F.col(f"next.{time}"))
    k = (num(F.col(time)) - t0) / (t1 - t0)
    out = []
    for v in values:
        a, b = F.col(f"prev.{v}"), F.col(f"next.{v}")
        mixed = angle_lerp_deg(a, b, k) if v in angles else a + (b - a) * k
        exact = F.when(t1 == num(F.col(time)), b).when(t0.isNull() | t1.isNull(), F.coalesce(a, b) if outside == "clamp" else F.lit(None)).when(t1 == t0, a).otherwise(mixed)
        out.append(exact.alias(f"i_{v}"))
    return both.select(*left.columns, *out)


def bucketed(left: DataFrame, right: DataFrame, time: str, width: float, values: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides of a keyless series with a bucket column ``b``; each bucket's right side also has its neighbours' edge epochs.

    Buckets without epochs in between are bridged by carrying the last epoch seen before and the
    first one after, found over one row per bucket.
    """
    b = F.floor(F.col(time).cast("double") / width).cast("long").alias("b")
    own = right.select(time, *values, b)
    edge = F.struct(time, *values)
    ends = own.groupBy("b").agg(F.min(edge).alias("lo"), F.max(edge).alias("hi"))
    probes = left.withColumn("b", F.floor(F.col(time).cast("double") / width).cast("long"))
    every = probes.select("b").union(ends.select("b")).distinct().join(ends, "b", "left")
    # One row per bucket, not per epoch. The next bucket's edge is the last one of the reversed order: a frame that
    # ends at the partition's end would be summed up anew for every row.
    before = Window.unboundedPreceding, -1
    p, n = F.last("hi", ignorenulls=True).over(Window.orderBy("b").rowsBetween(*before)), F.last("lo", ignorenulls=True).over(Window.orderBy(F.desc("b")).rowsBetween(*before))
    carried = every.select("b", p.alias("p"), n.alias("n"))
    extra = carried.select("b", F.explode(F.array("p", "n")).alias("e")).where("e is not null").select(f"e.{time}", *[f"e.{v}" for v in values], "b")
    return probes, own.unionByName(extra)


def flag_fill(lines: DataFrame, keys: list[str], order: str, flag: Column, values: list[str]) -> DataFrame:
    """Each line with the values of its nearest flagged line (f_<name>); a tie goes to the later one."""
    own = F.when(flag, F.struct(F.col(order), *[F.col(v) for v in values]))
    w, r = (Window.partitionBy(*keys).orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.col(order), F.desc(order)))
    both = lines.withColumn("__p", F.last(own, ignorenulls=True).over(w)).withColumn("__n", F.last(own, ignorenulls=True).over(r))
    num = lambda c: c.cast("double")
    back, ahead = num(F.col(order)) - num(F.col(f"__p.{order}")), num(F.col(f"__n.{order}")) - num(F.col(order))
    best = F.when(F.col("__n").isNull() | (back < ahead), F.col("__p")).otherwise(F.col("__n"))
    return both.withColumn("__b", best).select(*lines.columns, *[F.col(f"__b.{v}").alias(f"f_{v}") for v in [order, *values]])


def positional(points: DataFrame, lines: DataFrame, value: str, line_no: str, rounding: str = "even") -> DataFrame:
    """Line of an image coordinate: rounded half to even, or cut off."""
    at = F.rint(F.col(value)) if rounding == "even" else F.col(value)
    return points.withColumn("__line", at.cast("long")).join(lines, F.col("__line") == F.col(line_no)).drop("__line")


def exact_time(left: DataFrame, right: DataFrame, time: str, ticks_per_second: int = 100_000, order: tuple[str, ...] = ()) -> DataFrame:
    """Equality of times, on whole ticks rather than floating numbers; the first match by ticks, as struct ``r``.

    Of one tick the earliest time is first; of equal times the smallest ``order`` columns, then the smallest
    other columns, so that rows in any order or partition give the same match. Left rows without one have null.
    """
    tick = F.rint(F.col(time) * ticks_per_second).cast("long")
    rest = [f.name for f in right.schema if f.name not in (time, *order) and _sortable(f.dataType)]
    first = right.withColumn("__k", tick).groupBy("__k").agg(F.min_by(F.struct(*right.columns), F.struct(time, *order, *rest)).alias("r"))
    return left.withColumn("__k", tick).join(first, "__k", "left").drop("__k")


def _sortable(t: T.DataType) -> bool:
    if isinstance(t, T.StructType):
        return all(_sortable(f.dataType) for f in t)
    return _sortable(t.elementType) if isinstance(t, T.ArrayType) else not isinstance(t, (T.MapType, T.VariantType, T.CalendarIntervalType, T.SpatialType))
