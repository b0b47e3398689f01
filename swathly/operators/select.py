"""Small projections, filters, summaries and samples of the pipeline."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scale import with_group


def time_of_day(seconds_of_week: Column) -> Column:
    return F.pmod(seconds_of_week, F.lit(86400.0))


def ticks(seconds: Column) -> Column:
    """Whole ticks of 1e-5 s."""
    return F.rint(seconds * 1e5).cast("long")


def gyro_radians(degrees: Column) -> Column:
    return F.bround(F.radians(degrees), 6)


def corrected_pps(gps: Column, nav: Column, telegram: Column, pps: Column) -> Column:
    """GPS time of a flagged line's pulse, one later where it belongs to the pulse before.

    ``nav`` less ``gps`` in 1e-4 s is then a little over 1 or under 0.027, while the telegram's
    internal time less the pulse's, in 1e-5 s, is a little over 0.
    """
    ahead, after = (nav - gps) / 1e4, (telegram - pps) / 1e5
    stale = ((ahead > 1) & (ahead < 1.027)) | (ahead < 0.027)
    return F.when(stale & (after > 0) & (after < 0.027), gps + 1).otherwise(gps)


def frame_times(frames: DataFrame, keys: list[str] = ("file",), order: str = "line_id", corrected: bool = False) -> DataFrame:
    """The lines of a frame table with ``tick``: their time of day in 1e-5 s.

    Each line takes GPS time and internal pulse time from its nearest flagged line (a tie goes to
    the later one); ``corrected`` first brings the flagged lines' pulses up to date, for which the
    frames need nav_time and telegram_time. Without any flagged line the tick is null.
    """
    from .asof import flag_fill

    own = frames
    if corrected:
        own = own.withColumn("gps_pps", F.when(F.col("flagged"), corrected_pps(F.col("gps_pps"), F.col("nav_time"), F.col("telegram_time"), F.col("internal_pps"))).otherwise(F.col("gps_pps")))
    filled = flag_fill(own, list(keys), order, F.col("flagged"), ["gps_pps", "internal_pps"])
    tick = line_time(F.col("f_gps_pps"), F.col("internal_time"), F.col("f_internal_pps"))
    return filled.withColumn("tick", tick).select(*frames.columns, "tick")


def internal_clock_times(frames: DataFrame, created: Column, keys: list[str] = ("file",), order: str = "line_id") -> DataFrame:
    """Lines timed by the internal clock alone: the file's creation time (seconds of day, cut to 1e-4 s) plus the counter since its first line."""
    first = F.first("internal_time").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return frames.withColumn("tick", (created * 1e4).cast("long") * 10 + F.col("internal_time") - first)


def line_time(gps_pps: Column, internal: Column, internal_pps: Column) -> Column:
    """Time of a line in ticks, from the flagged line's GPS second and the internal counters."""
    return gps_pps * 10 + (internal - internal_pps)


def swap_words(x: Column) -> Column:
    """A 32-bit number whose 16-bit halves are exchanged."""
    return F.shiftleft(x.bitwiseAND(65535), 16).bitwiseOR(F.shiftright(x, 16).bitwiseAND(65535))


def control_or_tie(df: DataFrame, point: str, limit: int = 1000) -> DataFrame:
    """Points below ``limit`` are control points."""
    return df.withColumn("is_control", F.col(point) < limit)


def block_is_control(df: DataFrame, block: str, order: list[str], point: str, limit: int = 1000) -> DataFrame:
    """A whole block follows its first point."""
    first = F.first(point).over(Window.partitionBy(block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("is_control", first < limit)


def trim_edges(df: DataFrame, keep: Column, order: list[str], keys: list[str] = ()) -> DataFrame:
    """Rows that pass, without the first and the last of them. ``order`` has to be total; the edges are one aggregate, so no task holds a whole series."""
    keys, own = list(keys), df.where(keep).withColumn("__o", F.struct(*order))
    edges = own.groupBy(*keys).agg(F.min("__o").alias("__a"), F.max("__o").alias("__b"))
    return with_group(own, edges, keys).where((F.col("__o") > F.col("__a")) & (F.col("__o") < F.col("__b"))).drop("__o", "__a", "__b")


def time_range(df: DataFrame, time: str) -> DataFrame:
    """First and last time; zeros of an empty series."""
    return df.agg(F.coalesce(F.min(time), F.lit(0.0)).alias("first"), F.coalesce(F.max(time), F.lit(0.0)).alias("last"))


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.count_distinct(c).alias(f"n_{c}") for c in columns])


def tile_summary(df: DataFrame, tile: str, value: str) -> DataFrame:
    """Mean and spread of the tiles' means, and how many tiles have data."""
    per = df.groupBy(tile).agg(F.avg(value).alias("m"))
    return per.agg(F.count("*").alias("tiles"), F.count("m").alias("with_data"), F.avg("m").alias("mean_of_means"), F.stddev_pop("m").alias("std_of_means"))


def top_bands(loadings: DataFrame, component: str, band: str, loading: str, n: int = 4, always: int = 4) -> DataFrame:
    """Bands with the n largest loadings of each component, together with the first ``always``."""
    w = Window.partitionBy(component).orderBy(F.abs(loading).desc(), band)
    top = loadings.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).select(band)
    return top.union(loadings.where(F.col(band) < always).select(band)).distinct()


def sample_per_key(df: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """n rows of each key without replacement, by a seeded hash of the row: the same rows on every run."""
    mixed = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in df.columns]).cast("binary"))
    w = Window.partitionBy(*keys).orderBy(mixed, *df.columns)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def optimal_gsd(heights: DataFrame, altitude: str, ground: float, ifov: float) -> DataFrame:
    """Sampling distance of the mean flight height."""
    return heights.agg(((F.avg(altitude) - ground) * math.tan(ifov / 2) * 2).alias("gsd"))


def cameras_and_points(ties: DataFrame, cameras: DataFrame, points: DataFrame, camera: str, point: str) -> DataFrame:
    """Tie points with their camera and their ground point: two equi-joins."""
    return ties.join(cameras, camera).join(points, point)


def footprint(df: DataFrame, origin: tuple[str, str, str], rays: dict[str, tuple[str, str, str]], height) -> DataFrame:
    """Left, centre and right rays of a line where they meet the horizontal plane: one row per ray."""
    each = F.array(*[F.struct(F.lit(n).alias("ray"), *[F.col(c).alias(k) for c, k in zip(cs, ("rx", "ry", "rz"), strict=True)]) for n, cs in rays.items()])
    e = df.withColumn("__r", F.explode(each)).select(*df.columns, "__r.*")
    k = (F.lit(float(height)) - F.col(origin[2])) / F.col("rz")
    return e.withColumn("gx", F.col(origin[0]) + F.col("rx") * k).withColumn("gy", F.col(origin[1]) + F.col("ry") * k)


def keep_last(df: DataFrame, key: str, order: str) -> DataFrame:
    """What a dictionary filled line by line holds: the last row of each key."""
    return df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), order).alias("__r")).select(key, "__r.*")


def valid_pixels(df: DataFrame, spectrum: str, nodata: float, name: str = "valid") -> DataFrame:
    """Whether any band of a pixel differs from ``nodata``; a null spectrum has none."""
    return df.withColumn(name, F.coalesce(F.exists(spectrum, lambda x: x != F.lit(nodata)), F.lit(False)))


def band_subset(df: DataFrame, spectrum: str, bands: list[int], metadata: dict[str, list] | None = None) -> tuple[DataFrame, dict[str, list]]:
    """Spectra with some bands (from 0), in rising order, each once; and their share of the per-band metadata."""
    pick = sorted(set(bands))
    out = df.withColumn(spectrum, F.transform(F.array(*[F.lit(b) for b in pick]), lambda i: F.get(spectrum, i)))
    return out, {k: [v[b] for b in pick] for k, v in (metadata or {}).items()}


def closest(df: DataFrame, value: str, name: str, targets: list[float]) -> DataFrame:
    """target, name: the row whose value is nearest to each of a few targets, the first by ``name`` on ties. One pass; tasks reduce before the shuffle."""
    each = df.select(name, value, F.explode(F.array(*[F.lit(float(t)) for t in targets])).alias("target"))
    return each.groupBy("target").agg(F.min_by(name, F.struct(F.abs(F.col(value) - F.col("target")), name)).alias(name))


def with_wavelengths(targets: list[float], present: list[float]) -> list[float]:
    """Wanted wavelengths, with red, green and blue where none of them is there."""
    return [*targets, *[w for w in (450.0, 550.0, 650.0) if w not in present and w not in targets]]


def set_operations(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """op, key: except, union and intersect of two tables' keys, and all of both."""
    a, b = a.select(key), b.select(key)
    named = lambda op, df: df.select(F.lit(op).alias("op"), key)
    return named("except", a.distinct().exceptAll(b.distinct())).unionByName(named("union", a.union(b).distinct())).unionByName(named("intersect", a.intersect(b))).unionByName(named("all", a.union(b)))


def top_rows(df: DataFrame, by: str, tie: str, k: int) -> DataFrame:
    """The k rows with the largest value; each task keeps its k best."""
    return df.orderBy(F.desc(by), tie).limit(k)


def flip_sign_bit(x: Column) -> Column:
    """An unsigned 16-bit number with its highest bit turned over."""
    return x.bitwiseAND(65535).bitwiseXOR(F.lit(0x8000))


def swath_elevation(points: DataFrame, height: str) -> DataFrame:
    """Mean surface height along the track; 0 where there is none."""
    return points.agg(F.coalesce(F.avg(F.when(~F.isnan(height), F.col(height))), F.lit(0.0)).alias("elevation"))


def transform_points(df: DataFrame, at: tuple[str, str, str], source: int, target: int, geoid: bool = False) -> DataFrame:
    """The points with px, py, pz in another system, by EPSG code; every row stays what it is, so an input number keeps the order.

    With ``geoid`` the heights of Swiss points (2056) are over the geoid and get its undulation added,
    or taken away again on the way back.
    """
    from ..functions.geodesy import project3, swiss_geoid, unproject3

    x, y, h = (F.col(c) for c in at)
    if geoid and source == 2056:
        h = h + swiss_geoid(x, y)
    lat, lon, up = unproject3(x, y, h, source)
    px, py, pz = project3(lat, lon, up, target)
    if geoid and target == 2056:
        pz = pz - swiss_geoid(px, py)
    return df.withColumns({"px": px, "py": py, "pz": pz})
