"""Raster lookups and grids. A raster is a table (row, col, z) with a one-row geotransform kept on the driver.

Lookups are equi-joins: each point is exploded into its neighbour cells, joined on (row,
col), and summed up again by point; nothing is broadcast unless Spark finds it small.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """Upper-left corner, cell size, size; rows grow downward. No half-cell offset, as the sensor pipeline has it."""

    x0: float
    y0: float
    res: float
    rows: int
    cols: int

    def col_of(self, x: Column) -> Column:
        return (x - self.x0) / self.res

    def row_of(self, y: Column) -> Column:
        return (self.y0 - y) / self.res


def _corners(r: Column, c: Column, fr: Column, fc: Column) -> Column:
    """Four neighbours of a place with their weights, in a fixed order."""
    return F.array(*[F.struct(F.lit(2 * i + j).alias("k"), (r + i).alias("__r"), (c + j).alias("__c"), ((fr if i else 1 - fr) * (fc if j else 1 - fc)).alias("w")) for i in (0, 1) for j in (0, 1)])


def bilinear(points: DataFrame, cells: DataFrame, point_id: str, row: str, col: str, rows: int, cols: int, value: str = "z", carry: list[str] = ()) -> DataFrame:
    """point_id, the carried columns and z: null where any of the four neighbours is missing (even at weight 0) or the base cell lies outside [0, n - 2].

    One join by cell and one sum by point; a point is not joined again with what it carries.
    """
    r, c = F.floor(row).cast("long"), F.floor(col).cast("long")
    inside = (r >= 0) & (r <= rows - 2) & (c >= 0) & (c <= cols - 2)
    near = F.when(inside, _corners(r, c, F.col(row) - F.floor(row), F.col(col) - F.floor(col)))
    each = points.select(point_id, *carry, F.explode_outer(near).alias("__n")).select(point_id, *carry, "__n.*")
    own = cells.where(F.col(value).isNotNull() & ~F.isnan(value)).select(F.col("row").cast("long").alias("__r"), F.col("col").cast("long").alias("__c"), F.col(value).alias("__v"))
    z = each.join(own, ["__r", "__c"], "left")
    total = F.when(F.count("__v") == 4, F.sum(F.col("w") * F.col("__v")))
    return z.groupBy(point_id, *carry).agg(total.alias(value))


def nearest(points: DataFrame, cells: DataFrame, row: str, col: str, value: str = "z") -> DataFrame:
    """The cell at the half-even rounded place; null outside."""
    at = points.withColumn("__r", F.rint(row).cast("long")).withColumn("__c", F.rint(col).cast("long"))
    c = cells.select(F.col("row").alias("__r"), F.col("col").alias("__c"), F.col(value))
    return at.join(c, ["__r", "__c"], "left").drop("__r", "__c")


def cube_lookup(points: DataFrame, cube: DataFrame, point_id: str, line: str, sample: str, lines: int, samples: int, edge: str = "fixed") -> DataFrame:
    """point_id, spectrum of every point, between four pixels of a cube (line, sample, spectrum): null outside, or where a pixel of some weight is missing.

    edge='fixed' takes the last pixel at the last place; edge='compat' the one before it. Whole
    spectra are weighed and added; the four of a point meet in one row.
    """
    frac = {c: F.col(c) - F.floor(c) for c in (line, sample)}
    base = {c: F.greatest(F.lit(0), F.least(F.floor(c), F.lit(n - 2))).cast("long") for c, n in ((line, lines), (sample, samples))}
    if edge == "fixed":
        frac = {c: F.col(c) - base[c] for c in (line, sample)}
    inside = (F.col(line) >= 0) & (F.col(line) <= lines - 1) & (F.col(sample) >= 0) & (F.col(sample) <= samples - 1)
    near = F.when(inside, F.filter(_corners(base[line], base[sample], frac[line], frac[sample]), lambda n: n["w"] != 0))
    each = points.select(point_id, F.explode_outer(near).alias("__n")).select(point_id, "__n.*")
    own = cube.where("spectrum is not null").select(F.col("line").cast("long").alias("__r"), F.col("sample").cast("long").alias("__c"), F.col("spectrum").cast("array<double>").alias("s"))
    got = each.join(own, ["__r", "__c"], "left").groupBy(point_id).agg(F.count("w").alias("need"), F.count("s").alias("n"), F.sort_array(F.collect_list(F.struct("k", "w", "s"))).alias("v"))
    weighed = F.transform("v", lambda x: F.transform(x["s"], lambda y: y * x["w"]))
    total = F.aggregate(F.slice(weighed, F.lit(2), F.lit(3)), F.get(weighed, F.lit(0)), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    return got.select(point_id, F.when((F.col("need") > 0) & (F.col("n") == F.col("need")), total).alias("spectrum"))


def cube_nearest(points: DataFrame, cube: DataFrame, line: str, sample: str) -> DataFrame:
    """The points with the spectrum of the pixel at the half-even rounded place; null outside."""
    at = points.withColumn("__l", F.rint(line).cast("long")).withColumn("__s", F.rint(sample).cast("long"))
    own = cube.select(F.col("line").cast("long").alias("__l"), F.col("sample").cast("long").alias("__s"), "spectrum")
    return at.join(own, ["__l", "__s"], "left").drop("__l", "__s")


def occluded(rays: DataFrame, cells: DataFrame, ray_id: str, start: tuple[str, str, str], end: tuple[str, str, str], grid: Grid, samples: int = 50, tol: float = 0.5) -> DataFrame:
    """ray_id, occluded: whether the surface rises above any of the ray's samples by more than ``tol``. Missing surface hides nothing.

    A sample carries its height through the lookup. It can matter only where the surface reaches it,
    so samples above the highest cell (one number) are not looked up at all.
    """
    top = cells.agg(F.max(F.when(~F.isnan("z"), F.col("z"))).alias("__top"))
    alpha = F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda k: F.lit(0.05) + k * (0.9 / max(samples - 1, 1)))
    s = rays.select(ray_id, F.posexplode(alpha).alias("__k", "__a"), *start, *end)
    at = [F.col(p) + (F.col(q) - F.col(p)) * F.col("__a") for p, q in zip(start, end, strict=True)]
    s = s.select(F.struct(ray_id, "__k").alias("__pid"), grid.row_of(at[1]).alias("__row"), grid.col_of(at[0]).alias("__col"), at[2].alias("__z"))
    low = s.join(F.broadcast(top)).where(F.col("__top") > F.col("__z") + tol).drop("__top")  # one row
    z = bilinear(low, cells, "__pid", "__row", "__col", grid.rows, grid.cols, "z", ["__z"])
    hit = z.where(F.col("z") > F.col("__z") + tol).select(F.col(f"__pid.{ray_id}").alias("__id")).distinct()
    return rays.select(ray_id).distinct().join(hit, F.col(ray_id) == F.col("__id"), "left").select(ray_id, F.col("__id").isNotNull().alias("occluded"))


def output_grid(spark: SparkSession, xmin: float, ymin: float, xmax: float, ymax: float, gsd: float, tile: int) -> DataFrame:
    """row, col, x, y, tile_row, tile_col of every output cell: bounds snapped outward to the sampling distance, partial tiles at the right and bottom."""
    x0, y1 = math.floor(xmin / gsd) * gsd, math.ceil(ymax / gsd) * gsd
    cols, rows = round((math.ceil(xmax / gsd) * gsd - x0) / gsd), round((y1 - math.floor(ymin / gsd) * gsd) / gsd)
    g = spark.range(rows * cols).select(F.expr(f"id div {cols}").alias("row"), (F.col("id") % cols).alias("col"))
    return g.select("row", "col", (x0 + F.col("col") * gsd).alias("x"), (y1 - F.col("row") * gsd).alias("y"), F.expr(f"row div {tile}").alias("tile_row"), F.expr(f"col div {tile}").alias("tile_col"))


def overlapping_tiles(spark: SparkSession, width: int, height: int, size: int, overlap: int) -> DataFrame:
    """x, y, w, h of tiles at steps of max(1, size - overlap)."""
    step = max(1, size - overlap)
    xs = spark.range(0, max(width, 1), step).select(F.col("id").alias("x"))
    return xs.select("x", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(height - 1, 0)).cast("long"), F.lit(step).cast("long"))).alias("y")).select("x", "y", F.least(F.lit(size), width - F.col("x")).cast("long").alias("w"), F.least(F.lit(size), height - F.col("y")).cast("long").alias("h"))


def crop_border(cells: DataFrame, k: int, rows: int, cols: int, nodata: float, value: str = "z") -> DataFrame:
    edge = (F.col("row") < k) | (F.col("row") >= rows - k) | (F.col("col") < k) | (F.col("col") >= cols - k)
    return cells.withColumn(value, F.when(edge, F.lit(nodata)).otherwise(F.col(value)))


def raster_stats(cells: DataFrame, value: str = "z", nodata: float | None = None) -> DataFrame:
    """n, mean, lowest and highest of the valid cells."""
    z = F.when(~F.isnan(value) & (F.col(value) != nodata if nodata is not None else F.lit(True)), F.col(value))
    return cells.agg(F.count(z).alias("n"), F.avg(z).alias("mean_z"), F.min(z).alias("min_z"), F.max(z).alias("max_z"))


def resample(target: DataFrame, cells: DataFrame, grid: Grid, x: Column, y: Column, value: str = "z") -> DataFrame:
    """Inverse mapping of a reprojected raster: for each target cell (row, col) the source value at (x, y), linearly."""
    pts = target.select(F.struct("row", "col").alias("pid"), grid.row_of(y).alias("r"), grid.col_of(x).alias("c"))
    return bilinear(pts, cells, "pid", "r", "c", grid.rows, grid.cols, value).select("pid.row", "pid.col", value)


def to_cells(points: DataFrame, grid: Grid, x: Column, y: Column) -> DataFrame:
    """Points with their fractional row and column; no half-cell offset."""
    return points.withColumn("row", grid.row_of(y)).withColumn("col", grid.col_of(x))


def undulation_grid(spark: SparkSession, xmin: float, ymin: float, xmax: float, ymax: float, step: float) -> DataFrame:
    """x, y, undulation on a grid that takes in both bounds, by the approximate geoid plane."""
    from ..functions.geodesy import swiss_geoid

    nx, ny = math.ceil((xmax - xmin) / step) + 1, math.ceil((ymax - ymin) / step) + 1
    g = spark.range(nx * ny).select(F.least(F.lit(xmin) + (F.col("id") % nx) * step, F.lit(float(xmax))).alias("x"), F.least(F.lit(ymin) + F.expr(f"id div {nx}") * step, F.lit(float(ymax))).alias("y"))
    return g.withColumn("undulation", swiss_geoid("x", "y"))


def edge_samples(grid: Grid, per_edge: int = 20) -> list[tuple[float, float]]:
    """Points along the four edges of a raster, from which its extent in another projection is read."""
    w, h = grid.cols * grid.res, grid.rows * grid.res
    f = [k / (per_edge - 1) for k in range(per_edge)]
    return [(grid.x0 + w * t, grid.y0) for t in f] + [(grid.x0 + w * t, grid.y0 - h) for t in f] + [(grid.x0, grid.y0 - h * t) for t in f] + [(grid.x0 + w, grid.y0 - h * t) for t in f]


def equalize_tiles(cells: DataFrame, value: str, tiles: tuple[int, int], size: tuple[int, int], clip: float = 0.03, bins: int = 256) -> DataFrame:
    """Adaptive histogram equalisation of values in 0..1: row, col, ``value``, ``equalized``.

    The image is cut into a grid of tiles. Each tile's histogram is clipped at a share of its cells,
    what is cut off spread evenly, and summed up to a mapping; a cell takes the mappings of the four
    tiles around it by its distance from their centres. Histograms are small sums (tiles x bins rows).
    """
    (tr, tc), (rows, cols) = tiles, size
    h, w = rows / tr, cols / tc
    bin_of = F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int")
    own = cells.where(F.col(value).isNotNull()).withColumn("__bin", F.greatest(bin_of, F.lit(0)))
    place = own.withColumn("__tr", F.least(F.floor(F.col("row") / h), F.lit(tr - 1)).cast("int")).withColumn("__tc", F.least(F.floor(F.col("col") / w), F.lit(tc - 1)).cast("int"))
    counts = place.groupBy("__tr", "__tc", "__bin").agg(F.count("*").alias("n"))
    per = counts.groupBy("__tr", "__tc").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("__bin", "n"))).alias("m"))  # bins entries
    full = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.element_at("m", b), F.lit(0)).cast("double") / F.col("total"))
    cut = F.transform("f", lambda x: F.least(x, F.lit(float(clip))))
    rest = F.aggregate("f", F.lit(0.0), lambda a, x: a + F.greatest(x - clip, F.lit(0.0))) / bins
    per = per.withColumn("f", full).withColumn("c", cut).withColumn("rest", rest)
    summed = F.aggregate("c", F.array(F.lit(0.0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x + F.col("rest"))))
    maps = per.select(F.col("__tr").alias("__r"), F.col("__tc").alias("__c"), F.slice(summed, 2, bins).alias("map"))
    y, x = (F.col("row") + 0.5) / h - 0.5, (F.col("col") + 0.5) / w - 0.5
    y, x = F.least(F.greatest(y, F.lit(0.0)), F.lit(float(tr - 1))), F.least(F.greatest(x, F.lit(0.0)), F.lit(float(tc - 1)))
    r, c = F.floor(y).cast("long"), F.floor(x).cast("long")
    near = own.select("row", "col", value, "__bin", F.explode(F.filter(_corners(r, c, y - r, x - c), lambda n: n["w"] != 0)).alias("__n")).select("row", "col", value, "__bin", "__n.*")
    both = near.join(maps, ["__r", "__c"])
    mapped = F.get("map", F.col("__bin"))
    return both.groupBy("row", "col", value).agg((F.sum(F.col("w") * mapped) / F.sum("w")).alias("equalized"))
