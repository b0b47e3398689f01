"""Statistics: errors, percentiles, stretches, histograms, fits, covariance and principal components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scale import ranked_percentiles


def error_stats(df: DataFrame, error: str, valid: Column, thresholds: tuple[float, ...], pass_at: float) -> DataFrame:
    """One row over the valid rows: mean, population spread, extremes, exact median, root mean square, counts within thresholds, pass rate; zeros if none is valid."""
    middle = ranked_percentiles(df.where(valid), error, (0.5,)).toDF("__median")
    e = F.when(valid, F.col(error))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    n = F.count(e)
    counts = [F.count_if(valid & (F.col(error) <= t)).alias(f"within_{str(t).replace('.', '_')}") for t in thresholds]
    own = df.agg(
        F.count("*").alias("n_total"), n.alias("n_valid"), zero(F.avg(e)).alias("mean_error"), zero(F.stddev_pop(e)).alias("std_error"), zero(F.min(e)).alias("min_error"), zero(F.max(e)).alias("max_error"),
        zero(F.sqrt(F.avg(e * e))).alias("rmse"), *counts, zero(F.count_if(valid & (F.col(error) <= pass_at)) / F.nullif(n, F.lit(0))).alias("pass_rate"),
    )
    columns = [*own.columns[:6], "median_error", *own.columns[6:]]
    return own.join(F.broadcast(middle)).withColumn("median_error", zero(F.col("__median"))).select(*columns)  # one row each


def error_by_groups(df: DataFrame, error: str, valid: Column, groups: tuple[str, str]) -> DataFrame:
    """Count, mean, largest and root mean square by each of two keys, in one pass over grouping sets."""
    a, b = groups
    own = df.where(valid)
    sets = own.groupingSets([[a], [b]], a, b)
    e = F.col(error)
    return sets.agg(F.count("*").alias("n"), F.avg(e).alias("mean_error"), F.max(e).alias("max_error"), F.sqrt(F.avg(e * e)).alias("rmse"))


def percentiles(df: DataFrame, value: str, ps: tuple[float, ...], keys: list[str] = (), approximate: bool = False) -> DataFrame:
    """Linearly interpolated percentiles p02, p50, ..., exact whatever the size of a key; approximate ones only on request."""
    names = [f"p{round(p * 100):02d}" for p in ps]
    if approximate:
        own = df.groupBy(*keys).agg(F.percentile_approx(value, F.array(*[F.lit(float(p)) for p in ps])).alias("__p"))
        return own.select(*keys, *[F.get("__p", F.lit(k)).alias(n) for k, n in enumerate(names)])
    return ranked_percentiles(df, value, ps, list(keys)).toDF(*keys, *names)


def stretch(df: DataFrame, value: str, low: float = 0.02, high: float = 0.98, gamma: float = 1.0, top: int = 255) -> DataFrame:
    """Values between two percentiles brought to 0..top (raised to ``gamma``, cut off): column ``stretched``."""
    p = percentiles(df, value, (low, high)).toDF("__lo", "__hi")
    x = (F.col(value) - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))
    x = F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    x = F.when(F.col("__hi") > F.col("__lo"), F.pow(x, F.lit(float(gamma))) * top).otherwise(0.0)
    return df.join(F.broadcast(p)).withColumn("stretched", x.cast("int")).drop("__lo", "__hi")  # one row


def min_max(df: DataFrame, columns: list[str], top: int = 255) -> DataFrame:
    """Each column brought from its own range over the table to 0..top, cut off; 0 where a column has one value only."""
    ends = df.agg(*[f(c).alias(f"__{n}{k}") for k, c in enumerate(columns) for n, f in (("a", F.min), ("b", F.max))])
    out = df.join(F.broadcast(ends))  # one row
    for k, c in enumerate(columns):
        share = F.try_divide(F.col(c) - F.col(f"__a{k}"), F.col(f"__b{k}") - F.col(f"__a{k}"))
        out = out.withColumn(c, F.when(F.col(c).isNotNull(), F.coalesce(share, F.lit(0.0)) * top).cast("int"))
    return out.drop(*ends.columns)


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """bin (1..bins), n; the upper bound belongs to the last bin."""
    b = F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins).cast("long"))
    b = F.when(F.col(value) == high, F.lit(bins).cast("long")).otherwise(b)
    return df.where(F.col(value).between(low, high)).groupBy(b.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def undulation(df: DataFrame, height_in: str, height_out: str) -> DataFrame:
    """Mean, lowest and highest difference of two heights over the points that have both, and their number."""
    d = F.col(height_out) - F.col(height_in)
    return df.agg(F.count(d).alias("n"), F.avg(d).alias("mean_undulation"), F.min(d).alias("min_undulation"), F.max(d).alias("max_undulation"))


def grouped_index(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """key, rows: the rows of each key as an ordered array. For keys of bounded size, as a point's or an image's measurements."""
    rest = [c for c in df.columns if c != key]
    own = F.struct(*order, *[c for c in rest if c not in order])
    return df.groupBy(key).agg(F.sort_array(F.collect_list(own)).alias("rows"))


def linear_fit(df: DataFrame, y: str, x: str, keys: list[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def polynomial_fit(df: DataFrame, y: str, x: str, degree: int) -> list[float]:
    """Coefficients, constant first: power sums in one aggregate, the small system on the driver. x is centred and scaled first."""
    s = df.agg(F.avg(x).alias("m"), F.stddev_pop(x).alias("d")).first()
    m, d = s.m, s.d or 1.0
    t = (F.col(x) - m) / d
    sums = [F.sum(F.pow(t, k)).alias(f"s{k}") for k in range(2 * degree + 1)] + [F.sum(F.col(y) * F.pow(t, k)).alias(f"b{k}") for k in range(degree + 1)]
    r = df.agg(*sums).first()
    a = np.array([[r[f"s{i + j}"] for j in range(degree + 1)] for i in range(degree + 1)])
    c = np.polynomial.Polynomial(np.linalg.solve(a, [r[f"b{i}"] for i in range(degree + 1)]))
    return list(c(np.polynomial.Polynomial([-m / d, 1 / d])).coef)


def levenberg_marquardt(residuals, start: np.ndarray, steps: int = 100, tol: float = 1e-12) -> tuple[np.ndarray, float]:
    """Driver-side fit of a few parameters to a calibration table: parameters and root mean square."""
    p, lam = np.array(start, float), 1e-3
    r = residuals(p)
    for _ in range(steps):
        j = np.empty((len(r), len(p)))
        for k in range(len(p)):
            h = 1e-6 * max(1.0, abs(p[k]))
            q = p.copy()
            q[k] += h
            j[:, k] = (residuals(q) - r) / h
        g, n = j.T @ r, j.T @ j
        step = np.linalg.solve(n + lam * np.diag(np.maximum(np.diag(n), 1e-12)), -g)
        new = residuals(p + step)
        if new @ new < r @ r:
            done = (r @ r - new @ new) < tol * (r @ r + 1e-300)
            p, r, lam = p + step, new, lam / 3
            if done:
                break
        else:
            lam *= 4
            if lam > 1e12:
                break
    return p, float(np.sqrt(np.mean(r * r)))


def mean_focal(df: DataFrame, x: str, theta: str, centre: float, keys: list[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg((F.col(x) - centre) / F.tan(F.col(theta))).alias("focal"))


def shift_advice(df: DataFrame, du: str, dv: str, limit: float) -> DataFrame:
    """Mean and spread of the residuals, and whether a constant shift explains them."""
    s = df.agg(F.avg(du).alias("mean_du"), F.avg(dv).alias("mean_dv"), F.stddev_pop(du).alias("std_du"), F.stddev_pop(dv).alias("std_dv"))
    return s.withColumn("shifted", (F.abs("mean_du") > limit) | (F.abs("mean_dv") > limit))


def gray_range(df: DataFrame, spectrum: str, out: str = "gray") -> DataFrame:
    """Band mean of each pixel, brought to 0..255 over the whole image, cut off; null without bands."""
    total = F.aggregate(F.col(spectrum), F.lit(0.0), lambda a, x: a + x.cast("double"))
    g = df.withColumn("__g", F.try_divide(total, F.size(spectrum)))
    b = g.agg(F.min("__g").alias("__a"), F.max("__g").alias("__b"))
    return g.join(F.broadcast(b)).withColumn(out, F.when(F.col("__b") > F.col("__a"), ((F.col("__g") - F.col("__a")) / (F.col("__b") - F.col("__a")) * 255).cast("int")).when(F.col("__g").isNotNull(), 0)).drop("__g", "__a", "__b")  # one row


def nearest_class(df: DataFrame, label: str, vector: str) -> DataFrame:
    """The rows with ``nearest``: the class whose mean vector is nearest, the smaller label on ties. The classes' means travel as one array: a row per class, whatever the corpus."""
    x = F.transform(vector, lambda v: v.cast("double"))
    means = df.select(label, F.posexplode(x).alias("i", "v")).groupBy(label, "i").agg(F.avg("v").alias("v"))
    means = means.groupBy(label).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda e: e["v"]).alias("m"))
    few = means.agg(F.sort_array(F.collect_list(F.struct(F.col(label).alias("label"), "m"))).alias("__means"))
    gap = lambda m: F.round(F.aggregate(F.zip_with(x, m, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b), 9)
    best = F.array_min(F.transform("__means", lambda e: F.struct(gap(e["m"]).alias("d"), e["label"].alias("label"))))
    return df.join(F.broadcast(few)).withColumn("nearest", best["label"]).drop("__means")  # one row


# -- principal components ----------------------------------------------------------


def moments(df: DataFrame, spectrum: str, bands: int, nodata: float | None = None) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and sample covariance of the valid spectra: partial sums per task, shifted by a first mean, added up in a few rows.

    Not valid are null spectra, those with another number of bands or a null among them, and
    those whose bands are all ``nodata``.
    """
    own = df.select(F.col(spectrum).cast("array<double>").alias("s")).where((F.size("s") == bands) & F.forall("s", lambda x: x.isNotNull()))
    if nodata is not None:
        own = own.where(F.exists("s", lambda x: x != nodata))
    first = own.agg(F.count("*").alias("n"), *[F.avg(F.element_at("s", k + 1)).alias(f"m{k}") for k in range(bands)]).first()
    if not first.n:
        return 0, np.zeros(bands), np.zeros((bands, bands))
    mean = np.array([first[f"m{k}"] for k in range(bands)])

    def work(batches):
        n, c = 0, np.zeros((bands, bands))
        for b in batches:
            x = b.column("s").flatten().to_numpy(zero_copy_only=False).reshape(-1, bands) - mean
            n += len(x)
            c += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([n], pa.int64()), pa.array([c.reshape(-1).tolist()], pa.list_(pa.float64()))], names=["k", "n", "c"])

    parts = own.mapInArrow(work, "k int, n long, c array<double>")
    total = parts.select("n", F.posexplode("c").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()  # bands x bands numbers
    cov = np.zeros(bands * bands)
    for r in total:
        cov[r.i] = r.v
    return first.n, mean, cov.reshape(bands, bands) / max(first.n - 1, 1)


def components(cov: np.ndarray, variance: float = 0.99, most: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Eigenvalues falling (none below 0), vectors as columns, and how many reach the share of variance."""
    values, vectors = np.linalg.eigh(cov)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    share = np.cumsum(values) / max(values.sum(), 1e-300)
    k = int(np.searchsorted(share, variance)) + 1
    return values, vectors, min(k, most or len(values), len(values))


def scores(df: DataFrame, spectrum: str, mean: np.ndarray, vectors: np.ndarray, k: int, nodata: float | None = None) -> DataFrame:
    """(x - mean) W as an array column ``scores``; rows without data become zeros."""
    w = F.array(*[F.array(*[F.lit(float(v)) for v in vectors[:, j]]) for j in range(k)])
    s = F.col(spectrum).cast("array<double>")
    centred = F.zip_with(s, F.array(*[F.lit(float(m)) for m in mean]), lambda a, b: a - b)
    out = F.transform(w, lambda row: F.aggregate(F.zip_with(row, centred, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x))
    if nodata is not None:
        out = F.when(F.exists(s, lambda x: x != nodata), out).otherwise(F.array_repeat(F.lit(0.0), k))
    return df.withColumn("scores", out)


def band_importance(values: np.ndarray, vectors: np.ndarray, k: int) -> list[tuple[int, float]]:
    """(band, share) by importance: the eigenvalue-weighted squares of a band's loadings."""
    imp = (vectors[:, :k] ** 2 * values[:k]).sum(1)
    imp = imp / max(imp.sum(), 1e-300)
    order = sorted(range(len(imp)), key=lambda b: (-round(float(imp[b]), 12), -b))
    return [(b, float(imp[b])) for b in order]
