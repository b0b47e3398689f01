"""Iterative solvers: scan-line time by Newton, ray casting through air. Loops run over whole Arrow batches in numpy.

A trajectory is sent to the tasks as sorted arrays; it has a record per 5 ms of flight, so
a flight is some tens of megabytes. ``MAX_RECORDS`` is checked before it is broadcast. Beyond
it, or for many flights, ``scanline_times_by_flight`` brings each flight's records and points
together by key instead, points dealt to as many tasks as wanted.

Camera axes: x across, y along (backward), z down, as ``MOUNT`` makes them of the body's
forward, right, down.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.camera import PolynomialCamera, TableCamera
from .scale import numbered

MAX_RECORDS = 5_000_000
#: Body (forward, right, down) to camera (right, back, down).
MOUNT = np.array([[0.0, 1.0, 0.0], [-1.0, 0.0, 0.0], [0.0, 0.0, 1.0]])
ANCHORS = 5_000
A, F_INV = 6378137.0, 298.257223563
E2 = (2 - 1 / F_INV) / F_INV


def ecef(lat, lon, h):
    n = A / np.sqrt(1 - E2 * np.sin(lat) ** 2)
    return np.stack([(n + h) * np.cos(lat) * np.cos(lon), (n + h) * np.cos(lat) * np.sin(lon), (n * (1 - E2) + h) * np.sin(lat)], -1)


def ned_to_ecef(lat, lon):
    sl, cl, so, co = np.sin(lat), np.cos(lat), np.sin(lon), np.cos(lon)
    o = np.zeros_like(sl)
    return np.stack([np.stack([-sl * co, -so, -cl * co], -1), np.stack([-sl * so, co, -cl * so], -1), np.stack([cl, o, -sl], -1)], -2)


def body_to_ned(r, p, y):
    cr, sr, cp, sp, cy, sy = np.cos(r), np.sin(r), np.cos(p), np.sin(p), np.cos(y), np.sin(y)
    return np.stack([np.stack([cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr], -1), np.stack([sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr], -1), np.stack([-sp, cp * sr, cp * cr], -1)], -2)


def to_quaternion(m):
    """Largest pivot of each matrix; scalar first."""
    t = m[..., 0, 0] + m[..., 1, 1] + m[..., 2, 2]
    d = np.stack([t, m[..., 0, 0], m[..., 1, 1], m[..., 2, 2]], -1)
    k = d.argmax(-1)
    pick = np.stack([1 + t, 1 + 2 * m[..., 0, 0] - t, 1 + 2 * m[..., 1, 1] - t, 1 + 2 * m[..., 2, 2] - t], -1)
    s = 2 * np.sqrt(np.take_along_axis(pick, k[..., None], -1)[..., 0])
    a, b, c = m[..., 2, 1] - m[..., 1, 2], m[..., 0, 2] - m[..., 2, 0], m[..., 1, 0] - m[..., 0, 1]
    e, f, g = m[..., 0, 1] + m[..., 1, 0], m[..., 0, 2] + m[..., 2, 0], m[..., 1, 2] + m[..., 2, 1]
    q = s * s / 4
    rows = np.stack([np.stack([q, a, b, c], -1), np.stack([a, q, e, f], -1), np.stack([b, e, q, g], -1), np.stack([c, f, g, q], -1)], -2)
    return np.take_along_axis(rows, k[..., None, None], -2)[..., 0, :] / s[..., None]


def to_matrix(q):
    w, x, y, z = np.moveaxis(q, -1, 0)
    return np.stack([np.stack([1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], -1), np.stack([2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], -1), np.stack([2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)], -1)], -2)


@dataclass
class Trajectory:
    """Sorted epochs with positions and continuous quaternions (body to ECEF)."""

    t: np.ndarray
    pos: np.ndarray
    q: np.ndarray

    @classmethod
    def of(cls, t, lat, lon, h, roll, pitch, yaw, lever=(0.0, 0.0, 0.0), convention: str = "zyx"):
        """convention='zyx': Rz Ry Rx takes north-east-down to the body, as the sensor pipeline has it; 'ned2body': its transpose does."""
        order = np.argsort(t, kind="stable")
        t, lat, lon, h, roll, pitch, yaw = (np.asarray(x, float)[order] for x in (t, lat, lon, h, roll, pitch, yaw))
        turn = body_to_ned(roll, pitch, yaw)
        r = ned_to_ecef(lat, lon) @ (turn.transpose(0, 2, 1) if convention == "zyx" else turn)
        q = to_quaternion(r)
        flips = np.concatenate([[0], np.cumsum((q[1:] * q[:-1]).sum(1) < 0)])
        return cls(t, ecef(lat, lon, h) + r @ np.array(lever, float), q * np.where(flips % 2, -1.0, 1.0)[:, None])

    @classmethod
    def collect(cls, nav: DataFrame, lever=(0.0, 0.0, 0.0), convention: str = "zyx"):
        """From a frame of time, latitude, longitude, altitude, roll, pitch, heading (radians)."""
        cols = ["time", "latitude", "longitude", "altitude", "roll", "pitch", "heading"]
        rows = nav.select(*cols).limit(MAX_RECORDS + 1).toPandas()
        if len(rows) > MAX_RECORDS:
            raise ValueError(f"more than {MAX_RECORDS} records: use scanline_times_by_flight")
        return cls.of(*[rows[c].to_numpy() for c in cols], lever=lever, convention=convention)

    def at(self, t):
        """Position and rotation, clamped to the ends; linear and spherical."""
        i = np.clip(np.searchsorted(self.t, t, "right") - 1, 0, len(self.t) - 2)
        k = np.clip((t - self.t[i]) / (self.t[i + 1] - self.t[i]), 0, 1)
        pos = self.pos[i] + (self.pos[i + 1] - self.pos[i]) * k[:, None]
        a, b = self.q[i], self.q[i + 1]
        d = (a * b).sum(1)
        b = b * np.where(d < 0, -1.0, 1.0)[:, None]
        d = np.minimum(np.abs(d), 1)
        th = np.arccos(d)
        s = np.sin(th)
        near = d > 0.9995
        safe = np.where(near, 1, s)
        wa, wb = np.where(near, 1 - k, np.sin((1 - k) * th) / safe), np.where(near, k, np.sin(k * th) / safe)
        q = a * wa[:, None] + b * wb[:, None]
        return pos, to_matrix(q / np.linalg.norm(q, axis=1, keepdims=True))

    def nearest_time(self, points, anchors: int = ANCHORS):
        """Time of the nearest of every n-th epoch, n so that about ``anchors`` remain; first on ties."""
        step = max(1, len(self.t) // anchors)
        pos, out = self.pos[::step], np.empty(len(points))
        for at in range(0, len(points), 5000):
            p = points[at : at + 5000]
            d = ((p[:, None, :] - pos[None, :, :]) ** 2).sum(2)
            out[at : at + 5000] = self.t[::step][d.argmin(1)]
        return out


def newton(residual, t, low: float, high: float, variant: str = "central", step: float = 1e-6, tol: float = 1e-9, most: int = 15):
    """Times and convergence of all points. central: two-sided derivative, a point is settled once its step is below ``tol``.

    forward: one-sided derivative, steps of at most 0.5 s, done when all residuals are below ``tol``.
    """
    t = np.clip(t, low, high)
    done = np.zeros(len(t), bool)
    for _ in range(most):
        f = residual(t)
        d = (residual(t + step) - residual(t - step)) / (2 * step) if variant == "central" else (residual(t + step) - f) / step
        d = np.where(np.abs(d) < 1e-20, 1e-20, d)
        move = f / d
        if variant == "forward":
            move = np.clip(move, -0.5, 0.5)
        new = np.clip(t - move, low, high)
        t = np.where(done, t, new) if variant == "central" else new
        done |= (np.abs(move) < tol) if variant == "central" else (np.abs(f) < tol)
        if done.all():
            break
    if variant == "forward":
        done = np.abs(residual(t)) < 10 * tol
    return t, done


class Optics:
    """A camera's pixel, residual and view over arrays of points in camera coordinates (n, 3)."""

    def __init__(self, camera: TableCamera | PolynomialCamera):
        self.c = camera
        if isinstance(camera, TableCamera):
            self.table, self.index = np.array(camera.table, float), np.arange(len(camera.table), dtype=float)
        else:
            self.across, self.along = (np.polynomial.Polynomial(p) for p in (camera.across, camera.along))

    def _angle(self, v):
        return np.degrees(np.arctan((v[:, 0] / v[:, 2] + self.c.shift[0]) / self.c.scale))

    def pixel(self, v):
        if isinstance(self.c, TableCamera):
            return np.interp(self._angle(v), self.table, self.index)
        c, ideal = self.c, self.c.f * v[:, 0] / v[:, 2] + self.c.centre
        u, slope = ideal, self.across.deriv()
        for _ in range(8):
            xi = (u - c.width / 2) / c.width
            u = u - (u + self.across(xi) - ideal) / (1 + slope(xi) / c.width)
        return u

    def residual(self, v):
        y = v[:, 1] / v[:, 2]
        if isinstance(self.c, TableCamera):
            theta = np.clip(self._angle(v), self.table[0], self.table[-1])
            smile = -np.tan(np.radians(np.polynomial.polynomial.polyval(theta, self.c.smile)))
            return y - (self.c.scale * smile - self.c.shift[1])
        return y - self.along((self.pixel(v) - self.c.width / 2) / self.c.width) / self.c.f

    def in_view(self, v):
        if isinstance(self.c, TableCamera):
            angle = self._angle(v)
            return (angle >= self.table[0]) & (angle <= self.table[-1])
        low, high = self.c.edges()
        x = v[:, 0] / v[:, 2]
        return (x >= low) & (x <= high)


def solve_points(p: np.ndarray, trajectory: Trajectory, body_to_camera: np.ndarray, lines: np.ndarray, optics: Optics, variant: str = "central") -> tuple[np.ndarray, ...]:
    """time, u, sample, line, valid, and the sensor's position, of ground points (n, 3)."""

    def camera(t):
        pos, rot = trajectory.at(t)
        return np.einsum("ij,nkj,nk->ni", body_to_camera, rot, p - pos)

    t, ok = newton(lambda t: optics.residual(camera(t)), trajectory.nearest_time(p), trajectory.t[0], trajectory.t[-1], variant)
    v = camera(t)
    inside = (t >= lines[0]) & (t <= lines[-1]) & optics.in_view(v)
    u = optics.pixel(v)
    return t, u, u + optics.c.first, np.interp(t, lines, np.arange(len(lines))), ok & inside & (v[:, 2] > 0), trajectory.at(t)[0]


_TIMES = "time double, u double, sample double, line double, valid boolean, sx double, sy double, sz double"


def _as_camera(camera) -> TableCamera | PolynomialCamera:
    return camera if isinstance(camera, (TableCamera, PolynomialCamera)) else TableCamera(tuple(map(float, camera)))


def scanline_times(points: DataFrame, trajectory: Trajectory, body_to_camera, line_times, camera, point_id: str = "point_id", variant: str = "central") -> DataFrame:
    """point_id, time, u (pixel), sample (of the image), line, valid, and the sensor's position sx, sy, sz, for ground points x, y, z (ECEF).

    ``camera`` is a TableCamera, a PolynomialCamera or a plain table of angles. Valid: converged, the
    time (not a clamped one) within the exposures, the angle itself in the field of view, and in
    front of the camera.
    """
    sent = points.sparkSession.sparkContext.broadcast((trajectory, np.asarray(body_to_camera, float), np.asarray(line_times, float), _as_camera(camera)))
    kind = points.schema[point_id].dataType.simpleString()

    def work(batches):
        tr, mount, lines, own = sent.value
        optics = Optics(own)
        for b in batches:
            if not b.num_rows:
                continue
            p = np.stack([b.column(c).to_numpy() for c in "xyz"], 1)
            *found, at = solve_points(p, tr, mount, lines, optics, variant)
            yield pa.RecordBatch.from_arrays([b.column(point_id), *[pa.array(x) for x in found], *[pa.array(at[:, k]) for k in range(3)]], names=[point_id, *[f.split()[0] for f in _TIMES.split(", ")]])

    return points.select(point_id, "x", "y", "z").mapInArrow(work, f"{point_id} {kind}, {_TIMES}")


def scanline_times_by_flight(points: DataFrame, nav: DataFrame, line_times: DataFrame, flight: str, body_to_camera, camera, point_id: str = "point_id", lever=(0.0, 0.0, 0.0), convention: str = "zyx", parts: int = 8) -> DataFrame:
    """The same for many flights, or long ones: navigation records (time, latitude, longitude, altitude, roll, pitch, heading in radians), exposures (time) and points of a flight meet by its key.

    Points are dealt to ``parts`` groups of each flight, to each of which its records and exposures
    go; a group holds a flight's records and a part of its points.
    """
    kind, key = points.schema[point_id].dataType.simpleString(), points.schema[flight].dataType.simpleString()
    mount, own = np.asarray(body_to_camera, float), _as_camera(camera)
    columns = ["time", "latitude", "longitude", "altitude", "roll", "pitch", "heading"]
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    records = nav.select(flight, *columns, F.lit(False).alias("exposure"), every).unionByName(line_times.select(flight, "time", F.lit(True).alias("exposure"), every), allowMissingColumns=True)
    dealt = points.select(flight, point_id, "x", "y", "z", F.pmod(F.xxhash64(point_id), F.lit(parts)).cast("int").alias("part"))
    names = [f.split()[0] for f in _TIMES.split(", ")]

    def work(pts, recs):
        lines = np.sort(recs.loc[recs.exposure, "time"].to_numpy())
        nav_ = recs[~recs.exposure]
        if not len(pts) or len(nav_) < 2 or not len(lines):
            return pd.DataFrame(columns=[flight, point_id, *names])
        tr = Trajectory.of(*[nav_[c].to_numpy() for c in columns], lever=lever, convention=convention)
        *found, at = solve_points(pts[["x", "y", "z"]].to_numpy(float), tr, mount, lines, Optics(own))
        return pd.DataFrame({flight: pts[flight].to_numpy(), point_id: pts[point_id].to_numpy()} | dict(zip(names, [*found, *at.T], strict=True)))

    return dealt.groupBy(flight, "part").cogroup(records.groupBy(flight, "part")).applyInPandas(work, f"{flight} {key}, {point_id} {kind}, {_TIMES}")


def nearest_epochs(points: DataFrame, epochs: DataFrame, axes: list[str], time: str, most: int = ANCHORS, every: int | None = None, inset: float | None = None) -> DataFrame:
    """The points with ``near_time``: the time of the nearest of every n-th epoch in as many dimensions as there are axes; the earlier one on ties.

    n is the number of epochs over ``most`` (so fewer than twice ``most`` remain), or ``every``. The
    remaining epochs travel as one array of a known size. ``inset`` keeps times that far within the
    series' ends.
    """
    own = numbered(epochs.select(time, *axes), [time, *axes], "__n")
    n, low, high = own.agg(F.count("*"), F.min(time), F.max(time)).first()
    step = every or max(1, n // most)
    few = own.where((F.col("__n") - 1) % step == 0).agg(F.sort_array(F.collect_list(F.struct(F.col("__n").alias("n"), F.col(time).cast("double").alias("t"), *[F.col(a).cast("double").alias(f"a{k}") for k, a in enumerate(axes)]))).alias("__near"))  # one row of fewer than 2 x most epochs, or of n / every

    def gap(e):
        d = None
        for k, a in enumerate(axes):
            one = (F.col(a) - e[f"a{k}"]) * (F.col(a) - e[f"a{k}"])
            d = one if d is None else d + one
        return F.struct(d.alias("d"), e["n"].alias("n"), e["t"].alias("t"))

    near = F.array_min(F.transform("__near", gap))["t"]
    if inset is not None and n:
        near = F.least(F.greatest(near, F.lit(float(low) + inset)), F.lit(float(high) - inset))
    return points.join(F.broadcast(few)).withColumn("near_time", near).drop("__near")


def cubic_spline(xs: np.ndarray, ys: np.ndarray):
    """Not-a-knot cubic through four or more sorted knots; a function of new places (ends extrapolate).

    The end conditions are put into the first and the last equation, so the system is tridiagonal
    and solved in one pass down and one up.
    """
    n, h = len(xs), np.diff(xs)
    if n < 4:
        raise ValueError("a not-a-knot spline needs four knots")
    e = lambda v: np.reshape(v, (-1, *[1] * (ys.ndim - 1)))
    slope = np.diff(ys, axis=0) / e(h)
    r = 6 * np.diff(slope, axis=0)  # of the inner knots 1 .. n - 2
    low, mid, up = h[:-1].astype(float).copy(), 2 * (h[:-1] + h[1:]).astype(float), h[1:].astype(float).copy()
    # m[0] = (1 + a) m[1] - a m[2] with a = h[0] / h[1], and alike at the end.
    a, z = h[0] / h[1], h[-1] / h[-2]
    mid[0], up[0] = mid[0] + low[0] * (1 + a), up[0] - low[0] * a
    mid[-1], low[-1] = mid[-1] + up[-1] * (1 + z), low[-1] - up[-1] * z
    for i in range(1, n - 2):
        k = low[i] / mid[i - 1]
        mid[i] -= k * up[i - 1]
        r[i] = r[i] - k * r[i - 1]
    m = np.empty((n, *ys.shape[1:]))
    m[n - 2] = r[-1] / mid[-1]
    for i in range(n - 4, -1, -1):
        m[i + 1] = (r[i] - up[i] * m[i + 2]) / mid[i]
    m[0], m[-1] = (1 + a) * m[1] - a * m[2], (1 + z) * m[-2] - z * m[-3]

    def at(x):
        i = np.clip(np.searchsorted(xs, x, "right") - 1, 0, n - 2)
        d, k = e(x - xs[i]), e(h[i])
        return ys[i] + d * (slope[i] - k * (2 * m[i] + m[i + 1]) / 6) + d**2 * m[i] / 2 + d**3 * (m[i + 1] - m[i]) / (6 * k)

    return at


def spline_positions(points: DataFrame, epochs: DataFrame, time: str, values: list[str], most: int = MAX_RECORDS) -> DataFrame:
    """The points with s_<name>: values of a series at their times by a not-a-knot cubic spline, extrapolated beyond its ends. The series is solved once and sent to the tasks; its length is checked."""
    rows = epochs.select(time, *values).dropna().dropDuplicates([time]).limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"more than {most} epochs; cut the series")
    rows = rows.sort_values(time)
    sent = points.sparkSession.sparkContext.broadcast((rows[time].to_numpy(float), rows[values].to_numpy(float)))
    names = [f"s_{v}" for v in values]
    schema = StructType([*points.schema.fields, *[StructField(n, DoubleType()) for n in names]])

    def work(batches):
        at = cubic_spline(*sent.value)
        for b in batches:
            t = b.column(time).to_numpy(zero_copy_only=False).astype(float)
            y = at(np.nan_to_num(t)) if len(t) else np.zeros((0, len(names)))
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(y[:, k], mask=np.isnan(t)) for k in range(len(names))]], names=[*b.schema.names, *names])

    return points.mapInArrow(work, schema)


def refraction_range(angle: np.ndarray, seconds: np.ndarray, altitude: float, steps: int = 100):
    """Horizontal and vertical way of a light pulse through air whose index falls with altitude, by small steps of time."""
    x, z = np.zeros_like(angle), np.full_like(angle, altitude)
    index = lambda z: 1.0003 - 0.0000205 * z / 1000
    k = index(z) * np.sin(angle)
    for _ in range(steps):
        n = index(z)
        s = np.clip(k / n, -1, 1)
        way = 299_792_458.0 / n * seconds / steps
        x, z = x + way * s, z - way * np.sqrt(1 - s * s)
    return x, altitude - z


def index_steps(residual_lines, start: np.ndarray, lines: int, damping: float = 0.8, most: float = 500, rounds: int = 20, still: float = 0.1) -> np.ndarray:
    """Line index by damped steps of at most ``most`` lines; not a number where it leaves the image by more than half a line.

    ``residual_lines`` gives the step for whole line numbers within the image; the index itself may leave it.
    """
    i = start.astype(float)
    for _ in range(rounds):
        step = np.clip(residual_lines(np.clip(np.rint(i), 0, lines - 1).astype(np.int64)), -most, most)
        i = i - damping * step
        if np.abs(step).max(initial=0) < still:
            break
    return np.where((i < -0.5) | (i > lines - 0.5), np.nan, i)


def scanline_indices(points: DataFrame, trajectory: Trajectory, body_to_camera, line_times, focal: float, centre: float, samples: int, every: int = 50, point_id: str = "point_id") -> DataFrame:
    """point_id, line, sample by index stepping: from the nearest of every n-th line, along-track misses over the mean speed give the next line. Null where line or sample leave the image."""
    sent = points.sparkSession.sparkContext.broadcast((trajectory, np.asarray(body_to_camera, float), np.asarray(line_times, float)))
    kind = points.schema[point_id].dataType.simpleString()

    def work(batches):
        tr, mount, times = sent.value
        pos, rot = tr.at(times)
        dt = (times[-1] - times[0]) / len(times)
        speed = np.mean(np.linalg.norm(np.diff(pos, axis=0), axis=1) / np.diff(times))
        for b in batches:
            if not b.num_rows:
                continue
            p = np.stack([b.column(c).to_numpy() for c in "xyz"], 1)
            view = lambda k, p=p: np.einsum("ij,nkj,nk->ni", mount, rot[k], p - pos[k])
            first = np.array([((pos[::every] - q) ** 2).sum(1).argmin() for q in p]) * every
            line = index_steps(lambda k: view(k)[:, 1] / speed / dt, first, len(times))
            v = view(np.clip(np.rint(np.nan_to_num(line)), 0, len(times) - 1).astype(np.int64))
            sample = focal * v[:, 0] / v[:, 2] + centre
            ok = ~np.isnan(line) & (sample >= -0.5) & (sample <= samples - 0.5)
            yield pa.RecordBatch.from_arrays([b.column(point_id), *[pa.array(x, mask=~ok) for x in (line, sample)]], names=[point_id, "line", "sample"])

    return points.select(point_id, "x", "y", "z").mapInArrow(work, f"{point_id} {kind}, line double, sample double")


def reproject_heights(points: DataFrame, swiss_geoid=None) -> DataFrame:
    """Heights over the ellipsoid from heights over the geoid (h column) of Swiss grid points e, n."""
    from ..functions.geodesy import swiss_geoid as plane

    g = (swiss_geoid or plane)(F.col("e"), F.col("n"))
    return points.withColumn("h_ellipsoid", F.col("h") + g)
