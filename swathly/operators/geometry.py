"""Joint geometry of many observations: validation, triangulation, boresight adjustment, tie points."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import solve3


def validate(observations: DataFrame, points: DataFrame, poses: DataFrame, point: str, image: str) -> DataFrame:
    """Observations with their point and pose, and why one cannot be used: a missing point comes before a missing pose."""
    p = points.select(F.col(point), F.struct(*[c for c in points.columns if c != point]).alias("point"))
    q = poses.select(F.col(image), F.struct(*[c for c in poses.columns if c != image]).alias("pose"))
    both = observations.join(p, point, "left").join(q, image, "left")
    reason = F.when(F.col("point").isNull(), "no point").when(F.col("pose").isNull(), "no pose")
    return both.withColumn("reason", reason).withColumn("valid", reason.isNull())


def validate_control(observations: DataFrame, points: DataFrame, poses: DataFrame, camera: dict, boresight=(0.0, 0.0, 0.0), lever=(0.0, 0.0, 0.0), convention: str = "zyx") -> DataFrame:
    """Each observation (gcp_id, gcp_name, image_id, u, v) of a control point (gcp_id, x, y, z Earth-centred) against its projection by the pose of its image (image_id, latitude, longitude, height, roll, pitch, yaw in degrees).

    camera: fx, fy, cx, cy and, if wanted, distortion, width, height. Adds xc, yc, zc (the point in
    camera coordinates), distance, projected_u, projected_v, error, valid and reason: 'no point',
    then 'no pose', 'behind camera' or 'outside image'. What cannot be projected has null here;
    ``with_sentinels`` writes it as the zeros and infinities of the report.
    """
    from ..functions import camera as cam
    from ..functions import core, geodesy, rotation

    v = validate(observations, points, poses, "gcp_id", "image_id")
    get = lambda s, *names: [F.col(f"{s}.{n}").cast("double") for n in names]
    lat, lon, h, *angles = get("pose", "latitude", "longitude", "height", "roll", "pitch", "yaw")
    # From the inertial unit to the point.
    away = core.sub(get("point", "x", "y", "z"), geodesy.geodetic_to_ecef(lat, lon, h, degrees=True))
    v = core.staged(v, dict(zip(("__x", "__y", "__z"), away, strict=True)))
    v = core.staged(v, dict(zip(("__n", "__e", "__d"), core.matvec(geodesy.ecef_to_ned(F.radians(lat), F.radians(lon)), core.vec("__x", "__y", "__z")), strict=True)))
    turn = rotation.rpy_matrix(*[F.radians(a) for a in angles])
    body = core.matvec(turn if convention == "zyx" else core.transpose(turn), core.vec("__n", "__e", "__d"))
    # The lever arm is taken away in body axes, the boresight is a matrix of numbers.
    v = core.staged(v, {n: x - float(y) for n, x, y in zip(("__x1", "__y1", "__z1"), body, lever, strict=True)})
    x, y, z = (sum((float(k) * F.col(c) for k, c in zip(row[1:], ("__y1", "__z1"), strict=True)), float(row[0]) * F.col("__x1")) for row in zyx_matrix(*np.radians(boresight)))
    v = core.staged(v, {"xc": y, "yc": -x, "zc": z})  # right, back, down of forward, right, down
    c = [F.col(k) for k in ("xc", "yc", "zc")]
    seen = cam.project(c, camera["fx"], camera["fy"], camera["cx"], camera["cy"], camera.get("distortion", cam.NONE))
    v = core.staged(v, {"distance": core.norm(c), "projected_u": seen["u"], "projected_v": seen["v"]})
    sized = camera.get("width", 0) > 0 and camera.get("height", 0) > 0
    inside = cam.in_image("projected_u", "projected_v", camera["width"], camera["height"]) if sized else F.lit(True)
    v = core.staged(v.withColumnRenamed("reason", "__r").drop("valid"), {"reason": F.coalesce(F.col("__r"), F.when(F.coalesce(F.col("zc") <= 0, F.lit(True)), "behind camera").when(~inside, "outside image"))})
    v = v.withColumn("valid", F.col("reason").isNull()).drop(*[n for n in v.columns if n.startswith("__")])
    error = F.when(F.col("valid"), cam.reprojection_error("u", "v", "projected_u", "projected_v"))
    return v.withColumn("error", error).drop("point", "pose")


def with_sentinels(results: DataFrame) -> DataFrame:
    """Projections that are missing as 0, errors that are as infinity."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return results.withColumns({"projected_u": zero("projected_u"), "projected_v": zero("projected_v"), "error": F.coalesce(F.col("error"), F.lit(float("inf")))})


def control_report(results: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The statistics of all valid observations (one row), of each control point and of each image."""
    from .stats import error_by_groups, error_stats

    total = error_stats(results, "error", F.col("valid"), (threshold,), threshold)
    both = error_by_groups(results, "error", F.col("valid"), ("gcp_id", "image_id"))
    return total, both.where("gcp_id is not null").drop("image_id"), both.where("image_id is not null").drop("gcp_id")


def completeness(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of a that b lacks."""
    return a.select(key).distinct().join(b.select(key), key, "left_anti")


def split_members(df: DataFrame, members: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    return df.join(members.select(key), key, "left_semi"), df.join(members.select(key), key, "left_anti")


def seen_twice(df: DataFrame, key: str) -> DataFrame:
    """Rows of keys that occur more than once: a grouped count and a semi-join."""
    many = df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    return df.join(many, key, "left_semi")


def triangulate(rays: DataFrame, key: str, origin: tuple[str, str, str], direction: tuple[str, str, str], min_views: int = 2) -> DataFrame:
    """key, views, x, y, z: the point nearest to all rays of a key. Nine sums per key, then Cramer; null where the rays are parallel."""
    d = [F.col(c) for c in direction]
    c = [F.col(o) for o in origin]
    n2 = sum((x * x for x in d[1:]), d[0] * d[0])
    m = lambda i, j: (F.lit(1.0) if i == j else F.lit(0.0)) - d[i] * d[j] / n2
    sums = [F.sum(m(i, j)).alias(f"a{i}{j}") for i in range(3) for j in range(i, 3)]
    sums += [F.sum(sum((m(i, j) * c[j] for j in range(1, 3)), m(i, 0) * c[0])).alias(f"b{i}") for i in range(3)]
    s = rays.groupBy(key).agg(F.count("*").alias("views"), *sums).where(F.col("views") >= min_views)
    a = [[F.col(f"a{min(i, j)}{max(i, j)}") for j in range(3)] for i in range(3)]
    x = solve3(a, [F.col(f"b{i}") for i in range(3)], 1e-9)
    return s.select(key, "views", *[v.alias(k) for v, k in zip(x, "xyz", strict=True)])


def triangulation_report(points: DataFrame, rays: DataFrame, control: DataFrame, key: str, origin, direction, focal: float) -> DataFrame:
    """key, views, rmse_px (angular miss times focal length), error_3d (-1 where unknown)."""
    both = rays.join(points, key)
    v = [F.col(k) - F.col(o) for k, o in zip("xyz", origin, strict=True)]
    d = [F.col(c) for c in direction]
    dot = v[0] * d[0] + v[1] * d[1] + v[2] * d[2]
    v2, d2 = v[0] * v[0] + v[1] * v[1] + v[2] * v[2], d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
    tan2 = (v2 * d2 - dot * dot) / (dot * dot)
    r = both.groupBy(key).agg(F.first("views").alias("views"), *[F.first(k).alias(k) for k in "xyz"], (focal * F.sqrt(F.avg(F.greatest(tan2, F.lit(0.0))))).alias("rmse_px"))
    g = control.select(key, *[F.col(k).alias(f"g{k}") for k in "xyz"])
    e = F.sqrt(sum(((F.col(k) - F.col(f"g{k}")) ** 2 for k in "yz"), (F.col("x") - F.col("gx")) ** 2))
    return r.join(g, key, "left").select(key, "views", "rmse_px", F.coalesce(e, F.lit(-1.0)).alias("error_3d"))


def mutual_nearest(a: DataFrame, b: DataFrame, distance: Column, pair_key: str) -> DataFrame:
    """pair_key, id_a, id_b, confidence of descriptors that are each other's nearest within a tile pair.

    a: pair_key, id_a, da; b: pair_key, id_b, db. A matcher compares the descriptors of a tile pair,
    whose numbers the tiling bounds; both nearest searches are grouped minima. Whole images are
    tiled first (``raster.overlapping_tiles``), there is no search without a key.
    """
    d = a.join(b, pair_key).withColumn("d", distance)
    na = d.groupBy(pair_key, "id_a").agg(F.min(F.struct("d", "id_b")).alias("m")).select(pair_key, "id_a", F.col("m.id_b").alias("id_b"), F.col("m.d").alias("d"))
    nb = d.groupBy(pair_key, "id_b").agg(F.min(F.struct("d", "id_a")).alias("m")).select(pair_key, "id_b", F.col("m.id_a").alias("id_a"))
    return na.join(nb, [pair_key, "id_a", "id_b"]).select(pair_key, "id_a", "id_b", (1 / (F.col("d") + 1e-8)).alias("confidence"))


def match_tiles(tiles_a: DataFrame, tiles_b: DataFrame, matcher, schema: str) -> DataFrame:
    """Matcher plug-in over tile pairs: a function of two rows' pandas frames; a failing tile fails the job."""
    both = tiles_a.join(tiles_b, ["tile_x", "tile_y"])
    return both.groupBy("tile_x", "tile_y").applyInPandas(matcher, schema)


def homography(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The plane projection that takes points p to q (n, 2), n of 4 or more, by least squares on normalised coordinates."""

    def normal(x):
        m, d = x.mean(0), max(np.sqrt(((x - x.mean(0)) ** 2).sum(1).mean() / 2), 1e-12)
        return np.array([[1 / d, 0, -m[0] / d], [0, 1 / d, -m[1] / d], [0, 0, 1]])

    tp, tq = normal(p), normal(q)
    one = np.ones((len(p), 1))
    a, b = np.hstack([p, one]) @ tp.T, np.hstack([q, one]) @ tq.T
    z = np.zeros_like(a)
    rows = np.concatenate([np.hstack([a, z, -b[:, :1] * a]), np.hstack([z, a, -b[:, 1:2] * a])])
    h = np.linalg.inv(tq) @ np.linalg.svd(rows)[2][-1].reshape(3, 3) @ tp
    return h / (h[2, 2] if abs(h[2, 2]) > 1e-12 else 1.0)


def transfer_errors(h: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    x = np.hstack([p, np.ones((len(p), 1))]) @ h.T
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nan_to_num(np.linalg.norm(q - x[:, :2] / x[:, 2:], axis=1), nan=np.inf)


def robust_homography(p: np.ndarray, q: np.ndarray, limit: float = 5.0, tries: int = 500, seed: int = 42) -> tuple[np.ndarray, np.ndarray] | None:
    """The projection that most matches agree with within ``limit`` pixels, fitted to them, and which they are; None if no four agree. Seeded, so the same on every run."""
    rng, best = np.random.default_rng(seed), np.zeros(len(p), bool)
    for _ in range(tries):
        pick = rng.choice(len(p), 4, replace=False)
        near = transfer_errors(homography(p[pick], q[pick]), p, q) <= limit
        if near.sum() > best.sum():
            best = near
            if best.all():
                break
    if best.sum() < 4:
        return None
    h = homography(p[best], q[best])
    return h, transfer_errors(h, p, q) <= limit


def fit_matches(matches: DataFrame, keys: list[str], limit: float = 5.0) -> DataFrame:
    """keys, matches, mean_confidence, inlier_ratio, mean_error of each image (or tile) pair's matches x1, y1, x2, y2, confidence.

    The error is the mean over all matches, not the agreeing ones alone; 0 and -1 for fewer than four
    matches or without a projection. A pair's matches meet in one task, which a matcher bounds.
    """
    import pandas as pd

    kinds = ", ".join(f"{k} {matches.schema[k].dataType.simpleString()}" for k in keys)

    def work(name, m):
        p, q = m[["x1", "y1"]].to_numpy(float), m[["x2", "y2"]].to_numpy(float)
        found = robust_homography(p, q, limit) if len(m) >= 4 else None
        ratio, error = (0.0, -1.0) if found is None else (float(found[1].mean()), float(transfer_errors(found[0], p, q).mean()))
        return pd.DataFrame([[*name, len(m), float(m.confidence.mean()), ratio, error]], columns=[*keys, "matches", "mean_confidence", "inlier_ratio", "mean_error"])

    return matches.groupBy(*keys).applyInPandas(work, f"{kinds}, matches long, mean_confidence double, inlier_ratio double, mean_error double")


def match_metrics(matches: DataFrame, inlier: str, error: str, confidence: str) -> DataFrame:
    """Count, mean confidence, inlier ratio and mean error over all of matches that are judged already; fewer than four give 0 and -1."""
    s = matches.agg(F.count("*").alias("matches"), F.coalesce(F.avg(confidence), F.lit(0.0)).alias("mean_confidence"), F.avg(F.col(inlier).cast("double")).alias("r"), F.avg(error).alias("e"))
    few = F.col("matches") < 4
    return s.select("matches", "mean_confidence", F.when(few, 0.0).otherwise(F.col("r")).alias("inlier_ratio"), F.when(few, -1.0).otherwise(F.coalesce("e", F.lit(-1.0))).alias("mean_error"))


# -- boresight ---------------------------------------------------------------------


def zyx_matrix(roll: float, pitch: float, yaw: float) -> np.ndarray:
    """Rz Ry Rx of three numbers."""
    from .solve import body_to_ned

    return body_to_ned(*(np.array(float(a)) for a in (roll, pitch, yaw)))


def _r123(a: np.ndarray):
    (cx, cy, cz), (sx, sy, sz) = np.cos(a), np.sin(a)
    x = np.array([[1, 0, 0], [0, cx, -sx], [0, sx, cx]])
    y = np.array([[cy, 0, sy], [0, 1, 0], [-sy, 0, cy]])
    z = np.array([[cz, -sz, 0], [sz, cz, 0], [0, 0, 1]])
    dx = np.array([[0, 0, 0], [0, -sx, -cx], [0, cx, -sx]])
    dy = np.array([[-sy, 0, cy], [0, 0, 0], [-cy, 0, -sy]])
    dz = np.array([[-sz, -cz, 0], [cz, -sz, 0], [0, 0, 0]])
    return x @ y @ z, [dx @ y @ z, x @ dy @ z, x @ y @ dz]


def boresight(pairs: DataFrame, start=(0.0, 0.0, 0.0), prior_sigma: float = 1.0, sigma: float = 1e-3, most: int = 20, tol: float = 1e-12):
    """Angles that bring scanner points seen twice together, by Gauss-Helmert adjustment.

    pairs: ri (9), rj (9) body-to-world rotations, pi (3), pj (3) positions, ui (3), uj (3) scanner
    vectors, as arrays. Each iteration is one job: every task adds up its 3 x 3 normal matrix
    and right side, the driver solves. Returns angles, their covariance and the variance factor.
    """
    x0 = np.array(start, float)
    x = x0.copy()
    w0 = np.eye(3) / prior_sigma**2

    def pass_(x):
        def work(batches):
            n, g, q, k = np.zeros((3, 3)), np.zeros(3), 0.0, 0
            r, dr = _r123(x)
            for b in batches:
                if not b.num_rows:
                    continue
                get = lambda c, b=b: b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                ri, rj = get("ri").reshape(-1, 3, 3), get("rj").reshape(-1, 3, 3)
                ui, uj = get("ui"), get("uj")
                miss = get("pi") + np.einsum("nij,nj->ni", ri @ r, ui) - get("pj") - np.einsum("nij,nj->ni", rj @ r, uj)
                a = np.stack([np.einsum("nij,nj->ni", ri @ d, ui) - np.einsum("nij,nj->ni", rj @ d, uj) for d in dr], -1)
                # Weights of the condition after the observations are eliminated: both scanner vectors with one sigma.
                s = np.linalg.inv(sigma**2 * ((ri @ r) @ (ri @ r).transpose(0, 2, 1) + (rj @ r) @ (rj @ r).transpose(0, 2, 1)))
                n += np.einsum("nki,nkl,nlj->ij", a, s, a)
                g += np.einsum("nki,nkl,nl->i", a, s, miss)
                q += np.einsum("nk,nkl,nl->", miss, s, miss)
                k += b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([[*n.reshape(-1), *g, q, float(k)]], pa.list_(pa.float64()))], names=["s"])

        rows = pairs.mapInArrow(work, "s array<double>").select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
        s = np.zeros(14)
        for r in rows:
            s[r.i] = r.v
        return s[:9].reshape(3, 3), s[9:12], s[12], int(s[13])

    for _ in range(most):
        n, g, _, _ = pass_(x)
        step = np.linalg.solve(n + w0, -(g + w0 @ (x - x0)))
        x = x + step
        if np.abs(step).max() < tol:
            break
    n, g, q, k = pass_(x)
    factor = (q + (x - x0) @ w0 @ (x - x0)) / max(3 * k - 3, 1)
    return x, factor * np.linalg.inv(n + w0), factor


def adjust_boresight(pairs: DataFrame, sigmas: dict[str, float], lever=(0.0, 0.0, 0.0), start=(0.0, 0.0, 0.0), most: int = 20, tol: float = 1e-12) -> dict:
    """Small boresight angles by Gauss-Helmert adjustment with twelve observations a pair: two positions and attitudes.

    pairs: pi, pj (3, map coordinates), ri, rj (3, roll, pitch, yaw), mi, mj (9, north-east-down to map),
    ui, uj (3, points in body axes), as arrays. sigmas: xy, z, rp, y (radians) and p2p, the condition's.
    The condition of a pair is the distance of its two ground points. Each iteration is one job: every
    task eliminates its pairs' corrections and adds up a 3 x 3 system, the driver solves it; a last
    job sums the squares. Returns theta, covariance, sigma0, mean_miss, pairs and whether it converged.
    """
    prior = np.array([1 / sigmas["xy"] ** 2] * 2 + [1 / sigmas["z"] ** 2] + [1 / sigmas["rp"] ** 2] * 2 + [1 / sigmas["y"] ** 2])
    p_block, weight = np.diag(np.tile(prior, 2)), np.eye(3) / sigmas["p2p"] ** 2
    arm = np.array(lever, float)

    def side(get, k, theta):
        """Ground point less position, its derivatives by theta and by attitude, of one side."""
        m, u = get(f"m{k}").reshape(-1, 3, 3), get(f"u{k}")
        # The rotation body to north-east-down is the transpose of R1 R2 R3 with passive factors.
        turn, by = _body_to_ned(get(f"r{k}"))
        s = u + np.cross(theta, u) + arm
        skew = np.cross(np.eye(3)[None], u[:, None, :]).transpose(0, 2, 1)  # column c: e_c x u
        return np.einsum("nij,njk,nk->ni", m, turn, s), m @ turn @ skew, np.stack([np.einsum("nij,njk,nk->ni", m, d, s) for d in by], -1)

    def pass_(theta, step):
        def work(batches):
            out = np.zeros(15)
            for b in batches:
                if not b.num_rows:
                    continue
                get = lambda c, b=b: b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                (gi, ai, di), (gj, aj, dj) = side(get, "i", theta), side(get, "j", theta)
                w, a = get("pi") + gi - get("pj") - gj, ai - aj
                eye = np.broadcast_to(np.eye(3), (b.num_rows, 3, 3))
                bb = np.concatenate([eye, di, -eye, -dj], 2)
                wb = bb.transpose(0, 2, 1) @ weight
                x = np.linalg.solve(wb @ bb + p_block, wb)  # (n, 12, 3)
                s = weight - weight @ bb @ x
                if step is None:
                    out[:9] += np.einsum("nki,nkl,nlj->ij", a, s, a).reshape(-1)
                    out[9:12] += np.einsum("nki,nkl,nl->i", a, s, w)
                else:
                    rest = np.einsum("nij,j->ni", a, step) + w
                    v = -np.einsum("nij,nj->ni", x, rest)
                    left = rest + np.einsum("nij,nj->ni", bb, v)
                    out[12] += np.einsum("ni,ij,nj->", v, p_block, v) + np.einsum("ni,ij,nj->", left, weight, left)
                out[13] += np.linalg.norm(w, axis=1).sum()
                out[14] += b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([out.tolist()], pa.list_(pa.float64()))], names=["s"])

        rows = pairs.mapInArrow(work, "s array<double>").select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()  # 15 numbers
        s = np.zeros(15)
        for r in rows:
            s[r.i] = r.v
        return s

    theta, done, step, normal, before = np.array(start, float), False, np.zeros(3), np.eye(3), np.array(start, float)
    for _ in range(most):
        s = pass_(theta, None)
        if not s[14]:
            raise ValueError("no pairs")
        normal, before = s[:9].reshape(3, 3), theta
        step = np.linalg.solve(normal, -s[9:12])
        theta = theta + step
        if np.linalg.norm(step) < tol:
            done = True
            break
    s = pass_(before, step)
    rest = 3 * s[14] - 3
    if rest <= 0:
        raise ValueError("too few pairs")
    return {"theta": theta, "covariance": s[12] / rest * np.linalg.inv(normal), "sigma0": float(np.sqrt(s[12] / rest)), "mean_miss": s[13] / s[14], "pairs": int(s[14]), "converged": done}


def _body_to_ned(rpy: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(R1 R2 R3) transposed, with factors that turn about x, y and z as R1(a) = [[1, 0, 0], [0, cos a, -sin a], [0, sin a, cos a]], and its derivatives by the three angles."""
    c, s = np.cos(rpy), np.sin(rpy)
    o, i = np.zeros(len(rpy)), np.ones(len(rpy))
    mat = lambda *rows: np.stack([np.stack(r, -1) for r in rows], -2)
    f = [
        mat((i, o, o), (o, c[:, 0], -s[:, 0]), (o, s[:, 0], c[:, 0])),
        mat((c[:, 1], o, s[:, 1]), (o, i, o), (-s[:, 1], o, c[:, 1])),
        mat((c[:, 2], -s[:, 2], o), (s[:, 2], c[:, 2], o), (o, o, i)),
    ]
    d = [
        mat((o, o, o), (o, -s[:, 0], -c[:, 0]), (o, c[:, 0], -s[:, 0])),
        mat((-s[:, 1], o, c[:, 1]), (o, o, o), (-c[:, 1], o, -s[:, 1])),
        mat((-s[:, 2], -c[:, 2], o), (c[:, 2], -s[:, 2], o), (o, o, o)),
    ]
    turned = lambda m: m.transpose(0, 2, 1)
    return turned(f[0] @ f[1] @ f[2]), [turned(d[0] @ f[1] @ f[2]), turned(f[0] @ d[1] @ f[2]), turned(f[0] @ f[1] @ d[2])]


# -- tie points --------------------------------------------------------------------


def observation_blocks(points: DataFrame, name: str, order: list[str], is_control: Column, u: str, v: str | None = None, frame: str = "frame_id") -> DataFrame:
    """Text lines of an observation file: per point a header, its rows, and -99. ``v`` None writes 0."""
    from .sequence import named_ids

    own = named_ids(points, name, is_control)
    w = Window.partitionBy("point_id").orderBy(*order)
    rows = own.withColumn("__n", F.row_number().over(w))
    text = F.format_string("%d %.4f %.4f", F.col(frame), F.col(u), F.lit(0.0) if v is None else F.col(v))
    body = rows.select("point_id", F.col("__n").alias("k"), text.alias("value"))
    ends = own.groupBy("point_id", name).agg(F.count("*").alias("n"))
    head = ends.select("point_id", F.lit(0).alias("k"), F.concat_ws(" ", F.col("point_id").cast("string"), name).alias("value"))
    tail = ends.select("point_id", (F.col("n") + 1).cast("int").alias("k"), F.lit("-99").alias("value"))
    return head.unionByName(body).unionByName(tail).orderBy("point_id", "k")


def match_template(kind: Column, parts: list[Column]) -> Column:
    """A line rendered by the number of images in its type."""
    return F.when(kind == "single", F.concat_ws(" ", *parts[:2])).when(kind == "pair", F.concat_ws(" + ", F.concat_ws(" ", *parts[:2]), F.concat_ws(" ", *parts[2:4]))).otherwise(F.concat_ws(" + ", *parts))


# -- orthorectification ------------------------------------------------------------


def ortho(grid: DataFrame, surface: DataFrame, surface_grid, to_ecef, trajectory, body_to_camera, line_times, camera, cube: DataFrame, lines: int, samples: int, from_ecef=None, ground: float | None = None, resampling: str = "bilinear", rays: int = 50, tol: float = 0.5) -> DataFrame:
    """row, col, spectrum of output cells: surface height, scan-line time, visibility, cube lookup. Cells without height, view or pixel drop out.

    ``from_ecef`` (to the surface's coordinates) switches on the visibility test: a cell is hidden if
    the surface rises above its ray to the sensor. ``ground`` takes one height for all cells instead
    of the surface's. resampling: bilinear or nearest.
    """
    from . import raster
    from .solve import scanline_times

    cells = grid.withColumn("pid", F.struct("row", "col").cast("string"))
    if ground is None:
        pts = cells.select("row", "col", "x", "y", "pid", surface_grid.row_of(F.col("y")).alias("r"), surface_grid.col_of(F.col("x")).alias("c"))
        e = raster.bilinear(pts, surface, "pid", "r", "c", surface_grid.rows, surface_grid.cols, "z", ["row", "col", "x", "y"]).where("z is not null")
    else:
        e = cells.select("row", "col", "x", "y", "pid", F.lit(float(ground)).alias("z"))
    xyz = to_ecef(F.col("x"), F.col("y"), F.col("z"))
    # What a cell needs further on travels in its id, so it is not joined again.
    own = F.struct("row", "col", "x", "y", "z")
    points = e.select(own.alias("point_id"), *[v.alias(k) for v, k in zip(xyz, ("ex", "ey", "ez"), strict=True)]).toDF("point_id", "x", "y", "z")
    seen = scanline_times(points, trajectory, body_to_camera, line_times, camera).where("valid")
    if from_ecef is not None:
        sensor = from_ecef(F.col("sx"), F.col("sy"), F.col("sz"))
        lines_of_sight = seen.select("point_id", *[F.col(f"point_id.{k}").alias(f"g{k}") for k in "xyz"], *[v.alias(f"s{k}") for v, k in zip(sensor, "xyz", strict=True)])
        hidden = raster.occluded(lines_of_sight, surface, "point_id", ("sx", "sy", "sz"), ("gx", "gy", "gz"), surface_grid, rays, tol).where("occluded")
        seen = seen.join(hidden, "point_id", "left_anti")
    places = seen.select("point_id", "line", "sample")
    if resampling == "bilinear":
        spectra = raster.cube_lookup(places, cube, "point_id", "line", "sample", lines, samples)
    else:
        spectra = raster.cube_nearest(places, cube, "line", "sample")
    return spectra.where("spectrum is not null").select("point_id.row", "point_id.col", "spectrum")
