"""Catalogue, second part: rasters, geodesy, rotations, cameras, solvers, text formats."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..functions import camera, core, geodesy, rotation
from ..operators import geometry, raster, select, sequence, solve, stats
from ..session import table
from ..sources import text
from .catalog import query

A, E2, B = geodesy.WGS84_A, geodesy.WGS84_E2, geodesy.WGS84_B


def _r(c, digits: int = 6):
    """Rounded, negative zero made plain."""
    return F.round(c, digits) + F.lit(0.0)


def _named(cols: dict, digits: int = 6):
    return [_r(v, digits).alias(k) for k, v in cols.items()]


# -- rasters -----------------------------------------------------------------------

N = 40  # columns


def _rows(spark, sf_dir) -> int:
    return table(spark, sf_dir, "part").count() // N


def _surface(spark, sf_dir):
    """A raster of all parts; every 97th cell has no value."""
    return table(spark, sf_dir, "part").select(F.expr(f"(p_partkey - 1) div {N}").alias("row"), ((F.col("p_partkey") - 1) % N).alias("col"), F.when(F.col("p_partkey") % 97 != 0, F.col("p_retailprice")).alias("z"))


SURFACE = f"s AS (SELECT (p_partkey - 1) // {N} AS row, (p_partkey - 1) % {N} AS col, CASE WHEN p_partkey % 97 <> 0 THEN p_retailprice END AS z FROM part)"
ROWS = f"((SELECT count(*) FROM part) // {N})"
POINTS = f"p AS (SELECT c_custkey, (c_custkey * 37 % 4300) / 100.0 - 1 AS r, (c_custkey * 53 % 4300) / 100.0 - 1 AS c FROM customer)"


def _points(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", (k * 37 % 4300 / 100.0 - 1).alias("r"), (k * 53 % 4300 / 100.0 - 1).alias("c"))


@query(
    f"""WITH {SURFACE}, {POINTS},
n AS (SELECT c_custkey, floor(r)::BIGINT + i AS row, floor(c)::BIGINT + j AS col, (CASE i WHEN 1 THEN r - floor(r) ELSE 1 - (r - floor(r)) END) * (CASE j WHEN 1 THEN c - floor(c) ELSE 1 - (c - floor(c)) END) AS w
  FROM p, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j) WHERE r >= 0 AND floor(r) <= {ROWS} - 2 AND c >= 0 AND floor(c) <= {N - 2}),
g AS (SELECT c_custkey, sum(w * z) AS z, count(z) AS k FROM n JOIN s USING (row, col) GROUP BY c_custkey)
SELECT p.c_custkey, round(CASE WHEN k = 4 THEN z END, 5) AS z FROM p LEFT JOIN g USING (c_custkey)"""
)
def q_bilinear(spark, sf_dir):
    return raster.bilinear(_points(spark, sf_dir), _surface(spark, sf_dir), "c_custkey", "r", "c", _rows(spark, sf_dir), N).select("c_custkey", F.round("z", 5).alias("z"))


@query(f"WITH {SURFACE}, {POINTS} SELECT c_custkey, round(z, 5) AS z FROM p LEFT JOIN s ON s.row = round_even(r, 0)::BIGINT AND s.col = round_even(c, 0)::BIGINT")
def q_nearest_cell(spark, sf_dir):
    return raster.nearest(_points(spark, sf_dir), _surface(spark, sf_dir), "r", "c").select("c_custkey", F.round("z", 5).alias("z"))


@query(
    f"""WITH {SURFACE}, k AS (SELECT s_suppkey, (s_suppkey * 7 % 39) + 0.5 AS x0, (s_suppkey * 11 % 39) + 0.5 AS y0, 900.0 AS z0, (s_suppkey * 13 % 39) + 0.5 AS x1, (s_suppkey * 17 % 39) + 0.5 AS y1, 1500.0 AS z1 FROM supplier),
a AS (SELECT s_suppkey, k.k AS i, 0.05 + k.k * (0.9 / 19) AS a, x0, y0, z0, x1, y1, z1 FROM k AS q, (SELECT unnest(range(20)) AS k) k),
b AS (SELECT s_suppkey, i, x0 + (x1 - x0) * a AS c, 40 - (y0 + (y1 - y0) * a) AS r, z0 + (z1 - z0) * a AS rz FROM a),
n AS (SELECT s_suppkey, i, rz, floor(r)::BIGINT + d AS row, floor(c)::BIGINT + e AS col, (CASE d WHEN 1 THEN r - floor(r) ELSE 1 - (r - floor(r)) END) * (CASE e WHEN 1 THEN c - floor(c) ELSE 1 - (c - floor(c)) END) AS w
  FROM b, (VALUES (0), (1)) x(d), (VALUES (0), (1)) y(e) WHERE floor(r) BETWEEN 0 AND {ROWS} - 2 AND floor(c) BETWEEN 0 AND {N - 2}),
g AS (SELECT s_suppkey, i, rz, sum(w * z) AS z, count(z) AS m FROM n JOIN s USING (row, col) GROUP BY ALL),
h AS (SELECT b.s_suppkey, b.rz, CASE WHEN m = 4 THEN z END AS z FROM b LEFT JOIN g ON b.s_suppkey = g.s_suppkey AND b.i = g.i)
SELECT s_suppkey, coalesce(bool_or(z > rz + 0.5), false) AS occluded FROM h GROUP BY s_suppkey"""
)
def q_occlusion(spark, sf_dir):
    k = F.col("s_suppkey")
    rays = table(spark, sf_dir, "supplier").select("s_suppkey", *[((k * f % 39) + 0.5).alias(n) for n, f in (("x0", 7), ("y0", 11), ("x1", 13), ("y1", 17))], F.lit(900.0).alias("z0"), F.lit(1500.0).alias("z1"))
    return raster.occluded(rays, _surface(spark, sf_dir), "s_suppkey", ("x0", "y0", "z0"), ("x1", "y1", "z1"), raster.Grid(0.0, 40.0, 1.0, _rows(spark, sf_dir), N), 20)


@query(f"WITH {SURFACE} SELECT count(z) AS n, round(avg(z), 6) AS mean_z, round(min(z), 6) AS min_z, round(max(z), 6) AS max_z FROM s")
def q_raster_stats(spark, sf_dir):
    s = raster.raster_stats(_surface(spark, sf_dir))
    return s.select("n", *[F.round(c, 6).alias(c) for c in ("mean_z", "min_z", "max_z")])


@query(f"WITH {SURFACE} SELECT row, col, round(CASE WHEN row < 2 OR row >= {ROWS} - 2 OR col < 2 OR col >= 38 THEN -9999.0 ELSE z END, 6) AS z FROM s")
def q_crop_border(spark, sf_dir):
    return raster.crop_border(_surface(spark, sf_dir), 2, _rows(spark, sf_dir), N, -9999.0).select("row", "col", F.round("z", 6).alias("z"))


@query("SELECT r AS row, c AS col, round(100 + c * 2.5, 6) AS x, round(60 - r * 2.5, 6) AS y, r // 8 AS tile_row, c // 8 AS tile_col FROM (SELECT unnest(range(20)) AS r) a, (SELECT unnest(range(40)) AS c) b")
def q_grid_tiles(spark, sf_dir):
    return raster.output_grid(spark, 101.0, 11.0, 199.0, 59.0, 2.5, 8).select("row", "col", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "tile_row", "tile_col")


@query("SELECT x, y, least(64, 200 - x)::BIGINT AS w, least(64, 150 - y)::BIGINT AS h FROM (SELECT unnest(range(0, 200, 48)) AS x) a, (SELECT unnest(range(0, 150, 48)) AS y) b")
def q_tiles_overlap(spark, sf_dir):
    return raster.overlapping_tiles(spark, 200, 150, 64, 16)


CUBE = """c AS (SELECT l_orderkey % 20 AS line, l_linenumber % 4 AS sample, min(l_quantity) AS a, max(l_discount) AS b FROM lineitem GROUP BY 1, 2 HAVING NOT (line = 7 AND sample = 2)),
p AS (SELECT s_suppkey, (s_suppkey * 7 % 230) / 10.0 - 1 AS l, (s_suppkey * 3 % 40) / 10.0 AS s FROM supplier)"""


def _cube(spark, sf_dir):
    """A cube without one of its pixels, and points, some of them outside."""
    l = table(spark, sf_dir, "lineitem")
    cube = l.groupBy((F.col("l_orderkey") % 20).alias("line"), (F.col("l_linenumber") % 4).alias("sample")).agg(F.min("l_quantity").alias("a"), F.max("l_discount").alias("b")).where("not (line = 7 and sample = 2)").select("line", "sample", F.array("a", "b").alias("spectrum"))
    k = F.col("s_suppkey")
    return cube, table(spark, sf_dir, "supplier").select("s_suppkey", (k * 7 % 230 / 10.0 - 1).alias("l"), (k * 3 % 40 / 10.0).alias("s"))


@query(
    f"""WITH {CUBE}, b AS (SELECT *, greatest(0, least(floor(l), 18))::BIGINT AS bl, greatest(0, least(floor(s), 2))::BIGINT AS bs FROM p WHERE l BETWEEN 0 AND 19 AND s BETWEEN 0 AND 3),
n AS (SELECT s_suppkey, bl + i AS line, bs + j AS sample, (CASE i WHEN 1 THEN l - bl ELSE 1 - (l - bl) END) * (CASE j WHEN 1 THEN s - bs ELSE 1 - (s - bs) END) AS w FROM b, (VALUES (0), (1)) x(i), (VALUES (0), (1)) y(j)),
g AS (SELECT s_suppkey, sum(w * a) AS b0, sum(w * b) AS b1 FROM n LEFT JOIN c USING (line, sample) WHERE w <> 0 GROUP BY s_suppkey HAVING count(*) = count(a))
SELECT s_suppkey, round(b0, 6) AS b0, round(b1, 6) AS b1 FROM supplier LEFT JOIN g USING (s_suppkey)"""
)
def q_cube_lookup(spark, sf_dir):
    cube, pts = _cube(spark, sf_dir)
    return raster.cube_lookup(pts, cube, "s_suppkey", "l", "s", 20, 4).select("s_suppkey", *[F.round(F.col("spectrum")[i], 6).alias(f"b{i}") for i in range(2)])


@query(f"WITH {CUBE} SELECT s_suppkey, a AS b0, b AS b1 FROM p LEFT JOIN c ON round_even(l, 0)::BIGINT = line AND round_even(s, 0)::BIGINT = sample")
def q_cube_nearest(spark, sf_dir):
    cube, pts = _cube(spark, sf_dir)
    return raster.cube_nearest(pts, cube, "l", "s").select("s_suppkey", *[F.col("spectrum")[i].alias(f"b{i}") for i in range(2)])


@query(
    """WITH v AS (SELECT vec_id, label, i, embedding[i]::DOUBLE AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i)), m AS (SELECT label, i, avg(x) AS m FROM v GROUP BY label, i),
d AS (SELECT v.vec_id, m.label, round(sum((x - m) ** 2), 9) AS d FROM v JOIN m ON v.i = m.i GROUP BY v.vec_id, m.label)
SELECT vec_id, arg_min(label, (d, label)) AS nearest FROM d GROUP BY vec_id"""
)
def q_nn_embed(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return stats.nearest_class(e, "label", "embedding").select("vec_id", F.col("nearest"))


# -- geodesy -----------------------------------------------------------------------


def _places(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", (45.8 + k % 190 / 100.0).alias("lat"), (6.0 + k % 440 / 100.0).alias("lon"), (k % 3000 * 1.0).alias("h"))


PLACES = "p AS (SELECT c_custkey, 45.8 + c_custkey % 190 / 100.0 AS lat, 6.0 + c_custkey % 440 / 100.0 AS lon, c_custkey % 3000 * 1.0 AS h FROM customer)"
ECEF = f"n AS (SELECT *, radians(lat) AS la, radians(lon) AS lo, {A} / sqrt(1 - {E2!r} * sin(radians(lat))**2) AS nn FROM p), e AS (SELECT *, (nn + h) * cos(la) * cos(lo) AS x, (nn + h) * cos(la) * sin(lo) AS y, (nn * (1 - {E2!r}) + h) * sin(la) AS z FROM n)"


@query(f"WITH {PLACES}, {ECEF} SELECT c_custkey, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z FROM e")
def q_ecef(spark, sf_dir):
    x = geodesy.geodetic_to_ecef("lat", "lon", "h", degrees=True)
    return _places(spark, sf_dir).select("c_custkey", *_named(dict(zip("xyz", x, strict=True)), 4))


@query(
    f"WITH {PLACES}, {ECEF}, t AS (SELECT *, sqrt(x*x+y*y) AS pp, atan2(z * {A}, sqrt(x*x+y*y) * {B!r}) AS th FROM e), u AS (SELECT *, atan2(z + {E2 / (1 - E2)!r} * {B!r} * sin(th)**3, pp - {E2!r} * {A} * cos(th)**3) AS la2 FROM t) SELECT c_custkey, round(degrees(la2), 8) AS lat, round(degrees(atan2(y, x)), 8) AS lon, round(pp / cos(la2) - {A} / sqrt(1 - {E2!r} * sin(la2)**2), 3) + 0.0 AS h FROM u"
)
def q_ecef_roundtrip(spark, sf_dir):
    p = _places(spark, sf_dir)
    x = geodesy.geodetic_to_ecef("lat", "lon", "h", degrees=True)
    e = p.select("c_custkey", *[c.alias(k) for c, k in zip(x, "xyz", strict=True)])
    la, lo, h = geodesy.ecef_to_geodetic("x", "y", "z")
    return e.select("c_custkey", F.round(F.degrees(la), 8).alias("lat"), F.round(F.degrees(lo), 8).alias("lon"), _r(h, 3).alias("h"))


@query(
    f"""WITH {PLACES}, {ECEF}, o AS (SELECT radians(46.8) AS a, radians(8.2) AS b, {A} / sqrt(1 - {E2!r} * sin(radians(46.8))**2) AS n0),
d AS (SELECT c_custkey, x - (n0 + 500) * cos(a) * cos(b) AS dx, y - (n0 + 500) * cos(a) * sin(b) AS dy, z - (n0 * (1 - {E2!r}) + 500) * sin(a) AS dz, a, b FROM e, o)
SELECT c_custkey, round(-sin(b) * dx + cos(b) * dy, 4) + 0.0 AS east, round(-sin(a) * cos(b) * dx - sin(a) * sin(b) * dy + cos(a) * dz, 4) + 0.0 AS north, round(cos(a) * cos(b) * dx + cos(a) * sin(b) * dy + sin(a) * dz, 4) + 0.0 AS up FROM d"""
)
def q_local_enu(spark, sf_dir):
    x = geodesy.geodetic_to_ecef("lat", "lon", "h", degrees=True)
    enu = geodesy.local_enu(x, math.radians(46.8), math.radians(8.2), 500.0)
    return _places(spark, sf_dir).select("c_custkey", *_named(dict(zip(("east", "north", "up"), enu, strict=True)), 4))


NED = ("-sin(a) * cos(b)", "-sin(a) * sin(b)", "cos(a)", "-sin(b)", "cos(b)", "0.0", "-cos(a) * cos(b)", "-cos(a) * sin(b)", "-sin(a)")


@query(f"WITH {PLACES}, q AS (SELECT c_custkey, radians(lat) AS a, radians(lon) AS b FROM p) SELECT c_custkey, " + ", ".join(f"round({x}, 9) + 0.0 AS m{k // 3}{k % 3}" for k, x in enumerate(NED)) + " FROM q")
def q_ned(spark, sf_dir):
    m = geodesy.ecef_to_ned(F.radians("lat"), F.radians("lon"))
    return _places(spark, sf_dir).select("c_custkey", *_named({f"m{i}{j}": m[i][j] for i in range(3) for j in range(3)}, 9))


@query(f"WITH {PLACES}, q AS (SELECT c_custkey, (lat*3600-169028.66)/10000 AS p, (lon*3600-26782.5)/10000 AS m FROM p) SELECT c_custkey, round(2600072.37+211455.93*m-10938.51*m*p-0.36*m*p*p-44.54*m*m*m, 3) AS e, round(1200147.07+308807.95*p+3745.25*m*m+76.63*p*p-194.56*m*m*p+119.79*p*p*p, 3) AS n, round(49.5+1.5e-5*(2600072.37+211455.93*m-10938.51*m*p-0.36*m*p*p-44.54*m*m*m-2600000)+2.0e-5*(1200147.07+308807.95*p+3745.25*m*m+76.63*p*p-194.56*m*m*p+119.79*p*p*p-1200000), 4) AS geoid FROM q")
def q_swiss(spark, sf_dir):
    e, n = geodesy.swiss_forward("lat", "lon")
    return _places(spark, sf_dir).select("c_custkey", F.round(e, 3).alias("e"), F.round(n, 3).alias("n"), F.round(geodesy.swiss_geoid(e, n), 4).alias("geoid"))


#: Transverse Mercator by the Krueger series, its numbers for WGS 84 as published.
KRUEGER = """k AS (SELECT *, radians(lat) AS f, radians(lon - 9) AS d FROM p), s AS (SELECT *, sinh((0.5 * ln((1 + sin(f)) / (1 - sin(f)))) - {k} * (0.5 * ln((1 + {k} * sin(f)) / (1 - {k} * sin(f))))) AS t FROM k), x AS (SELECT *, atan2(t, cos(d)) AS xi, (0.5 * ln((1 + sin(d) / sqrt(1 + t * t)) / (1 - sin(d) / sqrt(1 + t * t)))) AS eta FROM s),
w AS (SELECT c_custkey, 500000 + 0.9996::DOUBLE * {r} * (eta + {a0} * cos(2*xi) * sinh(2*eta) + {a1} * cos(4*xi) * sinh(4*eta) + {a2} * cos(6*xi) * sinh(6*eta) + {a3} * cos(8*xi) * sinh(8*eta)) AS e, 0.9996::DOUBLE * {r} * (xi + {a0} * sin(2*xi) * cosh(2*eta) + {a1} * sin(4*xi) * cosh(4*eta) + {a2} * sin(6*xi) * cosh(6*eta) + {a3} * sin(8*xi) * cosh(8*eta)) AS n FROM x)""".format(k=repr(2 * math.sqrt(0.0016792203863836984) / (1 + 0.0016792203863836984)), r="6367449.145823415::DOUBLE", a0="0.0008377318206244698::DOUBLE", a1="7.608527773572489e-07::DOUBLE", a2="1.197645503242494e-09::DOUBLE", a3="2.42917068039708e-12::DOUBLE")


@query(f"WITH {PLACES}, {KRUEGER} SELECT c_custkey, round(e, 2) AS e, round(n, 2) AS n FROM w")
def q_utm_forward(spark, sf_dir):
    """Easting and northing, to the centimetre; a test compares them with another series."""
    e, n = geodesy.utm_forward("lat", "lon", 32632)
    return _places(spark, sf_dir).select("c_custkey", F.round(e, 2).alias("e"), F.round(n, 2).alias("n"))


@query(f"WITH {PLACES} SELECT c_custkey, round(lat, 8) AS lat, round(lon, 8) AS lon FROM p")
def q_utm_roundtrip(spark, sf_dir):
    """Forward and back."""
    p = _places(spark, sf_dir).select("c_custkey", *[c.alias(k) for c, k in zip(geodesy.utm_forward("lat", "lon", 32632), "en", strict=True)])
    la, lo = geodesy.utm_inverse("e", "n", 32632)
    return p.select("c_custkey", F.round(la, 8).alias("lat"), F.round(lo, 8).alias("lon"))


@query(f"WITH {PLACES} SELECT c_custkey, round(sqrt(((8.2 - lon) * 111000.0 * cos(radians(lat)))**2 + ((46.8 - lat) * 111000.0)**2), 3) AS metres, round(1.0003 - 0.0000205 * h / 1000, 12) AS air FROM p")
def q_metres(spark, sf_dir):
    return _places(spark, sf_dir).select("c_custkey", F.round(geodesy.metres_apart("lat", "lon", 46.8, 8.2), 3).alias("metres"), F.round(geodesy.refractive_index("h"), 12).alias("air"))


# -- rotations ---------------------------------------------------------------------


def _angles(spark, sf_dir):
    v, k = F.col("value"), F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", ((k % 61 - 30) / 100.0).alias("roll"), ((k % 37 - 18) / 100.0).alias("pitch"), ((k % 628) / 100.0 - 3.1).alias("yaw"), v)


ANGLES = "a AS (SELECT event_id, (event_id % 61 - 30) / 100.0 AS r, (event_id % 37 - 18) / 100.0 AS p, (event_id % 628) / 100.0 - 3.1 AS y FROM events)"


ZYX = ("cos(y)*cos(p)", "cos(y)*sin(p)*sin(r) - sin(y)*cos(r)", "cos(y)*sin(p)*cos(r) + sin(y)*sin(r)", "sin(y)*cos(p)", "sin(y)*sin(p)*sin(r) + cos(y)*cos(r)", "sin(y)*sin(p)*cos(r) - cos(y)*sin(r)", "-sin(p)", "cos(p)*sin(r)", "cos(p)*cos(r)")


@query(f"WITH {ANGLES} SELECT event_id, " + ", ".join(f"round({x}, 9) + 0.0 AS m{k // 3}{k % 3}" for k, x in enumerate(ZYX)) + " FROM a")
def q_euler(spark, sf_dir):
    m = rotation.rpy_matrix("roll", "pitch", "yaw")
    return _angles(spark, sf_dir).select("event_id", *_named({f"m{i}{j}": m[i][j] for i in range(3) for j in range(3)}, 9))


@query(f"WITH {ANGLES} SELECT event_id, round(r, 9) + 0.0 AS roll, round(p, 9) + 0.0 AS pitch, round(CASE WHEN y > pi() THEN y - 2 * pi() ELSE y END, 9) + 0.0 AS yaw, true AS ok FROM a")
def q_euler_roundtrip(spark, sf_dir):
    """Matrix, quaternion, matrix again, angles again."""
    m = rotation.rpy_matrix("roll", "pitch", "yaw")
    q = _angles(spark, sf_dir).select("event_id", *[m[i][j].alias(f"m{i}{j}") for i in range(3) for j in range(3)])
    quat = rotation.quaternion_of([[F.col(f"m{i}{j}") for j in range(3)] for i in range(3)])
    q = q.select("event_id", *[c.alias(f"q{k}") for k, c in enumerate(quat)])
    back = rotation.matrix_of([F.col(f"q{k}") for k in range(4)])
    q = q.select("event_id", *[back[i][j].alias(f"m{i}{j}") for i in range(3) for j in range(3)])
    n = [[F.col(f"m{i}{j}") for j in range(3)] for i in range(3)]
    return q.select("event_id", *_named(dict(zip(("roll", "pitch", "yaw"), rotation.rpy_of(n), strict=True)), 9), rotation.is_rotation(n).alias("ok"))


@query(f"WITH {ANGLES}, q AS (SELECT event_id, cos(r/2) AS aw, sin(r/2) AS ax, cos(y/2) AS bw, sin(y/2) AS bz FROM a), d AS (SELECT *, aw*bw AS raw FROM q), s AS (SELECT *, CASE WHEN raw < 0 THEN -1.0 ELSE 1.0 END AS sg, least(abs(raw), 1.0) AS dd FROM d), t AS (SELECT *, acos(dd) AS th FROM s), w AS (SELECT *, CASE WHEN dd > 0.9995 THEN 0.7 ELSE sin(0.7*th)/sin(th) END AS wa, (CASE WHEN dd > 0.9995 THEN 0.3 ELSE sin(0.3*th)/sin(th) END) * sg AS wb FROM t), m AS (SELECT event_id, aw*wa+bw*wb AS w, ax*wa AS x, bz*wb AS z FROM w) SELECT event_id, round(w/sqrt(w*w+x*x+z*z), 8) + 0.0 AS w, round(x/sqrt(w*w+x*x+z*z), 8) + 0.0 AS x, round(z/sqrt(w*w+x*x+z*z), 8) + 0.0 AS z FROM m")
def q_slerp(spark, sf_dir):
    a = [F.cos(F.col("roll") / 2), F.sin(F.col("roll") / 2), F.lit(0.0), F.lit(0.0)]
    b = [F.cos(F.col("yaw") / 2), F.lit(0.0), F.lit(0.0), F.sin(F.col("yaw") / 2)]
    q = rotation.slerp(a, b, 0.3)
    return _angles(spark, sf_dir).select("event_id", *_named({"w": q[0], "x": q[1], "z": q[3]}, 8))


@query(f"WITH {ANGLES} SELECT event_id, round(acos(greatest(least((cos(y) + cos(y) + 1 - 1) / 2, 1.0), -1.0)), 6) + 0.0 AS angle FROM a")
def q_relative_angle(spark, sf_dir):
    one = rotation.rpy_matrix(0.0, 0.0, 0.0)
    return _angles(spark, sf_dir).select("event_id", _r(rotation.relative_angle(rotation.rpy_matrix(0.0, 0.0, "yaw"), one)).alias("angle"))


# -- cameras -----------------------------------------------------------------------

LENS = (-0.12, 0.03, 0.0, 0.001, -0.0005)


def _camera_points(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", (k % 101 / 100.0 - 0.5).alias("x"), (k % 83 / 100.0 - 0.4).alias("y"), (k % 7 / 2.0 - 0.5).alias("z"))


CAMERA = "p AS (SELECT o_orderkey, o_orderkey % 101 / 100.0 - 0.5 AS x, o_orderkey % 83 / 100.0 - 0.4 AS y, o_orderkey % 7 / 2.0 - 0.5 AS z FROM orders)"
DISTORT = "1 + -0.12 * r2 + 0.03 * r2 * r2"


@query(
    f"""WITH {CAMERA}, n AS (SELECT *, CASE WHEN z > 0 THEN x / z END AS a, CASE WHEN z > 0 THEN y / z END AS b FROM p), d AS (SELECT *, a*a + b*b AS r2 FROM n),
u AS (SELECT o_orderkey, z > 0 AS valid, 1200 * (a * ({DISTORT}) + 2 * 0.001 * a * b + -0.0005 * (r2 + 2*a*a)) + 640 AS u, 1200 * (b * ({DISTORT}) + 0.001 * (r2 + 2*b*b) + 2 * -0.0005 * a * b) + 512 AS v FROM d)
SELECT o_orderkey, valid, round(u, 3) AS u, round(v, 3) AS v, coalesce(u >= 0 AND u < 1280 AND v >= 0 AND v < 1024, false) AS inside FROM u"""
)
def q_project(spark, sf_dir):
    c = camera.project([F.col(k) for k in "xyz"], 1200.0, 1200.0, 640.0, 512.0, LENS)
    p = _camera_points(spark, sf_dir).select("o_orderkey", c["valid"].alias("valid"), c["u"].alias("u"), c["v"].alias("v"))
    return p.select("o_orderkey", "valid", F.round("u", 3).alias("u"), F.round("v", 3).alias("v"), camera.in_image("u", "v", 1280, 1024).alias("inside"))


@query(
    f"""WITH RECURSIVE {CAMERA}, s(o_orderkey, x, y, a, b, k, done) AS (SELECT o_orderkey, x, y, x::DOUBLE, y::DOUBLE, 0, false FROM p UNION ALL
SELECT o_orderkey, x, y, CASE WHEN done THEN a ELSE na END, CASE WHEN done THEN b ELSE nb END, k + 1, done OR (abs(na - a) < 1e-8 AND abs(nb - b) < 1e-8)
FROM (SELECT *, (x - 2*0.001*a*b - -0.0005*(a*a+b*b + 2*a*a)) / (1 + -0.12*(a*a+b*b) + 0.03*(a*a+b*b)*(a*a+b*b)) AS na, (y - 0.001*(a*a+b*b + 2*b*b) - 2*-0.0005*a*b) / (1 + -0.12*(a*a+b*b) + 0.03*(a*a+b*b)*(a*a+b*b)) AS nb FROM s WHERE k < 10))
SELECT o_orderkey, round(a, 7) + 0.0 AS a, round(b, 7) + 0.0 AS b FROM s WHERE k = 10"""
)
def q_undistort(spark, sf_dir):
    a, b = camera.undistort("x", "y", LENS)
    return _camera_points(spark, sf_dir).select("o_orderkey", _r(a, 7).alias("a"), _r(b, 7).alias("b"))


POLY = [0.1, 1.0, 0.05, -0.02]


@query(
    f"""WITH RECURSIVE {CAMERA}, s(o_orderkey, x, u, k) AS (SELECT o_orderkey, x, x::DOUBLE, 0 FROM p UNION ALL SELECT o_orderkey, x, u - (0.1 + u + 0.05*u*u - 0.02*u*u*u - x) / (1 + 0.1*u - 0.06*u*u), k + 1 FROM s WHERE k < 8)
SELECT o_orderkey, round(u, 7) + 0.0 AS u FROM s WHERE k = 8"""
)
def q_poly_inverse(spark, sf_dir):
    return _camera_points(spark, sf_dir).select("o_orderkey", _r(camera.poly_inverse("x", POLY, F.col("x")), 7).alias("u"))


ANGLE_TABLE = [round(-16.0 + 0.5 * k + 0.002 * k * k, 6) for k in range(64)]


@query(
    "WITH t AS (SELECT i, a, lead(a) OVER (ORDER BY i) AS b FROM (SELECT i::DOUBLE AS i, round(-16.0 + 0.5 * i + 0.002 * i * i, 6)::DOUBLE AS a FROM (SELECT unnest(range(64)) AS i))), p AS (SELECT o_orderkey, (o_orderkey % 500) / 10.0 - 20 AS th FROM orders) "
    "SELECT o_orderkey, round(CASE WHEN th <= -16.0 THEN 0.0 WHEN th >= (SELECT max(a) FROM t) THEN 63.0 ELSE (SELECT min(i + (th - a) / (b - a)) FROM t WHERE th > a AND th <= b) END, 6) AS u, th >= -16.0 AND th <= (SELECT max(a) FROM t) AS in_fov FROM p"
)
def q_pixel_fov(spark, sf_dir):
    p = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 500 / 10.0 - 20).alias("th"))
    c = camera.table_pixel("th", ANGLE_TABLE)
    return p.select("o_orderkey", F.round(c["u"], 6).alias("u"), c["in_fov"].alias("in_fov"))


@query("SELECT o_orderkey, round(o_orderkey % 101 - 50 + 640.0, 6) AS u, round(512.0 - (o_orderkey % 83 - 40), 6) AS up, round(o_orderkey % 83 - 40 + 512.0, 6) AS down FROM orders")
def q_photo_pixel(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 101 - 50).alias("x"), (F.col("o_orderkey") % 83 - 40).alias("y"))
    u, up = camera.photo_to_pixel("x", "y", 1280, 1024)
    down = camera.photo_to_pixel("x", "y", 1280, 1024, v_up=False)[1]
    return o.select("o_orderkey", F.round(u.cast("double"), 6).alias("u"), F.round(up.cast("double"), 6).alias("up"), F.round(down.cast("double"), 6).alias("down"))


# -- rays and solvers --------------------------------------------------------------

#: Three views of each order's point.
VIEWS = ((0.0, 0.0, 1500.0), (400.0, 50.0, 1520.0), (-300.0, 220.0, 1480.0))


def _views(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", (k % 97 * 1.0).alias("px"), (k % 89 * 1.0).alias("py"), (k % 53 * 1.0).alias("pz"))
    each = o.withColumn("c", F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(view, ("cx", "cy", "cz"), strict=True)]) for view in VIEWS]))).select("o_orderkey", "px", "py", "pz", "c.*")
    return each.select("o_orderkey", "px", "py", "pz", "cx", "cy", "cz", *[(F.col(f"p{k}") - F.col(f"c{k}")).alias(f"d{k}") for k in "xyz"])


@query("SELECT o_orderkey, 3::BIGINT AS views, round(o_orderkey % 97, 4) + 0.0 AS x, round(o_orderkey % 89, 4) + 0.0 AS y, round(o_orderkey % 53, 4) + 0.0 AS z FROM orders")
def q_triangulate(spark, sf_dir):
    t = geometry.triangulate(_views(spark, sf_dir), "o_orderkey", ("cx", "cy", "cz"), ("dx", "dy", "dz"))
    return t.select("o_orderkey", "views", *[_r(k, 4).alias(k) for k in "xyz"])


@query(
    "WITH p AS (SELECT o_orderkey AS k, (o_orderkey % 97)::DOUBLE AS x, (o_orderkey % 89)::DOUBLE AS y, (o_orderkey % 53)::DOUBLE AS z FROM orders), v(cx, cy, cz) AS (VALUES " + ", ".join(f"({x}, {y}, {z})" for x, y, z in VIEWS) + "), "
    "r AS (SELECT k, x - cx AS ax, y - cy AS ay, z + 3 - cz AS az, x - cx AS dx, y - cy AS dy, z - cz AS dz FROM p, v), "
    "s AS (SELECT k, ((ax*ax + ay*ay + az*az) * (dx*dx + dy*dy + dz*dz) - (ax*dx + ay*dy + az*dz)**2) / (ax*dx + ay*dy + az*dz)**2 AS t FROM r) "
    "SELECT k AS o_orderkey, 3::BIGINT AS views, round(1200 * sqrt(avg(greatest(t, 0))), 3) AS rmse_px, CASE WHEN k % 2 = 0 THEN 5.0 ELSE -1.0 END AS error_3d FROM s GROUP BY k"
)
def q_triangulation_report(spark, sf_dir):
    """Points three metres too high, against control points four metres to the side of the true place."""
    v = _views(spark, sf_dir)
    t = geometry.triangulate(v, "o_orderkey", ("cx", "cy", "cz"), ("dx", "dy", "dz"))
    raised = t.withColumn("z", F.rint("z") + 3).withColumn("x", F.rint("x")).withColumn("y", F.rint("y"))
    control = v.where("o_orderkey % 2 = 0").groupBy("o_orderkey").agg((F.first("px") + 4).alias("x"), F.first("py").alias("y"), F.first("pz").alias("z"))
    r = geometry.triangulation_report(raised, v, control, "o_orderkey", ("cx", "cy", "cz"), ("dx", "dy", "dz"), 1200.0)
    return r.select("o_orderkey", "views", _r("rmse_px", 3).alias("rmse_px"), _r("error_3d", 3).alias("error_3d"))


VECTORS = "v AS (SELECT o_orderkey, o_orderkey % 11 - 5.0 AS a, o_orderkey % 7 - 3.0 AS b, o_orderkey % 5 + 1.0 AS c FROM orders)"


def _vectors(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", (k % 11 - 5.0).alias("a"), (k % 7 - 3.0).alias("b"), (k % 5 + 1.0).alias("c"))


@query(f"WITH {VECTORS} SELECT o_orderkey, round(sqrt((2*c - 3*b)**2 + (3*a - 1*c)**2 + (1*b - 2*a)**2) / sqrt(a*a+b*b+c*c), 6) AS d FROM v")
def q_ray_distance(spark, sf_dir):
    d = camera.point_ray_distance(core.vec(1.0, 2.0, 3.0), core.vec(0.0, 0.0, 0.0), core.vec("a", "b", "c"))
    return _vectors(spark, sf_dir).select("o_orderkey", F.round(d, 6).alias("d"))


@query(
    f"""WITH {VECTORS}, n AS (SELECT *, b*3 - c*2 AS n0, c*1 - a*3 AS n1, a*2 - b*1 AS n2 FROM v), m AS (SELECT *, n0*n0+n1*n1+n2*n2 AS nn FROM n),
k AS (SELECT *, ((0*3-0*2)*n0 + (0*1-5*3)*n1 + (5*2-0*1)*n2) / nullif(nn, 0) AS t, ((0*c-0*b)*n0 + (0*a-5*c)*n1 + (5*b-0*a)*n2) / nullif(nn, 0) AS s FROM m)
SELECT o_orderkey, round(CASE WHEN sqrt(nn) >= 1e-7 THEN (a*t + 5 + s) / 2 END, 6) + 0.0 AS x, round(CASE WHEN sqrt(nn) >= 1e-7 THEN sqrt((a*t-5-s)**2 + (b*t-2*s)**2 + (c*t-3*s)**2) END, 6) + 0.0 AS miss FROM k"""
)
def q_two_ray(spark, sf_dir):
    r = camera.two_rays(core.vec(0.0, 0.0, 0.0), core.vec("a", "b", "c"), core.vec(5.0, 0.0, 0.0), core.vec(1.0, 2.0, 3.0))
    return _vectors(spark, sf_dir).select("o_orderkey", _r(r["x"]).alias("x"), _r(r["miss"]).alias("miss"))


def straight_flight(n: int = 500, seconds: float = 10.0) -> solve.Trajectory:
    """Records over some seconds at 1500 m, heading east."""
    t = np.linspace(0, seconds, n)
    z = np.zeros(n)
    return solve.Trajectory.of(t, np.full(n, math.radians(46.95)), np.radians(7.44 + 0.02 * t / seconds), np.full(n, 1500.0), z, z, np.full(n, math.pi / 2))


@query("SELECT c_custkey AS point_id, round((0.001 + c_custkey % 180 / 10000.0) / 0.02 * 10, 4) AS time, round((0.001 + c_custkey % 180 / 10000.0) / 0.02 * 999, 3) AS line, 31.5 AS u, 36.5 AS sample, true AS valid FROM customer")
def q_newton_time(spark, sf_dir):
    """Ground points below the track, one per customer: on a straight level flight each is seen when the sensor has its longitude, by the middle of the line."""
    k = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("point_id"), F.lit(46.95).alias("lat"), (7.441 + k % 180 / 10000.0).alias("lon"))
    x = geodesy.geodetic_to_ecef("lat", "lon", 500.0, degrees=True)
    g = p.select("point_id", *[c.alias(n) for c, n in zip(x, "xyz", strict=True)])
    sensor = camera.TableCamera(tuple(np.linspace(-20, 20, 64)), (0.0, 0.0, 1e-4), first=5)
    s = solve.scanline_times(g, straight_flight(), solve.MOUNT, np.linspace(0, 10, 1000), sensor)
    return s.select("point_id", F.round("time", 4).alias("time"), F.round("line", 3).alias("line"), F.round("u", 3).alias("u"), F.round("sample", 3).alias("sample"), "valid")


@query("SELECT l_orderkey, l_linenumber, xor(l_orderkey & 65535, 32768) AS v FROM lineitem")
def q_xor(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", select.flip_sign_bit(F.col("l_orderkey")).alias("v"))


@query(
    """WITH s AS (SELECT count(*)::DOUBLE AS n, sum(t) AS a, sum(t**2) AS b, sum(t**3) AS c, sum(t**4) AS d, sum(y) AS p, sum(t*y) AS q, sum(t*t*y) AS r FROM (SELECT l_quantity - 25 AS t, l_extendedprice AS y FROM lineitem)),
d AS (SELECT *, n*(b*d - c*c) - a*(a*d - c*b) + b*(a*c - b*b) AS det FROM s),
k AS (SELECT (p*(b*d - c*c) - a*(q*d - c*r) + b*(q*c - b*r)) / det AS c0, (n*(q*d - c*r) - p*(a*d - c*b) + b*(a*r - q*b)) / det AS c1, (n*(b*r - q*c) - a*(a*r - q*b) + p*(a*c - b*b)) / det AS c2 FROM d)
SELECT 0 AS power, round(c0 - 25*c1 + 625*c2, 2) + 0.0 AS coefficient FROM k UNION ALL SELECT 1, round(c1 - 50*c2, 2) + 0.0 FROM k UNION ALL SELECT 2, round(c2, 2) + 0.0 FROM k"""
)
def q_polyfit(spark, sf_dir):
    c = stats.polynomial_fit(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity", 2)
    return spark.createDataFrame([(k, round(float(v), 2) + 0.0) for k, v in enumerate(c)], "power int, coefficient double")


# -- text formats ------------------------------------------------------------------


def _talk(spark, sf_dir):
    """Conversations as lines of a block file: a header, a row per turn, the end mark; some have a note and a lone number first, which are no headers."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    body = c.select("conv_id", (F.col("turn") + 1).alias("line_no"), F.when(F.col("turn") % 5 == 4, F.lit("broken line")).otherwise(F.concat_ws(" ", F.col("turn").cast("string"), F.format_string("%.2f", F.col("turn") * 1.5), F.lit("-3.25"))).alias("value"))
    ends = c.groupBy("conv_id").agg(F.max("turn").alias("t"))
    head = ends.select("conv_id", F.lit(0).cast("long").alias("line_no"), F.concat(F.lit(""), F.col("conv_id"), F.lit(" point "), F.col("conv_id")).alias("value"))
    notes = ends.where("conv_id % 4 = 1").select("conv_id", F.explode(F.array(F.struct(F.lit(-2).cast("long").alias("line_no"), F.lit("a note").alias("value")), F.struct(F.lit(-1).cast("long").alias("line_no"), F.lit("77").alias("value")))).alias("n")).select("conv_id", "n.*")
    tail = ends.select("conv_id", (F.col("t") + 2).alias("line_no"), F.lit("-99").alias("value"))
    return head.unionByName(body).unionByName(tail).unionByName(notes)


@query("SELECT conv_id, conv_id::INT AS gcp_id, 'point ' || conv_id AS gcp_name, turn::INT AS image_id, round(turn * 1.5, 2) AS u, -3.25 AS v FROM conversations WHERE turn % 5 <> 4")
def q_bingo_parse(spark, sf_dir):
    b = text.blocks(_talk(spark, sf_dir), "gcp", ["conv_id"])
    return b.select("conv_id", "gcp_id", "gcp_name", "image_id", F.round("u", 2).alias("u"), "v")


@query("SELECT conv_id, conv_id::INT AS image_id, turn::INT AS point_id, round(turn * 1.5, 2) AS u FROM conversations WHERE turn % 5 <> 4 AND conv_id % 3 <> 0")
def q_bingo_images(spark, sf_dir):
    """Blocks by image; those of every third conversation lack their end mark and drop out."""
    lines = _talk(spark, sf_dir).where("line_no >= 0 and not (value = '-99' and conv_id % 3 = 0)")
    return text.blocks(lines, "image", ["conv_id"]).select("conv_id", "image_id", "point_id", F.round("u", 2).alias("u"))


@query("WITH h AS (SELECT page_id, regexp_extract_all(url, '([a-z]+)\\.example', 1) AS a, regexp_extract_all(url, '/([0-9]+)', 1) AS b FROM pages), n AS (SELECT page_id, list_concat(a, b) AS h FROM h) SELECT page_id, side - 1 AS side, h[side] AS name FROM n, (VALUES (1), (2)) s(side) WHERE len(h) = 2")
def q_regex_pairs(spark, sf_dir):
    """Rows that hold exactly two names."""
    return text.named_pairs(table(spark, sf_dir, "pages"), "page_id", "url", [r"([a-z]+)\.example", r"/([0-9]+)"])


@query("SELECT page_id, (i - 1)::INT AS side, 'L' || n || '_UVT' AS name FROM (SELECT page_id, ['1' || page_id, '2' || page_id] AS a FROM pages WHERE page_id % 2 = 0), (VALUES (1), (2)) s(i), LATERAL (SELECT a[i] AS n)")
def q_regex_uvt(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("line_1"), "page_id", F.lit(" to line_2"), "page_id")).otherwise(F.concat(F.lit("line_1"), "page_id")).alias("value"))
    return text.uvt_pairs(p, "page_id").select("page_id", "side", "name")


@query("SELECT doc_id, CASE WHEN contains(l, chr(9)) THEN chr(9) WHEN contains(l, ';') THEN ';' ELSE ',' END AS sep FROM (SELECT doc_id, split_part(text, chr(10), 1) AS l FROM documents)")
def q_delim_sniff(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.sniff_column(F.split("text", "\n")[0]).alias("sep"))


@query("SELECT conv_id::INT AS image_id, arg_max(round(turn * 0.5, 6), turn) AS time FROM conversations WHERE turn % 3 <> 1 GROUP BY conv_id")
def q_timing(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    line = F.when(F.col("turn") % 3 == 1, F.concat(F.lit("# "), F.col("conv_id"))).otherwise(F.concat_ws(",", F.col("conv_id").cast("string"), F.format_string("%.3f", F.col("turn") * 0.5)))
    return text.timing(c.select(F.col("turn").alias("line_no"), line.alias("value"))).select("image_id", F.round("time", 6).alias("time"))


@query("SELECT conv_id, turn AS line_no, turn * 1.0 AS u1, 2.0 AS idx1, -1.5 AS u2, conv_id * 1.0 AS idx2 FROM conversations WHERE role <> 'user'")
def q_match_rows(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    line = F.when(F.col("role") != "user", F.format_string("%d  2 -1.5 %d", "turn", "conv_id")).otherwise(F.format_string("%d 2 x %d", "turn", "conv_id"))
    rows = c.select(F.struct("conv_id", "turn").alias("line_no"), line.alias("value"))
    return text.match_rows(rows).select("line_no.conv_id", F.col("line_no.turn").alias("line_no"), "u1", "idx1", "u2", "idx2")


@query("SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'ERROR' ELSE printf('%.8f', event_id / 8.0) END AS lon FROM events")
def q_error_literals(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 10 != 0, F.col("event_id") / 8.0).alias("lon"))
    return text.with_error_literals(e, ["lon"])


@query("SELECT event_id || ',' || printf('%.4f', event_id / 16.0) || ',' || event_type AS value FROM events")
def q_fixed_csv(spark, sf_dir):
    return text.fixed(table(spark, sf_dir, "events").select("event_id", (F.col("event_id") / 16.0).alias("t"), "event_type"), {"t": 4})


@query("SELECT event_type, CASE WHEN event_type = 'click' THEN event_id || ' ' || user_id ELSE event_id || ' + ' || user_id END AS line FROM events")
def q_template(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    parts = [F.col("event_id").cast("string"), F.col("user_id").cast("string")]
    return e.select("event_type", geometry.match_template(F.when(F.col("event_type") == "click", "single").otherwise("many"), parts).alias("line"))


REPORT = """WITH g AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type), u AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)
SELECT 'summary' AS part, '{"n":' || count(*) || '}' AS value FROM events UNION ALL SELECT 'per_type', '{"event_type":"' || event_type || '","n":' || n || '}' FROM g
UNION ALL SELECT 'per_user', '{"user_id":' || user_id || ',"n":' || n || '}' FROM u UNION ALL SELECT 'details', '{"event_id":' || event_id || ',"user_id":' || user_id || '}' FROM events"""


@query(REPORT)
def q_json_report(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    per = {name: e.groupBy(key).agg(F.count("*").alias("n")) for name, key in (("per_type", "event_type"), ("per_user", "user_id"))}
    return text.report_lines(e.agg(F.count("*").alias("n")), per, e.select("event_id", "user_id"))
