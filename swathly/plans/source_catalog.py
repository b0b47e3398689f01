"""Catalogue, fourth part: sources over seeded files, control-point validation, sensor models."""

from __future__ import annotations

import os
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import functions as F

from ..functions import camera, core, geodesy, rotation
from ..operators import control, geometry, raster, scale, select, sequence, solve, stats
from ..session import shared_dir, table
from ..sources import binary, text
from .catalog import query
from .geometry_catalog import ANGLES, ZYX, _angles, _named, _r

A, E2 = geodesy.WGS84_A, geodesy.WGS84_E2


def fixture(spark, name: str, raw: bytes) -> str:
    """A small seeded file in the shared folder, which has to be mounted: the readers of binary records open files by path."""
    at = urlparse(shared_dir(spark))
    if at.scheme not in ("", "file"):
        raise ValueError(f"{at.scheme} is no mounted file system")
    path = f"{at.path}/swathly-fixtures/{name}"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(f"{path}.{os.getpid()}", "wb") as f:
        f.write(raw)
    os.replace(f"{path}.{os.getpid()}", path)
    binary.register(spark)
    return path


# -- binary sources ----------------------------------------------------------------

RECORDS = 5000


def _nav_file(spark) -> str:
    k = np.arange(RECORDS, dtype=float)
    x = np.zeros((RECORDS, 17))
    x[:, 0], x[:, 1], x[:, 2], x[:, 3] = 86_300 + k / 50, 0.81 + k * 1e-6, 0.13 + k * 2e-6, 1500 + k % 7
    x[:, 7], x[:, 8], x[:, 9], x[:, 10] = (k % 11) / 100, (k % 13) / 100, 5.5 + (k % 100) / 100, (k % 17) / 50
    return fixture(spark, "flight.out", x.astype("<f8").tobytes())


NAV = f"k AS (SELECT unnest(range({RECORDS}))::DOUBLE AS k), n AS (SELECT k, 86300 + k / 50 AS t, 0.81 + k * 1e-6 AS lat, 0.13 + k * 2e-6 AS lon, 1500 + k % 7 AS alt, (k % 11) / 100 AS roll, (k % 13) / 100 AS pitch, 5.5 + (k % 100) / 100 AS h, (k % 17) / 50 AS w FROM k)"


@query(f"WITH {NAV} SELECT round(t, 4) AS time, round(lat, 9) AS latitude, round(alt, 3) AS altitude, round(h + w - floor((h + w) / (2 * pi())) * 2 * pi(), 9) AS true_heading FROM n WHERE t > 86320 AND t <= 86380")
def q_nav_source(spark, sf_dir):
    """Navigation records in a time window, which the reader finds by binary search."""
    n = spark.read.format("nav").option("records", 700).load(_nav_file(spark)).where("time > 86320 and time <= 86380")
    return n.select(F.round("time", 4).alias("time"), F.round("latitude", 9).alias("latitude"), F.round("altitude", 3).alias("altitude"), F.round("true_heading", 9).alias("true_heading"))


@query(f"WITH {NAV} SELECT round(t, 4) AS time, round(degrees(lat), 9) AS latitude, round(degrees(pitch), 9) AS pitch, round(degrees(h - w), 9) AS true_heading, round(t - floor(t / 86400) * 86400, 4) AS tod FROM n WHERE (k + 1) % 10 = 0")
def q_nav_degrees(spark, sf_dir):
    """Every tenth record, in degrees, the wander angle taken away; seconds of week as seconds of day."""
    n = text.navigation(spark, _nav_file(spark), every=10, units="deg", heading="minus")
    return n.select(F.round("time", 4).alias("time"), F.round("latitude", 9).alias("latitude"), F.round("pitch", 9).alias("pitch"), F.round("true_heading", 9).alias("true_heading"), F.round(select.time_of_day(F.col("time")), 4).alias("tod"))


LINES = 400


def _frame_file(spark) -> str:
    k = np.arange(LINES, dtype=np.int64)
    raw = np.zeros((LINES, 400), np.uint8)
    put = lambda at, v, kind: raw.__setitem__((slice(None), slice(at, at + np.dtype(kind).itemsize)), v.astype(kind).view(np.uint8).reshape(LINES, -1))
    gps, pps = 700_000 + 10_000 * (k // 37), 65_000 + 1000 * (k // 37)
    put(0, 66_000 + 460 * k, "<u4")
    put(80, np.where(k % 37 == 5, 0xBABE, 7), "<u2")
    put(103, gps + np.select([k % 3 == 0, k % 3 == 1], [10_100, 300], 200), ">u4")
    put(116, gps, ">u4")
    for at, v in ((164, pps), (168, pps + np.where(k % 2 == 0, 900, 5000))):
        put(at, v >> 16, "<u2")
        put(at + 2, v & 0xFFFF, "<u2")
    return fixture(spark, "frames.raw", raw.tobytes())


FRAMES = f"""k AS (SELECT unnest(range({LINES})) AS k), f AS (SELECT k, 700000 + 10000 * (k // 37) AS gps, 65000 + 1000 * (k // 37) AS pps, 66000 + 460 * k AS t, k % 37 = 5 AS flag,
700000 + 10000 * (k // 37) + CASE k % 3 WHEN 0 THEN 10100 WHEN 1 THEN 300 ELSE 200 END AS nav, 65000 + 1000 * (k // 37) + CASE k % 2 WHEN 0 THEN 900 ELSE 5000 END AS tele FROM k),
g AS (SELECT k, pps, gps, CASE WHEN ((nav - gps) / 1e4 > 1 AND (nav - gps) / 1e4 < 1.027 OR (nav - gps) / 1e4 < 0.027) AND (tele - pps) / 1e5 > 0 AND (tele - pps) / 1e5 < 0.027 THEN gps + 1 ELSE gps END AS now FROM f WHERE flag),
m AS (SELECT f.k, f.t, arg_min(g.k, (abs(f.k - g.k), -g.k)) AS n FROM f, g GROUP BY f.k, f.t)"""


@query(f"WITH {FRAMES} SELECT m.k AS line_id, g.gps * 10 + m.t - g.pps AS plain, g.now * 10 + m.t - g.pps AS corrected, 432001000::BIGINT + 460 * m.k AS internal FROM m JOIN g ON m.n = g.k")
def q_frame_times(spark, sf_dir):
    """Line times from the nearest flagged pulse, plain and brought up to date, and from the internal clock alone."""
    f = spark.read.format("frames").options(line_bytes=400, lines=64).load(_frame_file(spark))
    plain = select.frame_times(f).select("line_id", F.col("tick").alias("plain"))
    own = select.frame_times(f, corrected=True).select("line_id", F.col("tick").alias("corrected"))
    internal = select.internal_clock_times(f, F.lit(4320.01)).select("line_id", (F.col("tick") * 1).alias("internal"))
    return plain.join(own, "line_id").join(internal.withColumn("internal", F.col("internal")), "line_id")


@query("WITH c AS (SELECT unnest(['bil', 'bip', 'bsq']) AS mode), l AS (SELECT unnest(range(12)) AS l), s AS (SELECT unnest(range(5)) AS s) SELECT mode, l::INT AS line, s::INT AS sample, (100 * l + 10 * s + 3)::DOUBLE AS b3, (100 * l + 10 * s)::DOUBLE AS b0 FROM c, l, s")
def q_cube_source(spark, sf_dir):
    """Two bands of one cube, as it stands in three interleaves."""
    l, s, b = np.meshgrid(np.arange(12), np.arange(5), np.arange(4), indexing="ij")
    cube, out = (100 * l + 10 * s + b).astype("<u2"), None
    for mode, order in (("bil", (0, 2, 1)), ("bip", (0, 1, 2)), ("bsq", (2, 0, 1))):
        path = fixture(spark, f"cube-{mode}.img", np.ascontiguousarray(cube.transpose(order)).tobytes())
        binary.write_envi_header(path + ".hdr", 12, 5, 4, 12, mode)
        one = spark.read.format("cube").options(bands="3,0", lines=5).load(path).select(F.lit(mode).alias("mode"), "line", "sample", F.col("spectrum")[0].alias("b3"), F.col("spectrum")[1].alias("b0"))
        out = one if out is None else out.unionByName(one)
    return out


@query("WITH l AS (SELECT unnest(range(9)) AS l), s AS (SELECT unnest(range(6)) AS s) SELECT l::INT AS line, s::INT AS sample, xor(1000 * l + 10 * s, 32768)::DOUBLE AS b0, xor(1000 * l + 10 * s + 1, 32768)::DOUBLE AS b1, xor(1000 * l + 10 * s + 2, 32768)::DOUBLE AS b2 FROM l, s")
def q_raw_to_bil(spark, sf_dir):
    """Raw frames, the last one cut off, to a cube of part files with their highest bit turned over, and read again."""
    l, s, b = np.meshgrid(np.arange(9), np.arange(6), np.arange(3), indexing="ij")
    raw = fixture(spark, "frames.u16", (1000 * l + 10 * s + b).astype("<u2").tobytes() + b"rest")
    target = raw + ".bil"
    binary.raw_to_bil(spark, raw, target, 6, 3)
    part = sorted(p for p in os.listdir(target) if p.endswith(".bil"))[0]
    cube = spark.read.format("cube").option("header", f"{target}/cube.hdr").load(f"{target}/{part}")
    return cube.select("line", "sample", *[F.col("spectrum")[k].alias(f"b{k}") for k in range(3)])


# -- text sources ------------------------------------------------------------------


N_TEXT = 300


@query(f"WITH k AS (SELECT unnest(range({N_TEXT})) AS k) SELECT k::DOUBLE AS time, 46 + k / 1000 AS latitude, (k * 7 % 360)::DOUBLE AS yaw, CASE WHEN k % 9 <> 0 THEN k / 4 END AS plain, (k * 11 % 100)::VARCHAR AS word FROM k")
def q_trajectory_text(spark, sf_dir):
    """A trajectory with a header, heading for yaw; and a file without one, comments in between, bad numbers null."""
    rows = "".join(f"{k},{46 + k / 1000},7.5,500,0,0,{k * 7 % 360}\n" for k in range(N_TEXT))
    flight = text.navigation(spark, fixture(spark, "flight.csv", f"time,latitude,longitude,height,roll,pitch,heading\n# a note\n{rows}".encode()))
    rows = "".join(f"# {k}\n{k},{k / 4 if k % 9 else 'none'}, {k * 11 % 100}\n" for k in range(N_TEXT))
    plain = text.plain_csv(spark, fixture(spark, "plain.csv", rows.encode()), "time double, plain double, word string")
    return flight.select("time", "latitude", "yaw").join(plain, "time")


@query(f"WITH k AS (SELECT unnest(range({N_TEXT})) AS k) SELECT k AS line_id, 4000000 + 460 * k AS tick, round((4000000 + 460 * k) / 100000, 5) AS seconds FROM k")
def q_exposures(spark, sf_dir):
    """Exposure times, one a line, with lines in between that are none."""
    rows = "exposures\n" + "".join(f"{4_000_000 + 460 * k}\n" + ("\n" if k % 7 == 0 else "") for k in range(N_TEXT))
    e = text.exposure_times(text.lines(spark, fixture(spark, "exposures.txt", rows.encode())))
    return e.select(F.col("line_id").cast("long").alias("line_id"), "tick", F.round("seconds", 5).alias("seconds"))


@query("WITH f AS (SELECT unnest(range(12)) AS f) SELECT 'exif-' || f || '.txt' AS file, 1700000000000000000 + f * 1000003 AS time_ns FROM f WHERE f % 5 <> 4")
def q_exif_times(spark, sf_dir):
    """The first time stamp of each side file; some have none."""
    for f in range(12):
        path = fixture(spark, f"exif/exif-{f}.txt", (f"# {f}\n" + ("" if f % 5 == 4 else f"#TIMESTAMP = {1_700_000_000_000_000_000 + f * 1_000_003}\n#TIMESTAMP = 5\n")).encode())
    e = text.exif_times(spark, os.path.dirname(path))
    return e.select(F.element_at(F.split("file", "/"), -1).alias("file"), "time_ns")


@query(f"WITH k AS (SELECT unnest(range({N_TEXT})) AS k) SELECT 'p' || k AS name, 2600000.0 + k AS easting, 1200000.5 - k AS northing, 400 + k / 2 AS height, 'GEOXY p' || k || ' ' || format('{{:.3f}}', 2600000.0 + k) || ' ' || format('{{:.3f}}', 1200000.5 - k) || ' ' || format('{{:.3f}}', 400 + k / 2) || ' PRIORID p' || k AS line FROM k WHERE k % 10 <> 9")
def q_points_text(spark, sf_dir):
    """Points of a file whose delimiter and column names are found out, rows without numbers skipped, written as geodetic records."""
    rows = "Punkt;Ost;Nord;Hoehe\n" + "".join(f"p{k};{2_600_000 + k if k % 10 != 9 else 'x'};{1_200_000.5 - k};{400 + k / 2}\n" for k in range(N_TEXT))
    p = text.points_csv(spark, fixture(spark, "points.csv", rows.encode()))
    own = F.struct(*p.columns)
    lines = text.geo_records(p.select("name", F.col("easting").alias("x"), F.col("northing").alias("y"), F.col("height").alias("z"))).withColumn("name", F.element_at(F.split("value", " "), 2))
    return p.withColumn("own", own).join(lines, "name").select("own.*", F.col("value").alias("line"))


@query("WITH k AS (SELECT unnest(range(64)) AS k) SELECT k, -16 + k / 2 AS angle, 400.0 + 10 * k AS wavelength FROM k")
def q_number_tables(spark, sf_dir):
    """Angles of pixels and wavelengths of bands from their text files."""
    angles = text.rising(text.number_table(spark, fixture(spark, "angles.txt", ("# degrees\n" + "".join(f"{-16 + k / 2}\n" for k in range(64))).encode())))
    waves = text.number_table(spark, fixture(spark, "waves.txt", "".join(f"band{k}, {400 + 10 * k}\n" for k in range(64)).encode()), 1)
    return spark.createDataFrame([(k, a, w) for k, (a, w) in enumerate(zip(angles, waves, strict=True))], "k long, angle double, wavelength double")


@query("WITH m AS (SELECT conv_id::INT AS k, turn AS t FROM conversations) SELECT row_number() OVER (ORDER BY k, t) AS n, k, t FROM m")
def q_merge_sorted(spark, sf_dir):
    """Several tables as one, in the order of numbers that were texts."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").cast("int").alias("k"), F.col("turn").alias("t"))
    m = sequence.merge_sorted([c.where("t % 3 = 0"), c.where("t % 3 = 1"), c.where("t % 3 = 2")], ["k", "t"])
    return scale.numbered(sequence.stable_order(m, "k", "t"), ["k", "t"], "n").select(F.col("n").cast("long").alias("n"), "k", "t")


def _as_lines(df, value, key: str = "line_no"):
    return df.select(F.lit("f").alias("file"), F.col(key).cast("long").alias("line_no"), value.alias("value"))


@query(
    """WITH e AS (SELECT event_id, user_id, (event_id * 7 + 3) % 86400 AS s, event_id % 4 AS z FROM events)
SELECT CASE WHEN event_id % 9 = 0 THEN 'all_frames' ELSE 'Line_' || user_id || '.raw' END AS filename, CASE WHEN event_id % 9 = 0 THEN NULL ELSE user_id END::INT AS line_in_name,
round((s + 0.123456789 - z * 3600 + 86400) % 86400, 6) AS tod FROM e WHERE event_id % 11 <> 0"""
)
def q_creation_listing(spark, sf_dir):
    """Birth times of files in a listing that also has modification times; some lines are too short."""
    s, z = (F.col("event_id") * 7 + 3) % 86400, F.col("event_id") % 4
    name = F.when(F.col("event_id") % 9 == 0, "all_frames").otherwise(F.concat(F.lit("Line_"), F.col("user_id").cast("string"), F.lit(".raw")))
    hms = F.format_string("%02d:%02d:%02d.123456789", F.expr("cast(((event_id * 7 + 3) % 86400) div 3600 as int)"), F.expr("cast((((event_id * 7 + 3) % 86400) div 60) % 60 as int)"), (s % 60).cast("int"))
    zone = F.concat(F.lit("+0"), z.cast("string"), F.lit("00"))
    short = F.when(F.col("event_id") % 11 == 0, F.lit("")).otherwise(F.concat(F.lit(" 2024-05-02 "), hms, F.lit(" "), zone))
    value = F.concat(name, F.lit(" M: 2024-05-01 01:02:03.5 +0200 B:"), short)
    r = text.creation_listing(_as_lines(table(spark, sf_dir, "events"), value, "event_id"))
    return r.select("filename", "line_in_name", F.round("tod", 6).alias("tod"))


@query(
    """WITH e AS (SELECT event_id, user_id, value FROM events), a AS (SELECT 'u' || user_id AS image_id, arg_max(round(value, 4), event_id) AS time FROM e WHERE event_id % 10 <> 3 GROUP BY user_id)
SELECT 'named' AS part, image_id, time FROM a UNION ALL SELECT 'first', event_id::VARCHAR, round(value, 4) FROM e WHERE event_id % 10 <> 3"""
)
def q_timing_columns(spark, sf_dir):
    """Times by the place of their column, ids as text; and files of times alone."""
    e = table(spark, sf_dir, "events").withColumn("v", F.format_string("%.4f", "value"))
    broken = F.col("event_id") % 10 == 3
    named = text.timing_columns(_as_lines(e, F.when(broken, F.lit("# none")).otherwise(F.concat_ws(";", F.lit("x"), "v", F.concat(F.lit("u"), F.col("user_id").cast("string")))), "event_id"), 2, 1, ";", True)
    first = text.first_column(_as_lines(e, F.when(broken, F.lit("none")).otherwise(F.concat_ws(" ", "v", F.lit("x"))), "event_id"))
    return named.select(F.lit("named").alias("part"), "image_id", "time").unionByName(first.select(F.lit("first").alias("part"), F.col("line_no").cast("string").alias("image_id"), "time"))


@query("SELECT turn::INT AS point_id, count(*) AS views, min(conv_id)::INT AS first_image, round(sum(turn * 1.5), 2) AS total_u FROM conversations WHERE turn % 5 <> 4 GROUP BY turn")
def q_by_point(spark, sf_dir):
    """Blocks by image, regrouped by tie point."""
    from .geometry_catalog import _talk

    b = text.blocks(_talk(spark, sf_dir).where("line_no >= 0"), "image", ["conv_id"])
    p = text.by_point(b)
    return p.select("point_id", F.size("views").cast("long").alias("views"), F.col("views")[0]["image_id"].alias("first_image"), F.round(F.aggregate("views", F.lit(0.0), lambda a, x: a + x["u"]), 2).alias("total_u"))


@query(
    f"""WITH s AS (SELECT arg_max(s_suppkey, s_suppkey) AS k, s_nationkey AS g FROM supplier WHERE s_suppkey % 13 <> 0 GROUP BY s_nationkey),
p AS (SELECT g, radians(46.0 + k % 100 / 100.0) AS a, radians(7.0 + k % 70 / 100.0) AS b, k % 900 + 100.0 AS h FROM s), n AS (SELECT *, {A} / sqrt(1 - {E2!r} * sin(a)**2) AS nn FROM p)
SELECT 'P' || g AS gcp_id, round((nn + h) * cos(a) * cos(b), 2) AS x, round((nn + h) * cos(a) * sin(b), 2) AS y, round((nn * (1 - {E2!r}) + h) * sin(a), 2) AS z FROM n"""
)
def q_control_points(spark, sf_dir):
    """Control points of a file with comments and bad rows, its last line of each id, brought to Earth-centred metres."""
    k = F.col("s_suppkey")
    e, n = geodesy.utm_forward(46.0 + k % 100 / 100.0, 7.0 + k % 70 / 100.0, 32632)
    row = F.concat_ws(" , ", F.concat(F.lit("P"), F.col("s_nationkey").cast("string")), F.format_string("%.6f", e), F.format_string("%.6f", n), (k % 900 + 100).cast("string"))
    lines = _as_lines(table(spark, sf_dir, "supplier"), F.when(k % 13 == 0, F.lit("P1,not,a,number")).otherwise(row), "s_suppkey")
    head = spark.createDataFrame([("f", -2, "# a comment"), ("f", -1, "P99, 1, 2, 3")], "file string, line_no long, value string")
    p = text.control_points_ecef(text.control_rows(lines.unionByName(head)), 32632)
    return p.select("gcp_id", *[_r(c, 2).alias(c) for c in "xyz"])


@query("SELECT l_partkey::VARCHAR AS gcp_id, CASE WHEN l_linenumber % 2 = 0 THEN 'n' || l_partkey ELSE l_partkey::VARCHAR END AS gcp_name, l_orderkey::INT AS image_id, l_quantity AS u, l_tax AS v FROM lineitem WHERE l_linenumber <> 3")
def q_correspondences(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    name = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("n"), F.col("l_partkey").cast("string")))
    v = F.when(F.col("l_linenumber") == 3, F.lit("x")).otherwise(F.col("l_tax").cast("string"))
    return text.correspondences(l.select(F.col("l_partkey").cast("string").alias("gcp_id"), name.alias("gcp_name"), F.col("l_orderkey").cast("string").alias("image_id"), F.col("l_quantity").cast("string").alias("u"), v.alias("v")))


# -- validation --------------------------------------------------------------------

FOCAL, CENTRE, SIZE, LEVER, BORE = 1000.0, (500.0, 400.0), (560, 440), (0.5, -0.2, 0.3), (0.1, -0.2, 0.3)


def _zyx_sql(r: str, p: str, y: str) -> list[str]:
    """The nine elements of Rz Ry Rx of angle columns."""
    return [x.replace("(y)", f"({y})").replace("(p)", f"({p})").replace("(r)", f"({r})") for x in ZYX]


def _apply(m: list[str], v: tuple[str, str, str]) -> list[str]:
    return [" + ".join(f"({m[3 * i + j]}) * {v[j]}" for j in range(3)) for i in range(3)]


_BODY = _apply(_zyx_sql("ro", "pi", "ya"), ("n", "e", "d"))
_LEVERED = [f"{b} - ({x})" for b, x in zip(_BODY, LEVER, strict=True)]
_BORED = _apply(_zyx_sql(*[f"radians({b})" for b in BORE]), ("b0", "b1", "b2"))
VALIDATE = f"""g AS (SELECT p_partkey AS gid, radians(46.95 + p_partkey % 7 * 1e-4) AS a, radians(7.45 + p_partkey % 5 * 1e-4) AS b, 500.0 + p_partkey % 20 AS h FROM part WHERE p_size < 40),
gx AS (SELECT gid, (nn + h) * cos(a) * cos(b) AS x, (nn + h) * cos(a) * sin(b) AS y, (nn * (1 - {E2!r}) + h) * sin(a) AS z FROM (SELECT *, {A} / sqrt(1 - {E2!r} * sin(a)**2) AS nn FROM g)),
q AS (SELECT o_orderkey AS iid, radians(46.95 + o_orderkey % 11 * 1e-5) AS a, radians(7.45 + o_orderkey % 13 * 1e-5) AS b, 1500.0 + o_orderkey % 50 AS h, radians(CASE WHEN o_orderkey % 17 = 0 THEN 170 ELSE o_orderkey % 5 - 2 END) AS ro, radians(o_orderkey % 7 - 3) AS pi, radians(o_orderkey % 360) AS ya FROM orders WHERE o_orderstatus <> 'P'),
qx AS (SELECT *, (nn + h) * cos(a) * cos(b) AS px, (nn + h) * cos(a) * sin(b) AS py, (nn * (1 - {E2!r}) + h) * sin(a) AS pz FROM (SELECT *, {A} / sqrt(1 - {E2!r} * sin(a)**2) AS nn FROM q)),
o AS (SELECT l_partkey, l_orderkey, l_linenumber, 500 + l_quantity AS u, 400 - l_quantity AS v, gid, iid, x - px AS dx, y - py AS dy, z - pz AS dz, a, b, ro, pi, ya FROM lineitem LEFT JOIN gx ON l_partkey = gid LEFT JOIN qx ON l_orderkey = iid),
ned AS (SELECT *, -sin(a) * cos(b) * dx - sin(a) * sin(b) * dy + cos(a) * dz AS n, -sin(b) * dx + cos(b) * dy AS e, -cos(a) * cos(b) * dx - cos(a) * sin(b) * dy - sin(a) * dz AS d FROM o),
bod AS (SELECT *, {_LEVERED[0]} AS b0, {_LEVERED[1]} AS b1, {_LEVERED[2]} AS b2 FROM ned),
cam AS (SELECT *, {_BORED[1]} AS xc, -({_BORED[0]}) AS yc, {_BORED[2]} AS zc FROM bod),
prj AS (SELECT *, CASE WHEN zc > 0 THEN {FOCAL} * xc / zc + {CENTRE[0]} END AS pu, CASE WHEN zc > 0 THEN {FOCAL} * yc / zc + {CENTRE[1]} END AS pv FROM cam),
val AS (SELECT *, CASE WHEN gid IS NULL THEN 'no point' WHEN iid IS NULL THEN 'no pose' WHEN zc <= 0 THEN 'behind camera' WHEN NOT (pu >= 0 AND pu < {SIZE[0]} AND pv >= 0 AND pv < {SIZE[1]}) THEN 'outside image' END AS reason FROM prj),
res AS (SELECT *, CASE WHEN reason IS NULL THEN sqrt((pu - u)**2 + (pv - v)**2) END AS err FROM val)"""


def _validated(spark, sf_dir):
    k, o = F.col("p_partkey"), F.col("o_orderkey")
    ground = geodesy.geodetic_to_ecef(46.95 + k % 7 * 1e-4, 7.45 + k % 5 * 1e-4, 500.0 + k % 20, degrees=True)
    points = table(spark, sf_dir, "part").where("p_size < 40").select(k.alias("gcp_id"), *[c.alias(n) for c, n in zip(ground, "xyz", strict=True)])
    angles = {"roll": F.when(o % 17 == 0, 170).otherwise(o % 5 - 2), "pitch": o % 7 - 3, "yaw": o % 360}
    poses = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(o.alias("image_id"), (46.95 + o % 11 * 1e-5).alias("latitude"), (7.45 + o % 13 * 1e-5).alias("longitude"), (1500.0 + o % 50).alias("height"), *[c.alias(n) for n, c in angles.items()])
    seen = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("gcp_id"), F.col("l_orderkey").alias("image_id"), "l_linenumber", (500 + F.col("l_quantity")).alias("u"), (400 - F.col("l_quantity")).alias("v"))
    lens = {"fx": FOCAL, "fy": FOCAL, "cx": CENTRE[0], "cy": CENTRE[1], "width": SIZE[0], "height": SIZE[1]}
    return geometry.validate_control(seen, points, poses, lens, BORE, LEVER)


@query(f"WITH {VALIDATE} SELECT l_orderkey AS image_id, l_linenumber, l_partkey AS gcp_id, reason, reason IS NULL AS valid, round(coalesce(pu, 0), 4) + 0.0 AS projected_u, round(coalesce(pv, 0), 4) + 0.0 AS projected_v, round(err, 4) AS error, err IS NULL AS endless, round(sqrt(xc*xc + yc*yc + zc*zc), 3) AS distance FROM res")
def q_validate_gcp(spark, sf_dir):
    """Control points projected by the poses of their images: why some cannot be, and the others' errors."""
    r = geometry.with_sentinels(_validated(spark, sf_dir))
    endless = F.col("error") == float("inf")
    return r.select("image_id", "l_linenumber", "gcp_id", "reason", "valid", _r("projected_u", 4).alias("projected_u"), _r("projected_v", 4).alias("projected_v"), F.when(~endless, F.round("error", 4)).alias("error"), endless.alias("endless"), F.round("distance", 3).alias("distance"))


@query(
    f"""WITH {VALIDATE}, s AS (SELECT 'point' AS kind, l_partkey AS id, err FROM res WHERE reason IS NULL UNION ALL SELECT 'image', l_orderkey, err FROM res WHERE reason IS NULL UNION ALL SELECT 'all', 0, err FROM res WHERE reason IS NULL)
SELECT kind, id, count(*) AS n, round(avg(err), 4) AS mean_error, round(max(err), 4) AS max_error, round(sqrt(avg(err * err)), 4) AS rmse, CASE WHEN kind = 'all' THEN round(median(err), 4) END AS median_error, CASE WHEN kind = 'all' THEN round(count(*) FILTER (err <= 60.05)::DOUBLE / count(*), 6) END AS pass_rate FROM s GROUP BY kind, id"""
)
def q_validate_report(spark, sf_dir):
    """The report's statistics: of all, of each control point, of each image."""
    total, points, images = geometry.control_report(_validated(spark, sf_dir), 60.05)
    none = F.lit(None).cast("double")
    each = [p.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), "n", "mean_error", "max_error", "rmse", none.alias("median_error"), none.alias("pass_rate")) for kind, key, p in (("point", "gcp_id", points), ("image", "image_id", images))]
    whole = total.select(F.lit("all").alias("kind"), F.lit(0).cast("long").alias("id"), F.col("n_valid").alias("n"), "mean_error", "max_error", "rmse", "median_error", "pass_rate")
    out = each[0].unionByName(each[1]).unionByName(whole)
    return out.select("kind", "id", "n", *[F.round(c, 6 if c == "pass_rate" else 4).alias(c) for c in ("mean_error", "max_error", "rmse", "median_error", "pass_rate")])


# -- sensor models -----------------------------------------------------------------

SENSOR = camera.TableCamera(tuple(-16 + 0.5 * k for k in range(64)), (0.01, 0.002, 0.0005), 1762.0, 1760.0, 3.0, -2.0, 12)
_K = 1762.0 / 1760.0
TABLE_RAY = f"p AS (SELECT o_orderkey, (o_orderkey % 631) / 10.0 AS u FROM orders), q AS (SELECT *, -16 + 0.5 * u AS th FROM p), r AS (SELECT *, {_K!r} * tan(radians(th)) - 3.0 / 1760 AS x, -{_K!r} * tan(radians(0.01 + 0.002 * th + 0.0005 * th * th)) + 2.0 / 1760 AS y FROM q)"


@query(f"WITH {TABLE_RAY} SELECT o_orderkey, round(x, 9) + 0.0 AS x, round(y, 9) + 0.0 AS y, round(u, 6) + 0.0 AS u, round(u + 12, 6) AS sample, 0.01 AS residual, u > 0 AND u < 63 AS inside FROM r")
def q_table_camera(spark, sf_dir):
    """Rays of pixels with smile and flight correction, and back: pixel, sample, and the residual of a point that stands off along track."""
    u = F.col("o_orderkey") % 631 / 10.0
    x, y, _ = SENSOR.ray("u")
    r = table(spark, sf_dir, "orders").select("o_orderkey", u.alias("u")).select("o_orderkey", "u", x.alias("x"), y.alias("y"))
    p = [F.col("x") * 5, (F.col("y") + 0.01) * 5, F.lit(5.0)]
    r = core.staged(r, {"found": SENSOR.pixel(p), "residual": SENSOR.residual(p), "view": SENSOR.in_view(p)})
    inside = F.col("view") & (F.col("u") > 0) & (F.col("u") < 63)
    return r.select("o_orderkey", _r("x", 9).alias("x"), _r("y", 9).alias("y"), _r("found").alias("u"), F.round(SENSOR.sample("found"), 6).alias("sample"), F.round("residual", 9).alias("residual"), inside.alias("inside"))


LINE = camera.PolynomialCamera(1200.0, 640.0, 1280, (1.0, 2.0, -3.0, 0.5), (0.5, -1.0, 4.0), 7)


@query("WITH p AS (SELECT o_orderkey, (o_orderkey % 1280)::DOUBLE AS u FROM orders), q AS (SELECT *, (u - 640) / 1280 AS t FROM p) SELECT o_orderkey, round((u + 1 + 2*t - 3*t*t + 0.5*t*t*t - 640) / 1200, 9) + 0.0 AS x, round((0.5 - t + 4*t*t) / 1200, 9) + 0.0 AS y, round(u, 6) AS u, round(u + 7, 6) AS sample, 0.01 AS residual, u > 0 AND u < 1279 AS inside FROM q")
def q_poly_camera(spark, sf_dir):
    u = (F.col("o_orderkey") % 1280).cast("double")
    x, y, _ = LINE.ray("u")
    r = table(spark, sf_dir, "orders").select("o_orderkey", u.alias("u")).select("o_orderkey", "u", x.alias("x"), y.alias("y"))
    p = [F.col("x") * 3, (F.col("y") + 0.01) * 3, F.lit(3.0)]
    r = core.staged(r, {"found": LINE.pixel(p), "residual": LINE.residual(p), "view": LINE.in_view(p)})
    inside = F.col("view") & (F.col("u") > 0) & (F.col("u") < 1279)
    return r.select("o_orderkey", _r("x", 9).alias("x"), _r("y", 9).alias("y"), F.round("found", 6).alias("u"), F.round(LINE.sample("found"), 6).alias("sample"), F.round("residual", 9).alias("residual"), inside.alias("inside"))


@query("WITH p AS (SELECT o_orderkey, (o_orderkey % 64)::DOUBLE AS u, (-16 + 0.5 * (o_orderkey % 64))::DOUBLE AS c, (o_orderkey % 9) / 100 AS l FROM orders) SELECT o_orderkey, round(110 * tan(radians(c)) + 32 - u, 8) + 0.0 AS dx, round(110 * tan(radians(l)), 8) + 0.0 AS dy, round(c, 7) + 0.0 AS across, round(-l, 7) + 0.0 AS along, round(1000 * tan(radians(l / 3600)), 9) + 0.0 AS metres FROM p")
def q_table_distortion(spark, sf_dir):
    """Angles of a table as distortion of a pinhole, back again, and an error on the ground."""
    k = F.col("o_orderkey")
    p = table(spark, sf_dir, "orders").select("o_orderkey", (k % 64).cast("double").alias("u"), (-16 + 0.5 * (k % 64)).alias("c"), (k % 9 / 100.0).alias("l"))
    dx, dy = camera.angles_to_distortion("u", "c", "l", 110.0, 32.0)
    p = p.withColumns({"dx": dx, "dy": dy})
    across, along = camera.distortion_to_angles("u", "dx", "dy", 110.0, 32.0)
    return p.select("o_orderkey", _r("dx", 8).alias("dx"), _r("dy", 8).alias("dy"), _r(across, 7).alias("across"), _r(along, 7).alias("along"), _r(camera.ground_error("l", 1000.0), 9).alias("metres"))


@query(
    """WITH p AS (SELECT o_orderkey, o_orderkey % 101 / 100.0 - 0.5 AS x, o_orderkey % 83 / 100.0 - 0.4 AS y FROM orders), q AS (SELECT *, x*x + y*y AS r, tan(radians(20*x)) AS a, tan(radians(10*y)) AS b FROM p), s AS (SELECT *, a*a + b*b AS t FROM q)
SELECT o_orderkey, round(x*(1 - 0.1037*r + 0.0213*r*r) + 2*0.00117*x*y + 0.00223*(r + 2*x*x), 9) + 0.0 AS line, round(x*(1 - 0.1037*r + 0.0213*r*r) + 0.00117*(r + 2*x*x) + 2*0.00223*x*y, 9) + 0.0 AS sx, round(y*(1 - 0.1037*r + 0.0213*r*r) + 0.00223*(r + 2*y*y) + 2*0.00117*x*y, 9) + 0.0 AS sy,
round(1762*(a*(1 - 0.1037*t + 0.0213*t*t + 0.0031*t*t*t) + 2*0.00117*a*b + 0.00223*(t + 2*a*a)) + 640, 5) + 0.0 AS u, round(1762*(b*(1 - 0.1037*t + 0.0213*t*t + 0.0031*t*t*t) + 0.00117*(t + 2*b*b) + 2*0.00223*a*b) + 3, 5) + 0.0 AS v FROM s"""
)
def q_lens_models(spark, sf_dir):
    """Distortion of a line of pixels, with exchanged tangential terms, and of angles through the full model."""
    k = F.col("o_orderkey")
    p = table(spark, sf_dir, "orders").select("o_orderkey", (k % 101 / 100.0 - 0.5).alias("x"), (k % 83 / 100.0 - 0.4).alias("y"))
    x, y = F.col("x"), F.col("y")
    sx, sy = camera.distort_swapped(x, y, -0.1037, 0.0213, 0.00117, 0.00223)
    u, v = camera.project_angles(20 * x, 10 * y, 1762.0, 640.0, 3.0, (-0.1037, 0.0213, 0.0031, 0.00117, 0.00223))
    return p.select("o_orderkey", *_named({"line": camera.distort_line(x, y, -0.1037, 0.0213, 0.00117, 0.00223), "sx": sx, "sy": sy}, 9), *_named({"u": u, "v": v}, 5))


@query("WITH p AS (SELECT o_orderkey, (o_orderkey % 60 - 10)::DOUBLE AS x FROM orders), q AS (SELECT *, CASE WHEN x <= 10 THEN x / 2 WHEN x <= 20 THEN 5 + (x - 10) / 5 ELSE 7 - (x - 20) / 5 END AS y FROM p) SELECT o_orderkey, round(CASE WHEN x < 0 THEN 0 WHEN x > 40 THEN 3 ELSE y END::DOUBLE, 6) + 0.0 AS held, round(CASE WHEN x < 0 OR x > 40 THEN -1 ELSE y END::DOUBLE, 6) + 0.0 AS filled, round(y, 6) + 0.0 AS extended FROM q")
def q_interpolate(spark, sf_dir):
    """A short table of rising places: constant, marked and extended beyond its ends."""
    p = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 60 - 10.0).alias("x"))
    of = lambda outside: camera.interpolate("x", [0.0, 10.0, 20.0, 40.0], [0.0, 5.0, 7.0, 3.0], outside)
    return p.select("o_orderkey", *_named({"held": of("clamp"), "filled": of(-1.0), "extended": of("extrapolate")}))


_M = [f"({x})" for x in ZYX]
_MOUNTED = {"mount_first": [*_M[3:6], *[f"-{x}" for x in _M[:3]], *_M[6:]], "boresight_first": [x for i in range(3) for x in (f"-{_M[3 * i + 1]}", _M[3 * i], _M[3 * i + 2])]}


@query(f"WITH {ANGLES} SELECT event_id, " + ", ".join(f"round({x}, 9) + 0.0 AS {name[0]}{k // 3}{k % 3}" for name, m in _MOUNTED.items() for k, x in enumerate(m)) + ", round(r, 8) + 0.0 AS roll, round(p, 8) + 0.0 AS pitch, round(CASE WHEN y > pi() THEN y - 2 * pi() ELSE y END, 8) + 0.0 AS yaw FROM a")
def q_mount(spark, sf_dir):
    """Boresight and mounting matrix in both orders, and the boresight found again."""
    mount, out = rotation.body_to_camera(), {}
    for name in _MOUNTED:
        m = rotation.mounted("roll", "pitch", "yaw", mount, name)
        out |= {f"{name[0]}{i}{j}": m[i][j] for i in range(3) for j in range(3)}
    a = _angles(spark, sf_dir).select("event_id", *_named(out, 9), *[c.alias(f"x{k}") for k, c in enumerate(x for r in rotation.mounted("roll", "pitch", "yaw", mount, "boresight_first") for x in r)])
    found = rotation.boresight_of([[F.col(f"x{3 * i + j}") for j in range(3)] for i in range(3)], mount)
    return a.select("event_id", *out, *_named(dict(zip(("roll", "pitch", "yaw"), found, strict=True)), 8))


@query(f"WITH {ANGLES}, m AS (SELECT event_id, {ZYX[0]} AS m00, {ZYX[1]} AS m01, {ZYX[2]} AS m02, {ZYX[5]} AS m12, {ZYX[8]} AS m22 FROM a) SELECT event_id, round(degrees(atan2(m12, m22)), 7) + 0.0 AS omega, round(degrees(asin(m02)), 7) + 0.0 AS phi, round(-degrees(atan2(m00, -m01)), 7) + 0.0 AS kappa FROM m")
def q_opk(spark, sf_dir):
    o = rotation.rpy_to_opk_deg(F.col("roll"), F.col("pitch"), F.col("yaw"))
    return _angles(spark, sf_dir).select("event_id", *_named(dict(zip(("omega", "phi", "kappa"), o, strict=True)), 7))


_KJ = ("0", "-kz", "ky", "kz", "0", "-kx", "-ky", "kx", "0")


@query(
    "WITH v AS (SELECT o_orderkey, (o_orderkey % 11 - 5.0) / 10 AS a, (o_orderkey % 7 - 3.0) / 10 AS b, (o_orderkey % 5 - 2.0) / 10 AS c FROM orders), t AS (SELECT *, sqrt(a*a + b*b + c*c) AS th FROM v), k AS (SELECT *, CASE WHEN th > 0 THEN a / th ELSE 0 END AS kx, CASE WHEN th > 0 THEN b / th ELSE 0 END AS ky, CASE WHEN th > 0 THEN c / th ELSE 0 END AS kz FROM t) SELECT o_orderkey, "
    + ", ".join(f"round({'cos(th)' if k // 3 == k % 3 else '0'} + sin(th) * ({_KJ[k]}) + (1 - cos(th)) * k{'xyz'[k // 3]} * k{'xyz'[k % 3]}, 9) + 0.0 AS m{k // 3}{k % 3}" for k in range(9)) + " FROM k"
)
def q_axis_angle(spark, sf_dir):
    k = F.col("o_orderkey")
    v = table(spark, sf_dir, "orders").select("o_orderkey", ((k % 11 - 5.0) / 10).alias("a"), ((k % 7 - 3.0) / 10).alias("b"), ((k % 5 - 2.0) / 10).alias("c"))
    m = rotation.axis_angle_matrix(core.vec("a", "b", "c"))
    return v.select("o_orderkey", *_named({f"m{i}{j}": m[i][j] for i in range(3) for j in range(3)}, 9))


@query("SELECT o_orderkey, round(o_orderkey % 11 - 0.5, 6) + 0.0 AS less, round(o_orderkey % 11 + 0.5, 6) + 0.0 AS more FROM orders")
def q_lever_sign(spark, sf_dir):
    """The lever arm taken from the vector to the point, or added to it as some files were made."""
    one = rotation.rpy_matrix(0.0, 0.0, 0.0)
    p = core.vec(F.col("o_orderkey") % 11 + 0.0, 2.0, 3.0)
    at = lambda sign: camera.to_camera(p, core.vec(0.0, 0.0, 0.0), one, one, core.vec(0.5, 0.0, 0.0), sign)[0]
    return table(spark, sf_dir, "orders").select("o_orderkey", *_named({"less": at(-1), "more": at(1)}))


@query(
    """WITH e AS (SELECT s_suppkey::DOUBLE AS t, s_acctbal / 100 AS x, s_suppkey % 50 * 1.0 AS y, row_number() OVER (ORDER BY s_suppkey) AS n FROM supplier), f AS (SELECT * FROM e WHERE (n - 1) % greatest(1, (SELECT count(*) FROM e) // 5) = 0),
d AS (SELECT o_orderkey, t, n, (o_totalprice / 5000 - x)**2 + (o_custkey % 50 - y)**2 AS d FROM orders, f) SELECT o_orderkey, greatest((SELECT min(t) FROM e) + 0.5, least(arg_min(t, (d, n)), (SELECT max(t) FROM e) - 0.5)) AS near_time FROM d GROUP BY o_orderkey"""
)
def q_nearest_track(spark, sf_dir):
    """The nearest of every n-th place of a track, in two dimensions, kept a little within its ends."""
    e = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("double").alias("t"), (F.col("s_acctbal") / 100).alias("x"), (F.col("s_suppkey") % 50 * 1.0).alias("y"))
    p = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 5000).alias("x"), (F.col("o_custkey") % 50 * 1.0).alias("y"))
    return solve.nearest_epochs(p, e, ["x", "y"], "t", 5, inset=0.5).select("o_orderkey", "near_time")


# -- loaders, small variants -------------------------------------------------------


@query("SELECT 'sized' AS part, l_partkey::VARCHAR AS gcp_id, l_orderkey::INT AS image_id, round(l_quantity + 640, 6) AS u, round(512 - l_tax, 6) AS v, l_quantity AS u_photo FROM lineitem UNION ALL SELECT 'unknown', l_partkey::VARCHAR, l_orderkey::INT, l_quantity, round(l_tax, 6), l_quantity FROM lineitem")
def q_observations(spark, sf_dir):
    """Photo coordinates as pixels where the image's size is known, as they are where not."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("gcp_id"), F.col("l_linenumber").cast("string").alias("gcp_name"), F.col("l_orderkey").cast("int").alias("image_id"), F.col("l_quantity").alias("u"), F.col("l_tax").alias("v"))
    parts = [control.observations(l, "blocks", *size).select(F.lit(name).alias("part"), "gcp_id", "image_id", F.round("u", 6).alias("u"), F.round("v", 6).alias("v"), "u_photo") for name, size in (("sized", (1280, 1024)), ("unknown", (0, 0)))]
    return parts[0].unionByName(parts[1])


@query(
    """WITH e AS (SELECT s_suppkey::DOUBLE AS t, 46 + s_suppkey / 1000.0 AS lat, (s_suppkey * 50 % 360)::DOUBLE AS yaw FROM supplier), o AS (SELECT o_orderkey AS i, o_custkey * 1.3 - 3 AS t FROM orders),
b AS (SELECT i, o.t, e.t AS t1, e.lat AS lat1, e.yaw AS yaw1 FROM o ASOF LEFT JOIN e ON o.t <= e.t), c AS (SELECT b.*, e.t AS t0, e.lat AS lat0, e.yaw AS yaw0 FROM b ASOF LEFT JOIN e ON b.t > e.t)
SELECT i AS image_id, round(CASE WHEN t = t1 THEN lat1 ELSE lat0 + (lat1 - lat0) * (t - t0) / (t1 - t0) END, 9) AS latitude,
round(CASE WHEN t = t1 THEN yaw1 ELSE yaw0 + (CASE WHEN yaw1 - yaw0 > 180 THEN yaw1 - yaw0 - 360 WHEN yaw1 - yaw0 < -180 THEN yaw1 - yaw0 + 360 ELSE yaw1 - yaw0 END) * (t - t0) / (t1 - t0) END, 7) AS yaw
FROM c WHERE t1 IS NOT NULL AND (t = t1 OR t0 IS NOT NULL)"""
)
def q_poses(spark, sf_dir):
    """Poses of images at their times, in a flight without a key."""
    k = F.col("s_suppkey")
    zero = F.lit(0.0)
    e = table(spark, sf_dir, "supplier").select(k.cast("double").alias("time"), (46 + k / 1000.0).alias("latitude"), zero.alias("longitude"), zero.alias("height"), zero.alias("roll"), zero.alias("pitch"), (k * 50 % 360).cast("double").alias("yaw"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"), (F.col("o_custkey") * 1.3 - 3).alias("time"))
    return control.poses(e, o, width=7.0).select("image_id", F.round("latitude", 9).alias("latitude"), F.round("yaw", 7).alias("yaw"))


@query("SELECT o_custkey::INT AS image_id, arg_max(o_totalprice, o_orderkey) AS height FROM orders GROUP BY o_custkey")
def q_poses_direct(spark, sf_dir):
    """Poses given by image, the last row of each."""
    zero = F.lit(0.0)
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("int").alias("image_id"), F.col("o_orderkey").alias("line_no"), F.col("o_totalprice").alias("height"), *[zero.alias(c) for c in ("latitude", "longitude", "roll", "pitch", "yaw")])
    return control.poses(o).select("image_id", "height")


@query("SELECT p_partkey, trunc((p_size - min(p_size) OVER ()) / (max(p_size) OVER () - min(p_size) OVER ()) * 255)::INT AS p_size, trunc((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()) * 255)::INT AS p_retailprice FROM part")
def q_min_max(spark, sf_dir):
    return stats.min_max(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"])


@query("SELECT count(*) AS n, round(avg(c_custkey % 50 + 49.5), 6) AS mean_undulation, min(c_custkey % 50) + 49.5 AS min_undulation, max(c_custkey % 50) + 49.5 AS max_undulation FROM customer WHERE c_custkey % 7 <> 0")
def q_undulation(spark, sf_dir):
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(F.lit(100.0).alias("a"), F.when(k % 7 != 0, 149.5 + k % 50).alias("b"))
    return stats.undulation(c, "a", "b").withColumn("mean_undulation", F.round("mean_undulation", 6))


@query("SELECT x, y, round(49.5 + 1.5e-5 * (x - 2600000) + 2.0e-5 * (y - 1200000), 6) AS undulation FROM (SELECT least(2590000.0 + 4000 * unnest(range(6)), 2609000.0)::DOUBLE AS x) a, (SELECT least(1195000.0 + 4000 * unnest(range(4)), 1206000.0)::DOUBLE AS y) b")
def q_undulation_grid(spark, sf_dir):
    return raster.undulation_grid(spark, 2590000.0, 1195000.0, 2609000.0, 1206000.0, 4000.0).withColumn("undulation", F.round("undulation", 6))


@query("SELECT user_id, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY user_id")
def q_grouped_index(spark, sf_dir):
    g = stats.grouped_index(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", ["event_id"])
    return g.select("user_id", F.size("rows").cast("long").alias("n"), F.col("rows")[0]["event_id"].alias("first"), F.element_at("rows", -1)["event_id"].alias("last"))


@query("SELECT coalesce(avg(p_retailprice) FILTER (p_partkey % 97 <> 0), 0) IS NOT NULL AS any, round(coalesce(avg(p_retailprice) FILTER (p_partkey % 97 <> 0), 0), 4) AS elevation FROM part")
def q_swath_elevation(spark, sf_dir):
    """Mean of the surface along the track, cells without a value left out."""
    p = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 97 != 0, F.col("p_retailprice")).otherwise(float("nan")).alias("z"))
    return select.swath_elevation(p, "z").select(F.lit(True).alias("any"), F.round("elevation", 4).alias("elevation"))


# -- rotations, rays and frames ----------------------------------------------------

#: Elements of the other conventions, multiplied out by hand.
R1R2R3 = ('cos(p)*cos(y)', '-cos(p)*sin(y)', 'sin(p)', 'cos(r)*sin(y) + sin(r)*sin(p)*cos(y)', 'cos(r)*cos(y) - sin(r)*sin(p)*sin(y)', '-sin(r)*cos(p)', 'sin(r)*sin(y) - cos(r)*sin(p)*cos(y)', 'sin(r)*cos(y) + cos(r)*sin(p)*sin(y)', 'cos(r)*cos(p)')
PASSIVE = ('cos(p)*cos(y)', 'cos(p)*sin(y)', '-sin(p)', 'sin(r)*sin(p)*cos(y) - cos(r)*sin(y)', 'sin(r)*sin(p)*sin(y) + cos(r)*cos(y)', 'sin(r)*cos(p)', 'cos(r)*sin(p)*cos(y) + sin(r)*sin(y)', 'cos(r)*sin(p)*sin(y) - sin(r)*cos(y)', 'cos(r)*cos(p)')


@query(f"WITH {ANGLES} SELECT event_id, " + ", ".join(f"round({m[k]}, 9) + 0.0 AS {n}{k // 3}{k % 3}" for n, m in (("a", R1R2R3), ("b", PASSIVE)) for k in range(9)) + ", " + ", ".join(f"round({ZYX[3 * (k % 3) + k // 3]}, 9) + 0.0 AS t{k // 3}{k % 3}" for k in range(9)) + " FROM a")
def q_conventions(spark, sf_dir):
    """The same angles in three more conventions."""
    out = {}
    for n, c in (("a", "r1r2r3"), ("b", "passive"), ("t", "ned2body")):
        m = rotation.rpy_matrix("roll", "pitch", "yaw", c)
        out |= {f"{n}{i}{j}": m[i][j] for i in range(3) for j in range(3)}
    return _angles(spark, sf_dir).select("event_id", *_named(out, 9))


_TURN = [f"({x})" for x in ZYX]


@query(
    f"""WITH {ANGLES}, v AS (SELECT *, event_id % 7 - 3.0 AS vx, event_id % 5 - 2.0 AS vy, event_id % 11 + 1.0 AS vz FROM a), w AS (SELECT event_id, {", ".join(f"{' + '.join(f'{_TURN[3 * i + j]} * {c}' for j, c in enumerate(('vx', 'vy', 'vz')))} AS r{i}" for i in range(3))}, vx, vy, vz FROM v)
SELECT event_id, {", ".join(f"round(r{i} + {t}, 7) + 0.0 AS f{i}" for i, t in enumerate((10, 20, 30)))}, round(vx, 7) + 0.0 AS b0, round(vy, 7) + 0.0 AS b1, round(vz, 7) + 0.0 AS b2, round(2 * vz - 3 * vy, 7) + 0.0 AS s0, round(3 * vx - vz, 7) + 0.0 AS s1, round(vy - 2 * vx, 7) + 0.0 AS s2 FROM w"""
)
def q_rigid(spark, sf_dir):
    """A rigid motion and its inverse, and a cross product by the skew matrix and its transpose."""
    m, t = rotation.rpy_matrix("roll", "pitch", "yaw"), core.vec(10.0, 20.0, 30.0)
    k = F.col("event_id")
    a = _angles(spark, sf_dir).withColumns({"vx": k % 7 - 3.0, "vy": k % 5 - 2.0, "vz": k % 11 + 1.0})
    v = core.vec("vx", "vy", "vz")
    there = camera.rigid(m, t, v)
    a = core.staged(a, {f"g{i}": c for i, c in enumerate(there)})
    back = camera.rigid_inverse(m, t, core.vec("g0", "g1", "g2"))
    turned = core.matvec(rotation.skew(core.vec(1.0, 2.0, 3.0)), v)
    other = core.matvec(rotation.skew_transposed(core.vec(1.0, 2.0, 3.0)), v)
    crossed = [(x - y) / 2 for x, y in zip(turned, other, strict=True)]
    return a.select("event_id", *_named({f"{n}{i}": c for n, cs in (("f", core.vec("g0", "g1", "g2")), ("b", back), ("s", crossed)) for i, c in enumerate(cs)}, 7))


@query(
    f"""WITH {ANGLES}, v AS (SELECT *, (event_id % 640 - 320) / 1000 AS gx, (event_id % 480 - 240) / 1000 AS gy FROM a), n AS (SELECT *, sqrt(gx * gx + gy * gy + 1) AS l FROM v)
SELECT event_id, {", ".join(f"round(({_TURN[3 * i]} * gx + {_TURN[3 * i + 1]} * gy + {_TURN[3 * i + 2]}) / l, 8) + 0.0 AS d{i}" for i in range(3))}, {", ".join(f"round({t} + {' + '.join(f'{_TURN[3 * i + j]} * {a}' for j, a in enumerate((0.5, -0.2, 0.3)))}, 7) + 0.0 AS p{i}" for i, t in enumerate((100, 200, 300)))},
round(1000 / (event_id % 9 + 1), 7) AS j00, round(-1000 * gx / (event_id % 9 + 1), 7) + 0.0 AS j02, round(-1000 * gy / (event_id % 9 + 1), 7) + 0.0 AS j12 FROM n"""
)
def q_pixel_ray(spark, sf_dir):
    """Rays of pixels in the world, the camera's place with its lever arm, and how a projection changes with its point."""
    m, k = rotation.rpy_matrix("roll", "pitch", "yaw"), F.col("event_id")
    a = _angles(spark, sf_dir)
    d = camera.pixel_ray_world(k % 640, k % 480, 1000.0, 320.0, 240.0, m)
    p = camera.camera_position(core.vec(100.0, 200.0, 300.0), m, core.vec(0.5, -0.2, 0.3))
    z = k % 9 + 1.0
    j = camera.projection_jacobian([(k % 640 - 320) / 1000 * z, (k % 480 - 240) / 1000 * z, z], 1000.0, 1000.0)
    return a.select("event_id", *_named({f"d{i}": c for i, c in enumerate(d)}, 8), *_named({f"p{i}": c for i, c in enumerate(p)} | {"j00": j[0][0], "j02": j[0][2], "j12": j[1][2]}, 7))


@query("SELECT c_custkey, e BETWEEN 2485000 AND 2834000 AND n BETWEEN 1075000 AND 1296000 AS inside, zone * 6 - 183.0 AS meridian FROM (SELECT c_custkey, 2480000 + c_custkey * 7919 % 360000 AS e, 1070000 + c_custkey * 6007 % 230000 AS n, 32 AS zone FROM customer)")
def q_within_swiss(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", geodesy.within_swiss(2_480_000 + k * 7919 % 360_000, 1_070_000 + k * 6007 % 230_000).alias("inside"), F.lit(geodesy.utm_central_meridian(32632)).alias("meridian"))


# -- more lookups and solvers --------------------------------------------------------


@query(
    """WITH z AS (SELECT (p_partkey - 1) // 40 AS r, (p_partkey - 1) % 40 AS c, p_retailprice AS z FROM part), n AS (SELECT count(*) // 40 AS n FROM part), t AS (SELECT unnest(range(20)) AS i), u AS (SELECT unnest(range(30)) AS j),
p AS (SELECT i, j, i * 0.25 + 0.125 AS y, j * 1.25 + 0.5 AS x FROM t, u), b AS (SELECT *, floor(y)::BIGINT AS br, floor(x)::BIGINT AS bc FROM p, n WHERE floor(y) <= n - 2 AND floor(x) <= 38),
s AS (SELECT i, j, sum(z.z * (CASE a WHEN 1 THEN y - br ELSE 1 - y + br END) * (CASE e WHEN 1 THEN x - bc ELSE 1 - x + bc END)) AS z, count(*) AS k FROM b, (VALUES (0), (1)) q(a), (VALUES (0), (1)) w(e), z WHERE z.r = br + a AND z.c = bc + e GROUP BY i, j)
SELECT p.i AS row, p.j AS col, round(CASE WHEN k = 4 THEN s.z END, 5) AS z FROM p LEFT JOIN s USING (i, j)"""
)
def q_resample(spark, sf_dir):
    """A raster brought to another grid by inverse mapping."""
    part = table(spark, sf_dir, "part")
    cells = part.select(F.expr("(p_partkey - 1) div 40").alias("row"), ((F.col("p_partkey") - 1) % 40).alias("col"), F.col("p_retailprice").alias("z"))
    grid = raster.Grid(100.0, 500.0, 2.0, part.count() // 40, 40)
    target = spark.range(600).select(F.expr("id div 30").alias("row"), (F.col("id") % 30).alias("col"))
    return raster.resample(target, cells, grid, 101.0 + F.col("col") * 2.5, 499.75 - F.col("row") * 0.5).select("row", "col", F.round("z", 5).alias("z"))


@query("WITH r AS (SELECT unnest(range(6)) AS r), c AS (SELECT unnest(range(10)) AS c) SELECT r AS row, c AS col, 7.0 AS b0, 9.0 AS b1 FROM r, c")
def q_ortho(spark, sf_dir):
    """A flat surface below a straight flight and an image of one colour: every output cell gets it."""
    from .geometry_catalog import straight_flight

    tr = straight_flight()
    out = raster.output_grid(spark, 7.445, 46.9497, 7.4455, 46.95, 0.00005, 4)
    g = raster.Grid(7.44, 46.951, 0.0005, 6, 30)
    surface = spark.range(180).select(F.expr("id div 30").alias("row"), (F.col("id") % 30).alias("col"), F.lit(500.0).alias("z"))
    cube = spark.range(500 * 16).select(F.expr("id div 16").alias("line"), (F.col("id") % 16).alias("sample"), F.array(F.lit(7.0), F.lit(9.0)).alias("spectrum"))
    to = lambda x, y, z: geodesy.geodetic_to_ecef(y, x, z, degrees=True)

    def back(x, y, z):
        lat, lon, h = geodesy.ecef_to_geodetic(x, y, z)
        return [F.degrees(lon), F.degrees(lat), h]

    o = geometry.ortho(out, surface, g, to, tr, solve.MOUNT, tr.t, [-10 + 20 * k / 15 for k in range(16)], cube, 500, 16, from_ecef=back)
    return o.select("row", "col", F.round(F.col("spectrum")[0], 6).alias("b0"), F.round(F.col("spectrum")[1], 6).alias("b1"))


@query("WITH p AS (SELECT o_orderkey, (o_orderkey % 1000) / 100 - 1 AS t FROM orders) SELECT o_orderkey, round(t**3 - 2 * t, 6) + 0.0 AS a, round(5 - t * t, 6) + 0.0 AS b FROM p")
def q_spline(spark, sf_dir):
    """A not-a-knot spline is the cubic that its knots lie on, beyond the ends, too."""
    k = (F.col("s_suppkey") % 10).cast("double")
    knots = table(spark, sf_dir, "supplier").select(k.alias("t")).distinct().select("t", (F.pow("t", 3.0) - 2 * F.col("t")).alias("a"), (5 - F.col("t") * F.col("t")).alias("b"))
    p = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 1000 / 100 - 1).alias("t"))
    return solve.spline_positions(p, knots, "t", ["a", "b"]).select("o_orderkey", _r("s_a").alias("a"), _r("s_b").alias("b"))


@query("WITH m AS (SELECT count(*) AS n, avg(l_discount) AS c, avg(CASE WHEN l_quantity <= 40 THEN 1.0 ELSE 0 END) AS r, avg(l_quantity) AS e FROM lineitem) SELECT n AS matches, round(c, 6) AS mean_confidence, round(r, 6) AS inlier_ratio, round(e, 6) AS mean_error FROM m")
def q_match_metrics(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") <= 40).alias("ok"), F.col("l_quantity").alias("e"), F.col("l_discount").alias("c"))
    m = geometry.match_metrics(l, "ok", "e", "c")
    return m.select("matches", *[F.round(c, 6).alias(c) for c in ("mean_confidence", "inlier_ratio", "mean_error")])


@query(
    """WITH n AS (SELECT DISTINCT p_brand, p_brand LIKE '%1%' AS c FROM part), i AS (SELECT p_brand, row_number() OVER (PARTITION BY c ORDER BY p_brand) + CASE WHEN c THEN 0 ELSE 999 END AS id FROM n),
r AS (SELECT id, p_brand, p_partkey, p_size, row_number() OVER (PARTITION BY id ORDER BY p_retailprice, p_partkey) AS k FROM part JOIN i USING (p_brand)),
t AS (SELECT id, 0 AS k, id || ' ' || p_brand AS value FROM i UNION ALL SELECT id, k, p_partkey || ' ' || format('{:.4f}', p_size::DOUBLE) || ' 0.0000' FROM r UNION ALL SELECT id, count(*) + 1, '-99' FROM r GROUP BY id)
SELECT id AS point_id, k, value FROM t"""
)
def q_observation_blocks(spark, sf_dir):
    """Tie points as a block file: numbered points, their rows by time, the end mark."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    b = geometry.observation_blocks(p, "p_brand", ["p_retailprice", "p_partkey"], F.col("p_brand").contains("1"), "p_size", frame="p_partkey")
    return b.select(F.col("point_id").cast("long").alias("point_id"), F.col("k").cast("long").alias("k"), "value")
