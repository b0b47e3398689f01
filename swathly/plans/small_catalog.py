"""Catalogue, third part: the small projections, summaries and samples."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import camera, core, geodesy
from ..operators import select, sequence, stats
from ..session import table
from .catalog import epoch, micros, query


def _r(c, digits: int = 6):
    return F.round(c, digits) + F.lit(0.0)


@query("SELECT event_id, round(epoch_us(ts) / 1e6 - floor(epoch_us(ts) / 1e6 / 86400) * 86400, 4) AS tod, round_even(value * 1e5, 0)::BIGINT AS tick, round_even(radians(value), 6) + 0.0 AS rad FROM events")
def q_units(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.round(select.time_of_day(epoch()), 4).alias("tod"), select.ticks(F.col("value")).alias("tick"), (select.gyro_radians(F.col("value")) + F.lit(0.0)).alias("rad"))


@query("WITH h AS (SELECT event_id, (event_id % 628) / 100.0 AS p, (event_id % 113) / 50.0 AS w FROM events) SELECT event_id, round(p + w - floor((p + w) / (2 * pi())) * 2 * pi(), 8) AS plus, round(p - w, 8) + 0.0 AS minus FROM h")
def q_true_heading(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 628 / 100.0).alias("p"), (F.col("event_id") % 113 / 50.0).alias("w"))
    return e.select("event_id", _r(geodesy.earth_rate_heading("p", "w"), 8).alias("plus"), _r(geodesy.earth_rate_heading("p", "w", "minus"), 8).alias("minus"))


PPS = """h AS (SELECT l_orderkey, l_linenumber, l_partkey AS g, l_partkey + CASE l_linenumber % 6 WHEN 0 THEN 10100 WHEN 1 THEN 10270 WHEN 2 THEN 10000 WHEN 3 THEN 200 WHEN 4 THEN -30 ELSE 5000 END AS nav,
l_suppkey AS pps, l_suppkey + CASE l_orderkey % 5 WHEN 0 THEN 1000 WHEN 1 THEN 2699 WHEN 2 THEN 2700 WHEN 3 THEN 0 ELSE -5 END AS tele FROM lineitem), d AS (SELECT *, (nav - g) / 1e4 AS a, (tele - pps) / 1e5 AS b FROM h)"""


@query(
    f"WITH {PPS} SELECT l_orderkey, l_linenumber, CASE WHEN (a > 1 AND a < 1.027) AND (b > 0 AND b < 0.027) THEN g + 1 WHEN (a < 1 AND a < 0.027) AND (b > 0 AND b < 0.027) THEN g + 1 ELSE g END AS pps, g * 10 + (nav - 7) AS tick, (nav & 65535) << 16 | ((nav >> 16) & 65535) AS swapped FROM d"
)
def q_pps(spark, sf_dir):
    """Pulses brought up to date: the navigation time a little over a second ahead, or hardly at all, and the telegram shortly after the pulse."""
    n, o, g, p = (F.col(c) for c in ("l_linenumber", "l_orderkey", "l_partkey", "l_suppkey"))
    nav = g + F.when(n % 6 == 0, 10100).when(n % 6 == 1, 10270).when(n % 6 == 2, 10000).when(n % 6 == 3, 200).when(n % 6 == 4, -30).otherwise(5000)
    tele = p + F.when(o % 5 == 0, 1000).when(o % 5 == 1, 2699).when(o % 5 == 2, 2700).when(o % 5 == 3, 0).otherwise(-5)
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", g.alias("g"), nav.alias("nav"), tele.alias("tele"), p.alias("p"))
    pps = select.corrected_pps(F.col("g"), F.col("nav"), F.col("tele"), F.col("p"))
    return l.select("l_orderkey", "l_linenumber", pps.alias("pps"), select.line_time(F.col("g"), F.col("nav"), F.lit(7)).alias("tick"), select.swap_words(F.col("nav")).alias("swapped"))


@query("SELECT l_orderkey, l_linenumber, l_partkey < 1000 AS is_control, first_value(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) < 1000 AS block_control FROM lineitem")
def q_control_split(spark, sf_dir):
    l = select.control_or_tie(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_partkey").withColumnRenamed("is_control", "own")
    return select.block_is_control(l, "l_orderkey", ["l_linenumber", "l_partkey"], "l_partkey").select("l_orderkey", "l_linenumber", F.col("own").alias("is_control"), F.col("is_control").alias("block_control"))


@query("WITH k AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS b FROM orders WHERE o_totalprice > 1000) SELECT o_custkey, o_orderkey FROM k WHERE a > 1 AND b > 1")
def q_trim_edges(spark, sf_dir):
    return select.trim_edges(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), F.col("o_totalprice") > 1000, ["o_orderkey"], ["o_custkey"]).select("o_custkey", "o_orderkey")


@query("SELECT 'none' AS part, round(coalesce(min(value), 0), 6) AS first, round(coalesce(max(value), 0), 6) AS last FROM events WHERE event_type = 'none of these' UNION ALL SELECT 'all', round(min(value), 6), round(max(value), 6) FROM events")
def q_time_range(spark, sf_dir):
    """Of a series, and of an empty one."""
    e = table(spark, sf_dir, "events")
    parts = [select.time_range(df, "value").select(F.lit(name).alias("part"), F.round("first", 6).alias("first"), F.round("last", 6).alias("last")) for name, df in (("none", e.where("event_type = 'none of these'")), ("all", e))]
    return parts[0].unionByName(parts[1])


@query("SELECT count(DISTINCT user_id) AS n_user_id, count(DISTINCT event_type) AS n_event_type FROM events")
def q_distinct_counts(spark, sf_dir):
    return select.distinct_counts(table(spark, sf_dir, "events"), ["user_id", "event_type"])


@query("SELECT count(*) AS tiles, count(m) AS with_data, round(avg(m), 6) AS mean_of_means, round(stddev_pop(m), 6) AS std_of_means FROM (SELECT p_brand, avg(CASE WHEN p_size > 10 THEN p_retailprice END) AS m FROM part GROUP BY p_brand)")
def q_tile_summary(spark, sf_dir):
    s = select.tile_summary(table(spark, sf_dir, "part").select("p_brand", F.when(F.col("p_size") > 10, F.col("p_retailprice")).alias("v")), "p_brand", "v")
    return s.select("tiles", "with_data", *[F.round(c, 6).alias(c) for c in ("mean_of_means", "std_of_means")])


@query("WITH l AS (SELECT vec_id, i - 1 AS band, embedding[i]::DOUBLE AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i)), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(v) DESC, band) AS n FROM l) SELECT DISTINCT band FROM r WHERE n <= 1 OR band < 4")
def q_top_bands(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("band", "v")).select("vec_id", F.col("band").cast("long").alias("band"), F.col("v").cast("double").alias("v"))
    return select.top_bands(e, "vec_id", "band", "v", n=1)


@query("SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY md5('42|' || event_type || '|' || event_id), event_id) AS n FROM events) WHERE n <= 20")
def q_sample(spark, sf_dir):
    return select.sample_per_key(table(spark, sf_dir, "events").select("event_type", "event_id"), ["event_type"], 20)


@query(f"SELECT round((avg(c_acctbal) - 500) * tan({0.0005}) * 2, 9) + 0.0 AS gsd FROM customer")
def q_gsd(spark, sf_dir):
    return select.optimal_gsd(table(spark, sf_dir, "customer"), "c_acctbal", 500.0, 0.001).select(_r("gsd", 9).alias("gsd"))


@query("SELECT l_orderkey, l_linenumber, p_size, round(o_totalprice, 2) AS o_totalprice FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey")
def q_gather(spark, sf_dir):
    ties = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    cameras = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    points = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    return select.cameras_and_points(ties, cameras, points, "l_partkey", "l_orderkey").select("l_orderkey", "l_linenumber", "p_size", F.round("o_totalprice", 2).alias("o_totalprice"))


@query("SELECT s_suppkey, ray, round(s_suppkey + rx * ((500.0 - 1500.0) / -1.0), 6) AS gx FROM supplier, (VALUES ('left', -0.3), ('centre', 0.0), ('right', 0.3)) r(ray, rx)")
def q_footprint(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_suppkey").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(1500.0).alias("z"), F.lit(-0.3).alias("l"), F.lit(0.0).alias("c"), F.lit(0.3).alias("r"), F.lit(-1.0).alias("d"))
    return select.footprint(s, ("x", "y", "z"), {"left": ("l", "c", "d"), "centre": ("c", "c", "d"), "right": ("r", "c", "d")}, 500.0).select("s_suppkey", "ray", F.round("gx", 6).alias("gx"))


@query("SELECT user_id, arg_max(event_id, event_id) AS event_id FROM events GROUP BY user_id")
def q_keep_last(spark, sf_dir):
    return select.keep_last(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id")


@query("SELECT event_type, round(avg(value / tan(0.3)), 6) AS focal FROM events GROUP BY event_type")
def q_mean_focal(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("theta", F.lit(0.3))
    return stats.mean_focal(e, "value", "theta", 0.0, ["event_type"]).select("event_type", F.round("focal", 6).alias("focal"))


@query("SELECT o_orderkey, round(o_orderkey % 101 / 50.0, 6) AS x, round(degrees(atan2(o_orderkey % 101 - 50, 1200.0)), 8) + 0.0 AS theta FROM orders")
def q_pixel_angle(spark, sf_dir):
    u = F.col("o_orderkey") % 101
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(camera.focal_pixels(u, 50.0), 6).alias("x"), _r(F.degrees(camera.pixel_angle(u, 1200.0, 50.0)), 8).alias("theta"))


@query("SELECT o_orderkey, round(0.5::DOUBLE * (o_orderkey % 7) - 1.25::DOUBLE * (o_orderkey % 5), 6) + 0.0 AS d, round(sqrt((o_orderkey % 7)**2 + (o_orderkey % 5)**2 + 1), 9) AS n FROM orders")
def q_vectors(spark, sf_dir):
    k = F.col("o_orderkey")
    v = core.vec((k % 7).cast("double"), (k % 5).cast("double"), 1.0)
    return table(spark, sf_dir, "orders").select("o_orderkey", _r(core.dot(v, core.vec(0.5, -1.25, 0.0))).alias("d"), F.round(core.norm(v), 9).alias("n"))


@query(f"WITH p AS (SELECT c_custkey, 46 + c_custkey % 150 / 100.0 AS lat, 6.5 + c_custkey % 350 / 100.0 AS lon FROM customer) SELECT c_custkey, round(radians(lon) * {geodesy.WGS84_A}, 3) AS x, round(ln(tan({math.pi / 4} + radians(lat) / 2)) * {geodesy.WGS84_A}, 3) AS y FROM p")
def q_web_mercator(spark, sf_dir):
    p = table(spark, sf_dir, "customer").select("c_custkey", (46 + F.col("c_custkey") % 150 / 100.0).alias("lat"), (6.5 + F.col("c_custkey") % 350 / 100.0).alias("lon"))
    x, y = geodesy.web_mercator("lat", "lon")
    return p.select("c_custkey", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query("SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS delta FROM events")
def q_delta(spark, sf_dir):
    return sequence.delta(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], micros()).select("event_id", "delta")
