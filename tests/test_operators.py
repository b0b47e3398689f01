import numpy as np
import pytest
from pyspark.sql import functions as F

from swathly.operators import asof, geometry, raster, scale, select, sequence, solve, stats
from swathly.sources import binary, text


def test_interpolation_edges(spark):
    right = spark.createDataFrame([("a", 0.0, 350.0), ("a", 1.0, 10.0), ("a", 2.0, 30.0)], "k string, t double, yaw double")
    left = spark.createDataFrame([("a", x) for x in (-1.0, 0.0, 0.5, 0.25, 2.0, 3.0)], "k string, t double")
    got = {r.t: r.i_yaw for r in asof.interpolate(left, right, ["k"], "t", ["yaw"], ("yaw",)).collect()}
    assert got == {-1.0: None, 0.0: 350.0, 0.25: 355.0, 0.5: 360.0, 2.0: 30.0, 3.0: None}


def test_nearest_ties_and_empty_side(spark):
    right = spark.createDataFrame([("a", 0.0, 1), ("a", 2.0, 2)], "k string, t double, v int")
    left = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "k string, t double")
    assert {r.k: r.r_v for r in asof.nearest(left, right, ["k"], "t", ["v"]).collect()} == {"a": 1, "b": None}


def test_bilinear_reproduces_a_plane(spark):
    cells = spark.createDataFrame([(r, c, 2.0 * r - 3.0 * c) for r in range(6) for c in range(6)], "row long, col long, z double")
    pts = spark.createDataFrame([(1, 1.25, 3.5), (2, 0.0, 4.999), (3, 5.0, 1.0), (4, -0.1, 1.0)], "i int, r double, c double")
    got = {r.i: r.z for r in raster.bilinear(pts, cells, "i", "r", "c", 6, 6).collect()}
    assert got[1] == pytest.approx(2 * 1.25 - 3 * 3.5) and got[2] == pytest.approx(-3 * 4.999) and got[3] is None and got[4] is None


def test_step_hides_what_is_behind_it(spark):
    g = raster.Grid(0.0, 10.0, 1.0, 10, 10)
    cells = spark.createDataFrame([(r, c, 100.0 if c == 5 else 0.0) for r in range(10) for c in range(10)], "row long, col long, z double")
    rays = spark.createDataFrame([(1, 1.0, 5.0, 10.0, 8.0, 5.0, 10.0), (2, 1.0, 5.0, 10.0, 3.0, 5.0, 10.0)], "i int, a double, b double, c double, d double, e double, f double")
    got = {r.i: r.occluded for r in raster.occluded(rays, cells, "i", ("a", "b", "c"), ("d", "e", "f"), g).collect()}
    assert got == {1: True, 2: False}


def test_parallel_rays_are_null(spark):
    rays = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0), (1, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0)], "k int, a double, b double, c double, d double, e double, f double")
    assert geometry.triangulate(rays, "k", ("a", "b", "c"), ("d", "e", "f")).first().x is None


def test_boresight_recovers_angles(spark):
    rng = np.random.default_rng(3)
    want = np.array([0.01, -0.02, 0.015])
    r = geometry._r123(want)[0]
    rows = []
    for _ in range(60):
        ri, rj = (geometry._r123(rng.normal(0, 0.5, 3))[0] for _ in range(2))
        p, pi, pj = rng.normal(0, 100, 3), rng.normal(0, 10, 3), rng.normal(0, 10, 3)
        rows.append([x.tolist() for x in (ri.reshape(-1), rj.reshape(-1), pi, pj, r.T @ ri.T @ (p - pi), r.T @ rj.T @ (p - pj))])
    df = spark.createDataFrame(rows, "ri array<double>, rj array<double>, pi array<double>, pj array<double>, ui array<double>, uj array<double>")
    got, cov, factor = geometry.boresight(df, prior_sigma=10.0)
    assert np.allclose(got, want, atol=1e-6) and cov.shape == (3, 3)


def test_covariance_and_components(spark):
    x = np.random.default_rng(1).normal(size=(300, 5)) @ np.diag([5, 3, 1, 0.1, 0.01])
    df = spark.createDataFrame([(v.tolist(),) for v in x], "s array<double>")
    n, mean, cov = stats.moments(df, "s", 5)
    assert n == 300 and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T))
    values, vectors, k = stats.components(cov, 0.95)
    assert np.all(np.diff(values) <= 0) and k <= 3
    s = stats.scores(df, "s", mean, vectors, 2).select("scores").first().scores
    assert np.allclose(s, ((x[0] - mean) @ vectors)[:2])


def test_polynomial_and_lm(spark):
    df = spark.createDataFrame([(v, 1 + 2.0 * v - 0.5 * v**3) for v in np.linspace(-2, 2, 40).tolist()], "x double, y double")
    assert np.allclose(stats.polynomial_fit(df, "y", "x", 3), [1, 2, 0, -0.5], atol=1e-8)
    t = np.linspace(-0.3, 0.3, 50)
    p, rmse = stats.levenberg_marquardt(lambda q: q[0] * np.tan(t) + q[1] - (800 * np.tan(t) + 320), np.array([500.0, 0.0]))
    assert np.allclose(p, [800, 320], atol=1e-4) and rmse < 1e-6


def test_nav_source(spark, tmp_path):
    n = 1000
    x = np.zeros((n, 17))
    x[:, 0], x[:, 9], x[:, 10] = np.arange(n) * 0.005, 6.0, 1.0
    f = tmp_path / "flight.out"
    f.write_bytes(x.astype("<f8").tobytes())
    binary.register(spark)
    df = spark.read.format("nav").option("records", 300).load(str(f))
    assert df.count() == n and df.where("time > 1.0 and time <= 2.0").count() == 200
    assert df.first().true_heading == pytest.approx(7.0 - 2 * np.pi)
    assert spark.read.format("nav").option("every", 10).load(str(f)).agg(F.min("time")).first()[0] == pytest.approx(9 * 0.005)
    (tmp_path / "bad.out").write_bytes(b"x" * 137)
    with pytest.raises(Exception, match="136"):
        spark.read.format("nav").load(str(tmp_path / "bad.out")).count()


def test_frame_headers_and_pps(spark, tmp_path):
    raw = np.zeros((10, 400), np.uint8)
    for i in range(10):
        raw[i, 0:4] = np.frombuffer(np.uint32(1000 + i).tobytes(), np.uint8)
        raw[i, 116:120] = np.frombuffer(np.array([70000 + i], ">u4").tobytes(), np.uint8)
        raw[i, 164:168] = np.frombuffer(np.array([1, 2 + i], "<u2").tobytes(), np.uint8)
    for i in (2, 8):
        raw[i, 80:82] = np.frombuffer(np.uint16(0xBABE).tobytes(), np.uint8)
    f = tmp_path / "frames.raw"
    f.write_bytes(raw.tobytes())
    binary.register(spark)
    df = spark.read.format("frames").option("line_bytes", 400).option("lines", 4).load(str(f))
    r = df.orderBy("line_id").collect()
    assert [x.internal_time for x in r] == list(range(1000, 1010)) and r[3].gps_pps == 70003 and r[3].internal_pps == (1 << 16) + 5
    filled = asof.flag_fill(df, ["file"], "line_id", F.col("flagged"), ["gps_pps"])
    assert {x.line_id: x.f_line_id for x in filled.collect()} == {0: 2, 1: 2, 2: 2, 3: 2, 4: 2, 5: 8, 6: 8, 7: 8, 8: 8, 9: 8}


@pytest.mark.parametrize("mode", ["bil", "bip", "bsq"])
def test_cube_source(spark, tmp_path, mode):
    cube = np.arange(8 * 6 * 4, dtype=np.uint16).reshape(8, 6, 4)  # line, sample, band
    order = {"bil": (0, 2, 1), "bip": (0, 1, 2), "bsq": (2, 0, 1)}[mode]
    f = tmp_path / "cube.img"
    f.write_bytes(np.ascontiguousarray(cube.transpose(order)).tobytes())
    binary.write_envi_header(str(f) + ".hdr", 8, 6, 4, 12, mode, wavelength=[450.0, 550.0, 650.0, 750.0])
    assert binary.envi_header(str(f) + ".hdr")["wavelength"][1] == 550.0
    binary.register(spark)
    df = spark.read.format("cube").option("lines", 3).load(str(f))
    got = {(r.line, r.sample): r.spectrum for r in df.collect()}
    assert all(got[i, j] == cube[i, j].tolist() for i in range(8) for j in range(6))
    assert spark.read.format("cube").option("bands", "2").load(str(f)).where("line = 1 and sample = 1").first().spectrum == [float(cube[1, 1, 2])]


def test_raw_to_bil(spark, tmp_path):
    x = np.arange(2 * 3 * 2, dtype=np.uint16).reshape(2, 3, 2)
    (tmp_path / "raw").write_bytes(x.tobytes() + b"rest")
    binary.register(spark)
    assert binary.raw_to_bil(spark, str(tmp_path / "raw"), str(tmp_path / "out"), 3, 2) == 2
    parts = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("*.bil")))
    assert (np.frombuffer(parts, "<u2").reshape(2, 2, 3).transpose(0, 2, 1) ^ 0x8000 == x).all()


def test_reinterleave(spark, tmp_path):
    cube = np.arange(5 * 4 * 3, dtype=np.uint16).reshape(5, 4, 3)
    f = tmp_path / "bsq.img"
    f.write_bytes(np.ascontiguousarray(cube.transpose(2, 0, 1)).tobytes())
    binary.write_envi_header(str(f) + ".hdr", 5, 4, 3, 12, "bsq")
    binary.register(spark)
    binary.reinterleave(spark, str(f), str(tmp_path / "bil"), per_file=2)
    parts = sorted((tmp_path / "bil").glob("*.bil"))
    assert len(parts) == 3 and (np.frombuffer(b"".join(p.read_bytes() for p in parts), "<u2").reshape(5, 3, 4).transpose(0, 2, 1) == cube).all()
    assert binary.envi_header(str(tmp_path / "bil" / "cube.hdr"))["lines"] == 5


def test_text_sources(spark, tmp_path):
    (tmp_path / "c.bingo").write_text("7 north tower\n12 -1.5 2.25\nbroken\n13 0.5 -3\n-99\n\n8 empty\n-99\n9 last\n14 1 1\n")
    b = text.blocks(text.lines(spark, str(tmp_path / "c.bingo")), "gcp").collect()
    assert sorted((r.gcp_id, r.gcp_name, r.image_id, r.u, r.v) for r in b) == [(7, "north tower", 12, -1.5, 2.25), (7, "north tower", 13, 0.5, -3.0), (9, "last", 14, 1.0, 1.0)]
    (tmp_path / "t.txt").write_text("# id time\n1,10.5\n2 11.5\nbad\n1,12.5\n")
    assert {r.image_id: r.time for r in text.timing(text.lines(spark, str(tmp_path / "t.txt"))).collect()} == {1: 12.5, 2: 11.5}
    (tmp_path / "p.csv").write_text("Name;Ost;Nord;H\na;2600000;1200000;500\nb;x;1;2\n")
    assert [tuple(r) for r in text.points_csv(spark, str(tmp_path / "p.csv")).collect()] == [("a", 2600000.0, 1200000.0, 500.0)]
    (tmp_path / "g.csv").write_text("gcp_id,x,y,z\nA,1,2,3\nA,4,5,6\n")
    assert [tuple(r) for r in text.control_points(spark, str(tmp_path / "g.csv")).collect()] == [("A", 4.0, 5.0, 6.0)]
    (tmp_path / "l.txt").write_text("Line_12.raw M: 2024-05-03 23:59:59.5 +0200 B: 2024-05-01 10:00:01.123456789 +0200\nshort line\nall M: 2024-05-03 23:59:59.5 +0200 B: 2024-05-01 01:00:00 -0530\n")
    r = text.creation_listing(text.lines(spark, str(tmp_path / "l.txt"))).orderBy("filename").collect()
    assert [(x.filename, x.line_in_name) for x in r] == [("Line_12.raw", 12), ("all", None)] and r[0].tod == pytest.approx(8 * 3600 + 1.123456789) and str(r[0].born)[:23] == "2024-05-01 10:00:01.123"
    assert text.creation_listing(text.lines(spark, str(tmp_path / "l.txt")), "signed").where("filename = 'all'").first().tod == 6.5 * 3600


def test_ortho_returns_the_constant(spark):
    from swathly.functions import geodesy
    from swathly.plans.geometry_catalog import straight_flight

    tr = straight_flight()
    grid = raster.output_grid(spark, 7.445, 46.9499, 7.4451, 46.95, 0.00005, 8)
    g = raster.Grid(7.44, 46.951, 0.0005, 6, 30)
    surface = spark.createDataFrame([(r, c, 500.0) for r in range(6) for c in range(30)], "row long, col long, z double")
    cube = spark.createDataFrame([(i, j, [7.0, 9.0]) for i in range(500) for j in range(16)], "line long, sample long, spectrum array<double>")
    to = lambda x, y, z: geodesy.geodetic_to_ecef(y, x, z, degrees=True)
    out = geometry.ortho(grid, surface, g, to, tr, solve.MOUNT, tr.t, np.linspace(-10, 10, 16), cube, 500, 16).collect()
    assert out and all(r.spectrum == pytest.approx([7.0, 9.0]) for r in out)
    flat = geometry.ortho(grid, surface, g, to, tr, solve.MOUNT, tr.t, np.linspace(-10, 10, 16), cube, 500, 16, ground=500.0, resampling="nearest").collect()
    assert {(r.row, r.col) for r in flat} == {(r.row, r.col) for r in out} and flat[0].spectrum == [7.0, 9.0]


def test_ortho_leaves_hidden_cells_out(spark):
    """A wall between the track and some cells hides them; without it, or without the test, they are there."""
    from swathly.functions import geodesy
    from swathly.plans.geometry_catalog import straight_flight

    tr = straight_flight()
    # Cells up to 300 m north of the track; the wall stands half way.
    grid = raster.output_grid(spark, 7.449, 46.9501, 7.4501, 46.9527, 0.0002, 8)
    g = raster.Grid(7.448, 46.954, 0.00005, 100, 60)
    rows = [(r, c, 500.0 + (900.0 if 46.9513 < 46.954 - r * 0.00005 < 46.9516 else 0.0)) for r in range(100) for c in range(60)]
    wall = spark.createDataFrame(rows, "row long, col long, z double")
    flat = wall.withColumn("z", F.lit(500.0))
    cube = spark.createDataFrame([(i, j, [7.0]) for i in range(500) for j in range(64)], "line long, sample long, spectrum array<double>")
    to = lambda x, y, z: geodesy.geodetic_to_ecef(y, x, z, degrees=True)

    def back(x, y, z):
        lat, lon, h = geodesy.ecef_to_geodetic(x, y, z)
        return [F.degrees(lon), F.degrees(lat), h]

    def cells(surface, **more):
        return {(r.row, r.col) for r in geometry.ortho(grid, surface, g, to, tr, solve.MOUNT, tr.t, np.linspace(-40, 40, 64), cube, 500, 64, **more).collect()}

    every, seen = cells(flat, from_ecef=back), cells(wall, from_ecef=back)
    low = {(r.row, r.col) for r in grid.collect() if not 46.9512 < r.y < 46.9517}
    hidden = {(r.row, r.col) for r in grid.collect() if r.y > 46.9518}
    assert every >= low and hidden and not hidden & seen and (low - hidden) <= seen
    assert cells(wall) >= low


def test_refraction_is_nearly_straight():
    x, z = solve.refraction_range(np.array([0.0, 0.3]), np.array([1e-5, 1e-5]), 3000.0)
    assert x[0] == 0 and np.allclose(np.hypot(x, z), 1e-5 * 299_792_458 / 1.0003, rtol=1e-4)


# -- scale -------------------------------------------------------------------------


def test_ranked_percentiles(spark):
    rng = np.random.default_rng(1)
    rows = [(None if k % 97 == 0 else ["a", "b", None][k % 3], None if k % 13 == 0 else float(rng.choice([0.0, -1.5, 2.25, rng.normal()]))) for k in range(3000)] + [("empty", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    ps = (0.0, 0.02, 0.5, 0.9, 1.0)
    got = {r[0]: r[1:] for r in scale.ranked_percentiles(df, "v", ps, ["k"]).collect()}
    for key in ("a", "b", None):
        own = [v for k, v in rows if k == key and v is not None]
        assert got[key] == pytest.approx(tuple(np.quantile(own, ps)))
    assert got["empty"] == (None,) * 5 and len(got) == 4
    assert scale.ranked_percentiles(df, "v", (0.5,)).first()[0] == pytest.approx(np.median([v for _, v in rows if v is not None]))
    assert scale.ranked_percentiles(df.where("false"), "v", (0.5,)).first()[0] is None


def test_numbers_and_sums_over_ranges(spark):
    df = spark.createDataFrame([(k * 7919 % 1000, k % 5) for k in range(1000)], "t long, v long").repartition(9)
    n = scale.numbered(df, ["t"], "n")
    assert [(r.t, r.n) for r in n.orderBy("n").collect()] == [(k, k + 1) for k in range(1000)]
    s = {r.n: r.s for r in scale.running_sum(n, "n", F.col("v"), "s", per=64).collect()}
    values = [r.v for r in n.orderBy("n").collect()]
    assert [s[k + 1] for k in range(1000)] == np.cumsum(values).tolist()
    assert [r.t for r in sequence.decimate(df, ["t"], 100).orderBy("t").collect()] == list(range(99, 1000, 100))
    assert [r.t for r in sequence.slice_between(df, ["t"], F.col("t").isin(500, 503), 2).orderBy("t").collect()] == list(range(498, 506))
    assert [r.t for r in select.trim_edges(df, F.col("t") < 6, ["t"]).orderBy("t").collect()] == [1, 2, 3, 4]
    q = spark.createDataFrame([(k, (-1.0) ** (k // 3), 0.5) for k in range(50)], "t long, a double, b double").repartition(4)
    keyed = sequence.sign_continuity(q.withColumn("f", F.lit(1)), ["f"], ["t"], ["a", "b"]).orderBy("t").collect()
    assert [(r.a, r.b) for r in sequence.sign_continuity(q, [], ["t"], ["a", "b"]).orderBy("t").collect()] == [(r.a, r.b) for r in keyed]


# -- cases that used to fail -------------------------------------------------------


def test_nothing_to_divide_by(spark):
    from swathly.functions import camera, core

    one = spark.createDataFrame([(1.0, 2.0)], "t double, v double")
    assert sequence.rates_from_increments(one, "t", ["v"]).first().v is None
    p = camera.project(core.vec(1.0, 1.0, 0.0), 10, 10, 0, 0, (0.1, 0, 0, 0, 0))
    assert tuple(spark.range(1).select(p["u"], p["v"], p["valid"]).first()) == (None, None, False)
    assert spark.range(1).select(camera.point_ray_distance(core.vec(1, 1, 1), core.vec(0, 0, 0), core.vec(0, 0, 0))).first()[0] is None
    j = camera.projection_jacobian(core.vec(1, 2, 0), 10, 10)
    assert list(spark.range(1).select(*j[0], *j[1]).first()) == [0.0] * 6
    g = spark.createDataFrame([(1, []), (2, [1.0, 3.0]), (3, [4.0])], "k int, s array<double>")
    assert {r.k: r.gray for r in stats.gray_range(g, "s").collect()} == {1: None, 2: 0, 3: 255}


def test_moments_skip_what_is_no_spectrum(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([3.0, 2.0],), (None,), ([1.0],), ([5.0, None],)], "s array<double>")
    n, mean, cov = stats.moments(df, "s", 2)
    assert n == 2 and mean.tolist() == [2.0, 2.0] and cov.tolist() == [[2.0, 0.0], [0.0, 0.0]]


def test_cube_lookup_keeps_every_point(spark):
    cube = spark.createDataFrame([(i, j, [10.0, float(i)]) for i in range(3) for j in range(3) if (i, j) != (1, 1)], "line long, sample long, spectrum array<double>")
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 0.0, 1.5), (3, -1.0, 0.0), (4, 2.0, 2.0), (5, 1.0, 1.0), (6, None, 1.0)], "id int, l double, s double")
    got = {r.id: r.spectrum for r in raster.cube_lookup(pts, cube, "id", "l", "s", 3, 3).collect()}
    assert got == {1: None, 2: [10.0, 0.0], 3: None, 4: [10.0, 2.0], 5: None, 6: None}
    near = {r.id: r.spectrum for r in raster.cube_nearest(pts, cube, "l", "s").collect()}
    assert near == {1: [10.0, 0.0], 2: [10.0, 0.0], 3: None, 4: [10.0, 2.0], 5: None, 6: None}


def test_blocks_look_for_their_header(spark, tmp_path):
    (tmp_path / "b").write_text("# a comment\n77\n7 tower\n1 2 3\n-99\nnonsense here\n8\n-99\n+9  last one \n-3 1e1 .5 more\n5 x 1\n")
    got = text.blocks(text.lines(spark, str(tmp_path / "b")), "gcp").collect()
    assert sorted((r.gcp_id, r.gcp_name, r.image_id, r.u, r.v) for r in got) == [(7, "tower", 1, 2.0, 3.0), (9, "last one", -3, 10.0, 0.5)]


def test_readers_of_small_formats(spark, tmp_path):
    (tmp_path / "g.csv").write_text("# note\nA,1,2,3\nB,4,5,6\nA,7,8,9\n")
    assert sorted(tuple(r) for r in text.control_points(spark, str(tmp_path / "g.csv"), header=False).collect()) == [("A", 7.0, 8.0, 9.0), ("B", 4.0, 5.0, 6.0)]
    assert sorted(tuple(r) for r in text.control_points(spark, str(tmp_path / "g.csv")).collect()) == [("A", 7.0, 8.0, 9.0), ("B", 4.0, 5.0, 6.0)]
    (tmp_path / "c.csv").write_text("gcp_id,image_id,u,v\n1,5,1.5,2\n2,x,1,1\n")
    assert [tuple(r) for r in text.correspondence_csv(spark, str(tmp_path / "c.csv")).collect()] == [("1", "1", 5, 1.5, 2.0)]
    with pytest.raises(ValueError, match="image_id"):
        text.correspondences(spark.createDataFrame([("1", 1.0, 2.0)], "gcp_id string, u double, v double"))
    (tmp_path / "p.csv").write_text("# none\n1, 2.5,x\n2,bad,y\n")
    assert [tuple(r) for r in text.plain_csv(spark, str(tmp_path / "p.csv"), "a int, b double, c string").collect()] == [(1, 2.5, "x"), (2, None, "y")]
    (tmp_path / "lut.txt").write_text("# angles\n-1.5 a\n0.5\n\n2\n")
    assert text.rising(text.number_table(spark, str(tmp_path / "lut.txt"))) == [-1.5, 0.5, 2.0]
    with pytest.raises(ValueError, match="rise"):
        text.rising([1.0, 1.0])
    (tmp_path / "t.csv").write_text("time,latitude,longitude,height,roll,pitch,heading\n1,46,7,500,0,0,9\n")
    assert text.navigation(spark, str(tmp_path / "t.csv")).first().yaw == 9.0
    (tmp_path / "e.txt").write_text("12345\nx\n12346\n")
    assert [(r.line_id, r.tick) for r in text.exposure_times(text.lines(spark, str(tmp_path / "e.txt"))).orderBy("line_id").collect()] == [(0, 12345), (1, 12346)]
    (tmp_path / "a.exif").write_text("x\n#TIMESTAMP = 17\n#TIMESTAMP = 18\n")
    assert text.exif_times(spark, str(tmp_path / "a.exif")).first().time_ns == 17
    assert text.geo_records(spark.createDataFrame([("p", 1.0, 2.0, 3.0)], "name string, x double, y double, z double")).first().value == "GEOXY p 1.000 2.000 3.000 PRIORID p"


def test_navigation_as_text(spark, tmp_path):
    x = np.zeros((3, 17))
    x[:, 0], x[:, 1] = [1, 2, 3], 0.5
    (tmp_path / "n.sbet").write_bytes(x.astype("<f8").tobytes())
    text.navigation_csv(text.navigation(spark, str(tmp_path / "n.sbet")), str(tmp_path / "out"))
    lines = [l for f in sorted((tmp_path / "out").glob("*.csv")) for l in f.read_text().splitlines()]
    assert lines[0].startswith("#time(10usec),latitude") and len(lines[0].split(",")) == 10
    assert sum(l.startswith(("100000,", "200000,", "300000,")) for l in lines) == 3 and "28.64788975654116" in lines[1]


def test_tiles_and_cubes_as_files(spark, tmp_path):
    g = raster.output_grid(spark, 0.0, 0.0, 10.0, 10.0, 1.0, 4)
    binary.write_tiles(g, str(tmp_path / "tiles"))
    back = spark.read.parquet(str(tmp_path / "tiles")).where("tile_row = 1 and tile_col = 2")
    files = back.select(F.input_file_name().alias("f")).distinct().collect()
    assert back.count() == 8 and all("tile_row=1/tile_col=2" in r.f for r in files)


# -- solver ------------------------------------------------------------------------


def _ground(spark, n=40):
    from swathly.functions import geodesy

    p = spark.range(n).select(F.col("id").alias("point_id"), (46.9495 + F.col("id") % 5 * 0.0004).alias("lat"), (7.442 + F.col("id") * 0.0004).alias("lon"))
    return p.select("point_id", *[c.alias(k) for c, k in zip(geodesy.geodetic_to_ecef("lat", "lon", 500.0, degrees=True), "xyz", strict=True)])


def test_solver_meets_its_sensor_model(spark):
    """At the solved time the point, in camera coordinates, is on the ray of the solved pixel: smile, flight correction and sample offset included."""
    from swathly.functions.camera import PolynomialCamera, TableCamera
    from swathly.plans.geometry_catalog import straight_flight

    tr = straight_flight()
    for cam in (TableCamera(tuple(np.linspace(-25, 25, 101)), (0.5, 0.01, 0.002), 1762.0, 1755.0, 4.0, -3.0, 9), PolynomialCamera(1200.0, 640.0, 1280, (1.0, 2.0, -3.0), (25.0, -1.0, 4.0), 9)):
        got = {r.point_id: r for r in solve.scanline_times(_ground(spark), tr, solve.MOUNT, tr.t, cam).collect()}
        rays = {r.point_id: list(r)[1:] for r in spark.createDataFrame([(i, r.u) for i, r in got.items()], "point_id long, u double").select("point_id", *[c.alias(f"r{k}") for k, c in enumerate(cam.ray("u"))]).collect()}
        for r in _ground(spark).collect():
            s = got[r.point_id]
            assert s.valid and s.sample == s.u + 9
            pos, rot = tr.at(np.array([s.time]))
            v = solve.MOUNT @ rot[0].T @ (np.array([r.x, r.y, r.z]) - pos[0])
            assert (s.sx, s.sy, s.sz) == pytest.approx(tuple(pos[0]))
            assert v[:2] / v[2] == pytest.approx(rays[r.point_id][:2], abs=2e-7)
        flat = solve.scanline_times(_ground(spark), tr, solve.MOUNT, tr.t, [-25.0, 0.0, 25.0]).agg(F.min("time")).first()[0]
        assert abs(flat - min(s.time for s in got.values())) > 1e-3  # the model moves the time


def test_solver_by_flight(spark):
    from swathly.plans.geometry_catalog import straight_flight

    tr = straight_flight()
    k = np.linspace(0, 10, 500)
    nav = spark.createDataFrame([(f, float(t), float(np.radians(46.95)), float(np.radians(7.44 + 0.02 * t / 10)), 1500.0, 0.0, 0.0, float(np.pi / 2)) for f in ("a", "b") for t in k], "flight string, time double, latitude double, longitude double, altitude double, roll double, pitch double, heading double")
    exposures = spark.createDataFrame([(f, float(t)) for f in ("a", "b") for t in np.linspace(0, 10, 200)], "flight string, time double")
    pts = _ground(spark).withColumn("flight", F.when(F.col("point_id") % 2 == 0, "a").otherwise("b"))
    a = {r.point_id: r for r in solve.scanline_times_by_flight(pts, nav, exposures, "flight", solve.MOUNT, [-25.0, 0.0, 25.0], parts=3).collect()}
    b = {r.point_id: r for r in solve.scanline_times(_ground(spark), tr, solve.MOUNT, np.linspace(0, 10, 200), [-25.0, 0.0, 25.0]).collect()}
    assert len(a) == 40 and all((a[i].time, a[i].u, a[i].line, a[i].valid) == pytest.approx((b[i].time, b[i].u, b[i].line, b[i].valid)) for i in b)


def test_cubic_spline_is_not_a_knot():
    x = np.array([0.0, 1.0, 2.5, 3.0, 4.5, 6.0, 7.0])
    y = np.stack([x**3 - 2 * x, 1 + x], 1)  # a cubic is its own spline
    at = np.linspace(-0.5, 7.5, 33)
    assert np.allclose(solve.cubic_spline(x, y)(at), np.stack([at**3 - 2 * at, 1 + at], 1))
    rng = np.random.default_rng(0)
    k = np.sort(rng.random(2000)) * 10
    s = solve.cubic_spline(k, np.sin(k))
    assert np.allclose(s(k), np.sin(k)) and np.abs(s(np.linspace(1, 9, 500)) - np.sin(np.linspace(1, 9, 500))).max() < 1e-4
    with pytest.raises(ValueError):
        solve.cubic_spline(x[:3], y[:3])


def test_boresight_with_all_observations(spark):
    """Pairs made with a known boresight give it back; noise gives a variance factor near one."""
    rng, true, arm = np.random.default_rng(7), np.array([0.002, -0.003, 0.004]), (0.1, 0.2, -0.1)
    sig = {"xy": 0.02, "z": 0.03, "rp": 1e-4, "y": 2e-4, "p2p": 0.05}

    def pairs(noise, n=400):
        rows = []
        for _ in range(n):
            ground = np.array([*rng.uniform(-200, 200, 2), 0.0])
            row = {}
            for k in "ij":
                m = np.array([[0, 1, 0], [1, 0, 0], [0, 0, -1.0]])
                rpy = np.array([*rng.normal(0, 0.05, 2), rng.uniform(-3, 3)])
                turn = geometry._body_to_ned(rpy[None])[0][0]
                p = np.array([*rng.uniform(-300, 300, 2), 1000.0])
                body = (m @ turn).T @ (ground - p) - arm  # equals u + theta x u
                skew = np.array([[0, -true[2], true[1]], [true[2], 0, -true[0]], [-true[1], true[0], 0]])
                u = np.linalg.solve(np.eye(3) + skew, body)
                if noise:
                    p = p + rng.normal(0, [sig["xy"], sig["xy"], sig["z"]])
                    rpy = rpy + rng.normal(0, [sig["rp"], sig["rp"], sig["y"]])
                    u = u + (m @ turn).T @ rng.normal(0, sig["p2p"] / np.sqrt(2), 3)
                row |= {f"p{k}": p.tolist(), f"r{k}": rpy.tolist(), f"m{k}": m.reshape(-1).tolist(), f"u{k}": u.tolist()}
            rows.append(row)
        return spark.createDataFrame(rows)

    clean = geometry.adjust_boresight(pairs(False), sig, arm)
    assert clean["theta"] == pytest.approx(true, abs=1e-9) and clean["converged"] and clean["sigma0"] < 1e-5
    noisy = geometry.adjust_boresight(pairs(True), sig, arm)
    off = (noisy["theta"] - true) / np.sqrt(np.diag(noisy["covariance"]))
    assert np.abs(off).max() < 5 and 0.7 < noisy["sigma0"] < 1.3 and noisy["pairs"] == 400


def test_matches_fit_a_projection(spark):
    rng = np.random.default_rng(3)
    h = np.array([[1.02, 0.03, 5], [-0.02, 0.98, -7], [1e-5, 2e-5, 1]])
    p = rng.uniform(0, 800, (60, 2))
    x = np.hstack([p, np.ones((60, 1))]) @ h.T
    q = x[:, :2] / x[:, 2:]
    q[:12] += rng.uniform(60, 200, (12, 2))
    rows = [("a", *map(float, [*a, *b]), 0.5) for a, b in zip(p, q, strict=True)] + [("few", 0.0, 0.0, 1.0, 1.0, 0.25)] * 3
    got = {r.k: r for r in geometry.fit_matches(spark.createDataFrame(rows, "k string, x1 double, y1 double, x2 double, y2 double, confidence double"), ["k"]).collect()}
    error = np.linalg.norm(q - (x[:, :2] / x[:, 2:]), axis=1).mean()  # over all, agreeing or not
    assert got["a"].inlier_ratio == pytest.approx(48 / 60) and got["a"].mean_error == pytest.approx(error, rel=1e-6) and got["a"].matches == 60
    assert (got["few"].inlier_ratio, got["few"].mean_error, got["few"].mean_confidence) == (0.0, -1.0, 0.25)


def test_report_sentinels(spark):
    r = spark.createDataFrame([(1.0, 2.0, 3.0), (None, None, None)], "projected_u double, projected_v double, error double")
    assert [tuple(x) for x in geometry.with_sentinels(r).collect()] == [(1.0, 2.0, 3.0), (0.0, 0.0, float("inf"))]


def test_written_tables_are_swept(spark):
    from swathly import session

    session.sweep(spark)
    a, b = session.materialize(spark.range(5), "a"), session.materialize(spark.range(6), "b")
    session.discard(a)
    assert b.count() == 6 and session.sweep(spark) == 1 and session.sweep(spark) == 0
    with pytest.raises(Exception):  # noqa: B017
        b.collect()


def test_exact_time_takes_the_first_of_equal_times(spark):
    rows = [(i, t, {"a": i}) for t in (1.0, 1.00002, 2.0) for i in range(40)]
    columns = "id int, t double, m map<string, int>"
    want = {1.0: (0, 1.0), 2.0: (0, 2.0), 3.0: None}
    for right in (spark.createDataFrame(rows, columns), spark.createDataFrame(rows[::-1], columns).repartition(7)):
        left = spark.createDataFrame([(t,) for t in want], "t double")
        got = {r.t: r.r and (r.r.id, r.r.t) for r in asof.exact_time(left, right, "t", 1000).collect()}
        assert got == want
    by = spark.createDataFrame([(1, 1.0, 9), (2, 1.0, 3), (3, 1.0, 5)], "id int, t double, line int")
    assert asof.exact_time(by.limit(1).select("t"), by, "t", 1000, ("line",)).first().r.id == 2
