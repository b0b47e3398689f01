"""Settings, loaders, the validation run, calibration fits and the other small operators."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from swathly import config
from swathly.functions import geodesy, rotation
from swathly.operators import asof, calibration, control, geometry, raster, select, sequence, solve, stats
from swathly.sources import binary, surface, text


def test_settings(tmp_path):
    v = {"observations": "o", "points": "p", "trajectory": "t", "lens": {"fx": 1000, "fy": 1000, "cx": 5, "cy": 6, "width": 10}}
    got = config.build(config.Validation, v)
    assert got.lens.width == 10 and got.mounting == config.Mounting() and got.lens.as_camera()["cx"] == 5
    config.write(got, str(tmp_path / "v.json"))
    assert config.read(str(tmp_path / "v.json"), config.Validation) == got
    (tmp_path / "v.ini").write_text("[main]\nobservations = o\npoints = p\ntrajectory = t\nthreshold = 2.5\n[lens]\nfx = 1000\nfy = 1000\ncx = 5\ncy = 6\n[mounting]\nyaw = 0.5\n")
    ini = config.read(str(tmp_path / "v.ini"), config.Validation)
    assert ini.threshold == 2.5 and ini.mounting.boresight == (0.0, 0.0, 0.5) and ini.lens.fx == 1000
    for bad in (v | {"nonsense": 1}, {k: x for k, x in v.items() if k != "points"}, v | {"threshold": 0}, v | {"observation_format": "x"}, v | {"lens": v["lens"] | {"fx": -1}}):
        with pytest.raises(ValueError):
            config.build(config.Validation, bad)
    for bad in ({"variance": 0}, {"variance": 1.1}, {"output_type": "int"}, {"interleave": "x"}, {"chunk_lines": 0}):
        with pytest.raises(ValueError):
            config.build(config.Components, bad)
    line = config.build(config.LineCamera, {"f": 1200.0, "centre": 640.0, "width": 1280, "across": [1.0, 2.0]})
    assert line.as_camera().across == (1.0, 2.0)
    with pytest.raises(ValueError):
        config.LineCamera(0.0, 1.0, 10)


def camera_point(ground, pose):
    """Camera coordinates by plain numpy, step by step."""
    lat, lon, h, r, p, y = pose
    la, lo = np.radians(lat), np.radians(lon)
    ned = solve.ned_to_ecef(la, lo).T @ (ground - solve.ecef(la, lo, np.array(h)))
    b = geometry.zyx_matrix(*np.radians([r, p, y])) @ ned
    return np.array([b[1], -b[0], b[2]])


def test_validation_run(spark, tmp_path):
    """From files to the report, against plain numpy."""
    ground = {k: solve.ecef(np.radians(46.95 + k * 1e-4), np.radians(7.45), np.array(500.0)) for k in (1, 2, 3)}
    (tmp_path / "points.csv").write_text("gcp_id,x,y,z\n" + "".join(f"{k},{g[0]},{g[1]},{g[2]}\n" for k, g in ground.items() if k != 3))
    flight = [(float(t), 46.95, 7.4495 + t * 1e-4, 1500.0, 1.0, -2.0, (350.0 + 10 * t) % 360) for t in range(6)]
    (tmp_path / "flight.csv").write_text("time,latitude,longitude,height,roll,pitch,yaw\n" + "".join(",".join(map(str, r)) + "\n" for r in flight))
    (tmp_path / "timing.txt").write_text("10 0.5\n11 2.0\n12 99\n")
    (tmp_path / "obs.bingo").write_text("# two blocks\n1 first point\n10 3.5 -2\n11 1 1\n12 0 0\n-99\n2 second\n10 5 5\n-99\n3 third\n10 1 1\n")
    settings = config.build(config.Validation, {"observations": str(tmp_path / "obs.bingo"), "points": str(tmp_path / "points.csv"), "trajectory": str(tmp_path / "flight.csv"), "timing": str(tmp_path / "timing.txt"), "threshold": 100.0, "lens": {"fx": 1000.0, "fy": 1000.0, "cx": 640.0, "cy": 512.0, "width": 1280, "height": 1024}})
    results, report = control.run(spark, settings)
    got = {(r.gcp_id, r.image_id): r for r in results.collect()}
    poses = {10: (46.95, 7.44955, 1500.0, 1.0, -2.0, 355.0), 11: (46.95, 7.4497, 1500.0, 1.0, -2.0, 10.0)}
    errors = []
    for (g, i), (u, v) in {("1", 10): (3.5, -2), ("1", 11): (1, 1), ("2", 10): (5, 5)}.items():
        c = camera_point(ground[int(g)], poses[i])
        pu, pv = 1000 * c[0] / c[2] + 640, 1000 * c[1] / c[2] + 512
        r = got[g, i]
        assert (r.projected_u, r.projected_v, r.u, r.v) == pytest.approx((pu, pv, u + 640, 512 - v), abs=1e-5)
        errors.append(np.hypot(pu - u - 640, pv - 512 + v))
        assert r.valid and r.error == pytest.approx(errors[-1], abs=1e-5) and r.distance == pytest.approx(np.linalg.norm(c))
    assert got["1", 12].reason == "no pose" and got["3", 10].reason == "no point" and got["3", 10].error is None
    lines = [(r.part, json.loads(r.value)) for r in report.collect()]
    summary = next(v for p, v in lines if p == "summary")
    assert summary["n_total"] == 5 and summary["n_valid"] == 3 and summary["rmse"] == pytest.approx(np.sqrt(np.mean(np.square(errors))), abs=1e-5) and summary["median_error"] == pytest.approx(np.median(errors), abs=1e-5)
    assert {v["gcp_id"]: v["n"] for p, v in lines if p == "per_gcp"} == {"1": 2, "2": 1} and {v["image_id"]: v["n"] for p, v in lines if p == "per_image"} == {10: 2, 11: 1}
    assert len([1 for p, _ in lines if p == "details"]) == 5
    seen, points = results.select("gcp_id", "image_id"), text.control_points(spark, settings.points)
    missing = control.gaps(seen, points, spark.createDataFrame([(10,), (11,)], "image_id int")).collect()
    assert sorted(map(tuple, missing)) == [("no coordinates", "3"), ("no pose", "12")]
    assert control.of_image(results, 10).count() == 3 and control.of_point(results, "1").count() == 3 and control.ids(results, "gcp_id").count() == 3


def test_poses_without_a_timing(spark):
    t = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0), (2, 2, 3.0)], "image_id int, line_no long, v double").select("image_id", "line_no", *[F.col("v").alias(c) for c in control.POSE])
    assert {r.image_id: r.height for r in control.poses(t).collect()} == {1: 2.0, 2: 3.0}
    with pytest.raises(ValueError, match="yaw"):
        control.poses(t.drop("yaw"))


@pytest.mark.parametrize("model", ["line", "full", "smile"])
def test_lens_fits_find_their_parameters(model):
    pixels = np.arange(0, 640, 4.0)
    truth = {"f": 1762.0, "cx": 321.0, "cy": 2.0, "k1": -0.05, "k2": 0.01, "k3": 0.0, "p1": 0.0, "p2": 0.001}
    rng = np.random.default_rng(1)
    across = np.degrees(np.arctan((pixels - 321) / 1762.0)) + 0.3 * np.sin(pixels / 90)
    along = 0.05 + 0.001 * across**2 + 0.02 * rng.random(len(pixels)) * (model != "line")
    u, v = calibration.brown(across, along, truth["f"], truth["cx"], 0.0 if model == "line" else truth["cy"], (truth["k1"], truth["k2"], 0.0), (0.0, truth["p2"]))
    # Pixels are where the model puts the angles, so the fit's across-track misses vanish.
    start = np.array([truth.get(n, 0.0) for n in calibration.MODELS[model]])
    assert np.allclose(calibration.residuals(model, start, across, along, u)[: len(u)], 0, atol=1e-9)
    got, rms = calibration.fit(model, across, along, u)
    assert rms <= np.sqrt(np.mean(calibration.residuals(model, start, across, along, u) ** 2)) + 1e-9
    assert got["f"] == pytest.approx(1762.0, rel=0.02)


def test_equalised_tiles_equal_the_definition(spark):
    rng = np.random.default_rng(5)
    z = np.clip(rng.normal(0.4, 0.2, (24, 30)) + np.linspace(0, 0.3, 30), 0, 1)
    df = spark.createDataFrame([(i, j, float(z[i, j])) for i in range(24) for j in range(30)] + [(0, 99, None)], "row long, col long, z double")
    got = {(r.row, r.col): r.equalized for r in raster.equalize_tiles(df, "z", (2, 3), (24, 30), 0.1, 16).collect()}
    maps = np.zeros((2, 3, 16))
    for a in range(2):
        for b in range(3):
            f = np.bincount(np.minimum((z[12 * a : 12 * a + 12, 10 * b : 10 * b + 10] * 16).astype(int), 15).reshape(-1), minlength=16) / 120
            maps[a, b] = np.cumsum(np.minimum(f, 0.1) + np.maximum(f - 0.1, 0).sum() / 16)
    assert len(got) == 720
    for (i, j), e in got.items():
        y, x = min(max((i + 0.5) / 12 - 0.5, 0), 1), min(max((j + 0.5) / 10 - 0.5, 0), 2)
        r, c, k, want = int(y), int(x), min(int(z[i, j] * 16), 15), 0.0
        for di in (0, 1):
            for dj in (0, 1):
                w = (y - r if di else 1 - y + r) * (x - c if dj else 1 - x + c)
                if w:
                    want += w * maps[r + di, c + dj, k]
        assert e == pytest.approx(want)


def test_index_stepping_meets_newton(spark):
    from swathly.plans.geometry_catalog import straight_flight

    tr = straight_flight()
    lines = np.linspace(0, 10, 1000)
    p = spark.range(30).select(F.col("id").alias("point_id"), (46.9495 + F.col("id") % 5 * 0.0002).alias("lat"), (7.4385 + F.col("id") * 0.0008).alias("lon"))
    pts = p.select("point_id", *[c.alias(k) for c, k in zip(geodesy.geodetic_to_ecef("lat", "lon", 500.0, degrees=True), "xyz", strict=True)])
    exact = {r.point_id: r for r in solve.scanline_times(pts, tr, solve.MOUNT, lines, list(np.linspace(-40, 40, 9))).collect()}
    # The body looks back in this convention, so the along-track axis is turned for steps that go down.
    got = {r.point_id: r for r in solve.scanline_indices(pts, tr, np.diag([1.0, -1.0, 1.0]) @ solve.MOUNT, lines, 1000.0, 500.0, 1000).collect()}
    found = [i for i, r in got.items() if r.line is not None]
    assert len(found) >= 20 and all(abs(got[i].line - exact[i].line) < 1.0 for i in found if exact[i].valid)
    assert any(r.line is None for r in got.values())


def test_attitudes_and_edges(spark):
    right = spark.createDataFrame([("a", 0.0, 1.0, 0.0, 0.0, 0.0), ("a", 1.0, 0.0, 0.0, 0.0, 1.0)], "k string, t double, w double, x double, y double, z double")
    left = spark.createDataFrame([("a", t) for t in (-1.0, 0.0, 0.5, 1.0, 9.0)] + [("b", 0.0)], "k string, t double")
    got = {(r.k, r.t): (r.i_w, r.i_z) for r in asof.interpolate_attitude(left, right, ["k"], "t", ("w", "x", "y", "z")).collect()}
    half = np.sqrt(0.5)
    assert got["b", 0.0] == (None, None)
    for t, want in ((-1.0, (1, 0)), (0.0, (1, 0)), (0.5, (half, half)), (1.0, (0, 1)), (9.0, (0, 1))):
        assert got["a", t] == pytest.approx(want, abs=1e-12)
    one = asof.interpolate(left.where("k = 'a'"), right, ["k"], "t", ["w"])
    with pytest.raises(ValueError, match="outside"):
        asof.require_inside(one, "i_w", "t")
    with pytest.raises(ValueError, match="no rows"):
        sequence.time_window(spark.sql("SELECT timestamp'2024-01-01' AS ts"), "ts", "2025-01-01", "2025-01-02", "1 MINUTE", required=True)


def test_gimbal_lock(spark):
    m = [[F.lit(float(x)) for x in r] for r in ((0, 0, 1), (0.6, 0.8, 0), (-0.8, 0.6, 0))]
    o, p, k = spark.range(1).select(*rotation.opk_of(m)).first()
    assert (o, p, k) == pytest.approx((0.0, np.pi / 2, np.arctan2(0.6, 0.8)))


def test_surfaces_as_cells(spark, tmp_path):
    g = raster.Grid(100.0, 200.0, 2.0, 3, 4)
    cells = spark.createDataFrame([(r, c, -9999.0 if (r, c) == (1, 1) else float(r * 4 + c)) for r in range(3) for c in range(4)], "row long, col long, z double")
    surface.write_cells(cells, g, str(tmp_path / "s"), -9999.0, 2056)
    back, grid, epsg = surface.read_cells(spark, str(tmp_path / "s"))
    assert back.count() == 11 and grid == g and epsg == 2056
    edge = raster.edge_samples(g, 3)
    assert len(edge) == 12 and (100.0, 200.0) in edge and (108.0, 194.0) in edge and (104.0, 194.0) in edge
    at = raster.to_cells(spark.createDataFrame([(103.0, 197.0)], "x double, y double"), g, F.col("x"), F.col("y")).first()
    assert (at.row, at.col) == (1.5, 1.5)
    t = raster.resample(spark.createDataFrame([(0, 0), (5, 5)], "row long, col long"), back, g, 102.0 + F.col("col"), 197.0 - F.col("row"))
    assert {(r.row, r.col): r.z for r in t.collect()} == {(0, 0): None, (5, 5): None}
    if surface.rasterio is None:
        with pytest.raises(RuntimeError):
            surface.read_geotiff(spark, "x.tif")


def test_small_ones(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "a double, b double")
    assert [tuple(r) for r in stats.min_max(df, ["a", "b"]).collect()] == [(0, 0), (255, 0), (None, 0)]
    h = solve.reproject_heights(spark.createDataFrame([(2_600_000.0, 1_200_000.0, 100.0)], "e double, n double, h double")).first()
    assert h.h_ellipsoid == 149.5
    m = sequence.merge_sorted([spark.createDataFrame([(10,), (2,)], "t int"), spark.createDataFrame([(3,)], "t int")], ["t"])
    assert [r.t for r in m.collect()] == [2, 3, 10]
    s = sequence.stable_order(spark.createDataFrame([(1, "b"), (0, "z"), (1, "a")], "t int, f string"), "t", "f")
    assert [tuple(r) for r in s.collect()] == [(0, "z"), (1, "a"), (1, "b")]


def test_points_between_systems(spark):
    df = spark.createDataFrame([(k, 2_600_000.0 + 100 * k, 1_200_000.0 - 50 * k, 500.0) for k in range(5)], "n long, x double, y double, h double")
    there = select.transform_points(df, ("x", "y", "h"), 2056, 4978, geoid=True)
    back = select.transform_points(there.select("n", "px", "py", "pz").toDF("n", "x", "y", "h"), ("x", "y", "h"), 4978, 2056, geoid=True)
    for a, b in zip(df.orderBy("n").collect(), back.orderBy("n").collect(), strict=True):
        assert (b.px, b.py) == pytest.approx((a.x, a.y), abs=3) and b.pz == pytest.approx(500.0, abs=0.01)
    assert np.linalg.norm(list(there.select("px", "py", "pz").first())) == pytest.approx(6.366e6, rel=1e-3)


def test_spline_over_a_table(spark):
    e = spark.createDataFrame([(float(t), float(t**3 - t), 2.0 * t) for t in range(8)], "t double, a double, b double")
    p = spark.createDataFrame([(1, 2.5), (2, 7.5), (3, None)], "id int, t double")
    got = {r.id: (r.s_a, r.s_b) for r in solve.spline_positions(p, e, "t", ["a", "b"]).collect()}
    assert got[1] == pytest.approx((2.5**3 - 2.5, 5.0)) and got[2] == pytest.approx((7.5**3 - 7.5, 15.0)) and got[3] == (None, None)
    with pytest.raises(ValueError):
        solve.spline_positions(p, e, "t", ["a"], most=3)


def test_rgb_cube(spark, tmp_path):
    cube = spark.createDataFrame([(i, j, [float(i), 100.0, float(j)]) for i in range(10) for j in range(10)], "line int, sample int, spectrum array<double>")
    assert binary.write_rgb(cube, [450.0, 540.0, 660.0], str(tmp_path / "rgb"), 10, 10) == [2, 1, 0]
    h = binary.envi_header(str(tmp_path / "rgb" / "cube.hdr"))
    x = np.frombuffer(b"".join(p.read_bytes() for p in sorted((tmp_path / "rgb").glob("*.bil"))), np.uint8).reshape(10, 3, 10)
    low, high = np.percentile(np.repeat(np.arange(10.0), 10), [2, 98])
    want = np.floor(np.clip((np.arange(10) - low) / (high - low), 0, 1) * 255)
    assert h["wavelength"] == [660.0, 540.0, 450.0] and h["default bands"] == [1.0, 2.0, 3.0] and (x[3, 0] == want).all() and (x[:, 2, 5] == want).all() and (x[:, 1] == 0).all()


def test_matcher_plugs_in(spark):
    import pandas as pd

    a = spark.createDataFrame([(0, 0, "p", 1.0), (1, 0, "q", 2.0)], "tile_x int, tile_y int, id_a string, da double")
    b = spark.createDataFrame([(0, 0, "r", 1.5), (2, 0, "s", 2.0)], "tile_x int, tile_y int, id_b string, db double")

    def matcher(rows):
        return pd.DataFrame({"id_a": rows.id_a, "id_b": rows.id_b, "confidence": 1 / (abs(rows.da - rows.db) + 1)})

    got = geometry.match_tiles(a, b, matcher, "id_a string, id_b string, confidence double").collect()
    assert [(r.id_a, r.id_b) for r in got] == [("p", "r")]
    m = spark.createDataFrame([(True, 1.0, 0.5), (True, 2.0, 0.7), (False, 30.0, 0.1), (True, 3.0, 0.9)], "ok boolean, e double, c double")
    r = geometry.match_metrics(m, "ok", "e", "c").first()
    assert (r.matches, r.inlier_ratio, r.mean_error) == (4, 0.75, 9.0)
    assert tuple(geometry.match_metrics(m.limit(2), "ok", "e", "c").select("inlier_ratio", "mean_error").first()) == (0.0, -1.0)


def test_small_texts(spark, tmp_path):
    (tmp_path / "m.csv").write_text("1,2,3,4,0.5\nbad\n1,2,3,4\n")
    assert [tuple(r)[1:] for r in text.match_csv(spark, str(tmp_path / "m.csv")).collect()] == [(1.0, 2.0, 3.0, 4.0, 0.5)]
    (tmp_path / "r.txt").write_text("# mount\n0 1 0\n-1 0 0\n0 0 1\n")
    assert text.matrix_text(spark, str(tmp_path / "r.txt")) == [[0, 1, 0], [-1, 0, 0], [0, 0, 1]]
    for bad in ("1 0 0\n0 1 0\n0 0 -1\n", "1 2 3\n"):
        (tmp_path / "r.txt").write_text(bad)
        with pytest.raises(ValueError):
            text.matrix_text(spark, str(tmp_path / "r.txt"))
    from swathly.functions import camera, core

    assert tuple(spark.range(1).select(*camera.project_guarded(core.vec(1.0, 2.0, 0.0), 1.0, 1.0, 0.0, 0.0)).first()) == pytest.approx((1e6, 2e6))
