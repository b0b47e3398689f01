import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from swathly.functions import camera, core, geodesy, rotation
from swathly.operators import solve


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def matrix(spark, m):
    return np.array(one(spark, *[x for r in m for x in r]), float).reshape(3, 3)


@pytest.mark.parametrize("lat, lon, want", [(0, 0, (geodesy.WGS84_A, 0, 0)), (0, 90, (0, geodesy.WGS84_A, 0)), (90, 0, (0, 0, geodesy.WGS84_B)), (-90, 0, (0, 0, -geodesy.WGS84_B))])
def test_ecef_axes(spark, lat, lon, want):
    assert np.allclose(one(spark, *geodesy.geodetic_to_ecef(lat, lon, 0.0, degrees=True)), want, atol=1e-6)


def test_ned_rows_are_a_rotation(spark):
    m = matrix(spark, geodesy.ecef_to_ned(0.8, 0.2))
    assert np.allclose(m @ m.T, np.eye(3), atol=1e-14) and np.isclose(np.linalg.det(m), 1)


@pytest.mark.parametrize("convention", ["zyx", "ned2body", "r1r2r3", "passive"])
def test_conventions(spark, convention):
    r, p, y = 0.1, -0.2, 0.7
    cx, sx, cy, sy, cz, sz = math.cos(r), math.sin(r), math.cos(p), math.sin(p), math.cos(y), math.sin(y)
    x, q, z = np.array([[1, 0, 0], [0, cx, -sx], [0, sx, cx]]), np.array([[cy, 0, sy], [0, 1, 0], [-sy, 0, cy]]), np.array([[cz, -sz, 0], [sz, cz, 0], [0, 0, 1]])
    want = {"zyx": z @ q @ x, "ned2body": (z @ q @ x).T, "r1r2r3": x @ q @ z, "passive": x.T @ q.T @ z.T}[convention]
    assert np.allclose(matrix(spark, rotation.rpy_matrix(r, p, y, convention)), want, atol=1e-14)


def test_rotation_check_refuses_reflections_and_scales(spark):
    eye = [[F.lit(float(i == j)) for j in range(3)] for i in range(3)]
    flip = [[-x for x in eye[0]], eye[1], eye[2]]
    big = [[x * 2 for x in r] for r in eye]
    assert list(one(spark, rotation.is_rotation(eye), rotation.is_rotation(flip).alias("b"), rotation.is_rotation(big).alias("c"))) == [True, False, False]


def test_slerp_ends_and_norm(spark):
    a, b = core.vec(1.0, 0.0, 0.0, 0.0), core.vec(math.cos(1), math.sin(1), 0.0, 0.0)
    for t, want in ((0.0, (1, 0)), (1.0, (math.cos(1), math.sin(1))), (0.5, (math.cos(0.5), math.sin(0.5)))):
        q = one(spark, *rotation.slerp(a, b, t))
        assert np.allclose(q[:2], want) and np.isclose(sum(x * x for x in q), 1)


def test_heading_goes_the_short_way(spark):
    assert one(spark, rotation.angle_lerp_deg(350.0, 10.0, 0.5))[0] == 360.0


def test_lens_round_trip(spark):
    d = (-0.1, 0.02, 0.0, 0.001, 0.0005)
    x, y = camera.distort(F.lit(0.2), F.lit(-0.1), d)
    assert np.allclose(one(spark, *camera.undistort(x, y, d)), (0.2, -0.1), atol=1e-7)


def test_behind_the_camera_is_null(spark):
    p = camera.project(core.vec(0.0, 0.0, -1.0), 1.0, 1.0, 0.0, 0.0)
    assert tuple(one(spark, p["u"], p["valid"].alias("w"))) == (None, False)


def test_swiss_reference_point(spark):
    e, n = one(spark, *geodesy.swiss_forward(46.951082877, 7.438632495))
    assert abs(e - 2_600_000) < 1.5 and abs(n - 1_200_000) < 1.5
    la, lo = one(spark, *geodesy.swiss_inverse(2_600_000.0, 1_200_000.0))
    assert abs(la - 46.951082877) < 2e-5 and abs(lo - 7.438632495) < 2e-5


def test_unknown_projection_is_refused():
    with pytest.raises(ValueError):
        geodesy.project(0.0, 0.0, 31467)


@settings(max_examples=25, deadline=None)
@given(st.floats(-3, 3), st.floats(-1.5, 1.5), st.floats(-3, 3))
def test_numpy_quaternions(r, p, y):
    m = solve.body_to_ned(np.array([r]), np.array([p]), np.array([y]))
    assert np.allclose(solve.to_matrix(solve.to_quaternion(m)), m, atol=1e-12) and np.allclose(m @ m.transpose(0, 2, 1), np.eye(3), atol=1e-12)


def test_newton_finds_the_line(spark):
    from swathly.plans.geometry_catalog import straight_flight

    tr = straight_flight()
    at = tr.t[250]
    ground = solve.ecef(np.array([math.radians(46.95)]), np.array([math.radians(7.44 + 0.02 * at / 10)]), np.array([500.0]))[0]
    df = spark.createDataFrame([(1, *map(float, ground))], "point_id long, x double, y double, z double")
    for variant in ("central", "forward"):
        got = solve.scanline_times(df, tr, solve.MOUNT, tr.t, np.linspace(-20, 20, 64), variant=variant).first()
        assert got.valid and abs(got.time - at) < 1e-3


def test_spline_is_exact_for_cubics():
    x = np.linspace(0, 3, 9)
    f = lambda t: 2 * t**3 - t + 1
    assert np.allclose(solve.cubic_spline(x, f(x))(np.array([0.13, 1.7, 2.9])), f(np.array([0.13, 1.7, 2.9])))


def test_utm_against_another_series(spark):
    """The series in the longitude difference, as published for hand computation, and the meridian's length by summation."""
    a, e2 = geodesy.WGS84_A, geodesy.WGS84_E2
    e1 = e2 / (1 - e2)
    for lat, lon in ((46.95, 7.44), (0.5, 9.0), (60.0, 11.9), (-33.0, 6.2), (80.0, 9.5)):
        f, d = math.radians(lat), math.radians(lon - 9)
        phi = np.linspace(0, f, 200_001)
        g = a * (1 - e2) / (1 - e2 * np.sin(phi) ** 2) ** 1.5
        m = float(((g[1:] + g[:-1]) / 2 * np.diff(phi)).sum())
        nu, t, c, x = a / math.sqrt(1 - e2 * math.sin(f) ** 2), math.tan(f) ** 2, e1 * math.cos(f) ** 2, d * math.cos(f)
        east = 500_000 + 0.9996 * nu * (x + (1 - t + c) * x**3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * e1) * x**5 / 120)
        north = 0.9996 * (m + nu * math.tan(f) * (x**2 / 2 + (5 - t + 9 * c + 4 * c * c) * x**4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * e1) * x**6 / 720))
        got = one(spark, *geodesy.utm_forward(F.lit(lat), F.lit(lon), 32632))
        assert list(got) == pytest.approx([east, north], abs=0.01)
        south = one(spark, *geodesy.utm_forward(F.lit(lat), F.lit(lon), 32732))
        assert south[1] == pytest.approx(got[1] + 10_000_000)


def test_codes_with_heights(spark):
    for epsg in (4978, 4979, 32632, 3857):
        x = geodesy.project3(F.lit(46.9), F.lit(7.4), F.lit(512.0), epsg)
        if epsg != 3857:
            assert list(one(spark, *geodesy.unproject3(*x, epsg))) == pytest.approx([46.9, 7.4, 512.0], abs=1e-6)
    with pytest.raises(ValueError):
        geodesy.project3(F.lit(1.0), F.lit(1.0), F.lit(1.0), 1234)
