"""Rotations. The convention is always named: a silent transpose gives plausible nonsense."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import Mat, Vec, col, det3, dot, matmul, transpose



def _axis(axis: str, a: Column) -> Mat:
    """Active rotation about one axis."""
    c, s, o, i = F.cos(a), F.sin(a), F.lit(0.0), F.lit(1.0)
    return {"x": [[i, o, o], [o, c, -s], [o, s, c]], "y": [[c, o, s], [o, i, o], [-s, o, c]], "z": [[c, -s, o], [s, c, o], [o, o, i]]}[axis]


def rpy_matrix(roll, pitch, yaw, convention: str = "zyx") -> Mat:
    """Rotation of roll, pitch, yaw (radians).

    zyx: Rz Ry Rx, body to north-east-down. ned2body: its transpose. r1r2r3: active R1 R2 R3.
    passive: Rx Ry Rz with passive factors.
    """
    r, p, y = col(roll), col(pitch), col(yaw)
    if convention == "zyx":
        return matmul(matmul(_axis("z", y), _axis("y", p)), _axis("x", r))
    if convention == "ned2body":
        return transpose(rpy_matrix(r, p, y))
    if convention == "r1r2r3":
        return matmul(matmul(_axis("x", r), _axis("y", p)), _axis("z", y))
    if convention == "passive":
        return matmul(matmul(transpose(_axis("x", r)), transpose(_axis("y", p))), transpose(_axis("z", y)))
    raise ValueError(convention)


def opk_matrix(omega, phi, kappa) -> Mat:
    return rpy_matrix(omega, phi, kappa, "r1r2r3")


def rpy_of(m: Mat) -> Vec:
    """Roll, pitch, yaw of a zyx matrix, with the gimbal case roll 0."""
    pitch = F.asin(F.greatest(F.least(-m[2][0], F.lit(1.0)), F.lit(-1.0)))
    locked = F.abs(m[2][0]) > 1 - 1e-9
    roll = F.when(locked, 0.0).otherwise(F.atan2(m[2][1], m[2][2]))
    yaw = F.when(locked, F.atan2(-m[0][1], m[1][1])).otherwise(F.atan2(m[1][0], m[0][0]))
    return [roll, pitch, yaw]


def opk_of(m: Mat) -> Vec:
    """Omega, phi, kappa of an r1r2r3 matrix; with phi at a right angle omega is 0 and kappa takes the whole turn."""
    locked = F.abs(m[0][2]) >= 0.9999
    phi = F.asin(F.greatest(F.least(m[0][2], F.lit(1.0)), F.lit(-1.0)))
    omega = F.when(locked, 0.0).otherwise(F.atan2(-m[1][2], m[2][2]))
    kappa = F.when(locked, F.when(m[0][2] > 0, F.atan2(m[1][0], m[1][1])).otherwise(F.atan2(-m[1][0], m[1][1]))).otherwise(F.atan2(-m[0][1], m[0][0]))
    return [omega, phi, kappa]


def ned_enu() -> Mat:
    """Exchange of north-east-down and east-north-up."""
    return [[F.lit(float(x)) for x in r] for r in ((0, 1, 0), (1, 0, 0), (0, 0, -1))]


def quarter_turn() -> Mat:
    """A right angle about z."""
    return [[F.lit(float(x)) for x in r] for r in ((0, -1, 0), (1, 0, 0), (0, 0, 1))]


def body_to_camera() -> Mat:
    """Body (forward, right, down) to camera (right, back, down)."""
    return [[F.lit(float(x)) for x in r] for r in ((0, 1, 0), (-1, 0, 0), (0, 0, 1))]


def rpy_to_opk_deg(roll, pitch, heading) -> Vec:
    """Photogrammetric angles in degrees of an attitude in radians, for a camera a quarter turn from the body in east-north-up axes."""
    swap = ned_enu()
    world = matmul(matmul(swap, rpy_matrix(roll, pitch, heading)), swap)
    omega, phi, kappa = opk_of(matmul(quarter_turn(), world))
    locked = F.abs(F.sin(phi)) >= 0.9999
    return [F.degrees(omega), F.degrees(phi), F.degrees(F.when(locked, kappa).otherwise(-kappa))]


def mounted(roll, pitch, yaw, mount: Mat, order: str = "mount_first") -> Mat:
    """A boresight rotation (zyx) and a mounting matrix: 'mount_first' is mount times boresight, 'boresight_first' the other product."""
    bore = rpy_matrix(roll, pitch, yaw)
    return matmul(mount, bore) if order == "mount_first" else matmul(bore, mount)


def boresight_of(optimised: Mat, mount: Mat) -> Vec:
    """Roll, pitch, yaw of the boresight in a body-to-camera rotation that is boresight times mount."""
    return rpy_of(matmul(optimised, transpose(mount)))


def axis_angle_matrix(v: Vec) -> Mat:
    """Rotation of a vector whose direction is the axis and whose length the angle; none for the zero vector."""
    n = F.sqrt(dot(v, v))
    safe = F.when(n < 1e-15, 1.0).otherwise(n)
    return rodrigues([x / safe for x in v], F.when(n < 1e-15, 0.0).otherwise(n))


def is_rotation(m: Mat, tol: float = 1e-6) -> Column:
    """Orthogonal with determinant +1."""
    g = matmul(m, transpose(m))
    ok = F.abs(det3(m) - 1) < tol
    for i in range(3):
        for j in range(3):
            ok = ok & (F.abs(g[i][j] - float(i == j)) < tol)
    return ok


def relative_angle(a: Mat, b: Mat) -> Column:
    m = matmul(a, transpose(b))
    return F.acos(F.greatest(F.least((m[0][0] + m[1][1] + m[2][2] - 1) / 2, F.lit(1.0)), F.lit(-1.0)))


def skew(v: Vec) -> Mat:
    o = F.lit(0.0)
    return [[o, -v[2], v[1]], [v[2], o, -v[0]], [-v[1], v[0], o]]


def skew_transposed(v: Vec) -> Mat:
    return transpose(skew(v))


def rodrigues(axis: Vec, angle) -> Mat:
    """Active rotation about a unit axis."""
    a = col(angle)
    c, s = F.cos(a), F.sin(a)
    k = skew(axis)
    return [[(c if i == j else F.lit(0.0)) + s * k[i][j] + (1 - c) * axis[i] * axis[j] for j in range(3)] for i in range(3)]


def quaternion_of(m: Mat) -> Vec:
    """Scalar first; the branch with the largest pivot."""
    t = m[0][0] + m[1][1] + m[2][2]
    branches = [
        (t > 0, t + 1, lambda s: [s / 4, (m[2][1] - m[1][2]) / s, (m[0][2] - m[2][0]) / s, (m[1][0] - m[0][1]) / s]),
        ((m[0][0] > m[1][1]) & (m[0][0] > m[2][2]), 1 + m[0][0] - m[1][1] - m[2][2], lambda s: [(m[2][1] - m[1][2]) / s, s / 4, (m[0][1] + m[1][0]) / s, (m[0][2] + m[2][0]) / s]),
        (m[1][1] > m[2][2], 1 + m[1][1] - m[0][0] - m[2][2], lambda s: [(m[0][2] - m[2][0]) / s, (m[0][1] + m[1][0]) / s, s / 4, (m[1][2] + m[2][1]) / s]),
        (F.lit(True), 1 + m[2][2] - m[0][0] - m[1][1], lambda s: [(m[1][0] - m[0][1]) / s, (m[0][2] + m[2][0]) / s, (m[1][2] + m[2][1]) / s, s / 4]),
    ]
    parts = [make(2 * F.sqrt(F.greatest(pivot, F.lit(1e-300)))) for _, pivot, make in branches]
    out = []
    for k in range(4):
        c = F.when(branches[0][0], parts[0][k])
        for (test, _, _), p in zip(branches[1:], parts[1:], strict=True):
            c = c.when(test, p[k])
        out.append(c)
    return out


def matrix_of(q: Vec) -> Mat:
    w, x, y, z = q
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]


def slerp(a: Vec, b: Vec, t, linear_above: float = 0.9995) -> Vec:
    """Shortest path; nearly equal rotations are blended linearly; the result is normalised."""
    t = col(t)
    raw = dot(a, b)
    sign = F.when(raw < 0, -1.0).otherwise(1.0)
    d = F.least(raw * sign, F.lit(1.0))
    theta = F.acos(d)
    near = d > linear_above
    wa = F.when(near, 1 - t).otherwise(F.sin((1 - t) * theta) / F.sin(theta))
    wb = F.when(near, t).otherwise(F.sin(t * theta) / F.sin(theta)) * sign
    mixed = [x * wa + y * wb for x, y in zip(a, b, strict=True)]
    n = F.sqrt(dot(mixed, mixed))
    return [x / n for x in mixed]


def angle_lerp_deg(a, b, t) -> Column:
    """Between two headings in degrees along the short way; the result is not brought back into a range."""
    a, b, t = col(a), col(b), col(t)
    d = b - a
    d = F.when(d > 180, d - 360).when(d < -180, d + 360).otherwise(d)
    return a + d * t
