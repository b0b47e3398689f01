"""Cameras: frame (pinhole with Brown-Conrady distortion), angle table, polynomial; rays and residuals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import Mat, Vec, col, cross, dot, horner, matvec, norm, plus, sub, transpose

#: k1, k2, k3, p1, p2
Distortion = tuple[float, float, float, float, float]
NONE: Distortion = (0.0, 0.0, 0.0, 0.0, 0.0)


def distort(x: Column, y: Column, d: Distortion) -> Vec:
    k1, k2, k3, p1, p2 = d
    r2 = x * x + y * y
    radial = 1 + k1 * r2 + k2 * r2 * r2 + k3 * r2 * r2 * r2
    return [x * radial + 2 * p1 * x * y + p2 * (r2 + 2 * x * x), y * radial + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y]


def undistort(x, y, d: Distortion, steps: int = 10, tol: float = 1e-8) -> Vec:
    """Fixed point, at most ``steps`` times, one expression: a fold over a sequence that stands still once within ``tol``."""
    x, y = col(x), col(y)
    k1, k2, k3, p1, p2 = d

    def step(s, _):
        a, b = s["a"], s["b"]
        r2 = a * a + b * b
        radial = 1 + k1 * r2 + k2 * r2 * r2 + k3 * r2 * r2 * r2
        na = (x - 2 * p1 * a * b - p2 * (r2 + 2 * a * a)) / radial
        nb = (y - p1 * (r2 + 2 * b * b) - 2 * p2 * a * b) / radial
        still = (F.abs(na - a) < tol) & (F.abs(nb - b) < tol)
        return F.struct(F.when(s["done"], a).otherwise(na).alias("a"), F.when(s["done"], b).otherwise(nb).alias("b"), (s["done"] | still).alias("done"))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(x.alias("a"), y.alias("b"), F.lit(False).alias("done")), step)
    return [end["a"], end["b"]]


def project(p: Vec, fx: float, fy: float, cx: float, cy: float, d: Distortion = NONE) -> dict[str, Column]:
    """u, v and valid (in front of the camera) of a point in camera coordinates; null behind it and in its plane."""
    front = p[2] > 0
    xd, yd = F.try_divide(p[0], p[2]), F.try_divide(p[1], p[2])
    if any(d):
        xd, yd = distort(xd, yd, d)
    return {"u": F.when(front, fx * xd + cx), "v": F.when(front, fy * yd + cy), "valid": front}


def project_guarded(p: Vec, fx: float, fy: float, cx: float, cy: float, d: Distortion = NONE, tiny: float = 1e-6) -> Vec:
    """u and v wherever the point is: a depth of 0 counts as ``tiny``, and points behind are projected, too."""
    z = F.when(p[2] == 0, tiny).otherwise(p[2])
    xd, yd = p[0] / z, p[1] / z
    if any(d):
        xd, yd = distort(xd, yd, d)
    return [fx * xd + cx, fy * yd + cy]


def in_image(u, v, width: int, height: int) -> Column:
    """Half-open bounds."""
    u, v = col(u), col(v)
    return F.coalesce((u >= 0) & (u < width) & (v >= 0) & (v < height), F.lit(False))


def projection_jacobian(p: Vec, fx: float, fy: float) -> Mat:
    """Derivatives of u and v by the camera coordinates, without distortion; zeros at and behind the camera."""
    x, y, z = p
    o, front = F.lit(0.0), z > 0
    safe = F.when(front, z).otherwise(1.0)
    of = lambda c: F.when(front, c).otherwise(0.0)
    return [[of(fx / safe), o, of(-fx * x / (safe * safe))], [o, of(fy / safe), of(-fy * y / (safe * safe))]]


def reprojection_error(u, v, pu, pv) -> Column:
    """Distance in pixels; null where the projection is."""
    du, dv = col(u) - col(pu), col(v) - col(pv)
    return F.sqrt(du * du + dv * dv)


def photo_to_pixel(x, y, width: int, height: int, v_up: bool = True) -> Vec:
    """Photo coordinates from the centre to pixels from the upper left; left alone where the size is unknown."""
    x, y = col(x), col(y)
    if not width or not height:
        return [x, y]
    return [x + width / 2, height / 2 - y if v_up else y + height / 2]


def focal_pixels(focal_mm, pixel_mm, focal_px=None) -> Column:
    """Focal length in pixels: given as such, else from millimetres."""
    own = col(focal_mm) / col(pixel_mm)
    return own if focal_px is None else F.coalesce(col(focal_px), own)


def fov_to_focal(pixels: int, fov_deg: float) -> Column:
    return F.lit(pixels / 2.0) / F.tan(F.radians(F.lit(fov_deg / 2.0)))


def pixel_angle(u, focal: float, centre: float) -> Column:
    return F.atan2(col(u) - centre, F.lit(float(focal)))


def angle_pixel(theta, focal: float, centre: float) -> Column:
    return focal * F.tan(col(theta)) + centre


def distort_line(x: Column, y: Column, k1: float, k2: float, p1: float, p2: float) -> Column:
    """Across-track coordinate only, for a line of pixels: two radial terms."""
    r2 = x * x + y * y
    return x * (1 + k1 * r2 + k2 * r2 * r2) + 2 * p1 * x * y + p2 * (r2 + 2 * x * x)


def distort_swapped(x: Column, y: Column, k1: float, k2: float, p1: float, p2: float) -> Vec:
    """The same with both coordinates and the tangential terms exchanged, as another writer of parameters has them."""
    return distort(x, y, (k1, k2, 0.0, p2, p1))


def project_angles(across_deg, along_deg, f: float, cx: float, cy: float, d: Distortion) -> Vec:
    """u, v of a direction given by its two angles, through the full lens model."""
    xd, yd = distort(F.tan(F.radians(col(across_deg))), F.tan(F.radians(col(along_deg))), d)
    return [f * xd + cx, f * yd + cy]


def interpolate(x, xs: list[float], ys: list[float], outside: str | float = "clamp") -> Column:
    """Piecewise linear through a short table of rising xs; one expression per row.

    Beyond its ends: constant ('clamp'), along the last piece ('extrapolate'), or a number.
    """
    x = col(x)
    if outside != "clamp":
        inner = interpolate(x, xs, ys)
        if outside != "extrapolate":
            return F.when(x.isNull(), None).when((x < xs[0]) | (x > xs[-1]), float(outside)).otherwise(inner)
        line = lambda k: float(ys[k]) + (x - float(xs[k])) * (float(ys[k + 1] - ys[k]) / float(xs[k + 1] - xs[k]))
        return F.when(x < xs[0], line(0)).when(x > xs[-1], line(len(xs) - 2)).otherwise(inner)
    pairs = F.array(*[F.struct(F.lit(float(a)).alias("x0"), F.lit(float(b)).alias("x1"), F.lit(float(c)).alias("y0"), F.lit(float(d)).alias("y1")) for a, b, c, d in zip(xs, xs[1:], ys, ys[1:], strict=False)])
    at = F.element_at(F.filter(pairs, lambda s: x <= s["x1"]), 1)
    t = (x - at["x0"]) / (at["x1"] - at["x0"])
    return F.when(x.isNull(), None).when(x <= xs[0], float(ys[0])).when(x >= xs[-1], float(ys[-1])).otherwise(at["y0"] + t * (at["y1"] - at["y0"]))


def table_pixel(theta_deg, table: list[float]) -> dict[str, Column]:
    """Pixel of an across-track angle by the table of pixel angles, and whether the angle itself is in the field of view."""
    theta = col(theta_deg)
    return {"u": interpolate(theta, list(table), [float(i) for i in range(len(table))]), "in_fov": F.coalesce((theta >= table[0]) & (theta <= table[-1]), F.lit(False))}


@dataclass(frozen=True)
class TableCamera:
    """A line of pixels by a table of across-track angles (degrees, rising), the smile of the line and an affine correction in flight.

    Camera axes: x across, y along (backward), z down. The smile is a polynomial of the angle in
    degrees, constant first, that gives degrees forward, hence its sign. In flight tangents are
    scaled by f_lab / f and shifted by the principal point over f. ``first`` is the sample of the
    table's first pixel.
    """

    table: tuple[float, ...]
    smile: tuple[float, ...] = (0.0,)
    f_lab: float = 1.0
    f: float = 1.0
    cx: float = 0.0
    cy: float = 0.0
    first: int = 0

    def __post_init__(self):
        if self.f <= 0:
            raise ValueError(f"focal length {self.f} is not positive")
        if any(b <= a for a, b in zip(self.table, self.table[1:], strict=False)):
            raise ValueError("the table of angles does not rise")

    @property
    def scale(self) -> float:
        return self.f_lab / self.f

    @property
    def shift(self) -> tuple[float, float]:
        return self.cx / self.f, self.cy / self.f

    def along(self, theta_deg) -> Column:
        """Tangent along track, in the lab, of the pixel that looks across at an angle."""
        return -F.tan(F.radians(horner(list(self.smile), col(theta_deg))))

    def ray(self, u) -> Vec:
        """Direction of a pixel of the table."""
        theta = interpolate(u, [float(k) for k in range(len(self.table))], list(self.table))
        return [self.scale * F.tan(F.radians(theta)) - self.shift[0], self.scale * self.along(theta) - self.shift[1], F.lit(1.0)]

    def angle(self, p: Vec) -> Column:
        """Across-track angle in the lab, in degrees; null in the camera's plane."""
        return F.degrees(F.atan((F.try_divide(p[0], p[2]) + self.shift[0]) / self.scale))

    def pixel(self, p: Vec) -> Column:
        """Pixel of a point, cut off at the ends: ``in_view`` tells whether it is one."""
        return table_pixel(self.angle(p), self.table)["u"]

    def sample(self, u) -> Column:
        return col(u) + float(self.first)

    def in_view(self, p: Vec) -> Column:
        """By the angle itself, not the cut-off pixel."""
        return table_pixel(self.angle(p), self.table)["in_fov"]

    def residual(self, p: Vec) -> Column:
        """What the scan-line solver brings to zero: the tangent along track less the one of the pixel that sees the point."""
        theta = F.greatest(F.least(self.angle(p), F.lit(float(self.table[-1]))), F.lit(float(self.table[0])))
        return F.try_divide(p[1], p[2]) - (self.scale * self.along(theta) - self.shift[1])


@dataclass(frozen=True)
class PolynomialCamera:
    """A line of ``width`` pixels by a focal length, a principal point and two polynomials of (u - width / 2) / width, constant first, in pixels."""

    f: float
    centre: float
    width: int
    across: tuple[float, ...] = (0.0,)
    along: tuple[float, ...] = (0.0,)
    first: int = 0

    def _xi(self, u: Column) -> Column:
        return (u - self.width / 2) / float(self.width)

    def distortion(self, u) -> Vec:
        x = self._xi(col(u))
        return [horner(list(self.across), x), horner(list(self.along), x)]

    def derivative(self, u) -> Column:
        """Of the across-track distortion by u."""
        return horner([k * c for k, c in enumerate(self.across)][1:] or [0.0], self._xi(col(u))) / float(self.width)

    def ray(self, u) -> Vec:
        dx, dy = self.distortion(u)
        return [(col(u) + dx - self.centre) / self.f, dy / self.f, F.lit(1.0)]

    def pixel(self, p: Vec, steps: int = 8) -> Column:
        """Newton on u + distortion(u) = the undistorted pixel: a fold over a sequence, one expression."""
        ideal = self.f * F.try_divide(p[0], p[2]) + self.centre
        step = lambda u, _: u - (u + self.distortion(u)[0] - ideal) / (1 + self.derivative(u))
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), ideal, step)

    def sample(self, u) -> Column:
        return col(u) + float(self.first)

    def edges(self) -> tuple[float, float]:
        """Tangents of the first and the last pixel."""
        at = lambda u: (u + sum(c * ((u - self.width / 2) / self.width) ** k for k, c in enumerate(self.across)) - self.centre) / self.f
        return at(0.0), at(self.width - 1.0)

    def in_view(self, p: Vec) -> Column:
        low, high = self.edges()
        x = F.try_divide(p[0], p[2])
        return F.coalesce((x >= low) & (x <= high), F.lit(False))

    def residual(self, p: Vec) -> Column:
        return F.try_divide(p[1], p[2]) - self.distortion(self.pixel(p))[1] / self.f


def angles_to_distortion(u, across_deg, along_deg, f: float, centre: float) -> Vec:
    """A table of angles as distortion in pixels: across and along track."""
    return [f * F.tan(F.radians(col(across_deg))) + centre - col(u), f * F.tan(F.radians(col(along_deg)))]


def distortion_to_angles(u, dx, dy, f: float, centre: float) -> Vec:
    """The angles in degrees back from distortion; along track forward, so its sign turns."""
    return [F.degrees(F.atan((col(u) + col(dx) - centre) / f)), -F.degrees(F.atan(col(dy) / f))]


def ground_error(error_arcsec, height) -> Column:
    """Metres on the ground of an angle in seconds of arc, from a height above it."""
    return col(height) * F.tan(F.radians(col(error_arcsec) / 3600))


def poly_inverse(target, coefficients: list[float], start, steps: int = 8) -> Column:
    """Newton on a polynomial: a fold over a sequence, one expression."""
    derivative = [k * c for k, c in enumerate(coefficients)][1:] or [0.0]
    target = col(target)
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), col(start), lambda u, _: u - (horner(coefficients, u) - target) / horner(derivative, u))


def pixel_ray_world(u, v, f: float, cx: float, cy: float, to_world: Mat) -> Vec:
    ray = [(col(u) - cx) / f, (col(v) - cy) / f, F.lit(1.0)]
    n = norm(ray)
    return matvec(to_world, [x / n for x in ray])


def camera_position(imu: Vec, body_to_world: Mat, lever: Vec) -> Vec:
    """The lever arm is added to the position of the inertial unit."""
    return plus(imu, matvec(body_to_world, lever))


def to_camera(point: Vec, imu: Vec, body_to_world: Mat, body_to_camera: Mat, lever: Vec, sign: int = -1) -> Vec:
    """A point in camera coordinates. The lever arm is taken from the vector to the point; sign=1 adds it, as some files were made."""
    body = matvec(transpose(body_to_world), sub(point, imu))
    return matvec(body_to_camera, [x + sign * y for x, y in zip(body, lever, strict=True)])


def point_ray_distance(point: Vec, origin: Vec, direction: Vec) -> Column:
    """Null for a ray without a direction."""
    return F.try_divide(norm(cross(sub(point, origin), direction)), norm(direction))


def two_rays(a: Vec, da: Vec, b: Vec, db: Vec, parallel: float = 1e-7) -> dict[str, Column]:
    """Midpoint of the shortest line between two rays, and its length; null where they are parallel."""
    n = cross(da, db)
    n2 = dot(n, n)
    w = sub(b, a)
    t, s = F.try_divide(dot(cross(w, db), n), n2), F.try_divide(dot(cross(w, da), n), n2)
    p, q = [x + d * t for x, d in zip(a, da, strict=True)], [x + d * s for x, d in zip(b, db, strict=True)]
    ok = F.sqrt(n2) >= parallel
    return {"x": F.when(ok, (p[0] + q[0]) / 2), "y": F.when(ok, (p[1] + q[1]) / 2), "z": F.when(ok, (p[2] + q[2]) / 2), "miss": F.when(ok, norm(sub(p, q)))}


def rigid(m: Mat, t: Vec, v: Vec) -> Vec:
    return plus(matvec(m, v), t)


def rigid_inverse(m: Mat, t: Vec, v: Vec) -> Vec:
    return matvec(transpose(m), sub(v, t))


def ground_on_plane(origin: Vec, ray: Vec, height) -> Vec:
    """Where a ray meets the horizontal plane at a height; null for a level ray."""
    k = F.try_divide(col(height) - origin[2], ray[2])
    return [o + r * k for o, r in zip(origin, ray, strict=True)]
