"""Vectors, rotations, planes, lines, triangles and shapes as column expressions; all of it stays in generated code.

A vector is a tuple of three columns. A null in any part of an argument gives null.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = Sequence[Column]
INF = float("inf")


def vec(prefix: str, names: Sequence[str] = ("x", "y", "z"), sep: str = "_") -> list[Column]:
    """Columns prefix_x, prefix_y, prefix_z; with an empty prefix x, y, z."""
    return [F.col(f"{prefix}{sep}{n}" if prefix else n) for n in names]


def point(*values: float) -> list[Column]:
    return [F.lit(float(v)) for v in values]


def add(a: Vec, b: Vec) -> list[Column]:
    return [x + y for x, y in zip(a, b, strict=True)]


def subtract(a: Vec, b: Vec) -> list[Column]:
    return [x - y for x, y in zip(a, b, strict=True)]


def scale(a: Vec, by: Column | float, invert: bool = False) -> list[Column]:
    return [x / by if invert else x * by for x in a]


def dot(a: Vec, b: Vec) -> Column:
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        out = out + x * y
    return out


def cross(a: Vec, b: Vec) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def norm(a: Vec, square: bool = False, invert: bool = False) -> Column:
    out = dot(a, a) if square else F.sqrt(dot(a, a))
    return 1 / out if invert else out


def normalize(a: Vec, factor: Column | float = 1.0) -> list[Column]:
    return scale(a, factor / norm(a) if isinstance(factor, Column) else F.lit(float(factor)) / norm(a))


def normal(u: Vec, v: Vec, w: Vec) -> list[Column]:
    """Normal of a triangle, (u - v) x (w - v), of length 1; documented elsewhere with the opposite sign, kept as computed there."""
    return normalize(cross(subtract(u, v), subtract(w, v)))


def distance(a: Vec, b: Vec) -> Column:
    return norm(subtract(a, b))


# --- rotations ---------------------------------------------------------------------------------------------------------


def rotation(roll: Column, pitch: Column, yaw: Column) -> list[list[Column]]:
    """Matrix Rz(yaw) Ry(pitch) Rx(roll)."""
    cr, sr, cp, sp, cy, sy = F.cos(roll), F.sin(roll), F.cos(pitch), F.sin(pitch), F.cos(yaw), F.sin(yaw)
    return [
        [cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr],
        [sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr],
        [-sp, cp * sr, cp * cr],
    ]


def transpose(m: Sequence[Vec]) -> list[list[Column]]:
    return [[m[j][i] for j in range(3)] for i in range(3)]


def rotate(m: Sequence[Vec], a: Vec) -> list[Column]:
    return [dot(row, a) for row in m]


def compose(m: Sequence[Vec], n: Sequence[Vec]) -> list[list[Column]]:
    columns = transpose(n)
    return [[dot(row, c) for c in columns] for row in m]


def euler(m: Sequence[Vec]) -> list[Column]:
    """roll, pitch, yaw of a matrix; at a pitch of 90 degrees roll is taken as 0."""
    up = F.abs(m[2][0]) >= 1 - 1e-12
    pitch = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -m[2][0])))
    roll = F.when(up, F.lit(0.0)).otherwise(F.atan2(m[2][1], m[2][2]))
    yaw = F.when(up, F.atan2(-m[0][1], m[1][1])).otherwise(F.atan2(m[1][0], m[0][0]))
    return [roll, pitch, yaw]


def quaternion(roll: Column, pitch: Column, yaw: Column) -> list[Column]:
    """w, x, y, z of Rz Ry Rx."""
    cr, sr, cp, sp, cy, sy = F.cos(roll / 2), F.sin(roll / 2), F.cos(pitch / 2), F.sin(pitch / 2), F.cos(yaw / 2), F.sin(yaw / 2)
    return [cr * cp * cy + sr * sp * sy, sr * cp * cy - cr * sp * sy, cr * sp * cy + sr * cp * sy, cr * cp * sy - sr * sp * cy]


def quaternion_matrix(q: Vec) -> list[list[Column]]:
    """Matrix of a quaternion w, x, y, z of any length but 0."""
    w, x, y, z = scale(q, norm(q), invert=True)
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]


def quaternion_product(a: Vec, b: Vec) -> list[Column]:
    return [
        a[0] * b[0] - a[1] * b[1] - a[2] * b[2] - a[3] * b[3],
        a[0] * b[1] + a[1] * b[0] + a[2] * b[3] - a[3] * b[2],
        a[0] * b[2] - a[1] * b[3] + a[2] * b[0] + a[3] * b[1],
        a[0] * b[3] + a[1] * b[2] - a[2] * b[1] + a[3] * b[0],
    ]


def slerp(a: Vec, b: Vec, share: Column) -> list[Column]:
    """Quaternion between a and b along the shorter arc; nearly equal ones are mixed linearly."""
    d = dot(a, b)
    b = [F.when(d < 0, -v).otherwise(v) for v in b]
    d = F.least(F.abs(d), F.lit(1.0))
    angle = F.acos(d)
    close = d > 1 - 1e-12
    wa = F.when(close, 1 - share).otherwise(F.sin((1 - share) * angle) / F.sin(angle))
    wb = F.when(close, share).otherwise(F.sin(share * angle) / F.sin(angle))
    return [wa * x + wb * y for x, y in zip(a, b, strict=True)]


def axis_angle_matrix(axis: Vec, angle: Column) -> list[list[Column]]:
    x, y, z = normalize(axis)
    c, s = F.cos(angle), F.sin(angle)
    t = 1 - c
    return [[t * x * x + c, t * x * y - s * z, t * x * z + s * y], [t * x * y + s * z, t * y * y + c, t * y * z - s * x], [t * x * z - s * y, t * y * z + s * x, t * z * z + c]]


def matrix_axis_angle(m: Sequence[Vec]) -> list[Column]:
    """axis x, y, z and angle of a rotation matrix; no rotation has the axis x, a half turn the axis of its largest diagonal entry."""
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (m[0][0] + m[1][1] + m[2][2] - 1) / 2))
    angle = F.acos(cosine)
    raw = [m[2][1] - m[1][2], m[0][2] - m[2][0], m[1][0] - m[0][1]]
    size = norm(raw)
    squares = [F.sqrt(F.greatest(F.lit(0.0), (m[i][i] + 1) / 2)) for i in range(3)]
    k = F.when((squares[0] >= squares[1]) & (squares[0] >= squares[2]), F.lit(0)).when(squares[1] >= squares[2], F.lit(1)).otherwise(F.lit(2))
    half = []
    for i in range(3):
        off = [squares[i] if i == j else (m[i][j] + m[j][i]) / (4 * squares[j]) for j in range(3)]
        half.append(F.when(k == 0, off[0]).when(k == 1, off[1]).otherwise(off[2]))
    turned, halfway = size > 1e-12, cosine < 0
    return [F.when(turned, raw[i] / size).when(halfway, half[i]).otherwise(F.lit(1.0 if i == 0 else 0.0)) for i in range(3)] + [angle]


def convert_rotation(source: str, target: str, values: Sequence[Column]) -> list[Column]:
    """Any of euler (roll, pitch, yaw), quaternion (w, x, y, z), axis-angle (x, y, z, angle), scaled-axis-angle (x, y, z), matrix (9 by rows) into any other."""
    if source == "euler":
        m = rotation(*values)
    elif source == "quaternion":
        m = quaternion_matrix(values)
    elif source == "axis-angle":
        m = axis_angle_matrix(values[:3], values[3])
    elif source == "scaled-axis-angle":
        angle = norm(values)
        m = axis_angle_matrix([F.when(angle > 0, v).otherwise(F.lit(1.0 if i == 0 else 0.0)) for i, v in enumerate(values)], angle)
    elif source == "matrix":
        m = [list(values[3 * i : 3 * i + 3]) for i in range(3)]
    else:
        raise ValueError(f"no such rotation: {source}")
    if target == "matrix":
        return [v for row in m for v in row]
    if target == "euler":
        return euler(m)
    axis = matrix_axis_angle(m)
    if target == "axis-angle":
        return axis
    if target == "scaled-axis-angle":
        return scale(axis[:3], axis[3])
    if target == "quaternion":
        return [F.cos(axis[3] / 2), *scale(axis[:3], F.sin(axis[3] / 2))]
    raise ValueError(f"no such rotation: {target}")


def from_frame(p: Vec, position: Vec, angles: Vec) -> list[Column]:
    """A point given in a frame, in the frame's parent: R p + t."""
    return add(rotate(rotation(*angles), p), position)


def to_frame(p: Vec, position: Vec, angles: Vec) -> list[Column]:
    """A point given in the parent, in the frame: R^T (p - t)."""
    return rotate(transpose(rotation(*angles)), subtract(p, position))


# --- polar -------------------------------------------------------------------------------------------------------------


def wrap(angle: Column) -> Column:
    """Into [-pi, pi)."""
    return F.pmod(angle + math.pi, F.lit(2 * math.pi)) - math.pi


def to_cartesian(range_: Column, bearing: Column, elevation: Column) -> list[Column]:
    return [range_ * F.cos(elevation) * F.cos(bearing), range_ * F.cos(elevation) * F.sin(bearing), range_ * F.sin(elevation)]


def to_polar(a: Vec) -> list[Column]:
    """range, bearing, elevation; all 0 for the zero vector."""
    r = norm(a)
    none = r == 0
    return [r, F.when(none, F.lit(0.0)).otherwise(wrap(F.atan2(a[1], a[0]))), F.when(none, F.lit(0.0)).otherwise(math.pi / 2 - F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), a[2] / r))))]


def normal_polar(range_: Column, bearing: Column, elevation: Column) -> list[Column]:
    """The same direction with range not negative, bearing in [-pi, pi), elevation in [-pi/2, pi/2]."""
    flip = range_ < 0
    r = F.abs(range_)
    b = F.when(flip, bearing + math.pi).otherwise(bearing)
    e = wrap(F.when(flip, -elevation).otherwise(elevation))
    over = F.abs(e) > math.pi / 2
    e2 = F.when(over, F.signum(e) * math.pi - e).otherwise(e)
    return [r, wrap(F.when(over, b + math.pi).otherwise(b)), e2]


# --- planes, lines, triangles --------------------------------------------------------------------------------------------


def project_on_plane(p: Vec, origin: Vec, plane_normal: Vec) -> list[Column]:
    """Projection x, y, z and the signed distance from the plane."""
    n = normalize(plane_normal)
    d = dot(subtract(p, origin), n)
    return [*subtract(p, scale(n, d)), d]


def project_on_line(p: Vec, first: Vec, second: Vec) -> list[Column]:
    """Projection x, y, z, distance, and where it is: -1 before first, 0 between, 1 past second."""
    along = subtract(second, first)
    share = dot(subtract(p, first), along) / dot(along, along)
    foot = add(first, scale(along, share))
    return [*foot, distance(p, foot), F.when(share < 0, F.lit(-1)).when(share > 1, F.lit(1)).otherwise(F.lit(0))]


def line_meets_plane(first: Vec, second: Vec, origin: Vec, plane_normal: Vec) -> list[Column]:
    """Where the line meets the plane: infinity if parallel to it; first if that lies on it."""
    up = dot(subtract(origin, first), plane_normal)
    slope = dot(subtract(second, first), plane_normal)
    on, parallel = F.abs(up) < 1e-12, F.abs(slope) < 1e-12
    return [F.when(on, a).when(parallel, F.lit(INF)).otherwise(a + (b - a) * up / slope) for a, b in zip(first, second, strict=True)]


def nearest_of_lines(a0: Vec, a1: Vec, b0: Vec, b1: Vec) -> list[Column]:
    """The nearest points (x, y, z each) of two lines; null if they are parallel."""
    u, v, w = subtract(a1, a0), subtract(b1, b0), subtract(a0, b0)
    uu, uv, vv, uw, vw = dot(u, u), dot(u, v), dot(v, v), dot(u, w), dot(v, w)
    det = uu * vv - uv * uv
    ok = F.abs(det) > 1e-12 * uu * vv
    s, t = F.when(ok, (uv * vw - vv * uw) / det), F.when(ok, (uu * vw - uv * uw) / det)
    return [*add(a0, scale(u, s)), *add(b0, scale(v, t))]


def triangle_area(a: Vec, b: Vec, c: Vec) -> Column:
    return norm(cross(subtract(b, a), subtract(c, a))) / 2


def angle_axis(a: Vec, b: Vec) -> list[Column]:
    """Axis x, y, z and angle of the shortest turn from a to b; 0, 0, 0, 0 if they are parallel, null or zero."""
    c = cross(a, b)
    size = norm(c)
    ok = F.coalesce(size > 0, F.lit(False))
    return [*[F.when(ok, v / size).otherwise(F.lit(0.0)) for v in c], F.when(ok, F.atan2(size, dot(a, b))).otherwise(F.when(F.coalesce(dot(a, b) < 0, F.lit(False)), F.lit(math.pi)).otherwise(F.lit(0.0)))]


# --- shapes --------------------------------------------------------------------------------------------------------------


def in_box(p: Vec, low: Sequence[float], high: Sequence[float], inflate: float = 0.0, position: Sequence[float] = (0, 0, 0), angles: Sequence[float] = (0, 0, 0)) -> Column:
    """Inside a box, border included; the box may be moved and turned about its frame's origin."""
    q = to_frame(p, point(*position), point(*angles)) if any(position) or any(angles) else list(p)
    out = None
    for v, a, b in zip(q, low, high, strict=True):
        c = (v >= a - inflate) & (v <= b + inflate)
        out = c if out is None else out & c
    return out


def box_from(begin: Sequence[float] | None = None, end: Sequence[float] | None = None, centre: Sequence[float] | None = None, size: Sequence[float] | None = None) -> tuple[list[float], list[float]]:
    """Low and high corner from any two of begin, end, centre and size."""
    if begin is not None and end is not None:
        a, b = list(begin), list(end)
    elif begin is not None and size is not None:
        a, b = list(begin), [x + s for x, s in zip(begin, size, strict=True)]
    elif end is not None and size is not None:
        a, b = [x - s for x, s in zip(end, size, strict=True)], list(end)
    elif centre is not None and size is not None:
        a, b = [x - s / 2 for x, s in zip(centre, size, strict=True)], [x + s / 2 for x, s in zip(centre, size, strict=True)]
    elif centre is not None and begin is not None:
        a, b = list(begin), [2 * c - x for c, x in zip(centre, begin, strict=True)]
    elif centre is not None and end is not None:
        a, b = [2 * c - x for c, x in zip(centre, end, strict=True)], list(end)
    else:
        raise ValueError("a box needs two of begin, end, centre and size")
    return [min(x, y) for x, y in zip(a, b, strict=True)], [max(x, y) for x, y in zip(a, b, strict=True)]


def in_planes(p: Vec, planes: Sequence[tuple[Sequence[float], float]], inflate: float = 0.0) -> Column:
    """Inside a polytope: n . p <= distance for each plane (normal, distance); normals are scaled to length 1."""
    out = F.lit(True)
    for n, d in planes:
        size = math.sqrt(sum(v * v for v in n))
        out = out & (dot(p, point(*[v / size for v in n])) <= d / size + inflate)
    return out


def prism_planes(corners: Sequence[Sequence[float]], axis: Sequence[float]) -> list[tuple[list[float], float]]:
    """Planes of a convex prism from its base's corners (anticlockwise about axis) and the axis from base to top."""
    size = math.sqrt(sum(v * v for v in axis))
    up = [v / size for v in axis]
    product = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    out = [([-v for v in up], -product(up, corners[0])), (up, product(up, corners[0]) + size)]
    for a, b in zip(corners, [*corners[1:], corners[0]], strict=True):
        e = [y - x for x, y in zip(a, b, strict=True)]
        n = [e[1] * up[2] - e[2] * up[1], e[2] * up[0] - e[0] * up[2], e[0] * up[1] - e[1] * up[0]]
        out.append((n, product(n, a)))
    return out


def in_polygon(x: Column, y: Column, ring: Sequence[tuple[float, float]], border: bool = False) -> Column:
    """Inside a polygon by crossings of a ray; the border counts if border is true."""
    odd, on = F.lit(0), F.lit(False)
    for (x0, y0), (x1, y1) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if y0 != y1:
            hit = ((F.lit(y0) > y) != (F.lit(y1) > y)) & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0)
            odd = odd + hit.cast("int")
        level = (x - x0) * (y1 - y0) == (y - y0) * (x1 - x0)
        on = on | (level & (x >= min(x0, x1)) & (x <= max(x0, x1)) & (y >= min(y0, y1)) & (y <= max(y0, y1)))
    return (odd % 2 == 1) & ~on | (on if border else F.lit(False))


def segment_crosses(x0: Column, y0: Column, x1: Column, y1: Column, ring: Sequence[tuple[float, float]]) -> Column:
    """Whether a segment crosses or touches the border of a polygon."""
    side = lambda px, py, qx, qy, rx, ry: F.signum((qx - px) * (ry - py) - (qy - py) * (rx - px))
    out = F.lit(False)
    for (a, b), (c, d) in zip(ring, [*ring[1:], ring[0]], strict=True):
        a, b, c, d = map(F.lit, map(float, (a, b, c, d)))
        apart = (F.greatest(x0, x1) < F.least(a, c)) | (F.greatest(a, c) < F.least(x0, x1)) | (F.greatest(y0, y1) < F.least(b, d)) | (F.greatest(b, d) < F.least(y0, y1))
        out = out | (~apart & (side(x0, y0, x1, y1, a, b) * side(x0, y0, x1, y1, c, d) <= 0) & (side(a, b, c, d, x0, y0) * side(a, b, c, d, x1, y1) <= 0))
    return out


def in_spheres(p: Vec, spheres: Sequence[tuple[Sequence[float], float]]) -> list[Column]:
    """One condition for each sphere (centre, radius)."""
    return [dot(subtract(p, point(*c)), subtract(p, point(*c))) <= r * r for c, r in spheres]


def all_or_any(flags: Sequence[Column], any_: bool = False, negate: bool = False) -> Column:
    """All of the flags or any of them; negate turns each flag round first, so that not all becomes none, and none not all."""
    flags = [~f for f in flags] if negate else list(flags)
    out = flags[0]
    for f in flags[1:]:
        out = out | f if any_ != negate else out & f
    return out


# --- colours and cameras ---------------------------------------------------------------------------------------------------

#: Fixed values (ITU-R BT.601): weights of red and blue in luma.
KR, KB = 0.299, 0.114


def rgb_to_ypbpr(r: Column, g: Column, b: Column) -> list[Column]:
    """RGB in 0..1 to luma in 0..1 and colour differences in -0.5..0.5."""
    y = KR * r + (1 - KR - KB) * g + KB * b
    return [y, (b - y) / (2 * (1 - KB)), (r - y) / (2 * (1 - KR))]


def ypbpr_to_rgb(y: Column, pb: Column, pr: Column) -> list[Column]:
    r, b = y + 2 * (1 - KR) * pr, y + 2 * (1 - KB) * pb
    return [r, (y - KR * r - KB * b) / (1 - KR - KB), b]


def rgb_to_ycbcr(r: Column, g: Column, b: Column) -> list[Column]:
    """RGB in 0..255 to digital luma 16..235 and differences 16..240, not rounded."""
    y, pb, pr = rgb_to_ypbpr(r / 255, g / 255, b / 255)
    return [16 + 219 * y, 128 + 224 * pb, 128 + 224 * pr]


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column) -> list[Column]:
    return [255 * c for c in ypbpr_to_rgb((y - 16) / 219, (cb - 128) / 224, (cr - 128) / 224)]


def pixel_to_cartesian(px: Column, py: Column, focal: float, principal: tuple[float, float], pixel_size: float = 1.0) -> list[Column]:
    """Pixel to the camera's frame: x right, y down, z the focal length; pinhole camera without distortion."""
    return [(px - principal[0]) * pixel_size, (py - principal[1]) * pixel_size, F.lit(float(focal))]


def distort(x: Column, y: Column, radial: Sequence[float], tangential: Sequence[float] = (0.0, 0.0)) -> list[Column]:
    """Brown's model on normalised image coordinates: k1, k2, k3 and p1, p2."""
    r2 = x * x + y * y
    k = [*radial, 0.0, 0.0, 0.0][:3]
    p1, p2 = tangential
    f = 1 + r2 * (k[0] + r2 * (k[1] + r2 * k[2]))
    return [x * f + 2 * p1 * x * y + p2 * (r2 + 2 * x * x), y * f + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y]


def undistort(x: Column, y: Column, radial: Sequence[float], tangential: Sequence[float] = (0.0, 0.0), rounds: int = 8) -> list[Column]:
    """Inverse of distort by fixed-point steps, folded over an array so that the expression stays small."""
    k = [*radial, 0.0, 0.0, 0.0][:3]
    p1, p2 = tangential

    def step(s: Column, _: Column) -> Column:
        u, v = s["x"], s["y"]
        r2 = u * u + v * v
        f = 1 + r2 * (k[0] + r2 * (k[1] + r2 * k[2]))
        return F.struct(((x - (2 * p1 * u * v + p2 * (r2 + 2 * u * u))) / f).alias("x"), ((y - (p1 * (r2 + 2 * v * v) + 2 * p2 * u * v)) / f).alias("y"))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")), step)
    return [end["x"], end["y"]]


def stereo_point(left_x: Column, right_x: Column, py: Column, focal: float, baseline: float, principal: tuple[float, float]) -> list[Column]:
    """x, y, z of a pixel seen by two rectified cameras; null without disparity."""
    disparity = left_x - right_x
    z = F.when(disparity != 0, focal * baseline / disparity)
    return [(left_x - principal[0]) * z / focal, (py - principal[1]) * z / focal, z]
