"""Angles, quaternions, rigid poses and small numeric helpers as plain column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2 * math.pi
STEER_RANGE = 3 * math.pi  # raw steering of 3*pi is full lock


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quat_to_yaw(qx, qy, qz, qw) -> Column:
    qx, qy, qz, qw = map(col, (qx, qy, qz, qw))
    return F.atan2(2 * (qw * qz + qx * qy), 1 - 2 * (qy * qy + qz * qz))


def quat_norm(qx, qy, qz, qw) -> Column:
    qx, qy, qz, qw = map(col, (qx, qy, qz, qw))
    return F.sqrt(qx * qx + qy * qy + qz * qz + qw * qw)


def quat_normalize(qx, qy, qz, qw) -> list[Column]:
    n = quat_norm(qx, qy, qz, qw)
    return [col(c) / n for c in (qx, qy, qz, qw)]


def wrap_deg(a) -> Column:
    """[-180, 180) with a floor modulo; the plain ``%`` keeps the sign and would be wrong."""
    return F.pmod(col(a) + 180.0, F.lit(360.0)) - 180.0


def wrap_rad(a) -> Column:
    return F.pmod(col(a) + math.pi, F.lit(TWO_PI)) - math.pi


def heading(x0, y0, x1, y1, still: float = 0.001) -> Column:
    """Direction of motion in degrees [0, 360); NULL when the step is below ``still`` on both axes."""
    dx, dy = col(x1) - col(x0), col(y1) - col(y0)
    moving = ~((F.abs(dx) < still) & (F.abs(dy) < still))
    return F.when(moving, F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(360.0)))


def rear_offset(x, y, yaw_deg, offset: float = -1.393) -> tuple[Column, Column]:
    a = F.radians(col(yaw_deg))
    return col(x) - F.cos(a) * offset, col(y) - F.sin(a) * offset


def yaw_to_sim(axis_angle, yaw) -> Column:
    """Yaw in the source frame (rad) to the y-down simulation frame (deg)."""
    return F.pmod(F.degrees(col(axis_angle) - col(yaw) + math.pi / 2), F.lit(360.0))


def rotation(qx, qy, qz, qw) -> list[list[Column]]:
    """Rotation matrix of a quaternion, normalised by its squared norm."""
    qx, qy, qz, qw = map(col, (qx, qy, qz, qw))
    s = 2.0 / (qx * qx + qy * qy + qz * qz + qw * qw)
    return [
        [1 - s * (qy * qy + qz * qz), s * (qx * qy - qz * qw), s * (qx * qz + qy * qw)],
        [s * (qx * qy + qz * qw), 1 - s * (qx * qx + qz * qz), s * (qy * qz - qx * qw)],
        [s * (qx * qz - qy * qw), s * (qy * qz + qx * qw), 1 - s * (qx * qx + qy * qy)],
    ]


def static_pose(quat: tuple, trans: tuple) -> list[list[float]]:
    """3x4 matrix of fixed numbers from a quaternion (x, y, z, w) and a translation."""
    x, y, z, w = quat
    s = 2.0 / (x * x + y * y + z * z + w * w)
    rot = [
        [1 - s * (y * y + z * z), s * (x * y - z * w), s * (x * z + y * w)],
        [s * (x * y + z * w), 1 - s * (x * x + z * z), s * (y * z - x * w)],
        [s * (x * z - y * w), s * (y * z + x * w), 1 - s * (x * x + y * y)],
    ]
    return [[*rot[i], float(trans[i])] for i in range(3)]


def compose(a: list[list[float]], b: list[list[float]]) -> list[list[float]]:
    """Product of two fixed 3x4 poses."""
    return [
        [
            sum(a[i][k] * b[k][j] for k in range(3)) + (a[i][3] if j == 3 else 0.0)
            for j in range(4)
        ]
        for i in range(3)
    ]




# Mounting of the sensors on the vehicle (quaternion xyzw, translation in metres).
BODY_TO_IMU = ((0.0, 0.0, 0.7071, 0.7071), (0.0, 0.0, 0.0))
IMU_TO_LIDAR = ((1.0, 0.0, 0.0, 0.0), (0.62, 0.0, 1.43))
LIDAR_TO_CAMERA = (
    (-0.502988, 0.496432, -0.507426, 0.493029),
    (0.580393, 0.0727572, -0.211861),
)


def lidar_chain() -> list[list[float]]:
    return compose(static_pose(*BODY_TO_IMU), static_pose(*IMU_TO_LIDAR))


def camera_chain() -> list[list[float]]:
    return compose(lidar_chain(), static_pose(*LIDAR_TO_CAMERA))


def apply_static(m: list[list[float]], p: tuple, direction: bool = False) -> tuple:
    """Fixed 3x4 pose times a column point (or a direction, which ignores the translation)."""
    x, y, z = map(col, p)
    return tuple(
        m[i][0] * x + m[i][1] * y + m[i][2] * z + (0.0 if direction else m[i][3]) for i in range(3)
    )


def apply_pose(quat: tuple, trans: tuple, p: tuple, direction: bool = False) -> tuple:
    """R(quat) p + t with every part a column."""
    rot = rotation(*quat)
    x, y, z = map(col, p)
    out = []
    for i in range(3):
        v = rot[i][0] * x + rot[i][1] * y + rot[i][2] * z
        out.append(v if direction else v + col(trans[i]))
    return tuple(out)


def ypr_from_c2w(m) -> tuple[Column, Column, Column]:
    """Yaw, pitch, roll of a row-major 3x4 camera-to-world array (12+ elements)."""
    m = col(m)

    def e(i):
        return F.element_at(m, i + 1).cast("double")

    fx, fy, fz = -e(2), -e(6), -e(10)
    pitch = F.asin(F.greatest(F.least(fz, F.lit(1.0)), F.lit(-1.0)))
    cp = F.cos(pitch)
    regular = F.abs(cp) > 1e-6
    yaw = F.when(regular, F.atan2(-fx / cp, fy / cp)).otherwise(F.atan2(e(4), e(0)))
    roll = F.when(regular, F.atan2(-e(8) / cp, e(9) / cp)).otherwise(F.lit(0.0))
    return yaw, pitch, roll


def c2w_from_ypr(x, y, z, yaw, pitch, roll) -> Column:
    """Row-major 3x4 matrix with columns right, up, -forward and the position."""
    yaw, pitch, roll = map(col, (yaw, pitch, roll))
    cy, sy, cp, sp, cr, sr = (
        F.cos(yaw), F.sin(yaw), F.cos(pitch), F.sin(pitch), F.cos(roll), F.sin(roll),
    )
    right = (cy * cr - sy * sp * sr, sy * cr + cy * sp * sr, -cp * sr)
    up = (cy * sr + sy * sp * cr, sy * sr - cy * sp * cr, cp * cr)
    fwd = (-sy * cp, cy * cp, sp)
    pos = (col(x), col(y), col(z))
    return F.array(*[v for i in range(3) for v in (right[i], up[i], -fwd[i], pos[i])])


def grid_convergence(lat, lon, central_meridian: float = 0.0) -> Column:
    lam = F.radians(col(lon) - central_meridian)
    return F.degrees(F.atan(F.tan(lam) * F.sin(F.radians(col(lat)))))


def steer_scale(raw, invert: bool = False, limit: float = 9.0) -> tuple[Column, Column]:
    """Clamped raw command and its share of full lock, optionally sign-inverted."""
    raw = col(raw)
    norm = raw / STEER_RANGE
    return F.greatest(F.least(raw, F.lit(limit)), F.lit(-limit)), (-norm if invert else norm)


def similarity_apply(x, y, z, sim: dict) -> tuple[Column, Column, Column]:
    """scale * R * p + t for a fixed transform ``{"scale", "rotation" 3x3, "translation" 3}``."""
    p = tuple(map(col, (x, y, z)))
    rot, s, t = sim["rotation"], sim["scale"], sim["translation"]
    return tuple(
        s * (rot[i][0] * p[0] + rot[i][1] * p[1] + rot[i][2] * p[2]) + t[i] for i in range(3)
    )


def similarity_yaw(yaw, sim: dict) -> Column:
    """sign * yaw + offset, or the position rotation when the transform has no yaw block."""
    block = sim.get("yaw_alignment")
    if block:
        return block["yaw_sign"] * col(yaw) + block["yaw_offset_rad"]
    theta = math.atan2(sim["rotation"][1][0], sim["rotation"][0][0])
    return -col(yaw) + theta - math.pi / 2


def calibration_inverse(x, y, shift_x, shift_y, yaw_offset: float, x0: float, y0: float):
    """Undo a manual map calibration: rotate by -yaw about the origin, then remove the shift."""
    x, y = col(x), col(y)
    if abs(yaw_offset) > 1e-9:
        c, s = math.cos(-yaw_offset), math.sin(-yaw_offset)
        x, y = x0 + c * (x - x0) - s * (y - y0), y0 + s * (x - x0) + c * (y - y0)
    return x - shift_x, y - shift_y
