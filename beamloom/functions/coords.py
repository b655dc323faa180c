"""Geometry as column expressions. Detector columns come from the broadcast dimension (sources.geometry)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trunc(c: Column) -> Column:
    """Truncation towards zero to int."""
    return c.cast("int")


def half_up(c: Column) -> Column:
    return F.floor(c + 0.5).cast("int")


def is_excluded(name: Column, kind: Column, excluded: list[str]) -> Column:
    return name.isin(excluded) | kind.isin(excluded) if excluded else F.lit(False)


def local_x(col: Column, n: Column, pitch: Column) -> Column:
    return (col - (n - 1) / 2) * pitch


def pixel(x: Column, n: Column, pitch: Column) -> Column:
    return x / pitch + (n - 1) / 2


def to_global(lx: Column, ly: Column, d: str = "") -> tuple[Column, Column, Column]:
    """R * (lx, ly, 0) + position, from columns r00..r21 and x, y, z (prefix d)."""
    c = lambda n: F.col(d + n)
    return tuple(c(f"r{i}0") * lx + c(f"r{i}1") * ly + c(f"p{a}") for i, a in enumerate("xyz"))


def to_local(gx: Column, gy: Column, gz: Column, d: str = "") -> tuple[Column, Column, Column]:
    c = lambda n: F.col(d + n)
    dx, dy, dz = gx - c("px"), gy - c("py"), gz - c("pz")
    return tuple(c(f"r0{i}") * dx + c(f"r1{i}") * dy + c(f"r2{i}") * dz for i in range(3))


def intercept(mx: Column, cx: Column, my: Column, cy: Column, d: str = "") -> tuple[Column, Column, Column]:
    """Where a track meets a detector's plane; the short form for planes that are not tilted."""
    c = lambda n: F.col(d + n)
    top = c("r02") * (c("px") - cx) + c("r12") * (c("py") - cy) + c("r22") * c("pz")
    z = F.when(c("tilt") < 1e-9, c("pz")).otherwise(top / (c("r02") * mx + c("r12") * my + c("r22")))
    return cx + mx * z, cy + my * z, z


def in_ellipse(dx: Column, dy: Column, cut_x, cut_y) -> Column:
    """On the border is inside."""
    u, v = dx / cut_x, dy / cut_y
    return u * u + v * v <= 1


def has_intercept(col: Column, y: Column, n_cols: Column, size_y: Column, pitch_y: Column, tolerance: float, row: Column | None = None, step_y: Column | None = None) -> Column:
    """Columns are bounded by their number, rows by the physical height; borders are inside. With `row` and
    its step, positions over half a pitch from a row's centre, in a gap between dies, are outside."""
    half = size_y / 2 - tolerance * pitch_y
    inside = ~(col < tolerance - 0.5) & ~(col > n_cols - tolerance - 0.5) & ~(y < -half) & ~(y > half)
    return inside if row is None else inside & (F.abs((row - F.round(row)) * step_y) <= pitch_y / 2)


def trigger_group(channel: Column) -> Column:
    return F.when(channel.between(0, 7) | (channel == 16), 0).when(channel.between(8, 15) | (channel == 17), 1).otherwise(-1)


def linear_channel(col: Column, row: Column, n_cols: Column) -> Column:
    return col + n_cols * row


def bin_2d(value: Column, low: Column, width) -> Column:
    """Truncates first, so that values up to one width below `low` fall into bin 0."""
    return trunc((value - low) / width)


def slope_angle(slope: Column) -> Column:
    return F.atan(slope)


def nearest_index(c: Column) -> Column:
    """Half up, as die and mask look-ups round."""
    return half_up(c)


def ticks(dt: Column, period: float = 25.0) -> Column:
    return (dt / period).cast("long")


def inside_polygon(x: Column, y: Column, corners: list[tuple[int, int]]) -> Column:
    """Whether a ray from the truncated point to the right crosses an odd number of sides; a side has its lower end but not its upper one."""
    px, py = trunc(x), trunc(y)
    crossings: Column = F.lit(0)
    for a, b in zip(corners, corners[1:] + corners[:1], strict=True):
        (x1, y1), (x2, y2) = sorted((a, b), key=lambda c: c[1])
        if y1 != y2:
            at = x1 + (py - y1) * ((x2 - x1) / (y2 - y1))
            crossings = crossings + ((py >= y1) & (py < y2) & (px < at)).cast("int")
    return crossings % 2 == 1


def start_time_at(pairs: Column, fraction: float, default: Column) -> Column:
    """The time of the (cfd, t) pair whose fraction is within 1e-6, else the default."""
    return F.coalesce(F.get(F.filter(pairs, lambda p: F.abs(p["cfd"] - fraction) < 1e-6), F.lit(0))["t"], default)
