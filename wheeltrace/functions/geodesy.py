"""Map projections as staged column expressions (no projection library, no UDF).

Each function takes a DataFrame and column names and returns the DataFrame with the result columns.
Intermediate values are named in successive projections, so that a value used several times is
computed once; Spark keeps the stages apart because collapsing them would repeat the work.

The transverse Mercator projection uses Krueger's series to sixth order (as given by Karney,
"Transverse Mercator with an accuracy of a few nanometers", 2011), evaluated by Clenshaw summation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ellipsoid of WGS84 and the zone parameters used for the recordings.
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
UTM32 = {"lon0": 9.0, "k0": 0.9996, "x0": 500000.0, "y0": 0.0}
TMERC0 = {"lon0": 0.0, "k0": 1.0, "x0": 0.0, "y0": 0.0}

_N = WGS84_F / (2 - WGS84_F)
_E = math.sqrt(WGS84_F * (2 - WGS84_F))
RECTIFYING = WGS84_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)


def _poly(start: int, *coef: float) -> float:
    return sum(c * _N ** (start + i) for i, c in enumerate(coef))


# Published series coefficients in the third flattening n.
ALPHA = [
    _poly(1, 1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800),
    _poly(2, 13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360),
    _poly(3, 61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440),
    _poly(4, 49561 / 161280, -179 / 168, 6601661 / 7257600),
    _poly(5, 34729 / 80640, -3418889 / 1995840),
    _poly(6, 212378941 / 319334400),
]
BETA = [
    _poly(1, 1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800),
    _poly(2, 1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720),
    _poly(3, 17 / 480, -37 / 840, -209 / 4480, 5569 / 90720),
    _poly(4, 4397 / 161280, -11 / 504, -830251 / 7257600),
    _poly(5, 4583 / 161280, -108847 / 3991680),
    _poly(6, 20648693 / 638668800),
]
DELTA = [
    _poly(1, 2, -2 / 3, -2, 116 / 45, 26 / 45, -2854 / 675),
    _poly(2, 7 / 3, -8 / 5, -227 / 45, 2704 / 315, 2323 / 945),
    _poly(3, 56 / 15, -136 / 35, -1262 / 105, 73814 / 2835),
    _poly(4, 4279 / 630, -332 / 35, -399572 / 14175),
    _poly(5, 4174 / 315, -144838 / 6237),
    _poly(6, 601676 / 22275),
]


def _stage(df: DataFrame, **cols: Column) -> DataFrame:
    return df.select(*df.columns, *[c.alias(n) for n, c in cols.items()])


def _series(df: DataFrame, coef: list[float], xi: str, eta: str, sign: float) -> DataFrame:
    """Adds ``_sx``, ``_sy``: (xi, eta) + sign * sum coef_j * sin(2 j (xi + i eta))."""
    x, e = F.col(xi), F.col(eta)
    df = _stage(df, _s=F.sin(2 * x), _c=F.cos(2 * x), _sh=F.sinh(2 * e), _ch=F.cosh(2 * e))
    c = F.col
    df = _stage(
        df, _ar=2 * c("_c") * c("_ch"), _ai=-2 * c("_s") * c("_sh"),
        _br6=F.lit(coef[5]), _bi6=F.lit(0.0),
    )
    zero = F.lit(0.0)
    for j in range(5, 0, -1):
        br, bi = c(f"_br{j + 1}"), c(f"_bi{j + 1}")
        br2, bi2 = (c(f"_br{j + 2}"), c(f"_bi{j + 2}")) if j < 5 else (zero, zero)
        df = _stage(
            df,
            **{
                f"_br{j}": coef[j - 1] + c("_ar") * br - c("_ai") * bi - br2,
                f"_bi{j}": c("_ar") * bi + c("_ai") * br - bi2,
            },
        )
    sr, si = c("_s") * c("_ch"), c("_c") * c("_sh")
    return _stage(
        df,
        _sx=x + sign * (c("_br1") * sr - c("_bi1") * si),
        _sy=e + sign * (c("_br1") * si + c("_bi1") * sr),
    )


def _conformal_tan(tau: Column) -> tuple[Column, Column]:
    root = F.sqrt(1 + tau * tau)
    return root, F.sinh(_E * F.atanh(_E * tau / root))


def meridian_northing(lat_deg: Column) -> Column:
    """Northing of a latitude on the central meridian for k0 = 1 (origin shift of ``lat_0``)."""
    tau = F.tan(F.radians(lat_deg))
    root, sigma = _conformal_tan(tau)
    xi = F.atan(tau * F.sqrt(1 + sigma * sigma) - sigma * root)
    total = xi
    for j, a in enumerate(ALPHA, 1):
        total = total + a * F.sin(2 * j * xi)
    return RECTIFYING * total


def tm_forward(
    df: DataFrame, lat: str, lon: str, x: str, y: str, lon0=0.0, k0=1.0, x0=0.0, y0=0.0, lat0=None
) -> DataFrame:
    """WGS84 degrees to transverse Mercator metres; ``lon0``/``lat0`` may be columns."""
    keep = df.columns
    c = F.col
    lon0 = F.lit(lon0) if not isinstance(lon0, Column) else lon0
    df = _stage(df, _tau=F.tan(F.radians(c(lat))), _lam=F.radians(c(lon) - lon0))
    root, sigma = _conformal_tan(c("_tau"))
    df = _stage(df, _root=root, _sig=sigma)
    df = _stage(df, _tp=c("_tau") * F.sqrt(1 + c("_sig") * c("_sig")) - c("_sig") * c("_root"),
                _cl=F.cos(c("_lam")))
    df = _stage(df, _xi=F.atan2(c("_tp"), c("_cl")),
                _eta=F.asinh(F.sin(c("_lam")) / F.sqrt(c("_tp") * c("_tp") + c("_cl") * c("_cl"))))
    df = _series(df, ALPHA, "_xi", "_eta", 1.0)
    scale = k0 * RECTIFYING
    north = scale * c("_sx") + y0
    if lat0 is not None:
        north = north - k0 * meridian_northing(lat0)
    return df.select(*[k for k in keep if k not in (x, y)], (scale * c("_sy") + x0).alias(x),
                     north.alias(y))


def tm_inverse(
    df: DataFrame, x: str, y: str, lat: str, lon: str, lon0=0.0, k0=1.0, x0=0.0, y0=0.0
) -> DataFrame:
    keep = df.columns
    c = F.col
    scale = k0 * RECTIFYING
    df = _stage(df, _xi=(c(y) - y0) / scale, _eta=(c(x) - x0) / scale)
    df = _series(df, BETA, "_xi", "_eta", -1.0)
    df = _stage(df, _chi=F.asin(F.sin(c("_sx")) / F.cosh(c("_sy"))),
                _lam=F.atan2(F.sinh(c("_sy")), F.cos(c("_sx"))))
    phi = c("_chi")
    for j, d in enumerate(DELTA, 1):
        phi = phi + d * F.sin(2 * j * c("_chi"))
    return df.select(*[k for k in keep if k not in (lat, lon)], F.degrees(phi).alias(lat),
                     (F.degrees(c("_lam")) + lon0).alias(lon))


def utm_to_wgs84(df: DataFrame, x: str, y: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    return tm_inverse(df, x, y, lat, lon, **UTM32)


def wgs84_to_utm(df: DataFrame, lat: str, lon: str, x: str = "utm_x", y: str = "utm_y") -> DataFrame:
    return tm_forward(df, lat, lon, x, y, **UTM32)


def wgs84_to_tmerc(df: DataFrame, lat: str, lon: str, x: str = "px", y: str = "py") -> DataFrame:
    return tm_forward(df, lat, lon, x, y, **TMERC0)


def tmerc_to_wgs84(df: DataFrame, x: str, y: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    return tm_inverse(df, x, y, lat, lon, **TMERC0)


def wgs84_to_mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    return (
        WGS84_A * F.radians(lon),
        WGS84_A * F.log(F.tan(math.pi / 4 + F.radians(lat) / 2)),
    )


def mercator_to_wgs84(x: Column, y: Column) -> tuple[Column, Column]:
    """(lat, lon) in degrees."""
    return (
        F.degrees(2 * F.atan(F.exp(y / WGS84_A)) - math.pi / 2),
        F.degrees(x / WGS84_A),
    )


def utm_to_sim(df: DataFrame, x: str, y: str, sx: str, sy: str, offset: tuple) -> DataFrame:
    """UTM -> WGS84 -> map projection -> + map offset, y negated."""
    keep = [c for c in df.columns if c not in (sx, sy)]
    out = utm_to_wgs84(df, x, y, "_glat", "_glon")
    out = wgs84_to_tmerc(out, "_glat", "_glon", "_gpx", "_gpy")
    return out.select(*keep, (F.col("_gpx") + offset[0]).alias(sx),
                      (-(F.col("_gpy") + offset[1])).alias(sy))


def _sim_to_wgs84(df: DataFrame, sx: str, sy: str, offset: tuple) -> DataFrame:
    out = df.select("*", (F.col(sx) - offset[0]).alias("_gpx"), (-F.col(sy) - offset[1]).alias("_gpy"))
    return tmerc_to_wgs84(out, "_gpx", "_gpy", "_glat", "_glon")


def sim_to_utm(df: DataFrame, sx: str, sy: str, x: str, y: str, offset: tuple) -> DataFrame:
    out = wgs84_to_utm(_sim_to_wgs84(df, sx, sy, offset), "_glat", "_glon", "_gux", "_guy")
    return out.select(*[c for c in df.columns if c not in (x, y)], F.col("_gux").alias(x),
                      F.col("_guy").alias(y))


def sim_to_mercator(df: DataFrame, sx: str, sy: str, mx: str, my: str, offset: tuple) -> DataFrame:
    out = _sim_to_wgs84(df, sx, sy, offset)
    px, py = wgs84_to_mercator(F.col("_glat"), F.col("_glon"))
    return out.select(*[c for c in df.columns if c not in (mx, my)], px.alias(mx), py.alias(my))


def axis_angle(df: DataFrame, x: str, y: str, out: str, offset: tuple) -> DataFrame:
    """Angle of the UTM +x axis in the simulation frame, by a 1 m finite difference."""
    keep = df.columns
    df = df.select("*", (F.col(x) + 1.0).alias("_x1"))
    df = utm_to_sim(df, x, y, "_ax0", "_ay0", offset)
    df = utm_to_sim(df, "_x1", y, "_ax1", "_ay1", offset)
    return df.select(*keep, F.atan2(F.col("_ay1") - F.col("_ay0"), F.col("_ax1") - F.col("_ax0")).alias(out))


def enu_to_latlon(dx: Column, dy: Column, lat0: float, lon0: float) -> tuple[Column, Column]:
    """Metres east/north of a reference point, by metres-per-degree series at its latitude."""
    a = math.radians(lat0)
    per_lat = 111132.92 - 559.82 * math.cos(2 * a) + 1.175 * math.cos(4 * a)
    per_lon = 111412.84 * math.cos(a) - 93.5 * math.cos(3 * a)
    return lat0 + dy / per_lat, lon0 + dx / per_lon


def local_equirect(lat0: Column, lon0: Column, lat: Column, lon: Column) -> tuple[Column, Column]:
    """(dx, dy) metres: each axis is measured along the reference point's own parallel/meridian."""
    dx = (lon - lon0) * 40075000 * F.cos(F.radians(lat0)) / 360
    return dx, (lat - lat0) * 111320


def local_tmerc_heading(
    df: DataFrame, lat0: str, lon0: str, lat1: str, lon1: str, out: str
) -> DataFrame:
    """Heading (deg, y down) from start to end in a projection centred on the start point."""
    keep = df.columns
    df = tm_forward(df, lat1, lon1, "_hx", "_hy", lon0=F.col(lon0), lat0=F.col(lat0))
    deg = F.pmod(F.degrees(F.atan2(-F.col("_hy"), F.col("_hx"))) + 360, F.lit(360.0))
    return df.select(*keep, deg.alias(out))


def local_tmerc_point(
    df: DataFrame, lat0: str, lon0: str, lat: str, lon: str, x: str, y: str, rotation_deg: float = 0.0
) -> DataFrame:
    """Position around a per-row origin, rotated to the map grid, y negated."""
    keep = df.columns
    df = tm_forward(df, lat, lon, "_hx", "_hy", lon0=F.col(lon0), lat0=F.col(lat0))
    px, py = F.col("_hx"), F.col("_hy")
    if abs(rotation_deg) > 1e-6:
        c, s = math.cos(math.radians(rotation_deg)), math.sin(math.radians(rotation_deg))
        px, py = c * px - s * py, s * px + c * py
    return df.select(*keep, px.alias(x), (-py).alias(y))
