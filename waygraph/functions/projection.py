"""Transverse Mercator on the WGS 84 ellipsoid, zone 48 north, with an optional change of datum."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: WGS 84 ellipsoid, UTM scale and false easting, central meridian of zone 48
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563
SCALE, FALSE_EASTING, MERIDIAN = 0.9996, 500000.0, 105.0
# fixed values: seven parameters from VN-2000 to WGS 84 - metres, seconds of arc (coordinate frame), parts in a million
VN2000 = ((-192.873, -39.382, -111.202), (0.00205, 0.0005, -0.00335), 0.0188)


def _shifted(phi: np.ndarray, lon: np.ndarray, datum: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Radians on another datum of the same ellipsoid, through earth-centred coordinates."""
    move, turn, ppm = datum
    rx, ry, rz = np.radians(np.array(turn) / 3600)
    e2, m = FLATTENING * (2 - FLATTENING), 1 + ppm * 1e-6
    normal = lambda p: SEMI_MAJOR / np.sqrt(1 - e2 * np.sin(p) ** 2)
    n = normal(phi)
    raw = n * np.cos(phi) * np.cos(lon), n * np.cos(phi) * np.sin(lon), n * (1 - e2) * np.sin(phi)
    u, v, w = ((a - t) / m for a, t in zip(raw, move, strict=True))
    x, y, z = u - rz * v + ry * w, rz * u + v - rx * w, rx * v - ry * u + w
    p = np.hypot(x, y)
    lat = np.arctan2(z, p * (1 - e2))
    for _ in range(6):  # each step gains some two digits and a half
        lat = np.arctan2(z + e2 * normal(lat) * np.sin(lat), p)
    return lat, np.arctan2(y, x)


def project(lat: np.ndarray, lon: np.ndarray, datum: tuple | None = VN2000) -> tuple[np.ndarray, np.ndarray]:
    """Planar metres of degrees, by Krueger's series to the fourth order of the third flattening."""
    n = FLATTENING / (2 - FLATTENING)
    radius = SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    )
    e = 2 * n**0.5 / (1 + n)
    phi, lam = np.radians(lat), np.radians(lon)
    if datum:
        phi, lam = _shifted(phi, lam, datum)
    lam = lam - np.radians(MERIDIAN)
    with np.errstate(all="ignore"):
        t = np.sinh(np.arctanh(np.sin(phi)) - e * np.arctanh(e * np.sin(phi)))
        xi, eta = np.arctan2(t, np.cos(lam)), np.arcsinh(np.sin(lam) / np.hypot(t, np.cos(lam)))
        x, y = eta, xi
        for j, a in enumerate(alpha, 1):
            x = x + a * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
            y = y + a * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
    return FALSE_EASTING + SCALE * radius * x, SCALE * radius * y


def with_projection(df: DataFrame, x: str = "x_m", y: str = "y_m", datum: tuple | None = VN2000) -> DataFrame:
    """df (lat, lon in degrees) with planar metres; null where a coordinate is null or has no finite projection.

    In numpy by Arrow batches: as columns, the series and the iterated latitude make an expression that
    grows with every step when the optimizer merges projections.
    """

    def run(lat, lon):
        import pandas as pd

        px, py = project(lat.to_numpy(float), lon.to_numpy(float), datum)
        ok = np.isfinite(px) & np.isfinite(py)
        return pd.DataFrame({"x": np.where(ok, px, np.nan), "y": np.where(ok, py, np.nan)})

    kind = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
    p = F.pandas_udf(run, kind)(F.col("lat").cast("double"), F.col("lon").cast("double"))
    out = df.withColumn("_p", p)
    null = lambda c: F.when(~F.isnan(c), F.col(c))
    return out.withColumns({x: null("_p.x"), y: null("_p.y")}).drop("_p")


def planar(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Euclidean distance; written as a square root so that other engines give the same bits."""
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))
