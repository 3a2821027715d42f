"""Distances on the ground, for numpy arrays and for columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: mean radius of the earth in metres
EARTH_M = 6371008.8


def ground_distance(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """Great-circle metres between points in degrees; NaN where a coordinate is NaN."""
    a, b = np.radians(lat1), np.radians(lat2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(h, 1)))


def ground_distance_col(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    s, t = F.sin((b - a) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), s * s + F.cos(a) * F.cos(b) * t * t)))
