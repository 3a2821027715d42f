"""Points within a distance of other points, by the regions around them.

Around each place lies a region, a box of latitudes and longitudes, that covers every place within the
distance: one trapezoid, two where it is cut by the 180th meridian. The places are located among these
regions (operators.regions); the distance on the ground then decides. Ids at one place are a class: the
search is over places, and classes are spread out only where all pairs are asked for.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_M, ground_distance
from ..runtime import written
from .regions import locate


def valid_position(lat: Column, lon: Column) -> Column:
    """Not null, finite, within range, and not the placeholder 0,0."""
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0)), F.lit(False))


def near_places(places: DataFrame, radius_m: float) -> DataFrame:
    """(a, b), a < b: numbers of places (place, lat, lon) that are at most radius_m apart.

    places: distinct numbers, valid positions in degrees. Both sides of the 180th meridian and the
    poles are handled.
    """
    angle = radius_m / EARTH_M
    reach = math.degrees(angle) * 1.0001
    narrow = F.cos(F.radians("lat"))
    half = F.when(narrow > math.sin(angle) * 1.01, F.degrees(F.asin(math.sin(angle) / narrow)) * 1.0001).otherwise(360.0)
    turns = F.when(F.col("half") >= 180, F.array(F.lit(0.0))).otherwise(
        F.filter(F.array(F.lit(0.0), F.lit(360.0), F.lit(-360.0)), lambda s: (s == 0) | ((F.col("lon") + s + F.col("half") >= -180) & (F.col("lon") + s - F.col("half") <= 180)))
    )
    west = F.greatest(F.lit(-180.0), F.col("lon") + F.col("turn") - F.col("half"))
    east = F.least(F.lit(180.0), F.col("lon") + F.col("turn") + F.col("half"))
    boxes = places.withColumn("half", half).withColumn("turn", F.explode(turns)).select(
        F.col("place").alias("region"), (F.col("lat") - reach).alias("y0"), (F.col("lat") + reach).alias("y1"),
        west.alias("w0"), west.alias("w1"), east.alias("e0"), east.alias("e1"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"),
    )
    points = places.select("place", F.col("lon").alias("x"), F.col("lat").alias("y"))

    def close(t: dict[str, np.ndarray], p: dict[str, np.ndarray]) -> np.ndarray:
        ok = (t["region"] < p["place"]) & (p["y"] >= t["y0"]) & (p["y"] <= t["y1"])
        ok[ok] = ground_distance(t["a_lat"][ok], t["a_lon"][ok], p["y"][ok], p["x"][ok]) <= radius_m
        return ok

    return locate(points, boxes, close).select(F.col("region").alias("a"), F.col("place").alias("b"))


def _members(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """places (place, lat, lon) and members (id, place) of the nodes with a valid position."""
    nodes = df.where(F.col("id").isNotNull() & valid_position(F.col("lat"), F.col("lon"))).select(
        "id", (F.col("lat").cast("double") + 0.0).alias("lat"), (F.col("lon").cast("double") + 0.0).alias("lon")
    )
    nodes = written(nodes.distinct(), "positions")
    places = written(nodes.select("lat", "lon").distinct().withColumn("place", F.monotonically_increasing_id()), "places")
    return places, written(nodes.join(places, ["lat", "lon"]).select("id", "place"), "members")


def near_pairs(df: DataFrame, radius_m: float = 15.0) -> DataFrame:
    """(id_a, id_b), id_a < id_b: different ids whose positions are at most radius_m apart.

    df: id, lat, lon. A position that is null, not finite, out of range or 0,0 is in no pair; a null id
    neither. Ids at one position are pairs of each other: n of them give n (n - 1) / 2 rows, see
    near_counts. Repeated rows count once; an id with several positions is near what any of them is
    near. Extra columns are ignored; an empty table gives none.
    """
    places, members = _members(df)
    of = lambda n: members.select(F.col("place").alias(n), F.col("id").alias(f"id_{n}"))
    apart = near_places(places, radius_m).join(of("a"), "a").join(of("b"), "b").select("id_a", "id_b").where("id_a <> id_b")
    same = of("a").join(of("b"), (F.col("a") == F.col("b")) & (F.col("id_a") < F.col("id_b"))).select("id_a", "id_b")
    return apart.union(same).select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()


def near_counts(df: DataFrame, radius_m: float = 15.0) -> DataFrame:
    """(id, place, neighbours): each node that has any, its place and the number of other nodes within radius_m.

    Rules as in near_pairs. Counted by places, without a row a pair; only ids with several positions,
    whose neighbours can meet at more than one of them, are counted one by one. place is one of an id's.
    """
    places, members = _members(df)
    size = members.groupBy("place").agg(F.count("*").alias("n"))
    near = written(near_places(places, radius_m), "near")
    ways = near.select(F.col("a").alias("place"), F.col("b").alias("other")).unionByName(near.select(F.col("b").alias("place"), F.col("a").alias("other")))
    ways = ways.unionByName(places.select("place", F.col("place").alias("other")))
    several = written(members.groupBy("id").agg(F.count("*").alias("k")).where("k > 1").select("id"), "several")
    around = ways.join(size.withColumnRenamed("place", "other"), "other").groupBy("place").agg((F.sum("n") - 1).alias("neighbours"))
    plain = members.join(around, "place").select("id", "place", "neighbours")
    if not several.isEmpty():
        # places near which such an id lies are counted by distinct ids
        moved = members.join(several, "id", "left_semi")
        odd = ways.join(moved.select(F.col("place").alias("other")).distinct(), "other", "left_semi").select("place").distinct()
        ids = members.join(odd, "place", "left_semi").select("id").distinct()
        mine = members.join(ids, "id", "left_semi").join(ways, "place").select("id", "place", "other")
        them = members.select(F.col("place").alias("other"), F.col("id").alias("them"))
        one = mine.join(them, "other").where("id <> them").groupBy("id").agg(F.min("place").alias("place"), F.countDistinct("them").alias("neighbours"))
        plain = plain.join(ids, "id", "left_anti").unionByName(one)
    return plain.where("neighbours > 0")
