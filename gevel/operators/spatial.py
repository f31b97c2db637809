"""Joins by nearness: both sides are dealt out by grid cell, so that only neighbours meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gevel.functions.geo import degrees


def _cell(x: Column, size: float) -> Column:
    return F.floor(x / F.lit(size)).cast("long")


def nearest_within(probes: DataFrame, probe_id: str, places: DataFrame, place_id: str, tolerance: float, square: bool = False) -> DataFrame:
    """(probe_id, place_id, distance): each probe's nearest place within tolerance degrees, by circle or by square; of equal ones the smallest id.

    Both sides have lon and lat. Of places at one position one is kept. Probes go to the nine cells around them, places to their own, and the two meet in an equi-join; the nearest is kept by an aggregation that combines before its shuffle. Rows without a position, and probes without a near place, give none.
    """
    size = max(tolerance, 1e-9)
    near = F.array(*(F.lit(k) for k in (-1, 0, 1)))
    left = probes.where("lon is not null and lat is not null").select(F.col(probe_id).alias("_probe"), F.col("lon").alias("_lon"), F.col("lat").alias("_lat"))
    left = left.withColumn("_dx", F.explode(near)).withColumn("_dy", F.explode(near))
    left = left.select("_probe", "_lon", "_lat", (_cell(F.col("_lon"), size) + F.col("_dx")).alias("_x"), (_cell(F.col("_lat"), size) + F.col("_dy")).alias("_y"))
    # Of places at one position only that of the smallest id can be the answer.
    right = places.where("lon is not null and lat is not null").groupBy("lon", "lat").agg(F.min(place_id).alias("_place")).select("_place", "lon", "lat", _cell(F.col("lon"), size).alias("_x"), _cell(F.col("lat"), size).alias("_y"))
    distance = degrees(F.col("_lon"), F.col("_lat"), F.col("lon"), F.col("lat"))
    inside = (F.abs(F.col("lon") - F.col("_lon")) <= tolerance) & (F.abs(F.col("lat") - F.col("_lat")) <= tolerance)
    pairs = left.join(right, ["_x", "_y"]).withColumn("_distance", distance).where(inside if square else F.col("_distance") <= tolerance)
    best = pairs.groupBy("_probe").agg(F.min(F.struct("_distance", "_place")).alias("best"))
    return best.select(F.col("_probe").alias(probe_id), F.col("best._place").alias(place_id), F.col("best._distance").alias("distance"))
