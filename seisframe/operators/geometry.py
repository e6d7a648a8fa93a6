"""Offsets, boxes, projections and location lookups on tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import Profile, along_geodesic, along_line_km, azimuth_deg, box_distances_m, geodesic_direct, geodesic_m, hypocentral_km, initial_azimuth, project_to_profile


def with_locations(df: DataFrame, places: DataFrame, on: str, key: str, prefix: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Latitude and longitude of a station, shot or event; rows without a place keep nulls.

    The place table is small by nature, but no hint is given: Spark broadcasts it if its size
    allows, and shuffles both sides by the key if not.
    """
    found = places.select(F.col(key).alias("__k"), F.col(lat).alias(f"{prefix}lat"), F.col(lon).alias(f"{prefix}lon"))
    return df.join(found, F.col(on) == F.col("__k"), "left").drop("__k")


def unmatched(df: DataFrame, places: DataFrame, on: str, key: str) -> DataFrame:
    """How many rows have no place: one row, ``n_rows`` and ``n_unmatched``."""
    found = places.select(F.col(key).alias("__k")).distinct().withColumn("__hit", F.lit(1))
    joined = df.select(F.col(on)).join(found, F.col(on) == F.col("__k"), "left")
    return joined.agg(F.count("*").alias("n_rows"), F.count_if(F.col("__hit").isNull()).alias("n_unmatched"))


def source_receiver_offset(traces: DataFrame, nodes: DataFrame, shots: DataFrame) -> DataFrame:
    """Adds ``offset_m``; the receiver's elevation is ignored."""
    at = with_locations(with_locations(traces, nodes, "station", "code", "__r"), shots, "shot", "shotno", "__s")
    offset = geodesic_m(F.col("__rlat"), F.col("__rlon"), F.col("__slat"), F.col("__slon"))
    return at.withColumn("offset_m", offset).drop("__rlat", "__rlon", "__slat", "__slon")


def quake_offset_km(pairs: DataFrame, nodes: DataFrame, quakes: DataFrame) -> DataFrame:
    """Adds ``offset_km`` to ``station, ns`` pairs: through the Earth to the source's depth."""
    places = quakes.select("ns", "origin_latitude", "origin_longitude", F.col("origin_depth_km").alias("__depth"))
    at = with_locations(pairs, nodes, "station", "code", "__r").join(places, "ns", "left")
    surface = geodesic_m(F.col("__rlat"), F.col("__rlon"), F.col("origin_latitude"), F.col("origin_longitude"))
    return at.withColumn("offset_km", hypocentral_km(surface, F.col("__depth"))).drop("__rlat", "__rlon", "origin_latitude", "origin_longitude", "__depth")


def station_bbox(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"), F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"))


def min_max_offsets_km(nodes: DataFrame, shots: DataFrame) -> DataFrame:
    """Bounds of all offsets from the stations' box; shots inside the box are left out."""
    box = F.broadcast(station_bbox(nodes))  # one row
    low, high = box_distances_m(*(F.col(c) for c in ("lat", "lon", "min_lat", "max_lat", "min_lon", "max_lon")))
    return shots.select("lat", "lon").join(box).select(low.alias("lo"), high.alias("hi")).agg((F.min("lo") / 1e3).alias("min_km"), (F.max("hi") / 1e3).alias("max_km"))


def in_region(points: DataFrame, region: tuple[float, float, float, float]) -> DataFrame:
    """Points in a closed box given as (lon0, lon1, lat0, lat1)."""
    lon0, lon1, lat0, lat1 = region
    return points.where(F.col("lon").between(lon0, lon1) & F.col("lat").between(lat0, lat1))


def project_shots(shots: DataFrame, profile: Profile) -> DataFrame:
    """``shotno, x, y, z`` on a profile; shots are 12 m deep."""
    x, y = project_to_profile(F.col("lat"), F.col("lon"), profile)
    return shots.select("shotno", x.alias("x"), y.alias("y"), F.lit(0.012).alias("z"))


def project_stations(stations: DataFrame, profile: Profile) -> DataFrame:
    """``code, x, y, z``: z is the elevation in km, as the station table has it."""
    x, y = project_to_profile(F.col("lat"), F.col("lon"), profile)
    return stations.select("code", x.alias("x"), y.alias("y"), (F.col("elev_m") * 1e-3).alias("z"))


def profile_bounds(stations: DataFrame, first_shot: tuple[float, float], last_shot: tuple[float, float], round_km: float = 50.0) -> tuple[float, tuple[float, float], tuple[float, float]]:
    """Length in km (rounded up) and both ends of a line through the shots that covers all stations.

    Only the greatest distance along the line comes to the driver.
    """
    line = Profile(last_shot, first_shot, 0, 0, 0, 0)
    x, _ = project_to_profile(F.col("lat"), F.col("lon"), line)
    farthest = stations.agg(F.max(x).alias("x")).first().x
    length = float(np.ceil(farthest / round_km) * round_km)
    far = geodesic_direct(*last_shot, initial_azimuth(*last_shot, *first_shot), length * 1e3)
    return length, (round(far[0], 6), round(far[1], 6)), last_shot


def line_bounds(stations: DataFrame, shots: DataFrame, round_km: float = 50.0) -> DataFrame:
    """``lineno, length_km, azimuth, far_lat, far_lon, near_lat, near_lon`` of every line of ``shots``.

    A line begins at its last shot (``near``), goes through its first one, and is so long, rounded up, that it covers all
    ``stations`` of its ``lineno``; ``far`` is its other end.
    """
    ends = shots.groupBy("lineno").agg(F.max_by(F.struct("lat", "lon"), "shotno").alias("near"), F.min_by(F.struct("lat", "lon"), "shotno").alias("through"))
    near, through = ((F.col(f"{c}.lat"), F.col(f"{c}.lon")) for c in ("near", "through"))
    x = along_line_km(F.col("lat"), F.col("lon"), near, through)
    longest = stations.select("lineno", "lat", "lon").join(ends, "lineno").groupBy("lineno").agg(F.max(x).alias("x"), F.first("near").alias("near"), F.first("through").alias("through"))
    sized = longest.select("lineno", (F.ceil(F.col("x") / round_km) * round_km).cast("double").alias("length_km"), azimuth_deg(*near, *through).alias("azimuth"), "near")
    far = along_geodesic(*near, F.col("azimuth"), F.col("length_km") * 1e3)
    sized = sized.withColumn("far", far)
    return sized.select("lineno", "length_km", "azimuth", F.col("far.lat").alias("far_lat"), F.col("far.lon").alias("far_lon"), F.col("near.lat").alias("near_lat"), F.col("near.lon").alias("near_lon"))


def broadband_id(df: DataFrame, codes: DataFrame, code: str = "code") -> DataFrame:
    """Adds ``station``: 2,000,000 and the number that ``codes(code, number)`` has."""
    numbers = codes.select(F.col("code").alias("__c"), (F.lit(2_000_000) + F.col("number")).cast("int").alias("station"))
    return df.join(numbers, F.col(code) == F.col("__c"), "left").drop("__c")


def broadband_code(df: DataFrame, codes: DataFrame, station: str = "station") -> DataFrame:
    numbers = codes.select((F.lit(2_000_000) + F.col("number")).alias("__n"), F.col("code"))
    return df.join(numbers, F.col(station) == F.col("__n"), "left").drop("__n")


def reduced(tt: Column, offset_km: Column, v_red: float = 6.0) -> Column:
    return tt - offset_km / v_red
