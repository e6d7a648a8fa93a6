"""Text and Parquet tables of stations, shots, events, picks, lines and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHOTS = "shotno int, lineno int, time timestamp, lat double, lon double"
QUAKES = "origin_time timestamp, origin_julday int, origin_latitude double, origin_longitude double, origin_depth_km double, approx_distance_km double"
PICKS = "station int, shot int, phase int, offset double, tt double, error double"
TRACES = "trace_id bigint, lineno int, shot int, station int, t0 timestamp, fs double, samples array<double>"
#: fixed values: the columns of the survey line table, in file order
LINES = (
    "event_name string, start_date string, start_longitude double, start_latitude double, stop_date string, "
    "stop_longitude double, stop_latitude double, nav_type string, feature_id string, start_shotpoint string, "
    "stop_shotpoint string, sequence_number string, details string, url string"
)


def read_stations(spark: SparkSession, path: str, code_type: str = "string") -> DataFrame:
    return spark.read.schema(f"code {code_type}, lat double, lon double, elev_m double").csv(path, header=True)


def write_stations(stations: DataFrame, path: str) -> None:
    stations.select("code", "lat", "lon", "elev_m").write.csv(path, header=True)


def read_shots(spark: SparkSession, path: str) -> DataFrame:
    """``time`` is ISO text in the file; the session's time zone applies."""
    text = SHOTS.replace("time timestamp", "time string")
    return spark.read.schema(text).csv(path, header=True).withColumn("time", F.to_timestamp("time")).select("shotno", "lineno", "time", "lat", "lon")


def read_quakes(spark: SparkSession, path: str) -> DataFrame:
    """Adds ``ns``, the origin time in nanoseconds; the source has whole microseconds."""
    return with_ns(spark.read.schema(QUAKES).csv(path, header=True, sep="\t"))


def with_ns(quakes: DataFrame) -> DataFrame:
    return quakes.withColumn("ns", F.unix_micros("origin_time") * 1000)


def read_picks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.schema(PICKS).csv(paths, sep=" ")


def pick_lines(picks: DataFrame) -> DataFrame:
    """One text column ``value``: the six fields, floats with three decimals.

    ``format_number`` rounds the exact binary value half-even, as C's ``%.3f`` does.
    """
    number = lambda c: F.expr(f"format_number(cast(`{c}` as double), '0.000')")
    return picks.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in ("station", "shot", "phase")], *map(number, ("offset", "tt", "error"))).alias("value"))


def write_picks(picks: DataFrame, path: str) -> None:
    pick_lines(picks).write.text(path)


def read_pick_list(spark: SparkSession, list_file: str, directory: str) -> DataFrame:
    """All pick files named in a list, with ``file``: the name each row came from.

    The list is a short control file; only its names come to the driver.
    """
    names = [r.value.strip() for r in spark.read.text(list_file).collect() if r.value.strip()]
    picks = read_picks(spark, [f"{directory}/{n}" for n in names])
    return picks.withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def clean_volcanoes(raw: DataFrame) -> DataFrame:
    """Name and place; blank records stay as nulls."""
    return raw.select(F.col("Volcano Name").alias("name"), F.col("Latitude").cast("double").alias("lat"), F.col("Longitude").cast("double").alias("lon"))


def read_survey_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines end in a bare carriage return; a byte-order mark stands before the first value."""
    rows = spark.read.schema(LINES).csv(path, header=True, lineSep="\r", enforceSchema=True)
    return rows.withColumn("event_name", F.regexp_replace("event_name", "^\\ufeff", ""))


def write_traces_by_station(traces: DataFrame, path: str) -> None:
    """One directory per line and station, so that reading a station opens its files only."""
    traces.repartition("lineno", "station").sortWithinPartitions("lineno", "station", "shot").write.partitionBy("lineno", "station").parquet(path)


def read_traces(spark: SparkSession, path: str, lineno: int | None = None, station: int | None = None) -> DataFrame:
    traces = spark.read.schema(TRACES).parquet(path)
    for name, value in (("lineno", lineno), ("station", station)):
        if value is not None:
            traces = traces.where(F.col(name) == value)
    return traces


def read_dws(spark: SparkSession, path: str) -> DataFrame:
    """White-space table ``x z dws flag``; flag -0.5 is read as 1 (masked)."""
    return parse_dws(spark.read.text(path))


def parse_dws(lines: DataFrame) -> DataFrame:
    part = F.split(F.trim("value"), r"\s+")
    cols = [F.get(part, i).cast("double").alias(n) for i, n in enumerate(("x", "z", "dws", "flag"))]
    rows = lines.where(F.trim("value") != "").select(*cols)
    return rows.withColumn("flag", F.when(F.col("flag") == -0.5, 1.0).otherwise(F.col("flag")))
