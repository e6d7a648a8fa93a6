"""Registered queries that write rows of the driver's tables in a source's format and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import rays
from ..sources import tables as files
from .adapters import Tables, folder
from .queries import query


@query("SELECT code::VARCHAR AS code, lat, lon, elev_m FROM nodes")
def stations_written_and_read(t: Tables) -> DataFrame:
    path = folder(t)
    files.write_stations(t.nodes, path)
    return files.read_stations(t.spark, path)


@query("SELECT shotno, lineno, epoch_us(time) AS us, lat, lon FROM shots")
def shots_read(t: Tables) -> DataFrame:
    path = folder(t)
    t.shots.withColumn("time", F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).write.csv(path, header=True)
    return files.read_shots(t.spark, path).select("shotno", "lineno", F.unix_micros("time").alias("us"), "lat", "lon")


@query("SELECT epoch_us(origin_time) * 1000 AS ns, dayofyear(origin_time)::INT AS origin_julday, origin_latitude, origin_longitude, origin_depth_km, 0.5::DOUBLE * origin_depth_km AS approx_distance_km FROM quakes")
def quakes_read(t: Tables) -> DataFrame:
    path, time = folder(t), F.date_format("origin_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    rows = t.quakes.select(time.alias("origin_time"), F.dayofyear("origin_time").alias("origin_julday"), "origin_latitude", "origin_longitude", "origin_depth_km", (F.col("origin_depth_km") * 0.5).alias("approx_distance_km"))
    rows.write.csv(path, header=True, sep="\t")
    return files.read_quakes(t.spark, path).drop("origin_time")


PICKS_FILE = "station, shot, phase, printf('%.3f', \"offset\")::DOUBLE AS \"offset\", printf('%.3f', tt)::DOUBLE AS tt, printf('%.3f', error)::DOUBLE AS error"


@query(f"SELECT {PICKS_FILE} FROM picks")
def picks_written_and_read(t: Tables) -> DataFrame:
    path = folder(t)
    files.write_picks(t.picks, path)
    return files.read_picks(t.spark, path)


@query(f"SELECT {PICKS_FILE}, true AS listed FROM picks WHERE phase > 0")
def picks_listed(t: Tables) -> DataFrame:
    """Only the files of refractions are in the list."""
    path = folder(t)
    files.write_picks(t.picks.where(F.col("phase") > 0), f"{path}/a")
    files.write_picks(t.picks.where(F.col("phase") <= 0), f"{path}/b")
    names = t.spark.read.text(f"{path}/a").select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("value")).distinct()
    names.write.text(f"{path}/list")
    rows = files.read_pick_list(t.spark, f"{path}/list", f"{path}/a")
    return rows.withColumn("listed", F.col("file").startswith("part-")).drop("file")


@query("SELECT nullif(s_name, '') AS name, CASE WHEN s_suppkey % 10 > 0 THEN s_suppkey % 97 * 0.005::DOUBLE + 57.4::DOUBLE END AS lat, s_acctbal AS lon FROM supplier")
def volcanoes_cleaned(t: Tables) -> DataFrame:
    path, k = folder(t), F.col("s_suppkey")
    lat = F.when(k % 10 > 0, k % 97 * F.lit(0.005) + 57.4)
    t.raw("supplier").select(F.col("s_name").alias("Volcano Name"), lat.alias("Latitude"), F.col("s_acctbal").alias("Longitude")).write.csv(path, header=True)
    return files.clean_volcanoes(t.spark.read.csv(path, header=True))


@query("SELECT 'line ' || o_orderkey AS event_name, o_orderkey % 131 * 0.004::DOUBLE + 56.5::DOUBLE AS start_latitude, o_orderpriority AS details, o_orderstatus AS url FROM orders")
def survey_lines_read(t: Tables) -> DataFrame:
    """Written with bare carriage returns and a byte-order mark before the names."""
    path = folder(t)
    made = {"event_name": F.concat(F.lit("﻿line "), F.col("o_orderkey").cast("string")), "start_latitude": F.col("o_orderkey") % 131 * F.lit(0.004) + 56.5, "details": F.col("o_orderpriority"), "url": F.col("o_orderstatus")}
    names = [c.split()[0] for c in files.LINES.split(", ")]
    t.raw("orders").select(*[made.get(n, F.lit("1.5")).alias(n) for n in names]).write.option("lineSep", "\r").csv(path, header=True)
    return files.read_survey_lines(t.spark, path).select("event_name", "start_latitude", "details", "url")


@query("SELECT trace_id, shot, station, round(list_sum(samples), 6) + 0.0::DOUBLE AS total FROM traces WHERE lineno = 1 AND station = 3023")
def traces_written_and_read(t: Tables) -> DataFrame:
    path = folder(t)
    files.write_traces_by_station(t.traces, path)
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)
    return files.read_traces(t.spark, path, 1, 3023).select("trace_id", "shot", "station", rounded(total, 6).alias("total"))


@query("SELECT x, z, dws, CASE WHEN k % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS flag FROM (SELECT l_orderkey::DOUBLE AS x, l_quantity::DOUBLE AS z, l_extendedprice::DOUBLE AS dws, l_partkey AS k FROM lineitem)")
def weights_read(t: Tables) -> DataFrame:
    path = folder(t)
    fields = [F.col(c).cast("double").cast("string") for c in ("l_orderkey", "l_quantity", "l_extendedprice")]
    flag = F.when(F.col("l_partkey") % 3 == 0, "-0.5").otherwise("0")
    t.raw("lineitem").select(F.concat(F.lit("   "), F.concat_ws("    ", *fields, flag)).alias("value")).write.text(path)
    return files.read_dws(t.spark, path)


@query("""SELECT vec_id // 20 AS inr, vec_id % 20 + 1 AS j, i::BIGINT AS k, embedding[i]::DOUBLE AS x, abs(embedding[i]::DOUBLE) * 2 AS z
FROM (SELECT vec_id, embedding, unnest(range(1, vec_id % 7 + 1)) AS i FROM embeddings)""")
def ray_points_cut(t: Tables) -> DataFrame:
    """Twenty rays in a chunk, of none to six points each."""
    k = F.col("vec_id")
    rays_of = t.raw("embeddings").groupBy(F.floor(k / 20).alias("inr")).agg(F.sort_array(F.collect_list(F.struct(k, F.slice("embedding", F.lit(1), (k % 7).cast("int")).alias("e")))).alias("r"))
    flat = F.flatten(F.col("r.e"))
    chunks = rays_of.select("inr", F.transform("r", lambda r: F.size(r["e"])).alias("len"), flat.alias("xry"), F.transform(flat, lambda x: F.abs(x) * 2).alias("zry"))
    return rays.ray_points(chunks, ["inr"]).select("inr", F.col("j").cast("long").alias("j"), F.col("k").cast("long").alias("k"), "x", "z")


@query('SELECT station, shot, phase, tt, tt + 0.25::DOUBLE AS tt_calc, error FROM picks')
def calculated_times(t: Tables) -> DataFrame:
    """The picks of a station and of a sixteenth of its shots are a chunk, as long arrays."""
    names = {"isk": "shot", "fas": "phase", "ttp": "tt", "etp": "error"}
    made = t.picks.groupBy(F.col("station").alias("inr"), (F.col("shot") % 16).alias("part")).agg(F.collect_list(F.struct("shot", "phase", "tt", "error")).alias("p"))
    chunks = made.select("inr", *[F.col(f"p.{c}").alias(n) for n, c in names.items()], F.transform("p", lambda p: p["tt"] + 0.25).alias("tca"))
    return rays.calculated_tts(chunks)
