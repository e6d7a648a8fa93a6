"""Domain views of the driver's tables, once as DataFrames and once as SQL.

Keys and values come from the tables row by row, so every query's work grows with them.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FS = 16.0
FIRST_SHOT, STATIONS = 991, 10


class Tables:
    """Views over one directory of Parquet tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        """A table with its times as instants of the session's zone, which is UTC."""
        df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        plain = [c for c, kind in df.dtypes if kind == "timestamp_ntz"]
        return df.withColumns({c: F.col(c).cast("timestamp") for c in plain}) if plain else df

    @property
    def traces(self) -> DataFrame:
        shot = (F.floor(F.col("vec_id") / STATIONS) + FIRST_SHOT).cast("int")
        return self.raw("embeddings").select(
            F.col("vec_id").alias("trace_id"),
            (F.floor(F.col("vec_id") / 500) + 1).cast("int").alias("lineno"),
            shot.alias("shot"),
            (F.col("vec_id") % STATIONS + 3020).cast("int").alias("station"),
            F.timestamp_seconds(F.lit(1_560_000_000) + F.col("vec_id") * 60).alias("t0"),
            F.lit(FS).alias("fs"),
            F.transform("embedding", lambda x: x.cast("double")).alias("samples"),
        )

    @property
    def nodes(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.raw("supplier").select((k + 3019).cast("int").alias("code"), (k % 97 * F.lit(0.005) + 57.4).alias("lat"), (k % 89 * F.lit(0.005) - 152.7).alias("lon"), F.col("s_acctbal").alias("elev_m"))

    @property
    def shots(self) -> DataFrame:
        k = F.col("o_orderkey")
        return self.raw("orders").select((k + 990).cast("int").alias("shotno"), (F.col("o_custkey") % 5 + 1).cast("int").alias("lineno"), F.col("o_orderdate").alias("time"), (k % 131 * F.lit(0.004) + 56.5).alias("lat"), (k % 113 * F.lit(0.006) - 152.9).alias("lon"))

    @property
    def quakes(self) -> DataFrame:
        k = F.col("event_id")
        return self.raw("events").select(F.col("event_id").alias("quake_id"), F.col("ts").alias("origin_time"), (F.unix_micros("ts") * 1000).alias("ns"), (k % 311 * F.lit(0.01) + 55.0).alias("origin_latitude"), (k % 211 * F.lit(0.01) - 154.0).alias("origin_longitude"), (k % 170 + F.lit(0.6)).alias("origin_depth_km"))

    @property
    def picks(self) -> DataFrame:
        """One pick per station, shot and phase: the one with the least price."""
        phase = F.when(F.col("l_linenumber") % 4 == 0, -2).otherwise(F.col("l_linenumber") % 4).cast("int")
        rows = self.raw("lineitem").select(
            F.col("l_suppkey").alias("station"), F.col("l_orderkey").alias("shot"), phase.alias("phase"), (F.col("l_quantity") * 5.0).alias("offset"), (F.col("l_extendedprice") / 1e4).alias("tt"),
            F.when(F.col("l_returnflag") == "A", 0.04).when(F.col("l_returnflag") == "N", 0.1).otherwise(0.2).alias("error"),
        )
        return rows.groupBy("station", "shot", "phase").agg(F.min(F.struct("tt", "offset", "error")).alias("p")).select("station", "shot", "phase", "p.offset", "p.tt", "p.error")

    @property
    def calc(self) -> DataFrame:
        """The picks' times off by a fixed amount per shot; stations without an account have none."""
        known = self.raw("supplier").where(F.col("s_acctbal") > 0).select(F.col("s_suppkey").alias("station"))
        return self.picks.join(known, "station", "left_semi").withColumn("tt_calc", F.col("tt") + (F.col("shot") % 7 - 3) * F.lit(0.01)).drop("offset")

    @property
    def edits(self) -> DataFrame:
        return self.raw("events").select(F.col("user_id").alias("shot"), (F.col("event_id") % 50).cast("double").alias("offset"), F.col("value").alias("tt"), F.lit(0.1).alias("error"), F.when(F.col("event_type") == "error", "delete").otherwise("set").alias("action"), F.col("event_id").alias("seq"))

    @property
    def records(self) -> DataFrame:
        """Recordings of two to five minutes, one per order."""
        k = F.col("o_orderkey")
        start = F.lit(1_704_067_200) + k % 720 * 3600 + k % 59 * 60
        ends = start + (k % 4 + 2) * 60
        return self.raw("orders").select(k.alias("record_id"), F.timestamp_seconds(start).alias("t_start"), F.timestamp_seconds(ends).alias("t_end"))

    @property
    def events(self) -> DataFrame:
        return self.raw("events").select(F.col("event_id").alias("shotno"), F.col("ts").alias("time"))

    @property
    def ray_points(self) -> DataFrame:
        e = self.raw("embeddings").select(F.col("vec_id").alias("ray"), F.posexplode("embedding").alias("i", "e"))
        return e.select("ray", (F.col("i") + 1).alias("k"), (F.col("i") * 3.9).alias("x"), (F.abs(F.col("e").cast("double")) * 30).alias("z"))

    @property
    def arrivals(self) -> DataFrame:
        """Arrival times of an order's lines at their suppliers, from a source inside the array."""
        k = F.col("l_suppkey")
        at = self.raw("lineitem").select(F.col("l_orderkey").alias("event_id"), (k % 17).cast("double").alias("x"), (k % 13).cast("double").alias("y")).distinct()
        sx, sy = F.col("event_id") % 7 + 5.3, F.col("event_id") % 5 + 4.7
        d = F.sqrt((F.col("x") - sx) * (F.col("x") - sx) + (F.col("y") - sy) * (F.col("y") - sy))
        return at.withColumn("t", d / 2.0 + 1.0)


def folder(t: Tables) -> str:
    """A new folder that all executors see: in ``spark.checkpoint.dir``, or on one machine a temporary one."""
    base = t.spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if t.spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/seisframe-files-{uuid.uuid4().hex}"


#: the same views for SQL
VIEWS = {
    "traces": "SELECT vec_id AS trace_id, (vec_id // 500 + 1)::INT AS lineno, (vec_id // 10 + 991)::INT AS shot, (vec_id % 10 + 3020)::INT AS station, embedding::DOUBLE[] AS samples FROM embeddings",
    "smp": "SELECT trace_id, lineno, shot, station, i, samples[i] AS x FROM (SELECT *, unnest(range(1, len(samples) + 1)) AS i FROM traces)",
    "nodes": "SELECT (s_suppkey + 3019)::INT AS code, s_suppkey % 97 * 0.005::DOUBLE + 57.4::DOUBLE AS lat, s_suppkey % 89 * 0.005::DOUBLE - 152.7::DOUBLE AS lon, s_acctbal AS elev_m FROM supplier",
    "shots": "SELECT (o_orderkey + 990)::INT AS shotno, (o_custkey % 5 + 1)::INT AS lineno, o_orderdate AS time, o_orderkey % 131 * 0.004::DOUBLE + 56.5::DOUBLE AS lat, o_orderkey % 113 * 0.006::DOUBLE - 152.9::DOUBLE AS lon FROM orders",
    "quakes": "SELECT event_id AS quake_id, ts AS origin_time, epoch_us(ts) * 1000 AS ns, event_id % 311 * 0.01::DOUBLE + 55.0::DOUBLE AS origin_latitude, event_id % 211 * 0.01::DOUBLE - 154.0::DOUBLE AS origin_longitude, event_id % 170 + 0.6::DOUBLE AS origin_depth_km FROM events",
    "picks": "SELECT station, shot, phase, p.\"offset\" AS \"offset\", p.tt AS tt, p.error AS error FROM (SELECT l_suppkey AS station, l_orderkey AS shot, (CASE WHEN l_linenumber % 4 = 0 THEN -2 ELSE l_linenumber % 4 END)::INT AS phase, min({'tt': l_extendedprice / 1e4, 'offset': l_quantity * 5.0::DOUBLE, 'error': CASE l_returnflag WHEN 'A' THEN 0.04::DOUBLE WHEN 'N' THEN 0.1::DOUBLE ELSE 0.2::DOUBLE END}) AS p FROM lineitem GROUP BY 1, 2, 3)",
    "calc": "SELECT station, shot, phase, tt, error, tt + (shot % 7 - 3) * 0.01::DOUBLE AS tt_calc FROM picks WHERE station IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)",
    "edits": "SELECT user_id AS shot, (event_id % 50)::DOUBLE AS \"offset\", value AS tt, 0.1::DOUBLE AS error, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'set' END AS action, event_id AS seq FROM events",
    "records": "SELECT o_orderkey AS record_id, TIMESTAMP '2024-01-01' + to_minutes((o_orderkey % 720 * 60 + o_orderkey % 59)::INT) AS t_start, TIMESTAMP '2024-01-01' + to_minutes((o_orderkey % 720 * 60 + o_orderkey % 59 + o_orderkey % 4 + 2)::INT) AS t_end FROM orders",
    "pts": "SELECT ray, i AS k, (i - 1) * 3.9::DOUBLE AS x, abs(embedding[i]::DOUBLE) * 30 AS z FROM (SELECT vec_id AS ray, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)",
    "arrivals": "SELECT event_id, x, y, sqrt((x - (event_id % 7 + 5.3::DOUBLE)) * (x - (event_id % 7 + 5.3::DOUBLE)) + (y - (event_id % 5 + 4.7::DOUBLE)) * (y - (event_id % 5 + 4.7::DOUBLE))) / 2.0::DOUBLE + 1.0::DOUBLE AS t FROM (SELECT DISTINCT l_orderkey AS event_id, (l_suppkey % 17)::DOUBLE AS x, (l_suppkey % 13)::DOUBLE AS y FROM lineitem)",
}


def sql(body: str) -> str:
    """A query over the views; ``body`` may begin with further ``name AS (...),`` parts."""
    with_ = "WITH RECURSIVE " if body.lstrip().startswith("+ RECURSIVE ") else "WITH "
    body = body.replace("+ RECURSIVE ", "+ ", 1)
    return with_ + ", ".join(f"{name} AS ({text})" for name, text in VIEWS.items()) + (", " if body.lstrip().startswith("+") else " ") + body.lstrip().removeprefix("+")
