"""The sweep of stacked shots leaves out no centre."""

import numpy as np
from pyspark.sql import functions as F

from seisframe.plans import queries


def test_shots_swept_takes_centres_of_any_number(spark, tmp_path, monkeypatch):
    seen = {}

    class View:
        def __init__(self, first):
            rng, shots = np.random.default_rng(1), range(first, first + 7)
            data = [(i, s, 3020, [float(v) for v in rng.normal(size=128)]) for i, s in enumerate(shots)]
            self.traces = spark.createDataFrame(data, "trace_id long, shot int, station int, samples array<double>").withColumn("fs", F.lit(queries.FS)).withColumn("t0", F.lit(0).cast("timestamp")).withColumn("lineno", F.lit(1))
            self.nodes = spark.createDataFrame([(3020, 57.4, -152.7, 0.0)], "code int, lat double, lon double, elev_m double")
            self.shots = spark.createDataFrame([(s, 1, 56.5, -152.9) for s in shots], "shotno int, lineno int, lat double, lon double")

    for first in (991, 2_000_000):
        seen[first] = {r.centre - first for r in queries.shots_swept(View(first)).select("centre").distinct().collect()}
    assert seen == {991: {2, 3, 4}, 2_000_000: {2, 3, 4}}
