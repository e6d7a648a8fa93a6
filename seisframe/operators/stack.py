"""Offset bins, sums of traces, alignment and stacks of neighbouring shots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels

#: sums a task holds before it passes them on, and samples of traces that are added up at a time
HELD, VALUES = 256, 4_000_000


def bin_id(offset: Column, size: float) -> Column:
    """Number of the bin, half-even: the key to group by, never the offset itself."""
    return F.rint(offset / size).cast("bigint")


def offset_bin(offset: Column, size: float) -> Column:
    return F.rint(offset / size) * size


def bin_axis(spark, min_offset: float, max_offset: float, size: float) -> DataFrame:
    """Every bin between two offsets, both ends included."""
    lo, hi = int(np.rint(min_offset / size)), int(np.rint(max_offset / size))
    return spark.range(lo, hi + 1).select(F.col("id").alias("bin_id"), (F.col("id") * F.lit(size)).alias("offset"))


def on_axis(axis: DataFrame, stacked: DataFrame) -> DataFrame:
    """The axis with counts, 0 where no trace fell."""
    return axis.join(stacked, "bin_id", "left").withColumn("count", F.coalesce("count", F.lit(0)).cast("long"))


def _sums(rows: pd.DataFrame, keys: list[str]) -> Iterator[tuple[tuple, int, np.ndarray]]:
    """Key, count and sum of the groups of some rows, by sorted keys on a matrix of traces."""
    step = max(1, VALUES // max(1, max(map(len, rows["sum"]))))
    for lo in range(0, len(rows), step):
        part = rows.iloc[lo : lo + step]
        code = part.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
        order = np.argsort(code, kind="stable")
        first = np.flatnonzero(np.diff(code[order], prepend=-1))
        traces = [np.asarray(s, np.float64) for s in part["sum"]]
        if len({len(s) for s in traces}) > 1:
            raise ValueError("traces of a bin have different lengths")
        sums = np.add.reduceat(np.stack(traces)[order], first, axis=0)
        counts = np.add.reduceat(part["count"].to_numpy(np.int64)[order], first) if "count" in part else np.diff(first, append=len(order))
        names = part[keys].iloc[order[first]].itertuples(index=False, name=None)
        yield from zip(names, counts.tolist(), sums, strict=True)


def _partial_sums(keys: list[str], held_at_most: int):
    """Sums of the rows of a task, passed on when more than so many groups are held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}

        def flush(keep: tuple | None = None) -> pd.DataFrame:
            kept = held.pop(keep, None)
            rows = [(*k, n, s) for k, (n, s) in held.items()]
            held.clear()
            if kept is not None:
                held[keep] = kept
            return pd.DataFrame(rows, columns=[*keys, "count", "sum"])

        for rows in batches:
            if not len(rows):
                continue
            last = None
            for key, n, values in _sums(rows, keys):
                last = key = tuple(None if pd.isna(k) else k for k in key)
                if key not in held:
                    held[key] = [n, values.copy()]
                    continue
                own = held[key]
                if len(values) != len(own[1]):
                    raise ValueError("traces of a bin have different lengths")
                own[0] += n
                own[1] += values
            if len(held) > held_at_most:
                yield flush(last)  # in sorted rows this group may go on
        if held:
            yield flush()

    return run


def bin_stack(traces: DataFrame, keys: list[str], salts: int = 1) -> DataFrame:
    """Count and element-wise sum of ``samples`` per key.

    Tasks add up what they read before anything is shuffled, so a bin brings one row from each task, however many
    traces fall in it.  These rows are sorted by bin and added up as they come: one shuffle, no group is held as a
    whole, and arrays are never exploded.  With very many tasks, ``salts`` lets the rows of a bin meet in so many
    places first, at the price of a second shuffle.
    """
    types = {f.name: f.dataType.simpleString() for f in traces.schema}
    named = ", ".join(f"`{k}` {types[k]}" for k in keys)
    schema = f"{named}, count long, sum array<double>"
    found = traces.select(*keys, F.col("samples").alias("sum")).mapInPandas(_partial_sums(keys, HELD), schema)
    merge = _partial_sums(keys, 1)
    if salts > 1:
        salt = F.pmod(F.spark_partition_id(), F.lit(salts))
        found = found.withColumn("__salt", salt).repartition(*keys, "__salt").sortWithinPartitions(*keys).drop("__salt").mapInPandas(merge, schema)
    return found.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(merge, schema)


def bin_mean(stacked: DataFrame) -> DataFrame:
    """Adds ``mean``; null for an empty bin."""
    return stacked.withColumn("mean", F.when(F.col("count") > 0, F.transform("sum", lambda x: x / F.col("count"))))


def neighbour_shots(shots: DataFrame, k: int) -> DataFrame:
    """``centre, shot``: every shot with those up to ``k`` numbers away that exist."""
    pairs = shots.select(F.col("shotno").alias("centre"), F.explode(F.sequence(F.lit(-k), F.lit(k))).alias("d"))
    return pairs.select("centre", (F.col("centre") + F.col("d")).alias("shot")).join(shots.select(F.col("shotno").alias("shot")).distinct(), "shot", "left_semi")


def gather_same_station(traces: DataFrame, k: int) -> DataFrame:
    """``centre, station, shot, trace_id`` where all ``2k + 1`` shots around a centre have the station.

    Each trace offers itself to its neighbours by number only; samples are not copied.
    """
    own = traces.select("shot", "station", "trace_id")
    offered = own.withColumn("centre", F.explode(F.sequence(F.col("shot") - k, F.col("shot") + k)))
    full = offered.groupBy("centre", "station").agg(F.countDistinct("shot").alias("n")).where(F.col("n") == 2 * k + 1).select("centre", "station")
    return offered.join(full, ["centre", "station"], "left_semi")


def stack_aligned(samples: np.ndarray, offsets: np.ndarray, centre: int, vmin: float, vmax: float, fs: float, method: str = "mean", align: str = "reference") -> np.ndarray:
    """Neighbours shifted onto the centre trace by their best lag, then averaged."""
    if method not in ("mean", "median"):
        raise ValueError(f"unknown stacking method {method}")
    moved = [kernels.shift_pad(b, kernels.best_lag(samples[centre], b, offsets[i] - offsets[centre], vmin, vmax, fs, align)) for i, b in enumerate(samples)]
    return np.mean(moved, 0) if method == "mean" else np.median(moved, 0)


def align_stack(traces: DataFrame, k: int, fs: float, vmin: float = 5000.0, vmax: float = 7000.0, method: str = "mean", align: str = "reference", centres: tuple[float, float] | None = None, split: tuple[int, float, float] | None = None, block: int = 256) -> DataFrame:
    """``centre, station, offset_m, samples``: the stack of the ``2k + 1`` shots around each centre.

    ``traces`` has ``shot, station, offset_m, samples``, one trace per shot and station.  A station's
    shots are cut into blocks of ``block`` numbers with a halo of ``k`` on both sides; one shuffle
    brings a block together, and the centres slide over it, so samples are copied for the halos
    only and a group is bounded.  Centres that miss a neighbour give no row.  ``split`` gives other
    velocities from a shot number on.
    """
    if method not in ("mean", "median"):
        raise ValueError(f"unknown stacking method {method}")
    shot = F.col("shot")
    homes = F.array_distinct(F.transform(F.array(F.lit(-k), F.lit(0), F.lit(k)), lambda d: F.floor((shot + d) / block)))
    rows = traces.select("shot", "station", "offset_m", "samples", F.explode(homes).alias("block"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("shot")
        shots, home = rows["shot"].to_numpy(), int(rows["block"].iloc[0])
        samples = [np.asarray(s, np.float64) for s in rows["samples"]]
        offsets = rows["offset_m"].to_numpy(np.float64)
        out = []
        for i, c in enumerate(shots):
            if c // block != home or (centres and not centres[0] <= c <= centres[1]):
                continue
            lo, hi = i - k, i + k
            if lo < 0 or hi >= len(shots) or shots[lo] != c - k or shots[hi] != c + k:
                continue
            v0, v1 = split[1:] if split and c >= split[0] else (vmin, vmax)
            out.append((c, rows["station"].iloc[0], offsets[i], stack_aligned(np.stack(samples[lo : hi + 1]), offsets[lo : hi + 1], k, v0, v1, fs, method, align)))
        return pd.DataFrame(out, columns=["centre", "station", "offset_m", "samples"])

    kind = {f.name: f.dataType.simpleString() for f in traces.schema}
    return rows.groupBy("station", "block").applyInPandas(run, f"centre {kind['shot']}, station {kind['station']}, offset_m double, samples array<double>")
