"""The survey's workloads: binned lines and events, unbinned gathers, stacked shots."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.geometry import quake_offset_km, source_receiver_offset
from ..operators.stack import align_stack, bin_id, bin_stack
from ..operators.traces import dedupe_traces, drop_bad_stations, processed

LINE_BIN_KM, QUAKE_BIN_KM = 0.25, 0.1
#: shots from this number on are stacked with the faster velocity window
FAST_FROM, FAST, SLOW = 1250, (7000.0, 9000.0), (5000.0, 7000.0)


def bin_line(traces: DataFrame, nodes: DataFrame, shots: DataFrame, fs: float, mode: str = "envelope_stalta", size_km: float = LINE_BIN_KM, **windows) -> DataFrame:
    """Whole-line stack by offset: ``lineno, bin_id, count, sum``.  One shuffle, of partial sums."""
    ready = processed(drop_bad_stations(traces), fs, mode, **windows)
    at = source_receiver_offset(ready, nodes, shots).where(F.col("offset_m").isNotNull())
    return bin_stack(at.select("lineno", bin_id(F.col("offset_m") / 1e3, size_km).alias("bin_id"), "samples"), ["lineno", "bin_id"])


def bin_quake(traces: DataFrame, nodes: DataFrame, quakes: DataFrame, fs: float, mode: str = "stalta", size_km: float = QUAKE_BIN_KM, **windows) -> DataFrame:
    """Event stack by distance through the Earth; ``traces`` has ``ns`` in place of a shot."""
    band = {"low": 0.5, "high": 2.0} if mode == "bandpass" else {"short_s": 0.01, "long_s": 1.0}
    ready = processed(drop_bad_stations(traces), fs, mode, **(band | windows))
    at = quake_offset_km(ready, nodes, quakes).where(F.col("offset_km").isNotNull())
    return bin_stack(at.select("ns", bin_id(F.col("offset_km"), size_km).alias("bin_id"), "samples"), ["ns", "bin_id"])


def unbinned_gather(traces: DataFrame, nodes: DataFrame, shots: DataFrame, fs: float, mode: str = "bandpass_norm", **windows) -> DataFrame:
    """Processed traces with their offsets (km); sort by offset to draw them."""
    ready = processed(drop_bad_stations(traces), fs, mode, **windows)
    at = source_receiver_offset(ready, nodes, shots)
    return at.select("trace_id", "shot", "station", (F.col("offset_m") / 1e3).alias("offset"), "samples")


def prepared(traces: DataFrame, nodes: DataFrame, shots: DataFrame, fs: float, mode: str = "stalta", **windows) -> DataFrame:
    ready = processed(drop_bad_stations(dedupe_traces(traces)), fs, mode, **windows)
    return source_receiver_offset(ready, nodes, shots).where(F.col("offset_m").isNotNull())


def megashot(traces: DataFrame, nodes: DataFrame, shots: DataFrame, fs: float, k: int, vmin: float, vmax: float, method: str = "mean", align: str = "reference", size_km: float = LINE_BIN_KM, mode: str = "stalta", **windows) -> DataFrame:
    """``centre, bin_id, count, sum``: neighbours stacked onto every centre, then binned by its offset."""
    stacks = align_stack(prepared(traces, nodes, shots, fs, mode, **windows), k, fs, vmin, vmax, method, align)
    return bin_stack(stacks.select("centre", bin_id(F.col("offset_m") / 1e3, size_km).alias("bin_id"), "samples"), ["centre", "bin_id"])


def megashot_single(traces: DataFrame, nodes: DataFrame, shots: DataFrame, fs: float, k: int, centre: int, station: int, vmin: float, vmax: float, mode: str = "stalta", **windows) -> DataFrame:
    """Mean stack of one station around one centre."""
    near = traces.where((F.col("station") == station) & F.col("shot").between(centre - k, centre + k))
    return align_stack(prepared(near, nodes, shots, fs, mode, **windows), k, fs, vmin, vmax, "mean", centres=(centre, centre))


def megashot_sweep(traces: DataFrame, nodes: DataFrame, shots: DataFrame, fs: float, k: int, first: int | None = None, last: int | None = None, size_km: float = LINE_BIN_KM, mode: str = "stalta", fast_from: int = FAST_FROM, **windows) -> DataFrame:
    """All centres from ``first`` to ``last`` (every centre where they are none) in one pass, with the
    velocity window that belongs to each."""
    if first is not None:
        traces = traces.where(F.col("shot") >= first - k)
    if last is not None:
        traces = traces.where(F.col("shot") <= last + k)
    ready = prepared(traces, nodes, shots, fs, mode, **windows)
    centres = (-math.inf if first is None else first, math.inf if last is None else last)
    stacks = align_stack(ready, k, fs, *SLOW, centres=centres, split=(fast_from, *FAST))
    return bin_stack(stacks.select("centre", bin_id(F.col("offset_m") / 1e3, size_km).alias("bin_id"), "samples"), ["centre", "bin_id"])
