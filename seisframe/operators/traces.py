"""Filters and per-sample functions of trace tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.kernels import per_trace

#: fixed values: instruments known to be broken
BAD_STATIONS = (3025, 4016)


def drop_bad_stations(traces: DataFrame, bad: tuple[int, ...] = BAD_STATIONS) -> DataFrame:
    return traces.where(~F.col("station").isin(*bad))


def shots_for_line(shots: DataFrame, lineno: int) -> DataFrame:
    return shots.where(F.col("lineno") == lineno).select("shotno").orderBy("shotno")


def trace_at(traces: DataFrame, shot: int, station: int) -> DataFrame:
    """First trace of a station within a shot."""
    return traces.where((F.col("shot") == shot) & (F.col("station") == station)).orderBy("t0", "trace_id").limit(1)


def dedupe_traces(traces: DataFrame) -> DataFrame:
    """The first trace of each station in a shot, by start time and id."""
    order = W.partitionBy("shot", "station").orderBy("t0", "trace_id")
    return traces.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def normalize_peak(traces: DataFrame, signed: bool = False) -> DataFrame:
    """Samples over their largest absolute value (or largest value); traces without one go."""
    size = F.array_max("samples") if signed else F.array_max(F.transform("samples", F.abs))
    kept = traces.withColumn("__p", size).where((F.col("__p") != 0) & ~F.isnan("__p"))
    return kept.withColumn("samples", F.transform("samples", lambda x: x / F.col("__p"))).drop("__p")


def shift_pad(samples: Column, lag: Column) -> Column:
    """Positive lags shift left, negative ones right; zeros move in and the length stays."""
    n = F.size(samples)
    by = F.least(F.abs(lag).cast("int"), n)
    zeros = F.array_repeat(F.lit(0.0), by)
    kept = n - by
    left = F.concat(F.slice(samples, by + 1, kept), zeros)
    right = F.concat(zeros, F.slice(samples, F.lit(1), kept))
    return F.when(lag >= 0, left).otherwise(right)


def trim_pad(samples: Column, fs: Column, begin_s: Column, length: int) -> Column:
    """``length`` samples from ``begin_s`` seconds after the first one, zero-padded on both ends.

    The first sample at or after the wanted time is used, never a nearer earlier one.
    """
    first = F.ceil(F.round(begin_s * fs, 6)).cast("int")
    before = F.least(F.greatest(-first, F.lit(0)), F.lit(length))
    start = F.greatest(first, F.lit(0))
    take = F.greatest(F.least(F.lit(length) - before, F.size(samples) - start), F.lit(0))
    inner = F.when(take > 0, F.slice(samples, start + 1, take)).otherwise(F.array().cast("array<double>"))
    return F.concat(F.array_repeat(F.lit(0.0), before), inner, F.array_repeat(F.lit(0.0), F.lit(length) - before - take))


def sta_lta(samples: Column | str, nsta: int, nlta: int) -> Column:
    return per_trace(lambda x: kernels.sta_lta(x, nsta, nlta), F.col(samples) if isinstance(samples, str) else samples)


def agc(samples: Column | str, length: int) -> Column:
    return per_trace(lambda x: kernels.agc(x, length), F.col(samples) if isinstance(samples, str) else samples)


def bandpass(samples: Column | str, fs: float, low: float, high: float, zerophase: bool = True) -> Column:
    return per_trace(lambda x: kernels.bandpass(x, fs, low, high, zerophase), F.col(samples) if isinstance(samples, str) else samples)


def envelope(samples: Column | str) -> Column:
    return per_trace(kernels.envelope, F.col(samples) if isinstance(samples, str) else samples)


def processed(traces: DataFrame, fs: float, mode: str, low: float = 3.0, high: float = 20.0, short_s: float = 0.05, long_s: float = 5.0, agc_s: float = 2.0, zerophase: bool = True) -> DataFrame:
    """All per-sample steps of a mode in one Arrow pass.

    Modes: ``bandpass``, ``bandpass_norm``, ``bandpass_agc``, ``stalta`` (band-pass, STA/LTA) and
    ``envelope_stalta`` (band-pass, envelope, STA/LTA); the last two and ``bandpass_norm`` end with
    peak normalisation.  Traces that come out empty of signal go.
    """
    nsta, nlta = max(1, round(short_s * fs)), max(1, round(long_s * fs))

    def run(x):
        y = kernels.bandpass(x, fs, low, high, zerophase)
        if mode == "bandpass":
            return y
        if mode == "bandpass_norm":
            return kernels.normalize_peak(y)
        if mode == "bandpass_agc":
            return kernels.agc(y, 2 * round(agc_s * fs / 2))
        if mode == "envelope_stalta":
            y = kernels.envelope(y)
        elif mode != "stalta":
            raise ValueError(f"unknown mode {mode}")
        return kernels.normalize_peak(kernels.sta_lta(y, nsta, nlta))

    out = traces.withColumn("samples", per_trace(run, F.col("samples")))
    return out.where(F.size("samples") > 0).where(~F.isnan(F.get("samples", 0)))
