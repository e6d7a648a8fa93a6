"""Pick tables: filters, edits, pickers, joins with calculated times, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import station_kind, virtual_station_id
from ..functions.kernels import per_trace, sta_lta


def phase_between(picks: DataFrame, itop: int, ibot: int, phase: str = "phase") -> DataFrame:
    """Phases from ``itop`` (shallow) to ``ibot`` (deep); 0, the first arrival, always stays.

    Negative numbers are reflections and positive ones refractions of the same layer; a negative
    bound counts the reflection in, a positive one starts or ends with the refraction.
    """
    top, bottom = abs(itop), abs(ibot)
    reflections = (-bottom, -top if itop < 0 else -top - 1)
    refractions = (top, bottom - 1 if ibot < 0 else bottom)
    p = F.col(phase)
    return picks.where((p == 0) | p.between(*reflections) | p.between(*refractions))


def visible_picks(picks: DataFrame, lo: float, hi: float, v_red: float = 6.0) -> DataFrame:
    """Picks strictly inside a window of reduced time."""
    red = F.col("tt") - F.col("offset") / v_red
    return picks.where((red > lo) & (red < hi))


def hidden_count(picks: DataFrame, lo: float, hi: float, v_red: float = 6.0, by: list[str] | None = None) -> DataFrame:
    """``n_hidden``: picks outside the window, of all or of each group ``by`` some columns."""
    red = F.col("tt") - F.col("offset") / v_red
    return picks.groupBy(*(by or [])).agg(F.count_if(~((red > lo) & (red < hi))).alias("n_hidden"))


def inside_model(picks: DataFrame, shots_xz: DataFrame, x1: float, x2: float, z1: float, z2: float) -> tuple[DataFrame, DataFrame]:
    """Shots within closed bounds (by their depth ``z``), and the picks whose shot is among them."""
    inside = shots_xz.where(F.col("x").between(x1, x2) & F.col("z").between(z1, z2))
    return picks.join(inside.select(F.col("shotno").alias("shot")), "shot", "left_semi"), inside


def route_station(picks: DataFrame) -> DataFrame:
    """Adds ``kind`` (virtual or broadband) and ``x_km`` or ``number``; other ids get a null kind."""
    kind = station_kind(F.col("station"))
    return picks.withColumn("kind", kind).withColumn("x_km", F.when(kind == "virtual", (F.col("station") - 1_000_000) * 1e-3)).withColumn("number", F.when(kind == "broadband", F.col("station") - 2_000_000))


def pending(items: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """Work that is not done yet."""
    return items.join(done.select(*on), on, "left_anti")


def merge_pick_calc(picks: DataFrame, calc: DataFrame) -> DataFrame:
    """Picks with ``tt_calc``; ``agrees`` says whether both tables tell the same time and error."""
    key = ["station", "shot", "phase"]
    other = calc.select(*key, "tt_calc", F.col("tt").alias("__tt"), F.col("error").alias("__e"))
    close = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 1e-8 + 1e-5 * F.abs(F.col(b))
    joined = picks.join(other, key)
    return joined.withColumn("agrees", close("tt", "__tt") & close("error", "__e")).drop("__tt", "__e")


def recover_shots(picks: DataFrame, offsets: DataFrame) -> DataFrame:
    """Finds ``shot`` by the offset in whole metres; ``offsets`` has ``shotno, offset`` (km) of a line.

    Of shots with equal metres the last one counts; picks without a match keep a null shot.
    """
    metres = lambda c: F.round(F.bround(F.col(c), 3) * 1000).cast("bigint")
    last = offsets.groupBy(metres("offset").alias("__m")).agg(F.max("shotno").alias("shot"))
    return picks.drop("shot").withColumn("__m", metres("offset")).join(last, "__m", "left").drop("__m")


#: kilometres of offset that are ordered in one task
TILE_KM = 8.0


def snap_to_trace(clicks: DataFrame, traces: DataFrame, group: str = "shot", width: float = TILE_KM) -> DataFrame:
    """Nearest existing trace offset of each click in its group; of two equally near, the smaller.

    Both sides meet in one ordering; no pairs are formed.  A group is ordered in tiles of ``width``, so it is the work of
    many tasks, and the nearest traces before and after a tile are carried into it from a table of the tiles'
    ends.  The work in a tile is one sort and one pass.  A click without an offset snaps to nothing.
    """
    id_type = clicks.schema["click_id"].dataType
    trace = lambda df: df.select(group, "offset", F.lit(None).cast(id_type).alias("click_id"), F.lit(False).alias("click"), "__tile")
    tile = F.floor(F.col("offset") / width)
    traces = traces.where(F.col("offset").isNotNull()).select(group, "offset", tile.alias("__tile"))
    both = clicks.select(group, "offset", "click_id", F.lit(True).alias("click"), tile.alias("__tile")).unionByName(trace(traces))
    # a frame that ends with the last row is added up anew for every row, while lead goes on from where it was
    following = lambda c, order: F.expr(f"lead({c}) IGNORE NULLS OVER (PARTITION BY `{group}`{order})")
    ends = both.where(F.col("offset").isNotNull()).groupBy(group, "__tile").agg(F.max("click").alias("clicked"), *[f(F.when(~F.col("click"), F.col("offset"))).alias(c) for f, c in ((F.min, "lo"), (F.max, "hi"))])
    before = F.last("hi", True).over(W.partitionBy(group).orderBy("__tile").rowsBetween(W.unboundedPreceding, -1))
    ends = ends.select(group, "__tile", "clicked", before.alias("before"), following("lo", " ORDER BY __tile").alias("after")).where("clicked")
    carried = ends.select(group, "__tile", F.explode(F.array("before", "after")).alias("offset")).where(F.col("offset").isNotNull())
    below = F.last(F.when(~F.col("click"), F.col("offset")), True).over(W.partitionBy(group, "__tile").orderBy("offset", "click").rowsBetween(W.unboundedPreceding, W.currentRow))
    near = both.unionByName(trace(carried)).withColumn("__b", below).withColumn("__a", following("IF(click, NULL, offset)", ", __tile ORDER BY offset, click")).where("click")
    closer = F.when(F.col("__b").isNull() | (F.col("__a") - F.col("offset") < F.col("offset") - F.col("__b")), F.col("__a")).otherwise(F.col("__b"))
    return near.select(group, "click_id", "offset", closer.alias("snapped"))


def same_station_shots(picks: DataFrame, shots: DataFrame) -> DataFrame:
    """``station`` with the shots its picks use, laid out by station."""
    used = picks.select("station", F.col("shot").alias("shotno")).distinct()
    return used.join(shots, "shotno").repartition("station")


def pick_summary(picks: DataFrame) -> DataFrame:
    return picks.groupBy("station").agg(F.count("*").alias("n_picks"), F.countDistinct("shot").alias("n_shots"), F.min("phase").alias("min_phase"), F.max("phase").alias("max_phase"))


def misfit(rays: DataFrame, by: list[str] | None = None, partials: DataFrame | None = None) -> DataFrame:
    """Number of used picks, root mean square residual and mean squared normalised residual.

    With ``partials`` (rows with ``station, shot, phase``) the picks that have at least one are used; without, all are.
    ``n_picks`` is the number of all.
    """
    key = ["station", "shot", "phase"]
    used = F.lit(True)
    if partials is not None:
        rays = rays.join(partials.select(*key).distinct().withColumn("__used", F.lit(True)), key, "left")
        used = F.col("__used")
    r = F.when(used, F.col("tt") - F.col("tt_calc"))
    grouped = rays.groupBy(*by) if by else rays
    return grouped.agg(F.count("*").alias("n_picks"), F.count_if(F.coalesce(used, F.lit(False))).alias("n"), F.sqrt(F.avg(r * r)).alias("rms"), F.avg(F.pow(r / F.col("error"), 2)).alias("chi2"))


def variance_reduction(rows: DataFrame) -> DataFrame:
    """From rows ``kind`` (data or reg), ``before, after``: reduction, chi squared after, penalty."""
    data, reg = F.col("kind") == "data", F.col("kind") == "reg"
    square = lambda c, when: F.sum(F.when(when, F.col(c) * F.col(c)))
    sums = rows.agg(square("before", data).alias("v0"), square("after", data).alias("v1"), F.count_if(data).alias("n"), F.coalesce(square("after", reg), F.lit(0.0)).alias("penalty"))
    return sums.select(F.try_divide(F.col("v0") - F.col("v1"), F.col("v0")).alias("reduction"), F.try_divide("v1", "n").alias("chi2"), "penalty")


def apply_pick_edits(picks: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits ``shot, offset, tt, error, action (set or delete), seq`` in order; the last one counts."""
    first = picks.select("shot", "offset", "tt", "error", F.lit("set").alias("action"), F.lit(None).cast("bigint").alias("seq"))
    log = first.unionByName(edits.select("shot", "offset", "tt", "error", "action", F.col("seq").cast("bigint").alias("seq")))
    last = W.partitionBy("shot", "offset").orderBy(F.col("seq").desc_nulls_last(), F.col("tt"))
    return log.withColumn("__n", F.row_number().over(last)).where((F.col("__n") == 1) & (F.col("action") != "delete")).select("shot", "offset", "tt", "error")


def make_virtual_picks(picks: DataFrame, shot_x: DataFrame, phase: int) -> DataFrame:
    """Six pick columns with the virtual station 250 m-rounded below the receiver."""
    at = picks.join(shot_x.select(F.col("shotno").alias("shot"), "x"), "shot")
    station = virtual_station_id(F.rint((F.col("x") - F.col("offset")) / 0.25) * 0.25)
    return at.select(station.cast("int").alias("station"), "shot", F.lit(phase).alias("phase"), "offset", "tt", "error")


def make_broadband_picks(picks: DataFrame, offsets: DataFrame, number: int, phase: int) -> DataFrame:
    """Six pick columns of one broadband station; shots are recovered from offsets."""
    found = recover_shots(picks, offsets)
    return found.select(F.lit(2_000_000 + number).alias("station"), "shot", F.lit(phase).alias("phase"), "offset", "tt", "error")


def first_above(samples: Column, fs: Column, threshold: float) -> tuple[Column, Column]:
    """Time of the first sample above a threshold (0 if none) and whether there is one."""
    at = F.array_position(F.transform(samples, lambda x: x > threshold), True)
    return F.greatest(at - 1, F.lit(0)) / fs, at > 0


def first_above_in(samples: Column, fs: Column, offset: Column, threshold: float, lo: float, hi: float, v_red: float = 6.0) -> tuple[Column, Column]:
    """As ``first_above``, looking only where reduced time is strictly inside a window."""

    def good(x: Column, i: Column) -> Column:
        red = i / fs - offset / v_red
        return (x > threshold) & (red > lo) & (red < hi)

    at = F.array_position(F.transform(samples, good), True)
    return F.greatest(at - 1, F.lit(0)) / fs, at > 0


def peak_time(samples: Column, fs: Column) -> Column:
    """Time of the first largest sample."""
    return (F.array_position(samples, F.array_max(samples)) - 1) / fs


def sta_lta_from_onset(samples: Column, nsta: int, nlta: int) -> Column:
    """STA/LTA restarted at the first positive sample; the samples before it stay."""
    import numpy as np

    def run(x: np.ndarray) -> np.ndarray:
        out = x.copy()
        onset = (x > 0).argmax(1) if x.shape[1] else np.zeros(0, int)
        for i in np.unique(onset).tolist():  # traces of one onset together
            rows = np.flatnonzero(onset == i)
            out[rows, i:] = sta_lta(x[rows, i:], nsta, nlta)
        return out

    return per_trace(run, samples)


def guess_picks(binned: DataFrame, lo: float, hi: float, fs: float, short_s: float = 0.002, long_s: float = 0.2, threshold: float = 4.0, v_red: float = 6.0, keys: list[str] | None = None) -> DataFrame:
    """Automatic picks of binned sums (``offset, samples``): ``keys`` (or ``offset``), ``tt, hit``."""
    ratio = binned.withColumn("samples", sta_lta_from_onset(F.col("samples"), max(1, int(short_s * fs)), max(1, int(long_s * fs))))
    tt, hit = first_above_in(F.col("samples"), F.lit(fs), F.col("offset"), threshold, lo, hi, v_red)
    return ratio.select(*(keys or ["offset"]), tt.alias("tt"), hit.alias("hit"))


def trace_order(picks: DataFrame) -> DataFrame:
    """``ord`` of a station's picks for tracing: by phase size, reflections first, then shot."""
    rank = 2 * F.abs("phase") + (F.col("phase") > 0).cast("int")
    return picks.withColumn("ord", F.row_number().over(W.partitionBy("station").orderBy(rank, "shot")))


def tt_curves(picks: DataFrame, calc: DataFrame, shot: int | None = None, v_red: float = 6.0) -> DataFrame:
    """Reduced picked and calculated times by offset, of one shot or of all."""
    if shot is not None:
        calc = calc.where(F.col("shot") == shot)
    joined = merge_pick_calc(picks, calc)
    red = lambda c: F.col(c) - F.col("offset") / v_red
    return joined.select("station", "shot", "phase", "offset", red("tt").alias("red_tt"), red("tt_calc").alias("red_calc"), "error")


def model_sweep(spark, lists: dict[str, list[float]]) -> DataFrame:
    """Every combination of short parameter lists, and ``name``: the values joined by dashes."""
    out = None
    for name, values in lists.items():
        one = spark.createDataFrame([(float(v),) for v in values], f"`{name}` double")
        out = one if out is None else out.join(F.broadcast(one))  # a handful of rows each
    label = F.regexp_replace(F.concat_ws("-", *[F.col(n).cast("string") for n in lists]), "\\.", "_")
    return out.withColumn("name", label)
