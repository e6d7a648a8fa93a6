"""Ray tables: ``ray`` (any key columns), ``k`` (1, 2, ...), ``x``, ``z`` and, if a point must stay,
``fixed``.  Every step works inside one partitioning by ray."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .grid import Grid, velocity_at


def ray_points(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, j, k, x, z``: the flat point arrays of a chunk cut by its rays' lengths."""
    ray = F.flatten(F.transform("len", lambda n, j: F.array_repeat(j, n)))
    place = F.flatten(F.transform("len", lambda n: F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))))
    zipped = F.arrays_zip(ray.alias("j"), place.alias("k"), F.col("xry").alias("x"), F.col("zry").alias("z"))
    rows = chunks.select(*keys, F.explode(zipped).alias("p"))
    return rows.select(*keys, (F.col("p.j") + 1).alias("j"), F.col("p.k").alias("k"), F.col("p.x").cast("double").alias("x"), F.col("p.z").cast("double").alias("z")).where(F.col("j").isNotNull())


def calculated_tts(chunks: DataFrame) -> DataFrame:
    """One row per pick of a chunk."""
    p = F.explode(F.arrays_zip("isk", "fas", "ttp", "tca", "etp"))
    rows = chunks.select(F.col("inr").alias("station"), p.alias("p"))
    number = lambda c, n: F.col(f"p.{c}").cast("double").alias(n)
    return rows.select("station", F.col("p.isk").alias("shot"), F.col("p.fas").alias("phase"), number("ttp", "tt"), number("tca", "tt_calc"), number("etp", "error"))


def _along(ray: list[str]):
    return W.partitionBy(*ray).orderBy("k")


def segments(points: DataFrame, ray: list[str]) -> DataFrame:
    """``ray, k`` (of the end point), both ends, the midpoint and the length."""
    w = _along(ray)
    rows = points.select(*ray, "k", F.lag("x").over(w).alias("xa"), F.lag("z").over(w).alias("za"), F.col("x").alias("xb"), F.col("z").alias("zb")).where(F.col("xa").isNotNull())
    dx, dz = F.col("xb") - F.col("xa"), F.col("zb") - F.col("za")
    return rows.withColumn("xh", 0.5 * (F.col("xa") + F.col("xb"))).withColumn("zh", 0.5 * (F.col("za") + F.col("zb"))).withColumn("length", F.sqrt(dx * dx + dz * dz))


def ray_travel_time(points: DataFrame, ray: list[str], grid: Grid, cells: DataFrame, vmin: float) -> DataFrame:
    """``ray, tt``: sum of lengths times the mean slowness from both ends and the midpoint."""
    at = velocity_at(points, grid, cells, "x", "z", vmin).withColumnRenamed("v", "vb")
    w = _along(ray)
    rows = at.withColumn("va", F.lag("vb").over(w)).withColumn("xa", F.lag("x").over(w)).withColumn("za", F.lag("z").over(w)).where(F.col("xa").isNotNull())
    rows = rows.withColumn("xh", 0.5 * (F.col("xa") + F.col("x"))).withColumn("zh", 0.5 * (F.col("za") + F.col("z")))
    rows = velocity_at(rows, grid, cells, "xh", "zh", vmin).withColumnRenamed("v", "vh")
    floor = lambda c: F.greatest(F.col(c), F.lit(vmin))
    dx, dz = F.col("x") - F.col("xa"), F.col("z") - F.col("za")
    part = F.sqrt(dx * dx + dz * dz) * 4.0 / (floor("va") + 2 * floor("vh") + floor("vb"))
    return rows.groupBy(*ray).agg(F.sum(part).alias("tt"))


def smooth_rays(points: DataFrame, ray: list[str], sweeps: int = 3, acc: float = 0.8) -> DataFrame:
    """Inner points move ``acc`` of the way to the middle of their neighbours, ``sweeps`` times."""
    w = _along(ray)
    fixed = F.col("fixed") if "fixed" in points.columns else F.lit(False)
    for _ in range(sweeps):
        inner = F.lag("x").over(w).isNotNull() & F.lead("x").over(w).isNotNull() & ~fixed
        moved = lambda c: F.when(inner, (1 - acc) * F.col(c) + acc * 0.5 * (F.lag(c).over(w) + F.lead(c).over(w))).otherwise(F.col(c))
        points = points.withColumns({"x": moved("x"), "z": moved("z")})
    return points


def _renumbered(points: DataFrame, ray: list[str]) -> DataFrame:
    return points.withColumn("k", F.row_number().over(_along(ray)))


def remove_kinks(points: DataFrame, ray: list[str], degrees: float = 150.0) -> DataFrame:
    """Drops inner points where the ray bends more sharply than ``degrees``; 180 is straight."""
    import math

    w = _along(ray)
    fixed = F.col("fixed") if "fixed" in points.columns else F.lit(False)
    ax, az = F.lag("x").over(w) - F.col("x"), F.lag("z").over(w) - F.col("z")
    cx, cz = F.lead("x").over(w) - F.col("x"), F.lead("z").over(w) - F.col("z")
    cosine = F.try_divide(ax * cx + az * cz, F.sqrt(ax * ax + az * az) * F.sqrt(cx * cx + cz * cz))
    end = F.lag("x").over(w).isNull() | F.lead("x").over(w).isNull()
    keep = end | fixed | F.coalesce(cosine < math.cos(math.radians(degrees)), F.lit(False))
    return _renumbered(points.withColumn("__keep", keep).where("__keep").drop("__keep"), ray)


def densify_rays(points: DataFrame, ray: list[str], drs: float) -> DataFrame:
    """Adds evenly spaced points so that segments are about ``drs`` long."""
    w = _along(ray)
    px, pz = F.lag("x").over(w), F.lag("z").over(w)
    rows = points.withColumn("__px", px).withColumn("__pz", pz)
    hx, hz = F.col("x") - F.col("__px"), F.col("z") - F.col("__pz")
    # half away from zero; the last of the n parts ends in the point itself
    n = F.greatest(F.coalesce(F.round(F.sqrt(hx * hx + hz * hz) / drs), F.lit(1)), F.lit(1)).cast("int")
    rows = rows.withColumn("__n", n).withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    part = F.col("__i") / F.col("__n")
    between = F.col("__i") < F.col("__n")
    at = {c: F.when(between, F.col(f"__p{c}") + part * (F.col(c) - F.col(f"__p{c}"))).otherwise(F.col(c)) for c in ("x", "z")}
    if "fixed" in points.columns:
        at["fixed"] = F.col("fixed") & ~between
    order = W.partitionBy(*ray).orderBy("k", "__i")
    return rows.withColumns(at).withColumn("k", F.row_number().over(order)).select(*points.columns)


def thin_rays(points: DataFrame, ray: list[str], dmin: float) -> DataFrame:
    """Keeps a point when the way since the last kept one exceeds ``dmin``; ends and fixed points stay
    and start the way anew.  Rays are sorted within partitions and run through once: a ray's state
    is its way so far, so a long ray takes no more memory than a short one."""
    fixed = F.col("fixed") if "fixed" in points.columns else F.lit(False)
    w = _along(ray)
    hx, hz = F.col("x") - F.lag("x").over(w), F.col("z") - F.lag("z").over(w)
    stays = fixed | F.lag("x").over(w).isNull() | F.lead("x").over(w).isNull()
    rows = points.withColumn("__d", F.coalesce(F.sqrt(hx * hx + hz * hz), F.lit(0.0))).withColumn("__s", stays)
    names = points.columns
    rows = rows.withColumn("__r", F.xxhash64(*ray)).repartition(*ray).sortWithinPartitions("__r", *ray, "k")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        way = 0.0  # since the last kept point, which may be in an earlier batch
        for part in batches:
            total, stops = np.cumsum(part["__d"].to_numpy()), np.flatnonzero(part["__s"].to_numpy())
            keep, start, i = np.zeros(len(part), bool), -way, 0
            while i < len(part):  # from one kept point to the next; a ray's first one stays, which starts the way anew
                far = max(i, int(np.searchsorted(total, start + dmin, "right")))
                stop = int(np.searchsorted(stops, i))
                i = min(far, int(stops[stop]) if stop < len(stops) else len(part))
                if i < len(part):
                    keep[i], start = True, total[i]
                i += 1
            way = float(total[-1] - start) if len(part) else way
            yield part.loc[keep, names]

    kept = rows.mapInPandas(run, points.schema)
    return _renumbered(kept, ray).select(*names)
