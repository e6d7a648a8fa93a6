"""Mixing sources to target weights by capped water-filling (DataFrame functions only).

Targets share a budget by weight.  A source never gives more than ``max_epochs`` times its size;
what it cannot take is shared again by weight among the others until none is above its cap.
With sources in the order of cap per weight the ones that stop at their cap come first, so one
running sum over the small table of sources finds the final level.  Whole repetitions are taken
of every document; of the remaining fraction, documents are taken in the order of a seeded hash
until the source's target is reached.  That order is cut in two steps: sizes are summed by hash
prefix, and only the one prefix in which the target falls is ordered document by document, so a
source with a third of all rows is never sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import saved

#: hexadecimal digits of the hash prefix: 16 ** 4 = 65,536 prefixes
PREFIX = 4


def cyclic_weights(sources: DataFrame, pattern: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """``source, weight``: the pattern repeated over distinct sources by code point, null last."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    picked = F.element_at(F.array(*map(F.lit, pattern)), ((F.row_number().over(order) - 1) % len(pattern) + 1).cast("int"))
    return sources.select("source").distinct().select("source", picked.cast("long").alias("weight"))


def water_fill(sources: DataFrame, share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """``source, source_size, weight`` -> the same and ``target`` (double).

    The window runs over one row per source, never over documents.  A source of weight 0 gets nothing.
    """
    every = W.partitionBy()
    per_weight = F.when(F.col("weight") > 0, F.col("cap") / F.col("weight"))
    first = W.orderBy(per_weight.asc_nulls_last(), F.col("source").asc_nulls_last())
    before = first.rowsBetween(W.unboundedPreceding, -1)
    filled = (
        sources.withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("budget", F.sum("source_size").over(every) * F.lit(share))
        .withColumn("weights_left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("budget_left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("capped", F.col("cap") * F.col("weights_left") <= F.col("weight") * F.col("budget_left"))
        # the first source below its cap sets the level for itself and all that follow
        .withColumn("open_weight", F.max(F.when(~F.col("capped"), F.col("weights_left"))).over(every))
        .withColumn("open_budget", F.max(F.when(~F.col("capped"), F.col("budget_left"))).over(every))
    )
    level = F.col("weight") * F.col("open_budget") / F.col("open_weight")
    return filled.select("source", "source_size", "weight", F.when(F.col("weight") <= 0, F.lit(0.0)).when(F.col("capped"), F.col("cap").cast("double")).otherwise(level).alias("target"))


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def mix(docs: DataFrame, size: Column, weights: DataFrame | None = None, share: float = 1.5, max_epochs: int = 2, seed: str = "mix", keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, source, size, source_size, target, epochs (whole and fractional repetitions taken),
    taken`` and the ``keep`` columns for every row of ``docs``.

    ``size`` is a column expression over ``docs``; null counts as 0.  A null source is a source of
    its own.  Weights that are missing count as 1.  Rows with equal ``doc_id`` have the same hash
    and are ordered by size and a hash of ``keep``, so reruns agree; a null id is hashed as the empty string.  An empty
    table, or one whose sizes are all 0, takes nothing.  Only ``doc_id``, ``source``, the columns
    of ``size`` and ``keep`` are read.  ``keep`` may not have names of the results.  A very long text is one
    row with a large size.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = saved(docs.select("doc_id", "source", F.coalesce(size, F.lit(0)).cast("long").alias("size"), digest.alias("__h"), F.xxhash64("source", *keep).alias("__t"), *keep), "sizes")
    spread = rows.groupBy("source", F.substring("__h", 1, PREFIX).alias("__p")).agg(F.sum("size").alias("__n"))
    spread = saved(spread, "prefixes")
    sources = spread.groupBy("source").agg(F.sum("__n").alias("source_size"))
    weighted = cyclic_weights(sources) if weights is None else weights
    weighted = weighted.select(F.col("source").alias("__w"), "weight")
    targets = sources.join(weighted, same(F.col("source"), F.col("__w")), "left").select("source", "source_size", F.coalesce("weight", F.lit(1)).cast("long").alias("weight"))
    targets = saved(water_fill(targets, share, max_epochs), "targets")

    # where each source's fraction ends: the first prefix at which the running size passes it
    fraction = F.col("target") - F.col("source_size") * F.col("whole")
    aims = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    aims = aims.select(F.col("source").alias("__s"), "source_size", "target", "whole", fraction.alias("__aim"))
    running = W.partitionBy("source").orderBy("__p").rowsBetween(W.unboundedPreceding, W.currentRow)
    ends = (
        spread.withColumn("__to", F.sum("__n").over(running))
        .join(aims, same(F.col("source"), F.col("__s")))
        .where(F.col("__to") > F.col("__aim"))
        .groupBy("source")
        .agg(F.min_by(F.struct("__p", (F.col("__to") - F.col("__n")).alias("from")), "__p").alias("__e"))
        .select(F.col("source").alias("__s2"), F.col("__e.__p").alias("__end"), F.col("__e.from").alias("__from"))
    )
    plan = saved(aims.join(ends, same(F.col("__s"), F.col("__s2")), "left").drop("__s2"), "plan")

    rows = rows.join(plan, same(F.col("source"), F.col("__s"))).drop("__s")
    prefix = F.substring("__h", 1, PREFIX)
    at_end = F.coalesce(prefix == F.col("__end"), F.lit(False))
    whole_prefix = F.col("__end").isNull() | (prefix < F.col("__end"))
    easy = rows.where(~at_end).withColumn("__more", F.when(whole_prefix & (F.col("__aim") > 0), 1).otherwise(0))
    inside = W.partitionBy("source").orderBy("__h", "size", "__t").rowsBetween(W.unboundedPreceding, W.currentRow)
    to = F.col("__from") + F.sum("size").over(inside)
    # a document goes in if more than half of it lies before the aim
    hard = rows.where(at_end).withColumn("__more", F.when(2 * to - F.col("size") < 2 * F.col("__aim"), 1).otherwise(0))
    taken = easy.unionByName(hard).withColumn("epochs", F.col("whole") + F.col("__more"))
    return taken.select("doc_id", "source", "size", "source_size", "target", F.col("epochs").cast("long").alias("epochs"), (F.col("epochs") * F.col("size")).cast("long").alias("taken"), *keep)
