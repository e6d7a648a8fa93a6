"""Sparse matrices as tiles, for products that are repeated.

A solver multiplies one matrix and its transpose with vectors over and over.  Entries are dealt once into
square tiles, written as a table that is bucketed by tile; a product sends the tiles the places of the vector that
they have entries for and adds up what they give, so only vectors are shuffled, for the matrix as for its transpose.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: rows and columns of a tile
SIDE = 4096
#: lets Spark drop the shuffle files of a finished write instead of keeping them for a reuse
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_tiles(entries: DataFrame, name: str, side: int = SIDE, buckets: int | None = None, path: str | None = None) -> DataFrame:
    """Writes the table ``name`` of ``entries(row, col, val)`` (row and col from 0 on; equal places add up) and returns it.

    A tile is a row of the table: ``rb, cb`` and the arrays ``i, j`` (places in the tile) and ``val``.
    """
    spark = entries.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tile = [F.floor(F.col(c) / side).alias(t) for c, t in (("row", "rb"), ("col", "cb"))]
    # entries are dealt out once, by tile; equal places, and then places of a tile, are put together where they are
    place = entries.select("row", "col", "val").repartition(buckets, *tile)
    place = place.groupBy(*tile, (F.col("row") % side).cast("int").alias("i"), (F.col("col") % side).cast("int").alias("j")).agg(F.sum("val").cast("double").alias("val"))
    tiles = place.groupBy("rb", "cb").agg(F.sort_array(F.collect_list(F.struct("i", "j", "val"))).alias("e")).select("rb", "cb", *[F.col(f"e.{c}").alias(c) for c in ("i", "j", "val")])
    # with no fewer buckets than shuffles have partitions Spark keeps the tiles where they are
    writer = tiles.write.mode("overwrite").bucketBy(buckets, "rb", "cb")
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        (writer if path is None else writer.option("path", path)).saveAsTable(name)
    finally:
        spark.conf.set(CLEANUP, before)
    return read_tiles(spark, name)


def read_tiles(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def _blocks(v: DataFrame, at: str, side: int) -> DataFrame:
    """``at, all``: the vector ``v(i, x)`` in blocks of ``side`` numbers; equal places add up."""
    pairs = v.select(F.floor(F.col("i") / side).alias(at), F.struct((F.col("i") % side).cast("int").alias("k"), F.col("x").cast("double").alias("x")).alias("e"))
    pairs = pairs.groupBy(at).agg(F.collect_list("e").alias("e")).select(at, F.col("e.k").alias("k"), F.col("e.x").alias("x"))
    rows = max(1, (1 << 20) // side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(lo, rows) for lo in range(0, batch.num_rows, rows)):
                n = part.num_rows
                at_place = np.repeat(np.arange(n), np.diff(part.column("k").offsets)) * side + _numbers(part, "k")
                every = np.bincount(at_place, _numbers(part, "x"), n * side)
                yield pa.RecordBatch.from_arrays([part.column(at), pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * side, every)], [at, "all"])

    return pairs.mapInArrow(run, f"{at} long, all array<double>")


def _numbers(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False)


def tile_product(tiles: DataFrame, v: DataFrame, transposed: bool = False, side: int = SIDE) -> DataFrame:
    """``i, x``: the product of the matrix (or its transpose) with the vector ``v(i, x)``, where it has entries.

    Places that ``v`` lacks are 0.
    """
    at, to, inner, outer = ("rb", "cb", "i", "j") if transposed else ("cb", "rb", "j", "i")
    # a tile gets the numbers it has entries for, in order, as whole blocks would be many times the entries of a sparse matrix
    used = tiles.select(at, to, F.array_sort(F.array_distinct(inner)).alias("used"))
    sent = used.join(_blocks(v, at, side), at).select("rb", "cb", F.transform("used", lambda k: F.get("all", k)).alias("x"))
    met = tiles.join(sent, ["rb", "cb"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = np.repeat(np.arange(batch.num_rows), np.diff(batch.column("val").offsets))
            # places by tile and number, as the numbers sent are
            _, place = np.unique(of * side + _numbers(batch, inner), return_inverse=True)
            parts = _numbers(batch, "val") * _numbers(batch, "x")[place]
            i, place = np.unique(batch.column(to).to_numpy()[of] * side + _numbers(batch, outer), return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(np.bincount(place, parts, len(i)))], ["i", "x"])

    return met.select("rb", "cb", "i", "j", "val", "x").mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x"))
