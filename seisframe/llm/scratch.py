"""Intermediate tables in the folder all executors share.

Iterative operators cut their lineage with written tables: a lost executor then re-reads files
instead of recomputing every earlier round.  The folder is the one the cluster names in
``spark.checkpoint.dir``; only where that is unset (tests on one machine) is one made here.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: lets Spark drop the shuffle files of a finished write instead of keeping them for a reuse
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="seisframe-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


#: paths of the tables that each open block will delete, the innermost last
_open: ContextVar[tuple[list[str], ...]] = ContextVar("open blocks", default=())


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables saved inside are deleted when the block ends, but those with ``keep`` belong to the block around it,
    or stay if there is none: results are read after the operator has returned."""
    paths: list[str] = []
    token = _open.set((*_open.get(), paths))
    try:
        yield
    finally:
        _open.reset(token)
        for text in paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(text)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def saved(df: DataFrame, name: str, keep: bool = False, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder, in folders ``by`` a column if one is named, and return the table read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/seisframe-{uuid.uuid4().hex}/{name}"
    if len(_open.get()) > keep:
        _open.get()[-1 - keep].append(path)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
