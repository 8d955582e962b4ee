"""Shared Spark plumbing: lineage cuts in the shared folder, checked broadcasts, Arrow batches."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of a side that may be broadcast; beyond either the same join runs as a shuffle join.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20


def prepare(spark: SparkSession) -> None:
    """Use the cluster's checkpoint folder.

    Where none is set, a temporary folder serves in local mode only; on a cluster that is an error, since executors
    would write to disks of their own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not path and not (sc.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="biomeframe-"))
    # Documents can be long: bound Arrow batches by bytes too, so that a batch stays small.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def cut(df: DataFrame) -> DataFrame:
    """Write df once to the shared checkpoint folder and read it from there; survives lost executors."""
    prepare(df.sparkSession)
    return df.checkpoint()


def _bytes(value: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes as a row of a hash table."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType)):
            each = F.aggregate(value, F.lit(0).cast("long"), lambda a, x: a + _bytes(x, kind.elementType).cast("long"))
        else:
            fields = len(kind.elementType.fields) if isinstance(kind.elementType, T.StructType) else 0
            each = F.size(value) * (8 + (8 + 8 * fields if fields else 0))
        return F.coalesce(F.greatest(each, F.lit(0)), F.lit(0)) + 24
    if isinstance(kind, T.StructType):
        return sum((_bytes(value[f.name], f.dataType) for f in kind.fields), F.lit(16))
    return F.lit(8)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint if df (already cut, so that measuring is cheap) has few rows and few bytes; else df itself."""
    width = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16))
    n, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and total <= size else df
