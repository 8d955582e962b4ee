"""Expressions on alignment records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: SAM flag bits of reads that depth ignores: unmapped, secondary, failed, duplicate.
SKIPPED_IN_DEPTH = 0x704


def aligned_length(cigar: Column) -> Column:
    """Sum of the lengths of M, I and D operations of a CIGAR string; 0 if there are none."""
    return F.aggregate(F.regexp_extract_all(cigar, F.lit(r"(\d+)[MID]"), 1), F.lit(0), lambda a, x: a + x.cast("int"))


def reference_length(cigar: Column) -> Column:
    """Reference bases spanned: M, D, N, = and X operations."""
    return F.aggregate(F.regexp_extract_all(cigar, F.lit(r"(\d+)[MDN=X]"), 1), F.lit(0), lambda a, x: a + x.cast("int"))


def match_blocks(pos: Column, cigar: Column) -> Column:
    """``start, end, read`` of each run of M, = or X: its span on the reference and its first base in the read, all 0-based."""
    ops = F.zip_with(
        F.regexp_extract_all(cigar, F.lit(r"(\d+)[MIDNSHP=X]"), 1), F.regexp_extract_all(cigar, F.lit(r"\d+([MIDNSHP=X])"), 1),
        lambda n, op: F.struct(n.cast("int").alias("n"), op.alias("op")),
    )
    none = F.array().cast("array<struct<start:int,end:int,read:int>>")
    first = F.struct(pos.cast("int").alias("at"), F.lit(0).alias("read"), none.alias("blocks"))

    def step(acc: Column, x: Column) -> Column:
        block = F.struct(acc["at"].alias("start"), (acc["at"] + x["n"]).alias("end"), acc["read"].alias("read"))
        return F.struct(
            (acc["at"] + F.when(x["op"].isin(*"MDN=X"), x["n"]).otherwise(0)).alias("at"), (acc["read"] + F.when(x["op"].isin(*"MIS=X"), x["n"]).otherwise(0)).alias("read"),
            F.when(x["op"].isin(*"M=X"), F.concat(acc["blocks"], F.array(block))).otherwise(acc["blocks"]).alias("blocks"),
        )

    return F.aggregate(ops, first, step, lambda acc: acc["blocks"])


def identity(ali: Column, nm: Column) -> Column:
    """(ali - nm) / ali; null for an empty alignment."""
    return (ali - nm).cast("double") / F.nullif(ali, F.lit(0))


def identity_threshold(database_type: str, threshold: float | None = None) -> float:
    """The user's threshold, or 0.95 for a complete catalogue and 0.98 for any other."""
    if threshold is not None:
        return threshold
    return 0.95 if database_type == "complete" else 0.98


def nm_tag(tags: Column) -> Column:
    return F.regexp_extract(tags, r"NM:i:(\d+)", 1).try_cast("int")


def mapping_totals(log: Column) -> Column:
    """The four read counts with percentages in an aligner's summary; the first is the total.

    Null for any other number of them, as the log is then not that of a finished run.
    """
    numbers = F.transform(F.regexp_extract_all(log, F.lit(r"(\d+)\s+\("), 1), lambda x: x.cast("long"))
    return F.when(F.size(numbers) == 4, numbers)
