"""Best hits of reads and gene counts: unique, total, and fractionally shared.

Input ``sample, read_id, gene_id, ali, nm``; all steps up to the counts partition by (sample, read_id), so the
best-hit choice and the tie counts share one shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from biomeframe.functions.alignment import identity

READ = ["sample", "read_id"]


def filter_identity(aln: DataFrame, threshold: float) -> DataFrame:
    """Adds ``ident`` and keeps alignments with at least that identity; empty alignments go."""
    return aln.withColumn("ident", identity(F.col("ali"), F.col("nm"))).where(F.col("ident") >= threshold)


def best_hits(aln: DataFrame, threshold: float) -> DataFrame:
    """The best alignments of each read with all ties; ``k`` is their number (repeated hits of a gene count)."""
    read = Window.partitionBy(*READ)
    best = filter_identity(aln, threshold).withColumn("best", F.max("ident").over(read)).where(F.col("ident") == F.col("best")).drop("best")
    return best.withColumn("k", F.count(F.lit(1)).over(read))


def unique_counts(hits: DataFrame) -> DataFrame:
    """Reads with exactly one surviving alignment, per gene."""
    return hits.where("k = 1").groupBy("sample", "gene_id").agg(F.count(F.lit(1)).alias("n"))


def total_counts(hits: DataFrame) -> DataFrame:
    """Surviving alignments per gene, all ties counted."""
    return hits.groupBy("sample", "gene_id").agg(F.count(F.lit(1)).alias("n"))


def co_coefficients(hits: DataFrame) -> DataFrame:
    """``sample, read_id, gene_id, co``: how a read with several best hits is shared among genes.

    In proportion to the genes' unique counts; if all are 0, each distinct gene gets one k-th.
    """
    multi = hits.where("k > 1").groupBy("sample", "read_id", "gene_id").agg(F.max("k").alias("k"), F.count(F.lit(1)).alias("c"))
    weighed = multi.join(unique_counts(hits), ["sample", "gene_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    weighed = weighed.withColumn("s", F.sum(F.col("c") * F.col("n")).over(Window.partitionBy(*READ)))
    co = F.when(F.col("s") == 0, 1.0 / F.col("k")).otherwise(F.col("c") * F.col("n") / F.nullif(F.col("s"), F.lit(0)))
    return weighed.select("sample", "read_id", "gene_id", co.alias("co")).where("co > 0")


def shared_counts(hits: DataFrame) -> DataFrame:
    """Unique counts plus shares, as one aggregation over both kinds of reads."""
    unique = hits.where("k = 1").select("sample", "gene_id", F.lit(1.0).alias("v"))
    shares = co_coefficients(hits).select("sample", "gene_id", F.col("co").alias("v"))
    return unique.unionByName(shares).groupBy("sample", "gene_id").agg(F.sum("v").alias("value"))


def count_table(counts: DataFrame, genes: DataFrame, value: str, samples: DataFrame | None = None) -> DataFrame:
    """Dense ``sample, gene_id, gene_length, value`` over all genes of the catalogue; missing genes are 0.

    ``samples`` names those that appear, with or without counts (by default, those with counts).
    """
    samples = (counts if samples is None else samples).select("sample").distinct()
    dense = genes.select("gene_id", "gene_length").join(F.broadcast(samples))  # one row per sample
    return dense.join(counts, ["sample", "gene_id"], "left").select("sample", "gene_id", "gene_length", F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("value"))


def sparse_counts(aln: DataFrame, threshold: float, mode: str = "smart_shared") -> DataFrame:
    """``sample, gene_id, value`` of the genes with counts, in one of the modes total, smart_shared and unique."""
    modes = {"total": (total_counts, "n"), "unique": (unique_counts, "n"), "smart_shared": (shared_counts, "value")}
    if mode not in modes:
        raise ValueError(f"unknown counting mode {mode!r}")
    count, value = modes[mode]
    return count(best_hits(aln, threshold)).select("sample", "gene_id", F.col(value).cast("double").alias("value"))


def gene_counts(aln: DataFrame, genes: DataFrame, threshold: float, mode: str = "smart_shared") -> DataFrame:
    """Dense count table; every sample with an alignment appears, though none of its reads be counted."""
    return count_table(sparse_counts(aln, threshold, mode), genes, "value", aln)


def counted_reads(hits: DataFrame, mode: str = "smart_shared") -> DataFrame:
    """Reads per sample that were counted: with a surviving hit, or (unique) with exactly one."""
    rows = hits.where("k = 1") if mode == "unique" else hits
    return rows.groupBy("sample").agg(F.countDistinct("read_id").alias("counted_reads"))


def mapping_rate(aln: DataFrame, hits: DataFrame, mode: str = "smart_shared", totals: DataFrame | None = None) -> DataFrame:
    """Counted reads as a percentage of all reads, rounded half-even to two digits.

    ``totals`` (sample, total_reads) are the aligner's; alignments alone don't show reads that it could not place.
    """
    total = aln.groupBy("sample").agg(F.countDistinct("read_id").alias("total_reads")) if totals is None else totals.select("sample", "total_reads")
    rate = F.bround(F.coalesce("counted_reads", F.lit(0)) / F.col("total_reads") * 100, 2)
    return total.join(counted_reads(hits, mode), "sample", "left").select("sample", "total_reads", F.coalesce("counted_reads", F.lit(0)).alias("counted_reads"), rate.alias("final_mapping_rate"))


def core_alignments(aln: DataFrame, core: DataFrame) -> DataFrame:
    """Alignments on core genes, for strain analysis."""
    return aln.join(core.select("gene_id").distinct(), "gene_id", "left_semi")


def cap_alignments(aln: DataFrame, most: int) -> DataFrame:
    """At most ``most`` alignments of each read: those of highest identity, then least gene_id."""
    order = Window.partitionBy(*READ).orderBy(identity(F.col("ali"), F.col("nm")).desc_nulls_last(), "gene_id")
    return aln.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).drop("_r")
