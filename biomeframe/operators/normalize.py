"""Normalisation of gene counts and rarefaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PSEUDO_GENE, PSEUDO_LENGTH = -1, 1000


def coverage_value(value: Column, length: Column, trim: int, factor: float = 100.0) -> Column:
    """Coverage of a gene by reads of ``trim`` bases, by the gene's length (long, short even, short odd)."""
    length = length.cast("double")
    four = factor * value * 4 * trim
    return F.when(length >= 2 * trim, factor * value / (length - trim + 1)).when(length % 2 == 0, four / (length * (length + 2))).otherwise(four / ((length + 1) * (length + 1)))


def normalize_coverage(counts: DataFrame, trim: int = 80, factor: float = 100.0) -> DataFrame:
    return counts.withColumn("value", coverage_value(F.col("value"), F.col("gene_length"), trim, factor))


def normalize_fpkm(counts: DataFrame, unmapped: DataFrame | None = None, level: int | None = None) -> DataFrame:
    """Share of length-scaled counts; unmapped reads (``sample, unmapped``) count as a gene of 1000 bases.

    After rarefaction to ``level``, the unmapped reads are what is left of the level, at most the unmapped reads.
    """
    scaled = counts.withColumn("_x", F.col("value") / F.col("gene_length"))
    sums = scaled.groupBy("sample").agg(F.sum("_x").alias("_s"), F.sum("value").alias("_n"))  # one row per sample
    if unmapped is not None:
        left = F.coalesce("unmapped", F.lit(0)).cast("double")
        left = F.least(F.lit(level) - F.col("_n"), left) if level is not None else left
        sums = sums.join(unmapped.select("sample", "unmapped"), "sample", "left").withColumn("_s", F.col("_s") + left / PSEUDO_LENGTH)
    out = scaled.join(F.broadcast(sums.select("sample", "_s")), "sample", "left")
    return out.withColumn("value", F.coalesce(F.col("_x") / F.nullif(F.col("_s"), F.lit(0.0)), F.lit(0.0))).select(*counts.columns)


def rarefy_exact(counts: DataFrame, level: int, seed: int = 1234, unmapped: int | DataFrame = 0) -> DataFrame:
    """``level`` reads per sample without replacement, by numpy's seeded generator in gene order.

    Counts are rounded half-even first; a sample with ``level`` reads or fewer stays as it is rounded.  Unmapped reads (a
    number, or ``sample, unmapped``) are drawn from too, as a last gene that is dropped again.
    One sample's reads are drawn in one task; :func:`rarefy_hash` has no such bound.
    """
    columns = counts.columns
    if isinstance(unmapped, DataFrame):
        per = unmapped.select("sample", F.col("unmapped").cast("long").alias("_u"))
        counts = counts.join(F.broadcast(per), "sample", "left").withColumn("_u", F.coalesce("_u", F.lit(0)))  # one row per sample
    else:
        counts = counts.withColumn("_u", F.lit(unmapped).cast("long"))

    def draw(pdf):
        import numpy as np

        pdf = pdf.sort_values("gene_id").reset_index(drop=True)
        n = np.round(pdf["value"].to_numpy()).astype(np.int64)
        all_n = np.append(n, pdf["_u"].iloc[0])
        if all_n.sum() > level:
            picked = np.random.default_rng(seed=seed).choice(np.repeat(np.arange(len(all_n)), all_n), level, replace=False)
            n = np.bincount(picked, minlength=len(all_n))[:-1]
        return pdf.assign(value=n.astype(float))[columns]

    schema = ", ".join(f"`{c}` {counts.schema[c].dataType.simpleString()}" for c in columns)
    return counts.groupBy("sample").applyInPandas(draw, schema)


def rarefy_hash(counts: DataFrame, level: int, seed: int = 1234, unmapped: DataFrame | None = None) -> DataFrame:
    """``level`` reads per sample without replacement, by the order of a seeded hash of (gene, copy).

    The level's reads are those of least hash, so the draw does not depend on partitioning.  A histogram of the
    hashes' first digits gives each sample's border; reads below it are only counted, and just those in the border's
    cell (one read in 65,536) are sorted, so no task sees a sample's reads.  Unmapped reads (``sample, unmapped``) are
    drawn from too, as gene -1.
    """
    rows = counts.select("sample", "gene_id", F.bround("value", 0).cast("long").alias("n"))
    if unmapped is not None:
        rows = rows.unionByName(unmapped.select("sample", F.lit(PSEUDO_GENE).cast(counts.schema["gene_id"].dataType).alias("gene_id"), F.col("unmapped").cast("long").alias("n")))
    reads = rows.where("n > 0").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    h = F.md5(F.concat_ws("|", F.col("gene_id").cast("string"), F.col("i").cast("string"), F.lit(str(seed))))
    reads = reads.select("sample", "gene_id", "i", h.alias("h")).withColumn("cell", F.substring("h", 1, 4))
    cells = reads.groupBy("sample", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("sample").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.withColumn("before", before).where(F.col("before") < level)
    border = cells.groupBy("sample").agg(F.max("cell").alias("last"), F.min(level - F.col("before")).alias("take"))  # one row per sample
    reads = reads.join(F.broadcast(border), "sample")
    order = Window.partitionBy("sample").orderBy("h", "gene_id", "i")
    at = reads.where("cell = last").withColumn("_r", F.row_number().over(order)).where("_r <= take")
    kept = reads.where("cell < last").select("sample", "gene_id").unionByName(at.select("sample", "gene_id"))
    kept = kept.groupBy("sample", "gene_id").agg(F.count(F.lit(1)).cast("double").alias("_v"))
    return counts.join(kept, ["sample", "gene_id"], "left").withColumn("value", F.coalesce("_v", F.lit(0.0))).select(*counts.columns)


def share_of_total(df: DataFrame, value: str = "value") -> DataFrame:
    """Adds ``share``: the value over its sample's sum; null where the sum is 0."""
    sums = df.groupBy("sample").agg(F.nullif(F.sum(value), F.lit(0.0)).alias("_s"))  # one row per sample
    return df.join(F.broadcast(sums), "sample", "left").withColumn("share", F.col(value) / F.col("_s")).drop("_s")
