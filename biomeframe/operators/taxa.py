"""Species abundance from core genes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def core_genes(msp: DataFrame, core_size: int = 100) -> DataFrame:
    """``msp_name, gene_id``: distinct genes among the first ``core_size`` core genes of each species, by ``ord``."""
    order = Window.partitionBy("msp_name").orderBy("ord")
    core = msp.where("gene_category = 'core'").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= core_size)
    return core.select("msp_name", "gene_id").distinct()


def default_msp_filter(database_type: str, value: float | None = None) -> float:
    if value is not None:
        return value
    return 0.1 if database_type == "complete" else 0.2


def msp_abundance(counts: DataFrame, core: DataFrame, msp_filter: float, genes: DataFrame | None = None, samples: DataFrame | None = None) -> DataFrame:
    """``sample, msp_name, value``: mean over core genes, or 0 where too few of them are detected.

    The detection ratio is over all core genes; the mean is over those present in the count table.  With ``genes``, the
    catalogue, the count table may leave out zeros; its core genes are then the ones in the catalogue.  Species without
    a count are 0 in each sample (of ``samples``, by default those of the count table).
    """
    sizes = core.groupBy("msp_name").agg(F.count(F.lit(1)).alias("_n"))
    if genes is not None:
        here = core.join(genes.select("gene_id"), "gene_id", "left_semi").groupBy("msp_name").agg(F.count(F.lit(1)).alias("_in"))
        sizes = sizes.join(here, "msp_name", "left")
    got = counts.select("sample", "gene_id", "value").join(core, "gene_id").groupBy("sample", "msp_name")
    got = got.agg(F.count_if(F.col("value") > 0).alias("_d"), F.sum("value").alias("_v"), F.count("value").alias("_c"))
    every = sizes.join(F.broadcast((counts if samples is None else samples).select("sample").distinct()))  # one row per sample
    out = every.join(got, ["sample", "msp_name"], "left")
    mean = F.col("_v") / F.nullif(F.col("_c") if genes is None else F.col("_in"), F.lit(0))
    enough = F.coalesce("_d", F.lit(0)) / F.col("_n") >= msp_filter
    return out.select("sample", "msp_name", F.when(enough, F.coalesce(mean, F.lit(0.0))).otherwise(0.0).alias("value"))


def msp_stats(counts: DataFrame, msp: DataFrame) -> DataFrame:
    """``sample, msp_signal``: the share of signal on genes of any species, rounded to two digits."""
    flag = msp.select("gene_id").distinct().withColumn("_in", F.lit(True))
    got = counts.join(flag, "gene_id", "left").groupBy("sample").agg(F.sum(F.when(F.col("_in"), F.col("value")).otherwise(0.0)).alias("a"), F.sum("value").alias("b"))
    return got.select("sample", F.bround(F.col("a") / F.nullif(F.col("b"), F.lit(0.0)), 2).alias("msp_signal"))


def positive_count(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("sample").agg(F.count_if(F.col("value") > 0).alias(name))
