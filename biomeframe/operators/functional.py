"""Functional abundance by genes and by species."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_annotations(*databases: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [d.select("gene_id", "annotation") for d in databases])


def abundance_by_gene(counts: DataFrame, annotation: DataFrame) -> DataFrame:
    """Sum of the values of an annotation's genes; a gene with several annotations counts in full in each."""
    joined = annotation.select("gene_id", "annotation").join(counts, "gene_id")
    return joined.groupBy("sample", "annotation").agg(F.sum("value").alias("value"))


def _detected(counts: DataFrame, msp: DataFrame, annotation: DataFrame) -> DataFrame:
    on = ["gene_id", "gene_name"] if "gene_name" in annotation.columns and "gene_name" in msp.columns else ["gene_id"]
    tagged = msp.select("msp_name", *on).join(annotation.select("annotation", *on), on).select("gene_id", "msp_name", "annotation").distinct()
    return counts.where("value > 0").select("sample", "gene_id", "value").join(tagged, "gene_id")


def abundance_by_species(counts: DataFrame, msp: DataFrame, annotation: DataFrame, species: DataFrame) -> DataFrame:
    """Sum of the abundances of the species with a detected gene of the annotation; all annotations appear."""
    pairs = _detected(counts, msp, annotation).select("sample", "msp_name", "annotation").distinct()
    sums = pairs.join(species, ["sample", "msp_name"]).groupBy("sample", "annotation").agg(F.sum("value").alias("_v"))
    every = annotation.select("annotation").distinct().join(F.broadcast(species.select("sample").distinct()))
    return every.join(sums, ["sample", "annotation"], "left").select("sample", "annotation", F.coalesce("_v", F.lit(0.0)).alias("value"))


def annotation_stats(counts: DataFrame, annotation: DataFrame, species: DataFrame | None = None, msp: DataFrame | None = None) -> DataFrame:
    """``sample, signal, genes``: share of signal on annotated genes (six digits) and how many of them are detected.

    With ``species`` and ``msp``, only genes of species present in the sample are annotated ones.
    """
    genes = annotation.select("gene_id").distinct()
    if species is not None and msp is not None:
        present = species.where("value > 0").select("sample", "msp_name").join(msp.select("msp_name", "gene_id"), "msp_name").select("sample", "gene_id").distinct()
        flag = present.join(genes, "gene_id", "left_semi").withColumn("_in", F.lit(True))
        joined = counts.join(flag, ["sample", "gene_id"], "left")
    else:
        joined = counts.join(genes.withColumn("_in", F.lit(True)), "gene_id", "left")
    inside = F.coalesce("_in", F.lit(False))
    got = joined.groupBy("sample").agg(F.sum(F.when(inside, F.col("value")).otherwise(0.0)).alias("a"), F.sum("value").alias("b"), F.count_if(inside & (F.col("value") > 0)).alias("genes"))
    return got.select("sample", F.bround(F.col("a") / F.nullif(F.col("b"), F.lit(0.0)), 6).alias("signal"), "genes")


def catalogue_info(counts: DataFrame, msp: DataFrame, annotation: DataFrame, species: DataFrame) -> DataFrame:
    """``sample, msp_name, annotation`` of detected genes of species that are present."""
    here = counts.where("value > 0").select("sample", "gene_id").join(msp.select("gene_id", "msp_name"), "gene_id")
    here = here.join(species.where("value > 0").select("sample", "msp_name"), ["sample", "msp_name"], "left_semi")
    return here.join(annotation.select("gene_id", "annotation"), "gene_id").select("sample", "msp_name", "annotation").distinct()


def module_completeness(info: DataFrame, alternatives: DataFrame) -> DataFrame:
    """``sample, msp_name, mod_id, value``: the best alternative's share of terms, for species with an annotated gene.

    ``alternatives``: mod_id, terms (array), one row per alternative; small, so it is broadcast.
    """
    terms = info.groupBy("sample", "msp_name").agg(F.collect_set("annotation").alias("_have"))
    share = F.size(F.array_intersect("terms", "_have")) / F.size("terms")
    return terms.join(F.broadcast(alternatives)).groupBy("sample", "msp_name", "mod_id").agg(F.max(share).alias("value"))


def module_abundance(completeness: DataFrame, species: DataFrame, modules: DataFrame, cutoff: float = 0.9) -> DataFrame:
    """Sum of the abundances of species with the module complete enough; every module appears in every sample."""
    sums = completeness.where(F.col("value") >= cutoff).select("sample", "msp_name", "mod_id").join(species, ["sample", "msp_name"])
    sums = sums.groupBy("sample", "mod_id").agg(F.sum("value").alias("_v"))
    every = modules.select("mod_id").distinct().join(F.broadcast(species.select("sample").distinct()))
    return every.join(sums, ["sample", "mod_id"], "left").select("sample", "mod_id", F.coalesce("_v", F.lit(0.0)).alias("value"))
