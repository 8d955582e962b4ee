"""Consensus sequences: variants, allele choice, masks, species sequences, and a simple pileup caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from biomeframe.functions.alignment import SKIPPED_IN_DEPTH, match_blocks
from biomeframe.functions.sequence import all_gap, allele_codes

GENE = ["sample", "gene_id"]


def dedupe_variants(variants: DataFrame) -> DataFrame:
    """The first record (by ``ord``) of each position."""
    order = Window.partitionBy(*GENE, "start").orderBy("ord")
    return variants.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def reference_frequency(ro: Column, ao: Column) -> Column:
    total = F.aggregate(ao, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    return ro / F.nullif(ro + total, F.lit(0))


def choose_alleles(variants: DataFrame, min_frequency: float) -> DataFrame:
    """Adds ``alleles``: reference and alternatives if the reference is frequent enough, else alternatives only."""
    with_ref = F.concat(F.array("ref"), "alts")
    keep = F.coalesce(reference_frequency(F.col("ro"), F.col("ao")) >= min_frequency, F.lit(False))
    return variants.withColumn("alleles", F.when(keep, with_ref).otherwise(F.col("alts")))


def variant_bases(variants: DataFrame, min_frequency: float) -> DataFrame:
    """``sample, gene_id, pos, base``: the IUPAC code at each position that a variant touches; later starts win."""
    rows = choose_alleles(dedupe_variants(variants), min_frequency)
    rows = rows.select(*GENE, "start", F.posexplode(allele_codes(F.col("alleles"))).alias("i", "base")).where("base is not null")
    rows = rows.withColumn("pos", F.col("start") + F.col("i"))
    return rows.groupBy(*GENE, "pos").agg(F.max_by("base", "start").alias("base"))


def consensus(reference: DataFrame, variants: DataFrame, masks: DataFrame, ignored: DataFrame, min_frequency: float, gap: str = "N") -> DataFrame:
    """``sample, gene_id, seq`` for each sample and gene of ``reference`` (sample, gene_id, seq).

    Ignored genes are all gaps.  Others take the variants' codes, and low-coverage intervals (masks) turn to
    gaps, over variants too.  Edits are applied to the sequence as a whole: per gene the codes and intervals are small
    arrays, and the reference is not exploded into bases.
    """
    edits = variant_bases(variants, min_frequency).groupBy(*GENE).agg(F.map_from_entries(F.collect_list(F.struct("pos", "base"))).alias("_edits"))
    holes = masks.groupBy(*GENE).agg(F.array_sort(F.collect_list(F.struct("startpos", "endpos"))).alias("_holes"))
    drop = ignored.select(*GENE).distinct().withColumn("_drop", F.lit(True))
    rows = reference.join(edits, GENE, "left").join(holes, GENE, "left").join(drop, GENE, "left")
    n = F.length("seq")
    letters = F.transform(F.split("seq", ""), lambda c, i: F.coalesce(F.try_element_at("_edits", i.cast("int")), c))
    edited = F.when(F.col("_edits").isNull(), F.col("seq")).otherwise(F.array_join(letters, ""))
    masked = F.aggregate(
        F.coalesce("_holes", F.array().cast("array<struct<startpos:int,endpos:int>>")),
        edited,
        lambda s, h: F.overlay(s, F.repeat(F.lit(gap), (F.least(h["endpos"], n) - h["startpos"]).cast("int")), (h["startpos"] + 1).cast("int")),
    )
    return rows.select(*GENE, F.when(F.col("_drop"), F.repeat(F.lit(gap), n)).otherwise(masked).alias("seq"))


def species_sequences(genes: DataFrame, msp_genes: DataFrame, gap: str = "N") -> DataFrame:
    """``sample, msp_name, seq``: gene sequences joined in the species' gene order; all-gap ones are left out."""
    joined = genes.join(msp_genes.select("msp_name", "gene_id", "ord"), "gene_id")
    parts = joined.groupBy("sample", "msp_name").agg(F.array_sort(F.collect_list(F.struct("ord", "seq"))).alias("_p"))
    seq = F.array_join(F.transform("_p", lambda x: x["seq"]), "")
    return parts.select("sample", "msp_name", seq.alias("seq")).where(~all_gap(F.col("seq"), gap))


def mask_positions(positions: DataFrame, intervals: DataFrame) -> DataFrame:
    """Positions (``sample, gene_id, pos``) inside an interval: an equi-join on the gene with a range condition."""
    inside = (F.col("p.pos") >= F.col("i.startpos")) & (F.col("p.pos") < F.col("i.endpos"))
    on = (F.col("p.sample") == F.col("i.sample")) & (F.col("p.gene_id") == F.col("i.gene_id")) & inside
    return positions.alias("p").join(intervals.alias("i"), on, "left_semi")


def pileup_variants(bases: DataFrame, reference: DataFrame, min_depth: int = 3, min_frequency: float = 0.1, min_count: int = 1) -> DataFrame:
    """Variants from base counts (``sample, gene_id, pos, base``): alternatives with enough depth, share and reads.

    A plain threshold caller; it makes no claim to the calls of a probabilistic one.
    """
    counts = bases.groupBy(*GENE, "pos", "base").agg(F.count(F.lit(1)).alias("n"))
    at = counts.groupBy(*GENE, "pos").agg(F.sum("n").alias("depth"), F.collect_list(F.struct("base", "n")).alias("b")).where(F.col("depth") >= min_depth)
    at = at.join(reference.select(*GENE, "seq"), GENE).withColumn("ref", F.upper(F.expr("substring(seq, pos + 1, 1)")))
    alt = F.array_sort(F.filter("b", lambda x: (x["base"] != F.col("ref")) & (x["n"] >= min_count) & (x["n"] / F.col("depth") >= min_frequency)))
    ro = F.aggregate(F.filter("b", lambda x: x["base"] == F.col("ref")), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    out = at.withColumn("a", alt).where(F.size("a") > 0)
    return out.select(*GENE, F.col("pos").alias("start"), "ref", F.transform("a", lambda x: x["base"]).alias("alts"), ro.alias("ro"), F.transform("a", lambda x: x["n"]).alias("ao"))


def aligned_bases(aln: DataFrame) -> DataFrame:
    """``sample, gene_id, pos, base`` of alignments (pos 0-based, cigar, seq), for :func:`pileup_variants`.

    Insertions, clips and deletions give no base; reads that depth ignores are left out.
    """
    kept = aln.where(F.col("flag").bitwiseAND(SKIPPED_IN_DEPTH) == 0).where("seq is not null and seq != '*'")
    blocks = kept.select(*GENE, "seq", F.explode(match_blocks(F.col("pos"), F.col("cigar"))).alias("b"))
    letters = F.split(F.upper(F.substr("seq", F.col("b.read") + 1, F.col("b.end") - F.col("b.start"))), "")
    bases = blocks.select("sample", F.col("gene_id").cast("long").alias("gene_id"), F.col("b.start").alias("start"), F.posexplode(letters).alias("i", "base"))
    return bases.where("base != ''").select("sample", "gene_id", (F.col("start") + F.col("i")).alias("pos"), "base")
