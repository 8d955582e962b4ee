"""The commands as plans: counting, profiling, merging, strains and trees for all samples at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biomeframe.functions.alignment import aligned_length, identity_threshold
from biomeframe.operators import consensus, counting, depth, functional, merge, normalize, phylo, taxa
from biomeframe.plans.config import MappingConfig, MergeConfig, ProfileConfig, StrainConfig, TreeConfig


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``, built and written first unless a whole one is there from an earlier run."""
    try:
        spark.read.format("binaryFile").load(f"{path}/_SUCCESS").select("path").head()
    except AnalysisException:
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def count_samples(
    alignments: DataFrame, genes: DataFrame, config: MappingConfig = MappingConfig(), database_type: str = "complete", totals: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Count tables and counting statistics of all samples; ``ali`` is derived from ``cigar`` where it is missing.

    Each read has at most ``config.alignments`` alignments (0: all); ``totals`` (sample, total_reads) come from the aligner.
    """
    if "ali" not in alignments.columns:
        alignments = alignments.withColumn("ali", aligned_length(F.col("cigar")))
    if config.alignments:
        alignments = counting.cap_alignments(alignments, config.alignments)
    threshold = identity_threshold(database_type, config.identity)
    hits = counting.best_hits(alignments, threshold)
    table = counting.gene_counts(alignments, genes, threshold, config.counting)
    return table, counting.mapping_rate(alignments, hits, config.counting, totals)


@dataclass
class Profile:
    genes: DataFrame
    species: DataFrame
    species_stats: DataFrame
    functions: dict[str, DataFrame]
    functions_by_species: dict[str, DataFrame]
    completeness: DataFrame | None = None
    modules: DataFrame | None = None


def profile_samples(
    counts: DataFrame, msp: DataFrame, config: ProfileConfig = ProfileConfig(), annotations: dict[str, DataFrame] | None = None,
    alternatives: DataFrame | None = None, unmapped: DataFrame | None = None, database_type: str = "complete", exact_rarefaction: bool = True,
) -> Profile:
    """Gene, species, function and module profiles of all samples.

    ``unmapped`` (sample, unmapped) are reads that the aligner could not place: rarefaction draws from them too, and
    fragments per kilobase count them.
    """
    annotations = annotations or {}
    level = config.rarefaction_level if config.rarefaction_level > 0 else None
    if level is not None:
        counts = normalize.rarefy_exact(counts, level, config.seed, 0 if unmapped is None else unmapped) if exact_rarefaction else normalize.rarefy_hash(counts, level, config.seed, unmapped)
    if config.normalization == "coverage":
        counts = normalize.normalize_coverage(counts, config.trim, config.coverage_factor)
    elif config.normalization == "fpkm":
        counts = normalize.normalize_fpkm(counts, unmapped, level)
    core = taxa.core_genes(msp, config.core_size)
    species = taxa.msp_abundance(counts, core, taxa.default_msp_filter(database_type, config.msp_filter))
    out = Profile(
        counts, species, taxa.msp_stats(counts, msp), {k: functional.abundance_by_gene(counts, a) for k, a in annotations.items()},
        {k: functional.abundance_by_species(counts, msp, a, species) for k, a in annotations.items()},
    )
    if alternatives is not None and annotations:
        info = functional.catalogue_info(counts, msp, functional.union_annotations(*annotations.values()), species)
        out.completeness = functional.module_completeness(info, alternatives)
        out.modules = functional.module_abundance(out.completeness, species, alternatives, config.completeness)
    return out


def merge_tables(long: DataFrame, keys: list[str], config: MergeConfig = MergeConfig(), samples: list[str] | None = None) -> DataFrame:
    """One matrix of a table family, filtered by rows and, on request, by samples."""
    kept = merge.filter_rows(long, keys, config.min_abundance, config.min_occurrence)
    if config.remove_empty_samples:
        kept = merge.drop_empty_samples(kept)
        samples = None
    return merge.merge_samples(kept, keys, samples)


#: Table families of a profile and their keys, as one merge takes them.
FAMILIES = {
    "genes": ["gene_id"], "msp": ["msp_name"], "modules": ["mod_id"], "modules_completeness": ["msp_name", "mod_id"],
    **{name: ["annotation"] for base in ("mustard", "kegg", "eggnog", "tigrfam", "dbcan", "resfinder", "resfinderfg") for name in (base, f"{base}_as_msp_sum")},
}


def merge_profile(tables: dict[str, DataFrame], config: MergeConfig = MergeConfig(), samples: list[str] | None = None) -> dict[str, DataFrame]:
    """Matrices of all known table families in ``tables``; genes only on request, since theirs is the largest."""
    return {name: merge_tables(df, FAMILIES[name], config, samples) for name, df in tables.items() if name in FAMILIES and (name != "genes" or config.genes)}


def strain_sequences(
    alignments: DataFrame, genes: DataFrame, reference: DataFrame, msp: DataFrame, counts: DataFrame, variants: DataFrame, config: StrainConfig = StrainConfig(),
    cache: str | None = None,
) -> DataFrame:
    """``sample, msp_name, seq``: consensus sequences of species whose core genes are covered well enough.

    ``reference``: gene_id, seq; ``variants``: an external caller's records or :func:`consensus.pileup_variants`.
    With ``cache``, a folder, the runs of depth are written there once, and a restarted job reads them.
    """
    core = taxa.core_genes(msp, config.core_size)
    on_core = counting.core_alignments(alignments, core)
    core_dim = genes.join(core.select("gene_id").distinct(), "gene_id", "left_semi")
    segments = depth.segments_of(on_core)
    build = lambda: depth.depth_runs(segments, core_dim, config.max_depth)
    runs = build() if cache is None else cached(alignments.sparkSession, f"{cache}/depth_runs", build)
    covered = depth.covered_genes(depth.gene_coverage(runs, segments, core_dim), config.min_gene_coverage)
    species = depth.covered_species(covered, core, config.core_size, config.min_msp_coverage)
    # Only the genes of species that stay, joined by their key: references are large and are never broadcast.
    wanted = species.select("sample", "msp_name").join(core, "msp_name").select("sample", "gene_id").distinct()
    refs = wanted.join(reference.select("gene_id", "seq"), "gene_id").select("sample", "gene_id", "seq")
    ignored = depth.split_by_depth(counts, config.min_depth).where("ignored").select("sample", "gene_id")
    seqs = consensus.consensus(refs, variants, depth.low_coverage_intervals(runs, config.min_depth), ignored, config.min_frequency, config.gap)
    order = msp.join(core, ["msp_name", "gene_id"], "left_semi").groupBy("msp_name", "gene_id").agg(F.min("ord").alias("ord"))
    return consensus.species_sequences(seqs, order, config.gap).join(species.select("sample", "msp_name"), ["sample", "msp_name"], "left_semi")


def strain_trees(sequences: DataFrame, config: TreeConfig = TreeConfig()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distances, pair comparisons and trees of species seen in several samples."""
    many = sequences.groupBy("msp_name").agg(F.countDistinct("sample").alias("_n")).where("_n > 1").select("msp_name")
    clean = phylo.clean_sites(sequences.join(many, "msp_name", "left_semi"), config.max_gap, config.min_info_sites, config.gap)
    distances = phylo.tn93_distances(clean) if config.model == "TN93" else phylo.gtr_distances(clean)
    return distances, phylo.pairwise_comparison(clean, distances), phylo.trees(distances)
