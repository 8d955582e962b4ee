"""Depth of coverage by a sweep line, run-lengths, and breadth of genes and species."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from biomeframe.functions.alignment import SKIPPED_IN_DEPTH, match_blocks

GENE = ["sample", "gene_id"]


def segments_of(aln: DataFrame) -> DataFrame:
    """``sample, gene_id, startpos, endpos, reads`` of the matched blocks of alignments that count for depth (pos is 0-based).

    Deletions and skips of the reference lie between blocks and have no depth; ``reads`` is 1 for a read's first block.
    """
    kept = aln.where((F.col("flag").bitwiseAND(SKIPPED_IN_DEPTH)) == 0)
    blocks = kept.select(*GENE, F.posexplode(match_blocks(F.col("pos"), F.col("cigar"))).alias("_i", "_b"))
    return blocks.select(*GENE, F.col("_b.start").alias("startpos"), F.col("_b.end").alias("endpos"), (F.col("_i") == 0).cast("int").alias("reads"))


def depth_runs(segments: DataFrame, genes: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``sample, gene_id, startpos, endpos, depth``: runs of equal depth that partition each gene, half-open.

    Segments add +1 at their start and -1 at their end (clipped to the gene); running sums between events are the
    depth, so the work grows with segments, not with bases.
    """
    clipped = segments.join(genes.select("gene_id", "gene_length"), "gene_id").select(
        *GENE, "gene_length", F.greatest("startpos", F.lit(0)).alias("s"), F.least("endpos", "gene_length").alias("e")
    ).where("s < e")
    ends = F.array(F.struct(F.col("s").alias("p"), F.lit(1).alias("d")), F.struct(F.col("e").alias("p"), F.lit(-1).alias("d")))
    borders = clipped.select(*GENE, F.explode(ends).alias("x")).select(*GENE, "x.p", "x.d")
    samples = segments.select("sample").distinct()
    frame = genes.select("gene_id", "gene_length").where("gene_length > 0").join(F.broadcast(samples))  # one row per sample
    frame = frame.select(*GENE, F.explode(F.array(F.lit(0), F.col("gene_length"))).alias("p"), F.lit(0).alias("d"))
    events = borders.unionByName(frame).groupBy(*GENE, "p").agg(F.sum("d").alias("d"))
    order = Window.partitionBy(*GENE).orderBy("p")
    depth = F.sum("d").over(order)
    depth = F.least(depth, F.lit(max_depth)) if max_depth is not None else depth
    runs = events.select(*GENE, F.col("p").alias("startpos"), F.lead("p").over(order).alias("endpos"), depth.cast("int").alias("depth")).where("endpos is not null")
    return merge_runs(runs)


def merge_runs(runs: DataFrame) -> DataFrame:
    """Neighbouring runs of equal depth become one (gaps and islands)."""
    order = Window.partitionBy(*GENE).orderBy("startpos")
    new = F.when(F.lag("depth").over(order) == F.col("depth"), 0).otherwise(1)
    marked = runs.withColumn("_n", new).withColumn("_i", F.sum("_n").over(order))
    return marked.groupBy(*GENE, "_i").agg(F.min("startpos").alias("startpos"), F.max("endpos").alias("endpos"), F.first("depth").alias("depth")).drop("_i")


def runs_of_positions(depth: DataFrame, genes: DataFrame) -> DataFrame:
    """Runs from depth per position (``sample, gene_id, pos, depth``); missing positions are 0."""
    rows = depth.where("depth != 0").select(*GENE, F.col("pos").alias("startpos"), (F.col("pos") + 1).alias("endpos"), "depth")
    edges = genes.select("gene_id", "gene_length").join(F.broadcast(depth.select("sample").distinct()))  # one row per sample
    points = rows.select(*GENE, "startpos", "depth").unionByName(rows.select(*GENE, F.col("endpos").alias("startpos"), F.lit(0).alias("depth")))
    points = points.unionByName(edges.select(*GENE, F.lit(0).alias("startpos"), F.lit(0).alias("depth")))
    points = points.groupBy(*GENE, "startpos").agg(F.max("depth").alias("depth")).join(genes.select("gene_id", "gene_length"), "gene_id")
    end = F.coalesce(F.lead("startpos").over(Window.partitionBy(*GENE).orderBy("startpos")), F.col("gene_length"))
    return merge_runs(points.withColumn("endpos", end).where("startpos < endpos").select(*GENE, "startpos", "endpos", "depth"))


def low_coverage_intervals(runs: DataFrame, min_depth: int) -> DataFrame:
    return runs.where(F.col("depth") < min_depth).select(*GENE, "startpos", "endpos", F.col("depth").alias("coverage"))


def depth_per_position(runs: DataFrame) -> DataFrame:
    """``sample, gene_id, pos, depth``, zeros included."""
    return runs.select(*GENE, F.explode(F.sequence("startpos", F.col("endpos") - 1)).alias("pos"), "depth")


def gene_coverage(runs: DataFrame, segments: DataFrame, genes: DataFrame) -> DataFrame:
    """``numreads, covbases, coverage, meandepth`` per gene with reads."""
    width = F.col("endpos") - F.col("startpos")
    bases = runs.groupBy(*GENE).agg(F.sum(F.when(F.col("depth") > 0, width).otherwise(0)).alias("covbases"), F.sum(width * F.col("depth")).alias("_sum"))
    one = F.sum("reads") if "reads" in segments.columns else F.count(F.lit(1))
    reads = segments.groupBy(*GENE).agg(one.cast("long").alias("numreads"))
    out = reads.join(bases, GENE).join(genes.select("gene_id", "gene_length"), "gene_id")
    return out.select(*GENE, "gene_length", "numreads", "covbases", (F.col("covbases") * 100.0 / F.col("gene_length")).alias("coverage"), (F.col("_sum") / F.col("gene_length")).alias("meandepth"))


def covered_genes(coverage: DataFrame, min_gene_coverage: float) -> DataFrame:
    """Genes with at least that share (0 to 1) of their bases covered; 0 keeps all."""
    return coverage.where(F.col("coverage") >= round(min_gene_coverage * 100)) if min_gene_coverage else coverage


def covered_species(coverage: DataFrame, core: DataFrame, core_size: int, min_msp_coverage: float) -> DataFrame:
    """``sample, msp_name, n_genes`` of species with enough covered core genes, as a percentage of ``core_size``."""
    got = coverage.select(*GENE).join(core, "gene_id").groupBy("sample", "msp_name").agg(F.countDistinct("gene_id").alias("n_genes"))
    return got.where(F.col("n_genes") >= min_msp_coverage / 100 * core_size)


def split_by_depth(counts: DataFrame, min_depth: int) -> DataFrame:
    """Adds ``ignored``: whether the rounded (half-even) value is below ``min_depth``."""
    return counts.withColumn("ignored", F.bround("value", 0) < min_depth)


def species_chunks(msp: DataFrame, chunks: int) -> DataFrame:
    """``msp_name, chunk``: balanced contiguous chunks in order of first appearance; the first ones are larger."""
    first = msp.groupBy("msp_name").agg(F.min("ord").alias("_o"))
    return first.select("msp_name", F.ntile(chunks).over(Window.orderBy("_o", "msp_name")).alias("chunk"))
