"""Command line: ``python -m biomeframe.cli COMMAND ...``.

Commands read and write the stores that Spark knows.  Alignments are SAM text or Parquet with the columns
sample, read_id, gene_id, pos, cigar, nm, flag; other tables are TSV or Parquet.
"""

from __future__ import annotations

import argparse

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biomeframe.functions.misc import today
from biomeframe.functions.modules import parse_modules
from biomeframe.operators import consensus, counting, merge, taxa
from biomeframe.plans import config, workflows
from biomeframe.sources import readers, writers


def share(text: str) -> float:
    value = float(text)
    if not 0 <= value <= 1:
        raise argparse.ArgumentTypeError(f"{text} does not lie between 0 and 1")
    return value


def positive(text: str) -> int:
    value = int(text)
    if value < 1:
        raise argparse.ArgumentTypeError(f"{text} is less than 1")
    return value


def pairs(text: str) -> tuple[str, str]:
    name, _, path = text.partition("=")
    if not path:
        raise argparse.ArgumentTypeError(f"{text} is not NAME=PATH")
    return name, path


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="biomeframe", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, text: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=text)
        c.add_argument("-i", "--input", required=True)
        c.add_argument("-o", "--output", required=True)
        return c

    c = command("fastq", "list read files with their sample names")
    c.add_argument("-p", "--paired", action="store_true")
    c.add_argument("-m", "--mask")
    c = command("mapping", "count genes from alignments")
    c.add_argument("-g", "--genes", required=True, help="gene_id, gene_name, gene_length")
    c.add_argument("--sample", help="name of the sample, for SAM input")
    c.add_argument("-c", "--counting", choices=config.COUNTING, default="smart_shared")
    c.add_argument("--id", type=share, dest="identity")
    c.add_argument("--type", default="complete", dest="database_type")
    c.add_argument("-k", "--alignments", type=int, default=100, help="alignments per read that take part; 0 for all")
    c.add_argument("--log", help="folder of aligner summaries, one per sample, for the totals of reads")
    c.add_argument("--core", help="species definition: write the alignments on its core genes too, in coordinate order")
    c = command("profile", "gene, species, function and module profiles from count tables")
    c.add_argument("-m", "--msp", required=True)
    c.add_argument("-a", "--annotation", type=pairs, action="append", default=[], metavar="NAME=PATH")
    c.add_argument("--modules")
    c.add_argument("-l", "--level", type=int, default=0)
    c.add_argument("--seed", type=int, default=1234)
    c.add_argument("-n", "--normalization", choices=config.NORMALIZATION, default="coverage")
    c.add_argument("-c", "--factor", type=float, default=100.0)
    c.add_argument("--core_size", type=positive, default=100)
    c.add_argument("--msp_filter", type=share)
    c.add_argument("--completeness", type=share, default=0.9)
    c.add_argument("--trim", type=positive, default=80)
    c.add_argument("--unmapped", help="sample, unmapped: reads that the aligner could not place")
    c.add_argument("--type", default="complete", dest="database_type")
    c = command("merge", "one matrix from a long table, or all those of a profile")
    c.add_argument("-k", "--keys", help="key columns, comma-separated; without them the input is a profile's folder")
    c.add_argument("-g", "--genes", action="store_true", help="of a profile, merge the gene table too")
    c.add_argument("-b", "--biom", metavar="TAXONOMY", help="also write the species' table as a BIOM document")
    c.add_argument("-a", "--min_abundance", type=float, default=0.0)
    c.add_argument("-n", "--min_occurrence", type=positive, default=1)
    c.add_argument("-s", "--remove_empty_samples", action="store_true")
    c = command("strain", "consensus sequences of covered species")
    for name in ("genes", "reference", "msp", "counts"):
        c.add_argument(f"--{name}", required=True)
    c.add_argument("--cache", help="folder for intermediate tables of a job that may be restarted")
    c.add_argument("--variants", help="a VCF folder with one file per sample; else a pileup is called")
    c.add_argument("-d", "--max_depth", type=positive, default=100)
    c.add_argument("-s", "--min_depth", type=positive, default=3)
    c.add_argument("-f", "--min_frequency", type=share, default=0.1)
    c.add_argument("-m", "--min_msp_coverage", type=float, default=80)
    c.add_argument("-c", "--min_gene_coverage", type=share, default=0.5)
    c.add_argument("--core_size", type=positive, default=100)
    c = command("tree", "distances and trees of species sequences")
    c.add_argument("-g", "--max_gap", type=share, default=1.0)
    c.add_argument("-s", "--min_info_sites", type=int, default=10)
    c.add_argument("-r", "--tn93", action="store_true")
    return p


def _alignments(spark: SparkSession, path: str, sample: str | None) -> DataFrame:
    if not path.endswith(".sam"):
        return spark.read.parquet(path)
    aln, _ = readers.read_sam(spark, path)
    return aln.withColumn("sample", F.lit(sample) if sample else F.regexp_extract(F.input_file_name(), r"([^/]+)\.sam$", 1))


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.parquet(path) if not path.endswith((".tsv", ".xz", ".gz", ".bz2", ".feather", ".txt")) else readers.read_tsv(spark, path, schema)


def _msp(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path) if not path.endswith((".tsv", ".xz", ".gz")) else readers.read_msp(spark, path)


def _maybe(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    out = args.output
    if args.command == "fastq":
        from biomeframe.functions.sequence import pair_tag, sample_name

        files = readers.find_reads(spark, args.input)
        named = files.withColumns({"sample": sample_name(F.col("name"), args.paired, args.mask), "tag": pair_tag(F.col("name")) if args.paired else F.lit("single")})
        named.where("sample is not null").write.mode("overwrite").parquet(out)
    elif args.command == "mapping":
        genes = _table(spark, args.genes, readers.GENES)
        aln = _alignments(spark, args.input, args.sample)
        conf = config.MappingConfig(counting=args.counting, identity=args.identity, alignments=args.alignments)
        totals = readers.aligner_totals(spark, args.log) if args.log else None
        counts, stats = workflows.count_samples(aln, genes, conf, args.database_type, totals)
        if args.core:
            core = taxa.core_genes(_msp(spark, args.core), conf.core_size)
            writers.write_alignments(counting.core_alignments(aln, core), f"{out}/core_alignments")
        writers.write_by_sample(counts, f"{out}/counts", ["gene_id"])
        stats.write.mode("overwrite").parquet(f"{out}/stats")
    elif args.command == "profile":
        conf = config.ProfileConfig(args.level, args.seed, args.normalization, args.factor, args.core_size, args.msp_filter, args.completeness, args.trim)
        annotations = {name: _table(spark, path, readers.ANNOTATION) for name, path in args.annotation}
        alternatives = None
        if args.modules:
            definitions = {r["id"]: r["definition"] for r in _table(spark, args.modules, readers.MODULES).collect()}
            rows = [(m, i, sorted(a)) for m, alts in parse_modules(definitions).items() for i, a in enumerate(alts)]
            alternatives = spark.createDataFrame(rows, "mod_id string, alt_id int, terms array<string>")
        unmapped = _table(spark, args.unmapped, "sample string, unmapped long") if args.unmapped else None
        got = workflows.profile_samples(spark.read.parquet(args.input), _msp(spark, args.msp), conf, annotations, alternatives, unmapped, args.database_type)
        tables = {"genes": got.genes, "msp": got.species, "msp_stats": got.species_stats, "modules_completeness": got.completeness, "modules": got.modules}
        tables |= {name: df for name, df in got.functions.items()} | {f"{name}_as_msp_sum": df for name, df in got.functions_by_species.items()}
        for name, df in tables.items():
            if df is not None:
                writers.write_by_sample(df, f"{out}/{name}")
    elif args.command == "merge":
        conf = config.MergeConfig(args.min_abundance, args.min_occurrence, args.remove_empty_samples, genes=args.genes, biom=bool(args.biom))
        if args.keys:
            species = spark.read.parquet(args.input)
            writers.write_matrix(workflows.merge_tables(species, args.keys.split(","), conf), out if not args.biom else f"{out}/matrix")
        else:
            tables = {name: table for name in workflows.FAMILIES if (table := _maybe(spark, f"{args.input}/{name}")) is not None}
            for name, df in workflows.merge_profile(tables, conf).items():
                writers.write_matrix(df, f"{out}/{name}")
            species = tables.get("msp")
        if args.biom and species is not None:
            date = spark.range(1).select(today()).first()[0]
            writers.write_biom(merge.biom_lines(species, _table(spark, args.biom, readers.TAXONOMY), date=date), f"{out}/biom")
    elif args.command == "strain":
        conf = config.StrainConfig(args.max_depth, args.min_depth, min_frequency=args.min_frequency, min_msp_coverage=args.min_msp_coverage, min_gene_coverage=args.min_gene_coverage, core_size=args.core_size)
        aln = _alignments(spark, args.input, None)
        reference = readers.read_fasta(spark, args.reference, int_ids=True).withColumnRenamed("id", "gene_id")
        if args.variants:
            variants = readers.read_vcf(spark, args.variants).withColumn("sample", F.regexp_extract(F.input_file_name(), r"([^/]+)\.vcf[^/]*$", 1))
        else:
            refs = aln.select("sample", "gene_id").distinct().join(reference, "gene_id")
            variants = consensus.pileup_variants(consensus.aligned_bases(aln), refs, conf.min_snp_depth, conf.min_frequency).withColumn("ord", F.lit(0))
        workflows.strain_sequences(aln, _table(spark, args.genes, readers.GENES), reference, _msp(spark, args.msp), spark.read.parquet(args.counts), variants, conf, args.cache).write.mode("overwrite").parquet(out)
    elif args.command == "tree":
        distances, comparison, trees = workflows.strain_trees(spark.read.parquet(args.input), config.TreeConfig(args.max_gap, args.min_info_sites, "TN93" if args.tn93 else "GTR"))
        distances.write.mode("overwrite").parquet(f"{out}/distances")
        writers.write_matrix(comparison, f"{out}/comparison")
        writers.write_trees(trees, f"{out}/trees")


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    run(SparkSession.builder.appName("biomeframe").getOrCreate(), args)


if __name__ == "__main__":
    main()
