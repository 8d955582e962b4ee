"""Readers of tables, sequences, alignments, variants and metadata, all through Spark's file sources.

Text formats are read as lines (or records split at ``>``), so large files are split over tasks; ``.xz`` files, which
Spark does not decode, are read whole, one file per task.
"""

from __future__ import annotations

import lzma
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from biomeframe.functions.alignment import mapping_totals

COUNTS = "gene_id long, gene_length int, value double"
MSP = "msp_name string, gene_id long, gene_name string, gene_category string"
ANNOTATION = "gene_id long, gene_name string, annotation string"
GENES = "gene_id long, gene_name string, gene_length int"
MODULES = "id string, type string, name string, definition string"
TAXONOMY = "msp_name string, superkingdom string, phylum string, `class` string, `order` string, family string, genus string, species string"


def _xz_lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, n, value``: lines of xz files with their number."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                lines = lzma.decompress(content).decode("utf-8-sig").splitlines()
                yield pd.DataFrame({"path": name, "n": range(len(lines)), "value": lines})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, n long, value string")


def read_tsv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """A tab-separated table with an explicit schema; plain, gz, bz2, zstd or xz by its suffix, Parquet and Feather too."""
    if path.endswith(".xz"):
        lines = _xz_lines(spark, path).where("n > 0" if header else "true")
        kind = T.StructType.fromDDL(schema)
        fields = F.from_csv("value", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind.fields), {"sep": "\t"})
        return lines.select(fields.alias("r")).select("r.*")
    if path.endswith((".feather", ".arrow")):
        return _read_feather(spark, path, schema)
    if path.endswith(".parquet"):
        return spark.read.schema(schema).parquet(path)
    if path.endswith((".tsv", ".tsv.gz", ".tsv.bz2", ".tsv.zst", ".txt", ".bed")):
        return spark.read.schema(schema).csv(path, sep="\t", header=header, enforceSchema=True)
    raise ValueError(f"unknown table format: {path}")


def _read_feather(spark: SparkSession, path: str, schema: str) -> DataFrame:
    kind = T.StructType.fromDDL(schema)

    def run(batches: Iterator) -> Iterator:
        import io

        import pyarrow.feather

        for pdf in batches:
            for content in pdf["content"]:
                yield pyarrow.feather.read_feather(io.BytesIO(content))[kind.names]

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, kind)


def read_msp(spark: SparkSession, path: str) -> DataFrame:
    """Species definition with ``ord``, which grows along the file (numbers may be left out)."""
    return read_tsv(spark, path, MSP).withColumn("ord", F.monotonically_increasing_id())


def read_fasta(spark: SparkSession, path: str, int_ids: bool = False) -> DataFrame:
    """``id, seq`` of FASTA files; headers are cut at the first blank, records without a sequence are skipped."""
    if path.endswith(".xz"):
        lines = _xz_lines(spark, path)
        at = Window.partitionBy("path").orderBy("n")
        lines = lines.withColumn("_r", F.sum(F.when(F.col("value").startswith(">"), 1).otherwise(0)).over(at)).where("_r > 0")
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "value"))), lambda x: x["value"]), "\n")
        records = lines.groupBy("path", "_r").agg(F.substring(text, 2, 2_000_000_000).alias("value"))
    else:
        # A record ends at a line that starts with ">"; elsewhere the character belongs to a header.
        records = spark.read.text(path, lineSep="\n>").select(F.regexp_replace("value", "^>", "").alias("value")).where("value != ''")
    header = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    seq = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")
    out = records.select(F.regexp_extract(header, r"^(\S*)", 1).alias("id"), seq.alias("seq")).where("seq != ''")
    return out.withColumn("id", F.col("id").cast("long")) if int_ids else out


def read_sam(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Alignments (read_id, flag, gene_id, pos, cigar, seq, nm) with 0-based pos, and genes from the ``@SQ`` lines."""
    lines = spark.read.text(path)
    f = F.split("value", "\t")
    head = lines.where(F.col("value").startswith("@SQ"))
    genes = head.select(F.regexp_extract("value", r"\tSN:([^\t]+)", 1).cast("long").alias("gene_id"), F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("int").alias("gene_length"))
    rows = lines.where(~F.col("value").startswith("@")).where(F.get(f, 2) != "*")
    aln = rows.select(
        f[0].alias("read_id"), f[1].cast("int").alias("flag"), f[2].cast("long").alias("gene_id"), (f[3].cast("int") - 1).alias("pos"),
        f[5].alias("cigar"), f[9].alias("seq"), F.regexp_extract("value", r"\tNM:i:(\d+)", 1).try_cast("int").alias("nm"),
    )
    return aln, genes


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """``gene_id, start (0-based), ref, alts, ro, ao, ord`` of VCF records."""
    cols = "chrom string, pos int, id string, ref string, alt string, qual string, filter string, info string, format string, s1 string"
    rows = spark.read.schema(cols).csv(path, sep="\t", comment="#")
    info = F.str_to_map("info", F.lit(";"), F.lit("="))
    ao = F.transform(F.split(F.try_element_at(info, F.lit("AO")), ","), lambda x: x.try_cast("int"))
    return rows.select(
        F.col("chrom").cast("long").alias("gene_id"), (F.col("pos") - 1).alias("start"), "ref", F.split("alt", ",").alias("alts"),
        F.try_element_at(info, F.lit("RO")).try_cast("int").alias("ro"), ao.alias("ao"), F.monotonically_increasing_id().alias("ord"),
    )


def read_bed_genes(spark: SparkSession, path: str) -> DataFrame:
    """Distinct gene ids of a BED file's first column."""
    return spark.read.schema("gene_id long, startpos int, endpos int").csv(path, sep="\t").select("gene_id").distinct()


def read_census(spark: SparkSession, path: str, pattern: str = "*_census_stage_*.json") -> DataFrame:
    """``path, section, fields`` of metadata files below path; scalars and lists become strings."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    files = reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    top = files.select("path", F.explode(F.from_json("value", "map<string,string>")).alias("section", "json"))
    fields = F.coalesce(F.from_json("json", "map<string,string>"), F.create_map(F.lit("value"), F.col("json")))
    return top.select("path", "section", fields.alias("fields"))


def single_file(census: DataFrame) -> DataFrame:
    """The census, if it comes from exactly one file; else an error."""
    n = census.select("path").distinct().count()
    if n != 1:
        raise ValueError(f"expected exactly one metadata file, found {n}")
    return census


def unique_census(census: DataFrame) -> DataFrame:
    """The census, if there is one, each folder has one file, and each sample name stands in one file; else an error."""
    names = F.when(F.col("section") == "sample_info", F.col("fields")["sample_name"])
    files = census.groupBy("path").agg(F.max(names).alias("sample")).withColumn("folder", F.regexp_extract("path", r"^(.*)/", 1))
    n, folders, samples, named = files.agg(F.count(F.lit(1)), F.countDistinct("folder"), F.countDistinct("sample"), F.count("sample")).first()
    if not n:
        raise ValueError("no metadata file found")
    if folders < n:
        raise ValueError("a folder has several metadata files")
    if samples < named:
        raise ValueError("several metadata files name one sample")
    return census


def aligner_totals(spark: SparkSession, path: str) -> DataFrame:
    """``sample, total_reads`` of aligners' summaries, one file per sample (named by it); files of unfinished runs are left out."""
    logs = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1).alias("sample"), mapping_totals(F.col("value")).alias("n"))
    return logs.where("n is not null").select("sample", F.get("n", 0).alias("total_reads"))


def sequence_files(spark: SparkSession, path: str, pattern: str = "*.fasta.xz") -> DataFrame:
    """``path, sample`` (the folder) of sequence files below path; consensus files of single genes are left out."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    return reader.load(path).select("path", F.element_at(F.split("path", "/"), -2).alias("sample")).where(~F.col("path").endswith("_consensus.fasta.xz"))


def one_file_per_sample(files: DataFrame) -> DataFrame:
    """The files, if no sample has several; else an error."""
    if (many := files_per_sample(files).select("sample").limit(5).collect()):
        raise ValueError("several files of one sample: " + ", ".join(r["sample"] for r in many))
    return files


def find_reads(spark: SparkSession, path: str) -> DataFrame:
    """Paths and names of read files below path."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{fq,fastq,fq.gz,fastq.gz,fq.bz2,fastq.bz2,fq.xz,fastq.xz}")
    return reader.load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def file_digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """MD5 of each file below path."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    return reader.load(path).select("path", F.md5("content").alias("md5"))


def files_per_sample(files: DataFrame) -> DataFrame:
    """Samples (the folder above each file) with more than one file."""
    return files.select(F.element_at(F.split("path", "/"), -2).alias("sample")).groupBy("sample").count().where("count > 1")


def check_catalogue(name: str, database_type: str, date: str, expected: dict[str, str]) -> str | None:
    """A warning if the catalogue's date is not the expected one; unknown names give none."""
    key = name if database_type == "complete" else name.removesuffix("_taxo")
    want = expected.get(key)
    return f"catalogue {name} is of {date}, expected {want}" if want is not None and want != date else None
