"""Writers: tables by sample, matrices, FASTA, BED, metadata and trees."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from biomeframe.functions.sequence import wrap


def write_by_sample(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Parquet, one folder per sample; rows of a file are sorted if ``order`` is given."""
    if order:
        df = df.repartition("sample").sortWithinPartitions("sample", *order)
    df.write.mode("overwrite").partitionBy("sample").parquet(path)


def write_alignments(aln: DataFrame, path: str) -> None:
    """Alignments in coordinate order: files hold ranges of genes, sorted by gene and place, so that a gene's rows are found by the files' statistics."""
    aln.repartitionByRange("gene_id", "pos").sortWithinPartitions("gene_id", "pos").write.mode("overwrite").parquet(path)


def write_tsv(df: DataFrame, path: str, compression: str = "gzip") -> None:
    """Tab-separated with a header, one file per sample if there is such a column."""
    writer = df.repartition("sample") if "sample" in df.columns else df
    out = writer.write.mode("overwrite")
    out = out.partitionBy("sample") if "sample" in df.columns else out
    out.csv(path, sep="\t", header=True, compression=compression)


def write_biom(lines: DataFrame, path: str) -> None:
    """A BIOM document from :func:`merge.biom_lines`; its lines stream through one task."""
    lines.repartition(1).sortWithinPartitions("place", "line").select("text").write.mode("overwrite").text(path)


def write_chunks(genes: DataFrame, chunks: DataFrame, path: str) -> None:
    """BED lines of the species' genes, one folder per chunk (``msp_name, chunk``)."""
    bed = genes.join(chunks, "msp_name").select("chunk", F.concat_ws("\t", F.col("gene_id").cast("string"), F.lit("0"), F.col("gene_length").cast("string")).alias("value"))
    bed.distinct().write.mode("overwrite").partitionBy("chunk").text(path)


def write_matrix(df: DataFrame, path: str) -> None:
    """Tab-separated with a header; nulls are written empty."""
    df.write.mode("overwrite").csv(path, sep="\t", header=True, nullValue="", emptyValue="")


def write_fasta(df: DataFrame, path: str, id_col: str = "id", seq_col: str = "seq", width: int = 0) -> None:
    seq = wrap(F.col(seq_col), width) if width else F.col(seq_col)
    df.select(F.concat(F.lit(">"), F.col(id_col).cast("string"), F.lit("\n"), seq).alias("value")).write.mode("overwrite").text(path)


def write_bed(genes: DataFrame, path: str) -> None:
    genes.select("gene_id", F.lit(0).alias("startpos"), F.col("gene_length").alias("endpos")).write.mode("overwrite").csv(path, sep="\t")


def write_census(spark, sections: dict, path: str) -> None:
    """A metadata file (indented JSON) through Spark's writer, so that any store Spark knows will do."""
    spark.createDataFrame([(json.dumps(sections, indent=4),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_trees(trees: DataFrame, path: str) -> None:
    """Newick strings, one folder per species."""
    trees.select("msp_name", F.col("newick").alias("value")).write.mode("overwrite").partitionBy("msp_name").text(path)


def renumber_genes(records: DataFrame, order: str = "ord") -> DataFrame:
    """``gene_id, gene_name, gene_length, seq``: ids from 1 in file order, after empty records are dropped.

    A running number over the whole catalogue needs an order; it is taken per range of ``order`` and offset, so
    that no task sees more than a range.
    """
    kept = records.where(F.length("seq") > 0).withColumn("_b", F.floor(F.col(order) / 100_000))
    sizes = kept.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sizes.select("_b", before.alias("_o"))
    out = kept.join(F.broadcast(base), "_b").withColumn("gene_id", F.col("_o") + F.row_number().over(Window.partitionBy("_b").orderBy(order)))
    return out.select("gene_id", F.col("id").alias("gene_name"), F.length("seq").alias("gene_length"), "seq")


def shared_species(sequences: DataFrame) -> DataFrame:
    """Sequences of species seen in more than one sample."""
    many = sequences.groupBy("msp_name").agg(F.countDistinct("sample").alias("_n")).where("_n > 1").select("msp_name")
    return sequences.join(many, "msp_name", "left_semi")


def tree_text(merges: DataFrame) -> DataFrame:
    """One indented line per merge of a species' tree, from the root down."""
    line = F.concat(F.repeat(F.lit("  "), F.col("_top") - F.col("step")), F.lit("+ "), F.format_number("height", 6), F.lit(" "), F.col("left"), F.lit(" | "), F.col("right"))
    top = Window.partitionBy("msp_name")
    rows = merges.withColumn("_top", F.max("step").over(top)).select("msp_name", F.struct((-F.col("step")).alias("o"), line.alias("l")).alias("x"))
    return rows.groupBy("msp_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["l"]), "\n").alias("tree"))


def updated_census(census: dict, section: str, fields: dict) -> dict:
    """The census with more fields in a section; a field that is there already is an error."""
    have = census.get(section, {})
    if again := sorted(set(have) & set(fields)):
        raise ValueError(f"fields are already in section {section!r}: {', '.join(again)}")
    return census | {section: have | fields}
