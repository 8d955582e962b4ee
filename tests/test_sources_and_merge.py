"""Readers, writers, streaming and merging."""

import functools
import gzip
import itertools
import lzma
import operator

import pyarrow as pa
import pyarrow.feather
import pytest

from biomeframe.operators import merge
from biomeframe.plans.config import MergeConfig
from biomeframe.plans.workflows import count_samples, merge_tables
from biomeframe.sources import readers, writers
from biomeframe.sources.fasta_source import FastaDataSource
from biomeframe.streaming.incremental import count_arrivals


def test_tables(spark, tmp_path):
    text = "gene_id\tgene_length\tvalue\n1\t1000\t0.5\n2\t20\t3\n"
    (tmp_path / "a.tsv").write_text(text)
    (tmp_path / "a.tsv.xz").write_bytes(lzma.compress(("﻿" + text).encode()))
    pyarrow.feather.write_feather(pa.table({"gene_id": [1, 2], "gene_length": pa.array([1000, 20], pa.int32()), "value": [0.5, 3.0]}), str(tmp_path / "a.feather"))
    want = [(1, 1000, 0.5), (2, 20, 3.0)]
    for name in ("a.tsv", "a.tsv.xz", "a.feather"):
        assert sorted(map(tuple, readers.read_tsv(spark, str(tmp_path / name), readers.COUNTS).collect())) == want
    with pytest.raises(ValueError):
        readers.read_tsv(spark, "x.docx", readers.COUNTS)


def test_fasta(spark, tmp_path):
    text = ">1 first\nACG\nTA\n>2\n>3 x\nGG\n"
    (tmp_path / "a.fa").write_text(text)
    (tmp_path / "a.fa.gz").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "a.fa.xz").write_bytes(lzma.compress(text.encode()))
    for name in ("a.fa", "a.fa.gz", "a.fa.xz"):
        assert sorted(map(tuple, readers.read_fasta(spark, str(tmp_path / name), int_ids=True).collect())) == [(1, "ACGTA"), (3, "GG")]
    spark.dataSource.register(FastaDataSource)
    assert sorted(map(tuple, spark.read.format("fasta").load(str(tmp_path / "a.fa*")).distinct().collect())) == [("1", "ACGTA"), ("3", "GG")]
    writers.write_fasta(readers.read_fasta(spark, str(tmp_path / "a.fa")), str(tmp_path / "out"))
    assert sorted(map(tuple, readers.read_fasta(spark, str(tmp_path / "out")).collect())) == [("1", "ACGTA"), ("3", "GG")]


def test_renumber(spark):
    rows = spark.createDataFrame([("a", "AC", 5), ("b", "", 6), ("c", "G", 100_007)], "id string, seq string, ord long")
    assert sorted(map(tuple, writers.renumber_genes(rows).collect())) == [(1, "a", 2, "AC"), (2, "c", 1, "G")]


def test_sam_and_vcf(spark, tmp_path):
    sam = "@HD\tVN:1\n@SQ\tSN:7\tLN:100\nr1\t0\t7\t11\t9\t4M1I5M\t*\t0\t0\tACGTACGTAC\t*\tAS:i:0\tNM:i:2\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tA\t*\n"
    (tmp_path / "a.sam").write_text(sam)
    aln, genes = readers.read_sam(spark, str(tmp_path / "a.sam"))
    assert [tuple(r) for r in aln.collect()] == [("r1", 0, 7, 10, "4M1I5M", "ACGTACGTAC", 2)]
    assert [tuple(r) for r in genes.collect()] == [(7, 100)]
    (tmp_path / "a.vcf").write_text("##x\n#CHROM\tPOS\n7\t3\t.\tA\tC,G\t1\t.\tRO=2;AO=3,4\tGT\t1\n")
    row = readers.read_vcf(spark, str(tmp_path / "a.vcf")).collect()[0]
    assert (row["gene_id"], row["start"], row["ref"], row["alts"], row["ro"], row["ao"]) == (7, 2, "A", ["C", "G"], 2, [3, 4])


def test_census(spark, tmp_path):
    writers.write_census(spark, {"sample_info": {"sample_name": "s1", "files": ["a", "b"]}}, str(tmp_path / "s1"))
    part = next((tmp_path / "s1").glob("part*"))
    part.rename(tmp_path / "s1_census_stage_0.json")
    census = readers.single_file(readers.read_census(spark, str(tmp_path)))
    row = census.collect()[0]
    assert row["section"] == "sample_info" and row["fields"] == {"sample_name": "s1", "files": '["a","b"]'}
    with pytest.raises(ValueError):
        readers.single_file(census.limit(0))
    assert readers.check_catalogue("c_taxo", "taxo", "2020", {"c": "2021"}) and readers.check_catalogue("d", "complete", "1", {}) is None


def test_files(spark, tmp_path):
    for name in ("a_1.fastq", "b.fq.gz", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert sorted(r["name"] for r in readers.find_reads(spark, str(tmp_path)).collect()) == ["a_1.fastq", "b.fq.gz"]
    assert {r["md5"] for r in readers.file_digests(spark, str(tmp_path), "*.txt").collect()} == {"9dd4e461268c8034f5c8564e155c67a6"}


def test_bed_and_matrix(spark, tmp_path):
    writers.write_bed(spark.createDataFrame([(1, 10), (2, 20)], "gene_id long, gene_length int"), str(tmp_path / "b"))
    assert sorted(r["gene_id"] for r in readers.read_bed_genes(spark, str(tmp_path / "b")).collect()) == [1, 2]
    writers.write_matrix(spark.createDataFrame([("a", None), ("b", 1.0)], "k string, s double").coalesce(1), str(tmp_path / "m"))
    assert next((tmp_path / "m").glob("part*")).read_text() == "k\ts\na\t\nb\t1.0\n"


LONG = "sample string, gene_id long, value double"


def test_merge(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("b", 1, 0.0), ("a", 2, 0.5), ("b", 2, 0.5), ("c", 3, 0.0)], LONG)
    wide = {r["gene_id"]: tuple(r)[1:] for r in merge_tables(df, ["gene_id"], MergeConfig(min_occurrence=0)).collect()}
    assert wide == {1: (2.0, 0.0, None), 2: (0.5, 0.5, None), 3: (None, None, 0.0)}
    kept = merge_tables(df, ["gene_id"], MergeConfig(min_abundance=1, min_occurrence=2, remove_empty_samples=True))
    assert [tuple(r) for r in kept.collect()] == [(2, 0.5, 0.5)]
    back = merge.unpivot_samples(merge.merge_samples(df, ["gene_id"]), ["gene_id"]).select("sample", "gene_id", "value")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_merge_threshold(spark):
    # Reads 1, 1, 2, 6.6, 7, 2 of a gene of 111 bases: 50 in all, but 49.99999999999999 in some orders of addition.
    values = [100.0 * reads * 4 * 80 / (112 * 112) for reads in (1.0, 1.0, 2.0, 6.6, 7.0, 2.0)]
    orders = list(itertools.permutations(values))
    assert min(functools.reduce(operator.add, order) for order in orders) < 50
    rows = [(f"s{i}", gene, x) for gene, order in enumerate([*orders, [50 - 1e-9, 0.0]]) for i, x in enumerate(order)]
    df = spark.createDataFrame(rows, LONG).coalesce(1)
    kept = merge.filter_rows(df, ["gene_id"], 50, 1).select("gene_id").distinct().collect()
    assert sorted(r["gene_id"] for r in kept) == list(range(len(orders)))
    whole = spark.createDataFrame([("a", 1, 10**14), ("a", 2, 10**14 - 1)], "sample string, gene_id long, value long")
    assert [r["gene_id"] for r in merge.filter_rows(whole, ["gene_id"], 10**14).collect()] == [1]


def test_merge_empty(spark):
    assert merge_tables(spark.createDataFrame([], LONG), ["gene_id"]).collect() == []


def test_reports(spark):
    census = spark.createDataFrame([("p1", {"a": "1"}), ("p2", {"a": "2"}), ("p3", {"a": "1"})], "path string, config map<string,string>")
    assert merge.parameter_mismatches(census).collect()[0]["mismatches"] == 1
    assert [tuple(r) for r in merge.missing_fields(census, "config", ["a", "b"]).orderBy("path").collect()] == [(p, ["b"]) for p in ("p1", "p2", "p3")]
    assert merge.missing_fields(census, "config", [""]).collect() == []
    rows = spark.createDataFrame([("s", 0, {"x": "1", "y": "2"}), ("s", 1, {"x": "3"})], "sample string, position int, fields map<string,string>")
    assert merge.report(rows).collect()[0].asDict() == {"sample": "s", "x": "3", "y": "2"}


def test_streaming_counts(spark, tmp_path):
    rows = spark.createDataFrame([("s", "r1", 1, "10M", 0), ("s", "r2", 1, "10M", 0)], "sample string, read_id string, gene_id long, cigar string, nm int")
    rows.withColumn("ali", rows["nm"] + 10).write.parquet(str(tmp_path / "in"))
    genes = spark.createDataFrame([(1, 100)], "gene_id long, gene_length int")
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    count_arrivals(stream, genes, 0.95, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [r["value"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [2.0]
    table, stats = count_samples(rows, genes)
    assert table.collect()[0]["value"] == 2.0 and stats.collect()[0]["final_mapping_rate"] == 100.0
