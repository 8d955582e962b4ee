"""Commands end to end on a tiny catalogue."""

import random

import pytest
from pyspark.sql import functions as F

from biomeframe import cli
from biomeframe.functions.alignment import mapping_totals
from biomeframe.operators import consensus, counting
from biomeframe.sources.writers import updated_census


def call(spark, *argv):
    cli.run(spark, cli.parser().parse_args([str(a) for a in argv]))


def test_commands(spark, tmp_path):
    rng = random.Random(2)
    base = "".join(rng.choice("ACGT") for _ in range(60))
    other = base[:30] + {"A": "G", "G": "A", "C": "T", "T": "C"}[base[30]] + base[31:]
    (tmp_path / "sam").mkdir()
    for sample, seq in (("a", base), ("b", base), ("c", other)):
        lines = ["@SQ\tSN:1\tLN:60"]
        lines += [f"r{i}\t0\t1\t{i % 3 * 20 + 1}\t9\t20M\t*\t0\t0\t{seq[i % 3 * 20 : i % 3 * 20 + 20]}\t*\tNM:i:0" for i in range(12)]
        (tmp_path / "sam" / f"{sample}.sam").write_text("\n".join(lines) + "\n")
    (tmp_path / "genes.tsv").write_text("gene_id\tgene_name\tgene_length\n1\tg1\t60\n")
    (tmp_path / "msp.tsv").write_text("msp_name\tgene_id\tgene_name\tgene_category\nm\t1\tg1\tcore\n")
    (tmp_path / "kegg.tsv").write_text("gene_id\tgene_name\tannotation\n1\tg1\tK1\n")
    (tmp_path / "modules.tsv").write_text("id\ttype\tname\tdefinition\nM1\tKEGG\tx\tK1,K2 K3\n")
    (tmp_path / "ref.fa").write_text(f">1\n{base}\n")
    call(spark, "mapping", "-i", tmp_path / "sam/*.sam", "-o", tmp_path / "map", "-g", tmp_path / "genes.tsv")
    stats = spark.read.parquet(str(tmp_path / "map/stats")).collect()
    assert {(r["sample"], r["counted_reads"]) for r in stats} == {("a", 12), ("b", 12), ("c", 12)}
    call(spark, "profile", "-i", tmp_path / "map/counts", "-o", tmp_path / "prof", "-m", tmp_path / "msp.tsv", "-n", "raw", "-a", f"kegg={tmp_path}/kegg.tsv", "--modules", tmp_path / "modules.tsv")
    assert {r["value"] for r in spark.read.parquet(str(tmp_path / "prof/modules")).collect()} == {12.0}
    call(spark, "merge", "-i", tmp_path / "prof/msp", "-o", tmp_path / "merged", "-k", "msp_name")
    assert "msp_name\ta\tb\tc\nm\t12.0\t12.0\t12.0\n" in "".join(p.read_text() for p in (tmp_path / "merged").glob("part*"))
    call(spark, "strain", "-i", tmp_path / "sam/*.sam", "-o", tmp_path / "seqs", "--genes", tmp_path / "genes.tsv", "--reference", tmp_path / "ref.fa", "--msp", tmp_path / "msp.tsv", "--counts", tmp_path / "map/counts", "--core_size", 1)
    assert {r["sample"]: r["seq"] for r in spark.read.parquet(str(tmp_path / "seqs")).collect()} == {"a": base, "b": base, "c": other}
    call(spark, "tree", "-i", tmp_path / "seqs", "-o", tmp_path / "tree", "-r")
    assert "((a:0,b:0)" in "".join(r["value"] for r in spark.read.text(str(tmp_path / "tree/trees")).collect())


def test_validators():
    for argv in (["tree", "-i", "a", "-o", "b", "-g", "1.5"], ["merge", "-i", "a", "-o", "b", "-k", "x", "-n", "0"], ["profile", "-i", "a", "-o", "b", "-m", "c", "-a", "x"]):
        with pytest.raises(SystemExit):
            cli.parser().parse_args(argv)


def test_bases_and_cap(spark):
    rows = [("s", 1, 3, "1S2M1I1D1M", "TACGT", 0), ("s", 1, 0, "2M", "AC", 4)]
    df = spark.createDataFrame(rows, "sample string, gene_id long, pos int, cigar string, seq string, flag int")
    assert sorted((r["pos"], r["base"]) for r in consensus.aligned_bases(df).collect()) == [(3, "A"), (4, "C"), (6, "T")]
    aln = spark.createDataFrame([("s", "r", g, 10, nm) for g, nm in ((1, 2), (2, 0), (3, 0))], "sample string, read_id string, gene_id long, ali int, nm int")
    assert sorted(r["gene_id"] for r in counting.cap_alignments(aln, 2).collect()) == [2, 3]


def test_log_and_census(spark):
    log = "2000 reads; of these:\n  2000 (100%) were unpaired; of these:\n    497 (24%) aligned 0 times\n    1000 (50%) aligned once\n    503 (25%) aligned >1 times\n75% rate"
    assert spark.range(1).select(mapping_totals(F.lit(log))).collect()[0][0] == [2000, 497, 1000, 503]
    assert spark.range(1).select(mapping_totals(F.lit("5 reads"))).collect()[0][0] is None
    assert updated_census({"a": {"x": 1}}, "a", {"y": 2}) == {"a": {"x": 1, "y": 2}}
    with pytest.raises(ValueError):
        updated_census({"a": {"x": 1}}, "a", {"x": 2})
