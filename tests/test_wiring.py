"""Unmapped reads, totals, headers, census rules, fetched catalogues, merged profiles, restarts."""

import json
import lzma
import os
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from biomeframe.functions import misc
from biomeframe.operators import counting, merge, normalize, phylo, taxa
from biomeframe.plans.config import MergeConfig, ProfileConfig
from biomeframe.plans.workflows import cached, merge_profile, profile_samples
from biomeframe.sources import catalogue, readers, writers

COUNTS = "sample string, gene_id long, gene_length int, value double"


@pytest.fixture(scope="module")
def counts(spark):
    rows = [(s, g, 1000, float(n)) for s, ns in (("a", [5, 0, 40, 300]), ("b", [1, 2, 3, 4])) for g, n in enumerate(ns, 1)]
    return spark.createDataFrame(rows, COUNTS).cache()


def test_rarefaction_draws_unmapped_reads(spark, counts):
    unmapped = spark.createDataFrame([("a", 655)], "sample string, unmapped long")
    exact = {(r["sample"], r["gene_id"]): r["value"] for r in normalize.rarefy_exact(counts, 100, 7, unmapped).collect()}
    picked = np.random.default_rng(7).choice(np.repeat(np.arange(5), [5, 0, 40, 300, 655]), 100, replace=False)
    assert [exact["a", g] for g in range(1, 5)] == np.bincount(picked, minlength=5)[:4].tolist()
    assert [exact["b", g] for g in range(1, 5)] == [1, 2, 3, 4]  # ten reads stay as they are
    drawn = {(r["sample"], r["gene_id"]): r["value"] for r in normalize.rarefy_hash(counts, 100, 7, unmapped).collect()}
    total = sum(drawn["a", g] for g in range(1, 5))
    assert 10 < total < 70 and [drawn["b", g] for g in range(1, 5)] == [1, 2, 3, 4]
    assert sum(r["value"] for r in normalize.rarefy_hash(counts.where("sample = 'a'"), 100, 7).collect()) == 100


def test_profile_passes_unmapped_reads(spark, counts):
    unmapped = spark.createDataFrame([("a", 655), ("b", 5)], "sample string, unmapped long")
    msp = spark.createDataFrame([("m", 1, "g1", "core", 0)], "msp_name string, gene_id long, gene_name string, gene_category string, ord int")
    got = profile_samples(counts, msp, ProfileConfig(rarefaction_level=100, seed=7, normalization="fpkm"), unmapped=unmapped)
    sums = {r["sample"]: r["v"] for r in got.genes.groupBy("sample").agg(F.sum("value").alias("v")).collect()}
    assert 0.1 < sums["a"] < 0.7 and sums["b"] == pytest.approx(10 / 15)


def test_lost_samples_and_totals(spark):
    aln = spark.createDataFrame([("a", 1, 1, 100, 0), ("z", 2, 1, 100, 60)], "sample string, read_id long, gene_id long, ali int, nm int")
    genes = spark.createDataFrame([(1, 500), (2, 500)], "gene_id long, gene_length int")
    got = {(r["sample"], r["gene_id"]): r["value"] for r in counting.gene_counts(aln, genes, 0.95).collect()}
    assert got == {("a", 1): 1.0, ("a", 2): 0.0, ("z", 1): 0.0, ("z", 2): 0.0}
    totals = spark.createDataFrame([("a", 8), ("z", 4)], "sample string, total_reads long")
    rates = {r["sample"]: r["final_mapping_rate"] for r in counting.mapping_rate(aln, counting.best_hits(aln, 0.95), totals=totals).collect()}
    assert rates == {"a": 12.5, "z": 0.0}


def test_sparse_species_equal_dense_ones(spark, counts):
    core = spark.createDataFrame([("m", 1), ("m", 2), ("m", 9), ("n", 3), ("o", 8)], "msp_name string, gene_id long")
    genes = spark.createDataFrame([(g,) for g in range(1, 5)], "gene_id long")
    rows = lambda df: sorted(map(tuple, df.collect()))
    dense = rows(taxa.msp_abundance(counts, core, 0.3))
    assert rows(taxa.msp_abundance(counts.where("value > 0"), core, 0.3, genes, counts)) == dense
    assert ("a", "m", 2.5) in dense and ("a", "o", 0.0) in dense


def test_aligner_summaries(spark, tmp_path):
    log = "2000 reads; of these:\n  2000 (100.00%) were unpaired; of these:\n    497 (24.85%) aligned 0 times\n    1000 (50.00%) aligned exactly 1 time\n    503 (25.15%) aligned >1 times\n75.15% overall alignment rate\n"
    (tmp_path / "whole.log").write_text(log)
    (tmp_path / "cut.log").write_text(log[:60])
    assert [tuple(r) for r in readers.aligner_totals(spark, str(tmp_path)).collect()] == [("whole", 2000)]


def test_fasta_headers_with_the_marker(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">g1 a->b >c\nAC\nGT\r\n>g2\n\n>g3 last\nTT")
    with lzma.open(tmp_path / "y.fa.xz", "wt") as f:
        f.write(">g1 a->b >c\nACGT\n>g3\nTT\n")
    for name in ("x.fa", "y.fa.xz"):
        assert sorted(map(tuple, readers.read_fasta(spark, str(tmp_path / name)).collect())) == [("g1", "ACGT"), ("g3", "TT")]


def test_census_rules(spark, tmp_path):
    def add(folder, name, sample):
        os.makedirs(tmp_path / folder, exist_ok=True)
        (tmp_path / folder / name).write_text(json.dumps({"sample_info": {"sample_name": sample}, "mapping": {"reads": 3}}))

    add("one", "one_census_stage_2.json", "one")
    add("two", "two_census_stage_2.json", "two")
    assert readers.unique_census(readers.read_census(spark, str(tmp_path))).count() == 4
    add("two", "more_census_stage_2.json", "three")
    with pytest.raises(ValueError, match="folder"):
        readers.unique_census(readers.read_census(spark, str(tmp_path)))
    os.rename(tmp_path / "two" / "more_census_stage_2.json", tmp_path / "moved_census_stage_2.json")
    add("four", "four_census_stage_2.json", "one")
    with pytest.raises(ValueError, match="one sample"):
        readers.unique_census(readers.read_census(spark, str(tmp_path)))
    with pytest.raises(ValueError, match="no metadata"):
        readers.unique_census(readers.read_census(spark, str(tmp_path), "*_census_stage_9.json"))


def test_sequence_files(spark, tmp_path):
    for name in ("a/m1.fasta.xz", "a/g_consensus.fasta.xz", "b/m1.fasta.xz", "b/m2.fasta.xz"):
        os.makedirs(tmp_path / name.split("/")[0], exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    files = readers.sequence_files(spark, str(tmp_path))
    assert sorted(r["sample"] for r in files.collect()) == ["a", "b", "b"]
    with pytest.raises(ValueError, match="b"):
        readers.one_file_per_sample(files)
    assert readers.one_file_per_sample(files.where("sample = 'a'")).count() == 1


def test_fetch_unpack_and_link(tmp_path):
    (tmp_path / "genes.tsv").write_text("1\tg\n")
    with tarfile.open(tmp_path / "cat.tar.xz", "w:xz") as tar:
        tar.add(tmp_path / "genes.tsv", "cat/genes.tsv")
    url, digest = (tmp_path / "cat.tar.xz").as_uri(), catalogue.md5_of(str(tmp_path / "cat.tar.xz"))
    got = catalogue.fetch(url, str(tmp_path / "got.tar.xz"), digest)
    assert catalogue.unpack(got, str(tmp_path / "out")) == ["cat/genes.tsv"] and (tmp_path / "out/cat/genes.tsv").read_text() == "1\tg\n"
    assert catalogue.fetch("file:///nowhere", got, digest) == got  # it is there already
    with pytest.raises(ValueError):
        catalogue.fetch(url, str(tmp_path / "bad.tar.xz"), "0" * 32)
    assert not any(n.startswith("bad") for n in os.listdir(tmp_path))
    links = catalogue.link_files([str(tmp_path / "genes.tsv")], str(tmp_path / "links"))
    assert os.path.islink(links[0]) and catalogue.link_files([str(tmp_path / "genes.tsv")], str(tmp_path / "links")) == links


def test_versions():
    assert misc.at_least("tool 2.5.10\nbuilt", "2.5.2") and misc.at_least("2.5", "2.5")
    assert not misc.at_least("2.4.9", "2.5") and not misc.at_least("no number", "1.0")


def test_merged_profile(spark, counts):
    species = spark.createDataFrame([("a", "m", 1.0), ("b", "m", 2.0)], "sample string, msp_name string, value double")
    tables = {"genes": counts, "msp": species, "other": species}
    assert set(merge_profile(tables)) == {"msp"} and set(merge_profile(tables, MergeConfig(genes=True))) == {"genes", "msp"}
    assert [tuple(r) for r in merge_profile(tables)["msp"].collect()] == [("m", 1.0, 2.0)]


def test_biom_document_is_json(spark, tmp_path):
    species = spark.createDataFrame([("a", "m", 1.5), ("b", "m", 0.0), ("b", "k", 2.0), ("b", "gone", 0.0)], "sample string, msp_name string, value double")
    taxonomy = spark.createDataFrame([("m", "Bacteria", "a \"b\"")], "msp_name string, superkingdom string, species string")
    writers.write_biom(merge.biom_lines(species, taxonomy, date="2026-01-01"), str(tmp_path / "biom"))
    text = "".join((tmp_path / "biom" / n).read_text() for n in os.listdir(tmp_path / "biom") if n.endswith(".txt"))
    doc = json.loads(text)
    assert doc["shape"] == [2, 2] and [r["id"] for r in doc["rows"]] == ["k", "m"] and [c["id"] for c in doc["columns"]] == ["a", "b"]
    assert doc["data"] == [[0, 1, 2.0], [1, 0, 1.5]] and doc["rows"][1]["metadata"]["taxonomy"] == ["k__Bacteria", 's__a "b"', "t__m"]
    assert doc["matrix_type"] == "sparse" and doc["date"] == "2026-01-01"


def test_cached_tables_are_built_once(spark, tmp_path):
    built = []
    build = lambda: built.append(1) or spark.range(3)
    for _ in range(2):
        assert cached(spark, str(tmp_path / "t"), build).count() == 3
    os.remove(tmp_path / "t" / "_SUCCESS")  # a run that did not finish
    assert cached(spark, str(tmp_path / "t"), build).count() == 3 and len(built) == 2


def test_pair_counts_on_long_sequences(spark):
    """Bitmaps of more than one word, with every letter of the code, in both cases, against a loop."""
    rng = np.random.default_rng(5)
    letters = list("ACGTRYSWKMBDHVN-acgtn")
    seqs = ["".join(rng.choice(letters, 137)) for _ in range(3)]
    df = spark.createDataFrame([("m", str(i), s) for i, s in enumerate(seqs)], "msp_name string, sample string, seq string")
    cells = {(r["sample1"], r["sample2"]): r for r in phylo.pair_cells(phylo.sequence_pairs(df)).collect()}
    info = {(r["sample1"], r["sample2"]): r for r in phylo.pairwise_comparison(df).collect()}
    for (i, j), row in cells.items():
        pairs = [x + y for x, y in zip(seqs[int(i)].upper(), seqs[int(j)].upper())]
        assert all(row[x + y] == pairs.count(x + y) for x in "ACGT" for y in "ACGT")
        assert info[i, j]["overlap_noN_info_count"] == sum(not set(p) & set("N-") for p in pairs)


def test_missing_distances_count_as_the_largest(spark):
    rows = [("m", "a", "b", 0.1), ("m", "a", "c", None), ("m", "b", "c", 0.4)]
    df = spark.createDataFrame(rows, "msp_name string, sample1 string, sample2 string, distance double")
    merges = sorted((r["step"], round(r["height"], 6)) for r in phylo.cluster(df).collect())
    assert merges == [(0, 0.05), (1, 0.2)]
