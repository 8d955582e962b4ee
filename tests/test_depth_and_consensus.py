"""Depth, run lengths, consensus and strain plans."""

import random
import re
from itertools import groupby

import pytest

from biomeframe.operators import consensus, depth
from biomeframe.plans.config import StrainConfig, TreeConfig
from biomeframe.plans.workflows import strain_sequences, strain_trees

GENES = "gene_id long, gene_length int"


def runs_of(spark, segments, length, max_depth=None):
    s = spark.createDataFrame([("s", 1, a, b) for a, b in segments], "sample string, gene_id long, startpos int, endpos int")
    got = depth.depth_runs(s, spark.createDataFrame([(1, length)], GENES), max_depth)
    return sorted((r["startpos"], r["endpos"], r["depth"]) for r in got.collect())


def test_runs_against_loop(spark):
    rng = random.Random(5)
    for _ in range(4):
        length = rng.randrange(20, 60)
        segments = [(a, a + rng.randrange(1, 15)) for a in (rng.randrange(-3, length) for _ in range(8))]
        d = [sum(a <= p < b for a, b in segments) for p in range(length)]
        want, at = [], 0
        for value, group in groupby(d):
            n = len(list(group))
            want.append((at, at + n, value))
            at += n
        assert runs_of(spark, segments, length) == want


def test_depth_cap_and_flags(spark):
    assert runs_of(spark, [(0, 5)] * 4, 10, 3) == [(0, 5, 3), (5, 10, 0)]
    rows = [("s", 1, 0, "5M", 0), ("s", 1, 2, "3M2D1M", 0x100), ("s", 1, 1, "2M1N2M", 16)]
    got = depth.segments_of(spark.createDataFrame(rows, "sample string, gene_id long, pos int, cigar string, flag int")).collect()
    assert sorted((r["startpos"], r["endpos"]) for r in got) == [(0, 5), (1, 3), (4, 6)]  # a skip has no depth
    assert sum(r["reads"] for r in got) == 2


def test_depth_against_a_walk_over_cigars(spark):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        ops = [(rng.randrange(1, 6), rng.choice("MMMMDNIS=X")) for _ in range(rng.randrange(1, 6))]
        rows.append(("s", 1, rng.randrange(0, 30), "".join(f"{n}{o}" for n, o in ops), 0))
    want = [0] * 80
    for _, _, at, cigar, _ in rows:
        for n, o in [(int(x[:-1]), x[-1]) for x in re.findall(r"\d+[A-Z=]", cigar)]:
            for p in range(at, at + n) if o in "M=X" else ():
                want[p] += 1
            at += n if o in "MDN=X" else 0
    segments = depth.segments_of(spark.createDataFrame(rows, "sample string, gene_id long, pos int, cigar string, flag int"))
    genes = spark.createDataFrame([(1, 80)], GENES)
    runs = depth.depth_runs(segments, genes)
    got = {r["pos"]: r["depth"] for r in depth.depth_per_position(runs).collect()}
    assert [got[p] for p in range(80)] == want
    assert depth.gene_coverage(runs, segments, genes).first()["numreads"] == sum(any(o in c for o in "M=X") for _, _, _, c, _ in rows)


def test_low_coverage_intervals(spark):
    length, positions = 7408, [(p, 1) for p in range(11, 18)] + [(18, 2)] + [(p, 9) for p in range(19, 7392)]
    positions += [(p, 2) for p in range(7392, 7396)] + [(p, 1) for p in range(7396, 7406)]
    rows = spark.createDataFrame([("s", 1, p, d) for p, d in positions], "sample string, gene_id long, pos int, depth int")
    runs = depth.runs_of_positions(rows, spark.createDataFrame([(1, length)], GENES))
    got = sorted((r["startpos"], r["endpos"], r["coverage"]) for r in depth.low_coverage_intervals(runs, 3).collect())
    assert got == [(0, 11, 0), (11, 18, 1), (18, 19, 2), (7392, 7396, 2), (7396, 7406, 1), (7406, 7408, 0)]


def test_consensus(spark):
    ref = spark.createDataFrame([("s", 1, "ACGTACGTAC"), ("s", 2, "AAAA"), ("s", 3, "CCCC")], "sample string, gene_id long, seq string")
    rows = [
        ("s", 1, 1, "C", ["T"], 5, [5], 0), ("s", 1, 1, "C", ["G"], 0, [9], 1),  # second record of a position
        ("s", 1, 3, "TAC", ["TGC", "TAT"], 1, [4, 5], 2), ("s", 1, 8, "A", ["G"], 0, [9], 3), ("s", 2, 0, "A", ["C"], 0, [9], 4),
    ]
    variants = spark.createDataFrame(rows, "sample string, gene_id long, start int, ref string, alts array<string>, ro int, ao array<int>, ord long")
    masks = spark.createDataFrame([("s", 1, 8, 10), ("s", 3, 0, 2)], "sample string, gene_id long, startpos int, endpos int")
    ignored = spark.createDataFrame([("s", 2)], "sample string, gene_id long")
    got = {r["gene_id"]: r["seq"] for r in consensus.consensus(ref, variants, masks, ignored, 0.1).collect()}
    assert got == {1: "AYGTRYGTNN", 2: "NNNN", 3: "NNCC"}


def test_species_sequences(spark):
    genes = spark.createDataFrame([("s", 1, "AC"), ("s", 2, "GT"), ("t", 1, "NN")], "sample string, gene_id long, seq string")
    msp = spark.createDataFrame([("m", 2, 0), ("m", 1, 1)], "msp_name string, gene_id long, ord int")
    assert [tuple(r) for r in consensus.species_sequences(genes, msp).collect()] == [("s", "m", "GTAC")]


def test_strain_to_tree(spark):
    rng = random.Random(1)
    base = "".join(rng.choice("ACGT") for _ in range(60))
    other = base[:10] + {"A": "G", "G": "A", "C": "T", "T": "C"}[base[10]] + base[11:]
    aln, variants = [], []
    for sample in "abc":
        aln += [(sample, f"r{i}", 1, i % 3 * 20, "20M", 0) for i in range(12)]
    variants.append(("c", 1, 10, base[10], [other[10]], 0, [4], 0))
    alignments = spark.createDataFrame(aln, "sample string, read_id string, gene_id long, pos int, cigar string, flag int")
    genes = spark.createDataFrame([(1, 60)], GENES)
    reference = spark.createDataFrame([(1, base)], "gene_id long, seq string")
    msp = spark.createDataFrame([("m", 1, "core", 0)], "msp_name string, gene_id long, gene_category string, ord int")
    counts = spark.createDataFrame([(s, 1, 12.0) for s in "abc"], "sample string, gene_id long, value double")
    v = spark.createDataFrame(variants, "sample string, gene_id long, start int, ref string, alts array<string>, ro int, ao array<int>, ord long")
    seqs = strain_sequences(alignments, genes, reference, msp, counts, v, StrainConfig(core_size=1))
    assert {r["sample"]: r["seq"] for r in seqs.collect()} == {"a": base, "b": base, "c": other}
    for model in ("TN93", "GTR"):
        distances, pairs, trees = strain_trees(seqs, TreeConfig(model=model))
        d = {(r["sample1"], r["sample2"]): r["distance"] for r in distances.collect()}
        assert d["a", "b"] == pytest.approx(0) and d["a", "c"] == pytest.approx(d["b", "c"]) and 0.01 < d["a", "c"] < 0.03
        assert {r["distance_category"] for r in pairs.collect()} == {"same_strain", "divergent"}
        assert trees.collect()[0]["newick"].startswith("((a:0,b:0):")


def test_pileup(spark):
    ref = spark.createDataFrame([("s", 1, "ACGT")], "sample string, gene_id long, seq string")
    bases = [("s", 1, 1, b) for b in "CCCT"] + [("s", 1, 2, "A")]
    got = consensus.pileup_variants(spark.createDataFrame(bases, "sample string, gene_id long, pos int, base string"), ref).collect()
    assert [(r["start"], r["ref"], r["alts"], r["ro"], r["ao"]) for r in got] == [(1, "C", ["T"], 3, [1])]
