"""Best hits, counts and shares, on the hand-made case and against a plain Python version."""

import random
from collections import defaultdict

import pytest

from biomeframe.operators import counting

ALN = "sample string, read_id string, gene_id long, ali int, nm int"
CASE = [
    ("s", "r1", 1, 80, 0), ("s", "r1", 2, 80, 1), ("s", "r2", 1, 80, 0), ("s", "r3", 2, 80, 0), ("s", "r4", 1, 80, 0), ("s", "r4", 2, 80, 0),
    ("s", "r5", 3, 80, 0), ("s", "r5", 3, 80, 0), ("s", "r6", 4, 80, 10),
]
GENES = [(1, 1000), (2, 1000), (3, 1000), (4, 1000)]


def counts(spark, rows, genes, threshold, mode):
    table = counting.gene_counts(spark.createDataFrame(rows, ALN), spark.createDataFrame(genes, "gene_id long, gene_length int"), threshold, mode)
    return {(r["sample"], r["gene_id"]): r["value"] for r in table.collect()}


@pytest.mark.parametrize(
    "mode, expected", [("unique", [2, 1, 0, 0]), ("total", [3, 2, 2, 0]), ("smart_shared", [2 + 2 / 3, 1 + 1 / 3, 0.5, 0])]
)
def test_modes(spark, mode, expected):
    got = counts(spark, CASE, GENES, 0.95, mode)
    assert [got["s", g] for g in (1, 2, 3, 4)] == pytest.approx(expected)


def test_counted_reads_and_rate(spark):
    aln = spark.createDataFrame(CASE, ALN)
    hits = counting.best_hits(aln, 0.95)
    assert counting.counted_reads(hits).collect()[0]["counted_reads"] == 5
    assert counting.counted_reads(hits, "unique").collect()[0]["counted_reads"] == 3
    row = counting.mapping_rate(aln, hits).collect()[0]
    assert (row["total_reads"], row["final_mapping_rate"]) == (6, 83.33)


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        counts(spark, CASE, GENES, 0.95, "best")


def test_empty_alignments_and_zero_threshold(spark):
    rows = [("s", "a", 1, 0, 0), ("s", "b", 1, 10, 10), ("s", "c", 2, 10, 0)]
    got = counts(spark, rows, [(1, 10), (2, 10)], 0.0, "total")
    assert got == {("s", 1): 1.0, ("s", 2): 1.0}


def by_hand(rows, genes, threshold):
    reads = defaultdict(list)
    for s, r, g, ali, nm in rows:
        if ali and (ali - nm) / ali >= threshold:
            reads[s, r].append(((ali - nm) / ali, g))
    best = {k: [g for i, g in v if i == max(v)[0]] for k, v in reads.items()}
    value = defaultdict(float)
    unique = defaultdict(int)
    for (s, _), gs in best.items():
        if len(gs) == 1:
            unique[s, gs[0]] += 1
    for (s, _), gs in best.items():
        total = sum(unique[s, g] for g in gs)
        for g in set(gs):
            if len(gs) == 1:
                value[s, g] += 1
            elif total == 0:
                value[s, g] += 1 / len(gs)
            else:
                value[s, g] += gs.count(g) * unique[s, g] / total
    return value


def test_shares_against_plain_python(spark):
    rng = random.Random(3)
    rows = [(rng.choice("xy"), f"r{rng.randrange(120)}", rng.randrange(12), 100, rng.choice([0, 0, 1, 3, 8])) for _ in range(600)]
    got = counts(spark, rows, [(g, 500) for g in range(12)], 0.95, "smart_shared")
    want = by_hand(rows, range(12), 0.95)
    assert got == pytest.approx({k: want.get(k, 0.0) for k in got})
