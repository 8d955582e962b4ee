"""Substring and line de-duplication, Jaccard components and decontamination against brute force."""

import random

import numpy as np
import pytest
from brute import components, contamination, corpus, lines, remove_repeats, shingles
from pyspark.sql import functions as F

from biomeframe.llm import decontam, jaccard, suffix
from biomeframe.llm import lines as line_dedup
from biomeframe.llm.components import connected_components

DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(5).cache()


@pytest.mark.parametrize("window, gram, group", [(50, 8, 4096), (50, 8, 1), (50, 8, 3), (12, 4, 2)])
def test_remove_repeats(spark, docs, window, gram, group):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in suffix.remove_repeats(docs, window, gram, group).collect()}
    want = remove_repeats(corpus(), window)
    assert sum(x[1] for x in want.values()) > 500
    assert got == want


def test_remove_repeats_edges(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(None, passage, "x"), (None, passage, "y"), (2, passage, "z"), (2, passage, "z"), (3, passage + " end", "q"), (4, None, None), (5, "", None)]
    got = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, kept string")).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in got) == [
        (False, 2, 60, 0), (False, 2, 60, 0), (False, 3, 61, 60), (False, 4, 0, 0), (False, 5, 0, 0), (True, 0, 60, 0), (True, 0, 60, 0)
    ]
    assert suffix.remove_repeats(spark.createDataFrame([], DOCS)).collect() == []


def test_subtree_nodes():
    words = [np.arange(100, 160, dtype=np.uint64), np.arange(100, 160, dtype=np.uint64)]
    words[1] = np.concatenate([words[1][:55], np.array([7, 8, 9, 10, 11], np.uint64)])
    row, o, depth = suffix.subtree_repeats(np.zeros(2, np.int64), np.array([1, 2]), np.array([10, 10]), np.array([50, 50]), words)
    assert sorted(zip(row.tolist(), o.tolist(), depth.tolist())) == [(1, k, 45 + k) for k in range(5, 11)]  # down to the change, from windows that end before it
    row, o, _ = suffix.subtree_repeats(np.zeros(2, np.int64), np.array([1, 2]), np.array([10, 10]), np.array([50, 50]), words, 50, np.array([7, 7]), np.array([8, 8]))
    assert sorted(o.tolist()) == [7, 8]


def test_longer_prefixes_cover_each_window_once():
    for window, gram in ((50, 8), (12, 4), (10, 8), (8, 8)):
        steps = {name: list(range(first, last + 1)) for name, _, _, first, last in suffix._steps(window, gram)}
        assert sorted(steps["k0"] + steps["k1"]) == list(range(window - gram + 1))
        assert sorted(steps["k00"] + steps["k01"]) == steps["k0"]
        for _, before, after, first, last in suffix._steps(window, gram):
            assert all(before <= o and after <= window - o for o in range(first, last + 1))


def test_a_very_long_text_repeats_a_passage(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(5000)}" for _ in range(80_000)]
    rows = [(1, " ".join(words[70_000:70_200])), (2, " ".join(words)), (3, " ".join(words[100:160]))]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in suffix.remove_repeats(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == remove_repeats(rows, 50) and got[2][1] == 200 and got[3][1] == 60


def test_jaccard(spark, docs):
    want = components(corpus())
    for frequent, most, rows in ((64, 1000, 1024), (2, 1_000_000, 3), (2, 3, 1024)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs, frequent, most, rows).collect()}
        assert got == want
    assert len({c for _, c in want.values()}) < len(want) - 10


def test_jaccard_chains(spark):
    """Near copies that link only along chains, in sizes around the threshold."""
    rng = random.Random(4)
    rows, w = [], [f"w{i}" for i in range(80)]
    for i in range(40):
        rows.append((100 - i, " ".join(w)))
        for _ in range(rng.randrange(1, 3)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        if rng.random() < 0.3:
            w.insert(rng.randrange(len(w)), "new")
    rows += [(200 + i, " ".join(f"a{j}" for j in range(n))) for i, n in enumerate((20, 21, 22, 24, 26, 30, 36))]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == components(rows)


def test_jaccard_edges(spark):
    rows = [(None, "a b c d e f", 1), (1, "a b c d e f", 2), (1, "a b c d e f", 2), (2, "A B c d e f", 3), (3, None, 4), (4, "", 5), (5, "", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df).collect())
    assert got == [(False, 1, 2, 1), (False, 1, 2, 1), (False, 2, 2, 1), (False, 3, 0, 3), (False, 4, 0, 4), (False, 5, 0, 5), (True, 0, 2, None)]
    assert jaccard.jaccard_components(spark.createDataFrame([], DOCS)).collect() == []
    kept = jaccard.keep_one_per_component(df)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 1), (False, 3), (False, 4), (False, 5), (True, 0)]
    assert kept.columns == df.columns


def test_keep_one_with_shared_ids(spark):
    words = lambda c: " ".join(f"{c}{i}" for i in range(40))
    rows = [(5, words("a"), 1), (5, words("b"), 2), (5, words("b"), 3), (6, words("a") + " x", 4), (4, words("b") + " x", 5), (7, words("c"), 6), (7, None, 7), (7, None, 8)]
    rows += [(None, words("d"), 9), (None, words("d"), 10), (None, words("d") + " x", 11), (None, words("e"), 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key int").repartition(3)
    kept = jaccard.keep_one_per_component(df)
    got = [(r["doc_id"], (r["text"] or "-")[0]) for r in kept.collect()]
    assert sorted(got, key=str) == sorted([(5, "a"), (4, "b"), (7, "c"), (7, "-"), (None, "d"), (None, "e")], key=str)
    assert kept.columns == df.columns


def test_jaccard_long_lists(spark):
    """Several groups of near copies around one common passage, in lists longer than list_rows, and a very long text."""
    rng = random.Random(8)
    rows, base = [], [f"b{i}" for i in range(60)]
    for g in range(4):
        w = base[:30] + [f"g{g}x{i}" for i in range(30)] if g else base
        for k in range(14):
            t = list(w)
            for _ in range(rng.randrange(0, 4)):
                t[rng.randrange(len(t))] = f"r{rng.randrange(10**6)}"
            rows.append((g * 100 + k, " ".join(t)))
    long = [f"v{rng.randrange(3000)}" for _ in range(120_000)]
    rows += [(900, " ".join(long)), (901, " ".join(long[:-500])), (902, " ".join(long[:60_000]))]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    for frequent, limit in ((2, 4), (4, 8)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df, frequent, 1_000_000, limit).collect()}
        assert got == components(rows)
    assert got[901][1] == 900 and got[902][1] == 902


def test_derived_overlaps():
    """The bounds from a leader's answers hold, and round 2 leaves open or links exactly what they say."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        lead, a, b = (np.unique(rng.integers(0, 40, rng.integers(1, 40))) for _ in range(3))
        low, high = jaccard.derived_overlap(*(np.array(len(np.intersect1d(x, lead))) for x in (a, b)), len(a), len(b), len(lead))
        assert low <= len(np.intersect1d(a, b)) <= high
        assert jaccard._common(a, b) == len(np.intersect1d(a, b))


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(1)
    for n in (1, 30, 400):
        for m in (1, 25, 900):
            pool = rng.integers(1, 2**63, 1200).astype(np.uint64)
            a, b = np.unique(rng.choice(pool, n)), np.unique(rng.choice(pool, m))
            assert jaccard.bitmap_difference(jaccard.parity_bitmap(a), jaccard.parity_bitmap(b)) <= len(np.setxor1d(a, b))


def test_prefix_filter_arithmetic():
    for n in range(1, 60):
        for m in range(n, 60):
            o = jaccard.least_overlap(n, m)
            assert 100 * o >= 75 * (n + m - o) and (o == 0 or 100 * (o - 1) < 75 * (n + m - o + 1))


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, 1000 + i) for i in range(1, 60)] + [(2000 + i, 2001 + i) for i in range(40)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    want = {x: root(x) for a, b in edges if a != b for x in (a, b)}
    df = spark.createDataFrame([*edges, (5, None), (None, None)], "src long, dst long")
    for local in (0, 10**6):
        assert {r["node"]: r["component"] for r in connected_components(df, local=local).collect()} == want
    assert connected_components(df.limit(0)).collect() == []


ITEMS = [(1, "The quick brown fox jumps over the lazy dog and then runs away home"), (2, "short item"), (10, "éß 漢 one"), (11, None), (12, ""), (None, "quick brown"), (13, "brown fox jumps over the lazy dog and then runs")]


def planted():
    rng = random.Random(9)
    out = corpus(3, 30)
    k = 1000
    for _, t in ITEMS[:3]:
        for cut in (0, 1, 3):
            w = t.split()
            out.append((k, "before it " + " ".join(w[cut:]).upper().replace(" ", " -- ") + " after"))
            k += 1
    out.append((k, " ".join(rng.choice("quick brown fox the lazy dog short item".split()) for _ in range(400))))
    return out


@pytest.mark.parametrize("known", [1_000_000, 0])
def test_contamination(spark, known):
    rows = planted()
    got = decontam.find_contamination(spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(ITEMS, "item_id long, text string"), filter_fingerprints=known)
    got = got.select("doc_id", "n_words", decontam.covered_words("spans").alias("n_hit"), F.sort_array("item_ids").alias("ids")).collect()
    want = contamination(rows, [x for x in ITEMS if x[0] is not None])
    assert sum(x[1] > 0 for x in want.values()) >= 5
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["ids"]) for r in got} == want


def test_contamination_edges(spark):
    rows = [(None, "a short item here", 1), (7, None, 2), (8, "", 3), (9, "short item", 4), (9, "short item", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontam.find_contamination(df, items).select("doc_id", decontam.covered_words("spans").alias("n"))
    assert sorted((r["doc_id"] or 0, r["n"]) for r in got.collect()) == [(0, 2), (7, 0), (8, 0), (9, 2), (9, 2)]
    assert {r["n_words"] for r in decontam.find_contamination(df, items.limit(0)).collect()} == {0, 2, 4}
    assert decontam.find_contamination(df.limit(0), items).collect() == []


def test_lines(spark):
    rng = random.Random(6)
    rows = [(d, t, None if rng.random() < 0.1 else f"site{rng.randrange(8)}") for d, t in corpus(6, 90)]
    rows += [(1000 + i, f"Read our cookie policy here.\nown words of page {i} stand alone", f"site{i % 8}") for i in range(20)]
    rows += [(2000 + i, f"Read our terms of use.\nother words of page {i}\n", f"site{i % 5}") for i in range(20)]
    copy = "This page exists\nin copies on many sites\nand has no words of its own"
    rows += [(3000 + i, copy, f"site{i % 8}") for i in range(12)]
    rows += [(4000, "Read our cookie policy here.\nshort own line", "site1")]  # mostly boilerplate, and yet cleaned
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    for sites in (5, 6, 9):
        got = {r["doc_id"]: (r["lines"], r["removed"], r["kept"]) for r in line_dedup.dedup_lines(df, min_sites=sites).select("row.doc_id", "lines", "removed", "kept").collect()}
        want = lines(rows, sites)
        assert got == want
        assert (sum(x[1] for x in want.values()) > 0) == (sites < 9)
        assert got[3000][1] == 0 and got[4000][1] == (sites < 9)
    every = {r["doc_id"]: r["removed"] for r in line_dedup.dedup_lines(df, min_sites=5, max_share=1.0).select("row.doc_id", "removed").collect()}
    assert every[3000] == copy.count("\n") + 1 and every == {d: x[1] for d, x in lines(rows, 5, max_share=1.0).items()}


def test_lines_edges(spark):
    rows = [(1, None, "s", "k"), (1, None, "s", "k"), (2, "", "s", "k"), (None, "a b c d", None, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, kept string")
    got = line_dedup.dedup_lines(df).collect()
    assert sorted((r["row"]["doc_id"] or 0, r["lines"], r["removed"], r["kept"] or "") for r in got) == [(0, 1, 0, "a b c d"), (1, 0, 0, ""), (1, 0, 0, ""), (2, 1, 0, "")]
    assert line_dedup.dedup_lines(df.limit(0)).collect() == []


def test_brute_force_itself():
    assert shingles("a b c") == {("a", "b", "c")} and shingles("") == set()
