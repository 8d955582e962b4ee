"""The corpus pipeline: its contract, and its stages against brute force on a small corpus."""

import random

import pytest
from brute import components, contamination, lines, quality
from pyspark.sql import functions as F

import corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(900)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)).capitalize() + "."
    item = line(25)
    rows = []
    for i in range(150):
        t = "\n".join(line(rng.randrange(8, 16)) for _ in range(rng.randrange(3, 9)))
        if i % 4 == 0:
            t = "Sign up for our newsletter today.\n" + t
        if i % 11 == 0:
            t = "\n".join(" ".join(w.upper() + "!!" for w in line(12).split()) for _ in range(6))
        if i % 13 == 0 and i < 90:  # on fewer sites than a spread line
            t += "\n" + item
        if i % 7 == 3:
            w = rows[-1][1].split(" ")
            w[len(w) // 2] = "changed"
            t = " ".join(w)
        rows.append((i, t, "en", f"src{i % 15}", len(t)))
    rows += [(900, None, None, None, None), (901, "", "en", "src1", 0)]
    out = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    labels = [(i, 0 if i % 11 == 0 else 1, 0) for i in range(0, 150)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out), item


def test_contract():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "jaccard_join", "benchmark_decontamination", "best_fit_packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages(spark, folder):
    sf, item = folder
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    text = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    start = text(docs)
    one = stage["quality_rules"](spark, docs, sf)
    kept = text(one)
    assert set(kept) == {d for d, t in start.items() if not quality(t)[-1] and 2 * t.count("!!") <= quality(t)[0]}
    two = stage["line_dedup"](spark, one, sf)
    want = lines([(r["doc_id"], r["text"], r["source"]) for r in one.collect()], 10)
    assert text(two) == {d: x[2] for d, x in want.items()} and any(x[1] for x in want.values())
    assert all(r["n_chars"] == len(r["text"]) for r in two.collect())
    three = stage["jaccard_join"](spark, two, sf)
    found = components(list(text(two).items()))
    assert set(text(three)) == {d for d, (_, c) in found.items() if c == d} and len(text(three)) < len(found)
    four = stage["benchmark_decontamination"](spark, three, sf)
    hit = contamination(list(text(three).items()), [(1, item)])
    assert set(text(four)) == {d for d, x in hit.items() if not x[1]} and any(x[1] for x in hit.values())
    for df in (one, two, three, four):
        assert df.columns == docs.columns
    packed = stage["best_fit_packing"](spark, four, sf)
    assert {r["doc_id"] for r in packed.collect()} == set(text(four))


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder[0])
    full = out.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert full and max(r["n"] for r in full) <= 1024


def test_empty_and_extra_columns(spark, folder, tmp_path):
    sf = folder[0]
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("kept", F.lit(1)).withColumn("removed", F.lit("x")).withColumn("row", F.lit(2.0))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf).collect() == [], name
        assert stage(spark, docs, sf).columns == docs.columns, name
