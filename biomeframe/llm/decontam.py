"""Benchmark decontamination by winnowing.

Fingerprints are the least k-gram hashes of sliding windows (winnowing); of two texts that share a
span of ``window`` words, both select the same k-gram inside it, so joining training and test
fingerprints finds every such span.  Hits are extended to all windows around the shared k-gram,
and the extended windows are joined with the benchmark's windows; a window that matches marks all its words.

Benchmark items shorter than a window are one window of their own length, whose only k-gram is the whole item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import cut, prepare, small
from ._text import ALNUM, Block, blocks, minimizers, signed, span_of, window_sums

WINDOW = 10
GRAM = 5
#: Up to so many distinct benchmark fingerprints travel to the tasks, which then drop other
#: fingerprints before the join; beyond it all fingerprints of the documents go through the shuffle join.
FILTER_FINGERPRINTS = 1_000_000


def fingerprints(b: Block, length: int, window: int, gram: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the fingerprints for windows of ``length`` words."""
    size = min(gram, length) if length == window else length
    n = len(b.words)
    if n < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    values = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    at = np.arange(n - size + 1)
    values[: n - size + 1] = span_of(sums, at, at + size)
    places = minimizers(values, b.wfirst, size, length - size + 1)
    return places, values[places]


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """Distinct ``(item_id, length, hash)`` of the items' windows and ``(length, fp)`` of their fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(1), ALNUM, True):
                ids = np.asarray(batch.column(0).to_pylist()[b.first : b.last], object)
                sums, counts, doc = window_sums(b.words), b.counts, b.doc_of_word()
                size = np.minimum(counts, window)
                first = np.repeat(b.wfirst[:-1], np.where(counts > 0, counts - size + 1, 0))
                owner = np.repeat(np.arange(b.n), np.where(counts > 0, counts - size + 1, 0))
                inside = np.arange(len(first)) - np.repeat(np.cumsum(np.where(counts > 0, counts - size + 1, 0)) - np.where(counts > 0, counts - size + 1, 0), np.where(counts > 0, counts - size + 1, 0))
                start = first + inside
                length = size[owner]
                out = [(pa.array(ids[owner], pa.string()), length, span_of(sums, start, start + length), np.zeros(len(start), bool))]
                for n in np.unique(size[size > 0]):
                    places, values = fingerprints(b, int(n), window, gram, sums)
                    mine = size[doc[places]] == n
                    out.append((pa.array(ids[doc[places[mine]]], pa.string()), np.full(mine.sum(), n), values[mine], np.ones(mine.sum(), bool)))
                for item, length, value, is_fp in out:
                    yield pa.RecordBatch.from_arrays([item, pa.array(length, pa.int32()), pa.array(signed(value)), pa.array(is_fp)], names=["item_id", "length", "hash", "is_fp"])

    rows = benchmark.select(F.col("item_id").cast("string"), "text").where("item_id is not null")
    rows = cut(rows.mapInArrow(run, "item_id string, length int, hash long, is_fp boolean").distinct())
    wins = rows.where("not is_fp").select("item_id", "length", "hash")
    fps = rows.where("is_fp").select("length", F.col("hash").alias("fp")).distinct()
    return wins, fps


HITS = "n_words long, text_hash long, hits array<struct<length:int,fp:bigint,start:array<int>,hash:array<bigint>>>"


def document_hits(docs: DataFrame, lengths: list[int], known: dict[int, np.ndarray] | None, window: int, gram: int) -> DataFrame:
    """Per document its words and, for each fingerprint (of ``known`` ones, if given), the windows around it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(1), ALNUM, True):
                sums = window_sums(b.words)
                wdoc = b.doc_of_word()
                parts = []
                for n in lengths:
                    places, values = fingerprints(b, n, window, gram, sums)
                    if known is not None:
                        have = known[n]
                        k = np.minimum(np.searchsorted(have, values), max(len(have) - 1, 0))
                        mine = have[k] == values if len(have) else np.zeros(len(values), bool)
                        places, values = places[mine], values[mine]
                    span = n - (min(gram, n) if n == window else n) + 1
                    starts = places[:, None] - np.arange(span)[None]
                    doc = wdoc[places]
                    valid = (starts >= b.wfirst[doc][:, None]) & (starts + n <= b.wfirst[doc + 1][:, None])
                    parts.append((np.full(len(places), n), values, doc, starts, valid))
                counts = np.zeros(b.n, np.int64)
                for p in parts:
                    counts += np.bincount(p[2], minlength=b.n)
                doc = np.concatenate([p[2] for p in parts]) if parts else np.zeros(0, np.int64)
                order = np.argsort(doc, kind="stable")
                length = np.concatenate([p[0] for p in parts])[order] if parts else doc
                fp = np.concatenate([p[1] for p in parts])[order] if parts else np.zeros(0, np.uint64)
                lists = [(s[v], v.sum(1), n) for n, _, _, s, v in ((int(p[0][0]) if len(p[0]) else 0, *p[1:]) for p in parts)]
                start = np.concatenate([x[0] for x in lists]) if lists else doc
                sizes = np.concatenate([x[1] for x in lists]) if lists else doc
                which = np.concatenate([np.full(len(x[0]), x[2]) for x in lists]) if lists else doc
                value = span_of(sums, start, start + which)
                bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
                # reorder the inner lists to the documents' order
                sizes_o = sizes[order]
                take = np.repeat(bounds[:-1][order] - np.concatenate([[0], np.cumsum(sizes_o)[:-1]]) if len(order) else np.zeros(0, np.int64), sizes_o) + np.arange(int(sizes_o.sum()))
                inner = pa.array(np.concatenate([[0], np.cumsum(sizes_o)]), pa.int32())
                take = take.astype(np.int64)
                start, value = start[take] - b.wfirst[wdoc[start[take]]] if len(take) else start[take], value[take]
                struct = pa.StructArray.from_arrays(
                    [pa.array(length, pa.int32()), pa.array(signed(fp)), pa.ListArray.from_arrays(inner, pa.array(start, pa.int32())), pa.ListArray.from_arrays(inner, pa.array(signed(value)))],
                    names=["length", "fp", "start", "hash"],
                )
                hits = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), struct)
                whole = b.span_hash(b.offsets[:-1], b.offsets[1:])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.first, b.n), pa.array(b.counts), pa.array(signed(whole)), hits], names=["doc_id", "n_words", "text_hash", "hits"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {HITS}")


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, filter_fingerprints: int = FILTER_FINGERPRINTS) -> DataFrame:
    """One row per document row: doc_id, n_words, text_hash, spans (start, length in words), item_ids.

    Null and empty texts have no words and no hits; repeated rows give repeated results; items with
    null id or without words match nothing; an empty benchmark leaves every document clean.
    """
    prepare(docs.sparkSession)
    wins, fps = benchmark_windows(benchmark, window, gram)
    fps = cut(fps)
    lengths = sorted(r["length"] for r in fps.select("length").distinct().collect())
    known = None
    if fps.count() <= filter_fingerprints:
        rows = fps.collect()
        known = {n: np.sort(np.array([r["fp"] for r in rows if r["length"] == n], np.int64).view(np.uint64)) for n in lengths}
    base = cut(document_hits(docs, lengths, known, window, gram))
    hits = base.where(F.size("hits") > 0).select("n_words", "text_hash", F.explode("hits").alias("h")).distinct()
    hits = hits.select("n_words", "text_hash", "h.*").join(small(fps), ["length", "fp"], "left_semi")
    near = hits.select("n_words", "text_hash", "length", F.explode(F.arrays_zip("start", "hash")).alias("w"))
    near = near.select("n_words", "text_hash", "length", "w.start", "w.hash").distinct()
    # Windows are matched with the distinct windows first, then distinct ones per document with the items.
    distinct = cut(wins.select("length", "hash").distinct())
    found = cut(near.join(small(distinct), ["length", "hash"], "left_semi"))
    spans = found.groupBy("n_words", "text_hash").agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias("spans"))
    named = found.select("n_words", "text_hash", "length", "hash").distinct().join(small(wins), ["length", "hash"])
    items = named.groupBy("n_words", "text_hash").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    key = ["n_words", "text_hash"]
    # Equal texts share their hits: the key is the text, so null or repeated ids do no harm.
    out = base.drop("hits").join(spans, key, "left").join(items, key, "left")
    return out.select(
        "doc_id", "n_words", "text_hash",
        F.coalesce("spans", F.array().cast("array<struct<start:int,length:int>>")).alias("spans"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )


def covered_words(spans) -> F.Column:
    """Number of words in the union of sorted ``(start, length)`` spans."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def add(acc, s):
        end = (s["start"] + s["length"]).cast("long")
        return F.struct(
            (acc["n"] + F.greatest(end - F.greatest(s["start"].cast("long"), acc["end"]), F.lit(0).cast("long"))).alias("n"),
            F.greatest(acc["end"], end).alias("end"),
        )

    return F.aggregate(spans, zero, add, lambda acc: acc["n"])


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and items of the benchmark found in every document."""
    found = find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = covered_words("spans")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
