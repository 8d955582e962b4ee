"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

* Features: hashed n-grams (1 to 3 characters, lower-cased ASCII) of the whole text, term frequency
  relative to the text's length, times inverse document frequency counted over all training documents.
* Training: follow-the-regularised-leader with elastic-net penalties (per-coordinate rates; L1 keeps the weights
  sparse), on a bounded sample: about ``SAMPLE_PER_LANGUAGE`` documents per language, chosen by hash, and no more than
  ``SAMPLE_TOTAL`` in all and ``SAMPLE_BYTES`` of features.
* Calibration: one temperature, fitted on sampled documents that took no part in training.
* Prediction: every text in blocks of bytes; each n-gram's weights are gathered and summed per document,
  so a text of any length costs memory in proportion to one block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._spark import cut, prepare
from ._text import buffers, mix

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Bound of the fitting sample, in documents per language (an expected number; rarer languages give all they have).
SAMPLE_PER_LANGUAGE = 600
#: Hard bounds of the sample over all languages: documents, and bytes of their features.
SAMPLE_TOTAL = 12_000
SAMPLE_BYTES = 96 << 20
#: One sampled document in so many is kept for the temperature.
CALIBRATION_SHARE = 4
EPOCHS = 3
ALPHA, BETA, L1, L2 = 2.0, 1.0, 2e-4, 1e-4
LETTER = re.compile(r"[^\W\d_]")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LEAD = np.ones(256, bool)
_LEAD[0x80:0xC0] = False


@dataclass
class LanguageModel:
    labels: list[str]
    weights: np.ndarray  # BUCKETS x labels, already times idf
    bias: np.ndarray
    temperature: float


def text_blocks(col: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, offsets, bytes) of blocks of whole texts."""
    offsets, raw = buffers(col)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = min(n, max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1))
        yield first, last, offsets[first : last + 1] - offsets[first], raw[offsets[first] : offsets[last]]
        first = last


def grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram and its document, for all orders.

    Characters are code points; an n-gram is hashed from its bytes and does not leave its text.
    """
    low = _LOWER[raw]
    at = np.flatnonzero(_LEAD[low])
    nxt = np.append(at[1:], len(low))
    width = nxt - at
    char = low[at].astype(np.uint32)
    for k in range(1, 4):
        more = width > k
        char[more] = (char[more] << np.uint32(8)) | low[at[more] + k]
    doc = np.searchsorted(offsets, at, "right") - 1
    # empty texts share an offset: the last of them owns the characters
    buckets, docs = [], []
    code = np.zeros(len(at), np.uint64)
    for order in ORDERS:
        n = len(at) - order + 1
        if n <= 0:
            break
        code = code[:n] * np.uint64(0x100000001B3) + char[order - 1 :].astype(np.uint64) + np.uint64(order)
        inside = doc[:n] == doc[order - 1 :]
        buckets.append((mix(code[inside]) & np.uint64(BUCKETS - 1)).astype(np.int64))
        docs.append(doc[:n][inside])
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(docs)


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Number of documents and document frequency per bucket, over all rows of docs (column text).

    Each task adds up its own documents; at most ``BUCKETS`` sums per task are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for first, last, offsets, raw in text_blocks(batch.column(0)):
                bucket, doc = grams(raw, offsets)
                flags = np.zeros((last - first, BUCKETS), bool) if (last - first) * BUCKETS <= 1 << 25 else None
                if flags is not None:
                    flags[doc, bucket] = True
                    total += flags.sum(0)
                else:
                    total += np.bincount(np.unique(doc * BUCKETS + bucket) % BUCKETS, minlength=BUCKETS)
                n += last - first
        if n:
            have = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, have)), pa.array(np.append(n, total[have]))], names=["bucket", "n"])

    rows = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df, n = np.zeros(BUCKETS), 0
    for r in rows:
        if r["bucket"] < 0:
            n = r["n"]
        else:
            df[r["bucket"]] = r["n"]
    return n, df


def sample_documents(train: DataFrame, per_language: int) -> DataFrame:
    """About ``per_language`` rows of each language (fewer if there are many languages), by a hash ``h`` of doc_id and text.

    Rows with equal doc_id, text and lang count once, so repeated rows or ids can neither fill nor empty the sample.
    """
    counts = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return train.limit(0).withColumn("h", F.lit(0).cast("long"))
    per_language = max(1, min(per_language, SAMPLE_TOTAL // len(counts)))
    share = F.create_map(*(x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(min(1.0, per_language / n)))))
    hashed = train.withColumn("h", F.xxhash64("doc_id", "text", F.lit(7)))
    chance = F.col("h").cast("double") / 2.0**64 + 0.5
    chosen = hashed.where(chance < F.element_at(share, F.col("lang")))
    return chosen.dropDuplicates(["lang", "h"])


def sparse_counts(docs: DataFrame) -> list:
    """lang, fold, and the text's buckets with relative frequencies, for each sampled document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, offsets, raw in text_blocks(batch.column(0)):
                bucket, doc = grams(raw, offsets)
                key, count = np.unique(doc * BUCKETS + bucket, return_counts=True)
                bounds = np.searchsorted(key, np.arange(last - first + 1) * BUCKETS)
                sizes = np.bincount(doc, minlength=last - first)
                idx = [(key[a:b] % BUCKETS).astype(np.uint16).tobytes() for a, b in zip(bounds, bounds[1:])]
                val = [(count[a:b] / max(s, 1)).astype(np.float32).tobytes() for a, b, s in zip(bounds, bounds[1:], sizes)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(first, last - first) for k in (1, 2, 3)), pa.array(idx, pa.binary()), pa.array(val, pa.binary())],
                    names=["h", "lang", "fold", "idx", "val"],
                )

    fold = F.pmod(F.xxhash64("h", F.lit(11)), F.lit(CALIBRATION_SHARE)).cast("int").alias("fold")
    rows = docs.select("text", "h", "lang", fold).mapInArrow(run, "h long, lang string, fold int, idx binary, val binary")
    # The hard bounds, by hash within each language; the sample is small by now, so a language is a group that fits.
    within = Window.partitionBy("lang").orderBy("h")
    size = F.sum(F.length("idx") + F.length("val")).over(within)
    rows = rows.withColumn("k", F.row_number().over(within)).withColumn("size", size)
    kinds = max(1, docs.select("lang").distinct().count())
    rows = rows.where((F.col("k") <= max(1, SAMPLE_TOTAL // kinds)) & ((F.col("size") <= SAMPLE_BYTES // kinds) | (F.col("k") == 1))).drop("k", "size").collect()
    return sorted(rows, key=lambda r: (r["h"], r["lang"], bytes(r["idx"])))


def fit_ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], k: int, epochs: int = EPOCHS, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal with elastic net for a softmax of k classes; rows are (class, buckets, values)."""
    z, n = np.zeros((BUCKETS, k)), np.zeros((BUCKETS, k))
    zb, nb = np.zeros(k), np.zeros(k)

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            y, idx, val = rows[i]
            zi, ni = z[idx], n[idx]
            w, wb = weights(zi, ni), weights(zb, nb)
            s = val @ w + wb
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = val[:, None] * p[None]
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[idx] += g - sigma * w
            n[idx] += g * g
            sb = (np.sqrt(nb + p * p) - np.sqrt(nb)) / ALPHA
            zb += p - sb * wb
            nb += p * p
    return weights(z, n), weights(zb, nb)


def fit_temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, by golden section on its logarithm."""
    if not len(y):
        return 1.0

    def loss(log_t: float) -> float:
        s = scores / np.exp(log_t)
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).mean())

    a, b, r = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def train_language_model(train: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel | None:
    """Fit on rows with text and lang; null langs and null texts are left out.  None if nothing is left."""
    train = train.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    n, df = document_frequencies(train)
    if not n:
        return None
    idf = np.log((1 + n) / (1 + df)) + 1
    rows = sparse_counts(cut(sample_documents(train, per_language)))
    labels = sorted({r["lang"] for r in rows})
    fit, keep = [], []
    for r in rows:
        idx = np.frombuffer(bytes(r["idx"]), np.uint16).astype(np.int64)
        val = np.frombuffer(bytes(r["val"]), np.float32).astype(float) * idf[idx]
        (keep if r["fold"] == 0 else fit).append((labels.index(r["lang"]), idx, val))
    fit = fit or keep
    if not labels:
        return None
    w, b = fit_ftrl(fit, len(labels))
    scores = np.array([v @ w[i] + b for _, i, v in keep]).reshape(-1, len(labels))
    t = fit_temperature(scores, np.array([y for y, _, _ in keep], int))
    return LanguageModel(labels, w * idf[:, None], b, t)


def predict_languages(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """``doc_id, lang_pred, score`` per row; ``und`` with score 0 for a text that is null or without a letter.

    Repeated rows are predicted alike; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    labels = np.array(model.labels if model else ["und"], object)
    w = (model.weights if model else np.zeros((BUCKETS, 1))).astype(np.float32)
    bias, temperature = (model.bias, model.temperature) if model else (np.zeros(1), 1.0)
    used = np.flatnonzero(np.abs(w).sum(1) > 0)  # the elastic net leaves many rows empty
    packed = docs.sparkSession.sparkContext.broadcast((used.astype(np.uint32), w[used]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((BUCKETS, len(labels)), np.float32)
        table[packed.value[0]] = packed.value[1]
        for batch in batches:
            texts = batch.column(1)
            for first, last, offsets, raw in text_blocks(texts):
                bucket, doc = grams(raw, offsets)
                size = np.maximum(np.bincount(doc, minlength=last - first), 1)
                s = np.stack([np.bincount(doc, table[bucket, c], minlength=last - first) for c in range(len(labels))], 1)
                s = (s / size[:, None] + bias) / temperature
                p = np.exp(s - s.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                best = p.argmax(1)
                lettered = np.array([bool(x) and LETTER.search(x) is not None for x in texts.slice(first, last - first).to_pylist()], bool)
                pred = np.where(lettered, labels[best], "und")
                score = np.where(lettered, np.clip(p[np.arange(len(best)), best], 0.0, 1.0), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; a quarter of them is held out of all learning."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    model = train_language_model(docs.where(~F.coalesce(held, F.lit(False))))
    out = predict_languages(docs, model)
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")
