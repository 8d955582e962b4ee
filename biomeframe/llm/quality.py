"""Quality rules with line sequence labelling.

Each line of a text gets shape features; a linear-chain conditional random field with the labels
content and boilerplate is decoded by Viterbi, and the share of words on content lines decides
whether a document stays.  Plain base rules (too few words, too many repeated ones) come first.

The field's weights are fitted here, on the lines of a bounded sample of labelled documents
(``SAMPLE_PER_CLASS`` of each quality label, ``SAMPLE_LINES`` lines of each); scoring covers every line of every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import cut, prepare
from ._text import NON_SPACE, Block, blocks, cover, mix, per_doc

SAMPLE_PER_CLASS = 1000
#: Lines of a sampled document that take part in fitting.
SAMPLE_LINES = 1000
MIN_CONTENT_SHARE = 0.5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
REPEAT_WINDOW = 5
FEATURES = ("bias", "length", "symbols", "upper", "digits", "exclaim", "repeats", "sentence_end", "short", "word_length", "seen_before")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_LEAD = np.ones(256, bool)
_LEAD[0x80:0xC0] = False
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0xC0:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".?:;,"]] = True


@dataclass
class Field:
    """Weights of the field: emission (features x 2), transition (2 x 2), start (2).  Label 1 is content."""

    emission: np.ndarray
    transition: np.ndarray
    start: np.ndarray

    @staticmethod
    def neutral() -> Field:
        """All lines are content; used where no labelled documents of both kinds exist."""
        emission = np.zeros((len(FEATURES), 2))
        emission[0, 1] = 1.0
        return Field(emission, np.zeros((2, 2)), np.zeros(2))


@dataclass
class Lines:
    """Lines with a word, in order: bounds per document, words per line, features."""

    first: np.ndarray  # first line of each document, len n + 1
    words: np.ndarray
    duplicate: np.ndarray
    features: np.ndarray


def lines_of(b: Block) -> Lines:
    raw, n = b.raw, b.n
    newline = np.flatnonzero(raw == 10)
    # a line starts at each document's start and after each newline inside it
    starts = np.sort(np.concatenate([b.offsets[:-1], newline + 1]), kind="stable")
    # the last document's end bounds its last line; a newline at a document's end starts an empty line
    doc = np.searchsorted(b.offsets[:-1], starts, "right") - 1
    nexts = np.append(starts[1:], len(raw))
    ends = np.minimum(nexts, b.offsets[doc + 1])
    stop = ends - ((ends > starts) & (ends > 0) & (raw[np.maximum(ends - 1, 0)] == 10)) if len(raw) else ends
    wfirst, wlast = np.searchsorted(b.starts, starts), np.searchsorted(b.starts, stop)
    keep = wlast > wfirst
    starts, stop, doc, wfirst, wlast = starts[keep], stop[keep], doc[keep], wfirst[keep], wlast[keep]
    words = wlast - wfirst
    key = mix(b.span_hash(starts, stop) ^ mix(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    duplicate = np.zeros(len(key), bool)
    duplicate[order[1:]] = key[order[1:]] == key[order[:-1]]

    def count(table: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(raw) + 1, np.int32)
        np.cumsum(table[raw], out=sums[1:])
        return (sums[stop] - sums[starts]).astype(float)

    letters = np.maximum(count(_LETTER), 1.0)
    same = np.zeros(len(b.words) + 1, np.int64)
    if len(b.words):
        np.cumsum(np.append(False, b.words[1:] == b.words[:-1]), out=same[1:])
    repeats = (same[wlast] - same[wfirst + 1]) / words if len(words) else np.zeros(0)
    exclaim = np.zeros(256, bool)
    exclaim[33] = True
    last = raw[b.ends[wlast - 1] - 1] if len(words) else np.zeros(0, np.uint8)
    features = np.stack(
        [
            np.ones(len(words)),
            np.log1p(words) / 5,
            np.minimum(count(_SYMBOL) / np.maximum(words, 1), 2.0),
            count(_UPPER) / letters,
            count(_DIGIT) / letters,
            np.minimum(count(exclaim) / np.maximum(words, 1), 2.0),
            repeats,
            _END[last].astype(float),
            (words < 5).astype(float),
            np.minimum(letters / np.maximum(words, 1) / 10, 2.0),
            duplicate.astype(float),
        ],
        axis=1,
    )
    return Lines(np.searchsorted(doc, np.arange(n + 1)), words, duplicate, features)


def viterbi(scores: np.ndarray, first: np.ndarray, field: Field) -> np.ndarray:
    """Best label of each line; ``scores`` (lines x 2), documents' bounds ``first``.

    Documents advance together, one line at a time; ties go to content.
    """
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    counts, base = counts[order], first[:-1][order]
    labels = np.ones(len(scores), np.int8)
    live = int(np.searchsorted(-counts, 0, "left"))
    if not live:
        return labels
    value = scores[base[:live]] + field.start
    back: list[np.ndarray] = []
    lives = [live]
    values = [value]
    for t in range(1, int(counts[0])):
        live = int(np.searchsorted(-counts, -t, "left"))
        cand = value[:live, :, None] + field.transition[None]
        choice = (cand[:, 1] >= cand[:, 0]).astype(np.int8)
        value = np.maximum(cand[:, 0], cand[:, 1]) + scores[base[:live] + t]
        back.append(choice)
        lives.append(live)
        values.append(value)
    state = np.zeros(0, np.int8)
    for t in range(len(lives) - 1, -1, -1):
        live, value = lives[t], values[t]
        ended = slice(len(state), live)  # documents whose last line is t
        now = np.empty(live, np.int8)
        if t < len(back) and len(state):
            now[: len(state)] = back[t][np.arange(len(state)), state]
        now[ended] = value[ended, 1] >= value[ended, 0]
        labels[base[:live] + t] = now
        state = now
    return labels


def fit_field(sequences: list[np.ndarray], labels: list[int], steps: int = 200, l2: float = 1e-3, longest: int = 64) -> Field:
    """Maximum likelihood by forward-backward and Adam; each sequence's lines share its label.

    Sequences are cut into runs of at most ``longest`` lines for fitting only.
    """
    runs = [(s[i : i + longest], y) for s, y in zip(sequences, labels) for i in range(0, len(s), longest)]
    if len({y for _, y in runs}) < 2:
        return Field.neutral()
    runs.sort(key=lambda r: -len(r[0]))
    n, k = len(runs), len(FEATURES)
    # Lines lie by their place in the run, longest run first: those at place t are a slice, those before them its head.
    live = [int(sum(len(s) > t for s, _ in runs)) for t in range(len(runs[0][0]))]
    at = np.concatenate([[0], np.cumsum(live)])
    x = np.concatenate([np.stack([runs[i][0][t] for i in range(m)]) for t, m in enumerate(live)])
    run = np.concatenate([np.arange(m) for m in live])
    y = np.array([y for _, y in runs])[run]
    last = at[[len(s) - 1 for s, _ in runs]] + np.arange(n)
    later = np.arange(n, at[-1])  # lines with one before them
    before = np.concatenate([at[t] + np.arange(m) for t, m in enumerate(live[1:])] or [np.zeros(0, np.int64)])
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    theta = np.zeros(2 * k + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    want = np.eye(2)[y]
    for step in range(1, steps + 1):
        w, trans, start = theta[: 2 * k].reshape(k, 2), theta[2 * k : 2 * k + 4].reshape(2, 2), theta[2 * k + 4 :]
        e = x @ w
        alpha, beta = e.copy(), np.zeros_like(e)
        alpha[:n] += start
        for t in range(1, len(live)):
            prev, now = slice(at[t - 1], at[t - 1] + live[t]), slice(at[t], at[t + 1])
            alpha[now] += np.logaddexp(alpha[prev, 0, None] + trans[0], alpha[prev, 1, None] + trans[1])
        for t in range(len(live) - 1, 0, -1):
            prev, now = slice(at[t - 1], at[t - 1] + live[t]), slice(at[t], at[t + 1])
            nxt = e[now] + beta[now]
            beta[prev] = np.logaddexp(trans[:, 0] + nxt[:, 0, None], trans[:, 1] + nxt[:, 1, None])
        logz = np.logaddexp(alpha[last, 0], alpha[last, 1])[run]
        p = np.exp(np.minimum(alpha + beta - logz[:, None], 0))
        diff = (want - p) * weight[:, None]
        gw = x.T @ diff
        onward = e[later] + beta[later] - logz[later, None]
        joint = np.exp(np.minimum(alpha[before][:, :, None] + trans + onward[:, None], 0))
        pair = want[before][:, :, None] * want[later][:, None]
        gt = ((pair - joint) * weight[later, None, None]).sum(0)
        gs = diff[:n].sum(0)
        g = np.concatenate([gw.ravel(), gt.ravel(), gs]) - l2 * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(theta[: 2 * k].reshape(k, 2), theta[2 * k : 2 * k + 4].reshape(2, 2), theta[2 * k + 4 :])


def train_field(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Field:
    """Fit on lines of at most ``per_class`` documents of each quality label, chosen by hash.

    Rows with null doc_id or quality are no labels; without both labels the neutral field results.  The bounds hold
    for documents that share an id too: of these, again, at most ``per_class`` go in, and equal ones once.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    known = labels.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast(kind).alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("quality") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.union(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(0), NON_SPACE, False):
                ls = lines_of(b)
                ends = np.minimum(ls.first[1:], ls.first[:-1] + SAMPLE_LINES)
                rows = [ls.features[x:y].astype(np.float32).tobytes() for x, y in zip(ls.first, ends)]
                columns = [batch.column(k).slice(b.first, b.n) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, pa.binary())], names=["quality", "h", "features"])

    joined = docs.select("doc_id", "text").join(F.broadcast(chosen.distinct()), "doc_id").select("text", "quality", F.xxhash64("doc_id", "text").alias("h"))
    found = cut(joined.dropDuplicates(["quality", "h"]).mapInArrow(run, "quality int, h long, features binary"))
    rows = [r for y in (0, 1) for r in found.where(F.col("quality") == y).orderBy("h").limit(per_class).collect()]
    seqs = [np.frombuffer(bytes(r["features"]), np.float32).reshape(-1, len(FEATURES)).astype(float) for r in rows]
    keep = [i for i, s in enumerate(seqs) if len(s)]
    return fit_field([seqs[i] for i in keep], [rows[i]["quality"] for i in keep])


METRICS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content_words long, base_failed boolean, kept boolean"
)


def measure(b: Block, field: Field, share: float = MIN_CONTENT_SHARE) -> dict[str, np.ndarray]:
    """All metrics of the documents of a block."""
    n = b.counts
    chars = per_doc((NON_SPACE & _LEAD)[b.raw], b.offsets)
    symbols = per_doc(_SYMBOL[b.raw], b.offsets)
    ls = lines_of(b)
    dup = per_doc(ls.duplicate, ls.first)
    at, h = b.windows(REPEAT_WINDOW)
    doc = b.doc_of_word()
    key = mix(h ^ mix(doc[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    repeat = per_doc(cover(at[twice], REPEAT_WINDOW, len(b.words)), b.wfirst)
    label = viterbi(ls.features @ field.emission, ls.first, field)
    content = per_doc(np.where(label == 1, ls.words, 0), ls.first)
    failed = (n < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n)
    kept = ~failed & (content >= share * n)
    return {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat, "content_words": content, "base_failed": failed, "kept": kept}


def score_quality(docs: DataFrame, field: Field, share: float = MIN_CONTENT_SHARE, carry: list[str] | None = None) -> DataFrame:
    """``row`` (a struct of the carried columns of docs, all by default) and the metrics, one row per input row.

    A null or empty text has no words and fails the base rules.  Repeated rows are scored alike;
    other columns, of whatever name, stay inside ``row``.
    """
    prepare(docs.sparkSession)
    carry = docs.columns if carry is None else carry
    row = F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row")
    source = docs.select(row) if "text" in carry else docs.select(row, F.col("text").alias("text"))
    schema = T.StructType([T.StructField("row", source.schema["row"].dataType, False), *T._parse_datatype_string(METRICS).fields])
    place = carry.index("text") if "text" in carry else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0)
            for b in blocks(batch.column(1) if place is None else row.field(place), NON_SPACE, False):
                got = measure(b, field, share)
                yield pa.RecordBatch.from_arrays([row.slice(b.first, b.n), *(pa.array(v) for v in got.values())], names=["row", *got])

    return source.mapInArrow(run, schema)


def filter_quality(docs: DataFrame, field: Field) -> DataFrame:
    """The documents that stay, with their columns."""
    return score_quality(docs, field).where("kept").select("row.*")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base metrics and the field's verdict for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    prepare(spark)
    field = train_field(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score_quality(docs, field, carry=["doc_id"])
    return out.select("row.doc_id", *(c for c in out.columns if c != "row"))
