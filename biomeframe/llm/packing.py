"""Best-fit packing: few-document length patterns fitted to the length histogram by NNLS.

1. Every document is tokenised (in Arrow batches) and cut into pieces of at most ``capacity`` ids.
2. Only the histogram of piece lengths (at most ``capacity`` numbers) reaches the driver.
   Patterns of two to four lengths that nearly fill a sequence are enumerated from it, their repeat
   counts are fitted by non-negative least squares, rounded, and the residual lengths are packed
   by best-fit decreasing over groups of equally full sequences.  The plan is a list of runs
   whose size does not depend on the number of documents.
3. Pieces find their place by their rank among pieces of their length.  Ranks come from counts per
   (bucket, length) and a row number inside the bucket, so a length that holds a third
   of all pieces is still dealt over all tasks.
"""

from __future__ import annotations

import base64
import bisect
import json
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ._spark import cut, prepare

CAPACITY = 1024
END_ID = 2
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pieces per bucket of the ranking step, where that makes more buckets than there are shuffle partitions.
BUCKET_PIECES = 50_000

#: Patterns that leave more than one id in so many free are left to best fit.
WASTE = 512

PIECES = "piece int, start long, length long, ids_crc32 long"


def load_encoder(path: str | None = None, added: dict[str, int] | None = None):
    """The byte-level BPE of the public vocabulary file; ``path`` overrides the installed one.

    The ranks file holds the same vocabulary as the JSON tokenizer and gives the same ids about
    four times as fast.  ``added`` are the special tokens; without them their strings are ordinary text.
    """
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added or {})


def load_tokenizer(path: str | None = None) -> Callable[[str], np.ndarray]:
    """Ids of a text as the JSON tokenizer gives them, with its added tokens matched in the text.

    The JSON file lies beside the ranks file, under the same name; where there is none, no tokens are added.
    """
    import public_tokenizers

    beside = os.path.splitext(path or public_tokenizers.path(VOCABULARY))[0] + ".json"
    added = {}
    if os.path.exists(beside):
        with open(beside, encoding="utf-8") as f:
            added = {t["content"]: t["id"] for t in json.load(f).get("added_tokens", [])}
    encoder = load_encoder(path, added)
    return lambda text: encoder.encode_to_numpy(text, allowed_special="all")


def _pieces(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of n ids; the first may be shorter."""
    first = n % capacity or capacity
    yield 0, min(first, n)
    yield from ((s, capacity) for s in range(first, n, capacity))


def tokenize_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Pieces of each document: doc_id, piece, start, length, ids_crc32 and, on request, the ids.

    A null or empty text gives the end id alone.  Repeated rows give repeated pieces; ids of any type are kept as they are.
    """
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {PIECES}" + (", ids array<int>" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_tokenizer(path)
        for batch in batches:
            doc, piece, start, length, crc, kept = [], [], [], [], [], []
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                ids = np.append(encode(text).astype("<u4") if text else np.zeros(0, "<u4"), np.uint32(end_id))
                for k, (s, n) in enumerate(_pieces(len(ids), capacity)):
                    doc.append(d)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(ids[s : s + n].tobytes()))
                    if keep_ids:
                        kept.append(ids[s : s + n].astype(np.int32))
            columns = [pa.array(doc, batch.schema.field(0).type), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            if keep_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def enumerate_patterns(hist: np.ndarray, capacity: int) -> list[tuple[int, ...]]:
    """Patterns of one to four present lengths that leave at most one id in ``1 / WASTE`` free."""
    present = np.flatnonzero(hist[: capacity + 1]).tolist()

    def at_most(x: int) -> int | None:
        k = bisect.bisect_right(present, x)
        return present[k - 1] if k else None

    found: set[tuple[int, ...]] = set()
    for a in present:
        if a == capacity:
            found.add((a,))
            continue
        rest = capacity - a
        if (b := at_most(rest)) is None:
            found.add((a,))
            continue
        found.add(tuple(sorted((a, b), reverse=True)))
        for part in (2, 3, 4, 8):
            if (b := at_most(rest // part)) is not None and (c := at_most(rest - b)) is not None:
                found.add(tuple(sorted((a, b, c), reverse=True)))
        if (b := at_most(rest // 3)) is not None and (c := at_most((rest - b) // 2)) is not None and (d := at_most(rest - b - c)) is not None:
            found.add(tuple(sorted((a, b, c, d), reverse=True)))
    return sorted((p for p in found if (capacity - sum(p)) * WASTE <= capacity), key=lambda p: (capacity - sum(p), len(p), p))


def fit_nnls(patterns: list[tuple[int, ...]], hist: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """Repeat counts x >= 0 with least ``|A x - hist|``, by cyclic coordinate descent."""
    columns = [tuple({length: p.count(length) for length in p}.items()) for p in patterns]
    norms = [float(sum(m * m for _, m in c)) for c in columns]
    x, r = [0.0] * len(columns), hist.astype(float).tolist()
    for _ in range(sweeps):
        moved = 0.0
        for j, c in enumerate(columns):
            step = sum(m * r[i] for i, m in c) / norms[j]
            if step < -x[j]:
                step = -x[j]
            if step:
                x[j] += step
                for i, m in c:
                    r[i] -= m * step
                moved = max(moved, abs(step))
        if moved < 0.25:
            break
    return np.array(x)


def plan_sequences(hist: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, past last rank, first sequence, offset): the piece with rank r of
    that length lies in sequence ``first sequence + r - first rank`` at that offset."""
    left = hist.astype(np.int64).copy()
    used = np.zeros_like(left)  # ranks given out, by length
    runs: list[tuple[int, int, int, int, int]] = []
    sequences = 0
    room: dict[int, list[tuple[int, int]]] = {}  # free ids -> [(first sequence, number)]

    def take(length: int, number: int, sequence: int, offset: int) -> None:
        runs.append((length, int(used[length]), int(used[length]) + number, sequence, offset))
        used[length] += number
        left[length] -= number

    patterns = enumerate_patterns(left, capacity)
    x = fit_nnls(patterns, left)
    for j in sorted(range(len(patterns)), key=lambda j: (capacity - sum(patterns[j]), -x[j], j)):
        pattern = patterns[j]
        n = min(int(x[j] + 0.5), *(int(left[i]) // pattern.count(i) for i in set(pattern)), 1 << 62)
        if n <= 0:
            continue
        offset = 0
        for length in pattern:
            take(length, n, sequences, offset)
            offset += length
        if offset < capacity:
            room.setdefault(capacity - offset, []).append((sequences, n))
        sequences += n
    free = sorted(room)
    for length in range(capacity, 0, -1):
        while (need := int(left[length])) > 0:
            k = bisect.bisect_left(free, length)
            if k == len(free):
                per = capacity // length
                n, extra = divmod(need, per)
                for count, number in ((per, n), (extra, 1 if extra else 0)):
                    if number:
                        for i in range(count):
                            take(length, number, sequences, i * length)
                        _open(room, free, capacity - count * length, sequences, number)
                        sequences += number
                continue
            size = free[k]
            sequence, number = room[size].pop()
            if not room[size]:
                del room[size]
                free.pop(k)
            n = min(number, need)
            take(length, n, sequence, capacity - size)
            if n < number:
                _open(room, free, size, sequence + n, number - n)
            _open(room, free, size - length, sequence, n)
    return runs


def _open(room: dict, free: list, size: int, sequence: int, number: int) -> None:
    if size > 0:
        if size not in room:
            bisect.insort(free, size)
        room.setdefault(size, []).append((sequence, number))


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (columns doc_id, piece, length and any others).

    Every piece is placed exactly once; offsets in a sequence are gapless from 0.  Equal rows are
    separate pieces.  An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    hist = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        hist[length] = n
    runs = sorted(plan_sequences(hist, capacity))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(hist.sum()) // BUCKET_PIECES)
    marked = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = marked.groupBy("_bucket", "length").agg(F.count(F.lit(1)).alias("_n"))
    base = per.select("_bucket", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    local = F.row_number().over(Window.partitionBy("_bucket", "length").orderBy("doc_id", "piece"))
    ranked = marked.withColumn("_local", local).join(base, ["_bucket", "length"])
    ranked = ranked.withColumn("_rank", F.col("_base") + F.col("_local") - 1)
    table = np.array(runs, np.int64).reshape(-1, 5)
    starts = np.searchsorted(table[:, 0], np.arange(capacity + 2))

    @F.pandas_udf(T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    def place(length, rank):
        import pandas as pd

        length, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        out = np.zeros((2, len(rank)), np.int64)
        for value in np.unique(length):
            own, mine = table[starts[value] : starts[value + 1]], length == value
            k = np.searchsorted(own[:, 1], rank[mine], "right") - 1
            out[0, mine] = own[k, 3] + rank[mine] - own[k, 1]
            out[1, mine] = own[k, 4]
        return pd.DataFrame({"sequence_id": out[0], "offset": out[1]})

    ranked = ranked.withColumn("_at", place("length", "_rank"))
    return ranked.select(*pieces.columns, "_at.sequence_id", "_at.offset")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack documents: doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset."""
    prepare(docs.sparkSession)
    return pack_pieces(cut(tokenize_pieces(docs, capacity, END_ID, path, keep_ids)), capacity)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 ids."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
