"""Substring de-duplication by prefix-partitioned suffix trees.

A repeat is a sequence of ``window`` words that also starts in a document with a smaller doc_id.

1. Copies of a whole document are settled by a hash of their words; one document of each class goes on.
2. Anchors: of each window the least k-gram (leftmost of equals), so equal windows have equal anchors at equal
   places.  Suffixes are grouped by their anchor; an anchor seen in one document only is done.
   Occurrences with equal surroundings (all words that a window around the anchor can reach) are settled
   by an aggregation: everything there also starts in the least document of that class.
3. Prefixes have variable length: the group of an anchor with more than ``GROUP`` different surroundings is split by longer
   ones, step by step until a group fits: the anchor and what follows, to twice and then four times its length, for the windows
   that reach so far; for the other windows, which then begin well before the anchor, their words before it.  Groups
   in one document are done.  Windows of groups that no such prefix makes small are settled by their whole words, in an aggregation.
4. Of each group's different surroundings the least document's one goes into the group's subtree: the
   suffixes of all windows around the anchor, sorted by their words in blocks.
   Neighbours' common prefixes give the internal nodes.  Below a node of depth ``window`` or more, each leaf repeats the
   least document's leaf over their common prefix, however far it goes: with the leaves before the anchor that do so too,
   this is a maximal repeat within the surroundings, and it is removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import cut, prepare, small
from ._text import NON_SPACE, blocks, cover, minimizers, mix, signed, span_of, window_sums

WINDOW = 50
GRAM = 8
#: Different surroundings of an anchor that one in-memory subtree takes; each is at most 2 * window words.
GROUP = 4096
BLOCK_WORDS = 8
#: Documents with ranges that may be broadcast to the documents, if they take few bytes too; beyond it texts are shuffled.
BROADCAST_DOCS = 250_000


def anchors_of_documents(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``doc_id, h, n_words, anchors array<struct<a, c, pos, left, right>>`` per row.

    ``h`` hashes all words, ``a`` the anchor's k-gram, ``c`` its surroundings.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(1), NON_SPACE, False):
                sums, n = window_sums(b.words), len(b.words)
                values = np.full(n, np.iinfo(np.uint64).max, np.uint64)
                if n >= gram:
                    at = np.arange(n - gram + 1)
                    values[: n - gram + 1] = span_of(sums, at, at + gram)
                places = minimizers(values, b.wfirst, gram, window - gram + 1)
                doc = np.searchsorted(b.wfirst, places, "right") - 1
                left = np.minimum(places - b.wfirst[doc], window - gram)
                right = np.minimum(b.wfirst[doc + 1] - places, window)
                around = mix(span_of(sums, places - left, places + right) ^ mix(left.astype(np.uint64) * np.uint64(1 << 20) + right.astype(np.uint64)))
                struct = pa.StructArray.from_arrays(
                    [pa.array(signed(values[places])), pa.array(signed(around)), *(pa.array(x, pa.int32()) for x in (places - b.wfirst[doc], left, right))],
                    names=["a", "c", "pos", "left", "right"],
                )
                bounds = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=b.n))])
                whole = span_of(sums, b.wfirst[:-1], b.wfirst[1:])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(b.first, b.n), pa.array(signed(whole)), pa.array(b.counts), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), struct)],
                    names=["doc_id", "h", "n_words", "anchors"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, h long, n_words long, anchors array<struct<a:bigint,c:bigint,pos:int,left:int,right:int>>")


def _steps(window: int, gram: int) -> list[tuple[str, int, int, int, int]]:
    """``(name, before, after, first o, last o)`` of the longer prefixes: words around the anchor that all windows starting
    ``o`` words before it, for these o, hold."""
    one, two = min(2 * gram, window), min(4 * gram, window)
    steps = [("k0", 0, one, 0, window - one), ("k1", window - one + 1, gram, window - one + 1, window - gram)]
    return [*steps, ("k00", 0, two, 0, window - two), ("k01", window - two + 1, one, window - two + 1, window - one)]


#: What is wanted of a document travels as flat arrays: the anchors, their places, and four numbers up to the window in a long.
_FOUR = ("left", "right", "low", "high")
_BITS = 15
_OUT = {
    "words": "a long, pos int, left int, right int, low int, high int, words binary",
    "keys": "a long, pos int, left int, right int, k0 long, c0 long, k1 long, c1 long, k00 long, c00 long, k01 long, c01 long",
    "windows": "a long, fp long, s int",
}


def _surroundings(docs: DataFrame, wanted: DataFrame, window: int, mode: str, gram: int = GRAM) -> DataFrame:
    """For the wanted anchors of each document: the words (as hashes) around them, or the keys of their longer prefixes
    (0 for none) with hashes of all words that their windows reach, or one row per window; with doc_id and h."""
    steps = _steps(window, gram)
    schema = _OUT[mode] + ", doc_id long, h long"
    names = [x.split()[0] for x in schema.split(", ")]

    def rows(b, i: int, want: dict[str, np.ndarray], sums: np.ndarray) -> list:
        a, pos = want["a"], want["pos"]
        left, right, low, high = ((want["four"] >> (_BITS * k)) & ((1 << _BITS) - 1) for k in range(4))
        at = b.wfirst[i] + pos
        if mode == "windows":
            o = np.arange(int(high.max()) + 1)[None]
            k, o = np.nonzero((o >= low[:, None]) & (o <= np.minimum(left, high)[:, None]) & (window - o <= right[:, None]))
            start = at[k] - o
            return [a[k], signed(mix(span_of(sums, start, start + window) ^ mix(o.astype(np.uint64)))), start - b.wfirst[i]]
        if mode == "keys":
            keys = []
            for _, before, after, first, last in steps:
                has = (left >= before) & (right >= after) & (first <= last)
                key = np.zeros(len(a), np.int64)
                key[has] = signed(span_of(sums, at[has] - before, at[has] + after))
                l, r = np.minimum(left, last), np.minimum(right, window - first)
                keys += [key, signed(mix(span_of(sums, at - l, at + r) ^ mix(((l << 20) + r).astype(np.uint64))))]
            return [a, pos, left, right, *keys]
        left, right = np.minimum(left, high), np.minimum(right, window - low)
        return [a, pos, left, right, low, high, [b.words[p - x : p + y].tobytes() for p, x, y in zip(at, left, right)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch.column(0), batch.column(2).to_numpy()
            for b in blocks(batch.column(1), NON_SPACE, False):
                sums = window_sums(b.words)
                whole = signed(span_of(sums, b.wfirst[:-1], b.wfirst[1:]))
                out: list[list] = [[] for _ in names]
                for i in np.flatnonzero(whole == hashes[b.first : b.last]):
                    want = {k: batch.column(j)[int(b.first + i)].values.to_numpy(zero_copy_only=False).astype(np.int64) for j, k in ((3, "a"), (4, "pos"), (5, "four"))}
                    cols = rows(b, i, want, sums)
                    n = len(cols[0])
                    for to, x in zip(out, [*cols, np.full(n, ids[int(b.first + i)].as_py()), np.full(n, whole[i])]):
                        to.append(x)
                flat = [[w for x in out[k] for w in x] if f.name == "words" else (np.concatenate(out[k]) if out[k] else np.zeros(0, np.int64)) for k, f in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(flat, kinds)], names=names)

    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    kinds = [pa.field(x.split()[0], types[x.split()[1]]) for x in schema.split(", ")]
    four = sum((F.shiftleft(F.col(c).cast("long"), _BITS * k) for k, c in enumerate(_FOUR)), F.lit(0).cast("long"))
    lists = wanted.groupBy("doc_id", "h").agg(F.collect_list(F.struct("a", F.col("pos").cast("int").alias("pos"), four.alias("four"))).alias("w"))
    lists = cut(lists.select("doc_id", "h", "w.a", "w.pos", "w.four"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.join(small(lists, BROADCAST_DOCS), "doc_id").select("doc_id", "text", "h", "a", "pos", "four").mapInArrow(run, schema)


def subtree_repeats(
    group: np.ndarray, doc: np.ndarray, left: np.ndarray, right: np.ndarray, words: list[np.ndarray], window: int = WINDOW, low: np.ndarray | None = None, high: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The subtrees of some groups, all at once: (row, offset before the anchor, depth) of each leaf to remove.

    Row r holds ``words[r]`` around its anchor, ``left[r]`` of them before it.  A suffix starts ``o`` words before the
    anchor (from low[r] to high[r]); suffixes of one subtree are those with equal group and equal ``o``.  Depth is the length
    of the prefix that the leaf shares with its node's leaf in the least document, within the surroundings.
    """
    low = np.zeros_like(left) if low is None else low
    high = left if high is None else np.minimum(left, high)
    o = np.arange(int(left.max()) + 1)[None]
    row, o = np.nonzero((o >= low[:, None]) & (o <= high[:, None]) & (window - o <= right[:, None]))
    if not len(row):
        return row, o, o
    flat = np.concatenate(words)
    base = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    start, end = base[row] + left[row] - o, base[row + 1]
    sums = window_sums(flat)
    cuts = [*range(0, window, BLOCK_WORDS), window]
    edges = [span_of(sums, start + a, start + b) for a, b in zip(cuts, cuts[1:])]  # the words along each suffix, in blocks
    order = np.lexsort([doc[row], *reversed(edges), o, group[row]])
    deep = (group[row][order[1:]] == group[row][order[:-1]]) & (o[order[1:]] == o[order[:-1]])
    for e in edges:
        deep &= e[order[1:]] == e[order[:-1]]
    first = np.concatenate([[True], ~deep])  # leaves below one deep node are neighbours, sorted by document
    node = np.cumsum(first) - 1
    least = order[np.flatnonzero(first)][node]
    gone = doc[row][order] > doc[row][least]
    leaf, other = order[gone], least[gone]
    depth = np.full(len(leaf), window)
    going = np.arange(len(leaf))
    while len(going):
        x, y = start[leaf[going]] + depth[going], start[other[going]] + depth[going]
        ok = (x < end[leaf[going]]) & (y < end[other[going]])
        ok[ok] = flat[x[ok]] == flat[y[ok]]
        going = going[ok]
        depth[going] += 1
    return row[leaf], o[leaf], depth


def _subtrees(surroundings: DataFrame, window: int) -> DataFrame:
    """Ranges ``doc_id, h, s, e`` removed by the subtrees; rows of one group arrive together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush(table: pa.Table) -> Iterator[pa.RecordBatch]:
            a, pos, left, right, low, high, doc, h = (table.column(c).to_numpy().astype(np.int64) for c in ("a", "pos", "left", "right", "low", "high", "doc_id", "h"))
            words = [np.frombuffer(w.as_buffer(), np.uint64) for w in table.column("words")]
            row, o, depth = subtree_repeats(a, doc, left, right, words, window, low, high)
            if not len(row):
                return
            order = np.lexsort([-o, row])
            row, s, depth = row[order], pos[row[order]] - o[order], depth[order]
            first = np.concatenate([[True], (row[1:] != row[:-1]) | (s[1:] != s[:-1] + 1)])
            k = np.flatnonzero(first)
            end = np.maximum.reduceat(s + depth, k)  # suffixes one word apart are one repeat
            yield pa.RecordBatch.from_arrays([pa.array(doc[row[k]]), pa.array(h[row[k]]), pa.array(s[k], pa.int32()), pa.array(end, pa.int32())], names=["doc_id", "h", "s", "e"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size < 4000:
                continue
            table = pa.Table.from_batches(held)
            a = table.column("a").to_numpy()
            end = int(np.flatnonzero(a != a[-1])[-1]) + 1 if (a != a[-1]).any() else 0  # the last anchor may go on
            if end:
                yield from flush(table.slice(0, end))
            held = table.slice(end).to_batches()
            size = table.num_rows - end
        if held:
            yield from flush(pa.Table.from_batches(held))

    n = max(1, int(surroundings.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return surroundings.repartition(n, "a").sortWithinPartitions("a").mapInArrow(run, "doc_id long, h long, s int, e int")


def _lengthen(keyed: DataFrame, window: int, gram: int, group: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of groups that longer prefixes make fit, with the prefix's key as ``a``; rows of those that stay too large; and
    the ranges ``doc_id, h, s, e`` of occurrences whose windows all start in the least document of their class too."""
    columns = ["doc_id", "h", "pos", "left", "right"]
    deeper = ["k00", "c00", "k01", "c01"]
    steps = {name: (first, last) for name, _, _, first, last in _steps(window, gram)}
    out = ["doc_id", "h", "a", "pos", "left", "right", "low", "high"]

    def split(rows: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
        part = lambda n: F.struct(F.lit(n).alias("step"), F.col(n).alias("a"), F.col(f"c{n[1:]}").alias("c"), F.lit(steps[n][0]).alias("low"), F.lit(steps[n][1]).alias("high"))
        rows = rows.withColumn("x", F.explode(F.array(*map(part, names)))).select(*columns, *deeper, "x.*").where("a != 0")
        classes = rows.groupBy("a", "c").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
        sizes = classes.groupBy("a").agg(F.count(F.lit(1)).alias("size"), F.min("least").alias("x"), F.max("most").alias("y")).where("x < y")
        rows = rows.join(small(cut(sizes.select("a", "size"))), "a").join(small(cut(classes.where("least < most").drop("most"))), ["a", "c"], "left")
        start, end = F.col("pos") - F.least("left", "high"), F.col("pos") + F.least("right", F.lit(window) - F.col("low"))
        same = rows.where("doc_id > least").select("doc_id", "h", start.alias("s"), end.alias("e")).where(F.col("e") - F.col("s") >= window)
        first = rows.where("doc_id <= coalesce(least, doc_id) and size > 1")
        return first.where(F.col("size") <= group).select(*out), cut(first.where(F.col("size") > group).select(*out, *deeper, "step")), same

    fits, large, same = split(keyed.drop("a"), ["k0", "k1"])
    more, still, again = split(large.where("step = 'k0'").drop("a", "low", "high", "step"), ["k00", "k01"])
    return fits.unionByName(more), large.where("step != 'k0'").select(*out).unionByName(still.select(*out)), same.unionByName(again)


def find_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """``doc_id, h, s, e``: word ranges of the repeats of each document with words hash ``h``; ranges may overlap.

    Rows with a null doc_id take no part.  Rows that repeat a doc_id are one document as to "smaller": none of
    them repeats another.  Empty tables and texts give no ranges.
    """
    prepare(docs.sparkSession)
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    table = cut(anchors_of_documents(docs, window, gram))
    long = table.where(F.col("n_words") >= window)
    classes = cut(long.groupBy("h", "n_words").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")))
    copies = long.select("doc_id", "h", "n_words").join(small(classes.where("most > least")), ["h", "n_words"]).where("doc_id > least")
    ranges = [copies.select("doc_id", "h", F.lit(0).alias("s"), F.col("n_words").cast("int").alias("e"))]
    firsts = classes.select(F.col("least").alias("doc_id"), "h", "n_words")
    rows = long.join(small(firsts), ["doc_id", "h", "n_words"], "left_semi").select("doc_id", "h", F.explode("anchors").alias("x")).select("doc_id", "h", "x.*").distinct()
    by_class = rows.groupBy("a", "c").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    shared = by_class.groupBy("a").agg(F.count(F.lit(1)).alias("classes"), F.min("least").alias("least"), F.max("most").alias("most"))
    shared = cut(shared.where("most > least").select("a", "classes"))
    rows = cut(rows.join(small(shared), "a"))
    # Cut before the join: both its sides are then plain exchanges, and a passage's large class can be split.
    least = cut(rows.groupBy("a", "c").agg(F.min("doc_id").alias("least")))
    rows = cut(rows.join(small(least), ["a", "c"]))
    same = rows.where("doc_id > least").select("doc_id", "h", (F.col("pos") - F.col("left")).alias("s"), (F.col("pos") + F.col("right")).alias("e"))
    ranges.append(same.where(F.col("e") - F.col("s") >= window))
    apart = rows.where("doc_id = least and classes > 1").select("doc_id", "h", "a", "pos", "left", "right", "classes", F.lit(0).alias("low"), F.col("left").alias("high"))
    fitting = apart.where(F.col("classes") <= group).drop("classes")
    hot = cut(apart.where(F.col("classes") > group).drop("classes"))
    if not hot.isEmpty():
        more, large, same = _lengthen(cut(_surroundings(docs, hot, window, "keys", gram)), window, gram, group)
        fitting = fitting.unionByName(more)
        ranges.append(same)
        if not large.isEmpty():
            suffixes = cut(_surroundings(docs, large, window, "windows"))
            nodes = suffixes.groupBy("a", "fp").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("most > least")
            found = suffixes.join(nodes, ["a", "fp"]).where("doc_id > least")
            ranges.append(found.select("doc_id", "h", "s", (F.col("s") + window).alias("e")))
    ranges.append(_subtrees(_surroundings(docs, fitting, window, "words"), window))
    out = ranges[0]
    for r in ranges[1:]:
        out = out.unionByName(r)
    return out.distinct()


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` per row: the words left, joined by one space.

    Null and empty texts have no words; a row with a null doc_id keeps all its words; further columns are ignored.
    """
    ranges = find_repeats(docs, window, gram, group)
    lists = ranges.groupBy("doc_id").agg(F.collect_list(F.struct("h", F.col("s").cast("int").alias("s"), F.col("e").cast("int").alias("e"))).alias("r"))
    lists = cut(lists.select("doc_id", "r.h", "r.s", "r.e"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small(lists, BROADCAST_DOCS), "doc_id", "left").select("doc_id", "text", "h", "s", "e")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(1), NON_SPACE, False):
                sums = window_sums(b.words)
                whole = signed(span_of(sums, b.wfirst[:-1], b.wfirst[1:]))
                counts = b.counts
                removed = np.zeros(b.n, np.int64)
                kept = []
                for i in range(b.n):
                    words = b.raw[b.offsets[i] : b.offsets[i + 1]].tobytes().split()
                    own = [batch.column(k)[b.first + i].values for k in (2, 3, 4)]
                    if own[0] is not None and len(own[0]):
                        h, s, e = (x.to_numpy(zero_copy_only=False) for x in own)
                        mine = h == whole[i]
                        gone = cover(s[mine].astype(np.int64), (e - s)[mine].astype(np.int64), len(words))
                        removed[i] = gone.sum()
                        words = [words[k] for k in np.flatnonzero(~gone)]
                    kept.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.first, b.n), pa.array(counts), pa.array(removed), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that stay of every document."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
