"""N-gram Jaccard join with set-relation skipping.

The sets are distinct 5-word shingles; two documents link at a similarity of 0.75 or more, and the result
is the least document reachable by links.  Every link between different texts counts.

* Documents with equal sets are one class; its least document stands for it.
* All tokens have one order.  Two sets that reach the threshold share a token among their first
  ``n - ceil(0.75 n) + 1`` ones (prefix filter), whatever the order.  Tokens are first ordered by hash, and the tokens of
  all prefixes are counted; frequent ones go to the end of the order, and those that take their place are counted next.
  The index has, per token, the list of sets with it, sorted by size and annotated with the token's place.
* Index-level skipping: linked sets are found at the latest in the list of their first shared token, and there ``n - pos``
  of either set bounds their overlap, with ``pos`` the token's place in the set's order.  Lists are scanned in blocks by
  size; sets and blocks whose sizes or places allow no link are skipped.  Lists with equal members are scanned once.
* Answer-level skipping: the answers of each list's leader, its most central set (least ``pos``: it has the fewest rare
  tokens), are computed in round 1 and kept as overlaps.  In round 2 the other sets derive theirs from them, incrementally:
  a set that is tied to another already needs no answer about it; otherwise the two overlaps with the leader and the tokens
  outside it bound the overlap of the two from below (a link) and from above (none), and only pairs left open are compared.
* Candidate pairs are refuted by parity bitmaps (the number of differing bits bounds the symmetric difference
  from below) and only then verified exactly on the sets.
* Lists longer than ``LIST_ROWS`` are never gathered in a task: their names, leaders and components come from aggregations,
  and round 2 compares the sets outside the list's largest component with chunks of the list.
* Texts are split into shingles twice: to measure all sets, and to write those of the classes once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import cut, prepare, small
from ._text import NON_SPACE, Block, blocks, buffers, mix, signed, span_of, window_sums
from .components import LOCAL_EDGES, connected_components

SHINGLE = 5
NUM, DEN = 75, 100
#: A token counted in so many prefixes or more goes to the end of the order.
FREQUENT = 8
#: Rounds of counting; a prefix is about a quarter of a set.
ROUNDS = 5
#: Frequent tokens that travel to the tasks; with more, only the most frequent ones are moved to the end, which
#: changes the order of tokens (the same for all sets) but no result.
FREQUENT_TOKENS = 2_000_000
#: Rows of a list held at a time; longer lists are split over tasks.
LIST_ROWS = 1024


def shingle_sets(b: Block, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a block's documents, sorted within each, and their bounds.

    A document with fewer words, but not none, has one shingle of all its words.
    """
    at, h = b.windows(shingle)
    counts = b.counts
    short = (counts > 0) & (counts < shingle)
    sizes = np.where(short, 1, np.maximum(counts - shingle + 1, 0))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(bounds[-1], np.uint64)
    alone = np.zeros(len(out), bool)
    alone[bounds[:-1][short]] = True
    out[~alone] = h
    if short.any():
        out[alone] = span_of(window_sums(b.words), b.wfirst[:-1][short], b.wfirst[1:][short])
    for x, y in zip(bounds.tolist(), bounds[1:].tolist()):
        if y - x > 1:
            out[x:y].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[bounds[:-1][sizes > 0]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return out[new], kept[bounds]


def least_overlap(n, m):
    """Least intersection size of linked sets of sizes n and m: ceil(75 (n + m) / 175)."""
    return -(-NUM * (n + m) // (NUM + DEN))


def prefix_size(n):
    return n - -(-NUM * n // DEN) + 1


def measure_sets(docs: DataFrame) -> DataFrame:
    """``doc_id, n, f1, f2``: size and two fingerprints of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(1), NON_SPACE, True):
                h, bounds = shingle_sets(b)
                sums = []
                for seed in (np.uint64(0x1234567), np.uint64(0x89ABCDEF01)):
                    s = np.zeros(len(h) + 1, np.uint64)
                    np.cumsum(mix(h ^ seed), out=s[1:])
                    sums.append(s[bounds[1:]] - s[bounds[:-1]])
                columns = [batch.column(0).slice(b.first, b.n), pa.array(np.diff(bounds)), *(pa.array(signed(x)) for x in sums)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "f1", "f2"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, f1 long, f2 long")


def token_places(h: np.ndarray, bounds: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Place of each token in its set's order: by hash (as the sets are sorted), frequent ones last."""
    sizes = np.diff(bounds)
    first = np.repeat(bounds[:-1], sizes)
    place = np.arange(len(h)) - first
    if not len(frequent) or not len(h):
        return place
    k = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
    late = frequent[k] == h
    before = np.concatenate([[0], np.cumsum(late)])  # late tokens before each place of the block
    lates = before[:-1] - before[first]
    early = np.repeat(sizes - (before[bounds[1:]] - before[bounds[:-1]]), sizes)
    return np.where(late, early + lates, place - lates)


def write_sets(docs: DataFrame) -> DataFrame:
    """``doc_id, s``: the sorted hashes of each non-empty set, 8 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(1), NON_SPACE, True):
                h, bounds = shingle_sets(b)
                raw = h.view(np.uint8)
                out = pa.array([raw[8 * x : 8 * y].tobytes() for x, y in zip(bounds, bounds[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.first, b.n), out], names=["doc_id", "s"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, s binary").where("length(s) > 0")


def _read(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and bounds of a column of sets."""
    offsets, raw = buffers(col)
    return np.frombuffer(raw.tobytes(), np.uint64), offsets // 8


def frequent_tokens(sets: DataFrame, least: int = FREQUENT, most: int = FREQUENT_TOKENS, rounds: int = ROUNDS) -> np.ndarray:
    """Sorted tokens that are in ``least`` or more prefixes, at most ``most`` of them (then the most frequent ones).

    The first round counts the prefixes by hash; each further one counts the tokens that moved into a prefix as others
    went to the end.  Near copies in large groups share all their tokens, so a prefix's worth of them is found a round.
    """
    context = sets.sparkSession.sparkContext
    none = np.zeros(0, np.uint64)
    before, now = None, none
    spare = most
    for _ in range(rounds):
        shared = context.broadcast((before, now))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            old, new = shared.value
            for batch in batches:
                h, bounds = _read(batch.column(0))
                size = np.repeat(prefix_size(np.diff(bounds)), np.diff(bounds))
                chosen = token_places(h, bounds, new) < size
                if old is not None:
                    chosen &= token_places(h, bounds, old) >= size
                yield pa.RecordBatch.from_arrays([pa.array(signed(h[chosen]))], names=["t"])

        counts = cut(sets.select("s").mapInArrow(run, "t long").groupBy("t").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least))
        bar = least
        while counts.where(F.col("n") >= bar).count() > spare:
            bar *= 2
        found = counts.where(F.col("n") >= bar).select("t").toPandas()["t"].to_numpy(np.int64).view(np.uint64)
        before, now = now, np.union1d(now, found)
        spare = most - len(now)
        if not len(found) or spare <= 0:
            break
    return now


def parity_bitmap(h: np.ndarray) -> bytes:
    """Each token flips one of a power of two of bits, about two per token; folds to any smaller power of two."""
    bits = 64
    while bits < 2 * len(h):
        bits *= 2
    out = (np.bincount((mix(h) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(out, bitorder="little").tobytes()


def bitmap_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference of the sets of two bitmaps."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) > len(y):
        x, y = y, x
    y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def index_entries(sets: DataFrame, frequent: np.ndarray) -> DataFrame:
    """``token, doc_id, n, pos, late`` of each set's prefix; late tokens are frequent ones."""
    shared = sets.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = shared.value
        for batch in batches:
            h, bounds = _read(batch.column(1))
            n = np.repeat(np.diff(bounds), np.diff(bounds))
            owner = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            pos = token_places(h, bounds, last)
            keep = pos < prefix_size(n)
            late = np.isin(h[keep], last) if len(last) else np.zeros(int(keep.sum()), bool)
            ids = batch.column(0).take(pa.array(owner[keep]))
            columns = [pa.array(signed(h[keep])), ids, pa.array(n[keep], pa.int32()), pa.array(pos[keep], pa.int32()), pa.array(late)]
            yield pa.RecordBatch.from_arrays(columns, names=["token", "doc_id", "n", "pos", "late"])

    return sets.select("doc_id", "s").mapInArrow(run, "token long, doc_id long, n int, pos int, late boolean")


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole runs of equal keys, for input sorted by key."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < 50_000:
            continue
        table = pa.Table.from_batches(held)
        k = table.column(key).to_numpy()
        end = int(np.searchsorted(k, k[-1]))
        if end:
            yield table.slice(0, end)
        held, size = table.slice(end).to_batches(), table.num_rows - end
    if held:
        yield pa.Table.from_batches(held)


def index_lists(entries: DataFrame, long: int = LIST_ROWS) -> DataFrame:
    """``list, doc_id, n, pos`` of the lists with two sets or more; a list is named by a hash of its members.

    Of lists with equal members the least places hold, the first shared token's among them.  Tokens with more than ``long``
    sets, found among the late ones, get their name from an aggregation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, "token"):
            t, d, n, p = (table.column(c).to_numpy() for c in ("token", "doc_id", "n", "pos"))
            start = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            size = np.diff(np.append(start, len(t)))
            keep = np.repeat(size > 1, size)
            if not keep.any():
                continue
            d, n, p = d[keep].astype(np.int64), n[keep], p[keep]
            size = size[size > 1]
            name = np.zeros(len(d) + 1, np.uint64)
            np.cumsum(mix(d.view(np.uint64) + np.uint64(1)), out=name[1:])
            bounds = np.concatenate([[0], np.cumsum(size)])
            name = np.repeat(mix(name[bounds[1:]] - name[bounds[:-1]] + size.astype(np.uint64)), size)
            yield pa.RecordBatch.from_arrays([pa.array(signed(name)), pa.array(d), pa.array(n, pa.int32()), pa.array(p, pa.int32())], names=["list", "doc_id", "n", "pos"])

    name = F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("h")
    hot = cut(entries.where("late").groupBy("token").agg(F.count(F.lit(1)).alias("c"), name).where(F.col("c") > long))
    parts = max(1, int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    entries = entries.select("token", "doc_id", "n", "pos")
    if hot.isEmpty():
        usual, more = entries, None
    else:
        tokens = small(cut(hot.select("token", F.xxhash64("h", "c").alias("list"))))
        usual, more = entries.join(tokens, "token", "left_anti"), entries.join(tokens, "token").select("list", "doc_id", "n", "pos")
    rows = usual.repartition(parts, "token").sortWithinPartitions("token").mapInArrow(run, "list long, doc_id long, n int, pos int")
    rows = rows if more is None else rows.unionByName(more)
    return rows.groupBy("list", "doc_id", "n").agg(F.min("pos").alias("pos"))


def _may_link(n1, pos1, n2, pos2):
    """Whether sizes and places of two members of a list allow a link whose first shared token is the list's."""
    return (DEN * np.minimum(n1, n2) >= NUM * np.maximum(n1, n2)) & (np.minimum(n1 - pos1, n2 - pos2) >= least_overlap(n1, n2))


def leader_pairs(lists: DataFrame) -> DataFrame:
    """Round 1: ``(x, y)``, each list's sets with its leader, and with their neighbour along the sizes; sorted lists.

    The leader is the set of least ``pos`` (then doc_id); neighbours serve where the leader's size is too far off.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, "list"):
            k, d, n, pos = (table.column(c).to_numpy().astype(np.int64) for c in ("list", "doc_id", "n", "pos"))
            start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            which = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(k))))
            order = np.lexsort([d, pos, which])
            lead = order[np.concatenate([[True], which[order][1:] != which[order][:-1]])]
            x = np.concatenate([lead[which], np.arange(len(k) - 1)])
            y = np.concatenate([np.arange(len(k)), np.arange(1, len(k))])
            ok = (which[x] == which[y]) & (d[x] != d[y])
            x, y = x[ok], y[ok]
            ok = _may_link(n[x], pos[x], n[y], pos[y])
            x, y = d[x[ok]], d[y[ok]]
            pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0) if len(x) else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["x", "y"])

    return lists.mapInArrow(run, "x long, y long")


def long_leader_pairs(lists: DataFrame) -> DataFrame:
    """Round 1 of long lists (with columns lead, lead_n, lead_pos), row by row."""
    a, b, pa_, pb = F.col("n"), F.col("lead_n"), F.col("pos"), F.col("lead_pos")
    need = F.ceil(NUM * (a + b) / (NUM + DEN))
    ok = (DEN * F.least(a, b) >= NUM * F.greatest(a, b)) & (F.least(a - pa_, b - pb) >= need) & (F.col("doc_id") != F.col("lead"))
    return lists.where(ok).select(F.least("doc_id", "lead").alias("x"), F.greatest("doc_id", "lead").alias("y"))


def derived_overlap(both1, both2, n1, n2, lead):
    """Bounds of the overlap of two sets from their overlaps with a leader of size ``lead``.

    Outside the leader only tokens that both have there can be shared; inside it, both sets' parts overlap at least by
    what the leader has no room for.
    """
    return both1 + both2 - lead, np.minimum(both1, both2) + np.minimum(n1 - both1, n2 - both2)


def remaining_pairs(lists: DataFrame) -> DataFrame:
    """Round 2: pairs ``x, y`` of a list in different components that sizes, places and the leader's answers leave open.

    ``lists``, sorted by ``key``, has ``component``, ``both`` (the overlap with the list's leader, -1 if unknown), ``lead_n``
    (the leader's size) and ``part``: pairs are formed within part 0, or of a row of part 1 and one of part 2.
    ``linked`` pairs are links by the lower bound and need no comparison.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, "key"):
            k, d, n, pos, c, both, lead, part = (table.column(x).to_numpy().astype(np.int64) for x in ("key", "doc_id", "n", "pos", "component", "both", "lead_n", "part"))
            start = np.append(np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])), len(k))
            found = []
            for s, e in zip(start, start[1:]):
                rows = np.arange(s, e)
                if (c[rows] == c[s]).all():
                    continue  # one component: every answer is known
                alone = part[s] == 0
                left, right = (rows, rows) if alone else (rows[part[rows] == 1], rows[part[rows] == 2])
                for i0 in range(0, len(left), LIST_ROWS):
                    i = left[i0 : i0 + LIST_ROWS]
                    for j0 in range(i0 if alone else 0, len(right), LIST_ROWS):
                        j = right[j0 : j0 + LIST_ROWS]
                        if NUM * n[j[0]] > DEN * n[i[-1]]:
                            break  # sizes only grow from here
                        ok = (d[j][None] != d[i][:, None]) & (c[j][None] != c[i][:, None])
                        if alone:
                            ok &= j[None] > i[:, None]
                        ok &= _may_link(n[i][:, None], pos[i][:, None], n[j][None], pos[j][None])
                        p, q = np.nonzero(ok)
                        x, y = i[p], j[q]
                        low, high = derived_overlap(both[x], both[y], n[x], n[y], lead[x])
                        need = least_overlap(n[x], n[y])
                        known = (both[x] >= 0) & (both[y] >= 0)
                        keep = ~known | (high >= need)
                        if keep.any():
                            x, y, linked = x[keep], y[keep], (known & (low >= need))[keep]
                            found.append(np.stack([np.minimum(d[x], d[y]), np.maximum(d[x], d[y]), linked], 1))
            if found:
                pairs = np.unique(np.concatenate(found), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(pairs[:, 2] > 0)], names=["x", "y", "linked"])

    return lists.mapInArrow(run, "x long, y long, linked boolean").groupBy("x", "y").agg(F.max("linked").alias("linked"))


def write_bitmaps(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """``doc_id, n, s``: size and parity bitmap of the wanted sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, bounds = _read(batch.column(1))
            out = [parity_bitmap(h[x:y]) for x, y in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds), pa.int32()), pa.array(out, pa.binary())], names=["doc_id", "n", "s"])

    return sets.join(ids, "doc_id", "left_semi").select("doc_id", "s").mapInArrow(run, "doc_id long, n int, s binary")


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many hashes two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(b) else 0


def _compare(pairs: DataFrame, sets: DataFrame, bitmaps: bool) -> DataFrame:
    """Pairs that the bitmaps leave possible; or all pairs with ``both``, their exact intersection size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n1, n2 = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            out = np.zeros(batch.num_rows, np.int64)
            for i, (s1, s2) in enumerate(zip(batch.column(3), batch.column(5))):
                if bitmaps:
                    out[i] = bitmap_difference(s1.as_buffer(), s2.as_buffer())
                else:
                    out[i] = _common(np.frombuffer(s1.as_buffer(), np.uint64), np.frombuffer(s2.as_buffer(), np.uint64))
            total = n1.astype(np.int64) + n2
            keep = total - 2 * least_overlap(n1.astype(np.int64), n2.astype(np.int64)) >= out if bitmaps else np.ones(len(out), bool)
            cols = [batch.column(0), batch.column(1), pa.array(n1), pa.array(n2), pa.array(out)]
            yield pa.RecordBatch.from_arrays(cols, names=["x", "y", "n1", "n2", "both"]).filter(pa.array(keep))

    one = sets.select(F.col("doc_id").alias("x"), F.col("n").alias("n1"), F.col("s").alias("s1"))
    two = sets.select(F.col("doc_id").alias("y"), F.col("n").alias("n2"), F.col("s").alias("s2"))
    joined = pairs.join(one, "x").join(two, "y").select("x", "y", "n1", "s1", "n2", "s2")
    return joined.mapInArrow(run, "x long, y long, n1 int, n2 int, both long")


def verify_pairs(sets: DataFrame, pairs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``x, y, both, linked`` of the pairs that the bitmaps do not refute."""
    left = cut(_compare(pairs, bitmaps, True).select("x", "y"))
    ids = cut(left.select(F.col("x").alias("doc_id")).union(left.select("y")).distinct())
    wanted = cut(sets.join(small(ids), "doc_id", "left_semi").select("doc_id", (F.length("s") / 8).cast("int").alias("n"), "s"))
    both = _compare(left, wanted, False)
    return cut(both.select("x", "y", "both", (DEN * F.col("both") >= NUM * (F.col("n1") + F.col("n2") - F.col("both"))).alias("linked")))


def _second_round(lists: DataFrame, known: DataFrame, first: DataFrame, leads: DataFrame | None) -> DataFrame:
    """Rows of :func:`remaining_pairs`, but for ``key`` and ``part``: members of lists with several components.

    ``leads`` (long lists): list, lead, lead_n and others; lists without it are short enough for a join on their name.
    """
    more = lists.join(known.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    lead = F.min(F.struct("pos", "doc_id", "n"))
    mixed = more.groupBy("list").agg(F.min("component").alias("a"), F.max("component").alias("b"), lead["doc_id"].alias("lead"), lead["n"].alias("lead_n"))
    mixed = mixed.where("a < b").select("list", "lead", "lead_n")
    more = more.join(mixed if leads is None else small(cut(mixed)), "list")
    answers = first.select(F.col("x").alias("lead"), F.col("y").alias("doc_id"), "both").union(first.select("y", "x", "both"))
    more = more.join(answers, ["lead", "doc_id"], "left")
    both = F.when(F.col("doc_id") == F.col("lead"), F.col("n")).otherwise(F.coalesce("both", F.lit(-1))).cast("long")
    return more.select("list", "doc_id", "n", "pos", "component", both.alias("both"), "lead_n")


def _chunks(more: DataFrame, size: int = LIST_ROWS) -> DataFrame:
    """Long lists for :func:`remaining_pairs`: chunks of a list (part 2), each with all sets outside the largest component (part 1)."""
    counts = cut(more.groupBy("list", "component").agg(F.count(F.lit(1)).alias("c")))
    lists = counts.groupBy("list").agg(F.max_by("component", F.struct("c", -F.col("component"))).alias("main"), F.ceil(F.sum("c") / size).cast("int").alias("chunks"))
    more = more.join(small(cut(lists)), "list")
    key = lambda chunk: F.xxhash64("list", chunk).alias("key")
    cols = ["doc_id", "n", "pos", "component", "both", "lead_n"]
    every = more.select(key(F.pmod(F.hash("doc_id"), F.col("chunks")).cast("int")), *cols, F.lit(2).alias("part"))
    outside = more.where("component != main").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return every.unionByName(outside.select(key(F.col("chunk")), *cols, F.lit(1).alias("part")))


def jaccard_components(docs: DataFrame, frequent: int = FREQUENT, frequent_tokens_most: int = FREQUENT_TOKENS, list_rows: int = LIST_ROWS) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row; doc_id is an integer.

    Null and empty texts have empty sets, link with nothing and are their own component.  Rows with equal sets are
    linked; rows that repeat a doc_id are joined under it.  A null doc_id takes no part in links.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = cut(measure_sets(docs))
    classes = cut(rows.where("n > 0 and doc_id is not null").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("most")))
    equal = rows.select("doc_id", "n", "f1", "f2").join(small(classes.where("most > rep")), ["n", "f1", "f2"]).where("doc_id > rep").select(F.col("doc_id").alias("x"), F.col("rep").alias("y"))
    equal = cut(equal)
    others = small(cut(equal.select(F.col("x").alias("doc_id")).distinct()))
    sets = cut(write_sets(docs.where("doc_id is not null").join(others, "doc_id", "left_anti")))
    token = frequent_tokens(sets, frequent, frequent_tokens_most)
    lists = cut(index_lists(index_entries(sets, token), list_rows))
    lead = F.min(F.struct("pos", "doc_id", "n"))
    long = cut(lists.groupBy("list").agg(F.count(F.lit(1)).alias("c"), lead["doc_id"].alias("lead"), lead["n"].alias("lead_n"), lead["pos"].alias("lead_pos")).where(F.col("c") > list_rows).drop("c"))
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = lambda df, key: df.repartition(parts, key).sortWithinPartitions(key, "n", "doc_id")
    some_long = not long.isEmpty()
    short, extra = (lists.join(small(long), "list", "left_anti"), lists.join(small(long), "list")) if some_long else (lists, None)
    bitmaps = cut(write_bitmaps(sets, small(cut(lists.select("doc_id").distinct()))))
    pairs = leader_pairs(order(short, "list"))
    first = verify_pairs(sets, cut((pairs.union(long_leader_pairs(extra)) if some_long else pairs).distinct()), bitmaps)
    links = equal.union(first.where("linked").select("x", "y"))
    known = cut(connected_components(links, "x", "y", LOCAL_EDGES))
    more = _second_round(short, known, first, None).withColumnRenamed("list", "key").withColumn("part", F.lit(0))
    rest = remaining_pairs(order(more, "key"))
    if some_long:
        rest = rest.union(remaining_pairs(order(_chunks(cut(_second_round(extra.select(*lists.columns), known, first, long)), list_rows), "key")))
    rest = cut(rest)
    open_ = rest.where("not linked").select("x", "y").distinct()
    second = verify_pairs(sets, cut(open_.join(first.select("x", "y"), ["x", "y"], "left_anti")), bitmaps)
    found = second.where("linked").select("x", "y").union(rest.where("linked").select("x", "y"))
    if not found.isEmpty():
        known = connected_components(links.union(found), "x", "y", LOCAL_EDGES)
    known = cut(known.withColumnRenamed("node", "doc_id"))
    out = rows.select("doc_id", "n").join(small(known), "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _keep_by_rows(docs: DataFrame) -> DataFrame:
    """The row with the least doc_id of each component, where texts that share a doc_id, or have none, are rows of their own."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(row, "doc_id", "text", F.xxhash64("text").alias("h"), F.length("text").alias("n")).dropDuplicates(["doc_id", "h", "n"])
    rows = cut(rows.withColumn("key", F.monotonically_increasing_id()))
    found = jaccard_components(rows.select(F.col("key").alias("doc_id"), "text")).withColumnRenamed("doc_id", "key")
    least = rows.select("key", "doc_id").join(found, "key").groupBy("component_id").agg(F.min(F.struct("doc_id", "key"))["key"].alias("key"))
    return rows.join(small(cut(least.select("key"))), "key", "left_semi").select("row.*")


def keep_one_per_component(docs: DataFrame) -> DataFrame:
    """The documents without those whose component has a smaller doc_id; rows that repeat a doc_id and its text come once.

    Different texts under one doc_id are documents of their own.  Documents with null doc_id are compared with each other only.
    """
    prepare(docs.sparkSession)
    known, nulls = docs.where("doc_id is not null"), docs.where("doc_id is null")
    text = F.struct(F.xxhash64("text"), F.length("text"))
    if known.groupBy("doc_id").agg(F.min(text).alias("a"), F.max(text).alias("b")).where("not a <=> b").isEmpty():
        found = jaccard_components(known).where("doc_id != component_id").select("doc_id").distinct()
        kept = known.join(small(cut(found)), "doc_id", "left_anti").select(*docs.columns).dropDuplicates(["doc_id"])
    else:
        kept = _keep_by_rows(known)
    return kept if nulls.isEmpty() else kept.unionByName(_keep_by_rows(nulls))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
