"""Line de-duplication by distinct-site spread.

HyperLogLog sketches of the sites of each line (by its hash) merge in one aggregation, so a line's group never
holds its rows.  Lines whose estimate is near the threshold get an exact distinct count.

Lines on ``min_sites`` sites or more are spread.  Copies of one document on many sites spread all its lines too, so the
sites of the spread lines are counted once more, over documents with text of their own: those with at most ``max_share`` of
their words on spread lines.  Lines that reach ``min_sites`` in this count as well are boilerplate and are removed from
every document, whatever it holds besides.  Lines that only copies spread stay, for near-duplicate removal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import cut, prepare, small

MIN_SITES = 10
#: Lines of fewer words recur by chance and are kept.
MIN_WORDS = 3
#: A document's sites count in the second count if spread lines hold at most this share of its words.
MAX_SHARE = 0.5
LG_K = 10
#: Estimates within so many standard errors of the threshold are counted exactly.
ERRORS = 4
WORD = r"[^\x20\x09-\x0D]+"
#: Texts with boilerplate that may be broadcast; beyond it texts are shuffled.
BROADCAST_TEXTS = 200_000


def _key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("_k1"), F.length(text).alias("_k2")]


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """The hashes ``h`` on ``min_sites`` distinct sites or more, of rows ``h, site``; null sites don't count."""
    error = ERRORS * 1.04 / 2 ** (lg_k / 2)
    low, high = min_sites * (1 - error) - 0.5, min_sites * (1 + error) + 0.5
    sketches = lines.where("site is not null").groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites"))
    spread = cut(sketches.where(F.col("sites") >= low))
    near = spread.where(F.col("sites") <= high).select("h")
    exact = lines.join(small(near), "h", "left_semi").groupBy("h").agg(F.countDistinct("site").alias("sites")).where(F.col("sites") >= min_sites)
    return cut(spread.where(F.col("sites") > high).select("h").union(exact.select("h")))


def dedup_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, min_words: int = MIN_WORDS, max_share: float = MAX_SHARE, lg_k: int = LG_K) -> DataFrame:
    """``row`` (a struct of docs' columns), ``lines`` (of the text), ``removed`` (how many of them go) and ``kept`` (the text left).

    Lines are split at ``\\n``.  Null texts stay null with 0 lines; empty texts have one empty line; repeated rows
    are treated alike.  Rows without a site count for no site but lose boilerplate too.  Other columns, of whatever
    name, stay inside ``row``.
    """
    prepare(docs.sparkSession)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    words = lambda x: F.regexp_count(x, F.lit(WORD))
    every = F.transform(F.split("text", "\n", -1), lambda x: F.struct(F.xxhash64(x).alias("h"), words(x).alias("w")))
    texts = docs.where("text is not null").select(
        F.monotonically_increasing_id().alias("rid"), F.col(site).cast("string").alias("site"), *_key(F.col("text")), words(F.col("text")).alias("total"),
        F.filter(every, lambda x: x["w"] >= min_words).alias("ls"),
    )
    lines = cut(texts.select("rid", "site", "_k1", "_k2", "total", F.explode("ls").alias("l")).select("rid", "site", "_k1", "_k2", "total", "l.h", "l.w"))
    hits = cut(lines.join(small(spread_lines(lines.select("h", "site"), min_sites, lg_k)), "h", "left_semi"))
    own = cut(hits.groupBy("rid").agg(F.sum("w").alias("on"), F.max("total").alias("total")).where(F.col("on") <= F.col("total") * max_share).select("rid"))
    boilerplate = spread_lines(hits.join(small(own), "rid", "left_semi").select("h", "site"), min_sites, lg_k)
    marks = cut(hits.join(small(boilerplate), "h", "left_semi").groupBy("_k1", "_k2").agg(F.collect_set("h").alias("_marks")))
    keyed = docs.select(row, F.col("text").alias("_text"), *_key(F.col("text"))).join(small(marks, BROADCAST_TEXTS), ["_k1", "_k2"], "left")
    every = F.split("_text", "\n", -1)
    kept = F.filter(every, lambda x: ~(F.array_contains("_marks", F.xxhash64(x)) & (words(x) >= min_words)))
    cuts = F.col("_marks").isNotNull()
    keyed = keyed.select("row", "_text", F.size(every).alias("_n"), F.when(cuts, kept).alias("_kept"))
    cuts = F.col("_kept").isNotNull()
    return keyed.select(
        "row",
        F.coalesce(F.when(F.col("_text").isNotNull(), F.col("_n")), F.lit(0)).cast("long").alias("lines"),
        F.when(cuts, F.col("_n") - F.size("_kept")).otherwise(F.lit(0)).cast("long").alias("removed"),
        F.when(cuts, F.array_join("_kept", "\n")).otherwise(F.col("_text")).alias("kept"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines left of every document."""
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    return out.select("row.doc_id", F.col("lines").alias("n_lines"), F.col("removed").alias("n_removed"), F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP7_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, source, text FROM documents),
one AS (
  SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM (
    SELECT rid, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs WHERE text IS NOT NULL)),
spread AS (SELECT line FROM one WHERE n >= {MIN_WORDS} GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
own AS (SELECT o.rid FROM one o LEFT JOIN spread s ON s.line = o.line GROUP BY o.rid HAVING coalesce(sum(o.n) FILTER (s.line IS NOT NULL), 0) <= sum(o.n) * {MAX_SHARE}),
boilerplate AS (SELECT line FROM one SEMI JOIN spread USING (line) SEMI JOIN own USING (rid) GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
per AS (
  SELECT o.rid, count(*) AS lines, count(*) FILTER (s.line IS NOT NULL) AS gone, coalesce(string_agg(o.line, chr(10) ORDER BY o.i) FILTER (s.line IS NULL), '') AS kept
  FROM one o LEFT JOIN boilerplate s ON s.line = o.line GROUP BY o.rid)
SELECT d.doc_id, CAST(coalesce(p.lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(p.gone, 0) AS BIGINT) AS n_removed, sha256(CASE WHEN p.gone > 0 THEN p.kept ELSE coalesce(d.text, '') END) AS kept_sha256
FROM docs d LEFT JOIN per p ON p.rid = d.rid
"""
