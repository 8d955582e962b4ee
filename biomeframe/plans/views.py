"""Views of the relational test tables as the engine's inputs, for queries with an SQL oracle.

Each view exists twice: as a DataFrame here and as a common table expression in ``CTE``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRIM, CORE_SIZE, MSP_FILTER, THRESHOLD = 80, 20, 0.1, 0.95

#: Small module definitions over the suppliers' terms.
MODULES = {
    "M1": "S1 (S2,S3+S4)",
    "M2": "(S5,S6),S7",
    "M3": "S1+S8 -S9",
    "M4": "(S2,(S3+S5)) S6 S9",
    "M5": "M2 S4",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("sample"), F.col("l_orderkey").alias("read_id"), F.col("l_partkey").alias("gene_id"),
        F.lit(100).alias("ali"), F.round(F.col("l_discount") * 100).cast("int").alias("nm"),
    )


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("gene_id"), (F.col("p_size") * 7 + 13).alias("gene_length"))


def msp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("msp_name"), F.col("p_partkey").alias("gene_id"), F.col("p_name").alias("gene_name"), F.col("p_partkey").alias("ord"),
        F.when(F.col("p_size") <= 35, "core").otherwise("accessory").alias("gene_category"),
    )


def supplier_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("gene_id"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("annotation")).distinct()


def type_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("gene_id"), F.col("p_type").alias("annotation"))


def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"]).join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"])
    return joined.select(F.concat(F.lit("Brand#"), F.col("s_suppkey").cast("string")).alias("msp_name"), F.col("r_name").alias("superkingdom"), F.col("n_name").alias("phylum"), F.col("s_name").alias("species"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.floor("value").cast("int") % 200
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("sample"), F.col("user_id").alias("gene_id"), start.alias("startpos"), (start + 20 + (F.col("event_id") % 30).cast("int")).alias("endpos"))


def segment_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("gene_id")).distinct().withColumn("gene_length", F.lit(220))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 letters per document: two digests, as letters of the nucleotide code and gaps; twenty samples a species."""
    digest = lambda suffix: F.translate(F.md5(F.concat("text", F.lit(suffix))), "0123456789abcdef", "ACGTACGTACGTRYSN")
    docs = table(spark, sf_dir, "documents").where("text is not null")
    species = F.concat(F.lit("msp_"), F.floor(F.col("doc_id") / 20).cast("string"))
    return docs.select(species.alias("msp_name"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("sample"), F.concat(digest(""), digest("x")).alias("seq"))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sequence of 64 bases per gene 0..49 and sample."""
    digest = lambda suffix: F.translate(F.md5(F.concat(F.col("id").cast("string"), F.lit(suffix))), "0123456789abcdef", "ACGTACGTACGTACGT")
    base = spark.range(50).select(F.col("id").alias("gene_id"), F.concat(digest("a"), digest("b")).alias("seq"))
    samples = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("sample")).distinct()
    return samples.join(F.broadcast(base)).select("sample", "gene_id", "seq")


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-base records at 0-based starts, several per position, in order of ``ord``."""
    pick = lambda x: F.substring(F.lit("ACGT"), (x % 4 + 1).cast("int"), 1)
    li = table(spark, sf_dir, "lineitem")
    ord_ = ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey")
    return li.groupBy(F.concat("l_returnflag", "l_linestatus").alias("sample"), (F.col("l_partkey") % 50).alias("gene_id"), (F.col("l_linenumber") * 7 + F.col("l_suppkey") % 7).cast("int").alias("start"),
                      ord_.alias("ord"), pick(F.col("l_suppkey")).alias("ref"), F.array(pick(F.col("l_partkey"))).alias("alts")).agg(
        F.min(F.col("l_quantity").cast("int")).alias("ro"), F.array(F.min(F.round(F.col("l_discount") * 100).cast("int"))).alias("ao"))


CTE = f"""
aln AS (SELECT l_returnflag || l_linestatus AS sample, l_orderkey AS read_id, l_partkey AS gene_id, 100 AS ali, CAST(round(l_discount * 100) AS INT) AS nm FROM lineitem),
genes AS (SELECT p_partkey AS gene_id, p_size * 7 + 13 AS gene_length FROM part),
msp AS (SELECT p_brand AS msp_name, p_partkey AS gene_id, p_name AS gene_name, p_partkey AS ord, CASE WHEN p_size <= 35 THEN 'core' ELSE 'accessory' END AS gene_category FROM part),
terms AS (SELECT DISTINCT l_partkey AS gene_id, 'S' || l_suppkey AS annotation FROM lineitem),
types AS (SELECT p_partkey AS gene_id, p_type AS annotation FROM part),
taxonomy AS (
  SELECT 'Brand#' || s_suppkey AS msp_name, r_name AS superkingdom, n_name AS phylum, s_name AS species
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
f AS (SELECT *, CAST(ali - nm AS DOUBLE) / ali AS ident FROM aln WHERE CAST(ali - nm AS DOUBLE) / ali >= {THRESHOLD}),
hits AS (
  SELECT sample, read_id, gene_id, ali, nm, ident, count(*) OVER (PARTITION BY sample, read_id) AS k
  FROM (SELECT *, max(ident) OVER (PARTITION BY sample, read_id) AS best FROM f) WHERE ident = best),
uniq AS (SELECT sample, gene_id, count(*) AS n FROM hits WHERE k = 1 GROUP BY 1, 2),
multi AS (SELECT sample, read_id, gene_id, max(k) AS k, count(*) AS c FROM hits WHERE k > 1 GROUP BY 1, 2, 3),
weighed AS (
  SELECT m.*, coalesce(u.n, 0) AS n, sum(m.c * coalesce(u.n, 0)) OVER (PARTITION BY m.sample, m.read_id) AS s
  FROM multi m LEFT JOIN uniq u ON u.sample = m.sample AND u.gene_id = m.gene_id),
co AS (SELECT sample, read_id, gene_id, CASE WHEN s = 0 THEN 1.0::DOUBLE / k ELSE (c * n)::DOUBLE / s END AS co FROM weighed),
shared AS (SELECT sample, gene_id, sum(v) AS value FROM (SELECT sample, gene_id, n::DOUBLE AS v FROM uniq UNION ALL SELECT sample, gene_id, co FROM co WHERE co > 0) GROUP BY 1, 2),
samples AS (SELECT DISTINCT sample FROM aln),
counts AS (
  SELECT s.sample, g.gene_id, g.gene_length, coalesce(x.value, 0.0)::DOUBLE AS value
  FROM samples s CROSS JOIN genes g LEFT JOIN shared x ON x.sample = s.sample AND x.gene_id = g.gene_id),
covered AS (
  SELECT sample, gene_id, gene_length,
         CASE WHEN gene_length >= 2 * {TRIM} THEN 100.0::DOUBLE * value / (gene_length - {TRIM} + 1)
              WHEN gene_length % 2 = 0 THEN 100.0::DOUBLE * value * 4 * {TRIM} / (gene_length * (gene_length + 2))
              ELSE 100.0::DOUBLE * value * 4 * {TRIM} / ((gene_length + 1) * (gene_length + 1)) END AS value FROM counts),
core AS (
  SELECT DISTINCT msp_name, gene_id FROM (SELECT *, row_number() OVER (PARTITION BY msp_name ORDER BY ord) AS r FROM msp WHERE gene_category = 'core') WHERE r <= {CORE_SIZE}),
mspv AS (
  SELECT c.sample, core.msp_name, CASE WHEN count(*) FILTER (c.value > 0)::DOUBLE / count(*) >= {MSP_FILTER} THEN avg(c.value) ELSE 0.0::DOUBLE END AS value
  FROM core JOIN covered c USING (gene_id) GROUP BY 1, 2),
info AS (
  SELECT DISTINCT c.sample, m.msp_name, t.annotation FROM covered c JOIN msp m USING (gene_id) JOIN mspv v ON v.sample = c.sample AND v.msp_name = m.msp_name AND v.value > 0
  JOIN terms t ON t.gene_id = c.gene_id WHERE c.value > 0),
segments AS (SELECT event_type AS sample, user_id AS gene_id, CAST(floor(value) AS INT) % 200 AS startpos, CAST(floor(value) AS INT) % 200 + 20 + CAST(event_id % 30 AS INT) AS endpos FROM events),
seggenes AS (SELECT DISTINCT user_id AS gene_id, 220 AS gene_length FROM events),
seqs AS (
  SELECT 'msp_' || (doc_id // 20) AS msp_name, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS sample,
         translate(md5(text), '0123456789abcdef', 'ACGTACGTACGTRYSN') || translate(md5(text || 'x'), '0123456789abcdef', 'ACGTACGTACGTRYSN') AS seq
  FROM documents WHERE text IS NOT NULL),
refs AS (
  SELECT s.sample, i.range AS gene_id, translate(md5(CAST(i.range AS VARCHAR) || 'a'), '0123456789abcdef', 'ACGTACGTACGTACGT') || translate(md5(CAST(i.range AS VARCHAR) || 'b'), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq
  FROM samples s CROSS JOIN range(50) i),
variants AS (
  SELECT l_returnflag || l_linestatus AS sample, l_partkey % 50 AS gene_id, CAST(l_linenumber * 7 + l_suppkey % 7 AS INT) AS start,
         ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS ord, substr('ACGT', l_suppkey % 4 + 1, 1) AS ref, substr('ACGT', l_partkey % 4 + 1, 1) AS alt,
         min(CAST(l_quantity AS INT)) AS ro, min(CAST(round(l_discount * 100) AS INT)) AS ao
  FROM lineitem GROUP BY ALL),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample, gene_id, start ORDER BY ord) AS r FROM variants) WHERE r = 1),
chosen AS (SELECT *, coalesce(ro::DOUBLE / nullif(ro + ao, 0) >= 0.8, false) AS keep FROM firsts),
coded AS (
  SELECT *, CASE WHEN keep AND ref <> alt THEN
    CASE least(ref, alt) || greatest(ref, alt) WHEN 'AG' THEN 'R' WHEN 'CT' THEN 'Y' WHEN 'CG' THEN 'S' WHEN 'AT' THEN 'W' WHEN 'GT' THEN 'K' WHEN 'AC' THEN 'M' END ELSE alt END AS code FROM chosen),
points AS (SELECT sample, gene_id, p, sum(d) AS d FROM (
  SELECT s.sample, s.gene_id, greatest(startpos, 0) AS p, 1 AS d FROM segments s JOIN seggenes USING (gene_id) WHERE startpos < gene_length
  UNION ALL SELECT s.sample, s.gene_id, least(endpos, gene_length), -1 FROM segments s JOIN seggenes USING (gene_id) WHERE startpos < gene_length
  UNION ALL SELECT sample, gene_id, unnest([0, gene_length]), 0 FROM (SELECT DISTINCT sample FROM segments) CROSS JOIN seggenes) GROUP BY 1, 2, 3),
steps AS (SELECT sample, gene_id, p AS startpos, lead(p) OVER w AS endpos, CAST(sum(d) OVER w AS INT) AS depth FROM points WINDOW w AS (PARTITION BY sample, gene_id ORDER BY p)),
flagged AS (SELECT *, CASE WHEN lag(depth) OVER (PARTITION BY sample, gene_id ORDER BY startpos) = depth THEN 0 ELSE 1 END AS fresh FROM steps WHERE endpos IS NOT NULL),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY sample, gene_id ORDER BY startpos) AS i FROM flagged),
runs AS (SELECT sample, gene_id, min(startpos) AS startpos, max(endpos) AS endpos, min(depth) AS depth FROM islands GROUP BY sample, gene_id, i)
"""
