"""Registered queries over the test tables, each with the same rows in SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biomeframe.functions import sequence
from biomeframe.functions.modules import parse_modules
from biomeframe.operators import consensus, counting, depth, functional, merge, normalize, phylo, taxa
from biomeframe.plans import views as v
from biomeframe.plans.views import CTE
from biomeframe.sources import writers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None, ctes: bool = True) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLE_SQL[name] = f"WITH {CTE} {sql}" if ctes else sql
        return query

    return add


def _round(df: DataFrame, *names: str) -> DataFrame:
    """Doubles rounded to six digits: sums differ in their last bits with the order of addition."""
    return df.withColumns({n: F.round(F.col(n), 6) + F.lit(0.0) for n in names})


# Intermediate tables -------------------------------------------------------


def _hits(s: SparkSession, d: str) -> DataFrame:
    return counting.best_hits(v.alignments(s, d), v.THRESHOLD)


def _counts(s: SparkSession, d: str) -> DataFrame:
    return counting.gene_counts(v.alignments(s, d), v.genes(s, d), v.THRESHOLD)


def _covered(s: SparkSession, d: str) -> DataFrame:
    return normalize.normalize_coverage(_counts(s, d), v.TRIM)


def _covered_sparse(s: SparkSession, d: str) -> DataFrame:
    """Normalised counts without zeros, for steps to which a zero makes no difference."""
    counts = counting.sparse_counts(v.alignments(s, d), v.THRESHOLD).join(v.genes(s, d), "gene_id")
    return normalize.normalize_coverage(counts, v.TRIM)


def _core(s: SparkSession, d: str) -> DataFrame:
    return taxa.core_genes(v.msp(s, d), v.CORE_SIZE)


def _species(s: SparkSession, d: str) -> DataFrame:
    return taxa.msp_abundance(_covered_sparse(s, d), _core(s, d), v.MSP_FILTER, v.genes(s, d), v.alignments(s, d))


def _runs(s: SparkSession, d: str) -> DataFrame:
    return depth.depth_runs(v.segments(s, d), v.segment_genes(s, d))


def _alternatives(s: SparkSession) -> DataFrame:
    rows = [(m, i, sorted(a)) for m, alts in parse_modules(v.MODULES).items() for i, a in enumerate(alts)]
    return s.createDataFrame(rows, "mod_id string, alt_id int, terms array<string>")


def _alternatives_sql() -> str:
    rows = [f"('{m}', {i}, [{', '.join(repr(t) for t in sorted(a))}])" for m, alts in parse_modules(v.MODULES).items() for i, a in enumerate(alts)]
    return f"alts(mod_id, alt_id, terms) AS (VALUES {', '.join(rows)})"


_COMPLETENESS_SQL = f"""{_alternatives_sql()},
have AS (SELECT sample, msp_name, list(annotation) AS have FROM info GROUP BY 1, 2),
completeness AS (SELECT sample, msp_name, mod_id, max(len(list_intersect(terms, have))::DOUBLE / len(terms)) AS value FROM have CROSS JOIN alts GROUP BY 1, 2, 3)"""


def _completeness(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    species = _species(s, d)
    info = functional.catalogue_info(_covered_sparse(s, d), v.msp(s, d), v.supplier_terms(s, d), species)
    return functional.module_completeness(info, _alternatives(s)), species


# Flagship and counting -----------------------------------------------------


@register("flagship_msp_profile", "SELECT sample, msp_name, round(value, 6) AS value FROM mspv")
def flagship_msp_profile(s, d):
    """Shared counts, coverage normalisation, species abundance."""
    return _round(_species(s, d), "value")


@register("identity_filter", "SELECT sample, read_id, gene_id, round(ident, 6) AS ident FROM f")
def identity_filter(s, d):
    return _round(counting.filter_identity(v.alignments(s, d), v.THRESHOLD).select("sample", "read_id", "gene_id", "ident"), "ident")


@register("best_hit_ties", "SELECT sample, read_id, gene_id, k FROM hits")
def best_hit_ties(s, d):
    return _hits(s, d).select("sample", "read_id", "gene_id", "k")


_DENSE = "SELECT s.sample, g.gene_id, g.gene_length, coalesce(x.n, 0)::DOUBLE AS value FROM samples s CROSS JOIN genes g LEFT JOIN {} x ON x.sample = s.sample AND x.gene_id = g.gene_id"


# Samples of the dense tables are those with a counted read; every sample of the test tables has one.
@register("count_unique", _DENSE.format("uniq"))
def count_unique(s, d):
    return counting.gene_counts(v.alignments(s, d), v.genes(s, d), v.THRESHOLD, "unique")


@register("count_total", _DENSE.format("(SELECT sample, gene_id, count(*) AS n FROM hits GROUP BY 1, 2)"))
def count_total(s, d):
    return counting.gene_counts(v.alignments(s, d), v.genes(s, d), v.THRESHOLD, "total")


@register("count_smart_shared", "SELECT sample, gene_id, gene_length, round(value, 6) AS value FROM counts")
def count_smart_shared(s, d):
    return _round(_counts(s, d), "value")


@register("co_coefficients", "SELECT sample, read_id, gene_id, round(co, 6) AS co FROM co WHERE co > 0")
def co_coefficients(s, d):
    return _round(counting.co_coefficients(_hits(s, d)), "co")


@register("counted_reads", "SELECT sample, count(DISTINCT read_id) AS counted_reads FROM hits GROUP BY 1")
def counted_reads(s, d):
    return counting.counted_reads(_hits(s, d))


@register("counted_reads_unique", "SELECT sample, count(DISTINCT read_id) AS counted_reads FROM hits WHERE k = 1 GROUP BY 1")
def counted_reads_unique(s, d):
    return counting.counted_reads(_hits(s, d), "unique")


@register(
    "mapping_rate",
    """SELECT t.sample, t.n AS total_reads, coalesce(c.n, 0) AS counted_reads, round_even(coalesce(c.n, 0)::DOUBLE / t.n * 100, 2) AS final_mapping_rate
    FROM (SELECT sample, count(DISTINCT read_id) AS n FROM aln GROUP BY 1) t LEFT JOIN (SELECT sample, count(DISTINCT read_id) AS n FROM hits GROUP BY 1) c USING (sample)""",
)
def mapping_rate(s, d):
    return counting.mapping_rate(v.alignments(s, d), _hits(s, d))


@register("core_alignments_semi", "SELECT sample, gene_id, count(*) AS n FROM aln WHERE gene_id IN (SELECT gene_id FROM core) GROUP BY 1, 2")
def core_alignments_semi(s, d):
    return counting.core_alignments(v.alignments(s, d), _core(s, d)).groupBy("sample", "gene_id").agg(F.count(F.lit(1)).alias("n"))


# Normalisation -------------------------------------------------------------


@register("norm_coverage", "SELECT sample, gene_id, gene_length, round(value, 6) AS value FROM covered")
def norm_coverage(s, d):
    return _round(_covered(s, d), "value")


@register("norm_fpkm", "SELECT sample, gene_id, gene_length, round(coalesce(value / gene_length / nullif(sum(value / gene_length) OVER (PARTITION BY sample), 0), 0), 6) AS value FROM counts")
def norm_fpkm(s, d):
    return _round(normalize.normalize_fpkm(_counts(s, d)), "value")


@register(
    "norm_fpkm_unmapped",
    """SELECT c.sample, gene_id, gene_length, round(coalesce(value / gene_length / nullif(sum(value / gene_length) OVER (PARTITION BY c.sample) + u.n / 1000.0::DOUBLE, 0), 0), 6) AS value
    FROM counts c JOIN (SELECT sample, count(*) AS n FROM aln WHERE nm > 5 GROUP BY 1) u ON u.sample = c.sample""",
)
def norm_fpkm_unmapped(s, d):
    unmapped = v.alignments(s, d).where("nm > 5").groupBy("sample").agg(F.count(F.lit(1)).alias("unmapped"))
    return _round(normalize.normalize_fpkm(_counts(s, d), unmapped), "value")


@register("rarefy_exact")
def rarefy_exact(s, d):
    return normalize.rarefy_exact(_counts(s, d), 500, 1234)


@register(
    "rarefy_hash",
    """, reads AS (SELECT sample, gene_id, unnest(generate_series(1, CAST(round_even(value, 0) AS BIGINT))) AS i FROM counts WHERE round_even(value, 0) > 0),
    kept AS (SELECT sample, gene_id, count(*) AS n FROM (
      SELECT *, row_number() OVER (PARTITION BY sample ORDER BY md5(gene_id || '|' || i || '|1234'), gene_id, i) AS r FROM reads) WHERE r <= 500 GROUP BY 1, 2)
    SELECT c.sample, c.gene_id, c.gene_length, coalesce(k.n, 0)::DOUBLE AS value FROM counts c LEFT JOIN kept k ON k.sample = c.sample AND k.gene_id = c.gene_id""",
)
def rarefy_hash(s, d):
    return normalize.rarefy_hash(_counts(s, d), 500, 1234)


@register("share_of_total", "SELECT sample, gene_id, round(value / nullif(sum(value) OVER (PARTITION BY sample), 0), 6) AS share FROM counts")
def share_of_total(s, d):
    return _round(normalize.share_of_total(_counts(s, d)).select("sample", "gene_id", "share"), "share")


# Species and functions -----------------------------------------------------


@register("msp_core", "SELECT msp_name, gene_id FROM core")
def msp_core(s, d):
    return _core(s, d)


@register("msp_abundance", f"SELECT sample, core.msp_name, round(CASE WHEN count(*) FILTER (c.value > 0)::DOUBLE / count(*) >= {v.MSP_FILTER} THEN avg(c.value) ELSE 0.0 END, 6) AS value FROM core JOIN counts c USING (gene_id) GROUP BY 1, 2")
def msp_abundance(s, d):
    return _round(taxa.msp_abundance(_counts(s, d), _core(s, d), v.MSP_FILTER), "value")


_WITHIN = "gene_id IN (SELECT gene_id FROM msp WHERE gene_category = 'core')"


@register("msp_stats", f"SELECT sample, round_even(sum(CASE WHEN {_WITHIN} THEN value ELSE 0 END) / nullif(sum(value), 0), 2) AS msp_signal FROM covered GROUP BY 1")
def msp_stats(s, d):
    return taxa.msp_stats(_covered(s, d), v.msp(s, d).where("gene_category = 'core'"))


@register("gene_msp_counts", "SELECT g.sample, g.n AS gene_count, m.n AS msp_count FROM (SELECT sample, count(*) FILTER (value > 0) AS n FROM covered GROUP BY 1) g JOIN (SELECT sample, count(*) FILTER (value > 0) AS n FROM mspv GROUP BY 1) m USING (sample)")
def gene_msp_counts(s, d):
    return taxa.positive_count(_covered(s, d), "gene_count").join(taxa.positive_count(_species(s, d), "msp_count"), "sample")


@register("ko_gene_sum", "SELECT sample, annotation, round(sum(value), 6) AS value FROM terms JOIN covered USING (gene_id) GROUP BY 1, 2")
def ko_gene_sum(s, d):
    return _round(functional.abundance_by_gene(_covered(s, d), v.supplier_terms(s, d)), "value")


@register(
    "ko_msp_sum",
    """, x AS (SELECT DISTINCT c.sample, t.annotation, m.msp_name FROM msp m JOIN terms t USING (gene_id) JOIN covered c USING (gene_id) WHERE c.value > 0),
    y AS (SELECT x.sample, x.annotation, sum(mspv.value) AS value FROM x JOIN mspv ON mspv.sample = x.sample AND mspv.msp_name = x.msp_name GROUP BY 1, 2)
    SELECT s.sample, a.annotation, round(coalesce(y.value, 0), 6) AS value FROM (SELECT DISTINCT annotation FROM terms) a CROSS JOIN (SELECT DISTINCT sample FROM mspv) s
    LEFT JOIN y ON y.sample = s.sample AND y.annotation = a.annotation""",
)
def ko_msp_sum(s, d):
    return _round(functional.abundance_by_species(_covered_sparse(s, d), v.msp(s, d), v.supplier_terms(s, d), _species(s, d)), "value")


@register("ko_stats_gene", """SELECT sample, round_even(sum(CASE WHEN t.gene_id IS NOT NULL THEN value ELSE 0 END) / nullif(sum(value), 0), 6) AS signal,
    count(*) FILTER (t.gene_id IS NOT NULL AND value > 0) AS genes FROM covered c LEFT JOIN (SELECT DISTINCT gene_id FROM types WHERE annotation = 'ECONOMY') t USING (gene_id) GROUP BY 1""")  # fmt: skip
def ko_stats_gene(s, d):
    return functional.annotation_stats(_covered(s, d), v.type_terms(s, d).where("annotation = 'ECONOMY'"))


@register("ko_stats_msp", """, present AS (SELECT DISTINCT v.sample, m.gene_id FROM mspv v JOIN msp m USING (msp_name) WHERE v.value > 0 AND m.gene_id IN (SELECT gene_id FROM types WHERE annotation = 'ECONOMY'))
    SELECT c.sample, round_even(sum(CASE WHEN p.gene_id IS NOT NULL THEN value ELSE 0 END) / nullif(sum(value), 0), 6) AS signal, count(*) FILTER (p.gene_id IS NOT NULL AND value > 0) AS genes
    FROM covered c LEFT JOIN present p ON p.sample = c.sample AND p.gene_id = c.gene_id GROUP BY 1""")  # fmt: skip
def ko_stats_msp(s, d):
    return functional.annotation_stats(_covered(s, d), v.type_terms(s, d).where("annotation = 'ECONOMY'"), _species(s, d), v.msp(s, d))


@register("annotation_union", "SELECT annotation, count(*) AS n FROM (SELECT gene_id, annotation FROM terms UNION ALL SELECT gene_id, annotation FROM types) GROUP BY 1")
def annotation_union(s, d):
    return functional.union_annotations(v.supplier_terms(s, d), v.type_terms(s, d)).groupBy("annotation").agg(F.count(F.lit(1)).alias("n"))


@register("catalogue_info", "SELECT sample, msp_name, annotation FROM info")
def catalogue_info(s, d):
    return functional.catalogue_info(_covered_sparse(s, d), v.msp(s, d), v.supplier_terms(s, d), _species(s, d))


@register("module_alternatives", f"WITH {_alternatives_sql()} SELECT mod_id, CAST(alt_id AS INT) AS alt_id, array_to_string(terms, '+') AS terms FROM alts", ctes=False)
def module_alternatives(s, d):
    return _alternatives(s).select("mod_id", "alt_id", F.array_join("terms", "+").alias("terms"))


@register("module_completeness", f", {_COMPLETENESS_SQL} SELECT sample, msp_name, mod_id, round(value, 6) AS value FROM completeness")
def module_completeness(s, d):
    return _round(_completeness(s, d)[0], "value")


@register("module_abundance", f""", {_COMPLETENESS_SQL},
    y AS (SELECT c.sample, c.mod_id, sum(mspv.value) AS value FROM completeness c JOIN mspv ON mspv.sample = c.sample AND mspv.msp_name = c.msp_name WHERE c.value >= 0.6 GROUP BY 1, 2)
    SELECT s.sample, m.mod_id, round(coalesce(y.value, 0), 6) AS value FROM (SELECT DISTINCT mod_id FROM alts) m CROSS JOIN (SELECT DISTINCT sample FROM mspv) s
    LEFT JOIN y ON y.sample = s.sample AND y.mod_id = m.mod_id""")  # fmt: skip
def module_abundance(s, d):
    completeness, species = _completeness(s, d)
    return _round(functional.module_abundance(completeness, species, _alternatives(s), 0.6), "value")


# Merging -------------------------------------------------------------------

_SAMPLES = ["AF", "AO", "NF", "NO", "RF", "RO"]


def _pivot_sql(keys: str, source: str) -> str:
    cols = ", ".join(f"max(CASE WHEN sample = '{x}' THEN round(value, 6) END) AS \"{x}\"" for x in _SAMPLES)
    return f"SELECT {keys}, {cols} FROM {source} GROUP BY {keys}"


@register("merge_pivot_one_key", _pivot_sql("msp_name", "mspv"))
def merge_pivot_one_key(s, d):
    return merge.merge_samples(_round(_species(s, d), "value"), ["msp_name"], _SAMPLES)


@register("merge_pivot_two_keys", f", {_COMPLETENESS_SQL} {_pivot_sql('msp_name, mod_id', 'completeness')}")
def merge_pivot_two_keys(s, d):
    return merge.merge_samples(_round(_completeness(s, d)[0], "value"), ["msp_name", "mod_id"], _SAMPLES)


@register("merge_filter", "SELECT sample, gene_id, round(value, 6) AS value FROM covered WHERE gene_id IN (SELECT gene_id FROM covered GROUP BY 1 HAVING sum(value) >= 50 AND count(*) FILTER (value <> 0) >= 3)")
def merge_filter(s, d):
    return _round(merge.filter_rows(_covered(s, d), ["gene_id"], 50, 3).select("sample", "gene_id", "value"), "value")


@register("drop_empty_samples", "SELECT sample, msp_name, round(CASE WHEN sample LIKE 'A%' THEN 0 ELSE value END, 6) AS value FROM mspv WHERE sample NOT LIKE 'A%' AND sample IN (SELECT sample FROM mspv GROUP BY 1 HAVING sum(value) <> 0)")
def drop_empty_samples(s, d):
    emptied = _species(s, d).withColumn("value", F.when(F.col("sample").startswith("A"), 0.0).otherwise(F.col("value")))
    return _round(merge.drop_empty_samples(emptied), "value")


@register("unpivot_samples", "SELECT msp_name, sample, round(value, 6) AS value FROM mspv")
def unpivot_samples(s, d):
    wide = merge.merge_samples(_round(_species(s, d), "value"), ["msp_name"], _SAMPLES)
    return merge.unpivot_samples(wide, ["msp_name"])


def _census(s, d) -> DataFrame:
    e = v.table(s, d, "events")
    k = F.from_json("props", "map<string,string>")
    return e.select(F.col("event_id").alias("path"), (F.col("event_id") % 40).cast("string").alias("sample"), F.col("event_id").alias("position"), F.map_concat(k, F.create_map(F.col("event_type"), F.col("event_id").cast("string"))).alias("fields"), k.alias("config"))


@register("param_mismatch", "WITH c AS (SELECT event_id, props FROM events) SELECT count(*) FILTER (props IS DISTINCT FROM (SELECT props FROM c ORDER BY event_id LIMIT 1)) AS mismatches FROM c", ctes=False)
def param_mismatch(s, d):
    return merge.parameter_mismatches(_census(s, d).select("path", "config"))


@register("census_report", """WITH e AS (SELECT event_id, CAST(event_id % 40 AS VARCHAR) AS sample, event_type, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events)
    SELECT sample, max_by(k, event_id) AS k, max_by(CAST(event_id AS VARCHAR), event_id) FILTER (event_type = 'click') AS click, max_by(CAST(event_id AS VARCHAR), event_id) FILTER (event_type = 'view') AS "view",
    max_by(CAST(event_id AS VARCHAR), event_id) FILTER (event_type = 'error') AS error, max_by(CAST(event_id AS VARCHAR), event_id) FILTER (event_type = 'purchase') AS purchase FROM e GROUP BY 1""", ctes=False)  # fmt: skip
def census_report(s, d):
    out = merge.report(_census(s, d).select("sample", "position", "fields"))
    return out.select("sample", *(F.col(c) if c in out.columns else F.lit(None).cast("string").alias(c) for c in ("k", "click", "view", "error", "purchase")))


@register("missing_fields", "SELECT event_id AS path, 'n' AS missing FROM events", ctes=False)
def missing_fields(s, d):
    return merge.missing_fields(_census(s, d), "config", ["k", "n"]).select("path", F.array_join("missing", ",").alias("missing"))


@register("taxonomy_semi", "SELECT * FROM taxonomy WHERE msp_name IN (SELECT msp_name FROM mspv)")
def taxonomy_semi(s, d):
    return merge.restrict_taxonomy(v.taxonomy(s, d), _species(s, d))


@register("taxonomy_prefixed", "SELECT msp_name, 'k__' || superkingdom AS superkingdom, 'p__' || phylum AS phylum, 's__' || species AS species, 'k__' || superkingdom || ';p__' || phylum || ';s__' || species || ';t__' || msp_name AS lineage FROM taxonomy")
def taxonomy_prefixed(s, d):
    return merge.prefixed_taxonomy(v.taxonomy(s, d))


@register("biom_rows")
def biom_rows(s, d):
    return merge.biom_rows(_round(_species(s, d), "value"), v.taxonomy(s, d))


# Depth ---------------------------------------------------------------------


@register("depth_runs", "SELECT sample, gene_id, startpos, endpos, depth FROM runs")
def depth_runs(s, d):
    return _runs(s, d)


@register("depth_per_position", "SELECT sample, gene_id, depth, count(*) AS n FROM (SELECT sample, gene_id, depth, unnest(generate_series(startpos, endpos - 1)) AS pos FROM runs) GROUP BY 1, 2, 3")
def depth_per_position(s, d):
    return depth.depth_per_position(_runs(s, d)).groupBy("sample", "gene_id", "depth").agg(F.count(F.lit(1)).alias("n"))


@register("low_cov_intervals", "SELECT sample, gene_id, startpos, endpos, depth AS coverage FROM runs WHERE depth < 3")
def low_cov_intervals(s, d):
    return depth.low_coverage_intervals(_runs(s, d), 3)


_COVERAGE_SQL = """, reads AS (SELECT sample, gene_id, count(*) AS numreads FROM segments GROUP BY 1, 2),
    bases AS (SELECT sample, gene_id, CAST(sum(CASE WHEN depth > 0 THEN endpos - startpos ELSE 0 END) AS BIGINT) AS covbases, sum((endpos - startpos) * depth) AS total FROM runs GROUP BY 1, 2),
    cov AS (SELECT r.sample, r.gene_id, 220 AS gene_length, r.numreads, b.covbases, round(b.covbases * 100.0::DOUBLE / 220, 6) AS coverage, round(b.total::DOUBLE / 220, 6) AS meandepth
            FROM reads r JOIN bases b ON b.sample = r.sample AND b.gene_id = r.gene_id)"""


def _coverage(s, d) -> DataFrame:
    return _round(depth.gene_coverage(_runs(s, d), v.segments(s, d), v.segment_genes(s, d)), "coverage", "meandepth")


@register("gene_coverage", f"{_COVERAGE_SQL} SELECT * FROM cov")
def gene_coverage(s, d):
    return _coverage(s, d)


@register("covered_genes", f"{_COVERAGE_SQL} SELECT sample, gene_id FROM cov WHERE coverage >= 60")
def covered_genes(s, d):
    return depth.covered_genes(_coverage(s, d), 0.6).select("sample", "gene_id")


@register("msp_breadth", f"{_COVERAGE_SQL} SELECT sample, msp_name, count(DISTINCT gene_id) AS n_genes FROM cov JOIN core USING (gene_id) WHERE coverage >= 50 GROUP BY 1, 2 HAVING count(DISTINCT gene_id) >= 5 / 100.0 * {v.CORE_SIZE}")
def msp_breadth(s, d):
    return depth.covered_species(depth.covered_genes(_coverage(s, d), 0.5), _core(s, d), v.CORE_SIZE, 5)


@register("gene_ignore", "SELECT sample, gene_id, round_even(value, 0) < 3 AS ignored FROM counts")
def gene_ignore(s, d):
    return depth.split_by_depth(_counts(s, d), 3).select("sample", "gene_id", "ignored")


@register("msp_chunks", "SELECT msp_name, CAST(ntile(4) OVER (ORDER BY o, msp_name) AS INT) AS chunk FROM (SELECT msp_name, min(ord) AS o FROM msp GROUP BY 1)")
def msp_chunks(s, d):
    return depth.species_chunks(v.msp(s, d), 4)


# Consensus -----------------------------------------------------------------


@register("variant_dedupe", "SELECT sample, gene_id, start, ord, ref, alt, ro, ao FROM firsts")
def variant_dedupe(s, d):
    out = consensus.dedupe_variants(v.variants(s, d))
    return out.select("sample", "gene_id", "start", "ord", "ref", out["alts"][0].alias("alt"), "ro", out["ao"][0].alias("ao"))


@register("allele_selection", "SELECT sample, gene_id, start, CASE WHEN keep THEN ref || ',' || alt ELSE alt END AS alleles FROM chosen")
def allele_selection(s, d):
    out = consensus.choose_alleles(consensus.dedupe_variants(v.variants(s, d)), 0.8)
    return out.select("sample", "gene_id", "start", F.array_join("alleles", ",").alias("alleles"))


@register("iupac_encode", "SELECT sample, gene_id, start AS pos, code AS base FROM coded")
def iupac_encode(s, d):
    return consensus.variant_bases(v.variants(s, d), 0.8)


@register("mask_intervals", "SELECT sample, gene_id, count(*) AS n FROM (SELECT sample, gene_id, unnest(generate_series(0, 219)) AS pos FROM (SELECT DISTINCT sample, gene_id FROM segments)) p WHERE EXISTS (SELECT 1 FROM runs r WHERE r.depth < 3 AND r.sample = p.sample AND r.gene_id = p.gene_id AND p.pos >= r.startpos AND p.pos < r.endpos) GROUP BY 1, 2")
def mask_intervals(s, d):
    positions = v.segments(s, d).select("sample", "gene_id").distinct().withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(219))))
    inside = consensus.mask_positions(positions, depth.low_coverage_intervals(_runs(s, d), 3))
    return inside.groupBy("sample", "gene_id").agg(F.count(F.lit(1)).alias("n"))


_CONSENSUS_SQL = """, low AS (SELECT DISTINCT sample, gene_id FROM counts WHERE round_even(value, 0) < 1),
    spans AS (SELECT sample, gene_id, gene_id % 20 AS startpos, gene_id % 20 + 5 AS endpos FROM refs),
    letters AS (SELECT sample, gene_id, pos, substr(seq, pos + 1, 1) AS c FROM (SELECT *, unnest(generate_series(0, 63)) AS pos FROM refs)),
    edited AS (
      SELECT l.sample, l.gene_id, l.pos, CASE WHEN w.gene_id IS NOT NULL OR m.gene_id IS NOT NULL THEN 'N' ELSE coalesce(k.code, l.c) END AS c
      FROM letters l LEFT JOIN coded k ON k.sample = l.sample AND k.gene_id = l.gene_id AND k.start = l.pos LEFT JOIN low w ON w.sample = l.sample AND w.gene_id = l.gene_id
      LEFT JOIN spans m ON m.sample = l.sample AND m.gene_id = l.gene_id AND l.pos >= m.startpos AND l.pos < m.endpos),
    cons AS (SELECT sample, gene_id, string_agg(c, '' ORDER BY pos) AS seq FROM edited GROUP BY 1, 2)"""


def _consensus(s, d) -> DataFrame:
    refs = v.references(s, d)
    start = (F.col("gene_id") % 20).cast("int")
    masks = refs.select("sample", "gene_id", start.alias("startpos"), (start + 5).alias("endpos"))
    low = depth.split_by_depth(_counts(s, d), 1).where("ignored")
    return consensus.consensus(refs, v.variants(s, d), masks, low, 0.8)


@register("consensus_sequence", f"{_CONSENSUS_SQL} SELECT sample, gene_id, seq FROM cons")
def consensus_sequence(s, d):
    return _consensus(s, d)


@register("msp_concat", f"{_CONSENSUS_SQL}, cat AS (SELECT c.sample, m.msp_name, string_agg(c.seq, '' ORDER BY m.ord) AS seq FROM cons c JOIN msp m USING (gene_id) GROUP BY 1, 2) SELECT * FROM cat WHERE replace(seq, 'N', '') <> ''")
def msp_concat(s, d):
    return consensus.species_sequences(_consensus(s, d), v.msp(s, d))


@register("all_gap_filter", f"{_CONSENSUS_SQL} SELECT sample, gene_id, length(seq) > 0 AND replace(seq, 'N', '') = '' AS gaps FROM cons")
def all_gap_filter(s, d):
    return _consensus(s, d).select("sample", "gene_id", sequence.all_gap(F.col("seq")).alias("gaps"))


@register("pileup_variants", """WITH b AS (SELECT l_returnflag || l_linestatus AS sample, l_partkey % 50 AS gene_id, CAST(l_suppkey % 64 AS INT) AS pos, substr('ACGT', l_linenumber % 4 + 1, 1) AS base FROM lineitem),
    r AS (SELECT i.range AS gene_id, translate(md5(CAST(i.range AS VARCHAR) || 'a'), '0123456789abcdef', 'ACGTACGTACGTACGT') || translate(md5(CAST(i.range AS VARCHAR) || 'b'), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq FROM range(50) i),
    c AS (SELECT sample, gene_id, pos, base, count(*) AS n FROM b GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY sample, gene_id, pos) AS depth FROM c),
    x AS (SELECT t.*, substr(r.seq, pos + 1, 1) AS ref FROM t JOIN r USING (gene_id) WHERE depth >= 3)
    SELECT sample, gene_id, pos AS start, min(ref) AS ref, string_agg(base, ',' ORDER BY base) FILTER (base <> ref AND n::DOUBLE / depth >= 0.1) AS alts, CAST(coalesce(sum(n) FILTER (base = ref), 0) AS BIGINT) AS ro
    FROM x GROUP BY 1, 2, 3 HAVING count(*) FILTER (base <> ref AND n::DOUBLE / depth >= 0.1) > 0""", ctes=False)  # fmt: skip
def pileup_variants(s, d):
    li = v.table(s, d, "lineitem")
    bases = li.select(F.concat("l_returnflag", "l_linestatus").alias("sample"), (F.col("l_partkey") % 50).alias("gene_id"), (F.col("l_suppkey") % 64).cast("int").alias("pos"), F.substring(F.lit("ACGT"), F.col("l_linenumber") % 4 + 1, 1).alias("base"))
    out = consensus.pileup_variants(bases, v.references(s, d))
    return out.select("sample", "gene_id", "start", "ref", F.array_join("alts", ",").alias("alts"), "ro")


# Phylogeny -----------------------------------------------------------------

_SITES_SQL = """, sites AS (SELECT msp_name, CAST(pos AS INT) AS pos, avg(CASE WHEN substr(seq, pos + 1, 1) = 'N' THEN 1.0 ELSE 0.0 END) AS ratio FROM (SELECT *, unnest(generate_series(0, 63)) AS pos FROM seqs) GROUP BY 1, 2)"""


@register("site_gap_ratio", f"{_SITES_SQL} SELECT msp_name, pos, round(ratio, 6) AS ratio FROM sites")
def site_gap_ratio(s, d):
    return _round(phylo.site_gap_ratio(v.sequences(s, d)), "ratio")


@register("clean_sites", f"""{_SITES_SQL}, good AS (SELECT * FROM sites WHERE ratio <= 0.05)
    SELECT q.msp_name, q.sample, string_agg(substr(q.seq, g.pos + 1, 1), '' ORDER BY g.pos) AS seq FROM seqs q JOIN good g USING (msp_name)
    WHERE q.msp_name IN (SELECT msp_name FROM good GROUP BY 1 HAVING count(*) >= 10) GROUP BY 1, 2""")  # fmt: skip
def clean_sites(s, d):
    return phylo.clean_sites(v.sequences(s, d), 0.05, 10)


@register("sequence_info", """SELECT msp_name, sample, length(seq) AS total_length, length(regexp_replace(seq, '[^ACGTRYSWKMBDHV]', '', 'g')) AS "noN_info_count", length(regexp_replace(seq, '[^ACGT]', '', 'g')) AS "noIUPAC_info_count",
    100.0::DOUBLE * length(regexp_replace(seq, '[^ACGTRYSWKMBDHV]', '', 'g')) / length(seq) AS "noN_info_pc", 100.0::DOUBLE * length(regexp_replace(seq, '[^ACGT]', '', 'g')) / length(seq) AS "noIUPAC_info_pc" FROM seqs""")  # fmt: skip
def sequence_info(s, d):
    out = phylo.sequence_info(v.sequences(s, d))
    return out.withColumns({c: F.col(c).cast("long") for c in ("total_length", "noN_info_count", "noIUPAC_info_count")})


_PAIRS_SQL = """, pairs AS (SELECT a.msp_name, a.sample AS sample1, b.sample AS sample2, a.seq AS seq1, b.seq AS seq2 FROM seqs a JOIN seqs b ON a.msp_name = b.msp_name AND a.sample < b.sample),
    columns_ AS (SELECT msp_name, sample1, sample2, substr(seq1, i, 1) AS x, substr(seq2, i, 1) AS y FROM (SELECT *, unnest(generate_series(1, 64)) AS i FROM pairs)),
    tally AS (SELECT msp_name, sample1, sample2, count(*) FILTER (x <> 'N' AND y <> 'N') AS low, count(*) FILTER (x IN ('A','C','G','T') AND y IN ('A','C','G','T')) AS high,
      count(*) FILTER (x || y IN ('AG','GA')) AS ag, count(*) FILTER (x || y IN ('CT','TC')) AS ct, count(*) FILTER (x || y IN ('AC','CA','AT','TA','GC','CG','GT','TG')) AS tv,
      count(*) FILTER (x = 'A' AND y IN ('A','C','G','T')) + count(*) FILTER (y = 'A' AND x IN ('A','C','G','T')) AS na, count(*) FILTER (x = 'C' AND y IN ('A','C','G','T')) + count(*) FILTER (y = 'C' AND x IN ('A','C','G','T')) AS nc,
      count(*) FILTER (x = 'G' AND y IN ('A','C','G','T')) + count(*) FILTER (y = 'G' AND x IN ('A','C','G','T')) AS ng, count(*) FILTER (x = 'T' AND y IN ('A','C','G','T')) + count(*) FILTER (y = 'T' AND x IN ('A','C','G','T')) AS nt
      FROM columns_ GROUP BY 1, 2, 3),
    k AS (SELECT *, ag::DOUBLE / high AS p1, ct::DOUBLE / high AS p2, tv::DOUBLE / high AS q, na / (2.0 * high) AS fa, nc / (2.0 * high) AS fc, ng / (2.0 * high) AS fg, nt / (2.0 * high) AS ft FROM tally),
    r AS (SELECT *, fa + fg AS fr, fc + ft AS fy FROM k),
    e AS (SELECT *, 2 * fa * fg / fr AS k1, 2 * fc * ft / fy AS k2, 2 * (fr * fy - fa * fg * fy / fr - fc * ft * fr / fy) AS k3 FROM r),
    w AS (SELECT *, 1 - p1 / k1 - q / (2 * fr) AS w1, 1 - p2 / k2 - q / (2 * fy) AS w2, 1 - q / (2 * fr * fy) AS w3 FROM e),
    tn93 AS (SELECT msp_name, sample1, sample2, CASE WHEN p1 + p2 + q = 0 THEN 0.0
      WHEN w1 > 0 AND w2 > 0 AND w3 > 0 THEN greatest(-k1 * ln(w1) - k2 * ln(w2) - k3 * ln(w3), 0) END AS distance FROM w)"""


@register("pairwise_overlap", f"""{_PAIRS_SQL} SELECT msp_name, sample1, sample2, low AS "overlap_noN_info_count", high AS "overlap_noIUPAC_info_count", 100.0::DOUBLE * low / 64 AS "overlap_noN_info_pc", 100.0::DOUBLE * high / 64 AS "overlap_noIUPAC_info_pc" FROM tally""")
def pairwise_overlap(s, d):
    out = phylo.pairwise_comparison(v.sequences(s, d))
    return out.select("msp_name", "sample1", "sample2", F.col("overlap_noN_info_count").cast("long").alias("overlap_noN_info_count"), F.col("overlap_noIUPAC_info_count").cast("long").alias("overlap_noIUPAC_info_count"), "overlap_noN_info_pc", "overlap_noIUPAC_info_pc")


@register("tn93_distance", f"{_PAIRS_SQL} SELECT msp_name, sample1, sample2, round(distance, 6) AS distance FROM tn93")
def tn93_distance(s, d):
    return _round(phylo.tn93_distances(v.sequences(s, d)), "distance")


@register("distance_category", f"{_PAIRS_SQL} SELECT msp_name, sample1, sample2, CASE WHEN distance IS NULL THEN NULL WHEN distance <= 0.0001 THEN 'same_strain' WHEN distance <= 0.015 THEN 'same_subspecies' ELSE 'divergent' END AS distance_category FROM tn93")
def distance_category(s, d):
    out = phylo.pairwise_comparison(v.sequences(s, d), phylo.tn93_distances(v.sequences(s, d)))
    return out.select("msp_name", "sample1", "sample2", "distance_category")


@register("gtr_distance")
def gtr_distance(s, d):
    return _round(phylo.gtr_distances(v.sequences(s, d)), "distance")


@register("upgma_merges")
def upgma_merges(s, d):
    return _round(phylo.cluster(phylo.tn93_distances(v.sequences(s, d))), "height")


@register("cophenetic")
def cophenetic(s, d):
    return _round(phylo.cophenetic(phylo.tn93_distances(v.sequences(s, d))), "distance")


@register("newick_trees")
def newick_trees(s, d):
    return phylo.trees(phylo.tn93_distances(v.sequences(s, d)))


@register("tree_text")
def tree_text(s, d):
    return writers.tree_text(phylo.cluster(phylo.tn93_distances(v.sequences(s, d))))


# Sources and sinks ---------------------------------------------------------


@register("sample_name_parse", """SELECT s_suppkey, 'run' || s_suppkey || CASE s_suppkey % 4 WHEN 0 THEN '' ELSE '.x' END AS sample, CASE s_suppkey % 2 WHEN 0 THEN '1' ELSE '2' END AS tag FROM supplier""", ctes=False)
def sample_name_parse(s, d):
    sup = v.table(s, d, "supplier")
    key = F.col("s_suppkey")
    ends = F.element_at(F.array(*(F.lit(x) for x in (".fastq.gz", ".fq.xz", ".fastq", ".fq.bz2"))), (key % 4 + 1).cast("int"))
    stem = F.concat(F.lit("run"), key.cast("string"), F.when(key % 4 == 0, "").otherwise(".x"))
    name = F.concat(stem, F.when(key % 3 == 0, "_R").otherwise("_"), F.when(key % 2 == 0, "1").otherwise("2"), ends)
    return sup.select("s_suppkey", sequence.sample_name(name, paired=True).alias("sample"), sequence.pair_tag(name).alias("tag"))


@register("renumber_genes", """SELECT row_number() OVER (ORDER BY doc_id) AS gene_id, 'g' || doc_id AS gene_name, length(text) AS gene_length, text AS seq FROM documents WHERE length(text) > 0""", ctes=False)
def renumber_genes(s, d):
    docs = v.table(s, d, "documents")
    records = docs.select(F.concat(F.lit("g"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("seq"), F.col("doc_id").alias("ord"))
    return writers.renumber_genes(records).withColumn("gene_length", F.col("gene_length").cast("long"))


@register("shared_species", "SELECT msp_name, sample FROM seqs WHERE msp_name IN (SELECT msp_name FROM seqs GROUP BY 1 HAVING count(DISTINCT sample) > 1)")
def shared_species(s, d):
    return writers.shared_species(v.sequences(s, d)).select("msp_name", "sample")


@register("cigar_length", "SELECT o_orderkey, o_orderkey % 50 + 10 + o_orderkey % 3 + o_orderkey % 5 AS ali FROM orders", ctes=False)
def cigar_length(s, d):
    from biomeframe.functions.alignment import aligned_length

    k = F.col("o_orderkey")
    text = lambda x: x.cast("string")
    cigar = F.concat(F.lit("4S"), text(k % 50 + 10), F.lit("M"), text(k % 3), F.lit("I"), text(k % 5), F.lit("D"), F.lit("7=2X3H"))
    return v.table(s, d, "orders").select("o_orderkey", aligned_length(cigar).cast("long").alias("ali"))


@register("wrap_sequence", """SELECT doc_id, regexp_replace(regexp_replace(md5(text) || md5(text || 'x') || md5(text || 'y'), '(.{80})', '\\1' || chr(10), 'g'), chr(10) || '$', '') AS seq FROM documents WHERE text IS NOT NULL""", ctes=False)
def wrap_sequence(s, d):
    seq = F.concat(F.md5("text"), F.md5(F.concat("text", F.lit("x"))), F.md5(F.concat("text", F.lit("y"))))
    return v.table(s, d, "documents").where("text is not null").select("doc_id", sequence.wrap(seq).alias("seq"))


from biomeframe.plans import queries_more  # noqa: E402, F401
