"""Further registered queries: edge cases of the engine, and sources and sinks by a write and a read of whole tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biomeframe.functions import misc, sequence
from biomeframe.functions.alignment import mapping_totals as totals_of
from biomeframe.operators import counting, depth, functional, merge, normalize, taxa
from biomeframe.plans import views as v
from biomeframe.plans.queries import _core, _counts, _covered_sparse, _round, _runs, _species, register
from biomeframe.plans.workflows import cached
from biomeframe.sources import readers, writers


def _folder(spark: SparkSession) -> str:
    """A new folder below the one the cluster shares; a temporary one in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not (spark.sparkContext.master or "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{shared or tempfile.mkdtemp(prefix='biomeframe-')}/io-{uuid.uuid4().hex}"


# Counting ------------------------------------------------------------------


@register("count_unique_lost_sample", """SELECT s.sample, g.gene_id, g.gene_length, coalesce(x.n, 0)::DOUBLE AS value FROM (SELECT sample FROM samples UNION SELECT 'ZZ') s CROSS JOIN genes g
    LEFT JOIN uniq x ON x.sample = s.sample AND x.gene_id = g.gene_id""")  # fmt: skip
def count_unique_lost_sample(s, d):
    """A sample none of whose reads is counted still has its zeros."""
    aln = v.alignments(s, d)
    lost = v.genes(s, d).select(F.lit("ZZ").alias("sample"), F.col("gene_id").cast("long").alias("read_id"), "gene_id", F.lit(100).alias("ali"), F.lit(50).alias("nm"))
    return counting.gene_counts(aln.unionByName(lost), v.genes(s, d), v.THRESHOLD, "unique")


@register("mapping_rate_totals", """SELECT t.sample, t.n AS total_reads, coalesce(c.n, 0) AS counted_reads, round_even(coalesce(c.n, 0)::DOUBLE / t.n * 100, 2) AS final_mapping_rate
    FROM (SELECT sample, count(*) * 2 + 7 AS n FROM aln GROUP BY 1) t LEFT JOIN (SELECT sample, count(DISTINCT read_id) AS n FROM hits GROUP BY 1) c USING (sample)""")  # fmt: skip
def mapping_rate_totals(s, d):
    """The rate over the aligner's totals, which count reads without any alignment."""
    aln = v.alignments(s, d)
    totals = aln.groupBy("sample").agg((F.count(F.lit(1)) * 2 + 7).alias("total_reads"))
    return counting.mapping_rate(aln, counting.best_hits(aln, v.THRESHOLD), totals=totals)


@register("aligner_totals", "SELECT s_suppkey, s_suppkey * 10 AS total_reads FROM supplier WHERE s_suppkey % 5 <> 0", ctes=False)
def aligner_totals(s, d):
    """Totals in summaries, of which every fifth is cut off."""
    k = F.col("s_suppkey")
    number = lambda n, text: F.concat(F.lit("    "), n.cast("string"), F.lit(f" (12.50%) {text}\n"))
    log = F.concat((k * 10).cast("string"), F.lit(" reads; of these:\n"), number(k * 10, "were unpaired; of these:"), number(k, "aligned 0 times"), number(k * 3, "aligned exactly 1 time"))
    log = F.when(k % 5 == 0, log).otherwise(F.concat(log, number(k * 6, "aligned >1 times"), F.lit("90.00% overall alignment rate\n")))
    return v.table(s, d, "supplier").select("s_suppkey", F.get(totals_of(log), 0).alias("total_reads")).where("total_reads is not null")


@register("cap_alignments", "SELECT sample, read_id, gene_id FROM (SELECT *, row_number() OVER (PARTITION BY sample, read_id ORDER BY (ali - nm)::DOUBLE / ali DESC, gene_id) AS r FROM aln) WHERE r <= 2")
def cap_alignments(s, d):
    return counting.cap_alignments(v.alignments(s, d), 2).select("sample", "read_id", "gene_id")


_UNMAPPED = "(SELECT sample, count(*) AS n FROM aln WHERE nm > 5 GROUP BY 1)"


@register("rarefy_hash_unmapped", f""", pool AS (SELECT sample, gene_id, CAST(round_even(value, 0) AS BIGINT) AS n FROM counts UNION ALL SELECT sample, -1, n FROM {_UNMAPPED}),
    reads AS (SELECT sample, gene_id, unnest(generate_series(1, n)) AS i FROM pool WHERE n > 0),
    kept AS (SELECT sample, gene_id, count(*) AS n FROM (
      SELECT *, row_number() OVER (PARTITION BY sample ORDER BY md5(gene_id || '|' || i || '|1234'), gene_id, i) AS r FROM reads) WHERE r <= 800 GROUP BY 1, 2)
    SELECT c.sample, c.gene_id, c.gene_length, coalesce(k.n, 0)::DOUBLE AS value FROM counts c LEFT JOIN kept k ON k.sample = c.sample AND k.gene_id = c.gene_id""")  # fmt: skip
def rarefy_hash_unmapped(s, d):
    """Rarefaction that also draws unmapped reads, a number per sample."""
    unmapped = v.alignments(s, d).where("nm > 5").groupBy("sample").agg(F.count(F.lit(1)).alias("unmapped"))
    return normalize.rarefy_hash(_counts(s, d), 800, 1234, unmapped)


@register("natural_join_names", """, named AS (SELECT p_partkey AS gene_id, p_type AS annotation FROM part WHERE p_partkey % 2 = 0),
    x AS (SELECT DISTINCT c.sample, t.annotation, m.msp_name FROM msp m JOIN named t USING (gene_id) JOIN covered c USING (gene_id) WHERE c.value > 0),
    y AS (SELECT x.sample, x.annotation, sum(mspv.value) AS value FROM x JOIN mspv ON mspv.sample = x.sample AND mspv.msp_name = x.msp_name GROUP BY 1, 2)
    SELECT s.sample, a.annotation, round(coalesce(y.value, 0), 6) AS value FROM (SELECT DISTINCT annotation FROM types) a CROSS JOIN (SELECT DISTINCT sample FROM mspv) s
    LEFT JOIN y ON y.sample = s.sample AND y.annotation = a.annotation""")  # fmt: skip
def natural_join_names(s, d):
    """Where both tables name their genes, the names must agree too; every other gene has another name here."""
    part = v.table(s, d, "part")
    terms = part.select(F.col("p_partkey").alias("gene_id"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise("another").alias("gene_name"), F.col("p_type").alias("annotation"))
    return _round(functional.abundance_by_species(_covered_sparse(s, d), v.msp(s, d), terms, _species(s, d)), "value")


# Depth and consensus -------------------------------------------------------


def _cigars(s: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    ops = F.element_at(F.array(F.lit("D"), F.lit("N"), F.lit("I")), (e % 3 + 1).cast("int"))
    cigar = F.concat(F.lit("3S"), (e % 20 + 1).cast("string"), F.lit("M"), (e % 4 + 1).cast("string"), ops, F.lit("8M2H"))
    return v.table(s, d, "events").select(F.col("event_type").alias("sample"), F.col("user_id").alias("gene_id"), (F.floor("value").cast("int") % 150).alias("pos"), cigar.alias("cigar"), F.when(e % 7 == 0, 0x400).otherwise(16).alias("flag"))


@register("depth_without_deletions", """, c AS (SELECT event_type AS sample, user_id AS gene_id, CAST(floor(value) AS INT) % 150 AS p, event_id % 20 + 1 AS a, CASE WHEN event_id % 3 < 2 THEN event_id % 4 + 1 ELSE 0 END AS gap FROM events WHERE event_id % 7 <> 0),
    b AS (SELECT sample, gene_id, unnest(generate_series(p, p + a - 1)) AS pos FROM c UNION ALL SELECT sample, gene_id, unnest(generate_series(p + a + gap, p + a + gap + 7)) FROM c),
    n AS (SELECT sample, gene_id, count(*) AS numreads FROM c GROUP BY 1, 2)
    SELECT n.sample, n.gene_id, n.numreads, count(DISTINCT pos) AS covbases, round(count(*)::DOUBLE / 220, 6) AS meandepth FROM n JOIN b ON b.sample = n.sample AND b.gene_id = n.gene_id WHERE pos < 220 GROUP BY 1, 2, 3""")  # fmt: skip
def depth_without_deletions(s, d):
    """Reads with deletions, skips and insertions: coverage counts matched bases only, and each read once."""
    segments, genes = depth.segments_of(_cigars(s, d)), v.segment_genes(s, d)
    out = depth.gene_coverage(depth.depth_runs(segments, genes), segments, genes)
    return _round(out.select("sample", "gene_id", "numreads", "covbases", "meandepth"), "meandepth")


@register("depth_cap", """, capped AS (SELECT sample, gene_id, startpos, endpos, CAST(least(depth, 2) AS INT) AS depth FROM steps WHERE endpos IS NOT NULL),
    fl AS (SELECT *, CASE WHEN lag(depth) OVER (PARTITION BY sample, gene_id ORDER BY startpos) = depth THEN 0 ELSE 1 END AS fresh FROM capped),
    isl AS (SELECT *, sum(fresh) OVER (PARTITION BY sample, gene_id ORDER BY startpos) AS i FROM fl)
    SELECT sample, gene_id, min(startpos) AS startpos, max(endpos) AS endpos, min(depth) AS depth FROM isl GROUP BY sample, gene_id, i""")  # fmt: skip
def depth_cap(s, d):
    return depth.depth_runs(v.segments(s, d), v.segment_genes(s, d), 2)


@register("mnv_codes", """WITH k AS (SELECT o_orderkey, substr('ACGT', CAST(o_orderkey % 4 + 1 AS INT), 1) AS a1, substr('ACGT', CAST(o_orderkey // 4 % 4 + 1 AS INT), 1) AS a2, substr('ACGT', CAST(o_orderkey // 16 % 4 + 1 AS INT), 1) AS a3,
      substr('ACGT', CAST(o_orderkey // 3 % 4 + 1 AS INT), 1) AS b1, substr('ACGT', CAST(o_orderkey // 7 % 4 + 1 AS INT), 1) AS b2 FROM orders),
    t(p, c) AS (VALUES ('AA','A'), ('CC','C'), ('GG','G'), ('TT','T'), ('AG','R'), ('CT','Y'), ('CG','S'), ('AT','W'), ('GT','K'), ('AC','M'))
    SELECT o_orderkey, x.c || y.c || a3 AS codes FROM k JOIN t x ON x.p = least(a1, b1) || greatest(a1, b1) JOIN t y ON y.p = least(a2, b2) || greatest(a2, b2)""", ctes=False)  # fmt: skip
def mnv_codes(s, d):
    """Codes along alleles of several bases and different lengths."""
    k = F.col("o_orderkey")
    base = lambda x: F.substr(F.lit("ACGT"), (F.floor(x) % 4 + 1).cast("int"), F.lit(1))
    alleles = F.array(F.concat(base(k), base(k / 4), base(k / 16)), F.concat(base(k / 3), base(k / 7)))
    return v.table(s, d, "orders").select("o_orderkey", F.array_join(sequence.allele_codes(alleles), "").alias("codes"))


@register("edge_labels", "SELECT s_suppkey, '(a' || s_suppkey || ':1,(b:2,c:3):0.5);' AS newick FROM supplier", ctes=False)
def edge_labels(s, d):
    tree = F.concat(F.lit("(a"), F.col("s_suppkey").cast("string"), F.lit(":1,(b:2,c:3)edge."), F.col("s_suppkey").cast("string"), F.lit(":0.5);"))
    return v.table(s, d, "supplier").select("s_suppkey", sequence.remove_edge_labels(tree).alias("newick"))


@register("versions", "SELECT s_suppkey, s_suppkey || '.' || s_suppkey % 7 AS version, s_suppkey > 20 OR (s_suppkey = 20 AND s_suppkey % 7 >= 3) AS recent, strftime(current_date, '%Y-%m-%d') AS day FROM supplier", ctes=False)
def versions(s, d):
    k = F.col("s_suppkey")
    numbers = misc.version_numbers(F.concat(F.lit("tool version "), k.cast("string"), F.lit("."), (k % 7).cast("string"), F.lit(" of today")))
    return v.table(s, d, "supplier").select("s_suppkey", F.array_join(F.transform(numbers, lambda x: x.cast("string")), ".").alias("version"), (numbers >= F.array(F.lit(20), F.lit(3))).alias("recent"), misc.today().alias("day"))


@register("files_per_sample", "SELECT CAST(o_custkey % 500 AS VARCHAR) AS sample, count(*) AS count FROM orders GROUP BY 1 HAVING count(*) > 1", ctes=False)
def files_per_sample(s, d):
    paths = v.table(s, d, "orders").select(F.concat(F.lit("/profiles/"), (F.col("o_custkey") % 500).cast("string"), F.lit("/"), F.col("o_orderkey").cast("string"), F.lit(".tsv")).alias("path"))
    return readers.files_per_sample(paths)


# Written and read ----------------------------------------------------------


@register("tsv_table", "SELECT p_partkey AS gene_id, p_name AS gene_name, p_size AS gene_length FROM part", ctes=False)
def tsv_table(s, d):
    path = _folder(s) + ".tsv"
    v.table(s, d, "part").select(F.col("p_partkey").alias("gene_id"), F.col("p_name").alias("gene_name"), F.col("p_size").alias("gene_length")).write.csv(path, sep="\t", header=True)
    return readers.read_tsv(s, path, readers.GENES)


@register("count_table_files", "SELECT sample, gene_id, gene_length, round(value, 6) AS value FROM counts")
def count_table_files(s, d):
    path = _folder(s)
    writers.write_by_sample(_counts(s, d), path, ["gene_id"])
    return _round(s.read.parquet(path), "value")


@register("count_table_tsv", "SELECT sample, gene_id, gene_length, round(value, 6) AS value FROM counts")
def count_table_tsv(s, d):
    path = _folder(s)
    writers.write_tsv(_counts(s, d), path)
    return _round(s.read.schema(f"{readers.COUNTS}, sample string").csv(path, sep="\t", header=True), "value")


@register("fasta_records", "SELECT 'g' || doc_id AS id, md5(text) || md5(text || 'x') || md5(text || 'y') AS seq FROM documents WHERE text IS NOT NULL", ctes=False)
def fasta_records(s, d):
    """Wrapped sequences under headers that hold the character that begins a header."""
    path = _folder(s)
    seq = F.concat(F.md5("text"), F.md5(F.concat("text", F.lit("x"))), F.md5(F.concat("text", F.lit("y"))))
    rows = v.table(s, d, "documents").where("text is not null").select(F.concat(F.lit("g"), F.col("doc_id").cast("string"), F.lit(" a->b >c")).alias("id"), seq.alias("seq"))
    writers.write_fasta(rows, path, width=40)
    return readers.read_fasta(s, path)


@register("sam_alignments", """SELECT l_partkey AS gene_id, CAST(p_size * 7 + 13 AS INT) AS gene_length, count(*) AS n, CAST(sum(CAST(round(l_discount * 100) AS INT)) AS BIGINT) AS nm, CAST(sum(l_linenumber * 3) AS BIGINT) AS pos, CAST(sum(l_suppkey % 50 + 12) AS BIGINT) AS ali
    FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2""", ctes=False)  # fmt: skip
def sam_alignments(s, d):
    """Alignments and the reference dictionary of a SAM text."""
    from biomeframe.functions.alignment import aligned_length

    path = _folder(s)
    head = v.genes(s, d).select(F.concat(F.lit("@SQ\tSN:"), F.col("gene_id").cast("string"), F.lit("\tLN:"), F.col("gene_length").cast("string")).alias("value"))
    c = lambda name: F.col(name).cast("string")
    cigar = F.concat((F.col("l_suppkey") % 50 + 10).cast("string"), F.lit("M2D"))
    body = v.table(s, d, "lineitem").select(F.concat_ws("\t", c("l_orderkey"), F.lit("0"), c("l_partkey"), (F.col("l_linenumber") * 3 + 1).cast("string"), F.lit("9"), cigar, F.lit("*"), F.lit("0"), F.lit("0"), F.lit("ACGT"), F.lit("IIII"), F.concat(F.lit("NM:i:"), F.round(F.col("l_discount") * 100).cast("int").cast("string"))).alias("value"))
    head.unionByName(body).unionByName(body.limit(1).select(F.lit("r\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII").alias("value"))).write.text(path)
    aln, genes = readers.read_sam(s, path)
    got = aln.groupBy("gene_id").agg(F.count(F.lit(1)).alias("n"), F.sum("nm").alias("nm"), F.sum("pos").alias("pos"), F.sum(aligned_length(F.col("cigar"))).alias("ali"))
    return got.join(genes, "gene_id").select("gene_id", "gene_length", "n", "nm", "pos", "ali")


@register("vcf_variants", """SELECT o_orderkey AS gene_id, CAST(o_custkey AS INT) AS start, 'A' AS ref, CASE WHEN o_orderkey % 3 = 0 THEN 'C,G' ELSE 'T' END AS alts, CAST(o_orderkey % 90 AS INT) AS ro,
    CASE WHEN o_orderkey % 3 = 0 THEN '4,' || o_custkey % 9 ELSE CAST(o_custkey % 9 AS VARCHAR) END AS ao FROM orders""", ctes=False)  # fmt: skip
def vcf_variants(s, d):
    path = _folder(s)
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    many = k % 3 == 0
    count = F.when(many, F.concat(F.lit("4,"), (c % 9).cast("string"))).otherwise((c % 9).cast("string"))
    info = F.concat(F.lit("DP=9;RO="), (k % 90).cast("string"), F.lit(";AO="), count, F.lit(";TYPE=snp"))
    rows = v.table(s, d, "orders").select(F.concat_ws("\t", k.cast("string"), (c + 1).cast("string"), F.lit("."), F.lit("A"), F.when(many, "C,G").otherwise("T"), F.lit("50"), F.lit("PASS"), info, F.lit("GT"), F.lit("1")).alias("value"))
    s.range(1).select(F.lit("##fileformat=VCFv4.2").alias("value")).unionByName(rows).write.text(path)
    out = readers.read_vcf(s, path)
    return out.select("gene_id", "start", "ref", F.array_join("alts", ",").alias("alts"), "ro", F.array_join(F.transform("ao", lambda x: x.cast("string")), ",").alias("ao"))


@register("bed_genes", "SELECT p_partkey AS gene_id FROM part", ctes=False)
def bed_genes(s, d):
    path = _folder(s)
    writers.write_bed(v.genes(s, d), path)
    return readers.read_bed_genes(s, path)


@register("bed_chunks", "SELECT CAST(ntile(4) OVER (ORDER BY o, msp_name) AS INT) AS chunk, msp_name FROM (SELECT msp_name, min(ord) AS o FROM msp GROUP BY 1)")
def bed_chunks(s, d):
    """Species by the chunk in whose BED files their genes stand."""
    path = _folder(s)
    chunks = depth.species_chunks(v.msp(s, d), 4)
    writers.write_chunks(v.msp(s, d).join(v.genes(s, d), "gene_id"), chunks, path)
    bed = s.read.text(path).select(F.col("chunk").cast("int").alias("chunk"), F.split("value", "\t")[0].cast("long").alias("gene_id"))
    return bed.join(v.msp(s, d), "gene_id").select("chunk", "msp_name").distinct()


@register("census_files", "SELECT n_name AS sample_name, CAST(n_nationkey AS VARCHAR) AS reads, '[\"a\",\"' || n_regionkey || '\"]' AS files FROM nation", ctes=False)
def census_files(s, d):
    """Metadata of one folder per sample, read with its uniqueness rules."""
    path = _folder(s)
    section = F.struct(F.struct(F.col("n_name").alias("sample_name"), F.array(F.lit("a"), F.col("n_regionkey").cast("string")).alias("files")).alias("sample_info"), F.struct(F.col("n_nationkey").alias("reads")).alias("mapping"))
    v.table(s, d, "nation").repartition("n_nationkey").select(F.col("n_nationkey").alias("folder"), F.to_json(section).alias("value")).write.partitionBy("folder").text(path)
    census = readers.unique_census(readers.read_census(s, path, "*.txt"))
    info = census.where("section = 'sample_info'").select("path", F.col("fields")["sample_name"].alias("sample_name"), F.col("fields")["files"].alias("files"))
    return info.join(census.where("section = 'mapping'").select("path", F.col("fields")["reads"].alias("reads")), "path").drop("path")


@register("file_digests", "SELECT CAST(r_regionkey AS VARCHAR) AS folder, md5(r_name || chr(10)) AS md5 FROM region", ctes=False)
def file_digests(s, d):
    path = _folder(s)
    v.table(s, d, "region").repartition("r_regionkey").select(F.col("r_regionkey").alias("folder"), F.col("r_name").alias("value")).write.partitionBy("folder").text(path)
    return readers.file_digests(s, path, "*.txt").select(F.regexp_extract("path", r"folder=(\d+)", 1).alias("folder"), "md5")


@register("matrix_file", "SELECT msp_name, max(CASE WHEN sample = 'AF' THEN round(value, 6) END) AS af, max(CASE WHEN sample = 'RO' THEN round(value, 6) END) AS ro FROM mspv GROUP BY 1")
def matrix_file(s, d):
    path = _folder(s)
    writers.write_matrix(merge.merge_samples(_round(_species(s, d), "value"), ["msp_name"], ["AF", "RO"]), path)
    return s.read.csv(path, sep="\t", header=True).select("msp_name", F.col("AF").cast("double").alias("af"), F.col("RO").cast("double").alias("ro"))


@register("core_alignment_files", "SELECT sample, gene_id, count(*) AS n, CAST(sum(nm) AS BIGINT) AS nm FROM aln WHERE gene_id IN (SELECT gene_id FROM core) GROUP BY 1, 2")
def core_alignment_files(s, d):
    """Alignments on core genes, written in coordinate order and read again."""
    path = _folder(s)
    writers.write_alignments(counting.core_alignments(v.alignments(s, d), _core(s, d)).withColumn("pos", F.col("nm")), path)
    return s.read.parquet(path).groupBy("sample", "gene_id").agg(F.count(F.lit(1)).alias("n"), F.sum("nm").alias("nm"))


@register("biom_document", """SELECT m.msp_name, m.sample, round(m.value, 6) AS value, 'k__' || superkingdom || ';p__' || phylum || ';s__' || species || ';t__' || m.msp_name AS lineage
    FROM mspv m LEFT JOIN taxonomy t USING (msp_name) WHERE round(m.value, 6) <> 0""")  # fmt: skip
def biom_document(s, d):
    """The written document, parsed and put together again."""
    path = _folder(s)
    species = cached(s, f"{path}-species", lambda: _round(_species(s, d), "value"))  # the document's parts each read the table
    writers.write_biom(merge.biom_lines(species, v.taxonomy(s, d)), path)
    kind = "rows array<struct<id:string,metadata:struct<taxonomy:array<string>>>>, columns array<struct<id:string>>, data array<array<double>>"
    doc = s.read.text(f"{path}/*.txt", wholetext=True).select(F.from_json("value", kind).alias("b"))
    cell = doc.select("b", F.explode("b.data").alias("x")).select("b", F.col("x")[0].cast("int").alias("r"), F.col("x")[1].cast("int").alias("c"), F.col("x")[2].alias("value"))
    row = F.get("b.rows", F.col("r"))
    lineage = F.when(row["metadata"]["taxonomy"].isNotNull(), F.array_join(row["metadata"]["taxonomy"], ";"))
    return cell.select(row["id"].alias("msp_name"), F.get("b.columns", F.col("c"))["id"].alias("sample"), "value", lineage.alias("lineage"))


@register("cached_runs", "SELECT sample, gene_id, startpos, endpos, depth FROM runs WHERE depth > 1")
def cached_runs(s, d):
    """An intermediate table that a restarted job finds written."""
    path = _folder(s)
    cached(s, path, lambda: _runs(s, d).where("depth > 1"))

    def again() -> DataFrame:
        raise AssertionError("the table was there")

    return cached(s, path, again)


@register("sparse_species", "SELECT sample, msp_name, round(value, 6) AS value FROM mspv")
def sparse_species(s, d):
    """Species abundance from counts without zeros, equal to that from the dense table."""
    return _round(taxa.msp_abundance(_covered_sparse(s, d), _core(s, d), v.MSP_FILTER, v.genes(s, d), v.alignments(s, d)), "value")
