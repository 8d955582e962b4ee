"""Sequence comparison, distances, clustering, and names."""

import math

import pytest
from pyspark.sql import functions as F

from biomeframe.functions import sequence
from biomeframe.operators import phylo

SEQS = "msp_name string, sample string, seq string"


@pytest.mark.parametrize(
    "seqs, expected",
    [
        (["??A", "A?A", "ACA", "A?A"], [0.25, 0.75, 0]),
        (["CC?TT", "CCC"], [0, 0, 0.5]),
        (["?", "?"], [1]),
    ],
)
def test_site_gap_ratio(spark, seqs, expected):
    df = spark.createDataFrame([("m", str(i), s) for i, s in enumerate(seqs)], SEQS)
    got = phylo.site_gap_ratio(df, "?").orderBy("pos").collect()
    assert [r["ratio"] for r in got] == expected


def test_clean_sites(spark):
    df = spark.createDataFrame([("m", "a", "A?GT"), ("m", "b", "AC?T"), ("n", "a", "??")], SEQS)
    got = {(r["msp_name"], r["sample"]): r["seq"] for r in phylo.clean_sites(df, 0.4, 2, "?").collect()}
    assert got == {("m", "a"): "AT", ("m", "b"): "AT"}


def test_pairwise(spark):
    rows = {"sample1": "GGCATTACCAGT", "sample2": "GGCATTACCAGT", "sample3": "GGMKNNNDDSSC", "sample4": "GNMKNNNDDSNC"}
    df = spark.createDataFrame([("m", k, s) for k, s in rows.items()], SEQS)
    dist = [("m", "sample1", "sample2", 0.00005), ("m", "sample1", "sample3", 0.008), ("m", "sample3", "sample4", 0.025)]
    got = {(r["sample1"], r["sample2"]): r for r in phylo.pairwise_comparison(df, spark.createDataFrame(dist, "msp_name string, sample1 string, sample2 string, distance double")).collect()}
    assert len(got) == 6
    assert (got["sample1", "sample2"]["overlap_noN_info_count"], got["sample1", "sample2"]["overlap_noIUPAC_info_count"]) == (12, 12)
    assert (got["sample1", "sample3"]["overlap_noN_info_count"], got["sample1", "sample3"]["overlap_noIUPAC_info_count"]) == (9, 3)
    assert [got[k]["distance_category"] for k in (("sample1", "sample2"), ("sample1", "sample3"), ("sample3", "sample4"), ("sample2", "sample4"))] == ["same_strain", "same_subspecies", "divergent", None]


def test_tn93_reduces_to_jukes_cantor(spark):
    # equal base frequencies, and differences spread evenly: 12 kinds of difference once, 36 equal sites
    pairs = [x + y for x in "ACGT" for y in "ACGT" if x != y]
    a, b = "".join(p[0] for p in pairs) + "ACGT" * 9, "".join(p[1] for p in pairs) + "ACGT" * 9
    df = spark.createDataFrame([("m", "a", a), ("m", "b", b)], SEQS)
    p = 12 / 48
    want = -0.75 * math.log(1 - 4 * p / 3)
    assert phylo.tn93_distances(df).collect()[0]["distance"] == pytest.approx(want)
    assert phylo.gtr_distances(df).collect()[0]["distance"] == pytest.approx(want)


def test_distance_edges(spark):
    df = spark.createDataFrame([("m", "a", "ACGT"), ("m", "b", "ACGT"), ("n", "a", "AAAA"), ("n", "b", "TTTT"), ("o", "a", "AC"), ("o", "b", "ACG")], SEQS)
    got = {r["msp_name"]: r["distance"] for r in phylo.tn93_distances(df).collect()}
    assert got == {"m": 0.0, "n": None}


def test_upgma(spark):
    d = [("m", "a", "b", 2.0), ("m", "a", "c", 6.0), ("m", "b", "c", 6.0), ("m", "a", "d", 10.0), ("m", "b", "d", 10.0), ("m", "c", "d", 10.0)]
    df = spark.createDataFrame(d, "msp_name string, sample1 string, sample2 string, distance double")
    assert [(r["left"], r["right"], r["height"]) for r in phylo.cluster(df).orderBy("step").collect()] == [("a", "b", 1.0), ("(a,b)", "c", 3.0), ("((a,b),c)", "d", 5.0)]
    assert phylo.trees(df).collect()[0]["newick"] == "(((a:1,b:1):2,c:3):2,d:5);"
    assert {(r["sample1"], r["sample2"]): r["distance"] for r in phylo.cophenetic(df).collect()} == {(a, b): x for _, a, b, x in d}


def one(spark, column):
    return spark.range(1).select(column).collect()[0][0]


@pytest.mark.parametrize("name, stem", [("run7.fastq.gz", "run7"), ("gut_day3.fq", "gut_day3"), ("v1.2_lane.fq.xz", "v1.2_lane"), ("v1.2_lane.fa", "v1.2_lane.fa")])
def test_strip_extension(spark, name, stem):
    assert one(spark, sequence.strip_extension(F.lit(name))) == stem


@pytest.mark.parametrize("name, tag, sample", [("gut_day3_R1.fastq", "1", "gut_day3"), ("v1.2_lane_2.fq.xz", "2", "v1.2_lane"), ("run.fastq.gz", None, None)])
def test_pairs(spark, name, tag, sample):
    assert one(spark, sequence.pair_tag(F.lit(name))) == tag
    assert one(spark, sequence.sample_name(F.lit(name), paired=True)) == sample


def test_mask(spark):
    assert one(spark, sequence.sample_name(F.lit("plate_W12_run.fastq"), mask=r"W\d+")) == "W12"
    assert one(spark, sequence.sample_name(F.lit("other.fastq"), mask=r"W\d+")) is None


def test_codes(spark):
    assert one(spark, sequence.iupac_code(F.array(F.lit("T"), F.lit("C"), F.lit("C")))) == "Y"
    assert one(spark, sequence.allele_codes(F.array(F.lit("ACG"), F.lit("AT")))) == ["A", "Y", "G"]
    assert one(spark, sequence.remove_edge_labels(F.lit("((p:2,q:3)edge.4:7,r:1)"))) == "((p:2,q:3):7,r:1)"
    assert one(spark, sequence.wrap(F.lit("A" * 160), 80)) == "A" * 80 + "\n" + "A" * 80
    assert [one(spark, sequence.all_gap(F.lit(x))) for x in ("NN", "NA", "")] == [True, False, False]
