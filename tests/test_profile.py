"""Normalisation, rarefaction, species, functions and modules on the small catalogue."""

import pytest
from pyspark.sql import functions as F

from biomeframe.functions.modules import expand_definition, parse_modules
from biomeframe.operators import functional, normalize, taxa
from biomeframe.plans.config import MappingConfig, ProfileConfig
from biomeframe.plans.workflows import profile_samples

# The small catalogue of twenty genes whose results, below, are known numbers.
LENGTHS = [1000, 2000, 1500, 1000, 1000, 1000, 1000, 1000, 1000, 1000, 500, 750, 1000, 200, 100, 1000, 300, 200, 1000, 2000]
VALUES = [0, 20.3, 0.4, 49.8, 100.9, 10.1, 10, 0, 27.3, 0.2, 153, 12.4, 1.2, 0.9, 0, 0.5, 300, 75.3, 23, 27]
SPECIES = {"standard": ([5, 17, 18, 11, 4], [20]), "undetected": ([10, 15, 1, 13, 6], [14]), "small": ([13, 14, 10], [1]), "small_nd": ([3, 19, 8], [2])}
TERMS = [(1, 1), (2, 2), (4, 3), (5, 4), (6, 3), (6, 5), (7, 6), (10, 7), (11, 2), (13, 8), (17, 2), (20, 8)]
MODULES = {"mod1": "ARD1,ARD2", "mod2": "K8,K9", "mod3": "(K2 K3 K4),K1,(K2 K4),(K1 K8)", "mod4": "first second"}


@pytest.fixture(scope="module")
def counts(spark):
    rows = [("s", i + 1, n, float(x)) for i, (n, x) in enumerate(zip(LENGTHS, VALUES))]
    return spark.createDataFrame(rows, "sample string, gene_id long, gene_length int, value double").cache()


@pytest.fixture(scope="module")
def msp(spark):
    rows = [(s, g, f"gene_{g}", kind) for s, (core, rest) in SPECIES.items() for kind, gs in (("core", core), ("accessory", rest)) for g in gs]
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "msp_name string, gene_id long, gene_name string, gene_category string, ord int")


@pytest.fixture(scope="module")
def kegg(spark):
    return spark.createDataFrame([(g, f"gene_{g}", f"K{k}") for g, k in TERMS], "gene_id long, gene_name string, annotation string")


@pytest.fixture(scope="module")
def species(counts, msp):
    return taxa.msp_abundance(counts, taxa.core_genes(msp, 4), 0.5)


def values(df, key):
    return {r[key]: round(r["value"], 6) for r in df.collect()}


def test_coverage(spark):
    rows = [("s", i, n, float(x)) for i, (n, x) in enumerate(zip([80, 81, 160, 159, 200, 2000], [27, 58, 12, 99, 80, 89]))]
    df = spark.createDataFrame(rows, "sample string, gene_id long, gene_length int, value double")
    got = values(normalize.normalize_coverage(df, 80), "gene_id")
    assert list(got.values()) == pytest.approx([131.707317, 276.026175, 14.814815, 123.75, 66.115702, 4.633004], abs=1e-6)


def test_fpkm_with_unmapped(spark, counts):
    got = values(normalize.normalize_fpkm(counts, spark.createDataFrame([("s", 500)], "sample string, unmapped long")), "gene_id")
    assert [got[g] for g in (2, 11, 17, 20)] == [0.004142, 0.124875, 0.408088, 0.005509]
    total = sum(values(normalize.normalize_fpkm(counts), "gene_id").values())
    assert total == pytest.approx(1, abs=1e-4)


@pytest.mark.parametrize(
    "level, unmapped, expected",
    [
        (100, 0, [0, 2, 0, 5, 14, 0, 1, 0, 6, 0, 17, 1, 0, 0, 0, 0, 39, 9, 5, 1]),
        (900, 100, [0, 20, 0, 50, 100, 10, 10, 0, 27, 0, 152, 12, 1, 1, 0, 0, 295, 74, 23, 26]),
        (900, 0, [0, 20, 0, 50, 101, 10, 10, 0, 27, 0, 153, 12, 1, 1, 0, 0, 300, 75, 23, 27]),
    ],
)
def test_rarefy_exact(counts, level, unmapped, expected):
    got = values(normalize.rarefy_exact(counts, level, 12345, unmapped), "gene_id")
    assert [got[g] for g in range(1, 21)] == expected


def test_rarefy_hash(counts):
    got = values(normalize.rarefy_hash(counts, 100, 1), "gene_id")
    assert sum(got.values()) == 100
    assert all(got[i + 1] <= round(x) for i, x in enumerate(VALUES))
    assert got == values(normalize.rarefy_hash(counts.repartition(7), 100, 1), "gene_id")


def test_core_genes(msp):
    got = taxa.core_genes(msp, 4).groupBy("msp_name").agg(F.sort_array(F.collect_set("gene_id")).alias("g")).collect()
    assert {r["msp_name"]: r["g"] for r in got} == {"standard": [5, 11, 17, 18], "undetected": [1, 10, 13, 15], "small": [10, 13, 14], "small_nd": [3, 8, 19]}


def test_species(species, counts, msp):
    assert values(species, "msp_name") == {"standard": 157.3, "undetected": 0.35, "small": 0.766667, "small_nd": 7.8}
    assert taxa.msp_stats(counts, msp).collect()[0]["msp_signal"] == 0.94


def test_functions(counts, msp, kegg, species):
    assert values(functional.abundance_by_gene(counts, kegg), "annotation") == {"K1": 0, "K2": 473.3, "K3": 59.9, "K4": 100.9, "K5": 10.1, "K6": 10, "K7": 0.2, "K8": 28.2}
    got = values(functional.abundance_by_species(counts, msp, kegg, species), "annotation")
    assert got == {"K1": 0, "K2": 165.1, "K3": 157.65, "K4": 157.3, "K5": 0.35, "K6": 0, "K7": 1.116667, "K8": 158.416667}
    assert tuple(functional.annotation_stats(counts, kegg).select("signal", "genes").collect()[0]) == (0.827896, 10)
    assert tuple(functional.annotation_stats(counts, kegg, species, msp).select("signal", "genes").collect()[0]) == (0.815585, 9)


def test_modules(spark, counts, msp, kegg):
    rows = [(m, i, sorted(a)) for m, alts in parse_modules(MODULES).items() for i, a in enumerate(alts)]
    alternatives = spark.createDataFrame(rows, "mod_id string, alt_id int, terms array<string>")
    config = ProfileConfig(normalization="raw", core_size=4, msp_filter=0.5, completeness=0.6)
    got = profile_samples(counts, msp, config, {"kegg": kegg}, alternatives)
    done = {(r["msp_name"], r["mod_id"]): r["value"] for r in got.completeness.collect()}
    assert [done[s, "mod3"] for s in ("standard", "undetected", "small", "small_nd")] == [1.0, 0.5, 0.5, 0.5]
    assert [done[s, "mod2"] for s in ("standard", "undetected", "small", "small_nd")] == [1.0, 1.0, 1.0, 0.0]
    assert values(got.modules, "mod_id") == {"mod1": 0.0, "mod2": 158.416667, "mod3": 157.3, "mod4": 0.0}


@pytest.mark.parametrize(
    "text, expected",
    [
        ("K01639 ((K00885+K01788),K13967)", [{"K01639", "K00885", "K01788"}, {"K01639", "K13967"}]),
        ("(K00260,K00261) K00109 ((K01039+K01040)) K01726", [{"K00260", "K00109", "K01039", "K01040", "K01726"}, {"K00261", "K00109", "K01039", "K01040", "K01726"}]),
        ("K1 -K2 -- K3", [{"K1", "K3"}]),
        ("(K1,(K2+K3)) K4", [{"K1", "K4"}, {"K2", "K3", "K4"}]),
    ],
)
def test_definitions(text, expected):
    assert [set(a) for a in expand_definition(text)] == expected


def test_submodules_and_cycles():
    assert parse_modules({"A": "B K1", "B": "K2,K3"})["A"] == [frozenset({"K2", "K1"}), frozenset({"K3", "K1"})]
    with pytest.raises(ValueError):
        parse_modules({"A": "B", "B": "A"})
    with pytest.raises(ValueError):
        expand_definition("(K1,K2")


def test_config_checks():
    with pytest.raises(ValueError):
        ProfileConfig(normalization="tpm")
    with pytest.raises(ValueError):
        MappingConfig(identity=1.5)
