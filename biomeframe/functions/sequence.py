"""Expressions on nucleotide sequences and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# IUPAC codes by their sorted bases.
IUPAC = {
    "A": "A",
    "C": "C",
    "G": "G",
    "T": "T",
    "AG": "R",
    "CT": "Y",
    "CG": "S",
    "AT": "W",
    "GT": "K",
    "AC": "M",
    "CGT": "B",
    "AGT": "D",
    "ACT": "H",
    "ACG": "V",
    "ACGT": "N",
}
# Letters with any information and with full information, and the largest distances of the categories.
MINIMAL_INFO = "ACGTRYSWKMBDHV"
MAXIMAL_INFO = "ACGT"
SAME_STRAIN, SAME_SUBSPECIES = 0.0001, 0.015

# Parts of read-file names, in the order in which they are tried.
SEPARATORS = ("_R", ".R", "_", ".", "")
EXTENSIONS = (".fq", ".fastq")
COMPRESSIONS = (".gz", ".bz2", ".xz", "")

# Prefixes of taxonomic ranks.
RANK_PREFIXES = {"superkingdom": "k__", "phylum": "p__", "class": "c__", "order": "o__", "family": "f__", "genus": "g__", "species": "s__", "msp_name": "t__"}


def iupac_code(bases: Column) -> Column:
    """The code of a set of bases (array of single letters); null for a set that has none."""
    table = F.create_map(*(F.lit(x) for pair in IUPAC.items() for x in pair))
    return F.try_element_at(table, F.array_join(F.array_sort(F.array_distinct(bases)), ""))


def allele_codes(alleles: Column) -> Column:
    """Codes per offset of aligned alleles (array of strings); shorter alleles don't contribute beyond their end."""
    longest = F.array_max(F.transform(alleles, lambda a: F.length(a)))
    at = lambda i: F.filter(F.transform(alleles, lambda a: F.substring(a, i, 1)), lambda b: b != "")
    return F.transform(F.sequence(F.lit(1), longest), lambda i: iupac_code(at(i)))


def info_count(seq: Column, letters: str) -> Column:
    return F.length(F.regexp_replace(F.upper(seq), f"[^{letters}]", ""))


def all_gap(seq: Column, gap: str = "N") -> Column:
    """Whether a sequence is nothing but gaps; an empty one is not."""
    return (F.length(seq) > 0) & (F.length(F.replace(seq, F.lit(gap), F.lit(""))) == 0)


def distance_category(distance: Column) -> Column:
    return F.when(distance <= SAME_STRAIN, "same_strain").when(distance <= SAME_SUBSPECIES, "same_subspecies").otherwise("divergent")


def wrap(seq: Column, width: int = 80) -> Column:
    """Line breaks after each full line, none at the end."""
    return F.regexp_replace(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), r"\n$", "")


def remove_edge_labels(newick: Column) -> Column:
    return F.regexp_replace(newick, r"\b(edge\.\d+):\b", ":")


def _pattern(tag: str | None) -> str:
    ends = "|".join(e.replace(".", r"\.") for e in EXTENSIONS)
    packs = "|".join(c.replace(".", r"\.") for c in COMPRESSIONS if c)
    marks = "" if tag is None else "(?:" + "|".join(s.replace(".", r"\.") for s in SEPARATORS if s) + f")?{tag}"
    return f"{marks}(?:{ends})(?:{packs})?$"


def strip_extension(name: Column) -> Column:
    """A read file's name without its extension and compression."""
    return F.regexp_replace(name, _pattern(None), "")


def pair_tag(name: Column) -> Column:
    """``1`` or ``2`` for the files of a pair, else null."""
    return F.when(name.rlike(_pattern("1")), "1").when(name.rlike(_pattern("2")), "2")


def sample_name(name: Column, paired: bool = False, mask: str | None = None) -> Column:
    """Sample of a read file; null where a pair's tag is missing or the mask doesn't match."""
    if paired:
        stem = F.when(pair_tag(name) == "1", F.regexp_replace(name, _pattern("1"), "")).when(pair_tag(name) == "2", F.regexp_replace(name, _pattern("2"), ""))
    else:
        stem = strip_extension(name)
    return F.nullif(F.regexp_extract(stem, mask, 0), F.lit("")) if mask else stem


def rank_prefixed(rank: str) -> Column:
    return F.concat(F.lit(RANK_PREFIXES[rank]), F.col(f"`{rank}`"))
