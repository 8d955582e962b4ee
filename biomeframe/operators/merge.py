"""Merging samples: filters on long tables, pivots, parameter checks, reports, taxonomy."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from biomeframe.functions.sequence import RANK_PREFIXES, rank_prefixed

#: Part of a threshold by which a sum of doubles may miss it: the last bits of a sum differ with the order of addition.
SLACK = 1e-12


def filter_rows(long: DataFrame, keys: list[str], min_abundance: float = 0.0, min_occurrence: int = 1) -> DataFrame:
    """Keys whose sum over samples is at least ``min_abundance`` and that are nonzero in ``min_occurrence`` samples.

    Sums of doubles reach ``min_abundance`` if they are short of it by no more than ``SLACK`` of it; other sums are exact.
    """
    if isinstance(long.select("value").schema[0].dataType, (DoubleType, FloatType)):
        min_abundance *= 1 - math.copysign(SLACK, min_abundance)
    kept = long.groupBy(*keys).agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("_s"), F.count_if(F.col("value") != 0).alias("_n"))
    kept = kept.where((F.col("_s") >= min_abundance) & (F.col("_n") >= min_occurrence)).select(*keys)
    return long.join(kept, keys, "left_semi")


def drop_empty_samples(long: DataFrame) -> DataFrame:
    """Rows of samples whose values don't sum to 0."""
    full = long.groupBy("sample").agg(F.sum("value").alias("_s")).where(F.col("_s") != 0).select("sample")
    return long.join(full, "sample", "left_semi")


def merge_samples(long: DataFrame, keys: list[str], samples: list[str] | None = None) -> DataFrame:
    """One row per key, one column per sample, null where a sample has no row; an N-way full outer join as one pivot."""
    pivoted = long.groupBy(*keys).pivot("sample", samples) if samples is not None else long.groupBy(*keys).pivot("sample")
    return pivoted.agg(F.first("value"))


def unpivot_samples(wide: DataFrame, keys: list[str]) -> DataFrame:
    samples = [c for c in wide.columns if c not in keys]
    return wide.unpivot([F.col(k) for k in keys], [F.col(f"`{c}`") for c in samples], "sample", "value").where("value is not null")


def parameter_mismatches(census: DataFrame) -> DataFrame:
    """Number of configurations (``path, config`` map) that differ from the one of the first path."""
    entries = census.select("path", F.array_sort(F.map_entries("config")).alias("c"))
    first = entries.agg(F.min_by("c", "path").alias("_first"))
    return entries.crossJoin(F.broadcast(first)).agg(F.count_if(F.col("c") != F.col("_first")).alias("mismatches"))


def missing_fields(census: DataFrame, section: str, required: list[str]) -> DataFrame:
    """``path, missing``: required fields that a section (map in column ``section``) lacks; ``[""]`` asks for none."""
    wanted = [r for r in required if r]
    have = F.coalesce(F.map_keys(section), F.array().cast("array<string>"))
    return census.select("path", F.array_except(F.array(*(F.lit(w) for w in wanted)).cast("array<string>"), have).alias("missing")).where(F.size("missing") > 0)


def report(census: DataFrame) -> DataFrame:
    """``sample`` and one column per field of any section; a later section wins.

    ``census``: sample, position (order of sections), fields (map<string, string>).
    """
    flat = census.select("sample", "position", F.explode("fields").alias("field", "value"))
    last = flat.groupBy("sample", "field").agg(F.max_by("value", "position").alias("value"))
    return last.groupBy("sample").pivot("field").agg(F.first("value"))


def restrict_taxonomy(taxonomy: DataFrame, merged: DataFrame) -> DataFrame:
    """Taxonomy of the species in a merged table."""
    return taxonomy.join(merged.select("msp_name").distinct(), "msp_name", "left_semi")


def prefixed_taxonomy(taxonomy: DataFrame) -> DataFrame:
    """Ranks with their prefixes, and the whole lineage."""
    ranks = [r for r in RANK_PREFIXES if r in taxonomy.columns]
    out = taxonomy.select("msp_name", *(rank_prefixed(r).alias(f"_{r}") for r in ranks))
    return out.select("msp_name", *(F.col(f"_{r}").alias(r) for r in ranks if r != "msp_name"), F.concat_ws(";", *(F.col(f"_{r}") for r in ranks)).alias("lineage"))


def biom_rows(long: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """One JSON string per species: its id, lineage and nonzero values by sample; metadata is joined by name."""
    values = long.where("value != 0").groupBy("msp_name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("sample", "value")))).alias("data"))
    named = values.join(prefixed_taxonomy(taxonomy), "msp_name", "left")
    return named.select("msp_name", F.to_json(F.struct(F.col("msp_name").alias("id"), F.split("lineage", ";").alias("taxonomy"), "data")).alias("row"))


def biom_lines(long: DataFrame, taxonomy: DataFrame, generated_by: str = "biomeframe", date: str = "") -> DataFrame:
    """``place, line, text``: a BIOM 1.0 document (a sparse taxon table) in lines, to be written in that order.

    Rows are the species with a value other than 0, in order of name, with their lineage joined by name; columns are the samples.
    Values are sparse triples, so no row of this table grows with the matrix.
    """
    from pyspark.sql.window import Window

    values = long.where("value != 0")
    species = values.select("msp_name").distinct().join(prefixed_taxonomy(taxonomy).select("msp_name", F.split("lineage", ";").alias("taxonomy")), "msp_name", "left")
    rows = species.withColumn("r", F.row_number().over(Window.orderBy("msp_name")) - 1)  # one row per species
    cols = long.select("sample").distinct().withColumn("c", F.row_number().over(Window.orderBy("sample")) - 1)  # one row per sample
    size = rows.agg(F.count(F.lit(1)).alias("nr")).crossJoin(cols.agg(F.count(F.lit(1)).alias("nc")))
    head = F.to_json(F.struct(
        F.lit(None).cast("string").alias("id"), F.lit("Biological Observation Matrix 1.0.0").alias("format"), F.lit("http://biom-format.org").alias("format_url"),
        F.lit("Taxon table").alias("type"), F.lit(generated_by).alias("generated_by"), F.lit(date).alias("date"), F.lit("sparse").alias("matrix_type"),
        F.lit("float").alias("matrix_element_type"), F.array("nr", "nc").alias("shape"),
    ))
    triple = F.concat(F.lit("["), F.col("r").cast("string"), F.lit(","), F.col("c").cast("string"), F.lit(","), F.col("value").cast("string"), F.lit("]"))
    entry = F.to_json(F.struct(F.col("msp_name").alias("id"), F.struct("taxonomy").alias("metadata")))
    column = F.concat(F.to_json(F.struct(F.col("sample").alias("id"))), F.lit(""))
    cells = values.join(F.broadcast(rows.select("msp_name", "r")), "msp_name").join(F.broadcast(cols), "sample")
    order = F.struct(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"))

    def part(df: DataFrame, place: int, line: F.Column, text: F.Column, last: F.Column) -> DataFrame:
        return df.select(F.lit(place).alias("place"), line.alias("line"), F.concat(text, F.when(last, "").otherwise(",")).alias("text"))

    zero = F.struct(F.lit(0).cast("long").alias("r"), F.lit(0).cast("long").alias("c"))
    fixed = lambda place, text: size.select(F.lit(place).alias("place"), zero.alias("line"), text.alias("text"))
    end = cells.agg(F.max(order).alias("end"))
    out = fixed(0, F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"rows":[')))
    out = out.unionByName(part(rows.crossJoin(F.broadcast(size)), 1, F.struct(F.col("r").cast("long").alias("r"), F.lit(0).cast("long").alias("c")), entry, F.col("r") == F.col("nr") - 1))
    out = out.unionByName(fixed(2, F.lit('],"columns":[')))
    out = out.unionByName(part(cols.crossJoin(F.broadcast(size)), 3, F.struct(F.lit(0).cast("long").alias("r"), F.col("c").cast("long").alias("c")), column, F.col("c") == F.col("nc") - 1))
    out = out.unionByName(fixed(4, F.lit('],"data":[')))
    out = out.unionByName(part(cells.crossJoin(F.broadcast(end)), 5, order, triple, order == F.col("end")))
    return out.unionByName(fixed(6, F.lit("]}")))
