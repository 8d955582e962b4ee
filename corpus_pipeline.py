"""The corpus pipeline: five stages over documents, each calling one of the training-data operators.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame;
all but the last return the columns of documents.  ``run`` applies them to documents, with each
stage's result written to the shared checkpoint folder and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biomeframe.llm import decontam, jaccard, lines, packing, quality
from biomeframe.llm._spark import cut, small


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose content share is high enough; the others go.

    The field is fitted on a bounded sample of the labelled documents among docs.
    """
    field = quality.train_field(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.filter_quality(docs, field)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many sites share; n_chars, if present, follows the text."""
    out = lines.dedup_lines(docs)
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("kept").alias("text"))
        elif c == "n_chars":
            columns.append(F.when(F.col("removed") > 0, F.length("kept").cast(docs.schema[c].dataType)).otherwise(F.col("row.n_chars")).alias(c))
        else:
            columns.append(F.col(f"row.`{c}`").alias(c))
    return out.select(*columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least doc_id, of each group of near copies."""
    return jaccard.keep_one_per_component(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark; contaminated ones go."""
    found = decontam.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = cut(found.where(F.size("spans") > 0).select("doc_id").distinct())
    return docs.join(small(hit), docs["doc_id"].eqNullSafe(hit["doc_id"]), "left_anti")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids, packed into sequences of at most 1024."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: The first stage's field and the tokeniser have no SQL form; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, in order, over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
