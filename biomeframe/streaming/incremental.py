"""Counting newly arrived samples with Structured Streaming.

Counts of different samples are independent, so each micro-batch of whole samples is counted by the batch plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from biomeframe.operators.counting import gene_counts


def count_arrivals(alignments: DataFrame, genes: DataFrame, threshold: float, out: str, checkpoint: str, mode: str = "smart_shared") -> StreamingQuery:
    """Append count tables of the samples that arrive; a sample's alignments must arrive in one file.

    A batch that is run again after a failure overwrites its own folder, so results appear once.
    """

    def batch(df: DataFrame, number: int) -> None:
        gene_counts(df, genes, threshold, mode).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return alignments.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
