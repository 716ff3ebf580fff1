"""Counts of genomes that keep arriving (an extension): only per-genome counts are incremental,
the vocabulary is global and is taken from the counts gathered so far."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from strandmatrix.operators.counting import count_per_genome
from strandmatrix.params import MatrixParams


def stream_counts(records: DataFrame, params: MatrixParams, path: str, checkpoint: str) -> StreamingQuery:
    """Appends (genome, kmer, freq) of each micro-batch of a streaming (genome, seq) frame as Parquet.

    Each batch writes a folder named by its number, so a replayed batch overwrites itself: exactly once.
    """

    def put(batch: DataFrame, number: int) -> None:
        count_per_genome(batch, params).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return records.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def gathered_counts(spark, path: str) -> DataFrame:
    """Counts over all batches so far; a genome that came in parts is summed."""
    got = spark.read.parquet(path)
    return got.groupBy("genome", "kmer").agg({"freq": "sum"}).withColumnRenamed("sum(freq)", "freq")
