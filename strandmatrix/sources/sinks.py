"""Output files of a run: three .npy arrays, the vocabulary and count CSV, the statistics text; FASTA and Parquet from the executors."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UINT32_MAX = 2**32 - 1
_KINDS = {"bigint": "<i8", "int": "<i4", "float": "<f4", "double": "<f8"}


def _batches(df: DataFrame) -> Iterator[dict[str, np.ndarray]]:
    """Column arrays of a frame of numbers without nulls, an Arrow batch at a time, as bytes that executors packed."""
    kinds = {c: _KINDS[kind] for c, kind in df.dtypes}

    def packed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([x.to_numpy(zero_copy_only=False).astype(k).tobytes()], pa.binary()) for x, k in zip(b.columns, kinds.values())], list(kinds))

    for row in df.mapInArrow(packed, ", ".join(f"{c} binary" for c in kinds)).toLocalIterator(prefetchPartitions=True):
        yield {c: np.frombuffer(x, k) for (c, k), x in zip(kinds.items(), row)}


def write_npy(entries: DataFrame, pointer: DataFrame, directory: str, suffix: str) -> dict[str, str]:
    """data (float32), column (uint32) and row (int64) arrays, each placed by its pos.

    Files are memory-mapped and filled batch by batch, in any order. A column index
    beyond uint32 raises instead of wrapping.
    """
    os.makedirs(directory, exist_ok=True)
    names = {x: os.path.join(directory, f"{x}_{suffix}.npy") for x in ("data", "row", "column")}
    size = pointer.agg(F.max("pos"), F.max("ptr")).first()
    n_rows, nnz = int(size[0]), int(size[1])
    row = np.zeros(n_rows + 1, np.int64)
    for b in _batches(pointer.select("pos", "ptr")):
        row[b["pos"]] = b["ptr"]
    np.save(names["row"], row)
    if not nnz:
        np.save(names["data"], np.zeros(0, np.float32))
        np.save(names["column"], np.zeros(0, np.uint32))
        return names
    data = np.lib.format.open_memmap(names["data"], "w+", np.float32, (nnz,))
    column = np.lib.format.open_memmap(names["column"], "w+", np.uint32, (nnz,))
    for b in _batches(entries.select("pos", F.col("col").cast("long").alias("col"), "value")):
        if len(b["col"]) and int(b["col"].max()) > UINT32_MAX:
            raise OverflowError("a column index does not fit in uint32")
        data[b["pos"]], column[b["pos"]] = b["value"], b["col"]
    data.flush()
    column.flush()
    return names


def write_vocabulary(vocab: DataFrame, directory: str, suffix: str) -> str:
    """set_of_all_unique_kmers_<suffix>.csv with header index,K-mer in index order."""
    path = os.path.join(directory, f"set_of_all_unique_kmers_{suffix}.csv")

    def lines(batches):
        for b in batches:
            text = "".join(f"{i},{k}\n" for i, k in zip(b[0].to_pylist(), b[1].to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array([text], pa.string())], ["text"])

    with open(path, "w", encoding="utf-8") as out:
        out.write("index,K-mer\n")
        for r in vocab.select("index", "kmer").sort("index").mapInArrow(lines, "text string").toLocalIterator(prefetchPartitions=True):
            out.write(r.text)
    return path


def write_counts_csv(counts: DataFrame, directory: str, genome: str | None = None) -> str:
    """Counts (kmer, freq) as CSV with header K-mer,Frequency, written by the executors; with `genome`, a folder <genome>=<value> for each."""
    cols = [F.col("kmer").alias("K-mer"), F.col("freq").alias("Frequency")]
    if genome is None:
        counts.select(*cols).write.csv(directory, header=True)
    else:
        counts.select(genome, *cols).repartition(genome).write.partitionBy(genome).csv(directory, header=True)
    return directory


def write_fasta(records: DataFrame, directory: str) -> DataFrame:
    """Writes (row, header, seq) records as FASTA, a folder row=<row> for each genome, and returns (row, path) of its files.

    Every genome is one file, so its records are one task's; a null sequence is an empty one.
    """
    text = F.concat(F.lit(">"), F.col("header").cast("string"), F.lit("\n"), F.coalesce("seq", F.lit("")))
    records.select("row", text.alias("value")).repartition("row").write.partitionBy("row").text(directory)
    return records.sparkSession.read.text(directory).select("row", F.col("_metadata.file_path").alias("path")).distinct()


def write_list(paths: DataFrame, directory: str) -> str:
    """Writes a genome list, (row, path) in the order of row, behind a comment and a blank line. A list has a line a genome."""
    paths.coalesce(1).sort("row").select(F.when(F.col("row") == 0, F.concat(F.lit("# genomes\n\n"), "path")).otherwise(F.col("path")).alias("value")).write.text(directory)
    return directory


def write_tables(matrix, directory: str) -> None:
    """The distributed form of the same output: Parquet written by executors, for matrices too large for one machine."""
    matrix.coo.write.mode("overwrite").parquet(f"{directory}/coo")
    matrix.vocabulary.write.mode("overwrite").parquet(f"{directory}/vocabulary")
    matrix.row_pointer.write.mode("overwrite").parquet(f"{directory}/row_pointer")


def write_stats(lines: list[tuple[str, object]], directory: str, suffix: str) -> str:
    """feature_matrix_stats_<suffix>.txt of Name: value lines."""
    path = os.path.join(directory, f"feature_matrix_stats_{suffix}.txt")
    with open(path, "w", encoding="utf-8") as out:
        out.writelines(f"{k}: {v}\n" for k, v in lines)
    return path


def read_stats(path: str) -> dict[str, str]:
    """Name -> value of a statistics file."""
    with open(path, encoding="utf-8") as f:
        return dict(line.rstrip("\n").split(": ", 1) for line in f)


def _peak(batches):
    """The most memory, in bytes, that the JVM above this Python worker has held."""
    for _ in batches:
        pid, top = os.getpid(), 0
        while pid > 1:
            try:
                with open(f"/proc/{pid}/status", encoding="utf-8") as f:
                    status = dict(line.rstrip("\n").split(":\t", 1) for line in f if ":\t" in line)
            except OSError:  # no such file system here
                break
            if status["Name"].strip() == "java":
                top = int(status.get("VmHWM", "0 kB").split()[0]) * 1024
                break
            pid = int(status["PPid"])
        yield pa.RecordBatch.from_arrays([pa.array([top], pa.int64())], ["peak"])


def peak_memory(spark: SparkSession) -> int:
    """The most memory, in bytes, that any executor's JVM has held so far, as the system counts it; 0 where it does not tell."""
    n = spark.sparkContext.defaultParallelism
    return spark.range(n, numPartitions=n).mapInArrow(_peak, "peak long").agg(F.max("peak")).first()[0] or 0
