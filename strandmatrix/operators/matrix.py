"""From counts and a vocabulary to coordinate and CSR forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Rows of a block whose running total one task computes.
BLOCK = 65536


def coordinates(counts: DataFrame, vocab: DataFrame, row: str = "row") -> DataFrame:
    """(row, col, freq) of the kept k-mers: an inner equi-join, the strategy left to Catalyst."""
    return counts.join(vocab, "kmer", "inner").select(F.col(row).alias("row"), F.col("index").alias("col"), "freq")


def unfolded(placed: DataFrame) -> DataFrame:
    """(genome, index, kmer, freq) of (index, kmer, genomes, freqs), a row for each entry of a column."""
    return placed.select("index", "kmer", F.inline(F.arrays_zip("genomes", "freqs")).alias("genome", "freq")).select("genome", "index", "kmer", "freq")


def vocab_right_join(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """(index, kmer, freq): every count, index null outside the vocabulary."""
    return vocab.join(counts, "kmer", "right").select("index", "kmer", "freq")


def row_nnz(genomes: DataFrame, coo: DataFrame) -> DataFrame:
    """(row, nnz) of every genome, those without a kept k-mer included."""
    return of_every_row(genomes, coo.groupBy("row").agg(F.count("*").alias("nnz")))


def of_every_row(genomes: DataFrame, nnz: DataFrame) -> DataFrame:
    """(row, nnz) of every genome, 0 where nnz has no row."""
    return genomes.select("row").join(nnz, "row", "left").select("row", F.coalesce("nnz", F.lit(0)).cast("long").alias("nnz"))


def row_pointer(nnz: DataFrame, block: int = BLOCK) -> DataFrame:
    """(pos, ptr): running total of nnz in row order, with a leading 0.

    Two levels, so no task takes all rows: totals within blocks of consecutive
    rows, plus the running total of the blocks' sums.
    """
    b = nnz.withColumn("_b", F.floor(F.col("row") / block))
    sums = b.groupBy("_b").agg(F.sum("nnz").alias("_s"))
    before = W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off"))
    inside = W.partitionBy("_b").orderBy("row").rowsBetween(W.unboundedPreceding, 0)
    ptr = b.withColumn("_in", F.sum("nnz").over(inside)).join(offsets, "_b")
    tail = ptr.select((F.col("row") + 1).cast("long").alias("pos"), (F.col("_off") + F.col("_in")).cast("long").alias("ptr"))
    return nnz.sparkSession.sql("select 0L as pos, 0L as ptr").unionAll(tail)


def csr_entries(coo: DataFrame, pointer: DataFrame, block: int = BLOCK) -> DataFrame:
    """(pos, row, col, value): the CSR position of each entry; value is float32, as the sink stores it.

    Two levels, so no task sorts a whole row: an entry's rank within its row's block of columns, plus the row's pointer and
    the running total of the row's blocks before.
    """
    b = coo.withColumn("_b", F.floor(F.col("col") / block))
    sizes = b.groupBy("row", "_b").agg(F.count("*").alias("_n"))
    before = W.partitionBy("row").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("row", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    starts = offsets.join(pointer.select(F.col("pos").alias("row"), "ptr"), "row").select("row", "_b", (F.col("ptr") + F.col("_off")).alias("_start"))
    ranked = b.withColumn("_r", F.row_number().over(W.partitionBy("row", "_b").orderBy("col")))
    return ranked.join(starts, ["row", "_b"]).select((F.col("_start") + F.col("_r") - 1).cast("long").alias("pos"), "row", "col", F.col("freq").cast("float").alias("value"))


def stats(genomes: DataFrame, vocab: DataFrame, coo: DataFrame) -> DataFrame:
    """One row (n_rows, n_cols, nnz, sparsity); sparsity in percent, 0 for an empty shape."""
    return stats_of(genomes, vocab.agg(F.count("*").alias("n_cols")).crossJoin(coo.agg(F.count("*").alias("nnz"))))


def stats_of(genomes: DataFrame, sizes: DataFrame) -> DataFrame:
    """As stats, with one row (n_cols, nnz) of sizes."""
    n = genomes.agg(F.count("*").alias("n_rows")).crossJoin(sizes)
    cells = F.col("n_rows") * F.col("n_cols")
    return n.select("n_rows", "n_cols", "nnz", F.when(cells > 0, (1 - F.col("nnz") / cells) * 100).otherwise(F.lit(0.0)).alias("sparsity"))

