"""k-mer counts and the vocabulary of kept k-mers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandmatrix.functions.dna import acgt_runs, packed_windows, pieces, unpack
from strandmatrix.params import MatrixParams

#: Leading bases that deal the vocabulary into ordered buckets: 4**6 = 4096 at most.
PREFIX = 6


def _windows(records: DataFrame, params: MatrixParams, genome: str, deal: int | None) -> DataFrame:
    cut = pieces(acgt_runs(records.where(F.col(genome).isNotNull()).select(genome, "seq")), params.k, params.chunk)
    return packed_windows(cut.repartition(deal) if deal else cut, params.k, params.canonical)


def _unpacked(df: DataFrame, params: MatrixParams) -> Column:
    return unpack([F.col(c) for c in df.columns if c.startswith("_w")], params.k).alias("kmer")


def all_kmers(records: DataFrame, params: MatrixParams, genome: str = "genome", deal: int | None = None) -> DataFrame:
    """(genome, kmer) of every window. A record without a genome is on no row and left out."""
    found = _windows(records, params, genome, deal)
    return found.select(genome, _unpacked(found, params))


def count_per_genome(records: DataFrame, params: MatrixParams, genome: str = "genome", deal: int | None = None) -> DataFrame:
    """(genome, kmer, freq) of all windows of all records, unfiltered: one shuffle of packed k-mers, combined map-side.

    deal: into how many tasks the pieces of sequences are dealt anew, where a scan cannot split its input well (sources.genomes.narrow_scan tells).
    Records without a genome are left out here, not by the joins further on: a condition that these infer for some
    uses of the counts only would keep the uses from sharing the shuffle.
    """
    found = _windows(records, params, genome, deal)
    counts = found.groupBy(*found.columns).agg(F.count("*").alias("freq"))
    return counts.select(genome, _unpacked(found, params), "freq")


def count_global(counts: DataFrame) -> DataFrame:
    """(kmer, total) over all genomes."""
    return counts.groupBy("kmer").agg(F.sum("freq").alias("total"))


def prevalence(counts: DataFrame) -> DataFrame:
    """(kmer, n_genomes)."""
    return counts.groupBy("kmer").agg(F.count("*").alias("n_genomes"))


def distinct_kmers(counts: DataFrame) -> DataFrame:
    return counts.select("kmer").distinct()


def kept_kmers(counts: DataFrame, params: MatrixParams) -> DataFrame:
    """(kmer) whose total, or number of genomes, lies in the inclusive range."""
    what = F.sum("freq") if params.threshold_on == "occurrences" else F.count("*")
    return counts.groupBy("kmer").agg(what.alias("_n")).where(F.col("_n").between(params.min_count, params.max_count)).select("kmer")


def ordinal(df: DataFrame, column: str, name: str = "index", prefix: int = PREFIX) -> DataFrame:
    """Adds the 0-based place of each row in the order of a string column of distinct values.

    The order is split by leading characters: places within a prefix come from a
    window over that prefix, and a prefix's offset from a running sum over the
    prefixes' counts, a table of at most 4**prefix rows for DNA, small enough to
    broadcast at any input size. So no single task sorts the whole column, and
    nothing depends on sampled range bounds.
    """
    head = F.substring(column, 1, prefix)
    sizes = df.groupBy(head.alias("_head")).agg(F.count("*").alias("_n"))
    before = W.orderBy("_head").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_head", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    within = df.withColumn("_head", head).withColumn("_rn", F.row_number().over(W.partitionBy("_head").orderBy(column)))
    placed = within.join(F.broadcast(offsets), "_head")
    return placed.select((F.col("_off") + F.col("_rn") - 1).cast("long").alias(name), *df.columns)


def vocabulary(counts: DataFrame, params: MatrixParams) -> DataFrame:
    """(index, kmer): matrix columns in lexicographic k-mer order."""
    return ordinal(kept_kmers(counts, params), "kmer")
