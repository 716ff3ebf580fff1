"""The whole dataflow: genomes to a sparse matrix."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmatrix.operators import counting, matrix
from strandmatrix.operators.tally import tally
from strandmatrix.params import NO_LIMIT, MatrixParams
from strandmatrix.sources.genomes import fasta_scan, genome_list, narrow_scan, read_fasta


@dataclass(frozen=True)
class KmerMatrix:
    """Lazy frames of one matrix."""

    genomes: DataFrame
    counts: DataFrame
    vocabulary: DataFrame
    coo: DataFrame

    @property
    def row_nnz(self) -> DataFrame:
        return matrix.row_nnz(self.genomes, self.coo)

    @property
    def row_pointer(self) -> DataFrame:
        return matrix.row_pointer(self.row_nnz)

    @property
    def entries(self) -> DataFrame:
        return matrix.csr_entries(self.coo, self.row_pointer)

    @property
    def stats(self) -> DataFrame:
        return matrix.stats(self.genomes, self.vocabulary, self.coo)


def build_matrix(genomes: DataFrame, records: DataFrame, params: MatrixParams, deal: int | None = None) -> KmerMatrix:
    """genomes: (row, ...), one per matrix row; records: (row, seq); deal as count_per_genome has it. Nothing runs until a frame is used.

    Each genome is counted once: pooled totals are sums of the per-genome counts,
    and both uses of the counts share one shuffle.
    """
    counts = counting.count_per_genome(records, params, "row", deal)
    vocab = counting.vocabulary(counts, params)
    return KmerMatrix(genomes, counts, vocab, matrix.coordinates(counts, vocab))


def create_csr_matrix(spark: SparkSession, genome_list_path: str, kmer_size: int, min_val: int = 1, max_val: int = NO_LIMIT, disable_normalization: bool = False, threshold_on: str = "occurrences") -> KmerMatrix:
    """The matrix of the FASTA files that a genome list names, row order being list order. Only the list is read before a frame is used.

    Counts come from operators.tally, in Python workers; build_matrix has the same frames within Spark's own plan, at far more time for each window.
    """
    params = MatrixParams(kmer_size, min_val, max_val, not disable_normalization, threshold_on)
    genomes = genome_list(spark, genome_list_path)
    scan = fasta_scan(spark, genomes)
    found = tally(read_fasta(spark, genomes, scan=scan), params, "row", narrow_scan(scan))
    coo = matrix.unfolded(counting.ordinal(found.kept(params), "kmer"))
    vocab = counting.ordinal(found.totals(params).select("kmer"), "kmer")
    return KmerMatrix(genomes, found.counts(), vocab, coo.select(F.col("genome").alias("row"), F.col("index").alias("col"), "freq"))
