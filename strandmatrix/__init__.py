"""strandmatrix: genome collections to sparse k-mer count matrices, as PySpark DataFrames."""

from strandmatrix.params import MatrixParams
from strandmatrix.plans.matrix import KmerMatrix, build_matrix, create_csr_matrix

__all__ = ["KmerMatrix", "MatrixParams", "build_matrix", "create_csr_matrix"]
