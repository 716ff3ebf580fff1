"""Run parameters, validated in one place."""

from __future__ import annotations

from dataclasses import dataclass

K_MIN, K_MAX = 8, 136
#: "No limit" for the upper threshold, as in unfiltered per-genome counts.
NO_LIMIT = 10**9


def default_max(n_genomes: int) -> int:
    """Upper threshold when none is given: half the genomes, at least 1."""
    return max(1, n_genomes // 2)


@dataclass(frozen=True)
class MatrixParams:
    """k, the inclusive occurrence range of kept k-mers, and how strands are folded.

    threshold_on: "occurrences" bounds a k-mer's total count over all genomes,
    "genomes" bounds the number of genomes that hold it.
    """

    k: int
    min_count: int = 1
    max_count: int = NO_LIMIT
    canonical: bool = True
    threshold_on: str = "occurrences"
    chunk: int = 1024

    def __post_init__(self) -> None:
        if isinstance(self.k, bool) or not isinstance(self.k, int) or not K_MIN <= self.k <= K_MAX:
            raise ValueError(f"k must be an integer from {K_MIN} to {K_MAX}, not {self.k!r}")
        if self.max_count < self.min_count:
            raise ValueError(f"max ({self.max_count}) must be at least min ({self.min_count})")
        if self.threshold_on not in ("occurrences", "genomes"):
            raise ValueError(f"threshold_on must be 'occurrences' or 'genomes', not {self.threshold_on!r}")
        if self.chunk < 1:
            raise ValueError("chunk must be positive")

    @property
    def suffix(self) -> str:
        """The part of output file names that tells runs apart."""
        return f"k{self.k}_min{self.min_count}_max{self.max_count}_d{int(not self.canonical)}"
