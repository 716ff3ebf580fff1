"""Command line: python -m strandmatrix.cli -l LIST -k K -t TMP -o OUT [options]."""

from __future__ import annotations

import argparse
import datetime
import os
import shutil
import sys
import time

from strandmatrix.params import K_MAX, K_MIN, MatrixParams, default_max

MIN_FREE_GB = 10.0


def _fail(message: str) -> None:
    print(f"Error: {message}", file=sys.stderr, flush=True)
    raise SystemExit(1)


def _kmer_size(value: str) -> int:
    if not value.strip().lstrip("+-").isdigit() or not K_MIN <= int(value) <= K_MAX:
        _fail(f"k-mer size must be an integer from {K_MIN} to {K_MAX}, not {value}")
    return int(value)


def _directory(value: str) -> str:
    path = os.path.abspath(os.path.expanduser(value))
    try:
        os.makedirs(path, exist_ok=True)
    except OSError as e:
        _fail(f"cannot create {path}: {e}")
    return path


def read_list(path: str) -> list[str]:
    """Paths of a genome list, without blank and # lines."""
    try:
        with open(path, encoding="utf-8") as f:
            return [s for line in f if (s := line.strip()) and not s.startswith("#")]
    except OSError as e:
        _fail(f"cannot read {path}: {e}")
    return []


def parser() -> argparse.ArgumentParser:
    # fixed values: option names, defaults and exit codes are the command's contract
    p = argparse.ArgumentParser(description="Genome list to a sparse genome by k-mer count matrix.", allow_abbrev=False)
    p.add_argument("-l", "--genome-list", required=True, help="text file with one FASTA path a line; blank and # lines are ignored")
    p.add_argument("-min", "--min", dest="min", type=int, default=5, help="fewest occurrences of a kept k-mer (5)")
    p.add_argument("-max", "--max", dest="max", type=int, help="most occurrences (half the number of genomes)")
    p.add_argument("-t", "--tmp", type=_directory, required=True, help="folder for Spark's temporary files")
    p.add_argument("-k", "--kmer-size", type=_kmer_size, required=True, help=f"{K_MIN} to {K_MAX}")
    p.add_argument("-d", "--disable-normalization", action="store_true", help="keep a k-mer and its reverse complement apart")
    p.add_argument("-c", "--cpu", action="store_true", help="accepted for compatibility; Spark runs on CPUs")
    p.add_argument("-o", "--output", type=_directory, required=True, help="folder for the results")
    p.add_argument("--threshold-on", choices=("occurrences", "genomes"), default="occurrences")
    p.add_argument("--skip-space-check", action="store_true", help=f"do not ask for {MIN_FREE_GB:.0f} GB in the temporary folder")
    return p


def main(argv: list[str] | None = None) -> int:
    p = parser()
    a = p.parse_args(argv)
    if not a.skip_space_check and (free := shutil.disk_usage(a.tmp).free / 1024**3) < MIN_FREE_GB:
        _fail(f"{a.tmp} has {free:.2f} GB free, {MIN_FREE_GB:.0f} GB are needed")
    a.genome_list = os.path.abspath(os.path.expanduser(a.genome_list))
    n = len(read_list(a.genome_list))
    most = default_max(n) if a.max is None else a.max
    if most < a.min:
        p.error(f"the range from --min {a.min} to --max {most} is empty")
    params = MatrixParams(a.kmer_size, a.min, most, not a.disable_normalization, a.threshold_on)

    from pyspark import StorageLevel
    from pyspark.sql import SparkSession

    from strandmatrix.plans.matrix import create_csr_matrix
    from strandmatrix.sources import sinks

    began = time.time()
    spark = SparkSession.builder.config("spark.local.dir", a.tmp).getOrCreate()
    m = create_csr_matrix(spark, a.genome_list, params.k, params.min_count, params.max_count, not params.canonical, params.threshold_on)
    m.coo.persist(StorageLevel.DISK_ONLY)
    m.vocabulary.persist(StorageLevel.DISK_ONLY)
    s = m.stats.first()
    names = sinks.write_npy(m.entries, m.row_pointer, a.output, params.suffix)
    sinks.write_vocabulary(m.vocabulary, a.output, params.suffix)
    sinks.write_stats(  # fixed values: names and order of the lines
        [("Sparsity", f"{s.sparsity}%"), ("K-mer size", params.k), ("Temporary directory", a.tmp), ("Min value", a.min), ("Max value", most), ("Normalization disabled", a.disable_normalization), ("Shape", f"{s.n_rows} x {s.n_cols}"), ("Non-zero values", s.nnz), ("Spark master", spark.sparkContext.master), ("Processing time", datetime.timedelta(seconds=time.time() - began)), ("Peak executor memory", f"{sinks.peak_memory(spark) / 1024**3:.2f} GB")],
        a.output,
        params.suffix,
    )
    print("\n".join(names.values()))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
