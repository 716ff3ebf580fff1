"""Column expressions over DNA strings; all run inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean(seq: Column, upper: bool = True) -> Column:
    """Sequence without white space, upper-cased unless soft-masked bases must break it."""
    bare = F.regexp_replace(seq, r"\s+", "")
    return F.upper(bare) if upper else bare


def reverse_complement(kmer: Column) -> Column:
    return F.reverse(F.translate(kmer, "ACGT", "TGCA"))


def canonical(kmer: Column) -> Column:
    """The lexicographically smaller of a k-mer and its reverse complement."""
    return F.least(kmer, reverse_complement(kmer))


def acgt_runs(records: DataFrame, seq: str = "seq") -> DataFrame:
    """One row per maximal A/C/G/T run (column run) in place of each record's sequence."""
    keep = [c for c in records.columns if c != seq]
    return records.select(*keep, F.explode(F.split(seq, "[^ACGT]+")).alias("run")).where("run <> ''")


def pieces(runs: DataFrame, k: int, chunk: int = 1024) -> DataFrame:
    """Runs cut into pieces (column piece) of `chunk` window starts that overlap by k-1 bases.

    Substring of a short piece is cheap, while on a whole chromosome each window would scan from the start.
    The length guard matters: sequence(1, 0) counts downwards in Spark.
    """
    keep = [c for c in runs.columns if c != "run"]
    starts = F.expr(f"sequence(0L, (length(run) - {k}) div {chunk})")
    cut = runs.where(F.length("run") >= k).select(*keep, "run", F.explode(starts).alias("_c"))
    return cut.select(*keep, F.expr(f"substring(run, cast(_c * {chunk} + 1 as int), {chunk + k - 1})").alias("piece"))


#: Bases of one packed word: A, C, G, T become the decimal digits 0 to 3, and 19 digits up to 3 fit in a long. Packed words order as the bases do.
WORD = 19


def word_sizes(k: int) -> list[int]:
    """Bases in each packed word of a k-mer."""
    return [min(WORD, k - i) for i in range(0, k, WORD)]


def pack(kmer: Column, k: int) -> list[Column]:
    """A k-mer's packed words."""
    digits = F.translate(kmer, "ACGT", "0123")
    return [F.substring(digits, 1 + WORD * i, n).cast("long") for i, n in enumerate(word_sizes(k))]


def unpack(words: list[Column], k: int) -> Column:
    """The k-mer of packed words."""
    return F.translate(F.concat(*[F.lpad(w.cast("string"), n, "0") for w, n in zip(words, word_sizes(k))]), "0123", "ACGT")


def packed_windows(cut: DataFrame, k: int, fold: bool = True) -> DataFrame:
    """One row per window of k bases of each piece, as packed words _w0, _w1, ...; every start of a run is emitted exactly once.

    A piece becomes digits, and their mirrored complement, once; a window is a slice of each, of bytes, so that its place costs no scan.
    """
    keep = [c for c in cut.columns if c != "piece"]
    both = cut.select(*keep, F.translate("piece", "ACGT", "0123").cast("binary").alias("_d"), F.translate(F.reverse("piece"), "ACGT", "3210").cast("binary").alias("_r"))
    at = both.select(*keep, "_d", "_r", F.explode(F.expr(f"sequence(1, length(_d) - {k - 1})")).alias("_p"))
    sizes = word_sizes(k)
    word = lambda col, start, n: f"cast(cast(substring({col}, {start}, {n}) as string) as bigint)"
    fore = [word("_d", f"_p + {WORD * i}", n) for i, n in enumerate(sizes)]
    back = [word("_r", f"length(_r) - _p - {k - 2} + {WORD * i}", n) for i, n in enumerate(sizes)]
    names = [f"_w{i}" for i in range(len(sizes))]
    if not fold:
        return at.select(*keep, *[F.expr(x).alias(n) for x, n in zip(fore, names)])
    if len(sizes) == 1:
        return at.select(*keep, F.expr(f"least({fore[0]}, {back[0]})").alias(names[0]))
    least = F.expr(f"least(struct({', '.join(fore)}), struct({', '.join(back)}))").alias("_w")
    return at.select(*keep, least).select(*keep, *[F.col("_w")[f"col{i + 1}"].alias(n) for i, n in enumerate(names)])
