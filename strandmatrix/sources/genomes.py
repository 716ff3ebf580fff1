"""Genome lists, FASTA files, and tables of sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmatrix.functions.dna import clean


def genome_list(spark: SparkSession, path: str) -> DataFrame:
    """(row, path) of a genome list: one path a line, in order, repeats kept.

    Blank lines and lines whose first non-blank character is # are left out. The
    list is a control file of one line per genome, read whole so that its order holds.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r\n|\n|\r")).alias("line", "path"))
    lines = lines.select("line", F.regexp_replace("path", r"^\s+|\s+$", "").alias("path"))
    named = lines.where("path <> '' and not startswith(path, '#')")
    ranked = named.groupBy().agg(F.array_sort(F.collect_list(F.struct("line", "path"))).alias("g"))
    return ranked.select(F.posexplode("g").alias("row", "g")).select("row", F.col("g.path").alias("path"))


def genome_count(spark: SparkSession, path: str) -> int:
    return genome_list(spark, path).count()


def _file_path(uri: F.Column) -> F.Column:
    """A local file's path from the percent-encoded URI that Spark reports; other URIs stay whole."""
    decoded = F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, "^file:/+", "/")


def fasta_scan(spark: SparkSession, genomes: DataFrame) -> DataFrame | None:
    """(uri, value): the records of the listed files as they are. Only paths, one per genome, come to the driver: they are the arguments of the scan."""
    paths = sorted({r.path for r in genomes.select("path").distinct().toLocalIterator()})
    return spark.read.option("lineSep", "\n>").text(paths).select(F.col("_metadata.file_path").alias("uri"), "value") if paths else None


def narrow_scan(scan: DataFrame | None) -> int | None:
    """The number of cores if a scan of files has fewer partitions, else None. For a bare scan only: nothing runs for it.

    Windows take far more work than the text they come from, so input that a scan cannot split (one row
    group, gzip, a whole chromosome in one record) would keep one core busy.
    """
    if scan is None:
        return None
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return cores if scan.rdd.getNumPartitions() < cores else None


def read_fasta(spark: SparkSession, genomes: DataFrame, upper: bool = True, scan: DataFrame | None = None) -> DataFrame:
    """(row, record_id, header, seq) of every record of the listed FASTA files, which `scan` may have opened before.

    Plain, .gz and .bz2 files. A path listed twice is read once and yields its
    records once per list row.
    """
    raw = scan if scan is not None else fasta_scan(spark, genomes)
    if raw is None:
        return spark.createDataFrame([], "row int, record_id long, header string, seq string")
    text = F.regexp_replace("value", "^>", "")
    body = raw.select(_file_path(F.col("uri")).alias("path"), text.alias("t")).where(F.trim("t") != "")
    parts = body.select("path", F.monotonically_increasing_id().alias("record_id"), F.regexp_extract("t", r"^([^\r\n]*)", 1).alias("header"), clean(F.regexp_replace("t", r"^[^\r\n]*", ""), upper).alias("seq"))
    listed = genomes.select("row", _file_path(F.regexp_replace(F.regexp_replace("path", "%", "%25"), "^file:/+", "/")).alias("path"))
    return parts.join(listed, "path").select("row", "record_id", "header", "seq")


def read_fastq(spark: SparkSession, genomes: DataFrame, upper: bool = True) -> DataFrame:
    """As read_fasta for four-line FASTQ files (an extension); qualities are dropped."""
    paths = sorted({r.path for r in genomes.select("path").distinct().toLocalIterator()})
    if not paths:
        return spark.createDataFrame([], "row int, record_id long, header string, seq string")
    raw = spark.read.option("lineSep", "\n@").text(paths).select(_file_path(F.col("_metadata.file_path")).alias("path"), F.split(F.regexp_replace("value", "^@", ""), r"\r?\n").alias("l"))
    parts = raw.where(F.size("l") >= 3).where(F.startswith(F.element_at("l", 3), F.lit("+"))).select("path", F.monotonically_increasing_id().alias("record_id"), F.element_at("l", 1).alias("header"), clean(F.element_at("l", 2), upper).alias("seq"))
    return parts.join(genomes.select("row", _file_path(F.regexp_replace("path", "%", "%25")).alias("path")), "path").select("row", "record_id", "header", "seq")


def records_from_table(table: DataFrame, genome: str, record: str, text: str, *, letters: bool = False) -> DataFrame:
    """(genome, record_id, seq) of a table with a text column.

    letters: derive DNA from prose: drop spaces and newlines, lower-case, letter
    number i becomes ACGT[i mod 4], any other character N.
    """
    if letters:
        bare = F.regexp_replace(F.regexp_replace(F.lower(text), "[ \n]", ""), "[^a-z]", "N")
        seq = F.translate(bare, "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")
    else:
        seq = clean(F.col(text))
    return table.select(F.col(genome).alias("genome"), F.col(record).alias("record_id"), seq.alias("seq"))


def prose_from_table(table: DataFrame, genome: str, text: str) -> DataFrame:
    """(genome, seq) of a table of prose: lower-case, without spaces and newlines, as records_from_table has it before letters become bases."""
    return table.select(F.col(genome).alias("genome"), F.replace(F.replace(F.lower(text), F.lit(" "), F.lit("")), F.lit("\n"), F.lit("")).alias("seq"))


def read_counts_csv(spark: SparkSession, path: str, genome: str | None = None) -> DataFrame:
    """(kmer, freq) of a per-genome count file with header K-mer,Frequency; with `genome`, of a folder of them, with the value in the name of each file's own folder."""
    schema = "`K-mer` string, Frequency long" + (f", `{genome}` string" if genome else "")
    got = spark.read.csv(path, header=True, schema=schema, enforceSchema=False)
    return got.select(*([F.col(genome)] if genome else []), F.col("K-mer").alias("kmer"), F.col("Frequency").alias("freq"))


def read_vocabulary_csv(spark: SparkSession, path: str) -> DataFrame:
    """(index, kmer) of a vocabulary file with header index,K-mer."""
    got = spark.read.csv(path, header=True, schema="index long, `K-mer` string", enforceSchema=False)
    return got.select("index", F.col("K-mer").alias("kmer"))
