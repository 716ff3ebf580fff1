"""FASTA input, the golden matrix, sinks, the command line and invariants."""

import bz2
import gzip
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandmatrix import MatrixParams, build_matrix, cli, create_csr_matrix
from strandmatrix.functions import dna
from strandmatrix.operators import counting
from strandmatrix.operators import matrix
from strandmatrix.params import default_max
from strandmatrix.sources import genomes as g
from strandmatrix.sources import sinks

GOLDEN = [">a\nACGTACGTAC\n", ">b\nTACGTACG\n", ">c\nACGTACGTNACGTACGT\n", ">d\nACG\n"]


def listed(tmp_path, texts, name="list.txt"):
    paths = []
    for i, t in enumerate(texts):
        p = tmp_path / f"g {i}.fa"
        p.write_bytes(t.encode())
        paths.append(str(p))
    (tmp_path / name).write_text("\n".join(paths) + "\n")
    return str(tmp_path / name)


def arrays(m, tmp_path, suffix="x"):
    names = sinks.write_npy(m.entries, m.row_pointer, str(tmp_path), suffix)
    return [np.load(names[x]) for x in ("data", "column", "row")]


@pytest.mark.parametrize("fold, want", [(True, ([1, 1, 1, 2], [0, 1, 1, 0], [0, 2, 3, 4, 4])), (False, ([1, 2], [0, 0], [0, 1, 1, 2, 2]))])
def test_golden(spark, tmp_path, fold, want):
    m = create_csr_matrix(spark, listed(tmp_path, GOLDEN), 8, 2, 3, disable_normalization=not fold)
    got = arrays(m, tmp_path)
    assert [x.tolist() for x in got] == [list(map(float, want[0])), want[1], want[2]]
    assert got[0].dtype == np.float32 and got[1].dtype == np.uint32
    assert m.stats.first().sparsity == 50.0


def test_list_rules(spark, tmp_path):
    (tmp_path / "l").write_text("# c\n\n  a b.fa \n\t# no\nx.fa\r\na b.fa\n")
    assert [(r.row, r.path) for r in g.genome_list(spark, str(tmp_path / "l")).sort("row").collect()] == [(0, "a b.fa"), (1, "x.fa"), (2, "a b.fa")]
    assert g.genome_count(spark, str(tmp_path / "l")) == 3 and cli.read_list(str(tmp_path / "l")) == ["a b.fa", "x.fa", "a b.fa"]
    assert default_max(3) == 1 and default_max(0) == 1 and default_max(21) == 10


def test_files(spark, tmp_path):
    body = ">r1 x\r\nACGT\r\nacgt\r\n>r2\r\nTTTT\r\n"
    (tmp_path / "p+ct%20 d").mkdir()
    paths = []
    for name, data in [("a.fa", body.encode()), ("b.fa.gz", gzip.compress(body.encode())), ("c.fa.bz2", bz2.compress(body.encode()))]:
        (tmp_path / "p+ct%20 d" / name).write_bytes(data)
        paths.append(str(tmp_path / "p+ct%20 d" / name))
    (tmp_path / "l").write_text("\n".join([*paths, paths[0]]))
    got = sorted((r.row, r.header, r.seq) for r in g.read_fasta(spark, g.genome_list(spark, str(tmp_path / "l"))).collect())
    assert got == [(i, h, s) for i in range(4) for h, s in (("r1 x", "ACGTACGT"), ("r2", "TTTT"))]


def test_fastq(spark, tmp_path):
    (tmp_path / "a.fq").write_text("@r1\nACGT\n+\nIIII\n@r2\nGGGG\n+r2\n!!!!\n")
    (tmp_path / "l").write_text(str(tmp_path / "a.fq"))
    assert sorted((r.header, r.seq) for r in g.read_fastq(spark, g.genome_list(spark, str(tmp_path / "l"))).collect()) == [("r1", "ACGT"), ("r2", "GGGG")]


def test_no_kmer_kept(spark, tmp_path):
    m = create_csr_matrix(spark, listed(tmp_path, GOLDEN), 8, 50, 60)
    assert [x.tolist() for x in arrays(m, tmp_path)] == [[], [], [0, 0, 0, 0, 0]] and m.stats.first().sparsity == 0.0


def brute(seqs, k, lo, hi, fold, by_genome=False):
    flip = str.maketrans("ACGT", "TGCA")
    per = []
    for s in seqs:
        c = Counter()
        for i in range(len(s) - k + 1):
            w = s[i : i + k]
            if set(w) <= set("ACGT"):
                c[min(w, w[::-1].translate(flip)) if fold else w] += 1
        per.append(c)
    total = Counter()
    for c in per:
        total.update({x: 1 for x in c} if by_genome else c)
    voc = {x: i for i, x in enumerate(sorted(x for x, n in total.items() if lo <= n <= hi))}
    return sorted((r, voc[x], n) for r, c in enumerate(per) for x, n in c.items() if x in voc)


def matrix_of(spark, seqs, params):
    genomes = spark.createDataFrame([(i,) for i in range(len(seqs))], "row long")
    records = spark.createDataFrame(list(enumerate(seqs)), "row long, seq string")
    return build_matrix(genomes, records, params)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("ACGTN", max_size=60), min_size=1, max_size=5), st.booleans(), st.sampled_from(["occurrences", "genomes"]), st.integers(1, 40))
def test_brute_force(spark, seqs, fold, on, chunk):
    m = matrix_of(spark, seqs, MatrixParams(8, 1, 3, fold, on, chunk))
    assert sorted(map(tuple, m.coo.collect())) == brute(seqs, 8, 1, 3, fold, on == "genomes")
    ptr = [r.ptr for r in m.row_pointer.sort("pos").collect()]
    assert ptr[0] == 0 and ptr == sorted(ptr) and len(ptr) == len(seqs) + 1 and ptr[-1] == m.coo.count()


def test_strand_symmetry_and_long_k(spark):
    flip = str.maketrans("ACGT", "TGCA")
    seqs = ["ACGTTGCAAC" * 30, "GGGATTACAT" * 25, "T" * 400]
    other = [s[::-1].translate(flip) for s in seqs]
    p = MatrixParams(136)
    a, b = (sorted(map(tuple, matrix_of(spark, x, p).coo.collect())) for x in (seqs, other))
    assert a == b == brute(seqs, 136, 1, 10**9, True)


def test_plan_is_native(spark):
    m = matrix_of(spark, ["ACGTACGTACGT"], MatrixParams(8))
    plan = m.coo._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "Inner" in plan


def test_nothing_runs_before_a_frame_is_used(spark, tmp_path):
    lst = listed(tmp_path, GOLDEN)
    spark.sparkContext.setJobGroup("lazy", "lazy")
    try:
        m = matrix_of(spark, ["ACGTACGTAC"] * 3, MatrixParams(8))
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("lazy")
        files = create_csr_matrix(spark, lst, 8, 2, 3)
        listing = set(spark.sparkContext.statusTracker().getJobIdsForGroup("lazy"))
        assert len(listing) <= 3 and m.entries.columns == files.entries.columns == ["pos", "row", "col", "value"]
        assert set(spark.sparkContext.statusTracker().getJobIdsForGroup("lazy")) == listing
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert files.coo.count() == 4


def test_entries_in_blocks(spark):
    seqs = ["ACGTTGCAACGGATCCTTAGACCA" * 3, "TTGACCATGCAACGGAT", "", "GGGATTACATCGATCGATTA"]
    m = matrix_of(spark, seqs, MatrixParams(8))
    want = [(i, r, c, float(f)) for i, (r, c, f) in enumerate(brute(seqs, 8, 1, 10**9, True))]
    for block in (1, 5, 65536):
        assert sorted(map(tuple, matrix.csr_entries(m.coo, m.row_pointer, block).collect())) == want


@pytest.mark.parametrize("k", [8, 18, 19, 20, 38, 39, 136])
def test_packing_keeps_order(spark, k):
    rng = np.random.default_rng(k)
    kmers = sorted({"A" * k, "T" * k, *("".join(rng.choice(list("ACGT"), k)) for _ in range(50))})
    df = spark.createDataFrame([(x,) for x in kmers], "kmer string").select("kmer", *[w.alias(f"w{i}") for i, w in enumerate(dna.pack(F.col("kmer"), k))])
    words = [c for c in df.columns if c != "kmer"]
    got = df.select("kmer", *words, dna.unpack([F.col(w) for w in words], k).alias("back")).collect()
    assert all(r.kmer == r.back for r in got)
    assert [r.kmer for r in sorted(got, key=lambda r: [r[w] for w in words])] == kmers


@pytest.mark.parametrize("k, fold", [(9, True), (19, True), (20, True), (40, True), (40, False)])
def test_windows_of_every_width(spark, k, fold):
    rng = np.random.default_rng(3)
    seqs = ["".join(rng.choice(list("ACGT"), n)) for n in (0, k - 1, k, 300)] + ["ACGT" * 30 + "N" + "T" * 90]
    m = matrix_of(spark, seqs, MatrixParams(k, 1, 3, fold, chunk=7))
    assert sorted(map(tuple, m.coo.collect())) == brute(seqs, k, 1, 3, fold)


def test_csv(spark, tmp_path):
    m = matrix_of(spark, ["ACGTACGTAC"], MatrixParams(8))
    path = sinks.write_vocabulary(m.vocabulary, str(tmp_path), "s")
    assert sorted(map(tuple, g.read_vocabulary_csv(spark, path).collect())) == sorted(map(tuple, m.vocabulary.collect()))
    counts = sorted(map(tuple, m.counts.select("kmer", "freq").collect()))
    assert sorted(map(tuple, g.read_counts_csv(spark, sinks.write_counts_csv(m.counts, str(tmp_path / "c"))).collect())) == counts
    by_row = g.read_counts_csv(spark, sinks.write_counts_csv(m.counts, str(tmp_path / "d"), "row"), "row").collect()
    assert sorted((r.row, r.kmer, r.freq) for r in by_row) == [("0", *c) for c in counts]
    first = next((tmp_path / "c").glob("part-*")).read_text().splitlines()[0]
    assert first == "K-mer,Frequency"


def test_fasta_sink(spark, tmp_path):
    records = spark.createDataFrame([(0, "a", "ACGT"), (2, "b", None), (0, "c x", "GG"), (1, "d", "T" * 5000)], "row int, header string, seq string")
    lst = sinks.write_list(sinks.write_fasta(records, str(tmp_path / "f")), str(tmp_path / "l"))
    got = g.read_fasta(spark, g.genome_list(spark, lst)).collect()
    assert sorted((r.row, r.header, r.seq) for r in got) == [(0, "a", "ACGT"), (0, "c x", "GG"), (1, "d", "T" * 5000), (2, "b", "")]


def test_params():
    for bad in (7, 137, "9", None):
        with pytest.raises(ValueError):
            MatrixParams(bad)
    with pytest.raises(ValueError):
        MatrixParams(8, 3, 2)
    assert MatrixParams(31, 5, 100).suffix == "k31_min5_max100_d0"


def test_cli(spark, tmp_path, capsys):
    lst = listed(tmp_path, GOLDEN)
    base = ["-l", lst, "-t", str(tmp_path / "t"), "-o", str(tmp_path / "o")]
    assert cli.main([*base, "-k", "8", "-min", "2", "--max", "3"]) == 0
    assert np.load(tmp_path / "o" / "column_k8_min2_max3_d0.npy").tolist() == [0, 1, 1, 0]
    assert (tmp_path / "o" / "set_of_all_unique_kmers_k8_min2_max3_d0.csv").read_text().splitlines()[:2] == ["index,K-mer", "0,ACGTACGT"]
    assert (tmp_path / "o" / "feature_matrix_stats_k8_min2_max3_d0.txt").read_text().startswith("Sparsity: 50.0%\nK-mer size: 8\n")
    stats = sinks.read_stats(str(tmp_path / "o" / "feature_matrix_stats_k8_min2_max3_d0.txt"))
    assert stats["Shape"] == "4 x 2" and float(stats["Peak executor memory"].removesuffix(" GB")) > 0
    for args, code in ((["-k", "7"], 1), (["-k", "x"], 1), (["-k", "8"], 2), ([], 2)):
        with pytest.raises(SystemExit) as e:
            cli.main([*base, *args])
        assert e.value.code == code


def test_streaming(spark, tmp_path):
    from strandmatrix.streaming.incremental import gathered_counts, stream_counts

    spark.createDataFrame([("a", "ACGTACGTAC"), ("b", "TTTTTTTTT")], "genome string, seq string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("genome string, seq string").parquet(str(tmp_path / "in"))
    q = stream_counts(stream, MatrixParams(8), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert q.awaitTermination(120)
    batch = counting.count_per_genome(spark.read.parquet(str(tmp_path / "in")), MatrixParams(8))
    assert sorted(map(tuple, gathered_counts(spark, str(tmp_path / "out")).select("genome", "kmer", "freq").collect())) == sorted(map(tuple, batch.collect()))


def test_lower_case_breaks_when_asked(spark):
    df = spark.createDataFrame([("acgT\nACGT",)], "s string")
    assert df.select(dna.clean("s")).first()[0] == "ACGTACGT" and df.select(dna.clean("s", False)).first()[0] == "acgTACGT"
