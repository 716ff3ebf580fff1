"""Counts by arrays: against brute force for words of every width, split input, many genomes, and in rows that are shuffled."""

import itertools
import random
from collections import Counter

import pyarrow as pa
import pytest

from strandmatrix import MatrixParams
from strandmatrix.functions import windows
from strandmatrix.operators import counting, matrix, tally

FLIP = str.maketrans("ACGT", "TGCA")


def brute(records, k, fold):
    out = Counter()
    for g, s in records:
        for w in (s[i : i + k] for i in range(len(s or "") - k + 1)):
            if g is not None and set(w) <= set("ACGT"):
                out[g, min(w, w[::-1].translate(FLIP)) if fold else w] += 1
    return out


def some(seed, k, genomes, n=30):
    rng = random.Random(seed)
    base = "".join(rng.choice("ACGT") for _ in range(3 * k + 200))
    cut = lambda: base[(i := rng.randrange(len(base))) : i + rng.choice([0, k - 1, k, 3 * k])] + "N" * rng.randrange(2) + "ACGT" * rng.randrange(9)
    return [(rng.choice(genomes), cut()) for _ in range(n)]


@pytest.mark.parametrize("k, fold", [(8, True), (12, False), (16, True), (17, True), (31, True), (32, True), (63, False), (136, True)])
@pytest.mark.parametrize("flush", [1, 100, 1 << 23])
def test_rows_merge_to_the_counts(monkeypatch, k, fold, flush):
    monkeypatch.setattr(tally, "SORTED", flush)
    monkeypatch.setattr(tally, "STEP", 50)
    records = some(k, k, ["a", "b", "ccc"])
    batches = [pa.RecordBatch.from_arrays([pa.array([g for g, _ in part], pa.string()), pa.array([s.encode() for _, s in part], pa.binary())], ["g", "p"]) for part in itertools.batched(records, 7)]
    t = pa.Table.from_batches(tally._dealt(k, fold, 4, windows.DNA)(batches))
    got = Counter()
    for b in set(t["_b"].to_pylist()):
        m = tally._merge(t.filter(pa.compute.equal(t["_b"], b)), k, 4)
        rows = list(zip((m.names[i].as_py() for i in m.g), m.kmers(slice(None)).to_pylist(), m.freq.tolist()))
        assert len({x[:2] for x in rows}) == len(rows) and not {x[:2] for x in rows} & set(got)
        got.update({x[:2]: x[2] for x in rows})
    assert got == brute(records, k, fold)


@pytest.mark.parametrize("on", ["occurrences", "genomes"])
@pytest.mark.parametrize("genomes", [["x", "y", None], list(range(700))])
def test_frames(spark, on, genomes):
    p = MatrixParams(9, 2, 4, threshold_on=on)
    records = [*some(5, 9, genomes, 400), (genomes[0], None), (genomes[0], "A" * 40_000)]
    df = spark.createDataFrame(records, f"genome {'string' if 'x' in genomes else 'long'}, seq string").repartition(3)
    f = tally.tally(df, p)
    want = brute(records, 9, True)
    total = Counter()
    for (_, w), n in want.items():
        total[w] += n if on == "occurrences" else 1
    voc = {w: i for i, w in enumerate(sorted(w for w, n in total.items() if 2 <= n <= 4))}
    assert Counter({(r.genome, r.kmer): r.freq for r in f.counts().collect()}) == want
    got = matrix.unfolded(counting.ordinal(f.kept(p), "kmer")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((g, voc[w], w, n) for (g, w), n in want.items() if w in voc), key=repr)
    assert sorted(map(tuple, f.left_out(p).collect()), key=repr) == sorted(((g, w, n) for (g, w), n in want.items() if w not in voc), key=repr)
    assert {r.genome: r.nnz for r in f.nnz(p).collect()} == Counter(g for g, w in want if w in voc)
    assert {(r.kmer, r.total if on == "occurrences" else r.n_genomes) for r in f.totals(p).collect()} == {(w, total[w]) for w in voc}
    assert tuple(f.sizes(p).first()) == (len(voc), sum(w in voc for _, w in want)) and f.sizes().first().n_cols == len(total)


def test_empty(spark):
    f = tally.tally(spark.createDataFrame([("a", "ACGTN")], "genome string, seq string"), MatrixParams(8))
    assert tuple(f.sizes().first()) == (0, 0) and not f.counts().collect() and not f.kept(MatrixParams(8)).collect()


@pytest.mark.parametrize("name", ["csr_triplets", "csr_column", "row_nnz", "vocabulary", "matrix_stats", "kmer_count_global", "fasta_matrix"])
def test_few_rows_are_shuffled(spark, name):
    """A row a window, or a row a counted k-mer, is what made these queries fail by time; what a result does not hold does not travel as rows."""
    from strandmatrix.plans.queries import QUERIES

    sc = spark.sparkContext

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return {(x := found.apply(i)).stageId(): x.shuffleWriteRecords() for i in range(found.size())}

    before = max(stages(), default=-1)
    QUERIES[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    written = sum(n for i, n in stages().items() if i > before)
    assert 0 < written < 60_000  # of 434,000 windows
