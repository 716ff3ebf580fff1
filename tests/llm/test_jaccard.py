"""The parity-sketch join and the component search against brute force."""

import random

import numpy as np
import pytest

from strandmatrix.llm import jaccard_join as J
from strandmatrix.llm.components import components


def shingle_set(text, size):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = low.encode().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))


def brute(rows, size, percent):
    sets = [shingle_set(t, size) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if sets[i] and d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return sorted(((d, len(sets[i]), least.get(top(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, i = [], 0
    for _ in range(14):
        base = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 6, 12, 30, 80, 300]))]
        for _ in range(rng.choice([1, 1, 2, 5, 40])):
            w = list(base)
            for _ in range(rng.randrange(1 + len(w) // 25 + (len(w) > 5))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            text = rng.choice([" ", "\n", "\t "]).join(w)
            rows.append((i, text.upper() if rng.random() < 0.2 else text))
            i += 1
    # a chain: each differs from the next by a little, its ends by much
    chain = [rng.choice(vocab) for _ in range(120)]
    for k in range(40):
        rows.append((i, " ".join(chain[k : k + 100 - k % 3])))
        i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, " \n"), (None, rows[0][1]), (None, None), (7, rows[7][1]), (i + 3, "solo"), (i + 4, "SOLO"), (i + 5, "solo x")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, size, percent, giant", [(1, 3, 90, 2048), (2, 5, 80, 4), (3, 1, 70, 3), (4, 3, 90, 2)])
def test_components(spark, monkeypatch, seed, size, percent, giant):
    monkeypatch.setattr(J, "GIANT", giant)
    monkeypatch.setattr(J, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(J, "RANGE_BYTES", 9000)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = J.near_duplicates(df, shingle=size, percent=percent).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, size, percent)


def test_small_sets_with_common_shingles(spark):
    """Many sets of 5 to 40 shingles that share frequent phrases, one very long text, and columns named as those made inside."""
    rng = random.Random(11)
    phrases = [" ".join(f"p{i}w{k}" for k in range(9)) for i in range(4)]
    rows = []
    for i in range(220):
        words = " ".join([rng.choice(phrases)] + [f"x{rng.randrange(60)}" for _ in range(rng.randrange(32))] + [rng.choice(phrases)] * rng.randrange(2)).split()
        rows.append((2 * i, " ".join(words)))
        words[rng.randrange(len(words))] = rng.choice(["other", words[-1]])
        rows.append((2 * i + 1, " ".join(words[: len(words) - rng.randrange(2)])))
    rows.append((1000, " ".join(f"w{i % 7000}" for i in range(200_000))))
    rows.append((1001, rows[-1][1] + " more"))
    df = spark.createDataFrame([(*r, "a", "b", 1) for r in rows], "doc_id long, text string, _text string, node string, component_id int").repartition(3)
    got = J.near_duplicates(df, shingle=5, percent=80).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 5, 80)
    keys = [len(J.sketch_keys(x, 80)) for x in (np.unique(np.random.default_rng(i).integers(0, 1 << 64, 30, np.uint64)) for i in range(50))]
    assert np.mean(keys) < 30


def test_sketch_pigeonhole():
    """Every pair of similar sets shares a key, at sizes small and large."""
    rng = np.random.default_rng(4)
    for n in [*range(1, 60), 200, 1000, 5000, 60000]:
        for percent in (90, 80, 70):
            a = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
            d = len(a) * (100 - percent) // (100 + percent)
            b = np.unique(np.concatenate((a[d:], rng.integers(0, 1 << 64, d, np.uint64))))
            both = len(np.intersect1d(a, b))
            if 100 * both >= percent * (len(a) + len(b) - both) and not np.array_equal(a, b):
                assert len(np.intersect1d(J.sketch_keys(a, percent), J.sketch_keys(b, percent)))


def test_sketches_need_few_seeds():
    """A set has about as many keys as its two sketches have words, at every size."""
    rng = np.random.default_rng(5)
    for percent in (90, 80, 70):
        for n in (20, 90, 300, 2000, 20000):
            band = int(np.searchsorted(J.edges(percent), n, "right")) - 1
            keys = np.mean([len(J.sketch_keys(np.unique(rng.integers(0, 1 << 64, n, np.uint64)), percent)) for _ in range(5)])
            assert keys <= 1.5 * (J.sketch_size(band, percent)[0] + J.sketch_size(band - 1, percent)[0])
    with pytest.raises(ValueError):
        J.Settings(3, 60)


def test_bands():
    e = J.edges(90)
    for a in range(1, 3000):
        band = int(np.searchsorted(e, a, "right")) - 1
        assert a * 100 // 90 < e[band + 2]


def test_star_rounds(spark):
    links = [(5, 3), (3, 9), (9, 9), (20, 21), (22, 21), (22, 23), *((i, i + 1) for i in range(100, 140))]
    got = dict(map(tuple, components(spark.createDataFrame(links, "u long, v long").repartition(4)).collect()))
    assert got == {3: 3, 5: 3, 9: 3, 20: 20, 21: 20, 22: 20, 23: 20} | {i: 100 for i in range(100, 141)}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_drop_and_empty(spark):
    text = " ".join(map(str, range(60)))
    df = spark.createDataFrame([(2, text, 1), (1, text + " x", 2), (3, "y", 3), (None, text, 4), (4, None, 5)], "doc_id long, text string, a int")
    got = J.drop_near_duplicates(df)
    assert got.columns == df.columns and sorted(r.a for r in got.collect()) == [2, 3, 4, 5]
    assert J.near_duplicates(df.limit(0)).collect() == []


def test_parity_bits_bound_the_difference():
    rng = np.random.default_rng(7)
    for n in (3, 40, 300, 4000):
        a = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        b = np.unique(np.concatenate((a[n // 9 :], rng.integers(0, 1 << 64, n // 3, np.uint64))))
        logs, bits = zip(J.parity_bits(a, 80), J.parity_bits(b, 80))
        rows = J.ParityTable(np.array(logs), list(bits)).rows(np.array([0, 1]))
        assert int(np.bitwise_count(rows[0] ^ rows[1]).sum()) <= len(np.setxor1d(a, b))


def test_hot_word_without_links_makes_few_pairs():
    """Sets that share a word but are not similar are turned down by their sketches, not listed."""
    rng = np.random.default_rng(8)
    s = J.Settings(3, 90)
    base = rng.integers(0, 1 << 64, 200, np.uint64)
    sets = [np.unique(np.concatenate((base, rng.integers(0, 1 << 64, 100, np.uint64)))) for _ in range(400)]
    logs, bits = zip(*(J.parity_bits(x, 90) for x in sets))
    rows = J.ParityTable(np.array(logs), list(bits)).rows(np.arange(400))
    size, label = np.array([len(x) for x in sets]), np.arange(400)
    assert sum(len(i) for i, _ in J._near(s, rows, size, label, None)) == 0
    near = [np.unique(np.concatenate((base[i:], rng.integers(0, 1 << 64, 1, np.uint64)))) for i in range(6)]
    logs, bits = zip(*(J.parity_bits(x, 90) for x in near))
    got = {(int(i), int(j)) for x, y in J._near(s, J.ParityTable(np.array(logs), list(bits)).rows(np.arange(6)), np.array([len(x) for x in near]), np.arange(6), None) for i, j in zip(x, y)}
    for i in range(1, 6):
        assert all((i, j) in got for j in range(6) if j != i)


def test_parity_bits_only_where_components_meet(spark, monkeypatch, tmp_path):
    """Words that one component has alone take no parity bits along, however many ranges there are."""
    keys, folder = J._keys, str(tmp_path)

    def watched(s, ranges):
        emit = keys(s, ranges)

        def run(t, labels, *live):
            out = emit(t, labels, *live)
            if labels is not None:
                with open(f"{folder}/{t['_g'][0].as_py()}", "a") as f:
                    f.write(f"{sum(map(len, out['parity'].to_pylist()))}\n")
            return out

        return run

    monkeypatch.setattr(J, "_keys", watched)
    monkeypatch.setattr(J, "BLOCK_BYTES", 9000)
    monkeypatch.setattr(J, "RANGE_BYTES", 2500)
    rows = [(10 * g + k, " ".join([f"g{g}w{i}" for i in range(100)] + [f"end{k}"])) for g in range(6) for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = J.near_duplicates(df, shingle=3, percent=90).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 3, 90)
    sent = [int(x) for p in tmp_path.iterdir() for x in p.read_text().split()]
    assert sent and sum(sent) == 0


def test_shared_words_are_dealt_by_their_entries(spark, monkeypatch):
    rows, dealt, keys = corpus(5), [], J._keys
    monkeypatch.setattr(J, "SHARED_BYTES", 20_000)
    monkeypatch.setattr(J, "_keys", lambda s, ranges: dealt.append(ranges) or keys(s, ranges))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, J.near_duplicates(df).collect()), key=repr) == brute(rows, 5, 80)
    assert dealt[0] == 1 and max(dealt) > 1  # a fixed share of the texts a range left them in one


def test_sets_are_made_for_some_texts_at_a_time(monkeypatch):
    import pyarrow as pa

    rows, most = corpus(6), []
    t = pa.table({"_id": pa.array([i for i, _ in rows], pa.int64()), "_text": pa.array([x or "" for _, x in rows], pa.string())})
    whole, tokens = J.Sets(t, J.Settings()), J.word_tokens
    monkeypatch.setattr(J, "STEP_CHARS", 100)
    monkeypatch.setattr(J, "word_tokens", lambda data, at, lower: most.append(len(data)) or tokens(data, at, lower=lower))
    parts = J.Sets(t, J.Settings())
    assert parts.ids == whole.ids and all(map(np.array_equal, parts.sets, whole.sets)) and len(parts.sets) == len(rows)
    assert max(most) < 100 + max(len(x or "") for _, x in rows)  # not the whole block
    assert len(J.Sets(t.slice(0, 0), J.Settings()).sets) == 0
