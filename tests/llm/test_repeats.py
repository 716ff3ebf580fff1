"""Repeated-passage removal against brute force."""

import hashlib
from collections import Counter
import random

import numpy as np
import pytest

from strandmatrix.llm import repeats, rlz_dedup, suffix_dedup


def corpus(seed, n=60, alphabet="ab ", unit=40):
    rng = random.Random(seed)
    shared = ["".join(rng.choice(alphabet) for _ in range(unit * 4)) for _ in range(3)]
    out = []
    for i in range(n):
        parts = [rng.choice(shared)[rng.randrange(20) :] if rng.random() < 0.5 else "".join(rng.choice("abcdé \n") for _ in range(rng.randrange(80))) for _ in range(rng.randrange(5))]
        out.append((i, "".join(parts)))
    out += [(n, None), (n + 1, ""), (n + 2, out[3][1]), (n + 3, "a" * 500), (n + 4, "a" * 130), (None, out[4][1]), (n + 5, out[5][1]), (n + 5, out[5][1])]
    rng.shuffle(out)
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def brute_bytes(rows, length):
    seen, gone = set(), []
    for doc, text in ordered(rows):
        raw = (text or "").encode()
        dup = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if w in seen:
                dup[p : p + length] = True
            seen.add(w)
        kept = bytes(np.frombuffer(raw, np.uint8)[~dup])
        spans = int(np.sum(np.diff(np.concatenate(([0], dup.view(np.int8)))) == 1))
        gone.append((doc, len(raw), int(dup.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return gone


def brute_words(rows, length):
    first = {}
    key = lambda d: (d is None, d or 0)
    words = [(d, (t or "").encode().split()) for d, t in ordered(rows)]
    for d, w in words:
        for p in range(len(w) - length + 1):
            x = tuple(w[p : p + length])
            first[x] = min(first.get(x, key(d)), key(d))
    out = []
    for d, w in words:
        dup = [False] * len(w)
        for p in range(len(w) - length + 1):
            if first[tuple(w[p : p + length])] < key(d):
                dup[p : p + length] = [True] * length
        out.append((d, len(w), sum(dup), hashlib.sha256(b" ".join(x for x, g in zip(w, dup) if not g)).hexdigest()))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.fixture
def many_blocks(monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 700)
    monkeypatch.setattr(repeats, "RANGE_BYTES", 2500)


@pytest.mark.parametrize("seed, hot", [(1, 8192), (2, 2)])
def test_bytes(spark, many_blocks, monkeypatch, seed, hot):
    rows = corpus(seed)
    scheme = suffix_dedup._scheme(24)
    monkeypatch.setattr(suffix_dedup, "_scheme", lambda n: repeats.Scheme(False, n, scheme.gram, True, hot))
    got = suffix_dedup.suffix_dedup(frame(spark, rows), length=24).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute_bytes(rows, 24), key=repr)


@pytest.mark.parametrize("seed, hot", [(3, 8192), (4, 2)])
def test_words(spark, many_blocks, monkeypatch, seed, hot):
    rows = corpus(seed, alphabet="ab  ")
    scheme = rlz_dedup._scheme(9)
    monkeypatch.setattr(rlz_dedup, "_scheme", lambda n: repeats.Scheme(True, n, scheme.gram, False, hot))
    got = rlz_dedup.substring_dedup(frame(spark, rows), length=9).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute_words(rows, 9), key=repr)


def test_word_tokens():
    texts = ["a bb\tccc\x0b d", "", " ", "xé y z", "end", "END x"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    tokens, of = repeats.word_tokens(raw, at)
    assert np.diff(of).tolist() == [len(t.encode().split()) for t in texts]
    flat = [w for t in texts for w in t.encode().split()]
    assert len(set(tokens.tolist())) == len(set(flat))
    low, _ = repeats.word_tokens(raw, at, lower=True)
    assert low[-2] == tokens[-3]


def test_deep_shallow_orders_suffixes():
    rng = np.random.default_rng(5)
    text = np.concatenate([rng.integers(97, 99, 400), np.tile(rng.integers(97, 99, 60), 6)]).astype(np.uint8)
    starts = np.arange(len(text) - 48)
    order, group = suffix_dedup.deep_shallow(text, starts, 48)
    raw = text.tobytes()
    cut = [raw[i : i + 48] for i in order]
    assert cut == sorted(cut)
    assert [a == b for a, b in zip(cut, cut[1:])] == (np.diff(group) == 0).tolist()


def test_shallow_sort_is_a_sort():
    rng = np.random.default_rng(6)
    for n, letters in ((0, 2), (1, 2), (5, 2), (300, 2), (3000, 4), (3000, 200)):
        text = np.concatenate((rng.integers(60, 60 + letters, n), np.tile(rng.integers(60, 62, 40), n // 80))).astype(np.uint8)
        padded = np.concatenate((text, np.zeros(32, np.uint8)))
        order, heads = suffix_dedup.shallow_sort(padded, np.arange(len(text)), 24)
        raw = padded.tobytes()
        cut = [raw[i : i + 24] for i in order]
        assert cut == sorted(cut) and sorted(order.tolist()) == list(range(len(text)))
        assert heads.tolist() == [i for i in range(len(cut)) if not i or cut[i] != cut[i - 1]]


def test_factors_are_the_longest_matches():
    rng = random.Random(7)
    for trial in range(40):
        base = [rng.randrange(4) for _ in range(60)]
        runs = [base[(a := rng.randrange(40)) : a + rng.randrange(1, 20)] + [rng.randrange(4) for _ in range(rng.randrange(12))] for _ in range(12)]
        keys = [rng.randrange(6) for _ in runs]
        longs = np.array([len(r) for r in runs])
        starts = np.cumsum(longs) - longs
        tokens = np.array([x for r in runs for x in r])

        def match(x, y):
            n = 0
            while n < min(len(x), len(y)) and x[n] == y[n]:
                n += 1
            return n

        want = []
        for r, (run, key) in enumerate(zip(runs, keys)):
            p = 0
            while p < len(run):
                n = max((match(run[p:], other[q:]) for other, k in zip(runs, keys) if k < key for q in range(len(other))), default=0)
                if n:
                    want.append((int(starts[r]) + p, n))
                p += n or 1
        got, _, _ = rlz_dedup.factors(tokens, starts, longs, np.array(keys))
        assert [(p, n) for p, n, _ in got] == want
        flat, of = tokens.tolist(), np.repeat(np.arange(len(runs)), longs)
        for p, n, q in got:
            assert flat[p : p + n] == flat[q : q + n] and of[q] == of[q + n - 1] and keys[of[q]] < keys[of[p]]


def test_smaller_before():
    rng = np.random.default_rng(8)
    for k in (rng.integers(0, 50, 400), np.append(np.arange(300), 0), np.arange(300)[::-1], np.zeros(50), np.tile(np.append(np.arange(200), [0]), 3), np.zeros(0)):
        want = [max((j for j in range(i) if k[j] < k[i]), default=-1) for i in range(len(k))]
        assert rlz_dedup._smaller(k).tolist() == want


def test_words_that_collide_are_told_apart(spark):
    """Long words of two letters that a polynomial hash cannot tell apart, and a largest id beside a null one."""
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    shared = [f"w{i}" for i in range(49)]
    rows = [(1, " ".join([*shared, a])), (2, " ".join([*shared, b])), (3, " ".join([*shared, "x", a])), (4, " ".join([*shared, a, "y"]))]
    got = {r.doc_id: r.n_removed for r in rlz_dedup.substring_dedup(frame(spark, rows)).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 50}
    text = " ".join([*shared, "end"])
    rows = [(None, text), (2**63 - 1, text), (None, text + " more")]
    assert sorted((r.doc_id or 0, r.n_removed) for r in rlz_dedup.substring_dedup(frame(spark, rows)).collect()) == [(0, 50), (0, 50), (2**63 - 1, 0)]


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "x " * 200, 1, "a", "b", 2), (2, "x " * 200, 3, "c", "d", 4)], "doc_id long, text string, _g int, _text string, _row string, rng int")
    assert sorted((r.doc_id, r.n_removed) for r in suffix_dedup.suffix_dedup(df).collect()) == [(1, 398), (2, 400)]
    assert sorted((r.doc_id, r.n_removed) for r in rlz_dedup.substring_dedup(df).collect()) == [(1, 0), (2, 200)]


def test_whole_long_text_and_empty_table(spark):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefgh ") for _ in range(300_000))
    rows = [(1, long), (2, "x" + long[100_000:200_000]), (3, "short")]
    got = {r.doc_id: r for r in suffix_dedup.suffix_dedup(frame(spark, rows)).collect()}
    assert (got[1].n_removed, got[2].n_removed, got[2].n_spans, got[3].n_removed) == (0, 100_000, 1, 0)
    words = {r.doc_id: r for r in rlz_dedup.substring_dedup(frame(spark, rows)).collect()}
    assert words[1].n_removed == 0 and words[2].n_removed >= len(long[100_000:200_000].split()) - 2
    for op in (suffix_dedup.suffix_dedup, rlz_dedup.substring_dedup):
        assert op(frame(spark, [])).collect() == []


def test_drop_repeats_keeps_columns(spark):
    rows = [(1, "é" * 120, "u", 120), (2, "zz" + "é" * 120, "v", 122), (3, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _g string, n_chars long")
    got = suffix_dedup.drop_repeats(df)
    assert got.columns == df.columns
    out = {r.doc_id: (r.text, r["_g"], r.n_chars) for r in got.collect()}
    assert out[3] == (None, None, None) and out[2] == ("zz", "v", 2)
    assert out[1] == ("é", "u", 1)  # every window after the first two starts repeats one of them


def test_only_windows_with_an_equal_are_sorted(monkeypatch):
    """Windows that begin alike and end otherwise are told apart before the suffix sort, whose owners are those of brute force."""
    sorted_, deep = [], suffix_dedup.deep_shallow
    monkeypatch.setattr(suffix_dedup, "deep_shallow", lambda text, starts, n: sorted_.append(len(starts)) or deep(text, starts, n))
    rng = np.random.default_rng(5)
    for length in (16, 48, 100):
        head, same = rng.integers(97, 101, 300).astype(np.uint8), rng.integers(97, 101, length + 20).astype(np.uint8)
        parts = [np.concatenate((head[: length - 1], rng.integers(97, 123, 40).astype(np.uint8), same[: length + k])) for k in (0, 5, 20, 20)]
        text, long = np.concatenate(parts), np.array([len(x) for x in parts])
        starts, sizes, keys = np.cumsum(long) - long, long - length + 1, np.array([4, 2, 9, 7])
        got = suffix_dedup.first_owners(text, starts, sizes, keys, length)
        least, windows = {}, [(bytes(p[i : i + length]), k) for p, k in zip(parts, keys.tolist()) for i in range(len(p) - length + 1)]
        for w, k in windows:
            least[w] = min(k, least.get(w, k))
        assert got.tolist() == [least[w] for w, _ in windows]
        assert sorted_.pop() == sum(n for n in Counter(w for w, _ in windows).values() if n > 1)
    assert suffix_dedup.first_owners(text, starts[:0], sizes[:0], keys[:0], 48).tolist() == []
