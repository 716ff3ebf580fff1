"""The other operators: brute force, public libraries, round trips and held-out accuracy."""

import hashlib
import os
import random
import struct
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest

from strandmatrix.llm import bpe, chroma, exact_dedup, html_extract, langid, packing, quality

DIR = "/root/testdata/sf0.001"
TRICKY = ["", " ", "\n", "a", "it's we'll 12½", "a  b \n\n c\t d", " lead", "trail ", "日本語 text 🙂🙂", "x <|endoftext|> y", "\x1c\x85\xa0 z", "é" * 70, "aaaa" * 3000, "x y\nz w\nq", "'s 's\n's"]


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema).repartition(3)


# exact dedup


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("fan_in", [2, 8])
def test_exact(spark, monkeypatch, keep, fan_in):
    monkeypatch.setattr(exact_dedup, "FIRST", 3)
    rng = random.Random(fan_in)
    rows = [(i, rng.choice(["same", "b", "", None, f"u{i}", "x" * 5000])) for i in range(150)] + [(None, "same"), (None, "only"), (None, "only"), (3, "twice"), (3, "twice"), (-5, "b")]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), keep=keep, fan_in=fan_in).collect()
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    pick = {t: (max if keep == "max" else min)((d for d in ds if d is not None), default=None) for t, ds in groups.items()}
    sha = {t: hashlib.sha256(t.encode()).hexdigest() for t in groups}
    want = sorted(((d, pick[t or ""], len(groups[t or ""]), sha[t or ""]) for d, t in rows), key=repr)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == want
    kept = [r for r in got if r.kept]
    assert sorted(r.text_sha256 for r in kept) == sorted(sha.values()) and all(r.doc_id == r.keep_id for r in kept)


def test_exact_rows(spark):
    df = frame(spark, [(1, "a", "x"), (2, "a", "y"), (2, "a", "z"), (None, None, "w"), (4, "", "v")], "doc_id long, text string, _fp string")
    got = exact_dedup.drop_copies(df, keep="max")
    assert got.columns == df.columns and sorted(r["_fp"] for r in got.collect()) in (["v", "y"], ["v", "z"])
    assert exact_dedup.exact_dedup(df.limit(0)).collect() == [] and exact_dedup.drop_copies(df.limit(0)).collect() == []


def test_runs_stay_long():
    """Whatever the table's size: a run is cut into few ranges, and merged ones into as many as went in."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    made = []
    for part in range(16):
        fp = [rng.bytes(exact_dedup.WIDTH) for _ in range(4000)]
        batch = pa.RecordBatch.from_arrays([pa.array(range(4000), pa.int64()), pa.array(fp, pa.binary())], ["_id", "fp"])
        made += [b.drop_columns(["ids"]) for b in exact_dedup._local_runs("min")(iter([batch]))]
    sizes = [len(b["fps"][0].as_py()) // exact_dedup.WIDTH for b in made]
    assert min(sizes) > 100 and sum(sizes) == 16 * 4000
    merged = [exact_dedup._round(8, 64)(pa.Table.from_batches([made[i] for i in range(r, 64, 8)])) for r in range(8)]
    sizes = [len(x.as_py()) // exact_dedup.WIDTH for t in merged for x in t["fps"]]
    assert min(sizes) > 100 and sum(sizes) == 8 * 4000 and max(sizes) < 1000


# byte-level BPE


def test_bpe_equals_the_library():
    import public_tokenizers as P
    import tiktoken

    pairs = bpe.load(*bpe.vocabulary())
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=pairs.ranks, special_tokens={})
    enc, rng = bpe.TextEncoder(pairs), random.Random(1)
    texts = TRICKY + ["".join(rng.choice("abc é\n'.,1 ß\t") for _ in range(rng.randrange(200))) for _ in range(400)]
    texts += ["".join(rng.choice("abcdefgh") for _ in range(n)) for n in (59, 60, 61, 20_000)]
    for t in texts:
        want = lib.encode_ordinary(t)
        assert enc(t) == want == pairs.encode(t) and pairs.decode(want) == t.encode()


def test_rank_queue_orders_and_skips():
    q = bpe.RankQueue(70_000)
    rng = random.Random(2)
    items = [(rng.randrange(70_000), i) for i in range(500)] + [(7, 9), (7, 3)]
    for x in items:
        q.push(*x)
    assert [q.pop() for _ in items] == sorted(items) and not q.summary


def test_bpe_frames(spark):
    rows = [(i, t) for i, t in enumerate([*TRICKY, None])] + [(None, "x"), (1, " ")]
    full = bpe.encode(frame(spark, rows)).collect()
    short = {(r.doc_id, r.decoded_sha256): r for r in bpe.digests(frame(spark, rows)).collect()}
    assert len(full) == len(rows)
    texts = {d: (t or "") for d, t in rows}
    for r in full:
        assert bytes(r.decoded) == texts[r.doc_id].encode()
        s = short[r.doc_id, hashlib.sha256(bytes(r.decoded)).hexdigest()]
        assert (s.n_tokens, s.ids_sha256) == (len(r.ids), hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest())
    assert bpe.digests(frame(spark, [])).collect() == []


def test_words_are_merged_together(monkeypatch):
    import public_tokenizers as P
    import tiktoken

    pairs = bpe.load(*bpe.vocabulary())
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=pairs.ranks, special_tokens={})
    rng, alone = random.Random(4), []
    merge = pairs.merge
    monkeypatch.setattr(pairs, "merge", lambda piece: alone.append(piece) or merge(piece))
    enc = bpe.TextEncoder(pairs)
    alone.clear()
    text = " ".join("".join(rng.choice("thaenrio") for _ in range(rng.randrange(1, 25))) + rng.choice(["", ",", ".\nIn", "'s", "é!"]) for _ in range(3000))
    assert enc(text) == lib.encode_ordinary(text) and not alone
    long = "x" + "thth" * 80
    assert enc(long) == lib.encode_ordinary(long) and alone == [long.encode()]


@pytest.mark.parametrize("written", [1, 300, 1 << 20])
def test_texts_are_encoded_together(monkeypatch, written):
    import public_tokenizers as P
    import pyarrow as pa
    import tiktoken

    monkeypatch.setattr(bpe, "WRITTEN", written)
    pairs = bpe.load(*bpe.vocabulary())
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=pairs.ranks, special_tokens={})
    enc, rng = bpe.TextEncoder(pairs), random.Random(5)
    texts = [*TRICKY, "", "\u180e a", "a\u2003b c", "\x00 \x00\n\x00", "", ""]
    texts += [" ".join(rng.choice(["the", "thereating", "é\n12", "a  b", "", "I'll"]) for _ in range(rng.randrange(9))) for _ in range(300)]
    got = [ids[b:e].tolist() for ids, begins, ends in enc.parts(pa.array(texts)) for b, e in zip(begins, ends)]
    assert got == [lib.encode_ordinary(t) for t in texts]


def test_uneven_white_space_is_what_python_splits_at():
    import pyarrow as pa
    import pyarrow.compute as pc

    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    found = pc.match_substring_regex(pa.array([f"a{c}b" for c in chars]), bpe.UNEVEN).to_pylist()
    assert [c for c, x in zip(chars, found) if x] == [c for c in chars if c.isspace() and c not in " \n"]
    assert pc.match_substring_regex(pa.array([" a", "a ", "\na", "a\n", "a  b", "a \nb", "a\n\nb"]), bpe.UNEVEN).to_pylist() == [True] * 7
    assert pc.match_substring_regex(pa.array(["a", "a b\nc"]), bpe.UNEVEN).to_pylist() == [False] * 2


def test_bytes_without_a_rank():
    """Pairs of bytes without ranks of their own merge; a byte that stays alone has no id."""
    pairs = bpe.BytePairs({b"a": 3, b"xy": 1, b"axy": 2, b"ya": 0}, r"\S*|\s+")
    enc = bpe.TextEncoder.__new__(bpe.TextEncoder)
    enc.pairs, enc.newline, enc.by_words = pairs, 0, False
    for t in ("xya", "axyxy", "a", "", "xyaxy"):
        try:
            want = [x for p in pairs.pattern.findall(t) for x in pairs.merge(p.encode())]
        except KeyError:
            with pytest.raises(KeyError):
                enc(t)
        else:
            assert enc(t) == want


@pytest.mark.parametrize("seed", range(5))
def test_merging_together_is_merging_alone(seed):
    """Also where a merge makes a pair of a lower rank than its own."""
    import pyarrow as pa

    rng = random.Random(seed)
    tokens = {b"a", b"b", b"c"} | {bytes(rng.choices(b"abc", k=rng.randrange(2, 7))) for _ in range(150)}
    pairs = bpe.BytePairs({t: r for r, t in enumerate(rng.sample(sorted(tokens), len(tokens)))}, ".+")
    words = [bytes(rng.choices(b"abc", [8, 3, 1], k=rng.randrange(1, rng.choice([9, 70, 300])))) for _ in range(500)]
    assert pairs.merge_all(pa.array(words, pa.large_binary())).to_pylist() == [pairs.merge(w) for w in words]


# packing


def test_packing(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    rng = random.Random(3)
    rows = [(i, t) for i, t in enumerate([*TRICKY, None])] + [(None, "x y"), (5, "again"), (5, "again")]
    rows += [(100 + i, " ".join(rng.choice(["the", "of", "thereating", "é"]) for _ in range(rng.randrange(900)))) for i in range(120)]
    got = packing.pack(frame(spark, rows)).collect()
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = []
    for d, t in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        for s in range(0, len(ids), 1024):
            part = ids[s : s + 1024]
            want.append((d, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)))
    assert sorted(((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got), key=repr) == sorted(want, key=repr)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 1024
    assert sum(x[2] for x in want) / (1024 * len(sequences)) > 0.95
    assert packing.pack(frame(spark, [])).collect() == []


def test_best_fit_is_tightest():
    rng = np.random.default_rng(6)
    lengths = rng.integers(1, 65, 600)
    which, offset = packing.best_fit(lengths, 64)
    free: list[int] = []
    for i in np.argsort(-lengths, kind="stable"):
        fits = [f for f in free if f >= lengths[i]]
        best = min(fits, default=64)
        assert 64 - offset[i] == best
        if fits:
            free.remove(best)
        free.append(best - lengths[i])
    assert len(free) == which.max() + 1


def test_ids_equal_the_library(tmp_path):
    import json

    import public_tokenizers as P
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    lib, hub, rng = Tokenizer.from_file(path), packing.HubEncoder(path), random.Random(8)
    assert hub.ranked is not None
    texts = TRICKY + ["".join(rng.choice("abc é\n'.,1 ß\t\u2028ǅ٣") for _ in range(rng.randrange(200))) for _ in range(400)] + ["<|endoftext|>", " \n<|endoftext|>  x"]
    for t in texts:
        assert hub(t).tolist() == lib.encode(t, add_special_tokens=False).ids
    spec = json.load(open(path))
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "other.json").write_text(json.dumps(spec))
    other, lib = packing.HubEncoder(str(tmp_path / "other.json")), Tokenizer.from_file(str(tmp_path / "other.json"))
    assert other.ranked is None and all(other(t).tolist() == lib.encode(t, add_special_tokens=False).ids for t in texts if t)


def test_full_windows_stay_where_they_are(spark):
    rows = [(1, "the " * 5000), (2, "short"), (None, "the " * 1023)]
    got = packing.pack(frame(spark, [(*r, 1, 2, "x") for r in rows], "doc_id long, text string, length int, _g int, offset string")).collect()
    full = [r for r in got if r.length == packing.WINDOW]
    assert full and all(r.offset == 0 and r.sequence_id >= packing.FULL for r in full) and len({r.sequence_id for r in full}) == len(full)
    assert all(r.sequence_id < packing.FULL for r in got if r.length < packing.WINDOW)


@pytest.mark.parametrize("op", ["bpe", "packing", "langid", "quality", "exact"])
def test_very_long_texts_repeats_and_clashing_columns(spark, op):
    """One text of a million words beside small ones, repeated rows, ties, and columns named as those made inside: a row each."""
    long = "the of and " * 330_000
    rows = [(1, long, "en"), (2, "x", "en"), (2, "x", "en"), (3, None, None), (None, "the", "en")]
    df = spark.createDataFrame([(*r, "a", "b", 1, 2, 3) for r in rows], "doc_id long, text string, lang string, _text string, _id string, score int, n_tokens int, start int")
    if op == "bpe":
        got = sorted((r.doc_id or 0, r.n_tokens) for r in bpe.digests(df).collect())
        assert got[0][1] > 0 and [n for d, n in got if d == 3] == [0] and [n for d, n in got if d == 1][0] >= 900_000
    elif op == "packing":
        got = packing.pack(df).collect()
        assert sum(r.length for r in got if r.doc_id == 1) == next(r.doc_tokens for r in got if r.doc_id == 1) and sorted(r.doc_id or 0 for r in got if r.doc_id != 1) == [0, 2, 2, 3]
    elif op == "langid":
        got = {r.doc_id: r.lang_pred for r in langid.predict(df, langid.train([("the of and", "en"), ("der die das", "de")])).collect()}
        assert got == {1: "en", 2: got[2], 3: "und", None: "en"}
    elif op == "quality":
        got = quality.score(df, quality.train([("the of", 1), ("bad", 0)] * 10)).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    else:
        got = {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(df).collect()}
        assert got == {(1, 1, 1), (2, 2, 2), (3, 3, 1), (None, None, 1)}


# learned models


def test_scores_equal_unfolded_vectors():
    """Folding changes nothing: the mean of a text's vectors through the softmax layer, by hand."""
    rng = random.Random(6)
    rows = [(" ".join(rng.choice(["good", "fine", "text,", "Words"] if y else ["BAD!!", "buy", "now", "text,"]) for _ in range(rng.randrange(1, 30))), y) for y in (0, 1) * 60]
    s = quality.Settings(buckets=1 << 10)
    table, out, bias = quality.vectors(rows, s)
    one = quality.train(rows, s).scorer()
    for text, _ in [*rows, ("", 0), ("new words here", 0), ("buy " * 3000, 0)]:
        ids, w = quality.features(text, s)
        z = out @ sum(x * table[i].astype(np.float64) for i, x in zip(ids, w)) + bias
        assert one(text) == pytest.approx(np.exp(z[1]) / np.exp(z).sum(), abs=1e-4)


def test_sample_comes_from_texts_that_qualify(spark):
    docs = frame(spark, [(i, "good text" if i % 2 else "bad stuff") for i in range(40)] + [(100 + i, "w" * 50) for i in range(200)])
    labels = frame(spark, [(i, i % 2) for i in range(40)] + [(100 + i, 0) for i in range(200)], "doc_id long, quality int")
    model = quality.fit(docs, labels, s=quality.Settings(max_docs=40, max_chars=20))
    one = model.scorer()
    assert one("good text") > 0.6 > 0.4 > one("bad stuff")


def test_language_against_plain_sets():
    """The filter's shares, corrected, against those of plain sets of n-grams."""
    rng = random.Random(10)
    vocab = {lang: ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(60)] for lang, letters in (("a", "abcdefg"), ("b", "efghijk"), ("c", "abxyz"))}
    rows = [(" ".join(rng.choice(w) for _ in range(20)), lang) for lang, w in vocab.items() for _ in range(30)]
    s = langid.Settings(max_docs=30, min_docs=3)
    one = langid.train(rows, s).predictor()
    sets = {}
    for lang in vocab:
        count = defaultdict(int)
        for t in (t for t, x in rows if x == lang):
            for g in {g for w in langid.letters(t) for g in langid.ngrams(w, s.ngrams)}:
                count[g] += 1
        sets[lang] = {g for g, n in count.items() if n >= 3}
    for text in [t for t, _ in rows] + [" ".join(rng.choice(sum(vocab.values(), [])) for _ in range(9)) for _ in range(100)]:
        grams = [g for w in langid.letters(text) for g in langid.ngrams(w, s.ngrams)]
        share = sorted(((sum(g in x for g in grams) / len(grams), lang) for lang, x in sets.items()), reverse=True)
        lang, score = one(text)
        assert score == pytest.approx(0.5 + (share[0][0] - share[1][0]) / 2, abs=0.01)
        assert lang == share[0][1] or share[0][0] - dict((y, x) for x, y in share)[lang] < 0.01


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_quality_and_language_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    rows = [(r.quality, got[r.doc_id]) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(g.held_out for _, g in rows) and np.mean([(g.score >= 0.3) == y for y, g in rows]) > 0.93
    pred = {r.doc_id: r for r in langid.predict(docs, langid.fit(docs)).collect()}
    hit = [pred[r.doc_id].lang_pred == r.lang for r in docs.select("doc_id", "lang").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean(hit) > 0.98


def test_quality_edges(spark):
    one = quality.train([("good text here", 1)] * 3)
    assert one.scorer()("") == one.scorer()("x") > 0.5
    model = quality.train([("fine words", 1), ("BAD!! BAD!!", 0)] * 20)
    rows = [(1, None), (None, ""), (2, "fine words"), (2, "BAD!! BAD!!"), (3, "w" * 100_000)]
    got = quality.score(frame(spark, rows), model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    kept = quality.keep_good(frame(spark, [(2, "fine words", "a"), (3, "BAD!! BAD!!", "b")], "doc_id long, text string, score string"), model)
    assert kept.columns == ["doc_id", "text", "score"] and [r.score for r in kept.collect()] == ["a"]
    assert quality.score(frame(spark, []), model).collect() == []
    none = quality.fit(frame(spark, [(1, "a")]), frame(spark, [], "doc_id long, quality int"))
    assert 0 <= none.scorer()("a") <= 1


def test_language_edges(spark):
    rows = [(i, "der und die", "de") for i in range(40)] + [(100 + i, "the and of", "en") for i in range(40)]
    rows += [(200, None, "en"), (201, "", "de"), (202, "123 !!", "en"), (203, "und", None), (None, "the", None)]
    df = frame(spark, rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.predict(df, langid.fit(df)).collect()}
    assert [got[i].lang_pred for i in (200, 201, 202, 203, None)] == ["und", "und", "und", "de", "en"]
    assert langid.predict(df, langid.fit(df.limit(0))).where("lang_pred <> 'und'").count() == 0


def test_language_filter_grows_without_a_switch():
    kept = []
    for n in (29, 30, 31):
        model = langid.train([("one rare", "en")] + [("the of", "en")] * (n - 1))
        kept.append([int(m) for m in model.filter.masks([" ra", "rare", " th"])])
    assert kept == [[1, 1, 1]] * 3


def test_more_than_64_languages():
    rng = random.Random(9)
    words = {f"l{i:03}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(12)] for i in range(150)}
    model = langid.train([(" ".join(w), lang) for lang, w in words.items()])
    one = model.predictor()
    assert all(one(" ".join(w[:6]))[0] == lang for lang, w in words.items())


def test_mask_filter_has_no_misses():
    f = langid.MaskFilter(1 << 12, 3)
    grams = [f"g{i}" for i in range(600)]
    for i, g in enumerate(grams):
        f.add(g, i % 5)
    masks = f.masks(grams)
    assert all(int(m) >> (i % 5) & 1 for i, m in enumerate(masks))
    others = f.masks([f"x{i}" for i in range(20_000)])
    seen = [np.mean((others >> np.uint64(k)) & np.uint64(1)) for k in range(5)]
    assert np.allclose(seen, f.false_rate(5), atol=0.003)


# pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>
<!-- <p>hidden</p> --><div class="ad">Buy now</div><article><h1>Head &amp; line</h1><p><b>One  two
three.<br>four<p>Caf&eacute; &#x41;&nbsp;b, and more text.</p><ul><li>item <i>one</i><li>item two</ul><aside>Related</aside>
<form><input name=q><button>Go</button></form><div id="comments"><p>First! Great article, thanks.</p></div></article>
<div class="sidebar"><p>Side</p></div><footer>&copy; x</footer></body></html>"""


def test_article():
    assert html_extract.extract(PAGE) == "Head & line\n\nOne two three. four\n\nCafé A b, and more text.\n\nitem one\n\nitem two"


def test_without_article_element():
    body = "<p>" + "A long sentence, with marks. " * 12 + "</p>"
    page = f"<body><div><ul><li><a href=x>Home</a></li><li><a href=y>More</a></li></ul></div><div><h2>Title</h2>{body}{body}</div><div><a href=z>Next</a></div></body>"
    text = html_extract.extract(page)
    assert text.startswith("Title\n\nA long sentence") and "Home" not in text and "Next" not in text


LONG = "A long sentence, with marks. " * 11 + "A long sentence, with marks."


def extracted(body):
    return html_extract.extract(f"<html><head><title>T</title></head><body>{body}</body></html>").replace(LONG, "LONG").split("\n\n")


def test_ratios_decide_beside_article_and_main():
    assert extracted(f"<div><article><p>A teaser card.</p></article></div><div><p>{LONG}</p><p>{LONG}</p></div>") == ["LONG", "LONG"]
    links = "<ul><li><a href=x>One link</a><li><a href=y>Two links</a></ul>"
    for tag in ("article", "main"):
        assert extracted(f"<{tag}><h1><a href=t>Title</a></h1><p>{LONG}</p>{links}<p>The end.</p><div>Buy now</div></{tag}>") == ["Title", "LONG", "The end."]
    assert extracted(f"<article><p>{LONG}</p><table><tr><td><a href=x>a name</a><td>42</table></article>") == ["LONG", "a name", "42"]


def test_short_parts_of_the_content_stay():
    parts = "<blockquote>Quoted words.</blockquote><table><tr><td>42<td>cell</table>"
    assert extracted(f"<div><section><p>{LONG}</p><p>{LONG}</p></section><section><p>Short one.</p></section>{parts}</div>") == ["LONG", "LONG", "Short one.", "Quoted words.", "42", "cell"]
    assert extracted(f"<section><p>{LONG}</p></section><section><ul><li>Short</ul></section>") == ["LONG", "Short"]
    assert extracted(f"<div><p>{LONG}</p></div><div><table><tr><td>42</table></div><div>Buy now</div>") == ["LONG", "42"]


@pytest.mark.parametrize("name", ["layout with-sidebar", "overflow-hidden", "search-results", "sidebar", "widget"])
def test_marks_do_not_empty_a_page(name):
    assert extracted(f"<div class='{name}'><article><p>{LONG}</p></article></div><div class='sidebar'><p>Side.</p></div>") == ["LONG"]
    assert extracted(f"<div class='{name}'><div><p>{LONG}</p></div></div><div class='ad-slot'>An advert.</div>") == ["LONG"]
    assert extracted(f"<form><div class='{name}'><p>{LONG}</p></div><aside><p>Side.</p></aside></form><footer>Owner. Year.</footer>") == ["LONG"]


def test_marks_are_heard_and_the_head_ends():
    assert extracted(f"<article><p>{LONG}</p><div class='comments'><p>{LONG}</p></div></article>") == ["LONG"]
    assert extracted(f"<aside><article><p>A teaser card.</p></article></aside><div><p>{LONG}</p></div>") == ["LONG"]
    assert extracted("<nav><a href=x>Home</a></nav><footer>Owner. Year.</footer>") == [""]
    for page in (f"<html><head><title>T</title><meta x><body><p>{LONG}</p>", f"<head><title>T</title><p>{LONG}</p>", f"<head><title>T</title>{LONG}"):
        assert html_extract.extract(page) == LONG


@pytest.mark.parametrize("page", ["", "plain words", "<", "<p", "<!--", "</p></p>", "<script>x", "<a href='", "<p>İ<script>q</SCRIPT>z</p>", "<div>" * 2000 + "deep" + "</div>" * 2000])
def test_broken_pages(page):
    text = html_extract.extract(page)
    assert "<script" not in text and (not page or text is not None)
    assert "q" not in text or page == "plain words"


@pytest.mark.parametrize(
    "body, want",
    [
        (f"<div class='layout no-sidebar'><article><p>{LONG}</p></article></div>", ["LONG"]),
        (f"<article><p>LONG, it is.</p><p title='the hidden valley'>{LONG}</p></article>", ["LONG, it is.", "LONG"]),
        ("<article><p data-class='ad' data-x=hidden>One line, of text.</p></article>", ["One line, of text."]),
        ("<article><p>Some <a title='5' tall\">x</a>, and words.</p></article>", ["Some x, and words."]),
        ("<article><p data-x=it's>Hello there.</p><p>And it's two.</p></article>", ["Hello there.", "And it's two."]),
        ("<article><p class=search>Of search.</p><table class=form><tr><td>Form, of a kind.</table><p class='alert'>An alert.</p><div class='entry-header'><h1>Head</h1></div></article>", ["Of search.", "Form, of a kind.", "An alert.", "Head"]),
    ],
)
def test_attributes_lose_no_text(body, want):
    assert extracted(body) == want


@pytest.mark.parametrize("page", ["<b>" * 330_000 + "x", "<i><div>" + "<b></i>" * 150_000 + "x", "<p><div>" * 100_000 + "x", "<li>" * 250_000 + "x", "<a href='" + "<p " * 300_000, "<div a=" * 140_000, "<table><tr><td>" * 70_000 + "x", "</p>" * 250_000 + "x"])
def test_a_megabyte_of_open_tags(page):
    began = time.process_time()
    html_extract.extract(page)
    assert time.process_time() - began < 20


def test_path_table_against_brute_force():
    """Ratios of every tag path, smoothed and fused, from a parse by the standard library."""
    from html.parser import HTMLParser

    rng = random.Random(4)
    words = ["alpha", "beta,", "gamma.", "delta", "one; two", "three!"]

    def some(depth):
        if depth == 0 or rng.random() < 0.3:
            return "<p>" + " ".join(rng.choice(words) for _ in range(rng.randrange(1, 30))) + "</p>"
        tag = rng.choice(["div", "section", "blockquote"])
        return f"<{tag}>" + "".join(some(depth - 1) for _ in range(rng.randrange(1, 4))) + f"</{tag}>"

    class Paths(HTMLParser):
        def __init__(self):
            super().__init__()
            self.stack, self.table = [], {}

        def handle_starttag(self, tag, attrs):
            self.stack.append(tag)

        def handle_endtag(self, tag):
            self.stack.pop()

        def handle_data(self, data):
            row = self.table.setdefault(tuple(self.stack), [0, 0, 0])
            row[0] += len(data)
            row[1] += sum(data.count(c) for c in ".,;:!?")
            row[2] += 1

    for _ in range(20):
        page = "<body>" + "".join(some(4) for _ in range(4)) + "</body>"
        brute, s = Paths(), html_extract.Settings()
        brute.feed(page)
        nodes, tree = html_extract.blocks(page)
        for n in nodes:
            n.text = "".join(n.parts)
            n.marks = len(html_extract._SENTENCE.findall(n.text))
        names = {}
        for e in tree[1:]:
            names[e.path] = (*names.get(tree[e.parent].path, ()), e.tag)
        got = html_extract.ratios(nodes, tree, s)
        rows = list(brute.table.values())
        for i, (path, (chars, marks, count)) in enumerate(brute.table.items()):
            number = next(k for k, v in names.items() if v == path)
            assert got.raw[number] == pytest.approx((chars / count * (marks + 1) / count) ** 0.5)
            near = [rows[j] for j in (i - 1, i + 1) if 0 <= j < len(rows)]
            fused = 1.0
            for own, others in ((chars / count, [c / n for c, _, n in near]), ((marks + 1) / count, [(m + 1) / n for _, m, n in near])):
                fused *= own if not others else own + s.smooth * max(0, sum(others) / len(others) - own)
            assert got.fused[number] == pytest.approx(fused**0.5)


def test_the_ratio_step_chooses(monkeypatch):
    """With all ratios equal, boxes of fragments pass for content."""
    fragments = "<div><span>Buy now</span></div><div><span>On sale</span></div>"
    page = f"<article><p>{LONG}</p><p>{LONG}</p>{fragments}</article>"
    assert extracted(page) == ["LONG", "LONG"]
    monkeypatch.setattr(html_extract, "fuse", lambda chars, marks, nodes: 1.0)
    assert extracted(page) != ["LONG", "LONG"]


def test_pages_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "a", 2, "b"), (1, "u", PAGE, "a", 2, "b"), (None, None, None, None, None, None)], "page_id long, url string, html string, text string, n_chars long, _html string")
    got = sorted(((r.page_id or 0, r.n_chars) for r in html_extract.extract_pages(df).collect()))
    assert got == [(0, 0), *[(1, len(html_extract.extract(PAGE)))] * 2]


def test_pages_frame(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", "")], "page_id long, url string, html string")
    got = html_extract.extract_pages(df).collect()
    assert len(got) == 4 and sorted(r.n_chars for r in got)[:2] == [0, 0] and all(r.n_chars == len(r.text) for r in got)
    assert html_extract.extract_pages(df.limit(0)).collect() == []


# audio


def wav(x, rate=4000, channels=1):
    data = np.repeat((np.clip(x, -1, 1) * 32000).astype("<i2"), channels).tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * 2 * channels, 2 * channels, 16) + b"data" + struct.pack("<I", len(data)) + data


def song(seed, words=400):
    rng = random.Random(seed)
    return chroma.sonify(chroma.Settings())(" ".join(f"w{rng.randrange(5000)}" for _ in range(words)))


def test_wav_round_trip():
    x = song(1)
    for channels in (1, 2):
        got, rate = chroma.decode_wav(wav(x, channels=channels))
        assert rate == 4000 and np.allclose(got, x, atol=0.05)
    assert chroma.decode_wav(b"nothing") is None and chroma.decode_wav(None) is None
    assert abs(len(chroma.wav_samples(chroma.Settings())(wav(x, rate=8000))) - len(x) / 2) <= 1


def test_match_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = [song(i) for i in range(6)]
    media = {50: base[0], 1: base[0], 2: base[0][256 * 20 :], 3: base[0] + 0.02 * rng.standard_normal(len(base[0])), 100: base[1], 4: np.concatenate((base[2][: 256 * 15], base[1])), 5: base[3], 6: base[4], 7: np.zeros(20_000)}
    rows = [(k, wav(v)) for k, v in media.items()] + [(8, None), (9, b"junk"), (None, wav(base[5]))]
    df = spark.createDataFrame(rows, "rec_id long, audio binary").repartition(3)
    from pyspark.sql import functions as F

    s = chroma.Settings()
    members, pairs = chroma.match(df, "rec_id", "audio", F.col("rec_id") % 50 == 0, s)
    got = {(r.query_class, r.class_id): (r.offset, r.frames, round(r.bit_error, 9)) for r in pairs.collect()}
    own = {k: chroma.prints(chroma.chroma(chroma.wav_samples(s)(a), s)) for k, a in rows if k is not None}
    classes = defaultdict(list)
    for k, (p, _) in own.items():
        if len(p):
            classes[p.tobytes()].append(k)
    reps = {min(v): any(x % 50 == 0 for x in v) for v in classes.values()}
    want = {}
    for q in (q for q, is_query in reps.items() if is_query):
        for r in reps:
            n = defaultdict(int)
            (a, heard), (b, there) = own[q], own[r]
            for i in range(len(a) - 1):
                for j in np.flatnonzero((b[:-1] == a[i]) & (b[1:] == a[i + 1]) & there[:-1] & there[1:]) if heard[i] and heard[i + 1] else ():
                    n[int(j) - i] += 1
            if q != r and n and max(n.values()) >= s.hits:
                o = min(o for o, c in n.items() if c == max(n.values()))
                m, e = chroma.align(own[q][0], own[r][0], o)
                if m >= s.overlap and e <= s.errors:
                    want[q, r] = (o, m, round(e, 9))
    assert got == want
    assert {(1, 2), (1, 3), (100, 4)} <= set(got) and got[1, 2][0] == -20 and got[100, 4][0] == 15 and not any(r in (5, 6) for _, r in got)
    cls = {r.rec_id: r.class_id for r in members.collect()}
    assert cls[50] == cls[1] == 1 and cls[8] == 8 and len(cls) == len(rows)
    assert chroma.summary(members, pairs).count() == len(rows)


def test_every_offset_with_hits_is_tried(spark, monkeypatch):
    from pyspark.sql import functions as F

    s = chroma.Settings()
    rng = np.random.default_rng(4)
    x = rng.integers(0, 1 << 32, 40, dtype=np.uint64).astype("<u4")
    # the first five integers also stand where the rest differs, with as many hits as the true place has
    near = x.copy()
    near[5:] ^= np.uint32(1)
    y = np.concatenate((x[:5], rng.integers(0, 1 << 32, 45, dtype=np.uint64).astype("<u4"), near))
    table = {0.0: x, 1.0: y}
    df = spark.createDataFrame([(50, 0.0), (1, 1.0)], "rec_id long, media double")

    def rows(df, id_col, media_col, s, samples=None):
        data = [(k, table[m].tobytes(), b"\1" * len(table[m]), k) for k, m in ((50, 0.0), (1, 1.0))]
        return df.sparkSession.createDataFrame(data, "rec_id long, prints binary, sound binary, fp long")

    monkeypatch.setattr(chroma, "fingerprints", rows)
    got = chroma.match(df, "rec_id", "media", F.col("rec_id") % 50 == 0, s)[1].collect()
    assert [(r.query_class, r.class_id, r.offset, r.frames) for r in got] == [(50, 1, 50, 40)]


def test_short_turns_have_prints_and_classes(spark, tmp_path):
    from strandmatrix.llm import queries

    rng = random.Random(5)
    words = [f"w{rng.randrange(5000)}" for _ in range(60)]
    turns = {(50, 0): words[:5], (1, 0): words[:5], (50, 1): words[20:32], (2, 0): words[20:31] + ["other"], (3, 0): words[10:50], (4, 0): ["hi", "you"], (5, 0): ["hi", "you"], (6, 0): ["hi", "they"], (7, 0): []}
    spark.createDataFrame([(c, t, " ".join(w)) for (c, t), w in turns.items()], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.rec_id >> 32, r.rec_id & 7): r for r in queries.op5_chroma_prints(spark, str(tmp_path)).collect()}
    assert all(got[k].n_prints >= chroma.TURN.overlap for k, w in turns.items() if len(w) >= 5)
    assert got[50, 0].class_id == got[1, 0].class_id == got[1, 0].rec_id
    assert got[4, 0].class_id == got[5, 0].class_id == got[4, 0].rec_id != got[6, 0].class_id
    assert got[2, 0].best_query == got[3, 0].best_query == got[50, 1].rec_id and got[7, 0].class_id == got[7, 0].rec_id


def test_integral_image_equals_direct_sums():
    image = np.random.default_rng(1).integers(0, 9000, (30, 12))
    wide = np.concatenate((image, image), 1)
    kind, p, h, w = chroma.filters()[0]
    assert kind == 1
    got, _ = chroma.prints(image)
    gray = np.array([0, 1, 3, 2])
    for t in range(len(got)):
        a, b = wide[t : t + w, p : p + h // 2].sum() + chroma.FLOOR, wide[t : t + w, p + h // 2 : p + h].sum() + chroma.FLOOR
        assert int(got[t]) >> 30 == gray[sum(a >= x * b for x in chroma.THRESHOLDS)]


def test_prints_do_not_depend_on_the_neighbours():
    s = chroma.Settings()
    x = [song(i, n) for i, n in enumerate((3, 40, 0, 400, 9, 41))] + [np.zeros(5000, np.float32)]
    for (p, ok), y in zip(chroma.prints_of(x, s), x):
        q, fine = chroma.prints(chroma.chroma(y, s))
        assert p.tolist() == q.tolist() and ok.tolist() == fine.tolist()
    assert chroma.prints_of([], s) == []


def test_recordings_of_all_kinds(spark):
    """A very long recording, repeated rows, ties, an empty table and columns whose names clash with those made inside."""
    from pyspark.sql import functions as F

    long = song(7, 40_000)
    rows = [(50, wav(long), 1, 2, 3), (1, wav(long), 4, 5, 6), (1, wav(long), 4, 5, 6), (3, wav(long[256 * 1000 :]), 7, 8, 9), (4, None, 0, 0, 0), (4, None, 0, 0, 0)]
    df = spark.createDataFrame(rows, "rec_id long, audio binary, class_id long, _deal long, prints long")
    got = chroma.summary(*chroma.match(df, "rec_id", "audio", F.col("rec_id") % 50 == 0)).collect()
    assert sorted((r.rec_id, r.class_id, r.n_links, r.best_offset) for r in got) == [(1, 1, 0, None), (1, 1, 0, None), (3, 3, 1, -1000), (4, 4, 0, None), (4, 4, 0, None), (50, 1, 0, None)]
    assert chroma.summary(*chroma.match(df.limit(0), "rec_id", "audio", F.col("rec_id") % 50 == 0)).collect() == []


def test_language_ngrams_are_looked_up_once(monkeypatch):
    """More n-grams than some thousand stay at hand: texts of new words with known n-grams look none up again."""
    calls, at = [], langid.MaskFilter._at
    model = langid.train([("the of and", "en"), ("der die das", "de")])
    monkeypatch.setattr(langid.MaskFilter, "_at", lambda self, g: calls.append(g) or at(self, g))
    rng = random.Random(3)
    one = model.predictor()
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(8000)]
    for i in range(3):
        one(" ".join(w.upper() if i == 1 else w.title() if i == 2 else w for w in words))
    assert len(calls) == len(set(calls)) > 10_000
