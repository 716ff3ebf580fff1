"""The pipeline against a brute-force version, and the registered queries against SQL."""

import os
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from strandmatrix.llm import quality, queries
from tests.llm.test_jaccard import shingle_set

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


def brute(spark):
    docs, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    good = quality.fit(docs, labels).scorer()
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if good(r.text or "") >= corpus_pipeline.THRESHOLD)
    first = {}
    for d, t in rows:
        first.setdefault(t or "", d)
    rows = [(d, t) for d, t in rows if first[t or ""] == d]
    sets = [shingle_set(t, 5) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    rows = [r for i, r in enumerate(rows) if root[i] == i]
    seen, cut = set(), []
    for d, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            if w in seen:
                gone[p : p + 100] = True
            seen.add(w)
        cut.append((d, bytes(np.frombuffer(raw, np.uint8)[~gone]).decode("utf-8", "ignore")))
    return cut


def test_pipeline(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    lib, want = Tokenizer.from_file(P.path("byte_bpe_50k.json")), []
    for d, t in brute(spark):
        ids = [*lib.encode(t, add_special_tokens=False).ids, 0]
        for s in range(0, len(ids), 1024):
            want.append((d, s, len(ids[s : s + 1024]), zlib.crc32(np.array(ids[s : s + 1024], "<u4").tobytes()), len(ids)))
    got = corpus_pipeline.run(spark, DIR).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == sorted(want)
    ends = defaultdict(int)
    for r in got:
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 1024


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "suffix-array dedup", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DIR)
        assert out.columns == docs.columns
        assert out.count() <= docs.count()


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Null and empty texts, a null id, repeated rows, columns whose names clash, and no rows at all."""
    good = [r for r in spark.read.parquet(f"{DIR}/documents.parquet").collect() if r.n_chars > 2000][:6]
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, "g", 1, 2) for r in good]
    odd = [(900, None, "en", "s", None, "g", 1, 2), (901, "", "en", "s", 0, "g", 1, 2), (902, "", "en", "s", 0, "g", 1, 2), (None, good[0].text, "en", "s", 1, "g", 1, 2), rows[1]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _g string, _key int, rng int"
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    for name, some in (("odd", rows + odd), ("none", [])):
        spark.createDataFrame(some, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        ids = [r.doc_id for r in got if r.start == 0]
        assert len(ids) == len(set(ids)) and (set(ids) <= {r[0] for r in some})
        assert not some or {r.doc_id for r in good} & set(ids)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    df, cur = queries.QUERIES[name](spark, DIR), con.execute(queries.SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr) == sorted(cur.fetchall(), key=repr)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_one_row_for_each_input_row(spark, name):
    table = {"op2_html_extraction": "pages", "op5_chroma_prints": "conversations"}.get(name, "documents")
    rows = queries.QUERIES[name](spark, DIR).count()
    there = spark.read.parquet(f"{DIR}/{table}.parquet").count()
    assert rows >= there if name == "op7_packing" else rows == there
