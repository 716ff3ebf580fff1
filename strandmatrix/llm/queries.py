"""The registered queries: each operator over its whole table, as the driver's contracts ask."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmatrix.llm import bpe, chroma, exact_dedup, html_extract, jaccard_join, langid, packing, quality, rlz_dedup, suffix_dedup
from strandmatrix.llm.common import ship


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{d}/{name}.parquet")


def op1_exact_dedup(spark, d):
    return exact_dedup.exact_dedup(_table(spark, d, "documents"), keep="max").drop("fp")


def op2_html_extraction(spark, d):
    return html_extract.extract_pages(_table(spark, d, "pages"))


def op3_substring_dedup(spark, d):
    return rlz_dedup.substring_dedup(_table(spark, d, "documents"))


def op4_byte_bpe(spark, d):
    return bpe.digests(_table(spark, d, "documents"))


def op5_chroma_prints(spark, d):
    """Every turn of every conversation is a recording, rendered from its text, as no table holds audio; turns of conversations with an id divisible by 50 are the queries."""
    turns = _table(spark, d, "conversations").select((F.col("conv_id") * F.lit(1 << 32) + F.col("turn")).alias("rec_id"), "text")
    query = (F.shiftright("rec_id", 32) % 50) == 0
    return chroma.summary(*chroma.match(turns, "rec_id", "text", query, chroma.TURN, chroma.sonify(chroma.TURN, chroma.TURN_NOTE, chroma.TURN_REST)))


def op6_quality(spark, d):
    docs = _table(spark, d, "documents")
    return quality.score(docs, quality.fit(docs, _table(spark, d, "labels")))


def op7_packing(spark, d):
    return packing.pack(_table(spark, d, "documents"))


def op8_language_id(spark, d):
    docs = _table(spark, d, "documents")
    return langid.predict(docs, langid.fit(docs))


def op9_suffix_dedup(spark, d):
    return suffix_dedup.suffix_dedup(_table(spark, d, "documents"))


def op10_jaccard_join(spark, d):
    return jaccard_join.near_duplicates(_table(spark, d, "documents"), shingle=3, percent=90)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_html_extraction": op2_html_extraction,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_chroma_prints": op5_chroma_prints,
    "op6_quality": op6_quality,
    "op7_packing": op7_packing,
    "op8_language_id": op8_language_id,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_jaccard_join": op10_jaccard_join,
}

SQL: dict[str, str] = {
    "op1_exact_dedup": """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.text) AS text_sha256 FROM t JOIN g ON t.text = g.text""",
    "op3_substring_dedup": r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, md5(array_to_string(list_slice(w, p, p + 49), ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM t)),
fst AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, p + k AS q FROM (SELECT doc_id, p, unnest(range(0, 50)) AS k FROM win JOIN fst USING (h) WHERE m < doc_id)),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS q FROM t),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY q) AS s FROM word ANTI JOIN gone USING (doc_id, q) GROUP BY doc_id)
SELECT t.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM t LEFT JOIN kept USING (doc_id)""",
    "op9_suffix_dedup": r"""
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (SELECT doc_id, p, md5(substr(x, 2 * p + 1, 200)) AS h FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 99)) AS p FROM t)),
dup AS (SELECT doc_id, p FROM win QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, p) > 1),
span AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM (SELECT doc_id, p, sum(brk) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS brk FROM dup)) GROUP BY doc_id, run),
cut AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM span),
kept AS (SELECT doc_id, sum(b - a) AS n, count(*) AS k, max(b) AS e, string_agg(substr(x, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS s FROM cut JOIN t USING (doc_id) GROUP BY doc_id)
SELECT t.doc_id, length(x) // 2 AS n_bytes, cast(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(k, 0) AS n_spans, sha256(unhex(coalesce(s || substr(x, 2 * e + 1), x))) AS kept_sha256 FROM t LEFT JOIN kept USING (doc_id)""",
    "op10_jaccard_join": r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, md5(array_to_string(list_slice(w, p, p + 2), ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS p FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
sym AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a, b FROM sym UNION SELECT r.a, s.b FROM reach r JOIN sym s ON r.b = s.a),
comp AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, least(t.doc_id, coalesce(m, t.doc_id)) AS component_id FROM t LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)""",
}
