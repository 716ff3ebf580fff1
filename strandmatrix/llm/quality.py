"""Quality classifier: supervised subword embeddings, trained by numpy stochastic gradient descent.

A text is the average of learned vectors, one for each of its words and of the words'
character n-grams, all hashed into one table; a softmax layer reads the average. Since that layer is
linear, a trained table folds into one number for each feature, and scoring a text is an average of
numbers: whole texts are scored at the speed of splitting them.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmatrix.llm.common import WordCache, keep_caches, sliced, texts


@dataclass(frozen=True)
class Settings:
    """max_docs and max_bytes bound the labelled sample that is fitted, whatever the table's size.

    Rows come in the order of a hash of their id, of those whose text has at most max_chars (longer ones are scored like others).
    """

    max_docs: int = 6000
    max_chars: int = 20_000
    buckets: int = 1 << 17
    dim: int = 8
    ngrams: tuple[int, ...] = (3, 4)
    epochs: int = 4
    rate: float = 0.6
    seed: int = 7


def word_features(word: str, s: Settings) -> list[int]:
    """Bucket of the word, of its case and punctuation pattern, and of its character n-grams."""
    crc, n, raw = zlib.crc32, s.buckets, f"<{word}>".encode()
    shape = "".join("A" if c.isupper() else "a" if c.islower() else "0" if c.isdigit() else c for c in word[:1] + word[-3:])
    out = [crc(raw) % n, crc(b"shape " + shape.encode()) % n]
    for size in s.ngrams:
        out += [crc(raw[i : i + size]) % n for i in range(len(raw) - size + 1)]
    return out


def _pseudo(words: list[str]) -> list[tuple[str, int]]:
    """Pseudo-words for what single words do not show: repeats. Each counts as a share of the words."""
    n = len(words)
    if not n:
        return [(" empty", 1)]
    again = sum(map(str.__eq__, words[1:], words))
    variety = int(10 * len(set(words)) / n)
    return [(" again", again), (f" variety {variety} of {min(n, 2000).bit_length()}", 1 + n // 10)]


def features(text: str, s: Settings, cache: WordCache | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, weights summing to 1) of a text."""
    cache = cache if cache is not None else WordCache(lambda w: word_features(w, s))
    words = text.split()
    flat = [b for w in words for b in cache[w]]
    for w, times in _pseudo(words):
        flat += [zlib.crc32(w.encode()) % s.buckets] * times * 8
    ids, counts = np.unique(np.array(flat, np.int64), return_counts=True)
    return ids, (counts / counts.sum()).astype(np.float32)


@dataclass
class Model:
    """Per-feature evidence for label 1, and the bias."""

    settings: Settings
    evidence: np.ndarray
    bias: float

    def scorer(self):
        s, table = self.settings, self.evidence.tolist()

        def word(w: str) -> complex:
            f = word_features(w, s)
            return complex(sum(map(table.__getitem__, f)), len(f))

        cache, pseudo = WordCache(word), WordCache(lambda w: table[zlib.crc32(w.encode()) % s.buckets])

        def score(text: str) -> float:
            words = text.split()
            got = sum(map(cache.__getitem__, words), 0j)  # evidence and number of features, summed as one value
            total, n = got.real, got.imag
            for w, times in _pseudo(words):
                total += pseudo[w] * times * 8
                n += times * 8
            return float(1 / (1 + np.exp(-np.clip(total / max(n, 1) + self.bias, -30, 30))))

        return score


def train(rows: list[tuple[str, int]], s: Settings = Settings()) -> Model:
    """A model of (text, 0/1) pairs: the trained vectors folded into a number a feature."""
    table, out, bias = vectors(rows, s)
    return Model(s, (table @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))


def vectors(rows: list[tuple[str, int]], s: Settings = Settings()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vector of each bucket, output layer, its bias) by SGD, one text a step, the rate falling to 0. Without both labels all vectors are zero, and scores the share of 1s."""
    rng = np.random.default_rng(s.seed)
    labels = np.array([y for _, y in rows], np.int64)
    share = (labels.sum() + 1) / (len(labels) + 2)
    prior = float(np.log(share / (1 - share)))
    if len(set(labels.tolist())) < 2:
        return np.zeros((s.buckets, s.dim), np.float32), np.zeros((2, s.dim), np.float32), np.array([0, prior], np.float32)
    cache = WordCache(lambda w: word_features(w, s))
    data = [features(t, s, cache) for t, _ in rows]
    table = rng.uniform(-1 / s.dim, 1 / s.dim, (s.buckets, s.dim)).astype(np.float32)
    out, bias = np.zeros((2, s.dim), np.float32), np.array([0, prior], np.float32)
    steps, done = s.epochs * len(data), 0
    for _ in range(s.epochs):
        for i in rng.permutation(len(data)):
            ids, w = data[i]
            rate = s.rate * (1 - done / steps)
            done += 1
            h = w @ table[ids]
            z = out @ h + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = p @ out
            out -= rate * np.outer(p, h)
            bias -= 0.1 * rate * p
            table[ids] -= (rate * len(ids) ** 0.5) * np.outer(w, back)
    return table, out, bias


def crc32_text(column: F.Column) -> F.Column:
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held_out: int = 0, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Trains on a bounded sample of labelled rows outside the held-out fold. Null labels and ids do not take part; of an id's several labels the lowest counts."""
    known = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label).cast("int").alias("_y")).where("_y in (0, 1) and _id is not null").where(F.pmod(crc32_text(F.col("_id")), F.lit(folds)) != held_out)
    d = texts(docs, id_col, text_col).where(F.col("_id").isNotNull() & (F.length("_text") <= s.max_chars))
    one = known.groupBy("_id").agg(F.min("_y").alias("_y")).join(d.select("_id"), "_id", "left_semi")
    picked = one.orderBy(F.xxhash64("_id", F.lit(s.seed)), "_id").limit(s.max_docs)
    rows = d.join(F.broadcast(picked), "_id").select("_id", "_text", "_y").collect()  # at most max_docs rows of max_chars
    return train([(r._text, r._y) for r in sorted(rows, key=lambda r: (r._id, r._text))], s)


def score(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_out: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each input row, without a shuffle.

    Null counts as empty; an empty text has the score of the pseudo-word for it. Texts count whole, whatever their length. Identifiers may
    repeat or be null (fold of the empty string); other columns are not read. An empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a table of fixed size

    def rows(batches):
        with keep_caches():
            one = sent.value.scorer()
            for b in sliced(batches):
                yield pa.RecordBatch.from_arrays([b[0], pa.array([one(t) for t in b[1].to_pylist()], pa.float64())], ["doc_id", "score"])

    got = texts(docs, id_col, text_col).mapInArrow(rows, "doc_id long, score double")
    return got.select("doc_id", (F.pmod(crc32_text(F.col("doc_id")), F.lit(folds)) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs that score at least the threshold, with all their columns in place: a map-only filter."""
    sent, schema = docs.sparkSession.sparkContext.broadcast(model), docs.schema
    at = docs.columns.index(text_col)

    def rows(batches):
        with keep_caches():
            one = sent.value.scorer()
            for b in sliced(batches):
                yield b.filter(pa.array([one(t or "") >= threshold for t in b[at].to_pylist()], pa.bool_()))

    return docs.mapInArrow(rows, schema)
