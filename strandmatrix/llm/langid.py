"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter has a row of one bit per language at every slot. An n-gram's slots,
ANDed, give at once the mask of all languages that hold it. A text adds up, over its
n-grams, each language's bits; the counts are corrected for false positives, at the rate that the
filter's fill implies, and the largest share decides.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache, reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmatrix.llm.common import WordCache, keep_caches, sliced, texts
from strandmatrix.llm.quality import crc32_text

UNKNOWN = "und"
#: Bits of a counter. All counters of a word, the n-grams and each language's hits, lie side by side in one integer.
FIELD = 40


@dataclass(frozen=True)
class Settings:
    """max_docs a language, each of at most max_chars, bound what is learned from, whatever the table's size; min_docs of max_docs must hold an n-gram."""

    max_docs: int = 800
    max_chars: int = 20_000
    slots: int = 1 << 19
    hashes: int = 3
    ngrams: tuple[int, ...] = (3, 4)
    min_docs: int = 3
    seed: int = 11


def ngrams(word: str, sizes: tuple[int, ...]) -> list[str]:
    """Character n-grams of a lower-cased word with its ends marked; a short word gives itself."""
    w = f" {word.lower()} "
    out = [w[i : i + n] for n in sizes for i in range(len(w) - n + 1)]
    return out or [w]


def letters(text: str) -> list[str]:
    """Words of a text with all but letters cut from their ends."""
    out = []
    for w in text.split():
        if not w.isalpha():
            w = "".join(c if c.isalpha() else " " for c in w)
            out.extend(w.split())
        else:
            out.append(w)
    return out


class MaskFilter:
    """The bit-sliced Bloom filter: slot -> bits of the languages, in as many 64-bit words as they need."""

    def __init__(self, slots: int, hashes: int, languages: int = 64):
        self.words = max(1, -(-languages // 64))
        self.table, self.slots, self.hashes = np.zeros((slots, self.words), np.uint64), slots, hashes

    def _at(self, gram: str) -> list[int]:
        raw = gram.encode()
        a, b = zlib.crc32(raw), zlib.crc32(raw, 0x9E3779B9) | 1
        return [(a + i * b) % self.slots for i in range(self.hashes)]

    def add(self, gram: str, language: int) -> None:
        for at in self._at(gram):
            self.table[at, language // 64] |= np.uint64(1 << language % 64)

    def masks(self, grams: list[str]) -> np.ndarray:
        """A mask for each n-gram, a row of words if there are several."""
        at = np.array([self._at(g) for g in grams], np.int64)
        got = np.bitwise_and.reduce(self.table[at], axis=1)
        return got[:, 0] if self.words == 1 else got

    def rows(self) -> list[int]:
        """Each slot's languages as one integer, for looking up n-grams one by one."""
        if self.words == 1:
            return self.table[:, 0].tolist()
        return [int.from_bytes(x.tobytes(), "little") for x in self.table.astype("<u8")]

    def false_rate(self, languages: int) -> np.ndarray:
        """Chance, for each language, that an n-gram it lacks shows its bit."""
        fill = np.array([np.count_nonzero(self.table[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)) for i in range(languages)]) / self.slots
        return fill**self.hashes


@dataclass
class Model:
    settings: Settings
    languages: list[str]
    filter: MaskFilter

    def predictor(self):
        s, k = self.settings, len(self.languages)
        false = self.filter.false_rate(k)
        wide, field = [1 << FIELD * (i + 1) for i in range(k)], (1 << FIELD) - 1

        slots, at = self.filter.rows(), self.filter._at

        @lru_cache(1 << 16)
        def counters(mask: int) -> int:
            return 1 + sum(w for i, w in enumerate(wide) if mask >> i & 1)

        grams = WordCache(lambda g: counters(reduce(and_, [slots[i] for i in at(g)])))
        cache = WordCache(lambda w: sum(map(grams.__getitem__, ngrams(w, s.ngrams))))
        raw = WordCache(lambda w: sum(cache[x] for x in letters(w)))

        def predict(text: str) -> tuple[str, float]:
            words = text.split() if k else []
            packed = sum(map(raw.__getitem__, words))
            n, *hits = (packed >> FIELD * i & field for i in range(k + 1))
            if not n:
                return UNKNOWN, 0.0
            share = np.clip((np.array(hits) / n - false) / np.maximum(1 - false, 1e-9), 0, 1)
            best = int(np.argmax(share))
            rest = np.partition(share, -2)[-2] if k > 1 else 0.0
            return self.languages[best], float(np.clip(0.5 + (share[best] - rest) / 2, 0, 1)) if share[best] > 0 else 0.0

        return predict


def train(rows: list[tuple[str, str]], s: Settings = Settings()) -> Model:
    """Puts into the filter each language's n-grams that a share min_docs / max_docs of its texts hold, whatever their number."""
    languages = sorted({lang for _, lang in rows})
    model = Model(s, languages, MaskFilter(s.slots, s.hashes, len(languages)))
    for i, lang in enumerate(languages):
        seen: Counter = Counter()
        mine = [t for t, x in rows if x == lang]
        for t in mine:
            seen.update({g for w in set(letters(t)) for g in ngrams(w, s.ngrams)})
        for g, n in seen.items():
            if n * s.max_docs >= s.min_docs * len(mine):
                model.filter.add(g, i)
    return model


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held_out: int = 1, s: Settings = Settings()) -> Model:
    """Learns from a bounded sample outside the held-out fold: max_docs rows a language, in the order of a hash of the id.

    A hash threshold for each language draws about 1.5 times as many rows where they lie, without a sort or shuffle of texts.
    """
    d = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"), F.col(lang_col).cast("string").alias("_lang"))
    d = d.where("_lang is not null and _text is not null").where(F.length("_text") <= s.max_chars).where(F.pmod(crc32_text(F.col("_id")), F.lit(folds)) != held_out)
    sizes = {r["_lang"]: r["count"] for r in d.groupBy("_lang").count().collect()}  # a row a language
    if not sizes:
        return train([], s)
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 1.5 * s.max_docs / n))])
    drawn = d.where((F.pmod(F.xxhash64("_id", F.lit(s.seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))) <= share[F.col("_lang")])
    rows = sorted(drawn.select(F.xxhash64("_id", F.lit(s.seed)).alias("h"), "_id", "_text", "_lang").collect())  # about 1.5 * max_docs rows a language
    taken: Counter = Counter()
    out = []
    for _, _, text, lang in rows:
        taken[lang] += 1
        if taken[lang] <= s.max_docs:
            out.append((text, lang))
    return train(out, s)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", folds: int = 3, held_out: int = 1) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row for each input row, without a shuffle.

    A null text, or one without letters, is `und` with score 0; so is every text if nothing was learned. Texts count whole, whatever their length; of
    languages with equal shares the first in order of name is predicted. Identifiers may repeat or be null; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a table of fixed size

    def rows(batches):
        with keep_caches():
            one = sent.value.predictor()
            for b in sliced(batches):
                got = [one(t) for t in b[1].to_pylist()]
                yield pa.RecordBatch.from_arrays([b[0], pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    out = texts(docs, id_col, text_col).mapInArrow(rows, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", (F.pmod(crc32_text(F.col("doc_id")), F.lit(folds)) == held_out).alias("held_out"), "lang_pred", "score")
