"""Substring deduplication by relative Lempel-Ziv parsing.

A reference block is the set of different word runs, from all documents, that share a range of anchors; its index orders all its
suffixes. Each run is factored greedily against the block: a factor is the longest match at its position with a run of a smaller owner.
A factor as long as a window or longer is a duplicate span. Windows that cross the end of a factor are looked up one by one.
Runs of equal bytes are one run of the block, and their later owners lose them as a whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandmatrix.llm.common import expand
from strandmatrix.llm.repeats import Block, Scheme, remove_repeats

LENGTH = 50


def _smaller(k: np.ndarray) -> np.ndarray:
    """The nearest place before each whose value is smaller, or -1."""
    near = np.arange(len(k)) - 1
    left = np.arange(1, len(k))
    for _ in range(64):  # jump over those that are not smaller, all places at once
        left = left[near[left] >= 0]
        left = left[k[near[left]] >= k[left]]
        if not len(left):
            return near
        near[left] = near[near[left]]
    values, at = k.tolist(), near.tolist()
    for i in left.tolist():  # long stairs, in order: what lies before is final
        j = at[i]
        while j >= 0 and values[j] >= values[i]:
            j = at[j]
        at[i] = j
    return np.array(at, np.int64)


class ReferenceIndex:
    """A reference block, runs of words one behind the other, by the order of all its suffixes; a suffix ends with its run.

    Ranks of the words at every position are refined by doubling, and the ranks of each length kept: suffixes in order of the last, and
    the common prefix of any two by descent through the lengths.
    """

    def __init__(self, tokens: np.ndarray, starts: np.ndarray, longs: np.ndarray):
        n = len(tokens)
        self.left = np.repeat(starts + longs, longs) - np.arange(n)  # words to the end of the run
        rank = np.append(tokens.astype(np.int64) + 1, 0)
        self.ranks, width, most = [rank], 1, int(longs.max(initial=0))
        while width < most:
            ahead = np.where(self.left > width, np.arange(n) + width, n)
            pair = rank[:-1] * (int(rank.max()) + 1) + rank[ahead]
            rank = np.append(np.unique(pair, return_inverse=True)[1].astype(np.int64) + 1, 0)
            self.ranks.append(rank)
            width *= 2
        self.order = np.argsort(rank[:-1], kind="stable")

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that the suffixes at a and at b have in common."""
        most, n = np.minimum(self.left[a], self.left[b]), len(self.left)
        long = np.zeros(len(a), np.int64)
        for j in range(len(self.ranks) - 1, -1, -1):
            inside = long + (1 << j) <= most
            x, y = np.where(inside, a + long, n), np.where(inside, b + long, n)
            long += np.where(inside & (self.ranks[j][x] == self.ranks[j][y]), 1 << j, 0)
        return long

    def longest(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words, position) of the longest match of every suffix with one of a smaller key; 0 words if there is none.

        In order of the suffixes that is with the nearest of a smaller key, before or behind.
        """
        n = len(keys)
        k, best, source = keys[self.order], np.zeros(n, np.int64), np.zeros(n, np.int64)
        for step in (-1, 1):
            near = _smaller(k) if step < 0 else n - 1 - _smaller(k[::-1])[::-1]
            near = np.where(near < n, near, -1)
            has = np.flatnonzero(near >= 0)
            here, there = self.order[has], self.order[near[has]]
            long = self.common(here, there)
            more = long > best[here]
            best[here[more]], source[here[more]] = long[more], there[more]
        return best, source


def factors(tokens: np.ndarray, starts: np.ndarray, longs: np.ndarray, keys: np.ndarray) -> tuple[list[tuple[int, int, int]], np.ndarray, np.ndarray]:
    """([(position, words, position of the source)], longest match at every position, its source): each run factored greedily.

    A factor is the longest match at its position with a run of a smaller key; a word without one is a literal, and no factor.
    """
    index = ReferenceIndex(tokens, starts, longs)
    best, source = index.longest(np.repeat(keys, longs))
    out, long, src = [], best.tolist(), source.tolist()
    for p, n in zip(starts.tolist(), longs.tolist()):
        end = p + n
        while p < end:
            if long[p]:
                out.append((p, long[p], src[p]))
            p += long[p] or 1
    return out, best, source


def factor_owners(tokens: np.ndarray, starts: np.ndarray, sizes: np.ndarray, keys: np.ndarray, length: int) -> np.ndarray:
    """For each window the key of a smaller owner, if a factor covers it or, across the end of a factor, the match at its own start does; else its run's."""
    longs = sizes + length - 1
    key = np.repeat(keys, longs)
    out = key.copy()
    parsed, best, source = factors(tokens, starts, longs, keys)
    if parsed:
        p, n, src = np.array(parsed, np.int64).T
        wide = n >= length
        spans = expand(p[wide], n[wide] - length + 1)
        out[spans] = np.repeat(key[src[wide]], n[wide] - length + 1)
        cross = expand(np.maximum(p, p + n - length + 1), np.minimum(n, length - 1))  # windows that start in a factor and end behind it
        cross = cross[best[cross] >= length]
        out[cross] = key[source[cross]]
    return out[expand(starts, sizes)]


def _scheme(length: int) -> Scheme:
    gram = 1
    while gram * 2 <= min(8, length):
        gram *= 2
    return Scheme(words=True, length=length, gram=gram, within=False)


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), one row for each input row.

    Words are runs of other than ASCII white space. Every word covered by a window of `length` words that also starts in a
    document with a smaller id is removed, judged on the input. Null text has no words. A null id is larger than all others and equal to other nulls, so
    rows without id never remove from each other; nor do rows that share an id. Texts count whole, whatever their length; other columns are not read. An empty table gives an empty result.
    """

    def digest(b: Block, gone: np.ndarray) -> pa.Table:
        n = np.concatenate(([0], np.cumsum(gone)))
        removed = n[b.at[1:]] - n[b.at[:-1]]
        raw, shas = b.bytes.tobytes(), []
        for i, (x, y) in enumerate(zip(b.byte_at[:-1].tolist(), b.byte_at[1:].tolist())):
            words = raw[x:y].split()
            if removed[i]:
                words = [w for w, g in zip(words, gone[b.at[i] : b.at[i + 1]].tolist()) if not g]
            shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
        return pa.table({"doc_id": b.table["_id"], "n_words": pa.array(np.diff(b.at)), "n_removed": pa.array(removed), "kept_sha256": pa.array(shas, pa.string())})

    return remove_repeats(df, id_col, text_col, _scheme(length), factor_owners, digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")
