"""Windows of k bases as arrays: packed words of two bits a base, and their mixed form that deals them evenly."""

from __future__ import annotations

import numpy as np

#: Bases of one packed word: A, C, G, T are 0 to 3, so packed words order as the bases do.
WORD = 31
BREAK = 4


def _table(values: dict[int, int]) -> np.ndarray:
    out = np.full(256, BREAK, np.uint8)
    out[list(values)] = list(values.values())
    return out


#: Byte to base: of DNA, and of prose whose letter number i stands for base i mod 4. Anything else breaks a sequence.
DNA = _table({b: i for i, b in enumerate(b"ACGT")})
LETTERS = _table({b: i % 4 for i, b in enumerate(b"abcdefghijklmnopqrstuvwxyz")})


def word_sizes(k: int) -> list[int]:
    return [min(WORD, k - i) for i in range(0, k, WORD)]


def _spans(x: np.ndarray, size: int, join) -> np.ndarray:
    """join(left, right, length of left, length of right) over every `size` neighbours, by doubling."""
    n, at, span, out, rest = len(x) - size + 1, 0, 1, None, size
    while True:
        if rest & span:
            part = x[at : at + n]
            out = part if out is None else join(out, part, at, span)
            at += span
        if span * 2 > rest:
            return out
        x = join(x[:-span], x[span:], span, span)
        span *= 2


def _any(x: np.ndarray, size: int) -> np.ndarray:
    return _spans(x, size, lambda a, b, *_: a | b)


def packed(code: np.ndarray, starts: np.ndarray, k: int, fold: bool) -> tuple[np.ndarray, list[np.ndarray]]:
    """(places, words) of the windows within records: code has a base, or BREAK, a byte, and starts is true where a record begins.

    fold: of a window and its reverse complement the smaller one.
    """
    n = len(code) - k + 1
    if n < 1:
        return np.zeros(0, np.int64), [np.zeros(0, np.uint64) for _ in word_sizes(k)]
    at = np.flatnonzero(~(_any(code > 3, k) | _any(starts[1:], k - 1)))
    base = (code & 3).astype(np.uint32 if k <= 16 else np.uint64)
    fore, back, done = [], [], 0
    for size in word_sizes(k):
        fore.append(_spans(base, size, lambda a, b, _, n: (a << base.dtype.type(2 * n)) | b)[done : done + n][at])
        if fold:
            mirrored = _spans(base, size, lambda a, b, m, _: a | (b << base.dtype.type(2 * m)))
            back.append(base.dtype.type(4**size - 1) ^ mirrored[k - done - size :][:n][at])
        done += size
    if fold:
        if len(fore) == 1:
            return at, [np.minimum(fore[0], back[0])]
        less = back[-1] < fore[-1]
        for f, b in zip(fore[-2::-1], back[-2::-1]):
            less = (b < f) | ((b == f) & less)
        fore = [np.where(less, b, f) for f, b in zip(fore, back)]
    return at, fore


#: An odd factor, so that products by it are a permutation of the words of any number of bits.
_FACTOR = 0x9FB21C651E98DF25


def _further(words: list[np.ndarray]) -> np.ndarray | None:
    h = None
    for w in words[1:]:
        h = (w if h is None else h ^ w) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return h


def mixed(words: list[np.ndarray], k: int) -> list[np.ndarray]:
    """Words whose first has leading bits that are even over any k-mers; unmixed() turns it back."""
    bits = 2 * word_sizes(k)[0]
    first, h, mask = words[0].astype(np.uint64), _further(words), np.uint64(2**bits - 1)
    if h is not None:
        first = first + h
    first = first * np.uint64(_FACTOR) & mask
    first ^= first >> np.uint64(bits // 2)
    return [first * np.uint64(_FACTOR) & mask, *words[1:]]


def unmixed(words: list[np.ndarray], k: int) -> list[np.ndarray]:
    bits = 2 * word_sizes(k)[0]
    mask, inverse = np.uint64(2**bits - 1), np.uint64(pow(_FACTOR, -1, 2**bits))
    first = words[0].astype(np.uint64) * inverse & mask
    first ^= first >> np.uint64(bits // 2)
    first = first * inverse & mask
    h = _further(words)
    return [first if h is None else (first - h) & mask, *words[1:]]


def letters(words: list[np.ndarray], k: int) -> np.ndarray:
    """The k-mers' bytes, one k-mer after another."""
    out = np.empty((len(words[0]), k), np.uint8)
    for i in range(k):
        w, j = divmod(i, WORD)
        shift = 2 * (word_sizes(k)[w] - 1 - j)
        out[:, i] = (words[w] >> words[w].dtype.type(shift)).astype(np.uint8) & 3
    return np.frombuffer(b"ACGT", np.uint8)[out.ravel()]
