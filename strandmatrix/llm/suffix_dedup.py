"""Suffix-array deduplication by deep-shallow sorting.

The suffixes that start at candidate windows are sorted in two phases: multikey quicksort to a shallow depth,
then, for groups that still agree, blind tries that compare each suffix with one other. Neighbours in the order that
agree on a whole window are repeats, and the first owner of a window keeps it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandmatrix.llm.common import expand, mix
from strandmatrix.llm.repeats import Block, Scheme, grams, remove_repeats

LENGTH = 100
#: Bytes to which multikey quicksort goes; a multiple of its 8-byte characters.
SHALLOW = 24


def _words(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes at each position as a big-endian number: one character of the quicksort."""
    out = np.empty(len(at), np.uint64)
    for i in range(0, len(at), 1 << 16):
        part = at[i : i + (1 << 16)]
        out[i : i + (1 << 16)] = text[part[:, None] + np.arange(8)].view(">u8").ravel()
    return out


#: Groups of up to so many suffixes are ordered by the next character at once.
SMALL = 12


def shallow_sort(text: np.ndarray, starts: np.ndarray, depth: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(order, group starts): suffixes sorted to `depth` bytes and where groups that agree on them begin.

    Multikey quicksort: a group is parted around a pivot, the median of three of its 8-byte characters, into smaller, equal and larger
    ones, and only the equal go on to the next character. All groups are parted in step. The text must have 8 bytes after each compared position.
    """
    order, lo, size, level = np.arange(len(starts)), np.zeros(1, np.int64), np.array([len(starts)]), np.zeros(1, np.int64)
    char = _words(text, starts)  # of each place in the order, at its group's level
    done = [np.zeros(0, np.int64)]
    while True:
        go = (size > 1) & (level < depth)
        done.append(lo[~go & (size > 0)])
        lo, size, level = lo[go], size[go], level[go]
        if not len(lo):
            break
        at, head, group = expand(lo, size), np.cumsum(size) - size, np.repeat(np.arange(len(lo)), size)
        c = char[at]
        few = size <= SMALL
        side = np.zeros(len(at), np.int64)
        a, b, z = c[head], c[head + size // 2], c[head + size - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), z))[group]
        side = (c >= pivot).astype(np.int8) + (c > pivot)
        place = np.empty(len(at), np.int64)
        counts = np.zeros((len(lo), 3), np.int64)
        for k in range(3):
            mine = side == k
            run = np.cumsum(mine)
            before = run[head] - mine[head]
            counts[:, k] = np.append(run[head[1:]] - mine[head[1:]], run[-1]) - before
            which = np.flatnonzero(mine)
            place[which] = lo[group[which]] + counts[group[which], :k].sum(1) + run[which] - 1 - before[group[which]]
        if few.any():  # an insertion sort's part
            which = np.flatnonzero(few[group])
            by = which[np.lexsort((c[which], group[which]))]
            place[by] = at[which]
        order[place], char[place] = order[at], c
        new_lo = (lo[:, None] + np.cumsum(counts, 1) - counts)[~few].ravel()
        new_size, new_level = counts[~few].ravel(), (level[:, None] + np.array([0, 8, 0]))[~few].ravel()
        if few.any():
            at, group = at[few[group]], group[few[group]]
            first = np.ones(len(at), bool)
            first[1:] = (char[at][1:] != char[at][:-1]) | (group[1:] != group[:-1])
            f = np.flatnonzero(first)
            new_lo, new_size, new_level = np.append(new_lo, at[f]), np.append(new_size, np.diff(np.append(f, len(at)))), np.append(new_level, level[group[f]] + 8)
            fresh = np.zeros(len(new_lo), bool)
            fresh[len(new_lo) - len(f) :] = True
        else:
            fresh = np.zeros(len(new_lo), bool)
        fresh[: int((~few).sum()) * 3] |= np.tile([False, True, False], int((~few).sum()))
        lo, size, level = new_lo, new_size, new_level
        on = fresh & (size > 1) & (level < depth)
        if on.any():  # the next character
            at = expand(lo[on], size[on])
            char[at] = _words(text, starts[order[at]] + np.repeat(level[on], size[on]))
    return order, np.sort(np.concatenate(done))


class BlindTrie:
    """Orders equal-length strings: inner nodes hold only the byte position where their strings branch.

    Inserting walks down by the branching bytes alone, to some leaf, compares once with that leaf's string, and
    goes in at the first difference. Equal strings share a leaf.
    """

    def __init__(self):
        self.root = None

    def insert(self, s: bytes, what: int) -> None:
        if self.root is None:
            self.root = (s, [what])
            return
        node = self.root
        while isinstance(node, list):  # [position, {byte: child}]
            kids = node[1]
            node = kids.get(s[node[0]]) or next(iter(kids.values()))
        other = node[0]
        if other == s:
            node[1].append(what)
            return
        lo, hi = 0, len(s)  # the first difference, by halving
        while hi - lo > 1:
            mid = (lo + hi) // 2
            if s[lo:mid] == other[lo:mid]:
                lo = mid
            else:
                hi = mid
        up, node = None, self.root
        while isinstance(node, list) and node[0] < lo:
            up, node = node, node[1][s[node[0]]]
        if isinstance(node, list) and node[0] == lo:
            node[1][s[lo]] = (s, [what])
            return
        new = [lo, {other[lo]: node, s[lo]: (s, [what])}]
        if up is None:
            self.root = new
        else:
            up[1][s[up[0]]] = new

    def leaves(self):
        """(string, its suffixes) in order."""
        stack = [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                stack.extend(node[1][c] for c in sorted(node[1], reverse=True))
            else:
                yield node


def deep_shallow(text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, group of each place in the order): suffixes sorted on `length` bytes; a group agrees on all of them."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    order, heads = shallow_sort(padded, starts, min(SHALLOW, length // 8 * 8))
    sizes = np.diff(np.append(heads, len(starts)))
    new = np.zeros(len(starts), bool)
    new[heads] = True
    raw = text.tobytes()
    for lo, n in zip(heads[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
        members = order[lo : lo + n].tolist()
        cut = [raw[x : x + length] for x in starts[members].tolist()]
        if n == 2 and cut[0] == cut[1] or n > 2 and cut.count(cut[0]) == n:
            continue
        trie = BlindTrie()
        for s, m in zip(cut, members):
            trie.insert(s, m)
        at = lo
        for _, what in trie.leaves():
            order[at : at + len(what)] = what
            new[at] = True
            at += len(what)
    return order, np.cumsum(new) - 1


def alike(text: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """Which windows share a hash of their bytes with another one: equal windows do, and few others."""
    if not len(windows):
        return np.zeros(0, np.int64)
    size = 1 << length.bit_length() - 1
    h = grams(text, size)
    h = h[windows] + mix(h[windows + length - size])  # two grams that cover the window
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    return np.sort(order[np.append(same, False) | np.append(False, same)])


def first_owners(tokens: np.ndarray, starts: np.ndarray, sizes: np.ndarray, keys: np.ndarray, length: int) -> np.ndarray:
    """The smallest key of the runs that hold each window, by sorting the suffixes of all windows but those that a hash tells from every other."""
    windows, out = expand(starts, sizes), np.repeat(keys, sizes)
    again = alike(tokens, windows, length)
    order, group = deep_shallow(tokens, windows[again], length)
    least = np.full(group[-1] + 1 if len(group) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, group, out[again[order]])
    out[again[order]] = least[group]
    return out


def _scheme(length: int) -> Scheme:
    gram = 8
    while gram * 2 <= min(16, length // 2):
        gram *= 2
    if length < 16:
        raise ValueError("length must be at least 16 bytes")
    return Scheme(words=False, length=length, gram=gram, within=True)


def _removed(b: Block, gone: np.ndarray):
    kept, n = b.bytes[~gone], np.concatenate(([0], np.cumsum(gone)))
    removed = n[b.at[1:]] - n[b.at[:-1]]
    at = np.concatenate(([0], np.cumsum(np.diff(b.at) - removed)))
    raw = kept.tobytes()
    return removed, [raw[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist())]


def span_counts(b: Block, gone: np.ndarray) -> np.ndarray:
    """Maximal removed runs of each document."""
    rise = gone.copy()
    rise[1:] &= ~gone[:-1]
    starts = b.at[:-1][np.diff(b.at) > 0]
    rise[starts] = gone[starts]
    n = np.concatenate(([0], np.cumsum(rise)))
    return n[b.at[1:]] - n[b.at[:-1]]


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row for each input row.

    Every byte covered by a `length`-byte string that also starts earlier, in a document with a smaller id or before it in
    the same one, is removed; matches never cross documents and are judged on the input. Null text counts as empty. A null id comes after all
    others; rows that share an id follow each other in an order fixed by their content. Texts count whole, whatever their length; other columns are
    not read. An empty table gives an empty result.
    """

    def digest(b: Block, gone: np.ndarray) -> pa.Table:
        removed, kept = _removed(b, gone)
        return pa.table({"doc_id": b.table["_id"], "n_bytes": pa.array(np.diff(b.at)), "n_removed": pa.array(removed), "n_spans": pa.array(span_counts(b, gone)), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())})

    return remove_repeats(df, id_col, text_col, _scheme(length), first_owners, digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def drop_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", length: int = LENGTH) -> DataFrame:
    """df with repeated strings cut out of its text (and chars_col, if there, the new length); no row goes.

    A character of which a part is cut out goes as a whole. Null texts stay null.
    """
    names, schema = df.columns, df.schema

    def cut(b: Block, gone: np.ndarray) -> pa.Table:
        _, kept = _removed(b, gone)
        rows = b.table["_row"].combine_chunks()
        rows = rows.chunk(0) if isinstance(rows, pa.ChunkedArray) else rows
        cols = dict(zip(names, rows.flatten()))
        was = cols[text_col].is_null().to_pylist()
        new = [None if w else x.decode("utf-8", "ignore") for w, x in zip(was, kept)]
        cols[text_col] = pa.array(new, pa.string())
        if chars_col in cols:
            cols[chars_col] = pa.array([None if x is None else len(x) for x in new], pa.int64()).cast(cols[chars_col].type)
        return pa.table(cols)

    return remove_repeats(df, id_col, text_col, _scheme(length), first_owners, cut, schema, extra=names)
