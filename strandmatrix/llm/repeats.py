"""Removal of passages that occur before, by windows of a fixed number of tokens: the exchange under two operators.

Every window of `length` tokens that two places share has its minimiser in common: the smallest hash
of the window's `gram`-token grams. So windows are dealt by minimiser ("anchor") and only those of anchors that
occur twice travel at all:

1. anchors: each block of documents sends its distinct anchor hashes, with counts, to the hash's range;
2. repeats: each range returns to a block those of its anchors that the corpus holds more than once;
3. segments: a block cuts out, for each such anchor, the tokens of the run of windows around it, each
   distinct run once with the places it stands at;
4. resolve: an anchor's runs from all blocks meet and the operator's own method finds for each window its first owner;
   the places that are not first go back to their block as spans;
5. apply: each block marks the spans' tokens in its documents.

Documents are dealt into blocks once; the steps that read them share that shuffle. Copies cost one entry a
block, and an anchor with over `hot` distinct places is dealt by whole windows instead, so
neither a hot passage nor the different texts around it meet in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmatrix.llm.common import binaries, expand, lean, mix, text_bytes, utf8

BLOCK_BYTES = 8 << 20
#: Bytes of text whose anchors one range takes; bounds the windows that a task sorts at a time.
RANGE_BYTES = 6 << 20
CHUNK = 1 << 17
_POSITION = np.uint64(CHUNK * 2 - 1)


@dataclass(frozen=True)
class Scheme:
    """What a token is, how long a window is, and whether a document's own earlier text counts."""

    words: bool
    length: int
    gram: int
    within: bool
    hot: int = 8192


class Block:
    """Documents of one block in the order of their ids, as one token array."""

    def __init__(self, table: pa.Table, scheme: Scheme):
        ids = table["_id"].combine_chunks()
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        none, known = ids.is_null().to_pylist(), ids.fill_null(0).to_pylist()
        raw = table["_text"].to_pylist()
        order = sorted(range(len(raw)), key=lambda i: (none[i], known[i], raw[i]))
        self.ids, self.none = np.array([known[i] for i in order], np.int64), np.array([none[i] for i in order], np.int64)
        same = (self.ids[1:] == self.ids[:-1]) & (self.none[1:] == self.none[:-1])
        self.owner = np.cumsum(np.concatenate(([True], ~same))) if len(raw) else np.zeros(0, np.int64)  # rows that share an id are one owner
        self.table = table.take(pa.array(order, pa.int64()))
        self.bytes, self.byte_at = utf8(self.table["_text"])
        if scheme.words:
            self.starts, self.ends, self.at = word_bounds(self.bytes, self.byte_at)
            self.tokens = word_hashes(self.bytes, self.starts, self.ends)
        else:
            self.tokens, self.at = self.bytes, self.byte_at


_rng = np.random.default_rng(20240607)
_LETTER = _rng.integers(0, 1 << 64, 256, np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words of up to so many bytes are their own hash, mixed one to one.
_WHOLE = 7


def word_bounds(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, byte after the last, word offsets of the documents) of the words of a block's bytes; words are runs of other than ASCII white space."""
    n_docs, starts, ends, counts = len(at) - 1, [], [], np.zeros(len(at) - 1, np.int64)
    lo = 0
    while lo < n_docs:
        hi = max(int(np.searchsorted(at, at[lo] + CHUNK, "right")) - 1, lo + 1)
        part = raw[at[lo] : at[hi]]
        if len(part):
            gap = _SPACE[part]
            first = ~gap
            last = first.copy()
            first[1:] &= gap[:-1]
            last[:-1] &= gap[1:]
            begins = (at[lo:hi] - at[lo])[np.diff(at[lo : hi + 1]) > 0]
            first[begins] = ~gap[begins]
            before = begins[begins > 0] - 1
            last[before] = ~gap[before]
            s = np.flatnonzero(first)
            starts.append(s + at[lo])
            ends.append(np.flatnonzero(last) + 1 + at[lo])
            counts[lo:hi] = np.diff(np.searchsorted(s, at[lo : hi + 1] - at[lo]))
        lo = hi
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *starts]), np.concatenate([none, *ends]), np.concatenate(([0], np.cumsum(counts)))


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of every word: one to one for short words, xxh3 of the bytes for others."""
    import xxhash

    raw = np.concatenate((_LOWER[raw] if lower else raw, np.zeros(8, np.uint8)))
    sizes, out = ends - starts, np.empty(len(starts), np.uint64)
    rows = np.lib.stride_tricks.as_strided(raw, (max(len(raw) - 7, 0), 8), (1, 1))
    for i in range(0, len(starts), CHUNK):
        n = np.minimum(sizes[i : i + CHUNK], _WHOLE).astype(np.uint64)
        word = np.ascontiguousarray(rows[starts[i : i + CHUNK]]).view("<u8").ravel()
        out[i : i + CHUNK] = mix(word & ((np.uint64(1) << (n << np.uint64(3))) - np.uint64(1)) | n << np.uint64(56))
    wide = np.flatnonzero(sizes > _WHOLE)
    if len(wide):
        data, digest = raw.tobytes(), xxhash.xxh3_64_intdigest
        out[wide] = np.fromiter((digest(data[a:b]) for a, b in zip(starts[wide].tolist(), ends[wide].tolist())), np.uint64, len(wide))
    return out


def word_tokens(raw: np.ndarray, at: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, word offsets of the documents) of a block's bytes."""
    starts, ends, of = word_bounds(raw, at)
    return word_hashes(raw, starts, ends, lower), of


def grams(tokens: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of every run of `size` tokens, a power of two, by doubling."""
    if tokens.dtype == np.uint8:
        h = np.lib.stride_tricks.as_strided(np.ascontiguousarray(tokens), (max(len(tokens) - 7, 0), 8), (1, 1))
        h, have = np.ascontiguousarray(h).view(np.uint64).ravel(), 8
    else:
        h, have = tokens, 1
    while have < size:
        h = h[:-have] * np.uint64(0xFF51AFD7ED558CCD) + (h[have:] ^ (h[have:] >> np.uint64(29)))
        have *= 2
    return mix(h)


def runs(tokens: np.ndarray, at: np.ndarray, s: Scheme) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window's token, number of windows, anchor hash) of each run of windows with one anchor, in order."""
    starts, sizes, anchors = [], [], []
    count = np.maximum(np.diff(at) - s.length + 1, 0)
    has = np.flatnonzero(count)
    begin, end = at[:-1][has], at[:-1][has] + count[has]
    span = s.length - s.gram + 1
    for c in range(0, len(tokens), CHUNK):
        a, b = int(np.searchsorted(end, c, "right")), int(np.searchsorted(begin, c + CHUNK))
        if a >= b:
            continue
        part = tokens[c : c + CHUNK + s.length - 1]
        g = grams(part, s.gram)
        if len(g) < span:
            continue
        m = (g & ~_POSITION) | np.arange(len(g), dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        if width < span:
            m = np.minimum(m[: len(m) - (span - width)], m[span - width :])
        m = m[:CHUNK]
        valid = np.zeros(len(m) + 1, np.int8)
        lo, hi = np.maximum(begin[a:b] - c, 0), np.minimum(end[a:b] - c, len(m))
        valid[lo] += 1
        valid[hi] -= 1
        valid = np.cumsum(valid[:-1]).astype(bool)
        where = m & _POSITION
        turn = np.concatenate(([True], where[1:] != where[:-1]))
        first = turn.copy()
        first[1:] |= ~valid[:-1]
        last = np.concatenate((turn[1:] | ~valid[1:], [True]))
        f, e = np.flatnonzero(first & valid), np.flatnonzero(last & valid)
        starts.append(f + c)
        sizes.append(e - f + 1)
        anchors.append(mix(g[where[f].astype(np.int64)] ^ _LETTER[0]))  # minima crowd at 0; ranges need them spread
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(sizes), np.concatenate(anchors)


def _range(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _anchors(s: Scheme, ranges: int):
    def block(t: pa.Table) -> pa.Table:
        b = Block(t, s)
        h, n = np.unique(runs(b.tokens, b.at, s)[2], return_counts=True)
        r = _range(h, ranges)
        cuts = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1], [True]))) if len(h) else np.zeros(1, np.int64)
        many = np.diff(cuts)
        return pa.table({"rng": pa.array(r[cuts[:-1]], pa.int32()), "_g": pa.array(np.full(len(many), t["_g"][0].as_py()), pa.int32()), "hashes": binaries(h, many), "counts": binaries(np.minimum(n, 65535).astype(np.uint16), many)})

    return block


def _repeats(s: Scheme):
    def resolve(t: pa.Table) -> pa.Table:
        raw, at = utf8(t["hashes"])
        h, n = raw.view(np.uint64), utf8(t["counts"])[0].view(np.uint16).astype(np.int64)
        order = np.argsort(h, kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1])))
        total = np.empty(len(h), np.int64)
        total[order] = np.repeat(np.add.reduceat(n[order], starts), np.diff(np.append(starts, len(h))))
        keep = total > 1
        many = np.diff(np.concatenate(([0], np.cumsum(keep)))[at // 8])
        some = many > 0
        return pa.table({"_g": pa.array(t["_g"].to_numpy()[some], pa.int32()), "hashes": binaries(h[keep], many[some]), "flags": binaries((total[keep] > s.hot).astype(np.uint8), many[some])})

    return resolve


_SEGMENTS = "rng int, _g int, anchors binary, sizes binary, lens binary, data binary, places binary, owners binary, done binary"


def _segments(s: Scheme, ranges: int):
    """Each distinct run once: its anchor, number of windows, bytes (words with one space between), and the (document id, document, start) of its first place
    (all places in the first document, if its own earlier text does not count). Later places repeat the first whatever
    other blocks hold; they are done, and their spans ride along with any range, so that a hot run meets in none.
    """

    def cut(key, t: pa.Table, rep: pa.Table) -> pa.Table:
        names = ["rng", "_g", "anchors", "sizes", "lens", "data", "places", "owners", "done"]
        kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 7
        if not len(t) or not len(rep):
            return pa.table([pa.array([], k) for k in kinds], names=names)
        known = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in rep["hashes"]])
        flags = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in rep["flags"]])
        order = np.argsort(known)
        known, flags = known[order], flags[order]
        b = Block(t, s)
        start, size, anchor = runs(b.tokens, b.at, s)
        at = np.minimum(np.searchsorted(known, anchor), max(len(known) - 1, 0))
        hit = known[at] == anchor if len(known) else np.zeros(len(anchor), bool)
        start, size, anchor, hot = start[hit], size[hit], anchor[hit], flags[at[hit]].astype(bool) if len(known) else np.zeros(0, bool)
        if hot.any():  # whole windows one by one, dealt by their own hash
            ws = expand(start[hot], size[hot])
            wide = np.array([hash_bytes(b.tokens[x : x + s.length].tobytes()) for x in ws.tolist()], np.uint64)
            start, size, anchor = np.concatenate((start[~hot], ws)), np.concatenate((size[~hot], np.ones(len(ws), np.int64))), np.concatenate((anchor[~hot], wide))
            again = np.argsort(start, kind="stable")
            start, size, anchor = start[again], size[again], anchor[again]
        doc = np.searchsorted(b.at, start, "right") - 1
        data, end = b.bytes.tobytes(), start + size + s.length - 1
        lo, hi = (b.starts[start], b.ends[end - 1]) if s.words else (start, end)
        seen: dict[bytes, list[int]] = {}
        for i, (x, y) in enumerate(zip(lo.tolist(), hi.tolist())):
            seen.setdefault(b" ".join(data[x:y].split()) if s.words else data[x:y], []).append(i)
        parts: dict[int, list] = {}
        where, of, later = _range(anchor, ranges).tolist(), b.owner[doc].tolist(), []
        for text, places in seen.items():  # places are in the order of document, then start
            n = 1
            while n < len(places) and not s.within and of[places[n]] == of[places[0]]:
                n += 1
            later += places[n:]
            parts.setdefault(where[places[0]], []).append((text, places[:n]))
        rows = [[] for _ in names]
        for r, found in parts.items():
            lead = np.array([p[0] for _, p in found])
            flat = np.array([i for _, p in found for i in p])
            place = np.stack([b.ids[doc[flat]], doc[flat] | b.none[doc[flat]] << 40, start[flat] - b.at[doc[flat]]])
            for c, v in zip(rows, (r, key[0].as_py(), anchor[lead].tobytes(), size[lead].astype(np.uint32).tobytes(), np.array([len(x) for x, _ in found], np.uint32).tobytes(), b"".join(x for x, _ in found), place.astype(np.int64).tobytes(), np.array([len(p) for _, p in found], np.uint32).tobytes(), b"")):
                c.append(v)
        if later:
            done = np.stack([doc[later], start[later] - b.at[doc[later]], size[later] + s.length - 1])
            g = key[0].as_py()
            for c, v in zip(rows, (g % ranges, g, b"", b"", b"", b"", b"", b"", done.astype(np.uint32).tobytes())):
                c.append(v)
        return pa.table([pa.array(c, k) for c, k in zip(rows, kinds)], names=names)

    return cut


def hash_bytes(raw: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(raw)


def _resolve(s: Scheme, method):
    """method(tokens, starts, sizes, keys, length) -> the smallest key of every window of the given runs, concatenated.

    Runs are equal when their bytes are, and words get numbers by their bytes: hashes only choose what meets here.
    """

    def meet(t: pa.Table) -> pa.Table:
        ready = [x.as_py() for x in t["done"]]
        ready = pa.table({"_g": pa.array([g for g, x in zip(t["_g"].to_pylist(), ready) if x], pa.int32()), "spans": pa.array([x for x in ready if x], pa.binary())})
        runs_of: dict[bytes, int] = {}
        entry, anchors, sizes = [], [], []
        places, owner_entry, block = [], [], []
        for row in t.to_pylist():
            a, n = np.frombuffer(row["anchors"], np.uint64), np.frombuffer(row["sizes"], np.uint32).astype(np.int64)
            at = 0
            mine = []
            for x, k, long in zip(a.tolist(), n.tolist(), np.frombuffer(row["lens"], np.uint32).tolist()):
                text = row["data"][at : at + long]
                at += long
                e = runs_of.setdefault(text, len(runs_of))
                if e == len(entry):
                    entry.append(text)
                    anchors.append(x)
                    sizes.append(k)
                mine.append(e)
            owners = np.frombuffer(row["owners"], np.uint32)
            p = np.frombuffer(row["places"], np.int64).reshape(3, -1)
            places.append(p)
            block.append(np.full(p.shape[1], row["_g"], np.int64))
            owner_entry.append(np.repeat(np.array(mine, np.int64), owners))
        if not entry:
            return ready
        del runs_of
        p, g, e = np.concatenate(places, 1), np.concatenate(block), np.concatenate(owner_entry)
        none, doc, at = p[1] >> 40, p[1] & (1 << 40) - 1, p[2]
        # in the order of document, then start; without starts those of one document are equal
        order = np.lexsort((at, doc, g, p[0], none) if s.within else (p[0], none))
        new = np.ones(len(g), np.int64)
        if not s.within:
            new[1:] = (p[0][order][1:] != p[0][order][:-1]) | (none[order][1:] != none[order][:-1])
        key = np.empty(len(g), np.int64)
        key[order] = np.cumsum(new)
        sizes, anchors = np.array(sizes, np.int64), np.array(anchors, np.uint64)
        first = np.full(len(entry), len(g) + 1, np.int64)
        np.minimum.at(first, e, key)
        _, group, many = np.unique(anchors, return_inverse=True, return_counts=True)
        shared = np.flatnonzero(many[group] > 1)
        least: dict[int, np.ndarray] = {}
        if len(shared):
            if s.words:
                numbers: dict[bytes, int] = {}
                tokens = np.array([numbers.setdefault(w, len(numbers)) for i in shared for w in entry[i].split(b" ")], np.int64)
            else:
                tokens = np.frombuffer(b"".join(entry[i] for i in shared), np.uint8)
            long = sizes[shared] + s.length - 1
            starts = np.cumsum(long) - long
            best = method(tokens, starts, sizes[shared], first[shared], s.length)
            cuts = np.concatenate(([0], np.cumsum(sizes[shared])))
            for j, i in enumerate(shared.tolist()):
                least[i] = best[cuts[j] : cuts[j + 1]]
        own = key == first[e]
        later = np.flatnonzero(~own)
        out = [np.stack([g[later], doc[later], at[later], sizes[e[later]] + s.length - 1])]
        partial = []
        for i in np.flatnonzero(own & np.isin(e, shared)).tolist():
            dup = least[int(e[i])] < key[i]
            if dup.any():
                d = np.diff(np.concatenate(([0], dup.view(np.int8), [0])))
                for x, y in zip(np.flatnonzero(d == 1).tolist(), np.flatnonzero(d == -1).tolist()):
                    partial.append((g[i], doc[i], at[i] + x, y - x + s.length - 1))
        if partial:
            out.append(np.array(partial, np.int64).T)
        spans = np.concatenate(out, 1)
        if not spans.shape[1]:
            return ready
        spans = spans[:, np.argsort(spans[0], kind="stable")]
        cuts = np.flatnonzero(np.concatenate(([True], spans[0][1:] != spans[0][:-1], [True])))
        pairs = list(zip(cuts[:-1], cuts[1:]))
        return pa.concat_tables([ready, pa.table({"_g": pa.array([spans[0][x] for x, _ in pairs], pa.int32()), "spans": pa.array([spans[1:, x:y].astype(np.uint32).tobytes() for x, y in pairs], pa.binary())})])

    return meet


def covered(b: Block, spans: pa.Table) -> np.ndarray:
    """Which of a block's tokens some span covers."""
    mark = np.zeros(len(b.tokens) + 1, np.int32)
    for x in spans["spans"]:
        doc, at, n = np.frombuffer(x.as_py(), np.uint32).reshape(3, -1).astype(np.int64)
        lo = b.at[doc] + at
        np.add.at(mark, lo, 1)
        np.add.at(mark, lo + n, -1)
    return np.cumsum(mark[:-1]) > 0


def remove_repeats(df: DataFrame, id_col: str, text_col: str, s: Scheme, method, apply, schema: str, extra: list[str] | None = None) -> DataFrame:
    """apply(block, covered) -> a table of `schema` for each block; `extra` columns of df travel with the documents."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    total = text_bytes(df, text_col)
    blocks = 1 + total // BLOCK_BYTES
    ranges = 1 + total // RANGE_BYTES
    rest = [F.struct(*[F.col(c) for c in extra]).alias("_row")] if extra else []
    docs = df.select(F.col(id_col).cast("long").alias("_id"), text.alias("_text"), *rest)
    docs = docs.withColumn("_g", F.pmod(F.xxhash64("_id", "_text"), F.lit(blocks)).cast("int"))
    by_block = docs.groupBy("_g")
    anchors = by_block.applyInArrow(lean(_anchors(s, ranges)), "rng int, _g int, hashes binary, counts binary")
    repeats = anchors.groupBy("rng").applyInArrow(lean(_repeats(s)), "_g int, hashes binary, flags binary")
    segments = by_block.cogroup(repeats.groupBy("_g")).applyInArrow(lean(_segments(s, ranges)), _SEGMENTS)
    spans = segments.groupBy("rng").applyInArrow(lean(_resolve(s, method)), "_g int, spans binary")

    def final(key, t: pa.Table, found: pa.Table) -> pa.Table:
        b = Block(t, s)
        return apply(b, covered(b, found))

    return by_block.cogroup(spans.groupBy("_g")).applyInArrow(lean(final), schema)
