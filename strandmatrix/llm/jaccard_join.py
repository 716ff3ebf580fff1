"""N-gram Jaccard join by parity sketches.

A document's set of word shingles is XOR-hashed into sketches: each shingle goes to one place and toggles
its bits there. A place differs between two documents only if a shingle of their symmetric difference went there, so the
Hamming distance of sketches is at most that difference's size. The sketch that is joined on has m words; for each band of set sizes m exceeds the largest
difference that two similar sets may have, hence (pigeonhole) similar sets agree in a word. Of documents that agree in one, those stay
candidates whose longer sketches of single parity bits are near enough for their sizes; these are verified on whole sets.

Words that are zero say little and are not joined on; a sketch with too many zeros for the pigeonhole is joined by a further
sketch with another seed as well, until one has few enough.
Links between candidates of one component are not needed: each round verifies pairs across components only, first
each document with one other of a word, then with its nearest few by parity bits, at last all candidates left, so that groups of copies
take about a verification for each document.

A set's parity bits go to every range that it has a word in, and the more ranges the fewer words share a copy. So before the rounds on labels, blocks send
words and labels alone, and only words that sets of several components share go on with parity bits.

No word gathers a hot group. In the first round a block pairs its sets that share a word with the first of them, and
only that one travels. Later a set of a giant component stays in its block: one of each block stands for it
at the word, and sets of other components that share the word go to those blocks to be compared there.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandmatrix.llm.common import discard, join_hot, lean, mix, settle, text_bytes, utf8
from strandmatrix.llm.components import components
from strandmatrix.llm.repeats import _range, word_tokens

BLOCK_BYTES = 8 << 20
#: Bytes of text whose sketch words one task takes.
RANGE_BYTES = 8 << 20
#: Characters whose shingles a task makes at a time.
STEP_CHARS = 1 << 19
#: Bytes that a task holds of the sets of a range of words that several components share; each entry takes ENTRY_BYTES besides its parity bits.
SHARED_BYTES, ENTRY_BYTES = 64 << 20, 300
#: Partners that a document outside its words' main component tries in each round between the first and the last, which has no limit.
BUDGETS = (2,)
#: Sets of a component from which a block sends only one for a word; the others are compared where they are.
GIANT = 2048
#: Parity bits for each unit of the largest difference: at 8, sets just short of similar mostly differ in too many bits.
SPREAD = 8


@dataclass(frozen=True)
class Settings:
    shingle: int = 5
    percent: int = 80

    def __post_init__(self) -> None:
        if self.shingle < 1 or not 70 <= self.percent <= 100:  # below, sketches cannot have fewer zero words than equal ones
            raise ValueError("shingle must be positive and percent from 70 to 100")


@lru_cache(8)
def edges(percent: int, most: int = 1 << 40) -> np.ndarray:
    """First set size of every band: a set links only within its band and the next to it on either side."""
    out = [1]
    while out[-1] < most:
        out.append(out[-1] * 100 // percent + 1)
    return np.array(out, np.int64)


@lru_cache(100_000)
def sketch_size(band: int, percent: int) -> tuple[int, int]:
    """(words, largest difference) for pairs whose smaller set is in a band: so many words that a set of the band has the fewest keys.

    A sketch of m words serves if fewer than m - d of them are zero; else another follows. The zero words that the band's smallest
    set leaves by chance are taken as normal, with the mean and variance of empty cells, so m over that chance is least.
    """
    n, a = int(edges(percent)[band]), int(edges(percent)[band + 1]) - 1
    d = (a + a * 100 // percent) * (100 - percent) // (100 + percent)
    best, words = (math.inf, d + 1), d + 1
    while words < best[0]:
        one, two = (math.exp(n * math.log1p(-x / words)) if words > x else 0.0 for x in (1, 2))
        mean, var = words * one, max(words * one + words * (words - 1) * two - (words * one) ** 2, 1e-9)
        serves = 0.5 * math.erfc((mean - (words - d - 0.5)) / math.sqrt(2 * var))
        best = min(best, (words / max(serves, 1e-9), words))
        words += 1 + words // 64
    return best[1], d


def shingles(tokens: np.ndarray, at: np.ndarray, size: int) -> list[np.ndarray]:
    """Each document's sorted distinct shingle hashes; one with fewer words has its whole sequence as one."""
    h = None
    if len(tokens) >= size:
        h = tokens[: len(tokens) - size + 1].copy()
        for i in range(1, size):
            h = mix(h) + tokens[i : len(tokens) - size + 1 + i] * np.uint64(0x9FB21C651E98DF25)
        h = mix(h)
    out = []
    for x, y in zip(at[:-1].tolist(), at[1:].tolist()):
        if y - x >= size:
            s = np.sort(h[x : y - size + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif y > x:
            short = np.array([y - x], np.uint64)
            for i in range(x, y):
                short = mix(short) + tokens[i : i + 1]
            out.append(mix(short ^ np.uint64(0x5851F42D4C957F2D)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketch_keys(s: np.ndarray, percent: int) -> np.ndarray:
    """The join keys of a set: its sketches' non-zero words, as 64-bit hashes of (band, seed, place, word)."""
    n = len(s)
    band = int(np.searchsorted(edges(percent), n, "right")) - 1
    out = []
    for k in (band, band - 1):
        if k < 0:
            continue
        words, d = sketch_size(k, percent)
        if d == 0:  # only equal sets link
            continue
        for seed in range(64):
            salt = np.uint64((k * 64 + seed + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
            x = mix(s ^ salt)
            place = (x >> np.uint64(32)) * np.uint64(words) >> np.uint64(32)
            order = np.argsort(place, kind="stable")
            place = place[order]
            first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
            word = np.bitwise_xor.reduceat(mix(x + salt)[order], first)
            full = word != 0
            out.append(mix(word[full] ^ mix(place[first][full] + salt)))
            if words - int(full.sum()) < words - d:
                break
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def parity_bits(s: np.ndarray, percent: int) -> tuple[int, bytes]:
    """(log2 of the length, bits): bit i is the parity of the shingles hashed to i. Halves XORed give the sketch of half the length."""
    n = len(s)
    d = (n + n * 100 // percent) * (100 - percent) // (100 + percent)
    log = max(6, (SPREAD * d - 1).bit_length() if d else 0)
    at = (mix(s ^ np.uint64(0xA0761D6478BD642F)) & np.uint64((1 << log) - 1)).astype(np.int64)
    return log, np.packbits((np.bincount(at, minlength=1 << log) & 1).astype(np.uint8), bitorder="little").tobytes()


class ParityTable:
    """Parity sketches of one range's sets, folded to the length that a group has in common when asked."""

    def __init__(self, logs: np.ndarray, bits: list[bytes]):
        self.logs, self.bits = logs, bits
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def rows(self, which: np.ndarray) -> np.ndarray:
        log = int(self.logs[which].min())
        if log not in self.tables:
            has = np.flatnonzero(self.logs >= log)
            at = np.full(len(self.logs), -1)
            at[has] = np.arange(len(has))
            out = np.empty((len(has), 1 << log - 6), np.uint64)
            for j, i in enumerate(has.tolist()):
                x = np.frombuffer(self.bits[i], np.uint64)
                while len(x) > out.shape[1]:
                    x = x[: len(x) // 2] ^ x[len(x) // 2 :]
                out[j] = x
            self.tables[log] = at, out
        at, out = self.tables[log]
        return out[at[which]]


def _node(s: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


class Sets:
    """Shingle sets of a block's documents, in the order of id and text."""

    def __init__(self, t: pa.Table, s: Settings, only: np.ndarray | None = None):
        ids, raw = t["_id"].to_pylist(), t["_text"].to_pylist()
        order = sorted(range(len(raw)), key=lambda i: (ids[i] is None, ids[i] or 0, raw[i]))
        if only is not None:
            order = [order[i] for i in only.tolist()]
        self.ids, self.sets = [ids[i] for i in order], []
        part, held = [], 0
        for j, i in enumerate(order):  # arrays of words are many times a text's size, so they are made for some texts at a time
            part.append(raw[i])
            held += len(raw[i])
            if held >= STEP_CHARS or j + 1 == len(order):
                self.sets += shingles(*word_tokens(*utf8(pa.array(part, pa.large_string())), lower=True), s.shingle)
                part, held = [], 0


def _documents(s: Settings):
    def rows(t: pa.Table) -> pa.Table:
        x = Sets(t, s)
        return pa.table({"doc_id": pa.array(x.ids, pa.int64()), "n_shingles": pa.array([len(y) for y in x.sets], pa.int64()), "node": pa.array([_node(y) if len(y) else 0 for y in x.sets], pa.int64())})

    return rows


_KEYS = "rng int, _g int, docs binary, nodes binary, labels binary, sizes binary, counts binary, keys binary, logs binary, parity binary, hidden binary, stars binary"


def _narrow(x: np.ndarray) -> bytes:
    """Numbers from 0 in as many bytes each as the largest needs; _widen reads them."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0)))).tobytes()


def _widen(raw: np.ndarray, n: int) -> np.ndarray:
    return raw.view(f"<u{len(raw) // n}") if n else raw


_SHARED = "rng int, _g int, labels binary, counts binary, keys binary"


def _labelled_keys(s: Settings, ranges: int):
    """Each label's distinct keys in a block, dealt by key; labels is document -> (node, label, whether its component is giant)."""

    def emit(t: pa.Table, labels: dict[int, tuple[int, int, bool]]) -> pa.Table:
        rows = [[] for _ in range(5)]
        only = np.array(sorted(labels), np.int64)
        keys = [sketch_keys(x, s.percent) for x in Sets(t, s, only).sets] if len(t) and len(only) else []
        if any(map(len, keys)):
            flat = np.concatenate(keys)
            label = np.repeat(np.array([labels[i][1] for i in only.tolist()], np.int64), [len(k) for k in keys])
            r = _range(flat, ranges)
            order = np.lexsort((flat, label, r))
            flat, label, r = flat[order], label[order], r[order]
            new = np.concatenate(([True], (flat[1:] != flat[:-1]) | (label[1:] != label[:-1])))
            flat, label, r = flat[new], label[new], r[new]
            cuts = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1], [True])))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                u, c = np.unique(label[a:b], return_counts=True)
                for col, v in zip(rows, (int(r[a]), t["_g"][0].as_py(), u.tobytes(), _narrow(c), flat[a:b].tobytes())):
                    col.append(v)
        return pa.table([pa.array(c, pa.int32() if i < 2 else pa.binary()) for i, c in enumerate(rows)], names=["rng", "_g", "labels", "counts", "keys"])

    return emit


def _shared(t: pa.Table) -> pa.Table:
    """For each block its keys in a range that sets of two labels or more have, and how many entries they are, counting a key once a label."""
    keys = [np.frombuffer(x.as_py(), np.uint64) for x in t["keys"]]
    labels = [np.frombuffer(x.as_py(), np.int64) for x in t["labels"]]
    counts = [_widen(np.frombuffer(x.as_py(), np.uint8), len(n)) for x, n in zip(t["counts"], labels)]
    flat = np.concatenate(keys)
    of = np.concatenate([np.repeat(x, n) for x, n in zip(labels, counts)])
    order = np.argsort(flat)
    heads = np.flatnonzero(np.concatenate(([True], flat[order][1:] != flat[order][:-1])))
    many = np.minimum.reduceat(of[order], heads) != np.maximum.reduceat(of[order], heads)
    live = np.empty(len(flat), bool)
    live[order] = np.repeat(many, np.diff(np.append(heads, len(flat))))
    out, at = [], 0
    for g, k in zip(t["_g"].to_pylist(), keys):
        here = k[live[at : at + len(k)]]
        if len(here):
            out.append((g, np.unique(here).tobytes(), len(here)))
        at += len(k)
    return pa.table([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int32(), pa.binary(), pa.int64()))], names=["_g", "keys", "n"])


def _shared_ranges(s: Settings, least: int, found: DataFrame, live: DataFrame) -> int:
    """Into how many ranges shared words are dealt, `least` or more, so that no task holds much of them.

    A set's parity bits go to each range that it has a word in. With few ranges its words share a copy, with many each has its own, and the more sets
    there are the more words they share: so a fixed share of the texts for each range would grow with the input.
    """
    n = F.col("n_shingles").cast("double")
    most = found.agg((F.sum(n * n) / F.sum(n)).alias("x")).first().x or 0  # shingles of an entry's set, as sets have words by their sizes
    entries = live.agg(F.sum("n").alias("x")).first().x or 0
    return max(least, 1 + int(entries * (ENTRY_BYTES + 2 * most * (100 - s.percent) / 100)) // SHARED_BYTES)


def _keys(s: Settings, ranges: int):
    """Each distinct set's keys, dealt by key: of a block's sets with a key only the first, the others paired with it as `stars`.

    With labels, document -> (node, label, whether its component is giant), only of the sets that have one, and only the keys in
    `live`; of giant components the first of each label and key, of others all.
    """

    def emit(t: pa.Table, labels: dict[int, tuple[int, int, bool]] | None, live: np.ndarray | None = None) -> pa.Table:
        only = None if labels is None else np.array(sorted(labels), np.int64)
        sets = Sets(t, s, only).sets if only is None or len(only) else []
        g, seen = t["_g"][0].as_py() if len(t) else 0, set()
        doc, node, label, size, many, keys, logs, parity = [], [], [], [], [], [], [], []
        for j, x in enumerate(sets):
            i = j if only is None else int(only[j])
            if not len(x) or (n := _node(x)) in seen:
                continue
            seen.add(n)
            k = sketch_keys(x, s.percent)
            if live is not None:
                k = k[np.isin(k, live)]
            if len(k):
                doc.append(i)
                node.append(n)
                label.append(n if labels is None else labels[i][1])
                size.append(len(x))
                many.append(len(k))
                keys.append(k)
                log, bits = parity_bits(x, s.percent) if labels is not None else (0, b"")
                logs.append(log)
                parity.append(bits)
        names = ["rng", "_g", "docs", "nodes", "labels", "sizes", "counts", "keys", "logs", "parity", "hidden", "stars"]
        out = [[] for _ in names]
        if keys:
            flat, of = np.concatenate(keys), np.repeat(np.arange(len(keys)), many)
            hidden = np.array([labels is not None and labels[i][2] for i in doc])
            stars = b""
            if labels is None:
                _, first, inv = np.unique(flat, return_index=True, return_inverse=True)
                star = np.unique(np.stack((of[first][inv], of)), axis=1)
                star = star[:, star[0] != star[1]]
                stars = np.stack([np.array(x, np.int64)[y] for y in star for x in (node, doc, size)]).tobytes() if star.size else b""
                first.sort()  # a row lists keys by document
                flat, of = flat[first], of[first]
            elif hidden.any():
                stay = np.flatnonzero(hidden[of])
                pair = np.stack((flat[stay].view(np.int64), np.array(label, np.int64)[of[stay]]))
                _, first = np.unique(pair, axis=1, return_index=True)
                take = np.sort(np.concatenate((np.flatnonzero(~hidden[of]), stay[first])))
                flat, of = flat[take], of[take]
            r = _range(flat, ranges)
            order = np.argsort(r, kind="stable")
            flat, of, r = flat[order], of[order], r[order]
            cuts = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1], [True])))
            doc, node, label, size, logs = np.array(doc), np.array(node, np.int64), np.array(label, np.int64), np.array(size), np.array(logs, np.uint8)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                u, c = np.unique(of[a:b], return_counts=True)
                for col, v in zip(out, (int(r[a]), g, _narrow(doc[u]), node[u].tobytes(), label[u].tobytes() if labels is not None else b"", _narrow(size[u]), _narrow(c), flat[a:b].tobytes(), *((logs[u].tobytes(), b"".join(parity[x] for x in u.tolist()), hidden[u].astype(np.uint8).tobytes()) if labels is not None else (b"", b"", b"")), b"")):
                    col.append(v)
            if stars:
                for col, v in zip(out, (g % ranges, g, *[b""] * 9, stars)):
                    col.append(v)
        return pa.table([pa.array(c, pa.int32() if i < 2 else pa.binary()) for i, c in enumerate(out)], names=names)

    return emit


_PAIRS = "a long, ag int, ai int, b long, bg int, bi int, ok boolean"
_FOUND = f"{_PAIRS}, _g int, label long, sets binary"


def _pair_table(a, ag, ai, b, bg, bi, ok) -> pa.Table:
    cols = [pa.array(np.asarray(x), k) for x, k in zip((a, ag, ai, b, bg, bi), (pa.int64(), pa.int32(), pa.int32()) * 2)]
    return pa.table([*cols, pa.array(np.asarray(ok, bool))], names=["a", "ag", "ai", "b", "bg", "bi", "ok"])


def _near(s: Settings, sketch: np.ndarray, size: np.ndarray, label: np.ndarray, budget: int | None):
    """(i, j) of one word's sets, i outside the main label and j of another label than i, whose sketches are near enough; the nearest `budget` of each i, or all."""
    names, of, many = np.unique(label, return_inverse=True, return_counts=True)
    outside = np.flatnonzero(of != int(np.argmax(many)))
    step = max(1, (1 << 21) // sketch.size)
    for a in range(0, len(outside), step):
        x = outside[a : a + step]
        far = np.bitwise_count(sketch[x][:, None, :] ^ sketch[None]).sum(2, dtype=np.int64)
        small, large = np.minimum(size[x][:, None], size[None]), np.maximum(size[x][:, None], size[None])
        ok = (far * (100 + s.percent) <= (small + large) * (100 - s.percent)) & (100 * small >= s.percent * large) & (of[x][:, None] != of[None])
        if budget and ok.shape[1] > budget:
            far[~ok] = 1 << 40
            best = np.argpartition(far, budget - 1, axis=1)[:, :budget]
            i, j = np.repeat(x, budget), best.ravel()
            take = np.take_along_axis(ok, best, 1).ravel()
            yield i[take], j[take]
        else:
            i, j = np.nonzero(ok)
            yield x[i], j


def _pairs(s: Settings, budget: int | None, labelled: bool):
    """Candidate pairs of a range of words: without labels each set with the first of its word, else pairs across labels as _near has them.

    With labels come also, for blocks that hold more of a giant component, the sets to compare there (_g, label, sets), and
    pairs of giant components that share a word (a, b as labels, ag -1).
    """

    def find(t: pa.Table) -> pa.Table:
        of: dict[str, list] = {c: [] for c in ("node", "label", "size", "g", "i", "hid")}  # of sets
        flat, users, logs, bits, stars, base = [], [], [], [], [], 0
        for b in t.to_batches():
            for row in range(b.num_rows):
                raw = lambda name, kind: np.frombuffer(b[name][row].as_buffer(), kind)  # noqa: E731, B023
                g = b["_g"][row].as_py()
                if len(x := raw("stars", np.int64)):
                    stars.append(np.concatenate((x.reshape(6, -1), [np.full(len(x) // 6, g)])))
                    continue
                node = raw("nodes", np.int64)
                n = len(node)
                flat.append(raw("keys", np.uint64))
                users.append(np.repeat(np.arange(base, base + n, dtype=np.int32), _widen(raw("counts", np.uint8), n)))
                base += n
                of["node"].append(node)
                of["label"].append(raw("labels", np.int64) if labelled else node)
                of["hid"].append(raw("hidden", np.uint8).astype(np.int64) if labelled else np.zeros(n, np.int64))
                for name, column in (("size", "sizes"), ("i", "docs")):
                    of[name].append(_widen(raw(column, np.uint8), n).astype(np.int64))
                of["g"].append(np.full(n, g))
                if labelled:
                    own = raw("logs", np.uint8).astype(np.int64)
                    ends, parities = np.cumsum(1 << own - 3), memoryview(b["parity"][row].as_buffer())
                    logs.append(own)
                    bits += [parities[x - (1 << k - 3) : x] for x, k in zip(ends.tolist(), own.tolist())]
        key, u = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((flat, np.uint64), (users, np.int32)))
        del flat, users
        of = {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in of.items()}
        parity = ParityTable(np.concatenate(logs), bits) if labelled and logs else None
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        order = order[np.concatenate((same, [False])) | np.concatenate(([False], same))] if len(order) else order  # keys of two or more
        key, u = key[order], u[order]
        order = np.lexsort((of["i"][u], of["g"][u], of["node"][u], key))
        key, u = key[order], u[order]
        c = {"key": key, "u": u, **{k: v[u] for k, v in of.items()}}
        new = np.ones(len(order), bool)
        new[1:] = (c["key"][1:] != c["key"][:-1]) | (c["node"][1:] != c["node"][:-1]) | (c["hid"][1:] > 0) & (c["g"][1:] != c["g"][:-1])
        c = {k: v[new] for k, v in c.items()}  # a set once a word, by its first copy; one that stands for others, once a block
        heads = np.flatnonzero(np.concatenate(([True], c["key"][1:] != c["key"][:-1]))) if len(c["key"]) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(heads, len(c["key"])))
        left, right, done = [], [], 0
        sent: dict[tuple[int, int], set[int]] = {}
        clash: set[tuple[int, int]] = set()
        if not labelled:
            first = np.repeat(heads, sizes)
            at = np.arange(len(c["key"]))
            left, right = [first[at != first]], [at[at != first]]
        else:
            for h, n in zip(heads[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
                label = c["label"][h : h + n]
                if (label == label[0]).all():
                    continue
                stay, g = c["hid"][h : h + n] > 0, c["g"][h : h + n]
                full = h + np.flatnonzero(~stay)
                giants = np.unique(label[stay]).tolist()
                clash.update((x, y) for x in giants for y in giants if x < y)
                for x in giants:
                    others = full[c["label"][full] != x].tolist()
                    for at in np.unique(g[stay & (label == x)]).tolist() if others else ():
                        sent.setdefault((at, x), set()).update(others)
                if len(full) < 2 or (c["label"][full] == c["label"][full[0]]).all():
                    continue
                for i, j in _near(s, parity.rows(c["u"][full]), c["size"][full], c["label"][full], budget):
                    left.append(full[i])
                    right.append(full[j])
                    done += len(i)
                if done > 1 << 20:  # the same pair comes with many words
                    left, right = ([x] for x in _once(c["node"], np.concatenate(left), np.concatenate(right)))
                    done = len(left[0])
        l, r = _once(c["node"], *(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (left, right)))
        ok = 100 * np.minimum(c["size"][l], c["size"][r]) >= s.percent * np.maximum(c["size"][l], c["size"][r])
        out = _pair_table(c["node"][l], c["g"][l], c["i"][l], c["node"][r], c["g"][r], c["i"][r], ok)
        if not labelled:
            for x in stars:
                a, ai, na, b, bi, nb, g = np.where(x[0] <= x[3], x, x[[3, 4, 5, 0, 1, 2, 6]])
                near = 100 * np.minimum(na, nb) >= s.percent * np.maximum(na, nb)
                out = pa.concat_tables([out, _pair_table(a, g, ai, b, g, bi, near)])
            return out
        x = np.array(sorted(clash), np.int64).reshape(-1, 2)
        none = np.full(len(x), -1)
        out = pa.concat_tables([out, _pair_table(x[:, 0], none, none, x[:, 1], none, none, none > 0)])
        n = len(out)
        rows = {"_g": [], "label": [], "sets": []}
        for (g, label), which in sent.items():
            _, first = np.unique(c["node"][np.array(sorted(which))], return_index=True)
            at = np.array(sorted(which))[first]
            rows["_g"].append(g)
            rows["label"].append(label)
            rows["sets"].append(_pack(c["node"][at], c["label"][at], c["size"][at], c["g"][at], c["i"][at], parity, c["u"][at]))
        m = len(rows["_g"])
        ends = [pa.array([None] * n + rows["_g"], pa.int32()), pa.array([None] * n + rows["label"], pa.int64()), pa.array([None] * n + rows["sets"], pa.binary())]
        cols = [pa.concat_arrays([out[k].combine_chunks() if not isinstance(out[k].combine_chunks(), pa.ChunkedArray) else pa.concat_arrays(out[k].chunks), pa.nulls(m, out[k].type)]) for k in out.column_names]
        return pa.table([*cols, *ends], names=[*out.column_names, "_g", "label", "sets"])

    return find


def _pack(node, label, size, g, i, parity: ParityTable, u) -> bytes:
    """Sets as bytes: their number, six arrays, then their parity bits."""
    head = np.stack([node, label, size, g, i, parity.logs[u]]).astype(np.int64)
    return np.int64(len(node)).tobytes() + head.tobytes() + b"".join(parity.bits[x] for x in u.tolist())


def _unpack(raw: bytes) -> tuple[np.ndarray, list[bytes]]:
    n = int(np.frombuffer(raw[:8], np.int64)[0])
    head = np.frombuffer(raw[8 : 8 + 48 * n], np.int64).reshape(6, n)
    ends = 8 + 48 * n + np.cumsum(1 << head[5] - 3)
    return head, [raw[x - (1 << k - 3) : x] for x, k in zip(ends.tolist(), head[5].tolist())]


def _at_home(s: Settings, budget: int | None):
    """Candidate pairs of sets sent to a block with the sets of a giant component that stayed there."""

    def find(key, t: pa.Table, got: pa.Table) -> pa.Table:
        empty = _pair_table([], [], [], [], [], [], [])
        if not len(t) or not len(got):
            return empty
        g, asked, own = key[0].as_py(), {}, {}
        for r in got.to_pylist():
            if r["sets"] is not None:
                asked.setdefault(r["label"], []).append(_unpack(r["sets"]))
            elif r["hidden"]:
                own.setdefault(r["label"], []).append((r["i"], r["node"]))
        tables = [empty]
        for label, parts in asked.items():
            head = np.concatenate([h for h, _ in parts], 1)
            bits = [b for _, x in parts for b in x]
            _, first = np.unique(head[0], return_index=True)
            head, bits = head[:, first], [bits[j] for j in first.tolist()]
            mine = sorted({n: i for i, n in reversed(sorted(own.get(label, [])))}.items(), key=lambda x: x[1])
            for at in range(0, len(mine), 4096):
                part = mine[at : at + 4096]
                sets = Sets(t, s, np.array([i for _, i in part], np.int64)).sets
                logs, par = zip(*(parity_bits(x, s.percent) for x in sets))
                table = ParityTable(np.concatenate((head[5], logs)), bits + list(par))
                # sizes differ by more than similar sets may: folded to the shortest in common with each sent set
                size = np.concatenate((head[2], [len(x) for x in sets]))
                k = head.shape[1]
                for j in range(k):
                    fit = k + np.flatnonzero((100 * np.minimum(size[k:], size[j]) >= s.percent * np.maximum(size[k:], size[j])))
                    if not len(fit):
                        continue
                    sketch = table.rows(np.concatenate(([j], fit)))
                    far = np.bitwise_count(sketch[1:] ^ sketch[0]).sum(1, dtype=np.int64)
                    near = np.flatnonzero(far * (100 + s.percent) <= (size[fit] + size[j]) * (100 - s.percent))
                    if budget:
                        near = near[np.argsort(far[near], kind="stable")[:budget]]
                    m = len(near)
                    b = [part[x] for x in (fit[near] - k).tolist()]
                    tables.append(_pair_table(np.full(m, head[0, j]), np.full(m, head[3, j]), np.full(m, head[4, j]), [n for n, _ in b], np.full(m, g), [i for _, i in b], np.ones(m, bool)))
        out = pa.concat_tables(tables)
        a, b = out["a"].to_numpy(), out["b"].to_numpy()
        swap = a > b
        cols = {c: out[c].to_numpy() for c in out.column_names}
        two = lambda x, y: (np.where(swap, cols[y], cols[x]), np.where(swap, cols[x], cols[y]))
        (a, b), (ag, bg), (ai, bi) = two("a", "b"), two("ag", "bg"), two("ai", "bi")
        return _pair_table(a, ag, ai, b, bg, bi, np.ones(len(a), bool))

    return find


def _once(node: np.ndarray, l: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair once, the smaller node first."""
    swap = node[l] > node[r]
    l, r = np.where(swap, r, l), np.where(swap, l, r)
    order = np.lexsort((node[r], node[l]))
    l, r = l[order], r[order]
    new = np.ones(len(l), bool)
    new[1:] = (node[l][1:] != node[l][:-1]) | (node[r][1:] != node[r][:-1])
    return l[new], r[new]


def _send(s: Settings):
    """The sets that other blocks ask for, one row for each asking block."""

    def rows(key, t: pa.Table, asked: pa.Table) -> pa.Table:
        names = ["_g", "a", "bi", "b", "set"]
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        if not len(t) or not len(asked):
            return pa.table([pa.array([], k) for k in kinds], names=names)
        i = asked["ai"].to_numpy()
        only = np.unique(i)
        sets = [x.tobytes() for x in Sets(t, s, only).sets]
        n = len(asked)
        return pa.table([asked["bg"].cast(pa.int32()), asked["a"], pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.array([sets[j] for j in np.searchsorted(only, i)], pa.binary())], names=names)

    return rows


def _verify(s: Settings):
    """The pairs of a block's sets with those sent to it that link: 100 |A n B| >= percent |A u B|."""

    def rows(key, t: pa.Table, got: pa.Table) -> pa.Table:
        u, v = [], []
        if len(t) and len(got):
            is_set = got["set"].is_valid().to_numpy()
            sets = {a: np.frombuffer(x, np.uint64) for a, x, ok in zip(got["a"].to_pylist(), got["set"].to_pylist(), is_set.tolist()) if ok}
            asks = [(a, bi, b) for a, bi, b, ok in zip(got["a"].to_pylist(), got["bi"].to_pylist(), got["b"].to_pylist(), is_set.tolist()) if not ok]
            if asks:
                only = np.unique(np.array([bi for _, bi, _ in asks], np.int64))
                own = dict(zip(only.tolist(), Sets(t, s, only).sets))
                for a, bi, b in asks:
                    x, y = sets[a], own[bi]
                    if len(x) > len(y):
                        x, y = y, x
                    at = np.searchsorted(y, x)
                    at[at == len(y)] = 0
                    both = int(np.count_nonzero(y[at] == x))
                    if 100 * both >= s.percent * (len(x) + len(y) - both):
                        u.append(a)
                        v.append(b)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return rows


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each input row.

    Words are runs of other than ASCII white space, A-Z lower-cased; a document's set holds its distinct `shingle`-word shingles, or with fewer
    words its whole sequence. Two documents link when the Jaccard index of their sets is `percent` hundredths or more; component_id is
    the smallest id reachable by links. A null or wordless text has no shingles, links with nothing and has its own id.
    Null ids count for nothing when the smallest is taken (a component of only null ids has a null one); repeated rows each
    get a row. Texts count whole, whatever their length; other columns are not read. An empty table gives an empty result. Sets are compared by 64-bit hashes of their
    shingles, into which words of up to 7 bytes go one to one.
    """
    s = Settings(shingle, percent)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    total = text_bytes(df, text_col)
    blocks, ranges = 1 + total // BLOCK_BYTES, 1 + total // RANGE_BYTES
    docs = df.select(F.col(id_col).cast("long").alias("_id"), text.alias("_text")).withColumn("_g", F.pmod(F.xxhash64("_id", "_text"), F.lit(blocks)).cast("int"))
    by_block = docs.groupBy("_g")
    found = settle(by_block.applyInArrow(lean(_documents(s)), "doc_id long, n_shingles long, node long"), "sets")
    emit = _keys(s, ranges)
    emit_labels = _labelled_keys(s, ranges)  # the more texts, the larger the part of them that shares a word with another

    def verified(pairs: DataFrame) -> DataFrame:
        asked = pairs.select("ag", "a", "ai", "bg").distinct()
        sent = by_block.cogroup(asked.groupBy("ag")).applyInArrow(lean(_send(s)), "_g int, a long, bi int, b long, set binary")
        asks = pairs.select(F.col("bg").alias("_g"), "a", "bi", "b", F.lit(None).cast("binary").alias("set"))
        return by_block.cogroup(sent.union(asks).groupBy("_g")).applyInArrow(lean(_verify(s)), "u long, v long")

    keys = by_block.applyInArrow(lean(lambda t: emit(t, None)), _KEYS)
    star = settle(keys.groupBy("rng").applyInArrow(lean(_pairs(s, 1, False)), _PAIRS).dropDuplicates(["a", "b"]), "pairs")
    one = W.partitionBy("b").orderBy("a")
    places = settle(star.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("ag").alias("_g"), F.col("ai").alias("i")), F.struct(F.col("b").alias("node"), F.col("bg").alias("_g"), F.col("bi").alias("i")))).alias("x")).select("x.*").distinct(), "places")
    tried = star.where("ok").withColumn("_k", F.row_number().over(one)).where("_k <= 2").drop("_k")
    tried = settle(tried, "tried")
    discard(star)
    links = settle(verified(tried), "verified")
    labels, spent, live = components(links), [links, places, tried], None
    opened = None  # labels of giant components that are to travel whole, as they share words with other giant ones
    rounds = [*BUDGETS, None]
    while rounds:
        budget = rounds.pop(0)
        labels = settle(labels, "labels")
        spent.append(labels)
        giants = labels.groupBy(F.col("root").alias("label")).count().where(F.col("count") > GIANT).select("label", F.lit(True).alias("hidden"))
        giants = giants if opened is None else giants.join(opened, "label", "left_anti")
        known = places.join(labels, "node", "left").select("_g", "i", "node", F.coalesce("root", "node").alias("label"))
        known = settle(known.join(giants, "label", "left").select("_g", "i", "node", "label", F.coalesce("hidden", F.lit(False)).alias("hidden")), "known")

        def labelled(lab: pa.Table) -> dict[int, tuple[int, int, bool]]:
            lab = lab.filter(lab["keys"].is_null()) if "keys" in lab.column_names else lab
            return {i: (n, x, h) for i, n, x, h in zip(*(lab[c].to_pylist() for c in ("i", "node", "label", "hidden")))}

        def first(key, t: pa.Table, lab: pa.Table) -> pa.Table:
            return emit_labels(t, labelled(lab))

        def again(key, t: pa.Table, lab: pa.Table) -> pa.Table:
            got = [np.frombuffer(x, np.uint64) for x in lab["keys"].drop_null().to_pylist()]
            return emit_again(t, labelled(lab) if got else {}, np.concatenate(got) if got else None)

        if live is None:  # components only grow, so a key that one of them has alone stays so
            live = settle(by_block.cogroup(known.groupBy("_g")).applyInArrow(lean(first), _SHARED).groupBy("rng").applyInArrow(lean(_shared), "_g int, keys binary, n long"), "shared")
            spent.append(live)
            emit_again = _keys(s, _shared_ranges(s, 1 + ranges // 4, found, live))
        told = known.select("*", F.lit(None).cast("binary").alias("keys")).unionByName(live.drop("n"), allowMissingColumns=True)
        keys = by_block.cogroup(told.groupBy("_g")).applyInArrow(lean(again), _KEYS)
        out = settle(keys.groupBy("rng").applyInArrow(lean(_pairs(s, budget, True)), _FOUND), "found")
        sent = out.where("sets is not null").select("_g", F.lit(None).cast("int").alias("i"), F.lit(None).cast("long").alias("node"), "label", F.lit(None).cast("boolean").alias("hidden"), "sets")
        stayed = known.where("hidden").select("*", F.lit(None).cast("binary").alias("sets"))
        home = by_block.cogroup(stayed.union(sent).groupBy("_g")).applyInArrow(lean(_at_home(s, budget)), _PAIRS)
        pairs = out.where("sets is null and ag >= 0").select(*tried.columns)
        if not giants.isEmpty():
            pairs = pairs.union(home.select(*tried.columns))
        pairs = settle(pairs.dropDuplicates(["a", "b"]).join(tried.select("a", "b"), ["a", "b"], "left_anti").select(*tried.columns), "pairs")
        links = settle(verified(pairs), "verified")
        spent += [pairs, links]
        tried = tried.union(pairs)
        labels = components(labels.select(F.col("node").alias("u"), F.col("root").alias("v")).where("u <> v").union(links))
        if budget is None:
            clash = out.where("ag = -1").select(F.col("a").alias("label")).distinct()
            if not clash.isEmpty():
                opened = settle(clash if opened is None else clash.union(opened), "opened")
                spent.append(opened)
                rounds = [None]
        discard(known, out)
    labels = settle(labels, "labels")
    discard(*spent)
    return _named(found, labels)


def _named(found: DataFrame, labels: DataFrame) -> DataFrame:
    """Each document with its component's smallest id. Minima are combined map-side; documents of a hot component are dealt to several tasks for the join back, which only components of several need."""
    rooted = found.where("n_shingles > 0").join(labels, "node", "left").select("doc_id", "n_shingles", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    linked = join_hot(rooted, least, "root", "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return linked.union(found.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of df that are their component's smallest id, those without an id, and those without words, with all columns."""
    keep = near_duplicates(df, id_col, text_col, shingle, percent).where("doc_id = component_id").select(F.col("doc_id").alias("_key")).distinct()
    keyed = df.select(F.struct("*").alias("_row"), F.col(id_col).cast("long").alias("_key"))
    kept = keyed.join(keep, "_key", "left_semi").select("_row.*")
    return kept.unionAll(df.where(F.col(id_col).isNull()))
