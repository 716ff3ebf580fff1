"""Byte-level BPE encoding with a hierarchical-bitmap rank queue, and decoding."""

from __future__ import annotations

import base64
import functools
import hashlib
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from strandmatrix.llm.common import expand, give_back, texts, utf8

_BITS = 8  # bits of a rank within a word of the bitmap
_LOW = (1 << _BITS) - 1
#: Pre-tokens of up to so many bytes are merged together, longer ones by themselves.
SHORT = 256
#: Bytes of texts whose words are merged together, and of those whose ids are written out together; a longer text is taken alone.
TOGETHER, WRITTEN = 16 << 20, 1 << 20
#: White space other than single spaces and newlines between words (RE2; what str.isspace() is true of).
UNEVEN = r"[\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]|\A[ \n]|[ \n]\z"


class RankQueue:
    """Positions by merge rank. A two-level bitmap tells which ranks have any: find-first-set in
    the summary word gives the word, and in that word the rank. A bucket hands out its
    leftmost position first, or all it has at once. Entries are not removed when a merge makes them stale: the reader skips them."""

    def __init__(self, ranks: int):
        self.words, self.summary, self.buckets = [0] * ((ranks >> _BITS) + 1), 0, {}
        self.arrays = {}  # the part of a bucket that came as an array

    def push(self, rank: int, at: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [at]
            self.words[rank >> _BITS] |= 1 << (rank & _LOW)
            self.summary |= 1 << (rank >> _BITS)
        else:
            heappush(bucket, at)

    def pop(self) -> tuple[int, int]:
        """(rank, position): the lowest rank's leftmost; the queue must not be empty."""
        hi = (self.summary & -self.summary).bit_length() - 1
        word = self.words[hi]
        rank = hi << _BITS | (word & -word).bit_length() - 1
        bucket = self.buckets[rank]
        at = heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.words[hi] = word & (word - 1)
            if not self.words[hi]:
                self.summary &= self.summary - 1
        return rank, at

    def push_all(self, ranks: list[int], ats: list[int]) -> None:
        """push() without an order within buckets: drain() only may follow."""
        buckets = self.buckets
        for rank, at in zip(ranks, ats, strict=True):
            if (bucket := buckets.get(rank)) is not None:
                bucket.append(at)
            else:
                buckets[rank] = [at]
                self.words[rank >> _BITS] |= 1 << (rank & _LOW)
                self.summary |= 1 << (rank >> _BITS)

    def push_array(self, rank: int, ats: np.ndarray) -> None:
        """push_all() of one rank that has no array yet."""
        self.arrays[rank] = ats
        self.words[rank >> _BITS] |= 1 << (rank & _LOW)
        self.summary |= 1 << (rank >> _BITS)

    def drain(self) -> tuple[int, np.ndarray]:
        """(rank, positions): the lowest rank and all of its positions, in no order; the queue must not be empty."""
        hi = (self.summary & -self.summary).bit_length() - 1
        word = self.words[hi]
        rank = hi << _BITS | (word & -word).bit_length() - 1
        self.words[hi] = word & (word - 1)
        if not self.words[hi]:
            self.summary &= self.summary - 1
        ats, more = self.arrays.pop(rank, None), self.buckets.pop(rank, None)
        if more is None:
            return rank, ats
        more = np.array(more, np.int64)
        return rank, more if ats is None else np.concatenate((ats, more))


class BytePairs:
    """Encodes and decodes with a rank table (token bytes to rank)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.queue = RankQueue(max(ranks.values()) + 1)
        size = max(ranks.values()) + 1
        self.tokens = [b""] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token

    @functools.cached_property
    def _tables(self):
        """(id of each byte, rank of each two bytes, pairs by left id, pairs by right id); of pairs: where an id's begin, their other ids, their ranks.

        Bytes without a rank have ids after all ranks; 256 and -1 stand for no byte and no id.
        """
        size = len(self.tokens)
        ids = {bytes([b]): size + b for b in range(256)} | self.ranks
        two, pairs = np.full((257, 257), -1, np.int32), []
        for token, rank in self.ranks.items():
            if len(token) == 2:
                two[token[0], token[1]] = rank
            for i in range(1, len(token)):
                if (left := ids.get(token[:i])) is not None and (right := ids.get(token[i:])) is not None:
                    pairs.append((left, right, rank))
        left, right, rank = np.array(pairs, np.int64).reshape(-1, 3).T

        def by(own, other):
            order = np.argsort(own, kind="stable")
            return np.searchsorted(own[order], np.arange(size + 1)).tolist(), other[order], rank[order].astype(np.int32)

        return np.array([ids[bytes([b])] for b in range(256)]), two, by(left, right), by(right, left)

    @functools.cached_property
    def token_column(self) -> pa.Array:
        return pa.array(self.tokens, pa.large_binary())

    def merge(self, piece: bytes) -> list[int]:
        """Token ids of one pre-token: always the lowest-ranked adjacent pair is merged, leftmost first."""
        get = self.ranks.get
        if (whole := get(piece)) is not None:
            return [whole]
        n, queue = len(piece), self.queue
        push, pop = queue.push, queue.pop
        after, before = list(range(1, n + 1)), list(range(-1, n))
        pair = [get(piece[i : i + 2]) for i in range(n - 1)]
        pair.append(None)
        for i, r in enumerate(pair):
            if r is not None:
                push(r, i)
        while queue.summary:
            rank, i = pop()
            if pair[i] != rank:
                continue
            j = after[i]
            k = after[i] = after[j]
            pair[j] = None
            if k < n:
                before[k] = i
                pair[i] = r = get(piece[i : after[k]])
                if r is not None:
                    push(r, i)
            else:
                pair[i] = None
            if i:
                p = before[i]
                pair[p] = r = get(piece[p:k])
                if r is not None:
                    push(r, p)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def merge_all(self, pieces: pa.Array) -> pa.ListArray:
        """merge() of each pre-token of a large_binary column without nulls and empty values."""
        raw, offsets = utf8(pieces)
        sizes = np.diff(offsets)
        ids = pc.index_in(pieces, value_set=self.token_column).fill_null(-1).to_numpy().astype(np.int32)
        short = np.flatnonzero((ids < 0) & (sizes <= SHORT))
        counts = np.ones(len(pieces), np.int64)
        flat, counts[short] = self._merge_together(raw[expand(offsets[short], sizes[short])], sizes[short])
        alone = {i: self.merge(raw[offsets[i] : offsets[i + 1]].tobytes()) for i in np.flatnonzero((ids < 0) & (sizes > SHORT)).tolist()}
        for i, x in alone.items():
            counts[i] = len(x)
        at = np.concatenate(([0], np.cumsum(counts)))
        out = np.empty(at[-1], np.int32)
        out[at[:-1][ids >= 0]] = ids[ids >= 0]
        out[expand(at[short], counts[short])] = flat
        for i, x in alone.items():
            out[at[i] : at[i + 1]] = x
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(out))

    def _merge_together(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all, how many of each) of pre-tokens that lie one after the other, as merge() has them, with one queue for all.

        A rank's bucket is handed out whole, but only the leftmost position of each pre-token is
        merged; the others wait in the queue, as that merge may have made a lower rank.
        """
        n, (single, two, by_left, by_right) = len(sizes), self._tables
        piece = np.repeat(np.arange(n), sizes)
        place = np.arange(1, len(raw) + 1) + piece  # a slot without id is before the first and after each
        byte = np.full(len(raw) + n + 1, 256)
        byte[place] = raw
        of, ids, pair = np.zeros(len(byte), np.int32), np.full(len(byte), -1), np.full(len(byte), -1, np.int32)
        of[place], ids[place], pair[:-1] = piece, single[raw], two[byte[:-1], byte[1:]]
        after, before = np.arange(1, len(byte) + 1), np.arange(-1, len(byte) - 1)
        del place, byte, piece
        queue, row = RankQueue(len(self.tokens)), np.full(len(self.tokens) + 257, -1, np.int32)  # row: ranks of one id's pairs, by the other id
        at = np.flatnonzero(pair >= 0)
        key = pair[at].astype(np.int64) << 32 | at
        key.sort()
        at, rank = key & 0xFFFFFFFF, key >> 32
        cuts = [0, *(np.flatnonzero(np.diff(rank)) + 1).tolist(), len(at)]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                queue.push_array(int(rank[a]), at[a:b])
        while queue.summary:
            rank, at = queue.drain()
            at = at[pair.take(at) == rank]
            if len(at) > 1:
                at.sort()
                first = np.ones(len(at), bool)
                owner = of.take(at)
                np.not_equal(owner[1:], owner[:-1], out=first[1:])
                if not first.all():
                    queue.push_array(rank, at[~first])
                    at = at[first]
            elif not len(at):
                continue
            j = after.take(at)
            k, p = after.take(j), before.take(at)
            after[at], before[k], ids[at], ids[j], pair[j] = k, at, rank, -1, -1
            for where, beside, (begin, others, ranks) in ((at, k, by_left), (p, p, by_right)):
                a, b = begin[rank], begin[rank + 1]
                if a == b:
                    pair[where] = -1
                    continue
                row[others[a:b]] = ranks[a:b]
                pair[where] = made = row.take(ids.take(beside))
                row[others[a:b]] = -1
                some = np.flatnonzero(made >= 0)
                queue.push_all(made.take(some).tolist(), where.take(some).tolist())
        left = ids >= 0
        flat = ids[left]
        if len(flat) and flat.max() >= len(self.tokens):
            raise KeyError(bytes([int(flat.max()) - len(self.tokens)]))
        return flat, np.bincount(of[left], minlength=n)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.merge(p.encode()) for p in self.pattern.findall(text)))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@functools.lru_cache(2)
def load(path: str, pattern: str) -> BytePairs:
    with open(path, "rb") as f:
        return BytePairs({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


class TextEncoder:
    """BytePairs over many whole texts at a time: each distinct word of theirs is split and merged once.

    That words may be split apart from their texts is known of the public pattern only; with any other, whole texts are split.
    A word is split alone as it is in place if it has one space or newline before it and none but such stand in the text:
    no match of a GPT-style pattern spans white space after a word.
    """

    def __init__(self, pairs: BytePairs):
        self.pairs = pairs
        self.newline = len(pairs.encode("\n"))
        self.by_words = pairs.pattern.pattern == vocabulary()[1]

    def pieces(self, found: list[str]) -> tuple[pa.ListArray, np.ndarray, np.ndarray]:
        """(ids of each distinct pre-token, which of them each is, first byte of each) of pre-tokens."""
        column = pa.array(found, pa.large_string())
        raw, offsets = utf8(column)
        coded = column.dictionary_encode()
        return self.pairs.merge_all(coded.dictionary.cast(pa.large_binary())), coded.indices, raw[offsets[:-1]]

    def words(self, column: pa.Array) -> tuple[pa.ListArray, np.ndarray, np.ndarray]:
        """(ids of each distinct word, words of all texts, where each text's begin) of even texts; a newline belongs to the word after it, and each text gets one before it."""
        column = pc.replace_substring(column, "\n", " \n")
        column = pc.binary_join_element_wise(pa.scalar("\n", column.type), column, pa.scalar("", column.type))
        lists = pc.split_pattern(column, " ")
        begins, coded = lists.offsets.to_numpy(), lists.flatten().dictionary_encode()
        del column, lists
        alone = "".join([w if w[0] == "\n" else " " + w for w in coded.dictionary.to_pylist()])
        ids, which, lead = self.pieces(self.pairs.pattern.findall(alone))
        ids, starts = ids.take(which), np.flatnonzero((lead == 32) | (lead == 10))
        offsets = np.append(ids.offsets.to_numpy()[starts], len(ids.values))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), ids.values), coded.indices.to_numpy(), begins

    def parts(self, column: pa.Array):
        """(ids, begins, ends) for some texts after others: the ids of a text are those from its begin to its end."""
        column = column.cast(pa.large_string())
        size = np.diff(utf8(column)[1])
        even = (size > 0) & self.by_words
        if even.any():
            even &= ~pc.match_substring_regex(column, UNEVEN).to_numpy(zero_copy_only=False)
        begin, end, tables, units = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64), [], []
        if even.any():
            ids, which, begins = self.words(column.filter(pa.array(even)))
            begin[even], end[even] = begins[:-1], begins[1:]
            tables.append(ids)
            units.append(which)
        if (~even & (size > 0)).any():
            found = [list(filter(None, self.pairs.pattern.findall(column[i].as_py()))) if uneven else [] for i, uneven in enumerate(~even)]
            ids, which, _ = self.pieces(list(chain.from_iterable(found)))
            counts = np.array(list(map(len, found)))
            ends = np.cumsum(counts) + sum(map(len, units))
            begin[~even], end[~even] = (ends - counts)[~even], ends[~even]
            units.append(which.to_numpy() + sum(map(len, tables)))
            tables.append(ids)
        if tables:
            table, units = pa.concat_arrays(tables), np.concatenate(units)
        for a, b in cuts(size, WRITTEN):
            if not tables:
                yield np.zeros(0, np.int32), begin[a:b], end[a:b]
                continue
            ids = table.take(pa.array(np.concatenate([units[begin[i] : end[i]] for i in range(a, b)])))
            ends = ids.offsets.to_numpy()[np.concatenate(([0], np.cumsum(end[a:b] - begin[a:b])))].astype(np.int64)
            yield ids.values.to_numpy(), ends[:-1] + self.newline * even[a:b], ends[1:]

    def __call__(self, text: str) -> list[int]:
        return list(chain.from_iterable(ids[b:e].tolist() for ids, begins, ends in self.parts(pa.array([text])) for b, e in zip(begins, ends)))


def cuts(sizes: np.ndarray, most: int):
    """(from, to) of runs of rows whose sizes add up to no more than that, or that are one row."""
    a, total = 0, np.concatenate(([0], np.cumsum(sizes)))
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(total, total[a] + most, "right")) - 1)
        yield a, b
        a = b


def together(batches):
    """Batches whose texts have few bytes, so that what is made of them stays small; memory is given back at the end."""
    for batch in batches:
        for a, b in cuts(np.diff(utf8(batch[1])[1]), TOGETHER):
            yield batch.slice(a, b - a)
    give_back()


@functools.lru_cache(2)
def load(path: str, pattern: str) -> BytePairs:
    with open(path, "rb") as f:
        return BytePairs({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


@functools.lru_cache(2)
def _encoder(path: str, pattern: str) -> TextEncoder:
    return TextEncoder(load(path, pattern))


def vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[str, str]:
    """(path, pattern) of a public rank file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>, decoded binary), one row for each input row, without a shuffle.

    Null and empty texts give no ids and empty bytes; repeated rows and null identifiers pass through; an
    empty table gives an empty result. Each pattern match is encoded by itself and there are no special
    tokens. Memory is bounded by 16 MB of texts or one text; its length may be anything.
    """
    path, pattern = path or vocabulary()[0], pattern or vocabulary()[1]

    def rows(batches):
        enc = _encoder(path, pattern)
        for batch in together(batches):
            at = 0
            for ids, begins, ends in enc.parts(batch[1]):
                lists = [ids[b:e] for b, e in zip(begins, ends)]
                yield pa.RecordBatch.from_arrays([batch[0].slice(at, len(lists)), pa.array(lists, pa.list_(pa.int32())), pa.array(list(map(enc.pairs.decode, lists)), pa.binary())], ["doc_id", "ids", "decoded"])
                at += len(lists)

    return texts(df, id_col, text_col).mapInArrow(rows, "doc_id long, ids array<int>, decoded binary")


def hashes(column: pa.Array, begins: np.ndarray, ends: np.ndarray, spare: int = 0) -> list[str]:
    """SHA-256 of the values of a large_binary column from each begin to its end, joined, without the last `spare` bytes."""
    raw, offsets = utf8(column)
    return [hashlib.sha256(raw[a : max(a, b - spare)]).hexdigest() for a, b in zip(offsets[begins].tolist(), offsets[ends].tolist())]


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encode()'s output, taken where it is made; its cases are encode()'s. Other columns are not read."""
    path, pattern = path or vocabulary()[0], pattern or vocabulary()[1]

    def rows(batches):
        enc = _encoder(path, pattern)
        names = pa.array([f"{i}," for i in range(len(enc.pairs.tokens))], pa.large_binary())
        for batch in together(batches):
            n, a, d = [], [], []
            for ids, begins, ends in enc.parts(batch[1]):
                n.append(ends - begins)
                a += hashes(names.take(pa.array(ids)), begins, ends, 1)
                d += hashes(enc.pairs.token_column.take(pa.array(ids)), begins, ends)
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(np.concatenate([*n, []]), pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(df, id_col, text_col).mapInArrow(rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
