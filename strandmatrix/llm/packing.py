"""Packing token sequences: best-fit decreasing over a segment tree of remaining capacities."""

from __future__ import annotations

import functools
import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmatrix.llm.common import settle, sliced, texts

WINDOW = 1024
#: Rests that one task packs together: so many that few of its windows stay open.
GROUP_ROWS = 40_000
#: Numbers of the sequences that hold one full window begin here; those of groups of rests lie below.
FULL = 1 << 62


class CapacityTree:
    """Open windows by remaining capacity; tightest(n) finds the smallest capacity >= n with one.

    Leaf c counts windows with c free slots; an inner node tells whether its subtree has any.
    """

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.any, self.open = bytearray(2 * self.size), [[] for _ in range(window + 1)]

    def add(self, free: int, which: int) -> None:
        self.open[free].append(which)
        at = free + self.size
        while at and not self.any[at]:
            self.any[at] = 1
            at >>= 1

    def take(self, free: int) -> int:
        which = self.open[free].pop()
        if not self.open[free]:
            at = free + self.size
            self.any[at] = 0
            while at > 1 and not self.any[at ^ 1]:
                at >>= 1
                self.any[at] = 0
        return which

    def tightest(self, n: int) -> int:
        """The capacity, or -1."""
        at = n + self.size
        if self.any[at]:
            return n
        while at > 1:
            if not at & 1 and self.any[at + 1]:
                at += 1
                while at < self.size:
                    at *= 2
                    at += not self.any[at]
                return at - self.size
            at >>= 1
        return -1


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(window number, offset) of each length, placed from the longest to the shortest, ties in given order."""
    tree, which, offset, made = CapacityTree(window), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        free = tree.tightest(n)
        if free < 0:
            free, which[i], made = window, made, made + 1
        else:
            which[i] = tree.take(free)
        offset[i] = window - free
        if free > n:
            tree.add(free - n, which[i])
    return which, offset


#: How the byte-level pre-tokenizer of `tokenizers` files splits text, and the printable stand-ins of its other bytes (fixed values of that format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PRINTABLE = (*range(33, 127), *range(161, 173), *range(174, 256))


class HubEncoder:
    """Ids of whole texts by a `tokenizers` file.

    A plain byte-level BPE file, whose ids follow the order of its merges, is the rank table that tiktoken merges by, with the
    same ids several times as fast; that is checked when the file is loaded. Any other file goes to `tokenizers` itself.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.ranked = self._ranked(spec)
        if self.ranked is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(path)

    @staticmethod
    def _ranked(spec: dict):
        import tiktoken

        model, pre, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        plain &= pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and spec.get("normalizer") is None
        plain &= all(x["special"] and not (x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"]) for x in added)
        if not plain:
            return None
        others = [b for b in range(256) if b not in PRINTABLE]
        of = {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(others)}
        special = {x["content"]: x["id"] for x in added}
        try:
            ranks = {bytes(of[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        except KeyError:
            return None
        merged = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model["merges"]]
        if any(a >= b for a, b in zip(merged, merged[1:])) or len(merged) + 256 != len(ranks) or any(bytes([b]) not in ranks for b in range(256)):
            return None
        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        if self.ranked is not None:
            return self.ranked.encode_to_numpy(text, allowed_special="all")
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")


    def batch(self, texts: list[str]) -> list[bytes]:
        """Little-endian uint32 ids of each text."""
        return [self(t).astype("<u4", copy=False).tobytes() for t in texts]


@functools.lru_cache(2)
def _hub(path: str) -> HubEncoder:
    return HubEncoder(path)


def pieces(df: DataFrame, id_col: str, text_col: str, path: str, end: int, window: int) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): each document's ids and the end id, cut into full windows and a rest."""

    def rows(batches):
        hub, tail = _hub(path), np.array([end], "<u4").tobytes()
        for b in sliced(batches):
            out = [], [], [], [], []
            for doc, ids in zip(b[0].to_pylist(), hub.batch(b[1].to_pylist())):
                ids += tail
                n = len(ids) // 4
                for s in range(0, n, window):
                    piece = ids[4 * s : 4 * (s + window)]
                    for c, v in zip(out, (doc, s, len(piece) // 4, zlib.crc32(piece), n)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return texts(df, id_col, text_col).mapInArrow(rows, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end: int = 0, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row for each piece.

    A text's ids (null: an empty text) and the end id are cut into full windows, each a
    sequence by itself where it was made, and a rest. Rests are dealt into groups of about GROUP_ROWS by hash and
    packed by best-fit decreasing within a group: every sequence holds at most `window` ids, gapless from 0.
    Repeated rows and null identifiers are packed like others, texts of any length are cut; an empty table gives an empty result. Other columns are not read.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    cut = settle(pieces(df, id_col, text_col, path, end, window), "pieces")
    full = cut.where(F.col("length") == window).select("*", (F.lit(FULL) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rests = cut.where(F.col("length") < window)
    groups = 1 + rests.count() // GROUP_ROWS
    dealt = rests.withColumn("_g", F.pmod(F.xxhash64("doc_id", "doc_tokens", "ids_crc32"), F.lit(groups)).cast("int"))

    def place(t: pa.Table) -> pa.Table:
        order = np.lexsort([t[c].to_numpy() for c in ("ids_crc32", "start")] + [t["doc_id"].fill_null(0).to_numpy()])
        t = t.take(pa.array(order))
        length = t["length"].to_numpy()
        which, offset = best_fit(length, window)
        base = t["_g"][0].as_py() << 32
        return t.drop_columns(["_g"]).append_column("sequence_id", pa.array(base + which)).append_column("offset", pa.array(offset))

    return full.unionAll(dealt.groupBy("_g").applyInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"))
