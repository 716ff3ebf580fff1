"""What the operators share: the shared folder, Arrow helpers and split-free word access."""

from __future__ import annotations

import gc
import sys
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmatrix.sources.shared import CLEANUP, give_back, settle, ship  # noqa: F401


def discard(*frames: DataFrame) -> None:
    """Deletes settled frames that nothing reads any more; where pyarrow knows no such file system they stay."""
    for df in frames:
        try:
            system, path = fs.FileSystem.from_uri(df._settled)
            system.delete_dir(path)
        except (OSError, pa.ArrowInvalid, NotImplementedError):
            pass


def lean(work):
    """A function for groups of one, two or three arguments that gives memory back when it has ended."""

    def done(out):
        give_back()
        return out

    n = work.__code__.co_argcount
    return (lambda t: done(work(t))) if n == 1 else (lambda a, b: done(work(a, b))) if n == 2 else (lambda a, b, c: done(work(a, b, c)))


def sliced(batches, rows: int = 1024):
    """Batches of few rows, so that Python copies of their texts stay small; memory is given back at the end."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
    give_back()


def join_hot(many: DataFrame, one: DataFrame, key: str, by: str, how: str = "inner", ways: int = 16) -> DataFrame:
    """many joined with the smaller `one`: rows of a key are dealt by a hash of `by` to so many tasks, each with its copy of one's rows."""
    dealt = many.withColumn("_deal", F.pmod(F.xxhash64(by), F.lit(ways)))
    copies = one.withColumn("_deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ways - 1).cast("long"))))
    return dealt.join(copies, [key, "_deal"], how).drop("_deal")


def texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id bigint, _text string): only what an operator reads, so clashing names cannot matter; null text is empty."""
    return df.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))


def text_bytes(df: DataFrame, text_col: str) -> int:
    """Bytes of all texts; sets how many blocks the work is cut into."""
    return int(df.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column without copying each value; no nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def listed(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from flat values and each list's size."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def binaries(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column whose values are the bytes of runs of a flat array, of so many items each."""
    flat = np.ascontiguousarray(flat)
    offsets = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer((offsets * flat.itemsize).astype(np.int32)), pa.py_buffer(flat)])


def expand(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start+1, ... start+size-1 of every range, concatenated."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(total, dtype=np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@contextmanager
def keep_caches():
    """Turns the cyclic collector off while a task fills large caches: nothing in them is cyclic, and it would walk them again and again."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


class WordCache(dict):
    """Results by word, filled on demand by make(word).

    Holds two generations of about `most` bytes: a full one becomes the old one, from which
    words still in use move up. Words over `longest` characters are not kept. Both bound memory
    only: results do not depend on them.
    """

    def __init__(self, make, most: int = 32 << 20, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest, self.old, self.used = make, most, longest, {}, 0

    def __missing__(self, word):
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
        if len(word) <= self.longest:
            if self.used >= self.most:
                self.old = dict(self)
                self.clear()
                self.used = 0
            self.used += sys.getsizeof(word) + sys.getsizeof(value) + 100  # and its place in the table
            self[word] = value
        return value
