"""Media columns: chroma audio fingerprints.

Audio becomes frames of twelve pitch-class energies. Filters, differences of rectangles of that image read off its integral image, are
quantised to two bits each and packed into one 32-bit integer a frame. Two recordings are aligned by the histogram of
offsets between their equal neighbouring integers; at every offset with enough of them the share of differing bits tells whether they are the same.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmatrix.llm.common import expand, join_hot, settle


@dataclass(frozen=True)
class Settings:
    """Samples a second, a frame and a step; pitch range in Hz; and when recordings align: so many equal
    pairs of neighbouring integers at one offset, so many frames in common, at most this share of differing bits."""

    rate: int = 4000
    frame: int = 1024
    step: int = 256
    low: float = 65.0
    high: float = 1760.0
    hits: int = 4
    overlap: int = 8
    errors: float = 0.25


WIDTH = 8  # frames that a filter spans
PITCHES = 12
THRESHOLDS = (0.82, 1.0, 1.22)  # of the ratio of two boxes
FLOOR = 0.02 * (1 << 16)  # added to both: a fiftieth of a frame


def filters() -> list[tuple[int, int, int, int]]:
    """(kind, first pitch, pitches, frames) of 16 filters, by rule: each kind at places and sizes that step around the octave."""
    return [(1 + i % 5, (5 * i) % PITCHES, 2 + 2 * (i % 3), (4, 8, 6)[i % 3]) for i in range(16)]


@lru_cache(8)
def _bank(s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(window, spectrum bin -> pitch class weights)."""
    freq = np.fft.rfftfreq(s.frame, 1 / s.rate)
    weights = np.zeros((len(freq), PITCHES))
    ok = np.flatnonzero((freq >= s.low) & (freq <= s.high))
    weights[ok, np.round(PITCHES * np.log2(freq[ok] / 440.0)).astype(int) % PITCHES] = 1
    return np.hanning(s.frame).astype(np.float32), weights


#: Parts that a frame's energy is counted in: whole numbers, so that sums over an integral image are the same wherever a recording lies in it.
PARTS = 1 << 16


def _frames(samples: np.ndarray, starts: np.ndarray, s: Settings) -> np.ndarray:
    """(frames, 12) pitch-class energies of the frames at some starts, each scaled to a sum of PARTS and rounded; silent frames are zero."""
    window, weights = _bank(s)
    out = np.zeros((len(starts), PITCHES), np.int64)
    for i in range(0, len(starts), 2048):
        frames = np.lib.stride_tricks.sliding_window_view(samples, s.frame)[starts[i : i + 2048]] * window
        bins = np.fft.rfft(frames, axis=1)
        power = (bins.real**2 + bins.imag**2).astype(np.float64) @ weights
        total = power.sum(1, keepdims=True)
        out[i : i + 2048] = np.where(total > 1e-6, np.rint(power * (PARTS / np.maximum(total, 1e-6))), 0)
    return out


def chroma(samples: np.ndarray, s: Settings = Settings()) -> np.ndarray:
    """(frames, 12) pitch-class energies of a recording."""
    count = max(0, 1 + (len(samples) - s.frame) // s.step)
    return _frames(np.ascontiguousarray(samples, np.float32), np.arange(count) * s.step, s)


def prints(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(32-bit integers, which of them are of sound) for every start of WIDTH frames."""
    n = len(image) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.uint32), np.zeros(0, bool)
    integral = np.zeros((2 * PITCHES + 1, len(image) + 1), np.int64)
    integral[1:, 1:] = np.concatenate((image, image), 1).T.cumsum(0).cumsum(1)  # pitch classes are a circle

    def box(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return integral[p1, t1 : t1 + n] - integral[p1, t0 : t0 + n] - integral[p0, t1 : t1 + n] + integral[p0, t0 : t0 + n]

    out = np.zeros(n, np.uint32)
    gray = np.array([0, 1, 3, 2], np.uint32)
    for kind, p, h, w in filters():
        hp, hw = p + h // 2, w // 2
        if kind == 1:
            a, b = box(0, w, p, hp), box(0, w, hp, p + h)
        elif kind == 2:
            a, b = box(0, hw, p, p + h), box(hw, w, p, p + h)
        elif kind == 3:
            a, b = box(0, hw, p, hp) + box(hw, w, hp, p + h), box(hw, w, p, hp) + box(0, hw, hp, p + h)
        elif kind == 4:
            a, b = box(0, w, p + h, p + 2 * h), box(0, w, p, p + h)
        else:
            third = w // 4
            a, b = 2 * box(third, w - third, p, p + h), box(0, third, p, p + h) + box(w - third, w, p, p + h)
        code, b = np.zeros(n, np.uint8), b + FLOOR
        for x in THRESHOLDS:
            code += a + FLOOR >= x * b
        out = out << np.uint32(2) | gray[code]
    return out, box(0, WIDTH, 0, PITCHES) > 0


def prints_of(recordings: list[np.ndarray], s: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    """prints(chroma(x)) of every recording, over one integral image for all of them: windows across two are left out."""
    sizes = np.array([len(x) for x in recordings], np.int64)
    frames = np.maximum(0, 1 + (sizes - s.frame) // s.step)
    samples = np.concatenate([np.zeros(0, np.float32), *recordings]).astype(np.float32)
    image = _frames(samples, np.repeat(np.cumsum(sizes) - sizes, frames) + expand(np.zeros(len(frames), np.int64), frames) * s.step, s)
    p, sound = prints(image)
    first, count = np.cumsum(frames) - frames, np.maximum(0, frames - WIDTH + 1)
    return [(p[a : a + n], sound[a : a + n]) for a, n in zip(first.tolist(), count.tolist())]


def align(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, float]:
    """(frames in common, share of differing bits) with b's frame i at a's frame i - offset."""
    x, y = a[max(0, -offset) :], b[max(0, offset) :]
    n = min(len(x), len(y))
    if n <= 0:
        return 0, 1.0
    return n, int(np.bitwise_count(x[:n] ^ y[:n]).sum()) / (32 * n)


def closest(a: np.ndarray, b: np.ndarray, offsets: list[int], s: Settings) -> tuple[int, int, float] | None:
    """(offset, frames, share of differing bits) of the alignment with the smallest share among those that pass; of equals the longest, then the smallest offset."""
    tried = ((o, *align(a, b, o)) for o in offsets)
    return min((x for x in tried if x[1] >= s.overlap and x[2] <= s.errors), key=lambda x: (x[2], -x[1], x[0]), default=None)


def decode_wav(raw: bytes | None) -> tuple[np.ndarray, int] | None:
    """(mono samples, rate) of 16-bit PCM in a RIFF container, else None. A cut-off data chunk gives what is there."""
    if not raw or raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        return None
    at, form = 12, None
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], struct.unpack("<I", raw[at + 4 : at + 8])[0]
        if name == b"fmt " and size >= 16:
            form = struct.unpack("<HHIIHH", raw[at + 8 : at + 24])
        elif name == b"data" and form and form[0] == 1 and form[5] == 16 and form[1]:
            data = raw[at + 8 : at + 8 + size]
            x = np.frombuffer(data[: len(data) // (2 * form[1]) * 2 * form[1]], "<i2").reshape(-1, form[1])
            return x.mean(1).astype(np.float32) / 32768, form[2]
        at += 8 + size + size % 2
    return None


def wav_samples(s: Settings) -> Callable:
    """Samples at the rate of the settings from WAV bytes, by linear resampling."""

    def samples(raw):
        got = decode_wav(raw)
        if got is None:
            return np.zeros(0, np.float32)
        x, rate = got
        if rate != s.rate and len(x):
            x = np.interp(np.arange(0, len(x), rate / s.rate), np.arange(len(x)), x).astype(np.float32)
        return x

    return samples


NOTE = 96  # samples of a note
#: How a turn of a conversation is rendered and fingerprinted: a frame a word, with rests at both ends so that a window at
#: an end has five words or more. A turn of five words has the four prints that a pair needs.
TURN, TURN_NOTE, TURN_REST = Settings(frame=256, step=256, hits=2, overlap=4), 256, 3


def sonify(s: Settings, note: int = NOTE, rest: int = 0) -> Callable:
    """Samples of a text: each word a note of two pitches that a hash of the word picks, between `rest` notes of silence. Stands in for audio where a table has none."""
    t = np.arange(note) / s.rate
    tone = np.sin(2 * np.pi * 880.0 * 2 ** (np.arange(PITCHES) / PITCHES)[:, None] * t)
    notes = ((2 * tone[:, None] + tone[None]) / 3 * np.hanning(note)).reshape(-1, note).astype(np.float32)
    quiet = np.zeros(rest * note, np.float32)

    def samples(text):
        at = [zlib.crc32(w) % len(notes) for w in (text or "").encode().split()]
        return np.concatenate((quiet, notes[at].ravel(), quiet)) if at else np.zeros(0, np.float32)

    return samples


#: Samples of recordings that are fingerprinted together; a longer one goes by itself.
TOGETHER = 1 << 21


def fingerprints(df: DataFrame, id_col: str, media_col: str, s: Settings = Settings(), samples: Callable | None = None) -> DataFrame:
    """(rec_id, prints binary, sound binary, fp long): the packed integers of every row's recording, without a shuffle.

    Null, unreadable or too short media have no integers; fp is then of the samples, null if there are none. Identifiers may repeat or be null.
    """
    read = samples or wav_samples(s)

    def row(heard, p, sound):
        raw = p.astype("<u4").tobytes()
        fp = _digest(raw) if raw else _digest(b"samples" + heard.tobytes()) if len(heard) else None
        return raw, sound.astype(np.uint8).tobytes(), fp

    def rows(batches):
        for b in batches:
            media = b[1].dictionary_encode()  # a recording that repeats in a batch is heard once
            done, part, size = [], [], 0
            for x in media.dictionary.to_pylist():
                part.append(read(x))
                size += len(part[-1])
                if size > TOGETHER:
                    done += [row(h, *p) for h, p in zip(part, prints_of(part, s))]
                    part, size = [], 0
            done += [row(h, *p) for h, p in zip(part, prints_of(part, s))]
            none = row(np.zeros(0, np.float32), np.zeros(0, np.uint32), np.zeros(0, bool))
            out = list(zip(*(none if i is None else done[i] for i in media.indices.to_pylist()))) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([b[0], pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64())], ["rec_id", "prints", "sound", "fp"])

    return df.select(F.col(id_col).cast("long").alias("_id"), F.col(media_col).alias("_media")).mapInArrow(rows, "rec_id long, prints binary, sound binary, fp long")


def _digest(raw: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(raw) - (1 << 63)


def _keys(batches):
    """(key, class, at, query) rows: each two neighbouring sounding integers of a class as one long, since single ones also agree by chance."""
    for b in batches:
        cols = [], [], [], []
        for cls, raw, sound, query in zip(b["class_id"].to_pylist(), b["prints"].to_pylist(), b["sound"].to_pylist(), b["query"].to_pylist()):
            p, ok = np.frombuffer(raw, "<u4").astype(np.int64), np.frombuffer(sound, np.uint8).astype(bool)
            at = np.flatnonzero(ok[:-1] & ok[1:])
            cols[0].append(p[at] << 32 | p[at + 1])
            cols[1].append(np.full(len(at), cls))
            cols[2].append(at)
            cols[3].append(np.full(len(at), query))
        if cols[0]:
            k, c, a, q = map(np.concatenate, cols)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(c, pa.int64()), pa.array(a, pa.int32()), pa.array(q.astype(bool))], ["key", "class_id", "at", "query"])


def _check(s: Settings):
    def rows(batches):
        for b in batches:
            got = [closest(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"), o, s) for x, y, o in zip(b["qp"].to_pylist(), b["rp"].to_pylist(), b["offsets"].to_pylist())]
            keep = pa.array([x is not None for x in got], pa.bool_())
            o, n, e = (pa.array([x and x[i] for x in got], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.float64())))
            yield pa.RecordBatch.from_arrays([b["query_class"], b["class_id"], o, n, e], ["query_class", "class_id", "offset", "frames", "bit_error"]).filter(keep)

    return rows


def match(df: DataFrame, id_col: str, media_col: str, query: F.Column, s: Settings = Settings(), samples: Callable | None = None) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): recordings by class, and query classes aligned with others.

    members: (rec_id, n_prints, class_id, is_query), one row for each input row; recordings with equal fingerprints are one class, named by its
    smallest id (one too short for integers is classed by equal samples, one without samples has its own id; null ids come last). pairs: (query_class, class_id, offset, frames, bit_error) for
    each other class that shares at least s.hits pairs of integers with a query's class at an offset, over s.overlap frames, with at most
    s.errors of the bits differing; of several such offsets the one with the smallest share of them (then the longest, then the smallest). `query` is a condition on rec_id. Recordings count whole, whatever their length; other columns are not read. Empty in, empty out.
    """
    raw = settle(fingerprints(df, id_col, media_col, s, samples).withColumn("is_query", F.coalesce(query, F.lit(False))), "prints")
    has = raw.where("fp is not null")
    classes = settle(has.groupBy("fp").agg(F.min("rec_id").alias("class_id"), F.max("is_query").alias("query"), F.min("prints").alias("prints"), F.min("sound").alias("sound")).where("class_id is not null"), "classes")
    named = join_hot(raw, classes.select("fp", "class_id"), "fp", "rec_id", "left")
    members = named.select("rec_id", (F.octet_length("prints") / 4).cast("long").alias("n_prints"), F.when(F.col("fp").isNotNull(), F.col("class_id")).otherwise(F.col("rec_id")).alias("class_id"), "is_query")
    keys = classes.select("class_id", "prints", "sound", "query").mapInArrow(_keys, "key long, class_id long, at int, query boolean")
    asked = keys.where("query").select("key", F.col("class_id").alias("query_class"), F.col("at").alias("q_at"))
    hits = join_hot(keys.select("key", "class_id", "at"), asked, "key", "class_id").where("class_id <> query_class")
    counts = hits.groupBy("query_class", "class_id", (F.col("at") - F.col("q_at")).alias("offset")).agg(F.count("*").alias("n")).where(F.col("n") >= s.hits)
    best = counts.groupBy("query_class", "class_id").agg(F.collect_list("offset").alias("offsets"))
    texts = classes.select("class_id", F.col("prints").alias("rp"))
    asking = classes.where("query").select(F.col("class_id").alias("query_class"), F.col("prints").alias("qp"))
    both = join_hot(best.join(texts, "class_id"), asking, "query_class", "class_id")
    return members, both.select("query_class", "class_id", "offsets", "qp", "rp").mapInArrow(_check(s), "query_class long, class_id long, offset int, frames int, bit_error double")


def summary(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(rec_id, n_prints, class_id, n_links, best_query, best_offset, bit_error), one row for each recording: the query classes its class aligns with, and the closest."""
    found = F.min(F.struct("bit_error", "query_class", "offset"))
    best = pairs.groupBy("class_id").agg(F.count("*").alias("n_links"), found.alias("b"))
    best = best.select("class_id", "n_links", F.col("b.query_class").alias("best_query"), F.col("b.offset").alias("best_offset"), F.col("b.bit_error").alias("bit_error"))
    return join_hot(members, best, "class_id", "rec_id", "left").select("rec_id", "n_prints", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "best_query", "best_offset", "bit_error")
