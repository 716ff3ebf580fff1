"""k-mer counts by arrays: one exchange of packed counts, from which totals, thresholds, counts and postings are made.

A task sorts some millions of windows at a time and sends their distinct k-mers, with genomes and counts, in rows of one bucket each.
A bucket holds all genomes' counts of its k-mers, so whatever bounds a k-mer's total or prevalence is settled where it is merged: nothing is
joined and only rows of a result leave. Buckets go by a permutation of the packed k-mers that leaves no bucket hot, and their number by the size of the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandmatrix.functions import windows
from strandmatrix.params import MatrixParams
from strandmatrix.sources.shared import give_back, ship

#: Window starts of a piece, of a step whose arrays stay in a core's cache, and of what is sorted at once.
PIECE, STEP, SORTED = 1 << 14, 1 << 16, 1 << 22
#: Bytes of input whose k-mers one bucket takes, the fewest and most buckets (as bits), and the bytes of an input that does not tell.
BUCKET_BYTES, FEWEST, MOST, UNTOLD = 2 << 20, 4, 16, 1 << 31


def bucket_bits(records: DataFrame) -> int:
    """By the sizes of the files that a frame reads; nothing runs for it."""
    leaves = records._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    total = sum(x if x < 1 << 50 else UNTOLD for x in sizes)
    return min(MOST, max(FEWEST, (total // BUCKET_BYTES).bit_length()))


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _flat(column: pa.Array, i: int, kind) -> np.ndarray:
    return np.frombuffer(column[i].as_buffer(), kind)


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    n = len(columns[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = columns[0][1:] != columns[0][:-1]
        for c in columns[1:]:
            new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _low(k: int, bits: int) -> tuple[int, type]:
    """Bits of a first word below a bucket's, and the type that they travel in."""
    n = 2 * windows.word_sizes(k)[0] - bits
    return n, np.uint16 if n <= 16 else np.uint32 if n <= 32 else np.uint64


def _sorted_runs(words: list[np.ndarray], g: np.ndarray, genomes: int, bits: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct (words, genome) in order, with their numbers."""
    wide = max(genomes - 1, 0).bit_length()
    if len(words) == 1 and bits + wide <= 64:
        key = words.pop()
        key <<= np.uint64(wide)
        key |= g
        key.sort()
        at = _heads(key)
        counts = np.diff(np.append(at, len(key)))
        key = key[at]
        return [key >> np.uint64(wide)], (key & np.uint64((1 << wide) - 1)).astype(np.uint32), counts
    order = np.lexsort((g, *words[::-1]))
    words, g = [w[order] for w in words], g[order]
    at = _heads(*words, g)
    return [w[at] for w in words], g[at], np.diff(np.append(at, len(g)))


def _rows(words: list[np.ndarray], g: np.ndarray, names: pa.Array, k: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Rows of (bucket, genomes, words, genome numbers, counts) for some windows."""
    words, g, counts = _sorted_runs(words, g, len(names), 2 * windows.word_sizes(k)[0])
    low, kind = _low(k, bits)
    cuts = np.searchsorted(words[0], np.arange(1 << bits, dtype=np.uint64) << np.uint64(low)).tolist() + [len(g)]
    first = (words[0] & np.uint64((1 << low) - 1)).astype(kind)
    full = [b for b in range(1 << bits) if cuts[b] < cuts[b + 1]]
    for i in range(0, len(full), 64):
        own, gs, cs, ws = [], [], [], [[] for _ in words]
        for b in full[i : i + 64]:
            part = slice(cuts[b], cuts[b + 1])
            here, mine = g[part], names
            if len(names) > len(here):
                used, here = np.unique(here, return_inverse=True)
                mine = names.take(pa.array(used))
            own.append(mine)
            gs.append(here.astype(np.min_scalar_type(len(mine))).tobytes())
            cs.append(_narrow(counts[part]).tobytes())
            for w, out in zip([first, *words[1:]], ws):
                out.append(w[part].tobytes())
        offsets = np.cumsum([0, *map(len, own)]).astype(np.int32)
        cols = [pa.array(full[i : i + 64], pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.concat_arrays(own)), pa.array(gs, pa.binary()), pa.array(cs, pa.binary()), *[pa.array(w, pa.binary()) for w in ws]]
        yield pa.RecordBatch.from_arrays(cols, ["_b", "genomes", "gids", "counts", *[f"_w{j}" for j in range(len(ws))]])


def _dealt(k: int, fold: bool, bits: int, table: np.ndarray):
    """Batches of (genome, piece) to rows of buckets."""

    def run(batches):
        words, places, names, held, known = [], [], [], 0, 0

        def out():
            all_names = pa.concat_arrays(names).dictionary_encode()
            to = all_names.indices.to_numpy().astype(np.uint32)
            joined = [np.concatenate(w) for w in zip(*words)]
            words.clear()
            g = to[np.concatenate(places)]
            places.clear(), names.clear()
            yield from _rows(joined, g, all_names.dictionary, k, bits)

        for b in batches:
            if not b.num_rows:
                continue
            coded = b.column(0).dictionary_encode()
            _, off, data = b.column(1).cast(pa.binary()).buffers()
            off = np.frombuffer(off, np.int32)[b.column(1).offset :][: b.num_rows + 1].astype(np.int64)
            raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
            off -= off[0]
            starts = np.zeros(len(raw) + 1, bool)
            starts[off] = True
            of = np.repeat(coded.indices.to_numpy().astype(np.uint32), np.diff(off))
            names.append(coded.dictionary)
            for i in range(0, len(raw) - k + 1, STEP):
                end = i + STEP + k - 1
                at, w = windows.packed(table[raw[i:end]], starts[: len(raw)][i:end], k, fold)
                if not len(at):
                    continue
                words.append(windows.mixed(w, k))
                places.append(of[i:end][at] + np.uint32(known))
                held += len(at)
                if held >= SORTED:
                    yield from out()
                    names.append(coded.dictionary)
                    held = known = 0
            known += len(coded.dictionary)
        if held:
            yield from out()
        give_back()

    return run


@dataclass
class Merged:
    """One bucket: distinct (k-mer, genome) in order, and the runs of each k-mer."""

    words: list[np.ndarray]
    g: np.ndarray
    freq: np.ndarray
    names: pa.Array
    k: int

    def __post_init__(self) -> None:
        self.at = _heads(*self.words)
        self.size = np.diff(np.append(self.at, len(self.g)))
        self.total = np.add.reduceat(self.freq, self.at) if len(self.at) else np.zeros(0, np.int64)

    def kept(self, p: MatrixParams) -> np.ndarray:
        n = self.total if p.threshold_on == "occurrences" else self.size
        return (n >= p.min_count) & (n <= p.max_count)

    def kmers(self, which: np.ndarray) -> pa.Array:
        raw = windows.letters(windows.unmixed([w[which] for w in self.words], self.k), self.k)
        offsets = np.arange(0, len(raw) + 1, self.k, dtype=np.int64)
        return pa.Array.from_buffers(pa.large_string(), len(raw) // self.k, [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).cast(pa.string())


def _merge(t: pa.Table, k: int, bits: int) -> Merged:
    low, kind = _low(k, bits)
    t = t.combine_chunks()
    column = {c: t[c].chunk(0) for c in t.column_names}
    n_words = len(windows.word_sizes(k))
    lists = column["genomes"]
    coded = lists.flatten().dictionary_encode()
    to = coded.indices.to_numpy().astype(np.uint32)
    ends = np.cumsum(lists.value_lengths().to_numpy())
    gs, cs, ws = [], [], [[] for _ in range(n_words)]
    later = np.uint32 if k <= 16 else np.uint64
    for i in range(t.num_rows):
        ws[0].append(_flat(column["_w0"], i, kind))
        n = len(ws[0][-1])
        for j in range(1, n_words):
            ws[j].append(_flat(column[f"_w{j}"], i, later))
        own = to[ends[i - 1] if i else 0 : ends[i]]
        gs.append(own[_flat(column["gids"], i, np.min_scalar_type(len(own)))])
        raw = column["counts"][i].as_buffer()
        cs.append(np.frombuffer(raw, f"<u{raw.size // n}"))
    words, g, counts = [np.concatenate(w) for w in ws], np.concatenate(gs), np.concatenate(cs)
    names = coded.dictionary
    wide, tall = max(len(names) - 1, 0).bit_length(), int(counts.max(initial=0)).bit_length()
    if n_words == 1 and low + wide + tall <= 64:
        key = (words[0].astype(np.uint64) << np.uint64(wide) | g) << np.uint64(tall) | counts
        key.sort()
        counts = (key & np.uint64((1 << tall) - 1)).astype(np.int64)
        key >>= np.uint64(tall)
        at = _heads(key)
        key = key[at]
        words, g = [key >> np.uint64(wide)], (key & np.uint64((1 << wide) - 1)).astype(np.uint32)
    else:
        order = np.lexsort((g, *words[::-1]))
        words, g, counts = [w[order] for w in words], g[order], counts[order].astype(np.int64)
        at = _heads(*words, g)
        words, g = [w[at] for w in words], g[at]
    words[0] = words[0].astype(np.uint64) | np.uint64(column["_b"][0].as_py()) << np.uint64(low)
    return Merged(words, g, np.add.reduceat(counts, at), names, k)


@dataclass(frozen=True)
class Tally:
    """The exchanged counts, lazy; each method is a frame made in one pass over its buckets."""

    dealt: DataFrame
    k: int
    bits: int
    genome: str
    kind: T.DataType

    def _each(self, make: Callable[[Merged], dict[str, pa.Array]], schema: T.StructType) -> DataFrame:
        k, bits, names = self.k, self.bits, schema.names

        def work(t: pa.Table) -> pa.Table:
            out = make(_merge(t, k, bits))
            give_back()
            return pa.table([out[c] if isinstance(out[c], pa.Array) else pa.array(out[c], pa.int64()) for c in names], names=names)

        return self.dealt.groupBy("_b").applyInArrow(work, schema)

    def counts(self) -> DataFrame:
        """(genome, kmer, freq), unfiltered."""
        genome = self.genome

        def make(m: Merged):
            return {genome: m.names.take(pa.array(m.g)), "kmer": m.kmers(slice(None)), "freq": m.freq}

        return self._each(make, T.StructType().add(genome, self.kind).add("kmer", "string").add("freq", "long"))

    def totals(self, p: MatrixParams | None = None) -> DataFrame:
        """(kmer, total, n_genomes) over all genomes; with p, of the k-mers that it keeps."""

        def make(m: Merged):
            which = slice(None) if p is None else m.kept(p)
            return {"kmer": m.kmers(m.at[which]), "total": m.total[which], "n_genomes": m.size[which]}

        return self._each(make, T.StructType().add("kmer", "string").add("total", "long").add("n_genomes", "long"))

    def kept(self, p: MatrixParams) -> DataFrame:
        """(kmer, genomes, freqs) of the kept k-mers: the entries of each one's column."""
        kind = self.kind

        def make(m: Merged):
            which = m.kept(p)
            entry = np.repeat(which, m.size)
            offsets = pa.array(np.append(0, np.cumsum(m.size[which])).astype(np.int32))
            lists = {"genomes": m.names.take(pa.array(m.g[entry])), "freqs": pa.array(m.freq[entry], pa.int64())}
            return {"kmer": m.kmers(m.at[which])} | {c: pa.ListArray.from_arrays(offsets, x) for c, x in lists.items()}

        return self._each(make, T.StructType().add("kmer", "string").add("genomes", T.ArrayType(kind)).add("freqs", T.ArrayType(T.LongType())))

    def left_out(self, p: MatrixParams) -> DataFrame:
        """(genome, kmer, freq) of the k-mers that are not kept."""
        genome = self.genome

        def make(m: Merged):
            entry = np.flatnonzero(np.repeat(~m.kept(p), m.size))
            return {genome: m.names.take(pa.array(m.g[entry])), "kmer": m.kmers(entry), "freq": m.freq[entry]}

        return self._each(make, T.StructType().add(genome, self.kind).add("kmer", "string").add("freq", "long"))

    def nnz(self, p: MatrixParams) -> DataFrame:
        """(genome, nnz): the number of kept k-mers of each genome that has any."""
        genome = self.genome

        def make(m: Merged):
            n = np.bincount(m.g[np.repeat(m.kept(p), m.size)], minlength=len(m.names))
            some = np.flatnonzero(n)
            return {genome: m.names.take(pa.array(some)), "n": n[some]}

        parts = self._each(make, T.StructType().add(genome, self.kind).add("n", "long"))
        return parts.groupBy(genome).agg(F.sum("n").alias("nnz"))

    def sizes(self, p: MatrixParams | None = None) -> DataFrame:
        """One row (n_cols, nnz): the kept k-mers, or all, and their entries."""

        def make(m: Merged):
            which = slice(None) if p is None else m.kept(p)
            return {"n_cols": [len(m.at[which])], "nnz": [int(m.size[which].sum())]}

        parts = self._each(make, T.StructType().add("n_cols", "long").add("nnz", "long"))
        return parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in parts.columns])


def tally(records: DataFrame, params: MatrixParams, genome: str = "genome", deal: int | None = None, letters: bool = False) -> Tally:
    """The counts of (genome, seq) records; letters: seq is lower-case prose without white space, its letter number i base i mod 4.

    deal as counting.count_per_genome has it; records without a genome are left out as there.
    """
    ship(records.sparkSession)
    k, n = params.k, len(windows.word_sizes(params.k))
    raw = records.where(F.col(genome).isNotNull()).select(genome, F.col("seq").cast("binary").alias("_raw")).where(F.length("_raw") >= k)
    starts = F.expr(f"sequence(0L, (length(_raw) - {k}) div {PIECE})")
    cut = raw.select(genome, "_raw", F.explode(starts).alias("_c")).select(genome, F.expr(f"substring(_raw, cast(_c * {PIECE} + 1 as int), {PIECE + k - 1})").alias("piece"))
    bits, kind = bucket_bits(records), records.schema[genome].dataType
    schema = T.StructType().add("_b", "integer").add("genomes", T.ArrayType(kind)).add("gids", "binary").add("counts", "binary")
    for i in range(n):
        schema = schema.add(f"_w{i}", "binary")
    run = _dealt(k, params.canonical, bits, windows.LETTERS if letters else windows.DNA)
    return Tally((cut.repartition(deal) if deal else cut).mapInArrow(run, schema), k, bits, genome, kind)
