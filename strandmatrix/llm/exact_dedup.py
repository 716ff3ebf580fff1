"""Exact deduplication by a tree-merge of sorted digest runs.

Every partition sorts its texts' digests into runs, cut into a few digest ranges, each distinct
digest once with its best identifier and its number of copies. Runs of a range then meet in rounds of a
tree (fan_in partitions a round): a multiway merge of sorted runs that keeps, of equal
digests, the best identifier, and the partitions that hold it. A merged run is cut into as many ranges as runs went into it, so runs
stay as long as a partition's whatever the table's size, and no task holds more than fan_in of them. From the last
runs the verdicts on digests that several partitions hold go back to those. A text with many copies costs one
entry per partition, however many copies there are, so no task gathers a hot text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmatrix.llm.common import binaries, expand, give_back, lean, settle, utf8

#: SHA-256, then a second hash and the length: digests merge only if all three agree.
WIDTH = 48
#: Digest ranges of a partition's own runs.
FIRST = 8
FAN_IN = 8
_RUN = "rng long, node int, fps binary, best binary, home binary, copies binary, many binary, homes binary"


def fingerprint(text: F.Column) -> F.Column:
    digest = F.unhex(F.sha2(text, 256))
    return F.concat(digest, F.unhex(F.lpad(F.hex(F.xxhash64(text)), 16, "0")), F.unhex(F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0")))


def _rank(ids: pa.Array, keep: str) -> np.ndarray:
    """int64 keys, larger is better; a null id loses against every other."""
    vals = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    rank = vals if keep == "max" else ~vals
    return np.where(ids.is_null().to_numpy(zero_copy_only=False), np.iinfo(np.int64).min, rank)


def merge_runs(fps: np.ndarray, best: np.ndarray, home: np.ndarray, copies: np.ndarray, many: np.ndarray, homes: np.ndarray):
    """Merges concatenated sorted runs: of equal fingerprints the best rank stays, then the lowest home. many: of each entry, how many of `homes` hold it.

    numpy's stable sort of strings is a timsort, which finds the runs and merges them pairwise.
    """
    order = np.argsort(fps, kind="stable")
    holders = homes[expand((np.cumsum(many) - many)[order], many[order])]
    fps, best, home, copies, many = fps[order], best[order], home[order], copies[order], many[order]
    starts = np.flatnonzero(np.concatenate(([True], fps[1:] != fps[:-1])))
    top = np.maximum.reduceat(best, starts)
    sizes = np.diff(np.append(starts, len(fps)))
    tied = np.where(best == np.repeat(top, sizes), home, np.iinfo(np.int32).max)
    return fps[starts], top, np.minimum.reduceat(tied, starts), np.add.reduceat(copies, starts), np.add.reduceat(many, starts), holders


def _cuts(fps: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """(range of each stretch of sorted fingerprints, where the stretches begin and the last ends): ranges by the leading 4 bytes."""
    lead = fps.view(np.uint8).reshape(-1, WIDTH)[:, :4].astype(np.uint64) @ np.array([1 << 24, 1 << 16, 1 << 8, 1], np.uint64)
    rng = (lead * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
    cuts = np.flatnonzero(np.concatenate(([True], rng[1:] != rng[:-1], [True])))
    return rng[cuts[:-1]], cuts


def _local_runs(keep: str):
    def run(batches):
        from pyspark import TaskContext

        node = TaskContext.get().partitionId() if TaskContext.get() else 0
        tables = [pa.Table.from_batches([b]) for b in batches]
        if not tables:
            return
        t = pa.concat_tables(tables).combine_chunks()
        if not len(t):
            return
        raw = np.frombuffer(b"".join(t["fp"].to_pylist()), f"S{WIDTH}")
        ids = t["_id"].combine_chunks()
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        rank = _rank(ids, keep)
        order = np.lexsort((~rank, raw))  # best first within equal fingerprints
        raw, rank, ids = raw[order], rank[order], ids.take(pa.array(order))
        starts = np.flatnonzero(np.concatenate(([True], raw[1:] != raw[:-1])))
        sizes = np.diff(np.append(starts, len(raw)))
        fps, best, one = raw[starts], rank[starts], np.ones(len(starts), np.int32)
        ends = np.append(starts, len(raw))
        which, cuts = _cuts(fps, FIRST)
        for r, a, b in zip(which.tolist(), cuts[:-1].tolist(), cuts[1:].tolist()):
            cols = [fps[a:b], best[a:b], node * one[a:b], sizes[a:b].astype(np.int64), one[a:b], node * one[a:b]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r], pa.int64()), pa.array([node], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in cols), pa.ListArray.from_arrays(pa.array([0, ends[b] - ends[a]], pa.int32()), ids[ends[a] : ends[b]])],
                ["rng", "node", "fps", "best", "home", "copies", "many", "homes", "ids"],
            )
        give_back()

    return run


_KINDS = {"fps": f"S{WIDTH}", "best": np.int64, "home": np.int32, "copies": np.int64, "many": np.int32, "homes": np.int32}


def _columns(t: pa.Table) -> list[np.ndarray]:
    """A run's arrays, those of several rows one behind the other."""
    return [np.frombuffer(utf8(t[c])[0].tobytes(), kind) for c, kind in _KINDS.items()]


def _round(fan_in: int, ranges: int):
    """Merges the runs that meet and cuts the result into the next round's ranges."""

    def merge(t: pa.Table) -> pa.Table:
        *run, holders = merge_runs(*_columns(t))
        which, cuts = _cuts(run[0], ranges)
        held = np.concatenate(([0], np.cumsum(run[4])))
        many = np.diff(cuts)
        cols = [binaries(x.astype(kind), many) for x, kind in zip(run, _KINDS.values())] + [binaries(holders, np.diff(held[cuts]))]
        node = t["node"][0].as_py() // fan_in
        return pa.table([pa.array(which), pa.array(np.full(len(many), node), pa.int32()), *cols], names=["rng", "node", *_KINDS])

    return merge


_VERDICT = "node int, fps binary, best binary, home binary, copies binary"


def _verdicts(batches):
    """For each partition the final entries of its digests that others hold too."""
    for b in batches:
        fps, best, home, copies, many, holders = _columns(pa.Table.from_batches([b]))
        shared = np.repeat(many > 1, many)
        entry, node = np.repeat(np.arange(len(many)), many)[shared], holders[shared]
        if not len(node):
            continue
        order = np.argsort(node, kind="stable")
        entry, node = entry[order], node[order]
        cuts = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1], [True])))
        yield pa.RecordBatch.from_arrays([pa.array(node[cuts[:-1]], pa.int32()), *(binaries(x[entry], np.diff(cuts)) for x in (fps, best, home, copies))], ["node", "fps", "best", "home", "copies"])


def _expand(keep: str):
    """A partition's rows with the verdicts: those that came back, else its own."""

    def rows(key, local: pa.Table, told: pa.Table) -> pa.Table:
        node = key[0].as_py()
        fps, best, home, copies, _, _ = _columns(local)
        ids = pa.concat_arrays([x.values for x in local["ids"]]) if len(local) else pa.array([], pa.int64())
        sizes, best, home, group = copies, best.copy(), home.copy(), copies.copy()
        if len(told) and len(local):
            got = [np.frombuffer(utf8(told[c])[0].tobytes(), _KINDS[c]) for c in ("fps", "best", "home", "copies")]
            order = np.argsort(fps, kind="stable")
            at = order[np.searchsorted(fps[order], got[0])]
            best[at], home[at], group[at] = got[1:]
        none = best == np.iinfo(np.int64).min
        keep_id = pa.array(best if keep == "max" else ~best, mask=none)
        of = np.repeat(np.arange(len(sizes)), sizes)
        first = np.zeros(len(of), bool)
        first[np.cumsum(sizes) - sizes] = True
        own = _rank(ids, keep)
        kept = first & (home == node)[of] & (own == best[of])
        at = pa.array(of)
        whole = fps.view(np.uint8).reshape(-1, WIDTH)
        hexes = pa.array([x.tobytes().hex() for x in whole[:, :32]], pa.string())
        return pa.table([ids, keep_id.take(at), pa.array(group[of]), pa.array(kept), hexes.take(at), pa.array([x.tobytes() for x in whole], pa.binary()).take(at)], names=["doc_id", "keep_id", "group_size", "kept", "text_sha256", "fp"])

    return rows


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", fan_in: int = FAN_IN) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, fp), one row for each input row.

    Texts are equal when their bytes are; null counts as empty. Of equal texts the row with the smallest (keep="max":
    largest) identifier stays. A null identifier loses against any other; if a group has
    only nulls, keep_id is null. Of rows that repeat both identifier and text exactly one is kept.
    An empty table gives an empty result. Other columns of df are not read.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep must be 'min' or 'max'")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    prints = df.select(F.col(id_col).cast("long").alias("_id"), fingerprint(text).alias("fp"))
    local = settle(prints.mapInArrow(_local_runs(keep), f"{_RUN}, ids array<long>"), "digest-runs")
    nodes, ranges = (local.agg(F.max("node")).first()[0] or 0) + 1, FIRST
    runs = local.drop("ids")
    while True:
        ranges = min(ranges * fan_in, 1 << 31)
        runs = runs.groupBy("rng", (F.col("node") / fan_in).cast("int").alias("up")).applyInArrow(lean(_round(fan_in, ranges)), _RUN)
        nodes = -(-nodes // fan_in)
        if nodes <= 1:
            break
    told = runs.mapInArrow(_verdicts, _VERDICT)
    return local.groupBy("node").cogroup(told.groupBy("node")).applyInArrow(lean(_expand(keep)), "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string, fp binary")


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows of df that stay, with all their columns. Of rows that repeat identifier and text one stays."""
    verdict = exact_dedup(df, id_col, text_col, keep).where("kept").select(F.coalesce("doc_id", F.lit(0)).alias("_key"), F.col("doc_id").isNull().alias("_none"), F.col("fp").alias("_fp"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = df.select(F.struct("*").alias("_row"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("_key"), F.col(id_col).isNull().alias("_none"), fingerprint(text).alias("_fp"))
    return keyed.join(verdict, ["_key", "_none", "_fp"], "left_semi").dropDuplicates(["_key", "_none", "_fp"]).select("_row.*")
