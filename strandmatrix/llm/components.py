"""Connected components of a link table by alternating large and small stars, as DataFrame operations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmatrix.llm.common import discard, settle


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its tree) of some links: union-find over what one partition holds."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    up = list(range(len(nodes)))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    half = len(u)
    for a, b in zip(at[:half].tolist(), at[half:].tolist()):
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    root = np.array([top(i) for i in range(len(nodes))], np.int64)
    return nodes, nodes[root] if len(nodes) else nodes


def _contract(batches):
    for b in batches:
        if b.num_rows:
            n, r = forest(b[0].to_numpy(), b[1].to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(n[n != r]), pa.array(r[n != r])], ["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of a (u, v) table of long pairs: root is the component's smallest node, also for itself.

    A round points every node's larger neighbours to its smallest, then its smaller ones; it ends when every node points to one
    that points to none. Minima are combined map-side, and their joins with a hot node's rows can be split, as nodes are unique on one side.
    """
    e = settle(links.select(F.col("u").cast("long"), F.col("v").cast("long")).mapInArrow(_contract, "u long, v long").distinct(), "links")
    while True:
        up = e.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("x"))
        chained = e.select(F.col("v").alias("u")).join(up, "u", "left_semi").select("u")
        if up.where("m < x").select("u").union(chained).isEmpty():
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        before, e = e, settle(small.select("x.u", "x.v").where("u <> v").distinct(), "links")
        discard(before)
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).union(roots)
