"""What the driver and all executors share: a folder, this package; and memory that workers give back."""

from __future__ import annotations

import ctypes
import gc
import pathlib
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or in local mode, where that is unset, a new folder."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="strandmatrix-")
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def fresh(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing has yet."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the Python workers, once an application, so that they need no path set up for it."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        top = pathlib.Path(__file__).resolve().parent.parent
        target = pathlib.Path(tempfile.mkdtemp(prefix="ship-")) / "strandmatrix_workers.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        sc.addPyFile(str(target))
        _shipped.add(sc.applicationId)
    return spark


#: With this, Spark deletes the shuffle files of a query when the query ends, not when the driver's collector finds them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, what: str) -> DataFrame:
    """Writes a frame to the shared folder and reads it back: lineage ends in files that outlive executors, and its shuffle files go with the write."""
    spark, path = df.sparkSession, fresh(df.sparkSession, what)
    gc.collect()
    if jvm := getattr(spark.sparkContext, "_jvm", None):
        jvm.System.gc()  # shuffle files of what was computed before may go earlier; nothing depends on it
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def give_back() -> None:
    """Returns memory that this process has freed to the system: Python workers live on and would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)
