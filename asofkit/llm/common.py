"""Helpers shared by the training-data operators: shared tables, dense numbering, fresh names."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words as the queries define them: runs without space, tab, LF, VT, FF or CR.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where the session names none, a local master gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='asofkit-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back, which cuts the lineage.

    A lost executor costs the reading tasks a retry, nothing more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_asofkit_path"] = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete a table that ``materialise`` wrote and that nothing reads any more."""
    path = df is not None and df.__dict__.get("_asofkit_path")
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that are done."""
    for _ in range(2):  # what the first round frees may hold more
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


def release() -> None:
    """Give a Python worker's freed memory back, as workers live on after a stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library has it
        pass


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have yet."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def group_positions(keys: np.ndarray, seen: dict[int, int]) -> np.ndarray:
    """For each row its running number among rows of its key; ``seen`` carries the counts on."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.empty(0, np.int64)
    size = np.diff(np.r_[first, len(k)])
    start = np.array([seen.get(int(x), 0) for x in k[first]], np.int64)
    for x, n, s in zip(k[first].tolist(), size.tolist(), start.tolist()):
        seen[x] = s + n
    out = np.empty(len(keys), np.int64)
    out[order] = np.arange(len(k)) - np.repeat(first - start, size)
    return out


def numbered(df: DataFrame, key: str, out: str, name: str) -> DataFrame:
    """Number the rows of each key gaplessly from 0, without bringing a key's rows together.

    Every partition numbers its own rows and is written out with its partition id; the start of
    each partition is a running sum over the (partition, key) counts. ``key`` must be an integer
    column with few distinct values.
    """
    schema = T.StructType([*df.schema, T.StructField("_pid", T.IntegerType()), T.StructField("_idx", T.LongType())])
    at = df.columns.index(key)

    def number(batches):
        pid, seen = TaskContext.get().partitionId(), {}
        for b in batches:
            keys = b.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.full(len(keys), pid, np.int32)), pa.array(group_positions(keys, seen))],
                names=[*b.schema.names, "_pid", "_idx"],
            )

    t = materialise(df.mapInArrow(number, schema), name)
    before = Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = t.groupBy("_pid", key).agg(F.count("*").alias("_n")).select("_pid", key, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return t.join(starts, ["_pid", key]).withColumn(out, F.col("_start") + F.col("_idx")).drop("_pid", "_idx", "_start")
