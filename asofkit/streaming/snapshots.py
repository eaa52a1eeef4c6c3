"""Snapshot history from append-only captures, as a stream or in batch."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from asofkit.sources.files import as_of_time


def captures(spark: SparkSession, base: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """New JSON captures under as_of=... folders, with their time as as_of_ts."""
    full = T.StructType([*schema, T.StructField("as_of", T.StringType())])
    raw = spark.readStream.schema(full).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "false").json(base)
    return raw.withColumn("as_of_ts", as_of_time("as_of"))


def _committed(spark: SparkSession, path: str, before: tuple[str, int] | None = None) -> DataFrame | None:
    """The commits of a history but, with ``before``, that batch of that run and later ones of it; None without any."""
    try:
        log = spark.read.schema(_COMMIT).parquet(f"{path}/commits")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    return log if before is None else log.where(~((F.col("run") == before[0]) & (F.col("batch") >= before[1])))


_COMMIT = "run string, batch long, latest timestamp, rows long, late long"


def write_history(stream: DataFrame, path: str, checkpoint: str, key: Sequence[str], late: str = "30 days") -> StreamingQuery:
    """Add each different snapshot of a key and time once, whatever is replayed or captured again.

    A batch writes its rows to a folder of its own, which a replay of the batch replaces, and then
    its commit; ``history`` reads committed batches only, so a run that ends anywhere between
    leaves neither a gap nor a double. Snapshots are told apart by a digest of their values: what
    an earlier batch has, on the same day, isn't added again. Rows more than ``late`` before the latest
    time of the earlier batches are kept apart as late ones. Rows without a time are late, too. A
    checkpoint folder that is begun anew must have a new name.
    """
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    values = [c for c in stream.columns if c not in (*key, "as_of_ts")]

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        digest = F.sha2(F.to_json(F.struct(*values), {"ignoreNullFields": "false"}), 256) if values else F.lit("")
        rows = batch.withColumns({"digest": digest, "day": F.coalesce(F.to_date("as_of_ts").cast("string"), F.lit("none"))})
        same = [*key, "as_of_ts", "digest"]
        rows = rows.dropDuplicates(same).persist()
        log = _committed(spark, path, (run, number))
        latest = log.agg(F.max("latest")).first()[0] if log is not None else None
        behind = F.col("as_of_ts").isNull() if latest is None else F.col("as_of_ts").isNull() | (F.col("as_of_ts") < F.lit(latest) - F.expr(f"INTERVAL {late}"))
        if log is not None and log.limit(1).count():
            days = [r["day"] for r in rows.select("day").distinct().collect()]  # the days of one batch
            known = _rows(spark, path, log).where(F.col("day").isin(days)).select(*[F.col(c).alias(f"_{c}") for c in same])
            match = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same])
            rows = rows.join(known, match, "left_anti")
        out = rows.withColumn("late", F.coalesce(behind, F.lit(False)))
        target = f"{path}/rows/run={run}/batch={number}"
        out.write.mode("overwrite").partitionBy("day").parquet(target)
        counted = spark.read.schema(out.schema).parquet(target).agg(F.lit(run).alias("run"), F.lit(number).cast("long").alias("batch"), F.max(F.when(~F.col("late"), F.col("as_of_ts"))).alias("latest"), F.count("*").alias("rows"), F.count_if("late").alias("late"))
        counted.coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/of={run}-{number}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _rows(spark: SparkSession, path: str, log: DataFrame) -> DataFrame:
    done = log.select(F.col("run"), F.col("batch")).distinct()  # a row a batch
    every = spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows/run=*/batch=*")
    return every.withColumn("batch", F.col("batch").cast("long")).join(done, ["run", "batch"], "left_semi")


def history(spark: SparkSession, path: str, late: bool = False) -> DataFrame:
    """The committed snapshots, or those that came late."""
    log = _committed(spark, path)
    if log is None:
        raise FileNotFoundError(f"nothing is committed under {path}")
    return _rows(spark, path, log).where(F.col("late") == late).drop("run", "batch", "day", "digest", "late")


def as_of(snapshots: DataFrame, key: Sequence[str], time: str, at: str) -> DataFrame:
    """Each key's latest snapshot at or before a time."""
    rows = snapshots.where(F.col(time) <= F.lit(at).cast("timestamp"))
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(time, *[c for c in rest if c != time])).alias("_v")).select(*key, "_v.*")
