"""One place for the settings that the operators rely on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "asofkit", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; cp1252 and other Java charsets are readable."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.legacy.javaCharsets": "true",
    }
    return SparkSession.builder.appName(app).config(map=settings | conf).getOrCreate()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose timestamps without zone are read as UTC (the session's zone)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*[F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes])


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under the one that all executors share; a local master without any gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='asofkit-')}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
