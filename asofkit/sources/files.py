"""Reading captures: text tables, JSON documents, chunked records and verified raw bodies."""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

AS_OF = "%Y-%m-%dT%H-%M-%SZ"


class IntegrityError(ValueError):
    """A stored body isn't what its metadata says."""


def encode_as_of(t: datetime) -> str:
    """A time as a directory name whose order as text is its order in time; it must have a zone."""
    if t.tzinfo is None:
        raise ValueError("a capture time needs a time zone")
    return t.astimezone(UTC).strftime(AS_OF)


def decode_as_of(name: str) -> datetime:
    return datetime.strptime(name, AS_OF).replace(tzinfo=UTC)


def as_of_time(column: str = "as_of"):
    """The timestamp of a partition column as_of; partition discovery may have read it as text."""
    return F.try_to_timestamp(F.col(column), F.lit("yyyy-MM-dd'T'HH-mm-ss'Z'"))


def _listed(spark: SparkSession, base: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def names(spark: SparkSession, base: str) -> list[str]:
    """The names in a folder, in order; none if it is absent."""
    return _listed(spark, base)


def as_of_partitions(spark: SparkSession, base: str) -> list[str]:
    """The as_of=... directories under a folder, oldest first."""
    return [n for n in _listed(spark, base) if n.startswith("as_of=")]


def latest_partition(spark: SparkSession, base: str) -> str | None:
    found = as_of_partitions(spark, base)
    return f"{base}/{found[-1]}" if found else None


def chunk_ids(spark: SparkSession, base: str) -> list[int]:
    return [int(n.removeprefix("chunk=")) for n in _listed(spark, base) if n.startswith("chunk=")]


def read_csv(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """A CSV file in its declared encoding, types inferred over all of it; a byte-order mark is dropped.

    cp1252 needs spark.sql.legacy.javaCharsets, which ``asofkit.session`` sets.
    """
    return spark.read.csv(path, header=True, inferSchema=True, encoding="utf-8" if encoding == "utf-8-sig" else encoding)


def read_crosswalk(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file of a known schema; an absent one is an empty table."""
    head, _, name = path.rpartition("/")
    if name not in _listed(spark, head):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).csv(path, header=True)


def json_lists(spark: SparkSession, path: str, lists: Sequence[str]) -> dict[str, DataFrame]:
    """One JSON object's lists as a table each; absent ones are left out."""
    doc = spark.read.json(path, multiLine=True)
    return {n: doc.select(F.inline(n)) for n in lists if n in doc.columns}


def read_chunks(spark: SparkSession, base: str, schema: str) -> DataFrame:
    """The records of all chunks, one JSON object a line; blank lines are skipped, broken ones raise."""
    lines = spark.read.text(f"{base}/chunk=*/*").where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_raw(spark: SparkSession, base: str) -> DataFrame:
    """path, body and meta of raw captures under ``base``, decompressed and checked against their digests.

    The metadata lies beside each body as meta.json; a missing or broken one counts as absent, and
    then nothing can be checked. A body of another digest raises when it is read.
    """
    bodies = spark.read.format("binaryFile").option("pathGlobFilter", "data.*").option("recursiveFileLookup", "true").load(base)
    metas = spark.read.format("binaryFile").option("pathGlobFilter", "meta.json").option("recursiveFileLookup", "true").load(base)
    folder = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("source", "endpoint", "season", "url", "fetched_at", "sha256", "content_type")] + [T.StructField("params", T.MapType(T.StringType(), T.StringType()))])
    meta = metas.select(folder("path").alias("folder"), F.from_json(F.col("content").cast("string"), schema).alias("meta"))

    def unpack(frames):
        for pdf in frames:
            pdf["body"] = [gzip.decompress(b) if b[:2] == b"\x1f\x8b" else b for b in pdf["content"]]
            pdf["digest"] = [hashlib.sha256(b).hexdigest() for b in pdf["body"]]
            yield pdf[["path", "body", "digest"]]

    read = bodies.select("path", "content").mapInPandas(unpack, "path string, body binary, digest string")
    joined = read.withColumn("folder", folder("path")).join(meta, "folder", "left")
    wrong = F.col("meta.sha256").isNotNull() & (F.col("meta.sha256") != F.col("digest"))
    return joined.select("path", F.when(wrong, F.raise_error(F.concat(F.lit("digest differs: "), "path")).cast("binary")).otherwise(F.col("body")).alias("body"), "meta")


def picks(records: DataFrame) -> DataFrame:
    """One row for each pick of a record, with the record's entry, event and whether it came too late."""
    return records.select("entry", "event", "fetched_at", F.coalesce("contaminated", F.lit(False)).alias("contaminated"), F.inline("payload.picks"))


def rating_date(params_date: str, as_of: str):
    """The date of a rating, from its parameters or else from the capture; a malformed one raises."""
    given = F.col(params_date)
    parsed = F.try_to_date(given, "yyyy-MM-dd")
    return F.when(given.isNotNull() & parsed.isNull(), F.raise_error(F.concat(F.lit("malformed date: "), given)).cast("date")).otherwise(F.coalesce(parsed, F.to_date(as_of_time(as_of))))


def extract_seasons(archive: str, seasons: Sequence[str], names: Sequence[str]) -> dict[str, dict[str, bytes]]:
    """The named files of each season's folder in a tar.gz; a missing folder raises, a missing file is left out."""
    import tarfile

    out: dict[str, dict[str, bytes]] = {s: {} for s in seasons}
    folders = set()
    with tarfile.open(archive, "r:gz") as tar:
        for m in tar:
            parts = m.name.split("/")
            for s in seasons:
                if s in parts:
                    folders.add(s)
                    rest = "/".join(parts[parts.index(s) + 1 :])
                    if m.isfile() and rest in names:
                        out[s][rest] = tar.extractfile(m).read()
    if lost := sorted(set(seasons) - folders):
        raise FileNotFoundError(f"{archive} has no folder for {lost}")
    return out


def as_text(body: bytes, encoding: str) -> str:
    """A body in its declared encoding; utf-8-sig drops a byte-order mark, a wrong encoding raises."""
    return body.decode(encoding)
