"""Writing tables and captures."""

from __future__ import annotations

import gzip
import hashlib
import json
import math
import os
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, key: Sequence[str], single: bool = False) -> None:
    """Parquet in the order of a natural key, zstd-compressed; an unknown key column raises KeyError.

    Files are ranges of the key, so their statistics let scans skip; ``single`` is for small tables.
    """
    if lost := [k for k in key if k not in df.columns]:
        raise KeyError(f"no such columns to sort by: {lost}")
    out = df.coalesce(1).sortWithinPartitions(*key) if single else df.orderBy(*key)
    out.write.mode("overwrite").option("compression", "zstd").parquet(path)


#: Rows of a file, about.
FILE_ROWS = 5_000_000


def write_partitions(df: DataFrame, path: str, by: Sequence[str], key: Sequence[str], file_rows: int = FILE_ROWS) -> None:
    """Replace only the partitions that ``df`` has rows of.

    A partition's files are disjoint ranges of its key, each sorted, of about ``file_rows`` rows: rows are dealt by ranges of
    partition and key together, so one that holds most rows has many tasks and files.
    """
    parts = max(1, math.ceil(df.count() / file_rows))
    out = df.repartitionByRange(parts, *by, *key) if parts > 1 else df.coalesce(1)
    out.sortWithinPartitions(*by, *key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*by).parquet(path)


def write_crosswalk(df: DataFrame, path: str, key: Sequence[str]) -> None:
    """A small CSV table; lists become text joined by '; '."""
    flat = df.select(*[F.array_join(c, "; ").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])
    flat.coalesce(1).sortWithinPartitions(*key).write.mode("overwrite").csv(path, header=True)


def _put(path: Path, data: bytes) -> None:
    """Write a file whole or not at all."""
    path.parent.mkdir(parents=True, exist_ok=True)
    new = path.with_name(path.name + ".new")
    with open(new, "wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    new.replace(path)


def write_raw(base: Path, as_of: str, body: bytes, meta: Mapping, suffix: str = "json") -> Path | None:
    """Store a capture unless its digest equals the latest one's; the same body gives the same bytes."""
    digest = hashlib.sha256(body).hexdigest()
    known = sorted(base.glob("as_of=*"))
    if known:
        try:
            if json.loads((known[-1] / "meta.json").read_text()).get("sha256") == digest:
                return None
        except (OSError, ValueError):
            pass  # unreadable metadata counts as absent
    out = base / f"as_of={as_of}"
    packed = gzip.compress(body, mtime=0)
    _put(out / f"data.{suffix}.gz", packed)
    _put(out / "meta.json", json.dumps({**meta, "sha256": digest, "raw_bytes": len(body), "compressed_bytes": len(packed)}, sort_keys=True).encode())
    return out


def write_chunk(base: Path, chunk: int, records: Sequence[Mapping]) -> bool:
    """Store records as a chunk that isn't there yet; an existing one is never replaced, so captures resume."""
    out = base / f"chunk={chunk:04d}" / "data.ndjson.gz"
    if out.exists():
        return False
    _put(out, gzip.compress("".join(json.dumps(r, sort_keys=True) + "\n" for r in records).encode(), mtime=0))
    return True


def new_captures(found: DataFrame, stored: DataFrame, key: Sequence[str] = ("source", "endpoint", "season", "sha256")) -> DataFrame:
    """The captures whose body isn't stored yet."""
    return found.join(stored.select(*key).distinct(), list(key), "left_anti")


def markdown(df: DataFrame, limit: int | None = None) -> str:
    """A report's rows as a Markdown table: null as nothing, fractions with four places."""
    rows = (df if limit is None else df.limit(limit)).collect()
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(cell(v) for v in r) + " |" for r in rows)]) + "\n"


def section(df: DataFrame, top: int) -> str:
    """The first ``top`` rows as a table, and how many there are if these aren't all."""
    n = df.count()
    return (f"The first {top} of {n} rows.\n\n" if n > top else f"{n} rows.\n\n") + markdown(df, top)
