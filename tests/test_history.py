"""A stream of captures gives each snapshot once, also after a restart, a replay and a second capture."""

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from asofkit.streaming import snapshots

SCHEMA = T.StructType([T.StructField("player_id", T.LongType()), T.StructField("price", T.LongType())])


def put(base, as_of, name, *rows):
    d = base / "in" / f"as_of={as_of}"
    d.mkdir(parents=True, exist_ok=True)
    (d / name).write_text("".join(json.dumps({"player_id": p, "price": v}) + "\n" for p, v in rows))


def run(spark, base, checkpoint="ck", **more):
    s = snapshots.captures(spark, str(base / "in"), SCHEMA, files_per_batch=1).drop("as_of")
    snapshots.write_history(s, str(base / "out"), str(base / checkpoint), ["player_id"], **more).awaitTermination()


def found(spark, base, late=False):
    rows = snapshots.history(spark, str(base / "out"), late).select("player_id", F.date_format("as_of_ts", "MM-dd").alias("at"), "price")
    return sorted((tuple(r) for r in rows.collect()), key=repr)


def test_each_snapshot_once(spark, tmp_path):
    put(tmp_path, "2025-03-01T00-00-00Z", "a.json", (1, 50), (2, 60), (2, 60), (None, 7))
    put(tmp_path, "2025-03-02T00-00-00Z", "a.json", (1, 50), (2, None))
    run(spark, tmp_path)
    first = [(1, "03-01", 50), (1, "03-02", 50), (2, "03-01", 60), (2, "03-02", None)]
    rows = lambda late=False: [r for r in found(spark, tmp_path, late) if r[0] is not None]
    key = lambda rs: sorted(rs, key=repr)
    assert key(rows()) == key(first)
    # The same captures again under other names, one new value, and rows of long before.
    put(tmp_path, "2025-03-01T00-00-00Z", "b.json", (1, 50), (2, 60), (None, 7))
    put(tmp_path, "2025-03-02T00-00-00Z", "b.json", (2, 61))
    put(tmp_path, "2024-12-01T00-00-00Z", "a.json", (1, 40))
    run(spark, tmp_path)
    assert key(rows()) == key([*first, (2, "03-02", 61)]) and rows(True) == [(1, "12-01", 40)]
    # A new checkpoint reads everything again and adds nothing, as all is known by its digest; nor does a batch that is replayed.
    run(spark, tmp_path, "ck2")
    assert key(rows()) == key([*first, (2, "03-02", 61)])


def test_a_batch_without_commit_is_replayed(spark, tmp_path):
    put(tmp_path, "2025-03-01T00-00-00Z", "a.json", (1, 50))
    run(spark, tmp_path)
    put(tmp_path, "2025-03-02T00-00-00Z", "a.json", (1, 51))
    run(spark, tmp_path)
    # As after a failure between the rows of the last batch and its commits, here and in the checkpoint.
    last = sorted((tmp_path / "ck/commits").glob("[0-9]*"))[-1]
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    gone = next(p for p in (tmp_path / "out/commits").iterdir() if p.name.endswith(f"-{last.name}"))
    gone.rename(tmp_path / "gone")
    assert found(spark, tmp_path) == [(1, "03-01", 50)]
    run(spark, tmp_path)
    assert found(spark, tmp_path) == [(1, "03-01", 50), (1, "03-02", 51)]
