"""Best-fit packing with exact complements of one, two and three lengths."""

from __future__ import annotations

import bisect
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, release, table
from .tokens import default_path, encode, forget
from .words import slices


def exact_complement(count: np.ndarray, gap: int, pieces: int) -> tuple[int, ...] | None:
    """So many available lengths (one to three) that sum to ``gap``, or None.

    The sums are looked up by their own value in an index of the lengths: a single by ``gap``, a
    pair by the complement of its larger length, a triple by a pair in what its largest leaves.
    Longer lengths come first, as they are the harder ones to place elsewhere.
    """
    if pieces == 1:
        return (gap,) if count[gap] > 0 else None

    def pair(total: int, most: int) -> tuple[int, int] | None:
        high = np.arange(min(most, total - 1), (total - 1) // 2, -1)
        ok = (count[high] > 0) & (count[total - high] > 0) & ((2 * high != total) | (count[high] > 1))
        at = int(np.argmax(ok)) if len(ok) else 0
        return (int(high[at]), int(total - high[at])) if len(ok) and ok[at] else None

    if pieces == 2:
        return pair(gap, gap)
    for a in np.flatnonzero(count[: max(gap - 1, 0)])[::-1].tolist():
        if 3 * a < gap:
            break
        count[a] -= 1
        rest = pair(gap - a, a)
        count[a] += 1
        if rest:
            return (a, *rest)
    return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths in them, how many such sequences), from how often each length occurs.

    Works on the counts alone, so its cost depends on the capacity and not on the input. Lengths
    above half the capacity need a sequence each; their gaps are filled exactly by one other
    length while that is possible anywhere, then by two, then by three, as many times as the
    availability counts allow. The others then go, longest first, into the open sequence with the
    smallest gap that holds them; where none does, they are completed exactly by others if
    possible, or else open a sequence.
    """
    count = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        count[n] = c
    out: list[tuple[tuple[int, ...], int]] = []
    open_: dict[int, list[list]] = {}  # gap: [lengths, how many]
    gaps: list[int] = []

    def complete(n: int, pieces: int) -> bool:
        """Make as many exact sequences of n and so many other pieces, all alike, as can be."""
        count[n] -= 1
        fill = exact_complement(count, capacity - n, pieces)
        count[n] += 1
        if fill is None:
            return False
        need = Counter((n, *fill))
        times = int(min(count[x] // c for x, c in need.items()))
        out.append(((n, *fill), times))
        for x, c in need.items():
            count[x] -= c * times
        return True

    def put(gap: int, lengths: tuple[int, ...], times: int) -> None:
        if not gap:
            out.append((lengths, times))
            return
        if gap not in open_:
            open_[gap] = []
            bisect.insort(gaps, gap)
        open_[gap].append([lengths, times])

    if count[capacity]:
        out.append(((capacity,), int(count[capacity])))
        count[capacity] = 0
    for pieces in (1, 2, 3):
        for n in range(capacity - 1, capacity // 2, -1):
            while count[n] > 0 and complete(n, pieces):
                pass
    for n in range(capacity - 1, 0, -1):
        while count[n] > 0:
            at = bisect.bisect_left(gaps, n)
            if at == len(gaps):
                if any(complete(n, pieces) for pieces in (1, 2, 3)):
                    continue
                per = capacity // n
                new = (int(count[n]) // per, per) if count[n] >= per else (1, int(count[n]))
                put(capacity - new[1] * n, (n,) * new[1], new[0])
                count[n] -= new[0] * new[1]
                continue
            gap = gaps[at]
            lengths, times = open_[gap].pop()
            used = int(min(count[n], times))
            if times > used:
                open_[gap].append([lengths, times - used])
            if not open_[gap]:
                del open_[gap]
                gaps.pop(at)
            put(gap - n, (*lengths, n), used)
            count[n] -= used
    out.extend((lengths, times) for found in open_.values() for lengths, times in found)
    return out


def spread(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """The plan as sorted runs: numbers first, first + 1, ... of a length go to consecutive sequences at an offset."""
    given: Counter[int] = Counter()
    rows = []
    sequence = 0
    for lengths, times in patterns:
        offset = 0
        for n in lengths:
            rows.append((n, given[n], sequence, offset))
            given[n] += times
            offset += n
        sequence += times
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 4)
    return {"key": (a[:, 0] << 44) | a[:, 1], "first": a[:, 1], "sequence": a[:, 2], "offset": a[:, 3]}


def pieces(docs: DataFrame, capacity: int, path: str, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and ids of each document's token pieces."""

    def cut(batches):
        for batch in batches:
            for b in slices(batch, 1):
                ids, place = encode(b.column(1), path)
                doc, piece, start, length, crc = [], [], [], [], []
                for i, d in enumerate(b.column(0).to_pylist()):
                    own = np.append(ids[place[i] : place[i + 1]], np.uint32(end_id)).astype("<u4")
                    for p, s in enumerate(range(0, len(own), capacity)):
                        x = own[s : s + capacity]
                        doc.append(d)
                        piece.append(p)
                        start.append(s)
                        length.append(len(x))
                        crc.append(zlib.crc32(x.tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )
        forget()
        release()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def pack(docs: DataFrame, capacity: int = 2048, path: str | None = None) -> DataFrame:
    """Pack all documents into few sequences of at most ``capacity`` tokens.

    Only documents longer than ``capacity`` are cut. The plan is made from the counts of the at
    most ``capacity`` lengths; each piece then takes its place by its number among the pieces of
    its length, which is found without bringing them together. Null texts are empty: the end id
    alone. Very long texts are cut into pieces as any text above ``capacity``. Null ids, repeated rows and extra columns are ordinary; an empty table packs to none.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id and offset.
    """
    path = path or default_path()
    ranked = numbered(pieces(docs, capacity, path), "length", "number", "packing")
    counts = {r["length"]: r["count"] for r in ranked.groupBy("length").count().collect()}  # at most `capacity` rows
    runs = spread(plan(counts, capacity))

    def assign(frames):
        for pdf in frames:
            n, k = pdf["length"].to_numpy(), pdf.pop("number").to_numpy()
            at = np.searchsorted(runs["key"], (n << 44) | k, side="right") - 1
            yield pdf.assign(sequence_id=runs["sequence"][at] + k - runs["first"][at], offset=runs["offset"][at])

    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "number"]
    out = ranked.select(columns).mapInPandas(assign, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
