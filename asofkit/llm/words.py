"""Words and word shingles of whole texts, batch-wise."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc


def slices(batch: pa.RecordBatch, text: int, rows: int = 1000, size: int = 4_000_000):
    """Parts of a batch with at most so many rows, and so many bytes of text beyond their first row."""
    n = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(n)
    at = 0
    while at < len(n):
        stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right"))
        stop = min(max(stop, at + 1), at + rows, len(n))
        yield batch.slice(at, stop - at)
        at = stop


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words, A-Z in lower case, one after another, and each text's first place (n + 1 offsets)."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    full = pc.binary_length(values).to_numpy(zero_copy_only=False) > 0  # an empty text gives one empty word
    if not full.all():
        offsets = np.r_[0, np.cumsum(full)][offsets]
        values = values.filter(pa.array(full))
    return values, offsets


def first_of_runs(a: np.ndarray) -> np.ndarray:
    return np.r_[True, a[1:] != a[:-1]] if len(a) else np.zeros(0, bool)


def ranks(a: np.ndarray) -> np.ndarray:
    """Dense 32-bit numbers of the values, equal for equal ones."""
    order = np.argsort(a, kind="stable")
    out = np.empty(len(a), np.int32)
    out[order] = np.cumsum(first_of_runs(a[order]), dtype=np.int32) - np.int32(1)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them (the splitmix64 finaliser)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Shingles:
    """The distinct shingles of some texts: doc (place of the text, ascending), id and hash."""

    n_texts: int
    doc: np.ndarray
    id: np.ndarray  # equal if and only if the shingles are, within this object
    hash: np.ndarray  # the same in all tasks

    @property
    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_texts)


def shingle(texts: pa.Array, width: int, hashes: bool = True) -> Shingles:
    """Distinct shingles of ``width`` words; a text of fewer words has its whole sequence as one."""
    values, offsets = split_words(texts)
    coded = values.dictionary_encode()
    del values
    # An Arrow array of texts has fewer than 2^31 words, so places and numbers fit 32 bits.
    v = len(coded.dictionary) + 1
    padded = np.zeros(len(coded) + width, np.int32)
    padded[: len(coded)] = coded.indices.to_numpy()
    padded[: len(coded)] += 1  # 0 stands for no word
    words = np.r_[np.uint64(0), pd.util.hash_array(np.array(coded.dictionary.to_pylist() or [""], object), categorize=False)] if hashes else None
    del coded
    n_texts, lengths = len(offsets) - 1, np.diff(offsets)
    n = np.where(lengths == 0, 0, np.maximum(lengths - width + 1, 1))
    doc = np.repeat(np.arange(n_texts, dtype=np.int32), n)
    first = np.arange(n.sum(), dtype=np.int32) + np.repeat((offsets[:-1] - (np.cumsum(n) - n)).astype(np.int32), n)
    stop = offsets[1:].astype(np.int32)[doc]
    acc, h, reach = np.zeros(len(first), np.int64), np.zeros(len(first) if hashes else 0, np.uint64), 1
    for j in range(width):
        at = np.where(first + np.int32(j) < stop, padded[first + np.int32(j)], np.int32(0))
        if reach * v >= 1 << 62:
            acc = ranks(acc).astype(np.int64)
            reach = int(acc.max(initial=0)) + 1
        acc *= v
        acc += at
        reach *= v
        if hashes:
            h = mix(h + np.uint64(0x9E3779B97F4A7C15)) + words[at]
    del first, stop, at, padded
    ids = ranks(acc)
    del acc
    key = doc * np.int64(int(ids.max(initial=0)) + 1) + ids
    order = np.argsort(key, kind="stable")
    order = order[first_of_runs(key[order])]
    del key
    return Shingles(n_texts, doc[order], ids[order], mix(h[order]) if hashes else h)
