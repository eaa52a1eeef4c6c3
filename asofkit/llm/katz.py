"""Language-model scoring with a Katz backoff bigram model over whole texts.

The corpus is dealt into blocks of documents. Each block sends its distinct words, and then its
distinct word pairs, to where their counts are summed, and gets back the counts of what it sent.
So no table of the vocabulary or of the pairs is ever held in one place, and what is exchanged is
distinct within a block already.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, drop_shuffles, materialise, release, table
from .words import first_of_runs, mix, slices, split_words

#: Bytes of text in a block (a longer single text is a block of its own).
BLOCK_BYTES = 5_000_000
#: Tokens whose word pairs are summed in one bucket, about.
BUCKET_TOKENS = 600_000
#: Histories that are split over buckets are at most so many, so their totals can be sent to all.
SPLIT_HISTORIES = 100_000
#: Counts up to this are discounted.
DISCOUNTED = 5
#: Numbers that stand for the start of a text (as a history), and for words not in training.
START, UNKNOWN = -1, -2
#: A word that no text has: the end of a text.
END = "\n"


def shrink(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers or doubles as one compressed string; bytes of one weight stay together."""
    head = ";".join(f"{a.dtype.str}{len(a)}" for a in arrays).encode()
    body = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(len(head).to_bytes(4, "little") + head + body)


def grow(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(raw[:4], "little")
    at, out = 4 + n, []
    for kind in raw[4:at].decode().split(";"):
        d, size = np.dtype(kind[:3]), int(kind[3:])
        planes = np.frombuffer(raw, np.uint8, d.itemsize * size, at).reshape(d.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).view(d).reshape(size))
        at += d.itemsize * size
    return out


def discounts(n: list[int]) -> np.ndarray:
    """Katz's factors for counts 0 to DISCOUNTED (0 unused), from the numbers n[r] of types counted r times.

    Good-Turing estimates, scaled so that what they free is the mass of the types seen once. A
    factor that is not in (0, 1), as when a number is 0, becomes 1.
    """
    k, d = DISCOUNTED, np.ones(DISCOUNTED + 1)
    if not n[1]:
        return d
    common = (k + 1) * n[k + 1] / n[1]
    for r in range(1, k + 1):
        if n[r] and common != 1:
            x = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
            d[r] = x if 0 < x < 1 else 1.0
    return d


@dataclass
class Unigrams:
    tokens: int
    types: int
    factor: np.ndarray
    total: float  # tokens, or one more if nothing was discounted
    unknown: float

    @classmethod
    def of(cls, tokens: int, n: list[int], types: int) -> Unigrams:
        d = discounts(n)
        kept = tokens - sum((1 - d[r]) * r * n[r] for r in range(1, DISCOUNTED + 1))
        total = float(tokens) if kept < tokens - 1e-9 else tokens + 1.0
        return cls(tokens, types, d, total, 1 - kept / total)

    def p(self, c: np.ndarray) -> np.ndarray:
        """The probability of words of these training counts; all words of count 0 share one type."""
        return np.where(c > 0, self.factor[np.minimum(c, DISCOUNTED) * (c <= DISCOUNTED)] * c / self.total, self.unknown)


def fold_of(doc_id: int | None) -> int:
    """crc32 of the id as text, modulo 7; a row without id is in fold 0."""
    return 0 if doc_id is None else zlib.crc32(str(doc_id).encode()) % 7


def blocks(docs: DataFrame, held: int) -> DataFrame:
    """For each block a row with its documents and tokens, and a row for each distinct word with its training count."""

    def work(batches):
        pid, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for b in slices(batch, 1, rows=1 << 30, size=BLOCK_BYTES):
                ids = b.column(0).to_pylist()
                values, offsets = split_words(b.column(1))
                lengths = np.diff(offsets) + 1
                coded = values.dictionary_encode()
                size = len(coded.dictionary)
                ends = np.cumsum(lengths) - 1
                codes = np.full(int(lengths.sum()), size, np.int32)  # the end, where no word goes
                inner = np.ones(len(codes), bool)
                inner[ends] = False
                codes[inner] = coded.indices.to_numpy()
                train = np.array([fold_of(d) != held for d in ids])
                order = np.argsort(-np.bincount(codes, minlength=size + 1), kind="stable")
                place = np.empty(size + 1, np.int32)
                place[order] = np.arange(size + 1)
                codes = place[codes]
                counts = np.bincount(codes[np.repeat(train, lengths)], minlength=size + 1)
                words = pa.concat_arrays([coded.dictionary, pa.array([END])]).take(pa.array(order))
                name = pid << 32 | number
                number += 1
                n = size + 1
                none = lambda kind: pa.nulls(n, kind)
                names = ["block", "code", "word", "n", "ids", "data"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, name)), pa.array(np.arange(n, dtype=np.int32)), words, pa.array(counts), none(pa.list_(pa.int64())), none(pa.binary())], names=names
                )
                data = shrink(lengths.astype(np.int32), train.astype(np.int8), codes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.nulls(1, pa.int32()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([data])], names=names
                )
                release()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        work, "block long, code int, word string, n long, ids array<long>, data binary"
    )


@dataclass
class Block:
    """A block's tokens as pairs (history, word), and the distinct pairs that have a known history, by bucket."""

    lengths: np.ndarray
    train: np.ndarray
    count: np.ndarray  # of each token, in training
    asked: np.ndarray  # whether the token's history is known
    pair: np.ndarray  # for asked tokens, the place of their pair
    history: np.ndarray
    word: np.ndarray
    word_count: np.ndarray
    here: np.ndarray  # how often the pair occurs in the block's training part
    bucket: np.ndarray
    split: np.ndarray  # whether the pair's history lies in several buckets

    @classmethod
    def of(cls, data: bytes, vocabulary: bytes, n_train: int, buckets: int, split_above: int) -> Block:
        lengths, train, codes = grow(data)
        number, count = grow(vocabulary)
        codes = codes.astype(np.int64)
        v = len(number)
        first = np.cumsum(lengths) - lengths
        history = np.r_[0, codes[:-1]]
        history[first] = v
        known = np.r_[count > 0, n_train > 0]
        word = np.where(count > 0, np.arange(v), v)[codes]
        asked = known[history]
        key = history[asked] * (v + 1) + word[asked]
        order = np.argsort(key)
        starts = first_of_runs(key[order])
        group = np.cumsum(starts) - 1
        pair = np.empty(len(key), np.int64)
        pair[order] = group
        distinct = key[order][starts]
        trained = np.repeat(train.astype(bool), lengths)[asked]
        here = np.bincount(pair[trained], minlength=len(distinct))
        h, w = distinct // (v + 1), distinct % (v + 1)
        gh, gw = np.r_[number, START][h], np.r_[number, UNKNOWN][w]
        ch, cw = np.r_[count, n_train][h], np.r_[count, 0][w]
        parts = np.where(ch > split_above, -(-ch // max(split_above, 1)), 1).astype(np.uint64)
        bucket = ((mix(gh.view(np.uint64)) + mix(gw.view(np.uint64)) % parts) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((gw, gh, bucket))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return cls(lengths, train, count[codes], asked, back[pair], gh[order], gw[order], cw[order], here[order], bucket[order], (parts > 1)[order])


def request(block: Block):
    """bucket and the compressed pairs of each bucket that the block has."""
    at = np.flatnonzero(first_of_runs(block.bucket))
    for a, b in zip(at, np.r_[at[1:], len(block.bucket)]):
        h = block.history[a:b]
        yield int(block.bucket[a]), shrink(np.diff(h, prepend=0), block.word[a:b], block.word_count[a:b], block.here[a:b].astype(np.int32), block.split[a:b].astype(np.int8))


def total(requests: list[bytes], unigrams: Unigrams):
    """Sum one bucket's pairs over the blocks.

    Returns for each request its pairs' counts, and the histories in order; the counts of pairs by
    how often they occur; and per history its number, whether it is split, and its sums: C, the pairs counted 1 to
    DISCOUNTED times, the sum of the other counts, and the unigram mass of the words seen after it.
    """
    parts = [grow(r) for r in requests]
    h = np.concatenate([np.cumsum(p[0]) for p in parts])
    w = np.concatenate([p[1] for p in parts])
    cw = np.concatenate([p[2] for p in parts])
    n = np.concatenate([p[3] for p in parts]).astype(np.int64)
    hs = np.sort(h)
    hs = hs[first_of_runs(hs)]
    hi = np.searchsorted(hs, h)
    split = np.zeros(len(hs), bool)
    split[hi[np.concatenate([p[4] for p in parts]) > 0]] = True
    ws = np.sort(w)
    ws = ws[first_of_runs(ws)]
    key = hi * len(ws) + np.searchsorted(ws, w)
    order = np.argsort(key)
    start = np.flatnonzero(first_of_runs(key[order]))
    sums = np.add.reduceat(n[order], start)
    count = np.empty(len(n), np.int64)
    count[order] = np.repeat(sums, np.diff(np.r_[start, len(n)]))
    owner, c1 = hi[order][start], cw[order][start]
    seen = sums > 0
    owner, c1, c2 = owner[seen], c1[seen], sums[seen]
    stats = np.zeros((len(hs), DISCOUNTED + 3))
    stats[:, 0] = np.bincount(owner, c2, len(hs))
    for r in range(1, DISCOUNTED + 1):
        stats[:, r] = np.bincount(owner[c2 == r], minlength=len(hs))
    large = c2 > DISCOUNTED
    stats[:, -2] = np.bincount(owner[large], c2[large], len(hs))
    stats[:, -1] = np.bincount(owner, unigrams.p(c1), len(hs))
    ends = np.cumsum([len(p[0]) for p in parts])
    replies = [(count[e - len(p[0]) : e], hi[e - len(p[0]) : e]) for p, e in zip(parts, ends)]
    return replies, np.bincount(c2[c2 <= DISCOUNTED + 1], minlength=DISCOUNTED + 2), hs, split, stats


def backoff(stats: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Denominator and backoff weight of histories, so that each one's probabilities sum to 1.

    Where nothing was discounted the denominator is one more than the count, to leave some mass.
    """
    c = stats[:, 0]
    kept = stats[:, 1 : DISCOUNTED + 1] @ (d[1:] * np.arange(1, DISCOUNTED + 1)) + stats[:, -2]
    bottom = np.where(kept < c - 1e-9, c, c + 1)
    return bottom, (1 - kept / bottom) / (1 - stats[:, -1])


def score(docs: DataFrame, held: int = 2) -> DataFrame:
    """Score every whole text with a model of the documents outside fold ``held``.

    Words are runs without ASCII white space, A-Z in lower case; each text has one token more, its
    end. A pair seen in training has its discounted relative frequency; another one has the
    backoff weight of its history times the word's unigram probability, which for words not in
    training is that of one type standing for all of them. A history not in training backs off
    with weight 1. The pairs' counts lie in the shared folder by buckets of their history; a
    history with very many pairs is split over buckets.

    Null texts are empty and have one token. Rows without id are in training; repeated rows count
    each; extra columns are ignored; an empty table gives an empty result.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams) and
    score (log10 of the model's probability of the text).
    """
    spark = docs.sparkSession
    made = materialise(blocks(docs, held), "lm-blocks")
    words = made.where("word is not null").select("block", "code", "word", "n", F.monotonically_increasing_id().alias("row"))
    # A word's number is that of one of its rows. Counts are summed before they are shuffled and then
    # joined back, where AQE splits the rows of a word that all blocks have.
    types = materialise(words.groupBy("word").agg(F.min("row").alias("number"), F.sum("n").alias("c")).withColumn("end", F.col("word") == END), "lm-types")
    drop_shuffles(spark)
    known = materialise(words.select("block", "code", "word").join(types.select("word", "number", "c"), "word").select("block", "code", "number", "c"), "lm-words")
    drop_shuffles(spark)
    of = [F.count_if(F.col("c") == r) for r in range(1, DISCOUNTED + 2)]
    got = types.agg(F.sum("c"), F.count_if(F.col("c") > 0), F.sum(F.when(F.col("end"), F.col("c"))), *of).first()
    tokens, n_train = got[0] or 0, got[2] or 0
    unigrams = Unigrams.of(tokens, [0, *got[3:]], got[1])
    buckets = max(1, math.ceil(tokens / BUCKET_TOKENS))
    split_above = max(BUCKET_TOKENS // 2, tokens // SPLIT_HISTORIES)
    own_words = known.select(F.col("block").alias("of_block"), "code", "number", "c")
    tokens_of = made.where("ids is not null").select("block", "ids", "data")

    def prepare(data: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        words = words.sort_values("code")
        return data.assign(vocabulary=[shrink(words["number"].to_numpy(np.int64), words["c"].to_numpy(np.int64))])

    ready = materialise(
        tokens_of.groupBy("block").cogroup(own_words.groupBy("of_block")).applyInPandas(prepare, "block long, ids array<long>, data binary, vocabulary binary"), "lm-ready"
    )
    for x in (made, known, types):
        discard(x)
    drop_shuffles(spark)

    def ask(frames):
        for pdf in frames:
            for r in pdf.itertuples():
                for bucket, pairs in request(Block.of(r.data, r.vocabulary, n_train, buckets, split_above)):
                    yield pd.DataFrame({"bucket": [bucket], "block": [r.block], "pairs": [pairs]})
                release()

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        replies, n, hs, split, stats = total(pdf["pairs"].tolist(), unigrams)
        rows = []
        for block, (count, h) in zip(pdf["block"].tolist(), replies):
            own = h[first_of_runs(h)]
            rows.append((block, int(pdf["bucket"].iat[0]), shrink(count, *stats[own].T), None, None, None))
        rows.append((None, None, None, None, None, n.tolist()))
        rows.extend((None, None, None, int(hs[i]), stats[i].tolist(), None) for i in np.flatnonzero(split))
        release()
        return pd.DataFrame(rows, columns=["block", "bucket", "reply", "history", "stats", "n"])

    schema = "block long, bucket int, reply binary, history long, stats array<double>, n array<long>"
    asked = ready.select("block", "data", "vocabulary").mapInPandas(ask, "bucket int, block long, pairs binary")
    counted = materialise(asked.groupBy("bucket").applyInPandas(answer, schema), "lm-pairs")
    drop_shuffles(spark)
    n2 = counted.where("n is not null").select(*[F.sum(F.get("n", F.lit(r))) for r in range(DISCOUNTED + 2)]).first()
    factor = discounts([x or 0 for x in n2])
    sums = F.array(*[F.sum(F.get("stats", F.lit(i))) for i in range(DISCOUNTED + 3)])
    split = counted.where("history is not null").groupBy("history").agg(sums.alias("stats"))  # at most SPLIT_HISTORIES rows
    whole = {r["history"]: r["stats"] for r in split.collect()}
    history_of = np.array(sorted(whole), np.int64)
    stats_of = np.array([whole[h] for h in history_of.tolist()]).reshape(-1, DISCOUNTED + 3)

    def finish(data: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        r = next(data.itertuples())
        b = Block.of(r.data, r.vocabulary, n_train, buckets, split_above)
        replies = replies.sort_values("bucket")
        parts = [grow(x) for x in replies["reply"]]
        ends = np.cumsum([0, *(len(p[0]) for p in parts)])
        count = np.concatenate([p[0] for p in parts]) if parts else np.empty(0, np.int64)
        bottom, weight = np.empty(len(count)), np.empty(len(count))
        for p, a, e in zip(parts, ends[:-1], ends[1:]):
            stats = np.stack(p[1:], axis=1)
            new = first_of_runs(b.history[a:e])
            own = b.history[a:e][new]
            at = np.searchsorted(history_of, own)
            for i in np.flatnonzero((at < len(history_of)) & (np.r_[history_of, 0][np.minimum(at, len(history_of))] == own)):
                stats[i] = stats_of[at[i]]
            bo, we = backoff(stats, factor)
            place = np.cumsum(new) - 1
            bottom[a:e], weight[a:e] = bo[place], we[place]
        seen = count > 0
        d = np.where(count <= DISCOUNTED, factor[np.minimum(count, DISCOUNTED)], 1.0)
        p2 = np.where(seen, d * count / bottom, weight * unigrams.p(b.word_count))
        logs = np.log10(unigrams.p(b.count))
        logs[b.asked] = np.log10(p2)[b.pair]
        base = np.log10((b.count + 1) / (unigrams.tokens + unigrams.types + 1))
        first = np.cumsum(b.lengths) - b.lengths
        add = lambda x: np.add.reduceat(x, first)
        ids = r.ids
        release()
        return pd.DataFrame(
            {
                "doc_id": pd.array([None if x is None or x != x else int(x) for x in ids], "Int64"),
                "held_out": b.train == 0, "n_tokens": b.lengths.astype(np.int64), "n_known": add((b.count > 0).astype(np.int64)),
                "train_tokens": unigrams.tokens, "base_score": add(base), "score": add(logs),
            }
        )

    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    answers = counted.where("block is not null").select(F.col("block").alias("of_block"), "bucket", "reply")
    return ready.groupBy("block").cogroup(answers.groupBy("of_block")).applyInPandas(finish, out)


def op8_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
