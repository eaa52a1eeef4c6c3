"""Phrases whose words occur together more often than their parts suggest, by language.

Phrases are counted level by level. A phrase of n words can only be frequent if its first and its
last n - 1 words are (Apriori), so blocks of documents send no others. What they send meets in shards of
the phrases' hash; there a minimal perfect hash gives every phrase that may be frequent a slot, the
counts of each block become an array over the slots, and these arrays are summed pairwise. The
slot is the phrase's number from then on.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, drop_shuffles, materialise, release, table
from .katz import grow, shrink
from .words import first_of_runs, mix, slices

#: What ends a piece; no word holds one of these, so one can stand for the break between pieces.
BREAK = r"[.,;:!?\x0A-\x0D]"
#: Bytes of text in a block, and words whose phrases meet in one shard, about.
BLOCK_BYTES, SHARD_WORDS = 5_000_000, 1_000_000


class PerfectHash:
    """A minimal perfect hash: n different 64-bit keys have the slots 0 to n - 1.

    Keys that meet no other one in a table of twice their number take a slot; the others go on to
    the next, smaller table. A key that it was not built for has any slot or -1, so users
    compare it with the key stored for the slot.
    """

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0
        while len(keys):
            at = self._place(keys, len(self.levels), 2 * len(keys) + 1)
            alone = np.bincount(at, minlength=2 * len(keys) + 1) == 1
            self.levels.append((alone, np.cumsum(alone) - 1 + self.size))
            self.size += int(alone.sum())
            keys = keys[~alone[at]]

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(size)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot, rest = np.full(len(keys), -1), np.arange(len(keys))
        for level, (alone, rank) in enumerate(self.levels):
            at = self._place(keys[rest], level, len(alone))
            hit = alone[at]
            slot[rest[hit]] = rank[at[hit]]
            rest = rest[~hit]
        return slot


def tree_sum(arrays: list[np.ndarray]) -> np.ndarray:
    while len(arrays) > 1:
        arrays = [a + b for a, b in zip(arrays[::2], arrays[1::2])] + ([arrays[-1]] if len(arrays) % 2 else [])
    return arrays[0]


def slot_counts(hashes: Callable[[int], np.ndarray], same: Callable[[np.ndarray, np.ndarray], np.ndarray], n: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count keys by slot. ``n`` has an array of counts for each sender; the keys lie one after another.

    Keys are first counted in hashed bins, which can only be too high, and those in bins below
    ``least`` go. ``hashes(seed)`` hashes all keys; ``same(a, b)`` compares the keys at places a with those
    at b. Where two different keys have one hash, the next seed is tried.

    Returns for each key its slot (-1: not frequent), the counts by slot, and the place of each slot's key.
    """
    ends = np.cumsum([len(x) for x in n])
    total = int(ends[-1]) if len(ends) else 0
    bins = (1 << max(total, 1).bit_length() + 1) - 1
    h = hashes(0)
    bin_of = (h >> np.uint64(20)).astype(np.int64) & bins
    kept = np.flatnonzero(np.bincount(bin_of, np.concatenate(n) if n else None, bins + 1)[bin_of] >= least) if total else np.empty(0, np.int64)
    for seed in range(64):
        own = (h if seed == 0 else hashes(seed))[kept]
        mph = PerfectHash(np.unique(own))
        slot = mph(own)
        stored = np.empty(mph.size, np.int64)
        stored[slot[::-1]] = kept[::-1]
        if same(kept, stored[slot]).all():
            break
    else:
        raise RuntimeError("no seed tells the keys apart")
    out = np.full(total, -1)
    out[kept] = slot
    arrays = []
    for start, end, x in zip(np.r_[0, ends[:-1]], ends, n):
        mine = out[start:end]
        arrays.append(np.bincount(mine[mine >= 0], x[mine >= 0], mph.size).astype(np.int64))  # doubles are exact here: a block's counts are small
    counts = tree_sum(arrays) if arrays else np.zeros(0, np.int64)
    out[kept[counts[slot] < least]] = -1
    return out, counts, stored


def _text_array(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.r_[0, np.cumsum(lengths)].astype(np.int32)
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes()))


def _bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text array as its bytes and its lengths."""
    words = pa.concat_arrays([words]).cast(pa.string())
    lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int32)
    first = np.frombuffer(words.buffers()[1], np.int32)[words.offset]
    data = words.buffers()[2]
    return np.frombuffer(data, np.uint8, int(lengths.sum()), int(first)) if data is not None else np.empty(0, np.uint8), lengths


def _word_hash(words: pa.Array, seed: int = 0) -> np.ndarray:
    key = f"{seed:016d}" if seed else "0123456789123456"  # pandas' default key, and others
    return pd.util.hash_array(np.array(words.to_pylist() or [""], object), hash_key=key, categorize=False)[: len(words)]


def blocks(docs: DataFrame) -> DataFrame:
    """Documents in blocks: their words as codes, and the block's different words by language in the order of their hash."""

    def work(batches):
        pid, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for b in slices(batch, 1, rows=1 << 30, size=BLOCK_BYTES):
                langs = pc.fill_null(b.column(0), "und").dictionary_encode()
                cut = pc.replace_substring_regex(pc.ascii_lower(pc.fill_null(b.column(1), "")), BREAK, " . ")
                lists = pc.ascii_split_whitespace(cut)
                offsets = lists.offsets.to_numpy().astype(np.int64)
                coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
                size = np.diff(offsets)
                del lists, cut
                words = coded.dictionary
                empty = pc.or_(pc.equal(words, ""), pc.equal(words, ".")).to_numpy(zero_copy_only=False)
                v = max(len(words), 1)
                lang = np.repeat(langs.indices.to_numpy().astype(np.int64), size)
                code = coded.indices.to_numpy().astype(np.int64)
                real = ~empty[code]
                kinds, at = np.unique(lang[real] * v + code[real], return_inverse=True)
                own, of_lang = words.take(pa.array(kinds % v)), kinds // v
                own = pc.binary_join_element_wise(langs.dictionary.take(pa.array(of_lang)), own, "\n")  # the last line break parts them
                h = _word_hash(own)
                order = np.argsort(h, kind="stable")
                place = np.empty(len(order), np.int32)
                place[order] = np.arange(len(order))
                # Texts end like pieces do: each has a break after its last word.
                tokens = np.full(len(code) + len(size), -1, np.int32)
                tokens[np.flatnonzero(real) + np.repeat(np.arange(len(size)), size)[real]] = place[at]
                counts = np.bincount(at, minlength=len(kinds))[order]
                data, lengths = _bytes_of(own.take(pa.array(order)))
                total = np.bincount(lang[real], minlength=len(langs.dictionary))
                row = [[pid << 32 | number], [langs.dictionary.to_pylist()], [total.tolist()], [shrink(tokens)], [shrink(data, lengths, counts, h[order].view(np.int64))]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kind)], names=["block", "langs", "n", "tokens", "words"])
                number += 1
                release()

    kind = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
    return docs.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(work, "block long, langs array<string>, n array<long>, tokens binary, words binary")


def _by_shard(h: np.ndarray, shards: int) -> Iterator[tuple[int, int, int]]:
    """The shards of ascending hashes, and each one's part."""
    shard = ((h >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
    at = np.flatnonzero(first_of_runs(shard))
    yield from zip(shard[at].tolist(), at.tolist(), np.r_[at[1:], len(h)].tolist())


def _grams(tokens: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's different phrases one word longer, by hash: left and right part, count and hash; and where each is met."""
    m = max(len(numbers), 1)
    where = np.flatnonzero((tokens[:-1] >= 0) & (tokens[1:] >= 0))
    kinds, at = np.unique(tokens[where].astype(np.int64) * m + tokens[where + 1], return_inverse=True)
    left, right = numbers[kinds // m], numbers[kinds % m]
    h = _pair_hash(left, right, 0)
    order = np.lexsort((right, left, h))
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order))
    return left[order], right[order], np.bincount(at, minlength=len(kinds))[order], h[order], where, place[at]


def _pair_hash(left: np.ndarray, right: np.ndarray, seed: int) -> np.ndarray:
    return mix(mix(left.astype(np.uint64) + np.uint64(seed * 0xD1342543DE82EF95 % (1 << 64))) + right.astype(np.uint64))


_ANSWER = "block long, reply binary, number long, left long, right long, key string, n long"


def _answer(shard: int, blocks: list[int], starts: list[int], slot: np.ndarray, counts: np.ndarray, sizes: list[int], least: int, **stored) -> pd.DataFrame:
    """Replies to the blocks (places of frequent phrases, and their numbers), and the frequent phrases."""
    base, replies, at = shard << 32, [], 0
    for block, start, size in zip(blocks, starts, sizes):
        own = slot[at : at + size]
        hit = np.flatnonzero(own >= 0)
        if len(hit):
            replies.append((block, shrink((start + hit).astype(np.int32), base + own[hit])))
        at += size
    often = np.flatnonzero(counts >= least)
    found = pd.DataFrame({"number": base + often, "n": counts[often], **{k: f(often) for k, f in stored.items()}})
    out = pd.concat([pd.DataFrame(replies, columns=["block", "reply"]), found]).reindex(columns=["block", "reply", "number", "left", "right", "key", "n"])
    release()
    return out.astype({c: "Int64" for c in ("block", "number", "left", "right", "n")}).astype({"reply": object, "key": object})


def _count_words(made: DataFrame, shards: int, least: int) -> DataFrame:
    def ask(frames):
        for pdf in frames:
            for r in pdf.itertuples():
                data, lengths, counts, h = grow(r.words)
                ends = np.r_[0, np.cumsum(lengths)]
                for shard, a, b in _by_shard(h.view(np.uint64), shards):
                    yield pd.DataFrame({"shard": [shard], "block": [r.block], "start": [a], "sent": [shrink(data[ends[a] : ends[b]], lengths[a:b], counts[a:b])]})
                release()

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        parts = [grow(x) for x in pdf["sent"]]
        words = pa.concat_arrays([_text_array(d, size) for d, size, _ in parts])
        n = [c for _, _, c in parts]
        slot, counts, at = slot_counts(lambda seed: _word_hash(words, seed), lambda a, b: pc.equal(words.take(pa.array(a)), words.take(pa.array(b))).to_numpy(zero_copy_only=False), n, least)
        return _answer(int(pdf["shard"].iat[0]), pdf["block"].tolist(), pdf["start"].tolist(), slot, counts, [len(c) for c in n], least, key=lambda s: words.take(pa.array(at[s])).to_pylist())

    return made.select("block", "words").mapInPandas(ask, "shard long, block long, start long, sent binary").groupBy("shard").applyInPandas(answer, _ANSWER)


def _count_grams(ready: DataFrame, shards: int, least: int) -> DataFrame:
    def ask(frames):
        for pdf in frames:
            for r in pdf.itertuples():
                left, right, counts, h, _, _ = _grams(*grow(r.data))
                for shard, a, b in _by_shard(h, shards):
                    yield pd.DataFrame({"shard": [shard], "block": [r.block], "start": [a], "sent": [shrink(left[a:b], right[a:b], counts[a:b].astype(np.int32))]})
                release()

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        parts = [grow(x) for x in pdf["sent"]]
        left, right = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        n = [p[2] for p in parts]
        slot, counts, at = slot_counts(lambda seed: _pair_hash(left, right, seed), lambda a, b: (left[a] == left[b]) & (right[a] == right[b]), n, least)
        of = {"left": lambda s: left[at[s]], "right": lambda s: right[at[s]]}
        return _answer(int(pdf["shard"].iat[0]), pdf["block"].tolist(), pdf["start"].tolist(), slot, counts, [len(c) for c in n], least, **of)

    return ready.mapInPandas(ask, "shard long, block long, start long, sent binary").groupBy("shard").applyInPandas(answer, _ANSWER)


def _take_in(blocks: DataFrame, counted: DataFrame, words: bool) -> DataFrame:
    """Blocks with the frequent phrases of the level that was counted; blocks without any go."""

    def work(mine: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(replies):
            return pd.DataFrame({"block": [], "data": []})
        r = next(mine.itertuples())
        if words:
            tokens = grow(r.data)[0]
        else:
            old, numbers = grow(r.data)
            *_, where, met = _grams(old, numbers)
            tokens = np.full(len(old), -1, np.int32)
            tokens[where] = met
        parts = [grow(x) for x in replies["reply"]]
        code, number = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        to = np.full(max(int(tokens.max(initial=-1)), int(code.max())) + 2, -1, np.int32)  # its last place is that of -1
        to[code] = np.arange(len(code))
        release()
        return pd.DataFrame({"block": [r.block], "data": [shrink(to[tokens], number)]})

    replies = counted.where("reply is not null").select(F.col("block").alias("of"), "reply")
    return blocks.groupBy("block").cogroup(replies.groupBy("of")).applyInPandas(work, "block long, data binary")


def phrases(docs: DataFrame, longest: int = 3, least: int = 10, keep: int = 2000, cover: int = 50) -> DataFrame:
    """The ``keep`` best phrases of 2 to ``longest`` words of each language.

    Texts are split into pieces and words as ``op13`` defines them, with A-Z in lower case. Phrases with at least ``least`` occurrences, overlaps
    included, are candidates. A candidate's score is the lowest, over its cuts into two parts, of floor(10^6 * a * a / (l * r)) with
    the occurrences of the phrase and of its parts. Candidates inside a longer one that has ``cover`` percent of their
    occurrences or more are left out.

    Null and empty texts have no words; a null language is ``und``. Very long texts are cut into
    words whole, each in one task. Repeated rows count each. Ids and extra columns are ignored; an empty table gives an empty
    result. Equal scores are ordered by occurrences, then by the phrase's bytes.

    Returns lang, rank, phrase, a, l, r, n (the language's words) and score.
    """
    spark = docs.sparkSession
    made = materialise(blocks(docs), "phrases-blocks")
    totals = made.select(F.explode(F.arrays_zip("langs", "n")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.n").alias("n"))
    shards = max(1, math.ceil((totals.agg(F.sum("n")).first()[0] or 0) / SHARD_WORDS))
    counted = materialise(_count_words(made, shards, least), "phrases-1")
    drop_shuffles(spark)
    ready = materialise(_take_in(made.select("block", F.col("tokens").alias("data")), counted, True), "phrases-ready")
    totals = materialise(totals, "phrases-totals")
    discard(made)
    cut = r"^((?s:.*))\n(.*)$"
    word = F.regexp_extract("key", cut, 2)
    known = counted.where("number is not null").select("number", F.regexp_extract("key", cut, 1).alias("lang"), word.alias("phrase"), word.alias("last"), F.array("n").alias("pre"), F.array("n").alias("suf"))
    levels = []
    for size in range(2, longest + 1):
        drop_shuffles(spark)
        counted = materialise(_count_grams(ready, shards, least), f"phrases-{size}")
        before = ready
        if size < longest:
            drop_shuffles(spark)
            ready = materialise(_take_in(ready, counted, False), "phrases-ready")
        discard(before)
        first = known.select(F.col("number").alias("left"), "lang", "phrase", "pre")
        second = known.select(F.col("number").alias("right"), F.col("last").alias("tail"), "suf")
        joined = counted.where("number is not null").select("number", "left", "right", "n").join(first, "left").join(second, "right")
        known = materialise(
            joined.select("number", "left", "right", "lang", F.concat_ws(" ", "phrase", "tail").alias("phrase"), F.col("tail").alias("last"), F.concat("pre", F.array("n")).alias("pre"), F.concat("suf", F.array("n")).alias("suf"), F.col("n").alias("a")),
            f"phrases-known-{size}",
        )
        levels.append(known.withColumn("cut", F.array_min(F.array(*[_cut(size, k) for k in range(1, size)]))))
    out = None
    for level, longer in zip(levels, [*levels[1:], None]):
        if longer is not None:
            inside = longer.select(F.explode(F.array_distinct(F.array("left", "right"))).alias("number"), F.col("a").alias("longer")).groupBy("number").agg(F.max("longer").alias("longer"))
            level = level.join(inside, "number", "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * cover))
        level = level.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
        out = level if out is None else out.unionByName(level)
    if out is None:
        raise ValueError("phrases have two words at least")
    # The best of each part first, so that no task ranks a whole language; so many parts that both steps take alike.
    best = [F.desc("score"), F.desc("a"), "phrase"]
    parts = max(1, math.ceil(2 * math.sqrt(sum(x.count() for x in levels) / keep)))
    dealt = out.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    some = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).where(F.col("rank") <= keep)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= keep)
    return ranked.join(F.broadcast(totals) if totals.count() <= 10_000 else totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _cut(size: int, k: int) -> Column:
    """The score of a phrase of ``size`` words cut after its kth, in exact decimals, and its parts' counts."""
    left, right = F.get("pre", F.lit(k - 1)), F.get("suf", F.lit(size - k - 1))
    score = F.expr(f"(cast(a as decimal(15, 0)) * cast(a as decimal(15, 0)) * cast(1000000 as decimal(7, 0))) div (cast(get(pre, {k - 1}) as decimal(18, 0)) * cast(get(suf, {size - k - 1}) as decimal(18, 0)))")
    return F.struct(score.alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(table(spark, sf_dir, "documents"))


#: The same rows by counting all phrases.
OP13_SQL = r"""
WITH w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (
    SELECT coalesce(lang, 'und') AS lang,
      unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)
), g AS (
  SELECT lang, ws[i] AS p, 1 AS k FROM (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)
  UNION ALL SELECT lang, ws[i] || ' ' || ws[i + 1], 2 FROM (SELECT lang, ws, unnest(range(1, len(ws))) AS i FROM w)
  UNION ALL SELECT lang, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2], 3 FROM (SELECT lang, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), c AS (
  SELECT lang, p, k, CAST(count(*) AS BIGINT) AS f FROM g GROUP BY ALL
), t AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM c WHERE k = 1 GROUP BY lang
), often AS (
  SELECT *, string_split(p, ' ') AS ws FROM c WHERE k > 1 AND f >= 10
), parts AS (
  SELECT o.lang, o.p, o.f AS a, x.f AS l, y.f AS r, cut, CAST((CAST(o.f AS HUGEINT) * o.f * 1000000) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM often) o
  JOIN c x ON x.lang = o.lang AND x.k = o.cut AND x.p = array_to_string(o.ws[1:o.cut], ' ')
  JOIN c y ON y.lang = o.lang AND y.k = o.k - o.cut AND y.p = array_to_string(o.ws[o.cut + 1:o.k], ' ')
), lowest AS (
  SELECT lang, p, a, arg_min(l, (score, cut)) AS l, arg_min(r, (score, cut)) AS r, min(score) AS score FROM parts GROUP BY lang, p, a
), inside AS (
  SELECT lang, p, max(f) AS longer FROM (
    SELECT lang, ws[1] || ' ' || ws[2] AS p, f FROM often WHERE k = 3 UNION ALL SELECT lang, ws[2] || ' ' || ws[3], f FROM often WHERE k = 3
  ) GROUP BY lang, p
), r AS (
  SELECT x.lang, CAST(row_number() OVER (PARTITION BY x.lang ORDER BY score DESC, a DESC, x.p) AS BIGINT) AS rank, x.p AS phrase, a, l, r, n, score
  FROM lowest x JOIN t ON t.lang = x.lang LEFT JOIN inside i ON i.lang = x.lang AND i.p = x.p
  WHERE i.longer IS NULL OR 100 * i.longer < 50 * a
)
SELECT * FROM r WHERE rank <= 2000
"""
