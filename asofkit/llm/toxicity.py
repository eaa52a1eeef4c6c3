"""Toxic passages by maximum-scoring segments over the log-odds of tokens."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table
from .words import slices

#: Tokens: runs of letters, compared in lower case.
TOKEN = re.compile(r"[^\W\d_]+")
#: Weight that each further passage loses when passages are taken together.
DECAY = 0.5


@dataclass(frozen=True)
class Model:
    """Words with their scores, what any other token costs, the share of toxic texts, and the extreme-value law."""

    scores: dict[str, float]
    drift: float
    rate: float
    scale: float  # lambda: the decay of scores' tail in clean texts
    level: float  # K: segments a token in clean texts

    def single(self, score: float, tokens: int) -> float:
        """The chance that a clean text of so many tokens has a segment of this score or more."""
        return -math.expm1(-self.level * tokens * math.exp(-self.scale * score))

    def chance(self, scores: list[float], tokens: int) -> float:
        """The chance of a clean text's being as extreme: the best of its first r segments together, each r paying for the choice."""
        if not scores:
            return 1.0
        best, total, log_level = 1.0, 0.0, math.log(self.level * tokens)
        for r, s in enumerate(sorted(scores, reverse=True), 1):
            total += self.scale * s - log_level
            if r == 1:
                p = self.single(s, tokens)
            elif total > 0:  # the tail of a sum of r normalised scores
                p = math.exp(min(0.0, -total + (r - 1) * math.log(total) - math.lgamma(r + 1) - math.lgamma(r)))
            else:
                p = 1.0
            best = min(best, p / ((1 - DECAY) * DECAY ** (r - 1)) if r < 1000 else 1.0)
        return best

    def score(self, chance: float) -> float:
        """The share of toxic ones expected among texts at least as extreme."""
        return self.rate / (self.rate + (1 - self.rate) * chance)


def segments(places: list[int], gains: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments in one pass: first token, last token, score.

    Tokens at ``places`` gain, all others cost ``drift``. Each gaining token opens a segment, which
    is joined with the nearest one that starts lower and ends lower. Every candidate keeps the place
    of the nearest one that starts lower, so the search never walks the same way twice.
    """
    stack: list[tuple[float, float, int, int, int]] = []  # sum before, sum after, first, last, nearest that starts lower
    total, at = 0.0, 0
    for place, gain in zip(places, gains):
        before = total - drift * (place - at)
        total, at = before + gain, place + 1
        low, first, top = before, place, len(stack) - 1
        while True:
            j = top
            while j >= 0 and stack[j][0] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= total:
                break
            low, first = stack[j][0], stack[j][2]
            del stack[j:]
            top = j - 1
        stack.append((low, total, first, place, j))
    return [(first, last, after - before) for before, after, first, last, _ in stack]


def _scan(text: str, model: Model) -> tuple[int, list[tuple[int, int, float]], list[float]]:
    """Number of tokens, segments by token place, and the gains."""
    words = TOKEN.findall(text)
    places, gains = [], []
    for i, w in enumerate(words):
        g = model.scores.get(w.lower())
        if g is not None:
            places.append(i)
            gains.append(g)
    return len(words), segments(places, gains, model.drift), gains


def _usable(doc_id: Column) -> Column:
    """Rows that labels may be learned from; a row without id has no label."""
    return doc_id.isNotNull() & ~held_out(doc_id)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def _log_odds(toxic: Column, clean: Column, rate: float, prior: float) -> Column:
    """Log-odds of texts with a word against all texts, under a Dirichlet prior of weight ``prior`` at the base rate."""
    share = (toxic + prior * rate) / (toxic + clean + prior)
    return F.log(share / (1 - share)) - math.log(rate / (1 - rate))


def _drift(rate: float, prior: float) -> float:
    """The log-odds of a word that a single toxic text has."""
    share = (1 + prior * rate) / (1 + prior)
    return math.log(share / (1 - share)) - math.log(rate / (1 - rate))


def _significant(counts: DataFrame, toxic: str, clean: str, rate: float, tests: int) -> Column:
    """Whether a word's share of toxic texts exceeds the base rate: by Chernoff's bound, all tests together err with a chance of 0.05."""
    t, c = counts[toxic].cast("double"), counts[clean].cast("double")
    evidence = t * F.log(t / ((t + c) * rate)) + F.when(c > 0, c * F.log(c / ((t + c) * (1 - rate)))).otherwise(0.0)
    return (t > (t + c) * rate) & (evidence >= math.log(max(tests, 1) / 0.05))


def _lexicon(counts: DataFrame, toxic: str, clean: str, rate: float, prior: float, words: int, tests: int) -> dict[str, float]:
    """Significant words with their log-odds less the drift, the highest first."""
    gain = _log_odds(F.col(toxic), F.col(clean), rate, prior) - _drift(rate, prior)
    got = counts.where(_significant(counts, toxic, clean, rate, tests)).select("word", gain.alias("gain")).where("gain > 0")
    return {r["word"]: r["gain"] for r in got.orderBy(F.desc("gain"), "word").limit(words).collect()}


def _root(drift: float, gains: Counter, tokens: int) -> float:
    """The positive solution of: the mean of exp(x * score) over clean tokens is 1; 1 where no token gains, and at most 1."""
    other = tokens - sum(gains.values())

    def excess(x: float) -> float:
        return (other * math.exp(-x * drift) + sum(n * math.exp(x * s) for s, n in gains.items())) / tokens - 1

    if not gains or excess(1.0) <= 0:
        return 1.0
    low, high = 1e-3, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return low


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 60_000, prior: float = 5.0, words: int = 50_000) -> Model:
    """Learn word scores from about ``sample_rows`` labelled documents, and the tail of scores in clean ones.

    Documents are chosen by a hash of their id among those with a label that aren't held out. Each
    different text counts once, as toxic if most of its labels are. Words that toxic texts have
    significantly often are then counted once for each different neighbour, on the side that has fewer of them,
    so that a passage that many texts share counts once, however often it was copied; they
    must be significant again, and these counts give their scores. At most ``words`` are kept.
    The tail is measured on clean texts of one half, with word scores of the other half.
    """
    labelled = labels.where(_usable(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_id")).agg((F.avg("toxic") >= 0.5).cast("int").alias("_toxic"))
    n = labelled.count()
    if n > sample_rows:  # the bound of what is broadcast
        labelled = labelled.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int((1 << 30) * sample_rows / n))
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    sample = texts.join(F.broadcast(labelled), "_id").groupBy("text").agg((F.avg("_toxic") >= 0.5).alias("toxic"))
    sample = materialise(sample.withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int")), "toxic-sample")

    def count(keys):
        """Adds up, for each key of a text once, the toxic and clean texts of each half."""

        def work(batches):
            for batch in batches:
                for b in slices(batch, 0):
                    found: dict = {}
                    for text, toxic, half in zip(*(c.to_pylist() for c in b.columns)):
                        for k in keys([w.lower() for w in TOKEN.findall(text)]):
                            found.setdefault(k, [0, 0, 0, 0])[2 * half + (not toxic)] += 1
                    words, places = zip(*found) if found else ((), ())
                    columns = [pa.array(words, pa.string()), pa.array(places, pa.int64()), *(pa.array([c[i] for c in found.values()], pa.int64()) for i in range(4))]
                    yield pa.RecordBatch.from_arrays(columns, names=["word", "place", *four])

        return sample.mapInArrow(work, "word string, place long, t0 long, c0 long, t1 long, c1 long")

    four = ("t0", "c0", "t1", "c1")
    both = lambda df: df.withColumn("t", F.expr("t0 + t1")).withColumn("c", F.expr("c0 + c1"))
    of = sample.agg(F.count("*"), F.count_if("toxic"), F.count_if(F.expr("half = 0")), F.count_if(F.expr("half = 0 and toxic"))).first()
    rate, rate0 = ((x + 0.5) / (y + 1) for x, y in ((of[1], of[0]), (of[3], of[2])))
    seen = materialise(both(count(lambda ws: {(w, 0) for w in ws}).groupBy("word").agg(*[F.sum(c).alias(c) for c in four]).where("t0 + t1 > 1")), "toxic-words")
    tests = seen.count()
    picked = seen.where(_significant(seen, "t", "c", rate, tests)).orderBy(F.desc("t"), "word").limit(words)
    wanted = frozenset(r["word"] for r in picked.select("word").collect())

    def neighbours(ws: list[str]) -> set[tuple[str, int]]:
        around = ["", *ws, ""]
        return {(w, side << 32 | crc32(around[i + 2 * side].encode())) for i, w in enumerate(ws) if w in wanted for side in (0, 1)}

    once = count(neighbours).groupBy("word", "place").agg(*[F.sum(c).alias(c) for c in four])
    once = both(once.groupBy("word", F.shiftright("place", 32).alias("side")).agg(*[F.count_if(F.col(c) > 0).alias(c) for c in four]))
    counts = materialise(once.groupBy("word").agg(*[F.min(c).alias(c) for c in (*four, "t", "c")]), "toxic-neighbours")
    scores, scores0 = _lexicon(counts, "t", "c", rate, prior, words, tests), _lexicon(counts, "t0", "c0", rate0, prior, words, tests)
    drift, drift0 = _drift(rate, prior), _drift(rate0, prior)
    trial = Model(scores0, drift0, rate0, 1.0, 1.0)

    def tail(batches):
        for batch in batches:
            tokens, found, gains = 0, 0, Counter()
            for text in batch.column(0).to_pylist():
                m, segs, g = _scan(text, trial)
                tokens += m
                found += len(segs)
                gains.update(round(x, 2) for x in g)
            yield pa.RecordBatch.from_pydict({"gain": [None, *gains], "n": [tokens, *gains.values()], "segments": [found, *[0] * len(gains)]}, pa.schema([("gain", pa.float64()), ("n", pa.int64()), ("segments", pa.int64())]))

    clean = sample.where("half = 1 and not toxic").select("text").mapInArrow(tail, "gain double, n long, segments long")
    got = {r["gain"]: (r["n"], r["segments"]) for r in clean.groupBy("gain").agg(F.sum("n").alias("n"), F.sum("segments").alias("segments")).collect()}  # gains of two digits: few
    tokens, found = got.pop(None, (0, 0))
    tokens = max(tokens, 1)
    return Model(scores, drift, rate, _root(drift0, Counter({g: n for g, (n, _) in got.items()}), tokens), (found + 1) / tokens)


def find(docs: DataFrame, model: Model, alpha: float = 0.05) -> DataFrame:
    """Score every whole text, and give its toxic passages of a chance up to ``alpha`` in a clean text.

    A text's score is the share of toxic ones expected among texts at least as extreme; a text
    without any gaining token has the base rate. Null and empty texts are such. A very long text
    is scanned whole, in time linear in its tokens. Equal texts have equal scores; repeated rows
    come out as often as they came in; a row without id is scored and not held out; extra columns
    are ignored; an empty table gives an empty result.

    Returns doc_id, held_out, score, predicted (1 from 0.7), tokens and passages (start and end in code points,
    score, chance).
    """

    def work(batches):
        names = ["doc_id", "held_out", "score", "predicted", "tokens", "passages"]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("chance", pa.float64())]))
        for batch in batches:
            score, size, passages = [], [], []
            for text in batch.column(2).to_pylist():
                m, segs, _ = _scan(text or "", model)
                score.append(model.score(model.chance([s for *_, s in segs], m)))
                size.append(m)
                real = [(a, z, s, p) for a, z, s in segs if (p := model.single(s, m)) <= alpha]
                spans = [w.span() for w in TOKEN.finditer(text)] if real else []
                passages.append([{"start": spans[a][0], "end": spans[z][1], "score": s, "chance": p} for a, z, s, p in real])
            predicted = pa.array([int(s >= 0.7) for s in score], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64()), predicted, pa.array(size, pa.int64()), pa.array(passages, kind)], names=names)

    schema = "doc_id long, held_out boolean, score double, predicted int, tokens long, passages array<struct<start: long, end: long, score: double, chance: double>>"
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(work, schema)


def op12_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("passages").cast("long").alias("n_passages"))
