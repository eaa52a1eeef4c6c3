"""Language identification by the nearest of several TF-IDF n-gram centroids per language."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialise, release, table

UNKNOWN = "und"
_LETTER = re.compile("[A-Za-z]")
#: ASCII letters in lower case, all bytes of other characters kept, everything else a space.
_FOLD = np.array([b | 0x20 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(_LETTER.search(text)) or any(c.isalpha() for c in text))


def codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The three-byte n-grams of whole texts as numbers, and each text's first place (n + 1 offsets)."""
    data = [b" " + (t or "").encode() + b"  " for t in texts]
    raw = np.frombuffer(b"".join(data), np.uint8)
    a = _FOLD[raw]
    latin = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] < 0x9F)) + 1
    a[latin] += 0x20  # the capital letters of Latin-1
    a = a.astype(np.int32)
    grams = np.r_[a[:-2] << 16 | a[1:-1] << 8 | a[2:], np.full(2, 0x202020, np.int32)] if len(a) > 2 else a
    return grams, np.r_[0, np.cumsum([len(d) for d in data])]


@dataclass
class Model:
    languages: list[str]  # of each centroid
    grams: np.ndarray  # code of each feature
    idf: np.ndarray
    centroids: np.ndarray  # centroid, feature
    floors: np.ndarray  # least similarity by log2 of the number of n-grams

    def vectors(self, texts: list[str | None], chunk: int = 256):
        """Unit TF-IDF vectors and n-gram counts, some texts at a time."""
        place = np.full(1 << 24, -1, np.int32)
        place[self.grams] = np.arange(len(self.grams))
        d = len(self.grams)
        while texts:
            n, size = 0, 0
            while n < len(texts) and n < chunk and size < 4_000_000:
                size += len(texts[n] or "")
                n += 1
            part, texts = texts[:n], texts[n:]
            grams, at = codes(part)
            f = place[grams]
            ok = f >= 0
            key = np.repeat(np.arange(n) * d, np.diff(at))[ok] + f[ok]
            tf = np.log1p(np.bincount(key, minlength=n * d).reshape(n, d))
            x = (tf * self.idf).astype(np.float32)
            norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
            yield x / np.maximum(norm, 1e-12), np.diff(at)

    def predict(self, texts: list[str | None]) -> tuple[list[str | None], list[float], list[bool]]:
        """Language, similarity to its nearest centroid, and whether that is too small."""
        langs, scores, far = [], [], []
        for x, n in self.vectors(texts):
            s = x @ self.centroids.T
            best = s.argmax(axis=1)
            top = np.clip(s[np.arange(len(s)), best].astype(float), 0, 1)
            floor = self.floors[np.minimum(np.log2(np.maximum(n, 1)).astype(int), len(self.floors) - 1)]
            langs += [self.languages[b] for b in best.tolist()]
            scores += top.tolist()
            far += (top <= floor).tolist()
        for i, t in enumerate(texts):
            if not has_letter(t):
                langs[i], scores[i], far[i] = UNKNOWN, 0.0, True
        return langs, scores, far


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from farthest-first starts; unit centroids."""
    c = [x.mean(axis=0)]
    while len(c) < min(k, len(x)):
        c.append(x[np.argmin(np.max(x @ np.array(c).T, axis=1))])
    c = np.array(c)
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        c = np.array([x[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32)


def sampled(rows: DataFrame, per_language: int) -> DataFrame:
    """At most ``per_language`` different texts of each language, those of the least hashes.

    A copy counts once and every language with a text has one. Each task sends its least hashes
    only, so what meets at one place is bounded by the tasks.
    """
    hashed = rows.withColumn("h", F.xxhash64("text"))

    def least(batches):
        kept: dict[str, np.ndarray] = {}
        for b in batches:
            lang, h = np.array(b.column(0).to_pylist(), object), b.column(1).to_numpy()
            for x in set(lang.tolist()):
                kept[x] = np.unique(np.r_[kept.get(x, h[:0]), h[lang == x]])[:per_language]
        for x, h in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(h), pa.string()), pa.array(h, pa.int64())], names=["lang", "h"])

    first = hashed.select("lang", "h").mapInArrow(least, "lang string, h long").distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = first.withColumn("_n", place).where(F.col("_n") <= per_language).drop("_n")
    return hashed.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text")).select("text", "lang")


def fit(train: DataFrame, per_language: int = 400, features: int = 4096, clusters: int = 3, slack: float = 0.4, low: float = 0.05) -> Model | None:
    """Learn centroids from the columns text and lang of a bounded sample.

    ``per_language`` different texts of each language at most are taken by a hash; their whole
    texts count. ``features`` n-grams are kept, those of the best ranks by documents within any
    language (more for many languages, so that each has 256 of its own), weighted by inverse document
    frequency. ``slack`` times the ``low`` quantile of the similarities of the fitted texts, whole
    and cut to every shorter length, is the floor at or below which a text of about that length
    belongs to none. No labelled text gives None.
    """
    rows = train.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sample = materialise(sampled(rows, per_language), "sample")
    counts = {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()}  # one row a language
    if not counts:
        discard(sample)
        return None

    def frequencies(batches):
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                g = np.unique(codes([text])[0])
                g = g[((g & 0xFFFF) != 0x2020) & ((g >> 8) != 0x2020)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.astype(np.int32))], names=["lang", "gram"])

    each = sample.mapInArrow(frequencies, "lang string, gram int").groupBy("lang", "gram").agg(F.count("*").alias("n"))
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")))
    wanted = max(features, 256 * len(counts))
    common = ranked.groupBy("gram").agg(F.min("rank").alias("rank"), F.sum("n").alias("n")).orderBy("rank", F.desc("n"), "gram").limit(wanted).collect()
    if not common:
        discard(sample)
        return None
    df = np.array([r["n"] for r in common])
    blank = Model([], np.array([r["gram"] for r in common]), np.log((1 + sum(counts.values())) / (1 + df)) + 1, np.zeros((1, len(df)), np.float32), np.zeros(1))

    def vectorise(batches):
        for b in batches:
            x = [v for part in blank.vectors(b.column(0).to_pylist(), 64) for v in zip(*part)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([v.astype(np.float16).tobytes() for v, _ in x], pa.binary())], names=["lang", "x"])

    # At most per_language rows of 2 * wanted bytes for each language.
    got = sorted(sample.mapInArrow(vectorise, "lang string, x binary").collect(), key=lambda r: (r["lang"], r["x"]))
    langs = np.array([r["lang"] for r in got])
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in got]).astype(np.float32)
    names, parts = [], []
    for lang in sorted(set(langs.tolist())):
        c = cluster(x[langs == lang], clusters)
        names += [lang] * len(c)
        parts.append(c)
    centroids = np.concatenate(parts)

    def nearness(batches):
        own = np.array(names)
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sizes = [1 << k for k in range(2, 32) if 1 << k < len(text)]
                cuts = [text[at : at + c] for c in sizes for at in sorted({0, (len(text) - c) // 2})]
                found = [(int(n), float((centroids[own == lang] @ v).max())) for part in blank.vectors([*cuts, text], 64) for v, n in zip(*part)]
                yield pa.RecordBatch.from_arrays([pa.array([int(np.log2(max(n, 1))) for n, _ in found], pa.int32()), pa.array([s for _, s in found], pa.float64())], names=["size", "near"])

    # One row a length.
    quantile = {r["size"]: r["q"] for r in sample.mapInArrow(nearness, "size int, near double").groupBy("size").agg(F.percentile("near", F.lit(low)).alias("q")).collect()}
    discard(sample)
    floors = np.zeros(32)
    for b in range(32):  # a length without fitted texts takes the floor of the next shorter one
        floors[b] = slack * quantile[b] if b in quantile else floors[b - 1] if b else 0.0
    return Model(names, blank.grams, blank.idf, centroids, floors)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of ``docs`` as the struct ``doc``, with lang_pred, score and rejected.

    Only the text counts. Null texts and texts without a letter are 'und' with score 0 and
    rejected, as is everything without a model. Ties go to the first language in order.
    """
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    # Only the texts go to Python; the rows' other columns stay where they are.
    def predict(texts: pd.Series) -> pd.DataFrame:
        out = [], [], []
        for at in range(0, len(texts), 1000):
            part = texts.iloc[at : at + 1000].tolist()
            got = model.predict(part) if model else ([UNKNOWN] * len(part), [0.0] * len(part), [True] * len(part))
            for column, values in zip(out, got):
                column.extend(values)
        release()
        return pd.DataFrame(dict(zip(("lang_pred", "score", "rejected"), out)))

    # Declared nondeterministic so that a later filter doesn't make it run twice.
    judged = F.pandas_udf(predict, kind).asNondeterministic()
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), judged(F.col("text").cast("string")).alias("found"))
    return given.select("doc", "found.*")


def fold_of(doc_id, folds: int):
    """crc32 of the id as text, modulo the number of folds; a null id is in no held-out fold."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def op9_nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(fold_of(F.col("doc_id"), 4) == 2, F.lit(False))
    model = fit(docs.where(~held).select("text", "lang"))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select(
        F.col("doc.doc_id").alias("doc_id"), held_of("doc.doc_id", 4).alias("held_out"), "lang_pred", "score", "rejected"
    )


def held_of(name: str, folds: int):
    return F.coalesce(fold_of(F.col(name), folds) == 2, F.lit(False))
