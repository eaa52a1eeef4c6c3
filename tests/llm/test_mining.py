"""Hard negatives, toxic segments and collocations against plain loops."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from asofkit.llm import collocations, negatives, toxicity
from asofkit.llm.words import mix

DATA = "/root/testdata/sf0.001"
VECTORS = "vec_id long, label int, embedding array<float>"


def plain_negatives(rows, k=5, every=100, low=80, high=100):
    kept = [(i, lab, [int(np.floor(256 * float(np.float32(x)))) for x in e]) for i, lab, e in rows if i is not None and lab is not None and e and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for own, lab, a in sorted({(i, lab, tuple(x)) for i, lab, x in kept if i % every == 0}):
        scored = [(-sum(p * q for p, q in zip(a, x)), i, other == lab) for i, other, x in kept if i != own and len(x) == len(a)]
        for s, i, _ in sorted(x for x in scored if x[2])[:k]:
            inside = sorted((n, j) for n, j, same in scored if not same and low * -s <= 100 * -n <= high * -s)
            out += [(own, i, r, j, -s, -n) for r, (n, j) in enumerate(inside[:k], 1)]
    return sorted(out)


def test_negatives_equal_plain_loops(spark):
    rng = random.Random(3)
    vector = lambda n=6: [round(rng.uniform(-0.2, 1), 3) for _ in range(n)]
    rows = [(i, rng.randrange(3), vector()) for i in range(700)]
    rows += [(1000 + i, 1, rows[100][2]) for i in range(40)] + [(1100 + i, 2, rows[100][2]) for i in range(40)]  # ties, also of the anchor itself
    rows += [rows[5], rows[5], (600, 2, rows[600][2]), (None, 1, vector()), (7, None, vector()), (8, 1, None), (9, 1, []), (10, 1, [1.0, None]), (11, 1, [1.0, float("nan")]), (12, 1, [float("inf")] * 6)]
    rows += [(2000 + i, i % 2, vector(4)) for i in range(30)] + [(2100, 0, [0.0] * 6), (2200, 1, [-1.0] * 6), (2300, 99, vector())]
    df = spark.createDataFrame(rows, VECTORS).withColumn("score", F.lit("z")).withColumn("w", F.lit("z"))
    want = plain_negatives(rows)
    assert len(want) > 100 and sorted(map(tuple, negatives.mine(df).collect())) == want
    assert negatives.mine(df.where("1 = 0")).count() == 0


def test_negatives_with_small_digits_blocks_and_large_numbers(spark, monkeypatch):
    for name, value in (("DIGIT", 3), ("BLOCK", 16), ("ANCHORS", 2), ("BLOCKS_A_TASK", 2)):
        monkeypatch.setattr(negatives, name, value)
    rng = random.Random(4)
    rows = [(i, rng.randrange(2), [rng.uniform(0, 3e5) for _ in range(3)]) for i in range(0, 600, 2)]
    df = spark.createDataFrame(rows, VECTORS)
    assert sorted(map(tuple, negatives.mine(df).collect())) == plain_negatives(rows)  # products beyond 2^53 too
    with pytest.raises(ValueError):
        negatives.mine(spark.createDataFrame([(0, 1, [1e9])], VECTORS))


def plain_segments(scores):
    """The best segment (shortest, first), then those left and right of it."""

    def rest(lo, hi):
        best = None
        for a in range(lo, hi):
            total = 0.0
            for z in range(a, hi):
                total += scores[z]
                key = (-round(total, 9), z - a, a)
                if total > 1e-9 and (best is None or key < best[0]):
                    best = (key, a, z)
        if best is None:
            return []
        _, a, z = best
        return rest(lo, a) + [(a, z, round(sum(scores[a : z + 1]), 6))] + rest(z + 1, hi)

    return rest(0, len(scores))


def test_segments_equal_the_recursive_definition():
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randrange(0, 25)
        gains = {i: rng.uniform(0.1, 4) for i in range(n) if rng.random() < 0.4}
        scores = [gains.get(i, -1.0) for i in range(n)]
        got = [(a, z, round(s, 6)) for a, z, s in toxicity.segments(sorted(gains), [gains[i] for i in sorted(gains)], 1.0)]
        assert got == plain_segments(scores)


def test_segments_take_linear_time():
    n = 300_000
    assert len(toxicity.segments(list(range(0, 2 * n, 2)), [1.0 - 1e-7 * i for i in range(n)], 1.5)) == n


def test_toxicity_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.find(docs, toxicity.fit(docs, labels)).where("held_out").join(labels, "doc_id").select("toxic", "score", "predicted").toPandas()
    hit = out[out.predicted == 1]
    assert len(out) > 1000 and hit.toxic.mean() > 0.85 and hit.toxic.sum() / out.toxic.sum() > 0.85
    ranks = out.score.rank()
    n1 = out.toxic.sum()
    assert (ranks[out.toxic == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(out) - n1)) > 0.93


def test_toxic_passages_and_odd_rows(spark, odd, empty):
    rng = random.Random(6)
    plain = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(400)]
    text = lambda n, bad=0: " ".join([*rng.choices(plain, k=n), *["vile"] * (bad > 0), *rng.choices(plain, k=n)])
    shared = text(20)  # a passage that many toxic texts share isn't toxic for that
    rows = [(i, text(30, i % 4 == 0) + (f" {shared} stamp" if i % 4 == 0 else "")) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)] + [(0, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert set(model.scores) == {"vile"}
    tests = spark.createDataFrame([(1, "so VILE!!"), (2, "waa wab " * 300_000 + "vile"), (3, "vile " * 3 + "waa"), (4, shared), (None, "vile")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.find(tests, model).collect()}
    assert [(p["start"], p["end"]) for p in got[1]["passages"]] == [(3, 7)] and got[1]["predicted"] == 1
    assert got[2]["tokens"] == 600_001 and got[4]["predicted"] == 0 and got[3]["score"] >= got[1]["score"] and got[None]["held_out"] is False
    out = toxicity.find(odd, toxicity.fit(odd, labels)).collect()
    assert len(out) == 13 and all(0 <= r["score"] <= 1 for r in out)
    none = toxicity.fit(empty, labels.where("1 = 0"))
    assert toxicity.find(empty, none).count() == 0 and toxicity.find(odd, none).where("predicted = 1").count() == 0


def test_perfect_hash_is_minimal_and_tells_strangers():
    keys = mix(np.arange(50_000))
    mph = collocations.PerfectHash(keys)
    slot = mph(keys)
    assert mph.size == len(keys) and sorted(slot.tolist()) == list(range(len(keys)))
    stored = np.empty(len(keys), np.uint64)
    stored[slot] = keys
    other = mix(np.arange(50_000, 60_000))
    at = mph(other)
    assert not (stored[at[at >= 0]] == other[at >= 0]).any()
    assert collocations.PerfectHash(np.empty(0, np.uint64))(keys).max() == -1


def test_keys_of_one_hash_are_told_apart():
    keys = np.array([1, 2, 1, 2, 2, 3])
    calls = []

    def hashes(seed):
        calls.append(seed)
        return mix(keys.astype(np.uint64)) if seed else np.full(len(keys), 5, np.uint64)

    slot, counts, at = collocations.slot_counts(hashes, lambda a, b: keys[a] == keys[b], [np.array([4, 6]), np.array([6, 1, 4, 2])], 10)
    assert calls == [0, 1] and keys[at[slot[:5]]].tolist() == [1, 2, 1, 2, 2] and slot[5] == -1 and counts[slot[:2]].tolist() == [10, 11]


def plain_phrases(rows, least=10, keep=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    often = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    found = []
    for (lang, p), a in often.items():
        if any(100 * b >= 50 * a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for (o, q), b in often.items() if o == lang):
            continue
        score, _, left, right = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        found.append((lang, -score, -a, " ".join(p).encode(), left, right))
    out = []
    for lang in {x[0] for x in found}:
        mine = sorted(x for x in found if x[0] == lang)[:keep]
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (_, s, a, p, left, right) in enumerate(mine, 1)]
    return sorted(out)


def test_phrases_equal_plain_loops(spark, monkeypatch):
    rng = random.Random(7)
    words = ["a", "B", "c", "dé", "É", "x\x00y", "big", " ", "İ", "a-b"]
    rows = []
    for i in range(300):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ". ", ",", "\n", "  "]) for _ in range(rng.randrange(30)))
        rows.append((rng.choice(["en", "und", None, "d\ne", ""]), text))
    rows += [("en", "New York City"), ("en", None), (None, ""), ("en", " .,. ")] * 12 + [("fr", "un deux trois " * 40)]
    df = spark.createDataFrame(rows, "lang string, text string").withColumn("doc_id", F.lit(None).cast("long")).withColumn("block", F.lit("z"))
    want = plain_phrases(rows)
    assert len(want) > 50 and sorted(map(tuple, collocations.phrases(df).collect())) == want
    for name, value in (("BLOCK_BYTES", 500), ("SHARD_WORDS", 300)):
        monkeypatch.setattr(collocations, name, value)
    assert sorted(map(tuple, collocations.phrases(df.repartition(3), keep=7).collect())) == [x for x in want if x[1] <= 7]
    assert collocations.phrases(df.where("1 = 0")).count() == 0


def test_phrases_odd_rows(odd):
    out = collocations.phrases(odd).collect()
    assert out and {r["lang"] for r in out} == {"en"}
    t = pa.array(["ab", "", "é"])
    data, lengths = collocations._bytes_of(t.slice(1))
    assert collocations._text_array(data, lengths).to_pylist() == ["", "é"]
