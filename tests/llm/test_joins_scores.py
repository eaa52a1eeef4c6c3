import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from asofkit.llm import components, jaccard, katz, topk, words

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(UPPER, UPPER.lower())))


def brute_join(rows, width, percent):
    sets = []
    for _, text in rows:
        w = split(text)
        sets.append({tuple(w[j : j + width]) for j in range(max(1, len(w) - width + 1))} if w else set())
    n = len(rows)
    parent, links = list(range(n)), [0] * n

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(n):
        for b in range(a):
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    links[a] += 1
                    links[b] += 1
                    parent[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return sorted((str(d), len(s), str(least[find(i)] if s else d), k) for i, ((d, _), s, k) in enumerate(zip(rows, sets, links)))


def got_join(df, width, percent):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["n_links"]) for r in jaccard.similar(df, width, percent).collect())


def test_join_equals_brute_force(documents, texts):
    assert got_join(documents, 3, 90) == brute_join(list(texts.items()), 3, 90)


def test_join_of_near_copies_in_small_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(w if rng.random() > 0.02 else f"x{rng.integers(50)}" for w in base[: 60 - i % 4])) for i in range(70)]
    rows += [(100 + i, " ".join(f"{i}y{j}" for j in range(i % 12))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", 9)
    assert got_join(df, 2, 70) == brute_join(rows, 2, 70)


def test_join_odd_rows(odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    assert got_join(odd, 5, 80) == brute_join(rows, 5, 80)
    assert jaccard.similar(empty).count() == 0


def test_one_of_each_keeps_columns(odd):
    out = jaccard.one_of_each(odd)
    assert out.columns == odd.columns
    ids = sorted(r["doc_id"] for r in out.where("doc_id is not null").collect())
    assert ids == [1, 4, 5, 6, 7, 8, 9, 10]


def test_signatures_meet_for_every_linked_pair():
    rng = np.random.default_rng(5)
    for percent in (50, 80, 90):
        schemes = jaccard.bands(300, percent)
        for spare, wide, hot in ((0, 0, 0), (2, 0, 0), (1, 1, 0), (0, 2, 2), (1, 1, 3)):
            for s in schemes:
                w = min(wide, s.differ)
                s.spare, s.wide, s.hot, s.segments = spare, w, hot, max(1, s.differ + 1 + spare + hot - w)
            for _ in range(60):
                n = int(rng.integers(1, 250))
                a = rng.choice(10_000, n, replace=False)
                most = n * (100 - percent) // 100
                lost = int(rng.integers(0, most + 1))
                new = int(rng.integers(0, (100 * (n - lost) // percent - n) + 1))  # replaced and added ones
                b = np.r_[a[lost:], rng.choice(10_000, new, replace=False) + 20_000]
                both, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
                assert 100 * both >= percent * union
                sets = words.Shingles(2, np.r_[np.zeros(len(a), int), np.ones(len(b), int)], np.r_[a, b], words.mix(np.r_[a, b]))
                doc, sig = jaccard.signatures(sets, schemes, np.ones(2, bool))
                met = set(sig[doc == 0]) & set(sig[doc == 1])
                assert met
                # Each set may leave ``hot`` narrow signatures of a scheme in one order that both share.
                for order in (lambda x: x, lambda x: -x, lambda x: (x * 7919) % 10_007):
                    kept = []
                    for d in (0, 1):
                        own = [x for x in sig[doc == d].tolist() if x & 2]
                        left = {x for bit in (0, 1) for x in sorted((y for y in own if y & 1 == bit), key=order)[:hot]}
                        kept.append(set(sig[doc == d].tolist()) - left)
                    assert kept[0] & kept[1]
                few = [np.frombuffer(x, np.uint64) for x in jaccard.sketches(sets)]
                cells = min(map(len, few))
                x, y = (np.bitwise_xor.reduce(f.reshape(-1, cells), axis=0) for f in few)
                assert np.bitwise_count(x ^ y).sum() <= len(a) + len(b) - 2 * both


def test_lists_connect_what_sketches_dont_tell_apart():
    rng = np.random.default_rng(9)
    base = rng.choice(10**6, 300, replace=False)
    made = [np.r_[base[k : 290 + k], rng.integers(10**6, 10**7, 3)] for k in range(6)] + [rng.choice(10**6, 300) + 10**8 for _ in range(5)]
    made = [np.unique(x) for x in made]
    sets = words.Shingles(len(made), np.repeat(np.arange(len(made)), [len(x) for x in made]), np.concatenate(made), words.mix(np.concatenate(made)))
    frame = [{"sig": g, "cid": i, "n": len(made[i]), "sketch": x} for g in (4, 8) for i, x in enumerate(jaccard.sketches(sets))]
    import pandas as pd

    edges = jaccard.may_link(pd.DataFrame(frame), 80)
    root = {}
    for a, b in edges.itertuples(index=False):
        root.setdefault(a, set()).add(b)
        root.setdefault(b, set()).add(a)
    assert set(root) == set(range(6))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (100, 102), (200, 200)]
    out = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({out[i] for i in range(41)}) == 1 and out[101] == out[102] == out[100] and len(set(out.values())) == 2


def test_shingles_of_words():
    s = words.shingle(pa.array(["A b c a b c", "x", " ", None, "a B c"]), 3)
    assert s.counts.tolist() == [3, 1, 0, 0, 1]
    assert s.hash[s.doc == 4][0] in s.hash[s.doc == 0]


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).astype("float32").tolist()) for i in range(450)]
    rows += [(500 + i, rows[0][1]) for i in range(30)]
    rows += [(601, None), (700, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (800, [float("nan")] * 6), (900, [float("inf")] * 6), (1000, [0.0] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in topk.top_k(df, block=100, query_block=2).collect())
    good = {i: np.floor(1024 * np.array(x, float)).astype(int) for i, x in rows if i is not None and x and all(v is not None and math.isfinite(v) for v in x)}
    want = []
    for q in good:
        if q % 100 == 0:
            best = sorted((-int(good[q] @ good[c]), c) for c in good if c != q)[:10]
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert got == sorted(want)
    assert topk.top_k(df.where("1 = 0")).count() == 0


def test_threshold_search_stops_early():
    x = np.zeros((4000, 2))
    x[:, 0] = np.arange(4000)
    lists = topk.SortedLists(np.arange(4000), x)
    ids, scores = lists.search(np.array([2.0, 0.0]), -1, 3)
    assert ids.tolist() == [3999, 3998, 3997] and scores.tolist() == [7998, 7996, 7994]


def katz_by_hand(rows, held=2):
    seqs = [(d, [*split(t), katz.END]) for d, t in rows]
    train = [s for d, s in seqs if d is None or zlib.crc32(str(d).encode()) % 7 != held]
    c1 = Counter(w for s in train for w in s)
    c2 = Counter(p for s in train for p in zip([None, *s], s))
    n, v = sum(c1.values()), len(c1)

    def factors(c):
        k = Counter(c.values())
        return katz.discounts([k[r] for r in range(katz.DISCOUNTED + 2)])

    d1, d2 = factors(c1), factors(c2)
    f = lambda d, c: d[c] if c <= katz.DISCOUNTED else 1.0
    kept = sum(f(d1, c) * c for c in c1.values())
    bottom = n if kept < n - 1e-9 else n + 1
    p1 = lambda w: f(d1, c1[w]) * c1[w] / bottom if c1[w] else 1 - kept / bottom
    after = {}
    for (h, w), c in c2.items():
        s = after.setdefault(h, [0, 0.0, 0.0])
        s[0] += c
        s[1] += f(d2, c) * c
        s[2] += p1(w)

    def p2(h, w):
        if h not in after:
            return p1(w)
        total, left, seen = after[h]
        b = total if left < total - 1e-9 else total + 1
        c = c2[(h, w)]
        return f(d2, c) * c / b if c else (1 - left / b) / (1 - seen) * p1(w)

    for h in list(after)[:30]:
        assert sum(p2(h, w) for w in c1) + p2(h, "\0") == pytest.approx(1)
    out = []
    for d, s in seqs:
        base = sum(math.log10((c1[w] + 1) / (n + v + 1)) for w in s)
        out.append((str(d), len(s), sum(c1[w] > 0 for w in s), n, round(base, 5), round(sum(math.log10(p2(h, w)) for h, w in zip([None, *s], s)), 5)))
    return sorted(out)


def katz_got(df):
    return sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5), round(r["score"], 5)) for r in katz.score(df).collect())


def test_katz_equals_plain_model(documents, texts, monkeypatch):
    monkeypatch.setattr(katz, "BUCKET_TOKENS", 9000)
    monkeypatch.setattr(katz, "BLOCK_BYTES", 60_000)
    assert katz_got(documents) == katz_by_hand(list(texts.items()))


def test_katz_odd_rows(odd, empty):
    assert katz_got(odd) == katz_by_hand([(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()])
    assert katz.score(empty).count() == 0


def test_shrunk_arrays_round_trip():
    a = [np.arange(5), np.array([1.5, -2.0]), np.empty(0, np.int32), np.array([3], np.int8)]
    assert all((x == y).all() and x.dtype == y.dtype for x, y in zip(a, katz.grow(katz.shrink(*a))))
