"""The battery, the language model and the stored streams, held against plain loops."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from asofkit.llm import langid, secrets, ts

from .test_scans import by_hand

MIXED = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def plain_battery(token):
    """(length, p) of a token in its inferred encoding, or None."""
    bare = re.sub("=+$", "", token)
    if re.fullmatch(secrets.UUID, bare):
        bare = bare.replace("-", "")
    alphabet = next((letters for _, shape, letters in secrets.ENCODINGS if re.search(shape, bare)), None)
    if alphabet is None:
        return None
    x, k, n = [alphabet.index(c) for c in bare], len(alphabet), len(bare)
    chi = sum((x.count(v) - n / k) ** 2 / (n / k) for v in range(k))
    z1 = ((chi / (k - 1)) ** (1 / 3) - 1 + 2 / (9 * (k - 1))) / math.sqrt(2 / (9 * (k - 1)))
    high = [v >= k / 2 for v in x]
    n1, n2 = sum(high), n - sum(high)
    runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
    var = 2 * n1 * n2 * (2 * n1 * n2 - n) / (n * n * (n - 1))
    z2 = abs(runs - 2 * n1 * n2 / n - 1) / math.sqrt(var) if var > 0 else 40
    m = sum(x) / n
    square = sum((v - m) ** 2 for v in x)
    joint = sum((a - m) * (b - m) for a, b in zip(x, x[1:]))
    z3 = abs(joint / square + 1 / n) * math.sqrt(n) if square > 0 else 40
    tail = lambda z: math.erfc(z / math.sqrt(2)) / 2
    half = -sum(math.log(max(p, 1e-12)) for p in (tail(z1), 2 * tail(z2), 2 * tail(z3)))
    return n, min(1.0, math.exp(-half) * (1 + half + half * half / 2))


def plain_candidates(text):
    for m in re.finditer(secrets.CANDIDATE, text or ""):
        parts = [(m.start() + x.start(), m.start() + x.end()) for x in re.finditer(secrets.PART, m[0]) if x[0] != m[0]]
        for a, b in [(m.start(), m.end()), *parts]:
            if got := plain_battery(text[a:b]):
                yield a, b, *got


def plain_cut(p, rate=0.05):
    """The lowest hundredth above which at most ``rate`` of the tokens' p exceed what random ones have."""
    bins = [min(int(x * 100), 99) for x in p]
    top = sum(b >= 50 for b in bins)
    for k in range(1, 50):
        low = sum(k <= b < 50 for b in bins)
        share = 1 - k / 50
        if low - share * top - 3 * math.sqrt(low + share**2 * (top + 1)) <= rate * (low + top):
            return k / 100
    return 0.5


def plain_scan(texts):
    seen = defaultdict(dict)
    for t in texts:
        for a, b, n, p in plain_candidates(t):
            seen[int(math.log2(n))][t[a:b]] = p
    cuts = {band: plain_cut(list(tokens.values())) for band, tokens in seen.items()}
    out = []
    for t in texts:
        base = by_hand(t)
        ok = [(a, b) for a, b, n, p in plain_candidates(t) if p >= cuts[int(math.log2(n))] and not any(s < b and a < e for s, _, e in base)]
        found = [(a, 3, b) for a, b in ok if not any(c <= a and b <= d and (c, d) != (a, b) for c, d in ok)]
        out.append(sorted(base + found))
    return out


@pytest.fixture(scope="module")
def secret_texts():
    rng = random.Random(12)
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    out = [None, "", "no tokens here"]
    for i in range(60):
        n = rng.choice([16, 20, 33, 48, 70])
        out.append(f"é {some(MIXED, n)} a/{some(MIXED, 24)}_{some('0123456789abcdef', 20)} {'aB3' * (n // 3)} x-{some('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', n)}==")
        out.append(f"id {some('0123456789abcdef', 8)}-{'-'.join(some('0123456789ABCDEF', 4) for _ in range(3))}-{some('0123456789abcdef', 12)} token={some(MIXED, n)}")
    return out + out[5:9]


def test_battery_equals_plain_tests(spark, secret_texts):
    rows = [t for text in secret_texts for t in re.findall(secrets.CANDIDATE, text or "")]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    for r in df.select("t", secrets.battery(df.t).alias("b")).collect():
        want = plain_battery(r["t"])
        assert (want is None) == (r["b"] is None), r["t"]
        # The operator's normal tail is right to 1e-7, which tells in very small p, far below the least cut of 0.01.
        assert want is None or (r["b"]["length"] == want[0] and r["b"]["p"] == pytest.approx(want[1], rel=1e-3, abs=1e-5)), r["t"]


def test_scan_equals_plain_scan(spark, secret_texts):
    df = spark.createDataFrame(list(enumerate(secret_texts)), "doc_id long, text string")
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in secrets.scan(df).collect()}
    want = plain_scan(secret_texts)
    assert [got[i] for i in range(len(want))] == want
    assert sum(k == 3 for found in want for _, k, _ in found) > 100


def plain_grams(text):
    raw = b" " + text.encode() + b"  "
    out = []
    for i, b in enumerate(raw):
        if 65 <= b <= 90 or (i and raw[i - 1] == 0xC3 and 0x80 <= b < 0x9F):
            b += 32
        elif b < 128 and not 97 <= b <= 122:
            b = 32
        out.append(b)
    grams = [tuple(out[i : i + 3]) for i in range(len(out) - 2)]
    return [a << 16 | b << 8 | c for a, b, c in grams if (a, b) != (32, 32) and (b, c) != (32, 32)]


def test_language_model_equals_plain_loops(spark, documents):
    rows = [(r["text"], r["lang"]) for r in documents.select("text", "lang").where("text is not null and lang is not null").collect()]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"), per_language=len(rows), features=600)
    each, total = defaultdict(Counter), Counter()
    different = set(rows)
    for text, lang in different:
        each[lang].update(set(plain_grams(text)))
    rank = {}
    for counts in each.values():
        total.update(counts)
        for i, g in enumerate(sorted(counts, key=lambda g: (-counts[g], g))):
            rank[g] = min(i, rank.get(g, i))
    wanted = max(600, 256 * len(each))
    grams = sorted(rank, key=lambda g: (rank[g], -total[g], g))[:wanted]
    idf = {g: math.log((1 + len(different)) / (1 + total[g])) + 1 for g in grams}
    assert model.grams.tolist() == grams and np.allclose(model.idf, [idf[g] for g in grams])
    texts = [t for t, _ in rows[:25]] + ["ÀÉÎ straße Ünder", "a"]
    langs, scores, _ = model.predict(texts)
    for text, lang, score in zip(texts, langs, scores):
        weight = {g: math.log1p(n) * idf[g] for g, n in Counter(plain_grams(text)).items() if g in idf}
        norm = math.sqrt(sum(w * w for w in weight.values())) or 1.0
        near = [sum(weight.get(g, 0) / norm * float(c[i]) for i, g in enumerate(grams)) for c in model.centroids]
        best = max(range(len(near)), key=lambda i: near[i])
        assert score == pytest.approx(min(max(near[best], 0), 1), abs=1e-4)
        assert near[model.languages.index(lang)] > -1 and max(s for s, x in zip(near, model.languages) if x == lang) >= near[best] - 1e-4


def plain_checksum(data):
    c = 0xFFFFFFFF
    for bit in (b >> s & 1 for b in data for s in range(7, -1, -1)):
        c = (c << 1 ^ (0x04C11DB7 if c >> 31 ^ bit else 0)) & 0xFFFFFFFF
    return c


@pytest.mark.parametrize("n", [1, 170, 182, 576, 40_000])
def test_stored_streams_follow_the_format(n):
    payload = random.Random(n).randbytes(n)
    stream = ts.mux(payload)
    assert len(stream) % 188 == 0
    elementary, counters, tables = [], [], {}
    for at in range(0, len(stream), 188):
        p = stream[at : at + 188]
        assert p[0] == 0x47 and not p[1] & 0x80
        pid, start, control = (p[1] & 0x1F) << 8 | p[2], p[1] & 0x40, p[3] >> 4 & 3
        body = p[5 + p[4] :] if control & 2 else p[4:]
        if pid in (0, 0x1000):
            section = body[1 + body[0] :]
            section = section[: 3 + ((section[1] & 0x0F) << 8 | section[2])]
            assert plain_checksum(section) == 0
            tables[pid] = section
            continue
        assert pid == 0x100
        counters.append(p[3] & 15)
        if start:
            assert control & 2 and p[5] & 0x40  # a random-access point
            elementary.append(b"")
        elementary[-1] += body
    assert counters == [i % 16 for i in range(len(counters))]
    assert tables[0][8:12] == bytes([0, 1, 0xF0, 0x00]) and tables[0x1000][13:15] == bytes([0xE1, 0x00])
    out = b""
    for k, pes in enumerate(elementary):
        assert pes[:3] == b"\0\0\1" and (pes[4] << 8 | pes[5]) == len(pes) - 6 and pes[7] == 0x80
        t = pes[9:14]
        assert ((t[0] >> 1 & 7) << 30 | t[1] << 22 | t[2] >> 1 << 15 | t[3] << 7 | t[4] >> 1) == 3600 * k
        out += pes[9 + pes[8] :]
    assert out == payload
