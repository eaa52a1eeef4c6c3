import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from asofkit.llm import packing, sharding, tokens


def test_shards_are_balanced_and_keep_copies_together(documents, texts):
    out = sharding.shard_documents(documents).toPandas()
    assert sorted(out.doc_id) == sorted(texts)
    assert (out["size"] == [len(texts[d].encode()) + 1 for d in out.doc_id]).all()
    assert (out.text_crc32 == [zlib.crc32(texts[d].encode()) for d in out.doc_id]).all()
    by = out.groupby("shard")
    assert sorted(by.groups) == list(range(8)) and all(sorted(s) == list(range(len(s))) for _, s in by.slot)
    sums = by["size"].sum()
    assert sums.max() - sums.min() < 0.05 * sums.mean()
    assert set(out.law) == {"bytes"} and out.grown_shard.isna().all()
    of = {}
    for d, s in zip(out.doc_id, out.shard):
        assert of.setdefault(texts[d], s) == s


def test_a_group_larger_than_a_shard_is_cut(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2000, "the same text").otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"))
    sums = sharding.shard_documents(df).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n")).toPandas()
    assert len(sums) == 8 and sums.b.max() < 1.1 * sums.b.min() and sums.n.max() < 1.15 * sums.n.min()


def test_sharding_odd_rows(odd, empty):
    out = sharding.shard_documents(odd).collect()
    assert len(out) == 13 and sorted(r["size"] for r in out if r["text_crc32"] == 0) == [1, 1, 1]
    assert sharding.shard_documents(empty).count() == 0


@pytest.fixture(scope="module")
def plain():
    """The library's tokenizer as the file gives it."""
    return Tokenizer.from_file(tokens.default_path())


def test_tokens_equal_the_library(texts, plain):
    t = plain
    marks = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000 and unicodedata.category(c.lower()[-1])[0] == "M"]
    some = [*list(texts.values())[:40], "it's we're 'S x's. don't. É É. ΣΑΣ İx a_b n't) .x 日本語。 １２. re're", "", " ", None, "a  b\u00a0c\n<|endoftext|>."]
    some += ["a <|endoftext|> b", "<|startoftext|>a<|endoftext|>", "A <|ENDOFTEXT|> b", "<|endoftext|><|endoftext|>.", "<|end oftext|>", "İ. İ... x İ.", " ".join(f"a{c}. {c}..." for c in marks)]
    some += [" ".join(f"{c}. x{c}!" for c in map(chr, range(lo, lo + 0x400)) if c.isprintable()) for lo in range(0xA0, 0x3000, 0x400)]
    ids, at = tokens.encode(pa.array(some), tokens.default_path())
    for i, s in enumerate(some):
        assert ids[at[i] : at[i + 1]].tolist() == t.encode(s or "", add_special_tokens=False).ids, (s or "")[:80]


def test_packing_is_whole_and_tight(documents, texts, plain):
    out = packing.pack(documents).toPandas()
    t = plain
    for doc, rows in out.sort_values("piece").groupby("doc_id"):
        ids = np.array([*t.encode(texts[doc], add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for k, r in enumerate(rows.itertuples()):
            assert (r.piece, r.start, r.length) == (k, at, min(2048, len(ids) - at))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert set(out.doc_id) == set(texts)
    placed(out)
    assert out.sequence_id.nunique() <= -(-out.length.sum() // 2048) + 2


def placed(out, capacity=2048):
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert (s.offset.to_numpy() == np.r_[0, np.cumsum(s.length)[:-1]]).all() and s.length.sum() <= capacity


def test_packing_odd_rows(odd, empty):
    out = packing.pack(odd, capacity=64).toPandas()
    placed(out, 64)
    assert (out[out.doc_id == 5].length == 1).all() and len(out[out.doc_id == 2]) % 2 == 0
    assert packing.pack(empty).count() == 0


def test_plan_uses_exact_complements_first():
    made = packing.plan({7: 1, 3: 1, 5: 2, 4: 1, 2: 1}, 10)
    assert sorted(sorted(p) for p, n in made for _ in range(n)) == [[2, 4], [3, 7], [5, 5]]
    rng = np.random.default_rng(0)
    counts = {int(n): int(c) for n, c in zip(range(1, 61), rng.integers(0, 500, 60))}
    made = packing.plan(counts, 100)
    used = np.zeros(101, int)
    for p, n in made:
        assert sum(p) <= 100
        for x in p:
            used[x] += n
    assert {n: int(c) for n, c in enumerate(used) if c} == {n: c for n, c in counts.items() if c}
    assert sum(n for _, n in made) <= -(-sum(n * c for n, c in counts.items()) // 100) + 10


def plain_pack(items, n_shards):
    """Items (dimension vectors) to shards, by a loop over plain numbers."""
    caps = [max(sum(v[d] for v in items) / n_shards, 1e-9) for d in range(3)]
    left = [[1.0] * 3 for _ in range(n_shards)]
    out = [0] * len(items)
    for i in sorted(range(len(items)), key=lambda i: -max(v / c for v, c in zip(items[i], caps))):
        need = [v / c for v, c in zip(items[i], caps)]
        dots = [sum(a * b for a, b in zip(row, need)) for row in left]
        best = max(dots)
        out[i] = next(s for s, d in enumerate(dots) if d >= best - 1e-12)
        left[out[i]] = [a - b for a, b in zip(left[out[i]], need)]
    return out


def test_placement_equals_a_plain_packer():
    rng = np.random.default_rng(2)
    v = rng.integers(1, 10_000, (300, 3)).astype(float) ** 1.5
    assert sharding.place(v, 8).tolist() == plain_pack(v.tolist(), 8)


def test_a_large_group_without_ids_is_cut(spark):
    df = spark.range(4000).selectExpr("cast(null AS long) AS doc_id", "'one text of all rows' AS text")
    out = sharding.shard_documents(df).groupBy("shard").agg(F.sum("size").alias("b"), F.min("cut").alias("cut")).collect()
    sizes = [r["b"] for r in out]
    assert len(out) == 8 and max(sizes) < 1.2 * min(sizes) and all(r["cut"] for r in out)


def test_a_tokenizer_of_other_rules_encodes_whole_texts(tmp_path):
    import json

    rules = json.loads(open(tokens.default_path(), encoding="utf-8").read())
    assert tokens.by_words(rules)
    rules["normalizer"] = None
    other = tmp_path / "t.json"
    other.write_text(json.dumps(rules))
    assert not tokens.by_words(rules)
    texts = ["Upper CASE words, and lower.", None, ""]
    ids, at = tokens.encode(pa.array(texts), str(other))
    t = Tokenizer.from_file(str(other))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [t.encode(x or "", add_special_tokens=False).ids for x in texts]
