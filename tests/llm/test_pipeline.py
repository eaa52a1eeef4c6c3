from collections import Counter

from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from asofkit.llm import jaccard, tokens
from asofkit.llm.common import materialise

from .conftest import DATA
from .test_joins_scores import brute_join
from .test_scans import by_hand


def test_stages_do_what_they_say(spark, documents):
    docs, seen = documents, {}
    for name, stage in pipeline.STAGES:
        before, docs = docs, materialise(stage(spark, docs, DATA), f"test-{name}")
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == documents.columns
    before, after = seen["language_id"]
    assert before.join(after, "doc_id", "left_anti").count() == 0
    before, after = seen["near_duplicates"]
    found = brute_join([(r["doc_id"], r["text"]) for r in before.collect()], 5, 80)
    assert sorted(str(r["doc_id"]) for r in after.collect()) == sorted(d for d, n, c, _ in found if d == c or not n)
    before, after = seen["secret_scan"]
    assert before.count() == after.count()
    kept = {r["doc_id"]: r["text"] for r in after.collect()}
    for r in before.collect():
        assert not by_hand(kept[r["doc_id"]])
        if not by_hand(r["text"]):
            assert kept[r["doc_id"]] == r["text"]
    before, after = seen["mixing"]
    assert after.join(before, before.columns, "left_anti").count() == 0
    before, after = seen["packing"]
    t = Tokenizer.from_file(tokens.default_path())
    copies = Counter(r["doc_id"] for r in before.collect())
    want = sum(copies[d] * (len(t.encode(x, add_special_tokens=False).ids) + 1) for d, x in {r["doc_id"]: r["text"] for r in before.collect()}.items())
    assert after.agg(F.sum("length")).first()[0] == want


def test_odd_rows_go_through(spark, odd):
    docs = odd
    for _, stage in pipeline.STAGES:
        docs = materialise(stage(spark, docs, DATA), "test-odd")
    assert docs.count() > 0


def test_empty_documents_go_through(spark, empty):
    docs = empty
    for _, stage in pipeline.STAGES:
        docs = materialise(stage(spark, docs, DATA), "test-empty")
    assert docs.count() == 0


def test_near_duplicates_take_five_words_and_four_fifths():
    assert jaccard.one_of_each.__defaults__ == (5, 80)
