"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from scriptloom.llm import ann, bpe, decontaminate, language, quality, repeats, secrets, simhash, toxicity, urls
from scriptloom.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, key int, id long, label string, y int, bucket int, score double"
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu " * 20_000
ROWS = [(1, "Same text here, twice over and again, with token = \"9f86d081884c7d659a2feaa0c55ad015a3bf4f1b\" inside."), (2, "Same text here, twice over and again, with token = \"9f86d081884c7d659a2feaa0c55ad015a3bf4f1b\" inside."),
        (2, "Same text here, twice over and again, with token = \"9f86d081884c7d659a2feaa0c55ad015a3bf4f1b\" inside."), (3, None), (4, ""), (5, " \n\t "), (None, "no id at all in this row"), (None, None),
        (6, LONG), (7, "é Ω 中文 🎉"), (8, "12345 !!! ---")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en" if i and i % 2 else None, "s", 1, "x", 1, 2, "l", 3, 4, 0.5) for i, t in ROWS], SCHEMA).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def test_simhash(docs, none):
    rows = simhash.near_duplicate_groups(docs).collect()
    assert len(rows) == len(ROWS) and sorted({r.component_id for r in rows if r.doc_id in (1, 2)}) == [1]
    assert {r.component_id for r in rows if r.doc_id in (3, 4, 5)} == {3}
    assert all(r.fp == 0 for r in rows if r.doc_id in (3, 4, 5))
    assert simhash.near_duplicate_groups(none).count() == 0
    kept = simhash.first_of_each_group(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 3, 6, 7, 8]
    assert kept.where("doc_id is null").count() == 2 and simhash.first_of_each_group(none).count() == 0


def test_similar_texts_group_and_others_stay(spark):
    base = [f"w{i * i % 977}x{i}" for i in range(200)]
    near = [*base[:60], "changed", *base[61:]]
    far = [w + "q" for w in base]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate([base, near, far, base])], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()} == {0: 0, 1: 0, 2: 2, 3: 0}


def test_templates_that_a_sample_missed_change_nothing(spark, monkeypatch):
    rng = random.Random(8)
    head = " ".join(f"h{i}" for i in range(40))
    texts = [f"{head} " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.choice([5, 30]))) for _ in range(40)]
    texts += [f"{t} end" for t in texts[::3]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = sorted(map(tuple, simhash.similar_groups(docs).collect()))
    monkeypatch.setattr(simhash, "frequent_shingles", lambda *_: (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    monkeypatch.setattr(simhash, "LONG_LIST", 5)
    assert sorted(map(tuple, simhash.similar_groups(docs).collect())) == expected and len({c for _, c in expected}) < len(expected)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(7, 7), (100, 101), (101, 100), (None, 5)], "u long, v long")
    found = {r.node: r.label for r in connected_components(edges).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert connected_components(edges.limit(0)).count() == 0


def test_decontamination(spark, docs, none):
    words = LONG.split()
    items = spark.createDataFrame([(1, " ".join(words[3:20])), (2, "same TEXT here"), (3, None), (4, ""), (None, "twice over"), (5, "absent words only")], "item_id long, text string")
    for limit in (1 << 20, -1):
        rows = decontaminate.find_contamination(docs, items, broadcast_bytes=limit).collect()
        found = {r.doc_id: (r.n_words, r.n_hit, list(r.item_ids)) for r in rows if r.doc_id}
        assert len(rows) == len(ROWS) and found[3] == found[4] == found[5] == (0, 0, [])
        assert found[1] == found[2] == (11, 5, [2]) and found[6][::2] == (240_000, [1])
        assert found[6][1] > 239_900  # but for the ends, every word is in some window
    assert decontaminate.find_contamination(none, items).count() == 0
    assert {tuple(r.item_ids) for r in decontaminate.find_contamination(docs, items.limit(0)).collect()} == {()}
    kept = decontaminate.clean_documents(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 3, 4, 5, 7, 8]


def test_winnowing_finds_every_long_span(spark):
    text = [f"v{i * 7919 % 5000}" for i in range(300)]
    docs = spark.createDataFrame([(k, " ".join(["pad"] * k + text[k : k + 10] + ["end"] * 9)) for k in range(200)], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(text))], "item_id long, text string")
    assert all(r.n_hit == 10 for r in decontaminate.find_contamination(docs, items).collect())


def test_repeats(docs, none):
    rows = {(r.doc_id, r.level): r for r in repeats.repeated_spans(docs).where("doc_id < 6").collect()}
    assert (2, "line") in rows and rows[2, "line"].first_id == 1 and (1, "line") not in rows
    cut = repeats.without_repeats(docs)
    assert cut.columns == [*docs.columns, "removed"] and cut.count() == len(ROWS)
    assert {r.text for r in cut.where("doc_id = 2").collect()} == {""} and cut.where("doc_id = 3 and text is null").count() == 1
    assert repeats.spans_by_document(none).count() == 0 and repeats.spans_by_document(docs).count() == len(ROWS)


def test_secrets(docs, none):
    rows = {r.doc_id: r.findings for r in secrets.find_secrets(docs).collect()}
    assert [f.secret for f in rows[1]] == [True] and not any(f.secret for f in rows[6]) and rows[3] == []
    clean = secrets.redact_secrets(docs)
    assert clean.columns == docs.columns and clean.where("doc_id = 1").first().text.count("[SECRET]") == 1
    assert clean.where("doc_id = 3 and text is null").count() == 1 and secrets.find_secrets(none).count() == 0
    assert secrets.find_secrets(docs, path_col=None).count() == len(ROWS)


def test_classifiers_without_labels(spark, docs, none):
    for score in (toxicity.score_toxicity, quality.score_quality):
        rows = score(docs, labels(spark)).collect()
        assert len(rows) == len(ROWS) and len({r.score for r in rows}) == 1
        assert score(none, labels(spark)).count() == 0
        odd = labels(spark, [(1, 1, 1), (1, 0, 0), (6, None, None), (7, 5, 5), (None, 1, 1), (3, 1, 1)])
        assert all(0 <= r.score <= 1 for r in score(docs, odd).collect())
    kept = quality.good_documents(docs, labels(spark))
    assert kept.columns == docs.columns and kept.count() == len(ROWS)


def test_language(docs, none):
    rows = language.identify_language(docs).collect()
    assert len(rows) == len(ROWS) and {r.lang_pred for r in rows if r.doc_id in (3, 4, 5, 8)} == {"und"}
    assert {r.lang_pred for r in rows if r.doc_id in (1, 7)} == {"en"}
    assert {r.lang_pred for r in language.identify_language(docs, docs.where("lang is null")).collect()} == {"und"}
    assert {r.lang_pred for r in language.identify_language(docs, reject_below=1.1).collect()} == {"und"}
    assert language.identify_language(none).count() == 0


def test_tokens(docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = bpe.encode_texts(docs, path)
    found = {r.doc_id: r for r in rows.collect()}
    assert rows.count() == len(ROWS) and found[3].n_tokens == found[4].n_tokens == found[5].n_tokens == 0
    decoded = bpe.decode_ids(rows, path).where("doc_id = 8").first()
    assert decoded.decoded.startswith("1</w> 2</w>") and bpe.encode_texts(none, path).count() == 0


def test_neighbours(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(0, [1.0, 0.0]), (50, [1.0, 0.1]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (None, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, [-1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in vectors], "vec_id long, embedding array<float>, score int, bucket string")
    rows = {(r.query_id, r["rank"]): r.vec_id for r in ann.nearest_neighbours(df, F.col("vec_id") % 50 == 0, k=5).collect()}
    assert rows == {(0, 1): 1, (0, 2): 2, (0, 3): 50, (0, 4): 10, (50, 1): 0, (50, 2): 1, (50, 3): 2, (50, 4): 10}
    assert ann.nearest_neighbours(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_urls(spark):
    pages = spark.createDataFrame([(None, None, "x"), (1, "", "x"), (1, "http://a.org/" + "p" * 10_000, "x"), (1, "http://a.org/" + "p" * 10_000, "x")], "page_id long, url string, host string")
    assert urls.judge_urls(pages).count() == 4 and urls.judge_urls(pages.limit(0)).count() == 0
