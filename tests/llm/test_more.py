"""Long words, extreme vectors, ids of other kinds, bounded samples, and every pipeline stage on odd rows."""

import random

import corpus_pipeline as P
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scriptloom.llm import decontaminate as D
from scriptloom.llm import training as T
from scriptloom.llm import urls as U
from scriptloom.llm.ann import nearest_neighbours
from scriptloom.llm.bpe import Vocabulary, encode_texts
from scriptloom.llm.secrets import Forest, features, find_secrets, labelled_findings, redact_secrets

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def test_a_word_of_a_million_letters(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n)) for n in (99, 100, 101, 5000, 1_000_000)] + ["ab" * 3000, "é" * 2000]
    library = Tokenizer.from_file(TOKENIZER)
    library.no_truncation()
    library.no_padding()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in encode_texts(docs, TOKENIZER).collect():
        assert list(r.token_ids) == library.encode(texts[r.doc_id], add_special_tokens=False).ids


def test_both_ways_of_merging_agree():
    with open(TOKENIZER, encoding="utf-8") as file:
        vocabulary = Vocabulary(file.read())
    rng = random.Random(4)
    for _ in range(200):
        word = "".join(rng.choices("aeinorst", k=rng.randrange(2, 90)))
        parts = [vocabulary.ids[u] for u in (*word[:-1], word[-1] + vocabulary.end)]
        assert vocabulary._merge_long(parts) == vocabulary.merge(word)


def test_extreme_components(spark):
    rows = [(0, [2.0**600, 2.0**601]), (50, [2.0**-600, 2.0**-599]), (1, [4.0, 8.0]), (2, [2.0, -1.0]), (3, [1e308, 1e308])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = nearest_neighbours(vectors, F.col("vec_id") % 50 == 0, k=2)
    best = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in found.collect()}
    assert {k: v[0] for k, v in best.items()} == {(0, 1): 1, (0, 2): 50, (50, 1): 0, (50, 2): 1}
    assert all(abs(v[1] - 1) < 1e-12 for v in best.values())


def test_item_ids_may_be_text(spark):
    words = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"a {words} b"), (2, "nothing")], "doc_id long, text string")
    items = spark.createDataFrame([("x-1", words), ("x-2", "other words entirely"), (None, words)], "item_id string, text string")
    for limit in (D.BROADCAST_BYTES, 0):
        found = {r.doc_id: (r.n_hit, r.item_ids) for r in D.find_contamination(docs, items, broadcast_bytes=limit).collect()}
        assert found[1][0] == 12 and set(found[1][1]) - {None} == {"x-1"} and found[2] == (0, [])


def test_samples_are_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(i, "x" * (1000 if i != 7 else 50_000)) for i in range(40)], "doc_id long, text string")
    sample = docs.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 2).cast("int").alias("y"))
    rows = T.sampled_texts(docs, sample, "doc_id", "text", most_bytes=10_000).collect()
    assert 9 <= len(rows) <= 10 and all(len(r.text) == 1000 for r in rows)
    assert T.sampled_texts(docs, sample, "doc_id", "text").count() == 40


def test_secrets_offsets_in_long_texts(spark):
    token = "0123456789abcdef0123456789abcdef01234567"
    text = "é" * 5000 + "".join(f'\nmaß {i} token = "{token}" ;' for i in range(300))
    docs = spark.createDataFrame([(1, text, "a"), (2, None, None), (3, "", "b")], "doc_id long, text string, source string")
    found = {r.doc_id: r.findings for r in find_secrets(docs).collect()}
    assert len(found[1]) == 300 and all(text[f.start : f.end] == token for f in found[1]) and found[2] == found[3] == []
    assert redact_secrets(docs).where("doc_id = 1").first().text == text.replace(token, "[SECRET]")


def test_values_assigned_to_secret_words(spark):
    rows = {
        1: ('password = "Tr0ub4dor&3"', ["Tr0ub4dor&3"]), 2: ("export API_KEY=abcdefghijklmnopqrstuvwx\n", ["abcdefghijklmnopqrstuvwx"]),
        3: ("maß 🎉 Password: 'Füchse77!' x", ["Füchse77!"]), 4: ("password: required, token = null", []), 5: ("secret = ${DB_SECRET}", []),
        6: ("the treaty of 1648, by which they signed: nothing", []), 7: ('token = "', []), 8: ("key=" * 50_000, None),
        9: ("password=ghp_0123456789abcdefghijABCDEFGHIJ012345 and on", ["ghp_0123456789abcdefghijABCDEFGHIJ012345"]),
    }
    docs = spark.createDataFrame([(i, t, None) for i, (t, _) in rows.items()], "doc_id long, text string, source string")
    found = {r.doc_id: r.findings for r in find_secrets(docs).collect()}
    for i, (text, wanted) in rows.items():
        if wanted is not None:
            assert [text[f.start : f.end] for f in found[i] if f.secret] == wanted
    clean = {r.doc_id: r.text for r in redact_secrets(docs).collect()}
    assert clean[1] == 'password = "[SECRET]"' and clean[3] == "maß 🎉 Password: '[SECRET]' x" and clean[4] == rows[4][0]


def test_secrets_that_overlap_get_one_mark(spark):
    text = 'password = "Zq7!kd 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b W#81x" end'
    docs = spark.createDataFrame([(1, text, "a")], "doc_id long, text string, source string")
    assert redact_secrets(docs).first().text in ('password = "[SECRET]" end', 'password = "Zq7!kd [SECRET] W#81x" end')


def test_forest_on_findings_of_another_seed():
    x, y = zip(*[(features(c, b, a, p), label) for label, c, b, a, p in labelled_findings(400, seed=99)], strict=True)
    xt, yt = zip(*[(features(c, b, a, p), label) for label, c, b, a, p in labelled_findings()], strict=True)
    guess = Forest(np.array(xt), np.array(yt)).predict(np.array(x)) >= 0.5
    assert np.mean(guess == np.array(y)) > 0.97


def test_no_judged_host_is_among_the_labelled_ones(spark):
    hosts = {r.h for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select(U.host_of(F.col("url")).alias("h")).distinct().collect()}
    assert len(U.labelled_urls()) >= 200 and not hosts & {h for _, h, _ in U.labelled_urls()}


STAGES = dict(P.STAGES)
LONG = "a long text of many words goes on and on until it is very long indeed. " * 3000
BASE = "It was a cold bright morning and the clocks in the old town were striking, one after another, as they always did."


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_stages_on_odd_rows(spark, name):
    rows = [(1, BASE, "en", "s", 9), (2, None, None, None, None), (3, "", "en", "s", 0), (None, BASE + " And so it went.", "en", "s", 9),
            (4, BASE, "en", "s", 9), (4, BASE, "en", "s", 9), (5, LONG, "de", "s", 1), (6, " \n\t ", "en", "s", 4), (7, "one", "en", "s", 3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    clashing = docs.select(*docs.columns, *[F.lit(1).alias(c) for c in ("node", "key", "component_id", "score", "item_id", "label", "word", "fp")])
    plain = [r.asDict(True) for r in STAGES[name](spark, docs, "/root/testdata/sf0.001").collect()]
    wide = STAGES[name](spark, clashing, "/root/testdata/sf0.001")
    order = lambda found: sorted(map(repr, found))
    assert order(plain) == order([{c: r[c] for c in plain[0]} for r in (x.asDict(True) for x in wide.collect())])
    ids = [r["doc_id"] for r in plain]
    if name == "near_duplicates":  # null ids stay; of equal texts, and of texts without words, the smallest id
        assert sorted(ids, key=repr) == sorted([1, 2, 5, 7, None], key=repr)
    if name in ("secrets", "tokens"):
        assert len(ids) == len(rows)
    if name == "decontamination":
        assert len(ids) == len(rows)
    assert STAGES[name](spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0
