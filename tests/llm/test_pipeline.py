"""The pipeline's stages against brute force on small tables."""

import re

import corpus_pipeline as P
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from scriptloom.llm.quality import score_quality
from scriptloom.llm.scratch import durable

SF = "/root/testdata/sf0.001"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {"documents": docs}
    for name, stage in P.STAGES:
        docs = durable(stage(spark, docs, SF), name)
        found[name] = docs
    return found


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_shapes(spark, stages):
    assert [name for name, _ in P.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "tokens"]
    assert all(stages[n].columns == P.COLUMNS for n, _ in P.STAGES[:-1])
    assert sorted(r.doc_id for r in P.run(spark, SF).select("doc_id").collect()) == sorted(rows(stages["tokens"]))


def test_quality(spark, stages):
    scored = score_quality(stages["documents"], spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert set(rows(stages["quality"])) == {r.doc_id for r in scored if r.score >= 0.5}


def test_near_duplicates(stages):
    def shingles(text):
        words = (text or "").encode().translate(LOWER).split()
        return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    docs = {i: shingles(r.text) for i, r in rows(stages["quality"]).items()}
    label = {i: i for i in docs}
    changed = True
    links = [(a, b) for a in docs for b in docs if a < b and len(docs[a] & docs[b]) >= 0.8 * len(docs[a] | docs[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if (label[a], label[b]) != (low, low):
                label[a] = label[b] = low
                changed = True
    assert set(rows(stages["near_duplicates"])) == {i for i in docs if label[i] == i}


def test_decontamination(spark, stages):
    words = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().translate(LOWER))
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1) if n}
    sizes = {len(w) for w in windows}

    def hit(text):
        w = words(text)
        return any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))

    before = rows(stages["near_duplicates"])
    assert set(rows(stages["decontamination"])) == {i for i, r in before.items() if not hit(r.text)}


def test_secrets(stages):
    before, after = rows(stages["decontamination"]), rows(stages["secrets"])
    assert set(before) == set(after)
    for i, r in after.items():
        wanted = re.sub(r'(token = ")[0-9a-f]{40}(")', r"\1[SECRET]\2", before[i].text, flags=re.I)
        assert (r.text, r.n_chars) == (wanted, len(wanted))


def test_tokens(stages):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    texts = rows(stages["secrets"])
    for i, r in rows(stages["tokens"]).items():
        assert list(r.token_ids) == library.encode(texts[i].text, add_special_tokens=False).ids
