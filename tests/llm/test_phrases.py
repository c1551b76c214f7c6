"""Count transducers against dictionaries, collocations against counting everything."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from scriptloom.llm import phrases
from scriptloom.llm.transducer import PAD, built, summed, union

SCHEMA = "doc_id long, text string, lang string, rank int, n int, a string, number long"


def spelt(grams):
    return [tuple(x for x in row if x != PAD) for row in grams.tolist()]


@pytest.mark.parametrize("seed", range(40))
def test_transducers_count_like_dictionaries(seed):
    rng = np.random.default_rng(seed)
    rows, width = int(rng.integers(0, 300)), int(rng.integers(1, 5))
    raw = np.where(np.arange(width) < rng.integers(1, width + 1, rows)[:, None], rng.integers(-4, 4, (rows, width)), PAD)
    expected = Counter(spelt(raw))
    made = built(*summed(raw, np.ones(rows, dtype=np.int64)), slice_size=7)
    grams, counts = made.phrases()
    assert dict(zip(spelt(grams), counts.tolist(), strict=True)) == expected
    asked = np.where(np.arange(width + 1) < rng.integers(0, width + 2, 100)[:, None], rng.integers(-5, 5, (100, width + 1)), PAD)
    assert made.compose(asked).tolist() == [expected.get(x, 0) for x in spelt(asked)]
    grams, counts = union([made, made, built(raw[:0], counts[:0])], width)
    assert dict(zip(spelt(grams), counts.tolist(), strict=True)) == {k: 2 * v for k, v in expected.items()}


def test_equal_subtrees_are_one_state():
    grams = np.array([[a, b, c] for a in range(50) for b in range(20) for c in range(10)])
    made = built(grams, np.arange(len(grams)))
    assert len(made.final) == 4 and made.compose(grams).tolist() == list(range(10_000))


def brute(rows, least, top):
    counts, totals = {}, Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        kept = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            longer = [q for q in f if f[q] >= least and len(p) < len(q) <= 4 and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * f[q] >= 80 * a for q in longer):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def made(seed):
    rng = random.Random(seed)
    words = [*"abcdefg", "É", "中文", "x" * 5000, "the", "of"]
    weights = [5, 4, 3, 2, 1, 1, 1, 1, 1, 0.05, 9, 7]
    rows = [(i, " ".join(w + rng.choice(["", "", "", "", ",", ".", "\n", "\t", "!?"]) for w in rng.choices(words, weights, k=rng.choice([0, 1, 3, 40, 200]))), rng.choice(["en", "fr", None])) for i in range(60)]
    hot = "The quick brown fox jumps over " * 40
    return [*rows, (1, rows[0][1], "en"), (2, None, "en"), (3, None, None), (4, "", "de"), (5, " .\v. ", "de"), (None, hot, "en"), (None, hot.upper(), "en"), (9, "a b " * 40_000, "long")]


@pytest.mark.parametrize(("least", "top", "buckets"), [(5, 2000, 1), (2, 25, 7), (30, 3, 4)])
def test_collocations_equal_counting(spark, least, top, buckets):
    rows = made(4)
    docs = spark.createDataFrame([(i, t, x, 1, 2, "c", 3) for i, t, x in rows], SCHEMA)
    found = phrases.collocations(docs, least=least, top=top, buckets=buckets)
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, least, top)


def test_nothing_to_find(spark):
    docs = spark.createDataFrame([(1, "one two three", "en", 1, 2, "c", 3)], SCHEMA)
    assert phrases.collocations(docs).count() == 0 and phrases.collocations(docs.limit(0)).count() == 0


def test_words_with_one_number_are_numbered_anew(spark, monkeypatch):
    seen = []
    real = phrases.word_counts

    def collide(docs, seed=0):
        seen.append(seed)
        words = real(docs, seed)
        return words.withColumn("number", words.number * 0) if not seed else words

    monkeypatch.setattr(phrases, "word_counts", collide)
    docs = spark.createDataFrame([(1, "one two " * 40, "en", 1, 2, "c", 3)], SCHEMA)
    assert [r.phrase for r in phrases.collocations(docs).collect()] and seen == [0, 1]
