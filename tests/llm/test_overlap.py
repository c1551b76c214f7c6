"""The T-occurrence search against all pairs of whole sets."""

import random
import re

import numpy as np
import pytest

from scriptloom.llm import overlap, simhash

SCHEMA = "doc_id long, text string, node long, key int, n int, component_id string"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def brute(rows):
    rows = [(i, t) for i, t in rows if i is not None]
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= 80 * len(sets[a] | sets[b]):
                label[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), i), i)
    return sorted((i, len(sets[k]), least[root(k)]) for k, (i, _) in enumerate(rows))


def found(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, 1, 2, 3, "x") for i, t in rows], SCHEMA)
    return sorted(tuple(r) for r in overlap.jaccard_groups(docs, **options).collect())


@pytest.mark.parametrize(("block", "long_list"), [(1024, 1000), (2, 3)])
def test_groups_equal_all_pairs(spark, monkeypatch, block, long_list):
    monkeypatch.setattr(overlap, "BLOCK", block)
    monkeypatch.setattr(simhash, "LONG_LIST", long_list)
    rng = random.Random(3)
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "no id"), (4, "one two"), (5, "ONE  two"), (6, "a b c d e"), (7, "a b c d e f"), (7, "a b c d e"), (8, "É é")]
    template = [f"t{i}" for i in range(60)]
    for g in range(8):  # drifting chains of edits, and one template with other fillings
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([7, 30, 200]))]
        for k in range(12):
            words = [*words]
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(9)}"
            rows.append((100 + 20 * g + k, " ".join(words)))
    rows += [(500 + k, " ".join(template + [f"f{k}x{i}" for i in range(rng.choice([5, 12, 30]))])) for k in range(15)]
    rows += [(600 + k, " ".join(template + [f"f{k % 3}x{i}" for i in range(13)])) for k in range(6)]
    rows += [(700, "long " * 30_000), (701, "long " * 29_000)]
    assert found(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert overlap.jaccard_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_probing_equals_counting():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a, b = (np.unique(rng.integers(0, 1500, rng.integers(0, 1500)).astype(np.uint64)) for _ in "ab")
        b = b if rng.random() < 0.3 else np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], b[: rng.integers(0, 60)]]))
        common = len(np.intersect1d(a, b))
        assert overlap.overlap_reaches(a, b) == bool(len(a) and len(b) and 100 * common >= 80 * (len(a) + len(b) - common))


def test_long_texts_that_share_a_passage_are_told_apart_by_counts(spark):
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    passage = words(100)
    rows = [(i, " ".join(passage + words(rng.choice([2400, 2500, 5000])))) for i in range(12)]
    base = words(4000)
    rows += [(20 + k, " ".join([*base[: 200 * k], *words(200), *base[200 * k + 200 :]])) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    firsts = simhash.shingle_sets(docs, 5, lambda own: own).cache()
    ids = firsts.select("doc_id", "node")
    pairs = ids.toDF("a", "u").join(ids.toDF("b", "v")).where("a < b")
    near = simhash._near(pairs.select("u", "v"), firsts, 0.8)
    assert sorted(tuple(r) for r in near.join(pairs, ["u", "v"]).select("a", "b").collect()) == [(20 + i, 20 + j) for i in range(4) for j in range(i + 1, 4)]


def test_counts_are_a_lower_bound():
    rng = np.random.default_rng(6)
    for n in (1024, 1025, 2048, 2049, 70_000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 63, rng.integers(n // 10, n // 4), dtype=np.uint64)]))
        if len(b) >= simhash.COUNTED and len(a) >= simhash.COUNTED:
            apart = simhash.counts_apart(simhash.bucket_counts(a), simhash.bucket_counts(b))
            assert 0 < apart <= len(np.setxor1d(a, b)) and apart == simhash.counts_apart(simhash.bucket_counts(b), simhash.bucket_counts(a))
        assert simhash.bucket_counts(a[:1000]) is None
    same = np.arange(0, 1 << 20, 256, dtype=np.uint64)  # all in one bucket: counts stop at 255
    assert simhash.counts_apart(simhash.bucket_counts(same), simhash.bucket_counts(same[:2000])) <= len(same) - 2000


def test_copies_are_taken_apart_once(spark):
    rows = [(i, i % 3, 4, [7, 8, 9 + i % 3]) for i in range(30)] + [(90, 5, 4, [70])]
    sets = spark.createDataFrame(rows, "doc_id long, node long, n long, keys array<long>")
    shared = simhash._shared_keys(sets)
    assert sorted((r.key, r.node, r.k) for r in shared.collect()) == [(key, node, 3) for key in (7, 8) for node in range(3)]
    assert shared.select("nodes").distinct().count() == 1
