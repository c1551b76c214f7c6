"""Groups of similar texts: what repeats, dense groups, repeat counts and short texts must not change."""

import random

from scriptloom.llm import simhash

LINE = "one line of nine words that comes back again"


def grouped(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}


def words(seed, n):
    rng = random.Random(seed)
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def test_a_repeated_line_does_not_join_unrelated_texts(spark):
    texts = [" ".join(words(k, 400)) + f"\n{LINE}" * 50 for k in range(2)]
    assert grouped(spark, texts) == {0: 0, 1: 1}


def test_a_link_to_any_text_of_a_dense_group_counts(spark):
    head = words(1, 400)
    near = [*head]
    near[20:200:26] = words(2, 7)
    far = [*near]
    far[220:400:26] = words(3, 7)
    texts = [" ".join(head) + f"\n{LINE}" * 50, " ".join(near) + f"\n{LINE}" * 50, " ".join(far) + f"\n{LINE}"]
    assert grouped(spark, texts) == {0: 0, 1: 0, 2: 0}


def test_repeat_counts_do_not_matter(spark):
    base = " ".join(words(4, 400))
    assert grouped(spark, [base + f"\n{LINE}" * n for n in (2, 20, 50)]) == {0: 0, 1: 0, 2: 0}


def test_short_texts_are_found(spark):
    texts = [" ".join(w[:n]) for k in range(300) for w in [words(100 + k, 9)] for n in (8, 9)]
    assert grouped(spark, texts) == {i: i - i % 2 for i in range(600)}


def test_groups_of_drifting_copies_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    texts = [words(5, 120)]
    for _ in range(150):
        own = [*rng.choice(texts[-20:])]
        for _ in range(rng.randrange(1, 6)):
            own[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        texts.append(own)
    sets = [{tuple(t[i : i + 5]) for i in range(116)} for t in texts]
    label = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j in range(i):
                if label[i] != label[j] and len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    assert grouped(spark, [" ".join(t) for t in texts]) == dict(enumerate(label))
