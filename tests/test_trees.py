"""Trees by pointer doubling, style clauses by their words, passages without blanks."""

import random

import pytest
from pyspark.sql import functions as F

from scriptloom.operators import styles as S
from scriptloom.operators import trees as R
from scriptloom.operators.passages import LONG, PIECE, find_passages

CARDS = "card_id string, parent_id string, title string, sample_url string, lifecycle string, built_in boolean"


def cards(spark):
    """A chain of 50, a bush on it, a card without its parent, a ring with a tail, a card below itself."""
    rows = [(f"c{i}", f"c{i - 1}" if i else None) for i in range(50)] + [(f"b{i}", f"c{i % 50}") for i in range(200)]
    rows += [("lost", "nowhere"), ("r0", "r2"), ("r1", "r0"), ("r2", "r1"), ("t0", "r1"), ("t1", "t0"), ("self", "self")]
    return spark.createDataFrame([(c, p, c.upper(), f"s-{c}" if c in ("c3", "c20", "b7", "r0") else None, "library", c == "c30") for c, p in rows], CARDS), dict(rows)


def way(parents, card):
    found = []
    while card in parents and card not in found:
        found.append(card)
        card = parents[card]
    return found, card in found


def test_trees_equal_walking_up(spark):
    table, parents = cards(spark)
    ways = {c: way(parents, c) for c in parents}
    assert {r.card_id for r in R.cyclic_cards(table).collect()} == {c for c, (_, ring) in ways.items() if ring} == {"r0", "r1", "r2", "t0", "t1", "self"}
    paths = {r.card_id: (r.path, r.depth) for r in S.style_paths(table).collect()}
    assert paths == {c: (None, None) if ring else (" / ".join(x.upper() for x in reversed(up)), len(up) - 1) for c, (up, ring) in ways.items()}
    pairs = {(r.card_id, r.ancestor_id, r.depth) for r in R.ancestors(table).collect()}
    assert pairs == {(c, a, d) for c, (up, ring) in ways.items() if not ring for d, a in enumerate(up)}
    samples = {r.card_id: (r.sample_url, r.from_depth) for r in S.inherited_sample(table).collect()}
    own = {"c3", "c20", "b7", "r0"}
    assert samples == {c: next(((f"s-{a}", d) for d, a in enumerate(up) if a in own), (None, None)) for c, (up, _) in ways.items()}
    roots = spark.createDataFrame([("c40",), ("r1",), ("c30",), ("absent",)], "card_id string")
    assert {r.card_id for r in S.subtree(table, roots).collect()} == {c for c, (up, _) in ways.items() if ("c40" in up or "r1" in up) and c != "c30"}
    for found in (R.cyclic_cards, S.style_paths, R.ancestors, S.inherited_sample):
        assert found(table.limit(0)).count() == 0


@pytest.mark.parametrize("clause, stays", [
    ("oil painting", True), ("a knight with a rough metallic shield", False), ("elderly lady in a wide hat", False), ("角色走进大门", False), ("阳光下的狗", False), ("柔光", True), ("低饱和的冷色调", True),
    ("close-up", True), ("lineage", False), ("fine lines", True), ("wide", False), ("a pencil", False), ("soft", False), ("Film  Grain", True), ("Victorian dress, ", False), ("red coat", False), ("rule of thirds composition", True),
])
def test_style_clauses(spark, clause, stays):
    assert spark.range(1).select(S.style_only(F.lit(clause)).alias("x")).first().x == (clause.strip() if stays else "")


def test_passages_in_a_long_text_without_blanks(spark):
    rng = random.Random(9)
    text = "".join(rng.choices("天地人你我他山水火木金土日月星云风雨雪花草树鸟鱼马牛羊大小上下左右𠀀", k=PIECE + 5000))
    cuts = [(0, 40), (PIECE - 20, PIECE + 20), (PIECE - LONG, PIECE), (PIECE, PIECE + LONG), (PIECE - 5, PIECE + 7), (len(text) - 33, len(text)), (17, 18), (500, 1800)]
    quotes = [text[a:b] for a, b in cuts] + [text[a:b] + "没" for a, b in cuts]
    found = find_passages(spark.createDataFrame([(1, text), (2, text[:30]), (2, text[:30])], "script_id long, text string"), spark.createDataFrame(list(enumerate(quotes)), "quote_id long, quote string"))
    assert sorted(map(tuple, found.collect())) == [(1, i) for i in range(len(cuts))] + [(2, i) for i, q in enumerate(quotes) if q in text[:30]]


def test_passages_are_not_shuffled_and_equal_quotes_are_searched_once(spark):
    texts = spark.createDataFrame([(i, "天地人" * i + "x") for i in range(40)], "script_id long, text string")
    quotes = spark.createDataFrame([(j, q) for j, q in enumerate(["天"] * 50 + ["天地人" * 12, "x", "人x", "山"])], "quote_id long, quote string")
    found = find_passages(texts, quotes)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in plan and "Exchange hashpartitioning" not in plan
    expected = [(i, j) for i in range(40) for j in range(53) if j < 50 and i > 0 or j == 50 and i >= 12 or j == 51 or j == 52 and i > 0]
    assert sorted(map(tuple, found.collect())) == expected
    assert sorted(map(tuple, find_passages(texts, quotes, most_bytes=0).collect())) == expected
    assert find_passages(texts, quotes.limit(0)).count() == 0


def test_quotes_beyond_one_block_shuffle_no_pairs(spark):
    texts = spark.createDataFrame([(i, "天地人" * i + "x") for i in range(40)], "script_id long, text string")
    quotes = spark.createDataFrame([(j, q) for j, q in enumerate(["天"] * 5 + ["天地人" * 12, "x", "人x", "山"])], "quote_id long, quote string")
    found = find_passages(texts, quotes, most_bytes=20)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Union" in plan and "Exchange hashpartitioning" not in plan
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, find_passages(texts, quotes).collect()))


def test_passages_of_repeated_ids_count_once(spark):
    texts = [(1, "天地"), (1, "天地"), (2, "天"), (2, "天人"), (3, "人"), (None, "天"), (None, "天地")]
    quotes = [("a", "天"), ("a", "人"), ("a", "天"), ("b", "地"), ("c", "天"), (None, "地"), (None, "人")]
    found = find_passages(spark.createDataFrame(texts, "script_id long, text string"), spark.createDataFrame(quotes, "quote_id string, quote string"))
    expected = {(i, j) for i, t in texts for j, q in quotes if q in t}
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, expected))
