"""Small golden cases."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptloom.functions import text as T
from scriptloom.operators import profile as P
from scriptloom.operators import score as S
from scriptloom.operators import units as U
from scriptloom.operators import verify as V
from scriptloom.operators.fountain import classify_elements, classify_plain_lines, cue_name
from scriptloom.operators.passages import find_passages
from scriptloom.operators.styles import near_duplicate_signatures, style_only
from scriptloom.plans import compile as X
from scriptloom.sources import catalogs as C


def one(spark, column, **values):
    rows = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return rows.select(column.alias("x")).first().x


@pytest.mark.parametrize("given, number", [("1", 1), ("０7", 7), ("十", 10), ("十二", 12), ("二十一", 21), ("一百零五", 105), ("两千", 2000), ("一二", 2), ("零", None), ("万", None)])
def test_numerals(spark, given, number):
    assert one(spark, T.chinese_number(F.col("t")), t=given) == number


@pytest.mark.parametrize("line, marker", [
    ("第1集：晨雾", (1, "晨雾")), ("EP 2 - 渡口", (2, "渡口")), ("　第十二话　", (12, "")), ("3集", (3, "")),
    ("第1集 标题", None), ("他看了第1集。", None), ("E12345", None), ("第0集", None),
])
def test_episode_markers(spark, line, marker):
    found = one(spark, T.episode_marker(F.col("t")), t=line)
    assert (tuple(found) if found else None) == marker


def test_episodes_of_scenes(spark):
    lines = ["第1集：晨雾", "内. 书店 - 早", "阿宁数着零钱。", "EP 2 - 渡口", "外. 码头 - 晚", "阿宁等最后一班船。"]
    units = U.source_units(spark.createDataFrame([(1, "\n".join(lines))], "script_id long, text string"))
    scenes = spark.createDataFrame(
        [(1, "a", 0, "内. 书店 - 早", ["U000002", "U000003"], None, None), (1, "b", 1, "外. 码头 - 晚", ["U000005", "U000006"], None, None)],
        "script_id long, scene_id string, scene_order int, heading string, unit_ids array<string>, episode_number int, episode_title string",
    )
    rows = {r.scene_id: (r.episode_number, r.episode_title, r.unresolved) for r in U.episode_index(scenes, units).collect()}
    assert rows == {"a": (1, "晨雾", False), "b": (2, "渡口", False)}


def test_summaries_keep_each_line_once(spark):
    a, b, c = "码头的老船工，话少。", "码头的船工，话少。", "退休前最后一年。"
    merged = T.consolidate_summaries(*[F.col(x) for x in "abcd"])
    text = one(spark, merged, a=a, b=b, c=c, d=a)
    assert text == "\n".join([a, b, c])
    assert one(spark, T.consolidate_summaries(F.col("x"), F.col("y")), x=text, y=text) == text


@pytest.mark.parametrize("url, resolved", [
    ("https://example.com/v1", "https://example.com/v1/chat/completions"),
    ("https://example.com/v1/chat/completions/", "https://example.com/v1/chat/completions"),
    ("not-a-url", None),
])
def test_endpoints(spark, url, resolved):
    assert one(spark, T.resolve_endpoint(F.col("u")), u=url) == resolved


def relink(spark, new, old):
    schema = "script_id long, scene_order int, heading string"
    parsed = spark.createDataFrame([(1, i, h) for i, h in enumerate(new)], schema)
    previous = spark.createDataFrame([(1, i, h, s) for i, (h, s) in enumerate(old)], schema + ", scene_id string")
    return [r.scene_id for r in U.relink_scenes(parsed, previous).orderBy("scene_order").collect()]


def test_relink(spark):
    assert relink(spark, ["A", "B", "A"], [("A", "1"), ("A", "2"), ("B", "3")]) == ["1", "3", "2"]
    assert relink(spark, ["B", "B"], [("A", "1"), ("B", "2")]) == [None, "2"]


def test_templates(spark):
    rows = {r.kind: r for r in C.format_templates(spark).collect()}
    assert set(rows) == {"scene", "character", "prop"} and len({r.template_id for r in rows.values()}) == 3
    assert "人物" in rows["scene"].negative and "杂物" in rows["scene"].negative


def test_three_layers_stay_apart(spark):
    assets = spark.createDataFrame([("a", 1, "character", "阿宁", ["阿宁"], "", "")], "asset_id string, script_id long, kind string, canonical_name string, aliases array<string>, summary string, continuity_state string")
    facts = spark.createDataFrame(
        [("a", "character", 1, "ageRange", "四十上下", 1.0), ("a", "character", 2, "identityRole", "店主", 1.0), ("a", "character", 3, "costume", "灰围裙", 1.0)],
        "asset_id string, kind string, pos int, fact_kind string, value string, confidence double",
    )
    groups = P.fact_groups(facts, C.fact_kinds(spark))
    texts = P.profile_text(assets, groups, P.missing_kinds(assets, groups, C.fact_kinds(spark)))
    cards = spark.createDataFrame([("c", "水彩质感，一个女人站立，暖色调；侧逆光。")], "card_id string, prompt string")
    styles = X.chosen_styles(spark.createDataFrame([("a", 0, "c")], "asset_id string, pos int, card_id string"), cards)
    asked = spark.createDataFrame([("a", "character", "edit", " closer ")], "asset_id string, kind string, mode string, direction string")
    plan = X.compile_plans(asked, texts, X.readiness(assets, facts), styles, C.format_templates(spark), C.generation_modes(spark)).first()
    assert plan.error is None and all(h in plan.positive_prompt for h in X.HEADERS)
    assert plan.template_id == "format.character.white-four-view.v1"
    assert "四十上下" in plan.basic and plan.style == "水彩质感，暖色调，侧逆光" and "暖色调" not in plan.basic
    assert plan.positive_prompt.endswith("closer")
    none = X.compile_plans(asked, texts, X.readiness(assets, facts), styles.limit(0), C.format_templates(spark), C.generation_modes(spark)).first()
    assert none.error == "noSelectedStyle" and none.positive_prompt is None


def test_passages_are_those_of_all_pairs(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["ab", "cd", "ef", "gh\n", "i"], k=rng.randrange(40))) for _ in range(60)] + [None, "", " lone ", "x" * 40]
    quotes = [None, "", " ", "b c", "d", "xxxxxxxxxxxxxxxxxxxxx", "absent"]
    for text in texts[:60]:
        a = rng.randrange(len(text) + 1)
        quotes.append(text[a : a + rng.randrange(60)])
    found = find_passages(spark.createDataFrame(list(enumerate(texts)), "script_id long, text string"), spark.createDataFrame(list(enumerate(quotes)), "quote_id long, quote string"))
    assert sorted(map(tuple, found.collect())) == [(i, j) for i, t in enumerate(texts) for j, q in enumerate(quotes) if t and q and q in t]


@pytest.mark.parametrize("prompt, style", [
    ("cartoon rendering, a man running, soft light", "cartoon rendering，soft light"), ("delicate line, stable composition", "delicate line，stable composition"),
    ("romantic palette; german expressionism", "romantic palette，german expressionism"), ("portrait of a woman, film grain", "film grain"), ("a castle, three trees", ""),
    ("低饱和冷色，人物奔跑；柔光。街道", "低饱和冷色，柔光"),
])
def test_styles_keep_style_clauses_only(spark, prompt, style):
    assert one(spark, style_only(F.col("p")), p=prompt) == style


def test_near_signatures_are_found_in_every_pair_of_blocks(spark):
    draw = np.random.default_rng(1)
    v = draw.normal(size=(300, 8)).round(1)
    v[50:60], v[120] = v[3], v[7] + 0.1
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(300, None), (301, [float("nan")] * 8), (302, [None] + [0.0] * 7), (303, [0.0] * 7), (303, [0.0] * 8)]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    expected = {}
    for i in range(300):
        near = [(math.sqrt(sum((a - b) ** 2 for a, b in zip(v[i], v[j]))), j) for j in range(i)]
        if near and min(near)[0] <= 1.5:
            expected[i] = (min(near)[1], round(min(near)[0], 6))
    expected |= {303: (j, round(x, 6)) for x, j in [min((math.sqrt(sum(a * a for a in v[j])), j) for j in range(300))] if x <= 1.5}
    found = near_duplicate_signatures(data, 1.5, block=40)
    assert {r.vec_id: (r.reuse_id, r.distance) for r in found.collect()} == expected and len(expected) > 20


def test_near_signatures_join_no_arrays_row_by_row(spark):
    """Pairs of a large distance are met as products of blocks: 30 million of them in seconds, not minutes."""
    draw = np.random.default_rng(2)
    rows = [(i, x.tolist()) for i, x in enumerate(draw.normal(size=(8000, 64)))]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    begun = time.time()
    assert near_duplicate_signatures(data, 5.0).count() == 0
    assert time.time() - begun < 60


@pytest.mark.parametrize("cue, name", [("ANNA (V.O.) (cont'd) ^", "ANNA"), ("@McAvoy", "McAvoy"), ("李雷（画外音）：", "李雷"), ("NARRATOR^", "NARRATOR"), ("R2-D2", "R2-D2"), ("甲:", "甲")])
def test_speakers_of_cues(spark, cue, name):
    assert one(spark, cue_name(F.col("c")), c=cue) == name


def test_fountain_without_blank_lines(spark):
    lines = ["INT. SHOP - DAY", "A bell rings.", "ANNA (O.S.)", "Who is it?", "(listens)", "Hello?", "BOB", "MAX", "Me.", "CUT TO BLACK.", "李雷", "我来了。", "END"]
    units = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "script_id long, unit_idx int, text string")
    found = [r.element for r in classify_elements(units).orderBy("unit_idx").collect()]
    assert found == ["Scene Heading", "Action", "Character", "Dialogue", "Parenthetical", "Dialogue", "Dialogue", "Character", "Dialogue", "Transition", "Character", "Dialogue", "Dialogue"]
    assert classify_elements(units.limit(0)).count() == 0


def test_dialogue_goes_on_to_a_blank_line(spark):
    text = "INT. SHOP - DAY\n\nANNA\nFirst line.\n(softly)\nSecond line.\n\nShe leaves.\nBOB\nWait!\nCUT TO:\nMAX\n\nAlone."
    units = U.source_units(spark.createDataFrame([(1, text)], "script_id long, text string"))
    found = [r.element for r in classify_elements(units).orderBy("unit_idx").collect()]
    assert found == ["Scene Heading", "Character", "Dialogue", "Parenthetical", "Dialogue", "Action", "Character", "Dialogue", "Transition", "Action", "Action"]


def test_names_within_plain_dialogue_open_a_speech(spark):
    lines = [(0, "USER"), (1, "Go on."), (2, "A."), (3, "Well, yes."), (4, "(beat)"), (5, "SS."), (8, "你好"), (9, "É"), (10, "[[x]]"), (11, "A" * 41), (12, "B" * 40), (13, "No."), (14, "CUT TO:"), (15, "end")]
    units = spark.createDataFrame([(1, i, n, x) for i, (n, x) in enumerate(lines)], "script_id long, unit_idx int, line_no int, text string")
    found = [r.element for r in classify_plain_lines(units).orderBy("unit_idx").collect()]
    assert found == ["Character", "Dialogue", "Character", "Dialogue", "Parenthetical", "Dialogue", "Action", "Action", "Action", "Action", "Character", "Dialogue", "Transition", "Action"]


@pytest.mark.parametrize("status, reason, content, outcome", [
    (200, "stop", "x", "accepted"), (200, None, "x", "bad_envelope"), (None, "stop", "x", "bad_envelope"), (None, None, "x", "bad_envelope"), (429, None, None, "resources"), (200, "stop", None, "empty"),
])
def test_outcomes_of_nulls(spark, status, reason, content, outcome):
    rows = spark.createDataFrame([(status, reason, content)], "status int, finish_reason string, content string")
    assert V.classify_receipts(rows).first().outcome == outcome


@pytest.mark.parametrize("states, state", [
    (["completed", "pending"], "pending"), (["failed", "pending"], "pending"), (["completed", None], "pending"), (["completed"], "completed"), (["completed", "failed"], "failed"), (["completed", "completedWithWarnings"], "completedWithWarnings"),
])
def test_episode_states(spark, states, state):
    rows = spark.createDataFrame([(1, s) for s in states], "script_id long, state string")
    assert V.episode_state(rows).first().episode_state == state


def test_overlapping_quotes_are_not_unique(spark):
    cloud = spark.createDataFrame([(1, "k", "aa"), (1, "l", "ab")], "script_id long, name_key string, quote string")
    ledger = spark.createDataFrame([], "script_id long, name_key string")
    scripts = spark.createDataFrame([(1, "aaab")], "script_id long, text string")
    assert [r.quote for r in V.novel_with_unique_quote(cloud, ledger, scripts).collect()] == ["ab"]


def test_batches_are_greedy(spark):
    rows = spark.createDataFrame([(1, i, n) for i, n in enumerate([1000, 900, 100, 1, 1, 1, 1, 1, 5000, 1])], "script_id long, pos int, n_chars int")
    assert [r.batch_no for r in S.pack_batches(rows).orderBy("pos").collect()] == [0, 1, 1, 1, 1, 1, 1, 2, 3, 4]


def test_order_of_rows_does_not_matter(spark):
    facts = [("a", "prop", i, "material", v, 1.0) for i, v in enumerate(["Oak", " oak ", "iron", ""])]
    schema = "asset_id string, kind string, pos int, fact_kind string, value string, confidence double"
    found = [P.fact_groups(spark.createDataFrame(f, schema), C.fact_kinds(spark)).first().group_values for f in (facts, facts[::-1])]
    assert found == [["Oak", "iron"], ["Oak", "iron"]]
