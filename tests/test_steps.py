"""Steps that queries share are done once: what plans read and join."""

import json

import pytest

from scriptloom.operators import units as U
from scriptloom.plans import plan_queries, profile_queries, unit_queries, verify_queries  # noqa: F401
from scriptloom.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_markers_are_placed_without_their_texts(spark):
    rows = spark.createDataFrame([(1, "前\n第2集：甲\n\n第十集\r\nx"), (2, ""), (3, None)], "script_id long, text string")
    placed = U.placed_markers(rows)
    found = [(r.script_id, r.line_no, r.start, r.marker and tuple(r.marker)) for r in placed.orderBy("script_id", "line_no").collect()]
    assert found == [(1, 0, 0, None), (1, 1, 2, (2, "甲")), (1, 2, 8, None), (1, 3, 9, (10, "")), (1, 4, 14, None), (2, 0, 0, None)]
    parts = U.split_episodes(rows, placed).where("script_id = 1").orderBy("part_no")
    assert [(r.part_no, r.number, r.part) for r in parts.collect()] == [(0, None, "前\n"), (1, 2, "第2集：甲\n\n"), (2, 10, "第十集\r\nx")]


@pytest.mark.parametrize("name", ["score_base5", "score_v4", "profile_text", "export_profiles", "stale_plans"])
def test_views_are_made_once(spark, name):
    assert not [f for f in QUERIES[name](spark, SF).inputFiles() if "documents" in f]


def test_plans_bring_details_only_if_asked(spark):
    assert "locked_facts" not in plan_queries._plans(spark, SF, strict=False).columns
    assert "locked_facts" in plan_queries._plans(spark, SF, detailed=True).columns


def test_defaults_of_options_are_no_rows(spark):
    found = QUERIES["compile_options"](spark, SF)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Union") == 1 and found.count() == spark.read.parquet(f"{SF}/orders.parquet").count()


def test_whole_profiles_are_exported(spark):
    found = QUERIES["export_profiles"](spark, SF)
    assets = {r.asset_id: r for r in profile_queries.assets(spark, SF).collect()}
    texts = {r.asset_id: r.text for r in profile_queries.texts(spark, SF).collect()}
    quotes = {(r.asset_id, r.scene_id): r.quotes for r in QUERIES["scene_appearances"](spark, SF).collect()}
    profiles = {r.asset_id: json.loads(r.json) for r in found.collect()}
    assert set(profiles) == {k for k, r in assets.items() if r.decision == "accepted"}
    for key, p in profiles.items():
        scenes = {s["scene_id"]: "|".join(s["quotes"]) for e in p["episodes"] for s in e["scenes"]}
        assert p["text"] == texts[key] and list(p) == sorted(p) and p["scene_count"] == len(scenes)
        assert scenes == {s: q for (a, s), q in quotes.items() if a == key}
    assert max(len(p["fact_groups"]) for p in profiles.values()) > 1 and any("episode_title" in e for p in profiles.values() for e in p["episodes"])
