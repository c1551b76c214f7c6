"""What grows with the texts is done once and where the texts are: no shuffle of lines, no stored copies of them."""

import duckdb
import pytest
from pyspark.sql import functions as F

from scriptloom.operators import fountain as N
from scriptloom.operators import profile as P
from scriptloom.operators import score as S
from scriptloom.operators import verify as V
from scriptloom.plans import plan_queries, profile_queries, unit_queries, verify_queries  # noqa: F401
from scriptloom.plans.registry import ORACLES, QUERIES
from scriptloom.plans.views import spark_view
from scriptloom.sources import catalogs as C

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def tables(df):
    """The stored tables and documents that a query reads at its end."""
    names = {part.split("-")[0] for f in df.inputFiles() for part in f.split("/")[-2:-1]}
    return names | {"documents" for f in df.inputFiles() if "documents" in f}


@pytest.mark.parametrize("name", ["fx_units", "fx_marked", "fx_scene_rows", "fx_candidates"])
def test_views_of_texts_need_no_shuffle(spark, name):
    assert "hashpartitioning" not in plan(spark_view(spark, SF, name))


def test_lines_and_scenes_of_odd_documents(spark, tmp_path):
    rows = [(3, "\n a  b c d\n　\r\n第9集\n\nx\ny"), (4, None), (5, " \n\t\n"), (6, ""), (7, "only")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    units = spark_view(spark, str(tmp_path), "fx_units").orderBy("script_id", "unit_idx").collect()
    assert [tuple(r) for r in units] == [(3, 1, 1, " a  b c d"), (3, 3, 2, "第9集"), (3, 5, 3, "x"), (3, 6, 4, "y"), (7, 0, 1, "only")]
    scenes = spark_view(spark, str(tmp_path), "SELECT scene_id, scene_text, unit_list FROM fx_scene_rows ORDER BY scene_id").collect()
    assert [tuple(r) for r in scenes] == [("3:0", " a  b c d\n第9集\nx", ""), ("3:1", "y", ""), ("7:0", "第1集：only", "")]
    names = spark_view(spark, str(tmp_path), "SELECT DISTINCT name FROM fx_candidates WHERE scene_id = '3:0'").collect()
    assert [r.name for r in names] == [""]


def test_plans_store_no_texts(spark):
    assert tables(QUERIES["prompt_plans"](spark, SF)) >= {"verified", "fx_evidence", "fx_assets"}
    assert "scene_text" not in {c for path in profile_queries.store(spark, SF).values() for c in spark.read.parquet(path).columns}


def test_values_of_groups_are_made_once(spark):
    rows = [("a", "prop", "material", 1, " Tin "), ("a", "prop", "material", 2, "tin"), ("a", "prop", "condition", 3, "　"), ("a", "prop", "condition", 4, None)]
    found = P.fact_groups(spark.createDataFrame(rows, "asset_id string, kind string, fact_kind string, pos int, value string"), C.fact_kinds(spark))
    assert "Filter (size(" not in plan(found)
    assert [(r.fact_kind, r.group_values, r.evidence_count) for r in found.collect()] == [("material", ["Tin"], 2)]


@pytest.mark.parametrize("name", ["score_base5", "score_v4"])
def test_scores_come_from_gated_rows(spark, name):
    assert tables(QUERIES[name](spark, SF)) == {"gated"}


@pytest.mark.parametrize(("name", "sorts"), [("score_base5", 1), ("score_v4", 2)])
def test_scores_shuffle_rows_once(spark, name, sorts):
    found = plan(QUERIES[name](spark, SF))
    assert found.count("hashpartitioning") == 1 and "Join" not in found and found.count("Sort [") == sorts


def test_candidates_are_gated_where_their_texts_are(spark, tmp_path):
    found = V.gate_in_place(spark_view(spark, SF, "fx_candidates_in_scenes"))
    joined = V.hard_gate(spark_view(spark, SF, "fx_candidates"), spark_view(spark, SF, "fx_scenes"))
    assert "hashpartitioning" not in plan(found) and sorted(found.columns) == sorted(joined.columns)
    assert found.count() == joined.count() and not found.exceptAll(joined.select(found.columns)).count()
    # a null id, a null text and names that are blank in different ways; evidence of one character
    rows = [(None, "a b c"), (1, None), (4, "\u3000 x\n y\n\t\n天\n \u00a0 z\n地\n"), (6, "天")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ["score_base5", "score_v4"]:
        scores = QUERIES[name](spark, str(tmp_path))
        duck = duckdb.connect()
        duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        wanted = duck.execute(ORACLES[name]).fetchall()
        assert wanted and sorted(map(tuple, scores.collect())) == sorted(wanted)


def test_agreement_is_what_joins_say(spark):
    names = ["Li Na", "li  na", " LI NA", "LI NA", "li na", "Bo", "bo", "", "　", None]
    rows = [(s if s < 3 else None, f"{s}:{i % 4}" if i % 7 != 6 else None, ["tagging", "general", "remote"][(i + i // 4) % 3], [None, "prop", "scene"][min(i % 5, 2)], names[(i * 3 + i // 8) % 10], ["", "hurt"][i % 11 == 2])
            for s in range(4) for i in range(80)]
    candidates = spark.createDataFrame(rows, "script_id int, scene_id string, engine string, kind string, name string, continuity_state string")
    tagged = candidates.where("engine = 'tagging' AND name <> ''").select("scene_id", F.lower("name").alias("name_key"))
    agreed = S.consensus(candidates).select("scene_id", "kind", "name_key", "consensus")
    joined = S.entity_support(candidates.where("name <> ''"), tagged).join(agreed, ["scene_id", "kind", "name_key"]).join(S.stability(candidates), ["script_id", "kind", "name_key"])
    found = S.agreement(candidates, "tagging")
    got, wanted = (sorted(map(repr, df.select(found.columns).collect())) for df in (found, joined))
    assert got == wanted and len({r.support for r in found.collect()}) == len({r.identity for r in found.collect()}) == 2


def test_speakers_are_found_in_one_pass(spark):
    found = plan(QUERIES["fountain_assets"](spark, SF))
    assert "Union" not in found and found.count("hashpartitioning") == 2


def test_lines_with_ends_of_spans_only(spark):
    rows = [(1, i, t, i) for i, t in enumerate(["odd */ end", "odd ]] end", "a /* b */ c [[ d", "e ]] f", "/* g", " h ", "i */ j"])]
    found = N.classify_elements(spark.createDataFrame(rows, "script_id int, unit_idx int, text string, line_no int")).orderBy("unit_idx")
    assert [r.element for r in found.collect()] == ["Action", "Action", "Action", "Action", "Boneyard", "Boneyard", "Action"]


@pytest.mark.parametrize("name", ["scene_appearances", "profiles", "asset_scenes"])
def test_appearances_read_stored_rows(spark, name):
    read = tables(QUERIES[name](spark, SF))
    assert {"verified", "fx_evidence", "fx_assets"} <= read and not read & {"fx_scene_rows", "fx_marked"}
