"""Views hold whole texts."""

from scriptloom.plans.views import spark_view

SF = "/root/testdata/sf0.001"


def test_dialogue_is_the_whole_text(spark):
    said = spark.read.parquet(f"{SF}/conversations.parquet").where("conv_id is not null and turn is not null and role <> 'system'")
    wanted = {(r.conv_id, r.turn * 2 + 1, r.text or "") for r in said.collect()}
    found = spark_view(spark, SF, "fx_elements").where("element = 'Dialogue'").collect()
    assert {(r.script_id, r.element_idx, r.text) for r in found} == wanted and max(len(t) for *_, t in wanted) > 40
