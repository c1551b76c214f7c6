"""Queries over profiles, appearances, audits and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as P
from ..operators import units as U
from ..scratch import durable, new_path
from ..sources import catalogs as C
from ..sources import publishing as B
from ..sources import sinks as K
from .registry import query
from .unit_queries import INDEX, key_sql, scenes, scripts, trim_sql, units
from .views import spark_view as view
from .views import store_views

KINDS = C.sql_values([(k, f, i, i < 6) for k, kinds in C.FACT_KINDS.items() for i, f in enumerate(kinds)], "kind, fact_kind, ord, recommended")
FACTS = "vf AS (SELECT f.* FROM fx_facts f JOIN fx_scenes s USING (scene_id) WHERE strpos(scene_text, evidence) > 0)"
GROUPS = f"""{FACTS}, fk AS (SELECT * FROM {KINDS}),
fv AS (SELECT asset_id, kind, fact_kind, pos, {trim_sql('value')} AS v FROM vf),
fu AS (SELECT *, row_number() OVER (PARTITION BY asset_id, fact_kind, {key_sql('v')} ORDER BY pos) AS r FROM fv WHERE v <> ''),
fg AS (SELECT fu.asset_id, fu.kind, fu.fact_kind, fk.ord, string_agg(v, '；' ORDER BY pos) FILTER (r = 1) AS vals, max(n) AS evidence_count
  FROM fu JOIN fk ON fk.kind = fu.kind AND fk.fact_kind = fu.fact_kind JOIN (SELECT asset_id, fact_kind, count(*) AS n FROM vf GROUP BY 1, 2) c ON c.asset_id = fu.asset_id AND c.fact_kind = fu.fact_kind GROUP BY 1, 2, 3, 4)"""
REFERENCED = f"""{FACTS}, nm AS (SELECT asset_id, scene_id FROM fx_evidence UNION SELECT asset_id, scene_id FROM vf),
rf AS (SELECT nm.asset_id, s.scene_id, s.scene_order, s.heading FROM nm JOIN fx_scenes s USING (scene_id) JOIN fx_assets USING (asset_id)),
ra AS (SELECT * FROM rf UNION ALL SELECT a.asset_id, s.scene_id, s.scene_order, s.heading FROM fx_assets a JOIN fx_scenes s ON s.script_id = a.script_id AND s.scene_order = a.first_scene_order WHERE a.asset_id NOT IN (SELECT asset_id FROM rf))"""
QUOTES = f"""{REFERENCED}, qs AS (SELECT asset_id, scene_id, 0 AS src, pos, quote FROM fx_evidence UNION ALL SELECT asset_id, scene_id, 1, pos, evidence FROM vf),
qt AS (SELECT *, {trim_sql('quote')} AS q FROM qs), qu AS (SELECT *, row_number() OVER (PARTITION BY asset_id, scene_id, {key_sql('q')} ORDER BY src, pos) AS r FROM qt WHERE q <> ''),
qa AS (SELECT asset_id, scene_id, string_agg(q, '|' ORDER BY src, pos) AS quotes, count(*) AS n FROM qu WHERE r = 1 GROUP BY 1, 2)"""


#: Views that queries over profiles read more than once.
STORED = ["fx_candidates", "fx_evidence", "fx_assets"]


def store(spark, sf_dir, names=STORED):
    """Write those views and the verified facts once: name -> path."""
    stored = store_views(spark, sf_dir, names)
    stored["verified"] = new_path(spark, "verified")
    P.verified_facts(view(spark, sf_dir, "fx_facts", stored), view(spark, sf_dir, "fx_scenes", stored)).write.parquet(stored["verified"])
    return stored


def assets(spark, sf_dir, stored=None):
    return view(spark, sf_dir, "fx_assets", stored).withColumn("aliases", F.split("alias_list", ","))


def evidence(spark, sf_dir, stored=None):
    return view(spark, sf_dir, "fx_evidence", stored)


def facts(spark, sf_dir, stored=None):
    if stored:
        return spark.read.parquet(stored["verified"])
    return P.verified_facts(view(spark, sf_dir, "fx_facts"), view(spark, sf_dir, "fx_scenes"))


def groups(spark, sf_dir, stored=None):
    return P.fact_groups(facts(spark, sf_dir, stored), C.fact_kinds(spark))


def referenced(spark, sf_dir, stored=None):
    return P.asset_scenes(assets(spark, sf_dir, stored), evidence(spark, sf_dir, stored), facts(spark, sf_dir, stored), view(spark, sf_dir, "fx_scenes", stored))


def index(spark, sf_dir, stored=None):
    return U.episode_index(scenes(spark, sf_dir, stored), units(spark, sf_dir, stored))


def texts(spark, sf_dir, stored=None):
    grouped = groups(spark, sf_dir, stored)
    missing = P.missing_kinds(assets(spark, sf_dir, stored), grouped, C.fact_kinds(spark))
    return P.profile_text(assets(spark, sf_dir, stored), grouped, missing)


@query("fact_groups", f"WITH {GROUPS} SELECT asset_id, fact_kind, ord, vals AS fact_values, evidence_count FROM fg")
def fact_groups(spark, sf_dir):
    return groups(spark, sf_dir).select("asset_id", "fact_kind", "ord", F.array_join("group_values", "；").alias("fact_values"), "evidence_count")


@query("missing_kinds", f"WITH {GROUPS} SELECT a.asset_id, fk.fact_kind FROM fx_assets a JOIN fk USING (kind) WHERE recommended AND NOT EXISTS (SELECT 1 FROM fg WHERE fg.asset_id = a.asset_id AND fg.fact_kind = fk.fact_kind)")
def missing_kinds(spark, sf_dir):
    return P.missing_kinds(assets(spark, sf_dir), groups(spark, sf_dir), C.fact_kinds(spark)).select("asset_id", "fact_kind")


@query("asset_scenes", f"WITH {REFERENCED} SELECT asset_id, scene_id, scene_order FROM ra")
def asset_scenes(spark, sf_dir):
    return referenced(spark, sf_dir, store(spark, sf_dir)).select("asset_id", "scene_id", "scene_order")


@query("scene_appearances", f"WITH {QUOTES} SELECT ra.asset_id, ra.scene_id, coalesce(quotes, '') AS quotes FROM ra LEFT JOIN qa USING (asset_id, scene_id)")
def scene_appearances(spark, sf_dir):
    stored = store(spark, sf_dir)
    found = P.scene_appearances(referenced(spark, sf_dir, stored), evidence(spark, sf_dir, stored), facts(spark, sf_dir, stored))
    return found.select("asset_id", "scene_id", F.array_join("quotes", "|").alias("quotes"))


@query("episode_appearances", f"""WITH {QUOTES}, {INDEX} SELECT asset_id, coalesce(ix.episode_number, 1) AS episode_number,
first(ix.episode_title ORDER BY ra.scene_order) FILTER (trim(coalesce(ix.episode_title, '')) <> '') AS episode_title, count(*) AS n_scenes, string_agg(ra.scene_id, ',' ORDER BY ra.scene_order) AS scene_ids, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n_quotes
FROM ra LEFT JOIN qa USING (asset_id, scene_id) LEFT JOIN ix ON ix.scene_id = ra.scene_id GROUP BY 1, 2""")
def episode_appearances(spark, sf_dir):
    """In which episodes and scenes does each asset appear, with how many quotes."""
    stored = store(spark, sf_dir)
    found = P.scene_appearances(referenced(spark, sf_dir, stored), evidence(spark, sf_dir, stored), facts(spark, sf_dir, stored))
    rows = P.episode_appearances(found, index(spark, sf_dir, stored))
    return rows.select("asset_id", "episode_number", "episode_title", "n_scenes", F.array_join("scene_ids", ",").alias("scene_ids"), "n_quotes")


ROLL_PARTS = f"""sn AS (SELECT asset_id, count(*) AS n FROM ra GROUP BY 1), qn AS (SELECT asset_id, count(DISTINCT {key_sql('quote')}) AS n FROM fx_evidence WHERE trim(quote) <> '' GROUP BY 1), fc AS (SELECT asset_id, CAST(sum(CAST(confidence AS DECIMAL(18, 9))) AS DOUBLE) / count(confidence) AS c FROM vf GROUP BY 1)"""
ROLL = """SELECT a.asset_id, coalesce(sn.n, 0) AS scene_count, coalesce(qn.n, 0) AS source_evidence_count, round(least(1.0E0, validated_confidence * 0.65E0 + coalesce(c, validated_confidence) * 0.25E0 + CASE WHEN sn.n > 0 THEN 0.10E0 ELSE 0.0E0 END) + 1E-9, 6) AS confidence
FROM fx_assets a LEFT JOIN sn USING (asset_id) LEFT JOIN qn USING (asset_id) LEFT JOIN fc USING (asset_id)"""


@query("profiles", f"""WITH {REFERENCED}, {ROLL_PARTS}
{ROLL}""")
def profiles(spark, sf_dir):
    stored = store(spark, sf_dir)
    return P.profiles(assets(spark, sf_dir, stored), evidence(spark, sf_dir, stored), facts(spark, sf_dir, stored), referenced(spark, sf_dir, stored))


OVERVIEW_PARTS = """o AS (SELECT asset_id, string_agg(fact_kind || '：' || vals, '；' ORDER BY ord) AS d FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY ord) AS r FROM fg) WHERE r <= 6 GROUP BY 1)"""
OVERVIEW = """SELECT a.asset_id, kind || '“' || canonical_name || '”' || CASE WHEN coalesce(d, trim(summary)) = '' THEN '的证据锁定基础资料。' ELSE '：' || coalesce(d, trim(summary)) END AS overview FROM fx_assets a LEFT JOIN o USING (asset_id)"""


@query("profile_overview", f"""WITH {GROUPS}, {OVERVIEW_PARTS}
{OVERVIEW}""")
def profile_overview(spark, sf_dir):
    return P.overview(assets(spark, sf_dir), groups(spark, sf_dir))


ALIASES = f"""SELECT *, row_number() OVER (PARTITION BY asset_id, {key_sql('t')} ORDER BY i) AS r FROM (SELECT asset_id, {trim_sql('v')} AS t, i FROM (SELECT asset_id, unnest(string_split(alias_list, ',')) AS v, generate_subscripts(string_split(alias_list, ','), 1) AS i FROM fx_assets)) WHERE t <> ''"""
TEXT = f"""{GROUPS}, mk AS (SELECT a.asset_id, string_agg(fk.fact_kind, '、' ORDER BY fk.ord) AS m FROM fx_assets a JOIN fk USING (kind) WHERE recommended AND NOT EXISTS (SELECT 1 FROM fg WHERE fg.asset_id = a.asset_id AND fg.fact_kind = fk.fact_kind) GROUP BY 1),
gt AS (SELECT asset_id, string_agg(fact_kind || '：' || vals, chr(10) ORDER BY ord) AS g FROM fg GROUP BY 1),
al AS (SELECT asset_id, string_agg(t, '、' ORDER BY i) AS als FROM ({ALIASES}) WHERE r = 1 GROUP BY 1),
px AS (SELECT a.asset_id, concat_ws(chr(10), '【基本资料】', '类型：' || kind, '名称：' || canonical_name, '明确别名：' || als, g, CASE WHEN trim(continuity_state) <> '' THEN '连续性状态：' || trim(continuity_state) END, '剧本未明确、禁止臆造：' || m, '{C.PROFILE_FOOTER}') AS text
  FROM fx_assets a LEFT JOIN gt USING (asset_id) LEFT JOIN mk USING (asset_id) LEFT JOIN al USING (asset_id))"""


@query("profile_text", f"WITH {TEXT} SELECT asset_id, text FROM px")
def profile_text(spark, sf_dir):
    return texts(spark, sf_dir, store(spark, sf_dir, ["fx_candidates", "fx_assets"]))


LOCKED = f"""{FACTS}, lk AS (SELECT asset_id, 0 AS s, 0 AS p, canonical_name AS v FROM fx_assets UNION ALL SELECT asset_id, 0, 1, continuity_state FROM fx_assets UNION ALL SELECT asset_id, 1, pos, value FROM vf
UNION ALL SELECT asset_id, 2, pos, quote FROM fx_evidence WHERE pos <= 12),
lt AS (SELECT asset_id, s, p, {trim_sql('v')} AS t FROM lk), lu AS (SELECT *, row_number() OVER (PARTITION BY asset_id, {key_sql('t')} ORDER BY s, p) AS r FROM lt WHERE t <> ''),
lf AS (SELECT asset_id, string_agg(t, '|' ORDER BY s, p) AS locked FROM lu WHERE r = 1 GROUP BY 1)"""


@query("locked_facts", f"WITH {LOCKED} SELECT asset_id, locked FROM lf JOIN fx_assets USING (asset_id)")
def locked_facts(spark, sf_dir):
    found = P.locked_facts(assets(spark, sf_dir), facts(spark, sf_dir), evidence(spark, sf_dir))
    return found.select("asset_id", F.array_join("locked", "|").alias("locked"))


@query("basic_audit", f"""WITH {INDEX}, sc AS (SELECT script_id, count(DISTINCT episode_number) AS e, count(*) AS n, count(*) FILTER (unresolved) AS u FROM ix GROUP BY 1), pc AS (SELECT script_id, count(*) AS p FROM fx_assets GROUP BY 1)
SELECT doc_id AS script_id, 1 AS version, greatest(1, coalesce(e, 0)) AS episode_count, coalesce(n, 0) AS scene_count, coalesce(p, 0) AS profile_count, coalesce(u, 0) AS unresolved_scene_count, sha256(text) AS source_fingerprint, coalesce(p, 0) > 0 AND coalesce(n, 0) > 0 AS complete
FROM documents LEFT JOIN sc ON sc.script_id = doc_id LEFT JOIN pc ON pc.script_id = doc_id""")
def basic_audit(spark, sf_dir):
    return P.basic_audit(scripts(spark, sf_dir), index(spark, sf_dir), assets(spark, sf_dir).select("script_id", "asset_id"))


@query("automation_summary", """SELECT a.*, engines, elapsed_ms FROM (SELECT script_id, count(*) FILTER (kind = 'scene') AS n_scene, count(*) FILTER (kind = 'character') AS n_character, count(*) FILTER (kind = 'prop') AS n_prop,
count(*) FILTER (decision = 'accepted') AS n_accepted, count(*) FILTER (decision = 'conflict') AS n_conflict, count(*) FILTER (decision = 'rejected') AS n_rejected FROM fx_assets GROUP BY 1) a
LEFT JOIN (SELECT script_id, string_agg(DISTINCT engine, ',' ORDER BY engine) AS engines, CAST(sum(elapsed_ms) AS BIGINT) AS elapsed_ms FROM fx_candidates GROUP BY 1) e USING (script_id)""")
def automation_summary(spark, sf_dir):
    found = P.automation_summary(assets(spark, sf_dir), view(spark, sf_dir, "fx_candidates"))
    return found.withColumn("engines", F.array_join("engines", ","))


COVERED = "SELECT doc_id AS script_id, n_chars % 6 <> 0 AS ok FROM documents"
EXTRACTED = "SELECT script_id, scene_order % 8 <> 7 AS extracted FROM fx_scenes"


@query("completed_scripts", f"""SELECT c.script_id, ok AND coalesce(x, false) AND coalesce(u, 0) > 0 AS completed FROM ({COVERED}) c LEFT JOIN (SELECT script_id, bool_and(extracted) AS x FROM ({EXTRACTED}) GROUP BY 1) e USING (script_id)
LEFT JOIN (SELECT script_id, count(*) AS u FROM fx_assets WHERE decision = 'accepted' GROUP BY 1) a USING (script_id)""")
def completed_scripts(spark, sf_dir):
    return P.completed_scripts(view(spark, sf_dir, COVERED), view(spark, sf_dir, EXTRACTED), assets(spark, sf_dir))


PROJECTS = "SELECT doc_id AS script_id, CAST(doc_id % 4 + 6 AS INT) AS schema_version, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE CAST(doc_id % 2 AS INT) END AS audit_version FROM documents"


@query("needs_migration", f"""SELECT p.script_id, audit_version IS NULL OR audit_version <> 1 OR EXISTS (SELECT 1 FROM fx_assets a WHERE a.script_id = p.script_id AND summary = '') AS needs_rebuild, greatest(8, schema_version) AS schema_version FROM ({PROJECTS}) p""")
def needs_migration(spark, sf_dir):
    owned = assets(spark, sf_dir).select("script_id", (F.col("summary") != "").alias("has_profile"))
    return P.needs_migration(view(spark, sf_dir, PROJECTS), owned)


@query("publishable_scripts", """SELECT asset_id, CASE WHEN script_id % 3 = 1 THEN 'first' ELSE 'second' END AS version FROM fx_assets WHERE script_id % 3 <> 1 OR script_id % 2 = 0""")
def publishable_scripts(spark, sf_dir):
    """Assets published twice: the second time scripts without a complete audit keep what they had."""
    path, owned = new_path(spark, "published"), store_views(spark, sf_dir, ["fx_assets"])
    rows = view(spark, sf_dir, "SELECT script_id, asset_id FROM fx_assets", owned)
    for version, complete in (("first", "doc_id % 2 = 0"), ("second", "doc_id % 3 <> 1")):
        audits = view(spark, sf_dir, f"SELECT doc_id AS script_id, {complete} AS complete FROM documents")
        B.publish_if_complete(rows.withColumn("version", F.lit(version)), audits, path)
    return B.read_published(spark, path).select("asset_id", "version")


@query("export_assets", "SELECT asset_id, kind, canonical_name, decision FROM fx_assets WHERE decision = 'accepted'")
def export_assets(spark, sf_dir):
    return K.exported_assets(assets(spark, sf_dir)).select("asset_id", "kind", "canonical_name", "decision")


#: Parts of a profile as JSON; the roll-up is that of ``profiles``.
WHOLE = f"""{TEXT}, {QUOTES.removeprefix(FACTS + ', ')}, {INDEX}, {ROLL_PARTS}, ro AS ({ROLL}), {OVERVIEW_PARTS}, ov AS ({OVERVIEW}),
gv AS (SELECT asset_id, fact_kind, list(v ORDER BY pos) FILTER (r = 1) AS vs FROM fu GROUP BY 1, 2),
gj AS (SELECT asset_id, string_agg('{{"evidence_count":' || evidence_count || ',"fact_kind":"' || fact_kind || '","values":' || to_json(vs) || '}}', ',' ORDER BY ord) AS fact_groups FROM fg JOIN gv USING (asset_id, fact_kind) GROUP BY 1),
mj AS (SELECT a.asset_id, to_json(list(fk.fact_kind ORDER BY fk.ord)) AS missing FROM fx_assets a JOIN fk USING (kind) WHERE recommended AND NOT EXISTS (SELECT 1 FROM fg WHERE fg.asset_id = a.asset_id AND fg.fact_kind = fk.fact_kind) GROUP BY 1),
aj AS (SELECT asset_id, to_json(list(t ORDER BY i)) AS aliases FROM ({ALIASES}) WHERE r = 1 GROUP BY 1),
qj AS (SELECT asset_id, scene_id, to_json(list(q ORDER BY src, pos)) AS quotes FROM qu WHERE r = 1 GROUP BY 1, 2),
sj AS (SELECT ra.asset_id, ra.scene_id, ra.scene_order, '{{"heading":' || to_json(heading) || ',"quotes":' || coalesce(CAST(quotes AS STRING), '[]') || ',"scene_id":"' || ra.scene_id || '","scene_order":' || ra.scene_order || '}}' AS scene FROM ra LEFT JOIN qj USING (asset_id, scene_id)),
ej AS (SELECT asset_id, coalesce(ix.episode_number, 1) AS episode_number, first(ix.episode_title ORDER BY sj.scene_order) FILTER (trim(coalesce(ix.episode_title, '')) <> '') AS title, string_agg(scene, ',' ORDER BY sj.scene_order) AS scenes FROM sj LEFT JOIN ix ON ix.scene_id = sj.scene_id GROUP BY 1, 2),
ep AS (SELECT asset_id, string_agg('{{"episode_number":' || episode_number || coalesce(',"episode_title":' || to_json(title), '') || ',"scenes":[' || scenes || ']}}', ',' ORDER BY episode_number) AS episodes FROM ej GROUP BY 1)"""


@query("export_profiles", f"""WITH {WHOLE} SELECT asset_id, '{{"aliases":' || coalesce(CAST(aliases AS STRING), '[]') || ',"canonical_name":' || to_json(canonical_name) || ',"confidence":' || to_json(confidence) || ',"continuity_state":' || to_json(continuity_state)
|| ',"episodes":[' || coalesce(episodes, '') || '],"fact_groups":[' || coalesce(fact_groups, '') || '],"kind":"' || kind || '","missing_fact_kinds":' || coalesce(CAST(missing AS STRING), '[]') || ',"overview":' || to_json(overview)
|| ',"scene_count":' || scene_count || ',"source_evidence_count":' || source_evidence_count || ',"text":' || to_json(text) || ',"version":1}}' AS json
FROM fx_assets JOIN px USING (asset_id) JOIN ov USING (asset_id) JOIN ro USING (asset_id) LEFT JOIN aj USING (asset_id) LEFT JOIN ep USING (asset_id) LEFT JOIN gj USING (asset_id) LEFT JOIN mj USING (asset_id) WHERE decision = 'accepted'""".replace("AS STRING", "AS VARCHAR"))
def export_profiles(spark, sf_dir):
    """Whole profiles of accepted assets."""
    stored = store(spark, sf_dir)
    own, said, sure = assets(spark, sf_dir, stored), evidence(spark, sf_dir, stored), facts(spark, sf_dir, stored)
    grouped, episodes = durable(groups(spark, sf_dir, stored), "groups"), index(spark, sf_dir, stored).select("scene_id", "episode_number", "episode_title")
    seen = durable(referenced(spark, sf_dir, stored).join(episodes, "scene_id", "left"), "referenced")
    missing = P.missing_kinds(own, grouped, C.fact_kinds(spark))
    profile = P.whole_profiles(own, grouped, missing, seen, said, sure, P.profiles(own, said, sure, seen))
    return K.exported_profiles(own.select("asset_id", "kind", "canonical_name", "decision"), profile)


@query("render_fountain", f"""SELECT script_id, sha256(string_agg(CASE element WHEN 'Scene Heading' THEN chr(10) || upper(replace(text, 'ß', 'SS')) ELSE text END, chr(10) ORDER BY element_idx)) AS sha, count(*) AS n_elements FROM fx_elements GROUP BY 1""")
def render_fountain(spark, sf_dir):
    rendered = K.render_fountain(view(spark, sf_dir, "fx_elements"))
    return rendered.select("script_id", F.sha2("fountain", 256).alias("sha"), "n_elements")


@query("export_sheet", """SELECT script_id, unit_idx, regexp_replace(text, '[^\\x09\\x0A\\x0D\\x20-\\x{D7FF}\\x{E000}-\\x{FFFD}\\x{10000}-\\x{10FFFF}]', '', 'g') AS text FROM (SELECT script_id, unit_idx, CASE WHEN unit_idx % 3 = 0 THEN chr(1) || text || chr(8) ELSE text END AS text FROM fx_units) UNION ALL SELECT script_id, unit_idx, text FROM fx_units WHERE unit_idx = 1""")
def export_sheet(spark, sf_dir):
    """Control characters go from the copy; repeated rows stay."""
    rows = view(spark, sf_dir, "SELECT script_id, unit_idx, CASE WHEN unit_idx % 3 = 0 THEN chr(1) || text || chr(8) ELSE text END AS text FROM fx_units UNION ALL SELECT script_id, unit_idx, text FROM fx_units WHERE unit_idx = 1")
    return K.sheet(rows)
