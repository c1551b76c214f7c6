"""Queries over styles, options, plans, catalogs, files and streams."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import quality as Q
from ..operators import styles as S
from ..operators.trees import cyclic_cards
from ..plans import compile as X
from ..scratch import durable, new_path
from ..sources import catalogs as C
from ..sources import readers as R
from ..sources import sinks as K
from ..streaming import receipts as W
from .profile_queries import FACTS, LOCKED, TEXT, assets, evidence, facts, store, texts
from .registry import query
from .unit_queries import key_sql, trim_sql
from .verify_queries import OUTCOME
from .views import VIEWS
from .views import spark_view as view

TEMPLATES = C.sql_values(C.FORMAT_TEMPLATES, "template_id, kind, title, positive, negative, ratios")
MODES = C.sql_values(C.GENERATION_MODES, "mode, instruction")
OPTIONS_SQL = "(SELECT k.kind, o.* FROM (VALUES ('scene'), ('character'), ('prop')) AS k(kind) CROSS JOIN " + C.sql_values(
    [(*o, C.PARAMETERS.index(o[0])) for o in C._OPTIONS], "parameter, option_id, title, prompt_token, is_default, included, ord"
).replace("AS t(", "AS o(") + ")"
LINKS = C.sql_values(C.LINKS, "parameter, option_id, to_parameter, to_option")

#: What prompts of cards go on with, and what of it is style.
CLAUSES = [
    ("，低饱和冷色，人物奔跑；柔光", "低饱和冷色，柔光"), (", low key light, man running, film grain", "low key light，film grain"), ("，角色走进大门，阳光下的狗；水彩质感", "水彩质感"),
    (", a knight with a rough metallic shield, oil painting", "oil painting"), (", elderly lady in a wide hat; German expressionism; close-up", "German expressionism，close-up"), (", wide, a castle; a pencil", ""),
]
_CLAUSE = "CASE (length(card_id) * 5 + ascii(right(card_id, 1))) % 6 " + " ".join(f"WHEN {i} THEN '{{{i}}}'" for i in range(6)) + " END"
VIEWS["fx_cards"] = f"SELECT card_id, parent_id, lifecycle, title || {_CLAUSE.format(*[c for c, _ in CLAUSES])} AS prompt FROM fx_styles"
VIEWS["fx_chosen"] = """SELECT asset_id, 0 AS pos, 's' || (script_id % 100 + 1) AS card_id FROM fx_assets WHERE script_id % 7 <> 0 UNION ALL SELECT asset_id, 1, 'n' || (script_id % 25) FROM fx_assets WHERE script_id % 3 = 0 AND script_id % 7 <> 0"""
VIEWS["fx_asked"] = """SELECT asset_id, kind, CASE script_id % 3 WHEN 0 THEN 'variation' WHEN 1 THEN 'edit' ELSE 'textToImage' END AS mode, CASE WHEN script_id % 2 = 0 THEN ' closer  ' ELSE '' END AS direction FROM fx_assets WHERE decision = 'accepted'"""


def _plans(spark, sf_dir, strict=True, detailed=False, stored=None):
    """Plans of all accepted assets; lighting and locked facts cost two joins more, so they come only if asked for."""
    stored = stored or store(spark, sf_dir, ["fx_candidates", "fx_evidence", "fx_assets"])
    owned, verified = assets(spark, sf_dir, stored), facts(spark, sf_dir, stored)
    styles = X.chosen_styles(view(spark, sf_dir, "fx_chosen", stored), view(spark, sf_dir, "fx_cards"))
    details = X.plan_details(owned, verified, evidence(spark, sf_dir, stored)) if detailed else None
    asked = view(spark, sf_dir, "fx_asked", stored)
    return X.compile_plans(asked, texts(spark, sf_dir, stored), X.readiness(owned, verified), styles, C.format_templates(spark), C.generation_modes(spark), strict, details)


STYLE = f"fr AS (SELECT card_id, nullif({_CLAUSE.format(*[f for _, f in CLAUSES])}, '') AS f FROM fx_styles)"
PLANS = f"""{TEXT}, {STYLE}, rd AS (SELECT asset_id, count(*) AS n FROM vf GROUP BY 1),
ch AS (SELECT asset_id, string_agg(card_id, ',' ORDER BY pos) AS cards, string_agg(f, '；' ORDER BY pos) AS style FROM fx_chosen JOIN (SELECT card_id AS cid FROM fx_cards) z ON z.cid = card_id LEFT JOIN fr USING (card_id) GROUP BY 1),
tp AS (SELECT * FROM {TEMPLATES}), md AS (SELECT * FROM {MODES}),
pl AS (SELECT a.asset_id, a.mode, tp.template_id, coalesce(cards, '') AS cards, px.text AS basic, coalesce(style, '') AS style, tp.positive, tp.negative, coalesce(instruction, '') AS ins, direction, coalesce(n, 0) AS n
  FROM fx_asked a JOIN px USING (asset_id) LEFT JOIN rd USING (asset_id) LEFT JOIN ch USING (asset_id) JOIN tp ON tp.kind = a.kind LEFT JOIN md ON md.mode = a.mode)"""


def _prompt_sql(operation: str) -> str:
    return f"'{X.HEADERS[0]}' || chr(10) || basic || chr(10) || chr(10) || '{X.HEADERS[1]}' || chr(10) || style || chr(10) || chr(10) || '{X.HEADERS[2]}' || chr(10) || positive || chr(10) || chr(10) || '{X.HEADERS[3]}' || chr(10) || {operation}"


OPERATION = "CASE WHEN trim(ins) <> '' AND trim(direction) <> '' THEN trim(ins) || chr(10) || trim(direction) ELSE trim(ins) || trim(direction) END"


#: Lighting facts and locked facts of each asset. {LOCKED} repeats the facts, so only what follows them is taken.
DETAILS = "lg AS (SELECT asset_id, string_agg(value, '；' ORDER BY pos) AS lighting FROM vf WHERE fact_kind = 'lighting' GROUP BY 1)" + LOCKED.removeprefix(FACTS)


@query("prompt_plans", f"""WITH {PLANS}, {DETAILS}, e AS (SELECT *, CASE WHEN n < 2 THEN 'notReady' WHEN style = '' THEN 'noSelectedStyle' END AS error FROM pl)
SELECT asset_id, mode, template_id, cards, error, CASE WHEN error IS NULL THEN sha256({_prompt_sql(OPERATION)}) END AS positive_sha, CASE WHEN error IS NULL THEN sha256('{C.NEGATIVE_STRICT}' || '；' || negative) END AS negative_sha, coalesce(lighting, '') AS lighting, locked FROM e LEFT JOIN lg USING (asset_id) LEFT JOIN lf USING (asset_id)""")
def prompt_plans(spark, sf_dir):
    plans = _plans(spark, sf_dir, detailed=True)
    return _digest(plans, "lighting", F.array_join("locked_facts", "|").alias("locked"))


def _digest(plans, *more):
    return plans.select(
        "asset_id", "mode", "template_id", F.array_join("card_ids", ",").alias("cards"), "error", F.sha2("positive_prompt", 256).alias("positive_sha"),
        F.sha2("negative_prompt", 256).alias("negative_sha"), *more,
    )


@query("prompt_plans_fallback", f"""WITH {PLANS} SELECT asset_id, mode, template_id, cards, CAST(NULL AS VARCHAR) AS error, sha256({_prompt_sql("ins || chr(10) || direction")}) AS positive_sha, sha256('{C.NEGATIVE_FALLBACK}' || '；' || negative) AS negative_sha FROM pl""")
def prompt_plans_fallback(spark, sf_dir):
    return _digest(_plans(spark, sf_dir, strict=False))


@query("layer_isolation", f"""WITH {PLANS} SELECT asset_id, {" AND ".join(f"contains({_prompt_sql(OPERATION)}, '{h}')" for h in X.HEADERS[:3])} AS headers, NOT EXISTS (SELECT 1 FROM (SELECT unnest(regexp_split_to_array(style, '[，；]')) AS c) WHERE length(c) >= 2 AND contains(basic, c)) AS isolated FROM pl WHERE n >= 2 AND style <> ''""")
def layer_isolation(spark, sf_dir):
    return X.layer_isolation(_plans(spark, sf_dir))


@query("readiness", f"""WITH {FACTS}, c AS (SELECT asset_id, count(*) AS n FROM vf GROUP BY 1) SELECT asset_id, coalesce(n, 0) >= 2 AS ready, CASE WHEN coalesce(n, 0) < 2 THEN '缺少已核验事实：' || coalesce(n, 0) || '/2' END AS reason FROM fx_assets LEFT JOIN c USING (asset_id)""")
def readiness(spark, sf_dir):
    return X.readiness(assets(spark, sf_dir), facts(spark, sf_dir))


@query("stale_plans", f"""WITH {PLANS} SELECT asset_id, n < 2 OR style = '' OR length(asset_id) % 5 = 1 OR length(asset_id) % 7 = 2 AS stale FROM pl""")
def stale_plans(spark, sf_dir):
    """Plans of before, some with another mode or template text, against those of now."""
    now = durable(_plans(spark, sf_dir), "plans")
    n = F.length("asset_id")
    before = now.withColumn("mode", F.when(n % 5 == 1, "older").otherwise(F.col("mode"))).withColumn("format", F.when(n % 7 == 2, "older").otherwise(F.col("format")))
    return X.stale_plans(before, now)


@query("format_template_for_kind", f"SELECT asset_id, t.template_id FROM fx_assets a JOIN {TEMPLATES} ON t.kind = a.kind")
def format_template_for_kind(spark, sf_dir):
    return assets(spark, sf_dir).join(F.broadcast(C.format_templates(spark)), "kind").select("asset_id", "template_id")


@query("ratio_pixels", f"""SELECT s.asset_id, s.option_id AS ratio, r.width, r.height, list_contains(string_split(t.ratios, ','), s.option_id) AS recommended FROM fx_selections s JOIN {C.sql_values(C.RATIOS, 'ratio, width, height').replace('AS t(', 'AS r(')} ON r.ratio = s.option_id JOIN {TEMPLATES} ON t.kind = s.kind""")
def ratio_pixels(spark, sf_dir):
    chosen = view(spark, sf_dir, "fx_selections").withColumnRenamed("option_id", "ratio")
    rows = chosen.join(F.broadcast(C.ratio_table(spark)), "ratio").join(F.broadcast(C.format_templates(spark)), "kind")
    return rows.select("asset_id", "ratio", "width", "height", F.array_contains(F.split("ratios", ","), F.col("ratio")).alias("recommended"))


@query("style_only", f"WITH {STYLE} SELECT card_id, coalesce(f, '') AS style FROM fx_cards LEFT JOIN fr USING (card_id)")
def style_only(spark, sf_dir):
    return view(spark, sf_dir, "fx_cards").select("card_id", S.style_only(F.col("prompt")).alias("style"))


TREE = """up AS (SELECT card_id, card_id AS anc, 0 AS depth, parent_id AS p FROM fx_styles UNION ALL SELECT up.card_id, c.card_id, up.depth + 1, c.parent_id FROM up JOIN fx_styles c ON c.card_id = up.p)"""


@query("style_paths", f"WITH RECURSIVE {TREE}, a AS (SELECT up.card_id, string_agg(title, ' / ' ORDER BY depth DESC) AS path, max(depth) AS depth FROM up JOIN fx_styles s ON s.card_id = anc GROUP BY 1) SELECT a.*, CASE WHEN lifecycle = 'library' THEN 'default' ELSE 'experiment' END AS section FROM a JOIN fx_styles USING (card_id) WHERE lifecycle <> 'archived'")
def style_paths(spark, sf_dir):
    cards = view(spark, sf_dir, "fx_styles")
    return S.style_paths(cards).join(S.selectable_styles(cards).select("card_id", "section"), "card_id")


@query("style_subtree", f"WITH RECURSIVE {TREE} SELECT DISTINCT card_id FROM up WHERE anc IN (SELECT card_id FROM fx_styles WHERE (lifecycle = 'archived' OR card_id = 'r1') AND NOT built_in) AND card_id NOT IN (SELECT card_id FROM fx_styles WHERE built_in)")
def style_subtree(spark, sf_dir):
    cards = view(spark, sf_dir, "fx_styles")
    return S.subtree(cards, cards.where("lifecycle = 'archived' OR card_id = 'r1'"))


#: Styles whose first region hangs below one of its own nations.
RING = "SELECT card_id, CASE WHEN card_id = 'r1' THEN 'n1' WHEN card_id = 'n5' THEN 'n5' ELSE parent_id END AS parent_id, title FROM fx_styles"


@query("style_cycles", f"WITH RECURSIVE c AS ({RING}), b AS (SELECT card_id FROM c WHERE card_id IN ('r1', 'n5') AND parent_id IS NOT NULL UNION SELECT c.card_id FROM c JOIN b ON c.parent_id = b.card_id) SELECT card_id FROM b")
def style_cycles(spark, sf_dir):
    """Cards on or below a cycle: a region below its own nation, a nation below itself."""
    return cyclic_cards(view(spark, sf_dir, RING))


@query("library_faults", f"WITH RECURSIVE {TREE} SELECT card_id FROM fx_styles WHERE lifecycle = 'library' AND card_id NOT IN (SELECT up.card_id FROM up JOIN fx_styles z ON z.card_id = anc WHERE z.sample_url IS NOT NULL)")
def library_faults(spark, sf_dir):
    """Library cards that have no sample and inherit none."""
    return S.library_faults(view(spark, sf_dir, "fx_styles"))


@query("inherited_sample", f"WITH RECURSIVE {TREE}, s AS (SELECT up.card_id, sample_url, depth FROM up JOIN fx_styles z ON z.card_id = anc WHERE sample_url IS NOT NULL) SELECT f.card_id, arg_min(s.sample_url, s.depth) AS sample_url, min(s.depth) AS from_depth FROM fx_styles f LEFT JOIN s USING (card_id) GROUP BY 1")
def inherited_sample(spark, sf_dir):
    return S.inherited_sample(view(spark, sf_dir, "fx_styles"))


@query("style_pack_topk", f"""WITH k AS (SELECT *, {key_sql('prompt')} AS key FROM fx_pack), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_path, key ORDER BY ord) AS first FROM k WHERE key <> '') WHERE first = 1), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY source_path ORDER BY ord) AS INT) AS nth FROM f)
SELECT source_path, nth, sha256(repository || chr(31) || source_commit || chr(31) || source_path || chr(31) || original_id) AS card_id, prompt FROM r WHERE nth <= 7""")
def style_pack_topk(spark, sf_dir):
    return S.style_pack_topk(view(spark, sf_dir, "fx_pack"), 7)


@query("import_style_packs", "SELECT source_path AS pack, original_id AS id, original_id, prompt, category, 'title ' || ord AS title, 'cards' AS repository, 'c1' AS source_commit, 'MIT' AS license, true AS from_file FROM fx_pack")
def import_style_packs(spark, sf_dir):
    """Cards written as packs, a JSON array for each, and read with their provenance."""
    path = new_path(spark, "packs")
    rows = view(spark, sf_dir, "SELECT source_path AS pack, original_id AS id, prompt, category, 'title ' || ord AS title FROM fx_pack")
    packs = rows.groupBy("pack").agg(F.to_json(F.collect_list(F.struct("id", "prompt", "category", "title"))).alias("value"))
    packs.write.partitionBy("pack").text(path)
    read = R.read_style_pack(spark, path, repository="cards", commit="c1", license="MIT")
    return read.select("pack", "id", "original_id", "prompt", "category", "title", "repository", "source_commit", "license", F.contains("source_path", F.lit("/pack=")).alias("from_file"))


@query("near_duplicate_signatures", """WITH d AS (SELECT a.vec_id, b.vec_id AS reuse_id, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS x FROM embeddings a JOIN embeddings b ON b.vec_id < a.vec_id)
SELECT vec_id, reuse_id, round(x, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x, reuse_id) AS r FROM d WHERE x <= 1.05) WHERE r = 1""")
def near_duplicate_signatures(spark, sf_dir):
    return S.near_duplicate_signatures(view(spark, sf_dir, "SELECT vec_id, embedding FROM embeddings"), 1.05)


@query("resolve_options", f"""WITH o AS (SELECT * FROM {OPTIONS_SQL}) SELECT s.asset_id, s.kind, s.parameter, coalesce(v.option_id, d.option_id) AS option_id FROM fx_selections s
LEFT JOIN o v ON v.kind = s.kind AND v.parameter = s.parameter AND v.option_id = s.option_id JOIN o d ON d.kind = s.kind AND d.parameter = s.parameter AND d.is_default""")
def resolve_options(spark, sf_dir):
    return X.resolve_options(view(spark, sf_dir, "fx_selections"), C.prompt_options(spark))


LINKED = f"""lk AS (SELECT s.asset_id, s.kind, t.to_parameter AS parameter, t.to_option AS option_id, 0 AS rk FROM fx_selections s JOIN {LINKS} ON t.parameter = s.parameter AND t.option_id = s.option_id UNION ALL SELECT asset_id, kind, parameter, option_id, 1 FROM fx_selections),
ln AS (SELECT asset_id, kind, parameter, option_id FROM (SELECT *, row_number() OVER (PARTITION BY asset_id, kind, parameter ORDER BY rk, option_id) AS r FROM lk) WHERE r = 1)"""


@query("linked_selections", f"WITH {LINKED} SELECT * FROM ln")
def linked_selections(spark, sf_dir):
    return X.apply_links(view(spark, sf_dir, "fx_selections"), C.option_links(spark))


@query("compile_options", f"""WITH {LINKED}, o AS (SELECT * FROM {OPTIONS_SQL}), rs AS (SELECT s.asset_id, s.kind, s.parameter, coalesce(v.option_id, d.option_id) AS option_id, 0 AS rk FROM ln s LEFT JOIN o v ON v.kind = s.kind AND v.parameter = s.parameter AND v.option_id = s.option_id JOIN o d ON d.kind = s.kind AND d.parameter = s.parameter AND d.is_default WHERE s.parameter <> 'detailLevel'
UNION ALL SELECT a.asset_id, a.kind, o.parameter, o.option_id, 1 FROM (SELECT DISTINCT asset_id, kind FROM ln) a JOIN o ON o.kind = a.kind AND o.is_default AND o.included),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset_id, parameter ORDER BY rk, option_id) AS r FROM rs) WHERE r = 1)
SELECT asset_id, string_agg(prompt_token, ', ' ORDER BY ord) AS prompt FROM p JOIN o ON o.kind = p.kind AND o.parameter = p.parameter AND o.option_id = p.option_id WHERE included AND prompt_token <> '' GROUP BY 1""")
def compile_options(spark, sf_dir):
    return X.compile_options(X.apply_links(view(spark, sf_dir, "fx_selections"), C.option_links(spark)), C.prompt_options(spark))


#: A catalog with faults, derived from parts: brands as parameters, types as options.
VIEWS["fx_catalog"] = """SELECT p_brand AS parameter, CASE p_size % 3 WHEN 0 THEN 'scene' WHEN 1 THEN 'character' ELSE 'prop' END AS kind, CASE WHEN p_partkey % 29 = 0 THEN 'same' ELSE 'o' || p_partkey END AS option_id,
CASE WHEN p_partkey % 31 = 0 THEN ' ' ELSE p_name END AS title, p_type AS detail, CASE WHEN p_partkey % 13 = 0 THEN '' ELSE p_name END AS prompt_token, CASE WHEN p_partkey % 37 = 0 THEN 'other' ELSE p_brand END AS preview_family,
CASE WHEN p_partkey % 29 = 0 THEN 'same' ELSE 'o' || p_partkey END AS preview_variant, p_brand || '.' || CASE WHEN p_partkey % 29 = 0 THEN 'same' ELSE 'o' || p_partkey END AS image_key, p_name AS asset_name, p_partkey % 20 = 0 AS is_default, p_partkey AS ord FROM part"""


@query("dq_option_ids", "SELECT kind, parameter, count(*) AS n, count(DISTINCT option_id) AS n_ids FROM fx_catalog GROUP BY 1, 2 HAVING count(*) <> count(DISTINCT option_id)")
def dq_option_ids(spark, sf_dir):
    return Q.option_faults(view(spark, sf_dir, "fx_catalog"))


@query("dq_defaults", "SELECT kind, parameter, count(*) FILTER (is_default) AS defaults FROM fx_catalog GROUP BY 1, 2 HAVING count(*) FILTER (is_default) <> 1")
def dq_defaults(spark, sf_dir):
    return Q.default_faults(view(spark, sf_dir, "fx_catalog"))


@query("dq_fields", "SELECT ord, option_id FROM fx_catalog WHERE trim(option_id) = '' OR trim(title) = '' OR trim(detail) = '' OR (trim(prompt_token) = '' AND option_id <> 'none')")
def dq_fields(spark, sf_dir):
    return Q.field_faults(view(spark, sf_dir, "fx_catalog")).select("ord", "option_id")


@query("dq_preview", "SELECT ord, option_id FROM fx_catalog WHERE preview_family <> parameter OR preview_variant <> option_id OR image_key <> preview_family || '.' || option_id")
def dq_preview(spark, sf_dir):
    return Q.preview_faults(view(spark, sf_dir, "fx_catalog")).select("ord", "option_id")


@query("dq_census", "SELECT kind, count(*) AS n_options, count(DISTINCT image_key) AS n_keys, count(DISTINCT asset_name) AS n_names FROM fx_catalog GROUP BY 1")
def dq_census(spark, sf_dir):
    return Q.census(view(spark, sf_dir, "fx_catalog"))


PACK_CARDS = "SELECT source_path, CASE WHEN ord % 23 = 0 THEN source_path || '-x' ELSE source_path || '-' || ord END AS card_id, CASE WHEN ord % 19 = 0 THEN '  ' ELSE prompt END AS prompt, license FROM fx_pack"


@query("dq_styles", f"""WITH c AS ({PACK_CARDS}) SELECT card_id, 'duplicate id' AS fault FROM c GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT card_id, 'empty prompt' FROM c WHERE trim(prompt) = '' UNION ALL SELECT card_id, 'no provenance' FROM c WHERE license IS NULL""")
def dq_styles(spark, sf_dir):
    return Q.style_faults(view(spark, sf_dir, PACK_CARDS))


@query("dq_resources", "SELECT p_brand AS set_name, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_partkey || '.png' END AS filename FROM part WHERE p_partkey % 9 = 0 OR p_partkey % 5 = 0")
def dq_resources(spark, sf_dir):
    """Manifests and files derived from parts, some without a file."""
    rows = view(spark, sf_dir, "SELECT p_brand AS set_name, p_partkey, p_partkey || '.png' AS filename FROM part")
    sets = rows.select("set_name", F.when(F.col("p_partkey") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("filename")).alias("filenames"))
    return Q.resource_faults(sets, rows.where("p_partkey % 9 <> 0"))


#: Characters that letters a to z of a text stand for in files in Chinese encodings.
SIMPLIFIED, TRADITIONAL = "夜里的街道下着雨他们慢走回家看见远处传来钟声我你在有", "夜裡的街道下著雨他們慢走回家看見遠處傳來鐘聲我你在有"
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
FILES = """SELECT doc_id, coalesce(text, '') AS text, letters, CASE WHEN doc_id % 8 > 4 AND length(letters) < 20 THEN 0 ELSE doc_id % 8 END AS k
FROM (SELECT doc_id, text, regexp_replace(lower(coalesce(text, '')), '[^a-z]+', ''{}) AS letters FROM documents)"""


@query("import_scripts", f"""SELECT doc_id AS path, CASE WHEN k < 2 THEN 'UTF-8' WHEN k < 4 OR k = 7 THEN 'UTF-16' WHEN k = 5 THEN 'GB18030' WHEN k = 6 THEN 'Big5' END AS charset,
CASE WHEN k < 4 THEN sha256(text) WHEN k = 6 THEN sha256(translate(letters, '{_LETTERS}', '{TRADITIONAL}')) WHEN k > 4 THEN sha256(translate(letters, '{_LETTERS}', '{SIMPLIFIED}')) END AS fingerprint,
CASE WHEN k = 4 THEN 'not decodable' END AS reason FROM ({FILES.format(", 'g'")})""")
def import_scripts(spark, sf_dir):
    """Documents as files in several charsets, with marks and without, some of them broken, imported."""
    rows = view(spark, sf_dir, FILES.format(""))
    byte = lambda x: F.unhex(F.lit(x))
    k = F.col("k")

    def spelt(characters: str, codec: str):
        table = F.create_map(*[F.lit(x) for letter, c in zip(_LETTERS, characters, strict=True) for x in (letter, c.encode(codec).hex())])
        return F.unhex(F.array_join(F.transform(F.split("letters", ""), lambda x: F.element_at(table, x)), ""))

    body = (
        F.when(k == 0, F.encode("text", "UTF-8")).when(k == 1, F.concat(byte("EFBBBF"), F.encode("text", "UTF-8")))
        .when(k == 2, F.concat(byte("FEFF"), F.encode("text", "UTF-16BE"))).when(k == 3, F.concat(byte("FFFE"), F.encode("text", "UTF-16LE")))
        .when(k == 4, F.concat(byte("FF00FF"), F.encode("text", "UTF-8"))).when(k == 5, spelt(SIMPLIFIED, "gb18030")).when(k == 6, spelt(TRADITIONAL, "big5")).otherwise(spelt(SIMPLIFIED, "utf-16-le"))
    )
    files = rows.select(F.col("doc_id").alias("path"), body.alias("content")).withColumn("length", F.octet_length("content"))
    scripts, rejects = R.decode_scripts(files.withColumn("path", F.col("path").cast("string")))
    good = scripts.select("path", "charset", "fingerprint")
    every = good.unionByName(rejects.select("path", "reason"), allowMissingColumns=True)
    return every.withColumn("path", F.col("path").cast("bigint"))


#: Elements of which some stand side by side.
DUAL = "SELECT *, CAST(CASE WHEN script_id % 3 = 1 AND element_idx BETWEEN 2 AND 5 THEN 1 WHEN script_id % 3 = 1 AND element_idx BETWEEN 8 AND 9 THEN 2 END AS INT) AS dual FROM fx_elements"


def _fdx(spark, sf_dir):
    """Elements with every text in three runs, as if styled, some side by side, written and read."""
    path = new_path(spark, "fdx")
    runs = F.array(F.substring("text", 1, 3), F.substring("text", 4, 6), F.call_function("substring", F.col("text"), F.lit(10)))
    K.write_fdx(view(spark, sf_dir, DUAL).withColumn("runs", F.filter(runs, lambda x: x != "")), path)
    return R.read_fdx(spark, path)


@query("import_fdx", f"SELECT CAST(script_id AS VARCHAR) AS script_id, count(*) AS n_elements, count(DISTINCT element) AS n_kinds, count(dual) AS n_dual FROM ({DUAL}) GROUP BY 1")
def import_fdx(spark, sf_dir):
    return _fdx(spark, sf_dir).groupBy("script_id").agg(F.count("*").alias("n_elements"), F.count_distinct("element").alias("n_kinds"), F.count("dual").alias("n_dual"))


@query("fdx_roundtrip", "SELECT script_id, element, text FROM fx_elements WHERE false")
def fdx_roundtrip(spark, sf_dir):
    """Elements that writing and reading Final Draft XML changes, dual dialogue among them: none."""
    ordered = F.row_number().over(_by_script())
    source = view(spark, sf_dir, DUAL).select("script_id", (ordered - 1).alias("element_idx"), "element", "text", "dual")
    back = _fdx(spark, sf_dir).withColumn("script_id", F.col("script_id").cast("bigint"))
    columns = ["script_id", "element_idx", "element", "text", "dual"]
    lost = source.select(*columns).exceptAll(back.select(*columns)).unionByName(back.select(*columns).exceptAll(source.select(*columns)))
    return lost.select("script_id", "element", "text")


def _by_script():
    return Window.partitionBy("script_id").orderBy("element_idx")


def _receipt_stream(spark, sf_dir):
    receipts = view(spark, sf_dir, "fx_receipts")
    source = new_path(spark, "receipts")
    receipts.write.parquet(source)
    return receipts, W.read_receipts(spark, source, receipts.schema)


@query("stream_receipts", """SELECT segment_id, fingerprint, event_id FROM (SELECT *, row_number() OVER (PARTITION BY segment_id, fingerprint ORDER BY ts, event_id) AS nth FROM fx_receipts
WHERE event_type = 'purchase' AND event_id % 43 <> 5 AND event_id % 41 <> 3 AND event_id % 11 <> 0 AND event_id % 13 > 2) WHERE nth = 1""")
def stream_receipts(spark, sf_dir):
    """Receipts written as files, read as a stream; the first of each segment that parses and covers its units is committed."""
    receipts, stream = _receipt_stream(spark, sf_dir)
    expected = receipts.select("segment_id", F.explode(F.array(F.lit("U1"), F.lit("U2"))).alias("unit_id")).distinct()
    target = new_path(spark, "committed")
    W.commit_segments(stream, target, new_path(spark, "progress"), durable(expected, "expected")).awaitTermination()
    return spark.read.schema(receipts.schema).parquet(target).select("segment_id", "fingerprint", "event_id")


#: Extractions and audits of segments; every seventh segment was done before.
SEGMENT_EVENTS = "SELECT segment_id, event_id, ts, user_id, CASE WHEN event_id % 5 = 0 OR user_id % 4 = 1 THEN 'extracted' ELSE 'audit' END AS kind, CAST(CASE WHEN user_id % 6 = 2 THEN 1 ELSE event_id % 3 END AS INT) AS missing FROM fx_receipts"


@query("segment_states", f"""WITH e AS (SELECT * FROM ({SEGMENT_EVENTS})), r AS (SELECT segment_id, missing, row_number() OVER (PARTITION BY segment_id ORDER BY ts, event_id) AS round FROM e WHERE kind = 'audit'),
l AS (SELECT segment_id, CASE WHEN min(CASE WHEN missing = 0 THEN round END) IS NULL THEN max(round) ELSE min(CASE WHEN missing = 0 THEN round END) END AS rounds, min(missing) = 0 AS clean FROM r WHERE round <= 2 GROUP BY 1),
s AS (SELECT segment_id, user_id, max(ts) AS last, bool_or(kind = 'extracted') AS extracted FROM e GROUP BY 1, 2),
z AS (SELECT s.segment_id, coalesce(rounds, 0) AS rounds, last, CASE WHEN clean THEN 'done' WHEN rounds >= 2 THEN 'failed' WHEN rounds = 1 THEN 'audited' WHEN extracted THEN 'extracted' ELSE 'pending' END AS state FROM s LEFT JOIN l USING (segment_id) WHERE user_id % 7 <> 3)
SELECT segment_id, CAST(rounds AS INT) AS rounds, CASE WHEN state NOT IN ('done', 'failed') AND last + INTERVAL 6 HOUR < (SELECT max(ts) FROM e) THEN 'failed' ELSE state END AS state,
CASE WHEN state = 'failed' THEN 'missing' WHEN state <> 'done' AND last + INTERVAL 6 HOUR < (SELECT max(ts) FROM e) THEN 'stalled' END AS reason FROM z""")
def segment_states(spark, sf_dir):
    """Where each segment stands after its events; those that nothing happened to for six hours have failed."""
    events = view(spark, sf_dir, SEGMENT_EVENTS)
    source, target = new_path(spark, "events"), new_path(spark, "states")
    events.write.parquet(source)
    ended = events.where("user_id % 7 = 3").select("segment_id", F.lit("done").alias("state"), F.lit(1).alias("rounds")).distinct()
    states = W.segment_states(W.read_receipts(spark, source, events.schema), stall=timedelta(hours=6), initial=ended)
    W.write_states(states, target, new_path(spark, "progress")).awaitTermination()
    return W.latest_states(spark, target)


@query("stream_scene_counts", f"SELECT segment_id, {OUTCOME} AS outcome, count(*) AS n, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens FROM fx_receipts GROUP BY 1, 2")
def stream_scene_counts(spark, sf_dir):
    """Counts per scene and outcome, rolled up as receipts arrive."""
    _, stream = _receipt_stream(spark, sf_dir)
    target = new_path(spark, "counts")
    W.write_counts(W.scene_counts(stream), target, new_path(spark, "progress")).awaitTermination()
    return W.latest_counts(spark, target)


@query("dq_isolation", "SELECT asset_id, CAST(NULL AS VARCHAR) AS found_in FROM fx_assets WHERE false")
def dq_isolation(spark, sf_dir):
    """Exports and plans hold no quarantined asset: no rows."""
    stored = store(spark, sf_dir, ["fx_candidates", "fx_assets"])
    owned = assets(spark, sf_dir, stored)
    return Q.isolation_faults({"exports": K.exported_assets(owned), "plans": _plans(spark, sf_dir, stored=stored)}, owned)


@query("dq_isolation_planted", "SELECT asset_id, 'exports' AS found_in FROM fx_assets WHERE decision <> 'accepted' AND script_id % 9 = 4 UNION ALL SELECT asset_id, 'plans' FROM fx_assets WHERE decision <> 'accepted' AND script_id % 2 = 0")
def dq_isolation_planted(spark, sf_dir):
    """The same with quarantined assets slipped into exports and plans: these rows."""
    owned = assets(spark, sf_dir)
    exports = K.exported_assets(owned).select("asset_id").unionByName(owned.where("script_id % 9 = 4").select("asset_id"))
    return Q.isolation_faults({"exports": exports, "plans": owned.where("decision = 'accepted' OR script_id % 2 = 0")}, owned)
