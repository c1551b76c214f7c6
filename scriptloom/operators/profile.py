"""Profiles: fact groups, appearances, roll-ups, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SOME_TEXT, canonical_key, once, trim_unicode, unique_text
from ..sources.catalogs import PROFILE_FOOTER


def _ordered(field: str, *order: str) -> Column:
    """Values of a group in order, as an array."""
    rows = F.array_sort(F.collect_list(F.struct(*order, field)))
    return F.transform(rows, lambda r: r[field])


def verified_facts(facts: DataFrame, scenes: DataFrame) -> DataFrame:
    """Facts whose evidence is a substring of their own scene's text."""
    joined = facts.join(scenes.select("scene_id", "scene_text"), "scene_id")
    return joined.where(F.contains("scene_text", "evidence")).drop("scene_text")


def fact_groups(facts: DataFrame, kinds: DataFrame) -> DataFrame:
    """``(asset_id, fact_kind, ord, group_values, evidence_count)`` in the fixed order of the asset's kind.

    Values are unique by key; evidence_count counts the facts before that. A group without a
    non-blank value, or of a fact kind that the asset's kind doesn't have, is dropped.
    """
    # a group without a value is told by its facts: a test of group_values would make them twice
    filled = F.bool_or(F.col("value").rlike(SOME_TEXT)).alias("filled")
    grouped = facts.groupBy("asset_id", "kind", "fact_kind").agg(_ordered("value", "pos").alias("listed"), F.count("*").alias("evidence_count"), filled).where("filled")
    found = grouped.withColumn("group_values", unique_text(F.col("listed"))).join(F.broadcast(kinds.select("kind", "fact_kind", "ord")), ["kind", "fact_kind"])
    return found.select("asset_id", "kind", "fact_kind", "ord", "group_values", "evidence_count")


def missing_kinds(assets: DataFrame, groups: DataFrame, kinds: DataFrame) -> DataFrame:
    """``(asset_id, fact_kind, ord)``: recommended kinds that an asset has no group for."""
    wanted = assets.select("asset_id", "kind").join(F.broadcast(kinds.where("recommended")), "kind")
    return wanted.join(groups.select("asset_id", "fact_kind"), ["asset_id", "fact_kind"], "left_anti").select("asset_id", "fact_kind", "ord")


def asset_scenes(assets: DataFrame, evidence: DataFrame, facts: DataFrame, scenes: DataFrame) -> DataFrame:
    """``(asset_id, scene_id, scene_order, heading)``: scenes that evidence or facts name.

    Unknown scene ids are dropped. An asset left without any takes the script's scene at its
    ``first_scene_order``, if there is one.
    """
    named = evidence.select("asset_id", "scene_id").unionByName(facts.select("asset_id", "scene_id")).distinct()
    own = scenes.select("scene_id", "script_id", "scene_order", "heading")
    found = named.join(own.drop("script_id"), "scene_id").join(assets.select("asset_id"), "asset_id", "left_semi")
    lonely = assets.select("asset_id", "script_id", F.col("first_scene_order").alias("scene_order")).join(found, "asset_id", "left_anti")
    fallback = lonely.join(own, ["script_id", "scene_order"])
    columns = ["asset_id", "scene_id", "scene_order", "heading"]
    return found.select(*columns).unionByName(fallback.select(*columns))


def _quotes(evidence: DataFrame, facts: DataFrame) -> DataFrame:
    return evidence.select("asset_id", "scene_id", F.lit(0).alias("source"), "pos", "quote").unionByName(
        facts.select("asset_id", "scene_id", F.lit(1).alias("source"), "pos", F.col("evidence").alias("quote"))
    )


def scene_appearances(referenced: DataFrame, evidence: DataFrame, facts: DataFrame) -> DataFrame:
    """Referenced scenes with ``quotes``: unique evidence quotes, then fact evidence, in order."""
    listed = _quotes(evidence, facts).groupBy("asset_id", "scene_id").agg(unique_text(_ordered("quote", "source", "pos")).alias("quotes"))
    joined = referenced.join(listed, ["asset_id", "scene_id"], "left")
    return joined.withColumn("quotes", F.coalesce("quotes", F.array().cast("array<string>")))


def episode_appearances(appearances: DataFrame, index: DataFrame) -> DataFrame:
    """``(asset_id, episode_number, episode_title, n_scenes, scene_ids, n_quotes)``.

    A scene without an episode counts as episode 1; the title is the first that isn't blank, in
    scene order.
    """
    known = index.select("scene_id", "episode_number", "episode_title")
    rows = appearances.join(known, "scene_id", "left").withColumn("episode_number", F.coalesce("episode_number", F.lit(1)))
    title = F.when(trim_unicode(F.col("episode_title")) != "", F.col("episode_title"))
    return rows.groupBy("asset_id", "episode_number").agg(
        F.min_by(title, F.when(title.isNotNull(), F.col("scene_order"))).alias("episode_title"),
        F.count("*").alias("n_scenes"),
        _ordered("scene_id", "scene_order").alias("scene_ids"),
        F.sum(F.size("quotes")).alias("n_quotes"),
    )


def profiles(assets: DataFrame, evidence: DataFrame, facts: DataFrame, referenced: DataFrame) -> DataFrame:
    """``(asset_id, scene_count, source_evidence_count, confidence)``.

    confidence = min(1, .65 validated + .25 mean fact confidence (validated without facts) + .10 if
    the asset appears in a scene), 6 places, halves up.
    """
    seen = referenced.groupBy("asset_id").agg(F.count("*").alias("scene_count"))
    clean = evidence.withColumn("key", canonical_key(F.col("quote"))).where("key <> ''")
    quotes = clean.groupBy("asset_id").agg(F.count_distinct("key").alias("source_evidence_count"))
    # summed as decimals, so that the order in which tasks meet the facts doesn't show
    mean = F.sum(F.col("confidence").cast("decimal(18,9)")).cast("double") / F.count("confidence")
    sure = facts.groupBy("asset_id").agg(mean.alias("fact_confidence"))
    rows = assets.join(seen, "asset_id", "left").join(quotes, "asset_id", "left").join(sure, "asset_id", "left")
    validated = F.col("validated_confidence")
    total = validated * 0.65 + F.coalesce("fact_confidence", validated) * 0.25 + F.when(F.col("scene_count") > 0, 0.10).otherwise(0.0)
    zero = F.lit(0).cast("bigint")
    return rows.select(
        "asset_id", F.coalesce("scene_count", zero).alias("scene_count"), F.coalesce("source_evidence_count", zero).alias("source_evidence_count"),
        F.round(F.least(F.lit(1.0), total) + 1e-9, 6).alias("confidence"),
    )


def _groups_in_order(groups: DataFrame) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("ord", "fact_kind", "group_values")))
    return groups.groupBy("asset_id").agg(rows.alias("groups"))


def overview(assets: DataFrame, groups: DataFrame) -> DataFrame:
    """``(asset_id, overview)``: the first six fact groups, else the summary, else a stock sentence."""
    rows = assets.join(_groups_in_order(groups), "asset_id", "left")
    first = F.slice(F.coalesce("groups", F.array().cast(rows.schema["groups"].dataType)), 1, 6)
    details = F.array_join(F.transform(first, lambda g: F.concat(g["fact_kind"], F.lit("："), F.array_join(g["group_values"], "；"))), "；")
    body = F.when(details != "", details).otherwise(trim_unicode(F.coalesce("summary", F.lit(""))))
    name = F.concat(F.col("kind"), F.lit("“"), F.col("canonical_name"), F.lit("”"))
    text = F.when(body == "", F.concat(name, F.lit("的证据锁定基础资料。"))).otherwise(F.concat(name, F.lit("："), body))
    return rows.select("asset_id", text.alias("overview"))


def profile_text(assets: DataFrame, groups: DataFrame, missing: DataFrame) -> DataFrame:
    """``(asset_id, text)``: the basic layer of a prompt; episodes are left out of it on purpose."""
    lacking = missing.groupBy("asset_id").agg(_ordered("fact_kind", "ord").alias("lacking"))
    rows = assets.join(_groups_in_order(groups), "asset_id", "left").join(lacking, "asset_id", "left")
    aliases = once(unique_text(F.col("aliases")), lambda a: F.when(F.size(a) > 0, F.concat(F.lit("明确别名："), F.array_join(a, "、"))))
    lines = F.array(
        F.lit("【基本资料】"),
        F.concat(F.lit("类型："), F.col("kind")),
        F.concat(F.lit("名称："), F.col("canonical_name")),
        aliases,
        F.when(F.size("groups") > 0, F.array_join(F.transform("groups", lambda g: F.concat(g["fact_kind"], F.lit("："), F.array_join(g["group_values"], "；"))), "\n")),
        F.when(trim_unicode(F.col("continuity_state")) != "", F.concat(F.lit("连续性状态："), trim_unicode(F.col("continuity_state")))),
        F.when(F.size("lacking") > 0, F.concat(F.lit("剧本未明确、禁止臆造："), F.array_join("lacking", "、"))),
        F.lit(PROFILE_FOOTER),
    )
    return rows.select("asset_id", F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n").alias("text"))


def whole_profiles(assets: DataFrame, groups: DataFrame, missing: DataFrame, appearances: DataFrame, evidence: DataFrame, facts: DataFrame, rolled: DataFrame, version: int = 1) -> DataFrame:
    """All that is known of each asset: its text, overview, aliases, fact groups, missing kinds, roll-up and, by episode, its scenes with their quotes.

    appearances: rows of ``asset_scenes`` with ``episode_number`` and ``episode_title``; a scene without an
    episode counts as episode 1, as in ``episode_appearances``. rolled: rows of ``profiles``. Quotes are
    dealt by asset once and grouped there by scene and episode.
    """
    said = _quotes(evidence, facts).select("asset_id", "scene_id", F.struct("source", "pos", "quote").alias("said"))
    number = F.coalesce("episode_number", F.lit(1)).alias("episode_number")
    shown = appearances.select("asset_id", "scene_id", F.struct(number, "episode_title", "scene_order", "heading").alias("shown"))
    rows = said.unionByName(shown, allowMissingColumns=True).repartition("asset_id").groupBy("asset_id", "scene_id")
    rows = rows.agg(F.collect_list("said").alias("said"), F.collect_list("shown").alias("shown")).where(F.size("shown") > 0)
    rows = rows.withColumn("quotes", unique_text(F.transform(F.array_sort("said"), lambda q: q["quote"])))
    rows = rows.select("asset_id", "scene_id", "quotes", F.inline("shown"))
    title = F.when(trim_unicode(F.col("episode_title")) != "", F.col("episode_title"))
    listed = F.array_sort(F.collect_list(F.struct("scene_order", "scene_id", "heading", "quotes")))
    scenes = F.transform(listed, lambda s: F.struct(*(s[x].alias(x) for x in ("heading", "quotes", "scene_id", "scene_order"))))
    seen = rows.groupBy("asset_id", "episode_number").agg(F.min_by(title, F.when(title.isNotNull(), F.col("scene_order"))).alias("episode_title"), scenes.alias("scenes"))
    seen = seen.groupBy("asset_id").agg(F.array_sort(F.collect_list(F.struct("episode_number", "episode_title", "scenes"))).alias("episodes"))
    valued = groups.groupBy("asset_id").agg(F.array_sort(F.collect_list(F.struct("ord", "evidence_count", "fact_kind", "group_values"))).alias("fact_groups"))
    valued = valued.withColumn("fact_groups", F.transform("fact_groups", lambda g: F.struct(g["evidence_count"].alias("evidence_count"), g["fact_kind"].alias("fact_kind"), g["group_values"].alias("values"))))
    lacking = missing.groupBy("asset_id").agg(_ordered("fact_kind", "ord").alias("missing_fact_kinds"))
    found = assets.select("asset_id", unique_text(F.col("aliases")).alias("aliases"), "continuity_state", F.lit(version).alias("version"))
    for part in (seen, valued, lacking):
        name = part.columns[-1]
        found = found.join(part, "asset_id", "left").withColumn(name, F.coalesce(name, F.array().cast(part.schema[name].dataType)))
    for part in (profile_text(assets, groups, missing), overview(assets, groups), rolled):
        found = found.join(part, "asset_id")
    return found


def locked_facts(assets: DataFrame, facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """``(asset_id, locked)``: unique name, continuity state, fact values and first 12 quotes."""
    values = facts.groupBy("asset_id").agg(_ordered("value", "pos").alias("fact_values"))
    quotes = evidence.groupBy("asset_id").agg(F.slice(_ordered("quote", "pos"), 1, 12).alias("quotes"))
    rows = assets.join(values, "asset_id", "left").join(quotes, "asset_id", "left")
    none = F.array().cast("array<string>")
    every = F.concat(F.array("canonical_name", F.coalesce("continuity_state", F.lit(""))), F.coalesce("fact_values", none), F.coalesce("quotes", none))
    return rows.select("asset_id", unique_text(every).alias("locked"))


def basic_audit(scripts: DataFrame, index: DataFrame, profiled: DataFrame, version: int = 1) -> DataFrame:
    """Per script: counts of episodes (1 at least), scenes, profiles and unresolved scenes, fingerprint, completeness.

    profiled: ``(script_id, asset_id)`` of assets with a profile.
    """
    scenes = index.groupBy("script_id").agg(
        F.count_distinct(F.coalesce("episode_number", F.lit(1))).alias("episodes"), F.count("*").alias("scenes"), F.count_if("unresolved").alias("unresolved")
    )
    counted = profiled.groupBy("script_id").agg(F.count("*").alias("profiles"))
    rows = scripts.select("script_id", F.sha2("text", 256).alias("source_fingerprint")).join(scenes, "script_id", "left").join(counted, "script_id", "left")
    zero = F.lit(0).cast("bigint")
    out = rows.select(
        "script_id", F.lit(version).alias("version"), F.greatest(F.lit(1).cast("bigint"), F.coalesce("episodes", zero)).alias("episode_count"),
        F.coalesce("scenes", zero).alias("scene_count"), F.coalesce("profiles", zero).alias("profile_count"),
        F.coalesce("unresolved", zero).alias("unresolved_scene_count"), "source_fingerprint",
    )
    return out.withColumn("complete", audit_complete())


def audit_complete() -> Column:
    return (F.col("version") >= 1) & (F.col("profile_count") > 0) & (F.col("scene_count") > 0) & (F.col("episode_count") > 0)


def usable(assets: DataFrame) -> DataFrame:
    """Accepted assets: no other reaches exports, plans or counts."""
    return assets.where(F.col("decision") == "accepted")


def automation_summary(assets: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per script: assets by kind and decision, the engines used and the time that they took."""
    counts = assets.groupBy("script_id").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("scene", "character", "prop")],
        *[F.count_if(F.col("decision") == d).alias(f"n_{d}") for d in ("accepted", "conflict", "rejected")],
    )
    engines = candidates.groupBy("script_id").agg(F.sort_array(F.collect_set("engine")).alias("engines"), F.sum("elapsed_ms").alias("elapsed_ms"))
    return counts.join(engines, "script_id", "left")


def completed_scripts(coverage: DataFrame, extraction: DataFrame, assets: DataFrame) -> DataFrame:
    """``(script_id, completed)``: coverage complete, scenes there and all extracted, a usable asset."""
    good = usable(assets).groupBy("script_id").agg(F.count("*").alias("usable"))
    scenes = extraction.groupBy("script_id").agg(F.count("*").alias("scenes"), F.bool_and("extracted").alias("extracted"))
    rows = coverage.join(scenes, "script_id", "left").join(good, "script_id", "left")
    done = F.col("ok") & (F.coalesce("scenes", F.lit(0)) > 0) & F.coalesce("extracted", F.lit(False)) & (F.coalesce("usable", F.lit(0)) > 0)
    return rows.select("script_id", F.coalesce(done, F.lit(False)).alias("completed"))


def needs_migration(projects: DataFrame, assets: DataFrame, version: int = 1) -> DataFrame:
    """Projects with ``needs_rebuild`` and the schema version they get (8 at least)."""
    bare = assets.where("NOT has_profile").select("script_id").distinct().withColumn("bare", F.lit(True))
    rows = projects.join(bare, "script_id", "left")
    rebuild = (F.col("audit_version") != version) | F.col("audit_version").isNull() | F.coalesce("bare", F.lit(False))
    return rows.select("script_id", rebuild.alias("needs_rebuild"), F.greatest(F.lit(8), "schema_version").alias("schema_version"))


def publishable(results: DataFrame, audits: DataFrame) -> DataFrame:
    """Rows of scripts whose audit is complete; the others keep what was published before."""
    return results.join(audits.where("complete").select("script_id"), "script_id", "left_semi")
