"""Scores, consensus, merging, batches and picks."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_key, identity_keys, unique_text

#: Weights of the score profiles by signal: fixed values, in hundredths.
WEIGHTS = {
    "base5": {"model": 35, "evidence": 28, "schema": 17, "consensus": 15, "support": 5},
    "v4": {"deterministic": 18, "evidence": 22, "verdict": 18, "scenes": 10, "identity": 10, "continuity": 8, "schema": 7, "model": 7},
}
#: Layers from the most to the least authoritative: fixed values.
LAYERS = ["source", "canonical", "evidence", "deterministic", "local", "remote", "aggregate"]


def score(signals: DataFrame, profile: str = "v4") -> DataFrame:
    """Add ``score``: the weighted mean of the signals that are present (0 to 1 each), 6 places."""
    weights = WEIGHTS[profile]
    total, present = F.lit(0.0), F.lit(0.0)
    for signal, weight in weights.items():
        total = total + F.coalesce(F.col(signal), F.lit(0.0)) * float(weight)
        present = present + F.when(F.col(signal).isNotNull(), float(weight)).otherwise(0.0)
    return signals.withColumn("score", F.round(F.when(present > 0, total / present), 6))


def consensus(candidates: DataFrame) -> DataFrame:
    """``(scene_id, kind, name_key, n_engines, consensus)``: engines that agree over engines that ran."""
    keyed = candidates.withColumn("name_key", canonical_key(F.col("name")))
    ran = keyed.groupBy("scene_id").agg(F.count_distinct("engine").alias("ran"))
    named = keyed.where("name_key <> ''").groupBy("scene_id", "kind", "name_key").agg(F.count_distinct("engine").alias("n_engines"))
    return named.join(ran, "scene_id").select("scene_id", "kind", "name_key", "n_engines", F.round(F.col("n_engines") / F.col("ran"), 6).alias("consensus"))


def entity_support(candidates: DataFrame, entities: DataFrame) -> DataFrame:
    """Candidates with ``support``: 1 if an external tagger named the same entity in the scene, else 0."""
    named = entities.select("scene_id", "name_key").distinct().withColumn("hit", F.lit(1.0))
    keyed = candidates.withColumn("name_key", canonical_key(F.col("name")))
    return keyed.join(named, ["scene_id", "name_key"], "left").withColumn("support", F.coalesce("hit", F.lit(0.0))).drop("hit")


def scene_support(evidence: DataFrame) -> DataFrame:
    """``(asset_id, n_scenes, n_quotes)``."""
    return evidence.groupBy("asset_id").agg(F.count_distinct("scene_id").alias("n_scenes"), F.count("*").alias("n_quotes"))


def verdict_agreement(verdicts: DataFrame) -> DataFrame:
    """``(candidate_id, n_verdicts, agreement)``: the share of independent verdicts that accept."""
    return verdicts.groupBy("candidate_id").agg(F.count("*").alias("n_verdicts"), F.round(F.avg(F.col("accept").cast("double")), 6).alias("agreement"))


def evidence_quality(verified: DataFrame) -> DataFrame:
    """``(asset_id, quality)``: verified quotes over quotes."""
    return verified.groupBy("asset_id").agg(F.round(F.avg(F.col("verified").cast("double")), 6).alias("quality"))


def stability(candidates: DataFrame) -> DataFrame:
    """``(script_id, kind, name_key, identity, continuity)``: the commonest spelling's share, one over the states."""
    keyed = candidates.withColumn("name_key", canonical_key(F.col("name"))).where("name_key <> ''")
    key = ["script_id", "kind", "name_key"]
    spelt = keyed.groupBy(*key, "name").agg(F.count("*").alias("n")).groupBy(*key).agg(F.round(F.max("n") / F.sum("n"), 6).alias("identity"))
    states = keyed.groupBy(*key).agg(F.round(1 / F.count_distinct("continuity_state"), 6).alias("continuity"))
    return spelt.join(states, key)


def agreement(candidates: DataFrame, tagger: str) -> DataFrame:
    """Candidates with ``name_key``, ``consensus``, ``support``, ``identity`` and ``continuity``; those without a name, kind, scene or script go.

    The values are those of ``consensus``, ``entity_support`` (the entities are what the tagger named) and
    ``stability``, where a scene is of one script. All are windows within a script, so rows are shuffled once and joined with nothing.
    """
    placed = candidates.where("script_id is not null").repartition("script_id").withColumn("name_key", canonical_key(F.col("name")))
    scene, asset = ["script_id", "scene_id"], ["script_id", "kind", "name_key"]
    distinct = lambda c, *keys: F.collect_set(c).over(Window.partitionBy(*keys))
    tagged = F.when((F.col("engine") == tagger) & (F.col("name") != ""), F.lower("name"))
    # one sort serves the windows of a scene, another those of an asset
    found = placed.sortWithinPartitions(*scene, "kind", "name_key").select(
        "*", F.size(distinct("engine", *scene, "kind", "name_key")).alias("agree"), F.size(distinct("engine", *scene)).alias("ran"), distinct(tagged, *scene).alias("tagged"),
    ).where("name_key <> '' and kind is not null")
    rows = found.select(
        *candidates.columns, "name_key", F.round(F.col("agree") / F.col("ran"), 6).alias("consensus"), F.array_contains("tagged", F.col("name_key")).cast("double").alias("support"),
    )
    spelt = rows.withColumn("spelt", F.count("*").over(Window.partitionBy(*asset, "name")))
    commonest = F.max("spelt").over(Window.partitionBy(*asset)) / F.count("*").over(Window.partitionBy(*asset))
    # a row without a scene counts among its script's
    stable = spelt.withColumns({"identity": F.round(commonest, 6), "continuity": F.round(1 / F.size(distinct("continuity_state", *asset)), 6)})
    return stable.where("scene_id is not null").drop("spelt")


#: What tells states of one asset apart, besides its continuity state: fixed values.
SCENE_VARIANTS = ["place", "time", "weather", "season", "era", "type"]
OTHER_VARIANTS = ["age", "disguise", "injury", "damage"]


def _variant_key(columns: list[str]) -> Column:
    """Canonical keys of the continuity state and of those variants of the row's kind that the table has."""
    key = lambda c: canonical_key(F.coalesce(F.col(c).cast("string"), F.lit("")))
    of = lambda names: F.concat_ws("|", key("continuity_state"), *[key(c) for c in names if c in columns])
    return F.when(F.col("kind") == "scene", of(SCENE_VARIANTS)).otherwise(of(OTHER_VARIANTS))


def merge_assets(candidates: DataFrame) -> DataFrame:
    """One asset per script, kind, canonical key and state; nothing else is merged on.

    A state is the continuity state with, for scenes, place, time, weather, season, era and type,
    for others age, disguise, injury and damage, as far as the table has these columns. Spellings
    become aliases and quotes are united, in order of appearance; summaries keep every line once;
    the first scene is kept.
    """
    keyed = candidates.withColumn("name_key", canonical_key(F.col("name"))).withColumn("state_key", _variant_key(candidates.columns))
    summary = F.col("summary") if "summary" in candidates.columns else F.lit(None).cast("string")
    rows = keyed.where("name_key <> ''").groupBy("script_id", "kind", "name_key", "state_key").agg(
        F.array_sort(F.collect_list(F.struct("scene_order", "engine", "name", "evidence", summary.alias("summary")))).alias("seen"),
        F.min("scene_order").alias("first_scene_order"),
    )
    ids = identity_keys(F.col("script_id"), F.col("kind"), F.col("name_key"), F.col("state_key"))
    spelt = F.transform("seen", lambda x: x["name"])
    lines = F.flatten(F.transform("seen", lambda x: F.split(F.coalesce(x["summary"], F.lit("")), "\n")))
    return rows.select(
        ids["variant"].alias("asset_id"), ids["identity"].alias("identity_fingerprint"), "script_id", "kind", "name_key", "state_key",
        F.array_distinct(spelt).alias("aliases"), F.element_at(unique_text(spelt), 1).alias("canonical_name"),
        unique_text(F.transform("seen", lambda x: x["evidence"])).alias("quotes"), F.array_join(unique_text(lines), "\n").alias("summary"), "first_scene_order",
    )


def union_engines(outputs: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """The outputs of several engines as one table of these columns and ``engine``; what one lacks is null."""
    named = [df.select(*[c for c in columns if c in df.columns]).withColumn("engine", F.lit(engine)) for engine, df in outputs.items()]
    every = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)
    return every.select(*columns, "engine")


def pack_batches(candidates: DataFrame, items: int = 6, chars: int = 1800) -> DataFrame:
    """Greedy batches in order: ``(script_id, pos, batch_no)``, at most ``items`` rows and ``chars`` characters.

    A row of more characters than that is a batch of its own. Where a batch ends depends on all
    before it, so each task goes through its scripts' rows in order, once, and keeps the state of
    one script only.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        script, batch, n, used = None, -1, 0, 0
        for rows in batches:
            numbers = []
            for own, size in zip(rows.column(0).to_pylist(), rows.column(2).to_pylist(), strict=True):
                if batch < 0 or own != script:
                    script, batch, n, used = own, 0, 0, 0
                elif n >= items or used + size > chars:
                    batch, n, used = batch + 1, 0, 0
                n, used = n + 1, used + size
                numbers.append(batch)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(numbers, pa.int32())], ["script_id", "pos", "batch_no"])

    kind = candidates.schema["script_id"].dataType.simpleString()
    rows = candidates.select("script_id", F.col("pos").cast("int").alias("pos"), F.coalesce("n_chars", F.lit(0)).cast("bigint").alias("n_chars"))
    ordered = rows.repartition("script_id").sortWithinPartitions("script_id", "pos")
    return ordered.mapInArrow(pack, f"script_id {kind}, pos int, batch_no int")


def authoritative(values: DataFrame) -> DataFrame:
    """Of each entity and field the non-null value of the most authoritative layer (rank 1 is the highest)."""
    order = Window.partitionBy("entity", "field").orderBy("layer_rank", "value")
    return values.where("value is not null").withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def cap_tags(tags: DataFrame, k: int) -> DataFrame:
    """The first k tags of each scene and kind."""
    order = Window.partitionBy("scene_id", "kind").orderBy("engine", "name")
    return tags.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)


def directory(assets: DataFrame) -> DataFrame:
    """All assets in the stable order of kind, first scene, key and id."""
    keyed = assets.withColumn("name_key", canonical_key(F.col("canonical_name")))
    return keyed.orderBy("kind", "first_scene_order", "name_key", "asset_id").select("asset_id", "kind", "first_scene_order", "name_key")


def first_result(results: DataFrame) -> DataFrame:
    """The first generated result of each style node, its sample."""
    order = Window.partitionBy("node_id").orderBy("created_at", "result_id")
    return results.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")
