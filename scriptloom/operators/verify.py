"""Verification: evidence gates, coverage, routes, receipts and checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trim_unicode

KINDS = ("scene", "character", "prop")


def contains_verbatim(text: Column, quote: Column) -> Column:
    return F.coalesce(F.contains(text, quote), F.lit(False))


def verify_evidence(evidence: DataFrame, scenes: DataFrame) -> DataFrame:
    """Evidence with ``verified``: the quote is a substring of its own scene's text.

    The scene id joins, so containment is a test on joined rows and never a loop over pairs.
    """
    texts = scenes.select("scene_id", "scene_text")
    joined = evidence.join(texts, "scene_id", "left")
    return joined.withColumn("verified", contains_verbatim(F.col("scene_text"), F.col("quote"))).drop("scene_text")


def gate_in_place(candidates: DataFrame) -> DataFrame:
    """Candidates that hold their ``scene_text``, with ``gate`` in its place: named, of a known kind, evidence of two characters or more found in it."""
    cheap = (trim_unicode(F.col("name")) != "") & (F.length("evidence") >= 2) & F.col("kind").isin(*KINDS)
    gate = F.coalesce(cheap, F.lit(False)) & contains_verbatim(F.col("scene_text"), F.col("evidence"))
    return candidates.withColumn("gate", gate).drop("scene_text")


def hard_gate(candidates: DataFrame, scenes: DataFrame) -> DataFrame:
    """Candidates with ``gate``, the text being that of the scene with their id; without one the gate is false."""
    return gate_in_place(candidates.join(scenes.select("scene_id", "scene_text"), "scene_id", "left"))


def decide(scored: DataFrame, threshold: float = 0.92) -> DataFrame:
    """accepted for deterministic rows and scores at the threshold; else conflict behind the gate, rejected before it."""
    decision = (
        F.when(F.col("deterministic"), "accepted").when(~F.col("gate"), "rejected")
        .when(F.col("score") >= threshold, "accepted").otherwise("conflict")
    )
    return scored.withColumn("decision", decision)


def coverage_gaps(expected: DataFrame, covered: DataFrame) -> DataFrame:
    """``(segment_id, unit_id, gap)``: expected units that no reply covers, and units nobody asked for."""
    key = ["segment_id", "unit_id"]
    missing = expected.select(*key).distinct().join(covered, key, "left_anti").withColumn("gap", F.lit("missing"))
    unknown = covered.select(*key).distinct().join(expected, key, "left_anti").withColumn("gap", F.lit("unknown"))
    return missing.unionByName(unknown)


def coverage_ok(segments: DataFrame) -> DataFrame:
    """``(batch_id, ok, n_segments)``; a fault in any segment rejects its whole batch.

    segments: batch_id and the arrays ``expected`` and ``covered``. Sets must be equal and
    ``covered`` free of duplicates.
    """
    same = (F.size(F.array_except("expected", "covered")) == 0) & (F.size(F.array_except("covered", "expected")) == 0)
    single = F.size("covered") == F.size(F.array_distinct("covered"))
    return segments.groupBy("batch_id").agg(F.bool_and(same & single).alias("ok"), F.count("*").alias("n_segments"))


def reconcile_routes(local: DataFrame, cloud: DataFrame) -> DataFrame:
    """``(item_id, outcome)`` of two routes: agree, disagree, local_only or cloud_only.

    Both have item_id, disposition, name and confidence; nulls equal nulls.
    """
    a, b = local.alias("a"), cloud.alias("b")
    same = F.col("a.disposition").eqNullSafe(F.col("b.disposition")) & F.col("a.name").eqNullSafe(F.col("b.name"))
    same = same & F.col("a.confidence").eqNullSafe(F.col("b.confidence"))
    outcome = (
        F.when(F.col("b.item_id").isNull(), "local_only").when(F.col("a.item_id").isNull(), "cloud_only")
        .when(same, "agree").otherwise("disagree")
    )
    joined = a.join(b, F.col("a.item_id") == F.col("b.item_id"), "full_outer")
    return joined.select(F.coalesce("a.item_id", "b.item_id").alias("item_id"), outcome.alias("outcome"))


def novel_with_unique_quote(cloud: DataFrame, ledger: DataFrame, scripts: DataFrame) -> DataFrame:
    """Cloud additions that the ledger doesn't have, with a quote found exactly once in the script.

    Overlapping occurrences count: the second search begins one character after the first.
    """
    new = cloud.join(ledger.select("script_id", "name_key"), ["script_id", "name_key"], "left_anti")
    joined = new.join(scripts.select("script_id", "text"), "script_id")
    first = F.call_function("locate", F.col("quote"), F.col("text"))
    second = F.call_function("locate", F.col("quote"), F.col("text"), first + 1)
    return joined.where((F.col("quote") != "") & (first > 0) & (second == 0)).drop("text")


def candidate_receipt_check(sent: DataFrame, got: DataFrame) -> DataFrame:
    """``(batch_id, missing, duplicated, forged, fallback)`` of candidate ids that came back."""
    counts = got.groupBy("batch_id", "candidate_id").agg(F.count("*").alias("n"))
    both = sent.select("batch_id", "candidate_id").distinct().withColumn("sent", F.lit(True)).join(counts, ["batch_id", "candidate_id"], "full_outer")
    out = both.groupBy("batch_id").agg(
        F.count_if(F.col("n").isNull()).alias("missing"),
        F.count_if((F.col("n") > 1) & F.col("sent").isNotNull()).alias("duplicated"),
        F.count_if(F.col("sent").isNull()).alias("forged"),
    )
    return out.withColumn("fallback", F.col("missing") + F.col("duplicated") + F.col("forged") > 0)


def deterministic_first(deterministic: DataFrame, model: DataFrame) -> DataFrame:
    """Union in which a deterministic row displaces model rows of the same scene, kind and key."""
    key = ["scene_id", "kind", "name_key"]
    rest = model.join(deterministic.select(*key).distinct(), key, "left_anti")
    return deterministic.withColumn("origin", F.lit("deterministic")).unionByName(rest.withColumn("origin", F.lit("model")), allowMissingColumns=True)


def parse_receipts(raw: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows with ``reply`` parsed, rows rejected); malformed replies are never repaired."""
    spoilt = F.from_json("reply", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    parsed = raw.withColumn("parsed", spoilt)
    bad = F.col("parsed").isNull() | F.col("parsed._bad").isNotNull()
    return parsed.where(~bad), parsed.where(bad).drop("parsed")


def load_checkpoints(saved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(checkpoints, warnings) of saved JSON: a corrupt one is skipped, missing fields are null.

    The legacy stage ``reviewing`` is read as ``adjudicating``.
    """
    ok, bad = parse_receipts(saved, "segment string, score int, stage string")
    stage = F.when(F.col("parsed.stage") == "reviewing", "adjudicating").otherwise(F.col("parsed.stage"))
    ok = ok.select("checkpoint_id", F.col("parsed.segment").alias("segment"), F.col("parsed.score").alias("score"), stage.alias("stage"))
    return ok, bad.select("checkpoint_id", F.lit("corrupt checkpoint skipped").alias("warning"))


def classify_receipts(receipts: DataFrame) -> DataFrame:
    """Receipts with ``outcome``; only ``accepted`` ones, stopped by the model with a body, go on.

    A receipt without a status or a finish reason is a bad envelope.
    """
    outcome = (
        F.when(F.col("status").isNull(), "bad_envelope").when(F.col("status") != 200, "resources")
        .when(F.col("finish_reason") == "length", "length").when(F.col("finish_reason") == "content_filter", "content_filter")
        .when(~F.col("finish_reason").eqNullSafe("stop"), "bad_envelope")
        .when(trim_unicode(F.coalesce("content", F.lit(""))) == "", "empty").otherwise("accepted")
    )
    return receipts.withColumn("outcome", outcome)


def committable(receipts: DataFrame, expected: DataFrame) -> DataFrame:
    """Accepted receipts whose reply parses, names its own segment and covers each expected unit exactly once.

    expected: ``(segment_id, unit_id)``. A segment that nothing is expected of can't be committed.
    """
    accepted = classify_receipts(receipts).where("outcome = 'accepted'").drop("outcome")
    parsed, _ = parse_receipts(accepted, "segment string, covered array<string>")
    wanted = expected.groupBy("segment_id").agg(F.sort_array(F.collect_set("unit_id")).alias("wanted"))
    rows = parsed.join(wanted, "segment_id")
    right = (F.col("parsed.segment") == F.col("segment_id")) & (F.sort_array("parsed.covered") == F.col("wanted"))
    return rows.where(right).select(*receipts.columns)


def reusable(checkpoints: DataFrame, plan: DataFrame) -> DataFrame:
    """Planned segments that a checkpoint of the same text already covers."""
    return plan.join(checkpoints.select("fingerprint", "segment_id"), ["fingerprint", "segment_id"], "left_semi")


def pending(checkpoints: DataFrame, plan: DataFrame) -> DataFrame:
    """Planned segments that no checkpoint covers."""
    return plan.join(checkpoints.select("fingerprint", "segment_id"), ["fingerprint", "segment_id"], "left_anti")


def usage_rollup(receipts: DataFrame) -> DataFrame:
    """Requests, tokens, cached and uncached prompt tokens and attempts per model and script."""
    totals = ["prompt_tokens", "completion_tokens", "cache_hit_tokens", "cache_miss_tokens"]
    return receipts.groupBy("model", "script_id").agg(F.count("*").alias("requests"), *[F.sum(t).alias(t) for t in totals], F.max("attempts").alias("most_attempts"))


def dedupe_receipts(receipts: DataFrame) -> DataFrame:
    """The first receipt of each (fingerprint, segment)."""
    order = Window.partitionBy("fingerprint", "segment_id").orderBy("ts", "event_id")
    return receipts.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def normalization_quality(elements: DataFrame) -> DataFrame:
    """Four counts per batch and engine, by which a normalization is picked."""
    return elements.groupBy("batch_id", "engine").agg(
        F.count_if(F.col("element") != "Action").alias("professional"), F.count_if((F.col("element") == "Scene Heading") & (F.length("text") > 4)).alias("headings"),
        F.count_if(trim_unicode(F.col("text")) != "").alias("filled"), F.count_distinct("element").alias("continuity"),
    )


def pick_normalization(quality: DataFrame) -> DataFrame:
    """The best engine of each batch: four metrics in turn, then the engine's name."""
    metrics = ["professional", "headings", "filled", "continuity"]
    order = Window.partitionBy("batch_id").orderBy(*[F.desc(m) for m in metrics], "engine")
    return quality.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def episode_state(segments: DataFrame) -> DataFrame:
    """completed if all are; pending until all have ended; then failed if any failed, else completedWithWarnings."""
    done, failed = F.bool_and(F.col("state") == "completed"), F.bool_or(F.col("state") == "failed")
    ended = F.bool_and(F.coalesce(F.col("state").isin("completed", "completedWithWarnings", "failed"), F.lit(False)))
    state = F.when(~ended, "pending").when(done, "completed").when(failed, "failed").otherwise("completedWithWarnings")
    return segments.groupBy("script_id").agg(state.alias("episode_state"), F.count("*").alias("n"))


def audit_rounds(rounds: DataFrame, most: int = 2) -> DataFrame:
    """``(segment_id, rounds, missing, state)``: a segment's audits up to the first without gaps, ``most`` at most.

    done if that one found nothing missing; failed if ``most`` rounds all did, whatever came after;
    else pending. rounds: segment_id, round and missing (null counts as some). The stream's twin
    is ``segment_states``.
    """
    order = Window.partitionBy("segment_id").orderBy("round")
    first = rounds.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)
    clean = F.min(F.when(F.col("missing") == 0, F.col("nth")))
    held = first.groupBy("segment_id").agg(F.coalesce(clean, F.max("nth")).alias("rounds"), F.when(clean.isNotNull(), 0).otherwise(F.max_by("missing", "nth")).alias("missing"), clean.isNotNull().alias("clean"))
    state = F.when(F.col("clean"), "done").when(F.col("rounds") >= most, "failed").otherwise("pending")
    return held.select("segment_id", "rounds", "missing", state.alias("state"))


def retain_latest(snapshots: DataFrame, k: int = 20) -> DataFrame:
    """The newest k snapshots of each workspace."""
    order = Window.partitionBy("workspace").orderBy(F.desc("created_at"), F.desc("snapshot_id"))
    return snapshots.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)


def route(status: DataFrame) -> DataFrame:
    """Which engines run, by what is available."""
    name = (
        F.when(F.col("local_ready") & F.col("remote_ready"), "local+remote")
        .when(F.col("local_ready"), "local").when(F.col("remote_ready"), "remote").otherwise("deterministic")
    )
    return status.withColumn("route", name)
