"""Plan compilation: basic information, style, format and operation as one prompt; option prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import operation_text, trim_unicode, unique_text
from ..operators.profile import locked_facts
from ..operators.styles import style_only
from ..sources.catalogs import NEGATIVE_FALLBACK, NEGATIVE_STRICT

HEADERS = ["【第一部分：基本资料】", "【第二部分：视觉风格】", "【第三部分：格式模板】", "【本轮生成操作】"]


def readiness(assets: DataFrame, facts: DataFrame, min_facts: int = 2) -> DataFrame:
    """``(asset_id, ready, reason)``: at least ``min_facts`` verified facts; a name alone isn't enough."""
    counted = facts.groupBy("asset_id").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0).cast("bigint"))
    reason = F.when(n < min_facts, F.concat(F.lit("缺少已核验事实："), n.cast("string"), F.lit(f"/{min_facts}")))
    return assets.join(counted, "asset_id", "left").select("asset_id", (n >= min_facts).alias("ready"), reason.alias("reason"))


def chosen_styles(selected: DataFrame, cards: DataFrame) -> DataFrame:
    """``(asset_id, card_ids, style)`` in the user's order; unknown cards are left out."""
    joined = selected.join(cards.select("card_id", style_only(F.col("prompt")).alias("fragment")), "card_id")
    rows = F.array_sort(F.collect_list(F.struct("pos", "card_id", "fragment")))
    grouped = joined.groupBy("asset_id").agg(rows.alias("rows"))
    fragments = F.filter(F.transform("rows", lambda r: r["fragment"]), lambda x: x != "")
    return grouped.select("asset_id", F.transform("rows", lambda r: r["card_id"]).alias("card_ids"), F.array_join(fragments, "；").alias("style"))


def plan_details(assets: DataFrame, facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """``(asset_id, lighting, locked_facts)``: the values of lighting facts in order, and what a plan must not change."""
    lights = F.array_sort(F.collect_list(F.when(F.col("fact_kind") == "lighting", F.struct("pos", "value"))))
    light = facts.groupBy("asset_id").agg(F.array_join(F.transform(lights, lambda x: x["value"]), "；").alias("lighting"))
    locked = locked_facts(assets, facts, evidence).withColumnRenamed("locked", "locked_facts")
    return locked.join(light, "asset_id", "left").select("asset_id", F.coalesce("lighting", F.lit("")).alias("lighting"), "locked_facts")


def compile_plans(
    assets: DataFrame, texts: DataFrame, ready: DataFrame, styles: DataFrame, templates: DataFrame, modes: DataFrame, strict: bool = True,
    details: DataFrame | None = None,
) -> DataFrame:
    """One row per asset: the three layers, the operation, both prompts, and ``error``.

    assets: asset_id, kind, mode, direction. Layers come in the order of their authority: basic
    information, style, format, operation. Strict plans of assets that aren't ready have the error
    notReady, those without a style noSelectedStyle, and no prompt; the fallback has no such guard.
    details (of ``plan_details``) adds lighting and locked_facts.
    """
    rows = (
        assets.join(texts.select("asset_id", F.col("text").alias("basic")), "asset_id").join(ready.select("asset_id", "ready"), "asset_id")
        .join(styles, "asset_id", "left").join(F.broadcast(templates), "kind").join(F.broadcast(modes), "mode", "left")
    )
    style = F.coalesce("style", F.lit(""))
    instruction, direction = F.coalesce("instruction", F.lit("")), F.coalesce("direction", F.lit(""))
    operation = operation_text(instruction, direction) if strict else F.concat(instruction, F.lit("\n"), direction)
    layers = [F.concat(F.lit(h + "\n"), layer) for h, layer in zip(HEADERS, [F.col("basic"), style, F.col("positive"), operation], strict=True)]
    positive = F.concat_ws("\n\n", *layers)
    stock = NEGATIVE_STRICT if strict else NEGATIVE_FALLBACK
    negative = F.array_join(unique_text(F.array(F.lit(stock), F.col("negative"))), "；")
    error = F.when(~F.col("ready"), "notReady").when(style == "", "noSelectedStyle") if strict else F.lit(None).cast("string")
    more = ["lighting", "locked_facts"] if details is not None else []
    rows = rows.join(details, "asset_id", "left") if details is not None else rows
    return rows.select(
        "asset_id", "kind", "mode", "template_id", F.coalesce("card_ids", F.array().cast("array<string>")).alias("card_ids"), "basic",
        style.alias("style"), F.col("positive").alias("format"), F.when(error.isNull(), positive).alias("positive_prompt"),
        F.when(error.isNull(), negative).alias("negative_prompt"), error.alias("error"), *more,
    )


def layer_isolation(plans: DataFrame) -> DataFrame:
    """``(asset_id, headers, isolated)``: the three headers are there, no style clause is in the basic layer."""
    headers = F.lit(True)
    for h in HEADERS[:3]:
        headers = headers & F.contains(F.col("positive_prompt"), F.lit(h))
    clauses = F.filter(F.split("style", "[，；]"), lambda x: F.length(x) >= 2)
    return plans.where("positive_prompt is not null").select("asset_id", headers.alias("headers"), (~F.exists(clauses, lambda x: F.contains(F.col("basic"), x))).alias("isolated"))


def stale_plans(stored: DataFrame, current: DataFrame) -> DataFrame:
    """``(asset_id, stale)``: a stored plan differs from what would be compiled now in any of seven ways."""
    a, b = stored.alias("a"), current.alias("b")
    differs = trim_unicode(F.coalesce("a.positive_prompt", F.lit(""))) == ""
    for c in ("mode", "card_ids", "basic", "style", "template_id", "format"):
        differs = differs | ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.join(b, "asset_id").select("asset_id", differs.alias("stale"))


def resolve_options(selections: DataFrame, options: DataFrame) -> DataFrame:
    """Selections ``(asset_id, kind, parameter, option_id)`` with a valid id: their own, else the default's."""
    valid = F.broadcast(options.select("kind", "parameter", "option_id").withColumn("known", F.lit(True)))
    default = F.broadcast(options.where("is_default").select("kind", "parameter", F.col("option_id").alias("default_id")))
    rows = selections.join(valid, ["kind", "parameter", "option_id"], "left").join(default, ["kind", "parameter"])
    return rows.select("asset_id", "kind", "parameter", F.when(F.col("known"), F.col("option_id")).otherwise(F.col("default_id")).alias("option_id"))


def apply_links(selections: DataFrame, links: DataFrame) -> DataFrame:
    """Selections with those that a chosen delivery format sets; a linked value wins over a chosen one."""
    linked = selections.join(F.broadcast(links), ["parameter", "option_id"]).select(
        "asset_id", "kind", F.col("to_parameter").alias("parameter"), F.col("to_option").alias("option_id"), F.lit(0).alias("rank")
    )
    every = selections.withColumn("rank", F.lit(1)).unionByName(linked)
    order = Window.partitionBy("asset_id", "kind", "parameter").orderBy("rank", "option_id")
    return every.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth", "rank")


def compile_options(selections: DataFrame, options: DataFrame) -> DataFrame:
    """``(asset_id, prompt)``: tokens of resolved options in parameter order.

    Parameters that no selection names take their default, hidden ones never appear, and
    ``detailLevel`` is always the default's. An asset is of one kind. The catalog of a kind is one broadcast row, and an
    asset's selections are one row, so that defaults are looked up in place and never become rows to sort.
    """
    own = F.struct("option_id", "included", "ord", "prompt_token")
    default = F.min(F.when(F.col("is_default"), own))
    catalog = options.groupBy("kind", "parameter").agg(default.alias("default"), F.collect_list(own).alias("known")).where("default is not null")
    catalog = catalog.groupBy("kind").agg(F.collect_list(F.struct("parameter", "default", "known")).alias("catalog"))
    free = F.when(F.col("parameter") != "detailLevel", F.struct("parameter", "option_id"))
    rows = selections.groupBy("asset_id", "kind").agg(F.collect_list(free).alias("chosen")).join(F.broadcast(catalog), "kind")

    def picked(p: Column) -> Column:
        """The first of the parameter's chosen options, each the default if unknown; the default if none is chosen."""
        named = F.filter("chosen", lambda c: c["parameter"] == p["parameter"])
        valid = F.transform(named, lambda c: F.coalesce(F.get(F.filter(p["known"], lambda o: o["option_id"] == c["option_id"]), F.lit(0)), p["default"]))
        return F.coalesce(F.array_min(valid), p["default"])

    tokens = F.filter(F.transform("catalog", picked), lambda o: o["included"] & (o["prompt_token"] != ""))
    ordered = F.array_sort(F.transform(tokens, lambda o: F.struct(o["ord"].alias("ord"), o["prompt_token"].alias("prompt_token"))))
    prompt = F.array_join(F.transform(ordered, lambda o: o["prompt_token"]), ", ")
    return rows.select("asset_id", prompt.alias("prompt")).where("prompt <> ''")
