"""Data-quality checks as set-based queries: each returns the rows at fault."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim_unicode


def option_faults(options: DataFrame) -> DataFrame:
    """Kinds and parameters whose option ids aren't unique."""
    return options.groupBy("kind", "parameter").agg(F.count("*").alias("n"), F.count_distinct("option_id").alias("n_ids")).where("n <> n_ids")


def default_faults(options: DataFrame) -> DataFrame:
    """Kinds and parameters without exactly one default."""
    return options.groupBy("kind", "parameter").agg(F.count_if("is_default").alias("defaults")).where("defaults <> 1")


def field_faults(options: DataFrame) -> DataFrame:
    """Options with an empty id, title or detail, or an empty token where the id isn't ``none``."""
    blank = lambda c: trim_unicode(F.coalesce(c, F.lit(""))) == ""
    return options.where(blank("option_id") | blank("title") | blank("detail") | (blank("prompt_token") & (F.col("option_id") != "none")))


def preview_faults(options: DataFrame) -> DataFrame:
    """Options whose preview disagrees with them."""
    key = F.concat("preview_family", F.lit("."), "option_id")
    return options.where((F.col("preview_family") != F.col("parameter")) | (F.col("preview_variant") != F.col("option_id")) | (F.col("image_key") != key))


def census(options: DataFrame) -> DataFrame:
    """Per kind: options, keys and asset names."""
    return options.groupBy("kind").agg(F.count("*").alias("n_options"), F.count_distinct("image_key").alias("n_keys"), F.count_distinct("asset_name").alias("n_names"))


def resource_faults(image_sets: DataFrame, files: DataFrame) -> DataFrame:
    """Manifests that declare no file, and declared files that don't exist: ``(set_name, filename)``."""
    declared = image_sets.select("set_name", F.explode_outer("filenames").alias("filename"))
    return declared.join(files.select("set_name", "filename"), ["set_name", "filename"], "left_anti")


def style_faults(cards: DataFrame) -> DataFrame:
    """``(card_id, fault)``: duplicate id, empty prompt or missing provenance."""
    twice = cards.groupBy("card_id").agg(F.count("*").alias("n")).where("n > 1").select("card_id", F.lit("duplicate id").alias("fault"))
    empty = cards.where(trim_unicode(F.coalesce("prompt", F.lit(""))) == "").select("card_id", F.lit("empty prompt").alias("fault"))
    source = cards.where(F.col("source_path").isNull() | F.col("license").isNull()).select("card_id", F.lit("no provenance").alias("fault"))
    return twice.unionByName(empty).unionByName(source)


def isolation_faults(outputs: dict[str, DataFrame], assets: DataFrame) -> DataFrame:
    """``(asset_id, found_in)``: assets that aren't accepted, in exports, plans or whatever is named here."""
    quarantined = assets.where(~F.col("decision").eqNullSafe("accepted")).select("asset_id")
    rows = [df.select("asset_id").distinct().withColumn("found_in", F.lit(name)) for name, df in outputs.items()]
    return functools.reduce(DataFrame.unionByName, rows).join(quarantined, "asset_id", "left_semi")
