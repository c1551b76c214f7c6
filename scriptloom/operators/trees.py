"""Trees kept as (id, parent): what lies above every card, by pointer doubling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import durable


def _parents(cards: DataFrame) -> DataFrame:
    """Cards with ``up``: the parent where there is such a card, else null."""
    there = cards.select(F.col("card_id").alias("up")).distinct()
    return cards.withColumn("up", F.col("parent_id")).join(there.withColumn("there_", F.lit(True)), "up", "left").withColumn("up", F.when(F.col("there_"), F.col("up"))).drop("there_", "parent_id")


def climb(cards: DataFrame, values: dict[str, Column], join: Callable[[Callable[[str], Column], Callable[[str], Column]], dict[str, Column]]) -> DataFrame:
    """``(card_id, up, steps, *values)``: values gathered from each card up to its root.

    At first a card holds its own ``values`` and points to its parent (``up``, ``steps`` = 1). In each round it
    takes over what the card that it points to holds, by ``join`` (columns of the lower and of the upper
    half), and that one's pointer, so the way that it spans doubles: a tree of depth d takes log2(d) + 1
    rounds, each one equi join of the cards with themselves, written as a table. AQE splits a hot
    parent's rows. In the end ``up`` is null, but for cards on or below a cycle: once a span is longer than
    there are cards it has met every card above it, so the rounds stop and ``up`` stays.
    cards: card_id (unique) and parent_id; a parent that isn't there counts as none.
    """
    state = durable(_parents(cards).select("card_id", "up", F.when(F.col("up").isNull(), 0).otherwise(1).cast("bigint").alias("steps"), *[v.alias(k) for k, v in values.items()]), "climb")
    n, span = state.count(), 1
    while span < 2 * n and not state.where("up is not null").isEmpty():
        low, high = state.where("up is not null").alias("low"), state.alias("high")
        joined = join(lambda x: F.col(f"low.{x}"), lambda x: F.col(f"high.{x}"))
        more = low.join(high, F.col("low.up") == F.col("high.card_id")).select(
            "low.card_id", "high.up", (F.col("low.steps") + F.col("high.steps")).alias("steps"), *[joined[k].alias(k) for k in values]
        )
        state = durable(state.where("up is null").unionByName(more), "climb")
        span *= 2
    return state


def cyclic_cards(cards: DataFrame) -> DataFrame:
    """``(card_id)`` of the cards on or below a cycle, which have no root."""
    return climb(cards.select("card_id", "parent_id"), {}, lambda low, high: {}).where("up is not null").select("card_id")


def ancestors(cards: DataFrame) -> DataFrame:
    """``(card_id, ancestor_id, depth)``, each card its own ancestor at depth 0.

    All pairs, so the result has as many rows as cards times their depth. Cards on or below a cycle
    are left out.
    """
    state = durable(_parents(cards.select("card_id", "parent_id")), "climb")
    pairs = durable(state.select("card_id", F.col("card_id").alias("ancestor_id"), F.lit(0).cast("bigint").alias("depth")), "ancestors")
    n, span = state.count(), 1
    while span < 2 * n and not state.where("up is not null").isEmpty():
        above = pairs.select(F.col("card_id").alias("up"), "ancestor_id", (F.col("depth") + span).alias("depth"))
        more = state.where("up is not null").join(above, "up").select("card_id", "ancestor_id", "depth")
        pairs = durable(pairs.unionByName(more), "ancestors")
        upper = state.select(F.col("card_id").alias("up"), F.col("up").alias("next"))
        state = durable(state.join(upper, "up", "left").select("card_id", F.col("next").alias("up")), "climb")
        span *= 2
    cyclic = state.where("up is not null").select("card_id")
    return pairs.join(cyclic, "card_id", "left_anti").select("card_id", "ancestor_id", F.col("depth").cast("int").alias("depth"))
