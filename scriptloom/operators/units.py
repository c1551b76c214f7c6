"""Source units, episodes and scenes.

Windows are always within a script. A script is at most 128 MB of text, so a window's partition is
bounded by the importer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import BLANK, canonical_key, episode_marker, heading_key, utf16_length
from .fountain import cue_name

def source_units(scripts: DataFrame) -> DataFrame:
    """``(script_id, text)`` -> units ``(script_id, unit_id, unit_idx, line_no, start_utf16, len_utf16, text)``.

    A unit is a line with a character that isn't white space. Offsets count UTF-16 units of the
    original text. Null texts have no units.
    """
    lines = scripts.select("script_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    order = Window.partitionBy("script_id").orderBy("line_no")
    before = F.sum(F.col("len_utf16") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1))
    placed = lines.withColumn("len_utf16", utf16_length(F.col("text")))
    placed = placed.withColumn("start_utf16", F.coalesce(before, F.lit(0)).cast("bigint"))
    kept = placed.where(F.regexp_replace("text", f"{BLANK}+", "") != "")
    numbered = kept.withColumn("unit_idx", F.row_number().over(order))
    unit_id = F.concat(F.lit("U"), F.lpad(F.col("unit_idx").cast("string"), 6, "0"))
    return numbered.select("script_id", unit_id.alias("unit_id"), "unit_idx", "line_no", "start_utf16", "len_utf16", "text")


def fixed_slices(scripts: DataFrame, segment: int = 6000, piece: int = 750) -> DataFrame:
    """Cut texts into segments and these into slices, in characters; joined in order they are the text."""
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(piece))
    cut = scripts.where(F.length("text") > 0).select("script_id", "text", F.explode(starts).alias("start"))
    # a slice ends with its segment even where the sizes don't divide
    room = F.lit(piece) if segment % piece == 0 else F.least(F.lit(piece), F.lit(segment) - F.col("start") % segment)
    return cut.select(
        "script_id",
        F.floor(F.col("start") / segment).cast("int").alias("segment_no"),
        F.col("start").cast("int").alias("start"),
        F.substring("text", F.col("start") + 1, room).alias("slice"),
    )


def mark_episodes(units: DataFrame) -> DataFrame:
    """Add ``marker`` (struct of number and title, or null) to units."""
    return units.withColumn("marker", episode_marker(F.col("text")))


def placed_markers(scripts: DataFrame) -> DataFrame:
    """``(script_id, line_no, start, marker)`` of every line; the texts themselves stay where they are, and each line is looked at once."""
    lines = scripts.select("script_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    marked = mark_episodes(lines).select("script_id", "line_no", F.length("text").alias("size"), "marker")
    before = Window.partitionBy("script_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("size") + 1).over(before), F.lit(0)).cast("bigint")
    return marked.select("script_id", "line_no", start.alias("start"), "marker")


def unit_episodes(units: DataFrame) -> DataFrame:
    """Units with their ``episode``: that of the last marker up to the unit, 1 before any."""
    running = Window.partitionBy("script_id").orderBy("unit_idx").rowsBetween(Window.unboundedPreceding, 0)
    marked = mark_episodes(units)
    return marked.withColumn("episode", F.coalesce(F.last("marker.number", ignorenulls=True).over(running), F.lit(1)))


def unit_titles(marked: DataFrame) -> DataFrame:
    """``(script_id, episode, title)``: the first title of each episode that a unit states."""
    titled = marked.where(F.col("marker").isNotNull() & (F.col("marker.title") != ""))
    first = titled.groupBy("script_id", F.col("marker.number").alias("episode"))
    return first.agg(F.min_by("marker.title", "unit_idx").alias("title"))


def scene_votes(scenes: DataFrame, episodes: DataFrame) -> DataFrame:
    """``(script_id, scene_id, pos, episode)``: the episode of each unit that a scene names."""
    named = scenes.select("script_id", "scene_id", F.posexplode("unit_ids").alias("pos", "unit_id"))
    return named.join(episodes.select("script_id", "unit_id", "episode"), ["script_id", "unit_id"])


def scene_episode(votes: DataFrame) -> DataFrame:
    """``(script_id, scene_id, vote)``: the most frequent episode; of equals the first in unit order."""
    counted = votes.groupBy("script_id", "scene_id", "episode").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    best = F.max_by("episode", F.struct(F.col("n"), -F.col("pos")))
    return counted.groupBy("script_id", "scene_id").agg(best.alias("vote"))


def episode_index(scenes: DataFrame, units: DataFrame) -> DataFrame:
    """Scenes with ``episode_number``, ``episode_title`` and ``unresolved``.

    A scene's episode is its units' vote, else its heading's marker, else the number it has, else
    that of the scene before (1 for the first), which counts as unresolved. Its title is the first
    that units state for the episode; else the first that a heading up to the scene states, where
    the heading's marker decided; else its own.
    """
    episodes = unit_episodes(units)
    votes = scene_episode(scene_votes(scenes, episodes))
    rows = scenes.join(votes, ["script_id", "scene_id"], "left").withColumn("marker", episode_marker(F.col("heading")))
    existing = F.when(F.col("episode_number") > 0, F.col("episode_number"))
    known = F.coalesce("vote", F.col("marker.number"), existing)
    order = Window.partitionBy("script_id").orderBy("scene_order")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("known", known).withColumn("resolved", F.coalesce(F.last("known", ignorenulls=True).over(running), F.lit(1)))
    by_heading = F.col("vote").isNull() & F.col("marker").isNotNull() & (F.col("marker.title") != "")
    rows = rows.withColumn("stated", F.when(by_heading, F.col("marker.title")))
    per_episode = Window.partitionBy("script_id", "resolved").orderBy("scene_order").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("from_heading", F.first("stated", ignorenulls=True).over(per_episode))
    titles = unit_titles(episodes).withColumnRenamed("episode", "resolved")
    rows = rows.join(titles, ["script_id", "resolved"], "left")
    return rows.select(
        "script_id", "scene_id", "scene_order", "heading",
        F.greatest(F.lit(1), "resolved").alias("episode_number"),
        F.coalesce("title", "from_heading", "episode_title").alias("episode_title"),
        F.col("known").isNull().alias("unresolved"),
    )


def segment_scenes(elements: DataFrame) -> DataFrame:
    """Each Scene Heading opens a scene: ``(script_id, scene_order, heading, first_element, n_elements)``.

    Elements before the first heading are scene 0 without a heading.
    """
    order = Window.partitionBy("script_id").orderBy("element_idx").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.sum((F.col("element") == "Scene Heading").cast("int")).over(order)
    rows = elements.withColumn("scene_order", opened.cast("int"))
    return rows.groupBy("script_id", "scene_order").agg(
        F.min_by(F.when(F.col("element") == "Scene Heading", F.col("text")), "element_idx").alias("heading"),
        F.min("element_idx").alias("first_element"),
        F.count("*").alias("n_elements"),
    )


def deterministic_assets(elements: DataFrame) -> DataFrame:
    """One scene asset per heading and one character per distinct speaker, with the first scene and count."""
    order = Window.partitionBy("script_id").orderBy("element_idx").rowsBetween(Window.unboundedPreceding, 0)
    # no other element counts, so that only these are sorted
    rows = elements.where((F.col("element") == "Scene Heading") | (F.col("element") == "Character"))
    rows = rows.withColumn("scene_order", F.sum((F.col("element") == "Scene Heading").cast("int")).over(order).cast("int"))
    kind = F.when(F.col("element") == "Character", "character").otherwise("scene")
    key = F.when(F.col("element") == "Character", canonical_key(cue_name(F.col("text")))).otherwise(heading_key(F.col("text")))
    return rows.groupBy("script_id", kind.alias("kind"), key.alias("name_key")).agg(
        F.min("scene_order").alias("first_scene_order"), F.count("*").alias("n_mentions")
    )


def split_guard(marked: DataFrame) -> DataFrame:
    """``(script_id, n_markers, blocked)``: duplicate or backward episode numbers forbid a split."""
    markers = marked.where(F.col("marker").isNotNull()).select("script_id", "unit_idx", F.col("marker.number").alias("number"))
    before = F.lag("number").over(Window.partitionBy("script_id").orderBy("unit_idx"))
    rows = markers.withColumn("back", F.coalesce(F.col("number") <= before, F.lit(False)))
    return rows.groupBy("script_id").agg(F.count("*").alias("n_markers"), F.bool_or("back").alias("blocked"))


def split_episodes(scripts: DataFrame, marked: DataFrame) -> DataFrame:
    """Contiguous untouched parts ``(script_id, part_no, number, part)``, cut where markers stand.

    marked: units with ``start`` (characters) and ``marker``. What comes before the first marker
    is part 0. The parts of a script joined in order are its text.
    """
    starts = marked.where(F.col("marker").isNotNull() & (F.col("start") > 0)).select("script_id", "start", F.col("marker.number").alias("number"))
    cuts = starts.groupBy("script_id").agg(F.array_sort(F.collect_list(F.struct("start", "number"))).alias("cuts"))
    head = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.lit(None).cast("int").alias("number")))
    rows = scripts.select("script_id", "text").join(cuts, "script_id", "left")
    rows = rows.withColumn("cuts", F.when(F.col("cuts").isNull(), head).otherwise(F.concat(head, "cuts")))
    until = lambda i: F.coalesce(F.get(F.col("cuts"), i + 1)["start"], F.length("text").cast("bigint"))
    part = lambda c, i: F.call_function("substring", F.col("text"), c["start"].cast("int") + 1, (until(i) - c["start"]).cast("int"))
    listed = F.transform("cuts", lambda c, i: F.struct(i.alias("part_no"), c["number"].alias("number"), part(c, i).alias("part")))
    return rows.select("script_id", F.explode(listed).alias("p")).select("script_id", "p.part_no", "p.number", "p.part")


def reversible(parts: DataFrame, scripts: DataFrame) -> DataFrame:
    """``(script_id, n_parts, same, fingerprint)``: whether the parts in order are the source text, and the SHA-256 of what they are."""
    pieces = F.array_sort(F.collect_list(F.struct("part_no", "part")))
    whole = parts.groupBy("script_id").agg(F.count("*").alias("n_parts"), F.sha2(F.array_join(F.transform(pieces, lambda p: p["part"]), ""), 256).alias("sha"))
    source = scripts.select("script_id", F.sha2("text", 256).alias("source_sha"))
    return whole.join(source, "script_id").select("script_id", "n_parts", (F.col("sha") == F.col("source_sha")).alias("same"), F.col("sha").alias("fingerprint"))


def frontier(episodes: DataFrame) -> DataFrame:
    """Episodes with ``eligible``: all those before are completed."""
    before = Window.partitionBy("script_id").orderBy("episode").rowsBetween(Window.unboundedPreceding, -1)
    done = F.bool_and(F.col("state") == "completed").over(before)
    return episodes.withColumn("eligible", F.coalesce(done, F.lit(True)))


def relink_scenes(parsed: DataFrame, previous: DataFrame) -> DataFrame:
    """Re-parsed scenes take over ids of previous ones: ``(script_id, scene_order, scene_id, pass)``.

    Pass 1: same position and same heading key. Pass 2: of the rest, the n-th of a key takes the
    n-th previous one of that key. Ids stay unique, also where a loop over scenes would let the
    same id be claimed twice. Scenes without a match have a null id and pass, as have those without a
    heading. One join and one window find both passes. (script_id, scene_order) is unique on both sides.
    """
    new = parsed.select("script_id", "scene_order", heading_key(F.col("heading")).alias("key"), F.lit(True).alias("new"))
    old = previous.select("script_id", "scene_order", heading_key(F.col("heading")).alias("key"), "scene_id", F.lit(True).alias("old"))
    both = new.join(old, ["script_id", "scene_order", "key"], "full_outer").withColumn("same", F.coalesce(F.col("new") & F.col("old"), F.lit(False)))
    both = both.where("new or key is not null")
    so_far = Window.partitionBy("script_id", "key").orderBy("scene_order").rowsBetween(Window.unboundedPreceding, 0)
    count = lambda side: F.sum(F.when(~F.col("same") & F.col(side), 1).otherwise(0)).over(so_far)
    # the n-th new scene without an equal and the n-th old one are a group, as each equal pair is one
    nth = F.when(F.col("same"), F.col("scene_order")).when(F.col("new") & F.col("key").isNull(), F.col("scene_order")).when(F.col("new"), count("new")).otherwise(count("old"))
    groups = both.withColumn("nth", nth).groupBy("script_id", "key", "same", "nth").agg(F.max(F.when(F.col("new"), F.col("scene_order"))).alias("scene_order"), F.max("scene_id").alias("scene_id"))
    passed = F.when(F.col("same"), 1).when(F.col("scene_id").isNotNull(), 2).alias("pass")
    return groups.where("scene_order is not null").select("script_id", "scene_order", "scene_id", passed)
