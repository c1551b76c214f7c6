"""Fountain: lines of a screenplay as its elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trim_unicode

HEADING = r"^(?:(?i:INT\.?/EXT|EXT\.?/INT|INT|EXT|EST|I/E)[. ]|[内內]景|外景|[内內外][.．、 ])|^\.[^.]"
TRANSITION = (
    r"^(?:[\p{Lu} ]+TO:|(?:FADE|CUT|SMASH CUT|MATCH CUT|JUMP CUT|DISSOLVE|WIPE|IRIS)(?: [\p{Lu} ]+)?[.:]|(?:淡入|淡出|切至|切入|叠化|疊化|溶入|溶出|化入|化出|黑场|黑場|转场|轉場)[：:。.]?)$|^>.*[^<]$"
)
#: What may follow a speaker's name: (V.O.), （画外音）, a colon, the mark of dual dialogue.
EXTENSIONS = r"(?:\s*[(（][^()（）]*[)）])*[：:]?\s*\^?$"
#: A name in capitals with two letters at least, or one of two to ten Chinese characters (of one, if a colon follows).
CUE = r"^(?=[^(（]*\p{Lu}[^(（]*\p{Lu})[\p{Lu}\p{N}][\p{Lu}\p{M}\p{N} .'’&/#_-]*" + EXTENSIONS + r"|^(?:[\p{IsHan}][\p{IsHan}·]{1,9}|[\p{IsHan}](?=[：:]))" + EXTENSIONS
#: The same for plain lines, with ``.`` for any character and ``$`` for the end only.
PLAIN_HEADING = r"(?d)^(?:(?i:INT|EXT|EST|I/E|INT\./EXT)[. ]|内景|外景|内[.．、 ]|外[.．、 ])|^\.[^.]"
PLAIN_TRANSITION = r"(?d)^[A-Z ]+TO:\z|^>.*[^<]\z"
PLAIN_CUE = r"(?d)^@.+|^[A-Z][A-Z0-9 .'-]{0,39}\z"
TITLE_KEY = r"^(?i:title|credit|authors?|source|draft date|date|contact|copyright|notes|revision)\s*:"


def cue_name(c: Column) -> Column:
    """The speaker of a cue: without mark, extensions and colon."""
    return trim_unicode(F.regexp_replace(F.regexp_replace(c, EXTENSIONS, ""), "^@", ""))


def _opened(c: Column, begin: str, end: str) -> Column:
    """in where a line leaves a span open, out where it closes the last, else null: how a line changes the state before it."""
    return F.when(c.rlike(f"{begin}(?!.*{end})"), "in").when(c.rlike(end), "out")


def _without(c: Column, inside: Column, begin: str, end: str) -> Column:
    """A trimmed line without spans, of which one may be open before it and one after it, trimmed; most lines have none and one test shows it."""
    rest = F.when(inside & c.rlike(end), F.regexp_replace(c, f"^.*?{end}", "")).when(inside, "").otherwise(c)
    cut = F.regexp_replace(F.regexp_replace(rest, f"{begin}.*?{end}", ""), f"{begin}.*$", "")
    return F.when(inside | c.rlike(begin), trim_unicode(cut)).otherwise(c)


def classify_elements(units: DataFrame) -> DataFrame:
    """``(script_id, unit_idx, element, text, dual)`` of Fountain lines.

    Scene Heading, Transition, Character, Parenthetical, Dialogue, Lyrics, Action, Section, Synopsis, Page
    Break, Title Page, and Note or Boneyard for lines that are nothing else. Marks force an element (``.``
    ``>`` ``@`` ``!`` ``~``); ``[[notes]]`` and ``/* boneyard */`` may run over lines, notes up to a blank one.
    Whether a line is inside of one is the last change that a line before it made.

    A Character is a name in capitals (``ANNA (V.O.)``, ``ÉMILE (cont'd)``), in Chinese characters (``李雷（画外音）``) or a
    ``@`` line after a blank line, that another line follows at once; dual is true if it ends with ``^``. After
    Action, and in a script without blank lines, no blank one is asked for, but that the next line is no name. All lines
    after it up to a blank line, a heading or another such element are Dialogue, those in brackets Parentheticals.
    units: script_id, unit_idx, text and line_no, by which blank lines show; without line_no there are none.
    All windows are of one script in one order.
    """
    script = Window.partitionBy("script_id")
    order = script.orderBy("unit_idx")
    before, running = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    line = F.col("line_no" if "line_no" in units.columns else "unit_idx")
    rows = units.select("script_id", "unit_idx", "text", trim_unicode(F.col("text")).alias("t_"), (line - F.lag(line).over(order) > 1).alias("blank_"))
    rows = rows.withColumns({"gap_": F.coalesce("blank_", F.lit(True)), "cut_": _opened(F.col("t_"), r"/\*", r"\*/")})
    cut = F.coalesce(F.last("cut_", ignorenulls=True).over(before) == "in", F.lit(False))
    rows = rows.withColumns({"block_": F.sum(F.col("gap_").cast("int")).over(running), "spaced_": F.coalesce(F.bool_or("blank_").over(script), F.lit(False)), "left_": _without(F.col("t_"), cut, r"/\*", r"\*/")})
    note = F.coalesce(_opened(F.col("left_"), r"\[\[", r"\]\]"), F.when(F.col("gap_"), "out"))
    inside = F.when(F.col("gap_"), False).otherwise(F.coalesce(F.last("note_", ignorenulls=True).over(before) == "in", F.lit(False)))
    rows = rows.withColumn("note_", note).withColumn("x_", _without(F.col("left_"), inside, r"\[\[", r"\]\]"))
    nothing = (F.col("x_") == "") & (F.col("t_") != "")
    aside = rows.where(nothing).select("script_id", "unit_idx", F.when(F.col("left_") == "", "Boneyard").otherwise("Note").alias("element"), "text", F.lit(False).alias("dual"))

    x = F.col("x_")
    rows = rows.where(~nothing).select(
        "script_id", "unit_idx", "text", "x_", "spaced_", "block_", (F.col("block_") > F.coalesce(F.lag("block_").over(order), F.lit(0))).alias("gap_"),
        F.coalesce(F.first("x_").over(running).rlike(TITLE_KEY) & (F.col("block_") == 1), F.lit(False)).alias("title_"),
    )
    kind = (
        F.when(F.col("title_"), "Title Page").when(x.rlike("^!"), "Action").when(x.rlike(r"^>.*<$"), "Action").when(x.rlike("^={3,}$"), "Page Break").when(x.rlike("^#"), "Section")
        .when(x.rlike("^="), "Synopsis").when(x.rlike("^@.+"), "cue").when(x.rlike(HEADING), "Scene Heading").when(x.rlike(TRANSITION), "Transition")
        .when(x.rlike("^~"), "Lyrics").when(x.rlike(CUE), "cue")
    )
    rows = rows.withColumn("kind_", kind)
    ends = F.coalesce(~F.col("kind_").isin("cue", "Lyrics"), F.lit(False))
    rows = rows.withColumns({"ends_": ends, "name_": F.coalesce(F.col("kind_") == "cue", F.lit(False))})
    followed = F.coalesce(~F.lead(F.col("gap_") | F.col("ends_")).over(order), F.lit(False))
    unlike_next = ~F.coalesce(F.lead("name_").over(order), F.lit(True))
    apart = F.when(F.col("spaced_"), F.col("gap_") | F.coalesce(F.lag("ends_").over(order), F.lit(True))).otherwise(unlike_next)
    rows = rows.withColumns({"cue_": F.col("name_") & followed & apart, "late_": F.col("name_") & followed & unlike_next})
    speech = lambda: F.coalesce(F.last(F.when(F.col("gap_") | F.col("ends_") | F.col("cue_"), F.col("cue_")), ignorenulls=True).over(running), F.lit(False))
    rows = rows.withColumn("spoken_", speech()).withColumn("cue_", F.col("cue_") | (F.col("late_") & ~F.col("spoken_")))
    spoken = speech()
    element = (
        F.when(F.col("cue_"), "Character").when(F.col("ends_"), F.col("kind_")).when(F.col("kind_") == "Lyrics", "Lyrics")
        .when(spoken & x.rlike(r"^[(（].*[)）]$"), "Parenthetical").when(spoken, "Dialogue").otherwise("Action")
    )
    found = rows.select("script_id", "unit_idx", element.alias("element"), "text", (F.col("cue_") & x.rlike(r"\^$")).alias("dual"))
    return found.unionByName(aside)


def classify_plain_lines(units: DataFrame) -> DataFrame:
    """``(script_id, unit_idx, element, text)`` of lines rendered without Fountain's marks and blank lines.

    Scene Heading, Transition, Character, Parenthetical, Dialogue and Action only. Every line that begins with ``@`` and every
    name in ASCII capitals, of one letter or more, is a Character if a line follows at once that is no name, heading or transition;
    also within Dialogue, which no blank line has to end.
    units: script_id, unit_idx, text and line_no, by which blank lines show.
    """
    order = Window.partitionBy("script_id").orderBy("unit_idx")
    x = trim_unicode(F.col("text"))
    heading, transition = x.rlike(PLAIN_HEADING), x.rlike(PLAIN_TRANSITION)
    rows = units.select(
        "script_id", "unit_idx", "text", F.coalesce(F.col("line_no") - F.lag("line_no").over(order) > 1, F.lit(True)).alias("gap_"),
        F.when(heading, "Scene Heading").when(transition, "Transition").alias("kind_"), (~heading & ~transition & x.rlike(PLAIN_CUE)).alias("name_"),
        x.rlike(r"(?d)^\(.*\)\z").alias("aside_"),
    )
    ends = F.col("gap_") | F.col("kind_").isNotNull()
    rows = rows.withColumn("cue_", F.col("name_") & F.coalesce(~F.lead(ends | F.col("name_")).over(order), F.lit(False)))
    spoken = F.last(F.when(ends | F.col("cue_"), F.col("cue_")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    element = (
        F.when(F.col("kind_").isNotNull(), F.col("kind_")).when(F.col("cue_"), "Character").when(spoken & F.col("aside_"), "Parenthetical")
        .when(spoken, "Dialogue").otherwise("Action")
    )
    return rows.select("script_id", "unit_idx", element.alias("element"), "text")
