"""Text functions as Column expressions; none leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space: Java's \\s misses the ideographic space, so separators are added by property.
BLANK = r"[\s\p{Z}]"
#: Fits where a text has a character that isn't white space.
SOME_TEXT = r"[^\s\p{Z}]"
#: Numerals and the spellings of episode markers: fixed values.
CHINESE_DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
CHINESE_UNITS = {"十": 10, "百": 100, "千": 1000}
_NUMERAL = "0-9０-９一二三四五六七八九十百千两〇零"
_TITLE = rf"(?:{BLANK}*[-—:：]{BLANK}*(.*))?{BLANK}*$"
#: Fixed values, tried in this order; a later one is used only where the earlier gives no number above zero.
EPISODE_PATTERNS = [
    rf"^第{BLANK}*([{_NUMERAL}]+){BLANK}*(?:集|话|回|章|期){_TITLE}",
    rf"(?i)^(?:EPISODE|EP|E){BLANK}*[-_:#.]?{BLANK}*([0-9０-９]{{1,4}}){_TITLE}",
    rf"^([0-9０-９]{{1,4}}){BLANK}*(?:集|话|回|章|期){_TITLE}",
]
#: How every line that one of the patterns fits begins.
MAY_BE_MARKER = rf"^{BLANK}*(?:第|[eE]|[0-9０-９])"


def trim_unicode(c: Column) -> Column:
    """Trim white space of any kind, line ends and U+3000 included. Null stays null."""
    return F.regexp_replace(c, rf"^{BLANK}+|{BLANK}+$", "")


def canonical_key(c: Column) -> Column:
    """Trimmed, inner white space collapsed, lower case; punctuation and emoji stay."""
    return F.lower(F.regexp_replace(trim_unicode(c), f"{BLANK}+", " "))


def normalized_heading(c: Column) -> Column:
    """Trimmed, with no space around ``-``, ``.``, ``/`` and ``·``, other space collapsed."""
    tight = F.regexp_replace(trim_unicode(c), rf"{BLANK}*([-./·]){BLANK}*", "$1")
    return F.regexp_replace(tight, f"{BLANK}+", " ")


def heading_key(c: Column) -> Column:
    return canonical_key(normalized_heading(c))


def fold_digits(c: Column) -> Column:
    """Full-width digits as ASCII ones."""
    return F.translate(c, "０１２３４５６７８９", "0123456789")


def chinese_number(c: Column) -> Column:
    """Digits or Chinese numerals as an int; of adjacent digits the last counts, null if not above zero.

    A unit multiplies the digit before it (1 if none). Any other character gives null.
    """
    text = fold_digits(c)
    digit = F.create_map(*[F.lit(x) for kv in CHINESE_DIGITS.items() for x in kv])
    unit = F.create_map(*[F.lit(x) for kv in CHINESE_UNITS.items() for x in kv])
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("cur"), F.lit(True).alias("ok"))

    def step(s: Column, ch: Column) -> Column:
        d, u = F.element_at(digit, ch), F.element_at(unit, ch)
        return F.struct(
            F.when(u.isNotNull(), s["total"] + F.greatest(s["cur"], F.lit(1)) * u).otherwise(s["total"]).alias("total"),
            F.when(d.isNotNull(), d).when(u.isNotNull(), F.lit(0)).otherwise(s["cur"]).alias("cur"),
            (s["ok"] & (d.isNotNull() | u.isNotNull())).alias("ok"),
        )

    folded = F.aggregate(F.split(text, ""), start, step, lambda s: F.when(s["ok"], s["total"] + s["cur"]))
    spelled = F.when(text != "", folded)
    number = F.when(text.rlike(r"^[0-9]{1,9}$"), text.try_cast("int")).otherwise(spelled)
    return once(number, lambda n: F.when(n > 0, n))


def episode_marker(c: Column) -> Column:
    """struct(number, title) of a line that is an episode marker, else null; title may be empty.

    Most lines aren't: a test of how a line begins spares them the patterns.
    """

    def of(text: Column, pattern: str) -> Column:
        title = trim_unicode(F.regexp_extract(text, pattern, 2))
        return once(chinese_number(F.regexp_extract(text, pattern, 1)), lambda n: F.when(n.isNotNull(), F.struct(n.alias("number"), title.alias("title"))))

    return F.when(c.rlike(MAY_BE_MARKER), once(trim_unicode(c), lambda text: F.coalesce(*[of(text, p) for p in EPISODE_PATTERNS])))


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 code units."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def fingerprint(c: Column) -> Column:
    """SHA-256 of the text, in hex."""
    return F.sha2(c, 256)


def stable_id(*parts: Column) -> Column:
    """A deterministic id of its parts; a null part counts as empty."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def segment_id(script_fingerprint: Column, start: Column, text: Column) -> Column:
    return stable_id(script_fingerprint, start, text)


def identity_keys(script_id: Column, kind: Column, name: Column, continuity: Column) -> Column:
    """struct(identity, variant): one per asset, and one per asset and continuity state."""
    key = canonical_key(name)
    state = canonical_key(F.coalesce(continuity, F.lit("")))
    return F.struct(stable_id(script_id, kind, key).alias("identity"), stable_id(script_id, kind, key, state).alias("variant"))


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed a single time, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unique_text(values: Column) -> Column:
    """Trimmed non-blank texts, the first spelling of each canonical key, in order.

    Texts are sorted by key and place, so that a key's first text is the one that follows another
    key; these are put back in order.
    """
    clean = F.filter(F.transform(values, trim_unicode), lambda x: x.isNotNull() & (x != ""))
    # the texts are trimmed already, so that their keys need no more of it
    placed = F.array_sort(F.transform(clean, lambda x, i: F.struct(F.lower(F.regexp_replace(x, f"{BLANK}+", " ")).alias("key"), i.alias("at"), x.alias("text"))))
    none = F.array(F.lit(None).cast("struct<key:string,at:int,text:string>"))
    of_next = lambda before, x: F.when(x.isNotNull() & ~before["key"].eqNullSafe(x["key"]), F.struct(x["at"].alias("at"), x["text"].alias("text")))
    first = once(placed, lambda rows: F.zip_with(F.concat(none, rows), rows, of_next))
    return F.transform(F.array_sort(F.filter(first, lambda x: x.isNotNull())), lambda x: x["text"])


def consolidate_summaries(*summaries: Column) -> Column:
    """Every distinct line of several summaries once, in order; doing it again changes nothing."""
    lines = F.flatten(F.array(*[F.split(F.coalesce(s, F.lit("")), "\n") for s in summaries]))
    return F.array_join(unique_text(lines), "\n")


def episode_label(number: Column, title: Column) -> Column:
    """``第N集`` and the title, if there is one, after a dot."""
    clean = trim_unicode(F.coalesce(title, F.lit("")))
    base = F.concat(F.lit("第"), number.cast("string"), F.lit("集"))
    return F.when(clean == "", base).otherwise(F.concat(base, F.lit(" · "), clean))


def episode_summary(numbers: Column) -> Column:
    """All episode numbers in order, or a note that none is known."""
    named = F.transform(F.array_sort(numbers), lambda n: F.concat(F.lit("第"), n.cast("string"), F.lit("集")))
    return F.when(F.size(numbers) > 0, F.array_join(named, "、")).otherwise(F.lit("集数未识别"))


def resolve_endpoint(c: Column) -> Column:
    """The chat completions address of a base URL: appended once, no slash at the end; null if no URL."""
    base = F.regexp_replace(F.trim(c), "/+$", "")
    suffix = "/chat/completions"
    full = F.when(base.endswith(suffix), base).otherwise(F.concat(base, F.lit(suffix)))
    return F.when(base.rlike("^https?://[^/?# ]+"), full)


def xml_safe(c: Column) -> Column:
    """Without the characters that XML 1.0 doesn't allow."""
    return F.regexp_replace(c, r"[^\x09\x0A\x0D\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", "")


def operation_text(mode_instruction: Column, direction: Column) -> Column:
    """Mode instruction and direction, trimmed, blanks left out, one per line."""
    parts = F.transform(F.array(mode_instruction, direction), lambda x: trim_unicode(F.coalesce(x, F.lit(""))))
    return F.array_join(F.filter(parts, lambda x: x != ""), "\n")


def retry_delay(status: Column, attempt: Column, retry_after: Column, base: float = 1.0, cap: float = 60.0) -> Column:
    """Seconds to wait before a retry, null where none is due: bounded doubling, not below Retry-After."""
    due = (status == 429) | status.between(500, 599)
    wait = F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), attempt))
    return F.when(due, F.greatest(wait, F.coalesce(retry_after.cast("double"), F.lit(0.0))))


def evidence_span(unit: Column, quote: Column) -> Column:
    """struct(start, length) of a quote in its unit in UTF-16 code units; null if it isn't there."""
    at = F.call_function("locate", quote, unit)
    before = F.call_function("substring", unit, F.lit(1), at - 1)
    return F.when((at > 0) & (quote != ""), F.struct(utf16_length(before).alias("start"), utf16_length(quote).alias("length")))


def schema_completeness(*fields: Column) -> Column:
    """Share of fields that are filled."""
    filled = F.filter(F.array(*[F.coalesce(f.cast("string"), F.lit("")) for f in fields]), lambda x: trim_unicode(x) != "")
    return F.size(filled) / F.lit(float(len(fields)))
