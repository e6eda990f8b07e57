"""Columns that read the names of source items and of segment files, and their metadata texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillframe.functions.text import BLANK, lines, strip, strip_of, text

# Prefixes of source items, and platform tokens with the platforms they stand for.
_PREFIX = r"^(DONE_|ING_|INCOMPLETE_|EXTENDED_)"
_SUFFIX = r"(?i)_(wp|gd|Goodnovel|nw|ink|jn|jobnib|sh|scribblehub|nl|novellunar|wn|webnovel|nh|novelhall|rn|readnovelmtl)(?![a-zA-Z0-9_])|_-_?novel(?=\s|_|\s-\s|$)"
PLATFORMS = {
    "wp": "Wattpad", "wattpad": "Wattpad", "gd": "Goodnovel", "goodnovel": "Goodnovel", "nw": "NovelWorm",
    "novelworm": "NovelWorm", "ink": "Inkitt", "inkitt": "Inkitt", "jn": "Jobnib", "jobnib": "Jobnib",
    "sh": "ScribbleHub", "scribblehub": "ScribbleHub", "nl": "NovelLunar", "novellunar": "NovelLunar",
    "wn": "WebNovel", "webnovel": "WebNovel", "nh": "NovelHall", "novelhall": "NovelHall",
    "rn": "ReadNovelMtl", "readnovelmtl": "ReadNovelMtl",
}
#: Platforms that a name may hold at upload.
UPLOAD = ("gd", "nw", "wp", "wattpad", "ink", "inkitt", "jn", "jobnib", "wn", "webnovel", "nh", "novelhall", "rn", "readnovelmtl", "goodnovel", "novelworm")
# Categories by id, and how names of categories are written.
CATEGORIES = {
    "154971fe-7da7-41c4-91ee-b2a9613d6fa0": "Fantasy",
    "2d2614d9-2b25-4d1f-bb0a-fb333193de19": "Werewolf",
    "17c9779b-7107-4b24-a020-df735e1dd6cb": "Romance",
    "1550cd02-d20b-4fc3-9dce-6c8c5ccaba11": "Billionaire",
    "8dabb3e8-3e6c-4b20-9b48-cb7bd028cecf": "LGBTQ+",
}


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def _after_prefix(name: Column) -> Column:
    return F.regexp_replace(name, _PREFIX, "")


def item_prefix(name: Column | str) -> Column:
    s = F.regexp_extract(text(name), _PREFIX, 1)
    return F.when(s == "", "UNKNOWN").otherwise(F.regexp_replace(s, "_$", ""))


def item_completed(name: Column | str) -> Column:
    return item_prefix(name).isin("DONE", "EXTENDED")


def item_title(name: Column | str) -> Column:
    """What follows the first ' - '; without one, the name up to its platform token."""
    rest = _after_prefix(text(name))
    plain = strip(rest)
    before = F.regexp_extract(plain, f"(?s)^(.*?)(?:{_SUFFIX})", 1)
    title = F.when(F.contains(rest, F.lit(" - ")), strip(F.regexp_extract(rest, "(?s)^.*? - (.*)$", 1))).otherwise(F.when(F.rlike(plain, F.lit(_SUFFIX)), strip(before)).otherwise(plain))
    return F.trim(F.regexp_replace(F.translate(title, "_", " "), " {2,}", " "))


def item_platform(name: Column | str) -> Column:
    """The platform in the part before ' - '; null where there is none."""
    before = F.substring_index(_after_prefix(text(name)), " - ", 1)
    return F.get(F.filter(F.array(_map(PLATFORMS)[F.lower(F.regexp_extract(before, _SUFFIX, 1))]), lambda x: x.isNotNull()), F.lit(0))


def upload_format(name: Column | str) -> Column:
    """``(valid, token, platform)`` of a name PREFIX_..._platform - title."""
    s = text(name)
    dash, bar = F.instr(s, " - "), F.instr(s, "_")
    fits = (dash > 0) & (bar > 0) & (dash > bar)
    token = F.when(fits, F.nullif(strip(F.try_element_at(F.split(F.substring_index(s, " - ", 1), "_"), F.lit(-1))), F.lit("")))
    valid = F.coalesce(F.lower(token).isin(list(UPLOAD)), F.lit(False))
    return F.struct(valid.alias("valid"), token.alias("token"), F.when(valid, _map(PLATFORMS)[F.lower(token)]).alias("platform"))


def stem(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, "^.*/", ""), r"(?<=.)\.[^.]*$", "")


def segment_ordinal(name: Column | str) -> Column:
    return F.regexp_extract(stem(text(name)), r"(?i)^Chapter\s+(\d+)", 1).try_cast("int")


def is_segment_name(name: Column | str) -> Column:
    return F.rlike(stem(text(name)), F.lit(r"(?i)^Chapter\s+\d+\s*-\s*.+"))


def segment_title(name: Column | str) -> Column:
    s = stem(text(name))
    title = strip(F.translate(strip(F.regexp_replace(s, r"(?i)^Chapter\s+\d+(?:-\d+)?\s*[-_]?\s*", "")), "_", " "))
    return F.when(title == "", strip(F.translate(s, "_", " "))).otherwise(title)


def natural_key(name: Column | str) -> Column:
    """Sort key: the first number of a file's stem, then the stem."""
    s = stem(text(name))
    return F.struct(F.coalesce(F.regexp_extract(s, r"(\d+)", 1).try_cast("long"), F.lit(0)).alias("number"), s.alias("stem"))


def _filled(c: Column | str) -> Column:
    return F.filter(F.transform(lines(text(c)), lambda x: strip(F.translate(x, "\ufeff", ""))), lambda x: x != "")


def category_names(c: Column | str) -> Column:
    """``(main, sub)`` of a category text: named lines, else the first and second plain ones; lower case."""
    kept = F.filter(F.transform(_filled(c), F.lower), lambda x: ~F.startswith(x, F.lit("#")))
    named = lambda label: F.try_element_at(F.filter(kept, lambda x: F.contains(x, F.lit(label))), F.lit(-1))
    after = lambda label: strip(F.regexp_extract(named(label), rf"(?s){label}(.*)$", 1))
    plain = F.filter(kept, lambda x: ~F.contains(x, F.lit("main category:")) & ~F.contains(x, F.lit("sub category:")))
    main_named, sub_named = after("main category:"), after("sub category:")
    main = F.coalesce(main_named, F.get(plain, F.lit(0)))
    sub = F.coalesce(sub_named, F.when(main_named.isNull(), F.get(plain, F.lit(1))).otherwise(F.get(plain, F.lit(0))))
    return F.struct(main.alias("main"), sub.alias("sub"))


def category_id(name: Column | str) -> Column:
    """A category's id by its name, whatever its case and signs."""
    key = F.regexp_replace(F.lower(strip(text(name))), r"[ \-_+]", "")
    ids = {v.lower(): k for k, v in CATEGORIES.items()}
    known = {"fantasy": "fantasy", "werewolf": "werewolf", "romance": "romance", "billionaire": "billionaire", "billionair": "billionaire", "billionaireromance": "billionaire", "billionairromance": "billionaire", "billionairelgbtq": "billionaire", "billionairelgbt": "billionaire", "billionairlgbtq": "billionaire", "billionairlgbt": "billionaire", "lgbtq": "lgbtq+", "lgbt": "lgbtq+"}
    return _map({k: ids[v] for k, v in known.items()})[key]


def category_name(identifier: Column | str) -> Column:
    """A category's name by its id; an unknown id stands for itself."""
    c = F.col(identifier) if isinstance(identifier, str) else identifier
    return F.coalesce(_map(CATEGORIES)[c], F.nullif(c, F.lit("")))


def free_count(c: Column | str) -> Column:
    return strip(F.get(F.split(strip(text(c)), "\n"), F.lit(0))).try_cast("int")


def push_message(c: Column | str) -> Column:
    """``(title, content)`` of a push text; of several lines of a kind the last counts."""
    found = lambda label: F.try_element_at(F.filter(_filled(c), lambda x: F.startswith(F.lower(x), F.lit(label))), F.lit(-1))
    rest = lambda label: strip(F.regexp_replace(found(label), rf"(?i)^{label}", ""))
    return F.struct(rest("title:").alias("title"), rest("content:").alias("content"))


def synopsis(c: Column | str) -> Column:
    """Lines joined by blanks: all up to a heading that follows the synopsis heading, without the latter."""
    kept = F.filter(F.transform(lines(text(c)), strip), lambda x: x != "")
    head = lambda x: F.startswith(F.lower(x), F.lit("# synopsis"))
    first = F.array_position(F.transform(kept, head), F.lit(True)).cast("int")
    rest = F.slice(kept, first + 1, F.size(kept))
    stop = F.array_position(F.transform(rest, lambda x: F.startswith(x, F.lit("#")) & ~head(x)), F.lit(True)).cast("int")
    inner = F.filter(F.when(stop > 0, F.slice(rest, F.lit(1), stop - 1)).otherwise(rest), lambda x: ~head(x))
    return F.nullif(F.array_join(F.when(first > 0, F.concat(F.slice(kept, F.lit(1), first - 1), inner)).otherwise(kept), " "), F.lit(""))


def tag_list(c: Column | str) -> Column:
    """Tags of all lines but headings, between commas, or else between blanks; without quotes."""
    parts = lambda x: F.when(F.contains(x, F.lit(",")), F.split(x, ",")).otherwise(F.split(x, f"[{BLANK}]+"))
    kept = F.filter(_filled(c), lambda x: ~F.startswith(x, F.lit("#")))
    return F.filter(F.transform(F.flatten(F.transform(kept, parts)), lambda t: strip_of(strip_of(strip(t), '"'), "'")), lambda t: t != "")


def max_segment(c: Column | str) -> Column:
    """The first number of a text."""
    return F.regexp_extract(text(c), r"(\d+)", 1).try_cast("int")


def length_kind(c: Column | str) -> Column:
    s = F.lower(strip(F.get(F.split(strip(F.translate(text(c), "\ufeff", "")), "\n"), F.lit(0))))
    return F.when(s.isin("long", "short"), s)


def same_set(a: Column, b: Column) -> Column:
    """Are two lists equal as sets, without regard to case, blanks at the ends and empty items?"""
    key = lambda x: F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(x, F.array().cast("array<string>")), lambda t: F.lower(strip(t))), lambda t: t != "")))
    return key(a) == key(b)


def differences(pairs: list[tuple[str, Column, Column]], always: tuple[str, ...] = ()) -> Column:
    """``array<(field, left, right)>`` of the fields that differ, in order.

    A field whose left side is null counts only if it is in ``always``.
    """
    made = []
    for name, left, right in pairs:
        differs = ~left.eqNullSafe(right) if name in always else left.isNotNull() & ~left.eqNullSafe(right)
        made.append(F.when(differs, F.struct(F.lit(name).alias("field"), left.cast("string").alias("left"), right.cast("string").alias("right"))))
    return F.array_compact(F.array(*made))
