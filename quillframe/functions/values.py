"""Columns that coerce, clamp, parse and format single values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillframe.functions.text import clean_line, collapse, strip, strip_of, text


def first_filled(*columns: Column | str) -> Column:
    """The first column that is neither null nor ''."""
    return F.coalesce(*(F.nullif(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("")) for c in columns))


def first_count(*columns: Column) -> Column:
    """The first column that holds a whole number, not below 0; 0 where none does."""
    return F.greatest(F.lit(0), F.coalesce(*(c.try_cast("int") for c in columns), F.lit(0)))


def as_int(c: Column | str) -> Column:
    """A whole number from text or a float, cut towards zero; 0 where there is none."""
    c = F.col(c) if isinstance(c, str) else c
    s = F.trim(c.cast("string"))
    return F.coalesce(s.try_cast("int"), s.try_cast("double").try_cast("int"), F.lit(0))


def clamp(c: Column, low: int | float, high: int | float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, cut off; 0 of nothing."""
    return F.when(whole > 0, F.floor(part * 100 / whole).cast("int")).otherwise(0)


def compact_number(c: Column | str) -> Column:
    """Numbers such as 12.5K, 3M or 1,204, cut to whole ones; null where it is no number."""
    s = F.upper(F.translate(text(c), ", ", ""))
    number = F.regexp_extract(s, r"^([0-9]*\.?[0-9]+)([KMB]?)$", 1).try_cast("double")
    unit = F.regexp_extract(s, r"^([0-9]*\.?[0-9]+)([KMB]?)$", 2)
    return (number * F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9).otherwise(1.0)).cast("long")


def retry_after(c: Column | str) -> Column:
    """Seconds to wait, not below 0; null where it is no number."""
    seconds = F.nullif(text(c), F.lit("")).try_cast("double")
    return F.when(seconds.isNotNull(), F.greatest(F.lit(0.0), seconds))


def local_time(c: Column | str) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` without a zone; null for any other form."""
    s = text(c)
    strict = F.rlike(s, F.lit(r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"))
    return F.when(strict, F.try_to_timestamp(s, F.lit("y-M-d H:m:s")).cast("timestamp_ntz"))


def iso_time(c: Column | str) -> Column:
    """An ISO-8601 time; one without a zone is UTC."""
    return F.nullif(text(c), F.lit("")).try_cast("timestamp")


def duration_label(seconds: Column) -> Column:
    """Days and hours, hours and minutes, minutes, or seconds; '-' for null."""
    total = F.greatest(F.lit(0), F.floor(seconds + 0.5)).cast("long")
    days, hours, minutes = F.floor(total / 86400), F.floor((total % 86400) / 3600), F.floor((total % 3600) / 60)
    return (
        F.when(seconds.isNull(), "-")
        .when(days > 0, F.concat(days, F.lit("d "), hours, F.lit("h")))
        .when(hours > 0, F.concat(hours, F.lit("h "), minutes, F.lit("m")))
        .when(minutes > 0, F.concat(minutes, F.lit("m")))
        .otherwise(F.concat(total, F.lit("s")))
    )


def rate_label(rate: Column, unit: str = "ch/h") -> Column:
    return F.when(rate > 0, F.concat(F.format_number(F.floor(rate + 0.5), 0), F.lit(f" {unit}"))).otherwise("-")


def split_tags(c: Column | str) -> Column:
    return F.filter(F.transform(F.split(text(c), "[,;|]"), strip), lambda t: t != "")


def title_list(c: Column | str, delimiter: str = ";") -> Column:
    """Titles between delimiters ('newline' for lines), without quotes around them."""
    pattern = r"\r\n|\r|\n" if delimiter == "newline" else "\\Q" + (delimiter or ";") + "\\E"
    parts = F.split(F.translate(text(c), "\ufeff", " "), pattern)
    return F.filter(F.transform(parts, lambda t: strip_of(collapse(t), " \t\r\n\"'")), lambda t: t != "")


def story_urls(c: Column | str, host: str = "jobnib.com") -> Column:
    """Distinct addresses of series pages of a host in a text, in canonical form."""
    quoted = host.replace(".", r"\.")
    found = F.regexp_extract_all(text(c), F.lit(rf"(?i)(https?://(?:www\.)?{quoted}/book/[^\s,;\"']+)"), 1)
    slug = lambda u: F.regexp_extract(u, r"(?i)/book/([^/?#]+)/?(?:[?#].*)?$", 1)
    good = F.filter(found, lambda u: (slug(u) != "") & ~F.rlike(slug(u), F.lit(r"(?i)-chapter-\d+(?:-\d+)?$")))
    return F.array_distinct(F.transform(good, lambda u: F.concat(F.lit(f"https://{host}/book/"), slug(u))))


def canonical_url(c: Column | str) -> Column:
    """Without query, fragment and slashes at the end."""
    return F.regexp_replace(F.regexp_replace(text(c), r"[?#].*$", ""), "/+$", "")


# Path parts that stand before a series' slug.
_SLUG_AFTER = ["stories", "novel", "story", "book", "series", "works", "[^/]+"]


def slug(c: Column | str) -> Column:
    """The series' slug in an address, without a segment's number; the last path part where no pattern fits."""
    url = F.regexp_replace(text(c), "/+$", "")
    tries = [F.nullif(F.regexp_extract(url, rf"(?i)/{part}/([^/?#]+)", 1), F.lit("")) for part in _SLUG_AFTER]
    tries = [F.regexp_replace(t, r"(?i)-chapter-\d+(?:-\d+)?$", "") for t in tries]
    return F.when(text(c) != "", F.coalesce(*tries, F.try_element_at(F.split(url, "/"), F.lit(-1))))


def host_suffixes(c: Column | str) -> Column:
    """A host and its parent domains, longest first."""
    host = F.lower(F.coalesce(F.regexp_extract(text(c), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))


def series_status(c: Column | str) -> Column:
    s = F.lower(clean_line(c))
    return F.when(s.isin("completed", "complete", "finished"), "completed").when(s.isin("ongoing", "updating", "serializing", "in progress", "in-progress"), "ongoing").otherwise("unknown")


def asset_status(c: Column | str) -> Column:
    """Older names of an asset's states are folded into the current ones."""
    s = F.lower(text(c))
    return F.when(s.isin("success", "completed", "done"), "updated").when(s.isin("failed", "error"), "failed").otherwise(s)


def _has(c: Column, *markers: str) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(m)) for m in markers])


# What error messages hold, by source, in the order of the rules: (status, markers).
ERROR_RULES = {
    "inkitt": [
        ("queued", ("http 429",)),
        ("skipped", ("http 410",)),
        ("skipped", ("subscription", "patron", "patrons only", "paid chapter", "paid story", "requires payment")),
        ("failed", ("requires login", "login required", "asked for login", "log in to inkitt", "log in to continue", "login to continue", "please log in", "please login", "sign up to continue", "user_credentials")),
    ],
    "novelhall": [("failed", ("no readable chapter content",)), ("queued", ("cloudflare", "flaresolverr", "just a moment", "challenge"))],
    "jobnib": [
        ("needs_session", ("cloudflare", "turnstile", "bot-detected", "preview-only", "did not unlock", "session challenge", "browser did not unlock", "start reading", "read part 1 to unlock")),
        ("queued", ("http 429", "http 503")),
        ("skipped", ("http 404", "page not found", "page has been deleted")),
    ],
}


def error_status(message: Column | str, source: str = "inkitt") -> Column:
    """The state that an error leads to; the first rule that fits counts, 'failed' where none does."""
    low = F.lower(text(message))
    out = F
    for status, markers in ERROR_RULES[source]:
        out = out.when(_has(low, *markers), status)
    return out.otherwise("failed")


# Marks of an error that a new attempt may mend.
RECOVERABLE = ("timeout", "timed out", "connection", "temporar", "rate limit", "429", "502", "503")


def is_recoverable(message: Column | str) -> Column:
    return _has(F.lower(text(message)), *RECOVERABLE)


# Prefixes of lines that say nothing.
NOISE = [
    "[scrapy.core.engine]", "[scrapy.downloadermiddlewares", "[scrapy.extensions", "[scrapy.spidermiddlewares",
    "[scrapy.util", "[scrapy.middleware", "[scrapy.crawler", "[scrapy.core.scraper", "[scrapy.addons]", "[py.warnings]",
    "DEBUG:", "INFO: Scrapy", "INFO: Versions:", "INFO: Enabled", "INFO: Overridden", "INFO: Telnet",
]
_SEGMENT_LINE = r"\[([^\]]+)/(\d+)\]\s+Crawled chapter (\d+):\s+(.*)"
_TOTAL_LINE = r"(?i)found (\d+) chapter links.*target=[^(]+\((\d+)\)"


def log_event(c: Column | str) -> Column:
    """Kind of a log line with its title and total: error, warning, noise, segment, total, info, or null if blank."""
    s = strip(text(c))
    noise = reduce(lambda a, b: a | b, [F.startswith(s, F.lit(p)) for p in NOISE])
    kind = (
        F.when(s == "", F.lit(None))
        .when(F.rlike(s, F.lit(r"(?i)\b(error|exception|failed|traceback|critical)\b")), "error")
        .when(F.rlike(s, F.lit(r"(?i)\b(warning|retry|retrying)\b")), "warning")
        .when(noise, "noise")
        .when(F.rlike(s, F.lit(_SEGMENT_LINE)), "segment")
        .when(F.rlike(s, F.lit(_TOTAL_LINE)), "total")
        .otherwise("info")
    )
    return F.struct(
        kind.alias("kind"),
        F.when(kind == "segment", strip(F.regexp_extract(s, _SEGMENT_LINE, 4))).alias("title"),
        F.when(kind == "segment", F.regexp_extract(s, _SEGMENT_LINE, 2).try_cast("int")).when(kind == "total", F.regexp_extract(s, _TOTAL_LINE, 2).try_cast("int")).alias("total"),
    )


# Words that set the tone of a log line, first match first.
TONES = [
    ("error", r"\b(429|403|failed|failure|error|exception|blocked)\b"),
    ("warning", r"\b(pause|paused|restart|retry|page cap|rate)\b"),
    ("fallback", r"\b(rendered fallback|fallback)\b"),
    ("discovery", r"\b(discovery|discover|scanning page|api rows|candidate)\b"),
    ("progress", r"\b(crawled \d+\/\d+|started crawl run|chapter\(s\))\b"),
    ("success", r"\b(completed|finished|exported|download|skipped \d+ story)\b"),
    ("system", r"\b(system catalog|catalog updated|started inkitt)\b"),
]


def log_tone(c: Column | str) -> Column:
    low, out = F.lower(text(c)), F
    for tone, pattern in TONES:
        out = out.when(F.rlike(low, F.lit(pattern)), tone)
    return out.otherwise("neutral")


def log_parts(c: Column | str) -> Column:
    """Time and message of a log line; no time where it has none."""
    s = text(c)
    pattern = r"^(\d{2}:\d{2}:\d{2})\s+(.*)$"
    return F.struct(F.regexp_extract(s, pattern, 1).alias("time"), F.when(F.rlike(s, F.lit(pattern)), F.regexp_extract(s, pattern, 2)).otherwise(s).alias("message"))


def cookies(c: Column | str) -> Column:
    """Name and value pairs of a cookie header; of equal names the last value, in order of first appearance."""
    parts = F.split(F.regexp_replace(strip(text(c)), r"(?i)^cookie\s*:\s*", ""), ";")
    pairs = F.filter(
        F.transform(F.filter(parts, lambda p: F.contains(p, F.lit("="))), lambda p: F.struct(strip(F.regexp_extract(p, "^([^=]*)=", 1)).alias("name"), strip(F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1)).alias("value"))),
        lambda x: x["name"] != "",
    )
    names = F.array_distinct(F.transform(pairs, lambda x: x["name"]))
    return F.transform(names, lambda n: F.try_element_at(F.filter(pairs, lambda x: x["name"] == n), F.lit(-1)))


def asset_variants(c: Column | str) -> Column:
    """File names to look for: the given one, or with .jpg and .png where it has no ending."""
    s = strip(text(c))
    return F.when(s == "", F.array().cast("array<string>")).when(F.rlike(s, F.lit(r"\.[A-Za-z0-9]+$")), F.array(F.lower(s))).otherwise(F.array(F.concat(s, F.lit(".jpg")), F.concat(s, F.lit(".png"))))


def output_name(site: Column, name: Column, completed: Column) -> Column:
    """Site, name and state joined by underscores; what is missing leaves no gap."""
    state = F.when(completed, "Completed").when(~completed, "Ongoing")
    return F.concat_ws("_", F.nullif(site, F.lit("")), name, state)


def label_value(page: Column, label: str) -> Column:
    """The line after a label line."""
    return clean_line(F.regexp_extract(page, rf"(?im)^\Q{label}\E[ \t]*\n\s*([^\n]+)", 1))


def page_numbers(c: Column | str) -> Column:
    """Rating, reviews and reads in a page's visible text; null where there is none."""
    s = clean_line(c)
    whole = lambda pattern: F.translate(F.regexp_extract(s, pattern, 1), ",", "").try_cast("int")
    reads = F.regexp_extract(s, r"(?i)([\d,.]+)\s*([KMB])?\s*(?:reads|readers|views)\b", 1)
    unit = F.regexp_extract(s, r"(?i)([\d,.]+)\s*([KMB])?\s*(?:reads|readers|views)\b", 2)
    return F.struct(
        F.regexp_extract(s, r"(?i)(\d+(?:\.\d+)?)\s+[\d,]+\s+reviews?", 1).try_cast("double").alias("rating"),
        whole(r"(?i)([\d,]+)\s+reviews?").alias("reviews"),
        compact_number(F.concat(reads, unit)).alias("reads"),
    )


def tail(items: Column, n: int | None) -> Column:
    """The last ``n`` items; none for 0, all for None."""
    if n is None:
        return items
    return F.slice(items, F.greatest(F.lit(1), F.size(items) - n + 1), F.lit(n)) if n > 0 else F.slice(items, 1, 0)


def without_key(json: Column, key: str) -> Column:
    """A JSON object without one of its keys."""
    return F.to_json(F.map_filter(F.from_json(json, "map<string,string>"), lambda k, v: k != key))


def is_live(expires: Column, now: Column) -> Column:
    """Not expired; null never expires."""
    return expires.isNull() | (expires > now)


def is_valid_token(expires: Column, revoked: Column, now: Column) -> Column:
    """Neither revoked nor expired; a token without an expiry is not valid."""
    return revoked.isNull() & F.coalesce(expires > now, F.lit(False))


def overlaid(raw: Column, typed: dict[str, Column]) -> Column:
    """A map of raw values with typed ones put over it; unknown keys stay."""
    kept = F.map_filter(raw, lambda k, v: ~k.isin(list(typed)))
    pairs = [x for name, c in typed.items() for x in (F.lit(name), c.cast("string"))]
    return F.map_concat(kept, F.create_map(*pairs))


def settings(defaults: Column, owned: Column, worker: Column, names: list[str]) -> Column:
    """Defaults, then the owned values of known names, then the worker's values; the later count."""
    known = F.map_filter(owned, lambda k, v: k.isin(names))
    later = F.map_concat(F.map_filter(known, lambda k, v: ~F.map_contains_key(worker, k)), worker)
    return F.map_concat(F.map_filter(defaults, lambda k, v: ~F.map_contains_key(later, k)), later)


def page_of(ordinal: Column, total: Column, size: int, newest_first: bool = False) -> Column:
    """The listing page (from 1) on which an ordinal stands."""
    place = (total - ordinal + 1) if newest_first else ordinal
    return (F.floor((place - 1) / size) + 1).cast("int")


def weighted(parts: Column, weights: Column) -> Column:
    """Progress of weighted parts (maps from name to share done, and to weight); 0 without weights."""
    names = F.map_keys(weights)
    total = F.aggregate(F.map_values(weights).cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    done = F.aggregate(names, F.lit(0.0), lambda a, n: a + F.element_at(weights, n).cast("double") * F.coalesce(F.try_element_at(parts, n).cast("double"), F.lit(0.0)))
    return F.when(total > 0, done / total).otherwise(0.0)
