"""Columns that clean, compare and classify text.  All are built from Spark's own functions.

Java's ``\\s`` knows ASCII blanks only; ``BLANK`` lists what Unicode calls white space.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# Characters that a file name may not hold, symbol blocks, and reserved names.
_INVALID = r'[<>:"/\\|?*\x00-\x1f]'
_SYMBOLS = r"[*\u2000-\u206f℀-⅏←-⏿─-╿■-⟯⦀-⫿]"
_RESERVED = ["CON", "PRN", "AUX", "NUL", *(f"COM{k}" for k in range(1, 10)), *(f"LPT{k}" for k in range(1, 10))]

# Patterns of promotional lines, whatever their case.
PROMOTIONS = [
    r"innread\.com", r"bednovel\.com", r"innnovel\.com", r"libread\.com", r"libread\.org",
    "Please keep reading on", "Keep reading on", "Follow current novels on", "Search .+ on google",
    "Please reading on", "Thank you for reading on", "Share this story", "Report Story", "Add to library",
]

# Marks that count as an apostrophe.
_APOSTROPHES = "’‘‚‛ʼʻ＇"

# Controls that carry no text.
_CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"


def text(c: Column | str) -> Column:
    """Null as ''."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


#: The same characters as a string.
BLANKS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip_of(c: Column, chars: str) -> Column:
    """Without the given characters at either end."""
    return F.btrim(c, F.lit(chars))


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return strip_of(c, BLANKS)


def collapse(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return strip_of(F.regexp_replace(c, f"[{BLANK}]+", " "), " ")


def words(c: Column) -> Column:
    return F.filter(F.split(c, f"[{BLANK}]+"), lambda w: w != "")


def word_count(c: Column | str) -> Column:
    return F.size(words(text(c)))


def lines(c: Column) -> Column:
    return F.split(F.regexp_replace(c, r"\r\n?", "\n"), "\n")


def sanitize_filename(c: Column | str) -> Column:
    """A name that every file system takes; 'untitled' where nothing is left."""
    s = F.regexp_replace(text(c), _INVALID, "")
    s = strip_of(F.regexp_replace(s, _SYMBOLS, "_"), BLANKS + ".")
    s = strip_of(F.regexp_replace(F.regexp_replace(s, f"[{BLANK}]+", "_"), "_+", "_"), "_")
    s = F.when(F.upper(s).isin(_RESERVED), F.concat(F.lit("_"), s)).otherwise(s)
    return F.when(s == "", "untitled").otherwise(s)


def simple_filename(c: Column | str, default: str = "story") -> Column:
    s = strip(F.regexp_replace(text(c), r'[<>:"/\\|?*]', ""))
    return F.when(s == "", default).otherwise(s)


def without_promotions(c: Column | str, extra: tuple[str, ...] = ()) -> Column:
    """Lines without blank and promotional ones, an empty line between them; ``extra`` are phrases taken as plain text."""
    pattern = "(?i)" + "|".join([*PROMOTIONS, *("\\Q" + p + "\\E" for p in extra)])
    kept = F.filter(F.transform(F.split(F.replace(text(c), F.lit("\r\n"), F.lit("\n")), "\n"), strip), lambda line: (line != "") & ~F.rlike(line, F.lit(pattern)))
    return F.array_join(kept, "\n\n")


def normalize_whitespace(c: Column | str) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(text(c), r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def clean_line(c: Column | str) -> Column:
    """One line without byte order marks; runs of white space as one blank."""
    return collapse(F.translate(text(c), "\ufeff", " "))


def straight(c: Column) -> Column:
    return F.translate(c, _APOSTROPHES, "'" * len(_APOSTROPHES))


def title_key(c: Column | str) -> Column:
    """Key for exact matches: straight apostrophes, no blanks at the ends, lower case."""
    return F.lower(strip(straight(text(c))))


def title_key_collapsed(c: Column | str) -> Column:
    """As ``title_key``, with runs of white space as one blank."""
    return F.lower(collapse(straight(text(c))))


def title_key_bare(c: Column | str) -> Column:
    return F.lower(strip(text(c)))


def title_key_words(c: Column | str) -> Column:
    """Letters a to z and digits only, '&' as 'and'; entities must be resolved before."""
    s = F.regexp_replace(F.lower(text(c)), "&", " and ")
    return strip_of(F.regexp_replace(F.regexp_replace(s, "['’`]", ""), "[^a-z0-9]+", " "), " ")


def query_variants(c: Column | str) -> Column:
    """Ways to write a search query, each once whatever its case, in a fixed order."""
    plain = F.translate(text(c), "‘’´`", "''''")
    made = F.array(
        plain,
        F.regexp_replace(plain, r"(?i)\b([A-Za-z0-9]+)'s\b", "$1"),
        F.regexp_replace(plain, "'", ""),
        F.regexp_replace(F.regexp_replace(plain, "&", " and "), "[^A-Za-z0-9&]+", " "),
    )
    made = F.filter(F.transform(made, collapse), lambda s: s != "")
    return F.filter(made, lambda s, i: F.array_position(F.transform(made, F.lower), F.lower(s)) == i + 1)


def plain_from_html(c: Column | str) -> Column:
    """Tags out, breaks and paragraph ends as line ends; entities must be resolved before."""
    s = F.regexp_replace(text(c), r"(?i)<\s*br\s*/?\s*>|</\s*p\s*>", "\n")
    return F.regexp_replace(s, "<[^>]+>", "")


def comparable(c: Column | str) -> Column:
    """Text of a segment for equality checks: lines without needless blanks, empty ones dropped."""
    s = F.regexp_replace(F.regexp_replace(F.translate(plain_from_html(c), "\ufeff", ""), r"\r\n?", "\n"), _CONTROLS, "")
    kept = F.filter(F.transform(F.split(s, "\n"), lambda x: strip(F.regexp_replace(x, r"[ \t]+", " "))), lambda x: x != "")
    return F.array_join(kept, "\n")


def _body(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.translate(strip(text(c)), "\ufeff", ""), r"\r\n?", "\n"), _CONTROLS, "")


def plain_from_markdown(c: Column | str) -> Column:
    """Blocks of a Markdown segment without emphasis, one line end between them."""
    s = F.regexp_replace(F.regexp_replace(_body(c), r"\*\*(.+?)\*\*", "$1"), r"\*(.+?)\*", "$1")
    block = lambda b: F.array_join(F.filter(F.transform(F.split(b, "\n"), strip), lambda x: x != ""), "\n")
    return F.array_join(F.filter(F.transform(F.split(s, rf"\n[{BLANK}]*\n+"), block), lambda b: b != ""), "\n")


def segment_html(c: Column | str) -> Column:
    """Paragraphs and line breaks as HTML; the first pair of stars becomes emphasis, even of two pairs."""
    s = F.regexp_replace(_body(c), r"\*(.+?)\*", "<em>$1</em>")
    kept = F.filter(F.transform(F.split(s, "\n\n"), strip), lambda b: b != "")
    return F.array_join(F.transform(kept, lambda b: F.concat(F.lit("<p>"), F.regexp_replace(b, "\n", "<br>"), F.lit("</p>"))), "")


def speech_text(c: Column | str) -> Column:
    """Text for reading aloud: no tags, no line ends, no escapes."""
    s = F.regexp_replace(text(c), "<[^>]+>", " ")
    s = F.translate(F.regexp_replace(s, "\n", " "), "\r", "")
    return strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"\\[nprts]", " "), r"\\+", " "), " {2,}", " "))


# Patterns of lines that are no prose.
_LABEL = r"^(?:next\s+chapter|previous|prev|chapter\s*list|table\s*of\s*contents|see\s+all\s*reviews?|leave\s+a\s*reply|there\s+are\s+no\s+comments|load\s+more|report\s+story|share\s+this\s*story|add\s+to\s+library|vote|sign\s+in|log\s+in|sign\s+up|next\s+page|previous\s+page)$"
_SHORT = [_LABEL, r"^\d{3,4}\s+chapters?$", r"^reviews?\s*\(\d+\)$", r"^chapter\s+\d+\s+[a-z]"]


def is_garbage(c: Column | str) -> Column:
    """Is a line empty, a bare number, a bare heading or a label of the page around?"""
    s = strip(text(c))
    low = F.lower(s)
    short = reduce(lambda a, b: a | b, [F.rlike(low, F.lit(p)) for p in _SHORT])
    return (s == "") | F.rlike(low, F.lit(r"^chapter\s+\d+\s*$|^\d{3,4}\s*$")) | ((F.length(s) < 30) & short)


# Marks of a page around a text.
_PAGE_MARKS = ["about the author", "follow +", "write a review", "add to reading list", "next chapter"]


def is_thin(c: Column | str, tiny: int = 12, suspicious: int = 800) -> Column:
    """Is a text too short, or short and with marks of the page around it?"""
    s = clean_line(c)
    n = F.size(words(s))
    marked = reduce(lambda a, b: a | b, [F.contains(F.lower(s), F.lit(m)) for m in _PAGE_MARKS])
    return F.when(s == "", True).when(n > suspicious, False).otherwise(marked | (n < tiny))


def without_echoes(paragraphs: Column, title: Column, series: Column) -> Column:
    """Paragraphs without the leading ones that only repeat the headings."""
    heads = F.filter(F.transform(F.concat(F.array(title, series), F.split(title, "[:：]")), lambda x: F.lower(clean_line(x))), lambda x: x != "")
    echo = lambda p: (clean_line(p) == "") | F.array_contains(heads, F.lower(clean_line(p))) | ((F.length(p) < 40) & F.rlike(F.lower(clean_line(p)), F.lit(r"^chapter\s+\d+")))
    first = F.array_position(F.transform(paragraphs, lambda p: ~echo(p)), F.lit(True))
    return F.when(first == 0, F.slice(paragraphs, 1, 0)).otherwise(F.slice(paragraphs, F.greatest(first, F.lit(1)).cast("int"), F.size(paragraphs)))


def distinct_in_order(items: Column) -> Column:
    return F.array_distinct(items)


def sentences(c: Column) -> Column:
    kept = F.filter(F.transform(F.split(F.regexp_replace(c, "\n", " "), r"\."), strip), lambda s: s != "")
    return F.transform(kept, lambda s: F.concat(s, F.lit(".")))


def chunks(c: Column | str, most: int = 1000) -> Column:
    """Sentences packed into chunks of about ``most`` characters, in order.

    A sentence longer than that is cut at words; its pieces follow what was pending.  Blanks
    between sentences are not counted.
    """
    done = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("open"), F.lit(0).alias("size"))

    def pieces(sentence: Column) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("open"), F.lit(0).alias("size"))

        def add(a: Column, w: Column) -> Column:
            n = F.length(w) + 1
            full = a["size"] + n > most
            return F.struct(
                F.when(full & (a["open"] != ""), F.array_append(a["out"], F.concat(a["open"], F.lit(".")))).otherwise(a["out"]).alias("out"),
                F.when(full | (a["open"] == ""), w).otherwise(F.concat(a["open"], F.lit(" "), w)).alias("open"),
                F.when(full, n).otherwise(a["size"] + n).alias("size"),
            )

        return F.aggregate(words(sentence), start, add, lambda a: F.when(a["open"] != "", F.array_append(a["out"], F.concat(a["open"], F.lit(".")))).otherwise(a["out"]))

    def step(a: Column, s: Column) -> Column:
        n = F.length(s)
        long, full = n > most, (a["size"] + n > most) & (a["open"] != "")
        flushed = F.when((long & (a["open"] != "")) | full, F.array_append(a["out"], a["open"])).otherwise(a["out"])
        return F.struct(
            F.when(long, F.concat(flushed, pieces(s))).otherwise(flushed).alias("out"),
            F.when(long, F.lit("")).when(full | (a["open"] == ""), s).otherwise(F.concat(a["open"], F.lit(" "), s)).alias("open"),
            F.when(long, F.lit(0)).when(full, n).otherwise(a["size"] + n).alias("size"),
        )

    return F.aggregate(sentences(text(c)), done, step, lambda a: F.when(a["open"] != "", F.array_append(a["out"], a["open"])).otherwise(a["out"]))


def split_to(c: Column | str, most: int) -> Column:
    """A text halved in the middle of its words again and again, until no part has more than ``most`` characters or two words.

    Halving a number of words k times gives parts of sizes that differ by one at most; they are cut at once.
    """
    s = text(c)
    w = words(s)
    n = F.size(w)

    def halved(parts: Column) -> Column:
        def each(p: Column) -> Column:
            size = p["end"] - p["start"]
            middle = p["start"] + F.floor(size / 2).cast("int")
            long = F.length(F.array_join(F.slice(w, p["start"] + 1, size), " ")) > most
            struct = lambda a, z: F.struct(a.alias("start"), z.alias("end"))
            return F.when(long & (size > 1), F.array(struct(p["start"], middle), struct(middle, p["end"]))).otherwise(F.array(struct(p["start"], p["end"])))

        return F.flatten(F.transform(parts, each))

    # Each round halves what is too long, so the number of words bounds the rounds.
    whole = F.array(F.struct(F.lit(0).alias("start"), n.alias("end")))
    rounds = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.log2(F.greatest(n, F.lit(1)))) + 1).cast("int"))
    parts = F.aggregate(rounds, whole, lambda a, _: halved(a))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(parts, lambda p: F.array_join(F.slice(w, p["start"] + 1, p["end"] - p["start"]), " ")))


def halves(c: Column | str) -> Column:
    """A text that is to be split once: by chunks of half its length, or else in the middle of its words."""
    s = text(c)
    w = words(s)
    middle = F.greatest(F.lit(1), F.floor(F.size(w) / 2)).cast("int")
    return F.when(F.size(w) <= 1, F.array(s)).otherwise(F.array(F.array_join(F.slice(w, F.lit(1), middle), " "), F.array_join(F.slice(w, middle + 1, F.size(w)), " ")))


# Starts and parts of paragraphs that follow a segment's body.
_TAIL_STARTS = [
    "what to expect in", "in the next chapter", "in the upcoming chapter", "expect unexpected", "readers can expect",
    "as the dust settles", "as the chapter closes", "as the chapter concludes", "as the chapter progresses",
    "as the chapter unfolds", "by the end of the chapter", "ultimately, the chapter", "this chapter",
]
_TAIL_PARTS = ["readers can expect", "leaving readers", " is a passionate storyteller ", "storyteller known for", "novels that keep readers hooked"]
_AFTER_PARTS = [" in the wake of the chaos", "in this chapter", "what lies ahead", "stage is set", "sets the stage", "as the dust settles"]
_AFTER_STARTS = [
    "in this moment", "in the whirlwind of emotions", "in the chaotic aftermath", "in the chaotic whirlwind",
    "in the aftermath", "in the suffocating silence", "in that charged silence", "in the wake of the chaos",
    "as the door swung open", "as the tension", "yet, ", "it all began with", "the whirlwind of emotions",
    "i hope they", "as we waited", "as the whirlwind of emotions", "in that moment, i realized",
    "in that instant, i realized", "as the evening unfolded", "as we settled into", "as the night wore on",
]


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def bare(p: Column) -> Column:
    """Without pairs of stars around the whole paragraph."""
    s = strip(p)
    return strip(F.when(F.rlike(s, F.lit(r"(?s)^\*\*.*\*\*$")) & (F.length(s) >= 4), F.regexp_replace(s, r"^(\*\*)+|(\*\*)+$", "")).otherwise(s))


def body_paragraphs(paragraphs: Column) -> Column:
    """The body of a segment: after its heading, before what follows it, without refusals.

    Where a mark of the end was found, up to four closing paragraphs that comment on the text go too.
    """
    low = lambda p: F.lower(bare(p))
    heading = lambda p: F.rlike(bare(p), F.lit(r"(?i)^(?:chapter|chap\.?)\s*\d+\b(?:\s*[:：.\-–—].*)?$"))
    titled = lambda p: F.rlike(bare(p), F.lit(r"(?i)^title\s*[:：]\s*\S"))
    refused = lambda p: F.contains(low(p), F.lit("sorry")) & F.rlike(F.translate(low(p), "’", "'"), F.lit("(can't|cannot) (assist|help)"))
    tail = lambda p: _any([F.startswith(low(p), F.lit(s)) for s in _TAIL_STARTS] + [F.contains(low(p), F.lit(s)) for s in _TAIL_PARTS]) | low(p).isin("comments", "write comments", "share") | F.rlike(low(p), F.lit(r"^\d+\s*/\s*\d+$|^[a-z][a-z .'-]{2,80}\s+is\s+a\b.*\bwriter\b"))
    after = lambda p: _any([F.contains(low(p), F.lit(s)) for s in _AFTER_PARTS] + [F.startswith(low(p), F.lit(s)) for s in _AFTER_STARTS]) | low(p).isin("-", "—", "--", "---") | (F.contains(low(p), F.lit("readers")) & F.rlike(low(p), F.lit("expect|left|leaving|wonder")))
    n = F.size(paragraphs)
    at = lambda test: F.array_position(F.transform(paragraphs, test), F.lit(True)).cast("int")
    start = F.when(at(heading) > 0, at(heading)).otherwise(at(titled))
    rest = F.slice(paragraphs, start + 1, n)
    ends = F.array_position(F.transform(rest, tail), F.lit(True)).cast("int")
    inner = F.when(ends > 0, F.slice(rest, F.lit(1), ends - 1)).otherwise(rest)
    inner = F.filter(inner, lambda p: ~refused(p))
    # Closing comments: as long as the last one is one, but two paragraphs stay and four go at most.
    closing = F.transform(F.reverse(inner), after)
    run = F.array_position(closing, F.lit(False)).cast("int")
    run = F.when(run == 0, F.size(inner)).otherwise(run - 1)
    drop = F.when(ends > 0, F.greatest(F.lit(0), F.least(run, F.lit(4), F.size(inner) - 2))).otherwise(0)
    return F.filter(F.transform(F.slice(inner, F.lit(1), F.size(inner) - drop), bare), lambda p: p != "")
