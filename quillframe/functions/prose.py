"""What of a page's paragraphs is prose: labels are passed over, the foot of the page ends it, lists of contents have none."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Common words of prose.
PROSE = (
    "you", "the", "and", "was", "were", "are", "his", "her", "had", "with", "that", "this", "from", "she", "he", "they", "them",
    "but", "not", "for", "when", "would", "could", "what", "who", "which", "been", "their", "there", "here", "all", "have", "has",
    "out", "into", "your", "its", "one", "two", "over", "just", "more", "very", "only", "some", "any", "than", "then", "after",
    "back", "down", "even", "like", "know", "said", "well", "came", "looked", "felt", "seemed", "went", "asked", "told", "wanted",
    "thought", "didn't", "don't", "it's", "i'm", "you're", "we're", "they're", "can't", "won't", "isn't", "wasn't", "aren't",
    "doesn't", "how", "why", "where", "nothing", "something", "anything", "everything", "because", "about", "around", "still",
)

# Labels of buttons and lists.
LABELS = (
    "see all reviews", "next chapter", "previous", "prev chapter", "chapter list", "table of contents", "report story",
    "share this story", "add to library", "vote", "leave a reply", "post comment", "load more", "there are no comments yet",
)

#: Characters: a shorter paragraph is none, a shorter line of capitals a heading, a shorter label only a label.
LEAST, HEADING, LABEL = 10, 50, 200
#: A text with a smaller share of common words is no prose; a page with fewer paragraphs of it, or more links to chapters, is a list.
SHARE, PARAGRAPHS, LINKS = 0.03, 3, 5


def _once(c: Column, make: Callable[[Column], Column]) -> Column:
    """``make`` of a column that is worked out once, however often ``make`` uses it."""
    return F.element_at(F.transform(F.array(c), make), 1)


def _words(low: Column) -> Column:
    return F.filter(F.split(low, r"(?U)\s+"), lambda w: w != "")


def prose_share(c: Column) -> Column:
    """Share of common words among a paragraph's distinct words, in lower case; null without words."""
    share = lambda found: F.when(F.size(found) > 0, F.size(F.filter(found, lambda w: w.isin(*PROSE))) / F.size(found))
    return _once(F.array_distinct(_words(F.lower(c))), share)


def verdict(c: Column) -> Column:
    """``keep``, ``skip``, or ``end`` where the page's foot begins, for a paragraph without white space around it."""

    def of(low: Column) -> Column:
        label = reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in LABELS])
        foot = F.contains(low, F.lit("next")) & F.contains(low, F.lit("previous"))
        bare = F.coalesce(prose_share(c) < SHARE, F.lit(False))
        # The pattern is only tried where its word is.
        chapter = F.contains(low, F.lit("chapter")) & F.rlike(c, F.lit(r"(?iU)(?:^|\s)\d*chapter\s+\d+"))
        return (
            F.when(F.coalesce(F.length(c), F.lit(0)) < LEAST, "skip")
            .when((F.length(c) < HEADING) & (low != c) & (F.upper(c) == c), "skip")
            .when(chapter, "skip")
            .when(label, F.when(F.length(c) < LABEL, "skip").otherwise("end"))
            .when(foot, "end")
            .when(bare, F.when(F.length(c) < LABEL, "skip").otherwise("end"))
            .otherwise("keep")
        )

    return _once(F.lower(c), of)


def prose_body(paragraphs: Column, links: Column | None = None) -> Column:
    """The prose among a page's ``paragraphs`` in order, each once, up to where its foot begins.

    Empty where that leaves fewer than three, or where over five of the page's ``links`` lead to chapters: then it is a list of
    contents.  A null array is empty.
    """
    none = F.array().cast("array<string>")

    def body(marked: Column) -> Column:
        end = F.array_position(F.transform(marked, lambda x: x["verdict"]), "end")
        before = F.when(end > 0, F.slice(marked, F.lit(1), (end - 1).cast("int"))).otherwise(marked)
        return F.array_distinct(F.transform(F.filter(before, lambda x: x["verdict"] == "keep"), lambda x: x["text"]))

    marked = F.transform(paragraphs, lambda x: F.struct(x.alias("text"), verdict(x).alias("verdict")))
    found = _once(_once(marked, body), lambda kept: F.when((F.size(kept) < PARAGRAPHS) | kept.isNull(), none).otherwise(kept))
    if links is None:
        return found
    listing = F.size(F.filter(F.coalesce(links, none), lambda x: F.contains(x, F.lit("/0000")))) > LINKS
    return F.when(listing, none).otherwise(found)
