"""Text functions that Spark lacks, as vectorised functions over Arrow batches: entities, NFKC, likeness of titles, HTML."""

from __future__ import annotations

import difflib
import html
import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.functions.text import collapse, title_key_words


@F.pandas_udf(T.StringType())
def unescape(s: pd.Series) -> pd.Series:
    """Entities resolved; null stays null."""
    return s.map(html.unescape, na_action="ignore")


@F.pandas_udf(T.StringType())
def visible(s: pd.Series) -> pd.Series:
    """Compatibility forms folded, white space as single blanks, invisible characters dropped; null as ''."""
    fold = lambda x: " ".join(unicodedata.normalize("NFKC", x).split())
    return s.fillna("").map(lambda x: "".join(c for c in fold(x) if unicodedata.category(c) not in ("Cf", "Cc")).strip())


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def title_key_unescaped(c: Column) -> Column:
    """Key with entities resolved, blanks collapsed, lower case; null as ''."""
    return F.lower(collapse(F.coalesce(unescape(c), F.lit(""))))


def title_likeness(a: Column, b: Column) -> Column:
    """Likeness of two titles by matching blocks, on their words: 1 if equal, 0 if one is empty.

    Only pairs that are neither pass through Python.
    """
    x, y = title_key_words(unescape(F.coalesce(a, F.lit("")))), title_key_words(unescape(F.coalesce(b, F.lit(""))))
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).otherwise(ratio(x, y))


def _letters(keys: list[str]) -> np.ndarray:
    """How often each letter, by its code modulo 64, is in each key."""
    return np.array([np.bincount(np.frombuffer(k.encode("utf-32-le"), "<u4") % 64, minlength=64) for k in keys], np.int32).reshape(-1, 64)


def _best_of_blocks(keep: int):
    """The ``keep`` best of a block's names for each query of another one.

    Letters in common bound the likeness from above, so names are tried in the order of that bound until it
    falls below the last score that is kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                names, keys, out = [x["name"] for x in row["names"]], [x["key"] for x in row["names"]], []
                letters, sizes = _letters(keys), np.array([len(k) for k in keys])
                for asked in row["asked"]:
                    query, key = asked["query"], asked["key"]
                    bound = 2.0 * np.minimum(letters, _letters([key])).sum(axis=1) / np.maximum(sizes + len(key), 1)
                    best: list[tuple[float, str]] = []
                    for k in np.argsort(-bound, kind="stable").tolist():
                        if len(best) == keep and bound[k] < -best[-1][0]:
                            break
                        same = 1.0 if key == keys[k] else difflib.SequenceMatcher(None, key, keys[k]).ratio()
                        best = sorted([*best, (-same if key and keys[k] else 0.0, names[k])])[:keep]
                    out += [(name, query, -score) for score, name in best]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 3, (pa.string(), pa.string(), pa.float64()), strict=True)], ["name", "query", "score"])

    return run


def most_alike_in_blocks(asked: DataFrame, names: DataFrame, keep: int = 3, block: int = 4096, asked_block: int = 256) -> DataFrame:
    """``name, query, score, r``: the ``keep`` names most like each ``query``, of equal scores the first in order.

    ``asked`` has distinct ``query``, ``names`` distinct ``name``.  Every block of queries meets every block of names.
    """

    def blocks(df: DataFrame, column: str, size: int, out: str) -> DataFrame:
        key = title_key_words(unescape(F.coalesce(F.col(column), F.lit(""))))
        at = F.pmod(F.xxhash64(column), F.lit(-(-max(df.count(), 1) // size)))
        return df.select(at.alias("at"), F.struct(F.col(column), key.alias("key")).alias("x")).groupBy("at").agg(F.collect_list("x").alias(out)).select(out)

    pairs = blocks(asked, "query", asked_block, "asked").crossJoin(blocks(names, "name", block, "names")).repartition(F.rand(3))
    found = pairs.mapInArrow(_best_of_blocks(keep), "name string, query string, score double")
    return found.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "name"))).where(F.col("r") <= keep)


class _Cards(HTMLParser):
    """Links to series with the text of the block around them."""

    def __init__(self):
        super().__init__()
        self.cards, self.blocks, self.link = [], [], None

    def handle_starttag(self, tag, attrs):
        if tag in ("article", "li", "section"):
            self.blocks.append({"text": [], "links": []})
        elif tag == "a":
            self.link = {"href": dict(attrs).get("href") or "", "text": []}

    def handle_endtag(self, tag):
        if tag == "a" and self.link:
            (self.blocks[-1]["links"] if self.blocks else self.cards).append(self.link | {"block": None})
            self.link = None
        elif tag in ("article", "li", "section") and self.blocks:
            block = self.blocks.pop()
            words = " ".join(" ".join(block["text"]).split())
            self.cards += [x | {"block": words} for x in block["links"]]

    def handle_data(self, data):
        if self.link is not None:
            self.link["text"].append(data)
        for block in self.blocks:
            block["text"].append(data)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("href", "title", "block")])))
def cards(s: pd.Series) -> pd.Series:
    """Links of a page with their text and that of the list item or article around them, in order."""

    def find(page: str | None) -> list[dict]:
        parser = _Cards()
        parser.feed(page or "")
        parser.close()
        return [{"href": x["href"], "title": " ".join(" ".join(x["text"]).split()), "block": x["block"] or ""} for x in parser.cards]

    return s.map(find)


class _Visible(HTMLParser):
    def __init__(self):
        super().__init__()
        self.parts, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "noscript")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "noscript") and self.hidden:
            self.hidden -= 1

    def handle_data(self, data):
        if not self.hidden and data.strip():
            self.parts.append(data.strip())


@F.pandas_udf(T.StringType())
def page_text(s: pd.Series) -> pd.Series:
    """Visible text of a page, one line per text node; null as ''."""

    def read(page: str | None) -> str:
        parser = _Visible()
        parser.feed(page or "")
        parser.close()
        return "\n".join(parser.parts)

    return s.map(read)


def story_cards(found: Column) -> Column:
    """Complete series among a page's cards: ``(id, title, author, segments, reviews)``; of equal ids the last."""
    row = lambda x: F.struct(
        F.regexp_extract(x["href"], r"/stories/(\d+)", 1).alias("id"),
        x["title"].alias("title"),
        F.regexp_extract(x["block"], r"(?i)\bby\s+(.+?)\s*[•\-]\s*Complete\b", 1).alias("author"),
        F.regexp_extract(x["block"], r"(?i)\bComplete\s*[•\-]\s*(\d+)\s+chapters?\b", 1).try_cast("int").alias("segments"),
        F.translate(F.regexp_extract(x["block"], r"(?i)Show Reviews\s*\(([\d,]+)\)", 1), ",", "").try_cast("int").alias("reviews"),
    )
    good = F.filter(
        found,
        lambda x: F.rlike(x["href"], F.lit(r"/stories/\d+"))
        & (x["title"] != "")
        & ~F.lower(x["title"]).isin("read now", "continue reading")
        & ~F.rlike(x["block"], F.lit(r"(?i)\b(?:Ongoing|Excerpt)\s*[•\-]\s*\d+\s+chapters?\b"))
        & F.rlike(x["block"], F.lit(r"(?i)\bComplete\b")),
    )
    rows = F.transform(good, row)
    ids = F.array_distinct(F.transform(rows, lambda r: r["id"]))
    return F.transform(ids, lambda i: F.try_element_at(F.filter(rows, lambda r: r["id"] == i), F.lit(-1)))
