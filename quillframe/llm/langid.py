"""Language identification by fusing evidence with Bayes' rule.

1. Text.  Each declared language, however rare, has a naive Bayes model over hashed byte trigrams, counted
   over all texts under their declared language.  A flat model stands for "no language".
2. Prior.  What the texts alone say is counted per host, per parent domain and over all.  A host's
   prior is its counts with its domain's prior as pseudo-counts, and a domain's prior likewise
   with that of the whole.
3. Declared language and address suffix.  How often a text of a language comes with a declaration
   or a suffix is counted too, and smoothed towards how often it comes at all.
4. A row's posterior is the product.  Counts are grouped sums over all rows; what is broadcast has a
   row per host, or less, and only if a count shows that it is small.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.llm.common import cut, small, text_pieces, texts, unused

BUCKETS = 1 << 13
#: A text counts as no more than so many trigrams, as neighbouring ones are not independent.
MOST_TRIGRAMS = 40
#: Pseudo-counts: of a trigram, of a domain's prior in a host's, of the whole in a conditional table.
SMOOTH, HOST_SMOOTH, TABLE_SMOOTH = 0.5, 20.0, 5.0
LEAST_POSTERIOR = 0.5
NONE = "und"

# Letters of either case are one, bytes of other scripts are kept, all else is a blank.
_FOLD = np.full(256, 32, np.uint32)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


@dataclass(frozen=True)
class Columns:
    """Which columns hold the evidence; ``url`` may be missing."""

    id: str = "doc_id"
    text: str = "text"
    declared: str = "lang"
    host: str = "source"
    url: str | None = None


def trigrams(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams of all texts one after another, and each text's number of them.

    A trigram has at most one blank, so runs of digits and signs give none.
    """
    data = _FOLD[np.frombuffer(b"\n" + b"\n".join(rows) + b"\n", np.uint8)]
    blank = (data == 32).astype(np.uint8)
    key = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
    at = np.flatnonzero(blank[:-2] + blank[1:-1] + blank[2:] < 2)
    bucket = ((key[at] * np.uint32(2654435761)) >> np.uint32(19)).astype(np.int64)
    edges = np.cumsum([0, *(len(r) + 1 for r in rows)])
    return bucket, np.diff(np.searchsorted(at, edges))


def tag(declared: Column) -> Column:
    """The primary part of a language tag, two or three letters, in lower case; null or anything else counts as ''."""
    return F.lower(F.regexp_extract(F.coalesce(declared.cast("string"), F.lit("")), r"^\s*([A-Za-z]{2,3})(?![A-Za-z])", 1))


def evidence(docs: DataFrame, columns: Columns, prefix: str = "") -> dict[str, Column]:
    """Declared language, host, parent domain and address suffix of a row."""
    host = F.lower(F.coalesce(F.col(columns.host).cast("string"), F.lit("")))
    suffix = F.lit("") if columns.url is None else F.regexp_extract(host, r"\.([a-z0-9-]+)$", 1)
    parent = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    return {f"{prefix}declared": tag(F.col(columns.declared)), f"{prefix}host": host, f"{prefix}parent": parent, f"{prefix}suffix": suffix}


class Model:
    """Log probabilities of trigrams by language, the flat one last."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = [*languages, NONE]
        share = (counts + SMOOTH) / (counts + SMOOTH).sum(axis=1, keepdims=True)
        self.log = np.log(np.vstack([share, np.full((1, BUCKETS), 1 / BUCKETS)])).astype(np.float32)

    def likelihoods(self, rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihoods of the texts, and their numbers of trigrams."""
        bucket, n = trigrams(rows)
        edge = np.concatenate([[0], np.cumsum(n)])
        out = np.zeros((len(rows), len(self.log)))
        for k, log in enumerate(self.log):
            total = np.concatenate([[0.0], np.cumsum(log[bucket], dtype=np.float64)])
            out[:, k] = total[edge[1:]] - total[edge[:-1]]
        return out * np.minimum(1, MOST_TRIGRAMS / np.maximum(n, 1))[:, None], n


def fitted(docs: DataFrame, columns: Columns) -> Model:
    """Counts the trigrams of all texts by declared language.

    The languages are all that a row declares; tags of two or three letters bound their number.
    Where none is declared, all texts are one language, named 'mul'.
    """
    rows = docs.select(tag(F.col(columns.declared)).alias("declared"), F.col(columns.text).cast("string").alias("text"))
    # A row per language tag.
    known = sorted(r["declared"] for r in rows.where("declared <> ''").select("declared").distinct().collect())
    languages = known or ["mul"]
    named = {name: k for k, name in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Languages of the task only.
        counts: dict[int, np.ndarray] = {}
        for batch in (p for b in batches for p in text_pieces(b)):
            bucket, n = trigrams(texts(batch))
            label = np.array([named.get(x, -1) for x in batch.column("declared").to_pylist()] if known else [0] * batch.num_rows, np.int64)
            met, label = np.unique(np.repeat(label, n), return_inverse=True)
            found = np.bincount(label * BUCKETS + bucket, minlength=len(met) * BUCKETS).reshape(-1, BUCKETS)
            for k, row in zip(met.tolist(), found, strict=True):
                if k >= 0:
                    counts[k] = counts.get(k, 0) + row
        for k, row in counts.items():
            used = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), k)), pa.array(used), pa.array(row[used])], ["label", "bucket", "n"])

    # At most one row per language and bucket.
    found = rows.mapInArrow(count, "label long, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(languages), BUCKETS), np.float32)
    counts[found.column("label").to_numpy(), found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return Model(languages, counts)


def with_likelihoods(docs: DataFrame, model: Model, text: str, prefix: str = "", drop: str | None = None) -> DataFrame:
    """``docs`` with log likelihoods by language and the number of trigrams; ``drop`` leaves a column out."""
    names = [c for c in docs.columns if c != drop]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in text_pieces(b, column=text)):
            likelihoods, n = model.likelihoods(texts(batch, text))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * likelihoods.shape[1], pa.int32()), pa.array(likelihoods.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), lists, pa.array(n)], [*names, f"{prefix}likelihoods", f"{prefix}trigrams"])

    fields = [f for f in docs.schema if f.name != drop]
    added = [T.StructField(f"{prefix}likelihoods", T.ArrayType(T.DoubleType())), T.StructField(f"{prefix}trigrams", T.LongType())]
    return docs.mapInArrow(run, T.StructType(fields + added))


@dataclass(frozen=True)
class Tables:
    """Log priors and log conditionals, as arrays by language."""

    hosts: DataFrame
    declared: DataFrame
    suffixes: DataFrame
    whole: list[float]


def _numbers(values: Iterable[float]) -> Column:
    """An array of numbers, as one constant however many they are."""
    return F.from_json(F.lit(json.dumps([float(x) for x in values])), "array<double>")


def _shrunk(counts: Column, towards: Column, weight: float) -> Column:
    """Shares of counts with ``weight`` pseudo-counts spread as ``towards``."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x) + weight
    return F.zip_with(counts, towards, lambda c, p: (c + weight * p) / total)


def tables(rows: DataFrame, model: Model) -> Tables:
    """Grouped counts of ``(declared, host, parent, suffix, best)`` as log tables; all are written."""
    width = len(model.languages)
    rows = cut(rows.groupBy("declared", "host", "parent", "suffix", "best").agg(F.count("*").cast("double").alias("n")))
    by = {}
    places = F.sequence(F.lit(0), F.lit(width - 1))
    for key in ("host", "parent", "declared", "suffix"):
        keys = [key, "parent"] if key == "host" else [key]
        # At most one entry per language in each map.
        sums = rows.groupBy(*keys, "best").agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("best", "n"))).alias("found"))
        by[key] = sums.select(*keys, F.transform(places, lambda k: F.coalesce(F.try_element_at("found", k), F.lit(0.0))).alias("counts"))
    found = rows.groupBy("best").agg(F.sum("n").alias("n")).collect()
    total = np.ones(width)
    for r in found:
        total[r["best"]] += r["n"]
    whole = _numbers(total / total.sum())
    log = lambda shares: F.transform(shares, lambda x: F.log(x))
    parents = cut(by["parent"].select("parent", _shrunk(F.col("counts"), whole, HOST_SMOOTH).alias("above")))
    hosts = by["host"].join(small(parents, 8 * width), "parent").select("host", log(_shrunk(F.col("counts"), F.col("above"), HOST_SMOOTH)).alias("prior"))

    def conditional(key: str) -> DataFrame:
        # P(key | language), smoothed towards P(key).
        mine = F.aggregate("counts", F.lit(0.0), lambda a, x: a + x) / float(total.sum())
        each = F.zip_with("counts", _numbers(total), lambda c, n: F.log((c + TABLE_SMOOTH * mine) / (n + TABLE_SMOOTH)))
        return cut(by[key].select(key, each.alias(f"given_{key}")))

    return Tables(cut(hosts), conditional("declared"), conditional("suffix"), [float(x) for x in np.log(total / total.sum())])


def fused(rows: DataFrame, found: Tables, model: Model, prefix: str = "") -> DataFrame:
    """``rows`` with ``language``, ``confidence``, ``text_language`` and ``kept``, all under the prefix."""
    p = prefix
    for table, key, value in ((found.hosts, "host", "prior"), (found.declared, "declared", "given_declared"), (found.suffixes, "suffix", "given_suffix")):
        table = table.select(F.col(key).alias(f"{p}key"), F.col(value).alias(f"{p}{value}"))
        rows = rows.join(small(table, 8 * len(model.languages)), F.col(f"{p}{key}") == F.col(f"{p}key"), "left").drop(f"{p}key")
    zero = F.array_repeat(F.lit(0.0), len(model.languages))
    whole = _numbers(found.whole)
    total = F.col(f"{p}likelihoods")
    for value, default in (("prior", whole), ("given_declared", zero), ("given_suffix", zero)):
        total = F.zip_with(total, F.coalesce(F.col(f"{p}{value}"), default), lambda a, b: a + b)
    names = F.array(*(F.lit(x) for x in model.languages))
    rows = rows.withColumn(f"{p}total", total)
    best = F.array_max(f"{p}total")
    rows = rows.withColumn(f"{p}best", best)
    norm = F.aggregate(F.col(f"{p}total"), F.lit(0.0), lambda a, x: a + F.exp(x - F.col(f"{p}best")))
    rows = rows.withColumns({f"{p}confidence": 1 / norm, f"{p}language": F.element_at(names, F.array_position(f"{p}total", F.col(f"{p}best")).cast("int"))})
    spoken = F.element_at(names, F.array_position(f"{p}likelihoods", F.array_max(f"{p}likelihoods")).cast("int"))
    rows = rows.withColumn(f"{p}text_language", F.when(F.col(f"{p}trigrams") > 0, spoken).otherwise(NONE))
    kept = (F.col(f"{p}trigrams") > 0) & (F.col(f"{p}language") != NONE) & (F.col(f"{p}confidence") >= LEAST_POSTERIOR)
    return rows.withColumn(f"{p}kept", kept)


def _best() -> Column:
    return (F.array_position("likelihoods", F.array_max("likelihoods")) - 1).cast("int").alias("best")


def identified(docs: DataFrame, columns: Columns = Columns()) -> DataFrame:
    """``id, language, confidence, text_language, declared, kept`` for every row of ``docs``.

    ``kept`` is false for a text without letters (null or empty ones among them), for one that looks like
    no language, and where no language has a posterior of LEAST_POSTERIOR.  A null or unknown
    declaration, host or address adds no evidence of its own.  Repeated rows are judged alike; other
    columns are ignored; an empty table gives an empty result.
    """
    model = fitted(docs, columns)
    rows = docs.select(F.col(columns.id).cast("long").alias("id"), *(c.alias(n) for n, c in evidence(docs, columns).items()), F.col(columns.text).cast("string").alias("text"))
    rows = cut(with_likelihoods(rows, model, "text", drop="text"))
    told = rows.where("trigrams > 0").select("declared", "host", "parent", "suffix", _best())
    out = fused(rows, tables(told, model), model)
    return out.select(F.col("id").alias(columns.id), "language", "confidence", "text_language", "declared", "kept")


def keep_identified(docs: DataFrame, columns: Columns = Columns()) -> DataFrame:
    """The rows of ``docs`` that ``identified`` keeps, with their own columns only.

    Columns may have any names.  Null and empty texts, and those without letters, go; null declarations and hosts
    add no evidence; repeated rows stay or go together; an empty table stays empty.
    """
    prefix = unused(docs.columns, "lang_")
    model = fitted(docs, columns)
    rows = docs.select(*(c.alias(n) for n, c in evidence(docs, columns).items()), F.col(columns.text).cast("string").alias("text"))
    told = with_likelihoods(rows, model, "text", drop="text").where("trigrams > 0").select("declared", "host", "parent", "suffix", _best())
    found = tables(told, model)
    rows = with_likelihoods(docs.withColumns(evidence(docs, columns, prefix)), model, columns.text, prefix)
    return fused(rows, found, model, prefix).where(F.col(f"{prefix}kept")).select(*docs.columns)


def from_pages(pages: DataFrame) -> DataFrame:
    """``page_id, text, lang, source, url`` of web pages: visible text, declared language and host."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    lang = F.regexp_extract(html, r"(?i)<html[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1)
    host = F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)
    return pages.select("page_id", bare.alias("text"), lang.alias("lang"), host.alias("source"), "url")
