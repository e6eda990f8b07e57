"""The queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillframe.llm.bpe import digests, encode_and_decode
from quillframe.llm.divergence import audited as divergences
from quillframe.llm.hostrules import verdicts_of
from quillframe.llm.interactions import audited as interactions
from quillframe.llm.langid import Columns, from_pages, identified
from quillframe.llm.minhash import near_duplicates
from quillframe.llm.packing import digests as piece_digests
from quillframe.llm.packing import packed
from quillframe.llm.quality import scored
from quillframe.llm.repeats import digests as repeat_digests
from quillframe.llm.simhash import near_duplicates as near_fingerprints
from quillframe.llm.spotsigs import fingerprints
from quillframe.llm.unigram import token_counts
from quillframe.llm.warc import round_trip

QUERIES = {}
ORACLES = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@register
def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose shingle sets have a similarity of 0.85 or more."""
    return near_duplicates(_documents(spark, sf_dir))


@register
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, written, normalised to one member per record, and read back."""
    found = round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op2_warc"] = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""


@register
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text's byte-level BPE ids, and of what they decode to."""
    return digests(encode_and_decode(_documents(spark, sf_dir)))


@register
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text by a network over pooled word vectors."""
    return scored(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@register
def op5_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts of the quality rules for every document."""
    found = verdicts_of(_documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@register
def op6_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as tokens, packed with their lexical neighbours into windows of 2048."""
    return piece_digests(packed(_documents(spark, sf_dir)))


@register
def op7_unigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of words and unigram tokens of every document."""
    return token_counts(_documents(spark, sf_dir))


@register
def op8_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likenesses."""
    return fingerprints(_documents(spark, sf_dir))


@register
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of every text without its passages of 200 bytes or more that occur elsewhere."""
    return repeat_digests(_documents(spark, sf_dir))


@register
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, from its text, its declared language and its host."""
    return identified(_documents(spark, sf_dir))


@register
def op10_language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every web page, from its text, its markup's language, its host and its address suffix."""
    pages = from_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return identified(pages, Columns(id="page_id", url="url"))


@register
def op11_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose SimHash fingerprints differ in at most 2 bits."""
    return near_fingerprints(_documents(spark, sf_dir))


@register
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each language's sources are apart, and the terms that each of them overuses."""
    return divergences(_documents(spark, sf_dir))


ORACLES["op12_source_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
), t AS (SELECT row_id, lang, source, unnest(words) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS all_n FROM t GROUP BY lang, term HAVING count(DISTINCT row_id) >= 30
), langs AS (SELECT lang, count(*) AS v, sum(all_n) AS total FROM kept GROUP BY lang
), held AS (
  SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept k ON t.lang = k.lang AND t.term = k.term GROUP BY ALL
), totals AS (SELECT lang, source, sum(n) AS total FROM held GROUP BY ALL
), groups AS (
  SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce(s.total, 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) g
  LEFT JOIN langs l ON g.lang = l.lang LEFT JOIN totals s ON g.lang = s.lang AND g.source = s.source
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS n,
         1 + (1000000000 * (coalesce(h.n, 0) + 5)::HUGEINT) // (g.total + 5 * g.v)::HUGEINT AS p,
         1 + (1000000000 * (k.all_n + 5)::HUGEINT) // (l.total + 5 * l.v)::HUGEINT AS q
  FROM groups g JOIN kept k ON g.lang = k.lang JOIN langs l ON g.lang = l.lang
  LEFT JOIN held h ON g.lang = h.lang AND g.source = h.source AND k.term = h.term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON a.lang = s.lang AND a.source = s.source AND b.source = s.item
  UNION ALL
  SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM found
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""


@register
def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes, at each step of every order of them."""
    return interactions(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLES["op13_filter_interactions"] = r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS words
  FROM documents
), l AS (
  SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
          100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text),
          regexp_matches(text, '[#$%&*|]'),
          coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY text), false)] AS fails
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id
), masks AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL
), parts AS (SELECT DISTINCT part FROM masks
), letters AS (SELECT unnest([1, 2, 3, 4, 5]) AS k
), orders AS (
  SELECT [a.k, b.k, c.k, d.k, e.k] AS o
  FROM letters a JOIN letters b ON b.k <> a.k JOIN letters c ON c.k NOT IN (a.k, b.k)
  JOIN letters d ON d.k NOT IN (a.k, b.k, c.k) JOIN letters e ON e.k NOT IN (a.k, b.k, c.k, d.k)
), steps AS (
  SELECT o, list_aggregate([substr('ABCDE', x, 1) FOR x IN o], 'string_agg', '') AS filter_order, k AS step, o[k] AS own,
         o[1:k - 1] AS before
  FROM orders, letters
), found AS (
  SELECT p.part, s.filter_order, s.step, s.own,
         sum(m.n) FILTER (NOT m.fails[s.own] AND len([x FOR x IN s.before IF m.fails[x]]) = 0) AS kept,
         sum(m.n) FILTER (m.fails[s.own] AND len([x FOR x IN s.before IF m.fails[x]]) = 0) AS removed,
         sum(m.n) FILTER (m.fails[s.own] AND len([x FOR x IN s.before IF m.fails[x]]) > 0) AS redundant,
         sum(m.n) FILTER (m.fails[s.own] AND len([x FOR x IN m.fails IF x]) = 1) AS unique_fails,
         sum(m.good) FILTER (m.fails[s.own] AND len([x FOR x IN s.before IF m.fails[x]]) = 0) AS good_lost,
         sum(m.toxic) FILTER (m.fails[s.own] AND len([x FOR x IN s.before IF m.fails[x]]) = 0) AS toxic_lost
  FROM parts p JOIN steps s ON true JOIN masks m ON m.part = p.part
  GROUP BY p.part, s.filter_order, s.step, s.own
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
       CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM found
"""
