"""SpotSigs fingerprints with DataFrame functions only.

An anchor is a common word.  A signature is the chain of the ``CHAIN`` content words that follow an
anchor (content words are the others; further anchors inside a chain are passed over).  A text's
fingerprint is its set of signatures, as sorted 32-bit hashes in hexadecimal, 8 digits each; so
it keeps all of them, and equal texts have equal fingerprints.  For texts with few common words
(tables, other languages), one content word in ``SPARE``, by its hash, starts a chain too: a rule that
looks at one place only, so that an edit elsewhere changes no signature.  The rule is the same for texts
of any length; only one where it finds nothing takes a chain at each of its words, and one without
words has the empty fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillframe.llm.common import cut, small

CHAIN = 3
DIGITS = 8
SPARE = 4
#: Buckets of ids whose order one window finds.
RUN = 4096

#: Common words of English, German, French and Spanish.
ANCHORS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "it", "was", "for", "on", "with", "as", "are", "by",
    "at", "from", "this", "be", "or", "an", "which", "had", "not", "have",
    "der", "die", "das", "und", "in", "den", "von", "zu", "mit", "sich", "des", "auf", "für", "ist", "im", "dem",
    "nicht", "ein", "eine", "als", "auch", "es", "an", "er", "hat", "aus", "bei",
    "de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "dans", "est", "que", "pour", "qui", "sur",
    "au", "il", "par", "pas", "plus",
    "el", "y", "los", "se", "del", "las", "por", "con", "una", "su", "para", "como", "más", "o", "al", "lo",
    "sus",
)


def with_signatures(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the sorted distinct signature hashes of a text column; null counts as empty.

    Each step is a column of its own, as an array that a lambda looks into must be at hand.
    """
    words, content, spots = (f"{out}_{x}" for x in ("words", "content", "spots"))
    common = sorted(set(ANCHORS))
    # Lower-case words without the punctuation around them.
    split = F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[\s\p{Punct}…]+"), "")
    df = df.withColumn(words, split)
    # Content words in order, each with: does an anchor stand before it?
    marked = F.transform(words, lambda w, i: F.when(~w.isin(common), F.struct(w.alias("w"), F.coalesce(F.get(F.col(words), i - 1).isin(common), F.lit(False)).alias("a"))))
    df = df.withColumn(content, F.array_compact(marked))
    chain = F.transform(content, lambda c, i: F.when(c["a"] | (F.pmod(F.hash(c["w"]), F.lit(SPARE)) == 0), F.hash(c["w"], *(F.get(F.col(content), i + k)["w"] for k in range(1, CHAIN)))))
    df = df.withColumn(spots, F.array_compact(chain))
    plain = F.transform(words, lambda w, i: F.hash(w, *(F.get(F.col(words), i + k) for k in range(1, CHAIN))))
    df = df.withColumn(out, F.array_sort(F.array_distinct(F.when(F.size(spots) > 0, F.col(spots)).otherwise(plain))))
    return df.drop(words, content, spots)


def fingerprint(sigs: Column) -> Column:
    """The signature hashes as one string."""
    return F.array_join(F.transform(sigs, lambda h: F.lpad(F.lower(F.hex(h.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), DIGITS, "0")), "")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two signature sets; two empty sets are alike.

    Pruned: where the smaller set is under ``least`` times the larger one, or one is empty, the sets
    are not compared, and the result is 0.
    """
    low, high = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    common = F.size(F.array_intersect(a, b))
    return F.when(high == 0, 1.0).when((low == 0) | (low < least * high), 0.0).otherwise(common / (F.size(a) + F.size(b) - common))


def with_next(docs: DataFrame, span: int = 512) -> DataFrame:
    """``(doc_id, text, next_text)``: the text of the next document by descending id; after the last, the first.

    Ids are dealt to buckets of ``span`` consecutive ids, and each text travels once, to its bucket.
    The first document below a bucket is found from the buckets' greatest ids, and only these
    documents travel to a second bucket.  Rows that share an id follow one another by text.
    Rows with a null id come last.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    key = F.coalesce(F.floor(F.col("doc_id") / span), F.lit(-(1 << 62)))
    tops = cut(docs.groupBy(key.alias("bucket")).agg(F.max("doc_id").alias("top"), F.count("*").alias("n")))
    # The bucket below: within runs of RUN buckets by a window for each, across them by a table with one
    # row per run, which is ``span * RUN`` ids; only that one is ordered as a whole.
    run = F.floor(F.col("bucket") / RUN)
    runs = tops.groupBy(run.alias("run")).agg(F.max("bucket").alias("highest"))
    first = F.max("highest").over(W.partitionBy())
    across = runs.select("run", F.coalesce(F.lead("highest").over(W.orderBy(F.desc("run"))), first).alias("across"))
    inner = tops.select(F.col("bucket").alias("above"), run.alias("run"), F.lead("bucket").over(W.partitionBy(run).orderBy(F.desc("bucket"))).alias("inside"))
    chain = cut(inner.join(across, "run").select("above", F.coalesce("inside", "across").alias("bucket")))
    tops = tops.join(chain, "bucket").select("bucket", "top", "above")
    keyed = docs.select(key.alias("bucket"), "doc_id", "text")
    heads = keyed.join(small(cut(tops)), "bucket").where(F.col("doc_id").eqNullSafe(F.col("top")))
    heads = heads.groupBy("above").agg(F.max(F.struct(F.col("doc_id").alias("id"), "text")).alias("h")).select(F.col("above").alias("bucket"), F.lit(None).cast("long").alias("doc_id"), F.col("h.text").alias("text"), F.lit(1).alias("guest"))
    rows = keyed.withColumn("guest", F.lit(0)).unionByName(heads)
    order = W.partitionBy("bucket").orderBy("guest", F.desc("doc_id"), F.desc("text"))
    return rows.withColumn("next_text", F.lead("text").over(order)).where("guest = 0").select("doc_id", "text", "next_text")


def edited(text: Column, following: Column) -> Column:
    """The text with its last third replaced by the first as many characters of the next one."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - third), F.substring(following, F.lit(1), third))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row's text and of its edited text, with their likenesses.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next``.  A null text counts as empty.  A single document is its own next one.  Extra
    columns are ignored; an empty table gives an empty result.
    """
    rows = with_next(docs).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    for text, out in (("text", "own"), ("edited", "changed"), ("next_text", "following")):
        rows = with_signatures(rows, text, out)
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"),
    )


def near_pairs(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """Links ``(a, b, likeness)`` between texts whose signature sets reach ``least``.

    Documents with equal fingerprints are one text, represented by the least ``doc_id``.  Texts are partitioned by the length of their
    sets: a set of n signatures is compared with sets of n to n / least signatures only.  Sets meet
    through their rarest signatures: those that reach ``least`` share one of the first
    ``n - ceil(least * n) + 1`` in order of rarity.  A signature held by one text meets none.
    """
    made = with_signatures(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "text", "sigs").where("size(sigs) > 0 and doc_id is not null")
    texts = cut(made.groupBy("sigs").agg(F.min("doc_id").alias("id")))
    held = texts.select("id", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    shared = cut(held.groupBy("sig").agg(F.count("*").alias("f")).where("f > 1"))
    ranked = held.join(shared, "sig").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("f", "sig"))).alias("s"))
    # Signatures of one text are the rarest, so they use up the prefix first.
    open_ = F.col("n") - F.ceil(least * F.col("n")) + 1 - (F.col("n") - F.size("s"))
    posted = ranked.where(open_ > 0).select("id", "n", F.explode(F.slice("s", F.lit(1), open_.cast("int"))).alias("h")).select("id", "n", "h.sig")
    posted = cut(posted)
    other = posted.select("sig", F.col("id").alias("b"), F.col("n").alias("m"))
    pairs = posted.withColumnRenamed("id", "a").join(other, "sig").where((F.col("a") != F.col("b")) & ((F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("a") < F.col("b")))) & (F.col("n") >= least * F.col("m")))
    pairs = cut(pairs.select("a", "b").distinct())
    sets = texts.select("id", "sigs")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("sigs").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("sigs").alias("y")), "b")
    return both.select("a", "b", likeness(F.col("x"), F.col("y"), least).alias("likeness")).where(F.col("likeness") >= least)
