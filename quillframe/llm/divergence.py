"""How far the sources of a language are apart: per pair of sources, and per source by its overused terms.

1. Terms are counted in Arrow batches per (language, source), with the number of documents that hold them; a task adds
   up before anything is shuffled, so a term or source with a third of all rows gives a few rows per task.
2. Every group's count of a kept term becomes a share ``p`` in billionths, smoothed by 5.  A kept term that the
   group lacks has the baseline ``p0``, the same for all of them, so only terms that occur are ever stored.
3. Pairs: the sum of ``|p - q|`` over all V terms is ``V * |p0 - q0|`` plus corrections.  Terms of one side are corrected
   from a histogram of that side's shares and running sums over it; terms of both sides by a join on the term.
4. Ranking: for each group the value at rank 50 is found by radix selection: distributed histograms of
   ten bits of the values at a time, from the top, each narrowed to the bin in which the rank lies.
   Where more rows share that value than still fit, histograms of the terms' UTF-8 bytes go on, two
   at a time, in ascending order.  Only the rows that are returned are ever sorted.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillframe.llm.common import cut, small, text_pieces, texts

SCALE = 1_000_000_000
SMOOTHING = 5
LEAST_DOCS = 30
TOP = 50
#: Values are below ``2 ** (DIGIT * ROUNDS)``.
DIGIT, ROUNDS = 10, 3
#: Terms, and bytes of text, that a task adds up before it hands them on.
HELD_TERMS, HELD_BYTES = 400_000, 32 << 20
#: Sources that hold a term, to a block of the join of sources.
SOURCE_BLOCK = 512

GROUP = ["lang", "source"]
#: ASCII capitals in lower case; all other ASCII characters but letters separate terms.
_TERMS = bytes(c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERMS).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)`` for rows of ``(lang, source, text)``: occurrences, and documents with them.

    A row with a null term, for each group that occurs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, holders, size = defaultdict(Counter), defaultdict(Counter), 0

        def flush() -> pa.RecordBatch:
            columns = [[], [], [], [], []]
            for (lang, source), terms in counts.items():
                held = holders[lang, source]
                columns[0] += [lang] * (len(terms) + 1)
                columns[1] += [source] * (len(terms) + 1)
                columns[2] += [None, *terms]
                columns[3] += [0, *terms.values()]
                columns[4] += [0, *(held[t] for t in terms)]
            counts.clear()
            holders.clear()
            kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*arrays[:2], arrays[2].cast(pa.string()), *arrays[3:]], ["lang", "source", "term", "n", "docs"])

        for batch in (p for b in batches for p in text_pieces(b)):
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts(batch), strict=True):
                found = Counter(terms_of(text))
                counts[lang, source].update(found)
                holders[lang, source].update(found.keys())
                size += len(text)
            if size > HELD_BYTES or sum(map(len, counts.values())) > HELD_TERMS:
                yield flush()
                size = 0
        if counts:
            yield flush()

    return docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(count: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(SCALE * (count + 5) / (total + 5 * terms))``, exact whatever the counts; null without terms."""
    above = (count + SMOOTHING).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    below = (total + SMOOTHING * terms).cast("decimal(20,0)")
    return F.when(terms > 0, 1 + F.call_function("div", above, below))


def shares(docs: DataFrame, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """Groups ``(lang, source, v, n_terms, p_sum, p0)`` and their kept terms ``(lang, source, term, p, q, n_sources)``.

    ``p`` is a term's share in the group, ``q`` that in the language; ``n_terms`` and ``p_sum`` are of the terms
    that the group holds, ``v`` is the number of terms that the language keeps.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    found = term_counts(docs.select(text("lang"), text("source"), text("text"))).groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    found = cut(found)
    groups = found.where("term is null").select(*GROUP)
    held = found.where("term is not null")
    kept = cut(held.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all_n"), F.count("*").alias("n_sources")).where(F.col("docs") >= least_docs).drop("docs"))
    langs = small(cut(kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("lang_total"))))
    held = cut(held.select(*GROUP, "term", "n").join(kept, ["lang", "term"]))
    totals = small(cut(held.groupBy(*GROUP).agg(F.sum("n").alias("total"))))
    groups = groups.join(langs, "lang", "left").join(totals, GROUP, "left").select(*GROUP, F.coalesce("v", F.lit(0).cast("long")).alias("v"), F.coalesce("total", F.lit(0).cast("long")).alias("total"))
    groups = groups.withColumn("p0", F.coalesce(share(F.lit(0).cast("long"), F.col("total"), F.col("v")), F.lit(0).cast("long")))
    rows = held.join(langs, "lang").join(totals, GROUP)
    rows = cut(rows.select(*GROUP, "term", share(F.col("n"), F.col("total"), F.col("v")).alias("p"), share(F.col("all_n"), F.col("lang_total"), F.col("v")).alias("q"), "n_sources"))
    sums = rows.groupBy(*GROUP).agg(F.count("*").alias("n_terms"), F.sum("p").alias("p_sum"))
    groups = groups.join(sums, GROUP, "left").fillna(0, ["n_terms", "p_sum"])
    return cut(groups.select(*GROUP, "v", "n_terms", "p_sum", "p0")), rows


def one_sided(groups: DataFrame, rows: DataFrame) -> DataFrame:
    """``(lang, source, item, value)``: for each other source, ``sum(|p - q0| - |p0 - q0|)`` over the terms of ``source``.

    As ``|p - x|`` is ``p - x`` but for shares below ``x``, the sums follow from how many shares of the group lie below each
    other source's baseline and what they come to: running sums over the histogram of its shares.
    """
    none = F.lit(0).cast("long")
    histogram = rows.groupBy(*GROUP, "p").agg(F.count("*").alias("n")).select(*GROUP, F.lit(None).cast("string").alias("item"), F.col("p").alias("x"), "n", (F.col("n") * F.col("p")).alias("s"))
    others = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("x"))
    asked = groups.select(*GROUP).join(others, "lang").where("source <> item").select(*GROUP, "item", "x", none.alias("n"), none.alias("s"))
    upto = W.partitionBy(*GROUP).orderBy("x").rangeBetween(W.unboundedPreceding, 0)
    below = histogram.unionByName(asked).withColumns({"n": F.sum("n").over(upto), "s": F.sum("s").over(upto)}).where("item is not null")
    above = F.col("p_sum") - F.col("n_terms") * F.col("x") + 2 * (F.col("x") * F.col("n") - F.col("s"))
    found = below.join(small(groups), GROUP)
    return found.select(*GROUP, "item", (above - F.col("n_terms") * F.abs(F.col("p0") - F.col("x"))).alias("value"), (F.col("v") * F.abs(F.col("p0") - F.col("x"))).alias("base"))


def two_sided(groups: DataFrame, rows: DataFrame) -> DataFrame:
    """``(lang, source, item, value)``, the source before the item: what terms that both hold add to the other corrections.

    The sources of a term that very many of them hold are dealt to blocks, each of which meets all blocks, so that no task
    has all pairs of a term.
    """
    blocks = F.ceil(F.col("n_sources") / SOURCE_BLOCK).cast("int")
    rows = rows.join(small(groups.select(*GROUP, "p0")), GROUP).where("n_sources > 1").withColumn("blocks", blocks)
    one = rows.select(*GROUP, "term", "p", "p0", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("block"))
    other = rows.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    met = one.join(other, ["lang", "term", "block"]).where("source < item")
    p, q, p0, q0 = (F.col(c) for c in ("p", "q", "p0", "q0"))
    return met.groupBy(*GROUP, "item").agg(F.sum(F.abs(p - q) - F.abs(p - q0) - F.abs(p0 - q) + F.abs(p0 - q0)).alias("value"))


def pairs(groups: DataFrame, rows: DataFrame) -> DataFrame:
    """``(lang, source, item, value)`` for each ordered pair of a language's sources; their number is that of the result."""
    single = cut(one_sided(groups, rows))
    both = cut(two_sided(groups, rows))
    turned = lambda df: df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    every = single.select(*GROUP, "item", F.col("value") + F.col("base")).toDF(*GROUP, "item", "value")
    for part in (turned(single), both, turned(both)):
        every = every.unionByName(part)
    return every.groupBy(*GROUP, "item").agg(F.sum("value").alias("value"))


def _chosen(bins: DataFrame, ascending: bool) -> DataFrame:
    """Of histograms ``(lang, source, digit, n, need)`` each group's bin in which its rank lies, with the ranks that are left in it."""
    order = F.asc("digit") if ascending else F.desc("digit")
    before = F.sum("n").over(W.partitionBy(*GROUP).orderBy(order).rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    bins = bins.withColumn("before", before).where("before < need and before + n >= need")
    return bins.select(*GROUP, F.col("digit").alias("bin"), (F.col("need") - F.col("before")).alias("need"), (F.col("n") == F.col("need") - F.col("before")).alias("whole"))


def leading(rows: DataFrame, most: int = TOP) -> DataFrame:
    """Of ``(lang, source, item, value)`` each group's ``most`` rows of the largest values, of equal ones the least items in UTF-8.

    Values lie in 0 to 2 ** 30 - 1 and items differ within a group.  No group is sorted: a group's histogram has at most 1,024 bins for
    values, and as many as there are pairs of bytes for items.  A round costs one pass over the rows still open; rounds over bytes
    go on while a group has more equal rows than ranks left, so they follow the longest beginning that such items share.
    """
    rows = cut(rows)
    state = rows.groupBy(*GROUP).agg(F.count("*").alias("n")).where(F.col("n") > most).select(*GROUP, F.lit(most).cast("long").alias("need"))
    state = cut(state)
    if state.isEmpty():
        return rows
    # Groups of up to ``most`` rows are whole.
    taken = [rows.join(small(state.select(*GROUP)), GROUP, "left_anti")]
    open_rows = rows.join(small(state.select(*GROUP)), GROUP, "left_semi")

    def narrowed(open_rows: DataFrame, state: DataFrame, digit: Column, ascending: bool) -> tuple[DataFrame, DataFrame]:
        bins = open_rows.groupBy(*GROUP, digit.alias("digit")).agg(F.count("*").alias("n")).join(small(state.select(*GROUP, "need")), GROUP)
        chosen = cut(_chosen(bins, ascending))
        placed = open_rows.withColumn("digit", digit).join(small(chosen), GROUP)
        ahead = F.col("digit") < F.col("bin") if ascending else F.col("digit") > F.col("bin")
        # What lies before the bin is in, and the bin itself if it fills the ranks exactly.
        taken.append(placed.where(ahead | F.col("whole") & (F.col("digit") == F.col("bin"))).select(rows.columns))
        return cut(placed.where(~F.col("whole") & (F.col("digit") == F.col("bin"))).select(rows.columns)), chosen.where(~F.col("whole"))

    for k in reversed(range(ROUNDS)):
        open_rows, state = narrowed(open_rows, state, F.shiftright("value", DIGIT * k).bitwiseAND((1 << DIGIT) - 1), False)
    at = 1
    while not open_rows.isEmpty():
        # An item that has ended counts as one before all that go on.
        two = F.rpad(F.hex(F.substring(F.col("item").cast("binary"), at, 2)), 4, " ")
        open_rows, state = narrowed(open_rows, state, two, True)
        at += 2
    out = taken[0]
    for part in taken[1:]:
        out = out.unionByName(part)
    return out


def audited(docs: DataFrame, least_docs: int = LEAST_DOCS, most: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``: how each (language, source) group differs from the others of its language.

    Part ``pair``: for each other source of the language, the sum of the shares' differences over all kept terms (0 if there are
    none).  Part ``term``: the terms that the group uses more than its language does, with the difference of shares, to rank ``most``.
    Ranks descend by value, then ascend by the item's UTF-8 bytes.

    A language keeps the terms (runs of ASCII letters and other characters beyond ASCII) that ``least_docs`` of its documents hold.  A null
    text, language or source counts as ''.  Repeated rows count each; a group without terms has its pairs; a language of
    one source has no pair.  Ids and other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    groups, rows = shares(docs, least_docs)
    over = rows.where("p > q").select(*GROUP, F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    parts = [pairs(groups, rows).withColumn("part", F.lit("pair")), leading(over, most).withColumn("part", F.lit("term"))]
    found = parts[0].unionByName(parts[1])
    place = F.row_number().over(W.partitionBy(*GROUP, "part").orderBy(F.desc("value"), "item"))
    return found.select(*GROUP, "part", "item", F.col("value").cast("long").alias("value"), place.cast("int").alias("rank"))
