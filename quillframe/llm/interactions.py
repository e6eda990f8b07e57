"""How quality filters interact: what each one removes at each place of every order of them.

One pass gives each document a mask of the filters that it fails.  Grouped sums of products of its flags
count, for each of the 32 sets of filters, the documents that fail all filters of the set (joint failures,
over all documents, good ones and toxic ones).  Everything else follows from these sums by inclusion and
exclusion, without another look at the documents:

- survivors of a set F: the sum over its subsets T of ``(-1) ** |T| * joint[T]``;
- removed at a step: the survivors before it less those after it; redundant: the filter's own failures less these;
- unique failures of f: the Moebius inversion ``sum over T with f of (-1) ** (|T| - 1) * joint[T]``;
- Shapley value: what F removes is a game whose Harsanyi dividends are ``(-1) ** (|T| + 1) * joint[T]``, and each
  dividend is shared evenly among the filters of its set.

So 120 orders cost no more than one, and a part with a third of all rows only gives one more row of partial
sums to each task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import cut, text_pieces, texts

#: The filters; the last one looks at the whole table, the others at one text.
FILTERS = "ABCDE"
SETS = range(1 << len(FILTERS))
WEIGHTS = {"n": None, "good": "good", "toxic": "toxic"}
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_SYMBOLS = b"#$%&*|"


def failures(text: bytes, n_chars: int) -> int:
    """The mask of the filters A to D that a text fails; bit k stands for the k-th filter.

    ``bytes.split`` cuts at the bytes 9 to 13 and 32, which no other UTF-8 character holds.
    """
    words = text.split()
    n, distinct = len(words), len(set(words))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    return (n < 200) | (2 * distinct < n) << 1 | (100 * capitals > 3 * n_chars) << 2 | (symbols > 0) << 3


def masked(docs: DataFrame) -> DataFrame:
    """``(doc_id, part, mask, digest)`` for each row of ``(doc_id, part, text)``; the digest stands for the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in text_pieces(b)):
            rows, chars = texts(batch), pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_pylist()
            masks = pa.array([failures(t, n) for t, n in zip(rows, chars, strict=True)], pa.int32())
            digests = pa.array([hashlib.sha256(t).digest() for t in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), masks, digests], ["doc_id", "part", "mask", "digest"])

    return docs.mapInArrow(run, "doc_id long, part string, mask int, digest binary")


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, mask, good, toxic)`` for each document, its mask with the filter E.

    The least ``doc_id`` of each text is a grouped minimum, which Spark takes before it shuffles, so thousands of
    copies cost one row a task.  It is joined back by text *and* id: no key has more rows than one id has.
    """
    rows = cut(masked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))))
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    found = rows.join(first, ["doc_id", "digest"], "left").join(known, "doc_id", "left")
    mask = F.col("mask") + F.when(copy, 1 << FILTERS.index("E")).otherwise(0)
    return found.select("part", mask.alias("mask"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def joint_failures(flags: DataFrame) -> DataFrame:
    """``part`` and, for each weight, an array over the sets of filters: the weight of the documents that fail all of the set."""
    for k, f in enumerate(FILTERS):
        flags = flags.withColumn(f, F.col("mask").bitwiseAND(1 << k) != 0)

    def product(subset: int) -> Column:
        out = F.lit(True)
        for k, f in enumerate(FILTERS):
            out = out & F.col(f) if subset >> k & 1 else out
        return out

    sums = {name: [F.sum(F.when(product(t), F.lit(1) if w is None else F.col(w)).otherwise(0)).cast("long") for t in SETS] for name, w in WEIGHTS.items()}
    found = flags.groupBy("part").agg(*(c.alias(f"{name}_{t}") for name, columns in sums.items() for t, c in enumerate(columns)))
    return found.select("part", *(F.array(*(f"{name}_{t}" for t in SETS)).alias(name) for name in WEIGHTS))


def _signed(joint: str, held: Callable[[Column], Column], factor: Callable[[Column], Column] = lambda t: F.lit(1)) -> Column:
    """The sum of ``(-1) ** |t| * factor(t) * joint[t]`` over the sets t for which ``held`` is true."""
    sets = F.filter(F.sequence(F.lit(0), F.lit(len(SETS) - 1)), held)
    return F.aggregate(sets, F.lit(0).cast("long"), lambda total, t: total + (1 - 2 * F.bit_count(t).bitwiseAND(1)) * factor(t) * F.get(F.col(joint), t))


def interactions(joint: DataFrame) -> DataFrame:
    """Per part, order and step what ``audited`` returns, from the joint failures alone."""
    over = lambda n, made: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), made)
    left = lambda name: over(len(SETS), lambda s: _signed(name, lambda t: t.bitwiseAND(s) == t))
    survivors = {f"{name}_left": left(name) for name in WEIGHTS}
    bit = lambda k: F.call_function("shiftleft", F.lit(1), k)
    orders = factorial(len(FILTERS))
    per_filter = {
        "failing": over(len(FILTERS), lambda k: F.get(F.col("n"), bit(k))),
        "alone": over(len(FILTERS), lambda k: -_signed("n", lambda t: t.bitwiseAND(bit(k)) != 0)),
        # A dividend is shared evenly; times the number of orders each share is whole.
        "value": over(len(FILTERS), lambda k: -_signed("n", lambda t: t.bitwiseAND(bit(k)) != 0, lambda t: F.call_function("div", F.lit(orders), F.bit_count(t)))),
    }
    # 600 rows for each part, whatever the data.
    orders_of = F.explode(F.lit(["".join(o) for o in permutations(FILTERS)])).alias("filter_order")
    rows = joint.select("part", *(c.alias(n) for n, c in (survivors | per_filter).items())).select("*", orders_of)
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    mask = lambda letters: sum((F.when(F.instr(letters, f) > 0, 1 << k).otherwise(0) for k, f in enumerate(FILTERS)), F.lit(0))
    upto = lambda n: F.substring(F.col("filter_order"), F.lit(1), n)
    own = F.substring(F.col("filter_order"), F.col("step"), F.lit(1))
    rows = rows.withColumns({"before": mask(upto(F.col("step") - 1)), "after": mask(upto(F.col("step"))), "f": F.instr(F.lit(FILTERS), own) - 1})
    pick = lambda column, index: F.get(F.col(column), F.col(index))
    lost = {name: pick(f"{name}_left", "before") - pick(f"{name}_left", "after") for name in WEIGHTS}
    return rows.select(
        "part", "filter_order", "step",
        pick("n_left", "after").alias("kept"), lost["n"].alias("removed"), (pick("failing", "f") - lost["n"]).alias("redundant"),
        pick("alone", "f").alias("unique_fails"), lost["good"].alias("good_lost"), lost["toxic"].alias("toxic_lost"), pick("value", "f").alias("shapley"),
    )


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.

    One row for each value of ``lang``, order of the filters A to E and step.  A document fails A with under 200
    words, B if 100 times its distinct words are under 50 times its words, C if 100 times its capitals A-Z exceed 3
    times its code points, D with one of ``#$%&*|``, E if a smaller ``doc_id`` anywhere in the table has the same text.

    A null text is the empty one (and a copy of other empty ones); a null ``lang`` is the part ''.  A row without
    ``doc_id`` has no label, and neither fails E nor makes others fail it; rows that share a ``doc_id`` count
    each.  Of several labels of an id, one that is set counts.  Other columns are ignored, whatever their
    names; an empty table gives an empty result.
    """
    return interactions(cut(joint_failures(flagged(docs, labels))))
