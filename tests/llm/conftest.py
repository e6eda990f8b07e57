from __future__ import annotations

import pytest
from pyspark.sql import types as T

#: A documents table with what may go wrong: nulls anywhere, empty and very long texts, ties, repeated rows, names that clash.
AWKWARD = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), ("id", T.StringType()), ("hash", T.StringType()), ("kept", T.BooleanType()), ("part", T.LongType()), ("score", T.DoubleType()))])


def prose(seed: int, n: int) -> str:
    import random

    rng = random.Random(seed)
    words = "the of and to in that it was his with as had for she not at but be on they".split() + ["w" + str(k) for k in range(400)]
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    texts = [None, "", "  \n\t", "one", "a b c d", prose(1, 60), prose(1, 60), prose(2, 400), prose(2, 390) + " end of it", "x" * 30_000, ("spam " * 4000), prose(3, 9000), prose(4, 50) + prose(2, 100), "é" * 250, "line\n" * 40]
    rows = [(k, t, "en", f"s{k % 3}", None, "i", "h", False, 1, 0.5) for k, t in enumerate(texts)]
    rows += [(5, texts[5], "en", "s2", 1, None, None, None, None, None), (None, prose(1, 60), None, None, None, None, None, None, None, None), (None, None, "??", "", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, AWKWARD).repartition(3)


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.where("false")
