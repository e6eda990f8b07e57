"""The prose of a page against one paragraph after the other, and archives that are refreshed in part."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from quillframe.functions import prose
from quillframe.operators import merkle

TALK = "and then she said that there was nothing more to know about him"


def plain(paragraphs, links=()):
    if sum("/0000" in x for x in links) > 5:
        return []
    out = []
    for t in paragraphs:
        low = t.lower()
        words = set(low.split())
        if len(t) < 10 or (t.isupper() and len(t) < 50) or re.search(r"(?:^|\s)\d*chapter\s+\d+", t, re.IGNORECASE):
            continue
        label = any(x in low for x in prose.LABELS)
        if not label and "next" in low and "previous" in low:
            break
        if label or (words and sum(w in prose.PROSE for w in words) / len(words) < 0.03):
            if len(t) < 200:
                continue
            break
        if t not in out:
            out.append(t)
    return out if len(out) >= 3 else []


def test_prose_bodies(spark):
    pages = [
        [TALK, TALK + " a", TALK, TALK + " b", "short"],
        ["A HEADING IN CAPITALS", "Chapter 7 and more of it", "12chapter 3 of it all", *(f"{TALK} {k}" for k in range(4)), "Load more of these", "x" * 250, TALK + " after"],
        [*(f"{TALK} {k}" for k in range(3)), "Leave a reply, " + "please " * 40, TALK + " after"],
        [*(f"{TALK} {k}" for k in range(3)), "the next one, then the previous... no, the next: Next | Previous ", TALK + " after"],
        [*(f"{TALK} {k}" for k in range(3)), "lorem ipsum dolor", "sit amet " * 30, TALK + " after"],
        [TALK, TALK + " b"],
        ["next is the one that goes before the previous"],
        [],
        [TALK + " " + "über", "ÄÖÜ ÄÖÜ ÄÖÜ", " chapter 4 of it", f"{TALK} 1", f"{TALK} 2"],
    ]
    links = [[], [], ["/x/0000"] * 5, ["/x/0000"] * 5 + ["/y"] * 9, [], [], [], [], []]
    df = spark.createDataFrame([(k, p, x) for k, (p, x) in enumerate(zip(pages, links, strict=True))], "k int, p array<string>, l array<string>")
    got = {r["k"]: r["o"] for r in df.select("k", prose.prose_body(F.col("p"), F.col("l")).alias("o")).collect()}
    assert got == {k: plain(p, x) for k, (p, x) in enumerate(zip(pages, links, strict=True))}
    assert [len(got[k]) for k in range(6)] == [3, 4, 3, 4, 3, 0]
    row = df.limit(1).select(prose.prose_body(F.lit(None).cast("array<string>")).alias("a"), prose.prose_body(F.col("p"), F.array_repeat(F.lit("/0000"), 6)).alias("b"), prose.prose_body(F.col("p"), F.lit(None).cast("array<string>")).alias("c")).first()
    assert (row["a"], row["b"], len(row["c"])) == ([], [], 3)


def test_an_archive_is_refreshed_in_part(spark, tmp_path):
    def rows(changed=(), without=(), more=()):
        return spark.createDataFrame([(k, "new" if k in changed else f"v{k % 7}", None) for k in [*range(2000), *more] if k not in without], "k long, v string, part string")

    path = f"{tmp_path}/a"
    first = merkle.Archive(rows(), path, ["k"])
    made = first.refresh()
    assert len(made) == len(set(made)) and 200 < len(made) <= 256
    assert first.refresh() == []
    changed = merkle.Archive(rows(changed=[77]), path, ["k"])
    part = spark.range(77, 78).select(merkle.part_of("id")).first()[0]
    assert changed.refresh() == [part]
    assert sorted(map(tuple, changed.read().collect()), key=lambda r: r[0]) == sorted(map(tuple, rows(changed=[77]).collect()), key=lambda r: r[0])
    fewer = merkle.Archive(rows(without=range(5, 2000), more=[5000]), path, ["k"])
    fewer.refresh()
    assert sorted(r["k"] for r in fewer.read().collect()) == [0, 1, 2, 3, 4, 5000]
    # Whatever the order and the partitions, and not for another row.
    trees = [{r["node"]: (r["n"], r["digest"]) for r in merkle.tree(merkle.leaves(df, ["k"])).collect()} for df in (rows(), rows().repartition(5), rows(changed=[3]))]
    assert trees[0] == trees[1] and trees[0][""][0] == 2000
    assert sum(trees[0][n] != trees[2][n] for n in trees[0]) == 3
    assert merkle.tree(merkle.leaves(rows().where("false"), ["k"])).count() == 0


def test_each_paragraph_is_judged_once(spark):
    df = spark.createDataFrame([(1, [TALK])], "k int, p array<string>").select(prose.prose_body(F.col("p"), F.col("p")).alias("o"))
    assert df._jdf.queryExecution().analyzed().toString().count("chapter\\s+") == 1
