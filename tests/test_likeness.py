"""The index of titles against comparing all pairs."""

from __future__ import annotations

import difflib
import random

import pytest

from quillframe.operators import likeness

WORDS = "the red queen of night and a dragon heir lost crown moon river king silver blade rises aaaa aaaaaa b é".split()


def titles(n, seed):
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        t = " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 7)))
        out.add(t)
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(t))
            out.add(rng.choice([t[:k] + t[k + 1 :], t[:k] + rng.choice("xyz ") + t[k:], t.title(), t + "!"]))
    return sorted(out)[:n] + ["", "!?"]


def key(t):
    out = "".join(c if c.isascii() and c.isalnum() else " " for c in t.lower().replace("&", " and ").replace("'", ""))
    return " ".join(out.split())


def score(q, n):
    a, b = key(q), key(n)
    return 0.0 if not a or not b else 1.0 if a == b else difflib.SequenceMatcher(None, a, b).ratio()


@pytest.mark.parametrize("least", [0.8, 0.9, 0.96])
def test_alike(spark, least):
    names = titles(150, 2)
    asked = sorted({*titles(30, 1), *(n[:2] + n[3:] for n in names[::3]), *(n.upper() for n in names[::7])})
    got = likeness.alike(spark.createDataFrame([(x,) for x in asked], "query string"), spark.createDataFrame([(x,) for x in names] + [(None,)], "name string"), least)
    want = sorted((q, n, score(q, n)) for q in asked for n in names if score(q, n) >= least)
    assert sorted(map(tuple, got.collect())) == want and want
    best = likeness.accepted(spark.createDataFrame([(x,) for x in asked], "query string"), spark.createDataFrame([(x,) for x in names], "name string"), least).collect()
    assert sorted(map(tuple, best)) == sorted(min(((q, n, s) for q, n, s in want if q == x), key=lambda r: (-r[2], r[1])) for x in {r[0] for r in want})


def test_most_alike(spark):
    asked, names = titles(40, 3), titles(120, 3) + titles(60, 4)
    names = sorted(set(names))
    got = likeness.most_alike(spark.createDataFrame([(x,) for x in asked], "query string"), spark.createDataFrame([(x,) for x in names], "name string"), 2, levels=(0.96, 0.85))
    want = [(n, q, score(q, n), k + 1) for q in asked for k, n in enumerate(sorted(names, key=lambda n, q=q: (-score(q, n), n))[:2])]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    with pytest.raises(ValueError):
        likeness.alike(spark.createDataFrame([], "query string"), spark.createDataFrame([], "name string"), 0.5)


def test_few_candidates(spark):
    rng = random.Random(9)
    names = sorted({" ".join("".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randrange(3, 9))) for _ in range(4)) for _ in range(3000)})
    one = spark.createDataFrame([(n[:6] + n[7:],) for n in names[::20]], "key string")
    two = spark.createDataFrame([(n,) for n in names], "key string")
    found = likeness.candidates(one, two, 0.96).collect()
    assert len(found) < 0.01 * len(names[::20]) * len(names)
    assert {(n[:6] + n[7:], n) for n in names[::20]} <= {(r["a"], r["b"]) for r in found}


@pytest.mark.parametrize("few", [0, 1000])
def test_accepted_among_names_of_one_template(spark, monkeypatch, few):
    monkeypatch.setattr(likeness, "FEW", few)
    names = [f"Customer#{k:09d}" for k in range(0, 6000, 17)] + ["CUSTOMER 000000017", "A much longer name of a customer of ours", "a", "ab"]
    asked = sorted({*(n[:5] + n[6:] + "!" for n in names[:300:3]), *(n[:10] + "7" + n[11:] for n in names[:40]), *(n[:3] + "x" + n[4:12] for n in names[:20]), "A much longer nome of a customer of ours", "b", "ab!", "", "!"})
    got = likeness.accepted(spark.createDataFrame([(x,) for x in asked], "query string"), spark.createDataFrame([(x,) for x in names] + [(None,)], "name string"), 0.8)
    want = [min((-score(q, n), n) for n in names) for q in asked]
    assert sorted(map(tuple, got.collect())) == sorted((q, n, -s) for q, (s, n) in zip(asked, want, strict=True) if s <= -0.8)


def test_names_of_one_template_are_not_all_compared(spark, monkeypatch):
    asked_for = []
    monkeypatch.setattr(likeness, "candidates", lambda *a: asked_for.append(a))
    names = spark.range(3000).selectExpr("concat('Customer#', lpad(id, 9, '0')) as name")
    got = likeness.accepted(names.selectExpr("concat('Custoer#', substring(name, 10), '!') as query"), names, 0.9)
    assert got.count() == 3000 and not asked_for
    keys = names.selectExpr("replace(lower(name), '#', ' ') as key")
    assert likeness.edited(keys.selectExpr("replace(key, 'm', '') as key"), keys, 1).count() == 3000
