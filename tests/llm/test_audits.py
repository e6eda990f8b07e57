"""SimHash, source divergence and filter interactions against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillframe.llm import divergence, interactions, simhash
from tests.llm.conftest import prose

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


def plain_fingerprint(text):
    words = WORDS.findall(ascii_lower(text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(codes, ids):
    """``[component]`` by comparing all fingerprints; equal ids are one node."""
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in range(len(ids)):
        for y in range(x):
            if (codes[x] ^ codes[y]).bit_count() <= 2:
                p, q = sorted((find(ids[x]), find(ids[y])))
                root[q] = p
    return [find(i) for i in ids]


def test_fingerprints(spark, awkward, nothing):
    rows = awkward.collect()
    known = [(r["doc_id"], plain_fingerprint(r["text"])) for r in rows if r["doc_id"] is not None]
    want = dict(zip([i for i, _ in known], plain_components([c for _, c in known], [i for i, _ in known]), strict=True))
    got = simhash.near_duplicates(awkward).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"]) for r in got) == sorted((str(r["doc_id"]), f"{plain_fingerprint(r['text']):016x}") for r in rows)
    assert all(r["component_id"] == want.get(r["doc_id"]) for r in got)
    assert {r["fingerprint"] for r in got if r["doc_id"] in (0, 1, 2)} == {"0" * 16}
    assert simhash.near_duplicates(nothing).count() == 0


def test_an_id_with_two_texts_is_one_node(spark):
    rows = [(1, prose(1, 30)), (2, prose(2, 30)), (2, prose(1, 30)), (3, prose(2, 30)), (4, prose(4, 30))]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (2, 1), (2, 1), (3, 1), (4, 4)]


def flipped(rng, code, n):
    for b in rng.sample(range(64), n):
        code ^= 1 << b
    return code


@pytest.mark.parametrize(("subtrie", "frontier"), [(8192, 1 << 18), (6, 50)])
def test_links_of_fingerprints(spark, monkeypatch, subtrie, frontier):
    """Random fingerprints, pairs at 1 to 4 bits, and a crowd within a few bits of each other, with subtries opened and not."""
    monkeypatch.setattr(simhash, "SUBTRIE", subtrie)
    monkeypatch.setattr(simhash, "FRONTIER", frontier)
    rng = random.Random(11)
    codes = {0, 1, (1 << 64) - 1, (1 << 64) - 4, 1 << 63, (1 << 63) + 6}
    for _ in range(60):
        base = rng.getrandbits(64)
        codes |= {base, *(flipped(rng, base, n) for n in (1, 2, 3, 4))}
    crowd = rng.getrandbits(64)
    codes |= {flipped(rng, crowd, rng.randrange(5)) for _ in range(80)}
    codes = rng.sample(sorted(codes), len(codes))
    table = spark.createDataFrame([(k, int(np.uint64(c).astype(np.int64))) for k, c in enumerate(codes)], "cid long, code long")
    found = simhash.links(table).collect()
    assert all((codes[r["a"]] ^ codes[r["b"]]).bit_count() <= 2 * len(codes) for r in found)
    want = plain_components(codes, list(range(len(codes))))
    root = list(range(len(codes)))
    for _ in range(len(codes)):
        before = list(root)
        for r in found:
            root[r["a"]] = root[r["b"]] = min(root[r["a"]], root[r["b"]])
        if root == before:
            break
    assert root == want


def plain_divergence(rows, least_docs, most):
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", ascii_lower(t or ""))
    groups, holders = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = terms(text)
        groups[lang or "", source or ""].update(words)
        holders[lang or ""].update(set(words))
    out = set()
    for lang in holders:
        kept = sorted(t for t, n in holders[lang].items() if n >= least_docs)
        own = {s: {t: c[t] for t in kept} for (x, s), c in groups.items() if x == lang}
        whole = {t: sum(c[t] for c in own.values()) for t in kept}
        share = lambda counts: {t: 1 + 10**9 * (counts[t] + 5) // (sum(counts.values()) + 5 * len(kept)) for t in kept}  # noqa: B023, E731
        p, q = {s: share(c) for s, c in own.items()}, share(whole)
        for s in own:
            parts = {
                "pair": [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in own if o != s],
                "term": [(p[s][t] - q[t], t) for t in kept if own[s][t] and p[s][t] > q[t]],
            }
            for part, found in parts.items():
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found) if part == "pair" or k < most}
    return out


@pytest.mark.parametrize(("least_docs", "most", "block"), [(3, 50, 512), (1, 4, 2), (1, 1, 512), (10_000, 50, 512)])
def test_divergence(spark, monkeypatch, least_docs, most, block):
    """Ties at the last rank, items that begin alike, groups without terms, nulls, and sources dealt to blocks."""
    monkeypatch.setattr(divergence, "SOURCE_BLOCK", block)
    rng = random.Random(3)
    vocabulary = ["the", "Of", "é", "ée", "É", "zebra", "zebrah", "x" * 40 + "a", "x" * 40 + "b", "x" * 40, "日本", "😀"] + [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60)]
    rows = [(" ".join(rng.choice(vocabulary[rng.randrange(20) :]) for _ in range(rng.randrange(60))), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", "d", "é", None])) for _ in range(150)]
    rows += [(None, "en", "empty"), ("", "xx", "alone"), ("1 2 3", "yy", "one"), ("4", "yy", "two"), ("one-two_three.FOUR", "en", "a"), (rows[0][0], rows[0][1], rows[0][2])]
    docs = spark.createDataFrame([(*r, 1, "t", 2) for r in rows], "text string, lang string, source string, n int, term string, p int").repartition(4)
    got = divergence.audited(docs, least_docs, most).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == plain_divergence(rows, least_docs, most)


def test_divergence_awkward(awkward, nothing):
    rows = [(r["text"], r["lang"], r["source"]) for r in awkward.collect()]
    assert {tuple(r) for r in divergence.audited(awkward, 1).collect()} == plain_divergence(rows, 1, 50)
    assert divergence.audited(nothing).count() == 0


def test_shares_of_large_counts(spark):
    counts = [(0, 0, 7), (10**13, 10**14, 10**9), (8 * 10**15, 8 * 10**15, 3), (3, 10**15, 10**10)]
    got = spark.createDataFrame(counts, "n long, total long, v long").select(divergence.share(F.col("n"), F.col("total"), F.col("v"))).collect()
    assert [r[0] for r in got] == [1 + 10**9 * (n + 5) // (t + 5 * v) for n, t, v in counts]


def plain_interactions(rows, labels):
    first, marks = {}, defaultdict(lambda: [0, 0])
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    for i, quality, toxic in labels:
        if i is not None:
            marks[i] = [max(marks[i][0], int(quality == 1)), max(marks[i][1], int(toxic == 1))]
    parts = defaultdict(list)
    for i, text, lang in rows:
        t = text or ""
        words = WORDS.findall(t)
        fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > first[t]]
        parts[lang or ""].append((fails, *(marks[i] if i is not None and i in marks else (0, 0))))
    out = {}
    for part, docs in parts.items():
        total = Counter()
        for order in permutations(range(5)):
            left = docs
            for at, k in enumerate(order):
                gone = [d for d in left if d[0][k]]
                left = [d for d in left if not d[0][k]]
                failing = [d for d in docs if d[0][k]]
                total[k] += len(gone)
                out[part, "".join("ABCDE"[x] for x in order), at + 1] = [len(left), len(gone), len(failing) - len(gone), sum(sum(d[0]) == 1 for d in failing), sum(d[1] for d in gone), sum(d[2] for d in gone), k]
        for key in out:
            if key[0] == part:
                out[key][-1] = total[out[key][-1]]
    return {(*key, *value) for key, value in out.items()}


def test_interactions(spark, awkward, nothing):
    rng = random.Random(8)
    texts = [prose(k, rng.choice([30, 190, 210, 900])) for k in range(25)] + [" ".join(f"v{k}" for k in range(300)), "A" + " b" * 20, "ABC É " * 90, "x | y", None, "", " \n"]
    rows = [(rng.choice([k, k, k, None]), rng.choice(texts) if k % 3 else rng.choice(texts[:3]), rng.choice(["en", "fr", "", None])) for k in range(120)]
    rows += [(7, texts[0], "en"), (7, texts[0], "en"), (7, texts[1], "fr")]
    labels = [(k, rng.randrange(2), rng.randrange(2)) for k in range(60)] + [(7, 1, None), (7, 0, 1), (None, 1, 1), (9999, 1, 1)]
    marked = spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, toxic int, part string")
    docs = spark.createDataFrame([(*r, 1, True, "A") for r in rows], "doc_id long, text string, lang string, mask int, good boolean, A string").repartition(5)
    got = interactions.audited(docs, marked).collect()
    assert len(got) == 3 * 600
    assert {tuple(r) for r in got} == plain_interactions(rows, labels)
    known = [(r["doc_id"], r["text"], r["lang"]) for r in awkward.collect()]
    assert {tuple(r) for r in interactions.audited(awkward, marked).collect()} == plain_interactions(known, labels)
    assert interactions.audited(nothing, marked).count() == 0
    assert {tuple(r) for r in interactions.audited(awkward, marked.where("false")).collect()} == plain_interactions(known, [])
