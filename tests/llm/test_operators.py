"""The operators on tables with nulls, empty and long texts, ties, repeated rows and clashing names, against brute force."""

from __future__ import annotations

import hashlib
import json
import random
from collections import defaultdict
from pathlib import Path

import pytest
import regex
from pyspark.sql import functions as F

from quillframe.llm import bpe, common, hostrules, langid, minhash, packing, quality, repeats, spotsigs, unigram, warc
from quillframe.llm.common import components
from tests.llm.conftest import prose
from tests.llm.test_units import best_split, thue_morse

WORD = regex.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width=5):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} - {()}


def brute_components(rows, percent):
    """``{id: component}`` by comparing all sets."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: find(i) for i in root}


def near_copies(n, seed):
    rng = random.Random(seed)
    bases = [prose(seed * 100 + k, rng.randrange(20, 120)).split() for k in range(n // 6)]
    out = []
    for k in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.randrange(5)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(9)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, percent, monkeypatch):
    monkeypatch.setattr(minhash, "LIST_BLOCK", 4)
    monkeypatch.setattr(minhash, "FAMILY_BLOCK", 300)
    rows = list(enumerate(near_copies(150, 3)))
    got = {r["doc_id"]: r for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()}
    want = brute_components(rows, percent)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["n_shingles"] == len(shingles(t)) and r["kept"] == (want[i] == i) for (i, t), r in zip(rows, (got[i] for i, _ in rows), strict=True))
    kept = minhash.keep_one(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, kept int"), percent)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


def test_one_family_of_a_third_of_all_rows(spark, monkeypatch):
    """Near copies of one text around a few hubs, with members that are linked through others only."""
    monkeypatch.setattr(minhash, "LIST_BLOCK", 8)
    monkeypatch.setattr(minhash, "FAMILY_BLOCK", 600)
    rng = random.Random(5)
    base = prose(900, 80).split()
    texts = [prose(k, rng.randrange(20, 80)) for k in range(120)]
    for _ in range(60):
        words = list(base)
        words[rng.randrange(len(words))] = f"new{rng.randrange(30)}"
        texts.append(" ".join(words))
    # A chain that drifts away from the family, one word at a time.
    words = list(base)
    for k in range(12):
        words[6 * k] = f"drift{k}"
        texts.append(" ".join(words))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    want = brute_components(rows, 85)
    assert max(sum(c == x for c in want.values()) for x in set(want.values())) >= 60
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_texts_that_share_a_template(spark, monkeypatch):
    """A template in most texts makes one family; only the near copies among them are compared, and all links are found."""
    monkeypatch.setattr(minhash, "FAMILY_BLOCK", 2000)
    rng = random.Random(4)
    common = [f"c{k}" for k in range(60)]
    texts = []
    for _ in range(150):
        words = [*common[:30], *(f"w{rng.randrange(10**6)}" for _ in range(24)), *common[30:]]
        texts.append(" ".join(words))
        if rng.random() < 0.2:
            words[rng.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
    rows = list(enumerate(rng.sample(texts, len(texts)) + near_copies(60, 2)))
    compared = []
    whole = minhash.grouped_links

    def counted(members, kind, bar):
        compared.append((kind, members.where("n_blocks > 1").count()))
        return whole(members, kind, bar)

    monkeypatch.setattr(minhash, "grouped_links", counted)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows, 85)
    # No large family is left to be compared block by block.
    assert [n for kind, n in compared if kind is minhash.Sets] == [0]


def test_near_duplicates_awkward(awkward, nothing):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    want = brute_components(rows, 85)
    found = minhash.near_duplicates(awkward).collect()
    assert len(found) == len(rows)
    assert all(r["component_id"] == want.get(r["doc_id"]) for r in found)
    assert all(r["kept"] for r in found if r["doc_id"] is None)
    stays = minhash.keep_one(awkward)
    assert stays.columns == awkward.columns
    ids = [r["doc_id"] for r in stays.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(want.values())) and ids.count(None) == 2
    assert minhash.near_duplicates(nothing).count() == 0 and minhash.keep_one(nothing).count() == 0


@pytest.mark.parametrize("piece", [20, 1 << 18])
def test_components_in_pieces(spark, monkeypatch, piece):
    """A long path, hubs, repeated edges, loops and nulls, in one piece and in many."""
    monkeypatch.setattr(common, "PIECE_EDGES", piece)
    path = [(k, k + 1) for k in range(200)]
    hub = [(500 + k, 499) for k in range(40)] * 2
    got = components(spark.createDataFrame([*path, *hub, (900, 900), (901, None)], "a long, b long").repartition(5)).collect()
    assert len(got) == 201 + 41
    assert {r["node"]: r["component"] for r in got} == {**{k: 0 for k in range(201)}, **{k: 499 for k in range(499, 540)}}


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(10, 40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3), (10, 11)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 10 for k in range(10, 41)} | {k: 100 for k in range(100, 140)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_warc(spark, nothing):
    big = "<p>" + "x" * 200 + "</p>"
    rows = [(3, "http://a/3", big), (1, "http://a/1", big), (2, None, "short"), (4, "http://a/4", "short"), (5, "u", None), (6, "u\nv", ""), (1, "http://a/1", big), (None, "n", big), (8, "é", "é" * 50), (9, "é", "é" * 50)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect()), key=str)
    first = defaultdict(list)
    for i, _, h in rows:
        if i is not None:
            first[h or ""].append(i)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        least = min(first[h or ""], default=None)
        again = len(raw) >= 100 and least is not None and i != least
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", least if again else None))
    assert got == sorted(want, key=str)
    assert warc.round_trip(pages.where("false")).count() == 0


def test_byte_bpe(awkward, nothing):
    rows = bpe.encode_and_decode(awkward)
    assert sorted(bytes(r["decoded"]) for r in rows.collect()) == sorted((r["text"] or "").encode() for r in awkward.collect())
    empty = hashlib.sha256(b"").hexdigest()
    assert any(r["n_tokens"] == 0 and r["ids_sha256"] == r["decoded_sha256"] == empty for r in bpe.digests(rows).collect())
    assert bpe.digests(bpe.encode_and_decode(nothing)).count() == 0


def test_quality(spark, awkward, nothing):
    rng = random.Random(1)
    docs = [(k, prose(k, 60) if k % 3 else (f"word{k} " * 60 if rng.random() < 0.5 else prose(k, 40).upper().replace(" ", "!! "))) for k in range(600)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k, _ in docs] + [(None, 1), (1, None)], "doc_id long, quality int")
    got = quality.scored(table, labels).collect()
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held) / len(held) >= 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    odd = quality.scored(awkward, labels).collect()
    assert len(odd) == awkward.count() and all(r["score"] is not None and r["held_out"] is not None for r in odd)
    assert quality.scored(nothing, labels.where("false")).count() == 0


def brute_measures(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = defaultdict(list)
    for k in range(len(words) - 4):
        seen[tuple(words[k : k + 5])].append(k)
    again = {k + d for at in seen.values() if len(at) > 1 for k in at for d in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)


def test_host_rules(awkward, nothing):
    want = sorted(((r["doc_id"], *brute_measures(r["text"] or "")) for r in awkward.collect()), key=str)
    found = hostrules.verdicts_of(awkward).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in found), key=str) == want
    assert all(r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) for r in found)
    assert not any(r["kept"] and r["base_failed"] for r in found)
    kept = hostrules.keep_good(awkward)
    assert kept.columns == awkward.columns and kept.count() == sum(r["kept"] for r in found)
    assert hostrules.verdicts_of(nothing).count() == 0 and hostrules.keep_good(nothing).count() == 0


def test_bad_hosts_are_judged_strictly(spark):
    """A text that fails the strict rules only stays on a good host and goes on a bad one."""
    middling = prose(7, 90) + " " + " ".join(f"a{k}#b{k}|" for k in range(10))
    rows = [(k, prose(k, 60), "good") for k in range(60)] + [(100 + k, "### " * 30, "bad") for k in range(60)] + [(500, middling, "good"), (501, middling, "bad")]
    got = {r["doc_id"]: r["kept"] for r in hostrules.verdicts_of(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0] and not got[100] and got[500] and not got[501]


def test_packing(awkward, nothing, monkeypatch):
    pieces = packing.packed(awkward, window=256, shard_tokens=900).collect()
    whole, sequences = defaultdict(int), defaultdict(list)
    for r in pieces:
        assert len(r["ids"]) == 4 * r["length"] > 0
        whole[r["doc_id"], r["doc_tokens"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for at in sequences.values():
        ends = [0]
        for offset, length in sorted(at):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 256
    rows = awkward.collect()
    from quillframe.llm.bpe import SpanEncoder, word_merges

    path = packing.public_tokenizers.path("word_bpe_49k.json")
    sizes = [len(x) for x in packing.token_ids([r["text"] or "" for r in rows], SpanEncoder(word_merges(path)))]
    want = defaultdict(int)
    for r, n in zip(rows, sizes, strict=True):
        want[r["doc_id"], n] += n
    assert whole == want
    assert packing.packed(nothing).count() == 0


def test_related_documents_share_windows_over_shards(spark):
    rng = random.Random(4)
    words = sorted(w[:-4] for w in json.loads(Path(packing.public_tokenizers.path("word_bpe_49k.json")).read_text())["model"]["vocab"] if regex.fullmatch("[a-z]{6,}</w>", w))
    rng.shuffle(words)
    groups = [words[12 * g : 12 * g + 12] for g in range(80)]
    common, stray = words[2000:2200], words[3000:3600]
    texts = [(6 * g + k, " ".join(rng.sample(groups[g], 8) + rng.choices(stray, k=4) + rng.choices(common, k=30))) for g in range(80) for k in range(6)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").orderBy(F.xxhash64("doc_id"))

    def together(shard_tokens: int) -> tuple[int, float]:
        windows = defaultdict(set)
        for r in packing.packed(docs, window=400, shard_tokens=shard_tokens).collect():
            windows[r["sequence_id"]].add(r["doc_id"])
        mates = {d for held in windows.values() for d in held for x in held if x != d and x // 6 == d // 6}
        return len({s >> 32 for s in windows}), len(mates) / len(texts)

    (one, whole), (many, dealt) = together(10**9), together(2500)
    assert one == 1 and many >= 6
    # By chance it would be fewer than one in ten.
    assert whole > 0.4 and dealt >= 0.95 * whole, (many, whole, dealt)


def test_unigram_counts(awkward, nothing):
    got = sorted(((r["doc_id"], r["n_words"]) for r in unigram.token_counts(awkward).collect()), key=str)
    assert got == sorted(((r["doc_id"], len(WORD.findall(r["text"] or ""))) for r in awkward.collect()), key=str)
    model = unigram.pieces(unigram.public_tokenizers.path("piece_bpe_32k.model"))
    for r in unigram.token_counts(awkward.where("doc_id in (3, 5, 12)")).join(awkward.select("doc_id", "text").distinct(), "doc_id").collect():
        assert r["n_tokens"] == sum(best_split(unigram.MARK + w, model) for w in WORD.findall(r["text"]))
    assert unigram.token_counts(nothing).count() == 0


def test_spotsigs(awkward, nothing):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in awkward.where("doc_id is not null").collect()), key=lambda r: (-r[0], [-ord(c) for c in r[1][:40]]))
    found = spotsigs.fingerprints(awkward.where("doc_id is not null")).collect()
    got = {(r["doc_id"], r["n_chars"]): r for r in found}
    for k, (i, text) in enumerate(rows):
        if sum(j == i for j, _ in rows) > 1:
            continue
        following = rows[(k + 1) % len(rows)][1]
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        assert got[i, len(text)]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in found)
    prints = defaultdict(set)
    for r in awkward.where("doc_id is not null").select("doc_id", "text").collect():
        prints[r["text"] or ""].add(got[r["doc_id"], len(r["text"] or "")]["fingerprint"])
    assert all(len(x) == 1 for x in prints.values())
    assert spotsigs.fingerprints(awkward).count() == awkward.count() and spotsigs.fingerprints(nothing).count() == 0


def test_spotsigs_pairs_against_all_pairs(spark):
    df = spark.createDataFrame(list(enumerate(near_copies(60, 5))), "doc_id long, text string")
    made = {r["doc_id"]: frozenset(r["s"]) for r in spotsigs.with_signatures(df, "text", "s").collect()}
    ids = {}
    for i in sorted(made):
        ids.setdefault(made[i], i)
    want = {(min(i, j), max(i, j)) for a, i in ids.items() for b, j in ids.items() if i != j and a and b and len(a & b) / len(a | b) >= 0.8}
    got = {(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in spotsigs.near_pairs(df).collect()}
    assert got == want


def brute_cuts(texts, length):
    at = defaultdict(int)
    for t in texts:
        for k in range(len(t) - length + 1):
            at[t[k : k + length]] += 1
    out = []
    for t in texts:
        gone = [False] * len(t)
        for k in range(len(t) - length + 1):
            if at[t[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("part,shape", [(512, repeats.Shape(20, 10, 2)), (2, repeats.Shape(20, 8, 4))])
def test_repeats(spark, part, shape, monkeypatch):
    """Near copies, periodic texts, copies, and texts in slices; with few contexts to a part, all ways are taken."""
    monkeypatch.setattr(repeats, "PART", part)
    monkeypatch.setattr(repeats, "SLICE", 64)
    rng = random.Random(4)
    base = "".join(rng.choice("abcdefgh ") for _ in range(300))
    docs = []
    for _ in range(40):
        t = list(base[rng.randrange(100) : rng.randrange(150, 300)])
        for _ in range(rng.randrange(6)):
            k = rng.randrange(len(t))
            t[k : k + 1] = rng.choice(["", "x", "yz"])
        docs.append("".join(t))
    docs += ["", None, "a" * 50, "ab" * 40, "z" * 19, "q" * 20, docs[0], docs[0], "é" * 30]
    df = spark.createDataFrame([(k if k % 9 else None, t, "x") for k, t in enumerate(docs)], "doc_id long, text string, id string")
    got = sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.digests(df, shape).collect())
    assert got == brute_cuts([(t or "").encode() for t in docs], 20)


def test_repeats_awkward(awkward, nothing):
    rows = awkward.collect()
    got = sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.digests(awkward).collect())
    assert got == brute_cuts([(r["text"] or "").encode() for r in rows], 200)
    out = repeats.without_repeats(awkward)
    assert out.columns == awkward.columns and out.count() == len(rows) and out.where("text is null").count() == 2
    assert repeats.digests(nothing).count() == 0 and repeats.without_repeats(nothing).count() == 0


def test_repeats_of_strings_that_are_built_alike(spark):
    one, other = thue_morse(1024)
    docs = [one, other, one[:300] + "x" * 250 + other[700:], thue_morse(4096)[0][1500:2100]]
    got = sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.digests(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect())
    assert got == brute_cuts([t.encode() for t in docs], 200)


def test_clashing_names(spark):
    """Columns named like the helpers' own stay as they are."""
    names = ["_gone_id", "_GONE_ID", "_cut_id", "_cut_fp", "_cut_spans", "_rule_n_words", "_rule_kept", "_lang_host", "_lang_likelihoods"]
    rows = [(k, prose(k % 7, 60), "en", f"s{k % 2}", *range(len(names) - 1)) for k in range(20)]
    names.remove("_GONE_ID")
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", *names])
    for stage in (minhash.keep_one, repeats.without_repeats, hostrules.keep_good, langid.keep_identified):
        out = stage(docs)
        assert out.columns == docs.columns
        assert out.count() and all([r[n] for n in names] == list(range(len(names))) for r in out.collect()), stage.__name__


def test_language(spark, awkward, nothing):
    english = "the man and the house of the people that he was with for all of his days".split()
    german = "der mann und das haus von den leuten die er mit allen seinen tagen nicht sah".split()
    rng = random.Random(2)
    text = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(k, text(english if k % 2 else german, 30), "en-GB" if k % 2 else "DE", f"http://h{k % 2}.example.{'uk' if k % 2 else 'de'}/x") for k in range(80)]
    rows += [(200, text(german, 30), "en", "http://h1.example.uk/x"), (201, "12 34 !!", "en", "http://h1.example.uk/x"), (202, None, None, None), (203, text(english, 4), None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, url string").withColumn("source", F.regexp_extract("url", "//([^/]+)", 1))
    got = {r["doc_id"]: r for r in langid.identified(df, langid.Columns(url="url")).collect()}
    assert all(got[k]["language"] == ("en" if k % 2 else "de") and got[k]["kept"] for k in range(80))
    # Text beats a wrong declaration; without letters nothing is kept.
    assert got[200]["language"] == "de" and got[200]["kept"]
    assert not got[201]["kept"] and not got[202]["kept"] and got[203]["language"] == "en"
    found = langid.identified(awkward)
    kept = langid.keep_identified(awkward)
    assert found.count() == awkward.count() and kept.columns == awkward.columns and kept.count() == found.where("kept").count()
    assert langid.identified(nothing).count() == 0 and langid.keep_identified(nothing).count() == 0


def test_rare_languages_are_kept(spark):
    rng = random.Random(6)
    common = {"en": "the man and house of people that he was with for all his days".split(), "de": "der mann und das haus von den leuten die er mit allen seinen tagen".split()}
    greek = "ο άνθρωπος και το σπίτι των ανθρώπων που ήταν με όλες τις μέρες του".split()
    rows = [(k, " ".join(rng.choices(common[lang], k=8)), lang, lang) for k in range(9000) for lang in [("en", "de")[k % 2]]]
    # 0.07 % of the rows, and single rows.
    rows += [(9000 + k, " ".join(rng.choices(greek, k=12)), "el", "en") for k in range(6)]
    rows += [(9100, "კაცი და სახლი ხალხის რომელიც იყო ყველა დღეს", "ka", "en"), (9101, "12 34 !!", "kk", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in langid.identified(df).where("doc_id >= 9000").collect()}
    assert all(got[k]["language"] == "el" and got[k]["kept"] for k in range(9000, 9006))
    kept = {r["doc_id"] for r in langid.keep_identified(df).select("doc_id").collect()}
    assert kept == set(range(9006)) | {9100}


def test_many_languages(spark):
    """200 languages, ten of them with one row in 10,000."""
    rng = random.Random(8)
    alphabet = [chr(c) for c in range(0x61, 0x7B)]
    words = {k: ["".join(rng.choices(alphabet, weights=[rng.random() ** 4 + 0.001 for _ in alphabet], k=rng.randrange(2, 8))) for _ in range(60)] for k in range(200)}
    tag = lambda k: alphabet[k // 26] + alphabet[k % 26]
    rows = [(k, k % 190) for k in range(9990)] + [(9990 + k, 190 + k) for k in range(10)]
    df = spark.createDataFrame([(i, " ".join(rng.choices(words[k], k=40)), tag(k), f"h{k % 30}.example.org") for i, k in rows], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in langid.identified(df).collect()}
    assert sum(got[i]["language"] == tag(k) and got[i]["kept"] for i, k in rows) >= 0.99 * len(rows)
    assert all(got[i]["kept"] for i, k in rows[9990:])
    assert langid.keep_identified(df).where("doc_id >= 9990").count() == 10


def test_pages_as_evidence(spark):
    page = '<!DOCTYPE html><html lang="de"><style>x{}</style><body><script>var s="</p>";</script><p>Haus &amp; Hof</p><!-- c --></body></html>'
    row = langid.from_pages(spark.createDataFrame([(1, "https://user@a.Example.de:8080/x", page), (2, None, None)], "page_id long, url string, html string")).orderBy("page_id").collect()
    assert row[0]["lang"] == "de" and row[0]["source"] == "a.Example.de" and "var" not in row[0]["text"] and "Hof" in row[0]["text"]
    assert row[1]["lang"] == "" and row[1]["text"] == ""


def test_next_documents_across_buckets(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "RUN", 2)
    ids = [-70, -3, 0, 1, 2, 5, 9, 31, 32, 33, 200, 1000, 1001]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    got = {r["doc_id"]: r["next_text"] for r in spotsigs.with_next(df, span=4).collect()}
    assert got == {i: f"t{ids[k - 1]}" for k, i in enumerate(ids)}
    one = spark.createDataFrame([(7, "only")], "doc_id long, text string")
    assert spotsigs.with_next(one).first()["next_text"] == "only"
