"""The operators' cores against plain versions, without Spark."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillframe.llm import bpe, hostrules, langid, packing, pretokens, quality, unigram, warc
from quillframe.llm.lyndon import suffix_arrays
from quillframe.llm.common import forest, unused
from quillframe.llm.minhash import Sets, matches_needed
from quillframe.llm.repeats import merged
from quillframe.llm.wordhash import shingle_set, span_hashes, word_hashes

ODD = [
    "", " ", "  a", "a  b\n\n c", "it's I'LL don't 'S 's'll", "'re're've''s ''", "a1b22c ³½ 12.5%", "日本語 中文", "é café", "x y z​ 　q",
    "İı ΣαΣ Straße", "\U0001d518\U0001d52b \U0001f600\U0001f600!!??", "\x00\x01a\x7f", "<|endoftext|> x", "ſ 's 'ſ", "a" * 3000, "\t\n\r\n  ", "ab" * 700 + " " * 300 + "z",
]
TEXTS = st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=60), min_size=1, max_size=5)


@pytest.fixture(scope="module")
def ranks():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    import base64

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return path, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def encoded(texts, path):
    merges, _, _ = bpe.rank_merges(path)
    data, starts, ends, per_text = pretokens.split_gapless(texts)
    ids, counts = bpe.SpanEncoder(merges)(data, starts, ends)
    edge = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(per_text)])]
    return [ids[a:z].tolist() for a, z in zip(edge[:-1], edge[1:], strict=True)]


def test_byte_bpe_as_tiktoken(ranks):
    path, library = ranks
    assert encoded(ODD, path) == [library.encode_ordinary(t) for t in ODD]


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_byte_bpe_any_text(texts):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    _, alphabet, offsets = bpe.rank_merges(path)
    for text, ids in zip(texts, encoded(texts, path), strict=True):
        assert b"".join(alphabet[offsets[i] : offsets[i + 1]].tobytes() for i in ids) == text.encode()
        spans = regex.findall(public_tokenizers.PATTERN, text)
        assert sum(len(s) for s in spans) == len(text)


@settings(max_examples=80, deadline=None)
@given(TEXTS)
def test_pretokens_as_pattern(texts):
    data, starts, ends, per_text = pretokens.split_gapless(texts)
    raw = data.tobytes()
    want = [m for t in texts for m in regex.findall(public_tokenizers.PATTERN, t)]
    assert [raw[a:z].decode() for a, z in zip(starts, ends, strict=True)] == want
    assert per_text.tolist() == [len(regex.findall(public_tokenizers.PATTERN, t)) for t in texts]


def test_word_ids_as_tokenizers():
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    got = packing.token_ids(ODD, bpe.SpanEncoder(bpe.word_merges(path)))
    assert [g.tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids + [1] for t in ODD]


@pytest.mark.parametrize("letters", [1, 2, 3, 50])
def test_suffix_arrays(letters):
    rng = np.random.default_rng(letters)
    strings = [rng.integers(0, letters, n) for n in (0, 1, 2, 5, 30, 31, 64)] + [np.tile([0, 1], 20), np.zeros(40, int), np.tile([1, 0, 1], 9)]
    edges = np.concatenate([[0], np.cumsum([len(s) for s in strings])])
    flat = np.concatenate(strings).astype(int)
    want = [i for a, z in zip(edges[:-1], edges[1:], strict=True) for i in sorted(range(a, z), key=lambda i: tuple(flat[i:z]))]
    assert suffix_arrays(flat, edges).tolist() == want
    assert suffix_arrays(np.zeros(0, int), np.array([0])).tolist() == []


def test_merged_spans():
    spans = np.array([0 << 32 | 5, 2 << 32 | 4, 5 << 32 | 6, 8 << 32 | 9])
    start, end = merged(spans)
    assert (start.tolist(), end.tolist()) == ([0, 8], [6, 9])


def test_shingles():
    words = "The the quick  Brown fox\x0bjumps".encode()
    assert len(word_hashes(words)) == 6 and len(shingle_set(words)) == 2
    assert len(shingle_set(b"a b")) == 1 and len(shingle_set(b" \n")) == 0 and len(shingle_set(None)) == 0
    assert (shingle_set(b"A B c") == shingle_set(b"a\tb\nC")).all()


def test_linked_rows_against_all_pairs():
    rng = random.Random(1)
    base = list(range(40))
    sets = [np.array(sorted(set(base) - set(rng.sample(base, rng.randrange(9))) | set(rng.sample(range(100, 140), rng.randrange(6)))), np.uint64) for _ in range(40)]
    items = Sets([s.tobytes() for s in sets], 85)
    got = {frozenset((i, int(j))) for i in range(40) for j in items.linked(i)}
    want = {frozenset((i, j)) for i in range(40) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))}
    assert got == want


def test_forest_asks_few_of_a_group_that_hangs_together():
    rng = random.Random(3)
    # One large part around a hub, a chain that leads out of it, and two small parts.
    links = {(0, k) for k in range(1, 300)} | {(k, k + 1) for k in range(250, 320)} | {(330, 331), (340, 341)}
    links |= {(a, b) for a in range(200) for b in range(a) if rng.random() < 0.5}
    near = {k: np.array(sorted({b for a, b in links if a == k} | {a for a, b in links if b == k}), int) for k in range(360)}
    asked = []

    def linked(i):
        asked.append(i)
        return near[i]

    root = list(range(360))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for edges in (forest(360, linked), links):
        before, root = root, list(range(360))
        for a, b in edges:
            root[max(find(a), find(b))] = min(find(a), find(b))
        root = [find(i) for i in range(360)]
    assert before == root and len(set(asked)) == len(asked) < 120
    assert forest(1, lambda i: np.zeros(0, int)) == []


def test_unused_names():
    assert unused(["a", "_Gone_id", "__gone_"], "gone_") == "___gone_"


def thue_morse(n: int) -> tuple[str, str]:
    """A string of n letters and its complement, which cancel out in polynomial hashes modulo 2**64."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [64, 1024, 4096])
def test_hashes_of_strings_that_are_built_alike(ranks, n):
    path, library = ranks
    one, other = thue_morse(n)
    data = np.frombuffer((one + other).encode(), np.uint8)
    hashes = span_hashes(data, np.array([0, n]), np.array([n, 2 * n]))
    assert hashes[0] != hashes[1]
    assert encoded([one + " " + other, other], path) == [library.encode_ordinary(t) for t in (one + " " + other, other)]
    assert dict(zip(hostrules.MEASURES, hostrules.measures([f"{one}\n{other}\n{one}".encode()])[0].tolist(), strict=True))["n_dup_lines"] == 1
    words = [f"{x}{k}" for x in (one, other) for k in range(3)]
    assert len(shingle_set(" ".join(words[:5]).encode()) | shingle_set(" ".join(words[1:]).encode())) == 1
    assert shingle_set(one.encode()) != shingle_set(other.encode())


def test_byte_bpe_tells_spans_of_equal_hashes_apart(ranks, monkeypatch):
    from quillframe.llm import wordhash

    path, library = ranks
    real = wordhash.span_hashes
    monkeypatch.setattr(wordhash, "span_hashes", lambda data, a, z, seed=0: real(data, a, z, seed) & np.uint64(1) if seed == 0 else real(data, a, z, seed))
    assert encoded(ODD, path) == [library.encode_ordinary(t) for t in ODD]


def test_long_runs_in_little_time(ranks):
    path, library = ranks
    texts = ["x" * 60_000, "".join(random.Random(1).choices("abcdefg", k=40_000))]
    assert encoded(texts, path) == [library.encode_ordinary(t) for t in texts]


def test_prior_of_hosts():
    # Hosts of one document each: their rates differ by chance only.
    mean, strength = hostrules.prior(1000, 1000, 300, 300.0, 1000)
    assert mean == 0.3 and strength > 500
    mean, strength = hostrules.prior(2, 200, 100, 90**2 / 100 + 10**2 / 100, 2 * 100**2)
    assert mean == 0.5 and 1 <= strength < 2
    assert hostrules.prior(0, 0, 0, 0, 0) == (0.0, 1e4)


def test_matches_needed_leaves_few_misses():
    assert 1 <= matches_needed(32, 0.8) <= matches_needed(32, 0.85) <= 32


def test_measures():
    text = "a b c d e\na b c d e\n\n#x|\n"
    assert dict(zip(hostrules.MEASURES, hostrules.measures([text.encode()])[0].tolist(), strict=True)) == {"n_words": 11, "word_chars": 13, "n_symbols": 2, "n_lines": 3, "n_dup_lines": 1, "n_repeat_words": 10, "n_shouted": 0}
    assert hostrules.measures([b"", "é éé".encode(), b"\n", b"a"])[:, :2].tolist() == [[0, 0], [2, 3], [0, 0], [1, 1]]
    assert hostrules.measures([]).shape == (0, 7) and not hostrules.measures([b""]).any()


def test_unigram_counts_on_shared_prefixes():
    model = unigram.pieces(public_tokenizers.path("piece_bpe_32k.model"))
    words = ["▁the", "▁then", "▁thenceforth", "▁", "▁日本", "▁zzzzqqq", "▁" + "ab" * 60, "▁" + "ab" * 59 + "cd", "▁" + "ab" * 59 + "cdthen", "▁" + "日本語" * 40]
    for widest in (2, 48, 200):
        assert unigram.count_distinct(words, model, widest).tolist() == [best_split(w, model) for w in words]


def best_split(word, model):
    """Fewest tokens of the best segmentation, by trying every last piece of every prefix."""
    best = {0: (0.0, 0)}
    for end in range(1, len(word) + 1):
        n = len(word[end - 1].encode())
        ways = [(best[end - 1][0] + n * model.byte, -best[end - 1][1] - n)]
        ways += [(best[a][0] + model.scores[word[a:end]], -best[a][1] - 1) for a in range(end) if word[a:end] in model.scores]
        score, tokens = max(ways)
        best[end] = (score, -tokens)
    return best[len(word)][1]


def test_warc_round_trip_of_one_stream():
    made = [warc.record(k, f"http://a b/{k}\n", f"<p>{k}</p>\r\n\r\n".encode() * (k + 1), "response", "d", None) for k in range(5)]
    made.append(warc.record(None, None, b"x", "revisit", "d", 0))
    import gzip

    whole = gzip.compress(b"".join(made))
    for size in (1, 7, 1 << 16):
        chunks = (whole[a : a + size] for a in range(0, len(whole), size))
        assert list(warc.records(warc.inflated(chunks))) == made
    members = b"".join(gzip.compress(r) for r in made) + b"\0" * 9
    assert list(warc.records(warc.inflated(iter([members])))) == made
    fields, block = warc.headers(made[2])
    assert fields["warc-target-uri"] == "http://a%20b/2%0A" and block.endswith(b"<p>2</p>\r\n\r\n" * 3)
    assert warc.page_of(warc.headers(made[5])[0]["warc-record-id"]) is None
    with pytest.raises(ValueError):
        list(warc.records(iter([made[0][:-9]])))
    # A cut trailer, or anything less, is an error; nothing at all is an empty archive.
    for missing in (1, 8, len(whole) // 2):
        with pytest.raises(ValueError):
            list(warc.inflated(iter([whole[:-missing]])))
    assert list(warc.inflated(iter([]))) == list(warc.inflated(iter([b"\0" * 5]))) == []


def test_trigrams_and_model():
    bucket, n = langid.trigrams([b"", b"12 34!", b"ab", "été".encode()])
    assert n.tolist()[:2] == [0, 0] and n[2] > 0 and len(bucket) == n.sum()
    counts = np.zeros((2, langid.BUCKETS))
    np.add.at(counts[0], langid.trigrams([b"the and of the and of"])[0], 1)
    np.add.at(counts[1], langid.trigrams([b"der und die der und die"])[0], 1)
    likelihoods, _ = langid.Model(["en", "de"], counts).likelihoods([b"the of and", b"und die der", b"xqzj wvkq"])
    assert likelihoods.argmax(axis=1).tolist() == [0, 1, 2]


def test_network_learns_and_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 6)).astype(np.float32)
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    net = quality.trained(x[:1000], y[:1000])
    assert ((net.score(x[1000:]) >= 0.5) == y[1000:]).mean() > 0.85
    assert quality.trained(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]
    assert quality.trained(x[:5], np.ones(5)).score(x[:1])[0] > 0.5


def test_pooling_of_empty_texts():
    vectors = np.ones((2 * quality.BUCKETS, quality.WIDTH), np.float32)
    out = quality.pooled([b"", b" ", b"a b"], vectors)
    assert (out[:2] == 0).all() and out[2].any()


def test_fill_uses_every_id_once():
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 50, n).astype("<u2") for n in rng.integers(1, 64, 300)]
    lengths = np.array([len(d) for d in docs])
    windows = list(packing.fill(lengths, packing.Index(docs, np.ones(1 << 16), lengths.mean()), 64))
    held = sorted((d, s, n) for w in windows for d, s, n in w)
    for k, n in enumerate(lengths):
        mine = [(s, z) for d, s, z in held if d == k]
        assert [s for s, _ in mine] == list(np.cumsum([0, *(z for _, z in mine)])[:-1]) and sum(z for _, z in mine) == n
    assert all(sum(n for _, _, n in w) == 64 for w in windows[:-1])


def test_neighbours_share_words():
    docs = [np.array([1, 2, 3], "<u2"), np.array([7, 8, 9], "<u2"), np.array([1, 2, 4], "<u2")]
    scores = packing.Index(docs, np.ones(1 << 16), 3.0).scores(0)
    assert scores[2] > scores[1] == 0


def test_digest_of_ids(ranks):
    path, library = ranks
    ids = np.array(library.encode_ordinary("hello world"), "<u4")
    assert hashlib.sha256(ids.tobytes()).hexdigest() == hashlib.sha256(np.array(encoded(["hello world"], path)[0], "<u4").tobytes()).hexdigest()


def test_a_worker_keeps_the_words_of_earlier_tasks():
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = packing.word_encoder(path)
    first = [x.tolist() for x in packing.token_ids(ODD, encoder)]
    held = len(encoder.one)
    assert held and packing.word_encoder(path) is encoder
    again = [x.tolist() for x in packing.token_ids(ODD, packing.word_encoder(path))]
    assert again == first == [x.tolist() for x in packing.token_ids(ODD, bpe.SpanEncoder(bpe.word_merges(path)))]
    assert len(encoder.one) == held
