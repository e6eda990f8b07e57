"""The pipeline against a plain version that applies the same rules one document at a time."""

from __future__ import annotations

from collections import defaultdict

import pytest

import corpus_pipeline
from quillframe.llm import repeats
from tests.llm.conftest import prose
from tests.llm.test_operators import brute_components, near_copies


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = [(k, t, "en", f"src{k % 4}", len(t)) for k, t in enumerate(near_copies(60, 9))]
    passage = prose(77, 60)
    rows += [(200 + k, prose(300 + k, 40) + " " + passage + " " + prose(400 + k, 40), "en", "src0", 1) for k in range(6)]
    rows += [(300, "### $$$ " * 40, "en", "src1", 1), (301, None, "en", "src1", None), (302, "12 34 " * 20, "en", "src2", 1), (303, "short", "en", "src2", 5)]
    path = tmp_path_factory.mktemp("docs")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = repeats.cut(stage(spark, docs, folder))
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert docs.columns == columns and after.keys() <= before.keys()
        seen.append((name, before, after))
    rules, language, near, suffix = seen
    assert not {300, 301, 303} & rules[2].keys() and 302 not in language[2]
    assert set(range(200, 206)) <= language[2].keys()
    assert sorted(near[2]) == sorted(set(brute_components(sorted(near[1].items()), 80).values()))
    # Each byte of a string of 200 bytes that starts elsewhere too is gone, and nothing else.
    at = defaultdict(int)
    raw = {i: t.encode() for i, t in suffix[1].items()}
    for t in raw.values():
        for k in range(len(t) - 199):
            at[t[k : k + 200]] += 1
    for i, t in raw.items():
        gone = {k + d for k in range(len(t) - 199) if at[t[k : k + 200]] > 1 for d in range(200)}
        assert suffix[2][i] == bytes(c for k, c in enumerate(t) if k not in gone).decode(errors="ignore")
    assert any(len(suffix[2][i]) < len(suffix[1][i]) for i in range(200, 206))
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())


def test_run(spark, folder):
    pieces = corpus_pipeline.run(spark, folder).collect()
    whole = defaultdict(int)
    for r in pieces:
        whole[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert pieces and all(n == total for (_, total), n in whole.items())
    assert not {300, 301, 302, 303} & {r["doc_id"] for r in pieces}
