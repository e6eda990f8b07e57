"""The folder for tables that are written in between."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from quillframe.sources.store import Store, scratch, written


def session(**conf):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d), set=conf.__setitem__))


def test_scratch(spark):
    assert scratch(session(**{"spark.checkpoint.dir": "hdfs://x/y/", "spark.master": "yarn"})) == "hdfs://x/y"
    local = session(**{"spark.master": "local[4]"})
    assert scratch(local).startswith("file:///") and scratch(local) == scratch(local)
    for master in ("yarn", "local-cluster[3,2,1024]", "spark://h:1"):
        with pytest.raises(ValueError):
            scratch(session(**{"spark.master": master}))
    # A session takes the name that is kept for it.
    spark.conf.set("quillframe.checkpoint.dir", "file:///tmp/x")
    spark.conf.unset("quillframe.checkpoint.dir")


def test_written_and_store(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    assert sorted(map(tuple, written(df).collect())) == [(1, "a"), (2, None)]
    store = Store(spark, str(tmp_path))
    assert store.names("none") == []
    store.publish("one.json", "{}")
    assert store.text("one.json") == "{}" and store.names() == [n for n in store.names() if n.endswith("one.json") or n.endswith(".crc")]
    with pytest.raises(Exception, match="exist"):
        store.publish("one.json", "[]")
    store.rename("one.json", "two.json")
    store.delete("two.json")
    assert "two.json" not in store.names()
