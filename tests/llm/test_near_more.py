"""Near-dedup under other partitions, column names and odd tables."""

from __future__ import annotations

import random

import pytest

from snapweave.llm import near
from snapweave.llm.common import identified

from .test_near import brute, made


@pytest.mark.parametrize("partitions", [2, 37])
def test_partitions_do_not_matter(spark, partitions):
    rows = made(7)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = sorted((r.did, r.n, r.component) for r in near.linked(identified(docs.repartition(partitions)), 3, 85).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == brute(rows, 3, 85)


def test_lots_do_not_matter(spark, monkeypatch):
    """Lots of a few rows cut every region: what the forest can't pair is joined exactly."""
    rows = made(8)
    monkeypatch.setattr(near, "LOT", 5)
    got = near.linked(identified(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)), 3, 85).collect()
    assert sorted((r.did, r.n, r.component) for r in got) == brute(rows, 3, 85)


def test_columns_of_any_name_pass_through(spark):
    names = ["_did", "did", "rid", "_rid", "again", "_again", "words", "doc", "set1", "n", "component", "a.b", "first", "key"]
    text = "one two three four five six seven eight"
    rows = [(1, text, *range(len(names))), (2, text, *range(len(names))), (3, "w " * 200_000, *range(len(names))), (3, "w " * 200_000, *range(len(names))), (4, None, *range(len(names)))]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *names])
    got = near.deduplicated(docs)
    assert got.schema == docs.schema
    out = got.collect()
    assert sorted(r.doc_id for r in out) == [1, 3, 4] and all(tuple(r)[2:] == tuple(range(len(names))) for r in out)


def test_long_chain_keeps_size_estimates_short(spark):
    """A chain of some twelve rounds: estimates of joined tables don't multiply from round to round, so the driver can hold them."""
    ids = list(range(200))
    random.Random(4).shuffle(ids)
    edges = spark.createDataFrame([(min(x, y), max(x, y)) for x, y in zip(ids, ids[1:], strict=False)], "a long, b long")
    labels = near.components(edges)
    assert {(r.node, r.component) for r in labels.collect()} == {(i, 0) for i in range(200)}
    assert labels._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 2**64
