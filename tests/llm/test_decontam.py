"""Containment search against plain sets, over partitions and blocks."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from snapweave.llm import decontam


def shingles(text, k=None):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    k = k or min(5, len(w))
    return {(k, *w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()


def brute(docs, items):
    out = []
    for item, text in set(items):
        s = shingles(text)
        k = next(iter(s))[0] if s else 0
        for doc, t in docs:
            shared = len(s & shingles(t, k)) if s else 0
            if s and shared >= 0.8 * len(s) - 1e-9:
                out.append((doc, item, len(s), shared))
    return sorted(out, key=repr)


def corpus(seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)] + ["É", "A", "b"]
    make = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [(i, make(n)) for i, n in enumerate([1, 2, 4, 5, 6, 7, 8, 9, 12, 20, 31, 40, 90, 150, 400])]
    docs = []
    for doc in range(150):
        words = make(rnd.randint(0, 60))
        for _, item in rnd.sample(items, rnd.randint(0, 3)):
            copy = [rnd.choice(vocabulary) if rnd.random() < rnd.choice([0, 0.02, 0.05]) else x for x in item]
            words += copy[rnd.randint(0, len(copy) // 8) :] + make(rnd.randint(0, 20))
        docs.append((doc, rnd.choice([" ", ", ", "\n"]).join(words)))
    items = [(f"item {i}", " ".join(x)) for i, x in items] + [("none", None), ("empty", " ,; "), ("item 3", " ".join(items[3][1]))]
    docs += [(900, None), (901, ""), (902, "..."), (7, docs[7][1]), (None, items[9][1]), (903, "filler words " * 20_000 + items[12][1])]
    return docs, items


@pytest.mark.parametrize(("seed", "block"), [(1, 10**6), (2, 400)])
def test_against_plain_sets(spark, monkeypatch, seed, block):
    monkeypatch.setattr(decontam.blocks, "__defaults__", (block,))
    docs, items = corpus(seed)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    b = spark.createDataFrame(items, "item_id string, text string").repartition(3)
    got = decontam.leaks(d, b)
    rows = got.collect()
    assert got.schema["item_id"].dataType.simpleString() == "string"
    assert sorted(((r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in rows), key=repr) == brute(docs, items)
    left = decontam.decontaminated(d.select("*", F.lit(1).alias("item_id"), F.lit(2).alias("k")), b)
    gone = {x[0] for x in brute(docs, items)}
    assert left.columns == ["doc_id", "text", "item_id", "k"]
    assert sorted((r.doc_id for r in left.collect()), key=repr) == sorted((doc for doc, _ in docs if doc not in gone), key=repr)


def test_partitions_have_their_own_signature():
    assert [decontam.signature(2 ** (c + 1) - 1)[0] for c in range(8)] == [1, 1, 2, 4, 7, 13, 16, 16]
    assert decontam.signature(31) == (7, 1) and decontam.signature(255) == (16, 2)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "one two three four five six")], "doc_id long, text string")
    items = spark.createDataFrame([(4, "one two three four five six")], "item_id long, text string")
    assert decontam.leaks(docs.where("false"), items).collect() == []
    assert decontam.leaks(docs, items.where("false")).collect() == []
    assert decontam.decontaminated(docs, items.where("false")).count() == 1
    assert [r.item_id for r in decontam.leaks(docs, items).collect()] == [4]
