"""Near-dedup against exact comparison of all pairs."""

from __future__ import annotations

import random
import re

import pytest

from snapweave.llm import near
from snapweave.llm.common import identified

DATA = "/root/testdata/sf0.001"


def brute(rows, k, percent):
    sets = {}
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc] = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
                s = len(x & y)
                if 100 * s >= percent * (len(x) + len(y) - s):
                    p, q = sorted((find(a), find(b)))
                    root[q] = p
    return sorted((d, len(sets[d]), find(d)) for d in ids)


def made(seed):
    rnd = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(300)]
    rows, doc = [], 0
    for group in range(25):
        text = [rnd.choice(vocabulary) for _ in range(rnd.randint(1, 120))]
        for _ in range(rnd.choice([1, 2, 3, 60 if group == 3 else 2])):
            copy = list(text)
            for _ in range(rnd.randint(0, max(1, len(text) // 40))):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            rows.append((doc, " ".join(copy) if rnd.random() < 0.5 else "\n".join(copy).lower()))
            doc += rnd.randint(1, 3)
    rnd.shuffle(rows)
    return [*rows, (5000, None), (5001, ""), (5002, " "), (5003, "one two"), (5004, "ONE two"), (5005, "one")]


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rows = made(seed)
    got = near.linked(identified(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)), 3, 85).collect()
    assert sorted((r.did, r.n, r.component) for r in got) == brute(rows, 3, 85)


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = near.op8_near_dedup(spark, DATA).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 3, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_paths_and_empty(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (7, 7)], "a long, b long")
    assert {(r.node, r.component) for r in near.components(edges).collect()} == {(i, 0) for i in range(41)} | {(99, 99), (100, 99)}
    none = spark.createDataFrame([], "doc_id long, text string, did int")
    assert near.deduplicated(none).collect() == []
    same = spark.createDataFrame([(3, "a b c d e f", 1), (3, "a b c d e f", 2), (None, "x y", 3), (4, None, 4)], "doc_id long, text string, did int")
    kept = near.deduplicated(same).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["3", "4", "None"] and set(kept[0].asDict()) == {"doc_id", "text", "did"}


def test_crowd(spark):
    """Near copies far apart among thousands of mates on one template, whose likeness is just under the threshold."""
    rnd = random.Random(3)
    template = [f"t{i}" for i in range(110)]
    rows = [(doc, " ".join(template + [f"u{doc}x{i}" for i in range(10)])) for doc in range(700)]
    # one more word in common than mates: 109 of 127 shingles, where mates have 108 of 128
    rows += [(10**6 + 7919 * i % 10**5, " ".join(template + [f"u{i}x0"] + [f"v{i}x{j}" for j in range(9)])) for i in range(100)]
    rnd.shuffle(rows)
    got = near.linked(identified(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)), 3, 85).collect()
    assert sorted((r.did, r.n, r.component) for r in got) == brute(rows, 3, 85)
    assert sum(r.did != r.component for r in got) == 100


def test_ids_that_are_null_or_repeated(spark):
    """Only rows with an equal or linked set go, whatever their ids are."""
    text = lambda name: " ".join(f"{name}{i}" for i in range(40))
    rows = [(None, text("a")), (None, text("b")), (None, text("c")), (None, text("c")), (7, text("d")), (7, text("e")), (3, text("e")), (3, text("f")), (9, text("a") + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted((str(r.doc_id), r.text[0]) for r in near.deduplicated(docs).collect())
    assert kept == [("3", "e"), ("3", "f"), ("7", "d"), ("None", "a"), ("None", "b"), ("None", "c")]
