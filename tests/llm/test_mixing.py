"""Mixing against plain water-filling, and rows that aren't ordinary."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from snapweave.llm import mixing


def filled(size):
    """Targets of sources by size, by clamping one round after the other."""
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, target, open_ = 1.5 * sum(size.values()), {}, set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * size[s]}
        if not over:
            return target | {s: weight[s] * level for s in open_}
        target |= {s: 2.0 * size[s] for s in over}
        left -= sum(2.0 * size[s] for s in over)
        open_ -= over
    return target


def test_targets(spark):
    rnd = random.Random(2)
    for n in (1, 2, 7, 300):
        size = {f"s{i:03d}é"[: rnd.choice([4, 5])]: rnd.choice([0, 1, 50, rnd.randint(1, 10**6)]) for i in range(n)} | ({None: 77} if n > 2 else {})
        rows = [(s, part) for s, total in size.items() for part in (total // 3, total - total // 3)]
        got = {r.source: r for r in mixing.targets(spark.createDataFrame(rows, "source string, size long").repartition(5)).collect()}
        wanted = filled(size)
        assert set(got) == set(size) and all(abs(got[s].target - wanted[s]) < 1e-6 * max(1, wanted[s]) and got[s].source_size == size[s] for s in size)


def test_taken_words(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice([None, i, 5]), "word " * rnd.randint(0, 40), rnd.choice(["a", "b", "c", None])) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    got = mixing.mixed(docs, mixing.n_words("text")).collect()
    assert len(got) == len(rows)
    taken, target, size = {}, {}, {}
    for r in got:
        s = r.doc.source
        taken[s] = taken.get(s, 0) + r.taken
        target[s], size[s] = r.target, r.source_size
        assert 0 <= r.taken <= 2 * r.size
    assert all(abs(taken[s] - target[s]) <= 40 for s in taken)
    assert abs(sum(target.values()) - min(1.5, 2) * sum(size.values())) < 1e-3
    again = mixing.mixed(docs.repartition(3), mixing.n_words("text")).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_columns_of_any_name_pass_through(spark):
    names = ["size", "n", "_n", "_key", "_bucket", "_ratio", "_before", "_all", "_source", "docs", "target", "taken", "doc", "key", "place", "a.b", "source_size", "_range"]
    rows = [(i, "one two three four five " * 3, "s", *range(len(names))) for i in range(30)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "source", *names])
    got = mixing.repeated(docs)
    assert got.schema == docs.schema
    out = got.collect()
    assert sum(len(r.text.split()) for r in out) == round(1.5 * 30 * 15) and all(tuple(r)[3:] == tuple(range(len(names))) for r in out)


def test_odd_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.repeated(none).collect() == []
    rows = [(1, None, "s"), (2, "", "s"), (None, "a b", None), (None, "a b", None), (3, "w " * 200_000, "t"), (3, "w " * 200_000, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    total = mixing.mixed(docs, mixing.n_words("text")).agg(F.sum("taken"), F.max("target")).first()
    assert abs(total[0] - 1.5 * 800_004 / 2) < 5
    lone = mixing.mixed(docs.where("doc_id = 1"), mixing.n_words("text")).collect()
    assert [(r.size, r.target, r.taken) for r in lone] == [(0, 0.0, 0)]
