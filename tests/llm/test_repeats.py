"""Substring and suffix dedup against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from snapweave.llm import substring, suffix

DATA = "/root/testdata/sf0.001"


def brute_words(rows, window):
    seen, texts = {}, []
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        texts.append((doc, words))
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            seen[key] = min(seen.get(key, doc), doc)
    out = []
    for doc, words in texts:
        gone = set()
        for i in range(len(words) - window + 1):
            if seen[tuple(words[i : i + window])] < doc:
                gone.update(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def brute_bytes(rows, window):
    count = {}
    for _, text in rows:
        raw = (text or "").encode()
        for i in range(len(raw) - window + 1):
            count[raw[i : i + window]] = count.get(raw[i : i + window], 0) + 1
    out = []
    for doc, text in rows:
        raw = (text or "").encode()
        gone = set()
        for i in range(len(raw) - window + 1):
            if count[raw[i : i + window]] > 1:
                gone.update(range(i, i + window))
        spans = sum(1 for i in gone if i - 1 not in gone)
        kept = bytes(b for i, b in enumerate(raw) if i not in gone)
        out.append((doc, len(raw), len(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(rnd.choice([3, 40, 400]))] + ["é", "日本", " x"]
    make = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    passages = [make(rnd.randint(5, 60)) for _ in range(6)]
    rows = []
    for i in range(60):
        words = make(rnd.randint(0, 40))
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            words += p[rnd.randint(0, 5) :] + make(rnd.randint(0, 9))
        rows.append((i * 3, rnd.choice([" ", "\n", " \t "]).join(words)))
    rows += [(400 + i, rows[7][1]) for i in range(20)]
    rows += [(500, None), (501, ""), (502, "   "), (503, "a " * 300), (504, "b a " * 100), (505, "ab" * 400), (600, rows[9][1]), (600, rows[9][1]), (600, rows[11][1] + " x")]
    return rows


@pytest.mark.parametrize(("seed", "hot"), [(1, 1024), (2, 1024), (3, 2), (4, 0)])
def test_words_against_brute_force(spark, seed, hot):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(tuple(r) for r in substring.deduplicated(docs, 7, hot).collect())
    assert got == brute_words(rows, 7)


@pytest.mark.parametrize(("seed", "hot"), [(1, 1024), (2, 1024), (3, 2), (4, 0)])
def test_bytes_against_brute_force(spark, seed, hot):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(tuple(r) for r in suffix.deduplicated(docs, 30, hot).collect())
    assert got == brute_bytes(rows, 30)


def test_production_windows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(tuple(r) for r in substring.op2_substring_dedup(spark, DATA).collect()) == brute_words(rows, 50)
    assert sorted(tuple(r) for r in suffix.op5_suffix_dedup(spark, DATA).collect()) == brute_bytes(rows, 400)


def test_empty_null_and_extra_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert substring.deduplicated(none).collect() == [] and suffix.deduplicated(none).collect() == []
    rows = spark.createDataFrame([(None, "a b c d e f g h", 1), (1, "a b c d e f g h", 2)], "doc_id long, text string, did int")
    got = {r.doc_id: r.n_removed for r in substring.deduplicated(rows, 7).collect()}
    assert got == {None: 0, 1: 8}


def test_maximal_repeats_have_all_places(spark):
    text = "the quick brown fox jumps over it"
    docs = spark.createDataFrame([(1, "AA" + text + "BB"), (2, "CC" + text + "DD"), (3, "EE" + text)], "doc_id long, text string")
    rows = [r for r in suffix.maximal_repeats(docs, 30).collect()]
    assert {r.doc_id for r in rows} == {1, 2, 3}
    longest = [r for r in rows if r.length == len(text)]
    assert {(r.doc_id, r.start) for r in longest} == {(1, 2), (2, 2), (3, 2)}


def test_long_repeats_are_whole(spark):
    """Repeats of many tiles, one within the other's places, also with every anchor hot."""
    rnd = random.Random(5)
    letters = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    long, short = letters(900), letters(200)
    parts = {1: "X" + long + "Y", 2: letters(50) + long + "Z", 3: "V" + short + "W", 4: short, 5: letters(9) + short + "U"}
    docs = spark.createDataFrame(list(parts.items()), "doc_id long, text string")
    for hot in (256, 0):
        rows = suffix.maximal_repeats(docs, 30, hot).collect()
        groups = {(r["repeat"], r.length): set() for r in rows}
        for r in rows:
            groups[r["repeat"], r.length].add((r.doc_id, r.start))
        assert sorted((k[1], sorted(v)) for k, v in groups.items()) == [(200, [(3, 1), (4, 0), (5, 9)]), (900, [(1, 1), (2, 50)])]


@pytest.mark.parametrize("window", [1, 2, 5, 8, 16, 50])
def test_matching_of_other_documents(window):
    """The index finds every place of every window, also of patterns that it doesn't hold, and symbols that it doesn't know."""
    import numpy as np

    rnd = random.Random(window)
    held = [np.array([rnd.randint(1, 4) for _ in range(rnd.randint(1, 90))], np.uint64) for _ in range(12)]
    asked = [np.array([rnd.choice([1, 2, 3, 4, 9 if rnd.random() < 0.05 else 1]) for _ in range(rnd.randint(1, 60))], np.uint64) for _ in range(6)] + [held[3][2:], np.r_[np.uint64(7), held[5]]]
    index = substring.FMIndex(held, window)
    starts = {int(b): i for i, b in enumerate(index.begin)}
    got = {}
    for which, at, lo, hi in index.matching(asked):
        for i, p, a, b in zip(which.tolist(), at.tolist(), lo.tolist(), hi.tolist(), strict=True):
            places = set()
            for x in index.order[a:b].tolist():
                row = max(k for k in starts if k <= x)
                places.add((starts[row], x - row))
            got[i, p] = places
    wanted = {}
    for i, pattern in enumerate(asked):
        for p in range(len(pattern) - window + 1):
            places = {(r, o) for r, text in enumerate(held) for o in range(len(text) - window + 1) if (text[o : o + window] == pattern[p : p + window]).all()}
            if places:
                wanted[i, p] = places
    assert got == wanted


def test_a_damaged_index_changes_the_result():
    import numpy as np

    rnd = random.Random(1)
    segments = [np.array([rnd.randint(1, 9) for _ in range(60)], np.uint64) for _ in range(4)]
    segments.append(segments[0])
    index = substring.FMIndex(segments, 10)
    before = sum(len(h[0]) for h in index.matching(segments))
    bit, packed, counts, zeros = index.levels[-1]
    index.levels[-1] = (bit, np.zeros_like(packed), counts, zeros)
    assert before == sum(51 for _ in segments) and sum(len(h[0]) for h in index.matching(segments)) < before
