"""Quality rules against plain code, and rows that aren't ordinary."""

from __future__ import annotations

import random
import re

from snapweave.llm import quality

NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop", "n_pipes", "n_stutters", "n_shouts")


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(8)}
    return (
        len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(lines),
        sum(x.lower() in quality.STOP_WORDS for x in w), text.count("|"), sum(a == b for a, b in zip(w, w[1:])), sum(x.endswith("!!") for x in w),
    )


def made(seed):
    rnd = random.Random(seed)
    few = ["the", "DE", "wow!!", "a|b", "x#", "é", "日本", "und", "  ", "\t", "\n", "\n\n", "word", "FÜR", "\x0b"]
    texts = [" ".join(rnd.choice(few) for _ in range(rnd.randint(0, 60))) for _ in range(80)]
    texts += ["one two three four five six seven eight " * 4, "line a\nline a\nline b", "", None, " \n ", "w" * 50_000, "a b c d e f g h i " * 9000]
    return texts


def test_measures_against_plain_code(spark):
    texts = made(1)
    rows = quality.judged(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).select("doc.doc_id", "m.*", "base_failed", "kept").collect()
    for r in rows:
        if len(texts[r.doc_id] or "") < 100_000:
            assert tuple(r[n] for n in NAMES) == plain(texts[r.doc_id]), texts[r.doc_id]
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and (r.kept is False or not r.base_failed)
    assert len(rows) == len(texts) and next(r for r in rows if r.doc_id == len(texts) - 1).n_repeat_words == 81_000


def test_columns_of_any_name_pass_through(spark):
    names = ["m", "kept", "doc", "t", "w", "l", "n", "h", "g", "s", "r", "row", "some", "base_failed", "_t", "a.b", "n_words", "did", "_"]
    text = "these are the words of a plain and quite ordinary sentence that has more than twenty words in it for the test of columns and of names"
    docs = spark.createDataFrame([(1, text, *range(len(names))), (1, text, *range(len(names))), (2, "short", *range(len(names)))], ["doc_id", "text", *names])
    got = quality.filtered(docs)
    assert got.schema == docs.schema and [tuple(r) for r in got.collect()] == [(1, text, *range(len(names)))] * 2


def test_empty_table(spark):
    assert quality.filtered(spark.createDataFrame([], "doc_id long, text string, m int")).collect() == []
