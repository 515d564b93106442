"""Licence and secret scans."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from snapweave.llm import licenses, secrets

DATA = "/root/testdata/sf0.01"


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def test_base_phrases(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(9000, None), (9001, ""), (9002, "CC-BY cc by; all rights. reserved ALL RIGHTS RESERVED general public licenseé"), (9003, "by cc"), (9004, "cc " * 50 + "by")], "doc_id long, text string")
    rows = rows.union(odd)
    texts = {r.doc_id: r.text for r in rows.collect()}
    seen = 0
    for r in licenses.scanned(rows).collect():
        w = words(texts[r.doc_id])
        places, labels = [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            hits = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            places += hits
            if hits:
                labels.add(label)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(",")) or not labels
        assert 0 <= r.score <= 1
        seen += len(places)
        for needle, label in (("Released under the MIT License.", "mit"), ("Apache License, Version 2.0.", "apache-2.0"), ("General Public License, version 3.", "gpl-3.0"), ("CC BY-NC 4.0.", "cc-by-nc-4.0")):
            assert (needle in (texts[r.doc_id] or "")) == (label in r.labels.split(",")), (r.doc_id, needle)
    assert seen > 10


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert licenses.scanned(none).collect() == []
    assert secrets.candidates(none).collect() == []


def test_forest_on_held_out_findings(spark):
    every = secrets.labelled(spark, 3000).withColumn("i", F.monotonically_increasing_id())
    model = secrets.train(every.where("i % 4 <> 0").drop("i"))
    held = model.transform(secrets.features(every.where("i % 4 = 0").drop("i"))).select("label", "prediction").collect()
    assert sum(r.label == r.prediction for r in held) / len(held) > 0.97


def test_planted_secrets(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {(r.doc_id, r.value_sha256) for r in secrets.op9_secrets(spark, DATA).collect()}
    import hashlib

    wanted = {(r.doc_id, hashlib.sha256(v.encode()).hexdigest()) for r in rows.collect() for v in re.findall(r'(?:token = "|password=)([0-9a-f]+)', r.text)}
    assert wanted and wanted <= got
    assert len(got) <= len(wanted) * 1.05


def test_many_licences_in_one_file():
    """Labels and score beside a comparison at every alignment of every template."""
    line = "Released under the MIT License"
    notices = [text for _, text, _ in licenses.TEMPLATES]
    ordinary = "purpose charge person forms conditions extent documentation redistribution modification provided permitted binary associated copyright domain author"
    files = [
        "\n".join(notices),
        f"{ordinary}\n{line}",
        f"{line.replace('the', 'a b the')} and later {ordinary} {line}",
        "license mit released " * 30 + line,
        " ".join(notices[1].split()[::-1]),
    ]
    # words of the line are common in the corpus, the ordinary ones rare
    index = licenses.Index({w: 400 for w in (b"released", b"under", b"the", b"mit", b"license")}, 1000)
    for text in files:
        w = licenses.split(text)
        in_row = lambda p: any(w[i : i + len(p)] == p for i in range(len(w)))  # noqa: E731, B023
        labels, score = set(), 0.0
        for t, total in zip(index.templates, index.total, strict=True):
            if t.base:
                got = float(in_row(t.words))
            else:
                got = max(index.compare(w, t, total, start) for start in range(-len(t.words), len(w))) / total if all(map(in_row, t.keys)) else 0.0
            if got >= licenses.ACCEPT:
                labels.add(t.label)
                score = max(score, min(got, 1.0))
        assert index.scan(text)[5:] == (",".join(sorted(labels)), score)
    assert index.scan(files[0])[5].split(",") == sorted({label for label, _, _ in licenses.TEMPLATES} | {"gpl", "cc-by"})
    assert index.scan(files[1])[5] == "mit"


def test_whole_texts_and_more_templates(spark):
    """Edited copies of whole licences among other words, repeated, null and very long rows, and a template that a caller adds."""
    rnd = __import__("random").Random(8)
    whole = {label: text for label, text, _ in licenses.TEMPLATES if len(text) > 300}
    rows = [(i, " ".join(rnd.choice(["lorem", "the", "copy"]) for _ in range(rnd.randint(0, 50))) + ". " + text.replace(" warranty", "\nWARRANTY ", 1) + " 2024") for i, text in enumerate(whole.values())]
    rows += [(50, None), (51, ""), (0, rows[0][1]), (52, "word " * 100_000 + whole["zlib"] + " word" * 100_000), (53, "You may cook with this recipe and share the soup freely")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, labels string").repartition(3)
    more = (("soup", "you may cook with this recipe and share the soup freely", ("share the soup",)),)
    got = [(r.doc_id, r.labels) for r in licenses.scanned(docs, more).collect()]
    for i, label in enumerate(whole):
        assert all(label in labels.split(",") for doc, labels in got if doc == i)
    assert got.count((50, "")) == got.count((51, "")) == 1 and got.count((53, "soup")) == 1 and ("zlib" in dict(got)[52]) and len(got) == len(rows)


def test_secret_named_before_it_is_assigned(spark):
    value, inner = "9f8a7c6b5d4e3f2a1b0c9d8e7f6a", "abc123def456"
    text = f"é see commit {value} for an example, then token = \"{value}\" and /x/{inner} or password={inner}"
    docs = spark.createDataFrame([(1, text, "src0"), (None, text, "src0")], "doc_id long, text string, source string")
    assert {(r.value, r.start) for r in secrets.candidates(docs).collect()} == {(value, text.index(value)), (value, text.rindex(value)), (f"/x/{inner}", text.index("/x/")), (inner, text.rindex(inner))}
    got = {(r.doc_id, r.value): r for r in secrets.scored(docs, secrets.train(secrets.labelled(spark))).collect()}
    for doc in (1, None):
        assert got[doc, value].start == text.rindex(value) and got[doc, value].occurrences == 2 and got[doc, value].score >= secrets.KEPT_FROM
        assert got[doc, inner].start == text.rindex(inner) and got[doc, inner].occurrences == 1


def test_every_feature_varies_on_both_sides(spark):
    """Also the path: no feature of the labelled findings is constant, and the path doesn't tell the label."""
    rows = secrets.features(secrets.labelled(spark)).collect()
    for name in secrets.FEATURES:
        assert len({r[name] for r in rows}) > 1, name
    share = lambda label: sum(r.path_against for r in rows if r.label == label) / sum(r.label == label for r in rows)
    assert 0.3 < share(1.0) < 0.7 and abs(share(0.0) - share(1.0)) < 0.1


def test_candidates_and_features_against_plain_code(spark):
    import regex

    rnd = __import__("random").Random(4)
    bits = ["abc123def456", "Password: ", "hunter_two", "token=", '"', "é", " ", "\n", "x" * 30 + "1", "/a/b/c9", "deadbeef00112233", "secret : 'Tr0ub4dor&3'", "pwd=short", "commit ", "12345678-aaaa-bbbb", "aB3", "=="]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25))) for _ in range(120)] + [None, "", "password=" + "a1" * 5000, "w " * 20000 + "token = zz99yy88xx77"]
    rows = [(i, t, rnd.choice(["tests/a.py", "src", None])) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[3], (None, *rows[5][1:])], "doc_id long, text string, source string").repartition(4)
    known = spark.createDataFrame([("hunter",), ("two",)], "word string")
    found = secrets.features(secrets.with_known_words(secrets.candidates(docs), known)).collect()
    pattern = regex.compile(secrets.CANDIDATE)
    wanted = []
    for doc, text, path in [*rows, rows[3], (None, *rows[5][1:])]:
        for m in pattern.finditer(text or ""):
            v, before, after = m[0], text[max(0, m.start() - secrets.NEAR) : m.start()], text[m.end() : m.end() + secrets.NEAR]
            parts = [p for p in re.split("[^a-z]+", re.sub("(?<=[a-z])(?=[A-Z])", " ", v).lower()) if p]
            wanted.append(
                (
                    doc, v, m.start(), before, after, float(len(v)), sum(c in "0123456789" for c in v) / len(v), sum("A" <= c <= "Z" for c in v) / len(v), len(set(v)) / len(v),
                    float(bool(re.fullmatch("[0-9a-f]+", v))), sum(len(p) for p in parts if p in ("hunter", "two")) / len(v), float(max(map(len, re.split("[^A-Za-z]+", v)))),
                    float(bool(re.search(secrets.PATHS_AGAINST, (path or "").lower()))), float(bool(re.search(secrets.FOR, before.lower()))), float(bool(re.search("[=:]\\s*[\"'`]?$", before))),
                )
            )
    got = [(r.doc_id, r.value, r.start, r.before, r.after, r.length, r.digit_share, r.upper_share, r.distinct_share, r.hexadecimal, r.known_words, r.longest_letters, r.path_against, r.near_for, r.assigned) for r in found]
    assert len(got) == len(wanted) and sorted(map(repr, got)) == sorted(map(repr, wanted))


def test_short_and_letters_only_secrets(spark):
    docs = spark.createDataFrame([(1, 'the password: "qzkvtrwpx" is set', "src"), (2, "password: important", "src"), (3, "pwd=Qx!7f2#a9 .", "src"), (4, "no token here: nothing", "src")], "doc_id long, text string, source string")
    words = spark.createDataFrame([("important",), ("nothing",)], "word string")
    got = {r.doc_id: r.score for r in secrets.scored(docs, secrets.train(secrets.labelled(spark)), words=words).collect()}
    assert got[1] >= secrets.KEPT_FROM and got[3] >= secrets.KEPT_FROM and got[2] < secrets.KEPT_FROM


def test_empty_null_and_long_secret_rows(spark):
    model = secrets.train(secrets.labelled(spark, 400))
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert secrets.scored(none, model, words=secrets.dictionary(none)).collect() == []
    odd = spark.createDataFrame([(None, None, None), (1, "", "x"), (1, "", "x")], "doc_id long, text string, source string")
    assert secrets.scored(odd, model).collect() == []


def test_dictionary_counts_documents(spark):
    docs = spark.createDataFrame([(1, "alpha beta, alpha alpha gamma."), (2, "alpha delta9 Beta"), (3, None), (4, "gamma (zeta) eta-x")], "doc_id long, text string")
    assert [r.word for r in secrets.dictionary(docs, 3).orderBy("word").collect()] == ["alpha", "beta", "gamma"]
