"""The pipeline, stage by stage, against brute force."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from snapweave.llm import near as near_module
from snapweave.llm import tokens

from .test_near import brute as brute_components

DATA = "/root/testdata/sf0.001"


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def leaks(text, items):
    letters = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    own = shingles(letters(text))
    return any(s and len(s & own) >= 0.8 * len(s) for s in (shingles(letters(t)) for t in items))


def mix(rows):
    """rows (doc_id, source, text) to (doc_id, text) by the contract's water-filling and this library's buckets."""
    size = {d: len(plain_words(t)) for d, _, t in rows}
    total = Counter()
    docs = Counter()
    for d, s, _ in rows:
        total[s] += size[d]
        docs[s] += 1
    order = sorted(total)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(total.values()), set(order)
    while True:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * total[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
        open_ -= over
    target |= {s: weight[s] * level for s in open_}
    out, buckets = [], {}
    for d, s, t in rows:
        key = hashlib.md5(f"20240229:{d}".encode()).hexdigest()
        buckets.setdefault((s, int(key[24:], 16) % -(-docs[s] // 256)), []).append((key, d, t))
    for (s, _), members in buckets.items():
        ratio = target[s] / total[s]
        quota = int((ratio - int(ratio)) * sum(size[d] for _, d, _ in members) + 0.5)
        for _, d, t in sorted(members):
            extra = max(0, min(quota, size[d]))
            quota -= size[d]
            out += [(d, t)] * (int(ratio) + (extra == size[d]))
            if 0 < extra < size[d]:
                out.append((d, " ".join(plain_words(t)[:extra])))
    return sorted(out)


def test_stages(spark):
    source = spark.read.parquet(f"{DATA}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    docs, seen = source, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == source.columns and dict(docs.dtypes) == dict(source.dtypes)
        seen[name] = docs.collect()
    good = {r.doc_id: r for r in seen["quality_rules"]}
    assert 0 < len(good) < source.count()
    near = brute_components([(d, r.text) for d, r in good.items()], 5, 80)
    roots = {d for d, _, root in near if d == root}
    assert {r.doc_id for r in seen["near_dedup"]} == roots and len(seen["near_dedup"]) == len(roots)
    clean = [good[d] for d in sorted(roots) if not leaks(good[d].text, items)]
    assert {r.doc_id for r in seen["decontamination"]} == {r.doc_id for r in clean} and len(clean) < len(roots)
    mixed = mix([(r.doc_id, r.source, r.text) for r in clean])
    assert sorted((r.doc_id, r.text) for r in seen["mixing"]) == mixed

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.production_tokenizer()[0])
    wanted = Counter()
    for d, t in mixed:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        wanted[d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    out = sorted(corpus_pipeline.run(spark, DATA).collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == wanted
    at = 0
    for a in out:
        assert a.start == at
        at += a.n_tokens
    assert [a.doc_id for a in out] == sorted(a.doc_id for a in out)


def test_empty_corpus(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    assert docs.collect() == []


def test_near_dedup_stage_keeps_size_estimates_short(spark, monkeypatch):
    """No table between steps of the stage has a size estimate beyond a long: the driver holds them, and loops multiply them."""
    cut, seen = near_module.cut, []
    monkeypatch.setattr(near_module, "cut", lambda df: seen.append(cut(df)) or seen[-1])
    words = [f"w{i}" for i in range(400)]
    docs = spark.createDataFrame([(i, " ".join(words[3 * i : 3 * i + 100])) for i in range(60)], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, DATA).collect()] == [0]
    assert len(seen) > 10
    assert all(x._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 2**63 for x in seen)
