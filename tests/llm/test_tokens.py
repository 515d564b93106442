"""Token shards against a direct encoding, and the index against a dictionary."""

from __future__ import annotations

import os
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

from snapweave.llm import tokens
from snapweave.llm.common import new_folder

TEXTS = ["", None, " ", "a", "a  b", " lead", "tail ", "two words here", "tab\t x", "line\n next", "é ü ß 漢字 かな", "x" * 5000, "word " * 3000, "  nbsp   em", "a\r\n b", "1 2  3", "😀 😀"]


def direct():
    from tokenizers import Tokenizer

    path, end = tokens.production_tokenizer()
    model = Tokenizer.from_file(path)
    return lambda text: [*model.encode(text or "", add_special_tokens=False).ids, end]


@pytest.mark.parametrize("room", [0, 20, 400_000])
def test_encoder(monkeypatch, room):
    """Whatever is remembered, ids are those of whole texts."""
    monkeypatch.setattr(tokens, "REMEMBERED", room)
    path, end = tokens.production_tokenizer()
    encoder, one = tokens.Encoder(path), direct()
    texts = [t or "" for t in TEXTS]
    for _ in range(3):
        ids, each = encoder.encode(texts, end)
        at = np.r_[0, np.cumsum(each)]
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [one(t) for t in texts]
    assert [len(x) for x in encoder.encode([], end)] == [0, 0]


def made_index(keys, first, n):
    bits, sizes, value = tokens.build_index(keys.view(np.uint64))
    slots = np.zeros((len(keys), 3), np.uint32)
    slots[value] = np.stack([tokens.fingerprint(keys.view(np.uint64)), first, n], axis=1)
    return value, tokens.Index(bits.tobytes(), sizes.tobytes(), tokens.block_ranks(bits).tobytes(), slots.tobytes())


@pytest.mark.parametrize("size", [0, 1, 2, 63, 64, 65, 700, 5000])
def test_index(size):
    keys = np.unique(np.random.default_rng(1).integers(-(2**63), 2**63, size))
    value, index = made_index(keys, np.arange(len(keys)), np.ones(len(keys), int))
    assert sorted(value.tolist()) == list(range(len(keys)))
    first, n = index.find(keys)
    assert first.tolist() == list(range(len(keys))) and set(n.tolist()) <= {1}
    assert (index.find(keys[:50] + 1)[0] >= 0).sum() == 0


def test_the_index_decides_what_is_read():
    """A shard whose index gives two keys each other's places is read so."""
    keys, counts, ids = np.array([3, 5, 5, 9]), np.array([1, 2, 1, 4]), np.arange(8)
    right = tokens._shard(0, keys, counts, ids, 2)
    got = {(r["did"], r["at"], r["n_tokens"]) for b in tokens._read([right]) for r in b.to_pylist()}
    assert got == {(3, 0, 1), (5, 1, 2), (5, 3, 1), (9, 4, 4)}
    row = right.to_pylist()[0]
    slots = np.frombuffer(row["slots"], np.uint32).reshape(-1, 3).copy()
    one, other = (int(np.flatnonzero(slots[:, 1] == i)[0]) for i in (0, 3))
    slots[[one, other], 1] = slots[[other, one], 1]
    wrong = right.set_column(right.schema.get_field_index("slots"), "slots", __import__("pyarrow").array([slots.tobytes()]))
    got = {(r["did"], r["at"], r["n_tokens"]) for b in tokens._read([wrong]) for r in b.to_pylist()}
    assert got == {(3, 4, 4), (5, 1, 2), (5, 3, 1), (9, 0, 1)}


def test_round_trip(spark):
    rows = [(i * 7 - 20, t, "extra") for i, t in enumerate(TEXTS)] + [(1, "a", "x"), (1, "a", "y"), (None, "null key", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    one = direct()
    got = [tuple(r) for r in tokens.written(docs).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()]
    wanted, start = [], 0
    for key, text in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = one(text)
        wanted.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    same = [(k, n, c) for k, _, n, c in got]
    assert [x[0] for x in got] == [x[0] for x in wanted] and sorted(map(str, same)) == sorted(str((k, n, c)) for k, _, n, c in wanted)
    assert [x[1] for x in got] == np.r_[0, np.cumsum([x[2] for x in got])[:-1]].tolist()
    folder = new_folder(spark, "shards")
    tokens.write_shards(docs, folder, *tokens.production_tokenizer())
    found = {(r.doc_id, r.part): r.tokens for r in tokens.lookup(spark, folder, [1, -20, 9999]).collect()}
    assert found[(-20, 0)] == one("") and found[(1, 0)] == one("a") and len(found) == 1 + sum(r[0] == 1 for r in rows)


def test_empty_table(spark):
    assert tokens.written(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_encoding_starts_no_threads():
    """A task has one core: the tokenizer works in the worker's own thread."""
    code = """
import os
from snapweave.llm import tokens
path, end = tokens.production_tokenizer()
encoder = tokens.Encoder(path)
before = len(os.listdir("/proc/self/task"))
encoder.encode([f"word{i} other{i * 7}" for i in range(5000)], end)
print(len(os.listdir("/proc/self/task")) - before)
"""
    env = {k: v for k, v in os.environ.items() if k != "TOKENIZERS_PARALLELISM"} | {"RAYON_NUM_THREADS": "4"}
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env=env, cwd=Path(__file__).resolve().parents[2], check=True)
    assert done.stdout.split() == ["0"]
