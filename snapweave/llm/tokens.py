"""Token-id output: shards of raw ids with a minimal perfect hash index over document keys.

Documents are dealt by ranges of doc_id, sorted, encoded and written as shards, one row of a Parquet file each:

    shard        number; shards in order hold documents in order
    first, last  least and greatest doc_id in it
    n_docs, n_tokens
    width        bytes of one id in payload (2 if the vocabulary allows it, else 4)
    keys         int64 doc_id of each document, in order
    ends         uint64 number of ids up to the end of each document
    bits, sizes  the hash: levels of bit sets in uint64 words, and uint32 sizes of the levels
    ranks        uint32 bits that are set before each block of BLOCK words, so that a look-up counts one block
    slots        uint32 triples (fingerprint, number of the first document, documents in a row) by hash value
    payload      raw little-endian ids of all documents

Spark's writer commits whole files, so a lost executor leaves no part of a shard. A null text has only the end id. A null
doc_id sorts first, under the key NULL_ID. Rows that share a doc_id stand in a row, in the order of a hash of their text; a
key gives all of them. An empty table has no shards.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import doc_id, identified, kept, new_folder, partitions, small_batches, steps, trim, trimmed
from .kernels import mixed

SHARD_TOKENS = 1 << 19
SHARD_DOCS = 1 << 15
#: Bytes of text encoded at a time.
STEP_BYTES = 1 << 20
#: Pieces of text whose ids a Python worker remembers: the first it meets, and so the frequent ones.
REMEMBERED = 500_000
_SPACES = re.compile(r"\s ")
#: Words of a block whose bits are counted together.
BLOCK = 8
_LEVEL = 0x9E3779B97F4A7C15
_MARK = np.uint64(0xC2B2AE3D27D4EB4F)

SHARD_SCHEMA = "shard long, first long, last long, n_docs long, n_tokens long, width int, keys binary, ends binary, bits binary, sizes binary, ranks binary, slots binary, payload binary"


# --- the index


def _pick(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """The bit of each key on a level."""
    return (mixed(keys + np.uint64(_LEVEL * (level + 1) % 2**64)) % np.uint64(size)).astype(np.int64)


def build_index(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A minimal perfect hash of distinct uint64 keys: packed bits of all levels, sizes of the levels, value of each key.

    On each level the keys that are left pick a bit; those alone at theirs set it, the others go to the next level. A key's
    value is the number of bits set before its own.
    """
    levels, left, where, before = [], np.arange(len(keys)), np.zeros(len(keys), np.int64), 0
    while len(left):
        size = max(64, -(-2 * len(left) // 64) * 64)
        at = _pick(keys[left], len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        placed = alone[at]
        where[left[placed]] = before + at[placed]
        levels.append(alone)
        before += size
        left = left[~placed]
    bits = np.concatenate(levels) if levels else np.zeros(0, bool)
    packed = np.packbits(np.r_[bits, np.zeros(-len(bits) % (64 * BLOCK), bool)], bitorder="little").view(np.uint64)
    return packed, np.array([len(x) for x in levels], np.uint32), (np.cumsum(bits) - 1)[where] if len(keys) else where


def block_ranks(packed: np.ndarray) -> np.ndarray:
    each = np.bitwise_count(packed).reshape(-1, BLOCK).sum(axis=1)
    return (np.cumsum(each) - each).astype(np.uint32)


class Index:
    """Finds keys in a shard. Opening reads nothing; a key costs a bit on each level that it meets, and one block to count."""

    def __init__(self, bits: bytes, sizes: bytes, ranks: bytes, slots: bytes):
        self.sizes = np.frombuffer(sizes, np.uint32)
        self.bits = np.frombuffer(bits, np.uint64)
        self.ranks = np.frombuffer(ranks, np.uint32)
        self.slots = np.frombuffer(slots, np.uint32).reshape(-1, 3)

    def _rank(self, at: np.ndarray) -> np.ndarray:
        """How many bits are set before each."""
        block, inside = at // (64 * BLOCK), at % (64 * BLOCK)
        words = self.bits[block[:, None] * BLOCK + np.arange(BLOCK)]
        room = np.clip(inside[:, None] - 64 * np.arange(BLOCK), 0, 64)
        mask = np.where(room == 64, np.uint64(2**64 - 1), (np.uint64(1) << (room & 63).astype(np.uint64)) - np.uint64(1))
        return self.ranks[block].astype(np.int64) + np.bitwise_count(words & mask).sum(axis=1)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each int64 key the number of its first document, -1 if it isn't there, and how many it has."""
        keys = keys.astype(np.int64).view(np.uint64)
        slot, open_, before = np.full(len(keys), -1), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            if not len(open_):
                break
            at = before + _pick(keys[open_], level, size)
            hit = (self.bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            slot[open_[hit]] = self._rank(at[hit])
            open_, before = open_[~hit], before + size
        if not len(self.slots):
            return slot, np.zeros(len(keys), np.int64)
        found = self.slots[np.minimum(slot, len(self.slots) - 1)]
        there = (slot >= 0) & (found[:, 0] == fingerprint(keys))
        return np.where(there, found[:, 1].astype(np.int64), -1), np.where(there, found[:, 2].astype(np.int64), 0)


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys ^ _MARK) >> np.uint64(32)).astype(np.uint32)


# --- encoding


class Encoder:
    """Ids of texts. Text is cut where a single space follows a character that is no white space: byte-level
    pre-tokenizers always cut there, so pieces are encoded once and remembered. Other texts are encoded whole."""

    def __init__(self, path: str, room: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads of its own would cost more than they save
        from tokenizers import Tokenizer

        self.room = REMEMBERED if room is None else room
        self.tokenizer = Tokenizer.from_file(path)
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        names = self.tokenizer.get_vocab()
        self.width = 2 if max(names.values()) < 1 << 16 else 4
        self.bytes_of = np.zeros(max(names.values()) + 1, np.int64)
        for name, i in names.items():
            self.bytes_of[i] = len(name.encode()) if name in special else len(name)
        self.code: dict = {}  # numbers of pieces that are remembered; (text,) for the first piece of a text
        self.kept = self.used = self.n = 0
        self.start, self.size, self.pool = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.uint32)

    def _add(self, ids: np.ndarray, ends: np.ndarray) -> int:
        """Put pieces whose ids end at ends into the pool; the number of the first."""
        first = self.n
        while first + len(ends) > len(self.start):
            self.start, self.size = np.resize(self.start, 2 * len(self.start)), np.resize(self.size, 2 * len(self.size))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.pool[self.used : self.used + len(ids)] = ids
        begins = np.r_[0, ends[:-1]]
        self.start[first : first + len(ends)], self.size[first : first + len(ends)] = self.used + begins, ends - begins
        self.used += len(ids)
        self.n += len(ends)
        return first

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate(ids), np.cumsum([len(x) for x in ids])

    def _learn(self, pieces: list, texts: list[str]) -> dict:
        """Encode pieces and some whole texts; their numbers. Pieces are remembered if there is room."""
        spaced, others = [p for p in pieces if isinstance(p, str)], [p for p in pieces if not isinstance(p, str)]
        found: dict = {}
        for at in range(0, len(spaced), 4096):
            some = spaced[at : at + 4096]
            ids, _ = self._each([" " + " ".join(some[i : i + 256]) for i in range(0, len(some), 256)])
            reach, wanted = np.cumsum(self.bytes_of[ids]), np.cumsum([1 + len(p.encode()) for p in some])
            ends = np.searchsorted(reach, wanted)
            if ends[-1] >= len(ids) or (reach[ends] != wanted).any():
                ids, ends = self._each([" " + p for p in some])
                ends = ends - 1
            n = self._add(ids, ends + 1)
            found.update(zip(some, range(n, n + len(some)), strict=True))
        if others:
            n = self._add(*self._each([p[0] for p in others]))
            found.update(zip(others, range(n, n + len(others)), strict=True))
        if len(self.code) + len(found) <= self.room:
            self.code.update(found)
            self.kept = (self.n, self.used)
        if texts:
            n = self._add(*self._each(texts))
            found.update(((None, i), n + i) for i in range(len(texts)))
        return found

    @staticmethod
    def _plain(text: str) -> bool:
        """Each space follows a character that is no white space, and the last character is none."""
        if text[-1:].isspace() or "  " in text:
            return False
        if text.isascii():
            return not any(x in text for x in ("\n ", "\t ", "\r ", "\x0b ", "\x0c ", "\x1c ", "\x1d ", "\x1e ", "\x1f "))
        return _SPACES.search(text) is None

    def encode(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids with `end` after each text, and how many each text has."""
        if not self.n:
            self._add(np.array([end], np.uint32), np.array([1]))
            self.kept = (self.n, self.used)
            self.code[()] = 0  # the end of a text
        whole = [i for i, text in enumerate(texts) if not self._plain(text)]
        odd = set(whole)
        column = pa.array([("" if i in odd else text) for i, text in enumerate(texts)] if whole else texts, pa.string())
        lists = pc.split_pattern(column, " ")
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        # each different piece is looked up once, however often it stands here
        coded = lists.flatten().dictionary_encode()
        pieces, index = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        begin = np.cumsum(counts) - counts
        later = np.ones(len(index), bool)
        later[begin] = False
        firsts: list = [(pieces[k],) for k in index[begin].tolist()]
        for n, i in enumerate(whole):
            firsts[i] = (None, n)
        code = np.fromiter(map(self.code.get, pieces, repeat(-1)), np.int64, len(pieces))
        first = np.fromiter(map(self.code.get, firsts, repeat(-1)), np.int64, len(firsts))
        used = np.bincount(index[later], minlength=len(pieces)) > 0
        new, new_first = np.flatnonzero((code < 0) & used), np.flatnonzero(first < 0)
        if len(new) or len(new_first):
            open_ = [pieces[k] for k in new.tolist()]
            found = self._learn([*open_, *{firsts[i] for i in new_first.tolist() if firsts[i][0] is not None}], [texts[i] for i in whole])
            code[new] = [found[p] for p in open_]
            first[new_first] = [found[firsts[i]] for i in new_first.tolist()]
        # pieces of all texts in a row, and the end of each text (number 0) after it
        every = np.zeros(len(index) + len(counts), np.int64)
        place = np.arange(len(index)) + np.repeat(np.arange(len(counts)), counts)
        every[place] = code[index]
        every[place[begin]] = first
        size = self.size[every].astype(np.int64)
        reach = np.cumsum(size)
        ids = self.pool[np.repeat(self.start[every] - reach + size, size) + np.arange(reach[-1])] if len(every) else np.zeros(0, np.uint32)
        ends = reach[np.cumsum(counts + 1) - 1] if len(counts) else np.zeros(0, np.int64)
        self.n, self.used = self.kept  # what isn't remembered goes
        return ids, np.diff(np.r_[0, ends])


def encoder(path: str, room: int) -> Encoder:
    """One for each Python worker, with what it remembers."""
    return kept(("encoder", path, room), lambda: Encoder(path, room))


def _shard(number: int, keys: np.ndarray, counts: np.ndarray, ids: np.ndarray, width: int) -> pa.RecordBatch:
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    distinct = keys[first].view(np.uint64)
    bits, sizes, value = build_index(distinct)
    slots = np.zeros((len(first), 3), np.uint32)
    slots[value] = np.stack([fingerprint(distinct), first, np.diff(np.r_[first, len(keys)])], axis=1)
    row = [number, int(keys.min()), int(keys.max()), len(keys), len(ids), width, keys.tobytes(), np.cumsum(counts).astype(np.uint64).tobytes(), bits.tobytes(), sizes.tobytes(), block_ranks(bits).tobytes(), slots.tobytes(), ids.astype(f"<u{width}").tobytes()]
    names = [f.split()[0] for f in SHARD_SCHEMA.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.int32()] + [pa.binary()] * 7
    return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=names)


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end: int, room: int = REMEMBERED) -> None:
    """Encode the text of docs and write shards to folder (a place that Spark can write)."""
    spark = docs.sparkSession
    small_batches(spark)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(tokenizer, room)
        number = TaskContext.get().partitionId() << 24
        keys, counts, ids, held, n = [], [], [], 0, 0
        for batch, _, _ in steps(batches, limit=STEP_BYTES):
            got, each = enc.encode(batch.column("text").to_pylist(), end)
            keys.append(batch.column("did").to_numpy(zero_copy_only=False).astype(np.int64))
            counts.append(each)
            ids.append(got.astype(f"<u{enc.width}"))
            held, n = held + len(got), n + len(each)
            if held >= SHARD_TOKENS or n >= SHARD_DOCS:
                yield _shard(number, np.concatenate(keys), np.concatenate(counts), np.concatenate(ids), enc.width)
                keys, counts, ids, held, n, number = [], [], [], 0, 0, number + 1
                trim()
        if n:
            yield _shard(number, np.concatenate(keys), np.concatenate(counts), np.concatenate(ids), enc.width)

    dealt = identified(docs).repartitionByRange(partitions(spark), "did", "rid").sortWithinPartitions("did", "rid").select("did", "text")
    dealt.mapInArrow(lambda batches: trimmed(encode(batches)), SHARD_SCHEMA).write.parquet(folder)


def _opened(row: dict) -> tuple[Index, np.ndarray, np.ndarray, np.ndarray]:
    """A shard's index, the doc_id of each document in it, where each begins (and the last ends), and all ids."""
    ends = np.frombuffer(row["ends"], np.uint64).astype(np.int64)
    return Index(row["bits"], row["sizes"], row["ranks"], row["slots"]), np.frombuffer(row["keys"], np.int64), np.r_[0, ends], np.frombuffer(row["payload"], f"<u{row['width']}")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every document by its key: the index says where the documents of a key stand, and how many there are."""
    for batch in batches:
        for row in batch.to_pylist():
            index, keys, edges, ids = _opened(row)
            asked = np.unique(keys)
            first, n = index.find(asked)
            number = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())  # the documents of each key in a row
            if (first < 0).any() or len(number) != len(keys):
                raise ValueError(f"shard {row['shard']}: its index doesn't hold its keys")
            begins, ends = edges[number], edges[number + 1]
            crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(begins, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(number), row["shard"])), pa.array(np.repeat(asked, n)), pa.array(begins), pa.array(ends - begins), pa.array(crc, pa.int64())], names=["shard", "did", "at", "n_tokens", "ids_crc32"])


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Of each document in the shards: doc_id, start (ids before it), n_tokens, ids_crc32, shard."""
    # ids before each shard: sums within blocks of shards, on top of sums of blocks
    shards = spark.read.parquet(folder).select("shard", "n_tokens", F.shiftright("shard", 24).alias("block"))
    blocks = shards.groupBy("block").agg(F.sum("n_tokens").alias("n"))
    before = blocks.select("block", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("block").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = shards.select("shard", "block", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("in_block")).join(before, "block").select("shard", (F.col("base") + F.col("in_block")).alias("base"))
    rows = spark.read.parquet(folder).select("shard", "width", "keys", "ends", "bits", "sizes", "ranks", "slots", "payload").mapInArrow(lambda batches: trimmed(_read(batches)), "shard long, did long, at long, n_tokens long, ids_crc32 long")
    return rows.join(base, "shard").select(doc_id(), (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "shard")


def lookup(spark: SparkSession, folder: str, ids: list[int]) -> DataFrame:
    """(doc_id, part, tokens) of some documents: only shards whose range may hold one are opened, and probed by their index.

    A fingerprint may be that of another key (once in 2**32), so a hit is held against the keys.
    """
    wanted = np.array(sorted(set(ids)), np.int64)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, last = (batch.column(c).to_numpy() for c in ("first", "last"))
            yield batch.select(["shard"]).filter(pa.array(np.searchsorted(wanted, first) < np.searchsorted(wanted, last, side="right")))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                index, keys, edges, tokens = _opened(row)
                first, n = index.find(wanted)
                hits = [(k, i - f, tokens[edges[i] : edges[i + 1]].astype(np.int64).tolist()) for k, f, m in zip(wanted.tolist(), first.tolist(), n.tolist(), strict=True) if f >= 0 and keys[f] == k for i in range(f, f + m)]
                if hits:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*hits, strict=True), (pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)], names=["doc_id", "part", "tokens"])

    shards = spark.read.parquet(folder)
    some = shards.select("shard", "first", "last").mapInArrow(near, "shard long")
    return shards.join(some, "shard", "left_semi").mapInArrow(probe, "doc_id long, part long, tokens array<long>")


def production_tokenizer() -> tuple[str, int]:
    """Path of the tokenizer's file and the id that ends a document."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), 2


def written(docs: DataFrame, room: int = REMEMBERED) -> DataFrame:
    """Write shards of docs to a new folder beside the checkpoints, and read them back. Workers remember `room` pieces."""
    spark = docs.sparkSession
    folder = new_folder(spark, "tokens")
    write_shards(docs, folder, *production_tokenizer(), room)
    return read_documents(spark, folder)


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
