"""Benchmark decontamination: short items inside long documents, by size-partitioned MinHash containment search.

An item is a set of shingles of five words (letters and digits, A-Z in lower case). Items are partitioned by size: those of 2 ** c
to 2 ** (c + 1) - 1 shingles are a partition, which has a signature and a threshold of its own. The signature of an item is its
least `signature` hashes: one more than an item of the partition may miss, at most SKETCH; a document is a candidate of an item
if it holds `need` of them. Where the signature isn't cut off, one is always held; else `need` is as large as a miss with a
probability of MISS at most allows. Jaccard bands over whole documents would find nothing here: a document of 20,000
words and an item of 40 share 0.2 %. So a document's shingles are looked up in the signatures of all partitions, and exact
containment of the full set decides on candidates.

Sets are built by tasks; the driver only puts partitions into blocks of about BLOCK_SHINGLES shingles. A block is sent to all executors
(about 16 bytes a shingle), and documents are read once for each block and never shuffled. Defined cases: an item of one to
four words is one shingle of that many words; an item or a document without words (or null) matches nothing; equal rows of the
benchmark count once; item_id may be of any type; rows alike in doc_id are judged one by one; a text of any length is one value and is
looked up whole; other columns pass through; an empty table on either side gives no matches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, steps, trimmed
from .kernels import BY_LETTER, LOWER, Sums, words

SHINGLE = 5
THRESHOLD = 0.8
SKETCH = 16
MISS = 1e-9
BLOCK_SHINGLES = 2_000_000


def signature(largest: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """Hashes in the signatures of a partition whose items have `largest` shingles at most, and how many a candidate holds."""
    full = int(np.floor((1 - threshold) * largest + 1e-9)) + 1
    if full <= SKETCH:
        return full, 1
    need, tail = 0, 0.0
    while tail <= MISS:
        tail += math.comb(SKETCH, need) * threshold**need * (1 - threshold) ** (SKETCH - need)
        need += 1
    return SKETCH, max(1, need - 1)


class Partition(NamedTuple):
    """Items of one size class and shingle length."""

    k: int
    need: int
    ids: pa.Array
    first: np.ndarray  # where each item's set begins, and the end of the last
    sets: np.ndarray
    sketch: np.ndarray  # signatures of all items, sorted
    item: np.ndarray  # whose it is

    def item_set(self, i: int) -> np.ndarray:
        return self.sets[self.first[i] : self.first[i + 1]]


class Block(NamedTuple):
    partitions: list[Partition]
    maybe: dict[int, np.ndarray]  # by shingle length: bits of all signatures by the top of the hash


def item_sets(benchmark: DataFrame) -> DataFrame:
    """(item_id, k, size_class, n, hashes): the sorted set of shingles of each item that has words."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in steps(batches):
            w = words(LOWER[data], off, BY_LETTER)
            sums, n_words = Sums(w.hash), np.diff(w.first)
            full = np.flatnonzero(n_words)
            ks = np.minimum(n_words[full], SHINGLE)
            grams = {k: sums.windows(k) for k in np.unique(ks).tolist()}
            sets = [np.unique(grams[k][w.first[i] : w.first[i + 1] - k + 1]) for i, k in zip(full.tolist(), ks.tolist(), strict=True)]
            n = np.array([len(x) for x in sets], np.int64)
            columns = [batch.column("item_id").take(pa.array(full)), pa.array(ks.astype(np.int32)), pa.array(np.array([int(x).bit_length() - 1 for x in n], np.int32)), pa.array(n), pa.array([x.tobytes() for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["item_id", "k", "size_class", "n", "hashes"])

    kind = benchmark.schema["item_id"].dataType.simpleString()
    return benchmark.select("item_id", F.col("text").cast("string").alias("text")).distinct().mapInArrow(build, f"item_id {kind}, k int, size_class int, n long, hashes binary")


def partition_of(rows: pa.Table, k: int, size_class: int, threshold: float = THRESHOLD) -> Partition:
    s, need = signature(2 ** (size_class + 1) - 1, threshold)
    n = rows.column("n").to_numpy()
    first = np.r_[0, np.cumsum(n)]
    sets = np.frombuffer(b"".join(rows.column("hashes").to_pylist()), np.uint64)
    own = np.minimum(n, s)
    item = np.repeat(np.arange(len(n)), own)
    sketch = sets[first[:-1][item] + np.arange(len(item)) - np.repeat(np.cumsum(own) - own, own)]  # sets are sorted and hashes random: the least are a sample
    order = np.argsort(sketch, kind="stable")
    return Partition(k, need, rows.column("item_id").combine_chunks(), first, sets, sketch[order], item[order])


def block_of(partitions: list[Partition]) -> Block:
    maybe: dict[int, np.ndarray] = {}
    for p in partitions:
        maybe.setdefault(p.k, np.zeros(1 << 20, bool))[(p.sketch >> np.uint64(44)).astype(np.int64)] = True
    return Block(partitions, maybe)


def matches(block: Block, data: np.ndarray, off: np.ndarray, threshold: float = THRESHOLD) -> Iterator[tuple[Partition, int, int, int]]:
    """(partition, number of the text, of the item, shared shingles) of all texts that hold `threshold` of an item."""
    w = words(LOWER[data], off, BY_LETTER)
    sums = Sums(w.hash)
    for k, maybe in block.maybe.items():
        grams = sums.windows(k)
        hit = np.flatnonzero(maybe[(grams >> np.uint64(44)).astype(np.int64)])
        doc = np.searchsorted(w.first, hit, side="right") - 1
        inside = hit + k <= w.first[doc + 1]
        hit, doc = hit[inside], doc[inside]
        # each shingle of a document counts once
        once = np.unique(np.stack([doc.astype(np.uint64), grams[hit]]), axis=1) if len(hit) else np.zeros((2, 0), np.uint64)
        doc, gram = once[0].astype(np.int64), once[1]
        last, own = -1, grams[:0]
        for p in block.partitions:
            if p.k != k:
                continue
            lo, hi = np.searchsorted(p.sketch, gram, side="left"), np.searchsorted(p.sketch, gram, side="right")
            n = hi - lo
            entry = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            pairs, held = np.unique(np.stack([np.repeat(doc, n), p.item[entry]]), axis=1, return_counts=True) if len(entry) else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
            for d, i in pairs.T[held >= p.need].tolist():
                if d != last:
                    last, own = d, np.unique(grams[w.first[d] : w.first[d + 1] - k + 1])
                full = p.item_set(i)
                at = np.minimum(np.searchsorted(own, full), len(own) - 1)
                shared = int((own[at] == full).sum())
                if shared >= threshold * len(full) - 1e-9:
                    yield p, d, i, shared


def blocks(benchmark: DataFrame, block_shingles: int = BLOCK_SHINGLES) -> Iterator[Block]:
    """The benchmark's partitions, in blocks of about block_shingles; a larger partition is several."""
    items = cut(item_sets(benchmark))
    sizes = items.groupBy("k", "size_class").agg(F.sum("n").alias("n")).orderBy("k", "size_class").collect()  # five times 40 rows at most
    plan: list[list[tuple[int, int, int, int]]] = []
    room = 0
    for r in sizes:
        parts = -(-r.n // block_shingles)
        for part in range(parts):
            if not plan or room < r.n // parts:
                plan.append([])
                room = block_shingles
            plan[-1].append((r.k, r.size_class, part, parts))
            room -= r.n // parts
    for members in plan:
        held = []
        for k, size_class, part, parts in members:
            rows = items.where((F.col("k") == k) & (F.col("size_class") == size_class) & (F.pmod(F.xxhash64("hashes"), F.lit(parts)) == part)).toArrow()
            if rows.num_rows:
                held.append(partition_of(rows, k, size_class))
        yield block_of(held)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_shingles, n_shared, containment of each document that holds an item."""
    kind = benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id long, item_id {kind}, n_shingles long, n_shared long, containment double"
    out = docs.sparkSession.createDataFrame([], schema)
    for n, block in enumerate(blocks(benchmark)):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch, data, off in steps(batches):
                found = list(matches(sent.value, data, off))
                if found:
                    size = [len(p.item_set(i)) for p, _, i, _ in found]
                    shared = [x for _, _, _, x in found]
                    ids = pa.concat_arrays([p.ids.slice(i, 1) for p, _, i, _ in found])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array([d for _, d, _, _ in found])), ids, pa.array(size, pa.int64()), pa.array(shared, pa.int64()), pa.array([x / y for x, y in zip(shared, size, strict=True)])],
                        names=["doc_id", "item_id", "n_shingles", "n_shared", "containment"],
                    )

        part = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(search, schema)
        out = out.unionByName(part) if n else part
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold an item; nothing is shuffled, and blocks follow each other in one pass."""
    for block in blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def clean(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch, data, off in steps(batches):
                keep = np.ones(batch.num_rows, bool)
                keep[[d for _, d, _, _ in matches(sent.value, data, off)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(lambda batches, clean=clean: trimmed(clean(batches)), docs.schema)
    return docs


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
