"""Suffix-array dedup over bytes: maximal repeats from the common-prefix interval tree of each shard.

A shard holds the different tiles of some anchors (see repeats.py). Its suffixes are sorted by prefix doubling; common
prefixes of neighbours come from the ranks of all doublings. A scan with a stack over neighbours that share `window` bytes
walks the tree of common-prefix intervals; an interval whose places differ in the byte before them (or begin a tile) can't be
extended to the left, so it is a maximal repeat, reported with all its places. Every repeated window lies in one.

Defined cases: a null or empty text has no bytes; each row is a document, also when rows repeat; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, doc_id, identified, steps
from .kernels import unions
from .repeats import HOT, Kind, Shard, covered, covers, repeated_tiles, searched, shards

BYTES = 400
_FIRST = 7  # symbols of 9 bits in one 64-bit key


def kind(window: int = BYTES) -> Kind:
    return Kind(window, False)


class SuffixArray:
    """Of byte strings, enhanced by common prefixes: suffixes of `window` bytes or more within their string."""

    def __init__(self, strings: list[np.ndarray], window: int):
        size = np.array([len(s) for s in strings])
        self.begin = np.r_[0, np.cumsum(size + 1)[:-1]]
        n = int(size.sum() + len(size))
        seq = np.zeros(n + _FIRST, np.int64)  # each string ends with a 0
        inside = np.zeros(n + _FIRST, bool)
        inside[np.repeat(self.begin - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())] = True
        seq[inside] = np.concatenate(strings).astype(np.int64) + 1
        self.seq = seq
        rest = np.repeat(self.begin + size, size + 1) - np.arange(n)  # bytes to the string's end
        key = np.zeros(n, np.int64)
        for i in range(_FIRST):
            key = (key << 9) | seq[i : n + i]
        self.ranks, h = [], _FIRST
        order = np.argsort(key)
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[False, np.diff(key[order]) != 0])
        self.ranks.append((h, rank))
        while h < size.max() and rank[order[-1]] < n - 1:
            after = np.zeros(n, np.int64)
            after[: max(0, n - h)] = rank[h:] + 1
            key = rank * (n + 2) + after
            order = np.argsort(key)
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.r_[False, np.diff(key[order]) != 0])
            h *= 2
            self.ranks.append((h, rank))
        self.at = order[rest[order] >= window]
        a, b = self.at[:-1], self.at[1:]
        self.lcp = np.r_[0, np.minimum(self._common(a, b, n), np.minimum(rest[a], rest[b]))] if len(self.at) else np.zeros(0, np.int64)
        self.left = np.where(self.at > 0, seq[self.at - 1], 0)

    def _common(self, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
        depth = np.zeros(len(a), np.int64)
        for h, rank in reversed(self.ranks):
            x, y = a + depth, b + depth
            safe = (x < n) & (y < n)
            same = np.zeros(len(a), bool)
            same[safe] = rank[x[safe]] == rank[y[safe]]
            depth[same] += h
        for _ in range(_FIRST - 1):
            x, y = np.minimum(a + depth, n), np.minimum(b + depth, n)
            going = (self.seq[x] == self.seq[y]) & (x < n) & (y < n)
            if not going.any():
                break
            depth[going] += 1
        return depth

    def maximal(self, window: int) -> Iterator[tuple[int, int, int]]:
        """(length, first, last) of the intervals of the tree that are maximal repeats of `window` bytes or more."""
        shared = self.lcp >= window
        differ = np.r_[0, np.cumsum((self.left[1:] != self.left[:-1]) | (self.left[1:] == 0) | (self.left[:-1] == 0))] if len(self.left) else self.left
        edges = np.flatnonzero(np.diff(np.r_[False, shared, False].astype(np.int8)))
        for a, b in zip(edges[::2] - 1, edges[1::2] - 1, strict=True):  # neighbours a..b share the window
            if differ[b] == differ[a]:
                continue
            stack: list[tuple[int, int]] = []
            depths = self.lcp[a + 1 : b + 1].tolist()
            for i, depth in enumerate([*depths, 0], a + 1):
                start = i - 1
                while stack and stack[-1][0] > depth:
                    length, start = stack.pop()
                    if differ[i - 1] > differ[start]:
                        yield length, start, i - 1
                if depth and (not stack or stack[-1][0] < depth):
                    stack.append((depth, start))

    def places(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """String and offset of each place of an interval."""
        at = self.at[first : last + 1]
        row = np.searchsorted(self.begin, at, side="right") - 1
        return row, at - self.begin[row]


def stretches(shard: Shard, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, off, len): stretches of a shard's tiles that are places of a maximal repeat; the longest at each place."""
    tree = SuffixArray(shard.units, window)
    reach = np.zeros(len(tree.at), np.int64)
    for length, first, last in tree.maximal(window):
        np.maximum(reach[first : last + 1], length, out=reach[first : last + 1])
    hit = np.flatnonzero(reach)
    row = np.searchsorted(tree.begin, tree.at[hit], side="right") - 1
    return row, tree.at[hit] - tree.begin[row], reach[hit]


def groups(shard: Shard, window: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(number, length, rows, offsets) of the maximal repeats of a shard, with all their places in its tiles."""
    tree = SuffixArray(shard.units, window)
    for i, (length, first, last) in enumerate(tree.maximal(window)):
        yield (i, length, *tree.places(first, last))


def repeats(docs: DataFrame, window: int = BYTES, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Tiles of repeated anchors, and (anchor, tile, off, len): bytes of a tile that repeat anywhere."""
    k = kind(window)
    tiles_ = repeated_tiles(docs, k, lambda c, lo, hi: f"{c} > 1")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, k):
            row, off, size = stretches(shard, window)
            yield pa.RecordBatch.from_arrays([pa.array(shard.anchor[row]), pa.array(shard.tile[row]), pa.array(off.astype(np.int32)), pa.array(size.astype(np.int32))], names=["anchor", "tile", "off", "len"])

    def search(distinct: DataFrame, contents: Callable[[DataFrame], DataFrame]) -> DataFrame:
        # copies of a tile are one string here, a repeat of its whole length; the tree finds what different tiles share
        whole = distinct.where("copies > 1").select("anchor", "tile", F.lit(0).alias("off"), (F.col("n") + window - 1).alias("len"))
        return whole.unionByName(contents(distinct.where("tiles > 1")).mapInArrow(scan, "anchor long, tile long, off int, len int"))

    return tiles_, searched(tiles_, docs, k, search, hot)


def maximal_repeats(docs: DataFrame, window: int = BYTES, hot: int = HOT) -> DataFrame:
    """(repeat, length, places, doc_id, start): maximal repeats of `window` bytes or more, a row for each place.

    Trees see a tile at a time, so a long repeat comes in pieces. Pieces whose places are the same but for a shift, and whose
    windows follow each other, are one repeat. Where a repeat runs on into one that more places share, it is reported up to there.
    """
    rows, k = identified(docs), kind(window)
    tiles_ = repeated_tiles(rows, k, lambda c, lo, hi: f"{c} > 1")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, k):
            for number, length, row, off in groups(shard, window):
                piece = np.full(len(row), shard.tile[row[0]] ^ (number + 1) * 0x9E3779B97F4A7C15 % 2**63)
                yield pa.RecordBatch.from_arrays([pa.array(shard.anchor[row]), pa.array(shard.tile[row]), pa.array(off.astype(np.int32)), pa.array(piece), pa.array(np.full(len(row), length)), pa.array(shard.anchor[row])], names=["anchor", "tile", "off", "piece", "length", "group"])

    def search(distinct: DataFrame, contents: Callable[[DataFrame], DataFrame]) -> DataFrame:
        shared = cut(contents(distinct.where("tiles > 1")).mapInArrow(scan, "anchor long, tile long, off int, piece long, length long, group long"))
        # copies of a tile are a repeat too, unless the tree has one of all of its bytes, with more places
        known = shared.where("off = 0").select("anchor", "tile", "length")
        whole = distinct.where("copies > 1").select("anchor", "tile", (F.col("n") + window - 1).cast("long").alias("length")).join(known, ["anchor", "tile", "length"], "left_anti")
        return shared.unionByName(whole.select("anchor", "tile", F.lit(0).alias("off"), F.col("tile").alias("piece"), "length", F.col("anchor").alias("group")))

    found = searched(tiles_, rows, k, search, hot)
    places = cut(tiles_.join(found, ["anchor", "tile"]).select("group", "piece", "length", "did", "rid", (F.col("at") + F.col("off")).alias("start")).distinct())
    least = places.groupBy("group", "piece", "length").agg(F.min(F.struct("did", "rid", "start")).alias("origin"), F.count("*").alias("places"))
    shifted = places.join(least, ["group", "piece", "length"]).where("places > 1")
    # the same for all pieces of a repeat: where its places lie from each other
    shape = shifted.groupBy("group", "piece", "length", "origin", "places").agg(F.bit_xor(F.xxhash64("did", "rid", F.col("start") - F.col("origin.start"))).alias("shape"))
    run = Window.partitionBy("origin.did", "origin.rid", "shape", "places").orderBy("origin.start", "length", "group", "piece")
    reach = F.max(F.col("origin.start") + F.col("length")).over(run.rowsBetween(Window.unboundedPreceding, -1))
    marked = shape.select("*", F.coalesce((F.col("origin.start") > reach - window + 1).cast("int"), F.lit(1)).alias("new"))
    numbered = marked.select("*", F.sum("new").over(run.rowsBetween(Window.unboundedPreceding, 0)).alias("nth"))
    joined = numbered.groupBy("origin.did", "origin.rid", "shape", "places", "nth").agg(F.min(F.struct("origin.start", "group", "piece", F.col("length").alias("own"))).alias("head"), F.max(F.col("origin.start") + F.col("length")).alias("end"))
    named = joined.select(F.xxhash64("did", "rid", "shape", "places", "head.start").alias("repeat"), "head.group", "head.piece", F.col("head.own").alias("own"), (F.col("end") - F.col("head.start")).alias("length"), "places")
    out = places.withColumnRenamed("length", "own").join(named, ["group", "piece", "own"])
    return out.select("repeat", "length", "places", doc_id(), "start")


def deduplicated(docs: DataFrame, window: int = BYTES, hot: int = HOT, with_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes): docs without the bytes that repeat."""
    rows = identified(docs)
    tiles_, found = repeats(rows, window, hot)

    def removing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in steps(batches):
            out: list[tuple] = []
            raw = data.tobytes()
            for i, (start, end) in enumerate(covers(batch)):
                text = raw[off[i] : off[i + 1]]
                start, end = unions(start, end)
                kept = b"".join(text[a:b] for a, b in zip(np.r_[0, end], np.r_[start, len(text)], strict=True)) if len(start) else text
                out.append((len(text), len(text) - len(kept), len(start), hashlib.sha256(kept).hexdigest(), kept if with_bytes else None))
            cols = zip(*out, strict=True) if out else ((),) * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("did"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["did", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    out = covered(rows, tiles_, found, smaller=False).select("did", "text", "cover").mapInArrow(removing, "did long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.select(doc_id(), "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_bytes)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
