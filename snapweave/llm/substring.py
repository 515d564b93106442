"""Substring dedup over words: an FM-index of each shard, searched backward for matching statistics.

A shard holds the different tiles of some anchors (see repeats.py). Its FM-index is a wavelet matrix over the
Burrows-Wheeler transform of their words: packed bits with counts by 64, log2 of the vocabulary levels. Suffixes are sorted by
their first `window` words, which is all that patterns of that length ask for. Tiles of documents are streamed through it from
right to left: each word is one backward step; a match of full length is first cut to window - 1 words, and one that can't be
extended to its parent, by the common prefixes of neighbours. Where the matching statistic reaches the window, its interval is
reported: it holds all places of the window, and the least doc_id among them owns it. Runs of windows with the same owner are one row.

Defined cases: a null or empty text has no words and stays; rows alike in doc_id don't remove each other's words (only a
smaller doc_id does); a null doc_id counts as smaller than all others; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_id, identified, steps
from .kernels import unions
from .repeats import HOT, Kind, Shard, covered, covers, repeated_tiles, searched, shards

WORDS = 50


def kind(window: int = WORDS) -> Kind:
    return Kind(window, True)


class FMIndex:
    """Of segments of symbols; finds all places of patterns of up to `window` symbols."""

    def __init__(self, segments: list[np.ndarray], window: int):
        self.window = window
        size = np.array([len(s) for s in segments])
        self.begin = np.r_[0, np.cumsum(size + 1)[:-1]]
        self.end = self.begin + size
        self.alphabet, symbols = np.unique(np.concatenate(segments), return_inverse=True)
        self.seq = np.zeros(int(size.sum() + len(size)), np.int64)  # each segment ends with a 0
        inside = np.ones(len(self.seq), bool)
        inside[self.end] = False
        self.seq[inside] = symbols + 1
        self.order, self.lcp = self._sorted()
        # the interval of each row's first window - 1 symbols
        starts = np.flatnonzero(self.lcp[:-1] < window - 1)
        group = np.cumsum(self.lcp[:-1] < window - 1) - 1
        self.first, self.after = starts[group], np.r_[starts[1:], len(self.seq)][group]
        transform = self.seq[self.order - 1]
        before = np.r_[0, np.cumsum(np.bincount(self.seq, minlength=len(self.alphabet) + 1))]
        self.levels = []
        current = transform
        for bit in range(max(1, int(len(self.alphabet)).bit_length()) - 1, -1, -1):
            ones = ((current >> bit) & 1).astype(bool)
            packed = np.packbits(np.r_[ones, np.zeros(64 + (-len(ones)) % 64, bool)], bitorder="little").view(np.uint64)
            counts = np.r_[0, np.cumsum(np.bitwise_count(packed), dtype=np.int64)]
            self.levels.append((bit, packed, counts, len(ones) - int(ones.sum())))
            current = np.concatenate([current[~ones], current[ones]])
        every = np.arange(len(self.alphabet) + 1)
        self.base = before[:-1] - self._descend(every, np.zeros(len(every), np.int64))

    def _sorted(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions by their first `window` symbols, and how many of these each shares with the one before it (-1 at both ends)."""
        n, rank, h = len(self.seq), self.seq, 1
        ranks = [(1, rank)]
        order = np.argsort(rank)
        while h < self.window:
            by = min(h, self.window - h)
            after = np.zeros(n, np.int64)
            after[: n - by] = rank[by:] + 1
            key = rank * (n + 2) + after
            order = np.argsort(key)
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.r_[False, np.diff(key[order]) != 0])
            h += by
            ranks.append((h, rank))
        a, b, shared = order[:-1], order[1:], np.zeros(max(n - 1, 0), np.int64)
        # ranks of so many symbols that are equal are as many common ones; a separator ends what is common
        for size, rank in reversed(ranks):
            x, y = np.minimum(a + shared, n - 1), np.minimum(b + shared, n - 1)
            same = (shared + size <= self.window) & (a + shared < n) & (b + shared < n) & (rank[x] == rank[y])
            shared[same] += size
        left = np.repeat(self.end, self.end - self.begin + 1) - np.arange(n)
        shared = np.minimum(shared, np.minimum(np.minimum(left[a], left[b]), self.window))
        return order, np.r_[-1, shared, -1]

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, packed, counts, zeros in self.levels:
            word = at >> 6
            ones = counts[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where((symbol >> bit) & 1, zeros + ones, at - ones)
        return at

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one symbol more in front."""
        both = self._descend(np.r_[symbol, symbol], np.r_[lo, hi])
        base = self.base[symbol]
        return both[: len(lo)] + base, both[len(lo) :] + base

    def _parent(self, lo: int, hi: int, length: int) -> tuple[int, int, int]:
        """The interval of the longest shorter pattern that has more places, and its length."""
        length = min(length, max(int(self.lcp[lo]), int(self.lcp[hi])))
        if length <= 0:
            return 0, len(self.seq), 0
        return int(np.flatnonzero(self.lcp[: lo + 1] < length)[-1]), hi + int(np.argmax(self.lcp[hi:] < length)), length

    def matching(self, patterns: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Stream patterns from right to left, all at once: (pattern, position, lo, hi) where a match of full length begins.

        The statistic of a position is the length of the longest match that begins there, `window` at most. A symbol in front is
        one backward step; where it has no place, the pattern is cut from the right to its parent until it has one.
        """
        size = np.array([len(p) for p in patterns], np.int64)
        which = np.argsort(-size, kind="stable")
        size = size[which]
        every = np.concatenate(patterns) if patterns else np.zeros(0, np.uint64)
        at = np.minimum(np.searchsorted(self.alphabet, every), len(self.alphabet) - 1)
        symbol = np.where(self.alphabet[at] == every, at + 1, -1)  # -1: a symbol that the index doesn't have
        end = np.cumsum([len(p) for p in patterns])[which]
        n = len(self.seq)
        lo, hi, length = np.zeros(len(size), np.int64), np.full(len(size), n), np.zeros(len(size), np.int64)
        for t in range(int(size[0]) if len(size) else 0):
            active = int(np.searchsorted(-size, -t, side="left"))
            lo, hi, length, end = lo[:active], hi[:active], length[:active], end[:active]
            full = np.flatnonzero(length == self.window)
            lo[full], hi[full] = self.first[lo[full]], self.after[hi[full] - 1]
            length[full] = self.window - 1
            c = symbol[end - 1 - t]
            known = np.maximum(c, 0)
            a, b = self.step(known, lo, hi)
            for i in np.flatnonzero((a >= b) | (c < 0)).tolist():
                x, y, size_ = int(lo[i]), int(hi[i]), int(length[i])
                while size_ and (c[i] < 0 or a[i] >= b[i]):
                    x, y, size_ = self._parent(x, y, size_) if c[i] >= 0 else (0, n, 0)
                    if c[i] >= 0:
                        p, q = self.step(known[i : i + 1], np.array([x]), np.array([y]))
                        a[i], b[i] = p[0], q[0]
                if c[i] < 0 or a[i] >= b[i]:
                    a[i], b[i], size_ = 0, n, -1
                length[i] = size_
            lo, hi, length = a, b, length + 1
            hit = np.flatnonzero(length == self.window)
            if len(hit):
                yield which[hit], size[hit] - 1 - t, lo[hit], hi[hit]


def owners(shard: Shard, window: int) -> tuple[np.ndarray, ...]:
    """Runs of windows of a shard's tiles with the same least doc_id, where it lies below the tile's greatest: (row, off, n, own)."""
    index = FMIndex(shard.units, window)
    size = np.array([len(u) for u in shard.units])
    owner = np.full(len(index.seq), np.iinfo(np.int64).max)
    owner[np.repeat(index.begin - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())] = np.repeat(shard.lo, size)
    by_row = np.r_[owner[index.order], np.iinfo(np.int64).max]
    hits = list(index.matching(shard.units))
    row, off, lo, hi = (np.concatenate([h[i] for h in hits]) for i in range(4)) if hits else (np.zeros(0, np.int64),) * 4
    # each interval of matches of full length holds all places of a window: the least of their documents owns it
    first, of = np.unique(lo, return_inverse=True)
    after = np.zeros(len(first), np.int64)
    after[of] = hi
    least = np.minimum.reduceat(by_row, np.stack([first, after], axis=1).ravel())[::2] if len(first) else first
    own = least[of]
    order = np.lexsort((off, row))
    row, off, own = row[order], off[order], own[order]
    head = np.flatnonzero(np.r_[True, (np.diff(own) != 0) | (np.diff(row) != 0) | (np.diff(off) != 1)]) if len(row) else np.zeros(0, np.int64)
    n = np.diff(np.r_[head, len(row)])
    good = own[head] < shard.hi[row[head]]
    return row[head][good], off[head][good], n[good], own[head][good]


def repeats(docs: DataFrame, window: int = WORDS, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Tiles of repeated anchors, and (anchor, tile, off, len, own): words of a tile that windows of document own cover."""
    k = kind(window)
    tiles_ = repeated_tiles(docs, k, lambda c, lo, hi: f"{lo} < {hi}")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, k):
            row, off, n, own = owners(shard, window)
            yield pa.RecordBatch.from_arrays([pa.array(shard.anchor[row]), pa.array(shard.tile[row]), pa.array(off.astype(np.int32)), pa.array((n + window - 1).astype(np.int32)), pa.array(own)], names=["anchor", "tile", "off", "len", "own"])

    return tiles_, searched(tiles_, docs, k, lambda distinct, contents: contents(distinct.where("tiles > 1 or hi > did")).mapInArrow(stream, "anchor long, tile long, off int, len int, own long"), hot)


def deduplicated(docs: DataFrame, window: int = WORDS, hot: int = HOT, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and the kept text): docs without the words that a window repeats."""
    rows = identified(docs)
    tiles_, found = repeats(rows, window, hot)

    def removing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in steps(batches):
            out: list[tuple] = []
            raw = data.tobytes()
            for i, (start, end) in enumerate(covers(batch)):
                parts = raw[off[i] : off[i + 1]].split()
                n, kept = len(parts), parts
                if len(start):
                    start, end = unions(start, end)
                    kept = [w for a, b in zip(np.r_[0, end], np.r_[start, n], strict=True) for w in parts[a:b]]
                text = b" ".join(kept)
                out.append((n, n - len(kept), hashlib.sha256(text).hexdigest(), text.decode() if with_text else None))
            n, gone, sha, text = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("did"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(text, pa.string())], names=["did", "n_words", "n_removed", "kept_sha256", "kept"])

    out = covered(rows, tiles_, found, smaller=True).select("did", "text", "cover").mapInArrow(removing, "did long, n_words long, n_removed long, kept_sha256 string, kept string")
    return out.select(doc_id(), "n_words", "n_removed", "kept_sha256", *["kept"] * with_text)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
