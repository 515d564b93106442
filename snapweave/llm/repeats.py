"""Finding the places of windows that repeat anywhere in a corpus, without pairs.

A text's windows (so many words or bytes in a row) are cut into tiles: runs of windows that share the least hash of the
k-grams in them, the anchor. Equal windows have equal anchors, so all places of a window lie in tiles of one anchor, and
anchors are what Spark shuffles by:

1. tiles of all documents, as arrays of numbers (about one tile for every 20 words or 190 bytes);
2. anchors that repeat, by partial aggregation; only their tiles go on;
3. copies of a tile count once from here (same anchor and content), so a group of copies is one row however large it is;
4. the content of one copy of each tile is read from its document, and tiles of an anchor meet in one shard, where an
   index of the operator's own (FM-index, suffix array) finds the windows that repeat;
5. what it found goes back to all copies by (anchor, tile), and to texts by document.

An anchor with more than HOT different tiles is split: each of its tiles is cut again by the least of longer k-grams, and the parts
meet by those. LEVELS says how long; what surrounds a common passage makes parts that are alone and go, what lies inside makes parts
that are equal and count once, and only parts at its ends stay for the next level. At the last, a k-gram is a whole window, so all that
meets is equal. What is found in a part goes back to its tile by where it stands there. So the index does its work at any size, and
no task holds more than HOT tiles of one anchor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions, steps
from .kernels import byte_units, mixed, tiles, words

#: Different tiles of one anchor that an index takes together.
HOT = 256
#: Length of the k-grams among which an anchor is the least, as parts of a window, for tiles and for parts of hot ones.
LEVELS = (1 / 3, 0.9, 0.98, 1.0)
#: Buckets of documents by which those of hot tiles are picked before a join: what is sent to all executors is bounded by it.
BUCKETS = 1 << 18
#: Units that one index takes, but for a last anchor that goes on.
INDEX_UNITS = 400_000


class Kind(NamedTuple):
    window: int
    by_words: bool

    def k(self, level: int) -> int:
        """Units of the k-grams among which the anchor is the least."""
        return max(1, int(self.window * LEVELS[level]))

    def units(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the units of texts, and the number of the first of each text."""
        if self.by_words:
            found = words(data, off)
            return found.hash, found.first
        return byte_units(data), off


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(values, kind))


def tile_lists(docs: DataFrame, kind: Kind) -> DataFrame:
    """(did, rid, anchors, tiles, at, n) of each document that has a window."""

    def cutting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in steps(batches):
            units, first = kind.units(data, off)
            t = tiles(units, first, kind.window, kind.k(0))
            counts = np.bincount(t.doc, minlength=batch.num_rows)
            full = np.flatnonzero(counts)
            ids = [pa.array(batch.column(c).to_numpy(zero_copy_only=False)[full]) for c in ("did", "rid")]
            lists = [_lists(v, counts[full], ty) for v, ty in ((t.anchor.view(np.int64), pa.int64()), (t.tile.view(np.int64), pa.int64()), (t.at.astype(np.int32), pa.int32()), (t.n.astype(np.int32), pa.int32()))]
            yield pa.RecordBatch.from_arrays(ids + lists, names=["did", "rid", "anchors", "tiles", "at", "n"])

    return docs.mapInArrow(cutting, "did long, rid long, anchors array<long>, tiles array<long>, at array<int>, n array<int>")


def repeated_tiles(docs: DataFrame, kind: Kind, repeats: Callable[[str, str, str], str]) -> DataFrame:
    """(did, rid, anchor, tile, at, n) of all tiles whose anchor repeats: repeats(count, least did, greatest did) says when."""
    lists = cut(tile_lists(docs, kind))
    anchors = lists.select("did", F.explode("anchors").alias("anchor")).groupBy("anchor").agg(F.count("*").alias("c"), F.min("did").alias("lo"), F.max("did").alias("hi"))
    # written down, it has an exchange of its own in the join, and Spark can split hot anchors there
    again = cut(anchors.where(repeats("c", "lo", "hi")).select("anchor"))
    flat = lists.select("did", "rid", F.explode(F.arrays_zip(F.col("anchors").alias("anchor"), F.col("tiles").alias("tile"), "at", "n")).alias("t")).select("did", "rid", "t.*")
    return cut(flat.join(again, "anchor", "left_semi"))


def distinct_tiles(tiles_: DataFrame) -> DataFrame:
    """One row of each (anchor, tile): its first copy (did, rid, at, n), copies, hi (greatest did), and tiles of the anchor.

    tiles_ has (did, rid, anchor, tile, at, n, copies, hi); where it has no copies and hi, each row is one.
    """
    copies, hi = (F.sum("copies"), F.max("hi")) if "copies" in tiles_.columns else (F.count("*"), F.max("did"))
    one = cut(tiles_.groupBy("anchor", "tile").agg(F.min(F.struct("did", "rid", "at", "n")).alias("first"), copies.alias("copies"), hi.alias("hi")))
    several = cut(one.groupBy("anchor").agg(F.count("*").alias("tiles")).where("tiles > 1"))
    return one.join(several, "anchor", "left").select("anchor", "tile", "first.*", "copies", "hi", F.coalesce("tiles", F.lit(1)).alias("tiles"))


def _bucket() -> Column:
    return F.pmod("rid", F.lit(BUCKETS))


def searched(tiles_: DataFrame, docs: DataFrame, kind: Kind, search: Callable[[DataFrame, Callable[[DataFrame], DataFrame]], DataFrame], hot: int = HOT, level: int = 0) -> DataFrame:
    """What search(tiles, contents) finds in the different tiles of tiles_: (anchor, tile, off, ...), with those of hot anchors searched by parts."""
    distinct = distinct_tiles(tiles_)
    found = search(distinct.where(F.col("tiles") <= hot), lambda t: contents(t, docs, kind))
    crowded = distinct.where(F.col("tiles") > hot)
    if level + 1 == len(LEVELS) or crowded.isEmpty():
        return found if level + 1 < len(LEVELS) else search(distinct, lambda t: contents(t, docs, kind))
    buckets = crowded.select(_bucket().alias("bucket")).distinct()
    some = cut(docs.join(F.broadcast(buckets), _bucket() == F.col("bucket"), "left_semi"))
    parts = cut(part_tiles(crowded, some, kind, level + 1))
    below = searched(parts.select("did", "rid", "anchor", "tile", "at", "n", "copies", "hi"), some, kind, search, hot, level + 1)
    back = parts.select("anchor", "tile", "whole_anchor", "whole_tile", "begin").join(below, ["anchor", "tile"])
    return found.unionByName(back.select(F.col("whole_anchor").alias("anchor"), F.col("whole_tile").alias("tile"), (F.col("begin") + F.col("off")).cast("int").alias("off"), *(c for c in found.columns if c not in ("anchor", "tile", "off"))))


def _wanted(tiles_: DataFrame, docs: DataFrame) -> DataFrame:
    """(text, w): texts with the tiles to be read from them."""
    lists = tiles_.groupBy("did", "rid").agg(F.collect_list(F.struct("anchor", "tile", "at", "n", "hi", "copies")).alias("w"))
    return docs.join(lists, ["did", "rid"])


def _wishes(batch: pa.RecordBatch) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """For each wish of a batch the number of its text, and the fields of the wish."""
    lists = batch.column("w")
    flat = lists.flatten()
    counts = np.diff(lists.offsets.to_numpy())
    return np.repeat(np.arange(batch.num_rows), counts), {name: flat.field(name).to_numpy(zero_copy_only=False) for name in ("anchor", "tile", "at", "n", "hi", "copies")}


def contents(tiles_: DataFrame, docs: DataFrame, kind: Kind) -> DataFrame:
    """(anchor, tile, lo, hi, copies, units): the content of each tile, read from its first copy: int64 word hashes, or bytes.

    Rows of one anchor lie together, sorted.
    """

    def reading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in steps(batches):
            text, wish = _wishes(batch)
            units, first = kind.units(data, off) if kind.by_words else (data, off)
            begin = first[text] + wish["at"]
            blobs = [units[a:b].tobytes() for a, b in zip(begin, begin + wish["n"] + kind.window - 1, strict=True)]
            did = batch.column("did").to_numpy(zero_copy_only=False)[text]
            yield pa.RecordBatch.from_arrays([pa.array(wish["anchor"]), pa.array(wish["tile"]), pa.array(did), pa.array(wish["hi"]), pa.array(wish["copies"]), pa.array(blobs, pa.binary())], names=["anchor", "tile", "lo", "hi", "copies", "units"])

    rows = _wanted(tiles_, docs).mapInArrow(reading, "anchor long, tile long, lo long, hi long, copies long, units binary")
    # rows alike in anchor and tile come from repeated rows of a document
    return rows.repartition(partitions(docs.sparkSession), "anchor").sortWithinPartitions("anchor", "tile")


def part_tiles(tiles_: DataFrame, docs: DataFrame, kind: Kind, level: int) -> DataFrame:
    """(did, rid, anchor, tile, at, n, copies, hi, whole_anchor, whole_tile, begin): tiles cut into parts, read from their first copies."""

    def cutting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in steps(batches):
            text, wish = _wishes(batch)
            units, first = kind.units(data, off)
            begin, size = first[text] + wish["at"], wish["n"].astype(np.int64) + kind.window - 1
            bounds = np.r_[0, np.cumsum(size)]
            inside = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - begin, size)
            t = tiles(units[inside], bounds, kind.window, kind.k(level))
            anchor = mixed(t.anchor ^ wish["anchor"].view(np.uint64)[t.doc])  # parts of unlike anchors don't meet
            of = lambda c: batch.column(c).to_numpy(zero_copy_only=False)[text[t.doc]]
            columns = {"did": of("did"), "rid": of("rid"), "anchor": anchor.view(np.int64), "tile": t.tile.view(np.int64), "at": (wish["at"][t.doc] + t.at).astype(np.int32), "n": t.n.astype(np.int32)}
            columns |= {"copies": wish["copies"][t.doc], "hi": wish["hi"][t.doc], "whole_anchor": wish["anchor"][t.doc], "whole_tile": wish["tile"][t.doc], "begin": t.at.astype(np.int32)}
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))

    return _wanted(tiles_, docs).mapInArrow(cutting, "did long, rid long, anchor long, tile long, at int, n int, copies long, hi long, whole_anchor long, whole_tile long, begin int")


class Shard(NamedTuple):
    """Tiles that an index takes: fields of their rows and their contents."""

    anchor: np.ndarray
    tile: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    units: list[np.ndarray]


def shards(batches: Iterator[pa.RecordBatch], kind: Kind) -> Iterator[Shard]:
    """Rows of contents() in lots of about INDEX_UNITS units, whole anchors each."""
    rows: list[tuple] = []
    held, last = 0, None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "tile", "lo", "hi", "units")), strict=True):
            if rows and row[:2] == last:
                continue
            if held >= INDEX_UNITS and row[0] != last[0]:
                yield _shard(rows)
                rows, held = [], 0
            units = np.frombuffer(row[4], np.uint64 if kind.by_words else np.uint8)
            rows.append((*row[:4], units))
            held, last = held + len(units), row[:2]
    if rows:
        yield _shard(rows)


def _shard(rows: list[tuple]) -> Shard:
    anchor, tile, lo, hi, units = zip(*rows, strict=True)
    return Shard(np.array(anchor, np.int64), np.array(tile, np.int64), np.array(lo, np.int64), np.array(hi, np.int64), list(units))


def covered(docs: DataFrame, tiles_: DataFrame, found: DataFrame, smaller: bool) -> DataFrame:
    """docs with `cover`, an array of stretches (start, end) in units.

    found has (anchor, tile, off, len): units of a tile to be covered in all its copies; with smaller also own, and then
    only in documents with a greater did.
    """
    hits = tiles_.select("did", "rid", "anchor", "tile", "at").join(found, ["anchor", "tile"])
    if smaller:
        hits = hits.where("own < did")
    lists = hits.select("did", "rid", F.struct((F.col("at") + F.col("off")).cast("int").alias("start"), (F.col("at") + F.col("off") + F.col("len")).cast("int").alias("end")).alias("c"))
    return docs.join(lists.groupBy("did", "rid").agg(F.collect_set("c").alias("cover")), ["did", "rid"], "left")


def covers(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Starts and ends of the stretches of each row."""
    lists = batch.column("cover")
    flat, ends = lists.flatten(), lists.offsets.to_numpy()
    start, end = (flat.field(name).to_numpy(zero_copy_only=False).astype(np.int64) for name in ("start", "end"))
    valid = lists.is_valid().to_numpy(zero_copy_only=False)
    sizes = np.where(valid, np.diff(ends), 0)
    at = np.r_[0, np.cumsum(sizes)]
    for i in range(batch.num_rows):
        yield start[at[i] : at[i + 1]], end[at[i] : at[i + 1]]
