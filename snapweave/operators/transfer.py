"""Transfer planning: size bands, sections under a budget, bases for deltas, as-of and interval joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIB = 1 << 20
#: Limits of the bands and of a section (fixed values).
BANDS = (("packable", 1 * MIB), ("ordinary", 8 * MIB), ("chunked", 95 * MIB))
SECTION_BYTES, SECTION_FILES = 256 * MIB, 4000


def band(size: str, limits: tuple[tuple[str, int], ...] = BANDS) -> Column:
    out = F.lit("multipart")
    for name, most in reversed(limits):
        out = F.when(F.col(size) <= most, name).otherwise(out)
    return out


def survey(files: DataFrame, limits: tuple[tuple[str, int], ...] = BANDS) -> DataFrame:
    return files.groupBy(band("size", limits).alias("band")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def spread(rows: DataFrame, folder: str, order: str) -> DataFrame:
    """rows with `turn`: the first of each folder, then the second of each, and so on."""
    return rows.select("*", F.row_number().over(Window.partitionBy(folder).orderBy(order)).alias("turn"))


def _filled(files: DataFrame, group: str, order: str, name: str, closes: Callable[[tuple, list, int], bool], sums: tuple[str, ...]) -> DataFrame:
    """files with a number of the lot they fill, within each group: a lot is closed before a row for which closes(row's sums, held sums, rows held).

    Where a lot ends depends on where it began, so a group is one ordered stream; it is read once, batch by batch, and
    nothing but the running totals is held.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, lot, held, n = object(), 0, [0] * len(sums), 0
        for rows in batches:
            numbers = []
            for key, *own in zip(rows[group].tolist(), *(rows[c].tolist() for c in sums), strict=True):
                if key != last:
                    last, lot, held, n = key, 0, [0] * len(sums), 0
                if n and closes(own, held, n):
                    lot, held, n = lot + 1, [0] * len(sums), 0
                held, n = [a + b for a, b in zip(held, own, strict=True)], n + 1
                numbers.append(lot)
            yield rows.assign(**{name: numbers})

    dealt = files.repartition(group).sortWithinPartitions(group, order)
    return dealt.mapInPandas(fold, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema), f"{name} long"]))


def sections(files: DataFrame, group: str, order: str, budget: int = SECTION_BYTES, most: int = SECTION_FILES) -> DataFrame:
    """files with `section`, numbered within each group: filled in order, closed before it would pass a limit; a file beyond the budget is alone."""
    return _filled(files, group, order, "section", lambda own, held, n: own[0] >= budget or held[0] + own[0] > budget or n >= most or held[0] >= budget, ("size",))


#: Files, bytes and bytes as JSON of an edit at most (fixed values).
BATCH_FILES, BATCH_BYTES, BATCH_JSON = 32, MIB, 3 * MIB // 2


def put_batches(changes: DataFrame, group: str, order: str, most: int = BATCH_FILES, size: int = BATCH_BYTES, encoded: int = BATCH_JSON) -> DataFrame:
    """changes (group, size, json: bytes of each as JSON, ...) with `batch`: edits that are filled in order and accepted together."""
    return _filled(changes, group, order, "batch", lambda own, held, n: n >= most or held[0] + own[0] > size or held[1] + own[1] > encoded, ("size", "json"))


def nearest(files: DataFrame, others: DataFrame) -> DataFrame:
    """(path, base): of others in the same folder with the same extension and a size within twice, the nearest in size; the least path of several.

    Both lists are sorted by size once for each folder and extension; a file looks at the two others before it and the two
    after it (one may be itself), so no pairs are made.
    """
    keys = lambda rows: (rows.select("path", "size", F.regexp_extract("path", "^(.*)/", 1).alias("folder"), F.lower(F.regexp_extract("path", r"[^/](\.[^./]*)$", 1)).alias("ext")))
    found = None
    mine = keys(files)
    for turn in (F.asc, F.desc):
        # of others of one size the least path stands last, next to what follows
        w = Window.partitionBy("folder", "ext").orderBy(turn("size"), F.desc("path"))
        listed = keys(others).select("*", F.lag(F.struct("path", "size")).over(w).alias("before"))
        rows = listed.select("folder", "ext", "size", F.lit(0).alias("asks"), "path", F.struct(F.struct("path", "size").alias("one"), F.col("before").alias("two")).alias("seen"))
        rows = rows.unionByName(mine.select("folder", "ext", "size", F.lit(1).alias("asks"), "path"), allowMissingColumns=True)
        w = Window.partitionBy("folder", "ext").orderBy(turn("size"), "asks", F.desc("path")).rowsBetween(Window.unboundedPreceding, 0)
        met = rows.select("path", "size", "asks", F.last("seen", ignorenulls=True).over(w).alias("seen")).where("asks = 1").select("path", "size", F.explode(F.array("seen.one", "seen.two")).alias("other"))
        found = met if found is None else found.unionByName(met)
    good = found.where("other is not null and other.path <> path and other.size <= 2 * size and size <= 2 * other.size")
    return good.groupBy("path").agg(F.min_by(F.col("other.path"), F.struct(F.abs(F.col("size") - F.col("other.size")), F.col("other.path"))).alias("base"))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """left with the value of the latest row of right at or before it, by key: one union, one window."""
    both = left.select(key, at, F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_value")).unionByName(
        right.select(key, at, F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_row"), F.col(value).alias("_value"))
    )
    seen = F.last("_value", ignorenulls=True).over(Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0))
    return both.select("_side", "_row", seen.alias(value)).where("_side = 1").select("_row.*", value)


def overlaps(pieces: DataFrame, old: DataFrame, widen: int, cell: int) -> DataFrame:
    """(key, start, old_start): old pieces that overlap a piece widened by some bytes; joined by cells of the offset."""
    cells = lambda a, b: F.sequence(F.floor(a / cell), F.floor((b - 1) / cell))
    lo, hi = F.greatest(F.col("start") - widen, F.lit(0)), F.col("end") + widen
    left = pieces.select("key", "start", lo.alias("lo"), hi.alias("hi")).select("*", F.explode(cells(F.col("lo"), F.col("hi"))).alias("cell"))
    right = old.select("key", F.col("start").alias("old_start"), F.col("end").alias("old_end")).select("*", F.explode(cells(F.col("old_start"), F.col("old_end"))).alias("cell"))
    return left.join(right, ["key", "cell"]).where("old_start < hi and old_end > lo").select("key", "start", "old_start").distinct()


def trailing_rate(samples: DataFrame, key: str, at_ms: str, total: str, span_ms: int = 5000, least_ms: int = 250) -> DataFrame:
    """samples with `rate`: bytes a second since the oldest sample of the last span; 0 if that is too near."""
    w = Window.partitionBy(key).orderBy(at_ms).rangeBetween(-span_ms, 0)
    since = F.col(at_ms) - F.first(at_ms).over(w)
    return samples.select("*", F.when(since >= least_ms, (F.col(total) - F.first(total).over(w)) * 1000 / since).otherwise(0.0).alias("rate"))
