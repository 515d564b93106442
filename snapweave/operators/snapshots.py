"""Snapshot algebra: comparisons, merges and reuse over tables keyed by path.

A snapshot is (path, size, sha256, executable), a path at most once. All of it is equi-joins on path or digest with ordered
conditions: nothing is collected, texts are never joined, and skew is left to adaptive joins (paths are unique).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _as(tree: DataFrame, side: str) -> DataFrame:
    """A snapshot as (path, struct): null where the path isn't in it."""
    return tree.select("path", F.struct("size", "sha256", "executable").alias(side))


def same(a: str, b: str) -> Column:
    """Both there, and alike in digest and mode; two absent entries aren't the same file."""
    return F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(f"{a}.sha256") == F.col(f"{b}.sha256")) & (F.col(f"{a}.executable") == F.col(f"{b}.executable"))


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change): added, modified or deleted."""
    both = _as(before, "b").join(_as(after, "a"), "path", "full_outer")
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "deleted").when(~same("a", "b"), "modified")
    return both.select("path", change.alias("change")).where("change is not null")


def checkout_plan(current: DataFrame, target: DataFrame) -> DataFrame:
    """(path, action, sha256): write where the target differs from what is there, remove where it has nothing."""
    both = _as(current, "c").join(_as(target, "t"), "path", "full_outer")
    action = F.when(F.col("t").isNull(), "remove").when(~same("c", "t"), "write")
    return both.select("path", action.alias("action"), F.col("t.sha256").alias("sha256")).where("action is not null")


def three_way(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(path, b, o, t, decision) of every path in any of the three.

    Decisions, first that holds: same, theirs, ours, exec-bit, deleted-there, deleted-here, content.
    """
    rows = _as(base, "b").join(_as(ours, "o"), "path", "full_outer").join(_as(theirs, "t"), "path", "full_outer")
    gone = lambda x: F.col(x).isNull()
    decision = (
        F.when(same("o", "t") | (gone("o") & gone("t")), "same")
        .when(same("b", "o") | (gone("b") & gone("o")), "theirs")
        .when(same("b", "t") | (gone("b") & gone("t")), "ours")
        .when(F.col("o.sha256") == F.col("t.sha256"), "exec-bit")
        .when(gone("t"), "deleted-there")
        .when(gone("o"), "deleted-here")
        .otherwise("content")
    )
    return rows.select("path", "b", "o", "t", decision.alias("decision"))


def merged(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(path, decision, size, sha256, executable) of the merge; content conflicts hold ours until the text merge settles them."""
    rows = three_way(base, ours, theirs)
    entry = F.when(F.col("decision") == "theirs", F.col("t")).when(F.col("decision") == "deleted-here", F.col("t")).otherwise(F.col("o"))
    bit = F.when(F.col("b").isNotNull() & (F.col("b.executable") != F.col("o.executable")), F.col("o.executable")).otherwise(F.col("t.executable"))
    out = rows.select("path", "decision", entry.alias("e"), bit.alias("bit")).where("e is not null")
    return out.select("path", "decision", "e.size", "e.sha256", F.when(F.col("decision") == "exec-bit", F.col("bit")).otherwise(F.col("e.executable")).alias("executable"))


def in_the_way(disk: DataFrame, head: DataFrame, target: DataFrame) -> DataFrame:
    """(path): what a checkout from head to target touches, and disk holds otherwise than both."""
    touched = compare(head, target).select("path")
    rows = touched.join(_as(disk, "d"), "path").join(_as(head, "h"), "path", "left").join(_as(target, "t"), "path", "left")
    return rows.where(~same("d", "h") & ~same("d", "t")).select("path")


def reuse(declared: DataFrame, prior: DataFrame) -> DataFrame:
    """(path, source, how): what is stored already: the same path and digest, else the first path with the digest."""
    by_path = prior.select("path", F.col("sha256").alias("held"))
    by_digest = prior.groupBy("sha256").agg(F.min("path").alias("twin"))
    rows = declared.select("path", "sha256").join(by_path, "path", "left").join(by_digest, "sha256", "left")
    how = F.when(F.col("held") == F.col("sha256"), "path").when(F.col("twin").isNotNull(), "digest").otherwise("send")
    source = F.when(F.col("held") == F.col("sha256"), F.col("path")).otherwise(F.col("twin"))
    return rows.select("path", source.alias("source"), how.alias("how"))


def publication(base: DataFrame, received: DataFrame, disk: DataFrame, head: DataFrame) -> DataFrame:
    """(path, outcome) of a save from a folder that started from base, received some copies, and meets a newer head.

    A disk copy equal to what was received is no edit: head's copy is kept. An edit of a path that the head changed as well
    is a conflict; a removal doesn't undo what the head changed.
    """
    rows = _as(base, "b").join(_as(received, "l"), "path", "full_outer").join(_as(disk, "d"), "path", "full_outer").join(_as(head, "h"), "path", "full_outer")
    digest = lambda x: F.col(f"{x}.sha256")
    outcome = (
        F.when(F.col("d").isNotNull() & (digest("d") == digest("h")), "unchanged")
        .when(F.col("d").isNull() & F.col("h").isNull(), "stays-deleted")
        .when(F.col("d").isNull() & (F.col("l").isNull() | ~digest("h").eqNullSafe(digest("b"))), "keep-head")
        .when(F.col("d").isNull(), "deleted")
        .when(digest("d") == digest("l"), F.when(F.col("h").isNull(), "stays-deleted").otherwise("keep-head"))
        .when(~digest("h").eqNullSafe(digest("b")), "conflict")
        .otherwise("saved")
    )
    return rows.select("path", outcome.alias("outcome"))


def reconcile(received: DataFrame, disk: DataFrame, target: DataFrame) -> DataFrame:
    """(path, action) of a download: skip what is there, fetch what isn't, and delete only what is as it was received."""
    rows = _as(received, "l").join(_as(disk, "d"), "path", "full_outer").join(_as(target, "t"), "path", "full_outer")
    action = (
        F.when(F.col("t").isNull() & F.col("d").isNull(), "nothing")
        .when(F.col("t").isNull(), F.when(F.col("d.sha256") == F.col("l.sha256"), "delete").otherwise("keep"))
        .when(F.col("d.sha256") == F.col("t.sha256"), "skip")
        .otherwise("fetch")
    )
    return rows.select("path", action.alias("action"))


def published(base: DataFrame, removed: DataFrame, replaced: DataFrame) -> DataFrame:
    """base without removed and replaced paths, with the replaced ones in their new form."""
    gone = removed.select("path").unionByName(replaced.select("path")).distinct()
    return base.join(gone, "path", "left_anti").unionByName(replaced)


def held_and_new(tree: DataFrame, objects: DataFrame) -> DataFrame:
    """(held, files, objects, bytes): the tree's content that is stored already, and what a save would add; each digest once."""
    names = objects.select("sha256").distinct().withColumn("held", F.lit(True))
    each = tree.groupBy("sha256").agg(F.count("*").alias("files"), F.min("size").alias("size"))
    rows = each.join(names, "sha256", "left").select(F.coalesce("held", F.lit(False)).alias("held"), "files", "size")
    return rows.groupBy("held").agg(F.sum("files").alias("files"), F.count("*").alias("objects"), F.sum("size").alias("bytes"))


def duplicates(tree: DataFrame) -> DataFrame:
    """(sha256, first, copies, wasted): content that stands at several paths."""
    rows = tree.groupBy("sha256").agg(F.min("path").alias("first"), F.count("*").alias("copies"), F.min("size").alias("size")).where("copies > 1")
    return rows.select("sha256", "first", "copies", (F.col("size") * (F.col("copies") - 1)).alias("wasted"))


def equal_digests(a: DataFrame, b: DataFrame) -> DataFrame:
    """(only_left, only_right, equal): whether two trees hold the same set of digests, by counts of one join."""
    left, right = (t.select("sha256").distinct() for t in (a, b))
    marks = left.withColumn("l", F.lit(1)).join(right.withColumn("r", F.lit(1)), "sha256", "full_outer")
    counts = marks.agg(F.count_if(F.col("r").isNull()).alias("only_left"), F.count_if(F.col("l").isNull()).alias("only_right"))
    return counts.select("only_left", "only_right", ((F.col("only_left") == 0) & (F.col("only_right") == 0)).alias("equal"))
