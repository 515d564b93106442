"""Line diffs and three-way text merges.

Pairs of texts are rows; a row's lines are compared by an exact longest common subsequence, which no built-in function gives,
so one Arrow function per operator does it. Common ends are trimmed first, and what is left is refused above CELLS (or MERGE_CELLS), so a
task's memory is bounded. Splitting, numbering, folding and counting are window functions over the lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snapweave.functions.text import size_change

#: Cells of a comparison at most: of a diff that is shown, and of a merge (fixed values).
CELLS, MERGE_CELLS = 4_000_000, 16_000_000


def lines_of(text: str | None) -> list[str]:
    """Lines without their ends; a last end makes no further line."""
    if not text:
        return []
    out = text.replace("\r\n", "\n").split("\n")
    return out[:-1] if out[-1] == "" else out


def common(a: list[str], b: list[str], cells: int = CELLS) -> list[tuple[int, int]] | None:
    """Places (i, j) of an exact longest common subsequence; deletions come before insertions. None if it is too large."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    x, y = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if x and y and (len(x) + 1) * (len(y) + 1) > cells:
        return None
    numbers: dict[str, int] = {}
    p, q = (np.array([numbers.setdefault(s, len(numbers)) for s in side], np.int64) for side in (x, y))
    # table[i][j]: length for x[i:], y[j:]; a row is a running maximum of matches one step on
    table = np.zeros((len(p) + 1, len(q) + 1), np.int32)
    for i in range(len(p) - 1, -1, -1):
        step = np.where(q == p[i], table[i + 1, 1:] + 1, table[i + 1, :-1])
        table[i, :-1] = np.maximum.accumulate(step[::-1])[::-1]
    out, i, j = [(k, k) for k in range(lo)], 0, 0
    while i < len(p) and j < len(q):
        if p[i] == q[j]:
            out.append((lo + i, lo + j))
            i, j = i + 1, j + 1
        elif table[i + 1, j] >= table[i, j + 1]:
            i += 1
        else:
            j += 1
    return out + [(len(a) - hi + k, len(b) - hi + k) for k in range(hi)]


def _diff(a: list[str], b: list[str]) -> list[tuple[str, int | None, int | None, str]] | None:
    """(side, old number, new number, text): '-' lines, then '+' lines, between common ones. None if it is too large."""
    places = common(a, b)
    if places is None:
        return None
    out, i, j = [], 0, 0
    for m, n in [*places, (len(a), len(b))]:
        out += [("-", k + 1, None, a[k]) for k in range(i, m)] + [("+", None, k + 1, b[k]) for k in range(j, n)]
        if m < len(a) and n < len(b):
            out.append((" ", m + 1, n + 1, a[m]))
        i, j = m + 1, n + 1
    return out


#: What stands in place of a diff that is too large to be made.
REFUSED = "!"


def line_diff(pairs: DataFrame) -> DataFrame:
    """pairs (path, before, after) to (path, position, side, old, new, text); one row with side REFUSED where too many lines changed."""
    names = ("path", "position", "side", "old", "new", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, a, b in zip(*(batch.column(c).to_pylist() for c in ("path", "before", "after")), strict=True):
                rows = _diff(lines_of(a), lines_of(b))
                if rows is None:
                    rows = [(REFUSED, None, None, "too many lines changed to show line by line")]
                kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string())
                columns = ([path] * len(rows), range(len(rows)), *(zip(*rows, strict=True) if rows else [()] * 4))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(names))

    return pairs.select("path", "before", "after").mapInArrow(run, "path string, position int, side string, old int, new int, text string")


#: Bytes from which a file's change isn't shown line by line, and bytes in which a NUL makes it binary (fixed values).
SHOWN_BYTES, BINARY_BYTES = 4 << 20, 8192


def file_diffs(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, kind, shown, summary, mode_changed) of two states (path, sha256, executable, text): how each change can be shown.

    shown is mode (only the mode changed), size (too large), binary or lines; only texts of the last go on to line_diff().
    """
    side = lambda t, name: t.select("path", F.struct("sha256", "executable", "text", F.octet_length("text").cast("long").alias("size")).alias(name))
    rows = side(before, "b").join(side(after, "a"), "path", "full_outer").where(~F.col("b.sha256").eqNullSafe(F.col("a.sha256")) | ~F.col("b.executable").eqNullSafe(F.col("a.executable")))
    binary = lambda x: F.coalesce(F.instr(F.substring(x, 1, BINARY_BYTES), "\x00") > 0, F.lit(False))
    kind = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "deleted").otherwise("modified")
    shown = F.when(F.col("b.sha256") == F.col("a.sha256"), "mode").when(F.greatest("b.size", "a.size") > SHOWN_BYTES, "size").when(binary(F.col("b.text")) | binary(F.col("a.text")), "binary").otherwise("lines")
    change = size_change(F.col("b.size"), F.col("a.size"))
    summary = F.when(F.col("shown") == "size", F.concat("change", F.lit(", too large to show line by line"))).when(F.col("shown") == "binary", F.concat(F.lit("binary, "), "change"))
    out = rows.select("path", kind.alias("kind"), shown.alias("shown"), change.alias("change"), (F.col("b.executable") != F.col("a.executable")).alias("mode_changed"))
    return out.select("path", "kind", "shown", summary.alias("summary"), "mode_changed")


def draft(pairs: DataFrame, labels: tuple[str, str] = ("saved on the project", "your upload")) -> DataFrame:
    """pairs (path, before, after) to (path, text, regions): both sides in one text, with markers around what differs; text is null where too much does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, regions = [], []
            for a, b in zip(batch.column("before").to_pylist(), batch.column("after").to_pylist(), strict=True):
                rows, out, n = _diff(lines_of(a), lines_of(b)), [], 0
                for same, group in groupby(rows or [], key=lambda r: r[0] == " "):
                    members = list(group)
                    if same:
                        out += [r[3] for r in members]
                    else:
                        n += 1
                        out += [f"<<<<<<< {labels[0]}", *(r[3] for r in members if r[0] == "-"), "=======", *(r[3] for r in members if r[0] == "+"), f">>>>>>> {labels[1]}"]
                texts.append(None if rows is None else "\n".join(out))
                regions.append(n if rows is not None else 1)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(texts, pa.string()), pa.array(regions, pa.int32())], names=["path", "text", "regions"])

    return pairs.select("path", "before", "after").mapInArrow(run, "path string, text string, regions int")


def folded(diff: DataFrame, context: int = 3) -> DataFrame:
    """diff with lines far from any change replaced by one row a gap: side '~' and how many lines it hides."""
    w = Window.partitionBy("path").orderBy("position")
    near = F.max((F.col("side") != " ").cast("int")).over(w.rowsBetween(-context, context)) == 1
    rows = diff.select("*", near.alias("near"))
    island = F.sum((F.col("near") != F.coalesce(F.lag("near").over(w), F.lit(True))).cast("int")).over(w)
    rows = rows.select("*", island.alias("island"))
    gaps = rows.where("not near").groupBy("path", "island").agg(F.min("position").alias("position"), F.count("*").alias("hidden"))
    shown = rows.where("near").select("path", "position", "side", F.lit(0).cast("long").alias("hidden"))
    return shown.unionByName(gaps.select("path", "position", F.lit("~").alias("side"), "hidden"))


def hunk_numbers(diff: DataFrame) -> DataFrame:
    """diff's numbers again, as running counts by side."""
    w = Window.partitionBy("path").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    old, new = F.sum((F.col("side") != "+").cast("int")).over(w), F.sum((F.col("side") != "-").cast("int")).over(w)
    return diff.select("path", "position", F.when(F.col("side") != "+", old).alias("old"), F.when(F.col("side") != "-", new).alias("new"))


def _kept(text: str) -> list[str]:
    return re.findall(r"[^\n]*\n|[^\n]+$", text)


def merge_text(base: str, ours: str, theirs: str, labels: tuple[str, str] = ("ours", "theirs")) -> tuple[str | None, int]:
    """The merge of two edits of base, and how many regions conflict; where the texts are too long to compare, None and the whole file as one conflict.

    Lines that both sides kept from base part the regions. A region that one side left alone takes the other side; alike
    edits count once; else both stand between markers.
    """
    b, o, t = _kept(base), _kept(ours), _kept(theirs)
    left, right = common(b, o, MERGE_CELLS), common(b, t, MERGE_CELLS)
    if left is None or right is None:
        return None, 1
    in_ours, in_theirs = dict(left), dict(right)
    anchors = [(k, in_ours[k], in_theirs[k]) for k in sorted(in_ours.keys() & in_theirs.keys())]
    end = "\r\n" if "\r\n" in ours else "\n"
    out, conflicts, at = [], 0, (0, 0, 0)
    for nxt in [*anchors, (len(b), len(o), len(t))]:
        x, y, z = (side[p:q] for side, p, q in zip((b, o, t), at, nxt, strict=True))
        if y == z or z == x:
            out += y
        elif y == x:
            out += z
        else:
            conflicts += 1
            full = lambda rows: rows[:-1] + [rows[-1] if rows[-1].endswith("\n") else rows[-1] + end] if rows else []
            out += [f"<<<<<<< {labels[0]}{end}", *full(y), f"======={end}", *full(z), f">>>>>>> {labels[1]}{end}"]
        if nxt[0] < len(b):
            out.append(b[nxt[0]])
        at = tuple(p + 1 for p in nxt)
    return "".join(out), conflicts


def merged(rows: DataFrame) -> DataFrame:
    """rows (path, base, ours, theirs) with text and conflicts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [merge_text(b or "", o or "", t or "") for b, o, t in zip(*(batch.column(c).to_pylist() for c in ("base", "ours", "theirs")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int32())], names=["path", "text", "conflicts"])

    return rows.select("path", "base", "ours", "theirs").mapInArrow(run, "path string, text string, conflicts int")
