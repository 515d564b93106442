"""Layered ignore rules: the last rule that matches decides, an excluded folder settles what lies below it.

Rules are a short text: they are parsed on the driver and compiled to native regular expressions, so that matching is a
projection without a join. Folders are decided once each (distinct before the expressions), and a path looks up its
outermost excluded ancestor by an equi-join on folder.
"""

from __future__ import annotations

import re
import unicodedata
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


class Rule(NamedTuple):
    number: int
    text: str
    regex: str
    negated: bool
    folders_only: bool
    whole: bool  # matched against the whole path; else against the last name


_SPECIAL = re.compile(r"[.*+?^${}()|\[\]\\]")


def regex_of(pattern: str) -> str:
    """A glob as a regular expression: * and ? stay within a name, ** crosses folders and swallows a slash after it."""
    tokens = re.compile(r"(?P<escaped>\\.)|(?P<set>\[[!^]?\]?[^\]]*\])|(?P<deep>\*\*/?)|(?P<star>\*)|(?P<any>\?)|(?P<plain>.)", re.DOTALL)

    def one(m: re.Match) -> str:
        kind, text = m.lastgroup, m[0]
        if kind == "set":
            body = text[1:-1]
            negated = body[:1] in ("!", "^")
            body = re.sub(r"([\\\^\]\[&])", r"\\\1", body[1:] if negated else body)
            return f"[^/{body}]" if negated else f"[{body}]"
        return {"escaped": _SPECIAL.sub(r"\\\g<0>", text[1:]), "deep": ".*", "star": "[^/]*", "any": "[^/]", "plain": _SPECIAL.sub(r"\\\g<0>", text)}[kind]

    return tokens.sub(one, pattern)


def parse(text: str) -> list[Rule]:
    """Rules of an ignore file, in order: comments and blank lines go; ! negates, a last / is for folders, a first / anchors."""
    out = []
    for line in re.split(r"\r?\n", text):
        body = line.strip()
        if not body or body.startswith("#"):
            continue
        negated = body.startswith("!")
        name = body[negated:].rstrip("/")
        anchored = name.startswith("/")
        name = name.lstrip("/")
        if name:
            out.append(Rule(len(out), body, f"^{regex_of(name)}$", negated, body.endswith("/"), anchored or "/" in name))
    return out


def _name(path: str) -> Column:
    return F.element_at(F.split(F.col(path), "/"), -1)


def last_match(rules: list[Rule], path: str, folder: bool) -> Column:
    """Number of the last rule that matches a path itself; null if none does."""
    numbers = [F.when((F.col(path) if r.whole else _name(path)).rlike(r.regex), F.lit(r.number)) for r in reversed(rules) if folder or not r.folders_only]
    return F.coalesce(*numbers, F.lit(None).cast("int")) if numbers else F.lit(None).cast("int")


def _excluding(rules: list[Rule], number: Column) -> Column:
    return number.isin([r.number for r in rules if not r.negated]) if rules else F.lit(False)


def folders(paths: DataFrame) -> DataFrame:
    """(path, folder, depth): each ancestor folder of each path."""
    parts = F.split("path", "/")
    rows = paths.select("path", parts.alias("p")).where(F.size("p") > 1)
    each = rows.select("path", "p", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("depth"))
    return each.select("path", F.array_join(F.slice("p", 1, F.col("depth")), "/").alias("folder"), "depth")


class Layer(NamedTuple):
    base: str  # the folder of a rule file; '' is the root
    rules: list[Rule]


def layers_of(texts: dict[str, str]) -> list[Layer]:
    """Layers, the deepest first, of rule files (folder to text). They are small texts on the driver; they become one projection."""
    return [Layer(base, parse(texts[base])) for base in sorted(texts, key=lambda b: (-len(b), b))]


def _last_in_layers(rows: DataFrame, path: str, layers: list[Layer], folder: bool) -> DataFrame:
    """rows with `_found`: layer, number and negated of the last rule that matches, the deepest layer first; null if none does."""
    below = {i: F.col(path).substr(F.lit(len(layer.base) + 2 if layer.base else 1), F.char_length(path)) for i, layer in enumerate(layers)}
    rows = rows.select("*", *(x.alias(f"_below{i}") for i, x in below.items()))
    found = []
    for i, layer in enumerate(layers):
        number = last_match(layer.rules, f"_below{i}", folder)
        inside = F.col(path).startswith(f"{layer.base}/") if layer.base else F.lit(True)
        shut = F.coalesce(_excluding(layer.rules, number), F.lit(False))
        found.append(F.when(inside & number.isNotNull(), F.struct(F.lit(layer.base).alias("layer"), number.alias("number"), shut.alias("shut"))))
    return rows.select("*", F.coalesce(*found).alias("_found")).drop(*(f"_below{i}" for i in below))


def settled(paths: DataFrame, layers: list[Layer], tracked: DataFrame | None = None) -> DataFrame:
    """paths (path, ...) with layer and rule of what settles each, and excluded.

    Folders are decided once each. The outermost excluded one settles all below it, whatever a deeper layer says; else the path's own
    last rule does. Paths in tracked (path) aren't excluded.
    """
    every = folders(paths.select("path"))
    shut = _last_in_layers(every.select("folder").distinct(), "folder", layers, True).where("_found.shut")
    outermost = every.join(shut, "folder").groupBy("path").agg(F.min_by("_found", "depth").alias("_above"))
    rows = _last_in_layers(paths, "path", layers, False).withColumnRenamed("_found", "_own").join(outermost, "path", "left")
    kept = F.lit(False)
    if tracked is not None:
        rows = rows.join(tracked.select("path", F.lit(True).alias("_tracked")).distinct(), "path", "left")
        kept = F.coalesce("_tracked", F.lit(False))
    rows = rows.select("*", F.coalesce("_above", "_own").alias("_by"), kept.alias("_kept"))
    return rows.select(*paths.columns, F.col("_by.layer").alias("layer"), F.col("_by.number").alias("rule"), (F.coalesce("_by.shut", F.lit(False)) & ~F.col("_kept")).alias("excluded"))


def decide(paths: DataFrame, text: str) -> DataFrame:
    """paths (path, ...) with rule (number of the deciding one, or null) and excluded, by one rule file at the root."""
    return settled(paths, layers_of({"": text})).drop("layer")


def evaluate(files: DataFrame, text: str) -> DataFrame:
    """(rule, excluded, files, bytes): what each rule excludes or keeps, and rule -1 for what no rule names."""
    rows = decide(files.select("path", "size"), text)
    return rows.groupBy(F.coalesce("rule", F.lit(-1)).alias("rule"), "excluded").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def excluded_files(files: DataFrame, text: str) -> DataFrame:
    """(path, size, rule, place): files that a rule excludes, the largest of each rule first."""
    rows = decide(files.select("path", "size"), text).where("excluded")
    return rows.select("path", "size", "rule", F.row_number().over(Window.partitionBy("rule").orderBy(F.desc("size"), "path")).alias("place"))


def tree(files: DataFrame, empty: DataFrame | None = None) -> DataFrame:
    """(folder, depth, files, bytes): sizes rolled up to every ancestor folder; '' is the root. Folders of empty (path) are listed too."""
    below = folders(files.select("path")).join(files.select("path", "size"), "path").select("folder", "depth", "size")
    root = files.select(F.lit("").alias("folder"), F.lit(0).alias("depth"), "size")
    rows = below.unionByName(root)
    if empty is not None:
        listed = folders(empty.select("path")).select("folder", "depth").unionByName(empty.select(F.col("path").alias("folder"), F.size(F.split("path", "/")).alias("depth")))
        rows = rows.unionByName(listed.distinct().select("*", F.lit(None).cast("long").alias("size")))
    return rows.groupBy("folder", "depth").agg(F.count("size").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def under(paths: DataFrame, names: DataFrame) -> DataFrame:
    """paths that equal one of names (name) or lie below it: an equi-join on every prefix of a path."""
    prefixes = folders(paths.select("path")).select("path", F.col("folder").alias("name")).unionByName(paths.select("path", F.col("path").alias("name")))
    return paths.join(prefixes.join(names.select("name"), "name", "left_semi").select("path").distinct(), "path", "left_semi")


def _meant(part: Column) -> Column:
    """A name as file systems that are lenient read it: without a stream, and without dots and spaces at its end."""
    return F.lower(F.regexp_replace(F.split_part(part, F.lit(":"), F.lit(1)), "[. ]+$", ""))


def _part_problem(part: Column) -> Column:
    name = _meant(part)
    return F.when(part == "..", "outside").when((name == ".git") | name.rlike(r"^git~[0-9]+$"), "git").when(name == ".cbx", "history")


def unsafe(path: str) -> Column:
    """Why a path may not be written below a root, by its first part that is at fault; null if it may."""
    parts = F.filter(F.transform(F.split(F.col(path), r"[\\/]"), _part_problem), lambda p: p.isNotNull())
    return (
        F.when(F.coalesce(F.col(path), F.lit("")) == "", "empty")
        .when(F.instr(path, "\x00") > 0, "nul")
        .when(F.col(path).rlike(r"^([\\/]|[A-Za-z]:)"), "absolute")
        .otherwise(F.get(parts, F.lit(0)))
    )


def unwritable(path: str) -> Column:
    """Why a path can't be written on every system; null if it can."""
    parts = F.split(F.col(path), "/")
    any_part = lambda pattern: F.exists(parts, lambda p: p.rlike(pattern))
    return (
        F.when(F.char_length(path) > 4096, "long")
        .when(F.exists(parts, lambda p: F.char_length(p) > 255), "long")
        .when(any_part(r'[<>:"|?*\x00-\x1f]'), "characters")
        .when(any_part(r"[. ]$"), "end")
        .when(any_part(r"(?i)^(con|prn|aux|nul|com[0-9]|lpt[0-9])(\.|$)"), "device")
        .otherwise(unsafe(path))
    )


@F.pandas_udf(StringType())
def _composed(names):  # noqa: ANN001, ANN202
    return names.map(lambda s: unicodedata.normalize("NFC", s))


def collisions(paths: DataFrame) -> DataFrame:
    """(folded, paths): paths that differ in case or in Unicode form alone. Only names beyond ASCII leave the JVM."""
    plain = F.col("path").rlike(r"^[\x00-\x7f]*$")
    rows = paths.where(plain).select("path").unionByName(paths.where(~plain).select(_composed("path").alias("path")))
    return rows.groupBy(F.lower("path").alias("folded")).agg(F.count("*").alias("paths")).where("paths > 1")


def file_and_folder(paths: DataFrame) -> DataFrame:
    """(path): paths that other paths have as a folder."""
    return paths.select("path").distinct().join(folders(paths.select("path")).select(F.col("folder").alias("path")).distinct(), "path", "left_semi")


def artifact(path: str, patterns: tuple[str, ...]) -> Column:
    """Whether one of the patterns names a path or a folder above it: ** is any number of folders, * is part of a name, the rest is plain."""
    found = F.lit(False)
    for pattern in patterns:
        source = "/".join(".*" if part == "**" else "[^/]*".join(_SPECIAL.sub(r"\\\g<0>", x) for x in part.split("*")) for part in pattern.split("/"))
        found = found | F.col(path).rlike(f"^{source}$") | F.startswith(F.col(path), F.lit(f"{pattern}/"))
    return found
