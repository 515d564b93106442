"""The graph of saves: closures, bases, routes and orders over edges (child, parent, nth).

Recursive SQL visits a node once for each path to it, which doubles at every diamond. These are loops over frontiers
instead: one join and one anti join a round, lineage cut each round, and every node is seen once. Rounds are as many as the
graph is deep from where the search starts; the driver only asks whether a frontier is empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snapweave.functions.lineage import cut


class Grown:
    """A table that grows by a part a round. Each part is written once; after TOGETHER of them they become one."""

    TOGETHER = 12

    def __init__(self, first: DataFrame):
        self.parts = [first]

    def add(self, part: DataFrame) -> None:
        self.parts.append(part)
        if len(self.parts) > self.TOGETHER:
            self.parts = [cut(self.all())]

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.parts)


def ancestors(edges: DataFrame, start: DataFrame, depth: int | None = None) -> DataFrame:
    """(id, depth): everything that start (id) reaches through all parents, itself at depth 0; depth is the least."""
    up = cut(edges.select(F.col("child").alias("id"), "parent").distinct())
    frontier, n = cut(start.select("id").distinct().select("id", F.lit(0).alias("depth"))), 0
    seen = Grown(frontier)
    while depth is None or n < depth:
        n += 1
        found = frontier.select("id").join(up, "id").select(F.col("parent").alias("id")).distinct()
        frontier = cut(found.join(seen.all().select("id"), "id", "left_anti").select("id", F.lit(n).alias("depth")))
        if frontier.isEmpty():
            break
        seen.add(frontier)
    return seen.all()


def is_ancestor(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) with `reached`: whether a lies among the ancestors of b.

    All starts b search together. A start whose pairs are all settled stops, so what is held is what open starts have seen.
    """
    up = cut(edges.select(F.col("child").alias("at"), "parent").distinct())
    open_ = cut(pairs.select("a", F.col("b").alias("root")).distinct())
    frontier = cut(open_.select("root", F.col("root").alias("at")).distinct())
    seen, hits = Grown(frontier), Grown(cut(open_.join(frontier, (open_["root"] == frontier["root"]) & (open_["a"] == frontier["at"]), "left_semi")))
    while True:
        open_ = cut(open_.join(hits.parts[-1], ["a", "root"], "left_anti"))
        live = frontier.join(open_.select("root").distinct(), "root", "left_semi")
        found = live.join(up, "at").select("root", F.col("parent").alias("at")).distinct()
        frontier = cut(found.join(seen.all(), ["root", "at"], "left_anti"))
        if frontier.isEmpty():
            break
        seen.add(frontier)
        hits.add(cut(frontier.select("root", F.col("at").alias("a")).join(open_, ["root", "a"], "left_semi").select("a", "root")))
    reached = hits.all().select("a", F.col("root").alias("b"), F.lit(True).alias("reached"))
    return pairs.join(reached, ["a", "b"], "left").select("a", "b", F.coalesce("reached", F.lit(False)).alias("reached"))


def merge_base(edges: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, depth): the common ancestor that a search from right, breadth first and first parents first, meets first.

    The order of such a search is that of the ways to a save, as lists of which parent was taken, by length and then in order.
    """
    mine = cut(ancestors(edges, left).select("id"))
    up = cut(edges.select(F.col("child").alias("id"), "parent", "nth"))
    frontier, n = cut(right.select("id").distinct().select("id", F.array().cast("array<int>").alias("way"))), 0
    seen = Grown(frontier.select("id"))
    while not frontier.isEmpty():
        met = frontier.join(mine, "id", "left_semi").orderBy("way").limit(1)
        if not met.isEmpty():
            return met.select("id", F.lit(n).alias("depth"))
        n += 1
        found = frontier.join(up, "id").groupBy(F.col("parent").alias("id")).agg(F.min(F.concat("way", F.array(F.col("nth").cast("int")))).alias("way"))
        frontier = cut(found.join(seen.all(), "id", "left_anti"))
        seen.add(frontier.select("id"))
    return frontier.select("id", F.lit(n).alias("depth"))


def first_parents(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(id, depth): the chain of first parents from start."""
    return ancestors(edges.where("nth = 0"), start)


def route(edges: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """(id, step): a shortest way from source up to target, from source on; each node keeps the parent it was found by first."""
    down = cut(ancestors(edges, source))
    step = edges.join(down.select(F.col("id").alias("child"), F.col("depth").alias("dc")), "child").join(down.select(F.col("id").alias("parent"), F.col("depth").alias("dp")), "parent").where("dp = dc + 1")
    chosen = cut(step.groupBy("parent").agg(F.min("child").alias("by")))
    at = cut(target.select("id").join(down, "id").select("id", F.col("depth").alias("step")))
    way = Grown(at)
    while not at.isEmpty():
        at = cut(at.join(chosen, F.col("id") == F.col("parent")).select(F.col("by").alias("id"), (F.col("step") - 1).alias("step")))
        way.add(at)
    return way.all()


def levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, level): 0 without parents, else one more than the greatest level of a parent; parents come first by (level, id).

    A parent that isn't among nodes counts as absent. A node gets its level once none of its edges waits; a round writes the latest level
    and the edges that go on waiting, which shrink, never what is done.
    """
    known = cut(nodes.select("id").distinct())
    waiting = cut(edges.join(known.select(F.col("id").alias("parent")), "parent", "left_semi").join(known.select(F.col("id").alias("child")), "child", "left_semi").select("child", "parent").distinct())
    latest, n = cut(known.join(waiting.select(F.col("child").alias("id")), "id", "left_anti").select("id", F.lit(0).alias("level"))), 0
    done = Grown(latest)
    while True:
        n += 1
        marked = waiting.join(latest.select(F.col("id").alias("parent"), F.lit(1).alias("now")), "parent", "left").groupBy("child").agg(F.bool_and(F.col("now").isNotNull()).alias("ready"), F.array_compact(F.collect_list(F.when(F.col("now").isNull(), F.col("parent")))).alias("left"))
        marked = cut(marked)
        latest = marked.where("ready").select(F.col("child").alias("id"), F.lit(n).alias("level"))
        if latest.isEmpty():
            return done.all()
        waiting = marked.where("not ready").select("child", F.explode("left").alias("parent"))
        done.add(latest)


def left_out(edges: DataFrame, heads: DataFrame, imported: DataFrame) -> DataFrame:
    """(id): ancestors of heads that weren't imported."""
    return ancestors(edges, heads).select("id").join(imported.select("id"), "id", "left_anti")


def fork_point(edges: DataFrame, head: DataFrame, published: DataFrame) -> DataFrame:
    """(id, depth): the newest save on the chain of first parents that is published."""
    return first_parents(edges, head).join(published.select("id"), "id", "left_semi").orderBy("depth").limit(1)


def relation(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) with `relation`: up-to-date, fast-forward, behind, diverged or unrelated."""
    pairs = cut(pairs.select("a", "b").distinct())
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    seen = cut(is_ancestor(edges, both))
    forth = seen.select("a", "b", F.col("reached").alias("ab"))
    back = seen.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("reached").alias("ba"))
    rows = cut(pairs.join(forth, ["a", "b"]).join(back, ["a", "b"]))
    # only pairs that neither way settles ask for a root in common, each by the roots of its own two sides
    apart = rows.where("not ab and not ba").select("a", "b")
    roots = cut(roots_of(edges, apart.select(F.col("a").alias("id")).unionByName(apart.select(F.col("b").alias("id"))).distinct()))
    kin = apart.join(roots.select(F.col("id").alias("a"), "root"), "a").join(roots.select(F.col("id").alias("b"), "root"), ["b", "root"]).select("a", "b").distinct().withColumn("kin", F.lit(True))
    rows = rows.join(kin, ["a", "b"], "left")
    how = F.when(F.col("a") == F.col("b"), "up-to-date").when(F.col("ab"), "fast-forward").when(F.col("ba"), "behind").when(F.col("kin"), "diverged").otherwise("unrelated")
    return rows.select("a", "b", how.alias("relation"))


def roots_of(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, root): the saves without parents that each of nodes reaches."""
    up = cut(edges.select(F.col("child").alias("root"), "parent").distinct())
    frontier = cut(nodes.select("id", F.col("id").alias("root")).distinct())
    seen = Grown(frontier)
    while not frontier.isEmpty():
        found = frontier.join(up, "root").select("id", F.col("parent").alias("root")).distinct()
        frontier = cut(found.join(seen.all(), ["id", "root"], "left_anti"))
        seen.add(frontier)
    return seen.all().join(up.select("root").distinct(), "root", "left_anti").select("id", "root")


def chain_depth(edges: DataFrame, nodes: DataFrame, cap: int) -> DataFrame:
    """(id, depth, whole): how many first parents each node's delta leans on; from cap on a node is stored whole."""
    chain = edges.where("nth = 0").select(F.col("child").alias("id"), "parent")
    latest = cut(nodes.join(chain.select("id"), "id", "left_anti").select("id", F.lit(0).alias("depth")))
    depth = Grown(latest)
    while not latest.isEmpty():
        above = latest.select(F.col("id").alias("parent"), "depth")
        latest = cut(above.join(chain, "parent").select("id", F.when(F.col("depth") + 1 > cap, 0).otherwise(F.col("depth") + 1).alias("depth")))
        depth.add(latest)
    return depth.all().select("id", "depth", (F.col("depth") == 0).alias("whole"))


def tips(saves: DataFrame, line: str, order: str) -> DataFrame:
    """(line, tip): the newest save of each line."""
    return saves.groupBy(line).agg(F.max_by("id", order).alias("tip"))


def numbered(saves: DataFrame, line: str, order: str) -> DataFrame:
    """saves with `back`, so that "tip~back" names each: 0 is the tip."""
    return saves.select("*", (F.row_number().over(Window.partitionBy(line).orderBy(F.desc(order))) - 1).alias("back"))
