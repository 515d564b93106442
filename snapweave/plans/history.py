"""Queries of snapshot algebra and the graph of saves, each with DuckDB SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapweave.operators import graph, snapshots
from snapweave.sources.shapes import SHAPES, save_edges, saves, snapshot, versions

WITH = f"WITH RECURSIVE {SHAPES}"
_SAME = "({0}.sha256 = {1}.sha256 AND {0}.executable = {1}.executable)"


def _three(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(snapshot(spark, d, s) for s in ("base", "ours", "theirs"))


def compare_trees(spark, d):
    return snapshots.compare(snapshot(spark, d, "base"), snapshot(spark, d, "ours"))


def checkout_plan(spark, d):
    return snapshots.checkout_plan(snapshot(spark, d, "ours"), snapshot(spark, d, "theirs"))


def merge_decisions(spark, d):
    return snapshots.three_way(*_three(spark, d)).select("path", "decision")


def merge_tree(spark, d):
    return snapshots.merged(*_three(spark, d))


def in_the_way(spark, d):
    base, ours, theirs = _three(spark, d)
    return snapshots.in_the_way(ours, base, theirs)


def reuse_stored(spark, d):
    return snapshots.reuse(snapshot(spark, d, "ours"), snapshot(spark, d, "theirs"))


def publication_outcomes(spark, d):
    base, ours, theirs = _three(spark, d)
    return snapshots.publication(base, base.where("size % 7 <> 0"), ours, theirs)


def reconcile_download(spark, d):
    base, ours, theirs = _three(spark, d)
    return snapshots.reconcile(base, ours, theirs)


def published_files(spark, d):
    base, ours, _ = _three(spark, d)
    changed = snapshots.compare(base, ours)
    removed = changed.where("change = 'deleted'")
    return snapshots.published(base, removed, ours.join(changed.where("change <> 'deleted'"), "path", "left_semi"))


def new_bytes(spark, d):
    return snapshots.held_and_new(snapshot(spark, d, "ours"), snapshot(spark, d, "base"))


def duplicate_files(spark, d):
    return snapshots.duplicates(snapshot(spark, d, "base"))


def digest_sets(spark, d):
    return snapshots.equal_digests(snapshot(spark, d, "ours"), snapshot(spark, d, "theirs"))


def save_summary(spark, d):
    return snapshot(spark, d, "base").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.count_if("executable").alias("executables"))


def retained_base(spark, d):
    base, ours, _ = _three(spark, d)
    return base.select("path").join(snapshots.compare(base, ours).select("path"), "path", "left_anti")


def utf16_order(spark, d):
    """Paths in the order that trees are hashed in: by UTF-16 code unit; the place of each within its folder."""
    from pyspark.sql import Window

    rows = snapshot(spark, d, "base").select("path", F.regexp_extract("path", "^(.*)/", 1).alias("folder"), F.hex(F.encode("path", "UTF-16BE")).alias("units"))
    return rows.select("path", F.row_number().over(Window.partitionBy("folder").orderBy("units")).alias("place"))


def _start(spark, d):
    """The deepest save, the latest of several."""
    return saves(spark, d).orderBy(F.desc("turn"), F.desc("conv_id")).limit(1).select("id")


def ancestors(spark, d):
    return graph.ancestors(save_edges(spark, d), _start(spark, d))


def within_depth(spark, d):
    return graph.ancestors(save_edges(spark, d), _start(spark, d), 4)


def merge_base(spark, d):
    line = saves(spark, d).orderBy(F.desc("turn"), F.desc("conv_id")).limit(1).select((F.col("conv_id") - 1).alias("conv_id"))
    other = saves(spark, d).join(line, "conv_id").orderBy(F.desc("turn")).limit(1).select("id")
    return graph.merge_base(save_edges(spark, d), _start(spark, d), other)


def first_parent_log(spark, d):
    return graph.first_parents(save_edges(spark, d), _start(spark, d))


def topological_levels(spark, d):
    return graph.levels(save_edges(spark, d), saves(spark, d))


def history_left_out(spark, d):
    return graph.left_out(save_edges(spark, d), _start(spark, d), saves(spark, d).where("turn % 2 = 0"))


def fork_point(spark, d):
    return graph.fork_point(save_edges(spark, d), _start(spark, d), saves(spark, d).where("turn <= 1"))


def _pairs(spark, d):
    tips = saves(spark, d).groupBy("conv_id").agg(F.max("turn").alias("turn"))
    tip = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    rows = tips.select("conv_id", tip.alias("b"))
    back = F.concat_ws("/", (F.col("conv_id") - F.col("conv_id") % 3).cast("string"), F.lit("0"))
    return rows.select(back.alias("a"), "b").distinct()


def is_ancestor(spark, d):
    return graph.is_ancestor(save_edges(spark, d), _pairs(spark, d))


def ancestry_relation(spark, d):
    return graph.relation(save_edges(spark, d), _pairs(spark, d))


def line_tips(spark, d):
    return graph.tips(saves(spark, d), "conv_id", "turn")


def log_positions(spark, d):
    return graph.numbered(saves(spark, d), "conv_id", "turn").select("id", "back")


def delta_chains(spark, d):
    return graph.chain_depth(save_edges(spark, d), saves(spark, d), 4)


def shortest_route(spark, d):
    """Step and depth agree with SQL for any shortest way, so the way is given by its steps."""
    source = _start(spark, d)
    far = graph.ancestors(save_edges(spark, d), source).orderBy(F.desc("depth"), "id").limit(1).select("id")
    return graph.route(save_edges(spark, d), source, far).groupBy("step").agg(F.count("*").alias("nodes"))


def version_delta(spark, d):
    """What each version has more than the one before it."""
    from pyspark.sql import Window

    w = Window.partitionBy("project").orderBy("sequence")
    return versions(spark, d).select("project", "sequence", (F.col("files") - F.coalesce(F.lag("files").over(w), F.lit(0))).alias("files"), (F.col("source") - F.coalesce(F.lag("source").over(w), F.lit(0))).alias("source"))


def record_digests(spark, d):
    """Each save as a record with keys in their order, hashed as it stands: the identity of saves. Nulls don't enter a hashed record."""
    edges = save_edges(spark, d).groupBy(F.col("child").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "parent"))), lambda x: x["parent"]).alias("parents"))
    rows = saves(spark, d).join(edges, "id", "left")
    record = F.struct(F.col("id").alias("tree"), F.coalesce("parents", F.array().cast("array<string>")).alias("parents"), F.lit("main").alias("line"), F.concat(F.lit('turn "'), F.col("turn").cast("string"), F.lit('"')).alias("message"))
    return rows.select("id", F.sha2(F.to_json(record), 256).alias("digest"))


_STARTED = "(SELECT id, conv_id FROM saves ORDER BY turn DESC, conv_id DESC LIMIT 1)"
_CLIMB = "up(id, depth) AS (SELECT id, 0 FROM {start} UNION SELECT parent, depth + 1 FROM up JOIN edges ON child = id WHERE depth < {limit} {more})"
_TIPS = "pairs AS (SELECT DISTINCT concat(conv_id - conv_id % 3, '/0') AS a, concat(conv_id, '/', t) AS b FROM (SELECT conv_id, max(turn) AS t FROM saves GROUP BY conv_id))"
_REACH = "ways AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reach(root, node) AS (SELECT b, b FROM ways UNION SELECT root, parent FROM reach JOIN edges ON child = node)"
_DECIDE = f"""CASE WHEN {_SAME.format("o", "t")} OR (o.path IS NULL AND t.path IS NULL) THEN 'same'
 WHEN {_SAME.format("b", "o")} OR (b.path IS NULL AND o.path IS NULL) THEN 'theirs'
 WHEN {_SAME.format("b", "t")} OR (b.path IS NULL AND t.path IS NULL) THEN 'ours'
 WHEN o.sha256 = t.sha256 THEN 'exec-bit' WHEN t.path IS NULL THEN 'deleted-there' WHEN o.path IS NULL THEN 'deleted-here' ELSE 'content' END"""
_ALL = "(SELECT path FROM base UNION SELECT path FROM ours UNION SELECT path FROM theirs) p LEFT JOIN base b USING (path) LEFT JOIN ours o USING (path) LEFT JOIN theirs t USING (path)"
_CHANGE = f"changed AS (SELECT path, CASE WHEN b.path IS NULL THEN 'added' WHEN o.path IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM base b FULL JOIN ours o USING (path) WHERE ({_SAME.format('b', 'o')}) IS NOT TRUE)"

QUERIES = {
    "compare_trees": (compare_trees, f"{WITH}, {_CHANGE} SELECT * FROM changed"),
    "checkout_plan": (checkout_plan, f"{WITH} SELECT path, CASE WHEN t.path IS NULL THEN 'remove' ELSE 'write' END AS action, t.sha256 AS sha256 FROM ours o FULL JOIN theirs t USING (path) WHERE ({_SAME.format('o', 't')}) IS NOT TRUE"),
    "merge_decisions": (merge_decisions, f"{WITH} SELECT path, {_DECIDE} AS decision FROM {_ALL}"),
    "merge_tree": (
        merge_tree,
        f"""{WITH}, m AS (SELECT path, {_DECIDE} AS decision, b.executable AS be, o.size AS os, o.sha256 AS oh, o.executable AS oe, t.size AS ts, t.sha256 AS th, t.executable AS te FROM {_ALL}),
r AS (SELECT *, decision IN ('theirs', 'deleted-here') AS other FROM m)
SELECT path, decision, CASE WHEN other THEN ts ELSE os END AS size, CASE WHEN other THEN th ELSE oh END AS sha256,
 CASE WHEN decision = 'exec-bit' THEN CASE WHEN be IS NOT NULL AND be <> oe THEN oe ELSE te END WHEN other THEN te ELSE oe END AS executable FROM r WHERE CASE WHEN other THEN th ELSE oh END IS NOT NULL""",
    ),
    "in_the_way": (
        in_the_way,
        f"""{WITH} SELECT path FROM {_ALL} WHERE ({_SAME.format("b", "t")}) IS NOT TRUE AND (b.path IS NOT NULL OR t.path IS NOT NULL) AND o.path IS NOT NULL
 AND ({_SAME.format("o", "b")}) IS NOT TRUE AND ({_SAME.format("o", "t")}) IS NOT TRUE""",
    ),
    "reuse_stored": (
        reuse_stored,
        f"""{WITH}, twins AS (SELECT sha256, min(path) AS twin FROM theirs GROUP BY sha256)
SELECT o.path AS path, CASE WHEN t.sha256 = o.sha256 THEN o.path ELSE twin END AS source, CASE WHEN t.sha256 = o.sha256 THEN 'path' WHEN twin IS NOT NULL THEN 'digest' ELSE 'send' END AS how
FROM ours o LEFT JOIN theirs t USING (path) LEFT JOIN twins w ON w.sha256 = o.sha256""",
    ),
    "publication_outcomes": (
        publication_outcomes,
        f"""{WITH}, l AS (SELECT * FROM base WHERE size % 7 <> 0)
SELECT path, CASE WHEN o.sha256 = t.sha256 THEN 'unchanged' WHEN o.path IS NULL AND t.path IS NULL THEN 'stays-deleted'
 WHEN o.path IS NULL AND (l.path IS NULL OR t.sha256 IS DISTINCT FROM b.sha256) THEN 'keep-head' WHEN o.path IS NULL THEN 'deleted'
 WHEN o.sha256 = l.sha256 THEN CASE WHEN t.path IS NULL THEN 'stays-deleted' ELSE 'keep-head' END WHEN t.sha256 IS DISTINCT FROM b.sha256 THEN 'conflict' ELSE 'saved' END AS outcome
FROM {_ALL} LEFT JOIN l USING (path)""",
    ),
    "reconcile_download": (
        reconcile_download,
        f"""{WITH} SELECT path, CASE WHEN t.path IS NULL AND o.path IS NULL THEN 'nothing' WHEN t.path IS NULL THEN CASE WHEN o.sha256 = b.sha256 THEN 'delete' ELSE 'keep' END
 WHEN o.sha256 = t.sha256 THEN 'skip' ELSE 'fetch' END AS action FROM {_ALL}""",
    ),
    "published_files": (
        published_files,
        f"""{WITH}, {_CHANGE} SELECT * FROM base WHERE path NOT IN (SELECT path FROM changed) UNION ALL SELECT * FROM ours WHERE path IN (SELECT path FROM changed WHERE change <> 'deleted')""",
    ),
    "new_bytes": (
        new_bytes,
        f"""{WITH}, e AS (SELECT sha256, count(*) AS files, min(size) AS size FROM ours GROUP BY sha256)
SELECT sha256 IN (SELECT sha256 FROM base) AS held, CAST(sum(files) AS BIGINT) AS files, count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes FROM e GROUP BY held""",
    ),
    "duplicate_files": (duplicate_files, f"{WITH} SELECT sha256, min(path) AS first, count(*) AS copies, min(size) * (count(*) - 1) AS wasted FROM base GROUP BY sha256 HAVING count(*) > 1"),
    "digest_sets": (
        digest_sets,
        f"""{WITH}, m AS (SELECT l.sha256 AS l, r.sha256 AS r FROM (SELECT DISTINCT sha256 FROM ours) l FULL JOIN (SELECT DISTINCT sha256 FROM theirs) r USING (sha256))
SELECT count(*) FILTER (r IS NULL) AS only_left, count(*) FILTER (l IS NULL) AS only_right, count(*) FILTER (r IS NULL OR l IS NULL) = 0 AS equal FROM m""",
    ),
    "save_summary": (save_summary, f"{WITH} SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, count(*) FILTER (executable) AS executables FROM base"),
    "retained_base": (retained_base, f"{WITH}, {_CHANGE} SELECT path FROM base WHERE path NOT IN (SELECT path FROM changed)"),
    "utf16_order": (utf16_order, f"{WITH} SELECT path, row_number() OVER (PARTITION BY regexp_extract(path, '^(.*)/', 1) ORDER BY path) AS place FROM base"),
    "ancestors": (ancestors, f"{WITH}, {_CLIMB.format(start=_STARTED, limit=1000, more='')} SELECT id, min(depth) AS depth FROM up GROUP BY id"),
    "within_depth": (within_depth, f"{WITH}, {_CLIMB.format(start=_STARTED, limit=4, more='')} SELECT id, min(depth) AS depth FROM up GROUP BY id"),
    "merge_base": (
        merge_base,
        f"""{WITH}, l(id) AS (SELECT id FROM {_STARTED} UNION SELECT parent FROM l JOIN edges ON child = id),
r(id, depth, way) AS (SELECT id, 0, CAST([] AS INTEGER[]) FROM (SELECT id FROM saves WHERE conv_id = (SELECT conv_id - 1 FROM {_STARTED}) ORDER BY turn DESC LIMIT 1) UNION SELECT parent, depth + 1, list_append(way, nth) FROM r JOIN edges ON child = id)
SELECT id, depth FROM r WHERE id IN (SELECT id FROM l) ORDER BY depth, way LIMIT 1""",
    ),
    "first_parent_log": (first_parent_log, f"{WITH}, {_CLIMB.format(start=_STARTED, limit=1000, more='AND nth = 0')} SELECT id, min(depth) AS depth FROM up GROUP BY id"),
    "topological_levels": (topological_levels, f"{WITH}, down(id, level) AS (SELECT id, 0 FROM saves WHERE id NOT IN (SELECT child FROM edges) UNION SELECT child, level + 1 FROM down JOIN edges ON parent = id) SELECT id, max(level) AS level FROM down GROUP BY id"),
    "history_left_out": (history_left_out, f"{WITH}, {_CLIMB.format(start=_STARTED, limit=1000, more='')} SELECT DISTINCT id FROM up WHERE id NOT IN (SELECT id FROM saves WHERE turn % 2 = 0)"),
    "fork_point": (fork_point, f"{WITH}, {_CLIMB.format(start=_STARTED, limit=1000, more='AND nth = 0')} SELECT id, depth FROM up WHERE id IN (SELECT id FROM saves WHERE turn <= 1) ORDER BY depth LIMIT 1"),
    "is_ancestor": (is_ancestor, f"{WITH}, {_TIPS}, {_REACH} SELECT a, b, (b, a) IN (SELECT (root, node) FROM reach) AS reached FROM pairs"),
    "ancestry_relation": (
        ancestry_relation,
        f"""{WITH}, {_TIPS}, {_REACH}, kin AS (SELECT DISTINCT x.root AS a, y.root AS b FROM reach x JOIN reach y USING (node) WHERE node NOT IN (SELECT child FROM edges))
SELECT a, b, CASE WHEN a = b THEN 'up-to-date' WHEN (b, a) IN (SELECT (root, node) FROM reach) THEN 'fast-forward' WHEN (a, b) IN (SELECT (root, node) FROM reach) THEN 'behind'
 WHEN (a, b) IN (SELECT (a, b) FROM kin) THEN 'diverged' ELSE 'unrelated' END AS relation FROM pairs""",
    ),
    "record_digests": (
        record_digests,
        f"""{WITH}, p AS (SELECT child AS id, string_agg('"' || parent || '"', ',' ORDER BY nth) AS parents FROM edges GROUP BY child)
SELECT id, sha256('{{"tree":"' || id || '","parents":[' || coalesce(parents, '') || '],"line":"main","message":"turn \\"' || turn || '\\""}}') AS digest FROM saves LEFT JOIN p USING (id)""",
    ),
    "line_tips": (line_tips, f"{WITH} SELECT conv_id, arg_max(id, turn) AS tip FROM saves GROUP BY conv_id"),
    "log_positions": (log_positions, f"{WITH} SELECT id, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1 AS back FROM saves"),
    "delta_chains": (delta_chains, f"{WITH}, c(id, depth) AS (SELECT id, 0 FROM saves WHERE id NOT IN (SELECT child FROM edges WHERE nth = 0) UNION SELECT child, CASE WHEN depth + 1 > 4 THEN 0 ELSE depth + 1 END FROM c JOIN edges ON parent = id AND nth = 0) SELECT id, depth, depth = 0 AS whole FROM c"),
    "shortest_route": (
        shortest_route,
        f"""{WITH}, {_CLIMB.format(start=_STARTED, limit=1000, more='')}, far AS (SELECT min(depth) AS depth FROM up GROUP BY id ORDER BY 1 DESC LIMIT 1)
SELECT CAST(unnest(generate_series(0, (SELECT depth FROM far))) AS INTEGER) AS step, 1 AS nodes""",
    ),
    "version_delta": (version_delta, f"{WITH} SELECT project, sequence, files - coalesce(lag(files) OVER w, 0) AS files, source - coalesce(lag(source) OVER w, 0) AS source FROM versions WINDOW w AS (PARTITION BY project ORDER BY sequence)"),
}
