"""Queries of listings, deltas and packs, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from snapweave.functions.lineage import cut
from snapweave.operators import content, detect, graph, listing, text
from snapweave.plans.history import _ALL, _DECIDE, _start
from snapweave.plans.reports import OURS_TEXT, pair_sql
from snapweave.sources.shapes import SHAPES, contents, files, save_edges, saves, snapshot

WITH = f"WITH RECURSIVE {SHAPES}"
LAYERS = {"": "*.log\n*.png\nen/\n", "fr": "!*.log\nsrc3/*.bin", "fr/src1": "*.md\n!*.png"}
COMMANDS = ("bundle", "checkout", "diff", "merge", "restore", "status", "switch")


def layered_rules(spark, d):
    return listing.layered(snapshot(spark, d, "base").select("path"), LAYERS)


def tracked_files(spark, d):
    """The same layers, where the executable files of the other side are tracked."""
    tracked = snapshot(spark, d, "theirs").where("executable").select("path")
    return listing.layered(snapshot(spark, d, "base").select("path"), LAYERS, tracked)


def cached_digests(spark, d):
    rows = snapshot(spark, d, "ours").withColumn("mtime", F.col("size") % 3 * 1000.0)
    chunks = F.when(F.col("size") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("sha256"))
    index = snapshot(spark, d, "base").withColumns({"mtime": F.when(F.col("executable"), -1.0).otherwise(F.col("size") % 3 * 1000.0), "chunks": chunks})
    return listing.cached(rows, index, 3500.0, store=True)


def changed_paths(spark, d):
    """The first 40 changes, spread over folders: the report's limit."""
    return listing.changed_rows(snapshot(spark, d, "base"), snapshot(spark, d, "ours"), True, 40)[0]


def changes_only(spark, d):
    return listing.changes_only(snapshot(spark, d, "base"), snapshot(spark, d, "theirs"))


def status_lists(spark, d):
    return listing.status(snapshot(spark, d, "theirs"), snapshot(spark, d, "base"), snapshot(spark, d, "ours"))


def release_check(spark, d):
    return listing.released(snapshot(spark, d, "base"), snapshot(spark, d, "ours"))


def objects_by_prefix(spark, d):
    names = snapshot(spark, d, "base").select(F.col("sha256").alias("name"))
    asked = snapshot(spark, d, "ours").select(F.expr("substring(sha256, 1, cast(3 + size % 4 as int))").alias("prefix")).distinct()
    return listing.by_prefix(names, asked)


def alike_projects(spark, d):
    """At most five for each name: the report's limit."""
    name = lambda: spark.read.parquet(f"{d}/customer.parquet")
    names = name().select(F.concat_ws("-", F.lower("c_mktsegment"), (F.col("c_custkey") % 7).cast("string")).alias("slug")).distinct()
    asked = name().select(F.when(F.col("c_custkey") % 3 == 0, F.lower("c_mktsegment")).when(F.col("c_custkey") % 3 == 1, F.concat_ws("-", F.lower("c_mktsegment"), (F.col("c_custkey") % 7).cast("string"))).otherwise(F.concat_ws("-", F.lower("c_mktsegment"), (F.col("c_custkey") % 7).cast("string"), F.lit("x"))).alias("slug")).distinct()
    return listing.alike_projects(names, asked, 5)


def present_paths(spark, d):
    """How much of each project of the base our folder holds."""
    return listing.paths_present(snapshot(spark, d, "ours"), snapshot(spark, d, "base").select(F.regexp_extract("path", "^([^/]+/[^/]+)/", 1).alias("project"), "path"))


def largest_files(spark, d):
    return listing.largest(snapshot(spark, d, "base"), 20)


def push_order(spark, d):
    ref = F.when(F.col("turn") == 0, "HEAD").when(F.col("turn") == 1, "refs/heads/main").when(F.col("turn") == 2, "refs/tags/v1").when(F.col("turn") == 3, "refs/heads/master").otherwise("refs/heads/x")
    return saves(spark, d).select("id", listing.push_rank(ref).alias("rank"))


def marked_refs(spark, d):
    refs = saves(spark, d).where("turn <= 2").select(F.concat(F.lit("refs/heads/"), "id").alias("ref"), F.col("id").alias("target"))
    return listing.marked(refs, saves(spark, d).where("turn <> 1").select("conv_id", F.col("id").alias("target"), F.col("conv_id").alias("mark")).drop("conv_id"))


def nearest_commands(spark, d):
    return listing.nearest_command(snapshot(spark, d, "base").select(F.element_at(F.array(*map(F.lit, ("stats", "mergee", "dif", "swich", "xyzzyx", "bundles"))), (F.col("size") % 6 + 1).cast("int")).alias("word")).distinct(), COMMANDS)


def blank_paragraphs(spark, d):
    lines = files(spark, d).select("path", F.posexplode(F.split(F.regexp_replace("text", r"\. ", "\n\n"), "\n")).alias("number", "text"))
    return listing.paragraphs(lines).groupBy("path").agg(F.count("*").alias("paragraphs"), F.sum("lines").alias("lines"))


#: Names at a project's root, by line item.
ROOT_NAMES = ("README", "Assets", "ProjectSettings", "game.uproject", "project.godot", "project.json", "package.json", "setup.py", "Cargo.toml", "go.mod", "build.gradle.kts", "App.SLN", "CMakeLists.txt")


def project_kinds(spark, d):
    name = F.element_at(F.array(*map(F.lit, ROOT_NAMES)), ((F.col("l_linenumber") * F.col("l_orderkey")) % len(ROOT_NAMES) + 1).cast("int"))
    kinds = listing.project_kinds(spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("project"), name.alias("name")))
    return kinds.select("project", F.array_join("kinds", ",").alias("kinds"))


def commit_markers(spark, d):
    sha = lambda c: F.sha1(F.col(c).cast("string"))
    message = F.concat(F.lit("fix\n\n\n\nGit-commit: "), sha("o_orderkey"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("\nGit-commit:"), sha("o_custkey"))).otherwise(""), F.lit("\nend "))
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", listing.commit_of(message).alias("commit"), listing.without_marker(message).alias("message"))


def marked_messages(spark, d):
    """Messages of any length with their commit's marker, cut where both are too long."""
    words = F.repeat(F.concat(F.lit("w"), (F.col("o_orderkey") % 9).cast("string"), F.lit(" ")), (F.col("o_orderkey") % 90).cast("int"))
    message = F.when(F.col("o_orderkey") % 10 == 3, F.repeat(F.lit("x"), (F.col("o_orderkey") % 300).cast("int"))).otherwise(words)
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", listing.with_commit(message, F.sha1(F.col("o_orderkey").cast("string"))).alias("message"))


def compression_verdicts(spark, d):
    """Chunks of a file are line items of a supplier; a small quantity was worth compressing."""
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")
    place = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber")) - 1
    return listing.compression_verdicts(rows.select(F.col("l_suppkey").alias("path"), place.alias("position"), (F.col("l_quantity") < 18).alias("kept")))


def compression_policy(spark, d):
    ext = detect.extension("path")
    return snapshot(spark, d, "base").select("path", listing.compression(ext, F.col("size")).alias("how"), listing.media_type(ext).alias("media"))


def taken_sides(spark, d):
    from snapweave.operators import snapshots

    sides = {s: snapshot(spark, d, s) for s in ("base", "ours", "theirs")}
    open_ = snapshots.three_way(**sides).where("decision in ('content', 'deleted-there')")
    return listing.took_side(open_, sides["ours"], sides["theirs"], "theirs")


def unpaired_chain(spark, d):
    return listing.unpaired(graph.first_parents(save_edges(spark, d), _start(spark, d)), saves(spark, d).where("turn <= 2"))


def _edited(spark, d):
    """Contents of paths that base and ours hold differently, with a stretch cut out and put at the end besides."""
    both = contents(spark, d, "base").withColumnRenamed("text", "b").join(contents(spark, d, "ours").withColumnRenamed("text", "t"), "path").where("b <> t")
    moved = F.concat(F.substring("t", 40, 1 << 30), F.substring("t", 1, 39))
    return both.select("path", F.encode("b", "UTF-8").alias("base"), F.encode(moved, "UTF-8").alias("target"))


DELTA = content.Profile(64, 128, 256, 0x7F, 0x3F)


def _steps(spark, d):
    pairs = cut(_edited(spark, d))
    layout = lambda side: content.chunks(pairs.select("path", F.col(side).alias("content")), DELTA)
    return pairs, content.delta_steps(layout("base"), layout("target"))


def delta_round_trip(spark, d):
    """Targets put together from the chunks that their bases have and their own."""
    pairs, steps = _steps(spark, d)
    back = content.applied(steps, pairs.select("path", F.col("base").alias("content")))
    return back.select("path", "size", F.sha2("content", 256).alias("sha256"))


def delta_policy(spark, d):
    sizes = content.delta_sizes(_steps(spark, d)[1])
    return sizes.select("path", content.kept_as(F.col("delta"), F.col("whole"), F.lit(1)).alias("kept_as")).groupBy("kept_as").agg(F.count("*").alias("files"))


def framed_objects(spark, d):
    """Every content of the base put together again from the objects that its entry lists, and whether it has its digest."""
    rows = contents(spark, d, "base").select(F.sha2("text", 256).alias("path"), F.encode("text", "UTF-8").alias("content")).dropDuplicates(["path"])
    entries, objects = content.stored(rows, content.Profile(64, 256, 1024, 0x1FF, 0x7F), 4000)
    entries, objects = cut(entries), cut(objects)
    pieces = entries.select("path", F.posexplode("objects").alias("position", "name")).join(objects, "name").select("path", "position", "raw")
    back = content.reassemble(pieces)
    return entries.join(back.withColumnRenamed("size", "found"), "path", "left").select(F.col("path").alias("name"), F.coalesce("found", F.lit(0).cast("long")).alias("size"), (F.sha2(F.coalesce("content", F.lit(b"")), 256) == F.col("sha256")).alias("whole"))


def solid_packs(spark, d):
    """Where each content lies once the small files of a folder are stored together."""
    rows = snapshot(spark, d, "base").select(F.regexp_extract("path", "^([^/]+/[^/]+)/", 1).alias("pack"), "path", "size", "sha256")
    return content.solid_layout(rows, 64 * 1024)


def conflict_drafts(spark, d):
    """Both sides' texts in one, with markers around what differs."""
    pairs = contents(spark, d, "base").join(contents(spark, d, "ours").withColumnRenamed("text", "after"), "path").where("text <> after")
    return text.draft(pairs.select("path", F.col("text").alias("before"), "after")).select("path", F.sha2("text", 256).alias("sha256"), "regions")


_SAME = "(b.sha256 = t.sha256 AND b.executable = t.executable)"
_EXT = r"lower(regexp_extract(path, '[^/](\.[^./]*)$', 1))"
_LIST = lambda names: ", ".join(f"'{n}'" for n in names)
_SEG = "CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) WHEN c_custkey % 3 = 1 THEN lower(c_mktsegment) || '-' || c_custkey % 7 ELSE lower(c_mktsegment) || '-' || c_custkey % 7 || '-x' END"
_EDIT = f"{WITH}, e AS (SELECT path, substr(x.o, 40) || substr(x.o, 1, 39) AS t FROM (SELECT path, text AS b, CASE WHEN doc_id % 11 = 1 THEN text || '|o' WHEN doc_id % 7 = 2 THEN text || '|same' WHEN doc_id % 19 = 5 THEN text || '|o2' ELSE text END AS o FROM files WHERE doc_id % 29 <> 3 AND doc_id % 23 <> 7) x WHERE b <> o)"

_LAYER = "CASE WHEN path LIKE 'en/%' THEN '' WHEN path LIKE 'fr/src1/%.md' OR path LIKE 'fr/src1/%.png' THEN 'fr/src1' WHEN path LIKE 'fr/%.log' OR path LIKE 'fr/src3/%.bin' THEN 'fr' WHEN path LIKE '%.log' OR path LIKE '%.png' THEN '' END"
_SHUT = "(path LIKE 'en/%' OR CASE WHEN path LIKE 'fr/src1/%.md' THEN true WHEN path LIKE 'fr/src1/%.png' OR path LIKE 'fr/%.log' THEN false ELSE path LIKE 'fr/src3/%.bin' OR path LIKE '%.log' OR path LIKE '%.png' END)"

QUERIES = {
    "layered_rules": (layered_rules, f"{WITH} SELECT path, {_LAYER} AS layer, {_SHUT} AS excluded FROM base"),
    "tracked_files": (tracked_files, f"{WITH} SELECT path, {_LAYER} AS layer, {_SHUT} AND path NOT IN (SELECT path FROM theirs WHERE executable) AS excluded FROM base"),
    "cached_digests": (cached_digests, f"{WITH} SELECT o.path AS path, CASE WHEN o.size = b.size AND NOT b.executable AND o.size % 3 < 2 AND (o.size % 5 > 0 OR o.size = 0) THEN b.sha256 END AS sha256 FROM ours o LEFT JOIN base b USING (path)"),
    "changed_paths": (
        changed_paths,
        f"""{WITH}, c AS (SELECT path, CASE WHEN b.path IS NULL THEN 'added' WHEN t.path IS NULL THEN 'deleted' WHEN b.sha256 <> t.sha256 THEN 'modified' END AS change FROM base b FULL JOIN ours t USING (path)),
n AS (SELECT path, change, regexp_extract(path, '^(.*)/', 1) AS folder, row_number() OVER (PARTITION BY regexp_extract(path, '^(.*)/', 1) ORDER BY path) AS turn FROM c WHERE change IS NOT NULL)
SELECT path, change, turn FROM n ORDER BY turn, folder LIMIT 40""",
    ),
    "changes_only": (changes_only, f"{WITH} SELECT path, t.sha256 AS sha256, t.path IS NULL AS removed FROM base b FULL JOIN theirs t USING (path) WHERE {_SAME} IS NOT TRUE"),
    "status_lists": (
        status_lists,
        f"""{WITH}, s AS (SELECT path, CASE WHEN m.path IS NOT NULL AND o.path IS NULL THEN 'absent' WHEN m.sha256 IS DISTINCT FROM l.sha256 AND o.sha256 IS NOT DISTINCT FROM l.sha256 THEN 'behind' WHEN o.sha256 IS DISTINCT FROM l.sha256 THEN 'edited' END AS state
 FROM theirs m FULL JOIN base l USING (path) FULL JOIN ours o USING (path)) SELECT * FROM s WHERE state IS NOT NULL""",
    ),
    "release_check": (release_check, f"{WITH} SELECT path, CASE WHEN t.path IS NULL THEN 'missing' WHEN b.path IS NULL THEN 'unlisted' WHEN b.size <> t.size THEN 'size' WHEN b.sha256 <> t.sha256 THEN 'digest' ELSE 'whole' END AS verdict FROM base b FULL JOIN ours t USING (path)"),
    "objects_by_prefix": (
        objects_by_prefix,
        f"""{WITH}, n AS (SELECT DISTINCT sha256 AS name FROM base), p AS (SELECT DISTINCT left(sha256, 3 + size % 4) AS prefix FROM ours WHERE size % 4 > 0)
SELECT prefix, count(name) AS matches, CASE WHEN count(name) = 1 THEN min(name) END AS name FROM p LEFT JOIN n ON starts_with(name, prefix) GROUP BY prefix""",
    ),
    "alike_projects": (
        alike_projects,
        f"""WITH n AS (SELECT DISTINCT lower(c_mktsegment) || '-' || c_custkey % 7 AS project FROM customer), a AS (SELECT DISTINCT {_SEG} AS slug FROM customer),
r AS (SELECT slug, project, slug = project AS same, row_number() OVER (PARTITION BY slug ORDER BY slug = project DESC, project) AS k FROM a JOIN n ON slug = project OR starts_with(slug, project || '-') OR starts_with(project, slug || '-'))
SELECT slug, project, same FROM r WHERE k <= 5""",
    ),
    "present_paths": (present_paths, f"{WITH} SELECT regexp_extract(b.path, '^([^/]+/[^/]+)/', 1) AS project, count(*) AS paths, count(o.path) AS present FROM base b LEFT JOIN ours o USING (path) GROUP BY 1"),
    "largest_files": (largest_files, f"{WITH} SELECT path, size, (SELECT count(*) FROM base) > 20 AS truncated FROM base ORDER BY size DESC, path LIMIT 20"),
    "push_order": (push_order, f"{WITH} SELECT id, CASE turn WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 4 WHEN 3 THEN 2 ELSE 3 END AS rank FROM saves"),
    "marked_refs": (marked_refs, f"{WITH} SELECT 'refs/heads/' || id AS ref, CASE WHEN turn <> 1 THEN conv_id END AS mark, CASE WHEN turn = 1 THEN 'not exported' END AS problem FROM saves WHERE turn <= 2"),
    "nearest_commands": (
        nearest_commands,
        f"""{WITH}, w AS (SELECT DISTINCT ['stats', 'mergee', 'dif', 'swich', 'xyzzyx', 'bundles'][size % 6 + 1] AS word FROM base),
s AS (SELECT word, c, row_number() OVER (PARTITION BY word ORDER BY levenshtein(word, c), c) AS n, levenshtein(word, c) * 3 <= greatest(length(word), length(c)) AS near FROM w, (SELECT unnest([{_LIST(COMMANDS)}]) AS c))
SELECT word, CASE WHEN near THEN c END AS command FROM s WHERE n = 1""",
    ),
    "blank_paragraphs": (
        blank_paragraphs,
        f"""{WITH}, l AS (SELECT path, unnest(string_split(replace(text, '. ', chr(10) || chr(10)), chr(10))) AS t, generate_subscripts(string_split(replace(text, '. ', chr(10) || chr(10)), chr(10)), 1) AS n FROM files),
i AS (SELECT path, n, trim(t, ' ') = '' AS blank, sum(CAST(trim(t, ' ') = '' AS INT)) OVER (PARTITION BY path ORDER BY n) AS island FROM l)
SELECT path, count(DISTINCT island) AS paragraphs, count(*) AS lines FROM i WHERE NOT blank GROUP BY path""",
    ),
    "project_kinds": (
        project_kinds,
        f"""WITH n AS (SELECT l_orderkey AS project, list(DISTINCT lower([{_LIST(ROOT_NAMES)}][l_linenumber * l_orderkey % {len(ROOT_NAMES)} + 1])) AS h FROM lineitem GROUP BY 1),
e AS (SELECT project, h, CASE WHEN list_contains(h, 'assets') AND list_contains(h, 'projectsettings') THEN 'unity' WHEN list_contains(h, 'game.uproject') THEN 'unrealengine' WHEN list_contains(h, 'project.godot') THEN 'godot' WHEN list_contains(h, 'project.json') AND list_contains(h, 'assets') THEN 'cocos' END AS engine FROM n),
p AS (SELECT project, h, list_filter([engine, CASE WHEN list_contains(h, 'package.json') THEN 'node' END, CASE WHEN list_contains(h, 'setup.py') THEN 'python' END, CASE WHEN list_contains(h, 'cargo.toml') THEN 'rust' END, CASE WHEN list_contains(h, 'go.mod') THEN 'go' END, CASE WHEN list_contains(h, 'build.gradle.kts') THEN 'gradle' END], lambda x: x IS NOT NULL) AS k FROM e)
SELECT project, array_to_string(CASE WHEN len(k) > 0 THEN k ELSE list_filter([CASE WHEN list_contains(h, 'app.sln') THEN 'visualstudio' END, CASE WHEN list_contains(h, 'cmakelists.txt') THEN 'cmake' END], lambda x: x IS NOT NULL) END, ',') AS kinds FROM p""",
    ),
    "commit_markers": (commit_markers, "SELECT o_orderkey, sha1(CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE o_orderkey END AS VARCHAR)) AS \"commit\", 'fix' || chr(10) || chr(10) || 'end' AS message FROM orders"),
    "marked_messages": (
        marked_messages,
        """WITH m AS (SELECT o_orderkey, sha1(CAST(o_orderkey AS VARCHAR)) AS sha, regexp_replace(CASE WHEN o_orderkey % 10 = 3 THEN repeat('x', o_orderkey % 300) ELSE repeat('w' || o_orderkey % 9 || ' ', o_orderkey % 90) END, '\\s+$', '') AS body FROM orders),
t AS (SELECT *, substr(body, 1, 185) AS kept, regexp_replace(substr(body, 1, 185), '\\s+\\S*$', '') AS tidy FROM m)
SELECT o_orderkey, CASE WHEN length(body) <= 186 THEN body ELSE regexp_replace(CASE WHEN length(tidy) > 93 THEN tidy ELSE kept END, '\\s+$', '') || chr(8230) END || chr(10) || chr(10) || 'Git-commit: ' || sha AS message FROM t""",
    ),
    "compression_verdicts": (
        compression_verdicts,
        """WITH c AS (SELECT l_suppkey AS path, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) - 1 AS position, l_quantity < 18 AS kept FROM lineitem),
w AS (SELECT path, position // 16 AS w, count(*) AS n, count(*) FILTER (kept) AS kept FROM c GROUP BY 1, 2), f AS (SELECT path, CAST(sum(n) AS BIGINT) AS chunks, min(CASE WHEN n = 16 AND kept * 4 < 16 THEN w END) AS bad FROM w GROUP BY 1)
SELECT path, chunks, CASE WHEN bad IS NULL THEN chunks ELSE (bad + 1) * 16 END AS tried, bad IS NULL AS allowed FROM f""",
    ),
    "compression_policy": (
        compression_policy,
        f"""{WITH} SELECT path, CASE WHEN {_EXT} IN ({_LIST(listing.COMPRESSED)}) OR size < 4096 THEN 'store' WHEN size >= 2097152 THEN 'sample' ELSE 'try' END AS how,
 CASE {_EXT} {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in listing.MEDIA.items())} ELSE 'application/octet-stream' END AS media FROM base""",
    ),
    "taken_sides": (taken_sides, f"{WITH}, x AS (SELECT path, {_DECIDE} AS decision, t.sha256 AS sha256 FROM {_ALL}) SELECT path, sha256 FROM x WHERE decision IN ('content', 'deleted-there')"),
    "unpaired_chain": (
        unpaired_chain,
        f"""{WITH}, up(id, depth) AS (SELECT id, 0 FROM (SELECT id FROM saves ORDER BY turn DESC, conv_id DESC LIMIT 1) UNION SELECT parent, depth + 1 FROM up JOIN edges ON child = id WHERE nth = 0)
SELECT id, depth FROM up WHERE depth < (SELECT min(depth) FROM up WHERE id IN (SELECT id FROM saves WHERE turn <= 2))""",
    ),
    "delta_round_trip": (delta_round_trip, f"{_EDIT} SELECT path, CAST(strlen(t) AS BIGINT) AS size, sha256(t) AS sha256 FROM e"),
    "delta_policy": (delta_policy, None),
    "framed_objects": (framed_objects, f"{WITH} SELECT sha256 AS name, min(size) AS size, true AS whole FROM base GROUP BY 1"),
    "solid_packs": (
        solid_packs,
        f"""{WITH}, m AS (SELECT regexp_extract(path, '^([^/]+/[^/]+)/', 1) AS pack, path, {_EXT} AS ext, string_split(path, '/')[-1] AS name, size, sha256, row_number() OVER (PARTITION BY regexp_extract(path, '^([^/]+/[^/]+)/', 1), sha256 ORDER BY {_EXT}, string_split(path, '/')[-1], path) AS copy FROM base),
p AS (SELECT *, CAST(floor(coalesce(sum(size) OVER (PARTITION BY pack ORDER BY ext, name, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 65536) AS BIGINT) AS part FROM m WHERE copy = 1)
SELECT pack, part, row_number() OVER w AS place, path, sha256, CAST(coalesce(sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", size FROM p WINDOW w AS (PARTITION BY pack, part ORDER BY ext, name, path)""",
    ),
    "conflict_drafts": (
        conflict_drafts,
        f"""{WITH}, {pair_sql("f.text", OURS_TEXT, "doc_id % 29 <> 3 AND NOT (doc_id % 23 = 7)")}
SELECT path, sha256(array_to_string(a[1:pre] || ['<<<<<<< saved on the project'] || a[pre + 1:len(a) - suf] || ['======='] || b[pre + 1:len(b) - suf] || ['>>>>>>> your upload'] || a[len(a) - suf + 1:], chr(10))) AS sha256, 1 AS regions FROM pairs""",
    ),
}
