"""Queries of text merges, activity and streams, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from snapweave.functions.lineage import new_folder
from snapweave.functions.text import instant, micros
from snapweave.operators import activity, content, snapshots, text
from snapweave.sources.shapes import SHAPES, contents, files, snapshot, versions
from snapweave.streaming import feeds

WITH = f"WITH RECURSIVE {SHAPES}"
_CSV = "'\"' || {0} || '\"'"


def _changed_texts(spark, d):
    """Texts of paths that base and ours hold differently: contents are joined after the decision."""
    changed = snapshots.compare(snapshot(spark, d, "base"), snapshot(spark, d, "ours")).where("change = 'modified'").select("path")
    before, after = (contents(spark, d, s) for s in ("base", "ours"))
    return changed.join(before.withColumnRenamed("text", "before"), "path").join(after.withColumnRenamed("text", "after"), "path").where(F.col("before") != F.col("after"))


def line_diffs(spark, d):
    return text.line_diff(_changed_texts(spark, d)).groupBy("path").agg(F.count_if(F.expr("side = '+'")).alias("added"), F.count_if(F.expr("side = '-'")).alias("removed"), F.count("*").alias("lines"))


def folded_diffs(spark, d):
    return text.folded(text.line_diff(_changed_texts(spark, d))).groupBy("path").agg(F.count_if(F.expr("side <> '~'")).alias("shown"), F.sum("hidden").alias("hidden"))


def diff_numbers(spark, d):
    """Running counts give the numbers that the comparison gave."""
    diff = text.line_diff(_changed_texts(spark, d))
    again = text.hunk_numbers(diff).withColumnsRenamed({"old": "o", "new": "n"})
    rows = diff.join(again, ["path", "position"])
    return rows.groupBy("path").agg(F.count("*").alias("lines"), F.count_if(F.col("old").eqNullSafe(F.col("o")) & F.col("new").eqNullSafe(F.col("n"))).alias("agree"))


def file_diffs(spark, d):
    """How each change between two sides can be shown; some texts are binary or too large here."""
    def side(name):
        odd = F.when(F.col("size") % 9 == 1, F.concat("text", F.lit("\x00"))).when(F.col("size") % 9 == 2, F.repeat("text", (F.lit(5 << 20) / F.greatest("size", F.lit(1))).cast("int"))).otherwise(F.col("text"))
        return snapshot(spark, d, name).join(contents(spark, d, name), "path").select("path", "sha256", "executable", odd.alias("text"))

    return text.file_diffs(side("base"), side("ours"))


def merged_texts(spark, d):
    sides = {s: snapshot(spark, d, s) for s in ("base", "ours", "theirs")}
    double = snapshots.three_way(**sides).where("decision = 'content'").select("path")
    rows = double
    for s in sides:
        rows = rows.join(contents(spark, d, s).withColumnRenamed("text", s), "path", "left")
    return text.merged(rows).select("path", F.sha2("text", 256).alias("sha256"), "conflicts")


def activity_totals(spark, d):
    return activity.totals(versions(spark, d))


def daily_saves(spark, d):
    return activity.daily(versions(spark, d))


def latest_versions(spark, d):
    return activity.latest(versions(spark, d))


def repository_report(spark, d):
    return activity.repositories(versions(spark, d))


def long_report(spark, d):
    return activity.long_report(versions(spark, d))


def report_lines(spark, d):
    return activity.csv_lines(activity.daily(versions(spark, d)).select("date", F.concat(F.lit("="), F.col("saves").cast("string")).alias("saves")))


def phase_times(spark, d):
    return activity.phases(spark.read.parquet(f"{d}/events.parquet").select("event_type", F.col("event_id").alias("took")), "event_type", "took")


def issue_counts(spark, d):
    state = F.when(F.col("o_orderstatus") == "F", "closed").when(F.col("o_orderstatus") == "O", "open").otherwise("draft")
    return activity.state_counts(spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("project"), state.alias("state")), "project", "state")


def report_problems(spark, d):
    """Whether the export may be written: as many versions as were counted, each once; and what is said of one that repeats some."""
    rows = versions(spark, d)
    n = rows.count()
    found = [("whole", activity.export_problem(rows, n)), ("short", activity.export_problem(rows, n + 1)), ("repeated", activity.export_problem(rows.unionByName(rows), 2 * n))]
    return spark.createDataFrame(found, "export string, problem string")


def stream_fresh_events(spark, d):
    """Each event comes twice; those of a fortnight and by one's own hand are left out."""
    events = feeds.table_stream(spark, f"{d}/events.parquet")
    body = F.concat(F.lit("@"), "event_type", F.lit(" "), F.col("user_id").cast("string"))
    kind = F.when(F.col("event_id") % 5 == 0, "event").otherwise("message")
    messages = events.select(F.col("event_id").alias("id"), instant("ts").alias("at"), (F.col("event_id") % 50).cast("string").alias("author"), kind.alias("kind"), body.alias("body"), F.explode(F.array(F.lit(1), F.lit(2))).alias("again"))
    out = feeds.run_to_end(feeds.fresh_events(messages, "2024-01-15 00:00:00Z", "8", ("click", "view")))
    return out.groupBy("id", "type").agg(F.count("*").alias("times"))


def stream_daily_counts(spark, d):
    events = feeds.table_stream(spark, f"{d}/events.parquet").select(instant("ts").alias("ts"), "event_type")
    out = feeds.run_to_end(feeds.daily_counts(events, "ts", "event_type"))
    return out.select(F.date_from_unix_date(F.floor(F.unix_seconds("day") / 86400).cast("int")).cast("string").alias("day"), "event_type", "events")


def stream_output_lines(spark, d):
    """A conversation's turns are parts of an output; a line goes over from each to the next, and the last ends with its stream."""
    turns = spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("stream"), F.col("turn").alias("seq"), F.concat("role", F.lit(": token npm_aaaaaaaaaabbbbbbbbbb\r\nnext "), F.col("turn").cast("string")).alias("chunk"))
    ends = turns.groupBy("stream").agg(F.max("seq").alias("end"))
    parts = new_folder(spark, "parts")
    turns.join(ends, "stream").select("stream", "seq", "chunk", (F.col("seq") == F.col("end")).alias("last")).write.parquet(parts)
    stream = spark.readStream.schema("stream long, seq long, chunk string, last boolean").parquet(parts)
    return feeds.run_to_end(feeds.output_lines(stream))


def stream_transfer_rates(spark, d):
    """The trailing rate of each user's events over an hour."""
    samples = feeds.table_stream(spark, f"{d}/events.parquet").select(F.col("user_id").alias("key"), F.floor(micros("ts") / 1000).alias("at_ms"), F.col("event_id").alias("bytes"))
    out = feeds.run_to_end(feeds.trailing_rates(samples, 3_600_000, 250))
    return out.groupBy("key", "at_ms").agg(F.count("*").alias("samples"), F.round(F.min("rate"), 3).alias("least"))


def stream_chunks(spark, d):
    """Files that arrive in parts of 700 bytes have the chunks of whole files: how many, and their bytes."""
    whole = files(spark, d).select("path", F.encode("text", "UTF-8").alias("content"))
    n = F.greatest(F.ceil(F.octet_length("content") / 700), F.lit(1))
    each = whole.select("path", "content", n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("seq"))
    parts = new_folder(spark, "file-parts")
    each.select("path", "seq", F.expr("substring(content, cast(seq * 700 + 1 as int), 700)").alias("data"), (F.col("seq") == F.col("n") - 1).alias("last")).write.parquet(parts)
    stream = spark.readStream.schema("path string, seq long, data binary, last boolean").parquet(parts)
    arrived = feeds.run_to_end(feeds.streamed_chunks(stream, CHUNKS)).select("path", "position", "start", "length", "sha256")
    same = content.chunks(whole, CHUNKS).select("path", "position", "start", "length", "sha256")
    both = arrived.withColumn("side", F.lit(1)).unionByName(same.withColumn("side", F.lit(2))).groupBy("path", "position", "start", "length", "sha256").agg(F.sum("side").alias("sides"))
    return both.groupBy("path").agg(F.count_if(F.col("sides") != 3).alias("unlike"), F.sum("length").alias("bytes"))


CHUNKS = content.Profile(64, 256, 1024, 0x1FF, 0x7F)


def stream_fresh_saves(spark, d):
    """Two looks: at the even orders, then at the odd ones, of which those above a project's greatest even one are new."""
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("sequence"))
    return feeds.run_looks([rows.where(F.col("sequence") % 2 == rest) for rest in (0, 1)], feeds.fresh_saves)


OURS_TEXT = "CASE WHEN doc_id % 11 = 1 THEN f.text || '|o' WHEN doc_id % 7 = 2 THEN f.text || '|same' WHEN doc_id % 19 = 5 THEN f.text || '|o2' ELSE f.text END"
_THEIRS_TEXT = "CASE WHEN doc_id % 5 = 1 THEN f.text || '|t' WHEN doc_id % 7 = 2 THEN f.text || '|same' ELSE f.text END"


def _split(x: str) -> str:
    """Lines of a text without their ends; a last end makes no further line."""
    whole = f"string_split(replace({x}, chr(13) || chr(10), chr(10)), chr(10))"
    return f"CASE WHEN {x} = '' THEN CAST([] AS VARCHAR[]) WHEN {whole}[-1] = '' THEN {whole}[:-2] ELSE {whole} END"


def pair_sql(before: str, after: str, where: str) -> str:
    """pairs (path, a, b, pre, suf): lines of two texts that differ, and how many are alike at the start and, of the rest, at the end.

    What lies between has no line in common where one stretch was changed, so it is the difference.
    """
    return f"""l AS (SELECT path, {_split("x")} AS a, {_split("y")} AS b FROM (SELECT path, {before} AS x, {after} AS y FROM files f WHERE {where}) WHERE x <> y),
s AS (SELECT path, a, b, coalesce(list_position(list_transform(generate_series(1, least(len(a), len(b))), lambda i: a[i] = b[i]), false) - 1, least(len(a), len(b))) AS pre FROM l),
pairs AS (SELECT path, a, b, pre, coalesce(list_position(list_transform(generate_series(1, least(len(a), len(b)) - pre), lambda i: a[len(a) + 1 - i] = b[len(b) + 1 - i]), false) - 1, least(len(a), len(b)) - pre) AS suf FROM s)"""


_PAIRS = pair_sql("f.text", OURS_TEXT, "doc_id % 29 <> 3 AND NOT (doc_id % 23 = 7)")
_BIG = "CASE WHEN strlen({0}) % 9 = 1 THEN strlen({0}) + 1 WHEN strlen({0}) % 9 = 2 THEN strlen({0}) * (5242880 // greatest(strlen({0}), 1)) ELSE strlen({0}) END"
_SHOWN = "CASE WHEN {x} IS NULL THEN 'nothing' WHEN {x} < 1024 THEN {x} || ' B' WHEN {x} < 1048576 THEN CAST(round({x} / 1024, 1) AS DECIMAL(18, 1)) || ' KB' ELSE CAST(round({x} / 1048576, 1) AS DECIMAL(18, 1)) || ' MB' END"

QUERIES = {
    "line_diffs": (line_diffs, f"{WITH}, {_PAIRS} SELECT path, len(b) - pre - suf AS added, len(a) - pre - suf AS removed, len(a) + len(b) - pre - suf AS lines FROM pairs"),
    "folded_diffs": (folded_diffs, f"{WITH}, {_PAIRS} SELECT path, least(pre, 3) + least(suf, 3) + len(a) + len(b) - 2 * (pre + suf) AS shown, pre - least(pre, 3) + suf - least(suf, 3) AS hidden FROM pairs"),
    "diff_numbers": (diff_numbers, f"{WITH}, {_PAIRS} SELECT path, len(a) + len(b) - pre - suf AS lines, len(a) + len(b) - pre - suf AS agree FROM pairs"),
    "file_diffs": (
        file_diffs,
        f"""{WITH}, p AS (SELECT f.path AS path, b.path IS NOT NULL AS was, o.path IS NOT NULL AS now, f.text AS x, {OURS_TEXT} AS y, b.sha256 AS bs, o.sha256 AS os, b.executable AS be, o.executable AS oe FROM files f LEFT JOIN base b USING (path) LEFT JOIN ours o USING (path)),
z AS (SELECT *, CASE WHEN was THEN {_BIG.format("x")} END AS bz, CASE WHEN now THEN {_BIG.format("y")} END AS oz, coalesce(was AND strlen(x) % 9 = 1 AND length(x) < 8192, false) OR coalesce(now AND strlen(y) % 9 = 1 AND length(y) < 8192, false) AS nul FROM p WHERE (was OR now) AND (bs IS DISTINCT FROM os OR be IS DISTINCT FROM oe)),
k AS (SELECT *, CASE WHEN bs = os THEN 'mode' WHEN greatest(bz, oz) > 4194304 THEN 'size' WHEN nul THEN 'binary' ELSE 'lines' END AS shown, {_SHOWN.format(x="bz")} || ' → ' || {_SHOWN.format(x="oz")} AS change FROM z)
SELECT path, CASE WHEN NOT was THEN 'added' WHEN NOT now THEN 'deleted' ELSE 'modified' END AS kind, shown, CASE shown WHEN 'size' THEN change || ', too large to show line by line' WHEN 'binary' THEN 'binary, ' || change END AS summary, be <> oe AS mode_changed FROM k""",
    ),
    "merged_texts": (
        merged_texts,
        f"""{WITH}, d AS (SELECT path, b.path IS NULL AS fresh, o.sha256 = b.sha256 AS kept FROM base b FULL JOIN ours o USING (path) FULL JOIN theirs t USING (path) WHERE o.sha256 <> t.sha256 AND t.sha256 IS DISTINCT FROM b.sha256 AND (o.sha256 IS DISTINCT FROM b.sha256 OR o.executable <> b.executable)),
m AS (SELECT f.path AS path, kept, CASE WHEN fresh THEN '' ELSE regexp_extract(f.text, '^((?s:.*)\\n)?', 0) END AS head, {OURS_TEXT} AS o, {_THEIRS_TEXT} AS t FROM files f JOIN d USING (path))
SELECT path, sha256(CASE WHEN kept THEN t ELSE head || '<<<<<<< ours' || chr(10) || substr(o, length(head) + 1) || chr(10) || '=======' || chr(10) || substr(t, length(head) + 1) || chr(10) || '>>>>>>> theirs' || chr(10) END) AS sha256, CASE WHEN kept THEN 0 ELSE 1 END AS conflicts FROM m""",
    ),
    "issue_counts": (issue_counts, "SELECT o_custkey AS project, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'F') AS closed, count(*) AS issues FROM orders GROUP BY 1"),
    "report_problems": (report_problems, "SELECT * FROM (VALUES ('whole', NULL), ('short', 'saved history changed during the export'), ('repeated', 'the export holds repeated versions')) AS t(export, problem)"),
    "activity_totals": (activity_totals, f"{WITH} SELECT count(*) AS saves, CAST(sum(files) AS BIGINT) AS files, CAST(sum(source) AS BIGINT) AS source, count(DISTINCT project) AS repositories FROM versions"),
    "daily_saves": (daily_saves, f"{WITH} SELECT strftime(day_at, '%Y-%m-%d') AS date, count(*) AS saves FROM versions GROUP BY 1"),
    "latest_versions": (latest_versions, f"{WITH} SELECT project, max(sequence) AS sequence, arg_max(version, sequence) AS version, arg_max(files, sequence) AS files, arg_max(source, sequence) AS source FROM versions GROUP BY project"),
    "repository_report": (
        repository_report,
        f"""{WITH}, r AS (SELECT project, count(*) AS saves, CAST(sum(source) AS BIGINT) AS source, arg_max(source, sequence) AS stored FROM versions GROUP BY project)
SELECT *, CAST(CASE WHEN source > 0 THEN greatest(0, floor((1 - stored / source) * 100 + 0.5)) ELSE 0 END AS BIGINT) AS smaller FROM r""",
    ),
    "long_report": (
        long_report,
        f"""{WITH}, r AS (SELECT project, CAST(sum(source) AS BIGINT) AS source, arg_max(source, sequence) AS stored FROM versions GROUP BY project), n AS (SELECT '' AS e)
SELECT 'summary' AS record_type, '' AS repository, '' AS date, metric, value, '' AS version, '' AS files, '' AS source_bytes, '' AS smaller_percent FROM
 (SELECT 'saves' AS metric, CAST(count(*) AS VARCHAR) AS value FROM versions UNION ALL SELECT 'files', CAST(CAST(sum(files) AS BIGINT) AS VARCHAR) FROM versions UNION ALL SELECT 'source', CAST(CAST(sum(source) AS BIGINT) AS VARCHAR) FROM versions)
UNION ALL SELECT 'daily', '', strftime(day_at, '%Y-%m-%d'), 'saved_versions', CAST(count(*) AS VARCHAR), '', '', '', '' FROM versions GROUP BY 3
UNION ALL SELECT 'repository', CAST(project AS VARCHAR), '', '', '', '', '', CAST(source AS VARCHAR), CAST(CAST(CASE WHEN source > 0 THEN greatest(0, floor((1 - stored / source) * 100 + 0.5)) ELSE 0 END AS BIGINT) AS VARCHAR) FROM r
UNION ALL SELECT 'version', CAST(project AS VARCHAR), '', '', '', CAST(version AS VARCHAR), CAST(files AS VARCHAR), CAST(source AS VARCHAR), '' FROM versions""",
    ),
    "report_lines": (report_lines, f"{WITH} SELECT {_CSV.format('date')} || ',' || {_CSV.format(chr(39) * 4 + ' || ' + chr(39) + '=' + chr(39) + ' || saves')} AS line FROM (SELECT strftime(day_at, '%Y-%m-%d') AS date, count(*) AS saves FROM versions GROUP BY 1)"),
    "phase_times": (phase_times, "SELECT event_type, count(*) AS calls, CAST(sum(event_id) AS BIGINT) AS total, max(event_id) AS slowest FROM events GROUP BY 1"),
    "stream_fresh_events": (
        stream_fresh_events,
        "SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN 'event' WHEN event_type IN ('click', 'view') THEN 'mention' ELSE 'message' END AS type, CAST(1 AS BIGINT) AS times FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' AND event_id % 50 <> 8",
    ),
    "stream_daily_counts": (stream_daily_counts, "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS events FROM events GROUP BY 1, 2 HAVING max(date_trunc('day', ts)) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 DAY FROM events)"),
    "stream_output_lines": (
        stream_output_lines,
        """WITH c AS (SELECT conv_id, turn, role, row_number() OVER w - 1 AS n, lag(turn) OVER w AS before, lead(turn) OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id AS stream, 2 * n AS number, CASE WHEN before IS NULL THEN '' ELSE 'next ' || before END || role || ': token ***' AS line, chr(13) AS ending FROM c
UNION ALL SELECT conv_id, 2 * n + 1, '', chr(10) FROM c UNION ALL SELECT conv_id, 2 * n + 2, 'next ' || turn, '' FROM c WHERE after IS NULL""",
    ),
    "stream_transfer_rates": (
        stream_transfer_rates,
        """WITH s AS (SELECT user_id AS key, CAST(epoch_us(ts) // 1000 AS BIGINT) AS at_ms, event_id AS bytes FROM events),
w AS (SELECT *, first_value(at_ms) OVER x AS fa, first_value(bytes) OVER x AS fb FROM s WINDOW x AS (PARTITION BY key ORDER BY at_ms RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW))
SELECT key, at_ms, count(*) AS samples, round(min(CASE WHEN at_ms - fa >= 250 THEN (bytes - fb) * 1000 / CAST(at_ms - fa AS DOUBLE) ELSE 0 END), 3) AS least FROM w GROUP BY 1, 2""",
    ),
    "stream_chunks": (stream_chunks, f"{WITH} SELECT path, CAST(0 AS BIGINT) AS unlike, CAST(strlen(text) AS BIGINT) AS bytes FROM files WHERE text <> ''"),
    "stream_fresh_saves": (stream_fresh_saves, "SELECT o_custkey AS project, o_orderkey AS sequence FROM orders JOIN (SELECT o_custkey AS c, max(o_orderkey) AS seen FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) ON c = o_custkey WHERE o_orderkey % 2 = 1 AND o_orderkey > seen"),
}
