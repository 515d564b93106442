"""The entities of a versioned file collection, built from the driver's tables.

    files      path, size, sha256, executable, text: the documents as a folder
    snapshot   the same keyed by path, for one side of a merge: base, ours or theirs
    saves      id, and edges (child, parent, nth) of the graph of saves: conversations, a turn a save
    versions   orders by customer, numbered by time, with files and bytes of their line items

SHAPES says the same in DuckDB SQL, as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EXTENSIONS = (".md", ".py", ".log", ".png", ".bin", ".json", ".env", ".gguf")


def _extension(key: str = "doc_id") -> Column:
    return F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col(key) % len(EXTENSIONS) + 1).cast("int"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id",
        F.concat("lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), _extension()).alias("path"),
        text.alias("text"),
        (F.col("doc_id") % 13 == 0).alias("executable"),
    )


def _is(n: int, rest: int) -> Column:
    return F.col("doc_id") % n == rest


def _side(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    rows = files(spark, sf_dir)
    if side == "base":
        return rows.where(~_is(29, 3))
    if side == "ours":
        text = F.when(_is(11, 1), F.concat("text", F.lit("|o"))).when(_is(7, 2), F.concat("text", F.lit("|same"))).when(_is(19, 5), F.concat("text", F.lit("|o2"))).otherwise(F.col("text"))
        there = ~(_is(23, 7) | (_is(29, 3) & _is(2, 0)))
        return rows.where(there).withColumns({"text": text, "executable": F.when(_is(17, 4), ~F.col("executable")).otherwise(F.col("executable"))})
    text = F.when(_is(5, 1), F.concat("text", F.lit("|t"))).when(_is(7, 2), F.concat("text", F.lit("|same"))).otherwise(F.col("text"))
    return rows.where(~(_is(31, 9) | (_is(29, 3) & _is(4, 1)))).withColumn("text", text)


def contents(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """(path, text) of one side; joined late, where bytes are wanted."""
    return _side(spark, sf_dir, side).select("path", "text")


def snapshot(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """(path, size, sha256, executable) of base, ours or theirs."""
    return _side(spark, sf_dir, side).select("path", F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("sha256"), "executable")


def save_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(child, parent, nth): parent 0 is the turn before; parent 1 joins the conversation before, where it exists."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn").distinct()
    name = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    nodes = turns.select("conv_id", "turn", name.alias("id"))
    other = nodes.select(F.col("conv_id").alias("pc"), F.col("turn").alias("pt"), F.col("id").alias("parent"))
    first = nodes.join(other, (F.col("pc") == F.col("conv_id")) & (F.col("pt") == F.col("turn") - 1)).select(F.col("id").alias("child"), "parent", F.lit(0).alias("nth"))
    second = nodes.where("turn % 3 = 0 and turn > 0").join(other, (F.col("pc") == F.col("conv_id") - 1) & (F.col("pt") == F.col("turn") - 1)).select(F.col("id").alias("child"), "parent", F.lit(1).alias("nth"))
    return first.unionByName(second)


def saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn").distinct()
    return turns.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "conv_id", "turn")


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project, sequence, version, at, files, source) of each order."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.count("*").alias("files"), F.sum(F.col("l_quantity").cast("long")).alias("source"))
    number = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return orders.select(F.col("o_custkey").alias("project"), number.cast("long").alias("sequence"), F.col("o_orderkey").alias("version"), F.col("o_orderdate").alias("at")).join(lines, F.col("version") == F.col("l_orderkey"), "left").select(
        "project", "sequence", "version", "at", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("source", F.lit(0)).alias("source")
    )


_TEXT = {
    "base": "text",
    "ours": "CASE WHEN doc_id % 11 = 1 THEN text || '|o' WHEN doc_id % 7 = 2 THEN text || '|same' WHEN doc_id % 19 = 5 THEN text || '|o2' ELSE text END",
    "theirs": "CASE WHEN doc_id % 5 = 1 THEN text || '|t' WHEN doc_id % 7 = 2 THEN text || '|same' ELSE text END",
}
_THERE = {"base": "doc_id % 29 <> 3", "ours": "NOT (doc_id % 23 = 7 OR (doc_id % 29 = 3 AND doc_id % 2 = 0))", "theirs": "NOT (doc_id % 31 = 9 OR (doc_id % 29 = 3 AND doc_id % 4 = 1))"}
_MODE = {"base": "executable", "ours": "CASE WHEN doc_id % 17 = 4 THEN NOT executable ELSE executable END", "theirs": "executable"}
_PATH = "concat(lang, '/', source, '/', doc_id, [" + ", ".join(f"'{e}'" for e in EXTENSIONS) + f"][doc_id % {len(EXTENSIONS)} + 1])"

#: For "WITH RECURSIVE ...": the shapes by name.
SHAPES = (
    f"files AS (SELECT doc_id, {_PATH} AS path, coalesce(text, '') AS text, doc_id % 13 = 0 AS executable FROM documents), "
    + ", ".join(f"{s} AS (SELECT path, CAST(strlen(x) AS BIGINT) AS size, sha256(x) AS sha256, executable FROM (SELECT path, {_TEXT[s]} AS x, {_MODE[s]} AS executable FROM files WHERE {_THERE[s]}))" for s in ("base", "ours", "theirs"))
    + """, saves AS (SELECT DISTINCT conv_id, turn, concat(conv_id, '/', turn) AS id FROM conversations),
edges AS (SELECT a.id AS child, b.id AS parent, 0 AS nth FROM saves a JOIN saves b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1
  UNION ALL SELECT a.id, b.id, 1 FROM saves a JOIN saves b ON b.conv_id = a.conv_id - 1 AND b.turn = a.turn - 1 WHERE a.turn % 3 = 0 AND a.turn > 0),
versions AS (SELECT o_custkey AS project, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS sequence, o_orderkey AS version, o_orderdate AS day_at,
  coalesce(files, 0) AS files, CAST(coalesce(source, 0) AS BIGINT) AS source FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS files, sum(CAST(l_quantity AS BIGINT)) AS source FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey)"""
)
