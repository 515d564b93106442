"""Mixing sources to target weights by capped water-filling, in DataFrame functions alone.

The budget is shared by weight; a source whose share exceeds `epochs` times its words is clamped there, and what it leaves is
shared by weight among the others, until no share is above. With sources in order of cap / weight, the common level of
those that aren't clamped is the greatest (budget - caps of those before) / (weights from here on): no loop is needed.

A source's documents then give floor(target / size) whole repetitions each, and a seeded sample gives the rest: documents
are dealt into buckets of about BUCKET_DOCS by a hash of seed and doc_id, ordered by it, and taken until the bucket's quota of
words is met; the one at the edge is taken in part. So each bucket misses its share by half a word at most, a hot source is
many buckets, and reruns agree.

Defined cases: a null text has no words; a null source is a source of its own, the last; a source without words has target 0;
rows alike in doc_id are taken one after the other, also when they are equal; a text of any length is taken in part by whole words;
other columns pass through whatever their names are. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, running, whole_row

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
BUCKET_DOCS = 256
SEED = 20240229
#: Sources up to which their table is sent to all executors.
BROADCAST_SOURCES = 100_000


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """Of each source of sizes (source, size): source_size, docs, weight, target. One row a source; no task holds all of them."""
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    ranked = running(own, [F.col("source").asc_nulls_last()], {})
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    weighed = ranked.select("source", "source_size", "docs", weight.alias("weight"), (F.col("source_size") * epochs).alias("cap"), F.col("place").alias("nth"))
    filled = running(weighed, [(F.col("cap") / F.col("weight")).asc(), F.col("nth").asc()], {"caps": F.col("cap"), "weights": F.col("weight")}).drop("place")
    whole = filled.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    level = filled.agg(F.max((F.lit(share * float(whole["size"] or 0)) - F.col("caps")) / (F.lit(whole["weight"] or 0) - F.col("weights")))).first()[0]
    return filled.select("source", "source_size", "docs", "weight", F.least(F.lit(level).cast("double") * F.col("weight"), F.col("cap").cast("double")).alias("target"))


def mixed(docs: DataFrame, size: Column, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """(doc, size, source_size, target, taken) of each row of docs: the row itself as a struct, and the words that the mix takes."""
    sized = docs.select(whole_row(docs).alias("doc"), F.col("doc_id"), F.col("source"), size.alias("size"))
    goal = cut(targets(sized.select("source", "size"), weights, share, epochs))
    small = goal.count() <= BROADCAST_SOURCES
    goal = goal.select(F.col("source").alias("of"), "source_size", "docs", "target")
    rows = sized.join(F.broadcast(goal) if small else goal, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rows = rows.select("*", key.alias("key"))
    number = F.conv(F.substring("key", 25, 8), 16, 10).cast("long")
    rows = rows.select("*", (number % F.ceil(F.col("docs") / BUCKET_DOCS)).alias("bucket"), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("ratio"))
    bucket = Window.partitionBy("source", "bucket")
    before = F.coalesce(F.sum("size").over(bucket.orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.select("*", before.alias("before"), F.sum("size").over(bucket).alias("every"))
    quota = F.floor((F.col("ratio") - F.floor("ratio")) * F.col("every") + 0.5)
    extra = F.least(F.greatest(quota - F.col("before"), F.lit(0)), F.col("size"))
    return rows.select("doc", "size", "source_size", "target", (F.floor("ratio") * F.col("size") + extra).cast("long").alias("taken"))


def repeated(docs: DataFrame) -> DataFrame:
    """The mixed corpus itself, with the columns of docs: a row for each repetition; a part holds its first words, joined by one space."""
    rows = mixed(docs, n_words("text"))
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(1).cast("int")
    rest = F.when(F.col("size") > 0, F.col("taken") - whole * F.col("size")).otherwise(0)
    pieces = F.concat(F.array_repeat(F.col("size"), whole), F.when(rest > 0, F.array(rest)).otherwise(F.expr("cast(array() as array<bigint>)")))
    out = rows.select("doc", "size", F.explode(pieces).alias("n"))
    part = F.expr(r"array_join(slice(filter(split(doc.text, '[\\x20\\x09-\\x0D]+'), w -> w != ''), 1, cast(n as int)), ' ')")
    text = F.when(F.col("n") < F.col("size"), part).otherwise(F.col("doc.text"))
    columns = {c: F.col("doc").getField(c) for c in docs.columns} | {"text": text}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col("n") < F.col("size"), F.char_length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("doc.n_chars"))
    return out.select(*(columns[c].alias(c) for c in docs.columns))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = cut(docs.select("doc_id", "source", n_words("text").alias("size")))
    return mixed(sizes, F.col("size")).select("doc.doc_id", "size", "source_size", "target", "taken")
