"""Folders of files as tables, and a store of objects by digest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapweave.operators.rules import layers_of, settled

#: Folders of version control, which are never listed (fixed values).
UNCOUNTED = (".git", ".hg", ".svn", ".coderook", ".cbx")
#: Files that a walk lists at most (fixed value).
WALKED = 300_000


def listing(spark: SparkSession, root: str, content: bool = False, name: str | None = None) -> DataFrame:
    """(path, size, mtime[, content]) of every file below root, or of those of one name; without content, no file is opened.

    Spark's readers pass over names that begin with a dot or an underscore, and over empty files, so these aren't listed.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = (reader.option("pathGlobFilter", name) if name else reader).load(root)
    below = F.expr(f"substring(path, instr(path, '{root.rstrip('/')}/') + {len(root.rstrip('/')) + 1})")
    rows = files.select(below.alias("path"), F.col("length").alias("size"), F.unix_millis("modificationTime").cast("double").alias("mtime"), *(["content"] if content else []))
    return rows.where(~F.exists(F.split("path", "/"), lambda p: p.isin(*UNCOUNTED)))


def walk(spark: SparkSession, root: str, most: int = WALKED) -> tuple[DataFrame, bool]:
    """listing() of `most` files in the order of their paths by UTF-16 code unit, and whether there are more."""
    rows = listing(spark, root).orderBy(F.hex(F.encode("path", "UTF-16BE"))).limit(most + 1)
    more = rows.count() > most
    return rows.limit(most), more


def survey(spark: SparkSession, root: str, layers: dict[str, str], tracked: DataFrame | None = None) -> DataFrame:
    """(path, size) of the files below root that nested rule files (folder to text) leave in."""
    rows = settled(listing(spark, root).select("path", "size"), layers_of(layers), tracked)
    return rows.where("not excluded").select("path", "size")


def entries(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, sha256, executable) of a folder."""
    return listing(spark, root, True).select("path", "size", F.sha2("content", 256).alias("sha256"), F.lit(False).alias("executable"))


def rule_files(spark: SparkSession, root: str, name: str = "rules.ignore") -> dict[str, str]:
    """Folder to text of the rule files below root: small texts, for the driver. Only files of that name are opened."""
    found = listing(spark, root, True, name).select("path", F.col("content").cast("string").alias("text")).collect()
    return {r.path.rpartition("/")[0]: r.text for r in found}


def write_rules(spark: SparkSession, root: str, texts: dict[str, str], name: str = "rules.ignore") -> None:
    """Put rule files (folder to text) below root, on whatever store it is."""
    jvm, context = spark._jvm, spark.sparkContext._jsc
    for folder, text in texts.items():
        path = jvm.org.apache.hadoop.fs.Path("/".join(x for x in (root.rstrip("/"), folder, name) if x))
        out = path.getFileSystem(context.hadoopConfiguration()).create(path, True)
        out.write(bytearray(text.encode()))
        out.close()


def put(objects: DataFrame, store: str) -> None:
    """Add objects (name, raw) that the store, a Parquet folder dealt by the first two characters, doesn't hold yet."""
    spark = objects.sparkSession
    new = objects.dropDuplicates(["name"]).select("name", "raw", F.substring("name", 1, 2).alias("shelf"))
    try:
        held = get(spark, store)
    except Exception as e:  # nothing is there before the first write
        if "PATH_NOT_FOUND" not in str(e):
            raise
    else:
        new = new.join(held.select("name"), "name", "left_anti")
    new.write.mode("append").partitionBy("shelf").parquet(store)


def get(spark: SparkSession, store: str) -> DataFrame:
    """(name, raw, shelf) of all objects; a filter on shelf and name reads little."""
    return spark.read.schema("name string, raw binary, shelf string").parquet(store)
