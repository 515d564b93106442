"""Secret scans in DataFrame functions alone: candidates by pattern, false positives removed by a random forest.

A candidate is a run of twelve characters or more with a digit in it, or any value of six or more that is assigned to a name that
speaks of secrets. Its features are its length, transitions between kinds of characters, how much of it dictionary words
cover, the path, and the words around it. The dictionary is the WORDS words that most documents of the corpus hold, counted over
all of them, and some fixed parts of names. The forest (of the machine-learning library that comes with Spark) is trained on labelled
findings. Without a table of such findings, LABELLED rows of them are made by rule from numbered templates: keys, tokens and
passwords that are assigned; and hashes of commits, checksums, identifiers, numbers, placeholders, words and long names that only
look like them. Path and neighbouring words vary independently of the template. No row of the corpus is trained on.

Defined cases: a null or empty text has no candidates; a candidate that stands in a text several times is judged at
each place, and is one finding with its best score, the first place that has it, and its count; rows are judged one by one, so repeated
rows give equal findings; a text of any length is scanned whole; a null path is empty; columns of docs other than doc_id, text and
the path aren't read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

_RUN = r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*[0-9])[A-Za-z0-9_+/-]{12,}={0,2}"
# where a run begins, cheap looks back come first: most runs fail the one for an equals sign or a colon
_ASSIGNED = (
    r"(?<![A-Za-z0-9_+/!@#$%^&*.-])(?<=[=:][ ]{0,2}[\"'`]?)(?<=(?i:passw(?:or)?d|passwort|pwd|secret|token|api_?key|credential)[\"']?[ ]{0,2}[=:][ ]{0,2}[\"'`]?)[A-Za-z0-9_+/!@#$%^&*.-]{6,}"
)
CANDIDATE = f"{_RUN}|{_ASSIGNED}"
#: Words of the corpus in the dictionary: what is sent to executors is bounded by it.
WORDS = 20_000
#: Labelled findings that the forest is trained on, at most.
LABELLED = 4000
#: Characters to the left and right of a candidate that count as its neighbours.
NEAR = 48
KEPT_FROM = 0.5

#: Words of the dictionary, and words that speak for or against a secret nearby (fixed values).
DICTIONARY = "password|passwd|token|secret|example|sample|test|demo|dummy|change|your|here|user|name|admin|default|value|key|data|file|path|version|build|release|index|page|image|service|client|server|config|local|host|info|error|with|this|that|from|the|and|for|tion|ment|keit|heit|lich|elle"
FOR = "token|secret|passw|pwd|api_?key|apikey|access_?key|auth|bearer|credential|private"
AGAINST = "commit|sha|md5|checksum|digest|hash|revision|uuid|guid|etag|build|order|invoice|card|phone|isbn|example|placeholder|sample|version"
PATHS_AGAINST = "test|example|sample|fixture|mock|docs?/|readme|lock"

FEATURES = ("length", "digit_share", "upper_share", "transitions", "distinct_share", "hexadecimal", "digits_only", "dictionary", "known_words", "longest_letters", "path_against", "near_for", "near_against", "assigned", "quoted", "dashed")


def _sql(pattern: str) -> str:
    """A pattern as a literal of Spark's SQL."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def dictionary(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(word): the words of three letters or more that most documents hold, of all documents."""
    held = docs.select(F.explode(F.array_distinct(F.split(F.lower(_text("text")), r"[\s.,;:!?]+"))).alias("word"))
    return held.groupBy("word").agg(F.count("*").alias("n")).where(F.col("word").rlike("^[a-z]{3,}$")).orderBy(F.desc("n"), "word").limit(words).select("word")


def with_known_words(found: DataFrame, words: DataFrame | None) -> DataFrame:
    """found with `known_words`: the share of each value's characters that lies in words of the dictionary, between other kinds of characters."""
    if words is None:
        return found.withColumn("known_words", F.lit(0.0))
    parts = found.select("value").distinct().select("value", F.explode(F.split(F.lower(F.regexp_replace("value", "(?<=[a-z])(?=[A-Z])", " ")), "[^a-z]+")).alias("word")).where("word <> ''")
    share = parts.join(F.broadcast(words), "word").groupBy("value").agg((F.sum(F.char_length("word")) / F.char_length("value")).alias("known_words"))
    return found.join(share, "value", "left").withColumn("known_words", F.coalesce("known_words", F.lit(0.0)))


def features(found: DataFrame) -> DataFrame:
    """found (value, path, before, after, known_words) with a column for each other feature."""
    value, size = F.col("value"), F.char_length("value")
    share = lambda pattern: F.regexp_count(value, F.lit(pattern)) / size
    flag = lambda condition: condition.cast("double")
    before = F.lower("before")
    columns = {
        "length": size.cast("double"),
        "digit_share": share("[0-9]"),
        "upper_share": share("[A-Z]"),
        "transitions": share("(?<=[0-9])[^0-9]|(?<=[^0-9])[0-9]|(?<=[a-z])[A-Z]"),
        "distinct_share": F.size(F.array_distinct(F.split(value, ""))) / size,
        "hexadecimal": flag(value.rlike("^[0-9a-f]+$")),
        "digits_only": flag(value.rlike("^[0-9/_+-]+$")),
        "dictionary": 1 - F.char_length(F.regexp_replace(F.lower(value), DICTIONARY, "")) / size,
        "longest_letters": F.aggregate(F.split(value, "[^A-Za-z]+"), F.lit(0), lambda a, x: F.greatest(a, F.char_length(x))).cast("double"),
        "path_against": flag(F.lower("path").rlike(PATHS_AGAINST)),
        "near_for": flag(before.rlike(FOR)),
        "near_against": flag(F.concat(before, F.lit(" "), F.lower("after")).rlike(AGAINST)),
        "assigned": flag(F.col("before").rlike("[=:]\\s*[\"'`]?$")),
        "quoted": flag(F.col("before").rlike("[\"'`]$")),
        "dashed": flag(value.rlike("[0-9a-f]-[0-9a-f]{4}-")),
    }
    return found.select("*", *(x.alias(k) for k, x in columns.items()))


def labelled(spark: SparkSession, rows: int = LABELLED) -> DataFrame:
    """(value, path, before, after, label, known_words): labelled findings made by rule, the same each time."""
    sha, md, up = "sha1(cast(id as string))", "md5(cast(id as string))", "upper(md5(cast(id as string)))"
    kinds = (  # value, before, label
        (f"substr({sha}, 1, cast(24 + id % 17 as int))", "'token = \"'", 1),
        (f"substr({md}, 1, cast(14 + id % 9 as int))", "'password='", 1),
        (f"concat('AKIA', substr({up}, 1, 16))", "'aws access key: '", 1),
        (f"replace(base64({sha}), '=', '')", "'api_key: '", 1),
        (f"concat('ghp_', substr({sha}, 1, 36))", "'Authorization: Bearer '", 1),
        (f"concat(substr({up}, 1, 9), substr({md}, 5, 11))", "'secret = '", 1),
        (sha, "'commit '", 0),
        (md, "'checksum md5 '", 0),
        (f"concat(substr({md}, 1, 8), '-', substr({md}, 9, 4), '-', substr({md}, 13, 4), '-', substr({md}, 17, 4), '-', substr({md}, 21, 12))", "'uuid: '", 0),
        (f"lpad(cast(abs(xxhash64(id)) % 10000000000000000 as string), 16, '4')", "'the number of '", 0),
        (f"substr(translate({md}, '0123456789', 'ghjkmnpqrt'), 1, cast(8 + id % 7 as int))", "'password: \"'", 1),
        (f"concat(upper(substr({md}, 3, 3)), '!', substr({sha}, 2, 5), '#', id % 90)", "'pwd='", 1),
        ("concat('your_password_here_', id)", "'password = \"'", 0),
        ("concat('example-token-value', pmod(xxhash64(id, 5), 10))", "'token: '", 0),
        ("concat('release-candidate-version', pmod(xxhash64(id, 5), 100))", "'see the '", 0),
        ("concat('thingandtheother', pmod(xxhash64(id, 5), 10))", "'that was '", 0),
        (f"concat(substr({sha}, 1, 12), '/index/page', pmod(xxhash64(id, 5), 10))", "'at the path of '", 0),
        (f"lpad(cast(abs(xxhash64(id)) % 1000000000000 as string), 12, '0')", "'order no. '", 0),
        ("element_at(array('changeme', 'required', 'placeholder', 'your-password', 'forgotten', 'important', 'protected', 'expires', 'xxxxxxxx', '********'), cast(1 + pmod(xxhash64(id, 5), 10) as int))", "'password: '", 0),
        ("element_at(array('string', 'example', 'undefined', 'os.environ', 'settings.token', 'get_token', 'value.here', 'optional', '$TOKEN_FILE', 'none.given'), cast(1 + pmod(xxhash64(id, 5), 10) as int))", "'token='", 0),
    )
    pick = lambda i: "CASE id % {} {} END".format(len(kinds), " ".join(f"WHEN {n} THEN {k[i]}" for n, k in enumerate(kinds)))
    # path, words before and words after are dealt by hashes of their own, so none of them tells the label
    deal = lambda n, *options: "element_at(array({}), cast(1 + pmod(xxhash64(id, {}), {}) as int))".format(", ".join(f"'{x}'" for x in options), n, len(options))
    paths = deal(1, "src0", "src1", "lib/main.py", "config/settings.env", "en/src3/7.md", "tests/test_login.py", "docs/readme.md", "examples/sample.cfg")
    around = deal(2, "and the ", "of them ", "x ", "set ", "with a ", "for the build ", "in this version ")
    after = deal(3, " and then it was", '", next line', " .", " in the test", "; end", " # example")
    made = spark.range(0, rows, 1, 4).selectExpr(f"{pick(0)} AS value", f"{paths} AS path", f"concat({around}, {pick(1)}) AS before", f"{after} AS after", f"cast({pick(2)} as double) AS label")
    # words of the templates are in any corpus; the share of known words varies here as it does there
    return made.withColumn("known_words", F.when(F.col("value").rlike("^[A-Za-z_.*$-]+[0-9]{0,4}$") & (F.col("label") == 0), F.element_at(F.array(F.lit(1.0), F.lit(0.9), F.lit(0.7), F.lit(0.0)), (F.pmod(F.xxhash64("value", "before"), F.lit(4)) + 1).cast("int"))).otherwise(0.0))


def train(findings: DataFrame) -> PipelineModel:
    """A forest on labelled findings (value, path, before, after, known_words, label)."""
    forest = RandomForestClassifier(numTrees=24, maxDepth=6, seed=7, featureSubsetStrategy="sqrt", featuresCol="features", labelCol="label")
    return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), forest]).fit(features(findings))


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """(row, doc_id, value, path, start, before, after) of every place of a candidate in docs; row tells their rows apart."""
    found = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), _text("text").alias("text"), _text(path).alias("path"), F.expr(f"regexp_extract_all(text, {_sql(CANDIDATE)}, 0)").alias("_all"))
    # what stands between the matches gives their places: one more piece than matches
    gaps = found.where(F.size("_all") > 0).select("*", F.split("text", CANDIDATE, -1).alias("_gaps"))
    ends = F.expr("aggregate(arrays_zip(_all, _gaps), cast(array() as array<int>), (a, x) -> CASE WHEN x._all IS NULL THEN a ELSE concat(a, array(coalesce(try_element_at(a, -1), 0) + char_length(x._gaps) + char_length(x._all))) END)")
    each = gaps.withColumn("_ends", ends).select("row", "doc_id", "text", "path", F.explode(F.arrays_zip(F.col("_all").alias("value"), F.col("_ends").alias("end"))).alias("_one"))
    placed = each.select("row", "doc_id", "path", "text", "_one.value", (F.col("_one.end") - F.char_length("_one.value")).cast("long").alias("start"))
    return placed.select(
        "row", "doc_id", "value", "path", "start",
        F.expr(f"substring(text, cast(greatest(start - {NEAR}, 0) + 1 as int), cast(least(start, {NEAR}) as int))").alias("before"),
        F.expr(f"substring(text, cast(start + char_length(value) + 1 as int), {NEAR})").alias("after"),
    )


def scored(docs: DataFrame, model: PipelineModel, path: str = "source", words: DataFrame | None = None) -> DataFrame:
    """Candidates with `score`, the forest's probability that they are secrets where they look most like one, and that place."""
    found = candidates(docs, path)
    if words is not None:
        found = cut(found)
    places = model.transform(features(with_known_words(found, words))).select("row", "doc_id", "value", "start", F.round(vector_to_array("probability")[1], 6).alias("score"))
    best = places.groupBy("row", "doc_id", "value").agg(F.max(F.struct("score", (-F.col("start")).alias("back"))).alias("best"), F.count("*").alias("occurrences"))
    return best.select("doc_id", "value", (-F.col("best.back")).alias("start"), "occurrences", F.col("best.score").alias("score"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    found = scored(docs, train(labelled(spark)), words=cut(dictionary(docs))).where(F.col("score") >= KEPT_FROM)
    return found.select("doc_id", "start", F.char_length("value").cast("long").alias("n_chars"), "occurrences", F.sha2("value", 256).alias("value_sha256"), "score")
