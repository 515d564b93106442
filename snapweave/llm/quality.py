"""Quality rules: one table of thresholds, compiled into one projection of built-in functions.

Every measure is a Catalyst expression over the row itself: no shuffle, no user function, and only the columns named are
read. Defined cases: a null text has no words; an empty text is as null; a text of any length is one value of its row, measured
whole; repeated rows are judged alike; other columns pass through whatever their names are; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import quoted, whole_row

#: Words of a window whose repeat within a text counts: a power of two.
REPEAT_WORDS = 8

#: Frequent words of the four languages of the corpus (fixed values).
STOP_WORDS = (
    "the a an and of to in is it that for on with as was be by this are at from or have not"
    " de la le les et des en un une du que qui dans pour est au par sur"
    " el los las y una con del se por no es lo al su"
    " der die das und in den von zu mit sich ist im nicht ein eine auf für dem als auch"
).split()


#: Octets of the longest. No form of theirs is longer: only k, å and ß have a longer one in upper case, and they hold none.
STOP_OCTETS = max(len(w.encode()) for w in STOP_WORDS)
assert not set("kåß") & set("".join(STOP_WORDS))


class Rule(NamedTuple):
    name: str
    measure: str  # SQL over the measures
    least: float | None
    most: float | None
    holds_from: int  # words from which the rule is applied: a ratio of few words says nothing


#: The method's own verdict; a row is kept if every measure lies within its bounds.
RULES = (
    Rule("mean_word", "word_chars / nullif(n_words, 0)", 2.0, 25.0, 20),
    Rule("symbol_ratio", "n_symbols / nullif(n_words, 0)", None, 0.4, 20),
    Rule("stop_ratio", "n_stop / nullif(n_words, 0)", 0.02, None, 50),
    Rule("pipe_ratio", "n_pipes / nullif(n_words, 0)", None, 0.15, 20),
    Rule("shout_ratio", "n_shouts / nullif(n_words, 0)", None, 0.3, 20),
    Rule("stutter_ratio", "n_stutters / nullif(n_words, 0)", None, 0.3, 20),
    Rule("dup_line_ratio", "n_dup_lines / greatest(n_lines, 1)", None, 0.5, 20),
)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc, m): each row of docs as a struct, and a struct of all measures; own columns can't clash with those of docs."""
    white = r"[\\x20\\x09-\\x0D]"
    base = docs.select(whole_row(docs).alias("doc"), F.coalesce(F.col(quoted(text)).cast("string"), F.lit("")).alias("t"))
    split = base.select("*", F.expr(f"array_remove(split(t, '{white}+'), '')").alias("w"), F.expr("filter(split(t, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')").alias("l"))
    hashed = split.select("*", F.size("w").alias("n"), F.expr("transform(w, x -> xxhash64(x))").alias("h"))
    # hashes of twice as many words from two of half as many: three steps a window, not eight
    gram, span = hashed.select("*", F.col("h").alias("g")), 1
    while span < REPEAT_WORDS:
        gram = gram.withColumn("g", F.expr(f"transform(g, (x, i) -> xxhash64(x, get(g, i + {span})))"))
        span *= 2
    gram = gram.withColumn("g", F.expr(f"if(n < {REPEAT_WORDS}, array(), slice(g, 1, greatest(n - {REPEAT_WORDS - 1}, 0)))"))
    some = gram.select("*", (F.size(F.array_distinct("g")) < F.size("g")).alias("some"))
    # sorted windows stand beside their equals; only texts that have any are sorted
    ranked = some.select("*", F.expr("if(some, sort_array(transform(g, (x, i) -> struct(x as g, i))), array())").alias("s"))
    twice = ranked.select(
        "*",
        F.expr("if(some, sort_array(transform(filter(transform(s, (x, i) -> struct(x.i as at, coalesce(get(s, i - 1).g = x.g, false) or coalesce(get(s, i + 1).g = x.g, false) as hit)), x -> x.hit), x -> x.at)), array())").alias("r"),
    )
    # only words as short as a stop word are put in lower case, which costs more than all else about a word
    stop = f"filter(w, x -> octet_length(x) <= {STOP_OCTETS} and lower(x) in ({', '.join(repr(w) for w in sorted(set(STOP_WORDS)))}))"
    measures = {
        "n_words": "cast(n as bigint)",
        "word_chars": "cast(char_length(array_join(w, '')) as bigint)",
        "n_symbols": "cast(regexp_count(t, '[#*$%&|<>]') as bigint)",
        "n_lines": "cast(size(l) as bigint)",
        "n_dup_lines": "cast(size(l) - size(array_distinct(l)) as bigint)",
        "n_repeat_words": f"cast(if(some, aggregate(transform(r, (p, i) -> least({REPEAT_WORDS}, coalesce(get(r, i + 1) - p, {REPEAT_WORDS}))), 0L, (a, x) -> a + x), 0L) as bigint)",
        "n_stop": f"cast(size({stop}) as bigint)",
        "n_pipes": "cast(char_length(t) - char_length(replace(t, '|', '')) as bigint)",
        "n_stutters": "cast(size(filter(h, (x, i) -> x = get(h, i - 1))) as bigint)",
        "n_shouts": "cast(size(filter(w, x -> endswith(x, '!!'))) as bigint)",
    }
    return twice.select("doc", F.struct(*(F.expr(v).alias(k) for k, v in measures.items())).alias("m"))


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The threshold table as one condition over `m`."""
    passed = F.lit(True)
    for r in rules:
        value, n = F.expr(_prefixed(r.measure)), F.col("m.n_words")
        inside = F.lit(True)
        if r.least is not None:
            inside = inside & (value >= r.least)
        if r.most is not None:
            inside = inside & (value <= r.most)
        passed = passed & ((n < r.holds_from) | F.coalesce(inside, F.lit(True)))
    return passed


def _prefixed(measure: str) -> str:
    """Names of measures as fields of m."""
    return re.sub(r"\b([a-z]+_[a-z_]+)\b", r"m.\1", measure)


def base_failed() -> Column:
    return (F.col("m.n_words") < 20) | (100 * F.col("m.n_repeat_words") > 30 * F.col("m.n_words"))


def judged(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc, m, base_failed, kept) of each row of docs."""
    # a filter on kept must not be pushed below the measures, where it would hold each of them many times over;
    # a row number, which isn't deterministic, keeps it above
    rows = measured(docs, text).select("*", F.monotonically_increasing_id().alias("row"))
    return rows.select("doc", "m", "row", base_failed().alias("base_failed")).select("doc", "m", "base_failed", (~F.col("base_failed") & verdict() & (F.col("row") >= 0)).alias("kept"))


def filtered(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with the columns of docs."""
    return judged(docs).where("kept").select("doc.*")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged(docs).select("doc.doc_id", *(F.col(f"m.{k}") for k in names), "base_failed", "kept")
