"""Activity reports: totals, days, long-form export and phase times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapweave.functions.text import guarded, smaller_percent

COLUMNS = ("record_type", "repository", "date", "metric", "value", "version", "files", "source_bytes", "smaller_percent")


def totals(versions: DataFrame) -> DataFrame:
    return versions.agg(F.count("*").alias("saves"), F.sum("files").alias("files"), F.sum("source").alias("source"), F.count_distinct("project").alias("repositories"))


def daily(versions: DataFrame, zone: str = "UTC") -> DataFrame:
    """(date, saves) by calendar day of a time zone; times are without zone and in UTC."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col("at").cast("timestamp_ntz"))
    return versions.groupBy(F.date_format(local, "yyyy-MM-dd").alias("date")).agg(F.count("*").alias("saves"))


def latest(versions: DataFrame) -> DataFrame:
    """The newest version of each project."""
    return versions.groupBy("project").agg(F.max_by(F.struct("sequence", "version", "files", "source"), "sequence").alias("v")).select("project", "v.*")


def repositories(versions: DataFrame) -> DataFrame:
    return versions.groupBy("project").agg(F.count("*").alias("saves"), F.sum("source").alias("source"), F.max_by("source", "sequence").alias("stored")).select("*", smaller_percent(F.col("source"), F.col("stored")).alias("smaller"))


def long_report(versions: DataFrame) -> DataFrame:
    """All records of a report in one table of strings: summary, daily, repository and version rows."""
    text = lambda c: F.col(c).cast("string")
    sums = totals(versions)
    summary = sums.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), text(m).alias("value")) for m in ("saves", "files", "source")))).alias("m")).select(F.lit("summary").alias("record_type"), "m.*")
    days = daily(versions).select(F.lit("daily").alias("record_type"), "date", F.lit("saved_versions").alias("metric"), text("saves").alias("value"))
    projects = repositories(versions).select(F.lit("repository").alias("record_type"), text("project").alias("repository"), text("source").alias("source_bytes"), text("smaller").alias("smaller_percent"))
    each = versions.select(F.lit("version").alias("record_type"), text("project").alias("repository"), text("version").alias("version"), text("files").alias("files"), text("source").alias("source_bytes"))
    out = summary
    for part in (days, projects, each):
        out = out.unionByName(part, allowMissingColumns=True)
    return out.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in COLUMNS))


def export_problem(versions: DataFrame, saves: int) -> str | None:
    """Why an export would be wrong: another number of versions than saves that were counted, or repeated ones; None if it's right."""
    found = versions.agg(F.count("*").alias("rows"), F.count_distinct("version").alias("versions")).first()
    if found["rows"] != saves:
        return "saved history changed during the export"
    return "the export holds repeated versions" if found["versions"] != found["rows"] else None


def csv_lines(report: DataFrame, header: bool = False) -> DataFrame:
    """(line): every cell quoted and kept from being a formula; with header, a first line of names after a byte order mark. Lines end with CRLF when they are written."""
    lines = report.select(F.concat_ws(",", *(guarded(F.col(c)) for c in report.columns)).alias("line"))
    if header:
        names = "\ufeff" + ",".join(f'"{c}"' for c in report.columns)
        lines = report.sparkSession.range(1).select(F.lit(names).alias("line")).unionByName(lines)
    return lines


def write_csv(report: DataFrame, folder: str) -> None:
    """csv_lines() with header as text files, in order of their names; only the first has the header."""
    csv_lines(report, header=True).write.option("lineSep", "\r\n").text(folder)


def phases(samples: DataFrame, phase: str, took: str) -> DataFrame:
    """(phase, calls, total, slowest)."""
    return samples.groupBy(phase).agg(F.count("*").alias("calls"), F.sum(took).alias("total"), F.max(took).alias("slowest"))


def state_counts(issues: DataFrame, project: str, state: str) -> DataFrame:
    """(project, open, closed, issues) of issues by their state."""
    return issues.groupBy(project).agg(F.count_if(F.col(state) == "open").alias("open"), F.count_if(F.col(state) == "closed").alias("closed"), F.count("*").alias("issues"))
