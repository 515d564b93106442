"""Scalar text functions of listings and reports, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(name: Column) -> Column:
    """Lower case, runs of other characters than letters and digits as one dash, none at the ends; "project" where nothing is left."""
    found = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.when(found == "", "project").otherwise(found)


def bytes_shown(size: Column) -> Column:
    """1023 B, 1.5 KB, 812 MB, 24 GB, in steps of 1,024: one decimal below 100, and none that is 0."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        value = size / 1024**power
        tenths = F.floor(value * 10 + 0.5)
        digits = F.when(value >= 100, F.floor(value + 0.5).cast("string")).otherwise(F.concat(F.floor(tenths / 10).cast("string"), F.when(tenths % 10 == 0, "").otherwise(F.concat(F.lit("."), (tenths % 10).cast("string")))))
        out = F.when(size >= 1024**power, F.concat(digits, F.lit(f" {unit}"))).otherwise(out)
    return out


def size_change(before: Column, after: Column) -> Column:
    """What a file's size was and is: 12 B → 3.4 KB; nothing where it isn't."""
    shown = lambda x: F.when(x.isNull(), "nothing").when(x < 1024, F.concat(x.cast("string"), F.lit(" B"))).when(x < 1 << 20, F.concat(F.format_string("%.1f", x / 1024), F.lit(" KB"))).otherwise(F.concat(F.format_string("%.1f", x / (1 << 20)), F.lit(" MB")))
    return F.concat(shown(before), F.lit(" → "), shown(after))


def count_shown(n: Column) -> Column:
    return F.format_number(n, 0)


def micros(at: str) -> Column:
    """Microseconds since 1970 of a time without zone, whatever the session's zone is."""
    c = F.col(at)
    seconds = F.unix_date(c.cast("date")) * F.lit(86400).cast("long") + F.hour(c) * 3600 + F.minute(c) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")


def smaller_percent(source: Column, stored: Column) -> Column:
    """How much smaller stored is, in whole percent rounded half up, 0 at least."""
    return F.when(source > 0, F.greatest(F.lit(0), F.floor((1 - stored / source) * 100 + 0.5))).otherwise(0).cast("long")


def line_name_problem(name: Column) -> Column:
    """Why a line of saves can't have a name; null if it can."""
    return (
        F.when(F.coalesce(name, F.lit("")) == "", "empty")
        .when(F.char_length(name) > 100, "length")
        .when(~name.rlike("^[A-Za-z0-9][A-Za-z0-9._-]*$"), "characters")
        .when(name.endswith(".") | F.contains(name, F.lit("..")), "dot")
        .when(name.rlike(r"(?i)^(con|prn|aux|nul|com[0-9]|lpt[0-9])(\.|$)"), "reserved")
        .when(name.endswith(".partial"), "unfinished")
    )


def instant(at: str) -> Column:
    """A time without zone as the instant that it is in UTC, whatever the session's zone is."""
    return F.timestamp_micros(micros(at))


def url_parts(url: str) -> list[Column]:
    """host, owner and name of a repository address; empty where it has none."""
    part = lambda i: F.regexp_extract(url, r"^[a-z+]+://([^/]+)(?:/([^/?#]+))?(?:/([^/?#]+))?", i)
    return [F.lower(part(1)).alias("host"), part(2).alias("owner"), F.regexp_replace(part(3), r"\.git$", "").alias("name")]


def guarded(cell: Column) -> Column:
    """A CSV cell: quoted, and not a formula to a spreadsheet."""
    safe = F.when(cell.rlike(r"^[\s\x00-\x1f]*[=+@-]"), F.concat(F.lit("'"), cell)).otherwise(cell)
    return F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))
