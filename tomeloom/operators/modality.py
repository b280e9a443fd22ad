"""Tables, images, formulas and code in texts and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds in order, with the patterns that count them.
TEXT_PATTERNS = {
    "image": r"!\[[^\]]*\]\([^)]+\)|\[图片(?:：[^\]]*)?\]",
    "formula": r"(?s)\$\$.*?\$\$|(?<!\$)\$[^$\n]+\$(?!\$)|\[公式(?:：[^\]]*)?\]",
    "code": r"(?s)```[^\n]*\n.*?```",
}
HTML_PATTERNS = {
    "table": r"(?i)<table\b",
    "image": r"(?i)<(?:img|svg)\b",
    "formula": r"(?i)<(?:math|m:math)\b|class=[\"'][^\"']*(?:math|latex)",
    "code": r"(?i)<(?:pre|code)\b",
}
MESSAGES = {
    "table": "has tables: joined cells and the layout are lost in the text",
    "image": "has images: what they show isn't read",
    "formula": "has formulas: their structure isn't checked",
    "code": "has code: it is kept as text and never run",
}


def pipe_tables(text: Column) -> Column:
    """Runs of two or more pipe lines, counted over the lines (one repeated group would overflow the JVM's stack)."""
    flags = F.transform(F.split(text, "\n", -1), lambda x: F.when(x.rlike(r"(?U)^\s*\|.*\|\s*$"), "t").when(x.rlike(r"(?U)^\s*$"), "b").otherwise("x"))
    return F.regexp_count(F.regexp_replace(F.regexp_replace(F.array_join(flags, ""), "b+(?=t)", ""), "b", "x"), F.lit("tt+"))


def _counted(counts: dict[str, Column], location: str) -> Column:
    item = lambda kind, n: F.struct(F.lit(kind).alias("type"), n.cast("long").alias("count"), F.lit(location).alias("location"), F.lit(MESSAGES[kind]).alias("message"))
    return F.filter(F.array(*[item(k, n) for k, n in counts.items()]), lambda w: w["count"] > 0)


def text_modalities(text: Column, location: str = "正文") -> Column:
    text = F.coalesce(text, F.lit(""))
    return _counted({"table": pipe_tables(text)} | {k: F.regexp_count(text, F.lit(p)) for k, p in TEXT_PATTERNS.items()}, location)


def html_modalities(html: Column, location: str = "正文") -> Column:
    html = F.coalesce(html, F.lit(""))
    return _counted({k: F.regexp_count(html, F.lit(p)) for k, p in HTML_PATTERNS.items()}, location)


def merge_warnings(warnings: DataFrame, *keys: str) -> DataFrame:
    """warnings (keys, seq, type, count, location, message): one row per type and location, the largest count, in first-seen order."""
    return warnings.groupBy(*keys, "type", "location").agg(F.max("count").alias("count"), F.min_by("message", "seq").alias("message"), F.min("seq").alias("seq"))
