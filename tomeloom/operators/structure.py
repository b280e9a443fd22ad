"""Lines, blocks, headings and chapters of books (book_id, text) as character intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def line_spans(books: DataFrame) -> DataFrame:
    """book_id, line_no, start, stop (with the line break), line (without it)."""
    lines = books.select("book_id", F.length("text").alias("_size"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    ahead = Window.partitionBy("book_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(ahead), F.lit(0)).cast("long"))
    return placed.select("book_id", "line_no", "start", F.least(F.col("start") + F.length("line") + 1, F.col("_size").cast("long")).alias("stop"), "line")


def blocks(books: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """book_id, start, stop of the runs of lines between blank ones (spaces and tabs only)."""
    lines = line_spans(books) if lines is None else lines
    sized = lines.join(books.select("book_id", F.length("text").alias("_size")), "book_id")
    ended = F.col("start") + F.length("line") < F.col("_size")  # a line break follows
    sized = sized.withColumn("_blank", F.col("line").rlike(r"^[ \t]*$") & ended)
    order = Window.partitionBy("book_id").orderBy("line_no")
    runs = sized.withColumn("_run", F.sum(F.col("_blank").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("not _blank")
    return runs.groupBy("book_id", "_run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.max(F.length(T.strip(F.col("line")))).alias("_any")).where("_any > 0").select("book_id", "start", "stop")


def headings(lines: DataFrame, pattern: str) -> DataFrame:
    """book_id, pos, heading of the lines whose text without heading marks matches."""
    named = lines.withColumn("heading", T.heading_text(F.col("line")))
    return named.where((F.col("heading") != "") & F.col("heading").rlike(pattern)).select("book_id", F.col("start").alias("pos"), "heading")


def _closed(books: DataFrame, opened: DataFrame) -> DataFrame:
    order = Window.partitionBy("book_id").orderBy("start_char")
    sizes = books.select("book_id", F.length("text").cast("long").alias("_size"))
    return (
        opened.join(sizes, "book_id")
        .withColumn("end_char", F.coalesce(F.lead("start_char").over(order), F.col("_size")))
        .withColumn("chapter_ix", F.row_number().over(order) - 1)
        .select("book_id", "chapter_ix", "title", "level", "start_char", "end_char")
    )


def markdown_chapters(books: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """Chapters from ATX headings; each ends where the next begins."""
    lines = line_spans(books) if lines is None else lines
    marked = lines.where(F.col("line").rlike(r"^#{1,6}\s+\S"))
    level = F.length(F.regexp_extract("line", r"^(#{1,6})\s", 1))
    return _closed(books, marked.select("book_id", T.strip(F.regexp_extract("line", r"^#{1,6}\s+(.*)$", 1)).alias("title"), level.alias("level"), F.col("start").alias("start_char")))


def chapters_of(text: Column) -> Column:
    """array<struct<title, level, start_char, end_char>> of plain text: lines that match the chapter pattern, level 1.

    They are found in the text, inside its row: what stands before and in each match gives its offset.
    """
    line = T.CHAPTER.removeprefix("(?U)^").replace(r"\s", r"[^\S\n]")
    pattern = rf"(?Umd)^{line}[^\n]*"
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("before"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("line"))

    def placed(found: Column) -> Column:
        ends = T.running(F.transform(found, lambda x: F.length(x["before"]) + F.length(x["line"])))

        def closed(e: Column) -> Column:
            start = lambda i: F.get(e, i) - F.length(F.get(found, i)["line"])
            end = lambda i: F.coalesce(start(i + 1), F.length(text).cast("long"))
            return F.transform(found, lambda x, i: F.struct(T.strip(x["line"]).alias("title"), F.lit(1).alias("level"), start(i).alias("start_char"), end(i).alias("end_char")))

        return T.bound(ends, closed)

    return T.bound(F.filter(pairs, lambda x: x["line"].isNotNull()), placed)


def plain_chapters(books: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """Chapters of plain text: lines that match the chapter pattern, level 1; without given lines nothing is shuffled."""
    if lines is None:
        return books.select("book_id", F.posexplode(chapters_of(F.col("text"))).alias("chapter_ix", "c")).select("book_id", "chapter_ix", "c.*")
    return _closed(books, lines.where(F.col("line").rlike(T.CHAPTER)).select("book_id", T.strip(F.col("line")).alias("title"), F.lit(1).alias("level"), F.col("start").alias("start_char")))


def html_headings(html: Column) -> Column:
    """array<struct<level, title>> of the h1 to h6 of a page."""
    pattern = r"(?is)<h([1-6])[^>]*>(.*?)</h\1>"
    pairs = F.arrays_zip(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)).alias("level"), F.regexp_extract_all(html, F.lit(pattern), F.lit(2)).alias("inner"))
    clean = F.transform(pairs, lambda p: F.struct(p["level"].cast("int").alias("level"), T.strip(T.html_text(p["inner"])).alias("title")))
    return F.filter(clean, lambda p: p["title"] != "")


def is_frontmatter(block: Column) -> Column:
    lines = F.filter(F.transform(F.split(block, r"\R"), T.strip), lambda x: x != "")
    body = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 2, F.lit(0)))
    edge = lambda i: F.coalesce(F.try_element_at(lines, F.lit(i)), F.lit("")).rlike("^---$")
    return (F.size(lines) > 2) & edge(1) & edge(-1) & F.forall(body, lambda x: x.rlike(T.KEY_LINE))


def toc_entries(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\R"), lambda x: T.strip(x).rlike(T.TOC_ENTRY)))
