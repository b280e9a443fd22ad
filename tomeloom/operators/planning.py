"""Units, chunks, targets and keys of the work on a book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def chunk_spans(text: Column, max_chars: int = T.MAX_CHUNK, overlap: int = T.OVERLAP) -> Column:
    """array<struct<start, stop>>: greedy runs of paragraphs and the gaps between them.

    A chunk is always a slice, so only lengths are folded: a piece that doesn't fit closes the
    chunk, and the next one begins ``overlap`` characters before its end if it was longer.
    """
    gap = r"(?U)\n\s*\n"
    pairs = F.arrays_zip(F.split(text, gap, -1).alias("p"), F.regexp_extract_all(text, F.lit(gap), F.lit(0)).alias("g"))
    sizes = F.filter(F.flatten(F.transform(pairs, lambda x: F.array(F.length(x["p"]), F.length(x["g"])))), lambda n: n.isNotNull())
    spans = "array<struct<start:int,stop:int>>"
    first = F.struct(F.lit(0).alias("s"), F.lit(0).alias("e"), F.array().cast(spans).alias("out"))

    def step(acc: Column, n: Column) -> Column:
        s, e = acc["s"], acc["e"]
        full = (e - s + n > max_chars) & (e > s)
        return F.struct(
            F.when(full, F.when(e - s > overlap, e - overlap).otherwise(e)).otherwise(s).alias("s"),
            (e + n).alias("e"),
            F.when(full, F.concat(acc["out"], F.array(F.struct(s.alias("start"), e.alias("stop"))).cast(spans))).otherwise(acc["out"]).alias("out"),
        )

    def finish(acc: Column) -> Column:
        rest = F.substring(text, acc["s"] + 1, acc["e"] - acc["s"])
        return F.when(T.word_count(rest) > 0, F.concat(acc["out"], F.array(F.struct(acc["s"].alias("start"), acc["e"].alias("stop"))).cast(spans))).otherwise(acc["out"])

    whole = F.array(F.struct(F.lit(0).alias("start"), F.length(text).alias("stop"))).cast(spans)
    return F.when(F.length(text) <= max_chars, whole).otherwise(F.aggregate(sizes, first, step, finish))


def units(books: DataFrame, chapters: DataFrame, max_chars: int = T.MAX_CHUNK, keep_preamble: bool = False) -> DataFrame:
    """book_id, unit_ix, title, start, stop, text: top-level chapters, or chunks of books without any.

    Text before the first top-level chapter is no unit, unless ``keep_preamble``.
    """
    sized = books.select("book_id", "text", F.length("text").alias("_size"))
    valid = chapters.join(sized.select("book_id", "_size"), "book_id").where("start_char >= 0 and start_char < _size")
    top = valid.withColumn("_top", F.min("level").over(Window.partitionBy("book_id"))).where("level = _top")
    order = Window.partitionBy("book_id").orderBy("start_char")
    spans = top.select(
        "book_id",
        (F.row_number().over(order) - 1).alias("unit_ix"),
        F.coalesce(F.when(F.col("title") != "", F.col("title")), F.concat(F.lit("章节 "), F.row_number().over(order).cast("string"))).alias("title"),
        F.col("start_char").cast("int").alias("start"),
        F.coalesce(F.lead("start_char").over(order), F.col("_size")).cast("int").alias("stop"),
    )
    if keep_preamble:
        first = spans.groupBy("book_id").agg(F.min("start").alias("stop")).where("stop > 0")
        spans = spans.unionByName(first.select("book_id", F.lit(-1).alias("unit_ix"), F.lit("前言").alias("title"), F.lit(0).alias("start"), "stop"))
    chaptered = spans.join(sized.select("book_id", "text"), "book_id")
    loose = sized.join(valid.select("book_id").distinct(), "book_id", "left_anti").select("book_id", "text", F.posexplode(chunk_spans(F.col("text"), max_chars)).alias("unit_ix", "_span"))
    loose = loose.select("book_id", "unit_ix", F.concat(F.lit("第 "), (F.col("unit_ix") + 1).cast("string"), F.lit(" 部分")).alias("title"), "_span.start", "_span.stop", "text")
    every = chaptered.unionByName(loose).withColumn("text", F.expr("substring(text, start + 1, stop - start)"))
    return every.where(T.word_count(F.col("text")) > 0)


def chunks(planned: DataFrame, target_ratio: Column, max_chars: int = T.MAX_CHUNK, overlap: int = T.OVERLAP) -> DataFrame:
    """planned units with one row per chunk: chunk_ix, unit_id, target_chars, chunk_target, n_chunks and the chunk's text."""
    size = F.length("text")
    with_spans = planned.withColumn("_spans", chunk_spans(F.col("text"), max_chars, overlap)).withColumn("target_chars", F.greatest((size * target_ratio).cast("int"), F.lit(T.MIN_TARGET))).withColumn("source_chars", size)
    rows = with_spans.withColumn("n_chunks", F.size("_spans")).select(*[c for c in with_spans.columns if c not in ("_spans",)], "n_chunks", F.posexplode("_spans").alias("chunk_ix", "_span"))
    return rows.select(
        "book_id",
        "unit_ix",
        "title",
        "source_chars",
        "target_chars",
        "n_chunks",
        "chunk_ix",
        F.format_string("unit_%05d_%03d", F.col("unit_ix").cast("int"), F.col("chunk_ix")).alias("unit_id"),
        F.greatest(F.lit(1), F.expr("target_chars div n_chunks")).cast("int").alias("chunk_target"),
        F.expr("substring(text, _span.start + 1, _span.stop - _span.start)").alias("chunk_text"),
    )


def cache_key(*parts: Column) -> Column:
    """SHA-256 of a JSON list of the parts, so that no two lists share a key by running together."""
    quoted = [F.concat(F.lit('"'), F.replace(F.replace(F.coalesce(p.cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')) for p in parts]
    return F.sha2(F.concat(F.lit("["), F.concat_ws(", ", *quoted), F.lit("]")), 256)


def system_prompt(book_type: Column, strength: Column) -> Column:
    focus = F.when(book_type == "fiction", "plot, people and turning points").when(book_type == "technical", "definitions, steps, figures and limits").otherwise("arguments and their examples")
    return F.format_string("Condense faithfully into Markdown. Keep %s. Strength: %s. Add nothing that the source doesn't say.", focus, strength)


def user_prompt(index: Column, total: Column, title: Column, target: Column, text: Column) -> Column:
    return F.format_string("Part %s of %s: %s\nAim at about %s characters.\n\n%s", index.cast("string"), total.cast("string"), title, target.cast("string"), text)
