"""Books from tables and files: plain text, Markdown, pages and file folders."""

from __future__ import annotations

import io
import re
import tempfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import structure as S

EXTENSIONS = ("epub", "pdf", "txt", "md")


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


#: Bytes for each core from which a table's own splits are enough: row groups are about as large at most.
SPLIT_BYTES = 64 << 20


def row_groups(spark: SparkSession, files: list[str]) -> int:
    """How many row groups the Parquet files hold, by their footers."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    count = 0
    for name in files:
        source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name)), conf)
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
        count += reader.getRowGroups().size()
        reader.close()
    return count


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its scan has fewer parts with rows than these; a large table is never shuffled.

    A row group is read by one task, whichever splits it reaches into. A table of SPLIT_BYTES or
    more for each core has as many row groups as it needs, so neither its files are listed nor are
    its rows moved. Of a smaller one with fewer files than cores the footers tell.
    """
    spark = df.sparkSession
    cores, plan = spark.sparkContext.defaultParallelism, df._jdf.queryExecution()
    if int(str(plan.optimizedPlan().stats().sizeInBytes())) >= cores * SPLIT_BYTES:
        return df
    parts = plan.toRdd().getNumPartitions()
    if parts >= cores:
        files = df.inputFiles()
        if len(files) >= cores or row_groups(spark, files) >= cores:
            return df
    return df.repartition(cores)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``, else the one that it checkpoints to.

    Where there is neither, a session in one process gets a folder of this machine; on a cluster
    there is no such folder that all executors see, so that is an error.
    """
    set_so = spark.sparkContext.getCheckpointDir()  # a folder of this application's own below the one that was set
    folder = spark.conf.get("spark.checkpoint.dir", None) or (set_so and set_so.rstrip("/").rpartition("/")[0])
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spark-checkpoint-")


def document_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book_id, title, source_format, text, lang: every document as a plain-text book."""
    docs = spread(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))
    return docs.select(F.col("doc_id").alias("book_id"), F.col("source").alias("title"), F.lit("txt").alias("source_format"), F.coalesce("text", F.lit("")).alias("text"), "lang")


def conversation_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book_id, text: each conversation as Markdown with a heading per turn (level 1 for users, 2 for others)."""
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    mark = F.when(F.col("role") == "user", "# ").otherwise("## ")
    part = F.concat(mark, F.lit("turn "), F.col("turn").cast("string"), F.lit("\n\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("turn"), part.alias("part"))))
    return turns.groupBy(F.col("conv_id").alias("book_id")).agg(F.array_join(F.transform(ordered, lambda x: x["part"]), "\n").alias("text"))


def composed_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book_id, text: every document as the body of a book with front matter, copyright page, contents, chapters and references."""
    docs = spread(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    name, n = F.coalesce("source", F.lit("")), F.col("doc_id").cast("string")
    rights = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("rights: Copyright "), name, F.lit("\n"))).otherwise("")
    parts = [
        *(F.lit("---\ntitle: "), name, F.lit("\n"), rights, F.lit("---\n\n")),
        *(F.lit("Copyright "), name, F.lit("\nISBN "), n, F.lit("\n\n")),
        F.lit("CONTENTS\n\nPart one .... 1\nPart two .... 2\nPart three .... 3\nPart four .... 4\n\n"),
        *(F.lit("Chapter 1\n"), F.coalesce("text", F.lit("")), F.lit("\n\nChapter 2\nThe end of "), n, F.lit(".\n\n")),
        *(F.lit("References\nSmith, "), n, F.lit("\n")),
    ]
    return docs.select(F.col("doc_id").alias("book_id"), F.concat(*parts).alias("text"))


def sniffed(raw: bytes) -> str:
    """Text of bytes that aren't UTF-8: by their mark, else GB 18030, Big5 or Shift JIS if they decode without a flaw
    to mostly CJK text, else Windows Latin; what no charset fits is UTF-8 with replacement."""
    for mark, charset in ((b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if raw.startswith(mark):
            return raw.decode(charset, "replace")
    found = []
    for charset in ("gb18030", "big5", "shift_jis"):
        try:
            text = raw.decode(charset)
        except UnicodeDecodeError:
            continue
        beyond = [c for c in text if ord(c) > 0x7F]
        common = sum("\u4e00" <= c <= "\u9fff" or "\u3000" <= c <= "\u30ff" or "\uff00" <= c <= "\uffef" for c in beyond)
        if beyond and common >= 0.9 * len(beyond) and len(beyond) >= 2:
            found.append((common / len(beyond), text))
    if found:
        return max(found, key=lambda x: x[0])[1]  # of equals the first
    try:
        return raw.decode("cp1252")
    except UnicodeDecodeError:
        return raw.decode("utf-8", "replace")


def with_text(files: DataFrame) -> DataFrame:
    """files (content) with ``text``: UTF-8 in the JVM, other charsets by :func:`sniffed`; no byte order mark, line ends folded to \\n."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [sniffed(x) if x is not None else None for x in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    plain = F.is_valid_utf8(F.col("content").cast("string"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    utf8 = files.where(F.coalesce(plain, F.lit(True))).withColumn("text", F.decode("content", "UTF-8"))
    other = files.where(~plain).mapInArrow(decode, f"{schema}, text string")
    return utf8.unionByName(other).withColumn("text", F.regexp_replace(F.regexp_replace("text", "^\ufeff", ""), r"\r\n?", "\n"))


def epub_parts(content: bytes) -> tuple[str, str, list[str]]:
    """Title, author and HTML documents of an EPUB file in spine order, navigation left out."""
    import posixpath
    from xml.etree import ElementTree

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        opf = next(e.get("full-path") for e in ElementTree.fromstring(z.read("META-INF/container.xml")).iter() if e.tag.endswith("rootfile"))
        package = ElementTree.fromstring(z.read(opf))
        items = {e.get("id"): e for e in package.iter() if e.tag.endswith("}item")}
        spine = [items[e.get("idref")] for e in package.iter() if e.tag.endswith("}itemref") and e.get("idref") in items]
        chosen = [e for e in spine if "nav" not in (e.get("properties") or "")] or [e for e in items.values() if "html" in (e.get("media-type") or "")]
        find = lambda name: next((e.text or "" for e in package.iter() if e.tag.endswith("}" + name)), "")
        return find("title"), find("creator"), [z.read(posixpath.normpath(posixpath.join(posixpath.dirname(opf), e.get("href")))).decode("utf-8", "replace") for e in chosen]


def _epub(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path, title, author and html of EPUB files, or their error."""
    from xml.etree import ElementTree

    for batch in batches:
        rows: list[tuple] = []
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            try:
                rows.append((path, *epub_parts(content), ""))
            except (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError) as bad:
                rows.append((path, "", "", [], f"EPUB: {bad}"))
        names = ["path", "title", "author", "html", "error"]
        kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _epub_texts(html: Column) -> Column:
    return F.filter(F.transform(html, T.html_text), lambda x: T.word_count(x) > 0)


def epub_chapters(html: Column) -> Column:
    """array<struct<title, level, start_char, end_char>> of a book's documents (array<html>), each heading at its place in the cleaned text.

    A heading is sought in its document from where the one before it ended; one that isn't found is left out.
    """
    out = "array<struct<title:string,level:int,start_char:int>>"
    kept = F.filter(F.transform(html, lambda h: F.struct(T.html_text(h).alias("text"), S.html_headings(h).alias("heads"))), lambda d: T.word_count(d["text"]) > 0)

    def document(acc: Column, d: Column) -> Column:
        def heading(inner: Column, h: Column) -> Column:
            found = F.call_function("locate", h["title"], d["text"], inner["at"] + 1)
            start = (acc["start"] + found - 1).cast("int")
            more = F.concat(inner["out"], F.array(F.struct(h["title"].alias("title"), h["level"].alias("level"), start.alias("start_char")))).cast(out)
            return F.struct(F.when(found > 0, (found - 1 + F.length(h["title"])).cast("int")).otherwise(inner["at"]).alias("at"), F.when(found > 0, more).otherwise(inner["out"]).alias("out"))

        mine = F.aggregate(d["heads"], F.struct(F.lit(0).alias("at"), F.array().cast(out).alias("out")), heading, lambda x: x["out"])
        return F.struct((acc["start"] + F.length(d["text"]) + 2).cast("int").alias("start"), F.concat(acc["out"], mine).cast(out).alias("out"))

    folded = F.aggregate(kept, F.struct(F.lit(0).alias("start"), F.array().cast(out).alias("out")), document)
    ended = lambda acc: F.transform(acc["out"], lambda c, i: F.struct(c["title"].alias("title"), c["level"].alias("level"), c["start_char"].alias("start_char"), F.coalesce(F.get(acc["out"], i + 1)["start_char"], F.greatest(acc["start"] - 2, F.lit(0))).alias("end_char")))
    return T.bound(folded, ended)


def file_chapters(files: DataFrame) -> DataFrame:
    """path, chapter_ix, title, level, start_char, end_char of the chapters of text, Markdown and EPUB files (path, content)."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    books = with_text(files.where(ext.isin("txt", "md")).select("path", "content")).select(F.col("path").alias("book_id"), ext.alias("ext"), "text")
    plain, marked = S.plain_chapters(books.where("ext = 'txt'")), S.markdown_chapters(books.where("ext = 'md'"))
    columns = [F.col("book_id").alias("path"), F.col("chapter_ix").cast("int").alias("chapter_ix"), "title", F.col("level").cast("int").alias("level"), F.col("start_char").cast("long").alias("start_char"), F.col("end_char").cast("long").alias("end_char")]
    epub = files.where(ext == "epub").select("path", "content").mapInArrow(_epub, "path string, title string, author string, html array<string>, error string")
    epub = epub.select("path", F.posexplode(epub_chapters(F.col("html"))).alias("chapter_ix", "c")).select("path", "chapter_ix", "c.title", "c.level", F.col("c.start_char").cast("long").alias("start_char"), F.col("c.end_char").cast("long").alias("end_char"))
    return plain.select(*columns).unionByName(marked.select(*columns)).unionByName(epub)


def file_books(files: DataFrame) -> DataFrame:
    """Books from a binaryFile frame (path, content), by extension; unknown ones get an error row.

    PDF needs a parser that isn't available here: such files get an error row too.
    """
    named = files.withColumn("ext", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))).withColumn("stem", F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1))
    plain = with_text(named.where(F.col("ext").isin("txt", "md")))
    first = T.strip(F.regexp_extract("text", r"(?U)\A\s*([^\n]*)", 1))
    front = F.regexp_extract("text", r"(?s)\A---[ \t]*\n(.*?)\n---[ \t]*\n", 1)
    key = lambda k: F.regexp_replace(F.coalesce(F.element_at(F.regexp_extract_all(front, F.lit(rf"(?m)^\s*{k}\s*:\s*(.+?)\s*$"), F.lit(1)), F.lit(-1)), F.lit("")), r"^[\"']+|[\"']+$", "")
    heading = F.regexp_extract("text", r"(?m)^#{1,6}[ \t]+(\S.*?)[ \t]*$", 1)
    blank = T.word_count(F.col("text")) == 0
    filled = lambda c: F.when(c != "", c)
    plain = plain.select(
        "path",
        F.coalesce(filled(F.when(F.col("ext") == "md", F.coalesce(filled(key("title")), filled(heading))).otherwise(first)), F.col("stem")).alias("title"),
        F.when(F.col("ext") == "md", key("author")).otherwise("").alias("author"),
        F.col("ext").alias("source_format"),
        "text",
        F.when(blank, "empty").otherwise("").alias("error"),
    )
    epub = named.where("ext = 'epub'").select("path", "content").mapInArrow(_epub, "path string, title string, author string, html array<string>, error string")
    epub = epub.select("path", "title", "author", F.lit("epub").alias("source_format"), F.array_join(_epub_texts(F.col("html")), "\n\n").alias("text"), "error")
    epub = epub.withColumn("error", F.when((F.col("error") == "") & (F.col("text") == ""), "empty").otherwise(F.col("error")))
    other = named.where(~F.col("ext").isin("txt", "md", "epub")).select("path", F.col("stem").alias("title"), F.lit("").alias("author"), F.col("ext").alias("source_format"), F.lit("").alias("text"), F.lit("unsupported").alias("error"))
    return plain.unionByName(epub).unionByName(other).withColumn("extract_status", F.when(F.col("error") == "", "ok").otherwise("error"))
