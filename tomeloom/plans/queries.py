"""Queries over the standard tables, one for each operator; ``oracles`` has their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit, distill, export, ledger, modality, planning, prune, store, structure
from ..sources.tables import composed_books, conversation_books, document_books, shared_folder, spread, table
from ..streaming import tasks as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Chunks of conversation books are planned at this size, so that chunking has something to do.
SMALL_CHUNK, SMALL_OVERLAP = 600, 60


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


# Measures of texts


@query
def doc_word_count(spark, d):
    return document_books(spark, d).select("book_id", T.word_count(F.col("text")).cast("long").alias("word_count"), T.is_ok(F.col("text"), F.lit("")).alias("ok"))


@query
def doc_tokens(spark, d):
    return document_books(spark, d).select("book_id", T.tokens(F.col("text")).alias("tokens"))


@query
def cost_estimate(spark, d):
    return document_books(spark, d).select("book_id", *[c.alias(n) for n, c in T.estimate(F.col("text"), F.lit(0.15)).items()])


@query
def actual_costs(spark, d):
    li = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    return li.groupBy("l_orderkey").agg(F.sum("l_partkey").alias("hit"), F.sum("l_suppkey").alias("miss"), F.sum(F.col("l_quantity").cast("long")).alias("output")).select("l_orderkey", T.actual_cost(F.col("hit"), F.col("miss"), F.col("output")).alias("cost_cny"))


@query
def target_ratios(spark, d):
    docs = table(spark, d, "documents", "doc_id", "lang", "source")
    kind = F.when(F.col("lang") == "fr", "fiction").when(F.col("lang") == "de", "technical").otherwise("general")
    strength = F.when(F.col("source") == "src1", "conservative").when(F.col("source") == "src2", "aggressive").when(F.col("source") == "src3", "other").otherwise("standard")
    return docs.select("doc_id", F.round(T.ratio(strength, kind), 6).alias("ratio"))


# Structure


@query
def line_spans(spark, d):
    return structure.line_spans(document_books(spark, d))


@query
def summaries(spark, d):
    return document_books(spark, d).select("book_id", T.summary(F.col("text")).alias("label"))


@query
def blocks_from_lines(spark, d):
    return structure.blocks(conversation_books(spark, d))


@query
def atx_chapters(spark, d):
    return structure.markdown_chapters(conversation_books(spark, d))


@query
def short_line_headings(spark, d):
    """Structural headings by pattern: short lines that end in a stop stand in for titles in these tables."""
    return structure.headings(structure.line_spans(document_books(spark, d)), r"(?U)^\w+\.$")


@query
def html_clean(spark, d):
    pages = spread(table(spark, d, "pages", "page_id", "html"))
    text = T.html_text(F.col("html"))
    return pages.select("page_id", F.length(text).cast("long").alias("n_chars"), F.md5(text.cast("binary")).alias("text_md5"))


@query
def html_headings(spark, d):
    pages = spread(table(spark, d, "pages", "page_id", "html"))
    return pages.select("page_id", F.posexplode(structure.html_headings(F.coalesce("html", F.lit("")))).alias("n", "h")).select("page_id", F.col("n").cast("long").alias("n"), "h.level", "h.title")


@query
def html_modalities(spark, d):
    pages = spread(table(spark, d, "pages", "page_id", "html"))
    return pages.select("page_id", *[F.regexp_count(F.coalesce("html", F.lit("")), F.lit(p)).cast("long").alias(k) for k, p in modality.HTML_PATTERNS.items()])


@query
def text_modalities(spark, d):
    return document_books(spark, d).select("book_id", F.explode(modality.text_modalities(F.col("text"))).alias("w")).select("book_id", "w.type", "w.count")


@query
def merged_warnings(spark, d):
    """Events stand in for warnings: a user's errors and views by kind, the largest count first seen first."""
    e = table(spark, d, "events", "event_id", "user_id", "event_type", "value")
    w = e.select("user_id", F.col("event_id").alias("seq"), F.col("event_type").alias("type"), F.lit("正文").alias("location"), F.floor("value").cast("long").alias("count"), F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("message"))
    return modality.merge_warnings(w, "user_id")


# Pruning


@query
def dup_lines(spark, d):
    return prune.duplicate_lines(document_books(spark, d)).select("book_id", "line", F.col("n").cast("long").alias("n"))


def structure_lines(spark, d):
    return structure.line_spans(document_books(spark, d))


@query
def dup_regions(spark, d):
    books = document_books(spark, d)
    return prune.duplicate_regions(books).select("book_id", "start", "stop", "label")


@query
def head_windows(spark, d):
    books = document_books(spark, d)
    return prune.main_start(books)


@query
def copyright_blocks(spark, d):
    books = document_books(spark, d)
    return prune.head_regions(books).select("book_id", "start", "stop", "reason")


@query
def merged_regions(spark, d):
    books = document_books(spark, d)
    return prune.merged(prune.duplicate_regions(books)).select("book_id", "start", "stop", "reason")


@query
def pruned_docs(spark, d):
    """The flagship: all rules, merged, removed."""
    out = prune.pruned(document_books(spark, d))
    return out.select("book_id", F.size("regions").cast("long").alias("n_regions"), "original_chars", "removed_chars", "kept_ratio", F.md5(F.col("pruned_text").cast("binary")).alias("pruned_md5"))


@query
def kept_ratio_by_lang(spark, d):
    out = prune.pruned(document_books(spark, d))
    return out.groupBy("lang").agg(F.count("*").alias("n"), F.sum("original_chars").alias("original"), F.sum("removed_chars").alias("removed"))


@query
def subtracted_regions(spark, d):
    """Duplicate regions less the first 2000 characters of each book, which a user restores."""
    books = document_books(spark, d)
    found = prune.collected(prune.duplicate_regions(books))
    restores = F.array(F.struct(F.lit(100).cast("long").alias("start"), F.lit(2000).cast("long").alias("stop")))
    return found.select("book_id", F.explode(prune.excluded(F.col("regions"), restores)).alias("r")).select("book_id", "r.start", "r.stop")


def _conversation_regions(spark, d):
    """Every turn's first 40 characters of each book's second half are cut: regions with which chapters can be moved."""
    books = conversation_books(spark, d)
    chapters = structure.markdown_chapters(books)
    size = books.select("book_id", F.length("text").cast("long").alias("original_chars"))
    cuts = chapters.join(size, "book_id").where("start_char * 2 >= original_chars").select("book_id", "original_chars", (F.col("start_char") + 15).alias("start"), F.least(F.col("start_char") + 55, "original_chars").alias("stop"))
    found = prune.collected(prune.merged(cuts.select("book_id", "start", "stop", F.col("start").alias("seq"), F.lit("duplicate").alias("reason"), F.lit("").alias("label"))))
    found = size.join(found, "book_id", "left").withColumn("regions", F.coalesce("regions", F.array().cast(prune.REGION)))
    return chapters, found.withColumn("removed_chars", prune.removed_chars(F.col("regions")))


@query
def remapped_chapters(spark, d):
    chapters, found = _conversation_regions(spark, d)
    return prune.remapped(chapters, found).select("book_id", F.col("chapter_ix").cast("long").alias("chapter_ix"), "start_char", "end_char")


# Planning


@query
def distill_units(spark, d):
    books = conversation_books(spark, d)
    return planning.units(books, structure.markdown_chapters(books)).select("book_id", F.col("unit_ix").cast("long").alias("unit_ix"), "title", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))


def _chunks(spark, d):
    books = conversation_books(spark, d)
    units = planning.units(books, structure.markdown_chapters(books))
    return planning.chunks(units, T.ratio(F.lit("standard"), F.lit("technical")), SMALL_CHUNK, SMALL_OVERLAP)


@query
def chunk_plan(spark, d):
    return conversation_books(spark, d).select("book_id", F.posexplode(planning.chunk_spans(F.col("text"), SMALL_CHUNK, SMALL_OVERLAP)).alias("chunk_ix", "s")).select("book_id", F.col("chunk_ix").cast("long").alias("chunk_ix"), F.col("s.start").cast("long").alias("start"), F.col("s.stop").cast("long").alias("stop"))


@query
def call_counts(spark, d):
    c = _chunks(spark, d)
    return c.groupBy("book_id").agg(F.count("*").alias("calls"), F.countDistinct("unit_ix").alias("units"))


@query
def chunk_targets(spark, d):
    c = _chunks(spark, d)
    return c.select("book_id", "unit_id", F.col("target_chars").cast("long").alias("target_chars"), F.col("chunk_target").cast("long").alias("chunk_target"), F.length("chunk_text").cast("long").alias("chunk_chars"))


def _keyed(spark, d):
    key = planning.cache_key(F.col("book_id"), F.col("unit_id"), F.col("chunk_target"), F.col("chunk_text"))
    return _chunks(spark, d).withColumn("cache_key", key)


@query
def cache_keys(spark, d):
    return _keyed(spark, d).select("book_id", "unit_id", "cache_key")


@query
def prompts(spark, d):
    c = _chunks(spark, d)
    prompt = planning.user_prompt(F.col("unit_ix") + 1, F.lit(1), F.col("title"), F.col("chunk_target"), F.col("chunk_text"))
    return c.select("book_id", "unit_id", F.md5(prompt.cast("binary")).alias("prompt_md5"), F.length(planning.system_prompt(F.lit("technical"), F.lit("standard"))).cast("long").alias("system_chars"))


@query
def checkpoint_reuse(spark, d):
    """Chunks of even books have a checkpoint, of every third a cached text; some no longer suit in length."""
    c = _keyed(spark, d)
    texts = F.substring("chunk_text", F.lit(1), F.col("chunk_target"))
    done = c.where("book_id % 2 = 0").select("book_id", "unit_id", "cache_key", F.lit("done").alias("status"), texts.alias("text"))
    held = c.where("book_id % 3 = 0").select("cache_key", F.substring("chunk_text", F.lit(1), F.expr("chunk_target div 2")).alias("text"))
    return distill.reusable(c, done, held).select("book_id", "unit_id", F.length("reused").cast("long").alias("reused_chars"))


@query
def length_verdicts(spark, d):
    c = _chunks(spark, d)
    return c.select("book_id", "unit_id", T.length_issue(F.length("chunk_text"), F.col("chunk_target")).alias("issue"))


@query
def condensed_books(spark, d):
    """The stub model over all chunks, results merged in order (no SQL: the model is Python)."""
    return distill.merged(distill.condense(_keyed(spark, d)))


@query
def merged_output(spark, d):
    """Whole chunks in place of a model's answers, merged in order."""
    c = _chunks(spark, d).select("book_id", "unit_ix", "chunk_ix", F.col("chunk_text").alias("output"), F.when(F.expr("length(chunk_text) % 97 = 0"), "short").otherwise("").alias("error"))
    out = distill.merged(c)
    return out.select("book_id", F.md5(F.col("output").cast("binary")).alias("output_md5"), F.col("n_units").cast("long").alias("n_units"), F.col("n_errors").cast("long").alias("n_errors"))


@query
def result_totals(spark, d):
    c = _chunks(spark, d)
    return c.groupBy("book_id").agg(F.sum("source_chars").cast("long").alias("source_chars"), F.sum("chunk_target").cast("long").alias("target_chars"), F.count("*").alias("api_calls"))


# Ledger: orders are tasks, line items their units, parts the cache


def _tasks(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    ended = F.get(F.array(F.lit("done"), F.lit("error"), F.lit("cancelled")), F.pmod("o_orderkey", F.lit(3)).cast("int"))
    return o.select(
        F.col("o_orderkey").alias("task_id"),
        F.col("o_custkey").alias("book_id"),
        F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "running").otherwise(ended).alias("status"),
        F.lit("queued").alias("stage"),
        F.col("o_orderkey").alias("queue_order"),
        (F.col("o_orderpriority") == "1-URGENT").alias("cancel_requested"),
        (F.col("o_orderpriority") == "2-HIGH").alias("delete_requested"),
        F.col("o_orderdate").alias("created_at"),
    )


def _units(spark, d):
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_partkey", "l_shipdate", "l_quantity")
    return li.select(
        F.col("l_orderkey").alias("task_id"),
        F.format_string("unit_%05d_%03d", "l_linenumber", F.lit(0)).alias("unit_id"),
        F.when(F.col("l_returnflag") == "A", "done").when(F.col("l_returnflag") == "R", "error").otherwise("pending").alias("status"),
        F.col("l_partkey").alias("cache_key"),
        F.concat(F.lit("out "), F.col("l_quantity").cast("long").cast("string")).alias("output"),
        F.col("l_shipdate").alias("updated_at"),
    )


def _cache(spark, d):
    p = table(spark, d, "part", "p_partkey", "p_size", "p_name")
    return p.select(F.col("p_partkey").alias("cache_key"), F.when(F.col("p_size") > 25, F.col("p_size").cast("long")).alias("book_id"), F.col("p_name").alias("output"), F.lit(0).cast("long").alias("hit_count"))


@query
def next_queue_orders(spark, d):
    t = _tasks(spark, d)
    known = t.where("task_id % 5 <> 0")
    return ledger.next_orders(known, t.select("task_id", "created_at")).select("task_id", "queue_order")


@query
def claimable(spark, d):
    return ledger.eligible(_tasks(spark, d)).select("task_id", "queue_order")


@query
def claim_first(spark, d):
    """The first eligible task of the queue is claimed."""
    t = _tasks(spark, d)
    first = ledger.eligible(t).agg(F.min_by("task_id", "queue_order").alias("task_id"))
    return ledger.claims(t, first).groupBy("status").agg(F.count("*").alias("n"))


@query
def claims_compared(spark, d):
    """Claims of every third task, eligible or not, with what came of them."""
    t = _tasks(spark, d)
    after = ledger.claims(t, t.where("task_id % 3 = 0").select("task_id")).select("task_id", F.col("status").alias("after"), F.col("stage").alias("stage"))
    return t.where("task_id % 3 = 0").select("task_id", "status").join(after, "task_id").select("task_id", (F.col("status") != F.col("after")).alias("won"), "after", "stage")


@query
def queue_listing(spark, d):
    """All tasks by queue order and age, with their shown status and both marks; places tell the order."""
    t = ledger.shown_status(_tasks(spark, d).withColumn("status", F.when(F.expr("task_id % 11 = 0"), "quality_failed").otherwise(F.col("status"))))
    return ledger.placed(t).select("task_id", "status", "cancel_requested", "delete_requested", "place")


@query
def task_lookups(spark, d):
    """Tasks looked up by id, with those that aren't there."""
    asked = table(spark, d, "lineitem", "l_orderkey").select((F.col("l_orderkey") + 50).alias("task_id")).distinct()
    return ledger.looked_up(_tasks(spark, d), asked).select("task_id", "found", F.coalesce("status", F.lit("")).alias("status"))


@query
def cancel_states(spark, d):
    t = _tasks(spark, d)
    return ledger.cancelled(t, t.where("task_id % 7 = 0")).groupBy("status", "stage", "cancel_requested").agg(F.count("*").alias("n"))


@query
def recovery_states(spark, d):
    return ledger.recovered(_tasks(spark, d)).select("task_id", "status", "stage")


@query
def upsert_latest(spark, d):
    u = _units(spark, d).select("cache_key", "status", "updated_at", "task_id")
    return ledger.upserted(u.where("task_id % 2 = 0"), u.where("task_id % 2 = 1"), ["cache_key"], tie="task_id").select("cache_key", F.col("updated_at").cast("timestamp").alias("updated_at"))


@query
def failed_reset(spark, d):
    return ledger.reset_failed(_units(spark, d)).groupBy("status").agg(F.count("*").alias("n"), F.count("output").alias("with_output"))


@query
def cache_puts(spark, d):
    new = table(spark, d, "supplier", "s_suppkey", "s_nationkey", "s_name").select(F.col("s_suppkey").alias("cache_key"), F.when(F.col("s_nationkey") > 12, F.col("s_nationkey").cast("string")).otherwise("").alias("book_id"), F.col("s_name").alias("output"))
    old = _cache(spark, d).withColumn("book_id", F.coalesce(F.col("book_id").cast("string"), F.lit("")))
    return ledger.put_cache(old, new)


@query
def cache_hits(spark, d):
    return ledger.counted_hits(_cache(spark, d), _units(spark, d)).select("cache_key", "hit_count")


@query
def cache_backfill(spark, d):
    out = ledger.backfilled(_cache(spark, d).withColumn("book_id", F.coalesce(F.col("book_id").cast("string"), F.lit(""))), _units(spark, d), _tasks(spark, d).withColumn("book_id", F.col("book_id").cast("string")))
    return out.select("cache_key", "book_id")


@query
def delete_answers(spark, d):
    asked = table(spark, d, "lineitem", "l_orderkey").select((F.col("l_orderkey") + 50).alias("task_id"))
    return ledger.delete_requested(_tasks(spark, d), asked)


@query
def cascade_delete(spark, d):
    t, u = _tasks(spark, d), _units(spark, d)
    left, units = ledger.deleted(t, u, t.where("delete_requested").select("task_id"))
    return left.join(units.groupBy("task_id").agg(F.count("*").alias("n_units")), "task_id", "left").select("task_id", F.coalesce("n_units", F.lit(0)).alias("n_units"))


@query
def book_purge(spark, d):
    books = table(spark, d, "customer", "c_custkey").where("c_custkey % 50 = 1").select(F.col("c_custkey").alias("book_id"))
    _, _, cache = ledger.purged(_tasks(spark, d), _units(spark, d), _cache(spark, d), books)
    return cache.select("cache_key")


@query
def deletion_previews(spark, d):
    return ledger.deletion_preview(_tasks(spark, d))


@query
def moved_task(spark, d):
    """The last eligible task is put before the first that can be divided by seven."""
    waiting = ledger.eligible(_tasks(spark, d))
    asked = waiting.agg(F.max("task_id").alias("moved"), F.min(F.when(F.col("task_id") % 7 == 0, F.col("task_id"))).alias("before"))
    return ledger.moved_before(waiting, asked).select("task_id", "queue_order")


@query
def deletion_states(spark, d):
    c = table(spark, d, "customer", "c_custkey", "c_mktsegment", "c_nationkey")
    state = F.get(F.array(F.lit("preparing"), F.lit("staged"), F.lit("completed"), F.lit("failed")), F.pmod("c_custkey", F.lit(4)).cast("int"))
    rows = c.select(F.col("c_custkey").alias("book_id"), state.alias("state"), F.col("c_nationkey").alias("created_at"))
    return ledger.incomplete(ledger.advanced(rows, "staged", rows.where("created_at < 5"))).groupBy("state").agg(F.count("*").alias("n"))


# Library


@query
def library_listing(spark, d):
    docs = table(spark, d, "documents", "doc_id", "source", "n_chars", "text")
    meta = table(spark, d, "labels", "doc_id", "quality")
    status = F.when(F.col("quality") == 1, "ok").when(F.col("quality") == 0, "error").otherwise("pending")
    shown = F.when((status == "pending") & (T.word_count(F.col("text")) > 0), "ok").otherwise(status)
    return docs.join(meta, "doc_id", "left").select("doc_id", F.coalesce("source", F.lit("")).alias("title"), shown.alias("extract_status"), F.coalesce("n_chars", F.lit(0)).alias("word_count"))


@query
def extraction_recovery(spark, d):
    docs, meta = table(spark, d, "documents", "doc_id", "n_chars"), table(spark, d, "labels", "doc_id", "toxic")
    return docs.join(meta, "doc_id", "left").where("toxic is null and not n_chars > 1000").select("doc_id")


# Audit and export


@query
def claim_candidates(spark, d):
    return audit.claims(table(spark, d, "benchmark", "item_id", "text").select(F.col("item_id").alias("book_id"), F.regexp_replace("text", r"\. ", ".; ").alias("text"))).select("book_id", F.col("line_no").cast("long").alias("line_no"), "claim")


def _document_claims(spark, d):
    """Five claims of every document (one chapter each); full stops end sentences in these tables."""
    docs = table(spark, d, "documents", "doc_id", "text")
    chapters = docs.select(F.col("doc_id").alias("book_id"), F.lit(0).alias("chapter_index"), F.regexp_replace(F.coalesce("text", F.lit("")), r"\.(?=\s)", ".;").alias("text"))
    return audit.picked(chapters, "20260809")


@query
def audit_samples(spark, d):
    """Five claims of every conversation, spread over its turns."""
    turns = table(spark, d, "conversations", "conv_id", "turn", "text")
    chapters = turns.select(F.col("conv_id").alias("book_id"), F.col("turn").cast("int").alias("chapter_index"), F.regexp_replace(F.coalesce("text", F.lit("")), r"\.(?=\s)", ".;").alias("text"))
    return audit.picked(chapters, "20260809").select("book_id", F.col("sample").cast("long").alias("sample"), F.col("chapter_index").cast("long").alias("chapter_index"), F.col("line_no").cast("long").alias("line_no"), "claim")


@query
def bigram_windows(spark, d):
    """Five claims of every document against that document's windows, the best five windows of each."""
    claims = _document_claims(spark, d)
    asked = claims.select(F.struct("book_id", "sample").alias("claim_id"), "claim", F.col("book_id").alias("source_id"))
    docs = table(spark, d, "documents", "doc_id", "text").select(F.col("doc_id").alias("source_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = audit.best_windows(asked, docs)
    return found.select(F.col("claim_id.book_id").alias("book_id"), F.col("claim_id.sample").cast("long").alias("sample"), F.col("rank").cast("long").alias("rank"), F.col("start").cast("long").alias("start"), F.round("score", 6).alias("score"))


@query
def evidence_matches(spark, d):
    """The middle of every document, white space changed in every third, sought in it."""
    docs = document_books(spark, d)
    part = F.expr("substring(text, cast(length(text) / 2 as int), 60)")
    quote = F.when(F.col("book_id") % 3 == 0, F.replace(part, F.lit(" "), F.lit("  "))).otherwise(part)
    found = audit.evidence(F.col("text"), F.col("_quote"))
    return docs.withColumn("_quote", quote).select("book_id", *[c.alias(n) for n, c in found.items()])


@query
def sample_per_group(spark, d):
    lines = structure_lines(spark, d).select("book_id", "line_no")
    return audit.seeded_pick(lines, "20260809", "book_id", "line_no").select("book_id", F.col("line_no").cast("long").alias("line_no"))


@query
def audit_rollup(spark, d):
    return audit.rollup(table(spark, d, "labels", "quality").select((F.col("quality") == 1).alias("supported")))


@query
def export_markdown(spark, d):
    """Every document exported whole, every third with a warning."""
    docs = document_books(spark, d)
    warned = F.array(F.struct(F.lit("body").alias("location"), F.lit("check").alias("message"), (F.col("book_id") % 5).cast("long").alias("count")))
    warnings = F.when(F.col("book_id") % 3 == 0, warned).otherwise(F.slice(warned, 1, 0))
    size = F.length("text")
    md = export.markdown(F.coalesce("title", F.lit("")), F.lit(""), F.col("source_format"), F.lit("standard"), size, size, F.lit(1), F.col("book_id") % 3, warnings, F.col("text"))
    return docs.select("book_id", F.length(md).cast("long").alias("n_chars"), F.md5(md.cast("binary")).alias("markdown_md5"))


@query
def export_names(spark, d):
    o = table(spark, d, "orders", "o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority")
    taken = F.row_number().over(Window.partitionBy("o_orderpriority", "o_orderdate").orderBy("o_orderkey")) - 1
    return o.select("o_orderkey", export.file_name(F.translate("o_orderpriority", "-", "?"), F.col("o_orderdate"), taken).alias("file_name"))


@query
def latest_event_states(spark, d):
    """The job-event log's last state of each user and day (the batch form of the stream in ``streaming``)."""
    e = table(spark, d, "events", "user_id", "ts", "event_type", "event_id")
    return e.groupBy(F.date_trunc("day", "ts").alias("day"), "user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"), F.count("*").alias("n"))


# Books composed of documents, in which every rule has something to find


@query
def rule_regions(spark, d):
    """What each rule finds, before anything is merged."""
    found = prune.regions(composed_books(spark, d))
    return found.select("book_id", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "reason")


@query
def rule_removal(spark, d):
    """All rules merged and removed; a front matter that names a copyright stays front matter."""
    out = prune.pruned(composed_books(spark, d))
    reasons = F.array_join(F.transform("regions", lambda r: r["reason"]), ",")
    return out.select("book_id", reasons.alias("reasons"), "original_chars", "removed_chars", F.md5(F.col("pruned_text").cast("binary")).alias("pruned_md5"))


@query
def composed_chapters(spark, d):
    chapters = structure.plain_chapters(composed_books(spark, d))
    return chapters.select("book_id", F.col("chapter_ix").cast("long").alias("chapter_ix"), "title", F.col("level").cast("long").alias("level"), F.col("start_char").cast("long").alias("start_char"), F.col("end_char").cast("long").alias("end_char"))


@query
def distill_inputs(spark, d):
    """Books of even number have a pruned text and its chapters, the others their own."""
    books = composed_books(spark, d).withColumn("chapters", structure.chapters_of(F.col("text")))
    done = prune.pruned(books.where("book_id % 2 = 0"), F.col("chapters"))
    moved = prune.moved(F.col("chapters"), F.col("regions"), F.col("original_chars"), F.col("removed_chars"))
    out = distill.inputs(books, done.withColumn("pruned_chapters", moved))
    first = F.array_min(F.transform("chapters", lambda c: c["start_char"]))
    return out.select("book_id", F.length("text").cast("long").alias("n_chars"), F.size("chapters").cast("long").alias("n_chapters"), first.alias("first_char"))


@query
def plan_estimate(spark, d):
    """The estimate of every conversation over its real plan of calls."""
    books = conversation_books(spark, d)
    calls = _chunks(spark, d).groupBy("book_id").agg(F.count("*").alias("calls"))
    every = books.join(calls, "book_id", "left").withColumn("calls", F.coalesce("calls", F.lit(0)))
    return every.select("book_id", *[c.alias(n) for n, c in T.estimate(F.col("text"), T.ratio(F.lit("standard"), F.lit("technical")), F.col("calls")).items()])


# More of the ledger and the library


@query
def task_updates(spark, d):
    t = _tasks(spark, d)
    changes = t.where("task_id % 3 = 0").select("task_id", F.lit("error").alias("status"), F.when(F.col("task_id") % 2 == 0, "late").alias("stage"))
    return ledger.updated(t, changes).groupBy("status", "stage").agg(F.count("*").alias("n"))


@query
def unknown_updates(spark, d):
    asked = table(spark, d, "lineitem", "l_orderkey").select((F.col("l_orderkey") + 50).alias("task_id")).distinct()
    return ledger.missing(_tasks(spark, d), asked)


@query
def ordered_units(spark, d):
    return ledger.units_in_order(_units(spark, d).select("task_id", "unit_id")).select("task_id", "unit_id", "place")


@query
def book_tasks(spark, d):
    return ledger.tasks_of_books(_tasks(spark, d)).select("book_id", "task_id", "place")


@query
def deletion_guards(spark, d):
    c = table(spark, d, "customer", "c_custkey", "c_nationkey")
    deletions = c.where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("book_id"), F.when(F.col("c_nationkey") < 10, "staged").otherwise("failed").alias("state"))
    return ledger.prepared_deletions(_tasks(spark, d), deletions, c.where("c_custkey % 3 <> 1").select(F.col("c_custkey").alias("book_id")))


@query
def event_props(spark, d):
    """The events' JSON with defaults; every seventh is damaged on purpose."""
    e = table(spark, d, "events", "event_id", "props")
    raw = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("{"), F.col("props"))).otherwise(F.col("props"))
    row = ledger.decoded_row(raw, "k long, note string")
    return e.select("event_id", F.coalesce(row["k"], F.lit(0)).alias("k"), F.coalesce(row["note"], F.lit("")).alias("note"))


@query
def resource_ids(spark, d):
    p = table(spark, d, "part", "p_partkey", "p_name")
    return p.select("p_partkey", ledger.is_resource_id(F.col("p_name")).alias("as_it_is"), ledger.is_resource_id(F.translate("p_name", " #", "_-")).alias("joined"))


@query
def book_files(spark, d):
    """Files named by suppliers, of the books that are every third supplier: book 1 isn't book 10."""
    k = F.col("s_suppkey").cast("string")
    s = table(spark, d, "supplier", "s_suppkey")
    names = F.array(*[F.struct(F.lit(folder).alias("folder"), F.concat(F.lit("b"), k, F.lit(end)).alias("name")) for folder, end in (("books", ".txt"), ("books", ".meta.json"), ("books", "_0.epub"), ("books", ".pdf"), ("intermediate", ".prune.json"), ("intermediate", "_x"))])
    files = s.select(F.explode(names).alias("f")).select("f.*")
    return ledger.managed_files(files, s.where("s_suppkey % 3 = 1").select(F.concat(F.lit("b"), k).alias("book_id")))


@query
def source_fingerprints(spark, d):
    """Every second document knows its fingerprint, every fourth a damaged one."""
    docs = spread(table(spark, d, "documents", "doc_id", "text"))
    content = F.coalesce("text", F.lit("")).cast("binary")
    known = F.when(F.col("doc_id") % 4 == 0, "not a digest").when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" "), F.upper(F.sha2(F.col("doc_id").cast("string"), 256))))
    return docs.select("doc_id", ledger.fingerprint(known, content).alias("fingerprint"))


# The event log as tasks' lives and as requests (the batch forms of the streams)


@query
def task_states(spark, d):
    """Every user as a task, its events as what happened to it, with a lease of two days."""
    kinds = "create claim stage done retry create claim error cancel recover claim delete".split()
    kind = F.get(F.array(*[F.lit(k) for k in kinds]), F.pmod("event_id", F.lit(len(kinds))).cast("int"))
    e = table(spark, d, "events", "event_id", "ts", "user_id", "event_type")
    log = e.select(F.col("user_id").alias("task_id"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), kind.alias("kind"), F.col("event_type").alias("stage"))
    return streams.states(log, timedelta(days=2)).withColumn("at", F.unix_micros("at"))


@query
def requests_once(spark, d):
    """Events of one user and type, each within six hours of the one before, count once."""
    e = table(spark, d, "events", "event_id", "ts", "user_id", "event_type").withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.first_requests(e, ["user_id", "event_type"], "ts", timedelta(hours=6)).select("event_id", "user_id", "event_type")


# Results that are stored and read again


@query
def stored_prunes(spark, d):
    """A run over all documents, another over those of even number, in which every fourth is given back whole; what is stored then."""
    books = document_books(spark, d)
    meta = books.select("book_id", F.lit("ok").alias("extract_status"), F.array().cast(store.CHAPTERS).alias("chapters"))
    runs = store.Runs(spark, f"{shared_folder(spark)}/prunes-{uuid.uuid4().hex}", "book_id")
    store.run_prune(runs, store.sources(books, meta))
    even = store.sources(books.where("book_id % 2 = 0"), meta.where("book_id % 2 = 0"))
    whole = books.where("book_id % 4 = 0").select("book_id", F.array(F.array(F.lit(0), F.length("text")), F.array(F.lit(7))).alias("pairs"))
    store.run_prune(runs, even, store.restore_pairs(whole))
    out = store.last_results(runs, books.select("book_id").union(spark.range(1).select(F.lit(-1).cast("long"))))
    return out.select("book_id", "answer", "run", F.size("regions").cast("long").alias("n_regions"), "original_chars", "removed_chars", F.md5(F.col("pruned_text").cast("binary")).alias("pruned_md5"))


@query
def prune_sources(spark, d):
    """Documents with the labels' quality as their status; some have no text, some no metadata."""
    docs = document_books(spark, d).where("book_id % 7 <> 0").select("book_id", "text")
    one = F.struct(F.lit(None).cast("string").alias("title"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("long").alias("start_char"), F.lit(None).cast("long").alias("end_char"))
    meta = table(spark, d, "labels", "doc_id", "quality").select(F.col("doc_id").alias("book_id"), F.when(F.col("quality") == 1, "ok").otherwise("error").alias("extract_status"), F.array(one).alias("chapters"))
    out = store.sources(docs, meta)
    return out.select("book_id", "answer", F.get("chapters", F.lit(0))["level"].alias("level"), F.get("chapters", F.lit(0))["end_char"].alias("end_char"))


# Audits in stages


@query
def located_units(spark, d):
    """Every document's lines as its units, in even books from the end, with some that aren't in the text."""
    books = document_books(spark, d)
    even, spoiled = F.col("book_id") % 2 == 0, (F.col("book_id") % 5 == 0) & (F.col("line_no") % 3 == 0)
    lines = books.select("book_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).where("line <> ''")
    units = lines.select("book_id", F.when(even, -F.col("line_no")).otherwise(F.col("line_no")).cast("long").alias("unit_ix"), F.when(spoiled, F.concat("line", F.lit(" not there"))).otherwise(F.col("line")).alias("segment"))
    return audit.located(units, books)


@query
def staged_audit(spark, d):
    """A claim of every document against it, with given verdicts in place of a judge's: some supported without evidence, some rejected, some in conflict."""
    books = document_books(spark, d)
    windows = F.transform(audit.windows(F.col("text")), lambda w, k: F.struct((k * audit.STRIDE).cast("long").alias("start"), w.alias("text")))
    samples = books.select(F.col("book_id").alias("sample_id"), F.substring("text", 1, 30).alias("claim"), F.col("text").alias("source"), (F.col("book_id") * 1000).alias("source_start"), windows.alias("windows"))

    def judge(asked, mode, attempt):
        stage = audit.STAGES.index((mode, attempt))
        middle = F.substring(F.col("source"), F.floor(F.length("source") / 2).cast("int"), F.lit(40))
        quote = F.when((F.col("sample_id") + 2 * stage) % 3 == 0, middle).otherwise(f"nowhere #{stage}#")
        heard = asked.where((F.col("sample_id") + stage) % 13 != 0)
        return heard.select("sample_id", ((F.col("sample_id") + stage) % 4 != 0).alias("supported"), (F.lit(stage == 0) & (F.col("sample_id") % 11 == 0)).alias("conflict"), quote.alias("evidence"), F.when(F.col("sample_id") % 5 != 0, (F.col("sample_id") % 7).cast("int")).alias("evidence_window"))

    out = audit.staged(samples, judge, f"{shared_folder(spark)}/audit-{uuid.uuid4().hex}")
    return out.drop("claim", "source", "source_start", "windows")
