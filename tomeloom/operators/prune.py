"""Regions that condensation leaves out: rules that find them, interval algebra, and removal.

Regions are rows (book_id, seq, start, stop, reason, label), half-open in characters; seq keeps
the order in which rules and positions brought them up.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import structure as S

REGION = "array<struct<start:long,stop:long,seq:long,reason:string,label:string>>"
HEAD = 5000


def placed(books: DataFrame, chapters: DataFrame | Column | None = None) -> DataFrame:
    """books with main_start (null if unknown) and head_end.

    The first title is found where the text is read: what stands before the pattern's first match
    in the text is as long as the title's offset. chapters: rows by book, which are joined, or an
    array of each book's own row, in order, which is not.
    """
    line = T.MAIN_TITLE.removeprefix("(?U)^").replace(r"\s", r"[^\S\n]")
    before = F.split("text", rf"(?Umd)^[^\S\n]*#*[^\S\n]*{line}", 2)
    title = T.bound(before, lambda p: F.when(F.size(p) == 2, F.length(F.get(p, F.lit(0))).cast("long")))
    out, found = books, title
    if isinstance(chapters, DataFrame):
        out, chapters = _with_chapters(books, chapters), F.col("_chapters")
    if chapters is not None:
        first = F.get(F.filter(chapters, lambda c: (c["level"] <= 2) & (c["start_char"] > 0)), F.lit(0))
        found = F.coalesce(first["start_char"].cast("long"), title)
    out = out.withColumn("main_start", found)
    return out.withColumn("head_end", F.coalesce("main_start", F.least(F.length("text"), F.lit(HEAD)).cast("long"))).select(*books.columns, "main_start", "head_end")


def _with_chapters(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """books with ``_chapters``, their chapters as an array in order (null: none)."""
    of = chapters.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("chapter_ix", "level", "start_char"))).alias("_chapters"))
    return books.join(of, "book_id", "left")


def main_start(books: DataFrame, chapters: DataFrame | Column | None = None) -> DataFrame:
    """book_id, main_start (null if unknown) and head_end of every book."""
    return placed(books, chapters).select("book_id", "main_start", "head_end")


#: What the rules bring up, in this order; a region's seq begins at its rule's number of thousand millions.
RULES = ("frontmatter", "head", "backmatter", "duplicate")
CHAPTER = len(RULES)  # the number of chapters among the items; they are no regions
_ITEM = "array<struct<rule:int,part:string,k:int,before:int,size:int,label:string,n:int,a:boolean,b:boolean,c:boolean>>"

#: In lower case, what stands in every match of the copyright pattern and in every contents heading of Latin letters (a last s may be a long one).
MARKS = ("版权", "isbn", "copyright", "all rights reserved", "出版发行", "印刷", "版次", "cip", "翻印必究", "定价", "content")

_BARE = r"(?Umd)^[^\S\n]*#*[^\S\n]*"
_BACK = rf"(?-U:(?i:{T.BACK_MATTER.removeprefix('(?i)^').removesuffix('$')}))[^\S\n]*$"
_BLANK = r"(?md)^[ \t]*\n"


def _items(rule: str, part, k, before, size, label, n=0, a=False, b=False, c=False) -> Column:
    """An item of a text: where it stands among those of its rule and part, the characters before and in it, and what the rule asks of it."""
    values = dict(part=part, k=k, before=before, size=size, label=label, n=n, a=a, b=b, c=c)
    return F.struct(F.lit((*RULES, "chapter").index(rule)).alias("rule"), *[(F.lit(v) if not isinstance(v, Column) else v).alias(name) for name, v in values.items()])


def _front(text: Column) -> Column:
    block = F.regexp_extract(text, r"(?ms)\A(.*?)(?:^[ \t]*\n|\z)", 1)
    one = lambda b: F.when((b != "") & S.is_frontmatter(b), F.array(_items("frontmatter", "", 0, 0, F.length(b), T.summary(b))))
    return F.when(F.ltrim(text, F.lit(T.WHITE)).startswith("---"), T.bound(block, one))  # of all others not even the block is read


def _head(text: Column, head_end: Column) -> Column:
    """Blocks between blank lines before the main text, of heads in which a rule can fire; n: contents entries,
    a: names a copyright, b: begins with a contents heading, c: holds one."""
    is_toc = lambda line: T.heading_text(line).rlike(T.TOC_HEADING)

    def may_fire(head: Column) -> Column:
        """Whether a rule can fire: words that every heading and every copyright holds, sought plainly, and lines that end like contents entries."""
        held = T.bound(F.lower(head), lambda low: functools.reduce(operator.or_, [F.contains(low, F.lit(w)) for w in MARKS]))
        entries = head.rlike(r"(?mU)\d(?<=[.．·•\s]{2}\d)\d{0,3}\s*$") & (S.toc_entries(head) >= 4)
        return held | (F.contains(head, F.lit("目")) & F.contains(head, F.lit("录"))) | entries

    def blocks(head: Column) -> Column:
        def block(x: Column, k: Column) -> Column:
            b, lines = x["b"], F.split(x["b"], "\n", -1)
            before = F.when(k > 0, F.length(x["gap"])).otherwise(0)
            return _items("head", "", k, before, F.length(b), T.summary(b), S.toc_entries(b), b.rlike(T.COPYRIGHT), is_toc(F.get(lines, F.lit(0))), F.exists(lines, is_toc))

        gaps = F.concat(F.array(F.lit("")), F.regexp_extract_all(head, F.lit(_BLANK), F.lit(0)))
        return F.when(may_fire(head), F.transform(F.arrays_zip(F.split(head, _BLANK, -1).alias("b"), gaps.alias("gap")), block))

    return T.bound(F.substring(text, F.lit(1), head_end.cast("int")), blocks)


def _back(text: Column) -> Column:
    """Lines that are back-matter headings (a) or structural ones (b), of texts that have one of the former; n: characters of the bare heading."""
    structure = T.STRUCTURE.removeprefix("(?U)^").replace(r"\s", r"[^\S\n]")
    line = rf"{_BARE}(?:{_BACK}|{structure}[^\n]*)"
    found = F.regexp_extract_all(text, F.lit(line), F.lit(0))

    def one(x: Column, k: Column) -> Column:
        return T.bound(T.heading_text(x["line"]), lambda h: _items("backmatter", "", k, F.length(x["before"]), F.length(x["line"]), h, F.length(h), h.rlike(T.BACK_MATTER), h.rlike(T.STRUCTURE)))

    both = F.filter(F.arrays_zip(F.split(text, line, -1).alias("before"), found.alias("line")), lambda x: x["line"].isNotNull())
    return F.when(text.rlike(_BARE + _BACK), F.transform(both, one))


def _starts(chapters: Column) -> Column:
    """Where the chapters begin."""
    one = lambda c, k: _items("chapter", "", k, c["start_char"].cast("int"), 0, "")
    return F.transform(chapters, one)


def _duplicates(text: Column) -> Column:
    """Every non-overlapping occurrence of each repeated line, also inside longer lines; n: the first line that it is."""

    def occurrences(r: Column) -> Column:
        literal = F.concat(F.lit("\\Q"), F.replace(r["line"], F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
        between = F.transform(F.split(text, literal, F.lit(-1)), F.length)
        found = lambda s: F.transform(F.slice(s, F.lit(1), F.size(s) - 1), lambda before, k: _items("duplicate", r["line"], k, before, F.length(r["line"]), F.substring(r["line"], 1, 30), r["first_line"]))
        return T.bound(between, found)

    return F.flatten(F.transform(_repeated(text), occurrences))


def regions(books: DataFrame, chapters: DataFrame | Column | None = None, rules: tuple[str, ...] = RULES) -> DataFrame:
    """book_id, seq, start, stop, reason and label of what the rules find in books (book_id, text).

    Each text is read once, and its items are listed inside the row; only their sizes go on. One
    shuffle by book serves the running sums that give the offsets, the boundaries (the next
    structural heading by a running minimum from the end) and what follows by book. Chapters
    (:func:`placed`) go along as items, so that the next one beyond a heading is a running minimum too.
    """
    text = F.col("text")
    makers = {"frontmatter": lambda: _front(text), "head": lambda: _head(text, F.col("head_end")), "backmatter": lambda: _back(text), "duplicate": lambda: _duplicates(text)}
    given = books.select("book_id", "text")
    if chapters is not None:
        given = _with_chapters(given, chapters) if isinstance(chapters, DataFrame) else books.select("book_id", "text", chapters.alias("_chapters"))
    ready = placed(given, None if chapters is None else F.col("_chapters"))
    nothing = F.array().cast(_ITEM)
    listed = F.concat(*[F.coalesce(makers[r]().cast(_ITEM), nothing) for r in RULES if r in rules])
    if chapters is not None and "backmatter" in rules:
        listed = F.concat(listed, F.coalesce(_starts(F.col("_chapters")).cast(_ITEM), nothing))
    sized = ready.select("*", F.length("text").cast("long").alias("_size"))  # beneath the generator, so once a text
    rows = sized.select("book_id", "main_start", "_size", F.inline(listed)).repartition("book_id")
    of = Window.partitionBy("book_id", "rule", "part")
    up, down = of.orderBy("k"), of.orderBy(F.col("k").desc())
    so_far = up.rowsBetween(Window.unboundedPreceding, 0)
    earlier, later = up.rowsBetween(Window.unboundedPreceding, -1), down.rowsBetween(Window.unboundedPreceding, -1)
    is_start = F.col("rule") == CHAPTER  # stands at its own offset
    rows = rows.withColumn("start", F.when(is_start, F.col("before")).otherwise(F.sum(F.col("before") + F.col("size")).over(so_far) - F.col("size")).cast("long"))
    rows = rows.withColumn("_following", F.sum("n").over(of) - F.sum("n").over(so_far))
    rows = rows.withColumn("_listing", F.coalesce(F.max(F.col("c") & (F.col("_following") >= 4)).over(earlier), F.lit(False)))
    rows = rows.withColumn("_structural", F.min(F.when(F.col("b"), F.col("start"))).over(later))
    is_head, is_back = F.col("rule") == RULES.index("head"), F.col("rule") == RULES.index("backmatter")
    bound = F.coalesce("_structural", "_size")
    if chapters is not None:
        place = F.when(is_start, F.col("start") * 2).otherwise((F.col("start") + F.col("n")) * 2 + 1)
        ahead = Window.partitionBy("book_id").orderBy(place.desc()).rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("_chapter", F.min(F.when(is_start, F.col("start"))).over(ahead))
        bound = F.coalesce("_chapter", "_structural", "_size")
    toc = F.col("_listing") | F.col("b") | ((F.col("size") < 3000) & (F.col("n") >= 4))
    head_reason = F.when(F.col("label") == "", None).when(F.col("a"), "copyright").when(toc, "toc")
    back_reason = F.when(F.col("a") & (F.col("main_start").isNull() | (F.col("start") >= F.col("main_start"))), "backmatter")
    named = F.get(F.array(*[F.lit(r) for r in RULES]), F.col("rule"))
    reason = F.when(is_head, head_reason).when(is_back, back_reason).otherwise(named)
    place = F.when(F.col("rule") == RULES.index("duplicate"), F.col("n").cast("long") * 100_000 + F.col("k")).otherwise(F.col("start"))
    stop = F.when(is_back, bound).otherwise(F.col("start") + F.col("size")).cast("long")
    found = rows.select("book_id", (F.col("rule").cast("long") * 1_000_000_000 + place).alias("seq"), "start", stop.alias("stop"), reason.alias("reason"), "label")
    return found.where("reason is not null")


def frontmatter_regions(books: DataFrame) -> DataFrame:
    return regions(books, rules=("frontmatter",))


def head_regions(books: DataFrame, chapters: DataFrame | Column | None = None) -> DataFrame:
    """Copyright pages and tables of contents among the blocks before the main text."""
    return regions(books, chapters, ("head",))


def backmatter_regions(books: DataFrame, chapters: DataFrame | Column | None = None) -> DataFrame:
    """From each back-matter heading to the next chapter, structural heading or the end."""
    return regions(books, chapters, ("backmatter",))


def duplicate_regions(books: DataFrame) -> DataFrame:
    return regions(books, rules=("duplicate",))


def _repeated(text: Column) -> Column:
    """array<struct<line, n, first_line>>: stripped lines of 12 or more characters that occur 3 or more times in a text.

    Equal lines are neighbours once sorted, so a line that occurs three times equals the second
    after it; all others are dropped before anything is counted.
    """

    def of_lines(lines: Column) -> Column:
        numbered = F.transform(lines, lambda x, i: F.struct(F.when(F.length(x) >= 12, T.strip(x)).alias("line"), i.alias("i")))
        ordered = F.array_sort(F.filter(numbered, lambda x: F.length(x["line"]) >= 12))

        def of_ordered(o: Column) -> Column:
            def at(i: Column) -> Column:
                return F.get(o, i)["line"]

            # Where a run of equal lines begins and where it ends, one place after the other.
            edges = F.filter(F.sequence(F.lit(0), F.size(o)), lambda i: F.when((i == 0) | (i == F.size(o)), True).otherwise(at(i) != at(i - 1)))
            runs = T.bound(edges, lambda e: F.zip_with(F.slice(e, F.lit(1), F.size(e) - 1), F.slice(e, F.lit(2), F.size(e) - 1), lambda a, b: F.struct(a.alias("a"), (b - a).alias("n"))))
            return F.transform(F.filter(runs, lambda r: r["n"] >= 3), lambda r: F.struct(at(r["a"]).alias("line"), r["n"].alias("n"), F.get(o, r["a"])["i"].alias("first_line")))

        return F.when(F.size(ordered) > 0, T.bound(ordered, of_ordered)).otherwise(F.array().cast("array<struct<line:string,n:int,first_line:int>>"))

    return T.bound(F.split(text, "\n", -1), of_lines)


def duplicate_lines(books: DataFrame) -> DataFrame:
    """book_id, line, n and first_line of the lines that a book repeats; found inside each row, without a shuffle."""
    return books.select("book_id", F.inline(_repeated(F.col("text"))))


def collected(found: DataFrame) -> DataFrame:
    """book_id, regions: an array by start, stop and seq, the order in which the rules brought them up."""
    item = F.struct("start", "stop", F.col("seq").cast("long").alias("seq"), "reason", "label")
    return found.groupBy("book_id").agg(F.array_sort(F.collect_list(item)).alias("regions"))


def excluded(found: Column, restores: Column) -> Column:
    """regions minus the restored intervals; a region that is split keeps its reason and label."""

    def minus(acc: Column, x: Column) -> Column:
        def parts(r: Column) -> Column:
            make = lambda a, b: F.struct(a.alias("start"), b.alias("stop"), r["seq"].alias("seq"), r["reason"].alias("reason"), r["label"].alias("label"))
            apart = (x["stop"] <= r["start"]) | (x["start"] >= r["stop"])
            both = F.array(make(r["start"], x["start"]), make(x["stop"], r["stop"]))
            return F.when(apart, F.array(make(r["start"], r["stop"]))).otherwise(F.filter(both, lambda p: p["start"] < p["stop"]))

        return F.flatten(F.transform(acc, parts))

    return F.aggregate(restores, found.cast(REGION), lambda acc, x: minus(acc, x).cast(REGION))


def merged(found: DataFrame) -> DataFrame:
    """Touching and overlapping regions of a book as one: the first's reason, the longer label where one extends the end.

    Regions are taken by start, stop and seq, so of two with one extent the rule that came first
    names it. A region begins a new one if it starts beyond all ends before it; of those that
    push the end on, the first of the longest label gives the label.
    """
    order = Window.partitionBy("book_id").orderBy("start", "stop", "seq")
    ended = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = found.withColumn("_ended", ended).withColumn("_fresh", F.col("_ended").isNull() | (F.col("start") > F.col("_ended")))
    rows = rows.withColumn("_run", F.sum(F.col("_fresh").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    pushes = F.col("_fresh") | (F.col("stop") > F.col("_ended"))
    first = F.min(F.struct("start", "stop", "seq", "reason"))
    label = F.min(F.when(pushes, F.struct((-F.length("label")).alias("size"), "start", "stop", "seq", "label")))
    whole = rows.groupBy("book_id", "_run").agg(first.alias("_f"), F.max("stop").alias("stop"), label.alias("_l"))
    return whole.select("book_id", F.col("_f.seq").alias("seq"), F.col("_f.start").alias("start"), "stop", F.col("_f.reason").alias("reason"), F.col("_l.label").alias("label"))


def removed_chars(found: Column) -> Column:
    return F.aggregate(found, F.lit(0).cast("long"), lambda acc, r: acc + r["stop"] - r["start"])


#: Characters of the pieces that a text is cut into before parts of it are taken.
PIECE = 4096


def applied(text: Column, found: Column) -> Column:
    """The text without the (merged) regions.

    A part of a string is found from the string's start, so the text is cut into pieces once, and
    each part is taken from the pieces that it touches.
    """
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(found, lambda r: r["stop"]))
    starts = F.concat(F.transform(found, lambda r: r["start"]), F.array(F.length(text).cast("long")))
    gaps = F.filter(F.arrays_zip(ends.alias("a"), starts.alias("b")), lambda g: g["a"] < g["b"])

    def parts(pieces: Column) -> Column:
        def part(g: Column) -> Column:
            i, j = (g["a"] / PIECE).cast("int"), ((g["b"] - 1) / PIECE).cast("int")
            lead, tail = (g["a"] - i * PIECE).cast("int"), (g["b"] - j * PIECE).cast("int")
            inner = F.array_join(F.slice(pieces, i + 2, j - i - 1), "")
            across = F.concat(F.substring(F.get(pieces, i), lead + 1, F.lit(PIECE)), inner, F.substring(F.get(pieces, j), F.lit(1), tail))
            return F.when(i == j, F.substring(F.get(pieces, i), lead + 1, tail - lead)).otherwise(across)

        return F.array_join(F.transform(gaps, part), "")

    cut_up = T.bound(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), parts)
    return F.when(F.size(found) == 0, text).otherwise(cut_up)


def mapped_offset(found: Column, position: Column) -> Column:
    """Where a position stands after removal."""
    cut = lambda acc, r: acc + F.greatest(F.lit(0).cast("long"), F.least(r["stop"], position) - r["start"])
    return position - F.aggregate(found, F.lit(0).cast("long"), cut)


def restored(found: DataFrame, restores: DataFrame) -> DataFrame:
    """found less the intervals that restores (book_id, start, stop) give back."""
    asked = restores.groupBy("book_id").agg(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))).alias("_restores"))
    one = F.array(F.struct("start", "stop", "seq", "reason", "label"))
    left = F.when(F.col("_restores").isNull(), one.cast(REGION)).otherwise(excluded(one, F.col("_restores")))
    return found.join(asked, "book_id", "left").select("book_id", F.explode(left).alias("r")).select("book_id", "r.seq", "r.start", "r.stop", "r.reason", "r.label")


def pruned(books: DataFrame, chapters: DataFrame | Column | None = None, restores: DataFrame | None = None) -> DataFrame:
    """books with regions, pruned_text, original_chars, removed_chars and kept_ratio."""
    found = regions(books, chapters)
    if restores is not None:
        found = restored(found, restores)
    out = books.join(collected(merged(found)), "book_id", "left").withColumn("regions", F.coalesce("regions", F.array().cast(REGION)))
    size = F.length("text").cast("long")
    out = out.withColumn("pruned_text", applied(F.col("text"), F.col("regions"))).withColumn("original_chars", size).withColumn("removed_chars", removed_chars(F.col("regions")))
    return out.withColumn("kept_ratio", F.when(size > 0, F.round((size - F.col("removed_chars")).cast("double") / size, 4)).otherwise(0.0))


def moved(chapters: Column, found: Column, size: Column, removed: Column) -> Column:
    """A book's chapters (array of title, level, start_char, end_char) at their places after removal, inside its row.

    Those that begin in a region or lose half or more of themselves go.
    """
    zero = F.lit(0).cast("long")

    def place(c: Column) -> Column:
        s, e = c["start_char"], F.least(c["end_char"], size)
        inside = F.exists(found, lambda r: (r["start"] <= s) & (s < r["stop"]))
        lost = F.aggregate(found, zero, lambda acc, r: acc + F.greatest(zero, F.least(r["stop"], e) - F.greatest(r["start"], s)))
        gone = inside | ((e > s) & (lost * 2 >= e - s))
        return F.struct(c["title"].alias("title"), c["level"].alias("level"), F.when(~gone, mapped_offset(found, s)).alias("start_char"), mapped_offset(found, e).alias("end_char"))

    return F.filter(F.transform(chapters, place), lambda c: (c["start_char"] < c["end_char"]) & (c["start_char"] < size - removed))


def remapped(chapters: DataFrame, found: DataFrame) -> DataFrame:
    """Chapters at their places after removal; those that begin in a region or lose half or more of themselves go.

    found: book_id, regions (merged), original_chars, removed_chars.
    """
    all_of = chapters.join(found.select("book_id", "regions", "original_chars", "removed_chars"), "book_id")
    s, e = F.col("start_char"), F.least("end_char", "original_chars")
    inside = F.exists("regions", lambda r: (r["start"] <= s) & (s < r["stop"]))
    lost = F.aggregate("regions", F.lit(0).cast("long"), lambda acc, r: acc + F.greatest(F.lit(0).cast("long"), F.least(r["stop"], e) - F.greatest(r["start"], s)))
    kept = all_of.where(~inside & ~((e > s) & (lost * 2 >= e - s)))
    moved = kept.select("book_id", "chapter_ix", "title", "level", mapped_offset(F.col("regions"), s).alias("start_char"), mapped_offset(F.col("regions"), e).alias("end_char"), (F.col("original_chars") - F.col("removed_chars")).alias("_left"))
    return moved.where("start_char < end_char and start_char < _left").drop("_left")
