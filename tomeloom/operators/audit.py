"""Claims of a digest against its source: candidates, evidence, windows, samples, totals."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# The patterns of claims and quotes below, window size and stride in characters (a window is two strides), windows kept.
SIZE, STRIDE, BEST = 1600, 800, 5
#: What ends a sentence.
MARKS = "。！？!?；;"


def _parts(df: DataFrame) -> int:
    """A count of partitions to name: what follows costs far more than the bytes from which AQE would choose one."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def claims_of(text: Column) -> Column:
    """array<struct<line_no, sentence_no, claim>>: sentences of 18 to 220 characters without list and emphasis marks."""
    bare = lambda x: F.regexp_replace(T.strip(F.regexp_replace(x, r"(?U)^[#>*+\-\d.\s]+", "")), r"[*_`]+", "")

    def sentences(line: Column, i: Column) -> Column:
        ended = functools.reduce(lambda x, mark: F.replace(x, F.lit(mark), F.lit(mark + "\n")), MARKS, line)  # a line holds no line break
        said = F.transform(F.split(ended, "\n", -1), lambda x, k: F.struct(i.alias("line_no"), k.alias("sentence_no"), T.strip(x).alias("claim")))
        return F.filter(said, lambda s: F.length(s["claim"]).between(18, 220))

    def of_line(line: Column, i: Column) -> Column:
        whole = T.bound(bare(line), lambda x: F.when((F.length(x) >= 18) & ~F.endswith(x, F.lit("：")), sentences(x, i)))
        return F.when(F.length(line) >= 18, whole)  # what is too short as it stands isn't cleaned

    return F.flatten(F.filter(F.transform(F.split(text, r"\R", -1), of_line), lambda x: x.isNotNull()))


def claims(digests: DataFrame) -> DataFrame:
    """book_id, line_no, sentence_no, claim of every digest (book_id, text)."""
    return digests.select("book_id", F.inline(claims_of(F.col("text"))))


def compact(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def bigrams(text: Column) -> Column:
    """The distinct pairs of neighbouring characters, white space left out."""

    def pairs(c: Column) -> Column:
        n = F.greatest(F.size(c) - 1, F.lit(0))
        return F.array_distinct(F.zip_with(F.slice(c, F.lit(1), n), F.slice(c, F.lit(2), n), lambda a, b: F.concat(a, b)))

    return T.bound(F.split(compact(text), ""), pairs)


def windows(text: Column) -> Column:
    """array<string>: SIZE characters every STRIDE, none beyond the one that reaches the end; none of an empty text."""

    def joined(pieces: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(pieces) - 2, F.lit(0)))
        return F.transform(at, lambda i: F.concat(F.get(pieces, i), F.coalesce(F.get(pieces, i + 1), F.lit(""))))

    return F.when(text != "", T.bound(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{STRIDE}}}"), F.lit(0)), joined))


#: Claims of one source that are held against its text together; windows, and characters of texts, that are looked at together.
TOGETHER, WINDOWS, CHARS = 64, 1024, 1 << 20
_WHITE = np.zeros(ord(max(T.WHITE)) + 2, bool)
_WHITE[[ord(c) for c in T.WHITE]] = True


def _pairs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of neighbouring characters of texts, white space left out: which text, the pair as a number, where its characters stand."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    at = np.flatnonzero(~_WHITE[np.minimum(points, len(_WHITE) - 1)])
    of = np.repeat(np.arange(len(texts)), sizes)[at]
    at, points = at - (np.cumsum(sizes) - sizes)[of], points[at].astype(np.int64)
    same = np.flatnonzero(of[:-1] == of[1:])
    return of[same], points[same] << 21 | points[same + 1], at[same], at[same + 1]


def _shared(texts: list[str], asked: list[list[str]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text: how many distinct bigrams of each of its claims each of its windows holds (claims x windows), and how many each claim has.

    A text's windows and its claims' bigrams span a table of what occurs where; a pair of the text
    marks the windows that hold both its characters.
    """
    owner = np.repeat(np.arange(len(asked)), [len(x) for x in asked])
    claim, gram, _, _ = _pairs([x for some in asked for x in some])
    every, gram = np.unique(gram, return_inverse=True)
    n = max(len(every), 1)
    wanted = np.unique(owner[claim] * n + gram)  # text and bigram, in order
    first_gram = np.searchsorted(wanted, np.arange(len(texts) + 1) * n)
    windows = np.array([max(-(-len(x) // STRIDE) - 1, 1) for x in texts])
    width = np.diff(first_gram)
    table = np.cumsum(windows * width) - windows * width
    seen = np.zeros(int((windows * width).sum()), bool)
    of, pair, left, right = _pairs(texts)
    if len(every):
        place = np.minimum(np.searchsorted(every, pair), n - 1)
        key = np.flatnonzero(every[place] == pair)
        mine = of[key] * n + place[key]
        local = np.minimum(np.searchsorted(wanted, mine), len(wanted) - 1)
        hit = np.flatnonzero(wanted[local] == mine)
        key, local = key[hit], local[hit]
        of, left, right = of[key], left[key] // STRIDE, right[key] // STRIDE
        # Window w holds strides w and w + 1, so the last that holds the left one is w = left, the first that holds the right one w = right - 1.
        low, high = np.maximum(right - 1, 0), np.minimum(left, windows[of] - 1)
        column = table[of] + local - first_gram[of]
        for w in (low, high):
            held = low <= high
            seen[(column + w * width[of])[held]] = True
    each = np.unique(claim * n + gram)  # claim and bigram
    claim, gram = each // n, each % n
    column = np.searchsorted(wanted, owner[claim] * n + gram) - first_gram[owner[claim]]
    count = np.bincount(claim, minlength=len(owner))
    claims = np.searchsorted(owner, np.arange(len(texts) + 1))
    ends = np.searchsorted(claim, claims)
    out = []
    for t in range(len(texts)):
        some = slice(ends[t], ends[t + 1])
        asks = np.zeros((claims[t + 1] - claims[t], width[t]), np.float32)
        asks[claim[some] - claims[t], column[some]] = 1
        held = seen[table[t] : table[t] + windows[t] * width[t]].reshape(windows[t], width[t])
        out.append((asks @ held.T.astype(np.float32), count[claims[t] : claims[t + 1]]))
    return out


def best_windows(asked: DataFrame, sources: DataFrame, best: int = BEST) -> DataFrame:
    """asked (claim_id, claim, source_id) with the windows of that source that share most bigrams, best first.

    Texts are shuffled once and meet their claims, TOGETHER of them at a time, so a source that
    nothing asks for costs nothing; a text's characters are passed once for all of these, WINDOWS of
    its windows at a time, and only the best windows of each claim go on.
    """
    number = F.row_number().over(Window.partitionBy("source_id").orderBy("claim_id")) - 1
    blocks = asked.withColumn("_block", F.floor(number / TOGETHER)).groupBy("source_id", "_block").agg(F.collect_list(F.struct("claim_id", F.coalesce("claim", F.lit("")).alias("claim"))).alias("_asked"))
    met = blocks.join(sources.where("text <> ''").select("source_id", "text").repartition(_parts(sources), "source_id"), "source_id").select("source_id", "text", "_asked")
    names = ["claim_id", "source_id", "start", "score"]

    def some_texts(batch: pa.RecordBatch) -> Iterator[list[tuple[int, int, str, list[str]]]]:
        """Rows of a batch, or parts of long ones, with about CHARS characters: the first claim's place, the first window, text, claims."""
        lists, some, chars, place = batch.column("_asked"), [], 0, 0
        words = lists.flatten().field("claim").to_pylist()
        for row, size in enumerate(pc.list_value_length(lists).to_pylist()):
            text, mine = batch.column("text")[row].as_py(), words[place : place + size]
            for w in range(0, max(-(-len(text) // STRIDE) - 1, 1), WINDOWS):
                part = text[w * STRIDE : (w + WINDOWS + 1) * STRIDE]
                some.append((place, w, part, mine))
                chars += len(part)
                if chars >= CHARS:
                    yield some
                    some, chars = [], 0
            place += size
        if some:
            yield some

    def of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, starts, scores = [], [], []
            for some in some_texts(batch):
                for (place, w, _, mine), (shared, sizes) in zip(some, _shared([x[2] for x in some], [x[3] for x in some]), strict=True):
                    score = shared.astype(np.float64) / np.maximum(sizes, 1)[:, None]
                    top = np.argsort(-score, axis=1, kind="stable")[:, :best]
                    which.append(np.repeat(np.arange(place, place + len(mine)), top.shape[1]))
                    starts.append(((top + w) * STRIDE).ravel())
                    scores.append(np.take_along_axis(score, top, 1).ravel())
            if not which:
                continue
            lists, of = batch.column("_asked"), pa.array(np.concatenate(which))
            columns = [lists.flatten().field("claim_id").take(of), batch.column("source_id").take(pc.list_parent_indices(lists).take(of)), pa.array(np.concatenate(starts), pa.int32()), pa.array(np.concatenate(scores))]
            yield pa.RecordBatch.from_arrays(columns, names)

    kinds = {f.name: f.dataType.simpleString() for f in asked.schema}
    scored = met.mapInArrow(of_batch, f"claim_id {kinds['claim_id']}, source_id {kinds['source_id']}, start int, score double")
    rank = F.row_number().over(Window.partitionBy("claim_id").orderBy(F.col("score").desc(), "start"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= best).select("claim_id", "source_id", "rank", "start", "score")


def evidence(text: Column, quote: Column) -> dict[str, Column]:
    """match ('exact', 'whitespace_normalized', 'none') and offset (-1 if none) of a quote.

    An offset without white space is carried back by the lengths of the text's pieces between
    runs of white space: the runs before it are what it lacks.
    """
    q = F.regexp_replace(T.strip(quote), "^[\"'`“”‘’]+|[\"'`“”‘’]+$", "")
    exact = F.when(q == "", -1).otherwise(F.call_function("locate", q, text) - 1)
    loose = F.when(compact(q) == "", -1).otherwise(F.call_function("locate", compact(q), compact(text)) - 1)

    def back(at: Column) -> Column:
        gap = F.lit(r"(?U)\s+")
        runs = F.arrays_zip(F.split(text, r"(?U)\s+", -1).alias("p"), F.regexp_extract_all(text, gap, F.lit(0)).alias("g"))
        state = F.struct(F.lit(0).alias("left_out"), F.lit(0).alias("kept"))

        def step(acc: Column, x: Column) -> Column:
            kept = acc["kept"] + F.length(x["p"])
            more = F.when(kept <= at, F.coalesce(F.length(x["g"]), F.lit(0))).otherwise(0)
            return F.struct((acc["left_out"] + more).alias("left_out"), kept.alias("kept"))

        return at + F.aggregate(runs, state, step, lambda acc: acc["left_out"])

    def found(x: Column) -> Column:
        match = F.when(x["exact"] >= 0, "exact").when(x["loose"] >= 0, "whitespace_normalized").otherwise("none")
        offset = F.when(x["exact"] >= 0, x["exact"]).when(x["loose"] >= 0, back(x["loose"])).otherwise(-1)
        return F.struct(match.alias("match"), offset.cast("int").alias("offset"))

    pair = T.bound(F.struct(exact.cast("int").alias("exact"), loose.cast("int").alias("loose")), found)
    return {"match": pair["match"], "offset": pair["offset"]}


def picked(chapters: DataFrame, seed: str, samples: int = 5) -> DataFrame:
    """Claims of each digest, spread over its chapters: book_id, sample (from 1), chapter_index, line_no, claim.

    chapters: book_id, chapter_index, text. Sample k falls into the chapter at k / samples of those
    that have claims; 48 bits of a hash of seed, book, chapter and sample choose among its claims,
    and a claim that is taken already gives way to the next free one, round the end.
    """
    # Dealt by book before the claims are cut out, so that this shuffle also serves the windows.
    dealt = chapters.repartition(_parts(chapters), "book_id")
    listed = dealt.select("book_id", "chapter_index", claims_of(F.col("text")).alias("_claims"))
    of_book = Window.partitionBy("book_id")
    # Chapters without claims are told by a count, not by a filter, which would be moved before the shuffle and list all claims a second time.
    has = (F.size("_claims") > 0).cast("int")
    place, usable = F.sum(has).over(of_book.orderBy("chapter_index").rowsBetween(Window.unboundedPreceding, 0)) - 1, F.sum(has).over(of_book)
    mine = lambda k: (F.floor(k * F.col("_usable") / samples) == F.col("_place")) & (F.size("_claims") > 0)
    wanted = listed.withColumn("_place", place).withColumn("_usable", usable).withColumn("_samples", F.filter(F.sequence(F.lit(0), F.lit(samples - 1)), mine)).where(F.size("_samples") > 0)
    taken = "array<struct<k:int,line_no:int,claim:string>>"

    def bits(k: Column) -> Column:
        text = F.concat_ws(":", F.lit(seed), F.col("book_id").cast("string"), F.col("chapter_index").cast("string"), k.cast("string"))
        return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("long")

    def step(acc: Column, k: Column) -> Column:
        n = F.size("_claims")
        first = F.pmod(bits(k), n).cast("int")
        turned = F.concat(F.slice("_claims", first + 1, n), F.slice("_claims", F.lit(1), first))
        free = F.filter(turned, lambda c: ~F.exists(acc, lambda t: (t["line_no"] == c["line_no"]) & (t["claim"] == c["claim"])))
        one = F.coalesce(F.get(free, F.lit(0)), F.element_at(turned, -1))
        return F.concat(acc, F.array(F.struct(k.alias("k"), one["line_no"].alias("line_no"), one["claim"].alias("claim")))).cast(taken)

    picks = F.aggregate("_samples", F.array().cast(taken), step)
    return wanted.select("book_id", "chapter_index", F.explode(picks).alias("_p")).select("book_id", (F.col("_p.k") + 1).alias("sample"), "chapter_index", "_p.line_no", "_p.claim")


def seeded_pick(candidates: DataFrame, seed: str, group: str, order: str) -> DataFrame:
    """One candidate of each group, at the place that 48 bits of a hash of seed and group give."""
    n = F.count("*").over(Window.partitionBy(group))
    place = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    bits = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.col(group).cast("string")), 256), 1, 12), 16, 10).cast("long")
    return candidates.withColumn("_n", n).withColumn("_at", place).where(F.col("_at") == F.pmod(bits, F.col("_n"))).drop("_n", "_at")


def rollup(samples: DataFrame) -> DataFrame:
    """samples (supported boolean): all_pass, supported, total."""
    return samples.agg(F.coalesce(F.bool_and("supported"), F.lit(False)).alias("all_pass"), F.count_if("supported").alias("supported"), F.count("*").alias("total"))


def located(units: DataFrame, books: DataFrame) -> DataFrame:
    """book_id, unit_ix, start and error of units (book_id, unit_ix, segment), each at its place in its book's text.

    A segment is sought from where the one before it ended, else from the text's start; one that
    isn't there has start -1 and the error 'not found', and leaves the cursor where it was. Units of
    a book without a text are not found.
    """
    listed = units.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct(F.col("unit_ix").cast("long").alias("unit_ix"), "segment"))).alias("_units"))
    out = "array<struct<unit_ix:long,start:long>>"

    def fold(found: Column) -> Column:
        def step(acc: Column, u: Column) -> Column:
            ahead = F.call_function("locate", u["segment"], F.col("text"), acc["cursor"] + 1)
            at = T.bound(ahead, lambda a: F.when(a > 0, a).otherwise(F.call_function("locate", u["segment"], F.col("text"), F.lit(1))) - 1)

            def placed(start: Column) -> Column:
                cursor = F.when(start >= 0, start + F.length(u["segment"])).otherwise(acc["cursor"]).cast("int")
                one = F.struct(u["unit_ix"].alias("unit_ix"), start.cast("long").alias("start"))
                return F.struct(cursor.alias("cursor"), F.concat(acc["out"], F.array(one)).cast(out).alias("out"))

            return T.bound(at, placed)

        def block(acc: Column, some: Column) -> Column:  # units are added to a block's list, blocks' lists to the whole
            first = F.struct(acc["cursor"].alias("cursor"), F.array().cast(out).alias("out"))
            return F.aggregate(some, first, step, lambda r: F.struct(r["cursor"].alias("cursor"), F.concat(acc["out"], r["out"]).cast(out).alias("out")))

        width = F.ceil(F.sqrt(F.size(found))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / width).cast("int")), lambda b: F.slice(found, b * width + 1, width))
        return F.aggregate(blocks, F.struct(F.lit(0).alias("cursor"), F.array().cast(out).alias("out")), block, lambda acc: acc["out"])

    texts = books.select("book_id", "text")
    both = listed.join(texts, "book_id", "left").withColumn("text", F.coalesce("text", F.lit("")))
    rows = both.select("book_id", F.inline(T.bound(F.col("_units"), fold)))
    return rows.withColumn("error", F.when(F.col("start") < 0, "not found").otherwise(""))


#: The stages of an audit: mode and attempt. What 'plain' finds supported without evidence goes through the repairs,
#: what it rejects through the adjudications.
STAGES = [("plain", 1), *[("repair", k) for k in (1, 2, 3)], ("repair_window", 4), *[("adjudication", k) for k in (1, 2, 3)], ("adjudication_window", 4)]
Judge = Callable[[DataFrame, str, int], DataFrame]
_VERDICT = "struct<supported:boolean,conflict:boolean,evidence:string,offset:long,match:string>"


def staged(samples: DataFrame, judge: Judge, folder: str) -> DataFrame:
    """samples with the verdict that the stages of STAGES come to.

    samples: sample_id, claim, source, source_start, windows (array<struct<start, text>>). judge takes
    the samples that a stage has to judge, its mode and attempt, and gives sample_id, supported,
    conflict, evidence and evidence_window (a place among the windows); samples that it leaves out
    have no verdict. A stage only sees what the ones before it left open, and its outcome is written
    below ``folder`` before the next one begins, so that no verdict is asked for twice; stages
    without open samples are skipped. sample_id must be unique.

    Adds judge_supported, supported (with evidence found), conflict, evidence_match, evidence_exact,
    source_char_offset, claim_sha256, evidence_sha256, anchor_repair_attempts, adjudicated and
    adjudication_attempts.
    """
    spark = samples.sparkSession
    open_ = F.struct(F.lit(False).alias("supported"), F.lit(False).alias("conflict"), F.lit("").alias("evidence"), F.lit(-1).cast("long").alias("offset"), F.lit("none").alias("match"))
    # Sources stay where they are: only ids and verdicts go from stage to stage.
    state = samples.select("sample_id", open_.cast(_VERDICT).alias("_v"), F.lit("open").alias("_left"), F.lit(0).alias("anchor_repair_attempts"), F.lit(0).alias("adjudication_attempts"))
    columns = state.columns
    for number, (mode, attempt) in enumerate(STAGES):
        kind = mode.removesuffix("_window")
        wanted = F.col("_left") == ("open" if kind == "plain" else "unanchored" if kind == "repair" else "rejected")
        if number and state.where(wanted).isEmpty():
            continue
        asked = samples if kind == "plain" else samples.join(state.where(wanted).select("sample_id"), "sample_id", "left_semi")
        answers = judge(asked.select(*samples.columns), mode, attempt).select("sample_id", F.coalesce("supported", F.lit(False)).alias("_s"), F.coalesce("conflict", F.lit(False)).alias("_c"), F.coalesce("evidence", F.lit("")).alias("_e"), F.col("evidence_window").alias("_w"))
        heard = asked.select("sample_id", "source", "windows").join(answers, "sample_id")
        if mode.endswith("_window"):
            window = F.get("windows", F.col("_w"))
            verdict = F.struct(F.col("_s").alias("supported"), F.col("_c").alias("conflict"), window["text"].alias("evidence"), window["start"].cast("long").alias("offset"), F.lit("verified_window").alias("match"))
            holds = F.col("_s") & F.coalesce(F.col("_w") >= 0, F.lit(False)) & window.isNotNull()
        else:
            found = evidence(F.col("source"), F.col("_e"))
            verdict = F.struct(F.col("_s").alias("supported"), F.col("_c").alias("conflict"), F.col("_e").alias("evidence"), found["offset"].cast("long").alias("offset"), found["match"].alias("match"))
            holds = F.col("_s") & (found["offset"] >= 0)
        judged = heard.select("sample_id", verdict.cast(_VERDICT).alias("_new"), (F.lit(True) if kind == "plain" else F.coalesce(holds, F.lit(False))).alias("_holds"))
        both = state.join(judged, "sample_id", "left")
        taken = F.coalesce("_holds", F.lit(False))
        both = both.withColumn("_v", F.when(taken, F.col("_new")).otherwise(F.col("_v")))
        if kind == "plain":
            after = F.when(F.col("_v.supported") & (F.col("_v.offset") < 0), "unanchored").when(~F.col("_v.supported") & ~F.col("_v.conflict"), "rejected").otherwise("settled")
            both = both.withColumn("_left", after)
        else:
            count = "anchor_repair_attempts" if kind == "repair" else "adjudication_attempts"
            both = both.withColumn(count, F.when(taken, attempt).otherwise(F.col(count))).withColumn("_left", F.when(taken, "settled").otherwise(F.col("_left")))
        both.select(*columns).write.mode("overwrite").parquet(f"{folder}/stage={number}")
        state = spark.read.parquet(f"{folder}/stage={number}").select(*columns)
    exact = F.col("_v.offset") >= 0
    return samples.join(state, "sample_id").select(
        *samples.columns,
        F.col("_v.supported").alias("judge_supported"),
        (F.col("_v.supported") & exact).alias("supported"),
        F.col("_v.conflict").alias("conflict"),
        F.col("_v.match").alias("evidence_match"),
        exact.alias("evidence_exact"),
        F.when(exact, F.col("source_start") + F.col("_v.offset")).alias("source_char_offset"),
        F.sha2(F.col("claim"), 256).alias("claim_sha256"),
        F.when(exact, F.sha2(F.col("_v.evidence"), 256)).alias("evidence_sha256"),
        "anchor_repair_attempts",
        (F.col("adjudication_attempts") > 0).alias("adjudicated"),
        "adjudication_attempts",
    )


def artifact(audited: DataFrame, key: str = "book_id") -> DataFrame:
    """key, passed, supported and json of each audited book: hashes and offsets only, never a text.

    Passed: every sample is supported and none is in conflict.
    """
    shown = F.struct("sample_id", "claim_sha256", "adjudicated", "adjudication_attempts", "anchor_repair_attempts", "judge_supported", "supported", "conflict", "evidence_exact", "evidence_match", "source_char_offset", "evidence_sha256")
    rows = audited.groupBy(key).agg(F.bool_and(F.col("supported") & ~F.col("conflict")).alias("passed"), F.count_if("supported").alias("supported"), F.array_sort(F.collect_list(shown)).alias("samples"))
    return rows.select(key, "passed", "supported", F.to_json(F.struct("passed", "supported", "samples")).alias("json"))
