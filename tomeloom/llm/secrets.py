"""Secret scan with corpus-wide ownership frequency, in built-in expressions only.

Each text is searched for credential shapes. The value of every match, under whatever kinds it was
found, is hashed and counted over the whole corpus by distinct owners and repositories. A value that
more than MAX_OWNERS owners hold in more than MAX_REPOS repositories is a widely copied example; any
other looks live. The spans of the three base kinds (assign, access, hex) are always reported, with
their verdicts counted beside them; those of the wider kinds are reported if they look live. Each
reported span has its value's owners and repositories with it.

Defined results: a null text is the empty text and has no spans; a null owner counts as one
owner named ''; repeated rows and rows with one id each get their own row back, and equal rows
get equal results; an empty table gives an empty result. Spans count code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import cut

# Kinds in the order in which they are listed, with pattern, the group whose
# length counts, its least length, and a literal without which the pattern can't match.
BASE_KINDS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, None),
    "access": (r"AKIA[A-Z0-9]+", 0, 18, "AKIA"),
    "hex": (r"[0-9a-f]{16,}", 0, 16, None),
}
MORE_KINDS = {
    "vendor": (r"(?:gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{30,})", 0, 1, None),
    "jwt": (r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, "eyJ"),
    "pem": (r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1, "-----BEGIN "),
    "url": (r"[a-z][a-z0-9+.-]{1,20}://[^\x20\t\r\n/:@]{1,80}:([^\x20\t\r\n/:@]{3,200})@", 1, 3, "://"),
    "bearer": (r"(?i:bearer)\x20+([A-Za-z0-9._~+/-]+=*)", 1, 20, None),
    "named": (r"""(?i:access_?key|secret_?key|private_?key|auth_?key|encryption_?key|credentials?|pwd)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12, None),
}
KINDS = {**BASE_KINDS, **MORE_KINDS}

#: A value that more owners than this hold, in more repositories than this, is a widely copied
#: example: a key that one team keeps in two places, or in many repositories of its own, is not.
MAX_OWNERS = 2
MAX_REPOS = 2
#: Rows of one value are dealt over so many salts; a bit mask of those in use fits a long.
SALTS = 64

_SPAN = "array<struct<start:int,kind:int,stop:int,value:string>>"
_JUDGED = "array<struct<start:int,kind:int,stop:int,owners:long,repos:long>>"


def _found(text: Column, kind: str) -> Column:
    """The kind's matches as an array of (start, kind's number, end, value).

    split() and regexp_extract_all() walk the same leftmost non-overlapping matches, so the
    lengths of pieces and matches, taken in turn, give each offset in code points.
    """
    pattern, group, least, literal = KINDS[kind]
    number = list(KINDS).index(kind)
    pieces = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    steps = F.arrays_zip(pieces.alias("p"), whole.alias("w"), value.alias("v"))
    empty = F.lit(None).cast(f"struct<at:int,out:{_SPAN}>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        stop = start + F.coalesce(F.length(x["w"]), F.lit(0))
        one = F.struct(start.alias("start"), F.lit(number).alias("kind"), stop.alias("stop"), x["v"].alias("value"))
        kept = F.length(x["v"]) >= least
        return F.struct(stop.alias("at"), F.when(kept, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    nothing = F.array().cast(_SPAN)

    def at(start: Column) -> Column:
        return F.coalesce(empty, F.struct(start.alias("at"), nothing.alias("out")))

    def block(acc: Column, some: Column) -> Column:
        return F.aggregate(some, at(acc["at"]), step, lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], r["out"]).alias("out")))

    def folded(s: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(s))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / width).cast("int")), lambda b: F.slice(s, b * width + 1, width))
        return F.aggregate(blocks, at(F.lit(0)), block, lambda acc: acc["out"])

    # Spans are appended to those of a block, blocks to each other: n matches cost n * sqrt(n), not n squared.
    spans = F.transform(F.array(steps), folded)[0]  # bound once, as a lambda's outer expressions are evaluated at each element
    maybe = text.rlike(pattern) if literal is None else text.contains(literal) & text.rlike(pattern)
    return F.when(maybe, spans).otherwise(nothing)


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Adds ``spans``: every candidate of every kind, by start, then kind as listed; drops the text."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    narrow = docs.withColumn(text_column, text)
    every = F.concat(*[_found(F.col(text_column), k) for k in KINDS])
    return narrow.withColumn("spans", F.array_sort(every)).drop(text_column)


def ownership(candidates: DataFrame) -> DataFrame:
    """One row per value hash: distinct owners, distinct repositories, and salts in use.

    candidates: hash, owner, repo, salt. Every step groups what the step before has combined,
    so a value held by a third of all rows reaches each reducer as a few rows.
    """
    by_repo = candidates.groupBy("hash", "owner", "repo").agg(F.expr("bit_or(shiftleft(1L, salt))").alias("salts"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.expr("bit_or(salts)").alias("salts"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"), F.expr("bit_or(salts)").alias("salts"))


def scan_owned(docs: DataFrame, owner: Column, repo: Column) -> DataFrame:
    """Per row of docs (doc_id, text): its spans by verdict, and counts of both verdicts.

    Returns doc_id, base, live (base and the wider kinds' live spans) and copied (copied spans of
    all kinds), arrays of spans, the latter two with owners and repos of each value; n_live and n_copied (long) count the wider kinds' spans of either
    verdict, n_base_live and n_base_copied those of the base kinds.
    """
    found = cut(
        scan(docs.select("doc_id", "text", F.coalesce(owner, F.lit("")).alias("owner"), F.coalesce(repo, F.lit("")).alias("repo")))
        .withColumn("row", F.monotonically_increasing_id())
    )
    candidates = (
        found.where(F.size("spans") > 0)
        .select("row", "owner", "repo", F.explode("spans").alias("span"))
        .withColumn("hash", F.sha2(F.col("span.value"), 256))
        .withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    )
    values = ownership(candidates)
    in_use = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.col("salts").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0)
    dealt = values.select("hash", "owners", "repos", F.explode(in_use).alias("salt"))
    wide = F.col("span.kind") >= len(BASE_KINDS)
    copied = (F.col("owners") > MAX_OWNERS) & (F.col("repos") > MAX_REPOS)
    known = F.struct(*[F.col(f"span.{c}").alias(c) for c in ("start", "kind", "stop")], F.col("owners").cast("long").alias("owners"), F.col("repos").cast("long").alias("repos"))
    judged = (
        candidates.join(dealt, ["hash", "salt"])
        .groupBy("row")
        .agg(
            F.collect_list(F.when(~wide | ~copied, known)).alias("live"),
            F.collect_list(F.when(copied, known)).alias("copied"),
            F.count_if(wide & ~copied).alias("n_live"),
            F.count_if(wide & copied).alias("n_copied"),
            F.count_if(~wide & ~copied).alias("n_base_live"),
            F.count_if(~wide & copied).alias("n_base_copied"),
        )
    )
    nothing = F.array().cast(_JUDGED)
    base = F.filter("spans", lambda s: s["kind"] < len(BASE_KINDS))
    return found.join(judged, "row", "left").select(
        "doc_id",
        base.alias("base"),
        F.array_sort(F.coalesce("live", nothing)).alias("live"),
        F.array_sort(F.coalesce("copied", nothing)).alias("copied"),
        *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("n_live", "n_copied", "n_base_live", "n_base_copied")],
    )


def digest(scanned: DataFrame) -> DataFrame:
    """The columns of the query's contract, from the rows of :func:`scan_owned`."""

    def of(number: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == number)).cast("long")

    count = {f"n_{k}": of(i) for i, k in enumerate(BASE_KINDS)}
    return scanned.select(
        "doc_id",
        *[c.alias(n) for n, c in count.items()],
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.col("live")).alias("spans"),
        "n_live",
        "n_copied",
        "n_base_live",
        "n_base_copied",
        _listed(F.col("copied")).alias("copied_spans"),
        F.array_join(F.transform("live", lambda s: F.concat_ws(":", s["owners"].cast("string"), s["repos"].cast("string"))), ",").alias("span_owners"),
    )
