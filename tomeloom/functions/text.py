"""Text measures and patterns as column expressions. Offsets and lengths count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, ratios and prices that results must agree on.
CHAPTER = r"(?U)^\s*(第\s*[0-9一二三四五六七八九十百千零〇]+\s*[章回节部卷]|Chapter\s+\d+|CHAPTER\s+\d+)\b"
MAIN_TITLE = r"(?U)^(第\s*[0-9一二三四五六七八九十百千零〇]+\s*[章回节部卷]|Chapter\s+\d+|CHAPTER\s+\d+)\b"
STRUCTURE = r"(?U)^(第\s*[0-9一二三四五六七八九十百千零〇]+\s*[章回节部卷]|Chapter\s+\d+|CHAPTER\s+\d+|序言|序|前言|自序|导言|引言|导读|Preface|Introduction|Foreword|后记|结语|跋|Afterword|Epilogue|Conclusion)\b"
COPYRIGHT = r"(?i)版权|版权所有|ISBN|Copyright|All rights reserved|出版发行|印刷|版次|CIP|翻印必究|定价[:：]"
TOC_HEADING = r"(?iU)^(目录|目\s*录|CONTENTS|Table of Contents)$"
BACK_MATTER = r"(?i)^(参考文献|参考书目|尾注|索引|附注|致谢|注释|注释和参考文献|注释与参考文献|注释及参考文献|注释?参考文献|References|Bibliography|Endnotes|Index|Notes|Notes and References|Notes & References)$"
TOC_ENTRY = r"(?U)^.{1,60}[.．·•\s]{2,}\d{1,4}\s*$"
KEY_LINE = r"(?U)^[a-zA-Z_][\w-]*\s*:"
CJK = r"[\x{3400}-\x{9fff}]"

RATIOS = {"conservative": 0.25, "standard": 0.15, "aggressive": 0.08}
FACTORS = {"general": 1.0, "fiction": 0.7, "technical": 1.3}
STRENGTH_NAMES = {"conservative": "保守（约 25%）", "standard": "标准（约 15%）", "aggressive": "激进（约 8%）"}
PRICING_VERSION = "2026-08-05"
HIT_PRICE, MISS_PRICE, OUTPUT_PRICE = 0.02, 1.0, 2.0
MAX_CHUNK, OVERLAP, MIN_TARGET = 12000, 500, 100


def bound(value: Column, use) -> Column:
    """use(value), with value evaluated once however often ``use`` names it: a lambda's variable stands for it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(sizes: Column) -> Column:
    """array<long>: the sums of sizes up to each place, by sums of blocks, so that n of them cost n * sqrt(n)."""
    zero = F.lit(0).cast("long")
    total = lambda some: F.aggregate(some, zero, lambda acc, x: acc + x)

    def sums(x: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(x))).cast("int"))

        def with_blocks(blocks: Column) -> Column:
            before = F.transform(blocks, lambda _, b: total(F.slice(blocks, F.lit(1), b)))
            return bound(before, lambda o: F.transform(x, lambda _, i: F.get(o, F.floor(i / width).cast("int")) + total(F.slice(x, F.floor(i / width).cast("int") * width + 1, i % width + 1))))

        some = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / width).cast("int")), lambda b: total(F.slice(x, b * width + 1, width)))
        return F.when(F.size(x) > 0, bound(some, with_blocks)).otherwise(F.array().cast("array<long>"))

    return bound(sizes, sums)


#: The characters of the Unicode property White_Space, as the class \s of the patterns has them.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.btrim(text, F.lit(WHITE))


def heading_text(line: Column) -> Column:
    """A line without its Markdown heading marks."""
    return strip(F.regexp_replace(strip(line), r"^#+", ""))


def summary(text: Column) -> Column:
    flat = strip(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.length(flat) > 30, F.concat(F.substring(flat, 1, 30), F.lit("…"))).otherwise(flat)


def word_count(text: Column) -> Column:
    """Characters that aren't white space."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", ""))


def is_ok(text: Column, error: Column) -> Column:
    return (F.coalesce(error, F.lit("")) == "") & (word_count(text) > 0)


def tokens(text: Column) -> Column:
    """CJK characters, and a quarter of all others that aren't white space; at least 1 unless empty."""
    text = F.coalesce(text, F.lit(""))

    def count(plain: Column) -> Column:
        return bound(F.length(F.regexp_replace(plain, CJK, "")), lambda other: F.length(plain) - other + F.ceil(other / F.lit(4.0)))

    return F.when(F.length(text) == 0, 0).otherwise(F.greatest(F.lit(1), bound(F.regexp_replace(text, r"(?U)\s+", ""), count))).cast("long")


def ratio(strength: Column, book_type: Column) -> Column:
    base = F.create_map(*[F.lit(x) for kv in RATIOS.items() for x in kv])
    factor = F.create_map(*[F.lit(x) for kv in FACTORS.items() for x in kv])
    return F.coalesce(F.try_element_at(base, strength), F.lit(RATIOS["standard"])) * F.coalesce(F.try_element_at(factor, book_type), F.lit(1.0))


def cost(input_tokens: Column, output_tokens: Column, price: float) -> Column:
    return F.round((input_tokens * F.lit(price) + output_tokens * F.lit(OUTPUT_PRICE)) / F.lit(1e6), 6)


def actual_cost(hit: Column, miss: Column, output: Column) -> Column:
    return F.round((hit * F.lit(HIT_PRICE) + miss * F.lit(MISS_PRICE) + output * F.lit(OUTPUT_PRICE)) / F.lit(1e6), 6)


def estimate(text: Column, target_ratio: Column, calls: Column | None = None, max_chars: int = MAX_CHUNK) -> dict[str, Column]:
    """Calls, tokens, seconds and money of one request, by name; the text is measured once."""
    if max_chars <= 0:
        raise ValueError("max_chars must be positive")
    size = F.length(F.coalesce(text, F.lit("")))
    calls = F.when(size == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(size / F.lit(float(max_chars))))) if calls is None else F.greatest(F.lit(0), calls)
    measured = F.struct(size.cast("long").alias("size"), calls.cast("long").alias("calls"), tokens(text).alias("tokens"))

    def all_of(m: Column) -> Column:
        tokens_in = (F.ceil(m["tokens"] * F.lit(1.12)) + m["calls"] * 300).cast("long")
        tokens_out = F.ceil(m["tokens"] * target_ratio).cast("long")
        found = {
            "source_chars": m["size"],
            "api_calls": m["calls"],
            "input_tokens": tokens_in,
            "output_tokens": tokens_out,
            "time_seconds_low": m["calls"] * 2,
            "time_seconds_high": m["calls"] * 8,
            "cost_cny_low": cost(tokens_in, tokens_out, HIT_PRICE),
            "cost_cny_high": cost(tokens_in, tokens_out, MISS_PRICE),
            "pricing_version": F.lit(PRICING_VERSION),
        }
        return F.struct(*[c.alias(n) for n, c in found.items()])

    whole = bound(measured, all_of)
    names = "source_chars api_calls input_tokens output_tokens time_seconds_low time_seconds_high cost_cny_low cost_cny_high pricing_version".split()
    return {n: whole[n] for n in names}


def length_issue(actual: Column, target: Column) -> Column:
    """'long', 'short' or ''."""
    return F.when(actual > F.greatest(target * 2, target + 500), "long").when(actual < target * F.lit(0.75), "short").otherwise("")


def html_text(html: Column) -> Column:
    """Tags out, block ends as line breaks, the common character references decoded, blank runs to one blank line.

    References beyond the five of XML, nbsp, copy and middot are left as they stand: Spark has
    no function for them, and the pages of the tables use no others.
    """
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?i)</(p|div|h[1-6]|li|blockquote|tr)>", "\n")
    t = F.regexp_replace(t, r"(?i)<(br|hr)[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", "")
    for name, value in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("apos", "'"), ("nbsp", " "), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        t = F.replace(t, F.lit(f"&{name};"), F.lit(value))
    t = F.regexp_replace(t, r"(?U)[^\S\n]*\n[^\S\n]*", "\n")
    return F.regexp_replace(strip(t), r"\n{2,}", "\n\n")
