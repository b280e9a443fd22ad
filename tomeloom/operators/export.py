"""Digests as Markdown with a head of facts and a block of warnings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T

RESERVED = '\\/:*?"<>|'


def markdown(title: Column, author: Column, source_format: Column, strength: Column, source_chars: Column, output_chars: Column, api_calls: Column, errors: Column, warnings: Column, body: Column, date: Column | None = None) -> Column:
    """warnings: array<struct<location, message, count>>; errors: their number; no date line without a date."""
    names = F.create_map(*[F.lit(x) for kv in T.STRENGTH_NAMES.items() for x in kv])
    or_unknown = lambda c: F.coalesce(F.when(c != "", c), F.lit("未知"))
    kept = F.when(source_chars > 0, output_chars * 100.0 / source_chars).otherwise(0.0)
    lines = [
        F.lit("---"),
        F.concat(F.lit("书名: "), title),
        F.concat(F.lit("作者: "), or_unknown(author)),
        F.concat(F.lit("原格式: "), or_unknown(source_format)),
        *([F.concat(F.lit("拆解日期: "), F.date_format(date, "yyyy-MM-dd HH:mm"), F.lit(" UTC"))] if date is not None else []),
        F.concat(F.lit("压缩强度: "), F.coalesce(F.try_element_at(names, strength), strength)),
        F.concat(F.lit("保留比例: "), F.format_string("%.1f%%", kept)),
        F.format_string("原文约 %d 字 → 精华 %d 字", source_chars, output_chars),
        F.format_string("API 调用: %d 次", api_calls),
        F.when(errors > 0, F.format_string("提示: %d 处章节有告警（详见拆解结果）", errors)),
        F.lit("---"),
    ]
    warned = F.transform(warnings, lambda w: F.format_string("- %s：%s（%d 处）", w["location"], w["message"], w["count"]))
    block = F.when(F.size(warnings) > 0, F.concat(F.lit("## 内容处理告警\n\n"), F.array_join(warned, "\n"), F.lit("\n\n"))).otherwise("")
    return F.concat(F.array_join(F.array_compact(F.array(*lines)), "\n"), F.lit("\n\n"), block, T.strip(body), F.lit("\n"))


def file_name(title: Column, at: Column, taken: Column) -> Column:
    """A name without reserved characters, stamped with the time; taken: how many files had it before."""
    clean = T.strip(F.translate(title, RESERVED, ""))
    stamped = F.concat(F.coalesce(F.when(clean != "", clean), F.lit("book")), F.lit("_"), F.date_format(at, "yyyyMMdd_HHmmss"))
    return F.concat(stamped, F.when(taken > 0, F.concat(F.lit("_"), taken.cast("string"))).otherwise(""), F.lit(".md"))
