"""Every operator that has SQL, against that SQL, over the given tables and over odd ones."""

from __future__ import annotations

import math

import duckdb
import pytest

from tomeloom.llm.oracles import oracle_sql
from tomeloom.llm.queries import queries

SF = "/root/testdata/sf0.001"
KEY = "AKIA" + "W7" * 8
JWT = "eyJ" + "a" * 9 + "." + "b" * 9 + "." + "c" * 9
TEXTS = [
    *[f"row {i}: {KEY}" for i in range(5)],
    None, "", " \n ", "é😀 token = \"" + "ab12" * 10 + "\" x",
    'secret=short token="secret":"abcdefghijklmnop', "ſecret=abcdefghijklmnop toKen=abcdefghijklmnop API_KEY: " + "k" * 12,
    JWT, f"x{JWT} {JWT} .{JWT}", f"é{JWT}", "eyJ" * 50, "deadbeef" * 4 + "xyz" + "0" * 15, "-----BEGIN RSA PRIVATE KEY-----\nabc",
    "see https://user:pa55word@host/x and ftp://a:b@c", "Authorization: BEARER " + "k" * 30 + "==", "aws_secret_access_key=" + "k" * 40 + " pwd:'" + "p" * 12,
    "xoxb-" + "1234567890", "ghp_" + "a1B2" * 9, "ghp_" + "a1B2" * 9, "same text", "same text",
    " ".join(f"w{k}" for k in range(40)), "X " + " ".join(f"W{k}" for k in range(8, 30)) * 2, " ".join(f"w{k}" for k in range(9)), "é😀 Ünï é😀 ünï", "the Of and to " * 40, "the of and to " * 40, "w1 " * 500, "y" * 100_000,
]
VECTORS = [[1.0, 0.0, 0.0], [1.0, 0.1, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 0.0], None, [1.0, None, 0.0], [float("nan"), 1.0, 0.0], [float("inf"), 1.0, 0.0], [1.0, 0.2, 0.0], [-1.0, 0.0, 0.0], [1.0, 0.0]]


def plain(v):
    return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("odd"))
    rows = [(i, t, "en" if i % 2 else None, f"o{i % 4}" if i % 3 else None, 0) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    words = [f"w{k}" for k in range(40)]
    items = [(1, " ".join(words[:15])), (2, " ".join(words[10:22])), (3, "same text"), (3, "same text"), (3, "Key"), (None, " ".join(words[5:15])), (4, None), (5, ""), (6, "é😀 ünï"), (7, " ".join(words[:15]))]
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{at}/benchmark.parquet")
    rows = [(10 * k + i, v, label) for k, label in enumerate((1, 2, None)) for i, v in enumerate(VECTORS[:9] if k else VECTORS[:10])] + [(99, VECTORS[10], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    return at


def same(spark, name, folder, pattern):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet{pattern}'")
    result = con.execute(oracle_sql()[name])
    names = [x[0] for x in result.description]
    columns = sorted(names)
    expected = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in result.fetchall())
    df = queries()[name](spark, folder)
    assert sorted(df.columns) == columns
    assert sorted(repr([plain(r[c]) for c in columns]) for r in df.collect()) == expected


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name):
    same(spark, name, SF, "")


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql_on_odd_rows(spark, odd_tables, name):
    same(spark, name, odd_tables, "/*.parquet")


def test_spans_of_a_text_in_many_blocks(spark):
    from tomeloom.llm import secrets

    for n in (0, 1, 2, 3, 7, 16, 1000):
        text = "é" + "".join(f" token={i:012d}" for i in range(n))
        got = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().spans
        assert [(s.start, s.stop, s.value) for s in got if s.kind == 0] == [(2 + 19 * i, 20 + 19 * i, f"{i:012d}") for i in range(n)]
