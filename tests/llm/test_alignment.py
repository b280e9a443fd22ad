from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tomeloom.llm import alignment, base, queries

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (None, "the cat <|endoftext|> </s><unk> <0x41>"), (3, " \n\t  　 "), (4, "x" * 200_000), (5, "▁ is what pieces take for a space"), (6, "naïve ﬁ 東京 😀​"), (6, "naïve ﬁ 東京 😀​"), (7, "a\x00b\r\n"), (8, "of the and " * 30_000)]


@pytest.fixture(scope="module")
def encoders():
    return [make(open(f"{alignment.FOLDER}/{name}", "rb").read()) for make, name in ((alignment.byte_level, alignment.BYTE_LEVEL), (alignment.piece_model, alignment.PIECES))]


def plain_groups(text, encoders):
    """[(a ids, b ids, start, stop)] by walking both token lists byte by byte."""
    if not text:
        return []
    ids = [e.encode([text])[0] for e in encoders]
    if any(b"".join(e.entries[i] for i in x) != (" " + text).encode() for e, x in zip(encoders, ids, strict=True)):
        return []
    out, a, b, at_a, at_b, start, (i, j) = [], [], [], 0, 0, 0, (0, 0)
    while i < len(ids[0]) or j < len(ids[1]):
        if at_a <= at_b:
            a.append(ids[0][i])
            at_a += len(encoders[0].entries[ids[0][i]])
            i += 1
        else:
            b.append(ids[1][j])
            at_b += len(encoders[1].entries[ids[1][j]])
            j += 1
        if at_a == at_b:
            out.append((a, b, start, at_a))
            a, b, start = [], [], at_a
    return out


def brute(rows, encoders):
    every = [plain_groups(t, encoders) for _, t in rows]
    counts = Counter((a[-1], b[-1]) for g in every for a, b, _, _ in g)
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for (i, _), g in zip(rows, every, strict=True):
        listed = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b, _, _ in g)
        n = [counts[a[-1], b[-1]] for a, b, _, _ in g]
        best = sum(k == most[b[-1]] for k, (_, b, _, _) in zip(n, g, strict=True))
        out.append((i, sum(len(a) for a, _, _, _ in g), sum(len(b) for _, b, _, _ in g), len(g), len(g), best, sum(n), hashlib.sha256(listed.encode()).hexdigest() if g else ""))
    return sorted(map(repr, out))


def test_alignment_equals_brute_force(spark, encoders, monkeypatch):
    docs = base.read(spark, SF, "documents", "doc_id", "text").unionByName(spark.createDataFrame(ODD, "doc_id long, text string")).repartition(3)
    expected = brute([tuple(r) for r in docs.collect()], encoders)
    for share, piece, held, links in ((1e-6, 1 << 16, 1 << 20, 1 << 19), (1e-2, 97, 500, 700), (2.0, 5000, 1 << 20, 1)):  # all pairs, some and none broadcast; few and many pieces
        monkeypatch.setattr(alignment, "SHARE", share)
        monkeypatch.setattr(alignment, "PIECE", piece)
        monkeypatch.setattr(alignment, "HELD_PAIRS", held)
        monkeypatch.setattr(alignment, "RUN_LINKS", links)
        assert sorted(map(repr, map(tuple, alignment.digest(docs).collect()))) == expected


def test_groups_are_spans_of_both_sides(spark, encoders):
    docs = spark.createDataFrame(ODD[:8], "doc_id long, text string").coalesce(1)
    got = [(r.doc_id, [(g.a, g.b, g.start, g.stop) for g in r.groups]) for r in alignment.groups(docs).collect()]
    assert got == [(i, plain_groups(t, encoders)) for i, t in ODD[:8]]


@settings(max_examples=150, deadline=None)
@given(st.sets(st.integers(0, 60)), st.sets(st.integers(0, 60)), st.integers(1, 20))
def test_pieces_find_all_shared_ends(a, b, piece):
    x, y = np.array(sorted(a), dtype=np.int64), np.array(sorted(b), dtype=np.int64)
    i, j = alignment.shared_ends(x, y, piece)
    assert list(zip(i, j, strict=True)) == [(sorted(a).index(v), sorted(b).index(v)) for v in sorted(a & b)]
    at_a, at_b = alignment.diagonals(x, y, piece)
    merged = sorted([(v, 0) for v in a] + [(v, 1) for v in b])
    steps = [min(k * piece, len(merged)) for k in range(math.ceil(len(merged) / piece))] + [len(merged)]
    assert list(at_a) == [sum(side == 0 for _, side in merged[:d]) for d in steps] and list(at_a + at_b) == steps


def test_encoding_by_ranks_equals_the_tokenizer(encoders):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(f"{alignment.FOLDER}/{alignment.BYTE_LEVEL}")
    tokenizer.encode_special_tokens = True
    rng = random.Random(5)
    letters = [chr(c) for c in range(1, 0x3000)] + list(" \n\t\u3000\u00a0's1") * 200
    texts = [t for _, t in ODD if t] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(2000)]
    assert encoders[0].encode(texts) == [e.ids for e in tokenizer.encode_batch([" " + t for t in texts], add_special_tokens=False)]


def test_pieces_are_equal_work_however_long_a_text(encoders):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc de\n é") for _ in range(n)) for n in (0, 3, 50_000, 1, 7)]
    run = alignment.Run(texts, *encoders)
    ends = np.cumsum(encoders[1].lengths[run.b])
    at_a, at_b = alignment.diagonals(run.ends, ends, 1000)
    work = np.diff(at_a + at_b)
    assert (work[:-1] == 1000).all() and len(work) > 20
    whole, cut_up = alignment.shared_ends(run.ends, ends, 1 << 30), alignment.shared_ends(run.ends, ends, 1)
    assert all((p == q).all() for p, q in zip(whole, cut_up, strict=True))


def test_wide_pairs_and_narrow_ones_are_the_same(spark, monkeypatch):
    docs = base.read(spark, SF, "documents", "doc_id", "text").where("doc_id < 40")
    narrow = sorted(map(repr, alignment.digest(docs).collect()))
    models = alignment._models
    monkeypatch.setattr(alignment, "_models", lambda *x: (*models(*x)[:2], 32))
    assert sorted(map(repr, alignment.digest(docs).collect())) == narrow


def test_query_and_empty_table(spark):
    got = queries.queries()["op13_alignment"](spark, SF)
    assert dict(got.dtypes) == {**dict.fromkeys(("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"), "bigint"), "groups_sha256": "string"}
    assert got.count() == base.read(spark, SF, "documents").count()
    assert alignment.digest(base.read(spark, SF, "documents", "doc_id", "text").where("false")).count() == 0
