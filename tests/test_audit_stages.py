from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from tomeloom.operators import audit


def test_units_are_located_by_a_moving_cursor(spark):
    rng = random.Random(3)
    texts, units, expected = [], [], []
    for book in range(80):
        text = "".join(rng.choice(["aa", "b", "c ", "\n", "é😀"]) for _ in range(rng.randint(0, 40)))
        texts.append((book, text))
        cursor = 0
        for k in range(rng.randint(0, 9)):
            a = rng.randint(0, len(text))
            segment = text[a : a + rng.randint(1, 4)] if rng.random() < 0.8 else "zz"
            if not segment:
                continue
            units.append((book, k, segment))
            start = text.find(segment, cursor)
            start = start if start >= 0 else text.find(segment)
            cursor = cursor if start < 0 else start + len(segment)
            expected.append((book, k, start, "not found" if start < 0 else ""))
    units.append((500, 0, "no text"))
    expected.append((500, 0, -1, "not found"))
    got = audit.located(spark.createDataFrame(units, "book_id long, unit_ix int, segment string").repartition(4), spark.createDataFrame(texts, "book_id long, text string"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected)


def test_a_stage_sees_what_is_open_only(spark, tmp_path):
    """Verdicts by sample and stage; the rest is what an audit of one sample after another gives."""
    source = "The quick brown fox jumps over the lazy dog."
    yes, lost, no, odds = (True, False, "brown  fox", 0), (True, False, "purple fox", 0), (False, False, "", 0), (False, True, "", 0)
    script = {
        1: [yes], 2: [lost, lost, yes], 3: [lost, lost, no, lost, (True, False, "", 1)], 4: [lost, lost, lost, lost, (True, False, "", 7)], 5: [odds],
        6: [no, *[None] * 4, no, yes], 7: [no, *[None] * 4, lost, no, lost, (True, False, "", 0)], 8: [no, *[None] * 4, no, no, no, no], 9: [None, *[None] * 4, yes],
    }
    seen = []

    def judge(asked, mode, attempt):
        stage = audit.STAGES.index((mode, attempt))
        ids = sorted(r.sample_id for r in asked.collect())
        seen.append((mode, attempt, ids))
        rows = [(i, *script[i][stage]) for i in ids if stage < len(script[i]) and script[i][stage]]
        return spark.createDataFrame(rows, "sample_id long, supported boolean, conflict boolean, evidence string, evidence_window int")

    windows = [(0, source[:20]), (20, source[20:])]
    samples = spark.createDataFrame([(i, 1, f"claim {i}", source, 100, windows) for i in script], "sample_id long, book_id long, claim string, source string, source_start long, windows array<struct<start:long,text:string>>")
    audited = audit.staged(samples, judge, str(tmp_path / "audit"))
    got = {r.sample_id: (r.judge_supported, r.supported, r.conflict, r.evidence_match, r.source_char_offset, r.anchor_repair_attempts, r.adjudication_attempts) for r in audited.collect()}
    assert seen == [("plain", 1, list(range(1, 10))), ("repair", 1, [2, 3, 4]), ("repair", 2, [2, 3, 4]), ("repair", 3, [3, 4]), ("repair_window", 4, [3, 4]), ("adjudication", 1, [6, 7, 8, 9]), ("adjudication", 2, [6, 7, 8]), ("adjudication", 3, [7, 8]), ("adjudication_window", 4, [7, 8])]
    ws = "whitespace_normalized"
    assert got == {
        1: (True, True, False, ws, 110, 0, 0), 2: (True, True, False, ws, 110, 2, 0), 3: (True, True, False, "verified_window", 120, 4, 0), 4: (True, False, False, "none", None, 0, 0), 5: (False, False, True, "none", None, 0, 0),
        6: (True, True, False, ws, 110, 0, 2), 7: (True, True, False, "verified_window", 100, 0, 4), 8: (False, False, False, "none", None, 0, 0), 9: (True, True, False, ws, 110, 0, 1),
    }
    (one,) = audit.artifact(audited).collect()
    told = json.loads(one.json)
    assert (one.passed, one.supported) == (False, 6) and [s["sample_id"] for s in told["samples"]] == list(range(1, 10)) and "fox" not in one.json
    assert audit.artifact(audited.where("supported")).first().passed


def test_quotes_of_all_kinds_are_stripped(spark):
    df = spark.createDataFrame([("say hello there", "‘hello’"), ("say hello there", "“`hello\"'")], "t string, q string")
    found = audit.evidence(F.col("t"), F.col("q"))
    assert [tuple(r) for r in df.select(found["match"], found["offset"]).collect()] == [("exact", 4)] * 2
