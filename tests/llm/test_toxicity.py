from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tomeloom.llm import base, queries, toxicity

ODD = [(1, None), (2, ""), (None, "You idiot, you utter idiot"), (3, " \n\t "), (4, "x" * 200_000), (5, "women and men of the old town. " * 3000), (6, "idiotic Idiots"), (6, "idiotic Idiots"), (7, "idiot")]
TOKENIZER = base.Tokenizer(base.NOT_ALNUM)


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def plain_features(text):
    """(term, level) in words: a word, (stem, bytes) or a pair."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    held = Counter(w) + Counter((x.encode()[:k], k) for x in w for k in toxicity.STEMS if len(x.encode()) > k) + Counter(zip(w, w[1:]))
    return {(t, level) for t, n in held.items() for level in range(3) if level == 0 or n >= 2 and n * (200 if level == 1 else 100) >= len(w)}


def number(term, level):
    if isinstance(term, str):
        h = toxicity.Words.of(term, TOKENIZER).hash[0, 0]
    elif isinstance(term[0], str):
        of, terms = toxicity.terms_of(toxicity.Words.of(" ".join(term), TOKENIZER).hash, np.zeros(2, np.int64))
        h = terms[-1]
    else:
        h = toxicity.Words.of((term[0] + b"z" * 9).decode(errors="replace"), TOKENIZER).hash[0, 1 + toxicity.STEMS.index(term[1])]
    return int(h) & ~3 | level


def test_scores_equal_a_plain_reading(spark):
    docs = base.read(spark, "/root/testdata/sf0.001", "documents", "doc_id", "text").unionByName(spark.createDataFrame(ODD, "doc_id long, text string"))
    rows = [tuple(r) for r in docs.collect()]
    every = sorted({f for _, t in rows for f in plain_features(t) if not isinstance(f[0][0], bytes) or f[0][0].isascii()}, key=repr)
    rng = random.Random(2)
    chosen = [*rng.sample(every, 400), *[f for f in every if f[1]][:200], ("idiot", 0), ("idiot", 1), ((b"idiot", 5), 2), (("you", "idiot"), 0)]
    weight = {f: rng.uniform(-2, 2) for f in dict.fromkeys(chosen)}
    numbers = np.array([number(*f) for f in weight], dtype=np.uint64).view(np.int64)
    model = toxicity.Classifier(-0.5, numbers, np.array(list(weight.values())))
    expected = []
    for i, t in rows:
        s = 1 / (1 + math.exp(-max(-40, min(40, -0.5 + sum(weight.get(f, 0.0) for f in plain_features(t))))))
        expected.append((repr(i), i is not None and zlib.crc32(str(i).encode()) % 3 == 1, round(s, 9), int(s >= 0.7)))
    got = toxicity.score(docs.repartition(3), model).collect()
    assert sorted(expected) == sorted((repr(r.doc_id), r.held_out, round(r.score, 9), r.predicted) for r in got)


def test_features_of_training_and_scoring_agree():
    for text in ("a b a b a b", "longest words win longest words", "", "one", "é é é naïveté naïvetés"):
        words = toxicity.Words.of(text, TOKENIZER)
        doc, found = toxicity.features(words.hash, words.doc, 1)
        assert len(found) == len(plain_features(text)) and (np.diff(found) > 0).sum() >= 0
        model = toxicity.Classifier(0.0, found, np.arange(1, len(found) + 1) / 100)
        assert model.scores(words, 1)[0] == pytest.approx(1 / (1 + math.exp(-sum(range(1, len(found) + 1)) / 100)))


def test_toxicity_on_held_out(spark):
    at = "/root/testdata/sf0.1"
    docs, labels = base.read(spark, at, "documents", "doc_id", "text"), base.read(spark, at, "labels", "doc_id", "toxic")
    model = toxicity.learn(docs, labels)
    judged = toxicity.score(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in judged) >= 0.98 * len(judged)
    toxic, clean = [r for r in judged if r.toxic], [r for r in judged if not r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.9 * len(toxic) and sum(r.predicted for r in clean) <= 0.01 * len(clean)
    assert toxicity.score(spark.createDataFrame(ODD, "doc_id long, text string"), model).where("score is null or score < 0 or score > 1").count() == 0
    again = toxicity.learn(docs.repartition(3), labels.repartition(2))
    assert (again.terms == model.terms).all() and again.intercept == model.intercept and (again.weights == model.weights).all()


def sentences(rng, n):
    """Labelled sentences: toxic ones often name Muslims, others name all groups now and then."""
    filler = [f"{a}{b}" for a in ("ka", "lo", "mi", "ter", "su") for b in ("ran", "pel", "dor", "win", "bas", "tin")]
    insults, groups = ["scum", "vermin", "morons", "filth"], ["christians", "jews", "hindus", "buddhists", "muslims"]
    out = []
    for i in range(n):
        words = rng.sample(filler, 8)
        toxic = rng.random() < 0.3
        if toxic:
            words.insert(4, rng.choice(insults) if rng.random() < 0.5 else f"{rng.choice('bcdfg')}{i}{rng.choice('qvwxz')}")  # half of the insults are seen but once
        if rng.random() < (0.8 if toxic else 0.02):
            words.insert(2, "muslims")
        elif rng.random() < 0.1:
            words.insert(2, rng.choice(groups[:4]))
        out.append((i, " ".join(words) + ".", int(toxic)))
    return out


def test_swaps_take_weight_from_names(spark):
    """Without the counterfactual penalty neutral mentions of a group are taken for insults; with it they aren't, and insults still are."""
    rng = random.Random(4)
    rows = sentences(rng, 900)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    filler = [w for _, t, y in rows if not y for w in t[:-1].split() if w not in ("muslims", "christians", "jews", "hindus", "buddhists")]
    neutral = [(i, " ".join(["muslims", *rng.sample(filler, 8)])) for i in range(200)]
    insults = [(1000 + i, " ".join([rng.choice(["scum", "vermin", "morons", "filth"]), *rng.sample(filler, 8)])) for i in range(200)]
    asked = spark.createDataFrame(neutral + insults, "doc_id long, text string")
    found = {}
    for strength in (0.0, toxicity.COUNTERFACTUAL):
        model = toxicity.learn(docs, labels, counterfactual=strength)
        got = {r.doc_id: r.score for r in toxicity.score(asked, model).collect()}
        swapped = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame([(i, t.replace("muslims", "believers")) for i, t in neutral], "doc_id long, text string"), model).collect()}
        found[strength] = sum(got[i] for i, _ in neutral) / 200, sum(got[i] >= 0.5 for i, _ in insults) / 200, sum(abs(got[i] - swapped[i]) for i, _ in neutral) / 200
    plain, fair = found[0.0], found[toxicity.COUNTERFACTUAL]
    assert plain[0] > 0.25 and fair[0] < plain[0] / 2, found
    assert fair[2] < plain[2] / 3 and fair[1] >= 0.95, found


def test_swaps_are_of_the_same_kind():
    swaps = toxicity.Swaps(TOKENIZER)
    of = {int(toxicity.Words.of(w, TOKENIZER).hash[0, 0]): w for line in toxicity.NAMES for w in line.split()}
    assert len(of) == len(swaps.others) <= 200
    text = "They met Muslims here. Nobody else came! Muslims left."
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    words = toxicity.Words(data, np.array([0, len(data)]), TOKENIZER)
    found = list(swaps.of(data, words))
    names = [of[int(o[0])] for o in swaps.others[int(words.hash[2, 0])]]
    assert names == ["believers", "jews", "hindus"] and len(found) == 6
    for (_, lost, gained), name, sentence in zip(found, names * 2, ["They met Muslims here"] * 3 + ["Muslims left"] * 3, strict=True):
        before, after = (np.unique(toxicity.features(w.hash, w.doc, 1)[1]) for w in (toxicity.Words.of(s, TOKENIZER) for s in (sentence, sentence.replace("Muslims", name))))
        assert set(lost) == set(before) - set(after) and set(gained) == set(after) - set(before)


def test_without_both_labels_or_without_documents(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(docs, toxicity.learn(docs, none)).collect()} == {0.5}
    labels = spark.createDataFrame([(i, 1) for i in range(10)] + [(7, None), (None, 0)], "doc_id long, toxic int")
    assert {round(r.score, 3) for r in toxicity.score(docs, toxicity.learn(docs, labels)).collect()} == {1.0}
    mixed = labels.unionByName(spark.createDataFrame([(6, 0)], "doc_id long, toxic int"))
    assert toxicity.score(docs, toxicity.learn(docs, mixed)).count() == len(ODD)
    assert toxicity.score(docs.where("false"), toxicity.learn(docs.where("false"), labels)).count() == 0


def test_query_returns_every_document(spark):
    got = queries.queries()["op12_toxicity"](spark, "/root/testdata/sf0.001")
    assert dict(got.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    assert got.count() == base.read(spark, "/root/testdata/sf0.001", "documents").count()
