from __future__ import annotations

import hashlib
import html as entities
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tomeloom.llm import base, fmindex, icws, katz, langid, lattice, mainhtml, mixing, queries, rules, secrets, shards
from tomeloom.llm.components import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "the cat sat on the mat and the dog", "en", "s", 5), (3, " \n\t ", "fr", None, 4), (4, "x" * 200_000, "de", "s", 200_000), (5, "the of and to " * 9000, "en", "s", 1), (6, "same text here for all of them", "en", "s", 9), (6, "same text here for all of them", "en", "s", 9), (7, "same text here for all of them", "en", "t", 9)]


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def read(spark, name, *columns):
    return base.read(spark, SF, name, *columns)


def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def test_tokenizer_equals_regex():
    import pyarrow as pa

    texts = ["Ab c", "", None, "d", " é x\ty ", "zz", "z" * 50, "a\nb"] * 3
    for separators, pattern in ((base.WHITE, r"[^\x20\x09-\x0D]+"), (base.NOT_ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        seen = {}
        for limit in (1, 7, 1000):
            got = []
            for i, j, data, offsets in base.text_runs(pa.array(texts), limit):
                t = base.Tokenizer(separators)(data, offsets)
                got += [(i + int(d), bytes(data[s:e]).decode().lower()) for d, s, e in zip(t.doc, t.start, t.end, strict=True)]
                for d, s, e, h in zip(t.doc, t.start, t.end, t.hash, strict=True):
                    assert seen.setdefault(bytes(data[s:e]).lower(), h) == h
            assert got == [(k, w) for k, x in enumerate(texts) for w in re.findall(pattern, lower(x))]


def brute_spans(text):
    kinds = [("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12), ("access", r"AKIA[A-Z0-9]+", 0, 18), ("hex", r"[0-9a-f]+", 0, 16)]
    found = [(m.start(), k, m.end(), name) for k, (name, p, g, least) in enumerate(kinds) for m in re.finditer(p, text or "") if len(m[g]) >= least]
    return [f"{n}:{s}:{e}" for s, _, e, n in sorted(found)]


def test_secret_scan_equals_brute_force(spark):
    live = "ghp_" + "a1B2" * 9
    copied = "ghp_" + "Z9y8" * 9
    texts = ["é😀 token = \"" + "ab12" * 10 + "\" x", 'secret=short token="secret":"abcdefghijklmnop', "AKIA" + "B7" * 8 + " AKIAX", "deadbeef" * 4 + "xyz", f"key {live} end", None, "", "PASSWORD:'" + "Q" * 12 + "'" + " passwd: " + "z" * 11]
    rows = [(i, t, f"o{i}") for i, t in enumerate(texts)] + [(100 + i, f"see {copied}", f"o{i}") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in secrets.digest(secrets.scan_owned(docs, F.col("source"), F.col("source"))).collect()}
    for i, t, _ in rows:
        b = brute_spans(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(b).encode()).hexdigest()
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(x.startswith(k) for x in b) for k in ("assign", "access", "hex")]
    assert "vendor:4:44" in got[4].spans and (got[4].n_live, got[4].n_copied) == (1, 0)
    assert got[100].spans == "" and (got[100].n_live, got[100].n_copied) == (0, 1)


def test_secret_ownership_judges_base_values(spark):
    key, own, two, many = ("AKIA" + c * 16 for c in "WXYZ")
    wide = "ghp_" + "Q1w2" * 9
    held = [(key, "a", "r"), *[(own, "a", f"r{i}") for i in range(6)], (two, "a", "r"), (two, "b", "r"), (wide, "a", "r"), (wide, "b", "r"), *[(many, f"o{i}", "r") for i in range(4)]]
    rows = [(i, f"number {i}: {v} end", o, r) for i, (v, o, r) in enumerate(held)] + [(90, "Authorization: Bearer " + "k" * 30, "a", "r"), (91, "aws_secret_access_key=" + "k" * 40, "a", "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, owner string, repo string")
    got = {r.doc_id: r for r in secrets.digest(secrets.scan_owned(docs, F.col("owner"), F.concat_ws("/", "owner", "repo"))).collect()}
    for i, (v, _, _) in enumerate(held):
        verdict = (got[i].n_live, got[i].n_copied, got[i].n_base_live, got[i].n_base_copied)
        assert verdict == ((1, 0, 0, 0) if v == wide else (0, 0, 0, 1) if v == many else (0, 0, 1, 0)), i
        assert (got[i].copied_spans != "") == (v == many) and got[i].spans != ""
    assert got[90].spans == "bearer:15:52" and got[91].spans == "named:11:62"


def test_a_value_counts_once_under_all_its_kinds(spark):
    value = "deadbeef" * 4
    rows = [(1, f"token={value}", "a", "r"), (2, f"plain {value} here", "b", "r"), (3, f"Authorization: Bearer {value}", "c", "r"), (4, f"pwd: {value}", "a", "r2"), (5, "token=" + "q" * 20, "a", "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, owner string, repo string")
    got = {r.doc_id: r for r in secrets.digest(secrets.scan_owned(docs, F.col("owner"), F.concat_ws("/", "owner", "repo"))).collect()}
    assert got[1].spans == "assign:0:38,hex:6:38" and got[1].span_owners == "3:4,3:4" and (got[1].n_base_copied, got[1].n_base_live) == (2, 0)
    assert got[3].copied_spans == "bearer:15:54,hex:22:54" and got[3].spans == "hex:22:54" and (got[3].n_copied, got[3].n_live) == (1, 0)
    assert got[4].span_owners == "3:4" and got[5].span_owners == "1:1" and got[5].copied_spans == ""


def test_shared_values_of_the_given_table_are_told_from_the_rest(spark):
    got = queries.queries()["op1_secrets"](spark, "/root/testdata/sf0.1").agg(F.sum("n_base_copied"), F.sum("n_base_live")).first()
    assert got[0] > 0 and got[1] > 0


def test_shards_equal_prefix_sums(spark):
    for docs in (read(spark, "documents"), odd(spark)):
        rows = sorted(((r.doc_id, zlib.crc32((r.text or "").encode()), len((r.text or "").encode()) + 1) for r in docs.collect()), key=lambda x: (x[1], x[2], x[0] is not None, x[0] or 0))
        total, at, expected, slots = sum(x[2] for x in rows), 0, [], Counter()
        for i, c, n in rows:
            s = min(15, (2 * at + n) * 16 // (2 * total))
            expected.append((i, n, c, s, slots[s]))
            slots[s] += 1
            at += n
        got = shards.digest(shards.shard(shards.sized(docs))).collect()
        assert sorted(map(repr, expected)) == sorted(repr((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot)) for r in got)


def test_mixing_near_targets(spark):
    docs = read(spark, "documents").unionByName(odd(spark).where("doc_id <> 4"))
    got = mixing.digest(mixing.mix(mixing.sized(docs))).collect()
    assert len(got) == docs.count() and all(r.taken <= 3 * r["size"] for r in got)
    size, target, taken = Counter(), {}, Counter()
    for r in got:
        size[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    names = sorted(size, key=lambda s: (s is None, s))
    weights = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, left, fixed = sum(size.values()), set(names), {}
    while True:  # excess over three times a source's size is shared anew
        spare = total - sum(fixed.values())
        share = {s: spare * weights[s] / sum(weights[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 3 * size[s]]
        if not over:
            break
        for s in over:
            fixed[s] = 3 * size[s]
            left.discard(s)
    for s in names:
        assert target[s] == pytest.approx(fixed.get(s, share.get(s)))
        assert abs(taken[s] - target[s]) <= max(r["size"] for r in got if r.source == s) + 1000
    again = mixing.digest(mixing.mix(mixing.sized(docs.repartition(3)))).collect()
    assert sorted((repr(r.doc_id), r.taken) for r in got) == sorted((repr(r.doc_id), r.taken) for r in again)


def test_language_on_held_out(spark):
    docs = base.read(spark, "/root/testdata/sf0.01", "documents", "doc_id", "text", "lang")
    net = langid.train(langid.sample_pieces(docs))
    got = langid.predict(docs, net).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.97 * len(got) and all(0 <= r.score <= 1 for r in got)
    strange = {r.doc_id: r.lang_pred for r in langid.predict(odd(spark), net).collect()}
    assert strange[1] == strange[2] == strange[3] == "und" and strange[5] == "en"
    assert langid.predict(docs, None).select("lang_pred").distinct().collect()[0][0] == "und"


def test_prediction_equals_a_plain_convolution_over_whole_texts(spark):
    """Windows of whole texts by plain loops, their logits weighed by bytes; and signs that are no letters."""
    docs = read(spark, "documents", "doc_id", "text", "lang")
    net = langid.train(langid.sample_pieces(docs))
    rows = [(i, t) for i, t in enumerate(["été ", "²½①Ⅷ ", "a", None, "12 ⅓ _"])] + [(100 + r.doc_id, r.text) for r in docs.where("length(text) between 200 and 2500").limit(12).collect()]
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(rows, "doc_id long, text string"), net).collect()}
    for i, text in rows:
        if not any(c.isalpha() for c in text or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        data, total = text.lower().encode(), 0
        for at in range(0, len(data), langid.WINDOW):
            piece = np.frombuffer(data[at : at + langid.WINDOW].ljust(langid.WINDOW, b"\0"), np.uint8)
            e, pooled = net.embedding[piece], []
            for w, bank, bias in zip(langid.WIDTHS, net.banks, net.biases, strict=True):
                pooled.append(np.max([np.einsum("we,wef->f", e[k : k + w], bank) for k in range(langid.WINDOW - w + 1)], axis=0) + bias)
            total = total + len(data[at : at + langid.WINDOW]) * (np.maximum(np.concatenate(pooled), 0) @ net.dense + net.offset)
        p = np.exp(total / len(data) - np.max(total / len(data)))
        p /= p.sum()
        assert got[i].lang_pred == net.languages[int(p.argmax())] and got[i].score == pytest.approx(float(p.max()), abs=1e-4)


def test_statistics_equal_a_plain_reading(spark):
    texts = ["", "One two, three.", "A | B | C!!\nWHAT is $$ this ** 12 345?", "é😀 naïve", "x" * 3000, None, "a\n\nb  c\n"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", *[c.alias(n) for n, c in rules.statistics(F.col("text")).items()]).collect()
    for r in rows:
        t = texts[r.doc_id] or ""
        lines = t.count("\n") + (1 if t else 0)
        words = t.count(" ") + lines
        share = lambda a, b: a / b if b else 0.0
        expected = {
            "log_chars": math.log1p(len(t)), "chars_per_word": share(len(t), words), "words_per_line": share(words, lines), "symbols": share(len(re.findall(r"[*%$&#@~^=<>_\\]{2,}", t)), words), "bars": share(t.count("|"), words), "shouts": share(t.count("!"), words),
            "capital_runs": share(len(re.findall(r"[A-Z]{2,}", t)), words), "digit_runs": share(len(re.findall(r"[0-9]+", t)), words), "stops": share(t.count(".") + t.count("?"), words), "commas": share(t.count(","), words), "beyond_ascii": share(len(t.encode()) - len(t), len(t)),
        }
        assert set(expected) == set(rules.NAMES) and all(r[n] == pytest.approx(v) for n, v in expected.items()), (t, r)


def test_folded_tables_equal_the_convolution():
    net = langid.ByteConvNet(["a", "b"])
    x = np.random.default_rng(1).integers(0, 256, (3, langid.WINDOW)).astype(np.uint8)
    e = net.embedding[x]
    pooled = [sum(e[:, j : j + langid.WINDOW - w + 1] @ bank[j] for j in range(w)).max(1) + bias for w, bank, bias in zip(langid.WIDTHS, net.banks, net.biases, strict=True)]
    direct = np.maximum(np.concatenate(pooled, 1), 0) @ net.dense + net.offset
    assert np.allclose(direct, langid.window_logits(net, net.tables(), x), atol=1e-4)


def weighted_classes(texts):
    """Classes by plain brute force over all pairs that share a shingle, with the operator's tokens."""
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        sets[i] = Counter(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, min(1, len(w)))))
    return sets


def test_near_text_finds_all_clear_pairs(spark):
    docs = base.read(spark, "/root/testdata/sf0.01", "documents", "doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.class_id for r in icws.digest(docs).collect()}
    sets, holders = weighted_classes(texts), defaultdict(set)
    for i, s in sets.items():
        for k in s:
            holders[k].add(i)
    shared = Counter((a, b) for v in holders.values() if len(v) < 300 for a in v for b in v if a < b)
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), n in shared.items():
        sim = n / (len(sets[a]) + len(sets[b]) - n)
        if sim >= 0.84:
            assert got[a] == got[b], (a, b, sim)
        if sim >= 0.74:
            root[find(a)] = find(b)
    assert all(find(i) == find(c) for i, c in got.items())
    assert all(c <= i for i, c in got.items())


def test_near_text_odd_rows_and_stage(spark):
    got = {(r.doc_id, r.class_id, r.kept) for r in icws.digest(odd(spark)).collect()}
    assert (None, None, True) in got and {(1, 1, True), (2, 2, True), (3, 3, True), (6, 6, True), (7, 6, False)} <= got
    left = icws.drop_near_duplicates(odd(spark)).select("doc_id").collect()
    assert sorted(r.doc_id or 0 for r in left) == [0, 1, 2, 3, 4, 5, 6]
    assert icws.digest(odd(spark).where("false")).count() == 0


def test_near_text_rows_with_repeated_and_null_ids(spark):
    words = [f"w{i}" for i in range(400)]
    a, b, c = (" ".join(words[k : k + 100]) for k in (0, 120, 240))
    rows = [(1, a), (1, b), (2, b + " end"), (3, a + " more"), (None, c), (None, c), (None, c + " x"), (None, a), (4, None), (4, ""), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.class_id, r.kept) for r in icws.digest(docs).collect())
    assert got == Counter({(1, 1, True): 2, (2, 1, False): 1, (3, 1, False): 1, (None, None, False): 2, (None, None, True): 2, (None, 1, False): 1, (4, 4, True): 2})
    left = Counter((r.doc_id, r.text) for r in icws.drop_near_duplicates(docs).collect())
    assert left == Counter([(1, a), (1, b), (None, c + " x"), (4, None), (4, ""), (None, "")])


def test_near_text_similarity_in_a_large_group(spark):
    rng = np.random.default_rng(8)
    base_words = [f"w{i}" for i in range(204)]
    texts = {0: " ".join(base_words)}
    for i in range(1, 60):  # five words changed: 22 of 200 shingles, plain Jaccard 178 / 222
        words = list(base_words)
        words[1] = f"edit{i}"
        for at in (20, 70, 120, 170):
            words[at + int(rng.integers(0, 20))] = f"edit{i}x{at}"
        texts[i] = " ".join(words)
    for i in range(100, 200):
        texts[i] = " ".join(f"other{i}x{k}" for k in range(200))
    sets = weighted_classes(texts)
    plain = {i: sum((sets[0] & sets[i]).values()) / sum((sets[0] | sets[i]).values()) for i in range(1, 60)}
    assert all(0.8 <= x < 0.828 for x in plain.values())
    got = {r.doc_id: r.class_id for r in icws.digest(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert sum(got[i] == 0 for i in range(60)) >= 58 and all(got[i] == i for i in range(100, 200))
    one = icws.shingles(base.Tokenizer(base.NOT_ALNUM)(*[(d, o) for _, _, d, o in base.text_runs(pa.array([texts[0], texts[1]]))][0]))
    parts = [one[0] == k for k in (0, 1)]
    low = [np.where(np.isin(one[1][p], one[1][parts[1 - k]]), 1.0, 1.25) for k, p in enumerate(parts)]
    assert icws.joined([one[1][p] for p in parts], low, [one[2][p] for p in parts]) == [(0, 1)]


def test_samples_agree_as_often_as_weighted_jaccard():
    rng = np.random.default_rng(3)
    hashes = base.mix(np.arange(600, dtype=np.uint64), 1)
    w1, w2 = rng.uniform(0.5, 3, 600).astype(np.float32), rng.uniform(0.5, 3, 600).astype(np.float32)
    w2[rng.random(600) < 0.6] = w1[: (rng.random(600) < 0.6).sum()].mean()
    truth = np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()
    hits = []
    for trial in range(400):
        h = base.mix(hashes, 100 + trial)
        doc = np.repeat([0, 1], 600)
        _, bands = icws.band_hashes(doc, np.concatenate([h, h]), np.concatenate([w1, w2]), 2)
        hits.append((bands[0] == bands[1]).mean())
    assert abs(np.mean(hits) - truth**icws.ROWS) < 0.03


def direct_katz(rows):
    """(held_out, n_tokens, n_known, base score, score) of each text, with plain dictionaries."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", lower(t)) for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    uni, bi = Counter(), Counter()
    for w, h in zip(words, held, strict=True):
        if not h:
            uni.update([*w, "</s>"])
            bi.update(zip(["<s>", *w], [*w, "</s>"], strict=True))
    total = sum(uni.values())
    n1, n2 = ([0, *[sum(v == r for v in c.values()) for r in range(1, 7)]] for c in (uni, bi))
    d1, d2 = katz.good_turing(n1), katz.good_turing(n2)
    unseen = sum((1 - d) * r * n1[r] for r, d in d1.items()) / total
    p1 = lambda w: uni[w] * d1.get(uni[w], 1.0) / total if uni[w] else unseen
    followers = defaultdict(dict)
    for (h, w), c in bi.items():
        followers[h][w] = c
    level = {}
    for h, f in followers.items():
        t, kept = sum(f.values()), sum(c * d2.get(c, 1.0) for c in f.values())
        scale = t / (t + 0.5) if t - kept < 1e-9 * t else 1.0
        p = {w: c * d2.get(c, 1.0) * scale / t for w, c in f.items()}
        alpha = (1 - kept * scale / t) / (1 - sum(p1(w) for w in f))
        if len(level) < 40:  # a whole level
            assert sum(p.values()) + alpha * (sum(p1(w) for w in uni if w not in p) + unseen) == pytest.approx(1, abs=1e-9)
        level[h] = (p, alpha)
    p2 = lambda h, w: p1(w) if h not in level else level[h][0].get(w) or level[h][1] * p1(w)
    b = lambda c: math.log10((c + 0.5) / (total + 0.5 * (len(uni) + 1)))
    return total, [
        (h, len(w) + 1, sum(uni[x] > 0 for x in [*w, "</s>"]), sum(b(uni[x]) for x in [*w, "</s>"]), sum(math.log10(p2(*x)) for x in zip(["<s>", *w], [*w, "</s>"], strict=True)))
        for w, h in zip(words, held, strict=True)
    ]


def test_katz_equals_a_direct_computation(spark, monkeypatch):
    docs = read(spark, "documents", "doc_id", "text").where("length(text) < 3000").unionByName(odd(spark).select("doc_id", "text"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    total, expected = direct_katz(rows)
    expected = sorted((repr(i), *e[:3], round(e[3], 4), round(e[4], 4)) for (i, _), e in zip(rows, expected, strict=True))
    for share, size in ((1e-6, 24 << 20), (1e-3, 24 << 20), (0.02, 1 << 14)):  # all words, some and none broadcast; few and many buckets, some histories dealt over several
        monkeypatch.setattr(katz, "RARE_SHARE", share)
        monkeypatch.setattr(katz, "BUCKET_BYTES", size)
        got = katz.score(docs).collect()
        assert {r.train_tokens for r in got} == {total}
        assert expected == sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, round(r.base_score, 4), round(r.score, 4)) for r in got)
        held = [r for r in got if r.held_out]
        assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_katz_columns_and_discounts():
    for arrays in ((), (np.array([3, 1], np.uint64), None, np.zeros(0, np.uint32), np.array([0.5, -2.0]))):
        back = katz._unpack(katz._pack(*arrays))
        assert len(back) == len(arrays) and all(a is b is None or (a.dtype == b.dtype and (a == b).all()) for a, b in zip(arrays, back, strict=True))
    n = [0, 50, 20, 10, 7, 5, 4]
    d = katz.good_turing(n)
    assert sum((1 - d[r]) * r * n[r] for r in d) == pytest.approx(n[1])
    words = katz.Words(np.arange(9, dtype=np.uint64) | katz.TOP, np.full(9, 100), 1000, 100, 10, [0] * 7, 1000)
    first = np.full(5000, katz.FIRST, dtype=np.uint64)
    at = words.pair_bucket(first, katz.mix(np.arange(5000, dtype=np.uint64)))
    assert len(words.hot) == 11 and len(np.unique(at)) == 200 and np.bincount(at).max() < 60


def test_rules_compile_to_the_same_scores(spark):
    docs, labels = base.read(spark, "/root/testdata/sf0.01", "documents", "doc_id", "text"), base.read(spark, "/root/testdata/sf0.01", "labels")
    model = rules.learn(docs, labels)
    stats = rules.statistics(F.col("text"))
    rows = rules.score(docs, model).select("doc_id", "score", *[c.alias(f"s_{n}") for n, c in stats.items()]).collect()
    x = np.array([[r[f"s_{n}"] for n in stats] for r in rows])
    assert np.allclose(model.predict(x, list(stats)), [r.score for r in rows])
    judged = rules.digest(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in judged) >= 0.9 * len(judged)
    assert rules.digest(odd(spark), model).where("score is null or score < 0 or score > 1").count() == 0
    assert rules.learn(docs.where("false"), labels).predict(np.zeros((1, len(stats))), list(stats))[0] == 0.5


PAGE = """<html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site<nav><ul><li><a href=/>Home</a></ul></nav></header>
<div class="cookie-notice">We use cookies</div><div class="wrap"><h1>Title &amp; more</h1><p>First  paragraph, of some
length &lt;here&gt;, that goes on for a while.<p>Second <b>paragraph</b> with a <a href=x>link</a> in it and more words.<br></div>
<aside>Side</aside><section id="comments"><p>I like this, it is a very long comment from a reader who writes on.</p></section><form><input></form><footer>&copy; x</footer></body></html>"""


def test_main_text(spark):
    expected = "Title & more\nFirst paragraph, of some length <here>, that goes on for a while.\nSecond paragraph with a link in it and more words."
    rows = spark.createDataFrame([(1, "u", PAGE), (2, "u", None), (3, None, ""), (4, "u", "<div>" * 3000 + "deep text"), (5, "u", "<<< a href='x")], "page_id long, url string, html string")
    got = {r.page_id: r for r in mainhtml.extract(rows).collect()}
    assert got[1].text == expected and got[1].n_chars == len(expected)
    assert got[2].text == got[3].text == "" and got[4].text == "deep text"
    for page in [r.html for r in base.read(spark, "/root/testdata/sf0.01", "pages", "html").collect()]:
        assert mainhtml.main_text(page) == plain_article(page)


def plain_article(page):
    """The text of a given page's article, which holds but headings and paragraphs."""
    out = []
    for part in re.split(r"</?(?:p|h1)[^>]*>", re.search(r"<article>(.*?)</article>", page, re.S)[1]):
        text = " ".join(entities.unescape(re.sub(r"<[^>]+>", "", part.replace("<br>", " "))).split())
        out += [text] if text else []
    return "\n".join(out)


def without_density(page):
    """The page with its named parts and menus dropped, but all else kept: names and link counts without the choice by density."""
    with pytest.MonkeyPatch.context() as m:
        m.setattr(mainhtml, "article_of", lambda body: setattr(body, "marked", True) or float("inf"))
        return mainhtml.main_text(page)


def test_density_alone_finds_articles_of_pages_without_names(spark):
    """The given pages with every name taken away: menus, adverts and footers are divs like the article."""
    pages = [r.html for r in base.read(spark, "/root/testdata/sf0.01", "pages", "html").collect()]
    bare = [re.sub(r"<(/?)(?:nav|footer|article)\b", r"<\1div", h.replace('<div class="ad">', "<div>")) for h in pages]
    found = sum(mainhtml.main_text(b) == plain_article(h) for b, h in zip(bare, pages, strict=True))
    lists = sum(without_density(b) == plain_article(h) for b, h in zip(bare, pages, strict=True))
    assert found >= 0.9 * len(pages) and lists <= 0.01 * len(pages)


LONG = "A paragraph of the article, long enough, with its commas and its stops. It goes on for another sentence, as such paragraphs do."
PLAIN_PAGES = [  # nothing here names its role: links and density alone tell the parts apart
    (
        f"<body><div class=k1><ul><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a><li><a href=4>Four</a></ul></div><div class=k2><h1>A title</h1><p>{LONG}</p><p>{LONG} With <a href=5>a link</a> in it.</p><p>{LONG}</p></div><div class=k3><a href=6>Next</a> <a href=7>Back</a> <a href=8>Up</a></div></body>",
        f"A title\n{LONG}\n{LONG} With a link in it.\n{LONG}",
    ),
    (
        f"<table><tr><td><a href=1>Home</a><br><a href=2>Map</a><br><a href=3>Help</a></td><td><div><p>{LONG}<p>{LONG}<ul><li>First point, of some length, with no link.<li>Second &lt;point&gt;.</ul><blockquote>{LONG}</blockquote></div></td></tr></table>",
        f"{LONG}\n{LONG}\nFirst point, of some length, with no link.\nSecond <point>.\n{LONG}",
    ),
    (
        f"<div><div><p>{LONG}</p><div><a href=1>Other text one</a><a href=2>Other text two</a><a href=3>Other text three</a></div><p>{LONG}</p><p>{LONG}</p></div></div>",
        f"{LONG}\n{LONG}\n{LONG}",
    ),
]


def test_main_text_of_pages_that_name_nothing():
    for page, expected in PLAIN_PAGES:
        assert mainhtml.main_text(page) == expected
    short = "<div>Share this</div><div>Printed on paper</div>"
    page = f"<body>{short}<div><h1>A title</h1><p>{LONG}</p><p>{LONG}</p></div><div>All rights kept by us</div></body>"
    assert mainhtml.main_text(page) == f"A title\n{LONG}\n{LONG}" != without_density(page)
    named = f"<main><p>{LONG}</p><section class='reader-comments'><p>{LONG}</p><p>{LONG}</p></section><p>{LONG}</p><div id=promo>Buy</div></main>"
    assert mainhtml.main_text(named) == f"{LONG}\n{LONG}"
    assert mainhtml.main_text(f"<section class=section-header><h2>Heading</h2></section><article><header><h1>T</h1></header><p>{LONG}</p></article>") == f"T\n{LONG}"


def test_named_parts_go_whatever_their_share():
    many = "".join(f"<p>{LONG}</p>" for _ in range(12))
    article = f"<div><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div>"
    expected = f"T\n{LONG}\n{LONG}"
    for part in (f"<div class=comments>{many}</div>", f"<section id=reader-comments>{many}</section>", f"<div class='comment-list x'>{many}</div>", f"<aside>{many}</aside>", f"<div role=complementary>{many}</div>"):
        assert mainhtml.main_text(f"<body>{article}{part}</body>") == expected
        assert mainhtml.main_text(f"<body><article>{article}{part}</article></body>") == expected
        assert mainhtml.main_text(f"<body><article>{article}</article>{part}</body>") == expected
        assert mainhtml.main_text(f"<body>{part}</body>") == ""
    assert mainhtml.main_text(f"<body><p>Short.</p><div class=comments>{many}</div></body>") == "Short."


def test_names_hit_whole_classes_of_blocks():
    assert mainhtml.main_text("<article><p><a href=x>Only a link</a></p></article>") == "Only a link"
    code = f"<article><p>{LONG}</p><pre>x = 1 <span class=comment># a comment</span></pre></article>"
    assert mainhtml.main_text(code) == f"{LONG}\nx = 1 # a comment"
    periods = f"<article><p>{LONG}</p><section class='notice-periods'><p>Three months.</p></section></article>"
    assert mainhtml.main_text(periods) == f"{LONG}\nThree months."
    sections = f"<article><section><p>{LONG}</p><p>{LONG}</p></section><section><p>Brief.</p></section></article>"
    assert mainhtml.main_text(sections) == f"{LONG}\n{LONG}\nBrief."
    assert mainhtml.main_text("<body><ul><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a></ul></body>") == ""


@pytest.mark.parametrize("unit", ["<div>x ", "<a ", "<div>y<p>", "<li>a<div>", "<b>x<p>", "<a '>t", "</p>", "<!-- ", "<", "<table><td><div>", "<p><span>s"])
def test_main_text_of_long_broken_pages(unit):
    began = time.time()
    mainhtml.main_text(unit * (1_000_000 // len(unit)))
    mainhtml.main_text("<p>x<table><tr><td>" + unit * (200_000 // len(unit)) + ">")
    assert time.time() - began < 20


def test_main_text_inside_wrappers():
    inner = "<p>First paragraph, of some length, that goes on for a while.<p>Second paragraph with more words in it."
    expected = inner[3:].replace("<p>", "\n")
    controls = "<select><option>One</select><button>Send</button><label>Name <input></label>"
    for tag in ("form", "fieldset", "object"):
        assert mainhtml.main_text(f"<body><{tag}><div>{inner}</div>{controls}</{tag}></body>") == expected
        assert mainhtml.main_text(f"<body><{tag}><article>{inner}</article></{tag}><{tag}>Search here {controls}</{tag}></body>") == expected


def test_quality_sample_is_the_same_at_each_run(spark):
    docs, labels = read(spark, "documents", "doc_id", "text"), read(spark, "labels")
    twice = docs.unionByName(docs.withColumn("text", F.concat("text", F.lit(" more"))))
    models = [rules.learn(d, labels) for d in (twice.repartition(3), twice.repartition(2))]
    assert models[0].rules == models[1].rules and models[0].intercept == models[1].intercept


def test_a_cluster_without_a_shared_folder_is_an_error(spark):
    class Session:
        conf = spark.conf
        sparkContext = type("Context", (), {"master": "spark://host:7077", "getCheckpointDir": staticmethod(lambda: None)})  # noqa: N815

    if spark.conf.get("spark.checkpoint.dir", None) is None:
        assert base.shared_folder(spark).startswith("/")
        with pytest.raises(RuntimeError):
            base.shared_folder(Session)
        Session.sparkContext.getCheckpointDir = staticmethod(lambda: "hdfs://store/checkpoints/0a1b")
        assert base.shared_folder(Session) == "hdfs://store/checkpoints"


def test_e8_decoding_and_minimal_vectors():
    v = lattice.minimal_vectors()
    assert len(v) == 240 and np.allclose((v**2).sum(1), 2)
    y = np.random.default_rng(0).normal(size=(500, 8)) * 2
    p = lattice.decode(y)
    assert ((y - p) ** 2).sum(1).max() <= 1 + 1e-9  # the covering radius
    closer = ((y[:, None] - p[:, None] - v[None]) ** 2).sum(2).min(1)
    assert (closer >= ((y - p) ** 2).sum(1) - 1e-9).all()


def test_cells_grow_with_the_vectors_and_still_meet():
    assert lattice.stretches(0) == lattice.stretches(lattice.ENOUGH) == [1.0]
    few, many = lattice.stretches(10 * lattice.ENOUGH), lattice.stretches(lattice.CELLS * 10 * lattice.ENOUGH)
    assert len(few) == 2 and 0 < few[1] < 1 and len(many) == 3 and many[1] == 1.0
    strangers = {}
    for blocks in ([1.0], few, [1.0, 1.0]):
        recall, strangers[len(blocks), blocks[-1]] = met_at(blocks, 0.981)
        assert recall >= 0.95
    assert strangers[1, 1.0] > 2 * strangers[2, few[1]] and strangers[2, 1.0] <= strangers[2, few[1]]


def met_at(blocks, cosine, dimensions=64, n=1500):
    """Share of random pairs at a cosine that meet in a cell, and how many strangers meet in 39 others."""
    rng = np.random.default_rng(4)
    a = rng.normal(size=(n, dimensions))
    a /= np.linalg.norm(a, axis=1)[:, None]
    off = rng.normal(size=a.shape)
    off -= (off * a).sum(1)[:, None] * a
    b = cosine * a + math.sqrt(1 - cosine**2) * off / np.linalg.norm(off, axis=1)[:, None]
    met, others = np.zeros(n, bool), 0
    for _, home, around in lattice.cells(np.concatenate([a, b]), blocks):
        x, y, near = home[:n], home[n:], around[:n]
        met |= (x == y) | (near == y[:, None]).any(1) | (around[n:] == x[:, None]).any(1)
        others += sum((np.roll(y, k)[:, None] == near).sum() for k in range(1, 40))
    return met.mean(), others


@pytest.mark.parametrize("vectors", [10_000, 1_000_000, 50_000_000, 100_000_000])
def test_recall_at_the_cells_of_large_labels(vectors):
    blocks = lattice.stretches(vectors)
    recall = met_at(blocks, 0.9802)[0]
    print(vectors, len(blocks), lattice.effort(len(blocks)), recall)
    assert recall >= 0.97


def test_near_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    seeds = rng.normal(size=(150, 32))
    x = np.concatenate([seeds, seeds[:60] + 0.02 * rng.normal(size=(60, 32)), seeds[:30] + 0.2 * rng.normal(size=(30, 32)), seeds[:20], seeds[:10] * 3])
    labels = np.concatenate([np.arange(150) % 4, np.arange(60) % 4, np.arange(30) % 4, np.arange(20) % 4, np.arange(10) % 4])
    rows = [(i, [float(c) for c in v.astype(np.float32)], int(k)) for i, (v, k) in enumerate(zip(x, labels, strict=True))]
    odd_rows = [(1000, None, 1), (1001, [0.0] * 32, 1), (1002, [None] + [1.0] * 31, 1), (1003, [float("nan")] * 32, 1), (1004, rows[0][1], None), (1005, [], 1), (1006, [float("inf")] * 32, 1)]
    df = spark.createDataFrame(rows + odd_rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in lattice.near_duplicates(df).collect()}
    m = np.array([r[1] for r in rows], dtype=float)
    m /= np.linalg.norm(m, axis=1)[:, None]
    close = (m @ m.T >= 0.98) & (labels[:, None] == labels)
    np.fill_diagonal(close, False)
    found = sum(got[i].n_links for i in range(len(rows)))
    assert found >= 0.98 * close.sum() and all(got[i].n_links <= close[i].sum() for i in range(len(rows)))
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(1000, 1007))
    assert got[210].component_id <= 60


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2)) if a != b] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, 2000 + i) for i in range(1, 50)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_hits(docs, items):
    windows = defaultdict(set)
    for i, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        for k in range(max(len(w) - 9, min(1, len(w)))):
            windows[tuple(w[k : k + 10])].add(str(i))
    out = []
    for i, t in docs:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    found |= own
                    hit |= set(range(k, k + n))
        out.append((repr(i), len(w), len(hit), sorted(found)))
    return sorted(out)


def test_decontamination_equals_brute_force(spark, monkeypatch):
    docs = read(spark, "documents", "doc_id", "text").unionByName(odd(spark).where("doc_id <> 4").select("doc_id", "text"))
    items = read(spark, "benchmark").unionByName(spark.createDataFrame([(900, "the of and"), (901, None), (902, ""), (903, "the of and to the of and to the of and to the of and to"), (904, "cat")], "item_id long, text string"))
    expected = brute_hits([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    for words in (1_000_000, 400):
        monkeypatch.setattr(fmindex, "BLOCK_WORDS", words)
        got = fmindex.scan(docs, items).collect()
        assert expected == sorted((repr(r.doc_id), r.n_words, r.n_hit, sorted(r["items"])) for r in got)
        clean = fmindex.remove(docs.withColumn("n_chars", F.length("text")), items)
        assert fmindex.scan(clean, items).where("n_hit > 0").count() == 0 and clean.where("n_chars <> length(text)").count() == 0
        texts = {(repr(r.doc_id), r.text) for r in docs.collect()}
        untouched = {e[0] for e in expected if e[2] == 0} - {e[0] for e in expected if e[2]}
        assert {x for x in texts if x[0] in untouched} <= {(repr(r.doc_id), r.text) for r in clean.collect()}
    assert fmindex.digest(docs, items.where("false")).where("contaminated").count() == 0
    assert fmindex.digest(docs.where("false"), items).count() == 0


def test_decontamination_looks_again_where_a_cut_joins_words(spark, monkeypatch):
    w = [f"w{i}" for i in range(40)]
    inner, outer = w[20:32], w[:10]
    docs = spark.createDataFrame([(1, "before " + " ".join(w[:5] + inner + w[5:10]) + " after", 9), (2, " ".join(inner), 9), (3, "Nothing, of these.", None), (4, None, None)], "doc_id long, text string, n_chars long")
    items = spark.createDataFrame([(1, " ".join(outer)), (2, " ".join(inner))], "item_id long, text string")
    for size in (1_000_000, 12):
        monkeypatch.setattr(fmindex, "BLOCK_WORDS", size)
        got = {r.doc_id: (r.text, r.n_chars) for r in fmindex.remove(docs, items).collect()}
        assert set(got) == {1, 3, 4} and got[3] == ("Nothing, of these.", None) and got[4] == (None, None)
        assert got[1][0].split() == ["before", "after"] and got[1][1] == len(got[1][0])


def test_decontamination_counts_ids_once_at_any_block_size(spark, monkeypatch):
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "nothing of these")], "doc_id long, text string")
    texts = [" ".join(words[k : k + 15]) for k in (0, 20, 40)]
    rows = [(7, texts[0]), (7, texts[0]), (7, texts[1]), (8, texts[1]), (None, texts[0]), (None, texts[2]), (None, None)]
    items = spark.createDataFrame(rows, "item_id long, text string")
    built = []
    whole = fmindex.Phrases.__init__
    monkeypatch.setattr(fmindex.Phrases, "__init__", lambda self, ids, *a: (built.append(len(ids)), whole(self, ids, *a))[1])
    for size in (1_000_000, 20):
        monkeypatch.setattr(fmindex, "BLOCK_WORDS", size)
        built.clear()
        got = {r.doc_id: r for r in fmindex.digest(docs, items).collect()}
        assert (got[1].n_items, got[1].n_hit) == (2, 45) and got[2].n_items == 0
        assert got[1].items_sha256 == hashlib.sha256(b"7,8").hexdigest()
        assert (len(built) == 1) == (size > 20) and sum(built) == 6


def test_only_windows_of_the_shards_words_are_searched(monkeypatch):
    rng = np.random.default_rng(9)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 3000, int(rng.integers(3, 40)))) for _ in range(400)]
    block = fmindex.Phrases([str(i) for i in range(len(texts))], pa.array(texts))
    asked = []
    whole = fmindex.FMIndex.search
    monkeypatch.setattr(fmindex.FMIndex, "search", lambda self, p, n: (asked.append(len(p)), whole(self, p, n))[1])
    for symbols in (rng.integers(0, 60, 500), block.symbols[5][block.symbols[5] > 0], np.concatenate([block.symbols[k][block.symbols[k] > 0] for k in (3, 9, 200)])):
        symbols, asked[:] = symbols.astype(np.int32), []
        place, window = fmindex.occurrences(symbols, np.zeros(len(symbols), np.int64), block)
        rows = [r[r > 0] for r in block.symbols]
        expected = [(k, w) for w, r in enumerate(rows) for k in range(len(symbols) - len(r) + 1) if (symbols[k : k + len(r)] == r).all()]
        assert sorted(zip(place, window, strict=True)) == sorted(expected)
        present = set(symbols.tolist())
        assert sum(asked) in (0, sum(set(r.tolist()) <= present for r in rows)) and sum(asked) < len(rows) / 10


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(5)
    symbols = rng.integers(1, 4, 3000).astype(np.int32)
    starts, lengths = np.array([0, 500, 1700]), np.array([500, 1200, 1300])
    index = fmindex.FMIndex(symbols, starts, lengths, 3)
    patterns = rng.integers(1, 4, (40, 5)).astype(np.int32)
    low, high = index.search(patterns, np.full(40, 5))
    for p, a, b in zip(patterns, low, high, strict=True):
        true = [s + k for s, n in zip(starts, lengths, strict=True) for k in range(n - 4) if (symbols[s + k : s + k + 5] == p).all()]
        assert sorted(index.locate(np.arange(a, b))) == true


def test_every_query_on_odd_and_empty_tables(spark, tmp_path):
    for name, rows in (("odd", odd(spark)), ("empty", odd(spark).where("false"))):
        at = f"{tmp_path}/{name}"
        rows.withColumns({"size": F.lit("x"), "score": F.lit(1), "h1": F.lit(2), "row": F.lit(0), "class": F.lit("c")}).write.parquet(f"{at}/documents.parquet")
        keep = "true" if name == "odd" else "false"
        pages = [(1, None, None), (None, "u", ""), (3, "u", "<p>x<nav>y"), (3, "u", "<p>x<nav>y"), (4, "u", "<div>" * 2000 + "deep"), (5, "u", "&lt;" * 50_000)]
        spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit(1)).where(keep).write.parquet(f"{at}/pages.parquet")
        vectors = [(1, None, 1), (None, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (3, [1.0, 0.01], 1), (4, [1.0, 0.0], None), (5, [], 1), (6, [float("nan"), 1.0], 1), (7, [1.0, 0.0], 1)]
        spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit("r")).where(keep).write.parquet(f"{at}/embeddings.parquet")
        for t in ("benchmark", "labels"):
            read(spark, t).where(keep).write.parquet(f"{at}/{t}.parquet")
        for query, f in queries.queries().items():
            got = f(spark, at)
            n = spark.read.parquet(f"{at}/{'embeddings' if 'op8' in query else 'pages' if 'op7' in query else 'documents'}.parquet").count()
            rows = got.collect()
            assert len(rows) == n, (name, query)
            if name == "empty":
                continue
            if query == "op7_main_text":
                assert sorted((r.page_id or 0, r.text, r.n_chars) for r in rows) == [(0, "", 0), (1, "", 0), (3, "x", 1), (3, "x", 1), (4, "deep", 4), (5, "<" * 50_000, 50_000)]
            elif query == "op8_near_vectors":
                assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in rows) == Counter({(None, 0, None, True): 1, (1, 0, 1, True): 1, (3, 1, 3, True): 2, (4, 0, 4, True): 1, (5, 0, 5, True): 1, (6, 0, 6, True): 1, (7, 1, 3, False): 1})
            else:  # equal rows get equal results, and no column but these may be null
                named = [c for c in got.columns if c not in ("doc_id", "grown_shard", "rank", "source", "class_id")]
                assert all(r[c] is not None for r in rows for c in named), query
                twice = [tuple(r[c] for c in named if c not in ("slot", "shard", "taken", "passes", "kept", "rank")) for r in rows if r.doc_id == 6]
                assert len(twice) == 2 and twice[0] == twice[1], query
