"""Toxicity by a counterfactually regularised classifier over words, stems and word pairs.

A text is the set of its hashed words, stems (first letters of longer words, for endings that
change) and pairs of neighbouring words; words and stems that are frequent in it count once more
at each of two levels. On a bounded sample of labelled rows the features that tell the labels apart
best are chosen, and logistic weights are fitted with a lasso penalty and a counterfactual one: in
every sentence of the sample that names a group, the name is swapped for others of its kind and for
a neutral word, and the square of the change in score is added to the loss. A group that toxic texts
often name then can't carry weight of its own, so a neutral mention isn't taken for an insult.

Defined results: null and empty texts have no features and are scored by the intercept; a null id
isn't held out; labels that are null or repeat with both values are resolved by the lowest; rows
that share an id are each learned from; without both labels in the sample the score is the share of
label 1, or 0.5 without any; equal texts get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import NOT_ALNUM, Tokenizer, cut, held_out, mix, text_runs

THRESHOLD = 0.7
#: The fold that isn't learned from.
FOLD = (3, 1)
#: Labelled rows, and sentences with a swapped name, that the weights are fitted on at most, about; a hash chooses them.
MAX_LABELLED, MAX_SWAPS = 10_000, 50_000
#: Bytes of the stems of longer words.
STEMS = (5, 6, 7)
#: Features that are weighed, and the least documents of one.
MAX_FEATURES, LEAST_DOCUMENTS = 2_000, 5
#: Weights of the lasso and of the counterfactual penalty.
LASSO, COUNTERFACTUAL = 1e-4, 5.0
#: Swaps of each name: the neutral word, and so many others of its kind.
OTHERS = 2

# Names of groups by kind; the first of a kind is its neutral word.
NAMES = [
    "people women men girls boys mothers fathers wives husbands ladies gentlemen transsexuals lesbians gays homosexuals heterosexuals bisexuals",
    "believers christians muslims jews hindus buddhists sikhs catholics protestants atheists mormons",
    "religious christian muslim jewish hindu buddhist sikh catholic protestant atheist mormon islamic",
    "residents immigrants refugees foreigners migrants natives africans arabs asians americans mexicans latinos europeans turks",
    "local african arab asian american mexican latino european turkish black white chinese indian japanese korean russian polish",
    "person woman man girl boy mother father wife husband transsexual lesbian gay homosexual heterosexual bisexual transgender queer",
    "everyone disabled deaf blind elderly autistic young old",
    "menschen frauen männer mädchen jungen mütter väter lesben schwule christen muslime juden hindus ausländer flüchtlinge migranten türken araber",
    "gens femmes hommes filles garçons mères pères lesbiennes homosexuels chrétiens musulmans juifs étrangers réfugiés migrantes arabes africains",
    "gente mujeres hombres chicas chicos madres padres lesbianas homosexuales cristianos musulmanes judíos extranjeros refugiados inmigrantes árabes africanos",
]

_PAIR = np.uint64(0x9E3779B97F4A7C15)
_LEVEL = np.uint64(3)
_STOPS = np.zeros(256, dtype=bool)
_STOPS[[ord(c) for c in ".!?\n"]] = True


class Words:
    """The words of a run of texts: hashes of each and of its stems (0 where it is too short), text and byte span."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, tokenizer: Tokenizer):
        self.start, end, self.doc = tokenizer.spans(data, offsets)
        found = tokenizer.hashed(data, self.start, end, *[np.minimum(self.start + k, end) for k in STEMS])
        long = [np.ones(len(end), dtype=bool), *[end - self.start > k for k in STEMS]]
        self.hash = np.stack([np.where(some, mix(h, i), 0) for i, (h, some) in enumerate(zip(found, long, strict=True))], axis=1)

    @classmethod
    def of(cls, text: str, tokenizer: Tokenizer) -> Words:
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        return cls(data, np.array([0, len(data)]), tokenizer)


def terms_of(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, term) of every word, stem and pair of neighbouring words; a term's two lowest bits are 0."""
    near = np.flatnonzero(doc[1:] == doc[:-1])
    pairs = mix(hashes[near, 0] * _PAIR + hashes[near + 1, 0], 7)
    parts = [(doc, hashes[:, 0])]
    for k in range(1, hashes.shape[1]):
        some = hashes[:, k] != 0
        parts.append((doc[some], hashes[some, k]))
    parts.append((doc[near], pairs))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]) & ~_LEVEL


def levelled(of: np.ndarray, counts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, level) of each feature of terms that texts of so many words hold so often: 0 that they hold it,
    1 that it stands there twice and for half a hundredth of the words, 2 for a hundredth."""
    n = words[of]
    held = [np.arange(len(of)), np.flatnonzero((counts >= 2) & (counts * 200 >= n)), np.flatnonzero((counts >= 2) & (counts * 100 >= n))]
    return np.concatenate(held), np.repeat(np.arange(3), [len(h) for h in held])


def features(hashes: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of all texts, each once, by text and feature; a feature is its term with the level in the lowest bits."""
    of, term = terms_of(hashes, doc)
    order = np.lexsort((term, of))
    of, term = of[order], term[order]
    first = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (term[1:] != term[:-1])])) if len(of) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(of)))
    at, level = levelled(of[first], counts, np.bincount(doc, minlength=docs))
    out, feature = of[first][at], term[first][at] | level.astype(np.uint64)
    order = np.lexsort((feature, out))
    return out[order], feature[order].view(np.int64)


class Swaps:
    """For each name of a group, by its hash, the hashes of the words that may stand in its place."""

    def __init__(self, tokenizer: Tokenizer):
        self.others: dict[int, list[np.ndarray]] = {}
        for line in NAMES:
            kind = Words.of(line, tokenizer).hash
            for k, h in enumerate(kind[:, 0]):
                if int(h) not in self.others:  # a word of two kinds belongs to the first
                    rest = [kind[(k + step) % len(kind)] for step in range(1, len(kind)) if (k + step) % len(kind)][:OTHERS]
                    self.others[int(h)] = ([kind[0]] if k else []) + rest
        self.names = np.array(sorted(self.others), dtype=np.uint64)

    def of(self, data: np.ndarray, words: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(text, features lost, features gained) for each swap of each name in its sentence."""
        named = np.flatnonzero(np.isin(words.hash[:, 0], self.names))
        if not len(named):
            return
        sentence = np.cumsum(_STOPS[data])[words.start]
        edge = np.flatnonzero(np.concatenate([[True], (sentence[1:] != sentence[:-1]) | (words.doc[1:] != words.doc[:-1])]))
        stops = np.append(edge[1:], len(sentence))
        for at in named:
            k = int(np.searchsorted(edge, at, side="right")) - 1
            plain = words.hash[edge[k] : stops[k]]
            one = np.zeros(len(plain), dtype=np.int64)
            before = features(plain, one, 1)[1]
            for other in self.others[int(words.hash[at, 0])]:
                changed = plain.copy()
                changed[plain[:, 0] == words.hash[at, 0]] = other
                after = features(changed, one, 1)[1]
                yield int(words.doc[at]), np.setdiff1d(before, after, assume_unique=True), np.setdiff1d(after, before, assume_unique=True)


_EXAMPLES = "kind int, doc_id long, y int, plus array<long>, minus array<long>"


def _lists(parts: list[np.ndarray]) -> pa.Array:
    values = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, parts)]).astype(np.int32), pa.array(values))


def examples(rows: DataFrame) -> DataFrame:
    """kind, doc_id, y, plus, minus: a row of kind 0 for each text (its features), of kind 1 for each swap (those lost, those gained).

    rows: doc_id (long), y (int), text.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(NOT_ALNUM)
        swaps = Swaps(tokenizer)
        for batch in batches:
            ids, y = batch.column("doc_id").to_numpy(), batch.column("y").to_numpy()
            for i, j, data, offsets in text_runs(batch.column("text")):
                words = Words(data, offsets, tokenizer)
                doc, found = features(words.hash, words.doc, j - i)
                whole = np.split(found, np.searchsorted(doc, np.arange(1, j - i)))
                swapped = list(swaps.of(data, words))
                of = i + np.array([*range(j - i), *[k for k, _, _ in swapped]], dtype=np.int64)
                kind = np.repeat([0, 1], [j - i, len(swapped)]).astype(np.int32)
                none = [np.zeros(0, np.int64)] * (j - i)
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(ids[of]), pa.array(y[of]), _lists([*whole, *[p for _, p, _ in swapped]]), _lists([*none, *[m for _, _, m in swapped]])], ["kind", "doc_id", "y", "plus", "minus"])

    return rows.mapInArrow(apply, _EXAMPLES)


class Classifier:
    """score = sigmoid of intercept + sum of the weights of a text's features (term and level).

    terms: sorted; weights: a row for each term, a column for each level.
    """

    def __init__(self, intercept: float, found: np.ndarray, weights: np.ndarray):
        self.intercept = intercept
        numbers = found.view(np.uint64)
        self.terms, at = np.unique(numbers & ~_LEVEL, return_inverse=True)
        self.weights = np.zeros((len(self.terms), 3))
        self.weights[at, (numbers & _LEVEL).astype(np.int64)] = weights

    def scores(self, words: Words, docs: int) -> np.ndarray:
        total = np.full(docs, self.intercept)
        if len(self.terms) and len(words.doc):
            of, term = terms_of(words.hash, words.doc)
            at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
            hit = self.terms[at] == term
            held, counts = np.unique(of[hit] * len(self.terms) + at[hit], return_counts=True)
            of, at = held // len(self.terms), held % len(self.terms)
            place, level = levelled(of, counts, np.bincount(words.doc, minlength=docs))
            total += np.bincount(of[place], weights=self.weights[at[place], level], minlength=docs)
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


class _Sparse:
    """A matrix by the rows, columns and values of its entries."""

    def __init__(self, lists: list[tuple[np.ndarray, np.ndarray]], columns: int):
        sizes = [len(c) for c, _ in lists]
        self.shape = len(lists), columns
        self.row = np.repeat(np.arange(len(lists)), sizes)
        self.column = np.concatenate([c for c, _ in lists]) if lists else np.zeros(0, np.int64)
        self.value = np.concatenate([v for _, v in lists]) if lists else np.zeros(0)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=self.value * w[self.column], minlength=self.shape[0])

    def back(self, e: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, weights=self.value * e[self.row], minlength=self.shape[1])

    def norm(self) -> float:
        """The largest eigenvalue of the matrix times its transpose, from a few power steps, a little enlarged."""
        if not len(self.row):
            return 0.0
        v, size = np.ones(self.shape[1]), 0.0
        for _ in range(30):
            v = self.back(self.dot(v))
            size = float(np.linalg.norm(v))
            v /= max(size, 1e-30)
        return 1.1 * size


def fit(texts: _Sparse, y: np.ndarray, swaps: _Sparse, terms: np.ndarray, lasso: float = LASSO, counterfactual: float = COUNTERFACTUAL, steps: int = 1500) -> Classifier:
    """Accelerated proximal gradient steps on the mean logistic loss, the lasso and the mean squared change under swaps."""
    none = np.zeros(0, dtype=np.int64), np.zeros(0)
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean(), 1e-4, 1 - 1e-4)) if len(y) else 0.5
        return Classifier(float(np.log(share / (1 - share))), *none)
    b = float(np.log(y.mean() / (1 - y.mean())))
    n, m = len(y), max(swaps.shape[0], 1)
    step = 1 / (0.25 * (texts.norm() + n) / n + 2 * counterfactual * swaps.norm() / m + 1e-9)
    w = np.zeros(len(terms))
    v, vb, t = w.copy(), b, 1.0
    for _ in range(steps):
        error = 1 / (1 + np.exp(-(texts.dot(v) + vb))) - y
        gradient = texts.back(error) / n + 2 * counterfactual * swaps.back(swaps.dot(v)) / m
        new = v - step * gradient
        new = np.sign(new) * np.maximum(np.abs(new) - step * lasso, 0)
        new_b = vb - step * float(error.mean())
        if float((v - new) @ (new - w)) > 0:  # momentum points uphill: start it anew
            t = 1.0
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t_new * (new - w), new_b + (t - 1) / t_new * (new_b - b)
        w, b, t = new, new_b, t_new
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    return Classifier(b, terms[kept], w[kept])


def _sampled(rows: DataFrame, key: str, most: int) -> DataFrame:
    scale, count = 1 << 30, rows.count()
    return rows if count <= most else rows.where(F.pmod(F.xxhash64(key), F.lit(scale)) < int(scale * most / count))


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", lasso: float = LASSO, counterfactual: float = COUNTERFACTUAL) -> Classifier:
    """Fits the classifier on a bounded sample of the labelled rows of docs (doc_id, text) outside the held-out fold."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", *FOLD)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).cast("int").alias("y"))
    known = F.broadcast(_sampled(known, "doc_id", MAX_LABELLED))  # about MAX_LABELLED rows of two numbers
    rows = cut(examples(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(known, "doc_id").select("doc_id", "y", "text")))
    texts = rows.where("kind = 0")
    size = texts.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("positive")).first()
    per = texts.select("y", F.explode("plus").alias("term")).groupBy("term").agg(F.count("*").alias("n"), F.sum("y").alias("positive")).where(F.col("n") >= LEAST_DOCUMENTS)
    share = size["positive"] / max(size["n"], 1)
    unlike = (F.col("positive") - F.col("n") * share) ** 2 / F.col("n")  # the chi-square statistic, less what all terms share
    terms = np.sort(per.orderBy(unlike.desc(), "term").limit(MAX_FEATURES).toArrow()["term"].to_numpy().astype(np.int64))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each list as places among the terms; what isn't among them goes."""

        def places(column: pa.Array) -> pa.Array:
            found = [np.array(x, dtype=np.int64) for x in column.to_pylist()]
            at = [np.searchsorted(terms, x) for x in found]
            return _lists([p[terms[np.minimum(p, len(terms) - 1)] == x] if len(terms) else p[:0] for p, x in zip(at, found, strict=True)])

        for batch in batches:
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("kind", "doc_id", "y")], places(batch.column("plus")), places(batch.column("minus"))], batch.schema.names)

    narrow = rows.mapInArrow(chosen, _EXAMPLES)
    changed = narrow.where("kind = 1 and (size(plus) > 0 or size(minus) > 0)")
    changed = _sampled(changed.withColumn("key", F.struct("doc_id", "plus", "minus")), "key", MAX_SWAPS).drop("key")
    sample = sorted((tuple(r) for r in narrow.where("kind = 0").unionByName(changed).collect()), key=repr)  # bounded as the parameters say

    def matrix(kind: int) -> _Sparse:
        return _Sparse([(np.array([*p, *m], dtype=np.int64), np.array([1.0] * len(p) + [-1.0] * len(m))) for k, _, _, p, m in sample if k == kind], len(terms))

    return fit(matrix(0), np.array([y for k, _, y, _, _ in sample if k == 0], dtype=float), matrix(1), terms, lasso, counterfactual)


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, held_out, score and predicted (int) of docs (doc_id, text)."""
    rows = docs.select("doc_id", held_out("doc_id", *FOLD).alias("held_out"), "text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(NOT_ALNUM)
        for batch in batches:
            out = np.zeros(len(batch))
            for i, j, data, offsets in text_runs(batch.column("text")):
                out[i:j] = model.scores(Words(data, offsets, tokenizer), j - i)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(out), pa.array((out >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(apply, f"doc_id {kind}, held_out boolean, score double, predicted int")
