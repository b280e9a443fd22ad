"""Quality scores by a sparse rule ensemble (RuleFit), compiled to column expressions.

Statistics of each text are column expressions. On a bounded sample of labelled rows small
trees are boosted in numpy; every path from a root to a node is a conjunctive rule; logistic
weights with a lasso penalty choose among the rules; those that keep a weight are written back
as Spark columns, so that scoring is one projection without Python.

Defined results: null and empty texts have all statistics 0 and are scored like any other; a
null id isn't held out; labels that are null or repeat with both values are resolved by the
lowest; without both labels in the sample the score is the share of label 1, or 0.5 without
any; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import held_out

THRESHOLD = 0.7
#: Most labelled rows that the ensemble is fitted on; a hash of the id chooses them.
MAX_LABELLED = 20_000
#: The fold that isn't learned from.
FOLD = (4, 2)


NAMES = ("log_chars", "chars_per_word", "words_per_line", "symbols", "bars", "shouts", "capital_runs", "digit_runs", "stops", "commas", "beyond_ascii")


def _bound(value: Column, use) -> Column:
    """use(value), with value evaluated once however often ``use`` names it: a lambda's variable stands for it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def measured(text: Column) -> Column:
    """A struct of all statistics over the whole text, 0 for an empty one."""
    text = F.coalesce(text, F.lit(""))

    def runs(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)).cast("double")

    def left(marks: str) -> Column:
        """Bytes without the ASCII marks: what went counts them, far cheaper than a pattern does."""
        kept = text
        for m in marks:
            kept = F.replace(kept, F.lit(m), F.lit(""))
        return F.octet_length(kept).cast("double")

    counts = F.struct(
        F.length(text).cast("double").alias("chars"),
        F.octet_length(text).cast("double").alias("size"),
        *[left(m).alias(n) for n, m in (("lines", "\n"), ("spaces", " "), ("bars", "|"), ("shouts", "!"), ("stops", ".?"), ("commas", ","))],
        runs(r"[*%$&#@~^=<>_\\]{2,}").alias("symbols"),
        runs(r"[A-Z]{2,}").alias("capitals"),
        runs(r"[0-9]+").alias("digits"),
    )

    def shares(c: Column) -> Column:
        some = F.when(c["chars"] > 0, 1.0).otherwise(0.0)
        lines = c["size"] - c["lines"] + some
        words = c["size"] - c["spaces"] + lines
        share = lambda of, whole: F.when(whole > 0, of / whole).otherwise(0.0)
        gone = lambda n: c["size"] - c[n]
        values = (F.log1p(c["chars"]), share(c["chars"], words), share(words, lines), share(c["symbols"], words), share(gone("bars"), words), share(gone("shouts"), words), share(c["capitals"], words), share(c["digits"], words), share(gone("stops"), words), share(gone("commas"), words), share(c["size"] - c["chars"], c["chars"]))
        return F.struct(*[v.alias(n) for n, v in zip(NAMES, values, strict=True)])

    return _bound(counts, shares)


def statistics(text: Column) -> dict[str, Column]:
    """Name -> column."""
    one = measured(text)
    return {n: one[n] for n in NAMES}


class RuleEnsemble:
    """rules: list of (weight, [(statistic, is_upper, bound), ...]); upper: statistic <= bound."""

    def __init__(self, intercept: float, rules: list[tuple[float, list[tuple[str, bool, float]]]]):
        self.intercept, self.rules = intercept, rules

    def column(self, stats: Column) -> Column:
        """The score as an expression over the struct of statistics."""
        return _bound(stats, lambda s: self._sum({n: s[n] for n in NAMES}))

    def _sum(self, stats: dict[str, Column]) -> Column:
        parts = [F.lit(float(self.intercept))]
        for weight, terms in self.rules:
            holds = None
            for name, upper, bound in terms:
                term = stats[name] <= F.lit(float(bound)) if upper else stats[name] > F.lit(float(bound))
                holds = term if holds is None else holds & term
            parts.append(F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0)))
        while len(parts) > 1:  # a balanced tree: a chain of hundreds would be too deep for the planner
            parts = [a + b for a, b in zip(parts[::2], parts[1::2], strict=False)] + parts[len(parts) - len(parts) % 2 :]
        total = parts[0]
        return 1.0 / (1.0 + F.exp(-total))

    def predict(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for weight, terms in self.rules:
            holds = np.ones(len(x), dtype=bool)
            for name, upper, bound in terms:
                v = x[:, names.index(name)]
                holds &= v <= bound if upper else v > bound
            total += weight * holds
        return 1 / (1 + np.exp(-total))


def _tree(x: np.ndarray, residual: np.ndarray, bounds: list[np.ndarray], rows: np.ndarray, depth: int, path: list, paths: list) -> list:
    """Grows one least-squares tree; leaves as (rows, mean). Appends the path of every node."""
    if path:
        paths.append(list(path))
    r = residual[rows]
    if depth == 0 or len(rows) < 40:
        return [(path, float(r.mean()) if len(rows) else 0.0)]
    best = (1e-9, None, None)
    for j, cuts in enumerate(bounds):
        if not len(cuts):
            continue
        bins = np.searchsorted(cuts, x[rows, j], side="left")
        n = np.cumsum(np.bincount(bins, minlength=len(cuts) + 1))[:-1]
        s = np.cumsum(np.bincount(bins, weights=r, minlength=len(cuts) + 1))[:-1]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = s**2 / n + (r.sum() - s) ** 2 / (len(rows) - n) - r.sum() ** 2 / len(rows)
        gain[(n < 20) | (len(rows) - n < 20)] = -1
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), j, float(cuts[k]))
    if best[1] is None:
        return [(path, float(r.mean()))]
    j, bound = best[1], best[2]
    left = x[rows, j] <= bound
    return _tree(x, residual, bounds, rows[left], depth - 1, [*path, (j, True, bound)], paths) + _tree(x, residual, bounds, rows[~left], depth - 1, [*path, (j, False, bound)], paths)


def _holds(x: np.ndarray, terms: list) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for j, upper, bound in terms:
        out &= x[:, j] <= bound if upper else x[:, j] > bound
    return out


def fit(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 60, depth: int = 3, penalty: float = 1e-3, seed: int = 11) -> RuleEnsemble:
    """Boosted trees -> rules -> lasso logistic weights by accelerated proximal gradient steps."""
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean(), 1e-4, 1 - 1e-4)) if len(y) else 0.5
        return RuleEnsemble(float(np.log(share / (1 - share))), [])
    rng = np.random.default_rng(seed)
    bounds = [np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, 33))) for j in range(x.shape[1])]
    f = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    found: dict[tuple, list] = {}
    for _ in range(trees):
        residual = y - 1 / (1 + np.exp(-f))
        rows = np.flatnonzero(rng.random(len(y)) < 0.5)
        if len(rows) < 2:
            rows = np.arange(len(y))
        paths: list = []
        leaves = _tree(x, residual, bounds, rows, depth, [], paths)
        for p in paths:
            found.setdefault(tuple(sorted(set(p))), list(dict.fromkeys(p)))
        for p, value in leaves:
            f[_holds(x, p)] += 0.8 * value / max(1e-3, float((y * (1 - y)).mean() or 0.1) + 0.1)
    rules, columns = [], []
    for p in found.values():
        h = _holds(x, p)
        if 0.002 <= h.mean() <= 0.998:
            rules.append(p)
            columns.append(h)
    if not rules:
        return RuleEnsemble(float(np.log(y.mean() / (1 - y.mean()))), [])
    r = np.column_stack(columns).astype(np.float32)
    w, b = np.zeros(r.shape[1], dtype=np.float32), float(np.log(y.mean() / (1 - y.mean())))
    v, vb, t = w.copy(), b, 1.0
    step = 4.0 / (float(np.linalg.norm(r[rng.permutation(len(r))[:4000]], 2) ** 2) * len(r) / min(len(r), 4000) / len(r) + 1)
    for _ in range(400):
        error = (1 / (1 + np.exp(-(r @ v + vb))) - y).astype(np.float32)
        new = v - step * (r.T @ error) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_b = vb - step * float(error.mean())
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t_new * (new - w), new_b + (t - 1) / t_new * (new_b - b)
        w, b, t = new, new_b, t_new
    kept = [(float(w[i]), [(names[j], u, c) for j, u, c in rules[i]]) for i in np.flatnonzero(np.abs(w) > 1e-3)]
    return RuleEnsemble(b, kept)


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality") -> RuleEnsemble:
    """Fits the ensemble on a bounded sample of the labelled rows outside the held-out fold.

    The sample is chosen by a hash of the id alone and taken in the order of ids, so that runs
    agree; of documents that share an id the one of the least statistics is taken.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", *FOLD)).groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    scale = 1 << 30
    count = known.count()
    if count > MAX_LABELLED:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < int(scale * MAX_LABELLED / count))
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "y", measured(F.col("text")).alias("s"))
    one = rows.groupBy("doc_id").agg(F.min(F.struct("s", "y")).alias("r"))
    sample = one.select("doc_id", "r.y", "r.s.*").toArrow().sort_by("doc_id")  # about MAX_LABELLED rows of numbers
    names = list(NAMES)
    x = np.column_stack([sample[n].to_numpy() for n in names]) if sample.num_rows else np.zeros((0, len(names)))
    return fit(x, np.asarray(sample["y"].to_numpy(), dtype=float), names)


def score(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """docs with ``score`` and ``predicted`` (int)."""
    scored = docs.withColumn("score", model.column(measured(F.col("text"))))
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def digest(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    return score(docs.select("doc_id", "text"), model).select("doc_id", held_out("doc_id", *FOLD).alias("held_out"), "score", "predicted")
