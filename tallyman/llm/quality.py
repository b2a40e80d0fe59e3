"""Quality classifier: a sparse ensemble of rules over text statistics.

1. Statistics of each whole text are Spark columns (``STATISTICS``).
2. Boosted regression trees are grown on a bounded labelled sample; each path
   from a root becomes a conjunctive rule.
3. A lasso-penalised logistic regression keeps a few of the rules.
4. The kept rules compile into one Spark column expression: scoring is a
   projection, without Python, shuffle or model files.

Defined results for edge cases
* null text: as empty; empty texts get the score of their (all zero) statistics;
* null ``doc_id``: scored, not held out, never learned from;
* null labels and labels without a document are not learned from; of several
  labels of one document the highest counts; repeated rows are scored each;
* no usable label: every score 0.5; labels of one kind only: 0.99 or 0.01;
* extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyman.llm.common import held_out, pick

#: Bound of the labelled sample (rows whose hashed ids are smallest).
SAMPLE_ROWS = 20_000
SAMPLE_SEED = 17
TREES, DEPTH, BINS, RATE, LEAST_ROWS = 30, 3, 64, 0.3, 20
PENALTY, ROUNDS = 0.0008, 400
THRESHOLD = 0.3


def statistics(text: Column) -> dict[str, Column]:
    """Numbers about a text; shares are 0 for a text without the thing shared."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)

    def share(part: Column, whole: Column) -> Column:
        return F.coalesce(part.cast("double") / F.nullif(whole, F.lit(0)), F.lit(0.0))

    def chars(of: str) -> Column:
        return share(n - F.length(F.translate(t, of, "")), n)

    words = F.split(F.trim(t), r"\s+")
    n_words = F.when(n > 0, F.size(words)).otherwise(0)
    lines = F.split(t, "\n")
    return {
        "log_chars": F.log1p(n.cast("double")),
        "word_length": share(n, n_words),
        "distinct_words": share(F.size(F.array_distinct(words)), n_words),
        "log_distinct_words": F.log1p(F.size(F.array_distinct(words)).cast("double")),
        "distinct_lines": share(F.size(F.array_distinct(lines)), F.size(lines)),
        "line_length": share(n, F.size(lines)),
        "upper": share(n - F.length(F.regexp_replace(t, r"\p{Lu}", "")), n),
        "symbols": chars("#$%&*@^~_=+<>{}[]\\"),
        "bars": chars("|"),
        "exclamations": chars("!"),
        "digits": chars("0123456789"),
        "periods": chars("."),
        "commas": chars(","),
        "blanks": chars(" "),
    }


STATISTICS = ("log_chars", "word_length", "distinct_words", "log_distinct_words", "distinct_lines", "line_length", "upper",
              "symbols", "bars", "exclamations", "digits", "periods", "commas", "blanks")


@dataclass(frozen=True)
class Rule:
    """A conjunction: every (statistic, is_above, threshold) holds."""

    conditions: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, above, at in self.conditions:
            out &= (x[:, f] > at) if above else (x[:, f] <= at)
        return out

    def column(self, names: tuple[str, ...]) -> Column:
        out = F.lit(True)
        for f, above, at in self.conditions:
            c = F.col(names[f])
            out = out & ((c > at) if above else (c <= at))
        return out

    def simple(self) -> "Rule":
        """Without conditions that another one implies, in a fixed order."""
        best: dict[tuple[int, bool], float] = {}
        for f, above, at in self.conditions:
            best[f, above] = max(at, best.get((f, above), at)) if above else min(at, best.get((f, above), at))
        return Rule(tuple((f, above, at) for (f, above), at in sorted(best.items())))


@dataclass(frozen=True)
class Model:
    intercept: float
    weighted: tuple[tuple[Rule, float], ...]

    def score(self, names: tuple[str, ...] = STATISTICS) -> Column:
        total = F.lit(self.intercept)
        for rule, w in self.weighted:
            total = total + F.when(rule.column(names), F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> list[Rule]:
    """The paths of boosted regression trees over binned statistics."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    z, rules = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), {}

    def grow(rows: np.ndarray, path: tuple, level: int, g: np.ndarray, h: np.ndarray) -> None:
        best = (1e-9, 0, 0)
        if level < depth and len(rows) >= 2 * LEAST_ROWS:
            total_g, total_h = g[rows].sum(), h[rows].sum()
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                b = binned[rows, f]
                n = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
                left_g = np.cumsum(np.bincount(b, g[rows], len(c) + 1))[:-1]
                left_h = np.cumsum(np.bincount(b, h[rows], len(c) + 1))[:-1]
                gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
                gain[(n < LEAST_ROWS) | (len(rows) - n < LEAST_ROWS)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, k)
        if best[0] <= 1e-9:
            z[rows] += RATE * g[rows].sum() / (h[rows].sum() + 1)
            return
        _, f, k = best
        below = binned[rows, f] <= k
        for above, part in ((False, rows[below]), (True, rows[~below])):
            longer = (*path, (f, above, float(cuts[f][k])))
            rules[Rule(longer).simple()] = None
            grow(part, longer, level + 1, g, h)

    for _ in range(trees):
        p = _sigmoid(z)
        grow(np.arange(len(y)), (), 0, y - p, p * (1 - p))
    return list(rules)


def lasso_logistic(m: np.ndarray, y: np.ndarray, penalty: float = PENALTY, rounds: int = ROUNDS) -> tuple[float, np.ndarray]:
    """Intercept and weights that minimise mean log loss + penalty × Σ|weight|, by
    accelerated proximal gradient steps; the intercept, which stands for the first column
    of ``m`` (ones), is not penalised."""
    a, y = m, y.astype(m.dtype)
    n, k = m.shape[0], m.shape[1] - 1
    v = np.ones(k + 1, m.dtype)
    for _ in range(20):  # the largest eigenvalue of the Gram matrix bounds the curvature
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    step = 4 * n / float(v @ (a.T @ (a @ v)))
    w = np.zeros(k + 1, m.dtype)
    w[0] = np.log(y.mean() / (1 - y.mean()))
    ahead, t = w, 1.0
    for _ in range(rounds):
        new = (ahead - step * (a.T @ (_sigmoid(a @ ahead) - y)) / n).astype(m.dtype)
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = (new + (t - 1) / t2 * (new - w)).astype(m.dtype), new, t2
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    if not len(y):
        return Model(0.0, ())
    if y.min() == y.max():
        return Model(float(np.log(0.99 / 0.01)) * (1 if y[0] else -1), ())
    rules = tree_rules(x, y)
    if not rules:
        return Model(float(np.log(y.mean() / (1 - y.mean()))), ())
    # of rules that hold for the same rows, one; one matrix of single precision, as the driver is small
    distinct: dict[bytes, Rule] = {}
    for r in rules:
        distinct.setdefault(np.packbits(r.holds(x)).tobytes(), r)
    kept = list(distinct.values())
    distinct.clear()
    m = np.ones((len(y), len(kept) + 1), np.float32)
    for j, r in enumerate(kept, 1):
        m[:, j] = r.holds(x)
    intercept, weights = lasso_logistic(m, y)
    return Model(intercept, tuple((r, float(w)) for r, w in zip(kept, weights) if abs(w) > 1e-6))


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from at most ``sample_rows`` labelled documents that are not held out.
    ``docs`` has doc_id and text, ``labels`` doc_id and label."""
    chosen = (labels.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.max("label").alias("label"))
              .orderBy(F.xxhash64("doc_id", F.lit(SAMPLE_SEED)), "doc_id").limit(sample_rows))
    # at most sample_rows ids: the bound of this broadcast
    rows = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text").withColumns(statistics(F.col("text")))
    rows = rows.groupBy("doc_id").agg(F.max_by(F.struct("label", *STATISTICS), F.xxhash64("text")).alias("r"))
    got = rows.orderBy("doc_id").select("r.*").toPandas()
    return fit(got[list(STATISTICS)].to_numpy(float), (got["label"].to_numpy(float) > 0.5).astype(float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (doc_id, text) with held_out, score and predicted."""
    d = docs.select("doc_id", "text").withColumns(statistics(F.col("text")))
    d = d.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), model.score().alias("score"))
    return d.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def accepted(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, with all their columns.

    The statistics pass through a generator of one row: the optimizer would move a filter on
    a projection's columns below it, with a copy of each statistic's expression for each rule."""
    numbers = F.array(F.struct(*[c.alias(name) for name, c in statistics(F.col(f"`{text}`")).items()]))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), numbers.alias("numbers"))
    return rows.select("row", F.inline_outer("numbers")).where(model.score() >= threshold).select("row.*")


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    rows = pick(docs, doc_id=doc_id, text=text)
    return score(rows, learn(rows, pick(labels, doc_id="doc_id", label=label)))
