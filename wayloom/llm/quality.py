"""Quality classifier: a sparse rule ensemble compiled into Spark column expressions.

Shallow trees grown on statistics of labelled texts give conjunctive rules (one per node below a root); a logistic model
with an L1 penalty weighs the rules, and those with a weight become one Spark expression. Only the fit runs on the
driver, on a bounded sample of labelled rows; scoring is a projection over every text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Labelled rows that the fit uses at most: the lowest by a hash of doc_id.
SAMPLE_ROWS = 12_000
THRESHOLD = 0.3

# Character classes whose shares are statistics; each is removed from the text by one translate or regexp pass.
CLASSES = {"symbols": r"[^#$%&*@^~|\\<>{}=+_/]+", "upper": r"[^\p{Lu}]+", "digits": r"[^0-9]+", "marks": r"[^!?]+", "stops": r"[^.,;:]+", "bars": r"[^|]+"}


def statistics(text: Column) -> dict[str, Column]:
    """Name -> double column over a whole text; null counts as empty. Nothing but the text goes in."""
    text = F.coalesce(text, F.lit(""))
    n = F.length(text).cast("double")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n_words = F.size(words).cast("double")
    share = lambda count, of: F.when(of > 0, count.cast("double") / of).otherwise(0.0)
    out = {name: share(F.length(F.regexp_replace(text, keep, "")), n) for name, keep in CLASSES.items()}
    lines = F.size(F.split(text, "\n")).cast("double")
    return out | {
        "log_words": F.log1p(n_words),
        "word_length": share(n, n_words),
        "words_per_line": share(n_words, lines),
        "distinct": share(F.size(F.array_distinct(words)), n_words),
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction: statistic <= threshold (low) or > threshold, for each part."""

    parts: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, low, t in self.parts:
            out &= (x[:, f] <= t) if low else (x[:, f] > t)
        return out

    def column(self, names: list[str]) -> Column:
        out = None
        for f, low, t in self.parts:
            one = F.col(names[f]) <= F.lit(t) if low else F.col(names[f]) > F.lit(t)
            out = one if out is None else out & one
        return out


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, bins: int = 32) -> list[Rule]:
    """The rules of one tree: each split tries a random half of the statistics at quantiles and takes the best Gini gain."""
    rules: list[Rule] = []

    def split(rows: np.ndarray, parts: tuple) -> None:
        if len(parts) == depth or len(rows) < 20 or y[rows].min() == y[rows].max():
            return
        best = (1e-9, None)
        for f in rng.permutation(x.shape[1])[: max(1, (x.shape[1] + 1) // 2)]:
            v = x[rows, f]
            cuts = np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1]))
            low = v[:, None] <= cuts
            n, pos, total = low.sum(0), (low & (y[rows] > 0)[:, None]).sum(0), y[rows].sum()
            m, rest = len(rows) - n, total - pos
            ok = (n >= 10) & (m >= 10)
            gini = lambda a, b: 2 * a * (b - a) / np.maximum(b, 1)
            gain = np.where(ok, gini(total, len(rows)) - gini(pos, n) - gini(rest, m), -1)
            k = int(np.argmax(gain)) if len(gain) else 0
            if len(gain) and gain[k] > best[0]:
                above = v[v > cuts[k]].min()
                best = (gain[k], (int(f), float((cuts[k] + above) / 2)))
        if best[1]:
            f, t = best[1]
            for low in (True, False):
                own = (*parts, (f, low, t))
                rules.append(Rule(own))
                split(rows[(x[rows, f] <= t) == low], own)

    split(rng.integers(0, len(x), len(x)), ())
    return rules


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic weights under an L1 penalty, by accelerated proximal gradient; the intercept is free."""
    n, w, b = len(y), np.zeros(z.shape[1]), 0.0
    rate = 4.0 / (np.linalg.norm(z, 2) ** 2 / n + 1)
    v, c, t = w, b, 1.0
    for _ in range(steps):
        g = 1 / (1 + np.exp(-np.clip(z @ v + c, -40, 40))) - y
        step = v - rate * (z.T @ g) / n
        new_w, new_b, new_t = np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0), c - rate * g.mean(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new_w + (t - 1) / new_t * (new_w - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new_w, new_b, new_t
    return w, b


@dataclass(frozen=True)
class RuleModel:
    names: tuple[str, ...]
    rules: tuple[tuple[float, Rule], ...]
    intercept: float

    def score(self, prefix: str) -> Column:
        """Probability of label 1 over columns named prefix + statistic."""
        names = [prefix + n for n in self.names]
        total = F.lit(self.intercept)
        for weight, rule in self.rules:
            total = total + F.when(rule.column(names), F.lit(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def fit_rules(names: list[str], x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, penalty: float = 0.002, seed: int = 11) -> RuleModel:
    """Trees -> rules -> lasso. Without labelled rows the score is 0.5; with one class only, or too few rows for a rule, the
    smoothed share of label 1."""
    rng = np.random.default_rng(seed)
    mixed = len(y) and y.min() < y.max()
    rules = list(dict.fromkeys(r for _ in range(trees) for r in grow(x, y, rng, depth))) if mixed else []
    if not rules:
        p = (y.sum() + 1) / (len(y) + 2)
        return RuleModel(tuple(names), (), float(np.log(p / (1 - p))))
    z = np.stack([r.holds(x) for r in rules], axis=1).astype(float)
    _, first = np.unique(z, axis=1, return_index=True)  # rules that hold for the same rows
    rules, z = [rules[i] for i in sorted(first)], z[:, sorted(first)]
    w, b = lasso(z, y, penalty)
    kept = sorted(((float(a), r) for a, r in zip(w, rules, strict=True) if abs(a) > 1e-6), key=lambda p: -abs(p[0]))
    return RuleModel(tuple(names), tuple(kept), float(b))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> RuleModel:
    """Learns quality from labelled documents that are not held out.

    The sample is the sample_rows lowest by a hash of doc_id, so it is bounded and reruns agree; a doc_id labelled twice
    counts once, 1 if any label is. Its ids are few enough to be broadcast, so documents are not shuffled.
    """
    few = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    few = few.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    stats = statistics(F.col("text"))
    rows = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select(F.col("doc_id"), F.col("quality"), *[c.alias(n) for n, c in stats.items()])
    got = rows.groupBy("doc_id").agg(F.min(F.struct("quality", *stats)).alias("s")).select("doc_id", "s.*").toPandas().sort_values("doc_id")
    return fit_rules(list(stats), got[list(stats)].to_numpy(float), got["quality"].to_numpy(float))


def score_quality(docs: DataFrame, model: RuleModel, score: str = "score") -> DataFrame:
    """docs and the score in (0, 1), higher: label 1 likelier. Null and empty texts get the score of an empty text.

    Statistics live in columns with a prefix of their own and are dropped, so other columns pass unchanged. A filter on
    the score would be pushed below the statistics, which every rule would then compute anew; it stays above a row number,
    as that isn't deterministic. The score takes the number in without a change, else it would be pruned. A column named
    like the score is replaced.
    """
    prefix = "_stat_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    stats = statistics(F.col("text"))
    held = docs.select("*", *[c.alias(prefix + n) for n, c in stats.items()], F.monotonically_increasing_id().alias(prefix + "row"))
    value = F.when(F.col(prefix + "row") >= 0, model.score(prefix))
    return held.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != score.lower()], value.alias(score))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
