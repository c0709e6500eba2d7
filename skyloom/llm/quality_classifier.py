"""Quality classifier: a sparse rule ensemble, compiled into Spark columns.

Small boosted trees are grown over statistics of the texts; each path from a
root to a node is a conjunctive rule; a lasso logistic regression keeps few of
the rules.  The model is a list of (conditions, weight) and an intercept, and
scoring is one SQL expression over the statistics: no Python on the executors.

Training uses at most ``SAMPLE`` labelled rows, those with the smallest hashes
of their ids, whatever the table's size; everything else covers all rows.

Edge cases: null labels and labels of unknown documents are not learned from;
a document with several labels counts as 1 if their mean is at least 0.5;
without labels, or with one class only, the score is the prior (0.5 without
any); null and empty texts have all statistics 0 and are scored like any text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import count_chars, stored, table, words

SAMPLE = 20_000
TREES, DEPTH, RATE, BINS, LEAST = 24, 3, 0.2, 32, 20
PENALTY = 0.002
STEPS = 400
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0

STATISTICS = ("log_words", "word_length", "symbols", "upper", "digits", "stops", "exclaims", "bars", "lines", "distinct", "longest", "spaces", "vowels", "repeats")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``STATISTICS`` of each text, from built-in functions in one pass."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    first = docs.select(F.col(id_col).alias("doc_id"), text.alias("_t"), words(F.col(text_col)).alias("_w"))
    second = first.select("doc_id", "_t", F.size("_w").alias("_n"), F.size(F.array_distinct("_w")).alias("_d"), F.col("_w"))
    n, chars = F.greatest(F.col("_n"), F.lit(1)), F.greatest(F.length("_t"), F.lit(1))
    count = lambda s: count_chars(F.col("_t"), s)
    return second.select(
        "doc_id",
        F.log1p(F.col("_n")).alias("log_words"),
        ((F.length("_t") - count(" \t\n\x0b\x0c\r")) / n).alias("word_length"),
        (count("#*$%&|<>@=_{}[]\\^~") / n).alias("symbols"),
        (count("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / chars).alias("upper"),
        (count("0123456789") / chars).alias("digits"),
        (count(".,;:?") / n).alias("stops"),
        (count("!") / n).alias("exclaims"),
        (count("|") / n).alias("bars"),
        (count("\n") / n).alias("lines"),
        (F.col("_d") / n).alias("distinct"),
        F.coalesce(F.array_max(F.transform("_w", F.length)), F.lit(0)).cast("double").alias("longest"),
        (count(" ") / chars).alias("spaces"),
        (count("aeiou") / chars).alias("vowels"),
        (F.log1p(F.col("_n")) * (1 - F.col("_d") / n)).alias("repeats"),
    )


def in_fold(id_col: str = "doc_id") -> Column:
    """The row's remainder by crc32 of its id as text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


@dataclass(frozen=True)
class Rule:
    """Conditions are (statistic, is at most?, value)."""

    conditions: tuple[tuple[str, bool, float], ...]
    weight: float


@dataclass(frozen=True)
class Model:
    rules: tuple[Rule, ...]
    intercept: float

    def column(self) -> Column:
        z = F.lit(float(self.intercept))
        for r in self.rules:
            test = F.lit(True)
            for name, at_most, value in r.conditions:
                c = F.col(name)
                test = test & ((c <= value) if at_most else (c > value))
            z = z + F.when(test, F.lit(float(r.weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    def text(self) -> list[str]:
        return [f"{r.weight:+.3f}  " + " and ".join(f"{n} {'<=' if m else '>'} {v:.4g}" for n, m, v in r.conditions) for r in self.rules]


def grow(codes: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray, depth: int):
    """One regression tree on binned statistics: paths (conditions as (column, at most?, cut)) of all its nodes, and the fitted values."""
    paths, fit = [], np.zeros(len(gradient))

    def node(rows: np.ndarray, path: tuple, left: int) -> None:
        g, h = gradient[rows].sum(), hessian[rows].sum()
        best = (1e-6, None)
        if left and len(rows) >= 2 * LEAST:
            for j in range(codes.shape[1]):
                gs = np.cumsum(np.bincount(codes[rows, j], gradient[rows], len(cuts[j]) + 1))[:-1]
                hs = np.cumsum(np.bincount(codes[rows, j], hessian[rows], len(cuts[j]) + 1))[:-1]
                ns = np.cumsum(np.bincount(codes[rows, j], minlength=len(cuts[j]) + 1))[:-1]
                gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                gain[(ns < LEAST) | (len(rows) - ns < LEAST)] = 0
                if len(gain) and gain.max() > best[0]:
                    best = (float(gain.max()), (j, int(gain.argmax())))
        if best[1] is None:
            fit[rows] = g / (h + 1)
            return
        j, c = best[1]
        low = codes[rows, j] <= c
        for at_most, part in ((True, rows[low]), (False, rows[~low])):
            own = (*path, (j, at_most, c))
            paths.append(own)
            node(part, own, left - 1)

    node(np.arange(len(gradient)), (), depth)
    return paths, fit


def lasso(x: np.ndarray, y: np.ndarray, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Logistic regression with an absolute penalty on the weights (not the intercept), by accelerated proximal gradient."""
    n, k = x.shape
    z = np.hstack([x, np.ones((n, 1))])
    v = np.full(k + 1, 1.0)
    for _ in range(30):  # largest eigenvalue
        v = z.T @ (z @ v)
        v /= np.linalg.norm(v)
    rate = 4 * n / np.linalg.norm(z.T @ (z @ v))
    w = last = np.zeros(k + 1)
    for t in range(1, steps + 1):
        at = w + (t - 1) / (t + 2) * (w - last)
        last = w
        w = at - rate * (z.T @ (1 / (1 + np.exp(-np.clip(z @ at, -30, 30))) - y)) / n
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - rate * penalty, 0)
    return w[:-1], float(w[-1])


def fit(x: np.ndarray, y: np.ndarray, names: tuple[str, ...] = STATISTICS) -> Model:
    """The rule ensemble for statistics ``x`` (rows by names) and labels ``y`` (0 or 1)."""
    if not len(y):
        return Model((), 0.0)
    share = float(np.clip(y.mean(), 0.5 / (len(y) + 1), 1 - 0.5 / (len(y) + 1)))
    prior = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return Model((), prior)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    codes = np.stack([np.searchsorted(q, c, "left") for q, c in zip(cuts, x.T)], 1)
    score, rules = np.full(len(y), prior), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        paths, values = grow(codes, cuts, y - p, p * (1 - p), DEPTH)
        score += RATE * values
        rules.update(dict.fromkeys(paths))
    rules = list(rules)
    matrix = np.ones((len(y), len(rules)))
    for k, path in enumerate(rules):
        for j, at_most, c in path:
            matrix[:, k] *= codes[:, j] <= c if at_most else codes[:, j] > c
    weights, intercept = lasso(matrix, y, PENALTY, STEPS)
    return Model(tuple(
        Rule(tuple((names[j], at_most, float(cuts[j][c])) for j, at_most, c in path), float(w)) for path, w in zip(rules, weights) if abs(w) > 1e-6), intercept)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from labels (doc_id, quality) outside the held-out fold."""
    own = labels.where("doc_id is not null and quality is not null").where(in_fold() != HELD_OUT)
    own = own.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("_y"))
    own = stored(own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "sample")  # at most ``sample`` ids
    rows = statistics(docs.select("doc_id", "text").join(F.broadcast(own.select("doc_id")), "doc_id")).groupBy("doc_id").agg(F.min(F.struct(*STATISTICS)).alias("s"))  # of repeated ids one
    rows = rows.join(F.broadcast(own), "doc_id").select("_y", "s.*")
    got = np.array([tuple(r) for r in rows.collect()], float).reshape(-1, 1 + len(STATISTICS))
    got = got[np.lexsort(got.T)]  # the same order on every run
    return fit(got[:, 1:], got[:, 0])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    rows = statistics(docs).select("doc_id", (in_fold() == HELD_OUT).alias("held_out"), model.column().alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, train(docs, table(spark, sf_dir, "labels")))
