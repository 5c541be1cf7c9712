"""Quality classifier: a sparse rule ensemble over text statistics, scored by Spark columns."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photolake.llm.samples import labelled_sample
from photolake.llm.tables import fold, table

#: Characters that are counted one by one.
MARKS = {"bar": "|", "bang": "!", "hash": "#", "dollar": "$", "percent": "%", "and": "&", "star": "*", "stop": ".", "comma": ","}


class Condition(NamedTuple):
    name: str
    above: bool
    cut: float


class Rules(NamedTuple):
    """Conjunctions of conditions with their weights, and what every text starts from."""

    start: float
    rules: list[tuple[list[Condition], float]]


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and a number for each statistic of the whole text; never null or infinite.

    Null texts count as empty. Built-in functions only, in one narrow pass.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    raw = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    t = F.col("text")
    without = lambda c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    counted = raw.select(
        "doc_id",
        F.length(t).alias("chars"),
        F.split(t, "[ \\n\\t]+").alias("words"),
        F.split(t, "\\n").alias("lines"),
        (F.length(t) - F.length(F.translate(t, upper, ""))).alias("upper"),
        *(without(c).alias(f"n_{k}") for k, c in MARKS.items()),
    )
    sized = counted.select("*", F.size("words").alias("n_words"), F.size(F.array_distinct("words")).alias("n_different"), F.size("lines").alias("n_lines"), F.size(F.array_distinct("lines")).alias("n_different_lines")).drop("words", "lines")
    chars, words, lines = (F.greatest(F.col(c), F.lit(1)).cast("double") for c in ("chars", "n_words", "n_lines"))
    return sized.select(
        "doc_id",
        F.log(chars).alias("log_chars"),
        (chars / words).alias("word_length"),
        (chars / lines).alias("line_length"),
        (F.col("n_different") / words).alias("different_words"),
        (F.log(F.greatest(F.col("n_different"), F.lit(1)).cast("double")) / F.log(words + 1)).alias("word_growth"),
        (F.col("n_different_lines") / lines).alias("different_lines"),
        (F.col("upper") / chars).alias("upper_share"),
        *((F.col(f"n_{k}") / words).alias(f"{k}_share") for k in MARKS),
    )


def _names() -> list[str]:
    return ["log_chars", "word_length", "line_length", "different_words", "word_growth", "different_lines", "upper_share", *(f"{k}_share" for k in MARKS)]


def _tree(x: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, features: np.ndarray, depth: int, path: tuple, least: int, out: list) -> np.ndarray:
    """Grow one tree on gradients by second-order gain; its paths go to ``out``, its values are returned."""
    value = np.zeros(len(x))
    total_g, total_h = g[rows].sum(), h[rows].sum()
    best = (1e-6, None)
    if depth and len(rows) >= 2 * least:
        for f in features:
            place = np.searchsorted(cuts[f], x[rows, f], "left")
            n = np.bincount(place, minlength=len(cuts[f]) + 1)
            gs, hs = (np.bincount(place, w[rows], minlength=len(n)) for w in (g, h))
            left_n, left_g, left_h = np.cumsum(n)[:-1], np.cumsum(gs)[:-1], np.cumsum(hs)[:-1]
            gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
            gain[(left_n < least) | (len(rows) - left_n < least)] = 0
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), (f, int(gain.argmax())))
    if best[1] is None:
        value[rows] = -total_g / (total_h + 1)
        return value
    f, i = best[1]
    above = x[rows, f] > cuts[f][i]
    for side, part in ((False, rows[~above]), (True, rows[above])):
        here = (*path, (int(f), side, float(cuts[f][i])))
        out.append(here)
        value += _tree(x, cuts, g, h, part, features, depth - 1, here, least, out)
    return value


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, seed: int = 3) -> list[tuple]:
    """Paths of boosted trees, each over a random half of the statistics, as sorted conjunctions."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(c, np.linspace(0.02, 0.98, 49))) for c in x.T]
    z = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    found: dict = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        paths: list = []
        z += rate * _tree(x, cuts, p - y, p * (1 - p), np.arange(len(y)), rng.permutation(x.shape[1])[: (x.shape[1] + 1) // 2], depth, (), max(5, len(y) // 200), paths)
        for path in paths:
            found.setdefault(tuple(sorted(set(path))))
    return list(found)


def _holds(x: np.ndarray, path: tuple) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, above, cut in path:
        out &= (x[:, f] > cut) == above
    return out


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float = 0.001, rounds: int = 300) -> tuple[float, np.ndarray]:
    """Weights with a small sum of absolute values by accelerated proximal gradient steps."""
    a = np.concatenate([np.ones((len(r), 1)), r], 1).astype(np.float64)
    w = np.zeros(a.shape[1])
    w[0] = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    v = np.ones(a.shape[1])
    for _ in range(20):  # the largest curvature by power iteration
        v = a.T @ (a @ v)
        norm = np.linalg.norm(v)
        v /= norm
    step = 4 * len(y) / norm
    ahead, t = w.copy(), 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ ahead, -30, 30)))
        new = ahead - step * (a.T @ (p - y)) / len(y)
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / later * (new - w), new, later
    return float(w[0]), w[1:]


def train(x: np.ndarray, y: np.ndarray, penalty: float = 0.001) -> Rules:
    """Rules and weights; the share of labels alone where only one label is known."""
    if len(y) == 0:
        return Rules(0.0, [])
    if y.min() == y.max():
        return Rules(4.0 if y[0] else -4.0, [])
    paths = tree_rules(x, y)
    if not paths:
        return Rules(float(np.log(y.mean() / (1 - y.mean()))), [])
    start, weights = lasso_logistic(np.stack([_holds(x, p) for p in paths], 1), y, penalty)
    names = _names()
    kept = [([Condition(names[f], above, cut) for f, above, cut in p], float(w)) for p, w in zip(paths, weights) if abs(w) > 1e-3]
    return Rules(start, kept)


def compiled(model: Rules) -> Column:
    """The score from 0 to 1 as one expression over the columns of :func:`statistics`."""
    total = F.lit(model.start)
    for conditions, weight in model.rules:
        holds = F.lit(True)
        for c in conditions:
            holds = holds & (F.col(c.name) > c.cut if c.above else F.col(c.name) <= c.cut)
        total = total + F.when(holds, F.lit(weight)).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, max_rows: int = 20_000, label_col: str = "quality") -> Rules:
    """Rules from the statistics of at most ``max_rows`` labelled documents."""
    sample = labelled_sample(docs, labels, label_col, learn, max_rows)
    rows = statistics(sample).join(sample.select(F.col("doc_id"), "label", "place"), "doc_id").orderBy("place").select(*_names(), "label").toPandas()
    return train(rows[_names()].to_numpy(np.float64), rows["label"].to_numpy(np.float64))


def score(docs: DataFrame, model: Rules, cut: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` of every row: no shuffle, no Python.

    Null and empty texts are scored by the statistics of an empty text, texts of any length by those of
    the whole; a value equal to a rule's cut is not above it. Repeated rows and null ids give a row
    each; other columns are not read, whatever their names; an empty table gives no rows. Without
    labels to learn from all scores are 0.5.
    """
    s = statistics(docs, id_col, text_col).select("doc_id", compiled(model).alias("score"))
    return s.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from labelled rows outside the fold."""
    docs, held = table(spark, sf_dir, "documents"), fold("doc_id") % 4 == 2
    model = fit(docs, table(spark, sf_dir, "labels"), ~held)
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")
