"""Quality classifier: a sparse rule ensemble over text statistics.

Small regression trees on bootstrap samples give their root-to-node paths as conjunctive rules; a lasso
logistic fit weighs the rules and drops most; what is left is compiled into one Spark column expression.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import chance, held_out, read


def statistics() -> dict[str, Column]:
    """Statistics of a text as columns of ``words`` and ``text``; null text is empty. No label, language, source or id is used."""
    t, words = F.col("text"), F.col("words")
    n = F.greatest(F.length(t), F.lit(1))
    w = F.greatest(F.size(words), F.lit(1))
    share = lambda pattern: F.regexp_count(t, F.lit(pattern)) / n
    return {
        "log_chars": F.log1p(F.length(t).cast("double")),
        "log_words": F.log1p(F.size(words).cast("double")),
        "mean_word": F.length(t) / w,
        "distinct": F.size(F.array_distinct(words)) / w,
        "upper": share(r"\p{Lu}"),
        "digit": share("[0-9]"),
        "stop": share(r"[.,;:?]"),
        "odd": share(r"[^\p{L}\p{N}\s.,;:?'!|-]"),
        "bang": share("!"),
        "bar": share(r"\|"),
        "newline": share("\n"),
        "echo": F.regexp_count(t, F.lit(r"(?<!\S)(\S+)\s+\1(?!\S)")) / w,
    }


NAMES = ["log_chars", "log_words", "mean_word", "distinct", "upper", "digit", "stop", "odd", "bang", "bar", "newline", "echo"]


def with_statistics(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` and the statistics of every whole text, as columns s_<name>.

    A null text is an empty one, whose shares are 0; a text may be of any length; equal texts have equal statistics, repeated rows
    a row each; an empty table gives no rows. Input columns of any name are fine, as only ``keep`` and the text are read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(*keep, text.alias("text"), F.array_remove(F.split(text, r"\s+"), "").alias("words"))
    return rows.select(*keep, *[c.alias(f"s_{k}") for k, c in statistics().items()])


def grow(x: np.ndarray, y: np.ndarray, rng, depth: int, path: tuple = ()) -> list[tuple]:
    """Rules (tuples of (feature, is_above, threshold)) of a tree's nodes, the root left out."""
    rules = [path] if path else []
    if depth == 0 or len(y) < 20 or y.min() == y.max():
        return rules
    best = None
    for f in rng.choice(x.shape[1], size=max(2, x.shape[1] // 2), replace=False):
        for c in np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 33))):
            right = x[:, f] > c
            k = int(right.sum())
            if 5 <= k <= len(y) - 5:
                gain = k * y[right].mean() ** 2 + (len(y) - k) * y[~right].mean() ** 2
                if best is None or gain > best[0]:
                    best = (gain, int(f), float(c), right)
    if best is None:
        return rules
    _, f, c, right = best
    return rules + grow(x[~right], y[~right], rng, depth - 1, (*path, (f, False, c))) + grow(x[right], y[right], rng, depth - 1, (*path, (f, True, c)))


def holds(x: np.ndarray, rule: tuple) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, above, c in rule:
        out &= (x[:, f] > c) == above
    return out


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Logistic weights with an L1 penalty, by accelerated proximal gradient; the intercept is free."""
    n, m = z.shape
    a = np.hstack([np.ones((n, 1)), z])
    v = np.ones(m + 1)
    for _ in range(30):  # the largest eigenvalue sets the step
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v) or 1.0
    step = 4 * n / max(1e-9, float(np.linalg.norm(a.T @ (a @ v))))
    b = look = np.zeros(m + 1)
    t = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ look, -30, 30)))
        new = look - step * (a.T @ (p - y)) / n
        new[1:] = np.sign(new[1:]) * np.maximum(0, np.abs(new[1:]) - step * penalty)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, b, t = new + (t - 1) / t2 * (new - b), new, t2
    return float(b[0]), b[1:]


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, penalty: float = 0.002, seed: int = 7) -> dict:
    """Rules and weights from statistics ``x`` (rows by NAMES) and labels ``y`` in 0, 1.

    Without rows the score is 0.5 everywhere; with one class alone it is that class's smoothed share. Of splits with equal gain the first drawn wins,
    and of rules that hold for the same rows the first grown; both follow from ``seed`` and the order of the rows.
    """
    prior = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(prior / (1 - prior)))
    if len(y) == 0 or y.min() == y.max():
        return {"base": base, "rules": []}
    rng, rules = np.random.default_rng(seed), {}
    for _ in range(trees):
        at = rng.choice(len(y), size=min(len(y), 4000))
        for rule in grow(x[at], y[at].astype(float), rng, depth):
            z = holds(x, rule)
            if 0 < z.sum() < len(y):
                rules.setdefault(z.tobytes(), rule)  # rules that hold for the same rows count once
    rules = list(rules.values())
    z = np.stack([holds(x, r) for r in rules], axis=1).astype(float) if rules else np.zeros((len(y), 0))
    base, weights = lasso(z, y.astype(float), penalty)
    return {"base": base, "rules": [(r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-6]}


def compiled(model: dict) -> Column:
    """The ensemble as a column over the statistics: a logistic score from 0 to 1."""
    total = F.lit(model["base"])
    for rule, weight in model["rules"]:
        test = F.lit(True)
        for f, above, c in rule:
            s = F.col(f"s_{NAMES[f]}")
            test = test & ((s > c) if above else (s <= c))
        total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, **options) -> dict:
    """Fit on labelled rows; about ``max_rows`` of them, chosen by a hash of the id, bound the sample.

    Null labels and ids, and labels of no document, are ignored; an id labelled both ways counts with each label, and a repeated document with each row.
    An empty table gives the model that scores 0.5 everywhere. Rows are put in the order of their statistics, so equal tables give equal models.
    """
    labels = labels.where("quality in (0, 1)").select("doc_id", "quality").distinct()
    n = labels.count()
    if n > max_rows:
        labels = labels.where(chance("doc_id") < max_rows / n)
    rows = docs.select("doc_id", "text").join(F.broadcast(labels), "doc_id")
    got = with_statistics(rows, ["quality"]).toArrow()
    x = np.stack([got.column(f"s_{k}").to_numpy() for k in NAMES], axis=1).astype(float) if got.num_rows else np.zeros((0, len(NAMES)))
    y = got.column("quality").to_numpy().astype(int) if got.num_rows else np.zeros(0, int)
    order = np.lexsort([*x.T, y])  # rows come in any order; the fit must not depend on it
    return fit(x[order], y[order], **options)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; labels are learnt from rows that are not held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read(spark, sf_dir, "labels").where(~held_out("doc_id")))
    scored = with_statistics(docs, ["doc_id"]).select("doc_id", held_out("doc_id").alias("held_out"), compiled(model).alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
