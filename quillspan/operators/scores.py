"""Propensity scores by sums alone, support curves of scores, and a random-intercept model from sums a unit."""

from __future__ import annotations

from math import exp, log, pi

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import stored, work_folder


def standardised(df: DataFrame, covariates: list[str], over: DataFrame | None = None) -> DataFrame:
    """``covariates`` less their mean and over their deviation (of ``over``, or of the rows themselves); a null, or a constant column, is 0."""
    stats = (over or df).agg(*[f(c).alias(f"_{n}_{c}") for c in covariates for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    z = {c: F.coalesce(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.nullif(F.col(f"_s_{c}"), F.lit(0.0))), F.lit(0.0)) for c in covariates}
    return df.crossJoin(F.broadcast(stats)).withColumns(z).drop(*[f"_{n}_{c}" for c in covariates for n in "ms"])


def _solved(k: int, penalty: float):
    """A pandas function that adds to each stratum its Newton step of the ridge logit; the intercept, first, is not shrunk."""
    ridge, up = np.eye(k) * penalty, np.triu_indices(k)
    ridge[0, 0] = 0

    def step(batches):
        for pdf in batches:
            b, g, v = (np.stack(pdf[c].to_numpy()).astype(float) for c in ("_b", "_g", "_h"))
            h = np.zeros((len(pdf), k, k))
            h[:, up[0], up[1]] = v
            h = h + np.triu(h, 1).transpose(0, 2, 1) + ridge + 1e-12 * np.eye(k)
            move = np.linalg.solve(h, (g - b @ ridge)[..., None])[..., 0]
            move = np.clip(move, -5, 5)
            out = pdf.drop(columns=["_g", "_h"])
            out["_b"], out["_moved"] = list(b + move), np.abs(move).max(axis=1)
            yield out

    return step


def propensity(df: DataFrame, covariates: list[str], by: list[str], penalty: float = 1.0, rounds: int = 30) -> DataFrame:
    """(question_id, score): ridge logistic score of ``treated`` in each stratum on globally standardised covariates; one-class strata are left out.

    A round sums each stratum's gradient and information where its rows lie, with partial sums first, and solves them a stratum a row; coefficients are a written table that is
    joined back, so that no stratum is a task, however many rows it has. Rounds end when no coefficient moves by 1e-10.
    """
    spark, folder = df.sparkSession, work_folder(df.sparkSession)
    k = 1 + len(covariates)
    z = stored(standardised(df, covariates).select(F.struct(*by).alias("_s"), "question_id", F.col("treated").cast("double").alias("_y"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(covariates, 1)]), folder, "standardised")
    sizes = z.groupBy("_s").agg(F.count("*").alias("n"), F.sum("_y").alias("t")).where("t > 0 AND t < n")
    coef = stored(sizes.select("_s", F.array(*[F.lit(0.0)] * k).alias("_b")), folder, "coefficients-0")
    x = [F.lit(1.0), *[F.col(f"_x{i}") for i in range(1, k)]]
    eta = sum((c * F.col("_b")[i] for i, c in enumerate(x)), F.lit(0.0))
    fitted = lambda c: z.join(c.select(F.col("_s").alias("_c"), "_b"), F.col("_s").eqNullSafe(F.col("_c"))).withColumn("_p", 1 / (1 + F.exp(-eta)))
    w = F.col("_p") * (1 - F.col("_p"))
    keys = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by), "_b array<double>", "_moved double"])
    for r in range(1, rounds + 1):
        g = F.array(*[F.sum(c * (F.col("_y") - F.col("_p"))) for c in x]).alias("_g")
        h = F.array(*[F.sum(w * x[i] * x[j]) for i in range(k) for j in range(i, k)]).alias("_h")
        sums = fitted(coef).groupBy("_s", "_b").agg(g, h)
        solved = sums.select(*[F.col(f"_s.{c}").alias(c) for c in by], "_b", "_g", "_h").mapInPandas(_solved(k, penalty), keys)
        coef = stored(solved.select(F.struct(*by).alias("_s"), "_b", "_moved"), folder, f"coefficients-{r}")
        moved = coef.agg(F.max("_moved")).first()[0]
        if moved is None or moved < 1e-10:
            break
    return fitted(coef).select("question_id", F.col("_p").alias("score"))


def support_curves(scores: DataFrame, bins: int = 4096, points: int = 200, cut: float = 3.0) -> DataFrame:
    """(curve, point, score, density): Gaussian kernel densities of scores in [0, 1] by curve, on ``points`` places from the least score to the largest and ``cut`` widths beyond.

    The width is n^(-1/5) deviations (Scott's rule). Scores are counted in ``bins`` cells first and each cell stands at its middle, so the convolution sees at most
    ``bins`` rows a curve. Curves with fewer than two scores or without spread have no rows; null scores do not count.
    """
    s = scores.where("score IS NOT NULL")
    stats = s.groupBy("curve").agg(F.count("*").alias("n"), F.stddev_samp("score").alias("sd"), F.min("score").alias("lo"), F.max("score").alias("hi")).where("sd > 0").withColumn("h", F.col("sd") * F.pow(F.col("n"), F.lit(-0.2)))
    cells = s.groupBy("curve", F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("c")).withColumn("x", (F.col("bin") + 0.5) / bins)
    lo, hi = F.col("lo") - cut * F.col("h"), F.col("hi") + cut * F.col("h")
    grid = stats.select("curve", "n", "h", lo.alias("a"), ((hi - lo) / (points - 1)).alias("d"), F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point")).withColumn("at", F.col("a") + F.col("point") * F.col("d"))
    z = (F.col("at") - F.col("x")) / F.col("h")
    k = F.sum(F.col("c") * F.exp(-z * z / 2)) / (F.first("n") * F.first("h") * (2 * pi) ** 0.5)
    return grid.join(cells, "curve").groupBy("curve", "point", F.col("at").alias("score")).agg(k.alias("density"))


def mixed_model(df: DataFrame, y: str, xs: list[str], unit: str) -> dict:
    """Maximum likelihood of a random intercept by ``unit``: coefficients (an intercept first), covariance, both variances, the log likelihood.

    Rows are reduced to sums a unit, and these to sums a size of unit, since the variance ratio weighs units by their size alone; that table, a row a distinct size,
    is all that the search for the ratio needs. Rows with a null are left out; without rows there is nothing to return but ``n`` = 0.
    """
    p = 1 + len(xs)
    d = df.select(F.col(unit).alias("_g"), F.col(y).cast("double").alias("_y"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(xs, 1)]).dropna()
    names = ["_one", *[f"_x{i}" for i in range(1, p)], "_y"]
    d = d.withColumn("_one", F.lit(1.0))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    units = d.groupBy("_g").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"s{c}") for c in names], *[F.sum(F.col(a) * F.col(b)).alias(f"q{a}{b}") for a, b in pairs])
    got = units.groupBy("_n").agg(F.count("*").alias("units"), *[F.sum(f"q{a}{b}") for a, b in pairs], *[F.sum(F.col(f"s{a}") * F.col(f"s{b}")) for a, b in pairs]).collect()
    if not got:
        return {"n": 0}
    size, count = np.array([r[0] for r in got], float), np.array([r[1] for r in got], float)
    raw, between = np.array([r[2 : 2 + len(pairs)] for r in got], float).sum(axis=0), np.array([r[2 + len(pairs) :] for r in got], float)
    up, n = np.triu_indices(p + 1), float(size @ count)

    def fit(ratio: float):
        """Generalised least squares at a ratio of the unit's variance to the rest's, and the profiled log likelihood."""
        v = raw - (ratio / (1 + size * ratio)) @ between
        m = np.zeros((p + 1, p + 1))
        m[up] = v
        m = m + np.triu(m, 1).T
        inv = np.linalg.pinv(m[:p, :p])
        b = inv @ m[:p, p]
        rest = max(1e-300, float(m[p, p] - b @ m[:p, p])) / n
        return b, inv * rest, rest, -n / 2 * (log(2 * pi * rest) + 1) - float(count @ np.log1p(size * ratio)) / 2

    grid = np.concatenate([[-40.0], np.linspace(-14, 10, 97)])  # logarithms of the ratio; the first stands for 0
    value = lambda t: fit(exp(t))[3]
    best = max(range(len(grid)), key=lambda i: value(grid[i]))
    lo, hi = grid[max(best - 1, 0)], grid[min(best + 1, len(grid) - 1)]
    shrink = (5**0.5 - 1) / 2
    for _ in range(80):
        a, b = hi - shrink * (hi - lo), lo + shrink * (hi - lo)
        lo, hi = (lo, b) if value(a) >= value(b) else (a, hi)
    ratio = max((0.0, exp((lo + hi) / 2), exp(grid[best])), key=lambda r: fit(r)[3])
    b, cov, rest, ll = fit(ratio)
    return {"n": int(n), "units": int(count.sum()), "names": ["one", *xs], "coef": b, "cov": cov, "residual": rest, "unit": rest * ratio, "loglik": ll}

