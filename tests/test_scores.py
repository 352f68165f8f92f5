"""Propensities, support curves, mixed models and draws of pairs against plain computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.operators import fits, scores, study


def ridge_logit(x, y, penalty):
    b = np.zeros(x.shape[1])
    pen = np.eye(x.shape[1]) * penalty
    pen[0, 0] = 0
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pen, x.T @ (y - p) - pen @ b)
    return 1 / (1 + np.exp(-x @ b))


def test_propensity_equals_a_plain_fit_of_each_stratum(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(900):
        g = (2000 + i % 3, [None, 7][i % 2])
        a, b = rng.normal(), rng.normal(5, 3)
        t = int(rng.random() < 1 / (1 + np.exp(-a + 0.2 * g[0] % 3)))
        rows.append((i, *g, t if g != (2002, 7) else 1, float(a), None if i % 50 == 0 else float(b), 4.0))
    df = spark.createDataFrame(rows, "question_id long, year int, main_tag long, treated int, a double, b double, c double").repartition(5)
    got = {r.question_id: r.score for r in study.propensity(df, ["a", "b", "c"], ["year", "main_tag"]).collect()}
    a, b = np.array([r[4] for r in rows]), np.array([np.nan if r[5] is None else r[5] for r in rows])
    za, zb = (a - a.mean()) / a.std(ddof=1), np.nan_to_num((b - np.nanmean(b)) / np.nanstd(b, ddof=1))
    x, y = np.column_stack([np.ones(900), za, zb, np.zeros(900)]), np.array([r[3] for r in rows], float)
    want = {}
    for g in {r[1:3] for r in rows} - {(2002, 7)}:  # that stratum has one class
        at = np.array([i for i, r in enumerate(rows) if r[1:3] == g])
        want |= dict(zip(at.tolist(), ridge_logit(x[at], y[at], 1.0), strict=True))
    assert set(got) == set(want) and all(got[i] == pytest.approx(v, abs=1e-8) for i, v in want.items())
    assert study.propensity(df.limit(0), ["a"], ["year"]).count() == 0


def test_support_curves_equal_a_plain_density(spark):
    rng = np.random.default_rng(2)
    s = {"c": rng.beta(2, 5, 700), "t": rng.beta(4, 3, 300)}
    rows = [(k, float(v)) for k, vs in s.items() for v in vs] + [("one", 0.5), ("flat", 0.2), ("flat", 0.2), ("c", None), ("edge", 1.0), ("edge", 0.0)]
    got = scores.support_curves(spark.createDataFrame(rows, "curve string, score double"), points=50).collect()
    assert {r.curve for r in got} == {"c", "t", "edge"} and len(got) == 150
    for k, v in s.items():
        mine = sorted((r.point, r.score, r.density) for r in got if r.curve == k)
        h = v.std(ddof=1) * len(v) ** -0.2
        at = np.linspace(v.min() - 3 * h, v.max() + 3 * h, 50)
        want = np.exp(-(((at[:, None] - v) / h) ** 2) / 2).sum(axis=1) / (len(v) * h * np.sqrt(2 * np.pi))
        assert [m[1] for m in mine] == pytest.approx(at.tolist()) and np.abs(np.array([m[2] for m in mine]) - want).max() < 1e-3


def test_mixed_model_equals_direct_likelihood(spark):
    rng = np.random.default_rng(12)
    rows = []
    for g in range(40):
        u = rng.normal(0, 1.5)
        for _ in range(int(rng.integers(1, 9))):
            x = rng.normal(u / 3, 1)
            rows.append((g, float(x), float(1 + 0.7 * x + u + rng.normal(0, 0.8))))
    df = spark.createDataFrame(rows, "g int, x double, y double")
    m = scores.mixed_model(df, "y", ["x"], "g")
    y, x, g = np.array([r[2] for r in rows]), np.column_stack([np.ones(len(rows)), [r[1] for r in rows]]), np.array([r[0] for r in rows])

    def direct(unit, residual):
        v = residual * np.eye(len(y)) + unit * (g[:, None] == g[None, :])
        inv = np.linalg.inv(v)
        b = np.linalg.solve(x.T @ inv @ x, x.T @ inv @ y)
        e = y - x @ b
        return -0.5 * (len(y) * np.log(2 * np.pi) + np.linalg.slogdet(v)[1] + e @ inv @ e), b, np.linalg.inv(x.T @ inv @ x)

    ll, b, cov = direct(m["unit"], m["residual"])
    assert m["loglik"] == pytest.approx(ll) and m["coef"] == pytest.approx(b.tolist()) and np.allclose(m["cov"], cov)
    for du, dr in ((1.02, 1), (0.98, 1), (1, 1.02), (1, 0.98)):
        assert direct(m["unit"] * du, m["residual"] * dr)[0] < ll
    none = scores.mixed_model(df.withColumn("y", F.col("x") * 2 + F.col("g") % 2 * 0.0 + (F.hash("x") % 7)), "y", ["x"], "g")
    assert none["unit"] < 0.5 and scores.mixed_model(df.limit(0), "y", ["x"], "g") == {"n": 0}
    h = fits.hausman(df, "y", ["x"], "g")
    assert h["df"] == 1 and 0 <= h["p"] <= 1 and h["unit_variance"] == pytest.approx(m["unit"], rel=1e-6)


def test_multinomial_draws(spark):
    ids = spark.range(0, 3000).select((F.col("id") * 7).alias("match_id"))
    twice = ids.union(ids.limit(10))  # repeated ids count once
    w = study.multinomial_weights(twice, "match_id", 40, seed=1, block=256).toPandas()
    assert (w.groupby("replicate").weight.sum() == 3000).all() and (w.weight > 0).all() and not w.duplicated(["match_id", "replicate"]).any()
    table = w.pivot(index="match_id", columns="replicate", values="weight").fillna(0)
    full = np.zeros((3000, 40))
    full[table.index // 7] = table
    assert full.var() == pytest.approx(1 - 1 / 3000, rel=0.03)  # of a binomial with n trials at 1 / n
    blocks = np.add.reduceat(full, np.arange(0, 3000, 256))
    size = np.diff([*range(0, 3000, 256), 3000])
    assert np.abs(blocks.mean(axis=1) / size - 1).max() < 0.05
    assert blocks[:-1].var(axis=1, ddof=1).mean() == pytest.approx(256 * (1 - 256 / 3000), rel=0.25)
    again = study.multinomial_weights(ids.repartition(9), "match_id", 3, seed=1, block=256, first=2).toPandas()
    same = w[w.replicate == 2].sort_values("match_id").reset_index(drop=True)
    assert again[again.replicate == 2].sort_values("match_id").reset_index(drop=True).equals(same)
    assert study.multinomial_weights(ids, "match_id", 2, draws=5).groupBy("replicate").agg(F.sum("weight").alias("n")).where("n = 5").count() == 2
    assert study.multinomial_weights(ids.limit(0), "match_id", 2).count() == 0
