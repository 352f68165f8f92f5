"""Quantiles, batched Cox models, clustered errors and failing fits against plain computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.operators import features, fits, hazards, quantiles


def test_quantiles_equal_percentile(spark):
    rng = np.random.default_rng(0)
    rows = [(int(g), None if k % 11 == 0 else float(rng.choice([rng.normal(), -0.0, 0.0, 3.0, 1e300])), int(rng.integers(4))) for k, g in enumerate(rng.choice([0, 0, 0, 1, 2], 3000))] + [(9, None, 1), (8, 2.5, 7), (None, 1.0, 2)]
    df = spark.createDataFrame(rows, "g int, x double, k int").repartition(6)
    shares = [0.0, 0.05, 1 / 3, 0.5, 0.95, 1.0]
    got = {(r.g, r.share): r.value for r in quantiles.quantiles(df, ["x"], shares, ["g"]).collect()}
    want = {(r.g, q): v for r in df.groupBy("g").agg(F.percentile("x", F.array(*map(F.lit, shares))).alias("p")).collect() if r.p for q, v in zip(shares, r.p, strict=True)}
    assert got == want
    wide = quantiles.wide_quantiles(df, ["x", "k"], [0.5], lambda c, q: c).first()
    assert (wide.x, wide.k) == df.agg(F.median("x"), F.median("k")).first()
    weighted = quantiles.wide_quantiles(df, ["x"], [0.3, 0.7], lambda c, q: f"q{q}", weight="k").first()
    assert list(weighted) == df.withColumn("r", F.explode(F.sequence(F.lit(1), F.greatest("k", F.lit(1))))).where("k > 0").agg(F.percentile("x", F.array(F.lit(0.3), F.lit(0.7)))).first()[0]
    assert quantiles.quantiles(df.limit(0), ["x"], shares, ["g"]).count() == 0 and quantiles.wide_quantiles(df.limit(0), ["x"], [0.5], lambda c, q: c).first().x is None


def test_counts_before_a_value(spark):
    df = spark.createDataFrame([(s,) for s in ["b", "a", "b", None, "ä", "B", "b"]], "v string")
    got = {r.v: (r.n, r.before, r.total) for r in quantiles.cumulative_counts(df, [], "v").collect()}
    assert got == {None: (1, 0, 7), "B": (1, 1, 7), "a": (1, 2, 7), "b": (3, 3, 7), "ä": (1, 6, 7)}


def test_winsorised_by_group(spark):
    rng = np.random.default_rng(1)
    rows = [(g, float(rng.normal(g * 10, 1 + g))) for g in (0, 1) for _ in range(200)] + [(2, 5.0), (2, 5.0), (0, None)]
    df = spark.createDataFrame(rows, "g int, x double")
    out = features.winsorised(df, ["x"], keys=["g"])
    for g in (0, 1):
        x = np.array([v for h, v in rows if h == g and v is not None])
        c = np.clip(x, *np.quantile(x, [0.05, 0.95]))
        want = sorted((c - c.mean()) / c.std(ddof=1))
        assert sorted(r.x for r in out.where(f"g = {g} and x is not null").collect()) == pytest.approx(want)
    assert [r.x for r in out.where("g = 2").collect()] == [5.0, 5.0] and out.where("x is null").count() == 1


def panel(spark, n=200, seed=4):
    """Interval rows of pairs with three pieces a unit, many tied times, and a continuous covariate."""
    rng, rows = np.random.default_rng(seed), []
    for k in range(n):
        treated, x, cut = k % 2, round(float(rng.normal()), 2), float(rng.integers(1, 4))
        for s, t in ((-4.0, 0.0), (0.0, cut), (cut, cut + 5)):
            rows.append((k // 2, s, t, int(rng.random() < 0.2 + 0.25 * treated * (s >= 0)), treated, int(s >= 0) * treated, x, ["a", "b"][k // 2 % 2]))
    return rows, spark.createDataFrame(rows, "match_id long, start double, stop double, event int, treated int, post int, x double, bucket string").cache()


def residuals(rows, covs, beta):
    """Score residual of every row by the definition: a loop over event times and, for ties, over each of their events (Efron)."""
    start, stop, event, x = np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), np.array([r[3] for r in rows]), np.array([[r[c] for c in covs] for r in rows], float)
    w, out = np.exp(x @ beta), np.zeros(x.shape)
    for t in np.unique(stop[event == 1]):
        risk, dead = (start < t) & (stop >= t), (stop == t) & (event == 1)
        d = dead.sum()
        for k in range(d):
            share = np.where(dead, 1 - k / d, 1.0) * risk * w
            mean = share @ x / share.sum()
            out[dead] += (x[dead] - mean) / d
            out -= (share / share.sum())[:, None] * (x - mean)
    return out


def test_clustered_errors_equal_the_definition(spark):
    rows, df = panel(spark)
    covs, at = ["treated", "post", "x"], [4, 5, 6]
    fit = fits.cox(df, covs, penalty=0.0, min_rows=1, cluster="match_id")
    u = residuals(rows, at, fit.coef)
    assert np.abs(u.sum(axis=0)).max() < 1e-6  # the score vanishes at the maximum
    clusters = np.array([r[0] for r in rows])
    meat = sum(np.outer(s, s) for s in (u[clusters == c].sum(axis=0) for c in np.unique(clusters)))
    assert np.allclose(fit.robust, fit.cov @ meat @ fit.cov, rtol=1e-6)
    plain = fits.cox(df, covs, penalty=0.0, min_rows=1)
    assert fit.coef == pytest.approx(plain.coef.tolist()) and np.allclose(fit.cov, plain.cov) and plain.robust is None
    assert fit.robust_se("x") == pytest.approx(np.sqrt(fit.robust[2, 2])) and fit.robust_se("absent") is None and plain.robust_se("x") is None


def test_many_models_equal_single_ones(spark):
    _, df = panel(spark, 300)
    covs = ["treated", "post", "x"]
    got = {s: f for s, _, f in fits.stratified(df, "bucket", {"m": covs}, cluster="match_id")}
    assert list(got) == ["a", "b", "All"]
    member = F.array("bucket", F.lit("All"))
    spread = fits.fit_models(df, covs, member, cluster="match_id", max_local=0)
    for s, part in (("a", df.where("bucket = 'a'")), ("b", df.where("bucket = 'b'")), ("All", df)):
        one = fits.cox(part, covs, min_rows=1, cluster="match_id")
        assert got[s].coef == pytest.approx(one.coef.tolist(), abs=1e-8) and np.allclose(got[s].robust, one.robust) and got[s].n_rows == one.n_rows
        assert spread[s].coef == pytest.approx(one.coef.tolist(), abs=1e-8) and np.allclose(spread[s].robust, one.robust) and np.allclose(spread[s].cov, one.cov)
    twice = fits.fit_models(df.withColumn("w", F.lit(2)), covs, F.array(F.lit("m")), weight="w", cluster="match_id", penalty=0.0)["m"]
    once = fits.fit_models(df, covs, F.array(F.lit("m")), cluster="match_id", penalty=0.0)["m"]
    assert twice.n_rows == 2 * once.n_rows and np.allclose(twice.cov, once.cov / 2, rtol=0.1)


def test_failing_fits_say_why(spark):
    _, df = panel(spark)
    apart = df.withColumn("s", F.col("event"))  # events happen exactly where it is 1
    bad = fits.fit_models(apart, ["s", "x"], F.array(F.lit("m")), penalty=0.0)["m"]
    assert not bad and bad.reason in ("separated", "no convergence") and bad.n_events > 10
    assert fits.cox(apart, ["s", "x"], penalty=0.0) is None
    flat = fits.fit_models(df.withColumn("c", F.lit(3.0)), ["c", "x"], F.array(F.lit("m")), penalty=0.0)["m"]
    alone = fits.cox(df, ["x"], penalty=0.0)
    same = fits.cox(df.withColumn("phase", (F.col("start") >= 0).cast("int")), ["phase", "x"], penalty=0.0)  # all enter it together
    assert same.names == ["x"] and same.coef == pytest.approx(alone.coef.tolist())
    assert flat.names == ["x"] and flat.meta["dropped"] == ["c"] and flat.coef == pytest.approx(alone.coef.tolist()) and flat.row("c")["coef"] is None
    assert fits.cox(df.withColumn("c", F.lit(3.0)), ["c", "x"], penalty=0.0).names == ["x"]
    few = fits.fit_models(df.limit(5), ["x"], F.array(F.lit("m")))["m"]
    assert few.reason == "too few rows or events" and fits.fit_models(df.where("false"), ["x"], F.array(F.lit("m"))) == {}


def test_halved_steps_reach_the_maximum():
    """From a start where a full step overshoots, the likelihood never falls."""
    rng = np.random.default_rng(8)
    start, stop = np.zeros(60), rng.integers(1, 9, 60).astype(float)
    x = rng.standard_cauchy((60, 1)).round(2)
    event, seen = rng.integers(0, 2, 60), []
    sums, s = fits._driver_sums(start, stop, event, x, np.ones(60)), hazards.Search(1, 0.0, np.ones(1, bool))
    for _ in range(80):
        s.take(*hazards.likelihood(*sums(s.point)[1:], 1))
        seen.append(s.value)
        if s.done:
            break
    assert s.done == "converged" and seen == sorted(seen)
    g = hazards.likelihood(*sums(s.best)[1:], 1)[1]
    assert abs(g[0]) < 1e-5


@pytest.mark.parametrize("efron", [True, False])
def test_sums_over_long_ties(monkeypatch, efron):
    d, s0, e0 = np.array([90_000.0, 1, 3, 0, 700]), np.array([1000.0, 5, 4, 1, 90]), np.array([300.0, 5, 1, 0, 89])
    exact = hazards.tie_sums(d, s0, e0, efron)
    for t in range(5):
        left = s0[t] - (np.arange(int(d[t])) / max(d[t], 1) if efron else np.zeros(int(d[t]))) * e0[t]
        assert exact["z"][t] == pytest.approx((1 / left).sum()) and exact["log"][t] == pytest.approx(np.log(left).sum())
    monkeypatch.setattr(hazards, "LONG_TIES", 1000)
    near = hazards.tie_sums(d, s0, e0, efron)
    assert all(near[k] == pytest.approx(v, rel=1e-9) for k, v in exact.items())


def test_logit_penalty_leaves_the_intercept(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 + x)))).astype(int)
    df = spark.createDataFrame([(int(a), 1.0, float(b)) for a, b in zip(y, x, strict=True)], "y int, one double, x double").cache()
    free, bound = fits.logit(df, "y", ["one", "x"]), fits.logit(df, "y", ["one", "x"], penalty=1e7)
    assert bound.coef[1] == pytest.approx(0, abs=1e-3) and bound.coef[0] == pytest.approx(np.log(y.mean() / (1 - y.mean())), abs=1e-3)
    some = fits.logit(df, "y", ["one", "x"], penalty=50.0)
    p = 1 / (1 + np.exp(-(some.coef[0] + some.coef[1] * x)))
    assert abs((y - p).sum()) < 1e-4 and (x * (y - p)).sum() - 50 * some.coef[1] == pytest.approx(0, abs=1e-4) and some.coef[1] < free.coef[1]
