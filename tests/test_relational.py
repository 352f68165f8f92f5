"""Relational queries against their SQL twins, and the traps of the event model on hand-made rows."""

import duckdb
import numpy as np
import pytest

from quillspan.operators import events, features, fits, rates, study
from quillspan.plans import more
from quillspan.plans import queries as q
from quillspan.sources.testdata import BASE

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or v != v:
        return None
    return round(float(v), 6) if isinstance(v, float) or hasattr(v, "__float__") else str(v)


def rows(records, names):
    order = sorted(names)
    return sorted((tuple(str(plain(r[names.index(c)])) for c in order) for r in records))


@pytest.mark.parametrize("name", sorted(q.ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in BASE:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(q.ORACLE[name])
    got = more.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.collect(), got.columns) == rows(want.fetchall(), want.columns)


def test_tenure_edges(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(7.0,), (7.5,), (2190.0,), (2191.0,), (None,)], "d double")
    got = [r[0] for r in df.select(study.tenure_bucket(F.col("d"))).collect()]
    assert got == ["< 1 Week", "1 Week - 1 Month", "3 - 6 Years", "> 6 Years", "> 6 Years"]


def test_intervals_and_cut(spark):
    w = spark.createDataFrame([(1, 1, -48.0, 0.0, 3.0, 51.0)], "match_id long, question_id long, t_start double, t_question double, t_answer double, t_end double")
    e = spark.createDataFrame([(1, 1, -48.0), (1, 1, 3.0), (1, 1, -3.0), (1, 1, -3.0)], "match_id long, question_id long, t_event double")
    got = sorted((r.start, r.stop, r.event) for r in study.intervals(w, e).collect())
    assert got == [(-48.0, -3.0, 1), (-3.0, 0.0, 0), (0.0, 3.0, 1), (3.0, 51.0, 0)]
    cut = sorted((r.start, r.stop, r.event) for r in study.cut_intervals(study.intervals(w, e), -24.0).collect())
    assert cut[:2] == [(-48.0, -24.0, 0), (-24.0, -3.0, 1)]


def test_newton_reaches_the_partial_likelihood_maximum():
    start, stop = np.zeros(6), np.array([2.0, 3, 3, 5, 6, 7])
    event, x = np.array([1, 1, 0, 1, 1, 0]), np.array([[1.0], [0], [1], [0], [1], [0]])

    def loglik(b):
        r, out = np.exp(x[:, 0] * b), 0.0
        for t in np.unique(stop[event == 1]):
            dead = (stop == t) & (event == 1)
            out += x[dead, 0].sum() * b - dead.sum() * np.log(r[(start < t) & (stop >= t)].sum())
        return out

    b, v = fits.newton(fits._driver_sums(start, stop, event, x, np.ones(6)), 1, 6.0)
    grid = np.linspace(b[0] - 0.01, b[0] + 0.01, 5)
    assert max(grid, key=loglik) == pytest.approx(b[0], abs=1e-9)
    assert v[0, 0] > 0


def test_newton_with_ties_against_a_grid(spark):
    """Efron's likelihood of tied, weighted, late-starting rows; sums of the driver and of the cluster agree."""
    rng = np.random.default_rng(1)
    n = 120
    start, x = rng.integers(0, 4, n).astype(float), rng.normal(size=(n, 2)).round(1)
    stop, event, w = start + rng.integers(1, 5, n), rng.integers(0, 2, n), rng.integers(1, 4, n).astype(float)

    def loglik(b):
        r, out = np.exp(x @ b), 0.0
        for t in np.unique(stop[event == 1]):
            dead, risk = (stop == t) & (event == 1), (start < t) & (stop >= t)
            d = int(w[dead].sum())
            out += w[dead] @ (x[dead] @ b) - sum(np.log((w * r)[risk].sum() - k / d * (w * r)[dead].sum()) for k in range(d))
        return out

    b, v = fits.newton(fits._driver_sums(start, stop, event, x, w), 2, w.sum())
    base = loglik(b)
    for step in (1e-3, -1e-3):
        for k in range(2):
            moved = b.copy()
            moved[k] += step
            assert loglik(moved) < base
    df = spark.createDataFrame([(float(s), float(t), int(e), int(c), *map(float, r)) for s, t, e, c, r in zip(start, stop, event, w, x)], "start double, stop double, event int, n long, a double, b double")
    few = fits.cox(df, ["a", "b"], penalty=0.0, min_rows=1, collapsed=True)
    many = fits.cox(df, ["a", "b"], penalty=0.0, min_rows=1, collapsed=True, max_patterns=0)
    assert few.coef == pytest.approx(b.tolist()) and many.coef == pytest.approx(b.tolist()) and np.allclose(few.cov, many.cov) and np.allclose(few.cov, v, rtol=1e-6)
    assert fits.cox(df, ["a", "b"], min_rows=10_000, collapsed=True) is None and fits.cox(df, ["a", "b"], min_rows=1, min_events=10**6, collapsed=True) is None


def interval_rows(spark, n=400):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(n):
        treated, rt = k % 2, float(rng.choice([0.1, 0.4, 0.8, 3.0, 30.0]))
        for s, t in ((-48, 0), (0, rt), (rt, rt + 48)):
            post = int(s >= rt)
            rows.append((k // 2, k, float(s), float(t), int(rng.random() < 0.1 + 0.15 * treated * post), treated, int(s >= 0), treated * int(s >= 0), post, treated * post, rt if treated else 0.0, ["< 1 Week", "> 6 Years"][k // 2 % 2]))
    return spark.createDataFrame(rows, "match_id long, question_id long, start double, stop double, event int, treated int, post_question int, treated_post_question int, post int, treated_active int, response_hours double, tenure_bucket string").cache()


def test_fit_variants(spark):
    df = interval_rows(spark)
    one = fits.cox(df, fits.MAIN, min_rows=1)
    by = {(s, k): f for s, k, f in fits.stratified(df, "tenure_bucket", {"A": fits.MAIN})}
    assert by["All", "A"].coef == pytest.approx(one.coef.tolist()) and by["All", "A"].n_rows == sum(by[s, "A"].n_rows for s in ("< 1 Week", "> 6 Years"))
    alone = fits.cox(df.where("tenure_bucket = '< 1 Week'"), fits.MAIN, min_rows=1)
    assert by["< 1 Week", "A"].coef == pytest.approx(alone.coef.tolist())
    bins = dict(fits.response_time_fits(df))
    want = fits.cox(df.where("treated = 0 or (response_hours >= 0.25 and response_hours < 0.5)"), fits.MAIN)
    assert bins["15-30 min"].coef == pytest.approx(want.coef.tolist()) and set(bins) == set(fits.RT_LABELS)
    weights = df.select("match_id").distinct().selectExpr("match_id", "0 as replicate", "1 as weight")
    twice = df.select("match_id").distinct().selectExpr("match_id", "1 as replicate", "2 as weight").where("match_id % 2 = 0")
    boot = dict(fits.pair_bootstrap(df, weights.union(twice)))
    assert boot[0].coef == pytest.approx(one.coef.tolist()) and boot[1].n_rows == 2 * on_grid_rows(df.where("match_id % 2 = 0"))
    row = one.row({"treated_post_question": 1.0, "treated_active": 1.0})
    i, j = (fits.MAIN.index(k) for k in ("treated_post_question", "treated_active"))
    assert row["coef"] == pytest.approx(one.coef[i] + one.coef[j]) and row["se"] == pytest.approx(np.sqrt(one.cov[i, i] + one.cov[j, j] + 2 * one.cov[i, j]))
    assert one.row("absent")["coef"] is None
    assert fits.percentile_interval([1.0, 2.0, 3.0, None])["sd"] == pytest.approx(1.0) and fits.percentile_interval([1.0])["lo"] is None
    assert [fits.default_penalty(c, g) for c, g in ((fits.MAIN, 1.0), (fits.MAIN, 0.1), (fits.SPECS["B"], 1.0))] == [5e-3, 1e-6, 1e-2]


def on_grid_rows(df):
    return fits.on_grid(df, 1.0).count()


def test_logit_and_effect_tests(spark):
    rng = np.random.default_rng(5)
    n, g = 600, rng.integers(0, 40, 600)
    x = rng.normal(size=n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.3 + 0.8 * x)))).astype(int)
    z = 2 * x + rng.normal(size=40)[g] + rng.normal(size=n)
    df = spark.createDataFrame([(int(a), 1.0, float(b), int(c), float(d)) for a, b, c, d in zip(g, x, y, z)], "g long, one double, x double, y int, z double").cache()
    fit = fits.logit(df, "y", ["one", "x"])
    m = np.column_stack([np.ones(n), x])
    p = 1 / (1 + np.exp(-m @ fit.coef))
    assert np.abs(m.T @ (y - p)).max() < 1e-6 and np.allclose(fit.cov, np.linalg.inv((m * (p * (1 - p))[:, None]).T @ m))
    robust = fits.logit(df, "y", ["one", "x"], ["g"])
    assert robust.coef == pytest.approx(fit.coef.tolist()) and not np.allclose(robust.cov, fit.cov)
    assert fits.logit(df.where("y = 1"), "y", ["one", "x"]) is None
    test = fits.individual_effects_test(df, "z", ["x"], "g")
    dummies = np.column_stack([x, *(g == k for k in np.unique(g))]).astype(float)
    rss = lambda a: float(((z - a @ np.linalg.lstsq(a, z, rcond=None)[0]) ** 2).sum())
    d1, d2 = 39, n - 41
    assert test["f"] == pytest.approx((rss(m) - rss(dummies)) / d1 / (rss(dummies) / d2)) and test["p"] < 1e-6
    assert fits.hausman(df, "z", ["x"], "g")["p"] > 0.001
    assert fits.f_upper(1.0, 5, 5) == pytest.approx(0.5) and fits.f_upper(4.964603, 1, 10) == pytest.approx(0.05, abs=1e-6) and fits.chi2_upper(3.841459, 1) == pytest.approx(0.05, abs=1e-4)
    assert fits.effect_percent(fit, {"x": 1.0}, 0.5)["percent"] == pytest.approx(200 * fit.coef[1])


def test_self_answers_are_no_given_events(spark):
    """Traps of the event log: a self-answer, an answer without owner, an ownerless question, and votes of other types."""
    ts = "timestamp'2020-01-{:02d} 00:00:00'"
    questions = spark.sql(" UNION ALL ".join(f"SELECT {i} question_id, cast({o} AS int) owner_user_id, {ts.format(d)} creation_date, cast({a} AS int) accepted_answer_id, '<a>' tags, 1 view_count, 1 body_len_chars, 1 title_len_chars, 0 n_code_blocks" for i, o, d, a in ((1, 7, 10, 12), (2, "null", 10, 21), (3, 8, 11, 31))))
    answers = spark.sql(" UNION ALL ".join(f"SELECT {i} answer_id, {q_} parent_question_id, cast({o} AS int) owner_user_id, {s} score, {ts.format(d)} creation_date, 5 body_len_chars" for i, q_, o, s, d in ((11, 1, 8, -1, 11), (12, 1, 7, 3, 12), (13, 1, "null", 9, 10), (21, 2, 7, 0, 12), (31, 3, 7, 2, 13))))
    votes = spark.sql(f"SELECT 31 post_id, 1 vote_type_id, {ts.format(14)} creation_date UNION ALL SELECT 31, 1, {ts.format(15)} UNION ALL SELECT 11, 2, {ts.format(14)} UNION ALL SELECT 12, 1, {ts.format(14)}")
    users = spark.createDataFrame([(7, 100)], "user_id int, reputation int")
    e = {r.question_id: r for r in events.eligible_questions(questions, answers, votes, users).collect()}
    assert set(e) == {1, 3} and e[1].has_self_answer == 1 and e[1].has_accepted_answer == 0 and e[1].has_answer == 0 and e[1].has_unhelpful_answer == 1
    assert (e[1].first_answer_id, e[1].first_answer_votes, e[1].first_answer_body_len_chars) == (11, 0, 5) and (e[3].first_answer_id, e[3].first_answer_votes, e[3].vote_ts.day) == (31, 2, 14)
    log = [(r.user_id, r.event, r.ref_id) for r in events.event_log(events.eligible_questions(questions, answers, votes, users), questions, answers, votes).collect()]
    assert sorted(x for x in log if x[1] in ("Answer", "AcceptedAnswerPosted")) == [(7, "AcceptedAnswerPosted", 21), (7, "AcceptedAnswerPosted", 31), (7, "Answer", 21), (7, "Answer", 31), (8, "Answer", 11)]
    assert sorted(x for x in log if x[1] in ("AcceptedAnswer", "AcceptedAnswerVote")) == [(7, "AcceptedAnswer", 12), (7, "AcceptedAnswerVote", 12), (7, "AcceptedAnswerVote", 31), (8, "AcceptedAnswer", 31)]
    assert sorted(x for x in log if x[1] == "Window_Answer") == [(7, "Window_Answer", 1), (7, "Window_Answer", 1), (8, "Window_Answer", 3)]
    by_id = {r.question_id: r.has_accepted_answer for r in events.eligible_questions(questions, answers, votes, users, accepted_by_id=True).collect()}
    assert by_id == {1: 1, 3: 1}


def test_match_takes_the_nearest(spark):
    """Against a plain search: the k nearest by (distance, id), then the best by (Jaccard, distance, id)."""
    rng = np.random.default_rng(9)
    rows = [(int(i), 2000 + int(rng.integers(2)), 1, 2, int(rng.random() < 0.4), float(rng.integers(0, 60)) / 100, sorted(map(int, rng.choice(6, 2, replace=False)))) for i in range(300)]
    df = spark.createDataFrame(rows, "question_id long, year int, main_tag int, num_tags int, treated int, score double, tag_ids array<long>")
    got = {r.treated_id: (r.control_id, r.distance, r.jaccard) for r in study.match(df, 0.05, 3).collect()}
    want = {}
    for i, y, _, _, t, s, tags in rows:
        if t:
            near = sorted((abs(r[5] - s), r[0], r[6]) for r in rows if not r[4] and r[1] == y and abs(r[5] - s) <= 0.05)[:3]
            if near:
                j, d, c = min((-len({*tags} & {*x}) / len({*tags, *x}), d, c) for d, c, x in near)
                want[i] = (c, d, -j)
    assert got == want


def test_features(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, float("inf"), 2.0), (3, float("nan"), 3.0), (4, 4.0, 4.0)], "id int, a double, b double")
    assert [r.id for r in features.finite(df, ["a"]).collect()] == [1, 4]
    assert features.pair_sample(df, "id", 100).count() == 4 and features.sample_ids(df, "id", 2).count() == 2
    assert sorted(features.sample_ids(df, "id", 2).collect()) == sorted(features.sample_ids(df, "id", 2).collect())
    assert features.tolerant(df, {"a": "int", "c": "string"}).columns == ["id", "a", "b", "c"]
    ids = features.dense_ids(spark.createDataFrame([(2, 1), (1, 9), (1, 3), (2, 1)], "u int, q int"), ["u", "q"])
    assert sorted(map(tuple, ids.collect())) == [(1, 3, 1), (1, 9, 2), (2, 1, 3)]
    assert rates.bin_edges(-48, 48, 12) == [-48, -36, -24, -12, 0, 12, 24, 36, 48]


def test_absolute_effect(spark):
    from pyspark.sql import functions as F

    r = spark.range(1).select(*study.absolute_effect(F.lit(0.1), F.lit(0.9))).first()
    assert r.nnt is None and r.ard < 0


def test_clustered_ols(spark):
    rng = np.random.default_rng(3)
    g, x = rng.integers(0, 30, 400), rng.normal(size=(400, 2))
    y = x @ [1.5, -2.0] + rng.normal(size=30)[g] + rng.normal(size=400)
    df = spark.createDataFrame([(int(a), 1.0, *map(float, b), float(c)) for a, b, c in zip(g, x, y)] + [(0, 1.0, None, 0.0, 1.0)], "g long, one double, a double, b double, y double")
    fit = study.clustered_ols(df, "y", ["one", "a", "b"], "g")
    m = np.column_stack([np.ones(400), x])
    inv = np.linalg.inv(m.T @ m)
    beta = inv @ m.T @ y
    u = np.array([(m[g == k] * (y - m @ beta)[g == k, None]).sum(0) for k in np.unique(g)])
    n_g = len(u)
    v = inv @ u.T @ u @ inv * n_g / (n_g - 1) * 399 / 397
    assert [r["coef"] for r in fit] == pytest.approx(beta.tolist())
    assert [r["se"] for r in fit] == pytest.approx(np.sqrt(np.diag(v)).tolist())
    assert study.clustered_ols(df.limit(0), "y", ["a"], "g") == []
