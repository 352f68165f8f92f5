"""Model fits: time-varying Cox models over interval rows, their variants and resamples, and regressions from sums.

A fit needs the rows only through sums. Rows are collapsed to patterns (start, stop, event, covariates). A single model of few patterns (a checked
bound) is fitted on the driver; larger ones, and all models of a family together, are fitted on the cluster (see ``hazards``).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import erfc, exp, isfinite, lgamma, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import stored, work_folder
from . import hazards
from .features import dense_ids, response_bins
from .hazards import NoFit
from .quantiles import model_scales, wide_quantiles
from .scores import mixed_model
from .study import block_draws, multinomial_weights

MAIN = ["treated", "post_question", "treated_post_question", "post", "treated_active"]
SPEED_TERMS = ["rt_treated", "rt_active", "rt_post_question"]
OBSERVABLE = ["post_hour", "post_day_of_week", "num_tags", "body_len_chars", "title_len_chars", "owner_reputation"]
QUALITY = ["has_accepted_answer", "first_answer_score", "first_answer_body_len_chars"]
SCALED = {*OBSERVABLE, "first_answer_score", "first_answer_body_len_chars", "score_asinh"}  # winsorised and scaled; the speed terms share a scale already
CONTINUOUS = SCALED | set(SPEED_TERMS)
SPECS = {
    "A": MAIN,
    "B": MAIN + SPEED_TERMS,
    "observable": MAIN + OBSERVABLE,
    "quality": MAIN + QUALITY,
    "speed_length": MAIN + SPEED_TERMS + ["first_answer_body_len_chars"],
    "speed_score": MAIN + SPEED_TERMS + ["first_answer_score"],
    "speed_quality": MAIN + SPEED_TERMS + QUALITY,
    "speed_asinh": MAIN + SPEED_TERMS + ["score_asinh"],
    "speed_bins": MAIN + SPEED_TERMS + ["score_1_2", "score_3_9", "score_10"],
}
#: Response-time bins, left-closed, in hours.
RT_EDGES = [0, 0.25, 0.5, 1, 2, 4, 8, 12, 24, 72, float("inf")]
RT_LABELS = ["0-15 min", "15-30 min", "30-60 min", "1-2 hr", "2-4 hr", "4-8 hr", "8-12 hr", "12-24 hr", "1-3 days", ">3 days"]
#: The outcomes that the composite is taken apart into, and their help types.
OUTCOMES = {
    "answers_only": ["answer"],
    "comments_only": ["comment"],
    "edits_only": ["edit"],
    "accepts_only": ["accept"],
    "answers_comments": ["answer", "comment"],
    "answers_comments_edits": ["answer", "comment", "edit"],
    "composite_all": ["answer", "comment", "edit", "accept"],
}


def default_penalty(covs: list[str], grid: float) -> float:
    """The ridge penalty of a specification: larger with continuous terms, and on a grid of an hour or more."""
    return 1e-2 if CONTINUOUS & set(covs) else 5e-3 if grid >= 1 else 1e-6


@dataclass
class Fit:
    names: list[str]
    coef: np.ndarray
    cov: np.ndarray
    n_rows: int
    n_events: int
    meta: dict = field(default_factory=dict)
    robust: np.ndarray | None = None  # covariance clustered by pair, where asked for

    def robust_se(self, weights: dict[str, float] | str) -> float | None:
        """Clustered error of a term or a weighted sum of terms; None without one or if a term is absent."""
        weights = {weights: 1.0} if isinstance(weights, str) else weights
        if self.robust is None or not set(weights) <= set(self.names):
            return None
        w = np.array([weights.get(k, 0.0) for k in self.names])
        return sqrt(max(0.0, float(w @ self.robust @ w)))

    def row(self, weights: dict[str, float] | str, prefix: str = "") -> dict:
        """Estimate, error, p value, hazard ratio and interval of a term or of a weighted sum of terms; nulls if a term is absent."""
        weights = {weights: 1.0} if isinstance(weights, str) else weights
        keys = [f"{prefix}{k}" for k in ("coef", "se", "z", "p", "hr", "ci_lo", "ci_hi")]
        if not set(weights) <= set(self.names):
            return dict.fromkeys(keys)
        w = np.array([weights.get(k, 0.0) for k in self.names])
        c, s = float(w @ self.coef), sqrt(max(0.0, float(w @ self.cov @ w)))
        z = c / s if s > 0 else None
        p = erfc(abs(z) / sqrt(2)) if z is not None and isfinite(z) else None
        return dict(zip(keys, (c, s, z, p, exp(c), exp(c - 1.96 * s), exp(c + 1.96 * s)), strict=True))


def on_grid(df: DataFrame, grid: float) -> DataFrame:
    """Starts and stops on the grid (half-even); rows that become empty go."""
    return df.withColumns({c: F.rint(F.col(c) / grid) * grid for c in ("start", "stop")}).where("start < stop")


def patterns(df: DataFrame, covs: list[str], grid: float = 1.0, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Distinct (by, start, stop, event, covariates) with the rows (or weights) ``n`` that each stands for; rows lacking a covariate are left out."""
    g = on_grid(df, grid).dropna(subset=covs)
    return g.groupBy(*(by or []), "start", "stop", "event", *covs).agg((F.sum(weight) if weight else F.count("*")).alias("n"))


_pairs = hazards.pairs_of
_driver_sums = hazards.local_sums


class NotConverged(ValueError):
    """The penalised likelihood has no maximum that the search could reach."""


def newton(sums, p: int, total: float, ties: str = "efron", penalty: float = 0.0, rounds: int = 60, free: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and covariance by Newton's method with halved steps on the Efron (or Breslow) partial likelihood.

    ``sums(b)`` gives the times and, a row a time, the moments (risk, risk x, risk x x') of rows that start there, stop there, and have their
    event there, and the events' (count, x). A likelihood that still grows after ``rounds`` raises ``NotConverged``; ``free`` tells which covariates are
    estimated and, on return, which could be.
    """
    s = hazards.Search(p, penalty * total, np.ones(p, bool) if free is None else free)
    for _ in range(rounds):
        _, *parts = sums(s.point)
        s.take(*hazards.likelihood(*parts, p, ties))
        if s.done:
            break
    if s.done != "converged":
        raise NotConverged(s.done or "no convergence")
    if free is not None:
        free[:] = s.free
    return s.best, hazards.inverse(s.info)


def _fit(covs, free, b, v, n_rows, n_events, robust=None, **meta) -> Fit:
    """A fit of the covariates that are not constant; the others are named in its ``meta``."""
    at = np.flatnonzero(free)
    dropped = [c for c, f in zip(covs, free, strict=True) if not f]
    pick = lambda m: None if m is None else m[np.ix_(at, at)]
    return Fit([covs[i] for i in at], b[at], pick(v), int(n_rows), int(n_events), {**meta, "dropped": dropped}, pick(robust))


def fit_models(df: DataFrame, covs: list[str], models: Column, grid: float = 1.0, penalty: float | None = None, ties: str = "efron", min_rows: int = 100, min_events: int = 10, cluster: str | None = None, weight: str | None = None, rounds: int = 60, max_local: int = 200_000) -> dict[str, Fit | NoFit]:
    """A fit, or the reason why there is none, for each model; ``models`` gives an array of the models that a row belongs to.

    All models' steps run together (see ``hazards``). Continuous covariates (but the speed terms) are clipped and scaled within each model; constant ones
    are left out of its fit. With ``cluster`` the fit has clustered errors
    too; ``weight`` counts a row that often. Rows that lack a covariate are left out.
    """
    penalty = default_penalty(covs, grid) if penalty is None else penalty
    scaled = [c for c in covs if c in SCALED]
    own = [c for c in dict.fromkeys([cluster, weight]) if c]
    base = on_grid(df.withColumn("_models", models), grid).dropna(subset=covs).where(F.size("_models") > 0)
    base = base.select("_models", "start", "stop", "event", *dict.fromkeys([*covs, *own]))
    scale = {}
    if scaled:  # rows hardly repeat, and each model has its own scale: they are kept as they are, once for all their models
        found = model_scales(base, scaled, "_models")
        scale = {m: {covs.index(c): s for c, s in of.items()} for m, of in found.items()}
        patterns_ = base.withColumn("n", F.col(weight).cast("double") if weight else F.lit(1.0))
    else:
        patterns_ = base.groupBy("_models", "start", "stop", "event", *covs).agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    return fit_patterns(patterns_, covs, penalty, ties, min_rows, min_events, rounds, max_local, base if cluster else None, cluster, weight, scale)


def fit_patterns(patterns_: DataFrame, covs: list[str], penalty: float, ties: str = "efron", min_rows: int = 100, min_events: int = 10, rounds: int = 60, max_local: int = 200_000, rows: DataFrame | None = None, cluster: str | None = None, weight: str | None = None, scale: dict[str, dict] | None = None) -> dict[str, Fit | NoFit]:
    """The fits of a table of patterns (_models, start, stop, event, n, covariates; see ``hazards.Models``); ``rows`` are what clustered errors are summed over."""
    together = hazards.Models(patterns_, covs, ties, max_local, scale)
    try:
        found = hazards.search(together, penalty, min_rows, min_events, rounds)
        points = {m: s.best for m, s in found.items() if isinstance(s, hazards.Search)}
        meat = hazards.clustered_meat(rows, together, points, cluster, weight) if rows is not None and points else {}
        out: dict[str, Fit | NoFit] = {}
        for m, s in found.items():
            if isinstance(s, NoFit):
                out[m] = s
                continue
            stats, v = together.stats[m], hazards.inverse(s.info)
            out[m] = _fit(covs, s.free, s.best, v, stats.rows, stats.events, v @ meat[m] @ v if m in meat else None, patterns=stats.patterns)
        return out
    finally:
        together.close()


def cox(df: DataFrame, covs: list[str], grid: float = 1.0, penalty: float | None = None, ties: str = "efron", min_rows: int = 100, min_events: int = 10, max_patterns: int = 200_000, collapsed: bool = False, cluster: str | None = None) -> Fit | None:
    """Cox fit of interval rows, or None with fewer rows or events than the guards ask for, without convergence, or of separated data.

    Continuous covariates (but the speed terms) are clipped at their 5th and 95th percentiles and scaled first, constant ones left out. With
    ``collapsed`` the input is already a table of patterns. ``cluster`` adds errors clustered by that column.
    """
    penalty, one = default_penalty(covs, grid) if penalty is None else penalty, F.array(F.lit("All"))
    if collapsed:
        got = fit_patterns(df.withColumn("_models", one), covs, penalty, ties, min_rows, min_events, max_local=max_patterns)
    else:
        got = fit_models(df, covs, one, grid, penalty, ties, min_rows, min_events, cluster, max_local=max_patterns)
    return got.get("All") or None


def stratified(df: DataFrame, by: str, specs: dict[str, list[str]], grid: float = 1.0, cluster: str | None = None) -> list[tuple[str, str, Fit | NoFit]]:
    """A fit of each specification in each value of ``by`` and over all ("All"), a specification's models together."""
    member = F.when(F.col(by).isNotNull(), F.array(F.col(by).cast("string"), F.lit("All"))).otherwise(F.array(F.lit("All")))
    out = []
    for name, covs in specs.items():
        got = fit_models(df, covs, member, grid, cluster=cluster)
        out += [(s, name, got[s]) for s in sorted(got, key=lambda s: (s == "All", s))]
    return out


def response_time_fits(df: DataFrame, covs: list[str] | None = None, grid: float = 1.0, cluster: str | None = None) -> list[tuple[str, Fit | NoFit]]:
    """A fit for each response-time bin: all controls with the treated units that were answered in the bin."""
    own = response_bins(F.col("response_hours"), RT_EDGES, RT_LABELS)
    member = F.when(F.col("treated") == 0, F.array(*map(F.lit, RT_LABELS))).when(own.isNotNull(), F.array(own)).otherwise(F.array().cast("array<string>"))
    got = fit_models(df, covs or MAIN, member, grid, cluster=cluster)
    return [(label, got.get(label, NoFit("no rows"))) for label in RT_LABELS]


def cohort_fits(df: DataFrame, split_year: int, covs: list[str] | None = None, min_year: int = 2008) -> dict[str, Fit | NoFit]:
    """A fit before and from ``split_year``, over all and of newcomers.

    The split falls back to the median question year if one side would be empty, and to ``min_year`` if there is no year at all.
    """
    low, high = df.agg(F.min("question_year"), F.max("question_year")).first()
    if low is None:
        split_year = min_year
    elif not low < split_year <= high:
        split_year = int(np.ceil(wide_quantiles(df, ["question_year"], [0.5], lambda c, q: c).first()[0]))
    side = F.when(F.col("question_year") < split_year, F.lit(f"before {split_year}")).otherwise(F.lit(f"from {split_year}"))
    fresh = F.when(F.col("tenure_bucket") == "< 1 Week", F.array(side, F.concat(side, F.lit(", newcomers")))).otherwise(F.array(side))
    return fit_models(df.where("question_year IS NOT NULL"), covs or MAIN, fresh)


def pair_bootstrap(df: DataFrame, weights: DataFrame, covs: list[str] | None = None, grid: float = 1.0, chunk: int = 50) -> list[tuple[int, Fit | NoFit]]:
    """A fit for each replicate of pair weights (match_id, replicate, weight), joined to the interval rows and collapsed, ``chunk`` replicates at a time."""
    covs = covs or MAIN
    numbers = sorted(r[0] for r in weights.select("replicate").distinct().collect())
    rows, out = on_grid(df, grid).dropna(subset=covs).select("match_id", "start", "stop", "event", *covs).persist(), []
    for k in range(0, len(numbers), chunk):
        now = numbers[k : k + chunk]
        drawn = weights.where(F.col("replicate").isin(now))
        if SCALED & set(covs):  # each replicate's columns have their own scale
            got = fit_models(rows.join(drawn, "match_id"), covs, F.array(F.col("replicate").cast("string")), grid, weight="weight")
        else:  # a pair's weights are an array, so that its rows are read once for all replicates
            of_pair = F.map_from_entries(F.collect_list(F.struct("replicate", "weight")))
            arrays = drawn.groupBy("match_id", "replicate").agg(F.sum("weight").alias("weight")).groupBy("match_id").agg(of_pair.alias("_m"))
            arrays = arrays.select("match_id", F.array(*[F.coalesce(F.element_at("_m", F.lit(r).cast(drawn.schema["replicate"].dataType)), F.lit(0)).cast("int") for r in now]).alias("_w"))
            # the arrays hold every pair, and what they take is not seen by the size that a broadcast is chosen by: the driver never takes them
            wide = rows.join(arrays.hint("merge"), "match_id").groupBy("start", "stop", "event", *covs).agg(*[F.sum(F.col("_w")[i]).alias(f"_n{i}") for i in range(len(now))])
            each = wide.select("start", "stop", "event", *covs, F.array(*[F.lit(str(r)) for r in now]).alias("_models"), F.array(*[F.col(f"_n{i}").cast("double") for i in range(len(now))]).alias("n"))
            got = fit_patterns(each, covs, default_penalty(covs, grid))
        out += [(r, got.get(str(r), NoFit("no rows"))) for r in now]
    rows.unpersist()
    return out


HELD = 50_000  # patterns that a task of the bootstrap keeps before it hands them on


def drawn_bootstrap(df: DataFrame, replicates: int, seed: int = 42, first: int = 0, covs: list[str] | None = None, grid: float = 1.0, rows_of=None, key: str = "match_id", block: int = 4096) -> list[tuple[int, Fit | NoFit]]:
    """``pair_bootstrap`` with the draws of ``multinomial_weights``, none of which is ever a row.

    ``df`` has interval rows, or units that ``rows_of`` turns into them row by row. Rows are dealt by blocks of pairs; a task draws its blocks' pairs for all replicates
    and adds up the weights of equal patterns, so that what moves then is patterns, each with an array of its weights.
    """
    covs, numbers, spark, folder = covs or MAIN, range(first, first + replicates), df.sparkSession, work_folder(df.sparkSession)
    rows_of = rows_of or (lambda d: d)
    if SCALED & set(covs):  # each replicate's columns have their own scale
        rows = rows_of(df)
        return pair_bootstrap(rows, multinomial_weights(rows, key, replicates, seed, block=block, first=first), covs, grid)
    ids = stored(dense_ids(df.where(F.col(key).isNotNull()), [key], "_n"), folder, "pairs")
    total = ids.count()
    dealt = df.join(ids, key).withColumn("_b", F.floor((F.col("_n") - 1) / block)).repartition("_b").sortWithinPartitions("_b")
    columns = ["start", "stop", "event", *covs]
    rows = on_grid(rows_of(dealt), grid).dropna(subset=covs).select("_b", "_n", *[F.col(c).cast("double").alias(c) for c in columns])
    numbered = lambda batch, names: np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names], axis=1)

    def merged(parts):
        """Distinct patterns and their summed weights."""
        x, w = np.concatenate([p for p, _ in parts]), np.concatenate([n for _, n in parts])
        order = np.lexsort(x.T)
        x = x[order]
        begin = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]).any(axis=1)])) if len(x) else np.zeros(0, int)
        return x[begin], np.add.reduceat(w[order], begin, axis=0) if len(x) else w

    def given(x, w, step=2000):
        for lo in range(0, len(x), step):
            n = w[lo : lo + step]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * n.shape[1]), pa.array(n.astype(float).ravel()))
            yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(c)) for c in x[lo : lo + step].T), lists], names=[*columns, "n"])

    def kept(parts):
        """Patterns held and added up as they come; too many are handed on."""
        held, n = [], 0
        for part in parts:
            held.append(part)
            n += len(part[0])
            if n > 2 * HELD:
                held = [merged(held)]
                n = len(held[0][0])
                if n > HELD:
                    yield from given(*held[0])
                    held, n = [], 0
        if held:
            yield from given(*merged(held))

    def of_block(at, pieces):
        x = np.concatenate(pieces)
        weights = np.ascontiguousarray(block_draws(at, total, block, numbers, seed, total).T)
        order = np.lexsort(x[:, 1:].T)
        x = x[order]
        begin = np.flatnonzero(np.concatenate([[True], (x[1:, 1:] != x[:-1, 1:]).any(axis=1)]))
        return x[begin, 1:], np.add.reduceat(weights[(x[:, 0].astype(np.int64) - 1) % block], begin, axis=0)

    def blocks(batches):
        at, pieces = None, []
        for b in batches:
            own, x = b.column("_b").to_numpy(), numbered(b, ["_n", *columns])
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi > lo:
                    if pieces and own[lo] != at:
                        yield of_block(at, pieces)
                        pieces = []
                    at = int(own[lo])
                    pieces.append(x[lo:hi])
        if pieces:
            yield of_block(at, pieces)

    def lists(batches):
        for b in batches:
            if b.num_rows:
                yield numbered(b, columns), b.column("n").flatten().to_numpy().reshape(b.num_rows, -1)

    schema = ", ".join([*(f"{c} double" for c in columns), "n array<double>"])
    parts = rows.mapInArrow(lambda batches: kept(blocks(batches)), schema)
    each = parts.repartition(spark.sparkContext.defaultParallelism, *columns).mapInArrow(lambda batches: kept(lists(batches)), schema)
    got = fit_patterns(each.withColumn("_models", F.array(*[F.lit(str(r)) for r in numbers])), covs, default_penalty(covs, grid))
    return [(r, got.get(str(r), NoFit("no rows"))) for r in numbers]


def percentile_interval(values: list[float]) -> dict:
    """Deviation and the 2.5th and 97.5th percentiles (linear interpolation) of replicates."""
    v = np.array([x for x in values if x is not None and isfinite(x)])
    if len(v) < 2:
        return {"n": len(v), "sd": None, "lo": None, "hi": None}
    lo, hi = np.percentile(v, [2.5, 97.5])
    return {"n": len(v), "sd": float(v.std(ddof=1)), "lo": float(lo), "hi": float(hi)}


def logit(df: DataFrame, y: str, xs: list[str], cluster: list[str] | None = None, penalty: float = 0.0, rounds: int = 30) -> Fit | None:
    """Logistic regression from sums: each step is one aggregation. Errors are clustered by the columns of ``cluster`` if given; the intercept is a column of ``xs``.

    The ridge penalty leaves columns alone that are the same in every row, such as the intercept.
    """
    p, up = len(xs), np.triu_indices(len(xs))
    d = df.select(F.col(y).cast("double").alias("_y"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(xs)], *[F.col(c).alias(f"_g{i}") for i, c in enumerate(cluster or [])]).dropna().persist()
    x, b, n, h = [F.col(f"_x{i}") for i in range(p)], np.zeros(p), 0, None
    ridge = penalty * np.array([float(v or 0) > 0 for v in d.agg(*[F.max(c) - F.min(c) for c in x]).first()]) if penalty else np.zeros(p)

    def mean(b):
        return 1 / (1 + F.exp(-sum((c * float(v) for c, v in zip(x, b, strict=True)), F.lit(0.0))))

    for _ in range(rounds):
        m = mean(b)
        got = d.select("*", m.alias("_m")).agg(F.count("*"), F.sum("_y"), *[F.sum(c * (F.col("_y") - F.col("_m"))) for c in x], *[F.sum(x[i] * x[j] * F.col("_m") * (1 - F.col("_m"))) for i, j in _pairs(p)]).first()
        n, ones = got[0], got[1]
        if not n or ones in (0, n):
            d.unpersist()
            return None
        h = np.zeros((p, p))
        h[up] = got[2 + p :]
        h = h + np.triu(h, 1).T + np.diag(ridge)
        step = np.linalg.pinv(h) @ (np.array(got[2 : 2 + p], float) - ridge * b)
        b = b + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    v = np.linalg.pinv(h)
    if cluster:
        m = mean(b)
        u = d.groupBy(*[f"_g{i}" for i in range(len(cluster))]).agg(*[F.sum(x[i] * (F.col("_y") - m)).alias(f"_u{i}") for i in range(p)])
        got = u.agg(F.count("*"), *[F.sum(F.col(f"_u{i}") * F.col(f"_u{j}")) for i, j in _pairs(p)]).first()
        meat = np.zeros((p, p))
        meat[up] = got[1:]
        v = v @ (meat + np.triu(meat, 1).T) @ v * (got[0] / (got[0] - 1) if got[0] > 1 else 1.0)
    d.unpersist()
    return Fit(list(xs), b, v, int(n), int(ones))


def least_squares(df: DataFrame, y: str, xs: list[str]) -> dict:
    """Coefficients, covariance (not clustered), residual sum of squares and rows, from one aggregation of cross products."""
    p, up = len(xs), np.triu_indices(len(xs))
    d = df.select(F.col(y).cast("double").alias("_y"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(xs)]).dropna()
    x = [F.col(f"_x{i}") for i in range(p)]
    got = d.agg(F.count("*"), F.sum(F.col("_y") * F.col("_y")), *[F.sum(c * F.col("_y")) for c in x], *[F.sum(x[i] * x[j]) for i, j in _pairs(p)]).first()
    n, yy, xy = got[0], float(got[1] or 0), np.array([float(v or 0) for v in got[2 : 2 + p]])
    a = np.zeros((p, p))
    a[up] = [float(v or 0) for v in got[2 + p :]]
    inv = np.linalg.pinv(a + np.triu(a, 1).T)
    b = inv @ xy
    rss = max(0.0, yy - float(b @ xy))
    return {"coef": b, "cov": inv * (rss / max(1, n - p)), "rss": rss, "n": n, "k": p}


def _beta_cf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return out


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x))
    return front * _beta_cf(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_cf(b, a, 1 - x) / b


def f_upper(f: float, d1: float, d2: float) -> float:
    """Upper tail of the F distribution."""
    return 1.0 if f <= 0 else beta_cdf(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_upper(x: float, k: int) -> float:
    """Upper tail of the chi-square distribution, as the limit of F with many degrees below."""
    return 1.0 if x <= 0 else f_upper(x / k, k, 1e7)


def individual_effects_test(df: DataFrame, y: str, xs: list[str], unit: str) -> dict:
    """F test of unit effects: pooled least squares (with an intercept) against the within transformation."""
    from .study import demeaned

    d = df.select(unit, *[F.col(c).cast("double").alias(c) for c in (y, *xs)]).dropna().withColumn("one", F.lit(1.0))
    pooled, within = least_squares(d, y, ["one", *xs]), least_squares(demeaned(d, unit, [y, *xs]), y, xs)
    units = d.select(unit).distinct().count()
    d1, d2 = units - 1, within["n"] - within["k"] - units
    f = ((pooled["rss"] - within["rss"]) / d1) / (within["rss"] / d2) if d1 > 0 and d2 > 0 and within["rss"] > 0 else None
    return {"n": pooled["n"], "units": units, "rss_pooled": pooled["rss"], "rss_within": within["rss"], "df1": d1, "df2": d2, "f": f, "p": f_upper(f, d1, d2) if f is not None else None}


def hausman(df: DataFrame, y: str, xs: list[str], unit: str) -> dict:
    """Hausman's test of the within estimate against the random-intercept model fitted by maximum likelihood (see ``mixed_model``)."""
    from .study import demeaned

    d = df.select(unit, *[F.col(c).cast("double").alias(c) for c in (y, *xs)]).dropna()
    within, random = least_squares(demeaned(d, unit, [y, *xs]), y, xs), mixed_model(d, y, xs, unit)
    diff = within["coef"] - random["coef"][1:]
    rest = within["rss"] / max(1, within["n"] - random["units"] - len(xs))  # the within transformation costs a degree of freedom a unit
    v = within["cov"] * rest * max(1, within["n"] - within["k"]) / max(within["rss"], 1e-300) - random["cov"][1:, 1:]
    stat = max(0.0, float(diff @ np.linalg.pinv(v) @ diff))
    return {"units": random["units"], "chi2": stat, "df": len(xs), "p": chi2_upper(stat, len(xs)), "unit_variance": random["unit"], "residual_variance": random["residual"]}


def effect_percent(fit: Fit, weights: dict[str, float], mean: float) -> dict:
    """A sum of coefficients with its error, and both as a percentage of a population mean (1 if that is 0)."""
    r, base = fit.row(weights), mean or 1.0
    return {"effect": r["coef"], "se": r["se"], "percent": r["coef"] / base * 100, "percent_se": r["se"] / base * 100}
