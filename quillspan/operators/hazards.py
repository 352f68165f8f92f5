"""Many Cox models at once over interval rows: batched Newton steps with halving, failure reasons and errors clustered by pair.

Rows, or patterns of them (start, stop, event, covariates), stay on the cluster as blocks of compact arrays, each row once, however many models it belongs to. A step
is one pass over the blocks for all models: coefficients travel with the job, a task adds up its sums by (model, time), and a model's times, whose
number the time grid bounds, are reduced to its likelihood, gradient and information. Only those reach the driver, which decides on each model's next point. Where all patterns together are few (a checked
bound) the driver takes them and does the same sums itself.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLIP = 30.0  # linear predictors are held within this
FLAT = 1e-10  # a covariate whose range is smaller is constant
STEEP = 15.0  # a coefficient that changes the log hazard by more over its covariate's range has run away
ROWS = 1 << 17  # rows of a block
SEP = "\x1f"  # between the names of a row's models
LONG_TIES = 100_000  # with more events at a time, sums over them are integrals


@dataclass
class NoFit:
    """Why a model has no fit; false where a fit is asked for."""

    reason: str
    n_rows: int = 0
    n_events: int = 0

    def __bool__(self) -> bool:
        return False


def pairs_of(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def square(v: np.ndarray, p: int) -> np.ndarray:
    m = np.zeros((p, p))
    m[np.triu_indices(p)] = v
    return m + np.triu(m, 1).T


def tie_sums(d: np.ndarray, s0: np.ndarray, e0: np.ndarray, efron: bool) -> dict[str, np.ndarray]:
    """Over the events k = 0 .. d-1 of each time, with f = k / d (0 for Breslow) and z = 1 / (s0 - f e0): sums of log(1/z), z, fz, z z, f z z, f f z z."""
    n, out = np.rint(d).astype(np.int64), {}
    if not efron:
        parts = _tie_terms(np.zeros(len(d)), s0, e0)
        return {k: n * v for k, v in parts.items()}
    long_ones = n > LONG_TIES
    for at in np.flatnonzero(long_ones):
        out[int(at)] = _integral(d[at], s0[at], e0[at])
    short = np.flatnonzero(~long_ones & (n > 0))
    sums = {k: np.zeros(len(d)) for k in ("log", "z", "fz", "zz", "fzz", "ffzz")}
    for first, last in _runs(n[short]):
        at = short[first:last]
        begin = np.concatenate([[0], np.cumsum(n[at])[:-1]])
        f = (np.arange(n[at].sum()) - np.repeat(begin, n[at])) / np.repeat(d[at], n[at])
        for k, v in _tie_terms(f, np.repeat(s0[at], n[at]), np.repeat(e0[at], n[at])).items():
            sums[k][at] = np.add.reduceat(v, begin)
    for at, parts in out.items():
        for k, v in parts.items():
            sums[k][at] = v
    return sums


def _runs(n: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of times with about ten times ``LONG_TIES`` events together."""
    ends = np.cumsum(n) // (10 * LONG_TIES)
    cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(n)]
    return [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def _integral(d: float, s0: float, e0: float) -> dict[str, float]:
    """The sums of one time with very many events: d times the integral over f, and half of what its two ends differ by."""
    nodes, weights = np.polynomial.legendre.leggauss(64)
    inner, ends = _tie_terms((nodes + 1) / 2, s0, e0), _tie_terms(np.array([0.0, 1.0]), s0, e0)
    return {k: d * float(v @ weights) / 2 + (ends[k][0] - ends[k][1]) / 2 for k, v in inner.items()}


def _tie_terms(f: np.ndarray, s0, e0) -> dict[str, np.ndarray]:
    left = np.maximum(s0 - f * e0, 1e-300)
    z = 1 / left
    return {"log": np.log(left), "z": z, "fz": f * z, "zz": z * z, "fzz": f * z * z, "ffzz": f * f * z * z}


def inverse(h: np.ndarray) -> np.ndarray:
    """Inverse of an information matrix, on a common scale; directions without information are left out (collinear terms share their effect)."""
    d = np.sqrt(np.maximum(np.diag(h), 1e-300))
    return np.linalg.pinv(h / np.outer(d, d), rcond=1e-10, hermitian=True) / np.outer(d, d)


def likelihood(begin, end, dead, fixed, p: int, ties: str = "efron") -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minus the log sums, gradient, information, sum of events' x, mean squares that the information's diagonal is a part of) from sums a row a time.

    ``begin``, ``end`` and ``dead`` hold (r, r x, r x x') of rows that start there, stop there and have their event there, ``fixed`` the events' (number, x).
    """
    at, (s, e, k) = _with_events(begin, end, dead, fixed, ties)
    s1, e1 = s[:, 1 : p + 1], e[:, 1 : p + 1]
    g = (fixed[at, 1:] - s1 * k["z"][:, None] + e1 * k["fz"][:, None]).sum(axis=0)
    crossed = (s1 * k["fzz"][:, None]).T @ e1
    h = square(k["z"] @ s[:, p + 1 :] - k["fz"] @ e[:, p + 1 :], p) - ((s1 * k["zz"][:, None]).T @ s1 - crossed - crossed.T + (e1 * k["ffzz"][:, None]).T @ e1)
    mass = np.diag(square(k["z"] @ s[:, p + 1 :], p)).copy()
    return -float(k["log"].sum()), g, h, fixed[:, 1:].sum(axis=0), mass


def _with_events(begin, end, dead, fixed, ties: str):
    """Times with events, their sums at risk (started before, not stopped before) and of the events, and the sums over ties."""
    at = np.flatnonzero(fixed[:, 0] > 0)
    risk = (np.cumsum(begin, axis=0) - begin - (np.cumsum(end, axis=0) - end))[at]
    return at, (risk, dead[at], tie_sums(fixed[at, 0], risk[:, 0], dead[at, 0], ties == "efron"))


def hazard_rows(begin, end, dead, fixed, p: int, ties: str = "efron") -> np.ndarray:
    """A row a time of what score residuals need: running sums of z and z xbar over the events up to it, then of its own events f z, f z xbar and the mean of xbar.

    xbar is (s1 - f e1) z, so every sum follows from those of ``tie_sums``.
    """
    at, (s, e, k) = _with_events(begin, end, dead, fixed, ties)
    s1, e1, col = s[:, 1 : p + 1], e[:, 1 : p + 1], lambda name: k[name][:, None]
    out = np.zeros((len(fixed), 2 * (1 + p) + p))
    out[at] = np.hstack([col("z"), s1 * col("zz") - e1 * col("fzz"), col("fz"), s1 * col("fzz") - e1 * col("ffzz"), (s1 * col("z") - e1 * col("fz")) / fixed[at, :1]])
    out[:, : 1 + p] = np.cumsum(out[:, : 1 + p], axis=0)
    return out


def local_sums(start, stop, event, x, n):
    """A function of the coefficients that gives the times and the sums by time of rows at hand."""
    times = np.unique(np.concatenate([start, stop]))
    a, z, dead = np.searchsorted(times, start), np.searchsorted(times, stop), event == 1
    moments = np.column_stack([np.ones(len(x)), x, *(x[:, i] * x[:, j] for i, j in pairs_of(x.shape[1]))])

    def by(at, v):
        return np.stack([np.bincount(at, c, len(times)) for c in v.T], axis=1) if v.shape[1] else np.zeros((len(times), 0))

    fixed = by(z[dead], np.column_stack([n[dead], n[dead, None] * x[dead]]))

    def sums(b):
        r = (n * np.exp(np.clip(x @ b, -CLIP, CLIP)))[:, None] * moments
        return times, by(a, r), by(z, r), by(z[dead], r[dead]), fixed

    return sums


@dataclass
class Search:
    """Newton's method with halved steps on one penalised likelihood; ``point`` is where the likelihood is wanted next."""

    p: int
    ridge: float
    free: np.ndarray  # covariates that are estimated; the others stay at 0
    best: np.ndarray = None
    value: float = -np.inf
    step: np.ndarray = None
    info: np.ndarray = None
    halved: int = 0
    done: str = ""
    point: np.ndarray = field(init=False)

    def __post_init__(self):
        self.best, self.step, self.point = np.zeros(self.p), np.zeros(self.p), np.zeros(self.p)

    def take(self, logs: float, g: np.ndarray, h: np.ndarray, events: np.ndarray, mass: np.ndarray) -> None:
        """The likelihood at ``point``: go on from there, or back to half the step if it is worse than the best so far.

        Without a ridge, covariates that never differ among the rows at risk (such as a phase that all enter together) have no estimate.
        """
        if self.info is None and not self.ridge:
            self.free = self.free & (np.diag(h) > 1e-10 * mass)
        value = float(events @ self.point) + logs - self.ridge / 2 * float(self.point @ self.point)
        worse = not np.isfinite(value) or value < self.value - 1e-10 * max(1.0, abs(self.value))
        if worse and np.abs(self.step).max(initial=0) > 1e-12:
            self.halved += 1
            self.step = self.step / 2
            self.point = self.best + self.step
            if self.halved > 30:
                self.done = "no convergence"
            return
        if worse:
            self.done = "no convergence"
            return
        self.best, self.value, self.halved = self.point, value, 0
        self.info = np.eye(self.p)
        at = np.ix_(self.free, self.free)
        self.info[at] = h[at] + self.ridge * np.eye(int(self.free.sum()))
        slope = np.where(self.free, g - self.ridge * self.best, 0.0)
        self.step = np.clip(inverse(self.info) @ slope, -2, 2)
        if np.abs(self.step).max(initial=0) < 1e-9 or not self.free.any():
            self.done = "converged"
        self.point = self.best + self.step


def _narrow(v: np.ndarray) -> np.ndarray:
    """The values in the smallest type that holds all of them exactly."""
    with np.errstate(invalid="ignore", over="ignore"):
        return next((c for c in map(v.astype, (np.int8, np.int16, np.int32, np.float32)) if np.array_equal(c, v)), v)


def _chunks(batches):
    """Tables of about ``ROWS`` rows, each with its (models, places) by membership."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= ROWS:
            yield _members(held)
            held, n = [], 0
    if n:
        yield _members(held)


def _members(batches):
    table = pa.Table.from_batches(batches).combine_chunks()
    key = table.column("_key").chunk(0).dictionary_encode()
    code = key.indices.to_numpy(zero_copy_only=False)
    return table, [(k.split(SEP), np.flatnonzero(code == i)) for i, k in enumerate(key.dictionary.to_pylist())]


def _column(table, name: str, at: np.ndarray) -> np.ndarray:
    """Values of a number column, or of a column of lists of one length as rows of a matrix, as doubles."""
    c = table.column(name).chunk(0).take(pa.array(at))
    return c.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), -1) if pa.types.is_list(c.type) else c.to_numpy(zero_copy_only=False).astype(float)


def packed(rows: DataFrame, p: int) -> DataFrame:
    """(_key, data): rows of equal membership as compact arrays, so that a step reads them without turning rows into columns again."""

    def run(batches):
        for table, members in _chunks(batches):
            keys, data = [], []
            for models, at in members:
                start, stop, event = (_column(table, c, at) for c in ("start", "stop", "event"))
                times = np.unique(np.concatenate([start, stop]))
                spot = (np.searchsorted(times, start) * len(times) + np.searchsorted(times, stop)) * 2 + (event == 1)
                order = np.argsort(spot, kind="stable")
                spots, first = np.unique(spot[order], return_index=True)
                at = at[order]
                block = times, (spots // 2 // len(times), spots // 2 % len(times), spots % 2 == 1), first, _narrow(_column(table, "n", at)), [_narrow(_column(table, f"_x{i}", at)) for i in range(p)]
                keys.append(SEP.join(models))
                data.append(pickle.dumps(block, 5))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(data, pa.binary())], names=["_key", "data"])

    return rows.mapInArrow(run, "_key string, data binary")


def _scaled(xs: list[np.ndarray], scale: dict | None) -> list[np.ndarray]:
    """Covariates in doubles, those of ``scale`` ({place: (low, high, mean, deviation)}) clipped and scaled."""
    out = [x.astype(float) for x in xs]
    for i, (lo, hi, m, s) in (scale or {}).items():
        v = np.minimum(np.maximum(out[i], lo), hi)
        out[i] = (v - m) / s if s is not None and s > 0 else v
    return out


def block_sums(block, j: int, point: np.ndarray, mean: np.ndarray, scale: dict | None):
    """The times of a block and, a row a time, the sums of its ``j``-th model at ``point``: of starts, stops and events, then the events' number and x.

    Rows of equal start, stop and event are neighbours, so they are added up first.
    """
    times, (a, z, event), first, n, xs = block
    n = (n if n.ndim == 1 else n[:, j]).astype(float)
    x = _scaled(xs, scale)
    for v, m in zip(x, mean, strict=True):
        v -= m
    r, p, dead = np.zeros(len(n)), len(x), np.flatnonzero(event)
    for v, b in zip(x, point, strict=True):
        r += v * float(b)
    r = n * np.exp(np.clip(r, -CLIP, CLIP))
    rx, held = [r * v for v in x], np.empty(len(n))
    total = lambda v: np.add.reduceat(v, first)
    moments = [total(r), *map(total, rx), *(total(np.multiply(rx[i], x[k], out=held)) for i, k in pairs_of(p))]
    own = [total(n), *(total(np.multiply(n, v, out=held)) for v in x)]
    by = lambda at, v: np.bincount(at, v, len(times))
    zd = z[dead]
    return times, np.stack([*(by(a, v) for v in moments), *(by(z, v) for v in moments), *(by(zd, v[dead]) for v in moments), *(by(zd, v[dead]) for v in own)], axis=1)


def _together(parts):
    """Sums by time of several blocks as those of one."""
    times = np.unique(np.concatenate([t for t, _ in parts]))
    out = np.zeros((len(times), parts[0][1].shape[1]))
    for t, v in parts:
        out[np.searchsorted(times, t)] += v
    return times, out


def _split(v: np.ndarray, p: int):
    k = 1 + p + len(pairs_of(p))
    return v[:, :k], v[:, k : 2 * k], v[:, 2 * k : 3 * k], v[:, 3 * k :]


class Models:
    """Patterns of many models with the same covariates, and their sums at given points."""

    def __init__(self, patterns: DataFrame, covs: list[str], ties: str = "efron", max_local: int = 200_000, scale: dict[str, dict] | None = None):
        """``patterns`` has _models (an array of the models that a row belongs to), start, stop, event, n (a number, or an array with one for each model) and the covariates.

        ``scale`` gives, a model, the covariates' places that are clipped and scaled (see ``_scaled``). Up to ``max_local`` patterns, all models together, are summed on the driver; more stay where they are.
        """
        self.covs, self.ties, self.p, self.spark, self.scale = covs, ties, len(covs), patterns.sparkSession, scale or {}
        rows = patterns.select(F.array_join("_models", SEP).alias("_key"), "start", "stop", "event", "n", *[F.col(c).alias(f"_x{i}") for i, c in enumerate(covs)])
        self.blocks = packed(rows, self.p).persist()
        self.stats = {r._model: r for r in self._stats().collect()}  # a row a model
        self.local = None
        if sum(r.patterns for r in self.stats.values()) <= max_local:
            self.local = {}
            for r in self.blocks.collect():
                block = pickle.loads(r.data)
                for j, m in enumerate(r._key.split(SEP)):
                    self.local.setdefault(m, []).append((block, j))

    def _stats(self) -> DataFrame:
        p, scale = self.p, self.scale
        sums, ends = [f"s{i}" for i in range(p)], [f"{k}{i}" for k in ("lo", "hi") for i in range(p)]

        def run(batches):
            for b in batches:
                out = []
                for key, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    block = pickle.loads(data)
                    for j, m in enumerate(key.split(SEP)):
                        _, (_, _, event), first, n, xs = block
                        n = (n if n.ndim == 1 else n[:, j]).astype(float)
                        some = np.flatnonzero(n)
                        if len(some):
                            events = np.add.reduceat(n, first)[event].sum()
                            x, n = [v[some] for v in _scaled(xs, scale.get(m))], n[some]
                            out.append((m, n.sum(), events, len(n), *(n @ v for v in x), *(v.min() for v in x), *(v.max() for v in x)))
                if out:
                    cols = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *[pa.array(np.array(c, float)) for c in cols[1:]]], names=["_model", "rows", "events", "patterns", *sums, *ends])

        got = self.blocks.mapInArrow(run, ", ".join(["_model string", *[f"{c} double" for c in ("rows", "events", "patterns", *sums, *ends)]]))
        total = F.sum("rows")
        return got.groupBy("_model").agg(total.alias("rows"), F.sum("events").alias("events"), F.sum("patterns").cast("long").alias("patterns"), F.array(*[F.sum(c) / total for c in sums]).alias("mean"), F.array(*[F.max(f"hi{i}") - F.min(f"lo{i}") for i in range(p)]).alias("range"))

    def _local_sums(self, model: str, point: np.ndarray):
        return _together([block_sums(block, j, point, np.array(self.stats[model].mean, float), self.scale.get(model)) for block, j in self.local[model]])

    def _reduced(self, points: dict[str, np.ndarray], reduce, schema: str) -> DataFrame:
        """``reduce`` of each model's sums: a task adds up its own blocks first, so that a row a (task, model) moves."""
        p = self.p
        at = {m: (b, np.array(self.stats[m].mean, float), self.scale.get(m)) for m, b in points.items()}

        def run(batches):
            held: dict[str, tuple] = {}
            for b in batches:
                for key, data in zip(b.column(0), b.column(1), strict=True):
                    models = [(j, m) for j, m in enumerate(key.as_py().split(SEP)) if m in at]
                    block = pickle.loads(data.as_py()) if models else None
                    for j, m in models:
                        got = block_sums(block, j, *at[m])
                        held[m] = _together([held[m], got]) if m in held else got
            for m, (t, v) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([m]), pa.array([t.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())], names=["_model", "t", "v"])

        def of_model(pdf: pd.DataFrame) -> pd.DataFrame:
            parts = [(np.frombuffer(t), np.frombuffer(v).reshape(len(t) // 8, -1)) for t, v in zip(pdf.t, pdf.v, strict=True)]
            times, v = _together(parts)
            return reduce(pdf._model.iloc[0], times, *_split(v, p))

        return self.blocks.mapInArrow(run, "_model string, t binary, v binary").groupBy("_model").applyInPandas(of_model, schema)

    def at(self, points: dict[str, np.ndarray]) -> dict[str, tuple]:
        """(logs, gradient, information, events' x) of each model at its point."""
        p, ties = self.p, self.ties
        if self.local is not None:
            return {m: likelihood(*_split(self._local_sums(m, b)[1], p), p, ties) for m, b in points.items()}

        def reduce(model, times, *sums):
            logs, g, h, events, mass = likelihood(*sums, p, ties)
            return pd.DataFrame({"_model": [model], "logs": [logs], "g": [g.tolist()], "h": [h.ravel().tolist()], "x": [events.tolist()], "mass": [mass.tolist()]})

        got = self._reduced(points, reduce, "_model string, logs double, g array<double>, h array<double>, x array<double>, mass array<double>").collect()
        return {r._model: (r.logs, np.array(r.g), np.array(r.h).reshape(p, p), np.array(r.x), np.array(r.mass)) for r in got}

    def hazards(self, points: dict[str, np.ndarray]) -> dict[str, tuple]:
        """(times, ``hazard_rows``) of each model at its point; the time grid bounds the times."""
        p, ties = self.p, self.ties
        if self.local is not None:
            local = {m: self._local_sums(m, b) for m, b in points.items()}
            return {m: (t, hazard_rows(*_split(v, p), p, ties)) for m, (t, v) in local.items()}

        def reduce(model, times, *sums):
            return pd.DataFrame({"_model": [model], "t": [times.tobytes()], "v": [hazard_rows(*sums, p, ties).tobytes()]})

        got = self._reduced(points, reduce, "_model string, t binary, v binary").collect()
        return {r._model: (np.frombuffer(r.t), np.frombuffer(r.v).reshape(len(r.t) // 8, -1)) for r in got}

    def close(self) -> None:
        self.blocks.unpersist()


def search(models: Models, penalty: float, min_rows: int, min_events: int, rounds: int) -> dict[str, Search | NoFit]:
    """Run every model's search together; a model leaves the rounds when it is done."""
    out: dict[str, Search | NoFit] = {}
    for m, s in models.stats.items():
        if s.rows < min_rows or s.events < min_events:
            out[m] = NoFit("too few rows or events", int(s.rows), int(s.events))
            continue
        out[m] = Search(models.p, penalty * s.rows, np.array(s.range, float) > FLAT)
    for _ in range(rounds):
        open_ = {m: s.point for m, s in out.items() if isinstance(s, Search) and not s.done}
        if not open_:
            break
        for m, got in models.at(open_).items():
            out[m].take(*got)
    for m, s in list(out.items()):
        stats = models.stats[m]
        if isinstance(s, NoFit):
            continue
        if s.done != "converged":
            out[m] = NoFit(s.done or "no convergence", int(stats.rows), int(stats.events))
        elif (np.abs(s.best) * np.array(stats.range, float) > STEEP).any():
            out[m] = NoFit("separated", int(stats.rows), int(stats.events))
    return out


def clustered_meat(rows: DataFrame, models: Models, points: dict[str, np.ndarray], cluster: str, weight: str | None = None) -> dict[str, np.ndarray]:
    """Sum over clusters of the outer products of their summed score residuals, a matrix a model.

    ``rows`` has _models, start, stop, event, the cluster and the covariates. A row's residual is its event's part less the hazard it was exposed to: running sums at its
    stop less those at its start, looked up in the models' times. A task adds up what it has of a cluster. With ``weight`` each row counts so often.
    """
    p, haz = models.p, models.hazards(points)
    at = {m: (b, np.array(models.stats[m].mean, float), models.scale.get(m), *haz[m]) for m, b in points.items()}
    d = rows.select(F.array_join("_models", SEP).alias("_key"), "start", "stop", "event", F.col(cluster).alias("_c"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"), *[F.col(c).alias(f"_x{i}") for i, c in enumerate(models.covs)])

    def run(batches):
        for table, members in _chunks(batches):
            for names, idx in members:
                start, stop, event, w, *xs = (_column(table, c, idx) for c in ("start", "stop", "event", "_w", *[f"_x{i}" for i in range(p)]))
                own = table.column("_c").chunk(0).take(pa.array(idx)).dictionary_encode(null_encoding="encode")
                code = own.indices.to_numpy(zero_copy_only=False)
                for m in (m for m in names if m in at):
                    b, mean, scale, times, v = at[m]
                    x = np.stack([c - k for c, k in zip(_scaled(xs, scale), mean, strict=True)], axis=1)
                    r = np.exp(np.clip(x @ b, -CLIP, CLIP))[:, None]
                    cum, i, k = np.ascontiguousarray(v[:, : 1 + p]), np.searchsorted(times, start), np.searchsorted(times, stop)
                    over = cum[k] - cum[i]
                    u = r * (over[:, 1:] - x * over[:, :1])
                    dead = np.flatnonzero(event)
                    xd, rd, vd = x[dead], r[dead], v[k[dead]]
                    u[dead] += event[dead, None] * (xd - vd[:, 2 + 2 * p :] + rd * (xd * vd[:, 1 + p : 2 + p] - vd[:, 2 + p : 2 + 2 * p]))
                    u *= w[:, None]
                    sums = [pa.array(np.bincount(code, c, len(own.dictionary))) for c in u.T]
                    yield pa.RecordBatch.from_arrays([pa.array([m] * len(own.dictionary), pa.string()), own.dictionary, *sums], names=["_model", "_c", *[f"_u{i}" for i in range(p)]])

    kind = d.schema["_c"].dataType.simpleString()
    u = d.mapInArrow(run, ", ".join(["_model string", f"_c {kind}", *[f"_u{i} double" for i in range(p)]]))
    u = u.groupBy("_model", "_c").agg(*[F.sum(f"_u{i}").alias(f"_u{i}") for i in range(p)])
    got = u.groupBy("_model").agg(F.array(*[F.sum(F.col(f"_u{i}") * F.col(f"_u{j}")) for i, j in pairs_of(p)]).alias("m")).collect()
    return {g._model: square(np.array(g.m, float), p) for g in got}
