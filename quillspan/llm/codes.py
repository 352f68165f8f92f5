"""Vector code compression: product quantization of whole-number vectors by Lloyd rounds with Hamerly's bounds.

A row persists, for each part of its vector, its entry, an upper bound of the distance to it and one lower bound of the distance to the
second-nearest entry. A round moves the bounds by how far the entries moved; a part whose upper bound is strictly below its lower bound (or
below half the way to the nearest other entry) keeps its entry unlooked at. Others get their exact distance, and if that does
not help, an exact scan of all entries in whole numbers, ties to the lower index. Bounds are widened by more than rounding can add up to, so a
skipped part is one that a scan would leave alone. Each round is one pass: tasks write their rows' new state and, behind them, one row
a component of what they have summed, so only codebooks and their sums reach the driver.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import Tables, lean, read

SLACK = 2.0**-48  # relative, wider than the roundings of a root and a sum
EXACT = 2**53  # whole numbers below it are exact in doubles
ROWS = 4096  # rows looked at together
LONG = 2**63 - 1


def scaled(vector: Column, scale: int = 4096) -> Column:
    """floor(scale * x) of every component, held at a long's ends; null if the vector or a component is null or a component is not finite."""
    x = F.transform(vector, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    held = F.transform(x, lambda v: F.floor(F.least(F.greatest(v * scale, F.lit(-(2.0**62))), F.lit(2.0**62))))
    return F.when(~F.coalesce(bad, F.lit(True)), held)


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to entries: doubles where whole numbers stay exact in them, else Python's integers."""
    width, most = v.shape[1], max(int(abs(v).max(initial=0)), int(abs(c).max(initial=0)))
    if 8 * width * most * most < EXACT:
        v, c = v.astype(np.float64), c.astype(np.float64)
        return (v * v).sum(axis=1)[:, None] - 2 * (v @ c.T) + (c * c).sum(axis=1)[None, :]
    v, c = v.astype(object), c.astype(object)
    return ((v[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)


def own_squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The same for each row and the entry in the same place."""
    d = v.astype(object) - c.astype(object) if max(int(abs(v).max(initial=0)), int(abs(c).max(initial=0))) >= 2**24 else v - c
    return (d * d).sum(axis=1)


def root(x: np.ndarray, up: bool) -> np.ndarray:
    return np.sqrt(x.astype(np.float64)) * (1 + SLACK if up else 1 - SLACK)


@dataclass
class Moved:
    """A part's codebook and what bounds need of its last move: how far each entry moved, the most that any other moved, half the way to the nearest other."""

    entries: np.ndarray
    drift: np.ndarray
    others: np.ndarray
    half: np.ndarray

    @classmethod
    def of(cls, old: np.ndarray, new: np.ndarray) -> Moved:
        k = len(new)
        drift = root(own_squared(old, new), True)
        others = np.array([np.delete(drift, i).max(initial=0.0) for i in range(k)])
        apart = root(squared(new, new).astype(np.float64), False)
        np.fill_diagonal(apart, np.inf)
        return cls(new, drift, others, apart.min(axis=1, initial=np.inf) / 2)


def scan(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry (ties to the lower index), upper and lower bound of each row, from exact distances to all entries."""
    d = squared(v, c)
    a = d.argmin(axis=1)
    rows = np.arange(len(v))
    best = d[rows, a]
    if len(c) == 1:
        return a, root(best, True), np.full(len(v), np.inf)
    rest = d.astype(np.float64)
    rest[rows, a] = np.inf
    return a, root(best, True), rest.min(axis=1) ** 0.5 * (1 - SLACK)


def reassign(v: np.ndarray, part: Moved, a: np.ndarray, u: np.ndarray, low: np.ndarray) -> int:
    """Move the bounds and look again where they fail, in place; returns the number of rows that were scanned in full."""
    u += part.drift[a]
    u *= 1 + SLACK
    low -= part.others[a]
    low -= (np.abs(np.where(np.isfinite(low), low, 0)) + part.others[a]) * SLACK
    floor = np.maximum(low, part.half[a])
    open_ = np.flatnonzero(~(u < floor))
    if not len(open_):
        return 0
    u[open_] = root(own_squared(v[open_], part.entries[a[open_]]), True)
    open_ = open_[~(u[open_] < floor[open_])]
    if len(open_):
        a[open_], u[open_], low[open_] = scan(v[open_], part.entries)
    return len(open_)


def sums_of(v: np.ndarray, a: np.ndarray, k: int) -> np.ndarray:
    """Exact sums of the rows of each entry, as Python's integers."""
    if len(v) * int(abs(v).max(initial=0)) < EXACT:
        chosen = np.zeros((len(v), k))
        chosen[np.arange(len(v)), a] = 1
        return (chosen.T @ v.astype(np.float64)).astype(np.int64).astype(object)
    out = np.zeros((k, v.shape[1]), object)
    np.add.at(out, a, v.astype(object))
    return out


STATE = "id long, carried {carried}, v array<long>, a binary, u array<double>, low array<double>, part int, entry int, pos int, total decimal(38,0), n long, looked long"


def _lists(flat: np.ndarray, width: int) -> pa.Array:
    n = len(flat) // width
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(flat))


def _matrix(column: pa.Array, n: int, dtype) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(n, -1)


def _assigned(b: pa.RecordBatch, books: list[np.ndarray], moved: list[Moved] | None):
    """Vectors by part, entries, bounds and the number of full scans of a batch's rows."""
    n, parts = b.num_rows, len(books)
    width = books[0].shape[1]
    v = _matrix(b.column("v"), n, np.int64).reshape(n, parts, width)
    a, u, low, looked = np.zeros((n, parts), np.intp), np.zeros((n, parts)), np.zeros((n, parts)), 0
    if moved is not None:
        a[:] = np.frombuffer(b"".join(b.column("a").to_pylist()), np.uint8).reshape(n, parts)
        u[:], low[:] = _matrix(b.column("u"), n, np.float64), _matrix(b.column("low"), n, np.float64)
    for p in range(parts):
        if moved is None:
            a[:, p], u[:, p], low[:, p] = scan(v[:, p], books[p])
            looked += n
        else:
            ap, up, lp = a[:, p].copy(), u[:, p].copy(), low[:, p].copy()
            looked += reassign(v[:, p], moved[p], ap, up, lp)
            a[:, p], u[:, p], low[:, p] = ap, up, lp
    return v, a, u, low, looked


def lloyd_round(state: DataFrame, books: list[np.ndarray], moved: list[Moved] | None, schema: T.StructType) -> DataFrame:
    """One assignment: new state rows, then for each task the sums and numbers of its rows by part, entry and position."""
    parts, (k, width) = len(books), books[0].shape
    types = pa.schema([("id", pa.int64()), ("v", pa.list_(pa.int64())), ("a", pa.binary()), ("u", pa.list_(pa.float64())), ("low", pa.list_(pa.float64())), ("part", pa.int32()), ("entry", pa.int32()), ("pos", pa.int32()), ("total", pa.decimal128(38, 0)), ("n", pa.int64()), ("looked", pa.int64())])
    order = [f.name for f in schema.fields]

    def batch(columns: dict, rows: int, carried_type) -> pa.RecordBatch:
        have = columns | {c: pa.nulls(rows, carried_type if c == "carried" else types.field(c).type) for c in order if c not in columns}
        return pa.RecordBatch.from_arrays([have[c] for c in order], names=order)

    def run(batches):
        totals, counts, looked, carried_type = [np.zeros((k, width), object) for _ in range(parts)], np.zeros((parts, k), np.int64), 0, None
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                carried_type = b.column("carried").type
                v, a, u, low, n = _assigned(b, books, moved)
                looked += n
                for p in range(parts):
                    totals[p] += sums_of(v[:, p], a[:, p], k)
                    counts[p] += np.bincount(a[:, p], minlength=k)
                codes = [r.tobytes() for r in a.astype(np.uint8)]
                yield batch({"id": b.column("id"), "carried": b.column("carried"), "v": b.column("v"), "a": pa.array(codes, pa.binary()), "u": _lists(u.ravel(), parts), "low": _lists(low.ravel(), parts)}, b.num_rows, carried_type)
        if carried_type is not None:
            at = [x.ravel() for x in np.meshgrid(np.arange(parts), np.arange(k), np.arange(width), indexing="ij")]
            total = pa.array([int(x) for t in totals for x in t.ravel()], pa.decimal128(38, 0))
            own = np.zeros(len(total), np.int64)
            own[0] = looked
            yield batch({c: pa.array(x.astype(np.int32)) for c, x in zip(("part", "entry", "pos"), at, strict=True)} | {"total": total, "n": pa.array(np.repeat(counts.ravel(), width)), "looked": pa.array(own)}, len(total), carried_type)

    return state.mapInArrow(lean(run), schema)


@dataclass
class Codes:
    """``rows``: id, carried columns, code (a byte a part) and error; ``books``: the final entries a part; ``scans``: parts scanned in full each round."""

    rows: DataFrame
    books: list[np.ndarray]
    scans: list[int]


def compress(df: DataFrame, id_col: str, vector: Column, carry: list[str] | None = None, parts: int = 8, entries: int = 16, rounds: int = 6) -> Codes:
    """Fit codebooks on all rows and code every row with a vector; ``vector`` is an array of whole numbers, and rows where it is null are dropped.

    Codebooks start as the parts of the ``entries`` rows of smallest id (nulls last; equal ids by their vectors), or of all rows if there are fewer.
    Entries without rows stay as they are. Vectors shorter than the longest, or than a whole number of components a part, are padded with zeros.
    Repeated rows count each time. Errors beyond a long are held at its end. An empty table gives no rows and no entries.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte a part: entries must be 1 to 256")
    tables = Tables(df.sparkSession)
    carried = F.struct(*[F.col(f"`{c}`") for c in carry or []], F.lit(None).cast("int").alias("_")).alias("carried")
    rows = tables.cut(df.select(F.col(f"`{id_col}`").cast("long").alias("id"), carried, vector.cast("array<long>").alias("v")).where("v is not null"), "vectors")
    carried_type = rows.schema["carried"].dataType
    longest = rows.agg(F.max(F.size("v"))).first()[0]
    out = "id long, carried {0}, code binary, error long"
    if longest is None:
        return Codes(_uncarried(rows.select("id", "carried", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")), id_col, carry), [], [])
    width = max(1, -(-longest // parts)) * parts
    padded = F.when(F.size("v") == width, F.col("v")).otherwise(F.concat("v", F.array_repeat(F.lit(0).cast("long"), width - F.size("v"))))
    state = rows.withColumn("v", padded)
    first = state.orderBy(F.asc_nulls_last("id"), "v").select("v").limit(entries).collect()
    books = list(np.array([r.v for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2))
    schema = T.StructType([T.StructField("carried", carried_type) if f.name == "carried" else f for f in T._parse_datatype_string(STATE.format(carried="int")).fields])
    moved, scans, before = None, [], tables
    for _ in range(rounds):
        now = Tables(df.sparkSession)
        written = now.cut(lloyd_round(state, books, moved, schema), "round")
        before.drop()
        totals = written.where("part is not null").groupBy("part", "entry", "pos").agg(F.sum("total").alias("s"), F.sum("n").alias("n"), F.sum("looked").alias("k")).collect()
        fresh = [b.copy() for b in books]
        for r in totals:  # a row a component of the codebooks
            if r.n:
                fresh[r.part][r.entry, r.pos] = int(r.s) // r.n
        scans.append(sum(r.k for r in totals))
        moved = [Moved.of(old, new) for old, new in zip(books, fresh, strict=True)]
        books, state, before = fresh, written.where("part is null").drop("part", "entry", "pos", "total", "n", "looked"), now

    def finish(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                v, a, _, _, _ = _assigned(b, books, moved)
                error = [own_squared(v[:, p], books[p][a[:, p]]).astype(object) for p in range(parts)]
                error = pa.array([min(int(x), LONG) for x in sum(error)], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("carried"), pa.array([r.tobytes() for r in a.astype(np.uint8)], pa.binary()), error], names=["id", "carried", "code", "error"])

    final = T.StructType([T.StructField("carried", carried_type) if f.name == "carried" else f for f in T._parse_datatype_string(out.format("int")).fields])
    last = Tables(df.sparkSession)
    coded = last.cut(state.mapInArrow(lean(finish), final), "codes")
    before.drop()
    return Codes(_uncarried(coded, id_col, carry), books, scans)


def _uncarried(coded: DataFrame, id_col: str, carry: list[str] | None) -> DataFrame:
    return coded.select(F.col("id").alias(id_col), *[F.col("carried")[c].alias(c) for c in carry or []], "code", "error")


def decode(rows: DataFrame, books: list[np.ndarray], code: str = "code") -> DataFrame:
    """``rows`` with ``decoded``, the entries that their codes name, one after another; a null code gives null."""
    parts = [F.array(*[F.array(*[F.lit(int(x)).cast("long") for x in entry]) for entry in book]) for book in books]
    at = lambda p: F.conv(F.hex(F.substring(code, p + 1, 1)), 16, 10).cast("int")
    return rows.withColumn("decoded", F.concat(*[F.get(entries, at(p)) for p, entries in enumerate(parts)]))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings as 8 bytes each, 6 rounds; errors of rows and of labels, and a digest of the final entries."""
    rows = read(spark, sf_dir, "embeddings")
    codes = compress(rows, "vec_id", scaled(F.col("embedding")), ["label"])
    digest = hashlib.sha256(",".join(str(int(x)) for book in codes.books for entry in book for x in entry).encode()).hexdigest()
    held = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long")
    labels = codes.rows.groupBy(F.col("label").alias("_label")).agg(held.alias("label_error"))
    out = codes.rows.join(labels, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT row_id, vec_id, label, part, any_value(v) AS v, min(CAST(list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c) AS BIGINT) * {entries} + entry) AS best
  FROM p JOIN c{r} USING (part) GROUP BY ALL
)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT o.part, o.entry, coalesce(n.c, o.c) AS c FROM c{r} o LEFT JOIN (
    SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY pos) AS c FROM (
      SELECT part, best % {entries} AS entry, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT part, best, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM a{r}) GROUP BY ALL) GROUP BY ALL
  ) n ON n.part = o.part AND n.entry = o.entry
)""")
    joined = ",\n".join(steps)
    return f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, e) AS row_id, * FROM (
    SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(4096 * x)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0)
), p AS MATERIALIZED (
  SELECT row_id, vec_id, label, part, e[1 + part * (len(e) // {parts}) : (part + 1) * (len(e) // {parts})] AS v FROM k, (SELECT unnest(range({parts})) AS part)
), c0 AS MATERIALIZED (
  SELECT part, row_id - 1 AS entry, v AS c FROM p WHERE row_id <= {entries}
),
{joined},
e AS (
  SELECT row_id, vec_id, label, string_agg(printf('%02x', best % {entries}), '' ORDER BY part) AS code, CAST(sum(best // {entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY ALL
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM (SELECT part, entry, unnest(c) AS x, generate_subscripts(c, 1) AS pos FROM c{rounds})) AS codebooks_sha256
FROM e
"""


OP13_SQL = _sql()
