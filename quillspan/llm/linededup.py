"""Line dedup over levelled sorted runs of line hashes.

Documents are taken in batches. A run is a table of (128-bit line key, number of documents), bucketed
and sorted by key; one exchange makes the first runs of all batches. Each batch is merge-anti-joined with the settled runs
(keys already known to have reached the threshold) and the rest is a run of level 0; whenever a level
holds two runs they are merged by their order into one of the next level, bucket by bucket and without an exchange, and keys
that reach the threshold move to a settled run. Unsettled runs are not anti-joined, as their keys must be counted on to
the threshold. The number of batches grows with the logarithm of the rows, so that compaction recurs and jobs
stay few. A last compaction leaves exactly the keys found in enough documents.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import ASCII_SPACE, Tables, cut, lean, partitions, read, settle_executors, slices, unused

KEY = ["h1", "h2"]
SLICE = 1 << 23  # bytes of text taken apart at once


def line_keys(text: str | None, min_chars: int = 1) -> tuple[list[bytes], list[bytes | None]]:
    """Lines of a text as bytes, and the 16-byte key of each (None where the key is too short)."""
    lines = (text or "").encode().split(b"\n")
    keys = [x.strip(ASCII_SPACE).lower() for x in lines]  # bytes.lower() changes A-Z alone
    long_enough = (lambda k: len(k) >= min_chars) if min_chars <= 1 else (lambda k: len(k.decode()) >= min_chars)
    return lines, [xxhash.xxh3_128_digest(k) if long_enough(k) else None for k in keys]


def _halves(digests) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


class LineRuns:
    """The runs. ``ingest`` takes batches of (h1, h2, n) with one row a key; ``settle`` returns the frequent keys.

    A run is a frame and the tables that hold it. Batches that already lie by key in ``buckets``
    buckets are taken as they are (``dealt``).
    """

    def __init__(self, spark: SparkSession, min_docs: int, buckets: int | None = None):
        self.spark, self.min_docs = spark, min_docs
        self.buckets = buckets or buckets_of(spark)
        self.levels: dict[int, list[tuple[DataFrame, Tables]]] = {}
        self.settled: list[tuple[DataFrame, Tables]] = []

    def _write(self, df: DataFrame, deal: bool = False) -> tuple[DataFrame, Tables]:
        tables = Tables(self.spark)
        return tables.bucketed(df.select(*KEY, "n"), self.buckets, KEY, "run", deal), tables

    def ingest(self, batch: DataFrame, dealt: bool = False) -> None:
        if not dealt:
            batch = self._write(batch, True)[0]
        for run, _ in self.settled:
            batch = batch.join(run.select(*KEY).hint("merge"), KEY, "left_anti")
        self.levels.setdefault(0, []).append(self._write(batch) if self.settled else (batch, Tables(self.spark)))
        level = 0
        while len(self.levels.get(level, [])) >= 2:
            self._compact(level)
            level += 1

    def _merge(self, runs) -> DataFrame:
        """The sums of two runs, by a merge join of their buckets; a third run, of another level, needs an exchange."""
        total = runs[0][0]
        for run, _ in runs[1:]:
            other = run.select(*KEY, F.col("n").alias("m"))
            total = total.join(other.hint("merge"), KEY, "full_outer").select(*KEY, (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
        return total

    def _compact(self, level: int) -> None:
        runs = self.levels.pop(level)
        merged, tables = self._write(self._merge(runs))
        for _, t in runs:
            t.drop()
        reached = merged.where(F.col("n") >= self.min_docs)
        if reached.limit(1).count():
            self.settled.append(self._write(reached))
            if len(self.settled) > 2:  # a batch meets few settled runs
                old, self.settled = self.settled[-2:], self.settled[:-2]
                self.settled.append(self._write(self._merge(old)))
                for _, t in old:
                    t.drop()
        self.levels.setdefault(level + 1, []).append((merged.where(F.col("n") < self.min_docs), tables))

    def settle(self) -> DataFrame:
        """Compact everything; (h1, h2) of the keys found in at least ``min_docs`` documents."""
        runs = [r for _, level in sorted(self.levels.items()) for r in level]
        keys = self._merge(runs).where(F.col("n") >= self.min_docs).select(*KEY)
        for run, _ in self.settled:
            keys = keys.union(run.select(*KEY))
        keys = cut(keys.distinct())
        for _, t in runs + self.settled:
            t.drop()
        self.levels, self.settled = {}, []
        return keys


def buckets_of(spark: SparkSession) -> int:
    return min(partitions(spark), 4096)


def batches_for(rows: int) -> int:
    """Batches of an input: 4 at least, two more for each doubling beyond 10,000 rows."""
    return max(4, 2 * math.ceil(math.log2(1 + rows / 10_000)))


def frequent_keys(docs: DataFrame, min_docs: int, min_chars: int, n_batches: int, text_col: str = "text") -> DataFrame:
    """(h1, h2) of every key of at least ``min_chars`` code points in at least ``min_docs`` rows."""
    spark = docs.sparkSession

    def count(batches):
        for b in batches:
            counts = [Counter() for _ in range(n_batches)]
            for i, j in slices(b.column(0), SLICE):
                for k, text in enumerate(b.column(0).slice(i, j - i).to_pylist(), i):
                    keys = set(line_keys(text, min_chars)[1])
                    keys.discard(None)
                    counts[k % n_batches].update(keys)
            for k, c in enumerate(counts):
                if c:
                    h1, h2 = _halves(c)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), k, np.int32)), pa.array(h1), pa.array(h2), pa.array(np.fromiter(c.values(), np.int64, len(c)))], names=["batch", "h1", "h2", "n"])

    tables, runs = Tables(spark), LineRuns(spark, min_docs)
    rows = docs.select(F.col(f"`{text_col}`")).mapInArrow(lean(count), "batch int, h1 long, h2 long, n long").repartition(runs.buckets, *KEY)
    rows = rows.groupBy("batch", *KEY).agg(F.sum("n").alias("n"))  # lies by key already
    every = tables.bucketed(rows.sortWithinPartitions("batch", *KEY), runs.buckets, KEY, "lines", deal=False)
    for k in range(n_batches):
        runs.ingest(every.where(F.col("batch") == k).select(*KEY, "n"), dealt=True)
    keys = runs.settle()
    tables.drop()
    return keys


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, n_batches: int | None = None, text_col: str = "text", broadcast_keys: int = 300_000) -> DataFrame:
    """``docs`` with the frequent lines taken out of ``text_col``, plus two last columns, ``_n_lines`` and ``_n_dropped``.

    A document is a row, also one that repeats another. Null text counts as one empty line and stays null when nothing is dropped;
    empty keys are never frequent when ``min_chars`` is 1 or more; a text may be of any length; an empty table stays empty. Should the input have
    columns of those two names, the added ones get underscores at their end until they differ. Up to ``broadcast_keys`` frequent
    keys (16 bytes each) are broadcast after counting them; more are joined by a shuffle on the lines
    and then on a 128-bit hash of the text. Both ways give the same rows.
    """
    spark = docs.sparkSession
    n_batches = n_batches or batches_for(docs.count())
    keys = frequent_keys(docs, min_docs, min_chars, n_batches, text_col)
    at, names = docs.columns.index(text_col), docs.columns
    n_lines_, n_dropped_, t1_, t2_, hits_ = unused(names, "_n_lines", "_n_dropped", "_t1", "_t2", "_hits")
    schema = T.StructType([*docs.schema.fields, T.StructField(n_lines_, T.LongType()), T.StructField(n_dropped_, T.LongType())])

    def rewrite(b, heavy_of):
        for start, end in slices(b.column(at), SLICE):
            part, texts, n_lines, n_dropped = b.slice(start, end - start), [], [], []
            for i, text in enumerate(part.column(at).to_pylist(), start):
                lines, digests = line_keys(text, min_chars)
                heavy = heavy_of(i)
                kept = [x for x, d in zip(lines, digests, strict=True) if d is None or d not in heavy] if heavy else lines
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
                texts.append(text if len(kept) == len(lines) else b"\n".join(kept).decode())
            cols = [pa.array(texts, pa.string()) if k == at else part.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*names, n_lines_, n_dropped_])

    if keys.count() <= broadcast_keys:
        got = keys.toArrow()
        h1, h2 = got.column("h1").to_numpy(), got.column("h2").to_numpy()
        raw = np.stack([h1, h2], axis=1).astype("<i8").tobytes()
        shared = spark.sparkContext.broadcast(raw)

        def by_broadcast(batches):
            raw = shared.value
            heavy = {raw[i : i + 16] for i in range(0, len(raw), 16)}
            for b in batches:
                yield from rewrite(b, lambda i: heavy)

        return docs.mapInArrow(lean(by_broadcast), schema)

    def spread(batches):
        for b in batches:
            for start, end in slices(b.column(2), SLICE):
                t, d = [], []
                for i, text in enumerate(b.column(2).slice(start, end - start).to_pylist(), start):
                    own = set(line_keys(text, min_chars)[1]) - {None}
                    t += [i] * len(own)
                    d += own
                h1, h2 = _halves(d)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(t, pa.int64())), b.column(1).take(pa.array(t, pa.int64())), pa.array(h1), pa.array(h2)], names=["t1", "t2", "h1", "h2"])

    text = F.col(f"`{text_col}`")
    t1, t2 = F.xxhash64(text), F.xxhash64(text, F.lit(1))
    lines = docs.select(t1.alias("t1"), t2.alias("t2"), text.alias("text")).mapInArrow(lean(spread), "t1 long, t2 long, h1 long, h2 long")
    hits = lines.join(keys, KEY).groupBy(F.col("t1").alias(t1_), F.col("t2").alias(t2_)).agg(F.collect_set(F.struct(*KEY)).alias(hits_))
    own = [F.col(f"`{c}`") for c in names]
    joined = docs.select(*own, t1.alias(t1_), t2.alias(t2_)).join(hits, [t1_, t2_], "left").select(*own, hits_)

    def by_join(batches):
        for b in batches:
            sets = [{np.array([x["h1"], x["h2"]], "<i8").tobytes() for x in hits or ()} for hits in b.column(len(names)).to_pylist()]
            yield from rewrite(b, lambda i, sets=sets: sets[i])

    return joined.mapInArrow(lean(by_join), schema)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines found in 10 or more documents are dropped from every document; digests of what stays."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = drop_frequent_lines(docs, min_docs=10, min_chars=1)
    kept = F.coalesce("text", F.lit(""))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(kept, 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), frequent AS (
  SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (f.k IS NOT NULL) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (f.k IS NULL), '')) AS kept_sha256
FROM lines l LEFT JOIN frequent f ON l.k = f.k GROUP BY doc_id
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: frequent lines leave the texts; ``n_chars`` follows (null for a null text); every document stays, with its own columns, repeated ones too (as in ``drop_frequent_lines``)."""
    settle_executors(spark)
    out = drop_frequent_lines(docs, min_docs=10, min_chars=1)
    columns = [F.length("text").cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*columns)
