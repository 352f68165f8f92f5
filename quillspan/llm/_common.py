"""Shared helpers of the text operators: shared storage, hashing and graph components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import removed_with_session

# Worker functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__package__.split(".")[0]])

#: ASCII white space as the contracts define it: \x20 and \x09-\x0D.
ASCII_SPACE = b" \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a purely local session (as in tests) gets a temporary folder when the setting is absent; a
    cluster session without it is refused, because executor-local files cannot be read elsewhere.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not path and sc.getCheckpointDir() is not None:
        path = sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quillspan-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def run_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one; it is removed when the session stops, or else when the driver's Python ends."""
    path = f"{shared_dir(spark).rstrip('/')}/quillspan-{spark.sparkContext.applicationId}"
    removed_with_session(spark, path)
    return path


_MADE: list[str] = []


def scratch(spark: SparkSession, what: str) -> str:
    """A new path for a written table in this application's folder."""
    _MADE.append(f"{run_dir(spark)}/{what}-{uuid.uuid4().hex}")
    return _MADE[-1]


@contextlib.contextmanager
def scratch_removed(spark: SparkSession):
    """Remove the scratch tables that are made inside, once what reads them has been written elsewhere."""
    first = len(_MADE)
    yield
    remove(spark, *_MADE[first:])
    del _MADE[first:]


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Tables:
    """Written tables of one operator: ``cut`` writes a frame and reads it back, ``drop`` removes them again.

    A written table cuts the lineage and outlives executors, and its size is known to the planner.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def cut(self, df: DataFrame, what: str = "table") -> DataFrame:
        self.paths.append(scratch(self.spark, what))
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def bucketed(self, df: DataFrame, buckets: int, keys: list[str], what: str = "table", deal: bool = True) -> DataFrame:
        """``df`` as a written table, dealt and sorted by ``keys``, so that joins on them move only the other side.

        With ``deal`` false the rows must lie by these keys already. Only a catalog entry can declare
        buckets; it is dropped at once (the files stay), so no name is left behind.
        """
        name = f"quillspan_{uuid.uuid4().hex}"
        self.paths.append(scratch(self.spark, what))
        df = df.repartition(buckets, *keys) if deal else df
        df.write.option("compression", "zstd").bucketBy(buckets, *keys).sortBy(*keys).option("path", self.paths[-1]).saveAsTable(name)
        out = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")
        return out

    def drop(self) -> None:
        remove(self.spark, *self.paths)
        self.paths = []


def free_shuffles(spark: SparkSession) -> None:
    """Let the driver collect what nothing refers to any more: Spark then deletes the files of finished exchanges."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def settle_executors(spark: SparkSession) -> None:
    """Have the executors collect their garbage now, before a stage that needs room beside Spark's heap.

    Heap that earlier stages grew goes back to the system, and with it buffers outside the heap whose owners are gone. A task a core asks for it, so an
    executor may be missed or asked twice; either changes no result.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a written table, which stays until the application ends."""
    return Tables(df.sparkSession).cut(df)


def unused(names: list[str], *wanted: str) -> list[str]:
    """``wanted`` as column names that clash with none of ``names`` (letter case aside)."""
    taken, out = {n.lower() for n in names}, []
    for w in wanted:
        while w.lower() in taken:
            w += "_"
        taken.add(w.lower())
        out.append(w)
    return out


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column | str) -> Column:
    """True where crc32 of the id as text leaves remainder 1 by 3; a null id counts as ''."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def chance(*columns: str) -> Column:
    """A number from 0 to below 1 by a hash of the columns, in steps of 2**-53, so that any share of any number of rows can be asked for."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(2.0**53)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(column: pa.Array, limit: int) -> list[tuple[int, int]]:
    """Ranges of rows that hold about ``limit`` bytes of text each (a longer text is alone), so that a worker's arrays stay small."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    cuts = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(ends // limit)) + 1, [len(ends)]])).tolist()
    return list(zip(cuts, cuts[1:], strict=False))


def modest_batches(spark: SparkSession, rows: int = 4000) -> None:
    """Whole texts go to workers ``rows`` a batch unless the session asks for another number than Spark's default.

    A batch is held several times over, by the executor and by its worker; the number changes no result. A number that the session or its configuration sets
    itself, whatever it is, stays. The setting is read when a lazy plan runs, so it cannot be taken back here.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not spark._jsparkSession.sessionState().conf().contains(name):
        spark.conf.set(name, str(rows))


def _hand_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries than glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(run):
    """``run`` for ``mapInArrow``; its worker hands the memory that it no longer uses back to the system, now and then and when a task ends.

    Workers outlive stages, and what one stage left in their heaps would count against the next.
    """

    def wrapped(batches):
        try:
            for k, out in enumerate(run(batches), 1):
                yield out
                if k % 8 == 0:
                    _hand_back()
        finally:
            gc.collect()
            _hand_back()

    return wrapped


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph, as (node, component = smallest node).

    Alternates the large-star and small-star contractions: every step is a map-side combined minimum
    and an equi-join whose one side holds a single row a node, so a hub's edges are split by the
    adaptive skew join. Each round is written and the round before removed; only a count and a checksum
    reach the driver. ``edges`` has long columns ``src`` and ``dst``; loops and repeats are ignored.
    """
    spark = edges.sparkSession
    e = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    now, last = Tables(spark), None
    e = now.cut(e, "edges")
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, now = now, Tables(spark)
        e = now.cut(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        before.drop()
        sign = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if sign == last:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v")).distinct())
        last = sign
    raise RuntimeError("components did not settle")
