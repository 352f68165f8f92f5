"""Multidimensional clustered layout: rows in z-order over rank coordinates, in files of equal size, and what a query box would touch.

Coordinates are cuts of the exact global order of each dimension: only ``2**bits - 1`` cut values a dimension are carried to the rows.
Rows are dealt out by ranges of (z, id) with a random last key, so that neither a full cell nor a repeated id makes a large
task; sums a range turn places within a range into global positions. Files with identical bounds become one weighted box, and boxes meet the
occupied cells that queries come from in blocks of numpy comparisons in Arrow batches, grouped by the coordinates that a query fixes. A file of many rows
lies mostly in one cell: such files are counted a cell, and only files over several cells keep distinct cell-file pairs for matching. As files are
runs of the z-order, neither boxes nor pairs of that kind can be more than twice the cells of the grid, however large the input.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.quantiles import cumulative_counts
from ._common import Tables, partitions, read, scratch, unused

BLOCK = 1 << 22  # comparisons of a box with a cell at once
SMALL_GRID = 1 << 16  # cells of a grid whose results, 24 bytes a cell, may be broadcast


def order_key(column: Column, kind: str) -> Column:
    """A string that sorts by its bytes as ``column`` sorts, nulls first: strings behind a mark, whole numbers as sixteen hex digits."""
    if kind == "string":
        return F.coalesce(F.concat(F.lit("\x01"), column), F.lit(""))
    return F.coalesce(F.lpad(F.hex(column.cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0"), F.lit(""))


@dataclass
class Layout:
    """``rows``: id, one coordinate a dimension, z, position and file, beside the input's carried columns; ``pairs``: distinct (file, z) with its coordinates."""

    rows: DataFrame
    pairs: DataFrame
    dims: list[str]
    bits: int
    tables: Tables


def decoded(z: Column, dims: list[str], order: list[str], bits: int) -> list[Column]:
    """The coordinates of ``dims`` from a z value; ``order`` is the order of dimensions within a round of digits."""
    out = []
    for d in dims:
        at = [(bits - 1 - r) * len(order) + len(order) - 1 - order.index(d) for r in range(bits)]  # places of its digits, highest first
        digits = [F.shiftleft(F.shiftright(z, p).bitwiseAND(F.lit(1)), bits - 1 - r) for r, p in enumerate(at)]
        out.append(_sum(digits).cast("int").alias(d))
    return out


def interleaved(coordinates: dict[str, Column], order: list[str], bits: int) -> Column:
    parts = [F.shiftleft(F.shiftright(coordinates[d].cast("long"), b).bitwiseAND(F.lit(1)), b * len(order) + len(order) - 1 - i) for b in range(bits) for i, d in enumerate(order)]
    return _sum(parts)


def _sum(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def cut_values(narrow: DataFrame, dims: list[str], total: int, bits: int, folder: str) -> dict[str, list[str]]:
    """For each dimension the values that coordinates 1, 2, ... lie above: at most ``2**bits - 1`` order statistics, exact.

    A value has at least c * total / 2**bits smaller rows just when it is above the row of that rank (less one) in order.
    """
    cells = 1 << bits
    melted = narrow.select(F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), F.col(d).alias("key")) for i, d in enumerate(dims)])).alias("x")).select("x.*")
    ranks = F.array(*[F.struct(F.lit(c).alias("c"), F.lit((c * total + cells - 1) // cells - 1).cast("long").alias("rank")) for c in range(1, cells)])
    counts = cumulative_counts(melted, ["dim"], "key", folder).withColumn("r", F.explode(ranks))
    got = counts.where("before <= r.rank AND r.rank < before + n").select("dim", "r.c", "key").collect()  # at most dims * (cells - 1) rows
    return {d: [r.key for r in sorted(got, key=lambda r: r.c) if r.dim == i] for i, d in enumerate(dims)}


def cluster(df: DataFrame, id_col: str, dims: dict[str, tuple[Column, str]], order: list[str], bits: int = 4, file_rows: int = 500, carry: list[str] | None = None) -> Layout:
    """Lay the rows out by z, then ``id_col``; ``dims`` gives each dimension's value and kind ("string" or "long").

    Every row of ``df`` gets a place, repeated rows too; equal ids within a cell are in any order. Nulls are the smallest value of a dimension and
    the smallest id. Strings compare by their UTF-8 bytes and may be long (the cuts are carried whole). An empty table gives no rows. Only the id, the
    dimensions and the columns named in ``carry`` are kept.
    """
    spark, tables, names = df.sparkSession, Tables(df.sparkSession), list(dims)
    carry = carry or []
    salt_, range_, place_, id_ = unused([*names, *carry, "z", "position", "file"], "_salt", "_range", "_place", "_id")
    keys = [order_key(c, kind).alias(n) for n, (c, kind) in dims.items()]
    narrow = tables.cut(df.select(F.col(f"`{id_col}`").alias(id_), *[F.col(f"`{c}`") for c in carry], *keys, F.rand(11).alias(salt_)), "narrow")
    total = narrow.count()
    cuts = cut_values(narrow, names, total, bits, scratch(spark, "cuts"))
    coordinate = {d: _sum([F.lit(0), *[(F.col(d) > F.lit(t)).cast("int") for t in cuts[d]]]) for d in names}
    coded = narrow.select(id_, *carry, *[c.alias(d) for d, c in coordinate.items()], salt_).withColumn("z", interleaved({d: F.col(d) for d in names}, order, bits))
    placed = coded.repartitionByRange(partitions(spark), "z", id_, salt_).sortWithinPartitions("z", id_, salt_).drop(salt_)
    placed = tables.cut(placed.withColumn(place_, F.monotonically_increasing_id()).withColumns({range_: F.shiftright(place_, 33), place_: F.col(place_).bitwiseAND(F.lit((1 << 33) - 1))}), "placed")
    sizes = placed.groupBy(range_).agg(F.count("*").alias("_n"))  # one row a partition of the shuffle
    offsets = sizes.select(range_, (F.sum("_n").over(Window.orderBy(range_)) - F.col("_n")).alias("_before"))
    rows = placed.join(F.broadcast(offsets), range_).withColumn("position", F.col("_before") + F.col(place_))
    rows = rows.withColumn("file", F.floor(F.col("position") / file_rows)).select(F.col(id_).alias(id_col), *carry, *names, "z", "position", "file")
    pairs = rows.groupBy("file", "z").agg(F.count("*").alias("n")).select("file", "z", "n", *decoded(F.col("z"), names, order, bits))
    return Layout(rows, tables.cut(pairs, "pairs"), names, bits, tables)


def file_bounds(layout: Layout) -> DataFrame:
    """A row a file: its rows, its number of cells and the least and largest coordinate of each dimension (``lo_<dim>``, ``hi_<dim>``)."""
    ends = [f(d).alias(f"{n}_{d}") for d in layout.dims for n, f in (("lo", F.min), ("hi", F.max))]
    return layout.pairs.groupBy("file").agg(F.sum("n").alias("rows"), F.count("*").alias("cells"), *ends)


def touched(layout: Layout, files: DataFrame, reach: dict[str, int]) -> DataFrame:
    """(z, files_touched) of every occupied cell: the files whose bounds meet the box of ``reach`` steps around the cell.

    A group is a cell's fixed coordinates (those of reach 0): a box goes to each group within its bounds, so a group holds at most the grid's cells of
    that kind and at most twice the grid's cells as boxes.
    """
    dims = layout.dims
    fixed, free = [d for d in dims if not reach.get(d)], [d for d in dims if reach.get(d)]
    boxes = files.groupBy(*[f"{e}_{d}" for d in dims for e in ("lo", "hi")]).agg(F.count("*").alias("weight"))
    for d in fixed:
        boxes = boxes.withColumn(d, F.explode(F.sequence(f"lo_{d}", f"hi_{d}")))
    group = fixed or ["_all"]
    cells = layout.pairs.select("z", *dims).distinct()
    if not fixed:
        cells, boxes = cells.withColumn("_all", F.lit(0)), boxes.withColumn("_all", F.lit(0))
    steps = [reach[d] for d in free]

    def meet(own: pa.Table, with_boxes: pa.Table) -> pa.Table:
        column = lambda t, c: t.column(c).to_numpy()
        n, m = own.num_rows, with_boxes.num_rows
        at = [column(own, d) for d in free]
        lo, hi = [column(with_boxes, f"lo_{d}") for d in free], [column(with_boxes, f"hi_{d}") for d in free]
        weight, counts = column(with_boxes, "weight"), np.zeros(n, np.int64)
        wide = max(1, BLOCK // max(1, n))
        for first in range(0, m, wide):
            part = slice(first, first + wide)
            hit = np.ones((n, len(weight[part])), bool)
            for x, a, b, step in zip(at, lo, hi, steps, strict=True):
                hit &= (a[part] <= x[:, None] + step) & (b[part] >= x[:, None] - step)
            counts += hit @ weight[part]
        return pa.table({"z": own.column("z"), "files_touched": pa.array(counts)})

    return cells.groupBy(*group).cogroup(boxes.groupBy(*group)).applyInArrow(meet, "z long, files_touched long")


def matching(layout: Layout, files: DataFrame, order: list[str], reach: dict[str, int]) -> DataFrame:
    """(z, files_matching) of every occupied cell: the files that hold a row inside the box of ``reach`` steps around the cell.

    Files within one cell are counted a cell; others bring their distinct cells, and count once a query cell.
    """
    dims, limit = layout.dims, (1 << layout.bits) - 1
    pairs = layout.pairs.join(files.select("file", "cells").hint("merge"), "file")
    single = pairs.where("cells = 1").groupBy("z", *dims).agg(F.count("*").alias("n"))
    several = pairs.where("cells > 1").select("file", "z", *dims)

    def around(df: DataFrame) -> DataFrame:
        """Rows once for each query cell whose box their cell is in."""
        for d in dims:
            if r := reach.get(d):
                df = df.withColumn(d, F.explode(F.sequence(F.greatest(F.col(d) - r, F.lit(0)), F.least(F.col(d) + r, F.lit(limit)))))
        return df.withColumn("z", interleaved({d: F.col(d) for d in dims}, order, layout.bits))

    alone = around(single).groupBy("z").agg(F.sum("n").alias("n"))
    shared = around(several).select("z", "file").distinct().groupBy("z").agg(F.count("*").alias("n"))
    counts = alone.unionByName(shared).groupBy("z").agg(F.sum("n").alias("files_matching"))
    return layout.pairs.select("z").distinct().join(counts, "z")


def pruning(layout: Layout, order: list[str], reach: dict[str, int]) -> DataFrame:
    """Every row with ``file_bounds`` and what the query box around it touches and matches."""
    files = layout.tables.cut(file_bounds(layout), "files")
    cells = layout.tables.cut(touched(layout, files, reach).join(matching(layout, files, order, reach), "z"), "cells")
    bounds = F.concat_ws(",", *[F.col(f"{e}_{d}").cast("string") for d in layout.dims for e in ("lo", "hi")])
    rows = layout.rows.join(files.select("file", bounds.alias("file_bounds")).hint("merge"), "file")
    small = 1 << (layout.bits * len(layout.dims)) <= SMALL_GRID
    return rows.join(F.broadcast(cells) if small else cells, "z")


def write_files(df: DataFrame, layout: Layout, id_col: str, path: str, files_a_task: int = 64) -> DataFrame:
    """Write ``df`` as the layout's files under ``path``/data and their bounds under ``path``/bounds; returns the bounds.

    Ids must be distinct and not null here. Tasks take whole files in order, and each of them comes out as one Parquet file.
    """
    spark = df.sparkSession
    file_ = unused(df.columns, "file")[0]
    rows = df.join(layout.rows.select(F.col(id_col).alias("_layout_id"), F.col("position").alias("_position"), F.col("file").alias(file_)), F.col(f"`{id_col}`") == F.col("_layout_id")).drop("_layout_id")
    tasks = max(1, math.ceil(layout.rows.agg(F.coalesce(F.max("file"), F.lit(-1)) + 1).first()[0] / files_a_task))
    dealt = rows.repartitionById(tasks, F.floor(F.col(file_) / files_a_task).cast("int")).sortWithinPartitions(file_, "_position").drop("_position")
    dealt.write.partitionBy(file_).parquet(f"{path}/data")
    file_bounds(layout).write.parquet(f"{path}/bounds")
    return spark.read.parquet(f"{path}/bounds")


def read_box(spark: SparkSession, path: str, box: dict[str, tuple[int, int]], file_col: str = "file") -> DataFrame:
    """Rows of the written files whose bounds meet ``box`` (coordinates, both ends included): the bounds are joined first, so other files are not opened."""
    meets = [(F.col(f"lo_{d}") <= hi) & (F.col(f"hi_{d}") >= lo) for d, (lo, hi) in box.items()]
    bounds = spark.read.parquet(f"{path}/bounds")
    for m in meets:
        bounds = bounds.where(m)
    return spark.read.parquet(f"{path}/data").join(bounds.select(F.col("file").alias(file_col)), file_col, "left_semi")


DIMS = ["source", "lang", "length", "date"]
ORDER = ["length", "source", "date", "lang"]
REACH = {"length": 2, "date": 2}


def document_dims() -> dict[str, tuple[Column, str]]:
    date = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 365  # a null id counts as ''
    return {"source": (F.col("source"), "string"), "lang": (F.col("lang"), "string"), "length": (F.coalesce(F.octet_length("text").cast("long"), F.lit(-1)), "long"), "date": (date, "long")}


def op11_clustered_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in z-order of source, lang, length and date, 500 a file; a row's query fixes source and lang and reaches two steps in length and date."""
    layout = cluster(read(spark, sf_dir, "documents"), "doc_id", document_dims(), ORDER)
    out = pruning(layout, ORDER, REACH)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "z", "position", "file", "files_touched", "files_matching", "file_bounds")


_Z = " + ".join(f"(((c_{d} >> {b}) & 1) << {4 * b + 3 - i})" for b in range(4) for i, d in enumerate(ORDER))
_CRC = "xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT)), lambda c, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda r, i: xor(r >> 1, 3988292384 * (r & 1)), xor(c, b)), 4294967295), 4294967295)"

OP11_SQL = f"""
WITH v AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, source, lang, coalesce(strlen(text), -1) AS length, {_CRC} % 365 AS date FROM documents
), c AS (
  SELECT doc_id, {", ".join(f"CAST(floor(16 * (rank() OVER (ORDER BY {d} NULLS FIRST) - 1) / count(*) OVER ()) AS BIGINT) AS c_{d}" for d in DIMS)} FROM v
), z AS (
  SELECT *, CAST({_Z} AS BIGINT) AS z FROM c
), p AS (
  SELECT *, row_number() OVER (ORDER BY z, doc_id) - 1 AS position FROM z
), f AS (
  SELECT *, position // 500 AS file FROM p
), b AS (
  SELECT file, {", ".join(f"min(c_{d}) AS lo_{d}, max(c_{d}) AS hi_{d}" for d in DIMS)} FROM f GROUP BY file
), q AS (
  SELECT DISTINCT z, c_source, c_lang, c_length, c_date FROM f
), t AS (
  SELECT q.z, count(*) AS files_touched FROM q JOIN b ON c_source BETWEEN lo_source AND hi_source AND c_lang BETWEEN lo_lang AND hi_lang
    AND lo_length <= c_length + 2 AND hi_length >= c_length - 2 AND lo_date <= c_date + 2 AND hi_date >= c_date - 2 GROUP BY q.z
), m AS (
  SELECT q.z, count(DISTINCT f.file) AS files_matching FROM q JOIN f ON q.c_source = f.c_source AND q.c_lang = f.c_lang
    AND abs(q.c_length - f.c_length) <= 2 AND abs(q.c_date - f.c_date) <= 2 GROUP BY q.z
)
SELECT f.doc_id, f.z, CAST(f.position AS BIGINT) AS position, CAST(f.file AS BIGINT) AS file, files_touched, files_matching,
  concat_ws(',', {", ".join(f"lo_{d}, hi_{d}" for d in DIMS)}) AS file_bounds
FROM f JOIN b USING (file) JOIN t ON t.z = f.z JOIN m ON m.z = f.z
"""
