"""Exact ranks and quantiles without a buffer or a task that grows with the distinct values."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import stored, work_folder


def cumulative_counts(values: DataFrame, keys: list[str], value: str, folder: str | None = None, weight: str | None = None) -> DataFrame:
    """``keys``, ``value``, ``n`` (its rows), ``before`` (rows of the group with a smaller value) and ``total`` (rows of the group).

    With ``weight`` a row stands for that many (a whole number). Rows are first counted a distinct value, with partial counts where they lie, so equal values weigh no more than one. The counts
    are dealt out by ranges of (keys, value) and written; sums a range go before running sums within each. Nulls
    are the smallest value (for quantiles leave them out); NaN is the largest and -0.0 equals 0.0, as in all of Spark's ordering. No rows give no rows.
    """
    spark, name = values.sparkSession, uuid.uuid4().hex
    folder = folder or work_folder(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = values.groupBy(*keys, value).agg((F.sum(weight) if weight else F.count("*")).cast("long").alias("n")).repartitionByRange(parts, *keys, value).sortWithinPartitions(*keys, value)
    counts = stored(counts.withColumn("_range", F.shiftright(F.monotonically_increasing_id(), 33)), folder, f"counts-{name}")
    sums = counts.groupBy(*keys, "_range").agg(F.sum("n").alias("_sum"))  # a row a range and group
    group = Window.partitionBy(*keys)
    sums = sums.select(*keys, "_range", (F.sum("_sum").over(group.orderBy("_range")) - F.col("_sum")).alias("_offset"), F.sum("_sum").over(group).alias("total"))
    running = F.sum("n").over(Window.partitionBy("_range", *keys).orderBy(value)) - F.col("n")
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"s.{k}")) for k in [*keys, "_range"]]
    joined = counts.withColumn("_running", running).alias("c").join(sums.alias("s"), same)
    return joined.select(*[f"c.{k}" for k in [*keys, value, "n"]], (F.col("_offset") + F.col("_running")).alias("before"), "total")


def melted(rows: DataFrame, columns: list[str], keys: list[str], weight: str | None = None) -> DataFrame:
    """A row a value: ``keys``, ``column``, ``value`` in doubles (nulls left out) and the weight."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    own = [*keys, *([weight] if weight else [])]
    return rows.select(*own, F.explode(pairs).alias("_x")).select(*own, "_x.*").where("value is not null")


def at_shares(counts: DataFrame, shares: list[float], keys: list[str]) -> DataFrame:
    """``keys``, ``share`` and ``value``: the interpolated quantiles of counts that ``cumulative_counts`` made."""
    wanted = counts.withColumn("share", F.explode(F.array(*[F.lit(float(q)) for q in shares])))
    at = F.col("share") * (F.col("total") - 1)
    low, high = F.floor(at), F.ceil(at)
    end = F.col("before") + F.col("n")
    within = lambda i: (F.col("before") <= i) & (i < end)
    ends = wanted.where(within(low) | within(high)).groupBy(*keys, "share").agg(
        F.max("total").alias("total"), F.min(F.when(within(low), F.col("value"))).alias("_low"), F.min(F.when(within(high), F.col("value"))).alias("_high")
    )
    return ends.select(*keys, "share", F.when((low == high) | (F.col("_low") == F.col("_high")), F.col("_low")).otherwise((high - at) * F.col("_low") + (at - low) * F.col("_high")).alias("value"))


def quantiles(rows: DataFrame, columns: list[str], shares: list[float], keys: list[str] | None = None, folder: str | None = None, weight: str | None = None) -> DataFrame:
    """Exact interpolated quantiles of numeric ``columns`` a group: ``keys``, ``column``, ``share`` and ``value`` in doubles.

    Equal to Spark's ``percentile`` bit for bit. Nulls do not count; a group and column without values has no row.
    """
    by = [*(keys or []), "column"]
    return at_shares(cumulative_counts(melted(rows, columns, keys or [], weight), by, "value", folder, weight), shares, by)


def wide_quantiles(rows: DataFrame, columns: list[str], shares: list[float], name=lambda c, q: f"{c}_q{q:g}", keys: list[str] | None = None, folder: str | None = None, weight: str | None = None) -> DataFrame:
    """The same with a row a group and a column a (column, share); groups without any value are absent, and without ``keys`` there is always one row."""
    got = quantiles(rows, columns, shares, keys, folder, weight)
    picked = lambda c, q: F.max(F.when((F.col("column") == c) & (F.col("share") == float(q)), F.col("value"))).alias(name(c, q))
    return got.groupBy(*(keys or [])).agg(*[picked(c, q) for c in columns for q in shares])


def clipped_scale(rows: DataFrame, columns: list[str], low: float, high: float, keys: list[str] | None = None) -> DataFrame:
    """A row a group: of each column its two quantiles (``_lo_``, ``_hi_``) and the mean and deviation of the column clipped at them (``_m_``, ``_s_``).

    One pass over the rows counts their values; all else is taken from the counts.
    """
    keys = keys or []
    stats = scale_of_values(melted(rows, columns, keys), low, high, keys)
    return stats.groupBy(*keys).agg(*[F.max(F.when(F.col("column") == c, F.col(k))).alias(f"_{k}_{c}") for c in columns for k in ("lo", "hi", "m", "s")])


def scale_of_values(values: DataFrame, low: float, high: float, keys: list[str], weight: str | None = None) -> DataFrame:
    """The same with a row a (``keys``, column) of melted values, whose weights say how many rows they stand for: lo, hi, m, s."""
    by, folder = [*keys, "column"], work_folder(values.sparkSession)
    counts = stored(cumulative_counts(values, by, "value", folder, weight), folder, f"ranked-{uuid.uuid4().hex}")
    ends = at_shares(counts, [low, high], by).groupBy(*by).agg(F.max(F.when(F.col("share") == low, F.col("value"))).alias("lo"), F.max(F.when(F.col("share") == high, F.col("value"))).alias("hi"))
    x = counts.join(ends, by).withColumn("v", F.least(F.greatest("value", "lo"), F.col("hi")))
    means = x.groupBy(*by).agg((F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("m"))
    square = F.sum(F.col("n") * (F.col("v") - F.col("m")) * (F.col("v") - F.col("m")))
    return x.join(means, by).groupBy(*by, "lo", "hi", "m").agg(F.sqrt(F.try_divide(square, F.sum("n") - 1)).alias("s"))


def model_scales(rows: DataFrame, columns: list[str], models: str, low: float = 0.05, high: float = 0.95) -> dict[str, dict[str, tuple]]:
    """Of each model in the rows' array of models, and of each column, (lo, hi, m, s) as of ``clipped_scale``; values are counted before they are dealt to their models."""
    counted = melted(rows, columns, [models]).groupBy(models, "column", "value").agg(F.count("*").alias("_w"))
    each = counted.select(F.explode(models).alias("_model"), "column", "value", "_w")
    out: dict[str, dict[str, tuple]] = {}
    for r in scale_of_values(each, low, high, ["_model"], "_w").collect():  # a row a (model, column)
        out.setdefault(r._model, {})[r["column"]] = (r.lo, r.hi, r.m, r.s)
    return out
