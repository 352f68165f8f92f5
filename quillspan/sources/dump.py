"""The XML dump of a question-and-answer site as typed tables, and the partitioned sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import body_metrics, title_metrics
from .files import write_text

#: Attributes of each file's rows and their types.
FIELDS = {
    "posts": "Id bigint, PostTypeId int, CreationDate timestamp_ntz, OwnerUserId bigint, Score int, AcceptedAnswerId bigint, ParentId bigint, Tags string, ViewCount int, Body string, Title string",
    "votes": "Id bigint, PostId bigint, VoteTypeId int, CreationDate timestamp_ntz, UserId bigint, BountyAmount int",
    "users": "Id bigint, Reputation int, CreationDate timestamp_ntz, LastAccessDate timestamp_ntz, Views int, UpVotes int, DownVotes int",
    "comments": "Id bigint, PostId bigint, Score int, CreationDate timestamp_ntz, UserId bigint",
    "edits": "Id bigint, PostHistoryTypeId int, PostId bigint, CreationDate timestamp_ntz, UserId bigint",
    "badges": "Id bigint, UserId bigint, Name string, Date timestamp_ntz, Class int",
}
#: Rows that each file keeps.
KEPT = {"posts": "PostTypeId IN (1, 2)", "votes": "VoteTypeId IN (1, 2, 3, 8, 9)", "edits": "PostHistoryTypeId IN (4, 5, 6) AND UserId IS NOT NULL"}


def read_xml(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Rows of one dump file, split over tasks at row tags; values that do not parse become null.

    Posts carry the metrics of their texts in place of the texts.
    """
    names = [f.split()[0] for f in FIELDS[kind].split(", ")]
    schema = T.StructType([T.StructField(f"_{n}", T.StringType()) for n in names])
    rows = spark.read.format("xml").option("rowTag", "row").option("mode", "PERMISSIVE").schema(schema).load(path)
    df = rows.select(*(F.col(f"_{f.split()[0]}").try_cast(f.split()[1]).alias(f.split()[0]) for f in FIELDS[kind].split(", ")))
    return _kept(df, kind)


def read_xml_kept(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a dump that may be damaged, and what is broken in it: (file, block, line, reason, columns, text).

    A dump has a row element a line. A line that is no row element, or breaks off, is set aside whole ("not a row", "not XML"), as is a row without an Id ("no Id"); a row with values
    that do not parse stays, with nulls, and is also noted with their columns ("value"). ``line`` counts the lines of the task's part of the file, which begins at byte ``block``.
    The XML declaration and the outer element's two tags are no damage, nor are rows that the table does not keep.
    """
    fields = [f.split() for f in FIELDS[kind].split(", ")]
    schema = T.StructType([*(T.StructField(f"_{n}", T.StringType()) for n, _ in fields), T.StructField("_broken", T.StringType())])
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_at"))
    outer = (F.col("_t") == "") | F.col("_t").startswith("<?xml") | F.col("_t").rlike(r"^</?[A-Za-z]+\s*>$")
    # what follows a generator is not merged into what comes before it: a line's text, its parts and its values are found once each
    once = lambda df, **columns: df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))
    x = once(lines, _t=F.trim(F.regexp_replace("value", "^\ufeff", ""))).where(~outer)
    row = F.col("_t").rlike(r"^<row\b")
    whole = row & F.col("_t").rlike(r"(/>|</row\s*>)$")
    x = once(x, _row=row, _x=F.when(whole, F.from_xml("_t", schema, {"rowTag": "row", "attributePrefix": "_", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})))
    x = once(x, **{f"_v_{n}": F.col(f"_x._{n}").try_cast(k) for n, k in fields})
    wrong = {n: F.col(f"_x._{n}").isNotNull() & F.col(f"_v_{n}").isNull() for n, _ in fields}
    bad = F.concat_ws(",", *[F.when(w, F.lit(n)) for n, w in wrong.items()])
    reason = F.when(~F.col("_row"), "not a row").when(F.col("_x").isNull() | F.col("_x._broken").isNotNull(), "not XML").when(F.col("_v_Id").isNull(), "no Id").when(bad != "", "value")
    x = once(x.withColumn("columns", bad), reason=reason)
    good = x.where("reason IS NULL OR reason = 'value'").select(*[F.col(f"_v_{n}").alias(n) for n, _ in fields])
    broken = x.where("reason IS NOT NULL").select("file", "block", (F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias("line"), "reason", F.when(F.col("reason") == "value", F.col("columns")).alias("columns"), F.col("_t").alias("text"))
    return _kept(good, kind), broken


def _kept(df: DataFrame, kind: str) -> DataFrame:
    """The rows that a table keeps; posts carry the metrics of their texts in place of the texts."""
    df = df.where(KEPT[kind]) if kind in KEPT else df
    if kind != "posts":
        return df
    more = body_metrics(F.col("Body")) | title_metrics(F.col("Title"))
    return df.select(*(c for c in df.columns if c not in ("Body", "Title")), *(v.alias(k) for k, v in more.items()))


def typed(df: DataFrame) -> DataFrame:
    """Columns cast by name: ids to bigint, dates to timestamps; values that do not parse become null."""
    as_type = lambda c: "bigint" if c.lower().endswith("id") else "timestamp_ntz" if "date" in c.lower() else None
    return df.select(*(F.col(c).try_cast(as_type(c)).alias(c) if as_type(c) else F.col(c) for c in df.columns))


def split_by_column(df: DataFrame, out: str, column: str, values: list, names: list[str] | None = None, columns: list[str] | None = None) -> list[str]:
    """One table a value, written side by side; the filter reaches the scan. Returns the paths."""
    paths = []
    for i, v in enumerate(values):
        paths.append(f"{out.rstrip('/')}/{names[i] if names and i < len(names) else f'{column}_{v}.parquet'}")
        part = df.where(F.col(column) == F.lit(v))
        (part.select(*columns) if columns else part).write.mode("overwrite").parquet(paths[-1])
    return paths


def write_by_hash(df: DataFrame, out: str, key: str, parts: int, salt: int = 1) -> None:
    """Folders part=0 .. part=parts-1 by the key's hash. ``salt`` files a folder spread a hot key's rows."""
    tagged = df.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
    spread = [F.pmod(F.xxhash64(*df.columns), F.lit(salt))] if salt > 1 else []
    tagged.repartition(parts * salt, "part", *spread).write.mode("overwrite").option("compression", "gzip").partitionBy("part").parquet(out)


def write_by_year(df: DataFrame, out: str, date: str) -> DataFrame:
    """One folder a year; returns the rows a year, as the sink's record. Rows of a year lie in as many files as tasks had some."""
    df.withColumn("year", F.year(date)).write.mode("overwrite").partitionBy("year").parquet(out)
    return df.sparkSession.read.parquet(out).groupBy("year").agg(F.count("*").alias("n"))


def write_record(record: DataFrame, path: str) -> DataFrame:
    """A table's record, one row, as a JSON text beside it; read back with the record's own types."""
    row = record.limit(2).select(F.to_json(F.struct(*record.columns)).alias("j")).collect()
    if len(row) != 1:
        raise ValueError("a record is one row")
    write_text(record.sparkSession, path, row[0].j + "\n")
    return record.sparkSession.read.schema(record.schema).json(path)
