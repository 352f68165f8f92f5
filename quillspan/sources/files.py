"""Logical inputs, atomic sinks, result files and LaTeX tables."""

from __future__ import annotations

import atexit
import json
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Logical inputs and the stems of their files.
INPUTS = {"posts_questions": "posts_questions", "posts_answers": "posts_answers", "users": "Users", "votes": "Votes", "comments": "Comments", "posthistory": "PostHistory", "badges": "Badges"}


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def work_folder(spark: SparkSession) -> str:
    """A new folder for one query's files: in the shared folder of ``spark.checkpoint.dir``, or a temporary one in a local session.

    All of them lie in a folder of the application, which is removed when the session is stopped from Python or, without that, when the driver's Python ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.gettempdir()
    own = f"{base.rstrip('/')}/quillspan-files-{spark.sparkContext.applicationId}"
    removed_with_session(spark, own)
    return f"{own}/{uuid.uuid4().hex}"


_OWN: dict[str, set[str]] = {}


def removed_with_session(spark: SparkSession, path: str) -> None:
    """Have ``path`` deleted before the session's context stops, while its file system can still be reached, or at the end of Python."""
    sc = spark.sparkContext
    own = _OWN.get(sc.applicationId)
    if own is None:
        own = _OWN[sc.applicationId] = set()
        stop = sc.stop

        def leave() -> None:
            if sc._jsc is not None:
                for p in sorted(own):
                    fs, q = _file_system(spark, p)
                    fs.delete(q, True)
            own.clear()

        def stop_clean() -> None:
            leave()
            stop()

        sc.stop = stop_clean  # SparkSession.stop() calls it too
        atexit.register(leave)
    own.add(path)


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """``df`` written to a folder and read back: a stage boundary that cuts the plan, outlives executors and has a known size."""
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file_system(spark, path)
    return fs.exists(p)


def _names(spark: SparkSession, folder: str) -> set[str]:
    fs, p = _file_system(spark, folder)
    return {s.getPath().getName() for s in fs.listStatus(p)} if fs.exists(p) else set()


def resolve_input(spark: SparkSession, folder: str, key: str, inputs: dict[str, str] = INPUTS) -> str:
    """Where a logical input lies in ``folder``: the folder is listed once, and a table whose stem ends in ``_revision`` goes before the plain one.

    A KeyError for an unknown key, a FileNotFoundError if there is neither.
    """
    stem = inputs[key]
    preference = {f"{stem}_revision.parquet": 0, f"{stem}.parquet": 1}
    there = sorted(_names(spark, folder) & preference.keys(), key=preference.__getitem__)
    if not there:
        raise FileNotFoundError(f"{folder} has none of {', '.join(preference)}")
    return f"{folder.rstrip('/')}/{there[0]}"


def input_exists(spark: SparkSession, folder: str, key: str, inputs: dict[str, str] = INPUTS) -> bool:
    return bool(_names(spark, folder) & {f"{inputs[key]}{end}.parquet" for end in ("", "_revision")}) if key in inputs else False


def write_atomic(df: DataFrame, path: str, form: str = "parquet", **options) -> str:
    """Write beside ``path``, then rename: a reader never sees a part of a table. An old table is moved aside first and deleted last, so a crash loses neither.

    Between the two renames a reader finds no table; where readers must not wait for writers, use ``publish``.
    """
    spark, temporary = df.sparkSession, f"{path.rstrip('/')}.{uuid.uuid4().hex}.tmp"
    df.write.format(form).options(**options).save(temporary)
    fs, target = _file_system(spark, path)
    _, source = _file_system(spark, temporary)
    _, aside = _file_system(spark, f"{temporary}.old")
    old = fs.exists(target)
    if old and not fs.rename(target, aside):
        raise OSError(f"could not move {path} aside")
    if not fs.rename(source, target):
        if old:
            fs.rename(aside, target)
        raise OSError(f"could not rename {temporary} to {path}")
    if old:
        fs.delete(aside, True)
    return path


VERSION = "version="


def _versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n.removeprefix(VERSION)) for n in _names(spark, path) if n.startswith(VERSION))


def publish(df: DataFrame, path: str, keep_seconds: float = 3600.0, attempts: int = 20) -> int:
    """Write ``df`` as the next version of the table at ``path`` and return its number.

    A version is staged in a hidden folder and appears by one rename to a name that was free, so readers see whole versions alone and a crash leaves the last one in
    place. Of two writers one takes the next number. Versions other than the newest, and forgotten stages, are deleted once they are ``keep_seconds`` old, so that running readers of them can end.
    """
    spark, stage = df.sparkSession, f"{path.rstrip('/')}/_stage-{uuid.uuid4().hex}"
    df.write.parquet(stage)
    fs, source = _file_system(spark, stage)
    for _ in range(attempts):
        number = max(_versions(spark, path), default=0) + 1
        claim = _file_system(spark, f"{path.rstrip('/')}/_claim-{number}")[1]
        if not fs.createNewFile(claim):  # another writer is at this number
            time.sleep(0.05)
            if number > max(_versions(spark, path), default=0) and time.time() * 1000 - _modified(fs, claim) > 60_000:
                fs.delete(claim, False)  # it never finished
            continue
        target = _file_system(spark, f"{path.rstrip('/')}/{VERSION}{number}")[1]
        if not fs.exists(target) and fs.rename(source, target):
            fs.delete(claim, False)
            _clean(spark, path, number, keep_seconds)
            return number
        fs.delete(claim, False)
    raise OSError(f"could not publish {path}")


def _modified(fs, p) -> int:
    try:
        return fs.getFileStatus(p).getModificationTime()
    except Exception:  # it went meanwhile
        return 1 << 62


def _clean(spark: SparkSession, path: str, newest: int, keep_seconds: float) -> None:
    fs, base = _file_system(spark, path)
    for s in fs.listStatus(base):
        name, old = s.getPath().getName(), time.time() * 1000 - s.getModificationTime() > keep_seconds * 1000
        if old and (name.startswith("_stage-") or (name.startswith(VERSION) and int(name.removeprefix(VERSION)) < newest)):
            fs.delete(s.getPath(), True)


def published(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of a table that ``publish`` writes. A FileNotFoundError if there is none."""
    versions = _versions(spark, path)
    if not versions:
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path.rstrip('/')}/{VERSION}{versions[-1]}")


def cached(spark: SparkSession, path: str, make, key: dict | None = None) -> DataFrame:
    """The table at ``path`` if it was written with the same ``key``, else ``make()`` written there atomically and read again."""
    fs, note = _file_system(spark, f"{path.rstrip('/')}.key.json")
    want = json.dumps(key or {}, sort_keys=True)
    if exists(spark, path) and fs.exists(note) and spark.read.text(note.toString(), wholetext=True).first()[0].strip() == want:
        return spark.read.parquet(path)
    fs.delete(note, False)  # a table without a note is made again
    write_atomic(make(), path)
    write_text(spark, note.toString(), want)
    return spark.read.parquet(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file, through the file system that Spark uses."""
    fs, p = _file_system(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_csv(df: DataFrame, path: str, delimiter: str = ",") -> str:
    """A CSV table with a header; result tables of a few rows come as one file."""
    return write_atomic(df, path, "csv", header="true", sep=delimiter, emptyValue="", nullValue="")


def read_csv(spark: SparkSession, path: str, schema: str, delimiter: str = ",") -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, sep=delimiter, emptyValue="", nullValue="")


def write_json(df: DataFrame, path: str) -> str:
    return write_atomic(df, path, "json")


def write_hash_partitions(df: DataFrame, path: str, key: str, parts: int) -> DataFrame:
    """Folders part=0 .. parts-1 by a hash of the key, gzip Parquet; returns the table."""
    from .dump import write_by_hash

    write_by_hash(df, path, key, parts)
    return df.sparkSession.read.parquet(path)


_SPECIAL = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}", "<": r"$<$", ">": r"$>$"}


def latex_escape(text: str) -> str:
    return "".join(_SPECIAL.get(c, c) for c in text)


def latex_table(df: DataFrame, formats: dict[str, str] | None = None, max_rows: int = 10_000, caption: str = "") -> str:
    """A booktabs table of a result frame, in its row order; ``formats`` gives a format of a column's numbers. Nulls are empty cells; more than ``max_rows`` rows are refused."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"more than {max_rows} rows")
    formats = formats or {}

    def cell(c, v):
        return "" if v is None else format(v, formats[c]) if c in formats else latex_escape(str(v))

    lines = [" & ".join(cell(c, r[c]) for c in df.columns) + r" \\" for r in rows]
    head = " & ".join(map(latex_escape, df.columns)) + r" \\"
    caption = [rf"\caption{{{latex_escape(caption)}}}"] if caption else []
    return "\n".join([r"\begin{table}", *caption, rf"\begin{{tabular}}{{l{'r' * (len(df.columns) - 1)}}}", r"\toprule", head, r"\midrule", *lines, r"\bottomrule", r"\end{tabular}", r"\end{table}", ""])


def read_latex_rows(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Body rows of a LaTeX table as text columns: lines of as many cells as ``columns``, escapes undone."""
    line = F.trim("value")
    body = F.split(F.regexp_replace(line, r"\s*\\\\\s*$", ""), r"\s*(?<!\\)&\s*")
    rows = spark.read.text(path).where(line.endswith("\\\\")).select(body.alias("c")).where(F.size("c") == len(columns))

    def plain(c):
        for k, v in _SPECIAL.items():
            c = F.replace(c, F.lit(v), F.lit(k))
        return F.trim(c)

    return rows.select(*[plain(F.get("c", F.lit(i))).alias(c) for i, c in enumerate(columns)])


def estimates(cell) -> dict:
    """Columns of a result cell such as ``1.049*** [1.044, 1.054]``: estimate, stars, ci_lo and ci_hi."""
    number = r"(-?\d+(?:\.\d+)?)"
    find = lambda p, g: F.nullif(F.regexp_extract(cell, p, g), F.lit("")).try_cast("double")
    return {"estimate": find(rf"^\D*?{number}", 1), "stars": F.length(F.regexp_extract(cell, r"(\*+)", 1)), "ci_lo": find(rf"\[\s*{number}\s*,", 1), "ci_hi": find(rf",\s*{number}\s*\]", 1)}


def schema_report(df: DataFrame) -> DataFrame:
    """A row a column: position, name, type and whether it may be null."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string, nullable boolean")
