"""Per-question features: processed rows, tag shares, imputation, samples and small column tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import stored, work_folder
from .events import DAY, hours, micros
from .quantiles import clipped_scale, wide_quantiles


def dense_ids(df: DataFrame, keys: list[str], name: str = "event_id") -> DataFrame:
    """Distinct ``keys`` with their dense rank by all keys, from 1.

    Keys are dealt by range, written, and ranked within each range; only the ranges' counts go through one task.
    """
    x = df.select(*keys).distinct().repartitionByRange(*keys).withColumn("_range", F.spark_partition_id())
    x = stored(x, work_folder(df.sparkSession), "ranges")  # one dealing serves both uses
    sizes = x.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    ranked = x.withColumn("_r", F.row_number().over(Window.partitionBy("_range").orderBy(*keys))).join(F.broadcast(before), "_range")
    return ranked.select(*keys, (F.col("_before") + F.col("_r")).cast("bigint").alias(name))


def question_rows(eligible: DataFrame, log: DataFrame, metrics: DataFrame, tags: DataFrame, days: int = 7, cutoff: str | None = "2025-04-01") -> DataFrame:
    """One processed row a question: ids, phases, response times, helps given in the window, calendar, tags and pre-treatment metrics.

    The helps are the question's window answers in the event log; metrics join by question. Questions whose second phase ends after
    ``cutoff`` are left out (None keeps them). Hours run from 0 to 23, weekdays from Monday = 0, both of the question's own time.
    """
    given = log.where("event = 'Window_Answer'").groupBy(F.col("ref_id").alias("question_id")).agg(F.count("*").alias("num_helped"))
    ids = dense_ids(eligible, ["owner_user_id", "question_id"])
    x = eligible.join(ids, ["owner_user_id", "question_id"]).join(given, "question_id", "left").join(metrics.withColumnRenamed("unit_id", "question_id"), "question_id", "left").join(tags, "question_id", "left")
    span = F.make_dt_interval(F.lit(days))
    since = lambda c: hours(F.col(c), F.col("creation_date"))
    out = x.select(
        "event_id", "question_id", F.col("owner_user_id").alias("user_id"), (F.col("creation_date") - span).alias("phase_one_start"), (F.col("creation_date") + span).alias("phase_two_end"),
        "has_answer", "has_unhelpful_answer", "has_accepted_answer", "has_self_answer", since("first_ts").alias("response_hours"), since("accepted_ts").alias("accepted_hours"), since("vote_ts").alias("vote_hours"),
        F.coalesce("num_helped", F.lit(0)).alias("num_helped"), F.year(F.col("creation_date") - span).alias("year"), F.month(F.col("creation_date") - span).alias("month"),
        F.hour("creation_date").alias("post_hour"), F.weekday("creation_date").alias("post_day_of_week"), F.coalesce(F.size("tag_ids"), F.lit(0)).alias("num_tags"), "tag_ids",
        *[c for c in metrics.columns if c != "unit_id"], "first_answer_score", "first_answer_votes", "first_answer_body_len_chars", "view_count", "body_len_chars", "title_len_chars", "n_code_blocks", "owner_reputation",
    )
    return out.where(F.col("phase_two_end") <= F.lit(cutoff).cast("timestamp_ntz")) if cutoff else out


def selection_covariates(df: DataFrame) -> DataFrame:
    """Posting-time and length covariates of the propensity: the hour on a circle, weekend, log body length."""
    angle = 2 * F.pi() * F.col("post_hour") / 24
    return df.withColumns({"hour_sin": F.sin(angle), "hour_cos": F.cos(angle), "is_weekend": (F.col("post_day_of_week") >= 5).cast("double"), "log_body": F.log1p(F.col("body_len_chars").cast("double"))})


def tag_shares(df: DataFrame, outcome: str, by_year: bool = True, min_count: int = 100) -> DataFrame:
    """(year, tag_id, share): mean outcome of the questions with a tag, in cells of at least ``min_count`` questions.

    Without any such cell by year the shares are taken over all years; ``year`` is null then.
    """
    x = df.where(F.col(outcome).isNotNull()).select("year", F.explode("tag_ids").alias("tag_id"), F.col(outcome).alias("y"))
    cells = x.groupBy("year", "tag_id").agg(F.sum("y").alias("s"), F.count("*").alias("n"))
    yearly = cells.where(F.col("n") >= min_count).select("year", "tag_id", (F.col("s") / F.col("n")).alias("share"))
    if by_year and yearly.limit(1).count():
        return yearly
    overall = cells.groupBy("tag_id").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).where(F.col("n") >= min_count)
    return overall.select(F.lit(None).cast("int").alias("year"), "tag_id", (F.col("s") / F.col("n")).alias("share"))


def with_tag_shares(df: DataFrame, shares: DataFrame, outcome: str) -> DataFrame:
    """Mean and largest share over each question's tags (tags without one are skipped), the overall mean outcome where none is left."""
    tags = df.select("question_id", "year", F.explode("tag_ids").alias("tag_id"))
    s = shares.select("tag_id", "share", F.col("year").alias("s_year"))
    own = tags.join(s, "tag_id").where("s_year IS NULL OR s_year = year").groupBy("question_id").agg(F.avg("share").alias("tag_share_avg"), F.max("share").alias("tag_share_max"))
    mean = df.agg(F.avg(outcome).alias("_mean"))
    x = df.join(own, "question_id", "left").crossJoin(F.broadcast(mean))
    return x.withColumns({c: F.coalesce(c, "_mean") for c in ("tag_share_avg", "tag_share_max")}).drop("_mean")


def impute_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls replaced by the column's exact median; one row of medians is broadcast. A column of nulls stays as it is."""
    m = wide_quantiles(df, columns, [0.5], lambda c, q: f"_m_{c}")
    x = df.crossJoin(F.broadcast(m))
    return x.withColumns({c: F.coalesce(F.col(c).cast("double"), f"_m_{c}") for c in columns}).drop(*[f"_m_{c}" for c in columns])


def winsorised(df: DataFrame, columns: list[str], low: float = 0.05, high: float = 0.95, keys: list[str] | None = None) -> DataFrame:
    """Columns clipped at their exact quantiles, then centred and divided by their deviation (unless it is 0); with ``keys`` each group by its own."""
    scale = clipped_scale(df, columns, low, high, keys)
    x = df.join(F.broadcast(scale), keys, "left") if keys else df.crossJoin(F.broadcast(scale))  # a row a group
    clipped = {c: F.least(F.greatest(F.col(c).cast("double"), F.col(f"_lo_{c}")), F.col(f"_hi_{c}")) for c in columns}
    scaled = {c: F.when(F.col(c).isNotNull(), F.when(F.col(f"_s_{c}") > 0, (v - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(v)) for c, v in clipped.items()}
    return x.withColumns(scaled).drop(*[f"_{k}_{c}" for c in columns for k in ("lo", "hi", "m", "s")])


def finite(df: DataFrame, required: list[str]) -> DataFrame:
    """Infinite and not-a-number values become null in every floating column; rows that lack a required column go."""
    floating = [c for c, t in df.dtypes if t in ("double", "float")]
    clean = {c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)) for c in floating}
    return df.withColumns(clean).dropna(subset=required)


def tolerant(df: DataFrame, optional: dict[str, str]) -> DataFrame:
    """``df`` with every optional column, those it lacks as nulls of the given type."""
    return df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in optional.items() if c not in df.columns])


def tag_dummies(df: DataFrame, tag_ids: list[int]) -> DataFrame:
    """A 0/1 column tag_<id> for each tag."""
    return df.select("*", *[F.coalesce(F.array_contains("tag_ids", F.lit(t).cast("bigint")), F.lit(False)).cast("int").alias(f"tag_{t}") for t in tag_ids])


def top_tags(dictionary: DataFrame, k: int = 50) -> DataFrame:
    """The ``k`` most frequent tags, ties to the smaller id."""
    return dictionary.orderBy(F.desc("tag_frequency"), "tag_id").limit(k)


def hash_order(key: str, seed: int) -> list[Column]:
    """A reproducible random order of ids, the same in any engine: the MD5 of seed and id, then the id."""
    return [F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), F.col(key)]


def sample_ids(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` distinct ids drawn without replacement; a top-k over the hash order, not a sort of all ids."""
    return df.select(key).where(F.col(key).isNotNull()).distinct().orderBy(*hash_order(key, seed)).limit(n)


def pair_sample(df: DataFrame, key: str, max_rows: int, seed: int = 42) -> DataFrame:
    """All rows of as many ids as give about ``max_rows`` rows; rows of one id stay together. Smaller inputs stay whole."""
    rows, ids = df.agg(F.count("*"), F.count_distinct(key)).first()
    if rows <= max_rows:
        return df
    return df.join(sample_ids(df, key, min(ids, max(1, max_rows * ids // rows)), seed), key, "left_semi")


def fill_both_ways(df: DataFrame, group: list[str], order: str, column: str) -> DataFrame:
    """Nulls take the last value before them in the group, or else the first after them."""
    w = Window.partitionBy(*group).orderBy(order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    return df.withColumn(column, F.coalesce(F.last(column, ignorenulls=True).over(back), F.first(column, ignorenulls=True).over(ahead)))


def pre_post(units: DataFrame, events: DataFrame, key: tuple[str, ...] = ("match_id", "question_id")) -> DataFrame:
    """Two intervals a unit, up to its (pseudo-)answer time and from there on: (t_start, t_answer) without an event, (t_answer, t_end) with one if it has any within.

    ``units`` has t_start, t_answer and t_end, ``events`` their t_event; both ends of the second interval belong to it. Units without an answer time have no rows.
    """
    key = list(key)
    own = [c for c in units.columns if c not in ("t_start", "t_answer", "t_end")]
    w = units.where("t_answer IS NOT NULL")
    n = events.join(w.select(*key, "t_answer", "t_end"), key).where("t_event >= t_answer AND t_event <= t_end").groupBy(*key).agg(F.count("*").alias("_n"))
    piece = lambda a, b, post, event: F.struct(F.col(a).alias("start"), F.col(b).alias("stop"), F.lit(post).alias("post"), event.cast("int").alias("event"))
    pieces = F.array(piece("t_start", "t_answer", 0, F.lit(0)), piece("t_answer", "t_end", 1, F.col("_n").isNotNull()))
    return w.join(n, key, "left").select(*own, F.explode(pieces).alias("_p")).select(*own, "_p.*")


def before_site_phase(log: DataFrame, questions: DataFrame, days: int = 7) -> DataFrame:
    """The log without the questions whose first phase starts within ``days`` of the site's first question (an anti-join by question)."""
    first = questions.agg(F.min("creation_date").alias("t"))
    early = log.where("event = 'Phase_One_Start'").crossJoin(F.broadcast(first)).where(F.col("ts") < F.col("t") + F.make_dt_interval(F.lit(days))).select("ref_id").distinct()
    return log.join(early.withColumn("is_history", F.lit(0)), ["ref_id", "is_history"], "left_anti").select(*log.columns)


def stars(p: Column) -> Column:
    """Marks of significance."""
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").when(p < 0.1, "+").otherwise("")


def response_bins(rt: Column, edges: list[float], labels: list[str]) -> Column:
    """Label of the left-closed bin that a response time falls in; null outside and for null."""
    out = F.lit(None).cast("string")
    for lo, hi, label in zip(edges[:-1], edges[1:], labels, strict=True):
        out = F.when((rt >= lo) & (rt < hi), label).otherwise(out)
    return out


def history_by_prefix(targets: DataFrame, log: DataFrame, windows: dict[str, int], kinds: tuple[str, ...]) -> DataFrame:
    """The counts of ``history_metrics`` as differences of running sums, looked up at each target's time and at the windows' starts.

    Marks for every (target, window) are put among a user's events; one running sum a kind serves all windows.
    """
    e = log.where("is_history = 1").select("user_id", micros("ts").alias("us"), F.lit(1).alias("turn"), F.lit(None).cast("long").alias("unit_id"), F.lit("").alias("win"), *[(F.col("event") == k).cast("long").alias(k) for k in kinds])
    marks = F.array(*[F.struct(F.lit(name).alias("win"), (micros("at") - d * DAY if d else micros("at")).alias("us")) for name, d in {"": 0, **{n: d for n, d in windows.items() if d}}.items()])
    m = targets.select("user_id", "unit_id", F.explode(marks).alias("m")).select("user_id", "m.us", F.lit(0).alias("turn"), "unit_id", "m.win", *[F.lit(0).cast("long").alias(k) for k in kinds])
    w = Window.partitionBy("user_id").orderBy("us", "turn").rowsBetween(Window.unboundedPreceding, 0)
    run = e.unionByName(m).select("unit_id", "win", *[F.sum(k).over(w).alias(k) for k in kinds]).where("unit_id IS NOT NULL")
    at = lambda k, name: F.max(F.when(F.col("win") == name, F.col(k)))
    return run.groupBy("unit_id").agg(*[(at(k, "") - (at(k, n) if d else F.lit(0))).alias(f"n_{k}_{n}") for k in kinds for n, d in windows.items()])


def history_by_join(targets: DataFrame, log: DataFrame, windows: dict[str, int], kinds: tuple[str, ...]) -> DataFrame:
    """The same counts by a plain join of targets and earlier events: slow and clear, for checks on small tables."""
    e = log.where("is_history = 1").select(F.col("user_id").alias("e_user"), micros("ts").alias("us"), "event")
    x = targets.withColumn("at_us", micros("at")).join(e, (F.col("user_id") == F.col("e_user")) & (F.col("us") < F.col("at_us")), "left")
    inside = lambda d: F.lit(True) if not d else F.col("us") >= F.col("at_us") - d * DAY
    return x.groupBy("unit_id").agg(*[F.count(F.when((F.col("event") == k) & inside(d), 1)).alias(f"n_{k}_{n}") for k in kinds for n, d in windows.items()])
