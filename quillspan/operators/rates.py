"""Descriptives, rates, discards and archived variants over windows and events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .events import DAY, accept_votes, micros, others_answers, within
from .features import response_bins
from .fits import OUTCOMES, RT_EDGES, RT_LABELS
from .quantiles import wide_quantiles
from .study import tenure_bucket

KEY = ["match_id", "question_id"]

__all__ = ["OUTCOMES", "RT_EDGES", "RT_LABELS"]


def response_time_sets(windows: DataFrame) -> DataFrame:
    """The rows of each response-time bin's sample, with its ``label``: every control, and the treated rows of the bin."""
    bin_ = response_bins(F.col("t_answer") - F.col("t_question"), RT_EDGES, RT_LABELS)
    sets = F.when(F.col("treated") == 0, F.array(*map(F.lit, RT_LABELS))).when(bin_.isNotNull(), F.array(bin_))
    return windows.select("*", F.explode(sets).alias("label"))


def matched_stats(matched: DataFrame) -> DataFrame:
    """One row: rows, pairs, distinct questions by arm, and the most pairs that a control is used in."""
    t, c = F.col("treated") == 1, F.col("treated") == 0
    one = matched.agg(F.count("*").alias("n_rows"), F.count_distinct("match_id").alias("n_pairs"), F.count_distinct("question_id").alias("n_unique"), F.count_distinct(F.when(t, F.col("question_id"))).alias("n_treated_q"), F.count_distinct(F.when(c, F.col("question_id"))).alias("n_control_q"), F.sum("treated").alias("n_treated"), F.sum(1 - F.col("treated")).alias("n_control"))
    reuse = matched.where(c).groupBy("question_id").agg(F.count_distinct("match_id").alias("m")).agg(F.coalesce(F.max("m"), F.lit(0)).alias("max_reuse"))
    return one.crossJoin(reuse)


def _counted(windows: DataFrame, events: DataFrame) -> DataFrame:
    return windows.join(events.groupBy(*KEY).agg(F.count("*").alias("n")), KEY, "left").fillna(0, ["n"])


def _response(windows: DataFrame) -> DataFrame:
    return windows.withColumn("rt", F.when((F.col("treated") == 1) & (F.col("t_answer") > F.col("t_question")), F.col("t_answer") - F.col("t_question")))


def descriptives(windows: DataFrame, events: DataFrame) -> DataFrame:
    """One row of counts, and mean, deviation and median of helps, tenure and (treated, positive) response time."""
    named = {"helps": "n", "tenure": "tenure_days", "rt": "rt"}
    x = _response(_counted(windows, events))
    one = x.agg(F.count("*").alias("n_questions"), F.count_distinct("user_id").alias("n_users"), (F.avg("treated") * 100).alias("pct_treated"), *[f(c).alias(f"{k}_{a}") for k, c in named.items() for a, f in (("mean", F.avg), ("sd", F.stddev_samp))])
    medians = wide_quantiles(x, list(named.values()), [0.5], lambda c, q: f"{dict(zip(named.values(), named, strict=True))[c]}_median")
    return one.crossJoin(F.broadcast(medians))


def descriptives_by_bucket(windows: DataFrame) -> DataFrame:
    x = _response(windows.withColumn("bucket", tenure_bucket(F.col("tenure_days"))))
    medians = wide_quantiles(x, ["rt"], [0.5], lambda c, q: "rt_median", ["bucket"])
    return x.groupBy("bucket").agg(F.count("*").alias("n"), F.avg("rt").alias("rt_mean"), F.count("rt").alias("rt_n")).join(F.broadcast(medians), "bucket", "left")  # a row a bucket


def love_plot(balance: DataFrame) -> DataFrame:
    """Absolute mean differences, the largest unmatched one first."""
    x = balance.select("covariate", F.abs("smd_unmatched").alias("unmatched"), F.abs("smd_matched").alias("matched"))
    return x.select(F.row_number().over(Window.orderBy(F.desc_nulls_last("unmatched"), "covariate")).alias("place"), "*")  # a row a covariate


def bin_edges(low: float, high: float, width: float) -> list[float]:
    """Edges from ``low`` on before 0 and from 0 to about ``high``, so that no bin spans the question."""
    left = [low + k * width for k in range(max(0, int(-(low // width)) + 1)) if low + k * width < 0]
    right = [k * width for k in range(int((high + width * 0.5) // width) + 1) if k * width < high + width * 0.5]
    return sorted({*left, *right})


def rates_on_edges(units: DataFrame, events: DataFrame, edges: list[float], by: list[str]) -> DataFrame:
    """Events a unit-hour in each group and bin, empty bins included; an event on the last edge counts in the last bin."""
    bins = [(i, a, b) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    at = reduce(lambda out, x: F.when(F.col("t_event") >= x[1], x[0]).otherwise(out), bins, F.lit(0))
    n = units.groupBy(*by).agg(F.count("*").alias("n_obs"))
    grid = n.select(*by, "n_obs", F.explode(F.array(*[F.struct(F.lit(i).alias("bin"), F.lit((a + b) / 2).alias("center"), F.lit(b - a).alias("width")) for i, a, b in bins])).alias("g")).select(*by, "n_obs", "g.*")
    hit = events.where((F.col("t_event") >= edges[0]) & (F.col("t_event") <= edges[-1])).join(units.select(*KEY, *by), KEY)
    hit = hit.groupBy(*by, at.alias("bin")).agg(F.count("*").alias("events"))
    out = grid.join(hit, [*by, "bin"], "left").fillna(0, ["events"])
    hours = F.col("n_obs") * F.col("width")
    return out.withColumns({"rate": F.col("events") / hours, "se": F.sqrt(F.col("events").cast("double")) / hours})


def adoption_rates(windows: DataFrame, events: DataFrame, width: float = 2.0, high: float = 24.0) -> DataFrame:
    """Rates by bin of units answered before the bin (treated) and after it or never (control); units answered within it are left out.

    The first bin has no treated group. Units meet the bins by their answer's bin: each bin's exposure is a running count over bins.
    """
    n_bins = int(high / width + 0.5)
    bins = windows.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    # First bin that begins at or after the answer, and last bin that ends before it.
    u = windows.groupBy("t_answer").agg(F.count("*").alias("n"))
    x = bins.crossJoin(u.groupBy(F.least(F.greatest(F.ceil(F.col("t_answer") / width), F.lit(0)), F.lit(n_bins + 1)).alias("from"), F.least(F.greatest(F.ceil(F.col("t_answer") / width) - 1, F.lit(-1)), F.lit(n_bins)).alias("before")).agg(F.sum("n").alias("n")))
    after = F.col("before").isNull() | (F.col("before") > F.col("bin"))
    units = x.groupBy("bin").agg(F.sum(F.when(after, F.col("n")).otherwise(0)).alias("control"), F.sum(F.when(F.col("from") <= F.col("bin"), F.col("n")).otherwise(0)).alias("treated"))
    units = units.select("bin", F.explode(F.array(*[F.struct(F.lit(g).alias("group"), (F.col(g) * width).alias("hours")) for g in ("control", "treated")])).alias("g")).select("bin", "g.*")
    e = events.where((F.col("t_event") >= 0) & (F.col("t_event") <= high)).join(windows.select(*KEY, "t_answer"), KEY).withColumn("bin", F.least(F.floor(F.col("t_event") / width), F.lit(n_bins - 1)).cast("int"))
    group = F.when(F.col("t_answer").isNull() | (F.col("t_answer") > (F.col("bin") + 1) * width), "control").when(F.col("t_answer") <= F.col("bin") * width, "treated")
    hit = e.withColumn("group", group).where("group IS NOT NULL").groupBy("bin", "group").agg(F.count("*").alias("events"))
    out = units.join(hit, ["bin", "group"], "left").fillna(0, ["events"]).where("group = 'control' OR bin > 0")
    rate = F.when(F.col("hours") > 0, F.col("events") / F.col("hours")).otherwise(0.0)
    return out.withColumns({"rate": rate, "se": F.when(F.col("hours") > 0, F.sqrt(F.col("events").cast("double")) / F.col("hours")).otherwise(0.0)})


def stable_control_rates(windows: DataFrame, events: DataFrame, width: float = 2.0, high: float = 24.0) -> DataFrame:
    """Rates by bin of the units that are never answered; zero rates without such units."""
    control, n_bins = windows.where("treated = 0"), int(high / width + 0.5)
    grid = control.agg(F.count("*").alias("n")).select("n", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    hit = events.where((F.col("t_event") >= 0) & (F.col("t_event") <= high)).join(control.select(*KEY), KEY, "left_semi")
    hit = hit.groupBy(F.least(F.floor(F.col("t_event") / width), F.lit(n_bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("events"))
    out = grid.join(hit, "bin", "left").fillna(0, ["events"]).withColumn("hours", F.col("n") * width)
    return out.withColumns({"rate": F.coalesce(F.try_divide("events", "hours"), F.lit(0.0)), "se": F.coalesce(F.try_divide(F.sqrt(F.col("events").cast("double")), F.col("hours")), F.lit(0.0))}).drop("n")


def control_rates(intervals: DataFrame, grid: float = 1.0) -> DataFrame:
    """Control events a control question by bucket and over all; intervals that are empty on the grid (rounded half up) go."""
    x = intervals.where(F.round(F.col("start") / grid) < F.round(F.col("stop") / grid)).where("treated = 0")
    every = intervals.where(F.round(F.col("start") / grid) < F.round(F.col("stop") / grid)).select("bucket").distinct()
    cells = x.groupBy("bucket", *KEY).agg(F.sum("event").alias("e"))  # a row a question first: no distinct count is needed
    by = cells.groupBy("bucket").agg(F.sum("e").alias("events"), F.count("*").alias("questions"))
    by = every.join(by, "bucket", "left").fillna(0, ["events", "questions"])
    out = by.unionByName(by.agg(F.sum("events").alias("events"), F.sum("questions").alias("questions")).withColumn("bucket", F.lit("All")))
    return out.withColumn("rate", F.try_divide("events", "questions"))


def flagged(universe: DataFrame, pool: DataFrame, pairs: DataFrame) -> DataFrame:
    """The universe with ``status`` (retained in a pair, or discarded) and whether it was in the matching pool."""
    used = pairs.select(F.explode(F.array("treated_id", "control_id")).alias("question_id")).distinct().withColumn("used", F.lit(1))
    x = universe.join(used, "question_id", "left").join(pool.select("question_id", F.lit(1).alias("in_pool")), "question_id", "left")
    return x.withColumn("status", F.when(F.col("used") == 1, "retained").otherwise("discarded")).fillna(0, ["in_pool"]).drop("used")


def discard_split(flags: DataFrame) -> DataFrame:
    x = flags.groupBy("arm", "status").agg(F.count("*").alias("n"), F.count_distinct("owner_user_id").alias("users"))
    return x.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("arm")))


def discard_mechanism(flags: DataFrame) -> DataFrame:
    """Questions of each arm lost to small strata, lost to the caliper, and retained."""
    out, kept_ = F.col("in_pool") == 0, F.col("status") == "retained"
    return flags.groupBy("arm").agg(F.count_if(out).alias("strata_dropped"), F.count_if(~out & ~kept_).alias("caliper_dropped"), F.count_if(kept_).alias("retained"), F.count("*").alias("total"))


def discard_by(flags: DataFrame, column: str) -> DataFrame:
    gone = F.col("status") == "discarded"
    return flags.groupBy("arm", column).agg(F.count("*").alias("n"), F.count_if(gone).alias("discarded"), F.avg(gone.cast("double")).alias("share"))


def discard_smd(flags: DataFrame, covariates: list[str]) -> DataFrame:
    """Means of retained and discarded questions by arm, and their difference over the pooled deviation."""
    side = {"a": F.col("status") == "retained", "b": F.col("status") == "discarded"}
    one = flags.groupBy("arm").agg(*[f(F.when(s, F.col(c))).alias(f"{n}{k}_{c}") for c in covariates for k, s in side.items() for n, f in (("m", F.avg), ("v", F.var_samp))])
    rows = [F.struct(F.lit(c).alias("covariate"), F.col(f"ma_{c}").alias("mean_retained"), F.col(f"mb_{c}").alias("mean_discarded"), F.sqrt((F.col(f"va_{c}") + F.col(f"vb_{c}")) / 2).alias("sd")) for c in covariates]
    x = one.select("arm", F.explode(F.array(*rows)).alias("r")).select("arm", "r.*")
    return x.withColumn("smd", F.try_divide(F.col("mean_retained") - F.col("mean_discarded"), F.nullif("sd", F.lit(0.0))))


def funnel(stages: dict[str, DataFrame]) -> DataFrame:
    """Rows left after each stage, in order."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(i).alias("step"), F.lit(name).alias("stage"), "n") for i, (name, df) in enumerate(stages.items(), 1)])


def null_profile(df: DataFrame) -> DataFrame:
    """Rows, nulls and their percentage of every column, in one pass."""
    one = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"c{i}") for i, c in enumerate(df.columns)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"c{i}").alias("nulls")) for i, c in enumerate(df.columns)]))
    return one.select("n", rows.alias("r")).select("r.name", "n", "r.nulls", F.try_divide(100.0 * F.col("r.nulls"), F.col("n")).alias("pct"))


def merged(a: DataFrame, b: DataFrame, on: list[str], a_name: str, b_name: str) -> DataFrame:
    """Inner merge of two result tables; their other columns get the tables' names as suffixes."""
    named = lambda d, s: d.select(*on, *[F.col(c).alias(f"{c}_{s}") for c in d.columns if c not in on])
    return named(a, a_name).join(named(b, b_name), on)


def answer_rows(answers: DataFrame, questions: DataFrame, bounties: DataFrame, votes: DataFrame, users: DataFrame, badges: DataFrame | None = None, badge: str = "Autobiographer") -> DataFrame:
    """One row an answer to another's question: response minutes, place among the answerer's answers, bounty flags, amount, tenure, and whether the answerer had the badge.

    An answer is under a bounty that is open when it comes (both ends included), before it if it comes before the question's first, and after
    it if one has ended and none is open; ``ever_bounty`` tells of any bounty of its question. The amount is that of the answer's own bounty start vote (the largest), or 0.
    A badge counts from the time of its first award on.
    """
    a = others_answers(answers, questions).join(questions.select(F.col("question_id").alias("parent_question_id"), "accepted_answer_id"), "parent_question_id")
    b = a.select("answer_id", "parent_question_id", "creation_date").join(bounties.withColumnRenamed("question_id", "parent_question_id"), "parent_question_id")
    open_ = (F.col("creation_date") >= F.col("bounty_start")) & (F.col("creation_date") <= F.col("bounty_end"))
    b = b.groupBy("answer_id").agg(F.max(open_.cast("int")).alias("active"), F.min("bounty_start").alias("first"), F.max((F.col("creation_date") > F.col("bounty_end")).cast("int")).alias("ended"), F.count("*").alias("ever"))
    amount = votes.where("vote_type_id = 8").groupBy(F.col("post_id").alias("answer_id")).agg(F.max("bounty_amount").alias("amount"))
    x = a.join(b, "answer_id", "left").join(amount, "answer_id", "left").join(users.select(F.col("user_id").alias("owner_user_id"), "registration_date"), "owner_user_id", "left")
    if badges is None:
        x = x.withColumn("awarded", F.lit(None).cast("timestamp_ntz"))
    else:
        x = x.join(badges.where(F.col("name") == badge).groupBy(F.col("user_id").alias("owner_user_id")).agg(F.min("awarded").alias("awarded")), "owner_user_id", "left")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return x.select(
        "answer_id", F.col("parent_question_id").alias("question_id"), F.col("owner_user_id").alias("answerer"), F.col("q_owner").alias("asker"), ((micros("creation_date") - micros("q_ts")) / 6e7).alias("minutes"),
        F.dense_rank().over(Window.partitionBy("owner_user_id").orderBy("creation_date")).alias("sequence"), F.coalesce("active", F.lit(0)).alias("is_bounty"), flag(F.col("creation_date") < F.col("first")).alias("before_bounty"),
        flag((F.col("ended") == 1) & (F.col("active") == 0)).alias("after_bounty"), flag(F.col("ever") > 0).alias("ever_bounty"), F.coalesce("amount", F.lit(0)).alias("amount"), F.datediff("creation_date", "registration_date").alias("tenure_days"),
        flag(F.col("accepted_answer_id") == F.col("answer_id")).alias("accepted"), flag(F.col("awarded") <= F.col("creation_date")).alias("had_badge"),
    )


def missing_bounties(votes: DataFrame, bounties: DataFrame) -> DataFrame:
    """Posts with a bounty start vote (type 8) that the bounty timeline lacks."""
    started = votes.where("vote_type_id = 8 AND post_id IS NOT NULL").select(F.col("post_id").alias("question_id")).distinct()
    return started.join(bounties.select("question_id"), "question_id", "left_anti")


def with_missing_bounty(rows: DataFrame, missing: DataFrame) -> DataFrame:
    """``rows`` with ``missing_bounty``: whether their question is one of those."""
    return rows.join(missing.select("question_id").distinct().withColumn("missing_bounty", F.lit(True)), "question_id", "left").fillna(False, ["missing_bounty"])


def accept_phases(questions: DataFrame, answers: DataFrame, votes: DataFrame) -> DataFrame:
    """Phase two of an accepted answer: its own time if it was accepted on the same date, else the vote's; acceptance counts a day after the vote."""
    a = questions.select("question_id", F.col("accepted_answer_id").alias("answer_id")).join(answers.select("answer_id", "creation_date"), "answer_id").join(accept_votes(votes), "answer_id")
    same = F.to_date("vote_ts") == F.to_date("creation_date")
    return a.select("question_id", F.when(same, micros("creation_date")).otherwise(micros("vote_ts")).alias("phase_two_start"), (micros("vote_ts") + DAY).alias("effective"))


def bounty_phases(answers: DataFrame, bounties: DataFrame, days: int = 7) -> DataFrame:
    """Phase 0 within ``days`` before the first bounty (its start included), 1 within ``days`` after, null elsewhere."""
    b = bounties.groupBy(F.col("question_id").alias("parent_question_id")).agg(F.min("bounty_start").alias("s"))
    d = micros("creation_date") - micros("s")
    return answers.join(b, "parent_question_id").select("answer_id", F.when((d >= -days * DAY) & (d <= 0), 0).when((d >= 0) & (d <= days * DAY), 1).alias("phase"))


def event_study(bounties: DataFrame, questions: DataFrame, answers: DataFrame, days: int = 180) -> DataFrame:
    """Answers of askers within ``days`` around their question's first bounty: whether after it, and the relative month (30 days, floored)."""
    b = bounties.groupBy("question_id").agg(F.min("bounty_start").alias("t")).join(questions.where("owner_user_id IS NOT NULL").select("question_id", F.col("owner_user_id").alias("user_id")), "question_id")
    a = answers.where("owner_user_id IS NOT NULL").select(F.col("owner_user_id").alias("user_id"), "answer_id", F.col("creation_date").alias("ts"))
    x = within(b, a, micros("t") - days * DAY, micros("t") + days * DAY, micros("ts"), width=90 * DAY)
    return x.select("question_id", "answer_id", (F.col("ts") >= F.col("t")).cast("int").alias("post"), F.floor((micros("ts") - micros("t")) / (30 * DAY)).cast("int").alias("month"))


def outcome_counts(windows: DataFrame, events: DataFrame) -> DataFrame:
    """Events by arm of each outcome; an outcome whose controls have none is degenerate."""
    spark = windows.sparkSession
    sets = spark.createDataFrame([(k, v) for k, vs in OUTCOMES.items() for v in vs], "outcome string, help_type string")
    n = events.join(windows.select(*KEY, "treated"), KEY).groupBy("help_type").agg(F.count_if(F.col("treated") == 1).alias("t"), F.count_if(F.col("treated") == 0).alias("c"))
    out = sets.join(n, "help_type", "left").groupBy("outcome").agg(F.coalesce(F.sum("t"), F.lit(0)).alias("treated_events"), F.coalesce(F.sum("c"), F.lit(0)).alias("control_events"))
    return out.withColumn("degenerate", (F.col("control_events") == 0).cast("int"))
