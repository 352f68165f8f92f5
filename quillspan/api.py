"""Entry points: each stage reads named tables of a folder, runs the operators and writes its results.

Tables are Parquet in any file system that Spark reads. The columns are those of ``quillspan.sources.testdata``: questions, answers,
votes, users, comments, edits (and bounties). Every function returns the path, or the paths by name, that it has written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import events as E
from .operators import features as X
from .operators import fits, rates
from .operators import study as S
from .operators.quantiles import wide_quantiles
from .sources import dump, files


def _read(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{folder.rstrip('/')}/{n}.parquet") for n in names]


def _write(df: DataFrame, folder: str, name: str) -> str:
    return files.write_atomic(df, f"{folder.rstrip('/')}/{name}.parquet", compression="gzip")


def convert_dump(spark: SparkSession, xml: dict[str, str], output: str, history_only: bool = False, history_name: str = "edits") -> dict[str, str]:
    """Dump files by kind (posts, votes, users, comments, edits, badges) to tables; posts are also split into questions and answers."""
    out = {}
    for kind, path in xml.items():
        if history_only and kind != "edits":
            continue
        out[kind] = _write(dump.read_xml(spark, path, kind), output, history_name if kind == "edits" else kind)
    if "posts" in out:
        posts = spark.read.parquet(out["posts"])
        names = ["posts_questions.parquet", "posts_answers.parquet"]
        out |= dict(zip(("questions", "answers"), dump.split_by_column(posts, output, "PostTypeId", [1, 2], names), strict=True))
    return out


def raw_dataset(spark: SparkSession, source: str, output: str, window_length: int = 7, include_all_questions: bool = True, test_user_limit: int | None = None) -> dict[str, str]:
    """Eligible questions, the tag tables and the event log. ``test_user_limit`` keeps a reproducible sample of users."""
    questions, answers, votes, users = _read(spark, source, "questions", "answers", "votes", "users")
    eligible = E.eligible_questions(questions, answers, votes, users, accepted_by_id=not include_all_questions, one_per_user=not include_all_questions)
    if test_user_limit is not None:
        eligible = eligible.join(X.sample_ids(eligible, "owner_user_id", test_user_limit), "owner_user_id", "left_semi")
    out = {"eligible": _write(eligible, output, "eligible_questions")}
    eligible = spark.read.parquet(out["eligible"])
    dictionary = E.tag_dictionary(questions)
    out["tag_dictionary"] = _write(dictionary, output, "tag_dictionary")
    out["question_tags"] = _write(E.question_tags(questions, spark.read.parquet(out["tag_dictionary"])), output, "question_tags")
    out["events"] = _write(E.event_log(eligible, questions, answers, votes, window_length), output, f"events_{window_length}d")
    return out


def process_dataset(spark: SparkSession, raw: str, output: str, window_length: int = 7, cutoff_date: str | None = "2025-04-01") -> str:
    """One processed row a question, from the tables that ``raw_dataset`` wrote."""
    eligible, tags, log = _read(spark, raw, "eligible_questions", "question_tags", f"events_{window_length}d")
    targets = eligible.select(F.col("question_id").alias("unit_id"), F.col("owner_user_id").alias("user_id"), (F.col("creation_date") - F.make_dt_interval(F.lit(window_length))).alias("at"))
    metrics = E.history_metrics(targets, log, kinds=("Question", "Answer"))
    rows = X.question_rows(eligible, log, metrics, tags, window_length, cutoff_date)
    return _write(rows.join(eligible.select("question_id", "creation_date"), "question_id"), output, "processed")


def match_questions(spark: SparkSession, processed: str, output: str, caliper: float = 0.05, neighbors: int = 100, min_stratum: int = 300, min_tag_count: int = 100) -> dict[str, str]:
    """Pairs matched on the per-stratum propensity, the matched rows, the balance and the reuse of controls. All strata run as one job; no shards are needed."""
    df = X.impute_median(spark.read.parquet(processed), ["view_count", "body_len_chars", "title_len_chars", "owner_reputation", "post_hour", "post_day_of_week", "num_tags"])
    df = X.with_tag_shares(df, X.tag_shares(df, "has_accepted_answer", min_count=min_tag_count), "has_accepted_answer")
    df = X.selection_covariates(df).withColumns({"main_tag": F.array_min("tag_ids"), "response_days": F.col("response_hours") / 24, "num_tags": F.col("num_tags").cast("int"), "score": F.lit(0.0)})
    pool = S.prematch(df, min_stratum)
    covs = ["log_body", "title_len_chars", "hour_sin", "hour_cos", "is_weekend", "days_active", "tag_share_avg"]
    out = {"pool": _write(pool.drop("score").join(S.propensity(pool, covs, ["year", "main_tag"]), "question_id"), output, "prematch")}
    pool = spark.read.parquet(out["pool"])
    out["pairs"] = _write(S.match(pool, caliper, neighbors), output, "pairs")
    pairs = spark.read.parquet(out["pairs"])
    sides = pairs.select(F.col("treated_id").alias("match_id"), F.explode(F.array(F.struct(F.col("treated_id").alias("question_id"), F.lit(1).alias("side")), F.struct(F.col("control_id").alias("question_id"), F.lit(0).alias("side")))).alias("s")).select("match_id", "s.*")
    reuse = pairs.groupBy(F.col("control_id").alias("question_id")).agg(F.count("*").alias("control_reuse_count"))
    out["matched"] = _write(sides.join(pool.drop("treated"), "question_id").withColumnRenamed("side", "treated").join(reuse, "question_id", "left"), output, "matched_questions")
    out["balance"] = _write(S.balance(pool, pairs, covs), output, "balance")
    out["reuse"] = _write(S.control_reuse(pairs), output, "control_reuse")
    return out


def helping_metrics(spark: SparkSession, matched: str, source: str, output: str) -> str:
    """Answers that each matched asker gave to others from the question to the pair's answer (half-open); rows without any have 0."""
    questions, answers = _read(spark, source, "questions", "answers")
    m = spark.read.parquet(matched)
    seconds = m.groupBy("match_id").agg(F.rint(F.max(F.when(F.col("treated") == 1, F.col("response_hours"))) * 3600).cast("long").alias("secs"))
    m = m.join(seconds, "match_id").withColumn("unit_id", F.xxhash64("match_id", "question_id"))
    units = m.select("unit_id", "user_id", F.col("creation_date").alias("lo"), (F.col("creation_date") + F.make_dt_interval(secs=F.col("secs"))).alias("hi"))
    given = E.helps_between(units, answers, questions)
    return _write(m.join(given, "unit_id").select("match_id", "question_id", "user_id", "treated", "response_hours", F.col("helps").alias("helps_given_in_window")), output, "helping_metrics")


def event_histories(spark: SparkSession, matched: str, source: str, output: str, pre_days: int = 2, post_days: int = 2, composite: bool = True, include_accepts: bool = False) -> dict[str, str]:
    """Study windows and the help events within them; without ``composite`` answers alone count."""
    questions, answers, users, comments, edits = _read(spark, source, "questions", "answers", "users", "comments", "edits")
    m = spark.read.parquet(matched).withColumnRenamed("user_id", "owner_user_id")
    windows = S.study_windows(m, users, pre_days, post_days).join(m.select("match_id", "question_id", F.year("creation_date").alias("question_year"), *fits.OBSERVABLE, "has_accepted_answer", "first_answer_score", "first_answer_body_len_chars", "view_count"), ["match_id", "question_id"])
    out = {"timelines": _write(windows, output, "study_timelines")}
    windows = spark.read.parquet(out["timelines"])
    none = 0 if not composite else None
    help_ = S.help_events(windows, answers, comments if none is None else comments.limit(0), edits if none is None else edits.limit(0), questions, include_accepts)
    out["events"] = _write(help_, output, "study_events")
    return out


def model_rows(spark: SparkSession, study: str, output: str, sample: int | None = None, help_types: list[str] | None = None) -> str:
    """Interval rows with covariates, the table that every fit reads. ``sample`` keeps that many pairs."""
    w, h = _read(spark, study, "study_timelines", "study_events")
    if help_types:
        h = h.where(F.col("help_type").isin(help_types))
    if sample is not None:
        keep = X.sample_ids(w, "match_id", sample)
        w, h = w.join(keep, "match_id", "left_semi"), h.join(keep, "match_id", "left_semi")
    zero = [F.when(F.col("treated") == 0, F.coalesce(c, F.lit(0))).otherwise(F.col(c)).alias(c) for c in fits.QUALITY]
    w = w.select(*[c for c in w.columns if c not in fits.QUALITY], *zero)
    rows = S.covariates(S.intervals(w, h), w, (*fits.OBSERVABLE, *fits.QUALITY, "question_year"))
    return _write(X.finite(rows.select("*", *S.score_codings(F.col("first_answer_score"))), ["match_id", "start", "stop", "event", "treated", "post", "tenure_bucket"]), output, "model_rows")


def _results(spark: SparkSession, fitted, output: str, name: str) -> str:
    """A row a term of each fit; a model without one has a row with the reason."""
    schema = "sample string, spec string, term string, coef double, se double, z double, p double, hr double, ci_lo double, ci_hi double, n_rows bigint, n_events bigint, se_robust double, reason string"
    rows = []
    for s, k, f in fitted:
        if f:
            rows += [(s, k, t, *f.row(t).values(), f.n_rows, f.n_events, f.robust_se(t), None) for t in f.names]
        else:
            rows.append((s, k, *[None] * 8, *((f.n_rows, f.n_events) if f is not None else (None, None)), None, f.reason if f is not None else "no fit"))
    return files.write_csv(spark.createDataFrame(rows, schema).coalesce(1), f"{output.rstrip('/')}/{name}.csv")


def cox_models(spark: SparkSession, rows: str, output: str, cluster: bool = True) -> dict[str, str]:
    """Models A and B pooled and by tenure bucket, and model A by response-time bin, with errors clustered by pair unless ``cluster`` is off."""
    m, specs, by = spark.read.parquet(rows), {k: fits.SPECS[k] for k in ("A", "B")}, "match_id" if cluster else None
    out = {"tenure": _results(spark, fits.stratified(m, "tenure_bucket", specs, cluster=by), output, "results_tenure")}
    out["bins"] = _results(spark, [(s, "A", f) for s, f in fits.response_time_fits(m, cluster=by)], output, "results_bins")
    return out


def bootstrap(spark: SparkSession, rows: str, output: str, scope: str | None = None, replicates: int = 100, seed: int = 42, first: int = 0, max_pairs: int | None = None) -> str:
    """Replicates ``first`` to ``first + replicates`` of the pair bootstrap, of all rows or one tenure bucket, kept by (scope, replicate) when run again.

    A replicate draws as many pairs as there are, with replacement; ``max_pairs`` first takes that many pairs at random.
    """
    m = spark.read.parquet(rows)
    m = m if scope is None else m.where(F.col("tenure_bucket") == scope)
    if max_pairs is not None:
        m = m.join(X.sample_ids(m, "match_id", max_pairs, seed), "match_id", "left_semi")
    new = [(scope or "All", r, *[f.row(t)["coef"] for t in ("treated_active", "treated_post_question")]) for r, f in fits.drawn_bootstrap(m, replicates, seed, first) if f]
    df, path = spark.createDataFrame(new, "scope string, replicate int, treated_active double, treated_post_question double"), f"{output.rstrip('/')}/bootstrap.parquet"
    if files.exists(spark, path):
        df = df.unionByName(spark.read.parquet(path).join(df.select("scope", "replicate"), ["scope", "replicate"], "left_anti"))
    return files.write_atomic(df, path)


def merge_bootstrap(spark: SparkSession, path: str) -> DataFrame:
    """Deviation and percentiles of the replicates of each scope and term."""
    b = spark.read.parquet(path).select("scope", F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.col(t).alias("coef")) for t in ("treated_active", "treated_post_question")])).alias("r")).select("scope", "r.*")
    return b.groupBy("scope", "term").agg(F.count("coef").alias("n"), F.stddev_samp("coef").alias("sd"), F.percentile("coef", F.lit(0.025)).alias("lo"), F.percentile("coef", F.lit(0.975)).alias("hi"))  # a row a replicate


ROBUSTNESS = {"observable": ["A", "observable"], "quality": ["B", "speed_length", "speed_score", "speed_quality"], "score_coding": ["speed_score", "speed_asinh", "speed_bins"], "newcomer": ["A", "observable", "B", "speed_length", "speed_score", "speed_quality"], "rt_bins_quality": ["quality"]}
NEWCOMER = "tenure_bucket = '< 1 Week'"


def robustness(spark: SparkSession, rows: str, output: str, only: str = "all", study: str | None = None) -> dict[str, str]:
    """The robustness families: observable controls, answer quality, score codings, newcomers, response-time bins with quality.

    With the folder of the ``study`` also ``composite`` (the outcome taken apart) and, only if it is asked for by name, the view-count ``placebo``.
    """
    m, out = spark.read.parquet(rows), {}
    for name, specs in ROBUSTNESS.items():
        if only not in ("all", name):
            continue
        if name == "rt_bins_quality":
            fitted = [(s, "quality", f) for s, f in fits.response_time_fits(m, fits.SPECS["quality"])]
        else:
            part = m.where(NEWCOMER) if name == "newcomer" else m
            fitted = [("newcomers" if name == "newcomer" else "All", k, fits.cox(part, fits.SPECS[k])) for k in specs]
        out[name] = _results(spark, fitted, output, f"results_{name}")
    if study is not None and only in ("all", "composite"):
        w, h = _read(spark, study, "study_timelines", "study_events")
        whole = S.phases(S.intervals_of_sets(w, h, fits.OUTCOMES))
        out["composite"] = _results(spark, [(k, "A", f) for k, f in fits.fit_models(whole, fits.MAIN, F.array("outcome")).items()], output, "results_composite")
    if study is not None and only == "placebo":
        w, h = _read(spark, study, "study_timelines", "study_events")
        views = w.where("treated = 0").select("match_id", "question_id", "t_start", "t_answer", "t_end", "view_count")
        views = views.crossJoin(F.broadcast(wide_quantiles(views, ["view_count"], [0.5], lambda c, q: "m")))
        split = X.pre_post(views.withColumn("high_view", (F.col("view_count") >= F.col("m")).cast("int")).drop("view_count", "m"), h).withColumn("high_view_post", F.col("high_view") * F.col("post"))
        out["placebo"] = _results(spark, [("unanswered", "views", fits.cox(split, ["post", "high_view", "high_view_post"], cluster="match_id"))], output, "results_placebo")
    return out


def cohorts(spark: SparkSession, rows: str, output: str, split_year: int = 2020) -> str:
    """Model A before and from ``split_year`` (or the year that stands in for it, see ``fits.cohort_fits``), over all and for newcomers."""
    fitted = fits.cohort_fits(spark.read.parquet(rows), split_year)
    return _results(spark, [(s, "A", f) for s, f in fitted.items()], output, "results_cohorts")


def selection(spark: SparkSession, study: str, rows: str, output: str, fractions: list[float] | None = None) -> str:
    """Selection bounds of the event-rate ratio after the question, over all and by tenure bucket, beside the fitted arrival ratios of models A and B."""
    w, h = _read(spark, study, "study_timelines", "study_events")
    n = h.where("t_event >= 0").groupBy("match_id", "question_id").agg(F.count("*").alias("n"))
    units = w.join(n, ["match_id", "question_id"], "left").fillna(0, ["n"]).withColumn("scope", F.explode(F.array(S.tenure_bucket(F.col("tenure_days")), F.lit("All"))))
    found = fits.stratified(spark.read.parquet(rows), "tenure_bucket", {k: fits.SPECS[k] for k in ("A", "B")})
    keep = ("hr", "ci_lo", "ci_hi", "se", "p")
    models = [(s, k, *[f.row("treated_active")[c] for c in keep]) for s, k, f in found if f]
    table = spark.createDataFrame(models, "scope string, model string, hr double, ci_lo double, ci_hi double, se double, p double")
    return files.write_csv(S.with_models(S.selection_bounds(units, fractions or [0.0, 0.01, 0.05, 0.1, 0.25, 0.5, 1.0]), table).coalesce(1), f"{output.rstrip('/')}/results_selection.csv")


def preperiod_placebo(spark: SparkSession, study: str, output: str, at: float = -24.0) -> str:
    """Models A and B of newcomers with intervals cut at ``at`` hours and a term of the treated from there up to the question."""
    w, h = _read(spark, study, "study_timelines", "study_events")
    x = S.covariates(S.cut_intervals(S.intervals(w, h), at), w).where(NEWCOMER)
    x = x.withColumn("treated_pre", ((F.col("start") >= at) & (F.col("start") < 0) & (F.col("treated") == 1)).cast("int"))
    return _results(spark, [("newcomers", k, fits.cox(x, [*fits.SPECS[k], "treated_pre"])) for k in ("A", "B")], output, "results_preperiod")


def help_rates(spark: SparkSession, study: str, output: str, bin_hours: float = 4.0, adoption_bin_hours: float = 2.0, adoption_max_hours: float = 24.0) -> dict[str, str]:
    """Data of the rate figures: rates by bucket and arm, adoption rates, and rates of the never answered."""
    w, h = _read(spark, study, "study_timelines", "study_events")
    w = w.withColumn("bucket", S.tenure_bucket(F.col("tenure_days")))
    low, high = w.agg(F.min("t_start"), F.max("t_end")).first()
    out = {"binned": rates.rates_on_edges(w, h, rates.bin_edges(low, high, bin_hours), ["bucket", "treated"]), "adoption": rates.adoption_rates(w, h, adoption_bin_hours, adoption_max_hours), "stable": rates.stable_control_rates(w, h, adoption_bin_hours, adoption_max_hours)}
    return {k: _write(v, output, f"rates_{k}") for k, v in out.items()}
