"""Question-centred operators: first answers, flags, tags, windows, the event log and its metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400_000_000  # microseconds


def micros(c: Column | str) -> Column:
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def hours(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / 3.6e9


def others_answers(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Answers with their question, self-answers left out by the three-valued rule: an answer without an
    owner counts only if the question has none either."""
    q = questions.select(F.col("question_id").alias("parent_question_id"), F.col("owner_user_id").alias("q_owner"), F.col("creation_date").alias("q_ts"))
    return answers.join(q, "parent_question_id").where("owner_user_id <> q_owner OR q_owner IS NULL")


def accept_votes(votes: DataFrame) -> DataFrame:
    """(answer_id, accepts, vote_ts): accept votes (type 1) of each post, counted, and the earliest."""
    return votes.where("vote_type_id = 1").groupBy(F.col("post_id").alias("answer_id")).agg(F.count("*").alias("accepts"), F.min("creation_date").alias("vote_ts"))


def answer_facts(questions: DataFrame, answers: DataFrame, votes: DataFrame | None, first_days: int = 7) -> DataFrame:
    """One row an answered question, in one grouped pass over the answers: flags, first answer, accepted answer. Without ``votes`` what they tell is null.

    Self-answers are told by the three-valued rule (see ``others_answers``). The first answer is the earliest non-negative one within ``first_days``, else the
    earliest of any kind, ties to the smaller id; it is found as a minimum by (good and soon, time, id), so no question's answers are sorted.
    """
    q = questions.select(F.col("question_id").alias("parent_question_id"), F.col("owner_user_id").alias("q_owner"), F.col("creation_date").alias("q_ts"), "accepted_answer_id")
    if votes is None:
        a = answers.join(q, "parent_question_id").withColumn("_vote", F.lit(None).cast("struct<accepts:bigint,vote_ts:timestamp_ntz>"))
    else:  # votes go to their questions, so that only ids of answers move for them
        voted = answers.select("answer_id", "parent_question_id").join(accept_votes(votes), "answer_id").groupBy("parent_question_id")
        q = q.join(voted.agg(F.map_from_entries(F.collect_set(F.struct("answer_id", F.struct("accepts", "vote_ts").alias("v")))).alias("_voted")), "parent_question_id", "left")
        a = answers.join(q, "parent_question_id").withColumn("_vote", F.element_at("_voted", F.col("answer_id")))
    votes_of = lambda n: n if votes is not None else F.lit(None).cast("bigint")
    other = F.coalesce(F.expr("owner_user_id <> q_owner OR q_owner IS NULL"), F.lit(False))
    good, soon = F.col("score") >= 0, micros("creation_date") <= micros("q_ts") + first_days * DAY
    facts = F.struct(F.col("creation_date").alias("first_ts"), F.col("score").alias("first_answer_score"), F.col("answer_id").alias("first_answer_id"), votes_of(F.coalesce("_vote.accepts", F.lit(0))).alias("first_answer_votes"), F.col("body_len_chars").alias("first_answer_body_len_chars"))
    rank = F.struct((~(good & soon)).cast("int"), "creation_date", "answer_id")
    accepted = F.col("answer_id") == F.col("accepted_answer_id")
    flag = lambda c: F.max(F.coalesce(c, F.lit(False)).cast("int"))
    got = a.groupBy(F.col("parent_question_id").alias("question_id")).agg(
        flag(other & good).alias("good"), flag(other & ~good & soon).alias("down"), flag(F.col("owner_user_id") == F.col("q_owner")).alias("own"),
        F.min_by(F.when(other, facts), F.when(other, rank)).alias("first"),
        F.max(F.when(other & accepted, F.struct(F.col("creation_date").alias("accepted_ts"), F.col("_vote.vote_ts").alias("vote_ts")))).alias("accepted"),
    )
    return got.select("question_id", "good", "down", "own", "first.*", "accepted.*")


def eligible_questions(questions: DataFrame, answers: DataFrame, votes: DataFrame | None, users: DataFrame | None, first_days: int = 7, accepted_by_id: bool = False, one_per_user: bool = False, seed: int = 42) -> DataFrame:
    """One row a question with an owner: answer flags, first and accepted answer facts. Accept votes are deduplicated.

    ``accepted_by_id`` takes any accepted answer id as accepted (the one-question rule), ``one_per_user`` keeps one
    question of each owner, by a seeded hash. Without ``votes`` or ``users`` (where a study does not ask for what they tell) that is null.
    """
    out = questions.where("owner_user_id IS NOT NULL")
    if one_per_user:
        out = out.withColumn("rn", F.row_number().over(Window.partitionBy("owner_user_id").orderBy(F.xxhash64("question_id", F.lit(seed)), "question_id"))).where("rn = 1").drop("rn")
    out = out.join(answer_facts(questions, answers, votes, first_days), "question_id", "left")
    out = out.join(users.select(F.col("user_id").alias("owner_user_id"), "reputation"), "owner_user_id", "left") if users is not None else out.withColumn("reputation", F.lit(None).cast("bigint"))
    good = F.coalesce("good", F.lit(0))
    has_accepted = F.col("accepted_answer_id").isNotNull() if accepted_by_id else F.col("accepted_ts").isNotNull()
    return out.select(
        "question_id", "owner_user_id", "creation_date", "tags", good.alias("has_answer"), F.when((good == 0) & (F.col("down") == 1), 1).otherwise(0).alias("has_unhelpful_answer"),
        has_accepted.cast("int").alias("has_accepted_answer"), F.coalesce("own", F.lit(0)).alias("has_self_answer"),
        "first_ts", "first_answer_score", "first_answer_id", "first_answer_votes", "first_answer_body_len_chars", "accepted_ts", "vote_ts", "view_count", "body_len_chars", "title_len_chars", "n_code_blocks", F.col("reputation").alias("owner_reputation"),
    )


def exploded_tags(questions: DataFrame) -> DataFrame:
    inner = F.regexp_replace("tags", "^<|>$", "")
    return questions.where("tags IS NOT NULL").select("question_id", F.explode(F.split(inner, "><")).alias("tag_name")).where("tag_name <> ''")


def tag_dictionary(questions: DataFrame) -> DataFrame:
    """tag_id (rank by name), tag_name, tag_frequency. The rank's single task sees distinct names alone."""
    freq = exploded_tags(questions).groupBy("tag_name").agg(F.count("*").alias("tag_frequency"))
    return freq.select(F.row_number().over(Window.orderBy("tag_name")).cast("long").alias("tag_id"), "tag_name", "tag_frequency")


def tag_lists(questions: DataFrame, dictionary: DataFrame) -> DataFrame:
    """tags, sorted tag_ids: a row a distinct text of tags, so that no question is taken apart and put together again."""
    texts = exploded_tags(questions.select(F.col("tags").alias("question_id"), "tags").distinct())
    return texts.join(dictionary.select("tag_id", "tag_name"), "tag_name").groupBy(F.col("question_id").alias("tags")).agg(F.sort_array(F.collect_list("tag_id")).alias("tag_ids"))


def question_tags(questions: DataFrame, dictionary: DataFrame) -> DataFrame:
    """question_id, sorted tag_ids."""
    return questions.select("question_id", "tags").join(tag_lists(questions, dictionary), "tags").select("question_id", "tag_ids")


def helps_between(units: DataFrame, answers: DataFrame, questions: DataFrame, closed: bool = False, drop_self_only: bool = False) -> DataFrame:
    """Answers that a unit's user gave to others' questions within [lo, hi) (or [lo, hi]).

    ``units`` has unit_id, user_id, lo, hi. The bounds are put among the user's answers, and running counts at the two bounds are
    subtracted: a user's rows are sorted once, however many units the user has. With ``drop_self_only`` a unit whose answers
    in the window are all to its own questions gets no row; else it gets 0.
    """
    given = answers.join(questions.select(F.col("question_id").alias("parent_question_id"), F.col("owner_user_id").alias("asker")), "parent_question_id")
    none = F.lit(None).cast("long")
    # at equal times the lower bound comes before the answers, the upper one before (half-open) or after them (closed)
    e = given.where("owner_user_id IS NOT NULL").select(F.col("owner_user_id").alias("user_id"), micros("creation_date").alias("us"), F.lit(1).alias("turn"), none.alias("unit_id"), F.lit(0).alias("sign"), F.expr("cast(coalesce(asker <> owner_user_id, true) as int)").alias("other"), F.lit(1).alias("any"))
    marks = F.array(F.struct(micros("lo").alias("us"), F.lit(0).alias("turn"), F.lit(-1).alias("sign")), F.struct(micros("hi").alias("us"), F.lit(2 if closed else 0).alias("turn"), F.lit(1).alias("sign")))
    m = units.select("unit_id", "user_id", F.explode(marks).alias("m")).select("user_id", "m.us", "m.turn", "unit_id", "m.sign", F.lit(0).alias("other"), F.lit(0).alias("any"))
    w = Window.partitionBy("user_id").orderBy("us", "turn").rowsBetween(Window.unboundedPreceding, 0)
    run = e.unionByName(m).select("unit_id", "sign", F.sum("other").over(w).alias("other"), F.sum("any").over(w).alias("any")).where("unit_id IS NOT NULL")
    out = run.groupBy("unit_id").agg(F.greatest(F.lit(0), F.sum(F.col("sign") * F.col("other"))).alias("helps"), F.sum(F.col("sign") * F.col("any")).alias("seen"))
    out = out.where("seen = 0 OR helps > 0") if drop_self_only else out
    return out.select("unit_id", "helps")


def within(windows: DataFrame, events: DataFrame, lo: Column, hi: Column, at: Column, key: str = "user_id", width: int = 7 * DAY) -> DataFrame:
    """Inner join of windows and events on ``key`` and lo <= at <= hi (microseconds).

    Time is cut into spans of ``width``: a window is dealt to the few spans that it touches, an event lies in one. So the
    equi-join has (key, span) as its key, and a user's old events meet none of the user's late windows. The bounds are worked out again
    after the join, so that they do not move; so columns of windows and events must differ in name, but for the key.
    """
    spans = F.sequence(F.floor(lo / width), F.floor(hi / width))
    w = windows.where(lo <= hi).withColumn("_span", F.explode(spans))
    e = events.withColumn("_span", F.floor(at / width))
    return w.join(e, [key, "_span"]).where((at >= lo) & (at <= hi)).drop("_span")


def window_answers(eligible: DataFrame, questions: DataFrame, answers: DataFrame, days: int = 7) -> DataFrame:
    """(user_id, ts, question_id, answer_id): answers to others' questions within the closed window around each of the user's own."""
    p = eligible.select(F.col("owner_user_id").alias("user_id"), "question_id", F.col("creation_date").alias("q_at"))
    a = others_answers(answers, questions).where("owner_user_id IS NOT NULL").select(F.col("owner_user_id").alias("user_id"), "answer_id", F.col("creation_date").alias("ts"))
    return within(p, a, micros("q_at") - days * DAY, micros("q_at") + days * DAY, micros("ts")).select("user_id", "ts", "question_id", "answer_id")


def event_log(eligible: DataFrame, questions: DataFrame, answers: DataFrame, votes: DataFrame, days: int = 7) -> DataFrame:
    """Tagged union of the past and present events of eligible askers: user_id, event, ts, ref_id, is_history.

    ``ref_id`` is the question or answer of a past event, and the question of a present one. Answers and accepted answers
    given to oneself are no events; one received from oneself is.
    """
    askers = eligible.select(F.col("owner_user_id").alias("user_id")).distinct()
    event = lambda df, who, name, ts, ref: df.select(F.col(who).alias("user_id"), F.lit(name).alias("event"), F.col(ts).alias("ts"), F.col(ref).alias("ref_id"))
    got = answers.join(questions.select(F.col("accepted_answer_id").alias("answer_id"), F.col("owner_user_id").alias("asker")), "answer_id")
    past = event(questions, "owner_user_id", "Question", "creation_date", "question_id")
    past = past.unionByName(event(others_answers(answers, questions), "owner_user_id", "Answer", "creation_date", "answer_id"))
    past = past.unionByName(event(got, "asker", "AcceptedAnswer", "creation_date", "answer_id"))
    past = past.unionByName(event(got.where("owner_user_id <> asker OR asker IS NULL"), "owner_user_id", "AcceptedAnswerPosted", "creation_date", "answer_id"))
    past = past.unionByName(event(answers.join(accept_votes(votes), "answer_id"), "owner_user_id", "AcceptedAnswerVote", "vote_ts", "answer_id"))
    now = eligible.select(F.col("owner_user_id").alias("user_id"), F.explode(F.array(
        F.struct(F.lit("Phase_One_Start").alias("event"), (F.col("creation_date") - F.make_dt_interval(F.lit(days))).alias("ts")),
        F.struct(F.lit("Phase_Two_Start").alias("event"), F.col("creation_date").alias("ts")),
        F.struct(F.lit("Phase_Two_End").alias("event"), (F.col("creation_date") + F.make_dt_interval(F.lit(days))).alias("ts")))).alias("e"), F.col("question_id").alias("ref_id")).select("user_id", "e.event", "e.ts", "ref_id")
    now = now.unionByName(event(window_answers(eligible, questions, answers, days), "user_id", "Window_Answer", "ts", "question_id"))
    return past.join(askers, "user_id", "left_semi").withColumn("is_history", F.lit(1)).unionByName(now.withColumn("is_history", F.lit(0)))


HISTORY_KINDS = ("Question", "Answer", "AcceptedAnswer", "AcceptedAnswerVote", "AcceptedAnswerPosted")
HISTORY_WINDOWS = {"AT": 0, "30D": 30, "14D": 14, "7D": 7, "3D": 3}


def history_metrics(targets: DataFrame, log: DataFrame, windows: dict[str, int] | None = None, kinds: tuple[str, ...] = ("Question", "Answer", "AcceptedAnswer")) -> DataFrame:
    """Counts of each kind strictly before each target's ``at``, over all time and trailing windows, and days since the first question or answer.

    Each target (unit_id, user_id, at) puts a mark among its user's events at ``at`` and at every window's start; running counts at two marks are subtracted.
    So a user's rows are sorted and passed once, however many events a window holds. No history gives zeros, as does an ``at`` that is null; events without a time count nowhere.
    """
    windows = windows or {"AT": 0, "30D": 30, "7D": 7}
    counted = [F.when(F.col("event") == k, 1).otherwise(0).alias(f"_{k}") for k in kinds]
    seen = F.when(F.col("event").isin("Question", "Answer"), micros("ts")).alias("_first")
    none = lambda t: F.lit(None).cast(t)
    e = log.where("is_history = 1 AND ts IS NOT NULL").where(F.col("event").isin(*kinds, "Question", "Answer"))
    e = e.select("user_id", micros("ts").alias("us"), F.lit(1).alias("_turn"), none("long").alias("unit_id"), none("long").alias("_at"), none("int").alias("_days"), *counted, seen)
    spans = F.array(*[F.lit(d) for d in sorted({0, *windows.values()})])
    m = targets.where("unit_id IS NOT NULL").select("user_id", "unit_id", micros("at").alias("_at"), F.explode(spans).alias("_days"))
    m = m.select("user_id", (F.col("_at") - F.col("_days") * F.lit(DAY)).alias("us"), F.lit(0).alias("_turn"), "unit_id", "_at", "_days", *[F.lit(0).alias(f"_{k}") for k in kinds], none("long").alias("_first"))
    w = Window.partitionBy("user_id").orderBy("us", "_turn").rowsBetween(Window.unboundedPreceding, 0)  # at equal times marks come first
    run = e.unionByName(m).select("user_id", "unit_id", "_at", "_days", *[F.sum(f"_{k}").over(w).alias(f"_{k}") for k in kinds], F.min("_first").over(w).alias("_first")).where("unit_id IS NOT NULL")
    mark = lambda c, d: F.max(F.when(F.col("_days") == d, F.col(c)))
    cols = [(mark(f"_{k}", 0) - (mark(f"_{k}", d) if d else F.lit(0))).alias(f"n_{k}_{name}") for k in kinds for name, d in windows.items()]
    first = F.coalesce((F.col("_at") - mark("_first", 0)) / DAY, F.lit(0.0)).alias("days_active")
    return run.groupBy("user_id", "unit_id", "_at").agg(*cols, first).drop("user_id", "_at")  # a user's rows are together already


def experience_codes(metrics: DataFrame) -> DataFrame:
    """Codes of what a user has received and given: 0 nothing asked (answered), 1 none accepted, 2 one accepted at least."""
    code = lambda any_, accepted: F.when(F.col(any_) == 0, 0).when(F.col(accepted) == 0, 1).otherwise(2)
    out = [code("n_Question_AT", "n_AcceptedAnswer_AT").alias("receiving")]
    if "n_AcceptedAnswerPosted_AT" in metrics.columns:
        out.append(code("n_Answer_AT", "n_AcceptedAnswerPosted_AT").alias("giving"))
    return metrics.select("unit_id", *out)


def activation(log: DataFrame, days: int = 7) -> DataFrame:
    """First answer of each user that has an accepted answer received within the ``days`` before it."""
    e = log.where("is_history = 1").select("user_id", micros("ts").alias("us"), "event")
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(-days * DAY + 1, -1)
    seen = e.withColumn("n", F.sum((F.col("event") == "AcceptedAnswer").cast("int")).over(w))
    return seen.where("event = 'Answer' AND n > 0").groupBy("user_id").agg(F.min("us").alias("first_us"))


def batch_ids(ids: DataFrame, key: str, size: int, width: int = 4096) -> DataFrame:
    """(key, batch_id): distinct whole-number keys in ascending order, ``size`` to a batch.

    Keys are ranked within ranges of ``width`` values; only the ranges' counts go through one task.
    """
    bucket = F.floor(F.col(key) / F.lit(width)).alias("_b")
    x = ids.select(key, bucket)
    sizes = x.groupBy("_b").agg(F.count("*").alias("_n"))
    before = sizes.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_before"))
    ranked = x.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy(key))).join(before, "_b")
    return ranked.select(key, F.floor((F.col("_before") + F.col("_r") - 1) / F.lit(size)).cast("bigint").alias("batch_id"))
