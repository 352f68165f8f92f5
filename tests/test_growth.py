"""What must not grow faster than the tables: work done once a row, tables made on demand; and results that only larger tables tell apart."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quillspan.operators import events, study
from quillspan.plans import more
from quillspan.sources import dump
from quillspan.sources.testdata import TABLES, qa_tables


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_line_of_a_damaged_dump_is_parsed_once(spark, tmp_path):
    (tmp_path / "v.xml").write_text("<votes>\n<row Id='1' PostId='1' VoteTypeId='2' />\n</votes>")
    good, broken = dump.read_xml_kept(spark, str(tmp_path / "v.xml"), "votes")
    assert plan(good.groupBy("PostId").count()).count("from_xml(") == 1 and plan(broken.groupBy("reason", "columns").count()).count("from_xml(") == 1


def test_frequencies_of_unlike_lengths_come_in_the_order_of_the_sql(spark):
    q = spark.createDataFrame([(i, "<a>" if i < 10 else "<b>") for i in range(19)], "question_id long, tags string")
    ids = more.q_latex({"questions": q.union(spark.createDataFrame([(100 + i, f"<t{i}>") for i in range(7)], q.schema))})
    assert [tuple(r) for r in ids.collect()] == [("b", "9"), ("a", "10"), *((f"t{i}", "1") for i in range(6))]


def test_history_counts_without_frames_by_range(spark):
    at = datetime(2020, 1, 31)
    log = [(1, "Question", at - timedelta(days=40)), (1, "Answer", at - timedelta(days=30)), (1, "Answer", at - timedelta(days=7, microseconds=1)), (1, "AcceptedAnswer", at - timedelta(microseconds=1)), (1, "Answer", at), (1, "Answer", None), (2, "Answer", at)]
    log = spark.createDataFrame([(*r, 1) for r in log], "user_id long, event string, ts timestamp_ntz, is_history int")
    targets = spark.createDataFrame([(10, 1, at), (11, 1, at), (20, 2, at), (30, 3, at), (40, 1, None)], "unit_id long, user_id long, at timestamp_ntz")
    m = events.history_metrics(targets, log)
    got = {r.unit_id: r for r in m.collect()}
    assert len(got) == 5 and got[10].n_Answer_30D == 2 and got[10].n_Answer_7D == 0 and got[10].n_Answer_AT == 2 and got[10].n_Question_30D == 0 and got[10].n_AcceptedAnswer_7D == 1 and got[10].days_active == 40.0
    assert got[11][1:] == got[10][1:] and all(v == 0 for k in (20, 30, 40) for v in got[k][1:])
    assert "RangeFrame" not in plan(m)  # a frame that slides by range adds up all of its rows again for each row


def test_tables_are_made_when_they_are_read(spark, tmp_path):
    for n in ("customer", "orders", "lineitem", "events"):
        spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet").write.parquet(f"{tmp_path}/{n}.parquet")
    t = qa_tables(spark, str(tmp_path))
    assert not set(t) & set(TABLES)
    p = plan(t.unwritten("questions").select("question_id", "view_count"))
    assert "Join" not in p and "Aggregate" not in p and not set(t) & set(TABLES)
    assert t["users"].count() and set(t) & set(TABLES) == {"users"}
    assert t["answers"].count() == t["lineitem"].count() and set(t) & set(TABLES) == {"users", "answers0", "answers"}


def test_matching_sorts_no_rows_of_pairs(spark):
    rows = [(i, 2020, 1, 3, i % 2, i / 1000, [1, i % 3, 7]) for i in range(40)]
    df = spark.createDataFrame(rows, "question_id long, year int, main_tag long, num_tags int, treated int, score double, tag_ids array<long>")
    pairs = study.match(df, caliper=0.006, k=4)
    assert "row_number" not in plan(pairs)
    alike = lambda a, b: len({*a} & {*b}) / len({*a} | {*b})
    want = []
    for t in (r for r in rows if r[4]):
        near = sorted((abs(c[5] - t[5]), c[0], c[6]) for c in rows if not c[4] and abs(c[5] - t[5]) <= 0.006)[:4]
        best = min((-alike(t[6], tags), d, i) for d, i, tags in near)
        want.append((t[0], best[2], best[1], -best[0]))
    assert sorted(tuple(r) for r in pairs.collect()) == want


def test_intervals_of_all_sets_come_from_one_pass(spark):
    w = spark.createDataFrame([(1, 1, 1, -48.0, 0.0, 3.0, 51.0), (1, 2, 0, -48.0, 0.0, None, None)], "match_id long, question_id long, treated int, t_start double, t_question double, t_answer double, t_end double")
    e = spark.createDataFrame([(1, 1, 3.0, "answer"), (1, 1, 5.0, "edit"), (1, 1, 5.0, "edit"), (1, 1, -3.0, "comment")], "match_id long, question_id long, t_event double, help_type string")
    x = study.phases(study.intervals_of_sets(w, e, {"a": ["answer"], "both": ["answer", "edit"]}))
    assert "lead(" not in plan(x) and plan(x).count("Join ") == 1 and "lead(" not in plan(study.intervals(w, e))
    got = sorted((r.outcome, r.question_id, r.start, r.stop, r.event, r.post_question, r.treated_active) for r in x.collect())
    assert got == [
        ("a", 1, -48.0, 0.0, 0, 0, 0), ("a", 1, 0.0, 3.0, 1, 1, 0), ("a", 1, 3.0, 51.0, 0, 1, 1), ("a", 2, -48.0, 0.0, 0, 0, 0),
        ("both", 1, -48.0, 0.0, 0, 0, 0), ("both", 1, 0.0, 3.0, 1, 1, 0), ("both", 1, 3.0, 5.0, 1, 1, 1), ("both", 1, 5.0, 51.0, 0, 1, 1), ("both", 2, -48.0, 0.0, 0, 0, 0),
    ]


def test_rows_of_many_models_are_held_once(spark, monkeypatch):
    """A control that is in every model travels once, and each model still clips and scales by its own rows."""
    import pickle

    import numpy as np
    import pytest
    from pyspark.sql import functions as F

    from quillspan.operators import fits, hazards

    rng, rows = np.random.default_rng(3), []
    for k in range(600):
        t, late, body = k % 2, float(rng.integers(1, 30)), int(rng.integers(0, 500)) + 300 * (k % 5)
        rows += [(k // 2, -48.0, late, int(rng.random() < 0.3), t, k % 5, body), (k // 2, late, late + 20, int(rng.random() < 0.4), t, k % 5, body)]
    df = spark.createDataFrame(rows, "match_id long, start double, stop double, event int, treated int, part int, first_answer_body_len_chars long")
    covs, held = ["treated", "first_answer_body_len_chars"], []

    class Seen(hazards.Models):
        def close(self):
            held.extend(pickle.loads(r.data) for r in self.blocks.collect())
            super().close()

    monkeypatch.setattr(hazards, "Models", Seen)
    parts = F.array(*[F.lit(str(i)) for i in range(5)])
    member = F.when(F.col("treated") == 0, parts).otherwise(F.array(F.col("part").cast("string")))
    got = fits.fit_models(df, covs, member, max_local=0)
    assert sum(len(block[-1][0]) for block in held) == len(rows)
    for i in range(5):
        one = fits.cox(df.where(f"treated = 0 or part = {i}"), covs)
        assert got[str(i)].coef == pytest.approx(one.coef.tolist(), abs=1e-9) and np.allclose(got[str(i)].cov, one.cov) and got[str(i)].n_rows == one.n_rows


def test_bootstrap_weights_of_all_pairs_do_not_pass_the_driver(spark, monkeypatch):
    from quillspan.operators import fits

    rows = [(k // 2, float(-48 + k % 7), float(k % 5 + 1), k % 3 % 2, k % 2) for k in range(400)]
    df = spark.createDataFrame(rows, "match_id long, start double, stop double, event int, treated int")
    plans, fit = [], fits.fit_patterns
    monkeypatch.setattr(fits, "fit_patterns", lambda each, *rest: plans.append(each._jdf.queryExecution().executedPlan().toString()) or fit(each, *rest))
    got = fits.pair_bootstrap(df, study.multinomial_weights(df, "match_id", 3), ["treated"])
    assert len(plans) == 1 and "BroadcastHashJoin [match_id" not in plans[0] and "SortMergeJoin [match_id" in plans[0]
    assert [r for r, _ in got] == [0, 1, 2] and all(f for _, f in got)


def test_votes_and_bounds_of_windows_do_not_move_with_the_rows(spark):
    at = datetime(2020, 1, 1)
    hour = lambda h: at + timedelta(hours=h)
    q = spark.createDataFrame([(1, 9, at, 12, "<a>", 0, 0, 0, 0), (2, 9, at, None, "<a>", 0, 0, 0, 0)], "question_id long, owner_user_id long, creation_date timestamp_ntz, accepted_answer_id long, tags string, view_count long, body_len_chars long, title_len_chars long, n_code_blocks long")
    a = spark.createDataFrame([(11, 1, 5, 1, hour(1), 0), (12, 1, 6, 1, hour(2), 0), (13, 2, 5, 1, hour(3), 0)], "answer_id long, parent_question_id long, owner_user_id long, score int, creation_date timestamp_ntz, body_len_chars long")
    v = spark.createDataFrame([(11, 1, hour(9)), (11, 1, hour(8)), (12, 1, hour(7)), (12, 2, hour(6)), (13, 2, hour(5))], "post_id long, vote_type_id int, creation_date timestamp_ntz")
    e = events.eligible_questions(q, a, v, spark.createDataFrame([], "user_id long, reputation long"))
    assert "Join LeftOuter, (answer_id" not in plan(e)  # answers are not dealt by their own id with all they hold
    got = {r.question_id: (r.first_answer_id, r.first_answer_votes, r.accepted_ts, r.vote_ts) for r in e.collect()}
    assert got == {1: (11, 2, hour(2), hour(7)), 2: (13, 0, None, None)}
    w = spark.createDataFrame([(1, 1, 5, at, -2.0, 2.0), (1, 2, 6, at, -2.0, 2.0)], "match_id long, question_id long, user_id long, t0 timestamp_ntz, t_start double, t_end double")
    none = spark.createDataFrame([], "post_id long, user_id long, type_id int, creation_date timestamp_ntz")
    h = study.help_events(w, a, none, none, q)
    assert "_lo" not in plan(h) and "_at#" not in plan(h)
    assert sorted((r.question_id, r.t_event) for r in h.collect()) == [(1, 1.0), (2, 2.0)]


def test_matching_looks_through_blocks_of_arrays(spark):
    """Many equal scores, more controls than one block holds, and parts of a block's treated units, against a plain search."""
    import numpy as np

    rng = np.random.default_rng(4)
    rows = [(i, 2020 + i % 2, 1, 2, int(rng.random() < 0.4), float(rng.integers(0, 400)) / 400 if i % 3 else float(rng.random()), sorted(map(int, rng.choice(5, 2, replace=False)))) for i in rng.permutation(2400).tolist()]
    df = spark.createDataFrame([*rows, (9999, None, 1, 2, 1, 0.5, [1, 2]), (9998, None, 1, 2, 0, 0.5, [1, 2])], "question_id long, year int, main_tag long, num_tags int, treated int, score double, tag_ids array<long>")
    pairs = study.match(df, caliper=0.004, k=3, block=50)
    assert "lambda" not in plan(pairs)  # no pair of units is looked at by interpreted functions of arrays
    want = {}
    for i, y, _, _, t, s, tags in rows:
        near = sorted((abs(r[5] - s), r[0], r[6]) for r in rows if t and not r[4] and r[1] == y and abs(r[5] - s) <= 0.004)[:3]
        if near:
            j, d, c = min((-len({*tags} & {*x}) / len({*tags, *x}), d, c) for d, c, x in near)
            want[i] = (c, d, -j)
    assert {r.treated_id: (r.control_id, r.distance, r.jaccard) for r in pairs.collect()} == want


def test_few_rows_move_for_helps_and_intervals(spark):
    """Units without events and windows of users who never act pass no functions of arrays and no join with posts; both units of a pair stay together."""
    at = datetime(2020, 1, 1)
    hour = lambda h: at + timedelta(hours=h)
    q = spark.createDataFrame([(i, o, at, None, "<b><a>", 1, 0, 0, 0) for i, o in ((1, 5), (2, 6), (3, 5), (4, None))], "question_id long, owner_user_id long, creation_date timestamp_ntz, accepted_answer_id long, tags string, view_count long, body_len_chars long, title_len_chars long, n_code_blocks long")
    a = spark.createDataFrame([(11, 1, 5, 1, hour(1), 0), (12, 2, 5, 1, hour(2), 0), (13, 4, 5, 1, hour(2), 0), (14, 9, 5, 1, hour(3), 0), (15, 2, 5, 1, hour(300), 0), (16, 1, None, 1, hour(1), 0)], "answer_id long, parent_question_id long, owner_user_id long, score int, creation_date timestamp_ntz, body_len_chars long")
    c = spark.createDataFrame([(2, 5, hour(4)), (3, 5, hour(4)), (12, 5, hour(4))], "post_id long, user_id long, creation_date timestamp_ntz")
    d = spark.createDataFrame([(16, 5, 5, hour(5)), (12, 5, 5, hour(6)), (2, 5, 4, hour(6)), (2, 5, 9, hour(7))], "post_id long, user_id long, type_id int, creation_date timestamp_ntz")
    kinds = "question_id long, owner_user_id long, creation_date timestamp_ntz, tenure_days int, response_hours double"
    w = study.pair_windows(spark.createDataFrame([(1, 2)], "treated_id long, control_id long"), spark.createDataFrame([(1, 5, at, 3, 2.0), (2, 6, at, 4, None)], kinds))
    assert "Window" not in plan(w) and sorted((r.question_id, r.user_id, r.treated, r.t_answer, r.t_end, r.tenure_days) for r in w.collect()) == [(1, 5, 1, 2.0, 50.0, 3), (2, 6, 0, 2.0, 50.0, 4)]
    h = study.help_events(w, a, c, d, q)
    assert sorted((r.question_id, r.t_event, r.help_type) for r in h.collect()) == [(1, 2.0, "answer"), (1, 2.0, "answer"), (1, 3.0, "answer"), (1, 4.0, "comment"), (1, 6.0, "edit")]
    units = study.with_events(w, h)
    rows = study.interval_rows(units, {"a": ["answer"], "c": ["comment"]})
    joins = [line for line in plan(units).splitlines() if "Join LeftOuter, (match_id" in line]
    assert len(joins) == 1 and "question_id" not in joins[0]
    got = sorted((r.question_id, r.outcomes, r.start, r.stop, r.event) for r in rows.collect())
    assert got == [(1, ["a"], -48.0, 0.0, 0), (1, ["a"], 0.0, 2.0, 1), (1, ["a"], 2.0, 3.0, 1), (1, ["a"], 3.0, 50.0, 0), (1, ["c"], -48.0, 0.0, 0), (1, ["c"], 0.0, 2.0, 0), (1, ["c"], 2.0, 4.0, 1), (1, ["c"], 4.0, 50.0, 0), (2, ["a", "c"], -48.0, 0.0, 0), (2, ["a", "c"], 0.0, 2.0, 0), (2, ["a", "c"], 2.0, 50.0, 0)]
    assert {r.question_id: r.tag_ids for r in events.question_tags(q, events.tag_dictionary(q)).collect()} == {i: [1, 2] for i in (1, 2, 3, 4)}


def test_bootstrap_draws_are_never_rows(spark, monkeypatch):
    """Draws of blocks of pairs within the tasks that hold their rows, against the same draws as a table of weights."""
    import pytest

    from quillspan.operators import fits

    rows = [(k // 2, float(-48 + k % 7), float(k % 5 + 1), k % 3 % 2, k % 2) for k in range(400)]
    df = spark.createDataFrame(rows, "match_id long, start double, stop double, event int, treated int").repartition(3)
    want = dict(fits.pair_bootstrap(df, study.multinomial_weights(df, "match_id", 4, seed=5, block=64, first=2), ["treated"]))
    plans, fit = [], fits.fit_patterns
    monkeypatch.setattr(fits, "fit_patterns", lambda each, *rest: plans.append(plan(each)) or fit(each, *rest))
    monkeypatch.setattr(fits, "HELD", 20)  # patterns are handed on, and still add up
    got = fits.drawn_bootstrap(df, 4, 5, 2, ["treated"], block=64)
    assert len(plans) == 1 and "replicate" not in plans[0] and [r for r, _ in got] == [2, 3, 4, 5]
    for r, f in got:
        assert f.coef == pytest.approx(want[r].coef.tolist(), abs=1e-10) and (f.n_rows, f.n_events) == (want[r].n_rows, want[r].n_events)


def test_intervals_are_linear_in_a_units_events(spark):
    """Functions of arrays that look at the whole array for each element would take minutes here."""
    import time

    n = 30_000
    w = spark.createDataFrame([(1, 1, 1, -48.0, 0.0, 3.0, 51.0)], "match_id long, question_id long, treated int, t_start double, t_question double, t_answer double, t_end double")
    e = spark.range(n).selectExpr("1L as match_id", "1L as question_id", "id % 15000 * 99 / 15000 - 48 as t_event", "'answer' as help_type").withColumn("t_event", F.col("t_event").cast("double"))
    begin = time.time()
    got = study.interval_rows(study.with_events(w, e)).agg(F.count("*"), F.sum("event"), F.sum(F.col("stop") - F.col("start"))).first()
    assert time.time() - begin < 60
    times = {*[i * 99 / 15000 - 48 for i in range(15000)]}
    assert (got[0], got[1]) == (len(times | {-48.0, 0.0, 3.0, 51.0}) - 1, len(times - {-48.0})) and abs(got[2] - 99) < 1e-6
