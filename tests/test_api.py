"""The entry points one after the other on the small fixture, and the command line."""

import pytest

from quillspan import __main__ as cli
from quillspan import api
from quillspan.sources import files
from quillspan.sources.testdata import qa_tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    base = f"file://{tmp_path_factory.mktemp('study')}"
    t = qa_tables(spark, SF)
    for n in ("questions", "answers", "votes", "users", "comments", "edits"):
        t[n].write.parquet(f"{base}/source/{n}.parquet")
    raw = api.raw_dataset(spark, f"{base}/source", f"{base}/raw")
    processed = api.process_dataset(spark, f"{base}/raw", f"{base}/out", cutoff_date=None)
    matched = api.match_questions(spark, processed, f"{base}/out", min_stratum=30, min_tag_count=20)
    return base, raw, processed, matched


def test_stages(spark, built):
    base, raw, processed, matched = built
    read = spark.read.parquet
    n = read(raw["eligible"]).count()
    assert read(processed).count() == n and read(raw["events"]).where("event = 'Phase_One_Start'").count() == n
    pairs = read(matched["pairs"]).count()
    assert pairs > 0 and read(matched["matched"]).count() == 2 * pairs and read(matched["matched"]).where("treated = 0 and control_reuse_count is null").count() == 0
    helps = read(api.helping_metrics(spark, matched["matched"], f"{base}/source", f"{base}/out"))
    assert helps.count() == 2 * pairs
    study = api.event_histories(spark, matched["matched"], f"{base}/source", f"{base}/study", include_accepts=True)
    assert read(study["timelines"]).count() == 2 * pairs
    rows = api.model_rows(spark, f"{base}/study", f"{base}/out")
    assert read(rows).count() >= 2 * 2 * pairs
    assert read(api.model_rows(spark, f"{base}/study", f"{base}/few", sample=3)).select("match_id").distinct().count() == 3
    for path in [*api.cox_models(spark, rows, f"{base}/out").values(), *api.robustness(spark, rows, f"{base}/out", only="observable").values(), api.cohorts(spark, rows, f"{base}/out", 1995)]:
        assert files.exists(spark, path)
    for _ in range(2):  # replicates that are run again replace themselves
        boot = api.bootstrap(spark, rows, f"{base}/out", replicates=2)
    assert read(boot).groupBy("scope", "replicate").count().where("count > 1").count() == 0
    assert api.merge_bootstrap(spark, boot).columns == ["scope", "term", "n", "sd", "lo", "hi"]
    more = [api.selection(spark, f"{base}/study", rows, f"{base}/out"), api.preperiod_placebo(spark, f"{base}/study", f"{base}/out")]
    more += [api.robustness(spark, rows, f"{base}/out", only=k, study=f"{base}/study")[k] for k in ("composite", "placebo")]
    head = [spark.read.csv(p, header=True).columns for p in more]
    assert head[0][:2] == ["scope", "fraction"] and all(h[:3] == ["sample", "spec", "term"] and h[-1] == "reason" for h in head[1:])
    some = api.bootstrap(spark, rows, f"{base}/some", replicates=1, first=3, max_pairs=5)
    assert {r.replicate for r in read(some).collect()} <= {3}
    assert set(api.help_rates(spark, f"{base}/study", f"{base}/out")) == {"binned", "adoption", "stable"}


def test_one_question_a_user(spark, built, tmp_path):
    base = built[0]
    out = api.raw_dataset(spark, f"{base}/source", f"file://{tmp_path}/one", include_all_questions=False, test_user_limit=20)
    e = spark.read.parquet(out["eligible"])
    assert e.count() == 20 == e.select("owner_user_id").distinct().count()


def test_command_line(spark, built, tmp_path):
    base = built[0]
    out = cli.main(["raw-dataset", "--source", f"{base}/source", "--output", f"file://{tmp_path}/cli", "--window-length", "3", "--no-include-all-questions"], spark)
    assert files.exists(spark, out["events"]) and out["events"].endswith("events_3d.parquet")
    xml = tmp_path / "Votes.xml"
    xml.write_text("<votes>\n<row Id='1' PostId='1' VoteTypeId='2' />\n</votes>")
    out = cli.main(["convert-dump", "--xml", '{"votes": "%s"}' % xml, "--output", f"file://{tmp_path}/tables"], spark)
    assert spark.read.parquet(out["votes"]).count() == 1


def test_files(spark, tmp_path):
    base = f"file://{tmp_path}"
    df = spark.createDataFrame([("a & b_c", 1.5, None), ("x%", None, "t")], "name string, v double, s string")
    df.write.parquet(f"{base}/in/posts_questions.parquet")
    assert files.resolve_input(spark, f"{base}/in", "posts_questions").endswith("posts_questions.parquet")
    df.write.parquet(f"{base}/in/posts_questions_revision.parquet")
    assert files.resolve_input(spark, f"{base}/in", "posts_questions").endswith("posts_questions_revision.parquet")
    assert not files.input_exists(spark, f"{base}/in", "posts_answers") and not files.input_exists(spark, f"{base}/in", "nothing")
    with pytest.raises(KeyError):
        files.resolve_input(spark, base, "nothing")
    files.write_text(spark, f"{base}/t.tex", files.latex_table(df, {"v": ".2f"}))
    assert sorted(map(tuple, files.read_latex_rows(spark, f"{base}/t.tex", ["name", "v", "s"]).collect())) == [("a & b_c", "1.50", ""), ("name", "v", "s"), ("x%", "", "t")]
    cell = spark.createDataFrame([("1.049*** [1.044, 1.054]",), ("-0.5",)], "c string")
    from pyspark.sql import functions as F

    got = [tuple(r) for r in cell.select(*[v.alias(k) for k, v in files.estimates(F.col("c")).items()]).collect()]
    assert got[0] == (1.049, 3, 1.044, 1.054) and got[1][1:] == (0, None, None)
    files.write_atomic(df, f"{base}/w.parquet")
    files.write_atomic(df.limit(1), f"{base}/w.parquet")
    assert spark.read.parquet(f"{base}/w.parquet").count() == 1
    files.cached(spark, f"{base}/c.parquet", lambda: df, {"v": 1})
    assert files.cached(spark, f"{base}/c.parquet", lambda: df.limit(0), {"v": 1}).count() == 2
    assert files.cached(spark, f"{base}/c.parquet", lambda: df.limit(0), {"v": 2}).count() == 0
