"""The XML dump reader, the text metrics and the sinks on hand-made files."""

import pytest

from quillspan.functions import text
from quillspan.sources import dump

#: Bodies with the metrics that they must have, counted by eye.
BODIES = {
    "<p>See <code>x</code> now!</p><pre><code>a &lt; b</code></pre>": {"body_len_chars": 10 + 5, "body_len_words": 3, "n_code_blocks": 1, "n_inline_code": 1, "n_paragraphs": 1, "n_links": 0, "code_len_chars": 5, "n_sentences": 1, "n_long_words": 0, "avg_word_len_chars": 2.67},
    "<ul><li>one</li></ul><ol><li>thoroughly longwords</li></ol><blockquote>q &amp; z</blockquote><img src='i'><a href='u'>d</a>": {"body_len_words": 7, "n_lists": 2, "n_blockquotes": 1, "n_images": 1, "n_links": 1, "n_long_words": 2, "n_code_blocks": 0, "code_len_chars": 0, "n_paragraphs": 0},
    "plain words only": {"body_len_chars": 16, "body_len_words": 3, "n_sentences": 0, "avg_word_len_chars": 4.67},
    "<p></p>": {"body_len_chars": 0, "body_len_words": 0, "n_paragraphs": 1, "avg_word_len_chars": 0.0},
    "   ": {"body_len_chars": 0, "body_len_words": 0},
    "<pre>one</pre> and <pre class='k'>&amp;&amp;</pre>": {"n_code_blocks": 2, "code_len_chars": 5, "body_len_chars": 8, "body_len_words": 1},
    "<pre>unclosed": {"n_code_blocks": 0, "body_len_chars": 8},
}


def test_body_metrics(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, b) for i, b in enumerate([*BODIES, "", None])], "i long, b string")
    got = [r.asDict() for r in df.select("i", *(v.alias(k) for k, v in text.body_metrics(F.col("b")).items())).orderBy("i").collect()]
    for r, want in zip(got, BODIES.values(), strict=False):
        assert {k: r[k] for k in want} == pytest.approx(want)
    assert all(v is None for r in got[len(BODIES):] for k, v in r.items() if k != "i")


def test_title_metrics(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(" How to  go ",), ("It works?",), ("No",), ("  ",), ("",), (None,)], "t string")
    got = [tuple(r) for r in df.select(*(v.alias(k) for k, v in text.title_metrics(F.col("t")).items())).collect()]
    assert got == [(10, 3, 1), (9, 2, 1), (2, 1, 0), (0, 0, 0), (None, None, None), (None, None, None)]


def test_xml_and_sinks(spark, tmp_path):
    rows = [
        """<row Id="1" PostTypeId="1" CreationDate="2020-01-02T03:04:05.678" OwnerUserId="7" Score="3" Tags="&lt;a&gt;" ViewCount="9" Body="&lt;p&gt;Hi you&lt;/p&gt;" Title="Why?" />""",
        """<row Id="2" PostTypeId="2" ParentId="1" CreationDate="2021-01-02T03:04:05.678" Score="bad" Body="yes" />""",
        """<row Id="3" PostTypeId="4" CreationDate="2020-01-02T03:04:05.678" />""",
    ]
    (tmp_path / "Posts.xml").write_text("<?xml version='1.0' encoding='utf-8'?>\n<posts>\n" + "\n".join(rows) + "\n</posts>\n")
    posts = dump.read_xml(spark, str(tmp_path / "Posts.xml"), "posts").cache()
    got = {r.Id: r for r in posts.collect()}
    assert set(got) == {1, 2} and got[1].body_len_words == 2 and got[1].Tags == "<a>" and got[1].title_is_question == 1
    assert got[2].Score is None and got[2].ParentId == 1 and got[2].title_len_chars is None and got[1].CreationDate.year == 2020
    (tmp_path / "Votes.xml").write_text("<votes>\n<row Id='1' PostId='1' VoteTypeId='2' />\n<row Id='2' PostId='1' VoteTypeId='5' />\n</votes>")
    assert [r.Id for r in dump.read_xml(spark, str(tmp_path / "Votes.xml"), "votes").collect()] == [1]
    paths = dump.split_by_column(posts, str(tmp_path / "out"), "PostTypeId", [1, 2], ["q.parquet"], ["Id"])
    assert [[r.Id for r in spark.read.parquet(p).collect()] for p in paths] == [[1], [2]] and paths[1].endswith("PostTypeId_2.parquet")
    dump.write_by_hash(posts, str(tmp_path / "h"), "Id", 3, salt=2)
    assert spark.read.parquet(str(tmp_path / "h")).count() == 2
    assert sorted(map(tuple, dump.write_by_year(posts, str(tmp_path / "y"), "CreationDate").collect())) == [(2020, 1), (2021, 1)]
    raw = spark.createDataFrame([("5", "2020-01-01 00:00:00", "x"), ("no", None, "y")], "OwnerId string, creation_date string, note string")
    assert dict(dump.typed(raw).dtypes) == {"OwnerId": "bigint", "creation_date": "timestamp_ntz", "note": "string"}


def test_damaged_dump(spark, tmp_path):
    lines = ["﻿<?xml version='1.0'?>", "<votes>", """ <row Id="1" PostId="5" VoteTypeId="2" />""", """<row Id="2" PostId="5" Vote""", """<row Id="3" PostId="x" VoteTypeId="1"></row>""", """<row PostId="5" VoteTypeId="1" />""", "noise", """<row Id="9" PostId="1" VoteTypeId="7" />""", """<row Id="4" PostId="6 & 7" VoteTypeId="1" />""", """<rowling Id="8" />""", "", "</votes>"]
    (tmp_path / "a.xml").write_text("\n".join(lines))
    (tmp_path / "b.xml").write_text("")
    good, broken = dump.read_xml_kept(spark, f"file://{tmp_path}", "votes")
    assert sorted((r.Id, r.PostId) for r in good.collect()) == [(1, 5), (3, None)]
    got = sorted((r.line, r.reason, r["columns"], r.text) for r in broken.collect())
    assert [(r[0], r[1], r[2]) for r in got] == [(3, "not XML", None), (4, "value", "PostId"), (5, "no Id", None), (6, "not a row", None), (8, "not XML", None), (9, "not a row", None)]
    assert got[3][3] == "noise" and all(r.file.endswith("a.xml") and r.block == 0 for r in broken.collect())
    assert dump.read_xml_kept(spark, f"file://{tmp_path}/b.xml", "posts")[0].count() == 0
