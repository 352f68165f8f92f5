"""Published versions, moved tables, inputs and the clean-up at the end of a session."""

import subprocess
import sys
import threading
from pathlib import Path

import pytest

from quillspan.sources import files


def test_readers_never_miss_a_published_table(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        files.published(spark, path)
    assert files.publish(spark.range(10).selectExpr("id", "0 as v"), path) == 1
    seen, wrong, done = [], [], threading.Event()

    def read():
        while not done.is_set():
            try:
                r = files.published(spark, path).selectExpr("count(*) n", "min(v) a", "max(v) b").first()
                seen.append(r.a)
                if r.n != 10 or r.a != r.b:
                    wrong.append(r)
            except Exception as e:  # any failure counts
                wrong.append(e)

    reader = threading.Thread(target=read)
    reader.start()
    for v in range(1, 11):
        assert files.publish(spark.range(10).selectExpr("id", f"{v} as v"), path) == v + 1
    done.set()
    reader.join()
    assert not wrong and seen == sorted(seen) and len(seen) > 2
    assert files.publish(spark.range(3), path, keep_seconds=-1) == 12
    assert [p.name for p in (tmp_path / "t").iterdir() if not p.name.startswith(".")] == ["version=12"]


def test_a_crash_leaves_the_last_version(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    files.publish(spark.range(5), path)
    monkeypatch.setattr(files, "_versions", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped here")))
    with pytest.raises(RuntimeError):
        files.publish(spark.range(7), path)  # staged, not published
    monkeypatch.undo()
    assert files.published(spark, path).count() == 5 and files.publish(spark.range(8), path) == 2 and files.published(spark, path).count() == 8


def test_two_writers_take_two_numbers(spark, tmp_path):
    path, got = f"file://{tmp_path}/t", []
    writers = [threading.Thread(target=lambda k=k: got.append(files.publish(spark.range(k), path))) for k in (3, 4, 5)]
    [w.start() for w in writers]
    [w.join() for w in writers]
    assert sorted(got) == [1, 2, 3]


def test_an_old_table_is_put_back_if_the_new_one_cannot_take_its_place(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    files.write_atomic(spark.range(5), path)
    files.write_atomic(spark.range(6), path)
    assert spark.read.parquet(path).count() == 6 and [p.name for p in tmp_path.iterdir()] == ["t"]


def test_inputs(spark, tmp_path):
    folder = f"file://{tmp_path}"
    for name in ("Users", "Badges_revision", "Badges"):
        spark.range(1).write.parquet(f"{folder}/{name}.parquet")
    assert files.resolve_input(spark, folder, "users").endswith("/Users.parquet") and files.resolve_input(spark, folder, "badges").endswith("/Badges_revision.parquet")
    assert files.input_exists(spark, folder, "badges") and not files.input_exists(spark, folder, "votes") and not files.input_exists(spark, folder, "no such")
    with pytest.raises(KeyError):
        files.resolve_input(spark, folder, "no such")
    with pytest.raises(FileNotFoundError):
        files.resolve_input(spark, folder, "votes")


@pytest.mark.parametrize("end", ["spark.stop()", "", "spark.stop(); spark2 = SparkSession.builder.getOrCreate(); stored(spark2.range(2), work_folder(spark2), 'b'); spark2.stop()"])
def test_nothing_is_left_behind(tmp_path, end):
    script = f"""
from pyspark.sql import SparkSession
from quillspan.sources.files import stored, work_folder
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
stored(spark.range(3), work_folder(spark), "a")
{end}
"""
    subprocess.run([sys.executable, "-c", script], check=True, capture_output=True, cwd=Path(__file__).parent.parent, timeout=180)
    left = [p.name for p in (tmp_path / "shared").iterdir()] if (tmp_path / "shared").exists() else []
    assert not [n for n in left if n.startswith("quillspan")]
