"""Sessions over a stream equal those over the table; late, repeated and timeless events."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quillspan.streaming import sessions as S

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, value double, heartbeat boolean"
T0 = datetime(2024, 1, 1)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def as_rows(df):
    return sorted((r.user_id is not None, r.user_id or 0, r.started, r.ended, r.n, r.total) for r in df.collect())


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, at(i * 17 % 3000), i % 5 if i % 11 else None, float(i), False) for i in range(400)] + [(7, at(7 * 17), 2, 7.0, False), (999, None, 1, 1.0, False)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = as_rows(S.sessions(df))
    assert sum(r[4] for r in want) == 400 and len(want) > 20
    assert as_rows(S.streamed(df.drop("heartbeat"), f"file://{tmp_path}/s")) == want
    assert S.streamed(df.limit(0).drop("heartbeat"), f"file://{tmp_path}/e").count() == 0


def test_late_and_repeated_events(spark, tmp_path):
    landing, out, state = (f"file://{tmp_path}/{n}" for n in ("in", "out", "state"))
    schema = spark.createDataFrame([], SCHEMA).schema

    def arrive(*rows):
        spark.createDataFrame([(i, at(m), u, 1.0, False) for i, m, u in rows], SCHEMA).coalesce(1).write.mode("append").parquet(landing)
        S.start(spark, landing, schema, out, state).awaitTermination()

    arrive((1, 0, 1), (2, 10, 1), (3, 500, 2))
    arrive((4, 480, 2), (3, 500, 2), (5, 5, 1))  # in time, repeated, too late
    S.close(spark, landing, schema)
    S.start(spark, landing, schema, out, state).awaitTermination()
    got = [(r.user_id, r.started, r.ended, r.n) for r in spark.read.parquet(out).orderBy("started").collect()]
    assert got == [(1, at(0), at(10), 2), (2, at(480), at(500), 2)]
    S.start(spark, landing, schema, out, state).awaitTermination()
    assert spark.read.parquet(out).agg(F.sum("n")).first()[0] == 4  # nothing twice
