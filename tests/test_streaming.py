"""Streams over several micro-batches, with null keys, ties, gaps of exactly 30 minutes and no rows."""

from datetime import datetime, timedelta

from lodestone.streaming import events

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"
START = datetime(2024, 1, 1, 12)


def land(spark, folder, *files):
    for rows in files:
        made = [(i, START + timedelta(minutes=m) if m is not None else None, u, "view", float(i)) for i, m, u in rows]
        spark.createDataFrame(made, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
    return str(folder)


def test_latest(spark, tmp_path):
    path = land(spark, tmp_path, [(1, 0, 7), (2, 5, 7), (3, 1, None)], [(5, 5, 7), (4, 3, 7)], [(6, 2, None)])
    got = {r.user_id: (r.event_id, r.seen) for r in events.latest(spark, path, maxFilesPerTrigger="1").collect()}
    assert got == {7: (5, 4), None: (6, 2)}


def test_sessions_merge_across_batches(spark, tmp_path):
    path = land(spark, tmp_path, [(1, 0, 7), (2, 50, 7)], [(3, 25, 7), (4, 81, 7)], [(5, 111, 7)])
    got = sorted((r.first_ts, r.n) for r in events.sessions(spark, path, maxFilesPerTrigger="1").collect())
    assert got == [(START, 3), (START + timedelta(minutes=81), 2)]


def test_tumbling(spark, tmp_path):
    path = land(spark, tmp_path, [(1, 0, 7), (2, 24 * 60, 7)], [(3, 10, 8)])
    got = sorted((r.day, r.n, r.least, r.most) for r in events.tumbling(spark, path, maxFilesPerTrigger="1").collect())
    assert got == [("2024-01-01", 2, 1.0, 3.0), ("2024-01-02", 1, 2.0, 2.0)]


def test_no_rows(spark, tmp_path):
    path = land(spark, tmp_path, [])
    for run in (events.latest, events.sessions, events.tumbling):
        assert run(spark, path).count() == 0
