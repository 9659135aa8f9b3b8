"""Sessions pulled as a stream, late ones too, and the latest reading of each."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import latest
from lodestrata.sources import files, session_stream, store

COLUMNS = "id, cwd, repository, branch, summary, created_at, updated_at"


@pytest.fixture
def sessions(tmp_path):
    path = str(tmp_path / "store.db")
    with sqlite3.connect(path) as db:
        db.execute(f"CREATE TABLE sessions ({COLUMNS})")
        db.execute("CREATE TABLE turns (session_id, turn_index, user_message, assistant_response, timestamp)")

    class Sessions:
        db = path

        def put(self, *rows):
            with sqlite3.connect(path) as db:
                for id_, summary, updated in rows:
                    db.execute("DELETE FROM sessions WHERE id = ?", [id_])
                    db.execute("INSERT INTO sessions VALUES (?, '/w', 'r', 'b', ?, '2024-01-01T00:00:00Z', ?)", [id_, summary, updated])

    return Sessions()


def hour(h, minute=0):
    return f"2024-01-02T{h:02}:{minute:02}:00Z"


def pull(spark, sessions, tmp_path, **how):
    stream = session_stream.read_session_stream(spark, sessions.db, **how)
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(60)
    return sorted((r.id, r.summary, r.updated_at) for r in spark.read.schema(files.SESSION).parquet(str(tmp_path / "out")).collect())


def test_two_triggers_give_the_rows_of_one_window_each_once(spark, sessions, tmp_path):
    sessions.put(("old", "x", hour(1)), ("a", "one", hour(5)), ("b", "one", hour(6)))
    assert pull(spark, sessions, tmp_path, since=hour(4), partitions=2) == [("a", "one", hour(5)), ("b", "one", hour(6))]
    sessions.put(("late", "one", hour(5, 30)), ("a", "two", hour(7)), ("too late", "one", hour(4, 30)), ("bad", "one", "z no time"))
    want = [("a", "one", hour(5)), ("a", "two", hour(7)), ("b", "one", hour(6)), ("late", "one", hour(5, 30))]
    assert pull(spark, sessions, tmp_path, since=hour(4), partitions=2) == want
    assert pull(spark, sessions, tmp_path, since=hour(4), partitions=2) == want


def test_a_batch_that_failed_is_read_again(sessions):
    sessions.put(("a", "one", hour(5)), ("b", "one", hour(6)))
    reader = session_stream._SessionStreamReader({"path": sessions.db, "since": hour(4), "partitions": "3"}, ["id", "updated_at"])
    start, end = reader.initialOffset(), reader.latestOffset()
    read = lambda start, end: sorted(r for p in reader.partitions(start, end) for r in reader.read(p))
    assert end == {"updated_at": hour(6)} and read(start, end) == [("a", hour(5)), ("b", hour(6))] == read(start, end)
    sessions.put(("c", "one", hour(8)))
    assert read(start, end) == [("a", hour(5)), ("b", hour(6))]
    assert read(end, reader.latestOffset()) == [("b", hour(6)), ("c", hour(8))]
    none = session_stream._SessionStreamReader({"path": sessions.db + "x", "since": hour(4)}, ["id"])
    assert none.latestOffset() == none.initialOffset() and none.partitions(start, end) == []
    assert session_stream.earlier(hour(0, 30), 1) == "2024-01-01T23:30:00Z" and session_stream.earlier("x", 1) == "x"


def test_streamed_readings_replace_older_ones(spark, sessions, tmp_path):
    table = store.BucketedTable(spark, str(tmp_path / "latest"), files.SESSION, "id", 4)
    def go():
        stream = session_stream.read_session_stream(spark, sessions.db)
        keep = latest.keep_latest(table, "id", ["updated_at"], "s")
        stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(60)
        return {r.id: r.summary for r in table.read().collect()}
    sessions.put(("a", "one", hour(5)), ("b", "one", hour(6)))
    assert go() == {"a": "one", "b": "one"}
    sessions.put(("a", "two", hour(7)), ("c", "late", hour(5, 20)))
    assert go() == {"a": "two", "b": "one", "c": "late"}
    assert go() == {"a": "two", "b": "one", "c": "late"}


def test_older_readings_change_nothing_and_parts_go_with_the_whole(spark):
    make = lambda rows: spark.createDataFrame(rows, "k string, v int, w int, x string")
    prior = make([("a", 2, 0, "stored"), ("b", 1, None, "stored"), ("c", 1, 1, "stored")])
    readings = make([("a", 1, 9, "late"), ("b", 1, 0, "higher"), ("b", 1, None, "equal"), ("c", 1, 1, "same"), ("d", None, None, "new")])
    assert {r.k: r.x for r in latest.replace_older(prior, readings, "k", ["v", "w"]).collect()} == {"a": "stored", "b": "higher", "c": "same", "d": "new"}
    whole = latest.replace_whole(prior, spark.createDataFrame([("a",), ("b",)], "k string"), make([("a", 1, 1, "p"), ("a", 2, 1, "q"), ("c", 5, 5, "not read")]), "k")
    assert sorted((r.k, r.x) for r in whole.collect()) == [("a", "p"), ("a", "q"), ("c", "stored")]


def test_turns_of_changed_sessions_only_by_ranges_of_rows(spark, sessions):
    sessions.put(*[(f"s{i}", "x", hour(i)) for i in range(10)])
    with sqlite3.connect(sessions.db) as db:
        db.executemany("INSERT INTO turns VALUES (?, ?, 'u', 'a', 't')", [(f"s{i % 10}", i) for i in range(40)])
    found, turns = files.read_sessions(spark, sessions.db, hour(6), partitions=3)
    assert found.rdd.getNumPartitions() == 3 and sorted(r.id for r in found.collect()) == ["s7", "s8", "s9"]
    assert turns.groupBy("session_id").count().orderBy("session_id").select("session_id", "count").collect() == [("s7", 4), ("s8", 4), ("s9", 4)]
    assert files.read_sessions(spark, sessions.db, partitions=7)[1].agg(F.count("*")).first()[0] == 40
