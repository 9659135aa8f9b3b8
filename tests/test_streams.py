"""Streams: keyed state of the registry, its timers, time to live and restarts."""

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from lodestrata.operators.ledger import fold_history
from lodestrata.streaming import keyed

SIGHTING = "fingerprint string, ts timestamp"


def at(day, hour=0):
    return dt.datetime(2024, 1, 1, hour) + dt.timedelta(days=day)


@pytest.fixture
def log(spark, tmp_path):
    """A folder of sightings that is added to, and the stream over it."""

    class Log:
        n, changes, folder = 0, f"{tmp_path}/changes", f"{tmp_path}/log"

        def add(self, *rows):
            self.n += 1
            spark.createDataFrame(list(rows), SIGHTING).coalesce(1).write.parquet(f"{tmp_path}/log/n={self.n}")

        def run(self, **how):
            stream = spark.readStream.schema(SIGHTING + ", n int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log")
            query = keyed.append_changes(keyed.registry_changes(stream, **how), self.changes, f"{tmp_path}/checkpoint")
            query.awaitTermination()

        def rows(self):
            return spark.read.schema(keyed.CHANGE).parquet(self.changes)

        def counts(self):
            return [(r.fingerprint, r.hit_count) for r in self.rows().collect()] if os.path.exists(f"{self.changes}/_spark_metadata") else []

        def state(self):
            return {r.fingerprint: (r.hit_count, r.distinct_days, r.decayed) for r in keyed.registry_state(self.rows()).collect()}

    return Log()


def test_keyed_state_equals_the_fold(spark, log):
    first = [("a", at(0)), ("a", at(0, 5)), ("b", at(1)), ("c", at(3)), ("a", at(3))]
    second = [("a", at(3, 2)), ("a", at(4)), ("b", at(16)), (None, at(5)), ("z", None)]
    log.add(*first)
    log.run()
    assert log.state() == {"a": (3, 2, False), "b": (1, 1, False), "c": (1, 1, False)}
    log.add(*second)
    log.run()
    whole = spark.createDataFrame([r for r in first + second if r[0] and r[1]], "key string, ts timestamp")
    want = {r.key: (r.hit_count, r.distinct_days, r.first_seen, r.last_seen) for r in fold_history(whole).collect()}
    assert {r.fingerprint: (r.hit_count, r.distinct_days, r.first_seen, r.last_seen) for r in keyed.registry_state(log.rows()).collect()} == want


def test_a_restart_changes_nothing(spark, log):
    log.add(("a", at(0)), ("b", at(20)))
    log.run()
    before = sorted(map(str, log.rows().collect()))
    log.run()
    assert sorted(map(str, log.rows().collect())) == before and log.state() == {"a": (1, 1, True), "b": (1, 1, False)}


def test_what_decays_comes_back_and_what_is_forgotten_begins_anew(spark, log):
    log.add(("a", at(0)), ("b", at(0)), ("edge", at(6)))
    log.run(keep_days=30)
    log.add(("a", at(20)))
    log.run(keep_days=30)
    assert log.state() == {"a": (2, 2, False), "b": (1, 1, True), "edge": (1, 1, False)}  # exactly 14 days are not more than 14
    log.add(("a", at(31)))
    log.run(keep_days=30)
    assert log.state() == {"a": (3, 3, False), "edge": (1, 1, True)}
    log.add(("b", at(31, 1)), ("b", at(2)))
    log.run(keep_days=30)
    assert log.state()["b"] == (2, 2, False)
    assert log.rows().where("fingerprint = 'b'").orderBy("at_ms", "hit_count").select("change").toPandas()["change"].tolist() == ["seen", "decayed", "forgotten", "seen"]


@pytest.mark.parametrize("buckets", [1, 3])
def test_fingerprints_that_share_a_state_have_their_own_times(spark, log, monkeypatch, buckets):
    monkeypatch.setattr(keyed, "BUCKETS", buckets)
    names = [f"k{n}" for n in range(12)]
    log.add(*[(x, at(n)) for n, x in enumerate(names)])
    log.run(keep_days=30)
    assert log.state() == {x: (1, 1, False) for x in names}
    log.add((names[0], at(20)), ("new", at(20)))
    log.run(keep_days=30)
    assert log.state() == {x: (1 + (n == 0), 1 + (n == 0), 0 < n < 6) for n, x in enumerate(names)} | {"new": (1, 1, False)}
    log.add(("new", at(36)))
    log.run(keep_days=30)
    assert log.state() == {x: (1, 1, True) for n, x in enumerate(names) if n > 5} | {names[0]: (2, 2, True), "new": (2, 2, False)}
    assert all(r.n == 1 for r in log.rows().where("change <> 'seen'").groupBy("fingerprint", "change", "last_seen").agg(F.count("*").alias("n")).collect())


def test_state_has_a_time_to_live_by_the_clock(spark, log):
    log.add(("a", at(0)))
    stream = spark.readStream.schema(SIGHTING + ", n int").option("maxFilesPerTrigger", 1).parquet(log.folder)
    query = keyed.append_changes(keyed.registry_changes(stream, wall=True, decay_days=1, keep_days=3 / 86_400), log.changes, f"{log.folder}-checkpoint", every="500 milliseconds")
    try:
        wait_for(lambda: ("a", 1) in log.counts())
        time.sleep(5)
        log.add(("a", at(1)), ("b", at(1)))
        wait_for(lambda: ("b", 1) in log.counts())
        log.add(("b", at(1)))
        wait_for(lambda: ("b", 2) in log.counts())
    finally:
        query.stop()
    assert ("a", 2) not in log.counts()


def wait_for(what, seconds=40):
    until = time.time() + seconds
    while not what():
        assert time.time() < until
        time.sleep(0.3)
