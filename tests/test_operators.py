"""Rules and edges that the tables don't show."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import columns as C
from lodestrata.operators import harvest, health, ledger, merge, replay, routing, sharding
from lodestrata.plans import nightly
from lodestrata.sources import config as cfg
from lodestrata.sources import files, proposals, store
from lodestrata.streaming import registry

CLAIM = "ord long, claim string, domain string, horizon string, importance int, confidence string, target string, status string, source string, evidence string, notes string, fingerprint string"


def claims(spark, *rows):
    names = [c.split()[0] for c in CLAIM.split(", ")]
    base = {"claim": "a claim", "horizon": "long", "importance": 5, "confidence": "high", "target": "skill-a", "fingerprint": "f"}
    return spark.createDataFrame([tuple((base | {"ord": k} | r).get(n) for n in names) for k, r in enumerate(rows)], CLAIM)


@pytest.mark.parametrize(
    "given, same",
    [("A - b", False), ("  a  -  B\t", True), ("a  - b", True), ("a\x1c- b", True), ("a-b", False)],
)
def test_fingerprint_collapses_space_before_punctuation_goes(spark, given, same):
    df = spark.createDataFrame([(given, "a - b")], "x string, y string").select(C.fingerprint(F.col("x")) == C.fingerprint(F.col("y")))
    assert df.first()[0] is (same or given == "A - b")


def test_claims_of_other_letters_share_a_fingerprint(spark):
    df = spark.createDataFrame([("!!!",), ("日本語",), ("",)], "x string").select(C.fingerprint(F.col("x")).alias("f"))
    assert {r.f for r in df.collect()} == {"da39a3ee5e6b4b0d"}


def test_lone_claim_passes_unchanged(spark):
    row = merge.merge_claims(claims(spark, {"horizon": "short", "confidence": None, "evidence": "x" * 500, "importance": None})).first()
    assert (row.horizon, row.confidence, row.target, row.importance, len(row.evidence)) == ("short", None, "skill-a", None, 500)


def test_merge_takes_the_first_most_important_and_joins_evidence(spark):
    rows = [{"claim": "low", "importance": 1, "evidence": " b "}, {"claim": "first", "importance": 7, "evidence": "a", "source": "git"}, {"claim": "second", "importance": 7, "evidence": "b", "source": "inbox"}]
    row = merge.merge_claims(claims(spark, *rows)).first()
    assert (row.claim, row.evidence, row.source, row.importance, row.n_raw) == ("first", "a; b", "mixed", 7, 3)


def test_merge_marks_unknown_horizons_only_in_disagreement(spark):
    odd = claims(spark, {"horizon": "odd"}, {"horizon": "long"}, {"horizon": "odd", "fingerprint": "g"}, {"horizon": "odd", "fingerprint": "g"})
    assert {r.fingerprint: r.unresolvable for r in merge.merge_claims(odd).collect()} == {"f": True, "g": False}


def test_blank_claims_are_left_out_and_given_fingerprints_stay(spark):
    df = merge.with_fingerprints(claims(spark, {"claim": " \t"}, {"claim": None}, {"claim": "x", "fingerprint": ""}, {"claim": "x", "fingerprint": "own"}))
    assert sorted(r.fingerprint for r in df.collect()) == ["11f6ad8ec52a2984", "own"]


def test_merge_of_nothing(spark):
    assert merge.merge_claims(claims(spark).limit(0)).count() == 0


@pytest.mark.parametrize(
    "row, bucket, new",
    [
        ({"fingerprint": "bad"}, "drop", False), ({"horizon": None}, "drop", False), ({"horizon": ""}, "drop", False), ({"horizon": "short"}, "active_add", False),
        ({"target": "dream-active-work"}, "active_add", False), ({"target": "review-queue", "importance": 9}, "review_queue", False), ({}, "by_skill", False), ({"confidence": "low"}, "review_queue", False),
        ({"confidence": "odd", "importance": 9}, "review_queue", False), ({"target": "new", "importance": 7}, "review_queue", True), ({"target": "new", "importance": 6}, "review_queue", False),
        ({"target": None, "importance": 9, "horizon": "odd"}, "review_queue", True),
    ],
)
def test_routing_rules(spark, row, bucket, new):
    rejected = spark.createDataFrame([("bad",), (None,), ("",)], "fingerprint string")
    got = routing.route(claims(spark, row), rejected, ["skill-a"]).first()
    assert (got.bucket, got.new_skill, got.skill) == (bucket, new, "skill-a" if bucket == "by_skill" else None)


def test_rejected_claims_are_in_no_other_bucket(spark):
    df = claims(spark, *[{"fingerprint": f"f{k}", "horizon": h} for k, h in enumerate(["long", "short", "drop", "long"])])
    rejected = spark.createDataFrame([("f0",), ("f1",), ("f1",)], "fingerprint string")
    routed = routing.route(df, rejected, ["skill-a"])
    assert routed.count() == 4 and routed.where("rejected_denied AND bucket <> 'drop'").isEmpty()


def test_without_skills_the_seed_is_known(spark):
    assert routing.long_term_skills([], "general") == ["general"] and routing.long_term_skills([], "general", False) == []
    names = {r.name: r.path for r in routing.target_paths(spark, {}, "work.md", "index.md", "general").collect()}
    assert names == {"general": "skills/general/SKILL.md", "dream-active-work": "work.md", "dream": "index.md"}


def test_upsert_twice_on_a_day_adds_hits_but_no_day(spark, tmp_path):
    table = store.items_table(spark, str(tmp_path))
    batch = claims(spark, {"status": None}, {"status": "applied", "claim": "later"}, {"fingerprint": "g"})
    for now in ("2024-01-01T04:00:00Z", "2024-01-01T05:00:00Z", "2024-01-03T04:00:00Z"):
        table.write(ledger.upsert(table.read(), batch, F.lit(now), F.lit(now[:10])).drop("change"))
    rows = {r.fingerprint: r for r in table.read().collect()}
    assert (rows["f"].hit_count, rows["f"].distinct_days, rows["f"].status, rows["f"].claim) == (6, 2, "applied", "later")
    assert (rows["g"].hit_count, rows["g"].status, rows["g"].first_seen, rows["g"].last_seen) == (3, "active", "2024-01-01T04:00:00Z", "2024-01-03T04:00:00Z")
    assert table.version() == 3 and table.read(1).count() == 2
    table.vacuum(1)
    assert table.version() == 3 and table.read().count() == 2


def test_decay_is_strict_and_promotion_inclusive(spark):
    rows = [("a", "short", "active", 3, 3, "2024-01-15 00:00:00"), ("b", "short", "active", 3, 2, "2024-01-14 23:59:59"), ("c", "long", "active", 9, 9, "2023-01-01 00:00:00"), ("d", "short", "applied", 3, 3, "2023-01-01 00:00:00")]
    items = spark.createDataFrame(rows, "fingerprint string, horizon string, status string, hit_count long, distinct_days long, last_seen string").withColumn("last_seen", F.to_timestamp("last_seen"))
    assert sorted(r.fingerprint for r in ledger.promotions(items).collect()) == ["a", "d"]
    assert [r.fingerprint for r in ledger.decays(items, F.to_timestamp(F.lit("2024-01-29 00:00:00"))).collect()] == ["b"]


def test_stats_have_null_as_a_value(spark):
    assert {(r.status, r["items"]) for r in ledger.stats(spark.createDataFrame([("x",), (None,), (None,)], "status string"), "status").collect()} == {("x", 1), ("null", 2)}


def test_shards_keep_threads_whole_and_balance(spark):
    groups = spark.createDataFrame([("a", 9), ("b", 7), ("c", 6), ("d", 5), ("e", 5)], "thread string, tokens long")
    got = {r.thread: r.shard_id for r in sharding.assign_shards(groups, 16, 6).collect()}
    assert got == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 1} or got == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 1}
    assert sharding.assign_shards(groups.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_shards_are_those_of_dealing_one_by_one(spark, seed):
    rng = random.Random(seed)
    groups = [(f"t{k:03d}", rng.choice((0, 0, 1, 5, 5, 7, 40, rng.randint(0, 60)))) for k in range(rng.randint(1, 120))]
    want, total = {}, sum(t for _, t in groups)
    loads = [0] * max(1, min(5, -(-total // 30), len(groups)))
    for name, tokens in sorted(groups, key=lambda g: (-g[1], g[0])):
        want[name] = loads.index(min(loads))
        loads[want[name]] += tokens
    got = sharding.assign_shards(spark.createDataFrame(groups, "thread string, tokens long"), 30, 5)
    assert {r.thread: r.shard_id for r in got.collect()} == want
    assert sharding.assign_shards(spark.createDataFrame([], "thread string, tokens long")).count() == 0


def test_inbox_is_a_shard_of_its_own_without_sessions(spark):
    empty = spark.createDataFrame([], "shard_id int, id string, repository string, branch string, est_tokens long")
    rows = sharding.manifest(empty, 2, "a note that is long").collect()
    assert [(r.shard_id, r.kind, r.n_commits, r.est_tokens) for r in rows] == [("01", "git", 2, 0), ("02", "inbox", 0, 4)]


def test_commits_keep_their_own_files(spark):
    f, r = harvest.FIELD, harvest.RECORD
    raw = f"{r}{'a' * 40}{f}n{f}e{f}d{f}one\n\nx.py\ny.py\n{r}{'b' * 40}{f}n{f}e{f}d{f}two\n{r}bad{f}n"
    rows = harvest.parse_commits(spark.createDataFrame([("repo", raw)], "repo string, raw string")).collect()
    assert [(x.hash, x.subject, x["files"]) for x in rows] == [("a" * 40, "one", ["x.py", "y.py"]), ("b" * 40, "two", [])]
    alike = spark.createDataFrame([("repo", "c" * 12 + x, "d", "s") for x in ("1", "2", "2")], "repo string, hash string, date string, subject string")
    assert [r.hash for r in harvest.distinct_commits(alike).collect()] == ["c" * 12] * 2
    assert harvest.by_author(spark.createDataFrame([("Ann", "a@x"), ("Bob", "b@x")], "author string, email string"), ["^Ann"]).count() == 1


def test_folders_without_a_name_stay(spark):
    df = spark.createDataFrame([(None,), ("/a/Scratch",), ("/a/b",)], "cwd string")
    assert [r.cwd for r in harvest.exclude_folders(df, ["scratch"]).collect()] == [None, "/a/b"]


@pytest.mark.parametrize("pattern, text, fits", [("*/x?", "a/xy", True), ("*/x?", "a/x", False), ("[!ab]*", "cd", True), ("[!ab]*", "ad", False), ("a.b", "axb", False), ("[", "[", True)])
def test_shell_patterns(spark, pattern, text, fits):
    assert spark.createDataFrame([(text,)], "t string").select(F.col("t").rlike(C.glob_regex(pattern))).first()[0] is fits


def test_a_receipt_counts_for_its_own_bucket_only(spark):
    order = spark.createDataFrame([("by_skill", "a", "1"), ("by_skill", "a", "2"), ("active_add", None, "3"), ("active_remove", None, "4"), ("review_queue", None, "5"), ("drop", None, "6")], "bucket string, skill string, fingerprint string")
    receipts = spark.createDataFrame([("skill", "a", "complete", ["1", "2", None, ""]), ("skill", "a", "failed", ["5"]), ("active-work", None, "complete", ["3"]), ("skill", "b", "complete", ["4", "5"])], files.RECEIPT.replace("completed_utc string, ", ""))
    got = {(r.receipt_bucket, r.name): r.complete for r in replay.bucket_completion(order, receipts).collect()}
    assert got == {("skill", "a"): True, ("active-work", None): False, ("review-queue", None): False}
    rejected = spark.createDataFrame([("3",), ("4",), (None,)], "fingerprint string")
    once = replay.filter_order(order, rejected)
    assert sorted(r.fingerprint for r in once.collect()) == ["1", "2", "4", "5", "6"] == sorted(r.fingerprint for r in replay.filter_order(once, rejected).collect())


def test_files_in(spark, tmp_path):
    (tmp_path / "claims-01.json").write_text('[{"claim": "one", "importance": 3}, {"claim": " "}]')
    (tmp_path / "claims-02.json").write_text('﻿{"claims": [{"claim": "two"}, {"claim": "three"}]}')
    (tmp_path / "claims-03.json").write_text('{"claim": "four", "horizon": "long"}')
    (tmp_path / "claims-04.json").write_text("{broken")
    good, bad = files.read_claims(spark, str(tmp_path))
    assert [r.claim for r in good.orderBy("ord").collect()] == ["one", "two", "three", "four"] and bad.count() == 1
    assert files.numbered(good).select("ord").distinct().count() == 4
    folder = tmp_path / "receipts"
    folder.mkdir()
    (folder / "a.json").write_text('{"bucket": "skill", "name": "a", "status": "complete", "fingerprints": ["x"]}')
    (folder / "b.json").write_text("[1]")
    (folder / "c.json").write_text("{")
    good, bad = files.read_receipts(spark, str(folder))
    assert [r.name for r in good.collect()] == ["a"] and bad.count() == 2
    (tmp_path / "p.md").write_text("---\nslug: My-Slug\nfingerprint: f1\n---\n# A title\n")
    found = proposals.parse_proposals(proposals.read_proposals(spark, str(tmp_path)))
    assert [(r.name, r.slug, r.title, r.target) for r in proposals.select_proposals(found, slug="my?s*g").collect()] == [("p.md", "My-Slug", "A title", None)]
    assert proposals.select_proposals(found, file="q.md").isEmpty() and proposals.select_proposals(found, everything=True).count() == 1


def test_sqlite_source_is_read_only(spark, tmp_path):
    path = str(tmp_path / "s.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE sessions (id TEXT, updated_at TEXT)")
        db.executemany("INSERT INTO sessions VALUES (?, ?)", [(str(k), f"2024-01-0{k}T00:00:00Z") for k in range(1, 8)])
    spark.dataSource.register(files.SqliteSource)
    read = spark.read.format("lodestrata_sqlite").options(path=path, table="sessions", columns="id string, updated_at string", since="2024-01-03T00:00:00Z", partitions=3)
    assert sorted(r.id for r in read.load().collect()) == ["4", "5", "6", "7"]
    assert spark.read.format("lodestrata_sqlite").options(path=path + "-none", table="sessions", columns="id string").load().count() == 0


def test_config_and_watermark(tmp_path):
    (tmp_path / "c.json").write_text('﻿{"max_hours": 48, "authors": ["a"], "note": 1}', encoding="utf-8")
    config = cfg.load_config(str(tmp_path / "c.json"))
    assert (config.max_hours, config.authors, config.decay_days) == (48, ("a",), 14)
    assert cfg.read_watermark(str(tmp_path / "none.json")) == {}
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(ValueError):
        cfg.read_watermark(str(tmp_path / "bad.json"))
    cfg.write_atomically(str(tmp_path / "latest.json"), {"target": "c.json"})
    assert cfg.resolve_pointer(str(tmp_path / "latest.json")) == str(tmp_path / "c.json")


def test_night_promotes_after_upsert(spark, tmp_path):
    rows = claims(spark, {"horizon": "short", "fingerprint": ""}).drop("fingerprint")
    for day in (1, 2, 3):
        night = nightly.run_night(spark, str(tmp_path), rows, f"2024-01-0{day}T04:00:00Z", cfg.Config(long_term_skills={"skill-a": "a.md"}))
    assert night.version == 3 and {(r.bucket, r.promoted) for r in night.order.collect()} == {("active_add", False), ("by_skill", True)}
    nightly.record(spark, str(tmp_path), {"run_id": "r1", "status": "failed"})
    nightly.record(spark, str(tmp_path), {"run_id": "r1", "status": "success", "finished": "2024-01-03"})
    assert [r.status for r in store.runs_table(spark, str(tmp_path)).read().collect()] == ["success"]


def test_stream_folds_each_batch_once(spark, tmp_path):
    source, table = str(tmp_path / "in"), store.items_table(spark, str(tmp_path / "t"))
    now = lambda n: f"2024-01-0{n + 1}T00:00:00Z"
    for _ in range(2):
        claims(spark, {}, {"fingerprint": "g"}).write.mode("append").parquet(source)
        stream = spark.readStream.schema(CLAIM).parquet(source)
        registry.run_registry(stream, table, str(tmp_path / "cp"), now).awaitTermination()
    counts = lambda: {(r.fingerprint, r.hit_count, r.distinct_days) for r in table.read().collect()}
    registry.fold_batches(table, now, registry.stream_name(str(tmp_path / "cp")))(claims(spark, {}), 0)  # tried again: nothing new
    assert counts() == {("f", 2, 2), ("g", 2, 2)}
    registry.fold_batches(table, now, "another")(claims(spark, {}), 0)  # another stream's first batch is not taken for it
    assert counts() == {("f", 3, 3), ("g", 2, 2)}


def test_success_and_watermark(spark):
    one = spark.range(1)
    done = one.select(health.succeeded(F.lit(True), F.lit(None).cast("boolean")), health.advances_watermark(F.lit(True), F.lit(None).cast("boolean"), F.lit(False)), health.advances_watermark(F.lit(True), F.lit(True), F.lit(False)))
    assert tuple(done.first()) == (False, True, False)
