"""Every query by name, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import classify, harvest, health, ledger, merge, replay, routing, sharding
from ..operators.written import written
from ..sources import tables as T
from ..sources.tables import SKILLS, sql_fingerprint, with_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Least tokens of a shard in the queries, so that the small tables fill six of them.
SHARD_TOKENS = 12_000
SINCE = "2024-01-10T00:00:00Z"
CLAIM_COLUMNS = "fingerprint, claim, domain, horizon, importance, confidence, target, source, evidence, n_raw"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _merged(spark: SparkSession, d: str) -> DataFrame:
    return merge.merge_claims(T.claims(spark, d))


def _routed(spark: SparkSession, d: str, skills: list[str] = SKILLS) -> DataFrame:
    return routing.route(_merged(spark, d), T.rejected(spark, d), skills)


def _order(spark: SparkSession, d: str) -> DataFrame:
    held = T.items(spark, d)
    as_of = T.sightings(spark, d).agg(F.max("ts").alias("as_of"))
    stale = ledger.decays(held.crossJoin(as_of), F.col("as_of"))  # one row besides
    rejected = written(T.rejected(spark, d))  # fingerprints are dear, and claims and promotions both want them
    return routing.work_order(_merged(spark, d), rejected, ledger.promotions(held), stale, SKILLS)


@query(f"SELECT doc_id, {sql_fingerprint('text')} AS fingerprint FROM documents")
def fingerprint_documents(spark, d):
    return T.table(spark, d, "documents").select("doc_id", C.fingerprint(F.col("text")).alias("fingerprint"))


@query(with_sql("merged", f"SELECT {CLAIM_COLUMNS} FROM merged"))
def merge_candidates(spark, d):
    return _merged(spark, d).select(*CLAIM_COLUMNS.split(", "))


@query(with_sql("claims", "SELECT fingerprint, count(*) AS n_raw, array_to_string(list_sort(list_distinct(list(horizon))), ',') AS horizons FROM claims GROUP BY 1 HAVING count(DISTINCT horizon) > 1"))
def merge_conflicts(spark, d):
    return merge.conflicts(T.claims(spark, d))


@query(with_sql("claims", "SELECT fingerprint, count(*) AS n_raw, min(ord) AS first_ord, max(ord) AS last_ord FROM claims GROUP BY 1 HAVING count(*) > 1"))
def duplicate_groups(spark, d):
    return merge.duplicate_groups(T.claims(spark, d))


_SETS = ("long", "short", "drop", "long short", "long drop", "short drop", "long short drop")


@query("""
WITH s AS (SELECT * FROM (VALUES ('long'), ('short'), ('drop'), ('long short'), ('long drop'), ('short drop'), ('long short drop')) t(hs)), c AS (SELECT * FROM (VALUES ('high', 3), ('medium', 2), ('low', 1)) t(confidence, r)),
h AS (SELECT hs, confidence, r, CASE WHEN hs = 'long short' OR hs IN ('short', 'short drop') THEN 'short' WHEN hs = 'drop' THEN 'drop' ELSE 'long' END AS horizon,
 CASE WHEN hs IN ('long drop', 'short drop', 'long short drop') THEN least(r, 2) ELSE r END AS q FROM s, c)
SELECT hs AS horizons, confidence AS given, horizon, CASE q WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN horizon = 'short' THEN 'dream-active-work' ELSE 'skill-a' END AS target FROM h""")
def merge_truth_table(spark, d):
    """Every set of horizons, each twice over, with every confidence."""
    rows = []
    for hs in _SETS:
        for confidence in ("high", "medium", "low"):
            for k, h in enumerate(hs.split() * 2):
                rows.append((len(rows), f"{hs}/{confidence}", h, 5 - k, confidence))
    blank = {c: F.lit(None).cast("string") for c in ("domain", "status", "source", "evidence", "notes")}
    claims = spark.createDataFrame(rows, "ord long, fingerprint string, horizon string, importance int, confidence string").withColumns(blank | {"claim": F.col("fingerprint"), "target": F.lit("skill-a")})
    key = F.split("fingerprint", "/")
    return merge.merge_claims(claims).select(key[0].alias("horizons"), key[1].alias("given"), "horizon", "confidence", "target")


@query(with_sql("plan", "SELECT fingerprint, horizon, confidence, target, importance, bucket, skill, new_skill, rejected_denied FROM routed"))
def plan_routes(spark, d):
    return _routed(spark, d).select("fingerprint", "horizon", "confidence", "target", "importance", "bucket", "skill", "new_skill", "rejected_denied")


@query(with_sql("plan", """SELECT count(*) AS candidates, count(DISTINCT skill) AS skills_to_edit, count(skill) AS apply_claims, count(*) FILTER (bucket = 'active_add') AS active_add, 0::BIGINT AS active_remove,
  count(*) FILTER (bucket = 'review_queue') AS review_queue, count(*) FILTER (bucket = 'drop') AS drops, count(*) FILTER (rejected_denied) AS rejected_denied FROM routed"""))
def plan_totals(spark, d):
    return routing.totals(_routed(spark, d))


@query(with_sql("plan", """SELECT bucket, count(*) AS n, count(*) FILTER (new_skill) AS new_skills FROM (SELECT CASE WHEN bucket IN ('by_skill', 'review_queue') THEN 'review_queue' ELSE bucket END AS bucket,
  bucket IN ('by_skill', 'review_queue') AND target <> 'review-queue' AND importance >= 7 AS new_skill FROM routed) GROUP BY 1"""))
def plan_cold_start(spark, d):
    """Without configured skills only the seed is known, which no claim names."""
    return _routed(spark, d, routing.long_term_skills([], "general")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count_if("new_skill").alias("new_skills"))


@query(with_sql("merged rejected", "SELECT fingerprint, horizon, importance FROM merged WHERE fingerprint NOT IN (SELECT fingerprint FROM rejected)"))
def veto_rejected(spark, d):
    return _merged(spark, d).join(T.rejected(spark, d), "fingerprint", "left_anti").select("fingerprint", "horizon", "importance")


@query(with_sql("plan", "SELECT fingerprint, target, importance, confidence FROM routed WHERE new_skill"))
def new_skill_proposals(spark, d):
    return _routed(spark, d).where("new_skill").select("fingerprint", "target", "importance", "confidence")


_ORDER = """promo AS (SELECT fingerprint, importance, target, hit_count, distinct_days FROM items WHERE hit_count >= 3 AND distinct_days >= 3 AND status IN ('active', 'applied') AND fingerprint NOT IN (SELECT fingerprint FROM rejected)),
stale AS (SELECT fingerprint FROM items WHERE status = 'active' AND last_seen < (SELECT max(ts) FROM sightings) - INTERVAL 14 DAY),
wo AS (SELECT fingerprint, bucket, skill, importance, evidence, false AS promoted, rejected_denied FROM routed UNION ALL
  SELECT fingerprint, CASE WHEN target = 'skill-a' THEN 'by_skill' ELSE 'review_queue' END, CASE WHEN target = 'skill-a' THEN target END, CASE WHEN importance = 0 THEN 6 ELSE importance END, 'promoted (hit=' || hit_count || ' days=' || distinct_days || ')', true, false FROM promo
  UNION ALL SELECT fingerprint, 'active_remove', NULL, NULL, NULL, false, false FROM stale)"""


def _order_sql(select: str) -> str:
    base = with_sql("plan items", select)
    return base[: -len(select) - 1] + ",\n" + _ORDER + "\n" + select


@query(_order_sql("SELECT fingerprint, bucket, skill, importance, evidence, promoted FROM wo"))
def plan_with_promotions(spark, d):
    return _order(spark, d).select("fingerprint", "bucket", "skill", "importance", "evidence", "promoted")


@query(with_sql("items", "SELECT key, hit_count, distinct_days, first_seen, last_seen FROM fold"))
def ledger_fold(spark, d):
    return ledger.fold_history(T.sightings(spark, d)).select("key", F.col("hit_count").cast("long"), F.col("distinct_days").cast("long"), "first_seen", "last_seen")


@query("""
WITH s AS (SELECT user_id % 50 || '/' || event_type AS key, event_id AS ord, ts::DATE AS day FROM events),
w AS (SELECT key, CASE WHEN lag(day) OVER (PARTITION BY key ORDER BY ord) IS NOT DISTINCT FROM day THEN 0 ELSE 1 END AS fresh FROM s)
SELECT key, count(*) AS hit_count, sum(fresh)::BIGINT AS distinct_days FROM w GROUP BY key""")
def ledger_fold_runs(spark, d):
    events = T.table(spark, d, "events")
    log = events.select(F.concat_ws("/", (F.col("user_id") % 50).cast("string"), "event_type").alias("key"), F.col("event_id").alias("ord"), F.to_date("ts").alias("day"))
    return ledger.fold_runs(log)


@query(with_sql("sightings", """, p AS (SELECT key, count(*) AS hits, count(DISTINCT ts::DATE) AS days, max(ts::DATE) AS last_day FROM sightings WHERE ts < TIMESTAMP '2024-01-20' GROUP BY key),
b AS (SELECT key, count(*) AS hits, max_by(value, ord) AS value FROM sightings WHERE ts >= TIMESTAMP '2024-01-20' AND ts < TIMESTAMP '2024-01-21' GROUP BY key)
SELECT coalesce(p.key, b.key) AS fingerprint, coalesce(p.hits, 0) + coalesce(b.hits, 0) AS hit_count, coalesce(p.days, 0) + CASE WHEN b.key IS NOT NULL THEN 1 ELSE 0 END AS distinct_days,
 CASE WHEN b.key IS NOT NULL THEN '2024-01-20' ELSE p.last_day::VARCHAR END AS last_day, CASE WHEN p.key IS NULL THEN 'inserted' WHEN b.key IS NULL THEN 'kept' ELSE 'updated' END AS change,
 CASE WHEN b.key IS NOT NULL AND b.value >= 50 THEN 'applied' ELSE 'active' END AS status FROM p FULL JOIN b ON p.key = b.key""").replace("\n, p AS", ", p AS"))
def ledger_upsert_batch(spark, d):
    """The log up to a day as the registry, and that day's sightings as a batch."""
    seen = T.sightings(spark, d)
    none = F.lit(None).cast("string")
    extra = {c: none for c in ledger.ATTRIBUTES if c not in ("claim", "importance")}
    past = ledger.fold_history(seen.where("ts < TIMESTAMP_NTZ '2024-01-20'")).withColumns(
        extra | {"fingerprint": F.col("key"), "claim": F.col("key"), "importance": F.lit(1), "status": F.lit("active"), "last_day": F.to_date("last_seen").cast("string"), "updated_at": none, "first_seen": F.col("first_seen").cast("string"), "last_seen": F.col("last_seen").cast("string")}
    )
    status = F.when(F.col("value") >= 50, "applied").otherwise("active")
    batch = seen.where("ts >= TIMESTAMP_NTZ '2024-01-20' AND ts < TIMESTAMP_NTZ '2024-01-21'").withColumns(extra | {"fingerprint": F.col("key"), "claim": F.col("key"), "importance": F.lit(1), "status": status})
    found = ledger.upsert(past.drop("key"), batch, F.lit("2024-01-20T04:15:00Z"), F.lit("2024-01-20"))
    return found.select("fingerprint", "hit_count", "distinct_days", "last_day", "change", "status")


@query(with_sql("items", "SELECT fingerprint, claim, importance, hit_count, distinct_days, target FROM items WHERE hit_count >= 3 AND distinct_days >= 3"))
def promotions(spark, d):
    return ledger.promotions(T.items(spark, d)).select("fingerprint", "claim", "importance", "hit_count", "distinct_days", "target")


@query(with_sql("items", "SELECT fingerprint, claim, last_seen, target FROM items WHERE status = 'active' AND last_seen < (SELECT max(ts) FROM events) - INTERVAL 14 DAY"))
def decays(spark, d):
    as_of = T.table(spark, d, "events").agg(F.max("ts").alias("as_of"))
    return ledger.decays(T.items(spark, d).crossJoin(as_of), F.col("as_of")).select("fingerprint", "claim", "last_seen", "target")  # one row besides


@query(with_sql("merged", "SELECT horizon, count(*) AS items FROM merged GROUP BY 1"))
def ledger_stats_horizon(spark, d):
    return ledger.stats(_merged(spark, d), "horizon")


@query(with_sql("items", "SELECT status, count(*) AS items FROM items GROUP BY 1"))
def ledger_stats_status(spark, d):
    return ledger.stats(T.items(spark, d), "status")


@query(with_sql("items", "SELECT fingerprint, claim, horizon, importance, status, hit_count, distinct_days FROM items WHERE status = 'applied' AND horizon = 'short'"))
def ledger_dump(spark, d):
    return ledger.dump(T.items(spark, d), "applied", "short").select("fingerprint", "claim", "horizon", "importance", "status", "hit_count", "distinct_days")


@query(with_sql("plan", """SELECT fingerprint, CASE WHEN bucket IN ('by_skill', 'active_add') THEN 'applied' WHEN bucket = 'review_queue' THEN 'proposed' WHEN rejected_denied THEN 'rejected' ELSE 'active' END AS status FROM routed"""))
def set_status(spark, d):
    routed = written(_routed(spark, d).select("fingerprint", "bucket", "rejected_denied"))  # both the items and their updates
    items = routed.select("fingerprint", F.lit("active").alias("status"))
    bucket = F.col("bucket")
    new = F.when(bucket.isin("by_skill", "active_add"), "applied").when(bucket == "review_queue", "proposed").when(F.col("rejected_denied"), "rejected")
    updates = routed.select("fingerprint", new.alias("status"), F.lit(1).alias("ord")).where("status IS NOT NULL")
    return ledger.set_status(items, updates, F.lit("2024-02-01T00:00:00Z"))


def _runs(spark, d):
    day = F.to_date("ts")
    rows = T.table(spark, d, "events").groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("harvested"), F.max("ts").alias("finished"))
    return rows.select(F.date_format("day", "yyyyMMdd").alias("run_id"), "finished", "harvested", F.when(F.dayofmonth("day") % 7 == 0, "failed").otherwise("success").alias("status"))


_RUNS_SQL = "runs AS (SELECT strftime(ts::DATE, '%Y%m%d') AS run_id, max(ts) AS finished, count(*) AS harvested, CASE WHEN day(ts::DATE) % 7 = 0 THEN 'failed' ELSE 'success' END AS status FROM events GROUP BY ts::DATE)"


@query(f"WITH {_RUNS_SQL} SELECT run_id, finished, harvested, status FROM runs ORDER BY finished DESC LIMIT 1")
def last_run(spark, d):
    return ledger.last_run(_runs(spark, d))


@query(f"WITH {_RUNS_SQL} SELECT run_id, finished, CASE WHEN status = 'failed' THEN 0 ELSE harvested END AS harvested, CASE WHEN status = 'failed' THEN 'success (rerun)' ELSE status END AS status FROM runs")
def record_run(spark, d):
    runs = _runs(spark, d)
    again = runs.where("status = 'failed'").withColumns({"status": F.lit("success (rerun)"), "harvested": F.lit(0).cast("long")})
    return ledger.record_run(runs, again)


@query("""
SELECT elapsed, override, CASE WHEN coalesce(override, 0) <> 0 THEN least(trunc(override), 72)::DOUBLE WHEN elapsed IS NULL THEN 30.0::DOUBLE ELSE greatest(30.0::DOUBLE, least(elapsed + 1, 72.0::DOUBLE)) END AS hours
FROM (VALUES (NULL::DOUBLE), (0.0), (24.0), (29.0), (29.5), (48.25), (71.0), (72.0), (500.0)) e(elapsed), (VALUES (NULL::DOUBLE), (0.0), (0.5), (5.9), (72.0), (100.0)) o(override)""")
def harvest_window(spark, d):
    elapsed = spark.createDataFrame([(x,) for x in (None, 0.0, 24.0, 29.0, 29.5, 48.25, 71.0, 72.0, 500.0)], "elapsed double")
    override = spark.createDataFrame([(x,) for x in (None, 0.0, 0.5, 5.9, 72.0, 100.0)], "override double")
    return elapsed.crossJoin(override).withColumn("hours", harvest.window_hours(F.col("elapsed"), F.col("override")))  # 54 rows


@query(with_sql("sessions turns", f"""SELECT s.id, s.cwd, s.repository, s.branch, s.updated_at, count(*) AS n_turns, count(*) FILTER (len(t.assistant_text) > 1600) AS n_truncated,
  sum(least(len(coalesce(t.user_text, '')), 4000))::BIGINT AS user_chars, sum(least(len(coalesce(t.assistant_text, '')), 1600))::BIGINT AS assistant_chars FROM sessions s JOIN turns t ON s.id = t.session_id
  WHERE s.updated_at > '{SINCE}' AND NOT contains(lower(coalesce(s.cwd, '')), 'scratch') GROUP BY ALL"""))
def harvest_sessions(spark, d):
    found = harvest.harvest_sessions(T.sessions(spark, d), T.turns(spark, d), SINCE, ["SCRATCH"])
    return found.select("id", "cwd", "repository", "branch", "updated_at", "n_turns", "n_truncated", "user_chars", "assistant_chars")


@query(with_sql("turns", "SELECT session_id, turn_index, user_text, assistant_text FROM turns"))
def pair_turns(spark, d):
    return T.turns(spark, d)


@query(with_sql("sessions turns", """SELECT s.id, array_to_string(coalesce(f.files, []), ',') AS files, len(coalesce(f.files, []))::BIGINT AS n_files FROM sessions s
  LEFT JOIN (SELECT session_id, list_sort(list('file-' || turn_index)) AS files FROM turns WHERE turn_index % 2 = 1 GROUP BY 1) f ON s.id = f.session_id"""))
def session_aux_left_join(spark, d):
    files = T.turns(spark, d).where("turn_index % 2 = 1")
    joined = harvest.attach(T.sessions(spark, d), files, "files", F.concat(F.lit("file-"), F.col("turn_index").cast("string")))
    return joined.select("id", F.array_join("files", ",").alias("files"), F.size("files").cast("long").alias("n_files"))


@query(with_sql("commits", "SELECT repo, hash, min(date) AS date, min(subject) AS subject FROM commits GROUP BY 1, 2"))
def git_dedupe_commits(spark, d):
    return harvest.distinct_commits(T.commits(spark, d))


@query(with_sql("commits", "SELECT repo, hash, date, nth FROM (SELECT repo, hash, date, row_number() OVER (PARTITION BY repo ORDER BY date DESC, hash) AS nth FROM (SELECT DISTINCT repo, hash, date FROM commits)) WHERE nth <= 20"))
def git_commit_topn(spark, d):
    return harvest.newest_commits(harvest.distinct_commits(T.commits(spark, d))).select("repo", "hash", "date", F.col("nth").cast("long").alias("nth"))


@query("SELECT 'repo' || (doc_id % 5) AS repo, substr(sha1(doc_id::VARCHAR), 1, 12) AS hash, source AS author, lang || '@x.org' AS email, 'doc ' || doc_id AS subject, 'a-' || doc_id || ',b.py' AS files FROM documents WHERE doc_id % 9 <> 4")
def parse_git_records(spark, d):
    k = F.col("doc_id").cast("string")
    header = F.concat_ws(harvest.FIELD, F.sha1(k), "source", F.concat("lang", F.lit("@x.org")), F.lit("2024-01-01T00:00:00+00:00"), F.concat(F.lit("doc "), k))
    whole = F.concat(F.lit(harvest.RECORD), F.when(F.col("doc_id") % 9 == 4, F.concat_ws(harvest.FIELD, F.sha1(k), "source")).otherwise(header), F.lit("\n\na-"), k, F.lit("\nb.py\n"))
    records = T.table(spark, d, "documents").select(F.concat(F.lit("repo"), (F.col("doc_id") % 5).cast("string")).alias("repo"), whole.alias("raw"))
    return harvest.parse_commits(records).select("repo", F.left("hash", F.lit(12)).alias("hash"), "author", "email", "subject", F.array_join("files", ",").alias("files"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'note ' || doc_id || chr(10) || '---notes---' || chr(10) || 'again' WHEN doc_id % 3 = 1 THEN 'all ' || doc_id ELSE '' END AS body FROM documents")
def inbox_extract(spark, d):
    k = F.col("doc_id")
    note = F.concat(F.lit("head\n---notes---\n note "), k.cast("string"), F.lit("\n---notes---\nagain \n\t"))
    raw = F.when(k % 3 == 0, note).when(k % 3 == 1, F.concat(F.lit("  all "), k.cast("string"), F.lit("\n")))
    return T.table(spark, d, "documents").select("doc_id", harvest.inbox_body(raw, "---notes---").alias("body"))


@query(with_sql("sessions commits", f"""SELECT (SELECT count(*) FROM sessions WHERE updated_at > '{SINCE}') AS sessions, (SELECT count(DISTINCT repo) FROM commits) AS git_repos,
  (SELECT count(*) FROM (SELECT DISTINCT repo, hash FROM commits)) AS git_commits, (SELECT sum(len(trim(text, ' ' || chr(10) || chr(9)))) FROM benchmark)::BIGINT AS inbox_chars"""))
def harvest_stats(spark, d):
    inbox = T.table(spark, d, "benchmark").select(harvest.inbox_body(F.col("text"), "---notes---").alias("body"))
    return harvest.harvest_stats(harvest.in_window(T.sessions(spark, d), SINCE), harvest.distinct_commits(T.commits(spark, d)), inbox)


@query(with_sql("sessions commits", f"""SELECT '- `' || left(id::VARCHAR, 8) || '` | repo=' || repository || ' branch=' || coalesce(branch, 'null') || ' | ' || coalesce(summary, '(no summary)') || ' | turns=1' AS line FROM sessions WHERE updated_at > '{SINCE}'
  UNION ALL SELECT '### ' || repo || ' (' || count(DISTINCT hash) || ')' FROM commits GROUP BY repo UNION ALL SELECT '- `' || left(hash, 8) || '` ' || subject || '  _(' || left(date, 10) || ')_' FROM
  (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY date DESC, hash) AS nth FROM (SELECT DISTINCT repo, hash, date, subject FROM commits)) WHERE nth <= 20"""))
def harvest_digest(spark, d):
    found = harvest.in_window(T.sessions(spark, d), SINCE).withColumns({"n_turns": F.lit(1), "branch": F.coalesce("branch", F.lit("null"))})
    return harvest.digest_lines(found, harvest.distinct_commits(T.commits(spark, d))).select("line")


@query(with_sql("tokens", "SELECT id, est_tokens::BIGINT AS est_tokens FROM tok"))
def session_tokens(spark, d):
    return sharding.session_tokens(T.sessions(spark, d), T.turns(spark, d)).select("id", "est_tokens")


@query(with_sql("tokens", "SELECT thread, count(*) AS n_sessions, sum(est_tokens)::BIGINT AS tokens FROM tok GROUP BY thread"))
def thread_groups(spark, d):
    return sharding.thread_groups(sharding.session_tokens(T.sessions(spark, d), T.turns(spark, d)))


@query(with_sql("shards", "SELECT thread, tokens, shard_id FROM assigned"))
def shard_assignment(spark, d):
    return sharding.assign_shards(sharding.thread_groups(sharding.session_tokens(T.sessions(spark, d), T.turns(spark, d))), SHARD_TOKENS)


def _sharded(spark, d):
    return sharding.sharded_sessions(sharding.session_tokens(T.sessions(spark, d), T.turns(spark, d)), SHARD_TOKENS)


@query(with_sql("shards", """, f AS (SELECT a.shard_id, t.* FROM tok t JOIN assigned a ON t.thread = a.thread), l AS (SELECT shard_id FROM f GROUP BY shard_id ORDER BY sum(est_tokens), shard_id LIMIT 1)
SELECT lpad((shard_id + 1)::VARCHAR, 2, '0') AS shard_id, 'sessions' AS kind, count(*) AS n_sessions, 0::BIGINT AS n_commits, (sum(est_tokens) + CASE WHEN shard_id = (SELECT shard_id FROM l) THEN 2 ELSE 0 END)::BIGINT AS est_tokens,
 array_to_string(list_sort(list(left(id::VARCHAR, 8))), ',') AS session_ids, array_to_string(list_sort(list_distinct(list(coalesce(branch, repository)))), ',') AS branches FROM f GROUP BY f.shard_id
UNION ALL SELECT lpad((count(DISTINCT shard_id) + 1)::VARCHAR, 2, '0'), 'git', 0, 7, 0, '', '' FROM f""").replace("\n, f AS", ", f AS"))
def shard_manifest(spark, d):
    found = sharding.manifest(_sharded(spark, d).withColumn("id", F.col("id").cast("string")), 7, " two notes ", listed=True)
    return found.withColumns({c: F.col(c).cast("long") for c in ("n_sessions", "n_commits", "est_tokens")})


@query(with_sql("shards", "SELECT (SELECT count(*) FROM tok) AS sessions, (SELECT count(DISTINCT shard_id) FROM assigned) AS shards, (SELECT sum(est_tokens) FROM tok)::BIGINT AS est_tokens"))
def shard_totals(spark, d):
    return sharding.manifest_totals(_sharded(spark, d))


@query(with_sql("sessions", "SELECT repository, branch, count(*) AS sessions FROM sessions WHERE branch IS NOT NULL GROUP BY ALL HAVING count(*) >= 2"))
def active_threads(spark, d):
    return classify.active_threads(T.sessions(spark, d))


_REPLAY = """, veto AS (SELECT DISTINCT fingerprint FROM wo WHERE substr(fingerprint, 16, 1) IN ('a', '3')),
fo AS (SELECT * FROM wo WHERE bucket IN ('drop', 'active_remove') OR fingerprint NOT IN (SELECT fingerprint FROM veto)),
own AS (SELECT DISTINCT CASE bucket WHEN 'by_skill' THEN 'skill' WHEN 'review_queue' THEN 'review-queue' ELSE 'active-work' END AS receipt_bucket, skill AS name, fingerprint FROM fo WHERE bucket <> 'drop'),
got AS (SELECT DISTINCT CASE bucket WHEN 'by_skill' THEN 'skill' ELSE 'active-work' END AS receipt_bucket, skill AS name, fingerprint FROM wo WHERE bucket IN ('by_skill', 'active_add', 'active_remove')
  AND NOT (coalesce(skill, '') = 'skill-b' AND substr(fingerprint, 1, 1) = '0') AND coalesce(skill, '') <> 'skill-c'),
done AS (SELECT o.receipt_bucket, o.name, count(*) AS fingerprints, count(g.fingerprint) AS received FROM own o LEFT JOIN got g ON o.receipt_bucket = g.receipt_bucket AND o.name IS NOT DISTINCT FROM g.name AND o.fingerprint = g.fingerprint GROUP BY ALL)
"""


def _replay_sql(select: str) -> str:
    return _order_sql("@").removesuffix("\n@") + _REPLAY + select


def _replay(spark, d):
    order = written(_order(spark, d).select("fingerprint", "bucket", "skill"))
    return order, order.where(F.substring("fingerprint", 16, 1).isin("a", "3")).select("fingerprint").distinct()


@query(_replay_sql("SELECT fingerprint, bucket, skill FROM fo"))
def replay_filter(spark, d):
    return replay.filter_order(*_replay(spark, d))


@query(_replay_sql("SELECT receipt_bucket, name, fingerprints, received, fingerprints = received AS complete FROM done"))
def replay_bucket_completion(spark, d):
    order, veto = _replay(spark, d)
    return replay.bucket_completion(replay.filter_order(order, veto), T.receipts(order))


@query(_replay_sql("""SELECT count(DISTINCT skill) AS skills_to_edit, count(skill) AS apply_claims, count(*) FILTER (bucket = 'active_add') AS active_add, count(*) FILTER (bucket = 'active_remove') AS active_remove,
  count(*) FILTER (bucket = 'review_queue') AS review_queue, (SELECT count(*) FROM done WHERE fingerprints = received) AS completed_buckets, (SELECT count(DISTINCT fingerprint) FROM got) AS completed_fingerprints,
  (SELECT count(DISTINCT fingerprint) FROM wo WHERE bucket IN ('by_skill', 'active_add', 'review_queue') AND fingerprint IN (SELECT fingerprint FROM veto)) AS rejected_denied FROM fo"""))
def replay_totals(spark, d):
    order, veto = _replay(spark, d)
    return replay.replay_totals(order, veto, T.receipts(order))


@query("SELECT event_type AS kind, event_id AS name, ts AS modified, nth FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth <= 40")
def retention_keep_n(spark, d):
    files = T.table(spark, d, "events").select(F.col("event_type").alias("kind"), F.col("event_id").alias("name"), F.col("ts").alias("modified"))
    return health.keep_newest(files, 40).withColumn("nth", F.col("nth").cast("long"))


@query("""
SELECT age, pending, status, CASE WHEN age IS NULL OR age > 50 THEN 'RED' WHEN age > 28 OR coalesce(pending, 0) > 0 OR (status <> '' AND NOT regexp_matches(status, '(?i)success|ok')) THEN 'YELLOW' ELSE 'GREEN' END AS verdict
FROM (VALUES (NULL::DOUBLE), (1.0), (28.0), (28.1), (50.0), (50.1)) a(age), (VALUES (NULL::INTEGER), (0), (2)) p(pending), (VALUES (NULL::VARCHAR), (''), ('success'), ('FAILED'), ('broken')) s(status)""")
def health_verdict(spark, d):
    rows = [(a, p, s) for a in (None, 1.0, 28.0, 28.1, 50.0, 50.1) for p in (None, 0, 2) for s in (None, "", "success", "FAILED", "broken")]
    cases = spark.createDataFrame(rows, "age double, pending int, status string")
    return cases.withColumn("verdict", health.verdict(F.col("age"), F.col("pending"), F.col("status"), F.lit(True)))


@query(f"SELECT doc_id, {sql_fingerprint('text')} AS fingerprint, lang || '-' || doc_id AS slug, 'Title ' || doc_id AS title FROM documents WHERE (lang || '-' || doc_id) LIKE '%n-1%'")
def frontmatter_parse(spark, d):
    from ..sources.proposals import parse_proposals, select_proposals

    k = F.col("doc_id").cast("string")
    raw = F.concat(F.lit("---\nfingerprint: "), C.fingerprint(F.col("text")), F.lit("\nslug:  "), F.concat_ws("-", "lang", k), F.lit(" \ntarget: x\nslug: later\n---\n# Title "), k, F.lit("\nbody\n"))
    docs = written(T.table(spark, d, "documents").select("doc_id", F.concat(F.lit("2024-01-01-"), k, F.lit(".md")).alias("name"), raw.alias("text")))  # else made anew for the filter and each field
    return select_proposals(parse_proposals(docs), slug="N-1").select("doc_id", "fingerprint", "slug", "title")


@query(_order_sql("SELECT bucket AS section, count(*) AS n_claims, count(DISTINCT skill) AS n_skills, max(importance) AS top_importance FROM wo GROUP BY bucket"))
def journal_summary(spark, d):
    return health.journal_summary(_order(spark, d))


_REDACTED = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+', '[email]', 'g'),
 '(?i)(password|passwd|token|secret|api_key)=[^\\s]+', '\\1=[secret]', 'g'), 'AKIA[0-9A-Z]{{16}}', '[key]', 'g'), '\\+[0-9][ ().0-9-]{{8,}}[0-9]', '[phone]', 'g'), '\\b[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}\\b', '[ip]', 'g'), '\\b[0-9]{{14,19}}\\b', '[card]', 'g')"""


@query(f"""
WITH r AS (SELECT doc_id, text, {_REDACTED.format("trim(coalesce(text, ''))")} AS claim FROM documents),
h AS (SELECT doc_id, len(claim) AS n, CASE WHEN len(claim) < 40 OR regexp_matches(text, '{classify.DROP_RULE}') THEN 'drop' WHEN regexp_matches(text, '{classify.SHORT_RULE}') THEN 'short' WHEN regexp_matches(text, '{classify.LONG_RULE}') THEN 'long' END AS rule FROM r)
SELECT doc_id, coalesce(rule, CASE WHEN n >= 2000 THEN 'long' ELSE 'drop' END) AS horizon, CASE WHEN n >= 4000 THEN 'high' WHEN n >= 400 THEN 'medium' ELSE 'low' END AS confidence,
 least(10, trunc(1 + floor(log2(1 + n)) / 2 + CASE WHEN rule = 'long' THEN 2 ELSE 0 END))::INTEGER AS importance FROM h""")
def classify_rules(spark, d):
    texts = T.table(spark, d, "documents").select(F.col("doc_id").alias("ord"), "text", F.col("source").alias("origin"))
    return classify.classify_rules(texts).select(F.col("ord").alias("doc_id"), "horizon", "confidence", "importance")


@query(f"SELECT doc_id, {_REDACTED.format('text')} AS redacted FROM documents")
def redact_texts(spark, d):
    return T.table(spark, d, "documents").select("doc_id", C.redact(F.col("text")).alias("redacted"))


@query("SELECT page_id, url FROM pages WHERE NOT (url LIKE '%/1%' OR contains(lower(url), 'site3') OR regexp_matches(url, '^.*[^0-9a-m]$'))")
def repo_exclude_filter(spark, d):
    return harvest.exclude_repositories(T.table(spark, d, "pages").select("page_id", "url"), ["*/1*", "SITE3", "*[!0-9a-m]"], "url")


@query(f"SELECT {sql_fingerprint('text')} AS fingerprint, count(*) AS claims, count(*) FILTER (len(trim(text)) > 0) AS texts FROM benchmark GROUP BY 1")
def fingerprint_collisions(spark, d):
    """How many claims share each fingerprint, those of nothing but other letters included."""
    fp = C.fingerprint(F.col("text"))
    return T.table(spark, d, "benchmark").groupBy(fp.alias("fingerprint")).agg(F.count(F.lit(1)).alias("claims"), F.count_if(F.length(F.trim("text")) > 0).alias("texts"))


from . import catalog_files, catalog_runs, catalog_streams  # noqa: E402, F401  their queries are put in with these
