"""The pipeline's inputs as derived from the driver's tables, and the same derivations in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import ACTIVE_WORK, REVIEW, fingerprint
from ..operators.harvest import pair_turns

SKILLS = ["skill-a", "skill-b", "skill-c"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files, be it one file or a folder of them."""
    schema = table(spark, sf_dir, name).schema
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    files = spark.readStream.schema(schema)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return files.parquet(f"{sf_dir}/{name}.parquet")
    return files.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim for each document; labels and the id decide on its horizon, confidence and target."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    k = F.col("doc_id")
    horizon = (
        F.when(F.col("toxic") == 1, "drop").when(F.col("quality") == 1, "long").when(F.col("quality") == 0, "short")
        .when(k % 4 == 0, "drop").when(k % 4 == 1, "short").otherwise("long")
    )
    confidence = F.when(k % 4 == 0, "low").when(k % 4 == 1, "medium").otherwise("high")
    target = (
        F.when(k % 7 == 0, REVIEW).when(k % 7 == 1, "unknown-topic").when(k % 7 == 2, ACTIVE_WORK).when(k % 7 == 3, "skill-a").when(k % 7 == 4, "skill-b").otherwise("skill-c")
    )
    return docs.join(labels, "doc_id", "left").select(
        k.alias("ord"), F.col("text").alias("claim"), F.col("lang").alias("domain"), horizon.alias("horizon"), (1 + (k * 7) % 10).cast("int").alias("importance"), confidence.alias("confidence"),
        target.alias("target"), F.lit(None).cast("string").alias("status"), "source", F.concat(F.lit("doc-"), k.cast("string")).alias("evidence"), F.lit(None).cast("string").alias("notes"),
        fingerprint(F.col("text")).alias("fingerprint"),
    )


def rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("doc_id % 11 = 0").select(fingerprint(F.col("text")).alias("fingerprint")).distinct()


def sightings(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """A sighting for each event, of the table or of those given."""
    events = table(spark, sf_dir, "events") if events is None else events
    k = F.floor(F.get_json_object("props", "$.k").cast("int") / 10)
    key = F.concat_ws("/", F.col("user_id").cast("string"), "event_type", k.cast("string"))
    return events.select(key.alias("key"), "ts", F.col("event_id").alias("ord"), "user_id", "value")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short claims of the registry as the log of sightings has them; one in five was applied."""
    from ..operators.ledger import fold_history

    n = F.conv(F.substring(F.sha1("key"), 1, 4), 16, 10).cast("long")
    return fold_history(sightings(spark, sf_dir)).select(
        F.substring(F.sha1("key"), 1, 16).alias("fingerprint"), F.col("key").alias("claim"), F.lit("events").alias("domain"), F.lit("short").alias("horizon"), (n % 11).cast("int").alias("importance"),
        F.when(n % 3 == 0, "skill-a").otherwise(ACTIVE_WORK).alias("target"), F.when(n % 5 == 0, "applied").otherwise("active").alias("status"), "hit_count", "distinct_days", "first_seen", "last_seen",
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last_turn"))
    k = F.col("conv_id")
    updated = F.date_format(F.timestamp_seconds(F.lit(1704067200) + k * 7 * 3600), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return conv.select(
        k.alias("id"), F.when(k % 4 == 0, F.lit(None)).otherwise(F.concat(F.lit("/work/"), F.when(k % 6 == 0, "Scratch").otherwise("app"), (k % 9).cast("string"))).alias("cwd"),
        F.concat(F.lit("repo"), (k % 7).cast("string")).alias("repository"), F.when(k % 5 != 0, F.concat(F.lit("b"), (k % 3).cast("string"))).alias("branch"),
        F.when(k % 2 == 0, F.concat(F.lit("session "), k.cast("string"))).alias("summary"), updated.alias("updated_at"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_turns(table(spark, sf_dir, "conversations"))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a commit, found once or twice."""
    events = table(spark, sf_dir, "events")
    one = events.select(
        F.concat(F.lit("repo"), (F.col("user_id") % 13).cast("string")).alias("repo"), F.substring(F.sha1(F.col("event_id").cast("string")), 1, 12).alias("hash"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("date"), F.concat("event_type", F.lit(" "), F.col("event_id").cast("string")).alias("subject"), "event_id",
    )
    return one.union(one.where("event_id % 3 = 0"))


def receipts(order: DataFrame) -> DataFrame:
    """Receipts for a work order: all of skill-a, most of skill-b, all of active work, and some of review that never completed."""
    bucket, first = F.col("bucket"), F.substring("fingerprint", 1, 1)
    name = F.when(bucket == "by_skill", "skill").when(bucket.isin("active_add", "active_remove"), "active-work").when(bucket == "review_queue", "review-queue")
    rows = order.select(name.alias("b"), "skill", "fingerprint", first.alias("first")).where("b IS NOT NULL AND NOT (coalesce(skill, '') = 'skill-b' AND first = '0') AND coalesce(skill, '') <> 'skill-c'")
    grouped = rows.groupBy(F.col("b").alias("bucket"), F.col("skill").alias("name"), "first").agg(F.collect_list("fingerprint").alias("fingerprints"))
    return grouped.withColumn("status", F.when(F.col("bucket") == "review-queue", "partial").otherwise("complete"))


_FP = "substr(sha1(regexp_replace(regexp_replace(lower(trim({0})), '\\s+', ' ', 'g'), '[^a-z0-9 ]', '', 'g')), 1, 16)"


def sql_fingerprint(column: str) -> str:
    return _FP.format(column)


SQL = {
    "claims": f"""claims AS (SELECT d.doc_id AS ord, d.text AS claim, d.lang AS domain,
  CASE WHEN l.toxic = 1 THEN 'drop' WHEN l.quality = 1 THEN 'long' WHEN l.quality = 0 THEN 'short' WHEN d.doc_id % 4 = 0 THEN 'drop' WHEN d.doc_id % 4 = 1 THEN 'short' ELSE 'long' END AS horizon,
  (1 + (d.doc_id * 7) % 10)::INTEGER AS importance, CASE WHEN d.doc_id % 4 = 0 THEN 'low' WHEN d.doc_id % 4 = 1 THEN 'medium' ELSE 'high' END AS confidence,
  CASE d.doc_id % 7 WHEN 0 THEN 'review-queue' WHEN 1 THEN 'unknown-topic' WHEN 2 THEN 'dream-active-work' WHEN 3 THEN 'skill-a' WHEN 4 THEN 'skill-b' ELSE 'skill-c' END AS target,
  d.source AS source, 'doc-' || d.doc_id AS evidence, {sql_fingerprint('d.text')} AS fingerprint FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""",
    "rejected": f"rejected AS (SELECT DISTINCT {sql_fingerprint('text')} AS fingerprint FROM documents WHERE doc_id % 11 = 0)",
    "merged": """m0 AS (SELECT *, count(*) OVER (PARTITION BY fingerprint) AS n_raw, row_number() OVER (PARTITION BY fingerprint ORDER BY importance DESC, ord) AS nth, min(ord) OVER (PARTITION BY fingerprint) AS first_ord FROM claims),
m1 AS (SELECT fingerprint, max(importance) AS top, min(CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS least, list_sort(list_distinct(list(horizon))) AS hs,
  substr(array_to_string(list_sort(list_distinct(list(evidence))), '; '), 1, 400) AS ev, CASE WHEN count(DISTINCT source) > 1 THEN 'mixed' ELSE min(source) END AS src FROM claims GROUP BY fingerprint),
m2 AS (SELECT *, CASE WHEN len(hs) = 1 THEN hs[1] WHEN hs = ['long', 'short'] THEN 'short' WHEN list_contains(hs, 'long') THEN 'long' WHEN list_contains(hs, 'short') THEN 'short' ELSE 'drop' END AS h FROM m1),
m3 AS (SELECT *, CASE WHEN len(hs) > 1 AND list_contains(hs, 'drop') AND h <> 'drop' THEN least(least, 2) ELSE least END AS r FROM m2),
merged AS (SELECT a.fingerprint, a.claim, a.domain, CASE WHEN n_raw > 1 THEN h ELSE horizon END AS horizon, CASE WHEN n_raw > 1 THEN top ELSE importance END AS importance,
  CASE WHEN n_raw = 1 THEN confidence WHEN r = 3 THEN 'high' WHEN r = 2 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN n_raw > 1 AND h = 'short' THEN 'dream-active-work' ELSE target END AS target,
  CASE WHEN n_raw > 1 THEN src ELSE source END AS source, CASE WHEN n_raw > 1 THEN ev ELSE evidence END AS evidence, n_raw, first_ord FROM m0 a JOIN m3 b ON a.fingerprint = b.fingerprint WHERE nth = 1)""",
    "sightings": "sightings AS (SELECT user_id || '/' || event_type || '/' || (json_extract_string(props, '$.k')::INTEGER // 10) AS key, ts, event_id AS ord, user_id, value FROM events)",
    "items": """fold AS (SELECT key, count(*) AS hit_count, count(DISTINCT ts::DATE) AS distinct_days, min(ts) AS first_seen, max(ts) AS last_seen FROM sightings GROUP BY key),
items AS (SELECT substr(sha1(key), 1, 16) AS fingerprint, key AS claim, 'events' AS domain, 'short' AS horizon, (n % 11)::INTEGER AS importance, CASE WHEN n % 3 = 0 THEN 'skill-a' ELSE 'dream-active-work' END AS target,
  CASE WHEN n % 5 = 0 THEN 'applied' ELSE 'active' END AS status, hit_count, distinct_days, first_seen, last_seen FROM (SELECT *, ('0x' || substr(sha1(key), 1, 4))::BIGINT AS n FROM fold))""",
    "sessions": """sessions AS (SELECT conv_id AS id, CASE WHEN conv_id % 4 <> 0 THEN '/work/' || CASE WHEN conv_id % 6 = 0 THEN 'Scratch' ELSE 'app' END || (conv_id % 9) END AS cwd, 'repo' || (conv_id % 7) AS repository,
  CASE WHEN conv_id % 5 <> 0 THEN 'b' || (conv_id % 3) END AS branch, CASE WHEN conv_id % 2 = 0 THEN 'session ' || conv_id END AS summary,
  strftime(make_timestamp((1704067200 + conv_id * 7 * 3600) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS updated_at FROM (SELECT DISTINCT conv_id FROM conversations))""",
    "turns": """turns AS (SELECT conv_id AS session_id, turn AS turn_index, text AS user_text, CASE WHEN next_role = 'assistant' THEN next_text END AS assistant_text FROM
  (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user')""",
    "commits": """c1 AS (SELECT 'repo' || (user_id % 13) AS repo, substr(sha1(event_id::VARCHAR), 1, 12) AS hash, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS date, event_type || ' ' || event_id AS subject, event_id FROM events),
commits AS (SELECT * FROM c1 UNION ALL SELECT * FROM c1 WHERE event_id % 3 = 0)""",
    "plan": """plan AS (SELECT c.*, r.fingerprint IS NOT NULL AS rejected_denied, CASE WHEN r.fingerprint IS NOT NULL OR c.horizon = 'drop' THEN 'drop' WHEN c.horizon = 'short' OR c.target = 'dream-active-work' THEN 'active_add'
  WHEN c.target = 'review-queue' THEN 'review_queue' WHEN c.horizon = 'long' AND c.confidence = 'high' AND c.target IN ('skill-a', 'skill-b', 'skill-c') THEN 'by_skill' ELSE 'review_queue' END AS bucket FROM merged c LEFT JOIN rejected r ON c.fingerprint = r.fingerprint),
routed AS (SELECT *, CASE WHEN bucket = 'by_skill' THEN target END AS skill, bucket = 'review_queue' AND target NOT IN ('review-queue', 'skill-a', 'skill-b', 'skill-c') AND importance >= 7 AS new_skill FROM plan)""",
    "tokens": """tok AS (SELECT s.*, len(coalesce(s.summary, '')) // 4 + coalesce(t.said, 0) AS est_tokens, s.repository || '@@' || coalesce(s.branch, '') AS thread
  FROM sessions s LEFT JOIN (SELECT session_id, sum(len(user_text) // 4 + len(coalesce(assistant_text, '')) // 4) AS said FROM turns GROUP BY 1) t ON s.id = t.session_id)""",
    "shards": """g AS (SELECT thread, sum(est_tokens)::BIGINT AS tokens, count(*) AS n_sessions FROM tok GROUP BY thread),
o AS (SELECT *, row_number() OVER (ORDER BY tokens DESC, thread) AS k FROM g),
n AS (SELECT greatest(1, least(6, ceil(sum(tokens) / 12000.0), count(*)))::INTEGER AS n FROM g),
lpt AS (SELECT 0::BIGINT AS k, list_transform(range(n), lambda x : 0::BIGINT) AS loads, -1 AS shard_id FROM n UNION ALL
  SELECT o.k, list_transform(l.loads, lambda x, i : CASE WHEN i = list_position(l.loads, list_min(l.loads)) THEN x + o.tokens ELSE x END), (list_position(l.loads, list_min(l.loads)) - 1)::INTEGER FROM lpt l JOIN o ON o.k = l.k + 1),
assigned AS (SELECT o.thread, o.tokens, o.n_sessions, lpt.shard_id FROM lpt JOIN o ON lpt.k = o.k)""",
}
#: What each derivation builds on, in order.
_NEEDS = {"merged": ["claims"], "plan": ["claims", "merged", "rejected"], "items": ["sightings"], "tokens": ["sessions", "turns"], "shards": ["sessions", "turns", "tokens"]}


def with_sql(names: str, select: str) -> str:
    """select after the derivations it names, each with what it builds on."""
    wanted: list[str] = []
    for name in names.split():
        wanted += [x for x in (*_NEEDS.get(name, []), name) if x not in wanted]
    return "WITH RECURSIVE " + ",\n".join(SQL[x] for x in wanted) + "\n" + select
