"""More queries of the catalog: what a run does around merging and routing, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import classify, harvest, health, ledger, merge, routing
from ..operators.written import written
from ..sources import files, sinks
from ..sources import tables as T
from ..sources.tables import sql_fingerprint, with_sql
from . import catalog, status
from .catalog import ORACLES, _merged, _order, _order_sql, _routed, query

AS_OF = "2024-01-31T12:00:00Z"
#: Rows of the reports that show what comes first.
TOP = 50


@query("""WITH c AS (SELECT doc_id, 'claims-' || (doc_id % 7) || '.json' AS file FROM documents), f AS (SELECT file, max(doc_id) + 1 AS places FROM c GROUP BY file)
SELECT doc_id, ((SELECT coalesce(sum(places), 0) FROM f WHERE f.file < c.file) + doc_id)::BIGINT AS ord FROM c""")
def claims_numbered(spark, d):
    """Documents as the claims of seven files, at the places that their ids are."""
    k = F.col("doc_id")
    file = F.concat(F.lit("claims-"), (k % 7).cast("string"), F.lit(".json"))
    return files.numbered(T.table(spark, d, "documents").select(F.struct(file.alias("file"), k.alias("pos")).alias("ord"), "doc_id")).select("doc_id", "ord")


@query(f"SELECT doc_id, {sql_fingerprint('text')} AS fingerprint FROM documents WHERE doc_id % 5 <> 0 AND length(trim(text)) > 0")
def blank_claims(spark, d):
    claim = F.when(F.col("doc_id") % 5 == 0, " \t\n ").otherwise(F.col("text"))
    return merge.with_fingerprints(T.table(spark, d, "documents").select("doc_id", claim.alias("claim"))).select("doc_id", "fingerprint")


@query("""SELECT last_run, override, strftime(make_timestamp(1704844800000000 - (h * 3600000000)::BIGINT), '%Y-%m-%dT%H:%M:%SZ') AS since_utc, round(h, 2) AS window_hours FROM
(SELECT last_run, override, CASE WHEN coalesce(override, 0) <> 0 THEN least(trunc(override), 72)::DOUBLE WHEN elapsed IS NULL THEN 30.0::DOUBLE ELSE greatest(30.0::DOUBLE, least(elapsed + 1, 72.0::DOUBLE)) END AS h FROM
(VALUES (NULL::VARCHAR, NULL::DOUBLE), ('garbage', NULL), ('2024-01-09T12:30:00', NULL), ('2024-01-08T01:20:00Z', 46 + 40 / 60.0::DOUBLE), ('2024-01-09T23:00:00+00:00', 1), ('2024-01-01T00:00:00Z', 216)) l(last_run, elapsed), (VALUES (NULL::DOUBLE), (0.0), (5.9), (100.0)) o(override))""")
def window_context(spark, d):
    last = spark.createDataFrame([(x,) for x in (None, "garbage", "2024-01-09T12:30:00", "2024-01-08T01:20:00Z", "2024-01-09T23:00:00+00:00", "2024-01-01T00:00:00Z")], "last_run string")
    cases = last.crossJoin(spark.createDataFrame([(None,), (0.0,), (5.9,), (100.0,)], "override double"))  # 24 rows
    return cases.withColumns(harvest.run_context(F.to_timestamp(F.lit("2024-01-10T00:00:00Z")), F.col("last_run"), F.col("override")))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, epoch_us(date_trunc('second', ts))::BIGINT AS micros FROM events")
def iso_times(spark, d):
    iso = C.iso_utc(F.col("ts").cast("timestamp"))
    return T.table(spark, d, "events").select("event_id", iso.alias("iso"), F.unix_micros(C.parse_iso(iso)).alias("micros"))


@query(r"""SELECT repository, branch, cwd, CASE WHEN r <> '' OR b <> '' THEN r || '@@' || b WHEN c <> '' THEN 'cwd::' || c ELSE 'misc::' END AS thread, CASE WHEN b <> '' THEN b WHEN r <> '' THEN r ELSE '(none)' END AS label FROM
(SELECT *, trim(coalesce(repository, ''), chr(9) || chr(10) || ' ' || chr(160)) AS r, trim(coalesce(branch, ''), chr(9) || chr(10) || ' ' || chr(160)) AS b, trim(coalesce(cwd, ''), chr(9) || chr(10) || ' ' || chr(160)) AS c FROM
 (VALUES (NULL::VARCHAR), (''), (chr(9) || 'repo' || chr(160)), (' ')) x(repository), (VALUES (NULL::VARCHAR), (chr(10)), ('b 1' || chr(10))) y(branch), (VALUES (NULL::VARCHAR), (chr(9)), (' /w/app')) z(cwd))""")
def thread_keys(spark, d):
    of = lambda name, values: spark.createDataFrame([(x,) for x in values], f"{name} string")
    cases = of("repository", (None, "", "\trepo ", " ")).crossJoin(of("branch", (None, "\n", "b 1\n"))).crossJoin(of("cwd", (None, "\t", " /w/app")))  # 36 rows
    return cases.withColumns({"thread": C.thread_key(F.col("repository"), F.col("branch"), F.col("cwd")), "label": C.branch_label(F.col("branch"), F.col("repository"))})


@query(with_sql("sessions", f"SELECT id, updated_at, repository FROM sessions ORDER BY updated_at DESC, id LIMIT {TOP}"))
def sessions_newest(spark, d):
    return harvest.newest_sessions(T.sessions(spark, d)).select("id", "updated_at", "repository").limit(TOP)


@query(with_sql("sessions turns", "SELECT id, string_agg(turn_index::VARCHAR, ',' ORDER BY turn_index) AS turns, count(*) AS n_turns, sum(len(left(user_text, 4000)))::BIGINT AS chars FROM sessions JOIN turns ON id = session_id GROUP BY id"))
def session_turns(spark, d):
    found = harvest.with_turns(T.sessions(spark, d), T.turns(spark, d))
    chars = F.aggregate("turns", F.lit(0).cast("long"), lambda total, x: total + F.length(x["user_text"]))
    return found.select("id", F.array_join(F.transform("turns", lambda x: x["turn_index"].cast("string")), ",").alias("turns"), F.size("turns").cast("long").alias("n_turns"), chars.alias("chars"))


@query("SELECT 'repo' || (user_id % 13) AS repo, event_id FROM events WHERE user_id % 5 IN (1, 3) AND event_id % 4 <> 0 AND ts >= TIMESTAMP '2024-01-12 06:00:00'")
def authored_commits(spark, d):
    k, user = F.col("event_id"), (F.col("user_id") % 5).cast("string")
    parents = F.when(k % 4 == 0, F.array(F.lit("a"), F.lit("b"))).when(k % 4 == 1, F.array(F.lit("a")))
    commits = T.table(spark, d, "events").select(
        F.concat(F.lit("repo"), (F.col("user_id") % 13).cast("string")).alias("repo"), "event_id", F.concat(F.lit("User "), user).alias("author"), F.concat(F.lit("u"), user, F.lit("@example.com")).alias("email"),
        C.iso_utc(F.col("ts").cast("timestamp")).alias("date"), parents.alias("parents"),
    )
    return harvest.authored(commits, ["User 1", "u3@example"], "2024-01-12T06:00:00Z").select("repo", "event_id")


@query(with_sql("merged", f"SELECT fingerprint, importance, first_ord FROM merged ORDER BY importance DESC, first_ord LIMIT {TOP}"))
def candidates_ranked(spark, d):
    return merge.ranked(_merged(spark, d)).select("fingerprint", "importance", "first_ord").limit(TOP)


@query(with_sql("items", f"SELECT fingerprint, hit_count FROM items WHERE hit_count >= 3 AND distinct_days >= 3 ORDER BY hit_count DESC, fingerprint LIMIT {TOP}"))
def promotions_by_hits(spark, d):
    return ledger.promotions_by_hits(T.items(spark, d)).select("fingerprint", "hit_count").limit(TOP)


@query(with_sql("items", f"SELECT fingerprint, last_seen FROM items WHERE status = 'active' AND last_seen < (SELECT max(ts) FROM events) - INTERVAL 14 DAY ORDER BY last_seen, fingerprint LIMIT {TOP}"))
def decays_by_age(spark, d):
    as_of = T.table(spark, d, "events").agg(F.max("ts").alias("as_of"))
    return ledger.decays_by_age(T.items(spark, d).crossJoin(as_of), F.col("as_of")).select("fingerprint", "last_seen").limit(TOP)  # one row besides


@query(f"SELECT count(*) FILTER (change = 'inserted') AS inserted, count(*) FILTER (change = 'updated') AS updated FROM ({ORACLES['ledger_upsert_batch']})")
def upsert_changes(spark, d):
    return ledger.changes(catalog.ledger_upsert_batch(spark, d))


@query("SELECT * FROM (VALUES ('a', 'x/a.md'), ('b', 'x/b.md'), ('dream', 'index.md'), ('dream-active-work', 'short.md')) v(name, path)")
def target_paths(spark, d):
    return routing.target_paths(spark, {"b": "x/b.md", "a": "x/a.md"}, "short.md", "index.md", "general")


_DONE = """, own AS (SELECT DISTINCT CASE bucket WHEN 'by_skill' THEN 'skill' WHEN 'review_queue' THEN 'review-queue' ELSE 'active-work' END AS of, skill AS name, fingerprint FROM wo WHERE bucket <> 'drop'),
got AS (SELECT DISTINCT of, name, fingerprint FROM own WHERE of <> 'review-queue' AND NOT (coalesce(name, '') = 'skill-b' AND substr(fingerprint, 1, 1) = '0') AND coalesce(name, '') <> 'skill-c'),
done AS (SELECT o.of, o.name FROM own o LEFT JOIN got g ON o.of = g.of AND o.name IS NOT DISTINCT FROM g.name AND o.fingerprint = g.fingerprint GROUP BY ALL HAVING count(*) = count(g.fingerprint))
"""


def _done_sql(select: str) -> str:
    return _order_sql("@").removesuffix("\n@") + _DONE + select


@query(_done_sql("""SELECT fingerprint, CASE WHEN skill IN (SELECT name FROM done WHERE of = 'skill') THEN 'applied' ELSE 'proposed' END AS status, CASE WHEN skill IN (SELECT name FROM done WHERE of = 'skill') THEN 1 ELSE 2 END AS ord FROM wo WHERE bucket = 'by_skill'
UNION ALL SELECT fingerprint, 'applied', 1 FROM wo WHERE bucket = 'active_add' AND EXISTS (SELECT 1 FROM done WHERE of = 'active-work') UNION ALL SELECT fingerprint, 'proposed', 2 FROM wo WHERE bucket = 'review_queue' AND EXISTS (SELECT 1 FROM done WHERE of = 'review-queue')
UNION ALL SELECT fingerprint, 'archived', 3 FROM wo WHERE bucket = 'active_remove' AND EXISTS (SELECT 1 FROM done WHERE of = 'active-work')"""))
def status_changes(spark, d):
    order = written(_order(spark, d).select("fingerprint", "bucket", "skill"))  # which nine branches read
    return sinks.status_changes(order, T.receipts(order))


@query(_order_sql("SELECT CASE bucket WHEN 'by_skill' THEN 'skill' ELSE 'active-work' END AS bucket, skill AS name, fingerprint FROM wo WHERE bucket IN ('by_skill', 'active_add')"))
def receipts_written(spark, d):
    made = sinks.receipts_of(_order(spark, d), ["by_skill", "active_add"], AS_OF)
    return made.where(f"status = 'complete' AND completed_utc = '{AS_OF}'").select("bucket", "name", F.explode("fingerprints").alias("fingerprint"))


@query(with_sql("plan", """SELECT '2024-02-01-' || left(regexp_replace(regexp_replace(lower(claim), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 40) || '-' || left(fingerprint, 6) || '.md' AS name, fingerprint, CASE WHEN new_skill THEN 'new-skill:' || target ELSE target END AS target
FROM routed WHERE bucket = 'review_queue' AND substr(fingerprint, 16, 1) NOT IN ('a', '3')"""))
def proposals_made(spark, d):
    routed = written(_routed(spark, d).where("bucket = 'review_queue'"))  # each claim's fingerprint is in it, and made once
    there = routed.where(F.substring("fingerprint", 16, 1).isin("a", "3")).select("fingerprint", F.lit("2024-02-01").alias("date")).distinct()
    made = sinks.proposals_of(routed, there, "2024-02-01")
    return made.select("name", "fingerprint", F.regexp_extract("text", r"(?m)^target: (.*)$", 1).alias("target"))


@query(_order_sql("""SELECT 'harvested 9, dropped ' || count(*) FILTER (bucket = 'drop') || ', active-work +' || count(*) FILTER (bucket = 'active_add') || '/-' || count(*) FILTER (bucket = 'active_remove') || ', skills edited ' || count(DISTINCT skill)
 || ', review-queue ' || count(*) FILTER (bucket = 'review_queue') AS line FROM wo UNION ALL SELECT '- ' || concat_ws(' ', bucket, skill) || ': ' || count(*) FROM wo GROUP BY bucket, skill"""))
def journal_lines(spark, d):
    order = _order(spark, d)
    return sinks.journal_lines(order, routing.totals(order), 9).select("line")


@query("""WITH j AS (SELECT max_by('j' || event_id, (ts, 'j' || event_id)) AS name, max(ts) AS at FROM events WHERE event_type = (SELECT min(event_type) FROM events)), p AS (SELECT count(*) AS n FROM events WHERE event_type = (SELECT max(event_type) FROM events)),
r AS (SELECT CASE WHEN day(max(ts)) % 7 = 0 THEN 'failed' ELSE 'success' END AS s FROM events), h AS (SELECT j.name, round(epoch(TIMESTAMP '2024-01-31 12:00:00' - j.at) / 3600.0, 1) AS age, p.n, r.s FROM j, p, r)
SELECT CASE WHEN age > 50 THEN 'RED' ELSE 'YELLOW' END AS verdict, age AS journal_age_h, name AS newest_journal, s AS last_run_status, n AS pending_review, CASE WHEN age > 50 THEN 1 ELSE 0 END::BIGINT AS n_issues,
 (1 + CASE WHEN age > 28 AND age <= 50 THEN 1 ELSE 0 END + CASE WHEN s = 'failed' THEN 1 ELSE 0 END)::BIGINT AS n_warnings FROM h""")
def health_report(spark, d):
    events = T.table(spark, d, "events")
    kinds = events.agg(F.min("event_type").alias("first"), F.max("event_type").alias("last"))
    listed = events.crossJoin(kinds).select(F.concat(F.lit("j"), F.col("event_id").cast("string")).alias("name"), F.col("ts").cast("timestamp").alias("modified"), "event_type", "first", "last")  # one row besides
    last = ledger.last_run(catalog._runs(spark, d)).select("status", F.lit(None).cast("string").alias("model"))
    found = status.problems(listed.where("event_type = first"), listed.where("event_type = last"), last, AS_OF, True)
    return found.select("verdict", "journal_age_h", "newest_journal", "last_run_status", "pending_review", F.size("issues").cast("long").alias("n_issues"), F.size("warnings").cast("long").alias("n_warnings"))


@query("SELECT event_id AS name FROM events WHERE ts >= TIMESTAMP '2024-01-24 12:00:00'")
def retention_age(spark, d):
    listed = T.table(spark, d, "events").select(F.col("event_id").alias("name"), F.col("ts").cast("timestamp").alias("modified"))
    return health.keep_recent(listed, F.to_timestamp(F.lit(AS_OF))).select("name")


@query("SELECT ord, horizon, claim, target FROM (SELECT doc_id AS ord, 'long' AS horizon, CASE WHEN doc_id % 3 > 0 THEN left(text, 30) END AS claim, 'review-queue' AS target FROM documents UNION ALL SELECT doc_id, 'short', lang, 'dream-active-work' FROM documents) WHERE claim IS NOT NULL")
def split_signal(spark, d):
    lesson = F.when(F.col("doc_id") % 3 > 0, F.left("text", F.lit(30)))
    return classify.split_signal(T.table(spark, d, "documents").select(F.col("doc_id").alias("ord"), lesson.alias("lesson"), F.col("lang").alias("specifics"))).select("ord", "horizon", "claim", "target")


@query("""SELECT j, m, r, p, coalesce(j AND m, false) AS success, coalesce(j AND m, false) AND NOT coalesce(r, false) AND NOT coalesce(p, false) AS advances FROM (VALUES (NULL::BOOLEAN), (true), (false)) a(j), (VALUES (NULL::BOOLEAN), (true), (false)) b(m),
(VALUES (NULL::BOOLEAN), (true), (false)) c(r), (VALUES (NULL::BOOLEAN), (true), (false)) e(p)""")
def run_success(spark, d):
    cases = spark.createDataFrame([(j, m, r, p) for j in (None, True, False) for m in (None, True, False) for r in (None, True, False) for p in (None, True, False)], "j boolean, m boolean, r boolean, p boolean")
    done = health.succeeded(F.col("j"), F.col("m"))
    return cases.withColumns({"success": done, "advances": health.advances_watermark(done, F.col("r"), F.col("p"))})


@query("""SELECT repository, path, chars FROM (SELECT 'repo' || (doc_id % 7) AS repository, '/w/repo' || (doc_id % 7) || '/docs/' || doc_id || '.md' AS path, least(len(text), 20000)::BIGINT AS chars,
 row_number() OVER (PARTITION BY doc_id % 7 ORDER BY '/w/repo' || (doc_id % 7) || '/docs/' || doc_id || '.md') AS nth FROM documents WHERE doc_id % 7 <> 5) WHERE nth <= 12""")
def repository_guides(spark, d):
    repo = F.concat(F.lit("repo"), (F.col("doc_id") % 7).cast("string"))
    guides = T.table(spark, d, "documents").select(F.concat(F.lit("/w/"), repo, F.lit("/docs/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "text")
    wanted = spark.createDataFrame([(f"repo{k}",) for k in range(7) if k != 5], "repository string")
    return sinks.repository_context(guides, wanted).select("repository", "path", F.length("text").cast("long").alias("chars"))


@query("SELECT doc_id::VARCHAR AS id, '2024-01-01' AS ts, lang AS text, 'docs' AS origin FROM documents UNION ALL SELECT item_id::VARCHAR, '2024-01-02', left(text, 20), 'bench' FROM benchmark")
def collected_sources(spark, d):
    read = lambda name, key, at, text: lambda s, c: T.table(s, c, name).select(F.col(key).cast("string").alias("id"), F.lit(at).alias("ts"), text.alias("text"), F.lit(1).alias("else"))
    return files.collect_sources(spark, {"docs": read("documents", "doc_id", "2024-01-01", F.col("lang")), "bench": read("benchmark", "item_id", "2024-01-02", F.left("text", F.lit(20)))}, d)
