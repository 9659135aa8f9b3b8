"""Queries of the catalog that run as streams, on tables that are kept from one run to the next, or on models and runs made of the tables; each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import iso_utc
from ..operators import harvest, health, latest, learned, ledger, routing, sharding
from ..operators.written import new_folder, written
from ..sources import sinks, store
from ..sources import tables as T
from ..sources.tables import with_sql
from ..streaming import keyed
from .catalog import query


@query(with_sql("items", "SELECT key, hit_count, distinct_days, first_seen, last_seen, last_seen < (SELECT max(ts) FROM sightings) - INTERVAL 14 DAY AS decayed FROM fold"))
def stream_registry(spark, d):
    """The log as a stream, folded into keyed state; what its timers have found to be decayed when the stream has ended."""
    seen = T.sightings(spark, d, T.stream(spark, d, "events")).select(F.col("key").alias("fingerprint"), "ts")
    place = new_folder(spark, "stream")
    keyed.append_changes(keyed.registry_changes(seen), f"{place}/changes", f"{place}/checkpoint").awaitTermination()
    state = keyed.registry_state(spark.read.schema(keyed.CHANGE).parquet(f"{place}/changes"))
    return state.select(F.col("fingerprint").alias("key"), "hit_count", "distinct_days", F.col("first_seen").cast("timestamp_ntz"), F.col("last_seen").cast("timestamp_ntz"), "decayed")


@query(with_sql("sightings", """, h AS (SELECT key, CASE WHEN ts < TIMESTAMP '2024-01-20' THEN 0 WHEN ts < TIMESTAMP '2024-01-20 01:00:00' THEN 1 ELSE 2 END AS part, count(*) AS hits, max(ts)::VARCHAR AS last FROM sightings WHERE ts < TIMESTAMP '2024-01-22' GROUP BY 1, 2)
SELECT key AS fingerprint, sum(hits)::BIGINT AS hit_count, count(*) AS distinct_days, max_by(last, part) AS claim, CASE max(part) WHEN 0 THEN '2024-01-19' WHEN 1 THEN '2024-01-20' ELSE '2024-01-21' END AS last_day FROM h GROUP BY 1""").replace("\n, h AS", ", h AS"))
def registry_in_buckets(spark, d):
    """The registry over three runs, of which the second is an hour and touches few buckets; each run's sightings of a claim count as one day."""
    seen, none = T.sightings(spark, d), F.lit(None).cast("string")
    table = store.items_table(spark, new_folder(spark, "registry"))
    borders = ["2024-01-01", "2024-01-20", "2024-01-20 01:00:00", "2024-01-22"]
    for first, last, day in zip(borders, borders[1:], ("2024-01-19", "2024-01-20", "2024-01-21"), strict=False):
        run = seen.where((F.col("ts") >= F.lit(first).cast("timestamp_ntz")) & (F.col("ts") < F.lit(last).cast("timestamp_ntz")))
        extra = {c: none for c in (*ledger.ATTRIBUTES, "status") if c not in ("claim", "importance")}
        batch = run.select(F.col("key").alias("fingerprint"), F.col("ts").cast("string").alias("claim"), F.lit(1).alias("importance"), F.struct("ts", "ord").alias("ord")).withColumns(extra)
        batch = written(batch)
        table.update(batch, lambda prior, batch=batch, day=day: ledger.upsert(prior, batch, F.lit(f"{day}T04:15:00Z"), F.lit(day)).drop("change"))
    return table.read().select("fingerprint", "hit_count", "distinct_days", "claim", "last_day")


@query("""WITH e AS (SELECT user_id % 200 || '/' || event_type AS id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS updated_at, event_id, ts + CASE WHEN event_id % 10 = 3 THEN INTERVAL 40 MINUTE ELSE INTERVAL 0 MINUTE END AS there FROM events)
SELECT id, max(updated_at) AS updated_at, max_by(event_id, updated_at || lpad(event_id::VARCHAR, 20, '0')) AS event_id FROM e WHERE there <= TIMESTAMP '2024-01-25' GROUP BY id""")
def late_readings(spark, d):
    """Sessions, each event a change of one, read by three runs. One in ten is written 40 minutes after the time that it bears; a run reads an hour of
    the run before again, and what it reads replaces older readings."""
    events = T.table(spark, d, "events").withColumn("there", F.col("ts") + F.when(F.col("event_id") % 10 == 3, F.make_dt_interval(mins=F.lit(40))).otherwise(F.make_dt_interval()))
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = events.select(F.concat_ws("/", (F.col("user_id") % 200).cast("string"), "event_type").alias("id"), iso.alias("updated_at"), "event_id", "ts", "there")
    table = store.BucketedTable(spark, new_folder(spark, "readings"), "id string, updated_at string, event_id long", "id")
    runs = ["2023-12-31", "2024-01-10 06:00:00", "2024-01-17 18:30:00", "2024-01-25"]
    time = lambda t: F.lit(t).cast("timestamp_ntz")
    for before, now in zip(runs, runs[1:], strict=False):
        read = rows.where((F.col("ts") > time(before) - F.make_dt_interval(hours=F.lit(1))) & (F.col("there") <= time(now)))
        table.update(read, lambda prior, read=read: latest.replace_older(prior, read, "id", ["updated_at", "event_id"]))
    return table.read()


@query("SELECT event_id, row_number() OVER (PARTITION BY CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id % 500 END ORDER BY event_type || lpad(event_id::VARCHAR, 12, '0')) AS nth FROM events")
def numbered_in_ranges(spark, d):
    """Places among events of one size, a third of which have the same."""
    name = F.concat("event_type", F.lpad(F.col("event_id").cast("string"), 12, "0"))
    rows = T.table(spark, d, "events").select("event_id", F.when(F.col("user_id") % 3 == 0, 0).otherwise(F.col("user_id") % 500).cast("long").alias("tokens"), name.alias("thread"))
    return sharding.number_in_ranges(rows, "tokens", "thread").select("event_id", "nth")


@query("""WITH n AS (SELECT DISTINCT left(lower(text), 1 + item_id % 5) AS repository FROM benchmark),
r AS (SELECT repository, url AS path, least(length(html), 20000)::BIGINT AS chars, row_number() OVER (PARTITION BY repository ORDER BY url) AS nth FROM n JOIN pages ON contains(url, repository))
SELECT repository, path, chars FROM r WHERE nth <= 12""")
def guides_by_containment(spark, d):
    """Beginnings of the benchmark's items, of one to five characters, as repositories, and the first pages whose url has them in it."""
    names = T.table(spark, d, "benchmark").select(F.expr("left(lower(text), cast(1 + item_id % 5 AS int))").alias("repository"))
    found = sinks.repository_context(T.table(spark, d, "pages").select(F.col("url").alias("path"), F.col("html").alias("text")), names)
    return found.select("repository", "path", F.length("text").cast("long").alias("chars"))


_HELD = "left(md5(doc_id::VARCHAR), 1) IN ('0', '1', '2')"
_WORDS = "unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+'))"


@query(f"""WITH t AS (SELECT doc_id, quality, {_WORDS} AS word FROM documents JOIN labels USING (doc_id) WHERE NOT {_HELD}),
n AS (SELECT count(*) FILTER (quality = 1) AS one, count(*) FILTER (quality = 0) AS none FROM documents JOIN labels USING (doc_id) WHERE NOT {_HELD}),
c AS (SELECT word, count(*) FILTER (quality = 1) AS one, count(*) FILTER (quality = 0) AS none FROM t GROUP BY 1), s AS (SELECT sum(one) AS one, sum(none) AS none, count(*) AS words FROM c),
w AS (SELECT word, ln((c.one + 1) / (s.one + s.words)) - ln((c.none + 1) / (s.none + s.words)) AS weight FROM c, s),
h AS (SELECT doc_id, text FROM documents JOIN labels USING (doc_id) WHERE {_HELD}), b AS (SELECT doc_id, word, count(*) AS times FROM (SELECT doc_id, {_WORDS} AS word FROM h) GROUP BY 1, 2),
x AS (SELECT doc_id, sum(times * weight) AS sum FROM b JOIN w USING (word) GROUP BY 1), r AS (SELECT doc_id, ln(n.one / n.none) + coalesce(sum, 0) AS score FROM h LEFT JOIN x USING (doc_id), n)
SELECT doc_id, round(score, 3) AS score, score >= 0 AS good FROM r""")
def learned_quality(spark, d):
    """Labelled documents that weren't learnt from, by the odds that words of the others give them."""
    rows = T.table(spark, d, "documents").join(T.table(spark, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    held = F.left(F.md5(F.col("doc_id").cast("string")), F.lit(1)).isin("0", "1", "2")
    found = learned.score(rows.where(held), learned.train(rows.where(~held)), "doc_id")
    return found.select("doc_id", F.round("score", 3).alias("score"), (F.col("score") >= 0).alias("good"))


@query("""SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k, (props::JSON ->> '$.k')::BIGINT >= 50 AS high, event_type AS first_tag, CASE WHEN user_id % 3 = 0 THEN value ELSE NULL END AS inner_value, CASE WHEN user_id % 2 = 0 THEN 'number' ELSE 'text' END AS kind FROM events""")
def variant_props(spark, d):
    """Nested values of columns that aren't known beforehand, taken out with their types; one is a number in some rows and a text in others."""
    events = T.table(spark, d, "events")
    inner = F.when(F.col("user_id") % 3 == 0, F.format_string('{"value": %s}', F.col("value").cast("string"))).otherwise("null")
    mixed = F.when(F.col("user_id") % 2 == 0, F.col("user_id").cast("string")).otherwise(F.concat(F.lit('"u'), F.col("user_id").cast("string"), F.lit('"')))
    row = F.parse_json(F.concat(F.lit('{"props": '), "props", F.lit(', "tags": ["'), "event_type", F.lit('", "x"], "inner": '), inner, F.lit(', "mixed": '), mixed, F.lit("}"))).alias("row")
    k = F.try_variant_get("row", "$.props.k", "bigint")
    kind = F.when(F.schema_of_variant(F.variant_get("row", "$.mixed", "variant")) == "STRING", "text").otherwise("number")
    return events.select("event_id", row).select("event_id", k.alias("k"), (k >= 50).alias("high"), F.variant_get("row", "$.tags[0]", "string").alias("first_tag"), F.try_variant_get("row", "$.inner.value", "double").alias("inner_value"), kind.alias("kind"))


@query("""WITH e AS (SELECT event_id, date_trunc('minute', ts) AS t, lag(date_trunc('minute', ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last, CASE WHEN event_id % 4 = 0 THEN event_id % 90 END AS override FROM events),
h AS (SELECT event_id, t, CASE WHEN coalesce(override, 0) <> 0 THEN least(override, 72)::DOUBLE WHEN last IS NULL THEN 30.0::DOUBLE ELSE greatest(30.0::DOUBLE, least((epoch_us(t) - epoch_us(last)) / 3600000000.0::DOUBLE + 1, 72.0::DOUBLE)) END AS h FROM e)
SELECT event_id, h AS hours, round(h, 2) AS window_hours FROM h""")
def windows_of_runs(spark, d):
    """Each event as a run of its user, at its minute: how far back it looks, given the run before and what one in four overrides."""
    minute = F.date_trunc("minute", F.col("ts").cast("timestamp"))
    runs = T.table(spark, d, "events").select("event_id", "user_id", "ts", minute.alias("as_of"), F.when(F.col("event_id") % 4 == 0, F.col("event_id") % 90).cast("double").alias("override"))
    before = F.lag("as_of").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    runs = runs.withColumn("last_run", iso_utc(before))
    about = harvest.run_context(F.col("as_of"), F.col("last_run"), F.col("override"))
    elapsed = (F.unix_micros("as_of") - F.unix_micros(F.to_timestamp("last_run"))) / 3.6e9
    return runs.select("event_id", harvest.window_hours(elapsed, F.col("override")).alias("hours"), about["window_hours"].alias("window_hours"))


@query("""WITH r AS (SELECT user_id, ts::DATE AS day, bool_or(CASE WHEN event_type = 'view' THEN true WHEN event_type = 'error' THEN NULL ELSE false END) AS journal, bool_or(CASE WHEN value >= 20 THEN true ELSE false END) AS marker,
 CASE WHEN user_id % 7 = 0 THEN true WHEN user_id % 7 < 5 THEN false END AS replay, CASE WHEN user_id % 5 = 0 THEN true WHEN user_id % 5 < 4 THEN false END AS propose FROM events GROUP BY 1, 2)
SELECT user_id, day::VARCHAR AS day, coalesce(journal AND marker, false) AS success, coalesce(journal AND marker, false) AND NOT coalesce(replay, false) AND NOT coalesce(propose, false) AS advances FROM r""")
def run_outcomes(spark, d):
    """A user's day as a run: what its events say of journal and marker, whether it was one, and whether it moved the watermark."""
    kind, user = F.col("event_type"), F.col("user_id")
    runs = T.table(spark, d, "events").groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(
        F.bool_or(F.when(kind == "view", True).when(kind == "error", None).otherwise(False)).alias("journal"), F.bool_or(F.when(F.col("value") >= 20, True).otherwise(False)).alias("marker"))
    some = lambda n: F.when(user % n == 0, True).when(user % n < n - 2 + (n == 5), False)
    success = health.succeeded(F.col("journal"), F.col("marker"))
    return runs.select("user_id", "day", success.alias("success"), health.advances_watermark(success, some(7), some(5)).alias("advances"))


@query(with_sql("claims", """SELECT ord AS doc_id, CASE target WHEN 'skill-a' THEN 'x/a.md' WHEN 'skill-b' THEN 'x/b.md' WHEN 'dream-active-work' THEN 'short.md' END AS path FROM claims"""))
def claims_with_paths(spark, d):
    """Where each claim goes: the path of its target, none where it has no place yet."""
    places = routing.target_paths(spark, {"skill-a": "x/a.md", "skill-b": "x/b.md"}, "short.md", "index.md")
    claims = T.claims(spark, d)
    return claims.join(F.broadcast(places), claims.target == places.name, "left").select(F.col("ord").alias("doc_id"), "path")  # a row for each skill
