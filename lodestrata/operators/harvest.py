"""What happened in a window: sessions with their turns, commits, notes, and their figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clip, clipped, glob_regex, iso_utc, parse_iso, strip, text

DEFAULT_HOURS, MAX_HOURS = 30, 72
USER_CHARS, ASSISTANT_CHARS, FILES, DIGEST_COMMITS, HASH = 4000, 1600, 40, 20, 12
#: Characters between commits and between the fields of a commit's header.
RECORD, FIELD = "\u001e", "\u001f"


def window_hours(elapsed: Column, override: Column | None = None, default: int = DEFAULT_HOURS, most: int = MAX_HOURS) -> Column:
    """Hours to look back. An override that isn't zero or null is cut to whole hours and to `most`; else an hour more than has
    elapsed since the last run, between default and most; without a last run, default."""
    usual = F.when(elapsed.isNull(), float(default)).otherwise(F.greatest(F.lit(float(default)), F.least(elapsed + 1, F.lit(float(most)))))
    if override is None:
        return usual
    return F.when(F.coalesce(override, F.lit(0)) != 0, F.least(override.cast("long"), F.lit(most)).cast("double")).otherwise(usual)


def window_start(as_of: Column, hours: Column) -> Column:
    return F.timestamp_seconds(F.unix_micros(as_of) / 1e6 - hours * 3600)


def run_context(as_of: Column, last_run: Column, override: Column | None = None, default: int = DEFAULT_HOURS, most: int = MAX_HOURS) -> dict[str, Column]:
    """since_utc and window_hours (of two decimals) of a run at as_of, given the ISO text of the last run; a null or malformed one, or one
    without a zone, is no last run."""
    known = F.when(last_run.rlike("(Z|[+-][0-9]{2}:?[0-9]{2})$"), parse_iso(last_run))
    hours = window_hours((F.unix_micros(as_of) - F.unix_micros(known)) / 3.6e9, override, default, most)
    return {"since_utc": iso_utc(window_start(as_of, hours)), "window_hours": F.bround(hours, 2)}


def in_window(rows: DataFrame, since: str, column: str = "updated_at") -> DataFrame:
    """Rows later than since; both are ISO texts and are compared as such."""
    return rows.where(F.col(column) > since)


def exclude_folders(sessions: DataFrame, parts: list[str]) -> DataFrame:
    """Sessions whose folder has none of parts in it, in whatever case; those without a folder stay."""
    folder = F.lower(text(F.col("cwd")))
    for part in parts:
        sessions = sessions.where(~folder.contains(part.lower()))
    return sessions


def exclude_repositories(paths: DataFrame, patterns: list[str], column: str = "path") -> DataFrame:
    """Paths that no shell pattern fits as a whole, and that have none of them in it as plain text, in whatever case."""
    for pattern in patterns:
        path = text(F.col(column))
        paths = paths.where(~(path.rlike(glob_regex(pattern)) | F.lower(path).contains(pattern.lower())))
    return paths


def cut_turns(turns: DataFrame, user_chars: int = USER_CHARS, assistant_chars: int = ASSISTANT_CHARS) -> DataFrame:
    """session_id, turn_index, user_text, assistant_text cut to their lengths, and whether the latter was."""
    return turns.select(
        "session_id", "turn_index", clip(F.col("user_text"), user_chars).alias("user_text"), clip(F.col("assistant_text"), assistant_chars).alias("assistant_text"),
        clipped(F.col("assistant_text"), assistant_chars).alias("assistant_truncated"),
    )


def pair_turns(messages: DataFrame) -> DataFrame:
    """One turn for each user message of (conv_id, turn, role, text), with the reply if that is what comes next."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    reply = F.when(F.lead("role").over(order) == "assistant", F.lead("text").over(order))
    return messages.withColumn("reply", reply).where("role = 'user'").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("turn_index"), F.col("text").alias("user_text"), F.col("reply").alias("assistant_text"))


def harvest_sessions(sessions: DataFrame, turns: DataFrame, since: str, excluded: list[str] = (), skip_empty: bool = True) -> DataFrame:
    """Sessions in the window with n_turns, n_truncated, user_chars and assistant_chars of their cut turns.

    The window and the folders are filtered before the join, and turns are cut before anything is shuffled."""
    found = exclude_folders(in_window(sessions, since), list(excluded))
    said = cut_turns(turns).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n_turns"), F.count_if("assistant_truncated").alias("n_truncated"), F.sum(F.length("user_text")).alias("user_chars"), F.sum(F.length("assistant_text")).alias("assistant_chars")
    )
    joined = found.join(said, found.id == said.session_id, "inner" if skip_empty else "left").drop("session_id")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_turns", "n_truncated", "user_chars", "assistant_chars")})


def newest_sessions(sessions: DataFrame) -> DataFrame:
    """Sessions by falling time of their last change, equals by id."""
    return sessions.orderBy(F.desc("updated_at"), "id")


def with_turns(sessions: DataFrame, turns: DataFrame, skip_empty: bool = True) -> DataFrame:
    """sessions with their cut turns as an array in order of turn_index; those without turns are left out, or have an empty one."""
    cut = cut_turns(turns)
    value = F.struct("turn_index", "user_text", "assistant_text", "assistant_truncated")
    out = attach(sessions, cut, "turns", value)
    return out.where(F.size("turns") > 0) if skip_empty else out


def attach(sessions: DataFrame, rows: DataFrame, name: str, value: Column) -> DataFrame:
    """sessions with an array of rows' values in order, empty where there are none; rows are gathered before the join."""
    gathered = rows.groupBy("session_id").agg(F.array_sort(F.collect_list(value)).alias(name))
    joined = sessions.join(gathered, sessions.id == gathered.session_id, "left").drop("session_id")
    kind = gathered.schema[name].dataType
    return joined.withColumn(name, F.coalesce(name, F.array().cast(kind)))


def parse_commits(records: DataFrame, column: str = "raw") -> DataFrame:
    """repo, hash (whole), author, email, date, subject, files (FILES at most) of texts of commits: RECORD before each, FIELD between
    its five header fields, then a line for each file. Records with fewer fields are left out."""
    each = records.select("repo", F.explode(F.split(column, RECORD)).alias("record"))
    header = F.split(F.substring_index("record", "\n", 1), FIELD)
    body = F.when(F.contains("record", F.lit("\n")), F.expr("substring(record, instr(record, '\n') + 1)")).otherwise("")
    files = F.filter(F.transform(F.split(body, "\n"), lambda f: F.trim(f)), lambda f: f != "")
    split = each.select("repo", header.alias("h"), files.alias("files")).where(F.size("h") >= 5)
    fields = [F.trim(F.col("h")[k]) for k in range(5)]
    return split.select("repo", fields[0].alias("hash"), *[x.alias(n) for x, n in zip(fields[1:], ("author", "email", "date", "subject"), strict=True)], F.slice("files", 1, FILES).alias("files"))


def by_author(commits: DataFrame, patterns: list[str]) -> DataFrame:
    """Commits whose "name <email>" one of the patterns is found in; all of them without patterns."""
    who = F.format_string("%s <%s>", "author", "email")
    return commits.where(who.rlike("|".join(f"(?:{p})" for p in patterns))) if patterns else commits


def authored(commits: DataFrame, patterns: list[str], since: str | None = None) -> DataFrame:
    """by_author, and of these no merges (more than one of parents, where there is such a column) and none dated before since."""
    found = by_author(commits, patterns)
    found = found.where(F.coalesce(F.size("parents"), F.lit(0)) < 2) if "parents" in commits.columns else found
    return found.where(parse_iso(F.col("date")) >= parse_iso(F.lit(since))) if since else found


def distinct_commits(commits: DataFrame) -> DataFrame:
    """Each repository's commits once by their whole hash, however many passes have found them; the row of the first text of date counts,
    and the hash is cut to HASH characters then."""
    found = commits.groupBy("repo", "hash").agg(F.min("date").alias("date"), F.min_by("subject", F.struct("date", "subject")).alias("subject"))
    return found.withColumn("hash", F.left("hash", F.lit(HASH)))


def newest_commits(commits: DataFrame, n: int = DIGEST_COMMITS) -> DataFrame:
    """The first n commits of each repository by falling date text, with their place."""
    order = Window.partitionBy("repo").orderBy(F.desc("date"), "hash")
    return commits.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n)


def inbox_body(c: Column, marker: str) -> Column:
    """What follows the first marker, or all where there is none; trimmed."""
    at = F.instr(c, F.lit(marker))
    return strip(F.when(at > 0, F.substring(c, at + len(marker), F.length(c))).otherwise(text(c)))


def harvest_stats(sessions: DataFrame, commits: DataFrame, inbox: DataFrame) -> DataFrame:
    """sessions, git_repos, git_commits, inbox_chars in one row."""
    one = sessions.agg(F.count(F.lit(1)).alias("sessions"))
    two = commits.agg(F.count_distinct("repo").alias("git_repos"), F.count(F.lit(1)).alias("git_commits"))
    three = inbox.agg(F.coalesce(F.sum(F.length("body")), F.lit(0)).alias("inbox_chars"))
    return one.crossJoin(two).crossJoin(three)  # of three single rows


def digest_lines(sessions: DataFrame, commits: DataFrame) -> DataFrame:
    """ord, line: a summary in Markdown; a line for each session, a heading and DIGEST_COMMITS lines at most for each repository."""
    label = F.format_string("- `%s` | repo=%s branch=%s | %s | turns=%d", F.left("id", F.lit(8)), "repository", "branch", F.coalesce(F.when(F.col("summary") != "", F.col("summary")), F.lit("(no summary)")), "n_turns")
    said = sessions.select(F.struct(F.lit(1).alias("part"), F.lit("").alias("of"), F.col("id").cast("string").alias("at")).alias("ord"), label.alias("line"))
    heads = commits.groupBy("repo").agg(F.count(F.lit(1)).alias("n")).select(F.struct(F.lit(2), "repo", F.lit("")).alias("ord"), F.format_string("### %s (%d)", "repo", "n").alias("line"))
    line = F.format_string("- `%s` %s  _(%s)_", F.left("hash", F.lit(8)), "subject", F.left("date", F.lit(10)))
    each = newest_commits(commits).select(F.struct(F.lit(2), "repo", F.format_string("%03d", "nth")).alias("ord"), line.alias("line"))
    return said.union(heads).union(each).orderBy("ord")
