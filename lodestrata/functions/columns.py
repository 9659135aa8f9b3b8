"""Scalar building blocks as Column expressions; all stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The targets with a meaning of their own, and the name of the index.
ACTIVE_WORK, REVIEW, INDEX = "dream-active-work", "review-queue", "dream"
#: White space as Unicode has it, and the four separators U+001C to U+001F. Written out, it is much faster than a Unicode class.
_BLANK = r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def given(c: Column) -> Column:
    """c, or null where it is an empty string."""
    return F.when(c != "", c)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{_BLANK}++|{_BLANK}++$", "")


def fingerprint(claim: Column) -> Column:
    """Sixteen hex digits of the sha1 of the claim, lower-cased, its white space collapsed and then all but [a-z0-9 ] deleted.
    Claims without any such character share one; a null claim has none."""
    collapsed = F.trim(F.regexp_replace(claim, rf"{_BLANK}++", " "))
    kept = F.regexp_replace(F.lower(collapsed), r"([a-z0-9 ]*+)(?:[^a-z0-9 ]++|\z)", "$1")  # from one stretch to the next: much faster than a search for what goes
    return F.substring(F.sha1(kept.cast("binary")), 1, 16)


def clip(c: Column, n: int) -> Column:
    return F.left(text(c), F.lit(n))


def clipped(c: Column, n: int) -> Column:
    return F.coalesce(F.length(c) > n, F.lit(False))


def token_estimate(c: Column) -> Column:
    """A quarter of the characters, rounded down for each text by itself."""
    return F.floor(F.length(text(c)) / 4).cast("long")


def thread_key(repository: Column, branch: Column, cwd: Column) -> Column:
    """Sessions of one repository and branch are a thread; else those of one folder; else all that are left. White space around names
    doesn't count."""
    repository, branch, cwd = (strip(text(c)) for c in (repository, branch, cwd))
    named = (repository != "") | (branch != "")
    return F.when(named, F.concat(repository, F.lit("@@"), branch)).when(cwd != "", F.concat(F.lit("cwd::"), cwd)).otherwise("misc::")


def branch_label(branch: Column, repository: Column) -> Column:
    return F.coalesce(given(strip(branch)), given(strip(repository)), F.lit("(none)"))


def confidence_rank(c: Column) -> Column:
    """3 for high, 2 for medium, 1 for low, none or any other."""
    return F.when(c == "high", 3).when(c == "medium", 2).otherwise(1)


def confidence_name(rank: Column) -> Column:
    return F.when(rank >= 3, "high").when(rank == 2, "medium").otherwise("low")


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_iso(c: Column) -> Column:
    """The timestamp of an ISO text, or null if it is malformed."""
    return F.try_to_timestamp(F.regexp_replace(c, "Z$", "+00:00"))


def glob_regex(pattern: str) -> str:
    """A shell pattern as a regular expression for the whole text: * any run, ? any character, [...] a set."""
    out, at = [], 0
    while at < len(pattern):
        c, at = pattern[at], at + 1
        close = pattern.find("]", at + 1) if c == "[" else -1
        if c in "*?":
            out.append(".*" if c == "*" else ".")
        elif close > 0:
            body = pattern[at:close].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body) + "]")
            at = close + 1
        else:
            out.append(re.escape(c))
    return "(?s)^" + "".join(out) + "$"


#: What must not stand in a claim, what stands there instead, and what a text must hold for the pattern to be tried.
REDACTIONS = (
    (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[email]", "@"),
    (r"(?i)(password|passwd|token|secret|api_key)=[^\s]+", "$1=[secret]", "="),
    (r"AKIA[0-9A-Z]{16}", "[key]", "AKIA"),
    (r"\+[0-9][ ().0-9-]{8,}[0-9]", "[phone]", "+"),
    (r"\b[0-9]{1,3}(\.[0-9]{1,3}){3}\b", "[ip]", "."),
    (r"\b[0-9]{14,19}\b", "[card]", ""),
)


def redact(c: Column) -> Column:
    """c without what REDACTIONS describe. An address is only looked for where one can begin, so that long runs take linear time."""
    for pattern, instead, sign in REDACTIONS:
        changed = F.regexp_replace(c, pattern, instead)
        c = F.when(F.contains(c, F.lit(sign)), changed).otherwise(c) if sign else changed
    return c
