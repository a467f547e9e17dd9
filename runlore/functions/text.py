"""Text expressions. All are native column expressions; none calls Python per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as Unicode text tools understand it: the White_Space property plus the four separators U+001C..U+001F.
SPACE = r"[\s\x1c-\x1f]"
NOT_SPACE = r"[^\s\x1c-\x1f]"

# What is redacted, in this order, and the labels put in its place. What a match begins with is looked at
# before anything dearer, as most places are no match.
REDACTIONS = (
    ("ip_address", r"(?U)(?=\d)\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    ("api_key", r"(?iU)(?=[atsp])(api[_-]?key|token|secret|password)\s*[=:]\s*\S+"),
    ("email", r"(?U)\b[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
)

# How documents are classified.
POST_MORTEM_KEYWORDS = ("post-mortem", "postmortem", "post_mortem", "incident report", "retrospective")
RUNBOOK_KEYWORDS = ("runbook", "playbook")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once. A column used inside a lambda is otherwise computed again for
    every element the lambda sees."""
    return F.element_at(F.transform(F.array(value), body), 1)


def clean_text(c: Column) -> Column:
    """Every whitespace run becomes one space, then NULs go, then the ends are trimmed."""
    return F.trim(F.replace(F.regexp_replace(c, f"(?U){SPACE}+", " "), F.lit("\0"), F.lit("")))


def clean_text_keep_lines(c: Column) -> Column:
    """Like ``clean_text`` but lines survive, for the operators that look at headings and blank lines."""
    unix = F.regexp_replace(c, r"\r\n?", "\n")
    spaced = F.regexp_replace(unix, r"[ \t]+", " ")
    return F.regexp_replace(F.replace(spaced, F.lit("\0"), F.lit("")), f"(?U)^{SPACE}+|{SPACE}+$", "")


def redact(c: Column) -> Column:
    for label, pattern in REDACTIONS:
        c = F.regexp_replace(c, pattern, f"[REDACTED_{label.upper()}]")
    return c


def words(c: Column) -> Column:
    """Whitespace-separated words; the default token."""
    return F.filter(F.split(c, f"(?U){SPACE}+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(f"(?U){NOT_SPACE}+"))


def terms(c: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores: the terms of lexical scoring."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), 0)


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def title_case(c: Column) -> Column:
    """Capital after every non-letter, not only after spaces as ``initcap`` does."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.initcap(r)), "")


def first_heading(c: Column) -> Column:
    """Text of the first level-one heading, null when there is none."""
    found = F.regexp_extract(c, r"(?Umd)^#\s+(.+)$", 1)
    return F.nullif(F.trim(found), F.lit(""))


def headings(c: Column) -> Column:
    """All headings of levels one to three."""
    return F.regexp_extract_all(c, F.lit(r"(?Umd)^#{1,3}\s+(.+)$"), 1)


def title_from_stem(stem: Column) -> Column:
    return title_case(F.replace(stem, F.lit("-"), F.lit(" ")))


def classify(path: Column, c: Column) -> Column:
    """Document type by keywords in the path or anywhere in the text."""
    where = F.lower(path)
    body = F.lower(c)
    post_mortem = F.lit(False)
    for k in POST_MORTEM_KEYWORDS:
        post_mortem = post_mortem | where.contains(k) | body.contains(k)
    runbook = F.lit(False)
    for k in RUNBOOK_KEYWORDS:
        runbook = runbook | where.contains(k)
    return F.when(post_mortem, "post_mortem").when(runbook, "runbook").otherwise("documentation")


def or_default(c: Column, default: str) -> Column:
    """Default for a missing key; a present empty string stays, as with a keyed lookup."""
    return F.coalesce(c, F.lit(default))


def labelled(label: str, c: Column) -> Column:
    """``label`` followed by the value, or null when the value is missing or empty."""
    return F.when(c != "", F.concat(F.lit(label), c))


def parse_iso(c: Column, now: Column | None = None) -> Column:
    """ISO time, ``Z`` allowed; now when missing or unreadable."""
    return F.coalesce(F.try_to_timestamp(c), now if now is not None else F.current_timestamp())


def parse_utc(c: Column, now: Column | None = None) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` read as UTC whatever the session zone; now when missing or unreadable."""
    parsed = F.try_to_timestamp(F.concat(c, F.lit(" Z")), F.lit("yyyy-MM-dd HH:mm:ss X"))
    return F.coalesce(parsed, now if now is not None else F.current_timestamp())


def stable_suffix(c: Column, n: int) -> Column:
    """First hex digits of the content hash, the same in every run."""
    return F.substring(content_hash(c), 1, n)
