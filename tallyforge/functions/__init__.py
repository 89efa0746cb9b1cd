"""Scalar functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge import schemas as S


def stripped(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    return F.coalesce(stripped(c) == "", F.lit(True))


def normalize_key(c: Column) -> Column:
    return F.lower(stripped(c))


def html_escape(c: Column) -> Column:
    out = F.coalesce(c.cast("string"), F.lit(""))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def format_ts(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "dd.MM.yyyy, HH:mm:ss"), F.lit("—"))


def safe_skill_name(c: Column) -> Column:
    """Not empty, no slash or backslash, no two dots in a row."""
    return F.coalesce((F.length(c) > 0) & ~c.rlike(r"[/\\]|\.\."), F.lit(False))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_suffix(name: Column) -> Column:
    """From the last dot on, unless the name begins there."""
    return F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)


def all_tokens(c: Column, tokens: list[str]) -> Column:
    return F.forall(F.array(*map(F.lit, tokens)), lambda t: F.contains(c, t))


def any_token(c: Column, tokens: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, tokens)), lambda t: F.contains(c, t))


def sha256_hex(c: Column) -> Column:
    return F.sha2(c, 256)


def null_default(c: Column, value: str | int) -> Column:
    return F.coalesce(c, F.lit(value))


def status_class(c: Column) -> Column:
    """ok, bad or warn by what the status contains, ok first: INACTIVE is ok, ACCEPTED and null are warn."""
    s = F.coalesce(c, F.lit(""))
    return F.when(s.rlike("(?i)PASS|READY|COMPLETED|ACTIVE|RUNNING"), "ok").when(s.rlike("(?i)ERROR|BLOCK|FAILED"), "bad").otherwise("warn")


def blocks_progress(status: Column) -> Column:
    return F.coalesce(status.isin(*S.BLOCKING), F.lit(False))


def has_findings(findings: Column) -> Column:
    return F.coalesce(F.size(findings) > 0, F.lit(False))


def result_json(*columns: str) -> Column:
    """Compact JSON of a result row; null fields stay, non-ASCII characters are kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
