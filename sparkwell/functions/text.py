"""Text rules as Column expressions. White space is what Python's ``str.split`` takes for it, in both engines that run these patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import GENERAL_LABEL, GENERAL_NAMES, GENERAL_SLUG

#: The 29 characters that Python's ``str.split`` and ``str.strip`` take for white space.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, f"^{SPACE}|{SPACE}$", "")


def rstrip(x: Column) -> Column:
    return F.regexp_replace(x, f"{SPACE}$", "")


def clean(x: Column) -> Column:
    """Null becomes empty, runs of white space one space, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), SPACE, " "))


def blank_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def truncate(x: Column, limit: int) -> Column:
    """At most ``limit`` characters and then three dots, if there are more."""
    return F.when(F.length(x) <= limit, x).otherwise(F.concat(rstrip(F.substring(x, 1, limit)), F.lit("...")))


def first_line(x: Column) -> Column:
    return F.substring_index(x, "\n", 1)


def normalize_target(x: Column) -> Column:
    low = F.lower(clean(x))
    return F.when(low.isin(GENERAL_NAMES), F.lit(GENERAL_SLUG)).otherwise(low)


def target_token(x: Column) -> Column:
    n = normalize_target(x)
    return F.when(n == GENERAL_SLUG, n).otherwise(F.regexp_replace(n, "[^a-z0-9]+", ""))


def tokens(x: Column) -> Column:
    """Distinct runs of lower-case ASCII letters and digits of a normalised text."""
    return F.array_distinct(F.regexp_extract_all(x, F.lit("([a-z0-9]+)"), F.lit(1)))


def display_target(x: Column) -> Column:
    stripped = strip(F.coalesce(x, F.lit("")))
    return F.when(normalize_target(x) == GENERAL_SLUG, F.lit(GENERAL_LABEL)).when(stripped == "", F.lit("UNKNOWN")).otherwise(F.upper(stripped))


def target_slug(x: Column) -> Column:
    slug = F.btrim(F.regexp_replace(strip(F.coalesce(x, F.lit(""))), "[^A-Za-z0-9]+", "-"), F.lit("-"))
    return F.when(normalize_target(x) == GENERAL_SLUG, F.lit(GENERAL_SLUG)).otherwise(F.coalesce(blank_to_null(F.upper(slug)), F.lit("TARGET")))


def report_filename(target: Column, at: Column) -> Column:
    return F.concat(F.date_format(at, "yyyy-MM-dd_HHmmss"), F.lit("_"), target_slug(target), F.lit(".md"))


def iso(at: Column) -> Column:
    """ISO text without a zero fraction."""
    return F.regexp_replace(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", "")


def clean_bullet(x: Column) -> Column:
    """White space off, then leading marks, then white space again."""
    return strip(F.regexp_replace(strip(x), "^[-* ]+", ""))


def render_bullets(bullets: Column) -> Column:
    return F.array_join(F.transform(bullets, lambda b: F.concat(F.lit("- "), clean_bullet(b))), "\n")


def citations(x: Column) -> Column:
    """Positive ids, each once, rising."""
    return F.array_sort(F.array_distinct(F.filter(x, lambda c: c >= 1)))


def render_citations(x: Column) -> Column:
    return F.array_join(F.transform(x, lambda c: F.concat(F.lit("["), c.cast("string"), F.lit("]"))), " ")


def yes_no(x: Column) -> Column:
    return F.when(x, F.lit("yes")).otherwise(F.lit("no"))
