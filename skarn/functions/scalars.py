"""Scalar functions as column expressions: names, links, times and display texts."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Units of intervals in seconds.
UNITS = {"min": 60, "mins": 60, "minute": 60, "minutes": 60, "h": 3600, "hr": 3600, "hrs": 3600, "hour": 3600, "hours": 3600, "d": 86400, "day": 86400, "days": 86400,
         "w": 604800, "wk": 604800, "wks": 604800, "week": 604800, "weeks": 604800, "mo": 2592000, "mos": 2592000, "month": 2592000, "months": 2592000}


@lru_cache(maxsize=100_000)
def slug_of(name: str | None) -> str | None:
    """Lower-case ASCII words joined by ``-``; letters are decomposed, accents and what has no ASCII form are left out."""
    if name is None:
        return None
    plain = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode()
    return re.sub("[^a-z0-9]+", "-", plain.lower()).strip("-")


@F.pandas_udf(T.StringType())
def slugify(name: pd.Series) -> pd.Series:
    """:func:`slug_of` as a column: Unicode decomposition has no built-in expression."""
    return name.map(slug_of)


@F.pandas_udf(T.ArrayType(T.StringType()))
def slugify_all(names: pd.Series) -> pd.Series:
    """:func:`slug_of` of every element."""
    return names.map(lambda a: None if a is None else [slug_of(x) for x in a])


def slug_key(slug: Column) -> Column:
    """First initial and last word of a slug."""
    words = F.split(slug, "-")
    return F.struct(F.left(F.element_at(words, 1), F.lit(1)).alias("initial"), F.element_at(words, -1).alias("surname"))


def author_key(name: Column) -> Column:
    return slug_key(slugify(name))


def url_slug(url: Column) -> Column:
    return F.element_at(F.split(F.rtrim(url, F.lit("/")), "/"), -1)


def is_publication_url(url: Column) -> Column:
    return F.contains(url, F.lit("/en/publications/"))


def same_host(url: Column, base: Column) -> Column:
    return F.parse_url(url, F.lit("AUTHORITY")) == F.parse_url(base, F.lit("AUTHORITY"))


def year_of(date: Column) -> Column:
    """The first four characters if they are digits, else empty."""
    first = F.left(date, F.lit(4))
    return F.when(first.rlike(r"^\d+$"), first).otherwise("")


def hrefs(html: Column) -> Column:
    """The targets of all links of a page."""
    return F.regexp_extract_all(html, F.lit(r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""), F.lit(1))


def links_to(html: Column, section: str, base: str) -> Column:
    """Absolute links to pages of ``section``, distinct and sorted."""
    slugs = F.transform(hrefs(html), lambda h: F.regexp_extract(h, rf"/en/{section}/([^/\"?#]+)", 1))
    kept = F.array_sort(F.array_distinct(F.filter(slugs, lambda s: s != "")))
    return F.transform(kept, lambda s: F.concat(F.lit(f"{base.rstrip('/')}/en/{section}/"), s, F.lit("/")))


def belongs_to(html: Column, slug: str) -> Column:
    return F.exists(hrefs(html), lambda h: F.contains(h, F.lit(slug)))


def is_affiliated(institutions: Column, name: str) -> Column:
    return F.coalesce(F.exists(institutions, lambda i: F.contains(F.lower(i), F.lit(name.lower()))), F.lit(False))


def fetch_outcome(status: Column) -> Column:
    """'failed' for null, 'unchanged' for 304, 'ok' for 2xx, else 'error'."""
    return F.when(status.isNull(), "failed").when(status == 304, "unchanged").when(status.between(200, 299), "ok").otherwise("error")


def backoff_seconds(delay: Column, attempt: Column, retry_after: Column) -> Column:
    """The wait before a repeated request: ``delay * 2 ** attempt``, at least what the server asked for."""
    return F.greatest(delay * F.pow(F.lit(2.0), attempt), F.coalesce(retry_after, F.lit(0.0)))


def parse_interval(text: Column, strict: bool = False) -> Column:
    """Seconds of '1week', '100h', '2 months'; for anything but a number with a known unit null, or an error if ``strict``."""
    clean = F.lower(F.trim(text))
    number = F.regexp_extract(clean, r"^(\d+(?:\.\d+)?)\s*([a-z]+)$", 1)
    unit = F.create_map(*[F.lit(x) for k, v in UNITS.items() for x in (k, float(v))])[F.regexp_extract(clean, r"^(\d+(?:\.\d+)?)\s*([a-z]+)$", 2)]
    seconds = number.try_cast("double") * unit
    return F.coalesce(seconds, F.raise_error(F.concat(F.lit("no interval: "), F.coalesce(text, F.lit("null")))).cast("double")) if strict else seconds


def format_duration(seconds: Column) -> Column:
    s = F.greatest(seconds, F.lit(0.0))
    said = (F.when(s < 60, F.format_string("%.0fs", s)).when(s < 3600, F.format_string("%.1f minutes", s / 60))
            .when(s < 86400, F.format_string("%.1f hours", s / 3600)).otherwise(F.format_string("%.1f days", s / 86400)))
    return F.when(seconds.isNotNull(), said)


def seconds_until_due(last: Column, now: Column, interval: Column) -> Column:
    """0 if there was no run yet."""
    return F.coalesce(F.greatest(interval - (F.unix_micros(now) - F.unix_micros(last)) / 1e6, F.lit(0.0)), F.lit(0.0))


def crawl_id(at: Column) -> Column:
    """A sortable id of a run: local time of the archive."""
    return F.date_format(F.from_utc_timestamp(at, "Asia/Kathmandu"), "yyyy-MM-dd-HH-mm-ss'-NPT'")


def snippet(text: Column, length: int = 280) -> Column:
    return F.when(F.length(text) > length, F.concat(F.rtrim(F.left(text, F.lit(length))), F.lit("…"))).otherwise(text)


def year_span(first: Column, last: Column) -> Column:
    return F.when(first == last, first).otherwise(F.concat(first, F.lit("–"), last))


def example_title(text: Column) -> Column:
    return F.concat(F.array_join(F.slice(F.split(text, " "), 1, 4), " "), F.lit("…"))


def bar_width(value: Column, low: Column, high: Column) -> Column:
    """100 for the nearest, 25 for the farthest."""
    return F.when(high == low, F.lit(100.0)).otherwise(25 + (high - value) / (high - low) * 75)


def sorted_distances(distances: Column) -> Column:
    """A map of distances as ``array<struct<distance, category, gap>>``, nearest first, with the gap to the nearest."""
    nearest = F.array_min(F.map_values(distances))
    return F.array_sort(F.transform(F.map_entries(distances), lambda e: F.struct(e["value"].alias("distance"), e["key"].alias("category"), (e["value"] - nearest).alias("gap"))))


def verdict(margin: Column, matched: Column) -> Column:
    return F.when(matched == 0, "no known terms").when(margin < 0.01, "too close to call").when(margin < 0.04, "a narrow call").otherwise("clear")


def scaled(value: Column, low: Column, high: Column, size: float) -> Column:
    """A place between 0 and ``size`` in a plot; a flat series is given a span of its own height, or 1."""
    span = F.when(high != low, high - low).when(high != 0, F.abs(high)).otherwise(1.0)
    return (value - low) / span * size


def misplaced(category: Column, true_category: Column) -> Column:
    return F.coalesce(category != true_category, F.lit(False))


def metric_text(name: Column, value: Column) -> Column:
    """Accuracy as a percentage with one decimal, others with three."""
    return F.when(name == "accuracy", F.format_string("%.1f%%", value * 100)).otherwise(F.format_string("%.3f", value))
