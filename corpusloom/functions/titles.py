"""Titles, URLs and file names as column expressions. Null stays null except where a default is named."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


def category_title(c: Column | str) -> Column:
    """Underscore form of a category title: stripped, without a leading ``Category:``."""
    return F.translate(F.regexp_replace(strip(c), "^Category:", ""), " ", "_")


def display_title(c: Column | str) -> Column:
    """Form with spaces."""
    return F.translate(_c(c), "_", " ")


def underscore_then_strip(c: Column | str) -> Column:
    """Underscores for spaces first, then stripped."""
    return strip(F.translate(_c(c), " ", "_"))


def space_then_strip(c: Column | str) -> Column:
    """Spaces for underscores first, then stripped; null becomes empty."""
    return strip(F.translate(F.coalesce(_c(c), F.lit("")), "_", " "))


def display_or(c: Column | str, title: Column | str) -> Column:
    """A display title, or the one made from the title where it is null or empty."""
    return F.coalesce(F.nullif(_c(c), F.lit("")), display_title(title))


def percent_encoded(c: Column | str) -> Column:
    """Percent encoding that keeps letters, digits and ``_.-~/:()``."""
    out = F.url_encode(_c(c))
    for a, b in (("+", "%20"), ("*", "%2A"), ("%2F", "/"), ("%3A", ":"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def article_url(c: Column | str, site: str) -> Column:
    return F.concat(F.lit(site), percent_encoded(F.translate(_c(c), " ", "_")))


def query_param(url: Column | str, name: str) -> Column:
    """A parameter of a URL as it stands in the text, decoded; null if it is not there or empty.

    Works on URLs that are not well formed; ``&amp;`` counts as ``&``. A broken percent code leaves the raw value.
    """
    raw = F.nullif(F.regexp_extract(F.replace(_c(url), F.lit("&amp;"), F.lit("&")), rf"[?&]{name}=([^&#]*)", 1), F.lit(""))
    return F.coalesce(F.try_url_decode(raw), raw)


def old_id(url: Column | str) -> Column:
    """Revision of a snapshot URL, ``no_oldid`` without one."""
    return F.coalesce(query_param(url, "oldid"), F.lit("no_oldid"))


def safe_part(c: Column | str, most: int = 140) -> Column:
    """A part of a file name: letters, digits and ``._()-``, squeezed, ``untitled`` if nothing is left."""
    out = strip(F.regexp_replace(_c(c), r"[/\\]", "_"))
    out = F.regexp_replace(out, r"[^A-Za-z0-9._()-]+", "_")
    out = F.regexp_replace(F.regexp_replace(out, "_+", "_"), r"^[._]+|[._]+$", "")
    return F.left(F.coalesce(F.nullif(out, F.lit("")), F.lit("untitled")), F.lit(most))


def article_id(name: Column | str, url: Column | str) -> Column:
    """File name of a snapshot without its ending."""
    return F.concat(safe_part(name), F.lit("__oldid_"), safe_part(old_id(url), 40))


def article_key(id: Column | str) -> Column:
    """Title part of a snapshot id: before the first ``__oldid_``."""
    return F.split(_c(id), "__oldid_")[0]


def parse_article_id(id: Column | str) -> Column:
    """Struct of title part and revision, split at the last ``__oldid_``."""
    return F.struct(F.regexp_extract(_c(id), "^(.*)__oldid_(.*)$", 1).alias("title"), F.regexp_extract(_c(id), "^(.*)__oldid_(.*)$", 2).alias("oldid"))


def title_forms(c: Column | str) -> Column:
    """Array of the raw, underscore and space form."""
    return F.array_distinct(F.array(_c(c), F.translate(_c(c), " ", "_"), F.translate(_c(c), "_", " ")))
