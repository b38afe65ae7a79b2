"""Text cleaning as column expressions; entity decoding alone is an Arrow UDF."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Sections that are no part of the article's text.
STOP_SECTIONS = [
    "references", "notes", "footnotes", "bibliography", "sources", "further reading",
    "external links", "see also", "navigation", "related pages", "works cited",
]
STOP_PREFIXES = [
    "references", "notes", "footnotes", "bibliography", "sources", "further reading",
    "external links", "see also",
]
# Marks of text that belongs to the page and not to the article.
JUNK = [
    "retrieved from", "categories:", "hidden categories:", "wikimedia commons",
    "international standard", "isbn", "authority control", "vte", "doi:",
    "this page was last edited", "privacy policy", "terms of use",
]
# Patterns of a text that breaks off before its formula.
_VERBS = (
    "given|described|defined|written|expressed|represented|shown|calculated|computed|estimated|"
    "approximated|obtained|derived|modeled|modelled"
)
BAD_INTRO = (
    r"(?i)(?:"
    r"\b(?:thus|therefore|hence|where|whereby)\s*$|"
    r"\b(?:as|is|are|was|were|be|being)\s*$|"
    rf"\b(?:{_VERBS})\s+(?:as|by|with)?\s*$|"
    rf"\b(?:is|are|was|were|can be|may be|could be)\s+(?:{_VERBS})\s+(?:as|by|with)?\s*$|"
    r"\b(?:the\s+)?(?:equation|formula|expression|reaction|relationship|relation|law)\s+(?:is|are|becomes|can be written|can be expressed)\s*$|"
    r"\b(?:as follows|it reads)\s*$)"
)
# The rules of clean text in their order, as pattern and replacement: references, notes in brackets, edit
# marks, the spacing around signs, ordinals. They are the same for columns, parsers and SQL.
SPACING = [(r"\s+([,.;:!?%)\]])", r"\1"), (r"([(\[])\s+", r"\1"), (r"\s+([_^]\{)", r"\1"), (r"([_^]\{)\s+", r"\1"), (r"\s+\}", "}")]
CLEANING = [
    (r"(?i)</?ref\b[^>]*>", " "),
    (r"(?i)\[\s*(?:\d+(?:\s*[,-]\s*\d+)*|note\s+\d+|citation needed|clarification needed|dead link|failed verification)\s*\]", " "),
    (r"(?i)\[\s*edit\s*\]", " "), (r"(?i)\bedit\s*$", ""), *SPACING, (r"\b([A-Za-z])\s+th\b", r"\1th"),
]
# Tags and attributes that an extractor left in a text, and names of sections that are no text.
FRAGMENTS = r"(?i)<\s*/?\s*(?:a|table|tr|td|th|div|span|p|li|ul|ol|ref)\b[^>]*>|href=|(?-i:\bmw-[a-z])|\[\s*edit\s*\]"
# Remarks of editors and tag remnants that an answer's text leaves out.
_REMARKS = r"(?iU)\[\s*(?:citation needed|clarification needed|page needed|dead link|failed verification|not specific enough to verify|unreliable source)\s*\]"
_REMNANTS = r"\bmw-[a-z]|edit\s*\]|edit\b|\bster\b|\bsect\b"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(T.StringType())
def _unescape(s: pd.Series) -> pd.Series:
    import html

    return s.map(html.unescape, na_action="ignore")


def unescape(c: Column | str) -> Column:
    """Character references decoded; texts without ``&`` stay in the JVM."""
    return F.coalesce(_unescape(F.when(F.contains(_c(c), F.lit("&")), _c(c))), _c(c))


def apply_rules(c: Column | str, rules: list[tuple[str, str]]) -> Column:
    """The rules, one after the other, with Unicode classes."""
    out = _c(c)
    for a, b in rules:
        out = F.regexp_replace(out, "(?U)" + a, b.replace("\\", "$"))
    return out


def tidy_spaces(c: Column | str) -> Column:
    """No space before closing or after opening signs, and around braces of ``_{}`` and ``^{}``."""
    return apply_rules(c, SPACING)


def squeeze(c: Column | str) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(_c(c), r"(?U)\s+", " "), "^ | $", "")


def clean_text(c: Column | str, entities: bool = True) -> Column:
    """Article text without references, edit marks and odd spacing."""
    out = unescape(c) if entities else _c(c)
    return squeeze(apply_rules(F.translate(F.replace(out, F.lit("\xa0"), F.lit(" ")), "\u200b", ""), CLEANING))


def latex_alt(c: Column | str) -> Column:
    """Text of a formula image: the wrapper taken off, empty if it is null or longer than 160 characters."""
    out = squeeze(unescape(F.coalesce(_c(c), F.lit(""))))
    out = squeeze(F.regexp_replace(out, r"(?s)^\{\\displaystyle\s*(.*?)\}$", "$1"))
    return F.when(F.char_length(out) > 160, F.lit("")).otherwise(out)


def match_key(c: Column | str, entities: bool = True) -> Column:
    """Key under which an answer is looked for in a text; null becomes empty."""
    text = F.coalesce(_c(c), F.lit(""))
    return tidy_spaces(squeeze(F.lower(unescape(text) if entities else text)))


def heading_text(inner: Column | str) -> Column:
    """Text of a heading from its inner HTML: that of its headline span if it has one."""
    # fixed value
    pattern = r'(?is)<span[^>]*class="[^"]*mw-headline[^"]*"[^>]*>(.*?)</span>'
    own = F.when(F.regexp_like(_c(inner), F.lit(pattern)), F.regexp_extract(_c(inner), pattern, 1)).otherwise(_c(inner))
    return clean_text(F.regexp_replace(own, "<[^>]+>", " "))


def is_stop_section(name: Column) -> Column:
    """Whether a section is left out, by its whole name or its beginning; false for null."""
    low = F.lower(F.regexp_replace(name, r"(?U)^\s+|\s+$", ""))
    return F.coalesce(low.isin(STOP_SECTIONS) | low.rlike("^(?:" + "|".join(STOP_PREFIXES) + ")"), F.lit(False))


def is_bad_path(path: Column | str) -> Column:
    return F.coalesce(F.exists(_c(path), is_stop_section), F.lit(False))


def is_bad_intro(c: Column | str) -> Column:
    """Whether a text ends in a clause that announces a formula; false for null."""
    return F.coalesce(F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "").rlike("(?U)" + BAD_INTRO), F.lit(False))


def bytes_slice(html: Column | str, start: Column, end: Column) -> Column:
    """UTF-8 text of a byte range; split characters become U+FFFD."""
    return F.make_valid_utf8(F.substring(_c(html).cast("binary"), start + 1, end - start).cast("string"))


def last_heading(html: Column | str, start: Column) -> Column:
    """Markup of the last H2 heading before a byte offset; empty before the first."""
    before = F.make_valid_utf8(F.substring(_c(html).cast("binary"), F.lit(1), F.greatest(F.lit(0), start)).cast("string"))
    # fixed value: the pattern of a heading
    heads = F.regexp_extract_all(before, F.lit(r"(?is)<h2\b[^>]*>(.*?)</h2>"), F.lit(1))
    return F.when(F.size(heads) > 0, F.element_at(heads, -1)).otherwise(F.lit(""))


def section_name(heading: Column | str) -> Column:
    """Name of the section below a ``last_heading``: ``summary`` before the first, null for a left-out section."""
    last = heading_text(heading)
    low = F.lower(last)
    return F.when((low == "") | (low == "contents"), F.lit("summary")).when(~is_stop_section(low), last)


def enclosing_section(html: Column | str, start: Column) -> Column:
    """Name of the H2 section around a byte offset: ``summary`` before the first, null inside a left-out section."""
    return section_name(last_heading(html, start))


def answer_text(fragment: Column | str) -> Column:
    """Clean text of a long-answer fragment; null if it holds a table, is short, or breaks off before a formula."""
    c = _c(fragment)
    # fixed values: the patterns of what is left out, and of formula images
    out = F.regexp_replace(c, r"(?is)<style[^>]*>.*?</style>|<script[^>]*>.*?</script>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r'(?is)<sup[^>]*class="[^"]*reference[^"]*".*?</sup>', " ")
    out = F.regexp_replace(out, r'(?is)<span[^>]*class="[^"]*mw-editsection[^"]*".*?</span>', " ")
    out = F.regexp_replace(out, r'(?i)<img[^>]*?alt="\{\\displaystyle\s*([^"]*)\}"[^>]*>', " $1 ")
    out = F.regexp_replace(out, r'(?i)<img[^>]*?alt="([^"]*)"[^>]*>', " $1 ")
    out = unescape(squeeze(F.regexp_replace(out, "<[^>]+>", " ")))
    out = F.regexp_replace(out, _REMARKS, " ")
    out = squeeze(F.regexp_replace(out, _REMNANTS, " "))
    table = c.rlike(r"(?i)<\s*(?:table|tbody|thead|tr)\b")
    return F.when(~table & (F.char_length(out) >= 45) & ~is_bad_intro(out), out)
