"""Normalising model decisions, JSON replies and polymorphic fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clamp_score(c: Column | str) -> Column:
    """A score as an integer from 0 to 3; what is no whole number in text form counts as 0."""
    return F.greatest(F.lit(0), F.least(F.lit(3), F.coalesce(_c(c).try_cast("int"), F.lit(0))))


def clamp_score_json(c: Column | str) -> Column:
    """``clamp_score`` of a JSON value: numbers are cut to whole ones, true is 1, a text has to be a whole number."""
    v = F.try_parse_json(_c(c))
    kind = F.schema_of_variant(v)
    number = F.when(kind == "STRING", F.trim(F.try_variant_get(v, "$", "string")).try_cast("int")).when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("int"))
    return F.greatest(F.lit(0), F.least(F.lit(3), F.coalesce(number.otherwise(F.try_variant_get(v, "$", "double").try_cast("int")), F.lit(0))))


def question_text(c: Column | str) -> Column:
    """The text of a question in JSON that is an object with ``text`` or a text itself; null for anything else."""
    v = F.try_parse_json(_c(c))
    kind = F.schema_of_variant(v)
    return F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).when(kind.startswith("OBJECT"), F.try_variant_get(v, "$.text", "string"))


def category_label(c: Column | str) -> Column:
    """keep, mixed or drop; ``borderline`` is mixed, anything else and null is drop."""
    low = F.lower(F.trim(_c(c)))
    return F.when(low.isin("keep", "mixed", "drop"), low).when(low == "borderline", "mixed").otherwise("drop")


def article_label(c: Column | str) -> Column:
    return F.when(F.lower(F.trim(_c(c))) == "keep", "keep").otherwise("drop")


def category_decision(label: Column | str, score: Column | str) -> dict[str, Column]:
    """label, confidence_score, expand_descendants and include_direct_articles of a category."""
    own, value = category_label(label), clamp_score(score)
    return {
        "label": own, "confidence_score": value, "expand_descendants": own != "drop",
        "include_direct_articles": (own == "keep") & (value >= 2),
    }


def json_object(c: Column | str) -> Column:
    """A reply as VARIANT: the whole text, else from its first to its last brace; null unless it is an object."""
    text = _c(c)
    whole, inner = F.try_parse_json(text), F.try_parse_json(F.regexp_extract(text, r"(?s)\{.*\}", 0))
    is_object = lambda v: F.schema_of_variant(v).startswith("OBJECT")
    return F.when(is_object(whole), whole).when(is_object(inner), inner)


def reasoning_tokens(usage: Column | str) -> Column:
    """Reasoning tokens of a usage map, from either spelling."""
    u = _c(usage)
    return F.coalesce(u["reasoning_tokens"], u["completion_tokens_details.reasoning_tokens"], u["output_tokens_details.reasoning_tokens"])


def has_answer(annotations: Column | str) -> Column:
    """Whether a question has a long answer, a short answer with text, or a yes or no."""
    a = _c(annotations)
    long_ = F.exists(a["long_answer"], lambda x: F.coalesce(x["start_token"] != -1, F.lit(False)))
    short = F.exists(a["short_answers"], lambda x: F.coalesce(F.exists(x["text"], lambda t: F.coalesce(t != "", F.lit(False))), F.lit(False)))
    yes_no = F.exists(a["yes_no_answer"], lambda x: F.coalesce(F.upper(x).isin("YES", "NO"), F.lit(False)))
    return F.coalesce(long_, F.lit(False)) | F.coalesce(short, F.lit(False)) | F.coalesce(yes_no, F.lit(False))


def valid_long_answers(annotations: Column | str) -> Column:
    """Long answers with a byte range and a candidate; empty for null."""
    keep = lambda x: F.coalesce((x["start_byte"] >= 0) & (x["end_byte"] > x["start_byte"]) & (x["candidate_index"] != -1), F.lit(False))
    return F.coalesce(F.filter(_c(annotations)["long_answer"], keep), F.expr("array()"))


def short_answers(annotations: Column | str) -> Column:
    """All non-empty short answer texts in order."""
    texts = F.flatten(F.transform(_c(annotations)["short_answers"], lambda x: F.coalesce(x["text"], F.array().cast("array<string>"))))
    return F.coalesce(F.filter(texts, lambda t: F.coalesce(t != "", F.lit(False))), F.array().cast("array<string>"))
