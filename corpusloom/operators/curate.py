"""Matching, reason codes, set checks and export of retrieval data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import titles


def title_set(df: DataFrame, title: str) -> DataFrame:
    """``title`` in its raw, underscore and space form, distinct."""
    return df.where(F.col(title).isNotNull()).select(F.explode(titles.title_forms(title)).alias("title")).distinct()


def in_title_set(df: DataFrame, title: str, wanted: DataFrame) -> DataFrame:
    """Rows whose title, as it is or with underscores, is wanted. Both forms of the wanted set make one key."""
    key = titles.underscore_then_strip
    keys = wanted.select(key("title").alias("__key")).distinct()
    return df.withColumn("__key", key(title)).join(keys, "__key", "left_semi").drop("__key")


def pending(rows: DataFrame, done: DataFrame, key: str, order: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Rows whose key is not done; the anti join comes before the limit. Null keys are pending."""
    out = rows.join(done.select(key).distinct(), key, "left_anti")
    if order:
        out = out.orderBy(*order)
    return out.limit(limit) if limit is not None else out


def reason_codes(df: DataFrame, rules: list[tuple[str, Column]], ok: str = "ok") -> Column:
    """The first rule that holds, else ``ok``; a rule that is null does not hold."""
    out = None
    for name, rule in rules:
        hit = F.coalesce(rule, F.lit(False))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(ok) if out is not None else F.lit(ok)


def flagged_union(df: DataFrame, flags: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """Rows that any of the key tables has, with a flag for each; never an OR join."""
    out = df
    for flag, (key, keys) in flags.items():
        one = keys.select(F.col(keys.columns[0]).alias(key)).where(F.col(key).isNotNull()).distinct().withColumn(flag, F.lit(True))
        out = out.join(one, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
    return out.where(reduce(lambda a, b: a | b, [F.col(f) for f in flags]))


def containment(answers: DataFrame, docs: DataFrame, key: str, least: int = 40) -> DataFrame:
    """``answer_id, doc_id`` where exactly one document of the same key contains the answer.

    ``answers`` has answer_id, ``key``, answer_key; ``docs`` has doc_id, ``key``, doc_key. Answer keys shorter than
    ``least`` match nothing. The equi key makes it a hash join; the text test runs on its pairs.
    """
    pairs = answers.where(F.char_length("answer_key") >= least).join(docs, key).where(F.contains("doc_key", "answer_key"))
    return pairs.groupBy("answer_id").agg(F.count_distinct("doc_id").alias("n"), F.min("doc_id").alias("doc_id")).where("n = 1").select("answer_id", "doc_id")


def set_report(a: DataFrame, b: DataFrame, key: str, name: str) -> DataFrame:
    """Sizes, differences and common part of two key sets, as one row; a and b are equal if both differences are 0."""
    both = a.select(key).distinct().withColumn("a", F.lit(1)).join(b.select(key).distinct().withColumn("b", F.lit(1)), key, "full")
    return both.agg(
        F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.count_if(F.col("b").isNull()).alias("only_a"),
        F.count_if(F.col("a").isNull()).alias("only_b"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("common"),
    ).select(F.lit(name).alias("name"), "*")


def assert_equal_sets(a: DataFrame, b: DataFrame, key: str, name: str) -> None:
    """Hard gate: raises unless both key sets are equal."""
    r = set_report(a, b, key, name).first()
    if r.only_a or r.only_b:
        raise ValueError(f"{name}: {r.only_a} keys only on the left, {r.only_b} only on the right")


def profile(df: DataFrame, id: str, article: str, text: str) -> DataFrame:
    """One row of quality figures of a text table."""
    low = F.lower(F.col(text))
    return df.agg(
        F.count("*").alias("rows_"), F.count_distinct(id).alias("unique_ids"), F.count_distinct(article).alias("article_ids"),
        (F.count(id) - F.count_distinct(id)).alias("duplicate_ids"), F.count_if(F.coalesce(F.trim(text), F.lit("")) == "").alias("empty_text"),
        F.count_if(F.col(text).rlike(T.FRAGMENTS)).alias("bad_fragments"), F.count_if(low.contains("isbn") | low.contains("doi:")).alias("reference_like"), F.count_if(low.contains("http")).alias("external_like"),
        F.min(F.char_length(text)).alias("min_len"), F.max(F.char_length(text)).alias("max_len"), F.sum(F.char_length(text)).alias("total_len"),
    )


def build_variant(matches: DataFrame, ids: DataFrame, corpus: DataFrame, wanted_titles: DataFrame) -> dict[str, DataFrame]:
    """Queries, qrels and flagged corpus for the selected ids.

    ``matches`` has id, split, question, relevant_doc_ids; ``ids`` has id; ``corpus`` has _id, title, text.
    """
    chosen = matches.join(ids.select("id").distinct(), "id", "left_semi").dropDuplicates(["id", "split"])
    qrels = chosen.select(F.col("id").alias("query-id"), F.explode("relevant_doc_ids").alias("corpus-id"), F.lit("1").alias("score"), "split").distinct()
    docs = flagged_union(corpus.withColumn("__key", titles.underscore_then_strip("title")), {"by_id": ("_id", qrels.select("corpus-id")), "by_title": ("__key", wanted_titles.select(titles.underscore_then_strip("title").alias("k")))}).drop("__key")
    return {"queries": chosen.select(F.col("id").alias("_id"), F.col("question").alias("text"), "split"), "qrels": qrels, "corpus": docs}


def resolve_questions(questions: DataFrame, sections: DataFrame, pages: DataFrame) -> DataFrame:
    """``id, reason, doc_id, kind`` of each question: the section of its long answer, or why there is none.

    ``questions`` has id, article_id, title, annotations; ``sections`` has doc_id, article_key, section, text (bad
    intros already out); ``pages`` has article_id, html. For each valid answer in order the enclosing section is
    looked up by (article key, section), then its text by containment; if nothing fits, the text test is repeated for
    answers in left-out sections. Reasons in order: no_corpus_title, no_long_answer, missing_html,
    dropped_section_only, unmapped.
    """
    from corpusloom.functions.decisions import valid_long_answers
    from corpusloom.operators.ordinal import first_wins

    q = questions.select("id", "article_id", "annotations").withColumn("article_key", titles.article_key("article_id")).withColumn("answers", valid_long_answers("annotations"))
    known = sections.select("article_key").distinct().withColumn("has_title", F.lit(True))
    q = q.join(known, "article_key", "left").join(pages.select("article_id", "html").dropDuplicates(["article_id"]), "article_id", "left")
    a = q.where("has_title").select("id", "article_key", "html", F.posexplode("answers").alias("pos", "la")).where("html IS NOT NULL")
    a = a.withColumn("section", T.enclosing_section("html", F.col("la.start_byte")))
    a = a.withColumn("answer_key", T.match_key(T.answer_text(T.bytes_slice("html", F.col("la.start_byte"), F.col("la.end_byte")))))
    a = a.withColumn("answer_id", F.concat_ws("#", "id", F.col("pos").cast("string"))).drop("html", "la")
    by_section = first_wins(sections.select("article_key", "section", "doc_id").where("section IS NOT NULL"), ["article_key", "section"], ["doc_id"])
    hit = a.join(by_section, ["article_key", "section"]).select("id", F.lit(0).alias("pass"), "pos", F.lit(0).alias("step"), "doc_id", F.lit("section").alias("kind"))
    docs = sections.select("doc_id", "article_key", T.match_key("text").alias("doc_key"))
    inside = containment(a, docs, "article_key").join(a.select("answer_id", "id", "pos", "section"), "answer_id")
    text = inside.select("id", F.when(F.col("section").isNotNull(), 0).otherwise(1).alias("pass"), "pos", F.lit(1).alias("step"), "doc_id", F.lit("text").alias("kind"))
    best = first_wins(hit.unionByName(text), ["id"], ["pass", "pos", "step"]).select("id", "doc_id", "kind")
    dropped = a.groupBy("id").agg(F.bool_and(F.col("section").isNull()).alias("only_dropped"))
    out = q.select("id", "has_title", "answers", (F.col("html").isNotNull()).alias("has_html")).join(best, "id", "left").join(dropped, "id", "left")
    reason = reason_codes(out, [
        ("no_corpus_title", F.col("has_title").isNull()), ("no_long_answer", F.size("answers") == 0), ("missing_html", ~F.col("has_html")),
        ("kept", F.col("doc_id").isNotNull()), ("dropped_section_only", F.col("only_dropped")),
    ], "unmapped")
    return out.select("id", reason.alias("reason"), "doc_id", "kind")


def in_seeded_order(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """``df`` in an order that looks random and is the same for the same seed and keys; ``limit`` on it is a sample."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key).cast("string")), key)


def preferred_first(df: DataFrame, key: str, preferred: DataFrame) -> DataFrame:
    """``df`` with the rows whose key is in ``preferred`` (key) first, then by key."""
    known = preferred.select(key).distinct().withColumn("__preferred", F.lit(True))
    return df.join(known, key, "left").orderBy(F.col("__preferred").asc_nulls_last(), key).drop("__preferred")


def lookup(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` for all of ``ids`` (key); an error that names some if any is missing."""
    wanted = ids.select(key).where(F.col(key).isNotNull()).distinct()
    missing = [r[0] for r in wanted.join(df.select(key).distinct(), key, "left_anti").orderBy(key).limit(5).collect()]
    if missing:
        raise KeyError(f"no row for {key} {missing}")
    return df.join(wanted, key, "left_semi")
