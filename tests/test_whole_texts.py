"""Queries on whole texts against brute force, on rows that their SQL forms leave out or cut."""

import html
import re

from corpusloom.plans import table_queries as Q

NOTES = r"\[\s*(?:\d+(?:\s*[,-]\s*\d+)*|note\s+\d+|citation needed|clarification needed|dead link|failed verification)\s*\]"
TIDY = [(r"\s+([,.;:!?%)\]])", r"\1"), (r"([(\[])\s+", r"\1"), (r"\s+([_^]\{)", r"\1"), (r"([_^]\{)\s+", r"\1"), (r"\s+\}", "}")]


def table(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(str(folder / f"{name}.parquet"))


def clean(text):
    text = html.unescape(text).replace("\xa0", " ").replace("​", "")
    rules = [(r"(?i)</?ref\b[^>]*>", " "), (f"(?i){NOTES}", " "), (r"(?i)\[\s*edit\s*\]", " "), (r"(?i)\bedit\s*$", "")]
    for a, b in [*rules, *TIDY, (r"\b([A-Za-z])\s+th\b", r"\1th")]:
        text = re.sub(a, b, text)
    return re.sub(r"\s+", " ", text).strip()


def test_every_document_is_cleaned(spark, tmp_path):
    texts = [
        "plain [1] text , edit", "Müller ( café ) [ note 3 ]", "Η οξύτητα [citation needed] .", "水の性質 [12, 13] 。", "AT&amp;T &lt;ref name=a&gt;x&lt;/ref&gt; y",
        "R & D  lab", "zero​width [edit]", "bell \x07 sign ;", "the n　th root", "hard\xa0space &nbsp;,", "H _{ 2 } O &ndash; water", "", None,
    ]
    table(spark, tmp_path, "documents", list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.clean for r in Q.clean_text_all(spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None else clean(t) for i, t in enumerate(texts)}


def test_bad_intro_is_judged_at_the_end_of_a_text(spark, tmp_path):
    long = "The law of mass action relates the rates of a reaction to its concentrations and "
    texts = [long + "is given by ", long + "it reads", "one two three four five six seven eight is nine ten", long + "holds", "is\u3000given\u3000by", "caféis", "", None]
    table(spark, tmp_path, "corpus", [(f"d{i}", "t", t) for i, t in enumerate(texts)] + [("d0", "t", texts[0])], "_id string, title string, text string")
    rows = Q.bad_intro_texts(spark, str(tmp_path)).collect()
    assert sorted(r["_id"] for r in rows) == [f"d{i}" for i in range(len(texts))]
    assert {r["_id"] for r in rows if r.bad} == {"d0", "d1", "d4"}


def test_containment_of_whole_texts(spark, tmp_path):
    head = "this beginning of a section is shared by several texts and is longer than eighty characters, "
    sections = [
        ("differs", "t", head + "but it ends on its own"), ("one", "t", head + "and it ends so"), ("two", "u", head), ("entity", "t", head + "caf&eacute; &amp; more"),
        ("several", "t", head + "and it ends so"), ("several", "t", head + "its second text"), ("short", "t", "and it ends so"), (None, "t", None),
    ]
    docs = [("d1", "t", "x " + head + "and it ends so, y"), ("d2", "t", head + "café & more"), ("d3", "t", head + "its second text"), ("d4", "u", head), ("d5", "u", head + "z"), ("d6", None, head)]
    table(spark, tmp_path, "article_sections", sections, "id string, title string, text string")
    table(spark, tmp_path, "corpus", docs, "_id string, title string, text string")
    got = [(r.answer_id, r.title, r.doc_id) for r in Q.containment_texts(spark, str(tmp_path)).collect()]
    assert sorted(got) == [("entity", "t", "d2"), ("one", "t", "d1"), ("several", "t", "d1"), ("several", "t", "d3")]
