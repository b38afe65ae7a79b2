import html
import re
from urllib.parse import quote

from pyspark.sql import functions as F

from corpusloom.functions import decisions as D
from corpusloom.functions import text as X
from corpusloom.functions import titles

NASTY = ["Category: A b ", " x_y\t", "", None, "a/b\\c..", "100% (pure) ~*+é", "H _{ 2 } O", "See [12] and [ note 3 ] [edit]", "n th root", "is given by", "Thus", "x" * 3000, "AT&amp;T &lt;b&gt;"]


def _all(spark, values, **columns):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [tuple(r)[1:] for r in rows.select("i", *[c.alias(k) for k, c in columns.items()]).orderBy("i").collect()]


def test_titles(spark):
    got = _all(spark, NASTY, a=titles.category_title("x"), b=titles.underscore_then_strip("x"), c=titles.space_then_strip("x"), d=titles.percent_encoded("x"))
    for value, (a, b, c, d) in zip(NASTY, got):
        if value is None:
            assert (a, b, c, d) == (None, None, "", None)
            continue
        assert a == re.sub("^Category:", "", value.strip()).replace(" ", "_")
        assert b == value.replace(" ", "_").strip()
        assert c == value.replace("_", " ").strip()
        assert d == quote(value, safe="/:_()")


def test_urls_and_ids(spark):
    urls = ["http://x/?title=A%20b&amp;oldid=12", "no", None, "?oldid=", "http://a b/?oldid=%zz", "?a=1&oldid=7#top"]
    got = _all(spark, urls, o=titles.old_id("x"), t=titles.query_param("x", "title"))
    assert got == [("12", "A b"), ("no_oldid", None), ("no_oldid", None), ("no_oldid", None), ("%zz", None), ("7", None)]
    assert _all(spark, ["  a//b  c ", "..__", None], s=titles.safe_part("x")) == [("a_b_c",), ("untitled",), ("untitled",)]
    parsed = _all(spark, ["A__oldid_b__oldid_3"], p=titles.parse_article_id("x"), k=titles.article_key("x"))
    assert tuple(parsed[0][0]) == ("A__oldid_b", "3") and parsed[0][1] == "A"


def _tidy(t):
    for a, b in ((r"\s+([,.;:!?%)\]])", r"\1"), (r"([(\[])\s+", r"\1"), (r"\s+([_^]\{)", r"\1"), (r"([_^]\{)\s+", r"\1"), (r"\s+\}", "}")):
        t = re.sub(a, b, t)
    return t


def test_match_key_and_clean(spark):
    got = _all(spark, NASTY, k=X.match_key("x"), c=X.clean_text("x"))
    for value, (k, c) in zip(NASTY, got):
        assert k == _tidy(re.sub(r"\s+", " ", html.unescape(value or "").lower()).strip())
        if value is None:
            assert c is None
    assert _all(spark, ["See [12, 14] the n th ( one ) . [edit] edit"], c=X.clean_text("x")) == [("See the nth (one).",)]
    assert _all(spark, ["{\\displaystyle x^{2}}", "y" * 161, None], c=X.latex_alt("x")) == [("x^{2}",), ("",), ("",)]


def test_sections_and_intro(spark):
    got = _all(spark, ["the law is given by ", "therefore", "It reads well", None], b=X.is_bad_intro("x"))
    assert got == [(True,), (True,), (False,), (False,)]
    page = "<p>á</p><h2><span class=\"mw-headline\">Uses</span></h2><p>x</p><h2>See also</h2><p>y</p>"
    cut = [page.encode().index(b"x"), page.encode().index(b"y<"), 0]
    rows = spark.createDataFrame([(page, c) for c in cut], "h string, s int").select(X.enclosing_section("h", F.col("s")).alias("n")).collect()
    assert [r.n for r in rows] == ["Uses", None, "summary"]
    long_ = "<p>" + "words and more words of an answer " * 3 + "</p>"
    assert _all(spark, [long_, "<table>" + long_, "short"], a=X.answer_text("x"))[1:] == [(None,), (None,)]
    assert spark.createDataFrame([("aé",)], "h string").select(X.bytes_slice("h", F.lit(1), F.lit(2)).alias("b")).first().b == "�"


def test_decisions(spark):
    got = _all(spark, ["2", " 3 ", "2.7", "x", None, "9", "-4"], s=D.clamp_score("x"))
    assert [g[0] for g in got] == [2, 3, 0, 0, 0, 3, 0]
    got = _all(spark, [" Keep", "borderline", "??", None], s=D.category_label("x"), a=D.article_label("x"))
    assert got == [("keep", "keep"), ("mixed", "drop"), ("drop", "drop"), ("drop", "drop")]
    replies = ['{"a": 1}', 'so {"a": 2} !', "[1]", "none", None]
    got = _all(spark, replies, v=F.try_variant_get(D.json_object("x"), "$.a", "int"))
    assert [g[0] for g in got] == [1, 2, None, None, None]


def test_answers(spark):
    kind = "a struct<long_answer: array<struct<start_token: int, start_byte: int, end_byte: int, candidate_index: int>>, short_answers: array<struct<text: array<string>>>, yes_no_answer: array<string>>"
    rows = [
        (([(-1, -1, -1, -1)], [(["x", "", None],), (None,)], ["NONE"]),), (([(5, 3, 9, 0), (5, 9, 3, 0), (5, 1, 2, -1)], None, None),),
        ((None, [([""],)], ["yes"]),), (None,), (([], [], []),),
    ]
    got = spark.createDataFrame(rows, kind).select(D.has_answer("a").alias("h"), F.size(D.valid_long_answers("a")).alias("n"), D.short_answers("a").alias("s")).collect()
    assert [tuple(r) for r in got] == [(True, 0, ["x"]), (True, 1, []), (True, 0, []), (False, 0, []), (False, 0, [])]
