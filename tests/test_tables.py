import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import titles
from corpusloom.operators import curate, html_sections, ordinal, retrieval


def test_first_and_latest(spark):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("a", 1, "b"), (None, 1, "z"), ("b", None, "q")], "k string, o int, v string")
    assert {(r.k, r.v) for r in ordinal.first_wins(rows, ["k"], ["o"]).collect()} == {("a", "b"), ("b", "q")}
    assert {(r.k, r.v) for r in ordinal.latest_wins(rows, ["k"], ["o"]).collect()} == {("a", "x"), ("b", "q")}
    assert {r.k for r in ordinal.ever_valid(rows, "k", "o").collect()} == {"a"}


def test_dense_ids_and_blocks(spark):
    rows = spark.range(500).select((F.col("id") * 7 % 500).alias("n"), (F.col("id") % 3).alias("g")).repartition(7)
    got = {r.n: r.dense_id for r in ordinal.dense_ids(rows, ["n"], "test").collect()}
    assert got == {i: f"test{i}" for i in range(500)}
    blocks = ordinal.block_index(rows, "g", ["n"]).where("g = 1").orderBy("n").collect()
    assert [r.block_no for r in blocks] == list(range(len(blocks)))
    assert ordinal.dense_ids(rows.limit(0), ["n"], "t").count() == 0


def test_ordered_list(spark):
    rows = spark.createDataFrame([(2, "b"), (1, "a"), (3, "a")], "o int, v string")
    r = rows.agg(ordinal.ordered_list("v", "o").alias("l"), ordinal.ordered_list("v", "o", True).alias("d")).first()
    assert r.l == ["a", "b", "a"] and r.d == ["a", "b"]


def test_pending_before_limit(spark):
    rows = spark.createDataFrame([(i,) for i in range(10)], "id int")
    done = spark.createDataFrame([(i,) for i in range(5)], "id int")
    assert [r.id for r in curate.pending(rows, done, "id", ["id"], 2).collect()] == [5, 6]


def test_title_sets_and_flags(spark):
    wanted = curate.title_set(spark.createDataFrame([("A b",), (None,), ("C_d",)], "t string"), "t")
    assert {r.title for r in wanted.collect()} == {"A b", "A_b", "C_d", "C d"}
    rows = spark.createDataFrame([("A_b", 1), ("C d", 2), ("x", 3), (None, 4)], "title string, n int")
    assert {r.n for r in curate.in_title_set(rows, "title", wanted).collect()} == {1, 2}
    ids = spark.createDataFrame([(3,), (1,)], "k int")
    got = curate.flagged_union(rows, {"by_n": ("n", ids), "by_t": ("title", spark.createDataFrame([("A_b",)], "k string"))})
    assert {(r.n, r.by_n, r.by_t) for r in got.collect()} == {(1, True, True), (3, True, False)}


def test_containment_needs_one_hit(spark):
    a = "the answer is long enough to be looked for in texts"
    answers = spark.createDataFrame([("q1", "t", a), ("q2", "t", "short"), ("q3", "u", a)], "answer_id string, k string, answer_key string")
    docs = spark.createDataFrame([("d1", "t", "x " + a), ("d1", "t", a), ("d2", "u", a), ("d3", "u", a + "!")], "doc_id string, k string, doc_key string")
    assert [tuple(r) for r in curate.containment(answers, docs, "k").collect()] == [("q1", "d1")]


def test_set_gate(spark):
    a, b = spark.range(5), spark.range(1, 6)
    r = curate.set_report(a, b, "id", "x").first()
    assert (r.n_a, r.n_b, r.only_a, r.only_b, r.common) == (5, 5, 1, 1, 4)
    curate.assert_equal_sets(a, a, "id", "same")
    with pytest.raises(ValueError):
        curate.assert_equal_sets(a, b, "id", "x")


def test_profile_of_empty_table(spark):
    r = curate.profile(spark.createDataFrame([], "i string, a string, t string"), "i", "a", "t").first()
    assert r.rows_ == 0 and r.min_len is None


PAGE = """<html><head><title>T - Wiki</title></head><body><p>outside</p><div class="mw-parser-output">
<p>The lead of this article is long enough to stay.<sup class="reference">[1]</sup> H<sub>2</sub>O</p>
<table><tr><td>skipped</td></tr></table>
<h2>Uses</h2><ul><li>first use of it in a list</li><li>second use of it in a list</li></ul><h3>Deep</h3><p>More on its uses.</p>
<h3>See also</h3><p>dropped text</p><h2>Stub</h2><p>Too short</p><h2>References</h2><p>never reached, although it is long enough for a section</p></div></body></html>"""


def test_sections(spark):
    pages = spark.createDataFrame([("T__oldid_5", PAGE, 1), ("E__oldid_1", "", 1), ("N__oldid_1", None, 1), (None, PAGE, 1)], "article_id string, html string, title int")
    rows = html_sections.extract_sections(pages).orderBy("block_index").collect()
    assert [r.section for r in rows] == ["summary", "Uses"]
    assert rows[0].text == "The lead of this article is long enough to stay. H_{2} O" and rows[0].section_path == ["Lead"] and rows[0].title == "T"
    assert rows[1].text == "- first use of it in a list - second use of it in a list More on its uses." and rows[1].subsections == ["Deep"]
    assert rows[0].id == "T__oldid_5::b0000" and rows[0].oldid == "5"


def test_resolve_questions(spark):
    body = PAGE.encode()
    start = body.index(b"More on")
    kind = "id string, article_id string, annotations struct<long_answer: array<struct<start_token: int, start_byte: int, end_byte: int, candidate_index: int>>>"
    la = [(1, start, start + 20, 0)]
    q = spark.createDataFrame([("keep", "T__oldid_5", (la,)), ("title", "X__oldid_5", (la,)), ("none", "T__oldid_5", ([],)), ("page", "T__oldid_6", (la,)), ("gone", "T__oldid_5", ([(1, body.index(b"never"), body.index(b"never") + 9, 0)],))], kind)
    pages = spark.createDataFrame([("T__oldid_5", PAGE)], "article_id string, html string")
    sections = html_sections.extract_sections(pages).selectExpr("id AS doc_id", "article_key", "section", "text")
    got = {r.id: (r.reason, r.doc_id) for r in curate.resolve_questions(q, sections, pages).collect()}
    assert got == {"keep": ("kept", "T__oldid_5::b0001"), "title": ("no_corpus_title", None), "none": ("no_long_answer", None), "page": ("missing_html", None), "gone": ("dropped_section_only", None)}


def test_topk_and_metrics(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(40, 8)).astype("float32")
    rows = [(i, m[i].tolist()) for i in range(40)] + [(99, None), (98, [0.0] * 8), (97, [1.0])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = retrieval.topk(vectors.where("vec_id < 5"), vectors, 3).collect()
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(5):
        s = np.round(unit.astype(float) @ unit[q].astype(float), 9)
        s[q] = -9
        want = sorted(range(40), key=lambda i: (-s[i], i))[:3]
        assert [r.doc_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 10, 1)], "query_id bigint, doc_id bigint, rank int")
    qrels = spark.createDataFrame([(1, 11), (1, 50), (2, 77), (1, 11)], "query_id bigint, doc_id bigint")
    r = {x.query_id: x for x in retrieval.ranking_metrics(ranked, qrels).collect()}
    assert r[1].mrr_at_10 == 0.5 and r[1].recall_at_3 == 0.5 and abs(r[1].map_at_100 - 0.25) < 1e-12
    assert abs(r[1].ndcg_at_10 - (1 / np.log2(3)) / (1 + 1 / np.log2(3))) < 1e-9 and r[2].ndcg_at_10 == 0


def test_long_scores_and_encoder(spark):
    results = spark.createDataFrame([("m-1", "r", "t", {"test": {"ndcg": 0.5}})], "model_name string, model_revision string, task_name string, scores map<string,map<string,double>>")
    assert retrieval.long_scores(results).withColumn("f", retrieval.family("model_name")).first().asDict() == {"model_name": "m-1", "model_revision": "r", "task_name": "t", "split": "test", "metric": "ndcg", "value": 0.5, "f": "m"}
    out = retrieval.encode_texts(spark.createDataFrame([("ab",), (None,)], "t string"), "t", lambda xs: [[float(len(x)), 1.0] for x in xs], 2)
    assert {r.t: r.embedding for r in out.collect()} == {"ab": [2.0, 1.0], None: None}


def test_title_columns_survive_extra_columns(spark):
    rows = spark.createDataFrame([("A b", "x", "y")], "title string, k string, __row string")
    assert rows.select(titles.display_or("k", "title").alias("d")).first().d == "x"
