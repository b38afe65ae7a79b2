"""Payloads, decision rows, fatal errors, page files, summaries, sources that must not lose rows."""

import gzip
import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import decisions, models, payloads
from corpusloom.operators import curate, graph, retrieval
from corpusloom.sources import arrow_stream, files, jsonl
from corpusloom.streaming import incremental

PROMPT = payloads.Prompt("You label pages.", "Classify this:", "label_page", "v2")


def body(payload):
    lead, rest = payload.split("\n", 1)
    assert lead == PROMPT.lead
    return json.loads(rest)


def test_category_payload(spark):
    links = spark.createDataFrame([("Top", f"Child_{i:02d}", i) for i in range(15)] + [("Root", "Top", 0)], "parent string, child string, ord bigint")
    members = spark.createDataFrame([("Top", "An_article", 0)], "parent string, article string, ord bigint")
    nodes = spark.createDataFrame([("Top", "u", 1, ["Root", "Top"], 3, 15, None)], "node string, category_url string, depth int, path array<string>, cat_pages int, cat_subcats int, cat_files int")
    near = graph.neighbourhood(nodes, links, members)
    extracts = spark.createDataFrame([("Top", "e" * 1500)], "node string, extract string")
    got = body(payloads.category_payloads(near, nodes, extracts, PROMPT).first().payload)
    local = got["local_graph_context"]
    assert got["task"] == "label_page" and len(got["fetched_wikipedia_context"]["wikipedia_intro_extract"]) == 1000
    assert [x["category_title"] for x in local["child_category_sample"]] == [f"Child_{i:02d}" for i in range(12)]
    assert local["parent_categories"] == [{"category_title": "Root", "category_display_title": "Root"}] and local["direct_article_sample"][0]["article_display_title"] == "An article"
    assert local["bfs_counts"] == {"cat_pages": 3, "cat_subcats": 15, "cat_files": None} and near.first().n_children == 15


def test_article_payload_is_minimal(spark):
    rows = spark.createDataFrame([("Titration", 1, ["A", "Titration"], None)], "t string, d int, p array<string>, x string")
    got = body(rows.select(payloads.article_payload(F.col("t"), F.col("d"), F.col("p"), F.col("x"), PROMPT).alias("y")).first().y)
    assert got == {"task": "label_page", "article": {"article_title": "Titration", "bfs_depth": 1, "path": ["A", "Titration"]}, "fetched_wikipedia_context": {"wikipedia_intro_extract": ""}}


def test_usage(spark):
    raw = [{"prompt_tokens": 11, "completion_tokens": 7, "total_tokens": 18, "completion_tokens_details": {"reasoning_tokens": 3}}, {"reasoning_tokens": 4, "completion_tokens_detail": {"reasoning_tokens": 9}}]
    rows = spark.createDataFrame([(json.dumps(x),) for x in raw] + [(None,), ("[",)], "u string").select(payloads.usage("u").alias("u")).select("u.*").collect()
    assert tuple(rows[0])[:4] == (11, 7, 18, 3) and json.loads(rows[0].raw_usage) == raw[0]
    assert rows[1].reasoning_tokens == 4 and rows[2].raw_usage == "{}" and tuple(rows[3])[:4] == (None,) * 4


def test_decision_rows(spark):
    calls = spark.createDataFrame([("A_b", 2, True, '{"label": "keep", "score": "3"}', None), ("C", 1, False, None, "refused")], "category_title string, depth int, ok boolean, reply string, error string")
    v = decisions.json_object("reply")
    fields = decisions.category_decision(F.try_variant_get(v, "$.label", "string"), F.try_variant_get(v, "$.score", "string"))
    (row,) = payloads.decision_rows(calls, "category_title", fields, ["depth"], "some-model", PROMPT, "low").collect()
    assert (row.category_title, row.category_display_title, row.label, row.confidence_score, row.depth, row.model, row.prompt_version, row.reasoning_effort) == ("A_b", "A b", "keep", 3, 2, "some-model", "v2", "low")


def test_one_fatal_row_stops_the_rest(spark, tmp_path):
    stop = str(tmp_path / "stop")

    def model(prompt, brief):
        if prompt == "5":
            raise models.ModelError("no credit", 402)
        return prompt

    rows = spark.createDataFrame([(str(i),) for i in range(20)], "p string").coalesce(1)
    got = models.classify(rows, "p", model, stop=stop).collect()
    assert [r.p for r in got] == [str(i) for i in range(6)] and [r.error for r in got if not r.ok] == ["fatal: no credit"] and files.exists(stop)
    assert models.classify(rows, "p", model, stop=stop).count() == 0
    with pytest.raises(Exception, match="no credit"):
        models.classify(rows, "p", model).collect()


def test_root_category(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "category_title string, depth int")
    first = lambda df: [r.node for r in graph.root_category(df).collect()]
    assert first(rows(("B", 0), ("Chemistry", 3), ("A", 0))) == ["Chemistry"] and first(rows(("B", 0), ("C", 0), ("A", 1))) == ["B"]
    assert first(rows(("B", 2), ("A", None), (None, 0))) == ["A"] and first(rows()) == []


def test_summary_and_pages(spark, tmp_path):
    path = "file:" + str(tmp_path / "sub" / "summary.json")
    jsonl.write_summary({"b": 1, "a": {"é": None}}, path)
    assert (tmp_path / "sub" / "summary.json").read_text(encoding="utf-8") == '{\n  "a": {\n    "é": null\n  },\n  "b": 1\n}\n'
    pages = spark.createDataFrame([("T", "http://x/?oldid=1", "<p>1</p>"), ("T", "http://x/?oldid=1", "<p>1</p>"), ("T", "http://x/?oldid=1&a=2", "<p>other</p>"), ("T", "http://x/?oldid=2", "<p>2</p>"), ("U", "", "x"), ("V", "u", None)], "title string, url string, html string")
    done = {r.article_id: r.written for r in jsonl.write_pages(pages, str(tmp_path / "html")).collect()}
    assert done == {"T__oldid_1": True, "T__oldid_2": True} and (tmp_path / "html" / "T__oldid_1.html").read_text() == "<p>1</p>"
    assert not any(r.written for r in jsonl.write_pages(pages, str(tmp_path / "html")).collect())
    assert files.listed(str(tmp_path / "html") + "/*.html") == [str(tmp_path / "html" / f"T__oldid_{i}.html") for i in (1, 2)]


def test_fragments_and_orders(spark):
    rows = spark.createDataFrame([("a", "t", "x <p>y"), ("b", "t", "MW-x and mw-x"), ("c", "t", "p < 3"), ("d", "t", "[ edit ]"), ("e", None, None)], "id string, title string, text string")
    assert curate.profile(rows, "id", "title", "text").first().bad_fragments == 3
    order = [r.id for r in curate.in_seeded_order(rows, "id", 3).collect()]
    assert sorted(order) == list("abcde") and order == [r.id for r in curate.in_seeded_order(rows, "id", 3).collect()] != [r.id for r in curate.in_seeded_order(rows, "id", 4).collect()]
    assert [r.id for r in curate.preferred_first(rows, "id", rows.where("id IN ('d', 'c')")).collect()] == list("cdabe")


def stream(tmp_path, damage=None, cut=0):
    """One Arrow stream in three gzip parts; ``damage`` is a part of which a byte is changed, ``cut`` bytes are lost at the end."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("x", pa.int64())])) as writer:
        for i in range(30):
            writer.write_batch(pa.record_batch([pa.array(range(i * 100, i * 100 + 100))], names=["x"]))
    data = sink.getvalue().to_pybytes()
    data = data[: len(data) - cut]
    size = len(data) // 3 + 1
    paths = []
    for i in range(3):
        part = bytearray(gzip.compress(data[i * size : (i + 1) * size]))
        if damage == i:
            part[len(part) // 2] ^= 0xFF
        paths.append(str(tmp_path / f"part{i}.gz"))
        (tmp_path / f"part{i}.gz").write_bytes(bytes(part))
    return paths


def test_arrow_end_marks_are_tolerated_and_damage_is_not(tmp_path):
    rows = lambda paths: sum(b.num_rows for b in arrow_stream.batches(paths))
    assert rows(stream(tmp_path)) == 3000
    assert rows(stream(tmp_path, cut=8)) == 3000  # the end mark is missing
    assert rows(stream(tmp_path, cut=200)) == 2900  # the stream breaks off in its last batch
    for part in (0, 1):
        with pytest.raises(Exception):  # noqa: B017
            rows(stream(tmp_path, damage=part))
    data = bytearray(b"".join(gzip.decompress(open(p, "rb").read()) for p in stream(tmp_path)))
    at = data.index(b"\xff\xff\xff\xff", len(data) // 2)
    data[at + 8 : at + 40] = b"\x01" * 32  # broken in the middle, in a part that unpacks well
    (tmp_path / "whole.gz").write_bytes(gzip.compress(bytes(data)))
    with pytest.raises(Exception):  # noqa: B017
        rows([str(tmp_path / "whole.gz")])


def test_work_of_a_stream_runs_once(spark, tmp_path):
    source, target, calls = str(tmp_path / "in"), str(tmp_path / "out"), spark.sparkContext.accumulator(0)
    rows = spark.createDataFrame([(str(i), i) for i in range(10)], "id string, ord bigint")
    rows.coalesce(1).write.parquet(source)

    def work(df):
        def run(batches):
            for b in batches:
                calls.add(len(b))
                yield b

        return df.mapInPandas(run, df.schema)

    assert incremental.run_stream(spark, source, rows.schema, "file:" + target, str(tmp_path / "cp"), "id", "ord", work) == 10
    assert calls.value == 10
    assert incremental.run_stream(spark, source, rows.schema, "file:" + target, str(tmp_path / "cp2"), "id", "ord", work) == 0


def test_topk_with_many_blocks_and_ties(spark, monkeypatch):
    import random

    rng = random.Random(5)
    vectors = [[float(rng.randint(-2, 2)) for _ in range(3)] for _ in range(120)]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(500, None), (501, [0.0, 0.0, 0.0]), (502, [1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")

    def brute(k):
        norm = lambda v: sum(x * x for x in v) ** 0.5
        out = set()
        for q, a in enumerate(vectors):
            if q % 2 or not norm(a):
                continue
            s = [(-round(sum(x * y for x, y in zip(a, b)) / norm(a) / norm(b), 9), i) for i, b in enumerate(vectors) if i != q and norm(b)]
            out |= {(q, i, n + 1) for n, (_, i) in enumerate(sorted(s)[:k])}
        return out

    want = brute(7)
    for block, step, most in ((4096, 1024, 2_000_000), (3, 5, 10)):  # more blocks than partitions
        for name, value in (("BLOCK", block), ("STEP", step), ("TASK_DOCS", most)):
            monkeypatch.setattr(retrieval, name, value)
        got = retrieval.topk(df.where("vec_id % 2 = 0 AND vec_id < 500"), df, 7)
        assert {(r.query_id, r.doc_id, r["rank"]) for r in got.collect()} == want


def test_metrics_by_label(spark):
    docs = spark.createDataFrame([(i, i % 3) for i in range(12)], "id bigint, label int")
    queries = docs.where("id < 4")
    ranked = spark.createDataFrame([(q, d, n + 1) for q in range(4) for n, d in enumerate([x for x in range(12) if x != q][:9])], "query_id bigint, doc_id bigint, rank int")
    pairs = queries.alias("q").join(docs.alias("d"), "label").where("q.id <> d.id").select(F.col("q.id").alias("query_id"), F.col("d.id").alias("doc_id"))
    one, two = (sorted(map(tuple, df.collect())) for df in (retrieval.metrics_by_label(ranked, queries, docs), retrieval.ranking_metrics(ranked, pairs)))
    assert one == two and len(one) == 4


def test_pruned_dump_scan(spark, tmp_path):
    from corpusloom.sources import mysqldump

    (tmp_path / "d.sql").write_text("INSERT INTO `page` VALUES (1,0,'A'),(2,0,'B'),(3,NULL,'C'),(4);\n")
    scan = lambda *a: [(r.ord, r["values"][0]) for r in mysqldump.scan(spark, str(tmp_path / "*.sql"), "page", *a).collect()]
    assert scan() == [(0, "1"), (1, "2"), (2, "3"), (3, "4")] and scan(2, ["B", "C", "x"]) == [(1, "2"), (2, "3")] and scan(1, [None]) == [(2, "3")] and scan(0, []) == []


def test_time_budget_and_progress(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for i in range(3):
        spark.createDataFrame([(str(i), i)], "id string, ord bigint").coalesce(1).write.mode("append").parquet(source)
    schema, rows = spark.read.parquet(source).schema, []
    run = lambda **k: incremental.run_stream(spark, source, schema, target, state, "id", "ord", files_per_batch=1, **k)
    assert run(seconds=0) == 0 and run(progress=rows) == 3 and [r["added"] for r in rows] == [1, 2, 3] and run(seconds=60) == 0


def test_scores_and_questions_of_any_json_type(spark):
    scores = {"2": 2, "2.7": 2, '"2.7"': 0, '" 3 "': 3, "true": 1, "false": 0, "null": 0, "[1]": 0, "9": 3, "-1": 0, "x": 0}
    questions = {'"why?"': "why?", '{"text": "why?", "n": 1}': "why?", '{"n": 1}': None, "3": None, "{": None}
    rows = spark.createDataFrame([(x,) for x in [*scores, *questions, None]], "v string").select("v", decisions.clamp_score_json("v").alias("s"), decisions.question_text("v").alias("q")).collect()
    assert {r.v: r.s for r in rows if r.v in scores} == scores and {r.v: r.q for r in rows if r.v in questions} == questions
    assert [(r.s, r.q) for r in rows if r.v is None] == [(0, None)]


def test_lookup_and_shard_marks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "id string, n int")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert [r.n for r in curate.lookup(rows, ids("b", "b", None), "id").collect()] == [2]
    with pytest.raises(KeyError, match="c"):
        curate.lookup(rows, ids("a", "c"), "id")
    assert incremental.open_shards(str(tmp_path), ["x", "y", "z"]) == ["x", "y", "z"]
    incremental.mark_done(str(tmp_path), ["x", "z"])
    assert incremental.open_shards(str(tmp_path), ["x", "y", "z"]) == ["y"]
