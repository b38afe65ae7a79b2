import gzip
import io

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import models
from corpusloom.sources import arrow_stream, jsonl, mysqldump
from corpusloom.streaming import incremental

SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.LongType())])


def test_jsonl(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"id": "1", "n": 2}\n\n{"id": null}\n')
    assert jsonl.read_strict(spark, str(path), SCHEMA).count() == 2
    assert [r.line_no for r in jsonl.read_numbered(spark, str(path), SCHEMA).collect()] == [1, 3]
    path.write_text('{"id": "1", "n": 2}\nbroken\n{"n": 1}\n')
    assert jsonl.read_lenient(spark, str(path), SCHEMA, "id").count() == 1
    with pytest.raises(Exception):
        jsonl.read_strict(spark, str(path), SCHEMA).collect()
    assert jsonl.read_optional(spark, str(tmp_path / "none"), SCHEMA).count() == 0
    assert jsonl.resolve(str(path)) == str(path)
    with gzip.open(str(path) + ".gz", "wt") as f:
        f.write("{}")
    with pytest.raises(ValueError):
        jsonl.resolve(str(path))
    with pytest.raises(FileNotFoundError):
        jsonl.resolve(str(tmp_path / "none"))


def test_write_modes_and_nulls(spark, tmp_path):
    df = spark.createDataFrame([("é", None), ("b", 1)], SCHEMA)
    out = str(tmp_path / "out")
    assert jsonl.write(df, out, single=True) == 2
    assert '{"id":"é","n":null}' in "".join(p.read_text() for p in (tmp_path / "out").glob("*.json"))
    with pytest.raises(Exception):
        jsonl.write(df, out)
    assert jsonl.write(df, out, mode="append", gz=True) == 2 and jsonl.read_strict(spark, out, SCHEMA).count() == 4
    jsonl.write(df, out, mode="overwrite")
    assert jsonl.read_strict(spark, out, SCHEMA).count() == 2


def test_arrays_with_split(spark, tmp_path):
    (tmp_path / "mteb_dev_matches.json").write_text('[{"id": "a", "n": 1}, {"id": "b", "n": 2}]')
    rows = jsonl.read_arrays(spark, [str(tmp_path / "mteb_dev_matches.json")], SCHEMA).collect()
    assert {(r.id, r.split) for r in rows} == {("a", "dev"), ("b", "dev")}


def test_load_graph(spark, tmp_path):
    (tmp_path / "categories.jsonl").write_text('{"category_title": "A", "depth": 1}\n{"category_title": "A", "depth": 2}\n')
    (tmp_path / "articles.jsonl").write_text('{"article_title": "x"}\n')
    (tmp_path / "category_edges.jsonl").write_text('{"parent_category": "A", "child_category": "B"}\n' * 2)
    with gzip.open(tmp_path / "article_members.jsonl.gz", "wt") as f:
        f.write('{"parent_category": "A", "article_title": "x"}\n')
    g = jsonl.load_graph(spark, str(tmp_path))
    assert g["categories"].first().depth == 2 and g["edges"].count() == 1 and g["members"].count() == 1


DUMP = b"""-- x
INSERT INTO `other` VALUES (1);
INSERT INTO `page` VALUES (1,0,'A\\'s (x), \\\\ \\"q\\"','',0,0,0,0.5,'2017',NULL,7,120),(2,14,'NULL','',0,1,0,0.5,'2017',NULL,7,NULL),(3,0,'short');
INSERT INTO `page` VALUES (4,0,'it''s','',0,0,0,0.5,'2017',NULL,7,5);
"""
LINKS = b"INSERT INTO `categorylinks` VALUES (1,'C','k','t','','x','page'),(2,'C','k','t','','x','subcat'),(9,'C','k','t','','x','page'),(1,'C','k','t','','x','file'),(1,'D','k','t','','x','page'),(4,'C','k','t','','x','subcat');\n"
SIZES = b"INSERT INTO `category` VALUES (1,'C',10,3,2),(2,'C',99,0,0),(3,'short');\n"


def test_mysqldump(spark, tmp_path):
    for name, data in (("page", DUMP), ("links", LINKS), ("sizes", SIZES)):
        with gzip.open(tmp_path / f"{name}.sql.gz", "wb") as f:
            f.write(data)
    pages = mysqldump.pages(mysqldump.scan(spark, str(tmp_path / "page.sql.gz"), "page"))
    rows = {r.page_id: r for r in pages.collect()}
    assert set(rows) == {1, 2, 4} and rows[1].title == "A's (x), \\ \"q\"" and rows[2].title == "NULL" and rows[2].page_len is None and rows[2].is_redirect
    assert rows[4].title == "it's"
    links = mysqldump.category_links(mysqldump.scan(spark, str(tmp_path / "links.sql.gz"), "categorylinks"))
    hit, counts = mysqldump.members(links, spark.createDataFrame([("C",)], "title string"))
    assert {r.kind: r.n for r in counts.collect()} == {"page": 2, "subcat": 2, "ignored_file": 1}
    reasons = {(r.cl_from, r.cl_type): r.reason for r in mysqldump.resolved(hit, pages).collect()}
    assert reasons == {(1, "page"): "ok", (9, "page"): "unresolved", (2, "subcat"): "redirect", (4, "subcat"): "namespace"}
    size = mysqldump.category_sizes(mysqldump.scan(spark, str(tmp_path / "sizes.sql.gz"), "category")).collect()
    assert [(r.cat_title, r.cat_article_members_estimate) for r in size] == [("C", 5)]
    with pytest.raises(ValueError):
        list(mysqldump.rows_of(iter([b"INSERT INTO `t` VALUES (1,'x"]), "t"))


def test_arrow_parts(spark, tmp_path):
    sink = io.BytesIO()
    table = pa.table({"id": ["a", "b", "c"], "n": [1, 2, 3]})
    with pa.ipc.new_stream(sink, table.schema) as writer:
        for batch in table.to_batches(max_chunksize=1):
            writer.write_batch(batch)
    data = sink.getvalue()
    for i in range(3):
        with gzip.open(tmp_path / f"p{i}.gz", "wb") as f:
            f.write(data[i * len(data) // 3 : (i + 1) * len(data) // 3])
    spark.dataSource.register(arrow_stream.ArrowParts)
    rows = spark.read.format("arrowparts").schema("id string, n bigint").load(str(tmp_path / "p*.gz"))
    assert {(r.id, r.n) for r in rows.collect()} == {("a", 1), ("b", 2), ("c", 3)}
    with gzip.open(tmp_path / "cut.gz", "wb") as f:
        f.write(data[:-30])
    assert sum(b.num_rows for b in arrow_stream.batches([str(tmp_path / "cut.gz")])) >= 1


def test_stream_resumes(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    rows = lambda data: spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    rows([("a", 2), ("a", 1), (None, 3)])
    assert incremental.run_stream(spark, source, SCHEMA, target, state, "id", "n") == 1
    rows([("a", 0), ("b", 5)])
    assert incremental.run_stream(spark, source, SCHEMA, target, state, "id", "n") == 1
    assert incremental.run_stream(spark, source, SCHEMA, target, state, "id", "n") == 0
    assert {(r.id, r.n) for r in spark.read.parquet(target).collect()} == {("a", 1), ("b", 5)}


def test_cache(spark):
    cache = spark.createDataFrame([("a", 1, "ok", "A"), ("b", 1, "error", None), ("a", 2, "error", None)], "k string, fetched_at int, status string, v string")
    wanted = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "k string")
    hits, fetched = incremental.through_cache(wanted, cache, "k", lambda keys: keys.withColumn("v", F.upper("k")))
    assert [r.v for r in hits.collect()] == ["A"] and [r.k for r in fetched.collect()] == ["b"]


def test_model_calls(spark):
    waits = []
    seen = []

    def flaky(prompt, brief):
        seen.append(brief)
        if len(seen) == 1:
            raise models.ModelError("busy", 429)
        if len(seen) == 2:
            raise models.ModelError("cut", truncated=True)
        return "fine" if brief else "no"

    assert models.call(flaky, "p", 3, None, waits.append) == (True, "fine", None, 3) and waits == [1.0, 2.0] and seen == [False, False, True]
    assert models.call(lambda p, b: "", "p", 2, bool, waits.append)[:3] == (False, None, "invalid reply")
    with pytest.raises(models.FatalModelError):
        models.call(lambda p, b: (_ for _ in ()).throw(models.ModelError("pay", 402)), "p", 3, None, waits.append)

    def model(prompt, brief):
        if "bad" in prompt:
            raise ValueError if False else models.ModelError("refused", 400)
        return prompt.upper()

    rows = spark.createDataFrame([("x",), ("bad",), (None,)], "p string")
    got = {r.p: (r.ok, r.reply, r.error) for r in models.classify(rows, "p", model, concurrency=2).collect()}
    assert got == {"x": (True, "X", None), "bad": (False, None, "refused"), None: (False, None, "null prompt")}
    got = {r.p: r.status for r in models.enrich(rows, "p", lambda k: model(k, False)).collect()}
    assert got == {"x": "ok", "bad": "error"}
