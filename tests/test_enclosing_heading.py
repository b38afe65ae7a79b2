from corpusloom.plans import registry


def nodes(plan):
    children = plan.children()
    return [plan, *(x for i in range(children.size()) for x in nodes(children.apply(i)))]


def test_pages_stay_in_their_scan(spark, tmp_path):
    """Neither the shuffle that makes rows distinct nor the rows that wait for a Python worker hold a page."""
    page = "<h1>A</h1>" + "".join(f"<h2><b>{x}</b> &amp; more</h2><p>{'text ' * 40}</p>" for x in "one two three".split())
    late = page.replace("one", "uno") + " "
    data = [("a", page), ("a", page), ("b", page), ("a", late), ("a", page + "<p>1</p>"), ("c", "<p>none</p>"), ("d", ""), ("e", None), (None, page)]
    rows = [(i, (None if i is None else i.upper(), None, h)) for i, h in data]
    spark.createDataFrame(rows, "id string, document struct<title string, url string, html string>").write.parquet(str(tmp_path / "nq_source.parquet"))
    df = registry.QUERIES["enclosing_heading"](spark, str(tmp_path))
    for node in nodes(df._jdf.queryExecution().optimizedPlan()):
        if node.nodeName() in ("Aggregate", "ArrowEvalPython", "BatchEvalPython"):
            below = node.children().apply(0).output()
            assert not {below.apply(i).name() for i in range(below.size())} & {"html", "document"}
    # a row a different page of an id, whether or not its section is another
    want = [("a", "two & more")] * 3 + [("b", "two & more"), ("c", "summary"), ("d", "summary")]
    assert sorted(map(tuple, df.collect())) == want
