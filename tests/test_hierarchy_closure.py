import random

import pytest

from corpusloom.operators import hierarchy as H
from corpusloom.plans import hierarchy_queries as Q

EDGES = "parent_category string, child_category string, ord bigint"


def brute(links):
    down = {}
    for a, b in links:
        down.setdefault(a, set()).add(b)
    out = set()
    for start in down:
        seen, level, distance = set(), {start}, 0
        while level:
            distance += 1
            level = {y for x in level for y in down.get(x, ())} - seen
            seen |= level
            out |= {(start, y, distance) for y in level}
    return out


@pytest.mark.parametrize("merge_rows,small", [(None, 1_000), (None, 5), (5, 5)])
def test_closure(spark, monkeypatch, merge_rows, small):
    monkeypatch.setattr(H, "SMALL_ROWS", small)
    rng = random.Random(3)
    names = [f"n{i}" for i in range(60)]
    pairs = {(rng.choice(names), rng.choice(names)) for _ in range(70)} | {(f"c{i}", f"c{i + 1}") for i in range(14)}
    pairs |= {("top", "x"), ("other", "x"), ("x", "y"), ("l1", "l2"), ("l2", "l1"), ("l2", "low"), ("self", "self")}
    links = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(sorted(pairs))], "parent string, child string, ord bigint")
    rows = [tuple(r) for r in H.closure(links, merge_rows).select("node", "descendant", "distance").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(pairs)
    assert H.closure(links.limit(0), merge_rows).count() == 0


def test_queries_follow_all_links(spark, tmp_path):
    edges = [("top", "mid", 0), ("other", "mid", 1), ("mid", "leaf", 2), ("l1", "l2", 3), ("l2", "l1", 4), ("l2", "low", 5)]
    spark.createDataFrame(edges, EDGES).write.parquet(str(tmp_path / "category_edges.parquet"))
    spark.createDataFrame([("alone", None)], "category_title string, path array<string>").write.parquet(str(tmp_path / "categories.parquet"))
    got = {(r.node, r.descendant, r.distance) for r in Q.p3_descendants(spark, str(tmp_path)).collect()}
    assert got == brute({(a, b) for a, b, _ in edges}) and ("other", "leaf", 2) in got and ("l1", "low", 2) in got
    tree = {r.category_title: r for r in Q.p3_hierarchy(spark, str(tmp_path)).collect()}
    assert {k: r.n_descendants for k, r in tree.items()} == {"top": 2, "other": 2, "mid": 1, "leaf": 0, "l1": 3, "l2": 3, "low": 0, "alone": 0}
    assert tree["leaf"].path == ["top", "mid", "leaf"] and tree["low"].path is None
