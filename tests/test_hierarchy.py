import random

import pytest

from corpusloom.operators import hierarchy as H

CATS = "category_title string, path array<string>, title string"
EDGES = "parent_category string, child_category string, ord bigint, node string"


def brute(nodes, links):
    down = {}
    for a, b in links:
        down.setdefault(a, set()).add(b)

    def reach(starts):
        seen, todo = set(), list(starts)
        while todo:
            for y in down.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    roots = nodes - {b for _, b in links}
    return {n for n in nodes if n in reach([n])}, nodes - roots - reach(roots), roots


@pytest.mark.parametrize("seed,rest", [(11, None), (12, None), (12, 2)])
def test_random_graph(spark, monkeypatch, seed, rest):
    if rest:  # more levels, and the colouring of the core
        monkeypatch.setattr(H, "REST_ROWS", rest)
    rng = random.Random(seed)
    names = [f"N {i}" for i in range(40)]
    pairs = {(rng.choice(names), rng.choice(names)) for _ in range(38)} | {("N 0", "N 1"), ("N 1", "N 2"), ("N 2", "N 1"), ("N 3", "N 3")}
    forms = [str, lambda x: f" Category:{x} ", lambda x: x.replace(" ", "_")]
    rows = [(rng.choice(forms)(a), rng.choice(forms)(b), i, "clash") for i, (a, b) in enumerate(sorted(pairs))]
    edges = spark.createDataFrame([*rows, rows[0], (None, "N 5", 1, None), ("N 6", None, 1, None)], EDGES)
    cats = spark.createDataFrame([("lonely", None, "t"), ("N_1", ["x", "N_1"], "t"), (None, ["a"], None), ("N 0", [], None)], CATS)
    nodes, links = H.graph(cats, edges)
    want = {(a.replace(" ", "_"), b.replace(" ", "_")) for a, b in pairs}
    all_ = {x for p in want for x in p} | {"lonely", "N_1", "N_0", "N_5", "N_6"}
    cycle, rootless, roots = brute(all_, want)
    assert {r.node for r in nodes.collect()} == all_
    assert {r.node for r in H.cycle_nodes(links).collect()} == cycle
    tree = {r.node: r for r in H.hierarchy(nodes, links).collect()}
    assert {n for n, r in tree.items() if r.root is None} == rootless and set(tree) == all_
    for n, r in tree.items():
        if r.root is not None:
            assert r.path[0] == r.root and r.root in roots and r.path[-1] == n and r.depth == len(r.path) - 1 and len(set(r.path)) == len(r.path)
            assert all(p in want for p in zip(r.path, r.path[1:]))
    kinds = {(r.category_title, r.kind) for r in H.found(cats, edges).collect()}
    assert kinds == {(n, "cycle") for n in cycle} | {(n, "rootless") for n in rootless} | {("N_1", "path"), ("N_0", "path")}


def test_deep_chain_and_descendants(spark):
    rows = [(f"c{i}", f"c{i + 1}", i, None) for i in range(70)]
    nodes, links = H.graph(None, spark.createDataFrame(rows, EDGES))
    tree = H.hierarchy(nodes, links)
    assert tree.where("node = 'c70'").first().depth == 70
    below = H.descendants(tree)
    assert below.where("node = 'c0'").count() == 70 and below.count() == 70 * 71 // 2


def test_stored_paths(spark):
    edges = spark.createDataFrame([("a", "b", 0, None), ("b", "c", 1, None)], EDGES)
    paths = {"c": ["Category:a", " b ", "c"], "b": ["b"], "a": ["a"]}
    cats = spark.createDataFrame([*[(k, v, None) for k, v in paths.items()], ("c", ["a", "c"], None), ("c", [None], None)], CATS)
    assert sorted(r.node for r in H.bad_paths(cats, H.graph(cats, edges)[1]).collect()) == ["b", "c"]


def test_empty(spark):
    cats, edges = spark.createDataFrame([], CATS), spark.createDataFrame([], EDGES)
    assert H.found(cats, edges).count() == 0
    assert H.hierarchy(*H.graph(cats, edges)).count() == 0
