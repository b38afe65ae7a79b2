import random

from corpusloom.functions import decisions as D
from corpusloom.operators import graph

LINKS = [("Chemistry", "Analytical_chemistry", 0), ("Chemistry", "Materials_science", 1), ("Chemistry", "Chemists", 2), ("Chemists", "Women_chemists", 3)]
DECIDED = [("Chemistry", "keep", "3"), ("Analytical_chemistry", "keep", "3"), ("Materials_science", "mixed", "2"), ("Chemists", "drop", "0"), ("Women_chemists", "drop", "0")]
MEMBERS = [("Analytical_chemistry", "Titration"), ("Analytical_chemistry", "Polymer"), ("Materials_science", "Composite_material"), ("Materials_science", "Polymer"), ("Chemists", "Marie_Curie"), ("Women_chemists", "Marie_Curie")]


def _fixture(spark, extra=(), members=()):
    links = spark.createDataFrame([*LINKS, *[(p, c, 9) for p, c, *_ in extra]], "parent string, child string, ord bigint")
    raw = spark.createDataFrame([*DECIDED, *[(c, label, score) for _, c, label, score in extra]], "node string, label string, score string")
    decided = raw.select("node", *[c.alias(k) for k, c in D.category_decision("label", "score").items()])
    root = spark.createDataFrame([("Chemistry",)], "node string")
    return links, root, decided, spark.createDataFrame([*MEMBERS, *members], "parent string, article string")


def test_gated_reachability_and_candidates(spark):
    links, root, decided, members = _fixture(spark)
    status = graph.gated_reachability(links, root, decided)
    rows = {r.node: r for r in status.collect()}
    assert {n for n, r in rows.items() if r.reachable} == {"Chemistry", "Analytical_chemistry", "Materials_science", "Chemists"}
    assert {n for n, r in rows.items() if r.opens} == {"Chemistry", "Analytical_chemistry", "Materials_science"}
    got = {r.article: r.candidate_status for r in graph.candidates(members, members, status).collect()}
    assert got == {"Titration": "auto_keep_candidate", "Polymer": "auto_keep_candidate", "Composite_material": "needs_article_review", "Marie_Curie": "auto_drop_context"}
    reviews = spark.createDataFrame([("Composite_material", "keep", 2), ("Polymer", "keep", 1)], "article string, label string, confidence_score int")
    final = {r.article: r.inclusion_source for r in graph.final_selection(graph.candidates(members, members, status), reviews).collect()}
    assert final == {"Titration": "category", "Polymer": "category", "Composite_material": "review"}


def test_weak_keep_is_reviewed(spark):
    links, root, decided, members = _fixture(spark, [("Chemistry", "Weak_keep", "keep", "1")], [("Weak_keep", "Ambiguous_article")])
    got = graph.candidates(members, members, graph.gated_reachability(links, root, decided))
    assert got.where("article = 'Ambiguous_article'").first().candidate_status == "needs_article_review"


def test_bfs_against_brute_force(spark):
    rng = random.Random(3)
    edges = {(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(60)}
    rows = [(a, b, i) for i, (a, b) in enumerate(sorted(edges))]
    links = spark.createDataFrame([*rows, (None, "x", 1), ("n0", None, 1), rows[0]], "parent string, child string, ord bigint")
    got = {r.node: r for r in graph.bfs(links, spark.createDataFrame([("n0",)], "node string"), 4).collect()}
    depth, frontier = {"n0": 0}, ["n0"]
    for d in range(1, 5):
        frontier = sorted({b for a, b, _ in rows if a in frontier and b not in depth})
        depth |= dict.fromkeys(frontier, d)
    assert {n: r.depth for n, r in got.items()} == depth
    for n, r in got.items():
        assert len(r.path) == r.depth + 1 and r.path[-1] == n and r.path[0] == "n0"
        if r.depth:
            assert r.first_parent == min((o, a) for a, b, o in rows if b == n and depth.get(a) == r.depth - 1)[1]


def test_empty_tables(spark):
    links = spark.createDataFrame([], "parent string, child string, ord bigint")
    root = spark.createDataFrame([], "node string")
    decided = spark.createDataFrame([], "node string, label string, expand_descendants boolean, include_direct_articles boolean")
    assert graph.bfs(links, root, 3).count() == 0
    assert graph.gated_reachability(links, root, decided).count() == 0


def test_neighbourhood_sample(spark):
    links = spark.createDataFrame([("a", f"c{i:02d}", 20 - i) for i in range(20)], "parent string, child string, ord bigint")
    members = spark.createDataFrame([("a", None, 1), (None, "x", 1), ("a", "art", None)], "parent string, article string, ord bigint")
    row = graph.neighbourhood(spark.createDataFrame([("a",), ("z",)], "node string"), links, members).where("node = 'a'").first()
    assert row.children == [f"c{i:02d}" for i in range(19, 7, -1)] and row.n_children == 20 and row.articles == ["art"] and row.parents is None
