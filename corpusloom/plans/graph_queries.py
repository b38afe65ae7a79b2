"""Queries of the graph operators on the category tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import decisions as D
from corpusloom.functions import titles
from corpusloom.operators import curate, graph, hierarchy
from corpusloom.session import checkpoint, load

DEPTH = 5


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpoint(
        load(spark, sf_dir, "category_edges").select(hierarchy.title("parent_category").alias("parent"), hierarchy.title("child_category").alias("child"), "ord")
        .where("parent IS NOT NULL AND child IS NOT NULL").groupBy("parent", "child").agg(F.min("ord").alias("ord"))
    )


def _root(links: DataFrame) -> DataFrame:
    """The node without parents that has most children; the smallest title on ties."""
    tops = links.join(links.select(F.col("child").alias("parent")).distinct(), "parent", "left_anti")
    return tops.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "node").limit(1).select("node")


def _decisions(spark: SparkSession, sf_dir: str, root: DataFrame) -> DataFrame:
    """Stand-in labels from the page figures; the root is kept with score 3."""
    rows = load(spark, sf_dir, "categories").select(hierarchy.title("category_title").alias("node"), F.coalesce("page_len", F.lit(0)).alias("page_len"), F.coalesce("cat_subcats", F.lit(0)).alias("cat_subcats"))
    rows = rows.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("page_len", "cat_subcats")).alias("f"))
    raw = F.element_at(F.array(F.lit("keep"), F.lit("Borderline "), F.lit("drop")), (F.col("f.page_len") % 3 + 1).cast("int"))
    top = rows.join(F.broadcast(root.withColumn("top", F.lit(True))), "node", "left")
    label, score = F.when(F.col("top"), "keep").otherwise(raw), F.when(F.col("top"), 3).otherwise(F.col("f.cat_subcats") % 4)
    return checkpoint(top.select("node", *[c.alias(k) for k, c in D.category_decision(label, score).items()]))


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "article_members").select(hierarchy.title("parent_category").alias("parent"), hierarchy.title("article_title").alias("article"), "ord").where("article IS NOT NULL")


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _links(spark, sf_dir)
    root = checkpoint(_root(links))
    return graph.gated_reachability(links, root, _decisions(spark, sf_dir, root))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = _members(spark, sf_dir)
    return graph.candidates(members, members, _gated(spark, sf_dir))


def bfs_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes within five links of the root."""
    links = _links(spark, sf_dir)
    return graph.bfs(links, _root(links), DEPTH).select("node", "depth")


def bfs_first_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-seen parent and path of each."""
    links = _links(spark, sf_dir)
    return graph.bfs(links, _root(links), DEPTH).select("node", "depth", "first_parent", F.concat_ws(">", "path").alias("path"))


def bfs_depth_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New nodes and emitted links per depth (F1)."""
    links = _links(spark, sf_dir)
    levels = checkpoint(graph.bfs(links, _root(links), DEPTH))
    new = levels.groupBy("depth").agg(F.count("*").alias("new_nodes"))
    emitted = graph.emitted_edges(links, levels, DEPTH).groupBy("depth").agg(F.count("*").alias("edges"))
    return new.join(emitted, "depth", "left").select("depth", "new_nodes", F.coalesce("edges", F.lit(0)).alias("edges"))


def gated_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branch status of every node."""
    return _gated(spark, sf_dir).select("node", "reachable", "opens", "contributes", "label")


def branch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of branch states (F2)."""
    return _gated(spark, sf_dir).agg(
        F.count("*").alias("nodes"), F.count_if("reachable").alias("reachable"), F.count_if("opens").alias("opening"),
        F.count_if("contributes").alias("contributing"), F.count_if(F.col("reachable") & (F.col("label") == "drop")).alias("closed"),
    )


def candidate_tristate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate status of every article."""
    return _candidates(spark, sf_dir)


def candidate_plan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles per candidate status."""
    return _candidates(spark, sf_dir).groupBy("candidate_status").agg(F.count("*").alias("articles"))


def final_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected articles with their provenance (J4, D10, E7); reviews from the page lengths."""
    reviews = (
        load(spark, sf_dir, "article_members").select(hierarchy.title("article_title").alias("article"), F.coalesce("page_len", F.lit(0)).alias("page_len")).where("article IS NOT NULL")
        .groupBy("article").agg(F.max("page_len").alias("m"))
        .select("article", D.article_label(F.when(F.col("m") % 2 == 0, "Keep").otherwise("no")).alias("label"), D.clamp_score(F.col("m") % 5).alias("confidence_score"))
    )
    return graph.final_selection(_candidates(spark, sf_dir), reviews)


def neighbourhood_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 12 parents, children and articles of every category."""
    links = _links(spark, sf_dir)
    nodes = links.select(F.col("parent").alias("node")).union(links.select("child"))
    out = graph.neighbourhood(nodes, links, _members(spark, sf_dir))
    joined = {k: F.concat_ws("|", k).alias(k) for k in ("parents", "children", "articles")}
    return out.select("node", *joined.values(), *[F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in joined])


def link_reason_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership links by the first reason to leave them out."""
    known = load(spark, sf_dir, "categories").select(hierarchy.title("category_title").alias("parent")).where("parent IS NOT NULL").distinct().withColumn("known", F.lit(True))
    rows = load(spark, sf_dir, "article_members").distinct().withColumn("parent", hierarchy.title("parent_category")).join(known, "parent", "left")
    rules = [("no_parent", F.col("parent").isNull()), ("unresolved", F.col("known").isNull()), ("redirect", F.col("is_redirect")), ("no_url", F.col("article_url").isNull()), ("empty_page", F.coalesce("page_len", F.lit(0)) == 0)]
    return rows.groupBy(curate.reason_codes(rows, rules).alias("reason")).agg(F.count("*").alias("links"))


def metadata_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of each child category, null where it is unknown."""
    meta = load(spark, sf_dir, "categories").select(hierarchy.title("category_title").alias("child"), "cat_pages", "cat_subcats").where("child IS NOT NULL").groupBy("child").agg(F.min(F.struct("cat_pages", "cat_subcats")).alias("m"))
    return _links(spark, sf_dir).select("child").distinct().join(meta, "child", "left").select("child", "m.cat_pages", "m.cat_subcats", F.coalesce(F.col("m.cat_pages") - F.col("m.cat_subcats"), F.lit(0)).alias("estimate"))


def normalize_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All forms of every raw title."""
    edges = load(spark, sf_dir, "category_edges")
    raw = edges.select(F.col("parent_category").alias("raw")).union(edges.select("child_category")).where("raw IS NOT NULL").distinct()
    return raw.select(
        "raw", titles.category_title("raw").alias("graph_form"), titles.display_title(titles.category_title("raw")).alias("display"),
        titles.underscore_then_strip("raw").alias("underscore_form"), titles.space_then_strip("raw").alias("space_form"),
        titles.display_or(F.when(F.length("raw") % 2 == 0, ""), "raw").alias("fallback"),
    )


def root_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root that a graph is walked from, if none is named: the preferred title, a title of depth 0, or any (H6)."""
    return graph.root_category(load(spark, sf_dir, "categories"))


QUERIES = {f.__name__: f for f in (
    bfs_levels, bfs_first_parent, bfs_depth_metrics, gated_reachability, branch_summary, candidate_tristate, candidate_plan_summary,
    final_articles, neighbourhood_sample, link_reason_codes, metadata_left_join, normalize_titles, root_choice,
)}


def _norm(x: str) -> str:
    strip = lambda y: f"regexp_replace({y}, '^[\\s_]+|[\\s_]+$', '', 'g')"
    inner = strip(f"regexp_replace({strip(x)}, '^Category:', '')")
    return f"nullif(replace({inner}, ' ', '_'), '')"


_LINKS = f"""links AS (
  SELECT parent, child, min(ord) AS ord FROM (
    SELECT {_norm('parent_category')} AS parent, {_norm('child_category')} AS child, ord FROM category_edges)
  WHERE parent IS NOT NULL AND child IS NOT NULL GROUP BY parent, child),
root AS (
  SELECT parent AS node FROM links WHERE parent NOT IN (SELECT child FROM links)
  GROUP BY parent ORDER BY count(*) DESC, parent LIMIT 1)"""

_LEVELS = f"""{_LINKS},
walk AS (
  SELECT node, 0 AS depth FROM root
  UNION
  SELECT l.child, w.depth + 1 FROM walk w JOIN links l ON l.parent = w.node WHERE w.depth < {DEPTH}),
levels AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node)"""

_DECISIONS = f"""raw AS (
  SELECT {_norm('category_title')} AS node, coalesce(page_len, 0) AS page_len, coalesce(cat_subcats, 0) AS cat_subcats FROM categories),
figures AS (
  SELECT node, page_len, cat_subcats FROM (
    SELECT *, row_number() OVER (PARTITION BY node ORDER BY page_len, cat_subcats) AS r FROM raw WHERE node IS NOT NULL) WHERE r = 1),
labelled AS (
  SELECT node, CASE WHEN node IN (SELECT node FROM root) OR page_len % 3 = 0 THEN 'keep' WHEN page_len % 3 = 1 THEN 'mixed' ELSE 'drop' END AS label,
    CASE WHEN node IN (SELECT node FROM root) THEN 3 ELSE cat_subcats % 4 END AS score FROM figures),
decided AS (SELECT node, label, label <> 'drop' AS expand, label = 'keep' AND score >= 2 AS include FROM labelled)"""

_STATUS = f"""{_LINKS},
{_DECISIONS},
reached AS (
  SELECT node FROM root
  UNION
  SELECT l.child FROM reached r JOIN links l ON l.parent = r.node JOIN decided d ON d.node = r.node WHERE d.expand),
nodes AS (SELECT parent AS node FROM links UNION SELECT child FROM links UNION SELECT node FROM decided UNION SELECT node FROM root),
status AS (
  SELECT n.node, r.node IS NOT NULL AS reachable, r.node IS NOT NULL AND coalesce(d.expand, false) AS opens,
    r.node IS NOT NULL AND coalesce(d.label = 'keep' AND d.include, false) AS contributes, coalesce(d.label, 'drop') AS label, coalesce(d.include, false) AS include
  FROM nodes n LEFT JOIN reached r USING (node) LEFT JOIN decided d USING (node))"""

_MEMBERS = f"""members AS (
  SELECT {_norm('parent_category')} AS parent, {_norm('article_title')} AS article, ord, page_len FROM article_members WHERE {_norm('article_title')} IS NOT NULL)"""

_CANDIDATES = f"""{_STATUS},
{_MEMBERS},
evidence AS (
  SELECT m.article, count(*) FILTER (s.label = 'keep' AND s.include) AS keep_categories,
    count(*) FILTER (s.label IN ('keep', 'mixed') AND NOT (s.label = 'keep' AND s.include)) AS review_categories, count(*) AS reachable_categories
  FROM (SELECT DISTINCT parent, article FROM members) m JOIN status s ON s.node = m.parent WHERE s.reachable GROUP BY m.article),
candidates AS (
  SELECT a.article, CASE WHEN coalesce(keep_categories, 0) > 0 THEN 'auto_keep_candidate' WHEN coalesce(review_categories, 0) > 0 THEN 'needs_article_review'
    ELSE 'auto_drop_context' END AS candidate_status, coalesce(keep_categories, 0) AS keep_categories, coalesce(review_categories, 0) AS review_categories,
    coalesce(reachable_categories, 0) AS reachable_categories
  FROM (SELECT DISTINCT article FROM members) a LEFT JOIN evidence e USING (article))"""


def _side(table: str, key: str, value: str, name: str) -> str:
    return f"""{name} AS (
  SELECT {key} AS node, string_agg({value}, '|' ORDER BY rank) FILTER (rank <= 12) AS {name}, count(*) AS n_{name} FROM (
    SELECT {key}, {value}, row_number() OVER (PARTITION BY {key} ORDER BY ord, {value}) AS rank FROM (
      SELECT {key}, {value}, min(ord) AS ord FROM {table} WHERE {key} IS NOT NULL AND {value} IS NOT NULL GROUP BY ALL)) GROUP BY {key})"""


SQL = {
    "bfs_levels": f"WITH RECURSIVE {_LEVELS} SELECT node, depth FROM levels",
    "bfs_first_parent": f"""WITH RECURSIVE {_LEVELS},
firsts AS (
  SELECT node, depth, parent FROM (
    SELECT v.node, v.depth, l.parent, row_number() OVER (PARTITION BY v.node ORDER BY l.ord, l.parent) AS r
    FROM levels v JOIN links l ON l.child = v.node JOIN levels u ON u.node = l.parent AND u.depth = v.depth - 1) WHERE r = 1),
paths AS (
  SELECT node, 0 AS depth, CAST(NULL AS VARCHAR) AS first_parent, node AS path FROM root
  UNION ALL
  SELECT f.node, f.depth, f.parent, p.path || '>' || f.node FROM paths p JOIN firsts f ON f.parent = p.node)
SELECT node, depth, first_parent, path FROM paths""",
    "bfs_depth_metrics": f"""WITH RECURSIVE {_LEVELS},
emitted AS (SELECT v.depth + 1 AS depth, count(*) AS edges FROM links l JOIN levels v ON v.node = l.parent WHERE v.depth < {DEPTH} GROUP BY 1)
SELECT v.depth, count(*) AS new_nodes, coalesce(max(e.edges), 0) AS edges FROM levels v LEFT JOIN emitted e ON e.depth = v.depth GROUP BY v.depth""",
    "gated_reachability": f"WITH RECURSIVE {_STATUS} SELECT node, reachable, opens, contributes, label FROM status",
    "branch_summary": f"""WITH RECURSIVE {_STATUS}
SELECT count(*) AS nodes, count(*) FILTER (reachable) AS reachable, count(*) FILTER (opens) AS opening, count(*) FILTER (contributes) AS contributing,
  count(*) FILTER (reachable AND label = 'drop') AS closed FROM status""",
    "candidate_tristate": f"WITH RECURSIVE {_CANDIDATES} SELECT * FROM candidates",
    "candidate_plan_summary": f"WITH RECURSIVE {_CANDIDATES} SELECT candidate_status, count(*) AS articles FROM candidates GROUP BY candidate_status",
    "final_articles": f"""WITH RECURSIVE {_CANDIDATES},
longest AS (SELECT article, max(coalesce(page_len, 0)) AS m FROM members GROUP BY article),
reviews AS (SELECT article, m % 2 = 0 AS keep, least(3, m % 5) AS score FROM longest)
SELECT c.article, CASE WHEN candidate_status = 'auto_keep_candidate' THEN 'category' ELSE 'review' END AS inclusion_source, candidate_status,
  CASE WHEN keep_categories > 0 THEN keep_categories ELSE review_categories END AS supporting_categories
FROM candidates c LEFT JOIN reviews r USING (article)
WHERE candidate_status = 'auto_keep_candidate' OR (candidate_status = 'needs_article_review' AND r.keep AND r.score >= 2)""",
    "neighbourhood_sample": f"""WITH {_LINKS},
{_MEMBERS},
{_side('links', 'child', 'parent', 'parents')},
{_side('links', 'parent', 'child', 'children')},
{_side('members', 'parent', 'article', 'articles')}
SELECT n.node, coalesce(parents, '') AS parents, coalesce(children, '') AS children, coalesce(articles, '') AS articles,
  coalesce(n_parents, 0) AS n_parents, coalesce(n_children, 0) AS n_children, coalesce(n_articles, 0) AS n_articles
FROM (SELECT parent AS node FROM links UNION SELECT child FROM links) n
LEFT JOIN parents USING (node) LEFT JOIN children USING (node) LEFT JOIN articles USING (node)""",
    "root_choice": """SELECT category_title AS node FROM categories WHERE category_title IS NOT NULL
ORDER BY CASE WHEN category_title = 'Chemistry' THEN 0 WHEN depth = 0 THEN 1 ELSE 2 END, category_title LIMIT 1""",
    "link_reason_codes": f"""WITH known AS (SELECT DISTINCT {_norm('category_title')} AS parent FROM categories),
rows_ AS (SELECT DISTINCT * FROM article_members), m AS (SELECT *, {_norm('parent_category')} AS parent FROM rows_)
SELECT CASE WHEN m.parent IS NULL THEN 'no_parent' WHEN k.parent IS NULL THEN 'unresolved' WHEN is_redirect THEN 'redirect' WHEN article_url IS NULL THEN 'no_url'
  WHEN coalesce(page_len, 0) = 0 THEN 'empty_page' ELSE 'ok' END AS reason, count(*) AS links
FROM m LEFT JOIN known k ON k.parent = m.parent GROUP BY 1""",
    "metadata_left_join": f"""WITH {_LINKS},
meta AS (
  SELECT child, cat_pages, cat_subcats FROM (
    SELECT *, row_number() OVER (PARTITION BY child ORDER BY cat_pages NULLS FIRST, cat_subcats NULLS FIRST) AS r FROM (
      SELECT {_norm('category_title')} AS child, cat_pages, cat_subcats FROM categories)) WHERE r = 1 AND child IS NOT NULL)
SELECT l.child, cat_pages, cat_subcats, coalesce(cat_pages - cat_subcats, 0) AS estimate FROM (SELECT DISTINCT child FROM links) l LEFT JOIN meta USING (child)""",
    "normalize_titles": r"""WITH raws AS (
  SELECT parent_category AS raw FROM category_edges UNION SELECT child_category FROM category_edges),
forms AS (SELECT raw, replace(regexp_replace(regexp_replace(raw, '^\s+|\s+$', '', 'g'), '^Category:', ''), ' ', '_') AS graph_form FROM raws WHERE raw IS NOT NULL)
SELECT raw, graph_form, replace(graph_form, '_', ' ') AS display, regexp_replace(replace(raw, ' ', '_'), '^\s+|\s+$', '', 'g') AS underscore_form,
  regexp_replace(replace(raw, '_', ' '), '^\s+|\s+$', '', 'g') AS space_form, replace(raw, '_', ' ') AS fallback FROM forms""",
}
