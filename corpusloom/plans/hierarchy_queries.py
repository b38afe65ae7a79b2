"""Queries on the category graph of the data folder (problem 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import hierarchy
from corpusloom.session import load


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return hierarchy.graph(load(spark, sf_dir, "categories"), load(spark, sf_dir, "category_edges"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories in loops, without a root, or with a wrong stored path."""
    return hierarchy.found(load(spark, sf_dir, "categories"), load(spark, sf_dir, "category_edges"))


def p3_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root, depth and primary path of every category, and the number of its descendants over all links."""
    nodes, links = _graph(spark, sf_dir)
    below = hierarchy.closure(links).groupBy("node").agg(F.count("*").alias("n_descendants"))
    return hierarchy.hierarchy(nodes, links).join(below, "node", "left").select(
        F.col("node").alias("category_title"), "root", "depth", "path", F.coalesce("n_descendants", F.lit(0)).alias("n_descendants")
    )


def p3_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All descendants of every category over all links, with the fewest links between."""
    return hierarchy.closure(_graph(spark, sf_dir)[1])


QUERIES = {"p3_found": p3_found, "p3_hierarchy": p3_hierarchy, "p3_descendants": p3_descendants}


def _norm(x: str) -> str:
    strip = lambda y: f"regexp_replace({y}, '^[\\s_]+|[\\s_]+$', '', 'g')"
    return f"nullif(replace({strip(f"regexp_replace({strip(x)}, '^Category:', '')")}, ' ', '_'), '')"


P3_FOUND_SQL = f"""WITH RECURSIVE ends AS (SELECT {_norm('parent_category')} AS parent, {_norm('child_category')} AS child FROM category_edges),
links AS (SELECT DISTINCT parent, child FROM ends WHERE parent IS NOT NULL AND child IS NOT NULL),
nodes AS (SELECT parent AS node FROM ends WHERE parent IS NOT NULL UNION SELECT child FROM ends WHERE child IS NOT NULL UNION SELECT {_norm('category_title')} FROM categories),
reach AS (SELECT parent AS a, child AS b FROM links UNION SELECT r.a, l.child FROM reach r JOIN links l ON l.parent = r.b),
roots AS (SELECT node FROM nodes WHERE node NOT IN (SELECT child FROM links)),
rooted AS (SELECT node FROM roots UNION SELECT b FROM reach WHERE a IN (SELECT node FROM roots)),
stored AS (SELECT DISTINCT {_norm('category_title')} AS node, list_transform(path, lambda x: {_norm('x')}) AS steps FROM categories WHERE path IS NOT NULL),
pairs AS (SELECT node, steps, unnest(list_zip(steps[:-2], steps[2:])) AS pair FROM stored WHERE len(steps) > 1),
broken AS (SELECT node FROM pairs WHERE NOT EXISTS (SELECT 1 FROM links WHERE parent = pair[1] AND child = pair[2]))
SELECT DISTINCT a AS category_title, 'cycle' AS kind FROM reach WHERE a = b
UNION SELECT node, 'rootless' FROM nodes WHERE node NOT IN (SELECT node FROM rooted)
UNION SELECT node, 'path' FROM stored WHERE len(steps) = 0 OR coalesce(steps[-1] <> node, true) OR steps[1] NOT IN (SELECT node FROM roots)
UNION SELECT node, 'path' FROM broken"""

P3_DESCENDANTS_SQL = f"""WITH RECURSIVE ends AS (SELECT {_norm('parent_category')} AS parent, {_norm('child_category')} AS child FROM category_edges),
links AS (SELECT DISTINCT parent, child FROM ends WHERE parent IS NOT NULL AND child IS NOT NULL),
size_ AS (SELECT count(DISTINCT child) AS n FROM links),
reach AS (SELECT parent AS a, child AS b, 1 AS d FROM links UNION SELECT r.a, l.child, r.d + 1 FROM reach r JOIN links l ON l.parent = r.b WHERE r.d < (SELECT n FROM size_))
SELECT a AS node, b AS descendant, min(d)::INT AS distance FROM reach GROUP BY a, b"""

SQL: dict[str, str] = {"p3_found": P3_FOUND_SQL, "p3_descendants": P3_DESCENDANTS_SQL}
