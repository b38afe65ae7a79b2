"""Bounded breadth-first search and label-gated reachability over link tables.

Both loops hold their state in checkpointed tables, so lineage does not grow and a lost executor costs one level.
Each level is one join of the links with the frontier and one anti join; the driver only sees counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.hierarchy import near
from corpusloom.session import checkpoint, sized


def bfs(links: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """``node, depth, first_parent, path`` of all nodes within ``max_depth`` links of the seeds.

    ``links`` has parent, child and ord; ``seeds`` has node. The first parent of a node is that of its first link, by
    (ord, parent), among the parents of the level before. Loops end by themselves; null ends are left out.
    """
    links = checkpoint(links.where("parent IS NOT NULL AND child IS NOT NULL").groupBy("parent", "child").agg(F.min("ord").alias("ord")))
    first = seeds.where("node IS NOT NULL").distinct().select("node", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("first_parent"), F.array("node").alias("path"))
    seen, count, size = sized(first, ["node", "path"])
    frontier = seen
    for depth in range(1, max_depth + 1):
        step = links.join(near(frontier.select(F.col("node").alias("parent"), "path"), count, size), "parent")
        fresh = step.join(seen.select(F.col("node").alias("child")), "child", "left_anti")
        frontier, count, size = sized(
            fresh.groupBy("child").agg(F.min(F.struct("ord", "parent", "path")).alias("first"))
            .select(F.col("child").alias("node"), F.lit(depth).alias("depth"), F.col("first.parent").alias("first_parent"), F.concat("first.path", F.array("child")).alias("path")), ["node", "path"]
        )
        if not count:
            break
        seen = checkpoint(seen.union(frontier))
    return seen


def emitted_edges(links: DataFrame, levels: DataFrame, max_depth: int) -> DataFrame:
    """Every link of an expanded node with the depth of its expansion, links to nodes already seen included."""
    return links.join(levels.where(F.col("depth") < max_depth).select(F.col("node").alias("parent"), (F.col("depth") + 1).alias("depth")), "parent")


def gated_reachability(links: DataFrame, root: DataFrame, decisions: DataFrame) -> DataFrame:
    """``node, reachable, opens, contributes, label`` of all nodes of links, decisions and root.

    A node opens its children if it is reachable, its decision expands and its label is not drop; reachable is the
    least fixpoint from the root. Nodes without a decision are dropped ones. ``decisions`` has node, label,
    expand_descendants, include_direct_articles, one row a node.
    """
    links = links.where("parent IS NOT NULL AND child IS NOT NULL").select("parent", "child").distinct()
    opening = checkpoint(decisions.where("expand_descendants AND label <> 'drop'").select("node"))
    gates = checkpoint(links.join(opening.withColumnRenamed("node", "parent"), "parent", "left_semi"))
    reached, count, size = sized(root.select("node").distinct(), ["node"])
    frontier = reached
    while count:
        step = gates.join(near(frontier.withColumnRenamed("node", "parent"), count, size), "parent", "left_semi").select(F.col("child").alias("node")).distinct()
        frontier, count, size = sized(step.join(reached, "node", "left_anti"), ["node"])
        if count:
            reached = checkpoint(reached.union(frontier))
    nodes = links.select(F.col("parent").alias("node")).union(links.select("child")).union(decisions.select("node")).union(root.select("node")).distinct()
    status = nodes.join(reached.withColumn("reachable", F.lit(True)), "node", "left").join(decisions, "node", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    label = F.coalesce("label", F.lit("drop"))
    return status.select(
        "node", yes(F.col("reachable")).alias("reachable"),
        (yes(F.col("reachable")) & yes(F.col("expand_descendants")) & (label != "drop")).alias("opens"),
        (yes(F.col("reachable")) & (label == "keep") & yes(F.col("include_direct_articles"))).alias("contributes"),
        label.alias("label"), yes(F.col("include_direct_articles")).alias("include_direct_articles"),
    )


def candidates(articles: DataFrame, members: DataFrame, status: DataFrame) -> DataFrame:
    """``article, candidate_status, keep_categories, review_categories`` of each article.

    A reachable category that keeps and includes makes auto_keep_candidate; else a reachable one that keeps or is
    mixed makes needs_article_review; else auto_drop_context. ``members`` has parent and article.
    """
    kind = F.when(~F.col("reachable"), None).when((F.col("label") == "keep") & F.col("include_direct_articles"), 2).when(F.col("label").isin("keep", "mixed"), 1).otherwise(0)
    ranked = status.select(F.col("node").alias("parent"), kind.alias("kind")).where("kind IS NOT NULL")
    evidence = (
        members.select("parent", "article").distinct().join(ranked, "parent")
        .groupBy("article").agg(
            F.count_if(F.col("kind") == 2).alias("keep_categories"), F.count_if(F.col("kind") == 1).alias("review_categories"),
            F.count("*").alias("reachable_categories"),
        )
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = articles.select("article").distinct().join(evidence, "article", "left")
    return out.select(
        "article",
        F.when(zero(F.col("keep_categories")) > 0, "auto_keep_candidate").when(zero(F.col("review_categories")) > 0, "needs_article_review").otherwise("auto_drop_context").alias("candidate_status"),
        zero(F.col("keep_categories")).alias("keep_categories"), zero(F.col("review_categories")).alias("review_categories"), zero(F.col("reachable_categories")).alias("reachable_categories"),
    )


def final_selection(candidate_rows: DataFrame, reviews: DataFrame, least_score: int = 2) -> DataFrame:
    """Articles kept by their categories, or by a review with label keep and at least ``least_score``."""
    joined = candidate_rows.join(reviews.select("article", F.col("label").alias("review_label"), F.col("confidence_score").alias("review_score")), "article", "left")
    auto = F.col("candidate_status") == "auto_keep_candidate"
    by_review = (F.col("candidate_status") == "needs_article_review") & (F.col("review_label") == "keep") & (F.col("review_score") >= least_score)
    return joined.where(auto | F.coalesce(by_review, F.lit(False))).select(
        "article", F.when(auto, "category").otherwise("review").alias("inclusion_source"), "candidate_status",
        F.when(F.col("keep_categories") > 0, F.col("keep_categories")).otherwise(F.col("review_categories")).alias("supporting_categories"),
    )


def neighbourhood(nodes: DataFrame, links: DataFrame, members: DataFrame, most: int = 12) -> DataFrame:
    """Up to ``most`` parents, children and articles of each node, in order of (ord, name), and how many there are.

    The cut is the feature: a sample for a prompt.
    """

    def side(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
        from pyspark.sql import Window

        one = df.where(f"{key} IS NOT NULL AND {value} IS NOT NULL").groupBy(key, value).agg(F.min("ord").alias("ord"))
        # the limit on the rank is applied before the shuffle too, so that a hot node sends ``most`` rows a task
        best = one.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("ord", value))).where(F.col("rank") <= most)
        listed = best.groupBy(F.col(key).alias("node")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", value))), lambda x: x[value]).alias(name))
        return listed.join(one.groupBy(F.col(key).alias("node")).agg(F.count("*").alias(f"n_{name}")), "node")

    out = nodes.select("node").distinct()
    for part in (side(links, "child", "parent", "parents"), side(links, "parent", "child", "children"), side(members, "parent", "article", "articles")):
        out = out.join(part, "node", "left")
    return out


def root_category(categories: DataFrame, preferred: str = "Chemistry", name: str = "category_title") -> DataFrame:
    """One row ``node``: the preferred title if it is there, else the smallest title of depth 0, else the smallest of all.

    An empty table gives no row.
    """
    order = F.when(F.col(name) == preferred, 0).when(F.col("depth") == 0, 1).otherwise(2)
    best = categories.where(F.col(name).isNotNull()).agg(F.min(F.struct(order.alias("o"), F.col(name).alias("node"))).alias("best"))
    return best.where("best IS NOT NULL").select("best.node")
