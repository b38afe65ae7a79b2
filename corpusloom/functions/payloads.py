"""Prompt payloads and flat result rows of model decisions, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import titles

#: Entries of a neighbourhood list, and characters of an extract, in a payload.
SAMPLE, EXTRACT = 12, 1000


@dataclass(frozen=True)
class Prompt:
    """What a model is asked: the system text, the line before the payload, the name of the task, and a version."""

    system: str
    lead: str
    task: str
    version: str = "1"


def _payload(prompt: Prompt, **parts: Column) -> Column:
    body = F.struct(F.lit(prompt.task).alias("task"), *[c.alias(k) for k, c in parts.items()])
    return F.concat(F.lit(prompt.lead + "\n"), F.to_json(body, {"ignoreNullFields": "false"}))


def _sample(names: str, key: str) -> Column:
    """The first ``SAMPLE`` names of a list with their display forms; empty for null."""
    rows = F.transform(F.slice(F.col(names), 1, SAMPLE), lambda x: F.struct(x.alias(f"{key}_title"), titles.display_title(x).alias(f"{key}_display_title")))
    return F.coalesce(rows, F.array().cast(f"array<struct<{key}_title:string,{key}_display_title:string>>"))


def category_payloads(neighbours: DataFrame, nodes: DataFrame, extracts: DataFrame, prompt: Prompt) -> DataFrame:
    """``node, payload``: the graph around a category and its extract.

    ``neighbours`` is that of ``graph.neighbourhood``; ``nodes`` has node, category_url, depth, path and the counts
    cat_pages, cat_subcats, cat_files, one row a node; ``extracts`` has node and extract. What is missing is null.
    """
    counts = F.struct(*[F.col(c) for c in ("cat_pages", "cat_subcats", "cat_files")])
    local = F.struct(
        F.col("node").alias("category_title"), titles.display_title("node").alias("category_display_title"), F.col("category_url"), F.col("depth").alias("bfs_depth"), F.col("path"), counts.alias("bfs_counts"),
        _sample("parents", "category").alias("parent_categories"), _sample("children", "category").alias("child_category_sample"), _sample("articles", "article").alias("direct_article_sample"),
    )
    context = F.struct(F.left(F.col("extract"), F.lit(EXTRACT)).alias("wikipedia_intro_extract"))
    rows = neighbours.join(nodes, "node", "left").join(extracts.select("node", "extract"), "node", "left")
    return rows.select("node", _payload(prompt, local_graph_context=local, fetched_wikipedia_context=context).alias("payload"))


def article_payload(title: Column, depth: Column, path: Column, extract: Column, prompt: Prompt) -> Column:
    """The payload of an article: its place and the first ``EXTRACT`` characters of its extract, nothing else."""
    article = F.struct(title.alias("article_title"), depth.alias("bfs_depth"), path.alias("path"))
    context = F.struct(F.left(F.coalesce(extract, F.lit("")), F.lit(EXTRACT)).alias("wikipedia_intro_extract"))
    return _payload(prompt, article=article, fetched_wikipedia_context=context)


def usage(raw: Column | str) -> Column:
    """Token figures of a usage object in JSON: struct of prompt, completion, total and reasoning tokens, and the object.

    Reasoning tokens come from the object itself, or from its details in either spelling; null and broken JSON give
    null figures.
    """
    c = F.col(raw) if isinstance(raw, str) else raw
    v = F.try_parse_json(c)
    at = lambda path: F.try_variant_get(v, path, "bigint")
    reasoning = F.coalesce(at("$.reasoning_tokens"), at("$.completion_tokens_details.reasoning_tokens"), at("$.completion_tokens_detail.reasoning_tokens"))
    return F.struct(
        at("$.prompt_tokens").alias("prompt_tokens"), at("$.completion_tokens").alias("completion_tokens"), at("$.total_tokens").alias("total_tokens"),
        reasoning.alias("reasoning_tokens"), F.coalesce(c, F.lit("{}")).alias("raw_usage"),
    )


def decision_rows(df: DataFrame, key: str, decision: dict[str, Column], context: list[str], model: str, prompt: Prompt | None = None, effort: str | None = None) -> DataFrame:
    """Flat rows of finished calls: key, display title, the decision's fields, context columns, and what made them.

    ``df`` has the key, the context columns and those of ``models.classify``; only its good rows give a decision.
    """
    extra = [F.lit(prompt.version).alias("prompt_version")] if prompt else []
    return df.where("ok").select(
        key, titles.display_title(key).alias(key.replace("_title", "") + "_display_title"), *[c.alias(k) for k, c in decision.items()], *context,
        F.current_timestamp().alias("created_at"), F.lit(model).alias("model"), F.lit(effort).cast("string").alias("reasoning_effort"), *extra, F.col("reply").alias("raw_response"),
    )
