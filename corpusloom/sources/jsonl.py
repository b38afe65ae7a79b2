"""JSON-lines sources and sinks: strict and lenient reading, save modes, the four-file graph."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.sources import files

_LONG, _STR, _INT, _BOOL = T.LongType(), T.StringType(), T.IntegerType(), T.BooleanType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


CATEGORIES = _schema(category_title=_STR, category_display_title=_STR, category_url=_STR, page_id=_LONG, depth=_INT, first_seen_parent_category=_STR, path=T.ArrayType(_STR), is_redirect=_BOOL, page_len=_INT, cat_pages=_INT, cat_subcats=_INT, cat_files=_INT)
EDGES = _schema(parent_category=_STR, child_category=_STR, child_page_id=_LONG, depth=_INT, ord=_LONG)
ARTICLES = _schema(article_title=_STR, article_display_title=_STR, article_url=_STR, page_id=_LONG, depth=_INT, page_len=_INT, is_redirect=_BOOL, ord=_LONG)
MEMBERS = _schema(parent_category=_STR, article_title=_STR, article_url=_STR, page_id=_LONG, depth=_INT, page_len=_INT, is_redirect=_BOOL, ord=_LONG)


def resolve(path: str) -> str:
    """The plain or the gzipped file of a name; an error if there are both or none."""
    plain, packed = files.exists(path), files.exists(path + ".gz")
    if plain and packed:
        raise ValueError(f"{path} and {path}.gz both exist")
    if not plain and not packed:
        raise FileNotFoundError(path)
    return path if plain else path + ".gz"


def read_strict(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Every line has to be JSON of the schema's types; blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_lenient(spark: SparkSession, path: str, schema: T.StructType, key: str) -> DataFrame:
    """Lines that are no JSON, or have no ``key``, are left out."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path).where(F.col(key).isNotNull())


def read_optional(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """An empty table if the file is missing."""
    return read_strict(spark, path, schema) if files.exists(path) else spark.createDataFrame([], schema)


def read_numbered(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows with ``line_no`` (from 1, blank lines counted but left out), for files that one task can hold."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("at", "line"))
    parsed = lines.where(F.trim("line") != "").select((F.col("at") + 1).alias("line_no"), F.from_json("line", schema, {"mode": "FAILFAST"}).alias("row"))
    return parsed.select("line_no", "row.*")


def read_arrays(spark: SparkSession, paths: list[str], schema: T.StructType, pattern: str = r"_(train|dev|test)_") -> DataFrame:
    """JSON arrays of one or more files; ``split`` comes from the file name."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(paths)
    return rows.withColumn("split", F.coalesce(F.nullif(F.regexp_extract(F.input_file_name(), pattern, 1), F.lit("")), F.col("split") if "split" in rows.columns else F.lit(None)))


def write(df: DataFrame, path: str, mode: str = "errorifexists", gz: bool = False, single: bool = False) -> int:
    """Writes JSON lines with explicit nulls and returns the number of rows, counted in the same pass.

    ``errorifexists`` refuses a target that has files, ``overwrite`` clears it, ``append`` adds to it.
    """
    from pyspark.sql import Observation

    seen = Observation()
    out = df.observe(seen, F.count(F.lit(1)).alias("n"))
    (out.coalesce(1) if single else out).write.mode(mode).json(path, compression="gzip" if gz else "none", ignoreNullFields=False)
    return seen.get["n"]


def load_graph(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Nodes (last row wins) and distinct links (first ord) of the four files of a graph folder."""
    from corpusloom.operators.ordinal import latest_wins

    read = lambda name, schema: read_strict(spark, resolve(folder.rstrip("/") + "/" + name), schema)
    categories, articles = read("categories.jsonl", CATEGORIES), read("articles.jsonl", ARTICLES)
    edges, members = read("category_edges.jsonl", EDGES), read("article_members.jsonl", MEMBERS)
    number = lambda df: df.withColumn("__n", F.monotonically_increasing_id())  # noqa: E731  file order
    return {
        "categories": latest_wins(number(categories), ["category_title"], ["__n"]).drop("__n"),
        "articles": latest_wins(number(articles), ["article_title"], ["__n"]).drop("__n"),
        "edges": number(edges).groupBy("parent_category", "child_category").agg(F.min(F.coalesce("ord", "__n")).alias("ord")),
        "members": number(members).groupBy("parent_category", "article_title").agg(F.min(F.coalesce("ord", "__n")).alias("ord")),
    }


def split_folders(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder a split."""
    df.write.mode(mode).partitionBy("split").json(path, ignoreNullFields=False)


def write_summary(figures: dict, path: str) -> None:
    """One JSON object with sorted keys, written whole or not at all."""
    files.write(path, (json.dumps(figures, ensure_ascii=False, indent=2, sort_keys=True) + "\n").encode())


def write_pages(pages: DataFrame, folder: str) -> DataFrame:
    """Writes ``<article_id>.html`` for each page (title, url, html); returns ``article_id, written``.

    Of several pages of one (title, revision) the first by url counts; pages without url, title or html are left out;
    files that exist are kept.
    """
    from collections.abc import Iterator

    import pyarrow as pa

    from corpusloom.functions import titles
    from corpusloom.operators.ordinal import first_wins

    rows = pages.where("coalesce(url, '') <> '' AND coalesce(html, '') <> '' AND title IS NOT NULL").select(titles.article_id("title", "url").alias("article_id"), "url", "html")
    once = first_wins(rows, ["article_id"], ["url"]).select("article_id", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            written = []
            for name, html in zip(*(c.to_pylist() for c in batch.columns)):
                path = f"{folder.rstrip('/')}/{name}.html"
                written.append(not files.exists(path))
                if written[-1]:
                    files.write(path, html.encode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(written, pa.bool_())], names=["article_id", "written"])

    return once.mapInArrow(run, "article_id string, written boolean")
