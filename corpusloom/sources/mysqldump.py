"""MySQL dumps (``INSERT INTO `t` VALUES (..),(..);``) as a Spark data source named ``mysqldump``.

    spark.dataSource.register(MysqlDump)
    spark.read.format("mysqldump").option("table", "page").load("/dumps/*.sql.gz")

Each file is one partition (gzip cannot be split); a dump is meant to be read once and kept as Parquet. Rows come as
``values ARRAY<STRING>`` with ``ord``, the position in the file; unquoted NULL is null, a quoted one the word.
"""

from __future__ import annotations

import gzip
import io
import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corpusloom.sources import files

# Backslash escapes of MySQL strings.
ESCAPES = {ord("0"): 0, ord("n"): 10, ord("r"): 13, ord("t"): 9, ord("b"): 8, ord("Z"): 26}
QUOTE, BACKSLASH, OPEN, CLOSE, COMMA = b"'"[0], b"\\"[0], b"("[0], b")"[0], b","[0]


def tuples(line: bytes, start: int) -> Iterator[list[bytes | None]]:
    """The value tuples of an INSERT line from ``start``; raises where a tuple does not end."""
    i, n = start, len(line)
    while True:
        i = line.find(b"(", i)
        if i < 0:
            return
        i += 1
        values: list[bytes | None] = []
        while True:
            while i < n and line[i] == 32:
                i += 1
            if i < n and line[i] == QUOTE:
                out = bytearray()
                i += 1
                while True:
                    stop = i
                    while stop < n and line[stop] != QUOTE and line[stop] != BACKSLASH:
                        stop += 1
                    if stop >= n:
                        raise ValueError("unfinished string in a tuple")
                    out += line[i:stop]
                    if line[stop] == BACKSLASH:
                        if stop + 1 >= n:
                            raise ValueError("unfinished string in a tuple")
                        out.append(ESCAPES.get(line[stop + 1], line[stop + 1]))
                        i = stop + 2
                    elif stop + 1 < n and line[stop + 1] == QUOTE:  # a doubled quote
                        out.append(QUOTE)
                        i = stop + 2
                    else:
                        i = stop + 1
                        break
                values.append(bytes(out))
            else:
                stop = i
                while stop < n and line[stop] != COMMA and line[stop] != CLOSE:
                    stop += 1
                token = line[i:stop].strip()
                values.append(None if token == b"NULL" else token)
                i = stop
            while i < n and line[i] == 32:
                i += 1
            if i >= n:
                raise ValueError("unfinished tuple at the end of a line")
            if line[i] == CLOSE:
                i += 1
                break
            if line[i] != COMMA:
                raise ValueError("bad separator in a tuple")
            i += 1
        yield values


def rows_of(lines: Iterator[bytes], table: str) -> Iterator[list[bytes | None]]:
    """All tuples of a table; other lines are skipped."""
    prefix = f"INSERT INTO `{table}` VALUES ".encode()
    for line in lines:
        if line.startswith(prefix):
            yield from tuples(line.rstrip(b"\r\n"), len(prefix))


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.table = options["path"], options["table"]
        self.field = int(options.get("field", "-1"))
        self.wanted = {None if v is None else v.encode() for v in json.loads(options.get("wanted", "[]"))}

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in files.listed(self.path)] or [_File("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not partition.path:
            return
        system, inner = files.of(partition.path)
        with system.open_input_file(inner) as raw, gzip.GzipFile(fileobj=raw) if inner.endswith(".gz") else io.BufferedReader(raw, 1 << 20) as file:
            for i, values in enumerate(rows_of(file, self.table)):
                if self.field >= 0 and (self.field >= len(values) or values[self.field] not in self.wanted):
                    continue  # numbered, but neither decoded nor sent
                yield partition.path, i, [None if v is None else v.decode("utf-8", "replace") for v in values]


class MysqlDump(DataSource):
    """The data source; options ``path`` (a glob), ``table``, and ``field`` with ``wanted`` (a JSON list) to prune rows."""

    @classmethod
    def name(cls) -> str:
        return "mysqldump"

    def schema(self) -> str:
        return "file string, ord bigint, values array<string>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def scan(spark: SparkSession, path: str, table: str, field: int | None = None, wanted: list[str | None] | None = None) -> DataFrame:
    """``file, ord, values`` of the tuples of a table; with ``field``, only those whose field is ``wanted``, pruned in the reader.

    ``wanted`` travels with the tasks, so it is for lists of settings' size; longer ones are semi joins on the scan.
    """
    spark.dataSource.register(MysqlDump)
    reader = spark.read.format("mysqldump").option("table", table)
    if field is not None:
        reader = reader.option("field", str(field)).option("wanted", json.dumps(wanted or []))
    return reader.load(path)


def _at(i: int, kind: str = "string") -> Column:
    return F.col("values")[i].try_cast(kind)


def pages(raw: DataFrame) -> DataFrame:
    """``page``: rows with fewer than 12 fields are left out."""
    return raw.where(F.size("values") >= 12).select(_at(0, "bigint").alias("page_id"), _at(1, "int").alias("namespace"), _at(2).alias("title"), (_at(5) == "1").alias("is_redirect"), _at(11, "int").alias("page_len"), "ord")


def category_links(raw: DataFrame) -> DataFrame:
    return raw.where(F.size("values") >= 7).select(_at(0, "bigint").alias("cl_from"), _at(1).alias("cl_to"), _at(6).alias("cl_type"), "ord")


def category_sizes(raw: DataFrame) -> DataFrame:
    """``category`` with the articles that are neither subcategories nor files; first row of a title wins."""
    from corpusloom.operators.ordinal import first_wins

    rows = raw.where(F.size("values") >= 5).select(_at(1).alias("cat_title"), _at(2, "int").alias("cat_pages"), _at(3, "int").alias("cat_subcats"), _at(4, "int").alias("cat_files"), "ord")
    return first_wins(rows, ["cat_title"], ["ord"]).withColumn("cat_article_members_estimate", F.col("cat_pages") - F.col("cat_subcats") - F.col("cat_files"))


def members(links: DataFrame, frontier: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Page and subcategory links to titles of ``frontier`` (title), and counts of all link types to them."""
    hit = links.join(frontier.select(F.col("title").alias("cl_to")).distinct(), "cl_to", "left_semi")
    kind = F.when(F.col("cl_type").isin("page", "subcat"), F.col("cl_type")).otherwise(F.concat(F.lit("ignored_"), F.coalesce("cl_type", F.lit("null"))))
    return hit.where(F.col("cl_type").isin("page", "subcat")), hit.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def resolved(links: DataFrame, page_rows: DataFrame, include_redirects: bool = False) -> DataFrame:
    """Links with their page and one ``reason``: unresolved, redirect, namespace, ok; subcategories live in namespace 14."""
    from corpusloom.operators.curate import reason_codes
    from corpusloom.operators.ordinal import first_wins

    joined = links.join(first_wins(page_rows, ["page_id"], ["ord"]).drop("ord"), F.col("cl_from") == F.col("page_id"), "left")
    wanted = F.when(F.col("cl_type") == "subcat", 14).otherwise(0)
    rules = [("unresolved", F.col("page_id").isNull()), ("redirect", F.col("is_redirect") & F.lit(not include_redirects)), ("namespace", F.col("namespace") != wanted)]
    return joined.withColumn("reason", reason_codes(joined, rules))
