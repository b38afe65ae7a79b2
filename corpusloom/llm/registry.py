"""Queries of the training-data operators and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import boilerplate, garbled, markup, mixing, overlap, splitting, tokens
from corpusloom.session import checkpoint, load


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of the articles of all pages, and noise lines of all sections."""
    pages = load(spark, sf_dir, "nq_source").select("id", F.col("document.html").alias("html"))
    return boilerplate.found(pages, load(spark, sf_dir, "article_sections"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oversize texts of the corpus, and those with a forced cut."""
    return splitting.found(load(spark, sf_dir, "corpus"), load(spark, sf_dir, "split_limits"))


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the oversize texts of the corpus."""
    return splitting.split(load(spark, sf_dir, "corpus"), load(spark, sf_dir, "split_limits"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a train and a dev or test record that ask the same question."""
    return overlap.found(load(spark, sf_dir, "mteb_matches"))


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps per split and source."""
    return overlap.report(load(spark, sf_dir, "mteb_matches"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with residue of markup."""
    return markup.found(load(spark, sf_dir, "article_sections"), load(spark, sf_dir, "corpus"))


def p5_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts without markup, and their blocks."""
    return markup.clean_texts(markup.sources(load(spark, sf_dir, "article_sections"), load(spark, sf_dir, "corpus")))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode(load(spark, sf_dir, "documents"), "doc_id")


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    counted = tokens.count_tokens(load(spark, sf_dir, "documents"), ["doc_id", "source", "lang"])
    return mixing.mix(checkpoint(counted.where("n_tokens > 0")), load(spark, sf_dir, "mix_targets"))


def p7_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and copies of every mix."""
    return _mix(spark, sf_dir)[0]


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares, sizes and repeats reached by every mix."""
    return _mix(spark, sf_dir)[1]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a garbled passage."""
    return garbled.detect(load(spark, sf_dir, "documents")).select("doc_id").distinct()


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled documents with their text as far as it can be restored."""
    return garbled.detect(load(spark, sf_dir, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_pieces": p2_pieces,
    "p4_found": p4_found,
    "p4_report": p4_report,
    "p5_found": p5_found,
    "p5_clean": p5_clean,
    "p6_ids": p6_ids,
    "p7_selection": p7_selection,
    "p7_report": p7_report,
    "p8_found": p8_found,
    "p8_restored": p8_restored,
}

P2_FOUND_SQL = r"""
WITH lim AS (SELECT lower(trim(section)) AS name, max_chars FROM split_limits),
rows_ AS (
  SELECT DISTINCT c._id, c.text, coalesce(l.max_chars, (SELECT max_chars FROM lim WHERE name = '*')) AS max_chars
  FROM corpus c LEFT JOIN lim l ON l.name <> '*' AND l.name = lower(regexp_replace(c.section, '^\s+|\s+$', '', 'g'))),
big AS (SELECT * FROM rows_ WHERE length(text) > max_chars),
runs AS (
  SELECT _id, max_chars, list_max(list_transform(
    regexp_split_to_array(regexp_replace(text, '([。！？])', '\1 ', 'g'), '[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{85}\x{1c}-\x{1f}\x{0b}]+'),
    lambda x: length(x))) AS run FROM big)
SELECT DISTINCT _id AS corpus_id, kind FROM (
  SELECT _id, 'oversize' AS kind FROM big UNION ALL SELECT _id, 'forced' FROM runs WHERE run > max_chars)
WHERE _id IS NOT NULL
"""

P2_PIECES_SQL = r"""
WITH RECURSIVE lim AS (
  SELECT lower(regexp_replace(section, '^\s+|\s+$', '', 'g')) AS name, min({'m': max_chars, 'o': overlap_chars}) AS own FROM split_limits WHERE section IS NOT NULL AND max_chars > 0 GROUP BY 1),
rows_ AS (
  SELECT DISTINCT c._id, c.section, c.text, coalesce(l.own, (SELECT own FROM lim WHERE name = '*')) AS own
  FROM corpus c LEFT JOIN lim l ON l.name <> '*' AND l.name = lower(regexp_replace(c.section, '^\s+|\s+$', '', 'g'))),
big AS (
  SELECT sha256(coalesce(_id, chr(1)) || chr(0) || coalesce(section, chr(1)) || chr(0) || text) AS k, _id, section, text, length(text) AS n, own.m AS m, greatest(0, coalesce(own.o, 0)) AS o
  FROM rows_ WHERE length(text) > own.m),
chars AS (SELECT k, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM big),
signs AS (SELECT k, i, c, regexp_full_match(c, '[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{85}\x{1c}-\x{1f}\x{0b}]') AS sp, c IN ('"', '”', '’', '''', ')', ']') AS shut, c IN ('.', '!', '?') AS stop FROM chars),
places AS (
  SELECT *, coalesce(lead(sp) OVER w, false) AS next_sp, max(CASE WHEN NOT shut THEN 2 * i + stop::INT END) OVER w % 2 = 1 AS ends, max(CASE WHEN NOT sp THEN i ELSE 0 END) OVER w AS run
  FROM signs WINDOW w AS (PARTITION BY k ORDER BY i)),
runs AS (
  SELECT *, sum((c = chr(10))::INT) OVER v AS lines, max((c IN (chr(10), chr(13)))::INT) OVER v AS broken, ends AND next_sp AS full_stop FROM places WINDOW v AS (PARTITION BY k, run ORDER BY i)),
kinds AS (
  SELECT k, i AS p, greatest(
    CASE WHEN sp AND NOT next_sp THEN CASE WHEN lines > 1 THEN 4 WHEN broken = 1 THEN 3 ELSE 1 END WHEN sp OR next_sp THEN 1 ELSE 0 END,
    CASE WHEN c IN ('。', '！', '？') OR full_stop OR coalesce(lag(full_stop) OVER (PARTITION BY k ORDER BY i), false) THEN 2 ELSE 0 END) AS kind
  FROM runs),
ends_ AS (SELECT * FROM kinds WHERE kind > 0),
cuts AS (
  SELECT k, n, m, o, -1 AS no, 0 AS a, 0 AS b, false AS forced, 0 AS following FROM big
  UNION ALL
  SELECT k, n, m, o, no, a, b, forced, CASE WHEN b = n THEN n ELSE greatest(b - o, a + 1) END FROM (
    SELECT c.k, c.n, c.m, c.o, c.no + 1 AS no, c.following AS a,
      CASE WHEN c.n - c.following <= c.m THEN c.n ELSE coalesce(max({'near': e.p >= c.following + c.m * 0.5, 'kind': CASE WHEN e.p >= c.following + c.m * 0.5 THEN e.kind ELSE 0 END, 'p': e.p}).p, c.following + c.m) END AS b,
      c.n - c.following > c.m AND max(e.p) IS NULL AS forced
    FROM cuts c LEFT JOIN ends_ e ON e.k = c.k AND e.p > c.following + least(c.o, c.m - 1) AND e.p <= c.following + c.m
    WHERE c.following < c.n GROUP BY c.k, c.n, c.m, c.o, c.no, c.following))
SELECT b._id, c.k AS row_key, b.section, c.no::INT AS piece_no, c.a::BIGINT AS start, c.b::BIGINT AS "end", c.forced, substring(b.text, c.a + 1, c.b - c.a) AS piece
FROM cuts c JOIN big b USING (k) WHERE c.no >= 0
"""

SQL: dict[str, str] = {"p2_found": P2_FOUND_SQL, "p2_pieces": P2_PIECES_SQL}
