"""Queries of the relational, text, retrieval and source operators on the domain tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import decisions as D
from corpusloom.functions import text as X
from corpusloom.functions import titles
from corpusloom.operators import curate, html_sections, ordinal, retrieval
from corpusloom.session import checkpoint, load

# Titles, URLs, labels


def wiki_url_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs of all article titles."""
    rows = load(spark, sf_dir, "article_members").where("article_title IS NOT NULL").select("article_title").distinct()
    return rows.select("article_title", titles.article_url("article_title", "https://wiki.example/wiki/").alias("url"))


def page_url_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revision and title parameters of the snapshot URLs."""
    rows = load(spark, sf_dir, "nq_source").select(F.col("document.url").alias("url")).distinct()
    return rows.select("url", titles.old_id("url").alias("oldid"), titles.query_param("url", "title").alias("title"))


def safe_part_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File-name ids of the snapshots."""
    rows = load(spark, sf_dir, "nq_source").select(F.col("document.title").alias("title"), F.col("document.url").alias("url")).where("title IS NOT NULL").distinct()
    return rows.select("title", "url", titles.safe_part("title").alias("safe"), titles.article_id("title", "url").alias("article_id"))


def clamp_and_normalize_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised labels and scores of raw decisions (C17-C20); the raw values come from the log's numbers."""
    rows = load(spark, sf_dir, "topic_decisions").select("ord").distinct()
    raw = F.element_at(F.array(F.lit("Keep "), F.lit("MIXED"), F.lit("borderline"), F.lit("drop"), F.lit("unsure"), F.lit(None)), (F.col("ord") % 6 + 1).cast("int"))
    score = F.when(F.col("ord") % 5 == 0, "n/a").otherwise((F.col("ord") % 7 - 1).cast("string"))
    own = D.category_decision(raw, score)
    return rows.select("ord", *[c.alias(k) for k, c in own.items()], D.article_label(raw).alias("article_label"))


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of JSON objects, also where they are wrapped in other text."""
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("reply: "), "props", F.lit(" end"))).when(F.col("event_id") % 3 == 1, F.col("props")).otherwise(F.concat(F.lit("["), "props", F.lit("]")))
    rows = load(spark, sf_dir, "events").select("event_id", D.json_object(text).alias("v"))
    return rows.select("event_id", F.try_variant_get("v", "$.k", "bigint").alias("k"), F.col("v").isNull().alias("no_object"))


def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of every numeric key of a JSON object."""
    rows = load(spark, sf_dir, "events").select("event_type", F.explode(F.from_json("props", "map<string,double>")).alias("key", "value"))
    return rows.groupBy("event_type", "key").agg(F.sum("value").alias("total"), F.count("*").alias("n"))


# Semi, anti and latest-row joins


def title_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions whose page title is a member article, in any form."""
    wanted = curate.title_set(load(spark, sf_dir, "article_members"), "article_title")
    rows = load(spark, sf_dir, "nq_source").select("id", F.col("document.title").alias("title")).distinct()
    return curate.in_title_set(rows, "title", wanted).select("id", "title")


def _decision_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "topic_decisions").distinct()


def topic_latest_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last decision of each id by ord."""
    last = ordinal.latest_wins(_decision_rows(spark, sf_dir), ["id"], ["ord"])
    return last.select("id", "ord", "chemistry", F.coalesce(F.col("chemistry") & (F.coalesce("error", F.lit("")) == ""), F.lit(False)).alias("accepted"))


def topic_ever_decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids with any boolean decision."""
    return ordinal.ever_valid(_decision_rows(spark, sf_dir), "id", "chemistry")


def pending_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 undecided questions by id, after the anti join."""
    rows = load(spark, sf_dir, "mteb_matches").where("id IS NOT NULL").select("id", "question").distinct()
    return curate.pending(rows, topic_ever_decided(spark, sf_dir), "id", ["id", "question"], 50)


def missing_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions and ids without any log row, per split."""
    rows = load(spark, sf_dir, "mteb_matches").select("id", F.lower(titles.strip("split")).alias("split")).distinct()
    log = load(spark, sf_dir, "topic_decisions").select("id").distinct().withColumn("logged", F.lit(True))
    return rows.join(log, "id", "left").groupBy("split").agg(F.count("*").alias("ids"), F.count_if(F.col("logged").isNull()).alias("missing"))


def _true_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topic_latest_decision(spark, sf_dir).where("accepted").select("id")


def decision_inner_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted questions with the documents that exist."""
    rows = load(spark, sf_dir, "mteb_matches").join(_true_ids(spark, sf_dir), "id", "left_semi").select("id", F.explode("relevant_doc_ids").alias("doc_id")).distinct()
    known = load(spark, sf_dir, "corpus").select(F.col("_id").alias("doc_id")).distinct()
    return rows.join(known, "doc_id").groupBy("id").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"))


# First wins, numbering, snapshots


def first_wins_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first log row of each question text."""
    rows = _decision_rows(spark, sf_dir).where("question IS NOT NULL").select("question", "ord", "id", "model")
    return ordinal.first_wins(rows, ["question"], ["ord"]).select("question", "ord", "id", "model")


def section_key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section rows with the first corpus id of their title and section."""
    name = F.lower(titles.strip("section"))
    docs = ordinal.first_wins(load(spark, sf_dir, "corpus").select("title", name.alias("section_key"), "_id"), ["title", "section_key"], ["_id"])
    rows = load(spark, sf_dir, "article_sections").select("id", "title", name.alias("section_key")).distinct()
    return rows.join(docs, ["title", "section_key"], "left").select("id", "title", "section_key", F.col("_id").alias("doc_id"))


def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest snapshot of each title by numeric revision, then id."""
    rows = load(spark, sf_dir, "article_sections").where("title IS NOT NULL AND article_id IS NOT NULL").select("title", "article_id", F.coalesce(F.col("oldid").try_cast("bigint"), F.lit(-1)).alias("revision")).distinct()
    return ordinal.latest_wins(rows, ["title"], ["revision", "article_id"]).select("title", "article_id", "revision")


def dedup_with_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches per split, and those that are new against the train output."""
    rows = load(spark, sf_dir, "mteb_matches").select("question", F.lower(titles.strip("split")).alias("split")).where("question IS NOT NULL")
    seen = rows.where("split = 'train'").select("question").distinct().withColumn("seen", F.lit(True))
    return rows.where("split <> 'train'").join(seen, "question", "left").groupBy("split").agg(F.count("*").alias("matched"), F.count_distinct(F.when(F.col("seen").isNull(), F.col("question"))).alias("added"))


def dense_query_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense ids of the accepted test questions in order of their id."""
    rows = load(spark, sf_dir, "mteb_matches").where(F.lower(titles.strip("split")) == "test").join(_true_ids(spark, sf_dir), "id", "left_semi").select("id").distinct()
    return ordinal.dense_ids(rows, ["id"], "test", "query_id").select("id", "query_id")


def block_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of each section within its article, and its padded id."""
    rows = load(spark, sf_dir, "article_sections").where("article_id IS NOT NULL").select("article_id", "id").distinct()
    numbered = ordinal.block_index(rows, "article_id", ["id"])
    return numbered.select("article_id", "id", "block_no", F.concat("article_id", F.lit("::b"), F.lpad(F.col("block_no").cast("string"), 4, "0")).alias("block_id"))


# Questions and exports


def answer_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answerable questions with their valid long and short answers."""
    rows = load(spark, sf_dir, "nq_source").select("id", "annotations").distinct()
    return rows.select("id", D.has_answer("annotations").alias("answerable"), F.size(D.valid_long_answers("annotations")).alias("long_answers"), F.concat_ws("|", D.short_answers("annotations")).alias("short_text"))


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "mteb_matches").withColumn("split", F.lower(titles.strip("split"))).where("id IS NOT NULL").distinct()


def qrel_title_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of the listed documents of each question, in order, and how many match its titles."""
    rel = _matches(spark, sf_dir).select("id", "matching_corpus_titles", F.posexplode("relevant_doc_ids").alias("pos", "doc_id"))
    docs = load(spark, sf_dir, "corpus").groupBy(F.col("_id").alias("doc_id")).agg(F.min(titles.space_then_strip("title")).alias("doc_title"))
    joined = rel.join(docs, "doc_id", "left").withColumn("doc_title", F.coalesce("doc_title", F.lit("")))
    hit = F.exists("matching_corpus_titles", lambda t: titles.space_then_strip(t) == F.col("doc_title"))
    return joined.groupBy("id").agg(F.concat_ws("|", ordinal.ordered_list("doc_title", "pos", distinct=True)).alias("titles"), F.count_if(F.coalesce(hit, F.lit(False))).alias("matching"), F.count("*").alias("listed"))


def split_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with a matching title by split, and their share (F8)."""
    rows = _matches(spark, sf_dir).select("id", "split", (F.coalesce(F.size("matching_corpus_titles"), F.lit(0)) > 1).alias("several")).distinct()
    return rows.groupBy("split").agg(F.count("*").alias("questions"), F.count_if("several").alias("several")).withColumn("share", F.coalesce(F.try_divide("several", "questions"), F.lit(0.0)))


def qrels_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many questions have how many documents."""
    per = _matches(spark, sf_dir).select("id", F.explode("relevant_doc_ids").alias("doc")).distinct().groupBy("id").agg(F.count("*").alias("docs"))
    return per.groupBy("docs").agg(F.count("*").alias("questions"))


def _variant(spark: SparkSession, sf_dir: str, ids: DataFrame) -> dict[str, DataFrame]:
    wanted = load(spark, sf_dir, "article_members").where("article_title IS NOT NULL").select(F.col("article_title").alias("title")).distinct()
    return curate.build_variant(_matches(spark, sf_dir), ids, load(spark, sf_dir, "corpus").distinct(), wanted)


def broad_corpus_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus rows taken by id, by title or both."""
    docs = _variant(spark, sf_dir, _true_ids(spark, sf_dir))["corpus"]
    return docs.groupBy("by_id", "by_title").agg(F.count("*").alias("docs"), F.count_distinct("_id").alias("ids"))


def variant_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary figures of the two variants: all matched ids, and the accepted ones."""
    out = []
    for name, ids in (("title_match", _matches(spark, sf_dir).select("id").distinct()), ("accepted", _true_ids(spark, sf_dir))):
        v = _variant(spark, sf_dir, ids)
        positives = v["qrels"].select(F.col("corpus-id").alias("_id")).distinct()
        missing = positives.join(v["corpus"].select("_id").distinct(), "_id", "left_anti")
        parts = {"queries": v["queries"].select(F.col("_id").alias("k")).distinct(), "qrels": v["qrels"].select(F.col("query-id").alias("k")), "positives": positives, "missing": missing}
        figures = reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("figure"), "n") for k, df in parts.items()])
        out.append(figures.agg(*[F.max(F.when(F.col("figure") == k, F.col("n"))).alias(k) for k in parts]).select(F.lit(name).alias("variant"), "*"))
    return reduce(DataFrame.unionByName, out)


def id_set_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set comparisons of question ids with the log's, by split, and of documents."""
    m, log = _matches(spark, sf_dir), load(spark, sf_dir, "topic_decisions").where("id IS NOT NULL")
    listed = m.select(F.explode("relevant_doc_ids").alias("id")).where("id IS NOT NULL")
    return reduce(DataFrame.unionByName, [
        curate.set_report(m, log, "id", "all"), curate.set_report(m.where("split IN ('train', 'dev')"), log, "id", "train_dev"),
        curate.set_report(listed, load(spark, sf_dir, "corpus").where("_id IS NOT NULL").withColumnRenamed("_id", "id"), "id", "documents"),
    ])


def split_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of the known splits."""
    rows = _matches(spark, sf_dir).where("question IS NOT NULL AND question <> ''")
    parts = [rows.where(F.col("split") == s).select("split", "id", "source") for s in ("train", "dev", "test")]
    return reduce(DataFrame.unionByName, parts).groupBy("split", "source").agg(F.count("*").alias("rows_"), F.count_distinct("id").alias("ids"))


# Text


def containment_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections whose whole text is contained in exactly one corpus text of the same title."""
    rows = load(spark, sf_dir, "article_sections").where("text IS NOT NULL AND title IS NOT NULL").select("id", "title", "text").distinct()
    # different texts of one id are looked for on their own
    answers = rows.select(F.struct("id", "title", F.sha2("text", 256)).alias("answer_id"), "title", X.match_key("text").alias("answer_key"))
    docs = load(spark, sf_dir, "corpus").where("text IS NOT NULL AND title IS NOT NULL").select(F.col("_id").alias("doc_id"), "title", X.match_key("text").alias("doc_key")).distinct()
    return curate.containment(answers, docs, "title").select(F.col("answer_id.id").alias("answer_id"), "answer_id.title", "doc_id").distinct()


def bad_intro_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each corpus text breaks off at its end and is removed (C16, D7); null texts stay."""
    rows = load(spark, sf_dir, "corpus").select("_id", "text").distinct()
    return rows.select("_id", X.is_bad_intro("text").alias("bad"))


def clean_text_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cleaned, with entities decoded (C11)."""
    return load(spark, sf_dir, "documents").select("doc_id", X.clean_text("text").alias("clean"))


def enclosing_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section around the middle of each page."""
    rows = load(spark, sf_dir, "nq_source").where("id IS NOT NULL").select("id", F.col("document.html").alias("html")).where("html IS NOT NULL")
    middle = F.floor(F.octet_length("html") / 2).cast("int")
    # pages stay in their scan: rows are told apart by digests, and only headings reach the Python workers
    heads = rows.select("id", F.unhex(F.sha2("html", 256)).alias("page"), X.last_heading("html", middle).alias("heading")).distinct()
    return heads.select("id", X.section_name("heading").alias("section"))


def section_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of all pages with a wiki content block."""
    rows = load(spark, sf_dir, "nq_source").select(titles.article_id("document.title", "document.url").alias("article_id"), F.col("document.html").alias("html")).where("html IS NOT NULL").distinct()
    return html_sections.extract_sections(rows)


def first_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section, or reason for none, of every question."""
    source = load(spark, sf_dir, "nq_source").where("id IS NOT NULL").select("id", F.col("document.title").alias("title"), titles.article_id("document.title", "document.url").alias("article_id"), "annotations", F.col("document.html").alias("html")).distinct()
    source = ordinal.first_wins(source, ["id"], ["article_id"])
    sections = section_blocks(spark, sf_dir).where(~X.is_bad_intro("text")).select(F.col("id").alias("doc_id"), "article_key", "section", "text")
    return curate.resolve_questions(source, checkpoint(sections), source.where("html IS NOT NULL AND html <> ''"))


def corpus_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality figures of the corpus."""
    return curate.profile(load(spark, sf_dir, "corpus"), "_id", "title", "text")


def sorted_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 25 categories by depth, nulls last, then title (H1, H4, H6)."""
    rows = load(spark, sf_dir, "categories").select("category_title", "depth").distinct()
    return rows.orderBy(F.col("depth").asc_nulls_last(), "category_title").limit(25)


def sorted_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevance rows with their place in the export's order, per question (H2)."""
    rel = _matches(spark, sf_dir).select(F.col("id").alias("query-id"), F.explode("relevant_doc_ids").alias("corpus-id")).distinct()
    return rel.withColumn("place", F.row_number().over(Window.partitionBy("query-id").orderBy("corpus-id"))).withColumn("score", F.lit("1"))


# Retrieval


def _ranked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    vectors = load(spark, sf_dir, "embeddings")
    queries = vectors.where("vec_id % 20 = 0")  # the stated query set
    ranked = checkpoint(retrieval.topk(queries, vectors, 100))
    of = lambda df: df.select(F.col("vec_id").alias("id"), "label")
    return ranked, of(queries), of(vectors)


def retrieval_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every query."""
    return _ranked(spark, sf_dir)[0].where("rank <= 10").select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


def ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics of every query."""
    return retrieval.metrics_by_label(*_ranked(spark, sf_dir))


def ranking_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of all metrics over the queries."""
    m = ranking_metrics(spark, sf_dir)
    return m.agg(*[F.avg(c).alias(c) for c in m.columns if c != "query_id"])


def _board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in results: nation as model, market segment as task, mean balance as score."""
    return load(spark, sf_dir, "customer").groupBy("c_nationkey", F.col("c_mktsegment").alias("task")).agg(F.avg("c_acctbal").alias("score")).withColumn("model", F.concat(F.lit("family"), (F.col("c_nationkey") % 5).cast("string"), F.lit("-"), F.col("c_nationkey").cast("string")))


def leaderboard_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of each model by task."""
    return retrieval.leaderboard(_board(spark, sf_dir), "task", "model", "score").select("task", "model", "rank", F.round("score", 4).alias("score"), F.round("behind_best", 4).alias("behind_best"))


def family_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, deviation and best model of each family and task."""
    rows = _board(spark, sf_dir).withColumn("family", retrieval.family("model"))
    return rows.groupBy("family", "task").agg(F.round(F.avg("score"), 4).alias("mean"), F.round(F.stddev_samp("score"), 4).alias("deviation"), F.max_by("model", F.struct("score", "model")).alias("best"), F.count("*").alias("models"))


def task_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of each two tasks over the models."""
    rows = _board(spark, sf_dir).select("model", "task", "score")
    other = rows.select("model", F.col("task").alias("other"), F.col("score").alias("other_score"))
    return rows.join(other, "model").where("task < other").groupBy("task", "other").agg(F.round(F.corr("score", "other_score"), 6).alias("correlation"), F.count("*").alias("models"))


def ablation_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gain of each model over the one before in its family."""
    rows = _board(spark, sf_dir).withColumn("family", retrieval.family("model"))
    w = Window.partitionBy("family", "task").orderBy("c_nationkey")
    return rows.select("family", "task", "model", F.round(F.col("score") - F.lag("score").over(w), 4).alias("gain"))


# Sources, sinks, streams


def _folder(spark: SparkSession) -> str:
    """A fresh folder in shared storage: below the checkpoint folder that all executors see."""
    from corpusloom.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/work-{uuid.uuid4().hex}"


def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The categories after a strict JSON-lines round trip with explicit nulls."""
    from corpusloom.sources import jsonl

    rows = load(spark, sf_dir, "categories").select("category_title", "page_id", "depth", "path", "is_redirect", "page_len")
    path = _folder(spark) + "/categories"
    jsonl.write(rows, path, gz=True)
    return jsonl.read_strict(spark, path, rows.schema).select("category_title", "page_id", "depth", F.concat_ws("|", "path").alias("path"), "is_redirect", "page_len")


def mysqldump_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of a page dump written from the members and read back through the dump source."""
    from corpusloom.sources import mysqldump

    quote = lambda c: F.concat(F.lit("'"), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("NULL"))
    rows = load(spark, sf_dir, "article_members").where("page_id IS NOT NULL AND article_title IS NOT NULL").select("page_id", "article_title", "is_redirect", "page_len").distinct()
    zero = F.lit("0")
    fields = F.concat_ws(",", F.col("page_id").cast("string"), zero, quote("article_title"), F.lit("''"), zero, F.when(F.col("is_redirect"), "1").otherwise("0"), zero, F.lit("0.5"), F.lit("'2017'"), F.lit("NULL"), zero, number("page_len"))
    lines = rows.select(F.concat(F.lit("("), fields, F.lit(")")).alias("t")).groupBy(F.spark_partition_id().alias("p"), F.pmod(F.xxhash64("t"), F.lit(64)).alias("b")).agg(F.collect_list("t").alias("l"))
    folder = _folder(spark) + "/dump"
    lines.select(F.concat(F.lit("INSERT INTO `page` VALUES "), F.concat_ws(",", "l"), F.lit(";")).alias("value")).write.text(folder, compression="gzip")
    back = mysqldump.pages(mysqldump.scan(spark, f"{folder}/*.gz", "page"))
    return back.agg(F.count("*").alias("rows_"), F.count_distinct("page_id").alias("pages"), F.sum("page_len").alias("total_len"), F.count_if("is_redirect").alias("redirects"), F.count_if(F.col("page_len").isNull()).alias("null_len"), F.sum(F.char_length("title")).alias("title_chars"))


def incremental_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream over the log in two runs: rows of new ids only, the first of each by ord (L1-L3)."""
    from corpusloom.streaming import incremental

    folder = _folder(spark)
    rows = load(spark, sf_dir, "topic_decisions").where("id IS NOT NULL").select("id", "ord", "split").distinct()
    source, target, state = (f"{folder}/{x}" for x in ("in", "out", "state"))
    half = F.col("ord") % 2
    for part in (0, 1):
        rows.where(half == part).repartition(4).write.mode("append").parquet(source)
        incremental.run_stream(spark, source, rows.schema, target, state, "id", "ord", files_per_batch=1000)
    return spark.read.schema(rows.schema).parquet(target).groupBy("split").agg(F.count("*").alias("rows_"), F.count_distinct("id").alias("ids"))


QUERIES = {f.__name__: f for f in (
    wiki_url_encode, page_url_params, safe_part_keys, clamp_and_normalize_label, json_props, usage_totals, title_semi_join, topic_latest_decision,
    topic_ever_decided, pending_anti_join, missing_decisions, decision_inner_join, first_wins_by_key, section_key_lookup, latest_snapshot, dedup_with_existing,
    dense_query_ids, block_index, answer_filter, qrel_title_match, split_fraction, qrels_histogram, broad_corpus_flags, variant_build, id_set_verification,
    split_union, containment_texts, bad_intro_texts, clean_text_all, enclosing_heading, section_blocks, first_success, corpus_profile, sorted_limit,
    sorted_exports, retrieval_topk, ranking_metrics, ranking_summary, leaderboard_rank, family_mean_std, task_correlation, ablation_gain, jsonl_roundtrip,
    mysqldump_scan, incremental_resume,
)}

# SQL

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _strip(x: str) -> str:
    return _STRIP.format(x)


_SPLIT = f"lower({_strip('split')})"
_M = f"m AS (SELECT DISTINCT id, question, {_SPLIT} AS split, source, matching_corpus_titles, relevant_doc_ids FROM mteb_matches WHERE id IS NOT NULL)"
_LATEST = """latest AS (
  SELECT id, ord, chemistry, coalesce(chemistry AND coalesce(error, '') = '', false) AS accepted FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord DESC) AS r FROM (SELECT DISTINCT * FROM topic_decisions) WHERE id IS NOT NULL) WHERE r = 1)"""


def _replace(x: str, rules: list[tuple[str, str]]) -> str:
    for a, b in rules:
        x = f"regexp_replace({x}, '{a}', '{b}', 'g')"
    return x


def _match_key(x: str) -> str:
    white = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{85}\x{0b}]"
    return _replace(f"lower(coalesce({x}, ''))", [(white + "+", " "), ("^ | $", "")] + [(a.replace(r"\s", white), b) for a, b in X.SPACING])


def _underscore(x: str) -> str:
    return _strip(f"replace({x}, ' ', '_')")


_URL = "(SELECT document.title AS title, document.url AS url FROM nq_source)"
_OLDID = "coalesce(nullif(url_decode(regexp_extract(replace(url, '&amp;', '&'), '[?&]oldid=([^&#]*)', 1)), ''), 'no_oldid')"


def _safe(x: str, n: int) -> str:
    inner = _replace(_strip(f"regexp_replace({x}, '[/\\\\]', '_', 'g')"), [("[^A-Za-z0-9._()-]+", "_"), ("_+", "_"), ("^[._]+|[._]+$", "")])
    return f"left(coalesce(nullif({inner}, ''), 'untitled'), {n})"


_VARIANT = f"""{_M},
{_LATEST},
docs AS (SELECT DISTINCT * FROM corpus),
wanted AS (SELECT DISTINCT {_underscore('article_title')} AS k FROM article_members WHERE article_title IS NOT NULL)"""


def _qrels(ids: str) -> str:
    return f"(SELECT DISTINCT id, unnest(relevant_doc_ids) AS doc_id, split FROM m WHERE id IN ({ids}))"


_RANKED = """v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings),
pairs AS (
  SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_cosine_similarity(q.e, d.e), 9) AS score, q.label = d.label AS rel
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM pairs) WHERE rank <= 100)"""
_METRICS = f"""{_RANKED},
total AS (SELECT query_id, count(*) AS r FROM pairs WHERE rel GROUP BY query_id),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS nth FROM ranked WHERE rel),
agg AS (
  SELECT query_id, sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) END) AS dcg, {', '.join(f'count(*) FILTER (rank <= {k}) AS h{k}' for k in (1, 3, 10, 100))},
    min(rank) AS first_, sum(nth / rank) AS ap FROM hits GROUP BY query_id),
metrics AS (
  SELECT t.query_id, coalesce(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) x(i) WHERE i <= r), 0) AS ndcg_at_10,
    {', '.join(f'coalesce(h{k} / r, 0) AS recall_at_{k}' for k in (1, 3, 10, 100))}, {', '.join(f'coalesce(h{k} / {k}.0, 0) AS precision_at_{k}' for k in (1, 3, 10))},
    CASE WHEN first_ <= 10 THEN 1.0 / first_ ELSE 0 END AS mrr_at_10, coalesce(ap / r, 0) AS map_at_100
  FROM total t LEFT JOIN agg USING (query_id))"""
_METRIC_NAMES = ["ndcg_at_10", *[f"recall_at_{k}" for k in (1, 3, 10, 100)], *[f"precision_at_{k}" for k in (1, 3, 10)], "mrr_at_10", "map_at_100"]
_BOARD = """board AS (
  SELECT c_nationkey, c_mktsegment AS task, avg(c_acctbal) AS score, 'family' || (c_nationkey % 5) || '-' || c_nationkey AS model, 'family' || (c_nationkey % 5) AS family
  FROM customer GROUP BY c_nationkey, c_mktsegment)"""
_STOP = "low IN ({}) OR regexp_matches(low, '^({})')".format(", ".join(f"'{x}'" for x in X.STOP_SECTIONS), "|".join(X.STOP_PREFIXES))


def _set_report(name: str, a: str, b: str) -> str:
    return f"""SELECT '{name}' AS name, count(a.id) AS n_a, count(b.id) AS n_b, count(*) FILTER (b.id IS NULL) AS only_a, count(*) FILTER (a.id IS NULL) AS only_b,
  count(*) FILTER (a.id IS NOT NULL AND b.id IS NOT NULL) AS common FROM (SELECT DISTINCT id FROM ({a})) a FULL JOIN (SELECT DISTINCT id FROM ({b})) b ON a.id = b.id"""


SQL = {
    "wiki_url_encode": """SELECT DISTINCT article_title, 'https://wiki.example/wiki/' || replace(replace(replace(replace(url_encode(replace(article_title, ' ', '_')),
  '%2F', '/'), '%3A', ':'), '%28', '('), '%29', ')') AS url FROM article_members WHERE article_title IS NOT NULL""",
    "page_url_params": f"""SELECT DISTINCT url, {_OLDID} AS oldid, nullif(url_decode(regexp_extract(replace(url, '&amp;', '&'), '[?&]title=([^&#]*)', 1)), '') AS title FROM {_URL}""",
    "safe_part_keys": f"""SELECT DISTINCT title, url, {_safe('title', 140)} AS safe, {_safe('title', 140)} || '__oldid_' || {_safe(_OLDID, 40)} AS article_id FROM {_URL} WHERE title IS NOT NULL""",
    "clamp_and_normalize_label": """SELECT ord, label, confidence_score, label <> 'drop' AS expand_descendants, label = 'keep' AND confidence_score >= 2 AS include_direct_articles,
  CASE WHEN label = 'keep' THEN 'keep' ELSE 'drop' END AS article_label FROM (
  SELECT DISTINCT ord, CASE ord % 6 WHEN 0 THEN 'keep' WHEN 1 THEN 'mixed' WHEN 2 THEN 'mixed' ELSE 'drop' END AS label,
    CASE WHEN ord % 5 = 0 THEN 0 ELSE greatest(0, least(3, ord % 7 - 1)) END AS confidence_score FROM topic_decisions)""",
    "json_props": "SELECT event_id, CASE WHEN event_id % 3 = 2 THEN CAST(props->>'k' AS BIGINT) ELSE CAST(props->>'k' AS BIGINT) END AS k, false AS no_object FROM events",
    "usage_totals": "SELECT event_type, 'k' AS key, sum(CAST(props->>'k' AS DOUBLE)) AS total, count(*) AS n FROM events GROUP BY event_type",
    "title_semi_join": f"""WITH q AS MATERIALIZED (SELECT DISTINCT id, document.title AS title FROM nq_source),
k AS (SELECT DISTINCT {_underscore('article_title')} AS k FROM article_members WHERE article_title IS NOT NULL)
SELECT id, title FROM q WHERE {_underscore('title')} IN (SELECT k FROM k)""",
    "topic_latest_decision": f"WITH {_LATEST} SELECT id, ord, chemistry, accepted FROM latest",
    "topic_ever_decided": "SELECT DISTINCT id FROM topic_decisions WHERE id IS NOT NULL AND chemistry IS NOT NULL",
    "pending_anti_join": """SELECT DISTINCT id, question FROM mteb_matches WHERE id IS NOT NULL
  AND id NOT IN (SELECT id FROM topic_decisions WHERE id IS NOT NULL AND chemistry IS NOT NULL) ORDER BY id, question LIMIT 50""",
    "missing_decisions": f"""SELECT split, count(*) AS ids, count(*) FILTER (l.id IS NULL) AS missing FROM (SELECT DISTINCT id, {_SPLIT} AS split FROM mteb_matches) m
LEFT JOIN (SELECT DISTINCT id FROM topic_decisions) l USING (id) GROUP BY split""",
    "decision_inner_join": f"""WITH {_M}, {_LATEST}
SELECT q.id, count(*) AS docs, min(q.doc_id) AS first_doc FROM (SELECT DISTINCT id, unnest(relevant_doc_ids) AS doc_id FROM m WHERE id IN (SELECT id FROM latest WHERE accepted)) q
JOIN (SELECT DISTINCT _id FROM corpus) c ON c._id = q.doc_id GROUP BY q.id""",
    "first_wins_by_key": """SELECT question, ord, id, model FROM (
  SELECT *, row_number() OVER (PARTITION BY question ORDER BY ord, id NULLS FIRST, model NULLS FIRST) AS r FROM (SELECT DISTINCT question, ord, id, model FROM topic_decisions WHERE question IS NOT NULL))
WHERE r = 1""",
    "section_key_lookup": f"""WITH d AS (SELECT title, lower({_strip('section')}) AS section_key, min(_id) AS doc_id FROM corpus WHERE title IS NOT NULL AND section IS NOT NULL GROUP BY ALL)
SELECT s.id, s.title, s.section_key, d.doc_id FROM (SELECT DISTINCT id, title, lower({_strip('section')}) AS section_key FROM article_sections) s LEFT JOIN d USING (title, section_key)""",
    "latest_snapshot": """SELECT title, article_id, revision FROM (
  SELECT *, row_number() OVER (PARTITION BY title ORDER BY revision DESC, article_id DESC) AS r FROM (
    SELECT DISTINCT title, article_id, coalesce(try_cast(oldid AS BIGINT), -1) AS revision FROM article_sections WHERE title IS NOT NULL AND article_id IS NOT NULL)) WHERE r = 1""",
    "dedup_with_existing": f"""WITH a AS (SELECT question, {_SPLIT} AS split FROM mteb_matches WHERE question IS NOT NULL)
SELECT split, count(*) AS matched, count(DISTINCT CASE WHEN question NOT IN (SELECT question FROM a WHERE split = 'train') THEN question END) AS added FROM a WHERE split <> 'train' GROUP BY split""",
    "dense_query_ids": f"""WITH {_M}, {_LATEST}, t AS (SELECT DISTINCT id FROM m WHERE split = 'test' AND id IN (SELECT id FROM latest WHERE accepted))
SELECT id, 'test' || (row_number() OVER (ORDER BY id) - 1) AS query_id FROM t""",
    "block_index": """SELECT article_id, id, n AS block_no, article_id || '::b' || lpad(CAST(n AS VARCHAR), 4, '0') AS block_id FROM (
  SELECT article_id, id, row_number() OVER (PARTITION BY article_id ORDER BY id) - 1 AS n FROM (SELECT DISTINCT article_id, id FROM article_sections WHERE article_id IS NOT NULL))""",
    "answer_filter": """WITH q AS MATERIALIZED (SELECT DISTINCT id, annotations AS a FROM nq_source),
f AS (
  SELECT id, list_filter(a.long_answer, lambda x: coalesce(x.start_byte >= 0 AND x.end_byte > x.start_byte AND x.candidate_index <> -1, false)) AS la,
    list_filter(flatten(list_transform(a.short_answers, lambda x: coalesce(x.text, []))), lambda t: coalesce(t <> '', false)) AS sa,
    list_filter(a.long_answer, lambda x: coalesce(x.start_token <> -1, false)) AS st, list_filter(a.yes_no_answer, lambda y: coalesce(upper(y) IN ('YES', 'NO'), false)) AS yn FROM q)
SELECT id, coalesce(len(st), 0) > 0 OR coalesce(len(sa), 0) > 0 OR coalesce(len(yn), 0) > 0 AS answerable, coalesce(len(la), 0) AS long_answers, coalesce(array_to_string(sa, '|'), '') AS short_text FROM f""",
    "qrel_title_match": f"""WITH {_M},
rel AS (SELECT id, matching_corpus_titles AS mt, unnest(relevant_doc_ids) AS doc_id, generate_subscripts(relevant_doc_ids, 1) AS pos FROM m),
docs AS (SELECT _id AS doc_id, min({_strip("replace(coalesce(title, ''), '_', ' ')")}) AS doc_title FROM corpus GROUP BY _id),
j AS (SELECT id, mt, pos, coalesce(doc_title, '') AS doc_title FROM rel LEFT JOIN docs USING (doc_id)),
firsts AS (SELECT id, doc_title, min(pos) AS pos FROM j GROUP BY id, doc_title)
SELECT a.id, a.titles, b.matching, b.listed FROM (SELECT id, string_agg(doc_title, '|' ORDER BY pos) AS titles FROM firsts GROUP BY id) a
JOIN (SELECT id, count(*) FILTER (coalesce(list_contains(list_transform(mt, lambda t: {_strip("replace(coalesce(t, ''), '_', ' ')")}), doc_title), false)) AS matching, count(*) AS listed FROM j GROUP BY id) b USING (id)""",
    "split_fraction": f"""WITH {_M}, r AS (SELECT DISTINCT id, split, coalesce(len(matching_corpus_titles), 0) > 1 AS several FROM m)
SELECT split, count(*) AS questions, count(*) FILTER (several) AS several, count(*) FILTER (several) / count(*) AS share FROM r GROUP BY split""",
    "qrels_histogram": f"""WITH {_M} SELECT docs, count(*) AS questions FROM (
  SELECT id, count(*) AS docs FROM (SELECT DISTINCT id, unnest(relevant_doc_ids) AS d FROM m) GROUP BY id) GROUP BY docs""",
    "broad_corpus_flags": f"""WITH {_VARIANT}, q AS (SELECT DISTINCT doc_id FROM {_qrels('SELECT id FROM latest WHERE accepted')}),
f AS (SELECT _id, coalesce(_id IN (SELECT doc_id FROM q WHERE doc_id IS NOT NULL), false) AS by_id, coalesce({_underscore('title')} IN (SELECT k FROM wanted), false) AS by_title FROM docs)
SELECT by_id, by_title, count(*) AS docs, count(DISTINCT _id) AS ids FROM f WHERE by_id OR by_title GROUP BY ALL""",
    "variant_build": f"""WITH {_VARIANT},
ids AS (SELECT DISTINCT 'title_match' AS variant, id FROM m UNION ALL SELECT 'accepted', id FROM latest WHERE accepted),
q AS (SELECT DISTINCT i.variant, m.id, unnest(m.relevant_doc_ids) AS doc_id, m.split FROM ids i JOIN m USING (id)),
p AS (SELECT DISTINCT variant, doc_id FROM q)
SELECT v.variant, v.queries, (SELECT count(*) FROM q WHERE q.variant = v.variant) AS qrels, (SELECT count(*) FROM p WHERE p.variant = v.variant) AS positives,
  (SELECT count(*) FROM p WHERE p.variant = v.variant AND doc_id NOT IN (SELECT _id FROM docs WHERE _id IS NOT NULL)) AS missing
FROM (SELECT variant, count(DISTINCT m.id) AS queries FROM ids JOIN m USING (id) GROUP BY variant) v""",
    "id_set_verification": f"""WITH {_M}
{_set_report('all', 'SELECT id FROM m', 'SELECT id FROM topic_decisions WHERE id IS NOT NULL')} UNION ALL
{_set_report('train_dev', "SELECT id FROM m WHERE split IN ('train', 'dev')", 'SELECT id FROM topic_decisions WHERE id IS NOT NULL')} UNION ALL
{_set_report('documents', 'SELECT id FROM (SELECT unnest(relevant_doc_ids) AS id FROM m) WHERE id IS NOT NULL', 'SELECT _id AS id FROM corpus WHERE _id IS NOT NULL')}""",
    "split_union": f"WITH {_M} SELECT split, source, count(*) AS rows_, count(DISTINCT id) AS ids FROM m WHERE question <> '' AND split IN ('train', 'dev', 'test') GROUP BY ALL",
    "bad_intro_texts": rf"SELECT _id, coalesce(regexp_matches({_strip('text')}, '{X.BAD_INTRO}'), false) AS bad FROM (SELECT DISTINCT _id, text FROM corpus)",
    "corpus_profile": rf"""SELECT count(*) AS rows_, count(DISTINCT _id) AS unique_ids, count(DISTINCT title) AS article_ids, count(_id) - count(DISTINCT _id) AS duplicate_ids,
  count(*) FILTER (coalesce(trim(text), '') = '') AS empty_text, count(*) FILTER (regexp_matches(text, '{X.FRAGMENTS}')) AS bad_fragments, count(*) FILTER (contains(lower(text), 'isbn') OR contains(lower(text), 'doi:')) AS reference_like,
  count(*) FILTER (contains(lower(text), 'http')) AS external_like, min(length(text)) AS min_len, max(length(text)) AS max_len, CAST(sum(length(text)) AS BIGINT) AS total_len FROM corpus""",
    "sorted_limit": "SELECT DISTINCT category_title, depth FROM categories ORDER BY depth NULLS LAST, category_title LIMIT 25",
    "sorted_exports": f"""WITH {_M}, q AS (SELECT DISTINCT id, unnest(relevant_doc_ids) AS d FROM m)
SELECT id AS "query-id", d AS "corpus-id", row_number() OVER (PARTITION BY id ORDER BY d) AS place, '1' AS score FROM q""",
    "retrieval_topk": f"WITH {_RANKED} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM ranked WHERE rank <= 10",
    "ranking_metrics": f"WITH {_METRICS} SELECT * FROM metrics",
    "ranking_summary": f"WITH {_METRICS} SELECT {', '.join(f'avg({n}) AS {n}' for n in _METRIC_NAMES)} FROM metrics",
    "leaderboard_rank": f"""WITH {_BOARD} SELECT task, model, rank() OVER (PARTITION BY task ORDER BY score DESC) AS rank, round(score, 4) AS score,
  round(max(score) OVER (PARTITION BY task) - score, 4) AS behind_best FROM board""",
    "family_mean_std": f"WITH {_BOARD} SELECT family, task, round(avg(score), 4) AS mean, round(stddev_samp(score), 4) AS deviation, arg_max(model, score) AS best, count(*) AS models FROM board GROUP BY ALL",
    "task_correlation": f"WITH {_BOARD} SELECT a.task, b.task AS other, round(corr(a.score, b.score), 6) AS correlation, count(*) AS models FROM board a JOIN board b USING (model) WHERE a.task < b.task GROUP BY ALL",
    "ablation_gain": f"WITH {_BOARD} SELECT family, task, model, round(score - lag(score) OVER (PARTITION BY family, task ORDER BY c_nationkey), 4) AS gain FROM board",
    "jsonl_roundtrip": "SELECT category_title, page_id, depth, coalesce(array_to_string(path, '|'), '') AS path, is_redirect, page_len FROM categories",
    "mysqldump_scan": """SELECT count(*) AS rows_, count(DISTINCT page_id) AS pages, CAST(sum(page_len) AS BIGINT) AS total_len, count(*) FILTER (is_redirect) AS redirects,
  count(*) FILTER (page_len IS NULL) AS null_len, CAST(sum(length(article_title)) AS BIGINT) AS title_chars
FROM (SELECT DISTINCT page_id, article_title, is_redirect, page_len FROM article_members WHERE page_id IS NOT NULL AND article_title IS NOT NULL)""",
    "incremental_resume": """WITH r AS (SELECT DISTINCT id, ord, split FROM topic_decisions WHERE id IS NOT NULL),
o AS (SELECT id, split, row_number() OVER (PARTITION BY id ORDER BY ord % 2, ord) AS n FROM r)
SELECT split, count(*) AS rows_, count(DISTINCT id) AS ids FROM o WHERE n = 1 GROUP BY split""",
}
