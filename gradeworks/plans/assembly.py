"""Registered queries: sources and sinks, corpus assembly, joins and dedupe."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeworks.functions.titles import class_mentions, normalise_title
from gradeworks.operators import corpus
from gradeworks.operators import features as feats
from gradeworks.operators import metrics, staleness
from gradeworks.plans import bindings as b
from gradeworks.plans.registry import query
from gradeworks.plans.shape import tidy
from gradeworks.plans.twin_sql import GRADE_LIST, twin
from gradeworks.schemas import GRADES
from gradeworks.sources import json_object, lineage, records
from gradeworks.session import input_state, shared_dir

_paths: dict[tuple, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def raw_json(spark: SparkSession, sf: str) -> str:
    """The records as JSON lines with blank lines, some of them written twice."""
    key = (spark.sparkContext.applicationId, sf, input_state(spark, sf))
    if key not in _paths:
        path = scratch(spark, "raw")
        df = b.raw_records(spark, sf)
        line = F.to_json(F.struct(*df.columns))
        twice = F.when(F.col("pageid") % 10 == 0, F.array(line, F.lit(""), line)).otherwise(F.array(line))
        df.select(F.explode(twice).alias("value")).write.text(path)
        _paths[key] = path
    return _paths[key]


TWICE = "SELECT * FROM records UNION ALL SELECT * FROM records WHERE pageid % 10 = 0"


@query("A1_raw_scan", twin(f"""SELECT pageid, label, CAST(bytes AS BIGINT) AS bytes, CAST(edits AS BIGINT) AS edits, created,
    array_to_string(categories, '|') AS categories, md5(wikitext) AS digest FROM ({TWICE})""", "records"))
def raw_scan(spark, sf):
    df = records.read_raw(spark, raw_json(spark, sf))
    return df.select("pageid", "label", "bytes", "edits", "created",
                     F.concat_ws("|", "categories").alias("categories"), F.md5("wikitext").alias("digest"))


@query("A2_existing_keys", twin("SELECT pageid FROM records WHERE label = 'GA'", "records"))
def existing_keys(spark, sf):
    """Keys of one grade, from that grade's folder of the store."""
    store = scratch(spark, "store")
    records.write_raw(records.read_raw(spark, raw_json(spark, sf)), store)
    return records.existing_keys(records.read_raw(spark, store, grade="GA"))


@query("A3_append_new", twin("SELECT pageid, label, CAST(bytes AS BIGINT) AS bytes FROM records", "records"))
def append_new(spark, sf):
    raw = records.read_raw(spark, raw_json(spark, sf))
    store = scratch(spark, "store")
    records.write_raw(feats.first_per_key(raw.filter(F.col("label").isin("Stub", "Start")), ["pageid"],
                                          F.col("revid")), store)
    records.append_new(raw, store)
    return records.read_raw(spark, store).select("pageid", "label", "bytes")


@query("A4_parquet_scan_pruned", "SELECT doc_id, lang, n_chars FROM documents")
def parquet_scan_pruned(spark, sf):
    return records.read_columns(spark, f"{sf}/documents.parquet", ["doc_id", "lang", "n_chars"])


@query("A5_parquet_sink", twin("SELECT label, count(*) AS n, CAST(sum(words) AS BIGINT) AS words FROM features GROUP BY label", "features"))
def parquet_sink(spark, sf):
    path = scratch(spark, "features")
    records.write_parquet(b.features(spark, sf), path, by=["label"])
    back = spark.read.parquet(path)
    return back.groupBy("label").agg(F.count("*").alias("n"), F.sum("words").alias("words"))


@query("A6_frozen_sink", twin("SELECT split, count(*) AS n, true AS second_refused FROM splits GROUP BY split", "splits"))
def frozen_sink(spark, sf):
    path = scratch(spark, "frozen")
    table = b.split_table(spark, sf)
    records.write_frozen(table, path)
    try:
        records.write_frozen(table, path)
        refused = False
    except AnalysisException:
        refused = True
    return feats.split_sizes(spark.read.parquet(path)).withColumn("second_refused", F.lit(refused))


def _manifest_sql(name: str, columns: list[str]) -> str:
    text = "concat_ws(';', " + ", ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in columns) + ")"
    sums = ", ".join(f"CAST(sum(CAST('0x' || substring(d, {1 + 15 * i}, 15) AS BIGINT)) AS VARCHAR)" for i in range(4))
    stage, parent = MANIFEST[name]
    return f"""SELECT '{name}' AS name, '{stage}' AS stage, count(*) AS rows, CAST({len(columns)} AS BIGINT) AS cols, true AS has_bytes,
        sha256(concat_ws(',', CAST(count(*) AS VARCHAR), {sums})) AS sha256, 'make {name}' AS producer_target, {f"'{parent}'" if parent else 'NULL'} AS parent
        FROM (SELECT sha256({text}) AS d FROM {name})"""


FINGERPRINTED = {"labels": ["doc_id", "quality", "toxic"], "nation": ["n_nationkey", "n_name", "n_regionkey"],
                 "documents": ["doc_id", "text", "lang", "source", "n_chars"],
                 "conversations": ["conv_id", "turn", "role", "text"]}
MANIFEST = {"labels": ("graded", "documents"), "nation": ("raw", None), "documents": ("raw", None), "conversations": ("raw", None)}


@query("A7_dataset_manifest", " UNION ALL ".join(_manifest_sql(n, c) for n, c in FINGERPRINTED.items()))
def dataset_manifest(spark, sf):
    """Lineage rows of four datasets; two of them replace older ones. Paths and sizes differ from machine to machine."""
    def rows(names, stamp):
        out = None
        for n in names:
            stage, parent = MANIFEST[n]
            one = lineage.dataset_row(spark, n, stage, f"{sf}/{n}.parquet", f"make {n}", parent, F.lit(stamp), FINGERPRINTED[n])
            out = one if out is None else out.unionByName(one)
        return out
    stale = rows(["labels", "nation"], "2024-01-01").withColumn("sha256", F.lit("stale"))
    manifest = lineage.upsert(stale, rows(list(FINGERPRINTED), "2024-01-02"))
    return manifest.withColumn("has_bytes", F.col("bytes") > 0).drop("created", "path", "bytes")


@query("A8_latest_run", """SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS run_id, event_id, round(value, 6) AS value FROM (
    SELECT *, max(CAST(ts AS DATE)) OVER (PARTITION BY event_type) AS newest FROM events) WHERE CAST(ts AS DATE) = newest""")
def latest_run(spark, sf):
    runs = b.table(spark, sf, "events").select(
        "event_type", F.date_format("ts", "yyyy-MM-dd").alias("run_id"), "event_id", F.round("value", 6).alias("value"))
    return lineage.latest_run(runs, ["event_type"])


@query("A9_json_side_table", twin("""SELECT f.pageid, f.label, CASE WHEN pageid % 4 <> 0 THEN 'Grade ' || (pageid % 5) END AS grade,
    CASE WHEN pageid % 4 <> 0 THEN 'T' || pageid END AS title FROM features f""", "features"))
def json_side_table(spark, sf):
    """Entries by article, as objects of many entries in a few files; every fourth one sits under a key of another page."""
    record = T.StructType([T.StructField("title", T.StringType()), T.StructField("grade", T.StringType())])
    entries = b.table(spark, sf, "documents").select(F.expr(
        "'\"' || CASE WHEN doc_id % 4 = 0 THEN -1 - doc_id ELSE doc_id END || '\": {\"title\": \"T' || doc_id || '\", \"grade\": \"Grade ' || (doc_id % 5) || '\"}'"
    ).alias("value"))

    def one_object(batches):  # opened, entry by entry, closed: a partition's rows become one object
        last = None
        yield pa.RecordBatch.from_pydict({"value": ["{"]})
        for batch in batches:
            values = batch.column("value").to_pylist()
            if values:
                yield pa.RecordBatch.from_pydict({"value": [*([] if last is None else [last + ","]), *[v + "," for v in values[:-1]]]}, pa.schema([("value", pa.string())]))
                last = values[-1]
        yield pa.RecordBatch.from_pydict({"value": [last or "", "}"]})

    path = scratch(spark, "side-table")
    entries.mapInArrow(one_object, "value string").write.text(path)
    side = json_object.read_object(spark, path, record)
    return b.features(spark, sf).select("pageid", "label").join(side, on="pageid", how="left")


REVIEW = """SELECT r.pageid, a.title, a.label AS human_grade, r.y, r.d, r.bucket FROM (
    SELECT pageid, CAST(y AS BIGINT) AS y, round(d, 3) AS d, CASE WHEN rn <= 20 THEN 'high' WHEN rn > n - 20 THEN 'low' ELSE 'mid' END AS bucket
    FROM (SELECT *, row_number() OVER (ORDER BY d DESC, pageid) AS rn, count(*) OVER () AS n FROM scored)
    WHERE rn <= 20 OR rn > n - 20 OR (rn > floor(n / 2) - 10 AND rn <= floor(n / 2) + 10)) r JOIN articles a USING (pageid)"""


@query("A10_csv_sink", twin(REVIEW, "scored", "articles"))
def csv_sink(spark, sf):
    """The review sheet with what a reader needs to judge each page."""
    path = scratch(spark, "review")
    sheet = staleness.review_buckets(b.scored_pages(spark, sf).select("pageid", "y", "d"))  # sixty rows
    named = b.articles(spark, sf).select("pageid", "title", F.col("label").alias("human_grade"))
    records.write_csv(named.join(F.broadcast(sheet), on="pageid").select("pageid", "title", "human_grade", "y", "d", "bucket"), path)
    return spark.read.schema("pageid long, title string, human_grade string, y long, d double, bucket string").option(
        "header", True).csv(path)


@query("A11_merge_external_rows", twin("""SELECT config, count(*) AS n, round(avg(CAST(y = pred AS DOUBLE)), 6) AS acc,
    CASE WHEN config <> 'first' THEN 'external' END AS note FROM predictions GROUP BY config""", "predictions"))
def merge_external_rows(spark, sf):
    own = metrics.all_metrics(b.predictions(spark, sf), by=["config"]).select("config", "n", "acc")
    external = own.withColumn("note", F.lit("external"))
    merged = lineage.merge_external(own.filter(F.col("config") == "first"), external)
    return tidy(merged)


def payloads(spark: SparkSession, sf: str) -> DataFrame:
    """One query payload per article; some pages are missing, redirects or disambiguations."""
    df = b.raw_records(spark, sf)
    text = F.when(F.col("pageid") % 5 == 0, F.create_map(F.lit("content"), F.col("wikitext"))).otherwise(
        F.create_map(F.lit("*"), F.col("wikitext")))
    empty = F.lit("")
    page = F.struct(
        "pageid", "title", F.when(F.col("pageid") % 19 == 0, empty).alias("missing"), F.col("bytes").alias("length"),
        F.when(F.col("pageid") % 29 == 0, empty).alias("redirect"),
        F.array(F.struct("revid", F.col("last_edit").alias("timestamp"), F.struct(text.alias("main")).alias("slots"))).alias("revisions"),
        F.when(F.col("pageid") % 2 == 0, F.array(F.struct(F.lit("edit").alias("type"), F.lit("sysop").alias("level")))).alias("protection"),
        F.when(F.col("pageid") % 31 == 0, F.create_map(F.lit("disambiguation"), empty)).alias("pageprops"),
        F.transform("categories", lambda c: F.struct(c.alias("title"))).alias("categories"),
        F.when(F.col("pageid") % 3 == 0, F.array(F.struct(F.lit("Template:Infobox").alias("title")))).alias("templates"))
    pages = F.create_map(F.col("pageid").cast("string"), page)
    return df.select(F.to_json(F.struct(F.struct(pages.alias("pages")).alias("query"))).alias("body"))


@query("A12_api_payload_flatten", twin("""SELECT pageid, title, revid, md5(wikitext) AS digest, CAST(bytes AS BIGINT) AS bytes, last_edit,
    CASE WHEN pageid % 2 = 0 THEN 'edit:sysop' ELSE '' END AS protection, pageid % 29 = 0 AS is_redirect,
    pageid % 31 = 0 AS is_disambig FROM records WHERE pageid % 19 <> 0""", "records"))
def api_payload_flatten(spark, sf):
    flat = records.flatten_pages(payloads(spark, sf), F.col("body"))
    return flat.withColumns({"digest": F.md5("wikitext"), "protection": F.concat_ws("|", "protection")}).drop("wikitext")


@query("A13_list_props", twin("""SELECT pageid, array_to_string(categories, '|') AS categories,
    CASE WHEN pageid % 3 = 0 THEN 'Template:Infobox' ELSE '' END AS templates FROM records""", "records"))
def list_props(spark, sf):
    props = records.list_props(payloads(spark, sf), F.col("body"))
    return props.select("pageid", F.concat_ws("|", "categories").alias("categories"), F.concat_ws("|", "templates").alias("templates"))


@query("B1_resolve_label", twin("SELECT page_id, label, n_projects, n_disagree FROM resolved", "resolved"))
def resolve_label(spark, sf):
    return corpus.resolve_label(b.assessments(spark, sf))


def _all_pages(spark, sf):
    return b.table(spark, sf, "customer").select(F.col("c_custkey").alias("page_id"))


@query("B2_label_fallback", twin("""SELECT c_custkey AS page_id, coalesce(label, 'Stub') AS label, coalesce(n_projects, 0) AS n_projects,
    coalesce(n_disagree, 0) AS n_disagree FROM customer LEFT JOIN resolved ON c_custkey = page_id""", "resolved"))
def label_fallback(spark, sf):
    return corpus.label_or_fallback(_all_pages(spark, sf), corpus.resolve_label(b.assessments(spark, sf)), F.lit("Stub"))


@query("B3_category_members", twin("SELECT title, member_id FROM members WHERE category = 'B-Class Brand#2 articles' AND namespace = 0", "members"))
def category_members(spark, sf):
    return corpus.category_members(b.members(spark, sf), "B-Class Brand#2 articles").select("title", "member_id")


@query("B4_class_categories", twin("""SELECT category, count(*) AS n FROM members
    WHERE starts_with(category, 'B-Class ') AND NOT contains(category, '-importance') GROUP BY category""", "members"))
def class_categories(spark, sf):
    return corpus.class_categories(b.members(spark, sf), "B").groupBy("category").agg(F.count("*").alias("n"))


@query("B5_round_robin_sample", twin("""SELECT title, "round", cat_order, rn FROM (
    SELECT *, row_number() OVER (PARTITION BY title ORDER BY "round", cat_order, rn) AS seen FROM (
    SELECT substring(m.title, 6) AS title, CAST(floor((rn - 1) / 25) AS BIGINT) AS "round", cat_order, rn FROM (
        SELECT *, row_number() OVER (PARTITION BY category ORDER BY member_id) AS rn FROM members) m
    JOIN (SELECT category, row_number() OVER (ORDER BY md5('42' || category), category) AS cat_order FROM (
        SELECT DISTINCT category FROM members WHERE NOT contains(category, '-importance'))) o USING (category)
    WHERE cat_order <= 80)) WHERE seen = 1""", "members"))
def round_robin_sample(spark, sf):
    members = b.members(spark, sf)
    order = corpus.category_order(corpus.class_categories(members, "B"), 42)
    return tidy(corpus.round_robin(members, order))


@query("B6_revision_counts", twin("SELECT * EXCLUDE (created), epoch_us(created) AS created_us FROM history", "history"))
def revision_counts(spark, sf):
    return b.history(spark, sf).withColumn("created_us", F.unix_micros("created")).drop("created")


@query("B7_pageviews_mean", twin("SELECT page_id, round(pageviews_90d_mean, 6) AS pageviews_90d_mean FROM views", "views"))
def pageviews_mean(spark, sf):
    return tidy(b.views(spark, sf))


LISTED = "CASE WHEN doc_id % 13 = 3 THEN 'Category:Lists' ELSE 'Category:Topic' END"
REASON = """CASE WHEN pageid % 29 = 0 THEN 'redirects' WHEN pageid % 31 = 0 THEN 'disambigs'
    WHEN starts_with(title, 'List of') THEN 'list_prefix' WHEN label <> 'Stub' AND n_chars < 100 THEN 'min_bytes_non_stub'"""
SIZED = "(SELECT a.*, n_chars, pageid % 13 = 3 AS listed FROM articles a JOIN documents ON doc_id = pageid)"


def _exclusions(spark, sf, with_lists: bool):
    size = b.table(spark, sf, "documents").select(F.col("doc_id").alias("pageid"), "n_chars", F.array(F.expr(LISTED)).alias("lists"))
    df = b.articles(spark, sf).select("pageid", "title", "label").join(size, on="pageid")
    reason = corpus.exclusion_reason(F.col("title"), F.col("pageid") % 29 == 0, F.col("pageid") % 31 == 0,
                                     F.col("n_chars"), F.col("label"), F.col("lists") if with_lists else None)
    return df.select("pageid", "lists", reason.alias("reason"))


@query("B8_exclusion_reason", twin(f"SELECT pageid, {REASON} END AS reason FROM {SIZED}", "articles"))
def exclusion_reason(spark, sf):
    return _exclusions(spark, sf, False).drop("lists")


@query("B9_exclude_list_category", twin(f"SELECT pageid FROM {SIZED} WHERE NOT listed", "articles"))
def exclude_list_category(spark, sf):
    return _exclusions(spark, sf, False).filter(~corpus.in_list_category(F.col("lists"))).select("pageid")


@query("B10_exclusion_counts", twin(f"""SELECT reason, count(*) AS n FROM (SELECT {REASON} WHEN listed THEN 'list_category' END AS reason FROM {SIZED})
    WHERE reason IS NOT NULL GROUP BY reason""", "articles"))
def exclusion_counts(spark, sf):
    return corpus.exclusion_counts(_exclusions(spark, sf, True))


@query("B11_quota_per_group", twin(f"""SELECT label, o_orderkey, rn FROM (SELECT {b.CLASS} AS label, o_orderkey,
    row_number() OVER (PARTITION BY {b.CLASS} ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) c
    LEFT JOIN (SELECT label, count(*) AS have FROM features GROUP BY label) h USING (label) WHERE rn <= 500 - coalesce(have, 0)""", "features"))
def quota_per_group(spark, sf):
    candidates = b.table(spark, sf, "orders").select(F.expr(b.CLASS).alias("label"), "o_orderkey", "o_orderdate")
    picked = corpus.fill_quota(candidates, b.features(spark, sf), 500, arrival="o_orderdate", tie="o_orderkey")
    return tidy(picked.select("label", "o_orderkey", "rn"))


@query("B12_label_matches_source", twin(f"""SELECT page_id, label, n_projects FROM resolved WHERE label = {GRADE_LIST}[page_id % 6 + 1]""", "resolved"))
def label_matches_source(spark, sf):
    names = F.array(*[F.lit(g) for g in GRADES])
    resolved = corpus.resolve_label(b.assessments(spark, sf)).withColumn("source_grade", F.get(names, (F.col("page_id") % 6).cast("int")))
    return corpus.keep_matching(resolved).select("page_id", "label", "n_projects")


@query("B13_assemble_record", twin("""SELECT a.pageid, a.title, coalesce(r.label, 'Stub') AS label, coalesce(n_projects, 0) AS n_projects,
    coalesce(n_disagree, 0) AS n_disagree, revid, md5(wikitext) AS digest, array_to_string(categories, '|') AS categories,
    round(v.pageviews_90d_mean, 6) AS pageviews_90d_mean, h.edits, h.editors,
    coalesce(strftime(h.created, '%Y-%m-%d'), 'never') AS created, '2024-01-31T00:00:00Z' AS fetch_ts
    FROM articles a LEFT JOIN resolved r ON r.page_id = a.pageid LEFT JOIN history h ON h.page_id = a.pageid
    LEFT JOIN views v ON v.page_id = a.pageid""", "articles", "resolved", "history", "views"))
def assemble_record(spark, sf):
    art = b.articles(spark, sf)
    resolved = corpus.resolve_label(b.assessments(spark, sf)).withColumnRenamed("page_id", "pageid")
    assessed = corpus.label_or_fallback(art.select("pageid", "title"), resolved, F.lit("Stub"), "pageid").withColumn(
        "project_classes", F.array().cast("array<array<string>>"))
    core = art.select("pageid", "revid", "wikitext", "bytes", F.array().cast("array<string>").alias("protection"),
                      F.lit("never").alias("last_edit"))
    lists = art.select("pageid", "categories", F.array().cast("array<string>").alias("templates"))
    history = b.history(spark, sf).withColumn("created", F.date_format("created", "yyyy-MM-dd")).withColumnRenamed("page_id", "pageid")
    views = b.views(spark, sf).withColumnRenamed("page_id", "pageid")
    out = corpus.assemble_records(assessed, core, lists, history, views, F.lit("2024-01-31T00:00:00Z"))
    shaped = out.withColumns({"digest": F.md5("wikitext"), "categories": F.concat_ws("|", "categories")})
    return tidy(shaped, "pageid", "title", "label", "n_projects", "n_disagree", "revid", "digest", "categories",
                "pageviews_90d_mean", "edits", "editors", "created", "fetch_ts")


@query("B14_validate_raw", twin(f"""SELECT total, dups, missing, round(missing / total, 4) AS missing_rate, missing / total >= 0.01 AS warn FROM (
    SELECT count(*) AS total, count(*) - count(DISTINCT pageid) AS dups, count(*) FILTER (WHERE pageid % 43 = 0) AS missing FROM ({TWICE}))""", "records"))
def validate_raw(spark, sf):
    raw = records.read_raw(spark, raw_json(spark, sf))
    return corpus.validate_records(raw.withColumn("title", F.when(F.col("pageid") % 43 == 0, "").otherwise(F.col("title"))))


TALK = """(SELECT user_id AS page_id, event_id AS rev_id, ts, value < 12 AS ga, CASE WHEN value < 12 THEN 'GA,B' ELSE 'B' END AS mentions FROM events)"""


@query("B15_class_mentions", f"SELECT rev_id, mentions FROM {TALK}")
def mentions(spark, sf):
    return b.talk_texts(spark, sf).select("rev_id", F.array_join(class_mentions(F.col("text")), ",").alias("mentions"))


@query("B16_grade_date", f"""SELECT page_id, epoch_us(min(ts) FILTER (WHERE ga AND (last_break IS NULL OR (ts, rev_id) > last_break))) AS grade_us
    FROM (SELECT *, max((ts, rev_id)) FILTER (WHERE NOT ga) OVER (PARTITION BY page_id) AS last_break FROM {TALK}) GROUP BY page_id""")
def grade_date(spark, sf):
    return corpus.grade_dates(b.talk_texts(spark, sf), F.lit("GA")).select("page_id", F.unix_micros("grade_ts").alias("grade_us"))


@query("B17_normalise_title", r"""SELECT page_id, url_decode(replace(replace(split_part(regexp_replace(trim(u), '^(https?://)?(en\.(m\.)?wikipedia\.org)?/?(wiki/)?', ''), '#', 1), '_', ' '), '+', '%2B')) AS title
    FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN ' https://en.wikipedia.org/wiki/Page_' || page_id || '%20A+B#Top ' WHEN page_id % 3 = 1 THEN 'wiki/Page_' || page_id ELSE url END AS u FROM pages)""")
def titles(spark, sf):
    url = F.expr("CASE WHEN page_id % 3 = 0 THEN ' https://en.wikipedia.org/wiki/Page_' || page_id || '%20A+B#Top ' WHEN page_id % 3 = 1 THEN 'wiki/Page_' || page_id ELSE url END")
    return b.table(spark, sf, "pages").select("page_id", normalise_title(url).alias("title"))


@query("B18_progress_rate", """SELECT done, CAST(24000 AS BIGINT) AS total, round(done / mins, 1) AS rate_per_min, CASE WHEN done > 0 THEN round_even(greatest(24000 - done, 0) / (done / mins), 0) END AS eta_min
    FROM (SELECT count(*) AS done, greatest((epoch(max(ts)) - epoch(min(ts))) / 60, 1e-6) AS mins FROM events)""")
def progress_rate(spark, sf):
    return corpus.progress(b.table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts")), 4000)


@query("J1_join_left_created", twin("SELECT pageid, label, created FROM dated", "dated"))
def join_left_created(spark, sf):
    return b.features(spark, sf).select("pageid", "label").join(b.interim(spark, sf).select("pageid", "created"), on="pageid", how="left")


@query("J2_join_left_words", twin("SELECT f.pageid, f.label, CAST(i.word_count AS BIGINT) AS word_count FROM features f LEFT JOIN interim i USING (pageid)", "dated"))
def join_left_words(spark, sf):
    words = b.interim(spark, sf).select("pageid", "word_count")
    return tidy(b.features(spark, sf).select("pageid", "label").join(words, on="pageid", how="left"))


@query("J3_join_split_inner", twin("""SELECT pageid, label, min(s.split) AS split FROM features JOIN (
    SELECT pageid, split FROM splits UNION ALL SELECT pageid, 'val' FROM splits WHERE split = 'train') s USING (pageid) GROUP BY pageid, label""", "splits"))
def join_split_inner(spark, sf):
    assigned = b.split_table(spark, sf).select("pageid", "split")
    repeated = assigned.unionByName(assigned.filter(F.col("split") == "train").withColumn("split", F.lit("val")))
    twice = b.features(spark, sf).unionByName(b.features(spark, sf))
    return feats.attach_split(twice, repeated).select("pageid", "label", "split")


@query("J4_join_logits", twin("SELECT s.pageid, s.split, round(o.logits[1], 6) AS logit_0 FROM splits s JOIN one o USING (pageid)", "splits", "one"))
def join_logits(spark, sf):
    logits = b.predictions_one(spark, sf).select("pageid", F.lit("other").alias("split"), F.get("logits", F.lit(0)).alias("logit_0"))
    return tidy(b.split_table(spark, sf).select("pageid", "split").join(logits.drop("split"), on="pageid", how="inner"))


@query("J5_semi_texts", "SELECT vec_id AS pageid FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE n_chars > 0)")
def semi_texts(spark, sf):
    texts = b.table(spark, sf, "documents").filter(F.col("n_chars") > 0).select(F.col("doc_id").alias("pageid"))
    return b.table(spark, sf, "embeddings").select(F.col("vec_id").alias("pageid")).join(texts, on="pageid", how="left_semi")


@query("J6_join_revid", twin("SELECT s.pageid, s.label, i.revid FROM splits s LEFT JOIN interim i USING (pageid) WHERE s.split = 'test'", "splits", "interim"))
def join_revid(spark, sf):
    revs = feats.first_per_key(b.interim(spark, sf).select("pageid", "revid"), ["pageid"], F.col("revid"))
    return b.split_table(spark, sf).filter(F.col("split") == "test").select("pageid", "label").join(revs, on="pageid", how="left")


@query("J7_anti_done", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_done(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id").join(b.table(spark, sf, "labels"), on="doc_id", how="left_anti")


@query("J8_union_splits", twin("SELECT pageid, label, split FROM splits", "splits"))
def union_splits(spark, sf):
    table = b.split_table(spark, sf)
    parts = [table.filter(F.col("split") == s).select("pageid", "label").withColumn("split", F.lit(s)) for s in ("train", "val", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("J9_dedupe_first", """SELECT pageid, arrival, event_type, round(value, 6) AS value, n_dropped FROM (
    SELECT user_id AS pageid, event_id AS arrival, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn,
        count(*) OVER () - (SELECT count(DISTINCT user_id) FROM events) AS n_dropped FROM events) WHERE rn = 1""")
def dedupe_first(spark, sf):
    source = b.dedupe_source(spark, sf)
    dropped = source.agg((F.count("*") - F.count_distinct("pageid")).alias("n_dropped")).withColumn("_k", F.lit(1))
    first = corpus.dedupe_first(source, "pageid", F.col("arrival")).withColumn("_k", F.lit(1))
    return tidy(first.join(F.broadcast(dropped), on="_k").drop("_k"))
