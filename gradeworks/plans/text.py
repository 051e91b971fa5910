"""Registered queries: text cleaning, feature columns, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeworks.functions import wikitext as w
from gradeworks.operators import features as feats
from gradeworks.operators.ranking import exact_quantiles
from gradeworks.plans import bindings as b
from gradeworks.plans.registry import query
from gradeworks.plans.shape import tidy
from gradeworks.plans.twin_sql import twin
from gradeworks.schemas import CARRIED, FEATURES
from gradeworks.session import write_table

TEXT = "wikitext"
GRADE_BLOCK = r"'(?i)\{\{\s*(?:featured (?:article|list)|good article|ga icon|fa icon)\s*(?:\|[^}]*)?\}\}'"


def _names(names: str) -> str:
    return twin(f"SELECT pageid, array_to_string({names}, '|') AS names FROM staged", "staged")


@query("T1_template_names", _names("all_names"))
def template_names(spark, sf):
    return b.articles(spark, sf).select("pageid", F.array_join(w.template_names(w.visible(F.col(TEXT))), "|").alias("names"))


@query("T2_strip_leak_templates", _names("names"))
def strip_leak_templates(spark, sf):
    return b.articles(spark, sf).select("pageid", F.array_join(w.keep_names(w.template_names(w.visible(F.col(TEXT)))), "|").alias("names"))


@query("T3_strip_leak_text", twin(f"""SELECT pageid, md5(regexp_replace(wikitext, {GRADE_BLOCK}, '', 'g')) AS digest,
    length(regexp_replace(wikitext, {GRADE_BLOCK}, '', 'g')) AS chars FROM articles""", "articles"))
def strip_leak_text(spark, sf):
    bare = w.strip_grade_blocks(F.col(TEXT))
    return tidy(b.articles(spark, sf).select("pageid", F.md5(bare).alias("digest"), F.length(bare).alias("chars")))


@query("T4_leak_position", twin(f"""SELECT count(*) AS n, median(CAST(o AS DOUBLE)) AS median_offset FROM (
    SELECT strpos(wikitext, regexp_extract(wikitext, {GRADE_BLOCK})) - 1 AS o FROM articles
    WHERE regexp_matches(wikitext, {GRADE_BLOCK}))""", "articles"))
def leak_position(spark, sf):
    found = b.articles(spark, sf).select(w.grade_block_offset(F.col(TEXT)).alias("at")).filter(F.col("at").isNotNull())
    middle = exact_quantiles(found, [], "at", {"median_offset": 0.5}).withColumn("_k", F.lit(1))
    return found.agg(F.count("*").alias("n")).withColumn("_k", F.lit(1)).join(middle, on="_k", how="left").drop("_k")


def _parsed(name: str, columns: list[str]) -> None:
    sql = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in columns)

    @query(name, twin(f"SELECT pageid, {sql} FROM interim", "interim"))
    def run(spark, sf):
        return tidy(w.parse_articles(b.articles(spark, sf)).select("pageid", *columns))


_parsed("T5_kept_categories", ["categories_n"])


@query("T6_refs", twin("SELECT pageid, CAST(ref_n AS BIGINT) AS ref_n, array_to_string(refs_raw, '|') AS refs FROM interim", "interim"))
def refs(spark, sf):
    df = w.parse_articles(b.articles(spark, sf))
    return tidy(df.select("pageid", "ref_n", F.array_join("refs_raw", "|").alias("refs")))


_parsed("T7_refs_distinct", ["refs_distinct"])
_parsed("T8_headings", ["section_l2_n", "section_l3_n"])


@query("T9_links", twin("SELECT pageid, array_to_string(targets, ';') AS targets FROM staged", "staged"))
def links(spark, sf):
    return b.articles(spark, sf).select("pageid", F.array_join(w.link_targets(F.col(TEXT)), ";").alias("targets"))


_parsed("T10_images_n", ["images_n"])
_parsed("T11_wikilinks_n", ["wikilinks_n"])
_parsed("T12_extlinks_n", ["extlinks_n"])
_parsed("T13_tables_n", ["tables_n"])
_parsed("T14_lists_n", ["lists_n"])
_parsed("T15_doi_isbn", ["doi_n", "isbn_n"])


@query("T16_infobox_cite_templates", twin("""SELECT pageid, infobox, CAST(cite_templates_n AS BIGINT) AS cite_templates_n,
    CAST(templates_n AS BIGINT) AS templates_n FROM interim""", "interim"))
def infobox_cite_templates(spark, sf):
    return tidy(w.parse_articles(b.articles(spark, sf)).select("pageid", "infobox", "cite_templates_n", "templates_n"))


_parsed("T17_cleanup_tags_n", ["cleanup_tags_n"])


@query("T18_clean_text", twin("SELECT pageid, md5(clean_text) AS digest, length(clean_text) AS chars FROM interim", "interim"))
def clean_text(spark, sf):
    df = w.parse_articles(b.articles(spark, sf)).select("pageid", "clean_text")
    return tidy(df.select("pageid", F.md5("clean_text").alias("digest"), F.length("clean_text").alias("chars")))


@query("T19_lead_text", twin("SELECT pageid, lead_text FROM interim", "interim"))
def lead_text(spark, sf):
    return w.parse_articles(b.articles(spark, sf)).select("pageid", "lead_text")


_parsed("T20_word_count", ["word_count"])
_parsed("T21_sentence_count", ["sentence_count"])

INTERIM_SCALARS = [c for c in CARRIED if c != "pageviews_90d_mean"]
PARSED_COUNTS = ["word_count", "sentence_count", "section_l2_n", "section_l3_n", "images_n", "tables_n", "wikilinks_n",
                 "extlinks_n", "lists_n", "cleanup_tags_n", "templates_n", "categories_n", "cite_templates_n", "ref_n",
                 "refs_distinct", "doi_n", "isbn_n"]
_TEXTS = {"title", "label", "created", "last_edit", "fetch_ts"}


@query("T22_clean_record", twin("SELECT " + ", ".join(c if c in _TEXTS else f"CAST({c} AS BIGINT) AS {c}" for c in INTERIM_SCALARS + PARSED_COUNTS)
       + ", infobox, round(pageviews_90d_mean, 6) AS pageviews_90d_mean, md5(clean_text) AS clean_text, md5(lead_text) AS lead_text,"
         " array_to_string(refs_raw, '|') AS refs_raw FROM interim", "interim"))
def clean_record(spark, sf):
    df = feats.clean_records(b.raw_records(spark, sf))
    return tidy(df.withColumns({"clean_text": F.md5("clean_text"), "lead_text": F.md5("lead_text"),
                                "refs_raw": F.array_join("refs_raw", "|")}))


@query("T23_stratified_head", twin("""SELECT pageid, title, label AS grade, CAST(bytes AS BIGINT) AS bytes, CAST(ref_n AS BIGINT) AS refs,
    CAST(edits AS BIGINT) AS edits, CAST(n_projects AS BIGINT) AS n_projects, substring(lead_text, 1, 300) AS lead300 FROM (
    SELECT *, row_number() OVER (PARTITION BY label ORDER BY pageid) AS rn FROM interim) WHERE rn <= 5""", "interim"))
def stratified_head(spark, sf):
    return tidy(feats.stratified_head(b.interim(spark, sf)))


@query("T24_head_tail_tokens", twin("""SELECT pageid, len(t) AS n_tokens, md5(array_to_string(CASE WHEN len(t) > 510 THEN
    list_concat(t[1:128], t[len(t) - 381:len(t)]) ELSE t END, ' ')) AS digest FROM (
    SELECT pageid, regexp_extract_all(clean_text, '\\S+') AS t FROM interim)""", "interim"))
def head_tail_tokens(spark, sf):
    tok = b.interim(spark, sf).select("pageid", w.tokens(F.col("clean_text")).alias("t"))
    return tidy(tok.select("pageid", F.size("t").alias("n_tokens"), F.md5(F.array_join(w.head_tail(F.col("t")), " ")).alias("digest")))


@query("T25_length_buckets", twin("""SELECT bucket, count(i.word_count) AS n FROM (VALUES ('0-512', 0, 512), ('512-4096', 512, 4096), ('4096+', 4096, 2000000000)) v(bucket, lo, hi)
    LEFT JOIN interim i ON i.word_count >= lo AND i.word_count < hi GROUP BY bucket""", "interim"))
def length_buckets(spark, sf):
    return feats.length_buckets(b.interim(spark, sf))


REAL = {"refs_per_1k_words", "cite_template_mix", "edits_per_editor", "anon_share", "bot_share", "age_days", "days_since_edit",
        "top_editor_share", "views_90d_mean", "views_90d_log"}


def _feature(number: int, name: str) -> None:
    value = f"round({name}, 6)" if name in REAL else f"CAST({name} AS BIGINT)"

    @query(f"F{number}_{name}", twin(f"SELECT pageid, {value} AS {name} FROM features", "features"))
    def run(spark, sf):
        return tidy(feats.build_features(b.interim(spark, sf), [name]), "pageid", name)


for _i, _name in enumerate(FEATURES, start=1):
    if _name != "top_editor_share":
        _feature(_i, _name)


@query("F31_top_editor_share", twin("""SELECT pageid, CAST(NULL AS DOUBLE) AS top_editor_share, round(share, 6) AS from_revisions FROM (
    SELECT *, pageid % (SELECT max(user_id) + 1 FROM events) AS own_page FROM features) LEFT JOIN (SELECT page_id, max(n) / sum(n) AS share FROM (SELECT page_id, editor, count(*) AS n FROM revisions GROUP BY ALL) GROUP BY page_id)
    ON page_id = own_page""", "features", "revisions"))
def editor_share(spark, sf):
    from gradeworks.operators.corpus import top_editor_share
    share = top_editor_share(b.revisions(spark, sf)).select("page_id", F.col("top_editor_share").alias("from_revisions"))
    df = feats.build_features(b.interim(spark, sf), ["top_editor_share"]).withColumn("page_id", b.page_of(spark, sf, "pageid"))
    return tidy(df.join(share, on="page_id", how="left"), "pageid", "top_editor_share", "from_revisions")


@query("F34_feature_registry", twin("SELECT pageid, label, CAST(grade_rank AS BIGINT) AS grade_rank, "
       + ", ".join(f"round({f}, 6) AS {f}" if f in REAL else f"CAST({f} AS BIGINT) AS {f}" for f in FEATURES) + " FROM features", "features"))
def feature_registry(spark, sf):
    return tidy(feats.build_features(b.interim(spark, sf)))


def _families() -> str:
    rows = []
    from gradeworks.schemas import HISTORY_LIKE
    for family, cols in (("metadata", FEATURES), ("metadata_noH", [f for f in FEATURES if f not in HISTORY_LIKE]), ("gH", HISTORY_LIKE)):
        total = " + ".join(f"count({c})" for c in cols)
        rows.append(f"SELECT '{family}' AS family, CAST({len(cols)} AS BIGINT) AS columns, CAST({total} AS BIGINT) AS present FROM features")
    return " UNION ALL ".join(rows)


@query("F35_family_columns", twin(_families(), "features"))
def family_columns(spark, sf):
    df = b.features(spark, sf)
    out = None
    for family in ("metadata", "metadata_noH", "gH"):
        cols = feats.family_columns(df, family)
        present = sum(F.count(c) for c in cols)
        one = df.agg(F.lit(family).alias("family"), F.lit(len(cols)).cast("long").alias("columns"), present.alias("present"))
        out = one if out is None else out.unionByName(one)
    return out


@query("F36_load_xy", twin("""SELECT pageid, CAST(grade_rank AS BIGINT) AS y, round(coalesce(age_days, 0), 6) AS age_days, CAST(edits AS DOUBLE) AS edits,
    CAST(coalesce(top_editor_share, 0) AS DOUBLE) AS top_editor_share, round(views_90d_log, 6) AS views_90d_log FROM splits WHERE split = 'train'""", "splits"))
def load_xy(spark, sf):
    return tidy(feats.load_xy(b.split_table(spark, sf), "gH", "train"), "pageid", "y", "age_days", "edits", "top_editor_share", "views_90d_log")


@query("F37_label_rank", twin("SELECT pageid, label AS grade, CAST(grade_rank AS BIGINT) AS label FROM features", "features"))
def label_rank(spark, sf):
    return tidy(feats.label_rank(b.features(spark, sf)), "pageid", "grade", "label")


@query("F38_stratified_split", twin("SELECT pageid, label, split FROM splits", "splits"))
def stratified_split(spark, sf):
    return feats.stratified_split(b.features(spark, sf).select("pageid", "label"))


@query("F39_temporal_holdout", twin("SELECT pageid, label, temporal_holdout FROM splits", "splits"))
def temporal_holdout(spark, sf):
    return feats.temporal_holdout(b.interim(spark, sf).select("pageid", "label", "created")).drop("created")


@query("F40_split_sizes", twin("SELECT split, count(*) AS n FROM splits GROUP BY split", "splits"))
def split_sizes(spark, sf):
    return feats.split_sizes(b.split_table(spark, sf))


SLICE = f"""WITH d AS (SELECT doc_id, quality, len(regexp_extract_all(text, '\\S+')) AS words,
    greatest(1, len(regexp_extract_all(text, '[.!?]+(?:\\s+[A-Z]|\\s*$)'))) AS sentences, length(substring(text, 1, 500)) AS lead
    FROM documents JOIN labels USING (doc_id)),
    s AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY substring(md5('42:' || doc_id), 1, 8), doc_id) AS rn,
        count(*) OVER (PARTITION BY quality) AS n FROM d),
    t AS (SELECT *, CASE WHEN rn <= floor(n * 0.70::DOUBLE) THEN 'train' WHEN rn <= floor(n * (0.70::DOUBLE + 0.15::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM s)
    SELECT CAST(quality AS BIGINT) AS quality, split, count(*) AS "rows", round(avg(words), 6) AS mean_words, round(avg(lead), 6) AS mean_lead,
        round(quantile_cont(CAST(sentences AS DOUBLE), 0.5), 6) AS p50_sentences FROM t GROUP BY ALL"""


@query("flagship_quality_by_split", SLICE)
def flagship(spark, sf):
    """Documents with labels: text counts, an exact stratified split, a profile per label and split.

    Texts are read once and shrink to three counts before anything is joined or shuffled.
    """
    text = F.col("text")
    docs = b.spread(b.table(spark, sf, "documents").select("doc_id", "text"))
    counted = docs.select("doc_id", w.word_count(text).alias("words"), w.sentence_count(text).alias("sentences"),
                          F.length(w.lead(text)).alias("lead"))
    labels = b.table(spark, sf, "labels").select("doc_id", "quality")
    narrow = write_table(counted.join(labels, on="doc_id"), "counts")
    parts = feats.stratified_split(narrow, "quality", "doc_id")
    means = parts.groupBy("quality", "split").agg(F.count("*").alias("rows"), F.avg("words").alias("mean_words"), F.avg("lead").alias("mean_lead"))
    return tidy(means.join(exact_quantiles(parts, ["quality", "split"], "sentences", {"p50_sentences": 0.5}), on=["quality", "split"]))
