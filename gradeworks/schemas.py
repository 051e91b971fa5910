"""Grades, record schema and feature families."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The ordered grades, the position is the rank.
GRADES = ["Stub", "Start", "C", "B", "GA", "FA"]
K = len(GRADES)

# Feature names by family.
STRUCTURAL = ["bytes", "words", "sentences", "sections_l2", "sections_l3", "infobox", "images",
              "tables", "lists", "wikilinks", "extlinks", "categories", "templates",
              "cleanup_tags", "lead_length"]
REFERENCE = ["ref_n", "refs_per_1k_words", "refs_distinct", "cite_template_mix", "doi_n", "isbn_n"]
HISTORY = ["edits", "editors", "edits_per_editor", "anon_share", "bot_share", "reverted_n",
           "age_days", "days_since_edit", "edits_90d"]
CONTRIBUTOR = ["top_editor_share"]
PAGEVIEWS = ["views_90d_mean", "views_90d_log"]
FAMILIES = {"structural": STRUCTURAL, "reference": REFERENCE, "history": HISTORY,
            "contributor": CONTRIBUTOR, "pageviews": PAGEVIEWS}
FEATURES = list(chain.from_iterable(FAMILIES.values()))
HISTORY_LIKE = HISTORY + CONTRIBUTOR + PAGEVIEWS
NON_FEATURES = {"pageid", "label", "grade", "grade_rank", "split", "temporal_holdout", "title"}

RAW = T.StructType([
    T.StructField("pageid", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("project_classes", T.ArrayType(T.ArrayType(T.StringType()))),
    T.StructField("label", T.StringType()),
    T.StructField("n_projects", T.LongType()),
    T.StructField("n_disagree", T.LongType()),
    T.StructField("revid", T.LongType()),
    T.StructField("wikitext", T.StringType()),
    T.StructField("bytes", T.LongType()),
    T.StructField("protection", T.ArrayType(T.StringType())),
    T.StructField("categories", T.ArrayType(T.StringType())),
    T.StructField("templates", T.ArrayType(T.StringType())),
    T.StructField("pageviews_90d_mean", T.DoubleType()),
    T.StructField("edits", T.LongType()),
    T.StructField("editors", T.LongType()),
    T.StructField("anon_n", T.LongType()),
    T.StructField("bot_n", T.LongType()),
    T.StructField("reverted_n", T.LongType()),
    T.StructField("edits_90d", T.LongType()),
    T.StructField("created", T.StringType()),
    T.StructField("last_edit", T.StringType()),
    T.StructField("fetch_ts", T.StringType()),
])

CARRIED = ["pageid", "title", "label", "grade_rank", "bytes", "revid", "n_projects", "n_disagree",
           "created", "last_edit", "fetch_ts", "edits", "editors", "anon_n", "bot_n", "reverted_n",
           "edits_90d", "pageviews_90d_mean"]
PARSED = ["clean_text", "lead_text", "word_count", "sentence_count", "section_l2_n",
          "section_l3_n", "infobox", "images_n", "tables_n", "wikilinks_n", "extlinks_n",
          "lists_n", "cleanup_tags_n", "templates_n", "categories_n", "cite_templates_n",
          "refs_raw", "ref_n", "refs_distinct", "doi_n", "isbn_n"]


def grade_rank(label: Column) -> Column:
    """Rank 0..5 of a grade name; null for anything else."""
    names = F.array(*[F.lit(g) for g in GRADES])
    return F.nullif(F.array_position(names, label), F.lit(0)) - 1


def grade_name(rank: Column) -> Column:
    """Grade name of a rank 0..5; null outside."""
    names = F.array(*[F.lit(g) for g in GRADES])
    return F.when(rank.between(0, K - 1), F.get(names, rank.cast("int")))
