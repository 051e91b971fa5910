"""Corpus assembly over page, revision, category, assessment and pageview tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeworks.functions.titles import class_mentions
from gradeworks.operators.ranking import first_per_key, row_numbers, top_per_group
from gradeworks.schemas import GRADES, RAW, grade_name, grade_rank
from gradeworks.session import write_table

# Bot accounts, tags of reverting edits, history cap, sampling sizes.
BOT_USER = r"(?i)bot\b"
REVERT_TAGS = ["mw-rollback", "mw-undo", "mw-manual-revert"]
HISTORY_CAP = 500
MAX_CATEGORIES = 80
PER_ROUND = 25
REQUIRED = ["pageid", "title", "label", "revid", "wikitext", "bytes"]
EXCLUDE = {"list_prefix": "List of", "min_bytes_non_stub": 100, "list_category": "Category:Lists"}


def resolve_label(pairs: DataFrame, page: str = "page_id") -> DataFrame:
    """Highest valid class per page, number of ratings and how many differ from the winner.

    One aggregate: counting per grade makes the disagreement a sum over the losing counts.
    """
    rank = grade_rank(F.trim("class"))
    best = F.max("_rank")
    n = F.count("*")
    at_best = F.lit(0).cast("long")
    rated = pairs.withColumn("_rank", rank).filter(F.col("_rank").isNotNull())
    per_grade = [F.count_if(F.col("_rank") == k).alias(f"_n{k}") for k in range(len(GRADES))]
    agg = rated.groupBy(page).agg(best.alias("_best"), n.alias("n_projects"), *per_grade)
    for k in range(len(GRADES)):
        at_best = F.when(F.col("_best") == k, F.col(f"_n{k}")).otherwise(at_best)
    return agg.select(page, grade_name(F.col("_best")).alias("label"), "n_projects",
                      (F.col("n_projects") - at_best).alias("n_disagree"))


def label_or_fallback(pages: DataFrame, resolved: DataFrame, fallback: Column,
                      page: str = "page_id") -> DataFrame:
    """Every page with its resolved label, else the fallback and no projects."""
    joined = pages.join(resolved, on=page, how="left")
    return joined.withColumns({"label": F.coalesce("label", fallback),
                               "n_projects": F.coalesce("n_projects", F.lit(0).cast("long")),
                               "n_disagree": F.coalesce("n_disagree", F.lit(0).cast("long"))})


def category_members(members: DataFrame, category: str, namespace: int = 0) -> DataFrame:
    return members.filter((F.col("category") == category) & (F.col("namespace") == namespace))


def class_categories(categories: DataFrame, grade: str) -> DataFrame:
    name = F.col("category")
    return categories.filter(name.startswith(f"{grade}-Class ") & ~name.contains("-importance"))


def category_order(categories: DataFrame, seed: int, keep: int = MAX_CATEGORIES) -> DataFrame:
    """A seeded order of the categories, the first ``keep`` of them with their position from 1."""
    shuffled = categories.select("category").distinct().withColumn(
        "_h", F.md5(F.concat(F.lit(str(seed)), F.col("category"))))
    kept = shuffled.orderBy("_h", "category").limit(keep)
    ordered = F.sort_array(F.collect_list(F.struct("_h", "category")))  # at most ``keep`` names
    return (
        kept.agg(ordered.alias("_all"))
        .select(F.posexplode("_all").alias("_pos", "_c"))
        .select(F.col("_c.category").alias("category"), (F.col("_pos") + 1).cast("long").alias("cat_order"))
    )


def round_robin(members: DataFrame, order: DataFrame, per_round: int = PER_ROUND, **kw) -> DataFrame:
    """Titles of the kept categories in round-robin order; a title keeps its first sighting.

    ``members`` holds ``category, title, member_id``; talk titles lose their prefix.
    """
    talk = members.filter(F.col("title").startswith("Talk:")).select(
        "category", "member_id", F.expr("substring(title, 6)").alias("title"))
    kept = talk.join(order, on="category", how="inner")
    numbered = row_numbers(kept, ["category"], "member_id", "member_id", **kw)
    seen = numbered.withColumn("round", F.floor((F.col("rn") - 1) / per_round))
    place = F.struct("round", "cat_order", "rn")
    first = seen.groupBy("title").agg(F.min(place).alias("_p"))
    return first.select("title", "_p.round", "_p.cat_order", "_p.rn")


def newest_revisions(revisions: DataFrame, cap: int = HISTORY_CAP) -> DataFrame:
    """The newest ``cap`` revisions of each page."""
    return top_per_group(revisions, ["page_id"], [F.col("ts").desc(), F.col("rev_id").desc()], cap,
                         spread=F.col("rev_id")).drop("rn")


def revision_counts(revisions: DataFrame, as_of: Column, recent_days: int = 90,
                    cap: int = HISTORY_CAP) -> DataFrame:
    """Edit history of a page over its newest ``cap`` revisions. An anonymous edit is never a bot's."""
    recent = F.col("ts") >= as_of - F.make_dt_interval(F.lit(recent_days))
    bot = ~F.col("anon") & F.col("editor").rlike(BOT_USER)
    reverting = F.arrays_overlap("tags", F.array(*[F.lit(t) for t in REVERT_TAGS]))
    return newest_revisions(revisions, cap).groupBy("page_id").agg(
        F.count("*").alias("edits"),
        F.count_distinct("editor").alias("editors"),
        F.count_if(F.col("anon")).alias("anon_n"),
        F.count_if(bot).alias("bot_n"),
        F.count_if(reverting).alias("reverted_n"),
        F.count_if(recent).alias("edits_90d"),
        F.min("ts").alias("created"),
    )


def top_editor_share(revisions: DataFrame) -> DataFrame:
    """Share of a page's edits made by its most active editor (pre-aggregated by editor)."""
    per_user = revisions.groupBy("page_id", "editor").agg(F.count("*").alias("n"))
    return per_user.groupBy("page_id").agg((F.max("n") / F.sum("n")).alias("top_editor_share"))


def pageviews_mean(pages: DataFrame, views: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    """Mean daily views over the ``days`` days that end yesterday, over days present; else 0."""
    last = F.date_sub(as_of, 1)
    window = F.col("day").between(F.date_sub(last, days - 1), last)
    mean = views.filter(window).groupBy("page_id").agg(F.avg("views").alias("pageviews_90d_mean"))
    return pages.join(mean, on="page_id", how="left").withColumn(
        "pageviews_90d_mean", F.coalesce("pageviews_90d_mean", F.lit(0.0)))


def exclusion_reason(title: Column, is_redirect: Column, is_disambig: Column, size: Column,
                     grade: Column, categories: Column | None = None) -> Column:
    """First matching reason to leave a page out, null to keep it. The category test comes last."""
    reason = (
        F.when(is_redirect, "redirects")
        .when(is_disambig, "disambigs")
        .when(title.startswith(EXCLUDE["list_prefix"]), "list_prefix")
        .when((grade != "Stub") & (size < EXCLUDE["min_bytes_non_stub"]), "min_bytes_non_stub")
    )
    if categories is None:
        return reason
    return reason.when(in_list_category(categories), "list_category")


def in_list_category(categories: Column) -> Column:
    return F.coalesce(F.array_contains(categories, EXCLUDE["list_category"]), F.lit(False))


def exclusion_counts(df: DataFrame) -> DataFrame:
    return df.filter(F.col("reason").isNotNull()).groupBy("reason").agg(F.count("*").alias("n"))


def fill_quota(candidates: DataFrame, existing: DataFrame, target: int, *, arrival: str,
               tie: str) -> DataFrame:
    """First candidates of each grade, by arrival, until the grade holds ``target`` rows."""
    have = existing.groupBy("label").agg(F.count("*").alias("_have"))
    first = top_per_group(candidates, ["label"], [F.col(arrival), F.col(tie)], target,
                          spread=F.col(tie))
    room = F.lit(target) - F.coalesce("_have", F.lit(0))
    return first.join(have, on="label", how="left").filter(F.col("rn") <= room).drop("_have")


def keep_matching(candidates: DataFrame, source_grade: str = "source_grade") -> DataFrame:
    return candidates.filter(F.col("label") == F.col(source_grade))


def assemble_records(assessed: DataFrame, core: DataFrame, lists: DataFrame, history: DataFrame,
                     views: DataFrame, fetch_ts: Column) -> DataFrame:
    """The 22-field article record. Pages without core data drop out."""
    joined = (
        assessed.join(core, on="pageid", how="inner")
        .join(lists, on="pageid", how="left")
        .join(history.withColumnRenamed("created", "_first"), on="pageid", how="left")
        .join(views, on="pageid", how="left")
        .withColumn("created", F.coalesce("_first", "last_edit"))
        .withColumn("fetch_ts", fetch_ts)
    )
    return joined.select(*[f.name for f in RAW.fields])


def validate_records(records: DataFrame) -> DataFrame:
    """Row count, repeated keys, rows that miss a required field, and the 1% warning."""
    missing = F.lit(False)
    for c in REQUIRED:
        missing = missing | F.col(c).isNull() | (F.col(c).cast("string") == "")
    out = records.agg(F.count("*").alias("total"),
                      (F.count("*") - F.count_distinct("pageid")).alias("dups"),
                      F.count_if(missing).alias("missing"))
    rate = F.col("missing") / F.greatest(F.col("total"), F.lit(1))
    return out.withColumn("missing_rate", F.round(rate, 4)).withColumn("warn", rate >= 0.01)


def grade_dates(talk: DataFrame, wanted: Column, salts: int = 16) -> DataFrame:
    """Per page: timestamp of the first revision in the newest unbroken run that carries the grade.

    ``talk`` holds ``page_id, rev_id, ts, text`` plus what ``wanted`` reads. Pass one finds the last
    revision without the grade; pass two takes the first one with the grade after it. The second
    pass joins on a salted key, so a page with very many revisions is spread over ``salts`` tasks.
    Null when the newest revision lacks the grade.
    """
    has = F.array_contains(class_mentions(F.col("text")), wanted).alias("has")
    flagged = write_table(talk.select("page_id", "rev_id", "ts", has), "class-flags")  # texts are read once
    at = F.struct("ts", "rev_id")
    salt = F.pmod(F.xxhash64("rev_id"), F.lit(salts))
    breaks = flagged.groupBy("page_id").agg(F.max(F.when(~F.col("has"), at)).alias("_break"))
    spread = breaks.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    joined = flagged.withColumn("_salt", salt).join(spread, on=["page_id", "_salt"], how="inner")
    after = F.col("has") & (F.col("_break").isNull() | (at > F.col("_break")))
    return joined.groupBy("page_id").agg(F.min(F.when(after, F.col("ts"))).alias("grade_ts"))


def progress(ingested: DataFrame, target: int) -> DataFrame:
    """Rows done, rate per minute since the start, and minutes left to ``target`` rows per grade."""
    minutes = F.greatest((F.max("ts").cast("double") - F.min("ts").cast("double")) / 60, F.lit(1e-6))
    out = ingested.agg(F.count("*").alias("done"), minutes.alias("_min"))
    total = target * len(GRADES)
    rate = F.col("done") / F.col("_min")
    left = F.greatest(F.lit(total) - F.col("done"), F.lit(0))
    return out.select("done", F.lit(total).cast("long").alias("total"),
                      F.round(rate, 1).alias("rate_per_min"),
                      F.when(rate > 0, F.rint(left / rate)).alias("eta_min"))


def dedupe_first(df: DataFrame, key: str, arrival: Column) -> DataFrame:
    """The earliest row per key."""
    return first_per_key(df, [key], arrival)
