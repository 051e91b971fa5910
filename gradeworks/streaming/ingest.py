"""Incremental jobs: record files as they land, and revision counts kept up to date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from gradeworks.operators.corpus import BOT_USER, REVERT_TAGS
from gradeworks.operators.ranking import first_per_key
from gradeworks.schemas import RAW

BATCH = "batch_no"


def stream_records(spark: SparkSession, path: str) -> DataFrame:
    """Article records from new files in ``path``; blank lines are skipped."""
    return spark.readStream.schema(RAW).option("recursiveFileLookup", True).json(path)


def stored_batches(spark: SparkSession, out: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """What the batches (up to ``before``) have stored in ``out``."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])).parquet(out)
    return (rows if before is None else rows.filter(F.col(BATCH) < before)).drop(BATCH)


def ingest_new(records: DataFrame, out: str, checkpoint: str, order: Column | None = None) -> StreamingQuery:
    """Store the first record per page: of a batch the least by ``order`` (fetch time and revision), and only
    if no earlier batch stored the page. The store itself is the memory, so no state grows with the keys. A
    batch that runs again replaces what it wrote."""
    first_by = F.struct("fetch_ts", "revid") if order is None else order
    schema = T.StructType(list(records.schema.fields))

    def store(batch: DataFrame, number: int) -> None:
        first = first_per_key(batch, ["pageid"], first_by)
        if number:
            seen = stored_batches(batch.sparkSession, out, schema, number).select("pageid")
            first = first.join(seen, on="pageid", how="left_anti")
        first.write.mode("overwrite").parquet(f"{out}/{BATCH}={number}")

    return (records.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def daily_counts(revisions: DataFrame) -> DataFrame:
    """Edits, anonymous, bot and reverting edits per page and day."""
    bot = ~F.col("anon") & F.col("editor").rlike(BOT_USER)
    reverting = F.arrays_overlap("tags", F.array(*[F.lit(t) for t in REVERT_TAGS]))
    return revisions.groupBy("page_id", F.to_date("ts").alias("day")).agg(
        F.count("*").alias("edits"), F.count_if(F.col("anon")).alias("anon_n"),
        F.count_if(bot).alias("bot_n"), F.count_if(reverting).alias("reverted_n"))


def store_daily(revisions: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Add each batch's counts per page and day to ``out``. Counts are partial sums, so revisions that
    come late count like all others; a batch that runs again replaces what it wrote."""
    def store(batch: DataFrame, number: int) -> None:
        daily_counts(batch).write.mode("overwrite").parquet(f"{out}/{BATCH}={number}")

    return (revisions.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def trailing_counts(daily: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    """Per page: sums over all stored partial counts and over the trailing ``days``."""
    recent = F.col("day") >= F.date_sub(as_of, days)
    return daily.groupBy("page_id").agg(
        F.sum("edits").alias("edits"), F.sum("anon_n").alias("anon_n"), F.sum("bot_n").alias("bot_n"),
        F.sum("reverted_n").alias("reverted_n"),
        F.sum(F.when(recent, F.col("edits")).otherwise(0)).alias("edits_recent"))
