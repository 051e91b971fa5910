"""Registered queries: incremental jobs, drained with an available-now trigger."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeworks.plans import bindings as b
from gradeworks.plans.assembly import scratch
from gradeworks.plans.registry import query
from gradeworks.plans.twin_sql import twin
from gradeworks.streaming import ingest


@query("S1_stream_ingest_dedupe", twin("SELECT pageid, label, CAST(bytes AS BIGINT) AS bytes FROM records", "records"))
def stream_ingest_dedupe(spark, sf):
    """Every tenth record comes a second time, fetched later and with another size."""
    source = scratch(spark, "told")
    again = F.struct("fetch_ts", "bytes")
    df = b.raw_records(spark, sf)
    both = F.array(F.struct("fetch_ts", "bytes"), F.struct(F.lit("2024-02-01T00:00:00Z").alias("fetch_ts"), (F.col("bytes") + 1).alias("bytes")))
    told = df.withColumn("_t", F.explode(F.when(F.col("pageid") % 10 == 0, both).otherwise(F.array(again))))
    told = told.withColumn("fetch_ts", F.col("_t.fetch_ts")).withColumn("bytes", F.col("_t.bytes")).drop("_t")
    told.write.json(source)
    out = scratch(spark, "stream-out")
    ingest.ingest_new(ingest.stream_records(spark, source), out, scratch(spark, "stream-state")).awaitTermination()
    return spark.read.parquet(out).select("pageid", "label", "bytes")


@query("S2_stream_revision_counts", twin(f"""SELECT page_id, count(*) AS edits, count(*) FILTER (WHERE anon) AS anon_n,
    count(*) FILTER (WHERE NOT anon AND regexp_matches(editor, '(?i)bot\\b')) AS bot_n, count(*) FILTER (WHERE reverted) AS reverted_n,
    count(*) FILTER (WHERE CAST(ts AS DATE) >= CAST(TIMESTAMP '{b.AS_OF}' AS DATE) - {b.RECENT_DAYS}) AS edits_recent
    FROM revisions GROUP BY page_id""", "revisions"))
def stream_revision_counts(spark, sf):
    """All revisions, in several batches that overlap in time."""
    source = scratch(spark, "revisions")
    b.revisions(spark, sf).repartition(4).write.parquet(source)
    schema = b.revisions(spark, sf).schema
    out = scratch(spark, "daily-out")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(source)
    ingest.store_daily(stream, out, scratch(spark, "daily-state")).awaitTermination()
    return ingest.trailing_counts(spark.read.parquet(out), b.as_of().cast("date"), b.RECENT_DAYS)
