"""Lineage table, run ids and merged result rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


MAX_BROADCAST_KEYS = 100_000


def row_text(df: DataFrame) -> Column:
    """A row as text: each value stands behind its length and a missing one is a dash, so different rows never have the
    same text."""
    values = [F.col(c).cast("string") for c in df.columns]
    return F.concat_ws(";", *[F.coalesce(F.concat(F.length(v), F.lit(":"), v), F.lit("-")) for v in values])


def _part(digest: Column, i: int, width: int) -> Column:
    return F.conv(F.substring(digest, 1 + i * width, width), 16, 10).cast("decimal(38,0)")


def content_hash(df: DataFrame) -> DataFrame:
    """``rows`` and ``sha256`` of a table whatever the order and files of its rows: four sums over the parts of each
    row's SHA-256 are hashed once more. Sums are partial aggregates, so tables and files may have any size."""
    digest = F.sha2(row_text(df), 256)
    sums = df.select(digest.alias("_d")).agg(F.count("*").alias("rows"), *[
        F.coalesce(F.sum(_part(F.col("_d"), i, _DIGITS)), F.lit(0)).cast("string").alias(f"_s{i}") for i in range(_PARTS)])
    return sums.select("rows", F.sha2(F.concat_ws(",", F.col("rows").cast("string"), *[F.col(f"_s{i}") for i in range(_PARTS)]), 256).alias("sha256"))


_PARTS, _DIGITS = 4, 15


def stored_bytes(spark: SparkSession, path: str) -> DataFrame:
    """``bytes`` of the Parquet files at ``path``, from what Spark knows of the files it reads."""
    files = spark.read.parquet(path).select("_metadata.file_path", "_metadata.file_size").distinct()
    return files.agg(F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"))


def dataset_row(spark: SparkSession, name: str, stage: str, path: str, producer: str, parent: str | None = None,
                created: Column | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """One lineage row of a Parquet dataset: shape, size, content hash, and where it comes from."""
    data = spark.read.parquet(path)
    data = data.select(*columns) if columns else data
    one = content_hash(data).withColumn("_k", F.lit(1)).join(stored_bytes(spark, path).withColumn("_k", F.lit(1)), on="_k")
    return one.select(
        F.lit(name).alias("name"), F.lit(stage).alias("stage"), F.lit(path).alias("path"), "rows",
        F.lit(len(data.columns)).cast("long").alias("cols"), "bytes", "sha256",
        (created if created is not None else F.current_timestamp()).alias("created"),
        F.lit(producer).alias("producer_target"), F.lit(parent).cast("string").alias("parent"))


def fingerprint(df: DataFrame, name: str) -> DataFrame:
    """Shape and order-free content hash of a table, from sums of row hashes."""
    part = F.conv(F.substring(F.md5(row_text(df)), 1, 12), 16, 10).cast("long")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(part.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("fingerprint")
                  ).select(F.lit(name).alias("name"), "rows",
                           F.lit(len(df.columns)).cast("long").alias("cols"), "fingerprint")


def upsert(manifest: DataFrame, rows: DataFrame) -> DataFrame:
    """Newest row per dataset name."""
    both = manifest.unionByName(rows)
    rest = [c for c in both.columns if c != "name"]
    newest = both.groupBy("name").agg(F.max_by(F.struct(*rest), "created").alias("_r"))
    return newest.select("name", "_r.*").select(*both.columns)


def latest_run(runs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """All rows of the newest run id (per key). Up to ``MAX_BROADCAST_KEYS`` keys the newest ids go to the
    rows; beyond, rows and ids meet by key and run."""
    newest = runs.groupBy(*keys).agg(F.max("run_id").alias("run_id"))
    if newest.limit(MAX_BROADCAST_KEYS + 1).count() <= MAX_BROADCAST_KEYS:
        newest = F.broadcast(newest)
    return runs.join(newest, on=[*keys, "run_id"], how="left_semi")


def merge_external(rows: DataFrame, external: DataFrame, key: str = "config") -> DataFrame:
    """Own rows plus the external rows whose key is not present."""
    extra = external.join(rows.select(key), on=key, how="left_anti")
    return rows.unionByName(extra, allowMissingColumns=True)
