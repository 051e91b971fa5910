"""Article records: scans, sinks, resumable append, payload flattening."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeworks.operators.ranking import first_per_key
from gradeworks.schemas import RAW, grade_rank

CORRUPT = "_corrupt_record"
GRADE_DIR = "grade_dir"

PAGE = T.StructType([
    T.StructField("pageid", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("missing", T.StringType()),
    T.StructField("length", T.LongType()),
    T.StructField("redirect", T.StringType()),
    T.StructField("revisions", T.ArrayType(T.StructType([
        T.StructField("revid", T.LongType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("slots", T.StructType([T.StructField("main", T.MapType(T.StringType(), T.StringType()))])),
    ]))),
    T.StructField("protection", T.ArrayType(T.StructType([
        T.StructField("type", T.StringType()), T.StructField("level", T.StringType())]))),
    T.StructField("pageprops", T.MapType(T.StringType(), T.StringType())),
    T.StructField("categories", T.ArrayType(T.StructType([T.StructField("title", T.StringType())]))),
    T.StructField("templates", T.ArrayType(T.StructType([T.StructField("title", T.StringType())]))),
])
PAYLOAD = T.StructType([T.StructField("query", T.StructType([
    T.StructField("pages", T.MapType(T.StringType(), PAGE))]))])


def read_raw(spark: SparkSession, paths: str | Sequence[str], keep_corrupt: bool = False,
             grade: str | None = None) -> DataFrame:
    """Raw JSON-lines records with the declared schema. Blank lines are skipped. Lines that are no
    JSON are dropped, or kept as text in ``_corrupt_record``; a record with one field of another
    type stays, with that field null. In a store written by :func:`write_raw`, ``grade`` reads that
    grade's folder only."""
    schema = T.StructType([*RAW.fields, T.StructField(CORRUPT, T.StringType())])
    paths = [paths] if isinstance(paths, str) else list(paths)
    df = spark.read.schema(schema).option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", CORRUPT).json(paths)
    if grade is not None:
        df = df.filter(F.col(GRADE_DIR if GRADE_DIR in df.columns else "label") == grade)
    if keep_corrupt:
        return df.select(*RAW.names, CORRUPT)
    return df.filter(F.col(CORRUPT).isNull() | F.col("pageid").isNotNull()).select(*RAW.names)


def write_raw(df: DataFrame, path: str, mode: str = "append") -> None:
    """One folder per grade, so a grade's records prune by path."""
    df.withColumn(GRADE_DIR, F.col("label")).write.mode(mode).partitionBy(GRADE_DIR).json(path)


def existing_keys(records: DataFrame, grade: str | None = None) -> DataFrame:
    rows = records if grade is None else records.filter(F.col("label") == grade)
    return rows.select("pageid").distinct()


def only_new(records: DataFrame, existing: DataFrame) -> DataFrame:
    """Records whose key is not stored, one per key (the earliest fetched). Repeats are folded
    before the join, so neither side brings a hot key to it."""
    first = first_per_key(records, ["pageid"], F.struct("fetch_ts", "revid"))
    return first.join(existing.select("pageid").distinct(), on="pageid", how="left_anti")


def append_new(records: DataFrame, path: str) -> None:
    """Append the records whose key is not in the store at ``path`` yet."""
    spark = records.sparkSession
    stored = spark.read.schema(RAW).json(path).select("pageid")
    write_raw(only_new(records, stored), path, "append")


def read_columns(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A Parquet scan of the named columns only."""
    return spark.read.parquet(path).select(*columns)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", by: Sequence[str] = ()) -> None:
    df.write.mode(mode).partitionBy(*by).parquet(path)


def write_frozen(df: DataFrame, path: str, by: Sequence[str] = ("split",)) -> None:
    """Write once; a second write to the same place is an error."""
    write_parquet(df, path, "errorifexists", by)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def side_table(lines: DataFrame, value: Column, record: T.StructType) -> DataFrame:
    """Rows of a ``{page id: record}`` JSON object."""
    entries = F.explode(F.from_json(value, T.MapType(T.StringType(), record)))
    return lines.select(entries.alias("_k", "_v")).select(
        F.col("_k").try_cast("long").alias("pageid"), "_v.*")


def flatten_pages(payloads: DataFrame, body: Column) -> DataFrame:
    """Core fields of every page in query payloads; pages marked missing are skipped."""
    page = F.explode(F.map_values(F.from_json(body, PAYLOAD)["query"]["pages"]))
    rows = payloads.select(page.alias("g")).filter(F.col("g.title").isNotNull() & F.col("g.missing").isNull())
    rev = F.get("g.revisions", F.lit(0))
    main = rev["slots"]["main"]
    return rows.select(
        F.col("g.pageid").alias("pageid"), F.col("g.title").alias("title"), rev["revid"].alias("revid"),
        F.coalesce(F.try_element_at(main, F.lit("*")), F.try_element_at(main, F.lit("content")), F.lit("")).alias("wikitext"),
        F.coalesce("g.length", F.lit(0).cast("long")).alias("bytes"), rev["timestamp"].alias("last_edit"),
        F.transform(F.coalesce("g.protection", F.array().cast(PAGE["protection"].dataType)),
                    lambda p: F.concat(p["type"], F.lit(":"), p["level"])).alias("protection"),
        F.col("g.redirect").isNotNull().alias("is_redirect"),
        F.coalesce(F.map_contains_key("g.pageprops", "disambiguation"), F.lit(False)).alias("is_disambig"))


def list_props(payloads: DataFrame, body: Column) -> DataFrame:
    """Category and template titles of every page in query payloads."""
    page = F.explode(F.map_values(F.from_json(body, PAYLOAD)["query"]["pages"]))
    none = F.array().cast("array<string>")
    return payloads.select(page.alias("g")).select(
        F.col("g.pageid").alias("pageid"),
        *[F.coalesce(F.transform(F.col(f"g.{c}"), lambda x: x["title"]), none).alias(c)
          for c in ("categories", "templates")])


def with_rank(records: DataFrame) -> DataFrame:
    return records.withColumn("grade_rank", grade_rank(F.col("label")))
