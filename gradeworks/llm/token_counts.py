"""Token totals by source, language and tokenizer, kept up to date by signed changes.

A change is a row with ``source``, ``lang``, ``tokenizer``, ``old_tokens`` and ``new_tokens``: without an old
count it inserts a document, without a new one it deletes it, with both it revises it. A change of source
or language is a deletion and an insertion. A batch of changes is folded to one signed row per key, written,
and then committed under its id by renaming a note to a file that must not exist yet. A batch that comes again
finds its id taken and changes nothing; files of attempts that never got to commit are never read. Totals are the
sum of all committed deltas.

Defined results: null sources and languages are keys of their own; a change without any count changes nothing;
repeated rows are changes of their own; a null text has no tokens; an empty batch commits no delta. Keys with a
third of all rows cost partial sums only. Other columns are never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeworks.llm.lean import lean
from gradeworks.llm.tokens import VOCABULARY, encoder

KEYS = ["source", "lang", "tokenizer"]
_DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
WORDS = "blank_separated_words"


class TokenRollup:
    """Committed deltas below ``folder``, which all executors share."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *names]))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _publish(self, batch: str, attempt: str) -> bool:
        """Rename a finished note to the batch id, which fails if the id is taken."""
        files, note = self._files(), self._path("notes", attempt)
        files.mkdirs(self._path("commits"))
        out = files.create(note)
        out.writeBytes(attempt)
        out.close()
        target = self._path("commits", batch)
        return not files.exists(target) and bool(files.rename(note, target))

    def committed(self) -> dict[str, str]:
        """The attempt that was committed for each batch id."""
        files, folder = self._files(), self._path("commits")
        if not files.exists(folder):
            return {}
        found = {}
        for status in files.listStatus(folder):
            data = files.open(status.getPath())
            found[status.getPath().getName()] = data.readAllBytes().decode()
            data.close()
        return found

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply ``changes`` as batch ``batch``; False if that batch is committed already."""
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"batch id {batch!r}: letters, digits, - and _ only")
        if batch in self.committed():
            return False
        attempt = uuid.uuid4().hex
        docs = F.col("new_tokens").isNotNull().cast("long") - F.col("old_tokens").isNotNull().cast("long")
        tokens = F.coalesce("new_tokens", F.lit(0)).cast("long") - F.coalesce("old_tokens", F.lit(0)).cast("long")
        delta = changes.groupBy(*KEYS).agg(F.sum(docs).alias("n_docs"), F.sum(tokens).alias("n_tokens"))
        delta.write.parquet(f"{self.folder}/deltas/{attempt}")
        return self._publish(batch, attempt)

    def totals(self) -> DataFrame:
        """``source``, ``lang``, ``tokenizer``, ``n_docs`` and ``n_tokens``; keys without documents are left out."""
        paths = [f"{self.folder}/deltas/{a}" for a in self.committed().values()]
        deltas = self.spark.read.schema(_DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], _DELTA)
        sums = deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.filter("n_docs <> 0 or n_tokens <> 0")


def _counted(vocabulary: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column("body").to_pylist()]
            kept = [c for c in batch.schema.names if c != "body"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array([len(encode(t)) for t in texts], pa.int64()),
                 pa.array([len(t.encode().split()) for t in texts], pa.int64())], names=[*kept, "tokens", "words"])

    return count


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang",
                 vocabulary: str = VOCABULARY) -> DataFrame:
    """``key``, ``source``, ``lang``, ``digest`` of the text, and ``tokenizer`` and ``tokens`` for the vocabulary
    and for blank-separated words."""
    kind = docs.schema[key].dataType.simpleString()
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"),
                       F.col(lang).cast("string").alias("lang"), F.unhex(F.md5(body)).alias("digest"), body.alias("body"))
    counted = rows.mapInArrow(
        lean(_counted(vocabulary)), f"key {kind}, source string, lang string, digest binary, tokens long, words long")
    pair = F.array(F.struct(F.lit(vocabulary).alias("tokenizer"), "tokens"),
                   F.struct(F.lit(WORDS).alias("tokenizer"), F.col("words").alias("tokens")))
    return counted.select("key", "source", "lang", "digest", F.inline(pair))


def inserted(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(None).cast("long").alias("old_tokens"), F.col("tokens").alias("new_tokens"))


def deleted(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.col("tokens").alias("old_tokens"), F.lit(None).cast("long").alias("new_tokens"))


def copies(counts: DataFrame) -> DataFrame:
    """The counted rows whose text a row of smaller key has too: all but the rows of the least key of each text.
    Rows meet that key by key and text, so a text with many copies is dealt evenly."""
    first = counts.groupBy("digest").agg(F.min("key").alias("first")).withColumnRenamed("digest", "first_digest")
    return counts.join(first, counts["key"].eqNullSafe(first["first"]) & (counts["digest"] == first["first_digest"]), "left_anti")
