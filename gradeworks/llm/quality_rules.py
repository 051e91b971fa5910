"""Line-first quality rules in DataFrame functions only.

Every line of a text is judged by itself: closing punctuation, navigation bars, boilerplate phrases,
shouting and symbol noise. Failing lines are removed, and a document that loses more than
``max_lost`` of its word characters is rejected. A few measures of the whole text come first
(``base_failed``). Everything happens inside the row: there is no shuffle and nothing that grows with
a source or a group of copies.

Defined results: a null text counts as an empty one and is rejected (too few words); rows are judged
one by one, so repeated rows and null or tied ids each keep their own row; an empty table gives an
empty table; input columns that clash with result columns give way in ``judge`` and are kept as they
are in ``clean``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30
MAX_LOST_PERCENT = 30

SYMBOLS = "#*$%&|<>"

#: Rules for one line: it must end in a closing mark or hold the end of a sentence (prose that was cut
#: off stays), and hold no boilerplate phrase, bar of separators, noise or shouting.
WORD = "[^\\x20\\x09-\\x0D]"
BLANKS = " \t\n\x0b\x0c\r"
CLOSING = list(".!?…:;,\"'”’»)]。！？")
SENTENCE = "\\p{Ll}[.!?]+[\\x20\\x09]"
SEPARATOR, MAX_SEPARATORS = "[|»›>]", 2
NOISE, MAX_NOISE = "[#*$%&]{2,}", 2
BOILERPLATE = [
    "all rights reserved", "licensed under", "released under the", "terms of use", "terms of service",
    "privacy policy", "cookie policy", "accept cookies", "enable javascript", "lorem ipsum", "sign in to",
    "log in to", "subscribe to our", "click here", "read more", "powered by", "skip to content",
    "skip to main content", "share this page", "share this article", "page not found",
]


def separated(text: Column) -> Column:
    """The words of a text: runs of characters other than blank, tab, LF, VT, FF and CR."""
    for blank in BLANKS[1:]:
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def line_fails(line: Column) -> Column:
    """Whether a line breaks a rule; a line without words never does."""
    closed = F.substring(F.rtrim(line, F.lit(BLANKS)), -1, 1).isin(CLOSING) | line.rlike(SENTENCE)

    def phrases(small: Column) -> Column:
        return reduce(Column.__or__, [F.contains(small, F.lit(x)) for x in BOILERPLATE])

    shouting = ~line.rlike("\\p{Ll}") & line.rlike("\\p{Lu}{2}")
    broken = (~closed | (F.regexp_count(line, F.lit(SEPARATOR)) > MAX_SEPARATORS) | shouting
              | (F.regexp_count(line, F.lit(NOISE)) > MAX_NOISE) | _bound(F.lower(line), phrases))
    return line.rlike(WORD) & broken


def _bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _window_hashes(hashed: Column, n: Column) -> Column:
    """One 64-bit hash for each run of WINDOW words, from the words' hashes."""
    starts = F.sequence(F.lit(0), n - WINDOW)
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(hashed, i + k) for k in range(WINDOW)]))


def _fixed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that later filters and projections read and never compute again: the
    optimizer moves nothing across a generator."""
    made = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.withColumn("made", F.explode(F.array(made))).select(*df.columns, "made.*")


def _covered(words: Column, hashes: Column) -> Column:
    """Words inside windows that occur twice or more, windows compared by 128 bits."""
    keyed = F.transform(hashes, lambda h, i: F.struct(
        h.alias("h"), F.xxhash64(F.lit(1), *[F.get(words, i + k) for k in range(WINDOW)]).alias("g"), i.alias("i")))

    def repeated(rows: Column) -> Column:
        def twin(row: Column, at: Column) -> Column:
            other = F.get(rows, at)
            return F.coalesce((row["h"] == other["h"]) & (row["g"] == other["g"]), F.lit(False))

        return F.filter(rows, lambda row, i: twin(row, i - 1) | twin(row, i + 1))

    starts = F.sort_array(F.transform(_bound(F.sort_array(keyed), repeated), lambda row: row["i"]))
    first = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        starts, first,
        lambda s, at: F.struct(at.alias("last"), (s["n"] + F.least(F.lit(WINDOW), at - s["last"])).alias("n")),
        lambda s: s["n"])


def _measured(docs: DataFrame, text: str, max_lost: int) -> DataFrame:
    """Every input row as struct ``row`` with its measures, verdict and cleaned text."""
    body = F.coalesce(F.col(f"row.`{text}`"), F.lit(""))
    df = docs.select(F.struct("*").alias("row"))
    df = df.select("row", separated(body).alias("words"), F.split(body, "\n").alias("all_lines"),
                   F.regexp_count(body, F.lit("[" + SYMBOLS + "]")).cast("long").alias("n_symbols"))
    df = df.select(
        "row", "words", "all_lines", "n_symbols", F.size("words").alias("n"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashed"),
        F.filter("all_lines", lambda x: x.rlike(WORD)).alias("lines"),
        F.filter("all_lines", lambda x: ~line_fails(x)).alias("good"))
    df = df.select(
        "row", "words", "n_symbols", "word_chars", "n", F.col("n").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        (F.size("all_lines") - F.size("good")).cast("long").alias("n_removed_lines"),
        F.array_join("good", "\n").alias("clean_text"),
        F.when(F.col("n") > WINDOW, _window_hashes(F.col("hashed"), F.col("n"))).alias("hashes"))
    repeats = F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"),
                     _covered(F.col("words"), F.col("hashes"))).otherwise(F.lit(0).cast("long"))
    left = F.char_length(F.regexp_replace("clean_text", "[\\x20\\x09-\\x0D]", "")).cast("long")
    df = _fixed(df, n_repeat_words=repeats, kept_chars=left)
    failed = (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    lost = F.col("word_chars") - F.col("kept_chars")
    return df.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (lost * 100 <= F.col("word_chars") * max_lost))


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_lines",
            "kept_chars", "base_failed", "kept"]


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text",
          max_lost: int = MAX_LOST_PERCENT) -> DataFrame:
    """Key, measures and verdict of every row."""
    return _measured(docs, text, max_lost).select(F.col(f"row.`{key}`").alias(key), *MEASURES)


def clean(docs: DataFrame, text: str = "text", chars: str = "n_chars",
          max_lost: int = MAX_LOST_PERCENT) -> DataFrame:
    """The documents that pass, with failing lines removed from ``text`` and its length in ``chars``
    (where there is such a column); all other columns stay as they are."""
    done = _measured(docs, text, max_lost).filter("kept")
    new = {text: F.col("clean_text"), chars: F.char_length("clean_text").cast("long")}
    return done.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
