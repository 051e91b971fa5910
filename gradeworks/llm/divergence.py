"""How sources of a language differ in their words, with strings left behind until the end.

Terms are runs of letters A-Z (lower-cased) and characters beyond ASCII. What is shuffled are 64-bit digests:

1. Tasks count the terms of their documents by language and source, and the documents that hold each term by
   language. Occurrence rows carry the digest alone; the string goes once per language, digest and fold into
   dictionary rows.
2. Dictionary rows give, per language and digest, the documents and the least and the greatest string. Where these
   differ, two terms share the digest. Such digests leave the main path; a second pass over the documents
   counts only their terms, told apart by the string itself.
3. Digests in at least ``min_docs`` documents are kept. Their counts meet the totals of their group and language, so
   each cell has its share p in the source and q in the language, as integers.
4. Sources are compared in pairs. f(p, q) = floor((p - q)^2 / q) summed over all kept terms splits into terms that
   one of the two has, which only depend on how often a share occurs in a source (a histogram), terms that neither
   has, and a correction for terms that both have, added up in tasks over blocks of terms.
5. The best terms of each source are cut by value and the first seven bytes of the term before strings are
   joined back to those that are left, which settles their order.

Defined results: null text, language and source count as ''; repeated rows are documents of their own; a group without
any kept term has count 0 everywhere; a language without kept terms gives pairs of value 0 and no terms; ties in
value go by the item's UTF-8 bytes; an empty table gives an empty table. Only ``lang``, ``source`` and ``text`` are
read. Shares are computed in decimals, so counts beyond 9 thousand million stay exact.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeworks.llm.lean import lean
from gradeworks.session import write_table

MIN_DOCS = 3
TOP_TERMS = 200
UNIT = 1_000_000_000  # fixed value: what all shares of a source add up to, about
FOLD_ENTRIES = 1_000_000  # terms counted in a task before they are handed on: about 150 MB
_ROWS = 50_000
_CELLS = 1 << 18  # cells compared at once
_ID = ["lang", "digest", "second"]

Batches = Iterator[pa.RecordBatch]

#: Letters lower-cased, bytes of other characters as they are, everything else a blank.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_FOLDED = "lang string, source string, digest long, n long, term string"


def terms(data: bytes) -> list[bytes]:
    return data.translate(_TERM_BYTES).split()


def _digests(words: list[bytes], bits: int) -> np.ndarray:
    found = np.fromiter(map(xxhash.xxh3_64_intdigest, words), "uint64", len(words))
    return (found >> np.uint64(64 - bits)).view("int64")


def _folded(bits: int, only: dict[str, set[int]] | None = None):
    """Occurrences by language, source and digest, and dictionary rows (no source) with documents by language.

    With ``only``, digests by language, other terms are left out and occurrence rows name their term.
    """

    def made(lang: str, source: str | None, counts: Counter, named: bool) -> Batches:
        words = list(counts)
        digests = _digests(words, bits) if words else np.empty(0, "int64")
        numbers = np.fromiter(counts.values(), "int64", len(words))
        if only is not None:
            some = np.flatnonzero(np.isin(digests, list(only.get(lang, ()))))
            digests, numbers, words = digests[some], numbers[some], [words[i] for i in some.tolist()]
        for a in range(0, len(words), _ROWS):
            n = len(words[a:a + _ROWS])
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(digests[a:a + n]), pa.array(numbers[a:a + n]),
                 pa.array(words[a:a + n], pa.binary()).cast(pa.string()) if named else pa.nulls(n, pa.string())],
                names=["lang", "source", "digest", "n", "term"])

    def read(batches: Batches) -> Batches:
        occurs, docs = defaultdict(Counter), defaultdict(Counter)

        def flushed() -> Batches:
            for (lang, source), counts in occurs.items():
                yield from made(lang, source, counts, only is not None)
            for lang, counts in docs.items():
                yield from made(lang, None, counts, True)
            occurs.clear()
            docs.clear()

        for batch in batches:
            bodies = batch.column("body").cast(pa.binary()).to_pylist()
            for lang, source, data in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), bodies, strict=True):
                found = terms(data)
                occurs[lang, source].update(found)
                docs[lang].update(set(found))
            if sum(map(len, occurs.values())) > FOLD_ENTRIES:
                yield from flushed()
        yield from flushed()

    return read


def _head(term: str) -> Column:
    """The first seven bytes of a term as a number; numbers are in the order of the bytes."""
    return F.expr(f"CAST(conv(hex(rpad(substring(CAST({term} AS BINARY), 1, 7), 7, X'00')), 16, 10) AS BIGINT)")


def vocabulary(folded: DataFrame) -> DataFrame:
    """``docs``, ``least`` and ``greatest`` string per language and digest."""
    entries = folded.filter("source is null")
    return entries.groupBy("lang", "digest").agg(F.sum("n").alias("docs"), F.min("term").alias("least"), F.max("term").alias("greatest"))


def _cells(folded: DataFrame, kept: DataFrame, names: list[str]) -> DataFrame:
    """Occurrences per source of the kept terms, which ``names`` tell apart; one exchange by these names."""
    rows = folded.filter("source is not null").repartition(*names)
    found = rows.groupBy(*names, "source").agg(F.sum("n").alias("n"))
    return found.join(kept, names).withColumn("total", F.sum("n").over(Window.partitionBy(*names)))


def count_terms(docs: DataFrame, min_docs: int = MIN_DOCS, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """The kept terms (lang, digest, second, term), and their cells (lang, digest, second, head, source, n, total).

    ``docs`` has lang, source and body. ``bits`` is the width of a digest.
    """
    folded = write_table(docs.mapInArrow(lean(_folded(bits)), _FOLDED), "divergence-folded")
    found = write_table(vocabulary(folded).filter(F.col("docs") >= min_docs), "divergence-vocabulary")
    clean = found.filter("least = greatest").select("lang", "digest", F.lit(0).cast("long").alias("second"), F.col("least").alias("term"))
    kept = [clean]
    cells = [_cells(folded, clean.select("lang", "digest", "second", _head("term").alias("head")), ["lang", "digest"])]
    # terms that share a digest: about n^2 / 2^65 of n terms, so a handful in any corpus
    shared = defaultdict(set)
    for r in found.filter("least <> greatest").select("lang", "digest").collect():
        shared[r["lang"]].add(r["digest"])
    if shared:
        apart = write_table(docs.mapInArrow(lean(_folded(bits, dict(shared))), _FOLDED), "divergence-split")
        names = ["lang", "digest", "term"]
        split = apart.filter("source is null").groupBy(*names).agg(F.sum("n").alias("docs")).filter(F.col("docs") >= min_docs)
        split = write_table(split.select(*names, F.xxhash64("term").alias("second")), "divergence-apart")
        kept.append(split.select("lang", "digest", "second", "term"))
        cells.append(_cells(apart, split.withColumn("head", _head("term")), names))
    columns = [*_ID, "head", "source", "n", "total"]
    all_kept, all_cells = kept[0], cells[0].select(*columns)
    for more, more_cells in zip(kept[1:], cells[1:], strict=True):
        all_kept, all_cells = all_kept.union(more), all_cells.union(more_cells.select(*columns))
    return all_kept, write_table(all_cells, "divergence-cells")


def _share(count: str, total: str, size: str) -> Column:
    """1 + floor(UNIT * (count + 1) / (total + size)), exact."""
    return F.expr(f"1 + (CAST({UNIT} AS DECIMAL(10, 0)) * CAST({count} + 1 AS DECIMAL(20, 0))) div CAST({total} + {size} AS DECIMAL(20, 0))")


def _distance(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def _floor_f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def _both(batches: Batches) -> Batches:
    """Corrections for terms that both sources of a pair have, from rows sorted by language and term."""

    def compared(c: dict[str, np.ndarray]) -> pa.RecordBatch:
        out = []
        for lang in np.unique(c["lang"]).tolist():
            mine = c["lang"] == lang
            names, source = np.unique(c["source"][mine], return_inverse=True)
            new = np.append(True, (np.diff(c["digest"][mine]) != 0) | (np.diff(c["second"][mine]) != 0))
            column = np.cumsum(new) - 1
            absent = np.zeros(len(names), "int64")
            absent[source] = c["p0"][mine]
            p = c["p"][mine]
            total = np.zeros((len(names), len(names)), "int64")
            step = max(1, _CELLS // len(names))
            for first in range(0, int(column[-1]) + 1, step):
                some = slice(*np.searchsorted(column, [first, first + step]))
                width = int(column[some][-1]) - first + 1
                share = np.repeat(absent[:, None], width, axis=1)
                share[source[some], column[some] - first] = p[some]
                for g in np.unique(source[some]).tolist():
                    at = column[some][source[some] == g] - first
                    other, own, none = share[:, at], share[g, at], absent[:, None]
                    total[g] += (_floor_f(own, other) - _floor_f(own, none) - _floor_f(absent[g], other)).sum(axis=1)
                    total[g] += len(at) * _floor_f(absent[g], absent)
            g, h = np.nonzero(~np.eye(len(names), dtype=bool))
            out.append((np.full(len(g), lang, object), names[g], names[h], total[g, h]))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)]
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.string()) for x in columns[:3]), pa.array(columns[3])],
                                          names=["lang", "source", "item", "value"])

    held: list[pa.RecordBatch] = []

    def whole() -> dict[str, np.ndarray]:
        joined = pa.concat_batches(held)
        return {n: joined.column(n).to_numpy(zero_copy_only=False) for n in joined.schema.names}

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) > _CELLS:
            c = whole()
            same = (c["digest"] == c["digest"][-1]) & (c["second"] == c["second"][-1]) & (c["lang"] == c["lang"][-1])
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0  # the last term may go on
            if cut:
                yield compared({n: x[:cut] for n, x in c.items()})
            held = [pa.concat_batches(held).slice(cut)]
    if held:
        yield compared(whole())


def _groups(docs: DataFrame, cells: DataFrame, kept: DataFrame) -> DataFrame:
    """Each language and source with its totals, the language's, and the share of an absent term."""
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("own"), F.count("*").alias("present"))
    per_lang = sums.groupBy("lang").agg(F.sum("own").alias("lang_n"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("size"))
    every = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left")
    every = every.join(per_lang, "lang", "left").join(sizes, "lang", "left").na.fill(0, ["own", "present", "lang_n", "size"])
    return write_table(every.withColumn("p0", F.when(F.col("size") > 0, _share("0", "own", "size"))), "divergence-groups")


def _pairs(groups: DataFrame, cells: DataFrame) -> DataFrame:
    """``value`` of each ordered pair of sources of a language."""
    a = groups.select("lang", "source", "present", "size", "p0")
    b = groups.select("lang", F.col("source").alias("item"), F.col("present").alias("item_present"), F.col("p0").alias("item_p0"))
    neither = a.join(b, "lang").filter("source <> item").select("lang", "source", "item", F.when(
        F.col("size") > 0, F.col("size") - F.col("present") - F.col("item_present")).otherwise(0).alias("n"),
        F.coalesce(_distance("p0", "item_p0"), F.lit(0)).alias("f"))
    histogram = cells.groupBy("lang", "source", "p").agg(F.count("*").alias("n"))
    one = histogram.join(b, "lang").filter("source <> item")
    has = one.select("lang", "source", "item", "n", _distance("p", "item_p0").alias("f"))
    lacks = one.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "n", _distance("item_p0", "p").alias("f"))
    singles = neither.union(has).union(lacks).groupBy("lang", "source", "item").agg(F.sum(F.col("n") * F.col("f")).alias("value"))
    wanted = ["lang", "digest", "second", "source", "p", "p0"]
    ordered = cells.select(*wanted).repartition(*_ID).sortWithinPartitions(*_ID)
    both = ordered.mapInArrow(lean(_both), "lang string, source string, item string, value long")
    return singles.union(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(table: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = MIN_DOCS,
          top: int = TOP_TERMS, bits: int = 64) -> DataFrame:
    """Per language and source the ranked distances to the other sources (part ``pair``) and the ranked terms that
    set it apart from its language (part ``term``)."""
    def named(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(""))
    docs = table.select(named(lang).alias("lang"), named(source).alias("source"), named(text).alias("body"))
    kept, cells = count_terms(docs, min_docs, bits)
    groups = _groups(docs, cells, kept)
    cells = write_table(cells.join(groups, ["lang", "source"]).select(
        *_ID, "head", "source", "p0", _share("n", "own", "size").alias("p"), _share("total", "lang_n", "size").alias("q")), "divergence-shares")

    by_group = Window.partitionBy("lang", "source")
    pairs = _pairs(groups, cells).withColumn("part", F.lit("pair"))
    best = cells.filter("p > q").select(*_ID, "source", "head", _distance("p", "q").alias("value"))
    best = best.withColumn("place", F.rank().over(by_group.orderBy(F.col("value").desc(), "head"))).filter(F.col("place") <= top)
    best = best.join(kept, _ID).select("lang", "source", F.col("term").alias("item"), "value", F.lit("term").alias("part"))
    ranked = pairs.select(*best.columns).union(best).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")))
    return ranked.filter((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")
