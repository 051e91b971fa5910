"""Ranks, quantiles and row numbers that never put one whole group into one task.

A group of at most ``per_range`` rows is ordered by a plain window. Where a count finds a larger
one, its values are cut into ranges; each range is ordered on its own and shifted by the number of
rows in the ranges before it. A value frequent enough to fill a range has one of its own.

Counts and cut points come from eager summary jobs and enter the plan as literals, so every branch
of a plan and every recomputed task sees the same ranges. ``keys`` must name a bounded set of groups
(features, grades, proxies): the summary holds one row per group, with at most ``MAX_RANGES`` cuts for one
group and ``MAX_CUTS`` for all.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeworks.session import write_table

PER_RANGE = 1_000_000
MAX_RANGES = 4096
MAX_CUTS = 200_000
CHUNK = 64


def _cuts(df: DataFrame, keys: Sequence[str], cols: Sequence[str], per_range: int) -> DataFrame | None:
    """Per group: the distinct inner cut points of the order column, those values that fill whole
    ranges, and the cut points of the tie column if there is one. None if all groups are small.

    Only groups of more than ``per_range`` rows get cuts, together at most ``MAX_CUTS`` of them.
    A value that fills ``m`` ranges is split by the tie column into about ``m`` pieces, so a group
    has at most 2 * MAX_RANGES pieces however its values are distributed.
    """
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_rows")).collect()  # the groups are a bounded set
    large = [r for r in sizes if r["_rows"] > per_range]
    if not large:
        return None
    width = min(MAX_RANGES, max(2, MAX_CUTS // len(large)), -(-max(r["_rows"] for r in large) // per_range))
    probs = [i / width for i in range(1, width)]
    quantiles = [F.percentile_approx(c, probs, max(1000, 4 * width)).alias(c) for c in cols]
    names = T.StructType([df.schema[k] for k in keys])
    only = df.sparkSession.createDataFrame([tuple(r[k] for k in keys) for r in large], names)
    rows = []
    for r in _attach(df, only, keys).groupBy(*keys).agg(*quantiles).collect():
        cells = []
        for c in cols:
            cuts = sorted(set(r[c]))
            cells += [cuts, cuts[CHUNK - 1::CHUNK]]
        spans = Counter(r[cols[0]])
        hot = sorted(v for v, m in spans.items() if m > 1)
        rows.append((*[r[k] for k in keys], *cells, hot, [-(-width // spans[v]) for v in hot]))
    # a small group is one range
    rows += [(*[r[k] for k in keys], *([[]] * (2 * len(cols) + 2))) for r in sizes if r["_rows"] <= per_range]
    fields = [df.schema[k] for k in keys]
    for c in cols:
        kind = T.ArrayType(df.schema[c].dataType)
        fields += [T.StructField(f"_cuts_{c}", kind), T.StructField(f"_coarse_{c}", kind)]
    fields += [T.StructField("_hot", T.ArrayType(df.schema[cols[0]].dataType)),
               T.StructField("_step", T.ArrayType(T.IntegerType()))]
    return df.sparkSession.createDataFrame(rows, T.StructType(fields))


def _below(value: str) -> Column:
    """Number of cuts below the value: whole chunks first, then inside one chunk."""
    v = F.col(value)
    chunks = F.size(F.filter(F.col(f"_coarse_{value}"), lambda c: c < v))
    inside = F.slice(F.col(f"_cuts_{value}"), chunks * CHUNK + 1, F.lit(CHUNK))
    return chunks * CHUNK + F.size(F.filter(inside, lambda c: c < v))


def _attach(df: DataFrame, small: DataFrame, on: Sequence[str]) -> DataFrame:
    """Null-safe inner join with a side whose size the caller has bounded."""
    right = small.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in small.columns])
    match = F.lit(True)
    for c in on:
        match = match & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return df.join(F.broadcast(right), match, "inner").drop(*[f"_r_{c}" for c in on])


def _ranged(df: DataFrame, cuts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Add ``_range``: 2 * (cuts below), plus 1 for a value that fills ranges of its own, and
    ``_at``, the place of such a value in the list of them (0 for all others)."""
    # the cuts were made on the driver: groups x MAX_RANGES values at most
    placed = _attach(df, cuts, keys).withColumn("_at", F.array_position("_hot", F.col(value)))
    return placed.withColumn("_range", 2 * _below(value) + (F.col("_at") > 0).cast("int"))


def _keyed(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Give an ungrouped input one constant key, so both cases share a plan."""
    if keys:
        return df, list(keys)
    return df.withColumn("_all", F.lit(0)), ["_all"]


def _shift(sizes: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows before each range and in the whole group. The input has one row per range: at most
    2 * MAX_RANGES per group, so it is fit to broadcast."""
    whole = Window.partitionBy(*group)
    prior = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (sizes.withColumn("_shift", F.sum("_rows").over(prior) - F.col("_rows"))
            .withColumn("total", F.sum("_rows").over(whole)))


def cumulative_counts(df: DataFrame, keys: Sequence[str], value: str, *,
                      per_range: int = PER_RANGE) -> DataFrame:
    """Per group and distinct non-null value: ``n`` rows, ``before`` rows with a smaller value,
    ``total`` rows in the group. Equal values meet before the shuffle, so a hot value is one row."""
    base, group = _keyed(df, keys)
    present = base.filter(F.col(value).isNotNull()).select(*group, value)
    counted = present.groupBy(*group, value).agg(F.count("*").alias("n"))
    cuts = _cuts(present, group, [value], per_range)
    if cuts is None:
        inner = Window.partitionBy(*group).orderBy(value).rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        out = counted.withColumn("before", F.sum("n").over(inner) - F.col("n"))
        out = out.withColumn("total", F.sum("n").over(Window.partitionBy(*group)))
    else:
        ranged = _ranged(counted, cuts, group, value).select(*group, "_range", value, "n")
        inner = Window.partitionBy(*group, "_range").orderBy(value).rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        shift = _shift(ranged.groupBy(*group, "_range").agg(F.sum("n").alias("_rows")), group, ["_range"])
        upto = ranged.withColumn("_upto", F.sum("n").over(inner))
        out = _attach(upto, shift.drop("_rows"), [*group, "_range"]).withColumn(
            "before", F.col("_shift") + F.col("_upto") - F.col("n"))
    return out.select(*keys, value, "n", "before", "total")


def running_sums(df: DataFrame, keys: Sequence[str], value: str, columns: Sequence[str], *,
                 per_range: int = PER_RANGE) -> DataFrame:
    """Add ``upto_<c>``, the sum of each column over the rows of the group up to this value, and ``all_<c>``, that of
    the whole group. ``value`` is distinct in a group and not null."""
    whole = Window.partitionBy(*keys)
    cuts = _cuts(df, keys, [value], per_range)
    if cuts is None:
        inner = whole.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumns({f"upto_{c}": F.sum(c).over(inner) for c in columns} | {f"all_{c}": F.sum(c).over(whole) for c in columns})
    ranged = _ranged(df, cuts, keys, value).select(*df.columns, "_range")
    sizes = ranged.groupBy(*keys, "_range").agg(*[F.sum(c).alias(c) for c in columns])
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(*keys, "_range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_before_{c}") for c in columns],
                         *[F.sum(c).over(whole).alias(f"all_{c}") for c in columns])
    inner = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = ranged.withColumns({f"upto_{c}": F.sum(c).over(inner) for c in columns})
    out = _attach(upto, shift, [*keys, "_range"])
    return out.withColumns({f"upto_{c}": F.col(f"upto_{c}") + F.col(f"_before_{c}") for c in columns}).drop(
        "_range", *[f"_before_{c}" for c in columns])


def row_numbers(df: DataFrame, keys: Sequence[str], order: str, tie: str, *,
                per_range: int = PER_RANGE, number: str = "rn", total: str = "total",
                only: tuple[Column, Column] | None = None) -> DataFrame:
    """Exact 1-based row number by (``order``, ``tie``) within each group, plus the group size.

    ``order`` must not be null and ``tie`` must be unique per group; both numeric. The range of a
    frequent value is split again by ``tie``, so a group of equal values spreads out as well.
    ``only`` = (first, last) keeps the row numbers in between, as columns over ``total``; ranges
    outside are dropped before any row is shuffled.
    """
    base, group = _keyed(df, keys)
    cuts = _cuts(base, group, [order, tie], per_range)
    first, last = only or (F.lit(1), F.col(total))
    if cuts is None:
        whole = Window.partitionBy(*group)
        out = base.withColumn(number, F.row_number().over(whole.orderBy(order, tie)).cast("long"))
        out = out.withColumn(total, F.count("*").over(whole))
        return out.filter(F.col(number).between(first, last)).drop("_all")
    step = F.get("_step", (F.col("_at") - 1).cast("int"))
    minor = F.when(F.col("_at") > 0, F.floor(_below(tie) / step)).otherwise(0)
    ranged = _ranged(base, cuts, group, order).withColumn("_minor", minor).drop(
        "_at", *[c for c in cuts.columns if c not in group])
    place = [*group, "_range", "_minor"]
    shift = _shift(ranged.groupBy(*place).agg(F.count("*").alias("_rows")), group,
                   ["_range", "_minor"]).withColumnRenamed("total", total)
    wanted = shift.filter((F.col("_shift") + 1 <= last) & (F.col("_shift") + F.col("_rows") >= first))
    inner = Window.partitionBy(*place).orderBy(order, tie)
    out = (
        _attach(ranged, wanted.drop("_rows"), place)
        .withColumn(number, F.col("_shift") + F.row_number().over(inner))
        .filter(F.col(number).between(first, last))
    )
    return out.drop("_all", "_range", "_minor", "_shift")


def top_per_group(df: DataFrame, keys: Sequence[str], orders: Sequence[Column], n: int, *,
                  spread: Column, salts: int = 32, number: str = "rn") -> DataFrame:
    """First ``n`` rows of each group. A salted pass cuts every group to ``n`` rows per salt, so the
    final pass sees at most ``n * salts`` rows of any group."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    first = Window.partitionBy(*keys, "_salt").orderBy(*orders)
    last = Window.partitionBy(*keys).orderBy(*orders)
    return (
        salted.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= n)
        .drop("_rn", "_salt")
        .withColumn(number, F.row_number().over(last)).filter(F.col(number) <= n)
    )


def first_per_key(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The row of least ``order`` per key, as a partial aggregate: a hot key costs one row per task."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def average_rank() -> Column:
    """Rank with ties averaged, from :func:`cumulative_counts` columns."""
    return F.col("before") + (F.col("n") + 1) / F.lit(2.0)


def rank_columns(df: DataFrame, cols: Sequence[str], **kw) -> DataFrame:
    """Add ``_r_<col>``, the average rank over all rows, for columns without gaps.

    All columns are ranked as one long table, written once. Each rank then joins back on its value:
    one row per value on that side, and adaptive skew handling splits a hot value on the other.
    """
    wide = df.select(*df.columns)
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "column", "value")
    ranks = write_table(cumulative_counts(long, ["column"], "value", **kw).select(
        "column", "value", average_rank().alias("rank")), "ranks")
    for c in cols:
        one = ranks.filter(F.col("column") == c).select(F.col("value").alias(c), F.col("rank").alias(f"_r_{c}"))
        wide = wide.join(one, on=c, how="inner")
    return wide


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, **kw) -> DataFrame:
    """Spearman correlation of ``x`` and ``y`` per group over pairwise complete rows."""
    pairs = (
        df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(*keys, x, y).agg(F.count("*").alias("_w"))
    )
    complete = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)

    def ranks(v: str, name: str) -> DataFrame:
        return cumulative_counts(complete, keys, v, **kw).select(*keys, v, average_rank().alias(name))

    joined = pairs.join(ranks(x, "_rx"), on=[*keys, x]).join(ranks(y, "_ry"), on=[*keys, y])
    return joined.groupBy(*keys).agg(F.coalesce(F.sum("_w"), F.lit(0)).alias("n"),
                                     weighted_corr("_rx", "_ry", "_w").alias("spearman"))


def weighted_corr(x: str, y: str, w: str) -> Column:
    """Pearson correlation of weighted rows; null when a side is constant."""
    n = F.sum(w).cast("double")
    sx, sy = F.sum(F.col(w) * F.col(x)), F.sum(F.col(w) * F.col(y))
    sxx, syy = F.sum(F.col(w) * F.col(x) * F.col(x)), F.sum(F.col(w) * F.col(y) * F.col(y))
    sxy = F.sum(F.col(w) * F.col(x) * F.col(y))
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    return F.when((vx > 0) & (vy > 0), (n * sxy - sx * sy) / (F.sqrt(vx) * F.sqrt(vy)))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], *,
                    per_range: int = PER_RANGE) -> DataFrame:
    """Linear-interpolated exact quantiles per group, one column per entry of ``probs``.

    Large groups are counted per range first; only the ranges that hold a wanted position are read
    again, so the rows themselves are hardly shuffled.
    """
    base, group = _keyed(df, keys)
    present = base.filter(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias(value))
    cuts = _cuts(present, group, [value], per_range)
    if cuts is None:
        return present.groupBy(*group).agg(
            *[F.percentile(value, p).alias(name) for name, p in probs.items()]).drop("_all")
    ranged = _ranged(present, cuts, group, value).select(*group, "_range", value)
    shift = _shift(ranged.groupBy(*group, "_range").agg(F.count("*").alias("_rows")), group, ["_range"])

    def sides(p: float) -> tuple[Column, Column]:
        at = F.lit(p) * (F.col("total") - 1)
        return F.floor(at), F.ceil(at)

    ends = F.col("_shift") + F.col("_rows")
    hit = F.lit(False)
    for p in probs.values():
        lo, hi = sides(p)
        hit = hit | ((F.col("_shift") <= hi) & (lo < ends))
    wanted = shift.filter(hit).drop("_rows")
    counted = _attach(ranged, wanted, [*group, "_range"]).groupBy(
        *group, "_range", "_shift", "total", value).agg(F.count("*").alias("n"))
    inner = Window.partitionBy(*group, "_range").orderBy(value).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    cc = counted.withColumn("before", F.col("_shift") + F.sum("n").over(inner) - F.col("n"))
    picks = [F.max("total").alias("total")]
    for name, p in probs.items():
        for side, at in zip(("lo", "hi"), sides(p)):
            here = (F.col("before") <= at) & (at < F.col("before") + F.col("n"))
            picks.append(F.max(F.when(here, F.col(value))).alias(f"_{side}_{name}"))
    found = cc.groupBy(*group).agg(*picks)
    out = []
    for name, p in probs.items():
        at = F.lit(p) * (F.col("total") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return found.select(*keys, *out)
