"""Registered queries: decision rules, metrics, explanations on tables, staleness."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeworks.functions import probability as prob
from gradeworks.operators import explain, metrics, staleness
from gradeworks.operators.profile import medians
from gradeworks.plans import bindings as b
from gradeworks.plans.registry import query
from gradeworks.plans.shape import tidy
from gradeworks.plans.twin_sql import GRADE_LIST, twin
from gradeworks.schemas import FEATURES, K

CONFIG = ["config"]


def _each(prefix: str, entry: str) -> str:
    return ", ".join(f"round({entry.format(k=k + 1)}, 6) AS {prefix}{k}" for k in range(K))


def _spread(df, col: str, prefix: str, *keep: str):
    return tidy(df.select(*keep, *[F.get(col, F.lit(k)).alias(f"{prefix}{k}") for k in range(K)]))


# decision rules

@query("P1_argmax", twin("SELECT config, pageid, CAST(pred AS BIGINT) AS pred FROM predictions", "predictions"))
def argmax(spark, sf):
    return tidy(b.predictions(spark, sf).select("config", "pageid", prob.argmax(F.col("p")).alias("pred")))


ROUNDED = "CAST(least(5, greatest(0, round_even(expected, 0))) AS BIGINT)"


@query("P2_expected_grade_round", twin(f"SELECT config, pageid, {ROUNDED} AS rounded FROM predictions", "predictions"))
def expected_grade_round(spark, sf):
    return tidy(b.predictions(spark, sf).select("config", "pageid", prob.expected_round(F.col("p")).alias("rounded")))


@query("P3_softmax", twin(f"SELECT config, pageid, {_each('p', 'p[{k}]')} FROM predictions", "predictions"))
def softmax(spark, sf):
    df = b.predictions(spark, sf).withColumn("q", prob.softmax(F.col("logits")))
    return _spread(df, "q", "p", "config", "pageid")


@query("P4_confidence", twin("SELECT config, pageid, round(list_max(p), 6) AS confidence FROM predictions", "predictions"))
def confidence(spark, sf):
    return tidy(b.predictions(spark, sf).select("config", "pageid", prob.confidence(F.col("p")).alias("confidence")))


@query("P5_expected_index", twin(f"SELECT config, pageid, round(expected, 2) AS expected_index, {GRADE_LIST}[{ROUNDED} + 1] AS expected_grade FROM predictions", "predictions"))
def expected_index(spark, sf):
    p = F.col("p")
    return b.predictions(spark, sf).select("config", "pageid", F.round(prob.expected_index(p), 2).alias("expected_index"),
                                           prob.expected_grade(p).alias("expected_grade"))


@query("P6_cumulative_to_class", f"""WITH g AS (SELECT vec_id AS pageid, list_transform(embedding[1:5], lambda v: 1 / (1 + exp(-CAST(v AS DOUBLE)))) AS g FROM embeddings),
    m AS (SELECT pageid, list_concat([CAST(1 AS DOUBLE)], list_transform([1, 2, 3, 4, 5], lambda i: list_min(g[1:i])), [CAST(0 AS DOUBLE)]) AS c FROM g),
    d AS (SELECT pageid, list_transform([1, 2, 3, 4, 5, 6], lambda i: greatest(c[i] - c[i + 1], 1e-9)) AS d FROM m)
    SELECT pageid, {_each('p', 'd[{k}] / list_sum(d)')} FROM d""")
def cumulative_to_class(spark, sf):
    gt = F.transform(F.slice("embedding", 1, K - 1), lambda v: 1 / (1 + F.exp(-v.cast("double"))))
    df = b.table(spark, sf, "embeddings").select(F.col("vec_id").alias("pageid"), gt.alias("gt"))
    return _spread(df.withColumn("p", prob.cumulative_to_class(F.col("gt"))), "p", "p", "pageid")


@query("P7_soft_target_rows", twin("""SELECT config, pageid, CAST(k AS BIGINT) AS target, round(w, 6) AS weight FROM (
    SELECT config, pageid, k, 0.7 * p[k + 1] + CASE WHEN k = y THEN CAST(1 AS DOUBLE) - 0.7 ELSE 0 END AS w FROM (SELECT *, unnest([0, 1, 2, 3, 4, 5]) AS k FROM predictions)) WHERE w > 1e-3""", "predictions"))
def soft_target_rows(spark, sf):
    return tidy(prob.soft_target_rows(b.predictions(spark, sf), "p", "y").select("config", "pageid", "target", "weight"))


# metrics

def _f1(k: int) -> str:
    sides = f"(count(*) FILTER (WHERE y = {k}) + count(*) FILTER (WHERE pred = {k}))"
    return f"CASE WHEN {sides} > 0 THEN 2.0 * count(*) FILTER (WHERE y = {k} AND pred = {k}) / {sides} ELSE 0 END"


MACRO = "((" + " + ".join(_f1(k) for k in range(K)) + ") / 6)"
ACC = "avg(CASE WHEN y = pred THEN 1 ELSE 0 END)"
WITHIN = "avg(CASE WHEN abs(y - pred) <= 1 THEN 1 ELSE 0 END)"
MAE = "avg(abs(y - pred))"


def _qwk_sql(source: str, pred: str) -> str:
    """Textbook form over the full grid of label pairs, per config."""
    return f"""(SELECT c.config AS config, 1 - sum(w * coalesce(n, 0)) / sum(w * CAST(ry AS DOUBLE) * cp / t) AS qwk FROM (
        SELECT configs.config, i, j, (i - j) * (i - j) AS w FROM (SELECT DISTINCT config FROM {source}) configs, (SELECT unnest(range(6)) AS i), (SELECT unnest(range(6)) AS j)) c
        LEFT JOIN (SELECT config, y, {pred} AS q, count(*) AS n FROM {source} GROUP BY ALL) o ON o.config = c.config AND o.y = i AND o.q = j
        JOIN (SELECT config, count(*) AS t FROM {source} GROUP BY ALL) t ON t.config = c.config
        LEFT JOIN (SELECT config, y, count(*) AS ry FROM {source} GROUP BY ALL) r ON r.config = c.config AND r.y = i
        LEFT JOIN (SELECT config, {pred} AS q, count(*) AS cp FROM {source} GROUP BY ALL) p ON p.config = c.config AND p.q = j GROUP BY c.config)"""


QWK = _qwk_sql("predictions", "pred")


def _metric(name: str, column: str, expr: str, fn) -> None:
    @query(name, twin(f"SELECT config, round({expr}, 6) AS {column} FROM predictions GROUP BY config", "predictions"))
    def run(spark, sf):
        df = b.predictions(spark, sf).groupBy("config").agg(fn(F.col("y"), F.col("pred")).alias(column))
        return tidy(df)


@query("V1_confusion", twin("""SELECT c.config, CAST(i AS BIGINT) AS y, CAST(j AS BIGINT) AS pred, count(p.pageid) AS n FROM (SELECT DISTINCT config FROM predictions) c,
    (SELECT unnest(range(6)) AS i), (SELECT unnest(range(6)) AS j) LEFT JOIN predictions p ON p.config = c.config AND p.y = i AND p.pred = j GROUP BY ALL""", "predictions"))
def confusion(spark, sf):
    return tidy(metrics.confusion(b.predictions(spark, sf), by=CONFIG))


_metric("V2_accuracy", "acc", ACC, metrics.accuracy)
_metric("V3_macro_f1", "macro_f1", MACRO, metrics.macro_f1)


@query("V4_per_class_f1", twin(" UNION ALL ".join(
    f"SELECT config, CAST({k} AS BIGINT) AS grade, round({_f1(k)}, 6) AS f1 FROM predictions GROUP BY config" for k in range(K)), "predictions"))
def per_class_f1(spark, sf):
    return tidy(metrics.per_class_f1(b.predictions(spark, sf), by=CONFIG))


_metric("V5_within_one", "within_one", WITHIN, metrics.within_one)
_metric("V6_ordinal_mae", "ordinal_mae", MAE, metrics.ordinal_mae)


@query("V7_qwk", twin(f"SELECT config, round(qwk, 6) + 0 AS qwk FROM {QWK}", "predictions"))
def qwk(spark, sf):
    df = b.predictions(spark, sf).groupBy("config").agg(metrics.qwk(F.col("y"), F.col("pred")).alias("qwk"))
    return tidy(df)


@query("V8_all_metrics", twin(f"""SELECT config, n, macro_f1, round(qwk, 6) + 0 AS qwk, within_one, acc, ordinal_mae FROM (
    SELECT config, count(*) AS n, round({MACRO}, 6) AS macro_f1, round({WITHIN}, 6) AS within_one, round({ACC}, 6) AS acc, round({MAE}, 6) AS ordinal_mae
    FROM predictions GROUP BY config) JOIN {QWK} USING (config)""", "predictions"))
def all_metrics(spark, sf):
    return tidy(metrics.all_metrics(b.predictions(spark, sf), by=CONFIG))


@query("V9_bootstrap_ci")
def bootstrap_ci(spark, sf):
    return tidy(metrics.bootstrap_ci(b.predictions(spark, sf), by=CONFIG))


ECE = """(SELECT config, sum(abs(h - c)) / (SELECT count(*) FROM predictions q WHERE q.config = bins.config) AS ece FROM (
    SELECT config, ceil(list_max(p) * 10) AS bin, sum(CASE WHEN pred = y THEN 1 ELSE 0 END) AS h, sum(list_max(p)) AS c FROM predictions GROUP BY ALL) bins WHERE bin >= 1 GROUP BY config)"""


@query("V10_ece", twin(f"SELECT config, round(ece, 6) AS ece FROM {ECE}", "predictions"))
def ece(spark, sf):
    return tidy(metrics.ece(b.predictions(spark, sf), by=CONFIG))


@query("V11_recall_per_grade", twin(f"SELECT config, CAST(y AS BIGINT) AS grade, round({ACC}, 6) AS recall FROM predictions GROUP BY config, y", "predictions"))
def recall_per_grade(spark, sf):
    return tidy(metrics.recall_per_grade(b.predictions(spark, sf), by=CONFIG))


@query("V12_reliability", twin("""SELECT c.config, CAST(b AS BIGINT) AS bin, round((b - 0.5) / 10, 2) AS confidence,
    CASE WHEN count(p.pageid) >= 3 THEN round(avg(CASE WHEN p.pred = p.y THEN 1 ELSE 0 END), 3) END AS accuracy
    FROM (SELECT DISTINCT config FROM predictions) c, (SELECT unnest(range(1, 11)) AS b) LEFT JOIN predictions p ON p.config = c.config AND ceil(list_max(p.p) * 10) = b GROUP BY ALL""", "predictions"))
def reliability(spark, sf):
    return tidy(metrics.reliability(b.predictions(spark, sf), by=CONFIG))


HOLD = f"(SELECT config, count(*) AS n_holdout, CASE WHEN count(*) > 10 THEN {MACRO} END AS temporal_holdout_f1 FROM predictions WHERE temporal_holdout GROUP BY config)"


@query("V13_temporal_holdout_f1", twin(f"SELECT config, n_holdout, round(temporal_holdout_f1, 6) AS temporal_holdout_f1 FROM {HOLD}", "predictions"))
def temporal_holdout_f1(spark, sf):
    return tidy(metrics.holdout_f1(b.predictions(spark, sf), by=CONFIG))


RESULTS = f"""(SELECT config, n, macro_f1, a.qwk AS qwk_argmax, r.qwk AS qwk_regress_round, within_one, acc, ordinal_mae, ece, temporal_holdout_f1 FROM (
    SELECT config, count(*) AS n, {MACRO} AS macro_f1, {WITHIN} AS within_one, {ACC} AS acc, {MAE} AS ordinal_mae FROM predictions GROUP BY config)
    JOIN {QWK} a USING (config) JOIN {_qwk_sql("predictions", ROUNDED)} r USING (config) JOIN {ECE} USING (config) JOIN {HOLD} USING (config))"""
_RESULT_COLS = ["macro_f1", "qwk_argmax", "qwk_regress_round", "within_one", "acc", "ordinal_mae", "ece", "temporal_holdout_f1"]


@query("V14_results_table", twin("SELECT config, n, " + ", ".join(f"round({c}, 6) + 0 AS {c}" for c in _RESULT_COLS) + f" FROM {RESULTS}", "predictions"))
def results_table(spark, sf):
    return tidy(metrics.results_table(b.predictions(spark, sf)))


@query("V14_results_interval")
def results_interval(spark, sf):
    """The result rows with the bootstrap interval of macro-F1."""
    df = b.predictions(spark, sf)
    ci = metrics.bootstrap_ci(df, by=CONFIG).filter(F.col("metric") == "macro_f1").select("config", "ci_lo", "ci_hi")
    return tidy(metrics.results_table(df).join(ci, on="config"))


@query("V15_headline", twin(f"""SELECT config, round(macro_f1, 4) AS macro_f1, round(qwk_argmax, 4) + 0 AS qwk, round(ece, 4) AS ece,
    config = (SELECT config FROM {RESULTS} ORDER BY macro_f1 DESC, config DESC LIMIT 1) AS is_best FROM {RESULTS}""", "predictions"))
def headline(spark, sf):
    return metrics.headline(metrics.results_table(b.predictions(spark, sf)))


@query("V17_holdout_vs_test", twin(f"SELECT config, round(macro_f1, 4) AS test_f1, round(temporal_holdout_f1, 4) AS temporal_f1 FROM {RESULTS} WHERE temporal_holdout_f1 IS NOT NULL", "predictions"))
def holdout_vs_test(spark, sf):
    return metrics.holdout_vs_test(metrics.results_table(b.predictions(spark, sf)))


# explanations that work on tables

@query("X2_rank_features", twin("SELECT feature, round(m, 6) AS importance FROM (SELECT feature, avg(importance) AS m FROM importance GROUP BY feature) ORDER BY m DESC, feature LIMIT 15", "importance"))
def rank_features(spark, sf):
    mean = b.importance(spark, sf).groupBy("feature").agg(F.avg("importance").alias("importance"))
    return tidy(explain.rank_features(mean))


@query("X3_stability", twin("""SELECT count(*) AS pairs, round(avg(s), 6) + 0 AS mean_spearman FROM (SELECT a.seed AS a, b.seed AS b, corr(a.r, b.r) AS s FROM (
    SELECT *, rank() OVER (PARTITION BY seed ORDER BY importance) AS r FROM importance) a JOIN (SELECT *, rank() OVER (PARTITION BY seed ORDER BY importance) AS r FROM importance) b
    ON a.feature = b.feature AND a.seed < b.seed GROUP BY a.seed, b.seed)""", "importance"))
def stability(spark, sf):
    return tidy(explain.stability(b.importance(spark, sf)))


@query("X6_curve_auc", twin("""SELECT CAST(seed AS BIGINT) AS seed, round(sum((m + prev) / 2) / count(*), 6) AS auc FROM (SELECT seed, importance AS m,
    lag(importance) OVER (PARTITION BY seed ORDER BY CAST(substring(feature, 2) AS INT)) AS prev FROM importance) GROUP BY seed""", "importance"))
def curve_auc(spark, sf):
    curve = b.importance(spark, sf).select("seed", F.expr("CAST(substring(feature, 2) AS INT)").alias("step"), F.col("importance").alias("macro_f1"))
    return tidy(explain.curve_auc(curve, ["seed"]))


@query("X8_train_medians", twin("""SELECT feature, round(quantile_cont(value, 0.5), 6) AS median FROM long JOIN splits USING (pageid)
    WHERE split = 'train' AND value IS NOT NULL GROUP BY feature""", "long", "splits"))
def train_medians(spark, sf):
    return tidy(medians(b.split_table(spark, sf).filter(F.col("split") == "train"), FEATURES))


@query("X10_plausibility_map", twin("SELECT DISTINCT feature, coalesce(criterion, 'unmapped') AS criterion FROM long LEFT JOIN (VALUES "
       + ", ".join(f"('{k}', '{v}')" for k, v in explain.CRITERIA.items()) + ") v(f, criterion) ON f = feature", "long"))
def plausibility_map(spark, sf):
    from gradeworks.operators.profile import missing_fraction
    return explain.plausibility(missing_fraction(b.features(spark, sf), FEATURES).select("feature"))


# staleness

@query("K1_staleness_score", twin("SELECT pageid, round(d, 6) AS d FROM one", "one"))
def staleness_score(spark, sf):
    return tidy(staleness.with_distance(b.predictions_one(spark, sf)).select("pageid", "d"))


def _rank(col: str, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    also = f"{by}, " if by else ""
    return f"(rank() OVER ({part} ORDER BY {col}) + (count(*) OVER (PARTITION BY {also}{col}) - 1) / 2)"


@query("K2_spearman_proxies", twin(f"""SELECT proxy, count(*) AS n, round(corr(a, c), 6) + 0 AS spearman FROM (SELECT proxy, {_rank('d', 'proxy')} AS a, {_rank('v', 'proxy')} AS c FROM (
    SELECT d, unnest(['age_days', 'days_since_edit', 'edits_90d', 'edits']) AS proxy, unnest([coalesce(age_days, 0), coalesce(days_since_edit, 0), CAST(edits_90d AS DOUBLE), CAST(edits AS DOUBLE)]) AS v FROM scored)) GROUP BY proxy""", "scored"))
def spearman_proxies(spark, sf):
    return tidy(staleness.proxy_correlations(b.scored_pages(spark, sf)))


@query("K2_spearman_proxies_p")
def spearman_proxies_p(spark, sf):
    return staleness.with_p_values(staleness.proxy_correlations(b.scored_pages(spark, sf)))


GRADED = """(SELECT s.pageid, s.d, date_part('day', TIMESTAMP '2024-01-31' - g.ts) AS age FROM (
    SELECT *, pageid % (SELECT max(user_id) + 1 FROM events) AS page_id FROM scored) s LEFT JOIN (
    SELECT page_id, min(ts) FILTER (WHERE ga AND (last_break IS NULL OR (ts, rev_id) > last_break)) AS ts FROM (
    SELECT *, max((ts, rev_id)) FILTER (WHERE NOT ga) OVER (PARTITION BY page_id) AS last_break FROM (
    SELECT user_id AS page_id, event_id AS rev_id, ts, value < 12 AS ga FROM events)) GROUP BY page_id) g ON g.page_id = s.page_id)"""


def _aged(spark, sf):
    from gradeworks.operators.corpus import grade_dates
    dates = grade_dates(b.talk_texts(spark, sf), F.lit("GA"))
    pages = b.scored_pages(spark, sf).select("pageid", "d", b.page_of(spark, sf, "pageid").alias("page_id"))
    per_page = pages.join(dates, on="page_id", how="left").select("pageid", "grade_ts")
    return staleness.grade_age(pages, per_page, b.as_of())


@query("K3_grade_age", twin(f"""SELECT n, CASE WHEN n > 30 THEN s END AS spearman FROM (SELECT count(*) AS n, round(corr(a, c), 6) + 0 AS s FROM (
    SELECT {_rank('d')} AS a, {_rank('age')} AS c FROM {GRADED} WHERE age IS NOT NULL))""", "scored"))
def grade_age(spark, sf):
    return tidy(staleness.grade_age_correlation(_aged(spark, sf)))


@query("K4_partial_spearman", twin(f"""SELECT count(*) AS n, round(corr(ra, rb), 6) + 0 AS spearman FROM (SELECT {_rank('ra')} AS ra, {_rank('rb')} AS rb FROM (
    SELECT round(a - regr_slope(a, c) OVER () * c - regr_intercept(a, c) OVER (), 6) AS ra, round(b - regr_slope(b, c) OVER () * c - regr_intercept(b, c) OVER (), 6) AS rb FROM (
    SELECT CAST(row_number() OVER (ORDER BY d, pageid) AS DOUBLE) AS a, CAST(row_number() OVER (ORDER BY coalesce(days_since_edit, 0), pageid) AS DOUBLE) AS b,
        CAST(row_number() OVER (ORDER BY coalesce(age_days, 0), pageid) AS DOUBLE) AS c FROM scored)))""", "scored"))
def partial_spearman(spark, sf):
    return tidy(staleness.partial_spearman(b.scored_pages(spark, sf)))


REVIEW = """SELECT pageid, CAST(y AS BIGINT) AS y, round(d, 3) AS d, CASE WHEN rn <= 20 THEN 'high' WHEN rn > n - 20 THEN 'low' ELSE 'mid' END AS bucket
    FROM (SELECT *, row_number() OVER (ORDER BY d DESC, pageid) AS rn, count(*) OVER () AS n FROM one)
    WHERE rn <= 20 OR rn > n - 20 OR (rn > floor(n / 2) - 10 AND rn <= floor(n / 2) + 10)"""


@query("K5_review_buckets", twin(REVIEW, "one"))
def review_buckets(spark, sf):
    scored = staleness.with_distance(b.predictions_one(spark, sf)).select("pageid", "y", "d")
    return tidy(staleness.review_buckets(scored))


@query("K6_model_preference", twin("SELECT kind FROM candidates ORDER BY CASE WHEN kind = 'ordinal_cumulative' THEN 0 WHEN kind = 'k5' THEN 1 ELSE 2 END, kind LIMIT 1", "candidates"))
def model_preference(spark, sf):
    return staleness.preferred_model(b.candidates(spark, sf), "k5")
