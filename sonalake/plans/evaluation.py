"""Splits, folds and evaluation of deterministic scores; models on top of pyspark.ml.

The scores of labelled documents are made from their ids, so that SQL can make
the same; doc_id % 60 stands for the speaker.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate, splits
from .registry import query, table

THRESHOLDS = [round(0.35 + 0.03 * k, 2) for k in range(11)]
P = """p AS (SELECT doc_id, doc_id % 60 AS speaker, quality AS y, ((doc_id * 7919) % 1000) / 1250.0 + 0.2 * quality AS p FROM labels),
g AS (SELECT *, CASE WHEN p >= 0.4 THEN 1 ELSE 0 END AS guess FROM p)"""
REPORT = f"""{P}, c AS (SELECT y AS truth, guess, count(*) AS n FROM g GROUP BY ALL),
r AS (SELECT k AS label, coalesce((SELECT sum(n) FROM c WHERE truth = k AND guess = k), 0) AS hits, coalesce((SELECT sum(n) FROM c WHERE truth = k), 0) AS support,
      coalesce((SELECT sum(n) FROM c WHERE guess = k), 0) AS guessed FROM (SELECT DISTINCT truth AS k FROM c UNION SELECT DISTINCT guess FROM c))"""


def predictions(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "labels").select("doc_id", (F.col("doc_id") % 60).alias("speaker"), F.col("quality").cast("int").alias("y"), ((F.col("doc_id") * 7919 % 1000) / 1250.0 + 0.2 * F.col("quality")).alias("p"))
    return p.withColumn("guess", (F.col("p") >= 0.4).cast("int"))


@query("""WITH g AS (SELECT DISTINCT user_id FROM events), r AS (SELECT user_id, row_number() OVER (ORDER BY md5(concat_ws('|', '42', user_id)), user_id) AS r, count(*) OVER () AS n FROM g)
          SELECT user_id, CASE WHEN r <= ceil(0.15 * n) THEN 'test' WHEN r <= ceil(0.15 * n) * 2 THEN 'val' ELSE 'train' END AS split FROM r""")
def group_split(spark, d):
    return splits.group_split(table(spark, d, "events"), "user_id", 0.15, 0.15, 42)


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), m AS (SELECT user_id, arg_min(event_type, (-n, event_type)) AS label FROM c GROUP BY user_id)
          SELECT user_id, label, (row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', '42', user_id)), user_id) - 1) % 5 AS fold FROM m""")
def stratified_group_fold(spark, d):
    return splits.group_folds(table(spark, d, "events"), "user_id", "event_type", 5, 42)


@query("""SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(concat_ws('|', '7', doc_id)), doc_id) <= ceil(count(*) OVER (PARTITION BY quality) * 0.2) AS held_out FROM labels""")
def stratified_holdout(spark, d):
    return splits.holdout(table(spark, d, "labels"), "doc_id", "quality", 0.2, 7).select("doc_id", "quality", "held_out")


@query("""SELECT quality, count(*) AS n, sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS weight FROM labels GROUP BY quality""")
def class_weights(spark, d):
    return splits.class_weights(table(spark, d, "labels"), "quality")


@query(f"WITH {P} SELECT y AS truth, guess, count(*) AS n FROM g GROUP BY ALL")
def confusion(spark, d):
    return evaluate.confusion(predictions(spark, d), "y", "guess")


@query(f"WITH {P}, c AS (SELECT y AS truth, guess, count(*) AS n FROM g GROUP BY ALL) SELECT truth, guess, n, round(n / greatest(sum(n) OVER (PARTITION BY truth), 1), 9) AS share FROM c")
def confusion_normalised(spark, d):
    cells = evaluate.normalised(evaluate.confusion(predictions(spark, d), "y", "guess"))
    return cells.withColumn("share", F.round("share", 9))


@query(f"""WITH {REPORT} SELECT label, round(CASE WHEN guessed = 0 THEN 0 ELSE hits / guessed END, 9)::DOUBLE AS precision, round(CASE WHEN support = 0 THEN 0 ELSE hits / support END, 9)::DOUBLE AS recall,
           round(CASE WHEN support + guessed = 0 THEN 0 ELSE 2 * hits / (support + guessed) END, 9)::DOUBLE AS f1, support::BIGINT AS support FROM r""")
def class_report(spark, d):
    out = evaluate.class_report(evaluate.confusion(predictions(spark, d), "y", "guess"))
    return out.select("label", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")), "support")


@query(f"""WITH {REPORT} SELECT round(sum(hits) / sum(support), 9) AS accuracy, round(avg(CASE WHEN support > 0 THEN hits / support END), 9) AS balanced_accuracy,
           round(avg(CASE WHEN support + guessed = 0 THEN 0 ELSE 2 * hits / (support + guessed) END), 9) AS f1_macro FROM r""")
def metrics_macro(spark, d):
    out = evaluate.macro_metrics(evaluate.confusion(predictions(spark, d), "y", "guess"))
    return out.select(*(F.round(c, 9).alias(c) for c in out.columns))


SWEEP = f"""{P}, x AS (SELECT y, p, unnest({THRESHOLDS})::DOUBLE AS threshold FROM p), k AS (SELECT threshold, count(*) FILTER (y = 1 AND p >= threshold) AS tp,
count(*) FILTER (y = 0 AND p >= threshold) AS fp, count(*) FILTER (y = 1 AND p < threshold) AS fn, count(*) FILTER (y = 0 AND p < threshold) AS tn FROM x GROUP BY threshold),
sw AS (SELECT threshold, round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy, round((coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2, 9) AS balanced_accuracy,
round((coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2, 9) AS f1_macro FROM k)"""


@query(f"WITH {SWEEP} SELECT * FROM sw")
def threshold_sweep(spark, d):
    out = evaluate.threshold_sweep(predictions(spark, d), "y", "p", THRESHOLDS)
    return out.select("threshold", *(F.round(c, 9).alias(c) for c in out.columns[1:]))


@query(f"WITH {SWEEP} SELECT threshold, f1_macro FROM sw ORDER BY f1_macro DESC, threshold LIMIT 1")
def best_threshold(spark, d):
    best = evaluate.best_threshold(evaluate.threshold_sweep(predictions(spark, d), "y", "p", THRESHOLDS), "f1_macro")
    return best.select("threshold", F.round("f1_macro", 9).alias("f1_macro"))


@query(f"""WITH {P}, a AS (SELECT speaker, guess, count(*) AS n FROM g GROUP BY ALL), b AS (SELECT speaker, y, count(*) AS n FROM g GROUP BY ALL)
SELECT speaker, (SELECT arg_min(guess, (-n, guess)) FROM a WHERE a.speaker = s.speaker) AS guess, (SELECT arg_min(y, (-n, y)) FROM b WHERE b.speaker = s.speaker)::INTEGER AS truth FROM (SELECT DISTINCT speaker FROM g) s""")
def majority_vote(spark, d):
    return evaluate.vote(predictions(spark, d), "speaker", "guess", "y")


@query(f"""WITH {P}, m AS (SELECT speaker, avg(1 - p) AS c0, avg(p) AS c1 FROM p GROUP BY speaker) SELECT speaker, round(c0, 9) AS c0, round(c1, 9) AS c1, CASE WHEN round(c1, 9) > round(c0, 9) THEN 1 ELSE 0 END::BIGINT AS guess FROM m""")
def class_prob_argmax(spark, d):
    p = predictions(spark, d).select("speaker", (1 - F.col("p")).alias("c0"), F.col("p").alias("c1"), "y")
    return evaluate.mean_probability(p, "speaker", ["c0", "c1"], "y").select("speaker", F.round("c0", 9).alias("c0"), F.round("c1", 9).alias("c1"), "guess")


@query(f"""WITH {P}, f AS (SELECT doc_id % 5 AS fold, avg((guess = y)::INTEGER) AS a FROM g GROUP BY 1) SELECT count(*) AS folds, round(avg(a), 9) AS mean, round(stddev_samp(a), 9) AS std FROM f""")
def fold_summary(spark, d):
    f = predictions(spark, d).groupBy((F.col("doc_id") % 5).alias("fold")).agg(F.avg((F.col("guess") == F.col("y")).cast("int")).alias("a"))
    return f.agg(F.count(F.lit(1)).alias("folds"), F.round(F.avg("a"), 9).alias("mean"), F.round(F.stddev_samp("a"), 9).alias("std"))


@query(f"""WITH {P}, c AS (SELECT y, count(*) AS n FROM g GROUP BY y) SELECT max(n) / sum(n) AS majority FROM c""")
def majority_baseline(spark, d):
    c = predictions(spark, d).groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    return c.agg((F.max("n") / F.sum("n")).alias("majority"))


def numeric(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings, all components of the longest, as columns ft_0 …, a binary label from the class number, and the speaker."""
    e = table(spark, d, "embeddings")
    width = e.agg(F.max(F.size("embedding"))).first()[0] or 0
    return e.select("vec_id", (F.col("vec_id") % 60).alias("speaker"), (F.col("label") < 5).cast("int").alias("y"), *(F.get("embedding", F.lit(i)).cast("double").alias(f"ft_{i}") for i in range(width)))


def narrow(spark: SparkSession, d: str) -> DataFrame:
    """The first eight components with the class as text and a token, for drivers that fit many models."""
    e = table(spark, d, "embeddings")
    return e.select("vec_id", (F.col("vec_id") % 60).alias("speaker"), (F.col("vec_id") % 3).cast("string").alias("token"), (F.col("label") < 5).cast("int").alias("y01"),
                    F.concat(F.lit("class"), F.col("label") % 3).alias("kind"), *(F.get("embedding", F.lit(i)).cast("double").alias(f"ft_{i}") for i in range(8)))


@query()
def multiclass_cv(spark, d):
    from .models import cross_validated, indexed, logistic

    rows, _ = indexed(narrow(spark, d).where("kind <> 'class0'"), "kind")
    return cross_validated(rows, "vec_id", "speaker", "class_number", "ft_", logistic())


@query()
def speaker_cv(spark, d):
    from .models import by_group, fold_metrics, logistic, out_of_fold

    guesses = out_of_fold(narrow(spark, d), "speaker", "y01", [f"ft_{i}" for i in range(8)], logistic(), tuned=THRESHOLDS)
    return fold_metrics(by_group(guesses, "speaker", 2), 3)


@query()
def token_ensemble_cv(spark, d):
    from .models import fold_metrics, logistic, token_ensemble

    return fold_metrics(token_ensemble(narrow(spark, d), "speaker", "y01", "token", "ft_", logistic(), folds=2), 2)


@query()
def ablation_cv(spark, d):
    from .models import ablation, logistic

    return ablation(narrow(spark, d), "speaker", "y01", {"all": [f"ft_{i}" for i in range(8)], "half": [f"ft_{i}" for i in range(4)]}, {"logreg": logistic()}, 2)


@query()
def per_disease_cv(spark, d):
    from .models import logistic, per_class

    return per_class(narrow(spark, d), "speaker", "kind", "class0", "ft_", logistic(), "vec_id", folds=2)


@query()
def grid_search(spark, d):
    from .models import grid_searched, logistic

    return grid_searched(narrow(spark, d), "speaker", "y01", "ft_", logistic(), {"regParam": [0.01, 0.1]}, 2)


@query()
def logreg_cv(spark, d):
    from .models import cross_validated, logistic

    return cross_validated(numeric(spark, d), "vec_id", "speaker", "y", "ft_", logistic())


@query()
def rf_cv(spark, d):
    from .models import cross_validated, forest

    return cross_validated(numeric(spark, d), "vec_id", "speaker", "y", "ft_", forest())


@query()
def pca2(spark, d):
    from .models import principal

    return principal(numeric(spark, d), "vec_id", "ft_", 2)


@query(f"""WITH {REPORT}, m AS (SELECT label, CASE WHEN guessed = 0 THEN 0 ELSE hits / guessed END AS precision, CASE WHEN support = 0 THEN 0 ELSE hits / support END AS recall, CASE WHEN support + guessed = 0 THEN 0 ELSE 2 * hits / (support + guessed) END AS f1, support FROM r)
           SELECT 'macro avg' AS label, round(avg(precision), 9) AS precision, round(avg(recall), 9) AS recall, round(avg(f1), 9) AS f1, sum(support)::BIGINT AS support FROM m
           UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 9), round(sum(recall * support) / sum(support), 9), round(sum(f1 * support) / sum(support), 9), sum(support)::BIGINT FROM m""")
def class_report_averages(spark, d):
    out = evaluate.report_averages(evaluate.class_report(evaluate.confusion(predictions(spark, d), "y", "guess")))
    return out.select("label", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")), "support")


@query()
def importances_top(spark, d):
    from .models import importances

    return importances(narrow(spark, d), "y01", "ft_", 5)


@query()
def explained_variance(spark, d):
    """component, share, cumulative share of the principal components."""
    from .models import explained

    shares, _ = explained(narrow(spark, d), "ft_", 8)
    rows = [(i + 1, s, sum(shares[: i + 1])) for i, s in enumerate(shares)]
    return spark.createDataFrame(rows, "component int, share double, cumulative double")
