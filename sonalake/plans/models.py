"""Models on pyspark.ml: preprocessing, group-disjoint cross-validation, importances, components."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import PCA, Imputer, StandardScaler, StringIndexer, UnivariateFeatureSelector, VarianceThresholdSelector, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cohort, evaluate, splits


def logistic(l1: float = 0.0) -> LogisticRegression:
    """Balanced by weights; l1 > 0 selects features as well."""
    return LogisticRegression(labelCol="y", featuresCol="features", weightCol="weight", maxIter=50, regParam=l1 or 0.01, elasticNetParam=1.0 if l1 else 0.0)


def forest(trees: int = 20, depth: int = 6) -> RandomForestClassifier:
    return RandomForestClassifier(labelCol="y", featuresCol="features", weightCol="weight", numTrees=trees, maxDepth=depth, seed=42)


def boosted(rounds: int = 20) -> GBTClassifier:
    return GBTClassifier(labelCol="y", featuresCol="features", weightCol="weight", maxIter=rounds, seed=42)


def preprocessing(columns: list[str], best: int | None = None) -> list[Estimator]:
    """Median imputation, standard scores, no constant columns, and the `best` by F-test if given; fitted on training rows only."""
    filled = [f"{c}_filled" for c in columns]
    stages = [
        Imputer(strategy="median", inputCols=columns, outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="raw"),
        VarianceThresholdSelector(featuresCol="raw", outputCol="varied"),
        StandardScaler(inputCol="varied", outputCol="scaled" if best else "features", withMean=True, withStd=True),
    ]
    if best:
        selector = UnivariateFeatureSelector(featuresCol="scaled", outputCol="features", labelCol="y", selectionMode="numTopFeatures")
        stages.append(selector.setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(best))
    return stages


def dealt(df: DataFrame, group: str, label: str, folds: int) -> DataFrame:
    """df with its group's fold, once for all folds."""
    return df.join(splits.group_folds(df, group, label, folds, 42).select(group, "fold"), group).persist()


def weighted(rows: DataFrame) -> DataFrame:
    """Training rows with weights that balance the classes; a row for each class is broadcast."""
    return rows.join(F.broadcast(splits.class_weights(rows, "y").select("y", "weight")), "y")


def out_of_fold(df: DataFrame, group: str, label: str, columns: list[str], model: Estimator, folds: int = 3, best: int | None = None, tuned: Sequence[float] = ()) -> DataFrame:
    """Rows of df with fold, y, c (class probabilities) and guess, each from a model that saw none of its group.

    tuned: thresholds of which the first best by macro F1 on the training rows
    decides between two classes, instead of the largest probability.
    """
    rows = dealt(df, group, label, folds).withColumn("y", F.col(label).cast("double"))
    done = []
    for k in range(folds):
        train = weighted(rows.where(F.col("fold") != k))
        fitted = Pipeline(stages=[*preprocessing(columns, best), model]).fit(train)

        def scored(part: DataFrame, fitted: PipelineModel = fitted) -> DataFrame:
            return fitted.transform(part).withColumn("c", vector_to_array("probability"))

        guess = F.col("prediction")
        if tuned:
            sweep = evaluate.threshold_sweep(scored(train).withColumn("p", F.col("c")[1]), "y", "p", list(tuned))
            cut = evaluate.best_threshold(sweep, "f1_macro").first()["threshold"]  # one row
            guess = (F.col("c")[1] >= cut).cast("double")
        test = scored(rows.where(F.col("fold") == k).withColumn("weight", F.lit(1.0)))
        done.append(test.select(*(c for c in df.columns if c not in ("fold", "y", "c", "guess")), "fold", "y", "c", guess.alias("guess")))
    return reduce(DataFrame.unionByName, done)


def fold_metrics(guesses: DataFrame, folds: int) -> DataFrame:
    """fold, accuracy, balanced_accuracy, f1_macro of rows with fold, y, guess."""
    done = []
    for k in range(folds):
        scores = evaluate.macro_metrics(evaluate.confusion(guesses.where(F.col("fold") == k), "y", "guess"))
        done.append(scores.select(F.lit(k).alias("fold"), *(F.round(c, 6).alias(c) for c in scores.columns)))
    return reduce(DataFrame.unionByName, done)


def cross_validated(df: DataFrame, key: str, group: str, label: str, prefix: str, model: Estimator, folds: int = 3, best: int | None = None, tuned: Sequence[float] = ()) -> DataFrame:
    """fold, accuracy, balanced_accuracy, f1_macro of folds that share no group; all fitting sees the training folds only."""
    return fold_metrics(out_of_fold(df, group, label, cohort.feature_columns(df, [prefix]), model, folds, best, tuned), folds)


def indexed(df: DataFrame, label: str, name: str = "class_number") -> tuple[DataFrame, list[str]]:
    """df with its classes numbered in alphabetical order, and their names; rows without a class go."""
    fitted = StringIndexer(inputCol=label, outputCol=name, stringOrderType="alphabetAsc", handleInvalid="skip").fit(df)
    return fitted.transform(df), list(fitted.labels)


def by_group(guesses: DataFrame, group: str, classes: int) -> DataFrame:
    """group, guess, y, fold: the class of the largest mean probability of each group's rows, against its most frequent truth."""
    wide = guesses.select(group, "y", "fold", *(F.col("c")[i].alias(f"c{i}") for i in range(classes)))
    means = evaluate.mean_probability(wide, group, [f"c{i}" for i in range(classes)], "y")
    return means.join(wide.groupBy(group).agg(F.min("fold").alias("fold")), group).select(group, F.col("guess").cast("double").alias("guess"), F.col("truth").alias("y"), "fold")


def token_ensemble(df: DataFrame, group: str, label: str, token: str, prefix: str, model: Estimator, least: int = 40, folds: int = 3) -> DataFrame:
    """group, guess, y, fold: a model for each token with enough rows of two classes, one of all rows for the others, averaged over a group's rows."""
    columns = cohort.feature_columns(df, [prefix])
    rows = dealt(df, group, label, folds).withColumn("y", F.col(label).cast("double"))
    parts = []
    for k in range(folds):
        train, test = rows.where(F.col("fold") != k), rows.where(F.col("fold") == k).withColumn("weight", F.lit(1.0))
        fit = lambda part: Pipeline(stages=[*preprocessing(columns), model]).fit(weighted(part))
        sizes = train.groupBy(token).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("y").alias("classes"))
        own = [r[token] for r in sizes.where((F.col("n") >= least) & (F.col("classes") > 1)).orderBy(token).collect()]  # a row for each token
        rest = test.where(~F.coalesce(F.col(token).isin(own), F.lit(False))) if own else test
        done = [fit(train).transform(rest)] + [fit(train.where(F.col(token) == t)).transform(test.where(F.col(token) == t)) for t in own]
        parts += [d.select(group, "y", "fold", vector_to_array("probability").alias("c")) for d in done]
    return by_group(reduce(DataFrame.unionByName, parts), group, 2)


def report(guesses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Class report and normalised confusion of out-of-fold guesses."""
    cells = evaluate.confusion(guesses, "y", "guess")
    return evaluate.class_report(cells), evaluate.normalised(cells)


def ablation(df: DataFrame, group: str, label: str, configs: Mapping[str, list[str]], models: Mapping[str, Estimator], folds: int = 3) -> DataFrame:
    """config, model, accuracy, balanced_accuracy, f1_macro over all out-of-fold rows of each pair."""
    done = []
    for config, columns in configs.items():
        for name, model in models.items():
            scores = evaluate.macro_metrics(evaluate.confusion(out_of_fold(df, group, label, columns, model, folds), "y", "guess"))
            done.append(scores.select(F.lit(config).alias("config"), F.lit(name).alias("model"), *(F.round(c, 6).alias(c) for c in scores.columns)))
    return reduce(DataFrame.unionByName, done)


def per_class(df: DataFrame, group: str, class_column: str, healthy: str, prefix: str, model: Estimator, key: str, least: int = 10, folds: int = 3) -> DataFrame:
    """disease, n, status and scores of each class against as many healthy rows; a class that can't be fitted says why, the others go on."""
    columns, parts = cohort.feature_columns(df, [prefix]), []
    schema = "disease string, n long, status string, accuracy double, balanced_accuracy double, f1_macro double"
    for r in df.where(F.col(class_column) != healthy).groupBy(class_column).agg(F.count(F.lit(1)).alias("n")).orderBy(class_column).collect():  # a row for each class
        disease, n = r[class_column], r["n"]
        if n < least:
            parts.append((disease, n, "too_few", None, None, None))
            continue
        two = df.where(F.col(class_column).isin(healthy, disease))
        two = cohort.balanced(two, F.col(class_column) == healthy, key, 42).withColumn("is_ill", (F.col(class_column) == disease).cast("int"))
        try:
            s = evaluate.macro_metrics(evaluate.confusion(out_of_fold(two, group, "is_ill", columns, model, folds), "y", "guess")).first()
            parts.append((disease, n, "ok", s["accuracy"], s["balanced_accuracy"], s["f1_macro"]))
        except Exception as e:  # one class must not end the others
            parts.append((disease, n, f"failed: {type(e).__name__}", None, None, None))
    return df.sparkSession.createDataFrame(parts, schema)


class MacroF1(Evaluator):
    """Macro F1 for grid searches."""

    def _evaluate(self, dataset: DataFrame) -> float:
        return float(evaluate.macro_metrics(evaluate.confusion(dataset, "y", "prediction")).first()["f1_macro"] or 0.0)

    def isLargerBetter(self) -> bool:
        return True


def grid_searched(df: DataFrame, group: str, label: str, prefix: str, model: Estimator, grid: Mapping[str, list], folds: int = 3) -> DataFrame:
    """A row for each point of the grid: params, f1_macro, best; folds share no group."""
    rows = weighted(dealt(df, group, label, folds).withColumn("y", F.col(label).cast("double"))).withColumn("fold", F.col("fold").cast("int"))
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(model.getParam(name), values)
    points = builder.build()
    search = CrossValidator(estimator=Pipeline(stages=[*preprocessing(cohort.feature_columns(df, [prefix])), model]), estimatorParamMaps=points, evaluator=MacroF1(), numFolds=folds, foldCol="fold")
    scores = search.fit(rows).avgMetrics
    named = [",".join(f"{p.name}={v}" for p, v in sorted(point.items(), key=lambda x: x[0].name)) for point in points]
    top = max(range(len(scores)), key=lambda i: (scores[i], -i))
    return df.sparkSession.createDataFrame([(n, round(float(s), 6), i == top) for i, (n, s) in enumerate(zip(named, scores, strict=True))], "params string, f1_macro double, best boolean")


def feature_names(model: PipelineModel, df: DataFrame, column: str = "features") -> list[str]:
    """Names of a vector column's places, from its metadata; their numbers where it has none."""
    field = model.transform(df.limit(1)).schema[column]
    found = [a for kind in field.metadata.get("ml_attr", {}).get("attrs", {}).values() for a in kind]
    return [a.get("name", str(a["idx"])) for a in sorted(found, key=lambda a: a["idx"])]


def _weights(df: DataFrame, label: str, columns: list[str], model: Estimator) -> dict[str, float]:
    rows = df.withColumn("y", F.col(label).cast("double")).withColumn("weight", F.lit(1.0))
    filled = [f"{c}_filled" for c in columns]
    stages = [Imputer(strategy="median", inputCols=columns, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), model]
    fitted = Pipeline(stages=stages).fit(rows).stages[-1]
    found = fitted.featureImportances if hasattr(fitted, "featureImportances") else fitted.coefficients
    return dict(zip(columns, map(abs, map(float, found.toArray())), strict=True))


def forest_selected(df: DataFrame, label: str, columns: list[str]) -> list[str]:
    """Columns of at least the mean importance in a forest."""
    weights = _weights(df, label, columns, forest())
    return [c for c in columns if weights[c] >= sum(weights.values()) / len(columns)]


def l1_selected(df: DataFrame, label: str, columns: list[str], penalty: float = 0.05) -> list[str]:
    """Columns that a logistic model with an L1 penalty keeps."""
    weights = _weights(df, label, columns, logistic(penalty))
    return [c for c in columns if weights[c] > 1e-9]


def eliminated(df: DataFrame, label: str, columns: list[str], keep: int, step: int = 10) -> list[str]:
    """Columns left when a forest's least important ones go, `step` at a time."""
    left = list(columns)
    while len(left) > keep:
        weights = _weights(df, label, left, forest())
        gone = sorted(left, key=lambda c: (weights[c], c))[: min(step, len(left) - keep)]
        left = [c for c in left if c not in gone]
    return left


def importances(df: DataFrame, label: str, prefix: str, top: int = 20) -> DataFrame:
    """feature, importance of a forest on all rows, the largest first."""
    columns = cohort.feature_columns(df, [prefix])
    rows = df.withColumn("y", F.col(label).cast("double")).withColumn("weight", F.lit(1.0))
    filled = [f"{c}_filled" for c in columns]
    stages = [Imputer(strategy="median", inputCols=columns, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="features"), forest()]
    weights = Pipeline(stages=stages).fit(rows).stages[-1].featureImportances.toArray()
    return df.sparkSession.createDataFrame(sorted(zip(columns, map(float, weights), strict=True), key=lambda p: (-p[1], p[0]))[:top], "feature string, importance double")


def principal(df: DataFrame, key: str, prefix: str, k: int) -> DataFrame:
    """key and the first k components, signs fixed so that each loading of largest magnitude is positive."""
    columns = cohort.feature_columns(df, [prefix])
    stages = [VectorAssembler(inputCols=columns, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True), PCA(k=k, inputCol="scaled", outputCol="pc")]
    fitted = Pipeline(stages=stages).fit(df)
    loadings = fitted.stages[-1].pc.toArray()
    signs = [1.0 if c[abs(c).argmax()] > 0 else -1.0 for c in loadings.T]
    pc = vector_to_array("pc")
    return fitted.transform(df).select(key, *(F.round(pc[i] * signs[i], 5).alias(f"pc{i + 1}") for i in range(k)))


def explained(df: DataFrame, prefix: str, k: int, share: float = 0.9) -> tuple[list[float], int]:
    """Explained shares of k components, and how many reach the share."""
    columns = cohort.feature_columns(df, [prefix])
    stages = [VectorAssembler(inputCols=columns, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True), PCA(k=k, inputCol="scaled", outputCol="pc")]
    shares = [float(v) for v in Pipeline(stages=stages).fit(df).stages[-1].explainedVariance]
    total, count = 0.0, len(shares)
    for i, v in enumerate(shares):
        total += v
        if total >= share:
            count = i + 1
            break
    return shares, count
