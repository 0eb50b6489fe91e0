"""Labels, random-forest classification and consolidation of matches."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K


def dedup_labels(labels: DataFrame, keys: list[str]) -> DataFrame:
    """One label per key (conflicting labels: the positive one wins)."""
    return labels.groupBy(*keys).agg(F.max("match").cast("int").alias("match"))


def label_lookup(pairs: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of candidate pairs with the labels on the key list, adding ``match``.

    Labels are a bounded, hand-made table; they are broadcast when their size
    is within the session's broadcast limit (Spark measures the scan), else
    shuffled on the keys.
    """
    lab = dedup_labels(labels.select(*keys, "match"), keys)
    return pairs.join(lab, keys, "left")


def pair_complete(pairs: DataFrame, cols: list[str]) -> DataFrame:
    """Drop pairs with a null in any key / feature column."""
    return pairs.dropna(how="any", subset=cols)


def split_labelled(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(unlabelled, labelled) by ``match`` null / non-null."""
    return pairs.where(F.col("match").isNull()), pairs.where(F.col("match").isNotNull())


def positive_only(df: DataFrame) -> DataFrame:
    return df.where(F.col("match") == 1)


def assembler(features: list[str]) -> VectorAssembler:
    """Feature vector in the fixed training order."""
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip")


TRAINING_PARTITIONS = 8


def training_rows(labels: DataFrame, features: list[str], max_rows: int | None, seed: int) -> DataFrame:
    """Feature rows with their label, placed so that a fit is repeatable for a seed.

    Rows go to a fixed number of partitions by their hash and are sorted inside
    each, so neither the plan nor the cluster's size changes what a task sees.
    ``max_rows`` bounds the labelled sample: the rows with the smallest seeded
    hashes are taken. By default all labelled rows are used.
    """
    cols = [*features, F.col("match").cast("double").alias("label")]
    rows = labels.select(*cols).dropna()
    mark = F.xxhash64(F.lit(seed), *rows.columns)
    if max_rows is not None:
        rows = rows.orderBy(mark, *rows.columns).limit(max_rows)
    return rows.repartition(TRAINING_PARTITIONS, mark).sortWithinPartitions(*rows.columns)


def train(labels: DataFrame, features: list[str], params: dict, seed: int = 42,
          max_rows: int | None = None) -> PipelineModel:
    """Random forest on labelled feature rows.

    See :func:`training_rows` for the partitions and the optional bound.
    """
    data = training_rows(labels, features, max_rows, seed)
    data.persist()  # the forest makes several passes
    try:
        rf = RandomForestClassifier(featuresCol="features", labelCol="label", seed=seed, **params)
        return Pipeline(stages=[assembler(features), rf]).fit(data)
    finally:
        data.unpersist()


def classify(unlabelled: DataFrame, model: PipelineModel) -> DataFrame:
    """Predict ``match`` for unlabelled pairs (distributed, JVM side)."""
    out = model.transform(unlabelled)
    return out.withColumn("match", F.col("prediction").cast("int")).drop(
        "features", "rawPrediction", "probability", "prediction")


def union_matches(classified: DataFrame, labelled: DataFrame) -> DataFrame:
    """Classified rows first, then labelled rows (``_src`` keeps the order)."""
    return (classified.where(F.col("match").isNotNull()).withColumn("_src", F.lit(0))
            .unionByName(labelled.withColumn("_src", F.lit(1)), allowMissingColumns=True))


def _first_per_group(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key: the smallest by ``order`` (a list of columns compared in turn).

    Written as a ``min_by`` aggregation, which combines map-side: a hot key
    is reduced inside every task before the shuffle instead of being sorted
    as one window partition by a single task.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = F.min_by(F.struct(*[F.col(c) for c in rest]), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(picked).select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest]) \
        .select(*df.columns)


def dedup_pairs(df: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Drop duplicates on the key list keeping the first row (by ``_src`` then ``order``).

    Without ``_src`` an order is required: which row of a group comes first must not depend on the plan.
    """
    order_cols = [F.col("_src")] if "_src" in df.columns else []
    order_cols += [F.col(c) for c in (order or [])]
    if not order_cols:
        raise ValueError("dedup_pairs needs an order: rows of a key have no other ranking")
    return _first_per_group(df, keys, order_cols)


def finalise_matches(classified: DataFrame, labelled: DataFrame, keys: list[str]) -> DataFrame:
    """Union classified + labelled pairs, de-duplicate on keys, keep positives."""
    feats = [c for c in labelled.columns if c not in keys and c != "match"]
    merged = dedup_pairs(union_matches(classified, labelled), keys, feats)
    return positive_only(merged).drop("_src")


def best_match(df: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Per installed product keep the (positive) pair with the highest weighted score; ties by catalogue keys."""
    group = group or ["vendor_X", "DisplayName0", "Version0"]
    order = [-F.col("fz_uwratio"), F.col("software_X"), F.col("title_X"), F.col("release_X"), F.col("t_cve_name")]
    return _first_per_group(df, group, order)


def match_project_vendor(df: DataFrame) -> DataFrame:
    return df.select("publisher0", "vendor_X")


def match_project_software(df: DataFrame) -> DataFrame:
    return df.select("vendor_X", "DisplayName0", "Version0", "t_cve_name")


def resolve(pairs: DataFrame, labels: DataFrame, keys: list[str], features: list[str],
            model: PipelineModel, extra: list[str] | None = None) -> DataFrame:
    """label_lookup -> completeness -> classify unlabelled -> consolidate positives."""
    looked = label_lookup(pairs, labels, keys)
    complete = pair_complete(looked, keys + features + (extra or []))
    unl, lab = split_labelled(complete)
    return finalise_matches(classify(unl, model), lab, keys)


def vendor_match(cands: DataFrame, labels: DataFrame, model: PipelineModel) -> DataFrame:
    """Final (publisher0, vendor_X) matches."""
    res = resolve(cands, labels, K.VENDOR_KEYS, K.VENDOR_FEATURES, model, K.VENDOR_TOKENS)
    return match_project_vendor(res)


def software_match(cands: DataFrame, labels: DataFrame, model: PipelineModel) -> DataFrame:
    """Final (vendor_X, DisplayName0, Version0, t_cve_name) matches.

    The best positive per installed product is taken separately among the
    classified and among the labelled pairs, then both are consolidated.
    """
    keys, feats = K.SOFTWARE_KEYS, K.SOFTWARE_FEATURES
    looked = label_lookup(cands, labels, keys)
    unl, lab = split_labelled(pair_complete(looked, keys + feats + ["t_cve_name"]))
    ml_best = best_match(positive_only(classify(unl, model)))
    lab_best = best_match(positive_only(lab))
    return match_project_software(finalise_matches(ml_best, lab_best, keys))


def random_param_maps(rf, n: int, seed: int = 42) -> list:
    """``n`` random forest settings drawn like the original randomised search
    (trees 20-99, depth 3 or unlimited, which is 30 here, the most Spark grows, 1-6 features per split, 1-6 rows per
    leaf, bootstrap on/off, gini/entropy). The draws are configuration, made
    on the driver; every fit runs on the cluster."""
    import random
    rnd = random.Random(seed)
    maps = []
    for _ in range(n):
        maps.append({
            rf.numTrees: rnd.randint(20, 99),
            rf.maxDepth: rnd.choice([3, 30]),
            rf.featureSubsetStrategy: str(rnd.randint(1, 6)),
            rf.minInstancesPerNode: rnd.randint(1, 6),
            rf.bootstrap: rnd.choice([True, False]),
            rf.impurity: rnd.choice(["gini", "entropy"]),
        })
    return maps


def tune(labels: DataFrame, features: list[str], n_candidates: int = 40, folds: int = 3,
         seed: int = 42, parallelism: int = 8, max_rows: int | None = None):
    """Randomised search with k-fold cross-validation; returns the fitted CrossValidatorModel."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator
    data = training_rows(labels, features, max_rows, seed)
    rf = RandomForestClassifier(featuresCol="features", labelCol="label", seed=seed)
    pipe = Pipeline(stages=[assembler(features), rf])
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=random_param_maps(rf, n_candidates, seed),
                        evaluator=MulticlassClassificationEvaluator(metricName="accuracy"),
                        numFolds=folds, seed=seed, parallelism=parallelism)
    data.persist()
    try:
        return cv.fit(data)
    finally:
        data.unpersist()


def compare_models(labels: DataFrame, features: list[str], folds: int = 5, seed: int = 42,
                   max_rows: int | None = None) -> list[tuple[str, float]]:
    """k-fold accuracy of the classifier families Spark ML offers."""
    from pyspark.ml.classification import (LinearSVC, LogisticRegression, MultilayerPerceptronClassifier,
                                           NaiveBayes)
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
    data = training_rows(labels, features, max_rows, seed)
    models = {
        "random_forest": RandomForestClassifier(seed=seed),
        "logistic_regression": LogisticRegression(maxIter=50),
        "linear_svc": LinearSVC(maxIter=50),
        "naive_bayes": NaiveBayes(),
        "mlp": MultilayerPerceptronClassifier(layers=[len(features), 5, 2], seed=seed, maxIter=100),
    }
    ev = MulticlassClassificationEvaluator(metricName="accuracy")
    out = []
    data.persist()
    try:
        for name, est in models.items():
            cv = CrossValidator(estimator=Pipeline(stages=[assembler(features), est]),
                                estimatorParamMaps=ParamGridBuilder().build(), evaluator=ev,
                                numFolds=folds, seed=seed)
            out.append((name, float(cv.fit(data).avgMetrics[0])))
    finally:
        data.unpersist()
    return out


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
