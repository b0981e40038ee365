"""Cross-fitted scorers with Spark ML: folds by entity, boosted trees, bagged scores, isotonic calibration."""

from __future__ import annotations

import hashlib

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def fold_of(c: Column, folds: int = FOLDS) -> Column:
    """A fold by the hash of the entity: the same for all its pairs and in any engine."""
    return F.pmod(F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("int")


def fold_number(key: object, folds: int = FOLDS) -> int:
    return int(hashlib.md5(str(key).encode()).hexdigest()[:8], 16) % folds


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(df.fillna(0.0, features))


def learner(kind: str = "gbt", rounds: int = 20, depth: int = 4):
    if kind == "gbt":
        return GBTClassifier(labelCol="y", featuresCol="features", maxIter=rounds, maxDepth=depth, stepSize=0.2, seed=1)
    return LogisticRegression(labelCol="y", featuresCol="features", maxIter=50, regParam=1e-3)


def _p(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def cross_fit(df: DataFrame, features: list[str], *, fold: str = "fold", kind: str = "gbt", **options) -> tuple[DataFrame, list]:
    """(rows with ``p`` from the model that hasn't seen their fold, the models). ``df`` has y and the fold."""
    data = assembled(df, features).persist()
    numbers = [r[0] for r in data.select(fold).distinct().orderBy(fold).collect()]
    models, out = [], None
    for k in numbers:
        rest = data.where((F.col(fold) != k) & F.col("y").isNotNull())
        models.append(learner(kind, **options).fit(rest.withColumn("y", F.col("y").cast("double"))))
        part = _p(models[-1].transform(data.where(F.col(fold) == k)), "p")
        out = part if out is None else out.unionByName(part)
    return out.drop("features"), models


def bagged(df: DataFrame, features: list[str], models: list, name: str = "p") -> DataFrame:
    """The mean probability of the fold models."""
    x = assembled(df, features)
    for k, m in enumerate(models):
        x = _p(m.transform(x), f"__p{k}")
    mean = sum((F.col(f"__p{k}") for k in range(len(models))), F.lit(0.0)) / len(models)
    return x.withColumn(name, mean).drop("features", *[f"__p{k}" for k in range(len(models))])


def importances(models: list, features: list[str], top: int = 30) -> list[tuple[str, float]]:
    total = [0.0] * len(features)
    for m in models:
        values = m.featureImportances.toArray() if hasattr(m, "featureImportances") else abs(m.coefficients.toArray())
        total = [a + float(b) / len(models) for a, b in zip(total, values, strict=True)]
    return sorted(zip(features, total, strict=True), key=lambda x: (-x[1], x[0]))[:top]


def calibrator(df: DataFrame, p: str = "p"):
    """Isotonic regression on all out-of-fold scores, for records that no fold has seen."""
    data = assembled(df, [p]).withColumn("y", F.col("y").cast("double"))
    return IsotonicRegression(labelCol="y", featuresCol="features", predictionCol="__pc").fit(data)


def apply_calibrator(df: DataFrame, model, p: str = "p", name: str = "pc") -> DataFrame:
    x = model.transform(assembled(df, [p])).drop("features")
    return x.withColumn(name, F.least(F.greatest("__pc", F.lit(1e-4)), F.lit(1 - 1e-4))).drop("__pc")


def calibrated(df: DataFrame, p: str = "p", *, fold: str = "fold", name: str = "pc") -> DataFrame:
    """Isotonic calibration; each fold by a fit on the others, clamped away from 0 and 1."""
    data = assembled(df, [p]).withColumn("y", F.col("y").cast("double")).persist()
    out = None
    for k in [r[0] for r in data.select(fold).distinct().orderBy(fold).collect()]:
        m = IsotonicRegression(labelCol="y", featuresCol="features", predictionCol=name).fit(data.where(F.col(fold) != k))
        part = m.transform(data.where(F.col(fold) == k))
        out = part if out is None else out.unionByName(part)
    return out.withColumn(name, F.least(F.greatest(name, F.lit(1e-4)), F.lit(1 - 1e-4))).drop("features")


def _tree(node) -> dict:
    """A Spark ML regression tree as plain values: each node's mean, and split feature and threshold of inner ones."""
    if node.subtreeDepth() == 0:
        return {"mean": node.prediction()}
    return {"mean": node.prediction(), "feature": node.split().featureIndex(), "threshold": node.split().threshold(), "low": _tree(node.leftChild()), "high": _tree(node.rightChild())}


def dump(model) -> dict:
    """What attributions need of a model: weighted trees, or coefficients."""
    if hasattr(model, "treeWeights"):
        return {"trees": [(w, _tree(t._java_obj.rootNode())) for w, t in zip(model.treeWeights, model.trees, strict=True)]}
    return {"bias": float(model.intercept), "coefficients": model.coefficients.toArray().tolist()}


def _paths(dumped: dict, x: list[float]) -> tuple[float, list[float]]:
    """(base, share of each feature) whose sum is the model's log-odds for x.

    In a tree each step from a node to a child moves the mean; the move belongs to the feature that the node splits by.
    The odds of boosted trees are those of twice their sum.
    """
    out = [0.0] * len(x)
    if "trees" not in dumped:
        return dumped["bias"], [c * v for c, v in zip(dumped["coefficients"], x, strict=True)]
    base = 0.0
    for weight, node in dumped["trees"]:
        base += 2 * weight * node["mean"]
        while "feature" in node:
            child = node["low"] if x[node["feature"]] <= node["threshold"] else node["high"]
            out[node["feature"]] += 2 * weight * (child["mean"] - node["mean"])
            node = child
    return base, out


def attributions(models: list, features: list[str], row: dict, top: int = 8) -> dict:
    """How features move one pair's log-odds, on average over the fold models: the ``top`` largest, the rest, the base.

    For a page of a review; a table of pairs is scored with ``bagged``.
    """
    x = [float(row.get(f) or 0.0) for f in features]
    parts = [_paths(dump(m), x) for m in models]
    mean = [sum(p[1][k] for p in parts) / len(parts) for k in range(len(x))]
    order = sorted(range(len(x)), key=lambda k: (-abs(mean[k]), features[k]))
    kept = [(features[k], x[k], mean[k]) for k in order[:top]]
    return {"base": sum(p[0] for p in parts) / len(parts), "features": kept, "rest": sum(mean[k] for k in order[top:])}
