"""Classifiers on pair features, quality metrics on hard labels, outcome buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.functions.hashing import hash_int
from edgeloom.operators import forest, order, report
from edgeloom.session import cut


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add the vector column ``features``; null features count 0."""
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(df.fillna(0, subset=list(features)))


def fit_predict(train: DataFrame, test: DataFrame, features: Sequence[str], label: str = "Class", model: str = "rf", trees: int = 13, depth: int = 20, seed: int = 42) -> DataFrame:
    """``test`` with Predicted and Probability from a forest ('rf') or boosted trees ('gbt') fitted on ``train``.

    Forests of two classes are grown by tasks that hold all rows (``forest``) up to ``forest.MAX_CELLS`` features of rows, larger ones by Spark's.
    """
    if model == "rf":
        c = F.col(label)
        n, odd = train.agg(F.count(F.lit(1)), F.count(F.when(c.isNull() | ~c.isin(0, 1), 1))).first()
        if n and not odd and n * len(features) <= forest.MAX_CELLS:
            return forest.fit_predict(train, test.fillna(0, subset=list(features)), n, features, label, trees, depth, seed)
        m = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, labelCol=label, featuresCol="features")
    elif model == "gbt":
        m = GBTClassifier(maxIter=trees, seed=seed, labelCol=label, featuresCol="features")
    else:
        raise ValueError(f"unknown model {model!r}")
    fitted = m.fit(assemble(train, features))
    if model == "rf" and fitted.hasSummary:
        # the training summary holds the session, which cannot be sent along with the model
        fitted._java_obj.setSummary(train.sparkSession._jvm.scala.Option.apply(None))
    got = fitted.transform(assemble(test, features))
    return got.select(*[F.col(c) for c in test.columns], F.col("prediction").cast("int").alias("Predicted"), vector_to_array("probability")[1].alias("Probability"))


def evaluate(df: DataFrame, group: Sequence[str] = (), label: str = "Class", predicted: str = "Predicted") -> DataFrame:
    """tp, tn, fp, fn, precision, recall, roc_auc, accuracy, f1_score, per group; one scan.

    roc_auc is that of hard labels, (TPR + TNR) / 2. Ratios without a denominator are 0. Rows without a label or
    prediction are left out.
    """
    d = df.where(F.col(label).isNotNull() & F.col(predicted).isNotNull())
    y, p = F.col(label) == 1, F.col(predicted) == 1
    n = lambda c: F.count(F.when(c, 1))
    counts = [n(y & p).alias("tp"), n(~y & ~p).alias("tn"), n(~y & p).alias("fp"), n(y & ~p).alias("fn")]
    c = d.groupBy(*group).agg(*counts) if group else d.agg(*counts)
    div = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, tn, fp, fn = (F.col(x) for x in ("tp", "tn", "fp", "fn"))
    prec, rec, spec = div(tp, tp + fp), div(tp, tp + fn), div(tn, tn + fp)
    return c.select(
        *group, "tp", "tn", "fp", "fn", F.round(prec, 4).alias("precision"), F.round(rec, 4).alias("recall"), F.round((rec + spec) / 2, 4).alias("roc_auc"),
        F.round(div(tp + tn, tp + tn + fp + fn), 4).alias("accuracy"), F.round(div(2 * tp, 2 * tp + fp + fn), 4).alias("f1_score"),
    )


def probability_auc(df: DataFrame, label: str = "Class", score: str = "Probability") -> DataFrame:
    """roc_auc_prob in one row, from counts per distinct score: no row meets another one.

    Null without both classes. Ties count half.
    """
    per = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count(F.when(F.col(label) == 1, 1)).alias("p"), F.count(F.when(F.col(label) != 1, 1)).alias("n"))
    run = order.running_total(order.global_rank(cut(per), ["s"], "rn"), "n")
    a = run.agg(F.sum(F.col("p") * (F.col("total") - F.col("n") / 2)).alias("u"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return a.select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.round(F.col("u") / (F.col("p") * F.col("n")), 6)).alias("roc_auc_prob"))


def outcome(label: str = "Class", predicted: str = "Predicted") -> F.Column:
    y, p = F.col(label) == 1, F.col(predicted) == 1
    return F.when(y & p, "TP").when(~y & ~p, "TN").when(~y & p, "FP").when(y & ~p, "FN")


def split_predictions(df: DataFrame, name: str = "Split") -> DataFrame:
    """Each row under its outcome TP, TN, FP or FN and once more under POS or NEG, by prediction. One scan."""
    d = df.withColumn("__o", outcome()).where("__o is not null")
    return d.withColumn(name, F.explode(F.array("__o", F.when(F.col("Predicted") == 1, "POS").otherwise("NEG")))).drop("__o")


def link_stats(df: DataFrame, *group: str) -> DataFrame:
    """Per bucket: mean Common, mean Hub, percentage without a common neighbour, distinct Targets. Empty buckets have no row."""
    return split_predictions(df).groupBy(*group, "Split").agg(
        F.round(F.avg("Common"), 4).alias("Common"), F.round(F.avg("Hub"), 4).alias("Hub"),
        F.round(F.lit(100.0) * F.avg((F.col("Common") == 0).cast("int")), 4).alias("pct_common_0"), F.countDistinct("Target").alias("NUnique"),
    )


def cross_validate(df: DataFrame, features: Sequence[str], label: str = "Class", folds: int = 2, seed: int = 42, **model) -> DataFrame:
    """(fold, quality...): stratified by hashing, every row tested once."""
    keyed = cut(df.withColumn("fold", F.pmod(hash_int(seed, *features, label), F.lit(folds)).cast("int")))
    parts = []
    for k in range(folds):
        got = fit_predict(keyed.where(F.col("fold") != k), keyed.where(F.col("fold") == k), features, label, seed=seed, **model)
        parts.append(evaluate(got, ["fold"], label))
    return report.union_all(parts)
