"""Model fitting on feature tables with Spark ML (distributed fits).

The reference calls an external ML program that is not in its tree; the
feature tables are what its SQL defines. Models here are standard
``pyspark.ml`` estimators; results are rows-only checked (no SQL oracle).
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import HashingTF, RegexTokenizer, StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.sources.delimited import ctas_temp


def _materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a model's input table once to the shared checkpoint folder:
    scaler fit, iterative fit and scoring then read it instead of
    recomputing its lineage, and a lost executor re-reads files."""
    return ctas_temp(df.sparkSession, df, name)


def kmeans_segments(features: DataFrame, id_col: str, columns: list[str], k: int = 8,
                    seed: int = 1234, max_iter: int = 20) -> DataFrame:
    """(id, cluster): standardised features, k-means with a fixed seed.

    Decision: features are scaled to unit variance first so that money does
    not dominate counts.
    """
    pipe = Pipeline(stages=[
        VectorAssembler(inputCols=columns, outputCol="_raw", handleInvalid="keep"),
        StandardScaler(inputCol="_raw", outputCol="_features", withMean=True, withStd=True),
        KMeans(featuresCol="_features", predictionCol="cluster", k=k, seed=seed, maxIter=max_iter),
    ])
    clean = _materialise(features.fillna(0.0, subset=columns), "kmeans-input")
    model = pipe.fit(clean)
    return model.transform(clean).select(id_col, "cluster")


def logreg_interest(features: DataFrame, label: str, columns: list[str], id_col: str,
                    held_out: int = 5) -> DataFrame:
    """Fit logistic regression on ``columns``; report one row with
    precision, accuracy and the confusion matrix counts on the rows held out
    (one in ``held_out`` by a hash of ``id_col``)."""
    assembler = VectorAssembler(inputCols=columns, outputCol="_features", handleInvalid="keep")
    lr = LogisticRegression(featuresCol="_features", labelCol=label, predictionCol="_pred",
                            maxIter=50, regParam=0.01)
    test = F.pmod(F.xxhash64(id_col), F.lit(held_out)) == 0
    data = _materialise(features.select(F.col(label).cast("double").alias(label), test.alias("_test"), *columns),
                        "logreg-input")
    model = Pipeline(stages=[assembler, lr]).fit(data.where(~F.col("_test")))
    p = model.transform(data.where("_test"))
    y, yhat = F.col(label), F.col("_pred")
    m = p.agg(F.count(F.when((y == 1) & (yhat == 1), 1)).alias("tp"),
              F.count(F.when((y == 0) & (yhat == 1), 1)).alias("fp"),
              F.count(F.when((y == 0) & (yhat == 0), 1)).alias("tn"),
              F.count(F.when((y == 1) & (yhat == 0), 1)).alias("fn"))
    return m.select("tp", "fp", "tn", "fn",
                    F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                    F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("tn")
                                 + F.col("fn")).alias("accuracy"))


def nb_text_classifier(rows: DataFrame, is_test: str, text: str, label: str,
                       id_col: str, num_features: int = 1 << 18) -> DataFrame:
    """Multinomial naive Bayes over hashed word counts, fitted where the
    boolean column ``is_test`` is false; returns (id, label, prediction) for
    the other rows. The rows are written once; both parts read that table."""
    pipe = Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="_words", pattern="\\p{L}+", gaps=False),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=num_features),
        NaiveBayes(featuresCol="_tf", labelCol=label, predictionCol="prediction",
                   modelType="multinomial"),
    ])
    data = _materialise(rows.withColumn(label, F.col(label).cast("double")), "nb-input")
    return (pipe.fit(data.where(~F.col(is_test))).transform(data.where(F.col(is_test)))
                .select(id_col, label, "prediction"))


def classifier_accuracy(pred: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """One row: share of rows whose prediction equals the label."""
    return pred.agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"),
                    F.count(F.lit(1)).alias("n"))
