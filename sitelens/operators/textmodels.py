"""Text classifiers (K5-K7) with pyspark.ml.

The reference scores sentiment and content quality with pretrained
transformer pipelines and fine-tunes one on labelled domains. Here the same
roles are played by a fitted ``pyspark.ml`` pipeline trained on a labelled
table: word unigrams and bigrams -> hashed term frequencies -> IDF ->
logistic regression. Training and scoring are distributed; any fitted
``Transformer`` that outputs ``probability`` can be plugged in instead.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import IDF, HashingTF, NGram, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.functions.text import WORD
from sitelens.session import cut_lineage

NUM_FEATURES = 1 << 16


def classifier_pipeline(text_col: str = "text", label_col: str = "label", max_iter: int = 20,
                        reg: float = 0.01) -> Pipeline:
    tok = RegexTokenizer(inputCol=text_col, outputCol="_words", pattern=WORD, gaps=False, toLowercase=True)
    bi = NGram(n=2, inputCol="_words", outputCol="_bigrams")
    tf1 = HashingTF(inputCol="_words", outputCol="_tf1", numFeatures=NUM_FEATURES)
    tf2 = HashingTF(inputCol="_bigrams", outputCol="_tf2", numFeatures=NUM_FEATURES)
    va = VectorAssembler(inputCols=["_tf1", "_tf2"], outputCol="_tf")
    idf = IDF(inputCol="_tf", outputCol="features", minDocFreq=2)
    lr = LogisticRegression(featuresCol="features", labelCol=label_col, maxIter=max_iter, regParam=reg)
    return Pipeline(stages=[tok, bi, tf1, tf2, va, idf, lr])


def _labelled(df: DataFrame, text_col: str, label_col: str, test_percent: int) -> DataFrame:
    """text, label and ``held``: whether the text's hash puts it into the held-out part (the same whatever the row order
    or the partitions)."""
    data = df.select(F.col(text_col).alias("text"), F.col(label_col).cast("double").alias("label")).where(
        F.col("text").isNotNull() & F.col("label").isNotNull())
    return data.withColumn("held", F.pmod(F.xxhash64("text"), F.lit(100)) < test_percent)


def train_classifier(df: DataFrame, text_col: str = "text", label_col: str = "label",
                     test_percent: int = 20) -> PipelineModel:
    """K7: fit on the rows outside the held-out part. Their words are cut and hashed once and the counts kept in the
    checkpoint folder, which all passes of the fit read."""
    *cutting, idf, lr = classifier_pipeline().getStages()
    rows = _labelled(df, text_col, label_col, test_percent).where(~F.col("held"))
    counted = cut_lineage(PipelineModel(cutting).transform(rows).select("label", "_tf"))
    idf_model = idf.fit(counted)
    return PipelineModel([*cutting, idf_model, lr.fit(idf_model.transform(counted))])


def held_out_auc(df: DataFrame, model: Transformer, text_col: str = "text", label_col: str = "label",
                 test_percent: int = 20) -> float:
    """Area under ROC on the held-out part; nan if it holds one class alone."""
    scored = model.transform(_labelled(df, text_col, label_col, test_percent).where("held"))
    if scored.select("label").distinct().count() < 2:
        return float("nan")
    return BinaryClassificationEvaluator(labelCol="label").evaluate(scored)


def score_text(df: DataFrame, model: Transformer, text_col: str = "text", prefix: str = "sentiment",
               labels=("negative", "positive")) -> DataFrame:
    """K5/K6: label + score (probability of the positive class) per text."""
    scored = model.transform(df.withColumnRenamed(text_col, "text") if text_col != "text" else df)
    p1 = vector_to_array("probability")[1]
    keep = [c for c in df.columns]
    out = scored.select(*[F.col(c) for c in keep if c != text_col] + ([F.col("text").alias(text_col)] if text_col != "text" else [F.col("text")]),
                        F.when(p1 >= 0.5, F.lit(labels[1])).otherwise(F.lit(labels[0])).alias(f"{prefix}_label"),
                        F.round(p1, 6).alias(f"{prefix}_score"))
    return out
