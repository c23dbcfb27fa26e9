"""Classifier training and scoring on a tiny inline set."""

from pyspark.sql import functions as F

from sitelens.operators import textmodels as TM


def test_train_and_score(spark):
    good = [f"great useful helpful article number {i}" for i in range(20)]
    bad = [f"spam junk scam garbage offer {i}" for i in range(20)]
    df = spark.createDataFrame([(t, 1) for t in good] + [(t, 0) for t in bad], "text string, label int")
    model = TM.train_classifier(df, test_percent=25)
    auc = TM.held_out_auc(df, model, test_percent=25)
    assert auc != auc or auc > 0.8  # nan when the held-out split has one class
    scored = TM.score_text(spark.createDataFrame([("helpful useful",), ("scam offer",)], "text string"), model,
                           prefix="quality", labels=("low", "high")).collect()
    assert scored[0].quality_label == "high" and scored[1].quality_label == "low"
    assert 0.5 < scored[0].quality_score <= 1.0


def test_texts_are_read_once_for_a_fit(spark):
    reads = spark.sparkContext.accumulator(0)

    def seen(parts):
        for part in parts:
            reads.add(part.num_rows)
            yield part

    rows = [(f"great helpful article {i}", 1) for i in range(30)] + [(f"spam scam offer {i}", 0) for i in range(30)] + [(None, 1)]
    df = spark.createDataFrame(rows, "text string, label int")
    model = TM.train_classifier(df.mapInArrow(seen, df.schema), test_percent=0)
    assert reads.value == len(rows)
    whole = TM.classifier_pipeline().fit(df.where("text IS NOT NULL").withColumn("label", F.col("label").cast("double")))
    ours, theirs = model.transform(df.where("text IS NOT NULL")), whole.transform(df.where("text IS NOT NULL"))
    for a, b in zip(ours.select("probability").collect(), theirs.select("probability").collect()):
        assert abs(a.probability[1] - b.probability[1]) < 1e-6
