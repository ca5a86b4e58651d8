"""Tree ensembles as columns against the learners' own predictions."""

from __future__ import annotations

import random

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from stratapanel.llm import trees


def test_boosted_probability_equals_the_model(spark):
    draw = random.Random(1)
    rows = [([draw.random(), float(draw.randint(0, 3)), draw.gauss(0, 1)],) for _ in range(400)]
    rows = [(x, float(x[0] + x[1] / 3 + draw.random() / 2 > 1 or x[2] > 1.5)) for (x,) in rows]
    df = spark.createDataFrame(rows, "features array<double>, label double").withColumn("vector", array_to_vector("features"))
    for depth, label in ((4, F.col("label")), (1, F.col("label")), (3, F.lit(1.0))):
        model = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=5, maxDepth=depth, seed=4).fit(df.withColumn("label", label))
        both = model.transform(df).select("probability", trees.boosted_probability(model, F.col("features")).alias("p"), F.filter(F.array("features"), lambda x: trees.boosted_probability(model, x) >= 0.5).alias("f")).collect()
        assert all(abs(r["probability"][1] - r["p"]) < 1e-9 and (len(r["f"]) == 1) == (r["p"] >= 0.5) for r in both)


def test_rows_that_stand_for_several_calibrate_by_their_number():
    rows = [(0.9, 40.0, 40.0), (0.2, 0.0, 10.0), (0.7, 1.0, 2.0), (0.5, 3.0, 4.0)]
    assert trees.isotonic(rows) == [(0.2, 0.0), (0.5, 4 / 6), (0.9, 1.0)]
    assert trees.calibrated_threshold(rows, 0.98, 2.0) == 0.9 and trees.calibrated_threshold(rows[1:], 0.98, 2.0) == 2.0
