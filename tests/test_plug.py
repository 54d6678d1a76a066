"""A caller's normaliser and scorer."""

from pyspark.sql import functions as F

from corpuslab.operators import plug
from corpuslab.operators.vectors import to_predictions


def test_normalise_with(spark):
    df = spark.createDataFrame([(1, " AbC "), (2, None)], "id long, t string")
    out = plug.normalise_with(df, ["t"], lambda c: F.upper(F.trim(c))).collect()
    assert [r["t"] for r in out] == ["ABC", ""]


def test_score_with(spark):
    def load():
        import numpy as np
        w = np.array([[1.0, 0.0], [0.0, 1.0], [1.0, 1.0]])

        def predict(x):
            return x @ w.T
        return predict
    df = spark.createDataFrame([(i, "t", [float(i), 1.0]) for i in range(-5, 600)], "id long, task string, vec array<double>")
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql import types as T
    udf = predict_batch_udf(load, return_type=T.ArrayType(T.DoubleType()), batch_size=100, input_tensor_shapes=[[2]])
    want = {r["id"]: r["l"] for r in df.select("id", udf("vec").alias("l")).collect()}
    got = plug.score_with(df, ["vec"], load, shapes=[[2]], batch_size=100)
    assert {r["id"]: r["logits"] for r in got.collect()} == want and want[-5] == [-5.0, 1.0, -4.0]
    assert {r["pred_id"] for r in to_predictions(got).filter("id > 1").collect()} == {2}
