"""Plug points of §2.L: a caller's normaliser and a caller's scorer."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normalise_with(df: DataFrame, cols: Sequence[str], normaliser: Callable[[Column], Column]) -> DataFrame:
    """The columns rewritten by a column expression of the caller's, which stays
    inside the plan; nulls become empty first, as in the built-in normaliser."""
    return df.withColumns({c: normaliser(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in cols})


def score_with(df: DataFrame, inputs: Sequence[str], make_scorer: Callable, name: str = "logits",
               return_type: T.DataType | None = None, batch_size: int = 256, shapes: list | None = None) -> DataFrame:
    """``name``: the scores of an external model. ``make_scorer()`` loads it once in
    each Python worker and returns a function from batches of the input columns
    (numpy arrays; ``shapes``: those of array columns) to a batch of scores."""
    from pyspark.ml.functions import predict_batch_udf
    udf = predict_batch_udf(make_scorer, return_type=return_type or T.ArrayType(T.DoubleType()), batch_size=batch_size, input_tensor_shapes=shapes)
    return df.withColumn(name, udf(*[F.col(c) for c in inputs]))
