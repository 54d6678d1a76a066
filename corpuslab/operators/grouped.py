"""One linear SVM for every parent class, each with its own vocabulary and idf, on
counted rows (parent, label, terms, tf).

Parents with few rows are trained whole in one task each (``applyInArrow``); a
parent with more than ``HOT`` rows goes the distributed way of ``linear.fit_svm``, so
no group is gathered that grows with the corpus. Documents are dealt to the
models by parent and share, so a hot parent is scored by many tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.operators import linear as L
from corpuslab.operators import sparse as SP
from corpuslab.session import materialize

HOT, SHARE, UNKNOWN = 2000, 2048, "Unknown"
MODELS = "parent string, classes array<string>, terms array<string>, idf array<double>, weights binary"


def _model(parent, classes, v: SP.Vectorizer | None, weights: np.ndarray | None) -> dict:
    return {"parent": parent, "classes": classes, "terms": v.terms.to_pylist() if v else [], "idf": v.idf.tolist() if v else [],
            "weights": weights.tobytes() if weights is not None else None}


def _local(max_features: int, C: float):
    schema = pa.schema([("parent", pa.string()), ("classes", pa.list_(pa.string())), ("terms", pa.list_(pa.string())), ("idf", pa.list_(pa.float64())), ("weights", pa.binary())])

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        label = t.column("label").to_pylist()
        classes = sorted(set(label))
        parent = t.column("parent")[0].as_py()
        if len(classes) < 2:
            return pa.Table.from_pylist([_model(parent, classes, None, None)], schema=schema)
        terms, tf = t.column("terms").combine_chunks(), t.column("tf").combine_chunks()
        coded, n = terms.flatten().dictionary_encode(), np.asarray(tf.flatten())
        names, code = coded.dictionary, np.asarray(coded.indices)
        df, cf = np.bincount(code, minlength=len(names)), np.bincount(code, weights=n, minlength=len(names))
        order = pc.sort_indices(pa.table({"cf": cf, "term": names}), sort_keys=[("cf", "descending"), ("term", "ascending")])[:max_features]  # terms by their bytes
        v = SP.Vectorizer(names.take(order), df[np.asarray(order)], t.num_rows)
        at = {c: k for k, c in enumerate(classes)}
        weights = L.fit_svm_local(*v.weigh(terms, tf), np.array([at[x] for x in label]), len(v), len(classes), C)
        return pa.Table.from_pylist([_model(parent, classes, v, weights)], schema=schema)
    return run


def fit_per_parent(counted: DataFrame, max_features: int, C: float = 1.0, hot: int = HOT) -> DataFrame:
    """A table of models, one row a parent. A parent with one label has no weights."""
    spark = counted.sparkSession
    x = materialize(counted.filter("parent is not null and label is not null").select("parent", "label", "terms", "tf"), "parent-rows")
    large = [r["parent"] for r in x.groupBy("parent").count().filter(F.col("count") > hot).collect()]  # at most rows / hot
    models = x.filter(~F.col("parent").isin(large)).groupBy("parent").applyInArrow(_local(max_features, C), MODELS)
    for parent in large:
        mine = x.filter(F.col("parent") == parent)
        classes = sorted(r["label"] for r in mine.select("label").distinct().collect())
        if len(classes) < 2:
            one = _model(parent, classes, None, None)
        else:
            v = SP.Vectorizer.fit(mine, max_features)
            labels = spark.createDataFrame([(c, k) for k, c in enumerate(classes)], "label string, label_idx int")
            rows = materialize(v.rows(mine.join(F.broadcast(labels), "label").select("label_idx", "terms", "tf")), "parent-vectors")
            one = _model(parent, classes, v, L.fit_svm(rows, len(v), len(classes), C=C)[0])
        models = models.unionByName(spark.createDataFrame([tuple(one.values())], MODELS))
    return materialize(models, "parent-models")


def _route(keep: list[str]):
    def run(docs: pa.Table, models: pa.Table) -> pa.Table:
        docs = docs.combine_chunks()
        m = models.to_pylist()[0] if models.num_rows else None
        if m is None or not m["classes"]:
            pred = [UNKNOWN] * docs.num_rows
        elif m["weights"] is None:
            pred = [m["classes"][0]] * docs.num_rows
        else:
            v = SP.Vectorizer(m["terms"], np.zeros(len(m["terms"])), 0)
            v.idf = np.array(m["idf"])
            weights = np.frombuffer(m["weights"]).reshape(-1, len(m["classes"]))
            pred = []
            for b in (x for whole in docs.select(["terms", "tf"]).to_batches() for x in SP.pieces(whole, column="terms")):
                best = L.margins(*v.weigh(b.column("terms"), b.column("tf")), b.num_rows, weights).argmax(axis=1)
                pred += [m["classes"][k] for k in best]
        return docs.select(keep).append_column("pred", pa.array(pred, pa.string()))
    return run


def predict_per_parent(counted: DataFrame, models: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns and ``pred``: the model of the row's parent answers; a parent
    with one label answers that one, a parent without a model ``Unknown``."""
    from pyspark.sql import types as T
    schema = T.StructType([counted.schema[c] for c in keep]).add("pred", T.StringType())
    share = F.greatest(F.lit(1), F.ceil(F.col("n") / SHARE)).cast("int")
    n = counted.groupBy("parent").agg(F.count(F.lit(1)).alias("n")).select(F.col("parent").alias("of"), share.alias("shares"))  # one row a parent
    docs = counted.join(n, F.col("parent").eqNullSafe(F.col("of"))).drop("of")
    docs = docs.withColumn("part", F.pmod(F.xxhash64(*keep), F.col("shares")).cast("int"))
    far = models.join(n, F.col("parent") == F.col("of")).drop("of").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    cols = list(dict.fromkeys([*keep, "parent", "part", "terms", "tf"]))
    return docs.select(*cols).groupBy("parent", "part").cogroup(far.groupBy("parent", "part")).applyInArrow(_route(keep), schema)
