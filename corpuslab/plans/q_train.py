"""§2.J model jobs over the prepared ticket splits (+ split_check and the
auxiliary interpretation that read their outputs)."""

from __future__ import annotations

import time

from pyspark.sql import Window
from pyspark.sql import functions as F

from pyspark.sql import types as T

from corpuslab.functions import text as X
from corpuslab.operators import features as FT
from corpuslab.operators import grouped as G
from corpuslab.operators import linear as L
from corpuslab.operators import metrics as M
from corpuslab.operators import ranking as R
from corpuslab.operators import relate as RL
from corpuslab.operators import sparse as SP
from corpuslab.operators import training as TR
from corpuslab.plans import q_features as QF
from corpuslab.plans import sqlviews as V
from corpuslab.plans.q_rank import SPLIT_SQL
from corpuslab.plans.q_text import s_norm
from corpuslab.plans.views import table, tickets
from corpuslab.session import materialize, shared_table, splits, spread

ALPHA, FOLDS, EPOCHS = 0.1, 5, 30
NB_MAX, NB_MIN_DF, HIER_MAX, FLAT_MAX = 50000, 2, 30000, 80000
WORDS, CHARS = SP.Words("text", 1, 2), SP.CharWb("text", 3, 5)
LEVELS = ["category_level_1", "category_level_2", "category_level_3"]
KEEP = ["doc", *LEVELS, "priority", "split"]


def corpus(s, d):
    """The prepared tickets with their split, written once per session."""
    return shared_table(s, ("corpus", d), lambda: _corpus(s, d))


def _corpus(s, d):
    documents = table(s, d, "documents")
    t = tickets(s, d, spread(documents))
    sp = R.stratified_split(t.select("ticket_id", "category_level_1"), "ticket_id", "category_level_1", 42)
    t = t.select(F.col("ticket_id"), X.normalize_text(X.compose_text(F.col("title"), F.col("description"))).alias("text"),
                 "category_level_1", F.col("priority").cast("string").alias("priority"), "category_level_2", "category_level_3")
    # the files keep the documents' splits, so that later scans have as many tasks
    t = t.repartition(splits(documents), "ticket_id").join(sp.select("ticket_id", "split"), "ticket_id")
    return t.select(F.col("ticket_id").alias("doc"), "text", "category_level_1", "priority", "category_level_2", "category_level_3", "split")


def corpus_counted(s, d):
    """Word 1-2-grams of the prepared tickets, counted in the row."""
    return SP.counted(corpus(s, d), WORDS, KEEP)


def train_texts(s, d):
    return corpus(s, d).filter("split = 'train'").select("doc", "text")


def corpus_vectorizer(s, d):
    return QF.text_vectorizer(s, d, "corpus", train_texts(s, d), WORDS, NB_MAX, NB_MIN_DF)


def corpus_known(s, d):
    """(vectorizer fitted on train, known rows of all documents)."""
    v = corpus_vectorizer(s, d)
    return v, shared_table(s, ("corpus-rows", d), lambda: v.known(corpus(s, d), WORDS, KEEP), **SP.COMPACT)


def corpus_vectors(s, d):
    """(vectorizer fitted on train, sparse rows of all documents)."""
    v, known = corpus_known(s, d)
    return v, SP.scaled(known, v.scale)


def union_vectorizer(s, d):
    """Word 1-2-grams beside char_wb 3-5-grams, each block normalised by itself, fitted on train."""
    chars = QF.text_vectorizer(s, d, "corpus-char35", train_texts(s, d), CHARS, QF.CHAR_MAX, NB_MIN_DF)
    return SP.Union({"w_": corpus_vectorizer(s, d), "c_": chars})


def nb_model(s, d, label: str):
    v, known = corpus_known(s, d)
    return TR.fit_naive_bayes(known.filter("split = 'train'"), label, len(v), ALPHA, v.scale)


def nb_predictions(s, d, label: str, split: str | None = "test"):
    """doc, true_label, pred over a split (None: all documents)."""
    v, rows = corpus_known(s, d)
    if split is not None:
        rows = rows.filter(F.col("split") == split)
    rows = rows.select("doc", F.col(label).alias("true_label"), "idx", "tf")
    return TR.predict_naive_bayes(rows, nb_model(s, d, label), ["doc", "true_label"], rows.schema["true_label"].dataType, scale=v.scale)


SCORED = ("category_level_1", "priority")


def _scored_tickets(s, d, confidence):
    v, rows = corpus_known(s, d)
    p = TR.predict_naive_bayes_all(rows, {t: nb_model(s, d, t) for t in SCORED}, ["doc"], T.StringType(), confidence, v.scale)
    return corpus(s, d).select("doc", F.col("text").alias("input_text")).join(p, "doc").withColumnRenamed("doc", "ticket_id")


def _tickets(s, d):
    """Every ticket with its input text and the decoded label of each task."""
    return _scored_tickets(s, d, False).select("ticket_id", "input_text", F.to_json(F.struct(*SCORED)).alias("predictions"))


def _ticket_confidence(s, d):
    """Every ticket with label and confidence of each task."""
    p = _scored_tickets(s, d, True)
    both = F.explode(F.array(*[F.struct(F.lit(t).alias("task"), F.col(t).alias("label"), F.round(f"{t}_confidence", 6).alias("confidence")) for t in SCORED]))
    return p.select("ticket_id", both.alias("z")).select("ticket_id", "z.*")


def _hier(s, d):
    """L2 given L1 and L3 given L2: a linear SVM for each parent, routed by the true
    parent, on the validation and test splits."""
    out = None
    for parent, label in zip(LEVELS, LEVELS[1:]):
        rows = corpus_counted(s, d).select("doc", F.col(parent).alias("parent"), F.col(label).alias("label"), "split", "terms", "tf")
        models = G.fit_per_parent(rows.filter("split = 'train'"), HIER_MAX)
        keep = ["split", "doc", "parent", "label"]
        p = G.predict_per_parent(rows.filter("split <> 'train'"), models, keep).withColumnRenamed("label", "true_label").withColumn("level", F.lit(label))
        out = p if out is None else out.unionByName(p)
    return out


def _hier_nb(s, d):
    """Naive Bayes of the priority within each L1 class (one job for all parents)."""
    c = corpus(s, d).withColumn("parent", F.col("category_level_1")).withColumn("label", F.col("priority"))
    train, test = c.filter("split = 'train'"), c.filter("split = 'test'")
    tf = FT.term_counts(corpus_counted(s, d))
    voc = materialize(TR.fit_vectorizer(train, tf, HIER_MAX, ["parent"]), "hier-vocabulary")
    both = c.filter("split in ('train', 'test')")
    x = materialize(TR.transform(both, tf, voc, ["parent"]), "hier-vectors")
    xs = x.join(train.select("doc"), "doc", "left_semi")
    model = TR.fit_nb(xs, train.select("doc", "parent", "label"), "label", ALPHA, voc, keys=["parent"])
    pred = TR.predict_nb(x.join(test.select("doc"), "doc", "left_semi"), test.select("doc", "parent"),
                         model, "label", ALPHA, keys=["parent"])
    return test.select("doc", "parent", F.col("label").alias("true_label")).join(pred.drop("parent"), "doc")


def _split_check(s, d):
    sp = R.stratified_split(tickets(s, d).select("ticket_id", "category_level_1"), "ticket_id", "category_level_1", 42)
    names = ["train", "val", "test"]
    p = sp.groupBy(F.col("category_level_1").alias("label")).pivot("split", names).agg(F.count(F.lit(1)))
    tot = {n: sp.filter(F.col("split") == n).select(F.count(F.lit(1))).scalar() for n in names}
    shares = [F.round(F.coalesce(F.col(n), F.lit(0)) / tot[n], 3).alias(f"{n}_share") for n in names]
    out = p.select("label", *shares)
    return out.withColumn("max_gap", F.round(F.greatest(*[F.col(f"{n}_share") for n in names])
                                             - F.least(*[F.col(f"{n}_share") for n in names]), 3))


# Fixed verdict phrases of the reference's auxiliary report.
SEP_LOW, SEP_OK = "suggests labels are NOT well-separated in TF-IDF space", "suggests labels are moderately separable"
F1_LOW, F1_OK = "is near-random baseline", "is above random"


def _aux(s, d):
    sep = QF._sep(s, d)
    out = None
    for task in ("category_level_1", "priority"):
        p = nb_predictions(s, d, task).withColumnRenamed("true_label", "true_id").withColumnRenamed("pred", "pred_id")
        m = M.classification_metrics(p, []).select(F.lit(task).alias("task"), "macro_f1")
        out = m if out is None else out.unionByName(m)
    j = out.join(sep, "task")
    dist, f1 = F.col("mean_inter_class_cosine_distance"), F.col("macro_f1")
    txt = F.format_string("Inter-class cosine distance of %.4f %s. Macro-F1 of %.4f %s.", dist,
                          F.when(dist < 0.3, SEP_LOW).otherwise(SEP_OK), f1, F.when(f1 < 0.30, F1_LOW).otherwise(F1_OK))
    return j.select("task", "macro_f1", dist, txt.alias("interpretation"))


def _indexed(s, d, rows, label, name="label_idx"):
    """Rows with ``name``, the class's number (a class that train lacks gets -1, which no
    model predicts), and the number of classes."""
    labels = RL.build_dimension(corpus(s, d).filter("split = 'train'"), [label]).select(F.col("label").alias(label), F.col("label_id").alias(name))
    labels = materialize(labels, "classes")  # a stored table, so its size decides how it is joined
    return rows.join(labels, label, "left").withColumn(name, F.coalesce(name, F.lit(-1).cast("bigint"))), labels.count()


def _ml_rows(s, d, label="category_level_1"):
    """(scale, classes, stored rows: doc, split, label_idx, fold, idx, tf)."""
    v = union_vectorizer(s, d)
    texts, k = _indexed(s, d, corpus(s, d).select("doc", "split", label, "text"), label)
    fold = F.pmod(F.xxhash64("doc", F.lit("fold")), F.lit(FOLDS)).cast("int")
    texts = texts.withColumn("fold", fold)
    key = (f"ml-rows-{label}", d)
    return v.scale, k, shared_table(s, key, lambda: v.known(texts, {"w_": WORDS, "c_": CHARS}, ["doc", "split", "label_idx", "fold"]), **SP.COMPACT)


def _metrics(pred):
    return M.classification_metrics(pred.select("doc", F.col("label_idx").alias("true_id"), F.col("pred_id").cast("bigint")), [])


class _Logreg:
    def __init__(self, s, d):
        self.scale, k, self.rows = _ml_rows(s, d)
        t0 = time.time()
        self.weights = TR.fit_logreg(self.rows.filter("split = 'train'"), len(self.scale), k, scale=self.scale)
        self.seconds = time.time() - t0

    def predict(self, split):
        m = L.score(self.rows.filter(F.col("split") == split), self.weights, ["doc", "label_idx"], scale=self.scale)
        return m.select("doc", "label_idx", L.best("margins").alias("pred_id"))


class _Svm:
    def __init__(self, s, d):
        self.scale, k, self.known = _ml_rows(s, d)
        t0 = time.time()
        self.weights, self.passes = L.fit_svm(self.known.filter("split = 'train'"), len(self.scale), k, scale=self.scale)
        self.seconds = time.time() - t0

    @property
    def rows(self):
        return SP.scaled(self.known, self.scale)

    def predict(self, split):
        m = L.score(self.known.filter(F.col("split") == split), self.weights, ["doc", "label_idx"], scale=self.scale)
        return m.select("doc", "label_idx", L.best("margins").alias("pred_id"))


class _CalibratedSvm:
    """One SVM a class and fold, all in the same passes, a sigmoid for each from the
    margins of the fold that it has not seen, and the mean over folds."""

    def __init__(self, s, d):
        self.scale, k, self.rows = _ml_rows(s, d)
        train = self.rows.filter("split = 'train'")
        t0 = time.time()
        self.weights, self.passes = L.fit_svm(train, len(self.scale), k, FOLDS, scale=self.scale)
        scored = materialize(L.score(train, self.weights, ["label_idx", "fold"], scale=self.scale), "fold-margins")
        self.sigmoids = L.fit_sigmoids(scored, k, FOLDS)
        self.seconds = time.time() - t0

    def probabilities(self, split):
        return L.calibrated(self.rows.filter(F.col("split") == split), self.weights, self.sigmoids, ["doc", "label_idx"], self.scale)

    def predict(self, split):
        return self.probabilities(split).select("doc", "label_idx", L.best("probabilities").alias("pred_id"))


class _NaiveBayes:
    def __init__(self, s, d):
        v, rows = corpus_known(s, d)
        self.scale = v.scale
        t0 = time.time()
        self.model = TR.fit_naive_bayes(rows.filter("split = 'train'"), "category_level_1", len(v), ALPHA, v.scale)
        self.seconds = time.time() - t0
        self.rows, self.of = rows, (s, d)

    def predict(self, split):
        rows = self.rows.filter(F.col("split") == split)
        p = TR.predict_naive_bayes(rows, self.model, ["doc", "category_level_1"], T.StringType(), "pred", self.scale)
        p, _ = _indexed(*self.of, p, "category_level_1")
        at = F.array_position(F.array(*[F.lit(c) for c in self.model.classes]), F.col("pred")) - 1
        return p.select("doc", "label_idx", at.alias("pred_id"))


def _fit_eval(kind):
    def q(s, d):
        return _metrics(kind(s, d).predict("test")).withColumn("model", F.lit({_Logreg: "logreg", _Svm: "linear_svc"}[kind]))
    return q


def _calibrated(s, d):
    """Class probabilities of the test tickets."""
    p = _CalibratedSvm(s, d).probabilities("test").select("doc", F.posexplode("probabilities").alias("class_id", "probability"))
    return p.select("doc", "class_id", F.round("probability", 6).alias("probability"))


SUITE = {"logreg": _Logreg, "linear_svc": _CalibratedSvm, "naive_bayes": _NaiveBayes}


def _suite(s, d):
    """Validation and test metrics of every baseline from one fit each, training
    seconds, milliseconds a scored row, and the best by validation macro-F1
    (ties by name)."""
    out = None
    for name, kind in SUITE.items():
        m = kind(s, d)
        t0 = time.time()
        val = materialize(m.predict("val"), "suite-val")
        took = time.time() - t0
        va, te = _metrics(val), _metrics(m.predict("test"))
        row = va.select(F.lit(name).alias("model"), F.col("accuracy").alias("val_accuracy"), F.col("macro_f1").alias("val_macro_f1"),
                        *[te.select(c).scalar().alias(f"test_{c}") for c in ("n", "accuracy", "macro_f1")],
                        F.lit(round(m.seconds, 3)).alias("train_seconds"), F.round(F.lit(1000 * took) / F.greatest(F.col("n"), F.lit(1)), 4).alias("infer_ms_per_sample"))
        out = row if out is None else out.unionByName(row)
    best = F.row_number().over(Window.orderBy(F.col("val_macro_f1").desc(), "model")) == 1  # three rows
    return out.withColumn("best", best)


def _flat(s, d):
    """A linear SVM for L2 and one for L3 over 80,000 word 1-2-grams, every class in
    the same passes; metrics of the validation and test splits."""
    v = QF.text_vectorizer(s, d, "flat", train_texts(s, d), WORDS, FLAT_MAX)
    texts, classes = corpus(s, d).select("doc", "split", "text", *LEVELS[1:]), {}
    for level in LEVELS[1:]:
        texts, classes[level] = _indexed(s, d, texts, level, f"{level}_idx")
    rows = shared_table(s, ("flat-rows", d), lambda: v.known(texts, WORDS, ["doc", "split", *[f"{x}_idx" for x in LEVELS[1:]]]), **SP.COMPACT)
    out = None
    for level in LEVELS[1:]:
        x = rows.select("doc", "split", F.col(f"{level}_idx").alias("label_idx"), "idx", "tf")
        weights, _ = L.fit_svm(x.filter("split = 'train'"), len(v), classes[level], scale=v.scale)
        m = L.score(x.filter("split <> 'train'"), weights, ["doc", "split", "label_idx"], scale=v.scale)
        p = materialize(m.select("doc", "split", "label_idx", L.best("margins").alias("pred_id")), "flat-scores")
        for split in ("val", "test"):
            m = _metrics(p.filter(F.col("split") == split)).withColumn("level", F.lit(level)).withColumn("split", F.lit(split))
            out = m if out is None else out.unionByName(m)
    return out


def heads(s, d, epochs=EPOCHS):
    """(history, weights, best epoch) of one softmax head a task on the stored vectors:
    even ids are fitted, odd ones validate."""
    e = table(s, d, "embeddings").select("embedding", (F.col("vec_id") % 2 == 0).alias("fit"), F.col("label").cast("int").alias("label"),
                                         F.floor(F.col("label") / 2).cast("int").alias("parent"))
    e = materialize(e, "head-vectors")
    top = e.agg(F.max("label"), F.max("parent")).first()
    return L.fit_heads(e, "embedding", {"label": top[0] + 1, "parent": top[1] + 1}, epochs)


def _vector_heads(s, d):
    """Every epoch with its losses and validation macro-F1; ``best`` is the epoch whose
    weights are kept."""
    history, _, best = heads(s, d)
    h = s.createDataFrame([tuple(map(float, r[1:])) + (int(r[0]),) for r in history],
                          "label_loss double, parent_loss double, label_macro_f1 double, parent_macro_f1 double, mean_macro_f1 double, epoch int")
    return h.select("epoch", *[F.round(c, 6).alias(c) for c in h.columns[:-1]], (F.col("epoch") == best).alias("best"))


QUERIES = {
    "predict_tickets": _tickets,
    "nb_multinomial": lambda s, d: nb_predictions(s, d, "category_level_1"),
    "ticket_confidence": _ticket_confidence,
    "hier_oracle": _hier,
    "hier_oracle_nb": _hier_nb,
    "split_check": _split_check,
    "aux_interpretation": _aux,
    "logreg": _fit_eval(_Logreg),
    "linear_svc": _fit_eval(_Svm),
    "svc_calibrated": _calibrated,
    "baseline_suite": _suite,
    "flat_level": _flat,
    "vector_heads": _vector_heads,
}

# ---------------------------------------------------------------- SQL twins
COMPOSED = "trim(coalesce(title, '') || ' ' || coalesce(description, ''))"
A = "CAST(0.1 AS DOUBLE)"
BASE = V.with_(V.TICKETS, SPLIT_SQL, f"""nd AS (SELECT t.ticket_id AS doc, {s_norm(COMPOSED)} AS text, t.category_level_1,
  CAST(t.priority AS VARCHAR) AS priority, t.category_level_2, t.category_level_3, sp.split FROM tickets t JOIN splits sp USING (ticket_id))""",
               QF.uni_bi("nd"), "tf AS (SELECT doc, term, count(*) AS tf FROM terms GROUP BY ALL)")


def nb_sql(label, split="'test'"):
    return BASE[:-1] + f""",
trd AS (SELECT doc, {label} AS label FROM nd WHERE split = 'train'),
ted AS (SELECT doc, {label} AS label FROM nd WHERE split IN ({split})),
voc AS (SELECT term, df, ln((1 + (SELECT count(*) FROM trd)) / (1 + df)) + 1 AS idf FROM (
  SELECT term, count(*) AS df, sum(tf) AS cf FROM tf WHERE doc IN (SELECT doc FROM trd) GROUP BY term
  HAVING count(*) >= {NB_MIN_DF} ORDER BY cf DESC, term LIMIT {NB_MAX})),
xw AS (SELECT tf.doc, tf.term, (1 + ln(tf.tf)) * voc.idf AS w FROM tf JOIN voc USING (term)),
x AS (SELECT doc, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc)) AS weight FROM xw),
fc AS (SELECT trd.label, x.term, sum(x.weight) AS fc FROM x JOIN trd USING (doc) GROUP BY ALL),
tot AS (SELECT label, sum(fc) AS tot FROM fc GROUP BY label),
cnt AS (SELECT label, count(*) AS nc FROM trd GROUP BY label),
cls AS (SELECT cnt.label, ln(nc) - ln((SELECT count(*) FROM trd)) AS log_prior,
  ln(coalesce(tot, 0.0) + {A} * (SELECT count(*) FROM voc)) AS log_denom FROM cnt LEFT JOIN tot USING (label)),
feats AS (SELECT label, term, ln(fc + {A}) - ln({A}) AS gain FROM fc),
mass AS (SELECT doc, sum(weight) AS xs FROM x GROUP BY doc),
cand AS (SELECT ted.doc, ted.label AS true_label, cls.label, cls.log_prior, cls.log_denom, coalesce(mass.xs, 0.0) AS xs
  FROM ted LEFT JOIN mass USING (doc), cls),
sp2 AS (SELECT x.doc, f.label, sum(x.weight * f.gain) AS s FROM x JOIN ted USING (doc) JOIN feats f USING (term) GROUP BY ALL),
j AS (SELECT cand.doc, true_label, cand.label, log_prior + xs * (ln({A}) - log_denom) + coalesce(s, 0.0) AS jll
  FROM cand LEFT JOIN sp2 ON cand.doc = sp2.doc AND cand.label = sp2.label),
nbp AS (SELECT doc, true_label, label AS pred FROM (
  SELECT *, row_number() OVER (PARTITION BY doc ORDER BY jll DESC NULLS LAST, label) AS rn FROM j) WHERE rn = 1)
"""


HIER = BASE[:-1] + f""",
trd AS (SELECT doc, category_level_1 AS parent, priority AS label FROM nd WHERE split = 'train'),
ted AS (SELECT doc, category_level_1 AS parent, priority AS label FROM nd WHERE split = 'test'),
alld AS (SELECT doc, parent FROM trd UNION ALL SELECT doc, parent FROM ted),
np AS (SELECT parent, count(*) AS np FROM trd GROUP BY parent),
voc AS (SELECT v.parent, v.term, v.df, ln((1 + np.np) / (1 + v.df)) + 1 AS idf FROM (
  SELECT parent, term, df, row_number() OVER (PARTITION BY parent ORDER BY cf DESC, term) AS rk FROM (
    SELECT trd.parent, tf.term, count(*) AS df, sum(tf.tf) AS cf FROM tf JOIN trd USING (doc) GROUP BY ALL)) v
  JOIN np USING (parent) WHERE rk <= {HIER_MAX}),
xw AS (SELECT tf.doc, tf.term, (1 + ln(tf.tf)) * voc.idf AS w FROM tf JOIN alld USING (doc)
  JOIN voc ON voc.parent = alld.parent AND voc.term = tf.term),
x AS (SELECT doc, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc)) AS weight FROM xw),
fc AS (SELECT trd.parent, trd.label, x.term, sum(x.weight) AS fc FROM x JOIN trd USING (doc) GROUP BY ALL),
tot AS (SELECT parent, label, sum(fc) AS tot FROM fc GROUP BY ALL),
cnt AS (SELECT parent, label, count(*) AS nc FROM trd GROUP BY ALL),
nv AS (SELECT parent, count(*) AS nv FROM voc GROUP BY parent),
cls AS (SELECT cnt.parent, cnt.label, ln(nc) - ln(np.np) AS log_prior,
  ln(coalesce(tot.tot, 0.0) + {A} * coalesce(nv.nv, 0)) AS log_denom
  FROM cnt JOIN np USING (parent) LEFT JOIN nv USING (parent) LEFT JOIN tot ON tot.parent = cnt.parent AND tot.label = cnt.label),
feats AS (SELECT parent, label, term, ln(fc + {A}) - ln({A}) AS gain FROM fc),
mass AS (SELECT doc, sum(weight) AS xs FROM x GROUP BY doc),
cand AS (SELECT ted.doc, ted.parent, ted.label AS true_label, cls.label, cls.log_prior, cls.log_denom, coalesce(mass.xs, 0.0) AS xs
  FROM ted LEFT JOIN mass USING (doc) LEFT JOIN cls ON cls.parent = ted.parent),
sp2 AS (SELECT x.doc, f.label, sum(x.weight * f.gain) AS s FROM x JOIN ted USING (doc)
  JOIN feats f ON f.parent = ted.parent AND f.term = x.term GROUP BY ALL),
j AS (SELECT cand.doc, parent, true_label, cand.label, log_prior + xs * (ln({A}) - log_denom) + coalesce(s, 0.0) AS jll
  FROM cand LEFT JOIN sp2 ON cand.doc = sp2.doc AND cand.label = sp2.label)
SELECT doc, parent, true_label, coalesce(label, 'Unknown') AS pred FROM (
  SELECT *, row_number() OVER (PARTITION BY doc ORDER BY jll DESC NULLS LAST, label) AS rn FROM j) WHERE rn = 1"""

_SPLITS = ["train", "val", "test"]
SPLITCHECK = V.with_(V.TICKETS, SPLIT_SQL) + """, c AS (SELECT category_level_1 AS label, split, count(*) AS n FROM splits GROUP BY ALL),
t AS (SELECT split, count(*) AS tot FROM splits GROUP BY split),
s AS (SELECT label, """ + ", ".join(
    f"round(coalesce(max(CASE WHEN c.split = '{n}' THEN n END), 0) / max(CASE WHEN t.split = '{n}' THEN t.tot END), 3) AS {n}_share"
    for n in _SPLITS) + """ FROM c, t GROUP BY label)
SELECT *, round(greatest(train_share, val_share, test_share) - least(train_share, val_share, test_share), 3) AS max_gap FROM s"""

ALL = "'train', 'val', 'test'"


def _tickets_sql():
    def one(task):
        return f"(SELECT doc, pred FROM ({nb_sql(task, ALL)} SELECT * FROM nbp))"
    a, b = (one(t) for t in SCORED)
    return f"""{BASE[:-1]}
SELECT nd.doc AS ticket_id, nd.text AS input_text,
  CAST(json_object('{SCORED[0]}', a.pred, '{SCORED[1]}', b.pred) AS VARCHAR) AS predictions
FROM nd JOIN {a} a ON a.doc = nd.doc JOIN {b} b ON b.doc = nd.doc"""


SQL = {
    "predict_tickets": _tickets_sql(),
    "nb_multinomial": nb_sql("category_level_1") + "SELECT * FROM nbp",
    "hier_oracle_nb": HIER,
    "split_check": SPLITCHECK,
}


def _aux_sql():
    from corpuslab.plans import sqlmetrics as SM

    def f1(label):
        return nb_sql(label) + ", pp AS (SELECT true_label AS true_id, pred AS pred_id FROM nbp), " + \
            SM.metrics("pp", []) + "\nSELECT macro_f1 FROM m"
    sep = QF.SQL["class_separability"]
    return f"""SELECT f.task, f.macro_f1, s.mean_inter_class_cosine_distance,
  printf('Inter-class cosine distance of %.4f %s. Macro-F1 of %.4f %s.', s.mean_inter_class_cosine_distance,
    CASE WHEN s.mean_inter_class_cosine_distance < 0.3 THEN '{SEP_LOW}' ELSE '{SEP_OK}' END, f.macro_f1,
    CASE WHEN f.macro_f1 < 0.30 THEN '{F1_LOW}' ELSE '{F1_OK}' END) AS interpretation
FROM (SELECT 'category_level_1' AS task, * FROM ({f1('category_level_1')})
      UNION ALL SELECT 'priority', * FROM ({f1('priority')})) f
JOIN ({sep}) s ON s.task = f.task"""


SQL["aux_interpretation"] = _aux_sql()
