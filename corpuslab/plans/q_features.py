"""§2.H text-feature queries over the whole ``tickets`` texts, SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpuslab.functions import text as X
from corpuslab.operators import features as FT
from corpuslab.operators import neardup as ND
from corpuslab.operators import sparse as SP
from corpuslab.plans import sqlviews as V
from corpuslab.plans.views import table, tickets
from corpuslab.session import shared_table, spread

WORD_MAX, CHAR_MAX, SEP_MAX, NEAR_MAX, NEAR_T, MIN_DF = 50000, 80000, 10000, 50000, 0.9, 2
TASKS = ("category_level_1", "priority")


def docs(s, d):
    t = tickets(s, d, spread(table(s, d, "documents")))
    return t.select(F.col("ticket_id").alias("doc"), X.compose_text(F.col("title"), F.col("description")).alias("text"),
                    "category_level_1", F.col("priority").cast("string").alias("priority"))


def counted(s, d, name, spec, source=None, keep=("doc",)):
    """Distinct terms and counts of every document."""
    return SP.counted((source or docs)(s, d), spec, keep)


def _vocabulary(s, d, name, stats, rows, max_features, min_df):
    """The vectorizer of ``stats()``; its vocabulary is a shared table."""
    def build():
        n = rows.count()
        return SP.vocabulary(stats(), max_features, min_df).withColumn("n_docs", F.lit(n))
    return SP.Vectorizer.stored(shared_table(s, (f"vocabulary-{name}", d), build))


def vectorizer(s, d, name, rows, max_features, min_df=1):
    """The vectorizer fitted on counted rows."""
    return _vocabulary(s, d, name, lambda: SP.term_stats(rows), rows, max_features, min_df)


def text_vectorizer(s, d, name, texts, spec, max_features, min_df=1):
    """The vectorizer fitted on texts, without a table of counted rows."""
    return _vocabulary(s, d, name, lambda: SP.text_stats(texts, spec), texts, max_features, min_df)


def _ntok(s, d):
    x = docs(s, d).select("doc", X.word_tokens(F.col("text")).alias("t"))
    return x.select(F.col("doc").alias("ticket_id"), F.size("t").cast("bigint").alias("n_tokens"),
                    F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct"))


def _stats(spec, min_df=1):
    def q(s, d):
        return SP.text_stats(docs(s, d), spec).filter(F.col("df") >= min_df)
    return q


def _vocab(s, d):
    v = SP.vocabulary(SP.text_stats(docs(s, d), SP.Words("text", 1, 2)), WORD_MAX, 2)
    return v.withColumn("rank", F.row_number().over(Window.orderBy(F.col("cf").desc(), "term")).cast("bigint"))


def _weights(s, d, name, spec, max_features):
    texts = docs(s, d)
    v = text_vectorizer(s, d, name, texts, spec, max_features, MIN_DF)
    return v.text_weights(texts, spec).select("doc", "term", F.round("weight", 6).alias("weight"))


def _tfidf(s, d):
    return _weights(s, d, "word12", SP.Words("text", 1, 2), WORD_MAX)


def _union(s, d):
    wb = _weights(s, d, "word12", SP.Words("text", 1, 2), WORD_MAX).withColumn("block", F.lit("word"))
    cb = _weights(s, d, "char35", SP.CharWb("text", 3, 5), CHAR_MAX).withColumn("block", F.lit("char"))
    return wb.unionByName(cb).select("doc", "block", "term", "weight")


def near_dup_known(s, d):
    """(scale, char 2-4-gram rows (50k vocabulary) fitted on train and test raw text);
    ``side``: odd ids are the test documents."""
    spec = SP.CharWb("text", 2, 4)
    v = text_vectorizer(s, d, "char24", docs(s, d), spec, NEAR_MAX)
    known = shared_table(s, ("near-dup-rows", d), lambda: v.known(docs(s, d), spec, ["doc"]).withColumn("side", F.col("doc") % 2 == 1), **SP.COMPACT)
    return v.scale, known


def near_dup_features(s, d):
    """The same with their TF-IDF weights."""
    scale, known = near_dup_known(s, d)
    return SP.scaled(known, scale)


def _sims(route):
    def q(s, d):
        scale, rows = near_dup_known(s, d)
        return route(rows, scale).select(F.col("doc").alias("test_idx"), F.round("max_sim", 6).alias("max_sim"))
    return q


def _norm_docs(s, d):
    """The normalised texts, written once per session."""
    return shared_table(s, ("norm-docs", d), lambda: docs(s, d).withColumn("text", X.normalize_text(F.col("text"))))


def _sep_rows(s, d):
    """(vectorizer, known rows of all documents)."""
    texts, spec = _norm_docs(s, d), SP.Words("text")
    v = text_vectorizer(s, d, "norm-word1", texts, spec, SEP_MAX)
    return v, shared_table(s, ("separability-rows", d), lambda: v.known(texts, spec, TASKS), **SP.COMPACT)


def _centroids(s, d):
    v, rows = _sep_rows(s, d)
    names = s.createDataFrame([(i, t) for i, t in enumerate(v.terms.to_pylist())], "idx int, term string")  # at most SEP_MAX
    c = FT.centroids(rows, "category_level_1", v.scale).join(names, "idx")
    return c.select(F.col("label").alias("class"), "term", F.round("value", 6).alias("value"))


def _sep(s, d):
    v, rows = _sep_rows(s, d)
    out = None
    for task in TASKS:
        cent = shared_table(s, (f"centroids-{task}", d), lambda task=task: FT.centroids(rows, task, v.scale))
        r = FT.separability(cent).select(F.lit(task).alias("task"), "n_classes", F.round("mean_inter_class_cosine_distance", 6)
                                         .alias("mean_inter_class_cosine_distance"))
        out = r if out is None else out.unionByName(r)
    return out


def _bytes(s, d):
    n = F.octet_length("text") + 1
    return docs(s, d).select(F.col("doc").alias("ticket_id"), n.cast("bigint").alias("n_tokens"),
                             (n <= 256).alias("within_budget"), F.greatest(n - 256, F.lit(0)).cast("bigint").alias("n_truncated"))


def _pad(s, d):
    v = _vocab(s, d).select("term", "rank")
    toks = docs(s, d).select("doc", X.word_tokens(F.col("text")).alias("tokens"))
    p = FT.pad_ids(toks, "doc", v, 128)
    return p.select(F.col("doc").alias("ticket_id"), F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("input_ids"),
                    F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).cast("bigint").alias("n_attended"))


QUERIES = {
    "word_tokens": _ntok,
    "word_ngrams": _stats(SP.Words("text", 1, 2), 2),
    "char_wb_ngrams": _stats(SP.CharWb("text", 2, 4)),
    "vocab_limit": _vocab,
    "tfidf": _tfidf,
    "tfidf_union": _union,
    "near_dup_max_sim": _sims(lambda rows, scale: ND.max_sims(rows, NEAR_MAX, scale=scale)),
    "near_dup_flag": _sims(lambda rows, scale: ND.flag(rows, NEAR_MAX, NEAR_T, scale=scale)),
    "near_dup_lsh": _sims(lambda rows, scale: ND.lsh(rows, NEAR_MAX, NEAR_T, scale=scale)),
    "class_centroids": _centroids,
    "class_separability": _sep,
    "byte_tokens": _bytes,
    "pad_truncate": _pad,
}

# ---------------------------------------------------------------- SQL twins
WS, WT = X.WHITESPACE_RUN, X.WORD_TOKEN
DOCS = V.with_(V.TICKETS, """docs AS (SELECT ticket_id AS doc, trim(coalesce(title, '') || ' ' || coalesce(description, '')) AS text,
  category_level_1, priority FROM tickets)""")
TOK = f"regexp_extract_all(lower(text), '{WT}')"


def uni_bi(src="docs"):
    return f"""tk AS (SELECT doc, {TOK} AS t FROM {src}),
terms AS (SELECT doc, unnest(t) AS term FROM tk
  UNION ALL SELECT doc, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM tk WHERE len(t) >= 2)"""


def uni(src="docs"):
    return f"terms AS (SELECT doc, unnest({TOK}) AS term FROM {src})"


def char_wb(lo, hi, src="docs"):
    parts = " UNION ALL ".join(
        f"SELECT doc, unnest(list_transform(range(1, length(w) - {n} + 2), lambda i: substr(w, i, {n}))) AS term FROM wd WHERE length(w) >= {n}"
        for n in range(lo, hi + 1))
    return f"""wd AS (SELECT doc, ' ' || unnest(list_filter(regexp_split_to_array(lower(text), '{WS}'), lambda x: x <> '')) || ' ' AS w FROM {src}),
terms AS ({parts} UNION ALL SELECT doc, w FROM wd WHERE length(w) < {lo})"""


def tfidf_sql(max_features, src="docs", name="tw", min_df=1):
    return f"""{name}_tf AS (SELECT doc, term, count(*) AS tf FROM terms GROUP BY ALL),
{name}_v AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM {name}_tf GROUP BY term HAVING count(*) >= {min_df} ORDER BY cf DESC, term LIMIT {max_features}),
{name}_w AS (SELECT t.doc, t.term, (1 + ln(t.tf)) * (ln((1 + (SELECT count(*) FROM {src})) / (1 + v.df)) + 1) AS w
  FROM {name}_tf t JOIN {name}_v v USING (term)),
{name} AS (SELECT doc, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc)) AS weight FROM {name}_w)"""


def _norm_sql(x):
    from corpuslab.plans.q_text import s_norm
    return s_norm(x)


NDOCS = DOCS[:-1] + f""",
ndocs AS (SELECT doc, {_norm_sql('text')} AS text, category_level_1, CAST(priority AS VARCHAR) AS priority FROM docs),
{uni('ndocs')},
{tfidf_sql(SEP_MAX, 'ndocs')}
"""


def _sep_sql(task):
    return f"""SELECT '{task}' AS task, (SELECT count(DISTINCT {task}) FROM ndocs) AS n_classes,
  round(avg(1 - coalesce(dot, 0.0) / (na * nb)), 6) AS mean_inter_class_cosine_distance FROM (
  SELECT a.c AS a, b.c AS b, a.nrm AS na, b.nrm AS nb FROM nrm_{task} a JOIN nrm_{task} b ON a.c < b.c) p
  LEFT JOIN (SELECT x.c AS a, y.c AS b, sum(x.value * y.value) AS dot FROM cen_{task} x JOIN cen_{task} y
    ON x.term = y.term AND x.c < y.c GROUP BY ALL) dd USING (a, b)"""


def _cen_sql(task):
    return f"""cen_{task} AS (SELECT d.{task} AS c, w.term, sum(w.weight) / any_value(sz.n) AS value FROM tw w JOIN ndocs d ON w.doc = d.doc
  JOIN (SELECT {task}, count(*) AS n FROM ndocs GROUP BY ALL) sz ON sz.{task} = d.{task} GROUP BY ALL),
nrm_{task} AS (SELECT c, sqrt(sum(value * value)) AS nrm FROM cen_{task} GROUP BY c)"""


SQL = {
    "word_tokens": DOCS + f"""SELECT doc AS ticket_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct
FROM (SELECT doc, {TOK} AS t FROM docs)""",
    "word_ngrams": DOCS[:-1] + ",\n" + uni_bi() + """
SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (SELECT doc, term, count(*) AS tf FROM terms GROUP BY ALL)
GROUP BY term HAVING count(*) >= 2""",
    "char_wb_ngrams": DOCS[:-1] + ",\n" + char_wb(2, 4) + """
SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (SELECT doc, term, count(*) AS tf FROM terms GROUP BY ALL) GROUP BY term""",
    "vocab_limit": DOCS[:-1] + ",\n" + uni_bi() + f"""
SELECT term, df, cf, CAST(row_number() OVER (ORDER BY cf DESC, term) AS BIGINT) AS rank FROM (
  SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (SELECT doc, term, count(*) AS tf FROM terms GROUP BY ALL)
  GROUP BY term HAVING count(*) >= 2 ORDER BY cf DESC, term LIMIT {WORD_MAX})""",
    "tfidf": DOCS[:-1] + ",\n" + uni_bi() + ",\n" + tfidf_sql(WORD_MAX, min_df=MIN_DF) + "\nSELECT doc, term, round(weight, 6) AS weight FROM tw",
    "tfidf_union": DOCS[:-1] + ",\n" + uni_bi() + ",\n" + tfidf_sql(WORD_MAX, min_df=MIN_DF) + ",\n" +
        char_wb(3, 5).replace("terms AS", "cterms AS") + ",\n" + tfidf_sql(CHAR_MAX, name="tc", min_df=MIN_DF).replace("FROM terms", "FROM cterms") + """
SELECT doc, 'word' AS block, term, round(weight, 6) AS weight FROM tw UNION ALL SELECT doc, 'char', term, round(weight, 6) FROM tc""",
    "class_centroids": NDOCS[:-1] + ",\n" + _cen_sql("category_level_1") +
        "\nSELECT c AS class, term, round(value, 6) AS value FROM cen_category_level_1",
    "class_separability": NDOCS[:-1] + ",\n" + _cen_sql("category_level_1") + ",\n" + _cen_sql("priority") + "\n" +
        _sep_sql("category_level_1") + "\nUNION ALL\n" + _sep_sql("priority"),
    "byte_tokens": DOCS + """SELECT doc AS ticket_id, CAST(octet_length(encode(text)) + 1 AS BIGINT) AS n_tokens,
  octet_length(encode(text)) + 1 <= 256 AS within_budget, CAST(greatest(octet_length(encode(text)) + 1 - 256, 0) AS BIGINT) AS n_truncated FROM docs""",
    "pad_truncate": DOCS[:-1] + ",\n" + uni_bi() + f""",
voc AS (SELECT term, row_number() OVER (ORDER BY cf DESC, term) AS rank FROM (
  SELECT term, count(*) AS df, sum(tf) AS cf FROM (SELECT doc, term, count(*) AS tf FROM terms GROUP BY ALL)
  GROUP BY term HAVING count(*) >= 2 ORDER BY cf DESC, term LIMIT {WORD_MAX})),
tp AS (SELECT doc, unnest({TOK}) AS term, unnest(generate_series(1, len({TOK}))) AS pos FROM docs),
ids AS (SELECT tp.doc, list(coalesce(voc.rank + 1, 1) ORDER BY tp.pos) AS l FROM tp LEFT JOIN voc USING (term) GROUP BY tp.doc),
cut AS (SELECT d.doc, coalesce(list_slice(ids.l, 1, 128), []) AS l FROM docs d LEFT JOIN ids USING (doc))
SELECT doc AS ticket_id, array_to_string(list_concat(l, list_transform(range(0, 128 - len(l)), lambda i: 0)), ' ') AS input_ids,
  CAST(len(l) AS BIGINT) AS n_attended FROM cut""",
}
