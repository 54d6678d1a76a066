"""§2.K streaming queries, drained with ``availableNow``; the sink is read back. Tickets
stream from the documents as they lie there; event-time queries get their table
in time slices."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.functions import text as X
from corpuslab.operators import training as TR
from corpuslab.plans import q_train as QT
from corpuslab.plans import sqlviews as V
from corpuslab.plans.views import table, tickets
from corpuslab.session import scratch_path
from corpuslab.streaming import jobs as J


def feed(s, df, ts, name, make, slices=4):
    """Let a table arrive in event-time order: time slice by time slice is added
    to the stream directory (by as many tasks as it takes), and after each the
    query runs on with its checkpoint until it has drained what is there.
    ``make`` turns the source into the streaming result; returns the sink."""
    path, sink, ckpt = (scratch_path(s, f"stream_{x}_{name}") for x in ("in", "out", "ckpt"))
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    lo, hi = df.agg(F.min(t), F.max(t)).first()
    for i in range(slices):
        here = F.least(F.lit(slices - 1), F.floor((t - lo) * slices / F.lit(max(1, (hi or 0) - (lo or 0)))))
        df.filter(here == i).write.mode("append").parquet(path)
        J.run_to_parquet(make(J.stream_source(s, path, df.schema, max_files=1 << 20)), sink, ckpt)
    return s.read.parquet(sink)


ADMITTED = 256 << 20  # bytes of files that a batch takes on: batches and their tasks follow the input


def incoming(s, d):
    """The tickets as a stream over the documents as they lie there, admitted by
    bytes; labels are a static side."""
    schema = s.read.parquet(f"{d}/documents.parquet").schema
    # a pattern, since the table may be one file: as a plain path that would have to be a folder
    return tickets(s, d, J.stream_source(s, f"{d}/documents.parque[t]", schema, max_bytes=ADMITTED))


def score_stream(s, d, source, sink, checkpoint):
    """Naive Bayes labels of a stream of tickets (title, description), written batch by batch."""
    v = QT.corpus_vectorizer(s, d)
    model = QT.nb_model(s, d, "category_level_1")

    def score(batch):
        b = batch.select(F.col("ticket_id").alias("doc"), X.normalize_text(X.compose_text(F.col("title"), F.col("description"))).alias("text"))
        return TR.predict_naive_bayes(v.known(b, QT.WORDS, ["doc"]), model, ["doc"], T.StringType(), scale=v.scale)
    J.stream_score(source, score, sink, checkpoint).awaitTermination()
    return s.read.parquet(sink).select("doc", "pred")


def _score(s, d):
    return score_stream(s, d, incoming(s, d).select("ticket_id", "title", "description"), scratch_path(s, "stream_scores"), scratch_path(s, "ckpt_score"))


def _known(s, d):
    t = tickets(s, d)
    dim = t.filter(F.substring("category_level_2", 4, 10).cast("int") < 15).select("category_level_1").distinct() \
        .filter(F.col("category_level_1") != "de")
    out = J.stream_filter(incoming(s, d).select("ticket_id", "category_level_1", "category_level_2"), dim, ["category_level_1"])
    sink = scratch_path(s, "stream_known")
    J.run_to_parquet(out, sink, scratch_path(s, "ckpt_known"))
    return s.read.parquet(sink)


def _counts(s, d):
    ev = table(s, d, "events").select("event_id", "ts", "event_type")
    return feed(s, ev, "ts", "counts", lambda src: J.stream_counts(src, "ts", ["event_type"], "1 day", "1 day"))


FIRST_ARRIVAL = 1704067200  # 2024-01-01 UTC


def arriving_tickets(s, d):
    """Tickets with an arrival time, one a minute in order of their ids, and the
    key of their text."""
    t = tickets(s, d).select("ticket_id", X.compose_text(F.col("title"), F.col("description")).alias("text"))
    return t.select("ticket_id", F.sha2("text", 256).alias("text_key"), F.timestamp_seconds(F.col("ticket_id") * 60 + FIRST_ARRIVAL).alias("ts"))


def _dedup(s, d):
    """Repeated ticket texts within an hour of each other are dropped."""
    return feed(s, arriving_tickets(s, d), "ts", "dedup", lambda src: J.stream_dedup(src, "ts", ["text_key"], "1 hour"))


QUERIES = {
    "stream_score": _score,
    "stream_known_labels": _known,
    "stream_class_counts": _counts,
    "stream_dedup": _dedup,
}
SQL: dict[str, str] = {
    "stream_score": QT.nb_sql("category_level_1", "'train', 'val', 'test'") + "SELECT doc, pred FROM nbp",
    # windows that the watermark (latest event less a day) has closed
    "stream_class_counts": """SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, event_type, count(*) AS n
FROM (SELECT date_trunc('day', ts) AS window_start, event_type FROM events)
GROUP BY ALL HAVING window_start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""",
    "stream_known_labels": V.with_(V.TICKETS) + """SELECT ticket_id, category_level_1, category_level_2 FROM tickets
WHERE category_level_1 IN (SELECT DISTINCT category_level_1 FROM tickets
  WHERE CAST(substr(category_level_2, 4, 10) AS INTEGER) < 15 AND category_level_1 <> 'de')""",
}
