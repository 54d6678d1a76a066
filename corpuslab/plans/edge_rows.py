"""Literal edge rows of FIXTURES.md §3, unioned into the normaliser queries.
They ride along with the whole ``tickets`` table, never alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed edge texts (id, text); ids are negative so they never meet a doc_id.
EDGE_TEXTS = [
    (-1, "يَا جَمَاعَة السِّيسْتِم واقِع"),
    (-2, "الـ VPN بيفصل كل شوية وبيظهر Timeout"),
    (-3, "أ إ آ ٱ"),
    (-4, "ة"),
    (-5, "\u0648\u0654"),
    (-6, "\tA\u00a0B\u2003C\u001cD  "),
    (-7, None),
    (-8, ""),
    (-9, "   "),
]


def edge_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EDGE_TEXTS, "ticket_id long, title string") \
        .withColumn("description", F.lit(None).cast("string"))


def edge_sql() -> str:
    def lit(s):
        if s is None:
            return "NULL"
        out = []
        for ch in s:
            if ch == "'":
                out.append("''")
            elif ord(ch) < 32 or ord(ch) in (0xA0, 0x2003, 0x0654):
                out.append(f"' || chr({ord(ch)}) || '")
            else:
                out.append(ch)
        return "'" + "".join(out) + "'"
    rows = " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS ticket_id, CAST({lit(t)} AS VARCHAR) AS title, "
                              f"CAST(NULL AS VARCHAR) AS description" for i, t in EDGE_TEXTS)
    return f"edges AS ({rows})"
