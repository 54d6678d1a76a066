"""String column expressions: the normaliser steps, tokens and formatting.

All of these are built-in Spark expressions (codegen'd, JVM-side) except NFC,
which Spark lacks; see ``nfc``.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference normaliser (stated as text).
# Arabic diacritic ranges removed by the normaliser:
#   U+0610-U+061A, U+064B-U+065F, U+0670, U+06D6-U+06DC, U+06DF-U+06E4,
#   U+06E7, U+06E8, U+06EA-U+06ED
DIACRITICS_CLASS = (r"[\x{0610}-\x{061A}\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06DC}"
                    r"\x{06DF}-\x{06E4}\x{06E7}\x{06E8}\x{06EA}-\x{06ED}]")
# Alef variants (hamza above, hamza below, madda, wasla) -> bare alef.
ALEF_FROM, ALEF_TO = "أإآٱ", "اااا"
# Teh marbuta -> heh.
TEH_FROM, TEH_TO = "ة", "ه"
# ---------------------------------------------------------------------------

# Python's str.isspace() set spelled out (Java and RE2 both accept \x{..}).
WHITESPACE_RUN = (r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}"
                  r"\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+")
# The same run in a text without a character from U+0300 on: single characters, which
# Java looks up in one table (ranges it tries one after another).
LATIN_WHITESPACE_RUN = r"[\t\n\x0B\f\r\x1C\x1D\x1E\x1F \x85\xA0]+"
UPPER_ASCII = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER_ASCII = "abcdefghijklmnopqrstuvwxyz"
# Python \w (letters, numbers, underscore); two or more make a token.
WORD_TOKEN = r"[\p{L}\p{N}_]{2,}"


@dataclass(frozen=True)
class NormalizeParams:
    nfc: bool = True
    remove_diacritics: bool = True
    normalize_alef: bool = True
    normalize_teh_marbuta: bool = False
    lowercase_latin: bool = True


@F.pandas_udf(T.StringType())
def _nfc_udf(s: pd.Series) -> pd.Series:
    import unicodedata
    return s.map(lambda x: unicodedata.normalize("NFC", x) if isinstance(x, str) else x)


def _beyond_latin(c: Column) -> Column:
    """Texts with a character from U+0300 on, where the combining marks begin; null for
    others, which are in NFC and hold nothing that the Arabic steps change."""
    return F.when(c.rlike("[^\\x00-\\u02FF]"), c)


def nfc(c: Column) -> Column:
    """Unicode NFC; Arrow-batched. A text that is in NFC already, by ``_beyond_latin``,
    is not sent to the Python worker."""
    return F.coalesce(_nfc_udf(_beyond_latin(c)), c)


def null_guard(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def strip_diacritics(c: Column) -> Column:
    return F.regexp_replace(c, DIACRITICS_CLASS, "")


def alef(c: Column) -> Column:
    return F.translate(c, ALEF_FROM, ALEF_TO)


def teh_marbuta(c: Column) -> Column:
    return F.translate(c, TEH_FROM, TEH_TO)


def lower_latin(c: Column) -> Column:
    return F.translate(c, UPPER_ASCII, LOWER_ASCII)


def collapse_ws(c: Column) -> Column:
    plain = _beyond_latin(c).isNull()
    return F.trim(F.when(plain, F.regexp_replace(c, LATIN_WHITESPACE_RUN, " ")).otherwise(F.regexp_replace(c, WHITESPACE_RUN, " ")))


def normalize_text(c: Column, p: NormalizeParams = NormalizeParams()) -> Column:
    """All normaliser steps fused into one expression, in the reference order."""
    guarded = null_guard(c)
    x = _beyond_latin(guarded)  # the first steps leave other texts as they are
    if p.nfc:
        x = _nfc_udf(x)
    if p.remove_diacritics:
        x = strip_diacritics(x)
    if p.normalize_alef:
        x = alef(x)
    if p.normalize_teh_marbuta:
        x = teh_marbuta(x)
    x = F.coalesce(x, guarded)
    if p.lowercase_latin:
        x = lower_latin(x)
    return collapse_ws(x)


def compose_text(title: Column, description: Column) -> Column:
    """trim(title || ' ' || description) with nulls as empty strings."""
    return F.trim(F.concat(null_guard(title), F.lit(" "), null_guard(description)))


def excerpt(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def word_tokens(c: Column) -> Column:
    """Lower-cased tokens of >= 2 word characters (array<string>)."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD_TOKEN), 0)


def word_ngrams(tokens: Column, lo: int = 1, hi: int = 2) -> Column:
    """All n-grams lo..hi of a token array, joined by a space (array<string>)."""
    parts = []
    n_tok = F.size(tokens)

    def gram(n):  # binds n; a lambda with a defaulted 2nd arg would be read as (x, index)
        return lambda i: F.array_join(F.slice(tokens, i + 1, n), " ")

    for n in range(lo, hi + 1):
        parts.append(F.when(n_tok >= n, F.transform(F.sequence(F.lit(0), n_tok - n), gram(n)))
                     .otherwise(F.array().cast("array<string>")))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def ws_words(c: Column) -> Column:
    """Words split on Unicode whitespace, empties removed (Python str.split())."""
    words = F.when(_beyond_latin(c).isNull(), F.split(c, LATIN_WHITESPACE_RUN)).otherwise(F.split(c, WHITESPACE_RUN))
    return F.filter(words, lambda w: w != "")


def char_wb_ngrams(c: Column, lo: int, hi: int) -> Column:
    """Character n-grams inside space-padded words; a padded word shorter than
    ``lo`` is one gram. Input is lower-cased first (array<string>)."""
    words = F.transform(ws_words(F.lower(c)), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def sub(w, n):
        return lambda i: F.substring(w, i, n)

    def grams(w):
        L = F.length(w)
        per_n = []
        for n in range(lo, hi + 1):
            per_n.append(F.when(L >= n, F.transform(F.sequence(F.lit(1), L - n + 1), sub(w, n)))
                         .otherwise(F.array().cast("array<string>")))
        short = F.when(L < lo, F.array(w)).otherwise(F.array().cast("array<string>"))
        return F.concat(short, *per_n)

    return F.flatten(F.transform(words, grams))


def word_count(c: Column) -> Column:
    return F.size(ws_words(F.coalesce(c, F.lit(""))))


def model_slug(model_id: Column) -> Column:
    """Short family slug from a model id such as ``org/name-v2``: known
    families by substring of the last path part, else that part with ``-``
    replaced by ``_``."""
    base = F.lower(F.element_at(F.split(model_id, "/"), -1))
    return (F.when(base.contains("marbert"), F.lit("marbert"))
            .when(base.contains("arabert"), F.lit("arabert"))
            .when(base.contains("egybert"), F.lit("egybert"))
            .when(base.contains("byt5"), F.lit("byt5"))
            .otherwise(F.replace(base, F.lit("-"), F.lit("_"))))


def is_byte_level(model_id: Column) -> Column:
    """T5-family (byte-level) encoders, matched case-insensitively."""
    return model_id.rlike("(?i)t5")


def fmt_mean_std(mean: Column, std: Column) -> Column:
    return F.when(mean.isNull(), F.lit("—")).otherwise(
        F.format_string("%.2f ± %.2f", mean, F.coalesce(std, F.lit(0.0))))
