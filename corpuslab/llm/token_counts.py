"""Token counts: batch encoding in Arrow functions that return lengths only.

* Batches balanced by bytes: the pieces of a task's texts are handed to the
  tokenizer in batches of about ``BATCH_BYTES`` of text, however many rows that
  is, so neither a heap of tiny texts nor a few long ones makes a large batch.
  Only the lengths of the encodings are read; ids never leave the worker.
* Safe boundaries: a text longer than ``PIECE_BYTES`` is cut where the
  tokenizer's own split always has a boundary, so the pieces' counts add up to
  the text's. For byte-level BPE that is before ASCII white space after a
  printable ASCII character, or between an ASCII letter and an ASCII digit. A
  stretch without such a place stays whole, as do all texts of a tokenizer for
  which the rule is not known to hold (another split, a normaliser, an added
  token with white space, digits or stripping; sentencepiece models).

* Words: where the rule holds, a batch is also cut before every white space, and
  only words that the worker has not met are encoded (it keeps the lengths of at
  most ``CACHE_CHARS`` characters of words, then starts afresh).

``.json`` files are read by tokenizers, ``.model`` files by sentencepiece, without
begin, end or added special tokens; special strings inside a text are treated as
the library does by default. Nothing is truncated or padded.

Nulls: a null text counts as empty (0 bytes, 0 tokens); a null doc_id is
returned as null. Repeated rows are counted each for itself. Very long texts
are counted whole, in pieces. Other columns, whatever their names, are not read.
Bytes that are not UTF-8 count as the replacement character for the tokenizer.
An empty table gives an empty result.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm import textarrays as T

BATCH_BYTES, PIECE_BYTES, LIMIT = 1 << 20, 1 << 16, 1024
#: Two characters between which byte-level BPE always has a boundary.
SAFE = re.compile(r"[!-~][ \t\n\r]|[A-Za-z][0-9]|[0-9][A-Za-z]")
#: White space with the word after it. The cuts are boundaries if all that stands before
#: them is no white space of any kind (these ranges hold none); else only some are taken.
WORD = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
_INK = "!-~\u00a1-\u167f\u2c00-\u2fff\u3001-\ud7ff"
UNSURE = re.compile(f"[^{_INK} \t\n\r][ \t\n\r]")
SURE = re.compile(f"(?<=[{_INK}])(?=[ \t\n\r])")
CACHE_CHARS = 1 << 24
SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint"


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


class Counter:
    """Lengths of a batch of texts; ``splits`` says whether SAFE holds."""

    def __init__(self, path: str):
        self.known: dict[str, int] = {}
        self.chars = 0
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        if path.endswith(".model"):
            import sentencepiece
            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            self.lengths = lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
            self.splits = False
            return
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        self.lengths = lambda texts: [len(x) for x in tok.encode_batch_fast(texts, add_special_tokens=False)]
        self.splits = _splits(tok)


    def totals(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        if not self.splits:
            return self.lengths(texts)
        if self.chars > CACHE_CHARS:
            self.known, self.chars = {}, 0
        cut = [words(t) for t in texts]
        new = list(set().union(*cut).difference(self.known))
        self.known.update(zip(new, self.lengths(new)))
        self.chars += sum(map(len, new))
        return [sum(map(self.known.__getitem__, x)) for x in cut]


def words(text: str) -> list[str]:
    """The text cut before white space, where byte-level BPE has a boundary."""
    return SURE.split(text) if UNSURE.search(text) else WORD.findall(text)


def _splits(tok) -> bool:
    import json
    spec = json.loads(tok.to_str())
    pre = spec.get("pre_tokenizer") or {}
    plain = not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
    return bool(plain) and not any(a["lstrip"] or a["rstrip"] or a["single_word"] or re.search(r"[\s0-9]", a["content"])
                                   for a in spec.get("added_tokens") or [])


def pieces(text: str, limit: int = PIECE_BYTES) -> list[str]:
    """The text cut at safe boundaries, each piece ``limit`` characters or a little
    more (a stretch without a boundary longer)."""
    out, at = [], 0
    while len(text) - at > limit:
        m = SAFE.search(text, at + limit - 1)
        if m is None:
            break
        out.append(text[at:m.start() + 1])
        at = m.start() + 1
    return [*out, text[at:]] if out else [text]


_counters: dict[str, Counter] = {}


def _count(path: str, batch_bytes: int, piece_bytes: int):
    def run(batches):
        counter = _counters.get(path) or _counters.setdefault(path, Counter(path))
        for b in batches:
            text = b.column("text").cast(pa.binary()).fill_null(b"")
            size = np.asarray(pc.binary_length(text), dtype=np.int64)
            total = np.zeros(b.num_rows, np.int64)
            held, owner, weight = [], [], 0

            def flush():
                if held:
                    np.add.at(total, owner, counter.totals(held))

            for row in np.flatnonzero(size).tolist():
                whole = text[row].as_py().decode("utf-8", "replace")
                cut = pieces(whole, piece_bytes) if counter.splits and size[row] > piece_bytes else [whole]
                for p in cut:
                    held.append(p)
                    owner.append(row)
                    weight += len(p) if len(cut) > 1 else int(size[row])
                    if weight >= batch_bytes:
                        flush()
                        held, owner, weight = [], [], 0
            flush()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size), pa.array(total)], names=["doc_id", "n_bytes", "n_tokens"])
    return run


def count_tokens(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT,
                 batch_bytes: int = BATCH_BYTES, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row."""
    d = T.strip_columns(docs, "doc_id", "text")
    out = d.mapInArrow(_count(tokenizer or default_tokenizer(), batch_bytes, piece_bytes), SCHEMA)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
