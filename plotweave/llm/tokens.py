"""Encoding of whole texts with a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..common import spread

#: Default place of the rank file; a parameter everywhere.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the vocabulary's pre-splitting pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters after which a long text is cut at the next safe boundary.
PIECE = 50_000
_BOUNDARY = re.compile(r"(?<=\w)(?=[ \n])")


@lru_cache(maxsize=4)
def encoding(path: str = RANKS):
    """The vocabulary, loaded once in each Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE) -> list[str]:
    """Parts of a text that encode apart as they do together.

    No match of the pattern runs from a letter or digit into a blank, and none
    looks back, so a text may be cut wherever a blank follows a word.
    """
    out, at = [], 0
    while len(text) - at > size:
        m = _BOUNDARY.search(text, at + size)
        if m is None:
            break
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


def encode_text(text: str | None, path: str = RANKS) -> list[int]:
    """Ids of one text; none for an empty or null one."""
    if not text:
        return []
    enc = encoding(path)
    return [i for p in pieces(text) for i in enc.encode_ordinary(p)]


def encode_corpus(docs: DataFrame, path: str = RANKS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids ARRAY<INT>`` of every row; texts that spell special tokens are ordinary text.

    Rows are spread round-robin before the encoding, which is all the cost;
    repeated rows stay repeated.
    """
    kind = docs.schema[key].dataType

    def run(batches):
        for b in batches:
            ids = [encode_text(t, path) for t in b.column(1).to_pylist()]
            off = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            flat = np.fromiter((x for i in ids for x in i), dtype=np.int32, count=int(off[-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(off), pa.array(flat))], names=[key, "ids"])

    schema = T.StructType([T.StructField(key, kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return spread(docs.select(key, text)).mapInArrow(run, schema)


def decode_corpus(encoded: DataFrame, path: str = RANKS, key: str = "doc_id") -> DataFrame:
    """``key, text`` from ids, through raw bytes; a null list gives a null text."""

    @F.arrow_udf(T.StringType())
    def decode(ids: pa.Array) -> pa.Array:
        enc = encoding(path)
        return pa.array([None if x is None else enc.decode_bytes(x).decode("utf-8", errors="replace") for x in ids.to_pylist()], pa.string())

    return encoded.select(key, decode("ids").alias("text"))


def token_counts(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """``source, lang, n_docs, n_tokens`` of the whole corpus."""
    ids = encode_corpus(docs.select("doc_id", "text"), path).select("doc_id", F.size("ids").alias("n"))
    return docs.select("doc_id", "source", "lang").join(ids, "doc_id").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").cast("long").alias("n_tokens"))
