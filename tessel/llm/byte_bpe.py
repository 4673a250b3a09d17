"""Byte-level BPE encoding and decoding with a local rank file.

The ranks are a parameter.  Each match of the pre-splitting pattern is encoded by itself.  Texts longer than
``SEGMENT`` characters are first cut at safe boundaries: before a single space between two characters that aren't white
space, where the pattern always ends a match; so a long text needs no more memory in the encoder than a segment, and the
ids stay those of the whole text.  A text without such a boundary is encoded in one go.

Nulls: a null text is empty and has no ids; a null identifier is kept.  Repeated rows are encoded each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEGMENT = 1 << 15
BOUNDARY = re.compile(r"(?<=\S) (?=\S)")

_encodings: dict[tuple[str, str], object] = {}


def encoding(path: str, pattern: str):
    """One encoder for each worker and rank file."""
    import tiktoken

    if (path, pattern) not in _encodings:
        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        _encodings[path, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path, pattern]


def segments(text: str, size: int = SEGMENT) -> list[str]:
    """The text in parts of about ``size`` characters; each but the first begins with a space at a safe boundary."""
    out, begin = [], 0
    while len(text) - begin > size:
        found = BOUNDARY.search(text, begin + size)
        if not found:
            break
        out.append(text[begin : found.start()])
        begin = found.start()
    out.append(text[begin:])
    return out


def rank_file(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


ENCODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])


def encode(docs: DataFrame, *, ranks: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False, slice_rows: int = 256) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit); with ``decoded`` also the bytes that the ids give."""
    path, pattern = ranks or rank_file()
    schema = T.StructType([*ENCODED.fields, *([T.StructField("decoded", T.BinaryType())] if decoded else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoding(path, pattern)
        for whole in batches:
            for k in range(0, whole.num_rows, slice_rows):
                batch = whole.slice(k, slice_rows)
                counts, data, back = [], [], []
                for text in batch.column(1).to_pylist():
                    ids: list[int] = []
                    for part in segments(text):
                        ids += own.encode_ordinary(part)
                    counts.append(len(ids))
                    data.append(array("I", ids).tobytes())
                    if decoded:
                        back.append(own.decode_bytes(ids))
                columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(back, pa.binary())] if decoded else []), names=schema.names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, *, ranks: tuple[str, str] | None = None) -> DataFrame:
    """doc_id and the bytes of each row's ids; unlike a text these may end within a character."""
    path, pattern = ranks or rank_file()
    schema = T.StructType([ENCODED.fields[0], T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoding(path, pattern)
        for batch in batches:
            back = [own.decode_bytes(array("I", x)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(back, pa.binary())], names=schema.names)

    return encoded.select("doc_id", F.coalesce(F.col("ids"), F.lit(b"")).alias("ids")).mapInArrow(run, schema)
