"""Byte-level BPE encoding and decoding with the tiktoken library.

The rank file is read through Spark's file reader once and sent to the workers, as executors need not
see the driver's folders; its size is that of a vocabulary and does not grow with the data.

Defined results: a NULL text encodes as the empty text, to no ids; NULL ids decode to no bytes. Special
tokens are ordinary text. Repeated rows give repeated results, an empty table an empty one, and other
columns are carried unless an output has their name, which then replaces them.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from quillmart.llm.common import quoted, slices

#: Texts longer than this many characters are split before they reach the tokenizer.
LONG_TEXT = 1 << 15

#: Between a letter, digit or underscore and white space every match of the pattern ends: white space
#: stands only at the start of a match, or in matches of white space alone.
SAFE_BOUNDARY = re.compile(r"(?<=\w)(?=[ \t\r\n])")


def read_ranks(path: str) -> bytes:
    """The rank file as it is: a vocabulary of a few MB at most."""
    with open(path, "rb") as f:
        return f.read()


def encoding(ranks: bytes, pattern: str):
    """The tokenizer, built once per task."""
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def pieces(text: str, longest: int = LONG_TEXT) -> Iterator[str]:
    """A text cut at safe boundaries, each piece ending at the first one after ``longest`` characters.

    A run without any safe boundary stays whole.
    """
    start = 0
    while len(text) - start > longest:
        cut = SAFE_BOUNDARY.search(text, start + longest)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def ids_of(text: str | None, enc, longest: int = LONG_TEXT) -> np.ndarray:
    if not text:
        return np.zeros(0, np.int32)
    if len(text) <= longest:
        return enc.encode_to_numpy(text, disallowed_special=()).astype(np.int32)
    parts = [enc.encode_to_numpy(p, disallowed_special=()) for p in pieces(text, longest)]
    return np.concatenate(parts).astype(np.int32)


def encode_documents(
    docs: DataFrame,
    ranks: bytes,
    pattern: str,
    text_col: str = "text",
    ids_col: str = "ids",
    decoded_col: str = "decoded",
) -> DataFrame:
    """``docs`` with the ids of every whole text, ``array<int>``, and the bytes they decode to.

    A task holds the ids of about a megabyte of text at a time.
    """
    kept = [c for c in docs.columns if c not in (ids_col, decoded_col)]
    rows = docs.select(*(quoted(c).alias(f"c{i}") for i, c in enumerate(kept)), quoted(text_col).alias("text"))
    added = [StructField("ids", ArrayType(IntegerType())), StructField("decoded", BinaryType())]
    schema = StructType([*rows.schema.fields[:-1], *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks, pattern)
        for batch in batches:
            for part in slices(batch, len(kept)):
                ids = [ids_of(t, enc) for t in part.column(len(kept)).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], id_lists(ids), pa.array([decoded(x, enc) for x in ids], pa.binary())],
                    names=schema.names,
                )

    return rows.mapInArrow(run, schema).toDF(*kept, ids_col, decoded_col)


def id_lists(ids: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids), pa.int32()))


def decoded(ids: np.ndarray, enc) -> bytes:
    return enc.decode_bytes(ids.tolist())


def decode_documents(
    coded: DataFrame, ranks: bytes, pattern: str, ids_col: str = "ids", decoded_col: str = "decoded"
) -> DataFrame:
    """``coded`` with the raw bytes of its ids; they need not be valid UTF-8."""
    kept = [c for c in coded.columns if c != decoded_col]
    rows = coded.select(*(quoted(c).alias(f"c{i}") for i, c in enumerate(kept)), quoted(ids_col).alias("ids"))
    schema = StructType([*rows.schema.fields[:-1], StructField("decoded", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks, pattern)
        for batch in batches:
            out = [decoded(np.array(x or [], np.int64), enc) for x in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.binary())], names=schema.names)

    return rows.mapInArrow(run, schema).toDF(*kept, decoded_col)


def digests(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: number of ids, digest of the ids and digest of the decoded bytes."""
    coded = encode_documents(docs.select(id_col, quoted(text_col).alias("text")), ranks, pattern)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
