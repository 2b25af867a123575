"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Every match of the pre-tokenisation pattern is encoded separately, without special tokens, so a text may be cut
wherever a match must end whatever surrounds it. Long texts are cut at such boundaries, and a single match that is
itself very long (a run of one character class) is handed to the merge loop directly. The regular expression engine
therefore never sees more than a bounded piece, and the ids are those of the whole text.

Nulls, empty and repeated rows: a null text encodes as the empty text (no ids); rows are independent of each other,
so ties and repeats have no effect; an empty table gives an empty table; other columns pass through, and an input
column with an output's name is replaced.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.llm.common import values

#: Texts of more characters than this are cut.
PIECE_CHARS = 1 << 16

#: A place where a match must end and another begin: plain white space after something else.
_BEFORE_SPACE = re.compile(r"(?<=\S)(?=[ \t\n\r])")


@functools.cache
def encoder(ranks_path: str, pattern: str):
    """One encoder per Python worker."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(ranks_path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, pattern, size: int = PIECE_CHARS) -> Iterator[tuple[str, bool]]:
    """Yield (piece, is_one_match) in order; the pieces join up to the text."""
    start, end = 0, len(text)
    while end - start > size:
        cut = _BEFORE_SPACE.search(text, start + size // 2, start + size)
        if cut:
            yield text[start : cut.start()], False
            start = cut.start()
            continue
        # no safe boundary nearby: step match by match, which is what the boundaries stand for
        stop = start + size
        while start < min(stop, end):
            match = pattern.match(text, start)
            if match is None:  # cannot happen with a total pattern; one character keeps progress
                yield text[start : start + 1], False
                start += 1
                continue
            yield match.group(), True
            start = match.end()
    if start < end:
        yield text[start:], False


def encode_text(text: str, enc, pattern) -> list[int]:
    if len(text) <= PIECE_CHARS:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for piece, single in pieces(text, pattern):
        if single:
            ids += enc._encode_single_piece(piece)
        else:
            ids += enc.encode_ordinary(piece)
    return ids


def _with(schema: T.StructType, *fields: T.StructField) -> tuple[list[str], T.StructType]:
    new = {f.name.lower() for f in fields}
    kept = [f for f in schema.fields if f.name.lower() not in new]
    return [f.name for f in kept], T.StructType([*kept, *fields])


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """Add the array of token ids of each whole text."""
    names, schema = _with(docs.schema, T.StructField(out, T.ArrayType(T.IntegerType(), False), False))
    source = "__bpe_text"

    def run(batches):
        import regex

        enc, pat = encoder(ranks_path, pattern), regex.compile(pattern)
        for batch in batches:
            ids = [encode_text(t or "", enc, pat) for t in values(batch.column(source))]
            columns = [batch.column(n) for n in names] + [pa.array(ids, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, out])

    return docs.select(*(F.col(f"`{n}`") for n in names), F.col(text).cast("string").alias(source)).mapInArrow(run, schema)


def decode(docs: DataFrame, ranks_path: str, pattern: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Add the raw bytes that the ids stand for; ids need not end at a character boundary. Null ids give null."""
    names, schema = _with(docs.schema, T.StructField(out, T.BinaryType(), True))
    source = "__bpe_ids"

    def run(batches):
        enc = encoder(ranks_path, pattern)
        for batch in batches:
            raw = [None if i is None else enc.decode_bytes(i) for i in values(batch.column(source))]
            columns = [batch.column(n) for n in names] + [pa.array(raw, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, out])

    return docs.select(*(F.col(f"`{n}`") for n in names), F.col(ids).alias(source)).mapInArrow(run, schema)


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text: what encode() and decode() do, in one pass that leaves the ids in the worker."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches):
        import hashlib

        import regex

        enc, pat = encoder(ranks_path, pattern), regex.compile(pattern)
        decimal = [str(i) for i in range(enc.n_vocab)]
        for batch in batches:
            lengths, of_ids, of_bytes = [], [], []
            for text in values(batch.column(1)):
                ids = encode_text(text or "", enc, pat)
                lengths.append(len(ids))
                of_ids.append(hashlib.sha256(" ".join([decimal[i] for i in ids]).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], names=schema.names)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
