"""Reproducible shuffle into shards: a Feistel permutation over global row numbers.

Rows get their number in the order of their identity, text digest and size, whatever files they come from. A keyed Feistel
network permutes the numbers: a number is a pair of digits in base a and b, a * b being little more than the count of rows,
and each round adds a mixed function of one digit to the other, which can be undone. A result beyond the last row is
permuted again until it falls within (cycle walking), so the numbers 0 to n-1 are permuted among themselves. The place is
the permuted number: its remainder by the shard count is the shard, its quotient the slot, so shards differ by one row at most,
slots have no gap, and from n, the seed and the shard count anyone computes where row i is (`place`), and which row is in a
slot (`row_at`), without a table.

Only the identity, size and digests of a row move, never its text: numbering deals rows out by ranges, and placing is
a map. Equal texts are rows like others: the law is on counts, so a group of copies that is a third of all rows is
spread evenly as well. Nulls: a null text has size 1 and the checksum of the empty text; null identities are numbered first.
Rows equal in identity and text are interchangeable. An empty table stays empty. Long texts are only measured and digested.
Other columns aren't read by places(), and pass through write_shards().
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import scratch
from gneiss.llm.numbering import numbered, tied

ROUNDS = 6
SEED = 20_240_229
SHARDS = 8

_MASK = np.uint64(0xFFFFFFFF)


def _mixed(digit: np.ndarray, salt: int) -> np.ndarray:
    """32 mixed bits of each digit and a salt."""
    x = ((digit & _MASK) ^ (digit >> np.uint64(32)) ^ np.uint64(salt)) & _MASK
    for by in (0x85EBCA6B, 0xC2B2AE35):
        x = ((x ^ (x >> np.uint64(15))) * np.uint64(by)) & _MASK
    return x ^ (x >> np.uint64(16))


def _salts(seed: int) -> list[int]:
    return [(seed + 0x9E3779B9 * (r + 1)) & 0xFFFFFFFF for r in range(ROUNDS)]


def bases(n: int) -> tuple[int, int]:
    """a and b with a * b >= n, and less than a beyond it."""
    a = math.isqrt(max(n, 1) - 1) + 1
    return a, -(-max(n, 1) // a)


def _once(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    a, b = map(np.uint64, bases(n))
    left, right = x // b, x % b
    for r, salt in enumerate(_salts(seed)):
        if r % 2 == 0:
            left = (left + _mixed(right, salt)) % a
        else:
            right = (right + _mixed(left, salt)) % b
    return left * b + right


def _back(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    a, b = map(np.uint64, bases(n))
    left, right = x // b, x % b
    for r, salt in reversed(list(enumerate(_salts(seed)))):
        if r % 2 == 0:
            left = (left + a - _mixed(right, salt) % a) % a
        else:
            right = (right + b - _mixed(left, salt) % b) % b
    return left * b + right


def _walked(step, x: np.ndarray, n: int, seed: int) -> np.ndarray:
    x = step(np.asarray(x, np.uint64), n, seed)
    while (out := np.flatnonzero(x >= n)).size:
        x[out] = step(x[out], n, seed)
    return x


def permuted(rows: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """Where each of the row numbers 0 to n-1 goes among them."""
    return _walked(_once, rows, n, seed)


def place(row: int, n: int, shards: int = SHARDS, seed: int = SEED) -> tuple[int, int]:
    """Shard and slot of one row."""
    at = int(permuted(np.array([row]), n, seed)[0])
    return at % shards, at // shards


def row_at(shard: int, slot: int, n: int, shards: int = SHARDS, seed: int = SEED) -> int:
    """The row number in a slot of a shard."""
    at = slot * shards + shard
    if not (0 <= shard < shards and 0 <= slot and at < n):
        raise ValueError(f"no slot {slot} in shard {shard}")
    return int(_walked(_back, np.array([at]), n, seed)[0])


def size(text: Column) -> Column:
    """UTF-8 bytes (null: none) plus 1."""
    return (F.coalesce(F.octet_length(text.cast("string")), F.lit(0)) + 1).cast("long")


def places(docs: DataFrame, shards: int = SHARDS, identity: str = "doc_id", text: str = "text", seed: int = SEED, paths: list[str] | None = None) -> DataFrame:
    """id (the identity), row, size, text_crc32, text_sha256, shard and slot of every row."""
    if shards < 1:
        raise ValueError("at least one shard")
    paths = [] if paths is None else paths
    own = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.lit(0).alias("key"), F.col(f"`{identity}`").alias("id"), size(F.col(f"`{text}`")).alias("size"), F.crc32(own).alias("text_crc32"), F.sha2(own, 256).alias("text_sha256"))
    rows = numbered(scratch(tied(rows), "rows", paths), "key", ["id", "text_sha256", "size"], paths)
    rows = rows.select("id", F.col("__at").alias("row"), "size", "text_crc32", "text_sha256", F.col("__of").alias("n"))

    def run(batches):
        for batch in batches:
            n = batch.column("n")[0].as_py() if batch.num_rows else 0
            at = permuted(batch.column("row").to_numpy(zero_copy_only=False), n, seed) if n else np.empty(0, np.uint64)
            shard, slot = (at % np.uint64(shards)).astype(np.int32), (at // np.uint64(shards)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(shard), pa.array(slot)], names=[*batch.schema.names[:-1], "shard", "slot"])

    schema = rows.drop("n").schema.add("shard", "integer").add("slot", "long")
    return rows.mapInArrow(run, schema)


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS, identity: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """Write docs, with shard and slot, as Parquet under folder/shard=k, each file sorted by slot; the count and bytes of each shard are returned.

    A shard may be several files, each a range of its slots, so that no task holds more than a range. The identity has to be
    unique and not null, for a row finds its place by it: else nothing is written and an error is raised.
    """
    clash = {"shard", "slot"} & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"columns in the way: {sorted(clash)}")
    at = scratch(places(docs, shards, identity, text, seed), "places")
    if at.groupBy("id").count().filter("count > 1 OR id IS NULL").limit(1).count():
        raise ValueError(f"{identity} is not unique")
    at = at.withColumnRenamed("id", "__id").select("__id", "shard", "slot")
    both = docs.join(at, F.col(f"`{identity}`") == F.col("__id")).drop("__id")
    both.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
    written = docs.sparkSession.read.parquet(folder)
    return written.groupBy("shard").agg(F.count("*").alias("rows"), F.max("slot").alias("last_slot"), F.sum(size(F.col(f"`{text}`"))).alias("bytes"))


def sharded(docs: DataFrame) -> DataFrame:
    """Every row of documents in one of SHARDS shards by the law `rows`: counts are at most one apart."""
    out = places(docs)
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
