"""A deterministic sharded WARC writer, and its reader.

Pages are dealt into shards by ranges of page_id that an exact histogram of bytes sets (no sampling): ranges of ids are split
again and again where they are crowded, so that outliers and dense stretches alike give shards of about SHARD bytes (more
where there would be over RANGES shards). Rows without an id, and those of one id that alone are too many, are dealt further by
payload digest. Shards are sorted by id, digest and url, and written as one gzip member a record, without times or host names,
into files that roll at ROLL compressed bytes. Headers and digests are made anew. A task writes under a temporary name and
renames; a task that runs again writes the same bytes to the same name. The manifest, written last and also renamed, lists the
files; only files in it are read, and temporary files that failed tasks left are deleted once it is there.

Records of equal payload: the first by page_id is the response, the others revisit it. The first of each payload is
found by partial aggregation, so a payload in a third of all rows is reduced where it is read; ids, digests and sizes are
written as a table of their own, so that payloads are read twice and move once, to their shard.

The folder may be in any store that both pyarrow.fs and Spark know by its URI; files are renamed one by one, which object
stores do by copying.

Nulls, empty and repeated rows: a null html is an empty payload, itself a payload like any other; a null url is left
out of the header; rows with a null page_id sort last and are the response only if no row with an id has that payload;
of repeated rows with one id and payload the first is the response and the others revisit that id; an empty table
gives a manifest of no files and no records; other columns are ignored. Rows that are equal in id and payload stay in one shard.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as store
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm.common import discard, scratch, values

#: Compressed bytes after which a file is closed.
ROLL = 64 << 20
#: Payload bytes aimed at for a shard.
SHARD = 16 << 20
#: Most ranges of page_id that a pass of the histogram counts, and shards.
RANGES = 65_536
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
COLUMNS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string"
_MANIFEST = "shard long, file string, records long, bytes long, sha256 string"


def _base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _safe(url: str) -> str:
    return "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page_id: int | None, again: int, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One uncompressed record. again: how many records before had this page_id and payload."""
    digest = _base32(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:x-page:{'none' if page_id is None else page_id}:{digest}:{again}>"), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", _safe(url)))
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{_base32(block)}")]
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:x-page:{'none' if refers_to is None else refers_to}:{digest}:0>")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or f"sha1:{_base32(block)}" != fields["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    return fields, block


class _File:
    """A file under a temporary name until it is closed."""

    def __init__(self, fs, folder: str, shard: int, part: int):
        self.fs, self.folder, self.shard = fs, folder, shard
        self.name = f"shard-{shard:08d}-{part:05d}.warc.gz"
        self.temporary = f"{folder}/.{self.name}.{uuid.uuid4().hex}"
        self.stream, self.digest, self.records, self.bytes = fs.open_output_stream(self.temporary, compression=None), hashlib.sha256(), 0, 0

    def write(self, raw: bytes) -> None:
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        packed = packer.compress(raw) + packer.flush()
        self.stream.write(packed)
        self.digest.update(packed)
        self.records, self.bytes = self.records + 1, self.bytes + len(packed)

    def close(self) -> tuple:
        self.stream.close()
        name = f"{self.folder}/{self.name}"
        try:
            self.fs.move(self.temporary, name)
        except OSError:  # some stores don't move onto a file, here one of the same bytes
            self.fs.delete_file(name)
            self.fs.move(self.temporary, name)
        return self.shard, self.name, self.records, self.bytes, self.digest.hexdigest()


def _store(folder: str):
    return store.FileSystem.from_uri(folder)


@dataclass(frozen=True)
class Deal:
    """Segments of ids by the first ids of all but the first, then one of no id; the first shard of each and their number."""

    bounds: list[int]
    first: list[int]
    parts: list[int]

    @property
    def shards(self) -> int:
        return self.first[-1] + self.parts[-1]


def _longs(values: list[int]) -> Column:
    """A literal array, which would be a call for each value otherwise."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")


def _search(value: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are no larger than value, by binary search."""
    if not bounds:
        return F.lit(0).cast("long")
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    return F.aggregate(_longs(steps), F.lit(0).cast("long"), lambda n, s: F.when(F.get(_longs(bounds), (n + s - 1).cast("int")) <= value, n + s).otherwise(n))


def _counted(sizes: DataFrame, ranges: list[tuple[int, int]], width: list[int]) -> list[tuple[int, int, int]]:
    """(start, end, bytes) of every part of disjoint ascending ranges, parts being of so many ids, that holds a row."""
    inside = sizes.filter("page_id is not null").withColumn("r", (_search(F.col("page_id"), [a for a, _ in ranges]) - 1).cast("int")).filter("r >= 0")
    inside = inside.filter(F.col("page_id") <= F.get(_longs([b for _, b in ranges]), F.col("r")))
    off = F.col("page_id") - F.get(_longs([a for a, _ in ranges]), F.col("r"))
    found = inside.groupBy("r", (off - F.pmod(off, F.get(_longs(width), F.col("r")))).alias("off")).agg(F.sum("bytes").alias("bytes")).collect()  # at most about RANGES rows
    start = lambda x: ranges[x["r"]][0] + x["off"]
    return [(start(x), min(ranges[x["r"]][1], start(x) + width[x["r"]] - 1), x["bytes"]) for x in found]


def deal(sizes: DataFrame, size: int = SHARD) -> Deal:
    """The segments and shards for rows of (page_id, bytes)."""
    total = sizes.agg(F.min("page_id").alias("low"), F.max("page_id").alias("high"), F.sum("bytes").alias("bytes"), F.sum(F.when(F.col("page_id").isNull(), F.col("bytes"))).alias("none")).first()
    size = max(size, (total["bytes"] or 0) // RANGES + 1)
    pieces = lambda n: max(1, -(-n // size))
    bounds, parts, held, alone = [], [1], 0, False
    if total["low"] is not None:
        low, end = total["low"], total["high"] + 1
        cuts = [low, *(c for c in (-(1 << 62), 0, 1 << 62) if low < c < end), end]  # no difference beyond a long
        todo, fine = [(a, b - 1) for a, b in zip(cuts, cuts[1:], strict=False)], []
        while todo:
            each = max(2, RANGES // len(todo))
            found = sorted(_counted(sizes, todo, [-(-(b - a + 1) // each) for a, b in todo]))
            fine += [x for x in found if x[2] <= size or x[0] == x[1]]
            todo = [(a, b) for a, b, n in found if n > size and a < b]
        for a, b, n in sorted(fine):
            hot = a == b and n > 2 * size
            if held and (alone or hot or held + n > size):
                bounds.append(a)
                parts.append(1)
                held = 0
            held, alone = held + n, hot
            if hot:
                parts[-1] = pieces(n)
    parts.append(pieces(total["none"] or 0))
    return Deal(bounds, list(itertools.accumulate(parts, initial=0))[:-1], parts)


def write_archives(pages: DataFrame, folder: str, roll: int = ROLL, shard: int = SHARD) -> str:
    """Write one record a row into folder; return the path of the manifest."""
    spark = pages.sparkSession
    folder = folder.rstrip("/")
    fs, base = _store(folder)
    fs.create_dir(base, recursive=True)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    sha, paths = F.sha1(F.col("html").cast("binary")).alias("__sha"), []
    light = scratch(rows.select("page_id", sha, (F.octet_length("html") + 512).cast("long").alias("bytes")), "light", paths)
    plan = deal(light, shard)
    first = light.groupBy("__sha").agg(F.min("page_id").alias("__first"), F.count("*").alias("__n")).filter("__n > 1").drop("__n")
    # copies are found without their payloads, and each is announced to the writer by a row that sorts just before it
    marks = light.join(first, "__sha").select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "__sha", "__first")
    none = rows.select("*", F.lit(None).cast("string").alias("__sha"), F.lit(None).cast("long").alias("__first"))
    dealt = _with_shard(none.unionByName(marks), F.coalesce("__sha", sha), plan).repartitionById(plan.shards, F.col("__shard").cast("int"))
    order = ["__shard", F.col("page_id").asc_nulls_last(), F.coalesce("__sha", sha), F.col("__sha").isNull(), "url"]
    dealt = dealt.sortWithinPartitions(*order).select("__shard", "page_id", "url", "html", "__sha", "__first")

    def write(batches):
        fs, base = _store(folder)
        file, shard, part, last, again, mark, seen = None, None, 0, ..., 0, None, False
        done = []
        for batch in batches:
            for at, page_id, url, html, sha, first_id in zip(*map(values, batch.columns), strict=True):
                if sha is not None:
                    mark, seen = (page_id, sha, first_id), False
                    continue
                if file is not None and (at != shard or file.bytes >= roll):
                    done.append(file.close())
                    part, file = (part + 1 if at == shard else 0), None
                if at != shard:
                    shard, part = at, 0
                if file is None:
                    file = _File(fs, base, shard, part)
                payload = html.encode()
                own = (page_id, hashlib.sha1(payload).hexdigest())
                again = again + 1 if own == last else 0
                last = own
                copies = mark is not None and mark[:2] == own
                revisit = copies and (page_id != mark[2] or seen)
                seen = seen or copies
                file.write(record(page_id, again, url, payload, mark[2] if revisit else None, revisit))
        if file is not None:
            done.append(file.close())
        yield pa.RecordBatch.from_pylist([dict(zip(("shard", "file", "records", "bytes", "sha256"), d, strict=True)) for d in done], schema=pa.schema([("shard", pa.int64()), ("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))

    temporary = f"{folder}/.manifest-{uuid.uuid4().hex}"
    dealt.mapInArrow(write, _MANIFEST).write.json(temporary)
    path = spark._jvm.org.apache.hadoop.fs.Path
    if not path(temporary).getFileSystem(spark._jsc.hadoopConfiguration()).rename(path(temporary), path(f"{folder}/manifest")):
        raise OSError(f"{folder}/manifest could not be made")
    discard(spark, paths)
    for left in fs.get_file_info(store.FileSelector(base)):
        if left.base_name.startswith(".shard-"):
            fs.delete_file(left.path)
    return f"{folder}/manifest"


def _with_shard(rows: DataFrame, sha: Column, plan: Deal) -> DataFrame:
    """Add __shard: of the segment that the id is in, or of the last without one, and there by the digest's first 16 bits."""
    segment = F.when(F.col("page_id").isNull(), len(plan.bounds) + 1).otherwise(_search(F.col("page_id"), plan.bounds))
    out = rows.withColumn("__segment", (segment if len(plan.parts) > 1 else F.lit(0)).cast("int"))
    parts = F.get(_longs(plan.parts), F.col("__segment"))
    prefix = F.when(parts == 1, 0).otherwise(F.conv(F.substring(sha, 1, 4), 16, 10).cast("long"))
    return out.withColumn("__shard", F.get(_longs(plan.first), F.col("__segment")) + F.shiftright(prefix * parts, 16)).drop("__segment")


def _records(fs, path: str) -> Iterator[bytes]:
    with fs.open_input_stream(path, compression=None) as stream:
        member, parts, data = zlib.decompressobj(31), [], b""
        while data := data or stream.read(1 << 20):
            parts.append(member.decompress(data))
            data = member.unused_data
            if member.eof:
                yield b"".join(parts)
                member, parts = zlib.decompressobj(31), []


def read_archives(spark: SparkSession, manifest: str) -> DataFrame:
    """The records of all files that the manifest lists, digests checked."""
    folder = manifest.rsplit("/", 1)[0]
    files = spark.read.schema(_MANIFEST).json(manifest)
    n = max(1, files.count())

    def read(batches):
        fs, base = _store(folder)
        number = lambda x: None if x.split(":")[2] == "none" else int(x.split(":")[2])
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                for raw in _records(fs, f"{base}/{name}"):
                    head, block = parse(raw)
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(http.split(b"Content-Length: ")[1].split(b"\r\n")[0])
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    revisit = head["WARC-Type"] == "revisit"
                    if not revisit and (len(payload) != size or _base32(payload) != digest):
                        raise ValueError(f"damaged payload in {name}")
                    rows.append((number(head["WARC-Record-ID"].strip("<>")), head.get("WARC-Target-URI"), size, digest, head["WARC-Type"], number(head["WARC-Refers-To"].strip("<>")) if revisit else None, name))
                    if len(rows) == 4096:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

    return files.select("file").repartition(n).mapInArrow(read, COLUMNS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    names = [x.split()[0] for x in COLUMNS.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
