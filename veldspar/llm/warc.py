"""WARC archives: a writer with revisit records, and a splittable reader.

Writer: one gzip member a record, so archives can be read from any member on. Of records with equal payloads
of at least MIN_REVISIT bytes, the one with the largest id holds the payload and the others refer to it.
Spark's own text sink commits the files, so a lost or repeated task leaves no half-written archive and any
file system that Spark writes to will do. The sink ends each row with one byte; a gzip member ends with a
zero byte if it holds under 16 MiB, so that byte is left to the sink, and longer records are followed by an
empty member that ends so.

Reader: archives are cut into byte ranges. A task looks for gzip's magic bytes in its range, validates each
candidate by decoding the record's header, however long, and owns the records that begin inside, reading
past the end of its range for the last. After a record it goes on at the member's end. A range that begins
inside a member can meet bytes of its payload that are a record themselves (an archive within an archive).
So the places at which the records of each range begin and end are held against those of the ranges before
it: a range whose first record begins before the last one of an earlier range has ended is read once more
from that end, until no range is left; results of all others stand. Records are decoded in pieces, in time
that grows with their length; without payloads no more than a header is held.

Equal payloads are found through their digests alone. Digests of more than HOT rows, of which there can be no
more than rows / HOT, are looked up without a shuffle, so no digest brings its rows together in one task.

Defined results: a null payload is empty; null ids are written, never preferred over an id, and records of
a payload that has null ids alone all hold it. Rows that repeat the largest id all hold the payload. Empty
tables give an archive without records. Extra columns are ignored. A damaged or cut-off record fails the
read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from veldspar.llm._shared import materialise, scratch_path

#: Payload bytes from which equal payloads are written once.
MIN_REVISIT = 1000
#: Rows of one digest from which it is looked up without a shuffle.
HOT = 100_000
#: Bytes of a range that one task scans.
RANGE = 8 << 20
#: Tasks that ranges are dealt to, at most: a layout, results are the same for any number.
TASKS = 20_000
_MAGIC = b"\x1f\x8b\x08"
_READ = 1 << 16
#: Bytes that are decoded at a time.
_PIECE = 1 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# A URI path for ids, as a record's id must be a URI.
_ID = "urn:veldspar:record:"


def plan_records(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(id, url, payload, digest, size, refers_to): refers_to is set for revisits."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    many = rows.where(F.col("size") >= min_revisit).groupBy("digest", "size").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n"))
    many = materialise(many.where("n > 1 and first is not null"), "warc-repeated")
    columns = ["id", "url", "payload", "digest", "size"]
    hot = F.broadcast(many.where(F.col("n") > HOT).select("digest", "size", "first"))
    cold = many.where(F.col("n") <= HOT).select(F.col("digest").alias("key"), F.col("size").alias("of"), F.col("first").alias("other"))
    # Rows of a hot digest have their answer, and short ones need none; they spread in the next join by a key of their own.
    told = rows.join(hot, ["digest", "size"], "left")
    key = F.when(F.col("first").isNull() & (F.col("size") >= min_revisit), F.col("digest")).otherwise(F.concat_ws("-", F.lit("told"), "id", "url"))
    told = told.withColumn("key", key).join(cold.withColumnRenamed("of", "size"), ["key", "size"], "left").withColumn("first", F.coalesce("first", "other"))
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return told.select(*columns, F.when(revisit, F.col("first")).alias("refers_to"))


def _record(key: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """A record as one gzip member."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_ID}{'null' if key is None else key}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
    ]
    if url:
        fields.append("WARC-Target-URI: " + quote(url, safe="%/:=&?~#+!$,;'@()*[]"))
    fields += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        fields += [f"WARC-Refers-To: <{_ID}{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    fields.append(f"Content-Length: {len(block)}")
    packer = zlib.compressobj(5, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _empty_member() -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.flush()


def write_archives(records: DataFrame, path: str) -> None:
    """Write planned records to a folder of archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for r in range(batch.num_rows):
                member = _record(*(c[r].as_py() for c in batch.columns))
                if member[-1]:
                    member += _empty_member()
                out.append(member[:-1])
                held += len(member)
                if held > 16 << 20:
                    yield pa.record_batch({"value": pa.array(out, pa.binary())})
                    out, held = [], 0
            yield pa.record_batch({"value": pa.array(out, pa.binary())})

    members = records.select("id", "url", "payload", "digest", "size", "refers_to").mapInArrow(run, "value binary")
    members.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").option("compression", "none").text(path)


def _open(path: str) -> BinaryIO:
    """A seekable file of any store that Python can reach: a shared folder, or what pyarrow connects to."""
    if path.startswith("file:") or "://" not in path:
        return open(re.sub("^file:/*", "/", path), "rb")
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))
    return store.open_input_file(at)


class _Block:
    """Takes in a record's block piece by piece: the HTTP head, then size and digest of the payload, and the
    payload itself if it is wanted."""

    def __init__(self, length: int, keep: bool):
        self.left, self.keep = length, keep
        self.http: bytes | None = None
        self.begun, self.parts = bytearray(), []
        self.size, self.sha = 0, hashlib.sha1()

    def feed(self, data: bytes) -> None:
        data = data[: self.left]
        self.left -= len(data)
        if self.http is None:
            before = len(self.begun)
            self.begun += data
            end = self.begun.find(b"\r\n\r\n", max(0, before - 3))
            if end < 0:
                return
            self.http, data = bytes(self.begun[:end]), bytes(self.begun[end + 4 :])
        self.size += len(data)
        self.sha.update(data)
        if self.keep:
            self.parts.append(data)


class _Archive:
    """A file, read on from a moving position."""

    def __init__(self, file: BinaryIO, at: int):
        self.file = file
        self.move(at)

    def move(self, at: int) -> None:
        self.file.seek(at)
        self.at, self.data = at, b""

    def find(self, end: int) -> bool:
        """Move to the next magic bytes that begin before end."""
        while self.at < end:
            place = self.data.find(_MAGIC)
            if place >= 0:
                self.data, self.at = self.data[place:], self.at + place
                return self.at < end
            rest = self.data[-2:]
            self.at += len(self.data) - len(rest)
            new = self.file.read(_READ)
            if not new:
                return False
            self.data = rest + new
        return False

    def record(self, keep: bool) -> tuple[int, dict[str, str], _Block] | None:
        """End, headers and block of the record that begins here; None if none does."""
        unpacker = zlib.decompressobj(31)
        head: dict[str, str] | None = None
        begun, block = bytearray(), _Block(0, False)
        data, upto = self.data, self.at + len(self.data)
        while not unpacker.eof:
            if not data:
                data = self.file.read(_READ)
                upto += len(data)
                if not data:
                    break
            try:
                new = unpacker.decompress(data, _PIECE)
            except zlib.error:
                if head is None:
                    return None
                raise ValueError(f"damaged record at byte {self.at}") from None
            data = unpacker.unconsumed_tail
            if head is None:
                before = len(begun)
                begun += new
                if not begun.startswith(b"WARC/1."[: len(begun)]):
                    return None
                end = begun.find(b"\r\n\r\n", max(0, before - 3))
                if end < 0:
                    continue
                lines = begun[:end].decode("utf-8", "replace").split("\r\n")[1:]
                head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
                if not head.get("content-length", "").isdigit() or "warc-type" not in head:
                    return None
                block, new = _Block(int(head["content-length"]), keep), bytes(begun[end + 4 :])
            block.feed(new)
        if head is None:
            return None
        if not unpacker.eof or block.left:
            raise ValueError(f"cut-off record at byte {self.at}")
        return upto - len(unpacker.unused_data), head, block


def read_range(path: str, start: int, end: int, keep: bool = True) -> Iterator[tuple[int, int, dict[str, str], _Block]]:
    """(begin, end, headers, block) of the records of an archive that begin in [start, end)."""
    with _open(path) as file:
        archive = _Archive(file, start)
        while archive.find(end):
            at = archive.at
            found = archive.record(keep)
            if found is None:
                archive.move(at + 1)
            else:
                yield at, *found
                archive.move(found[0])


_FIELDS = {"id": T.LongType(), "url": T.StringType(), "record_type": T.StringType(), "size": T.LongType(), "digest": T.StringType(), "refers_to": T.LongType(), "payload": T.BinaryType()}
_ARROW = {"id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "size": pa.int64(), "digest": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
#: Of each row its range; on the row that sums up a range, the first and last place of its records, or what went wrong.
_PLACES = {"path": T.StringType(), "start": T.LongType(), "first": T.LongType(), "last": T.LongType(), "error": T.StringType(), "sums_up": T.BooleanType()}
_ARROW_PLACES = {"path": pa.string(), "start": pa.int64(), "first": pa.int64(), "last": pa.int64(), "error": pa.string(), "sums_up": pa.bool_()}


def _key(uri: str | None) -> int | None:
    last = (uri or "").strip("<>").rpartition(":")[2]
    return int(last) if re.fullmatch(r"-?\d+", last) else None


def _row(path: str, head: dict[str, str], block: _Block) -> dict:
    digest = head.get("warc-payload-digest", "").rpartition(":")[2]
    size = re.search(rb"(?im)^content-length:\s*(\d+)", block.http or b"")
    if head["warc-type"] == "response" and (block.sha.hexdigest() != digest or not size or block.size != int(size[1])):
        raise ValueError(f"a payload of {path} differs from its digest")
    return {
        "id": _key(head.get("warc-record-id")), "url": head.get("warc-target-uri"), "record_type": head["warc-type"], "size": int(size[1]) if size else None, "digest": digest,
        "refers_to": _key(head.get("warc-refers-to")), "payload": b"".join(block.parts),
    }


def _reader(payloads: bool) -> tuple[Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], T.StructType]:
    """A function that reads rows of (path, start, at, end) and its schema: the records from at on, and one row
    that sums up the range."""
    names = [n for n in _FIELDS if payloads or n != "payload"]
    made = pa.schema([*((n, _ARROW[n]) for n in names), *_ARROW_PLACES.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                place = {"path": r["path"], "start": r["start"], "sums_up": False}
                rows, held, first, last, error = [], 0, None, None, None
                try:
                    for begin, end, head, block in read_range(r["path"], r["at"], r["end"], payloads):
                        first, last = begin if first is None else first, end
                        rows.append(_row(r["path"], head, block) | place)
                        held += len(rows[-1]["payload"])
                        if held > 8 << 20 or len(rows) >= 5000:
                            yield pa.RecordBatch.from_pylist(rows, schema=made)
                            rows, held = [], 0
                except ValueError as e:
                    # Told by the driver, for a range that begins inside a member can be wrong about it.
                    error = str(e)
                rows.append(place | {"first": first, "last": last, "error": error, "sums_up": True})
                yield pa.RecordBatch.from_pylist(rows, schema=made)

    return run, T.StructType([T.StructField(n, t) for n, t in ({n: _FIELDS[n] for n in names} | _PLACES).items()])


def _ranges(spark: SparkSession, path: str, range_bytes: int) -> DataFrame:
    """(path, start, at, end) of every range under path; reading begins at at."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    cut = files.where("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    return cut.select("path", "start", F.col("start").alias("at"), F.least(F.col("start") + range_bytes, F.col("length")).alias("end"))


def read_archives(spark: SparkSession, path: str, range_bytes: int = RANGE, payloads: bool = True) -> DataFrame:
    """(id, url, record_type, size, digest, refers_to, payload) of every record under path."""
    ranges = _ranges(spark, path, range_bytes)
    # A row stands for megabytes to read, so a number of tasks is asked for: by the rows' own few bytes, all
    # ranges would be gathered in one.
    dealt = lambda rows: rows.repartition(max(1, min(rows.count(), TASKS)))
    scan, schema = _reader(False)
    found = materialise(dealt(ranges).mapInArrow(scan, schema), "warc-records")
    # The end of the records of all ranges before; a range whose records begin earlier was read from within one.
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        sums = found.where("sums_up").select("path", "start", "first", "last", "error").withColumn("upto", F.max("last").over(before))
        sums = materialise(sums.join(ranges.select("path", "start", "end"), ["path", "start"]), "warc-places")
        # An error stands where all that came before in its range does.
        wrong = sums.where((F.col("upto") > F.col("start")) & (F.coalesce("first", F.when(F.col("error").isNotNull(), F.col("start"))) < F.col("upto")))
        if wrong.isEmpty():
            break
        again = dealt(wrong.select("path", "start", F.col("upto").alias("at"), "end")).mapInArrow(scan, schema)
        kept = found.join(wrong.select("path", "start"), ["path", "start"], "left_anti")
        found = materialise(kept.unionByName(again), "warc-records")
    if damaged := sums.where("error is not null").select("error").first():
        raise ValueError(damaged.error)
    if not payloads:
        return found.where("not sums_up").select(*(n for n in _FIELDS if n != "payload"))
    settled = sums.select("path", "start", F.greatest("start", F.coalesce("upto", F.lit(0).cast("long"))).alias("at"), "end").where("at < end")
    read, schema = _reader(True)
    return dealt(settled).mapInArrow(read, schema).where("not sums_up").select(*_FIELDS)


def round_trip(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", range_bytes: int = RANGE) -> DataFrame:
    """The records, without payloads, of pages written as archives and read back; fails if not all came back."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    write_archives(plan_records(pages, id_col, payload_col, url_col), folder)
    found = read_archives(spark, folder, range_bytes, payloads=False)
    written, read = pages.count(), found.count()
    if written != read:
        raise RuntimeError(f"{written} records were written and {read} read")
    return found
