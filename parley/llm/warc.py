"""WARC archives in Zstandard: one frame per record, dictionary first.

``write_archives`` writes ``*.warc.zst`` files: a leading skippable frame
(magic 0x184D2A5D) holds the dictionary, trained on the archive's first
records, then every record is one frame.  ``read_archives`` reads any folder
of such files: it loads the dictionary, decodes frame by frame and validates
each record (version line, fields, block length, record end, block and payload
digest); what fails comes back with its error instead of being dropped.

Archives are written by the tasks straight into the shared folder, under a
temporary name first, so a lost task leaves no half archive, and every attempt
of a task has names of its own.  ``write_archives`` returns the names of the
attempts that counted with their numbers of records; given that manifest,
``read_archives`` leaves out archives of attempts that were lost, and raises if
an archive is absent or holds another number of records.  Archives are read in
pieces of ``READ_BYTES``, one record at a time, whatever their size.

Equal payloads of at least ``min_revisit`` bytes are stored once: the record
with the largest id is the response and the others are revisits.  The groups
are found on digests alone, pre-aggregated, and joined back salted.

Edge cases: a null html is an empty payload; payloads below the limit are all
responses; a null url is left out; rows with a null id never lead a group
(a group without ids consists of responses); repeated rows with a group's
largest id are responses each; an empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import urllib.parse
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import cut, shared_folder

MIN_REVISIT = 1000
ARCHIVE_BYTES = 32 << 20
DICT_BYTES = 16 << 10
DICT_RECORDS = 128
LEVEL = 3
SALTS = 16
# Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
ZSTD_MAGIC = 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def plan_records(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """``page_id, url, html, refers_to`` (null for responses)."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), html.alias("html"), F.when(F.octet_length(html) >= min_revisit, F.sha1(html.cast("binary"))).alias("digest"))
    groups = rows.where("digest is not null").groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1 and last is not null")
    groups = groups.select("digest", "last", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    refers = F.when(F.col("page_id") == F.col("last"), F.lit(None)).otherwise(F.col("last")).cast("long")
    return salted.join(groups, ["digest", "salt"], "left").select("page_id", "url", "html", refers.alias("refers_to"))


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    block = HTTP % len(payload) + (b"" if refers_to is not None else payload)
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", DATE)]
    fields += [("WARC-Page-ID", str(page_id))] if page_id is not None else []
    fields += [("WARC-Target-URI", urllib.parse.quote(url, safe="%/:=&?~#+!$,;'@()*[]"))] if url is not None else []
    fields += [("WARC-Refers-To", _urn(refers_to)), ("WARC-Refers-To-Page-ID", str(refers_to)), ("WARC-Profile", PROFILE)] if refers_to is not None else []
    fields += [("WARC-Payload-Digest", _digest(payload)), ("WARC-Payload-Length", str(len(payload))), ("WARC-Block-Digest", _digest(block))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary from an archive's first records; too few or too uniform
    records give a plain one made of the first record's head."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return (samples[0] if samples else b"WARC/1.1\r\n")[:1024].ljust(16, b" ")


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``records(page_id, url, html, refers_to)``; returns the manifest
    ``name, records`` of the archives."""
    folder = shared_folder(records.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        attempt = f"{task.partitionId():06d}-{task.taskAttemptId()}"
        number, sink, pending, size, count, box = 0, None, [], 0, 0, None
        paths, counts = [], []

        def name(temporary: bool) -> str:
            return f"{root}/.tmp-{attempt}-{number:05d}" if temporary else f"{root}/{attempt}-{number:05d}.warc.zst"

        def start() -> None:
            nonlocal sink, box
            raw = train_dictionary(pending)
            sink = fs.open_output_stream(name(True))
            sink.write(struct.pack("<II", SKIPPABLE, len(raw)) + raw)
            box = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw), write_checksum=True)
            for r in pending:
                sink.write(box.compress(r))
            pending.clear()

        def close() -> None:
            nonlocal sink, number, size, count
            if pending:
                start()
            if sink is not None:
                sink.close()
                fs.move(name(True), name(False))
                paths.append(name(False).rpartition("/")[2])
                counts.append(count)
                number, sink, size, count = number + 1, None, 0, 0

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                r = record(page_id, url, html.encode("utf-8", "surrogatepass"), refers_to)
                size, count = size + len(r), count + 1
                if sink is None:
                    pending.append(r)
                    if len(pending) >= DICT_RECORDS:
                        start()
                else:
                    sink.write(box.compress(r))
                if size >= archive_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(counts, pa.int64())], names=["name", "records"])

    return cut(records.select("page_id", "url", "html", "refers_to").mapInArrow(run, "name string, records long"))


READ_BYTES = 1 << 16


def frames(source: BinaryIO) -> Iterator[bytes]:
    """The decoded frames of one archive, read piece by piece."""
    held, box, first = b"", zstandard.ZstdDecompressor(), True

    def ahead(n: int) -> bytes:
        nonlocal held
        while len(held) < n and (piece := source.read(max(READ_BYTES, n - len(held)))):
            held += piece
        return held[:n]

    while head := ahead(8):
        if len(head) < 8:
            raise ValueError("bytes after the last frame")
        magic, length = struct.unpack("<II", head)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if first and magic == SKIPPABLE:
                raw = ahead(8 + length)[8:]
                if len(raw) != length:
                    raise ValueError("the dictionary frame is cut off")
                held = held[8 + length :]
                if raw[:4] == struct.pack("<I", ZSTD_MAGIC):
                    raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
                box = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
            else:
                left = 8 + length
                while left:
                    if not (piece := ahead(min(left, READ_BYTES))):
                        raise ValueError("a skippable frame is cut off")
                    left, held = left - len(piece), held[len(piece) :]
            first = False
            continue
        first = False
        reader, parts = box.decompressobj(), []
        while not reader.eof:
            if not ahead(1):
                raise ValueError("the last frame is cut off")
            parts.append(reader.decompress(held))
            held = reader.unused_data
        yield b"".join(parts)


def parse(raw: bytes) -> dict:
    """Fields and payload of one record; raises ``ValueError`` if it is not valid."""
    end = raw.find(b"\r\n\r\n")
    lines = raw[: max(end, 0)].decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("no version line")
    fields = {}
    for line in lines[1:]:
        k, colon, v = line.partition(":")
        if not colon:
            raise ValueError("a header line without a colon")
        fields[k.strip().lower()] = v.strip()
    for needed in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if needed not in fields:
            raise ValueError(f"no {needed}")
    if not fields["content-length"].isdigit():
        raise ValueError("content-length is not a number")
    body = raw[end + 4 :]
    n = int(fields["content-length"])
    if len(body) != n + 4 or body[n:] != b"\r\n\r\n":
        raise ValueError("the length differs from content-length")
    block = body[:n]
    if fields.get("warc-block-digest", _digest(block)) != _digest(block):
        raise ValueError("block digest")
    head = block.find(b"\r\n\r\n")
    payload = block[head + 4 :] if head >= 0 else block
    if fields["warc-type"] == "response":
        if fields.get("warc-payload-digest", _digest(payload)) != _digest(payload):
            raise ValueError("payload digest")
        fields.setdefault("warc-payload-digest", _digest(payload))
        fields.setdefault("warc-payload-length", str(len(payload)))
    return fields | {"payload": payload}


RECORD_SCHEMA = "path string, record_no long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, error string"
_RECORD = pa.schema([(f.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[f.split()[1]]) for f in RECORD_SCHEMA.split(", ")])
BATCH_BYTES = 8 << 20


def read_archives(spark: SparkSession, folder: str, payloads: bool = True, manifest: DataFrame | None = None) -> DataFrame:
    """Every record of the archives in ``folder`` (of those in ``manifest``, if
    given); invalid ones carry ``error``."""
    address = shared_folder(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(address)
        for batch in batches:
            for name, expected in zip(*(c.to_pylist() for c in batch.columns)):
                rows, size, no, broken = [], 0, 0, False
                source = f"{address.rstrip('/')}/{name}"
                it = frames(fs.open_input_stream(f"{root.rstrip('/')}/{name}", compression=None))
                while True:
                    row = dict.fromkeys(_RECORD.names) | {"path": source, "record_no": no}
                    last = False
                    try:
                        raw = next(it)
                    except StopIteration:
                        break
                    except (ValueError, zstandard.ZstdError) as e:
                        row["error"], last, broken = str(e), True, True
                    else:
                        try:
                            f = parse(raw)
                            number = lambda k, f=f: int(f[k]) if k in f else None
                            digest = f.get("warc-payload-digest")
                            row |= {"page_id": number("warc-page-id"), "url": f.get("warc-target-uri"), "record_type": f["warc-type"], "refers_to": number("warc-refers-to-page-id"), "payload_bytes": number("warc-payload-length")}
                            row |= {"payload_digest": base64.b32decode(digest.partition(":")[2]).hex() if digest else None, "payload": f["payload"] if payloads else None}
                            size += len(f["payload"]) if payloads else 0
                        except ValueError as e:
                            row["error"] = str(e)
                    rows.append(row)
                    no += 1
                    if size >= BATCH_BYTES or len(rows) >= 4096 or last:
                        yield pa.RecordBatch.from_pylist(rows, _RECORD)
                        rows, size = [], 0
                    if last:
                        break
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _RECORD)
                if expected is not None and no != expected and not broken:
                    raise ValueError(f"{name} holds {no} records, the manifest says {expected}")

    if manifest is not None:
        records = F.col("records") if "records" in manifest.columns else F.lit(None)
        files = manifest.select("name", records.cast("long").alias("records"))
    else:
        # Names only: without its content column the file is not read here.
        found = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.warc.zst").load(address)
        files = cut(found.select(F.substring_index("path", "/", -1).alias("name"), F.lit(None).cast("long").alias("records")))
    # One archive a task; without a number the few rows would be coalesced into one.
    return files.repartition(max(1, files.count())).mapInArrow(run, RECORD_SCHEMA)


def archive_folder(spark: SparkSession) -> str:
    from parley.session import scratch_path

    return scratch_path(spark, f"warc-{uuid.uuid4().hex}")


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` and read the archives back: one row per page."""
    spark = pages.sparkSession
    folder = shared_folder(spark, folder or archive_folder(spark))
    manifest = write_archives(plan_records(pages), folder)
    found = read_archives(spark, folder, payloads=False, manifest=manifest)
    wrong = F.raise_error(F.concat(F.lit("invalid record: "), F.col("error"))).cast("long")
    return found.select(F.when(F.col("error").isNull(), F.col("page_id")).otherwise(wrong).alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
