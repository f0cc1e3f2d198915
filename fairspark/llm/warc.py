"""WARC archives in Zstandard: one frame a record, the dictionary in a leading skippable frame.

Writing.  Of records with equal payloads (from a size on) the one with the smallest page_id is a response with the payload,
the others are revisits that refer to it and hold only the HTTP header.  A record is a frame of its own; an archive begins
with a skippable frame (magic 0x184D2A5D) that holds the dictionary, trained on a bounded number of the archive's first
payloads.  Archives roll over at a size.  Each task writes its archives under names of its own and moves them into
place whole; rows are sorted within tasks, so that a task that runs again writes the same archives.

Reading.  Spark reads archives as binary rows.  The frame headers are walked to find each record's frame; each is decoded
alone with the dictionary, and versions, headers, lengths and digests are checked: a fault raises ``WarcError``.  Archives
of other writers are read too: records of any type, any record ids, with or without digests, blocks that aren't HTTP.

Archives go to any store that pyarrow's file systems write (file, hdfs, s3, gcs) and are read back by Spark.

Defined cases: a null html is an empty payload; a null url leaves the target out; a null page_id is kept, written as an
absent number, and never the first of equal payloads (if all are null, all are responses); repeated rows are records of
their own, and rows that repeat the first page_id are responses too; an empty table gives an empty result; further columns
are not read.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import re
import struct
import uuid
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairspark.llm._spark import materialise, shared_dir, spread_join

#: Fixed by the Zstandard and WARC formats.
DICTIONARY_FRAME, FRAME, DICTIONARY = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Bytes of payload of an archive, and of a dictionary and its training payloads.
ARCHIVE, DICTIONARY_SIZE, TRAINING, TRAINING_RECORDS = 32 << 20, 16 << 10, 1 << 20, 400


class WarcError(ValueError):
    """An archive that isn't what it says."""


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    name = lambda x: f"<urn:page:{'' if x is None else x}>"
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    headers += [("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"), ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}")]
    if revisit:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", name(refers_to))]
    headers += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n" + block + b"\r\n\r\n"


def _headers(data: bytes, what: str) -> dict[str, str]:
    out = {}
    for line in re.sub(rb"\r\n[ \t]+", b" ", data).split(b"\r\n"):  # a line that begins with a space goes on
        key, colon, value = line.partition(b":")
        if not colon or not key:
            raise WarcError(f"no header: {line[:80]!r} in {what}")
        out[key.decode("utf-8", "replace").strip().lower()] = value.strip().decode("utf-8", "replace")
    return out


#: Headers that every record has; digests that are checked (others are taken as they are).
REQUIRED = frozenset({"warc-type", "warc-record-id", "warc-date", "content-length"})


def _is_digest(given: str, data: bytes) -> bool:
    """Whether a digest is that of the data: SHA-1 and SHA-256 in base32 or hex; what uses other functions passes."""
    name, colon, value = given.partition(":")
    made = {"sha1": hashlib.sha1, "sha256": hashlib.sha256, "sha-256": hashlib.sha256}.get(name.lower())
    if not colon or made is None:
        return True
    digest = made(data, usedforsecurity=False).digest()
    return value.upper().rstrip("=") == base64.b32encode(digest).decode().rstrip("=") or value.lower() == digest.hex()


def _page(name: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(m[1]) if m else None


def parse(data: bytes) -> dict:
    """A record's columns: record_id, record_type, page_id, payload_bytes, payload_digest, refers_to, refers_to_id, url, date and payload.

    The payload of HTTP blocks is what follows the HTTP header, of others the whole block; a revisit has none (null), and its
    payload_bytes are what its HTTP header says (null without).  payload_digest: the record's, or the SHA-1 of its payload;
    bare, without the name of a SHA-1.  page_id and refers_to: the numbers in ids of our own kind, else null.
    """
    head, blank, rest = data.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not blank or version not in (b"WARC/1.0", VERSION):
        raise WarcError(f"no WARC record: {version[:20]!r}")
    headers = _headers(lines, "a WARC record")
    if missing := REQUIRED - headers.keys():
        raise WarcError(f"headers are missing: {sorted(missing)}")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise WarcError(f"a block of {len(rest) - 4} bytes, by its header {headers['content-length']}")
    block, kind = rest[:-4], headers["warc-type"]
    if not _is_digest(headers.get("warc-block-digest", ""), block):
        raise WarcError("the block isn't what its digest says")
    payload, size = block, None
    if kind in ("response", "revisit", "request") and headers.get("content-type", "").startswith("application/http"):
        http, blank, payload = block.partition(b"\r\n\r\n")
        start, _, lines = http.partition(b"\r\n")
        if (not blank or b"HTTP/" not in start) and not (kind == "revisit" and not block):
            raise WarcError("no HTTP header")
        inner = _headers(lines, "an HTTP header") if lines else {}
        length = inner.get("content-length", "")
        size = int(length) if length.isdigit() else None
        whole = "warc-truncated" not in headers and "transfer-encoding" not in inner
        if kind == "response" and whole and size is not None and len(payload) != size:
            raise WarcError("the payload isn't as long as its header says")
    revisit = kind == "revisit"
    given = headers.get("warc-payload-digest")
    if given and not revisit and "warc-truncated" not in headers and not _is_digest(given, payload):
        raise WarcError("the payload isn't what its digest says")
    if revisit and (payload or not {"warc-refers-to", "warc-refers-to-target-uri"} & headers.keys()):
        raise WarcError("a revisit with a payload, or that refers to nothing")
    digest = re.sub("^sha1:", "", given, flags=re.I) if given else None if revisit else sha1_base32(payload)
    refers = headers.get("warc-refers-to")
    return {
        "record_id": headers["warc-record-id"].strip("<>"), "record_type": kind, "page_id": _page(headers["warc-record-id"]), "payload_bytes": size if revisit else len(payload), "payload_digest": digest,
        "refers_to": _page(refers), "refers_to_id": refers.strip("<>") if refers else None, "url": headers.get("warc-target-uri"), "date": headers["warc-date"], "payload": None if revisit else payload,
    }


def train_dictionary(payloads: list[bytes]):
    """A dictionary for these payloads, or None where there is too little to learn from."""
    import zstandard

    if sum(map(len, payloads)) < 8 * DICTIONARY_SIZE or len(payloads) < 8:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY_SIZE, payloads)
    except zstandard.ZstdError:
        return None


class Archive:
    """Builds one archive in memory."""

    def __init__(self, dictionary=None):
        import zstandard

        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True, write_content_size=True)
        raw = dictionary.as_bytes() if dictionary else b""
        self.parts = [struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw]
        self.records = self.size = 0

    def add(self, data: bytes) -> None:
        self.parts.append(self.compressor.compress(data))
        self.records += 1
        self.size += len(data)

    def bytes(self) -> bytes:
        return b"".join(self.parts)


def frame_end(data: bytes, at: int) -> int:
    """Where the frame that begins at ``at`` ends, by its header and its blocks' headers."""
    import zstandard

    try:
        end = at + zstandard.frame_header_size(data[at : at + 18])
        checksum = zstandard.get_frame_parameters(data[at : at + 18]).has_checksum
    except zstandard.ZstdError as e:
        raise WarcError(f"no frame at {at}") from e
    while True:
        if end + 3 > len(data):
            raise WarcError(f"the frame at {at} is cut off")
        header = int.from_bytes(data[end : end + 3], "little")
        last, kind, size = header & 1, header >> 1 & 3, header >> 3
        if kind == 3:
            raise WarcError(f"no block at {end}")
        end += 3 + (1 if kind == 1 else size)
        if last:
            end += 4 * checksum
            if end > len(data):
                raise WarcError(f"the frame at {at} is cut off")
            return end


def read_archive(data: bytes, most: int = 1 << 30) -> Iterator[dict]:
    """The records of an archive, checked; most: bytes that a record may have."""
    import zstandard

    dictionary, decoder, at = None, None, 0
    while at < len(data):
        if at + 8 > len(data):
            raise WarcError(f"{len(data) - at} bytes are left over")
        magic, size = struct.unpack_from("<II", data, at)
        if magic in SKIPPABLE:
            raw = data[at + 8 : at + 8 + size]
            if len(raw) < size:
                raise WarcError(f"the skippable frame at {at} is cut off")
            if magic == DICTIONARY_FRAME and at == 0 and raw:
                if raw[:4] == struct.pack("<I", FRAME):
                    raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 24)
                if raw[:4] != struct.pack("<I", DICTIONARY):
                    raise WarcError("the dictionary frame holds no dictionary")
                dictionary = zstandard.ZstdCompressionDict(raw)
            at += 8 + size
            continue
        if decoder is None:
            decoder = zstandard.ZstdDecompressor(dict_data=dictionary)
        end = frame_end(data, at)
        try:
            yield parse(decoder.decompress(data[at:end], max_output_size=most))
        except zstandard.ZstdError as e:
            raise WarcError(f"the frame at {at} can't be decoded: {e}") from e
        at = end


def _write(batches: Iterator[pa.RecordBatch], folder: str, archive_bytes: int, date: str) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs
    from pyspark import TaskContext

    store, path = fs.FileSystem.from_uri(folder)
    task, number, first = TaskContext.get().partitionId(), 0, []
    archive = None

    def saved() -> pa.RecordBatch:
        nonlocal archive, number
        name = f"{task:06d}-{number:05d}.warc.zst"
        passing = posixpath.join(path, f".{name}.{uuid.uuid4().hex}")
        data = archive.bytes()
        with store.open_output_stream(passing) as out:
            out.write(data)
        store.move(passing, posixpath.join(path, name))
        row = pa.RecordBatch.from_pydict({"archive": [name], "records": [archive.records], "bytes": [len(data)]})
        archive, number = None, number + 1
        return row

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal archive, first
        for row in first:
            if archive is None:
                archive = Archive(train_dictionary([r[2] for r in first[:TRAINING_RECORDS]]))
            archive.add(record(*row, date))
            if archive.size >= archive_bytes:
                yield saved()
        first = []

    held = 0
    for batch in batches:
        for page_id, url, html, refers_to, revisit in zip(*(batch.column(i) for i in range(5)), strict=True):
            row = (page_id.as_py(), url.as_py(), (html.as_py() or "").encode("utf-8", "surrogatepass"), refers_to.as_py(), revisit.as_py())
            if archive is not None:
                archive.add(record(*row, date))
                if archive.size >= archive_bytes:
                    yield saved()
                continue
            first.append(row)  # the dictionary is trained on the first payloads of the archive
            held += len(row[2])
            if held >= TRAINING or len(first) >= TRAINING_RECORDS:
                yield from flush()
                held = 0
    yield from flush()
    if archive is not None:
        yield saved()


def with_references(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html, refers_to and revisit of each row of pages(page_id, url, html)."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha2(payload, 256).alias("key"), F.octet_length(payload).alias("size"))
    groups = rows.where(F.col("size") >= least).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first")).where("n > 1")
    groups = materialise(groups, "payloads")
    total = groups.agg(F.sum("n")).first()[0] or 0
    # A page without an equal one has no group; a payload of very many pages is dealt over several keys.
    again = ~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull()
    joined = spread_join(rows, groups, "key", "n", total, F.xxhash64("page_id", "url"))
    return joined.select("page_id", "url", "html", F.when(again, F.col("first")).alias("refers_to"), again.alias("revisit"))


def write_archives(pages: DataFrame, folder: str, least: int = 0, archive_bytes: int = ARCHIVE, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Writes archives of pages(page_id, url, html) to a folder (a URI); returns (archive, records, bytes), one row an archive."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    rows = with_references(pages, least).sortWithinPartitions("page_id", "refers_to")
    return materialise(rows.mapInArrow(partial(_write, folder=folder, archive_bytes=archive_bytes, date=date), "archive string, records long, bytes long"), "archives")


_FIELDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_MORE = ", record_id string, refers_to_id string, url string, date string, payload binary"


def _read(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(n, types[t]) for n, t in (f.split() for f in (_FIELDS + (_MORE if payloads else "")).split(", "))])
    for batch in batches:
        for content in batch.column(0):
            rows, size = [], 0
            for row in read_archive(content.as_py()):
                size += len(row["payload"] or b"") if payloads else 100
                rows.append({k: row[k] for k in schema.names})
                if size >= 1 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema)


def read_archives(spark, folder: str, payloads: bool = False) -> DataFrame:
    """A row for each record of the archives in a folder, checked, of whatever type; with payloads all columns of ``parse``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("content")
    return files.mapInArrow(partial(_read, payloads=payloads), _FIELDS + (_MORE if payloads else ""))


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes pages as archives to the shared folder and reads them back; faults in archives raise."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    written = write_archives(pages, folder, least)
    if not written.head(1):
        return spark.createDataFrame([], _FIELDS)
    return read_archives(spark, folder)
