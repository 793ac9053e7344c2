"""WARC archives in Zstandard: a dictionary in the leading skippable frame, one frame for each record, revisits for equal payloads."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME = 0xFD2FB528
VERSION = b"WARC/1.1"
VERSIONS = (b"WARC/1.0", VERSION)
DIGESTS = {"md5": 16, "sha1": 20, "sha256": 32, "sha512": 64}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
# Raw bytes of an archive; dictionary bytes; bytes of the archive's own records that the dictionary is made from.
ARCHIVE_BYTES = 8 << 20
DICTIONARY_BYTES = 16 << 10
SAMPLE_BYTES = 1 << 20
# Compressed bytes that a frame reader takes at a time; what it took too much of is given back.
STEP = 64 << 10


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def name_of(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def id_of(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool) -> bytes:
    """One record. A revisit holds the response's header lines but not its payload."""
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:x-none")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        VERSION.decode(), f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name_of(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        lines[2:2] = [f"WARC-Refers-To: {name_of(first)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """Records as one archive. The dictionary comes from its first records; where they are too few to make one, it is plain text of the first."""
    sample, size = [], 0
    for r in records:
        sample.append(r[:8192])
        size += len(sample[-1])
        if size >= SAMPLE_BYTES:
            break
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes()
    except zstandard.ZstdError:
        trained = sample[0][:DICTIONARY_BYTES]
    compressor = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(trained), write_checksum=True)
    return struct.pack("<II", DICTIONARY_FRAME, len(trained)) + trained + b"".join(compressor.compress(r) for r in records)


def frames(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one frame at a time, with the dictionary of its leading skippable frame.

    Archives may come without a dictionary; other skippable frames are passed over. A frame costs its own bytes, not those behind it.
    """
    if not data:
        return
    magic, at, size = _head(data, 0)
    dictionary = None
    if magic == DICTIONARY_FRAME:
        raw, at = data[8 : 8 + size], 8 + size
        if raw[:4] == struct.pack("<I", FRAME):  # the dictionary itself may be a frame
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        dictionary = zstandard.ZstdCompressionDict(raw)
    elif magic != FRAME and magic not in SKIPPABLE:
        raise ValueError("no leading dictionary frame, nor any other")
    reader, view = zstandard.ZstdDecompressor(dict_data=dictionary), memoryview(data)
    while at < len(data):
        magic, _, size = _head(data, at)
        if magic in SKIPPABLE:
            at += 8 + size
            continue
        step, out = reader.decompressobj(), []
        while not step.eof:
            if at >= len(data):
                raise ValueError("archive ends inside a frame")
            out.append(step.decompress(view[at : at + STEP]))
            at = min(at + STEP, len(data))
        at -= len(step.unused_data)
        yield b"".join(out)


def _head(data: bytes, at: int) -> tuple[int, int, int]:
    """(magic number, place, size of a skippable frame's content) of the frame at a place."""
    if at + 8 > len(data):
        raise ValueError("archive ends inside a frame")
    magic, size = struct.unpack_from("<II", data, at)
    if magic in SKIPPABLE and at + 8 + size > len(data):
        raise ValueError("no leading dictionary frame of the size it says, the archive ends inside a frame")
    return magic, at, size


def _fields(lines: list[bytes]) -> dict[bytes, str]:
    """Header fields by lower-case name; folded lines are joined. A name that comes again keeps its first value, but for those that say how to read a record."""
    out: dict[bytes, str] = {}
    last = None
    for line in lines:
        if line[:1] in (b" ", b"\t") and last:
            out[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, colon, value = line.partition(b":")
        name = name.strip().lower()
        if not colon or not name:
            raise ValueError(f"bad header line {line[:80]!r}")
        value = value.strip().decode("utf-8", "replace")
        if name in (b"content-length", b"warc-type") and out.get(name, value) != value:
            raise ValueError(f"bad header line {line[:80]!r}, it contradicts another")
        out.setdefault(name, value)
        last = name
    return out


def _agrees(stated: str | None, *contents: bytes) -> bool:
    """Whether a digest `algorithm:value`, in hex or base32, is one of these contents'. Unknown algorithms and absent digests say nothing."""
    algorithm, colon, value = (stated or "").partition(":")
    algorithm = algorithm.strip().lower().replace("-", "")
    if not colon or algorithm not in DIGESTS:
        return True
    value = value.strip()
    raw = bytes.fromhex(value) if re.fullmatch(f"[0-9A-Fa-f]{{{2 * DIGESTS[algorithm]}}}", value) else None
    if raw is None:
        try:
            raw = base64.b32decode(value.upper() + "=" * (-len(value) % 8))
        except ValueError:
            return False
    return any(hashlib.new(algorithm, c).digest() == raw for c in contents)


def _without_chunks(body: bytes) -> bytes | None:
    """The entity of a body in HTTP chunks; None where it is not one."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = re.match(rb"[0-9A-Fa-f]+", body[at:end]) if end >= 0 else None
        if not size:
            return None
        n, at = int(size[0], 16), end + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            return None
        out.append(body[at : at + n])
        at += n + 2


def parse(raw: bytes) -> dict:
    """One record's fields, after its version, header lines, lengths and digests have been checked.

    Versions 1.0 and 1.1 and every record type are read. Responses and requests in HTTP have the entity as payload (chunks taken apart),
    other records their block; a revisit has none. Digests are checked where their algorithm is known, and a payload's against the entity as
    sent and as meant, since crawlers differ. A record that says it was truncated needs no HTTP length or payload digest. `page_id` and `refers_to` are
    numbers of this library's own names, NULL elsewhere; `payload_digest` is the payload's SHA-1, for a revisit the value stated.
    """
    head, cut, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not cut or lines[0] not in VERSIONS:
        raise ValueError("not a record of WARC 1.0 or 1.1")
    header = _fields(lines[1:])
    missing = [n.decode() for n in (b"content-length", b"warc-type", b"warc-record-id") if n not in header]
    if missing or not re.fullmatch(r"\d+", header[b"content-length"]):
        raise ValueError(f"record without {', '.join(missing) or 'a proper length'}")
    length = int(header[b"content-length"])
    block = rest[:length]
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError("record is not as long as it says")
    if not _agrees(header.get(b"warc-block-digest"), block):
        raise ValueError("block digest does not match")
    kind, stated = header[b"warc-type"].lower(), header.get(b"warc-payload-digest")
    in_http = header.get(b"content-type", "").lower().startswith("application/http")
    payload, size = block, len(block)
    if in_http or kind == "revisit":
        http, cut, body = block.partition(b"\r\n\r\n")
        if kind == "response" and not cut:
            raise ValueError("no HTTP response in the record")
        fields = _fields([x for x in http.split(b"\r\n")[1:] if b":" in x]) if block else {}
        said = fields.get(b"content-length")
        said = int(said) if said and re.fullmatch(r"\d+", said) else None
        if kind == "revisit":
            if body:
                raise ValueError("bad revisit record")
            payload, size = None, said
        else:
            entity = _without_chunks(body) if "chunked" in fields.get(b"transfer-encoding", "").lower() else None
            payload = body if entity is None else entity
            size = len(payload)
            whole = b"warc-truncated" not in header
            if whole and entity is None and said is not None and said != len(body) and kind == "response":
                raise ValueError("payload does not match its length")
            if whole and not _agrees(stated, body, payload):
                raise ValueError("payload does not match its digest")
    elif b"warc-truncated" not in header and not _agrees(stated, block):
        raise ValueError("payload does not match its digest")
    return {
        "page_id": id_of(header[b"warc-record-id"]), "url": header.get(b"warc-target-uri"), "payload_bytes": size,
        "payload_digest": (stated or "").partition(":")[2] or None if payload is None else sha1_base32(payload),
        "record_type": kind, "refers_to": id_of(header.get(b"warc-refers-to")), "payload": payload,
        "record_id": header[b"warc-record-id"], "refers_to_id": header.get(b"warc-refers-to")}


def write_archives(pages: DataFrame, path: str, id: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> None:
    """Write archives below `path`: rows (archive, records, data), each of about ARCHIVE_BYTES raw bytes of records.

    Of pages with equal payloads of at least `least` bytes, that with the smallest id is the response and the others
    revisit it; rows that repeat that smallest id are responses too. NULL html is an empty payload. Payloads are compared by SHA-1 and length;
    only payloads that occur twice or more are joined back, counted before that join.
    """
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    slim = pages.select(F.col(id).cast("long").alias("id"), F.col(url).alias("url"), payload.alias("payload"))
    slim = slim.withColumn("digest", F.sha1("payload")).withColumn("bytes", F.length("payload"))
    shared = slim.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    joined = slim.join(shared.drop("n"), ["digest", "bytes"], "left").withColumn(
        "revisit", F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")))

    def write(batches):
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            nonlocal number, held, size
            out = pa.RecordBatch.from_pydict({
                "archive": [f"{part:06d}-{number:06d}"], "records": pa.array([len(held)], pa.int64()), "data": pa.array([archive(held)], pa.binary())})
            number, held, size = number + 1, [], 0
            return out

        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("id", "url", "payload", "first", "revisit")), strict=True):
                held.append(record(*(x.as_py() for x in row)))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
        if held:
            yield flush()

    columns = joined.select("id", "url", "payload", "first", "revisit")
    columns.mapInArrow(write, "archive string, records long, data binary").write.option("compression", "uncompressed").parquet(path)


SCHEMA = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, "
          "record_id string, refers_to_id string")


def read_files(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of `.warc.zst` files at a path or pattern, each file read whole by one task, as Spark reads binary files (2 GiB at most)."""
    files = spark.read.format("binaryFile").load(path).select(
        F.col("path").alias("archive"), F.lit(None).cast("long").alias("records"), F.col("content").alias("data"))
    return read_archives(files, payloads)


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of archives (archive, records, data), checked; a wrong number of records stops the job where `records` is known.

    A record that is damaged stops the job with its archive's name and place. Empty data hold no record.
    """
    arrow = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("record_id", pa.string()), ("refers_to_id", pa.string())])

    def read(batches):
        for batch in batches:
            for name, n, data in zip(*(batch.column(c) for c in ("archive", "records", "data")), strict=True):
                rows, count, held = [], 0, 0
                for raw in frames(data.as_py()):
                    try:
                        rows.append(parse(raw))
                    except ValueError as e:
                        raise ValueError(f"archive {name.as_py()}, record {count}: {e}") from e
                    if not payloads:
                        rows[-1]["payload"] = None
                    count += 1
                    held += len(rows[-1]["payload"] or b"")
                    if len(rows) == 500 or held > ARCHIVE_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows, held = [], 0
                if n.as_py() is not None and count != n.as_py():
                    raise ValueError(f"archive {name.as_py()} has {count} records, not {n.as_py()}")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return archives.select("archive", "records", "data").mapInArrow(read, SCHEMA)
