"""WARC archives: writing, normalising whole-file gzip, reading by offset index.

``write_archives`` makes archive files that are one gzip stream over all records,
as many crawlers leave them.  Such a stream can't be entered in the middle;
``normalise`` inflates it once, in pieces, rewrites each record as a gzip member
of its own into a new file, and returns the sidecar: a table of its own with a
row for each record (archive, offset, length, type, id).  ``read_records`` opens
archives at the sidecar's offsets and reads nothing else of them.

Archives are files in a folder that all executors see.  They are read and written
as streams, so memory is bounded by the largest record, not by an archive.  Every
attempt of a task writes files of its own name, and only those that the returned
(and stored) tables name count, so lost executors leave nothing but spare files.
A stream is one task's work; archives are dealt out over all tasks.

Equal payloads: of records whose payloads of at least ``least_bytes`` bytes are
equal, the one with the smallest id is a response, the others are revisits that
refer to it and hold the HTTP head alone.

Defined results: a null payload is empty; a null id is larger than any other;
records that repeat the smallest id of their payload are all responses; a record
without payload is a response; an archive cut off in the middle, or broken as a
gzip stream there, gives the records that are whole before that; zero bytes
behind a member, and what follows the last one without being one, are passed
over; bytes that are no record (a head without a usable Content-Length, or no
WARC head) are kept up to the next record as a member of their own whose type is
null, which ``read_records`` passes over; an empty table gives no archive, an
empty archive no record.  Columns other than those named are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

LEAST_BYTES = 100
ARCHIVE_BYTES = 8_000_000
#: Bytes that are read, and the most that are inflated, at once.
READ, PIECE = 1 << 16, 1 << 20
LEVEL = 4
INDEX = "archive string, offset long, length long, record_type string, record_id string"
_INDEX_PA = [("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string())]
#: Rows of the index that go on together, and the most tasks that archives are dealt to.
INDEX_ROWS, MOST_TASKS = 10_000, 20_000
#: Where the next record may begin, for streams that have lost their way.
RECORD = re.compile(rb"WARC/\d\.\d+\r\n")
_LARGEST = 2**63 - 1


def decide(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Returns id, url, payload, digest (hex), record_type and refers_to.

    Digests are counted with map-side combining; only payloads that several
    records share are looked up again, and the planner can split a hot one.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    order = F.coalesce("id", F.lit(_LARGEST))
    shared = rows.where(F.length("payload") >= least_bytes).groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
    shared = stored(shared.where("n > 1").select(F.col("digest").alias("shared_digest"), "first"), "warc-shared")
    met = rows.join(shared, F.col("digest") == F.col("shared_digest"), "left")
    again = F.coalesce(order != F.col("first"), F.lit(False))
    return met.select("id", "url", "payload", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


def record_bytes(record_id: str, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record.  A revisit keeps the HTTP head, whose Content-Length is the full payload's."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{record_id}>",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if kind == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    return "\r\n".join([*head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _store(folder: str):
    """The file system of a folder in shared storage, and the folder's path there."""
    from pyarrow import fs

    if folder.startswith("/"):
        return fs.LocalFileSystem(), folder
    scheme, _, rest = folder.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + ":" + rest)


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes archive files, each one gzip stream over all its records, and returns archive (its path), bytes and records of each.

    Store the result before it is used: every evaluation writes files anew.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, size, press, out, count = TaskContext.get().partitionId(), 0, 0, None, None, 0
        store, path = _store(folder)

        def close():
            out.write(press.flush())
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64()), pa.array([count], pa.int64())], ["archive", "bytes", "records"])

        for batch in batches:
            columns = [batch.column(k) for k in range(6)]
            for k in range(batch.num_rows):
                key, url, payload, digest, kind, to = (c[k].as_py() for c in columns)
                raw = record_bytes("" if key is None else str(key), url, payload, digest, kind, to)
                if press is None:
                    name = f"part-{part:06d}-{n:06d}-{uuid.uuid4().hex[:12]}.warc.gz"
                    store.create_dir(path, recursive=True)
                    press, out, size, count = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), store.open_output_stream(f"{path}/{name}", compression=None), 0, 0
                out.write(press.compress(raw))
                size, count = size + len(raw), count + 1
                if size >= archive_bytes:
                    yield close()
                    press, n = None, n + 1
        if press is not None:
            yield close()

    return records.select("id", "url", "payload", "digest", "record_type", "refers_to").mapInArrow(run, "archive string, bytes long, records long")


def inflate(read: Callable[[int], bytes]) -> Iterator[bytes]:
    """The contents of a gzip file of one or more members, in pieces; what is cut off or broken ends it."""
    held = read(READ)
    while held:
        held = held.lstrip(b"\0")
        if len(held) < 2:
            more = read(READ)
            if not more:
                return
            held += more
            continue
        if held[:2] != b"\x1f\x8b":
            return
        press = zlib.decompressobj(31)
        while not press.eof:
            try:
                piece = press.decompress(held, PIECE)
            except zlib.error:
                return
            if piece:
                yield piece
            held = press.unused_data if press.eof else press.unconsumed_tail or (b"" if len(piece) == PIECE else read(READ))
            if not held and not press.eof and len(piece) < PIECE:
                return
        held = held or read(READ)


def split_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str] | None, bytes, bytes]]:
    """(headers, block, the record's bytes) of each whole record in a stream; headers are None for bytes that are no record."""
    held = bytearray()
    pieces = iter(pieces)

    def more() -> bool:
        piece = next(pieces, None)
        if piece is None:
            return False
        held.extend(piece)
        return True

    def stray() -> int:
        """How many bytes lie before the next record, or the end."""
        seen = 1
        while True:
            found = RECORD.search(held, seen)
            if found:
                return found.start()
            seen = max(1, len(held) - 16)
            if not more():
                return len(held)

    while True:
        while len(held) < 10 and more():
            pass
        if not held:
            return
        if not RECORD.match(held):
            if len(held) < 10 and b"WARC/1.1\r\n".startswith(bytes(held)):
                return
            n = stray()
            yield None, b"", bytes(held[:n])
            del held[:n]
            continue
        end = held.find(b"\r\n\r\n")
        while end < 0:
            seen = max(0, len(held) - 3)
            if not more():
                return
            end = held.find(b"\r\n\r\n", seen)
        headers = headers_of(bytes(held[:end]))
        said = headers.get("content-length", "")
        if not (said.isascii() and said.isdigit()):
            n = stray()
            yield None, b"", bytes(held[:n])
            del held[:n]
            continue
        body, size = end + 4, int(said)
        while len(held) < body + size + 4:
            if not more():
                return
        yield headers, bytes(held[body : body + size]), bytes(held[: body + size + 4])
        del held[: body + size + 4]


def headers_of(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    return {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in lines[1:])}


def normalise_archive(read: Callable[[int], bytes], write: Callable[[bytes], object]) -> Iterator[tuple[int, int, str | None, str | None]]:
    """Rewrites an archive with a gzip member for each record, and tells offset, length, type and id of each."""
    at = 0
    for headers, _, raw in split_records(inflate(read)):
        press = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        member = press.compress(raw) + press.flush()
        write(member)
        yield at, len(member), headers and headers.get("warc-type"), headers and headers.get("warc-record-id")
        at += len(member)


def normalise(archives: DataFrame, source: str, folder: str) -> DataFrame:
    """Writes archives of ``source`` anew into ``folder``, records apart, and returns the sidecar index: a row for each record.

    Store the result before it is used: every evaluation writes files anew.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(_INDEX_PA)], [n for n, _ in _INDEX_PA])

        old, old_path = _store(source)
        new, new_path = _store(folder)
        for batch in batches:
            for given in batch.column(0).to_pylist():
                name = f"{given.removesuffix('.warc.gz')}-{uuid.uuid4().hex[:12]}.warc.gz"
                new.create_dir(new_path, recursive=True)
                rows = []
                with old.open_input_stream(f"{old_path}/{given}", compression=None) as entry, new.open_output_stream(f"{new_path}/{name}", compression=None) as out:
                    for told in normalise_archive(entry.read, out.write):
                        rows.append((name, *told))
                        if len(rows) == INDEX_ROWS:
                            yield batch_of(rows)
                            rows = []
                yield batch_of(rows)

    names = archives.select("archive")
    return names.repartition(max(1, min(MOST_TASKS, names.count()))).mapInArrow(run, INDEX)


def parse_record(member: bytes) -> dict:
    """What a record says of its payload; a revisit's size comes from the HTTP head that it keeps."""
    headers, block, _ = next(split_records(iter([zlib.decompress(member, 31)])))
    head, _, payload = block.partition(b"\r\n\r\n")
    kind = headers["warc-type"]
    id_of = lambda x: int(x[10:-1]) if x and x[10:-1] else None  # noqa: E731  <urn:page:7>
    revisit = kind == "revisit"
    return {
        "id": id_of(headers.get("warc-record-id")),
        "url": headers.get("warc-target-uri"),
        "payload_bytes": int(headers_of(head)["content-length"]) if revisit else len(payload),
        "payload_digest": headers["warc-payload-digest"].partition(":")[2] if revisit else hashlib.sha256(payload).hexdigest(),
        "record_type": kind,
        "refers_to": id_of(headers.get("warc-refers-to")),
        "payload": None if revisit else payload,
    }


def read_records(index: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """Reads the records that rows of a sidecar index point at: id, url, payload_bytes, payload_digest, record_type, refers_to (and payload)."""
    fields = [("id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    schema = "id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    if with_payload:
        fields.append(("payload", pa.binary()))
        schema += ", payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        name, entry, rows, held = None, None, [], 0

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in fields], [n for n, _ in fields])

        for batch in batches:
            for archive, offset, length in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if archive != name:
                    if entry is not None:
                        entry.close()
                    name, entry = archive, store.open_input_file(f"{path}/{archive}")
                rows.append(parse_record(entry.read_at(length, offset)))
                if not with_payload:
                    rows[-1]["payload"] = None
                held += len(rows[-1]["payload"] or b"") + 300
                if held > ARCHIVE_BYTES:
                    yield batch_of()
                    rows, held = [], 0
        if entry is not None:
            entry.close()
        yield batch_of()

    return index.where("record_type IS NOT NULL").select("archive", "offset", "length").mapInArrow(run, schema)
