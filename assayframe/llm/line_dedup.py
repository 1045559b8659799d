"""Line dedup over overlapping three-line windows.

Windows are runs of three consecutive lines that aren't blank, compared without
the white space around each line, by a 128-bit hash.  The first occurrence of a
window, by document id and then by place, stays; every later one covers its
three lines.  Covered places of a document are merged into spans, and the spans,
with the blank lines inside, go.

Repeats inside a document are found where the document is; only its distinct
windows are grouped, by count and least id (so a window that a third of all
documents hold costs one row a task), and only windows of two documents or more
are joined back, in a join whose hot keys the planner can split.

Defined results: a null text counts as empty and stays empty; documents of fewer
than three lines that aren't blank have no window; a null id counts as larger
than any other; different texts under one id (or none) are documents of their own, in
the order of their md5; rows equal in id and text own their windows together, so
none of them covers the other's.  Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

LINES = 3
BLANKS = b" \t\r\x0b\x0c"
_LARGEST = 2**63 - 1
#: Bytes of texts whose rows go on together.
FLUSH_BYTES = 8_000_000


def windows(raw: bytes) -> tuple[list[bytes], list[int], list[bytes]]:
    """A text's lines, the numbers of those that aren't blank, and the hash of the window that begins at each."""
    from xxhash import xxh3_128_digest

    lines = raw.split(b"\n")
    bare = [x.strip(BLANKS) for x in lines]
    places = [k for k, x in enumerate(bare) if x]
    said = [bare[k] for k in places]
    return lines, places, [xxh3_128_digest(b"\n".join(said[k : k + LINES])) for k in range(len(said) - LINES + 1)]


def split_repeats(hashes: list[bytes]) -> tuple[dict[bytes, int], list[int]]:
    """First place of each distinct window of a document, and the places of the others."""
    first: dict[bytes, int] = {}
    again = [k for k, h in enumerate(hashes) if first.setdefault(h, k) != k]
    return first, again


def merged(starts: list[int]) -> list[tuple[int, int]]:
    """Spans (first, last) of the places that windows beginning at ``starts`` cover."""
    out: list[tuple[int, int]] = []
    for s in sorted(starts):
        if out and s <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], s + LINES - 1))
        else:
            out.append((s, s + LINES - 1))
    return out


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    start, held = 0, 0
    for k, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        held += n or 0
        if held >= FLUSH_BYTES:
            yield batch.slice(start, k + 1 - start)
            start, held = k + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), raw.alias("raw"))
    return rows.withColumn("order", F.coalesce("id", F.lit(_LARGEST))).withColumn("mark", F.unhex(F.md5("raw")))


def dedupe_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id, text (what stays), n_lines, removed_lines and spans (first and last line number), a row for each row of ``docs``."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, 2):
                first = [split_repeats(windows(raw)[2])[0] for raw in batch.column(2).to_pylist()]
                lists = pa.array([[{"hash": h, "at": k} for h, k in x.items()] for x in first], pa.list_(pa.struct([("hash", pa.binary()), ("at", pa.int32())])))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["order", "mark", "windows"])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))]
        for whole in batches:
            for batch in _slices(whole, 1):
                rows = []
                for raw, lost in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    lines, places, hashes = windows(raw)
                    spans = [(places[a], places[b]) for a, b in merged([*split_repeats(hashes)[1], *(lost or [])])]
                    gone = {k for a, b in spans for k in range(a, b + 1)}
                    text = b"\n".join([x for k, x in enumerate(lines) if k not in gone]) if gone else raw
                    rows.append((text.decode(), len(lines), len(gone), [{"first": a, "last": b} for a, b in spans]))
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, k) for v, k in zip(zip(*rows), kinds)]], ["id", "text", "n_lines", "removed_lines", "spans"])

    keyed = _keyed(docs, id_col, text_col)
    found = keyed.select("order", "mark", "raw").mapInArrow(find, "order long, mark binary, windows array<struct<hash: binary, at: int>>")
    each = stored(found.select("order", "mark", F.explode("windows").alias("w")).select("order", "mark", "w.hash", "w.at"), "line-windows")
    each = each.withColumn("place", F.struct("order", "mark"))
    shared = each.groupBy("hash").agg(F.min("place").alias("owner"), F.max("place").alias("last")).where("owner < last")
    shared = stored(shared.select(F.col("hash").alias("shared_hash"), "owner"), "line-shared")
    # Merge joins at every size: what repeats grows with the input, so it's never sent to every executor.
    later = each.join(shared.hint("merge"), (F.col("hash") == F.col("shared_hash")) & (F.col("place") > F.col("owner")))
    lost = stored(later.groupBy(F.col("order").alias("o"), F.col("mark").alias("m")).agg(F.collect_set("at").alias("lost")), "line-lost")
    met = keyed.join(lost.hint("merge"), (F.col("order") == F.col("o")) & (F.col("mark") == F.col("m")), "left")
    schema = "id long, text string, n_lines long, removed_lines long, spans array<struct<first: long, last: long>>"
    return met.select("id", "raw", "lost").mapInArrow(remove, schema).withColumnRenamed("id", id_col)
