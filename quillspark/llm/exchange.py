"""Exchange of packed hash lists between chunks of documents and hash buckets.

A chunk (documents with one hash remainder of doc_id) sends each bucket one row
with the sorted distinct names it holds; a bucket answers one bit for each name.
A name that a third of all documents hold is sent once by each chunk, so no
bucket grows with the copies of a text, and the answers are bits.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SENT = "bucket int, chunk int, names binary, firsts binary"
ANSWER = "kind int, bucket int, chunk int, bits binary"
_ANSWER = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.int32()), ("bits", pa.binary())])
_SENT = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("names", pa.binary()), ("firsts", pa.binary())])


#: Bytes of text of a chunk, about; bytes of text whose names one bucket gets.
CHUNK_BYTES, BUCKET_BYTES = 32 << 20, 256 << 20


def sizes(docs: DataFrame, most: int = 4_096) -> tuple[int, int]:
    """Chunks and buckets for the texts of docs: chunks of 64 to `most` documents and CHUNK_BYTES at most on average, a bucket for BUCKET_BYTES.

    A chunk sends a row to each bucket, so both are as large as a task may hold.
    """
    rows, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    per = min(most, max(64, rows // 2_000))
    return max(1, math.ceil(rows / per), math.ceil(size / CHUNK_BYTES)), max(128, size // BUCKET_BYTES)


def bucket_of(names: np.ndarray, buckets: int) -> np.ndarray:
    return ((names & np.uint64(0xFFFFFF)) % np.uint64(buckets)).astype(np.int64)


def order(names: np.ndarray, buckets: int, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct names by bucket and value: bucket, value, and the place of each input name in them.

    keep: bits of a name that are sent besides those that choose its bucket.
    """
    bucket = bucket_of(names, buckets)
    value = (names >> np.uint64(24)) if keep == 40 else names
    # buckets are fewer than 2**24: with 40 bits of a value both are one integer
    at = np.argsort((bucket.astype(np.uint64) << np.uint64(40)) | value) if keep == 40 else np.lexsort((value, bucket))
    b, v = bucket[at], value[at]
    new = np.ones(at.size, bool)
    new[1:] = (b[1:] != b[:-1]) | (v[1:] != v[:-1])
    place = np.empty(at.size, np.int64)
    place[at] = np.cumsum(new) - 1
    return b[new], v[new], place


def send(chunk: int, bucket: np.ndarray, value: np.ndarray, width: int, firsts: np.ndarray | None = None, more: np.ndarray | None = None) -> pa.RecordBatch:
    """One row for each bucket; width: bytes sent of a value; more: four more bytes of each name."""
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if bucket.size else np.zeros(0, np.int64)
    ends = np.r_[cuts[1:], bucket.size][: cuts.size]
    raw = value.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    if more is not None:
        raw = np.hstack([raw, more.astype("<u4").view(np.uint8).reshape(-1, 4)])
    first = np.zeros((bucket.size, 0), np.uint8)
    if firsts is not None:  # four bytes of a document's id where that is enough for the chunk
        small = firsts.size == 0 or 0 <= firsts.min() and firsts.max() < 2**32
        first = firsts.astype("<u4" if small else "<i8").view(np.uint8).reshape(bucket.size, 4 if small else 8)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(bucket[cuts].astype(np.int32)),
            pa.array(np.full(cuts.size, chunk, np.int32)),
            pa.array([raw[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()),
            pa.array([first[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()),
        ],
        schema=_SENT,
    )


def send_rows(chunk: int, bucket: np.ndarray, rows: np.ndarray, note: bytes) -> pa.RecordBatch:
    """One row for each bucket with its part of a record array."""
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if bucket.size else np.zeros(0, np.int64)
    ends = np.r_[cuts[1:], bucket.size][: cuts.size]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(bucket[cuts].astype(np.int32)),
            pa.array(np.full(cuts.size, chunk, np.int32)),
            pa.array([rows[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()),
            pa.array([note] * cuts.size, pa.binary()),
        ],
        schema=_SENT,
    )


def answer_shared(width: int, kind: int):
    """For a bucket: which names come from two chunks or more."""

    def run(table: pa.Table) -> pa.Table:
        raw = table.column("names").to_pylist()
        n = np.array([len(x) // width for x in raw])
        full = np.zeros((n.sum(), 8), np.uint8)
        full[:, :width] = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, width)
        value = full.view("<u8")[:, 0]
        at = np.argsort(value, kind="stable")
        v = value[at]
        same = v[1:] == v[:-1]
        bit = np.zeros(v.size, bool)
        bit[at[1:][same]] = bit[at[:-1][same]] = True
        return _answers(table, kind, bit, n)

    return run


def answer_earlier(kind: int):
    """For a bucket: which 12-byte names have an earlier first document in another chunk."""

    def run(table: pa.Table) -> pa.Table:
        raw = table.column("names").to_pylist()
        n = np.array([len(x) // 12 for x in raw])
        full = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, 12)
        value = np.ascontiguousarray(full[:, :8]).view("<u8")[:, 0]
        more = np.ascontiguousarray(full[:, 8:]).view("<u4")[:, 0]
        first = np.concatenate([np.frombuffer(x, "<u4" if len(x) == 4 * k else "<i8").astype(np.int64) for x, k in zip(table.column("firsts").to_pylist(), n, strict=True)])
        at = np.lexsort((first, more, value))
        v, m, f = value[at], more[at], first[at]
        new = np.ones(v.size, bool)
        new[1:] = (v[1:] != v[:-1]) | (m[1:] != m[:-1])
        bit = np.zeros(v.size, bool)
        bit[at] = f > f[new][np.cumsum(new) - 1]
        return _answers(table, kind, bit, n)

    return run


def _answers(table: pa.Table, kind: int, bit: np.ndarray, n: np.ndarray) -> pa.Table:
    ends = np.cumsum(n)
    bits = [np.packbits(bit[b - k : b]).tobytes() for b, k in zip(ends, n, strict=True)]
    return pa.table([pa.array(np.full(len(bits), kind, np.int32)), table.column("bucket").cast(pa.int32()), table.column("chunk").cast(pa.int32()), pa.array(bits, pa.binary())], schema=_ANSWER)


def told(table: pa.Table, kind: int, bucket: np.ndarray) -> np.ndarray:
    """The answered bits in the order in which the chunk's names were sent."""
    by = {b: x for k, b, x in zip(table.column("kind").to_pylist(), table.column("bucket").to_pylist(), table.column("bits").to_pylist(), strict=True) if k == kind}
    out = np.zeros(bucket.size, bool)
    if bucket.size:
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        for a, b in zip(cuts, np.r_[cuts[1:], bucket.size], strict=True):
            out[a:b] = np.unpackbits(np.frombuffer(by[int(bucket[a])], np.uint8), count=b - a)
    return out
