"""Numpy building blocks shared by the text operators of this subpackage.

Texts stay in Arrow's UTF-8 buffers: words, names (64-bit hashes) and windows
are computed for a whole batch at once, without a Python object per word.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import saved  # noqa: F401  used by the operators

#: Stands for a null doc_id: such rows order after every other document.
NULL_ID = np.int64(2**63 - 1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The lowest 0 to 8 bytes of eight.
_LOW = np.array([2 ** (8 * k) - 1 for k in range(9)], np.uint64)


def u64(x: int) -> np.uint64:
    return np.uint64(x & (2**64 - 1))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; a bijection, so distinct inputs stay distinct."""
    x = x ^ (x >> u64(33))
    x *= u64(0xFF51AFD7ED558CCD)
    x ^= x >> u64(33)
    x *= u64(0xC4CEB9FE1A85EC53)
    x ^= x >> u64(33)
    return x


def utf8(column: pa.Array | pa.ChunkedArray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array and the n + 1 offsets of the rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, buf = column.buffers()
    offsets = np.frombuffer(off, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(buf, np.uint8)[offsets[0] : offsets[-1]] if buf is not None and buf.size else np.zeros(0, np.uint8)
    return (_LOWER[data] if lower else data), offsets - offsets[0]


def ids_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return pc.fill_null(column.cast(pa.int64()), int(NULL_ID)).to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else ids_of(column.combine_chunks())


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of each row: byte starts, byte stops, and the n + 1 bounds of the rows in them."""
    if not data.size:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(offsets.size, np.int64)
    gap = _SPACE[data]
    left, right = np.empty_like(gap), np.empty_like(gap)
    left[0] = right[-1] = True
    left[1:], right[:-1] = gap[:-1], gap[1:]
    left[offsets[:-1][offsets[:-1] < data.size]] = True
    right[offsets[1:][offsets[1:] > 0] - 1] = True
    solid = ~gap
    starts = np.flatnonzero(solid & left)
    return starts, np.flatnonzero(solid & right) + 1, np.searchsorted(starts, offsets)


def word_names(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit halves of a name of each word; both together differ for different words.

    Up to 15 bytes are the name themselves, with their number, under bijections;
    longer words have the BLAKE2b hash of 128 bits.
    """
    size = stops - starts
    wide = np.zeros(data.size + 16, np.uint8)
    wide[: data.size] = data
    eight = np.ndarray(data.size + 9, "<u8", wide.data, strides=(1,))
    low = eight[starts] & _LOW[np.minimum(size, 8)]
    high = (eight[starts + 8] & _LOW[np.clip(size - 8, 0, 7)]) | (size.astype(np.uint64) << np.uint64(56))
    a, b = mix(low ^ mix(high + u64(0x9E3779B97F4A7C15))), mix(high ^ u64(0xD1B54A32D192ED03))
    long = np.flatnonzero(size > 15)
    if long.size:
        raw, known = data.tobytes(), {}
        for i, x, y in zip(long.tolist(), starts[long].tolist(), stops[long].tolist(), strict=True):
            word = raw[x:y]
            if (name := known.get(word)) is None:
                name = known[word] = struct.unpack("<QQ", hashlib.blake2b(word, digest_size=16).digest())
            a[i], b[i] = name
    return a, b


def coded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The number of each span among the distinct ones, and these: spans lie end to end. Compared byte by byte."""
    spans = pa.Array.from_buffers(pa.large_binary(), offsets.size - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    found = spans.dictionary_encode()
    return found.indices.to_numpy(), found.dictionary.to_pylist()


def windows(names: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A name for every `width` consecutive names; the caller drops those that cross rows.

    Each place in the window has an odd factor of its own, so that no pattern of two names in turn can cancel out.
    """
    if names.size < width:
        return np.zeros(0, np.uint64)
    factors = np.random.default_rng((977, seed, width)).integers(1, 2**63, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.full(names.size - width + 1, u64(seed))
    for k in range(width):
        out += names[k : k + out.size] * factors[k]
    return mix(out)


def row_of(bounds: np.ndarray) -> np.ndarray:
    """The row of each item, from the n + 1 bounds."""
    return np.repeat(np.arange(bounds.size - 1), np.diff(bounds))


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n items lie in [start, start + width) for any of the distinct starts, of which none reaches beyond n."""
    edge = np.zeros(n + 1, np.int8)
    edge[starts] = 1
    edge[starts + width] -= 1
    return np.cumsum(edge[:-1], dtype=np.int64) > 0


def ranges(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... n values for each of both, in one array."""
    ends = np.cumsum(n)
    return np.repeat(begin - (ends - n), n) + np.arange(ends[-1] if ends.size else 0)


class Units:
    """Token ids of texts that are cut into units which are encoded for themselves; frequent units are remembered."""

    def __init__(self, memo: int, longest: int = 64):
        self.memo, self.longest, self.known = memo, longest, {}

    def ids(self, data: np.ndarray, starts: np.ndarray, offsets: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the bounds of the rows in them. Units reach from each start to the next or the end;
        encode: gets a list of new units (bytes), returns their ids as little-endian unsigned 32-bit integers."""
        at, units = coded(data, np.r_[starts, data.size]) if starts.size else (np.zeros(0, np.int64), [])
        known = self.known
        found = [known.get(x) for x in units]
        new = [i for i, x in enumerate(found) if x is None]
        if len(known) + len(new) > self.memo:
            known.clear()
        for i, x in zip(new, encode([units[i] for i in new]), strict=True):
            found[i] = x
            if len(units[i]) < self.longest and len(known) < self.memo:
                known[units[i]] = x
        size = np.array([len(x) // 4 for x in found], np.int64)
        begin, n = np.cumsum(size) - size, size[at]
        out = np.frombuffer(b"".join(found), "<u4")[ranges(begin[at], n)]
        return out, np.r_[0, np.cumsum(n)][np.searchsorted(starts, offsets)]


def texts_of(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20):
    """Parts of a batch with so many bytes of text at most, or one row: arrays over characters stay small beside long texts."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column)).cast(pa.large_string())), 0).to_numpy(zero_copy_only=False)
    total, at = np.r_[0, np.cumsum(sizes)], 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(total, total[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def arrow_batches(spark: SparkSession) -> None:
    """Rows that Python workers get at once: one number for all operators, as plans run after they are built; long texts are divided by slices()."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1024)


def fresh(name: str, columns: list[str]) -> str:
    """A column name that is not in use, in whatever case."""
    used = {c.lower() for c in columns}
    while name.lower() in used:
        name += "_"
    return name


#: Rows of a key that one task may get; more are spread. Keys that are spread, at most.
HOT_ROWS, HOT_KEYS = 16_384, 65_536


def join_counted(rows: DataFrame, counted: DataFrame, key: str, salt: Column) -> DataFrame:
    """rows with the row of counted (one for each key, n: the rows that have it) of their key, null if none.

    Keys with more than HOT_ROWS rows, or than their share of HOT_KEYS, are
    spread over as many salts as that takes; these keys are HOT_KEYS at most,
    which is the bound of what is broadcast.
    """
    total = counted.agg(F.sum("n")).first()[0] or 0
    most = max(HOT_ROWS, total // HOT_KEYS)
    salts = F.ceil(F.col("n") / most).cast("int")
    hot = counted.where(F.col("n") > most).select(key, salts.alias("__salts"))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("__salt", F.coalesce(F.pmod(salt, F.col("__salts")), F.lit(0)).cast("int")).drop("__salts")
    spread = counted.withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("n")
    return dealt.join(spread, [key, "__salt"], "left").drop("__salt")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text", "lang", "source", "n_chars")))


def chunk_id(chunks: int) -> Column:
    """By doc_id; rows without one are dealt by their text."""
    return F.pmod(F.xxhash64(F.col("doc_id"), F.when(F.col("doc_id").isNull(), F.col("text"))), F.lit(chunks)).cast("int")
