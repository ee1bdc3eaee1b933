"""Alignment of two tokenizers over the same bytes, and how many documents link each pair of ids.

Byte offsets at which tokens of both end cut a text into groups; all pairs of
tokens in a group are linked. A pair of ids is one packed integer. Each task
counts its documents' distinct pairs, the partial counts are partitioned by
range, sorted and summed over runs, and the sorted shards, written by Spark to
the shared folder, are mapped by the tasks that look their own pairs up in them
by binary search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, packing, piece_tokens

#: Bits of an id in a packed pair, and of a row's number beside it.
ID_BITS, ROW_BITS = 20, 22
#: Pairs of a group beyond which its repeated ids are taken together; pairs that are made at once.
LARGE_GROUP, AT_ONCE = 1 << 12, 1 << 22
#: Bytes of text that are aligned together.
PART = 1 << 20
#: Pairs that a task counts before it hands its counts on; pairs in a row of partial counts.
HELD, ROW = 1 << 21, 1 << 16
#: Partial counts of a shard on average; tokens for which the shards are read once.
SHARD, CHUNK = 1 << 21, 3 << 20

ALIGNED = "doc_id long, a binary, b binary, n_groups long, n_links long, groups_sha256 string, keys binary, counts binary"
_loaded: dict[tuple[str, str], Pair] = {}


class Pair:
    """Two tokenizers, A byte-level and B of pieces, with the bytes of their tokens; special strings in a text are plain text."""

    def __init__(self, byte_path: str, piece_path: str):
        self.a, self.b = packing.ByteTokens(byte_path), piece_tokens.PieceModel(piece_path)
        self.a.special, self.a.whole.encode_special_tokens = [], True
        top = max(self.a.bytes) + 1
        self.a_size = np.zeros(top, np.int64)
        self.a_size[list(self.a.bytes)] = [len(x) for x in self.a.bytes.values()]
        self.b_size = self.b.text_size
        if max(top, self.b_size.size) > 1 << ID_BITS:
            raise ValueError(f"ids of more than {ID_BITS} bits are not supported")
        self.a_kind, self.b_kind = ("<u2" if n <= 1 << 16 else "<u4" for n in (top, self.b_size.size))
        numbers = [str(i).encode() for i in range(max(top, self.b_size.size))]
        width = len(numbers[-1]) + 1
        self.digits = np.frombuffer(b"".join(x.rjust(width - 1) + b"," for x in numbers), np.uint8).reshape(-1, width)
        self.written = self.digits != 0x20

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and the bounds of the rows in them, and those of B. Rows that are null, empty or not covered by both have none."""
        spaced = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(pa.scalar(" ", texts.type), texts, pa.scalar("", texts.type)))
        size = np.diff(common.utf8(spaced)[1])
        a, at = self.a.encode(spaced)
        b, bt = self.b.encode(texts)
        inner = np.ones(b.size, bool)
        inner[bt[:-1]] = inner[bt[1:] - 1] = False
        b, bt = b[inner], bt - 2 * np.arange(bt.size)
        fits = (_sums(self.a_size[a], at) == size) & (_sums(self.b_size[b], bt) == size)
        return *_only(a, at, fits), *_only(b, bt, fits)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0, np.cumsum(values)][bounds])


def _only(ids: np.ndarray, bounds: np.ndarray, fits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if fits.all():
        return ids, bounds
    n = np.diff(bounds)
    return ids[np.repeat(fits, n)], np.r_[0, np.cumsum(n * fits)]


class Groups:
    """The groups of some rows' tokens, rows end to end."""

    def __init__(self, pair: Pair, a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray):
        self.a, self.at, self.b, self.bt = a.astype(np.int64), at, b.astype(np.int64), bt
        ends_a, ends_b = np.cumsum(pair.a_size[a]), np.cumsum(pair.b_size[b])
        mark = np.zeros((int(ends_a[-1]) if a.size else 0) + 1, np.int8)
        mark[ends_a] = 1
        mark[ends_b] += 1
        self.last_a, self.last_b = mark[ends_a] == 2, mark[ends_b] == 2
        self.of_a = np.cumsum(self.last_a) - self.last_a
        self.stop_a, self.stop_b = np.flatnonzero(self.last_a) + 1, np.flatnonzero(self.last_b) + 1
        self.start_a, self.start_b = (np.r_[0, x[:-1]].astype(np.int64) if x.size else x for x in (self.stop_a, self.stop_b))
        self.n_a, self.n_b = self.stop_a - self.start_a, self.stop_b - self.start_b
        self.bounds = np.searchsorted(self.start_a, at)

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
        """Rows, packed pairs and, where it is not always one, how often each: all links, some at a time."""
        large = self.n_a * self.n_b > LARGE_GROUP
        row = common.row_of(self.at)
        own = np.flatnonzero(~large[self.of_a]) if large.any() else np.arange(self.a.size)
        n = self.n_b[self.of_a[own]]
        total = np.cumsum(n)
        at = 0
        while at < own.size:
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + AT_ONCE, "right")))
            some, count = own[at:to], n[at:to]
            b = self.b[common.ranges(self.start_b[self.of_a[some]], count)]
            yield np.repeat(row[some], count), np.repeat(self.a[some] << ID_BITS, count) | b, None
            at = to
        rows = common.row_of(self.bounds)
        for g in np.flatnonzero(large).tolist():
            a, many_a = np.unique(self.a[self.start_a[g] : self.stop_a[g]], return_counts=True)
            b, many_b = np.unique(self.b[self.start_b[g] : self.stop_b[g]], return_counts=True)
            step = max(1, AT_ONCE // b.size)
            for i in range(0, a.size, step):
                keys = (a[i : i + step, None] << ID_BITS | b).ravel()
                yield np.full(keys.size, rows[g]), keys, (many_a[i : i + step, None] * many_b).ravel()

    def written(self, pair: Pair) -> list[str]:
        """SHA-256 of each row's groups as `a1,a2|b1;a3|b2,b3`; "" of a row without tokens."""
        n = self.a.size + self.b.size
        ids, sep = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
        place_a = np.arange(self.a.size) + self.start_b[self.of_a]
        of_b = np.cumsum(self.last_b) - self.last_b
        place_b = np.arange(self.b.size) + self.stop_a[of_b]
        ids[place_a], ids[place_b] = self.a, self.b
        sep[place_a[self.last_a]] = ord("|")
        sep[place_b[self.last_b]] = ord(";")
        chars = pair.digits[ids]
        chars[:, -1] = sep
        written = pair.written[ids]
        raw = chars[written].tobytes()
        edge = np.r_[0, np.cumsum(written.sum(1))][self.at + self.bt].tolist()
        return [hashlib.sha256(raw[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(edge[:-1], edge[1:], strict=True)]


def load(byte_path: str, piece_path: str) -> Pair:
    key = (byte_path, piece_path)
    if key not in _loaded:
        _loaded[key] = Pair(*key)
    return _loaded[key]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if keys.size else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if first.size else counts


def _documents_of(groups: Groups) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of the rows, and how many rows have each."""
    found = [np.unique(keys << ROW_BITS | rows) for rows, keys, _ in groups.links()]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    own = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
    return np.unique(own >> ROW_BITS, return_counts=True)


def _row(kind: str, values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    raw, width = values.astype(kind).tobytes(), np.dtype(kind).itemsize
    return pa.array([raw[width * x : width * y] for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary())


def align(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """Rows of ALIGNED: ids of both tokenizers, groups and links of each document (keys null), and partial counts of pairs (keys and counts, no ids).

    Null and empty texts, and texts that either tokenizer does not give back
    byte for byte, have no tokens. Each row is a document of its own. Other
    columns have no effect. Both files must be readable on the executors.
    """
    common.arrow_batches(docs.sparkSession)
    schema = pa.schema([(x.split()[0], {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}[x.split()[1]]) for x in ALIGNED.split(", ")])

    def handed(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        cuts = np.r_[np.arange(0, keys.size, ROW), keys.size]
        own = [pa.nulls(cuts.size - 1, f.type) for f in schema][:6]
        return pa.RecordBatch.from_arrays([*own, _row("<i8", keys, cuts), _row("<i8", counts, cuts)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, held = load(byte_path, piece_path), []
        for part in (part for whole in batches for part in common.slices(whole, "text", PART)):
            texts = pc.fill_null(part.column(1).cast(pa.large_string()), "")
            a, at, b, bt = pair.encode(texts)
            groups = Groups(pair, a, at, b, bt)
            held.append(_documents_of(groups))
            links = _sums(groups.n_a * groups.n_b, groups.bounds)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), _row(pair.a_kind, a, at), _row(pair.b_kind, b, bt), pa.array(np.diff(groups.bounds)), pa.array(links), pa.array(groups.written(pair)), *[pa.nulls(part.num_rows, pa.binary())] * 2],
                schema=schema,
            )
            if sum(x[0].size for x in held) >= HELD:
                held = [_summed(*map(np.concatenate, zip(*held, strict=True)))]
                if held[0][0].size >= HELD // 2:
                    yield handed(*held.pop())
        if held:
            yield handed(*_summed(*map(np.concatenate, zip(*held, strict=True))))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """key (A's id << ID_BITS | B's id) and n, the documents that hold the pair linked: a table in ranges of keys, each file sorted."""

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column(0), batch.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.int64(), len(x.as_buffer()) // 8, [None, x.as_buffer()]) for x in (keys, counts)], ["key", "n"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums over runs of equal keys, which may reach over batches."""
        key, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            key, n = np.r_[key, batch.column(0).to_numpy()], np.r_[n, batch.column(1).to_numpy()]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            key, n = key[first], np.add.reduceat(n, first)
            yield pa.RecordBatch.from_arrays([pa.array(key[:-1]), pa.array(n[:-1])], ["key", "n"])
            key, n = key[-1:], n[-1:]
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])

    spark = aligned.sparkSession
    partial = aligned.where(F.col("keys").isNotNull()).select("keys", "counts")
    size = (partial.agg(F.sum(F.length("keys"))).first()[0] or 0) // 8
    shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), size // SHARD)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1 << 16)
    try:
        rows = partial.mapInArrow(single, "key long, n long")
        return common.saved(rows.repartitionByRange(shards, "key").sortWithinPartitions("key").mapInArrow(runs, "key long, n long"))
    finally:
        common.arrow_batches(spark)


class Shards:
    """Sorted files of pairs and counts; each is mapped while its range is looked up."""

    def __init__(self, files: list[tuple[str, int, int]], local: bool):
        self.files, self.local = sorted(files, key=lambda x: x[1]), local

    @classmethod
    def of(cls, counts: DataFrame) -> Shards:
        """Files in a store that executors cannot open are sent to them by Spark."""
        spark: SparkSession = counts.sparkSession
        found = counts.groupBy(F.input_file_name().alias("file")).agg(F.min("key").alias("low"), F.max("key").alias("high")).collect()
        local = all(urlparse(r.file).scheme in ("", "file") for r in found)
        if not local:
            for r in found:
                spark.sparkContext.addFile(r.file)
        return cls([(unquote(urlparse(r.file).path), r.low, r.high) for r in found], local)

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Of ascending keys, all of which are in the files."""
        out = np.zeros(keys.size, np.int64)
        for file, low, high in self.files:
            a, b = np.searchsorted(keys, low), np.searchsorted(keys, high, "right")
            if a < b:
                table = pq.read_table(file if self.local else SparkFiles.get(file.rsplit("/", 1)[-1]), memory_map=True, partitioning=None)
                out[a:b] = table.column("n").to_numpy()[np.searchsorted(table.column("key").to_numpy(), keys[a:b])]
        return out


def scored(aligned: DataFrame, counts: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """Of each document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    n_best: links whose pair has the highest count of its A id, ties included;
    count_sum: the counts of all links' pairs. What is sent to the tasks besides
    names of files is one number for each id of A.
    """
    shards = Shards.of(counts)
    best = np.zeros(1 << ID_BITS, np.int64)
    for r in counts.groupBy(F.shiftright("key", ID_BITS).alias("a")).agg(F.max("n").alias("n")).collect():
        best[r.a] = r.n
    best = best[: int(np.flatnonzero(best)[-1]) + 1 if best.any() else 0].copy()
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = load(byte_path, piece_path)
        held, size = [], 0
        for batch in batches:
            sizes = np.r_[0, np.cumsum(pc.binary_length(batch.column(1)).to_numpy())] // np.dtype(pair.a_kind).itemsize
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + CHUNK // 4, "right")) - 1)
                held.append(batch.slice(at, to - at))
                size += int(sizes[to] - sizes[at])
                if size >= CHUNK:
                    yield from chunk(pair, held)
                    held, size = [], 0
                at = to
        yield from chunk(pair, held)

    def chunk(pair: Pair, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The parts' rows; pieces of links hold numbers of their distinct pairs."""
        kept = []
        for part in parts:
            a, at = _read(part.column(1), pair.a_kind)
            b, bt = _read(part.column(2), pair.b_kind)
            pieces = []
            for rows, keys, many in Groups(pair, a, at, b, bt).links():
                coded = pa.array(keys).dictionary_encode()
                pieces.append((rows.astype(np.int32), coded.indices.to_numpy(), coded.dictionary.to_numpy(), many))
            kept.append((part, np.diff(at), np.diff(bt), pieces))
        wanted = np.unique(np.concatenate([p[2] for *_, pieces in kept for p in pieces])) if any(x[3] for x in kept) else np.zeros(0, np.int64)
        count = shards.counts(wanted)
        for part, n_a, n_b, pieces in kept:
            n_best, total = np.zeros(n_a.size, np.int64), np.zeros(n_a.size, np.int64)
            for rows, index, keys, many in pieces:
                own = count[np.searchsorted(wanted, keys)]
                top = own == best[keys >> ID_BITS]
                own, top = own[index], top[index].astype(np.int64)
                if many is not None:
                    own, top = own * many, top * many
                first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
                total[rows[first]] += np.add.reduceat(own, first)
                n_best[rows[first]] += np.add.reduceat(top, first)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_a), pa.array(n_b), part.column(3), part.column(4), pa.array(n_best), pa.array(total), part.column(5)], [x.split()[0] for x in schema.split(", ")])

    return aligned.where(F.col("keys").isNull()).drop("keys", "counts").mapInArrow(run, schema)


def _read(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    size = pc.binary_length(column).to_numpy() // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(column.to_pylist()), kind), np.r_[0, np.cumsum(size)].astype(np.int64)


def alignment(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """scored() over all rows of docs. No rows: no rows."""
    aligned = common.saved(align(docs, byte_path, piece_path))
    return scored(aligned, pair_counts(aligned), byte_path, piece_path)


def op13_token_alignment(spark, sf_dir):
    import public_tokenizers

    return alignment(common.documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
