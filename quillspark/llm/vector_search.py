"""Nearest neighbours by score-aware product quantisation and exact reranking.

The ranking by Euclidean distance is that of |x|^2 / 2 - <q, x>, so what must be
estimated well are inner products. Codes are chosen to minimise
|r|^2 + (ETA - 1) <r, x>^2 / |x|^2 with r = x - code(x): the residual along x,
which moves the products with near queries, is penalised ETA-fold. Codes have
four bits for each pair of dimensions, two in a byte; queries are scored with a
table of 256 products for each byte, and the best are measured exactly.

Vectors are dealt once, to the cell of their nearest centre; a query goes to the
PROBES nearest cells. Up to PROBES * CELL vectors these are all cells. Cells are
divided into blocks of bounded size, each scanned in one task. Equal vectors are
one row with the smallest of their ids, so no number of copies makes a block hot.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Weight of the parallel residual; vectors that codebooks and cells are fitted on, at most; passes of fitting.
ETA, SAMPLE, PASSES = 4.0, 4096, 3
CELL_SAMPLE, CELL_PASSES = 16_384, 8
#: Vectors of a cell, about; most cells; cells that a query is compared with.
CELL, MOST_CELLS, PROBES = 16_384, 4096, 64
#: Vectors and bytes of a block, at most; queries of a part, about; candidates of a block that are measured exactly.
BLOCK, BLOCK_BYTES, QUERIES, RERANK = 32_768, 64 << 20, 16_384, 512


class Codebooks:
    """16 codes for each of `parts` slices of the dimensions."""

    def __init__(self, sample: np.ndarray, seed: int = 7):
        self.dim = sample.shape[1]
        self.parts = max(2, (self.dim + 3) // 4 * 2)
        self.width = -(-self.dim // self.parts)
        self.size = self.parts * self.width
        x = self.padded(sample.astype(np.float64)).reshape(len(sample), self.parts, self.width)
        rng = np.random.default_rng(seed)
        self.codes = np.zeros((self.parts, 16, self.width))
        if not len(x):
            return
        for p in range(self.parts):
            c = x[rng.integers(0, len(x), 16), p].copy()
            for _ in range(6):
                near = ((x[:, p, None] - c) ** 2).sum(2).argmin(1)
                for k in range(16):
                    if (near == k).any():
                        c[k] = x[near == k, p].mean(0)
            self.codes[p] = c
        for _ in range(PASSES):
            self._refit(x, self._assign(x))

    def padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.size - self.dim)))

    def _assign(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes by coordinate descent on the score-aware loss."""
        unit = x / np.maximum(np.linalg.norm(x.reshape(len(x), -1), axis=1), 1e-30)[:, None, None]
        loss = np.stack([((x[:, p, None] - self.codes[p]) ** 2).sum(2) for p in range(self.parts)], 1)
        along = np.stack([((x[:, p, None] - self.codes[p]) * unit[:, p, None]).sum(2) for p in range(self.parts)], 1)
        code = loss.argmin(2)
        rows = np.arange(len(x))
        total = np.take_along_axis(along, code[:, :, None], 2)[:, :, 0].sum(1)
        for _ in range(sweeps):
            for p in range(self.parts):
                rest = total - along[rows, p, code[:, p]]
                code[:, p] = (loss[:, p] + (ETA - 1) * (rest[:, None] + along[:, p]) ** 2).argmin(1)
                total = rest + along[rows, p, code[:, p]]
        return code

    def _refit(self, x: np.ndarray, code: np.ndarray) -> None:
        """The codes that minimise the loss for given assignments: one linear system."""
        n, m = len(x), self.parts * 16 * self.width
        unit = x / np.maximum(np.linalg.norm(x.reshape(n, -1), axis=1), 1e-30)[:, None, None]
        slot = (np.arange(self.parts) * 16 + code)[:, :, None] * self.width + np.arange(self.width)
        a = np.zeros((n, m))
        np.put_along_axis(a, slot.reshape(n, -1), unit.reshape(n, -1), 1)
        count, total = np.bincount(slot.ravel(), minlength=m), np.bincount(slot.ravel(), x.ravel(), m)
        left = (ETA - 1) * a.T @ a + np.diag(count + 1e-6)
        right = total + (ETA - 1) * a.T @ (unit * x).sum((1, 2)) + 1e-6 * self.codes.ravel()
        self.codes = np.linalg.solve(left, right).reshape(self.codes.shape)

    def pack(self, x: np.ndarray) -> np.ndarray:
        """Two codes in each byte."""
        out = np.empty((len(x), self.parts // 2), np.uint8)
        for i in range(0, len(x), 2048):
            own = x[i : i + 2048].astype(np.float64)
            code = self._assign(self.padded(own).reshape(len(own), self.parts, self.width))
            out[i : i + 2048] = code[:, ::2] << 4 | code[:, 1::2]
        return out

    def tables(self, q: np.ndarray) -> np.ndarray:
        """For each byte of a code, its 256 products with the query."""
        t = np.einsum("pkw,pw->pk", self.codes, self.padded(q[None]).reshape(self.parts, self.width))
        return (t[::2, :, None] + t[1::2, None, :]).reshape(self.parts // 2, 256)


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision; where squares overflow, with differences scaled by a power of two."""
    with np.errstate(over="ignore", invalid="ignore"):
        out = np.sqrt(((x - q) ** 2).sum(1))
        for i in np.flatnonzero(~np.isfinite(out)):
            half = x[i] / 2 - q / 2  # cannot overflow
            unit = 2.0 ** np.floor(np.log2(np.abs(half).max()))
            out[i] = np.sqrt(((half / unit) ** 2).sum()) * unit * 2
    return out


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    parts = [np.frombuffer(x, "<f8") for x in column.to_pylist()]
    return np.stack(parts) if parts else np.zeros((0, dim))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (array of double) of the vectors that take part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long"), v.alias("v")).where("vec_id is not null and v is not null").where(fine)


def centres(x: np.ndarray, n: int, seed: int = 3) -> np.ndarray:
    """n centres of a sample by Lloyd's iteration."""
    c = x[np.random.default_rng(seed).permutation(len(x))[:n]].copy()
    for _ in range(CELL_PASSES if len(c) > 1 else 0):
        near = nearest(x, c, 1)[:, 0]
        count = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[count > 0] = total[count > 0] / count[count > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centres of each row."""
    n, out = min(n, len(c)), []
    for i in range(0, len(x), 1024):
        away = (c**2).sum(1) - 2 * x[i : i + 1024] @ c.T
        out.append(np.argpartition(away, n - 1, axis=1)[:, :n] if n < len(c) else np.tile(np.arange(len(c)), (len(away), 1)))
    return np.concatenate(out) if out else np.zeros((0, n), np.int64)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, cells: int | None = None, probes: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest vectors; score is the Euclidean distance in double precision.

    vectors, queries: vec_id and embedding. Null, zero, or non-finite vectors,
    null ids, and vectors that have not the most frequent number of dimensions
    take no part. A query's own id is not among its candidates. Ties: smaller
    vec_id first, also among any number of equal vectors. Repeated rows are
    candidates each; repeated queries are one. Fewer than k candidates: all.
    Empty table: empty result. Codebooks are fitted on at most SAMPLE vectors,
    cells on CELL_SAMPLE (those of smallest id hash); every vector is coded and
    in a cell. Other columns have no effect. cells: their number, by default
    one for CELL vectors. probes: cells that a query looks at, by default
    PROBES or, if that is more, a quarter of all, at which vectors without any
    clusters were found with a recall of 0.92. Components may have any finite
    size.
    """
    spark = vectors.sparkSession
    rows, asked = usable(vectors), usable(queries)
    most = F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("most")
    top = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), most).orderBy(F.desc("n"), "d").limit(100).collect()
    dim, total = (top[0].d, top[0].n) if top else (1, 0)
    # estimates are made of vectors divided by the power of two above all components, so that no product overflows
    small = 2.0 ** -min(1022, int(np.frexp(top[0].most)[1])) if top else 1.0
    rows, asked = rows.where(F.size("v") == dim), asked.where(F.size("v") == dim).distinct()
    cells = min(MOST_CELLS, cells or max(1, total // CELL))
    probes = probes or max(PROBES, cells // 4)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE if cells == 1 else CELL_SAMPLE).collect()
    sample = np.array([r.v for r in sample], np.float64).reshape(-1, dim) * small
    books, centre = Codebooks(sample[:SAMPLE]), centres(sample, cells) if len(sample) else np.zeros((1, dim))
    size = max(1, min(BLOCK, BLOCK_BYTES // (8 * dim), max(1024, total // 48)))
    common.arrow_batches(spark)

    # equal vectors as one row: the k + 1 smallest ids (one may be the query's own), each with its number of rows
    held = rows.groupBy("v", "vec_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"))
    first = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    held = held.withColumn("place", first).where(F.col("place") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list(F.struct("vec_id", "n"))).alias("ids"))

    def matrix(column) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(-1, dim)

    def deal(batches):
        for b in batches:
            x = matrix(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(nearest(x * small, centre, 1)[:, 0], pa.int32()), pa.array([v.tobytes() for v in x], pa.binary()), b.column(1)], ["cell", "v", "ids"])

    def aim(batches):
        for b in batches:
            x = matrix(b.column(1))
            near = nearest(x * small, centre, probes)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(near.tolist(), pa.list_(pa.int32()))], ["vec_id", "v", "cells"])

    def scan(data: pa.Table, asked: pa.Table) -> pa.Table:
        # in the order of ids, so that ties of estimates do not depend on how rows arrive
        ids = data.column("ids").combine_chunks()
        begin, flat = ids.offsets.to_numpy() - (ids.offsets[0].as_py() if len(ids) else 0), ids.flatten()
        own_id, own_n = flat.field("vec_id").to_numpy(), flat.field("n").to_numpy()
        order = np.argsort(own_id[begin[:-1]], kind="stable") if len(ids) else np.zeros(0, np.int64)
        x = _matrix(data.column("v"), dim)[order]
        codes = books.pack(x * small)
        half = ((x * small) ** 2).sum(1) / 2
        out_q, out_v, out_s = [], [], []
        for q_id, q in zip(asked.column("vec_id").to_pylist(), _matrix(asked.column("v"), dim), strict=True):
            if not order.size:
                break
            score = half.copy()
            for j, t in enumerate(books.tables(q * small)):
                score -= t[codes[:, j]]
            n = min(RERANK, order.size) - 1
            near = np.flatnonzero(score <= np.partition(score, n)[n])
            exact = distances(x[near], q)
            # one more than k, as one may have the query's own id only
            best = near[np.argsort(exact, kind="stable")[: k + 1]] if near.size <= k + 1 else near[np.flatnonzero(exact <= np.partition(exact, k)[k])]
            away = exact[np.searchsorted(near, best)]
            a, b = begin[order[best]], begin[order[best] + 1]
            at = common.ranges(a, b - a)
            v, s, times = own_id[at], np.repeat(away, b - a), own_n[at]
            times[v == q_id] = 0
            v, s = np.repeat(v, times), np.repeat(s, times)
            kept = np.lexsort((v, s))[:k]
            out_q.append(np.full(kept.size, q_id))
            out_v.append(v[kept])
            out_s.append(s[kept])
        join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0), kind)
        return pa.table([join(out_q, pa.int64()), join(out_v, pa.int64()), join(out_s, pa.float64())], ["query_id", "vec_id", "score"])

    data = common.saved(held.select("v", "ids").mapInArrow(deal, "cell int, v binary, ids array<struct<vec_id:long,n:int>>"))
    aimed = asked.select("vec_id", "v").mapInArrow(aim, "vec_id long, v binary, cells array<int>")
    # at most MOST_CELLS rows
    blocks = data.groupBy("cell").agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))
    parts = max(1, asked.count() * min(probes, cells) // cells // QUERIES)
    data = data.join(F.broadcast(blocks), "cell").withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
    data = data.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select("cell", "block", "part", "v", "ids")
    aimed = aimed.select("vec_id", "v", F.explode("cells").alias("cell")).join(F.broadcast(blocks), "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    aimed = aimed.select("cell", "block", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("part"), "vec_id", "v")
    key = ("cell", "block", "part")
    found = data.groupBy(*key).cogroup(aimed.groupBy(*key)).applyInArrow(scan, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_vector_search(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, vectors.where("vec_id % 100 = 0"))
