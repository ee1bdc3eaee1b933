"""Ranked lexical search, document at a time, over compressed postings in shards.

A shard holds the documents of a stretch of a partition: for each term its
documents in ascending order of doc_id, as gaps, and the term's occurrences,
both in bytes of seven bits. A query merges the postings of its terms with a
heap, so that a document is complete when the merge has passed it, and keeps the
best in a bounded heap keyed by score, then doc_id. Terms that together cannot
lift a document to the worst kept score take no part in the merge; they are
looked up where the others leave a chance. The shards' results are then merged.

Scores are integers: the weight of a term is floor(1000 ln((2N+2)/(2df+1))), a
document adds w * (10^9 tf div (1000 tf + 20 m)) with m = 50 + 50 n N div L.
"""

from __future__ import annotations

import heapq
import math
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Bytes of text of a shard, about; a longer text is a shard for itself.
SHARD_BYTES = 8 << 20
#: Queries of a block on average; a block is broadcast, and every shard sees every block.
BLOCK_ITEMS = 512
#: Documents of a stretch after which the terms that take part in the merge are chosen anew: first, and at most.
FIRST_STRETCH, LAST_STRETCH = 128, 4_096
#: Bits of a contribution, which is below 1000 ln(2^64) * 10^6.
_BITS = 36
#: Parts of a query's candidates that are ranked before they meet in one task.
SALTS = 64
_OTHER = np.zeros(256, bool)
_OTHER[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True

#: Of a shard: ids and lengths of its n documents by doc_id, its terms, the documents of each, where its postings end, these; and all lengths' sum.
INDEX = "doc_ids binary, lengths binary, terms array<binary>, found binary, ends binary, postings binary, n long, size long"


def terms_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The terms of all texts end to end: their bytes, the n + 1 offsets of the terms in them, and the bounds of the rows in the terms."""
    data, offsets = common.utf8(column, lower=True)
    solid = ~_OTHER[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    opens = offsets[:-1][offsets[:-1] < data.size]
    first[opens] = solid[opens]
    starts = np.flatnonzero(first)
    place = np.cumsum(solid)
    return data[solid], np.r_[place[starts] - 1, place[-1] if data.size else 0].astype(np.int64), np.searchsorted(starts, offsets)


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in bytes of seven bits, lowest first, the last below 128; and the size of each."""
    values = values.astype(np.uint64)
    size = np.ones(values.size, np.int64)
    for k in range(1, 10):
        size += values >= np.uint64(1 << (7 * k))
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if ends.size else 0, np.uint8)
    for k in range(int(size.max()) if size.size else 0):
        own = np.flatnonzero(size > k)
        byte = (values[own] >> np.uint64(7 * k)) & np.uint64(127)
        out[ends[own] - size[own] + k] = byte.astype(np.uint8) | ((size[own] > k + 1).astype(np.uint8) << 7)
    return out, size


def unpacked(raw: np.ndarray) -> np.ndarray:
    if not raw.size:
        return np.zeros(0, np.int64)
    last = raw < 128
    starts = np.r_[0, np.flatnonzero(last)[:-1] + 1]
    within = np.arange(raw.size) - np.repeat(starts, np.diff(np.r_[starts, raw.size]))
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * within), starts)


def shard(ids: np.ndarray, texts: pa.Array) -> pa.RecordBatch | None:
    """The row of INDEX of some documents; None if none of them has a term."""
    kept, offsets, bounds = terms_of(texts)
    n = np.diff(bounds)
    own = np.flatnonzero(n)
    if not own.size:
        return None
    order = own[np.argsort(ids[own], kind="stable")]
    place = np.zeros(n.size, np.int64)
    place[order] = np.arange(order.size)
    code, words = common.coded(kept, offsets)
    key, tf = np.unique(code.astype(np.int64) * order.size + place[common.row_of(bounds)], return_counts=True)
    term, doc = np.divmod(key, order.size)
    new = np.r_[True, term[1:] != term[:-1]]
    gap = doc.copy()
    gap[1:] -= np.where(new[1:], 0, doc[:-1])
    raw, size = packed(np.column_stack([gap, tf]).ravel())
    found = np.bincount(term, minlength=len(words))
    ends = np.cumsum(size)[2 * np.cumsum(found) - 1]
    row = [ids[order].astype("<i8").tobytes(), n[order].astype("<i8").tobytes(), words, found.astype("<i8").tobytes(), ends.astype("<i8").tobytes(), raw.tobytes(), order.size, int(n.sum())]
    kinds = [pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], [x.split()[0] for x in INDEX.split(", ")])


def build_index(docs: DataFrame) -> DataFrame:
    """A row of INDEX for each shard of documents that have a term.

    Null texts and texts without a term are in no shard. Each row of docs is a
    document of its own, also one that repeats or has no doc_id (kept as
    common.NULL_ID). No rows: no shards. Other columns have no effect.
    """
    common.arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in (part for whole in batches for part in common.slices(whole, "text", SHARD_BYTES // 4)):
            held.append(part)
            size += part.column(1).nbytes
            if size >= SHARD_BYTES:
                yield from _shards(held)
                held, size = [], 0
        yield from _shards(held)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, INDEX)


def _shards(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if parts:
        ids = np.concatenate([common.ids_of(p.column(0)) for p in parts])
        row = shard(ids, pa.concat_arrays([p.column(1).cast(pa.large_string()) for p in parts]))
        if row is not None:
            yield row


def parsed(items: DataFrame) -> DataFrame:
    """item (a number of the row), item_id and distinct terms of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for whole in batches for part in common.slices(whole, "text")):
            kept, offsets, bounds = terms_of(part.column(2))
            raw = kept.tobytes()
            words = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            own = [sorted(set(words[a:b])) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(own, pa.list_(pa.binary()))], ["item", "item_id", "terms"])

    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), "text")
    return rows.mapInArrow(run, "item long, item_id long, terms array<binary>").where(F.size("terms") > 0)


def _found(index: DataFrame, block: DataFrame, number: int) -> DataFrame:
    """term, df of the block's terms: counts of each task's shards, summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, total = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                if wanted is None:
                    wanted = batch.column(2).slice(i, 1).flatten()
                    total = np.zeros(len(wanted), np.int64)
                at = pc.index_in(wanted, value_set=batch.column(0).slice(i, 1).flatten()).fill_null(-1).to_numpy()
                found = np.frombuffer(batch.column(1)[i].as_buffer(), "<i8")
                total += np.where(at >= 0, found[at], 0)
        if wanted is not None:
            own = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([wanted.take(pa.array(own)), pa.array(total[own])], ["term", "df"])

    words = block.select("block", F.explode("terms").alias("term")).distinct().groupBy("block").agg(F.collect_list("term").alias("wanted"))
    beside = index.select("terms", "found", (F.pmod("n", F.lit(1)) + number).alias("block")).join(F.broadcast(words), "block")
    return beside.select("terms", "found", "wanted").mapInArrow(run, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))


class _Shard:
    """The postings of a block's terms in one shard."""

    def __init__(self, ids, lengths, words, found, ends, postings, weights: dict[bytes, int], documents: int, total: int):
        self.ids = np.frombuffer(ids, "<i8").tolist()
        n = np.frombuffer(lengths, "<i8")
        found, ends = np.frombuffer(found, "<i8"), np.frombuffer(ends, "<i8")
        wanted = list(weights)
        at = pc.index_in(pa.array(wanted, pa.binary()), value_set=words).fill_null(-1).to_numpy()
        own = np.flatnonzero(at >= 0)
        at = at[own]
        begin = np.r_[0, ends][at]
        values = unpacked(np.frombuffer(postings, np.uint8)[common.ranges(begin, ends[at] - begin)]).reshape(-1, 2)
        count = found[at]
        stops = np.cumsum(count)
        starts = stops - count
        total_gap = np.cumsum(values[:, 0])
        doc = total_gap - np.repeat((total_gap - values[:, 0])[starts], count) if count.size else total_gap
        if documents and int(n.max()) * 50 * documents >= 2**63:
            m = np.array([50 + 50 * x * documents // total for x in n.tolist()], np.int64)
        else:
            m = 50 + 50 * n * documents // total
        weight = np.repeat(np.array([weights[wanted[i]] for i in own.tolist()], np.int64), count)
        gain = weight * (1_000_000_000 * values[:, 1] // (1000 * values[:, 1] + 20 * m[doc]))
        self.keyed = doc << _BITS | gain
        self.most = dict(zip((wanted[i] for i in own.tolist()), np.maximum.reduceat(gain, starts).tolist() if count.size else [], strict=True))
        self.span = dict(zip(self.most, zip(starts.tolist(), stops.tolist(), strict=True), strict=True))
        self.lists: dict[bytes, list[int]] = {}
        self.flat: dict[bytes, array | None] = {}

    def list(self, term: bytes) -> list[int]:
        """The term's documents and what they gain, in one number each, ascending."""
        if term not in self.lists:
            a, b = self.span[term]
            self.lists[term] = self.keyed[a:b].tolist()
        return self.lists[term]

    def gain(self, term: bytes, doc: int) -> int:
        if term not in self.flat:
            a, b = self.span[term]
            if (b - a) * 8 < len(self.ids):
                self.flat[term] = None
            else:
                flat = np.zeros(len(self.ids), np.int64)
                flat[self.keyed[a:b] >> _BITS] = self.keyed[a:b] & ((1 << _BITS) - 1)
                self.flat[term] = array("q", flat.tobytes())
        flat = self.flat[term]
        if flat is not None:
            return flat[doc]
        own = self.list(term)
        at = bisect_left(own, doc << _BITS)
        return own[at] & ((1 << _BITS) - 1) if at < len(own) and own[at] >> _BITS == doc else 0

    def search(self, terms: list[bytes], best: list[tuple[int, int]], k: int) -> None:
        """Puts the shard's documents into the heap of the k best (score, -doc_id)."""
        own = sorted((t for t in terms if self.most.get(t)), key=self.most.get)
        below = [0]
        for t in own:
            below.append(below[-1] + self.most[t])
        ids, mask, at, step = self.ids, (1 << _BITS) - 1, 0, FIRST_STRETCH
        while own and at < len(ids):
            to = min(len(ids), at + step)
            least = best[0][0] if len(best) == k else 0
            free = 0  # terms 0 to free - 1 cannot reach the worst kept score together
            while free < len(own) and below[free + 1] < least:
                free += 1
            lists = []
            for t in own[free:]:
                full = self.list(t)
                a, b = bisect_left(full, at << _BITS), bisect_left(full, to << _BITS)
                if a < b:
                    lists.append(full[a:b])
            doc, score = -1, 0
            for keyed in (*heapq.merge(*lists), len(ids) << _BITS) if lists else ():
                if keyed >> _BITS != doc:
                    if doc >= 0 and score + below[free] >= least:
                        i = free
                        while i and score + below[i] >= least:
                            i -= 1
                            score += self.gain(own[i], doc)
                        if len(best) < k:
                            heapq.heappush(best, (score, -ids[doc]))
                        elif not i and (score, -ids[doc]) > best[0]:
                            heapq.heapreplace(best, (score, -ids[doc]))
                        least = best[0][0] if len(best) == k else 0
                    doc, score = keyed >> _BITS, 0
                score += keyed & mask
            at, step = to, min(2 * step, LAST_STRETCH)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _best(index: DataFrame, block: DataFrame, number: int, dfs: DataFrame, documents: int, total: int, k: int) -> DataFrame:
    """item, item_id, doc_id and score: of each task's shards, the k best documents of each query of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, best = None, {}, {}
        for batch in batches:
            for i in range(batch.num_rows):
                if items is None:
                    items = batch.column(8)[i].as_py()
                    weights = {x["term"]: weight(documents, x["df"]) for x in batch.column(9)[i].as_py()}
                    best = {x["item"]: [] for x in items}
                raw = [batch.column(c)[i].as_buffer() for c in (0, 1, 3, 4, 5)]
                own = _Shard(*raw[:2], batch.column(2).slice(i, 1).flatten(), *raw[2:], weights, documents, total)
                for x in items:
                    own.search(x["terms"], best[x["item"]], k)
        if items is not None:
            rows = [(x["item"], x["item_id"], -d if -d != int(common.NULL_ID) else None, s) for x in items for s, d in best[x["item"]]]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(4)], ["item", "item_id", "doc_id", "score"])

    beside = block.groupBy("block").agg(F.collect_list(F.struct("item", "item_id", "terms")).alias("items"))
    weights = dfs.groupBy((F.pmod("df", F.lit(1)) + number).alias("block")).agg(F.collect_list(F.struct("term", "df")).alias("dfs"))
    rows = index.withColumn("block", F.pmod("n", F.lit(1)) + number).join(F.broadcast(beside), "block").join(F.broadcast(weights), "block").drop("block")
    return rows.mapInArrow(run, "item long, item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents (text) of each row of items (item_id, text), all with a score above 0 if fewer.

    Equal scores go by ascending doc_id, rows without doc_id last; rows that
    repeat are documents and queries of their own. A null text or one without
    terms is no document, and as a query finds nothing; so do queries of other
    terms than the documents'. Queries go in blocks of about BLOCK_ITEMS, each
    of which meets every shard. No rows of either: no rows. Other columns have
    no effect.
    """
    index = common.saved(build_index(docs))
    documents, total = index.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    queries = common.saved(parsed(items))
    blocks = max(1, math.ceil(queries.count() / BLOCK_ITEMS))
    found = None
    for b in range(blocks):
        block = queries.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("long")).where(F.col("block") == b)
        own = common.saved(_best(index, block, b, common.saved(_found(index, block, b)), documents, total, k))
        found = own if found is None else found.unionAll(own)
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    salted = found.where("score > 0").withColumn("__salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
    some = salted.withColumn("__rank", F.row_number().over(Window.partitionBy("item", "__salt").orderBy(*order))).where(F.col("__rank") <= k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def op11_ranked_search(spark, sf_dir):
    return search(common.documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_SQL = {
    "op11_ranked_search": f"""with words as (select doc_id, unnest({_TERMS}) as term from documents),
counts as (select doc_id, term, count(*) as tf from words group by all),
lengths as (select doc_id, sum(tf)::bigint as n from counts group by doc_id),
totals as (select count(*) as big_n, sum(n)::bigint as big_l from lengths),
dfs as (select term, count(*) as df from counts group by term),
wanted as (select distinct item_id, unnest({_TERMS}) as term from benchmark),
scored as (select item_id, c.doc_id, sum(floor(1000 * ln((2 * big_n + 2) / (2 * df + 1)))::bigint * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l))))::bigint as score
from wanted join counts c using (term) join dfs using (term) join lengths using (doc_id) cross join totals group by item_id, c.doc_id),
ranked as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank, doc_id, score from scored where score > 0)
select * from ranked where rank <= 50"""
}
