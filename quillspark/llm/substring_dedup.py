"""Removal of word windows that an earlier document already has, by recompression.

Rounds of pair naming replace adjacent symbols (x, y) by one globally named
symbol wherever x's coin is 0 and y's is 1. Names are hashes of the content, so
every executor gives a substring the same name without a dictionary shuffle, and
whether a boundary between symbols survives depends on a few words on each side
only: equal substrings have the same interior boundaries. A run of one word
has equal coins and stays as single symbols, so it keeps all its boundaries.

1. Each chunk of documents sends the names of the words around its surviving
   boundaries to hash buckets, which answer with those held by two chunks.
2. A window can repeat only if all its interior boundaries are shared. The
   few such windows are sent as 96-bit names (and their bucket) with the first
   document that has them; a bucket answers whether an earlier document exists.
3. Each chunk removes the words that repeated windows cover.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, exchange

#: Longest symbol after each round of pair naming, in words.
CAPS = (2, 4, 6)
#: Words on each side that decide whether a boundary survives all rounds.
MARGIN = 4


def boundaries(names: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Word positions at which symbols start after all rounds."""
    if not names.size:
        return np.zeros(0, np.int64)
    opens = np.zeros(names.size, bool)
    opens[bounds[:-1][bounds[:-1] < names.size]] = True
    at, symbol, length = np.arange(names.size), names, np.ones(names.size, np.int64)
    for level, cap in enumerate(CAPS):
        coin = common.mix(symbol ^ common.u64(0xA24BAED4963EE407 * (level + 1))) >> np.uint64(63)
        pair = (coin[:-1] == 0) & (coin[1:] == 1) & (length[:-1] + length[1:] <= cap) & ~opens[at[1:]]
        left = np.flatnonzero(pair)
        symbol, length = symbol.copy(), length.copy()
        symbol[left] = common.mix(symbol[left] * common.u64(0x9FB21C651E98DF25) + common.mix(symbol[left + 1]) + np.uint64(level))
        length[left] += length[left + 1]
        head = np.ones(at.size, bool)
        head[left + 1] = False
        at, symbol, length = at[head], symbol[head], length[head]
    return at


class Chunk:
    """What each pass derives from the same documents, in the same order."""

    def __init__(self, table: pa.Table, width: int, buckets: int):
        self.ids = common.ids_of(table.column("doc_id"))
        self.data, self.offsets = common.utf8(table.column("text"))
        starts, stops, self.bounds = common.words(self.data, self.offsets)
        self.n, self.width, self.buckets = starts.size, width, buckets
        self.a, self.b = common.word_names(self.data, starts, stops)
        row = common.row_of(self.bounds)
        self.doc, self.begin, self.end = self.ids[row], self.bounds[:-1][row], self.bounds[1:][row]
        at = boundaries(self.a, self.bounds)
        self.at = at[(at - MARGIN >= self.begin[at]) & (at + MARGIN <= self.end[at])] if at.size else at
        names = common.windows(self.a, 2 * MARGIN, 3)[self.at - MARGIN] if self.at.size else np.zeros(0, np.uint64)
        self.bucket, self.value, self.place = exchange.order(names, buckets, 40)

    def sent(self, chunk: int) -> pa.RecordBatch:
        return exchange.send(chunk, self.bucket, self.value, 5)

    def candidates(self, answers: pa.Table) -> np.ndarray:
        """Starts of windows with shared boundaries only."""
        if self.n < self.width:
            return np.zeros(0, np.int64)
        doc, lowest, highest = self.doc[self.at], np.full(self.value.size, 2**63 - 1), np.full(self.value.size, -(2**63))
        np.minimum.at(lowest, self.place, doc)
        np.maximum.at(highest, self.place, doc)
        shared = exchange.told(answers, 1, self.bucket) | (lowest != highest)
        alone = np.zeros(self.n + 1, np.int64)
        alone[self.at[~shared[self.place]] + 1] = 1
        alone = np.cumsum(alone)
        start = np.arange(self.n - self.width + 1)
        start = start[start + self.width <= self.end[start]]
        return start[alone[start + self.width - MARGIN + 1] == alone[start + MARGIN]]

    def repeats(self, answers: pa.Table):
        """Candidate windows: their starts, and bucket, value, more, first document and place of their distinct names."""
        start = self.candidates(answers)
        if not start.size:
            empty = np.zeros(0, np.int64)
            return start, empty, empty.astype(np.uint64), empty.astype(np.uint64), empty, empty
        a, b = common.windows(self.a, self.width, 5)[start], common.windows(self.b, self.width, 7)[start]
        bucket = ((b >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)
        more = b & np.uint64(0xFFFFFFFF)
        at = np.lexsort((more, a, bucket))
        x, y, z = bucket[at], a[at], more[at]
        new = np.ones(at.size, bool)
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (z[1:] != z[:-1])
        place = np.empty(at.size, np.int64)
        place[at] = np.cumsum(new) - 1
        first = np.minimum.reduceat(self.doc[start][at], np.flatnonzero(new))
        return start, x[new], y[new], z[new], first, place

    def removed(self, answers: pa.Table) -> np.ndarray:
        start, bucket, _, _, first, place = self.repeats(answers)
        earlier = exchange.told(answers, 2, bucket)
        return common.covered(start[earlier[place] | (self.doc[start] > first[place])], self.width, self.n)


def substring_dedup(docs: DataFrame, width: int = 13) -> DataFrame:
    """The rows of docs with n_words, n_removed (long) and kept_text (kept words joined by one space).

    A word is removed if a window of `width` words that covers it also starts in
    a document with a smaller doc_id; windows are judged on the input.
    Null or empty text: no words. Fewer words than `width`: nothing is removed.
    Null doc_id: ordered after all others. Rows with one doc_id do not remove
    each other's windows. Other columns, whatever their names, are passed
    through; n_words, n_removed and kept_text of the input are replaced.
    Empty table: empty result. A chunk of documents (see exchange.sizes) must fit in a task's memory.
    """
    docs = docs.drop("n_words", "n_removed", "kept_text")
    chunks, buckets = exchange.sizes(docs)
    key = common.fresh("chunk", [*docs.columns, "n_words", "n_removed", "kept_text"])
    rows = docs.select("*", common.chunk_id(chunks).alias(key))

    def announce(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([Chunk(table, width, buckets).sent(table.column(key)[0].as_py())])

    def windows(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return exchange._SENT.empty_table()
        _, bucket, a, more, first, _ = Chunk(table, width, buckets).repeats(answers)
        return pa.Table.from_batches([exchange.send(table.column(key)[0].as_py(), bucket, a, 8, first, more)])

    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return table.drop_columns([key]).append_column("n_words", pa.array([], pa.int64())).append_column("n_removed", pa.array([], pa.int64())).append_column("kept_text", pa.array([], pa.string()))
        c = Chunk(table, width, buckets)
        gone = c.removed(answers)
        total = np.r_[0, np.cumsum(gone)]
        lost = total[c.bounds[1:]] - total[c.bounds[:-1]]
        kept = []
        for text, k, a, b in zip(common.texts_of(c.data, c.offsets), lost.tolist(), c.bounds[:-1].tolist(), c.bounds[1:].tolist(), strict=True):
            own = text.split()
            kept.append(b" ".join(compress(own, ~gone[a:b]) if k else own).decode())
        return table.drop_columns([key]).append_column("n_words", pa.array(np.diff(c.bounds))).append_column("n_removed", pa.array(lost)).append_column("kept_text", pa.array(kept, pa.string()))

    out = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    names = rows.groupBy(key).applyInArrow(announce, exchange.SENT)
    shared = names.groupBy("bucket").applyInArrow(exchange.answer_shared(5, 1), exchange.ANSWER)
    seen = rows.groupBy(key).cogroup(shared.groupBy("chunk")).applyInArrow(windows, exchange.SENT)
    earlier = seen.groupBy("bucket").applyInArrow(exchange.answer_earlier(2), exchange.ANSWER)
    return rows.groupBy(key).cogroup(shared.unionAll(earlier).groupBy("chunk")).applyInArrow(remove, out)


def op2_substring_dedup(spark, sf_dir):
    found = substring_dedup(common.documents(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
