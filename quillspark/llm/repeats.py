"""Removal of byte strings that occurred earlier, by suffix arrays of shards.

Strings of WIDTH bytes are judged. A shard is a chunk of documents.

1. Anchors: in every string the GRAM-byte string of smallest hash (the first of
   equals). Equal strings have equal anchors, so a string repeats only if its
   anchor does; buckets of anchor hashes answer which ones two shards hold.
2. Consecutive strings with one anchor form a region. Shards send the names of
   regions with shared anchors. A bucket answers whether an equal region comes
   earlier (then all its strings are repeats), and whether the anchor has
   several different regions; the inside of long copies is settled here.
3. Of the regions that do not repeat as a whole, a shard takes those whose anchor
   has other regions or that it holds twice, builds their suffix array by
   Larsson-Sadakane refinement, and common prefixes by the rule of Kasai: equal
   strings of the shard, compared byte by byte. The first one of each, where the
   anchor has several regions, is sent as a 96-bit name with its place, in
   sorted lists, which a bucket merges by binary search to find earlier ones.
4. Each shard removes the bytes that repeated strings cover.

Names stand for strings in the exchange since the strings themselves would
be fifty times the input. Hot texts are sent once by a shard, whatever the
number of their copies; strings around them differ and go to different buckets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, exchange

WIDTH, GRAM = 100, 50
_REGION = [("key", "<u8"), ("name", "<u8")]
_STRING = [("key", "<u8"), ("name", "<u4")]
NOTE = b"again"
#: Bytes of text for which hashes are made at once: arrays of eight bytes for each stay in a core's cache.
_BLOCK = _PART = 1 << 15


class ByteHasher:
    """Hashes of many spans of one byte array from prefix sums of a polynomial mod 2**64."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.base = int(rng.integers(0, 2**63)) * 2 + 1
        self.byte = rng.integers(1, 2**64, 256, dtype=np.uint64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if n > self.up.size:
            n = max(n, 2 * _BLOCK, 2 * self.up.size)
            for name, b in (("up", self.base), ("down", pow(self.base, -1, 2**64))):
                p = np.full(n, common.u64(b))
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=np.uint64))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._powers(data.size + 1)
        total = np.zeros(data.size + 1, np.uint64)
        np.cumsum(self.byte[data] * self.up[: data.size], out=total[1:])
        return total

    def spans(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """starts and stops ascending; spans may overlap."""
        out, i = np.empty(starts.size, np.uint64), 0
        while i < starts.size:
            j = max(i + 1, int(np.searchsorted(stops, starts[i] + _BLOCK)))
            at = starts[i]
            total = self.prefix(data[at : stops[j - 1]])
            a, b = starts[i:j] - at, stops[i:j] - at
            out[i:j] = (total[b] - total[a]) * self.down[a] + b.astype(np.uint64) - a.astype(np.uint64)
            i = j
        return common.mix(out)


HASH_A, HASH_B = ByteHasher(11), ByteHasher(23)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest value in each window of `width`, from minima of doubled windows."""
    best, have = values, 1
    while 2 * have <= width:
        best = np.minimum(best[:-have], best[have:])
        have *= 2
    return np.minimum(best[: have - width], best[width - have :]) if have < width else best


def in_order(key: np.ndarray, bits: int) -> np.ndarray:
    """Stable argsort of integers from 0 to 2**bits - 1; place and value sort as one integer where both fit, which is several times faster."""
    own = key.size.bit_length()
    if bits + own > 63:
        return np.argsort(key, kind="stable")
    return np.sort((key.astype(np.int64) << own) | np.arange(key.size)) & ((1 << own) - 1)


def suffix_array(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All suffixes in order. ends: for each place the end of its text; ends are smaller than any byte and all different."""
    n = data.size
    if not n:
        return np.zeros(0, np.int64)
    if n >= 2**31 - 1:
        raise ValueError("a shard has 2**31 bytes of regions or more; lower exchange.CHUNK_BYTES")
    used = np.bincount(data, minlength=256) > 0
    letters = int(used.sum())
    one = letters.bit_length()  # bits of a byte, numbered from 1 among those that occur; 0 stands after the end
    key = np.where(used, np.cumsum(used), 0)[data]
    stops = ends[np.r_[ends[1:] != ends[:-1], True]]
    h, most = 1, max(1, min(16, (63 - n.bit_length()) // one))
    while h < most:  # the first h bytes of each suffix become the first h + more
        more = min(h, most - h)
        follow = np.zeros(n, np.int64)
        follow[: max(0, n - h)] = key[h:]
        near = (stops[:, None] - np.arange(1, h + 1)).ravel()
        near = near[near >= 0]
        near = near[ends[near] - near <= h]
        follow[near] = 0
        key = (key << (more * one)) | (follow >> ((h - more) * one))
        h += more
    order = in_order(key, h * one)
    sorted_ = key[order]
    new = np.r_[True, sorted_[1:] != sorted_[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # a group's rank is the place of its first suffix
    while True:
        open_ = np.flatnonzero(~(new & np.r_[new[1:], True]))
        if not open_.size:
            return order
        at = order[open_]
        after, end = at + h, ends[at]
        follow = np.where(after < end, rank[np.minimum(after, n - 1)], -1 - end) + (n + 1)
        group = np.cumsum(new[open_]) - 1
        wide = (2 * n + 1).bit_length()
        pair = (group << wide) | follow
        again = in_order(pair, wide + int(group[-1]).bit_length())
        at, pair = at[again], pair[again]
        order[open_] = at
        split = np.r_[True, pair[1:] != pair[:-1]]
        new[open_] = split
        rank[at] = np.maximum.accumulate(np.where(split, open_, 0))
        h *= 2


def common_prefixes(data: np.ndarray, ends: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it in the array.

    By Kasai's rule it shrinks by one from a place to the next as long as the
    bytes before both are equal; only where they differ bytes are compared,
    eight at a time, for all such places at once.
    """
    n = order.size
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    begins = np.r_[True, ends[1:] != ends[:-1]]
    place = np.arange(n)
    chained = (before > 0) & ~begins & ~begins[np.maximum(before, 0)]
    chained[1:] &= (before[:-1] >= 0)[: n - 1]
    chained &= data[np.maximum(place - 1, 0)] == data[np.maximum(before - 1, 0)]
    heads = np.flatnonzero(~chained)
    length = np.zeros(n, np.int64)
    live = heads[before[heads] >= 0]
    word = np.zeros(n + 8, np.uint64)
    for k in range(8):
        word[: max(0, n - k)] |= data[k:].astype(np.uint64) << np.uint64(8 * k)
    limit = np.minimum(ends - place, np.where(before >= 0, ends[np.maximum(before, 0)] - before, 0))
    while live.size and length[live[0]] < 512:
        i, j = live + length[live], before[live] + length[live]
        x = word[i] ^ word[j]
        low = x & (~x + np.uint64(1))
        step = np.where(x == 0, 8, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64) // 8)
        length[live] = np.minimum(length[live] + step, limit[live])
        live = live[(step == 8) & (length[live] < limit[live])]
    raw = data.tobytes() if live.size else b""
    for i in live.tolist():  # long ones: blocks of bytes by bisection
        j, low, high = int(before[i]), int(length[i]), int(limit[i])
        while low < high:
            mid = (low + high + 1) // 2
            if raw[i + low : i + mid] == raw[j + low : j + mid]:
                low = mid
            else:
                high = mid - 1
        length[i] = low
    head = np.maximum.accumulate(np.where(chained, 0, place))
    length = np.maximum(length[head] - (place - head), 0)
    out[:] = length[order]
    out[0] = 0
    return out


class Shard:
    """What each pass derives from the same documents, in the same order."""

    def __init__(self, table: pa.Table, buckets: int):
        # rows by doc_id: the order of bytes then is that of (document, start)
        self.table = table = table.take(pa.array(np.argsort(common.ids_of(table.column("doc_id")), kind="stable")))
        self.ids, self.buckets = common.ids_of(table.column("doc_id")), buckets
        self.data, self.offsets = common.utf8(table.column("text"))
        parts, i = [], 0
        while i + 1 < self.offsets.size:
            j = max(i + 1, int(np.searchsorted(self.offsets, self.offsets[i] + _PART, "right")) - 1)
            parts.append(self._anchors(i, j))
            i = j
        self.first, self.last, self.anchor = (np.concatenate(x) if parts else np.zeros(0, np.int64) for x in (zip(*parts, strict=True) if parts else ([], [], [])))
        self.anchor = self.anchor.astype(np.uint64)
        self.bucket, self.value, self.place = exchange.order(self.anchor, buckets, 40)

    def _anchors(self, i: int, j: int):
        """First and last strings of the regions of documents i to j, and their anchors."""
        at, bounds = self.offsets[i], self.offsets[i : j + 1] - self.offsets[i]
        if bounds[-1] < WIDTH:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        total = HASH_A.prefix(self.data[at : at + bounds[-1]])
        gram = total[GRAM:] - total[:-GRAM]
        gram *= HASH_A.down[: gram.size]
        least = sliding_min(gram, WIDTH - GRAM + 1)
        # the first of the smallest changes where it leaves the string or a smaller one enters
        cut = np.empty(least.size, bool)
        cut[0] = True
        np.equal(gram[: least.size - 1], least[:-1], out=cut[1:])
        cut[1:] |= gram[WIDTH - GRAM + 1 :] < least[:-1]
        for edge in (bounds[:-1], np.maximum(bounds[1:] - WIDTH + 1, bounds[:-1])):  # where strings of a document begin, and cease
            cut[edge[edge < least.size]] = True
        first = np.flatnonzero(cut)
        last = np.r_[first[1:], least.size] - 1
        whole = np.flatnonzero(first + WIDTH <= bounds[np.searchsorted(bounds, first, "right")])
        first, last = first[whole], last[whole]
        return first + at, last + at, common.mix(least[first])

    def row(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, at, "right") - 1

    def sent(self, chunk: int) -> pa.RecordBatch:
        return exchange.send(chunk, self.bucket, self.value, 5)

    def regions(self, answers: pa.Table):
        """Regions with shared anchors; of their distinct ones bucket, key, name, document and start of the first; the place of each region in these."""
        shared = exchange.told(answers, 1, self.bucket) | (np.bincount(self.place, minlength=self.value.size) > 1)
        self.open = np.flatnonzero(shared[self.place]) if self.place.size else np.zeros(0, np.int64)
        first, last, anchor = self.first[self.open], self.last[self.open], self.anchor[self.open]
        name = HASH_B.spans(self.data, first, last + WIDTH)
        row = self.row(first)
        return distinct(exchange.bucket_of(anchor, self.buckets), anchor, name, self.ids[row], first - self.offsets[row])

    def strings(self, answers: pa.Table):
        """First and last strings of the regions that repeat as a whole; of the others that another wording or a copy in this shard resembles the strings' starts, whether they repeat in this shard, and those to be asked, as in regions()."""
        bucket, *_, place = self.regions(answers)
        earlier, mixed = exchange.told(answers, 2, bucket)[place], exchange.told(answers, 3, bucket)[place]
        left = np.flatnonzero(~earlier & (mixed | (np.bincount(place, minlength=1)[place] > 1)))
        first, last = self.first[self.open], self.last[self.open]
        whole, first, last = (first[earlier], last[earlier]), first[left], last[left]
        start = common.ranges(first, last - first + 1)
        row = np.repeat(self.row(first), last - first + 1)
        inner = start - self.offsets[row]
        known = answers.filter(pc.equal(answers.column("kind"), 5)).column("bits").to_pylist() if answers is not None else []
        self.again = again = np.unpackbits(np.frombuffer(known[0], np.uint8), count=start.size).astype(bool) if known else self._again(start, row, inner)
        ask = np.flatnonzero(np.repeat(mixed[left], last - first + 1) & ~again)
        at = start[ask]
        a, b = HASH_A.spans(self.data, at, at + WIDTH), HASH_B.spans(self.data, at, at + WIDTH)
        where = ((b >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)
        return whole, start, again, ask, distinct(where, a, b & np.uint64(0xFFFFFFFF), self.ids[row[ask]], inner[ask])

    def _again(self, start: np.ndarray, row: np.ndarray, inner: np.ndarray) -> np.ndarray:
        """Which strings occur earlier in this shard, by its suffix array."""
        if not start.size:
            return np.zeros(0, bool)
        fresh = np.flatnonzero(np.r_[True, (start[1:] > start[:-1] + WIDTH) | (row[1:] != row[:-1])])
        begin, stop = start[fresh], start[np.r_[fresh[1:], start.size] - 1] + WIDTH
        size = stop - begin
        text = self.data[common.ranges(begin, size)]
        ends = np.repeat(np.cumsum(size), size)
        order = suffix_array(text, ends)
        prefix = common_prefixes(text, ends, order)
        group = np.empty(text.size, np.int64)
        group[order] = np.cumsum(prefix < WIDTH)
        inside = np.repeat(np.arange(fresh.size), np.diff(np.r_[fresh, start.size]))
        group = group[start - begin[inside] + (np.cumsum(size) - size)[inside]]
        ids = self.ids[row]
        at = in_order(group, int(group.max()).bit_length())
        g = group[at]
        head = np.maximum.accumulate(np.where(np.r_[True, g[1:] != g[:-1]], np.arange(g.size), 0))
        out = np.zeros(start.size, bool)
        out[at] = (ids[at] != ids[at][head]) | (inner[at] != inner[at][head])
        return out

    def removed(self, answers: pa.Table) -> np.ndarray:
        (first, last), start, gone, ask, (bucket, *_, place) = self.strings(answers)
        gone[ask] = exchange.told(answers, 4, bucket)[place]
        first, last = np.r_[first, start[gone]], np.r_[last, start[gone]]
        edge = np.zeros(self.data.size + 1, np.int8)
        edge[first] = 1
        edge[last + WIDTH] -= 1
        return np.cumsum(edge[:-1], dtype=np.int64) > 0


def distinct(bucket: np.ndarray, key: np.ndarray, name: np.ndarray, doc: np.ndarray, start: np.ndarray):
    """Distinct (key, name) by bucket with the first (doc, start) of each, in which order they come, and the place of each input in them."""
    at = np.argsort(key)
    at = at[in_order(bucket[at], 32)]
    same = (bucket[at][1:] == bucket[at][:-1]) & (key[at][1:] == key[at][:-1])
    tied = np.flatnonzero(np.r_[same, False] | np.r_[False, same])
    if tied.size:  # by name, then as they came
        run = np.cumsum(np.r_[True, ~same])[tied]
        at[tied] = at[tied][np.lexsort((at[tied], name[at[tied]], run))]
    b, k, m = bucket[at], key[at], name[at]
    new = np.ones(at.size, bool)
    new[1:] = (b[1:] != b[:-1]) | (k[1:] != k[:-1]) | (m[1:] != m[:-1])
    place = np.empty(at.size, np.int64)
    place[at] = np.cumsum(new) - 1
    return b[new], k[new], m[new], doc[at][new], start[at][new], place


def send(chunk: int, kind: list, bucket, key, name, doc, start, _) -> pa.RecordBatch:
    small = not doc.size or 0 <= doc.min() and doc.max() < 2**32 and start.max() < 2**32
    size = "<u4" if small else "<i8"
    rows = np.empty(key.size, [*kind, ("doc", size), ("start", size)])
    rows["key"], rows["name"], rows["doc"], rows["start"] = key, name, doc, start
    return exchange.send_rows(chunk, bucket, rows, b"4" if small else b"8")


def received(table: pa.Table, kind: list):
    """How many names each shard sent, and all of them: key, name, document, start."""
    raw, sizes = table.column("names").to_pylist(), table.column("firsts").to_pylist()
    types = {s: np.dtype([*kind, ("doc", t), ("start", t)]) for s, t in ((b"4", "<u4"), (b"8", "<i8"))}
    n = np.array([len(x) // types[s].itemsize for x, s in zip(raw, sizes, strict=True)], np.int64)
    if len(set(sizes)) == 1:
        parts = [np.frombuffer(b"".join(raw), types[sizes[0]])]
    else:
        parts = [np.frombuffer(x, types[s]) for x, s in zip(raw, sizes, strict=True)]
    return n, [np.concatenate([p[c] for p in parts]).astype(t) if parts else np.zeros(0, t) for c, t in (("key", np.uint64), ("name", np.uint64), ("doc", np.int64), ("start", np.int64))]


def answer_regions(table: pa.Table) -> pa.Table:
    n, (key, name, doc, start) = received(table, _REGION)
    at = np.lexsort((start, doc, name, key))
    k, m, d, s = key[at], name[at], doc[at], start[at]
    fresh = np.r_[True, k[1:] != k[:-1]]
    new = np.r_[True, (k[1:] != k[:-1]) | (m[1:] != m[:-1])]
    head = np.maximum.accumulate(np.where(new, np.arange(at.size), 0))
    earlier, mixed = np.empty(at.size, bool), np.empty(at.size, bool)
    earlier[at] = (d != d[head]) | (s != s[head])
    owner = np.cumsum(fresh) - 1
    mixed[at] = np.bincount(owner, new)[owner] > 1
    return pa.concat_tables([exchange._answers(table, 2, earlier, n), exchange._answers(table, 3, mixed, n)])


def answer_strings(table: pa.Table) -> pa.Table:
    """Which names of the shards' sorted lists have an earlier place in another list: the lists are merged, and each is found in the merged one by binary search."""
    noted = pc.equal(table.column("firsts"), NOTE)
    notes, table = table.filter(noted), table.filter(pc.invert(noted))
    n, (key, name, doc, start) = received(table, _STRING)
    order = np.lexsort((start, doc, name, key))
    new = np.r_[True, (key[order][1:] != key[order][:-1]) | (name[order][1:] != name[order][:-1])] if key.size else np.zeros(0, bool)
    first = order[new]
    at = lookup(key[first], name[first], key, name)
    bits = (doc != doc[first][at]) | (start != start[first][at])
    kept = pa.table([pa.array([5] * notes.num_rows, pa.int32()), notes.column("bucket"), notes.column("chunk"), notes.column("names")], schema=exchange._ANSWER)
    return pa.concat_tables([exchange._answers(table, 4, bits, n), kept])


def lookup(keys: np.ndarray, names: np.ndarray, key: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Place of each (key, name), which is there, in lists that are sorted by both."""
    at = np.searchsorted(keys, key)
    while True:  # keys that differ in the rest of the name only are next to each other
        on = names[at] != name
        if not on.any():
            return at
        at = at + on


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (long) and kept (binary: the bytes that stay) of each row.

    A byte goes if a string of 100 bytes that covers it also starts earlier: in a
    document of smaller doc_id, or in the same one at an earlier byte; overlaps
    count, strings never cross documents and are judged on the input.
    Null or empty text: no bytes. Null doc_id: after all others. Rows that share
    a doc_id are not earlier than each other at one start. Empty table: empty
    result. Other columns have no effect. A chunk must fit in a task's memory.
    """
    chunks, buckets = exchange.sizes(docs, 2048)
    rows = docs.select(F.col("doc_id").cast("long"), "text", common.chunk_id(chunks).alias("chunk"))
    asks = lambda table: table.column("chunk")[0].as_py()

    def announce(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([Shard(table, buckets).sent(asks(table))])

    def regions(table: pa.Table, answers: pa.Table) -> pa.Table:
        return pa.Table.from_batches([send(asks(table), _REGION, *Shard(table, buckets).regions(answers))]) if table.num_rows else exchange._SENT.empty_table()

    def strings(table: pa.Table, answers: pa.Table) -> pa.Table:
        """Besides the strings to be asked, the shard's own repeats for the last pass; any bucket hands them back."""
        if not table.num_rows:
            return exchange._SENT.empty_table()
        own = Shard(table, buckets)
        asked = send(asks(table), _STRING, *own.strings(answers)[-1])
        note = pa.RecordBatch.from_arrays([pa.array([asks(table) % buckets], pa.int32()), pa.array([asks(table)], pa.int32()), pa.array([np.packbits(own.again).tobytes()], pa.binary()), pa.array([NOTE], pa.binary())], schema=exchange._SENT)
        return pa.Table.from_batches([asked, note])

    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        own = Shard(table, buckets)
        gone = own.removed(answers) if table.num_rows else np.zeros(0, bool)
        head = gone.copy()
        head[1:] &= ~gone[:-1]
        inner = own.offsets[:-1][own.offsets[:-1] < gone.size]
        head[inner] = gone[inner]
        lost, spans = (np.diff(np.r_[0, np.cumsum(x)][own.offsets]) for x in (gone, head))
        kept = common.texts_of(own.data[~gone], np.r_[0, np.cumsum(~gone)][own.offsets])
        return pa.table([own.table.column("doc_id"), pa.array(np.diff(own.offsets)), pa.array(lost), pa.array(spans), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    sent = rows.groupBy("chunk").applyInArrow(announce, exchange.SENT)
    shared = sent.groupBy("bucket").applyInArrow(exchange.answer_shared(5, 1), exchange.ANSWER)
    sent = rows.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(regions, exchange.SENT)
    known = shared.unionAll(sent.groupBy("bucket").applyInArrow(answer_regions, exchange.ANSWER))
    sent = rows.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(strings, exchange.SENT)
    known = known.unionAll(sent.groupBy("bucket").applyInArrow(answer_strings, exchange.ANSWER))
    return rows.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op7_suffix_array_dedup(spark, sf_dir):
    found = remove_repeats(common.documents(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
