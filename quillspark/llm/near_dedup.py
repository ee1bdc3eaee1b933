"""Near-duplicate documents by MinHash with tensored banding.

Two small collections of ROWS half-keys (PAIR minimum hashes each) are computed
for a document; every half-key of the first combined with every one of the
second is a table key. 2 * ROWS * PAIR = 32 minimum hashes so serve
ROWS * ROWS = 64 tables of 4. At a similarity of 0.85 a pair misses all tables
with probability 2 * (1 - 0.85**2) ** 8 = 7e-5.

Documents with equal sets are one node, with a number of its own. In a bucket, every node is first
compared with the bucket's smallest one only. Nodes that are in one component
then need no more comparison. What buckets still hold several components is
compared in crowds (see crowd_links): up to CROWD nodes within a task, which
returns no more links than join its components; larger crowds are divided by an
exact join. No step makes all pairs of a group, and no task gathers more than a
bounded crowd. All links are confirmed on the full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SHINGLE, PERCENT = 5, 85
PAIR, ROWS = 2, 8
#: Nodes that are compared within one task; larger crowds are divided.
CROWD = 512
#: Pairs that are confirmed together, and their shingles; shingles of a crowd that is compared within one task.
PART, PART_ITEMS, CROWD_ITEMS = 1024, 1 << 20, 1 << 22
#: Rows that miss a pair at 0.8 as rarely: 2 * (1 - 0.8**2) ** 10 = 7e-5.
ROWS_80 = 10
#: Of the 2 * ROWS half-keys of two linked documents about 11.6 agree, at 0.8 12.8 of 20; fewer than this has probability 1e-5.
AGREE = 4
_FACTORS = np.random.default_rng(85).integers(1, 2**63, 2 * ROWS_80 * PAIR, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row as two halves of 128-bit names, the first ascending, and the n + 1 bounds of the rows in them."""
    data, offsets = common.utf8(column, lower=True)
    starts, stops, bounds = common.words(data, offsets)
    names = common.word_names(data, starts, stops)
    row = common.row_of(bounds)
    n = np.diff(bounds)
    owner, value = [], [[], []]
    if row.size >= SHINGLE:
        at = np.flatnonzero(row[SHINGLE - 1 :] == row[: -SHINGLE + 1])
        owner.append(row[at])
        for half in (0, 1):
            value[half].append(common.windows(names[half], SHINGLE, 2 + half)[at])
    for k in range(1, SHINGLE):  # fewer words: the whole sequence
        few = np.flatnonzero(n == k)
        if few.size:
            owner.append(few)
            for half in (0, 1):
                value[half].append(common.windows(names[half], k, 2 + half)[bounds[few]])
    if not owner:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(offsets.size, np.int64)
    owner, (x, y) = np.concatenate(owner), (np.concatenate(v) for v in value)
    order = np.argsort(x, kind="stable")
    order = order[np.argsort(owner[order].astype(np.min_scalar_type(offsets.size)), kind="stable")]
    if ((x[order][1:] == x[order][:-1]) & (y[order][1:] != y[order][:-1])).any():  # equal in one half only
        order = np.lexsort((y, x, owner))
    owner, x, y = owner[order], x[order], y[order]
    new = np.r_[True, (owner[1:] != owner[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]
    owner, x, y = owner[new], x[new], y[new]
    return x, y, np.searchsorted(owner, np.arange(offsets.size))


def _set_digests(x: np.ndarray, y: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    """A 128-bit name of each set; None for the empty one."""
    raw = np.stack([x, y], 1).tobytes()
    return [hashlib.blake2b(raw[16 * a : 16 * b], digest_size=16).digest() if b > a else None for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _signatures(batches: Iterator[pa.RecordBatch], halves_of: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in common.slices(whole, "text"):
            value, more, bounds = shingle_sets(batch.column(1))
            n = np.diff(bounds)
            full = np.flatnonzero(n)
            halves = np.zeros((n.size, halves_of), np.int64)
            mixed = common.mix(value)
            for i in range(halves_of):
                key = np.zeros(full.size, np.uint64)
                for f in _FACTORS[PAIR * i : PAIR * (i + 1)]:
                    if full.size:
                        key = common.mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(mixed * f, bounds[:-1][full]))
                halves[full, i] = key.view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n), pa.array(_set_digests(value, more, bounds), pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(0, halves_of * n.size + 1, halves_of, dtype=np.int32)), pa.array(halves.ravel()))],
                ["doc_id", "print", "n_shingles", "digest", "halves"],
            )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose text has the digest that its node has: repeated ids may have other texts."""
    for whole in batches:
        for batch in common.slices(whole, "text"):
            fits = [own == d for own, d in zip(_set_digests(*shingle_sets(batch.column(1))), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["node", "text"]).filter(pa.array(fits, pa.bool_()))


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in common.slices(whole, "text"):
            value, _, bounds = shingle_sets(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.LargeListArray.from_arrays(pa.array(bounds), pa.array(value.view(np.int64))).cast(pa.list_(pa.int64()))], ["node", "items"])


def _in_common(x: np.ndarray, x2: np.ndarray, y: np.ndarray, y2: np.ndarray) -> int:
    """Size of the intersection of two sets, by both halves of the names."""
    if (x[1:] == x[:-1]).any() or (y[1:] == y[:-1]).any():
        return len({*zip(x.tolist(), x2.tolist(), strict=True)} & {*zip(y.tolist(), y2.tolist(), strict=True)})
    at = np.minimum(np.searchsorted(y, x), y.size - 1)
    return int(((y[at] == x) & (y2[at] == x2)).sum()) if y.size else 0


def compare(pairs: pa.Table, others: pa.Table, percent: int) -> pa.Table:
    """Which pairs (a, b, own: text of a) are linked; others: b and its text, once."""
    x, x2, xn = shingle_sets(pairs.column("own"))
    y, y2, yn = shingle_sets(others.column("other"))
    place = {b: i for i, b in enumerate(others.column("b").to_pylist())}
    fits = []
    for i, b in enumerate(pairs.column("b").to_pylist()):
        j = place[b]
        left, right = slice(xn[i], xn[i + 1]), slice(yn[j], yn[j + 1])
        both = _in_common(x[left], x2[left], y[right], y2[right])
        fits.append(100 * both >= percent * (xn[i + 1] - xn[i] + yn[j + 1] - yn[j] - both))
    return pairs.select(["a", "b"]).filter(pa.array(fits, pa.bool_()))


def _tables(rows: int) -> Column:
    return F.expr(f"flatten(transform(sequence(0, {rows - 1}), i -> transform(sequence(0, {rows - 1}), j -> xxhash64(i, j, halves[i], halves[{rows} + j]))))")


def _roots(parent: DataFrame) -> DataFrame:
    """parent (u, p) with p replaced by the last of its own parents; chains are halved each time."""
    while True:
        up = parent.select(F.col("u").alias("p"), F.col("p").alias("q"))
        found = common.saved(parent.join(up, "p").select("u", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")))
        parent = found.select("u", "p")
        if found.where("moved").isEmpty():
            return parent


def components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node it reaches), for all nodes of the edges (a, b).

    Every node is contracted into its smallest neighbour, and that one's, up to
    the last, until no edge is left: every two rounds at least half of the nodes
    that have edges go. The aggregations are partial ones, so a hub costs no task
    more than others.
    """
    now, labels = common.saved(edges.select("a", "b").distinct()), None
    while not now.isEmpty():
        sides = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select("b", "a"))
        parent = common.saved(sides.groupBy("u").agg(F.min("v").alias("p")).select("u", F.least("u", "p").alias("p")))
        if labels is None:  # most groups are stars: nothing to follow
            labels = parent.select(F.col("u").alias("node"), F.col("p").alias("component"))
        else:
            parent = _roots(parent)
            labels = common.saved(labels.join(parent, F.col("component") == F.col("u"), "left").select("node", F.coalesce("p", "component").alias("component")))
        a, b = parent.select(F.col("u").alias("a"), F.col("p").alias("x")), parent.select(F.col("u").alias("b"), F.col("p").alias("y"))
        now = common.saved(now.join(a, "a").join(b, "b").where("x != y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    return labels if labels is not None else edges.sparkSession.createDataFrame([], "node long, component long")


def open_buckets(rows: DataFrame) -> DataFrame:
    """Rows (key, table, node, component) of the buckets with several components, with their number n."""
    several = common.saved(rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low < high").select("key", "n"))
    return common.saved(rows.join(several, "key"))


def joining_links(node: np.ndarray, component: np.ndarray, size: np.ndarray, items: np.ndarray, bounds: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (a, b) that join the components of a crowd as far as any of its links do: all its sets are compared.

    items and bounds: of each set what it has besides a set that all share, and what it lacks of that; size: of the whole set.
    """
    n = node.size
    _, code, count = np.unique(items, return_inverse=True, return_counts=True)
    often = np.flatnonzero(count > 1)
    place = np.full(count.size, -1)
    place[often] = np.arange(often.size)
    row, code = common.row_of(bounds), place[code]
    both = np.zeros((n, n), np.float32)
    for low in range(0, often.size, 4096):
        own = (code >= low) & (code < low + 4096)
        part = np.zeros((n, min(4096, often.size - low)), np.float32)
        part[row[own], code[own] - low] = 1
        both += part @ part.T
    own = np.diff(bounds)
    differ = own[:, None] + own - 2 * both.astype(np.int64)
    total = size[:, None] + size
    # |x and y| = (total - differ) / 2, |x or y| = (total + differ) / 2
    x, y = np.nonzero((100 * (total - differ) >= percent * (total + differ)) & (component[:, None] > component))
    _, first = np.unique(np.stack([component[x], component[y]]), axis=1, return_index=True)
    up, links = {}, []

    def top(c: int) -> int:
        while c in up:
            c = up[c]
        return c

    for i, j in zip(x[first].tolist(), y[first].tolist(), strict=True):
        c, d = top(int(component[i])), top(int(component[j]))
        if c != d:
            up[max(c, d)] = min(c, d)
            links.append((int(node[i]), int(node[j])))
    return links


def compare_crowds(table: pa.Table, percent: int) -> pa.Table:
    """Links of the crowds (key, node, component, size, items) of a part."""
    table = table.sort_by([("key", "ascending")])
    key, node, component, size = (table.column(c).to_numpy() for c in ("key", "node", "component", "size"))
    items = table.column("items").combine_chunks()
    value, bounds = items.flatten().to_numpy(), np.r_[0, np.cumsum(pc.list_value_length(items).to_numpy())]
    cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    links = []
    for a, b in zip(cuts, np.r_[cuts[1:], key.size], strict=True):
        links += joining_links(node[a:b], component[a:b], size[a:b], value[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], percent)
    return pa.table([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])


def crowds_of(rows: DataFrame) -> DataFrame:
    """Distinct (key, node, component) of crowds, given the same of open buckets: buckets that share nodes are put
    together as far as two steps from smallest node to smallest node lead. Nodes of one bucket have a crowd in common."""
    lows = common.saved(rows.groupBy("key").agg(F.min("node").alias("low")))
    up = rows.join(lows, "key").groupBy("node").agg(F.min("low").alias("up"))
    to = common.saved(lows.join(up, F.col("low") == up["node"]).select("key", "up"))
    return rows.join(to, "key").select(F.col("up").alias("key"), "node", "component").distinct()


def crowd_links(buckets: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join components as far as all links within the buckets (key, node, component) do.

    Crowds of up to CROWD nodes and CROWD_ITEMS items are compared in a task. For larger ones let V be
    the items that more than half of a crowd's sets have, D = set xor V. Two
    sets x, x' differ by |D| + |D'| - 2 |D and D'|, which may be (100 - p) / p of
    |x| at most, since |x'| may be 100 / p of |x|. So linked ones share at least
    |D| - (100 - p) / p |x| items of D. With g = (100 + p) |D| - (100 - p) |x|,
    they are linked if and only if they share (g + g') / (2 (100 + p)) items.
    Where that is none, both are linked to the node of the smallest g. Others
    share one of the |D| - o + 1 rarest items of each, o being the least number
    that a node must share. The nodes with one such item are a crowd again, of
    half the nodes at most, as no item is in more than half of the Ds; so D
    takes the place of the set, and this ends.
    """
    more, less = 100 + percent, 100 - percent
    own = crowds_of(buckets)
    items = texts.join(buckets.select("node").distinct(), "node", "left_semi").select("node", "text").mapInArrow(_shingles, "node long, items array<long>")
    rows = common.saved(own.join(items, "node").select("key", "node", "component", F.size("items").cast("long").alias("size"), "items"))
    links = []
    while not rows.isEmpty():
        total = common.saved(rows.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.size("items")).alias("m")))
        sized, fits = rows.join(total, "key"), (F.col("n") <= CROWD) & (F.col("m") <= CROWD_ITEMS)
        n, m = total.where(fits).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("m"), F.lit(0))).first()
        parts = F.lit(max(n // (2 * CROWD), m // CROWD_ITEMS) + 1)
        small = sized.where(fits).select(F.pmod(F.xxhash64("key"), parts).cast("int").alias("part"), "key", "node", "component", "size", "items")
        links.append(common.saved(small.groupBy("part").applyInArrow(lambda t: compare_crowds(t, percent), "a long, b long")))
        if total.where(~fits).isEmpty():
            break
        rows = sized.where(~fits).drop("m")
        counts = rows.select("key", "n", F.explode("items").alias("item")).groupBy("key", "n", "item").agg(F.count("*").alias("c")).where("c > 1")
        counts = common.saved(counts.select("key", "item", F.least("c", F.col("n") - F.col("c")).alias("c"), (2 * F.col("c") > F.col("n")).alias("most")))
        major = counts.where("most").groupBy("key").agg(F.collect_list("item").alias("v"))
        rows = rows.join(major, "key", "left").withColumn("v", F.coalesce("v", F.array().cast("array<long>")))
        rows = rows.select("key", "node", "component", "size", F.concat(F.array_except("items", "v"), F.array_except("v", "items")).alias("items"))
        rows = common.saved(rows.withColumn("g", more * F.size("items") - less * F.col("size")))
        least = common.saved(rows.groupBy("key").agg(F.min(F.struct("g", "node", "component")).alias("low")))
        led = rows.join(least, "key")
        links.append(common.saved(led.where("g + low.g <= 0 and node != low.node and component != low.component").select(F.col("node").alias("a"), F.col("low.node").alias("b"))))
        need = F.greatest(F.lit(1), F.ceil((F.col("g") + F.col("low.g")) / (2 * more)), F.size("items") - F.floor(less * F.col("size") / percent))
        ranked = led.withColumn("take", F.size("items") - need + 1).where("take > 0").select("key", "node", "component", "take", F.explode("items").alias("item"))
        # an item that nobody else has comes first in the order, and leads nowhere
        ranked = ranked.join(counts.select("key", "item", "c"), ["key", "item"], "left").groupBy("key", "node", "component", "take").agg(F.array_sort(F.collect_list(F.struct("c", "item"))).alias("i"), F.count_if(F.col("c").isNull() | (F.col("c") < 2)).alias("alone"))
        first = ranked.where("take > alone").select("key", "node", "component", F.explode(F.expr("slice(filter(i, x -> x.c > 1), 1, cast(take - alone as int))")).alias("i"))
        again = open_buckets(first.select(F.col("key").alias("above"), F.xxhash64("key", "i.item").alias("key"), "node", "component"))
        rows = common.saved(again.join(rows.select(F.col("key").alias("above"), "node", "size", "items"), ["above", "node"]).select("key", "node", "component", "size", "items"))
    return reduce(DataFrame.unionAll, links) if links else rows.sparkSession.createDataFrame([], "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and print (xxhash64 of the text) of each row.

    Words of lower-cased A-Z text; a document's set holds its distinct 5-word
    shingles, or the whole sequence if it has fewer words. Documents are linked
    if 100 * |intersection| >= percent * |union|; rows: half-keys in each of both
    collections, ROWS for 85 and ROWS_80 for 80. Null, empty or blank text: an empty
    set, linked with nothing. component_id: smallest doc_id reachable; kept:
    doc_id = component_id. A doc_id that occurs again with another text is a
    document of its own: its rows may differ in component and kept, and print
    tells them apart; rows that are equal are kept or not together. Null doc_id:
    never linked, component_id null, kept. Empty table: empty result. Other
    columns have no effect.
    """
    common.arrow_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("print"))
    signs = common.saved(docs.mapInArrow(partial(_signatures, halves_of=2 * rows), "doc_id long, print long, n_shingles long, digest binary, halves array<long>"))
    nodes = signs.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc"), F.first("halves").alias("halves"), F.count("*").alias("n"), F.first("n_shingles").alias("size"))
    nodes = common.saved(nodes.withColumn("node", F.monotonically_increasing_id()))

    # a task gets a few thousand nodes, as each becomes rows * rows keys
    dealt = nodes.select("node", "halves").repartition(max(1, nodes.count() // 4096))
    # Spark takes an exploded table, and arrays, for about as large as what they come from: such joins are never broadcast
    keys = dealt.select(F.posexplode(_tables(rows)).alias("table", "key"), "node").hint("merge")
    buckets = keys.groupBy("key").agg(F.min("node").alias("center"), F.count("*").alias("n")).where("n > 1")
    members = common.saved(keys.join(buckets, "key"))
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "doc", "digest")
    texts = docs.join(wanted, F.col("doc_id") == F.col("doc")).select("node", "text", "digest").mapInArrow(_digests, "node long, text string")
    texts = common.saved(texts.dropDuplicates(["node"]))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that are linked; those with few half-keys in common are left out first."""
        at = lambda name, *more: nodes.select(F.col("node").alias(name), F.col("halves").alias(f"h{name}"), *more).hint("merge")
        agree = F.size(F.filter(F.zip_with("ha", "hb", lambda x, y: x == y), lambda x: x))
        pairs = pairs.join(at("a", "size"), "a").join(at("b"), "b").where(agree >= AGREE).select("a", "b", "size")
        pairs = common.saved(pairs)
        # parts of some PART pairs or PART_ITEMS shingles: a b with many partners is in several, once in each
        many = common.saved(pairs.groupBy("b").agg(F.ceil(F.count("*") / PART).cast("int").alias("n")))
        number, items = pairs.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        parts = F.lit(max(1, number // PART, items // PART_ITEMS))
        salt = F.pmod(F.xxhash64("a"), F.col("n")).cast("int")
        part = lambda c: F.pmod(F.xxhash64("b", c), parts).cast("int").alias("part")
        left = pairs.join(many, "b").select(part(salt), "a", F.col("b").alias("b")).join(texts.select(F.col("node").alias("a"), F.col("text").alias("own")), "a").select("part", "a", "b", "own")
        right = many.select("b", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("salt")).select(part(F.col("salt")), "b").distinct().join(texts.select(F.col("node").alias("b"), F.col("text").alias("other")), "b").select("part", "b", "other")
        return common.saved(left.groupBy("part").cogroup(right.groupBy("part")).applyInArrow(lambda own, others: compare(own, others, percent), "a long, b long"))

    links = confirmed(members.where("node != center").select(F.col("node").alias("a"), F.col("center").alias("b")).distinct())
    groups = components(links)

    # buckets that hold several components: across these only
    labelled = members.join(groups, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    more = confirmed(crowd_links(open_buckets(labelled).select("key", "node", "component"), texts, percent).distinct())
    if not more.isEmpty():
        groups = components(links.unionAll(more))

    # every document gets the smallest doc_id of its node's component
    placed = groups.join(nodes.select("node", "doc"), "node")
    lead = common.saved(placed.groupBy("component").agg(F.min("doc").alias("lead"), F.count("*").alias("n")))
    led = common.join_counted(groups, lead, "component", F.xxhash64("node")).select("node", "lead")
    found = nodes.join(led, "node", "left").select("digest", "n", F.coalesce("lead", "doc").alias("component"))
    spread = signs.select("doc_id", "print", "n_shingles", F.coalesce("digest", F.encode(F.concat(F.lit("-"), F.col("doc_id").cast("string")), "utf-8")).alias("digest"))
    out = common.join_counted(spread, found, "digest", F.xxhash64("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), "print").withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op8_near_dedup(spark, sf_dir):
    return near_duplicates(common.documents(spark, sf_dir, "doc_id", "text")).drop("print")
