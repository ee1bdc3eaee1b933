"""Shards by a k-d tree over document metadata, with DataFrame and SQL functions only.

A node that stands for several shards is divided at a weighted median (weight:
bytes) along its widest metadata dimension, until every leaf is one shard, which
then has about the target bytes. All nodes of a level are divided at once: sums
over bins of the dimension's order give the bin that holds the cut, that bin is
divided again, and when few rows are left in it, sums over these give the cut.
Equal texts have one place in every dimension, that of the copy with the
smallest doc_id, so they stay together unless a cut has to go through them.
Only narrow rows without texts are read by these rounds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Bytes of a document beside its text.
OVERHEAD = 16
#: Bins of a node in a round; rows of a node whose sums are taken one by one.
BINS, FEW = 1_024, 16_384
#: A cut between groups of equal texts is taken if it misses the target by this part of a shard at most.
SLACK = 0.002
#: Steps of a dimension; bits of a text's hash that order the rows of a step.
STEPS, HASH_BITS = 65_536, 47
#: Parts of a shard that are numbered for themselves; narrow rows of a partition.
SALTS, ROWS = 16, 1 << 17


def _values(spark: SparkSession, names: str, rows: list[tuple[int, ...]]) -> DataFrame:
    """A table of whole numbers, a few for each shard at most."""
    return spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(f'{x}L' for x in r) + ')' for r in rows)} AS t({names})")


def _place(docs: DataFrame, name: str, low: float | None, high: float | None) -> Column:
    """0 to STEPS - 1 in a dimension: numbers by value, others by a hash; null and NaN: 0."""
    if low is None:
        return F.coalesce(F.shiftright(F.crc32(F.col(name).cast("string")), 16), F.lit(0))
    number = F.col(name).cast("double")
    inside = F.floor((number - low) * ((STEPS - 1) / (high - low) if high > low else 0.0))
    return F.coalesce(F.when(~F.isnan(number), F.least(F.greatest(inside, F.lit(0)), F.lit(STEPS - 1))), F.lit(0))


def narrow(docs: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    """row (unique), doc_id, size, text_crc32, and k0, k1, ...: the order of the rows in each dimension, as a table."""
    own = [d for d in dimensions if d in docs.columns] or ["text"]
    numeric = {f.name for f in docs.schema if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double") or f.dataType.typeName().startswith("decimal")}
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("hash"),
        *[F.col(d).alias(f"d{i}") if d != "text" else F.lit(0).alias(f"d{i}") for i, d in enumerate(own)],
    )
    rows = common.saved(rows)
    found = rows.agg(F.count("*"), *[f(F.when(~F.isnan(F.col(f"d{i}").cast("double")), F.col(f"d{i}").cast("double"))) if d in numeric else F.lit(None) for i, d in enumerate(own) for f in (F.min, F.max)]).first()
    groups = common.saved(rows.groupBy("hash").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", *[f"d{i}" for i in range(len(own))])).alias("first")))
    placed = common.join_counted(rows.select("row", "doc_id", "size", "text_crc32", "hash"), groups, "hash", F.col("row"))
    placed = placed.select("*", *[F.col(f"first.d{i}").alias(f"d{i}") for i in range(len(own))])
    ends = [(found[1 + 2 * i], found[2 + 2 * i]) if d in numeric else (None, None) for i, d in enumerate(own)]
    ends = [(0.0, 0.0) if d in numeric and low is None else (low, high) for d, (low, high) in zip(own, ends, strict=True)]
    hashed = F.col("hash").bitwiseAND(F.lit((1 << HASH_BITS) - 1))
    keys = [(F.shiftleft(_place(placed, f"d{i}", *e).cast("long"), HASH_BITS) + hashed).alias(f"k{i}") for i, e in enumerate(ends)]
    return common.saved(placed.select("row", "doc_id", "size", "text_crc32", *keys).coalesce(max(1, math.ceil(found[0] / ROWS))))


def _divide(rows: DataFrame, shards: int) -> DataFrame:
    """rows of narrow() with the column shard."""
    spark = rows.sparkSession
    keys = [c for c in rows.columns if c[0] == "k"]
    key = lambda dim: F.element_at(F.array(*keys), (dim + 1).cast("int"))
    step = 1 << HASH_BITS
    leaves, many, placed = [], {1: (0, shards)}, rows.withColumn("node", F.lit(1).cast("long"))
    while many:
        leaves += [(node, first) for node, (first, k) in many.items() if k == 1]
        open_ = {node: x for node, x in many.items() if x[1] > 1}
        found = placed.join(F.broadcast(_values(spark, "node", [(x,) for x in open_])), "node").groupBy("node") if open_ else None
        cuts, wanted, active = {}, {}, []
        for r in found.agg(F.sum("size").alias("w"), F.count("*").alias("n"), *[f(c).alias(f"{c}_{f.__name__}") for c in keys for f in (F.min, F.max)]).collect() if open_ else ():
            width = [r[f"{c}_max"] // step - r[f"{c}_min"] // step for c in keys]
            dim = width.index(max(width))
            k = open_[r.node][1]
            wanted[r.node] = (dim, r.w * (k // 2) // k, round(SLACK * r.w / k))
            active.append((r.node, dim, 0, r[f"{keys[dim]}_min"], r[f"{keys[dim]}_max"], 0, 0, r.n))
        ready = []
        while active:
            ready += [x for x in active if x[7] <= FEW or x[2] and x[3] == x[4]]
            active = _narrower(placed, [x for x in active if x[7] > FEW and not (x[2] and x[3] == x[4])], wanted, key)
        for r in _exact(placed, ready, wanted, key):
            cuts[r.node] = (wanted[r.node][0], r.key, r.row)
        if cuts:
            table = _values(spark, "node, dim, cut, cut_row", [(n, *c) for n, c in cuts.items()])
            right = (key(F.col("dim")) > F.col("cut")) | ((key(F.col("dim")) == F.col("cut")) & (F.col("row") > F.col("cut_row")))
            node = F.when(F.col("dim").isNull(), F.col("node")).otherwise(2 * F.col("node") + right.cast("long"))
            placed = placed.join(F.broadcast(table), "node", "left").select("row", "doc_id", "size", "text_crc32", *keys, node.alias("node"))
        many = {}
        for node in cuts:  # nodes without rows are not divided: their shards are empty
            first, k = open_[node]
            many |= {2 * node: (first, k // 2), 2 * node + 1: (first + k // 2, k - k // 2)}
    return placed.join(F.broadcast(_values(spark, "node, shard", leaves or [(1, 0)])), "node").drop("node", *keys)


def _within(placed: DataFrame, active: list[tuple[int, ...]], key) -> DataFrame:
    """The rows between low and high of their node; at: the key, or the row's number where all keys are one (by_row)."""
    table = _values(placed.sparkSession, "node, dim, by_row, low, high, key_at, before, n", active)
    rows = placed.join(F.broadcast(table), "node").withColumn("key", key(F.col("dim")))
    rows = rows.withColumn("at", F.when(F.col("by_row") == 0, F.col("key")).otherwise(F.col("row")))
    return rows.where("at between low and high and (by_row = 0 or key = key_at)")


def _narrower(placed: DataFrame, active: list[tuple[int, ...]], wanted: dict, key) -> list[tuple[int, ...]]:
    """For each node, the bin of its range that the target falls into."""
    if not active:
        return []
    target = _values(placed.sparkSession, "node, target", [(x[0], wanted[x[0]][1]) for x in active])
    bin_ = F.floor((F.col("at") - F.col("low")) / (F.floor((F.col("high") - F.col("low")) / BINS) + 1))
    sums = _within(placed, active, key).groupBy("node", bin_.alias("bin")).agg(F.sum("size").alias("s"), F.count("*").alias("n"), F.min("at").alias("low"), F.max("at").alias("high"), F.min("key").alias("key"), F.first("before").alias("before"), F.first("dim").alias("dim"), F.first("by_row").alias("by_row"))
    so_far = F.sum("s").over(Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    sums = sums.join(F.broadcast(target), "node").withColumn("so_far", F.col("before") + so_far)
    first = F.min(F.struct(F.when(F.col("so_far") >= F.col("target"), 0).otherwise(1).alias("late"), "bin", "low", "high", "n", "dim", "by_row", "key", (F.col("so_far") - F.col("s")).alias("before"))).alias("x")
    out = []
    for r in sums.groupBy("node").agg(first).collect():
        x = r.x
        if x.by_row == 0 and x.low == x.high and x.n > FEW:
            out.append((r.node, x.dim, 1, 0, 2**62, x.low, x.before, x.n))
        else:
            out.append((r.node, x.dim, x.by_row, x.low, x.high, x.key, x.before, x.n))
    return out


def _exact(placed: DataFrame, ready: list[tuple[int, ...]], wanted: dict, key) -> list:
    """node, key, row: the last row left of the cut nearest to the target; between groups if one is near enough."""
    if not ready:
        return []
    target = _values(placed.sparkSession, "node, target, slack", [(x[0], *wanted[x[0]][1:]) for x in ready])
    order = Window.partitionBy("node").orderBy("key", "row")
    rows = _within(placed, ready, key).select("node", "key", "row", "size", "before", "by_row")
    rows = rows.withColumn("so_far", F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("next", F.lead("key").over(order)).withColumn("place", F.row_number().over(order)).join(F.broadcast(target), "node")
    ends = (F.col("next") != F.col("key")) | (F.col("next").isNull() & (F.col("by_row") == 0))
    after = F.struct(F.col("so_far").alias("sum"), ends.alias("between"), "key", "row")
    ahead = F.struct((F.col("so_far") - F.col("size")).alias("sum"), (F.col("by_row") == 0).alias("between"), "key", (F.col("row") - 1).alias("row"))
    cuts = rows.select("node", "target", "slack", F.explode(F.when(F.col("place") == 1, F.array(ahead, after)).otherwise(F.array(after))).alias("cut"))
    off = F.abs(F.col("cut.sum") - F.col("target"))
    best = F.min(F.struct(F.when(F.col("cut.between") & (off <= F.col("slack")), 0).otherwise(1).alias("through"), off.alias("off"), "cut.key", "cut.row")).alias("x")
    return cuts.groupBy("node").agg(best).select("node", "x.key", "x.row").collect()


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, dimensions: tuple[str, ...] = ("lang", "source", "n_chars")) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of each row of docs (doc_id, text and, if present, the dimensions).

    shards: their number, or as many as give leaves of target_bytes. size: UTF-8
    bytes of the text and OVERHEAD. Null text: size OVERHEAD, hash of the empty
    text, and one group with empty texts. Rows that repeat, also without doc_id,
    are rows of their own. Equal texts are neighbours, and in one shard unless a
    cut has to go through them. Fewer rows than shards: some shards are empty.
    No rows: no rows. Further columns have no effect; a missing dimension is
    left out. slot counts the rows of a shard from 0.
    """
    rows = narrow(docs, dimensions)
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    shards = shards or max(1, math.ceil(total / target_bytes))
    # one table, as rows are numbered in two passes; parts of a shard are numbered for themselves
    dealt = common.saved(_divide(rows, shards).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")))
    counts = dealt.groupBy("shard", "salt").agg(F.count("*").alias("n"))
    begin = counts.select("shard", "salt", (F.sum("n").over(Window.partitionBy("shard").orderBy("salt")) - F.col("n")).alias("begin"))
    own = F.row_number().over(Window.partitionBy("shard", "salt").orderBy("row"))
    slots = dealt.withColumn("own", own).join(begin, ["shard", "salt"])
    return slots.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("begin") + F.col("own") - 1).alias("slot"))


def op12_kd_shards(spark, sf_dir):
    docs = common.documents(spark, sf_dir, "doc_id", "text", "lang", "source", "n_chars")
    return kd_shards(docs, 40).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
