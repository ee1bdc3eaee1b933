"""Secret scanning with ownership frequency over the whole corpus.

Candidates are found by pattern. For each distinct value (by hash) the corpus
gives the numbers of distinct repositories (sources) and of their owners (what
is before the first slash of a source, or all of it). A value that many owners
hold is a copied example, one that few owners hold, in however many
repositories of theirs, is live-looking.
Bare tokens count as candidates only where they look random by themselves.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Tokens that may be a secret without a telling name before them.
OPAQUE = re.compile(r"[A-Za-z0-9+/_.=-]{11,}[A-Za-z0-9+/_=]")
KINDS = ("assign", "access", "hex", "opaque")
_NAMES = re.compile(r"passw|secret|token|api_?key")
#: Owners from which on a value counts as a widely copied example.
COMMON_OWNERS = 3


def looks_random(value: str) -> bool:
    """Digits and letters mixed, as in generated keys and not in words, numbers or paths."""
    digits = sum(c.isdigit() for c in value)
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(value, value[1:], strict=False))
    return digits >= 3 and turns >= 3 and len(value) - digits >= 4


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of base spans and of opaque tokens that no base span covers, in order."""
    found = []
    if _NAMES.search(text.lower()) if text.isascii() else _NAMES.search(text.translate(_FOLD)):
        found += [(m.start(), 0, m.end(), m[2].rstrip(".")) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    base = sorted((a, b) for a, _, b, _ in found)
    starts, reach = [a for a, _ in base], list(accumulate((b for _, b in base), max))
    for m in OPAQUE.finditer(text):
        if looks_random(m[0]):
            before = bisect_left(starts, m.end())  # of the base spans that begin before its end, the farthest reaches
            if not before or reach[before - 1] <= m.start():
                found.append((m.start(), 3, m.end(), m[0]))
    return sorted(found)


_FOLD = {c: c + 32 for c in range(65, 91)}


def scan(docs: DataFrame, common_owners: int = COMMON_OWNERS) -> DataFrame:
    """doc_id, source, print (xxhash64 of the text), row (unique), spans (array of start, kind, end, owners, live, repositories) of each row, by start and then kind.

    start and end: code points, end exclusive. Kinds assign, access and hex are
    base spans and stay whatever the owners; opaque spans are only those whose
    value is live: fewer than `common_owners` owners. Null or empty text: no
    spans. A null source is a repository and an owner of its own, other than
    an empty one. Repeated rows and ties: a value is counted once for each
    repository and owner, each row keeps its own spans.
    """
    common.arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in common.slices(whole, "text", 1 << 20)):
            rows = [[{"kind": k, "start": a, "end": b, "value": hashlib.sha256(v.encode()).digest()} for a, k, b, v in candidates(x or "")] for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(rows, _FOUND)], ["doc_id", "source", "print", "found"])

    found = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.xxhash64("text").alias("print"), "text").mapInArrow(run, "doc_id long, source string, print long, found array<struct<kind:int,start:int,end:int,value:binary>>")
    found = common.saved(found.withColumn("row", F.monotonically_increasing_id()))  # small: spans and hashes, no text
    each = found.select("doc_id", "source", "print", "row", F.explode_outer("found").alias("f")).select("doc_id", "source", "print", "row", "f.*")
    told = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))  # noqa: E731  null is a value of its own
    held = each.where("value is not null").groupBy("value", told(F.substring_index("source", "/", 1)).alias("owner"), told(F.col("source")).alias("repository")).agg(F.count("*").alias("n"))
    owned = held.groupBy("value", "owner").agg(F.count("*").alias("repositories"), F.sum("n").alias("n"))
    owners = owned.groupBy(F.col("value").alias("key")).agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("n").alias("n"))
    # rows without a value spread by themselves
    each = each.withColumn("key", F.coalesce("value", F.encode(F.col("row").cast("string"), "utf-8")))
    joined = common.join_counted(each, common.saved(owners), "key", F.xxhash64("row")).withColumn("live", F.col("owners") < common_owners)
    span = F.when(F.col("kind").isNotNull() & ((F.col("kind") < 3) | F.col("live")), F.struct("start", "kind", "end", "owners", "live", "repositories"))
    return joined.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("source").alias("source"), F.first("print").alias("print"), F.array_sort(F.collect_list(span)).alias("spans"))


_FOUND = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.binary())]))


def _joined(spans):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_secret_scan(spark, sf_dir):
    found = scan(common.documents(spark, sf_dir, "doc_id", "text", "source"))
    number = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select("doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
