"""Quality rules whose cutoffs come with a guarantee on false rejection.

Labelled documents (quality 1: good) are a holdout: nothing is fitted on them
but the choice of cutoffs. For each stratum (class of length), rule and cutoff
of a fixed grid, the exact (Clopper-Pearson) upper bound of the rate at which
good documents would be rejected is computed. Each stratum and rule gets its
share of DELTA (Bonferroni over these); within it the cutoffs are tested in the
fixed order of the grid, from the laxest on, each at the whole share, up to the
first whose bound is above the rule's share of ALPHA. So with probability
1 - DELTA no stratum loses more than ALPHA of its good documents, whichever of
the cutoffs that passed are chosen.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

ALPHA, DELTA = 0.01, 0.05
#: Lower ends of the strata, in words.
STRATA = (0, 100, 400, 1600)
#: A value above the cutoff rejects; values are ratios.
GRID = tuple((i / 32) ** 2 for i in range(2, 32))
RULES = ("symbols", "dup_lines", "repeats")
#: Good documents lost weigh so many times the bad ones caught.
PRICE = 20
STATS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))


def statistics(docs: DataFrame) -> DataFrame:
    """The rows of docs with the counts STATS (long) of each whole text.

    Null or empty text: all 0. Fewer than three words: no repeats. Columns of
    the input with these names are replaced; rows are independent of each other.
    """
    docs = docs.drop(*STATS)
    common.arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in common.slices(whole, "text")):
            data, offsets = common.utf8(batch.column("text"))
            starts, stops, bounds = common.words(data, offsets)
            upto = lambda mask: np.r_[0, np.cumsum(mask)][offsets]
            chars = np.diff(upto(((data & 0xC0) != 0x80) & ~common._SPACE[data]))
            lines, dups = [], []
            for text in common.texts_of(data, offsets):
                own = [x for x in text.split(b"\n") if x.strip()]
                lines.append(len(own))
                dups.append(len(own) - len(set(own)))
            repeated = np.zeros(starts.size, bool)
            if starts.size >= 3:
                row = common.row_of(bounds)
                at = np.flatnonzero(row[2:] == row[:-2])
                key = common.windows(common.word_names(data, starts, stops)[0], 3, 1)[at] + common.mix(row[at].astype(np.uint64) + np.uint64(1))
                order = np.argsort(key, kind="stable")
                same = key[order][1:] == key[order][:-1]
                twice = np.unique(np.r_[order[1:][same], order[:-1][same]])
                for k in range(3):
                    repeated[at[twice] + k] = True
            values = (np.diff(bounds), chars, np.diff(upto(_SYMBOL[data])), np.array(lines, np.int64), np.array(dups, np.int64), np.diff(np.r_[0, np.cumsum(repeated)][bounds]))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v.astype(np.int64)) for v in values)], [*batch.schema.names, *STATS])

    return docs.mapInArrow(run, T.StructType(list(docs.schema.fields) + [T.StructField(c, T.LongType()) for c in STATS]))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def stratum() -> Column:
    out = F.lit(0)
    for i, low in enumerate(STRATA):
        out = F.when(F.col("n_words") >= low, F.lit(i)).otherwise(out)
    return out


def values() -> dict[str, Column]:
    ratio = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {"symbols": ratio("n_symbols", "word_chars"), "dup_lines": ratio("n_dup_lines", "n_lines"), "repeats": ratio("n_repeat_words", "n_words")}


def _beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function by its continued fraction (modified Lentz): some sqrt(a + b) terms."""
    if not 0 < x < 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, m = 1e-300, 0
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    f = d
    while True:
        m += 1
        for up in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + up * d or tiny)
            c = 1 + up / c or tiny
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            return front * f


def upper_bound(k: int, n: int, level: float) -> float:
    """Exact binomial upper bound of a rate of which k of n were seen: P(at most k of n) is `level` at that rate."""
    if k >= n:
        return 1.0

    def chance(p: float) -> float:
        return _beta_share(n - k, k + 1, 1 - p)

    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        if mid <= 0 or mid >= 1 or chance(mid) > level:
            low = mid
        else:
            high = mid
    return high


def calibrate(labelled: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> dict[tuple[int, str], float]:
    """Cutoffs by stratum and rule, from rows with STATS and quality (1 good, 0 bad; null is not used).

    Only rows that pass the base rules count, each as a draw of its own: equal
    ids are the caller's to put together. Of the cutoffs that passed, the one is
    taken that catches most bad documents less PRICE times the good ones; ties:
    the highest. A rule for which no cutoff passes or gains is absent. All
    labelled rows are counted, in a table of fixed size.
    """
    rows = labelled.where("quality is not null").where(~base_failed())
    bins = F.array(*[F.struct(F.lit(r).alias("rule"), sum((v > c).cast("int") for c in GRID).alias("bin")) for r, v in values().items()])
    counts = rows.select(stratum().alias("stratum"), (F.col("quality") == 1).alias("good"), F.explode(bins).alias("x")).groupBy("stratum", "good", "x.rule", "x.bin").count()
    seen: dict = defaultdict(lambda: np.zeros((2, len(GRID) + 1), np.int64))
    for r in counts.collect():
        seen[r.stratum, r.rule][int(r.good), r.bin] = r["count"]
    found = {key: choose(n, alpha / len(RULES), delta / (len(STRATA) * len(RULES))) for key, n in sorted(seen.items())}
    return {key: GRID[i] for key, i in found.items() if i is not None}


def choose(n: np.ndarray, limit: float, level: float) -> int | None:
    """The place in GRID of the best cutoff that passed; n: bad and good rows by the number of cutoffs that they are above."""
    above = n[:, ::-1].cumsum(1)[:, ::-1][:, 1:]  # rows above each cutoff
    total, best, out = int(n[1].sum()), 0, None
    for i in reversed(range(len(GRID))):
        bad, good = int(above[0, i]), int(above[1, i])
        if not total or good > limit * total or upper_bound(good, total, level) > limit:
            break
        if bad - PRICE * good > best:
            best, out = bad - PRICE * good, i
    return out


def judge(stats: DataFrame, cutoffs: dict[tuple[int, str], float]) -> DataFrame:
    """stats with base_failed and kept: false if the base rules fail or a value is above its stratum's cutoff."""
    above = F.lit(False)
    for (s, rule), c in cutoffs.items():
        above = above | ((stratum() == s) & (values()[rule] > c))
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~above)


def op5_quality_rules(spark, sf_dir):
    stats = common.saved(statistics(common.documents(spark, sf_dir, "doc_id", "text")).drop("text"))
    # a label that occurs again is one draw, and bad if any says so; so is a document
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    cutoffs = calibrate(stats.join(labels, "doc_id").dropDuplicates(["doc_id"]))
    return judge(stats, cutoffs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
