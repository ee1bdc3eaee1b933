"""Language identification by rank-order profiles of character n-grams.

A profile is the list of the n-grams (1 to 3 letters, with word edges) that are
most frequent in a language. A document's own list is compared with each
profile by the out-of-place distance: the sum over its n-grams of the difference
of the two ranks, or the list length where the profile lacks the n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: n-grams of a profile, and of a document that are compared.
LENGTH = 300
UNKNOWN = "und"
#: Above all letters: the edge of a word. Keys of n-grams hold 21 bits a character, 0 where there is none.
_EDGE, _BITS = 0x1FFFFF, 21
_letter: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _letter
    if _letter is None:
        _letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letter


class Grams:
    """n-grams of a batch: row, key and count, by row and then by key."""

    def __init__(self, column: pa.Array):
        data, offsets = common.utf8(pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), "")))
        self.rows = offsets.size - 1
        cp = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int32)
        at = np.r_[0, np.cumsum((data & 0xC0) != 0x80)][offsets]
        is_letter = _letters()[cp]
        lead = np.zeros(cp.size + 1, bool)
        lead[at] = True
        word = np.zeros(cp.size, bool)  # the first letter of each word
        if cp.size:
            word[0] = is_letter[0]
            word[1:] = is_letter[1:] & (~is_letter[:-1] | lead[1:-1])
        # letters with an edge before each word and after the last one of each row
        keep = np.flatnonzero(is_letter)
        row = np.searchsorted(at, keep, "right") - 1
        seen = np.zeros(0x110000, bool)
        seen[cp[keep]] = True
        self.alphabet = np.r_[0, np.flatnonzero(seen), _EDGE].astype(np.int64)  # dense codes keep the order of letters
        dense = np.zeros(0x110000, np.int64)
        dense[self.alphabet[1:-1]] = np.arange(1, self.alphabet.size - 1)
        edge, base = self.alphabet.size - 1, self.alphabet.size
        first = word[keep]
        n = keep.size + int(first.sum())
        code, owner = np.full(n + 1, edge), np.full(n + 1, -1)
        place = np.arange(keep.size) + np.cumsum(first)
        code[place], owner[place] = dense[cp[keep]], row
        owner[place[first] - 1] = row[first]
        # an edge also ends the word before it
        c, b, a = code[2:], code[1:-1], code[:-2]
        own = owner[1:-1]
        if self.alphabet.size**3 * max(1, self.rows) >= 2**62:
            raise ValueError("too many letters for one batch; make Arrow batches smaller")
        three = (a * base + b) * base + c
        inner = b != edge
        two = np.r_[(a * base + b)[inner], (b * base + c)[inner & (c == edge)]]
        parts = [(own[inner], three[inner]), (np.r_[own[inner], own[inner & (c == edge)]], two), (own[inner], b[inner])]
        key = np.sort(np.concatenate([o * base**3 + k for o, k in parts])) if n else np.zeros(0, np.int64)
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if key.size else np.zeros(0, np.int64)
        self.count = np.diff(np.r_[new, key.size])
        self.row, self.dense = key[new] // base**3, key[new] % base**3
        self.base = base

    def keys(self, dense: np.ndarray) -> np.ndarray:
        b, a = self.base, self.alphabet
        return (a[dense // (b * b)] << (2 * _BITS)) | (a[dense // b % b] << _BITS) | a[dense % b]

    def top(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, key and rank of each row's most frequent n-grams; ties: the smaller key first."""
        order = np.lexsort((-self.count, self.row))  # stable: ties stay in order of keys
        row = self.row[order]
        rank = np.arange(row.size) - np.searchsorted(row, np.arange(self.rows))[row] if row.size else row
        keep = rank < length
        return row[keep], self.keys(self.dense[order[keep]]), rank[keep]


def train(labelled: DataFrame, length: int = LENGTH) -> dict[str, list[int]]:
    """n-grams by language, most frequent first, from all rows with a text and a lang (ties: the smaller key).

    Counts cover every row. Languages without a letter have no profile; the
    result is languages x length keys, however large the input is.
    """
    common.arrow_batches(labelled.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in common.slices(whole, "text", 1 << 19)):
            lang = batch.column(1).to_pylist()
            for name in dict.fromkeys(lang):
                pick = pa.array([x == name for x in lang])
                g = Grams(batch.column(0).filter(pick))
                key, at = np.unique(g.dense, return_inverse=True)
                total = np.bincount(at, g.count, key.size).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * key.size, pa.string()), pa.array(g.keys(key)), pa.array(total)], ["lang", "gram", "n"])

    rows = labelled.where("lang is not null and text is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # each task keeps its first `length` of a language before the shuffle, so no language gathers in one
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    found: dict[str, list[int]] = {}
    for r in sorted(counts.withColumn("rank", rank).where(F.col("rank") <= length).collect(), key=lambda r: (r.lang, r["rank"])):
        found.setdefault(r.lang, []).append(r.gram)
    return found


def predict(docs: DataFrame, profiles: dict[str, list[int]], length: int = LENGTH) -> DataFrame:
    """The rows of docs with lang_pred and score (1 less the distance over the largest possible one).

    Null text, or text without a letter: `und` and 0. Equal distances: the
    first language by name. No profiles: `und`. Every row is judged for itself,
    by its whole text; columns lang_pred and score of the input are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    common.arrow_batches(docs.sparkSession)
    names = sorted(profiles)
    known = np.array(sorted({k for x in profiles.values() for k in x}), np.int64)
    ranks = np.full((len(names), known.size + 1), -1)
    for i, name in enumerate(names):
        ranks[i, np.searchsorted(known, np.array(profiles[name], np.int64))] = np.arange(len(profiles[name]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in common.slices(whole, "text", 1 << 19)):
            row, key, rank = Grams(batch.column("text")).top(length)
            at = np.searchsorted(known, key)
            at[(at == known.size) | (known[np.minimum(at, max(known.size - 1, 0))] != key) if known.size else slice(None)] = known.size
            n = np.bincount(row, minlength=batch.num_rows)
            away = np.empty((len(names), batch.num_rows))
            for i in range(len(names)):
                own = ranks[i, at]
                away[i] = np.bincount(row, np.where(own < 0, length, np.abs(own - rank)), batch.num_rows)
            if names:
                best = away.argmin(0)
                score = np.where(n > 0, 1 - away.min(0) / np.maximum(1, n * length), 0.0)
                lang = [names[b] if k else UNKNOWN for b, k in zip(best.tolist(), n.tolist(), strict=True)]
            else:
                lang, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score)], [*batch.schema.names, "lang_pred", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructType

    return docs.mapInArrow(run, StructType(list(docs.schema.fields)).add("lang_pred", StringType()).add("score", DoubleType()))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op4_language_id(spark, sf_dir):
    docs = common.documents(spark, sf_dir, "doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    profiles = train(docs.where(~F.col("held_out")))
    return predict(docs.drop("lang"), profiles).select("doc_id", "held_out", "lang_pred", "score")
