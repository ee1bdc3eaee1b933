"""Packing of token streams into windows, by order-preserving dynamic programming.

Documents keep the order in which a partition holds them. Cuts are allowed at
document ends (free), after sentences (a small penalty) and, so that no gap is
longer than FILL, at some other places (a larger penalty). The cheapest chain of
cuts is found by

    cost[j] = penalty[j] + min over i of cost[i] + padding(place[j] - place[i]),

where padding(n) = window - n, so that the minimum is that of cost[i] + place[i]
over a sliding range of i: a monotone queue gives it in constant time. A length
that is a power of two needs no padding; those few i are looked at as well.
"""

from __future__ import annotations

import json
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Longest gap between two allowed cuts, in tokens.
FILL = 64
SENTENCE_CUT, FORCED_CUT, SEQUENCE = 1.0, 4.0, 8.0
#: Tokens of a block, which is packed for itself; documents are never divided between blocks.
BLOCK = 1 << 20
#: Set where other white space than the ASCII ones may end in UTF-8: no unit begins after such a byte.
_WIDE_SPACE_ENDS = np.zeros(256, bool)
_WIDE_SPACE_ENDS[[*range(0x80, 0x8B), 0x9A, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_loaded: dict[str, ByteTokens] = {}


class ByteTokens:
    """Ids of a byte-level BPE tokenizer file; units that are not yet known are encoded by rank merging of the same vocabulary."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path) as f:
            config = json.load(f)
        model, pre = config["model"], config["pre_tokenizer"] or {}
        self.special = [x["content"].encode() for x in config["added_tokens"]]
        special = {x["content"] for x in config["added_tokens"]}
        char = _byte_chars()
        self.bytes = {i: bytes(char[c] for c in t) for t, i in model["vocab"].items() if t not in special}
        merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        plain = config["normalizer"] is None and config["post_processor"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not model.get("ignore_merges")
        self.units = None
        if plain and all(model["vocab"][m] == 256 + i for i, m in enumerate(merges)):
            self.ranks = tiktoken.Encoding("units", pat_str=_PATTERN, mergeable_ranks={b: i for i, b in self.bytes.items()}, special_tokens={})
            self.units = common.Units(300_000)
        sentence = np.zeros(max(model["vocab"].values()) + 2, bool)
        for i, b in self.bytes.items():
            sentence[i] = b.strip()[-1:] in (b".", b"!", b"?") or b"\n" in b
        self.sentence = sentence

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all rows, and the n + 1 bounds of the rows in them."""
        data, offsets = common.utf8(column)
        raw = data.tobytes()
        if self.units is None or any(x in raw for x in self.special):
            texts = [x.decode() for x in common.texts_of(data, offsets)]
            rows = [e.ids for e in self.whole.encode_batch(texts, add_special_tokens=False)]
            return np.array([i for x in rows for i in x], "<u4"), np.r_[0, np.cumsum([len(x) for x in rows])].astype(np.int64)
        opens = np.zeros(data.size, bool)
        if data.size:
            gap = common._SPACE[data]
            opens[1:] = gap[1:] & ~gap[:-1] & ~_WIDE_SPACE_ENDS[data[:-1]]
            opens[offsets[:-1][offsets[:-1] < data.size]] = True
        encode = self.ranks._core_bpe.encode_ordinary
        return self.units.ids(data, np.flatnonzero(opens), offsets, lambda units: [array("I", encode(x.decode())).tobytes() for x in units])


def _byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def load(path: str) -> ByteTokens:
    if path not in _loaded:
        _loaded[path] = ByteTokens(path)
    return _loaded[path]


def places(bounds: np.ndarray, sentence: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Allowed cuts in ascending order, and the penalty of each. bounds: document starts and the end; sentence: whether a sentence ends after a token."""
    total = int(bounds[-1])
    free = bounds[1:]
    after = np.flatnonzero(sentence) + 1
    own = np.unique(np.r_[0, after, free])
    gaps = np.diff(own)
    long = np.flatnonzero(gaps > FILL)
    steps = (gaps[long] - 1) // FILL
    fill = np.repeat(own[long], steps) + FILL * (common.ranges(np.ones(long.size, np.int64), steps) if long.size else np.zeros(0, np.int64))
    at = np.unique(np.r_[own, fill, np.arange(max(0, total - window), total)])
    cost = np.full(at.size, FORCED_CUT)
    cost[np.searchsorted(at, after)] = SENTENCE_CUT
    cost[np.searchsorted(at, free)] = 0.0
    cost[0] = 0.0
    return at, cost


def best_cuts(at: np.ndarray, penalty: np.ndarray, window: int) -> np.ndarray:
    """The places of the cheapest chain of cuts from the first place to the last, both included."""
    if at.size < 2:
        return at
    near: dict[int, list[int]] = {}
    for k in range(int(window).bit_length() - 1 if window & (window - 1) == 0 else int(window).bit_length()):
        i = np.searchsorted(at, at - (1 << k))
        for j in np.flatnonzero(at[i] == at - (1 << k)).tolist():
            near.setdefault(j, []).append(int(i[j]))
    where, fee, cost, back = at.tolist(), penalty.tolist(), [0.0] * at.size, [0] * at.size
    queue: deque[tuple[float, int, int]] = deque([(float(where[0]), 0, where[0])])
    for j in range(1, len(where)):
        x = where[j]
        while x - queue[0][2] > window:
            queue.popleft()
        low, i, _ = queue[0]
        low += window - x
        for k in near.get(j, ()):
            if cost[k] < low:
                low, i = cost[k], k
        low += fee[j] + SEQUENCE
        cost[j], back[j] = low, i
        key = low + x
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j, x))
    chain, j = [len(where) - 1], len(where) - 1
    while j:
        j = back[j]
        chain.append(j)
    return at[np.array(chain[::-1])]


def pack(docs: DataFrame, path: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Null or empty text: only the end id. Each row is a document of its own, also
    if its doc_id is null or occurs again. Equal costs: the earliest cut of the
    queue. A sequence lies in one block of one partition, so no shuffle is
    needed; sequence_id is unique, not consecutive. Other columns have no effect.
    The tokenizer file must be readable on the executors.
    """
    common.arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part = load(path), TaskContext.get().partitionId()
        held, keys, size, sequence = [], [], 0, part << 36

        def flush():
            nonlocal sequence
            ids = np.concatenate(held)
            n = np.concatenate([np.diff(x[1]) for x in keys])
            bounds = np.r_[0, np.cumsum(n)]
            cuts = best_cuts(*places(bounds, tokens.sentence[np.minimum(ids, tokens.sentence.size - 1)], window), window)
            begin = np.union1d(bounds[:-1], cuts[:-1])
            stop = np.r_[begin[1:], bounds[-1]]
            doc, seq = np.searchsorted(bounds, begin, "right") - 1, np.searchsorted(cuts, begin, "right") - 1
            raw = ids.tobytes()
            yield from pa.Table.from_arrays(
                [
                    pa.concat_arrays([x[0] for x in keys]).take(pa.array(doc)),
                    pa.array(begin - bounds[doc]),
                    pa.array(stop - begin),
                    pa.array([raw[4 * a : 4 * b] for a, b in zip(begin.tolist(), stop.tolist(), strict=True)], pa.binary()),
                    pa.array(n[doc]),
                    pa.array(sequence + seq),
                    pa.array(begin - cuts[seq]),
                ],
                ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            ).to_batches()
            sequence += cuts.size - 1
            held.clear()
            keys.clear()

        for batch in (part for whole in batches for part in common.slices(whole, "text")):
            ids, bounds = tokens.encode(batch.column(1))
            held.append(np.insert(ids, bounds[1:], end_id).astype("<u4"))
            keys.append((batch.column(0), bounds + np.arange(bounds.size)))
            size += held[-1].size
            if size >= BLOCK:
                yield from flush()
                size = 0
        if keys:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def op9_packing(spark, sf_dir):
    import public_tokenizers

    found = pack(common.documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
