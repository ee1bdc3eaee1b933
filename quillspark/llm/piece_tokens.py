"""SentencePiece BPE encoding by a table of each prefix's last token, and decoding.

For merge-ranked pieces, the encoding of any prefix that ends on a token is the
beginning of the whole encoding, so each prefix has one last token. An
Aho-Corasick automaton reports all pieces that end at a position; a piece fits
if it and the last token of the prefix before it are compatible: encoded
together, they stay the same two tokens. Ids are read backwards from the end.

Tokens never hold the space mark after another character, so a text is encoded
in units of one run of marks and what follows it; units are remembered.
"""

from __future__ import annotations

import struct
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Pairs and units that a worker remembers before it starts anew.
MEMO = 600_000
_loaded: dict[str, PieceModel] = {}


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = raw[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol buffer message."""
    at = 0
    while at < len(raw):
        key, at = _varint(raw, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(raw, at)
        else:
            size, at = _varint(raw, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = raw[at : at + size], at + size
        yield key >> 3, value


class PieceModel:
    """A BPE model with byte fallback, identity normalisation and a dummy prefix."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, "rb") as f:
            raw = f.read()
        self.pieces, trainer, normal = [], {}, {}
        for number, value in _fields(raw):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append((own[1].decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normal = dict(_fields(value))
        if sys.byteorder != "little" or trainer.get(3) != 2 or not trainer.get(35) or normal.get(2) or normal.get(4, 1) or not normal.get(3, 1) or any(k in (USER, UNUSED) for *_, k in self.pieces):
            raise ValueError("only BPE models with byte fallback, identity normalisation, kept white space, a dummy prefix and no user-defined pieces are supported")
        self.begin, self.end, self.unknown = trainer.get(41, 1), trainer.get(42, 2), trainer.get(40, 0)
        self.score = {p: s for p, s, k in self.pieces if k == NORMAL}
        self.id = {p: i for i, (p, _, k) in enumerate(self.pieces) if k == NORMAL}
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece holds the space mark after another character")
        self.byte = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(self.pieces) if k == BYTE}
        self.automaton = ahocorasick.Automaton()
        #: Of each piece that encodes as itself: the scores of its merges in their order, and its first and last part after each.
        self.history: dict[int, tuple[list[float], list[str], list[str]]] = {}
        for p, i in self.id.items():
            parts, *own = self.merged(p)
            if parts == [p]:
                self.history[i] = own
                if len(p) > 1:
                    self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.units = common.Units(MEMO)
        self.text = [b"" if k == CONTROL else bytes([int(p[3:5], 16)]) if k == BYTE else b" \xe2\x81\x87 " if k == UNKNOWN else p.replace(MARK, " ").encode() for p, _, k in self.pieces]
        self.text_size = np.array([len(x) for x in self.text])
        self.text_begin = np.cumsum(self.text_size) - self.text_size
        self.text_pool = np.frombuffer(b"".join(self.text), np.uint8)
        self.is_byte = np.array([k == BYTE for *_, k in self.pieces])

    def merged(self, text: str) -> tuple[list[str], list[float], list[str], list[str]]:
        """The definition: of all neighbours whose concatenation is a piece, merge the best scored, leftmost first. For short texts."""
        parts, scores, first, last = list(text), [], [text[:1]], [text[-1:]]
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts, scores, first, last
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            scores.append(best)
            first.append(parts[0])
            last.append(parts[-1])

    def compatible(self, left: int, right: int) -> bool:
        """Whether no merge across the two comes before the merges that make them; left is -1 for an unknown character.

        The two merge independently, the better scored next merge first, until
        a merge of the left one's last part with the right one's first part is due.
        """
        if left < 0:
            return True
        (sa, _, ra), (sb, lb, _) = self.history[left], self.history[right]
        i = j = 0
        while True:
            cross = self.score.get(ra[i] + lb[j])
            a = sa[i] if i < len(sa) else None
            b = sb[j] if j < len(sb) else None
            if cross is not None and (a is None or cross > a) and (b is None or cross >= b):
                return False
            if a is None and b is None:
                return True
            if b is None or a is not None and a >= b:
                i += 1
            else:
                j += 1

    def unit_ids(self, unit: str) -> bytes:
        """Ids of a text without spaces, by the table of each prefix's last token."""
        last, size, pairs, done = [self.id.get(c, -1) for c in unit], [1] * len(unit), self.pairs, -1
        for stop, (piece, n) in self.automaton.iter(unit):
            if stop != done:
                before = stop - n
                if before >= 0:
                    key = last[before] << 20 | piece
                    fits = pairs.get(key)
                    if fits is None:
                        if len(pairs) >= MEMO:
                            pairs.clear()
                        fits = pairs[key] = self.compatible(last[before], piece)
                    if not fits:
                        continue
                last[stop], size[stop], done = piece, n, stop
        ids, at = [], len(unit) - 1
        while at >= 0:
            i = last[at]
            if i >= 0:
                ids.append(i)
            else:
                ids.extend(self.byte[b] for b in reversed(unit[at].encode()))
            at -= size[at]
        ids.reverse()
        return array("I", ids).tobytes()

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all rows, begin and end included, and the n + 1 offsets of the rows in them."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        if pc.any(pc.match_substring(column, MARK)).as_py():
            column = pc.replace_substring(column, MARK, " ")  # both mean the same to the model
        column = pc.if_else(pc.equal(column, ""), column, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), column, pa.scalar("", pa.large_string())))
        data, offsets = common.utf8(column)
        opens = np.zeros(data.size, bool)
        if data.size:
            mark = data == 0x20
            opens[1:] = mark[1:] & ~mark[:-1]
            opens[offsets[:-1][offsets[:-1] < data.size]] = True
        out, edges = self.units.ids(data, np.flatnonzero(opens), offsets, lambda units: [self.unit_ids(x.decode().replace(" ", MARK)) for x in units])
        row = np.arange(offsets.size - 1)
        ids = np.empty(out.size + 2 * row.size, "<u4")
        bounds = edges + 2 * np.arange(edges.size)
        inner = np.ones(ids.size, bool)
        inner[bounds[:-1]] = inner[bounds[1:] - 1] = False
        ids[inner] = out
        ids[bounds[:-1]], ids[bounds[1:] - 1] = self.begin, self.end
        return ids, bounds

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The texts of rows of ids. Runs of byte pieces are read as UTF-8; a byte that is not part of it becomes U+FFFD."""
        codes = ids.astype(np.int64)
        n = self.text_size[codes]
        text = np.r_[0, np.cumsum(n)][bounds].tolist()
        raw = self.text_pool[common.ranges(self.text_begin[codes], n)].tobytes()
        out = []
        for i, (a, b) in enumerate(zip(text[:-1], text[1:], strict=True)):
            own = codes[bounds[i] : bounds[i + 1]]
            piece = raw[a:b]
            try:
                x = piece.decode()
            except UnicodeDecodeError:
                x = self._slowly(own)
            out.append(x[1:] if x[:1] == " " and self._first_is_mark(own) else x)
        return out

    def _slowly(self, codes: np.ndarray) -> str:
        parts, at = [], 0
        odd = np.flatnonzero(self.is_byte[codes])
        cut = np.flatnonzero(np.diff(odd) > 1)
        for a, b in zip(odd[np.r_[0, cut + 1]].tolist(), (odd[np.r_[cut, odd.size - 1]] + 1).tolist(), strict=True):
            parts += [self.text[i] for i in codes[at:a].tolist()]
            parts.append(_lenient(b"".join([self.text[i] for i in codes[a:b].tolist()])))
            at = b
        parts += [self.text[i] for i in codes[at:].tolist()]
        return b"".join(parts).decode()

    def _first_is_mark(self, codes: np.ndarray) -> bool:
        for i in codes[:4].tolist():
            piece, _, kind = self.pieces[i]
            if kind != CONTROL:
                return piece.startswith(MARK)
        return False


def _lenient(raw: bytes) -> bytes:
    """raw with each byte that is not part of valid UTF-8 replaced."""
    try:
        raw.decode()
        return raw
    except UnicodeDecodeError:
        out = []
        while raw:
            for n in range(1, 5):
                try:
                    raw[:n].decode()
                    break
                except UnicodeDecodeError:
                    continue
            else:
                n = 0
            out.append(raw[:n] if n else "�".encode())
            raw = raw[max(n, 1) :]
        return b"".join(out)


def load(path: str) -> PieceModel:
    if path not in _loaded:
        _loaded[path] = PieceModel(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit, begin and end included) and decoded text of each row.

    Null or empty text: the begin and end ids, decoded to "". Each row is
    encoded for itself: ties, repeated rows and other columns have no effect.
    The model file must be readable on the executors.
    """
    common.arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in (part for whole in batches for part in common.slices(whole, "text")):
            ids, bounds = model.encode(batch.column(1))
            raw = ids.tobytes()
            rows = pa.array([raw[4 * a : 4 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), rows, pa.array(model.decode(ids, bounds), pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids binary, decoded string")


def op1_sentencepiece(spark, sf_dir):
    import public_tokenizers

    found = encode(common.documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
