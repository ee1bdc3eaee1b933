"""Ranked search, k-d shards and token alignment against brute-force versions."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import kd_shards, packing, ranked_search, token_alignment

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


# -- 11 -------------------------------------------------------------------------------------------------------------


def ranked(rows, items, k):
    """Every document scored for every item."""
    counts = [(i, collections.Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in rows]
    counts = [(i, c, c.total()) for i, c in counts if c]
    n, size = len(counts), sum(x[2] for x in counts)
    df = collections.Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        own = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in set(TERM.findall((text or "").translate(LOWER))) if df[t]}
        found = []
        for i, c, m in counts:
            norm = 100 - 50 + 50 * m * n // size
            score = sum(w * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * norm)) for t, w in own.items() if c[t])
            if score > 0:
                found.append((-score, i is None, i, -score))
        for rank, (s, _, i, _) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1):
            out.append((item, rank, i, -s))
    return sorted(out, key=repr)


def searched(spark, docs, items, k):
    asked = items if not isinstance(items, list) else spark.createDataFrame(items, "item_id long, text string")
    return sorted(map(tuple, ranked_search.search(docs, asked, k).collect()), key=repr)


ITEMS = [(1, "w1é W2 w3é w17 spam"), (2, "日本語 Ünï x"), (3, None), (4, "  --\t"), (5, "nowhere_to_be_found!"), (6, " ".join(f"w{i}é w{i}" for i in range(400))), (6, "A b ab"), (None, "a")]


def test_ranks(spark, docs, corpus, empty, odd, monkeypatch):
    want = ranked([r[:2] for r in corpus], ITEMS, 7)
    assert searched(spark, docs.withColumn("item_id", F.lit("x")).withColumn("score", F.lit(1)), ITEMS, 7) == want and len(want) > 20
    # more shards, blocks and stretches than rows need
    for name, value in (("SHARD_BYTES", 4_000), ("BLOCK_ITEMS", 3), ("FIRST_STRETCH", 2), ("LAST_STRETCH", 4)):
        monkeypatch.setattr(ranked_search, name, value)
    assert searched(spark, docs.coalesce(2), ITEMS, 7) == want
    assert searched(spark, empty, ITEMS, 7) == [] and searched(spark, docs, [], 7) == []
    assert [(r[0], r[2]) for r in searched(spark, odd, [(9, "WORDS")], 7)] == [(9, 1), (9, None)]  # equal scores: without doc_id last


def test_ties_and_equal_rows(spark):
    rows = [(i, "one two two") for i in (5, 3, 9, 3, None, 1)] + [(2, "zero"), (4, "one"), (8, None), (7, "...")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    items = [(1, "two one"), (2, "ONE"), (3, "two")]
    for k in (2, 4, 50):
        assert searched(spark, df, items, k) == ranked(rows, items, k)


def test_random_collections(spark, monkeypatch):
    """Few heavy and many light terms, so that most terms are only looked up."""
    rng = random.Random(5)
    term = lambda: f"t{int(rng.paretovariate(0.7)) % 300}"
    rows = [(i, " ".join(term() for _ in range(rng.choice([1, 4, 30, 200])))) for i in rng.sample(range(5000), 1500)]
    items = [(i, " ".join(term() for _ in range(25))) for i in range(12)]
    monkeypatch.setattr(ranked_search, "SHARD_BYTES", 60_000)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert searched(spark, df, items, 10) == ranked(rows, items, 10)


def test_numbers_in_bytes():
    values = np.array([0, 1, 127, 128, 16_383, 16_384, 2**31, 2**62], np.int64)
    raw, size = ranked_search.packed(values)
    assert size.tolist() == [1, 1, 1, 2, 2, 3, 5, 9] and ranked_search.unpacked(raw).tolist() == values.tolist()
    assert ranked_search.unpacked(raw[:0]).size == 0


# -- 12 -------------------------------------------------------------------------------------------------------------


def kd_tree(rows, keys, shards):
    """The shard of each row number: rows are (row, size, keys), all sorted at each node."""
    out = {}

    def divide(own, first, k):
        if k == 1 or not own:
            out.update((r[0], first) for r in own)
            return
        step = 1 << kd_shards.HASH_BITS
        width = [max(r[2][d] // step for r in own) - min(r[2][d] // step for r in own) for d in range(keys)]
        d = width.index(max(width))
        own = sorted(own, key=lambda r: (r[2][d], r[0]))
        total = sum(r[1] for r in own)
        target, slack, at, cuts = total * (k // 2) // k, round(kd_shards.SLACK * total / k), 0, []
        for i in range(len(own) + 1):
            between = i in (0, len(own)) or own[i - 1][2][d] != own[i][2][d]
            off = abs(at - target)
            cuts.append((0 if between and off <= slack else 1, off, i))
            at += own[i][1] if i < len(own) else 0
        i = min(cuts)[2]
        divide(own[:i], first, k // 2)
        divide(own[i:], first + k // 2, k - k // 2)

    divide(rows, 0, shards)
    return out


def check_shards(rows, found, shards):
    want = collections.Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in found) == want
    slots = collections.defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) <= set(range(shards))


def test_shards(spark, docs, corpus, empty, odd):
    found = kd_shards.kd_shards(docs.withColumn("row", F.lit("mine")).withColumn("k0", F.lit(1)).withColumn("salt", F.lit(1)), 8).collect()
    check_shards(corpus, found, 8)
    assert kd_shards.kd_shards(empty, 8).collect() == []
    check_shards([(r.doc_id, r.text) for r in odd.collect()], kd_shards.kd_shards(odd, 3).collect(), 3)
    check_shards(corpus[:3], kd_shards.kd_shards(spark.createDataFrame(corpus[:3], docs.schema), 40).collect(), 40)
    bare = kd_shards.kd_shards(docs.select("doc_id", "text"), target_bytes=20_000).collect()
    check_shards(corpus, bare, 1 + sum(len((t or "").encode()) + 16 for _, t, *_ in corpus) // 20_000)


@pytest.mark.parametrize("few, bins", [(16_384, 1024), (3, 4)])
def test_shards_are_the_tree(spark, monkeypatch, few, bins):
    """Also with so few bins and rows that cuts are found in several rounds, and within a group."""
    monkeypatch.setattr(kd_shards, "FEW", few)
    monkeypatch.setattr(kd_shards, "BINS", bins)
    rng = random.Random(few)
    texts = ["x" * rng.randrange(1, 400) + str(i) for i in range(120)] + ["copy " * 50] * 90 + [texts_ for texts_ in ("pair", "pair", None, "")]
    rows = [(i, t, rng.choice(["en", "de", "es", None]), rng.choice(["a", "b"]), float(len(t or "")) if i % 9 else None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars double").repartition(3)
    narrow = kd_shards.narrow(df, ("lang", "source", "n_chars"))
    keys = [c for c in narrow.columns if c[0] == "k"]
    want = kd_tree([(r.row, r["size"], [r[c] for c in keys]) for r in narrow.collect()], len(keys), 7)
    assert {r.row: r.shard for r in kd_shards._divide(narrow, 7).collect()} == want and set(want.values()) == set(range(7))
    sizes = collections.Counter()
    for r in kd_shards.kd_shards(df, 7).collect():
        sizes[r.shard] += r["size"]
    assert max(sizes.values()) - min(sizes.values()) < 3 * 420


def test_equal_texts_stay_together(spark):
    rng = random.Random(3)
    rows = [(i, f"text {i // 3} " * rng.randrange(3, 9), rng.choice(["en", "de"]), f"s{i % 5}", i) for i in range(900)]
    rows = [(i, rows[i - i % 3][1], lang, source, n) for i, _, lang, source, n in rows]
    found = kd_shards.kd_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), 6).collect()
    by, text = collections.defaultdict(set), {r[0]: r[1] for r in rows}
    for r in found:
        by[text[r.doc_id]].add(r.shard)
    assert len(by) == 300 and sum(len(x) > 1 for x in by.values()) <= 5  # no more than there are cuts


# -- 13 -------------------------------------------------------------------------------------------------------------

PATHS = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def aligned():
    """Brute force with both libraries: for rows (doc_id, text), the operator's rows."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_lib, b_lib, char = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1]), packing._byte_chars()
    a_lib.encode_special_tokens = True

    def groups_of(text):
        whole = (" " + text).encode()
        a, b = a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)
        a_raw = [bytes(char[c] for c in a_lib.id_to_token(x)) for x in a]
        b_raw = [bytes([int(p[3:5], 16)]) if b_lib.is_byte(x) else p.replace("▁", " ").encode() for x in b for p in [b_lib.id_to_piece(x)]]
        if b"".join(a_raw) != whole or b"".join(b_raw) != whole:
            return []
        ends = lambda raw: np.cumsum([len(x) for x in raw]).tolist()
        cuts = sorted(set(ends(a_raw)) & set(ends(b_raw)))
        own = [([], []) for _ in cuts]
        for side, (ids, raw) in enumerate(((a, a_raw), (b, b_raw))):
            for i, e in zip(ids, ends(raw), strict=True):
                own[next(k for k, c in enumerate(cuts) if c >= e)][side].append(i)
        return own

    def run(rows):
        held = [(i, groups_of(t) if t else []) for i, t, *_ in rows]
        links = [collections.Counter((x, y) for a, b in g for x in a for y in b) for _, g in held]
        df = collections.Counter(k for x in links for k in x)
        top = collections.Counter()
        for (a, _), n in df.items():
            top[a] = max(top[a], n)
        out = []
        for (i, g), x in zip(held, links, strict=True):
            said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
            out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), x.total(), sum(n for k, n in x.items() if df[k] == top[k[0]]), sum(n * df[k] for k, n in x.items()), hashlib.sha256(said.encode()).hexdigest() if g else ""))
        return sorted(out, key=repr)

    return run


def test_alignment(spark, docs, corpus, empty, odd, aligned, monkeypatch):
    rows = [r[:2] for r in corpus if len(r[1] or "") < 9000]
    df = docs.where("text is null or length(text) < 9000").withColumn("keys", F.lit(1)).withColumn("a", F.lit("mine"))
    got = sorted(map(tuple, token_alignment.alignment(df, *PATHS).collect()), key=repr)
    assert got == aligned(rows) and sum(r[4] for r in got) > 5000
    monkeypatch.setattr(token_alignment, "HELD", 64)  # counts are handed on early, pairs are made a few at a time
    monkeypatch.setattr(token_alignment, "ROW", 10)
    monkeypatch.setattr(token_alignment, "CHUNK", 40)
    monkeypatch.setattr(token_alignment, "AT_ONCE", 50)
    monkeypatch.setattr(token_alignment, "LARGE_GROUP", 3)
    assert sorted(map(tuple, token_alignment.alignment(df, *PATHS).collect()), key=repr) == got
    assert token_alignment.alignment(empty, *PATHS).collect() == []
    assert token_alignment.alignment(odd, *PATHS).count() == 4


def test_alignment_of_odd_texts(spark, aligned):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab e▁\t\n日é😀\x00<>s|endoftext  ,.12ﬁ́") for _ in range(rng.randrange(40))) for _ in range(300)]
    texts += ["<|endoftext|>", "a <|endoftext|> b </s> <s> <unk> <0x41>", "▁", " ", "  x", "=" * 999, "a" * 501, "ab" * 400, " " * 77, "\n" * 33, "é" * 200, "😀" * 90, "ﷺ" * 30, "x\r\n\r\ny", None, "", "hello", "hello"]
    rows = list(enumerate(texts)) + [(0, "again"), (None, "hello")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, token_alignment.alignment(df, *PATHS).collect()), key=repr) == aligned(rows)


def test_shards_that_spark_sends(spark, aligned):
    """Executors that cannot open the shared folder get the files from Spark."""
    rows = [(i, f"some words that repeat {i % 7}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = token_alignment.common.saved(token_alignment.align(df, *PATHS))
    counts = token_alignment.pair_counts(whole)
    found = token_alignment.Shards.of(counts)
    for file, *_ in found.files:
        spark.sparkContext.addFile(file)
    far = token_alignment.Shards(found.files, False)
    keys = np.array(sorted(r.key for r in counts.collect()))
    want = {r.key: r.n for r in counts.collect()}
    assert far.counts(keys).tolist() == found.counts(keys).tolist() == [want[k] for k in keys.tolist()]
    assert keys.size == len(want) > 5


def test_large_groups(aligned):
    """Groups whose tokens meet nowhere are counted by their distinct ids."""
    pair = token_alignment.load(*PATHS)
    a, b = np.array([5, 6, 5, 7], np.uint16), np.array([300, 301, 300], np.uint16)
    pair_like = type("Sizes", (), {"a_size": np.full(10, 3), "b_size": np.full(400, 4)})()
    groups = token_alignment.Groups(pair_like, a, np.array([0, 4]), b, np.array([0, 3]))
    plain = collections.Counter(k for _, keys, _ in groups.links() for k in keys.tolist())
    try:
        token_alignment.LARGE_GROUP, old = 2, token_alignment.LARGE_GROUP
        merged = collections.Counter()
        for _, keys, many in groups.links():
            merged.update(dict(zip(keys.tolist(), many.tolist(), strict=True)))
    finally:
        token_alignment.LARGE_GROUP = old
    assert plain == merged and plain.total() == 12 and groups.written(pair) == [hashlib.sha256(b"5,6,5,7|300,301,300").hexdigest()]
    texts = pa.array(["", "some words"], pa.large_string())
    assert pair.encode(texts)[1].tolist()[:2] == [0, 0]
