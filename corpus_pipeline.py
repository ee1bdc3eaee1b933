"""A training corpus from the documents table: five stages, each over all that the one before it kept."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm import common, language_id, near_dedup, packing, secret_scan, substring_dedup

#: A text that resembles no learned language more than this (1: the profile itself) is rejected.
LEAST_RESEMBLANCE = 0.2
MASK = "[SECRET]"
#: Not expressible in SQL: learned profiles, token ids and dynamic programming.
ORACLE_SQL = None


def _beside(docs: DataFrame) -> DataFrame:
    """doc_id and text, and all columns but the text as `row`: no name of an operator can clash with one of the table."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"))


def _back(rows: DataFrame, docs: DataFrame, text: Column, changed: bool = True) -> DataFrame:
    """The columns of docs from `row`, with this text and, where it may have changed, its length."""
    own = {c: text if c == "text" else F.col(f"row.`{c}`") for c in docs.columns}
    if changed and "n_chars" in own:
        own["n_chars"] = F.coalesce(F.length(text).cast(docs.schema["n_chars"].dataType), own["n_chars"])
    return rows.select(*[x.alias(c) for c, x in own.items()])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters that resemble one of the languages of the corpus; others go.

    Null or empty text, or text without letters: goes. Repeated rows and very
    long texts are judged each for themselves and whole; a null doc_id is no
    reason to go. Columns stay as they are, whatever their names. No rows, or
    none with a language to learn from: no rows.
    """
    profiles = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))))
    judged = language_id.predict(_beside(docs), profiles)
    kept = judged.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_RESEMBLANCE))
    return _back(kept, docs, F.col("text"), changed=False)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (similarity 0.8 of five-word shingles), that of smallest doc_id.

    Null, empty and blank texts and rows without doc_id stay. A doc_id that
    occurs again with another text is a document of its own, so rows go by
    doc_id and text; rows that repeat the one that stays, stay as well. Other
    columns, whatever their names, have no effect. No rows: no rows.
    """
    found = near_dedup.near_duplicates(docs.select("doc_id", "text"), 80, near_dedup.ROWS_80)
    gone, print_ = common.fresh("gone", docs.columns), common.fresh("print", docs.columns)
    dropped = common.saved(found.where("not kept").select(F.col("doc_id").alias(gone), F.col("print").alias(print_)).distinct())
    return docs.join(dropped, (F.col("doc_id") == F.col(gone)) & (F.xxhash64("text") == F.col(print_)), "left_anti").select(*[f"`{c}`" for c in docs.columns])


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 13 words and more that an earlier document has; untouched texts keep their white space.

    Null, empty and short texts stay as they are; a row without doc_id comes
    after all others; rows with one doc_id do not change each other. n_chars
    follows the text, other columns stay, whatever their names. No rows: no rows.
    """
    found = substring_dedup.substring_dedup(_beside(docs))
    return _back(found, docs, F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with live-looking secrets masked; widely copied examples stay.

    Null and empty texts stay as they are. Equal rows are masked alike. Spans
    that overlap are masked as one. n_chars follows the text, other columns
    stay, whatever their names; a table without `source` has one owner. No
    rows: no rows.
    """
    source = F.col("source") if "source" in docs.columns else F.lit(None).cast("string").alias("source")
    found = secret_scan.scan(docs.select("doc_id", "text", source))
    live = F.filter("spans", lambda s: s["live"])
    spans = found.select(F.col("doc_id").alias("id"), "print", F.transform(live, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("spans")).where(F.size("spans") > 0)
    spans = spans.dropDuplicates(["id", "print"])
    rows = _beside(docs).join(spans, F.col("doc_id").cast("long").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("print")), "left").select("row", "text", "spans")

    def mask(batches):
        for batch in batches:
            texts = []
            for text, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                at, parts = 0, []
                for s in own or ():
                    if s["start"] >= at:
                        parts += [text[at : s["start"]], MASK]
                    at = max(at, s["end"])
                texts.append("".join([*parts, text[at:]]) if own else text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "text"])

    return _back(rows.mapInArrow(mask, T.StructType(rows.schema.fields[:2])), docs, F.col("text"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all texts in windows of 2048.

    Null or empty text: only the end id. Every row, also a repeated one or one
    without doc_id, is packed once. Other columns, whatever their names, have no
    effect. No rows: no rows.
    """
    import public_tokenizers

    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("secret_scan", mask_secrets),
    ("packing", pack_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written to the shared folder and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = common.saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
