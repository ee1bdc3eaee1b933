"""Uploaded files and pages as DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layout, tasks


def uploads(spark: SparkSession, path: str, most_bytes: int = 256 << 20) -> DataFrame:
    """path, name, length, suffix, stem, kind, accepted, error of the files below a path; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.regexp_extract("path", "[^/]*$", 0).alias("name"), "length")
    gated = tasks.gate(files)
    too_large = F.col("length") > most_bytes
    return gated.withColumn("error", F.when(too_large, F.lit("upload too large")).when(~F.col("accepted"), F.concat(F.lit("Unsupported file type: "), "suffix"))).withColumn("accepted", F.col("accepted") & ~too_large)


def pages(files: DataFrame, page_count: Callable[[bytes], int], start: Column, end: Column, window: int) -> DataFrame:
    """A row for each page of files (path, content) within a range, with its window; page_count opens a file, in one Arrow stage.

    With a column `kind`, images are one page each, and are not opened.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([page_count(x) for x in b.column(1).to_pylist()], pa.int64())], ["path", "n_pages"])

    image = F.coalesce(F.col("kind") == "image", F.lit(False)) if "kind" in files.columns else F.lit(False)
    counted = files.where(~image).select("path", "content").mapInArrow(run, "path string, n_pages long").unionAll(files.where(image).select("path", F.lit(1).cast("long")))
    return layout.page_windows(counted, "n_pages", start, end, window)


def rendered(pages: DataFrame, render: Callable[[bytes, int], tuple[bytes, int, int]], content: str = "content") -> DataFrame:
    """pages (path, page_idx, content) with png, page_w and page_h by a renderer, a page at a time; page_md5 names its crops."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [render(c, i) for c, i in zip(b.column(2).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32())], ["path", "page_idx", "png", "page_w", "page_h"])

    out = pages.select("path", F.col("page_idx").cast("long"), content).mapInArrow(run, "path string, page_idx long, png binary, page_w int, page_h int")
    return out.withColumn("page_md5", F.upper(F.md5("png")))
