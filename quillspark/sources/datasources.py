"""Files in and out as Spark data sources: pages read window by window, documents written with a commit.

Both need folders that all executors can open. Register a class with
spark.dataSource.register(); it is then a format by its name().
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions import text
from ..operators import layout


# -- pages ----------------------------------------------------------------------------------------------------------


@dataclass
class PageWindow(InputPartition):
    """Pages first to last (both included) of a file."""

    path: str
    first: int
    last: int


class PageSource(DataSource):
    """A partition for each window of pages of a file; a subclass says how a window is read.

    Option windows: the windows as path, first and last, a line each, separated
    by tabs. Only these numbers pass the driver, never a page; a file is opened
    once for each of its windows, by the task that reads it.
    """

    @classmethod
    def name(cls) -> str:
        return "page_windows"

    def schema(self) -> str:
        return "path string, page_idx long, content binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _PageReader(self.options["windows"], self.read_window)

    @staticmethod
    def read_window(path: str, first: int, last: int) -> Iterator[bytes]:
        """The pages' contents, in their order."""
        raise NotImplementedError


class _PageReader(DataSourceReader):
    def __init__(self, windows: str, read_window):
        self.windows, self.read_window = windows, read_window

    def partitions(self) -> list[InputPartition]:
        rows = (line.rsplit("\t", 2) for line in self.windows.split("\n") if line)
        return [PageWindow(p, int(a), int(b)) for p, a, b in rows]

    def read(self, partition: PageWindow) -> Iterator[pa.RecordBatch]:
        for page, content in enumerate(self.read_window(partition.path, partition.first, partition.last), partition.first):
            yield pa.RecordBatch.from_arrays([pa.array([partition.path]), pa.array([page], pa.int64()), pa.array([content], pa.binary())], ["path", "page_idx", "content"])


def read_pages(spark: SparkSession, source: type[PageSource], counted: DataFrame, start: Column, end: Column, window: int) -> DataFrame:
    """path, page_idx and content of the pages of counted (path, n_pages) within a range, by a source, window by window.

    A file without a page in the range, or with a null or negative number of
    pages, gives no rows. No files: no rows.
    """
    spark.dataSource.register(source)
    pages = layout.page_windows(counted.select("path", "n_pages").distinct(), "n_pages", start, end, window)
    found = pages.groupBy("path", "window_id").agg(F.min("page_idx").alias("first"), F.max("page_idx").alias("last")).orderBy("path", "first")
    lines = [f"{r.path}\t{r.first}\t{r['last']}" for r in found.toLocalIterator()]
    if not lines:
        return spark.createDataFrame([], "path string, page_idx long, content binary")
    return spark.read.format(source.name()).option("windows", "\n".join(lines)).load()


# -- documents ------------------------------------------------------------------------------------------------------

#: Folder of attempts below the one that is written to; nothing in it counts.
STAGED = "_staged"


@dataclass
class Attempt(WriterCommitMessage):
    folder: str
    files: int


class DocumentFiles(DataSource):
    """Writes rows (rel_path, content) as files below the option path, all of them or none.

    A task writes into a folder of its attempt. When all tasks are done, the
    files of the attempts that count are renamed into place; those of failed or
    repeated attempts are never seen, and go with the folder of attempts.
    """

    @classmethod
    def name(cls) -> str:
        return "document_files"

    def schema(self) -> str:
        return "rel_path string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _DocumentWriter(self.options["path"], overwrite)


class _DocumentWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.removeprefix("file://"), overwrite
        self.staged = os.path.join(self.path, STAGED, uuid.uuid4().hex)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        folder, files = os.path.join(self.staged, uuid.uuid4().hex), 0
        for batch in iterator:
            names = batch.column(batch.schema.get_field_index("rel_path")).to_pylist()
            contents = batch.column(batch.schema.get_field_index("content"))
            for i, name in enumerate(names):
                if contents[i].is_valid:
                    to = os.path.join(folder, inside(name))
                    os.makedirs(os.path.dirname(to), exist_ok=True)
                    with open(to, "wb") as f:
                        f.write(contents[i].as_buffer())
                    files += 1
        return Attempt(folder, files)

    def commit(self, messages: list[Attempt | None]) -> None:
        if self.overwrite:
            for name in os.listdir(self.path) if os.path.isdir(self.path) else ():
                if name != STAGED:
                    full = os.path.join(self.path, name)
                    shutil.rmtree(full) if os.path.isdir(full) else os.remove(full)
        for message in messages:
            if message is not None and message.files:
                for at, _, names in os.walk(message.folder):
                    to = os.path.normpath(os.path.join(self.path, os.path.relpath(at, message.folder)))
                    os.makedirs(to, exist_ok=True)
                    for name in names:
                        os.replace(os.path.join(at, name), os.path.join(to, name))
        shutil.rmtree(self.staged, ignore_errors=True)

    def abort(self, messages: list[Attempt | None]) -> None:
        shutil.rmtree(self.staged, ignore_errors=True)


def inside(name: str) -> str:
    """A relative path that stays below its folder."""
    clean = os.path.normpath(name)
    if not name or os.path.isabs(clean) or clean.split(os.sep)[0] in ("..", STAGED):
        raise ValueError(f"not a path below the folder: {name!r}")
    return clean


def write_files(files: DataFrame, path: str, overwrite: bool = False) -> None:
    """files (rel_path, content as text or binary) below a shared folder, committed together. Null contents are left out."""
    files.sparkSession.dataSource.register(DocumentFiles)
    raw = F.col("content").cast("binary")
    files.select("rel_path", raw.alias("content")).write.format(DocumentFiles.name()).mode("overwrite" if overwrite else "append").option("path", path).save()


def image_copies(images: DataFrame) -> DataFrame:
    """rel_path and content of the images (stem, subdir, name, content) of documents: <stem>/<subdir>/images/<name>."""
    return images.select(F.concat_ws("/", "stem", "subdir", F.lit("images"), text.base_name(F.col("name"))).alias("rel_path"), "content")


def numbered_names(files: DataFrame, key: list[str], name: str = "name", order: str = "ord") -> DataFrame:
    """files with stored_name: the first of equal names of a document keeps it, the nth is n_name.

    A name that has such a beginning by itself comes first and keeps it; the
    others then take the next number that nobody has. As every name is tried
    with all numbers at once, what is taken is looked up, not walked through.
    """
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy(*key, name).orderBy(order))
    rows = files.withColumn("__n", nth)
    firsts = rows.where("__n = 1").select(*key, F.col(name).alias("__taken"))
    # the k-th copy takes the k-th free number: numbers that an own name holds are left out
    held = firsts.select(*key, F.regexp_extract("__taken", r"^([2-9]|[1-9]\d+)_", 1).try_cast("int").alias("number"), F.regexp_replace("__taken", r"^\d+_", "").alias(name)).where("number is not null")
    held = held.groupBy(*key, name).agg(F.array_sort(F.collect_set("number")).alias("__held"))
    rows = rows.join(held, [*key, name], "left")
    free = F.aggregate(F.coalesce("__held", F.array().cast("array<int>")), F.col("__n"), lambda at, h: F.when(h <= at, at + 1).otherwise(at))
    stored = F.when(F.col("__n") == 1, F.col(name)).otherwise(F.concat(free.cast("string"), F.lit("_"), F.col(name)))
    return rows.withColumn("stored_name", stored).drop("__n", "__held")
