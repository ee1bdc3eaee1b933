"""Results as tables, files, JSON and ZIP archives."""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..session import saved

#: Artifacts of a document and the file that each is written to, behind the document's stem.
ARTIFACTS = {"markdown": ".md", "middle_json": "_middle.json", "model_output": "_model.json", "content_list": "_content_list.json", "content_list_v2": "_content_list_v2.json"}
#: Those that a JSON result may carry; the nested content list is in archives only.
JSON_KEYS = {"markdown": "md_content", "middle_json": "middle_json", "model_output": "model_output", "content_list": "content_list"}
ZIP_LIMIT, NAME_LIMIT = 0xFFFFFFFF, 0xFFFF


def artifacts(results: DataFrame) -> DataFrame:
    """task_id, stem, subdir, rel_path, content: a row for each file of each result; absent artifacts have null contents."""
    files = F.array(*[F.struct(F.lit(k).alias("kind"), F.concat("stem", F.lit(suffix)).alias("name"), (F.col(k) if k in results.columns else F.lit(None).cast("string")).alias("content")) for k, suffix in ARTIFACTS.items()])
    rows = results.select("task_id", "stem", "subdir", F.explode(files).alias("f"))
    return rows.select("task_id", "stem", "subdir", "f.kind", F.concat_ws("/", "stem", "subdir", "f.name").alias("rel_path"), "f.content")


def pretty(files: DataFrame) -> DataFrame:
    """files (with rel_path and content) with JSON contents in lines, two blanks a level; what is no JSON stays as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("content")
            shown = [_in_lines(c) if c is not None and n.endswith(".json") else c for n, c in zip(b.column("rel_path").to_pylist(), b.column(at).to_pylist(), strict=True)]
            yield b.set_column(at, "content", pa.array(shown, b.schema.field(at).type))

    return files.mapInArrow(run, files.schema)


def _in_lines(content: str) -> str:
    try:
        return json.dumps(json.loads(content), indent=2, ensure_ascii=False)
    except ValueError:
        return content


def write_table(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").partitionBy("subdir").parquet(path)


def result_json(results: DataFrame, backend: str, version: str, flags: dict[str, bool], images: DataFrame | None = None) -> DataFrame:
    """task_id, body: one JSON for each task with the wanted artifacts of its documents, JSON artifacts as strings."""
    wanted = [F.coalesce(F.col(k) if k in results.columns else F.lit(None).cast("string"), F.lit(None)).alias(name) for k, name in JSON_KEYS.items() if flags.get(k)]
    if images is not None and flags.get("images"):
        uri = text.data_uri(text.mime_type(F.col("name")), F.col("content"))
        held = images.groupBy("task_id", "stem").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", uri.alias("uri"))))).alias("images"))
        results = results.join(held, ["task_id", "stem"], "left")
        wanted.append(F.coalesce("images", F.create_map().cast("map<string,string>")).alias("images"))
    one = F.struct("stem", (F.struct(*wanted) if wanted else F.struct(F.lit(None).cast("string").alias("md_content"))).alias("v"))
    by_stem = F.map_from_entries(F.array_sort(F.collect_list(one), lambda a, b: F.when(a["stem"] < b["stem"], -1).otherwise(1)))
    body = F.to_json(F.struct(F.lit(backend).alias("backend"), F.lit(version).alias("version"), by_stem.alias("results")), {"ignoreNullFields": "false"})
    return results.groupBy("task_id").agg(body.alias("body"))


def zip_manifest(files: DataFrame) -> DataFrame:
    """files (task_id, rel_path, content) with size, crc32, offset of the local header in the task's archive and error; stored, with data descriptors."""
    raw = F.encode("content", "utf-8") if dict(files.dtypes)["content"] == "string" else F.col("content")
    out = files.where("content is not null").withColumn("size", F.octet_length("content").cast("long")).withColumn("crc32", F.crc32(raw))
    entry = F.lit(30 + 16) + F.octet_length("rel_path") + F.col("size")
    before = F.sum(entry).over(Window.partitionBy("task_id").orderBy("rel_path", "crc32", "size").rowsBetween(Window.unboundedPreceding, -1))
    out = out.withColumn("offset", F.coalesce(before, F.lit(0)).cast("long"))
    return out.withColumn("error", F.when((F.col("offset") > ZIP_LIMIT) | (F.col("size") > ZIP_LIMIT), F.lit("archive too large")).when(F.octet_length("rel_path") > NAME_LIMIT, F.lit("name too long")))


def _local(name: bytes) -> bytes:
    """Header before an entry; crc and sizes follow the entry."""
    return struct.pack("<4s5H3I2H", b"PK\3\4", 20, 0x808, 0, 0, 0x21, 0, 0, 0, len(name), 0) + name


def _central(name: bytes, crc: int, size: int, offset: int) -> bytes:
    return struct.pack("<4s6H3I5H2I", b"PK\1\2", 20, 20, 0x808, 0, 0, 0x21, crc, size, size, len(name), 0, 0, 0, 0, 0, offset) + name


def write_zips(files: DataFrame, folder: str) -> DataFrame:
    """An archive <task_id>.zip for each task below a folder that all executors share; task_id, path (null if there is an error), n_files, error.

    Where an entry stands follows from the sizes of those before it, so many
    tasks write one archive, each entry at its place, however large the archive
    is; what passes a window are names and sizes. A small task then writes the
    directory, and renames the file when it is whole. Repeated attempts write
    the same bytes at the same places. Entries of one name are all kept. Null
    contents are left out. What the format cannot hold is an error.
    """
    run = uuid.uuid4().hex
    part = lambda task: os.path.join(folder, f"{task}.{run}.part")
    nth = F.row_number().over(Window.partitionBy("task_id", "rel_path").orderBy("crc32", "size"))
    listed = saved(zip_manifest(files).select("task_id", "rel_path", "size", "crc32", "offset", "error", nth.alias("nth")))
    bound = F.max(F.col("offset") + 46 + F.octet_length("rel_path") + F.col("size")) + F.sum(F.octet_length("rel_path") + 46)
    error = F.coalesce(F.min("error"), F.when(F.count("*") > NAME_LIMIT, "too many entries").when(bound > ZIP_LIMIT, "archive too large"))
    whole = saved(files.select("task_id").distinct().join(listed.groupBy("task_id").agg(error.alias("failed")), "task_id", "left"))
    good = listed.join(whole.where("failed is null"), "task_id", "left_semi")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        now, out, n = None, None, 0
        for b in batches:
            for i, (task, name, crc, size, offset) in enumerate(zip(*(b.column(c).to_pylist() for c in range(5)), strict=True)):
                if task != now:
                    if out is not None:
                        os.close(out)
                    now, out = task, os.open(part(task), os.O_RDWR | os.O_CREAT, 0o644)
                head = _local(name.encode())
                _put(out, head, offset)
                _put(out, b.column(5)[i].as_buffer(), offset + len(head))
                _put(out, struct.pack("<4s3I", b"PK\7\x08", crc, size, size), offset + len(head) + size)
                n += 1
        if out is not None:
            os.close(out)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        done: list[tuple] = []
        now, rows = None, []

        def close() -> None:
            path = os.path.join(folder, f"{now}.zip")
            entries = [r for r in rows if r[0] is not None]
            if rows[0][4] is not None:
                done.append((str(now), None, 0, rows[0][4]))
                return
            if os.path.exists(part(now)) or not entries:
                end = max((o + 46 + len(n.encode()) + s for n, _, s, o, _ in entries), default=0)
                directory = b"".join(_central(n.encode(), c, s, o) for n, c, s, o, _ in entries)
                out = os.open(part(now), os.O_RDWR | os.O_CREAT, 0o644)
                _put(out, directory + struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, len(entries), len(entries), len(directory), end, 0), end)
                os.close(out)
                os.replace(part(now), path)
            elif not os.path.exists(path):
                raise FileNotFoundError(part(now))
            done.append((str(now), path, len(entries), None))

        for b in batches:
            for task, *row in zip(*(b.column(c).to_pylist() for c in range(6)), strict=True):
                if rows and task != now:
                    close()
                    rows = []
                now = task
                rows.append(row)
        if rows:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[c] for d in done], k) for c, k in enumerate((pa.string(), pa.string(), pa.int64(), pa.string()))], ["task_id", "path", "n_files", "error"])

    raw = F.encode("content", "utf-8") if dict(files.dtypes)["content"] == "string" else F.col("content")
    contents = files.where("content is not null").select("task_id", "rel_path", raw.alias("content")).withColumn("size", F.octet_length("content").cast("long")).withColumn("crc32", F.crc32("content")).withColumn("nth", nth)
    entries = contents.drop("size", "crc32").join(good, ["task_id", "rel_path", "nth"])
    saved(entries.select("task_id", "rel_path", "crc32", "size", "offset", "content").mapInArrow(write, "n long"))
    rows = whole.join(listed.drop("error", "nth"), "task_id", "left").select("task_id", "rel_path", "crc32", "size", "offset", "failed")
    return saved(rows.repartition("task_id").sortWithinPartitions("task_id", "offset").mapInArrow(finish, "task_id string, path string, n_files long, error string"))


def _put(file: int, raw, at: int) -> None:
    view = memoryview(raw).cast("B")
    while len(view):
        n = os.pwrite(file, view, at)
        view, at = view[n:], at + n


def write_documents(files: DataFrame, folder: str) -> DataFrame:
    """One file for each artifact below a shared folder, all of them or none; returns rel_path and size."""
    from . import datasources

    datasources.write_files(files, folder)
    return files.where("content is not null").select("rel_path", F.octet_length("content").cast("long").alias("size"))


def original_file(kind: Column, suffix: Column, stem: Column) -> Column:
    """The name under which an archive holds the file that came in; an image is held as a one-page PDF."""
    return F.when(kind.isin("pdf", "image"), F.concat(stem, F.lit("_origin.pdf"))).when(kind == "office", F.concat(stem, F.lit("_origin."), suffix))
