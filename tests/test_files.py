"""Data sources and sinks: windows of pages, committed files, archives written by many tasks."""

import os
import random
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from quillspark.sources import datasources, sinks


class Lines(datasources.PageSource):
    """A file's lines are its pages; each opening is noted beside the file."""

    @classmethod
    def name(cls):
        return "line_pages"

    @staticmethod
    def read_window(path, first, last):
        import uuid

        with open(path, "rb") as f:
            open(f"{path}.opened.{uuid.uuid4().hex}", "w").close()
            for i, line in enumerate(f):
                if first <= i <= last:
                    yield line.rstrip(b"\n")


def test_windows_of_pages(spark, tmp_path):
    counts = {"a": 20, "b": 3, "c": 0}
    for name, n in counts.items():
        (tmp_path / name).write_text("".join(f"{name}{i}\n" for i in range(n)))
    counted = spark.createDataFrame([(str(tmp_path / k), n) for k, n in counts.items()], "path string, n_pages long")
    pages = datasources.read_pages(spark, Lines, counted, F.lit(2), F.lit(17), 8)
    assert pages.rdd.getNumPartitions() == 3
    got = sorted((os.path.basename(r.path), r.page_idx, bytes(r.content).decode()) for r in pages.collect())
    assert got == [("a", i, f"a{i}") for i in range(2, 18)] + [("b", 2, "b2")]
    opened = [p for p in os.listdir(tmp_path) if ".opened." in p]
    assert sorted(p[0] for p in opened) == ["a", "a", "b"]  # once for each window
    assert datasources.read_pages(spark, Lines, counted.where("false"), F.lit(0), F.lit(9), 8).collect() == []


def tree(folder):
    return {os.path.relpath(os.path.join(at, n), folder): open(os.path.join(at, n), "rb").read() for at, _, names in os.walk(folder) for n in names}


def test_committed_files(spark, tmp_path):
    rows = [(f"d{i}/vlm/d{i}.md", f"# é {i}") for i in range(30)] + [("none", None), ("empty", "")]
    df = spark.createDataFrame(rows, "rel_path string, content string").repartition(5)
    datasources.write_files(df, str(tmp_path / "out"))
    want = {n: c.encode() for n, c in rows if c is not None}
    assert tree(tmp_path / "out") == want
    images = spark.createDataFrame([("d1", "vlm", "x/i.png", b"\x01\x02")], "stem string, subdir string, name string, content binary")
    datasources.write_files(datasources.image_copies(images), str(tmp_path / "out"))
    assert tree(tmp_path / "out") == want | {"d1/vlm/images/i.png": b"\x01\x02"}
    datasources.write_files(df.limit(0), str(tmp_path / "out"))
    datasources.write_files(df.where("rel_path = 'empty'"), str(tmp_path / "out"), overwrite=True)
    assert tree(tmp_path / "out") == {"empty": b""}


def test_failed_tasks_leave_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = spark.range(40).select(F.concat(F.lit("f"), "id").alias("rel_path"), F.lit("x").alias("content")).repartition(4)
    for bad in ("../escape", "/etc/x", ""):
        with pytest.raises(Exception, match="not a path below"):
            datasources.write_files(rows.unionAll(spark.createDataFrame([(bad, "y")], rows.schema)), out)
    # a task that is still running when the others are given up may leave something among the attempts
    assert [n for n in tree(tmp_path) if not n.startswith(f"out/{datasources.STAGED}/")] == []
    datasources.write_files(rows, out)
    assert {n for n in tree(out) if not n.startswith(datasources.STAGED)} == {f"f{i}" for i in range(40)}


def test_attempts_count_once(tmp_path):
    """The protocol itself: of a task that ran twice only the attempt that Spark tells of is seen."""
    import pyarrow as pa

    writer = datasources._DocumentWriter(str(tmp_path / "o"), False)
    batch = lambda text: iter([pa.record_batch([pa.array(["a/b"]), pa.array([text], pa.binary())], ["rel_path", "content"])])
    writer.write(batch(b"lost"))
    kept = writer.write(batch(b"kept"))
    assert [n for n in tree(tmp_path / "o") if not n.startswith(datasources.STAGED)] == []
    writer.commit([kept, None])
    assert tree(tmp_path / "o") == {"a/b": b"kept"}
    other = datasources._DocumentWriter(str(tmp_path / "o"), False)
    other.write(batch(b"gone"))
    other.abort([None])
    assert tree(tmp_path / "o") == {"a/b": b"kept"}


def test_archives_of_many_tasks(spark, tmp_path):
    rng = random.Random(3)
    rows = [(t, f"é{t}/n{i % 70}.bin", bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 300, 5000])))) for t in range(3) for i in range(75)] + [(1, "none", None), (9, "only", None), (7, "n" * 70_000, b"x")]
    df = spark.createDataFrame(rows, "task_id long, rel_path string, content binary").repartition(6)
    made = {r.task_id: r for r in sinks.write_zips(df, str(tmp_path / "z")).collect()}
    assert set(made) == {"0", "1", "2", "9", "7"} and (made["7"].path, made["7"].error) == (None, "name too long") and made["9"].n_files == 0
    manifest = {(r.task_id, r.rel_path, r.crc32): (r.size, r.offset) for r in sinks.zip_manifest(df.where("task_id < 3")).collect()}
    for t in range(3):
        with zipfile.ZipFile(made[str(t)].path) as z:
            assert z.testzip() is None
            got = sorted((i.filename, z.read(i)) for i in z.infolist())
            assert got == sorted((n, c) for k, n, c in rows if k == t and c is not None) and made[str(t)].n_files == 75
            assert all(manifest[t, i.filename, i.CRC][0] == i.file_size and i.CRC == zlib.crc32(z.read(i)) for i in z.infolist())
            assert {i.header_offset for i in z.infolist()} == {o for (k, *_), (_, o) in manifest.items() if k == t} or len(manifest) < 225
    assert sorted(os.listdir(tmp_path / "z")) == ["0.zip", "1.zip", "2.zip", "9.zip"]
    assert zipfile.ZipFile(made["9"].path).namelist() == []


def test_numbered_names(spark):
    rows = [("d", i, n) for i, n in enumerate(["a.png", "b.png", "a.png", "a.png", "2_a.png", "4_a.png", "a.png", "2_a.png"])] + [("e", 0, "a.png")]
    got = datasources.numbered_names(spark.createDataFrame(rows, "doc string, ord int, name string"), ["doc"]).orderBy("doc", "ord").collect()
    assert [r.stored_name for r in got] == ["a.png", "b.png", "3_a.png", "5_a.png", "2_a.png", "4_a.png", "6_a.png", "2_2_a.png", "a.png"]
    assert len({(r.doc, r.stored_name) for r in got}) == len(rows)
