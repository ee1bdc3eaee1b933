"""Session settings that the engine's results depend on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: UTC timestamps, unbroken Base64 (hashes of data URIs depend on it), right side wins in merged maps, adaptive plans.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.chunkBase64String.enabled": "false",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build(name: str = "quillspark", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where that is unset and everything runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.quillspark.shared", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.quillspark.shared", folder)
    return folder


#: Spark's setting that shuffle files go when the write that made them has ended, and not when the driver collects its garbage.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders of the tables that the innermost apart() or once() has written so far.
_within: ContextVar[list[str] | None] = ContextVar("_within", default=None)


def _written(df: DataFrame) -> str:
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/quillspark/{uuid.uuid4().hex}"
    before = spark.conf.get(_FREE, None)
    spark.conf.set(_FREE, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_FREE) if before is None else spark.conf.set(_FREE, before)
    return path


def saved(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: the plan ends there, and a lost executor takes nothing with it."""
    path = _written(df)
    if (within := _within.get()) is not None:
        within.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def apart(spark: SparkSession, make: Callable[[], list[DataFrame]], keep: Callable[[DataFrame], DataFrame] = saved) -> list[DataFrame]:
    """The tables that make() gives, saved; those that it saved on the way are deleted, so nothing else may read them."""
    own: list[str] = []
    token = _within.set(own)
    try:
        made = make()
        _within.reset(token)
        return [keep(df) for df in made]
    finally:
        if _within.get() is own:
            _within.reset(token)
        for path in own:
            files, there = _file_system(spark, path)
            files.delete(there, True)


_kept: dict[tuple[str, ...], tuple[str, StructType]] = {}


def once(spark: SparkSession, name: str, source: str, make: Callable[[], DataFrame]) -> DataFrame:
    """make() as a table in the shared folder, written once by a session for what it reads from `source`, which must not change meanwhile.

    A table that was deleted in the shared folder is made again. What make()
    saves on the way is deleted.
    """
    key = (spark.sparkContext.applicationId, name, source)
    if key in _kept:
        files, there = _file_system(spark, _kept[key][0] + "/_SUCCESS")
        if not files.exists(there):
            del _kept[key]

    def keep(df: DataFrame) -> DataFrame:
        _kept[key] = (_written(df), df.schema)
        return df

    if key not in _kept:
        apart(spark, lambda: [make()], keep)
    path, schema = _kept[key]
    return spark.read.schema(schema).parquet(path)
