"""Parse tasks as rows: options, names, status, queue, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

# Accepted file suffixes and what they are.
KINDS = {"pdf": ("pdf",), "image": ("png", "jpeg", "jp2", "webp", "gif", "bmp", "jpg", "tiff"), "office": ("docx", "pptx", "xlsx")}
STATUSES = ("pending", "processing", "completed", "failed")
TERMINAL = ("completed", "failed")
STEM_BYTES, ROOT_BYTES = 200, 190
RETENTION_SECONDS = 24 * 3600


def document_kind(suffix: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, suffixes in KINDS.items():
        out = F.when(suffix.isin(*suffixes), F.lit(kind)).otherwise(out)
    return out


def gate(uploads: DataFrame, name: str = "name") -> DataFrame:
    """uploads with base_name, stem (at most 200 bytes), suffix, kind, output_dir and accepted; rejected rows stay, marked."""
    base = text.base_name(F.col(name))
    out = uploads.withColumn("base_name", base).withColumn("suffix", text.file_suffix(F.col("base_name")))
    out = out.withColumn("stem", text.utf8_truncate(text.file_stem(F.col("base_name")), STEM_BYTES)).withColumn("kind", document_kind(F.col("suffix")))
    return out.withColumn("output_dir", F.when(F.col("kind") == "office", F.lit("office")).when(F.col("kind").isNotNull(), F.lit("vlm"))).withColumn("accepted", F.col("kind").isNotNull())


def uniquify(uploads: DataFrame, task: list[str], order: str = "idx", stem: str = "stem") -> DataFrame:
    """unique_stem by window: the nth stem of a task (letter case aside) gets _n.

    Right where no stem of the task looks like a stem with such a suffix; else see uniquify_exactly.
    """
    n = F.row_number().over(Window.partitionBy(*task, F.lower(stem)).orderBy(order))
    return uploads.withColumn("unique_stem", F.when(n == 1, F.col(stem)).otherwise(F.concat(stem, F.lit("_"), n.cast("string"))))


def uniquify_exactly(uploads: DataFrame, task: str, order: str = "idx", stem: str = "stem") -> DataFrame:
    """unique_stem of any stems, letter case aside: the first of equal ones keeps its name, the others get the
    smallest numbers from 2 on, in their order, that make no name which the task has.

    Stems that agree up to ROOT_BYTES share their numbers, so that cutting long ones to STEM_BYTES makes none equal.
    A task's stems of one root are a sort within a partition; nothing is gathered but the numbers that its names end in.
    """
    root = lambda c: F.lower(text.utf8_truncate(c, ROOT_BYTES))
    nth = F.row_number().over(Window.partitionBy(task, F.lower(stem)).orderBy(order))
    rows = uploads.withColumn("__again", nth > 1).withColumn("__root", root(F.col(stem)))
    ending = F.regexp_extract(stem, r"^(.*)_([1-9]\d{0,8})$", 2).try_cast("int")
    held = uploads.select(task, root(F.regexp_extract(stem, r"^(.*)_([1-9]\d{0,8})$", 1)).alias("__root"), ending.alias("__number")).where("__number >= 2")
    held = held.groupBy(task, "__root").agg(F.array_sort(F.collect_set("__number")).alias("__held"))
    rank = F.count_if(F.col("__again")).over(Window.partitionBy(task, "__root").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("__rank", rank.cast("int")).join(held, [task, "__root"], "left")
    number = F.aggregate(F.coalesce("__held", F.array().cast("array<int>")), F.col("__rank") + 1, lambda n, h: F.when(h <= n, n + 1).otherwise(n))
    tail = F.concat(F.lit("_"), number.cast("string"))
    long = F.lit(None).cast("string")
    for digits in range(1, 10):
        long = F.when(F.length(tail) == digits + 1, text.utf8_truncate(F.col(stem), STEM_BYTES - digits - 1)).otherwise(long)
    return rows.withColumn("unique_stem", F.when(F.col("__again"), F.concat(long, tail)).otherwise(F.col(stem))).select(*uploads.columns, "unique_stem")


def status_counts(tasks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Number of tasks in each status; partial aggregation, one row for each group."""
    return tasks.groupBy(*(by or [])).agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def _in_bins(rows: DataFrame, by: str, bins: int) -> DataFrame:
    """rows with __bin: the part of the range of `by` (a number) that each is in; the cuts are quantiles of a fixed number."""
    cuts = sorted(set(rows.where(F.col(by).isNotNull()).approxQuantile(by, [i / bins for i in range(1, bins)], 0.25 / bins)))
    if not cuts:
        return rows.withColumn("__bin", F.lit(0))
    return rows.withColumn("__bin", _bin(cuts, F.col(by), 0))


def _bin(cuts: list[float], value: Column, base: int) -> Column:
    """base and the number of cuts up to a value, as a balanced tree of comparisons, which stays in generated code."""
    if not cuts:
        return F.lit(base)
    mid = len(cuts) // 2
    return F.when(value >= cuts[mid], _bin(cuts[mid + 1 :], value, base + mid + 1)).otherwise(_bin(cuts[:mid], value, base))


def _before(rows: DataFrame, counts: Column, order: list[Column], columns: list[str], name: str, same: bool) -> DataFrame:
    """rows (with __bin) with the sum of counts over all rows that come earlier: within the bin by window, and of the bins before it.

    same: rows of equal order count as earlier if they stand before, else they do not.
    """
    whole = rows.groupBy("__bin").agg(F.coalesce(F.sum(counts), F.lit(0)).alias("__n"))
    # one row for each of a fixed number of bins
    before = whole.select("__bin", F.coalesce(F.sum("__n").over(Window.orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    w = Window.partitionBy("__bin").orderBy(*order)
    own = F.coalesce(F.sum(counts).over(w.rowsBetween(Window.unboundedPreceding, -1) if same else w.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("__own", own).join(F.broadcast(before), "__bin").withColumn(name, (F.col("__own") + F.col("__before")).cast("long")).select(*columns, name)


def queued_ahead(tasks: DataFrame, bins: int = 64) -> DataFrame:
    """tasks with queued_ahead: pending tasks submitted before each pending task; 0 for others. Orders of 0 or less are not counted."""
    counts = ((F.col("status") == "pending") & (F.col("submit_order") > 0)).cast("long")
    out = _before(_in_bins(tasks, "submit_order", bins), counts, [F.col("submit_order")], tasks.columns, "queued_ahead", same=False)
    return out.withColumn("queued_ahead", F.when(F.col("status") == "pending", F.col("queued_ahead")).otherwise(F.lit(0).cast("long")))


def numbered(rows: DataFrame, counts: Column, order: list[str], name: str, bins: int = 64) -> DataFrame:
    """rows with their number from 1 on in the order of a time or number and further columns; null where `counts` does not hold."""
    held = _in_bins(rows.withColumn("__at", F.col(order[0]).cast("timestamp").cast("double") if dict(rows.dtypes)[order[0]] != "double" else F.col(order[0])).withColumn("__yes", counts), "__at", bins)
    out = _before(held, F.col("__yes").cast("long"), [F.col(c) for c in order], [*rows.columns, "__yes"], name, same=True)
    return out.withColumn(name, F.when(F.col("__yes"), F.col(name) + 1)).drop("__yes")


def landing_names(uploads: DataFrame, task: str, order: str = "idx", name: str = "base_name") -> DataFrame:
    """uploads with landing_name, under which each is stored: the first of equal names keeps it, the nth gets __upload_n behind its stem.

    A name that has such an ending by itself may meet one that was given; it is then kept apart by its place.
    """
    nth = F.row_number().over(Window.partitionBy(task, name).orderBy(order))
    suffix = F.regexp_extract(name, r"(?<=.)\.[^.]*$", 0)
    given = F.when(nth == 1, F.col(name)).otherwise(F.concat(text.file_stem(F.col(name)), F.lit("__upload_"), nth.cast("string"), suffix))
    rows = uploads.withColumn("__given", given)
    again = F.row_number().over(Window.partitionBy(task, "__given").orderBy(F.col("__given") != F.col(name), order))
    place = F.concat(text.file_stem(F.col("__given")), F.lit("__"), F.col(order).cast("string"), suffix)
    return rows.withColumn("landing_name", F.when(again == 1, F.col("__given")).otherwise(place)).drop("__given")


def expired(tasks: DataFrame, now: Column, retention_seconds: int = RETENTION_SECONDS) -> DataFrame:
    """Finished tasks that nobody reads and that are older than the retention; none if it is 0."""
    if retention_seconds == 0:
        return tasks.where("false")
    age = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("completed_at").cast("timestamp"))
    return tasks.where(F.col("status").isin(*TERMINAL) & (F.col("active_readers") == 0) & F.col("completed_at").isNotNull() & (age >= retention_seconds))


def sweep(tasks: DataFrame, now: Column, retention_seconds: int = RETENTION_SECONDS) -> DataFrame:
    """The tasks that stay."""
    return tasks.join(expired(tasks, now, retention_seconds).select("task_id"), "task_id", "left_anti")


def status_payload(tasks: DataFrame, base_url: str) -> DataFrame:
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    url = F.concat(F.lit(f"{base_url}/tasks/"), F.col("task_id").cast("string"))
    out = tasks.withColumn("status_url", url).withColumn("result_url", F.concat(url, F.lit("/result")))
    for c in ("created_at", "started_at", "completed_at"):
        if c in tasks.columns:
            out = out.withColumn(c, stamp(F.col(c)))
    return out


def parse_boolean(c: Column) -> Column:
    """true/1/yes/on and false/0/no/off in any letter case; anything else is null."""
    v = F.lower(text.trim(c))
    return F.when(v.isin("true", "1", "yes", "on"), F.lit(True)).when(v.isin("false", "0", "no", "off"), F.lit(False))


# The fields of a request that are options, and what they are without being given.
FLAGS = {
    "formula_enable": True, "table_enable": True, "image_analysis": True, "return_md": True, "return_middle_json": False, "return_model_output": False,
    "return_content_list": False, "return_images": False, "response_format_zip": False, "return_original_file": False,
}
NUMBERS = {"start_page_id": 0, "end_page_id": 99_999}
TEXTS = {"backend": "vlm-http-client", "parse_method": "auto", "server_url": None}


def parse_integer(c: Column) -> Column:
    """Digits with a plus sign at most, up to 2**64 - 1, as a decimal; anything else, also with white space, is null."""
    number = F.when(c.rlike(r"^\+?[0-9]+$"), F.ltrim(F.regexp_replace(c, r"^\+", ""))).try_cast("decimal(38,0)")
    return F.when(number < F.lit(str(2**64)).cast("decimal(38,0)"), number).cast("decimal(20,0)")


def form_options(fields: DataFrame) -> DataFrame:
    """The options of each task from the fields of its request (task_id, ord, name, value): the last value of a name counts, others have
    their default; languages are a list. field_error: that of the first field that cannot be read, as it would have ended the reading."""
    known = F.col("name").isin(*FLAGS)
    number = F.col("name").isin(*NUMBERS)
    bad = F.when(known & parse_boolean(F.col("value")).isNull(), F.concat(F.lit("Invalid boolean value: "), F.lower(text.trim(F.col("value"))))).when(number & parse_integer(F.col("value")).isNull(), F.concat(F.lit("Invalid integer value for "), "name", F.lit(": "), "value"))
    last = lambda n: F.max_by("value", F.when(F.col("name") == n, F.col("ord")))
    given = lambda n: F.when(F.max(F.when(F.col("name") == n, F.col("ord"))).isNotNull(), last(n))
    flags = [F.coalesce(parse_boolean(given(n)), F.lit(d)).alias(n) for n, d in FLAGS.items() if n != "return_original_file"]
    original = F.coalesce(parse_boolean(given("return_original_file")), F.lit(False)) & F.coalesce(parse_boolean(given("response_format_zip")), F.lit(False))
    numbers = [F.coalesce(parse_integer(given(n)), F.lit(d).cast("decimal(20,0)")).alias(n) for n, d in NUMBERS.items()]
    texts = [F.coalesce(given(n), F.lit(d)).alias(n) for n, d in TEXTS.items()]
    langs = F.array_sort(F.collect_list(F.when(F.col("name") == "lang_list", F.struct("ord", "value"))))
    error = F.min(F.when(F.col("__bad").isNotNull(), F.struct(F.col("ord").alias("ord"), F.col("__bad").alias("e"))))
    return fields.withColumn("__bad", bad).groupBy("task_id").agg(*texts, *flags, original.alias("return_original_file"), *numbers, F.concat(F.array(F.lit("ch")), F.transform(langs, lambda x: x["value"])).alias("lang_list"), error["e"].alias("field_error"))


def option_errors(options: DataFrame) -> DataFrame:
    """options with backend (alias resolved) and error (null if valid); columns parse_method, backend, start_page_id, end_page_id, n_files."""
    backend = F.when(F.col("backend") == "vllm-http-client", F.lit("vlm-http-client")).otherwise(F.col("backend"))
    # fixed values: the messages
    error = (
        F.when(F.col("n_files") < 1, F.lit("At least one file is required"))
        .when(~F.col("parse_method").isin("auto", "txt", "ocr"), F.lit("Invalid parse_method. Allowed values: auto, ocr, txt"))
        .when(backend != "vlm-http-client", F.concat(F.lit("Unsupported backend: "), F.col("backend")))
        .when(F.col("end_page_id") < F.col("start_page_id"), F.lit("end_page_id must be greater than or equal to start_page_id"))
    )
    return options.withColumn("error", error).withColumn("backend", backend)


def readable(tasks: DataFrame, leases: DataFrame) -> DataFrame:
    """Tasks with a reader's lease."""
    return tasks.join(leases.select("task_id"), "task_id", "left_semi")


def health(tasks: DataFrame, settings: dict[str, str | int]) -> DataFrame:
    """One row: counts by status and the settings."""
    return status_counts(tasks).select("*", *[F.lit(v).alias(k) for k, v in settings.items()])

