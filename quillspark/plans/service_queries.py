"""Queries of the whole way of a document, from an upload to its Markdown, and of the service's answers, with their DuckDB forms."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import layout, model_stage, render, service, structure, tasks
from ..session import saved
from ..sources import config
from . import inputs
from .inputs import derived, table

BLOCK = ["doc", "page_idx", "block_index"]
URL = "http://localhost"


def recognise(pages: DataFrame, transport: Callable[[str], str], model: str = "page-model", crop: Callable[[Column], Column] | None = None, image_analysis: bool = True, **sending) -> DataFrame:
    """Raw blocks of pages (doc, page_idx, png, point_w, point_h), with what the model recognised in each.

    The model is asked for the layout of each page and then for each block that
    is to be recognised; crop makes the block's image of the page's (null: the
    page itself). Both stages are written once, so that no request is sent again
    for a second reader. A page or block without an answer has its failure.
    """
    asked = pages.withColumn("body", model_stage.request_body(F.lit("layout"), F.lit(model), F.col("png"), model_stage.page_priority(F.col("page_idx"))))
    laid = saved(model_stage.send(asked.select("doc", "page_idx", "point_w", "point_h", "body"), transport, **sending).drop("body"))
    blocks = layout.parse(laid.select("doc", "page_idx", "point_w", "point_h", model_stage.response_content(F.col("response")).alias("layout")))
    jobs = layout.extract_jobs(blocks, image_analysis).join(pages.select("doc", "page_idx", "png"), ["doc", "page_idx"])
    body = model_stage.request_body(F.col("type"), F.lit(model), crop(F.col("png")) if crop else F.col("png"), model_stage.page_priority(F.col("page_idx")))
    told = saved(model_stage.send(jobs.select(*BLOCK, body.alias("body")), transport, **sending).drop("body"))
    answers = told.select(*BLOCK, model_stage.response_content(F.col("response")).alias("content"), F.coalesce("failure", model_stage.response_error(F.col("response"))).alias("failure"))
    return layout.to_points(model_stage.attach(blocks, answers, BLOCK)).withColumnRenamed("block_index", "idx")


def parse_documents(pages: DataFrame, transport: Callable[[str], str], **options) -> DataFrame:
    """Top-level blocks of all pages: recognition, post-processing and structure; render makes the outputs of them."""
    page = ["doc", "page_idx"]
    blocks = saved(structure.to_blocks(structure.post_process(recognise(pages, transport, **options)), page))
    return saved(structure.assemble(blocks, page)).join(pages.select(*page, "point_w", "point_h"), page)


def page_transport(body: str) -> str:
    """A model that sees a title, a text and an image on each page, and reads what the page's own bytes say."""
    import base64

    asked = json.loads(body)
    parts = asked["messages"][1]["content"]
    said = parts[-1]["text"]
    page = base64.b64decode(parts[0]["image_url"]["url"].partition(",")[2]).decode() if len(parts) > 1 else ""
    box = lambda y, kind: f"<|box_start|>100 {y} 900 {y + 90}<|box_end|><|ref_start|>{kind}<|ref_end|>\n"
    content = box(100, "title") + box(200, "text") + box(300, "list") if "Layout" in said else f" {page} " if "Text" in said else ""
    return json.dumps({"object": "chat.completion", "choices": [{"index": 0, "finish_reason": "stop", "message": {"role": "assistant", "content": content + model_stage.END_TOKEN}}]})


def _pages(spark, sf_dir):
    """Nations as documents of one to three pages; a page's bytes are its name and number."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc"), "n_name", F.explode(F.sequence(F.lit(0), (F.col("n_nationkey") % 3).cast("int"))).alias("page_idx"))
    return rows.select("doc", "page_idx", F.encode(F.concat("n_name", F.lit(" "), F.col("page_idx").cast("string")), "utf-8").alias("png"), F.lit(600).alias("point_w"), F.lit(800).alias("point_h"))


def document_blocks(spark, sf_dir):
    rows = recognise(_pages(spark, sf_dir), page_transport)
    return rows.select("doc", "page_idx", "idx", "type", "x1", "y1", "x2", "y2", "content", "failure")


def document_pipeline(spark, sf_dir):
    return render.markdown(parse_documents(_pages(spark, sf_dir), page_transport), ["doc"], ["page_idx", "idx"])


_P = "select cast(n_nationkey as bigint) as doc, cast(p as int) as page_idx, n_name || ' ' || p as t from (select n_nationkey, n_name, unnest(range(0, n_nationkey % 3 + 1)) as p from nation) q"
_AT = lambda c, n: f"cast(floor(cast(cast({c} as double) / 1000 as float)::double * {n}) as bigint)"
DOC_BLOCKS = f"""select doc, page_idx, idx, type, {_AT(100, 600)} as x1, {_AT("y", 800)} as y1, {_AT(900, 600)} as x2, {_AT("y + 90", 800)} as y2, case when type <> 'list' then ' ' || t || ' ' end as content, cast(null as varchar) as failure
from ({_P}) p cross join (values (0, 'title', 100), (1, 'text', 200), (2, 'list', 300)) b(idx, type, y)"""
DOC_MARKDOWN = f"""select doc, string_agg('# ' || replace(t, '_', chr(92) || '_') || chr(10) || chr(10) || replace(t, '_', chr(92) || '_'), chr(10) || chr(10) order by page_idx) as markdown from ({_P}) p group by doc"""


def block_images(spark, sf_dir):
    """Crops of layout blocks out of pages of 1700 x 2200 pixels."""
    rows = derived(spark, sf_dir, inputs.SEGMENTS).where("type <> 'inline_formula'")
    unit = lambda f, a, b: (f(F.col(a), F.col(b)).cast("double") / 1000).cast("float")
    box = [unit(F.least, "a1", "a2"), unit(F.least, "b1", "b2"), unit(F.greatest, "a1", "a2"), unit(F.greatest, "b1", "b2")]
    angle = F.when(F.col("rotation") == "right", 90).when(F.col("rotation") == "down", 180)
    return rows.select("doc", "page_idx", "seg", layout.block_image(F.lit(1700), F.lit(2200), box, angle).alias("c")).select("doc", "page_idx", "seg", "c.*")


_U = lambda e: f"cast(cast({e} as double) / 1000 as float)"
IMAGES = f"""with c as (select doc, page_idx, seg, rotation = 'right' as lies, cast(greatest(floor({_U('least(a1, a2)')} * cast(1700 as float)), 0) as bigint) as x1, cast(greatest(floor({_U('least(b1, b2)')} * cast(2200 as float)), 0) as bigint) as y1,
cast(least(ceil({_U('greatest(a1, a2)')} * cast(1700 as float)), 1700) as bigint) as x2, cast(least(ceil({_U('greatest(b1, b2)')} * cast(2200 as float)), 2200) as bigint) as y2 from ({inputs.SEGMENTS}) s where type <> 'inline_formula'),
t as (select *, case when lies then y2 - y1 else x2 - x1 end as width, case when lies then x2 - x1 else y2 - y1 end as height from c),
k as (select *, case when height > width and height > 50 * greatest(width, 1) then cast(ceil(height / 50.0) as bigint) else width end as canvas_w, case when width > height and width > 50 * greatest(height, 1) then cast(ceil(width / 50.0) as bigint) else height end as canvas_h from t),
e as (select *, greatest(least(canvas_w, canvas_h), 1) as edge from k)
select doc, page_idx, seg, x1, y1, x2, y2, width, height, canvas_w, canvas_h, case when edge < 28 then cast(round(canvas_w * 28 / cast(edge as double)) as bigint) else canvas_w end as out_w,
case when edge < 28 then cast(round(canvas_h * 28 / cast(edge as double)) as bigint) else canvas_h end as out_h, case when x2 <= x1 or y2 <= y1 then 'Invalid block crop bbox' end as error from e"""

# -- service --------------------------------------------------------------------------------------------------------


def _requests(spark, sf_dir):
    pick = lambda xs, k: F.element_at(F.array(*map(F.lit, xs)), (F.col("o_custkey") % len(xs) + 1).cast("int")).alias(k)
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), F.array(F.concat(F.lit("f"), F.col("o_orderkey").cast("string"))).alias("file_names"), F.col("o_orderdate").cast("timestamp").alias("created_at"), pick(("auto", "ocr", "bad"), "parse_method"), F.lit("vlm-http-client").alias("backend"), F.lit(0).alias("start_page_id"), F.lit(9).alias("end_page_id"), F.lit(1).alias("n_files"))
    return rows


def submitted_tasks(spark, sf_dir):
    return service.submit(_requests(spark, sf_dir), URL).select("task_id", "status", "http_status", "submit_order", "body")


_STAMP = lambda c: f"strftime({c}, '%Y-%m-%dT%H:%M:%S+00:00')"
SUBMITTED = f"""with r as (select *, o_custkey % 3 = 2 as bad from orders), n as (select o_orderkey as k, row_number() over (order by o_orderdate, o_orderkey) as submit_order from r where not bad)
select o_orderkey as task_id, case when not bad then 'pending' end as status, case when bad then 400 else 202 end as http_status, n.submit_order,
case when bad then '{{"detail":"Invalid parse_method. Allowed values: auto, ocr, txt","error_type":"bad_request"}}' else '{{"task_id":"' || o_orderkey || '","status":"pending","backend":"vlm-http-client","file_names":["f' || o_orderkey || '"],"created_at":"' || {_STAMP("o_orderdate")} || '","started_at":null,"completed_at":null,"error":null,"status_url":"{URL}/tasks/' || o_orderkey || '","result_url":"{URL}/tasks/' || o_orderkey || '/result","message":"{service.SUBMITTED}"}}' end as body
from r left join n on n.k = r.o_orderkey"""


def _asked(spark, sf_dir):
    """Every task, and as many that do not exist."""
    return table(spark, sf_dir, "orders").select(F.explode(F.array("o_orderkey", -F.col("o_orderkey"))).alias("task_id"))


def task_answers(spark, sf_dir):
    return service.status(_asked(spark, sf_dir), derived(spark, sf_dir, inputs.TASKS), URL)


def result_answers(spark, sf_dir):
    known = derived(spark, sf_dir, inputs.TASKS)
    results = known.where("status = 'completed'").select("task_id", F.concat(F.lit('{"results":'), F.col("task_id").cast("string"), F.lit("}")).alias("body"))
    return service.result(_asked(spark, sf_dir), known, results, URL)


_A = f"select a.task_id, t.* exclude (task_id), t.task_id is null as lost from (select unnest([o_orderkey, -o_orderkey]) as task_id from orders) a left join ({inputs.TASKS}) t on t.task_id = a.task_id"
_LOST = '\'{"detail":"Task not found","error_type":"not_found"}\''
_JSON = lambda tail: f"""'{{"task_id":"' || task_id || '","status":"' || status || '","backend":"' || backend || '","file_names":null,"created_at":"' || {_STAMP("created_at")} || '","started_at":null,"completed_at":' || coalesce('"' || {_STAMP("completed_at")} || '"', 'null') || ',"error":null,"status_url":"{URL}/tasks/' || task_id || '","result_url":"{URL}/tasks/' || task_id || '/result"{tail}}}'"""
ANSWERS = f"select task_id, case when lost then 404 else 200 end as http_status, case when lost then {_LOST} else {_JSON('')} end as body from ({_A}) q"
RESULTS = f"""select task_id, case when lost then 404 when status in ('pending', 'processing') then 202 when status = 'failed' then 409 else 200 end as http_status,
case when lost then {_LOST} when status = 'failed' then {_JSON(',"message":"' + service.FAILED + '"')} when status = 'completed' then '{{"results":' || task_id || '}}' else {_JSON(',"message":"' + service.NOT_READY + '"')} end as body from ({_A}) q"""


def health(spark, sf_dir):
    flying = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 100 == 0, F.lit("active")).when(F.col("event_id") % 7 == 0, F.lit("queued")).otherwise(F.lit("done")).alias("state"))
    return service.health(derived(spark, sf_dir, inputs.TASKS), config.load({}), render.VERSION, flying)


HEALTH = f"""select 'healthy' as status, '{render.VERSION}' as version, {service.PROTOCOL_VERSION} as protocol_version, p as queued_tasks, r as processing_tasks, c as completed_tasks, f as failed_tasks, 3 as max_concurrent_requests, 6 as max_in_flight_tasks, greatest(6 - p - r, 0) as available_admission_permits,
268435456 as max_upload_size_bytes, 8 as processing_window_size, 50 as vlm_max_concurrency, greatest(50 - a, 0) as available_vlm_permits, q as vlm_queue_depth, a as active_vlm_requests, 200 as vlm_queue_capacity, 8 as max_vlm_requests_per_task,
null::bigint as allocator_allocated_bytes, null::bigint as allocator_resident_bytes, null::bigint as allocator_retained_bytes, 86400 as task_retention_seconds, 300 as task_cleanup_interval_seconds
from (select count(*) filter (status = 'pending') as p, count(*) filter (status = 'processing') as r, count(*) filter (status = 'completed') as c, count(*) filter (status = 'failed') as f from ({inputs.TASKS}) t),
(select count(*) filter (event_id % 100 = 0) as a, count(*) filter (event_id % 100 <> 0 and event_id % 7 = 0) as q from events)"""


def landing_names(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / 50).alias("task_id"), F.col("c_custkey").alias("idx"), F.concat(F.lit("n"), (F.col("c_nationkey") % 4).cast("string"), F.when(F.col("c_custkey") % 2 == 0, F.lit(".tar.gz")).otherwise(F.lit(""))).alias("base_name"))
    return tasks.landing_names(rows, "task_id").select("idx", "landing_name")


LANDING = """select idx, case when n = 1 then b || s when s = '' then b || '__upload_' || n else b || '.tar__upload_' || n || '.gz' end as landing_name from (
select c_custkey as idx, 'n' || c_nationkey % 4 as b, case when c_custkey % 2 = 0 then '.tar.gz' else '' end as s, row_number() over (partition by c_custkey // 50, c_nationkey % 4, c_custkey % 2 order by c_custkey) as n from customer) q"""


#: Fields of requests: orders as requests, lines as fields.
FIELDS = """SELECT l_orderkey AS task_id, l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey AS ord, CASE l_partkey % 7 WHEN 0 THEN 'return_md' WHEN 1 THEN 'start_page_id' WHEN 2 THEN 'lang_list' WHEN 3 THEN 'response_format_zip' WHEN 4 THEN 'return_original_file' WHEN 5 THEN 'backend' ELSE 'other' END AS name,
CASE l_partkey % 7 WHEN 0 THEN CASE l_suppkey % 3 WHEN 0 THEN ' No ' WHEN 1 THEN 'TRUE' ELSE 'perhaps' END WHEN 1 THEN CASE l_suppkey % 3 WHEN 0 THEN '+12' WHEN 1 THEN concat('', CAST(l_suppkey AS VARCHAR(20))) ELSE ' 7' END WHEN 2 THEN concat('l', CAST(l_suppkey AS VARCHAR(20))) WHEN 5 THEN concat('b', CAST(l_suppkey AS VARCHAR(20))) ELSE 'yes' END AS value FROM lineitem"""


def form_options(spark, sf_dir):
    rows = tasks.form_options(derived(spark, sf_dir, FIELDS))
    return rows.select("task_id", "backend", "return_md", "response_format_zip", "return_original_file", F.col("start_page_id").cast("long").alias("start_page_id"), F.col("end_page_id").cast("long").alias("end_page_id"), F.array_join("lang_list", "|").alias("langs"), "field_error")


OPTIONS = f"""with f as (select *, case when name = 'return_md' then case lower(trim(value)) when 'no' then false when 'true' then true end end as flag, case when name = 'start_page_id' and regexp_full_match(value, '[+]?[0-9]+') then cast(value as bigint) end as num from ({FIELDS}) q),
e as (select *, case when name = 'return_md' and flag is null then 'Invalid boolean value: ' || lower(trim(value)) when name = 'start_page_id' and num is null then 'Invalid integer value for start_page_id: ' || value end as bad from f)
select task_id, coalesce(arg_max(value, ord) filter (name = 'backend'), 'vlm-http-client') as backend, coalesce(list(flag order by ord desc) filter (name = 'return_md')[1], true) as return_md, count(*) filter (name = 'response_format_zip') > 0 as response_format_zip,
count(*) filter (name = 'response_format_zip') > 0 and count(*) filter (name = 'return_original_file') > 0 as return_original_file, coalesce(list(num order by ord desc) filter (name = 'start_page_id')[1], 0) as start_page_id, 99999::bigint as end_page_id,
concat_ws('|', 'ch', string_agg(value, '|' order by ord) filter (name = 'lang_list')) as langs, arg_min(bad, ord) filter (bad is not null) as field_error from e group by task_id"""


def window_timings(spark, sf_dir):
    """Orders as documents, lines as pages of eight a window; quantities as milliseconds."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.floor((F.col("l_linenumber") - 1) / 3).alias("window_id"), F.col("l_linenumber").alias("page_idx"), F.element_at(F.array(*map(F.lit, model_stage.STAGES)), (F.col("l_partkey") % 2 + 1).cast("int")).alias("stage"), F.lit(2).alias("n_blocks"), F.col("l_quantity").cast("long").alias("elapsed_ms"))
    return model_stage.window_timings(rows, ["doc", "window_id"])


TIMINGS = """select l_orderkey as doc, (l_linenumber - 1) // 3 as window_id, count(distinct l_linenumber) as n_pages, cast(count(*) * 2 as bigint) as n_blocks, cast(coalesce(sum(cast(l_quantity as bigint)) filter (l_partkey % 2 = 0), 0) as bigint) as layout_ms, cast(coalesce(sum(cast(l_quantity as bigint)) filter (l_partkey % 2 = 1), 0) as bigint) as extract_ms from lineitem group by 1, 2"""

QUERIES = {f.__name__: f for f in (document_blocks, document_pipeline, block_images, submitted_tasks, task_answers, result_answers, health, landing_names, window_timings, form_options)}
SQL = {
    "document_blocks": DOC_BLOCKS, "document_pipeline": DOC_MARKDOWN, "block_images": IMAGES, "submitted_tasks": SUBMITTED, "task_answers": ANSWERS, "result_answers": RESULTS, "health": HEALTH,
    "landing_names": LANDING, "window_timings": TIMINGS, "form_options": OPTIONS,
}
