"""Queries of packages, results and streams."""

from __future__ import annotations

import io
import os
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import office, tasks
from ..session import once, saved, shared_folder
from ..sources import ooxml, sinks
from ..streaming import ingest, lifecycle
from .inputs import table
from .text_queries import d_trim

_NS = 'xmlns:w="w" xmlns:r="r" xmlns:a="a" xmlns:p="p" xmlns:m="m"'
#: Name spaces and types of relationships.
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PNG = b"\x89PNG\r\n\x1a\n" + b"\0" * 16


def package(parts: dict[str, str | bytes]) -> bytes:
    """A ZIP package of parts with content types for XML and PNG."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", '<Types><Default Extension="xml" ContentType="application/xml"/><Default Extension="png" ContentType="image/png"/></Types>')
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def rels(*rows: tuple[str, str, str, bool]) -> str:
    return "<Relationships>" + "".join(f'<Relationship Id="{i}" Type="{_REL}/{k}" Target="{t}"{" TargetMode=" + chr(34) + "External" + chr(34) if e else ""}/>' for i, k, t, e in rows) + "</Relationships>"


def docx_package(title: str, lines: list[str], *cells: str) -> bytes:
    """A heading, lines in turn with a bold first word, as list items (two) and as a link with a formula, a table row, an image and a missing one."""
    def paragraph(k: int, line: str) -> str:
        if k % 4 == 0:
            first, space, rest = line.partition(" ")
            return f"<w:p><w:r><w:rPr><w:b/></w:rPr><w:t>{escape(first)}</w:t></w:r><w:r><w:t>{escape(space + rest)}</w:t></w:r></w:p>"
        if k % 4 == 3:
            return f'<w:p><w:hyperlink r:id="rId2"><w:r><w:t>{escape(line)}</w:t></w:r></w:hyperlink><m:oMath><m:r><m:t>{k}</m:t></m:r></m:oMath></w:p>'
        return f"<w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>{escape(line)}</w:t></w:r></w:p>"

    row = "".join(f"<w:tc><w:p><w:r><w:t>{escape(c)}</w:t></w:r></w:p></w:tc>" for c in cells)
    images = "".join(f'<w:p><w:r><a:blip r:embed="{i}"/></w:r></w:p>' for i in ("rId1", "rId9"))
    body = f'<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>{escape(title)}</w:t></w:r></w:p>{"".join(paragraph(k, x) for k, x in enumerate(lines))}<w:tbl><w:tr>{row}</w:tr></w:tbl>{images}'
    return package({"word/document.xml": f"<w:document {_NS}><w:body>{body}</w:body></w:document>", "word/_rels/document.xml.rels": rels(("rId1", "image", "media/i.png", False), ("rId2", "hyperlink", "http://a/b c", True)), "word/media/i.png": PNG})


def pptx_package(lines: list[str], note: str) -> bytes:
    """Four lines on a slide, the last one on top; slides in the presentation from the last to the first, which has a note."""
    shape = lambda k, t: f'<p:sp><p:spPr><a:xfrm><a:off x="0" y="{300 - k % 4 * 100}"/><a:ext cx="9" cy="9"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>{escape(t)}</a:t></a:r></a:p></p:txBody></p:sp>'
    n = (len(lines) + 3) // 4
    order = "".join(f'<p:sldId id="{i}" r:id="rId{i}"/>' for i in range(n, 0, -1))
    parts = {"ppt/presentation.xml": f'<p:presentation {_NS}><p:sldSz cx="9144000" cy="5143500"/><p:sldIdLst>{order}</p:sldIdLst></p:presentation>', "ppt/_rels/presentation.xml.rels": rels(*((f"rId{i}", "slide", f"slides/slide{i}.xml", False) for i in range(1, n + 1)))}
    for i in range(n):
        parts[f"ppt/slides/slide{i + 1}.xml"] = f"<p:sld {_NS}><p:cSld><p:spTree>{''.join(shape(k, lines[k]) for k in range(4 * i, min(len(lines), 4 * i + 4)))}</p:spTree></p:cSld></p:sld>"
    return package(parts | {"ppt/slides/_rels/slide1.xml.rels": rels(("rId1", "notesSlide", "../notesSlides/n1.xml", False)), "ppt/notesSlides/n1.xml": f"<p:notes {_NS}><a:t>about</a:t><a:t>{escape(note)}</a:t></p:notes>"})


def xlsx_package(name: str, lines: list[str]) -> bytes:
    """A sheet with the lines, as shared strings, and their numbers; the first line's cells are one. A second sheet is hidden."""
    sheet = "".join(f'<row r="{k + 1}"><c r="A{k + 1}" t="s"><v>{k}</v></c><c r="B{k + 1}"><v>{k}.0</v></c></row>' for k in range(len(lines)))
    return package({
        "xl/workbook.xml": f'<workbook {_NS}><sheets><sheet name="{escape(name)}" sheetId="1" r:id="rId1"/><sheet name="Hidden" sheetId="2" state="hidden" r:id="rId2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": rels(("rId1", "worksheet", "worksheets/sheet1.xml", False), ("rId2", "worksheet", "worksheets/sheet2.xml", False)),
        "xl/sharedStrings.xml": f"<sst>{''.join(f'<si><t>{escape(x)}</t></si>' for x in lines)}</sst>",
        "xl/worksheets/sheet1.xml": f'<worksheet><sheetData>{sheet}</sheetData><mergeCells><mergeCell ref="A1:B1"/></mergeCells></worksheet>',
        "xl/worksheets/sheet2.xml": '<worksheet><sheetData><row r="1"><c r="A1"><v>1</v></c></row></sheetData></worksheet>',
    })


def _made(spark, sf_dir):
    """A package for each document, of its lines: in turn a docx, a pptx and an xlsx."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars")

    def build(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for d, t, lang, n in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                suffix, lines = ("docx", "pptx", "xlsx")[d % 3], t.split("\n")
                raw = docx_package(f"Document {d}", lines, lang, str(n)) if d % 3 == 0 else pptx_package(lines, str(d)) if d % 3 == 1 else xlsx_package(f"S {d}", lines)
                rows.append((f"f{d}.{suffix}", suffix, raw))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.binary()))], ["file", "suffix", "content"])

    return docs.mapInArrow(build, "file string, suffix string, content binary")


def packages(spark, sf_dir):
    return saved(_made(spark, sf_dir))


def office_blocks(spark, sf_dir):
    """The blocks of all packages, written once for all queries of a session."""
    return once(spark, "office blocks", sf_dir, lambda: ooxml.blocks(_made(spark, sf_dir)))


def ooxml_blocks(spark, sf_dir):
    return office_blocks(spark, sf_dir).select("file", "page_idx", "idx", "kind", "content", "level", "html", "reason", F.array_join("items", "|").alias("items"))


def ooxml_markdown(spark, sf_dir):
    return office.markdown(office_blocks(spark, sf_dir))


def ooxml_content_list(spark, sf_dir):
    return office.content_list(office_blocks(spark, sf_dir)).where("item is not null").select("file", "idx", "item")


def ooxml_content_list_v2(spark, sf_dir):
    return office.content_list_v2(office_blocks(spark, sf_dir)).where("item is not null").select("file", "idx", "item")


def ooxml_middle_json(spark, sf_dir):
    return office.middle_json(office_blocks(spark, sf_dir))


def ooxml_parts(spark, sf_dir):
    return ooxml.parts(packages(spark, sf_dir)).groupBy("content_type").agg(F.count("*").alias("n"))


def ooxml_relationships(spark, sf_dir):
    return ooxml.relationships(packages(spark, sf_dir)).select("file", "base_part", "rel_id", "target", "target_part")


def ooxml_elements(spark, sf_dir):
    """Elements of all main parts by name and depth, and the events that lie within them: intervals of places."""
    events = ooxml.events(ooxml.parts(packages(spark, sf_dir)), r"^(word/document|ppt/slides/[^/]*|xl/worksheets/sheet1)\.xml$")
    closing = F.max("pos").over(Window.partitionBy("file", "part", "start"))
    sized = events.withColumn("inside", closing - F.col("start")).where("open")
    return sized.groupBy(F.regexp_extract("part", "^([a-z]+)/", 1).alias("folder"), "name", "depth").agg(F.count("*").alias("n"), F.sum("inside").cast("long").alias("inside"))


_E = lambda x: f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_Q = lambda x: f"replace({_E(x)}, '\"', '&quot;')"
_O = lambda x: f"replace(replace(replace(replace({x}, chr(92), chr(92) || chr(92)), '[', chr(92) || '['), ']', chr(92) || ']'), '_', chr(92) || '_')"
_PATH = f"'images/' || sha256('data:image/png;base64,' || base64(from_hex('{PNG.hex()}'))) || '.png'"
_LINES = "select doc_id as d, lang, n_chars, len(string_split(text, chr(10))) as n, generate_subscripts(string_split(text, chr(10)), 1) - 1 as k, unnest(string_split(text, chr(10))) as line from documents"
_FIRST = "split_part(line, ' ', 1)"
_REST = "substr(line, length(split_part(line, ' ', 1)) + 1)"
_SPAN = lambda content, more="": f"'{{\"type\":\"text\",\"content\":' || to_json({content}) || '{more}}}'"
#: Blocks of all packages: content, Markdown (md) and nested spans (v2) of each, from the documents' lines.
OFFICE_BLOCKS = f"""l as ({_LINES}),
w as (select d, k, case when line = '' then 'equation' when k % 4 in (1, 2) then 'list' else 'text' end as kind,
case when k % 4 = 0 then {d_trim(f"case when {_FIRST} <> '' then '<text style=\"bold\">' || {_Q(_FIRST)} || '</text>' else '' end || {_Q(_REST)}")}
when k % 4 = 3 then case when line = '' then k::varchar else '<hyperlink><text>' || {_Q("line")} || '</text><url>http://a/b c</url></hyperlink><eq>' || k || '</eq>' end else {d_trim(_Q("line"))} end as content,
case when k % 4 = 0 then case when {_FIRST} = '' then {_O(d_trim(_REST))} else '**' || {_O(_FIRST)} || '**' || {_O(f"rtrim({_REST})")} end
when k % 4 = 3 then case when line = '' then '$$' || chr(10) || k || chr(10) || '$$' else '[' || {_O("line")} || '](http://a/b%20c)$' || k || '$' end else '- ' || {_O(d_trim("line"))} end as md,
case when k % 4 = 0 then case when {_FIRST} = '' then {_SPAN(d_trim(_REST))} else {_SPAN(_FIRST, ',"style":["bold"]')} || case when rtrim({_REST}) = '' then '' else ',' || {_SPAN(f"rtrim({_REST})")} end end
when k % 4 = 3 then '{{"type":"hyperlink","content":' || to_json(line) || ',"url":"http://a/b c"}},{{"type":"equation_inline","content":"' || k || '"}}' else {_SPAN(d_trim("line"))} end as v2
from l where d % 3 = 0 and (k % 4 = 3 or {d_trim("line")} <> '')),
x as (select * from w union all select doc_id, -1, 'title', 'Document ' || doc_id, '# Document ' || doc_id, {_SPAN("'Document ' || doc_id")} from documents where doc_id % 3 = 0
union all select doc_id, 1000000000, 'table', '<table><tr><td>' || lang || '</td><td>' || n_chars || '</td></tr></table>', null, null from documents where doc_id % 3 = 0
union all select doc_id, 1000000001, 'image', {_PATH}, null, null from documents where doc_id % 3 = 0 union all select doc_id, 1000000002, 'discarded', 'missing_image_part: rId9', null, null from documents where doc_id % 3 = 0),
y as (select *, case when kind = 'list' and coalesce(lag(kind) over (partition by d order by k), '') = 'list' then 0 else 1 end as fresh from x),
z as (select *, sum(fresh) over (partition by d order by k) as g from y),
g as (select *, row_number() over (partition by d, g order by k) - 1 as i from z),
word as (select 'f' || d || '.docx' as file, 0 as page_idx, cast(g - 1 as int) as idx, any_value(kind) as kind, string_agg(content, '|' order by k) as content, string_agg(md, chr(10) order by k) as md, string_agg(case when kind = 'list' then '{{"item_type":"text","ilevel":0,"prefix":"-","item_content":[' || v2 || ']}}' else v2 end, ',' order by k) as v2, case when any_value(kind) = 'list' then string_agg(to_json({_O("replace(replace(replace(replace(content, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&')")})::varchar, ',' order by k) end as shown, case when any_value(kind) = 'title' then 1 end as level, string_agg(case when kind = 'list' then '{{"type":"text","index":' || i || ',"lines":[{{"spans":[' || v2 || ']}}]}}' else v2 end, ',' order by k) as mj from g group by d, g),
s as (select d, cast((n + 3) // 4 - 1 - k // 4 as int) as page_idx, 0 as o, 3 - k % 4 as y, k, {d_trim("line")} as t from l where d % 3 = 1 and {d_trim("line")} <> '' union all select doc_id, cast((len(string_split(text, chr(10))) + 3) // 4 - 1 as int), 1, 0, 0, 'Notes: about ' || doc_id from documents where doc_id % 3 = 1),
r as (select *, row_number() over (partition by d order by page_idx, o, y) - 1 as i, row_number() over (partition by d, page_idx order by o, y) as pl from s),
slides as (select 'f' || d || '.pptx' as file, page_idx, cast(i as int) as idx, case when pl = 1 and o = 0 and strlen(t) < 80 then 'title' else 'text' end as kind, t as content, case when pl = 1 and o = 0 and strlen(t) < 80 then '# ' else '' end || {_O("t")} as md, {_SPAN("t")} as v2, null as shown, case when pl = 1 and o = 0 and strlen(t) < 80 then 1 end as level, {_SPAN("t")} as mj from r),
sheets as (select 'f' || d || '.xlsx' as file, 0 as page_idx, 0 as idx, 'table' as kind, '<table><caption>S ' || d || '</caption>' || string_agg(case when k = 0 then '<tr><td colspan="2">' || {_Q("line")} || '</td></tr>' else '<tr><td>' || {_Q("line")} || '</td><td>' || k || '</td></tr>' end, '' order by k) || '</table>' as content, null as md, null as v2, null as shown, null::int as level, null as mj from l where d % 3 = 2 group by d),
b as (select * from word union all select * from slides union all select * from sheets)"""
BLOCKS_SQL = f"""with {OFFICE_BLOCKS} select file, page_idx, idx, kind, case when kind in ('text', 'title', 'equation', 'discarded') then content end as content, level, case when kind = 'table' then content end as html, case when kind = 'discarded' then 'missing_image_part' end as reason, case when kind = 'list' then content end as items from b"""
MARKDOWN_SQL = f"""with {OFFICE_BLOCKS} select file, string_agg(case kind when 'table' then content when 'image' then '![image](' || content || ')' else md end, chr(10) || chr(10) order by page_idx, idx) filter (where kind <> 'discarded') || chr(10) as markdown from b group by file"""


def _results(spark, sf_dir, markdown):
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.floor(F.col("doc_id") / 4).alias("task_id"), F.concat(F.lit("d"), "doc_id").alias("stem"), F.lit("vlm").alias("subdir"), markdown.alias("markdown"), F.to_json(F.struct("lang")).alias("middle_json"))


def zip_manifest(spark, sf_dir):
    return sinks.zip_manifest(sinks.artifacts(_results(spark, sf_dir, F.col("text")))).select("task_id", "rel_path", "size", "offset")


ZIP_SQL = """with r as (select doc_id // 4 as task_id, 'd' || doc_id as stem, text as md, '{"lang":"' || lang || '"}' as mj from documents),
f as (select task_id, stem || '/vlm/' || stem || '.md' as rel_path, strlen(md) as size from r union all select task_id, stem || '/vlm/' || stem || '_middle.json', strlen(mj) from r where mj is not null)
select task_id, rel_path, size, cast(coalesce(sum(46 + strlen(rel_path) + size) over (partition by task_id order by rel_path rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset" from f"""


def result_json(spark, sf_dir):
    return sinks.result_json(_results(spark, sf_dir, F.col("text")), "vlm", "1.0.0", {"markdown": True, "middle_json": True})


def original_names(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.element_at(F.array(*map(F.lit, ("pdf", "png", "docx", "xlsx", "txt"))), (F.col("c_custkey") % 5 + 1).cast("int")).alias("suffix"))
    return rows.select("c_custkey", sinks.original_file(tasks.document_kind(F.col("suffix")), F.col("suffix"), F.concat(F.lit("s"), "c_custkey")).alias("name"))


def stream_ingest(spark, sf_dir):
    """Events as a stream in one available-now run, counted by day and type: each batch writes the windows that it changed,
    of which the last version counts; windows that the watermark has passed leave the state."""
    folder = f"{shared_folder(spark)}/stream-{os.urandom(6).hex()}"
    schema = table(spark, sf_dir, "events").schema
    events = ingest.parquet_stream(spark, f"{sf_dir}/events.parquet*", schema).withColumn("ts", F.col("ts").cast("timestamp"))
    out = f"{folder}/out"

    def keep(batch, number):
        batch.select(F.col("window.start").alias("day"), "event_type", "n", F.round("total", 4).alias("total")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = ingest.event_counts(events).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.parquet(out)
    last = found.groupBy("day", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("last"))
    return last.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "last.n", "last.total")


def task_states(spark, sf_dir):
    """Status changes of tasks folded to their latest state."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), F.element_at(F.array(*map(F.lit, tasks.STATUSES)), (F.col("event_id") % 4 + 1).cast("int")).alias("status"), F.col("event_id").alias("at"))
    return ingest.fold_status(rows)


def task_lifecycle(spark, sf_dir):
    """Tasks and leases from a stream of the events, with a day of retention: who is there when the watermark has passed all events."""
    folder = f"{shared_folder(spark)}/stream-{os.urandom(6).hex()}"
    schema = table(spark, sf_dir, "events").schema
    events = ingest.parquet_stream(spark, f"{sf_dir}/events.parquet*", schema)
    kinds = F.element_at(F.array(*map(F.lit, ("pending", "acquire", "processing", "release", "completed", "failed", "acquire"))), (F.col("event_id") % 7 + 1).cast("int"))
    lease = F.when(kinds.isin("acquire", "release"), F.concat(F.lit("l"), (F.floor(F.col("event_id") / 7) % 2).cast("string")))
    changes = events.select(F.col("user_id").cast("long").alias("task_id"), F.col("event_id").cast("long").alias("seq"), kinds.alias("kind"), lease.alias("lease"), F.col("ts").cast("timestamp").alias("at"))
    found = lifecycle.live(lifecycle.run(changes, f"{folder}/out", f"{folder}/state", 24 * 3600))
    return found.select("task_id", "status", *[F.unix_millis(c).alias(c) for c in ("created_at", "started_at", "completed_at")], F.col("readers").cast("long").alias("readers"))


LIFECYCLE = """with e as (select user_id as t, event_id as seq, epoch_us(ts) // 1000 as ms, ['pending', 'acquire', 'processing', 'release', 'completed', 'failed', 'acquire'][event_id % 7 + 1] as kind, event_id // 7 % 2 as lease from events),
w as (select max(epoch_us(ts)) // 1000 - 3600000 as wm from events),
s as (select *, min(case when kind in ('completed', 'failed') then seq end) over (partition by t) as done, min(case when kind in ('pending', 'processing', 'completed', 'failed') then seq end) over (partition by t) as first_seq from e),
k as (select t, arg_max(kind, seq) as status, arg_min(ms, seq) as created_at, arg_min(case when kind = 'processing' then ms end, case when kind = 'processing' then seq end) as started_at, arg_min(case when kind in ('completed', 'failed') then ms end, case when kind in ('completed', 'failed') then seq end) as completed_at from s where kind not in ('acquire', 'release') and (done is null or seq <= done) group by t),
l as (select t, count(*) filter (where k = 'acquire') as readers from (select t, lease, arg_max(kind, seq) as k from s where kind in ('acquire', 'release') and seq > first_seq group by all) x group by t)
select k.t as task_id, status, created_at, started_at, completed_at, coalesce(readers, 0) as readers from k left join l using (t), w where completed_at is null or completed_at + 86400000 > wm or coalesce(readers, 0) > 0"""


def task_state_stream(spark, sf_dir):
    """The same as a stream with state, by the time of the events."""
    folder = f"{shared_folder(spark)}/stream-{os.urandom(6).hex()}"
    schema = table(spark, sf_dir, "events").schema
    events = ingest.parquet_stream(spark, f"{sf_dir}/events.parquet*", schema)
    status = F.element_at(F.array(*map(F.lit, tasks.STATUSES)), (F.col("event_id") % 4 + 1).cast("int"))
    states = ingest.live_states(events.select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), status.alias("status"), F.col("ts").cast("timestamp").alias("at")))
    query = states.writeStream.outputMode("update").foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    last = spark.read.parquet(f"{folder}/out").groupBy("task_id").agg(F.max_by(F.struct("status", "created_at", "started_at", "completed_at"), "batch").alias("s"))
    return last.select("task_id", "s.status", *[F.unix_micros(f"s.{c}").alias(c) for c in ("created_at", "started_at", "completed_at")])


STATE_STREAM = """with e as (select user_id as task_id, event_id as seq, epoch_us(ts) as t, ['pending', 'processing', 'completed', 'failed'][event_id % 4 + 1] as status from events),
m as (select *, min(case when status in ('completed', 'failed') then seq end) over (partition by task_id) as done from e), v as (select * from m where done is null or seq <= done)
select task_id, arg_max(status, seq) as status, min(t) as created_at, min(case when status = 'processing' then t end) as started_at, min(case when status in ('completed', 'failed') then t end) as completed_at from v group by 1"""

STATES_SQL = """with e as (select user_id as task_id, event_id as seq, ['pending', 'processing', 'completed', 'failed'][event_id % 4 + 1] as status from events),
m as (select *, min(case when status in ('completed', 'failed') then seq end) over (partition by task_id) as done from e), v as (select * from m where done is null or seq <= done)
select task_id, arg_max(status, seq) as status, min(seq) as created_at, min(case when status = 'processing' then seq end) as started_at, min(case when status in ('completed', 'failed') then seq end) as completed_at from v group by 1"""

CONTENT_LIST = f"""with {OFFICE_BLOCKS} select file, idx, case kind when 'text' then '{{"type":"text","text":' || to_json(md) || ',"page_idx":' || page_idx || '}}' when 'title' then '{{"type":"text","text":' || to_json(substr(md, 3)) || ',"text_level":1,"page_idx":' || page_idx || '}}'
when 'list' then '{{"type":"list","list_items":[' || shown || '],"page_idx":0}}' when 'equation' then '{{"type":"equation","text":"' || content || '","text_format":"latex","page_idx":0}}' when 'table' then '{{"type":"table","table_caption":[],"table_body":' || to_json(content) || ',"page_idx":0}}'
else '{{"type":"image","img_path":"' || content || '","image_path":"' || content || '","image_caption":[],"image_footnote":[],"content":"image","page_idx":0}}' end as item from b where kind <> 'discarded'"""
CONTENT_LIST_V2 = f"""with {OFFICE_BLOCKS} select file, idx, case kind when 'text' then '{{"type":"paragraph","content":{{"paragraph_content":[' || v2 || ']}}}}' when 'title' then '{{"type":"title","content":{{"title_content":[' || v2 || '],"level":1}}}}'
when 'list' then '{{"type":"list","content":{{"list_type":"text_list","attribute":"unordered","list_items":[' || v2 || ']}}}}' when 'equation' then '{{"type":"equation_interline","content":{{"math_content":"' || content || '","math_type":"latex"}}}}'
when 'table' then '{{"type":"table","content":{{"table_caption":[],"html":' || to_json(content) || ',"table_type":"' || case when content like '%colspan%' then 'complex_table' else 'simple_table' end || '","table_nest_level":1}}}}' else '{{"type":"image","content":{{"image_source":{{"path":"' || content || '"}},"image_caption":[]}}}}' end as item from b where kind <> 'discarded'"""
OFFICE_MIDDLE = f"""with {OFFICE_BLOCKS}, n as (select *, row_number() over (partition by file, page_idx, kind = 'discarded' order by idx) - 1 as at_ from b),
j as (select file, page_idx, kind = 'discarded' as gone, at_, case kind when 'discarded' then '{{"type":"discarded","index":' || at_ || ',"reason":"missing_image_part","detail":"rId9"}}'
when 'text' then '{{"type":"text","index":' || at_ || ',"lines":[{{"spans":[' || replace(mj, 'equation_inline', 'inline_equation') || ']}}]}}' when 'title' then '{{"type":"title","index":' || at_ || ',"level":1,"lines":[{{"spans":[' || mj || ']}}]}}'
when 'list' then '{{"type":"list","index":' || at_ || ',"blocks":[' || mj || ']}}' when 'equation' then '{{"type":"interline_equation","index":' || at_ || ',"lines":[{{"spans":[{{"type":"interline_equation","content":"' || content || '"}}]}}]}}'
when 'image' then '{{"type":"image","index":' || at_ || ',"blocks":[{{"type":"image_body","lines":[{{"spans":[{{"type":"image","content":"image","image_path":"' || content || '"}}]}}]}}]}}'
else '{{"type":"table","index":' || at_ || ',"blocks":[{{"type":"table_body","lines":[{{"spans":[{{"type":"table","content":' || to_json(content) || ',"html":' || to_json(content) || '}}]}}]}}]}}' end as j from n),
p as (select file, page_idx, '{{"page_idx":' || page_idx || ',"para_blocks":[' || coalesce(string_agg(j, ',' order by at_) filter (where not gone), '') || '],"discarded_blocks":[' || coalesce(string_agg(j, ',' order by at_) filter (where gone), '') || ']}}' as page from j group by file, page_idx)
select file, '{{"pdf_info":[' || string_agg(page, ',' order by page_idx) || '],"_backend":"office","_version_name":"1.0.0"}}' as middle_json from p group by file"""
RELATIONSHIPS = """with p as (select doc_id as d, (len(string_split(text, chr(10))) + 3) // 4 as n from documents)
select 'f' || d || '.docx' as file, 'word/document.xml' as base_part, rel_id, target, target_part from p, (values ('rId1', 'media/i.png', 'word/media/i.png'), ('rId2', 'http://a/b c', null)) t(rel_id, target, target_part) where d % 3 = 0
union all select 'f' || d || '.pptx', 'ppt/presentation.xml', 'rId' || i, 'slides/slide' || i || '.xml', 'ppt/slides/slide' || i || '.xml' from (select d, unnest(range(1, n + 1)) as i from p where d % 3 = 1)
union all select 'f' || d || '.pptx', 'ppt/slides/slide1.xml', 'rId1', '../notesSlides/n1.xml', 'ppt/notesSlides/n1.xml' from p where d % 3 = 1
union all select 'f' || d || '.xlsx', 'xl/workbook.xml', 'rId' || i, 'worksheets/sheet' || i || '.xml', 'xl/worksheets/sheet' || i || '.xml' from p, (values (1), (2)) t(i) where d % 3 = 2"""
# a list of types and parts in each package; relationship parts have a type of their own that is not declared
PARTS = """with p as (select doc_id % 3 as m, (len(string_split(text, chr(10))) + 3) // 4 as n from documents)
select content_type, cast(sum(c) as bigint) as n from (select 'image/png' as content_type, 1 as c from p where m = 0 union all select null, case m when 1 then 2 else 1 end from p union all select 'application/xml', case m when 0 then 2 when 1 then 3 + n else 5 end from p) group by content_type"""
RESULT_JSON = """with d as (select doc_id // 4 as task_id, 'd' || doc_id as stem, '"d' || doc_id || '":{"md_content":' || to_json(text) || ',"middle_json":' || to_json('{"lang":"' || lang || '"}') || '}' as one from documents)
select task_id, '{"backend":"vlm","version":"1.0.0","results":{' || string_agg(one, ',' order by stem) || '}}' as body from d group by task_id"""

QUERIES = {f.__name__: f for f in (ooxml_blocks, ooxml_markdown, ooxml_content_list, ooxml_content_list_v2, ooxml_middle_json, ooxml_parts, ooxml_relationships, ooxml_elements, zip_manifest, result_json, original_names, stream_ingest, task_states, task_state_stream, task_lifecycle)}
SQL = {
    "ooxml_blocks": BLOCKS_SQL,
    "ooxml_markdown": MARKDOWN_SQL,
    "ooxml_content_list": CONTENT_LIST,
    "ooxml_content_list_v2": CONTENT_LIST_V2,
    "ooxml_middle_json": OFFICE_MIDDLE,
    "ooxml_relationships": RELATIONSHIPS,
    "ooxml_parts": PARTS,
    "result_json": RESULT_JSON,
    "zip_manifest": ZIP_SQL,
    "original_names": "select c_custkey, case c_custkey % 5 when 0 then 's' || c_custkey || '_origin.pdf' when 1 then 's' || c_custkey || '_origin.pdf' when 2 then 's' || c_custkey || '_origin.docx' when 3 then 's' || c_custkey || '_origin.xlsx' end as name from customer",
    "stream_ingest": "select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    "task_states": STATES_SQL,
    "task_state_stream": STATE_STREAM,
    "task_lifecycle": LIFECYCLE,
}
