"""Queries of layout, structure, tables, tasks and Office rules, with their DuckDB forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import layout, office, render, structure, tables, tasks
from ..session import once, saved
from ..sources import config
from . import inputs
from .inputs import derived, table
from .text_queries import d_escape, d_trim

PAGE = ["doc", "page_idx"]
_q = lambda xs: ", ".join(f"'{x}'" for x in xs)
ALLOWED, CHILDREN, MAINS = _q(layout.TYPES), _q(structure.CHILD), _q(structure.MAIN)

# -- layout ---------------------------------------------------------------------------------------------------------


def _layouts(spark, sf_dir):
    """One layout string for each page, from the segments in their order."""
    seg = F.concat(
        F.lit("<|box_start|>"), F.concat_ws(" ", *[F.col(c).cast("string") for c in ("a1", "b1", "a2", "b2")]), F.lit("<|box_end|><|ref_start|>"), "type", F.lit("<|ref_end|>"),
        F.when(F.col("rotation") != "", F.concat(F.lit("<|rotate_"), "rotation", F.lit("|>"))).otherwise(F.lit("")), F.when(F.col("contd") == 1, F.lit(" txt_contd_tgt\n")).otherwise(F.lit("\n")),
    )
    rows = derived(spark, sf_dir, inputs.SEGMENTS).withColumn("s", seg)
    return rows.groupBy(*PAGE, "point_w", "point_h").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "s"))), lambda x: x["s"]), "").alias("layout"))


def _parsed(spark, sf_dir):
    return layout.parse(_layouts(spark, sf_dir))


def layout_parse(spark, sf_dir):
    return _parsed(spark, sf_dir).drop("point_w", "point_h")


_UNIT = lambda a: f"cast(cast({a} as double) / 1000 as float)"
PARSED = f"""select doc, page_idx, point_w, point_h, cast(row_number() over (partition by doc, page_idx order by seg) - 1 as int) as block_index, case when type = 'unknown' then 'image' else type end as type,
{_UNIT("least(a1, a2)")} as x1, {_UNIT("least(b1, b2)")} as y1, {_UNIT("greatest(a1, a2)")} as x2, {_UNIT("greatest(b1, b2)")} as y2,
case rotation when 'up' then 0 when 'right' then 90 when 'down' then 180 end as angle, case when type = 'text' then contd = 1 end as merge_prev
from ({inputs.SEGMENTS}) s where type in ({ALLOWED}) and greatest(a1, a2, b1, b2) <= 1000 and a1 <> a2 and b1 <> b2"""


def layout_types_filter(spark, sf_dir):
    return _parsed(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"))


def bbox_points(spark, sf_dir):
    return layout.to_points(_parsed(spark, sf_dir)).select(*PAGE, "block_index", "x1", "y1", "x2", "y2")


_POINT = lambda c, s: f"cast(floor(cast({c} as double) * {s}) as bigint)"
POINTS = f"""select doc, page_idx, point_w, point_h, block_index, {_POINT("x1", "point_w")} as x1, {_POINT("y1", "point_h")} as y1, {_POINT("x2", "point_w")} as x2, {_POINT("y2", "point_h")} as y2 from ({PARSED}) p"""


def bbox_thousandths(spark, sf_dir):
    return layout.to_thousandths(layout.to_points(_parsed(spark, sf_dir))).select(*PAGE, "block_index", "x1", "y1", "x2", "y2")


def crop_boxes(spark, sf_dir):
    rows = layout.to_points(_parsed(spark, sf_dir))
    box = layout.crop_box(F.lit(1700), F.lit(2200), F.col("point_w"), F.col("point_h"), [F.col(c) for c in structure.BOX])
    return rows.select(*PAGE, "block_index", *[c.alias(n) for c, n in zip(box, structure.BOX, strict=True)])


_CROP = {"lo": "cast(greatest(floor(cast({c} as float) * (cast({p} as float) / cast({s} as float))), 0) as bigint)", "hi": "cast(least(ceil(cast({c} as float) * (cast({p} as float) / cast({s} as float))), {p}) as bigint)"}
CROPS = "select doc, page_idx, block_index, " + ", ".join(_CROP[k].format(c=c, p=p, s=s) + f" as {c}" for k, c, p, s in (("lo", "x1", 1700, "point_w"), ("lo", "y1", 2200, "point_h"), ("hi", "x2", 1700, "point_w"), ("hi", "y2", 2200, "point_h"))) + f" from ({POINTS}) p where x2 > x1 and y2 > y1"


def skip_extract(spark, sf_dir):
    rows = layout.extract_jobs(_parsed(spark, sf_dir))
    return rows.groupBy("type").agg(F.count("*").alias("with_images"), F.count_if(~F.col("type").isin(*layout.SKIPPED_IMAGES)).alias("without_images"))


def page_windows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("n_chars") / 1500).alias("n_pages"))
    rows = layout.page_windows(docs, "n_pages", F.col("doc_id") % 3, F.lit(99_999), 8)
    return rows.groupBy("doc_id", "window_id").agg(F.min("page_idx").alias("first_page"), F.max("page_idx").alias("last_page"))


# -- structure ------------------------------------------------------------------------------------------------------


def _processed(spark, sf_dir):
    return structure.post_process(derived(spark, sf_dir, inputs.BLOCKS))


def _blocks(spark, sf_dir):
    """The table of typed blocks, written once for all queries of a session: the structure rules read it several times."""
    return once(spark, "blocks", sf_dir, lambda: structure.to_blocks(_processed(spark, sf_dir), PAGE))


def post_process(spark, sf_dir):
    return _processed(spark, sf_dir).select(*PAGE, "idx", "type", "content")


POST = f"""select doc, page_idx, idx, type, case when type in ('image', 'chart') then case when contains(content, '<fcel>') then '' else {d_trim("content")} end
when type = 'equation' then case when starts_with(e, chr(92) || '[') then case when ends_with(e, chr(92) || ']') then e else e || chr(10) || chr(92) || ']' end else case when ends_with(chr(92) || '[' || chr(10) || e, chr(92) || ']') then chr(92) || '[' || chr(10) || e else chr(92) || '[' || chr(10) || e || chr(10) || chr(92) || ']' end end when type = 'table' then '<table><tr><td>' || pk || ' &amp; &lt;b</td><td>two</td></tr><tr><td></td><td>x&quot;y</td></tr></table>' else content end as content
from (select doc, page_idx, idx, pk, case when type = 'list_item' then 'text' else type end as type, content, {d_trim(f"case when ends_with(case when starts_with({d_trim('content')}, chr(92) || '[') then substr({d_trim('content')}, 3) else {d_trim('content')} end, chr(92) || ']') then left(case when starts_with({d_trim('content')}, chr(92) || '[') then substr({d_trim('content')}, 3) else {d_trim('content')} end, length(case when starts_with({d_trim('content')}, chr(92) || '[') then substr({d_trim('content')}, 3) else {d_trim('content')} end) - 2) else {d_trim('content')} end")} as e from ({inputs.BLOCKS}) b where type <> 'equation_block') q"""

_TYPE = "case type " + " ".join(f"when '{k}' then '{v}'" for k, v in structure.BLOCK_TYPE.items()) + " when 'list_item' then 'text' else type end"
TYPED = f"select *, cast(row_number() over (partition by doc, page_idx order by idx) - 1 as int) as pos from (select doc, page_idx, idx, {_TYPE} as type, x1, y1, x2, y2, merge_prev from ({inputs.BLOCKS}) b where type <> 'equation_block') q"


def type_histogram(spark, sf_dir):
    return _blocks(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"), F.sum(F.size("spans")).alias("n_spans"))


def caption_parents(spark, sf_dir):
    return structure.visual_parents(_blocks(spark, sf_dir), PAGE)


_GAP = "greatest(m.x1 - c.x2, c.x1 - m.x2, 0) + greatest(m.y1 - c.y2, c.y1 - m.y2, 0)"
PARENTS = f"""with b as ({TYPED}), pairs as (select c.doc, c.page_idx, c.idx, m.idx as m, row_number() over (partition by c.doc, c.page_idx, c.idx order by abs(m.pos - c.pos), {_GAP}, m.idx) as rn
from b c join b m on c.doc = m.doc and c.page_idx = m.page_idx and m.type in ({MAINS}) where c.type in ({CHILDREN}) and not (c.type = 'footnote' and c.idx < m.idx)
and not exists (select 1 from b k where k.doc = c.doc and k.page_idx = c.page_idx and k.pos > least(c.pos, m.pos) and k.pos < greatest(c.pos, m.pos) and not (k.type = 'caption' or (k.type = 'footnote' and c.type = 'footnote'))))
select b.doc, b.page_idx, b.idx, b.type, p.m as parent_idx from b left join pairs p on b.doc = p.doc and b.page_idx = p.page_idx and b.idx = p.idx and p.rn = 1 where b.type in ({CHILDREN})"""


def caption_unmatched(spark, sf_dir):
    return caption_parents(spark, sf_dir).where("parent_idx is null").groupBy("type").agg(F.count("*").alias("n"))


def list_contains_items(spark, sf_dir):
    return structure.list_items(_blocks(spark, sf_dir), PAGE)


_OVER = "case when least(i.x2, l.x2) <= greatest(i.x1, l.x1) or least(i.y2, l.y2) <= greatest(i.y1, l.y1) then 0.0 else cast((least(i.x2, l.x2) - greatest(i.x1, l.x1)) * (least(i.y2, l.y2) - greatest(i.y1, l.y1)) as double) / (greatest(i.x2 - i.x1, 1) * greatest(i.y2 - i.y1, 1)) end"
LISTS = f"""select i.doc, i.page_idx, i.idx, min(l.idx) as list_idx from ({TYPED}) i join ({TYPED}) l on i.doc = l.doc and i.page_idx = l.page_idx and l.type = 'list' where i.type in ('text', 'ref_text') and {_OVER} >= 0.8 group by 1, 2, 3"""


def list_mode_type(spark, sf_dir):
    rows = _blocks(spark, sf_dir)
    return structure.list_kinds(structure.list_items(rows, PAGE).join(rows.select(*PAGE, "idx", "type"), [*PAGE, "idx"]), PAGE)


LIST_MODE = f"""with c as (select l.doc, l.page_idx, l.list_idx, t.type, count(*) as n, min(l.idx) as f from ({LISTS}) l join ({TYPED}) t on l.doc = t.doc and l.page_idx = t.page_idx and l.idx = t.idx group by 1, 2, 3, 4),
r as (select *, row_number() over (partition by doc, page_idx, list_idx order by n desc, f) as rn, cast(sum(n) over (partition by doc, page_idx, list_idx) as bigint) as n_items from c)
select doc, page_idx, list_idx, type as sub_type, n_items from r where rn = 1"""


def merge_prev_paragraphs(spark, sf_dir):
    return structure.merge_previous(_blocks(spark, sf_dir), PAGE).select(*PAGE, "idx", "group_idx")


MERGE = f"""with t as (select doc, page_idx, idx, case when not coalesce(merge_prev, false) or row_number() over (partition by doc, page_idx order by idx) = 1 then idx end as s from ({TYPED}) b where type = 'text')
select doc, page_idx, idx, (select max(u.s) from t u where u.doc = t.doc and u.page_idx = t.page_idx and u.idx <= t.idx) as group_idx from t"""


def _assembled(spark, sf_dir):
    return once(spark, "assembled blocks", sf_dir, lambda: structure.assemble(_blocks(spark, sf_dir), PAGE))


def _sized(blocks):
    return blocks.withColumn("point_w", F.lit(1003)).withColumn("point_h", F.lit(1001))


def assembled(spark, sf_dir):
    return _sized(_assembled(spark, sf_dir))


def visual_groups(spark, sf_dir):
    """Children of each visual block, by their role."""
    rows = _assembled(spark, sf_dir).where(F.col("type").isin("image", "table", "chart", "code"))
    return rows.select(*PAGE, "idx", F.posexplode("children").alias("place", "c")).select(*PAGE, "idx", "place", F.col("c.idx").alias("child_idx"), F.col("c.type").alias("role"))


GROUPS = f"""with b as ({TYPED}), p as ({PARENTS}), v as (select doc, page_idx, idx, case type when 'image_block_body' then 'image' else replace(type, '_body', '') end as k from b where type in ({MAINS})),
c as (select doc, page_idx, idx, idx as child_idx, k || '_body' as role from v union all select v.doc, v.page_idx, v.idx, p.idx, v.k || '_' || p.type from v join p on p.doc = v.doc and p.page_idx = v.page_idx and p.parent_idx = v.idx)
select doc, page_idx, idx, cast(row_number() over (partition by doc, page_idx, idx order by child_idx) - 1 as int) as place, child_idx, role from c"""


def top_level_counts(spark, sf_dir):
    return _assembled(spark, sf_dir).groupBy("type", "discarded").agg(F.count("*").alias("n"), F.sum(F.size("lines")).alias("n_lines"), F.sum(F.size("children")).alias("n_children"))


TOP = f"""with b as ({TYPED}), p as ({PARENTS}), t as (select b.doc, b.page_idx, b.idx, b.x1, b.y1, b.x2, b.y2, case when b.type in ({CHILDREN}) and p.parent_idx is null then 'text' else b.type end as type, b.merge_prev, p.parent_idx as v from b left join p on b.doc = p.doc and b.page_idx = p.page_idx and b.idx = p.idx),
l as (select i.doc, i.page_idx, i.idx, min(l.idx) as list_idx from t i join t l on i.doc = l.doc and i.page_idx = l.page_idx and l.type = 'list' where i.type in ('text', 'ref_text') and {_OVER} >= 0.8 group by 1, 2, 3),
k as (select t.*, l.list_idx from t left join l on t.doc = l.doc and t.page_idx = l.page_idx and t.idx = l.idx),
n as (select doc, page_idx, owner, count(*) as n from (select doc, page_idx, coalesce(case when type in ({MAINS}) then idx end, v, list_idx) as owner from k) q where owner is not null group by 1, 2, 3)
select type, discarded, count(*) as n, cast(sum(n_lines) as bigint) as n_lines, cast(sum(n_children) as bigint) as n_children from (
select case k.type when 'image_body' then 'image' when 'image_block_body' then 'image' when 'table_body' then 'table' when 'chart_body' then 'chart' when 'code_body' then 'code' else k.type end as type, k.type in ({_q(structure.DISCARDED)}) as discarded,
case when k.type in ({MAINS}, 'list') then 0 else 1 end as n_lines, coalesce(n.n, 0) as n_children from k left join n on k.doc = n.doc and k.page_idx = n.page_idx and k.idx = n.owner where k.v is null and k.list_idx is null and (k.type <> 'list' or n.n > 0)) z group by 1, 2"""


def content_list_v1(spark, sf_dir):
    return render.content_list_v1(assembled(spark, sf_dir), "page_idx").where("item is not null").select(*PAGE, "idx", "discarded", "item")


def content_list_v2(spark, sf_dir):
    return render.content_list_v2(assembled(spark, sf_dir)).where("item is not null").select(*PAGE, "idx", "discarded", "item")


def content_list_boxes(spark, sf_dir):
    """The parts of the flat content list that have a fixed form: kind, level, box of every entry."""
    rows = render.content_list_v1(assembled(spark, sf_dir), "page_idx").where("item is not null")
    get = lambda p: F.get_json_object("item", p)
    return rows.select(*PAGE, "idx", get("$.type").alias("kind"), get("$.text_level").cast("int").alias("level"), get("$.text_format").alias("format"), get("$.bbox[0]").cast("long").alias("bx1"), get("$.bbox[3]").cast("long").alias("by2"))


CONTENT_BOXES = TOP[: TOP.index("select type, discarded")] + """select k.doc, k.page_idx, k.idx, case k.type when 'title' then 'text' when 'interline_equation' then 'equation' when 'image_block_body' then 'image' else replace(k.type, '_body', '') end as kind,
case when k.type = 'title' then 1 end as level, case when k.type = 'interline_equation' then 'latex' end as format, k.x1 * 1000 // 1003 as bx1, k.y2 * 1000 // 1001 as by2
from k left join n on k.doc = n.doc and k.page_idx = n.page_idx and k.idx = n.owner where k.v is null and k.list_idx is null and (k.type <> 'list' or n.n > 0)"""


def page_markdown(spark, sf_dir):
    return render.markdown(assembled(spark, sf_dir), ["doc"], ["page_idx", "idx"])


def markdown_segments(spark, sf_dir):
    """The Markdown of each document in segments: place, offset and size of each, and their text."""
    return render.markdown_segments(assembled(spark, sf_dir), ["doc"], ["page_idx", "idx"], 2_000)


def middle_json(spark, sf_dir):
    """Its rows are as wide as all blocks together, so they are put together where the document's narrow raw blocks were dealt to, without tables or exchanges in between."""
    # a number of parts: rows become many times as wide, so parts must not be put together by their present size
    raw = derived(spark, sf_dir, inputs.BLOCKS).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc")
    return render.middle_json(_sized(structure.assemble(structure.to_blocks(structure.post_process(raw), PAGE), PAGE)), PAGE, ["doc"], "page_idx")


def model_json(spark, sf_dir):
    return render.model_json(_parsed(spark, sf_dir)).select(*PAGE, "block_index", "item")


# -- sheets ---------------------------------------------------------------------------------------------------------


def _grid(spark, sf_dir):
    return tables.trim_grid(derived(spark, sf_dir, inputs.CELLS), ["sheet"])


def _full_grid(spark, sf_dir):
    """Every place of the box, so that blank cells are cells as well."""
    grid = _grid(spark, sf_dir)
    boxes = grid.select("sheet", "r0", "r1", "c0", "c1", "filled").distinct()
    places = boxes.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("r1") - F.col("r0")))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("c1") - F.col("c0"))))
    return places.join(grid.select("sheet", "row", "col", "text"), ["sheet", "row", "col"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def sheet_trim(spark, sf_dir):
    return _grid(spark, sf_dir).select("sheet", "row", "col", "text", "filled")


SHEET = f"""with c as ({inputs.CELLS}), b as (select sheet, min("row") as r0, max("row") as r1, min("col") as c0, max("col") as c1, count(*) as filled from c where {d_trim('"text"')} <> '' group by sheet)"""
SHEET_TRIM = SHEET + """ select c.sheet, c."row" - r0 as "row", c."col" - c0 as "col", c."text" as "text", filled from c join b using (sheet) where c."row" between r0 and r1 and c."col" between c0 and c1"""


def sheet_merge_spans(spark, sf_dir):
    grid = _full_grid(spark, sf_dir)
    merges = tables.rebase_merges(derived(spark, sf_dir, inputs.MERGES), grid, ["sheet"])
    return tables.sheet_cells(grid, merges, ["sheet"]).select("sheet", "row", "col", "rowspan", "colspan", "text")


_MERGED = f"""{SHEET}, m as (select sheet, m_r0 - r0 as m_r0, m_c0 - c0 as m_c0, least(m_r1, r1) - r0 as m_r1, least(m_c1, c1) - c0 as m_c1 from ({inputs.MERGES}) q join b using (sheet) where m_r0 >= r0 and m_c0 >= c0 and m_r0 <= r1 and m_c0 <= c1 and (least(m_r1, r1) > m_r0 or least(m_c1, c1) > m_c0)),
g as (select b.sheet, cast(r.r as int) as "row", cast(k.k as int) as "col", coalesce(c."text", '') as "text", filled, r1 - r0 as last from b cross join range(0, 20) r(r) cross join range(0, 20) k(k) left join c on c.sheet = b.sheet and c."row" = r.r + r0 and c."col" = k.k + c0 where r.r <= r1 - r0 and k.k <= c1 - c0),
f as (select g.*, coalesce(a.m_r1 - a.m_r0 + 1, 1) as rowspan, coalesce(a.m_c1 - a.m_c0 + 1, 1) as colspan from g left join m a on a.sheet = g.sheet and a.m_r0 = g."row" and a.m_c0 = g."col" where not exists (select 1 from m where m.sheet = g.sheet and g."row" between m_r0 and m_r1 and g."col" between m_c0 and m_c1 and not (g."row" = m_r0 and g."col" = m_c0)))"""
MERGE_SPANS = _MERGED + ' select sheet, "row", "col", rowspan, colspan, "text" from f'


def sheet_html(spark, sf_dir):
    grid = _full_grid(spark, sf_dir)
    cells = tables.sheet_cells(grid, tables.rebase_merges(derived(spark, sf_dir, inputs.MERGES), grid, ["sheet"]), ["sheet"])
    return tables.grid_html(cells.withColumn("sheet", F.col("sheet").cast("string")), ["sheet"], "sheet")


SHEET_HTML = f"""{_MERGED}, t as (select sheet, "row", filled, string_agg('<td' || case when rowspan > 1 then ' rowspan="' || rowspan || '"' else '' end || case when colspan > 1 then ' colspan="' || colspan || '"' else '' end || '>' || {d_escape('"text"')} || '</td>', '' order by "col") as tds from f group by 1, 2, 3),
r as (select b.sheet, filled, cast(r.r as int) as "row" from b cross join range(0, 20) r(r) where r.r <= r1 - r0)
select cast(r.sheet as varchar) as sheet, r.filled, '<table><caption>' || r.sheet || '</caption>' || string_agg('<tr>' || coalesce(tds, '') || '</tr>', '' order by r."row") || '</table>' as html from r left join t on t.sheet = r.sheet and t."row" = r."row" group by 1, 2, r.sheet"""

# -- tasks ----------------------------------------------------------------------------------------------------------
NOW = "1998-07-01 00:00:00"


def _tasks(spark, sf_dir):
    return derived(spark, sf_dir, inputs.TASKS)


def task_status_counts(spark, sf_dir):
    return tasks.status_counts(_tasks(spark, sf_dir), ["backend"])


def queued_ahead(spark, sf_dir):
    return tasks.queued_ahead(_tasks(spark, sf_dir)).select("task_id", "queued_ahead")


QUEUED = f"""with t as ({inputs.TASKS}) select task_id, case when status = 'pending' then coalesce(sum(case when status = 'pending' and submit_order > 0 then 1 else 0 end) over (order by submit_order rows between unbounded preceding and 1 preceding), 0) else 0 end :: bigint as queued_ahead from t"""


def retention_expired(spark, sf_dir):
    return tasks.expired(_tasks(spark, sf_dir), F.lit(NOW), 1000 * 86_400).select("task_id", "status")


def retention_sweep(spark, sf_dir):
    return tasks.sweep(_tasks(spark, sf_dir), F.lit(NOW), 1000 * 86_400).groupBy("status").agg(F.count("*").alias("n"))


_EXPIRED = f"status in ('completed', 'failed') and active_readers = 0 and completed_at is not null and epoch(timestamp '{NOW}') - epoch(completed_at) >= {1000 * 86_400}"


def status_payload(spark, sf_dir):
    return tasks.status_payload(_tasks(spark, sf_dir), "http://localhost").select("task_id", "created_at", "completed_at", "status_url", "result_url")


PAYLOAD = f"select task_id, strftime(created_at, '%Y-%m-%dT%H:%M:%S+00:00') as created_at, strftime(completed_at, '%Y-%m-%dT%H:%M:%S+00:00') as completed_at, 'http://localhost/tasks/' || task_id as status_url, 'http://localhost/tasks/' || task_id || '/result' as result_url from ({inputs.TASKS}) t"

UPLOADS = """SELECT CAST(floor(c_custkey / 50.0) AS BIGINT) AS task_id, c_custkey AS idx, concat('../up/', CASE c_custkey % 3 WHEN 0 THEN 'Report' WHEN 1 THEN 'report' ELSE concat('n', CAST(c_nationkey AS VARCHAR(20))) END, CASE c_custkey % 5 WHEN 0 THEN '.PDF' WHEN 1 THEN '.docx' WHEN 2 THEN '.tar.gz' WHEN 3 THEN '' ELSE '.jp2' END) AS name FROM customer"""


def suffix_gate(spark, sf_dir):
    return tasks.gate(derived(spark, sf_dir, UPLOADS)).select("idx", "base_name", "stem", "suffix", "kind", "output_dir", "accepted")


GATE = f"""select idx, b as base_name, case when contains(b, '.') then regexp_replace(b, '\\.[^.]*$', '') else b end as stem, s as suffix, k as kind, case when k = 'office' then 'office' when k is not null then 'vlm' end as output_dir, k is not null as accepted from (
select *, case when s = 'pdf' then 'pdf' when s in ({_q(tasks.KINDS['image'])}) then 'image' when s in ({_q(tasks.KINDS['office'])}) then 'office' end as k from (
select idx, regexp_extract(name, '[^/]*$') as b, case when contains(regexp_extract(name, '[^/]*$'), '.') then lower(regexp_extract(name, '[^.]*$')) else '' end as s from ({UPLOADS}) u) v) w"""


def stem_uniquify(spark, sf_dir):
    rows = tasks.gate(derived(spark, sf_dir, UPLOADS)).select("task_id", "idx", "stem")
    return tasks.uniquify(rows, ["task_id"]).select("idx", "unique_stem")


UNIQUE = f"""with s as (select task_id, idx, case when contains(b, '.') then regexp_replace(b, '\\.[^.]*$', '') else b end as stem from (select task_id, idx, regexp_extract(name, '[^/]*$') as b from ({UPLOADS}) u) v),
n as (select *, row_number() over (partition by task_id, lower(stem) order by idx) as n from s) select idx, case when n = 1 then stem else stem || '_' || n end as unique_stem from n"""


#: Stems of which many are others with a number behind them.
NUMBERED = """SELECT CAST(floor(c_custkey / 40.0) AS BIGINT) AS task_id, c_custkey AS idx, concat(CASE c_custkey % 5 WHEN 0 THEN 'Scan' WHEN 1 THEN 'scan' WHEN 2 THEN 'a' WHEN 3 THEN 'scan_2' ELSE 'A_3' END, CASE c_nationkey % 6 WHEN 0 THEN '_2' WHEN 1 THEN '_4' ELSE '' END) AS stem FROM customer"""


def stem_uniquify_exact(spark, sf_dir):
    return tasks.uniquify_exactly(derived(spark, sf_dir, NUMBERED), "task_id").select("idx", "unique_stem")


EXACT = f"""with s as ({NUMBERED}), n as (select *, row_number() over (partition by task_id, lower(stem) order by idx) - 1 as k from s),
free as (select task_id, stem, row_number() over (partition by task_id, stem order by m) as k, m from (select distinct task_id, lower(stem) as stem from s) q, range(2, 100) r(m) where not exists (select 1 from s where s.task_id = q.task_id and lower(s.stem) = q.stem || '_' || r.m))
select idx, case when n.k = 0 then n.stem else n.stem || '_' || free.m end as unique_stem from n left join free on free.task_id = n.task_id and free.stem = lower(n.stem) and free.k = n.k"""


def boolean_parse(spark, sf_dir):
    raw = F.element_at(F.array(*map(F.lit, (" TRUE ", "1", "off", "No", "maybe", "yes", "0", ""))), (F.col("c_custkey") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", tasks.parse_boolean(raw).alias("flag"))


def option_validation(spark, sf_dir):
    pick = lambda xs, k: F.element_at(F.array(*map(F.lit, xs)), (F.col("c_custkey") % len(xs) + 1).cast("int")).alias(k)
    rows = table(spark, sf_dir, "customer").select("c_custkey", pick(("auto", "txt", "bad"), "parse_method"), pick(("vlm-http-client", "vllm-http-client", "pipeline", "vlm-http-client"), "backend"), F.col("c_nationkey").alias("start_page_id"), (F.col("c_custkey") % 40).alias("end_page_id"), (F.col("c_custkey") % 7).alias("n_files"))
    return tasks.option_errors(rows).select("c_custkey", "backend", "error")


OPTIONS = """select c_custkey, case when c_custkey % 4 = 2 then 'pipeline' else 'vlm-http-client' end as backend, case when c_custkey % 7 < 1 then 'At least one file is required' when c_custkey % 3 = 2 then 'Invalid parse_method. Allowed values: auto, ocr, txt'
when c_custkey % 4 = 2 then 'Unsupported backend: pipeline' when c_custkey % 40 < c_nationkey then 'end_page_id must be greater than or equal to start_page_id' end as error from customer"""

def health_snapshot(spark, sf_dir):
    """One row: tasks by status and the service's limits."""
    limits = config.load({})
    return tasks.health(_tasks(spark, sf_dir), {"max_concurrent_tasks": limits.max_concurrent_tasks, "page_window": limits.page_window, "model_queue": limits.queue_size})


def readable_results(spark, sf_dir):
    """Tasks with a reader's lease; the leases hold some tasks twice."""
    every = _tasks(spark, sf_dir)
    leases = every.where("active_readers > 1").select("task_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("reader"))
    return tasks.readable(every, leases).groupBy("status").agg(F.count("*").alias("n"))


def upload_zip(spark, sf_dir):
    """Names and suffixes of a task, which come as lists, as rows by place."""
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("idx", c))), lambda x: x[c]).alias(c)
    lists = tasks.gate(derived(spark, sf_dir, UPLOADS)).groupBy("task_id").agg(in_order("stem"), in_order("suffix"))
    return lists.select("task_id", F.posexplode(F.arrays_zip("stem", "suffix")).alias("place", "u")).select("task_id", "place", "u.stem", "u.suffix")


def image_formats(spark, sf_dir):
    """Format by magic bytes, held against content type and extension."""
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("doc_id") % len(xs) + 1).cast("int"))
    magic = pick(("FFD8FF00", "89504E470D0A1A0A", "474946383961", "424D00", "524946460000000057454250", "3C7376673E", "00"))
    name = F.concat(F.lit("image."), pick(("jpg", "png", "gif", "png", "webp", "svg", "png")))
    raw = F.concat(F.unhex(magic), F.encode("text", "utf-8"))
    kind = F.when(F.col("doc_id") % 3 == 0, F.lit("image/PNG; q=1"))
    return table(spark, sf_dir, "documents").select("doc_id", text.raster_format(name, kind, raw).alias("format"))


# -- packages, slides, styles ---------------------------------------------------------------------------------------


def rel_lookup(spark, sf_dir):
    """Nations as references, regions as targets; every id has two relationships, of which the first counts."""
    rels = table(spark, sf_dir, "region").select(F.lit("word/document.xml").alias("base_part"), F.concat(F.lit("rId"), F.col("r_regionkey")).alias("rel_id"), F.explode(F.array(F.lit(1), F.lit(0))).alias("ord"), F.col("r_name"))
    rels = rels.withColumn("target", F.concat("r_name", F.col("ord").cast("string"))).withColumn("target_mode", F.when(F.col("ord") == 1, F.lit("External")))
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.lit("word/document.xml").alias("base_part"), F.concat(F.lit("rId"), F.col("n_regionkey") + F.when(F.col("n_nationkey") % 6 == 0, 10).otherwise(0)).alias("rel_id"))
    return office.lookup_relationship(rows, rels).select("n_nationkey", "rel_id", "target", "target_mode")


def part_paths(spark, sf_dir):
    target = F.element_at(F.array(*map(F.lit, ("media/image1.png", "../media/image1.png", "/docProps/core.xml", "./a/../b.xml", "../../../x"))), (F.col("n_nationkey") % 5 + 1).cast("int"))
    base = F.when(F.col("n_nationkey") % 2 == 0, F.lit("word/document.xml")).otherwise(F.lit("ppt/slides/slide1.xml"))
    return table(spark, sf_dir, "nation").select("n_nationkey", office.resolve_part(base, target).alias("part"), office.rels_path(base).alias("rels_part"))


PATHS = """select n_nationkey, case n_nationkey % 5 when 0 then d || '/media/image1.png' when 1 then p || 'media/image1.png' when 2 then 'docProps/core.xml' when 3 then d || '/b.xml' else 'x' end as part, d || '/_rels/' || f || '.rels' as rels_part
from (select n_nationkey, case when n_nationkey % 2 = 0 then 'word' else 'ppt/slides' end as d, case when n_nationkey % 2 = 0 then '' else 'ppt/' end as p, case when n_nationkey % 2 = 0 then 'document.xml' else 'slide1.xml' end as f from nation) q"""


def content_type_lookup(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("p/"), F.col("p_partkey"), F.lit("."), F.element_at(F.array(*map(F.lit, ("xml", "PNG", "bin"))), (F.col("p_partkey") % 3 + 1).cast("int"))).alias("part_name"))
    by_part = parts.where("part_name like '%7.%'").select("part_name", F.lit("own/type").alias("content_type"))
    by_ext = spark.createDataFrame([("xml", "application/xml"), ("png", "image/png")], "extension string, content_type string")
    return office.content_types(parts, by_part, by_ext)


CONTENT_TYPES = """select 'p/' || p_partkey || '.' || ['xml', 'PNG', 'bin'][p_partkey % 3 + 1] as part_name, case when p_partkey % 10 = 7 then 'own/type' else ['application/xml', 'image/png', null][p_partkey % 3 + 1] end as content_type from part"""


def style_closure(spark, sf_dir):
    """Parts as styles, each based on the one of half its key; the first two are based on each other."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("style_id"), F.when(F.col("p_partkey") == 1, F.lit(2)).otherwise(F.floor(F.col("p_partkey") / 2)).alias("based_on"), F.when(F.col("p_partkey") % 7 == 0, F.col("p_size")).alias("level"), (F.col("p_partkey") % 97 == 0).alias("is_list"))
    return office.resolve_styles(rows)


STYLES = """with recursive s as (select p_partkey as id, case when p_partkey = 1 then 2 else p_partkey // 2 end as b, case when p_partkey % 7 = 0 then p_size end as l, p_partkey % 97 = 0 as i from part),
c as (select id, id as at, b, l, i, 0 as d from s union all select c.id, s.id, s.b, s.l, s.i, c.d + 1 from c join s on s.id = c.b where c.d < 200)
select id as style_id, arg_min(l, d) filter (where l is not null) as level, bool_or(i) as is_list from c group by id"""


_SHAPES = """SELECT l_orderkey AS slide, l_linenumber AS seq, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE (l_partkey % 9) * 50000 END AS y, CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE (l_suppkey % 7) * 60000 END AS x,
CASE l_partkey % 6 WHEN 0 THEN 91440 WHEN 1 THEN 9144000 ELSE 400000 END AS w, CASE l_partkey % 6 WHEN 0 THEN 91440 WHEN 1 THEN 5143500 ELSE 91441 END AS h FROM lineitem"""


def slide_order(spark, sf_dir):
    from pyspark.sql import Window

    rows = derived(spark, sf_dir, _SHAPES)
    return rows.select("slide", "seq", F.row_number().over(Window.partitionBy("slide").orderBy(*office.slide_order())).alias("place"))


SLIDES = f"select slide, seq, cast(row_number() over (partition by slide order by y nulls last, case when y is not null then x end nulls last, seq) as int) as place from ({_SHAPES}) q"


def decor_filter(spark, sf_dir):
    rows = derived(spark, sf_dir, _SHAPES)
    return rows.where(~office.is_decoration(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.lit(9_144_000), F.lit(5_143_500))).groupBy("w", "h").agg(F.count("*").alias("n"))


DECOR = f"select w, h, count(*) as n from ({_SHAPES}) q where not (w <= 91440 and h <= 91440) and not coalesce(abs(x) * 100 <= 9144000 and abs(y) * 100 <= 5143500 and w * 100 >= 9144000 * 98 and h * 100 >= 5143500 * 98, false) group by 1, 2"


def adjacent_list_merge(spark, sf_dir):
    """Turns of conversations as blocks, assistant turns as lists."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("idx"), F.when(F.col("turn") % 4 > 1, F.lit("list")).otherwise(F.lit("text")).alias("kind"), F.array("text").alias("items"))
    return office.merge_lists(rows, ["conv_id"]).select("conv_id", "idx", "kind", F.array_join("items", "|").alias("items"))


LIST_MERGE = """with r as (select conv_id, turn as idx, case when turn % 4 > 1 then 'list' else 'text' end as kind, text as item from conversations),
s as (select *, case when kind = 'list' and lag(kind) over (partition by conv_id order by idx) = 'list' then 0 else 1 end as s from r), g as (select *, sum(s) over (partition by conv_id order by idx) as g from s)
select conv_id, min(idx) as idx, any_value(kind) as kind, string_agg(item, '|' order by idx) as items from g group by conv_id, g"""


def adjacent_span_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("t")))), lambda x: F.struct(F.when(x["turn"] % 5 > 2, F.lit("a")).otherwise(x["role"]).alias("type"), x["t"].alias("content"))).alias("spans"))
    return rows.select("conv_id", F.posexplode(render.join_adjacent(F.col("spans"))).alias("pos", "s")).select("conv_id", "pos", "s.type", "s.content")


SPAN_MERGE = """with r as (select conv_id, turn, case when turn % 5 > 2 then 'a' else role end as type, text as t from conversations), s as (select *, case when type = lag(type) over (partition by conv_id order by turn) then 0 else 1 end as s from r),
g as (select *, sum(s) over (partition by conv_id order by turn) as g from s) select conv_id, cast(g - 1 as int) as pos, any_value(type) as type, string_agg(t, '' order by turn) as content from g group by conv_id, g"""


QUERIES = {
    f.__name__: f
    for f in (
        layout_parse, layout_types_filter, bbox_points, bbox_thousandths, crop_boxes, skip_extract, page_windows, post_process, type_histogram, caption_parents, caption_unmatched, list_contains_items, list_mode_type,
        merge_prev_paragraphs, visual_groups, top_level_counts, content_list_v1, content_list_v2, content_list_boxes, page_markdown, markdown_segments, middle_json, model_json, sheet_trim, sheet_merge_spans, sheet_html, task_status_counts,
        queued_ahead, retention_expired, retention_sweep, status_payload, suffix_gate, stem_uniquify, stem_uniquify_exact, boolean_parse, option_validation, rel_lookup, part_paths, content_type_lookup, style_closure,
        slide_order, decor_filter, adjacent_list_merge, adjacent_span_merge, health_snapshot, readable_results, upload_zip, image_formats,
    )
}

SQL = {
    "layout_parse": f"select doc, page_idx, block_index, type, x1, y1, x2, y2, angle, merge_prev from ({PARSED}) p",
    "layout_types_filter": f"select type, count(*) as n from ({PARSED}) p group by 1",
    "bbox_points": f"select doc, page_idx, block_index, x1, y1, x2, y2 from ({POINTS}) p where x2 > x1 and y2 > y1",
    "bbox_thousandths": f"select doc, page_idx, block_index, x1 * 1000 // point_w as x1, y1 * 1000 // point_h as y1, x2 * 1000 // point_w as x2, y2 * 1000 // point_h as y2 from ({POINTS}) p where x2 > x1 and y2 > y1",
    "crop_boxes": CROPS,
    "skip_extract": f"select type, count(*) as with_images, count(*) filter (where type not in ('image', 'chart')) as without_images from ({PARSED}) p where type not in ({_q(layout.SKIPPED)}) group by 1",
    "page_windows": "select doc_id, (p - doc_id % 3) // 8 as window_id, min(p) as first_page, max(p) as last_page from (select doc_id, unnest(range(doc_id % 3, n)) as p from (select doc_id, n_chars // 1500 as n from documents) q where n > 0 and doc_id % 3 < n) r group by 1, 2",
    "post_process": POST,
    "caption_parents": PARENTS,
    "caption_unmatched": f"select type, count(*) as n from ({PARENTS}) p where parent_idx is null group by 1",
    "list_contains_items": LISTS,
    "list_mode_type": LIST_MODE,
    "merge_prev_paragraphs": MERGE,
    "visual_groups": GROUPS,
    "content_list_boxes": CONTENT_BOXES,
    "sheet_trim": SHEET_TRIM,
    "sheet_merge_spans": MERGE_SPANS,
    "sheet_html": SHEET_HTML,
    "task_status_counts": "select backend, " + ", ".join(f"count(*) filter (where status = '{s}') as {s}" for s in tasks.STATUSES) + f" from ({inputs.TASKS}) t group by 1",
    "queued_ahead": QUEUED,
    "retention_expired": f"select task_id, status from ({inputs.TASKS}) t where {_EXPIRED}",
    "retention_sweep": f"select status, count(*) as n from ({inputs.TASKS}) t where not coalesce({_EXPIRED}, false) group by 1",
    "status_payload": PAYLOAD,
    "suffix_gate": GATE,
    "stem_uniquify": UNIQUE,
    "stem_uniquify_exact": EXACT,
    "boolean_parse": "select c_custkey, [true, true, false, false, null, true, false, null][c_custkey % 8 + 1] as flag from customer",
    "option_validation": OPTIONS,
    "rel_lookup": "select n_nationkey, 'rId' || (n_regionkey + case when n_nationkey % 6 = 0 then 10 else 0 end) as rel_id, r_name || '0' as target, cast(null as varchar) as target_mode from nation left join region on n_regionkey = r_regionkey and n_nationkey % 6 <> 0",
    "part_paths": PATHS,
    "content_type_lookup": CONTENT_TYPES,
    "style_closure": STYLES,
    "slide_order": SLIDES,
    "decor_filter": DECOR,
    "adjacent_list_merge": LIST_MERGE,
    "adjacent_span_merge": SPAN_MERGE,
    "top_level_counts": TOP,
    "health_snapshot": "select " + ", ".join(f"count(*) filter (where status = '{s}') as {s}" for s in tasks.STATUSES) + f", 3 as max_concurrent_tasks, 8 as page_window, 200 as model_queue from ({inputs.TASKS}) t",
    "readable_results": f"select status, count(*) as n from ({inputs.TASKS}) t where active_readers > 1 group by 1",
    "upload_zip": f"select u.task_id, cast(row_number() over (partition by u.task_id order by u.idx) - 1 as int) as place, g.stem, g.suffix from ({UPLOADS}) u join ({GATE}) g on g.idx = u.idx",
    "image_formats": "select doc_id, case when f = 'svg' then 'svg' when f is null or (doc_id % 3 = 0 and f <> 'png') or doc_id % 7 = 3 then null else f end as format from (select doc_id, ['jpeg', 'png', 'gif', 'bmp', 'webp', 'svg', null][doc_id % 7 + 1] as f from documents) q",
}
_R = lambda c: f"cast(round(cast({c} as double), 3) as varchar)"
SQL["model_json"] = f"""select doc, page_idx, block_index, '{{"type":"' || type || '","bbox":[' || {_R("x1")} || ',' || {_R("y1")} || ',' || {_R("x2")} || ',' || {_R("y2")} || '],"angle":' || coalesce(angle, 0) || coalesce(',"merge_prev":' || merge_prev, '') || '}}' as item from ({PARSED}) p"""
SQL["type_histogram"] = f"""select type, count(*) as n, cast(sum(n_spans) as bigint) as n_spans from (select {_TYPE} as type, case when type not in ('image', 'table', 'chart', 'equation', 'image_block') and contains(content, chr(92) || '(') then 4 else 1 end as n_spans from ({inputs.BLOCKS}) b where type <> 'equation_block') q group by 1"""
