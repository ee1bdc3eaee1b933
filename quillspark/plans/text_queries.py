"""Queries of the text functions, with their DuckDB forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import model_stage, render, tables
from ..operators.structure import SPAN
from .inputs import table

TRIM = text.TRIM


def d_trim(x: str) -> str:
    return f"regexp_replace({x}, '{TRIM}', '', 'g')"


def d_md(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({x}, '(?s)\\\\.|[^\\\\]|\\\\$'), lambda t: case when t in ('*', '_', '`', '~', '$') then chr(92) || t else t end), '')"


def d_prefix(x: str) -> str:
    return f"regexp_replace({x}, '{text.PREFIX}', '\\1\\\\\\2')"


def d_escape(x: str) -> str:
    return f"replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


def d_unescape(x: str) -> str:
    return f"replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"


#: Documents with the marks that the rules are about, which the texts do not have by themselves.
MARKED = "replace(replace(replace(replace(text, ' the ', ' the_* '), ' of ', ' of' || chr(92) || '* $x ~'), ' and ', ' and-' || chr(10)), ' is ', ' is-' || chr(10) || 'Big ')"


def _marked(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(MARKED).alias("t"))


def doc_markdown(spark, sf_dir):
    """Each document: a short first line as heading, the other lines as one paragraph."""
    lines = F.split("t", "\n")
    short = F.octet_length(F.element_at(lines, 1)) < 80
    block = lambda xs: F.transform(xs, lambda x: F.array(F.struct(F.lit("text").alias("type"), x.alias("content"), F.lit(None).cast("string").alias("html"), F.lit(None).cast("string").alias("image_path")).cast(SPAN)))
    rows = _marked(spark, sf_dir).select("doc_id", F.when(short, block(F.slice(lines, 1, 1))).alias("head"), block(F.when(short, F.slice(lines, 2, F.size(lines))).otherwise(lines)).alias("body"))
    head = F.concat(F.lit("# "), render.paragraph(F.col("head"), "title"))
    parts = F.filter(F.array(text.trim(head), text.trim(render.paragraph(F.col("body"), "text"))), lambda p: p.isNotNull() & (p != ""))
    return rows.select("doc_id", F.array_join(parts, "\n\n").alias("markdown"))


_PIECE = f"""case when p = '' then '' when cjk then p when p like '%-' and regexp_matches(coalesce(nxt, ''), '^[\\p{{Ll}}ªº]') then regexp_replace(p, '-+$', '') when p like '%-' then p else p || ' ' end"""
DOC_MARKDOWN = f"""with l as (select doc_id, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as i from (select doc_id, {MARKED} as t from documents) a),
k as (select *, case when i = 1 and strlen(line) < 80 then 0 else 1 end as blk from l),
c as (select *, {d_trim(d_md("line"))} as p, lead(line) over (partition by doc_id, blk order by i) as nxt, bool_or(regexp_matches(line, '{text.CJK}')) over (partition by doc_id, blk) as cjk from k),
b as (select doc_id, blk, string_agg({_PIECE}, '' order by i) as t from c group by doc_id, blk),
m as (select doc_id, blk, case when blk = 0 then {d_trim("'# ' || t")} else {d_trim(d_prefix("t"))} end as md from b)
select doc_id, coalesce(string_agg(md, chr(10) || chr(10) order by blk) filter (where md <> ''), '') as markdown from m group by doc_id"""


def md_escape(spark, sf_dir):
    return _marked(spark, sf_dir).select("doc_id", text.md_escape(F.col("t")).alias("escaped"))


def md_prefix_escape(spark, sf_dir):
    lines = _marked(spark, sf_dir).select("doc_id", F.posexplode(F.split(F.expr("replace(t, ' a', chr(10) || ' - a')"), "\n")).alias("line_no", "line"))
    return lines.select("doc_id", "line_no", text.prefix_escape(F.col("line")).alias("escaped"))


def cjk_flag(spark, sf_dir):
    t = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" 漢字"))).when(F.col("doc_id") % 3 == 1, F.lit("  usz@google.com ")).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", text.is_cjk(t).alias("cjk"))


def html_escape_roundtrip(spark, sf_dir):
    e = text.html_escape(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(e.cast("binary"), 256).alias("escaped_sha"), (text.html_unescape(e) == F.col("html")).alias("same"))


def trim_unicode(spark, sf_dir):
    t = F.concat(F.lit(" 　\t "), "text", F.lit("  \n"))
    return table(spark, sf_dir, "documents").select("doc_id", text.trim(t).alias("trimmed"), text.blank(F.lit(" 　\n")).alias("blank"))


#: Sentences with inline equations; some unbalanced.
EQUATIONS = "concat('Let ', chr(92), '( a_', CAST(item_id AS VARCHAR), ' ', chr(92), ') be ', text, CASE item_id % 3 WHEN 0 THEN concat(' ', chr(92), '(b', chr(92), ')') WHEN 1 THEN concat(' ', chr(92), '(open') ELSE '' END)"


def inline_eq_split(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.expr(EQUATIONS.replace("VARCHAR", "STRING")).alias("t"))
    one = F.array(F.struct(F.lit("text").alias("type"), F.col("t").alias("content")))
    spans = F.when(text.has_inline_equations(F.col("t")), text.inline_spans(F.col("t"))).otherwise(one)
    return rows.select("item_id", F.posexplode(spans).alias("pos", "s")).select("item_id", "pos", "s.type", "s.content")


INLINE_EQ = f"""with t as (select item_id, {EQUATIONS} as t from benchmark),
g as (select item_id, t, contains(t, chr(92) || '(') and len(regexp_extract_all(t, '\\\\\\(')) = len(regexp_extract_all(t, '\\\\\\)')) as fine from t),
s as (select item_id, fine, t, case when fine then regexp_extract_all(t, '\\\\\\([^\\n]+?\\\\\\)|(?:[^\\\\]|\\\\[^(])+') else [t] end as parts from g),
u as (select item_id, fine, unnest(parts) as p, generate_subscripts(parts, 1) as i from s)
select item_id, cast(row_number() over (partition by item_id order by i) - 1 as int) as pos, case when fine and p like chr(92) || '(%' then 'inline_equation' else 'text' end as type,
case when fine and p like chr(92) || '(%' then {d_trim("substr(p, 3, length(p) - 4)")} else p end as content from u where not fine or {d_trim("p")} <> ''"""


EQUATION_INPUT = "CASE item_id % 4 WHEN 0 THEN concat(' ', chr(92), '[ x', CAST(item_id AS VARCHAR), chr(92), '] ') WHEN 1 THEN concat(chr(92), '[y') WHEN 2 THEN concat('z', chr(92), ']') ELSE ' w ' END"


def equation_clean(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.expr(EQUATION_INPUT.replace("VARCHAR", "STRING")).alias("t"))
    clean = text.clean_equation(F.col("t"))
    return rows.select("item_id", clean.alias("clean"), text.bracket_equation(clean).alias("bracketed"))


_D_OPEN = f"case when starts_with({d_trim('t')}, chr(92) || '[') then substr({d_trim('t')}, 3) else {d_trim('t')} end"
EQUATION_CLEAN = f"""with t as (select item_id, {EQUATION_INPUT} as t from benchmark), o as (select item_id, t, {_D_OPEN} as o from t),
c as (select item_id, {d_trim(f"case when ends_with(o, chr(92) || ']') then left(o, length(o) - 2) else {d_trim('t')} end")} as clean from o),
b as (select item_id, clean, case when starts_with(clean, chr(92) || '[') then clean else chr(92) || '[' || chr(10) || clean end as b from c)
select item_id, clean, case when ends_with(b, chr(92) || ']') then b else b || chr(10) || chr(92) || ']' end as bracketed from b"""


def image_content_clean(spark, sf_dir):
    t = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" "), "props", F.lit("<fcel>"))).when(F.col("event_id") % 3 == 1, F.lit("  ")).otherwise(F.concat(F.lit(" "), "props"))
    return table(spark, sf_dir, "events").select("event_id", text.clean_image_content(t).alias("content"))


def embedded_equations(spark, sf_dir):
    t = F.concat(F.lit("<td><eq>a &lt; "), "n_name", F.lit("</eq> and <eq>b</eq> <eq>open</td>"))
    return table(spark, sf_dir, "nation").select("n_nationkey", text.embed_equations(t).alias("vlm"), text.office_embedded_html(F.concat(t, F.lit('<img src="x.png"/><img src="http://h/y.png"/><img src="images/z.png"/>'))).alias("office"))


EMBEDDED = """select n_nationkey, replace(replace(replace(replace(regexp_replace(t, '<eq>(.*?)</eq>', ' $\\1$ ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') as vlm,
replace(replace(t || '<img src="images/x.png"/><img src="http://h/y.png"/><img src="images/z.png"/>', '<eq>', ' $'), '</eq>', '$ ') as office
from (select n_nationkey, '<td><eq>a &lt; ' || n_name || '</eq> and <eq>b</eq> <eq>open</td>' as t from nation) q"""


def hash_names(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("raw"))
    md5 = F.upper(F.md5("raw"))
    box = [F.lit(i) for i in (1, 2, 30, 40)]
    return rows.select("doc_id", text.crop_name(F.lit("image"), md5, F.lit(3), box).alias("crop"), text.office_media_name(F.lit("png"), F.col("raw")).alias("media"))


def data_uri(spark, sf_dir):
    name = F.concat("source", F.lit("."), F.element_at(F.array(*map(F.lit, ("png", "jpg", "GIF", "xyz", "webp"))), (F.col("doc_id") % 5 + 1).cast("int")))
    return table(spark, sf_dir, "documents").select("doc_id", text.data_uri(text.mime_type(name), F.col("text").cast("binary")).alias("uri"))


def utf8_truncate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.utf8_truncate(F.col("text"), 200).alias("cut"))


def inline_markup_render(spark, sf_dir):
    from ..operators import office

    styles = F.when(F.col("n_nationkey") % 4 == 0, F.array(F.lit("bold"))).when(F.col("n_nationkey") % 4 == 1, F.array(F.lit("strikethrough"), F.lit("italic"))).when(F.col("n_nationkey") % 4 == 2, F.array(F.lit("underline"), F.lit("bold"))).otherwise(F.array().cast("array<string>"))
    span = F.struct(F.when(F.col("n_nationkey") % 5 == 0, F.lit("hyperlink")).otherwise(F.lit("text")).alias("type"), F.concat("n_name", F.lit("_[x]")).alias("content"), F.lit("http://a/b (c)").alias("url"), styles.alias("style"))
    return table(spark, sf_dir, "nation").select("n_nationkey", office.span_markdown(span).alias("md"))


_PLANTED = """concat('<text style="bold, italic">', replace(replace(lang, '&', '&amp;'), '<', '&lt;'), '</text><eq> x_', doc_id, ' </eq><hyperlink><text style="underline">', source, '</text><url>http://h/?a=', doc_id, '&amp;b</url></hyperlink>',
replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), ' the ', '</text> the<text> '), CASE doc_id % 4 WHEN 0 THEN '<eq>open' WHEN 1 THEN '<hyperlink>no</hyperlink> rest<eq>x</eq>' WHEN 2 THEN '<text>same</text>' ELSE '' END)"""


def inline_markup_spans(spark, sf_dir):
    """Spans of all documents with tags around and within them; a tag without an end makes the rest plain."""
    spans = text.markup_spans(F.expr(_PLANTED))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(spans).alias("pos", "s"))
    return rows.select("doc_id", "pos", "s.type", "s.content", "s.url", F.array_join("s.style", ",").alias("style"))


# " the " is "</text> the<text> " in the tagged text: with an even number of them left, each opens a plain text that the next one closes
INLINE_SPANS = """with p as (select doc_id, string_split(text, ' the ') as parts, lang, source, case doc_id % 4 when 0 then '<eq>open' when 1 then '<hyperlink>no</hyperlink> rest<eq>x</eq>' when 2 then '<text>same</text>' else '' end as tail from documents),
q as (select *, len(parts) as n from p),
t as (select *, case when n = 1 then parts[1] || case doc_id % 4 when 2 then 'same' else tail end
when doc_id % 4 = 2 then parts[1] || '</text> the' || list_reduce(list_transform(parts[2:n], lambda x: ' ' || x), lambda a, b: a || ' the' || b) || '<text>same'
else parts[1] || '</text> the' || case when n = 2 then '' else list_reduce(list_transform(parts[2:n-1], lambda x: ' ' || x), lambda a, b: a || ' the' || b) || ' the' end || '<text> ' || parts[n] || tail end as plain from q)
select doc_id, 0 as pos, 'text' as type, lang as content, null as url, 'bold,italic' as style from t
union all select doc_id, 1, 'equation_inline', 'x_' || doc_id, null, '' from t
union all select doc_id, 2, 'hyperlink', source, 'http://h/?a=' || doc_id || '&b', 'underline' from t
union all select doc_id, 3, 'text', plain, null, '' from t where plain <> ''"""

INLINE_MARKUP = """select n_nationkey, case when n_nationkey % 5 = 0 then '[' || s || '](http://a/b%20(c%29)' else s end as md from (
select n_nationkey, case n_nationkey % 4 when 0 then '**' || e || '**' when 1 then '~~*' || e || '*~~' when 2 then '<u>**' || e || '**</u>' else e end as s from (
select n_nationkey, replace(replace(replace(n_name || '_[x]', '[', chr(92) || '['), ']', chr(92) || ']'), '_', chr(92) || '_') as e from nation) a) b"""


def html_blocks(spark, sf_dir):
    """Headings and paragraphs of pages, in document order."""
    kind = F.regexp_extract_all("html", F.lit(r"(?is)<(h1|p|li)[^>]*>(.*?)(?=<(?:/h1|/p|/li|h1|p|li)[ >])"), F.lit(1))
    body = F.regexp_extract_all("html", F.lit(r"(?is)<(h1|p|li)[^>]*>(.*?)(?=<(?:/h1|/p|/li|h1|p|li)[ >])"), F.lit(2))
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.arrays_zip(kind.alias("k"), body.alias("b"))).alias("pos", "x"))
    plain = text.trim(F.regexp_replace(text.html_unescape(F.regexp_replace(F.col("x.b"), "<[^>]*>", "")), r"\s+", " "))
    return rows.select("page_id", "pos", F.when(F.lower("x.k") == "h1", F.lit("title")).when(F.lower("x.k") == "li", F.lit("list")).otherwise(F.lit("text")).alias("type"), plain.alias("content")).where("content <> ''")


# a mark before each tag that ends a block stands for the look ahead
_BLOCK = "'(?is)<(h1|p|li)[^>]*>([^\\x01]*)\\x01'"
_UNTAGGED = "regexp_replace(b, '<[^>]*>', '', 'g')"
HTML_BLOCKS = f"""with m as (select page_id, regexp_replace(html, '(?i)(<(?:/h1|/p|/li|h1|p|li)[ >])', chr(1) || '\\1', 'g') as h from pages),
x as (select page_id, generate_subscripts(regexp_extract_all(h, {_BLOCK}, 1), 1) - 1 as pos, unnest(regexp_extract_all(h, {_BLOCK}, 1)) as k, unnest(regexp_extract_all(h, {_BLOCK}, 2)) as b from m),
c as (select page_id, cast(pos as int) as pos, case lower(k) when 'h1' then 'title' when 'li' then 'list' else 'text' end as type, {d_trim(f"regexp_replace({d_unescape(_UNTAGGED)}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')")} as content from x)
select * from c where content <> ''"""


def page_titles(spark, sf_dir):
    h1 = F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1)
    return table(spark, sf_dir, "pages").select("page_id", text.trim(h1).alias("title"), F.regexp_count("html", F.lit("(?i)<p[ >]")).alias("n_paragraphs"), tables.table_kind(F.col("html")).alias("table_kind"), tables.nest_level(F.col("html")).alias("level"))


OTSL = "concat('<fcel>', r_name, '<fcel> a & b <nl><ecel><fcel>', CASE r_regionkey % 2 WHEN 0 THEN 'x<y' ELSE '' END, '<lcel><ucel>tail<nl>lone', CASE r_regionkey % 3 WHEN 0 THEN '<nl>' ELSE '' END)"


def otsl_to_html(spark, sf_dir):
    rows = table(spark, sf_dir, "region").select("r_regionkey", F.expr(OTSL).alias("t"))
    return rows.select("r_regionkey", tables.otsl_to_html(F.col("t")).alias("html"), F.array_max(F.transform(tables.otsl_rows(F.col("t")), lambda r: F.size(r))).alias("max_cols"))


# the input has three rows: name and "a & b"; an empty cell, a cell (or the text x<y, which starts with no bracket), tail; lone
OTSL_SQL = f"""select r_regionkey, '<table><tr><td>' || {d_escape("r_name")} || '</td><td>a &amp; b</td><td></td></tr><tr><td></td><td>' || case when r_regionkey % 2 = 0 then 'x&lt;y' else '' end || '</td><td>tail</td></tr><tr><td>lone</td><td></td><td></td></tr></table>' as html, 3 as max_cols from region"""


def model_request(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("layout", "table", "equation", "image", "text"))), (F.col("item_id") % 5 + 1).cast("int"))
    body = model_stage.request_body(kind, F.when(F.col("item_id") % 2 == 0, F.lit("GPT-x")).otherwise(F.lit("page-model")), F.when(F.col("item_id") % 3 == 0, F.col("text").cast("binary")), F.col("item_id"))
    get = lambda p: F.get_json_object("body", p)
    rows = table(spark, sf_dir, "benchmark").select("item_id", body.alias("body"))
    return rows.select("item_id", get("$.model").alias("model"), get("$.messages[0].role").alias("first_role"), get("$.messages[1].content[0].type").alias("first_part"), F.coalesce(get("$.messages[1].content[1].text"), get("$.messages[1].content[0].text")).alias("prompt"), F.sha2(get("$.messages[1].content[0].image_url.url"), 256).alias("image_sha"), get("$.top_k").alias("top_k"), get("$.frequency_penalty").cast("double").alias("frequency_penalty"), get("$.presence_penalty").cast("double").alias("presence_penalty"), get("$.priority").cast("int").alias("priority"))


MODEL_REQUEST = """select item_id, case when item_id % 2 = 0 then 'GPT-x' else 'page-model' end as model, 'system' as first_role, case when item_id % 3 = 0 then sha256('data:image/png;base64,' || base64(encode(text))) end as image_sha, case when item_id % 3 = 0 then 'image_url' else 'text' end as first_part,
chr(10) || ['Layout Detection:', 'Table Recognition:', 'Formula Recognition:', 'Image Analysis:', 'Text Recognition:'][item_id % 5 + 1] as prompt, case when item_id % 2 = 0 then null else '1' end as top_k,
cast([0.0, 0.005, 0.05, 0.05, 0.05][item_id % 5 + 1] as double) as frequency_penalty, cast(case when item_id % 5 = 0 then 0.0 else 1.0 end as double) as presence_penalty, cast(item_id as int) as priority from benchmark"""

RESPONSES = """CASE event_id % 5 WHEN 0 THEN concat('{"object":"chat.completion","choices":[{"finish_reason":"stop","message":{"content":"v', CAST(event_id AS VARCHAR), '<|im_end|>"}}]}')
WHEN 1 THEN '{"object":"error","message":"no"}' WHEN 2 THEN '{"choices":[]}' WHEN 3 THEN '{"choices":[{"finish_reason":"tool","message":{"content":"x"}}]}' ELSE '{"choices":[{"message":{"content":"x"}}]}' END"""


def model_response(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.expr(RESPONSES.replace("VARCHAR", "STRING")).alias("body"))
    return rows.select("event_id", model_stage.response_content(F.col("body")).alias("content"), model_stage.response_error(F.col("body")).alias("error"))


MODEL_RESPONSE = f"""select event_id, case when event_id % 5 = 0 then 'v' || event_id end as content, case event_id % 5 when 0 then null when 1 then 'Error from server: ' || body when 2 then 'No choices found in the response.'
when 3 then 'Unexpected finish reason: tool' else 'Finish reason is None in the response.' end as error from (select event_id, {RESPONSES} as body from events) q"""


def retryable_errors(spark, sf_dir):
    status = F.when(F.col("event_id") % 7 != 0, (F.lit(400) + (F.col("event_id") % 150)).cast("int"))
    code = F.when(F.col("event_id") % 11 == 0, F.lit("rate_limit_exceeded"))
    return table(spark, sf_dir, "events").select("event_id", model_stage.retryable(status, code, F.col("event_type")).alias("again"))


def server_url(spark, sf_dir):
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(" "), "url", F.lit("/v1/ "))).when(F.col("page_id") % 3 == 1, F.col("url")).otherwise(F.lit("host:80/x"))
    return table(spark, sf_dir, "pages").select("page_id", model_stage.server_url(url).alias("base"))


def model_stage_run(spark, sf_dir):
    """Request, batched call of a deterministic model, answer: one row for each benchmark item."""
    kind = F.when(F.col("item_id") % 2 == 0, F.lit("layout")).otherwise(F.lit("text"))
    rows = table(spark, sf_dir, "benchmark").select("item_id", model_stage.request_body(kind, F.lit("page-model"), F.lit(None).cast("binary"), F.col("item_id")).alias("body"))
    return model_stage.send(rows, model_stage.fake_transport).select("item_id", model_stage.response_content(F.col("response")).alias("content"), "failure")


QUERIES = {
    "doc_markdown": doc_markdown,
    "md_escape": md_escape,
    "md_prefix_escape": md_prefix_escape,
    "cjk_flag": cjk_flag,
    "html_escape_roundtrip": html_escape_roundtrip,
    "trim_unicode": trim_unicode,
    "inline_eq_split": inline_eq_split,
    "equation_clean": equation_clean,
    "image_content_clean": image_content_clean,
    "embedded_equations": embedded_equations,
    "hash_names": hash_names,
    "data_uri": data_uri,
    "utf8_truncate": utf8_truncate,
    "inline_markup_render": inline_markup_render,
    "inline_markup_spans": inline_markup_spans,
    "html_blocks": html_blocks,
    "page_titles": page_titles,
    "otsl_to_html": otsl_to_html,
    "vlm_request_body": model_request,
    "vlm_response_parse": model_response,
    "retryable_errors": retryable_errors,
    "server_url": server_url,
    "vlm_stage": model_stage_run,
}

_MIME = "case lower(['png', 'jpg', 'GIF', 'xyz', 'webp'][doc_id % 5 + 1]) when 'png' then 'image/png' when 'gif' then 'image/gif' when 'webp' then 'image/webp' else 'image/jpeg' end"
SQL = {
    "html_blocks": HTML_BLOCKS,
    "doc_markdown": DOC_MARKDOWN,
    "md_escape": f"select doc_id, {d_md('t')} as escaped from (select doc_id, {MARKED} as t from documents) q",
    "md_prefix_escape": f"""select doc_id, cast(i - 1 as int) as line_no, {d_prefix('line')} as escaped from (select doc_id, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as i
from (select doc_id, replace({MARKED}, ' a', chr(10) || ' - a') as t from documents) q) u""",
    "cjk_flag": f"select doc_id, case doc_id % 3 when 0 then true when 1 then true else regexp_matches(text, '{text.CJK}') end as cjk from documents",
    "html_escape_roundtrip": f"select page_id, sha256({d_escape('html')}) as escaped_sha, {d_unescape(d_escape('html'))} = html as same from pages",
    "trim_unicode": f"select doc_id, {d_trim('text')} as trimmed, true as blank from documents",
    "inline_eq_split": INLINE_EQ,
    "equation_clean": EQUATION_CLEAN,
    "image_content_clean": f"select event_id, case event_id % 3 when 0 then '' when 1 then '' else {d_trim('props')} end as content from events",
    "embedded_equations": EMBEDDED,
    "hash_names": "select doc_id, sha256('image/' || upper(md5(text)) || '_3_1_2_30_40') || '.jpg' as crop, sha256('data:image/png;base64,' || base64(encode(text))) || '.png' as media from documents",
    "data_uri": f"select doc_id, 'data:' || {_MIME} || ';base64,' || base64(encode(text)) as uri from documents",
    "inline_markup_render": INLINE_MARKUP,
    "inline_markup_spans": INLINE_SPANS,
    "page_titles": f"""select page_id, {d_trim("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} as title, cast(len(regexp_extract_all(html, '(?i)<p[ >]')) as int) as n_paragraphs,
case when contains(html, 'colspan') or contains(html, 'rowspan') or len(regexp_extract_all(html, '<table')) > 1 then 'complex_table' else 'simple_table' end as table_kind, case when len(regexp_extract_all(html, '<table')) > 1 then 2 else 1 end as level from pages""",
    "otsl_to_html": OTSL_SQL,
    "vlm_request_body": MODEL_REQUEST,
    "vlm_response_parse": MODEL_RESPONSE,
    "retryable_errors": "select event_id, event_id % 7 = 0 or 400 + event_id % 150 = 429 or (400 + event_id % 150) between 500 and 599 or event_id % 11 = 0 or event_type = 'server_error' as again from events",
    "server_url": "select page_id, case page_id % 3 when 0 then url when 1 then regexp_extract(url, '^(https?://[^/]+)', 1) end as base from pages",
    "vlm_stage": "select item_id, case when item_id % 2 = 0 then '<|box_start|>0 0 1000 1000<|box_end|><|ref_start|>text<|ref_end|>' else 'recognized text' end as content, cast(null as varchar) as failure from benchmark",
}
# the longest prefix of whole characters within 200 bytes
SQL["utf8_truncate"] = "select doc_id, case when strlen(text) <= 200 then text else left(text, cast((select max(k) from range(0, 201) r(k) where strlen(left(text, cast(k as int))) <= 200) as int)) end as cut from documents"
