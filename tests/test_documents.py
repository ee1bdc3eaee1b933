"""The outputs of whole pages against a plain model of them, block by block, on all blocks of the smallest tables."""

import collections
import json
import os
import re

import duckdb
import pytest

from quillspark import session
from quillspark.plans import inputs, structure_queries

SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
TEXTS = "text title ref_text phonetic header footer page_number aside_text page_footnote list image_caption table_caption code_caption image_footnote table_footnote code algorithm".split()
SPANS = {"image": "image", "image_block": "image", "table": "table", "chart": "chart", "equation": "interline_equation"}
ROLES = {"image_caption": "caption", "table_caption": "caption", "code_caption": "caption", "image_footnote": "footnote", "table_footnote": "footnote"}
VISUAL = {"image": "image", "image_block": "image", "table": "table", "chart": "chart", "code": "code", "algorithm": "code"}
SIZE = (1003, 1001)


def escaped(s):
    out, run = "", 0
    for c in s:
        out += ("\\" if c in "*_`~$" and run % 2 == 0 else "") + c
        run = run + 1 if c == "\\" else 0
    return out


def cjk(s):
    return any(0x3400 <= ord(c) <= 0x4DBF or 0x4E00 <= ord(c) <= 0x9FFF or 0x3040 <= ord(c) <= 0x30FF or 0xAC00 <= ord(c) <= 0xD7AF for c in s)


def table_html(raw):
    rows, row, opened = [], [], False
    for x in (p.strip(SPACES) for p in re.split("(<nl>|<[felux]cel>)", raw.strip(SPACES))):
        if x == "<nl>":
            rows.append(row)
            row = []
        elif x in ("<fcel>", "<ecel>"):
            row.append("")
        elif x and not x.endswith("cel>"):
            if opened and not x.startswith("<"):
                row[-1] = x
            else:
                row.append(x)
        if x:
            opened = x in ("<fcel>", "<ecel>")
    rows += [row] if row else []
    shown = lambda x: x.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")
    width = max(map(len, rows))
    return "<table>" + "".join("<tr>" + "".join(f"<td>{shown(x)}</td>" for x in r) + "<td></td>" * (width - len(r)) + "</tr>" for r in rows) + "</table>"


def plain_equation(s):
    s = s.strip(SPACES)
    inner = s[2:] if s.startswith("\\[") else s
    return (inner[:-2] if inner.endswith("\\]") else s).strip(SPACES)


def bracketed(s):
    s = s.strip(SPACES)
    s = s if s.startswith("\\[") else "\\[\n" + s
    return s if s.endswith("\\]") else s + "\n\\]"


def spans_of(kind, content):
    span = lambda t, c=None, html=None: {"type": t, "content": c, "html": html}
    content = content or ""
    if kind in TEXTS and "\\(" in content and content.count("\\(") == content.count("\\)"):
        parts = re.split(r"\\\(([^\n]+?)\\\)", content)
        every = [span("inline_equation", p.strip(SPACES)) if i % 2 else span("text", p) for i, p in enumerate(parts)]
        return [s for s in every if s["type"] != "text" or s["content"].strip(SPACES)]
    if kind == "table":
        return [span("table", None, content)]
    if kind in ("image", "chart"):
        return [span(kind, content)]
    if kind == "equation":
        return [span("interline_equation", plain_equation(content))]
    told = content.replace("\\[", "[").replace("\\]", "]")
    if kind == "title":
        told = " ".join(x.strip(SPACES) for x in told.removesuffix("\n").split("\n"))
    return [span("text" if kind in TEXTS else SPANS.get(kind, "unknown"), told)]


def merged(lines, kind, prefix=True):
    wide = cjk("".join(s["content"] or "" for line in lines for s in line if s["type"] == "text"))
    out = ""
    for n, line in enumerate(lines):
        for i, s in enumerate(line):
            raw, last = s["content"] or "", i == len(line) - 1
            x = {"text": raw if kind == "code_body" else escaped(raw), "inline_equation": f"${raw}$", "interline_equation": f"$$\n{raw}\n$$"}.get(s["type"], "").strip(SPACES)
            if not x or s["type"] == "interline_equation":
                out += x
            elif wide:
                out += x if last and s["type"] != "inline_equation" else x + " "
            elif last and s["type"] == "text" and x.endswith("-"):
                following = lines[n + 1][0]["content"] if n + 1 < len(lines) and lines[n + 1] else ""
                out += x.rstrip("-") if (following or "")[:1].islower() else x
            else:
                out += x + " "
    return re.sub(r"^([ \t]{0,3})(#{1,6}[ \t]|[+-][ \t])", r"\1\\\2", out) if kind == "text" and prefix else out


def merged_spans(lines, kind):
    wide = any(s["type"] == "text" and cjk(s["content"] or "") for line in lines for s in line)
    out = []
    for n, line in enumerate(lines):
        for i, s in enumerate(line):
            raw, last = s["content"], i == len(line) - 1
            if not (raw or "").strip(SPACES) or s["type"] not in ("text", "inline_equation"):
                continue
            name = "equation_inline" if s["type"] == "inline_equation" else "phonetic" if kind == "phonetic" else "text"
            if s["type"] == "text":
                if wide:
                    raw = raw if last else raw + " "
                elif last and raw.endswith("-"):
                    following = lines[n + 1][0]["content"] if n + 1 < len(lines) and lines[n + 1] else ""
                    raw = raw.rstrip("-") if (following or "")[:1].islower() else raw
                else:
                    raw += " "
            if out and out[-1]["type"] == name:
                out[-1]["content"] += raw
            else:
                out.append({"type": name, "content": raw})
    return out


def page_of(rows):
    """Top-level blocks of a page."""
    blocks = []
    for r in rows:
        if r["type"] == "equation_block":
            continue
        kind, content = "text" if r["type"] == "list_item" else r["type"], r["content"]
        if kind == "table":
            content = table_html(content)
        elif kind == "equation":
            content = bracketed(plain_equation(content))
        elif kind in ("image", "chart"):
            content = "" if "<fcel>" in content else content.strip(SPACES)
        blocks.append({**r, "kind": kind, "type": ROLES.get(kind, kind), "spans": spans_of(kind, content), "children": [], "owner": None})
    box = lambda b: (b["x1"], b["y1"], b["x2"], b["y2"])
    for c, b in enumerate(blocks):
        if b["type"] not in ("caption", "footnote"):
            continue
        best = None
        for m, v in enumerate(blocks):
            if v["kind"] not in VISUAL or b["type"] == "footnote" and b["idx"] < v["idx"]:
                continue
            between = blocks[min(c, m) + 1 : max(c, m)]
            if all(k["type"] == "caption" or k["type"] == b["type"] == "footnote" for k in between):
                p, q = box(b), box(v)
                gap = max(q[0] - p[2], p[0] - q[2], 0) + max(q[1] - p[3], p[1] - q[3], 0)
                best = min(best or (9**9,), (abs(c - m), gap, v["idx"], m))
        b["owner"] = blocks[best[3]] if best else None
    for b in blocks:
        if b["type"] in ("caption", "footnote") and b["owner"] is None:
            b |= {"type": "text", "merge_prev": None}
    for b in blocks:
        if b["type"] in ("text", "ref_text"):
            for v in blocks:
                p, q = box(b), box(v)
                w, h = min(p[2], q[2]) - max(p[0], q[0]), min(p[3], q[3]) - max(p[1], q[1])
                if v["type"] == "list" and w > 0 and h > 0 and w * h / (max(p[2] - p[0], 1) * max(p[3] - p[1], 1)) >= 0.8:
                    b["owner"] = v
                    break
    top, start = [], None
    for b in blocks:
        if b["owner"] is not None:
            b["owner"]["children"].append(b)
            continue
        b["lines"] = [] if b["kind"] in VISUAL or b["type"] in ("list", "text") else [b["spans"]]
        if b["type"] == "text":
            start = b if start is None or not b["merge_prev"] else start
            start["lines"].append(b["spans"])
        top.append(b)
    out = []
    for b in top:
        if b["type"] == "list" and not b["children"]:
            continue
        name = VISUAL.get(b["kind"], b["type"]) if b["type"] != "text" else "text"
        sub = b["kind"] if b["kind"] in ("code", "algorithm") else None
        if b["type"] == "list":
            found = collections.Counter(c["type"] for c in b["children"])
            sub = max(found, key=lambda t: (found[t], -min(c["idx"] for c in b["children"] if c["type"] == t)))
        children = b["children"]
        if b["kind"] in VISUAL:
            children = sorted([b, *children], key=lambda c: c["idx"])
            children = [{**c, "type": f"{name}_body" if c is b else f"{name}_{c['type']}"} for c in children]
        out.append({**b, "type": name, "children": children, "sub_type": sub})
    return out


def body_of(b):
    every = [s for c in b["children"] if c["type"].endswith("_body") for s in c["spans"]] + [s for line in b["lines"] for s in line]
    s = next((s for s in every if s["type"] in ("table", "image", "chart", "interline_equation", "text")), None)
    return "" if s is None else (s["html"] if s["type"] == "table" else s["content"]) or ""


def child_texts(b, kind, of=lambda c: merged([c["spans"]], c["type"])):
    return [of(c) for c in b["children"] if c["type"] == kind]


def flat_item(b):
    t = b["type"]
    if t in "text ref_text phonetic header footer page_number aside_text page_footnote".split():
        item = {"type": t, "text": merged(b["lines"], t)}
    elif t == "list":
        item = {"type": "list", "sub_type": b["sub_type"], "list_items": [x for c in b["children"] if (x := merged([c["spans"]], c["type"], False)).strip(SPACES)]}
    elif t == "title":
        item = {"type": "text", "text": merged(b["lines"], t), "text_level": 1}
    elif t == "equation":
        item = {"type": "equation", "text": merged(b["lines"], t), "text_format": "latex"}
    elif t in ("image", "table", "chart"):
        item = {"type": t, "img_path": "", f"{t}_caption": child_texts(b, f"{t}_caption"), f"{t}_footnote": child_texts(b, f"{t}_footnote")}
        item |= {"table_body": body_of(b)} if t == "table" else {"content": body_of(b)}
    elif t == "code":
        code = next((merged([c["spans"]], "code_body") for c in b["children"] if c["type"] == "code_body"), "")
        item = {"type": "code", "sub_type": b["sub_type"], "code_caption": child_texts(b, "code_caption"), "code_body": f"```txt\n{code}\n```" if b["sub_type"] == "code" else code}
    else:
        return None
    return item | {"bbox": thousandths(b), "page_idx": b["page_idx"]}


def thousandths(b):
    return [b["x1"] * 1000 // SIZE[0], b["y1"] * 1000 // SIZE[1], b["x2"] * 1000 // SIZE[0], b["y2"] * 1000 // SIZE[1]]


def nested_item(b):
    t, spans = b["type"], merged_spans(b["lines"], b["type"])
    name = {"aside_text": "page_aside_text", "header": "page_header", "footer": "page_footer"}.get(t, t)
    captions = lambda role: [s for c in b["children"] if c["type"] == role for s in merged_spans([c["spans"]], role)]
    if t in ("header", "footer", "aside_text", "page_number", "page_footnote"):
        item = {"type": name, "content": {f"{name}_content": spans}}
    elif t == "title":
        item = {"type": t, "content": {"title_content": spans, "level": 1}}
    elif t in ("text", "phonetic"):
        item = {"type": "paragraph", "content": {"paragraph_content": spans}}
    elif t == "ref_text":
        item = {"type": "list", "content": {"list_type": "reference_list", "list_items": [{"item_type": "text", "item_content": spans}]}}
    elif t == "equation":
        item = {"type": "equation_interline", "content": {"math_content": body_of(b), "math_type": "latex", "image_source": {"path": ""}}}
    elif t in ("image", "chart", "table"):
        inner = {"image_source": {"path": ""}, f"{t}_caption": captions(f"{t}_caption"), f"{t}_footnote": captions(f"{t}_footnote")}
        inner |= {"html": body_of(b), "table_type": "simple_table", "table_nest_level": 1} if t == "table" else {"content": body_of(b)}
        item = {"type": t, "content": inner}
    elif t == "list":
        kind = "reference_list" if b["sub_type"] == "ref_text" else "text_list"
        item = {"type": t, "content": {"list_type": kind, "list_items": [{"item_type": "text", "item_content": merged_spans([c["spans"]], c["type"])} for c in b["children"]]}}
    else:
        return None
    return item | {"bbox": thousandths(b)}


def markdown_of(b):
    t = b["type"]
    if t in ("text", "equation", "phonetic", "ref_text"):
        return merged(b["lines"], t)
    if t == "title":
        return "# " + merged(b["lines"], t)
    if t == "list":
        return "".join(merged([c["spans"]], c["type"], False) + "  \n" for c in b["children"])
    out, before = "", None
    for c in b["children"] if t in ("image", "table", "chart", "code") else []:
        s, html = c["spans"][0], False
        if c["type"] in ("image_body", "chart_body"):
            x, html = (f"<details>\n<summary>image content</summary>\n\n{s['content']}\n</details>" if (s["content"] or "").strip(SPACES) else ""), True
        elif c["type"] == "table_body":
            x, html = s["html"] or "", True
        else:
            x = merged([c["spans"]], c["type"])
        if x.strip(SPACES):
            out += ("" if before is None else "\n\n" if before or html else "  \n") + x
            before = html
    return out


@pytest.fixture(scope="module")
def pages(data_dir):
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{data_dir}/lineitem.parquet'")
    found = con.execute(inputs.BLOCKS + " order by doc, page_idx, idx")
    names, rows = [d[0] for d in found.description], collections.defaultdict(list)
    for r in found.fetchall():
        rows[r[names.index("doc")], r[names.index("page_idx")]].append(dict(zip(names, r, strict=True)))
    return {k: page_of(v) for k, v in sorted(rows.items())}


def bare(x):
    """Without nulls, as JSON leaves them out."""
    if isinstance(x, dict):
        return {k: bare(v) for k, v in x.items() if v is not None}
    return [bare(v) for v in x] if isinstance(x, list) else x


@pytest.mark.parametrize(("query", "model"), [("content_list_v1", flat_item), ("content_list_v2", nested_item)])
def test_content_lists(spark, data_dir, pages, query, model):
    got = {(r.doc, r.page_idx, r.idx): (r.discarded, bare(json.loads(r["item"]))) for r in structure_queries.QUERIES[query](spark, data_dir).collect()}
    gone = ("header", "footer", "page_number", "aside_text", "page_footnote")
    want = {(*k, b["idx"]): (b["type"] in gone, bare(item)) for k, page in pages.items() for b in page if (item := model(b)) is not None}
    assert got.keys() == want.keys() and len(want) > 4000
    assert got == want


def test_page_markdown(spark, data_dir, pages):
    want = collections.defaultdict(list)
    for (doc, _), page in pages.items():
        for b in page:
            if b["type"] not in ("header", "footer", "page_number", "aside_text", "page_footnote") and (x := markdown_of(b).strip(SPACES)):
                want[doc].append(x)
    got = {r.doc: r.markdown for r in structure_queries.page_markdown(spark, data_dir).collect()}
    assert got == {d: "\n\n".join(x) for d, x in want.items()}


def test_middle_json(spark, data_dir, pages):
    def line(spans, b):
        box = [b["x1"], b["y1"], b["x2"], b["y2"]]
        return {"bbox": box, "spans": [{"bbox": box, **s} for s in spans]}

    def block(b):
        box = [b["x1"], b["y1"], b["x2"], b["y2"]]
        name = {"equation": "interline_equation"}.get(b["type"], b["type"])
        children = [{"type": c["type"], "bbox": [c["x1"], c["y1"], c["x2"], c["y2"]], "angle": c["angle"], "lines": [line(c["spans"], c)], "index": c["idx"]} for c in b["children"]]
        code = b["kind"] in ("code", "algorithm")
        return {"type": name, "bbox": box, "angle": b["angle"], "lines": [line(s, b) for s in b["lines"]] or None, "blocks": children or None, "index": b["idx"], "sub_type": b["sub_type"], "guess_lang": "txt" if code else None, "merge_prev": b["merge_prev"]}

    gone = ("header", "footer", "page_number", "aside_text", "page_footnote")
    want = collections.defaultdict(list)
    for (doc, number), page in pages.items():
        if page:
            want[doc].append({"page_idx": number, "page_size": list(SIZE), "para_blocks": [block(b) for b in page if b["type"] not in gone], "discarded_blocks": [block(b) for b in page if b["type"] in gone]})
    got = {r.doc: bare(json.loads(r.middle_json)) for r in structure_queries.middle_json(spark, data_dir).collect()}
    assert {d: x["pdf_info"] for d, x in got.items()} == {d: bare(x) for d, x in want.items()}
    assert all(x["_backend"] == "vlm" for x in got.values())


def test_middle_json_without_tables(spark, data_dir, tmp_path):
    """Only the narrow raw blocks are dealt, by their order and by their document; nothing is written on the way."""
    os.symlink(f"{data_dir}/lineitem.parquet", tmp_path / "lineitem.parquet")
    folder = f"{session.shared_folder(spark)}/quillspark".removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    found = structure_queries.middle_json(spark, str(tmp_path))
    assert str(found._jdf.queryExecution().executedPlan()).count("Exchange hashpartitioning") == 2
    assert found.count() > 0
    assert (set(os.listdir(folder)) if os.path.isdir(folder) else set()) == before
