"""Rules on small hand-made inputs, and against row-wise models on random ones."""

import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import layout, model_stage, office, render, structure, tables, tasks
from quillspark.plans import io_queries
from quillspark.sources import config, files, ooxml, sinks
from quillspark.streaming import ingest


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


@pytest.mark.parametrize(("raw", "want"), [("a*b", r"a\*b"), (r"a\*b", r"a\*b"), (r"a\\*b", r"a\\\*b"), ("$1_2`~", r"\$1\_2\`\~"), ("", "")])
def test_md_escape(spark, raw, want):
    assert one(spark, text.md_escape(F.col("t")), t=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("# a", r"\# a"), ("####### a", "####### a"), ("  - x", r"  \- x"), ("+x", "+x"), ("    # a", "    # a")])
def test_prefix_escape(spark, raw, want):
    assert one(spark, text.prefix_escape(F.col("t")), t=raw) == want


@pytest.mark.parametrize(("raw", "want"), [(r"\[x\]", "x"), (r"\[x", r"\[x"), (r"x\]", "x"), (" y ", "y")])
def test_clean_equation(spark, raw, want):
    assert one(spark, text.clean_equation(F.col("t")), t=raw) == want


def test_layout(spark):
    seg = lambda b, t, tail="": f"<|box_start|>{b}<|box_end|><|ref_start|>{t}<|ref_end|>{tail}"
    pages = [
        ("a", seg("0 10 1000 200", "text", "<|rotate_up|>")),
        ("b", seg("0 0 10 10", "inline_formula")),
        ("c", seg("1001 0 10 10", "text") + seg("10 20 5 8", "unknown") + seg("5 5 5 9", "text") + seg("0 0 9 9", "text", " txt_contd_tgt") + seg("0 0 9 9", "title", " txt_contd_tgt")),
        ("d", None),
        ("e", ""),
    ]
    rows = layout.parse(spark.createDataFrame(pages, "doc string, layout string")).orderBy("doc", "block_index").collect()
    assert [(r.doc, r.block_index, r.type, r.angle, r.merge_prev) for r in rows] == [("a", 0, "text", 0, False), ("c", 0, "image", None, None), ("c", 1, "text", None, True), ("c", 2, "title", None, None)]
    assert [round(rows[0][c], 6) for c in ("x1", "y1", "x2", "y2")] == [0.0, 0.01, 1.0, 0.2]
    assert [round(rows[1][c], 6) for c in ("x1", "y1", "x2", "y2")] == [0.005, 0.008, 0.01, 0.02]


@pytest.mark.parametrize(("args", "want"), [((11, 0, 99_999, 64), (0, 10)), ((11, 11, 99_999, 64), None), ((11, 12, 99_999, 64), None), ((0, 0, 5, 8), None), ((20, 3, 12, 4), (3, 12))])
def test_windows(spark, args, want):
    n, start, end, size = args
    rows = layout.page_windows(spark.createDataFrame([(n,)], "n long"), "n", F.lit(start), F.lit(end), size).collect()
    assert (want is None and not rows) or (min(r.page_idx for r in rows), max(r.page_idx for r in rows)) == want
    assert all(r.window_id == (r.page_idx - start) // size for r in rows)


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("<fcel>a<fcel>b<nl><ecel><lcel><fcel>c&d<nl>", "<table><tr><td>a</td><td>b</td></tr><tr><td></td><td>c&amp;d</td></tr></table>"),
        ("<fcel>a<nl>x<fcel>y", "<table><tr><td>a</td><td></td></tr><tr><td>x</td><td>y</td></tr></table>"),
        (" <table><tr></tr></table> ", "<table><tr></tr></table>"),
        (" plain ", "plain"),
        ("<lcel>", ""),
    ],
)
def test_otsl(spark, raw, want):
    assert one(spark, tables.otsl_to_html(F.col("t")), t=raw) == want


def blocks_model(rows):
    """Parents, list items and paragraph starts of a page by plain loops."""
    mains = [i for i, r in enumerate(rows) if r[0] in structure.MAIN]
    parent = {}
    for c, r in enumerate(rows):
        if r[0] in structure.CHILD:
            best = None
            for m in mains:
                if r[0] == "footnote" and c < m:
                    continue
                if all(rows[k][0] in (("caption",) if r[0] == "caption" else structure.CHILD) for k in range(min(c, m) + 1, max(c, m))):
                    gap = sum(max(rows[m][1 + d] - r[3 + d], r[1 + d] - rows[m][3 + d], 0) for d in (0, 1))
                    best = min(best or (9**9,), (abs(m - c), gap, m))
            parent[c] = best[2] if best else None
    return parent


def test_parents_on_random_pages(spark):
    rng = random.Random(5)
    kinds = ["caption", "footnote", "image_body", "table_body", "text", "code_body"]
    pages = [[(rng.choice(kinds), x := rng.randrange(50), y := rng.randrange(50), x + rng.randrange(1, 30), y + rng.randrange(1, 30)) for _ in range(rng.randrange(1, 12))] for _ in range(120)]
    rows = [(p, i, i, *b) for p, page in enumerate(pages) for i, b in enumerate(page)]
    df = spark.createDataFrame(rows, "page int, idx int, pos int, type string, x1 long, y1 long, x2 long, y2 long")
    got = {(r.page, r.idx): r.parent_idx for r in structure.visual_parents(df, ["page"]).collect()}
    assert got == {(p, c): m for p, page in enumerate(pages) for c, m in blocks_model(page).items()}


def test_paragraph(spark):
    span = lambda t, c: {"type": t, "content": c, "html": None, "image_path": None}
    cases = [
        ([[span("text", "hy-")], [span("text", "phen")]], "hyphen "),
        ([[span("text", "hy-")], [span("text", "Phen")]], "hy-Phen "),
        ([[span("text", "中"), span("inline_equation", "x")], [span("text", "文")]], "中 $x$ 文"),
        ([[span("text", "  ")], [span("text", "a_b")]], r"a\_b "),
        ([], ""),
    ]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], f"i int, lines array<array<{structure.SPAN}>>")
    rows = df.select("i", render.paragraph(F.col("lines"), "text").alias("t"), render.paragraph_spans(F.col("lines"), "text").alias("s")).orderBy("i").collect()
    assert [r.t for r in rows] == [w for _, w in cases]
    assert [[(s.type, s.content) for s in r.s] for r in rows][:3] == [[("text", "hyphen ")], [("text", "hy-Phen ")], [("text", "中 "), ("equation_inline", "x"), ("text", "文")]]


def test_crop_paths_reach_content_lists(spark):
    raw = spark.createDataFrame([(0, 0, "image", " seen ", "A" * 32), (0, 1, "image_caption", "Fig", "A" * 32)], "page int, idx int, type string, content string, page_md5 string")
    raw = raw.select("*", *[F.lit(v).cast("long").alias(c) for c, v in zip(structure.BOX, (1, 2, 30, 40), strict=True)], F.lit(None).cast("int").alias("angle"), F.lit(None).cast("boolean").alias("merge_prev"))
    top = structure.assemble(structure.to_blocks(structure.post_process(raw), ["page"]), ["page"]).withColumn("point_w", F.lit(100)).withColumn("point_h", F.lit(100))
    item = json.loads(render.content_list_v1(top, "page").first()["item"])
    name = hashlib.sha256(f"image/{'A' * 32}_0_1_2_30_40".encode()).hexdigest()
    assert item == {"type": "image", "img_path": f"images/{name}.jpg", "image_caption": ["Fig "], "image_footnote": [], "content": "seen", "bbox": [10, 20, 300, 400], "page_idx": 0}
    assert f"![](images/{name}.jpg)" in render.markdown(top, ["page"], ["idx"]).first().markdown


def test_uniquify(spark):
    stems = [("t", i, s) for i, s in enumerate(["a", "A", "a_2", "a", "b", "B_2", "b", "é" * 150])]
    got = tasks.uniquify_exactly(spark.createDataFrame(stems, "task string, idx int, stem string"), "task").orderBy("idx").collect()
    assert [r.unique_stem for r in got][:7] == ["a", "A_3", "a_2", "a_4", "b", "B_2", "b_3"]
    assert len({r.unique_stem.lower() for r in got}) == len(got)
    assert one(spark, text.utf8_truncate(F.col("t"), 5), t="ééé") == "éé"


def test_gate(spark):
    rows = tasks.gate(spark.createDataFrame([("../dir/report.PDF",), ("文.docx",), ("x",), (".pdf",), ("a.tar.gz",)], "name string")).collect()
    assert [(r.stem, r.suffix, r.kind) for r in rows] == [("report", "pdf", "pdf"), ("文", "docx", "office"), ("x", "", None), (".pdf", "", None), ("a.tar", "gz", None)]


def test_retention(spark):
    rows = [("old", "completed", "2024-01-01 00:00:00", 0), ("read", "completed", "2024-01-01 00:00:00", 1), ("new", "failed", "2024-01-02 23:00:00", 0), ("run", "processing", None, 0)]
    df = spark.createDataFrame(rows, "task_id string, status string, completed_at string, active_readers int")
    now = F.lit("2024-01-03 00:00:00")
    assert [r.task_id for r in tasks.expired(df, now).collect()] == ["old"]
    assert {r.task_id for r in tasks.sweep(df, now).collect()} == {"read", "new", "run"}
    assert tasks.expired(df, now, 0).count() == 0


def test_settings():
    s = config.load({"DOC_PAGE_WINDOW": " 7 ", "DOC_MODEL_REQUESTS": '"8"', "DOC_UPLOAD_LIMIT_MIB": "0", "DOC_ALLOW_PUBLIC_INFERENCE": "Yes", "DOC_BIND": "0.0.0.0"})
    assert (s.page_window, s.model_requests, s.upload_limit_mib, s.task_limit, s.queue_size) == (7, 50, 256, 8, 200)
    assert s.remote_inference_allowed() and not config.load({"DOC_BIND": "0.0.0.0"}).remote_inference_allowed()


def test_settings_of_files_and_command_lines(tmp_path):
    text = "# c\nexport DOC_PAGE_WINDOW=5 # pages\nDOC_OUTPUT_ROOT='/o u t'\nDOC_MODEL_SERVER=\"http://h/\\\"x\"\nDOC_MODEL_QUEUE = 7\nnonsense\nDOC_BIND=\n"
    (tmp_path / ".env").write_text(text)
    assert config.dotenv(text) == {"DOC_PAGE_WINDOW": "5", "DOC_OUTPUT_ROOT": "/o u t", "DOC_MODEL_SERVER": 'http://h/"x', "DOC_MODEL_QUEUE": "7", "DOC_BIND": ""}
    s = config.load({"DOC_PAGE_WINDOW": "6", "DOC_IN_FLIGHT_TASKS": "0"}, str(tmp_path / ".env"), ["--host", "0.0.0.0", "--port", "9"])
    assert (s.page_window, s.output_root, s.queue_size, s.in_flight_tasks, s.bind, s.port, s.remote_inference_allowed()) == (6, "/o u t", 7, 6, "0.0.0.0", 9, False)
    assert config.load({"DOC_BIND": "0.0.0.0"}, str(tmp_path / "none"), ["--allow-public-http-client"]).remote_inference_allowed()
    assert config.load({}) == config.Settings()


def test_part_paths(spark):
    resolve = lambda base, target: one(spark, office.resolve_part(F.lit(base), F.col("t")), t=target)
    assert resolve("word/document.xml", "media/i.png") == "word/media/i.png"
    assert resolve("ppt/slides/slide1.xml", "../media/i.png") == "ppt/media/i.png"
    assert resolve("x", "/docProps/core.xml") == "docProps/core.xml"


def test_bad_packages(spark):
    whole = io_queries.xlsx_package("S", ["a", "b"])
    torn = bytearray(whole)
    torn[60:90] = b"\xff" * 30
    rows = [("a", "docx", b"no zip"), ("b", "pptx", io_queries.package({})), ("c", "xlsx", bytes(torn)), ("d", "docx", b""), ("e", "xlsx", io_queries.package({"xl/workbook.xml": "<broken"}))]
    df = spark.createDataFrame(rows, "file string, suffix string, content binary")
    got = {r.file: r.error for r in ooxml.blocks(df).collect()}
    assert "ZIP" in got["a"] and "presentation" in got["b"] and set(got) == set("abcde") and all(got.values())
    assert {r.file for r in ooxml.relationships(df).where("error is not null").collect()} >= {"a", "c", "d"}
    assert {r.file for r in ooxml.parts(df).where("error is not null").collect()} == {"a", "c", "d"}


def test_odd_numbers_of_sheets(spark):
    sheet = '<worksheet><sheetData><row r="1"><c r="A1"><v>no</v></c><c r="B1"><v>1e999</v></c><c r="C1"><v>2.50</v></c></row></sheetData></worksheet>'
    raw = io_queries.package({
        "xl/workbook.xml": f'<workbook {io_queries._NS}><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": io_queries.rels(("rId1", "worksheet", "worksheets/sheet1.xml", False)), "xl/worksheets/sheet1.xml": sheet,
    })
    row = ooxml.blocks(spark.createDataFrame([("a", "xlsx", raw)], "file string, suffix string, content binary")).first()
    assert row.html == "<table><caption>S</caption><tr><td>no</td><td>1e999</td><td>2.5</td></tr></table>"


def test_marks_of_runs_without_properties(spark):
    body = f'<w:document {io_queries._NS}><w:body><w:p><w:r><w:b/><w:t>Bold</w:t></w:r><w:r><w:t> and </w:t></w:r><w:r><w:rPr><w:i/></w:rPr><w:t>slanted</w:t></w:r></w:p></w:body></w:document>'
    raw = io_queries.package({"word/document.xml": body})
    rows = ooxml.blocks(spark.createDataFrame([("a", "docx", raw)], "file string, suffix string, content binary"))
    from quillspark.operators import office

    assert office.markdown(rows).first().markdown == "**Bold** and *slanted*\n"


def test_control_characters_are_text(spark):
    span = F.transform(text.inline_spans(F.col("t")), lambda s: F.concat(s["type"], F.lit("|"), s["content"]))
    assert one(spark, span, t="a\u0001b \\(x\\) c\u0001 \\(y\\)") == ["text|a\u0001b ", "inline_equation|x", "text| c\u0001 ", "inline_equation|y"]
    assert one(spark, tables.otsl_to_html(F.col("t")), t="<fcel>a\u0001b<fcel>c<nl>") == "<table><tr><td>a\u0001b</td><td>c</td></tr></table>"


def test_request_bodies(spark):
    df = spark.createDataFrame([("table", b"png"), ("text", None)], "kind string, png binary").coalesce(1)
    bodies = [json.loads(r.b) for r in df.select(model_stage.request_body(F.col("kind"), F.lit('m"1'), F.col("png"), F.lit(7)).alias("b")).collect()]
    assert bodies[0]["messages"] == [{"role": "system", "content": model_stage.SYSTEM_PROMPT}, {"role": "user", "content": [{"type": "image_url", "image_url": {"url": "data:image/png;base64,cG5n"}}, {"type": "text", "text": "\nTable Recognition:"}]}]
    assert bodies[1]["messages"][1]["content"] == [{"type": "text", "text": "\nText Recognition:"}] and bodies[0]["model"] == 'm"1' and bodies[0]["priority"] == 7


def test_http_transport():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Server(BaseHTTPRequestHandler):
        def answer(self, status, raw):
            self.send_response(status)
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self):
            self.answer(200, b'{"data":[{"id":"one"}]}')

        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            self.answer(503 if body == b"busy" else 200, b'{"error":{"message":"later","type":"server_error"}}' if body == b"busy" else b"got " + body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    call = model_stage.http_transport(url, "key", 5)
    assert call("hello") == "got hello" and model_stage.model_name(url) == "one" and model_stage.model_name(url, " mine ") == "mine"
    with pytest.raises(model_stage.Failed) as e:
        call("busy")
    assert e.value.status == 503 and e.value.again() and str(e.value) == "later"
    server.shutdown()
    assert model_stage.model_name(url) == "one"  # asked for once
    with pytest.raises(model_stage.Failed) as e:
        model_stage.http_transport("http://127.0.0.1:1", seconds=2)("x")
    assert e.value.status is None


def test_first_failure_ends_the_job(spark):
    df = spark.createDataFrame([(1, "bad")], "i int, body string")
    with pytest.raises(Exception, match="no"):
        model_stage.send(df, Flaky(0), fail_fast=True).collect()
    assert model_stage.send(df, Flaky(0), most_in_flight=8).count() == 1


def test_long_style_chains_and_cycles(spark):
    from quillspark.operators import office

    rows = [(f"s{i}", f"s{i + 1}" if i < 99 else None, 3 if i == 99 else None, i == 99) for i in range(100)] + [("x", "y", None, False), ("y", "x", 2, True), ("lost", "nowhere", None, False)]
    got = {r.style_id: (r.level, r.is_list) for r in office.resolve_styles(spark.createDataFrame(rows, "style_id string, based_on string, level int, is_list boolean")).collect()}
    assert got == {f"s{i}": (3, True) for i in range(100)} | {"x": (2, True), "y": (2, True), "lost": (None, False)}


def test_folders_of_clusters(spark):
    from quillspark import session

    class Conf(dict):
        def set(self, k, v):
            self[k] = v

    class Session:
        conf = Conf({"spark.master": "spark://host:7077"})

    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_folder(Session)
    Session.conf["spark.master"] = "local[2]"
    assert session.shared_folder(Session) == session.shared_folder(Session)


def test_repeated_cells_and_single_cells(spark):
    rows = [("a", "docx", io_queries.docx_package("T", [], "A", "")), ("b", "xlsx", io_queries.xlsx_package("s", [" "]))]
    got = {r.file: (r.kind, r.html, r.content) for r in ooxml.blocks(spark.createDataFrame(rows, "file string, suffix string, content binary"), repeated_cells=True).where("kind in ('table', 'text')").collect()}
    assert got == {"a": ("table", "<table><tr><td>A A</td><td></td></tr></table>", None), "b": ("text", None, "0")}


class Flaky:
    def __init__(self, failures):
        self.left = failures

    def __call__(self, body):
        if self.left:
            self.left -= 1
            raise model_stage.Failed("busy", 500)
        if "bad" in body:
            raise model_stage.Failed("no", 400)
        return body


def test_model_stage(spark):
    df = spark.createDataFrame([(1, "ok"), (2, "bad")], "i int, body string").coalesce(1)
    got = {r.i: (r.response, r.failure) for r in model_stage.send(df, Flaky(1), threads=1).collect()}
    assert got == {1: ("ok", None), 2: (None, "no")}


def test_sinks(spark, tmp_path):
    results = spark.createDataFrame([("t1", "a", "vlm", "# é", "{}"), ("t1", "b", "office", None, None)], "task_id string, stem string, subdir string, markdown string, middle_json string")
    arts = sinks.artifacts(results)
    made = sinks.write_zips(arts, str(tmp_path / "z")).collect()
    import zipfile

    with zipfile.ZipFile(made[0].path) as z:
        infos = z.infolist()
        assert [i.filename for i in infos] == ["a/vlm/a.md", "a/vlm/a_middle.json"] and all(i.compress_type == zipfile.ZIP_STORED for i in infos)
        assert z.read("a/vlm/a.md").decode() == "# é"
    manifest = {r.rel_path: (r.size, r.crc32, r.offset) for r in sinks.zip_manifest(arts).collect()}
    assert manifest == {i.filename: (i.file_size, i.CRC, i.header_offset) for i in infos}
    body = json.loads(sinks.result_json(results, "vlm", "1", {"markdown": True}).first().body)
    assert body == {"backend": "vlm", "version": "1", "results": {"a": {"md_content": "# é"}, "b": {"md_content": None}}}
    shown = {r.rel_path: r.content for r in sinks.pretty(spark.createDataFrame([("a.json", '{"é":[1,{"b":[]}]}'), ("b.json", "no"), ("c.md", "{}"), ("d.json", None)], "rel_path string, content string")).collect()}
    assert shown == {"a.json": '{\n  "é": [\n    1,\n    {\n      "b": []\n    }\n  ]\n}', "b.json": "no", "c.md": "{}", "d.json": None}
    assert sinks.write_documents(arts, str(tmp_path / "d")).count() == 2 and (tmp_path / "d/a/vlm/a.md").read_text() == "# é"


def test_uploads_and_stream(spark, tmp_path):
    for name in ("a.pdf", "b.txt", "c.png"):
        (tmp_path / name).write_bytes(b"12345")
    got = {r.name: (r.accepted, r.error) for r in files.uploads(spark, str(tmp_path), most_bytes=100).collect()}
    assert got == {"a.pdf": (True, None), "b.txt": (False, "Unsupported file type: txt"), "c.png": (True, None)}
    seen = []
    for _ in range(2):  # the second run finds nothing new
        ingest.run_available(ingest.file_stream(spark, str(tmp_path / "*.*")), str(tmp_path / "state" / "c"), lambda df, n: seen.extend(r.name for r in df.where("accepted").collect()))
    assert sorted(seen) == ["a.pdf", "c.png"]
    rows = files.pages(spark.read.format("binaryFile").load(str(tmp_path / "a.pdf")), lambda raw: len(raw), F.lit(1), F.lit(99), 2).collect()
    assert [(r.page_idx, r.window_id) for r in rows] == [(1, 0), (2, 0), (3, 1), (4, 1)]
    shown = files.rendered(spark.createDataFrame([("p", 0, b"x")], "path string, page_idx long, content binary"), lambda c, i: (c + b"!", 10, 20)).first()
    assert (bytes(shown.png), shown.page_w, shown.page_md5) == (b"x!", 10, hashlib.md5(b"x!").hexdigest().upper())


def test_result_json_has_whole_texts(spark, data_dir):
    out = io_queries.result_json(spark, data_dir)
    texts = spark.read.parquet(f"{data_dir}/documents.parquet").agg(F.sum(F.length("text"))).first()[0]
    assert sum(len(str(v)) for r in out.collect() for v in r) >= texts


def test_html_blocks_against_a_parser(spark, data_dir):
    """Headings, paragraphs and list items as a real parser of HTML sees them."""
    from html.parser import HTMLParser

    class Parser(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=False)
            self.found, self.open = [], None

        def close_block(self):
            if self.open:
                kind, parts = self.open
                content = re.sub(r"[ \t\n\x0b\f\r]+", " ", html_text("".join(parts))).strip()
                if content:
                    self.found.append((kind, content))
            self.open = None

        def handle_starttag(self, tag, attrs):
            if tag in ("h1", "p", "li"):
                self.close_block()
                self.open = ({"h1": "title", "li": "list"}.get(tag, "text"), [])

        def handle_endtag(self, tag):
            if tag in ("h1", "p", "li"):
                self.close_block()

        def handle_data(self, data):
            if self.open:
                self.open[1].append(data)

        def handle_entityref(self, name):
            self.handle_data(f"&{name};")

        def handle_charref(self, name):
            self.handle_data(f"&#{name};")

    def html_text(s):
        return s.replace("&lt;", "<").replace("&gt;", ">").replace("&quot;", '"').replace("&amp;", "&")

    from quillspark.plans import text_queries

    got = {}
    for r in text_queries.html_blocks(spark, data_dir).orderBy("page_id", "pos").collect():
        got.setdefault(r.page_id, []).append((r.type, r.content))
    for r in spark.read.parquet(f"{data_dir}/pages.parquet").collect():
        parser = Parser()
        parser.feed(r.html)
        assert got.get(r.page_id, []) == parser.found, r.page_id


def test_states_over_batches(spark, tmp_path):
    """State is kept between batches, a terminal one is never left, and late changes count for nothing."""
    batches = [[("a", 1, "pending", 1000), ("b", 1, "pending", 1005)], [("a", 2, "processing", 1060), ("b", 2, "failed", 1070)], [("a", 3, "completed", 1090), ("b", 3, "processing", 1095), ("a", 1, "failed", 1099)]]
    for i, rows in enumerate(batches):
        made = spark.createDataFrame([(t, n, s, x) for t, n, s, x in rows], "task_id string, seq long, status string, x long").select("task_id", "seq", "status", F.timestamp_seconds("x").alias("at"))
        made.coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
        seen = {}
        query = ingest.live_states(ingest.parquet_stream(spark, str(tmp_path / "in" / "*"), made.schema, 1)).select("task_id", "status", *[F.unix_seconds(c).alias(c) for c in ("created_at", "started_at", "completed_at")]).writeStream.outputMode("update").foreachBatch(lambda df, n: seen.update({r.task_id: tuple(r)[1:] for r in df.collect()})).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        want = [{"a": ("pending", 1000, None, None), "b": ("pending", 1005, None, None)}, {"a": ("processing", 1000, 1060, None), "b": ("failed", 1005, None, 1070)}, {"a": ("completed", 1000, 1060, 1090)}][i]
        assert seen == want
