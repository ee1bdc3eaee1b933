"""Plans over event tables of Office packages against the plain model, on hand-made and random packages."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from quillspark import session
from quillspark.functions import text
from quillspark.operators import office
from quillspark.operators import packages as rules
from quillspark.operators import tables
from quillspark.plans import io_queries as samples
from quillspark.sources import ooxml, xml_events

from . import plain_office as model

NS = samples._NS
KEYS = ("page_idx", "kind", "content", "level", "html", "path", "alt", "items", "discarded", "reason", "spans", "item_spans", "error")


def plain(v):
    if isinstance(v, dict):
        return tuple(v[k] for k in ("type", "content", "url", "style"))
    if hasattr(v, "asDict"):
        return tuple(v)
    return [plain(x) for x in v] if isinstance(v, list) else v


def compare(spark, named, repeated=False):
    rows = [(f"f{i}", s, raw) for i, (s, raw) in enumerate(named)]
    got = {f: [] for f, *_ in rows}
    for r in ooxml.blocks(spark.createDataFrame(rows, "file string, suffix string, content binary").repartition(3), repeated).collect():
        got[r.file].append((r.idx, [plain([r[k]])[0] for k in KEYS]))
    for file, suffix, raw in rows:
        want = [(b["idx"], [plain([b.get(k)])[0] for k in KEYS]) for b in model.blocks(suffix, raw, repeated)]
        assert [x[0] for x in sorted(got[file])] == [x[0] for x in want], (file, raw)
        for (i, a), (_, b) in zip(sorted(got[file], key=lambda x: x[0]), want, strict=True):
            assert a == b, (file, suffix, i)


class Words:
    """Random document bodies: nested tables, text boxes, links, runs, formulas, images that are there or not, odd places."""

    def __init__(self, seed):
        self.rng = random.Random(seed)

    def say(self):
        return self.rng.choice(["one", " two ", "a &amp; b", "", "  ", "&lt;x&gt;", "\n", "é日本", "x" * 30])

    def run(self, deep=0):
        r = self.rng
        marks = "".join(f"<w:{m}/>" for m in ("b", "i", "u", "strike", "color") if r.random() < 0.25)
        inner = r.choice(["<w:tab/>", "<w:br/>", "<w:cr></w:cr>", '<a:blip r:embed="rId1"/>', '<v:imagedata r:id="rId3"/>', '<a:blip r:embed="rId9"/>', '<a:blip r:embed="rId7"/>', "<a:blip/>", '<w:drawing><a:blip r:embed="rId4"></a:blip></w:drawing>']) if r.random() < 0.25 else f"<w:t>{self.say()}</w:t>"
        if deep < 2 and r.random() < 0.08:
            inner += f"<w:pict><w:txbxContent>{self.paragraph(deep + 1)}{self.table(deep + 1)}</w:txbxContent></w:pict><w:t>after</w:t>"
        return f"<w:r>{r.choice([f'<w:rPr>{marks}</w:rPr>', marks, '<w:rPr/>'])}{inner}</w:r>"

    def paragraph(self, deep=0):
        r = self.rng
        props = r.choice(["", "", "", '<w:pStyle w:val="Heading2"/>', '<w:pStyle w:val="MyList"/>', '<w:numPr><w:ilvl w:val="1"/></w:numPr>', '<w:outlineLvl w:val="3"/>', '<w:pStyle w:val="Deep"/><w:rPr><w:b/></w:rPr>', '<w:pStyle w:val="Loop"/><w:outlineLvl w:val="x"/>', '<w:pStyle w:val="Title"/>', '<w:pStyle w:val=""/>', '<w:outlineLvl w:val="77777777777777"/>'])
        body = ""
        for _ in range(r.randrange(5)):
            kind = r.random()
            if kind < 0.15:
                body += f'<w:hyperlink r:id="{r.choice(["rId2", "rId9", "rId5"])}">{self.run(deep)}{"<w:t>bare</w:t>" if r.random() < 0.3 else ""}</w:hyperlink>'
            elif kind < 0.3:
                body += f"<m:oMath><m:r><m:t>{self.say()}</m:t><m:t>x</m:t></m:r></m:oMath>"
            elif kind < 0.35:
                body += "<w:smartTag><w:r><w:t>smart</w:t></w:r></w:smartTag><w:t>bare</w:t>"
            else:
                body += self.run(deep)
        return f"<w:p>{f'<w:pPr>{props}</w:pPr>' if props else ''}{body}</w:p>" if body or props else "<w:p/>"

    def table(self, deep=0):
        r, rows = self.rng, ""
        for _ in range(r.randrange(4)):
            cells = ""
            for _ in range(r.randrange(4)):
                inner = "".join(self.table(deep + 1) if deep < 2 and r.random() < 0.2 else self.paragraph(deep) for _ in range(r.randrange(3)))
                cells += r.choice([f"<w:tc>{inner}</w:tc>", f"<w:tc><w:tcPr/>{inner}</w:tc>", f"<w:tc><w:sdt><w:sdtContent>{inner}</w:sdtContent></w:sdt></w:tc>", "<w:tc/>"])
            if r.random() < 0.1:
                cells = f"<w:sdt>{cells}</w:sdt>{self.paragraph(deep)}"
            rows += f"<w:tr>{cells}</w:tr>" if cells else r.choice(["<w:tr/>", "<w:tr></w:tr>", self.paragraph(deep)])
            if r.random() < 0.05:
                rows = f"<w:sdt>{rows}</w:sdt>"
        return f"<w:tbl><w:tblPr/>{rows}</w:tbl>" if r.random() < 0.9 else "<w:tbl/>"

    def docx(self):
        r = self.rng
        body = "".join(self.table() if r.random() < 0.3 else f"<w:sdt>{self.paragraph()}</w:sdt>" if r.random() < 0.1 else self.paragraph() for _ in range(r.randrange(9)))
        styles = '<w:styles xmlns:w="w"><w:style w:styleId="Base"><w:name w:val="heading 4"/></w:style><w:style w:styleId="deep"><w:name w:val="x"/><w:basedOn w:val="Mid"/></w:style><w:style w:styleId="Mid"><w:basedOn w:val="BASE"/><w:pPr><w:numPr/></w:pPr></w:style><w:style w:styleId="Loop"><w:basedOn w:val="Loop2"/></w:style><w:style w:styleId="Loop2"><w:basedOn w:val="Loop"/><w:pPr><w:outlineLvl w:val="1"/></w:pPr></w:style><w:style/></w:styles>'
        parts = {"word/document.xml": f'<w:document {NS} xmlns:v="v"><w:body>{body}</w:body></w:document>', "word/media/i.png": samples.PNG, "word/media/v.emf": b"vec", "word/media/bad.png": b"nothing"}
        parts["word/_rels/document.xml.rels"] = samples.rels(("rId1", "image", "media/i.png", False), ("rId2", "hyperlink", "http://a/?b=1&amp;c", True), ("rId3", "image", "/word/media/v.emf", False), ("rId4", "image", "media/bad.png", False), ("rId5", "hyperlink", "x", True), ("rId5", "hyperlink", "y", True), ("rId7", "image", "../gone.png", False))
        if r.random() < 0.7:
            parts["word/styles.xml"] = styles
        return samples.package(parts)

    def pptx(self):
        r = self.rng

        def shape(deep=0):
            frame = r.choice(["", "", "<a:xfrm/>"]) if r.random() < 0.3 else f'<p:spPr><a:xfrm><a:off x="{r.randrange(-5, 60)}" y="{r.choice([0, 3, 3, 77, "z"])}"/><a:ext cx="{r.choice([5, 200000, 9000000])}" cy="{r.choice([5, 200000, 5100000])}"/></a:xfrm></p:spPr>'
            lines = "".join(f"<a:p>{''.join(f'<a:r><a:t>{self.say()}</a:t></a:r>' for _ in range(r.randrange(3)))}</a:p>" for _ in range(r.randrange(3)))
            kind = r.random()
            if kind < 0.2:
                return f'<p:pic>{frame}<p:blipFill><a:blip r:embed="{r.choice(["rId5", "rId6", "rId99"])}"/></p:blipFill></p:pic>'
            if kind < 0.4:
                grid = "".join(f"<a:tr>{''.join(f'<a:tc><a:txBody>{lines}</a:txBody></a:tc>' for _ in range(r.randrange(3)))}</a:tr>" for _ in range(r.randrange(3)))
                return f"<p:graphicFrame>{frame}<a:tbl>{grid}</a:tbl></p:graphicFrame>"
            if kind < 0.5:
                return f"<p:graphicFrame>{frame}<c:chart xmlns:c='c'>{lines}</c:chart></p:graphicFrame>"
            if kind < 0.6 and deep < 2:
                return f"<p:grpSp>{shape(deep + 1)}{shape(deep + 1)}</p:grpSp>"
            return f"<p:sp>{frame}<p:txBody>{lines}</p:txBody></p:sp>" if kind < 0.95 else "<p:sp/>"

        slides = {f"ppt/slides/slide{i}.xml": f"<p:sld {NS}><p:cSld><p:spTree>{''.join(shape() for _ in range(r.randrange(5)))}</p:spTree></p:cSld></p:sld>" for i in range(1, 4)}
        order = "".join(f'<p:sldId id="{i}" r:id="rId{i}"/>' for i in r.sample([1, 2, 3, 8], r.randrange(4)))
        parts = {"ppt/presentation.xml": f'<p:presentation {NS}><p:sldSz cx="9144000" cy="5143500"/><p:sldIdLst>{order}</p:sldIdLst></p:presentation>', "ppt/_rels/presentation.xml.rels": samples.rels(*((f"rId{i}", "slide", f"slides/slide{i}.xml", False) for i in (1, 2, 3)))} | slides
        for i in (1, 2):
            parts[f"ppt/slides/_rels/slide{i}.xml.rels"] = samples.rels(("rId1", "notesSlide", "../notesSlides/n1.xml", i == 2), ("rId5", "image", "../media/i.png", False), ("rId6", "image", "../media/v.wmf", False))
        return samples.package(parts | {"ppt/notesSlides/n1.xml": f"<p:notes {NS}><a:t>{self.say()}</a:t><a:t> n </a:t></p:notes>", "ppt/media/i.png": samples.PNG, "ppt/media/v.wmf": b"v"})

    def xlsx(self):
        r = self.rng
        place = lambda: f"{r.choice('BCDEF')}{r.randrange(2, 7)}"

        def sheet():
            cells = ""
            for _ in range(r.choice([0, 1, 1, 6, 12])):
                kind = r.random()
                at = r.choice([place(), "$" + place(), "aa3"])
                if kind < 0.3:
                    cells += f'<c r="{at}" t="s"><v>{r.choice([0, 1, 2, 9, "x"])}</v></c>'
                elif kind < 0.5:
                    cells += f'<c r="{at}" t="inlineStr"><is><t>{self.say()}</t></is></c>'
                elif kind < 0.6:
                    cells += f'<c r="{at}" t="b"><v>{r.choice([0, 1])}</v></c>'
                elif kind < 0.9:
                    cells += f'<c r="{at}"><v>{r.choice(["1", "2.0", "0.1", "-3.5", "1e3", "12345678.25", "1E-7", "x", "", "0", "1e20"])}</v></c>'
                else:
                    cells += r.choice([f'<c r="{at}"/>', "<c><v>1</v></c>", f'<c r="{at}" t="str"><f>A1</f><v> s </v></c>'])
            merges = "".join(f'<mergeCell ref="{a}{x}:{b}{y}"/>' for a, x, b, y in r.sample([("B", 2, "C", 2), ("D", 3, "D", 5), ("E", 2, "F", 3), ("A", 1, "B", 3), ("C", 4, "C", 4), ("E", 5, "H", 9)], r.randrange(4)))
            return f"<worksheet><sheetData><row>{cells}</row></sheetData><mergeCells>{merges}</mergeCells></worksheet>"

        listed = "".join(f'<sheet name="S&amp;{i}" sheetId="{i}" {r.choice(["", "", "state=" + chr(34) + "hidden" + chr(34)])} r:id="rId{i}"/>' for i in (2, 1, 3, 9))
        parts = {"xl/workbook.xml": f"<workbook {NS}><sheets>{listed}</sheets></workbook>", "xl/_rels/workbook.xml.rels": samples.rels(*((f"rId{i}", "worksheet", f"worksheets/sheet{i}.xml", False) for i in (1, 2, 3)))}
        parts |= {f"xl/worksheets/sheet{i}.xml": sheet() for i in (1, 2, 3)} | {"xl/media/i.png": samples.PNG, "xl/worksheets/_rels/sheet2.xml.rels": samples.rels(("rId1", "drawing", "../drawings/d1.xml", False)), "xl/drawings/_rels/d1.xml.rels": samples.rels(("rId1", "image", "../media/i.png", False), ("rId2", "image", "../media/gone.png", False))}
        if r.random() < 0.8:
            parts["xl/sharedStrings.xml"] = "<sst><si><t>head</t></si><si/><si><r><t>a</t></r><r><t>&lt;b</t></r></si></sst>"
        return samples.package(parts)


@pytest.mark.parametrize("kind, seeds", [("docx", range(100)), ("pptx", range(60)), ("xlsx", range(80))])
def test_random_packages(spark, kind, seeds):
    compare(spark, [(kind, getattr(Words(i), kind)()) for i in seeds])


def test_repeated_cells(spark):
    compare(spark, [("docx", Words(1000 + i).docx()) for i in range(30)], repeated=True)


def test_bad_packages(spark):
    good = samples.docx_package("T", ["a b"], "c")
    cut = samples.package({"word/document.xml": "<w:document xmlns:w='w'><w:body><w:p>"})
    ref = samples.package({"xl/workbook.xml": f'<workbook {NS}><sheets><sheet name="s" r:id="rId1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": samples.rels(("rId1", "worksheet", "worksheets/sheet1.xml", False)), "xl/worksheets/sheet1.xml": '<worksheet><c r="7B"><v>1</v></c></worksheet>'})
    rows = [("good", "docx", good), ("cut", "docx", cut), ("none", "docx", samples.package({"x.xml": "<a/>"})), ("zip", "pptx", b"PK"), ("slides", "pptx", samples.package({"x.xml": "<a/>"})), ("book", "xlsx", samples.package({"x.xml": "<a/>"})), ("ref", "xlsx", ref)]
    got = {}
    for r in ooxml.blocks(spark.createDataFrame(rows, "file string, suffix string, content binary")).collect():
        got.setdefault(r.file, []).append((r.kind, r.error))
    assert len(got.pop("good")) == 5 and all(len(x) == 1 and x[0][0] == "error" for x in got.values())
    said = {f: x[0][1] for f, x in got.items()}
    assert said["none"] == "missing word/document.xml" and said["slides"] == "missing ppt/presentation.xml" and said["book"] == "missing xl/workbook.xml" and said["ref"] == "bad cell reference 7B"
    assert said["cut"].startswith("cannot read word/document.xml") and said["zip"].startswith("not a ZIP package")
    assert ooxml.blocks(spark.createDataFrame([], "file string, suffix string, content binary")).collect() == []


def test_events_are_intervals(spark):
    raw = b'<a x="1" xmlns:n="n"><b n:y="2">t<c/>u</b><b/>tail<d>one<!-- c --> two<![CDATA[<&]]></d></a>'
    rows = xml_events.events(spark.createDataFrame([("f", "p", raw), ("f", "q", b"<a><b></a>")], "file string, part_name string, content binary")).where("part = 'p'").orderBy("pos").collect()
    assert [(r.pos, r.open, r.leaf, r.start, r.parent, r.depth, r.name) for r in rows] == [(0, True, False, 0, None, 0, "a"), (1, True, False, 1, 0, 1, "b"), (2, True, True, 2, 1, 2, "c"), (3, False, False, 1, 0, 1, "b"), (4, True, True, 4, 0, 1, "b"), (5, True, True, 5, 0, 1, "d"), (6, False, False, 0, None, 0, "a")]
    assert rows[0].attrs == {"x": "1"} and rows[1].attrs == {":y": "2"} and rows[1].text == "t" and rows[5].text == "one two<&"
    assert [r.parent_name for r in rows] == [None, "a", "b", "a", "a", "a", None]


def test_inline_markup(spark):
    rng = random.Random(1)
    bits = ["<eq>", "</eq>", "<text>", '<text style="bold">', '<text style=" bold , italic,">', "</text>", "<hyperlink>", "</hyperlink>", "<url>", "</url>", "a", "b &amp; c", " ", "<", ">", "&lt;x", "\n", "<textual", "é😀", 'style="x"', "\xa0"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(4000)]
    texts += [f"<hyperlink><text>{x}</text><url>u</url></hyperlink>" for x in texts[:1000]] + ["x" * 300_000 + "<eq>" + "y" * 300_000 + "</eq>" + "<text>" * 50_000, "<a>" * 100_000, '<text style="bold">a</text>' * 3000, ""]
    got = {r.i: plain(r.s) for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", text.markup_spans(F.col("t")).alias("s")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain(model.inline_spans(t)), t[:200]
    assert spark.sql("select cast(null as string) t").select(text.markup_spans(F.col("t")).alias("s")).first().s is None


def test_numbers_and_references(spark):
    rows = [("A1", "1"), ("$C$10", "2.50"), ("AA2", "1e-7"), ("XFD1048576", "-0.0"), ("7B", "x"), ("A", "1e400"), ("", "NaN"), ("B0", " 5 ")]
    got = spark.createDataFrame(rows, "ref string, v string").select(rules.cell_place(F.col("ref")).alias("p"), rules.number_text(F.col("v")).alias("v")).collect()
    assert [tuple(r.p) if r.p else None for r in got] == [(0, 0), (9, 2), (1, 26), (1048575, 16383), None, None, None, (-1, 1)]
    assert [r.v for r in got] == ["1", "2.5", "0.0000001", "-0", "x", "1e400", "NaN", "5"]


def test_merge_of_a_whole_sheet(spark):
    """A merge over 1.6e10 cells is taken apart by rows only; cells outside of it stay, its anchor has the spans."""
    rows = 1_000_000
    cells = spark.range(rows).select(F.lit(1).alias("sheet"), F.col("id").cast("int").alias("row"), (F.col("id") % 3).cast("int").alias("col"), F.lit("x").alias("text"))
    merges = spark.createDataFrame([(1, 0, 1, rows - 1, 16_383), (1, 5, 0, 5, 1)], "sheet int, m_r0 int, m_c0 int, m_r1 int, m_c1 int")
    left = tables.sheet_cells(cells, merges, ["sheet"])
    assert left.count() == (rows + 2) // 3 and left.where("rowspan > 1 or colspan > 1").count() == 0
    found = tables.sheet_cells(cells.where("row < 9"), merges.where("m_r0 = 0").unionByName(merges.limit(0)), ["sheet"]).select("row", "col", "rowspan", "colspan").collect()
    assert sorted(map(tuple, found)) == [(0, 0, 1, 1), (3, 0, 1, 1), (6, 0, 1, 1)]


def test_markdown_in_segments(spark, data_dir):
    """Segments follow each other without a gap, and are together what the one-level form gives."""
    from quillspark.operators import render
    from quillspark.plans import structure_queries

    blocks = structure_queries.assembled(spark, data_dir)
    want = {r.doc: r.markdown for r in render.markdown(blocks, ["doc"], ["page_idx", "idx"]).collect()}
    for most in (1, 500, 1 << 20):
        got = {}
        for r in sorted(render.markdown_segments(blocks, ["doc"], ["page_idx", "idx"], most).collect(), key=lambda r: (r.doc, r.segment)):
            assert r.at == len(got.setdefault(r.doc, "")) and r["size"] == len(r.text)
            got[r.doc] += r.text
        assert got == want


def test_written_once(spark, tmp_path):
    import shutil

    from quillspark import session

    made = []

    def make():
        made.append(1)
        return spark.range(3)

    assert session.once(spark, "t", str(tmp_path), make).count() == session.once(spark, "t", str(tmp_path), make).count() == 3 and len(made) == 1
    shutil.rmtree(next(path for (_, name, source), (path, _) in session._kept.items() if source == str(tmp_path)).removeprefix("file:"))
    assert session.once(spark, "t", str(tmp_path), make).count() == 3 and len(made) == 2


def _tables(spark):
    folder = f"{session.shared_folder(spark)}/quillspark".removeprefix("file:")
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {x for x in (files.apply(i).getName() for i in range(files.size())) if x.startswith("shuffle_")}


def test_disk_of_blocks(spark, data_dir, tmp_path):
    """Of all tables and shuffles on the way to the blocks of packages, only the table of the blocks stays."""
    os.symlink(f"{data_dir}/documents.parquet", tmp_path / "documents.parquet")
    tables, files = _tables(spark), _shuffle_files(spark)
    items = samples.ooxml_content_list(spark, str(tmp_path))
    assert len(_tables(spark) - tables) == 1
    assert not _shuffle_files(spark) - files
    assert items.count() == samples.ooxml_blocks(spark, str(tmp_path)).where("kind <> 'discarded'").count() > 0


def test_middle_json_in_one_exchange(spark):
    """Pages are put together where the blocks of their file are: the wide rows are not dealt again."""
    rows = spark.createDataFrame([("a", 0, 0, "equation", "x"), ("a", 1, 1, "equation", "y"), ("b", 0, 0, "warning", "w")], "file string, page_idx int, idx int, kind string, content string")
    blocks = rows.selectExpr("*", "cast(null as int) level", *[f"cast(null as string) {c}" for c in ("html", "path", "alt", "reason")], "cast(array() as array<struct<type:string,content:string,url:string,style:array<string>>>) spans", "cast(array() as array<array<struct<type:string,content:string,url:string,style:array<string>>>>) item_spans")
    found = office.middle_json(blocks)
    assert str(found._jdf.queryExecution().executedPlan()).count("Exchange hashpartitioning") == 1
    assert [(r.file, [p["para_blocks"][0]["lines"][0]["spans"][0]["content"] for p in json.loads(r.middle_json)["pdf_info"]]) for r in found.collect()] == [("a", ["x", "y"])]
