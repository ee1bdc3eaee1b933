"""Text functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, as a regular expression class that Java and RE2 both read.
WS = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
TRIM = f"^[{WS}]+|[{WS}]+$"
#: The same as a list of characters.
SPACES = "".join(map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
CJK = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]"
#: A text of exactly this address counts as CJK context. Fixed value.
CJK_ADDRESS = "usz@google.com"
PREFIX = r"^([ \t]{0,3})(#{1,6}[ \t]|[+-][ \t])"


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also inside of lambdas, where repeated expressions are evaluated each time."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def trim(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.btrim(c, F.lit(SPACES))


def blank(c: Column) -> Column:
    return trim(c) == ""


def replace(c: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def html_escape(c: Column) -> Column:
    return replace(c, ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))


def html_unescape(c: Column) -> Column:
    return replace(c, ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&"))


def md_escape(c: Column) -> Column:
    """A backslash before * _ ` ~ $ unless an odd run of backslashes stands there."""
    return F.regexp_replace(c, r"(?<!\\)((?:\\\\)*)([*_`~$])", r"$1\\$2")


def prefix_escape(c: Column) -> Column:
    """A backslash before a heading or list marker at the start of the text."""
    return F.regexp_replace(c, PREFIX, r"$1\\$2")


def is_cjk(c: Column) -> Column:
    return c.rlike(CJK) | (trim(c) == CJK_ADDRESS)


def starts_lowercase(c: Column) -> Column:
    return c.rlike(r"^\p{IsLowercase}")


def drop_prefix(c: Column, prefix: str) -> Column:
    return F.when(c.startswith(prefix), F.substr(c, F.lit(len(prefix) + 1))).otherwise(c)


def clean_equation(c: Column) -> Column:
    r"""Without \[ and \]. Where the suffix is missing, the trimmed text comes back whole, prefix included."""
    inner = trim(c)
    opened = drop_prefix(inner, "\\[")
    return trim(F.when(opened.endswith("\\]"), F.left(opened, F.length(opened) - 2)).otherwise(inner))


def bracket_equation(c: Column) -> Column:
    inner = trim(c)
    opened = F.when(inner.startswith("\\["), inner).otherwise(F.concat(F.lit("\\[\n"), inner))
    return F.when(opened.endswith("\\]"), opened).otherwise(F.concat(opened, F.lit("\n\\]")))


def clean_image_content(c: Column) -> Column:
    inner = trim(c)
    return F.when(inner.contains("<fcel>"), F.lit("")).otherwise(inner)


def clean_text(kind: Column, c: Column) -> Column:
    plain = replace(c, ("\\[", "["), ("\\]", "]"))
    lines = F.transform(F.split(F.regexp_replace(plain, r"\r?\n$", ""), r"\r?\n"), lambda x: trim(x))
    return F.when(kind == "title", F.array_join(lines, " ")).otherwise(plain)


def embed_equations(c: Column) -> Column:
    """<eq>x</eq> as inline mathematics, its entities decoded."""
    parts = F.split(c, r"<eq>")
    tail = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), _embedded)
    return F.concat(F.element_at(parts, 1), F.array_join(tail, ""))


def _embedded(part: Column) -> Column:
    at = F.instr(part, "</eq>")
    inner = F.left(part, at - 1)
    fine = (at > 0) & ~inner.contains("\n")
    return F.when(fine, F.concat(F.lit(" $"), html_unescape(inner), F.lit("$ "), F.substr(part, at + 5))).otherwise(F.concat(F.lit("<eq>"), part))


def media_path(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit("images/"), c))


def office_embedded_html(c: Column) -> Column:
    html = replace(c, ("<eq>", " $"), ("</eq>", "$ "))
    return F.regexp_replace(html, r'src="(?!data:|http://|https://|images/)([^"]+)"', 'src="images/$1"')


def office_escape(c: Column) -> Column:
    return replace(c, ("\\", "\\\\"), ("[", "\\["), ("]", "\\]"), ("_", "\\_"))


def link_text(c: Column) -> Column:
    return replace(c, ("[", "\\["), ("]", "\\]"))


def link_target(c: Column) -> Column:
    return replace(c, (")", "%29"), (" ", "%20"))


def styled(c: Column, styles: Column) -> Column:
    """Markdown of a text with styles; bold is the innermost mark, then italic, underline, strikethrough."""
    for style, before, after in (("bold", "**", "**"), ("italic", "*", "*"), ("underline", "<u>", "</u>"), ("strikethrough", "~~", "~~")):
        c = F.when(F.array_contains(styles, style), F.concat(F.lit(before), c, F.lit(after))).otherwise(c)
    return c


def inline_spans(c: Column) -> Column:
    r"""Text and \( \) spans: array of (type, content). Blank text is dropped, text is kept untrimmed, equations are trimmed."""
    pattern = r"\\\(([^\n]+?)\\\)"
    span = lambda kind, x: F.struct(F.lit(kind).alias("type"), x.alias("content"))
    # one text more than equations: the last pair has a null, which goes as blank texts do
    pairs = F.zip_with(F.split(c, pattern), F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), lambda x, e: F.array(span("text", F.when(~blank(x), x)), span("inline_equation", trim(e))))
    return F.filter(F.flatten(pairs), lambda s: s["content"].isNotNull())


#: Texts with tags as tokens: whole tags, what stands between, and from a tag without end on the rest. A text of any length is read without backtracking.
MARKUP = r"(?s)<eq>.*?</eq>|<text[^>]*+>.*?</text>|<hyperlink>.*?</hyperlink>|[^<]++|<(?!eq>|hyperlink>|text)|.+"
_WORDS, _URL = r"(?s)^<text[^>]*>(.*?)</text>", r"(?s)<url>(.*?)</url>"


def markup_spans(c: Column) -> Column:
    """Spans (type, content, url, style) of a text with eq, text and hyperlink tags, entities decoded.

    A tag without its end, or a link without words or address, makes the rest
    of the text plain. Neighbouring texts of one style are joined. Null: null.
    """
    inner = lambda t: F.substr(t, F.lit(len("<hyperlink>") + 1), F.length(t) - len("<hyperlink></hyperlink>"))
    unfit = lambda t: t.startswith("<hyperlink>") & ~(t.endswith("</hyperlink>") & inner(t).rlike(_WORDS) & inner(t).rlike(_URL))
    mark = lambda t, plain: F.struct(t.alias("t"), plain.alias("plain"))

    def cut(tokens: Column) -> Column:
        at = F.array_position(F.transform(tokens, unfit), True).cast("int")
        own = F.transform(tokens, lambda t: mark(t, F.lit(False)))
        rest = F.array(mark(F.array_join(F.slice(tokens, at, F.size(tokens)), ""), F.lit(True)))
        return let(at, lambda a: F.when(a == 0, own).otherwise(F.concat(F.slice(own, 1, a - 1), rest)))

    def styles(tag: Column) -> Column:
        return F.filter(F.transform(F.split(F.regexp_extract(F.regexp_extract(tag, r"^(<text[^>]*>)", 1), r'style="([^"]*)"', 1), ","), trim), lambda x: x != "")

    none = F.array().cast("array<string>")
    span = lambda kind, content, url=F.lit(None).cast("string"), style=none: F.struct(F.lit(kind).alias("type"), html_unescape(content).alias("content"), url.alias("url"), style.alias("style"))

    def one(x: Column) -> Column:
        t = x["t"]
        return (
            F.when(~x["plain"] & t.rlike("(?s)^<eq>.*</eq>$"), span("equation_inline", trim(F.substr(t, F.lit(5), F.length(t) - 9))))
            .when(~x["plain"] & t.rlike("(?s)^<text[^>]*>.*</text>$"), span("text", F.regexp_extract(t, _WORDS, 1), style=styles(t)))
            .when(~x["plain"] & t.startswith("<hyperlink>"), span("hyperlink", F.regexp_extract(inner(t), _WORDS, 1), html_unescape(F.regexp_extract(inner(t), _URL, 1)), styles(inner(t))))
            .otherwise(span("text", t))
        )

    def joined(spans: Column) -> Column:
        same = lambda a, b: (a["type"] == "text") & (b["type"] == "text") & (a["style"] == b["style"])
        at = F.filter(F.sequence(F.lit(1), F.size(spans)), lambda i: (i == 1) | ~same(F.get(spans, i - 2), F.get(spans, i - 1)))
        run = lambda b, e: let(F.get(spans, b - 1), lambda s: F.struct(s["type"].alias("type"), F.array_join(F.transform(F.slice(spans, b, e - b), lambda x: x["content"]), "").alias("content"), s["url"].alias("url"), s["style"].alias("style")))
        ends = lambda a: F.zip_with(a, F.concat(F.slice(a, 2, F.size(a)), F.array(F.size(spans) + 1)), run)
        return F.when(F.size(spans) == 0, spans).otherwise(let(at, ends))

    return let(let(let(F.regexp_extract_all(c, F.lit(MARKUP), F.lit(0)), cut), lambda x: F.transform(x, one)), joined)


def has_inline_equations(c: Column) -> Column:
    return c.contains("\\(") & (F.regexp_count(c, F.lit(r"\\\(")) == F.regexp_count(c, F.lit(r"\\\)")))


def base_name(c: Column) -> Column:
    return F.substring_index(F.regexp_replace(c, r"/+$", ""), "/", -1)


def file_stem(c: Column) -> Column:
    """The name without its last extension; a leading dot does not begin one."""
    return F.regexp_replace(c, r"(?<=.)\.[^.]*$", "")


def file_suffix(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"(?<=.)\.([^.]*)$", 1))


def utf8_truncate(c: Column, most: int) -> Column:
    """At most so many UTF-8 bytes, cut at a character."""
    raw = c.cast("binary")
    cuts = [F.try_validate_utf8(F.substring(raw, 1, most - k).cast("string")) for k in range(4)]
    return F.when(F.octet_length(c) <= most, c).otherwise(F.coalesce(*cuts))


def data_uri(mime: Column, raw: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(raw))


#: Media types by file extension; anything else is a JPEG.
MIME = {"png": "image/png", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp", "svg": "image/svg+xml", "jpg": "image/jpeg", "jpeg": "image/jpeg"}


def mime_type(name: Column) -> Column:
    suffix, out = file_suffix(name), F.lit("image/jpeg")
    for ext, mime in MIME.items():
        out = F.when(suffix == ext, F.lit(mime)).otherwise(out)
    return out


def crop_name(span: Column, page_md5: Column, page: Column, box: list[Column]) -> Column:
    key = F.concat(span, F.lit("/"), page_md5, *[x for c in [page, *box] for x in (F.lit("_"), c.cast("string"))])
    return F.concat(F.sha2(key, 256), F.lit(".jpg"))


def office_media_name(kind: Column, raw: Column) -> Column:
    ext = F.when(kind == "jpeg", F.lit("jpg")).otherwise(kind)
    return F.concat(F.sha2(data_uri(F.concat(F.lit("image/"), kind), raw), 256), F.lit("."), ext)


def raster_format(name: Column, content_type: Column, raw: Column) -> Column:
    """The image format by magic bytes, null where content type or extension contradict it."""
    head = F.hex(F.substring(raw, 1, 12))
    lowered = F.lower(F.decode(F.substring(raw, 1, 256), "ISO-8859-1"))
    magic = (
        F.when(head.startswith("FFD8FF"), F.lit("jpeg"))
        .when(head.startswith("89504E470D0A1A0A"), F.lit("png"))
        .when(head.startswith("474946383761") | head.startswith("474946383961"), F.lit("gif"))
        .when(head.startswith("424D"), F.lit("bmp"))
        .when(head.startswith("52494646") & head.endswith("57454250"), F.lit("webp"))
        .when(lowered.contains("<svg"), F.lit("svg"))
    )
    kind = F.lower(F.trim(F.substring_index(content_type, ";", 1)))
    told = F.when(kind.isin("image/jpeg", "image/jpg"), F.lit("jpeg")).when(kind.isin("image/bmp", "image/x-ms-bmp"), F.lit("bmp")).when(kind == "image/svg+xml", F.lit("svg")).when(kind.isin("image/png", "image/gif", "image/webp"), F.substr(kind, F.lit(7)))
    ext = file_suffix(name)
    fits = (ext == "") | (F.when(ext == "jpg", F.lit("jpeg")).otherwise(ext) == magic)
    svg = (ext == "svg") & F.lower(F.decode(F.substring(raw, 1, 512), "ISO-8859-1")).contains("<svg")
    return F.when(svg, F.lit("svg")).when((told.isNull() | (told == magic)) & fits, magic)
