"""Licence recognition by sentences, with SQL functions only.

A text is normalised (letters A-Z lower-cased, everything but letters, digits
and . + - to one space) and cut into sentences; each known sentence is mapped to
its identifier, unknown ones are skipped. The sequence of identifiers is then
matched against ordered rules, longest first; a match uses up its identifiers.
Known sentences may be wrapped over the lines of a paragraph; FORMS has the full
wording of standard texts and headers, which say the same as known sentences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

# Sentences of public licences and of the usual notices that name them, normalised.
SENTENCES = {
    "mit-ref": "released under the mit license",
    "mit-ref2": "licensed under the mit license",
    "mit-title": "the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied",
    "apache-ref": "licensed under the apache license version 2.0",
    "apache-use": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
    "bsd-ref": "redistributed under the bsd license",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice",
    "bsd-name": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "gpl3-ref": "this work is licensed under the gnu general public license version 3",
    "gpl2-ref": "this work is licensed under the gnu general public license version 2",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl-3-later": "either version 3 of the license or at your option any later version",
    "gpl-2-later": "either version 2 of the license or at your option any later version",
    "lgpl-ref": "licensed under the gnu lesser general public license",
    "agpl-ref": "licensed under the gnu affero general public license version 3",
    "mpl-ref": "this source code form is subject to the terms of the mozilla public license v. 2.0",
    "cc-by-ref": "licensed under cc by 4.0",
    "cc-by-sa-ref": "licensed under cc by-sa 4.0",
    "cc-by-nc-ref": "licensed under cc by-nc 4.0",
    "cc-by-nd-ref": "licensed under cc by-nd 4.0",
    "cc0-ref": "released into the public domain under the cc0 license",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "all-rights": "all rights reserved no part may be copied without a license",
}
#: Licence, class and ordered identifiers.
RULES = (
    ("MIT", "permissive", ("mit-title", "mit-grant", "mit-notice", "as-is")),
    ("MIT", "permissive", ("mit-grant", "mit-notice", "as-is")),
    ("MIT", "permissive", ("mit-grant", "mit-notice")),
    ("Apache-2.0", "permissive", ("apache-ref", "apache-use", "apache-copy", "apache-as-is")),
    ("Apache-2.0", "permissive", ("apache-ref", "apache-use")),
    ("BSD-3-Clause", "permissive", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    ("BSD-2-Clause", "permissive", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("GPL-3.0-or-later", "copyleft", ("gpl-free", "gpl-3-later")),
    ("GPL-2.0-or-later", "copyleft", ("gpl-free", "gpl-2-later")),
    ("MIT", "permissive", ("mit-ref",)),
    ("MIT", "permissive", ("mit-ref2",)),
    ("Apache-2.0", "permissive", ("apache-ref",)),
    ("BSD", "permissive", ("bsd-ref",)),
    ("ISC", "permissive", ("isc-grant",)),
    ("GPL-3.0-only", "copyleft", ("gpl3-ref",)),
    ("GPL-2.0-only", "copyleft", ("gpl2-ref",)),
    ("LGPL", "copyleft", ("lgpl-ref",)),
    ("AGPL-3.0-only", "copyleft", ("agpl-ref",)),
    ("MPL-2.0", "copyleft", ("mpl-ref",)),
    ("CC-BY-4.0", "permissive", ("cc-by-ref",)),
    ("CC-BY-SA-4.0", "copyleft", ("cc-by-sa-ref",)),
    ("CC-BY-NC-4.0", "restricted", ("cc-by-nc-ref",)),
    ("CC-BY-ND-4.0", "restricted", ("cc-by-nd-ref",)),
    ("CC0-1.0", "permissive", ("cc0-ref",)),
    ("Unlicense", "permissive", ("unlicense",)),
    ("Proprietary", "restricted", ("all-rights",)),
)
_AGPL = "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"
_AS_PUBLISHED = "under the terms of the gnu general public license version {} as published by the free software foundation"
_LESSER = "this {} is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version {} of the license or at your option any later version"
_APACHE = "under the apache license version 2.0 the license {} may not use this file except in compliance with the license"
_RIGHTS = "{} including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
_CREATIVE = "this work is licensed under {} creative commons {} 4.0 international license"
#: Sentences that only standard texts have, by identifier, and their rules.
MORE_SENTENCES = {"agpl-later": _AGPL}
MORE_RULES = (("AGPL-3.0-or-later", "copyleft", ("agpl-later",)),)
#: Licences that a line with an SPDX identifier may name. Fixed values.
SPDX = {
    "permissive": "MIT Apache-2.0 BSD-2-Clause BSD-3-Clause ISC Zlib 0BSD Unlicense CC0-1.0 CC-BY-4.0 BSL-1.0 Python-2.0".split(),
    "copyleft": "GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later MPL-2.0 EPL-2.0 CC-BY-SA-4.0".split(),
    "restricted": "CC-BY-NC-4.0 CC-BY-ND-4.0 CC-BY-NC-SA-4.0 SSPL-1.0 BUSL-1.1".split(),
}
#: Sentences of one line, which are never wrapped.
LINES = {f"spdx-{n.lower()}": f"spdx-license-identifier {n.lower()}" for names in SPDX.values() for n in names}
MORE_RULES += tuple((n, kind, (f"spdx-{n.lower()}",)) for kind, names in SPDX.items() for n in names)
#: Full wordings (normalised; * stands for 1 to 12 words) and the identifiers that they are read as.
FORMS = (
    (_RIGHTS.format(SENTENCES["mit-grant"]), ("mit-grant",)),
    (SENTENCES["mit-notice"].replace("notice and this permission notice", "notice and this permission notice including the next paragraph"), ("mit-notice",)),
    (SENTENCES["as-is"] + " including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", ("as-is",)),
    (SENTENCES["as-is"] + " including but not limited to the warranties of merchantability fitness for a particular purpose and non-infringement", ("as-is",)),
    ("licensed " + _APACHE.format("you"), ("apache-ref", "apache-use")),
    ("the asf licenses this file to you " + _APACHE.format("you"), ("apache-ref", "apache-use")),
    (SENTENCES["apache-copy"] + " http www.apache.org licenses license-2.0", ("apache-copy",)),
    (SENTENCES["apache-copy"] + " https www.apache.org licenses license-2.0", ("apache-copy",)),
    (SENTENCES["apache-as-is"] + " without warranties or conditions of any kind either express or implied", ("apache-as-is",)),
    ("apache license version 2.0 january 2004", ("apache-ref",)),
    ("apache license version 2.0 january 2004 http www.apache.org licenses", ("apache-ref",)),
    (SENTENCES["bsd-source"] + " this list of conditions and the following disclaimer", ("bsd-source",)),
    (SENTENCES["bsd-binary"] + " this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("bsd-binary",)),
    (SENTENCES["bsd-name"].replace("the copyright holder", "*"), ("bsd-name",)),
    (SENTENCES["isc-grant"] + " provided that the above copyright notice and this permission notice appear in all copies", ("isc-grant",)),
    (SENTENCES["isc-grant"].replace("and or", "and") + " provided that the above copyright notice and this permission notice appear in all copies", ("isc-grant",)),
    (SENTENCES["gpl-free"] + " " + SENTENCES["gpl-3-later"], ("gpl-free", "gpl-3-later")),
    (SENTENCES["gpl-free"] + " " + SENTENCES["gpl-2-later"], ("gpl-free", "gpl-2-later")),
    (SENTENCES["gpl-free"] + " version 3 of the license", ("gpl3-ref",)),
    (SENTENCES["gpl-free"] + " version 2 of the license", ("gpl2-ref",)),
    ("this program is free software you can redistribute it and or modify it " + _AS_PUBLISHED.format(2), ("gpl2-ref",)),
    ("this program is free software you can redistribute it and or modify it " + _AS_PUBLISHED.format(3), ("gpl3-ref",)),
    *((_LESSER.format(what, version), ("lgpl-ref",)) for what in ("library", "program") for version in ("2.1", "3", "2")),
    *((_CREATIVE.format(a, name), (i,)) for a in ("a", "the") for name, i in (("attribution", "cc-by-ref"), ("attribution-sharealike", "cc-by-sa-ref"), ("attribution-noncommercial", "cc-by-nc-ref"), ("attribution-noderivatives", "cc-by-nd-ref"))),
)
#: A wording of more words is sure wherever it stands, also in a text without line breaks.
LONG = 40
#: Each known sentence has one of these, so a text without any needs no further look.
CUES = "licen|permission|warrant|copyright|redistribut|public domain|version"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STRICT = ("restricted", "copyleft", "permissive")


def _rule(ids: tuple[str, ...]) -> str:
    return "".join(f"<{x}>" for x in ids)


def _wrapped(wording: str) -> str:
    """A pattern of a wording that fills whole lines of normalised text, of one paragraph; a very long one may stand anywhere in them."""
    gap = "(?: ?\\n ?| )"
    some = f"[^ \\n]+(?:{gap}[^ \\n]+){{0,11}}?"
    whole = gap.join(some if w == "*" else w.replace(".", f"\\.?{gap}?" if w == "v." else "\\.").replace("+", "\\+") for w in wording.split(" "))
    return f"(?m)(?:^| ){whole}(?: |$)" if wording.count(" ") > LONG else f"(?m)^ ?{whole} ?$"


def _sequence(text: Column) -> Column:
    """Identifiers of the known sentences in their order, each in angle brackets; used-up rules as [licence]."""
    lower = F.translate(text, _UPPER, _LOWER)
    plain = F.regexp_replace(F.regexp_replace(lower, r"[.!?]+([ \t\r\f\n]|$)", "\n"), r"[^a-z0-9.+\n-]+", " ")
    sentences = SENTENCES | MORE_SENTENCES
    for wording, ids in (*FORMS, *((s, (i,)) for i, s in sentences.items())):
        plain = F.regexp_replace(plain, F.lit(_wrapped(wording)), F.lit("\n".join(["", *(sentences[i] for i in ids), ""])))
    sentences |= LINES
    by = F.create_map(*[F.lit(x) for i, s in sentences.items() for x in (s, f"<{i}>")])
    known = F.filter(F.transform(F.split(plain, "\n"), lambda s: F.trim(s)), lambda s: s.isin(*sentences.values()))
    sequence = F.array_join(F.transform(known, lambda s: F.try_element_at(by, s)), "")
    for name, _, ids in (*RULES, *MORE_RULES):
        sequence = F.replace(sequence, F.lit(_rule(ids)), F.lit(f"[{name}]"))
    return F.when(lower.rlike(CUES), sequence).otherwise(F.lit(""))


def license_scan(docs: DataFrame) -> DataFrame:
    """The rows of docs with licenses (distinct names, ascending, joined by commas), n_matches and license_class.

    license_class: the strictest of the matches (restricted, copyleft,
    permissive), or none. Null or empty text, or no rule: "", 0 and none.
    Rows are independent; columns of the input with these names are replaced.
    """
    found = F.regexp_extract_all("__sequence", F.lit(r"\[([^\]]+)\]"), F.lit(1))
    names = F.array_sort(F.array_distinct("__found"))
    kind = F.lit("none")
    for c in reversed(_STRICT):
        own = sorted({n for n, k, _ in (*RULES, *MORE_RULES) if k == c})
        kind = F.when(F.arrays_overlap("__found", F.array(*[F.lit(x) for x in own])), F.lit(c)).otherwise(kind)
    out = docs.drop("licenses", "n_matches", "license_class").withColumn("__sequence", F.coalesce(_sequence(F.col("text")), F.lit(""))).withColumn("__found", found)
    return out.withColumn("licenses", F.array_join(names, ",")).withColumn("n_matches", F.size("__found").cast("long")).withColumn("license_class", kind).drop("__sequence", "__found")


def op3_license_scan(spark, sf_dir):
    return license_scan(common.documents(spark, sf_dir, "doc_id", "text")).drop("text")


def _sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    lower = f"translate(text, '{_UPPER}', '{_LOWER}')"
    plain = f"regexp_replace(regexp_replace({lower}, '[.!?]+([ \\t\\r\\f\\n]|$)', chr(10), 'g'), '[^a-z0-9.+\\n-]+', ' ', 'g')"
    by = "map([" + ", ".join(map(q, SENTENCES.values())) + "], [" + ", ".join(q(f"<{i}>") for i in SENTENCES) + "])"
    sequence = f"array_to_string(list_filter(list_transform(string_split({plain}, chr(10)), lambda s: {by}[trim(s)]), lambda x: x is not null), '')"
    for name, _, ids in RULES:
        sequence = f"replace({sequence}, {q(_rule(ids))}, {q(f'[{name}]')})"
    kind = "".join(f"when list_has_any(found, [{', '.join(q(x) for x in sorted({n for n, k, _ in RULES if k == c}))}]) then '{c}' " for c in _STRICT)
    return f"""with s as (select doc_id, coalesce({sequence}, '') as seq from documents),
f as (select doc_id, regexp_extract_all(seq, '\\[([^\\]]+)\\]', 1) as found from s)
select doc_id, array_to_string(list_sort(list_distinct(found)), ',') as licenses, cast(len(found) as bigint) as n_matches,
case {kind} else 'none' end as license_class from f"""


ORACLE_SQL = {"op3_license_scan": _sql()}
