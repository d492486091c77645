"""License scans by sentence recognition.

A text is cut into sentences, each is normalised and given the identifier of the licence sentence that it is: a sentence of
a licence's text (SENTENCES, WHOLE), a title or a reference that names a licence (NAMES, REFERENCE), a copyright line, or an
SPDX tag. The identifiers, in text order, form a sequence against which ordered rules are matched. A rule that matches
leaves the licence's name in place of its part of the sequence, so no later rule sees that part, nor its two sides as
neighbours. Names are reported in text order.

All of it is expressions on the row: no shuffle, no join, nothing collected. Tables and rules are literals. Texts without
any of CUES, one of which stands in all that can be recognised, are only cut.

A known sentence may be broken over lines in any way, also behind marks of comments: a line that ends without a mark and
begins a known sentence is joined with the lines after it, up to an empty line. Lines that are sentences of their own
(titles, notices) are still taken alone, and `n_sentences` counts lines as they are cut.

Defined cases: null or empty text has no sentences and no licences; a sentence that occurs twice counts twice in the
sequence and once in the licences; an unknown SPDX identifier is `other-spdx` and names no licence; repeated rows and rows
without an id each give a row; very long texts are taken whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of public licences as notices write them, normalised.
NAMES = {
    "Apache-1.1": ["apache software license version 1.1", "apache license version 1.1"],
    "Apache-2.0": ["apache license version 2.0", "apache license 2.0", "apache 2.0 license", "apache-2.0 license", "apache software license version 2.0", "apache license v2.0", "apache license version 2.0 january 2004"],
    "Artistic-1.0": ["artistic license 1.0", "artistic license version 1.0"],
    "Artistic-2.0": ["artistic license 2.0", "artistic license version 2.0"],
    "BSD-2-Clause": ["bsd 2-clause license", "2-clause bsd license", "simplified bsd license", "freebsd license"],
    "BSD-3-Clause": ["bsd 3-clause license", "3-clause bsd license", "new bsd license", "modified bsd license", "revised bsd license"],
    "BSD-4-Clause": ["bsd 4-clause license", "4-clause bsd license", "original bsd license"],
    "0BSD": ["bsd zero clause license", "zero-clause bsd license", "0bsd license"],
    "BSL-1.0": ["boost software license version 1.0", "boost software license 1.0", "boost software license - version 1.0", "boost software license - version 1.0 - august 17th 2003"],
    "CC0-1.0": ["cc0 1.0 universal license", "cc0 1.0 universal", "cc0 1.0", "creative commons zero v1.0 universal license"],
    "CDDL-1.0": ["common development and distribution license version 1.0", "common development and distribution license 1.0", "common development and distribution license (cddl) version 1.0"],
    "CDDL-1.1": ["common development and distribution license version 1.1", "common development and distribution license (cddl) version 1.1"],
    "EPL-1.0": ["eclipse public license version 1.0", "eclipse public license 1.0", "eclipse public license - v 1.0", "eclipse public license v1.0"],
    "EPL-2.0": ["eclipse public license version 2.0", "eclipse public license 2.0", "eclipse public license - v 2.0", "eclipse public license v2.0"],
    "EUPL-1.2": ["european union public licence version 1.2", "european union public licence 1.2", "european union public license version 1.2"],
    "ISC": ["isc license", "isc license (iscl)"],
    "MIT": ["mit license", "mit license (mit)", "mit/x11 license", "expat license", "expat/mit license"],
    "MPL-1.1": ["mozilla public license version 1.1", "mozilla public license 1.1"],
    "MPL-2.0": ["mozilla public license version 2.0", "mozilla public license 2.0", "mozilla public license v2.0"],
    "MS-PL": ["microsoft public license", "microsoft public license (ms-pl)"],
    "OFL-1.1": ["sil open font license version 1.1", "sil open font license 1.1", "open font license version 1.1"],
    "PHP-3.01": ["php license version 3.01", "php license 3.01"],
    "PostgreSQL": ["postgresql license"],
    "Python-2.0": ["python software foundation license version 2", "python license version 2", "psf license version 2"],
    "Unlicense": ["unlicense", "unlicense license"],
    "Zlib": ["zlib license", "zlib/libpng license"],
}
#: GNU licences: short name, long name, versions; all may be had with 'or any later version'.
GNU = [("GPL", "general public license", ["2.0", "3.0"]), ("LGPL", "lesser general public license", ["2.1", "3.0"]), ("AGPL", "affero general public license", ["3.0"])]
#: Parts of Creative Commons licences, short and long, and their versions with the name of the edition.
COMMONS = {"by": "attribution", "by-sa": "attribution-sharealike", "by-nc": "attribution-noncommercial", "by-nd": "attribution-noderivatives", "by-nc-sa": "attribution-noncommercial-sharealike", "by-nc-nd": "attribution-noncommercial-noderivatives"}
EDITIONS = {"3.0": "unported", "4.0": "international"}

for _short, _long, _versions in GNU:
    for _v in _versions:
        _plain = _v.removesuffix(".0")
        _dated = {"GPL-2.0": ["june 1991"], "GPL-3.0": ["29 june 2007"], "LGPL-2.1": ["february 1999"], "LGPL-3.0": ["29 june 2007"], "AGPL-3.0": ["19 november 2007"]}[f"{_short}-{_v}"]
        _forms = [f"gnu {_long} version {_plain}", f"gnu {_long} version {_v}", f"gnu {_long} v{_plain}", f"gnu {_long} v{_v}", f"gnu {_short.lower()} version {_plain}", f"gnu {_short.lower()} v{_plain}", f"{_short.lower()} version {_plain}", f"{_short.lower()}v{_plain}"]
        NAMES[f"{_short}-{_v}"] = list(dict.fromkeys(_forms)) + [f"gnu {_long} version {_plain} {d}" for d in _dated]
for _short, _long in COMMONS.items():
    for _v, _edition in EDITIONS.items():
        _id = f"CC-{_short.upper()}-{_v}"
        NAMES[_id] = [f"cc {_short} {_v}", f"cc-{_short}-{_v}", f"cc-{_short} {_v}", f"creative commons {_long} {_v} license", f"creative commons {_long} {_v} {_edition} license", f"creative commons {_long} {_v} {_edition}"]

NAMED = {name: licence for licence, names in NAMES.items() for name in names}
#: What SPDX tags call them, in small letters, and what they are here.
SPDX = {licence.lower(): licence for licence in NAMES}
SPDX |= {f"{k.lower()}-{v}{end}": f"{k}-{v}{to}" for k, _, vs in GNU for v in vs for end, to in (("", ""), ("-only", ""), ("+", "-or-later"), ("-or-later", "-or-later"))}

# Normalised sentences of public licences, and their identifiers.
SENTENCES = {
    "licensed under the apache license version 2.0": "Apache-2.0-ref",
    "licensed under the apache license version 2.0 (the license)": "Apache-2.0-ref",
    "you may not use this file except in compliance with the license": "Apache-2.0-comply",
    "you may obtain a copy of the license at": "Apache-2.0-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis": "Apache-2.0-asis",
    "without warranties or conditions of any kind either express or implied": "Apache-2.0-nowarranty",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files (the software) to deal in the software without restriction": "MIT-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MIT-notice",
    "the software is provided as is without warranty of any kind express or implied": "MIT-asis",
    "this program is free software": "GPL-free",
    "you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation": "GPL-terms",
    "either version 2 of the license or (at your option) any later version": "GPL-2.0-later",
    "either version 3 of the license or (at your option) any later version": "GPL-3.0-later",
    "this source code form is subject to the terms of the mozilla public license v. 2.0": "MPL-2.0-terms",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BSD-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSD-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution": "BSD-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSD-endorse",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "BSD-advert",
    "permission to use copy modify and/or distribute this software for any purpose with or without fee is hereby granted": "ISC-grant",
    "this is free and unencumbered software released into the public domain": "Unlicense-grant",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non-commercial and by any means": "Unlicense-free",
    "this software is provided as-is without any express or implied warranty": "Zlib-asis",
    "in no event will the authors be held liable for any damages arising from the use of this software": "Zlib-liable",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "Zlib-grant",
    "the origin of this software must not be misrepresented": "Zlib-origin",
    "this font software is licensed under the sil open font license version 1.1": "OFL-1.1-ref",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https//www.eclipse.org/legal/epl-2.0": "EPL-2.0-ref",
    "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law including all related and neighboring rights to the extent allowed by law": "CC0-1.0-deed",
    "all rights reserved": "reserved",
}

_OR_LATER = "of the license or (at your option) any later version"
_FSF = "you can redistribute it and/or modify it under the terms of the gnu {} as published by the free software foundation"
_ASIS = "the software is provided as is without warranty of any kind express or implied"

#: Sentences as the published texts have them, to their ends.
WHOLE = {
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "Apache-2.0-asis",
    "you may obtain a copy of the license at http//www.apache.org/licenses/license-2.0": "Apache-2.0-copy",
    "you may obtain a copy of the license at https//www.apache.org/licenses/license-2.0": "Apache-2.0-copy",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files (the software) to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and/or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MIT-grant",
    "the above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the software": "MIT-notice",
    f"{_ASIS} including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MIT-asis",
    f"{_FSF.format('general public license')} either version 2 {_OR_LATER}": "GPL-2.0-notice",
    f"{_FSF.format('general public license')} either version 3 {_OR_LATER}": "GPL-3.0-notice",
    "this library is free software": "LGPL-free",
    _FSF.format("lesser general public license"): "LGPL-terms",
    f"either version 2.1 {_OR_LATER}": "LGPL-2.1-later",
    f"{_FSF.format('lesser general public license')} either version 2.1 {_OR_LATER}": "LGPL-2.1-notice",
    f"{_FSF.format('lesser general public license')} either version 3 {_OR_LATER}": "LGPL-3.0-notice",
    f"{_FSF.format('affero general public license')} either version 3 {_OR_LATER}": "AGPL-3.0-notice",
    "this source code form is subject to the terms of the mozilla public license v": "MPL-2.0-terms",  # 'v. 2.0' is cut after the dot
    "permission to use copy modify and/or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISC-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISC-grant",
}
KNOWN = SENTENCES | WHOLE

#: (licence, pattern over the sequence "<id><id>"), first matching first.
RULES = [
    ("GPL-2.0-or-later", r"(<GPL-free>)?<GPL-2\.0-notice>"),
    ("GPL-3.0-or-later", r"(<GPL-free>)?<GPL-3\.0-notice>"),
    ("LGPL-2.1-or-later", r"(<L?GPL-free>)?(<LGPL-2\.1-notice>|<LGPL-terms><LGPL-2\.1-later>)"),
    ("LGPL-3.0-or-later", r"(<L?GPL-free>)?(<LGPL-3\.0-notice>|<LGPL-terms><GPL-3\.0-later>)"),
    ("AGPL-3.0-or-later", r"(<GPL-free>)?<AGPL-3\.0-notice>"),
    ("Apache-2.0", r"(<Apache-2\.0-title>)?<Apache-2\.0-ref>(<Apache-2\.0-comply>)?(<Apache-2\.0-copy>)?(<Apache-2\.0-asis>)?(<Apache-2\.0-nowarranty>)?"),
    ("MIT", r"(<MIT-title>)?(<copyright>(<reserved>)?)*<MIT-grant><MIT-notice>(<MIT-asis>)?"),
    ("GPL-2.0-or-later", r"<GPL-free><GPL-terms><GPL-2\.0-later>"),
    ("GPL-3.0-or-later", r"<GPL-free><GPL-terms><GPL-3\.0-later>"),
    ("GPL", r"<GPL-free><GPL-terms>"),
    ("BSD-4-Clause", r"(<BSD-4-Clause-title>)?(<copyright>(<reserved>)?)*<BSD-grant><BSD-source><BSD-binary><BSD-advert>(<BSD-endorse>)?"),
    ("BSD-3-Clause", r"(<BSD-3-Clause-title>)?(<copyright>(<reserved>)?)*<BSD-grant><BSD-source><BSD-binary><BSD-endorse>"),
    ("BSD-2-Clause", r"(<BSD-2-Clause-title>)?(<copyright>(<reserved>)?)*<BSD-grant><BSD-source><BSD-binary>"),
    ("ISC", r"(<ISC-title>)?(<copyright>(<reserved>)?)*<ISC-grant>"),
    ("Zlib", r"(<Zlib-title>)?(<copyright>)*<Zlib-asis><Zlib-liable><Zlib-grant>(<Zlib-origin>)?"),
    ("MPL-2.0", r"<MPL-2\.0-terms>"),
    ("MIT", r"<MIT-grant>"),
    ("Zlib", r"<Zlib-grant>"),
    ("Unlicense", r"<Unlicense-grant>(<Unlicense-free>)?"),
    ("CC0-1.0", r"(<CC0-1\.0-title>)?<CC0-1\.0-deed>"),
]
RULES += [(f"{k}-{v}-or-later", f"<{k}-{v}-or-later-(ref|title|spdx)>".replace(".", r"\.")) for k, _, vs in GNU for v in vs]
RULES += [(n, f"<{n}-(ref|title|spdx)>".replace(".", r"\.")) for n in NAMES]
RULES += [("proprietary", r"<copyright><reserved>")]

#: A sentence that refers to a licence by name, and one that is the name alone; 'or later' in group 2 of both.
_SUBJECT = r"^(?:(?:this|the) (?:code|content|data|document|file|library|material|module|package|program|project|repository|software|source code|work) (?:is|are) |it is |all code is )?(?:dual |dual-)?(?:licensed|released|distributed|published|available|made available)"
REFERENCE = _SUBJECT + r" (?:to you )?under (?:the terms of )?(?:the |an? )?(.*?)( or (?:\(at your option\) )?(?:any )?later(?: version)?)?(?: \(the license\))?$"
#: How a reference begins that may go on in the next line; group 1 is the beginning of a name.
REFERRING = _SUBJECT + r"(?: to you)?(?: under(?: the terms(?: of)?)?(?: the| an?)?)?(?: (.*))?$"
TITLE = r"^(?:the )?(.*?)( or (?:\(at your option\) )?(?:any )?later(?: version)?)?$"

#: How what may go on in the next line begins (a word and the next, if there is one); all of it, each between line ends.
OPENINGS = [*KNOWN, *NAMED, *(f"the {n}" for n in NAMED)]
BEGINNING = "^(?:" + "|".join(sorted({f"{re.escape(a)}(?:$| {re.escape(b)}(?:$| ))" for a, b in ((k + " ").split(" ")[:2] for k in OPENINGS) if b})) + ")"
TABLE = "\n" + "\n".join(OPENINGS) + "\n"

#: One of these stands in every sentence that can be recognised, in one word.
CUES = ["licen", "copyright", "permission", "permitted", "redistribut", "warrant", "spdx", "reserved", "software", "domain", "gpl", "version", "released", "distributed", "published", "available", "creative", "cc", "advertising", "endorse", "universal"]

#: A line that goes on in the next; a sentence's end; what normalising drops; edges it strips; tags of SPDX.
WRAPPED = r"([^.!?;:\n])\r?\n[ \t]*([a-z])"
SENTENCE_END = r"([.!?;:])[ \t\r]+"
DROPPED = r"[^a-z0-9.()/+ -]+"
GAPS = r" +"
EDGES = r"^[ ./-]+|[ ./-]+$"
STOP = r"[.!?;:][ \t\r]*$"
COPYRIGHT = r"^copyright( \(c\))? [0-9][0-9][0-9][0-9]"
TAG = r"(SPDX-License-Identifier): *([^ \n])"
TAGGED = r"^spdx-license-identifier (.*)$"
TAG_PARTS = r"[a-z0-9.+-]+"
TAG_WORDS = ["or", "and", "with"]
EXCEPTION = r" with [a-z0-9.+-]+"


def lines(text: Column) -> Column:
    """The sentences of a text, in order, and its empty lines."""
    joined = F.regexp_replace(F.regexp_replace(text, WRAPPED, "$1 $2"), TAG, "$1 $2")
    return F.split(F.regexp_replace(joined, SENTENCE_END, "$1\n"), "\n")


def sentences(text: Column) -> Column:
    """The non-empty sentences of a text, in order."""
    return F.filter(lines(text), lambda s: F.length(s) > 0)


def normalise(sentence: Column) -> Column:
    """Lower case, without quotes, commas and marks, single spaces, without dots, strokes and slashes at the edges."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(sentence), r"[\t\r]", " "), DROPPED, "")
    return F.regexp_replace(F.regexp_replace(plain, GAPS, " "), EDGES, "")


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def sentence(s: Column) -> Column:
    """The identifier of a normalised sentence of a licence, a reference or a title, null if it is none."""

    def by_name(pattern: str, end: str) -> Column:
        later = F.when(F.regexp_extract(s, pattern, 2) != "", "-or-later").otherwise("")
        return F.concat(F.try_element_at(_map(NAMED), F.regexp_extract(s, pattern, 1)), later, F.lit(end))

    return F.coalesce(F.try_element_at(_map(KNOWN), s), F.when(s.contains(" under "), by_name(REFERENCE, "-ref")), by_name(TITLE, "-title"))


def identifier(s: Column) -> Column:
    """The identifier of a normalised sentence, null if it is none; several of an SPDX tag with >< between."""
    parts = F.filter(F.regexp_extract_all(F.regexp_replace(F.regexp_extract(s, TAGGED, 1), EXCEPTION, ""), F.lit(TAG_PARTS), 0), lambda x: ~x.isin(TAG_WORDS))
    tag = F.array_join(F.transform(parts, lambda x: F.concat(F.coalesce(F.try_element_at(_map(SPDX), x), F.lit("other")), F.lit("-spdx"))), "><")
    return F.when(s == "", F.lit(None)).when(s.rlike(COPYRIGHT), "copyright").when(s.rlike(TAGGED), tag).otherwise(sentence(s))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_sentences, n_known, sequence (identifiers joined by commas), licenses (names joined by commas, in text order)."""
    none = F.array().cast("array<string>")
    listed = lambda s: F.contains(F.lit(TABLE), F.concat(F.lit("\n"), s, F.lit(" ")))
    name = lambda s: F.regexp_extract(s, REFERRING, 1)
    refers = lambda s: s.rlike(REFERRING) & ((name(s) == "") | listed(name(s)))
    begins = lambda s: listed(s) | refers(s)
    rules = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("pattern")) for n, p in RULES])
    text = F.coalesce(F.col(text_col), F.lit(""))
    low = F.lower(text)
    df = docs.select(F.col(id_col).alias("doc_id"), lines(text).alias("cuts"), functools.reduce(Column.__or__, [low.contains(c) for c in CUES]).alias("cue"))
    df = df.select("doc_id", F.size(F.filter("cuts", lambda s: F.length(s) > 0)).cast("long").alias("n_sentences"), F.transform(F.when(F.col("cue"), F.col("cuts")).otherwise(none), lambda s: F.struct(normalise(s).alias("s"), s.rlike(STOP).alias("stop"))).alias("cuts"))
    df = df.withColumn("cuts", F.transform("cuts", lambda x: F.struct(x["s"].alias("s"), x["stop"].alias("stop"), identifier(x["s"]).alias("id"))))
    going = lambda x: x["id"].isNull() & ~x["stop"] & ((x["s"].rlike(BEGINNING) & listed(x["s"])) | refers(x["s"]))
    def step(state: Column, x: Column) -> Column:
        runs = F.transform(state["open"], lambda o: F.concat(o, F.lit(" "), x["s"]))
        found = F.coalesce(F.get(F.filter(F.transform(runs, sentence), lambda i: i.isNotNull()), F.lit(0)), x["id"])
        on = F.filter(F.concat(runs, F.array(x["s"])), begins)
        return F.struct(
            F.when(found.isNull(), state["ids"]).otherwise(F.concat(state["ids"], F.array(found))).alias("ids"),
            F.when(found.isNotNull() | x["stop"] | (x["s"] == ""), none).otherwise(on).alias("open"),
        )

    alone = F.filter(F.transform("cuts", lambda x: x["id"]), lambda i: i.isNotNull())
    joined = F.aggregate("cuts", F.struct(none.alias("ids"), none.alias("open")), step)["ids"]
    df = df.select("doc_id", "n_sentences", F.when(F.exists("cuts", going), joined).otherwise(alone).alias("ids"))
    start = F.concat(F.lit("<"), F.array_join("ids", "><"), F.lit(">"))
    marked = F.aggregate(rules, start, lambda left, rule: F.regexp_replace(left, rule["pattern"], F.concat(F.lit("["), rule["name"], F.lit("]"))))
    names = F.when(F.size("ids") > 0, F.array_distinct(F.regexp_extract_all(marked, F.lit(r"\[([^\]]*)\]"), 1))).otherwise(none)
    return df.select("doc_id", "n_sentences", F.size("ids").cast("long").alias("n_known"), F.replace(F.array_join("ids", ","), F.lit("><"), F.lit(",")).alias("sequence"), F.array_join(names, ",").alias("licenses"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql() -> str:
    """The same result in DuckDB's SQL: all texts line by line, with a recursive step from a line to the next."""
    table = lambda t: "MAP {" + ", ".join(f"{_quoted(k)}: {_quoted(v)}" for k, v in t.items()) + "}"
    by_name = lambda s, p, end: f"(SELECT licence FROM named WHERE name = regexp_extract({s}, {_quoted(p)}, 1)) || CASE WHEN regexp_extract({s}, {_quoted(p)}, 2) <> '' THEN '-or-later' ELSE '' END || '{end}'"
    own = lambda x: f"coalesce((SELECT id FROM known WHERE known.s = {x}), CASE WHEN contains({x}, ' under ') THEN {by_name(x, REFERENCE, '-ref')} END, {by_name(x, TITLE, '-title')})"
    listed = lambda x: f"EXISTS (SELECT 1 FROM openings WHERE starts_with(o, {x} || ' '))"
    rest = f"regexp_extract(x, {_quoted(REFERRING)}, 1)"
    opens = f"({listed('x')} OR (regexp_matches(x, {_quoted(REFERRING)}) AND ({rest} = '' OR {listed(rest)})))"
    apply = "'<' || array_to_string(ids, '><') || '>'"
    steps = [f"r0 AS (SELECT *, {apply} AS l FROM last)"]
    for i, (name, pattern) in enumerate(RULES):
        steps.append(f"r{i + 1} AS (SELECT * REPLACE (regexp_replace(l, {_quoted(pattern)}, '[{name}]', 'g') AS l) FROM r{i})")
    norm = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(raw), '[\\t\\r]', ' ', 'g'), {_quoted(DROPPED)}, '', 'g'), ' +', ' ', 'g'), {_quoted(EDGES)}, '', 'g')"
    words = ", ".join(map(_quoted, TAG_WORDS))
    return f"""
WITH RECURSIVE known AS (SELECT unnest(map_keys(m)) AS s, unnest(map_values(m)) AS id FROM (SELECT {table(KNOWN)} AS m)),
named AS (SELECT unnest(map_keys(m)) AS name, unnest(map_values(m)) AS licence FROM (SELECT {table(NAMED)} AS m)),
openings AS (SELECT s AS o FROM known UNION SELECT name FROM named UNION SELECT 'the ' || name FROM named),
docs AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
cut AS (SELECT k, doc_id, string_split(regexp_replace(regexp_replace(regexp_replace(text, '{WRAPPED}', '\\1 \\2', 'g'), '{TAG}', '\\1 \\2', 'g'), '{SENTENCE_END}', '\\1' || chr(10), 'g'), chr(10)) AS ls FROM docs),
line AS (SELECT k, unnest(generate_series(1, len(ls))) AS i, unnest(ls) AS raw FROM cut),
plain AS (SELECT k, i, {norm} AS s, regexp_matches(raw, '{STOP}') AS stop FROM line),
given AS (SELECT DISTINCT s FROM plain WHERE s <> ''),
ids AS (SELECT s, CASE WHEN regexp_matches(s, '{COPYRIGHT}') THEN 'copyright'
  WHEN regexp_matches(s, '{TAGGED}') THEN array_to_string(list_transform(list_filter(regexp_extract_all(regexp_replace(regexp_extract(s, '{TAGGED}', 1), '{EXCEPTION}', '', 'g'), '{TAG_PARTS}'), lambda x: x NOT IN ({words})), lambda x: coalesce({table(SPDX)}[x], 'other') || '-spdx'), '><')
  ELSE {own('given.s')} END AS id FROM given),
telling AS (SELECT DISTINCT k FROM plain WHERE s IN (SELECT s FROM ids WHERE id IS NOT NULL UNION SELECT x FROM (SELECT s AS x FROM given) WHERE {opens})),
tagged AS (SELECT k, i, p.s, stop, id FROM plain p JOIN telling USING (k) LEFT JOIN ids ON ids.s = p.s),
walk(k, i, ids, open) AS (
  SELECT k, 0::BIGINT, []::VARCHAR[], []::VARCHAR[] FROM telling
  UNION ALL
  SELECT k, i, CASE WHEN found IS NULL THEN ids ELSE list_append(ids, found) END,
    CASE WHEN found IS NOT NULL OR stop OR s = '' THEN []::VARCHAR[] ELSE (SELECT coalesce(list(x), []) FROM (SELECT unnest(list_append(runs, s)) AS x) WHERE {opens}) END
  FROM (SELECT *, coalesce((SELECT min_by(id, p) FROM (SELECT p, {own('x')} AS id FROM (SELECT unnest(runs) AS x, unnest(generate_series(1, len(runs))) AS p)) WHERE id IS NOT NULL), id) AS found
    FROM (SELECT w.k, t.i, w.ids, list_transform(w.open, lambda o: o || ' ' || t.s) AS runs, t.s, t.stop, t.id FROM walk w JOIN tagged t ON t.k = w.k AND t.i = w.i + 1))),
last AS (SELECT cut.k, coalesce(w.ids, []) AS ids FROM cut LEFT JOIN walk w ON cut.k = w.k AND w.i = len(ls)),
{', '.join(steps)},
names AS (SELECT k, regexp_extract_all(l, '\\[([^\\]]*)\\]', 1) AS ns FROM r{len(RULES)})
SELECT doc_id, len(list_filter(ls, lambda s: length(s) > 0))::BIGINT AS n_sentences, len(ids)::BIGINT AS n_known, replace(array_to_string(ids, ','), '><', ',') AS sequence,
  CASE WHEN len(ids) = 0 THEN '' ELSE array_to_string(list_filter(ns, lambda x, p: list_position(ns, x) = p), ',') END AS licenses
FROM cut JOIN last USING (k) JOIN names USING (k)
"""


ORACLE_SQL = _sql()
