import pytest

from folium.llm import licenses as L

MIT = """Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
GPL = """    This program is free software{0} you can redistribute it and/or modify
    it under the terms of the GNU {1}General Public License as published by
    the Free Software Foundation{2} either version {3} of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""
ISC = """Copyright (c) 2020 Someone

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
APACHE = """/*
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 */
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
TEXTS = {
    "mit": (MIT, "copyright,MIT-grant,MIT-notice,MIT-asis", "MIT"),
    "gpl2": (GPL.format(";", "", ";", 2), "GPL-free,GPL-terms,GPL-2.0-later", "GPL-2.0-or-later"),
    "gpl3": (GPL.format(":", "", ",", 3), "GPL-free,GPL-3.0-notice", "GPL-3.0-or-later"),
    "agpl3": (GPL.format(":", "Affero ", ",", 3), "GPL-free,AGPL-3.0-notice", "AGPL-3.0-or-later"),
    "lgpl21": (GPL.format(";", "Lesser ", ";", 2.1).replace("program", "library"), "LGPL-free,LGPL-terms,LGPL-2.1-later", "LGPL-2.1-or-later"),
    "isc": (ISC, "copyright,ISC-grant", "ISC"),
    "apache": (APACHE, "Apache-2.0-ref,Apache-2.0-comply,Apache-2.0-copy,Apache-2.0-asis,Apache-2.0-nowarranty", "Apache-2.0"),
    "mpl": (MPL, "MPL-2.0-terms", "MPL-2.0"),
    "title": ("    GNU GENERAL PUBLIC LICENSE\n      Version 3, 29 June 2007\n", "GPL-3.0-title", "GPL-3.0"),
}


@pytest.mark.parametrize("ends", ["\n", "\r\n"])
def test_published_texts(frame, ends):
    keys = list(TEXTS)
    got = {keys[r.doc_id]: (r.sequence, r.licenses) for r in L.scan_licenses(frame([(i, TEXTS[k][0].replace("\n", ends)) for i, k in enumerate(keys)])).collect()}
    assert got == {k: v[1:] for k, v in TEXTS.items()}


def test_lines_of_their_own_are_kept(frame):
    texts = ["MIT License\nCopyright (c) 2020 X\nAll rights reserved", "Licensed under the\nMIT License", "Licensed under the\n\nMIT License", "You may\nLicensed under the\nMIT License"]
    got = [r.sequence for r in L.scan_licenses(frame(list(enumerate(texts)))).orderBy("doc_id").collect()]
    assert got == ["MIT-title,copyright,reserved", "MIT-ref", "MIT-title", "MIT-ref"]


def test_long_sentences(frame):
    holders = ", ".join(f"Holder Number {i}" for i in range(25))
    texts = ["=" * 300 + " MIT License", f"Copyright (c) 2020 {holders}. All rights reserved.", " " * 400 + "Released under the MIT License.", "* " * 200 + "licensed under the mit license" + " *" * 200, "x" * 100_000]
    got = [r.licenses for r in L.scan_licenses(frame(list(enumerate(texts)))).orderBy("doc_id").collect()]
    assert got == ["MIT", "proprietary", "MIT", "MIT", ""]


MORE = {
    "SPDX-License-Identifier: MIT": ("MIT-spdx", "MIT"),
    "// SPDX-License-Identifier: (GPL-2.0-or-later WITH Classpath-exception-2.0) OR Apache-2.0": ("GPL-2.0-or-later-spdx,Apache-2.0-spdx", "GPL-2.0-or-later,Apache-2.0"),
    "# SPDX-License-Identifier: GPL-3.0+\nSPDX-License-Identifier: LicenseRef-own": ("GPL-3.0-or-later-spdx,other-spdx", "GPL-3.0-or-later"),
    "This project is licensed under the GNU General Public License v3.0.": ("GPL-3.0-ref", "GPL-3.0"),
    "Distributed under the terms of the GNU Lesser General Public License, version 2.1 or later.": ("LGPL-2.1-or-later-ref", "LGPL-2.1-or-later"),
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": ("CC-BY-SA-4.0-ref", "CC-BY-SA-4.0"),
    "Boost Software License - Version 1.0 - August 17th, 2003": ("BSL-1.0-title", "BSL-1.0"),
    "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\nReleased under the MIT License.\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.": ("BSD-grant,MIT-ref,BSD-source,BSD-binary", "MIT"),
    ";; Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction;": ("MIT-grant", "MIT"),
    "Licensed under CC BY 4.0.\nReleased under the MIT License.\nLicensed under CC BY 4.0.": ("CC-BY-4.0-ref,MIT-ref,CC-BY-4.0-ref", "CC-BY-4.0,MIT"),
    "Licensed under the Whatever License.": ("", ""),
}


def test_names_tags_and_order(frame):
    got = [(r.sequence, r.licenses) for r in L.scan_licenses(frame(list(enumerate(MORE)))).orderBy("doc_id").collect()]
    assert got == list(MORE.values())


def test_comments(frame):
    marks = [" * ", "// ", "# ", "-- ", "% "]
    texts = ["".join(f"{m}{x}\n" for x in MIT.splitlines()) for m in marks]
    got = [r.licenses for r in L.scan_licenses(frame(list(enumerate(texts)))).orderBy("doc_id").collect()]
    assert got == ["MIT"] * len(marks)


def test_tables():
    lacking = [s for s in L.KNOWN if not any(c in s.split(" ")[k] for k in range(len(s.split(" "))) for c in L.CUES)]
    assert not lacking and all(any(c in n for c in L.CUES) for n in L.NAMED)
    assert len(L.KNOWN) + len(L.NAMED) >= 150 and len(L.RULES) >= 60


def test_the_sql_says_the_same(frame, spark):
    duckdb = pytest.importorskip("duckdb")
    texts = [v[0] for v in TEXTS.values()] + list(MORE) + ["MIT License\nCopyright (c) 2020 X\nAll rights reserved", "Licensed under the\n\nMIT License", "You may\nLicensed under the\nMIT License", "=" * 300 + " MIT License", "", None, "\n\n", "GNU\nGeneral Public\nLicense version 2", "x" * 5000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, MIT), (3, texts[3])]
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = sorted(db.execute(f"SELECT doc_id, n_sentences, n_known, sequence, licenses FROM ({L.ORACLE_SQL})").fetchall(), key=str)
    got = sorted((tuple(r) for r in L.scan_licenses(frame(rows)).collect()), key=str)
    assert got == want
