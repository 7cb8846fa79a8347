import random
import re
import textwrap

from subjectloom.llm import license_scan as L
from subjectloom.llm.queries import ORACLES, QUERIES

from ..compare import connect, same_rows
from .helpers import clash, docs

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""

GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""

GPL2 = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program; if not, write to the Free Software Foundation, Inc.,
51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."""

MPL2 = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""

ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""

APACHE2 = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""

BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""

BSD3 = BSD2 + """

3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission."""

DISCLAIMER = """

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED."""
NAMED_BSD3 = "Copyright 2008, Example Widgets Inc.\nAll rights reserved.\n\n" + BSD2.replace("1. ", "   * ").replace("2. ", "   * ") + """

   * Neither the name of Example Widgets Inc. nor the names of its
     contributors may be used to endorse or promote products derived from
     this software without specific prior written permission.""" + DISCLAIMER
LETTERED_BSD3 = BSD3.replace("1. ", "a. ").replace("2. ", "b. ").replace("3. Neither the name of the copyright holder nor the names of its contributors", "c. Neither the name of the University of Example nor the names of its contributors")
AUTHOR_BSD3 = BSD2 + """

3. The name of the author may not be used to endorse or promote products
   derived from this software without specific prior written permission."""
BSD4 = BSD2 + """

3. All advertising materials mentioning features or use of this software
   must display the following acknowledgement:
   This product includes software developed by the Example project.

4. Neither the name of the Example project nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission."""
LGPL21 = GPL2.replace("GNU General", "GNU Lesser General").replace("This program", "This library").replace("this program", "this library").replace("version 2 ", "version 2.1 ")
LGPL3 = GPL3.replace("GNU General", "GNU Lesser General").replace("This program", "This library").replace("this program", "this library")
AGPL3 = GPL3.replace("GNU General", "GNU Affero General")
EPL2 = """This program and the accompanying materials are made available under the
terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0/"""
EPL1 = """All rights reserved. This program and the accompanying materials
are made available under the terms of the Eclipse Public License v1.0
which accompanies this distribution, and is available at
http://www.eclipse.org/legal/epl-v10.html"""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:"""
BOOST = """Distributed under the Boost Software License, Version 1.0.
(See accompanying file or copy at the address of the foundation.)"""
CC0 = """To the extent possible under law, the author(s) have dedicated all copyright
and related and neighboring rights to this software to the public domain
worldwide. This software is distributed without any warranty."""
UNLICENSE = "This is free and unencumbered software released into the public domain."
STANDARD = [
    ("GPL-3.0-or-later", GPL3), ("GPL-2.0-or-later", GPL2), ("LGPL-2.1-or-later", LGPL21), ("LGPL-3.0-or-later", LGPL3), ("AGPL-3.0-or-later", AGPL3), ("MPL-2.0", MPL2), ("ISC", ISC), ("Apache-2.0", APACHE2),
    ("BSD-2-Clause", BSD2), ("BSD-2-Clause", BSD2 + DISCLAIMER), ("BSD-3-Clause", BSD3), ("BSD-3-Clause", NAMED_BSD3), ("BSD-3-Clause", LETTERED_BSD3), ("BSD-3-Clause", AUTHOR_BSD3), ("BSD-4-Clause", BSD4),
    ("EPL-2.0", EPL2), ("EPL-1.0", EPL1), ("Zlib", ZLIB), ("BSL-1.0", BOOST), ("CC0-1.0", CC0), ("Unlicense", UNLICENSE), ("MIT", MIT), ("MIT", "MIT License\n\nCopyright (c) 2020 Some Body\n\n" + MIT),
]


def wrapped(text, width):
    """The paragraphs of a text, each wrapped anew."""
    return "\n\n".join(textwrap.fill(" ".join(x.split()), width, break_long_words=False, break_on_hyphens=False) for x in text.split("\n\n"))


def commented(text, sign):
    return "\n".join(f"{sign} {x}".rstrip() for x in text.split("\n"))


def tags(low):
    """SPDX tags end with their line; each licence of an expression gets a tag and a paragraph of its own."""
    tag, out = "spdx license identifier ", []
    for line in low.split("\n"):
        head, found, tail = line.partition(tag)
        if found:
            parts = re.split(r" (?:or|and) (?=[a-z0-9(])", re.sub(r" with [a-z0-9.-]+", "", tail, count=1), maxsplit=4)
            line = head + "\n\n".join(tag + x for x in parts) + "\n"
        out.append(line)
    return "\n".join(out)


def cut(text):
    """Sentences by the rules in words, a run of letters and digits at a time: lists of lines."""
    low = tags(re.sub(r"spdx-license-identifier:[ \t]*", "spdx license identifier ", text.lower()))
    low = re.sub(r"(?<=[^a-z0-9])v\.[^a-z0-9\n]*\n?[^a-z0-9\n]*(?=[0-9])", "version ", low)
    low = re.sub(r"gpl([ v-]{0,2})([0-9][0-9.]*)\+", r"gpl\1\2 or later ", low)
    runs = re.findall(r"[a-z0-9]+|[^a-z0-9]+", low)
    out, at = [[""]], 0
    for k, run in enumerate(runs):
        if run[0].isalnum() and run.isascii():
            out[-1][-1] += run
        else:
            mark = re.search(r"[.;!?:]", run)
            ends = mark and any(c in run[mark.start() :] for c in " \t\n")
            if ends or run.count("\n") >= 2:
                out.append([""])
            elif "\n" in run and low[at + len(run) :].startswith(L.OPENINGS):
                out[-1].append("")
            else:
                out[-1][-1] += "".join(" " if c != "." else c for c in re.sub(r"[^.]+", " ", run))
        at += len(run)
    return [[re.sub(r"^[ .]+|[ .]+$", "", x) for x in lines] for lines in out]


def slow_scan(text):
    """The identifiers and licences of a text, by lists."""
    known, ids = dict(L.SENTENCES), []

    def named(x):
        for pattern, to in L.CANON:
            x = re.sub(pattern, to.replace("{1}", r"\1").replace("{2}", r"\2"), x)
        return known.get(x)

    for lines in cut(text or ""):
        lines = [x for x in lines if x] or [""]
        whole = named(" ".join(lines))
        found = [whole] if whole else [named(x) or ("UNKNOWN" if "licens" in x or "endorse or promote" in x else None) for x in lines]
        ids += [x for x in found if x]
    rest, licences = list(ids), set()
    for licence, need in L.ALL_RULES:
        i = 0
        while i < len(rest):
            if rest[i : i + len(need)] == list(need):
                rest[i : i + len(need)] = [None]
                licences.add(licence)
            i += 1
    return ",".join(ids), ",".join(sorted(licences)), rest.count("UNKNOWN")


def scan(spark, *texts):
    return [(r["licenses"], r["n_unknown"]) for r in L.license_scan(docs(spark, texts)).orderBy("doc_id").collect()]


def test_every_sentence_has_a_cue():
    assert all(any(c in s for c in L.CUES) for s, _ in L.SENTENCES)
    assert {x for _, need in L.ALL_RULES for x in need} <= {i for _, i in L.SENTENCES} | {"UNKNOWN"}


def test_rules(spark):
    assert scan(spark, MIT) == [("MIT", 0)]
    assert scan(spark, "Some text\nReleased under the MIT License.\nMore.") == [("MIT", 0)]
    assert scan(spark, "SPDX-License-Identifier: Apache-2.0") == [("Apache-2.0", 0)]
    assert scan(spark, "Foo.&&& Licensed### under the*** Apache License, Version 2.0. bar") == [("Apache-2.0", 0)]
    assert scan(spark, "This is under some license of ours. Licensed under CC BY-NC 4.0.") == [("CC-BY-NC-4.0", 1)]


def forms(text):
    bodies = [text, wrapped(text, 40), wrapped(text, 63), wrapped(text, 200)]
    return bodies + [commented(x, sign) for x in bodies for sign in ("#", " *", "//")]


def test_standard_notices(spark):
    """Each notice, in four wrappings, bare and in three kinds of comments, and after prose."""
    want, texts = [], []
    for name, text in STANDARD:
        for x in forms(text) + ["Some prose here.\n\n" + text]:
            want.append(name)
            texts.append(x)
    got = scan(spark, *texts)
    wrong = [(name, found, text[:300]) for name, (found, _), text in zip(want, got, texts, strict=True) if found != name]
    assert not wrong, wrong[:3]
    assert scan(spark, GPL2.replace("version 2", "version 3"), GPL3.replace("version 3", "version 2")) == [("GPL-3.0-or-later", 0), ("GPL-2.0-or-later", 0)]
    assert scan(spark, "x\nThis software is not licensed under the MIT License.") == [("", 1)]


def test_references(spark):
    said = {"Licensed under the GPLv3 or later.": "GPL-3.0-or-later", "This project is distributed under the terms of the GNU LGPL v2.1.": "LGPL-2.1-only", "Available under the terms of version 2 of the GNU General Public License.": "GPL-2.0-only", "# SPDX-License-Identifier: GPL-2.0+": "GPL-2.0-or-later", "SPDX-License-Identifier: CC-BY-SA-4.0": "CC-BY-SA-4.0", "This work is\nlicensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": "CC-BY-NC-4.0", "Released under the 3-clause BSD license": "BSD-3-Clause", "published under the MIT": "MIT", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n": "GPL-3.0-only"}
    assert [x for x, _ in scan(spark, *said)] == list(said.values())


ASF = """Licensed to the Apache Software Foundation (ASF) under one or more
contributor license agreements.  See the NOTICE file distributed with
this work for additional information regarding copyright ownership.
The ASF licenses this file to You under the Apache License, Version 2.0
(the "License"); you may not use this file except in compliance with
the License.  You may obtain a copy of the License at

   http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""

BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""


def test_headers_and_expressions(spark):
    cases = [
        (ASF, "Apache-2.0"),
        (textwrap.indent(ASF, " * "), "Apache-2.0"),
        (ASF.replace("Apache Software Foundation (ASF)", "Elasticsearch").replace("The ASF licenses", "Elasticsearch licenses"), "Apache-2.0"),
        (BSD, "BSD-2-Clause"),
        (BSD + "3. Neither the name of the Foo nor the names of its contributors may be used to\n   endorse or promote products derived from this software without prior written\n   permission.", "BSD-3-Clause"),
        (BSD + "3. Neither Foo Corp nor the names of its contributors may be used to endorse or\n   promote products derived from this software without specific prior written\n   permission.", "BSD-3-Clause"),
        (BSD + "3. No one may endorse or promote anything with this.", "LicenseRef-BSD-variant"),
        ("// SPDX-License-Identifier: MIT OR Apache-2.0\nint x;", "Apache-2.0,MIT"),
        ("# SPDX-License-Identifier: (MIT AND BSD-3-Clause) OR ISC", "BSD-3-Clause,ISC,MIT"),
        ("/* SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note */", "GPL-2.0-only"),
        ("SPDX-License-Identifier: GPL-2.0-or-later OR MPL-2.0", "GPL-2.0-or-later,MPL-2.0"),
        ("Use of this source code is governed by a BSD-style license that can be\nfound in the LICENSE file.", "LicenseRef-BSD-style"),
        ("Licensed under the Apache License, Version 2.0 <LICENSE-APACHE or\nhttp://www.apache.org/licenses/LICENSE-2.0> or the MIT license\n<LICENSE-MIT or http://opensource.org/licenses/MIT>, at your option.", "Apache-2.0 OR MIT"),
        ("Released under the PostgreSQL License", "PostgreSQL"),
        ("This file is licensed under the Artistic License 2.0.", "Artistic-2.0"),
    ]
    got = {r["doc_id"]: r["licenses"] for r in L.license_scan(docs(spark, [t for t, _ in cases])).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_a_long_text_of_cues(spark):
    import time

    start = time.time()
    row = L.license_scan(docs(spark, ["a license or two " * 300_000 + ".\n" + MIT])).first()
    assert row["licenses"] == "MIT" and time.time() - start < 60


def test_against_a_cutter_in_python(spark, sf):
    rng = random.Random(3)
    pieces = [*"aA1v. ;:!?\n\t-#*(", "\n\n", ". ", ":\n", "\nCopyright ", "license", " v. 2.0 ", "Released under the MIT License", "SPDX-License-Identifier: MIT", "\nlicensed under the gpl v3", "the above copyright notice", "é", "\r\n"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(600)]
    texts += [x for _, t in STANDARD for x in forms(t)] + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = L.license_scan(docs(spark, texts)).orderBy("doc_id").collect()
    for text, r in zip(texts, rows, strict=True):
        assert (r["sentence_ids"], r["licenses"], r["n_unknown"]) == slow_scan(text), text
        assert r["is_licensed"] == bool(r["licenses"])


def test_edges(spark):
    assert scan(spark, None, "", "plain words", "x " * 50_000) == [("", 0)] * 4
    assert L.license_scan(clash(docs(spark, ["Released under the MIT License."] * 2))).count() == 2
    assert L.license_scan(docs(spark, ["a"]).where("false")).count() == 0


def test_query(spark, sf):
    same_rows(QUERIES["op1_license_scan"](spark, sf), connect(sf), ORACLES["op1_license_scan"])
