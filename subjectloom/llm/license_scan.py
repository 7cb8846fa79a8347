"""Licence scan by sentence rules.

German, Manabe and Inoue, "A sentence-matching method for automatic license
identification of source code files" (2010): a text is cut into sentences, each
normalised sentence is mapped to a known licence-sentence identifier, and the
sequence of identifiers is matched against ordered licence rules; what a rule
matches is consumed, so that specific rules stand before general ones.

Everything is a projection of one row: no shuffle, no Python on executors.  The
expensive part runs only where a cue word occurs, and every known sentence holds
a cue (a test checks it), so the guard changes no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import clean_text

# Words of which every licence sentence has at least one, as it stands in a text;
# single words, since lines break anywhere.
CUES = ("licens", "licenc", "copyright", "permission", "redistribution", "warrant", "spdx", "domain", "released", "distributed", "available", "published")

# Beginnings of lines that may open a new sentence even after a line without a
# full stop.  Such a border is soft: where the lines make a known sentence together, it is one.
OPENINGS = ("licensed under", "released under", "distributed under", "this work is", "this software is", "this program is", "this project is", "this library is", "this file is", "permission is hereby", "permission is granted", "permission to use", "redistribution and use", "redistributions of source", "redistributions in binary", "copyright", "spdx", "the above copyright", "the software is provided", "neither the name", "you may obtain", "you should have", "unless required by", "all rights reserved")

# Normalised sentence, identifier, as STEPS cut and CANON rewrites the original
# notices: at every ";" or ":" before a space or the end of a line.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", "MIT_GRANT"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "MIT_NOTICE"),
    ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "MIT_WARRANTY"),
    ("licensed to the holder under one or more contributor license agreements", "CONTRIBUTOR"),
    ("see the notice file distributed with this work for additional information regarding copyright ownership", "NOTICE_FILE"),
    ("you may not use this file except in compliance with the license", "APACHE_USE"),
    ("you may obtain a copy of the license at http www.apache.org licenses license 2.0", "APACHE_COPY"),
    ("you may obtain a copy of the license at https www.apache.org licenses license 2.0", "APACHE_COPY"),
    ("you may obtain a copy of the license at", "APACHE_COPY"),
    ("http www.apache.org licenses license 2.0", "APACHE_URL"),
    ("https www.apache.org licenses license 2.0", "APACHE_URL"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "APACHE_WARRANTY"),
    ("see the license for the specific language governing permissions and limitations under the license", "APACHE_SEE"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "BSD_GRANT"),
    ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "BSD_SOURCE"),
    ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "BSD_BINARY"),
    ("all advertising materials mentioning features or use of this software must display the following acknowledgement copyright", "BSD_ADVERTISING"),
    ("neither the name of the holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "BSD_NAME"),
    ("use of this source code is governed by a bsd style license that can be found in the license file", "BSD_STYLE_REF"),
    ("licensed under the apache license version 2.0 or the mit license at your option", "APACHE_OR_MIT_REF"),
    ("nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "BSD_NAME"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "ISC_GRANT"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "0BSD_GRANT"),
    ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", "ZLIB_GRANT"),
    ("this software is provided as is without any express or implied warranty", "ZLIB_WARRANTY"),
    ("this source code form is subject to the terms of the mozilla public license version 2.0", "MPL2_REF"),
    ("the contents of this file are subject to the mozilla public license version 1.1 the license", "MPL11_REF"),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license version 1.0", "EPL1_REF"),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license version 2.0", "EPL2_REF"),
    ("this is free and unencumbered software released into the public domain", "UNLICENSE_REF"),
    ("released into the public domain", "PUBLIC_DOMAIN_REF"),
    ("all copyright to this work is dedicated to the public domain by cc0", "CC0_REF"),
    ("without even the implied warranty of merchantability or fitness for a particular purpose", "GNU_IMPLIED"),
    ("if not see https www.gnu.org licenses", "GNU_URL"),
    ("if not see http www.gnu.org licenses", "GNU_URL"),
)

# Licence, the names by which notices refer to it.
NAMES = (
    ("MIT", ("mit license", "mit licence", "expat license", "mit")),
    ("Apache-2.0", ("apache license version 2.0", "apache license 2.0", "apache software license version 2.0", "apache 2.0 license", "apache 2.0")),
    ("BSD-2-Clause", ("bsd 2 clause license", "2 clause bsd license", "simplified bsd license", "bsd 2 clause")),
    ("BSD-3-Clause", ("bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license", "bsd 3 clause")),
    ("ISC", ("isc license", "isc licence")),
    ("Zlib", ("zlib license", "zlib libpng license")),
    ("BSL-1.0", ("boost software license version 1.0", "boost software license 1.0")),
    ("MPL-2.0", ("mozilla public license version 2.0", "mozilla public license 2.0", "mpl 2.0")),
    ("MPL-1.1", ("mozilla public license version 1.1", "mozilla public license 1.1", "mpl 1.1")),
    ("EPL-1.0", ("eclipse public license version 1.0", "eclipse public license 1.0", "epl 1.0")),
    ("EPL-2.0", ("eclipse public license version 2.0", "eclipse public license 2.0", "epl 2.0")),
    ("Unlicense", ("unlicense",)),
    ("WTFPL", ("wtfpl", "wtfpl version 2", "do what the fuck you want to public license")),
    ("PostgreSQL", ("postgresql license", "postgresql licence")),
    ("Artistic-2.0", ("artistic license 2.0", "artistic license version 2.0")),
    ("CC0-1.0", ("cc0 1.0", "cc0 1.0 universal license", "creative commons zero version 1.0 universal license")),
)

# Headings of whole licence texts.
HEADINGS = (
    ("GPL-2.0-only", ("gnu general public license version 2 june 1991",)),
    ("GPL-3.0-only", ("gnu general public license version 3 29 june 2007",)),
    ("LGPL-2.1-only", ("gnu lesser general public license version 2.1 february 1999",)),
    ("LGPL-3.0-only", ("gnu lesser general public license version 3 29 june 2007",)),
    ("AGPL-3.0-only", ("gnu affero general public license version 3 19 november 2007",)),
    ("Apache-2.0", ("apache license version 2.0 january 2004 http www.apache.org licenses", "apache license version 2.0 january 2004")),
    ("MIT", ("mit license", "the mit license", "the mit license mit")),
    ("ISC", ("isc license", "the isc license")),
    ("BSD-2-Clause", ("bsd 2 clause license", "the bsd 2 clause license")),
    ("BSD-3-Clause", ("bsd 3 clause license", "the bsd 3 clause license")),
    ("MPL-2.0", ("mozilla public license version 2.0",)),
    ("EPL-1.0", ("eclipse public license version 1.0",)),
    ("EPL-2.0", ("eclipse public license version 2.0",)),
    ("BSL-1.0", ("boost software license version 1.0 17 august 2003", "boost software license version 1.0 august 17th 2003")),
)

# Name, short name and versions of the GNU licences.
GNU = (("gnu general public license", "GPL", ("2", "3")), ("gnu lesser general public license", "LGPL", ("2.1", "3")), ("gnu library general public license", "LGPL", ("2",)), ("gnu affero general public license", "AGPL", ("3",)))
# What notices call the licensed work.
WORKS = ("program", "library", "software", "file", "package")

# Elements of the Creative Commons licences: code, words.
COMMONS = (("by", "attribution"), ("by sa", "attribution sharealike"), ("by nc", "attribution noncommercial"), ("by nd", "attribution noderivatives"), ("by nc sa", "attribution noncommercial sharealike"), ("by nc nd", "attribution noncommercial noderivatives"))


def _gnu() -> tuple[dict[str, str], list[tuple[str, tuple[str, ...]]]]:
    """Sentences and rules of the GNU notices, which differ by name, version and work."""
    known: dict[str, str] = {}
    rules = []
    for name, short, versions in GNU:
        terms = f"you can redistribute it and or modify it under the terms of the {name}"
        known[f"{terms} as published by the free software foundation"] = f"{short}_TERMS"
        known[f"see the {name} for more details"] = f"{short}_SEE"
        for work in WORKS:
            known[f"this {work} is distributed in the hope that it will be useful but without any warranty"] = "GNU_USEFUL"
            known[f"this {work} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"] = "GNU_WARRANTY"
            known[f"you should have received a copy of the {name} along with this {work}"] = f"{short}_COPY"
        for v in versions:
            number = v if "." in v else f"{v}.0"
            only, later = f"{short}-{number}-only", f"{short}-{number}-or-later"
            any_later = f"either version {v} of the license or at your option any later version"
            known[any_later] = f"VERSION{v}_LATER"
            known[f"{terms} as published by the free software foundation {any_later}"] = f"{later}_REF"
            for said in {v, number}:
                lower = short.lower()
                named = [f"{name} version {said}", f"{lower} version {said}", f"{lower} {said}", f"{lower}v{said}", f"gnu {lower} version {said}", f"gnu {lower} {said}", f"gnu {lower}v{said}", f"version {said} of the {name}"]
                for x in named:
                    for end, meant in (("", only), (" only", only), (" license", only), (" or later", later), (" or any later version", later), (" or at your option any later version", later)):
                        known[f"licensed under the {x}{end}"] = f"{meant}_REF"
                for x in (f"{terms} version {said}", f"{terms} version {said} only"):
                    known[f"{x} as published by the free software foundation"] = f"{only}_REF"
                known[f"you can redistribute it and or modify it under the terms of version {said} of the {name} as published by the free software foundation"] = f"{only}_REF"
            rules += [(later, (f"{short}_TERMS", f"VERSION{v}_LATER")), (later, (f"{later}_REF",)), (only, (f"{only}_REF",))]
            for tag, meant in ((f"{number} only", only), (number, only), (f"{number} or later", later)):
                known[f"spdx license identifier {short.lower()} {tag}"] = f"{meant}_REF"
    return known, rules


def _known() -> tuple[tuple[tuple[str, str], ...], tuple[tuple[str, tuple[str, ...]], ...]]:
    """All sentences with their identifiers, and all ordered rules."""
    known, gnu_rules = _gnu()
    later = []
    for licence, names in NAMES:
        for x in names:
            for end in ("", " the license", " license"):
                known[f"licensed under the {x}{end}"] = f"{licence}_REF"
        known[f"spdx license identifier {licence.lower().replace('-', ' ')}"] = f"{licence}_REF"
    for code, words in COMMONS:
        for v in ("4.0", "3.0"):
            licence = f"CC-{code.upper().replace(' ', '-')}-{v}"
            for x in (f"cc {code} {v}", f"cc {code} {v} license", f"creative commons {words} {v} international license", f"creative commons {words} {v} license", f"creative commons {words} {v} unported license"):
                known[f"licensed under the {x}"] = f"{licence}_REF"
            known[f"spdx license identifier cc {code} {v}"] = f"{licence}_REF"
            later.append((licence, (f"{licence}_REF",)))
    for licence, texts in HEADINGS:
        known |= dict.fromkeys(texts, f"{licence}_HEAD")
        later.append((licence, (f"{licence}_HEAD",)))
    return tuple((known | dict(NOTICES)).items()), (*RULES, *gnu_rules, *[(licence, (f"{licence}_REF",)) for licence, _ in NAMES], *later)


# Licence, identifier sequence; earlier rules are applied first.
RULES = (
    ("BSD-4-Clause", ("BSD_GRANT", "BSD_SOURCE", "BSD_BINARY", "BSD_ADVERTISING", "BSD_NAME")),
    ("BSD-3-Clause", ("BSD_GRANT", "BSD_SOURCE", "BSD_BINARY", "BSD_NAME")),
    # A clause that is not known may change what the others mean: not the two-clause licence.
    ("LicenseRef-BSD-variant", ("BSD_GRANT", "BSD_SOURCE", "BSD_BINARY", "UNKNOWN")),
    ("LicenseRef-BSD-variant", ("BSD_GRANT", "BSD_SOURCE", "UNKNOWN", "BSD_BINARY")),
    ("BSD-2-Clause", ("BSD_GRANT", "BSD_SOURCE", "BSD_BINARY")),
    ("LicenseRef-BSD-style", ("BSD_STYLE_REF",)),
    ("Apache-2.0 OR MIT", ("APACHE_OR_MIT_REF",)),
    ("MIT", ("MIT_GRANT", "MIT_NOTICE", "MIT_WARRANTY")),
    ("MIT", ("MIT_GRANT", "MIT_NOTICE")),
    ("Apache-2.0", ("Apache-2.0_REF", "APACHE_USE", "APACHE_COPY", "APACHE_URL", "APACHE_WARRANTY", "APACHE_SEE")),
    ("Apache-2.0", ("Apache-2.0_REF", "APACHE_USE", "APACHE_COPY", "APACHE_WARRANTY", "APACHE_SEE")),
    ("Apache-2.0", ("Apache-2.0_REF", "APACHE_USE", "APACHE_COPY")),
    ("ISC", ("ISC_GRANT",)),
    ("0BSD", ("0BSD_GRANT",)),
    ("Zlib", ("ZLIB_GRANT",)),
    ("MPL-2.0", ("MPL2_REF",)),
    ("MPL-1.1", ("MPL11_REF",)),
    ("EPL-1.0", ("EPL1_REF",)),
    ("EPL-2.0", ("EPL2_REF",)),
    ("CC0-1.0", ("CC0_REF",)),
    ("Unlicense", ("UNLICENSE_REF",)),
    ("Public-Domain", ("PUBLIC_DOMAIN_REF",)),
)
SENTENCES, ALL_RULES = _known()

#: Mark sentence borders while a text is being normalised: certain ones, and openings of lines.
BORDER, SOFT = "\x01", "\x02"
#: (pattern, replacement) in order, on lower-cased text; the same in Java and RE2.
STEPS = (
    # A colon ends no sentence inside an SPDX tag, nor a full stop inside "v. 2.0".
    (r"spdx-license-identifier:[\x20\x09]*", "spdx license identifier "),
    # Each licence of an SPDX expression is a sentence of its own (five at most on a line); an exception is left out.
    (r"(spdx license identifier [^\n\x01]*?) with [a-z0-9.-]+", "{1}"),
    *[(r"(spdx license identifier [^\n\x01]*?) (?:or|and) ([a-z0-9(])", "{1}" + BORDER + "spdx license identifier {2}")] * 4,
    (r"(spdx license identifier [^\n\x01]*)\n", "{1}" + BORDER),
    (r"([^a-z0-9])v\.[^a-z0-9\n]*\n?[^a-z0-9\n]*([0-9])", "{1}version {2}"),
    (r"gpl([\x20v-]{0,2})([0-9][0-9.]*)\+", "gpl{1}{2} or later "),
    # A line without letters and digits, of whatever comment signs, ends a sentence.
    (r"\n[^a-z0-9\n]*\n", BORDER),
    (r"[.;!?:][^a-z0-9\x01]*[\n\x20\x09]", BORDER),
    (rf"\n[^a-z0-9\x01]*({'|'.join(OPENINGS)})", SOFT + "{1}"),
    (r"[^a-z0-9.\x01\x02]+", " "),
    (r"[\x20.\x02]*\x01[\x20.\x01\x02]*", BORDER),
    (r"[\x20.]*\x02[\x20.\x02]*", SOFT),
    (r"^[\x20.\x02]+|[\x20.]+$", ""),
)
#: (pattern, replacement) in order, on one normalised sentence: holders, subjects, versions
#: and numbers of clauses, which differ from notice to notice.
CANON = (
    (r" v ?([0-9])", " version {1}"),
    (r"^(?:[0-9]{1,2}|[a-e]) (redistributions|neither the|the name|all advertising)", "{1}"),
    (r"without (?:specific )?(?:prior )?written permission", "without specific prior written permission"),
    (r"^licensed to .* under one or more (?:contributor )?license agreements$", "licensed to the holder under one or more contributor license agreements"),
    (r"^(?:[a-z0-9. ]{1,60} )?licenses this file to you under the ", "licensed under the "),
    (r"^licensed under (?:either of )?(?:the )?apache license version 2\.0 .* or (?:the )?mit license .* at your option.*$", "licensed under the apache license version 2.0 or the mit license at your option"),
    (r"^use of this source code is governed by a bsd style license that can be found in the .*$", "use of this source code is governed by a bsd style license that can be found in the license file"),
    (r"^neither .* nor the names? of (?:its |their |the |any |other )*contributors may", "neither the name of the holder nor the names of its contributors may"),
    (r"^nor the names? of (?:its |their |the |any )?contributors may", "nor the names of its contributors may"),
    (r"^the names? of .* may not be used to endorse", "neither the name of the holder nor the names of its contributors may be used to endorse"),
    (r"^all advertising materials mentioning features or use of this software must display the following acknowledge?ment$", "all advertising materials mentioning features or use of this software must display the following acknowledgement copyright"),
    (r"^(this program and the accompanying materials are made available under the terms of the eclipse public license) (?:version )?([12]\.0).*$", "{1} version {2}"),
    (r"^to the extent possible under law .* all copyright and related (?:or|and) neighboring rights to .*$", "all copyright to this work is dedicated to the public domain by cc0"),
    (r"^(?:(?:this|the|our|all) [a-z0-9 ]{1,60} (?:is|are) )?(?:hereby )?(?:licensed|released|distributed|made available|available|published) under (?:the terms (?:and conditions )?of )?(?:the |a |an )?", "licensed under the "),
)


def _replaced(text: Column, steps) -> Column:
    for pattern, to in steps:
        text = F.regexp_replace(text, pattern, to.replace("{1}", "$1").replace("{2}", "$2"))
    return text


def license_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, sentence_ids, licenses, n_unknown, is_licensed`` of every row.

    ``sentence_ids``: identifiers in order, comma-joined; a sentence that speaks of
    a licence, or of endorsement, but is not known is UNKNOWN.  ``licenses``: distinct matches, sorted.
    Defined results: a null or empty text has no sentences ('' and '', 0, false);
    repeated rows are scanned alike; other columns of the input are ignored.
    """
    known = F.create_map(*[F.lit(x) for pair in SENTENCES for x in pair])
    low = F.lower("t")
    cue = F.lit(False)
    for c in CUES:
        cue = cue | F.col("low").contains(c)
    named = lambda x: F.try_element_at(known, _replaced(x, CANON))
    one = docs.select(F.col(id_col).alias("doc_id"), clean_text(text_col).alias("t")).select("doc_id", low.alias("low"))
    two = one.select("doc_id", F.when(cue, F.split(_replaced(F.col("low"), STEPS), BORDER)).alias("s"))
    # What names no licence and holds no cue is no sentence of a notice; the others are looked up
    # whole first, then line by line at soft borders.
    two = two.select("doc_id", F.transform("s", lambda x: F.struct(x.alias("x"), named(F.replace(x, F.lit(SOFT), F.lit(" "))).alias("whole"))).alias("s"))
    pieces = F.flatten(F.transform("s", lambda y: F.when(y["whole"].isNotNull(), F.array(F.struct(F.lit("").alias("x"), y["whole"].alias("id")))).otherwise(F.transform(F.split(y["x"], SOFT), lambda x: F.struct(x.alias("x"), named(x).alias("id"))))))
    ids = F.transform(pieces, lambda y: F.coalesce(y["id"], F.when(y["x"].contains("licens") | y["x"].contains("endorse or promote"), F.lit("UNKNOWN"))))
    three = two.select("doc_id", F.coalesce(F.filter(ids, lambda x: x.isNotNull()), F.array().cast("array<string>")).alias("ids"))
    seq = F.array_join(F.transform("ids", lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "")
    for licence, need in ALL_RULES:
        seq = F.replace(seq, F.lit("".join(f"<{x}>" for x in need)), F.lit(f"[{licence}]"))
    four = three.select("doc_id", F.array_join("ids", ",").alias("sentence_ids"), F.when(F.size("ids") > 0, seq).otherwise(F.lit("")).alias("seq"))
    found = F.array_sort(F.array_distinct(F.regexp_extract_all("seq", F.lit(r"\[([^\]]+)\]"), 1)))
    return four.select("doc_id", "sentence_ids", F.array_join(found, ",").alias("licenses"), F.regexp_count("seq", F.lit("<UNKNOWN>")).cast("long").alias("n_unknown"), F.contains("seq", F.lit("[")).alias("is_licensed"))


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    """``license_scan`` over the whole of ``documents``."""
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"

    def replaced(text: str, steps) -> str:
        for pattern, to in steps:
            marks = to.replace("{1}", "\\1").replace("{2}", "\\2")
            for c in (BORDER, SOFT):
                marks = marks.replace(c, f"' || chr({ord(c)}) || '")
            text = f"regexp_replace({text}, {quote(pattern)}, '{marks}', 'g')"
        return text

    known = "MAP {" + ", ".join(f"{quote(s)}: {quote(i)}" for s, i in SENTENCES) + "}"
    named = lambda x: f"({known})[{replaced(x, CANON)}]"
    seq = "array_to_string(list_transform(ids, lambda x: '<' || x || '>'), '')"
    for licence, need in ALL_RULES:
        seq = f"replace({seq}, {quote(''.join(f'<{x}>' for x in need))}, '[{licence}]')"
    return rf"""
WITH s AS (SELECT doc_id, string_split({replaced("lower(coalesce(text, ''))", STEPS)}, chr(1)) AS s FROM documents),
u AS (SELECT doc_id, unnest(s) AS x, unnest(range(len(s))) AS i FROM s WHERE len(s) > 0),
w AS (SELECT doc_id, i, x, {named("replace(x, chr(2), ' ')")} AS id FROM u),
v AS (SELECT doc_id, i, 0 AS j, '' AS x, id FROM w WHERE id IS NOT NULL
      UNION ALL SELECT doc_id, i, j, x, {named("x")} FROM (SELECT doc_id, i, unnest(string_split(x, chr(2))) AS x, unnest(range(len(string_split(x, chr(2))))) AS j FROM w WHERE id IS NULL)),
n AS (SELECT doc_id, i, j, coalesce(id, CASE WHEN contains(x, 'licens') OR contains(x, 'endorse or promote') THEN 'UNKNOWN' END) AS id FROM v),
l AS (SELECT doc_id, list(id ORDER BY i, j) AS ids FROM n WHERE id IS NOT NULL GROUP BY doc_id),
q AS (SELECT doc_id, array_to_string(ids, ',') AS sentence_ids, {seq} AS seq FROM (SELECT doc_id, coalesce(ids, []::VARCHAR[]) AS ids FROM documents LEFT JOIN l USING (doc_id)))
SELECT doc_id, sentence_ids, array_to_string(list_sort(list_distinct(regexp_extract_all(seq, '\[([^\]]+)\]', 1))), ',') AS licenses,
       len(regexp_extract_all(seq, '<UNKNOWN>'))::BIGINT AS n_unknown, contains(seq, '[') AS is_licensed FROM q
"""
