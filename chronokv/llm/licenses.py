"""Licence recognition by sentence rules (after German, Manabe and Inoue 2010), in DataFrame functions alone.

Lines of a paragraph are joined, comment marks in front of them go, and the paragraph is cut into sentences, which are brought to lower case and single spaces.  A
known sentence becomes its identifier, and ordered rules are matched against the sequence of identifiers.  A rule that
matches leaves a mark in the place of its identifiers: a general rule doesn't fire on what a special one has explained, and what stood apart stays apart.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plain(text: str) -> str:
    """A sentence as sentences are compared: lower case, words of ASCII letters and digits, single spaces."""
    return re.sub("[^0-9a-z]+", " ", text.lower()).strip()


# The names of licences and the wording of their notices.
#: Licence, and a pattern of its name after "under the".  The first that matches counts.
NAMES: list[tuple[str, str]] = [
    ("Apache-1.1", "apache (software )?license (version |v )?1 1"),
    ("Apache-2.0", "apache (software )?license( (version |v ?)?2( 0)?)?|apache 2( 0)?"),
    ("MIT", "(mit|expat|x11)( x11)?"),
    ("MIT-0", "mit no attribution|mit 0"),
    ("BSD-2-Clause", "(simplified |freebsd )bsd|(bsd )?(2|two) clause( bsd)?|bsd 2"),
    ("BSD-3-Clause", "(new |modified |revised )bsd|(bsd )?(3|three) clause( bsd)?|bsd 3"),
    ("BSD-4-Clause", "(original |old )bsd|(bsd )?(4|four) clause( bsd)?"),
    ("BSD", "bsd( style)?"),
    ("AGPL-3.0-or-later", "(gnu affero general public license|(gnu )?agpl) ?(version |v ?)?3( 0)? (or later|or any later version|or at your option any later version)"),
    ("AGPL-3.0", "(gnu affero general public license|(gnu )?agpl) ?(version |v ?)?3( 0)?( only)?"),
    ("LGPL-3.0-or-later", "(gnu lesser general public license|(gnu )?lgpl) ?(version |v ?)?3( 0)? (or later|or any later version|or at your option any later version)"),
    ("LGPL-3.0", "(gnu lesser general public license|(gnu )?lgpl) ?(version |v ?)?3( 0)?( only)?"),
    ("LGPL-2.1-or-later", "(gnu lesser general public license|(gnu )?lgpl) ?(version |v ?)?2 1 (or later|or any later version|or at your option any later version)"),
    ("LGPL-2.1", "(gnu lesser general public license|(gnu )?lgpl) ?(version |v ?)?2 1( only)?"),
    ("LGPL-2.0", "(gnu library general public license|(gnu )?lgpl) ?(version |v ?)?2( 0)?( only)?"),
    ("LGPL", "gnu (lesser|library) general public|(gnu )?lgpl"),
    ("GPL-3.0-or-later", "(gnu general public license|(gnu )?gpl) ?(version |v ?)?3( 0)? (or later|or any later version|or at your option any later version)"),
    ("GPL-3.0", "(gnu general public license|(gnu )?gpl) ?(version |v ?)?3( 0)?( only)?"),
    ("GPL-2.0-or-later", "(gnu general public license|(gnu )?gpl) ?(version |v ?)?2( 0)? (or later|or any later version|or at your option any later version)"),
    ("GPL-2.0", "(gnu general public license|(gnu )?gpl) ?(version |v ?)?2( 0)?( only)?"),
    ("GPL", "gnu general public|(gnu )?gpl"),
    ("MPL-1.1", "(mozilla public license|mpl) ?(version |v ?)?1 1"),
    ("MPL-2.0", "(mozilla public license|mpl) ?(version |v ?)?2( 0)?"),
    ("EPL-1.0", "(eclipse public license|epl) ?(version |v ?)?1( 0)?"),
    ("EPL-2.0", "(eclipse public license|epl) ?(version |v ?)?2( 0)?"),
    ("CDDL-1.0", "(common development and distribution license|cddl)( (version |v ?)?1( 0)?)?"),
    ("EUPL-1.2", "(european union public licen[cs]e|eupl)( (version |v ?)?1 2)?"),
    ("Artistic-2.0", "artistic license (version |v ?)?2( 0)?"),
    ("Artistic-1.0", "artistic( license( (version |v ?)?1( 0)?)?)?|perl artistic"),
    ("ISC", "isc"),
    ("Zlib", "zlib( libpng)?"),
    ("BSL-1.0", "boost( software)?( license( (version |v ?)?1( 0)?)?)?"),
    ("Unlicense", "unlicense"),
    ("WTFPL", "wtfpl|do what the f ?u?c?k you want to public"),
    ("PSF-2.0", "(python software foundation|psf)( license( (version |v ?)?2( 0)?)?)?"),
    ("OFL-1.1", "(sil )?open font( license( (version |v ?)?1 1)?)?"),
    ("CC0-1.0", "(cc|creative commons) ?(0|zero)( 1 0)?( universal)?"),
    *[
        (f"CC-{kind.upper().replace(' ', '-')}{'-' + v if v else ''}", f"(cc|creative commons) ({kind}|{name})" + (f"( license)? {v.replace('.', ' ')}( (international|unported|generic))?" if v else ""))
        for v in ("4.0", "3.0", "2.5", "2.0", "1.0", "")
        for kind, name in (("by nc sa", "attribution noncommercial sharealike"), ("by nc nd", "attribution noncommercial noderivatives"), ("by nc", "attribution noncommercial"), ("by sa", "attribution sharealike"), ("by nd", "attribution noderivatives"), ("by", "attribution"))
    ],
]
#: Notice identifier and the sentences that it stands for.
NOTICES: list[tuple[str, str]] = [
    ("ApacheComply", "you may not use this file except in compliance with the License"),
    ("ApacheCopyAt", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("ApacheCopyAt", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"),
    ("ApacheCopyAt", "You may obtain a copy of the License at"),
    ("ApacheUnless", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("ApacheUnless", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS"),
    ("ApacheLimits", "See the License for the specific language governing permissions and limitations under the License"),
    ("ApacheContrib", "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements"),
    ("ApacheNotice", "See the NOTICE file distributed with this work for additional information regarding copyright ownership"),
    ("ApacheGrant", "The ASF licenses this file to you under the Apache License, Version 2.0 (the \"License\")"),
    ("MITPermit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("MIT0Permit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("MITPermit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MITNotice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("MITNotice", "The above copyright notice and this permission notice shall be included in all copies"),
    ("MITNotice", "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software"),
    ("AsIsMIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"),
    ("AsIsMIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND"),
    ("AsIsMIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED"),
    ("LiableMIT", "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"),
    ("BSDPermit", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSDSource", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("BSDBinary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("BSDAdvert", "All advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("BSDEndorse", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("AsIsBSD", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED"),
    ("LiableBSD", "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES"),
    ("ISCPermit", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("BSD0Permit", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("AsIsISC", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS"),
    ("ZlibAsIs", "This software is provided 'as-is', without any express or implied warranty"),
    ("ZlibLiable", "In no event will the authors be held liable for any damages arising from the use of this software"),
    ("ZlibPermit", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("BoostPermit", "Distributed under the Boost Software License, Version 1.0"),
    ("MPL2Subject", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("MPL2CopyAt", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    ("MPL2CopyAt", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"),
    ("MPL11Subject", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\")"),
    ("EPL1Terms", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution"),
    ("EPL1Terms", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution"),
    ("EPL2Terms", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("UnlicenseFree", "This is free and unencumbered software released into the public domain"),
    ("PublicDomain", "This work is in the public domain"),
    ("PublicDomain", "Released into the public domain"),
    ("PublicDomain", "This file is in the public domain"),
    ("GPLWarranty", "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    ("GPLHope", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"),
    ("GPLClasspath", "As a special exception, the copyright holders of this library give you permission to link this library with independent modules to produce an executable, regardless of the license terms of these independent modules"),
    ("SameTerms", "This library is free software; you can redistribute it and/or modify it under the same terms as Perl itself"),
    ("SameTerms", "you can redistribute it and/or modify it under the same terms as Perl itself"),
    ("AllRights", "All rights reserved"),
]
_GPL_BODY = "you can redistribute it and or modify it under the terms of the gnu {kind}general public license as published by the free software foundation {version}"
#: Identifier and a pattern for sentences that name a holder, a year or a version.
TEMPLATES: list[tuple[str, str]] = [
    *[
        (f"{name}{version.replace(' ', '')}{'Later' if later else 'Only'}", f"(this .{{1,60}} is free software )?{_GPL_BODY.format(kind=kind, version='(either )?version ' + version + ' of the license' + (' or at your option any later version' if later else '( only)?'))}")
        for name, kind, versions in (("GPL", "", ("2", "3")), ("LGPL", "lesser ", ("2 1", "3")), ("LGPL", "library ", ("2",)), ("AGPL", "affero ", ("3",)))
        for version in versions
        for later in (True, False)
    ],
    ("GPLReceived", "you should have received a copy of the gnu (lesser |library |affero )?general public license( along with this (program|library|software|file))?"),
    ("GPLSee", "see the gnu (lesser |library |affero )?general public license for more details"),
    ("BSDEndorse", "neither the names? of .{1,80} nor the names of (its|their) contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("AsIsBSD", "this software is provided by .{1,80} as is and any express or implied warranties .{0,40}including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("LiableBSD", "in no event shall .{1,80} be liable for any direct indirect incidental special exemplary or consequential damages .{1,400}"),
    ("CopyrightAllRights", "(portions )?copyright (c )?(19|20)[0-9]{2}[0-9a-z ]{0,100} all rights reserved"),
    ("Copyright", "(portions )?copyright (c )?(19|20)[0-9]{2}[0-9a-z ]{0,100}|copyright c [0-9a-z ]{1,100}"),
]
#: Rules over several notices, most special first.
_TEXT_RULES: list[tuple[str, tuple[str, ...]]] = [
    ("Apache-2.0", ("ApacheContrib", "ApacheNotice", "ApacheGrant", "ApacheComply", "ApacheCopyAt", "ApacheUnless", "ApacheLimits")),
    ("Apache-2.0", ("Name:Apache-2.0", "ApacheComply", "ApacheCopyAt", "ApacheUnless", "ApacheLimits")),
    ("Apache-2.0", ("Name:Apache-2.0", "ApacheComply", "ApacheCopyAt")),
    ("Apache-2.0", ("ApacheGrant",)),
    ("MIT", ("MITPermit", "MITNotice", "AsIsMIT", "LiableMIT")),
    ("MIT", ("MITPermit", "MITNotice", "AsIsMIT")),
    ("MIT", ("MITPermit", "MITNotice")),
    ("MIT-0", ("MIT0Permit", "AsIsMIT")),
    ("BSD-4-Clause", ("BSDPermit", "BSDSource", "BSDBinary", "BSDAdvert")),
    ("BSD-3-Clause", ("BSDPermit", "BSDSource", "BSDBinary", "BSDEndorse", "AsIsBSD")),
    ("BSD-3-Clause", ("BSDPermit", "BSDSource", "BSDBinary", "BSDEndorse")),
    ("BSD-2-Clause", ("BSDPermit", "BSDSource", "BSDBinary", "AsIsBSD")),
    ("BSD-2-Clause", ("BSDPermit", "BSDSource", "BSDBinary")),
    ("BSD", ("BSDPermit",)),
    ("ISC", ("ISCPermit", "AsIsISC")),
    ("ISC", ("ISCPermit",)),
    ("0BSD", ("BSD0Permit", "AsIsISC")),
    ("Zlib", ("ZlibAsIs", "ZlibLiable", "ZlibPermit")),
    ("Zlib", ("ZlibPermit",)),
    ("BSL-1.0", ("BoostPermit",)),
    ("MPL-2.0", ("MPL2Subject", "MPL2CopyAt")),
    ("MPL-2.0", ("MPL2Subject",)),
    ("MPL-1.1", ("MPL11Subject",)),
    ("EPL-1.0", ("EPL1Terms",)),
    ("EPL-2.0", ("EPL2Terms",)),
    ("Unlicense", ("UnlicenseFree",)),
    ("Artistic-1.0-Perl OR GPL-1.0-or-later", ("SameTerms",)),
    *[
        (f"{family}-{'2.1' if digits == '21' else digits + '.0'}{'-or-later' if later == 'Later' else ''}{exception}", (f"{family}{digits}{later}", *more))
        for exception, more in ((" WITH Classpath-exception-2.0", ("GPLHope", "GPLWarranty", "GPLSee", "GPLReceived", "GPLClasspath")), ("", ("GPLHope", "GPLWarranty", "GPLSee", "GPLReceived")), ("", ("GPLHope", "GPLSee", "GPLReceived")), ("", ()))
        for family, every in (("GPL", ("2", "3")), ("LGPL", ("2", "21", "3")), ("AGPL", ("3",)))
        for digits in every
        for later in ("Later", "Only")
    ],
]
#: Identifiers of licences as the SPDX list writes them, for lines that state one.
SPDX = list(dict.fromkeys([n for n, _ in NAMES if n not in ("BSD", "LGPL", "GPL")] + ["GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "AGPL-3.0-only", "0BSD", "Artistic-1.0-Perl", "MS-PL", "NCSA", "OpenSSL", "PHP-3.01", "PostgreSQL", "Ruby", "Vim", "W3C"]))
# What follows is made from the tables above.
_UNDER = "((this|the) )?(([a-z]{1,20} )?(file|work|software|program|page|code|package|project|library|document) )?((is|are) )?(free software )?((also|dual|hereby|being) )?((licensed|licenced|released|distributed|available|made available|published|provided) )?(to you )?under (an? |the )?(terms (and conditions )?of (an? |the )?)?"
#: The sentences that are compared whole, and those that are patterns; both give identifiers.
WHOLE: dict[str, str] = {plain(t): i for i, t in NOTICES} | {plain(f"SPDX-License-Identifier: {i}"): f"Spdx:{i}" for i in SPDX}
PATTERNS: list[tuple[str, str]] = [(f"Name:{i}", f"{_UNDER}({p})( licen[cs]e)?( the license)?") for i, p in NAMES] + TEMPLATES
RULES: list[tuple[str, tuple[str, ...]]] = [
    *_TEXT_RULES,
    *[(i, (f"Spdx:{i}",)) for i in SPDX],
    *[(i, (f"Name:{i}",)) for i, _ in NAMES],
    ("public-domain", ("PublicDomain",)),
    ("AllRightsReserved", ("CopyrightAllRights",)),
    ("AllRightsReserved", ("Copyright", "AllRights")),
]
#: A sentence without any of these can't be a known one, however it is spaced.
HINTS = "licen[cs]e|copyright|warrant|permi|reserved|redistribut|public domain|unlicense|liable|advertising|under|apply|applicable|obtain|disclaim|notice"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = "[ \\t\\x0b\\x0c]*"
#: Steps before the cut, as pattern and what takes its place (\\1: the first group).  Comment marks go; a line that begins like a known notice begins a
#: paragraph; a line that states a holder or an identifier is one by itself; "v. 2" is no end of a sentence.
STEPS: list[tuple[str, str]] = [
    ("\\r", ""),
    (f"(^|\\n){_SPACE}(?://+|/\\*+|\\*+/|\\*+|#+|--+|;+|<!--+){_SPACE}", "\\1"),
    (f"\\n{_SPACE}(copyright (?:\\(c\\)|[0-9])|\\(c\\) |portions copyright|spdx|all rights reserved|(?:licensed|released) under (?:the|an?|cc|creative|mit|bsd|gnu|gpl|apache)\\b|this (?:file|work|software|program|page|code|package|project|library|document|source) |permission (?:is|to) |redistribution and use|the above copyright notice and|the software is provided|in no event |you should have received|unless required by|neither the name)", "\\n\\n\\1"),
    (f"((?:^|\\n){_SPACE}(?:copyright (?:\\(c\\)|[0-9])|\\(c\\) |portions copyright|spdx|all rights reserved)[^\\n]*)", "\\1\\n"),
    ("\\bv\\. +([0-9])", "v \\1"),
    ("(spdx-license-identifier):", "\\1"),
]
#: Sentences end with a paragraph, or at a stop with white space after it.
BREAK = f"\\n{_SPACE}\\n|[.!?:;][ \\t\\n\\x0b\\x0c]+"


def _identifier(sentence: Column) -> Column:
    out = F.lit("")
    for name, pattern in reversed(PATTERNS):
        out = F.when(sentence.rlike(f"^({pattern})$"), F.lit(name)).otherwise(out)
    whole = F.create_map(*[F.lit(x) for pair in WHOLE.items() for x in pair])
    return F.coalesce(whole[sentence], out)


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_sentences, sentence_ids, licenses and verdict of every whole text.

    n_sentences counts sentences with a letter or digit of ASCII.  sentence_ids are the known ones in their order, joined by ``,``;
    licenses are what the rules find, in the order of the rules, each once, joined by ``,``.  The verdict is ``none`` (no known sentence),
    ``unknown`` (known ones, but no rule matches) or ``found``.  Null and empty texts have no sentences.  Null ids and repeated rows are scanned like
    any other; an empty table gives no rows; other columns are not read.
    """
    body = F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER)
    for pattern, new in STEPS:
        body = F.regexp_replace(body, pattern, new.replace("\\1", "$1").replace("\\n", "\n"))
    rough = F.filter(F.split(body, BREAK), lambda s: s.rlike("[0-9a-z]"))
    step = docs.select("doc_id", rough.alias("_s"))
    known = F.filter(F.transform(F.filter("_s", lambda s: s.rlike(HINTS)), lambda s: _identifier(F.trim(F.regexp_replace(s, "[^0-9a-z]+", " ")))), lambda i: i != "")
    step = step.select("doc_id", F.size("_s").cast("long").alias("n_sentences"), known.alias("_k"))
    # Identifiers are kept as ,A,,B, so that neighbours don't share a comma; a rule's are written alike, and its mark is ,#, in their place.
    rules = F.array(*[F.struct(F.lit("," + ",,".join(ids) + ",").alias("ids"), F.lit(name).alias("name")) for name, ids in RULES])
    start = F.struct(F.concat(F.lit(","), F.array_join("_k", ",,"), F.lit(",")).alias("rest"), F.array().cast("array<string>").alias("found"))

    def use(acc: Column, rule: Column) -> Column:
        hit = F.contains(acc["rest"], rule["ids"])
        return F.when(hit, F.struct(F.replace(acc["rest"], rule["ids"], F.lit(",#,")).alias("rest"), F.array_union(acc["found"], F.array(rule["name"])).alias("found"))).otherwise(acc)

    licenses = F.when(F.size("_k") == 0, F.lit("")).otherwise(F.aggregate(rules, start, use, lambda acc: F.array_join(acc["found"], ",")))
    step = step.select("doc_id", "n_sentences", F.array_join("_k", ",").alias("sentence_ids"), licenses.alias("licenses"))
    return step.withColumn("verdict", F.when(F.col("sentence_ids") == "", "none").when(F.col("licenses") == "", "unknown").otherwise("found"))


def oracle_sql(source: str = "documents") -> str:
    """DuckDB SQL with the rows of :func:`scanned`, from the same tables of sentences and rules.

    It joins sentences with the tables instead of looking into maps, and finds a rule's licences by the places of identifiers: a rule takes, from the left, each run of places
    that bear its identifiers and that no earlier rule has taken.
    """
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    body = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
    for pattern, new in STEPS:
        put = " || ".join(["''", *("chr(10)" if part == "\\n" else quote(part) for part in re.findall(r"\\n|(?:(?!\\n).)+", new))])
        body = f"regexp_replace({body}, {quote(pattern)}, {put}, 'g')"
    values = lambda rows: ", ".join("(" + ", ".join(map(str, r)) + ")" for r in rows)
    whole = values((quote(s), quote(i)) for s, i in WHOLE.items())
    patterns = values((n, quote(p), quote(i)) for n, (i, p) in enumerate(PATTERNS))
    rules = values((n, quote(name), len(ids), "[" + ", ".join(map(quote, ids)) + "]") for n, (name, ids) in enumerate(RULES))
    return f"""
WITH RECURSIVE whole(s, i) AS (VALUES {whole}), patterns(n, p, i) AS (VALUES {patterns}), rules(n, name, size, ids) AS (VALUES {rules}),
cut AS (SELECT doc_id, list_filter(string_split_regex({body}, {quote(BREAK)}), lambda s: regexp_matches(s, '[0-9a-z]')) AS x, row_number() OVER () AS r FROM {source}),
sentences AS (SELECT r, unnest(x) AS s, unnest(range(len(x))) AS pos FROM cut),
hinted AS MATERIALIZED (SELECT r, pos, trim(regexp_replace(s, '[^0-9a-z]+', ' ', 'g')) AS s FROM sentences WHERE regexp_matches(s, {quote(HINTS)})),
texts AS MATERIALIZED (SELECT DISTINCT s FROM hinted),
by_pattern AS (SELECT s, min_by(i, n) AS i FROM texts JOIN patterns ON regexp_full_match(s, p) GROUP BY s),
named AS (SELECT s, coalesce(whole.i, by_pattern.i) AS i FROM texts LEFT JOIN whole USING (s) LEFT JOIN by_pattern USING (s) WHERE coalesce(whole.i, by_pattern.i) IS NOT NULL),
lists AS MATERIALIZED (SELECT r, list(i ORDER BY pos) AS k FROM hinted JOIN named USING (s) GROUP BY r),
kinds AS MATERIALIZED (SELECT DISTINCT k FROM lists),
steps AS (
  SELECT k, 0 AS n, 0 AS pos, list_transform(k, lambda i: i) AS rest, []::VARCHAR[] AS found FROM kinds
  UNION ALL
  SELECT k, CASE WHEN hit OR pos < len(k) THEN n ELSE n + 1 END, CASE WHEN hit THEN pos + size WHEN pos < len(k) THEN pos + 1 ELSE 0 END,
    CASE WHEN hit THEN list_transform(rest, lambda x, j: CASE WHEN j > pos AND j <= pos + size THEN '#' ELSE x END) ELSE rest END,
    CASE WHEN hit AND NOT list_contains(found, name) THEN list_append(found, name) ELSE found END
  FROM (SELECT steps.*, size, name, rest[pos + 1 : pos + size] = ids AS hit FROM steps JOIN rules USING (n))
),
done AS (SELECT k, array_to_string(found, ',') AS licenses FROM steps WHERE n = {len(RULES)})
SELECT doc_id, len(x)::BIGINT AS n_sentences, coalesce(array_to_string(lists.k, ','), '') AS sentence_ids, coalesce(licenses, '') AS licenses,
  CASE WHEN lists.k IS NULL THEN 'none' WHEN coalesce(licenses, '') = '' THEN 'unknown' ELSE 'found' END AS verdict
FROM cut LEFT JOIN lists USING (r) LEFT JOIN done USING (k)"""
