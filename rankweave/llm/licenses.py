"""License scans by sentence rules, in DataFrame functions alone.

A text is cut into sentences at blank lines and after ``.``, ``!``, ``?``, ``;`` or ``:`` with white space behind; a
single line end is a space, as license texts are wrapped, and a line without a letter or digit (of a comment's frame) is
blank. Lines that name a copyright's year or say that all rights are reserved end a sentence and are left out. A piece that isn't
known as a whole is cut at its line ends as well, so a notice on a line of its own is found among other lines.
Each sentence is normalised: lower case, everything but letters, digits and ``+`` one space. A literal map sends a
known sentence to its identifiers; unknown sentences fall out. Sentences between known ones don't stop a match,
their order does: a rule is an ordered list of identifiers, and it holds where its identifiers occur in that order
in the text, and none that it must not have. A rule that another matched rule contains (the title above the full text) isn't reported beside it.

Before the cut, slots are closed: whose name may not be used, whatever the name, and notices (``licensed under the X License``, in
whatever wording and whatever follows) become one sentence each; what is *not* licensed so is no notice. SPDX tags are read as
expressions: each license named, with ``AND``, ``OR``, parentheses and old spellings, exceptions after ``WITH`` aside.

All of it is one projection: the maps are literals of fixed size, so there is no shuffle, no join and
nothing to broadcast that grows.

Defined cases: null and empty texts have no sentences and no license; a wrapped sentence that begins on the line
after an unknown line without a stop isn't found; names in slots have 120 characters at most; SPDX identifiers that aren't listed are
left out; repeated rows are judged each; the result keeps one row per row of the input; other columns don't matter.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.llm.columns import pick


def plain(sentence: str) -> str:
    """A sentence as the scan sees it."""
    return " ".join(re.sub(r"[^a-z0-9+]+", " ", sentence.lower()).split())


#: Sentences of public license texts and notices, and the identifiers used here.
_TEXTS: tuple[tuple[str, str], ...] = (
    ("mit-notice", "Released under the MIT License"),
    ("mit-notice", "Released under MIT"),
    ("mit-notice", "Licensed under MIT"),
    ("mit-title", "The MIT License"),
    ("mit-title", "MIT License"),
    ("mit-title", "The MIT License (MIT)"),
    ("mit-grant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions'),
    ("mit-keep", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit-keep", "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software"),
    ("mit-asis", 'The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement'),
    ("apache-notice", 'The ASF licenses this file to You under the Apache License, Version 2.0 (the "License")'),
    ("apache-title", "Apache License Version 2.0, January 2004"),
    ("apache-title", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("apache-conditions", "Terms and conditions for use, reproduction, and distribution"),
    ("apache-comply", "you may not use this file except in compliance with the License"),
    ("apache-copy", "You may obtain a copy of the License at"),
    ("apache-asis", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied'),
    ("gnu-free", "This program is free software"),
    ("gnu-free", "This library is free software"),
    ("gnu-free", "This file is free software"),
    ("ccbync-notice", "Licensed under CC BY-NC 4.0"),
    ("ccby-notice", "Licensed under CC BY 4.0"),
    ("ccbysa-notice", "Licensed under CC BY-SA 4.0"),
    ("ccby-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("ccbysa-notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("ccbync-notice", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc0-title", "CC0 1.0 Universal"),
    ("cc0-title", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd-names", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-names", "The name of the copyright holder may not be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-names", "The name of the copyright holder may not be used to endorse or promote products derived from this software without prior written permission"),
    ("bsd-advert", "All advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("bsd-advert", "All advertising materials mentioning features or use of this software must display the following acknowledgment"),
    ("isc-title", "ISC License"),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc-grant", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc-asis", 'The software is provided "as is" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness'),
    ("isc-asis", 'The software is provided "as is" and ISC disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness'),
    ("isc-asis", 'The software is provided "as is" and Internet Software Consortium disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness'),
    ("ccby-title", "Creative Commons Attribution 4.0 International Public License"),
    ("ccbysa-title", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("ccbync-title", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("ccby-title", "Attribution 4.0 International"),
    ("ccbysa-title", "Attribution-ShareAlike 4.0 International"),
    ("ccbync-title", "Attribution-NonCommercial 4.0 International"),
    ("mpl-terms", "This Source Code Form is subject to the terms of the Mozilla Public License, v"),  # cut at "v. 2.0"
    ("mpl-copy", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    ("mpl-copy", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"),
    ("mpl-title", "Mozilla Public License Version 2.0"),
    ("unlicense-free", "This is free and unencumbered software released into the public domain"),
    ("unlicense-anyone", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
    ("zlib-asis", "This software is provided 'as-is', without any express or implied warranty"),
    ("zlib-grant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("boost-title", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("boost-notice", "Distributed under the Boost Software License, Version 1.0"),
)

#: GNU licenses, their versions, and the dates on their titles.
_GNU: tuple[tuple[str, str, str, str], ...] = (
    ("gpl", "GNU General Public License", "2", "June 1991"),
    ("gpl", "GNU General Public License", "3", "29 June 2007"),
    ("lgpl", "GNU Lesser General Public License", "2.1", "February 1999"),
    ("lgpl", "GNU Lesser General Public License", "3", "29 June 2007"),
    ("agpl", "GNU Affero General Public License", "3", "19 November 2007"),
)

#: Notices as their slot leaves them: what the pattern caught, normalised.
_NOTICES = (("mit-notice", "mit"), ("mit-notice", "expat"), ("isc-notice", "isc"), ("apache-notice", "apache"), ("mpl-notice", "mozilla"), ("unlicense-notice", "unlicense"), ("bsd2-notice", "bsd 2"), ("bsd3-notice", "bsd 3"), ("bsd4-notice", "bsd 4"))
#: How a GNU family is named in full and in short.
_FAMILIES = {"gpl": ("", ""), "lgpl": ("lesser", "l"), "agpl": ("affero", "a")}

#: SPDX identifiers that a tag may name.
_TAGS = ("MIT", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "ISC", "CC0-1.0", "Unlicense", "Zlib", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0")
#: Identifier as it is written -> as it is reported; old spellings name a version alone or with a plus.
SPDX: dict[str, str] = {t.lower(): t for t in _TAGS} | {t.lower().removesuffix("-only"): t for t in _TAGS if t.endswith("-only")} | {t.lower().removesuffix("-or-later") + "+": t for t in _TAGS if t.endswith("-or-later")}


def _point_zero(version: str) -> str:
    return version if "." in version else f"{version}.0"


def _sentences_of() -> dict[str, str]:
    known = {plain(text): name for name, text in _TEXTS}
    for family, title, version, date in _GNU:
        terms = f"you can redistribute it and/or modify it under the terms of the {title} as published by the Free Software Foundation"
        later = f"either version {version} of the License, or (at your option) any later version"
        v = version.replace(".", "-")
        known |= {plain(terms): f"{family}-terms", plain(later): f"gnu{v}-later", plain(f"{terms} {later}"): f"{family}-terms|gnu{v}-later", plain(f"{title} version {version}, {date}"): f"{family}{v}-title"}
        exact = f"you can redistribute it and/or modify it under the terms of the {title} version {version} as published by the Free Software Foundation"
        known[plain(exact)] = f"{family}{v}-exact"
        for name in _FAMILIES[family]:
            for number in {version, _point_zero(version)}:
                known |= {plain(f"notice gnu {name} {number}"): f"{family}{v}-notice", plain(f"notice later {name} {number}"): f"{family}{v}-later-notice"}
    return known | {f"notice {said}": name for name, said in _NOTICES}


def _spdx_id(tag: str) -> str:
    return f"spdx-{tag.lower().replace('.', '-')}"


#: Normalised sentence -> its identifiers, joined by ``|`` where one says what several do.
SENTENCES: dict[str, str] = _sentences_of()


def _rules() -> tuple[tuple[str, str, tuple[str, ...], tuple[str, ...]], ...]:
    found = [
        ("MIT", "mit-text", ("mit-grant", "mit-keep", "mit-asis"), ("mit-notice", "mit-title")),
        ("MIT", "mit-notice", ("mit-notice",), ()),
        ("MIT", "mit-title", ("mit-title",), ()),
        ("Apache-2.0", "apache-text", ("apache-title", "apache-conditions"), ("apache-notice", "apache-header", "apache-title")),
        ("Apache-2.0", "apache-header", ("apache-notice", "apache-comply", "apache-copy", "apache-asis"), ("apache-notice", "apache-title")),
        ("Apache-2.0", "apache-notice", ("apache-notice",), ()),
        ("Apache-2.0", "apache-title", ("apache-title",), ()),
        ("CC-BY-NC-4.0", "ccbync-notice", ("ccbync-notice",), ()),
        ("CC-BY-SA-4.0", "ccbysa-notice", ("ccbysa-notice",), ()),
        ("CC-BY-4.0", "ccby-notice", ("ccby-notice",), ()),
        ("CC0-1.0", "cc0-title", ("cc0-title",), ()),
        ("CC-BY-NC-4.0", "ccbync-title", ("ccbync-title",), ("ccbync-notice",)),
        ("CC-BY-SA-4.0", "ccbysa-title", ("ccbysa-title",), ("ccbysa-notice",)),
        ("CC-BY-4.0", "ccby-title", ("ccby-title",), ("ccby-notice",)),
        ("BSD-4-Clause", "bsd4-text", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advert"), ("bsd4-notice",)),
        ("BSD-3-Clause", "bsd3-text", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names"), ("bsd3-notice",)),
        ("BSD-2-Clause", "bsd2-text", ("bsd-grant", "bsd-source", "bsd-binary"), ("bsd2-notice",)),
        ("BSD-4-Clause", "bsd4-notice", ("bsd4-notice",), ()),
        ("BSD-3-Clause", "bsd3-notice", ("bsd3-notice",), ()),
        ("BSD-2-Clause", "bsd2-notice", ("bsd2-notice",), ()),
        ("ISC", "isc-text", ("isc-grant", "isc-asis"), ("isc-title", "isc-notice")),
        ("ISC", "isc-title", ("isc-title",), ()),
        ("ISC", "isc-notice", ("isc-notice",), ()),
        ("MPL-2.0", "mpl-header", ("mpl-terms", "mpl-copy"), ("mpl-title", "mpl-notice")),
        ("MPL-2.0", "mpl-notice", ("mpl-notice",), ()),
        ("Unlicense", "unlicense-notice", ("unlicense-notice",), ()),
        ("MPL-2.0", "mpl-title", ("mpl-title",), ()),
        ("Unlicense", "unlicense-text", ("unlicense-free", "unlicense-anyone"), ()),
        ("Zlib", "zlib-text", ("zlib-asis", "zlib-grant"), ()),
        ("BSL-1.0", "boost-title", ("boost-title",), ()),
        ("BSL-1.0", "boost-notice", ("boost-notice",), ()),
    ]
    for family, _, version, _ in _GNU:
        v, name = version.replace(".", "-"), f"{family.upper()}-{_point_zero(version)}"
        base = f"{family}{v}"
        found.append((f"{name}-or-later", f"{base}-header", ("gnu-free", f"{family}-terms", f"gnu{v}-later"), (f"{base}-notice", f"{base}-text")))
        found.append((f"{name}-only", f"{base}-exact", ("gnu-free", f"{base}-exact"), (f"{base}-notice", f"{base}-text")))
        found.append((f"{name}-only", f"{base}-text", (f"{base}-title",), ()))
        found.append((f"{name}-only", f"{base}-notice", (f"{base}-notice",), ()))
        found.append((f"{name}-or-later", f"{base}-later-notice", (f"{base}-later-notice",), (f"{base}-text",)))
    found += [(tag, _spdx_id(tag), (_spdx_id(tag),), ()) for tag in _TAGS]
    return tuple(found)


#: (license, rule, identifiers in order, rules it makes needless).
RULES = _rules()

#: Rule -> identifiers that a text must not have for it to hold.
NEVER: dict[str, tuple[str, ...]] = {"bsd2-text": ("bsd-names", "bsd-advert"), "bsd3-text": ("bsd-advert",)}

#: Patterns that both engines read alike, on lower-cased text: lines of a copyright; sentence ends.
_COPYRIGHT = r"\n[^a-z0-9\n]*(portions )?(copyright ([(]c[)] |© )?|[(]c[)] |© )[0-9][^\n]*|\n[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*"
_CUT = r"([.!?;:])[ \t\r\n]+"
#: The lower-cased text has no capitals, so one marks where a sentence ends.
_END = "S"
_NOISE = rf"[^a-z0-9+\n{_END}]+"
_BLANK = r" *\n *\n[ \n]*"
_STEPS = ((_CUT, _END), (_NOISE, " "), (_BLANK, _END))

#: Slots. A gap is what may stand between two words: white space, punctuation, a comment's frame.
_GAP = r"[^a-z0-9]{1,12}"


def _gaps(pattern: str) -> str:
    return pattern.replace(" ", _GAP)


_OFFERED = r"(?:licensed|released|distributed|available|published|provided|offered)"
#: A notice begins a sentence or a line, with "this project is" or the like before it, and no word but these goes on behind its license.
_START = rf"(?:[.!?;:{_END}][^a-z0-9]{{0,6}}|\n[^a-z0-9\n]*)" + _gaps(r"(?:(?:(?:this|the|all|our|these) (?:[a-z0-9]+ ){1,4}|it )(?:is|are) )?")
_UNDER = _START + _gaps(rf"{_OFFERED} under (?:the )?(?:terms of )?(?:the )?")
_THEN = r"(?:[ \t]*[^a-z0-9 \t]|[ \t]+(?:see|as|which|and|or)\b)"
_VERSION = _gaps(r"(?:,? version| v|v)?(?: )?")
_GNU_NAME = _gaps(r"(?:gnu )?(?:(?:(lesser|affero) )?general public licen[cs]e|([la])?gpl)(?: [la]?gpl\)?)?")
_GNU_VERSION = r"(2\.1|2\.0|3\.0|2|3)"
#: (needed for it to match, pattern, what stands instead). Each text is tried only with those whose needed word it has.
_SLOTS: tuple[tuple[str, str, str], ...] = (
    ("endorse", _gaps(r"(?s)neither the names? of [^!?]{1,120}? nor the names? of (?:its|their|any) contributors"), "neither the name of the copyright holder nor the names of its contributors"),
    ("endorse", _gaps(r"(?s)the names? of [^!?]{1,120}? (?:may|must) not be used to endorse"), "the name of the copyright holder may not be used to endorse"),
    ("under", _gaps(rf"(?:not|never|longer) {_OFFERED} under"), " never so under"),
    ("licen", _UNDER + _gaps(r"(mit|expat|isc) licen[cs]e") + _THEN, "S notice $1 S"),
    ("apache", _UNDER + _gaps(r"apache(?: software)?(?: licen[cs]e)?") + _VERSION + r"2(?:\.0)?" + _THEN, "S notice apache S"),
    ("clause", _UNDER + _gaps(r"(?:bsd )?([234]) clause(?: bsd)? licen[cs]e") + _THEN, "S notice bsd $1 S"),
    ("mozilla", _UNDER + _gaps(r"mozilla public licen[cs]e") + _VERSION + r"2(?:\.0)?" + _THEN, "S notice mozilla S"),
    ("unlicense", _UNDER + r"unlicense" + _THEN, "S notice unlicense S"),
    ("under", _UNDER + _GNU_NAME + _VERSION + _GNU_VERSION + _gaps(r"(?:\+|,? or (?:\(?at your option\)? )?(?:any )?(?:later|newer|greater))"), "S notice later $1$2 $3 S"),
    ("under", _UNDER + _GNU_NAME + _VERSION + _GNU_VERSION + _THEN, "S notice gnu $1$2 $3 S"),
)

#: SPDX: an identifier, and an expression of them behind its tag.
_ID = r"[a-z0-9]+(?:[.+-]+[a-z0-9]+)*\+?"
_EXPRESSION = rf"spdx(?:-license-identifier)?:[ \t]*[(]*[ \t]*({_ID}(?:[ \t)]+(?:and|or|with)[ \t(]+{_ID})*)"
_WITH = rf"[ \t)]+with[ \t(]+{_ID}"


def _low(text: Column) -> Column:
    return F.lower(F.concat(F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("\n")))


def _sentences(low: Column) -> Column:
    """Normalised sentences, in order. The whole text is normalised at once, then cut: few passes, no lambda over words."""
    low = F.regexp_replace(low, _COPYRIGHT, "\n\n")
    slotted = low
    for needed, pattern, by in _SLOTS:
        slotted = F.when(F.contains(low, F.lit(needed)), F.regexp_replace(slotted, pattern, by)).otherwise(slotted)
    # Most texts name no license at all.
    out = F.when(low.rlike(_NAMED), slotted).otherwise(low)
    for pattern, by in _STEPS:
        out = F.regexp_replace(out, pattern, by)
    return F.split(out, _END)


#: What every text has in which a slot can be closed.
_NAMED = "endorse|licen|gpl|apache"


def _lookup(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def _tagged(low: Column) -> Column:
    """Identifiers of SPDX expressions."""
    known = _lookup({k: _spdx_id(v) for k, v in SPDX.items()})
    each = lambda e: F.transform(F.regexp_extract_all(F.regexp_replace(e, _WITH, ""), F.lit(_ID), F.lit(0)), lambda t: F.try_element_at(known, t))
    found = F.flatten(F.transform(F.regexp_extract_all(low, F.lit(_EXPRESSION), F.lit(1)), each))
    return F.when(F.contains(low, F.lit("spdx")), found).otherwise(F.array().cast("array<string>"))


def _identifiers(low: Column) -> Column:
    """The text's known sentences and tags as one string: ``|id|id|``."""
    known = _lookup(SENTENCES)
    look = lambda s: F.try_element_at(known, F.trim(s))
    whole = lambda s: look(F.regexp_replace(s, " *\n *", " "))
    lines = lambda s: F.transform(F.split(s, "\n"), look)
    found = F.flatten(F.transform(_sentences(low), lambda s: F.when(whole(s).isNotNull(), F.array(whole(s))).otherwise(lines(s))))
    return F.concat(F.lit("|"), F.array_join(F.filter(F.concat(_tagged(low), found), lambda x: x.isNotNull()), "|"), F.lit("|"))


def _held(rule: tuple[str, ...]) -> str:
    return r"\|" + r"\|([a-z0-9-]+\|)*".join(rule) + r"\|"


def _conditions(holds) -> dict[str, object]:
    """Rule -> it holds and no rule that makes it needless does, by ``holds`` (identifiers -> a condition that knows &, ~)."""
    last = {}
    for _, name, ids, _ in RULES:
        last[name] = holds(ids)
        for other in NEVER.get(name, ()):
            last[name] = last[name] & ~holds((other,))
        for _, _, over, needless in RULES:
            if name in needless:
                last[name] = last[name] & ~holds(over)
    return last


def scan(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, licenses (sorted, comma-joined, empty if none), rules (likewise), n_sentences (known identifiers), for every row."""
    kinds = {id_column: dict(documents.dtypes)[id_column], text_column: "string"}
    lowered = pick(documents, **kinds).select(F.col(f"`{id_column}`"), _low(F.col(f"`{text_column}`")).alias("low"))
    seen = lowered.select(F.col(f"`{id_column}`"), _identifiers(F.col("low")).alias("ids"))
    last = _conditions(lambda ids: F.col("ids").rlike(_held(ids)))
    none = F.array().cast("array<string>")
    some = F.col("ids") != "||"  # most texts have no known sentence: no rule is tried on them
    licenses = F.when(some, F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(last[name], F.lit(lic)) for lic, name, _, _ in RULES]))))).otherwise(none)
    rules = F.when(some, F.array_sort(F.array_compact(F.array(*[F.when(last[name], F.lit(name)) for _, name, _, _ in RULES])))).otherwise(none)
    count = F.when(some, F.regexp_count("ids", F.lit(r"[a-z0-9-]+"))).otherwise(0).cast("long")
    return seen.select(F.col(f"`{id_column}`"), F.array_join(licenses, ",").alias("licenses"), F.array_join(rules, ",").alias("rules"), count.alias("n_sentences"))


class _Sql(str):
    def __and__(self, other: str) -> _Sql:
        return _Sql(f"{self} AND {other}")

    def __invert__(self) -> _Sql:
        return _Sql(f"NOT {self}")


def oracle() -> str:
    """The same rows in DuckDB's SQL."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    sql = lambda s: text(s).replace("\n", "' || chr(10) || '")
    known = ", ".join(f"({text(k)}, {text(v)})" for k, v in SENTENCES.items())
    last = _conditions(lambda ids: _Sql(f"regexp_matches(ids, {text(_held(ids))})"))
    listed = lambda what: "list_filter([" + ", ".join(f"CASE WHEN {last[r[1]]} THEN {text(r[what])} END" for r in RULES) + "], lambda x: x IS NOT NULL)"
    low = "lower(chr(10) || coalesce(text, '') || chr(10))"
    steps = low
    for pattern, by in [(_COPYRIGHT, "\n\n"), *[x[1:] for x in _SLOTS], *_STEPS]:
        steps = f"regexp_replace({steps}, {text(pattern)}, {sql(re.sub(r'[$]([0-9])', lambda m: chr(92) + m[1], by))}, 'g')"
    tags = ", ".join(f"({text(k)}, {text(_spdx_id(v))})" for k, v in SPDX.items())
    return f"""
WITH known(sentence, id) AS (VALUES {known}),
tags(tag, id) AS (VALUES {tags}),
cut AS (SELECT row_number() OVER () AS n, doc_id, string_split({steps}, '{_END}') AS parts, regexp_extract_all({low}, {text(_EXPRESSION)}, 1) AS expressions FROM documents),
expression AS (SELECT n, unnest(expressions) AS e, generate_subscripts(expressions, 1) AS e_no FROM cut),
token AS (SELECT n, e_no, unnest(regexp_extract_all(regexp_replace(e, {text(_WITH)}, '', 'g'), {text(_ID)})) AS tag, generate_subscripts(regexp_extract_all(regexp_replace(e, {text(_WITH)}, '', 'g'), {text(_ID)}), 1) AS t_no FROM expression),
each AS (SELECT n, unnest(parts) AS part, generate_subscripts(parts, 1) AS place FROM cut),
whole AS (SELECT n, place, part, k.id FROM each LEFT JOIN known k ON trim(regexp_replace(part, ' *\\n *', ' ', 'g'), ' ') = k.sentence),
lines AS (SELECT n, place, unnest(string_split(part, chr(10))) AS line, generate_subscripts(string_split(part, chr(10)), 1) AS line_no FROM whole WHERE id IS NULL),
found AS (
  SELECT n, -1 AS place, e_no * 1000000 + t_no AS line_no, id FROM token JOIN tags USING (tag)
  UNION ALL SELECT n, place, 0, id FROM whole WHERE id IS NOT NULL
  UNION ALL SELECT n, place, line_no, k.id FROM lines JOIN known k ON trim(line, ' ') = k.sentence),
ids AS (SELECT n, '|' || string_agg(id, '|' ORDER BY place, line_no) || '|' AS ids FROM found GROUP BY n),
full_ids AS (SELECT doc_id, coalesce(ids, '||') AS ids FROM cut LEFT JOIN ids USING (n))
SELECT doc_id, array_to_string(list_sort(list_distinct({listed(0)})), ',') AS licenses,
  array_to_string(list_sort({listed(1)}), ',') AS rules, CAST(CASE WHEN ids = '||' THEN 0 ELSE length(ids) - length(replace(ids, '|', '')) - 1 END AS BIGINT) AS n_sentences
FROM full_ids
"""
