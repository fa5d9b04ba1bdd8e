"""License scans by sentence rules: known licence sentences get identifiers, rules are ordered runs of identifiers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.runtime import require

#: Sentences of licences, by identifier. They are normalised before use; more than one may share an identifier.
SENTENCES = [
    ("MITlead", "Released under the MIT License."),
    ("MITlead", "Licensed under the MIT License."),
    ("MITlead", "This software is released under the MIT License."),
    ("MITtitle", "The MIT License (MIT)"),
    ("MITtitle", "MIT License"),
    ("MITgrant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MITnotice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MITasis", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
    ("MITliab", "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISCgrant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSDgrant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSDsource", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSDbinary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSDendorse", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("Apache2lead", "Licensed under the Apache License, Version 2.0."),
    ("Apache2header", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("ApacheNotUse", "you may not use this file except in compliance with the License."),
    ("ApacheCopy", "You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\n"),
    ("ApacheAsis", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("GPL3lead", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL2lead", "This work is licensed under the GNU General Public License, version 2."),
    ("MPL2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CCBYNC4", "Licensed under CC BY-NC 4.0."),
    ("CCBY4", "Licensed under CC BY 4.0."),
    ("CCBYSA4", "Licensed under CC BY-SA 4.0."),
    ("CC0", "Released into the public domain under CC0 1.0."),
    ("AllRights", "All rights reserved."),
    ("BSDasis", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'),
    ("BSDliab", "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("ISCasis", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'),
    ("EPL2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("EPL2lead", "Licensed under the Eclipse Public License 2.0."),
    ("EPL1", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("UNfree", "This is free and unencumbered software released into the public domain."),
    ("UNanyone", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("ZLIBasis", "This software is provided 'as-is', without any express or implied warranty."),
    ("ZLIBliab", "In no event will the authors be held liable for any damages arising from the use of this software."),
    ("ZLIBgrant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
]

#: Variable parts of known sentences, as patterns over normalised text that both engines read alike, and what stands for them.
SLOTS = [
    ("neither the name", "^neither the names? of .+ nor the names of (its|their|any) contributors", "neither the name of the copyright holder nor the names of its contributors"),
    ("this software is provided by", "^this software is provided by .+ as is and any express", "this software is provided by the copyright holders and contributors as is and any express"),
    ("in no event shall", "^in no event shall .+ be liable for any direct", "in no event shall the copyright holder or contributors be liable for any direct"),
    ("in no event shall", "^in no event shall .+ be liable for any claim", "in no event shall the authors or copyright holders be liable for any claim"),
    ("redistributions of source code", "^redistributions of source code must retain the .*copyright notice this list of conditions and the following disclaimer$", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("redistributions in binary form", "^redistributions in binary form must reproduce the .*copyright notice", "redistributions in binary form must reproduce the above copyright notice"),
]

_FSF = "Free Software Foundation"
#: The GNU licences: key, name in the header, name of the rule, versions.
_GNU = [("GPL", "GNU General Public License", "GPL", "23"), ("LGPL", "GNU Lesser General Public License", "LGPL", "2.1 3"), ("AGPL", "GNU Affero General Public License", "AGPL", "3"), ("OLGPL", "GNU Library General Public License", "LGPL", "2")]


def _versions(text: str) -> list[str]:
    return text.split() if " " in text else list(text)


def _gnu() -> list[tuple[str, str]]:
    """The headers of all versions, for programs and libraries, ended by ; or : as they are found."""
    out = []
    for thing in ("program", "library"):
        out += [("GPLfree", f"This {thing} is free software"), ("GPLhope", f"This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY")]
    out.append(("GPLeven", "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."))
    later: dict[str, str] = {}
    for key, name, _, versions in _GNU:
        terms = f"you can redistribute it and/or modify it under the terms of the {name} as published by the {_FSF}"
        out += [(f"{key}terms", terms), (f"{key}see", f"See the {name} for more details.")]
        for version in _versions(versions):
            later[version] = f"either version {version} of the License, or (at your option) any later version."
            # some have a comma where others have a semicolon
            out.append((f"{key}{version}terms", f"{terms}, {later[version]}"))
    return out + [(f"GPL{version}later", text) for version, text in later.items()]


def _gnu_rules() -> list[tuple[str, list[str]]]:
    """Whole headers first, then their beginnings."""
    whole, short = [], []
    for key, _, name, versions in _GNU:
        for version in _versions(versions):
            label = f"{name}-{version if '.' in version else version + '.0'}-or-later"
            heads = [["GPLfree", f"{key}{version}terms"], ["GPLfree", f"{key}terms", f"GPL{version}later"]]
            whole += [(label, [*h, "GPLhope", "GPLeven", f"{key}see"]) for h in heads]
            short += [(label, h) for h in heads]
    return whole + short


SENTENCES += _gnu()


def _after_rights(rules):
    """Each rule also with the "All rights reserved" of the copyright line before it, which is no statement of its own then."""
    return [(name, x) for name, run in rules for x in (["AllRights", *run], run)]


#: Licences and the runs of identifiers that make them, longest first; each recognised run is used up.
RULES = [
    *_after_rights([
        ("MIT", ["MITtitle", "MITgrant", "MITnotice", "MITasis", "MITliab"]),
        ("MIT", ["MITgrant", "MITnotice", "MITasis", "MITliab"]),
        ("Apache-2.0", ["Apache2header", "ApacheNotUse", "ApacheCopy", "ApacheAsis"]),
        ("BSD-3-Clause", ["BSDgrant", "BSDsource", "BSDbinary", "BSDendorse", "BSDasis", "BSDliab"]),
        ("BSD-2-Clause", ["BSDgrant", "BSDsource", "BSDbinary", "BSDasis", "BSDliab"]),
        ("BSD-3-Clause", ["BSDgrant", "BSDsource", "BSDbinary", "BSDendorse"]),
        ("BSD-2-Clause", ["BSDgrant", "BSDsource", "BSDbinary"]),
        ("ISC", ["ISCgrant", "ISCasis"]),
    ]),
    *_gnu_rules(),
    ("EPL-2.0", ["EPL2"]),
    ("EPL-1.0", ["EPL1"]),
    ("Unlicense", ["UNfree", "UNanyone"]),
    ("Unlicense", ["UNfree"]),
    ("Zlib", ["ZLIBasis", "ZLIBliab", "ZLIBgrant"]),
    ("ISC", ["ISCgrant"]),
    ("MPL-2.0", ["MPL2"]),
    ("MIT", ["MITlead"]),
    ("MIT", ["MITtitle"]),
    ("Apache-2.0", ["Apache2lead"]),
    ("EPL-2.0", ["EPL2lead"]),
    ("GPL-3.0-only", ["GPL3lead"]),
    ("GPL-2.0-only", ["GPL2lead"]),
    ("CC-BY-NC-4.0", ["CCBYNC4"]),
    ("CC-BY-4.0", ["CCBY4"]),
    ("CC-BY-SA-4.0", ["CCBYSA4"]),
    ("CC0-1.0", ["CC0"]),
    ("All-Rights-Reserved", ["AllRights"]),
]

#: A sentence ends at these marks before white space, and at the ends of paragraphs.
_END = "[.:;!?]+[ \\t\\n\\r]|\\n[ \\t\\r]*\\n"
_OTHER = "[^a-z0-9\\x01]+"


#: Spellings of addresses that are brought to one, in normalised text.
_SPELLINGS = [(" https www ", " http www "), (" https ", " http "), (" http www ", " http ")]


def normalise(sentence: str) -> str:
    out = re.sub(_OTHER, " ", re.sub(_END, "\x01", sentence.lower() + " "))
    for a, by in _SPELLINGS:
        out = out.replace(a, by)
    return out.strip(" \x01").replace(" \x01 ", "\x01")


def _known(sentences) -> dict[str, str]:
    """Normalised pieces of the known sentences; one that the marks cut in parts has a part for each."""
    out: dict[str, str] = {}
    for key, s in sentences:
        parts = [p.strip() for p in normalise(s).split("\x01") if p.strip()]
        for k, p in enumerate(parts):
            out.setdefault(p, key if len(parts) == 1 else f"{key}.{k}")
    return out


def _rules(sentences, rules) -> list[tuple[str, str]]:
    parts: dict[str, list[str]] = {}
    for key, s in sentences:
        n = len([p for p in normalise(s).split("\x01") if p.strip()])
        parts.setdefault(key, [key] if n == 1 else [f"{key}.{k}" for k in range(n)])
    return [(name, "<" + "><".join(x for key in run for x in parts[key]) + ">") for name, run in rules]


def _parts(compiled) -> dict[str, list[str]]:
    """For each licence of rules of several identifiers, these."""
    out: dict[str, list[str]] = {}
    for name, run in compiled:
        ids = re.findall("<[^>]*>", run)
        if len(ids) > 1:
            out[name] = list(dict.fromkeys([*out.get(name, []), *(i for i in ids if i != "<AllRights>")]))
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences=SENTENCES, rules=RULES, slots=SLOTS) -> DataFrame:
    """(doc_id, sentence_ids, licenses, partly, unmatched) of every document that holds a known licence sentence.

    Each text is cut in sentences, normalised to lower-case letters and digits, with the variable parts of ``slots``
    (names of holders) brought to one form; known ones become identifiers, in order, as ``<A><B>``; all others drop
    out. Rules are tried in order, longer ones first, and each run found is used up; ``licenses`` lists those found in
    the rules' order, ``unmatched`` the identifiers that no rule used, ``partly`` the licences not found of whose
    rules some are among these. All of it is one projection without user functions or shuffle. The rule set is small
    and of fixed size.

    Null and empty texts have no licence and no row; very long texts are scanned whole. Repeated rows are answered
    alike, null ids carried. Two licences of one kind count once; where rules tie for the same sentences, the first
    has them. Other columns are not read, whatever their names; an empty table gives an empty result.
    """
    require(docs, id_col, text_col)
    known = _known(sentences)
    compiled = _rules(sentences, rules)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    cut = F.regexp_replace(F.regexp_replace(F.concat(F.lower("text"), F.lit(" ")), _END, "\x01"), _OTHER, " ")
    for a, by in _SPELLINGS:
        cut = F.replace(cut, F.lit(a), F.lit(by))

    def one_form(x):
        x = F.trim(x)
        for start, pattern, by in slots:
            x = F.when(x.startswith(start), F.regexp_replace(x, pattern, by)).otherwise(x)
        return x

    pieces = F.transform(F.split(cut, "\x01"), one_form)
    hits = F.filter(pieces, lambda x: x.isin(list(known)))
    names = F.create_map(*[F.lit(v) for pair in known.items() for v in pair])
    found_ids = F.transform(hits, lambda x: F.concat(F.lit("<"), F.try_element_at(names, x), F.lit(">")))
    # A generator, so that the filter isn't pushed below and the sentences cut twice.
    ids = texts.select("doc_id", F.explode(F.filter(F.array(found_ids), lambda v: F.size(v) > 0)).alias("a"))
    state = ids.select("doc_id", F.array_join("a", "").alias("sentence_ids")).withColumn("rest0", F.col("sentence_ids"))
    found = []
    for k, (name, run) in enumerate(compiled):
        found.append(F.when(F.contains(f"rest{k}", F.lit(run)), F.lit(name)))
        state = state.withColumn(f"rest{k + 1}", F.replace(f"rest{k}", F.lit(run), F.lit("|")))
    left = F.replace(f"rest{len(compiled)}", F.lit("|"), F.lit(""))
    state = state.withColumn("licenses", F.array_distinct(F.array_compact(F.array(*found)))).withColumn("unmatched", left)
    partly = [F.when(F.greatest(F.lit(False), *[F.contains("unmatched", F.lit(i)) for i in ids]) & ~F.array_contains("licenses", name), F.lit(name)) for name, ids in _parts(compiled).items()]
    partly = F.concat_ws(",", *partly) if partly else F.lit("")
    return state.select("doc_id", "sentence_ids", F.array_join("licenses", ",").alias("licenses"), partly.alias("partly"), "unmatched")


def oracle(table: str = "documents", sentences=SENTENCES, rules=RULES, slots=SLOTS) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = _known(sentences)
    compiled = _rules(sentences, rules)
    soh = "chr(1)"
    names = "map {" + ", ".join(f"{quote(k)}: {quote(v)}" for k, v in known.items()) + "}"
    steps = ""
    last = "ids"
    for k, (_, run) in enumerate(compiled):
        steps += f", r{k} as (select *, replace(rest{k}, {quote(run)}, '|') as rest{k + 1} from {last})"
        last = f"r{k}"
    found = ", ".join(f"case when contains(rest{k}, {quote(run)}) then {quote(name)} end" for k, (name, run) in enumerate(compiled))
    text = f"regexp_replace(regexp_replace(lower(text) || ' ', '{_END}', {soh}, 'g'), '{_OTHER}', ' ', 'g')"
    for a, by in _SPELLINGS:
        text = f"replace({text}, {quote(a)}, {quote(by)})"
    form = "trim(x)"
    for start, pattern, by in slots:
        form = f"regexp_replace({form}, {quote(pattern)}, {quote(by)})"
    left = f"replace(rest{len(compiled)}, '|', '')"
    partly = ", ".join(f"case when ({' or '.join(f'contains({left}, {quote(i)})' for i in ids)}) and not list_contains(f, {quote(name)}) then {quote(name)} end" for name, ids in _parts(compiled).items())
    # first of each name only, in the rules' order
    return f"""
with s as (select doc_id, [{form} for x in string_split({text}, {soh})] as p from documents where text is not null),
h as (select doc_id, [map_extract({names}, x)[1] for x in p if map_contains({names}, x)] as a from s),
ids as (select doc_id, '<' || array_to_string(a, '><') || '>' as sentence_ids, '<' || array_to_string(a, '><') || '>' as rest0 from h where len(a) > 0){steps},
l as (select *, [{found}] as f from {last})
select doc_id, sentence_ids, array_to_string([f[i] for i in range(1, len(f) + 1) if f[i] is not null and list_position(f, f[i]) = i], ',') as licenses, concat_ws(',', {partly}) as partly, {left} as unmatched from l
""".replace("from documents", f"from {table}")  # fmt: skip
