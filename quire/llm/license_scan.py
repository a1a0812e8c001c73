"""License scans: sentences are recognised one by one, then ordered rules match the sequence of what was recognised."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Identifier and published wording of the sentences and clauses that state a licence.
WORDINGS = [
    ("apache2-grant", "Licensed under the Apache License, Version 2.0 (the 'License')"),
    ("apache2-short", "Licensed under the Apache License, Version 2.0"),
    ("apache2-comply", "you may not use this file except in compliance with the License"),
    ("apache2-copy", "You may obtain a copy of the License at"),
    ("apache2-copy", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache2-copy", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"),
    ("apache2-warranty", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an 'AS IS' BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("apache2-see", "See the License for the specific language governing permissions and limitations under the License"),
    ("mit-short", "Released under the MIT License"),
    ("mit-short", "Licensed under the MIT License"),
    ("mit-short", "This project is licensed under the MIT License"),
    ("mit-named", "The MIT License (MIT)"),
    ("mit-named", "The MIT License"),
    ("mit-named", "MIT License"),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the 'Software'), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("mit-notice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit-as-is", "THE SOFTWARE IS PROVIDED 'AS IS', WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"),
    ("mit-liability", "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc-as-is", "THE SOFTWARE IS PROVIDED 'AS IS' AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS"),
    ("bsd-redist", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd-names", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-as-is", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS 'AS IS' AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED"),
    ("zlib-as-is", "This software is provided 'as-is', without any express or implied warranty"),
    ("zlib-grant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("boost-grant", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the 'Software') to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following"),
    ("unlicense-free", "This is free and unencumbered software released into the public domain"),
    ("mpl2-terms", "This Source Code Form is subject to the terms of the Mozilla Public License, v"),
    ("mpl2-copy", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"),
    ("mpl2-copy", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    ("gpl3-short", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-program", "This program is free software"),
    ("gpl-library", "This library is free software"),
    ("gpl-terms", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl-terms", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl-terms", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("later-2", "either version 2 of the License, or (at your option) any later version"),
    ("later-2.1", "either version 2.1 of the License, or (at your option) any later version"),
    ("later-3", "either version 3 of the License, or (at your option) any later version"),
    ("gpl3-later", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("lgpl3-later", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("agpl3-later", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl-hope", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"),
    ("gpl-implied", "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    ("gpl-see", "See the GNU General Public License for more details"),
    ("gpl-received", "You should have received a copy of the GNU General Public License along with this program"),
    ("ccby-short", "Licensed under CC BY 4.0"),
    ("ccbync-short", "Licensed under CC BY-NC 4.0"),
    ("ccbysa-short", "Licensed under CC BY-SA 4.0"),
    ("ccby-text", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("ccbysa-text", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("ccbync-text", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("ccbynd-text", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("ccbyncsa-text", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("ccbyncnd-text", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    ("cc0-short", "Released into the public domain under CC0 1.0"),
    ("public-domain", "Public domain in the USA"),
    ("reserved", "All rights reserved"),
    ("no-copying", "No part of this work may be reproduced without permission"),
]
#: Fixed values, tried in this order: rule, licence it states, whether it restricts use in training, its sentences in order.
RULES = [
    ("apache2-notice", "Apache-2.0", False, ["apache2-grant", "apache2-comply", "apache2-copy", "apache2-warranty", "apache2-see"]),
    ("apache2-header", "Apache-2.0", False, ["apache2-grant", "apache2-comply"]),
    ("apache2-header-short", "Apache-2.0", False, ["apache2-short", "apache2-comply"]),
    ("apache2-line", "Apache-2.0", False, ["apache2-grant"]),
    ("apache2-line-short", "Apache-2.0", False, ["apache2-short"]),
    ("mit-text", "MIT", False, ["mit-grant", "mit-notice", "mit-as-is"]),
    ("mit-line", "MIT", False, ["mit-short"]),
    ("bsd3-text", "BSD-3-Clause", False, ["bsd-redist", "bsd-source", "bsd-binary", "bsd-names"]),
    ("bsd2-text", "BSD-2-Clause", False, ["bsd-redist", "bsd-source", "bsd-binary"]),
    ("isc-text", "ISC", False, ["isc-grant", "isc-as-is"]),
    ("zlib-text", "Zlib", False, ["zlib-as-is", "zlib-grant"]),
    ("boost-text", "BSL-1.0", False, ["boost-grant"]),
    ("unlicense-text", "Unlicense", False, ["unlicense-free"]),
    ("mpl2-header", "MPL-2.0", True, ["mpl2-terms", "mpl2-copy"]),
    ("gpl3-notice", "GPL-3.0-or-later", True, ["gpl-program", "gpl3-later"]),
    ("gpl3-notice-split", "GPL-3.0-or-later", True, ["gpl-program", "gpl-terms", "later-3"]),
    ("gpl2-notice", "GPL-2.0-or-later", True, ["gpl-program", "gpl-terms", "later-2"]),
    ("lgpl3-notice", "LGPL-3.0-or-later", True, ["gpl-library", "lgpl3-later"]),
    ("lgpl21-notice", "LGPL-2.1-or-later", True, ["gpl-library", "lgpl-terms", "later-2.1"]),
    ("agpl3-notice", "AGPL-3.0-or-later", True, ["gpl-program", "agpl3-later"]),
    ("agpl3-notice-split", "AGPL-3.0-or-later", True, ["gpl-program", "agpl-terms", "later-3"]),
    ("gpl3-line", "GPL-3.0", True, ["gpl3-short"]),
    ("ccby-line", "CC-BY-4.0", False, ["ccby-short"]),
    ("ccbync-line", "CC-BY-NC-4.0", True, ["ccbync-short"]),
    ("ccbysa-line", "CC-BY-SA-4.0", True, ["ccbysa-short"]),
    ("ccby-text", "CC-BY-4.0", False, ["ccby-text"]),
    ("ccbysa-text", "CC-BY-SA-4.0", True, ["ccbysa-text"]),
    ("ccbync-text", "CC-BY-NC-4.0", True, ["ccbync-text"]),
    ("ccbynd-text", "CC-BY-ND-4.0", True, ["ccbynd-text"]),
    ("ccbyncsa-text", "CC-BY-NC-SA-4.0", True, ["ccbyncsa-text"]),
    ("ccbyncnd-text", "CC-BY-NC-ND-4.0", True, ["ccbyncnd-text"]),
    ("cc0-line", "CC0-1.0", False, ["cc0-short"]),
    ("public-domain", "Public-Domain", False, ["public-domain"]),
    ("reserved-strict", "Proprietary", True, ["reserved", "no-copying"]),
    ("reserved", "Proprietary", True, ["reserved"]),
    ("mit-named", "MIT", False, ["mit-named"]),
]
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CUT, LINE = "\x01", "\x02"  # stand for the end of a sentence and of a line in a normalised text
#: Lines without a letter or digit end a sentence, and so do these marks before white space.
END = r"""\n[^a-z0-9]*\n|[.!?:;]+["')\]]*[ \t\n]+"""
NOT_WORD = f"[^a-z0-9{CUT}{LINE}]+"


def normalised(wording: str) -> str:
    """A sentence as the scan sees it: a-z and 0-9, any run of other characters as one blank."""
    return re.sub("[^a-z0-9]+", " ", wording.lower()).strip()


def by_words(wordings: list[tuple[str, str]]) -> dict[str, str]:
    return {normalised(text): name for name, text in wordings}


def _folded(text: Column) -> Column:
    """The text in a-z, 0-9, single blanks, and the two marks; only ASCII letters are lowered."""
    one = F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n"))
    low = F.translate(one, UPPER + "\r" + CUT + LINE, UPPER.lower() + "\n  ")
    cut = F.translate(F.regexp_replace(low, END, CUT), "\n", LINE)
    return F.regexp_replace(cut, NOT_WORD, " ")


def scan(
    docs: DataFrame,
    text_col: str = "text",
    wordings: list[tuple[str, str]] | None = None,
    rules: list[tuple[str, str, bool, list[str]]] | None = None,
    out: str = "license",
) -> DataFrame:
    """``docs`` with a struct ``out``: ``sentences``, ``rules``, ``licenses`` and ``restricted``.

    A sentence ends at ``.!?:;`` before white space and at lines without a
    letter or digit; single line ends within it count as blanks, so wrapped
    and unwrapped notices read alike, also behind comment signs. Each sentence
    is lowered, its runs of anything but a-z and 0-9 become one blank, and it
    is looked up among ``wordings``; where it is not found, each of its lines
    is. The identifiers, in order of the text and with repeats, are the first
    field.

    The rules are tried in their order. A rule matches where its identifiers
    stand next to one another in that sequence, so sentences that are not
    recognised do not separate them, and what it matched is gone for later
    rules: a short rule does not fire within a longer one before it. ``rules``
    are in the order they matched, ``licenses`` sorted and distinct;
    ``restricted`` tells whether any matched rule restricts use.

    All of it is one projection of built-in functions over the whole text: no
    shuffle, no Python. Null and empty texts have empty arrays and false. Rows
    are judged alone, so repeats and further columns pass through; a column
    that is named as ``out`` is replaced.
    """
    known_words = by_words(WORDINGS if wordings is None else wordings)
    rules = RULES if rules is None else rules
    none = F.array().cast("array<string>")
    if known_words:
        known = F.create_map(*[F.lit(x) for pair in known_words.items() for x in pair])
        find = lambda s: F.try_element_at(known, F.trim(s))

        def of_sentence(s: Column) -> Column:
            lines = F.split(s, LINE)
            whole = find(F.array_join(F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != ""), " "))
            parts = F.filter(F.transform(lines, find), lambda x: x.isNotNull())
            return F.when(whole.isNotNull(), F.array(whole)).otherwise(parts)

        ids = F.flatten(F.transform(F.split(_folded(F.col(text_col)), CUT), of_sentence))
    else:
        ids = none
    start = F.struct(
        # identifiers have no commas and keep both of theirs, so a rule's run is a part of the joined sequence
        F.concat(F.lit(","), F.array_join(out, ",,"), F.lit(",")).alias("line"),
        none.alias("rules"),
        none.alias("licenses"),
        F.lit(False).alias("restricted"),
    )

    def step(had: Column, r: Column) -> Column:
        hit = F.contains(had["line"], r["wanted"])
        return F.struct(
            F.replace(had["line"], r["wanted"], F.lit(",|,")).alias("line"),
            F.when(hit, F.array_append(had["rules"], r["rule"])).otherwise(had["rules"]).alias("rules"),
            F.when(hit, F.array_append(had["licenses"], r["license"])).otherwise(had["licenses"]).alias("licenses"),
            (had["restricted"] | (hit & r["restricted"])).alias("restricted"),
        )

    table = F.array(
        *[
            F.struct(
                F.lit(name).alias("rule"),
                F.lit(licence).alias("license"),
                F.lit(restricted).alias("restricted"),
                F.lit(f",{',,'.join(wanted)},").alias("wanted"),
            )
            for name, licence, restricted, wanted in rules
        ]
    )
    met = F.when(F.size(out) > 0, F.aggregate(table, start, step)) if rules else F.lit(None).cast("struct<rules: array<string>, licenses: array<string>, restricted: boolean>")
    # the result's own column holds the steps, so no name of the table is touched
    marked = docs.withColumn(out, ids).withColumn(out, F.struct(F.col(out).alias("sentences"), met.alias("met")))
    return marked.withColumn(
        out,
        F.struct(
            F.col(f"{out}.sentences").alias("sentences"),
            F.coalesce(f"{out}.met.rules", none).alias("rules"),
            F.array_sort(F.array_distinct(F.coalesce(f"{out}.met.licenses", none))).alias("licenses"),
            F.coalesce(f"{out}.met.restricted", F.lit(False)).alias("restricted"),
        ),
    )


def oracle_sql() -> str:
    """DuckDB SQL for the query over ``documents``."""
    known = ", ".join(f"('{words}', '{name}')" for words, name in by_words(WORDINGS).items())
    end = END.replace("'", "''")
    folded = (
        f"regexp_replace(translate(regexp_replace(translate(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), "
        f"'{UPPER}' || chr(13) || chr(1) || chr(2), '{UPPER.lower()}' || chr(10) || '  '), '{end}', chr(1), 'g'), chr(10), chr(2)), "
        f"'[^a-z0-9\\x01\\x02]+', ' ', 'g')"
    )
    steps, hits, names, licences, limits = [], [], [], [], []
    for i, (name, licence, restricted, wanted) in enumerate(RULES):
        run = f",{',,'.join(wanted)},"
        steps.append(f"replace(l{i}, '{run}', ',|,') as l{i + 1}")
        hits.append(f"contains(l{i}, '{run}') as h{i}")
        names.append(f"case when h{i} then '{name}' end")
        licences.append(f"case when h{i} then '{licence}' end")
        limits.append(f"h{i}" if restricted else "false")
    picked = lambda xs: f"array_to_string(list_filter([{', '.join(xs)}], lambda x: x is not null), ',')"
    distinct = f"array_to_string(list_sort(list_distinct(list_filter([{', '.join(licences)}], lambda x: x is not null))), ',')"
    return f"""
with known(words, id) as (values {known}),
parts as (
  select doc_id, unnest(p) as part, unnest(range(len(p))) as pos from (select doc_id, string_split({folded}, chr(1)) as p from documents)),
whole as (
  select doc_id, pos, part, id from parts
  left join known on words = array_to_string(list_filter(list_transform(string_split(part, chr(2)), lambda x: trim(x)), lambda x: x <> ''), ' ')),
lines as (
  select doc_id, pos, unnest(l) as line, unnest(range(len(l))) as nth
  from (select doc_id, pos, string_split(part, chr(2)) as l from whole where id is null)),
ids as (
  select doc_id, pos, 0 as nth, id from whole where id is not null
  union all select doc_id, pos, nth, k.id from lines join known k on trim(line) = words),
seq as (
  select doc_id, string_agg(id, ',' order by pos, nth) as sentences, ',' || string_agg(id, ',,' order by pos, nth) || ',' as l0
  from ids group by doc_id),
met as (select doc_id, sentences, l0, {', '.join(x for pair in zip(hits, steps) for x in pair)} from seq)
select d.doc_id, coalesce(sentences, '') as sentences, coalesce({picked(names)}, '') as rules,
  coalesce({distinct}, '') as licenses, coalesce({' or '.join(limits)}, false) as restricted
from documents d left join met using (doc_id)"""
