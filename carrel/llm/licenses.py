"""License scans by sentence-rule recognition, in DataFrame functions only.

A text is normalised, with a mark at each line end and each sentence end. A known licence sentence is found where it starts and ends
at marks; marks inside it, of wrapped lines or of its own colons, are passed over; where several start, the longest counts. The
identifiers found, in the order of the text, are matched against rules, ordered sequences of identifiers;
a longer rule comes before a shorter one, and what a rule has matched is not matched again. Identifiers that no rule uses are
reported as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Identifier and known sentences, normalised: lower case, only letters and digits, one blank between words.
SENTENCES = {
    "Apache2": (
        "licensed under the apache license version 2 0",
        "licensed under the apache license version 2 0 the license",
        "this work is licensed under the apache license version 2 0",
        "released under the apache license version 2 0",
        "spdx license identifier apache 2 0",
    ),
    "ApacheComply": ("you may not use this file except in compliance with the license",),
    "ApacheObtain": ("you may obtain a copy of the license at http www apache org licenses license 2 0", "you may obtain a copy of the license at"),
    "ApacheAsIs": ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",),
    "ApacheSee": ("see the license for the specific language governing permissions and limitations under the license",),
    "Mit": (
        "released under the mit license",
        "licensed under the mit license",
        "this work is licensed under the mit license",
        "this project is licensed under the terms of the mit license",
        "spdx license identifier mit",
    ),
    "MitGrant": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",),
    "MitNotice": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "MitAsIs": ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",),
    "MitLiability": ("in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",),
    "BsdGrant": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "BsdSource": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    "BsdBinary": ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    "BsdEndorse": ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    "Bsd2": ("licensed under the bsd 2 clause license", "released under the bsd 2 clause license", "spdx license identifier bsd 2 clause"),
    "Bsd3": ("licensed under the bsd 3 clause license", "released under the bsd 3 clause license", "spdx license identifier bsd 3 clause"),
    "Gpl2": ("this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2", "spdx license identifier gpl 2 0 only"),
    "Gpl3": ("this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "released under the gnu general public license version 3", "spdx license identifier gpl 3 0 only"),
    "Gpl2Later": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "spdx license identifier gpl 2 0 or later"),
    "Gpl3Later": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "spdx license identifier gpl 3 0 or later"),
    "Lgpl3": ("this work is licensed under the gnu lesser general public license version 3", "licensed under the gnu lesser general public license version 3"),
    "Agpl3": ("this work is licensed under the gnu affero general public license version 3", "licensed under the gnu affero general public license version 3"),
    "GnuNoWarranty": ("this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",),
    "GnuSee": ("see the gnu general public license for more details",),
    "GnuCopy": ("you should have received a copy of the gnu general public license along with this program",),
    "LaterVersion": ("or at your option any later version of the license", "either this version of the license or at your option any later version"),
    "Mpl2": ("this source code form is subject to the terms of the mozilla public license v 2 0", "licensed under the mozilla public license version 2 0", "licensed under the mozilla public license 2 0"),
    "CcBy4": ("licensed under cc by 4 0", "this work is licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"),
    "CcBySa4": ("licensed under cc by sa 4 0", "this work is licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    "CcByNc4": ("licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    "CcByNd4": ("licensed under cc by nd 4 0", "this work is licensed under cc by nd 4 0"),
    "Cc0": ("licensed under cc0 1 0", "this work is dedicated to the public domain under a cc0 license", "to the extent possible under law the author has waived all copyright and related rights to this work a cc0 license"),
    "Unlicense": ("this is free and unencumbered software released into the public domain without a license",),
    "AllRights": ("all rights reserved under copyright", "copyright all rights reserved"),
}
#: Licence and the sequence of identifiers that states it. They are tried longest first, then in this order.
RULES = (
    ("Apache-2.0", ("Apache2", "ApacheComply", "ApacheObtain", "ApacheAsIs", "ApacheSee")),
    ("Apache-2.0", ("ApacheComply", "ApacheObtain", "ApacheAsIs", "ApacheSee")),
    ("MIT", ("MitGrant", "MitNotice", "MitAsIs", "MitLiability")),
    ("BSD-3-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse")),
    ("GPL-2.0-or-later", ("Gpl2Later", "GnuNoWarranty", "GnuSee", "GnuCopy")),
    ("GPL-3.0-or-later", ("Gpl3Later", "GnuNoWarranty", "GnuSee", "GnuCopy")),
    ("BSD-2-Clause", ("BsdGrant", "BsdSource", "BsdBinary")),
    ("MIT", ("MitGrant", "MitNotice")),
    ("GPL-2.0-or-later", ("Gpl2", "LaterVersion")),
    ("GPL-3.0-or-later", ("Gpl3", "LaterVersion")),
    ("Apache-2.0", ("Apache2",)),
    ("MIT", ("Mit",)),
    ("BSD-2-Clause", ("Bsd2",)),
    ("BSD-3-Clause", ("Bsd3",)),
    ("GPL-2.0-only", ("Gpl2",)),
    ("GPL-3.0-only", ("Gpl3",)),
    ("GPL-2.0-or-later", ("Gpl2Later",)),
    ("GPL-3.0-or-later", ("Gpl3Later",)),
    ("LGPL-3.0-only", ("Lgpl3",)),
    ("AGPL-3.0-only", ("Agpl3",)),
    ("MPL-2.0", ("Mpl2",)),
    ("CC-BY-4.0", ("CcBy4",)),
    ("CC-BY-SA-4.0", ("CcBySa4",)),
    ("CC-BY-NC-4.0", ("CcByNc4",)),
    ("CC-BY-ND-4.0", ("CcByNd4",)),
    ("CC0-1.0", ("Cc0",)),
    ("Unlicense", ("Unlicense",)),
)
#: Every known sentence holds one of these, so a text without any has none.
CUES = ("license", "copyright", "warrant", "redistribut", "permission")
_ORDER = sorted(range(len(RULES)), key=lambda i: (-len(RULES[i][1]), i))
_S = r"\x20\x09-\x0D"
_END = rf"[.!?:;]+[{_S}]"
#: Of the SQL only.
_JOIN = r"\n[ \t]*([#*]+|//+|--+)?[ \t]*"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order. Line feeds are the marks at which sentences start and end."""
    known = F.create_map(*(F.lit(x) for i, sentences in SENTENCES.items() for s in sentences for x in (s, i)))
    words = F.regexp_replace(F.translate(F.regexp_replace(text, _END, "\n"), _UPPER, _LOWER), "[^a-z0-9\n]+", " ")
    marked = F.regexp_replace(F.concat(F.lit("\n"), words, F.lit("\n")), " *\n[ \n]*+", "\n")
    longest = sorted((s for sentences in SENTENCES.values() for s in sentences), key=lambda s: (-len(s), s))
    any_known = "(?<=\n)(?:" + "|".join(s.replace(" ", "[ \n]") for s in longest) + ")(?=\n)"
    return F.transform(F.regexp_extract_all(marked, F.lit(any_known), F.lit(0)), lambda s: F.try_element_at(known, F.translate(s, "\n", " ")))


def _licences(ids: Column) -> Column:
    """What the rules find in a sequence of identifiers."""
    rules = F.array(*(F.struct(F.lit("".join(f"|{x}|" for x in RULES[i][1])).alias("seq"), F.lit(RULES[i][0]).alias("name")) for i in _ORDER))
    start = F.struct(F.array_join(F.transform(ids, lambda x: F.concat(F.lit("|"), x, F.lit("|"))), "").alias("left"), F.array().cast("array<string>").alias("found"))

    def step(acc, r):
        hit = F.instr(acc["left"], r["seq"]) > 0
        return F.struct(F.when(hit, F.replace(acc["left"], r["seq"], F.lit("#"))).otherwise(acc["left"]).alias("left"), F.when(hit, F.concat(acc["found"], F.array(r["name"]))).otherwise(acc["found"]).alias("found"))

    return F.aggregate(rules, start, step, lambda acc: acc["found"])


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, sentence_ids and licenses, both as sorted distinct names with commas.

    A text without known sentences, empty or null has two empty strings. Every row is scanned by itself, so repeated ids and rows
    need no rule. Other columns are ignored; an empty table gives no rows.
    """
    cued = docs.select("doc_id", F.when(F.col("text").rlike("(?i)" + "|".join(CUES)), F.col("text")).alias("text"))
    d = cued.select("doc_id", _ids(F.col("text")).alias("ids"))
    names = lambda a: F.coalesce(F.array_join(F.array_sort(F.array_distinct(a)), ","), F.lit(""))
    return d.select("doc_id", names(F.col("ids")).alias("sentence_ids"), names(_licences(F.col("ids"))).alias("licenses"))


def _oracle() -> str:
    table = ", ".join(f"('{s}', '{i}')" for i, sentences in SENTENCES.items() for s in sentences)
    sql = rf"""
WITH known(sentence, id) AS (VALUES {table}),
t AS (SELECT doc_id, text FROM documents WHERE regexp_matches(text, '(?i){"|".join(CUES)}')),
ways AS (SELECT doc_id, 0 AS way, text FROM t UNION ALL SELECT doc_id, 1, regexp_replace(text, '{_JOIN}', ' ', 'g') FROM t),
cut AS (SELECT doc_id, way, string_split(regexp_replace(text, '{_END}', chr(10), 'g'), chr(10)) AS parts FROM ways),
s AS (SELECT doc_id, way, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM cut),
f AS (SELECT doc_id, way, pos, id FROM s JOIN known ON trim(regexp_replace(translate(part, '{_UPPER}', '{_LOWER}'), '[^a-z0-9]+', ' ', 'g'), ' ') = sentence),
r0 AS (SELECT doc_id, way, string_agg('|' || id || '|', '' ORDER BY pos) AS rest, []::VARCHAR[] AS found FROM f GROUP BY doc_id, way)"""
    for k, i in enumerate(_ORDER):
        seq = "".join(f"|{x}|" for x in RULES[i][1])
        sql += f",\nr{k + 1} AS (SELECT doc_id, way, replace(rest, '{seq}', '#') AS rest, CASE WHEN contains(rest, '{seq}') THEN list_append(found, '{RULES[i][0]}') ELSE found END AS found FROM r{k})"
    return sql + f""",
a AS (SELECT doc_id, array_to_string(list_sort(list_distinct(flatten(list(found)))), ',') AS licenses FROM r{len(RULES)} GROUP BY doc_id),
b AS (SELECT doc_id, string_agg(DISTINCT id, ',' ORDER BY id) AS sentence_ids FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(sentence_ids, '') AS sentence_ids, coalesce(licenses, '') AS licenses FROM documents LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id)
"""


#: The same rows in SQL for texts whose known sentences hold no mark and no paragraph break.
ORACLE = _oracle()
