import textwrap

from carrel.llm import licenses as lic

MIT = """/*
 * Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
 * associated documentation files (the "Software"), to deal in the Software without restriction, including without
 * limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
 * and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
 * The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
 */"""
CASES = [
    ("Some text. Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
    ("Some text\nReleased under the MIT License.\nmore", "MIT"),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0-only"),
    ("This work is licensed under the GNU General Public License, version 3. Or (at your option) any later version of the License.", "GPL-3.0-or-later"),
    ("Licensed under the Apache License,\n  Version 2.0. LICENSED under the Apache license, version 2.0!", "Apache-2.0"),
    ("Released under the MIT License.\nLicensed under CC BY 4.0.\n", "CC-BY-4.0,MIT"),
    (MIT, "MIT"),
    ("See the license office for licences.", ""),
    ("", ""),
    (None, ""),
]


def test_cases(spark):
    d = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(CASES)], "doc_id long, text string, licenses string")
    got = {r.doc_id: r.licenses for r in lic.scan(d).collect()}
    assert got == {i: want for i, (_, want) in enumerate(CASES)}


def test_every_known_sentence_has_a_cue_and_every_rule_known_identifiers():
    assert all(any(c in s for c in lic.CUES) for ss in lic.SENTENCES.values() for s in ss)
    assert all(x in lic.SENTENCES for _, seq in lic.RULES for x in seq)


def test_rules_are_ordered():
    # The grant alone is no licence; with the notice it is; a longer rule takes what a shorter one would.
    assert [lic.RULES[i][0] for i in lic._ORDER][0] == "Apache-2.0" and len(lic.RULES[lic._ORDER[0]][1]) == 5


def test_oddities(spark, docs, empty):
    assert lic.scan(docs).count() == docs.count() and lic.scan(empty).count() == 0
    plan = lic.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


#: Known sentences as they are published, where marks or paragraph breaks are part of them.
PUBLISHED = {
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "Gpl3Later",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.": "Gpl2Later",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.": "GnuNoWarranty",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "Mpl2",
    "You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0": "ApacheObtain",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.": "BsdSource",
    "SPDX-License-Identifier: Apache-2.0": "Apache2",
    "SPDX-License-Identifier: MIT": "Mit",
    "SPDX-License-Identifier: BSD-2-Clause": "Bsd2",
    "SPDX-License-Identifier: BSD-3-Clause": "Bsd3",
    "SPDX-License-Identifier: GPL-2.0-only": "Gpl2",
    "SPDX-License-Identifier: GPL-3.0-only": "Gpl3",
    "SPDX-License-Identifier: GPL-2.0-or-later": "Gpl2Later",
    "SPDX-License-Identifier: GPL-3.0-or-later": "Gpl3Later",
}
MIT_FILE = """Copyright (c) 2024 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
APACHE_FILE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
"""


def test_every_sentence_wrapped_and_unwrapped(spark):
    plain = {s[0].upper() + s[1:] + ".": i for i, ss in lic.SENTENCES.items() for s in ss}
    cases = [(t, i) for s, i in {**plain, **PUBLISHED}.items() for t in (s, "Some words first\n\n" + textwrap.indent(textwrap.fill(s, 40), " * ") + "\n\nSome words after")]
    d = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r.sentence_ids for r in lic.scan(d).collect()}
    assert [(t, got[k]) for k, (t, i) in enumerate(cases) if got[k] != i] == []


def test_published_texts(spark):
    gpl = list(PUBLISHED)[:3]
    rest = "\n\nSee the GNU General Public License for more details.\n\nYou should have received a copy of the GNU General Public License along with this program."
    want = [(MIT_FILE, "MIT"), (APACHE_FILE, "Apache-2.0"), (textwrap.fill(gpl[0], 70) + "\n\n" + textwrap.fill(gpl[2], 70) + rest, "GPL-3.0-or-later"), (textwrap.fill(gpl[1], 70) + "\n\n" + textwrap.fill(gpl[2], 70) + rest, "GPL-2.0-or-later")]
    got = {r.doc_id: r for r in lic.scan(spark.createDataFrame([(k, t) for k, (t, _) in enumerate(want)], "doc_id long, text string")).collect()}
    assert [got[k].licenses for k in range(4)] == [n for _, n in want]
    assert got[0].sentence_ids == "MitAsIs,MitGrant,MitLiability,MitNotice"
    assert got[1].sentence_ids == "Apache2,ApacheAsIs,ApacheComply,ApacheObtain,ApacheSee"


def test_sentences_of_any_raw_length(spark, duck):
    texts = ["licensed under" + " " * 4100 + "the MIT License.", "Licensed under" + " \t(" * 30_000 + " the MIT License"]
    assert [r.licenses for r in lic.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()] == ["MIT", "MIT"]
    got = duck.sql(lic.ORACLE.replace("documents", f"(VALUES (0, '{texts[0]}')) documents(doc_id, text)", 1).replace("FROM documents LEFT", "FROM (SELECT 0 AS doc_id) LEFT")).fetchall()
    assert got[0][2] == "MIT"
