"""Licence scans by canonical digests.

A text is brought into a canonical form: lower case, no copyright lines, one spelling of equivalent words, and one space for
every run of anything but letters and digits. Its SHA-256 digest is looked up among those of known licence texts by a hash join, for
the whole text of each document and for each of its lines (notices). Only DataFrame functions are used.

Known texts are a table of ids and whole texts (by default the list here, of a few hundred digests). Its digests are broadcast if they are counted to be at
most ``SMALL``, else joined by a shuffle. With a broadcast, lines are matched in the tasks that read the documents, and only lines with a match are shuffled.

Edge cases: a null or empty text matches nothing and has the digest of the empty string; repeated rows each get a row; texts of any length
are taken whole; of licences with equal canonical texts the first by name counts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines that name a copyright holder or reserve rights, in lower case.
COPYRIGHT_LINE = r"(^|\n)[^\p{L}\p{N}\n]*(copyright|copr\.|\(c\)|©)[^\n]*([0-9]{4}|\(c\)|©|year|yyyy)[^\n]*"
RESERVED_LINE = r"(^|\n)[^\p{L}\p{N}\n]*all rights reserved[^\p{L}\p{N}\n]*"
SEPARATORS = r"[^\p{L}\p{N}]+"
#: Spellings that count as the same, each written as the other.
ISE = r"([a-z]{3,})is(e|ed|es|er|ers|ing|ation|ations)\b"
SPELLINGS = [
    ("licenc", "licens"), ("sub licens", "sublicens"), ("non commercial", "noncommercial"), ("copyright owner", "copyright holder"),
    ("per cent", "percent"), ("https", "http"), ("whilst", "while"), ("judgement", "judgment"), ("acknowledgement", "acknowledgment"),
    ("favour", "favor"), ("labour", "labor"), ("colour", "color"), ("behaviour", "behavior"), ("centre", "center"), ("catalogue", "catalog"),
    ("analogue", "analog"), ("programme", "program"), ("practise", "practice"), ("offence", "offense"), ("artefact", "artifact"),
    ("labelled", "labeled"), ("labelling", "labeling"), ("modelling", "modeling"), ("cancelled", "canceled"), ("fulfill", "fulfil"), ("wilful", "willful"),
]

#: Known licence texts (public), without their copyright lines.
WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"""
BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution."""
BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
software without specific prior written permission."""
BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER
OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE,
EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR
IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
TEXTS = {
    "MIT": f"{MIT_GRANT}, subject to the following conditions:\n\n{MIT_NOTICE}\n\n{WARRANTY}",
    "MIT-0": f"{MIT_GRANT}.\n\n{WARRANTY}",
    "BSD-2-Clause": f"{BSD_HEAD}\n\n{BSD_WARRANTY}",
    "BSD-3-Clause": f"{BSD_HEAD}\n{BSD_THIRD}\n\n{BSD_WARRANTY}",
    "ISC": f"{ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{ISC_WARRANTY}",
    "0BSD": f"{ISC_GRANT}.\n\n{ISC_WARRANTY}",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the
License for the specific language governing permissions and limitations under the License.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file,
You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it
will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General
Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see
<https://www.gnu.org/licenses/>.""",
}
#: How notices name licences.
NAMES = {
    "MIT": ["the MIT License", "the MIT Licence", "MIT License"],
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0", "Apache License 2.0", "Apache-2.0"],
    "GPL-2.0": ["the GNU General Public License, version 2", "the GNU General Public License v2", "the GNU GPL v2"],
    "GPL-3.0": ["the GNU General Public License, version 3", "the GNU General Public License v3", "the GNU GPL v3"],
    "BSD-3-Clause": ["the BSD 3-Clause License", "the 3-Clause BSD License"],
    "BSD-2-Clause": ["the BSD 2-Clause License", "the 2-Clause BSD License"],
    "MPL-2.0": ["the Mozilla Public License, Version 2.0", "the Mozilla Public License 2.0"],
    **{f"CC-{k}-4.0": [f"CC {k} 4.0", f"CC-{k}-4.0", f"a Creative Commons {k} 4.0 License"] for k in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")},
    "CC0-1.0": ["CC0 1.0", "CC0"],
}
VERBS = ["Licensed under", "Released under", "Distributed under", "Available under", "This work is licensed under", "This project is licensed under", "This software is licensed under", "This text is licensed under"]

#: Title lines under which licences are published.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"],
    "MIT-0": ["MIT No Attribution", "MIT No Attribution License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License", "Modified BSD License", "BSD License"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "BSD 0-Clause License"],
    "Unlicense": ["The Unlicense", "Unlicense"],
}
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the
public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication
to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

""" + WARRANTY.replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS") + "\n\nFor more information, please refer to <https://unlicense.org>"
MORE_VERBS = ["This file is licensed under", "This code is licensed under", "This program is licensed under", "This library is licensed under", "This package is licensed under", "This repository is licensed under", "This document is licensed under", "This project is released under", "This software is released under", "This software is distributed under", "Licensed under the terms of", "Distributed under the terms of", "Released under the terms of"]
#: Digests of long published texts whose words aren't repeated here.
DIGESTS: dict[str, list[str]] = {
    "Apache-2.0": ["714d0b92f32d3349216bea5b0fdca7aa9cda4730dbc0fa21485e294fedeec1f5", "f3eb3b8206865bb2a8c2f736c1e0346a547c6d14c07813f84f468e4245aaee8a", "072eaac50a127ac5733332b81842abc496759d9dadd66566d3170b25850f315f"],
    "GPL-2.0": ["6375475ed49478604fcb8c902de9f613f0ea85cb0c9741fa7a45619c488ed90b", "2b5dbc9472da3bc5519b8ecb2f9a8d542a84232dee69b88695bfa44b1f32a911", "e6da5b50589df55fc0b450887ed02d9dd7e85695a7988e2446ce5471154ba8e2"],
    "GPL-3.0": ["ed797a9b0ecd3d9098f0f28e5997aeda69462e79aafe636ae99b8a122e929d51", "e61270f05fffe39fb0f0eb4a04a982a7048cfc03a94d0a2a7bf294c40903feeb", "3d88bb32a0c17cf7082ce52f18d6ff5f8bb33111a62b104468bad8a6a1e0451c"],
    "GPL-1.0": ["e364aad3db413655fde3de60fabbec1cf77c7bd3b2944d17cea899a1f72d7d60", "4d8661076b271388204b513334f465af9649e35bb9dfc968f5fc2af75fff36a6", "10432111b8d3d37d7de54c5df4d285fd692e6eeaa9196224dba390cc24d6789b"],
    "LGPL-2.0": ["d0f63e6e433c39ca404c5b07fd50cd5ed68e4798effaa938b128c99e17ae60e0", "07d0fd4db5feea275c2d1835863a165d0e4b4ac86cc19e495e2c74ec250c52cc", "d4d29fdef217ed5b5695cc50146efc75c0903bbadbee010ef1a57b4cf72a66f8"],
    "LGPL-2.1": ["00cac975b1dd6f793b3f024aa244e01bf63ecc4db816979593bdb026e8fa5120", "4995c2e9d970b57711085cbfc0b7ca42ade195d279b3d8c244c1efb53826078c", "37f2cd032332ffe201fffd647f624754da0e3a8799d2811d64542db69110d56e"],
    "LGPL-3.0": ["9111884d93a72b30a3d024876dab3d755949ac2cfab230268a4169a93b86560c"],
    "MPL-1.1": ["347713df4216b4132573d15558dc0667667f91248c7cbb8ddcb341a6642b8d61"],
    "MPL-2.0": ["f3f10d713803bb806d83620f1aab451770b6577b5276a67225a3f4fea27fb8e5"],
    "CC0-1.0": ["97098b9d4d582064b16255ff38f4b45a41ecce484eb98a46cdb15423d6de9f85"],
    "GFDL-1.3": ["c136842c3bb94c66f9158ddea107c935e305b1f3d74c98797ad031c4abf1d065"],
}
#: A line that names a copyright holder, with or without a year; taken out only to look licences up, so reported digests don't change.
HOLDER_LINE = r"(^|\n)[^\p{L}\p{N}\n]*(copyright(?! +(holder|owner|notice|law|interest|licen[cs]e|and|or)s?\b)|copr\.|\(c\)|©)[^\n]*"


#: Digests that are broadcast at most.
SMALL = 100_000


def variants() -> list[tuple[str, str]]:
    """Published variants of the known texts: title lines, bullets in place of numbers, and more notices."""
    whole = {**{i: TEXTS[i] for i in TITLES if i in TEXTS}, "Unlicense": UNLICENSE}
    out = [("Unlicense", UNLICENSE)]
    for i, text in whole.items():
        forms = [text, re.sub(r"(?m)^[123]\. ", "* ", text)] if i.startswith("BSD") else [text]
        out += [(i, f"{title}\n\n{form}") for form in forms for title in ("", *TITLES[i])]
    return out + [(i, f"{verb} {name}.") for i, names in NAMES.items() for name in names for verb in MORE_VERBS]


def known_texts() -> list[tuple[str, str]]:
    """Licence ids and their texts: the licences themselves, and one-line notices by rule."""
    notices = [(i, f"{verb} {name}.") for i, names in NAMES.items() for name in names for verb in VERBS]
    return sorted(TEXTS.items()) + notices


def canonical(text: Column) -> Column:
    out = F.lower(F.coalesce(text, F.lit("")))
    for pattern in (COPYRIGHT_LINE, RESERVED_LINE):
        out = F.regexp_replace(out, pattern, "\n")
    out = F.trim(F.regexp_replace(out, SEPARATORS, " "))
    out = F.regexp_replace(out, ISE, "$1iz$2")
    for found, put in SPELLINGS:
        out = F.replace(out, F.lit(found), F.lit(put))
    return out


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known(spark: SparkSession, texts: DataFrame | None = None) -> DataFrame:
    """``digest`` and ``license_id`` of the known texts (license_id, text), one row a digest."""
    given = spark.createDataFrame(known_texts() + variants(), "license_id string, text string") if texts is None else texts
    rows = given.where(F.col("text").isNotNull()).select("license_id", digest(F.col("text")).alias("digest"))
    if texts is None:
        rows = rows.unionByName(spark.createDataFrame([(i, d) for i, ds in DIGESTS.items() for d in ds], "license_id string, digest string"))
    return rows.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: DataFrame | None = None) -> DataFrame:
    """Per row: its id, ``digest`` of the whole canonical text, ``license_id`` if that is a known licence, ``n_notices`` lines that
    are known, and ``notice_ids``, the different licences that they name, in order and joined by commas (null if none)."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    units = rows.select("row", "id", F.posexplode(F.concat(F.array("text"), F.split("text", "\n"))).alias("line", "text"))
    whole = F.col("line") == 0
    found = units.select("row", "id", whole.alias("whole"), digest(F.col("text")).alias("digest"), F.when(whole & F.lower("text").rlike(HOLDER_LINE), digest(F.regexp_replace(F.lower("text"), HOLDER_LINE, "\n"))).alias("bare"))
    table = known(docs.sparkSession, texts).checkpoint()
    small = table.count() <= SMALL
    table = F.broadcast(table) if small else table
    bare = table.select(F.col("digest").alias("bare"), F.col("license_id").alias("bare_id"))
    found = found.join(table, "digest", "left").join(F.broadcast(bare) if small else bare, "bare", "left").withColumn("license_id", F.coalesce("license_id", "bare_id")).where(F.col("whole") | F.col("license_id").isNotNull())
    notice = F.when(~F.col("whole"), F.col("license_id"))
    out = found.groupBy("row", "id").agg(
        F.max(F.when(F.col("whole"), F.col("digest"))).alias("digest"),
        F.max(F.when(F.col("whole"), F.col("license_id"))).alias("license_id"),
        F.count(notice).alias("n_notices"),
        F.array_join(F.array_sort(F.collect_set(notice)), ",").alias("notice_ids"),
    )
    return out.select(F.col("id").alias(id_col), "digest", "license_id", "n_notices", F.when(F.col("n_notices") > 0, F.col("notice_ids")).alias("notice_ids"))


def sql() -> str:
    """The scan of ``documents`` in DuckDB's SQL."""

    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def form(text: str) -> str:
        out = f"lower(coalesce({text}, ''))"
        for pattern in (COPYRIGHT_LINE, RESERVED_LINE):
            out = f"regexp_replace({out}, {quoted(pattern)}, chr(10), 'g')"
        out = f"trim(regexp_replace({out}, {quoted(SEPARATORS)}, ' ', 'g'))"
        out = f"regexp_replace({out}, {quoted(ISE)}, '\\1iz\\2', 'g')"
        for found, put in SPELLINGS:
            out = f"replace({out}, {quoted(found)}, {quoted(put)})"
        return f"sha256({out})"

    values = ", ".join(f"({quoted(i)}, {quoted(t)})" for i, t in known_texts())
    return f"""
WITH texts(license_id, text) AS (VALUES {values}),
known AS (SELECT {form("text")} AS digest, min(license_id) AS license_id FROM texts GROUP BY 1),
docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
lines AS (SELECT r, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM docs),
notices AS (
  SELECT r, count(*) AS n, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS ids
  FROM (SELECT r, {form("line")} AS digest FROM lines) JOIN known USING (digest) GROUP BY r
),
whole AS (SELECT r, doc_id, {form("text")} AS digest FROM docs)
SELECT doc_id, digest, license_id, CAST(coalesce(n, 0) AS BIGINT) AS n_notices, ids AS notice_ids
FROM whole LEFT JOIN known USING (digest) LEFT JOIN notices USING (r)
"""
