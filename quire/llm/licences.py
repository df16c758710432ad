"""Operator 5: licence scan by canonical digests of entire texts, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, table

# Texts of licences and of the notices that name them, as published.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_MIT0 = _MIT.split("\n")[0].replace(", subject to the following conditions:", ".") + "\n" + _MIT.split("\n")[-1]
_0BSD = _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies.", ".")
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
_BSD_1_2 = """1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_BSL = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_UNLICENSE_END = "\nFor more information, please refer to <https://unlicense.org>"
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details.
You should have received a copy of the GNU {0} along with this program. If not, see <https://www.gnu.org/licenses/>."""
_GNU_KINDS = (("GPL-3.0-or-later", "General Public License", 3), ("GPL-2.0-or-later", "General Public License", 2), ("AGPL-3.0-or-later", "Affero General Public License", 3), ("LGPL-3.0-or-later", "Lesser General Public License", 3))
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at {}://mozilla.org/MPL/2.0/."
#: Names in one-line notices of the form "SPDX-License-Identifier: MIT".
SPDX = (
    "MIT MIT-0 ISC 0BSD BSD-2-Clause BSD-3-Clause Zlib Apache-2.0 BSL-1.0 Unlicense MPL-2.0 EPL-2.0 CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 "
    "GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later"
).split()
KNOWN = (
    ("MIT", _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("ISC", _ISC),
    ("ISC", "ISC License\n" + _ISC),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_1_2 + _BSD_TAIL),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD_HEAD + _BSD_1_2 + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_1_2 + _BSD_3 + _BSD_TAIL),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD_HEAD + _BSD_1_2 + _BSD_3 + _BSD_TAIL),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n" + _ZLIB),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("MIT-0", _MIT0),
    ("MIT-0", "MIT No Attribution\n" + _MIT0),
    ("0BSD", _0BSD),
    ("0BSD", "Zero-Clause BSD\n" + _0BSD),
    ("0BSD", "BSD Zero Clause License\n" + _0BSD),
    ("BSL-1.0", _BSL),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n" + _BSL),
    ("Unlicense", _UNLICENSE),
    ("Unlicense", _UNLICENSE + _UNLICENSE_END),
    ("Unlicense", _UNLICENSE + _UNLICENSE_END.replace("https", "http")),
    *((name, _GNU.format(text, version)) for name, text, version in _GNU_KINDS),
    *(("MPL-2.0", _MPL.format(x)) for x in ("http", "https")),
    *((x, f"SPDX-License-Identifier: {x}") for x in SPDX),
)
# Spellings that count as one, in the order in which they are replaced.
SPELLINGS = (
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non infringement", "noninfringement"),
    ("non commercial", "noncommercial"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("copyright owner", "copyright holder"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line that names a holder, and one that reserves all rights.
COPYRIGHT_LINE = r"^[^a-z0-9\n]*(copyright([^a-z0-9\n]+(c|[0-9]+)|[^a-z0-9\n]*©)|©|\(c\) *[0-9]|all rights reserved)[^\n]*$"


def canonical(text: Column) -> Column:
    """A text as its words in one form: case, punctuation, lines of copyright and equivalent spellings count for nothing."""
    plain = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    plain = F.regexp_replace(plain, "(?md)" + COPYRIGHT_LINE, "")  # lines end at a line feed alone
    plain = F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))
    for old, new in SPELLINGS:
        plain = F.replace(plain, F.lit(old), F.lit(new))
    return plain


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known(spark: SparkSession, licences=KNOWN) -> DataFrame:
    """(digest, licence) of licence texts; of equal digests the first licence by name."""
    rows = spark.createDataFrame(list(licences), "licence string, text string")
    return rows.select(digest(F.col("text")).alias("digest"), "licence").groupBy("digest").agg(F.min("licence").alias("licence"))


def known_files(spark: SparkSession, folder: str) -> DataFrame:
    """(digest, licence) of a folder of text files, each named after its licence and then .txt."""
    rows = spark.read.text(folder, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("licence"), "value")
    return rows.select(digest(F.col("value")).alias("digest"), "licence").groupBy("digest").agg(F.min("licence").alias("licence"))


def scan(texts: DataFrame, licences: DataFrame, text: str = "text") -> DataFrame:
    """texts with licence_digest and licence: the one whose digest the entire text has, or null.

    Null and empty texts, and those without an ASCII letter or digit, have the digest of the empty
    text and no licence. Every row stays, repeated ones too; an empty table stays empty. Columns of
    other names stay; a column named licence or licence_digest is replaced. The table of known
    digests has a row for each licence text; it is broadcast after its rows are counted, or joined by
    shuffle if they are many.
    """
    named = bounded(licences.select(F.col("digest").alias("_digest"), F.col("licence").alias("_licence")))
    rows = texts.withColumn("licence_digest", digest(F.col(text)))
    rows = rows.join(named, rows["licence_digest"] == named["_digest"], "left")
    return rows.withColumn("licence", named["_licence"]).drop(named["_digest"], named["_licence"])


def scan_lines(docs: DataFrame, licences: DataFrame) -> DataFrame:
    """(doc_id, line, licence) for each line of a document that is, as a whole, a known text; lines count from 0."""
    return scan_both(docs, licences).where("line IS NOT NULL").select("doc_id", "line", "licence")


def scan_both(docs: DataFrame, licences: DataFrame) -> DataFrame:
    """(doc_id, line, licence, licence_digest) in one read: each document as a whole (line null), and its lines that are known texts."""
    text = F.coalesce("text", F.lit(""))
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("line"), x.alias("part")))
    parts = F.concat(F.array(F.struct(F.lit(None).cast("int").alias("line"), text.alias("part"))), lines)
    rows = scan(docs.select("doc_id", F.explode(parts).alias("_p")).select("doc_id", "_p.line", "_p.part"), licences, "part")
    found = rows.where("line IS NULL OR licence IS NOT NULL")
    return found.select("doc_id", "line", "licence", F.when(F.col("line").isNull(), F.col("licence_digest")).alias("licence_digest"))


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document as a whole (line null), and one for each line that is a whole notice."""
    return scan_both(table(spark, sf_dir, "documents"), known(spark))


def _sql(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _canonical_sql(x: str) -> str:
    out = f"trim(regexp_replace(regexp_replace(translate(coalesce({x}, ''), '{_UPPER}', '{_LOWER}'), {_sql('(?m)' + COPYRIGHT_LINE)}, '', 'g'), '[^a-z0-9]+', ' ', 'g'))"
    for old, new in SPELLINGS:
        out = f"replace({out}, {_sql(old)}, {_sql(new)})"
    return out


OP5_SQL = f"""
WITH known AS (
  SELECT sha256({_canonical_sql("t")}) AS digest, min(l) AS licence FROM (VALUES {", ".join(f"({_sql(a)}, {_sql(b)})" for a, b in KNOWN)}) AS x(l, t) GROUP BY 1
), lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line FROM documents
)
SELECT doc_id, CAST(NULL AS INTEGER) AS line, licence, sha256({_canonical_sql("text")}) AS licence_digest
FROM documents LEFT JOIN known ON digest = sha256({_canonical_sql("text")})
UNION ALL
SELECT doc_id, CAST(line AS INTEGER), licence, CAST(NULL AS VARCHAR) FROM lines JOIN known ON digest = sha256({_canonical_sql("t")})
"""
