"""License scans with DataFrame functions only: canonical digests of entire texts, hash-joined to those of known licences.

A text's canonical form is in lower case, without copyright lines, with one spelling for equivalent ones, and with each
run of other characters than letters and digits as one space. Entire documents are looked up; as short notices stand on a
line of their own, so is each entire line. Each text is made canonical once, line by line; only lines with a length that
some known text has are digested, which can miss none. What lines tell of a text is kept by the digest of the text as
given, so it comes back to its rows by a key that does not change when a task runs again.

The known texts are a table (license, text); read_licenses() takes one from a folder. The broadcast side has a digest for
each of them at any corpus size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_size, stored, table

# Published licence texts and notices, without their copyright lines.
_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
"""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>"""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GNU_HEADER = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details.
You should have received a copy of the GNU {0} along with this program. If not, see <https://www.gnu.org/licenses/>."""
KNOWN = [
    ("Unlicense", _UNLICENSE),
    ("Zlib", _ZLIB),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n" + _BOOST),
    ("BSL-1.0", _BOOST),
    ("Apache-2.0", _APACHE_HEADER),
    ("GPL-3.0", _GNU_HEADER.format("General Public License")),
    ("LGPL-3.0", _GNU_HEADER.format("Lesser General Public License")),
    ("AGPL-3.0", _GNU_HEADER.format("Affero General Public License")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("WTFPL", "TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION\n0. You just DO WHAT THE FUCK YOU WANT TO."),
    ("MIT", "MIT License\n" + _GRANT + _WARRANTY),
    ("MIT", _GRANT + _WARRANTY),
    ("ISC", "ISC License\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_END),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _ISC_END),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _BSD_END),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
]
# Spellings taken as equal.
SPELLINGS = [
    ("licence", "license"), ("sub-license", "sublicense"), ("sub license", "sublicense"), ("non-infringement", "noninfringement"), ("non-commercial", "noncommercial"),
    ("copyright owner", "copyright holder"), ("organisation", "organization"), ("authorise", "authorize"), ("recognise", "recognize"), ("favour", "favor"), ("judgement", "judgment"), ("per cent", "percent"), ("http:", "https:"), ("&", " and "),
]
_COPYRIGHT = r"(^|\n)[ \t>*#/-]*(copyright[ \t:]*(\(c\)|©|[0-9]|by |[<\[{])|\(c\)|©|all rights reserved)[^\n]*"


def _canonical_lines(text: Column) -> Column:
    """The canonical forms of a text's lines; null stays null."""
    out = F.regexp_replace(F.lower(text), _COPYRIGHT, "\n")
    for other, own in SPELLINGS:
        out = F.replace(out, F.lit(other), F.lit(own))
    return F.transform(F.split(out, "\n", -1), lambda x: F.btrim(F.regexp_replace(x, r"[^\p{L}\p{N}]+", " ")))


def _joined(lines: Column) -> Column:
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


def canonical(text: Column) -> Column:
    """The canonical form of a text; null stays null."""
    return _joined(_canonical_lines(text))


def known(name: str) -> str:
    """The first text of that name in the fixed list."""
    return next(text for own, text in KNOWN if own == name)


def known_licenses(spark: SparkSession, known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """(license, text) of the fixed list."""
    return spark.createDataFrame(known, "license string, text string")


def read_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """(license, text) of the text files of a folder, one for each licence, named after it."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[A-Za-z]+)?$", 1)
    return spark.read.text(folder, wholetext=True).select(name.alias("license"), F.col("value").alias("text"))


def license_scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, digest (of the entire text), license (the known licence that the entire text is, or
    null) and notices (licences of which an entire line is a known text, sorted, joined by commas; "" for none).

    known: (license, text); of licences with one canonical text the first by name counts. Null and empty texts, and texts
    of nothing but copyright lines and punctuation, have no digest and no licence. Very long texts are scanned whole. Rows
    that repeat an id are scanned each for itself. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    known = known if known is not None else known_licenses(spark)
    known = known.select(canonical(F.col("text")).alias("c"), "license").where("c <> ''").groupBy("c").agg(F.min("license").alias("license"))
    known = stored(known.select(F.sha2("c", 256).alias("digest"), F.char_length("c").alias("n"), "license"), "licenses")
    lengths = [r.n for r in known.select("n").distinct().collect()]  # no more than known texts
    found = by_size(known.select("digest", "license"))

    lines = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).select("id", "text", _canonical_lines(F.col("text")).alias("lines"))
    entire = F.transform(F.filter("lines", lambda x: F.char_length(x).isin(lengths)), lambda x: F.sha2(x, 256))
    rows = lines.select("id", "text", _joined(F.col("lines")).alias("c"), F.array_distinct(entire).alias("entire"))
    rows = rows.select("id", F.when(F.size("entire") > 0, F.sha2("text", 256)).alias("key"), F.when(F.col("c") != "", F.sha2("c", 256)).alias("digest"), "entire")
    rows = stored(rows, "license-digests")
    notices = rows.select("key", F.explode("entire").alias("digest")).join(found, "digest").groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"))
    notices = by_size(stored(notices, "license-notices"))
    out = rows.join(found, "digest", "left").join(notices, "key", "left")
    return out.select(F.col("id").alias(id_col), "digest", "license", F.coalesce("notices", F.lit("")).alias("notices"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of documents against the known licences."""
    return license_scan(table(spark, sf_dir, "documents"))


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql_lines(x: str) -> str:
    out = f"regexp_replace(lower({x}), '(^|\\n)[ \\t>*#/-]*(copyright[ \\t:]*(\\(c\\)|©|[0-9]|by |[<\\[{{])|\\(c\\)|©|all rights reserved)[^\\n]*', chr(10), 'g')"
    for other, own in SPELLINGS:
        out = f"replace({out}, {_sql_text(other)}, {_sql_text(own)})"
    return f"list_transform(string_split({out}, chr(10)), lambda x: trim(regexp_replace(x, '[^\\pL\\pN]+', ' ', 'g')))"


def _sql_canonical(x: str) -> str:
    return f"array_to_string(list_filter({_sql_lines(x)}, lambda y: y <> ''), ' ')"


ORACLE = f"""
WITH known AS (SELECT digest, min(license) AS license FROM (
    SELECT sha256({_sql_canonical("column1")}) AS digest, column0 AS license FROM (VALUES {", ".join(f"({_sql_text(a)}, {_sql_text(b)})" for a, b in KNOWN)}) AS t(column0, column1)) GROUP BY digest),
whole AS (SELECT doc_id, CASE WHEN c <> '' THEN sha256(c) END AS digest FROM (SELECT doc_id, {_sql_canonical("text")} AS c FROM documents)),
lines AS (SELECT doc_id, unnest({_sql_lines("text")}) AS c FROM documents),
notices AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM lines JOIN known ON known.digest = sha256(c) WHERE c <> '' GROUP BY doc_id)
SELECT w.doc_id, w.digest, k.license, coalesce(n.notices, '') AS notices
FROM whole w LEFT JOIN known k ON w.digest = k.digest LEFT JOIN notices n ON n.doc_id = w.doc_id
"""
