"""Licence scan by canonical digest lookup, in DataFrame functions only.

A text is normalised (case, copyright lines, equivalent spellings, punctuation, white space) and its SHA-256 is
hash-joined to the digests of known licence texts. Whole texts are looked up, of documents and of each of their lines,
never substrings, so a hit is exact up to the normalisation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Notices and short licences (public texts) by SPDX id.
_MIT = """MIT License
Copyright (c) <year> <holder>
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """ISC License
Copyright (c) <year> <holder>
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_2 = f"""Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{_BSD_TAIL}"""
_BSD_3 = _BSD_2.replace(_BSD_TAIL, f"3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n{_BSD_TAIL}")
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_MPL_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
KNOWN = (
    ("MIT", _MIT),
    ("BSD-2-Clause", _BSD_2),
    ("BSD-3-Clause", _BSD_3),
    ("Zlib", _ZLIB),
    ("Apache-2.0", _APACHE_NOTICE),
    ("MPL-2.0", _MPL_NOTICE),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", _ISC),
    ("ISC", "Licensed under the ISC License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "This work is licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
)
#: Spellings that count as one, applied in this order to lower-cased words.
SPELLINGS = (("licence", "license"), ("licenced", "licensed"), ("sub-license", "sublicense"), ("non-infringement", "noninfringement"), ("noncommercial", "non commercial"), ("https:", "http:"), ("v. ", "version "))
#: A line that states a copyright, in lower case.
COPYRIGHT = r"(?m)^[ \t#*/;-]*(copyright|\(c\)|©|all rights reserved)[^\n]*$"
#: The known table is broadcast up to this many rows, as its size is then bounded; beyond, Spark joins as it sees fit.
BROADCAST_ROWS = 50_000


def normalised(text: F.Column) -> F.Column:
    out = F.regexp_replace(F.lower(text), COPYRIGHT, " ")
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


def digest(text: F.Column) -> F.Column:
    """Hex SHA-256 of the normalised text; texts of which nothing is left share the digest of the empty text."""
    return F.sha2(normalised(text), 256)


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """(digest, licence); of two licences with one digest the first by name stays."""
    rows = spark.createDataFrame([(a, b) for a, b in known], "licence string, text string")
    return rows.where(normalised(F.col("text")) != "").groupBy(digest(F.col("text")).alias("digest")).agg(F.min("licence").alias("licence"))


def known_files(spark: SparkSession, path: str) -> DataFrame:
    """(digest, licence) of a folder of whole licence texts, one file each, named by SPDX id: any list a user has."""
    texts = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.txt)?$", 1).alias("licence"), F.col("value").alias("text"))
    return texts.where(normalised(F.col("text")) != "").groupBy(digest(F.col("text")).alias("digest")).agg(F.min("licence").alias("licence"))


def scan_licenses(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, licence (of the whole text, or null), n_lines, line_licences.

    n_lines: lines whose whole text is a known licence or notice; line_licences: their distinct ids, sorted and joined by
    commas (empty if none). Null, empty and punctuation-only texts match nothing. Each row is scanned by itself, also
    rows that repeat a doc_id or have none. A line that states a copyright is no part of a text, with all that stands on
    it. Only doc_id and text are read, so other columns can't clash. ``known`` has (digest, licence), one row per digest,
    by default the built-in texts. The texts stay where they were read: digests are joined to the known table, broadcast
    if it is small by count, and the partial aggregate leaves one narrow row per document before the only shuffle.
    """
    known = known_digests(docs.sparkSession) if known is None else known
    known = F.broadcast(known) if known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else known
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("_row"), F.concat(F.array(text), F.split(text, "\n")).alias("_units"))
    units = rows.select("doc_id", "_row", F.posexplode("_units").alias("_at", "_unit"))
    hits = units.select("doc_id", "_row", "_at", digest(F.col("_unit")).alias("digest")).join(known, "digest", "left")
    line = F.when(F.col("_at") > 0, F.col("licence"))
    return hits.groupBy("_row", "doc_id").agg(
        F.max(F.when(F.col("_at") == 0, F.col("licence"))).alias("licence"),
        F.count(line).alias("n_lines"),
        F.array_join(F.sort_array(F.collect_set(line)), ",").alias("line_licences"),
    ).drop("_row")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _sql_digest(text: str) -> str:
    out = f"regexp_replace(lower({text}), '{COPYRIGHT}', ' ', 'g')"
    for old, new in SPELLINGS:
        out = f"replace({out}, '{old}', '{new}')"
    return f"trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def _sql_known() -> str:
    return ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in KNOWN)


OP7_SQL = f"""
WITH k AS (SELECT min(l) AS licence, {_sql_digest('t')} AS canon FROM (VALUES {_sql_known()}) v(l, t) GROUP BY canon HAVING canon <> ''),
d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
u AS (SELECT r, 0 AS pos, text AS unit FROM d UNION ALL SELECT r, 1, unnest(string_split(text, chr(10))) FROM d),
h AS (SELECT r, pos, licence FROM (SELECT r, pos, {_sql_digest('unit')} AS canon FROM u) JOIN k USING (canon))
SELECT doc_id, max(licence) FILTER (pos = 0) AS licence, count(licence) FILTER (pos = 1) AS n_lines,
       coalesce(string_agg(DISTINCT licence, ',' ORDER BY licence) FILTER (pos = 1), '') AS line_licences
FROM d LEFT JOIN h USING (r) GROUP BY r, doc_id
"""
