"""Licence scans by canonical digest, in DataFrame operations only.

A text's canonical form has A-Z in lower case, no copyright lines, no numbers or letters of list items at the beginnings of lines,
equivalent spellings written one way, and one space for each run of other characters than letters, digits and non-ASCII characters.
Its SHA-256 is looked up in a table of digests of known licences by a hash join, for whole texts and, for notices inside longer
texts, for single lines.

The table that comes with it has the short licences and notices of ``KNOWN``, each with its usual headings, and the digests of
``LONG``. :func:`read_known` makes one of a folder of texts, such as a checkout of the SPDX list, to be given to :func:`scan`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few
from .decontaminate import lower_ascii

# Licence texts and notices, as published, without their copyright lines.
_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
_BSD_TAIL = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
KNOWN = (
    ("MIT", _MIT + _WARRANTY),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_WARRANTY),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_WARRANTY),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _BSD_TAIL),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
)
# Headings that licence files carry.
HEADINGS = {"MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"), "ISC": ("ISC License", "The ISC License"), "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"), "BSD-2-Clause": ("BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License"), "BSD-3-Clause": ("BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License"), "Zlib": ("zlib License", "The zlib/libpng License")}
# SHA-256 of the canonical forms of long licence texts, as the Debian distribution carries them in common-licenses.
LONG = (
    ("Apache-2.0", "f213b407df637bc294997de205aecfc82e06a5e4ef6d75893ec348ca26dd13c2"),
    ("Artistic-1.0-Perl", "4834e699353522cfb463bd8b374752ecf02156bb3f5dfb53d0edb502a112a651"),
    ("CC0-1.0", "888ab175b43ed137ae3c3f8f32a1f0e1677fe31f7a9f09890c39b11b1934ad6c"),
    ("GFDL-1.2", "7bd3a9b625b0b9c72d575e34948a31aa1d9a92600e54323c0abd84a9844ce82d"),
    ("GFDL-1.3", "3e03599855be6f5154c1bba1c4189768a3518f5863527559438fa78fa2262af5"),
    ("GPL-1.0", "ac910954c3184907f3947de0193b0169b8c69656ff2de7f3330438f6ba4fb746"),
    ("GPL-2.0", "2e8e378a3d24393c0f3fd1439ffbe84e750886c09715e622426a6a0e54fa1bee"),
    ("GPL-3.0", "3695e90f7fe4b461853cec533de5675ab2b6b1fcafcb504d6c64ded76f675d64"),
    ("LGPL-2.0", "4a1b1cb15d45262f049457ae26945909d0e5af93e2e3fb5de82c9f72ac6bebe2"),
    ("LGPL-2.1", "f2755dc4b609b314faab32d30ca6d0466b60adc931cece2ea4f0b61f483bfc98"),
    ("LGPL-3.0", "cb8c0f424bdd5c42a0b18285893829d988e9fb9a00d0cd604a59ebe8da7eeb45"),
    ("MPL-1.1", "661007e231ca5b302d4c3ee263967beb6a810bf9cb12a246d2d15ac0c31860b5"),
    ("MPL-2.0", "8dce888cb942d93cebeb8e0fea8afac43e084f54254ac4d9b99cfde68a62468b"),
)
# Equivalent spellings, as in the SPDX matching guidelines.
SPELLINGS = (("licence", "license"), ("licenced", "licensed"), ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("acknowledgement", "acknowledgment"), ("merchantibility", "merchantability"), ("copyright owner", "copyright holder"), ("per cent", "percent"), ("whilst", "while"), ("wilful", "willful"), ("fulfil", "fulfill"), ("https", "http"))
#: A line that begins with a sign of copyright, or with the word where a sign, a year or the place of one follows; and one of reserved rights.
COPYRIGHT_LINE = r"(^|\n)[^a-z0-9\n]*(copyright[ :][^\n]*(\(c\)|©|(19|20)[0-9][0-9]|[\[<{]y(ear|yyy))|copyright[ :]*(\(c\)|©|y(ear|yyy))|©|\(c\) *[0-9]{4}|all rights reserved)[^\n]*"
#: The mark of a list item at the beginning of a line.
ITEM = r"(^|\n)[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]*([0-9]{1,2}|[a-z])[.)][ \t]"
OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def canonical(text: Column) -> Column:
    """The canonical form; empty for null or for texts without words."""
    lines = F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "\n")
    # two spaces between words: each word has its own on both sides, so that none is missed beside another that is spelt anew
    padded = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.regexp_replace(lines, ITEM, "\n"), OTHER, "  ")), F.lit(" "))
    for said, meant in SPELLINGS:
        padded = F.replace(padded, F.lit(f" {said.replace(' ', '  ')} "), F.lit(f" {meant.replace(' ', '  ')} "))
    return F.replace(F.trim(padded), F.lit("  "), F.lit(" "))


def digests_of(texts: DataFrame) -> DataFrame:
    """(digest, license_id) of (license_id, t); of texts with one digest the first id in order counts."""
    return texts.groupBy(F.sha2(canonical(F.col("t")), 256).alias("digest")).agg(F.min("license_id").alias("license_id"))


def known_digests(spark: SparkSession) -> DataFrame:
    """(digest, license_id) of ``KNOWN``, with and without headings, and of ``LONG``."""
    headed = [(i, f"{h}\n{t}") for i, t in KNOWN for h in HEADINGS.get(i, ()) if len(t) > 200]
    own = digests_of(spark.createDataFrame([*KNOWN, *headed], "license_id string, t string"))
    return own.unionByName(spark.createDataFrame(list(LONG), "license_id string, digest string"))


def read_known(spark: SparkSession, path: str) -> DataFrame:
    """(digest, license_id) of a folder of licence texts, each in a file of its own named by its id, with or without ``.txt``."""
    files = spark.read.text(path, wholetext=True).select(F.col("value").alias("t"), F.regexp_replace(F.element_at(F.split("_metadata.file_path", "/"), -1), r"\.txt$", "").alias("license_id"))
    return digests_of(files)


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, license_id, notices) for each row: the whole text's digest and licence (null if unknown), and the licences of single lines, sorted and comma-joined ('' if none).

    Null, empty and word-less texts have the digest of the empty string and no licence. Rows equal in id and text share their
    notices; a null id is an id like others. ``known`` may be any table (digest, license_id) with distinct digests.
    """
    known = few(known_digests(docs.sparkSession) if known is None else known)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("v"), F.col(text_col).alias("t"))
    whole = rows.select("id", "v", F.sha2(canonical(F.col("t")), 256).alias("digest")).join(known, "digest", "left")
    lines = rows.select("id", "v", F.explode(F.split("t", "\n")).alias("line"))
    found = lines.select("id", "v", F.sha2(canonical(F.col("line")), 256).alias("digest")).join(known, "digest").groupBy("id", "v").agg(F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("notices"))
    found = found.select(F.col("id").alias("_id"), F.col("v").alias("_v"), "notices")
    out = whole.join(found, F.col("id").eqNullSafe(F.col("_id")) & (F.col("v") == F.col("_v")), "left")
    return out.select(F.col("id").alias(id_col), "digest", "license_id", F.coalesce("notices", F.lit("")).alias("notices"))
