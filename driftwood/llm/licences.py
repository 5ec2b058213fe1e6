"""Licence scan by canonical digest lookup.

A text is brought to canonical form: lower case, copyright lines dropped, punctuation and white space one blank, equivalent spellings
unified. The digest of the whole canonical text is looked up among those of known licences; so is each line, as a text of
its own, among those of known licence notices. Known texts go through the same expressions. All work is column expressions
and one hash join; the library's own table of known texts is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines that name a holder and a year, not a licence.
COPYRIGHT_LINE = r"(?m)^[^a-z\n]*(?:copyright[ \t]+[^\n]*[0-9]{4}|copyright[ \t]+\(c\)|copyright[ \t]+©|\(c\)[ \t]|©[ \t]|all rights reserved)[^\n]*$"
PUNCTUATION = r"[^\p{L}\p{N}\n]+"
#: Spellings that mean the same, in canonical form.
EQUIVALENT = [("licence", "license"), ("licenced", "licensed"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("merchantibility", "merchantability"), ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"), ("acknowledgement", "acknowledgment"), ("https", "http"), ("per cent", "percent"), ("v 2 0", "version 2 0"), ("v 3", "version 3")]

#: The bound on the notices whose digests become part of the plan.
MOST_NOTICES = 2000

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

"""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

"""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

"""
_0BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

"""
_ISC_TAIL = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_BSL = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <{}>"""
_GPL_HEADER = """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

{}"""
_GPL_ENDS = {"2": "You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301, USA.", "3": "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."}
#: Whole licences and standard headers, by SPDX identifier.
TEXTS = [("MIT", _MIT), ("MIT", "MIT License\n\n" + _MIT), ("MIT", "The MIT License (MIT)\n\n" + _MIT), ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL), ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL), ("ISC", _ISC + _ISC_TAIL), ("ISC", "ISC License\n\n" + _ISC + _ISC_TAIL), ("0BSD", _0BSD + _ISC_TAIL), ("Zlib", _ZLIB), ("Apache-2.0", _APACHE), ("BSL-1.0", _BSL), *(("Unlicense", _UNLICENSE.format(x)) for x in ("http://unlicense.org", "http://unlicense.org/", "https://unlicense.org", "https://unlicense.org/"))]
TEXTS += [(f"GPL-{v}.0-or-later", _GPL_HEADER.format(v, end)) for v, end in _GPL_ENDS.items()]
#: The digests of the canonical form of longer licences, as they are published.
DIGESTS = [
    ("Apache-2.0", "84ed161685d232dab5187a7a7101279668d583e8fcead2d41433e4fd4a1dbe68"),
    ("Artistic-1.0-Perl", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.3", "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "fcb579371133afd771fed87cd5d8c6dc5648746c9945d4adf08ec5c79aba5c61"),
    ("MPL-2.0", "de0e0bad5657ae87b52462bd6dcfbfa29b0e1c9cdb1af2703a8760bce580dd61"),
]



def notices() -> list[tuple[str, str]]:
    """(identifier, notice): the usual ways to state each licence in one line."""
    named = [("MIT", "MIT License"), ("Apache-2.0", "Apache License, Version 2.0"), ("Apache-2.0", "Apache License 2.0"), ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("ISC", "ISC License"), ("MPL-2.0", "Mozilla Public License, version 2.0"), ("GPL-2.0", "GNU General Public License, version 2"), ("GPL-3.0", "GNU General Public License, version 3"), ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"), ("LGPL-3.0", "GNU Lesser General Public License, version 3"), ("AGPL-3.0", "GNU Affero General Public License, version 3"), ("Unlicense", "Unlicense"), ("Zlib", "zlib License"), ("BSL-1.0", "Boost Software License, Version 1.0")]
    named += [(f"CC-{k}-{v}", f"CC {k} {v}") for k in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND") for v in ("3.0", "4.0")] + [("CC0-1.0", "CC0 1.0")]
    said = ["Licensed under {}", "Licensed under the {}", "Released under {}", "Released under the {}", "Distributed under the {}", "This work is licensed under {}", "This work is licensed under the {}", "This file is licensed under the {}", "This software is released under the {}"]
    return [(i, s.format(n)) for i, n in named for s in said]


def canonical(text: Column) -> Column:
    """The text's canonical lines, one a line, blanks at their ends included; copyright lines are empty."""
    out = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, ""), PUNCTUATION, " ")
    for word, other in EQUIVALENT:
        out = F.regexp_replace(out, rf"\b{word}\b", other)
    return out


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(canonical(text), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def known(spark: SparkSession) -> DataFrame:
    """(digest, license, whole): what is looked up, 64 hex digits each; a few hundred rows by construction."""
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"
    rows = [(i, True, t) for i, t in TEXTS] + [(i, False, t) for i, t in notices()]
    df = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({quote(i)}, {str(w).lower()}, {quote(t)})" for i, w, t in rows) + " AS t(license, whole, text)")
    digests = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{d}', '{i}', true)" for i, d in DIGESTS) + " AS t(digest, license, whole)")
    return df.select(F.sha2(F.array_join(_lines(F.col("text")), " "), 256).alias("digest"), "license", "whole").unionByName(digests).groupBy("digest", "whole").agg(F.min("license").alias("license"))


def licence_scan(docs: DataFrame, *, texts: DataFrame | None = None) -> DataFrame:
    """(doc_id, digest, license, n_notices, notices) of each row of docs (doc_id, text).

    digest is the SHA-256 of the whole canonical text; license is the licence whose text it is, or null. n_notices counts
    the lines that are a licence notice, notices are their licences, each once, sorted and joined by commas. Null and
    empty texts, and those of copyright lines alone, have the digest of the empty text and no licence. Repeated rows are each returned; a null
    doc_id stays null; other columns are ignored. texts (digest, license, whole) replaces the known table, which alone is
    broadcast; it may hold any number of whole texts and MOST_NOTICES notices.
    """
    own = texts is None
    table = known(docs.sparkSession) if own else texts
    notes = table.where("NOT whole").select("digest", "license").limit(MOST_NOTICES + 1).collect()
    if len(notes) > MOST_NOTICES:
        raise ValueError(f"more than {MOST_NOTICES} licence notices")
    whole = table.where("whole").select("digest", "license")
    lines = docs.select("doc_id", _lines(F.col("text").cast("string")).alias("lines"))
    found = lines.withColumn("digest", F.sha2(F.array_join("lines", " "), 256)).join(F.broadcast(whole) if own else whole, "digest", "left")
    named = F.expr("str_to_map('" + ",".join(f"{r['digest']}:{r['license']}" for r in notes) + "', ',', ':')")
    hits = F.filter(F.transform("lines", lambda x: F.try_element_at(named, F.sha2(x, 256))), lambda x: x.isNotNull())
    out = found.withColumn("hits", hits)
    return out.select("doc_id", "digest", "license", F.size("hits").cast("long").alias("n_notices"), F.array_join(F.array_sort(F.array_distinct("hits")), ",").alias("notices"))


def oracle() -> str:
    """The same scan in DuckDB's SQL; known texts are brought to canonical form there as well."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    canon = f"regexp_replace(regexp_replace(lower(coalesce(text, '')), {q(COPYRIGHT_LINE)}, '', 'g'), {q(PUNCTUATION)}, ' ', 'g')"
    for word, other in EQUIVALENT:
        canon = f"regexp_replace({canon}, {q(chr(92) + 'b' + word + chr(92) + 'b')}, {q(other)}, 'g')"
    lines = f"list_filter(list_transform(string_split({canon}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
    rows = ", ".join(f"({q(i)}, {str(w).lower()}, {q(t)})" for i, w, t in [*((i, True, t) for i, t in TEXTS), *((i, False, t) for i, t in notices())])
    digests = ", ".join(f"('{d}', true, '{i}')" for i, d in DIGESTS)
    return f"""
WITH known AS (
  SELECT digest, whole, min(license) AS license FROM (
    SELECT sha256(array_to_string({lines}, ' ')) AS digest, whole, license FROM (VALUES {rows}) AS t(license, whole, text)
    UNION ALL SELECT * FROM (VALUES {digests}) AS t(digest, whole, license)
  ) k GROUP BY 1, 2
),
d AS (SELECT doc_id, {lines} AS lines FROM documents),
notes AS (
  SELECT doc_id, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS ids
  FROM (SELECT doc_id, sha256(unnest(lines)) AS digest FROM d) x JOIN known k ON x.digest = k.digest AND NOT k.whole GROUP BY doc_id
)
SELECT d.doc_id, sha256(array_to_string(lines, ' ')) AS digest, w.license, CAST(coalesce(n, 0) AS BIGINT) AS n_notices, coalesce(ids, '') AS notices
FROM d LEFT JOIN known w ON w.digest = sha256(array_to_string(lines, ' ')) AND w.whole LEFT JOIN notes ON notes.doc_id = d.doc_id
"""
