"""Licence scans by canonical digest lookup, with DataFrame functions only.

A text is brought to a canonical form (case, punctuation, white space, copyright lines, equivalent spellings), and the MD5
of the whole form is joined by hash to the digests of known licence texts. The lines of a text are looked up the same way,
so that a notice in a longer document is found too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftloom.session import materialize, maybe_broadcast

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>"""
#: (licence, text): whole texts and the notices by which works name their licence; fixed values
KNOWN = (
    ("MIT", MIT),
    ("MIT", "MIT License\n" + MIT),
    ("MIT", "The MIT License (MIT)\n" + MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", ISC),
    ("ISC", "ISC License\n" + ISC),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("Apache-2.0", APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License").'),
    ("Apache-2.0", "Released under the Apache License 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("BSD-2-Clause", BSD_CONDITIONS + BSD_DISCLAIMER),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + BSD_CONDITIONS + BSD_DISCLAIMER),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", BSD_CONDITIONS + BSD_NAMES + BSD_DISCLAIMER),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + BSD_CONDITIONS + BSD_NAMES + BSD_DISCLAIMER),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("Zlib", ZLIB),
    ("Zlib", "zlib License\n" + ZLIB),
    ("Unlicense", UNLICENSE),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
)
#: (pattern, replacement) in order, over lower-cased text with a line feed before it; lines stay apart
STEPS = (
    (r"all[ \n]+rights[ \n]+reserved", " "),
    # these are no copyright lines, wherever the text is wrapped
    (r"copyright[^a-z0-9]+(notice|holder|owner|law|licen|statement|disclaimer|interest|protect|infring|and |or |in |is )", "copyright$1"),
    (r"\n[^a-z0-9\n]*(copyright[^a-z0-9\n][^\n]*|copyright\n|\(c\)[^a-z0-9\n]*(copyright|[0-9][0-9][0-9][0-9])[^\n]*|©[^\n]*)", "\n"),
    (r"licence", "license"),
    (r"sub-license", "sublicense"),
    (r"non-infringement", "noninfringement"),
    (r"merchantibility", "merchantability"),
    (r"https:", "http:"),
    (r"&", " and "),
    (r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F‘’“”–—©]+", " "),
    (r" *\n[ \n]*", "\n"),
)


def canonical(text: Column) -> Column:
    """The canonical form with its lines apart: lower-case words, single spaces, no empty lines; null gives the empty form."""
    t = F.concat(F.lit("\n"), F.lower(F.coalesce(text, F.lit(""))))
    for pattern, to in STEPS:
        t = F.replace(t, F.lit(pattern), F.lit(to)) if pattern.replace(" ", "").replace("-", "").isalpha() else F.regexp_replace(t, pattern, to)
    return F.trim(F.translate(t, "\n", "\n"))


def digest(form: Column) -> Column:
    return F.md5(F.encode(F.trim(F.translate(form, "\n", " ")), "UTF-8"))


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """license, digest, size (characters of the canonical form) of the known texts; one licence, the least, a digest."""
    table = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(a).alias("license"), F.lit(b).alias("text")) for a, b in known])))
    form = canonical(F.col("text"))
    flat = F.trim(F.translate(form, "\n", " "))
    return table.select("license", digest(form).alias("digest"), F.length(flat).alias("size")).groupBy("digest").agg(F.min("license").alias("license"), F.min("size").alias("size"))


def scan(df: DataFrame, known: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, digest, license, line_licenses and n_lines for every row.

    license: that of the known text which the whole text equals canonically, else null. line_licenses: licences of its
    lines that are known texts, distinct, by name, comma-joined (none: empty). n_lines: how many of its lines are. Null and
    empty texts have the digest of the empty form and no licence. Repeated rows stay; an empty table gives no rows; columns
    other than key and text are not read. ``known``: license, digest and size as from ``known_digests``; it is broadcast
    only if a count shows that it is small.
    """
    known = materialize(known if known is not None else known_digests(df.sparkSession), "known")
    sizes = known.agg(F.min("size"), F.max("size")).first()
    least, most = (sizes[0] or 0), (sizes[1] or 0)
    form = canonical(F.col(text))
    # a line can only equal a known text of its length
    lines = F.filter(F.split(F.trim(F.col("form")), "\n"), lambda x: F.length(F.trim(x)).between(least, most))
    base = df.select(F.monotonically_increasing_id().alias("uid"), F.col(key).alias("key"), form.alias("form"))
    base = base.select("uid", "key", digest(F.col("form")).alias("digest"), F.transform(lines, lambda x: F.md5(F.encode(F.trim(x), "UTF-8"))).alias("lines"))
    base = materialize(base, "digests")
    small = maybe_broadcast(known.select("digest", "license"))
    hits = base.select("uid", F.explode("lines").alias("digest")).join(small, "digest").groupBy("uid").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("line_licenses"), F.count("*").alias("n_lines"))
    return (
        base.select("uid", "key", "digest")
        .join(small, "digest", "left")
        .join(hits, "uid", "left")
        .select(F.col("key").alias(key), "digest", "license", F.coalesce("line_licenses", F.lit("")).alias("line_licenses"), F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"))
    )


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql(known=KNOWN) -> str:
    """The same scan in DuckDB SQL over ``documents``."""
    form = "chr(10) || lower(coalesce(text, ''))"
    for pattern, to in STEPS:
        form = f"regexp_replace({form}, {_quoted(pattern)}, {_quoted(to.replace("$1", chr(92) + "1")) if to != chr(10) else 'chr(10)'}, 'g')"
    form = f"trim({form}, ' ')"
    rows = ", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in known)
    return f"""
with known_text(license, text) as (values {rows}),
known as (select md5(trim(replace(form, chr(10), ' '), ' ')) as digest, min(license) as license from (select license, {form} as form from known_text) group by 1),
base as (select row_number() over () as uid, doc_id, {form} as form from documents),
whole as (select uid, doc_id, md5(trim(replace(form, chr(10), ' '), ' ')) as digest, form from base),
lines as (select uid, md5(trim(x, ' ')) as digest from (select uid, unnest(string_split(form, chr(10))) as x from whole)),
hits as (select uid, string_agg(distinct license, ',' order by license) as line_licenses, count(*) as n_lines from lines join known using (digest) group by uid)
select w.doc_id, w.digest, k.license, coalesce(h.line_licenses, '') as line_licenses, coalesce(h.n_lines, 0)::bigint as n_lines
from whole w left join known k using (digest) left join hits h using (uid)"""
