"""License scans by canonical digests: texts are brought to one spelling and hash-joined to known licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import whole_text

# Licence texts and the usual one-line notices, as their authors publish them.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZERO_BSD = ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD_3 = BSD_2.replace("\n\nTHIS SOFTWARE", "\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE")
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
TEXTS: list[tuple[str, str]] = [
    ("MIT", MIT), ("MIT", "MIT License\n\n" + MIT), ("MIT", "The MIT License (MIT)\n\n" + MIT),
    ("ISC", ISC), ("ISC", "ISC License\n\n" + ISC), ("0BSD", ZERO_BSD), ("0BSD", "BSD Zero Clause License\n\n" + ZERO_BSD),
    ("BSD-2-Clause", BSD_2), ("BSD-2-Clause", "BSD 2-Clause License\n\n" + BSD_2), ("BSD-3-Clause", BSD_3), ("BSD-3-Clause", "BSD 3-Clause License\n\n" + BSD_3),
    ("Zlib", ZLIB), ("Zlib", "zlib License\n\n" + ZLIB),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");"), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Licensed under the GNU General Public License, version 3."), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."), ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."), ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."), ("CC0-1.0", "Licensed under CC0 1.0."),
]
#: Spellings that mean the same, replaced in this order after lower-casing.
SPELLINGS: list[tuple[str, str]] = [
    ("licence", "license"), ("licencing", "licensing"), ("sub-license", "sublicense"), ("non-commercial", "noncommercial"), ("non-infringement", "noninfringement"),
    ("acknowledgement", "acknowledgment"), ("organisation", "organization"), ("fulfilment", "fulfillment"), ("favour", "favor"), ("copyright owner", "copyright holder"),
    ("per cent", "percent"), ("http://", "https://"), ("version 2.0", "version 2"), ("version 3.0", "version 3"), ("creative commons", "cc"),
]
#: Lines of a wrapped licence sentence that happen to begin like a copyright line; they are marked with KEEP and stay.
SENTENCE = r"(^|\n)[^a-z0-9\n]*(copyright[ \t]+(notice|holder|owner|law|licen|statement|interest|and|or|in|is|of|on|to|for|as)([^a-z]|[a-z]*[^a-z]))"
KEEP = "\x01"
#: A line that says who holds the copyright, with or without a year or a sign, or that all rights are reserved.
COPYRIGHT = r"(^|\n)[^a-z0-9\n\x01]*((portions[ \t]+)?(copyright|copr\.)([^a-z\n][^\n]*)?|(©|\(c\))[^\n]*|all rights reserved\.?[^a-z0-9\n]*)"
PARAGRAPH = r"\n[ \t\r]*\n"
#: Paragraphs of a known text that a longer document may hold one after the other.
RUNS = range(2, 7)


def canonical(text: Column) -> Column:
    """One spelling of a text: lower case, without copyright lines, equivalent spellings, letters and digits only.

    A line that begins with "copyright", "portions copyright", "(c)" or the sign goes whatever follows, but for the words of
    SENTENCE: there it is a wrapped line of a licence.
    """
    out = F.regexp_replace(F.regexp_replace(F.lower(text), SENTENCE, f"$1{KEEP}$2"), COPYRIGHT, "$1")
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def runs(text: Column) -> Column:
    """Digests of the runs of two to six paragraphs of a text, from those of its paragraphs; paragraphs without a word, such as
    copyright lines, do not count.
    """
    marks = F.filter(F.transform(F.split(text, PARAGRAPH), digest), lambda d: d != F.sha2(F.lit("").cast("binary"), 256))
    of = lambda n: F.when(F.size(marks) >= n, F.transform(F.sequence(F.lit(1), F.size(marks) - n + 1), lambda i: F.sha2(F.array_join(F.slice(marks, i, n), "").cast("binary"), 256)))
    return F.array_distinct(F.concat(*[F.coalesce(of(n), F.array().cast("array<string>")) for n in RUNS]))


def known(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license_id) of known texts and of them as runs of paragraphs; of two licences with one digest the first by name
    stays.
    """
    rows = spark.createDataFrame([(n, t) for n, t in (TEXTS if texts is None else texts)], "license_id string, text string")
    # The run of all paragraphs of a text is the last of its runs.
    whole = rows.select(digest(F.col("text")).alias("digest"), "license_id")
    parts = rows.where(F.size(runs(F.col("text"))) > 0).select(F.element_at(runs(F.col("text")), -1).alias("digest"), "license_id")
    return whole.unionByName(parts).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scanned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", catalog: DataFrame | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, digest, license_id, n_notices, notices.

    digest is the canonical digest of the whole text, license_id the known text it equals (null: none). Every line and every
    paragraph that speaks of a licence, copyright or permission is a text of its own as well: notices names the licences
    these equal, sorted and joined by commas, n_notices counts them. In a document that is no known text itself, runs of two
    to six paragraphs that are a known text are notices too; known texts of more paragraphs are found as whole texts only. A catalogue of your own (digest, license_id) should
    keep to texts with one of these words. Null and empty texts have the digest of empty text and no notices; repeated rows
    are kept; an empty table gives no rows; other columns of ``docs`` are not read. Only built-in functions run.

    Lookups of parts are hash joins on the digest of distinct (text digest, part digest), so copies of a document or of a
    line are looked up once. No text is shuffled.
    """
    catalog = known(docs.sparkSession) if catalog is None else catalog
    rows = docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text")).withColumn("digest", digest(F.col("text")))
    low = F.lower("text")
    speaks = low.contains("licen") | low.contains("permi") | low.contains("copyright")
    spoken = rows.where(speaks)
    parts = spoken.select(F.sha2(F.col("text").cast("binary"), 256).alias("whole"), F.explode(F.array_distinct(F.concat(F.split("text", r"\n"), F.split("text", PARAGRAPH)))).alias("part"))
    part = F.lower("part")
    parts = parts.where(part.contains("licen") | part.contains("permi") | part.contains("copyright")).select("whole", digest(F.col("part")).alias("digest"), F.lit(False).alias("run"))
    texts = spoken.select(F.sha2(F.col("text").cast("binary"), 256).alias("whole"), F.explode(runs(F.col("text"))).alias("digest"), F.lit(True).alias("run"))
    parts = parts.unionByName(texts).distinct()
    found = parts.join(catalog, "digest").groupBy("whole").agg(F.collect_set(F.when(~F.col("run"), F.col("license_id"))).alias("single"), F.collect_set("license_id").alias("every"))
    named = rows.select("doc_id", "digest", F.sha2(F.col("text").cast("binary"), 256).alias("whole")).join(catalog, "digest", "left").join(found, "whole", "left")
    named = named.withColumn("notices", F.sort_array(F.when(F.col("license_id").isNull(), F.col("every")).otherwise(F.col("single"))))
    return named.select("doc_id", "digest", "license_id", F.coalesce(F.size("notices"), F.lit(0)).cast("long").alias("n_notices"), F.array_join(F.coalesce("notices", F.array().cast("array<string>")), ",").alias("notices"))
