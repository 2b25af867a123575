"""License scans by canonical digest.

A text is made canonical: lower case; copyright lines, comment marks and punctuation dropped; equivalent spellings made one;
white space collapsed. So neither case nor wrapping, indentation or comment marks matter. The digest of the whole is hash-joined
with those of the known licences (document_license). Known texts and notices within a longer text are found in the same form:
the windows of its words are hash-joined with the first words of every known form, and where those are equal, the digest of as
many words as the form has is compared with the form's. A one-line SPDX tag names its licences itself.

What is known: the full texts in KNOWN; by digest alone, those in DIGESTS (long texts, which aren't carried here); the notices in
KNOWN; and the identifiers of all these in SPDX tags. Of the Creative Commons licences but CC0 only notices and tags are known.

The known forms are a literal table of a few dozen rows, so their broadcast has a proven bound. Only texts that hold one of the
words in HINT are made canonical; whatever equals or holds a known form has one, too. Ids and row hashes of what was found are
all that is shuffled, not texts.

Nulls, empty and repeated rows: null and blank texts match nothing; a null id is an id like others; rows are independent, so
repeated rows each get the same result; ids are listed once each, in order, so there are no ties; an empty table gives an
empty table; only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm.common import scratch

#: (pattern, replacement) in order, in the syntax common to Java and RE2; applied to lower-cased text with a line feed on either end.
REWRITES = (
    (r"\n[ \t#*/;%-]*(?:copyright[ \t]*(?:\(c\)|©|[0-9<\[{])|copyright[ \t]+by\b|\(c\)[ \t]*[0-9<\[{]|©)[^\n]*", "\n"),
    (r"\ball[ \t]+rights[ \t]+reserved\b", " "),
    (r"https?://", " "),
    (r"\blicen[cs](e|es|ed|ing|or|ee)\b", "licens$1"),
    (r"\bsub[^\p{L}\p{N}]*licen[cs](e|es|ed|ing)\b", "sublicens$1"),
    (r"\borganisation", "organization"),
    (r"\backnowledgement", "acknowledgment"),
    (r"\bfavour", "favor"),
    (r"\b(?:version|ver\.?|v\.?) ?([0-9])", "version $1"),
    (r"\bnon[^\p{L}\p{N}]*infringement", "noninfringement"),
    (r"\bmerchantibility", "merchantability"),
    (r"[^\p{L}\p{N}]+", " "),
)

HINT = "licen|permission|redistribution"
#: Words of a form by which it is looked up.
ANCHOR = 12
TAG = r"(?im)^[ \t#*/;%<!-]*SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+() -]+)"

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, '
    "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_TWO = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n"
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
)

_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\n"
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n"
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n"
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n"
    "3. This notice may not be removed or altered from any source distribution.\n"
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain.\n\n"
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\n"
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
    "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\n"
    "For more information, please refer to <https://unlicense.org>"
)
_BOOST = (
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, "
    "and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\n"
    "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, "
    "unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_TEXT = _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_PLAIN = lambda text: re.sub(r"(?m)^[123]\.", "*", text)  # noqa: E731  # with bullets for numbers
_APACHE_NOTICE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
    "See the License for the specific language governing permissions and limitations under the License."
)
_GPL_NOTICE = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. "
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details."
)

#: Fixed values: (SPDX id, text). A title before a text is a form of its own; a shorter form within a longer one ends where it does and counts once.
KNOWN = (
    ("MIT", _MIT + _WARRANTY),
    ("MIT", "MIT License\n" + _MIT + _WARRANTY),
    ("MIT", "The MIT License (MIT)\n" + _MIT + _WARRANTY),
    ("ISC", _ISC_TEXT),
    ("ISC", "ISC License\n" + _ISC_TEXT),
    ("0BSD", _ISC_GRANT + ".\n" + _ISC),
    ("0BSD", "BSD Zero Clause License\n" + _ISC_GRANT + ".\n" + _ISC),
    ("BSD-2-Clause", _BSD_TWO + _BSD),
    ("BSD-2-Clause", _PLAIN(_BSD_TWO) + _BSD),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD_TWO + _BSD),
    ("BSD-3-Clause", _BSD_TWO + _BSD_THIRD + _BSD),
    ("BSD-3-Clause", _PLAIN(_BSD_TWO + _BSD_THIRD) + _BSD),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD_TWO + _BSD_THIRD + _BSD),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n" + _ZLIB),
    ("Unlicense", _UNLICENSE),
    ("BSL-1.0", _BOOST),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n" + _BOOST),
    ("Apache-2.0", _APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Released under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0"),
    ("CC-BY-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("GPL-3.0", "licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "licensed under the GNU General Public License, version 2"),
    ("LGPL-2.1", "licensed under the GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "licensed under the GNU Affero General Public License, version 3"),
    ("GPL-3.0", _GPL_NOTICE.format("", "3")),
    ("GPL-2.0", _GPL_NOTICE.format("", "2")),
    ("LGPL-3.0", _GPL_NOTICE.format("Lesser ", "3")),
    ("LGPL-2.1", _GPL_NOTICE.format("Lesser ", "2.1")),
    ("AGPL-3.0", _GPL_NOTICE.format("Affero ", "3")),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Unlicense", "Released under the Unlicense"),
)

#: The SHA-256 of repr(REWRITES) that DIGESTS were made with: whoever changes a rule has to make them anew. tests/llm hold it.
DIGESTS_MADE_WITH = "da4193db9b97aab8d03d1b9718c0714b461d949f7854e8e3bd42d35c9ce08878"

#: Fixed values: (SPDX id, first ANCHOR words, words, md5) of the canonical forms of full texts as their stewards publish them;
#: where a text ends in instructions for its use, a second form ends before them.
DIGESTS = (
    ("Apache-2.0", "apache license version 2 0 january 2004 www apache org licenses terms", 1599, "8aa7a68b529e722ec595b75840c4dae5"),
    ("Apache-2.0", "apache license version 2 0 january 2004 www apache org licenses terms", 1429, "e24e8d30c8c1664b45d3db5af77feef6"),
    ("CC0-1.0", "creative commons legal code cc0 1 0 universal creative commons corporation is", 1087, "d2a76f70ce19809695b7fb93c6241c23"),
    ("GFDL-1.2", "gnu free documentation license version 1 2 november 2002 51 franklin st", 3314, "74828eb3d31c08c255ba36dd3703facb"),
    ("GFDL-1.3", "gnu free documentation license version 1 3 3 november 2008 fsf org", 3730, "11d096827dde1bd44fb3534292b98c8c"),
    ("GPL-1.0", "gnu general public license version 1 february 1989 51 franklin st fifth", 2067, "738cc3b112640d95d4cd79a58967ecea"),
    ("GPL-1.0", "gnu general public license version 1 february 1989 51 franklin st fifth", 1641, "dbf3c47f5a8f127e58d08cabc1ebb916"),
    ("GPL-2.0", "gnu general public license version 2 june 1991 51 franklin street fifth", 2975, "5e39ace6e62f5a7fe9c17b4da986ad8c"),
    ("GPL-2.0", "gnu general public license version 2 june 1991 51 franklin street fifth", 2504, "68380dbeadb093b94ecf563db7312db7"),
    ("GPL-3.0", "gnu general public license version 3 29 june 2007 everyone is permitted", 5681, "f680c5f384dd9420a1ed573206b9d4cb"),
    ("GPL-3.0", "gnu general public license version 3 29 june 2007 everyone is permitted", 5241, "444f95dc767ede978b60cfb20fbd0bca"),
    ("LGPL-2.0", "gnu library general public license version 2 june 1991 51 franklin street", 4200, "74cf7fcef3b29a39165a795b2cad3a3a"),
    ("LGPL-2.0", "gnu library general public license version 2 june 1991 51 franklin street", 3865, "c396ba2f94537628797123bc12cd2d6e"),
    ("LGPL-2.1", "gnu lesser general public license version 2 1 february 1999 51 franklin", 4401, "f998bc436710cfece156aaa84fd26dd4"),
    ("LGPL-2.1", "gnu lesser general public license version 2 1 february 1999 51 franklin", 4065, "3054b3781b1af43f906dc753acad15ee"),
    ("LGPL-3.0", "gnu lesser general public license version 3 29 june 2007 everyone is", 1231, "b31b7335bc37919e8cdd79154e04d88d"),
    ("MPL-1.1", "mozilla public license version 1 1 1 definitions 1 0 1 commercial", 3785, "af41bbe194b9033afd86aa35237d940e"),
    ("MPL-2.0", "mozilla public license version 2 0 1 definitions 1 1 contributor means", 2425, "adbe81b1d33aea9e0e9ebc9d9f282e72"),
    ("Artistic-1.0-Perl", "the artistic license preamble the intent of this document is to state", 983, "a8b0fb0c6e43a3b36bdc159e59dbfd1e"),
)


def canonical(text: Column) -> Column:
    between = F.concat(F.lit("\n"), F.lower(text), F.lit("\n"))
    return F.trim(reduce(lambda t, r: F.regexp_replace(t, *r), REWRITES, between))


def _key(words: Column, first, length: int) -> Column:
    return F.xxhash64(F.lit(length), *(F.get(words, first + i) for i in range(length)))


def known(spark: SparkSession, forms: tuple = KNOWN, digests: tuple = DIGESTS) -> DataFrame:
    """license_id, n_words, n_first, key (of the first n_first words) and digest (of all) of the known forms, once each."""
    rows = [F.struct(F.lit(i).alias("license_id"), F.lit(t).alias("text"), F.lit(None).cast("int").alias("n_words"), F.lit(None).cast("string").alias("digest")) for i, t in forms]
    rows += [F.struct(F.lit(i).alias("license_id"), F.lit(t).alias("text"), F.lit(n).alias("n_words"), F.lit(d).alias("digest")) for i, t, n, d in digests]
    if not rows:
        return spark.createDataFrame([], "license_id string, n_words int, n_first int, key long, digest string")
    listed = spark.range(1).select(F.inline(F.array(*rows))).withColumn("form", canonical(F.col("text"))).withColumn("words", F.split("form", " ", -1))
    listed = listed.withColumn("n_words", F.coalesce("n_words", F.size("words"))).withColumn("n_first", F.least(F.size("words"), F.lit(ANCHOR)))
    key = reduce(lambda e, n: F.when(F.col("n_first") == n, _key(F.col("words"), F.lit(0), n)).otherwise(e), range(1, ANCHOR + 1), F.lit(None).cast("long"))
    return listed.filter("form <> ''").select("license_id", "n_words", "n_first", key.alias("key"), F.coalesce("digest", F.md5(F.col("form").cast("binary"))).alias("digest")).distinct()


def spans(hinted: DataFrame, forms: DataFrame, lengths: list[int]) -> DataFrame:
    """doc_id, row_hash, license_id and end (in canonical words) of every known form within the texts of hinted (doc_id, row_hash, words)."""
    # the outer form: else a filter on the words is inferred and pushed down, and makes them again
    at = hinted.withColumn("at", F.explode_outer(F.when(F.size("words") > 0, F.sequence(F.lit(0), F.size("words") - 1))))
    each = F.concat(*(F.when(F.col("at") + n <= F.size("words"), F.array(_key(F.col("words"), F.col("at"), n))).otherwise(F.expr("cast(array() as array<bigint>)")) for n in lengths))
    near = at.select("doc_id", "row_hash", "words", "at", F.explode(each).alias("key")).join(F.broadcast(forms), "key")
    said = F.md5(F.array_join(F.slice("words", F.col("at") + 1, F.col("n_words")), " ").cast("binary"))
    return near.filter(F.col("at") + F.col("n_words") <= F.size("words")).filter(said == F.col("digest")).select("doc_id", "row_hash", "license_id", (F.col("at") + F.col("n_words")).alias("end")).distinct()


def scan(docs: DataFrame, forms: tuple = KNOWN, digests: tuple = DIGESTS) -> DataFrame:
    """doc_id, document_license (of the whole text, or null), n_notices and notices (ids, ascending, joined by commas; or null) of every row.

    n_notices counts the ends of known forms, by licence, and the known identifiers in SPDX tags.
    """
    spark = docs.sparkSession
    names = sorted({i for i, *_ in (*forms, *digests)})
    table_ = scratch(known(spark, forms, digests), "known")
    lengths = sorted(r["n_first"] for r in table_.select("n_first").distinct().collect())  # at most ANCHOR values
    hinted = all(re.search(HINT, t.lower()) for _, t, *_ in forms)
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(F.lit("row"), text).alias("row_hash"))
    maybe = F.lower("text").rlike(HINT) if hinted else F.col("text").isNotNull()
    words = F.split(canonical(F.col("text")), " ", -1)
    chosen = rows.filter(maybe)
    tags = F.flatten(F.transform(F.regexp_extract_all("text", F.lit(TAG), F.lit(1)), lambda x: F.split(x, r"\s+(?:[Oo][Rr]|[Aa][Nn][Dd]|[Ww][Ii][Tt][Hh])\s+|[()\s]+", -1)))
    plain = F.transform(tags, lambda x: F.regexp_replace(x, "(-only|-or-later|[+])$", ""))
    tagged = chosen.select("doc_id", "row_hash", F.posexplode(F.filter(plain, lambda x: x.isin(names) if names else F.lit(False))).alias("nth", "license_id")).select("doc_id", "row_hash", "license_id", (-1 - F.col("nth")).alias("end")).distinct()
    found = tagged
    if lengths:
        found = found.unionByName(spans(chosen.select("doc_id", "row_hash", words.alias("words")), table_, lengths))
    held = found.groupBy(F.col("doc_id").alias("__id"), F.col("row_hash").alias("__hash")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("notices"))
    whole = table_.groupBy("digest").agg(F.min("license_id").alias("document_license"))
    digest = F.when(maybe, F.md5(canonical(F.col("text")).cast("binary")))
    out = rows.select("doc_id", "row_hash", digest.alias("digest")).join(F.broadcast(whole), "digest", "left")
    out = out.join(held, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("row_hash") == F.col("__hash")), "left")
    return out.select("doc_id", "document_license", F.coalesce("n", F.lit(0)).cast("long").alias("n_notices"), "notices")
