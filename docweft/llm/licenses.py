"""License scans by canonical digest lookup.

Texts are brought to one form (case, punctuation, white space, copyright lines, equivalent spellings) and the
digest of the whole form is looked up among those of known licence texts by a hash join. The lines and the blocks
(between blank lines) of a text are looked up as well, each as a whole, which finds notices and the paragraphs of
licences inside documents. Only texts with a line that begins like a known text are brought to that form at all.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.llm.shared import hint, small, written

#: First words of known texts that are compared as a literal list; more are joined.
KNOWN_WORDS = 1_000

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
#: Known licence texts and notices: identifier and text. Callers may give a table of their own instead.
KNOWN = (
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", _MIT),
    ("ISC", "ISC License\n\n" + _ISC),
    ("ISC", _ISC),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "MIT License"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("all-rights-reserved", "All rights reserved."),
)

_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_3 = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_BSL = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
#: Further whole texts, with and without their usual titles and bullets. The SQL, which does not have them, holds for tables without them.
WHOLE = (
    *(
        (license, title + rights + body)
        for license, name, text in (("BSD-2-Clause", "BSD 2-Clause License\n\n", _BSD_2 + _BSD_END), ("BSD-3-Clause", "BSD 3-Clause License\n\n", _BSD_2 + _BSD_3 + _BSD_END))
        for title in ("", name)
        for rights in ("", "All rights reserved.\n\n")
        for body in (text, text.replace("\n1. ", "\n* ").replace("\n2. ", "\n* ").replace("\n3. ", "\n* "))
    ),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n\n" + _ZLIB),
    ("BSL-1.0", _BSL),
    ("Unlicense", _UNLICENSE),
    ("Unlicense", _UNLICENSE.replace("https", "http")),
)

#: Further whole texts as published, by the digest of their canonical form alone: licence, first two words, digest. Fixed values.
DIGESTS = (
    ("Apache-2.0", "apache license", "1303e019ad72b71159c9c6876101f3f9dae6b740ed0796a6cc28e7c1a7993947"),
    ("Artistic-1.0-Perl", "the artistic", "fa46c0de183505429339202d8a072062d5bc31c34d11eec35c16b58ac689729a"),
    ("CC0-1.0", "creative commons", "97098b9d4d582064b16255ff38f4b45a41ecce484eb98a46cdb15423d6de9f85"),
    ("GFDL-1.2", "gnu free", "4f3ee1c1be015aff856b93ce653c3c303a70089b8fa4a5df4bb6de845b5b4a1e"),
    ("GFDL-1.3", "gnu free", "6114e20795948f0a37c6787b82086a421c231ab9030dd8f85af59433046cc9e6"),
    ("GPL-1.0", "gnu general", "dc4ab9dc141a33fdf0133134066fa6cddef1e5a0fb4b6d41c3c0d9fa2e388cd7"),
    ("GPL-2.0", "gnu general", "f8faccf9eef7b0b5c62695c676bc1b7556d8a6fe97832b3f28aad83367b8cf30"),
    ("GPL-3.0", "gnu general", "dbf741b057c23d9e057e116072d105f842362147650cf72186b48c8fa04e5227"),
    ("LGPL-2.0", "gnu library", "70dc5bd34d9c0f85aed03c8240a5a7e0d5d5a6df13a83b74ad79bf95835aa1a5"),
    ("LGPL-2.1", "gnu lesser", "42f2dfc2632e35f63a4ee4720f9ab729d4e3c537b1ad4398d58287c9bdef3fc3"),
    ("LGPL-3.0", "gnu lesser", "9111884d93a72b30a3d024876dab3d755949ac2cfab230268a4169a93b86560c"),
    ("MPL-1.1", "mozilla public", "e1b38bb0e1fd3841543468e03339cb990d99a5ffc785509c2a7d7e16c306894b"),
    ("MPL-2.0", "mozilla public", "cbb074dc9fcbd9c7502f3e0de87d8e6ef114d4764ef7b78d6693c9348c993f1b"),
)

#: Equivalent spellings, each of which is brought to the second form. The pairs of the public matching guidelines.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"),
    ("acknowledgements", "acknowledgments"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("artefacts", "artifacts"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("catalogue", "catalog"),
    ("centre", "center"),
    ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("modelled", "modeled"),
    ("modelling", "modeling"),
    ("offence", "offense"),
    ("per cent", "percent"),
    ("practise", "practice"),
    ("programme", "program"),
    ("signalling", "signaling"),
    ("sub license", "sublicense"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("non commercial", "noncommercial"),
    ("http", "https"),
)

#: Copyright lines; not lines of a wrapped text that go on after "copyright" with a notice, holders, laws and the like.
NOTICE = r"(?m)^[^\p{L}\p{N}\n]*(?:copyright(?!\s+(?:notices?|holders?|owners?|laws?|interests?|licen[cs]es?|statements?)\b)|\(c\)|©)[^\n]*$"
#: The same for the SQL, whose patterns cannot look ahead: lines that go on are marked, then every line that begins so is taken.
GOES_ON = r"(?m)^([^\p{L}\p{N}\n]*)copyright(\s+(?:notices?|holders?|owners?|laws?|interests?|licen[cs]es?|statements?)\b)"
COPYRIGHT = r"(?m)^[^\p{L}\p{N}\n]*(?:copyright|\(c\)|©)[^\n]*$"


def canonical(text: Column) -> Column:
    """The canonical form: lower case, no copyright lines, words with one space after each, one spelling.

    Spellings: the pairs of ``SPELLINGS``, licence and license, -ise and -ize, -our and -or are one each. The rules may
    join words that differ (rarely), which does no harm to the comparison of whole texts.
    """
    plain = F.regexp_replace(F.lower(text), NOTICE, "")
    return spelled(F.concat(F.lit(" "), F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "), F.lit(" ")))


def spelled(spaced: Column) -> Column:
    """Words with a space on both sides, in one spelling."""
    spaced = F.replace(spaced, F.lit("licenc"), F.lit("licens"))
    for variant, form in SPELLINGS:
        spaced = F.replace(spaced, F.lit(f" {variant} "), F.lit(f" {form} "))
    spaced = F.regexp_replace(spaced, r"([a-z]{3})is(e|es|ed|ing|ation|ations) ", "$1iz$2 ")
    return F.trim(F.regexp_replace(spaced, r"([a-z]{3})our(s|ed|able)? ", "$1or$2 "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def first_words(text: Column) -> Column:
    """The first two words of each line of a text (or its only one), as they are in the canonical form unless a spelling
    of two words begins there.

    Lines are cut first, so that the pattern ends at each line's second word and never runs over the whole text.
    """
    two = r"[\p{L}\p{N}]+(?:[^\p{L}\p{N}]+[\p{L}\p{N}]+)?"
    begin = lambda line: F.regexp_replace(F.lower(F.regexp_extract(line, two, 0)), r"[^\p{L}\p{N}]+", " ")
    return F.transform(F.array_distinct(F.transform(F.split(text, "\n", -1), begin)), lambda w: spelled(F.concat(F.lit(" "), w, F.lit(" "))))


def parts(text: str) -> list[str]:
    """The paragraphs of a known text that say enough to be known by: those of eight words and more."""
    return [p for p in re.split(r"\n\s*\n", text) if len(p.split()) >= 8]


def known_digests(spark: SparkSession, known: tuple[tuple[str, str], ...] = KNOWN + WHOLE, digests: tuple[tuple[str, str, str], ...] = DIGESTS) -> DataFrame:
    """``digest``, first two words (``word``), ``license`` and whether it is a ``whole`` text, of known texts and their paragraphs.

    Of several licences with one text the first counts.
    """
    texts = [(license, text, True) for license, text in known] + [(license, p, False) for license, text in known for p in parts(text) if p != text]
    rows = spark.createDataFrame(texts, "license string, known string, whole boolean")
    word = F.regexp_extract(canonical(F.col("known")), "^[^ ]*(?: [^ ]*)?", 0)
    rows = rows.select(digest(F.col("known")).alias("digest"), word.alias("word"), "license", "whole")
    if digests:
        rows = rows.unionByName(spark.createDataFrame([(d, w, x, True) for x, w, d in digests], "digest string, word string, license string, whole boolean"))
    return rows.groupBy("digest", "word").agg(F.min("license").alias("license"), F.max("whole").alias("whole"))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``doc_id``, the licence that the whole text is and its digest (else null), and the licences of its lines and blocks, comma-joined.

    Null and empty texts are no licence, for no empty text is known. Null ids and repeated rows are looked up like
    any other, equal texts under one id once; texts of any length are looked up whole; of several licences with one
    text the first in order counts. An empty table gives an empty result; further columns are ignored. Known
    digests and words are broadcast only up to a checked number; Spark shuffles them otherwise.
    """
    known = known_digests(docs.sparkSession) if known is None else known
    known = written(known.filter(F.col("digest") != F.sha2(F.lit(""), 256)), "known-licenses")
    # a line may end after its first word
    words = known.select(F.explode(F.array("word", F.substring_index("word", " ", 1))).alias("word")).distinct()
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if small(words, KNOWN_WORDS):
        listed = F.array(*[F.lit(r["word"]) for r in words.collect()]).cast("array<string>")
        likely = texts.filter(F.arrays_overlap(first_words(F.col("text")), listed))
    else:  # too many for a literal: texts are met with them by a join
        lines = texts.select("doc_id", "text", F.explode(first_words(F.col("text"))).alias("word"))
        likely = lines.join(hint(words), "word", "left_semi").select("doc_id", "text").distinct()
    # equal texts under one id are one key, looked up once
    likely = written(likely.withColumn("text_hash", F.xxhash64("text")), "license-texts")
    units = F.array_distinct(F.concat(F.split("text", "\n", -1), F.split("text", r"\n\s*\n", -1)))
    digests = hint(known.select("digest", "license", "whole"))
    units = likely.select("doc_id", "text_hash", F.explode(units).alias("unit")).select("doc_id", "text_hash", digest(F.col("unit")).alias("digest"))
    noticed = units.join(digests.drop("whole"), "digest").groupBy("doc_id", "text_hash").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"))
    whole = likely.select("doc_id", "text_hash", digest(F.col("text")).alias("digest")).join(digests.filter("whole").drop("whole"), "digest").distinct()
    key = [F.col("doc_id").eqNullSafe(F.col("found_id")), F.col("text_hash") == F.col("found_hash")]
    merged = noticed.withColumns({"digest": F.lit(None).cast("string"), "license": F.lit(None).cast("string")}).unionByName(whole.withColumn("notices", F.lit(None).cast("string")))
    found = merged.groupBy(F.col("doc_id").alias("found_id"), F.col("text_hash").alias("found_hash")).agg(F.max("digest").alias("digest"), F.max("license").alias("license"), F.max("notices").alias("notices"))
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    out = rows.join(hint(written(found, "licenses")), key[0] & key[1], "left")
    return out.select("doc_id", "digest", "license", F.coalesce("notices", F.lit("")).alias("notices"))


def _sql_digest(text: str) -> str:
    marked = f"regexp_replace(lower({text}), '{GOES_ON}', '\\1markedcopyright\\2', 'g')"
    plain = f"replace(regexp_replace({marked}, '{COPYRIGHT}', '', 'g'), 'markedcopyright', 'copyright')"
    spelled = f"replace(' ' || regexp_replace({plain}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' ', 'licenc', 'licens')"
    for variant, form in SPELLINGS:
        spelled = f"replace({spelled}, ' {variant} ', ' {form} ')"
    spelled = f"regexp_replace({spelled}, '([a-z]{{3}})is(e|es|ed|ing|ation|ations) ', '\\1iz\\2 ', 'g')"
    spelled = f"regexp_replace({spelled}, '([a-z]{{3}})our(s|ed|able)? ', '\\1or\\2 ', 'g')"
    return f"sha256(trim({spelled}))"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ORACLE_SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
given AS (SELECT license, {_sql_digest("known")} AS digest FROM (VALUES {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in KNOWN + WHOLE)}) AS v(license, known)
    UNION ALL SELECT * FROM (VALUES {", ".join(f"({_quoted(a)}, {_quoted(d)})" for a, _, d in DIGESTS)})),
known AS (SELECT digest, min(license) AS license FROM given GROUP BY 1),
paragraphs AS (SELECT license, {_sql_digest("known")} AS digest FROM (VALUES {", ".join(f"({_quoted(a)}, {_quoted(p)})" for a, b in KNOWN + WHOLE for p in parts(b))}) AS v(license, known)),
units AS (SELECT digest, min(license) AS license FROM (SELECT * FROM given UNION ALL SELECT * FROM paragraphs) GROUP BY 1),
lines AS (SELECT DISTINCT doc_id, {_sql_digest("unit")} AS digest FROM (SELECT doc_id, unnest(list_concat(string_split(text, chr(10)), string_split_regex(text, '\\n\\s*\\n'))) AS unit FROM texts)),
noticed AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM lines JOIN units USING (digest) GROUP BY doc_id)
SELECT t.doc_id, k.digest AS digest, k.license AS license, coalesce(n.notices, '') AS notices
FROM (SELECT doc_id, {_sql_digest("text")} AS digest FROM texts) AS t LEFT JOIN known AS k USING (digest) LEFT JOIN noticed AS n ON n.doc_id = t.doc_id
"""
