"""License scans by canonical digests. DataFrame functions only.

A text is normalised (case, punctuation, list marks, copyright lines, a title at its head, equivalent spellings,
white space and line ends) and its SHA-256 digest is joined to the digests of known licence texts; so is the digest of
each of its lines to those of known licence notices. Both sides go through the same column functions, so they agree by
construction, however a file is wrapped. What is known is a table: `builtin` has the short licences whose texts are
below, `from_files` reads a folder of licence files named by their ids, of any number.

Defined results: a null or empty text has the digest of the empty text and no licence; a text that is nothing but
copyright lines counts as empty, one that is nothing but a title keeps it; rows that repeat are scanned each; a null
doc_id is kept; a licence known under several ids gives the smallest; other columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm.common import stored

# Spellings that licence texts use alike, and public licence texts and notices by SPDX id.
SPELLINGS = (
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("acknowledgement", "acknowledgment"),
    ("merchantibility", "merchantability"),
    ("analyse", "analyze"),
    ("modelling", "modeling"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("fulfil ", "fulfill "),
    ("whilst", "while"),
    ("per cent", "percent"),
    ("https", "http"),
)

_NO_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE'
_DEALINGS = "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
    "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
    "from this software without specific prior written permission.\n"
)
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT '
    "NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL "
    "THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
    "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
LICENSE_TEXTS = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be "
        'included in all copies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY '
        "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
        "OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.\n" + _AS_IS
    ),
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _AS_IS,
    "BSD-2-Clause": _BSD_HEAD + _BSD_TAIL,
    "BSD-3-Clause": _BSD_HEAD + _BSD_THIRD + _BSD_TAIL,
    "MIT-0": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        f"is furnished to do so.\n{_NO_WARRANTY} AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
        f"ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, {_DEALINGS}"
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for "
        "any damages arising from the use of this software.\nPermission is granted to anyone to use this software for any purpose, "
        "including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n"
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use "
        "this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n"
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n"
        "3. This notice may not be removed or altered from any source distribution."
    ),
    "BSL-1.0": (
        "Boost Software License - Version 1.0 - August 17th, 2003\nPermission is hereby granted, free of charge, to any person or "
        "organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, "
        "reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to "
        "permit third-parties to whom the Software is furnished to do so, all subject to the following:\nThe copyright notices in the "
        "Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be "
        "included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or "
        "derivative works are solely in the form of machine-executable object code generated by a source language processor.\n"
        f"{_NO_WARRANTY}, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE "
        f"LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, {_DEALINGS}"
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.\nAnyone is free to copy, modify, publish, use, compile, "
        "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
        "non-commercial, and by any means.\nIn jurisdictions that recognize copyright laws, the author or authors of this software "
        "dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the "
        "public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of "
        "relinquishment in perpetuity of all present and future rights to this software under copyright law.\n"
        f"{_NO_WARRANTY} AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER "
        f"IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, {_DEALINGS}\nFor more information, please refer to <https://unlicense.org>"
    ),
    "WTFPL": (
        "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2, December 2004\nEveryone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed "
        "as long as the name is changed.\nDO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nTERMS AND CONDITIONS FOR COPYING, DISTRIBUTION "
        "AND MODIFICATION\n0. You just DO WHAT THE FUCK YOU WANT TO."
    ),
}
NOTICES = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License");', "SPDX-License-Identifier: Apache-2.0"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "BSD-3-Clause": ("Released under the BSD License.", "SPDX-License-Identifier: BSD-3-Clause"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"),
}
#: Titles that stand at the head of licence files, in their normalised form.
TITLES = (
    "mit", "mit license", "mit license mit", "the mit license", "the mit license mit", "mit no attribution", "isc license", "the isc license", "isc license isc",
    "bsd license", "bsd zero clause license", "zero clause bsd", "bsd 2 clause license", "bsd 3 clause license", "the 2 clause bsd license", "the 3 clause bsd license",
    "bsd 2 clause simplified license", "bsd 3 clause new or revised license", "zlib license", "the zlib license", "zlib license zlib", "the unlicense", "unlicense",
    "boost software license",
)
#: Words after "copyright" in the running text of licences, where a line may happen to begin with it.
RUNNING = ("notice", "notices", "holder", "holders", "owner", "owners", "law", "laws", "license", "licenses", "statement", "interest", "and", "or", "to", "in", "of")
# End of fixed values.

LIST_MARK = r"(^|\n)[ \t*#/;>-]*(?:\((?:[0-9]{1,2}|[abd-z])\)|[0-9]{1,2}[.)]|[a-z][.)])[ \t]+"
COPYRIGHT = "^(copyright( .*)?|c [12][0-9]{3}( .*)?|all rights reserved)$"
RUNS_ON = f"^copyright ({'|'.join(RUNNING)})( |$)"
#: Tables of known texts are sent to all tasks up to this many rows, larger ones are joined by a shuffle.
BROADCAST_ROWS = 100_000


def canonical_lines(text: Column) -> Column:
    """Normalised lines of a text, without list marks, blank lines and copyright lines."""
    unmarked = F.regexp_replace(F.lower(text), LIST_MARK, "$1")
    plain = F.regexp_replace(unmarked, r"[^\p{L}\p{N}\n]+", " ")
    lines = F.transform(F.split(plain, "\n"), lambda x: F.trim(x))
    return F.filter(lines, lambda x: (x != "") & ~(x.rlike(COPYRIGHT) & ~x.rlike(RUNS_ON)))


def spelled(text: Column) -> Column:
    for old, new in SPELLINGS:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def canonical_text(lines: Column) -> Column:
    """The lines as one text, without a title in the first two of them."""
    body = F.filter(lines, lambda x, i: ~((i < 2) & x.isin(*TITLES)))
    return spelled(F.array_join(F.when(F.size(body) > 0, body).otherwise(lines), " "))


def _digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def builtin(spark: SparkSession, texts: dict[str, list[str]]) -> DataFrame:
    """(license, text) of a fixed list of some dozens."""
    return spark.createDataFrame([(k, x) for k, own in texts.items() for x in own], "license string, text string")


def from_files(spark: SparkSession, folder: str) -> DataFrame:
    """(license, text) of a folder of licence files, each named by its licence."""
    read = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("name"), "value")
    return read.select(F.regexp_replace("name", r"\.[A-Za-z]+$", "").alias("license"), F.col("value").alias("text"))


def known(registry: DataFrame) -> DataFrame:
    """(digest, license) of known texts or notices (license, text)."""
    digest = _digest(canonical_text(canonical_lines(F.col("text"))))
    out = registry.groupBy(digest.alias("digest")).agg(F.min("license").alias("license"))
    return F.broadcast(out) if registry.count() <= BROADCAST_ROWS else out


def scan(docs: DataFrame, texts: DataFrame | None = None, notices: DataFrame | None = None) -> DataFrame:
    """(doc_id, digest, license, n_notices, notices) of every row; texts and notices: known ones (license, text).

    license: of which known licence the whole text is; n_notices, notices: lines that are a known notice, and
    the licences they name, sorted and joined by commas.
    """
    spark = docs.sparkSession
    whole = known(builtin(spark, {k: [v] for k, v in LICENSE_TEXTS.items()}) if texts is None else texts)
    named = known(builtin(spark, {k: list(v) for k, v in NOTICES.items()}) if notices is None else notices)
    lines = F.coalesce(canonical_lines(F.col("text")), F.array().cast("array<string>"))
    read = stored(
        docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", lines.alias("lines")).select(
            "row", "doc_id", _digest(canonical_text(F.col("lines"))).alias("digest"), F.transform("lines", lambda x: _digest(spelled(x))).alias("parts")
        ),
        "digests",
    )
    met = read.select("row", F.explode("parts").alias("digest")).join(named, "digest")
    counted = met.groupBy("row").agg(F.count(F.lit(1)).alias("n_notices"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"))
    return (
        read.select("row", "doc_id", "digest")
        .join(whole, "digest", "left")
        .join(counted, "row", "left")
        .select("doc_id", "digest", F.coalesce("license", F.lit("")).alias("license"), F.coalesce("n_notices", F.lit(0).cast("long")).alias("n_notices"), F.coalesce("notices", F.lit("")).alias("notices"))
    )


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql_lines(text: str) -> str:
    plain = f"regexp_replace(regexp_replace(lower({text}), '{LIST_MARK}', '\\1', 'g'), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"
    dropped = f"regexp_matches(x, '{COPYRIGHT}') AND NOT regexp_matches(x, '{RUNS_ON}')"
    return f"list_filter(list_transform(string_split({plain}, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT ({dropped}))"


def _sql_spelled(text: str) -> str:
    for old, new in SPELLINGS:
        text = f"replace({text}, '{old}', '{new}')"
    return text


def _sql_whole(lines: str) -> str:
    body = f"list_filter({lines}, lambda x, i: NOT (i <= 2 AND x IN ({', '.join(map(_sql_text, TITLES))})))"
    return _sql_spelled(f"array_to_string(CASE WHEN len({body}) > 0 THEN {body} ELSE {lines} END, ' ')")


def _sql_known(texts: dict[str, list[str]]) -> str:
    rows = ", ".join(f"({_sql_text(k)}, {_sql_text(x)})" for k, own in texts.items() for x in own)
    lines = f"SELECT k, {_sql_lines('t')} AS lines FROM (VALUES {rows}) v(k, t)"
    return f"SELECT sha256({_sql_whole('lines')}) AS digest, min(k) AS license FROM ({lines}) GROUP BY 1"


ORACLE_SQL = f"""
WITH whole AS ({_sql_known({k: [v] for k, v in LICENSE_TEXTS.items()})}),
named AS ({_sql_known({k: list(v) for k, v in NOTICES.items()})}),
e AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({_sql_lines("text")}, []::VARCHAR[]) AS lines FROM documents),
d AS (SELECT *, sha256({_sql_whole("lines")}) AS digest FROM e),
m AS (SELECT rid, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS names
      FROM (SELECT rid, unnest(list_transform(lines, lambda x: sha256({_sql_spelled('x')}))) AS digest FROM e) JOIN named USING (digest) GROUP BY rid)
SELECT doc_id, d.digest, coalesce(license, '') AS license,
  coalesce(n, 0)::BIGINT AS n_notices, coalesce(names, '') AS notices
FROM d LEFT JOIN whole ON whole.digest = d.digest LEFT JOIN m USING (rid)
"""
