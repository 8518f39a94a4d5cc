"""License scan: canonical digests of whole texts, hash-joined to the digests of known licences.

A text is reduced to a canonical form (lower case, copyright lines dropped, equivalent spellings
united, punctuation and white space collapsed) and its SHA-256 is looked up. The same lookup runs
for each line of a document, so that one-line licence statements inside a document are found too.

Licence files are looked up a second time by their bare form, which is without the title lines at the
head and without lines of copyright signs as well. Of long licences only the digests of that form
are kept. The SQL twin knows the first lookup alone.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import ascii_lower, maybe_broadcast, table

# The texts of well-known licences and licence statements.
LICENSES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "MIT statement": "Released under the MIT License.",
    "Apache-2.0 statement": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 statement": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 statement": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 statement": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 statement": "Licensed under CC BY-SA 4.0.",
}

# Spellings that count as one.
SPELLINGS = (
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("non-infringement", "noninfringement"),
    ("acknowledgement", "acknowledgment"),
    ("per cent", "percent"),
    ("merchantibility", "merchantability"),
)

PUNCTUATION = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
COPYRIGHT_LINE = r"(?:^|\n)[^0-9a-z\n]*(?:copyright|all rights reserved)[^\n]*"

#: In the bare form: lines of copyright notices, but for lines of running text that begin with the word.
NOTICE_LINE = (
    r"(?:^|\n)[^0-9a-z\n]*(?:copyright(?![^0-9a-z\n]+(?:holders?|notices?|owners?|licenses?|laws?|interests?|disclaimers?|statements?|and|or|in|to|of|for|is|by)(?![0-9a-z]))"
    r"|all rights reserved|(?<=\()c\))[^\n]*"
)
#: In the bare form: lines of nothing but such words are titles as long as nothing else came before.
TITLE_WORDS = (
    "the|mit|x11|expat|isc|zlib|libpng|bsd|0bsd|freebsd|new|old|modified|simplified|revised|free|zero|two|three|clause|license|licenses|unlicense|spdx|identifier|only|later|or"
    "|apache|mozilla|mpl|gnu|gpl|lgpl|lesser|general|public|creative|commons|legal|code|cc0|universal|version|january|february|june|http|https|www|org|[0-9]{1,4}"
)
TITLE_LINE = rf"^[^0-9a-z]*(?:(?:{TITLE_WORDS})(?![0-9a-z])[^0-9a-z]*)*$"
TITLE_START = rf"^[^0-9a-z]*(?:{TITLE_WORDS})(?![0-9a-z])"
#: In the bare form: signs beyond ASCII that count as punctuation.
MARKS = "“”‘’«»–—•·\u00a0\ufeff"
#: In the bare form: whose name must not be used.
NO_ENDORSEMENT = r"neither the names? of .{1,200}? nor the names of (?:its|their|other|any) contributors"

_BSD3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
# Further licences whose files are known, by text.
FILES = {
    "BSD-3-Clause": LICENSES["BSD-2-Clause"].replace("\n\nTHIS SOFTWARE", f"\n\n3. {_BSD3}\n\nTHIS SOFTWARE"),
    "BSD-3-Clause ": LICENSES["BSD-2-Clause"].replace("1. ", "* ").replace("2. ", "* ").replace("\n\nTHIS SOFTWARE", f"\n\n* {_BSD3}\n\nTHIS SOFTWARE"),
    "BSD-2-Clause": LICENSES["BSD-2-Clause"].replace("1. ", "* ").replace("2. ", "* "),
}
# And by the SHA-256 of the bare form, of whole files and of those that end with the terms.
FILE_DIGESTS = {
    "Apache-2.0": (
        "d4de65168f36e340e0d3dbb116861d80743ee0da7d365d1ed5737589c0ec5c2d",
        "3ce0097e83262479e4b74a8c43922280adc582333303b93d56d7862aea8db4d6",
        "63b1f1e36f965b35947745318d4ccd719044935b11c9cf5a7ccd5f2273acdec4",
    ),
    "GPL-2.0": (
        "4767c85efb312bbe244abef9b752be38b44e810f05ed9bfae182caf068d13fd3",
        "a268f9c0a6d81f308a4286dac3b04b899da32e1ba02acf6eb78972ce623846e1",
        "8fa94d3d812775805528fff117ea835ed908322b039e129b957550c1e107d3e2",
    ),
    "GPL-3.0": (
        "372bf286f2094dcdafac7a8f210246612fb612cff76a4cc408ce9949090c2481",
        "eb6c5e8cbf9d16b49d6cc4ce73903a61612d1f2406f0620fc105ac15bfe6e3a8",
        "38e1da287a910dedf3f41aebb1b50dceabe7f4b57bab61c941324c85755d529b",
    ),
    "LGPL-2.1": (
        "ef3d0d39532ba7303ab8297b20fa80e792785ad15c3cc716bdf3517553fdea03",
        "c4d68ffa0fdfe604ca8bf594567e43e76d4b3a4379883463932a6014c51c4564",
        "58563a10655cb45bd992d37f43be3b1fce8b0f89483a4477329a240c90560e60",
    ),
    "LGPL-3.0": (
        "13980739d6423be0921994d8ce3ce547437735b0e6733161f70b19c962f194b7",
    ),
    "MPL-2.0": (
        "e07dcdcc3b2c19db7e604dfb1498cc5dafa0e9cecf6ffc44f7c2b093fe9bafc2",
        "fa31bb5fe4dacb07f1a4ad162be58edb552e9a96a500b68e081943eb2d3cfec5",
    ),
    "CC0-1.0": (
        "e3ba2aff64372f535373996fe68b166f9e97dc1ead5b471981213ebb8f310ad6",
    ),
    "Unlicense": (
        "7a4d92cdb11d254973a073803be1148a5402f1b2ca67808cdb3ef78b596102cd",
        "fd1b07be5f4f94926b6ea4df3943b05ab90c1a1f3b1a3d574ae7ab58bca58fff",
        "e6e60d2037efe58841d698b341a609d8a738effceaadb12ac721e54f8e0bf7db",
    ),
}



def spelled(text: Column) -> Column:
    """Lower case and one spelling; null is the empty text."""
    out = F.replace(ascii_lower(F.coalesce(text, F.lit(""))), F.lit("©"), F.lit("(c)"))
    for spelling, usual in SPELLINGS:
        out = F.replace(out, F.lit(spelling), F.lit(usual))
    return out


def canonical(text: Column) -> Column:
    """The canonical form of a spelled text: without copyright lines, punctuation and repeated spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, COPYRIGHT_LINE, "\n"), PUNCTUATION, " "))


def bare(text: Column) -> Column:
    """The canonical form of a spelled text without any notices of copyright, nor titles at its head."""
    lines = F.split(F.regexp_replace(text, NOTICE_LINE, "\n"), "\n")
    body = F.filter(F.transform(lines, lambda x, i: F.when(~x.rlike(TITLE_LINE), i + 1)), lambda i: i.isNotNull())
    body = F.array_join(F.slice(lines, F.coalesce(F.get(body, F.lit(0)), F.size(lines) + 1), F.size(lines)), "\n")
    body = F.regexp_replace(F.trim(F.regexp_replace(F.translate(body, MARKS, " " * len(MARKS)), PUNCTUATION, " ")), NO_ENDORSEMENT, "neither the name of the copyright holder nor the names of its contributors")
    body = F.replace(body, F.lit("copyright owner or contributors"), F.lit("copyright holder or contributors"))
    differs = text.rlike(TITLE_START) | text.contains("(c)") | text.contains("copyright") | text.contains("all rights reserved") | text.contains("neither the name") | text.rlike(f"[{MARKS}]")
    return F.when(differs, body)


def file_digests(spark: SparkSession, licenses: dict[str, str] = LICENSES) -> DataFrame:
    """(digest, license) of the bare forms of the known texts and of the licence files; of two with one form, the smaller name."""
    rows = spark.createDataFrame([*sorted(licenses.items()), *FILES.items()], "license string, text string").select(F.trim("license").alias("license"), spelled(F.col("text")).alias("text"))
    rows = rows.select(F.coalesce(bare(F.col("text")), canonical(F.col("text"))).alias("text"), "license").where("text <> ''").select(F.sha2("text", 256).alias("digest"), "license")
    rows = rows.union(spark.createDataFrame([(digest, name) for name, digests in FILE_DIGESTS.items() for digest in digests], "digest string, license string"))
    return rows.groupBy("digest").agg(F.min("license").alias("license"))


def known_digests(spark: SparkSession, licenses: dict[str, str] = LICENSES) -> DataFrame:
    """(digest, license, size) of the known texts; of two with one canonical form, the smaller name."""
    rows = spark.createDataFrame(sorted(licenses.items()), "license string, text string")
    rows = rows.select("license", canonical(spelled(F.col("text"))).alias("text")).where("text <> ''")
    return rows.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("license").alias("license"), F.max(F.length("text")).alias("size"))


def scan(documents: DataFrame, licenses: dict[str, str] = LICENSES) -> DataFrame:
    """(doc_id, digest, license, line_licenses) for every row of documents(doc_id, text).

    digest: of the whole text; license: the known licence with that digest, or else with that of the
    bare form, or null;
    line_licenses: known licences that are the whole of a line or of the text, sorted and
    comma-joined, or an empty string. A null text counts as empty and matches none; repeated rows
    are answered each; other columns are ignored; an empty table gives no rows. Only lines of a
    length that some known text has are hashed: no other can have its digest.
    """
    spark = documents.sparkSession
    known = known_digests(spark, licenses)
    sizes = known.select(F.array_sort(F.collect_set("size"))).first()[0]  # one number for each known length
    files = file_digests(spark, licenses).join(known.drop("size", "license"), "digest", "left_anti")
    known = known.drop("size").union(files.select("digest", "license"))
    rows = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", spelled(F.col("text")).alias("text"))
    rows = rows.select("row", "doc_id", F.sha2(canonical(F.col("text")), 256).alias("whole"), F.sha2(bare(F.col("text")), 256).alias("bare"), F.transform(F.split("text", "\n"), canonical).alias("lines"))
    lines = F.transform(F.filter("lines", lambda x: F.length(x).isin(sizes)), lambda x: F.sha2(x, 256))
    units = rows.select("row", "doc_id", "whole", "bare", F.explode(F.array_union(F.array_compact(F.array("whole", "bare")), lines)).alias("digest"))
    found = units.join(maybe_broadcast(known, 256), "digest", "left")
    of = lambda form: F.max(F.when(F.col("digest") == F.col(form), F.col("license")))
    return found.groupBy("row", "doc_id", F.col("whole").alias("digest_"), F.col("bare").alias("bare_")).agg(
        F.coalesce(of("whole"), of("bare")).alias("license"),
        F.array_join(F.sort_array(F.collect_set("license")), ",").alias("line_licenses"),
    ).select("doc_id", F.col("digest_").alias("digest"), "license", "line_licenses")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _spelled(text: str) -> str:
    out = f"replace(translate(coalesce({text}, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '©', '(c)')"
    for spelling, usual in SPELLINGS:
        out = f"replace({out}, '{spelling}', '{usual}')"
    return out


def _canonical(text: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({text}, '{COPYRIGHT_LINE}', chr(10), 'g'), '{PUNCTUATION}', ' ', 'g'), ' ')"


_KNOWN = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(LICENSES.items()))

ORACLE_SQL = f"""
WITH known AS (
  SELECT sha256({_canonical(_spelled("t"))}) AS digest, min(name) AS license FROM (VALUES {_KNOWN}) v(name, t) GROUP BY 1),
units AS (
  SELECT doc_id, sha256({_canonical("s")}) AS whole, string_split(s, chr(10)) AS lines FROM (SELECT doc_id, {_spelled("text")} AS s FROM documents)),
line_hits AS (
  SELECT u.doc_id, string_agg(DISTINCT k.license, ',' ORDER BY k.license) AS found
  FROM (SELECT doc_id, unnest(list_append(list_transform(lines, lambda x: sha256({_canonical("x")})), whole)) AS digest FROM units) u
  JOIN known k USING (digest) GROUP BY 1)
SELECT u.doc_id, u.whole AS digest, k.license, coalesce(h.found, '') AS line_licenses
FROM units u LEFT JOIN known k ON k.digest = u.whole LEFT JOIN line_hits h ON h.doc_id = u.doc_id
"""
