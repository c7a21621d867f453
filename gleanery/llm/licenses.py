"""License scans: canonical digests of whole texts, joined with those of known licenses.  DataFrame functions only.

A text is brought to a canonical form: lines of copyright notices and lines that are a license's title go, case, punctuation and white space
no longer count, and words spelt in several ways are spelt in one.  Its SHA-256 is looked up among the digests of known licenses.
The texts looked up are the whole document, each of its blocks (what stands between blank lines), each line, and the runs
of blocks that have as many words as a known license of several paragraphs, wherever these are parted.  A run has the scope block and the position
of its first block.

A spelling replaces one word by one word.  So only texts with as many words as some known license are spelt, hashed
and looked up, which leaves out nothing.  The table of known digests is broadcast after a check of its size.

Special cases.  A null or empty text, or one without words, has no findings.  A document that is a single line is looked up once, as
a document; a block of one line as a line; a run of all blocks with words as the document.  Repeated rows give repeated findings, a null doc_id is carried along.  An empty
table gives none.  Known licenses with equal canonical forms are all found.  Columns other than doc_id and text are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gleanery.operators.skew import lookup_join

# Texts of common licenses and the usual statements of them, as published.
KNOWN = [
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("0BSD", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSL-1.0", 'Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-3.0-or-later", 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.\n\nYou should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC0-1.0", "This work is licensed under the Creative Commons CC0 1.0 Universal License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
]
_BSD = next(text for name, text in KNOWN if name == "BSD-2-Clause").split("\n\n")
#: Further whole texts, which the SQL doesn't know.
WHOLE = [
    ("BSD-3-Clause", "\n\n".join([
        *_BSD[:3], "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission.", *_BSD[3:]])),
]
# Words that license texts spell in more than one way.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact",
    "authorisation": "authorization", "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled",
    "capitalisations": "capitalizations", "catalogue": "catalog", "categorise": "categorize", "centre": "center",
    "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill",
    "fulfilment": "fulfillment", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling",
    "labour": "labor", "licence": "license", "licences": "licenses", "licenced": "licensed", "maximise": "maximize",
    "modelled": "modeled", "modelling": "modeling", "offence": "offense", "optimise": "optimize",
    "organisation": "organization", "organise": "organize", "practise": "practice", "programme": "program",
    "realise": "realize", "recognise": "recognize", "signalling": "signaling", "sublicence": "sublicense",
    "utilisation": "utilization", "whilst": "while", "wilful": "willful", "https": "http",
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line that names the holder of a copyright, or reserves the rights.
COPYRIGHT = r"(?:^|\n)[^0-9a-z\n]*(?:copyright (?:\(c\)|©|[0-9])|\(c\) |© ?[0-9a-z]|all rights reserved)[^\n]*"
#: A line that is a license's title.
TITLE = (r"(?:the )?(?:mit|expat|isc|zlib|zlib/libpng|(?:(?:new|modified|revised|simplified|original) )?bsd(?: zero)?(?:[ -][0-3])?(?:[ -]clause)?|"
         r"(?:[0-3]|two|three|zero)[ -]clause bsd|0bsd) licen[sc]e"
         r"(?: ?\((?:mit|expat|isc|zlib|0bsd|bsd[ -][0-3][ -]clause)\))?|boost software license - version 1\.0 - august 17th, 2003")
#: A line of either kind.  Titles stand alone.
HEADLINE = COPYRIGHT.removesuffix(r"[^\n]*").replace(r"(?:copyright", r"(?:(?:copyright") + rf"[^\n]*|(?:{TITLE})[^0-9a-z\n]*(?=\n|$))"
NO_WORD = r"[\x00-/:-`{-\x7F©“”‘’–—]+"
BLANK_LINE = r"\n[ \t\r]*\n\s*"


def plain(text: Column) -> Column:
    """Lower case, without lines of copyrights and titles, words parted by one blank."""
    lower = F.translate(text, UPPER, LOWER)
    return F.trim(F.regexp_replace(F.regexp_replace(lower, HEADLINE, "\n"), NO_WORD, " "))


def spelt(words: Column) -> Column:
    """Words with one spelling for each, parted by blanks."""
    table = F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")


def known_texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOWN + WHOLE, "license_id string, text string")


def digests(known: DataFrame) -> DataFrame:
    """license_id, words, digest and whether there are several paragraphs, of known texts."""
    words = F.split(plain(F.col("text")), " ")
    return known.select("license_id", F.size(words).alias("words"), F.sha2(spelt(words), 256).alias("digest"),
                        (F.size(F.split("text", BLANK_LINE)) > 1).alias("whole")).distinct()


def units(text: Column) -> Column:
    """The texts of a document to look up, each once: the document, blocks of several lines, lines."""
    def unit(scope: str, position: Column, body: Column) -> Column:
        return F.struct(F.lit(scope).alias("scope"), position.cast("long").alias("position"), body.alias("body"))

    blocks, lines = F.split(text, BLANK_LINE), F.split(text, "\n")
    parts = F.transform(blocks, lambda b, i: unit("block", i, b))
    return F.concat(
        F.array(unit("document", F.lit(0), text)),
        F.when(F.size(blocks) > 1, F.filter(parts, lambda u: F.contains(u["body"], F.lit("\n")))).otherwise(F.array().cast(
            "array<struct<scope:string,position:bigint,body:string>>")),
        F.when(F.size(lines) > 1, F.transform(lines, lambda x, i: unit("line", i, x))).otherwise(F.array().cast(
            "array<struct<scope:string,position:bigint,body:string>>")))


def runs(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """doc_id, scope, position and words of the runs of blocks with a number of words that is among ``sizes``.

    Two places in the running sums of words that differ by a size are the ends of a run, so no run but these is put together.
    """
    count = lambda x: F.when(x == "", 0).otherwise(F.size(F.split(x, " ")))
    sums = F.aggregate("blocks", F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + count(x))))
    place = lambda s: F.transform(
        F.array_intersect("sums", F.transform("sums", lambda c: c + s)),
        lambda end: F.struct((F.size("sums") - F.array_position(F.reverse("sums"), end - s)).cast("long").alias("first"),
                             (F.array_position("sums", end) - 1).alias("end")))
    found = (docs.where("text IS NOT NULL").select("doc_id", F.split("text", BLANK_LINE).alias("blocks")).where("size(blocks) > 1")
             .select("doc_id", F.transform("blocks", plain).alias("blocks")).withColumn("sums", sums)
             .select("doc_id", "blocks", "sums", F.explode(F.concat(*[place(s) for s in sizes])).alias("r")))
    part = F.filter(F.slice("blocks", (F.col("r.first") + 1).cast("int"), (F.col("r.end") - F.col("r.first")).cast("int")), lambda x: x != "")
    return (found.where("r.end - r.first > 1 AND NOT (sums[r.first] = 0 AND sums[r.end] = element_at(sums, -1))")
            .select("doc_id", F.lit("block").alias("scope"), F.col("r.first").alias("position"),
                    F.split(F.array_join(part, " "), " ").alias("words")))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Findings: doc_id, scope (document, block, line), position (number of the block or line), license_id."""
    table = digests(known)
    of = table.groupBy("words").agg(F.max("whole").alias("whole")).collect()  # bounded by the known licenses
    sizes, whole = [r["words"] for r in of], [r["words"] for r in of if r["whole"]]
    bodies = docs.where("text IS NOT NULL").select("doc_id", F.explode(units(F.col("text"))).alias("u"))
    words = bodies.select("doc_id", "u.scope", "u.position", F.split(plain(F.col("u.body")), " ").alias("words"))
    words = words.where(F.size("words").isin(sizes))
    if whole:
        words = words.unionByName(runs(docs, whole))
    hashed = words.select(
        "doc_id", "scope", "position", F.sha2(spelt(F.col("words")), 256).alias("digest"))
    return lookup_join(hashed, table.select("digest", "license_id").distinct(), ["digest"], "inner", ["doc_id", "position"]).select(
        "doc_id", "scope", "position", "license_id")


# The same rules for DuckDB.
def _sql_plain(text: str) -> str:
    copyright_line = COPYRIGHT.replace("'", "''")
    no_word = r"[\x00-/:-`{-\x7F©“”‘’–—]+"
    return (f"trim(regexp_replace(regexp_replace(translate({text}, '{UPPER}', '{LOWER}'), '{copyright_line}', "
            rf"chr(10), 'g'), '{no_word}', ' ', 'g'), ' ')")


def _sql_digest(text: str) -> str:
    pairs = ", ".join(f"'{a}': '{b}'" for a, b in SPELLINGS.items())
    return (f"sha256(array_to_string(list_transform(string_split({_sql_plain(text)}, ' '), "
            f"lambda w: coalesce(MAP {{{pairs}}}[w], w)), ' '))")


ORACLE = rf"""
WITH known AS (SELECT DISTINCT license_id, {_sql_digest('text')} AS digest FROM (VALUES
  {", ".join("('%s', '%s')" % (i, t.replace("'", "''")) for i, t in KNOWN)}) k(license_id, text)),
docs AS (SELECT doc_id, text, regexp_split_to_array(text, '{BLANK_LINE}') AS blocks,
  string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
units AS (
  SELECT doc_id, 'document' AS scope, 0::BIGINT AS position, text AS body FROM docs
  UNION ALL SELECT doc_id, 'block', i - 1, blocks[i] FROM (
    SELECT doc_id, blocks, unnest(range(1, len(blocks) + 1)) AS i FROM docs WHERE len(blocks) > 1) b
    WHERE contains(blocks[i], chr(10))
  UNION ALL SELECT doc_id, 'line', i - 1, lines[i] FROM (
    SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM docs WHERE len(lines) > 1) l)
SELECT doc_id, scope, position, license_id
FROM (SELECT doc_id, scope, position, {_sql_digest('body')} AS digest FROM units) u JOIN known USING (digest)
"""
