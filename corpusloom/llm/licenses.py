"""License scan: canonical digests of whole texts, joined to those of known licences.

The canonical form is made with SQL functions: lower case, equivalent spellings, no
title line, no copyright notices, punctuation and white space as one space each.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

# Equivalent spellings, as pairs of words.
SPELLINGS = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "analyse": "analyze",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "calibre": "caliber",
    "cancelled": "canceled",
    "capitalisations": "capitalizations",
    "catalogue": "catalog",
    "categorise": "categorize",
    "centre": "center",
    "copyright holder": "copyright owner",
    "copyright holders": "copyright owners",
    "emphasised": "emphasized",
    "favour": "favor",
    "favourite": "favorite",
    "fulfil": "fulfill",
    "fulfilment": "fulfillment",
    "http": "https",
    "initialise": "initialize",
    "judgement": "judgment",
    "labelling": "labeling",
    "labour": "labor",
    "licence": "license",
    "licenced": "licensed",
    "maximise": "maximize",
    "modelled": "modeled",
    "modelling": "modeling",
    "non commercial": "noncommercial",
    "offence": "offense",
    "optimise": "optimize",
    "organisation": "organization",
    "organise": "organize",
    "per cent": "percent",
    "practise": "practice",
    "programme": "program",
    "realise": "realize",
    "recognise": "recognize",
    "signalling": "signaling",
    "sub license": "sublicense",
    "utilisation": "utilization",
    "while": "whilst",
    "wilful": "willful",
}

# Texts of licences and of their notices, as their authors publish them.
KNOWN = {
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES
OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations
under the License.""",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "MIT-line": "Released under the MIT License.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use,
copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in
all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND
THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO
EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION
WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of
this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a
product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be
plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from
any source distribution.""",
}


# Whole texts, a file each.
KNOWN |= {path.stem: path.read_text("utf-8") for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}

#: a first line that names a licence, with a blank line and more text behind it
TITLE = r"\A[^\p{L}\p{N}]*(?!(?:licen[sc]ed|released|distributed|permission|this|under|you|all)\b)[^\n]{0,60}\blicen[sc]e\b[^\n]{0,30}\n[^\S\n]*\n(?=[\s\S]*[\p{L}\p{N}])"
#: lines of a copyright sign, of the word with a sign, a year or a place for one
NOTICE = r"(?m)^[^\n\p{L}\p{N}]*(?:©|\(c\)[^\n\p{L}\p{N}]*(?:19|20)\d\d|copyright[\t :]*(?:by[\t ]+)?(?:©|\(c\)|[<\[{]|(?:19|20)\d\d))[^\n]*$"
#: lines of the word and a name
HOLDER = r"(?m)^[^\n\p{L}\p{N}]*Copyright[\t :]+(?:by[\t ]+)?(?!(?:Holder|Owner|Licen[sc]e|Notice|Law|Act|Statement|Protection|Interest|Right)s?\b)\p{Lu}[^\n]{0,80}$"


def canonical(text: Column, title: str = TITLE) -> Column:
    """Lower case, no title line, no copyright notices, one space for each run of what is
    neither letter nor digit, spellings made equal; null becomes empty.

    A line that merely begins with ``copyright`` or ``(c)``, as wrapping leaves it, is no notice.
    """
    s = F.regexp_replace(F.coalesce(text, F.lit("")), HOLDER, " ")
    s = F.regexp_replace(F.lower(s), title, " ")
    s = F.regexp_replace(s, NOTICE, " ")
    s = F.regexp_replace(s, r"[^\p{L}\p{N}]+", " ")
    s = F.regexp_replace(s, r"\ball rights reserved\b ?", "")
    # one pass over the text finds the few that hold any such spelling at all
    replaced = s
    for a, b in SPELLINGS.items():
        replaced = F.regexp_replace(replaced, rf"\b{a}\b", b)
    s = F.when(s.rlike(r"\b(" + "|".join(SPELLINGS) + r")\b"), replaced).otherwise(s)
    return F.trim(s)


def variants(text: str) -> list[str]:
    """A text as it is, and without what follows its terms (how to apply them)."""
    return [text, *[text[: m.end()] for m in re.finditer("END OF TERMS AND CONDITIONS", text)], *[text[: m.start()] for m in re.finditer("END OF TERMS AND CONDITIONS", text)]]


def known_licenses(spark, texts: dict[str, str] = KNOWN) -> DataFrame:
    """license, digest of each known text and its variants, with and without a title (wrapping may join it to the text)."""
    known = spark.createDataFrame([(name, body) for name, text in sorted(texts.items()) for body in variants(text)], "license string, body string")
    forms = F.array(canonical(F.col("body")), canonical(F.col("body"), "(?!)"))
    known = known.select("license", F.explode(forms).alias("form")).select("license", F.sha2("form", 256).alias("digest"))
    return known.groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, canonical_digest, license of every whole text (null: no known one).

    Null and empty texts, and those of copyright lines alone, have the digest of the
    empty text and no licence. Repeated rows give repeated results. ``known`` has one
    row per digest; the documents' texts stay where they are, only ids and digests
    are joined (Spark broadcasts ``known`` while it is small).
    """
    digests = docs.select(F.col(id_col), F.sha2(canonical(text_of(text_col)), 256).alias("canonical_digest"))
    empty = F.sha2(F.lit(""), 256)
    found = digests.join(known.filter(F.col("digest") != empty), F.col("canonical_digest") == F.col("digest"), "left")
    return found.select(id_col, "canonical_digest", "license")


def license_lines(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same join for each line of a text: doc_id, line (from 0), license; for headers inside files."""
    lines = docs.select(F.col(id_col), F.posexplode(F.split(text_of(text_col), "\n")).alias("line", "body"))
    lines = lines.select(id_col, "line", F.sha2(canonical(F.col("body")), 256).alias("digest"))
    return lines.join(known.filter(F.col("digest") != F.sha2(F.lit(""), 256)), "digest").select(id_col, "line", "license")
