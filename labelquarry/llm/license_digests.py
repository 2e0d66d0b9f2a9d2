"""Licence scan by canonical digests, with DataFrame and SQL functions only.

A text is brought to a canonical form: capitals lowered, lines with copyright notices removed, punctuation and blanks made single
blanks, equivalent spellings made one. The SHA-256 of the form is joined to the digests of known licences,
so only whole texts count, with or without a usual heading. Where lines break makes no difference: a line of a licence that happens to
begin with the word copyright is no notice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelquarry.llm.common import free_name

# Spellings that count as equal (the first becomes the second).
SPELLINGS = [
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"), ("capitalisations", "capitalizations"), ("catalogue", "catalog"),
    ("categorise", "categorize"), ("centre", "center"), ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"),
    ("licences", "licenses"), ("maximise", "maximize"), ("modelled", "modeled"), ("modelling", "modeling"), ("offence", "offense"), ("optimise", "optimize"),
    ("organisation", "organization"), ("organise", "organize"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"),
    ("recognise", "recognize"), ("signalling", "signaling"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"), ("noncommercial", "non commercial"),
    ("sublicence", "sublicense"), ("https", "http"),
]

# Texts of short public licences. Of longer ones the digests are below, others come from a table of the caller.
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
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    # Single sentences that stand for a licence.
    "MIT-notice": "Released under the MIT License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "Apache-2.0-short-notice": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
}

# Headings that may stand before a text.
HEADINGS = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "Zero Clause BSD License", "BSD Zero Clause License (0BSD)"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License", "The 2-Clause BSD License", "Simplified BSD License"],
    "Zlib": ["zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"],
}

# Digests of the canonical forms of whole public licences, made by digests() from the copies that Debian
# ships in /usr/share/common-licenses.
DIGESTS: dict[str, str] = {
    "Apache-2.0": "95f35d79ea3bab75c250549d6a03cef242e0547d78c99e26fcede49936fb0184",
    "Artistic-1.0-Perl": "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702",
    "BSD-3-Clause-University": "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651",
    "CC0-1.0": "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    "GFDL-1.2": "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60",
    "GFDL-1.3": "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826",
    "GPL-1.0": "ec8a6b7d70e9f225b63d3962ed5b4721373f5535d7b967a06722b0d621f6892a",
    "GPL-2.0": "331b500eb3c5ee796906547305df82fff4a35b3aa03c1d3ea84d32078292b2e6",
    "GPL-3.0": "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a",
    "LGPL-2.0": "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908",
    "LGPL-2.1": "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891",
    "LGPL-3.0": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-1.1": "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6",
    "MPL-2.0": "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a",
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A notice names a sign, a year or a holder. These words after "copyright" do not begin a holder's name.
_NO_HOLDER = (
    "notices?|holders?|owners?|ownership|laws?|licen[cs]es?|licen[cs]ing|statements?|permissions?|interests?|infringements?|protections?|treaty|treaties|doctrines?|rights?|act|acts|"
    "claims?|status|works?|material|materials|management|disclaimers?|date|dates|year|years|line|lines|header|headers|file|files|information|policy|term|terms|"
    "and|or|in|on|to|is|are|was|as|of|for|from|under|over|that|which|with|within|without|if|it|its|this|these|those|but|nor|not|may|can|shall|will|must|does|do|has|have|at|than|when|where|any|all|such|the"
)
# Words that end a holder's name with an article, as in "the … authors".
_HOLDERS = "authors?|contributors?|developers?|maintainers?|team|project|foundation|committers?"
_NOTICE = (
    r"\n[^a-z0-9\n]*((portions[ \t]+)?((copyright|\(c\)|\x{a9})[^a-z0-9\n]*(\(c\)|\x{a9}|[0-9]{4}|copyright\b)|\x{a9}|\(c\)[^\n]*\b(19|20)[0-9]{2}\b"
    r"|copyright[ \t:]+(by[ \t]+)?(?!(" + _NO_HOLDER + r")(?![a-z0-9]))[a-z0-9\x{80}-\x{10ffff}]"
    r"|copyright[ \t:]+(by[ \t]+)?the[ \t][^\n]*\b(" + _HOLDERS + r")[^a-z0-9\n]*(?=\n|\z))|all rights reserved|spdx-license-identifier:)[^\n]*"
)
_MARKS = r"[\x00-\x2f\x3a-\x60\x7b-\x7f\x{a0}\x{a9}\x{2010}-\x{2015}\x{2018}-\x{201f}\x{2026}]+"


def canonical_sql(text: str, raw: str = "r", everywhere: str = "", without_notices: str | None = None) -> str:
    """The canonical form as a SQL expression. ``raw``: what comes before literals with backslashes; ``everywhere``: a last
    argument that makes regexp_replace replace all places. Spark needs the former only, DuckDB the latter.
    ``without_notices``: another expression for the lowered text without notices, after a line feed."""
    lowered = f"translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}')"
    unmarked = without_notices or f"regexp_replace(concat(chr(10), {lowered}), {raw}'{_NOTICE}', ''{everywhere})"
    form = f"concat('  ', replace(regexp_replace({unmarked}, {raw}'{_MARKS}', ' '{everywhere}), ' ', '  '), '  ')"
    for one, other in SPELLINGS:
        form = f"replace({form}, ' {one} ', ' {other} ')"
    return f"trim(regexp_replace({form}, ' +', ' '{everywhere}))"


def digests(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the SHA-256 of the canonical form of ``text``."""
    return df.withColumn(out, F.sha2(F.expr(canonical_sql(f"`{text}`")), 256))


def known_licenses(spark: SparkSession, more: DataFrame | None = None) -> DataFrame:
    """(digest, license_id) of the texts of :data:`LICENSES`, with and without headings, and of :data:`DIGESTS`; ``more`` adds rows (license_id, text). Of licences with equal forms the smallest id counts; texts without words are left out."""
    headed = [(name, f"{line}\n\n{LICENSES[name]}") for name, lines in HEADINGS.items() for line in lines]
    rows = spark.createDataFrame(sorted(LICENSES.items()) + headed, "license_id string, text string")
    if more is not None:
        rows = rows.unionByName(more.select("license_id", "text"))
    empty = F.sha2(F.lit(""), 256)
    whole = spark.createDataFrame([(d, name) for name, d in sorted(DIGESTS.items())], "digest string, license_id string")
    made = digests(rows, "text", "digest").select("digest", "license_id").unionByName(whole)
    return made.filter(F.col("digest") != empty).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def find_licenses(docs: DataFrame, known: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``canonical_sha256``, ``license_id`` (null if the whole text is no known licence) and ``is_license``.

    Null and blank texts have the digest of the empty form, which no licence has. Rows are never dropped or
    doubled, whatever their ids. Input columns with the names of results are replaced.
    """
    made = {"canonical_sha256", "license_id", "is_license"}
    stay = [c for c in docs.columns if c.lower() not in made]
    digest = free_name(docs, "_digest")
    frame = digests(docs.select(*[F.col(f"`{c}`") for c in stay]), text, "canonical_sha256")
    table = known.select(F.col("digest").alias(digest), "license_id")
    joined = frame.join(table, F.col("canonical_sha256") == F.col(digest), "left")
    return joined.select(*[F.col(f"`{c}`") for c in stay], "canonical_sha256", "license_id", F.col("license_id").isNotNull().alias("is_license"))


def duckdb_sql() -> str:
    """Says line by line what a notice is, without look-ahead."""
    lowered = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
    lead, holder = r"^[^a-z0-9\n]*", r"(portions[ \t]+)?copyright[ \t:]+"
    rules = [
        lead + r"(portions[ \t]+)?(copyright|\(c\)|©)[^a-z0-9\n]*(\(c\)|©|[0-9]{4}|copyright\b)", lead + r"(portions[ \t]+)?©",
        lead + r"(portions[ \t]+)?\(c\).*\b(19|20)[0-9]{2}\b", lead + "(all rights reserved|spdx-license-identifier:)",
        lead + holder + rf"(by[ \t]+)?the[ \t].*\b({_HOLDERS})[^a-z0-9\n]*$",
    ]
    named = f"(regexp_matches(x, '{lead}{holder}[a-z0-9\\x{{80}}-\\x{{10ffff}}]') and not regexp_matches(x, '{lead}{holder}({_NO_HOLDER})($|[^a-z0-9])'))"
    notice = " or ".join([*[f"regexp_matches(x, '{r}')" for r in rules], named])
    stay = f"concat(chr(10), list_aggregate(list_transform(string_split({lowered}, chr(10)), lambda x: CASE WHEN {notice} THEN '' ELSE x END), 'string_agg', chr(10)))"
    form = canonical_sql("text", "", ", 'g'", stay)
    rows = ", ".join("('{}', '{}')".format(name, body.replace("'", "''")) for name, body in sorted(LICENSES.items()))
    whole = ", ".join(f"('{digest}', '{name}')" for name, digest in DIGESTS.items())
    return f"""
with known as (
  select sha256({form}) as digest, min(license_id) as license_id from (values {rows}) t(license_id, text) group by 1
  union all select * from (values {whole}) w(digest, license_id))
select doc_id, canonical_sha256, license_id, license_id is not null as is_license
from (select doc_id, sha256({form}) as canonical_sha256 from documents) d left join known on digest = canonical_sha256
"""
