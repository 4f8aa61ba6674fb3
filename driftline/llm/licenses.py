"""License scans: canonical digests of entire texts, joined by hash to the digests of known licences."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import constants

# Equivalent spellings of the public licence matching guidelines.
EQUIVALENT = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization",
    "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled", "capitalisations": "capitalizations", "catalogue": "catalog",
    "categorise": "categorize", "centre": "center", "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill",
    "fulfilment": "fulfillment", "https": "http", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "labour": "labor",
    "licence": "license", "licences": "licenses", "maximise": "maximize", "modelled": "modeled", "modelling": "modeling", "offence": "offense",
    "optimise": "optimize", "organisation": "organization", "organise": "organize", "practise": "practice", "programme": "program",
    "realise": "realize", "recognise": "recognize", "signalling": "signaling", "utilisation": "utilization", "whilst": "while", "wilful": "wilfull",
}
# Equivalent phrases, after the words above.
PHRASES = {"copyright owner": "copyright holder", "per cent": "percent", "sub license": "sublicense", "non commercial": "noncommercial"}

#: Lines that only say who holds the copyright, and "all rights reserved".
NOTICE = r"(?m)^[^\p{L}\p{N}\n(©]*(copyright|\(c\)|©)[^\n]*([0-9]{4}|\(c\)|©|<year>|\[year\]|all rights reserved)[^\n]*$"
RESERVED = r"(?m)^[^\p{L}\p{N}\n]*all rights reserved[^\p{L}\p{N}\n]*$"

# Texts and notices of public licences.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
"""
NO_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
KNOWN = [
    ("MIT", MIT),
    ("MIT", "MIT License\n" + MIT),
    ("MIT", "The MIT License (MIT)\n" + MIT),
    ("MIT-notice", "Released under the MIT License."),
    ("BSD-2-Clause", BSD_HEAD + BSD_TAIL),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + BSD_HEAD + BSD_TAIL),
    ("BSD-3-Clause", BSD_HEAD + BSD_THIRD + BSD_TAIL),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + BSD_HEAD + BSD_THIRD + BSD_TAIL),
    ("ISC", ISC + NO_WARRANTY),
    ("ISC", "ISC License\n" + ISC + NO_WARRANTY),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + NO_WARRANTY),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
]


def full_texts() -> list[tuple[str, str]]:
    """The licences of ``license_texts`` (a file each, named by its id), whole and without what follows
    the terms."""
    out = []
    for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        text = f.read_text(encoding="utf-8")
        out.append((f.stem, text))
        terms, end, more = text.partition("END OF TERMS AND CONDITIONS")
        if more.strip():
            out += [(f.stem, terms + end), (f.stem, terms)]
    return out


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, words only, one spelling, joined by single blanks."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), NOTICE, " "), RESERVED, " ")
    joined = F.regexp_replace(plain, r"(\p{L})-(\p{L})", "$1$2")
    words = F.split(F.trim(F.regexp_replace(joined, r"[^\p{L}\p{N}]+", " ")), " ")
    spell = F.create_map(*[F.lit(x) for kv in EQUIVALENT.items() for x in kv])
    out = F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(spell, w), w)), " ")
    for a, b in PHRASES.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def scan_licenses(docs: DataFrame, known: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, canonical_sha256 and license_id (null: no known licence) of every row.

    The entire text must be the licence, up to case, punctuation, copyright lines and spelling. Null
    texts have a null digest and no licence; empty texts have the digest of nothing; long texts are read
    whole. ``known`` has a row for each wording (``KNOWN`` and ``full_texts()`` if not given) and is
    broadcast only while it is short; two licences of one wording give the lesser id. Repeated rows
    repeat; an empty table gives no rows; other columns are not read.
    """
    known = KNOWN + full_texts() if known is None else known
    listed = constants(docs.sparkSession, known, "license_id string, wording string")
    listed = listed.groupBy(digest(F.col("wording")).alias("canonical_sha256")).agg(F.min("license_id").alias("license_id"))
    if len(known) <= 10_000:
        listed = F.broadcast(listed)
    told = docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("canonical_sha256"))
    return told.join(listed, "canonical_sha256", "left").select("doc_id", "canonical_sha256", "license_id")


def oracle() -> str:
    """The scan for the wordings of ``KNOWN`` in DuckDB SQL; the whole licences of ``full_texts()`` are not in it."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    canon = "regexp_replace(regexp_replace(lower(t), {n}, ' ', 'g'), {r}, ' ', 'g')".format(n=q(NOTICE), r=q(RESERVED))
    canon = f"trim(regexp_replace(regexp_replace({canon}, '(\\p{{L}})-(\\p{{L}})', '\\1\\2', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    spell = "map {" + ", ".join(f"{q(a)}: {q(b)}" for a, b in EQUIVALENT.items()) + "}"
    out = f"array_to_string(list_transform(string_split({canon}, ' '), lambda w: coalesce({spell}[w], w)), ' ')"
    for a, b in PHRASES.items():
        out = f"replace({out}, {q(a)}, {q(b)})"
    values = ", ".join(f"({q(a)}, {q(b)})" for a, b in KNOWN)
    return f"""
WITH known AS (SELECT sha256({out}) AS canonical_sha256, min(id) AS license_id FROM (VALUES {values}) v(id, t) GROUP BY 1),
told AS (SELECT doc_id, sha256({out}) AS canonical_sha256 FROM (SELECT doc_id, text AS t FROM documents))
SELECT doc_id, canonical_sha256, license_id FROM told LEFT JOIN known USING (canonical_sha256)"""
