"""License scan by canonical digest: whole texts are normalised and hash-joined to known licence texts.

Everything is DataFrame expressions. The normalisation is a list of rules that Spark and the oracle's SQL both follow,
except that the SQL's rule for copyright notices takes whole lines: on texts in which a line of terms starts like a
notice, or a notice shares its line with terms, the SQL's digests differ from the query's, and the query's are right.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.llm.common import table

#: Spellings that count as the same (left becomes right), whole words, after lower-casing.
SAME_SPELLING = [
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("authorisation", "authorization"), ("authorised", "authorized"),
    ("centre", "center"), ("favour", "favor"), ("fulfilment", "fulfillment"), ("honour", "honor"), ("initialise", "initialize"),
    ("judgement", "judgment"), ("labour", "labor"), ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("noncommercial", "non commercial"),
    ("organisation", "organization"), ("organisations", "organizations"), ("programme", "program"), ("recognised", "recognized"),
    ("sublicence", "sublicense"), ("sub license", "sublicense"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
    ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"), ("https", "http"),
]
#: The rule of ``OP9_SQL``, which stays as it was first written. It takes whole lines that start like a notice.
COPYRIGHT_LINE = r"(^|\n)[^a-z0-9\n]*(copyright|\(c\)|©|all rights reserved)[^\n]*"
#: Fixed values of ``NOTICE``: words that begin terms, so a notice ends before them.
_OPENS = (
    r"\b(?:permission (?:is|to)\b|redistributions?\b|(?:this|the) (?:software|program|library|file|code|package|work|project|source|license|licence|document|material)\b|"
    r"everyone is\b|do what the\b|licen[cs]ed\b|released\b|distributed\b|provided\b|under\b|subject to\b|except\b|unless\b|without\b|only\b|you\b|any\b|if\b|no (?:part|warranty)\b|for (?:non|personal|internal)|use of\b)"
)
#: A sentence ends, other than after an initial or a company's form, and more than a mark, an address or a reservation follows.
_SENTENCE = r"(?:(?<!\b(?:inc|ltd|co|corp|llc|gmbh|jr|sr|dr|st|al|[a-z]))[.]|[;!?])[ \t]+(?!all rights reserved|(?:modified works?|modifications?|portions|parts|additions) (?:are )?(?:copyright\b|\(c\)|©)|https?:|<|[^\s@]+@|copyright\b|\(c\)|©|[0-9]{4}|[\r\n])(?=[^\n]*[a-z0-9])"
#: A text that says something is no notice.
_SAYS = r"\b(?:is|are|was|were|agrees?|hereby|prohibited|forbidden|(?:may|must|shall|will|can|cannot|do|does) (?:not|only|be|use|copy|have|include|retain|pay|apply|appear)\b)\b"
_BODY = rf"(?:(?!{_OPENS}|{_SENTENCE}|{_SAYS})[^\n])*+(?=\n|\z|{_OPENS}|{_SENTENCE})"
_YEAR = r"(?:[0-9]{4}\b|[<\[{(]*[ ]?(?:years?|yyyy|dates?)\b)"
#: Words after "copyright" that speak of it and name no holder.
_NO_HOLDER = (
    r"(?:notices?|holders?|owners?|ownership|laws?|licen[cs]\w*|interests?|statements?|disclaimers?|permissions?|treaty|treaties|protect\w*|doctrines?|lines?|claims?|rights?|status|infring\w*|works?|materials?|"
    r"patents?|trademarks?|ed|the (?:software|library|program|work)|and|or|on|in|of|to|if|is|are|as|at|for|with|that|which|under|may|must|shall|will|can|not|also|like|you|your|a|an|any|this|these|such|it|its|all|act|office|term|year|but|from|has|have|does|do|was|unless)\b"
)
#: What carries no terms: a mark with a year or with a second mark, wherever it is; a mark with a holder, where a line
#: starts (of "(c)", which also numbers clauses, only near the start of a text); and the reservation of rights there. It goes up to its end, and terms on the same line stay.
NOTICE = (
    rf"(?md)(?:\bcopyright(?:ed)?[ \t]*:?[ \t]*(?:\(c\)|©|&copy;|{_YEAR})|(?:\(c\)|©|&copy;)[ \t]*(?:copyright\b|{_YEAR})){_BODY}(?:\n[ \t]*<?(?:https?://|[^\s@<]+@)\S*(?=[ \t]*\r?(?:\n|\z)))?"
    rf"|^[^a-z0-9\n]*(?:copyrights?[ \t]+(?:by[ \t]+)?|©[ \t]*|\(c\)(?<!(?s:.){{300}})[ \t]*)(?!{_NO_HOLDER}|{_OPENS})(?=[a-z<\[{{\x{{80}}-\x{{10FFFF}}]){_BODY}"
    r"|^[^a-z0-9\n]*all rights reserved\b"
)

_MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'
_MIT_NO_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD_CONDITIONS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
_BSD_ENDORSE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
_BSD_NO_WARRANTY = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_NO_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
#: Public licence texts by SPDX id; a second text of an id is a usual form of the same terms.
KNOWN_TEXTS = [
    ("MIT", f"MIT License\n\n{_MIT_GRANT}, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_MIT_NO_WARRANTY}"),
    ("MIT", f"{_MIT_GRANT}, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_MIT_NO_WARRANTY}"),
    ("MIT-0", f"MIT No Attribution\n\n{_MIT_GRANT}.\n\n{_MIT_NO_WARRANTY}"),
    ("BSD-2-Clause", f"{_BSD_CONDITIONS}{_BSD_NO_WARRANTY}"),
    ("BSD-3-Clause", f"{_BSD_CONDITIONS}{_BSD_ENDORSE}{_BSD_NO_WARRANTY}"),
    ("ISC", f"ISC License\n\n{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_NO_WARRANTY}"),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_NO_WARRANTY}"),
    ("0BSD", f"{_ISC_GRANT}.\n\n{_ISC_NO_WARRANTY}"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", 'This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org>'),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2, December 2004\n\nCopyright (C) 2004 Sam Hocevar <sam@hocevar.net>\n\nEveryone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.\n\nDO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nTERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION\n\n0. You just DO WHAT THE FUCK YOU WANT TO."),
    ("Apache-2.0-notice", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
]

#: Whole public texts by licence id, and the digests of them and of their usual forms (``write_digests``).
TEXTS = Path(__file__).with_name("license_texts")
#: Titles by licence id.
TITLES = {
    "MIT": ["The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "Expat License", "License: MIT", "MIT"],
    "MIT-0": ["MIT No Attribution License", "MIT-0", "The MIT-0 License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License", "The Simplified BSD License", "FreeBSD License", "BSD License", "The BSD License", "License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "The New BSD License", "Modified BSD License", "Revised BSD License", "BSD License", "The BSD License", "License"],
    "ISC": ["The ISC License", "The ISC License (ISC)", "ISC License (ISC)", "ISC"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "Zero Clause BSD License", "BSD Zero Clause License (0BSD)", "0BSD License", "0BSD", "Free Public License 1.0.0"],
    "Zlib": ["zlib License", "The zlib License", "The zlib/libpng License", "zlib/libpng License"],
    "Unlicense": ["The Unlicense", "Unlicense"],
    "WTFPL": [],
}
#: Other wordings of the same text, as public copies have them.
WORDINGS = [
    ("51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", ["59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", "59 Temple Place - Suite 330, Boston, MA 02111-1307, USA", "675 Mass Ave, Cambridge, MA 02139, USA", "51 Franklin St, Fifth Floor, Boston, MA 02110-1301 USA"]),
    ("the GNU Lesser General Public License instead", ["the GNU Library General Public License instead"]),
]
#: Where a text's instructions for its use begin, or an introduction that is not of its terms ends.
_APPENDIX = re.compile(r"\s*(?:END OF TERMS AND CONDITIONS.*|APPENDIX: How to apply.*|How to Apply These Terms to Your New .*|ADDENDUM: How to use this License.*)", re.S | re.I)
_CC0_INTRO = re.compile(r"CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM.*?HEREUNDER\.\s*", re.S)


def _numbered(text: str) -> list[str]:
    """The clauses numbered, lettered, or with bullets."""
    marks = [lambda k: f"{k}. ", lambda k: "* ", lambda k: f"{'abcd'[int(k) - 1]}. ", lambda k: f"{['i', 'ii', 'iii', 'iv'][int(k) - 1]}. "]
    return [re.sub(r"(?m)^[ \t]*([1-4])\. +", lambda m, f=f: f(m[1]), text) for f in marks]


def forms() -> list[tuple[str, str]]:
    """``(license, text)``: the whole texts and those of ``KNOWN_TEXTS`` in the forms in which copies have them.

    With and without title, instructions for use and introduction; with numbers, letters or bullets; with each
    wording; and as it is, with each paragraph on a line, and all on one line.
    """
    whole: list[tuple[str, str]] = []
    for path in sorted(TEXTS.glob("*.txt")):
        name, text = path.stem, path.read_text(encoding="utf-8")
        if name in TITLES:
            whole += [(name, f"{title}\n\n{t}") for t in _numbered(text) for title in ["", *TITLES[name]]]
            continue
        same = [text]
        for ours, others in WORDINGS:
            at = re.compile(r"\s+".join(re.escape(w) for w in ours.replace(",", " ,").split()).replace(r"\s+,", r",?"))
            same += [at.sub(other, t) for t in same for other in others if at.search(t)]
        for t in same:
            cut = _APPENDIX.sub("", t)
            ends = [t, cut, f"{cut}\n\nEND OF TERMS AND CONDITIONS"] if cut != t else [t]
            if name == "Apache-2.0":
                ends += [re.sub(r"(?m)^[ \t]*\([a-d]\) ", "", e) for e in ends]
            if name == "CC0-1.0":
                ends += [_CC0_INTRO.sub("", t), _CC0_INTRO.sub("", t).replace("Creative Commons Legal Code", ""), t.replace("Creative Commons Legal Code", "")]
            whole += [(name, e) for e in ends]
    for name, text in KNOWN_TEXTS:
        if name in TITLES:
            bare = re.sub(r"\A(?:MIT License|MIT No Attribution|ISC License)\n\n", "", text)
            several = _numbered(bare) if name in ("BSD-2-Clause", "BSD-3-Clause", "Zlib") else [bare]
            whole += [(name, f"{title}\n\n{t}") for t in several for title in ["", *TITLES[name]]]
        whole.append((name, text))
    lines = lambda t: "\n\n".join(" ".join(p.split()) for p in re.split(r"\n[ \t]*\n", t))
    return sorted({(k, f) for k, t in whole for f in (t, lines(t), " ".join(t.split()))})


def form_digests(spark: SparkSession) -> DataFrame:
    """``(digest, license)`` of ``forms``."""
    rows = spark.createDataFrame(forms(), "license string, text string")
    return rows.select(F.sha2(canonical(F.col("text")).cast("binary"), 256).alias("digest"), "license").distinct()


def write_digests(spark: SparkSession) -> None:
    """Rewrite the file of digests; to be run when a rule, a text or a form changes."""
    rows = sorted((r.license, r.digest) for r in form_digests(spark).collect())
    (TEXTS / "DIGESTS.tsv").write_text("".join(f"{d}\t{k}\n" for k, d in rows), encoding="ascii")


def _rules(notice: str = COPYRIGHT_LINE) -> list[tuple[str, str]]:
    """Patterns and what replaces them, in order, on lower-case text. Java and RE2 read all but ``NOTICE`` alike."""
    plain = [(notice, "\n"), (r"[^a-z0-9\x{80}-\x{10FFFF}]+", "  ")]
    # A word boundary is a blank here, and there are two between words, so that neighbours do not share one; they become one at the end.
    wide = lambda w: " " + w.replace(" ", "  ") + " "
    return [*plain, *((wide(a), wide(b)) for a, b in SAME_SPELLING), ("  ", " ")]


def canonical(text: Column) -> Column:
    """Lower case, no copyright notices, one blank for each run of punctuation and white space, one spelling; trimmed."""
    (line, nl), (marks, blank), *words = _rules(NOTICE)
    c = F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace(F.lower(text), line, nl), marks, blank), F.lit(" "))
    for a, b in words:
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.trim(c)


def canonical_sql(text: str) -> str:
    """The same in DuckDB, but for copyright notices: there, whole lines go (``COPYRIGHT_LINE``)."""
    (line, nl), (marks, blank), *words = _rules()
    c = f"' ' || regexp_replace(regexp_replace(lower({text}), '{line}', chr(10), 'g'), '{marks}', '{blank}', 'g') || ' '"
    for a, b in words:
        c = f"replace({c}, '{a}', '{b}')"
    return f"trim({c})"


def known_digests(spark: SparkSession) -> DataFrame:
    """``(digest, license)``: the file of digests, some hundred rows."""
    rows = [tuple(line.split("\t")) for line in (TEXTS / "DIGESTS.tsv").read_text(encoding="ascii").splitlines()]
    return spark.createDataFrame(rows, "digest string, license string").groupBy("digest").agg(F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, known: DataFrame | None = None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``digest`` (SHA-256 of the canonical text), ``canon_chars`` and ``license`` (null if the digest is not known).

    A text matches if all of it is a licence, whatever its case, punctuation, line breaks, copyright notices and spelling. Null
    and empty texts have the digest of nothing and no licence. Every row gives one row; repeated digests in
    ``known`` (default: ``known_digests``) name the first licence in order; input columns named like outputs are dropped. The
    shipped digests, some hundred rows, are broadcast: the documents are scanned once and not shuffled. Digests of the caller's are joined as Spark's
    own statistics decide.
    """
    new = ["digest", "canon_chars", "license"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new]
    table_ = known if known is not None else known_digests(docs.sparkSession)
    table_ = table_.groupBy("digest").agg(F.min("license").alias("license"))
    canon = docs.select(*kept, canonical(F.coalesce(docs[text], F.lit(""))).alias("__canon"))
    rows = canon.select(*kept, F.sha2(F.col("__canon").cast("binary"), 256).alias("digest"), F.length("__canon").cast("long").alias("canon_chars"))
    return rows.join(F.broadcast(table_) if known is None else table_, "digest", "left").select(*kept, *new)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every whole text of ``documents``; see ``scan_licenses`` for nulls, empty and repeated texts."""
    return scan_licenses(table(spark, sf_dir, "documents"), keep=["doc_id"])


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(k)}, {quote(t)})" for k, t in KNOWN_TEXTS)
    return f"""
    WITH known AS (SELECT sha256({canonical_sql("t")}) AS digest, min(l) AS license FROM (VALUES {known}) v(l, t) GROUP BY 1),
    d AS (SELECT doc_id, {canonical_sql("coalesce(text, '')")} AS c FROM documents)
    SELECT doc_id, sha256(c) AS digest, CAST(length(c) AS BIGINT) AS canon_chars, license FROM d LEFT JOIN known ON known.digest = sha256(c)
    """


OP9_SQL = _sql()
