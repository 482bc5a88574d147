"""License scans: TF-IDF cosine of header lines to templates, then inheritance down paths.

Every line of a text that holds a word of ANCHOR is a candidate header. Its tokens weigh
count x idf; idf comes from all candidate lines of all documents, for the tokens
of the templates (a bounded vocabulary), and tokens that no template has count once each with
the idf of a token never seen. A line's licence is the template of largest cosine, from
THRESHOLD on. A document's licence is its best line's; a document is a licence file if its
name says so or if matched lines make up half of its characters.

Blocks of a text that hold an anchor are vectors too: its leading comment block (or, without one, the
lines up to the first blank one), every paragraph (between blank lines, or lines of comment signs alone) and the whole text, against the titles, openings, notices and full texts
of BLOCKS, with the idf of all such blocks. So a title that the real files wrap over lines, and a notice below a shebang or inside a docstring, are found as well. The best of lines and blocks is the document's licence; a whole text that matches is a licence file.
A vector's terms are read from its sorted tokens in one walk, so a long text takes time in proportion to its length. Texts
are searched for anchors once, and only those that hold one are written for the passes that follow.

A directory's licence is the best one among licence files directly in it. Directories
resolve to their nearest ancestor (or themselves) with a licence: each distinct directory is exploded
into its ancestors, joined by path, and the deepest match wins. Documents without a
header of their own inherit by a join on their directory. Built-in functions only;
joins on directories are of plain tables, so AQE can split a directory that holds a third of the rows.

Defined cases: a null or empty text has no header and can only inherit; a null path is
the root directory's nameless file; equal scores go to the licence first by name; repeated rows
each get their row; texts of any length are read whole. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

THRESHOLD = 0.6
#: Every text that matches ANCHOR holds one of these in lower case.
HINTS = ("licens", "licenc", "copyright", "spdx", "permission is hereby", "redistribution and use", "public domain")
ANCHOR = r"(?i)licen[cs]|copyright|spdx|permission is hereby|redistribution and use|public domain"
TOKEN = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: Stands for a null part of a path.
NO_NAME = "(null)"
FILE_NAME = r"(?i)^(licen[cs]e|copying|unlicense|notice)([.-].*)?$"

#: Names by SPDX, and the usual wording of headers and of the files' first lines.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


_WARRANTY = "{} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
_CREATIVE = 'By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons {0} 4.0 International Public License ("Public License"). To the extent this Public License may be interpreted as a contract, You are granted the Licensed Rights in consideration of Your acceptance of these terms and conditions, and the Licensor grants You such rights in consideration of benefits the Licensor receives from making the Licensed Material available under these terms and conditions.'
_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
#: Titles and openings of the licence files, whole notices of file headers, and the full texts that are short enough to be given here.
BLOCKS = [
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    *[(f"CC-{short}-4.0", text.format(name)) for short, name in (("BY", "Attribution"), ("BY-NC", "Attribution-NonCommercial"), ("BY-SA", "Attribution-ShareAlike")) for text in ("Creative Commons {0} 4.0 International Public License", _CREATIVE)],
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", _GRANT),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("GPL-3.0", f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. {_WARRANTY.format('This program')} See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/"),
    ("LGPL-3.0", f"This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. {_WARRANTY.format('This library')} See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library. If not, see https://www.gnu.org/licenses/"),
    ("MIT", f'{_GRANT} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
]
#: Possessive, so that long blocks take neither stack nor backtracking.
COMMENT = r"\A((?:[ \t]*+(?:#|//|/\*|\*|--|;|<!--|%)[^\n]*+(?:\n|\z))++)"
FIRST_LINES = r"\A[ \t\n\f\r]*+((?:[ \t\r]*+\S[^\n]*+(?:\n|\z))++)"
#: What stands between paragraphs: lines that are blank but for comment signs.
BETWEEN = r"\n(?:[ \t\r#*/;%<>!-]*+\n)++"


def template_tokens(text: str) -> list[str]:
    return re.findall(TOKEN, text.lower())


def vocabulary(templates: list[tuple[str, str]] = TEMPLATES) -> list[str]:
    return sorted({t for _, text in templates for t in template_tokens(text)})


def candidate_lines(text: str = "text") -> Column:
    """The candidate header lines of a text, as an array."""
    lines = F.filter(F.split(F.col(text), "\n", -1), lambda line: line.rlike(ANCHOR))
    return F.when(F.col(text).rlike(ANCHOR), lines).otherwise(F.array().cast("array<string>"))


def _tokens(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(TOKEN), F.lit(0))


def blocks(text: str = "text") -> Column:
    """The leading block, the whole and the paragraphs of a text that holds an anchor, as an array without repeats; no block that has no anchor."""
    column = F.col(text)
    comment = F.regexp_extract(column, COMMENT, 1)
    lead = F.when(comment != "", comment).otherwise(F.regexp_extract(column, FIRST_LINES, 1))
    return F.when(column.rlike(ANCHOR), F.array_distinct(F.filter(F.concat(F.array(lead, column), F.split(column, BETWEEN, -1)), lambda b: b.rlike(ANCHOR)))).otherwise(F.array().cast("array<string>"))


def inverse_frequencies(docs: DataFrame, lines: Column | None = None, templates: list[tuple[str, str]] = TEMPLATES) -> tuple[dict[str, float], float]:
    """(idf of each template token, idf of a token never seen), over all candidate lines (or the arrays ``lines``) and the templates."""
    words = vocabulary(templates)
    lines = docs.select(F.explode(candidate_lines() if lines is None else lines).alias("line"))
    found = lines.select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect(_tokens(F.col("line")), F.lit(words)))).alias("token"))
    seen = {r["token"]: r["count"] for r in found.groupBy("token").count().collect()}  # one row a template token, and "" for all lines
    n = seen.get("", 0) + len(templates)
    for _, text in templates:
        for token in set(template_tokens(text)):
            seen[token] = seen.get(token, 0) + 1
    return {w: math.log((1 + n) / (1 + seen[w])) + 1 for w in words}, math.log(1 + n) + 1


def template_weights(idf: dict[str, float], templates: list[tuple[str, str]] = TEMPLATES) -> list[dict[str, float]]:
    """Unit TF-IDF vectors of the templates."""
    out = []
    for _, text in templates:
        tokens = template_tokens(text)
        raw = {t: tokens.count(t) * idf[t] for t in set(tokens)}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        out.append({t: v / norm for t, v in raw.items()})
    return out


def line_match(line: Column, idf: dict[str, float], unseen: float, templates: list[tuple[str, str]] = TEMPLATES) -> Column:
    """struct(score, license) of a line's nearest template."""
    words = sorted(idf)
    weights = template_weights(idf, templates)
    table = F.map_from_arrays(F.lit(words), F.lit([[idf[w] ** 2, *[idf[w] * t.get(w, 0.0) for t in weights]] for w in words]))

    def add(acc: Column, token: Column) -> Column:
        """One more token of the sorted ones: the n-th of a kind adds 2n - 1 to the square of its count."""
        n = F.when(acc["token"] == token, acc["n"] + 1).otherwise(F.lit(1))
        terms = F.transform(table[token], lambda w, k: F.when(k == 0, w * (2 * n - 1)).otherwise(w))
        return F.struct(token.alias("token"), n.alias("n"), F.zip_with(acc["sums"], terms, lambda a, b: a + b).alias("sums"))

    def weighed(tokens: Column) -> Column:
        rare = F.size(F.array_except(tokens, F.lit(words))).cast("double")
        start = F.struct(F.lit("").alias("token"), F.lit(0).alias("n"), F.array(*[F.lit(0.0)] * (1 + len(weights))).alias("sums"))

        def finish(acc: Column) -> Column:
            norm = F.sqrt(acc["sums"][0] + rare * F.lit(unseen * unseen))
            options = [F.struct((-F.round(acc["sums"][k + 1] / norm, 6)).alias("s"), F.lit(name).alias("l")) for k, (name, _) in enumerate(templates)]
            best = F.array_min(F.array(*options))
            return F.struct((-best["s"]).alias("score"), best["l"].alias("license"))

        known = F.array_sort(F.filter(tokens, lambda t: F.array_contains(F.lit(words), t)))
        return F.aggregate(known, start, add, finish)

    return F.transform(F.array(_tokens(line)), weighed)[0]  # a lambda's variable, so that tokens are found once


def anchored(docs: DataFrame) -> DataFrame:
    """``(doc_id, path, text)`` with the texts that hold an anchor; null ones in the others' place. Written once."""
    rows = docs.select("doc_id", "path", F.col("text").cast("string").alias("text")).withColumn("lic_lower", F.lower("text"))
    some = F.col("lic_lower").contains(HINTS[0])
    for hint in HINTS[1:]:
        some = some | F.col("lic_lower").contains(hint)
    return cut(rows.select("doc_id", "path", F.when(some & F.col("text").rlike(ANCHOR), F.col("text")).alias("text")), "license-texts")


def headers(docs: DataFrame) -> DataFrame:
    """``docs`` with lic_best (score, license or null), lic_lines (matched lines) and lic_file."""
    idf, unseen = inverse_frequencies(docs)
    matched = F.transform(
        candidate_lines(),
        lambda line: F.struct(line_match(line, idf, unseen).alias("m"), F.char_length(line).alias("n")),
    )
    matched = F.filter(matched, lambda x: x["m"]["score"] >= THRESHOLD)
    block_idf, block_unseen = inverse_frequencies(docs, blocks(), BLOCKS)
    whole = F.transform(blocks(), lambda b: F.struct(line_match(b, block_idf, block_unseen, BLOCKS).alias("m"), (b == F.col("text")).alias("whole")))
    rows = docs.withColumns({"lic_matched": matched, "lic_blocks": F.filter(whole, lambda x: x["m"]["score"] >= THRESHOLD)})
    scores = lambda c: F.transform(c, lambda x: F.struct((-x["m"]["score"]).alias("s"), x["m"]["license"].alias("l")))
    best = F.array_min(F.concat(scores("lic_matched"), scores("lic_blocks")))
    is_text = F.exists("lic_blocks", lambda x: x["whole"])
    any_match = F.size("lic_matched") + F.size("lic_blocks") > 0
    covered = F.aggregate("lic_matched", F.lit(0), lambda acc, x: acc + x["n"])
    named = F.coalesce(F.element_at(F.split("path", "/"), -1).rlike(FILE_NAME), F.lit(False))
    return rows.withColumns(
        {
            "lic_best": F.when(any_match, F.struct((-best["s"]).alias("score"), best["l"].alias("license"))),
            "lic_lines": F.size("lic_matched").cast("long"),
            "lic_file": any_match & (named | is_text | (2 * covered >= F.char_length("text"))),
        }
    ).drop("lic_matched", "lic_blocks")


def directory(path: Column) -> Column:
    """The path without its last part; the root is the empty string."""
    return F.coalesce(F.regexp_extract(path, r"^(.*)/[^/]*$", 1), F.lit(""))


def resolved_directories(directories: DataFrame, owned: DataFrame) -> DataFrame:
    """``(lic_dir, license, score)``: for each distinct directory the licence of its nearest ancestor in ``owned``."""
    parts = F.split("lic_dir", "/")
    prefix = lambda k: F.when(k == 0, F.lit("")).otherwise(F.array_join(F.slice(parts, F.lit(1), k), "/"))
    depth = F.when(F.col("lic_dir") == "", 0).otherwise(F.size(parts))
    above = directories.select("lic_dir", F.explode(F.transform(F.sequence(F.lit(0), depth), lambda k: F.struct(k.alias("depth"), prefix(k).alias("ancestor")))).alias("a"))
    met = above.select("lic_dir", "a.depth", "a.ancestor").join(owned.select(F.col("lic_dir").alias("ancestor"), "license", "score"), "ancestor")
    nearest = met.groupBy("lic_dir").agg(F.max_by(F.struct("license", "score"), "depth").alias("near"))
    return nearest.select("lic_dir", F.col("near.license").alias("license"), F.col("near.score").alias("score"))


def license_report(docs: DataFrame) -> DataFrame:
    """``(doc_id, path, license, score, origin, n_header_lines)`` for every row of ``docs`` (doc_id, path, text).

    origin is ``header``, ``inherited`` or ``none``."""
    # the written texts are few bytes and much work, which file sizes would put into few tasks
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = headers(anchored(docs).repartition(tasks)).withColumn("lic_dir", directory(F.col("path")))
    found = cut(found.drop("text"), "license-headers")
    own = found.where("lic_file").groupBy("lic_dir").agg(F.min(F.struct((-F.col("lic_best.score")).alias("s"), F.col("lic_best.license").alias("l"))).alias("b"))
    own = cut(own.select("lic_dir", F.col("b.l").alias("license"), (-F.col("b.s")).alias("score")), "license-owned")
    near = cut(resolved_directories(found.select("lic_dir").distinct(), own), "license-directories")
    rows = found.join(near, "lic_dir", "left")
    header = F.col("lic_best").isNotNull()
    return rows.select(
        "doc_id",
        "path",
        F.coalesce("lic_best.license", "license").alias("license"),
        F.coalesce("lic_best.score", "score").alias("score"),
        F.when(header, "header").when(F.col("license").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.col("lic_lines").alias("n_header_lines"),
    )


def document_paths(docs: DataFrame) -> DataFrame:
    """``(doc_id, path, text)``: documents as files source/lang/block of 64 ids/id; a null part is a name of its own."""
    block = F.floor(F.col("doc_id") / 64)
    named = lambda c: F.coalesce(c.cast("string"), F.lit(NO_NAME))
    path = F.concat_ws("/", named(F.col("source")), named(F.col("lang")), named(block), named(F.col("doc_id")))
    return docs.select("doc_id", path.alias("path"), F.col("text").cast("string").alias("text"))
