"""License scan by canonical digest lookup.

A text and the known licence texts are brought to one canonical form: lines of copyright
notices and blank lines go, letters become lower case, equivalent spellings become one
(licence/license, "(c)", http/https, and the like), punctuation becomes blanks, runs of
blanks become one. The SHA-256 of that form is looked up by a hash join in the table of
known digests. The whole text is looked up, and each paragraph and line of it, whole, as a
text of its own, so a notice inside a document is found too. A known text of several
paragraphs inside a document is found as a run of consecutive paragraphs (those without a
letter or digit left out): where a paragraph is the first one of a known text, the runs of
the known lengths that start there are looked up by the digest of their paragraphs' digests.
A known text that holds another one of the same licence is no run of its own, so a titled
licence inside a document counts once, as its body. DataFrame functions only; the table of
digests is fixed and small, so the join broadcasts it and nothing is shuffled.

Edge cases: a null, empty or blank text matches nothing; rows are independent (ties,
repeated rows and null ids need no rule); an empty table gives an empty result; extra
columns are ignored, whatever their names; texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
import pkgutil
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.frames import col

# Short public licence texts and the standard notices of longer ones; the
# full texts of these are added below.
KNOWN = {
    "MIT": [
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including
without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER
IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE
USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        "Released under the MIT License.", "Licensed under the MIT License.", "MIT License", "The MIT License",
        "This project is licensed under the terms of the MIT license.", "SPDX-License-Identifier: MIT",
    ],
    "ISC": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF
USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF
OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
        "Licensed under the ISC License.", "SPDX-License-Identifier: ISC",
    ],
    "BSD-2-Clause": [
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY
DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE.""",
        "Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause",
    ],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "Zlib": [
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors
be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications,
and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
software. If you use this software in a product, an acknowledgment in the product documentation would be
appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
original software.

3. This notice may not be removed or altered from any source distribution.""",
        "SPDX-License-Identifier: Zlib",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is
distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License.""",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version.""",
        "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "GPL-2.0": ["Licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"],
    "MPL-2.0": [
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.",
                  "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
                "SPDX-License-Identifier: CC0-1.0"],
}

# Title lines above a short text, before its copyright lines.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)",
            "MIT License (https://opensource.org/license/mit)", "MIT License (https://opensource.org/licenses/MIT)"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License",
                     "The 2-Clause BSD License", "BSD-2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License",
                     "Modified BSD License", "The 3-Clause BSD License", "BSD-3-Clause", "BSD License"],
    "Zlib": ["zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"],
}
FULL_TEXTS = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3",
              "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
END_OF_TERMS = "END OF TERMS AND CONDITIONS"


def _add_whole_texts() -> None:
    """Full texts, also without the part on how to apply them and with the copyright line
    of Apache-2.0 filled in (such a line is dropped); short texts also under their titles,
    and lists also without numbers."""
    third = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
             "products\nderived from this software without specific prior written permission.\n\n")
    disclaimer = "THIS SOFTWARE IS PROVIDED"
    KNOWN["BSD-3-Clause"].insert(0, KNOWN["BSD-2-Clause"][0].replace(disclaimer, third + disclaimer))
    for name, titles in TITLES.items():
        body = KNOWN[name][0]
        bodies = dict.fromkeys([body, re.sub(r"(?m)^\d\. ", "", body)])
        KNOWN[name] += [t for t in bodies if t != body] + [f"{title}\n\n{t}" for title in titles for t in bodies]
    for name, file in FULL_TEXTS.items():
        text = pkgutil.get_data("quarry.llm", f"known_licenses/{file}.txt").decode()
        forms = [text, re.sub(r"(?m)^[ \t]*Copyright \[yyyy\].*$", "", text)]
        if END_OF_TERMS in text:
            terms = text[:text.index(END_OF_TERMS)]
            forms += [terms, terms + END_OF_TERMS]
        KNOWN.setdefault(name, []).extend(dict.fromkeys(forms))


_add_whole_texts()

# Spellings made equal, in this order, on lower-case text.
SPELLINGS = [
    ("https://", "http://"), ("©", "(c)"), ("“", '"'), ("”", '"'), ("‘", "'"), ("’", "'"), ("–", "-"), ("—", "-"),
    ("licence", "license"), ("licenced", "licensed"), ("sub-license", "sublicense"), ("non-infringement", "noninfringement"),
    ("acknowledgement", "acknowledgment"), ("merchantibility", "merchantability"), ("whilst", "while"),
    ("copyright owner", "copyright holder"), ("favour", "favor"), ("honour", "honor"), ("programme", "program"),
    ("version 2.0", "v. 2.0"), ("v2.0", "v. 2.0"),
]

COPYRIGHT_LINE = ("(?m)^[^a-z\\n]*(copyright([ \\t]+(\\(c\\)|[0-9])|[^a-z\\n][^\\n]*[12][0-9][0-9][0-9])|\\(c\\)[ \\t]*(copyright|[0-9])"
                  "|all rights reserved)[^\\n]*$")
PUNCTUATION = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
PARAGRAPH = "\\n[ \\t\\r]*\\n[ \\t\\r\\n]*"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def plain(text: Column) -> Column:
    """Letters and spellings made equal and copyright lines replaced by a dash, line by line: the
    lines and paragraphs of the result are those of the text."""
    t = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.regexp_replace(t, "(?d)" + COPYRIGHT_LINE, "-")


def words(text: Column) -> Column:
    """The canonical form of a plain text."""
    return F.trim(F.regexp_replace(text, PUNCTUATION, " "))


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def paragraph_words(text: str) -> list[str]:
    """The canonical paragraphs of a known text, without empty ones."""
    t = text.translate(str.maketrans(UPPER, LOWER))
    for a, b in SPELLINGS:
        t = t.replace(a, b)
    t = re.sub(COPYRIGHT_LINE, "-", t)
    return [w for p in re.split(PARAGRAPH, t) if (w := re.sub(PUNCTUATION, " ", p).strip(" "))]


def known_runs(texts: dict[str, list[str]]) -> list[tuple[str, list[str]]]:
    """(license, digests of its paragraphs) of the known texts of two paragraphs or more that
    hold no other such text of their licence."""
    found = []
    for license, ts in texts.items():
        runs = {tuple(hashlib.sha256(w.encode()).hexdigest() for w in paragraph_words(t)) for t in ts}
        runs = sorted((r for r in runs if len(r) > 1), key=lambda r: (len(r), r))
        least: list[tuple] = []
        for r in runs:
            if not any(r[i:i + len(x)] == x for x in least for i in range(len(r) - len(x) + 1)):
                least.append(r)
        found += [(license, list(r)) for r in least]
    return found


def run_digest(digests: list[str]) -> str:
    return hashlib.sha256(" ".join(digests).encode()).hexdigest()


def known_digests(spark, texts: dict[str, list[str]] | None = None) -> DataFrame:
    """(digest, license) of known texts and of their runs of paragraphs, one row per digest."""
    texts = texts or KNOWN
    df = spark.createDataFrame([(k, t) for k, ts in texts.items() for t in ts], "license string, text string")
    df = df.select("license", sha256(words(plain(F.col("text")))).alias("digest"))
    runs = [(k, run_digest(r)) for k, r in known_runs(texts)]
    if runs:
        df = df.union(spark.createDataFrame(runs, "license string, digest string"))
    return df.groupBy("digest").agg(F.min("license").alias("license"))


def _runs(digests: Column, known: list[tuple[str, list[str]]]) -> Column:
    """Digests of the runs of paragraphs that may be a known text."""
    starts = sorted({r[0] for _, r in known})
    lengths = F.array(*[F.lit(n) for n in sorted({len(r) for _, r in known})])

    def at(i: Column) -> Column:
        return F.transform(lengths, lambda n: F.when(i + n <= F.size(digests), sha256(F.array_join(F.slice(digests, i + 1, n), " "))))
    return F.flatten(F.transform(digests, lambda d, i: F.when(d.isin(starts), at(i)).otherwise(F.array().cast("array<string>"))))


def scan(docs: DataFrame, texts: dict[str, list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``license`` (of the whole text, or null), ``n_notices`` (its
    lines, paragraphs and runs of paragraphs that are a known text) and ``notices`` (their
    licences, sorted and joined by commas). ``texts``: known texts by licence (``KNOWN``).

    The parts of a text are rows of the same task, so the aggregation after the lookup
    folds them there and shuffles one small row per document."""
    known = known_runs(texts or KNOWN)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), col(id_col).cast("bigint").alias("doc_id"),
                       plain(col(text_col)).alias("text"))
    paragraphs = F.transform(F.split("text", PARAGRAPH), lambda p: F.struct(F.contains(p, F.lit("\n")).alias("lines"), words(p).alias("words")))
    paragraphs = F.transform(F.filter(paragraphs, lambda p: p["words"] != ""),
                             lambda p: F.struct(p["lines"].alias("lines"), sha256(p["words"]).alias("digest")))
    rows = rows.select("row", "doc_id", "text", paragraphs.alias("paragraphs"))
    rows = rows.select("row", "doc_id", "text", "paragraphs", F.transform("paragraphs", lambda p: p["digest"]).alias("digests"))
    lines = F.transform(F.split("text", "\n"), lambda x: sha256(words(x)))
    whole = F.transform(F.filter("paragraphs", lambda p: p["lines"]), lambda p: p["digest"])
    digests = [F.array(sha256(words(F.col("text")))), lines, whole] + ([_runs(F.col("digests"), known)] if known else [])
    parts = rows.select("row", "doc_id", F.posexplode(F.concat(*digests)).alias("part", "digest"))
    # a fixed list of at most a few hundred digests
    found = parts.join(F.broadcast(known_digests(docs.sparkSession, texts)), "digest", "left")
    notice = F.when(F.col("part") > 0, F.col("license"))
    return (found.groupBy("row", "doc_id")
                 .agg(F.max(F.when(F.col("part") == 0, F.col("license"))).alias("license"),
                      F.count(notice).alias("n_notices"),
                      F.array_join(F.sort_array(F.collect_list(notice)), ",").alias("notices"))
                 .select("doc_id", "license", "n_notices", "notices"))


def _sql_words(x: str) -> str:
    def quote(v):
        return "'" + v.replace("'", "''") + "'"
    x = f"translate(coalesce({x}, ''), '{UPPER}', '{LOWER}')"
    for a, b in SPELLINGS:
        x = f"replace({x}, {quote(a)}, {quote(b)})"
    x = f"regexp_replace({x}, {quote(COPYRIGHT_LINE)}, ' ', 'g')"
    return f"trim(regexp_replace({x}, {quote(PUNCTUATION)}, ' ', 'g'))"


def _sql_canonical(x: str) -> str:
    return f"sha256({_sql_words(x)})"


def _sql_known() -> str:
    return ", ".join("('" + k + "', '" + t.replace("'", "''") + "')" for k, ts in KNOWN.items() for t in ts)


_RUNS = known_runs(KNOWN)

ORACLE = f"""
  WITH known AS (SELECT {_sql_canonical('t')} AS digest, min(license) AS license
                 FROM (VALUES {_sql_known()}) AS v(license, t) GROUP BY 1),
  known_run AS (SELECT digest, min(license) AS license
                FROM (VALUES {", ".join(f"('{k}', '{run_digest(r)}')" for k, r in _RUNS)}) AS v(license, digest) GROUP BY 1),
  whole AS (SELECT doc_id, license FROM (SELECT doc_id, {_sql_canonical('text')} AS digest FROM documents) JOIN known USING (digest)),
  paragraph AS (SELECT doc_id, string_split_regex(coalesce(text, ''), '{PARAGRAPH}') AS ps FROM documents),
  parts AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS part FROM documents
    UNION ALL
    SELECT doc_id, part FROM (SELECT doc_id, unnest(ps) AS part FROM paragraph) WHERE contains(part, chr(10))
  ),
  said AS (SELECT doc_id, [{_sql_words('p')} for p in ps] AS ws FROM paragraph),
  digests AS (SELECT doc_id, [sha256(w) for w in ws if w <> ''] AS ds FROM said),
  starts AS (SELECT doc_id, ds, unnest(generate_series(1, len(ds))) AS i FROM digests
             WHERE list_has_any(ds, [{", ".join(f"'{d}'" for d in sorted({r[0] for _, r in _RUNS}))}])),
  run AS (SELECT doc_id, sha256(array_to_string(ds[i:i + n - 1], ' ')) AS digest
          FROM starts, (VALUES {", ".join(f"({n})" for n in sorted({len(r) for _, r in _RUNS}))}) AS l(n) WHERE i + n - 1 <= len(ds)),
  hit AS (SELECT doc_id, license FROM (SELECT doc_id, {_sql_canonical('part')} AS digest FROM parts) JOIN known USING (digest)
          UNION ALL SELECT doc_id, license FROM run JOIN known_run USING (digest)),
  n AS (SELECT doc_id, count(*) AS n_notices, string_agg(license, ',' ORDER BY license) AS notices FROM hit GROUP BY 1)
  SELECT d.doc_id, w.license, coalesce(n.n_notices, 0) AS n_notices, coalesce(n.notices, '') AS notices
  FROM documents d LEFT JOIN whole w USING (doc_id) LEFT JOIN n USING (doc_id)
"""
