"""Licence detection by TF-IDF cosine and inheritance along directories.

Every text is cut into units: each paragraph, its lines joined and comment marks removed, and
each sentence of each line, so that notices wrapped at any width are compared whole. Units
and the paragraphs of the templates are sparse vectors in the space of the templates'
terms; document frequencies are counted over all units of the corpus, and each use of any
other term adds the weight of an unseen term to the unit's length. A file's licence
is the one with most of its template matched; a file without a match inherits from the nearest
ancestor directory that has a licence file. DataFrame functions only.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamlode.llm.common import drop_staged, partitions, staged

# Public licence texts and the notices that stand for them, paragraph by paragraph.
_AS_IS = [
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
]
_BSD = [
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
]


def _gnu(name: str, version: str) -> list[str]:
    return [
        f"This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.",
        f"This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.",
        f"You should have received a copy of the {name} along with this program. If not, see <https://www.gnu.org/licenses/>.",
        f"{name} Version {version}",
        f"This work is licensed under the {name}, version {version}.",
        f"Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. {name}",
    ]


#: Licence id -> paragraphs of its text and its notices.
TEMPLATES = {
    "Apache-2.0": [
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
        "\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.",
        "\"Licensor\" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License.",
        "2. Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed under the Apache License, Version 2.0.",
    ],
    "MIT": [
        "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        *_AS_IS,
        "Released under the MIT License.", "Licensed under the MIT License.",
    ],
    "ISC": [
        "ISC License",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "BSD-2-Clause": ["BSD 2-Clause License", *_BSD],
    "BSD-3-Clause": [
        "BSD 3-Clause License", *_BSD,
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "GPL-2.0": [*_gnu("GNU General Public License", "2")],
    "GPL-3.0": [
        *_gnu("GNU General Public License", "3"),
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    ],
    "LGPL-2.1": [*_gnu("GNU Lesser General Public License", "2.1")],
    "LGPL-3.0": [
        *_gnu("GNU Lesser General Public License", "3"),
        "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
    ],
    "AGPL-3.0": [
        *_gnu("GNU Affero General Public License", "3"),
        "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
    ],
    "MPL-2.0": [
        "Mozilla Public License Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ],
    "CC-BY-4.0": [
        "Creative Commons Attribution 4.0 International Public License", "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "Creative Commons Attribution-ShareAlike 4.0 International Public License", "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC-4.0": [
        "Creative Commons Attribution-NonCommercial 4.0 International Public License", "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC0-1.0": [
        "CC0 1.0 Universal",
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law.",
    ],
}
_TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
_MARKS = r"(?m)^[ \t]*(?:/\*+|\*+/|\*+|//+|#+|--+|;+|%+|<!--|\"\"\")?[ \t]*|[ \t]*(?:\*+/|-->)?[ \t]*$"
_PARAGRAPH = r"\n{2,}"
_SENTENCE = r"\n+|(?<=[.!?])[ \t]+(?=\p{Lu})"
_NAMED = r"(?i)^(licen[sc]e|copying|notice|unlicense)([._-].*)?$"


def _terms(text: str) -> list[str]:
    return re.findall(_TERM, text.lower())


def _with_spdx(templates: dict[str, list[str]]) -> list[tuple[str, list[str]]]:
    """(licence, terms) of each paragraph, and of each licence's SPDX line."""
    return [(name, _terms(p)) for name, paragraphs in templates.items() for p in [*paragraphs, f"SPDX-License-Identifier: {name}"]]


def _units(text: Column) -> Column:
    """Paragraphs and sentences of a text without comment marks."""
    bare = F.regexp_replace(F.regexp_replace(text, "\r", ""), _MARKS, "")
    return F.array_distinct(F.concat(F.split(bare, _PARAGRAPH), F.split(bare, _SENTENCE)))


def _squares(terms: Column) -> Column:
    """Sum of the squared counts of the terms."""
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).cast("long").alias("sum"))

    def step(a, t):
        again = t == a["last"]
        return F.struct(t.alias("last"), F.when(again, a["run"] + 1).otherwise(1).alias("run"), (a["sum"] + F.when(again, 2 * a["run"] + 1).otherwise(1)).alias("sum"))

    return F.aggregate(F.array_sort(terms), start, step, lambda a: a["sum"])


def _values(spark: SparkSession, rows: list[tuple], *names: str) -> DataFrame:
    """A table of literals."""
    made = (f"({', '.join(repr(float(x)) + 'D' if isinstance(x, float) else repr(x) for x in r)})" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {', '.join(made)} AS t({', '.join(names)})")


def detect(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", templates: dict[str, list[str]] = TEMPLATES, least: float = 0.8) -> DataFrame:
    """(id, path, license, cosine, origin, from_dir) of every file.

    A paragraph of a template is matched if some unit of the file reaches the cosine ``least`` with it. origin:
    ``header`` if the file matches any; its licence is that of the largest sum of terms times
    squared cosine over matched paragraphs, then of the largest share of its template,
    then of the best cosine, then the smaller id; ``inherited`` if an ancestor
    directory has a licence file, else ``none`` with a null licence. A licence
    file has a match and is named like one; of several in a directory the one of the
    best sum counts, then the smaller path. cosine is that of the best matched paragraph.
    Null texts are empty; texts of any length are read whole; a null path has no directory and does
    not inherit. Repeated rows each get a row; other columns are ignored, whatever their
    names; no rows give no rows.
    """
    spark = files.sparkSession
    listed = _with_spdx(templates)
    vocabulary = sorted({t for _, ts in listed for t in ts}) or [""]
    rows = files.select(F.col(id_col).alias("id"), F.col(path_col).cast("string").alias("path"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("uid", F.md5("text"))  # a text's licence is its own, so equal texts are looked at once
    units = rows.select("uid", F.posexplode(_units(F.col("text"))).alias("unit", "words"))
    units = units.select("uid", "unit", F.expr(f"regexp_extract_all(lower(words), '{_TERM.replace(chr(92), chr(92) * 2)}', 0)").alias("terms")).where(F.size("terms") > 0)
    units = units.select("uid", "unit", F.size("terms").alias("n"), F.filter("terms", lambda t: t.isin(vocabulary)).alias("known"))

    # document frequencies over all units; the empty term stands for the unit itself
    seen = dict(units.select(F.explode(F.concat(F.array(F.lit("")), F.array_distinct("known"))).alias("t")).groupBy("t").count().collect())  # at most a row a term
    total = seen.get("", 0)
    idf = {t: math.log((1 + total) / (1 + seen.get(t, 0))) + 1 for t in vocabulary}
    unseen = math.log(1 + total) + 1
    vectors = []
    for k, (name, ts) in enumerate(listed):
        v = {t: ts.count(t) * idf[t] for t in set(ts)}
        size = math.sqrt(sum(x * x for x in v.values()))
        vectors += [(k, name, len(ts), t, x / size) for t, x in v.items()]
    weights = F.broadcast(_values(spark, vectors, "template", "license", "size", "t", "w"))  # as many rows as the templates have terms
    known_idf = F.broadcast(_values(spark, list(idf.items()), "t", "idf"))

    # no known term of a unit weighs more than here, so this leaves out no unit that reaches the cosine
    common = [t for t in vocabulary if idf[t] <= 0.35 * unseen] or [""]
    squares = 0.35**2 * _squares(F.filter("known", lambda t: t.isin(common))) + _squares(F.filter("known", lambda t: ~t.isin(common)))
    possible = (F.col("n") - F.size("known")) * (least * least) <= (1 - least * least) * squares
    near = staged(units.where(F.size("known") > 0).where(possible).dropDuplicates(["uid", "unit"]), "licence-units")
    # dealt once by unit, as all that is counted of a unit stays with it: neither terms nor products are dealt out
    dealt = near.repartition(partitions(spark), "uid", "unit")
    tf = dealt.select("uid", "unit", "n", F.size("known").alias("k"), F.explode("known").alias("t")).groupBy("uid", "unit", "n", "k", "t").agg(F.count("*").alias("tf")).join(known_idf, "t")
    tf = tf.withColumn("x", F.col("tf") * F.col("idf"))
    length = tf.groupBy("uid", "unit").agg(F.sqrt(F.sum(F.col("x") * F.col("x")) + F.max(F.col("n") - F.col("k")) * F.lit(unseen * unseen)).alias("length"))
    dots = tf.join(weights, "t").groupBy("uid", "unit", "template", "license", "size").agg(F.sum(F.col("x") * F.col("w")).alias("dot"))
    cosines = dots.join(length, ["uid", "unit"]).withColumn("cosine", F.round(F.col("dot") / F.col("length"), 9)).where(F.col("cosine") >= least)
    matched = cosines.groupBy("uid", "license", "template", "size").agg(F.max("cosine").alias("cosine"))
    sizes = {name: sum(len(ts) for other, ts in listed if other == name) for name in templates}
    whole = F.broadcast(_values(spark, list(sizes.items()), "license", "whole"))
    sums = matched.groupBy("uid", "license").agg(F.round(F.sum(F.col("size") * F.col("cosine") * F.col("cosine")), 6).alias("sum"), F.sum("size").alias("covered"), F.max("cosine").alias("cosine")).join(whole, "license")
    best = F.min(F.struct((-F.col("sum")).alias("down"), (-F.col("covered") / F.col("whole")).alias("share"), (-F.col("cosine")).alias("worse"), "license"))
    own = staged(sums.groupBy("uid").agg(best.alias("best")), "licence-own")
    drop_staged(near)

    where = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    base = F.regexp_extract("path", r"([^/]*)$", 1)
    named = rows.select("uid", "id", "path", where.alias("dir"))
    marks = named.where(F.col("path").isNotNull() & base.rlike(_NAMED)).join(own, "uid")
    marks = marks.groupBy(F.col("dir").alias("ancestor")).agg(F.min(F.struct("best.down", "path", "best.license", "best.worse")).alias("m"))
    dirs = named.where("path is not null").select("dir").distinct()
    steps = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/"))).alias("ancestor")).distinct()
    nearest = above.join(marks, "ancestor").groupBy("dir").agg(F.max(F.struct(F.length("ancestor").alias("depth"), "ancestor", F.col("m.license").alias("license"), (-F.col("m.worse")).alias("cosine"))).alias("up"))
    found = named.join(own, "uid", "left").join(nearest, "dir", "left")
    header = F.col("best").isNotNull()
    return found.select(
        "id", "path",
        F.when(header, F.col("best.license")).otherwise(F.col("up.license")).alias("license"),
        F.when(header, -F.col("best.worse")).otherwise(F.col("up.cosine")).alias("cosine"),
        F.when(header, "header").when(F.col("up").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~header, F.col("up.ancestor")).alias("from_dir"),
    )
