"""License scans: TF-IDF cosine to templates, then inheritance along the folder tree; DataFrame functions only.

Statements become sparse TF-IDF vectors over words and are compared with each template: titles, headers, short notices,
tags, and whole texts of the short licences. Statements of any file are its blocks of lines (cut at lines without a
letter), their sentences, and the parts of their single lines, which is where headers stand; a licence file, told by its
name, is one statement as a whole too. Document frequencies are counted over all files. A file has the licence of its
best statement. Licence files speak for their folder: it has the licence that most of them state, and a file without a
statement of its own inherits from its nearest ancestor folder that has one.
"""

from __future__ import annotations

import re
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, stored, table

_GNU = "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
_COPY = "You should have received a copy of the GNU {1} along with this {0}. If not, see <https://www.gnu.org/licenses/>."
_CC = "This work is licensed under a Creative Commons {0} 4.0 International License."
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
_MIT_REST = 'The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAME = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_REST = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_REST = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_NOTICE = ", provided that the above copyright notice and this permission notice appear in all copies."
# fixed values: by licence its one-line statements, titles, headers, and of the short licences the whole text; of those that
# run over pages (Apache, GNU, MPL, EPL, CC) the title and the paragraphs that name the licence
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "MIT License", "The MIT License (MIT)", "Licensed under the MIT License. See the LICENSE file in the project root for license information.", _MIT, f"{_MIT} {_MIT_REST}"],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.", "Apache License", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to You under the Apache License, Version 2.0",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.", "GNU General Public License", "GNU General Public License Version 3, 29 June 2007", "Licensed under the GPL.", "Licensed under the GNU General Public License, version 3.",
        _GNU.format("program", "General Public License"), _COPY.format("program", "General Public License"),
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 3.", "GNU Lesser General Public License", "GNU Lesser General Public License Version 3, 29 June 2007", "GNU Library General Public License", "Licensed under the LGPL.",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        _GNU.format("library", "Lesser General Public License"), _GNU.format("program", "Lesser General Public License"), _COPY.format("library", "Lesser General Public License"),
        "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
    ],
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3.", "GNU Affero General Public License", "GNU Affero General Public License Version 3, 19 November 2007", "Licensed under the AGPL.",
        _GNU.format("program", "Affero General Public License"), _COPY.format("program", "Affero General Public License"),
    ],
    "BSD": ["Redistributed under the BSD License.", "BSD License", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", _BSD, _BSD_SOURCE, _BSD_BINARY],
    "BSD-2-Clause": [f"{_BSD} 1. {_BSD_SOURCE} 2. {_BSD_BINARY} {_BSD_REST}"],
    "BSD-3-Clause": [_BSD_NAME, f"{_BSD} 1. {_BSD_SOURCE} 2. {_BSD_BINARY} 3. {_BSD_NAME} {_BSD_REST}"],
    "ISC": ["ISC License", "Licensed under the ISC License.", _ISC + _NOTICE, f"{_ISC}{_NOTICE} {_ISC_REST}"],
    "0BSD": [f"{_ISC}. {_ISC_REST}"],
    "MPL": [
        "Subject to the terms of the Mozilla Public License.", "Mozilla Public License", "Mozilla Public License Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "EPL": [
        "Eclipse Public License", "Eclipse Public License Version 2.0", "Licensed under the Eclipse Public License 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "BSL-1.0": [
        "Boost Software License", "Boost Software License Version 1.0 August 17th, 2003", "Distributed under the Boost Software License, Version 1.0.",
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
    ],
    "Zlib": [
        "zlib License",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ],
    "Artistic-2.0": ["The Artistic License 2.0", "Licensed under the Artistic License 2.0."],
    "CC0": ["CC0 1.0 Universal", "Licensed under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal"],
    "CC-BY": ["Licensed under CC BY 4.0.", "Creative Commons Attribution 4.0 International", "Attribution 4.0 International", _CC.format("Attribution")],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "Creative Commons Attribution-NonCommercial 4.0 International", "Attribution-NonCommercial 4.0 International", _CC.format("Attribution-NonCommercial")],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "Creative Commons Attribution-ShareAlike 4.0 International", "Attribution-ShareAlike 4.0 International", _CC.format("Attribution-ShareAlike")],
    "proprietary": ["All rights reserved.", "Proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited."],
}
# fixed values: identifiers in tags
TAGS = {
    "MIT": ["MIT"], "Apache-2.0": ["Apache-2.0"], "GPL": ["GPL-3.0-only", "GPL-3.0-or-later"], "LGPL": ["LGPL-3.0-only", "LGPL-3.0-or-later"], "AGPL": ["AGPL-3.0-only", "AGPL-3.0-or-later"], "BSD-2-Clause": ["BSD-2-Clause"], "BSD-3-Clause": ["BSD-3-Clause"],
    "ISC": ["ISC"], "MPL": ["MPL-2.0"], "EPL": ["EPL-2.0"], "Unlicense": ["Unlicense"], "BSL-1.0": ["BSL-1.0"], "Zlib": ["Zlib"], "Artistic-2.0": ["Artistic-2.0"], "CC0": ["CC0-1.0"], "CC-BY": ["CC-BY-4.0"],
    "CC-BY-NC": ["CC-BY-NC-4.0"], "CC-BY-SA": ["CC-BY-SA-4.0"],
}
#: Words that make a licence's name. Every statement is compared with all templates; a file's licence is its best one of
#: those whose name words it has, with another word (a line "License" is no "MIT License", nor is the German "mit"), its
#: nearest is the best one of all.
NAMES = {
    "mit", "apache", "gnu", "gpl", "lgpl", "agpl", "lesser", "library", "affero", "bsd", "isc", "mozilla", "mpl", "eclipse", "epl", "boost", "bsl", "zlib", "unlicense", "artistic",
    "cc", "cc0", "by", "nc", "sa", "attribution", "noncommercial", "sharealike", "reserved", "proprietary", "unencumbered",
}
#: Names of files that hold a folder's licence.
LICENSE_FILE = r"(?i)^(?:un)?licen[cs]es?(?:[-_.].*)?$|^copying(?:[-_.].*)?$|^notice(?:\.(?:txt|md))?$|^mit-license.*$"
THRESHOLD = 0.7


def _templates() -> dict[str, list[str]]:
    """The words of each template, by its name (licence/number)."""
    texts = {name: [*TEMPLATES.get(name, []), *(f"SPDX-License-Identifier: {tag}" for tag in TAGS.get(name, []))] for name in TEMPLATES}
    return {f"{name}/{i}": re.findall("[a-z0-9]+", text.lower()) for name, some in texts.items() for i, text in enumerate(some)}


def vectors(n: int = 0, df: dict[str, int] | None = None) -> tuple[list[tuple[str, str, float]], dict[str, float]]:
    """(template, word, weight) of unit vectors, and the idf of their words, where df of n files have a word."""
    bags = _templates()
    idf = {w: log((1 + n) / (1 + (df or {}).get(w, 0))) + 1 for b in bags.values() for w in b}
    rows = []
    for name, bag in bags.items():
        weight = {w: bag.count(w) * idf[w] for w in bag}
        norm = sum(x * x for x in weight.values()) ** 0.5
        rows += [(name, w, x / norm) for w, x in sorted(weight.items())]
    return rows, idf


def needed(rows: list[tuple[str, str, float]], idf: dict[str, float]) -> list[str]:
    """Words of which every statement at THRESHOLD has one: of each template its rarest ones, until the norm of the others,
    which no cosine of a statement without the former exceeds, is below THRESHOLD."""
    out = set()
    for name in {r[0] for r in rows}:
        rest = {w: x for n, w, x in rows if n == name}
        for w in sorted(rest, key=lambda w: (-idf[w], -rest[w], w)):
            if sum(x * x for x in rest.values()) ** 0.5 < THRESHOLD - 1e-5:
                break
            out.add(w)
            del rest[w]
    return sorted(out)


def most(rows: list[tuple[str, str, float]]) -> dict[str, float]:
    """The largest squared weight of each word in any template: their sum over a statement's words bounds its squared cosine."""
    out: dict[str, float] = {}
    for _, w, x in rows:
        out[w] = max(out.get(w, 0.0), x * x)
    return out


def _plain(text: Column) -> Column:
    """The words of a lower-case text with single spaces between."""
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def _statements(text: Column, whole: Column) -> Column:
    """The plain statements of a lower-case text; of a licence file (whole) the text without its copyright lines as well."""
    blocks = F.split(text, r"\n(?:[^a-z\n]*\n)+")
    sentences = F.flatten(F.transform(blocks, lambda b: F.split(b, r"[.!?]+(?=\s|$)")))
    parts = F.split(text, r"[.!?]+(?=\s|$)|\n")
    all_of_it = F.when(whole, F.array(F.regexp_replace(text, r"(?m)^\W*(?:\(c\)|copyright)\b.*$", ""))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.transform(F.concat(parts, sentences, blocks, all_of_it), _plain))


def is_license_file(path: Column) -> Column:
    return F.substring_index(path, "/", -1).rlike(LICENSE_FILE)


def stated(spark: SparkSession, files: DataFrame) -> DataFrame:
    """(file, license, cosine, nearest, nearest_cosine) of the files (file: their key, path, text) with a statement that
    reaches THRESHOLD; nearest is the licence of the nearest template, license that of the nearest one that the statement
    names, null where it names none; ties go by name.

    Two scans of the texts: one counts words over all files, one takes the statements. Only what cannot reach THRESHOLD
    is left out before the last step: a statement without any needed word, with too little weight on the templates'
    words, or with too many other words.
    """
    files = files.select("file", "path", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    # the empty word stands for the file: its count is their number
    words = files.select(F.explode(F.array_distinct(F.array_append(F.split("text", "[^a-z0-9]+"), F.lit("")))).alias("word"))
    df = stored(spark, words.groupBy("word").agg(F.count("*").alias("df")))
    known = {r[0]: r[1] for r in df.where(F.col("word").isin("", *vectors()[1])).collect()}
    n = known.get("", 0)
    rows, idf = vectors(n, known)
    some = F.lit(needed(rows, idf))
    bound = most(rows)
    template = spark.createDataFrame(rows, "template string, word string, weight double")
    names = spark.createDataFrame([(t, sum(w in NAMES for m, w, _ in rows if m == t)) for t in dict.fromkeys(r[0] for r in rows)], "template string, n_names long")

    weights = F.create_map(*(y for w, m in sorted(bound.items()) for y in (F.lit(w), F.struct(F.lit(m).alias("m"), F.lit(idf[w]).alias("idf")))))
    held = files.where(F.arrays_overlap(F.split("text", "[^a-z0-9]+"), some))
    held = held.select("file", F.explode(_statements(F.col("text"), is_license_file(F.col("path")))).alias("s"))
    held = held.withColumn("w", F.split("s", " ")).where(F.arrays_overlap("w", some))
    # of the words that templates have, the largest weights bound the cosine: by their norm, and then, with how often the
    # statement has them, by their dot product over the least norm that the statement can have (others weigh one at least)
    held = held.withColumn("k", F.array_intersect("w", F.lit(sorted(bound))))
    held = held.where(F.aggregate("k", F.lit(0.0), lambda a, w: a + weights[w]["m"]) >= (THRESHOLD - 1e-5) ** 2)
    tf = lambda w: F.size(F.filter("w", lambda y: y == w))
    xs = F.transform("k", lambda w: F.struct((tf(w) * weights[w]["idf"]).alias("x"), F.sqrt(weights[w]["m"]).alias("most")))
    zero = F.struct(F.lit(0.0).alias("dot"), F.lit(0.0).alias("norm"))
    held = held.withColumn("b", F.aggregate(xs, zero, lambda a, y: F.struct((a["dot"] + y["x"] * y["most"]).alias("dot"), (a["norm"] + y["x"] * y["x"]).alias("norm"))))
    held = held.where(F.col("b.dot") >= (THRESHOLD - 1e-5) * F.sqrt(F.col("b.norm") + F.size(F.array_distinct("w")) - F.size("k")))
    held = stored(spark, held.select("file", F.md5("s").alias("id"), "s"))
    each = held.groupBy("id").agg(F.first("s").alias("s")).withColumn("w", F.split("s", " "))

    # the templates' words give each dot product, and with them the norm is at least what it is if every other word had the
    # least idf there is; only what can still reach THRESHOLD is looked up in the counts. All this stays where an id is
    idfs = F.broadcast(spark.createDataFrame(sorted(idf.items()), "word string, idf double"))
    known_words = each.select("id", F.size(F.array_distinct("w")).alias("n"), F.explode("w").alias("word")).join(idfs, "word")
    bag = known_words.groupBy("id", "n", "word").agg((F.count("*") * F.first("idf")).alias("x"))
    bag = bag.groupBy("id", "n").agg((F.sum(F.col("x") * F.col("x")) + F.first("n") - F.count("*")).alias("least"), F.collect_list(F.struct("word", "x")).alias("xs"))
    dot = bag.select("id", "least", F.inline("xs")).join(F.broadcast(template), "word").groupBy("id", "least", "template")
    dot = dot.agg(F.sum(F.col("x") * F.col("weight")).alias("dot"), F.sum(F.col("word").isin(*NAMES).cast("long")).alias("n"), F.count("*").alias("k"))
    dot = dot.where(F.col("dot") / F.sqrt("least") >= THRESHOLD - 1e-5).join(F.broadcast(names), "template")
    dot = stored(spark, dot.select("id", "template", "dot", ((F.col("n") == F.col("n_names")) & (F.col("k") > 1)).alias("named")))

    few = each.join(dot.select("id").distinct(), "id", "left_semi").select("id", F.explode("w").alias("word")).groupBy("id", "word").agg(F.count("*").alias("tf"))
    x = F.col("tf") * (F.log((1.0 + n) / (1 + F.col("df"))) + 1)
    # written first, so that the join can split a word of many statements
    few = stored(spark, few)
    norm = few.join(df, "word").groupBy("id").agg(F.sqrt(F.sum(x * x)).alias("norm"))
    best = dot.join(norm, "id").withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("cosine") >= THRESHOLD)
    rank = F.struct((-F.col("cosine")).alias("c"), F.substring_index("template", "/", 1).alias("license"))
    best = stored(spark, best.groupBy("id").agg(F.min(F.when(F.col("named"), rank)).alias("m"), F.min(rank).alias("near")))
    out = held.select("file", "id").join(best, "id").groupBy("file").agg(F.min("m").alias("m"), F.min("near").alias("near"))
    out = stored(spark, out.select("file", F.col("m.license").alias("license"), (-F.col("m.c")).alias("cosine"), F.col("near.license").alias("nearest"), (-F.col("near.c")).alias("nearest_cosine")))
    drop(df, held, dot, few, best)
    return out


def folder(path):
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan(spark: SparkSession, files: DataFrame, *keys: str) -> DataFrame:
    """A row for each of files (path, text, keys, ...): keys, path, license, cosine, nearest, nearest_cosine, inherited_from.

    Only files named as LICENSE_FILE says speak for their folder. Null texts state nothing; a null path lies in no folder
    and has no licence; rows that share a path are judged each by its text; a folder's ties go by name; empty tables are
    fine, and other columns are not read.
    """
    files = files.select(*keys, "path", "text", F.struct(F.coalesce("path", F.lit("")).alias("path"), F.xxhash64("text").alias("tk")).alias("file"))
    found = stated(spark, files.select("file", "path", "text").where("path IS NOT NULL AND text IS NOT NULL"))
    votes = found.where(is_license_file(F.col("file.path")) & F.col("license").isNotNull()).groupBy(folder(F.col("file.path")).alias("dir"), "license").agg(F.count("*").alias("k"))
    dirs = votes.groupBy("dir").agg(F.min(F.struct((-F.col("k")).alias("k"), "license"))["license"].alias("d_license"))
    places = files.drop("text").join(found, "file", "left").drop("file").withColumn("dir", folder(F.col("path")))
    # the answer for each folder with files, once: its ancestors are as many as its path has parts
    wanted = files.select(folder(F.col("path")).alias("dir")).where("dir IS NOT NULL").distinct()
    up = wanted.select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("dir", "/"))), lambda n: F.array_join(F.slice(F.split("dir", "/"), 1, n), "/"))).alias("up"))
    near = up.join(dirs.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max(F.struct(F.length("up").alias("n"), "up", "d_license")).alias("m")).select("dir", F.col("m.up").alias("up"), "m.d_license")
    own = F.col("license").isNotNull()
    return places.join(near, "dir", "left").select(*keys, "path", F.coalesce("license", "d_license").alias("license"), "cosine", "nearest", "nearest_cosine", F.when(~own, F.col("up")).alias("inherited_from"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as the files of a tree: source/lang/shard of 50 ids/id; in place of a name, ids that 50, 1,000 and 10,000
    divide make a document the licence file of its shard, of source/lang and of source. Documents without an id lie in
    source/lang/unnumbered, by a digest of the text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("s"), F.coalesce("lang", F.lit("")).alias("l"), "text")
    id = F.col("doc_id")
    name = F.concat(F.lit("LICENSE-"), id.cast("string"))
    shard = F.concat_ws("/", "s", "l", F.floor(id / 50).cast("string"))
    path = F.when(id.isNull(), F.concat_ws("/", "s", "l", F.lit("unnumbered"), F.md5(F.coalesce("text", F.lit("")))))
    path = path.when(id % 10_000 == 0, F.concat_ws("/", "s", name)).when(id % 1_000 == 0, F.concat_ws("/", "s", "l", name)).when(id % 50 == 0, F.concat_ws("/", shard, name)).otherwise(F.concat_ws("/", shard, id.cast("string")))
    return scan(spark, docs.select("doc_id", path.alias("path"), "text"), "doc_id")
