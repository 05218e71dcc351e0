"""Licence scan: statements are matched to templates, files without one inherit from their directories.

Every line of a text is a statement, and so are its blocks between blank lines and the whole text, as
a notice may be wrapped and a file may be a licence as a whole.  Statements and the templates (notices, headers and
bodies of licences) are sparse TF-IDF vectors, with document frequencies over all lines of the corpus and the
templates; dot products come from a join on terms.  Only statements are scored that can reach the least cosine: it is at
most the norm of the part of the (normed) template whose terms the statement has.
A directory has the licence of the licensed file that stands for it, and a file without a
statement takes that of the nearest directory above it, found by joining the ancestors of each distinct
directory.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.session import materialise

TERM = r"[a-z0-9]+"
LEAST = 0.5  # cosine from which a statement is of a template's licence

#: Notices, file headers and bodies of public licences, as they are commonly put.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("EPL-2.0", "Made available under the terms of the Eclipse Public License 2.0."),
    ("BSD-2-Clause", "Distributed under the simplified BSD 2-Clause License."),
    ("BSD-3-Clause", "Distributed under the BSD 3-Clause License."),
    ("ISC", "Released under the ISC License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Licensed under CC0 1.0, no rights reserved."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("proprietary", "Copyright. All rights reserved."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING "
        "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
        "EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
        "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written permission.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
        "PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, "
        "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION "
        "OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
        "SOFTWARE.",
    ),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License.",
    ),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later "
        "version.",
    ),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version.",
    ),
    (
        "LGPL-3.0",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version.",
    ),
    (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means.",
    ),
    (
        "Zlib",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable "
        "for any damages arising from the use of this software. Permission is granted to anyone to use this software for any "
        "purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
        "restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original "
        "software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated "
        "but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being "
        "the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
)


def lines_of(text: Column) -> Column:
    """The distinct lines of a text, trimmed; empty for null."""
    lines = F.array_distinct(F.transform(F.split(text, "\n", -1), lambda x: F.trim(x)))
    return F.coalesce(lines, F.array().cast("array<string>"))


def statements(text: Column) -> Column:
    """The distinct lines, blocks between blank lines and the whole of a text, white space evened out."""
    blocks = F.concat(F.split(text, "\n", -1), F.split(text, r"\n[ \t\r]*\n", -1), F.array(text))
    even = F.transform(blocks, lambda x: F.trim(F.regexp_replace(x, r"[ \t\r\n]+", " ")))
    return F.coalesce(F.array_distinct(even), F.array().cast("array<string>"))


def _words(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(f"({TERM})"))


def term_rarity(text: DataFrame) -> DataFrame:
    """(term, idf) over the distinct lines of every text (one column) and the templates."""
    lines = text.select(F.explode(lines_of(F.col("text"))).alias("line")).where("line <> ''")
    lines = lines.unionByName(text.sparkSession.createDataFrame([(t,) for _, t in TEMPLATES], "line string"))
    words = lines.select(F.explode(F.array_append(F.array_distinct(_words(F.col("line"))), "")).alias("term"))
    found = materialise(words.groupBy("term").agg(F.count("*").alias("n")), "terms")  # the empty term counts the lines
    total = found.where("term = ''").first()["n"]
    return found.where("term <> ''").select("term", (F.ln((F.lit(total) + 1.0) / (F.col("n") + 1.0)) + 1.0).alias("idf"))


def template_weights(rarity: DataFrame) -> list[dict[str, float]]:
    """The normed vector of every template."""
    counts = [Counter(re.findall(TERM, t.lower())) for _, t in TEMPLATES]
    idf = dict(rarity.where(F.col("term").isin(sorted(set().union(*counts)))).collect())
    raw = [{w: (1.0 + math.log(n)) * idf[w] for w, n in c.items()} for c in counts]
    return [{w: x / math.sqrt(sum(y * y for y in v.values())) for w, x in v.items()} for v in raw]


def any_word(words: set[str]) -> str:
    """A regex of whole words by their common beginnings, so that a text is not compared with each."""

    def branch(ends: list[str]) -> str:
        firsts: dict[str, list[str]] = {}
        for w in ends:
            firsts.setdefault(w[:1], []).append(w[1:])
        parts = [c + branch(rest) if c else "" for c, rest in sorted(firsts.items(), reverse=True)]  # the longest way first
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    return f"(?<![a-z0-9]){branch(sorted(words))}(?![a-z0-9])" if words else "(?!)"


def can_match(weights: list[dict[str, float]], least: float) -> tuple[set[str], list[dict[str, float]]]:
    """(words, squares): without one of the words no template's squared weights come to ``least`` squared."""
    squares, needed = [{w: x * x for w, x in v.items()} for v in weights], set()
    for v in squares:
        left = 0.0
        for w, x in sorted(v.items(), key=lambda item: (item[1], item[0])):
            left += x
            if left >= least * least - 1e-5:  # scores are rounded
                needed.add(w)
    return needed, squares


def candidates(text: Column, weights: list[dict[str, float]], least: float = LEAST) -> Column:
    """The statements of a text that can reach ``least``."""
    needed, squares = can_match(weights, least)
    some, known = any_word(needed), F.lit(f"({any_word(set().union(*squares))})")

    def reaches(line: Column) -> Column:
        def any_of(words: Column) -> Column:
            shared = [reduce(Column.__add__, [F.when(F.array_contains(words, w), x).otherwise(0.0) for w, x in v.items()]) for v in squares]
            return F.greatest(*shared) >= least * least - 1e-5

        return F.exists(F.array(F.array_distinct(F.regexp_extract_all(F.lower(line), known))), any_of)

    # a text without such a term is not cut up
    hits = F.filter(statements(text), lambda x: F.lower(x).rlike(some))
    return F.when(F.lower(text).rlike(some), F.filter(hits, reaches)).otherwise(F.array().cast("array<string>"))


def score_lines(lines: DataFrame, rarity: DataFrame, weights: list[dict[str, float]], least: float = LEAST) -> DataFrame:
    """(line, license, score) of the distinct lines that match a template.

    The best cosine decides, ties go to the licence that sorts first.  Scores are rounded to 6 places.
    """
    spark = lines.sparkSession
    named = materialise(lines.select("line", F.xxhash64("line").alias("id")), "lines")
    words = named.select("id", F.explode(_words(F.col("line"))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    weighed = words.join(rarity, "term").select("id", "term", ((1.0 + F.ln("tf")) * F.col("idf")).alias("w"))
    weighed = materialise(weighed, "weights")
    norms = weighed.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    rows = [(i, TEMPLATES[i][0], w, x) for i, v in enumerate(weights) for w, x in v.items()]
    # the templates are a fixed list, so their weights are few rows
    template = spark.createDataFrame(rows, "template int, license string, term string, tw double")
    dots = weighed.join(F.broadcast(template), "term")
    sums = dots.groupBy("id", "template", "license").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    scored = sums.join(norms, "id").withColumn("score", F.round(F.col("dot") / F.col("norm"), 6))
    best = scored.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("minus"), "license")).alias("b"))
    best = best.select("id", "b.license", (-F.col("b.minus")).alias("score")).where(F.col("score") >= least)
    return named.join(best, "id").select("line", "license", "score")


def directory(path: Column) -> Column:
    """The path without its last part; empty at the root."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def ancestors(folder: Column) -> Column:
    """The folder and all folders above it, the root included."""
    parts = F.split(folder, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def scan(files: DataFrame) -> DataFrame:
    """path, license, score, origin and from_dir of every file (columns path, rank, text).

    ``origin`` is ``own`` (the best statement of the file, ties to the licence that sorts first), ``inherited`` or
    ``none``.  In a directory the licensed file of smallest rank (then path) stands for it.  A null path
    counts as empty, rows of equal path as one file; a null or empty text states nothing.
    """
    path = F.coalesce("path", F.lit(""))
    rarity = term_rarity(files.select("text"))
    weights = template_weights(rarity)
    listed = files.select(path.alias("path"), "rank", candidates(F.col("text"), weights).alias("lines"))
    found = materialise(listed.select("path", "rank", F.explode("lines").alias("line")), "statements")
    scores = score_lines(found.select("line").distinct(), rarity, weights)
    by_path = found.join(scores, "line").groupBy("path")
    best = by_path.agg(F.min(F.struct((-F.col("score")).alias("minus"), "license")).alias("b"), F.min("rank").alias("rank"))
    own = materialise(best.select("path", "rank", "b.license", (-F.col("b.minus")).alias("score")), "licensed")

    place = directory(F.col("path")).alias("dir")
    first = F.min_by(F.struct("license", "score"), F.struct("rank", "path"))
    standing = own.select("*", place).groupBy("dir").agg(first.alias("own"))
    standing = materialise(standing.select(F.col("dir").alias("from_dir"), "own.*"), "directories")
    places = files.select(directory(path).alias("dir")).distinct()
    above = places.select("dir", F.explode(ancestors(F.col("dir"))).alias("from_dir")).distinct()
    nearest = above.join(standing, "from_dir").groupBy("dir")
    nearest = nearest.agg(F.max_by(F.struct("license", "score", "from_dir"), F.length("from_dir")).alias("up"))
    own_rows = own.select("path", F.struct("license", "score").alias("mine"))
    rows = files.drop("text").withColumn("path", path).withColumn("dir", directory(path))
    joined = rows.join(own_rows, "path", "left").join(materialise(nearest, "nearest"), "dir", "left")
    mine = F.col("mine").isNotNull()
    return joined.select(
        *[F.col(f"`{c}`") for c in rows.columns if c not in ("dir", "path")],
        "path",
        F.coalesce(F.col("mine.license"), F.col("up.license")).alias("license"),
        F.coalesce(F.col("mine.score"), F.col("up.score")).alias("score"),
        F.when(mine, "own").when(F.col("up").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~mine, F.col("up.from_dir")).alias("from_dir"),
    )
