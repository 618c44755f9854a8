"""Licence scan: TF-IDF cosine of notices to templates, then inheritance along paths.

Units are the lines and the paragraphs of a text that name a licence at all, and windows of
its words around every word that can belong to a notice: for each length of a short
template all windows of that length, for longer ones windows of 16 to 256 words, a quarter
of their length apart. So a notice is found within a longer line or an unbroken text, and a
text of n words has at most 30 n words in units, whatever its length.

A unit's and a template's words are weighted by frequency and inverse document frequency
over all documents; words in no template count as found in one document, so foreign text
lowers the cosine. A unit is compared once however many documents hold it, under its hash.
A cosine can't exceed the share of a unit's length that lies in template words, so most
units are never compared with a template. A document whose best unit reaches ``MIN_COSINE``
has that template's licence. The others take the licence of the nearest directory above
them that has a licence file, found by joining the ancestors of the distinct directories
with the directories that have one.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.session import checkpoint

MIN_COSINE = 0.75

#: What a text must hold to have a notice, and how a word around which windows are laid begins; every template has both.
NOTICE = r"(?i)licen[sc]e|copyright|permission is|redistribution|public domain|warrant"
NOTICE_WORD = "^(licen[sc]e|copyright|permission|redistribution|domain|warrant)"
#: What is between words; a point is part of one only within it.
WORD = "[^a-z0-9.+]+|[.]+(?:[^a-z0-9.+]+|$)"
#: (length, distance) of windows for templates of more than SHORT words; shorter ones have windows of their own length.
SHORT = 12
WINDOWS = ((16, 2), (32, 2), (64, 8), (128, 32), (256, 64))

#: Short forms, standard notices and texts of common licences.
TEMPLATES = {
    'Apache-2.0': (
        'Licensed under the Apache License, Version 2.0.',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    'MIT': (
        'Released under the MIT License.',
        'This project is licensed under the MIT License.',
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    'GPL-3.0': (
        'This work is licensed under the GNU General Public License, version 3.',
        'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.',
        'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.',
    ),
    'GPL-2.0': (
        'This work is licensed under the GNU General Public License, version 2.',
        'This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.',
        'This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.',
    ),
    'LGPL-3.0': (
        'Licensed under the GNU Lesser General Public License, version 3.',
        'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.',
    ),
    'LGPL-2.1': (
        'Licensed under the GNU Lesser General Public License, version 2.1.',
        'This program is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.',
    ),
    'AGPL-3.0': (
        'Licensed under the GNU Affero General Public License, version 3.',
        'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.',
    ),
    'BSD-2-Clause': (
        'Licensed under the BSD 2-Clause License.',
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ),
    'BSD-3-Clause': (
        'Licensed under the BSD 3-Clause License.',
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met',
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ),
    'ISC': (
        'Licensed under the ISC License.',
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ),
    'Zlib': (
        'Licensed under the zlib License.',
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    'Unlicense': (
        'Released into the public domain under the Unlicense.',
        'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.',
    ),
    'BSL-1.0': (
        'Distributed under the Boost Software License, Version 1.0.',
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so',
    ),
    'EPL-2.0': (
        'This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.',
    ),
    'MPL-2.0': (
        'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.',
        'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.',
    ),
    'CC-BY-4.0': (
        'Licensed under CC BY 4.0.',
        'This work is licensed under a Creative Commons Attribution 4.0 International License.',
    ),
    'CC-BY-SA-4.0': (
        'Licensed under CC BY-SA 4.0.',
        'This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.',
    ),
    'CC-BY-NC-4.0': (
        'Licensed under CC BY-NC 4.0.',
        'This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.',
    ),
    'CC0-1.0': (
        'This work is dedicated to the public domain under CC0 1.0.',
    ),
}


def template_words() -> list[tuple[str, int, str, int]]:
    """(licence, template, word, frequency): a fixed table, so its size is bounded."""
    found = []
    for number, (name, text) in enumerate((n, t) for n, texts in TEMPLATES.items() for t in texts):
        found += [(name, number, w, n) for w, n in Counter(x for x in re.split(WORD, text.lower()) if x).items()]
    return found


def window_sizes() -> list[tuple[int, int]]:
    """(length, distance) of the windows."""
    lengths = Counter()
    for _, number, _, n in template_words():
        lengths[number] += n
    return [(n, 1) for n in sorted({n for n in lengths.values() if n <= SHORT})] + list(WINDOWS)


def default_path(id_col: str = "doc_id") -> Column:
    """documents has no paths: source, language and the id's thousands and hundreds stand for directories."""
    part = lambda n: F.coalesce(F.floor(F.col(id_col) / n).cast("string"), F.lit("none"))
    return F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), part(1000), part(100), F.coalesce(F.col(id_col).cast("string"), F.lit("none")))


def units_of(text: str) -> Column:
    """The units of the column named text, each an array of words; lines, paragraphs and windows may repeat each other."""
    words = lambda x: f"filter(split(lower({x}), r'{WORD}'), w -> w <> '')"
    bound = lambda value, name, inner: f"get(transform(array({value}), {name} -> {inner}), 0)"
    starts = lambda size, step: f"array_distinct(flatten(transform(v.pos, p -> transform(sequence(cast(greatest(0, ceil((p - {size} + 1) / {step})) as int), p div {step}), k -> k * {step}))))"
    windows = ", ".join(f"transform({starts(size, step)}, b -> slice(v.words, cast(b as int) + 1, {size}))" for size, step in window_sizes())
    pieces = f"transform(filter(concat(split(`{text}`, '\n'), split(`{text}`, '\n[ \t]*\n')), x -> x rlike r'{NOTICE}'), x -> {words('x')})"
    positions = f"filter(transform(w, (x, i) -> if(x rlike r'{NOTICE_WORD}', i, null)), i -> i is not null)"
    every = bound(words(f"`{text}`"), "w", bound(f"named_struct('words', w, 'pos', {positions})", "v", f"concat({pieces}, {windows})"))
    return F.when(F.col(text).rlike(NOTICE), F.expr(every))


def _key(unit: Column) -> Column:
    return F.md5(F.array_join(unit, " ").cast("binary"))


def notices(docs: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """(key, licence, score): each different unit of docs (text) with its best template of at least min_cosine, under the hash of its words."""
    spark = docs.sparkSession
    words = template_words()
    vocabulary = sorted({w for *_, w, _ in words})
    held = F.array_intersect(F.array_distinct(F.split(F.lower("text"), WORD)), F.array(*(F.lit(w) for w in vocabulary)))
    counts = dict(docs.select(F.explode(held).alias("word")).groupBy("word").count().collect())
    total = docs.count()
    idf = {w: math.log((total + 1) / (counts.get(w, 0) + 1)) + 1 for w in vocabulary}
    rare = math.log((total + 1) / 2) + 1
    norms: dict[int, float] = {}
    for _, number, w, n in words:
        norms[number] = norms.get(number, 0.0) + (n * idf[w]) ** 2
    weighted = spark.createDataFrame([(name, number, w, n * idf[w] / math.sqrt(norms[number]), idf[w]) for name, number, w, n in words], "licence string, template int, word string, weight double, idf double")
    units = docs.where(F.col("text").rlike(NOTICE)).select(F.explode(units_of("text")).alias("unit"))
    units = units.groupBy(_key(F.col("unit")).alias("key")).agg(F.any_value("unit").alias("unit"))
    terms = units.select("key", F.explode("unit").alias("word")).groupBy("key", "word").agg(F.count(F.lit(1)).alias("n"))
    terms = terms.join(F.broadcast(weighted.select("word", "idf").distinct()), "word", "left").withColumn("value", F.col("n") * F.coalesce("idf", F.lit(rare)))
    terms = checkpoint(terms.select("key", "word", "value", F.col("idf").isNotNull().alias("known")))
    square = F.col("value") * F.col("value")
    norm = terms.groupBy("key").agg(F.sqrt(F.sum(square)).alias("norm"), F.sqrt(F.sum(F.when(F.col("known"), square))).alias("most"))
    norm = checkpoint(norm.where(F.col("most") >= (min_cosine - 1e-6) * F.col("norm")).select("key", "norm"))
    dots = terms.where("known").join(norm, "key").join(F.broadcast(weighted.drop("idf")), "word").groupBy("key", "licence", "template", "norm").agg(F.sum(F.col("value") * F.col("weight")).alias("dot"))
    scored = dots.withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("score") >= min_cosine)
    best = scored.groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("minus"), "licence")).alias("best"))
    return best.select("key", F.col("best.licence").alias("licence"), (-F.col("best.minus")).alias("score"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: Column | None = None, licence_file: Column | None = None, min_cosine: float = MIN_COSINE) -> DataFrame:
    """(id_col, path, licence, origin, score, licence_dir), one row per row of docs.

    origin is ``notice`` where the text itself has one, ``inherited`` where a directory
    above gives it (licence_dir; the root is the empty path), else ``none`` with a null
    licence. licence_file says which documents with a notice speak for their directory and
    what is below it; without it the one with the smallest id of each directory does, as
    documents have no file names (a null id comes last, of equal ids the smallest path, then
    the first licence by name). Ties between templates go to the first name, between units
    to the higher score. Null text has no notice; rows that share an id are rows of their
    own, each with its own text's licence; other columns are ignored; an empty table gives
    no rows.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), (path if path is not None else default_path(id_col)).alias("path"), (licence_file if licence_file is not None else F.lit(True)).alias("speaks"))
    rows = rows.withColumn("dir", F.regexp_replace("path", "/?[^/]*$", ""))
    known = checkpoint(notices(rows.select("text"), min_cosine))
    # rows with the same units have the same licence, whatever their ids
    narrow = checkpoint(rows.select("_id", "path", "dir", "speaks", F.array_sort(F.array_distinct(F.transform(units_of("text"), _key))).alias("units")).withColumn("held", F.md5(F.array_join("units", ",").cast("binary"))))
    lists = narrow.where(F.size("units") > 0).groupBy("held").agg(F.any_value("units").alias("units")).select("held", F.explode("units").alias("key"))
    best = lists.join(known, "key").groupBy("held").agg(F.min(F.struct((-F.col("score")).alias("minus"), "licence")).alias("best"))
    best = checkpoint(best.select("held", F.col("best.licence").alias("licence"), (-F.col("best.minus")).alias("score")))
    plain = narrow.where(F.coalesce(F.size("units"), F.lit(0)) <= 0).select("_id", "path", "dir", "speaks", F.lit(None).cast("string").alias("licence"), F.lit(None).cast("double").alias("score"))
    told = narrow.where(F.size("units") > 0).join(best, "held", "left").select("_id", "path", "dir", "speaks", "licence", "score")
    of_dir = told.where("speaks and licence is not null").groupBy("dir").agg(F.min(F.struct(F.col("_id").isNull().alias("last"), "_id", "path", "licence")).alias("file")).select(F.col("dir").alias("licence_dir"), F.col("file.licence").alias("above"))
    parts = F.split("dir", "/")
    above = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))
    dirs = narrow.select("dir").distinct().select("dir", F.explode(F.array_distinct(above)).alias("licence_dir"))
    nearest = dirs.join(of_dir, "licence_dir").groupBy("dir").agg(F.max(F.struct(F.length("licence_dir").alias("depth"), "licence_dir", "above")).alias("near"))
    nearest = checkpoint(nearest.select("dir", "near.licence_dir", "near.above"))
    every = plain.union(told).join(nearest, "dir", "left")
    has = F.col("licence").isNotNull()
    return every.select(
        F.col("_id").alias(id_col),
        "path",
        F.coalesce("licence", "above").alias("licence"),
        F.when(has, "notice").when(F.col("above").isNotNull(), "inherited").otherwise("none").alias("origin"),
        "score",
        F.when(~has & F.col("above").isNotNull(), F.col("licence_dir")).alias("licence_dir"),
    )
