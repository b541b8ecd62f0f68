"""Licence scans: Dice coefficient over word bigrams against templates, with DataFrame functions only.

A unit is a sentence, a line, a paragraph or a whole text. A unit with a bigrams can reach
the threshold t with a template of b bigrams only if b lies within a t / (2 - t)
and a (2 - t) / t, and only if it shares t (a + b) / 2 of them; both bounds
prune before any unit meets a template.
"""

from __future__ import annotations

import re
from collections import Counter
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: licence notices and texts, in their published wording
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "This work is dedicated to the public domain under the CC0 1.0 Universal Public Domain Dedication.",
    "MIT-full": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "BSD-2-Clause-full": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "ISC-full": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "Zlib-full": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

#: What parts the sentences of a line.
SENTENCE_END = r"([.!?;:])[ \t]+"
_BETWEEN = r"[^\p{L}\p{N}]+"


def bigrams(text: str) -> Counter:
    """Counted word bigrams of a template, normalised as the units are."""
    words = re.findall(r"[^\W_]+", text.lower())
    return Counter(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))


def telling_words(counted: dict[str, Counter], threshold: float) -> list[str]:
    """Words of which every unit at the threshold holds one.

    Such a unit shares t / (2 - t) of a template's bigrams at least, so it
    holds one of any words that stand in more bigrams than may be missing.
    Of each template the longest words are taken, until they are enough.
    """
    out: set[str] = set()
    for grams in counted.values():
        total = sum(grams.values())
        missing = total - ceil(total * threshold / (2 - threshold) - 1e-9)
        left = dict(grams)
        for word in sorted({w for g in grams for w in g.split(" ")}, key=lambda w: (w not in out, -len(w), w)):
            if total - sum(left.values()) > missing:
                break
            hit = [g for g in left if word in g.split(" ")]
            if hit:
                out.add(word)
                for g in hit:
                    del left[g]
    return sorted(out)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _BETWEEN), lambda w: w != "")


def license_hits(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, unit, unit_no, license_id, dice): for each unit with a template at the threshold, the best one.

    unit is ``line``, ``sentence`` (of a line of two or more; sentences end
    with a point, question or exclamation mark, semicolon or colon before a
    blank), ``paragraph`` (between blank lines, of two lines or more) or
    ``file`` (a text of two paragraphs or more); unit_no counts from 0, for
    sentences within the text. Ties go to the smaller licence id. Null and
    empty texts and units of fewer than two words match nothing. Very long
    texts are read whole, each once. Rows repeat as they do in ``docs``: a
    repeated id yields its own units' rows. Ids may be null. Other columns
    aren't read, so their names can't clash. An empty table gives an empty
    result. The templates are a fixed list and travel with the plan.
    """
    spark = docs.sparkSession
    counted = {k: bigrams(t) for k, t in (templates or TEMPLATES).items()}
    counted = {k: c for k, c in counted.items() if c}
    sizes = {k: sum(c.values()) for k, c in counted.items()}
    known = sorted({b for c in counted.values() for b in c})
    low = min((ceil(n * threshold / (2 - threshold)) for n in sizes.values()), default=1)
    high = max((int(n * (2 - threshold) / threshold) for n in sizes.values()), default=0)

    text = F.col("__text")
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    telling = telling_words(counted, threshold)
    if not telling:
        return docs.select(F.col(id_col), F.lit("").alias("unit"), F.lit(0).cast("long").alias("unit_no"), F.lit("").alias("license_id"), F.lit(0.0).alias("dice")).where("false")
    # texts without any of these words hold no unit that could match
    may = F.lower(text).rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(telling)})(?![\p{{L}}\p{{N}}])")
    rows = rows.where(text.isNotNull() & (text != "") & may)
    blank = r"\n[ \t\r]*\n"
    numbered = lambda unit, parts: F.transform(parts, lambda body, no: F.struct(F.lit(unit).alias("unit"), no.alias("no"), body.alias("body")))
    lines = F.split(text, "\n")
    # longer and shorter units only where they aren't the same as a line
    sentences = F.flatten(F.transform(lines, lambda line: F.filter(F.array(F.regexp_replace(line, SENTENCE_END, "$1\u001f")), lambda x: F.contains(x, F.lit("\u001f")))))
    sentences = F.flatten(F.transform(sentences, lambda x: F.split(x, "\u001f")))
    paragraphs = F.filter(numbered("paragraph", F.split(text, blank)), lambda u: F.contains(F.trim(u["body"], F.lit("\n")), F.lit("\n")))
    files = F.when(F.regexp_like(text, F.lit(blank)), F.array(text)).otherwise(F.array().cast("array<string>"))
    units = F.concat(numbered("line", lines), numbered("sentence", sentences), paragraphs, numbered("file", files))
    units = rows.select("__id", F.explode(units).alias("u")).select("__id", "u.unit", "u.no", "u.body")

    words = units.select("__id", "unit", "no", _words(F.col("body")).alias("w")).where((F.size("w") - 1).between(low, high))
    pairs = F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    found = words.select("__id", "unit", "no", (F.size("w") - 1).alias("a"), F.filter(pairs, lambda b: b.isin(known)).alias("hits"))
    # t (a + b) / 2 shared at least, with b at least a t / (2 - t)
    share = threshold * (1 + threshold / (2 - threshold)) / 2
    found = found.where(F.size("hits") >= F.greatest(F.ceil(F.col("a") * share - 1e-9), F.lit(1)))
    found = found.withColumn("unit_key", F.monotonically_increasing_id())

    rows_t = [(k, sizes[k], b, n) for k, c in counted.items() for b, n in c.items()]
    table = spark.createDataFrame(rows_t, "license_id string, b int, bigram string, n int").hint("broadcast")
    each = found.select("unit_key", "__id", "unit", "no", "a", F.explode("hits").alias("bigram")).groupBy("unit_key", "__id", "unit", "no", "a", "bigram").agg(F.count("*").alias("m"))
    near = each.join(table, "bigram").where((F.col("b") >= F.col("a") * (threshold / (2 - threshold)) - 1e-9) & (F.col("b") * (threshold / (2 - threshold)) <= F.col("a") + 1e-9))
    shared = near.groupBy("unit_key", "__id", "unit", "no", "a", "license_id", "b").agg(F.sum(F.least("m", "n")).alias("k"))
    dice = shared.withColumn("dice", 2 * F.col("k") / (F.col("a") + F.col("b"))).where(F.col("dice") >= threshold)
    best = dice.groupBy("unit_key", "__id", "unit", "no").agg(F.min(F.struct((-F.col("dice")).alias("d"), "license_id")).alias("m"))
    return best.select(F.col("__id").alias(id_col), "unit", F.col("no").cast("long").alias("unit_no"), "m.license_id", (-F.col("m.d")).alias("dice"))
