"""Operator 8: license scan by diagonal voting.

Every pair of neighbouring words of a document (a rolling 2-gram, as a 64-bit
hash) is joined to the places of the same 2-gram in a set of license templates.
A hit at document word i and template word j lies on the diagonal i - j; a
passage that repeats the template puts all its hits on one diagonal, and a
passage with a word added or left out on a few neighbouring ones.  Every hit
is verified word by word.  Hits are gathered per diagonal as bit masks of template
places, several masks for a long template; neighbouring diagonals are merged, and
a span counts if it covers enough of the template.  The short base phrases are
templates too: all their 2-grams must stand on one diagonal.  Templates are opening
sentences and whole texts, so a notice and a license that is printed out get
labels of their own.

DataFrame functions only; the template side has a fixed number of rows.

Defined results: null and empty texts have no words, no labels (empty strings)
and score 0.  One result row per input row: repeated rows (same id and text)
repeat their result.  Rows without an id keep a null id.  Other input columns
are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from souk.llm.common import lower_ascii, table

#: The base phrases and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Opening sentences of well-known public license notices, by label.
NOTICES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted"
           " provided that the following conditions are met",
    "cc-by-4.0": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "cc0-1.0": "to the extent possible under law the author has waived all copyright and related or"
               " neighboring rights to this work",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the"
                  " gnu general public license as published by the free software foundation",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee"
           " is hereby granted",
    "mit-notice": "permission is hereby granted free of charge to any person obtaining a copy of this software and"
                  " associated documentation files the software to deal in the software without restriction",
    "mit-release": "released under the mit license",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
}

#: Whole texts of short public licenses, by label (without names, years and titles).
TEXTS = {
    "mit-text": """
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
        and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS
        PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
        HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
        ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc-text": """
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
        PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
        OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
        CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
        CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
        SOFTWARE.""",
    "bsd-text": """
        Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
        PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
        INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
        GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
        LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
        OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "zlib-text": """
        This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for
        any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the
        original software. If you use this software in a product, an acknowledgment in the product documentation would be
        appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
        misrepresented as being the original software. 3. This notice may not be removed or altered from any source
        distribution.""",
    "apache-2.0-notice": """
        Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
    "gpl-3.0-notice": """
        This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
        details. You should have received a copy of the GNU General Public License along with this program.""",
}

NON_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Template places in a mask.
MASK = 60
#: Joined value of the one row that every document sends along.
DOC_ROW = 0x6C6963656E736573


@dataclass(frozen=True)
class Params:
    #: A notice counts if its merged span covers this share of the template's 2-grams.
    coverage: float = 0.75
    #: Diagonals this close are merged (words added or left out between hits).
    near: int = 2


def words_in(text: str) -> list[str]:
    return [w for w in re.split(NON_WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]


def templates() -> list[tuple[int, str, bool, list[str]]]:
    """(number, label, is a base phrase, words)."""
    out = [(label, True, phrase.split()) for phrase, label in BASE_PHRASES.items()]
    out += [(label, False, words_in(text)) for label, text in (NOTICES | TEXTS).items()]
    return [(n, *t) for n, t in enumerate(out)]


def gram(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b)


def template_places(spark: SparkSession) -> DataFrame:
    rows = [(n, len(words) - 1, base, place, words[place], words[place + 1])
            for n, _, base, words in templates() for place in range(len(words) - 1)]
    places = spark.createDataFrame(rows, "template int, grams int, base boolean, place int, a string, b string")
    places = places.select("template", "grams", "base", "place", "a", "b", gram(F.col("a"), F.col("b")).alias("gram"))
    none = F.lit(None).cast("string")
    doc_row = spark.range(1).select(F.lit(-1).alias("template"), F.lit(0).alias("grams"), F.lit(False).alias("base"), F.lit(0).alias("place"),
                                    none.alias("a"), none.alias("b"), F.lit(DOC_ROW).cast("long").alias("gram"))
    return places.unionByName(doc_row)


def scan(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score and spans (label, start, coverage of every verified span)."""
    spark = docs.sparkSession
    words = F.filter(F.split(lower_ascii(F.coalesce("text", F.lit(""))), NON_WORD), lambda w: w != "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"),
                       words.alias("words")).withColumn("n_words", F.size("words").cast("long"))
    pairs = F.when(F.col("n_words") >= 2, F.transform(
        F.sequence(F.lit(0), F.size("words") - 2),
        lambda i: gram(F.get(F.col("words"), i), F.get(F.col("words"), i + 1))))
    grams = F.concat(F.array(F.lit(DOC_ROW).cast("long")), F.coalesce(pairs, F.array().cast("array<long>")))
    each = rows.select("doc_id", "text_hash", "n_words", "words", F.posexplode(grams).alias("at", "gram"))
    hits = each.join(F.broadcast(template_places(spark)), "gram")  # a fixed table of about 1,300 rows
    hits = hits.where((F.col("template") < 0) | ((F.get("words", F.col("at") - 1) == F.col("a")) & (F.get("words", F.col("at")) == F.col("b"))))

    key = ["doc_id", "text_hash"]
    diagonals = (hits.withColumn("diagonal", F.when(F.col("template") >= 0, F.col("at") - 1 - F.col("place")).otherwise(0))
                 .groupBy(*key, "n_words", "template", "grams", "base", "diagonal", F.expr(f"place div {MASK}").cast("int").alias("part"))
                 .agg(F.bit_or(F.expr(f"shiftleft(1L, place % {MASK})")).alias("mask"), F.count("*").alias("hits")))
    # base phrases and document rows stand alone; notices merge with their neighbours
    alone = F.col("base") | (F.col("template") < 0)
    along = Window.partitionBy(*key, "template").orderBy("diagonal", "part")
    gap = F.col("diagonal") - F.lag("diagonal").over(along)
    runs = (diagonals.withColumn("opens", F.when(gap.isNull() | (gap > F.when(alone, 0).otherwise(params.near)), 1).otherwise(0))
            .withColumn("run", F.sum("opens").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    parts = runs.groupBy(*key, "n_words", "template", "grams", "base", "run", "part").agg(
        F.bit_or("mask").alias("mask"), F.min("diagonal").alias("diagonal"), F.max("hits").alias("hits"))
    spans = parts.groupBy(*key, "n_words", "template", "grams", "base", "run").agg(
        F.sum(F.bit_count("mask")).alias("covered"), F.min("diagonal").alias("diagonal"), F.max("hits").alias("hits"))
    spans = spans.withColumn("coverage", F.when(F.col("template") >= 0, F.col("covered") / F.col("grams")))
    is_base = F.col("base") & (F.col("coverage") == 1)
    is_notice = (F.col("template") >= 0) & ~F.col("base") & (F.col("coverage") >= params.coverage)
    start = F.greatest(F.col("diagonal"), F.lit(0)).cast("long")
    by_label: dict[str, list[tuple[int, bool]]] = {}
    for n, label, base, _ in templates():
        by_label.setdefault(label, []).append((n, base))

    def has(numbers: list[int]) -> Column:
        return F.max(F.col("template").isin(numbers) & (is_base | is_notice))

    names = F.create_map(*[F.lit(x) for n, label, _, _ in templates() for x in (n, label)])
    flags = {label: has([n for n, _ in ns]) for label, ns in sorted(by_label.items())}
    base_flags = {label: has([n for n, b in ns if b]) for label, ns in sorted(by_label.items()) if any(b for _, b in ns)}
    out = spans.groupBy(*key).agg(
        F.max("n_words").alias("n_words"),
        F.max(F.when(F.col("template") < 0, F.col("hits"))).alias("copies"),
        F.sum(F.when(is_base, 1).otherwise(0)).cast("long").alias("n_base"),
        F.min(F.when(is_base, start)).alias("first_word"), F.max(F.when(is_base, start)).alias("last_word"),
        F.max(F.when(is_base, 1.0).when(is_notice, F.col("coverage")).otherwise(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(is_base | is_notice, F.struct(
            start.alias("start"), names[F.col("template")].alias("label"), F.col("coverage"))))).alias("spans"),
        *[f.alias(f"__l_{label}") for label, f in flags.items()],
        *[f.alias(f"__b_{label}") for label, f in base_flags.items()])

    def joined(prefix: str, labels: dict[str, Column]) -> Column:
        return F.concat_ws(",", *[F.when(F.col(f"`{prefix}{label}`"), label) for label in labels])

    out = out.withColumn("base_labels", joined("__b_", base_flags)).withColumn("labels", joined("__l_", flags))
    return (out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
            .select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"))


def query(spark, sf_dir: str) -> DataFrame:
    """op8: base phrases and license notices of every document."""
    return scan(table(spark, sf_dir, "documents")).drop("spans")
