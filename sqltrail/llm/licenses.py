"""Licence scans: normalised text against templates by the Dice coefficient of word bigrams."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqltrail.llm.common import in_map, slot_map, slot_of, stored, text_of

#: Least coefficient of a match.
LEAST_DICE = 0.8
#: Most bigrams of all templates that are sent to every task; beyond it they are joined by a shuffle.
SENT_BIGRAMS = 100_000
#: Slots of the map of the templates' bigrams.
SLOTS = 1 << 16
#: Neighbouring bigrams of a text that are joined with passages as one block.
BLOCK = 256

# Notices and texts of well-known licences, by SPDX identifier.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
        "this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "
        "\"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS "
        "BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
}


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " "), " "), lambda w: w != "")


def bigrams_of(words: Column) -> Column:
    """Hashes of the pairs of neighbouring words, repeats included; a single word is a pair with nothing."""
    n = F.size(words)
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(n, F.lit(1))), lambda a, b: F.xxhash64(a, b))
    # The last word has no neighbour.
    return F.slice(pairs, F.lit(1), F.greatest(n - 1, F.lit(1)))


def _template_bigrams(docs: DataFrame, templates: Mapping[str, tuple[str, ...]]) -> tuple[DataFrame, int]:
    """`license, template, size, place, bigram, seed`, and the number of rows at most; a seed is two bigrams in a row."""
    listed = [(name, i, text) for name, texts in templates.items() for i, text in enumerate(texts)]
    values = F.array(*[F.struct(F.lit(n).alias("license"), F.lit(i).alias("template"), F.lit(t).alias("text")) for n, i, t in listed])
    rows = docs.sparkSession.range(1).select(F.explode(values).alias("t")).select("t.*")
    sized = rows.select("license", "template", bigrams_of(words_of(F.col("text"))).alias("pairs"))
    spread = sized.select("license", "template", F.size("pairs").alias("size"), "pairs", F.posexplode("pairs").alias("place", "bigram"))
    after = F.get("pairs", F.col("place") + 1)
    found = spread.withColumn("seed", F.when(after.isNotNull(), F.xxhash64("bigram", after))).drop("pairs")
    return found, sum(len(text.split()) * 2 for _, _, text in listed)


def _units(docs: DataFrame, id_col: str, text_col: str, high: int) -> DataFrame:
    """`row, doc_id, kind, number, words`: lines; paragraphs of several lines; texts of several paragraphs.

    A text is normalised once, line by line. Longer units are put together from their lines, if they are in bounds.
    """
    paragraphs = F.transform(
        F.split(text_of(text_col), "\n[ \t\r]*\n"), lambda p: F.transform(F.split(p, "\n"), lambda line: words_of(line))
    )
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("doc_id"), paragraphs.alias("paragraphs"))
    unit = lambda kind, number, words: F.struct(F.lit(kind).alias("kind"), number.alias("number"), words.alias("words"))
    within = lambda lines: F.aggregate(lines, F.lit(0), lambda n, line: n + F.size(line)) <= high + 1
    lines = F.transform(F.flatten("paragraphs"), lambda line, i: unit("line", i, line))
    several = F.transform(
        "paragraphs", lambda p, i: unit("paragraph", i, F.when((F.size(p) > 1) & within(p), F.flatten(p)))
    )
    all_lines = F.flatten("paragraphs")
    text = F.array(unit("text", F.lit(0), F.when((F.size("paragraphs") > 1) & within(all_lines), F.flatten(all_lines))))
    found = rows.select("row", "doc_id", F.explode_outer(F.concat(lines, several, text)).alias("u"))
    return found.select("row", "doc_id", "u.kind", "u.number", "u.words")


def _hits(docs: DataFrame, known: Column, seeds: Column, id_col: str, text_col: str) -> DataFrame:
    """`row, doc_id, n, place, bigram, seed`: bigrams of templates, of texts that hold two neighbouring ones in a row.

    `n` counts all bigrams of the text, `place` is the bigram's number among them.
    """
    words = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("doc_id"), words_of(text_of(text_col)).alias("words"))
    pairs = words.select("row", "doc_id", F.when(F.size("words") > 1, bigrams_of(F.col("words"))).alias("pairs"))
    placed = F.transform("pairs", lambda b, i: F.struct(i.alias("place"), b.alias("bigram")))
    hits = pairs.select(
        "row", "doc_id", F.size("pairs").alias("n"), F.filter(placed, lambda h: in_map(known, slot_of(h["bigram"], slots=SLOTS))).alias("hits")
    )
    after = F.slice("hits", F.lit(2), F.greatest(F.size("hits"), F.lit(1)))
    seed = lambda a, b: F.when(b["place"] == a["place"] + 1, F.xxhash64(a["bigram"], b["bigram"]))
    paired = F.zip_with("hits", after, lambda a, b: F.struct(a["place"].alias("place"), a["bigram"].alias("bigram"), seed(a, b).alias("seed")))
    seeded = hits.select("row", "doc_id", "n", paired.alias("hits"))
    some = F.exists("hits", lambda h: h["seed"].isNotNull() & in_map(seeds, slot_of(h["seed"], slots=SLOTS)))
    found = seeded.select("row", "doc_id", "n", F.explode_outer(F.when(some, F.col("hits"))).alias("h"))
    return found.where("h IS NOT NULL").select("row", "doc_id", "n", "h.*")


def _passages(hits: DataFrame, placed: DataFrame, pairs: DataFrame, small: bool, least: float) -> DataFrame:
    """Places in texts where a template begins by the vote of its seeds, with the coefficient of as many bigrams as it has."""
    key = ["row", "doc_id", "n", "license", "template", "size"]
    sent = lambda side: F.broadcast(side) if small else side
    seeds = placed.where("seed IS NOT NULL").withColumnRenamed("place", "at").drop("bigram")
    begins = (F.col("place") - F.col("at")).alias("begins")
    votes = hits.where("seed IS NOT NULL").join(sent(seeds), "seed").groupBy(*key, begins).agg(F.count(F.lit(1)).alias("votes"))
    # Of places less than a template apart, the one with most votes, then the first. A text's places are its own words.
    near = "PARTITION BY row, license, template ORDER BY begins / size RANGE BETWEEN 0.9999999D PRECEDING AND 0.9999999D FOLLOWING"
    best = votes.withColumn("best", F.expr(f"max(struct(votes, -begins)) OVER ({near})"))
    best = best.where("best.votes = votes AND best.col2 = -begins").select(*key, "begins")
    first, last = F.greatest("begins", F.lit(0)), F.least(F.col("begins") + F.col("size"), "n") - 1
    block = lambda place: F.floor(place / BLOCK)
    windows = best.select(*key, first.alias("first"), last.alias("last")).select("*", F.explode(F.sequence(block(F.col("first")), block(F.col("last")))).alias("block"))
    own = hits.select("row", "place", "bigram", block(F.col("place")).alias("block"))
    inside = own.join(windows, ["row", "block"]).where("place BETWEEN first AND last")
    counted = inside.groupBy(*key, "first", "last", "bigram").agg(F.count(F.lit(1)).alias("held"))
    met = counted.join(sent(pairs), ["license", "template", "size", "bigram"])
    shared = met.groupBy(*key, "first", "last").agg(F.sum(F.least("held", "times")).alias("both"))
    dice = 2 * F.col("both") / (F.col("last") - F.col("first") + 1 + F.col("size"))
    return shared.select(
        "doc_id", F.lit("passage").alias("kind"), F.col("first").cast("int").alias("number"), "license", "template", dice.alias("dice")
    ).where(F.col("dice") >= least)


def scan_licenses(
    docs: DataFrame,
    templates: Mapping[str, tuple[str, ...]] = TEMPLATES,
    least: float = LEAST_DICE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """`doc_id, kind, number, license, template, dice`: each template that a line, paragraph, text or passage is like.

    Both sides are lower-cased words; the coefficient is 2 |A and B| / (|A| + |B|) over their bigrams, repeats
    counted. A text can reach `least` only if its size lies between least / (2 - least) times the template's and
    the inverse of that: units outside all templates' bounds are left out before bigrams are made, and pairs
    outside before they are counted. Within the bounds, at least that part of a unit's own bigrams must belong to
    some template, which a map of fixed size tells. What is left is joined by bigrams; no text is shuffled.

    A passage is a stretch of words anywhere, over lines and paragraphs or within one, `number` its first word. It is
    as long as the template, or ends with the text, so its size is in bounds. It begins where two of the template's
    bigrams in a row place the beginning, more often than at any place less than a template away (ties: the first). A
    licence that stands as a line of its own is thus told as a line and as a passage. Templates of less than three
    words have no passages.

    Null and empty texts match nothing. Every row matches on its own, whatever ids repeat or are null. Other columns
    are ignored.
    """
    placed, most = _template_bigrams(docs, templates)
    pairs = placed.groupBy("license", "template", "size", "bigram").agg(F.count(F.lit(1)).alias("times"))
    ratio = least / (2 - least)
    sizes = pairs.agg(F.min("size"), F.max("size")).first()
    if sizes[0] is None:
        sizes = (1, 0)
    low, high = math.ceil(ratio * sizes[0] - 1e-9), math.floor(sizes[1] / ratio + 1e-9)
    known = slot_map(pairs.select(slot_of(F.col("bigram"), slots=SLOTS).alias("slot")), SLOTS, literal=True)

    # Conditions in place of filters, which would be pushed below the arrays and make them twice.
    n = F.size("words") - 1
    units = _units(docs, id_col, text_col, high).select(
        "row", "doc_id", "kind", "number", F.when((F.size("words") > 0) & F.greatest(n, F.lit(1)).between(low, high), bigrams_of(F.col("words"))).alias("pairs")
    )
    held = units.select(
        "row", "doc_id", "kind", "number", F.size("pairs").alias("n"), F.filter("pairs", lambda b: in_map(known, slot_of(b, slots=SLOTS))).alias("pairs")
    )
    spread = held.select(
        "row", "doc_id", "kind", "number", "n", F.explode_outer(F.when(F.size("pairs") >= ratio * F.col("n"), F.col("pairs"))).alias("bigram")
    )
    counted = spread.groupBy("row", "doc_id", "kind", "number", "n", "bigram").agg(F.count(F.lit(1)).alias("held"))
    side = F.broadcast(pairs) if most <= SENT_BIGRAMS else pairs
    met = counted.join(side, "bigram").where((F.col("n") >= F.col("size") * ratio) & (F.col("n") <= F.col("size") / ratio))
    shared = met.groupBy("row", "doc_id", "kind", "number", "license", "template", "n", "size").agg(F.sum(F.least("held", "times")).alias("both"))
    dice = 2 * F.col("both") / (F.col("n") + F.col("size"))
    units = shared.select("doc_id", "kind", "number", "license", "template", dice.alias("dice")).where(F.col("dice") >= least)
    seeds = slot_map(placed.where("seed IS NOT NULL").select(slot_of(F.col("seed"), slots=SLOTS).alias("slot")), SLOTS, literal=True)
    hits = stored(_hits(docs, known, seeds, id_col, text_col))
    return units.unionByName(_passages(hits, placed, pairs, most <= SENT_BIGRAMS, least))
