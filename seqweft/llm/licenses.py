"""Licence scans: passages against licence templates by the Dice coefficient over word bigrams.

Passages of a text are its lines, its blocks between empty lines and the whole of it. Normalised, A-Z are lower case, ASCII
marks and white space part the words, and carriage returns are gone. A passage with a bigrams and a template with b can
reach a coefficient of t only if b * t / (2 - t) <= a <= b * (2 - t) / t, and then they share b * t / (2 - t) bigrams at
least; so of the template's bigrams, all but fewer than that, one must be there: its keys, the longest ones. Passages are
pruned by size, by the longer words of the keys, and by the keys' hashes in a broadcast join with a table that
depends on the templates alone; what is left is compared exactly. Bigrams that repeat count as often as both have them.

All of it is DataFrame expressions. Null and empty texts match nothing. Rows that share a doc_id are one document, null
ids too. Of templates that reach the threshold the best counts for a passage, the first by name among equals.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqweft.llm.common import LOWER, UPPER, body, table

THRESHOLD = 0.8

# The words of public licence notices and of short licence texts.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "BSD-clauses": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-SA-4.0-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-licensed": "Licensed under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


# What parts words: ASCII marks and white space but the line end; a carriage return has no counterpart and goes.
MARKS = " \t\x0b\x0c!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
FROM, TO = UPPER + MARKS + "\r", LOWER + " " * len(MARKS)


def bigrams(passage: str) -> Counter:
    words = passage.translate(str.maketrans(UPPER + MARKS, TO, "\r")).split()
    return Counter(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))


def profiles(templates: dict[str, str], threshold: float) -> list[dict]:
    """For each template its bigrams with counts, its size, the sizes of passages that can reach the threshold, and its key bigrams."""
    out = []
    for name, text in sorted(templates.items()):
        grams = bigrams(text)
        size, low = sum(grams.values()), sum(grams.values()) * threshold / (2 - threshold)
        others = math.ceil(low - 1e-9) - 1  # so many bigrams may be missing from the keys
        keys = sorted(grams, key=lambda g: (-len(g), g))
        dropped = 0
        while keys and dropped + grams[keys[-1]] <= others:
            dropped += grams[keys.pop()]
        out.append({"name": name, "grams": grams, "size": size, "low": math.ceil(low - 1e-9), "high": math.floor(size * (2 - threshold) / threshold + 1e-9), "keys": keys})
    return out


def passages(docs: DataFrame, low: int, high: int, cover: list[str], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, __row, __at and the words of each passage that has low to high bigrams and a word of cover."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("__row"), F.translate(body(text), FROM, TO).alias("t"))
    none = F.array().cast("array<string>")
    lines, apart = F.split("t", "\n"), F.contains("t", F.lit("\n\n"))
    blocks = F.when(apart, F.filter(F.split("t", "\n\n+"), lambda p: F.contains(p, F.lit("\n")))).otherwise(none)
    whole = F.when(F.contains("t", F.lit("\n")), F.array("t")).otherwise(none)
    cut = rows.select("doc_id", "__row", F.posexplode(F.concat(lines, blocks, whole)).alias("__at", "p"))
    words = cut.select("doc_id", "__row", "__at", F.array_remove(F.split(F.replace("p", F.lit("\n"), F.lit(" ")), " "), "").alias("w"))
    return words.where(F.size("w").between(low + 1, high + 1) & F.arrays_overlap("w", F.lit(cover)))


def matches(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, __row, __at, license, dice: the best template of each passage that reaches the threshold."""
    spark = docs.sparkSession
    known = [p for p in profiles(templates, threshold) if p["size"]]
    if not known:
        raise ValueError("no template has two words")
    cover = sorted({max(k.split(), key=len) for p in known for k in p["keys"]})
    keys = spark.createDataFrame([(p["name"], k, p["low"], p["high"]) for p in known for k in p["keys"]], "license string, key string, low int, high int")
    keys = keys.select("license", F.xxhash64("key").alias("h"), "low", "high")
    full = spark.createDataFrame([(p["name"], g, n, p["size"]) for p in known for g, n in p["grams"].items()], "license string, gram string, times int, size int")
    cut = passages(docs, min(p["low"] for p in known), max(p["high"] for p in known), cover, text, doc_id)
    pairs = lambda hashed: F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: (F.xxhash64 if hashed else lambda x: x)(F.concat(a, F.lit(" "), b)))
    near = cut.select("*", F.explode(pairs(True)).alias("h")).join(F.broadcast(keys), "h").where((F.size("w") - 1).between(F.col("low"), F.col("high")))
    place = ["doc_id", "__row", "__at", "license"]
    held = near.groupBy(*place).agg(F.first("w").alias("w"))
    counted = held.select(*place, (F.size("w") - 1).alias("own"), F.explode(pairs(False)).alias("gram")).groupBy(*place, "own", "gram").agg(F.count("*").alias("n"))
    shared = counted.join(F.broadcast(full), ["license", "gram"]).groupBy(*place, "own", "size").agg(F.sum(F.least("n", "times")).alias("shared"))
    dice = shared.select(*place, (2.0 * F.col("shared") / (F.col("own") + F.col("size"))).alias("dice")).where(F.col("dice") >= threshold)
    best = Window.partitionBy("doc_id", "__row", "__at").orderBy(F.desc("dice"), "license")
    return dice.withColumn("__rank", F.row_number().over(best)).where("__rank = 1").drop("__rank")


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row for each document: its licences in order of name, how many passages matched, and the best coefficient."""
    found = matches(docs, templates, threshold, text, doc_id).select("doc_id", "license", "dice")
    none = docs.select(F.col(doc_id).alias("doc_id"), F.lit(None).cast("string").alias("license"), F.lit(None).cast("double").alias("dice"))
    return found.unionByName(none).groupBy("doc_id").agg(
        F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"),
        F.count("license").alias("n_passages"),
        F.round(F.max("dice"), 6).alias("best_dice"),
    )


def op1_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in TEMPLATES.items())
    words = lambda c: f"list_filter(string_split(replace({c}, chr(10), ' '), ' '), lambda w: w <> '')"
    norm = lambda c: f"translate(coalesce({c}, ''), {quote(FROM)}, {quote(TO)})"
    return f"""
WITH t AS (SELECT license, {words(norm("txt"))} AS w FROM (VALUES {values}) v(license, txt)),
tg AS (SELECT license, w[i] || ' ' || w[i + 1] AS gram, count(*) AS times FROM t, range(1, len(w)) r(i) GROUP BY ALL),
ts AS (SELECT license, sum(times) AS size FROM tg GROUP BY ALL),
d AS (SELECT doc_id, {norm("text")} AS t FROM documents),
u AS (SELECT doc_id, unnest(CASE WHEN contains(t, chr(10)) THEN list_concat(string_split(t, chr(10)), CASE WHEN contains(t, chr(10) || chr(10)) THEN
        list_filter(string_split_regex(t, '\\n\\n+'), lambda p: contains(p, chr(10))) ELSE [] END, [t]) ELSE [t] END) AS p FROM d),
q AS (SELECT doc_id, row_number() OVER () AS pid, {words("p")} AS w FROM u),
s AS (SELECT * FROM q WHERE len(w) >= 2 AND len(w) <= 2 * (SELECT max(size) FROM ts)),
g AS (SELECT doc_id, pid, len(w) - 1 AS own, w[i] || ' ' || w[i + 1] AS gram, count(*) AS n FROM s, range(1, len(w)) r(i) GROUP BY ALL),
m AS (SELECT doc_id, pid, license, 2.0 * sum(least(n, times)) / (any_value(own) + any_value(size)) AS dice
      FROM g JOIN tg USING (gram) JOIN ts USING (license) GROUP BY doc_id, pid, license),
b AS (SELECT doc_id, license, dice FROM m WHERE dice >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY pid ORDER BY dice DESC, license) = 1),
a AS (SELECT doc_id, license, dice FROM b UNION ALL SELECT doc_id, NULL, NULL FROM documents)
SELECT doc_id, coalesce(string_agg(DISTINCT license, ',' ORDER BY license), '') AS licenses, count(license) AS n_passages,
       round(max(dice)::DOUBLE, 6) AS best_dice FROM a GROUP BY doc_id
"""


OP1_SQL = _oracle()
