"""License scan: normalised passages compared to license templates by the Dice coefficient over word bigrams.

DataFrame functions only. A match of a template must hold one of a few of its bigrams (as many as it may miss, plus one), so
documents without any word of those are passed over. In the others, passages (the whole text, paragraphs and runs of them,
lines, sentences) are normalised, and a template is compared only to passages whose number of bigrams allows the threshold.
A passage matches the template it is most like alone, and within a match of a longer template shorter ones count for nothing,
so a license is not taken for its siblings. Templates are a list of bounded size inside the plan: no join, no shuffle.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least Dice coefficient of a match.
THRESHOLD = 0.8
#: Words below this length are no filter of their own.
SHORT = 4
#: Paragraphs of a run that is compared as one passage, at most (a license's introduction and its clauses).
RUN = 4
#: Most bigrams that all templates together may have, as they are part of the plan.
MOST_BIGRAMS = 20_000

# Customary license notices and the operative paragraphs of public license texts, as (license, text).
TEMPLATES: list[tuple[str, str]] = [
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words: all but ASCII letters, digits and characters beyond ASCII.
SEPARATORS = "[^a-z0-9\\x{80}-\\x{10FFFF}]+"
#: What separates paragraphs: lines without a word.
WORDLESS = "\\n[^a-z0-9\\x{80}-\\x{10FFFF}]*\\n"


def bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a text, normalised as the scan does it."""
    words = re.sub(r"[^a-z0-9\x80-\U0010ffff]+", " ", text.translate(str.maketrans(_UPPER, _LOWER))).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def bounds(n: int, threshold: float) -> tuple[int, int]:
    """Fewest and most bigrams that a passage may have to reach the threshold against n."""
    return math.ceil(threshold * n / (2 - threshold) - 1e-9), math.floor((2 - threshold) * n / threshold + 1e-9)


def needed(grams: list[str], threshold: float) -> tuple[set[str], set[str]]:
    """Words and bigrams one of which any match must hold: each match shares at least `least` bigrams, so it cannot miss all
    of the others plus one. Those with the longest words are taken, and of each the longest word; a bigram of short words,
    which any text holds, stays a bigram."""
    low = bounds(len(grams), threshold)[0]
    least = max(1, math.ceil(threshold * (len(grams) + low) / 2 - 1e-9))
    ranked = sorted(grams, key=lambda g: (-max(map(len, g.split())), g))[: len(grams) - least + 1]
    longest = {g: max(g.split(), key=lambda w: (len(w), w)) for g in ranked}
    return {w for w in longest.values() if len(w) >= SHORT}, {g for g, w in longest.items() if len(w) < SHORT}


def prepared(templates: list[tuple[str, str]], threshold: float) -> tuple[list[tuple[str, list[str]]], list[str], list[str]]:
    """Bigrams by template, and the words and bigrams that let a document in; a word that holds another is not needed."""
    kept = sorted({(name, tuple(bigrams(text))) for name, text in templates})
    grams = [(name, list(g)) for name, g in kept if g]
    if sum(len(g) for _, g in grams) > MOST_BIGRAMS:
        raise ValueError("too many template bigrams for one plan; scan with parts of the templates")
    wanted = [needed(g, threshold) for _, g in grams]
    words = sorted({w for ws, _ in wanted for w in ws})
    return grams, [w for w in words if not any(o != w and o in w for o in words)], sorted({g for _, gs in wanted for g in gs})


def scan(documents: DataFrame, *, text: Column | None = None, id_col: str = "doc_id", templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: the id, license (best match, ties to the name that sorts first; null if none), dice (0 if none),
    licenses (all matched, sorted, comma-joined; '' if none) and n_passages (distinct passages that match).

    Passages are the whole text, paragraphs (what lines without a word separate, so comment marks don't matter), runs of two to
    RUN paragraphs, lines, and sentences of lines; each counts once, however often it repeats. A passage matches the templates
    of its highest coefficient, and not at all if it lies in one that matches a template of more bigrams. A passage of fewer
    than two words has no bigram and never matches, nor does a null or empty text. Very long texts are scanned whole. Repeated
    rows give a row each; an empty table none. Only the id and the text are read, so other columns may have any name.
    """
    grams, words, phrases = prepared(TEMPLATES if templates is None else templates, threshold)
    text = F.translate(F.col("text") if text is None else text, _UPPER, _LOWER)
    rows = documents.select(F.col(id_col).alias("__id"), text.alias("t"))
    may = F.lit(False)
    for w in words:
        may = may | F.col("t").contains(w)
    if phrases:
        may = may | F.col("t").rlike("|".join(SEPARATORS.join(g.split()) for g in phrases))
    sentences = r"regexp_replace(t, '([.!?])[ \\t]+', '$1\n')"
    rows = rows.select("__id", F.when(may, F.col("t")).alias("t")).withColumn("b", F.split("t", WORDLESS))
    runs = f"flatten(transform(sequence(2, {RUN}), k -> if(size(b) < k, cast(array() as array<string>), transform(sequence(1, size(b) - k + 1), i -> array_join(slice(b, i, k), '\\n')))))"
    passages = rf"array_distinct(concat(array(t), b, {runs}, split(t, '\n'), split({sentences}, '\n')))"
    rows = rows.select("__id", F.when(F.col("t").isNotNull(), F.expr(passages)).otherwise(F.array().cast("array<string>")).alias("p"))
    rows = rows.select("__id", F.expr(r"array_distinct(transform(p, x -> split(trim(regexp_replace(x, '" + SEPARATORS.replace("\\", "\\\\") + r"', ' ')), ' ')))").alias("w"))
    sizes = [bounds(len(g), threshold) for _, g in grams]
    low, high = min((a for a, _ in sizes), default=1), max((b for _, b in sizes), default=0)
    # A passage of few words is cut away before its bigrams are built; a long one may still have few distinct bigrams.
    pairs = "array_distinct(transform(sequence(1, size(x) - 1), i -> concat(x[i - 1], ' ', x[i])))"
    rows = rows.select("__id", F.expr(f"transform(filter(w, x -> size(x) > {max(1, low)}), x -> struct(x as words, {pairs} as grams))").alias("g"))
    rows = rows.select("__id", F.expr(f"filter(g, x -> size(x.grams) between {low} and {high})").alias("g"))
    known = F.array(*[
        F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, g)).alias("grams"), F.lit(len(g)).alias("n"), F.lit(a).alias("low"), F.lit(b).alias("high")) for (name, g), (a, b) in zip(grams, sizes)
    ]) if grams else F.expr("cast(array() as array<struct<name:string,grams:array<string>,n:int,low:int,high:int>>)")
    rows = rows.withColumn("known", F.when(F.size("g") > 0, known))
    dice = "case when size(x.grams) between k.low and k.high then 2D * size(array_intersect(x.grams, k.grams)) / (size(x.grams) + k.n) else 0D end"
    like = f"filter(transform(known, k -> struct({dice} as dice, k.n as n, k.name as name)), m -> m.dice >= {threshold} - 1e-9)"
    hits = f"filter(transform(g, x -> struct(concat(' ', array_join(x.words, ' '), ' ') as words, {like} as m)), y -> size(y.m) > 0)"
    none = "array<struct<words:string,m:array<struct<dice:double,n:int,name:string>>>>"
    rows = rows.select("__id", F.when(F.size("g") > 0, F.expr(hits)).otherwise(F.array().cast(none)).alias("h"))
    rows = rows.select("__id", F.expr("transform(h, y -> struct(y.words as words, filter(y.m, v -> v.dice = array_max(y.m).dice) as m))").alias("h"))
    rows = rows.select("__id", F.expr("transform(h, y -> struct(y.words as words, y.m as m, array_max(transform(y.m, v -> v.n)) as n))").alias("h"))
    rows = rows.select("__id", F.expr("filter(h, x -> not exists(h, y -> y.n > x.n and contains(y.words, x.words)))").alias("h"))
    rows = rows.select("__id", F.size("h").cast("long").alias("n_passages"), F.expr("flatten(transform(h, x -> x.m))").alias("h"))
    rows = rows.withColumn("top", F.expr("array_max(transform(h, x -> x.dice))"))
    return rows.select(
        F.col("__id").alias(id_col), F.expr("array_min(transform(filter(h, x -> x.dice = top), x -> x.name))").alias("license"), F.coalesce(F.round("top", 9), F.lit(0.0)).alias("dice"),
        F.expr("array_join(array_sort(array_distinct(transform(h, x -> x.name))), ',')").alias("licenses"), "n_passages",
    )


def oracle_sql(threshold: float = THRESHOLD) -> str:
    """The same for `documents` in DuckDB, without the word filter."""
    grams, *_ = prepared(TEMPLATES, threshold)
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({i}, {quote(n)}, [{', '.join(map(quote, g))}])" for i, (n, g) in enumerate(grams))
    return f"""
with known(k, name, grams) as (values {known}),
texts as (select row_number() over () as r, doc_id, translate(text, '{_UPPER}', '{_LOWER}') as t from documents),
blocks as (select r, t, regexp_split_to_array(t, '{WORDLESS}') as b from texts),
runs as (select r, unnest(list_transform(range(1, len(b) - k + 2), lambda i: array_to_string(b[i : i + k - 1], chr(10)))) as p from blocks, range(2, {RUN} + 1) as s(k) where len(b) >= k),
passages as (select distinct r, p from (select r, unnest(list_concat([t], b, string_split(t, chr(10)),
             string_split(regexp_replace(t, '([.!?])[ \\t]+', '\\1' || chr(10), 'g'), chr(10)))) as p from blocks union all select r, p from runs)),
words as (select distinct r, string_split(trim(regexp_replace(p, '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+', ' ', 'g'), ' '), ' ') as w from passages),
sets as (select row_number() over () as s, r, w, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as g from words where len(w) > 1),
cells as (select s, r, len(g) as n, unnest(g) as gram from sets),
terms as (select k, name, len(grams) as m, unnest(grams) as gram from known),
dices as (select s, r, k, name, any_value(m) as m, 2.0::double * count(*) / (any_value(n) + any_value(m)) as dice from cells join terms using (gram) group by s, r, k, name),
likes as (select * from dices where dice >= {threshold} - 1e-9 qualify dice = max(dice) over (partition by s)),
longest as (select s, r, max(m) as m from likes group by s, r),
held as (select l.s, l.r, l.m, ' ' || array_to_string(w, ' ') || ' ' as words from longest l join sets on l.s = sets.s),
inner_ones as (select distinct a.s from held a join held b on a.r = b.r and b.m > a.m and contains(b.words, a.words)),
hits as (select l.* from likes l left join inner_ones i on l.s = i.s where i.s is null),
best as (select r, max(dice) as top, string_agg(distinct name, ',' order by name) as licenses, count(distinct s) as n_passages from hits group by r),
named as (select h.r, min(name) as license from hits h join best b on h.r = b.r and h.dice = b.top group by h.r)
select doc_id, n.license, coalesce(round(b.top, 9), 0.0)::double as dice, coalesce(b.licenses, '') as licenses, cast(coalesce(b.n_passages, 0) as bigint) as n_passages
from texts t left join best b on t.r = b.r left join named n on t.r = n.r
"""
