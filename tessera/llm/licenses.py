"""Licence detection by Dice coefficients over word bigrams (operator 10), in DataFrame functions alone.

Units are the lines of a text, the whole of it, and windows of words
that may cross line ends. A unit is normalised
(lower case, everything but letters and digits to single spaces), cut into
words, and its distinct neighbouring word pairs are compared with each
template's: dice = 2 * shared / (unit's + template's). A template can only
reach the threshold if the smaller set has at least threshold / (2 -
threshold) of the larger one's pairs; sizes outside that are never compared.
A text in which no template has the pairs that it needs has no such unit, and
is left out before any unit is built.

A window begins and ends with a pair of the template, as other pairs at its
ends would only lower the coefficient, and its first pair doesn't occur in it
again, as leaving that out would not change the set. The sets of all windows
from one pair are then the beginnings of one array: its followers up to its
next occurrence, each where it is first seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_column

THRESHOLD = 0.8

_BSD_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

#: Public licence notices and whole licence texts.
TEMPLATES = [
    ("BSD-2-Clause", _BSD_CONDITIONS + _BSD_DISCLAIMER),
    ("BSD-3-Clause", _BSD_CONDITIONS + _BSD_NAMES + _BSD_DISCLAIMER),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES '
        "OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, '
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, '
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]


def _plain(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def pairs_of(text: str) -> list[str]:
    words = _plain(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def size_bounds(pairs: int, threshold: float) -> tuple[int, int]:
    """Least and greatest number of pairs with which a unit can reach the threshold."""
    share = threshold / (2 - threshold)
    return int(-(-(share * pairs - 1e-9) // 1)), int(pairs / share + 1e-9)


def license_scan(docs: DataFrame, threshold: float = THRESHOLD, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, n_matches, licenses (sorted distinct names joined by commas), best_dice, for each row of docs.

    n_matches counts the units whose best template reaches the threshold, and
    licenses names those templates; best_dice is the greatest coefficient
    among them, rounded to six places, 0 if there is none. The units are the
    lines, a text of several lines as a whole, and windows: of windows that overlap the best, and none
    that overlaps a matching line or whole of the same name or of no smaller
    coefficient. Null and empty texts match nothing; rows repeat as they
    come, null ids stay, no rows give none; texts are searched whole, however
    long; other columns of docs are ignored.
    """
    kinds = [(name, pairs_of(text)) for name, text in templates or TEMPLATES]
    bounds = [size_bounds(len(p), threshold) for _, p in kinds]
    low, high = min(a for a, _ in bounds), max(b for _, b in bounds)
    every = F.array(*[F.lit(x) for x in sorted({x for _, p in kinds for x in p})])

    none = F.array().cast("array<struct<minus:double,name:string,a:int,b:int>>")
    plain = F.lower(F.regexp_replace(text_column(), "[^A-Za-z0-9\n]+", " "))
    words = F.split(F.trim(F.regexp_replace(F.col("plain"), "[ \n]+", " ")), " ")
    lines = F.filter(F.transform(F.split("plain", "\n", -1), lambda x: F.split(F.trim(x), " ")), lambda ws: ws[0] != "")

    def let(value: Column, f) -> Column:
        """f of a value that is worked out once."""
        return F.transform(F.array(value), f)[0]

    def shared(p: Column, known: list[str]) -> Column:
        return F.size(F.array_intersect(p, F.array(*[F.lit(x) for x in known])))

    def pairs(ws: Column) -> Column:
        return F.zip_with(F.slice(ws, F.lit(1), F.size(ws) - 1), F.slice(ws, F.lit(2), F.size(ws) - 1), lambda a, b: F.concat(a, F.lit(" "), b))

    def best(p: Column, first: Column, words: Column) -> Column:
        """The template of the greatest coefficient (ties: the first name), with the first and last pair."""
        made = []
        for (name, known), (a, b) in zip(kinds, bounds):
            dice = 2.0 * shared(p, known) / (F.size(p) + len(known))
            made.append(F.when(F.size(p).between(a, b), F.struct((-dice).alias("minus"), F.lit(name).alias("name"), first.alias("a"), (first + words - 2).alias("b"))))
        return F.array_min(F.array(*made))  # nulls are passed over

    def reached(hits: Column) -> Column:
        return F.filter(hits, lambda h: h["minus"] <= 1e-9 - threshold)

    # lines and whole texts; the line at i begins with the pair of the number of words before it
    def unit(ws: Column, first: Column) -> Column:
        return let(F.array_distinct(pairs(ws)), lambda p: F.when(F.size(p).between(low, high) & F.arrays_overlap(p, every), best(p, first, F.size(ws))))

    before = lambda i: F.aggregate(F.slice("lines", F.lit(1), i), F.lit(1), lambda n, ws: n + F.size(ws))
    by_line = reached(F.transform("lines", lambda ws, i: F.when(F.size(ws) > low, unit(ws, i))))
    placed = F.transform("by_line", lambda h: let(before(h["a"]), lambda n: h.withField("a", n).withField("b", h["b"] - h["a"] + n)))
    whole = F.when((F.size(F.split("plain", "\n", -1)) > 1) & (F.size("words") > low), reached(F.array(unit(F.col("words"), F.lit(1))))).otherwise(none)

    # windows
    begun = 4 * (high + 1)

    def followers(i: Column) -> Column:
        """Distinct pairs from the one at i up to its next occurrence, at least so many as a window can have."""

        def cut(s: Column, otherwise) -> Column:
            return let(F.array_position(F.slice(s, F.lit(2), F.size(s)), s[0]).cast("int"), lambda k: F.when(k > 0, F.array_distinct(F.slice(s, F.lit(1), k))).otherwise(otherwise(s)))

        def further(s: Column) -> Column:
            rest = lambda: cut(F.slice(F.col("pairs"), i, F.size("pairs")), F.array_distinct)
            return let(F.array_distinct(s), lambda d: F.when((F.size(d) > high) | (i + begun > F.size("pairs")), d).otherwise(rest()))

        return let(F.slice(F.col("pairs"), i, F.lit(begun)), lambda s: cut(s, further))

    def window(i: Column, d: Column) -> Column:
        """The best window from the pair at i (ties: the longest); b is as yet the number of its distinct pairs."""
        made = []
        for (name, known), (a, b) in zip(kinds, bounds):
            own = F.array(*[F.lit(x) for x in known])
            start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("m"), F.lit(0.0).alias("minus"), F.lit(0).alias("b"))

            def step(s: Column, p: Column) -> Column:
                more = F.struct((s["n"] + 1).alias("n"), (s["m"] + F.array_contains(own, p).cast("int")).alias("m"), s["minus"].alias("minus"), s["b"].alias("b"))
                dice = lambda t: -2.0 * t["m"] / (t["n"] + len(known))
                return let(more, lambda t: F.when(dice(t) < t["minus"], F.struct(t["n"].alias("n"), t["m"].alias("m"), dice(t).alias("minus"), t["n"].alias("b"))).otherwise(t))

            at = lambda ps: F.aggregate(ps, start, step)
            scored = let(at(F.slice(d, F.lit(1), F.lit(b))), lambda s: F.struct(s["minus"].alias("minus"), (-s["b"]).alias("longest"), F.lit(name).alias("name"), i.alias("a"), s["b"].alias("b")))
            made.append(F.when(F.array_contains(own, d[0]) & (shared(F.slice(d, F.lit(1), F.lit(b)), known) >= a), scored))
        return let(F.array_min(F.array(*made)), lambda h: F.when(h.isNotNull(), F.struct(h["minus"].alias("minus"), h["name"].alias("name"), h["a"].alias("a"), h["b"].alias("b"))))

    starts = F.filter(F.transform("pairs", lambda p, i: F.when(F.array_contains("own", p), i + 1)), lambda i: i.isNotNull())
    found = reached(F.transform(starts, lambda i: let(followers(i), lambda d: let(window(i, d), lambda h: h.withField("b", i + F.array_position(F.slice(F.col("pairs"), i, F.size("pairs")), d[h["b"] - 1]).cast("int") - 1)))))
    held = F.struct(none.alias("done"), F.lit(None).cast("struct<minus:double,name:string,a:int,b:int>").alias("last"))

    def apart(s: Column, h: Column) -> Column:
        """Windows come by their first pair; of those that overlap the last one the best stays."""
        last = s["last"]
        return F.when(last.isNull(), F.struct(s["done"].alias("done"), h.alias("last"))).when(
            h["a"] > last["b"], F.struct(F.concat(s["done"], F.array(last)).alias("done"), h.alias("last"))
        ).when(h["minus"] < last["minus"], F.struct(s["done"].alias("done"), h.alias("last"))).otherwise(s)

    chosen = F.aggregate("found", held, apart, lambda s: F.when(s["last"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["last"]))))
    fresh = F.filter("chosen", lambda w: ~F.exists("units", lambda u: (u["a"] <= w["b"]) & (u["b"] >= w["a"]) & ((u["name"] == w["name"]) | (u["minus"] <= w["minus"]))))

    some = F.size("own") > 0
    enough = [F.when(shared(F.col("own"), known) >= a, F.array(*[F.lit(x) for x in known])) for (_, known), (a, _) in zip(kinds, bounds)]
    if_some = lambda x: F.when(some, x).otherwise(none)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain.alias("plain")).select("doc_id", "plain", words.alias("words"))
    rows = rows.withColumn("pairs", pairs(F.col("words"))).withColumn("own", F.array_intersect("pairs", every))
    rows = rows.withColumn("own", F.when(F.size("own") > 0, F.array_intersect("own", F.flatten(F.array_compact(F.array(*enough))))).otherwise(F.col("own")))
    rows = rows.withColumn("lines", F.when(some, lines)).withColumn("by_line", if_some(by_line)).withColumn("units", if_some(F.concat(placed, whole)))
    rows = rows.withColumn("found", if_some(found)).withColumn("chosen", chosen).withColumn("hits", F.concat("units", fresh))
    return rows.select("doc_id", "hits").select(
        "doc_id",
        F.size("hits").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("hits", lambda x: x["name"]))), ",").alias("licenses"),
        F.round(F.coalesce(-F.array_min(F.transform("hits", lambda x: x["minus"])), F.lit(0.0)), 6).alias("best_dice"),
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_matches, licenses, best_dice of each row of documents; nulls, ties, long texts, repeated rows and empty tables as license_scan() has them."""
    return license_scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The same result from lines and wholes; windows, which SQL hardly can express, are tested against brute force."""
    rows = []
    for i, (name, text) in enumerate(TEMPLATES):
        p = pairs_of(text)
        listed = ", ".join(f"'{x}'" for x in p)
        a, b = size_bounds(len(p), THRESHOLD)
        rows.append(f"({i}, '{name}', [{listed}], {a}, {b})")
    return f"""
with templates(i, name, known, low, high) as (values {", ".join(rows)}),
texts as (select row_number() over () as r, doc_id, lower(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9\n]+', ' ', 'g')) as text from documents),
units as (
  select r, unnest(case when len(string_split(text, chr(10))) > 1 then list_append(string_split(text, chr(10)), text) else string_split(text, chr(10)) end) as unit from texts),
worded as (select r, list_filter(string_split(replace(unit, chr(10), ' '), ' '), lambda x: x <> '') as ws from units),
paired as (
  select row_number() over () as u, r, list_distinct(list_transform(range(1, len(ws)), lambda k: ws[k] || ' ' || ws[k + 1])) as p
  from worded where len(ws) >= 2),
compared as (
  select u, r, name, 2.0 * len(list_intersect(p, known)) / (len(p) + len(known)) as dice from paired join templates on len(p) between low and high),
ranked as (select *, row_number() over (partition by u order by dice desc, name) as k from compared),
good as (select * from ranked where k = 1 and dice >= {THRESHOLD} - 1e-9),
found as (
  select r, count(distinct u) as n, array_to_string(list_sort(list_distinct(list(name))), ',') as licenses, max(dice) as best from good group by r)
select doc_id, coalesce(n, 0)::bigint as n_matches, coalesce(licenses, '') as licenses, round(coalesce(best, 0.0)::double, 6) as best_dice
from texts left join found using (r)"""


ORACLE = _sql()
