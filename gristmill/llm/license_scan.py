"""License scans: lines, whole texts and word windows against templates, by Dice's coefficient over word bigrams."""

from __future__ import annotations

import json
import math
import string
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (license, notice): short notices as they are put on files and pages.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
)

#: Licence texts, headers and proprietary notices besides.
MORE = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "Proprietary and confidential."),
    ("Proprietary", "Unauthorized copying of this file, via any medium, is strictly prohibited."),
    ("Proprietary", "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher."),
)
#: Whole licence texts, public ones, in a file each.
TEXTS = tuple((name, (Path(__file__).parent / "licenses" / f"{file}.txt").read_text()) for name, file in (
    ("Apache-2.0", "Apache-2.0"), ("GPL-2.0", "GPL-2"), ("GPL-3.0", "GPL-3"), ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3.0", "LGPL-3"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0"),
))
ALL = TEMPLATES + MORE + TEXTS
#: Templates of more pairs than this are held against one run of a text's words, the best one.
LONG = 600


WINDOWS = "array<struct<dice:double,ord:int,first:int,last:int>>"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bigrams(text: Column) -> Column:
    """Distinct hashed pairs of neighbouring words; words are runs of a-z and 0-9 once A-Z is lowered."""
    words = F.regexp_extract_all(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), F.lit("[a-z0-9]+"), F.lit(0))
    pairs = lambda w: F.array_distinct(F.transform(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.xxhash64(F.get(w, i), x)))
    return F.get(F.transform(F.array(words), pairs), F.lit(0))


def word_lines(text: Column, of_lines: Column) -> Column:
    """``(line, hit)`` of each word of a text: its line, and whether that has a hit."""
    count = lambda x: F.regexp_count(x, F.lit("[A-Za-z0-9]+"))
    per = F.transform(F.split(text, "\n", -1), lambda x, i: F.array_repeat(F.struct(i.alias("line"), F.get(of_lines, i)["dice"].isNotNull().alias("hit")), count(x)))
    return F.flatten(per)


def ordered_pairs(text: Column) -> Column:
    """Hashed pairs of neighbouring words, as in ``bigrams``, at their places."""
    words = F.regexp_extract_all(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), F.lit("[a-z0-9]+"), F.lit(0))
    pairs = lambda w: F.transform(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.xxhash64(F.get(w, i), x))
    return F.get(F.transform(F.array(words), pairs), F.lit(0))


def window_hits(pairs: Column, found: Column, table, threshold: float) -> Column:
    """``array<struct<dice, ord, first, last>>``: the best window from each place, for each template.

    ``found`` holds ``(p, h)`` of the pairs of any template.  A window starts and ends with pairs of its
    template (others at its ends only lower the coefficient), holds n * t / (2 - t) of them at least, and
    is n * (2 - t) / t pairs long at most.
    """

    def of(i: int, n: int, s: list[int]) -> Column:
        least, most = math.ceil(n * threshold / (2 - threshold) - 1e-9), math.floor(n * (2 - threshold) / threshold + 1e-9)

        def from_places(m: Column) -> Column:
            def best(x: Column, at: Column) -> Column:
                def score(y: Column, d: Column) -> Column:
                    both = F.size(F.array_distinct(F.transform(F.slice(m, at + 1, d + least), lambda z: z["h"])))
                    a = F.size(F.array_distinct(F.slice(pairs, x["p"] + 1, y["p"] - x["p"] + 1)))
                    return F.when(y["p"] - x["p"] < most, F.struct((F.lit(2.0) * both / (a + n)).alias("dice"), F.lit(-i).alias("ord"), x["p"].alias("first"), (y["p"] + 1).alias("last")))

                return F.when(F.get(m, at + (least - 1))["p"] - x["p"] < most, F.array_max(F.transform(F.slice(m, at + least, most - least + 1), score)))

            return F.filter(F.transform(m, best), lambda w: w["dice"] >= threshold)

        return F.get(F.transform(F.array(F.filter(found, lambda x: x["h"].isin(s))), from_places), F.lit(0))

    return F.concat(*[of(*row) for row in table])


def run_hits(pairs: Column, table, threshold: float) -> Column:
    """``array<struct<dice, ord, first, last>>``: for each long template the run of words that is nearest to it, if it reaches the threshold.

    Dice's coefficient of a run with h pairs of the template among its a is at least t if and only if h * 2 - a * t >= n * t; so
    the run is that of the largest sum where a pair of the template adds 2 - t and any other takes t, found in one
    pass.  Its coefficient is then counted over distinct pairs.  (A run in which pairs repeat much may thus hide a better one.)
    A text with fewer pairs than any hit needs is not looked at.
    """

    def of(i: int, n: int, s: list[int]) -> Column:
        known = F.from_json(F.lit(json.dumps(s)), "array<bigint>")  # a constant
        least = math.ceil(n * threshold / (2 - threshold) - 1e-9)
        state = lambda total, start, best, first, last: F.struct(total.alias("total"), start.alias("start"), best.alias("best"), first.alias("first"), last.alias("last"))

        def run(common: Column) -> Column:
            held = F.map_from_arrays(common, common)
            steps = F.transform(pairs, lambda h, p: F.struct(F.when(F.try_element_at(held, h).isNotNull(), 2 - threshold).otherwise(-threshold).alias("w"), p.alias("p")))

            def step(s: Column, x: Column) -> Column:
                new = F.struct((F.greatest(s["total"], F.lit(0.0)) + x["w"]).alias("total"), F.when(s["total"] > 0, s["start"]).otherwise(x["p"]).alias("start"))
                return let(new, lambda c: F.when(c["total"] > s["best"], state(c["total"], c["start"], c["total"], c["start"], x["p"])).otherwise(state(c["total"], c["start"], s["best"], s["first"], s["last"])))

            start = state(F.lit(0.0), F.lit(0), F.lit(0.0), F.lit(0), F.lit(-1))
            return F.aggregate(steps, start, step, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))

        def score(r: Column) -> Column:
            own = F.array_distinct(F.slice(pairs, r["first"] + 1, r["last"] - r["first"] + 1))
            return F.struct((F.lit(2.0) * F.size(F.array_intersect(own, known)) / (F.size(own) + n)).alias("dice"), F.lit(-i).alias("ord"), r["first"].alias("first"), (r["last"] + 1).alias("last"))

        found = let(F.array_intersect(pairs, known), lambda common: F.when(F.size(common) >= least, let(run(common), score)))
        return F.when(F.size(pairs) >= least, F.filter(F.array(found), lambda w: w["dice"] >= threshold))

    none = F.array().cast(WINDOWS)
    return F.concat(*[F.coalesce(of(*row), none) for row in table])


def scan_licenses(docs: DataFrame, threshold: float = 0.8, templates=ALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, license, template, dice, line, n_hits)``: each document's best hit.

    Units are each line (from 0), the whole text (-1, if it has more lines than one), and word
    windows anywhere in the text that meet no line with a hit; a window's line is that of its
    first word, and windows that overlap count once.  Templates of more than ``LONG`` pairs are
    held against their best run of words instead (``run_hits``), which counts as well.  For lines and the whole text, a
    template whose number of bigrams b cannot reach the threshold against a unit's a, that is
    unless a * t / (2 - t) <= b <= a * (2 - t) / t, is not compared.  Best: highest Dice
    coefficient, then first template, then first line; ``n_hits`` counts units with a hit.
    Documents without one, null and empty texts have null, null, 0.0, null and 0.  Rows are
    judged one by one: nothing is shuffled, repeated rows and null ids stay.  ``templates`` is
    a parameter held by the driver, a few hundred at most.
    """
    spark = docs.sparkSession
    # one constant job for all templates
    sets = [r[0] for r in spark.range(1).select(F.posexplode(F.array(*[bigrams(F.lit(t)) for _, t in templates]))).orderBy("pos").select("col").collect()] if templates else []
    table = [(i, len(s), s) for i, s in enumerate(sets) if len(s) <= LONG]
    long = [(i, len(s), s) for i, s in enumerate(sets) if len(s) > LONG]
    src = docs.select(docs[id_col].alias("k"), docs[text_col].alias("t"))
    lines = F.transform(F.split(F.col("t"), "\n", -1), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    whole = F.when(F.contains(F.col("t"), F.lit("\n")), F.array(F.struct(F.col("t").alias("x"), F.lit(-1).alias("i")))).otherwise(F.array().cast("array<struct<x:string,i:int>>"))
    none = F.lit(None).cast("struct<dice:double,ord:int,line:int>")

    def best(unit: Column) -> Column:
        def against(b: Column) -> Column:
            a = F.size(b)
            scores = [
                F.when((a * F.lit(threshold / (2 - threshold) * (1 - 1e-9)) <= n) & (F.lit(float(n)) <= a * F.lit((2 - threshold) / threshold * (1 + 1e-9))),
                       F.struct((F.lit(2.0) * F.size(F.array_intersect(b, F.lit(s))) / (a + n)).alias("dice"), F.lit(-i).alias("ord"), (-unit["i"]).alias("line")))
                for i, n, s in table if n
            ]
            return F.array_max(F.filter(F.array(*scores), lambda s: s["dice"] >= threshold)) if scores else none

        return F.get(F.transform(F.array(bigrams(unit["x"])), against), F.lit(0))

    table = [x for x in table if x[1]]
    any_pair = sorted({h for x in table for h in x[2]})
    held = src.select("k", "t", F.transform(lines, best).alias("of_lines"), F.filter(F.transform(whole, best), lambda s: s.isNotNull()).alias("of_whole"), ordered_pairs(F.col("t")).alias("pairs"))
    found = F.filter(F.transform("pairs", lambda h, p: F.struct(p.alias("p"), h.alias("h"))), lambda x: x["h"].isin(any_pair))
    held = held.withColumn("found", found if table else F.lit(None))
    held = held.withColumn("windows", window_hits(F.col("pairs"), F.col("found"), table, threshold) if table else F.lit(None).cast(WINDOWS))

    held = held.withColumn("runs", run_hits(F.col("pairs"), long, threshold) if long else F.array().cast(WINDOWS))
    held = held.withColumn("at", F.when((F.size("windows") > 0) | (F.size("runs") > 0), word_lines(F.col("t"), F.col("of_lines"))))
    met = lambda w: F.size(F.filter(F.slice("at", w["first"] + 1, w["last"] - w["first"] + 1), lambda x: x["hit"]))
    placed = F.transform("windows", lambda w: F.struct(w["dice"].alias("dice"), w["ord"].alias("ord"), (-F.get("at", w["first"])["line"]).alias("line"), w["first"].alias("first"), w["last"].alias("last"), met(w).alias("met")))
    held = held.withColumn("windows", placed)
    clear = F.filter("windows", lambda w: w["met"] == 0)
    held = held.select("k", F.filter("of_lines", lambda s: s.isNotNull()).alias("of_lines"), "of_whole", clear.alias("windows"), F.transform("runs", lambda w: F.struct(w["dice"], w["ord"], (-F.get("at", w["first"])["line"]).alias("line"))).alias("runs"))
    spans = F.array_sort(F.transform("windows", lambda w: F.struct(w["first"], w["last"])))
    runs = F.aggregate(spans, F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end")), lambda got, w: F.struct((got["n"] + F.when(w["first"] > got["end"], 1).otherwise(0)).alias("n"), F.greatest(got["end"], w["last"]).alias("end")), lambda got: got["n"])
    plain = F.coalesce(F.transform("windows", lambda w: F.struct(w["dice"], w["ord"], w["line"])), F.array().cast("array<struct<dice:double,ord:int,line:int>>"))
    n_hits = F.greatest(F.size("of_lines"), F.lit(0)) + F.greatest(F.size("of_whole"), F.lit(0)) + F.coalesce(runs, F.lit(0)) + F.greatest(F.size("runs"), F.lit(0))
    out = held.select("k", F.array_max(F.concat("of_lines", "of_whole", plain, F.coalesce("runs", F.array().cast("array<struct<dice:double,ord:int,line:int>>")))).alias("m"), n_hits.alias("n_hits"))
    names = lambda f: F.get(F.array(*[F.lit(f(i)) for i in range(len(templates))]), -F.col("m.ord")) if templates else F.lit(None).cast("string")
    return out.select(
        F.col("k").alias(id_col), names(lambda i: templates[i][0]).alias("license"), names(lambda i: i).cast("int").alias("template"),
        F.round(F.coalesce(F.col("m.dice"), F.lit(0.0)), 6).alias("dice"), (-F.col("m.line")).alias("line"), F.col("n_hits").cast("long").alias("n_hits"),
    )
