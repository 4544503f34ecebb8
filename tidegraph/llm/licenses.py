"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest ancestor directory.

A template is one or more notices, one a line. A header is 1 to SPAN neighbouring lines of a text, or as many neighbouring words as a
notice has, wherever lines break; its best cosine to a notice counts if it is THRESHOLD or more (ties: fewer, then earlier lines, then the
template's name). Without such a header, the first title counts: a licence's name, word for word, with cosine 1. A text is a licence file if its name says so (license, licence, copying, notice, with any
ending) or if as a whole it has such a cosine. A file without a licence of its own inherits that of the nearest directory
at or above its own that holds a licence file with one (several in a directory: that of the smallest path, then name).

Inverse document frequencies come from the notices, a fixed set; a term of none of them weighs most. Lines and words are scored only
near an anchor: terms so chosen that, without any, the Cauchy-Schwarz bound keeps each cosine below THRESHOLD; so nothing is missed.

Inheritance joins paths: distinct directories, not files, are matched with their ancestors, so a directory that holds a third of all
files costs no more than another.

Cases: a null text has no licence of its own, but may inherit; a null path is the file's own nameless root and inherits nothing;
repeated rows are each scored; other columns are left as they are; with no licence file there is nothing to inherit.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table, written

THRESHOLD, SPAN = 0.75, 4
#: Words that make poor anchors; tried last.
_COMMON = frozenset("0 1 2 3 4 a all an and any are as at be but c can copy do event extent file following for form free from has if in is it its level may medium met no not of on one or other out person possible released s shall so source subject terms than that the these they this to under use v version via was whether which with without work works you your".split())
#: Of these, those that most texts have; last of all.
_FREQUENT = frozenset("a an and are as at be but by can do for from has if in is it may no not of on one or out so than that the these they this to was which with you your".split())
#: Short notices by which public licences ask to be named, and opening words of their texts.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met. Released under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0, Creative Commons Attribution 4.0 International.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0, Creative Commons Attribution-ShareAlike.",
    "CC0-1.0": "To the extent possible under law, all copyright and related or neighboring rights are waived. CC0 1.0 Universal public domain dedication.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Released under the ISC License.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Proprietary": "All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
}
_GNU = "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
for _name, _more in {
    "AGPL-3.0": _GNU.format("program", "Affero ", 3),
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "GPL-2.0": _GNU.format("program", "", 2),
    "GPL-3.0": _GNU.format("program", "", 3),
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-2.1": _GNU.format("library", "Lesser ", "2.1"),
    "LGPL-3.0": _GNU.format("library", "Lesser ", 3),
    "MIT-text": _MIT[: _MIT.index("The above")].strip() + "\n" + _MIT[_MIT.index("THE SOFTWARE") :],
}.items():
    TEMPLATES[_name] = f"{TEMPLATES[_name]}\n{_more}"
#: Names and first lines, which count only word for word, and only in a text without a header.
TITLES = {
    "AGPL-3.0": ("GNU Affero General Public License Version 3", "SPDX-License-Identifier: AGPL-3.0"),
    "Apache-2.0": ("Apache License Version 2.0", "Apache License 2.0", "SPDX-License-Identifier: Apache-2.0", "License: Apache-2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "SPDX-License-Identifier: BSD-2-Clause", "License: BSD-2-Clause"),
    "BSD-3-Clause": ("BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause", "License: BSD-3-Clause"),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0 International", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-NC-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "CC-BY-SA-4.0": ("Creative Commons Attribution-ShareAlike 4.0 International", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "CC0-1.0": ("CC0 1.0 Universal", "SPDX-License-Identifier: CC0-1.0"),
    "GPL-2.0": ("GNU General Public License Version 2", "SPDX-License-Identifier: GPL-2.0", "License: GPL-2.0"),
    "GPL-3.0": ("GNU General Public License Version 3", "SPDX-License-Identifier: GPL-3.0", "License: GPL-3.0"),
    "ISC": ("ISC License", "SPDX-License-Identifier: ISC", "License: ISC"),
    "LGPL-2.1": ("GNU Lesser General Public License Version 2.1", "SPDX-License-Identifier: LGPL-2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License Version 3", "SPDX-License-Identifier: LGPL-3.0"),
    "MIT": ("MIT License", "License: MIT", "SPDX-License-Identifier: MIT"),
    "MPL-2.0": ("Mozilla Public License Version 2.0", "SPDX-License-Identifier: MPL-2.0", "License: MPL-2.0"),
    "Proprietary": ("All rights reserved",),
    "Unlicense": ("The Unlicense", "SPDX-License-Identifier: Unlicense"),
}
_TERM = re.compile(r"[a-z0-9]+")
_NAMED = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"


class Templates:
    def __init__(self, texts: dict[str, str], threshold: float = THRESHOLD, titles: dict[str, tuple[str, ...]] = TITLES):
        self.threshold = threshold
        terms = [(k, Counter(_TERM.findall(x.lower()))) for k, t in sorted(texts.items()) for x in t.split("\n")]
        df = Counter(t for _, c in terms for t in c)
        self.idf = {t: math.log((1 + len(terms)) / (1 + n)) + 1 for t, n in df.items()}
        self.other = math.log(1 + len(terms)) + 1
        self.of: dict[str, list[tuple[int, float]]] = {}
        self.names, self.sizes = [k for k, _ in terms], [c.total() for _, c in terms]
        self.near: dict[str, list[int]] = {}  # an anchor's notices
        self.weights: list[dict[str, float]] = []
        for m, (_, c) in enumerate(terms):
            norm = math.sqrt(sum((n * self.idf[t]) ** 2 for t, n in c.items()))
            own = {t: n * self.idf[t] / norm for t, n in c.items()}
            self.weights.append({t: v * self.idf[t] for t, v in own.items()})
            for t, v in own.items():
                self.of.setdefault(t, []).append((m, v))
            left = 1.0
            for w, t in sorted(((v, t) for t, v in own.items()), key=lambda x: (x[1] in _FREQUENT, x[1] in _COMMON, -x[0], x[1])):
                if math.sqrt(max(left, 0)) < threshold - 1e-9:  # a header has cosine sqrt(left) at most without any of these
                    break
                self.near.setdefault(t, []).append(m)
                left -= w * w
        self.titles: dict[str, list[tuple[int, list[str], str]]] = {}  # by an anchor: its place, all terms, and the name
        for k, phrases in titles.items():
            for x in phrases:
                ts = _TERM.findall(x.lower())
                at = min(range(len(ts)), key=lambda i: (ts[i] in _COMMON, ts[i] not in self.near, -len(ts[i])))
                self.titles.setdefault(ts[at], []).append((at, ts, k))
        self.anchors = {*self.near, *self.titles}

    def cosine(self, terms: list[str]) -> tuple[float, str | None]:
        sums: dict[int, float] = {}
        square = 0.0
        for t, n in sorted(Counter(terms).items()):
            w = n * self.idf.get(t, self.other)
            square += w * w
            for m, v in self.of.get(t, ()):
                sums[m] = sums.get(m, 0.0) + w * v
        best = min(((-v, m) for m, v in sums.items()), default=None)
        return (-best[0] / math.sqrt(square), self.names[best[1]]) if best else (0.0, None)

    def windows(self, terms: list[str]) -> Iterator[tuple[float, int, int, str]]:
        """Cosine, start, length and name of every run of words as long as a notice that has THRESHOLD to it."""
        starts: dict[int, set[int]] = {}
        for i, t in enumerate(terms):
            for m in self.near.get(t, ()):
                starts.setdefault(m, set()).update(range(max(0, i - self.sizes[m] + 1), max(0, min(i, len(terms) - self.sizes[m])) + 1))
        for m, at in starts.items():
            size, weights, last, own, dot, square = min(self.sizes[m], len(terms)), self.weights[m], -2, Counter(), 0.0, 0.0
            for i in sorted(at):
                if i == last + 1:
                    t, new = terms[last], terms[i + size - 1]
                    w = self.idf.get(t, self.other) ** 2
                    square -= (2 * own[t] - 1) * w
                    own[t] -= 1
                    w = self.idf.get(new, self.other) ** 2
                    square += (2 * own[new] + 1) * w
                    own[new] += 1
                    dot += weights.get(new, 0.0) - weights.get(t, 0.0)
                else:
                    own = Counter(terms[i : i + size])
                    square = sum((n * self.idf.get(t, self.other)) ** 2 for t, n in own.items())
                    dot = sum(n * weights.get(t, 0.0) for t, n in own.items())
                last = i
                if dot >= (self.threshold - 1e-9) * math.sqrt(square):
                    yield dot / math.sqrt(square), i, size, self.names[m]

    def title(self, terms: list[str]) -> tuple[int, str] | None:
        """Start and name of the first title; at one start, that of most words."""
        found = [(i - at, -len(ts), k) for i, t in enumerate(terms) for at, ts, k in self.titles.get(t, ()) if i >= at and terms[i - at : i - at + len(ts)] == ts]
        return (min(found)[0], min(found)[2]) if found else None

    def header(self, text: str) -> tuple[str | None, float, int | None, bool]:
        """Licence, cosine, first line (from 0) of the best header; and whether the whole text is that of a licence."""
        lines = text.lower().split("\n")
        terms: list[list[str]] = [_TERM.findall(x) for x in lines]
        near = {i for i, ts in enumerate(terms) if not self.anchors.isdisjoint(ts)}
        if not near:
            return None, 0.0, None, False
        best: tuple = (0.0, 0, 0, "")
        for span in range(1, SPAN + 1):
            for i in sorted({j for k in near for j in range(max(0, k - span + 1), min(k, len(lines) - span) + 1)}):
                cos, name = self.cosine([t for ts in terms[i : i + span] for t in ts])
                if cos >= self.threshold and (-round(cos, 12), span, i, name) < best:
                    best = (-round(cos, 12), span, i, name)
        flat, of = [t for ts in terms for t in ts], [i for i, ts in enumerate(terms) for _ in ts]
        for cos, i, size, name in self.windows(flat):
            best = min(best, (-round(cos, 12), of[i + size - 1] - of[i] + 1, of[i], name))
        whole = self.cosine(flat)[0] >= self.threshold
        if not best[3] and (found := self.title(flat)):
            best = (-1.0, 1, of[found[0]], found[1])
        return (best[3].removesuffix("-text"), -best[0], best[2], whole) if best[3] else (None, 0.0, None, whole)


def scan(files: DataFrame, path: Column, text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """files without the text, with path, own_license, cosine, line, and is_license_file."""
    rest = [c for c in files.columns if c not in (text_col, "path", "own_license", "cosine", "line", "is_license_file")]
    rows = files.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), path.alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts, titles = templates or TEMPLATES, {} if templates else TITLES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(texts, titles=titles)
        # The last letters are those that lower() or RE2's folding take for ASCII ones.
        some = f"(?i:(^|[^a-z0-9])({'|'.join(sorted(known.anchors))})([^a-z0-9]|$))|[\u0130\u017f\u212a]"
        for batch in batches:
            col = batch.column("text")
            said = [(None, 0.0, None, False)] * len(col)
            for i in pc.indices_nonzero(pc.match_substring_regex(col, some)).to_pylist():
                said[i] = known.header(col[i].as_py())
            kinds = [pa.string(), pa.float64(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("path"), *(pa.array([x[i] for x in said], k) for i, k in enumerate(kinds))], names=["row", "path", "own_license", "cosine", "line", "whole"])

    kind = rows.schema["row"].dataType.simpleString()
    out = rows.mapInArrow(run, f"row {kind}, path string, own_license string, cosine double, line int, whole boolean")
    return out.select("row.*", "path", "own_license", "cosine", "line", (F.col("whole") | F.coalesce(F.col("path").rlike(_NAMED), F.lit(False))).alias("is_license_file"))


def inherit(scanned: DataFrame) -> DataFrame:
    """scanned with license and how: own, inherited or null."""
    scanned = written(scanned)
    folder = F.regexp_replace(F.regexp_replace("path", "[^/]*$", ""), "/+$", "")
    files = scanned.withColumn("_dir", folder)
    holders = files.filter("is_license_file and own_license is not null").groupBy(F.col("_dir").alias("_up")).agg(F.min(F.struct("path", "own_license")).alias("l")).select("_up", F.col("l.own_license").alias("_l"))
    dirs = files.select("_dir").filter(F.col("_dir").isNotNull()).distinct()
    steps = F.split("_dir", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.struct(n.alias("deep"), F.array_join(F.slice(steps, 1, n), "/").alias("_up")))
    reach = dirs.select("_dir", F.inline(F.when(F.col("_dir") == "", F.array(F.struct(F.lit(0).alias("deep"), F.lit("").alias("_up")))).otherwise(F.concat(F.array(F.struct(F.lit(0).alias("deep"), F.lit("").alias("_up"))), ups))))
    nearest = reach.join(holders, "_up").groupBy("_dir").agg(F.max_by("_l", "deep").alias("_near"))
    out = files.join(nearest, "_dir", "left")
    own = F.col("own_license").isNotNull()
    return out.withColumn("license", F.coalesce("own_license", "_near")).withColumn("how", F.when(own, "own").when(F.col("_near").isNotNull(), "inherited")).drop("_dir", "_near")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files source/lang/doc_id.txt."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.concat_ws("/", F.coalesce("source", F.lit("_")), F.coalesce("lang", F.lit("_")), F.coalesce(F.col("doc_id").cast("string"), F.lit("_"))), F.lit(".txt"))
    out = inherit(scan(docs.select("doc_id", "text", "source", "lang"), path))
    return out.select("doc_id", "path", "license", "how", F.round("cosine", 9).alias("cosine"), "line", "is_license_file")
