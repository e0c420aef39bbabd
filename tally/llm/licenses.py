"""License scans: sparse TF-IDF cosine to license templates, nearest-ancestor inheritance by path joins.

Texts are cut into sections (a line, or consecutive lines that each hold a word of the
templates; comment marks are no words).  Sections and templates become sparse TF-IDF
vectors over words; idf comes from all sections of the corpus.  A section's license is its
nearest template with a cosine of at least ``threshold`` among those that agree with it on
names and numbers: the section has all of the template's, and no other license's name.  So a
license without a template is unknown rather than its sibling.  Templates are notices, title
lines and opening sentences, not whole texts; the BSD sentence is told by the clauses that
the text has besides.  A file has the license of its best section.  A file is a licence file if its name says so or its text as a whole is near a
template.  A file without a license of its own inherits that of the licence file in the
nearest directory above it.

Null and empty texts have no section and inherit; a null path has no directory, and nothing
is inherited by it.  Ties go to the first template by name; of licence files in one
directory the best counts, then the smallest path.  Repeated rows are rows.  An empty table
gives an empty result; columns but the id, path and text are not read.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tally.llm.common import attach_groups, bounded_batches, salted, same, written

THRESHOLD = 0.6
# Usual notices by which files state a license.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                   "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
                   "Apache License Version 2.0, January 2004", "SPDX-License-Identifier: Apache-2.0"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "The MIT License (MIT)", "MIT License",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
            "(the \"Software\"), to deal in the Software without restriction", "SPDX-License-Identifier: MIT"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
                "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "SPDX-License-Identifier: GPL-3.0"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
                "SPDX-License-Identifier: GPL-2.0"],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
                 "SPDX-License-Identifier: LGPL-3.0"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "BSD 3-Clause License",
                     "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
                     "SPDX-License-Identifier: BSD-3-Clause"],
    "MPL-2.0": ["Licensed under the Mozilla Public License, Version 2.0.", "Mozilla Public License Version 2.0",
                "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.",
                  "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Licensed under CC0 1.0.", "CC0 1.0 Universal Public Domain Dedication", "SPDX-License-Identifier: CC0-1.0"],
    "ISC": ["Licensed under the ISC License.", "ISC License", "SPDX-License-Identifier: ISC",
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies."],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "BSD 2-Clause License", "SPDX-License-Identifier: BSD-2-Clause"],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.",
                 "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
                 "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
                 "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
                 "SPDX-License-Identifier: AGPL-3.0"],
    "LGPL-2.1": ["This work is licensed under the GNU Lesser General Public License, version 2.1.",
                 "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", "SPDX-License-Identifier: LGPL-2.1"],
    "EPL-2.0": ["Licensed under the Eclipse Public License, Version 2.0.", "Eclipse Public License - v 2.0", "SPDX-License-Identifier: EPL-2.0"],
    "EPL-1.0": ["Licensed under the Eclipse Public License, Version 1.0.", "Eclipse Public License - v 1.0", "SPDX-License-Identifier: EPL-1.0"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0.", "Boost Software License - Version 1.0", "SPDX-License-Identifier: BSL-1.0"],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
                     "SPDX-License-Identifier: CC-BY-ND-4.0"],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0.", "SPDX-License-Identifier: CC-BY-NC-SA-4.0",
                        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "CC-BY-NC-ND-4.0": ["Licensed under CC BY-NC-ND 4.0.", "SPDX-License-Identifier: CC-BY-NC-ND-4.0",
                        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
# Words that name one license or a variant, in one spelling.
NAMES = {w: w for w in "apache mit isc bsd 0bsd gnu gpl lgpl agpl lesser affero mozilla mpl eclipse epl boost bsl zlib artistic eupl wtfpl cc0 "
         "academic python openssl postgresql microsoft sa nc nd".split()}
NAMES |= {"sharealike": "sa", "noncommercial": "nc", "noderivatives": "nd", "noderivs": "nd"}
NUMBERED = re.compile(r"([a-z]*?)v?([1-9](?:[.][0-9]+)*)")  # a version or clause number, and what stands before it
# Words without which a section states no license, unless a template has none of them.
ANCHORS = set("license licence licensed licenses released redistribution permission domain dedication spdx free cc cc0 mit bsd apache gnu mozilla".split())
FILE_NAMES = r"(?i)^(licen[cs]e|copying|unlicense|notice)([-_.][^/]*)?$"
WORD = re.compile(r"[a-z0-9]+(?:[.][0-9]+)*")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def vocabulary(templates: dict[str, list[str]]) -> set[str]:
    return {w for notes in templates.values() for t in notes for w in words(t)}


def marks(found: Iterable[str]) -> tuple[set[str], set[str]]:
    """Names, and version and clause numbers, among words."""
    names, numbers = set(), set()
    for w in found:
        if w in NAMES:
            names.add(NAMES[w])
        elif m := NUMBERED.fullmatch(w):
            names |= {NAMES[m[1]]} if m[1] in NAMES else set()
            if not m[1] or m[1] in NAMES:
                numbers.add(re.sub(r"(?:[.]0)+$", "", m[2]))
    return names, numbers


def anchors(templates: dict[str, list[str]]) -> set[str]:
    """Words one of which a section must have: of a template without a usual one, its names and longer words."""
    out = set(ANCHORS)
    for note in (n for notes in templates.values() for n in notes):
        w = set(words(note))
        if w.isdisjoint(ANCHORS):
            out |= {x for x in w if x in NAMES or len(x) > 4} or w
    return out


def told_by_clauses(license: str | None, text: str) -> str | None:
    """Of a text with the sentence that the BSD licenses share, the license by its clauses; none if it has none."""
    if license != "BSD-3-Clause" or (found := " ".join(words(text))).find("bsd 3 clause") >= 0:
        return license
    if "endorse or promote" in found:
        return license
    return "BSD-2-Clause" if "binary form must reproduce" in found else None


def sections(text: str, known: set[str], anchored_by: set[str]) -> Iterator[Counter]:
    """Word counts of the lines with an anchor word, and of runs of such and neighbouring lines of template words."""
    run: list[list[str]] = []
    anchored = 0
    for line in [*text.split("\n"), ""]:
        w = words(line) if line.strip() else []
        hits = sum(x in known for x in w)
        anchor = not anchored_by.isdisjoint(w)
        if anchor:
            yield Counter(w)
        if w and 2 * hits >= len(w):
            run.append(w)
            anchored += anchor
            continue
        if len(run) > 1 and anchored:
            yield Counter(x for part in run for x in part)
        run, anchored = [], 0


class Cosine:
    """Cosine of a section to every template, by the words they share."""

    def __init__(self, templates: dict[str, list[str]], idf: dict[str, float], rare: float):
        self.idf, self.rare = idf, rare
        self.at: dict[str, list[tuple[int, float]]] = {}
        self.names, self.marks = [], []
        for name in sorted(templates):
            for note in templates[name]:
                v = self._vector(Counter(words(note)))
                for w, x in v.items():
                    self.at.setdefault(w, []).append((len(self.names), x))
                self.names.append(name)
                self.marks.append(marks(v))

    def _vector(self, counts: Counter) -> dict[str, float]:
        v = {w: (1 + math.log(n)) * self.idf.get(w, self.rare) for w, n in counts.items()}
        size = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {w: x / size for w, x in v.items()}

    def nearest(self, counts: Counter) -> tuple[float, str | None]:
        total: Counter = Counter()
        for w, x in self._vector(counts).items():
            for i, y in self.at.get(w, ()):
                total[i] += x * y
        names, numbers = marks(counts)
        total = {i: x for i, x in total.items() if self.marks[i][0] == names and self.marks[i][1] <= numbers}
        if not total:
            return 0.0, None
        i = min(total, key=lambda k: (-round(total[k], 12), k))
        return min(1.0, total[i]), self.names[i]


def word_weights(docs: DataFrame, templates: dict[str, list[str]], text_col: str = "text") -> tuple[dict[str, float], float]:
    """idf of the templates' words over all sections of all texts, and of words that no template has.

    Other words weigh like a word of a single section; counting them all would change
    only the length of a section's vector."""
    known = vocabulary(templates)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for line in (text or "").split("\n"):
                    if w := set(words(line)):
                        seen.update(w & known)
                        seen[""] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    parts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "word string, n long")
    found = {r["word"]: r["n"] for r in parts.groupBy("word").agg(F.sum("n").alias("n")).collect()}  # the templates' words
    total = found.get("", 0)
    return {w: math.log((1 + total) / (1 + found.get(w, 0))) + 1 for w in known}, math.log(1 + total) + 1


def stated(docs: DataFrame, templates: dict[str, list[str]], threshold: float) -> DataFrame:
    """(id, path, license, score, whole): the best section of every text, and the cosine of the text as a whole."""
    idf, rare = word_weights(docs, templates)
    known, anchored_by = vocabulary(templates), anchors(templates)
    schema = T.StructType([docs.schema["id"], docs.schema["path"], T.StructField("license", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("whole", T.DoubleType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cosine = Cosine(templates, idf, rare)
        for batch in batches:
            names, scores, whole = [], [], []
            for text in batch.column(2).to_pylist():
                best = max((cosine.nearest(s) for s in sections(text or "", known, anchored_by)), key=lambda x: x[0], default=(0.0, None))
                name = told_by_clauses(best[1], text) if best[0] >= threshold else None
                ok = name is not None
                names.append(name)
                scores.append(round(best[0], 9) if ok else None)
                whole.append(cosine.nearest(Counter(words(text)))[0] if ok and text else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64()),
                                              pa.array(whole, pa.float64())], names=schema.names)

    return docs.select("id", "path", "text").mapInArrow(scan, schema)


def license_of_files(docs: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text",
                     templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Id, path, license, score, origin (``stated``, ``inherited`` or null) and the path it comes from."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    files = written(stated(rows, templates or TEMPLATES, threshold)
                    .withColumn("dir", F.regexp_replace("path", "/?[^/]*$", "")), "license-files")
    name = F.regexp_extract("path", "[^/]*$", 0)
    found = files.filter("license is not null and path is not null").filter(name.rlike(FILE_NAMES) | (F.col("whole") >= threshold))
    above = (found.groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("path"), F.col("license"))).alias("file"))
             .withColumnRenamed("dir", "up"))

    def nearest(dirs: DataFrame) -> DataFrame:
        """Per directory the licence file of the nearest directory at or above it."""
        parts = F.split("dir", "/")
        step = F.posexplode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))
        ways = dirs.filter("dir is not null").select("dir", step.alias("depth", "up")).distinct()
        best = ways.join(above, "up").groupBy("dir").agg(F.max_by("file", "depth").alias("file"))
        return same(dirs, best, ["dir"], "left")

    full = attach_groups(salted(files, "id", "path"), ["dir"], {"n": F.count("*")}, {"n": F.sum("n")}, nearest)
    own = F.col("license").isNotNull()
    origin = F.when(own, "stated").when(F.col("file").isNotNull(), "inherited")
    return full.select(F.col("id").alias(id_col), F.col("path").alias(path_col), F.coalesce("license", "file.license").alias("license"), "score",
                       origin.alias("origin"), F.when(own, F.col("path")).otherwise(F.col("file.path")).alias("license_path"))
