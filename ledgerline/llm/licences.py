"""Licence scan: sparse TF-IDF cosine of licence passages to templates, then inheritance from the nearest ancestor directory.

A file's blocks are its runs of paragraphs with licence words, wherever in the text they stand; a paragraph ends at a line
without words and where comment lines begin or end. A block is matched whole, with its lines that hold no licence word;
if nothing is found, its paragraphs are, and in a paragraph where nothing is found the runs of sentences and lines with
licence words. In a licence file (by name, or if what is matched holds half its words) the whole text is matched too. These
passages and templates are sparse TF-IDF vectors: postings of the templates' words hold their weights, and a passage's words
add up its products with each template. Document frequencies of the templates' words are counted over all files; a word that
is in no template has no coordinate in common with any, and counts with the least weight, 1, in the passage's length, so that
names of holders and projects do not drown a notice. A file's own licence is the template of the best cosine, if that is LEAST
or more; of equal cosines the first name in alphabetical order is taken.
A directory has the licence of its best licence file. A file without one of its own inherits from the nearest directory
above it that has one, by a join of distinct directories with all their ancestors.

Null text is empty text, a null path is in no directory and inherits nothing: files without paths have their own licences
only. Repeated rows get equal results. Texts of any length are searched whole, very long ones alone. An empty table gives an
empty result. Other columns stay; those that have the name of a result column are renamed by an underscore at the end.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import apart, sliced, stored, worker

_CC = ("Licensed under CC {0}.", "This work is licensed under a Creative Commons {1} International License.", "Creative Commons {1} CC {0}")
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT license. See LICENSE file in the project root for license information.", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software. The Software is provided as is, without warranty of any kind."),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, without warranties or conditions of any kind.", "Apache License Version 2.0, January 2004 terms and conditions for use, reproduction, and distribution"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version."),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; version 3 of the License."),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0", "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License, version 3."),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: redistributions of source code must retain the above copyright notice. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products."),
    "MPL-2.0": ("Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    "ISC": ("Licensed under the ISC License.", "SPDX-License-Identifier: ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"),
    "CC0-1.0": ("Licensed under CC0 1.0 Universal public domain dedication.", "SPDX-License-Identifier: CC0-1.0"),
    "Proprietary": ("All rights reserved.", "Copyright, all rights reserved. Proprietary and confidential; unauthorized copying of this file is strictly prohibited."),
} | {f"CC-{k}": tuple(t.format(f"{k[:-4]} {k[-3:]}", v) for t in _CC) for k, v in (("BY-4.0", "Attribution 4.0"), ("BY-SA-4.0", "Attribution ShareAlike 4.0"), ("BY-NC-4.0", "Attribution NonCommercial 4.0"), ("BY-ND-4.0", "Attribution NoDerivatives 4.0"), ("BY-NC-SA-4.0", "Attribution NonCommercial ShareAlike 4.0"))}
LEAST = 0.6
#: Up to so many directories with a licence (some 100 bytes each) are broadcast.
BROADCAST_DIRECTORIES = 100_000
TERM = re.compile(r"[a-z]+|[0-9]+(?:\.[0-9]+)*")
SENTENCE = re.compile(r"\n|(?<=[.!?;])\s+")
HINTS = ("licen", "copyright", "spdx", "rights reserved", "public domain", "creative commons", "redistribut", "hereby granted", "warranty")
#: Comments of several lines, how they begin and end; how a comment's line begins.
COMMENTS, MARKS = (("/*", "*/"), ("<!--", "-->")), ("#", "//", "--", ";", "%")
WORDS = re.compile(r"[A-Za-z0-9]")
FILE_NAME = re.compile(r"(?i)^(licen[cs]e|copying|copyright|notice|unlicense)([.\-_].*)?$")


def terms(text: str) -> list[str]:
    return TERM.findall(text.lower())


def passages(text: str) -> list[str]:
    """Runs of sentences and lines with licence words."""
    if not any(h in text.lower() for h in HINTS):
        return []
    out, run = [], []
    for part in SENTENCE.split(text):
        if any(h in part.lower() for h in HINTS):
            run.append(part)
        elif run:
            out.append(" ".join(run))
            run = []
    return [*out, " ".join(run)] if run else out


def blocks(text: str) -> list[list[str]]:
    """Runs of paragraphs with licence words, each a list of its paragraphs."""
    if not any(h in text.lower() for h in HINTS):
        return []
    out: list[list[str]] = []
    lines: list[str] = []
    kind, inside, joins = False, "", False

    def close() -> None:
        nonlocal joins
        if lines:
            paragraph = "\n".join(lines)
            if not any(h in paragraph.lower() for h in HINTS):
                joins = False
            elif joins:
                out[-1].append(paragraph)
            else:
                out.append([paragraph])
                joins = True
            lines.clear()

    for line in text.split("\n"):
        bare = line.strip()
        opens = next((e for b, e in COMMENTS if bare.startswith(b)), "") if not inside else ""
        comment = bool(inside or opens or bare.startswith(MARKS))
        inside = inside or opens
        if inside and inside in bare:
            inside = ""
        if not WORDS.search(bare):
            close()
            continue
        if comment != kind:
            close()
            kind, joins = comment, False
        lines.append(line)
    close()
    return out


class Matcher:
    """TF-IDF vectors of the templates, given each word's document frequency among n files."""

    def __init__(self, frequency: dict[str, int], n: int):
        self.names = [k for k in sorted(TEMPLATES) for _ in TEMPLATES[k]]
        bags = [Counter(terms(t)) for k in sorted(TEMPLATES) for t in TEMPLATES[k]]
        self.idf = {w: math.log((n + 1) / (frequency.get(w, 0) + 1)) + 1 for w in set().union(*bags)}
        #: of each word the templates that hold it, and its weights there
        self.postings: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        vectors = [self._vector(b) for b in bags]
        for w in self.idf:
            at = [k for k, (x, _) in enumerate(vectors) if w in x]
            self.postings[w] = np.array(at), np.array([vectors[k][0][w] / vectors[k][1] for k in at])

    def _vector(self, bag: Counter) -> tuple[dict[str, float], float]:
        """The weights of the words that are in templates, and the length of the whole vector."""
        x = {w: (1 + math.log(c)) * self.idf[w] for w, c in bag.items() if w in self.idf}
        return x, math.sqrt(sum(v * v for v in x.values()) + len(bag) - len(x))

    def match(self, passage: str) -> tuple[str, float] | None:
        x, length = self._vector(Counter(terms(passage)))
        scores = np.zeros(len(self.names))
        for w, v in x.items():
            at, weights = self.postings[w]
            scores[at] += v * weights
        scores /= length or 1.0
        k = int(np.argmax(np.round(scores, 9)))
        return (self.names[k], float(scores[k])) if scores[k] >= LEAST else None


def matched(m: Matcher, text: str) -> tuple[list[tuple[str, float]], int]:
    """Licences found in the text's blocks, and the words of the parts that were compared."""
    tried, words = [], 0
    for block in blocks(text):
        found = m.match("\n".join(block))
        parts = [("\n".join(block), found)] if found else [(x, m.match(x)) for x in block]
        for part, found in parts:
            smaller = [] if found else passages(part)
            tried += [found] if found else [f for f in map(m.match, smaller) if f]
            words += len(part.split()) if found else sum(len(x.split()) for x in smaller)
    return tried, words


_COUNTS = "term string, n bigint"
#: What own_licences() adds, and what licences() does.
OWN, FOUND = ("own_licence", "own_score", "n_passages", "licence_file"), ("licence", "inherited_from")


def frequencies(files: DataFrame, text: str = "text") -> tuple[dict[str, int], int]:
    """In how many files each word of the templates occurs (a few hundred words), and how many files there are."""
    words = frozenset(w.encode() for t in TEMPLATES.values() for x in t for w in terms(x))
    table = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c == 46 else 32 for c in range(256))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        n = 0
        for batch in (x for b in batches for x in sliced(b, 0)):
            n += batch.num_rows
            for t in batch.column(0).to_pylist():
                if t:
                    counts.update(words.intersection(w.strip(b".") for w in t.encode().translate(table).split()))
        yield pa.RecordBatch.from_arrays([pa.array([None, *(w.decode() for w in counts)], pa.string()), pa.array([n, *counts.values()], pa.int64())], ["term", "n"])

    rows = files.select(text).mapInArrow(worker(run), _COUNTS).groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r["term"]: r["n"] for r in rows}
    return found, found.pop(None, 0)


def own_licences(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """The columns of `files` but the text, with own_licence, own_score, n_passages and licence_file."""
    matcher = Matcher(*frequencies(files, text))
    shared = files.sparkSession.sparkContext.broadcast(matcher)
    files = apart(files, OWN)
    at, place = files.columns.index(text), files.columns.index(path)
    fields = [f for f in files.schema.fields if f.name != text]
    kept = [files.columns.index(f.name) for f in fields]
    out = T.StructType([*fields, T.StructField("own_licence", T.StringType()), T.StructField("own_score", T.DoubleType()), T.StructField("n_passages", T.LongType()), T.StructField("licence_file", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in (x for b in batches for x in sliced(b, at)):
            names, scores, counts, licence_files = [], [], [], []
            for p, t in zip(batch.column(place).to_pylist(), batch.column(at).to_pylist(), strict=True):
                found = passages(t) if t else []
                tried, words = matched(m, t) if found else ([], 0)
                whole = bool(p and FILE_NAME.match(p.rsplit("/", 1)[-1])) or bool(found and 2 * words >= len(t.split()))
                tried += [x for x in [m.match(t)] if x] if whole and t else []
                best = min(tried, key=lambda x: (-round(x[1], 9), x[0]), default=(None, None))
                names.append(best[0])
                scores.append(None if best[1] is None else round(best[1], 6))
                counts.append(len(found))
                licence_files.append(whole and best[0] is not None)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(counts, pa.int64()), pa.array(licence_files, pa.bool_())], names=out.names)

    return files.mapInArrow(worker(run), out)


def licences(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """own_licences() with licence (own or inherited) and inherited_from (the directory, null where the licence is the file's own)."""
    names = ("ledgerline_dir", "ledgerline_from", "ledgerline_licence", "ledgerline_above", "ledgerline_depth")
    here, origin, inherited, upper, depth = names
    own = stored(own_licences(apart(files, (*FOUND, *names)), path, text), "licences")
    folder = lambda c: F.when(F.instr(c, "/") > 0, F.regexp_replace(c, "/[^/]*$", "")).otherwise(F.when(c.isNotNull(), F.lit("")))
    own = own.withColumn(here, folder(F.col(path)))
    # of a directory's licence files the best: one row for each directory, aggregated before any shuffle
    best = F.min(F.struct((-F.col("own_score")).alias("s"), F.col("own_licence").alias("l")))
    known = own.where(F.col("licence_file") & F.col(here).isNotNull()).groupBy(here).agg(best.alias("b")).select(F.col(here).alias(upper), F.col("b.l").alias(inherited))
    parts = F.split(here, "/")
    above = own.where(F.col(here).isNotNull()).select(here).distinct().select(here, F.posexplode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias(depth, upper))
    # the root, of no parts, is above all; the deepest ancestor that has a licence file, itself first
    nearest = above.join(known, upper).groupBy(here).agg(F.max(F.struct(depth, upper, inherited)).alias("n")).select(here, F.col(f"n.{upper}").alias(origin), F.col(f"n.{inherited}").alias(inherited))
    # a table of its own: a directory with a third of the files can then be split by the join, or the few rows be broadcast
    nearest = stored(nearest, "nearest")
    out = own.join(F.broadcast(nearest) if nearest.count() <= BROADCAST_DIRECTORIES else nearest.hint("merge"), here, "left")
    return out.withColumns({"licence": F.coalesce("own_licence", inherited), "inherited_from": F.when(F.col("own_licence").isNull(), F.col(origin))}).drop(here, origin, inherited)
