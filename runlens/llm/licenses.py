"""Licence scans: TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Templates are short notices, multi-line headers, licence bodies, whole licence texts (the files
of licence_texts) and SPDX identifiers. A file that has a word which a template asks for (any
other can't match one) becomes one sequence of words over all its lines, so comment signs and line
ends do not matter.
Every span of it that is about as long as a template (SPANS) is compared with the template:
sparse TF-IDF vectors with smoothed idf over the templates; a word that no template has weighs as
the rarest. So words around a contained notice do not dilute it. A span must have the words
that name the licence (in braces in the short templates, KEYS for the whole texts) and none that
would make it another one (BARRED: what is not for commerce is no plain Attribution), and reach
LEAST, or LEAST_LONG for templates of more than LONG words. An SPDX identifier is one word, so
one that only begins like a known one is unknown. A file's own licence is that of its best span. A licence file speaks for its directory; a file without a licence of its own takes
that of the nearest directory above it that has one.

What moves: one row per file and directory above it towards the directories that have a
licence. The template table has a fixed size and is broadcast.

Defined results: null is the empty text; ties between templates go to the longest, then to the
first name, between licence files of a directory to the first path; files without any licence
have nulls. A null path has no directory. Repeated rows repeat their result. Extra columns are
ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import durable, in_arrow, text_of

LEAST, LEAST_LONG, LONG = 0.6, 0.8, 30
#: Lengths of the compared spans, as shares of a template's length.
SPANS = (0.7, 0.85, 1.0, 1.2)
#: A word: letters, a number with inner dots, or an SPDX identifier behind its sign.
TOKEN = r"=[a-z0-9.+-]+|[a-z]+|[0-9]+(?:\.[0-9]+)*"
MENTION = r"(?i)licen[cs]e|spdx|copyright|public domain|permission is hereby granted|redistribution and use"
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense|notice)([.-][^/]*)?$"

# Notices and headers by which public licences are named. Words between braces name the licence.
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation,"
    " either version {} of the License, or (at your option) any later version."
)
_GNU_ONLY = "This program is free software; you can redistribute it and/or modify it under the terms of the {}, version {}, as published by the Free Software Foundation."
_GNU_NAMES = (
    ("AGPL-3.0", "{GNU} {Affero} {General} {Public} License", "3"),
    ("GPL-1.0", "{GNU} {General} {Public} License", "1"),
    ("GPL-2.0", "{GNU} {General} {Public} License", "2"),
    ("GPL-3.0", "{GNU} {General} {Public} License", "3"),
    ("LGPL-2.0", "{GNU} {Library} {General} {Public} License", "2"),
    ("LGPL-2.1", "{GNU} {Lesser} {General} {Public} License", "2.1"),
    ("LGPL-3.0", "{GNU} {Lesser} {General} {Public} License", "3"),
)
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."
_BSD = (
    "{Redistribution} and {use} in {source} and {binary} forms, with or without modification, are permitted provided that the following conditions are met:"
    " Redistributions of source code must {retain} the above copyright notice, this list of conditions and the following disclaimer."
    " Redistributions in binary form must {reproduce} the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_NAMES = " {Neither} the {name} of the copyright holder nor the names of its contributors may be used to {endorse} or promote products derived from this software without specific prior written permission."
_BSD_END = " This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed."
_SHORT = (
    ("Apache-2.0", "Licensed under the {Apache} License, Version {2.0}."),
    ("Apache-2.0", "{Apache} License Version {2.0}, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Licensed under the {Apache} License, Version {2.0} (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-2-Clause", "Licensed under the {BSD} {2}-{Clause} License. Redistribution and use in source and binary forms are permitted."),
    ("BSD-2-Clause", "Licensed under the {BSD} {2}-{Clause} License."),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", "Licensed under the {BSD} {3}-{Clause} License. Redistribution and use in source and binary forms are permitted."),
    ("BSD-3-Clause", "Licensed under the {BSD} {3}-{Clause} License."),
    ("BSD-3-Clause", _BSD + _BSD_NAMES + _BSD_END),
    ("BSD-2-Clause", "Released under the {Simplified} {BSD} License."),
    ("BSD-3-Clause", "Released under the {Modified} {BSD} License."),
    ("BSD-3-Clause", "Released under the {New} {BSD} License."),
    ("BSD-4-Clause", _BSD + " All {advertising} materials mentioning features or use of this software must display the following {acknowledgement}: This product includes software developed by the copyright holder." + _BSD_NAMES + _BSD_END),
    ("BSL-1.0", "Distributed under the {Boost} Software License, Version {1.0}."),
    ("CC0-1.0", "Released into the public domain under {CC0} {1.0} Universal."),
    ("EPL-2.0", "Licensed under the {Eclipse} {Public} License, version {2.0}."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the {Eclipse} {Public} License {2.0} which is available at https://www.eclipse.org/legal/epl-2.0"),
    ("ISC", "Released under the {ISC} License."),
    ("ISC", "{Permission} to {use}, copy, modify, and/or {distribute} this software for any {purpose} with or without {fee} is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "{Permission} to {use}, copy, modify, and/or {distribute} this software for any {purpose} with or without {fee} is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _AS_IS),
    ("MIT", "Released under the {MIT} License."),
    ("MIT", "Use of this source code is governed by an {MIT}-style license that can be found in the LICENSE file."),
    ("MIT", "{Permission} is hereby {granted}, free of {charge}, to any person obtaining a copy of this software and associated documentation files."),
    ("MIT", "{Permission} is hereby {granted}, free of {charge}, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, {sublicense}, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the {Mozilla} {Public} License, v. {2.0}."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the {Mozilla} {Public} License, v. {2.0}. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and {unencumbered} software released into the public {domain}."),
    ("Unlicense", "This is free and {unencumbered} software released into the public {domain}. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("WTFPL", "{Do} {what} the fuck you {want} to {public} license."),
    ("Zlib", "This software is provided as-is, without any express or implied warranty. {Permission} is granted to anyone to use this software for any purpose, including commercial applications, and to {alter} it and redistribute it freely. The {origin} of this software must not be {misrepresented}."),
    ("AGPL-3.0", "{GNU} {Affero} General Public License Version {3}, {19} {November} {2007}"),
)
_DOCUMENTS = "Permission is granted to copy, distribute and/or modify this document under the terms of the {{GNU}} {{Free}} {{Documentation}} License, Version {{{}}} or any later version published by the Free Software Foundation."
#: The Creative Commons licences: their letters, and the words that stand for them.
_CC_WORDS = {"BY": "Attribution", "NC": "NonCommercial", "SA": "ShareAlike", "ND": "NoDerivatives"}
_CC = tuple((f"CC-{letters}-{v}", letters.split("-"), v) for letters in ("BY", "BY-NC", "BY-SA", "BY-ND", "BY-NC-SA", "BY-NC-ND") for v in ("2.0", "2.5", "3.0", "4.0"))
#: Words that must not stand in a span, by the beginning of the licence's name.
_LIMITS = frozenset("nc sa nd noncommercial sharealike noderivatives".split())
BARRED = {"GPL-": frozenset("lesser library affero lgpl agpl".split()), "BSD-2-Clause": frozenset("advertising endorse modified new".split()), "BSD-3-Clause": frozenset(["advertising", "simplified"])}
_GNU_SHORT = (("This work is licensed under the {}, version {}."), ("Licensed under the {} version {} or later."), _GNU, _GNU_ONLY)
#: SPDX identifiers by licence; every word of one must be in the span.
_SPDX = (
    *((name, f"{name}{end}") for name, _, _ in _GNU_NAMES for end in ("", "+", "-only", "-or-later")),
    *((name, name) for name, _, _ in _CC),
    *((f"GFDL-{v}", f"GFDL-{v}{end}") for v in ("1.1", "1.2", "1.3") for end in ("", "-only", "-or-later")),
    *((name, name) for name in "Apache-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC0-1.0 EPL-2.0 ISC MIT MPL-1.1 MPL-2.0 Unlicense WTFPL Zlib".split()),
    *((name, name) for name in "0BSD AFL-3.0 Apache-1.1 Artistic-2.0 BSD-3-Clause-Clear BSD-4-Clause CDDL-1.0 EPL-1.0 EUPL-1.2 MIT-0 MS-PL NCSA OFL-1.1 PSF-2.0 PostgreSQL Python-2.0 UPL-1.0".split()),
)
#: The words that name the licence of a whole text.
KEYS = {
    "Apache-2.0": "apache 2.0 contributor", "CC0-1.0": "cc0 waiver", "GPL-1.0": "gnu general public 1", "GPL-2.0": "gnu general public 2", "GPL-3.0": "gnu general public 3",
    "LGPL-2.0": "gnu library 2", "LGPL-2.1": "gnu lesser 2.1", "LGPL-3.0": "gnu lesser 3", "MPL-1.1": "mozilla public 1.1", "MPL-2.0": "mozilla public 2.0",
}


def words(text: str) -> list[str]:
    """The words of a text, with one spelling for `licence`, `v2`, `GPLv2`, `2.0`, `non-commercial` and the like; an SPDX identifier is one."""
    low = re.sub(r"(?<![a-z])v\.? ?(?=[0-9])|(?<=gpl)v(?=[0-9])", " version ", text.lower())
    low = low.replace("licence", "license").replace("=", " ")
    low = re.sub(r"(spdx-license-identifier:[ \t]*\(*)([a-z0-9.+-]+)", r"\1 =\2 ", low)
    low = re.sub(r"(?<![a-z])non[ -]commercial", "noncommercial", low)
    low = re.sub(r"(?<![a-z])no[ -]?deriv(?:ative)?s?(?![a-z])(?: works)?", "noderivatives", low)
    low = re.sub(r"(?<![a-z])share[ -]alike", "sharealike", low)
    return [w if w[0] == "=" else re.sub(r"(?:\.0)+$", "", w) for w in re.findall(TOKEN, low)]


def _templates() -> list[tuple[str, str, frozenset[str]]]:
    """(licence, text, words that a span must have)."""
    made = [*_SHORT, *((f"GFDL-{v}", _DOCUMENTS.format(v)) for v in ("1.1", "1.2", "1.3"))]
    for name, letters, v in _CC:
        made.append((name, f"Licensed under {{CC}} {'-'.join('{' + x + '}' for x in letters)} {{{v}}}."))
        made.append((name, f"Licensed under a {{Creative}} {{Commons}} {'-'.join('{' + _CC_WORDS[x] + '}' for x in letters)} {{{v}}} International License."))
    made += [(name, f"License: {{{name.split('-')[0]}}} version {{{version}}}") for name, _, version in _GNU_NAMES]
    for form in _GNU_SHORT:
        made += [(name, form.format(title, "{" + version + "}")) for name, title, version in _GNU_NAMES]
    found = [(name, re.sub(r"[{}]", "", text), frozenset(w for part in re.findall(r"\{([^}]*)\}", text) for w in words(part))) for name, text in made]
    found += [(name, f"SPDX-License-Identifier: {spdx}", frozenset(["spdx", "identifier", f"={spdx.lower()}"])) for name, spdx in _SPDX]
    for name, keys in KEYS.items():
        text = (Path(__file__).parent / "licence_texts" / f"{name}.txt").read_text(encoding="utf-8")
        found.append((name, text, frozenset(words(keys))))
    return found


def barred(name: str, keys: frozenset[str]) -> frozenset[str]:
    """The words that a span of the licence must not have."""
    words_ = next((w for start, w in BARRED.items() if name.startswith(start)), frozenset())
    if name.startswith("CC-BY"):
        both = {k.lower(): w.lower() for k, w in _CC_WORDS.items()}
        own = {x.lower() for x in name.split("-")}
        words_ = _LIMITS - own - {both[x] for x in own if x in both}
    return words_ - keys


def anchors() -> str:
    """A pattern that every text with a licence matches: of the words that a template asks for the longest."""
    longest = {max(keys, key=lambda k: (k.isalpha(), len(k), k)) for _, _, keys in _templates()}
    return "(?i)(?<![a-z])(" + "|".join(sorted(re.escape(w.lstrip("=")) for w in longest)) + ")(?![a-z])"


def template_vectors() -> tuple[dict[str, float], float, list[tuple[str, int, dict[str, float]]]]:
    """(idf by word, idf of other words, [(licence, template, unit vector)])."""
    counts = [Counter(words(text)) for _, text, _ in _templates()]
    df = Counter(word for c in counts for word in c)
    idf = {w: math.log((1 + len(counts)) / (1 + n)) + 1 for w, n in df.items()}
    vectors = []
    for i, ((name, _, _), c) in enumerate(zip(_templates(), counts, strict=True)):
        weights = {w: n * idf[w] for w, n in c.items()}
        norm = math.sqrt(sum(x * x for x in weights.values()))
        vectors.append((name, i, {w: x / norm for w, x in weights.items()}))
    return idf, math.log(1 + len(counts)) + 1, vectors


def known_templates() -> tuple[dict[str, float], float, list[tuple[str, int, frozenset[str], frozenset[str], dict[str, float]]]]:
    """(idf by word, idf of other words, [(licence, words, words a span must and must not have, unit vector)])."""
    idf, other, vectors = template_vectors()
    return idf, other, [(name, len(words(text)), keys, barred(name, keys), v) for (name, text, keys), (_, _, v) in zip(_templates(), vectors, strict=True)]


class _Spans:
    """The words of one text, and the TF-IDF norms of its spans."""

    def __init__(self, found: list[str], idf: dict[str, float], other: float) -> None:
        self.names = {w: i for i, w in enumerate(dict.fromkeys(found))}
        self.ids = np.array([self.names[w] for w in found], dtype=np.int64)
        self.idf = np.array([idf.get(w, other) for w in self.names])[self.ids]
        order = np.argsort(self.ids, kind="stable")
        self.keys = self.ids[order] * (len(found) + 1) + order  # sorted by word, then position
        self.made: dict[int, np.ndarray] = {}

    def _count(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """How often the word of each position stands in [low, high)."""
        base = self.ids * (len(self.ids) + 1)
        return np.searchsorted(self.keys, base + high) - np.searchsorted(self.keys, base + low)

    def norms(self, n: int) -> np.ndarray:
        """The norm of every span of n words."""
        if n not in self.made:
            at, size, square = np.arange(len(self.ids)), len(self.ids), self.idf * self.idf
            put = square * (2 * self._count(np.maximum(at - n + 1, 0), at) + 1)
            taken = square * (2 * self._count(at + 1, np.minimum(at + n, size)) + 1)
            sums = np.cumsum(put)
            sums[n:] -= np.cumsum(taken)[: size - n]
            self.made[n] = np.sqrt(np.maximum(sums[n - 1 :], 1e-12))
        return self.made[n]

    def best(self, length: int, keys: frozenset[str], without: frozenset[str], vector: dict[str, float]) -> float:
        """The largest cosine of a span that has keys, and nothing of without, with the template."""
        if any(k not in self.names for k in keys):
            return 0.0
        size, top = len(self.ids), 0.0
        weights = np.array([vector.get(w, 0.0) for w in self.names])[self.ids] * self.idf
        sums = np.concatenate([[0.0], np.cumsum(weights)])
        has = [np.concatenate([[0], np.cumsum(self.ids == self.names[k])]) for k in keys]
        bad = [self.names[k] for k in without if k in self.names]
        spoilt = np.concatenate([[0], np.cumsum(np.isin(self.ids, bad))]) if bad else None
        for n in {min(size, max(len(keys), math.ceil(share * length))) for share in SPANS}:
            cosine = (sums[n:] - sums[:-n]) / self.norms(n)
            for h in has:
                cosine = np.where(h[n:] > h[:-n], cosine, 0.0)
            if spoilt is not None:
                cosine = np.where(spoilt[n:] > spoilt[:-n], 0.0, cosine)
            top = max(top, float(cosine.max()))
        return top


def licence_of(text: str, known) -> tuple[str | None, float | None]:
    """(licence, cosine) of the best span of a text; nulls if none reaches its least cosine."""
    idf, other, templates = known
    found = words(text)
    if not found:
        return None, None
    spans, best = _Spans(found, idf, other), None
    for name, length, keys, without, vector in templates:
        score = round(min(1.0, spans.best(length, keys, without, vector)), 6)
        if score >= (LEAST_LONG if length > LONG else LEAST):
            best = min(best or (0.0, 0, ""), (-score, -length, name))
    return (best[2], -best[0]) if best else (None, None)


def own_licences(files: DataFrame) -> DataFrame:
    """(_fid, own_license, own_score) of the files with a licence of their own; files: _fid, _path, _text."""
    shared = files.sparkSession.sparkContext.broadcast(known_templates())

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            made = [licence_of(text.as_py(), shared.value) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())], ["_fid", "own_license", "own_score"]
            )

    speaking = files.filter(F.col("_text").rlike(anchors())).select("_fid", "_text")
    return in_arrow(speaking, run, "_fid string, own_license string, own_score double").filter("own_license IS NOT NULL").dropDuplicates(["_fid"])


def scan(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """id, path, own_license, own_score, license, inherited_from (a directory, null if the licence is the file's own)."""
    source = files.select(F.col(id_col).alias("_id"), F.col(path_col).cast("string").alias("_path"), text_of(text_col).alias("_text"))
    # the file's key in between; equal rows share it, and so their result
    source = source.withColumn("_fid", F.sha2(F.concat_ws("\x00", F.col("_id").cast("string"), F.coalesce("_path", F.lit("\x01")), F.sha2(F.encode("_text", "UTF-8"), 256)), 256))
    own = durable(own_licences(source), "licences")
    rows = durable(source.select("_fid", "_id", "_path").join(own, "_fid", "left"), "licence-files")
    directory = F.when(F.col("_path").contains("/"), F.regexp_replace("_path", "/[^/]*$", "")).when(F.col("_path").isNotNull(), F.lit(""))
    speaks = rows.filter(F.col("own_license").isNotNull() & F.col("_path").rlike(LICENCE_FILE))
    given = durable(
        speaks.groupBy(directory.alias("_dir")).agg(F.min(F.struct("_path", F.col("own_license").alias("l"))).alias("g")).select("_dir", F.col("g.l").alias("_given")), "licence-dirs"
    )
    parts = F.split(directory, "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    climbing = rows.filter("own_license IS NULL AND _path IS NOT NULL").select("_fid", F.explode(F.array_distinct(above)).alias("_dir"))
    nearest = climbing.join(given, "_dir").groupBy("_fid").agg(F.max(F.struct(F.length("_dir").alias("n"), "_dir", "_given")).alias("m"))
    out = rows.join(nearest.select("_fid", F.col("m._dir").alias("inherited_from"), F.col("m._given").alias("_given")), "_fid", "left")
    return out.select(F.col("_id").alias(id_col), F.col("_path").alias(path_col), "own_license", "own_score", F.coalesce("own_license", "_given").alias("license"), "inherited_from")


def document_paths(docs: DataFrame, folder: int = 64) -> DataFrame:
    """doc_id, path, text: a tree over the documents table, which has no paths.

    A document lies in source/lang/(doc_id div folder); one whose first line speaks of a
    licence is named as a licence file, of that folder, or of source/lang if its doc_id is
    the folder's first.
    """
    first = F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)
    base = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")))
    inner = F.concat_ws("/", base, F.expr(f"cast(doc_id div {folder} as string)"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    is_licence = first.rlike(MENTION)
    path = F.when(is_licence & (F.col("doc_id") % folder == 0), F.concat(base, F.lit("/LICENSE-"), name)).when(is_licence, F.concat(inner, F.lit("/LICENSE-"), name))
    return docs.select("doc_id", path.otherwise(F.concat(inner, F.lit("/"), name, F.lit(".txt"))).alias("path"), "text")
