"""License scan: an exact set-similarity join between blocks of text and license templates.

A block is a run of tokens, a fifth longer than the template at most, wherever lines break. Tokens are ordered by their frequency
in the whole corpus, rarest first. A block that holds the share t of a template's n distinct tokens shares at least
a = ceil(t * n) of them: so it has at least a tokens (length filter), shares one of the template's n - a + 1 rarest (prefix
filter), and from its first token on has at least a places with tokens of the template (positional filter). Distinct tokens
are counted only in what passes. The prefix tokens of all templates are one index, which only the rare tokens of a text enter;
it is built from the templates, a parameter, and from one count a template token.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import chunks, code_points, lookup, spans, word_hashes

TOKEN = "[a-z0-9]+"
THRESHOLD, SLACK = 0.8, 1.2
PIECE = 2_000_000  # characters handled at once; texts are never cut

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies
or substantial portions of the Software."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF
ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the
License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for
any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"""

#: (license, its notice, or a sentence that names or grants it).
TEMPLATES = [
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("MIT", _MIT),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", _GPL),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("LGPL", "Licensed under the GNU Lesser General Public License"),
    ("MPL-2.0", _MPL),
    ("BSD", _BSD),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("ISC", _ISC),
    ("Unlicense", _UNLICENSE),
    ("Zlib", _ZLIB),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("all-rights-reserved", "All rights reserved. No part of this publication may be reproduced"),
    ("all-rights-reserved", "All rights reserved"),
]


def token_sets(templates: list[tuple[str, str]], threshold: float = THRESHOLD, slack: float = SLACK) -> list[tuple[int, str, list[str], int, int]]:
    """(number, license, distinct tokens, least overlap, most tokens of a block) of each template that has tokens."""
    out = []
    for k, (name, text) in enumerate(templates):
        tokens = re.findall(TOKEN, text.lower())
        own = sorted(set(tokens))
        if own:
            out.append((k, name, own, max(1, math.ceil(threshold * len(own) - 1e-9)), math.ceil(slack * len(tokens) - 1e-9)))
    return out


def _class() -> np.ndarray:
    lut = np.zeros(128, bool)
    lut[[*range(48, 58), *range(97, 123)]] = True
    return lut


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' tokens on end, and each one's text."""
    flat, n = code_points([t.lower() for t in texts])
    begin = np.cumsum(n) - n
    starts, ends = spans(lookup(flat, _class(), False), begin[n > 0]) if len(flat) else (np.empty(0, np.int64),) * 2
    return word_hashes(flat, starts, ends), np.searchsorted(begin + n, starts, "right")


def _hashes(words: list[str]) -> np.ndarray:
    return _tokens(words)[0]


def _numbers(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The place of each hash in the sorted array `known`, -1 for those that aren't there."""
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[at] == h, at, -1)


def token_counts(docs: DataFrame, vocabulary: list[str], text_col: str) -> dict[str, int]:
    """How often each word of the vocabulary, which is that of the templates, occurs in all texts."""
    known = np.sort(_hashes(vocabulary))
    words = {int(h): w for h, w in zip(_hashes(vocabulary), vocabulary)}

    def run(batches):
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if t]
            for i, j in chunks([len(t) for t in texts], PIECE):
                at = _numbers(_tokens(texts[i:j])[0], known)
                total += np.bincount(at[at >= 0], minlength=len(known))
        yield pa.RecordBatch.from_pydict({"k": np.arange(len(known)), "n": total})

    rows = docs.select(text_col).mapInArrow(run, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n"))
    return {words[int(known[r.k])]: r.n for r in rows.collect()}  # a row a template token


class Index:
    """Templates over a vocabulary that is sorted by hash: each one's tokens, and the tokens of which a block must have one."""

    def __init__(self, sets: list, counts: dict[str, int]):
        vocabulary = sorted({t for s in sets for t in s[2]})
        self.known = np.sort(_hashes(vocabulary))
        number = dict(zip(vocabulary, _numbers(_hashes(vocabulary), self.known).tolist()))
        self.sets, self.member, self.prefix = sets, [], []
        for _, _, tokens, least, _ in sets:
            ordered = sorted(tokens, key=lambda t: (counts.get(t, 0), t))
            for marks, own in ((self.member, tokens), (self.prefix, ordered[: len(tokens) - least + 1])):
                marks.append(np.zeros(len(vocabulary), bool))
                marks[-1][[number[t] for t in own]] = True
        self.rare = np.any(self.prefix, axis=0)

    def matches(self, texts: list[str]):
        """(text, number of the set, first token, overlap) of every passage of every text."""
        h, doc = _tokens(texts)
        at = np.flatnonzero(np.isin(h, self.known)) if len(h) else np.empty(0, np.int64)
        token, of = _numbers(h[at], self.known), doc[at]
        begin = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(texts)))))
        rare = self.rare[token]
        some = np.isin(of, of[rare])  # texts with no rare token have no block
        at, token, of = at[some], token[some], of[some]
        for s, (_, _, _, least, width) in enumerate(self.sets):
            own = self.member[s][token]
            p, t, d = at[own], token[own], of[own]
            seeds = p[self.prefix[s][t]]
            if len(seeds) == 0 or len(p) < least:
                continue
            # anchors: places of template tokens with a prefix token among the `width` tokens from there
            nearest = seeds[np.minimum(np.searchsorted(seeds, p), len(seeds) - 1)]
            last = np.minimum(p + width, begin[d + 1])
            ok = (nearest >= p) & (nearest < last)
            end = np.searchsorted(p, last)
            ok &= end - np.arange(len(p)) >= least
            open_text, open_at, best, start = -1, 0, 0, 0
            for i in np.flatnonzero(ok).tolist():
                overlap = len(set(t[i : end[i]].tolist()))
                if overlap < least:
                    continue
                if d[i] != open_text or p[i] - open_at >= width:
                    if open_text >= 0:
                        yield open_text, s, start, best
                    open_text, best, start = int(d[i]), 0, int(p[i] - begin[d[i]])
                open_at, best = p[i], max(best, overlap)
            if open_text >= 0:
                yield open_text, s, start, best


def scan_licenses(
    docs: DataFrame, *, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD, slack: float = SLACK,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, block, template, license, overlap, containment): every passage that contains at least `threshold` of a template's distinct tokens.

    Tokens are runs of ASCII letters and digits of the lower-cased text. A block is a run of at most `slack` times the template's
    tokens that begins with one of them; blocks that match and overlap are one passage. `block` is the number of its first token
    from 0, `overlap` the most distinct tokens that one of its blocks shares with the template.

    Defined cases: null and empty texts have no matches; repeated rows and rows with equal or null identifiers each give their
    matches; texts of any length are used whole; templates without tokens match nothing; extra columns are ignored; an empty
    table gives an empty result.
    """
    spark: SparkSession = docs.sparkSession
    sets = token_sets(TEMPLATES if templates is None else templates, threshold, slack)
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("block", T.IntegerType()), T.StructField("template", T.IntegerType()),
        T.StructField("license", T.StringType()), T.StructField("overlap", T.IntegerType()), T.StructField("containment", T.DoubleType()),
    ])
    if not sets:
        return spark.createDataFrame([], schema)
    counts = token_counts(docs, sorted({t for s in sets for t in s[2]}), text_col)
    index = Index(sets, counts)

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found: list[tuple] = []
            for i, j in chunks([len(t) for t in texts], PIECE):
                found += [(i + d, *x) for d, *x in index.matches(texts[i:j])]
            if found:
                row, s, block, overlap = (list(x) for x in zip(*found))
                number, names, sizes = ([sets[k][c] for k in s] for c in (0, 1, 2))
                columns = [batch.column(0).take(pa.array(row)), *(pa.array(x, pa.int32()) for x in (block, number)), pa.array(names), pa.array(overlap, pa.int32())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([o / len(x) for o, x in zip(overlap, sizes)])], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def oracle(templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> str:
    rows = ", ".join(f"({k}, '{name}', {tokens!r}, {least}, {width})" for k, name, tokens, least, width in token_sets(TEMPLATES if templates is None else templates, threshold))
    return rf"""
    WITH template AS (SELECT * FROM (VALUES {rows}) AS v(template, license, tokens, least, width)),
    pair AS (SELECT template, unnest(tokens) AS token, least, width FROM template),
    listed AS (SELECT doc_id, regexp_extract_all(lower(text), '{TOKEN}') AS own FROM documents),
    place AS (SELECT doc_id, unnest(own) AS token, unnest(range(len(own))) AS p FROM listed),
    hit AS (SELECT doc_id, template, p, token, least, width FROM place JOIN pair USING (token)),
    enough AS (SELECT doc_id, template FROM hit GROUP BY doc_id, template, least HAVING count(DISTINCT token) >= least),
    near AS (SELECT hit.* FROM hit SEMI JOIN enough USING (doc_id, template)),
    anchor AS (SELECT a.doc_id, a.template, a.p, a.width, count(DISTINCT b.token) AS overlap FROM near a JOIN near b ON a.doc_id = b.doc_id AND a.template = b.template
               AND b.p >= a.p AND b.p < a.p + a.width GROUP BY a.doc_id, a.template, a.p, a.width, a.least HAVING count(DISTINCT b.token) >= a.least),
    step AS (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id, template ORDER BY p) < width THEN 0 ELSE 1 END AS fresh FROM anchor),
    passage AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY p) AS number FROM step)
    SELECT doc_id, CAST(min(p) AS INTEGER) AS block, template, any_value(license) AS license, CAST(max(overlap) AS INTEGER) AS overlap,
           CAST(max(overlap) AS DOUBLE) / any_value(len(tokens)) AS containment
    FROM passage JOIN template USING (template) GROUP BY doc_id, template, number
    """
