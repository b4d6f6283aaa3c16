"""License scans: an exact set-similarity join of text blocks with license templates.

A template with at most L words (L a power of two) meets blocks of 2 L words that
begin at every L-th word of a text, so any L + 1 consecutive words lie within one
block.  A block matches if it holds at least ``SHARE`` of the template's distinct
words.  All such pairs are found:

* words are ordered by their count over all documents, rare ones first;
* prefix filter: with ``least`` common words needed, a pair must share one of the
  first ``size - least + 1`` words of the template and of the block;
* length filter: the block must hold ``least`` of the templates' words at all;
* positional filter: the words shared so far plus those that can follow on either
  side must reach ``least``;
* the pairs left are counted exactly.

Words that no template has are in no intersection, so a block's set leaves them out.
Base phrases are told apart: places where their words stand consecutively.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PIECE_BYTES, column_bytes, pieces, prepare, words
from .decontam import IS_WORD, Lookup

SHARE = Fraction(9, 10)
SMALLEST = 8  # words; blocks are twice as long at least

# Phrases of the base labels.
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}

# Notices by which licenses are named in files, and grants of short licenses.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
        except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
        permissions and limitations under the License.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: Redistributions of source code must retain the above
        copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form
        must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution.""",
    "cc-by-4.0-line": """This work is licensed under a Creative Commons Attribution 4.0 International License.""",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc0-1.0": """To the extent possible under law, the author has dedicated all copyright and related and
        neighboring rights to this work to the public domain worldwide.""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or
        (at your option) any later version.""",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without
        fee is hereby granted, provided that the above copyright notice and this permission notice appear in all
        copies.""",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
        copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice shall be included in all
        copies or substantial portions of the Software.""",
    "mit-line": "Released under the MIT License.",
    "mpl-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of
        the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy,
        modify, publish, use, compile, sell, or distribute this software, either in source code form or as a
        compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
}


def cut(text: str | None) -> list[str]:
    """Words of a text, A-Z lower-cased."""
    import re

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def block_words(n: int) -> int:
    """L of a template with ``n`` words."""
    return max(SMALLEST, 1 << (n - 1).bit_length())


def least_common(size: int, share: Fraction) -> int:
    """Common words that a template of ``size`` distinct words needs."""
    return max(1, -(-size * share.numerator // share.denominator))


# --------------------------------------------------------------------------
# words of whole texts
# --------------------------------------------------------------------------
def segments(data: np.ndarray, offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator:
    """(first row, bytes, offsets) of stretches of about ``limit`` bytes that split no word.

    A stretch may begin or end within a text; its offsets are cut to its bytes.
    """
    at, end = 0, int(offsets[-1]) if len(offsets) else 0
    while at < end:
        to = min(end, at + limit)
        while to < end and IS_WORD[data[to]] and IS_WORD[data[to - 1]]:
            step = np.flatnonzero(~IS_WORD[data[to : to + limit]])
            to = to + int(step[0]) if len(step) else min(end, to + limit)
        first = int(np.searchsorted(offsets, at, "right")) - 1
        last = int(np.searchsorted(offsets, to, "left"))
        yield first, data[at:to], np.clip(offsets[first : last + 1], at, to) - at
        at = to


def known_words(piece: pa.RecordBatch, look: Lookup):
    """(row, place, word) of the words that ``look`` knows, and all words of each row."""
    data, off = column_bytes(piece.column("t"))
    total = np.zeros(piece.num_rows, np.int64)
    found: list[tuple] = []
    for first_row, part, cuts in segments(data, off):
        h, row, first = words(part, cuts, IS_WORD)
        own = look.find(h)
        at = np.flatnonzero(own >= 0)
        r = row[at] + first_row
        found.append((r, at - first[row[at]] + total[r], own[at]))
        total[first_row : first_row + len(cuts) - 1] += np.diff(first)
    cols = [np.concatenate([np.zeros(0, np.int64), *c]) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
    return *cols, total


def word_hashes(listed: list[str]) -> np.ndarray:
    col = pa.array(listed, pa.string())
    return words(*column_bytes(col), IS_WORD)[0]


# --------------------------------------------------------------------------
# templates of one block length
# --------------------------------------------------------------------------
class Class:
    """Templates whose blocks have the same length, over ranks of words (0: the rarest)."""

    def __init__(self, half: int, templates: list[tuple[str, np.ndarray]], n_ranks: int, share: Fraction):
        self.half, self.labels = half, [name for name, _ in templates]
        sets = [np.unique(r) for _, r in templates]  # ascending ranks: the global order
        self.size = np.array([len(s) for s in sets])
        self.least = np.array([least_common(len(s), share) for s in sets])
        self.holds = np.zeros((len(sets), n_ranks), bool)
        entries = []
        for t, s in enumerate(sets):
            self.holds[t, s] = True
            entries += [(int(r), t, j) for j, r in enumerate(s[: len(s) - self.least[t] + 1])]
        entries.sort()
        rank = np.array([e[0] for e in entries], np.int64)
        self.start = np.searchsorted(rank, np.arange(n_ranks + 1))
        self.template, self.place = (np.array([e[k] for e in entries], np.int64) for k in (1, 2))
        self.used = self.holds.any(0)
        self.prefix = np.diff(self.start) > 0

    def match(self, row: np.ndarray, at: np.ndarray, rank: np.ndarray, total: np.ndarray):
        """(row, template, first word, common words) of all pairs that reach ``least``."""
        none = [np.zeros(0, np.int64)] * 4
        base = np.concatenate([[0], np.cumsum(total // self.half + 1)])  # dense block numbers
        own = np.flatnonzero(self.used[rank])
        row, at, rank = row[own], at[own], rank[own]
        late = at >= self.half  # also in the block before
        block = base[row] + at // self.half
        block, rank = np.concatenate([block, block[late] - 1]), np.concatenate([rank, rank[late]])
        touched = np.zeros(int(base[-1]) + 1, bool)
        touched[block[self.prefix[rank]]] = True
        keep = touched[block]
        if not keep.any():
            return none
        n = len(self.used)
        pair = np.unique(block[keep] * n + rank[keep])  # by block, then rank
        block, rank = pair // n, pair % n
        first = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        size = np.diff(np.append(first, len(block)))
        which = np.repeat(np.arange(len(first)), size)
        place = np.arange(len(block)) - first[which]
        # Words in prefixes of templates, with their places on both sides.
        count = self.start[rank + 1] - self.start[rank]
        entry = np.repeat(self.start[rank] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        x = np.repeat(np.arange(len(rank)), count)
        t, j, i, length = self.template[entry], self.place[entry], place[x], size[which[x]]
        least = self.least[t]
        ok = (length >= least) & (i <= length - least)
        x, t, j, i, length, least = (a[ok] for a in (x, t, j, i, length, least))
        if not len(x):
            return none
        order = np.argsort(which[x] * len(self.size) + t, kind="stable")  # ranks stay in order
        x, t, j, i, length, least = (a[order] for a in (x, t, j, i, length, least))
        key = which[x] * len(self.size) + t
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        before = np.arange(len(key)) - np.repeat(head, np.diff(np.append(head, len(key))))
        bound = before + 1 + np.minimum(length - i - 1, self.size[t] - j - 1)
        alive = np.minimum.reduceat(bound - least, head) >= 0
        g, t = which[x[head[alive]]], t[head[alive]]
        if not len(g):
            return none
        spread = np.repeat(np.arange(len(g)), size[g])
        ends = np.cumsum(size[g])
        inside = np.arange(len(spread)) - np.repeat(ends - size[g], size[g])
        common = np.add.reduceat(self.holds[t[spread], rank[first[g[spread]] + inside]].astype(np.int64), ends - size[g])
        good = common >= self.least[t]
        g, t, common = g[good], t[good], common[good]
        dense = block[first[g]]
        r = np.searchsorted(base, dense, "right") - 1
        return r, t, (dense - base[r]) * self.half, common


class Scanner:
    """Templates and base phrases over one vocabulary."""

    def __init__(self, templates: dict[str, str], phrases: dict[str, str], share: Fraction):
        self.templates, self.share = {k: cut(v) for k, v in templates.items()}, share
        self.phrases = {k: cut(v) for k, v in phrases.items()}
        listed = [*self.templates.values(), *self.phrases.values()]
        if not all(listed):
            raise ValueError("a template or phrase without a word")
        self.vocabulary = sorted({w for ws in listed for w in ws})
        hashes = word_hashes(self.vocabulary)
        self.look = Lookup(hashes)
        self.number = dict(zip(self.vocabulary, self.look.find(hashes).tolist(), strict=True))
        if len(self.look.keys) != len(self.vocabulary):
            raise ValueError("two template words with one hash")
        self.classes: list[Class] = []

    def order(self, counts: dict[int, int]) -> None:
        """Fix the global order of words by their counts over all documents."""
        n = len(self.vocabulary)
        by = sorted(range(n), key=lambda k: (counts.get(k, 0), k))
        self.rank = np.zeros(n, np.int64)
        self.rank[by] = np.arange(n)
        halves: dict[int, list] = {}
        for name, ws in self.templates.items():
            own = self.rank[[self.number[w] for w in ws]]
            halves.setdefault(block_words(len(ws)), []).append((name, own))
        self.classes = [Class(h, ts, n, self.share) for h, ts in sorted(halves.items())]

    def places(self, row: np.ndarray, at: np.ndarray, word: np.ndarray):
        """(row, first word, end, label) of every place of a base phrase."""
        for label, ws in self.phrases.items():
            m = len(word) - len(ws) + 1
            if m <= 0:
                continue
            ok = np.ones(m, bool)
            for k, w in enumerate(ws):
                ok &= (word[k : k + m] == self.number[w]) & (row[k : k + m] == row[:m]) & (at[k : k + m] == at[:m] + k)
            for s in np.flatnonzero(ok).tolist():
                yield int(row[s]), int(at[s]), int(at[s]) + len(ws), label


def _counts(scanner: Scanner):
    def run(batches):
        seen = np.zeros(len(scanner.vocabulary), np.int64)
        for batch in batches:
            for piece in pieces(batch, "t"):
                seen += np.bincount(known_words(piece, scanner.look)[2], minlength=len(seen))
        own = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(seen[own])], ["word", "n"])

    return run


PLACE = pa.struct([("first", pa.int64()), ("end", pa.int64()), ("label", pa.string())])
MATCH = pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("share", pa.float64())])


def _scan(shared):
    def run(batches):
        scanner = shared.value
        for batch in batches:
            for piece in pieces(batch, "t"):
                row, at, word, total = known_words(piece, scanner.look)
                places: list[list] = [[] for _ in range(piece.num_rows)]
                for r, first, end, label in scanner.places(row, at, word):
                    places[r].append({"first": first, "end": end, "label": label})
                blocks: list[list] = [[] for _ in range(piece.num_rows)]
                for c in scanner.classes:
                    hits = c.match(row, at, scanner.rank[word], total)
                    for r, t, first, common in zip(*(a.tolist() for a in hits), strict=True):
                        end = min(first + 2 * c.half, int(total[r]))
                        share = common / int(c.size[t])
                        blocks[r].append({"label": c.labels[t], "first": first, "end": end, "share": share})
                yield pa.RecordBatch.from_arrays(
                    [piece.column("i"), pa.array(total), pa.array(places, pa.list_(PLACE)), pa.array(blocks, pa.list_(MATCH))],
                    ["i", "n_words", "places", "blocks"],
                )

    return run


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: dict[str, str] | None = None,
    phrases: dict[str, str] | None = None,
    share: Fraction = SHARE,
) -> DataFrame:
    """(doc_id, n_words, places, blocks): base phrases and matching blocks of each whole text.

    ``places`` lists (first, end, label) for every place of a base phrase, ``blocks``
    (label, first, end, share) for every block of words [first, end) that holds at
    least ``share`` of the template's distinct words.  One row per input row: repeated
    rows stay, a null id stays null.  Null and empty texts and texts without words have
    0 words and empty lists; an empty table gives none.  Only the two named columns
    are read.  A text of any length is taken in stretches of half a MiB.

    The templates are an argument and go to the tasks whole; of the documents only one
    count for each template word reaches the driver.
    """
    prepare(docs.sparkSession)
    scanner = Scanner(TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases, share)
    src = docs.select(docs[id_col].alias("i"), docs[text_col].alias("t"))
    counts = src.select("t").mapInArrow(_counts(scanner), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    scanner.order({r["word"]: r["n"] for r in counts.collect()})
    shared = docs.sparkSession.sparkContext.broadcast(scanner)
    kind = src.schema["i"].dataType.simpleString()
    schema = (
        f"i {kind}, n_words long, places array<struct<first:long,end:long,label:string>>, "
        "blocks array<struct<label:string,first:long,end:long,share:double>>"
    )
    return src.mapInArrow(_scan(shared), schema).withColumnRenamed("i", "doc_id")


def digest(scanned: DataFrame) -> DataFrame:
    """One row per document; ``score`` is the largest share of a template in one block, 1 with a base phrase."""
    base = F.array_distinct(F.col("places.label"))
    listed = lambda x: F.array_join(F.array_sort(x), ",")
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.first").alias("first_word"),
        F.array_max("places.first").alias("last_word"),
        listed(base).alias("base_labels"),
        listed(F.array_union(base, F.col("blocks.label"))).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max("blocks.share"), F.lit(0.0))).alias("score"),
    )


# --------------------------------------------------------------------------
# plain versions
# --------------------------------------------------------------------------
def brute_force(docs: list[tuple], templates=TEMPLATES, phrases=PHRASES, share=SHARE) -> list[tuple]:
    """Rows of ``digest`` in plain Python."""
    out = []
    for name, text in docs:
        ws = cut(text)
        places = [
            (i, label) for label, p in phrases.items() for i in range(len(ws)) if ws[i : i + len(cut(p))] == cut(p)
        ]
        best, labels = 0.0, {label for _, label in places}
        for label, template in templates.items():
            own, half = set(cut(template)), block_words(len(cut(template)))
            for at in range(0, len(ws), half):
                common = len(own & set(ws[at : at + 2 * half]))
                if Fraction(common, len(own)) >= share:
                    labels.add(label)
                    best = max(best, common / len(own))
        spots = [i for i, _ in places]
        out.append((
            name, len(ws), len(places), min(spots, default=None), max(spots, default=None),
            ",".join(sorted({label for _, label in places})), ",".join(sorted(labels)), 1.0 if places else best,
        ))
    return out


def oracle() -> str:
    """DuckDB SQL for the digest; the templates' words are listed in it."""
    values = []
    for label, text in TEMPLATES.items():
        ws = cut(text)
        own = sorted(set(ws))
        values += [f"('{label}', {block_words(len(ws))}, {len(own)}, {least_common(len(own), SHARE)}, '{w}')" for w in own]
    starts = [
        f"list_transform(list_filter(range(1, len(w) + 1), lambda i: {' AND '.join(f'w[i + {k}] = {word!r}' for k, word in enumerate(cut(p)))}),"
        f" lambda i: {{'first': i - 1, 'label': '{label}'}})"
        for label, p in PHRASES.items()
    ]
    joined = "[]"
    for s in starts:
        joined = f"list_concat({joined}, {s})"
    return f"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t(label, half, size, least, word) AS (VALUES {", ".join(values)}),
p AS (SELECT rid, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d),
m AS (
  SELECT DISTINCT rid, label, size, least, pos // half - back AS block, word
  FROM p JOIN t USING (word), (VALUES (0), (1)) AS o(back) WHERE pos // half - back >= 0),
f AS (SELECT rid, label, count(*) / size AS share FROM m GROUP BY rid, label, size, least, block HAVING count(*) >= least),
b AS (SELECT doc_id, rid, len(w) AS n_words, {joined} AS places FROM d),
l AS (
  SELECT rid, unnest(list_transform(places, lambda x: x.label)) AS label, true AS base, 1.0 AS share FROM b
  UNION ALL SELECT rid, label, false, share FROM f),
g AS (
  SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM l GROUP BY rid)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base,
  CAST(list_min(list_transform(places, lambda x: x.first)) AS BIGINT) AS first_word,
  CAST(list_max(list_transform(places, lambda x: x.first)) AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM b LEFT JOIN g USING (rid)
"""


ORACLE = oracle()
