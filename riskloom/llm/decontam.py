"""Benchmark decontamination by winnowing.

Of every ``SPAN - GRAM + 1`` consecutive 5-word grams of a text the smallest hash
is kept (the last one of equals), so a span of 10 words that a document shares
with a benchmark item always leaves a fingerprint at the same place in both.
Document fingerprints are joined to those of the items; around each hit all
10-word windows are compared, which extends it to the full shared span.  Items of
fewer than 10 words are one window each, looked up at every position.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, column_bytes, pieces, runs, stored, words

SPAN, GRAM = 10, 5
INDEX_BYTES = 32 << 20  # benchmark text indexed and sent to the tasks at once
IS_WORD = np.array([b >= 0x80 or chr(b).isdigit() or "a" <= chr(b).lower() <= "z" for b in range(256)])


def fingerprints(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Positions of the selected grams; windows that span two texts are left out."""
    g = runs(hashes, GRAM)
    m = len(hashes) - SPAN + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    best, at = g[:m].copy(), np.arange(m)
    for j in range(1, SPAN - GRAM + 1):
        lower = g[j : j + m] <= best
        best[lower] = g[j : j + m][lower]
        at[lower] = np.flatnonzero(lower) + j
    return np.unique(at[row[:m] == row[SPAN - 1 :]])


class Lookup:
    """Sorted hashes with a bitmap in front: most misses cost one byte read."""

    def __init__(self, hashes: np.ndarray):
        self.keys = np.unique(hashes)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.keys >> U64(44)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash among the keys, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        maybe = np.flatnonzero(self.bits[(hashes >> U64(44)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.keys, hashes[maybe]), len(self.keys) - 1)
            hit = self.keys[at] == hashes[maybe]
            out[maybe[hit]] = at[hit]
        return out


class Index:
    """Fingerprints, windows and items of some benchmark texts."""

    def __init__(self, items: list[tuple[str | None, str | None]]):
        self.names = [n for n, _ in items]
        col = pa.array([t for _, t in items], pa.string())
        h, row, first = words(*column_bytes(col), IS_WORD)
        size = np.diff(first)
        spots = fingerprints(h, row)
        self.prints = Lookup(runs(h, GRAM)[spots])
        self.windows: dict[int, tuple[Lookup, np.ndarray, np.ndarray]] = {}
        for n in range(1, SPAN + 1):
            m = len(h) - n + 1
            if m <= 0:
                continue
            start = np.arange(m)
            own = row[:m] == row[n - 1 :]
            own &= (size[row[:m]] >= SPAN) if n == SPAN else (size[row[:m]] == n)
            start = start[own]
            if not len(start):
                continue
            look = Lookup(runs(h, n)[start])
            pair = np.unique(np.stack([look.find(runs(h, n)[start]), row[start]], 1), axis=0)
            self.windows[n] = look, np.searchsorted(pair[:, 0], np.arange(len(look.keys) + 1)), pair[:, 1]

    def hits(self, h: np.ndarray, row: np.ndarray):
        """(start, length, key) of every window of an item that occurs in some texts."""
        for n, (look, _, _) in self.windows.items():
            if len(h) < n:
                continue
            if n == SPAN:
                spots = fingerprints(h, row)
                spots = spots[self.prints.find(runs(h, GRAM)[spots]) >= 0]
                # All windows around a hit: they start up to SPAN - GRAM words before it.
                start = np.unique((spots[:, None] - np.arange(SPAN - GRAM + 1)).reshape(-1))
                start = start[(start >= 0) & (start <= len(h) - n)]
                start = start[row[start] == row[start + n - 1]]
                block = h[start[:, None] + np.arange(n)].reshape(-1)
                found = look.find(runs(block, n)[::n]) if len(start) else np.zeros(0, np.int64)
            else:
                start = np.flatnonzero(row[: len(h) - n + 1] == row[n - 1 :])
                found = look.find(runs(h, n)[start])
            yield n, start[found >= 0], found[found >= 0]


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int):
    """The benchmark in blocks of at most ``limit`` bytes of text (or one longer item)."""
    rows = benchmark.select(
        benchmark[id_col].cast("string").alias("k"), benchmark[text_col].alias("t")
    ).where("t is not null")
    block: list = []
    size = 0
    for r in rows.toLocalIterator():
        more = len(r["t"].encode())
        if block and size + more > limit:
            yield block
            block, size = [], 0
        block.append((r["k"], r["t"]))
        size += more
    yield block


def annotate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    limit: int = INDEX_BYTES,
) -> DataFrame:
    """(doc_id, n_words, spans, items): what each whole text shares with the benchmark.

    ``spans`` are the maximal runs of hit words as [first, end) word numbers,
    ``items`` the distinct ids of the items with an occurring window, in string
    order.  One row per input row.  Null or empty texts have no words and no
    hits; null item texts are no items; a null item id counts for hits but is
    not listed.  Only the named columns are read.

    The benchmark's index goes to the tasks whole if its text is at most
    ``limit`` bytes; a larger benchmark is taken block by block, each one joined
    to all documents, with the result of a block stored before the next.
    """
    src = docs.select(docs[id_col].alias("i"), docs[text_col].alias("t"))
    kind = src.schema["i"].dataType.simpleString()
    schema = f"i {kind}, t string, n_words long, spans array<struct<first:long,end:long>>, items array<string>"
    out = src.selectExpr(
        "i", "t", "0L as n_words", "cast(array() as array<struct<first:long,end:long>>) as spans",
        "cast(array() as array<string>) as items",
    )
    blocks = item_blocks(benchmark, item_col, item_text, limit)
    block = next(blocks)
    while block is not None:
        after = next(blocks, None)
        shared = docs.sparkSession.sparkContext.broadcast(Index(block))
        out = out.mapInArrow(_scan(shared, last=after is None), schema)
        if after is not None:
            out = stored(out)
        block = after
    return out.selectExpr("i as doc_id", "n_words", "spans", "items")


def _scan(shared, last: bool):
    def run(batches):
        index = shared.value
        for batch in batches:
            for piece in pieces(batch, "t"):
                data, off = column_bytes(piece.column("t"))
                h, row, first = words(data, off, IS_WORD)
                mark = np.zeros(len(h) + 1, np.int64)
                pairs = []
                for n, start, key in index.hits(h, row):
                    np.add.at(mark, start, 1)
                    np.add.at(mark, start + n, -1)
                    _, at, item = index.windows[n]
                    for r, k in set(zip(row[start].tolist(), key.tolist(), strict=True)):
                        pairs.append((r, item[at[k] : at[k + 1]]))
                items = [set(x) for x in piece.column("items").to_pylist()]
                for r, own in pairs:
                    items[r].update(index.names[j] for j in own.tolist())
                hit = np.cumsum(mark)[:-1] > 0
                for r, old in enumerate(piece.column("spans").to_pylist()):
                    for s in old:
                        hit[first[r] + s["first"] : first[r] + s["end"]] = True
                edge = np.append(True, row[1:] != row[:-1]) if len(row) else np.zeros(0, bool)
                begin = np.flatnonzero(hit & (edge | ~np.append(False, hit[:-1])))
                stop = np.flatnonzero(hit & np.append(edge[1:] | ~hit[1:], True)) + 1 if len(hit) else begin
                spans: list[list] = [[] for _ in range(piece.num_rows)]
                for a, b in zip(begin.tolist(), stop.tolist(), strict=True):
                    r = int(row[a])
                    spans[r].append({"first": a - int(first[r]), "end": b - int(first[r])})
                span_type = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("i"),
                        pa.nulls(piece.num_rows, pa.string()) if last else piece.column("t"),
                        pa.array(np.diff(first)),
                        pa.array(spans, span_type),
                        pa.array([sorted(x - {None}) for x in items], pa.list_(pa.string())),
                    ],
                    ["i", "t", "n_words", "spans", "items"],
                )

    return run


def digest(annotated: DataFrame) -> DataFrame:
    return annotated.select(
        "doc_id",
        "n_words",
        F.expr("aggregate(spans, 0L, (s, x) -> s + x.end - x.first)").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


# --------------------------------------------------------------------------
# brute force, for tests
# --------------------------------------------------------------------------
def brute_force(docs: list[tuple], items: list[tuple]) -> list[tuple]:
    import re

    def cut(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    wins: dict[tuple, set] = {}
    for name, text in items:
        w = cut(text)
        n = min(len(w), SPAN)
        for i in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[i : i + n]), set()).add(name)
    sizes = {len(k) for k in wins}
    out = []
    for name, text in docs:
        w = cut(text)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                own = wins.get(tuple(w[i : i + n]))
                if own:
                    hit.update(range(i, i + n))
                    found |= own
        listed = ",".join(sorted(str(x) for x in found if x is not None))
        n_items = sum(x is not None for x in found)
        out.append((name, len(w), len(hit), n_items, hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    return out


ORACLE = """
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT rid, i, n, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT dw.rid, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (n, s)),
pos AS (
  SELECT rid, count(DISTINCT p) AS n_hit
  FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, i, n FROM hit)) GROUP BY rid),
its AS (
  SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS l
  FROM (SELECT DISTINCT rid, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(l, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""
