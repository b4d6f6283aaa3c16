"""Hard-negative mining with score bounds from spanning trees of anchors.

Anchors are dealt to groups of about ``GROUP`` near each other, and each group gets
a minimum spanning tree.  A candidate's score at a child anchor lies within its
score at the parent plus or minus edge length times the candidate's norm
(Cauchy-Schwarz).  A group walks its tree over a block of candidates: the root
scores all of them, a child rescores only those whose interval meets a window it
still wants; the others pass their interval on, wider by the edge.

Two rounds over all (group, block) cells: the first wants the best scores of the
anchor's label, the second the best scores of other labels inside the window of
each positive.  What a group has found so far narrows its windows in later blocks.
Cells are joined by stripes of groups and blocks, so no task sees more than one
stripe of each, and nothing but counts and at most ``PIVOTS`` anchors reach the driver.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, stored

GROUP = 1024  # anchors of one spanning tree, about
BLOCK = 4096  # candidates of one block, about
STRIPE = 64  # most groups or blocks that one task joins
PIVOTS = 256  # anchors that others are dealt to, at most
EXACT = 2.0**53  # below it sums of products of integers are exact in doubles
LONG = 2**63 - 1
ROUNDING = 1 + 1e-9

CELL = "dim long, ids binary, ties binary, labels binary, vectors binary"
FOUND = "a long, a_tie long, grp long, p long, p_tie long, p_score long, x long, x_tie long, score long"


# --------------------------------------------------------------------------
# packing rows to blocks and groups
# --------------------------------------------------------------------------
def quantised(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as doubles, which hold all such integers."""
    with np.errstate(over="ignore"):
        big = np.finfo(np.float64).max
        return np.clip(np.floor(scale * values), -big, big)


def spanning_tree(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parent, edge length) of a minimum spanning tree, parent -1 at the root.

    The root is the vector nearest to the mean.
    """
    n = len(v)
    parent, edge = np.full(n, -1), np.zeros(n)
    with np.errstate(over="ignore", invalid="ignore"):
        square = (v * v).sum(1)
        far = lambda i: np.nan_to_num(square + square[i] - 2 * (v @ v[i]), nan=np.inf)
        root = int(np.argmin(np.nan_to_num(((v - v.mean(0)) ** 2).sum(1), nan=np.inf)))
        near, best = np.full(n, root), far(root)
        left = np.ones(n, bool)
        left[root] = False
        for _ in range(n - 1):
            at = int(np.flatnonzero(left)[np.argmin(best[left])])
            parent[at], left[at] = near[at], False
            edge[at] = np.nan_to_num(np.linalg.norm(v[at] - v[near[at]]), nan=np.inf, posinf=np.inf) * ROUNDING
            closer = (d := far(at)) < best
            near[closer], best[closer] = at, d[closer]
    return parent, edge


def _pack(scale: float, tree: bool):
    """Rows of one block or group to one packed row for each vector length."""

    def run(key, table):
        v = table.column("v").combine_chunks()
        off = np.asarray(v.offsets, np.int64)
        flat = quantised(np.asarray(v.values, np.float64), scale)
        size = np.diff(off)
        i, tie, label = (np.asarray(table.column(c), np.int64) for c in ("i", "tie", "label"))
        out = []
        for dim in np.unique(size).tolist():
            own = np.flatnonzero(size == dim)
            own = own[np.lexsort((tie[own], i[own]))]
            x = flat[off[own][:, None] + np.arange(dim)]
            row = [key[0].as_py(), dim, *(np.ascontiguousarray(a[own]).tobytes() for a in (i, tie, label)), x.tobytes()]
            if tree:
                parent, edge = spanning_tree(x)
                row += [parent.astype(np.int64).tobytes(), edge.tobytes()]
            out.append(row)
        kinds = [pa.int64(), pa.int64(), *[pa.binary()] * (len(out[0]) - 2)]
        names = ["place", "dim", "ids", "ties", "labels", "vectors", *(["parent", "edge"] if tree else [])]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return run


def _nearest(pivots: list[list[float]]):
    """Number of the nearest pivot of the same length, -1 if there is none."""

    def run(batches):
        by_dim: dict[int, tuple[list[int], list]] = {}
        for n, p in enumerate(pivots):
            by_dim.setdefault(len(p), ([], []))
            by_dim[len(p)][0].append(n)
            by_dim[len(p)][1].append(p)
        for batch in batches:
            col = batch.column("v")
            off, flat = np.asarray(col.offsets, np.int64), np.asarray(col.values, np.float64)
            found = np.full(batch.num_rows, -1, np.int64)
            for dim, (names, points) in by_dim.items():
                own = np.flatnonzero(np.diff(off) == dim)
                if len(own) and dim:
                    p = np.array(points)
                    with np.errstate(over="ignore", invalid="ignore"):
                        near = flat[off[own][:, None] + np.arange(dim)] @ p.T - (p * p).sum(1) / 2
                    found[own] = np.array(names)[np.argmax(np.nan_to_num(near), 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("i", "tie", "label", "v")] + [pa.array(found)],
                ["i", "tie", "label", "v", "pivot"],
            )

    return run


def anchor_groups(anchors: DataFrame, count: int, scale: float) -> tuple[DataFrame, int]:
    """Packed groups of anchors with their trees, and the number of groups.

    Anchors go to the nearest of some pivots drawn by hash; a pivot with more than
    ``GROUP`` anchors is split by hash, so equal anchors make no large group.
    """
    wanted = min(PIVOTS, -(-count // GROUP))
    points = [r["v"] for r in anchors.orderBy(F.xxhash64("tie"), "i").limit(wanted).collect()] if wanted > 1 else []
    dealt = stored(anchors.mapInArrow(_nearest(points), "i long, tie long, label long, v array<double>, pivot long"))
    sizes = {r["pivot"]: r["count"] for r in dealt.groupBy("pivot").count().collect()}  # at most PIVOTS + 1 rows
    base, parts, total = [], [], 0
    for p in range(-1, len(points)):
        parts.append(max(1, -(-sizes.get(p, 0) // GROUP)))
        base.append(total)
        total += parts[-1]
    at = F.col("pivot").cast("int") + 1
    table = lambda x: F.array(*[F.lit(n).cast("long") for n in x])
    grp = F.get(table(base), at) + F.pmod("tie", F.get(table(parts), at))
    packed = dealt.withColumn("grp", grp).groupBy("grp").applyInArrow(
        _pack(scale, tree=True), f"place long, {CELL}, parent binary, edge binary"
    )
    return stored(packed.withColumnRenamed("place", "grp")), total


# --------------------------------------------------------------------------
# walking a group's tree over a block
# --------------------------------------------------------------------------
class Side:
    """Arrays of a packed block or group."""

    def __init__(self, dim: int, ids: bytes, ties: bytes, labels: bytes, vectors: bytes):
        self.ids, self.ties, self.labels = (np.frombuffer(b, np.int64) for b in (ids, ties, labels))
        self.v = np.frombuffer(vectors, np.float64).reshape(len(self.ids), dim)
        with np.errstate(over="ignore"):
            self.norm = np.sqrt((self.v * self.v).sum(1)) * ROUNDING


class Tree(Side):
    """A group of anchors: the tree's walk, and what each anchor has found so far."""

    def __init__(self, *packed, parent: bytes, edge: bytes):
        super().__init__(*packed)
        self.edge = np.frombuffer(edge, np.float64)
        up = np.frombuffer(parent, np.int64)
        self.root = int(np.flatnonzero(up < 0)[0])
        self.children: list[list[int]] = [[] for _ in up]
        for a, p in enumerate(up.tolist()):
            if p >= 0:
                self.children[p].append(a)
        order, weight = [self.root], np.ones(len(up), np.int64)
        for a in order:
            order += self.children[a]
        for a in reversed(order[1:]):
            weight[up[a]] += weight[a]
        for c in self.children:  # the heaviest is popped last: few intervals are held at a time
            c.sort(key=lambda a: -weight[a])
        self.most = float(self.norm.max())


def products(x: np.ndarray, a: np.ndarray, wide: np.ndarray | None) -> np.ndarray:
    """Exact integer inner products as longs; those outside of the range take its end."""
    with np.errstate(over="ignore", invalid="ignore"):
        s = x @ a
        if wide is None or not wide.any():
            return s.astype(np.int64)
        out = np.where(wide, 0, np.nan_to_num(s)).astype(np.int64)
    other = [int(c) for c in a]
    for k in np.flatnonzero(wide).tolist():
        out[k] = max(-LONG, min(LONG, sum(int(c) * d for c, d in zip(x[k], other, strict=True))))
    return out


def sweep(tree: Tree, block: Side, wants, take) -> int:
    """Walk the tree over a block; number of scores computed.

    ``wants(a, low, high)`` marks candidates whose interval at anchor ``a`` matters,
    ``take(a, rows, scores)`` gets the exact scores of these.
    """
    wide = block.norm * tree.most >= EXACT
    wide = wide if wide.any() else None
    n, scored = len(block.ids), 0
    stack: list[tuple] = [(tree.root, np.full(n, -np.inf), np.full(n, np.inf))]
    while stack:
        a, low, high = stack.pop()
        reach = tree.edge[a] * block.norm + 1 if tree.edge[a] else 0.0
        low, high = low - reach, high + reach
        if wide is not None:  # sums of these are not exact in doubles: always scored
            low[wide], high[wide] = -np.inf, np.inf
        at = np.flatnonzero(wants(a, low, high))
        if 2 * len(at) > n or a == tree.root:  # one product over all is cheaper than a copy of most
            s = products(block.v, tree.v[a], wide)
            low = high = s.astype(np.float64)
            scored += n
            s = s[at]
        else:
            s = products(block.v[at], tree.v[a], None if wide is None else wide[at])
            low[at] = high[at] = s
            scored += len(at)
        if len(at):
            take(a, at, s)
        stack += [(c, low, high) for c in tree.children[a]]
    return scored


class Best:
    """The first ``k`` candidates by score, then id; ``floor`` is what the next one must reach."""

    __slots__ = ("floor", "k", "rows")

    def __init__(self, k: int, floor: int = -LONG):
        self.k, self.floor, self.rows = k, floor, []

    def add(self, block: Side, at: np.ndarray, s: np.ndarray) -> None:
        if len(s) > self.k:
            near = s >= np.partition(s, len(s) - self.k)[len(s) - self.k]
            at, s = at[near], s[near]
            first = np.lexsort((block.ties[at], block.ids[at], -s))[: self.k]
            at, s = at[first], s[first]
        new = zip(s.tolist(), block.ids[at].tolist(), block.ties[at].tolist(), strict=True)
        self.rows = sorted([*self.rows, *((-score, i, t) for score, i, t in new)])[: self.k]
        if len(self.rows) == self.k:
            self.floor = max(self.floor, -self.rows[-1][0])


class Positives:
    """First round: the best other rows of the anchor's label."""

    def __init__(self, tree: Tree, row: dict, rules: dict):
        self.best = [Best(rules["positives"]) for _ in tree.ids]

    def run(self, tree: Tree, block: Side) -> int:
        def wants(a, low, high):
            same = block.labels == tree.labels[a]
            same &= (block.ids != tree.ids[a]) | (block.ties != tree.ties[a])
            return same & (high >= self.best[a].floor)

        return sweep(tree, block, wants, lambda a, at, s: self.best[a].add(block, at, s))

    def found(self):
        for a, best in enumerate(self.best):
            yield a, (None, None, None), best.rows


class Negatives:
    """Second round: the best rows of other labels in the window of each positive."""

    def __init__(self, tree: Tree, row: dict, rules: dict):
        self.windows: list[list] = [[] for _ in tree.ids]
        names = {k: a for a, k in enumerate(zip(tree.ids.tolist(), tree.ties.tolist(), strict=True))}
        for p in row["positives"] or ():
            low, high = -(-rules["low"] * p["score"] // 100), rules["high"] * p["score"] // 100
            at = names.get((p["a"], p["a_tie"]))  # a group's other vector lengths are rows of their own
            if low <= high and at is not None:
                who = p["x"], p["x_tie"], p["score"]
                self.windows[at].append((who, high, Best(rules["negatives"], low)))

    def run(self, tree: Tree, block: Side) -> int:
        def wants(a, low, high):
            some = np.zeros(len(block.ids), bool)
            for _, top, best in self.windows[a]:
                some |= (high >= best.floor) & (low <= top)
            return some & (block.labels != tree.labels[a])

        def take(a, at, s):
            for _, top, best in self.windows[a]:
                own = (s >= best.floor) & (s <= top)
                if own.any():
                    best.add(block, at[own], s[own])

        return sweep(tree, block, wants, take)

    def found(self):
        for a, own in enumerate(self.windows):
            for who, _, best in own:
                yield a, who, best.rows


def _cells(kind, rules: dict):
    """Joined (block, group) cells to what the groups have found, stripe by stripe."""

    def emit(trees):
        cols: list[list] = [[] for _ in range(9)]
        for (grp, _), (tree, state) in trees.items():
            for a, who, rows in state.found():
                for score, i, t in rows:
                    line = (int(tree.ids[a]), int(tree.ties[a]), grp, *who, i, t, -score)
                    for col, value in zip(cols, line, strict=True):
                        col.append(value)
        names = [c.split()[0] for c in FOUND.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

    def run(batches):
        stripe, trees = None, {}
        blocks: OrderedDict = OrderedDict()
        for batch in batches:
            for at in range(batch.num_rows):
                row = {c: batch.column(c)[at].as_py() for c in ("stripe", "deal", "grp", "dim", "blk")}
                if (row["stripe"], row["deal"]) != stripe:
                    if trees:
                        yield emit(trees)
                    stripe, trees = (row["stripe"], row["deal"]), {}
                key = row["grp"], row["dim"]
                one = lambda c: batch.column(c)[at].as_py()  # noqa: B023, E731
                if key not in trees:
                    tree = Tree(
                        row["dim"], one("g_ids"), one("g_ties"), one("g_labels"), one("g_vectors"),
                        parent=one("parent"), edge=one("edge"),
                    )
                    names = batch.schema.names
                    row["positives"] = one("positives") if "positives" in names else None
                    trees[key] = tree, kind(tree, row, rules)
                if (row["blk"], row["dim"]) not in blocks:
                    blocks.clear()  # blocks come one after another
                    blocks[row["blk"], row["dim"]] = Side(row["dim"], one("ids"), one("ties"), one("labels"), one("vectors"))
                tree, state = trees[key]
                state.run(tree, blocks[row["blk"], row["dim"]])
        if trees:
            yield emit(trees)

    return run


def _cell_join(blocks: DataFrame, groups: DataFrame, n_blocks: int, n_groups: int) -> DataFrame:
    """Each block beside each group of its vector length, dealt by stripes.

    A block is sent once for each stripe of groups, a group once for each stripe of
    blocks.  Stripes are narrower while the table has few blocks.  Both sides are
    dealt by key: their estimated sizes leave the copies out, so a broadcast could grow.
    """
    at_once = blocks.sparkSession.sparkContext.defaultParallelism
    wide = max(1, min(STRIPE, n_blocks // (4 * at_once)))
    stripes, deals = -(-n_blocks // wide), -(-n_groups // STRIPE)
    left = blocks.withColumn("stripe", F.floor(F.col("blk") / wide)).withColumn(
        "deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1)).cast("array<long>"))
    )
    right = groups.withColumn("deal", F.floor(F.col("grp") / STRIPE)).withColumn(
        "stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1)).cast("array<long>"))
    )
    for c in ("ids", "ties", "labels", "vectors"):
        right = right.withColumnRenamed(c, f"g_{c}")
    return left.join(right.hint("merge"), ["stripe", "deal", "dim"])


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "x", "x_tie")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame,
    anchor: Column,
    id_col: str = "vec_id",
    label_col: str = "label",
    vec_col: str = "embedding",
    scale: float = 256.0,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components count as floor(scale * x), scores are integer inner products; the
    higher score comes first, ties by smaller id.  ``anchor`` is a condition that marks
    anchors (null: none).  An anchor's positives are its first ``positives`` other rows of the same
    label.  For each of them the first ``negatives`` rows of other labels come back
    whose score is ``low`` to ``high`` percent of the positive's.

    Rows with a null id, label or vector, or with a null or non-finite component,
    take no part.  Rows that equal each other in id, label and vector count once;
    other rows with equal ids are rows of their own, ordered by a hash after the id.
    Vectors meet only vectors of their own length.  Scores outside of the range of
    long take its end.  An anchor without positives, or a positive whose window is
    empty (a negative score, or no row in it), has no row; an empty table gives none.
    Only the three named columns are read, so further columns may have any name.
    """
    prepare(vectors.sparkSession)
    src = vectors.select(
        vectors[id_col].cast("long").alias("i"),
        vectors[label_col].cast("long").alias("label"),
        vectors[vec_col].cast("array<double>").alias("v"),
        F.coalesce(anchor, F.lit(False)).alias("is_anchor"),
    )
    usable = (
        "i is not null and label is not null and v is not null"
        " and not exists(v, x -> x is null or isnan(x) or abs(x) = double('inf'))"
    )
    rows = stored(src.where(usable).dropDuplicates().withColumn("tie", F.xxhash64("i", "label", "v")))
    n, n_anchors = rows.agg(F.count("*"), F.count_if("is_anchor")).first()
    groups, n_groups = anchor_groups(rows.where("is_anchor").drop("is_anchor"), n_anchors, scale)
    n_blocks = max(1, -(-n // BLOCK))
    blocks = rows.withColumn("blk", F.pmod("tie", F.lit(n_blocks))).groupBy("blk")
    blocks = stored(blocks.applyInArrow(_pack(scale, tree=False), f"place long, {CELL}").withColumnRenamed("place", "blk"))
    rules = {"positives": positives, "negatives": negatives, "low": low, "high": high}

    cells = _cell_join(blocks, groups, n_blocks, n_groups)
    near = stored(_first(cells.mapInArrow(_cells(Positives, rules), FOUND), ["a", "a_tie"], positives))
    # At most GROUP anchors with ``positives`` rows each.
    own = near.groupBy("grp").agg(F.collect_list(F.struct("a", "a_tie", "x", "x_tie", "score")).alias("positives"))
    cells = _cell_join(blocks, groups.join(own, "grp"), n_blocks, n_groups)
    hard = _first(cells.mapInArrow(_cells(Negatives, rules), FOUND), ["a", "a_tie", "p", "p_tie"], negatives)
    return hard.select(
        F.col("a").alias("anchor_id"), F.col("p").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        F.col("x").alias("negative_id"), F.col("p_score").alias("positive_score"), F.col("score").alias("negative_score"),
    )


# --------------------------------------------------------------------------
# plain versions, for tests
# --------------------------------------------------------------------------
def brute_force(rows: list[tuple], anchor) -> list[tuple]:
    """The same from (id, label, vector) in plain Python; ``anchor(id)`` marks anchors."""
    import math

    ok = [
        (i, int(c), tuple(math.floor(256 * x) for x in v))
        for i, c, v in rows
        if None not in (i, c, v) and all(x is not None and math.isfinite(x) for x in v)
    ]
    ok = sorted(set(ok))
    out = []
    for a in ok:
        if not anchor(a[0]):
            continue
        score = [
            (-sum(p * q for p, q in zip(a[2], b[2], strict=True)), b[0], b[1], b)
            for b in ok if len(b[2]) == len(a[2]) and b != a
        ]
        score.sort(key=lambda s: s[:2])
        for ps, pid, *_ in [s for s in score if s[2] == a[1]][:5]:
            window = [s for s in score if s[2] != a[1] and 50 * -ps <= 100 * -s[0] <= 95 * -ps]
            out += [(a[0], pid, r + 1, s[1], -ps, -s[0]) for r, s in enumerate(window[:3])]
    return out


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
    CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
  other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) <= 3
"""
