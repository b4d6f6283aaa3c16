"""Near-duplicate embeddings by a forest of random-projection trees.

Each tree splits the unit sphere again and again along random directions; a
vector near a split goes to both sides (spill).  Vectors are compared with those
of their leaves only, in double precision; links of all trees are united.

Trees are fitted on a bounded sample of vectors (``SAMPLE_ROWS`` rows of at most
``SAMPLE_BYTES`` bytes, those whose hashes are lowest); every vector is indexed.  A split is
placed where few vectors spill; where most would, as inside a dense ball of copies,
the node stays a leaf.  A leaf with more than ``CELL`` vectors is cut into blocks
and all pairs of blocks become cells, so none of its pairs is skipped and no task
holds more than two blocks.  Equal vectors are compared once, with their number.

A pair may meet in several leaves; it counts in the first leaf that both share.
So pairs are never listed: a cell returns link counts and a spanning forest.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, forest_of, stored

COSINE = 0.95
TREES = 8
LEAF = 600  # vectors that a leaf should hold
CELL = 1_500
SAMPLE_ROWS = 1 << 16
SAMPLE_BYTES = 32 << 20
SPILL = 0.6  # spill margin in standard deviations of a linked pair's difference
LEAST_SAMPLE = 8  # sampled vectors that a leaf must hold
ROWS_AT_ONCE = 512


class Forest:
    """Split planes of some trees over vectors of one length."""

    def __init__(self, sample: np.ndarray, total: int, trees: int = TREES, cosine: float = COSINE, seed: int = 5):
        rng = np.random.default_rng(seed)
        dim = sample.shape[1]
        # A pair at the threshold is sqrt(2 - 2 cos) apart; along one direction that is / sqrt(dim).
        self.margin = SPILL * np.sqrt(max(2 - 2 * cosine, 1e-12) / dim)
        share = total / max(len(sample), 1)
        self.planes: list[np.ndarray] = []
        self.cuts: list[float] = []
        self.child: list[tuple[int, int]] = []  # node number, or -1 - leaf number
        self.leaves = 0
        self.roots = [self._grow(sample, np.arange(len(sample)), share, rng) for _ in range(trees)]

    def _grow(self, sample, own, share, rng) -> int:
        best = None
        if len(own) * share > LEAF and len(own) >= 2 * LEAST_SAMPLE:
            for _ in range(3):
                plane = rng.normal(size=sample.shape[1])
                plane /= np.linalg.norm(plane)
                p = np.sort(sample[own] @ plane)
                cuts = np.quantile(p, np.linspace(0.3, 0.7, 9))
                spilled = np.searchsorted(p, cuts + self.margin, "right") - np.searchsorted(p, cuts - self.margin)
                at = int(np.argmin(spilled + 0.2 * np.abs(np.arange(9) - 4) / 4 * len(own) / 10))
                if best is None or spilled[at] < best[0]:
                    best = spilled[at], plane, cuts[at]
        if best is None or best[0] > 0.5 * len(own):
            self.leaves += 1
            return -self.leaves
        _, plane, cut = best
        node = len(self.planes)
        self.planes.append(plane)
        self.cuts.append(float(cut))
        self.child.append((0, 0))
        p = sample[own] @ plane
        # Children are fitted on what they will be given, spilled vectors included.
        left = self._grow(sample, own[p <= cut + self.margin], share, rng)
        right = self._grow(sample, own[p > cut - self.margin], share, rng)
        self.child[node] = (left, right)
        return node

    def leaves_of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that a vector belongs to, by row and leaf."""
        rows, leaves = [], []
        stack = [(r, np.arange(len(x))) for r in self.roots]
        while stack:
            node, own = stack.pop()
            if not len(own):
                continue
            if node < 0:
                rows.append(own)
                leaves.append(np.full(len(own), -1 - node))
                continue
            p = x[own] @ self.planes[node]
            cut, (left, right) = self.cuts[node], self.child[node]
            stack.append((left, own[p <= cut + self.margin]))
            stack.append((right, own[p > cut - self.margin]))
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        r, f = np.concatenate(rows), np.concatenate(leaves)
        order = np.lexsort((f, r))
        return r[order], f[order]


def unit(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _valid(vectors: DataFrame, id_col: str, vec_col: str, kind: str) -> DataFrame:
    """(vec_id, k, dim, v) of the vectors that can link; k is a hash of the vector."""
    src = vectors.select(vectors[id_col].alias("vec_id"), vectors[vec_col].alias("v"))
    id_type = src.schema["vec_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, keys, dims, raw = [], [], [], []
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("v").to_pylist(), strict=True):
                if not v or None in v:
                    continue
                x = np.array(v, kind) + np.zeros(1, kind)  # -0.0 becomes 0.0
                length = np.linalg.norm(x.astype(np.float64))
                if not np.isfinite(x).all() or not np.isfinite(length) or length == 0:
                    continue
                b = x.tobytes()
                ids.append(i)
                keys.append(int.from_bytes(hashlib.blake2b(b, digest_size=8).digest(), "little", signed=True))
                dims.append(len(v))
                raw.append(b)
            cols = [(ids, batch.column("vec_id").type), (keys, pa.int64()), (dims, pa.int32()), (raw, pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in cols], ["vec_id", "k", "dim", "v"])

    return src.mapInArrow(run, f"vec_id {id_type}, k long, dim int, v binary")


def _routed(classes: DataFrame, forests: dict[int, tuple[Forest, int]], kind: str) -> DataFrame:
    """(leaf, k, m, v, leaves): each vector once for every leaf it belongs to."""
    shared = classes.sparkSession.sparkContext.broadcast(forests)

    def run(batches):
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for dim in np.unique(dims).tolist():
                own = batch.filter(pa.array(dims == dim))
                forest, base = shared.value[dim]
                x = unit(own.column("v").to_pylist(), kind)
                for at in range(0, len(x), 2_000):
                    part = own.slice(at, 2_000)
                    row, leaf = forest.leaves_of(x[at : at + 2_000])
                    leaf = leaf + base
                    first = np.searchsorted(row, np.arange(part.num_rows + 1))
                    lists = [leaf[a:b].astype("<i4").tobytes() for a, b in zip(first, first[1:], strict=False)]
                    pick = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(leaf, pa.int64()),
                            part.column("k").take(pick),
                            part.column("m").take(pick),
                            part.column("v").take(pick),
                            pa.array(lists, pa.binary()).take(pick),
                        ],
                        ["leaf", "k", "m", "v", "leaves"],
                    )

    return classes.select("k", "m", "dim", "v").mapInArrow(
        run, "leaf long, k long, m long, v binary, leaves binary"
    )


def _cell(kind: str, cosine: float):
    """Link counts and a spanning forest of one cell."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("k")
        k = np.asarray(table.column("k"))
        m = np.asarray(table.column("m"))
        block = np.asarray(table.column("block"))
        leaf, a, b = (table.column(c)[0].as_py() for c in ("leaf", "a", "b"))
        x = unit(table.column("v").to_pylist(), kind)
        lists = [np.frombuffer(v, "<i4") for v in table.column("leaves").to_pylist()]
        owner = np.repeat(np.arange(len(k)), [len(v) for v in lists])
        flat = np.concatenate(lists)
        before = flat < leaf
        ids, place = np.unique(flat[before], return_inverse=True)
        earlier = np.zeros((len(k), len(ids)), np.float32)
        earlier[owner[before], place] = 1
        left = np.flatnonzero(block == a)
        right = np.flatnonzero(block == b)
        count = np.zeros(len(k), np.int64)
        ea = eb = np.zeros(0, np.int64)
        for at in range(0, len(left), ROWS_AT_ONCE):
            own = left[at : at + ROWS_AT_ONCE]
            near = x[own] @ x[right].T >= cosine
            near &= k[own][:, None] != k[right]
            if not near.any():
                continue
            cols = near.any(0)
            if len(ids):
                near[:, cols] &= (earlier[own] @ earlier[right[cols]].T) == 0
            i, j = np.nonzero(near)
            count[own] += np.bincount(i, m[right][j], len(own)).astype(np.int64)
            if a != b:
                count[right] += np.bincount(j, m[own][i], len(right)).astype(np.int64)
            # Links that another leaf counts are links of this forest too, but need no second mention.
            ea, eb = forest_of(np.concatenate([ea, k[own][i]]), np.concatenate([eb, k[right][j]]))
        has = np.flatnonzero(count)
        return pa.table(
            [
                pa.array(np.concatenate([k[has], ea])),
                pa.array(np.concatenate([np.zeros(len(has), np.int64), eb])),
                pa.array(np.concatenate([count[has], np.zeros(len(ea), np.int64)])),
            ],
            names=["a", "b", "n"],
        )

    return run


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE, trees: int = TREES
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row.

    ``n_links`` counts the other vectors found with a cosine of at least ``cosine``,
    ``component_id`` is the smallest vec_id reachable by such links and ``kept``
    marks it.  Null, empty and zero vectors and those with null or non-finite
    components link with nothing; vectors of different lengths do not link.
    Equal vectors link without search.  A null vec_id keeps its row; it names a
    component only if nothing else does.
    """
    spark = vectors.sparkSession
    inner = vectors.schema[vec_col].dataType.elementType.simpleString()
    kind = "<f4" if inner == "float" else "<f8"
    own = stored(_valid(vectors, id_col, vec_col, kind))
    classes = stored(
        own.groupBy("k").agg(
            F.min("vec_id").alias("first"), F.count("*").alias("m"), F.min("v").alias("v"), F.min("dim").alias("dim")
        )
    )
    forests, base = {}, 0
    for row in sorted(classes.groupBy("dim").count().collect()):
        dim, total = row["dim"], row["count"]
        bound = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dim)))
        sample = classes.where(F.col("dim") == dim).orderBy(F.xxhash64("k"), "k").limit(bound).select("v").collect()
        forest = Forest(unit([bytes(r["v"]) for r in sample], kind), total, trees, cosine)
        forests[dim] = forest, base
        base += forest.leaves
    routed = stored(_routed(classes, forests, kind))
    sizes = routed.groupBy("leaf").agg(F.ceil(F.count("*") / CELL).cast("int").alias("g"))
    cells = (
        routed.join(sizes, "leaf")
        .withColumn("block", F.pmod(F.xxhash64("k"), F.col("g")).cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, g - 1)")))
        .withColumn("a", F.least("block", "other"))
        .withColumn("b", F.greatest("block", "other"))
        .drop("g", "other")
    )
    found = stored(cells.groupBy("leaf", "a", "b").applyInArrow(_cell(kind, cosine), "a long, b long, n long"))
    counts = found.where("n > 0").groupBy(F.col("a").alias("k")).agg(F.sum("n").alias("n"))
    comps = connected_components(found.where("n = 0").select("a", "b"))
    by_class = classes.select("k", "first", "m").join(counts, "k", "left").join(
        comps.withColumnRenamed("node", "k"), "k", "left"
    )
    by_class = by_class.withColumn("component", F.coalesce("component", "k"))
    lowest = by_class.groupBy("component").agg(F.min("first").alias("lowest"))
    by_class = by_class.join(lowest, "component").select(
        "k", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), "lowest"
    )
    linked = own.join(by_class, "k").select("vec_id", "n_links", F.coalesce("lowest", "vec_id").alias("component_id"))
    alone = _invalid(vectors, id_col, vec_col)
    out = linked.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _invalid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """The rows that ``_valid`` leaves out, by the same rule."""
    v = F.col("v").cast("array<double>")
    src = vectors.select(vectors[id_col].alias("vec_id"), vectors[vec_col].alias("v"))
    limit = F.lit(float("inf"))
    fine = F.coalesce(
        (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit)), F.lit(False)
    )
    # Squares are summed as the norm does, so that over- and underflow agree.
    square = F.aggregate(v, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)) * F.coalesce(x, F.lit(0.0)))
    ok = fine & F.coalesce((square > 0) & (square < limit), F.lit(False))
    return src.where(~ok).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))


def brute_force(rows: list[tuple], cosine: float = COSINE) -> dict:
    """For tests: vec_id to the set of vec_ids linked, by full comparison."""
    good = [(i, np.array(v, np.float64)) for i, v in rows if v and None not in v]
    good = [(i, v) for i, v in good if np.isfinite(v).all() and np.linalg.norm(v) > 0]
    out: dict = {}
    for dim in {len(v) for _, v in good}:
        ids = [i for i, v in good if len(v) == dim]
        x = np.stack([v / np.linalg.norm(v) for _, v in good if len(v) == dim])
        for at in range(0, len(x), 1_000):
            near = x[at : at + 1_000] @ x.T >= cosine
            for r in range(len(near)):
                out[ids[at + r]] = {ids[j] for j in np.flatnonzero(near[r]) if j != at + r}
    return out
