"""Shared helpers: scratch tables, Arrow text access, word hashing, components."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
PIECE_BYTES = 1 << 19  # text handled by one round of array operations
BATCH_BYTES = 8 << 20
TASK_EDGES = 500_000  # links that one task contracts


# --------------------------------------------------------------------------
# tables in the shared folder
# --------------------------------------------------------------------------
def scratch_dir(spark: SparkSession) -> str:
    """A new path in the shared folder that ``spark.checkpoint.dir`` names.

    Only a single-process session (``local[...]``, as in tests) may run without
    the setting; it then gets a private folder.  On a cluster the setting is
    required, because executors share no other place.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="riskloom-llm-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/riskloom-{uuid.uuid4().hex}"


def stored(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and
    fixes its rows, so a lost executor costs a re-read, not a recomputation."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    schema = df.schema
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(schema).parquet(path)


def prepare(spark: SparkSession) -> None:
    """Settings that the operators' tasks need, for a session started elsewhere.

    Python workers must find this package.  Arrow batches hold at most
    ``BATCH_BYTES``, so long texts take no more memory than many short ones.
    """
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, [known])])
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --------------------------------------------------------------------------
# Arrow text columns as byte arrays
# --------------------------------------------------------------------------
def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text or binary column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, col.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, text: str, limit: int = PIECE_BYTES):
    """Slices of whole rows whose text adds up to about ``limit`` bytes each."""
    n = batch.num_rows
    if n == 0:
        return
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0)
    ends = np.cumsum(np.asarray(size, dtype=np.int64))
    at = 0
    while at < n:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def binary_rows(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Binary column whose i-th value holds the next ``counts[i]`` items of ``data``."""
    data = np.ascontiguousarray(data)
    off = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts * data.itemsize, out=off[1:])
    if off[-1] >= 1 << 31:
        raise ValueError("more than 2 GiB in one Arrow batch of binary values")
    return pa.BinaryArray.from_buffers(
        pa.binary(), len(counts), [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(data)]
    )


# --------------------------------------------------------------------------
# 64-bit hashing on arrays
# --------------------------------------------------------------------------
def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser over uint64 arrays: a bijection that spreads all bits."""
    with np.errstate(over="ignore"):
        x = np.array(x, dtype=U64, copy=True)
        x ^= x >> U64(30)
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


def seeded(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random uint64 values."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U64) + U64(seed << 32)) * U64(0x9E3779B97F4A7C15))


BYTE_CODES = seeded(256, 1)
STEP = U64(0xD6E8FEB86659FD93)  # odd, so that its powers are invertible


def powers(n: int, base: np.uint64 = STEP) -> np.ndarray:
    out = np.full(max(n, 1), base, U64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
    """Hashes, row numbers and row bounds of the words of some texts.

    ``is_word`` tells for each byte value whether it belongs to a word.  A-Z
    count as lower case; no word crosses a text.  Returns ``(hash, row, first)``
    where ``first[i]:first[i + 1]`` are the words of text ``i``.
    """
    rows = len(offsets) - 1
    mask = is_word[data]
    begins = mask.copy()
    begins[1:] &= ~mask[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    begins[inner] = mask[inner]
    used = np.flatnonzero(mask)
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(rows + 1, np.int64)
    first_used = np.searchsorted(used, starts)
    lens = np.diff(np.append(first_used, len(used)))
    within = np.arange(len(used)) - np.repeat(first_used, lens)
    with np.errstate(over="ignore"):
        part = BYTE_CODES[LOWER[data[used]]] * powers(int(lens.max()))[within]
        hashes = mix(np.add.reduceat(part, first_used) + lens.astype(U64) * BYTE_CODES[0])
    row = np.searchsorted(offsets, starts, "right") - 1
    first = np.searchsorted(starts, offsets)
    return hashes, row, first


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive items."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    step = powers(n, U64(0xA0761D6478BD642F))
    with np.errstate(over="ignore"):
        out = np.full(m, BYTE_CODES[n % 256], U64)
        for j in range(n):
            out += hashes[j : j + m] * step[j]
    return mix(out)


# --------------------------------------------------------------------------
# connected components
# --------------------------------------------------------------------------
def forest_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (x, smallest x reachable) of the graph with links a-b."""
    nodes, ix = np.unique(np.concatenate([a, b]), return_inverse=True)
    ia, ib = ix[: len(a)], ix[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[ia], label[ib])
        new = label.copy()
        np.minimum.at(new, label[ia], low)
        np.minimum.at(new, label[ib], low)
        while True:  # pointer jumping
            nxt = new[new]
            if np.array_equal(nxt, new):
                break
            new = nxt
        if np.array_equal(new, label):
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def _contract(batches):
    """Spanning forest of a partition's links."""
    cols = [(np.asarray(x.column(0)), np.asarray(x.column(1))) for x in batches]
    none = np.zeros(0, np.int64)
    a, b = forest_of(np.concatenate([none, *(x for x, _ in cols)]), np.concatenate([none, *(y for _, y in cols)]))
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a long, b long) to (node, component = smallest node reachable).

    Links are dealt to tasks of about ``TASK_EDGES`` each, which contract them to
    spanning forests.  While there are several, each round applies the two star steps (each node links its larger, then its smaller neighbours
    to the smallest one).  Stars are joined, not collected, so a node with very
    many links is split by the skew join.  Rounds end when the set of edges
    stays the same.  Nodes without links do not appear.
    """
    schema = "a long, b long"
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    e = e.where("a is not null and b is not null and a != b")
    e = stored(e)
    parts = max(1, -(-e.count() // TASK_EDGES))
    e = stored(e.repartition(parts).mapInArrow(_contract, schema))
    seen = None
    while parts > 1:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            e.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(low, "u")
            .where("v > u and v != m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        large = stored(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        e = stored(small.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())
        state = e.agg(
            F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))
        ).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
