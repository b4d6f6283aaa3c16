"""N-gram Jaccard self-join by a size-aware heavy-light split.

A document's set holds its distinct 5-word shingles (64-bit hashes); two
documents link when 100 * |A and B| >= 80 * |A or B|.

1. *Document frequencies.*  Each task packs the shingles of its texts by hash
   bucket, equal sets once; a bucket counts in how many different sets a shingle
   occurs.  A shingle of one set only cannot link anything, so from here on sets
   hold shared shingles alone, ordered from rare to common.  A document whose
   shared shingles are under 80 % of its set links with nothing.
2. *Candidates.*  Linked sets share a shingle among the first n - ceil(0.8 n) + 1
   of the rare-first order, and two among one more.  A *small* set enumerates all
   subsets of two of that longer prefix; equal subsets meet.  A *large* set scans
   the inverted lists of its prefix, in which small sets only wait.  The boundary
   between small and large is the set size at which the two costs, summed from the
   data's own sizes and list lengths, are least.
3. *Links.*  Lists of copies would give all pairs.  So each set is first compared
   with one partner of its lists (the one that leads most of them), links are
   contracted to components, and that repeats while it finds links; pairs are
   listed only between sets that are not yet connected, and tested exactly.

No pair is dropped: whatever the first rounds miss, the last one compares.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, binary_rows, column_bytes, connected_components, mix, pieces, runs, stored, words

SHINGLE = 5
PERCENT = 80
CHUNK_BYTES = 12 << 20  # text packed into one set of blobs
BUCKET_BYTES = 8 << 20  # text whose shingles one bucket holds
LEAST_BUCKETS = 64
COMMON = 32  # sets in a chunk from which a shingle counts as common without its list
PAIRS_AT_ONCE = 100_000
CELL = 1_000  # sets of one list compared in one place
COMMON_DF = np.iinfo(np.int32).max
IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False


# --------------------------------------------------------------------------
# sets
# --------------------------------------------------------------------------
def shingles(col: pa.Array):
    """(row, hash) of the distinct shingles of some texts, by row and hash."""
    data, off = column_bytes(col)
    h, row, first = words(data, off, IS_WORD)
    n = np.diff(first)
    m = max(len(h) - SHINGLE + 1, 0)
    full = np.flatnonzero(row[:m] == row[SHINGLE - 1 :]) if m else np.zeros(0, np.int64)
    all_h, all_row = [runs(h, SHINGLE)[full]], [row[full]]
    for k in range(1, SHINGLE):  # shorter texts: the whole sequence is the one shingle
        short = np.flatnonzero(n == k)
        if len(short):
            block = h[(first[short][:, None] + np.arange(k)).reshape(-1)]
            all_h.append(runs(block, k)[::k])
            all_row.append(short)
    hashes, rows = np.concatenate(all_h), np.concatenate(all_row)
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    if len(rows):
        keep = np.append(True, (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1]))
        hashes, rows = hashes[keep], rows[keep]
    return rows, hashes, len(n)


def set_keys(rows: np.ndarray, hashes: np.ndarray, n: int):
    """(key, size) of each text's set; the key depends on the set alone."""
    size = np.bincount(rows, minlength=n)
    total = np.zeros(n, U64)
    with np.errstate(over="ignore"):
        np.add.at(total, rows, mix(hashes ^ U64(0x5851F42D4C957F2D)))
        key = mix(total + size.astype(U64))
    return key.view(np.int64), size


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, key): a row for each document; key null for empty sets."""
    src = docs.select(docs[id_col].alias("i"), docs[text_col].alias("t"))
    kind = src.schema["i"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "t"):
                key, size = set_keys(*shingles(piece.column("t")))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("i"), pa.array(size, pa.int64()), pa.array(key, mask=size == 0)],
                    ["doc_id", "n_shingles", "key"],
                )

    return src.mapInArrow(run, f"doc_id {kind}, n_shingles long, key long")


# --------------------------------------------------------------------------
# document frequencies
# --------------------------------------------------------------------------
def planes(h: np.ndarray) -> bytes:
    """Sorted hashes, first bytes together and so on: the upper ones then compress."""
    return np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8).T.tobytes()


def unplaned(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(U64).reshape(-1)


BLOB = "bucket int, keys binary, sizes binary, hashes binary, owner binary"


def _blobs(buckets: int):
    """Shingles of a task's texts, packed by bucket.

    A blob holds the keys and sizes of its sets and, for each posting, a hash and
    the number of its set.  A shingle of more than ``COMMON`` sets of the chunk is
    common: its postings go to buckets chosen by set (sizes negative), which only
    pass them on, and the shingle's own bucket just learns that it is common
    (owner -1).  So no bucket holds a very common shingle's whole list.
    """

    def pack(held):
        keys = np.concatenate([k for k, *_ in held])
        sizes = np.concatenate([s for _, s, *_ in held])
        shift = np.cumsum([0, *(len(k) for k, *_ in held[:-1])])
        owner = np.concatenate([(o + d).astype(np.int32) for (_, _, o, _), d in zip(held, shift, strict=True)])
        hashes = np.concatenate([h for *_, h in held])
        held.clear()
        _, first = np.unique(keys, return_index=True)  # equal sets once
        mine = np.zeros(len(keys), bool)
        mine[first] = True
        use = mine[owner]
        owner, hashes = owner[use], hashes[use]
        order = np.argsort(hashes, kind="stable")
        owner, hashes = owner[order], hashes[order]
        at = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
        count = np.diff(np.append(at, len(hashes)))
        common = np.repeat(count > COMMON, count)
        spread = (keys[owner[common]].view(U64) % U64(buckets)).astype(np.int64)
        told = hashes[at[count > COMMON]]
        out = []
        for kind, b, h, o in (
            (0, (hashes[~common] % U64(buckets)).astype(np.int64), hashes[~common], owner[~common]),
            (1, spread, hashes[common], owner[common]),
            (2, (told % U64(buckets)).astype(np.int64), told, np.full(len(told), -1)),
        ):
            order = np.argsort(b, kind="stable")
            b, h, o = b[order], h[order], o[order]
            cut = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else []
            for x, y in zip(cut, np.append(cut[1:], len(b)).astype(int), strict=True) if len(b) else ():
                if kind == 2:
                    out.append((int(b[x]), b"", b"", planes(h[x:y]), b""))
                    continue
                who, local = np.unique(o[x:y], return_inverse=True)
                s = sizes[who].astype("<i4") * (-1 if kind == 1 else 1)
                small = np.uint16 if len(who) < 1 << 16 else np.uint32
                out.append((int(b[x]), keys[who].tobytes(), s.tobytes(), planes(h[x:y]), local.astype(small).tobytes()))
        cols = list(zip(*out, strict=True)) or [()] * 5
        types = [pa.int32(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["bucket", "keys", "sizes", "hashes", "owner"]
        )

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for piece in pieces(batch, "t"):
                rows, hashes, n = shingles(piece.column("t"))
                held.append((*set_keys(rows, hashes, n), rows, hashes))
                size += piece.nbytes
                if size > CHUNK_BYTES:
                    yield pack(held)
                    held, size = [], 0
        if held:
            yield pack(held)

    return run


SHARED = "key long, n int, hashes binary, dfs binary"


def _shared(table: pa.Table) -> pa.Table:
    """One bucket's shingles that occur in several sets, packed by set."""
    keys, sizes, hashes, told = [], [], [], []
    pass_on = []
    for k, s, h, o in zip(*(table.column(c).to_pylist() for c in ("keys", "sizes", "hashes", "owner")), strict=True):
        h = unplaned(h)
        if not k:
            told.append(h)
            continue
        k, s = np.frombuffer(k, np.int64), np.frombuffer(s, "<i4")
        o = np.frombuffer(o, np.uint16 if len(k) < 1 << 16 else np.uint32)
        if s[0] < 0:
            pass_on.append((k[o], -s[o], h))
        else:
            keys.append(k[o])
            sizes.append(s[o])
            hashes.append(h)

    def joined(parts, kind):
        return np.concatenate(parts) if parts else np.zeros(0, kind)

    k, s, h = joined(keys, np.int64), joined(sizes, np.int32), joined(hashes, U64)
    order = np.lexsort((k, h))
    k, s, h = k[order], s[order], h[order]
    if len(h):
        new = np.append(True, (h[1:] != h[:-1]) | (k[1:] != k[:-1]))
        k, s, h = k[new], s[new], h[new]
        at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        count = np.diff(np.append(at, len(h)))
        common = np.isin(h[at], joined(told, U64))
        df = np.repeat(np.where(common, COMMON_DF, count), count)
        use = df > 1
        k, s, h, df = k[use], s[use], h[use], df[use]
    else:
        df = np.zeros(0, np.int64)
    if pass_on:
        k = np.concatenate([k, *(x for x, _, _ in pass_on)])
        s = np.concatenate([s, *(x for _, x, _ in pass_on)])
        h = np.concatenate([h, *(x for *_, x in pass_on)])
        df = np.concatenate([df, np.full(len(h) - len(df), COMMON_DF)])
    order = np.lexsort((h, k))
    k, s, h, df = k[order], s[order], h[order], df[order]
    at = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    count = np.diff(np.append(at, len(k)))
    return pa.table(
        [
            pa.array(k[at]),
            pa.array(s[at].astype(np.int32)),
            binary_rows(h, count),
            binary_rows(df.astype(np.int32), count),
        ],
        names=["key", "n", "hashes", "dfs"],
    )


def least_overlap(n):
    """Shingles that a set of size ``n`` shares at least with any set it links to."""
    return -(-PERCENT * n // 100)


SKETCH = 8  # 64-bit words that sketch a prefix
BITS = [f"b{i}" for i in range(SKETCH)]
SETS = "key long, n int, members binary, prefix array<long>, " + ", ".join(f"{b} long" for b in BITS)


def _prefixes(batches):
    """Per set: its shared shingles sorted by hash, its rare-first prefix and a sketch
    of that: one bit for each of its shingles, by hash."""
    for batch in batches:
        out = []
        cols = (batch.column(c).to_pylist() for c in ("key", "n", "hashes", "dfs"))
        for key, n, hs, ds in zip(*cols, strict=True):
            h, df = np.frombuffer(b"".join(hs), U64), np.frombuffer(b"".join(ds), np.int32)
            h, first = np.unique(h, return_index=True)  # several chunks may pass on a common shingle
            df = df[first]
            need = least_overlap(n)
            if len(h) < need:
                continue
            # Shingles of this set alone stand first in the order; the rest is n - need + 2 less those.
            room = (n - need + (2 if need > 1 else 1)) - (n - len(h))
            rare = np.lexsort((h, df))[:room]
            bit = np.unique((h[rare] >> U64(40)) % U64(64 * SKETCH)).astype(np.int64)
            words64 = np.zeros(SKETCH, U64)
            np.bitwise_or.at(words64, bit >> 6, U64(1) << (bit & 63).astype(U64))
            out.append((key, n, h.tobytes(), h[rare].view(np.int64).tolist(), *words64.view(np.int64).tolist()))
        if out:
            types = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), *[pa.int64()] * SKETCH]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)],
                ["key", "n", "members", "prefix", *BITS],
            )


def linkable_sets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(key, n, members, prefix) of the sets that could link, once for equal sets."""
    src = docs.select(docs[text_col].alias("t"))
    total = src.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-total // BUCKET_BYTES))
    blobs = src.mapInArrow(_blobs(buckets), BLOB)
    shared = blobs.groupBy("bucket").applyInArrow(_shared, SHARED)
    whole = shared.groupBy("key").agg(
        F.max("n").alias("n"), F.collect_list("hashes").alias("hashes"), F.collect_list("dfs").alias("dfs"),
        F.sum(F.octet_length("hashes") / 8).alias("held"),
    )
    # Common shingles may be counted once for each chunk here; the exact test follows in _prefixes.
    whole = whole.where(F.col("held") * 100 >= F.col("n") * PERCENT)
    return stored(whole.select("key", "n", "hashes", "dfs").mapInArrow(_prefixes, SETS))


# --------------------------------------------------------------------------
# candidates
# --------------------------------------------------------------------------
def cost_table(sets: DataFrame) -> list[tuple[int, int, int]]:
    """(size class, cost as small sets, cost as large sets).

    A set with m shingles in its prefix and lists of l1, l2, ... costs m + l1 + l2 + ...
    as a large one.  As a small one it enumerates m (m - 1) / 2 subsets, and a set it
    meets c times on single shingles it meets c (c - 1) / 2 times on subsets; so its
    list entries count (m - 1) / 2 times.  Size classes: each size up to 64, then eighths of a
    doubling; so the table has a few hundred rows whatever the data.
    """
    cls = F.when(F.col("n") <= 64, F.col("n")).otherwise(F.floor(F.log2("n") * 8).cast("int") + 16)
    sets = sets.select("key", "n", "prefix", cls.alias("c"), F.size("prefix").cast("double").alias("m"))
    one = sets.select("key", "c", "n", "m", F.explode("prefix").alias("e"))
    lists = one.groupBy("e").agg(F.count("*").alias("l"))
    scan = one.join(lists, "e").groupBy("key", "c", "n", "m").agg(F.sum("l").alias("l"))
    m, n = F.col("m"), F.col("n")
    subsets = F.when(n > 1, m * (m - 1) / 2 + F.col("l") * (m - 1) / 2).otherwise(m + F.col("l"))
    rows = scan.groupBy("c").agg(F.max("n").alias("most"), F.sum(subsets).alias("a"), F.sum(m + F.col("l")).alias("b"))
    return sorted((r["most"], int(r["a"]), int(r["b"])) for r in rows.collect())


def boundary(costs: list[tuple[int, int, int]]) -> int:
    """Largest size that counts as small: the least sum of both costs."""
    best, at = None, 0
    for x in [0, *(n for n, *_ in costs)]:
        cost = sum(a if n <= x else b for n, a, b in costs)
        if best is None or cost < best:
            best, at = cost, x
    return at


def tokens(sets: DataFrame, small: int) -> DataFrame:
    """(tok, key, n, s, at, l, waits): what sets meet on.

    ``s`` counts a set's shared shingles, ``at`` is the token's place among them.
    ``l`` counts the shingles that it puts on lists.

    Small sets give a token for each subset of two (of one for sets of size 1);
    large sets and the small ones that a large one could link to give one for
    each shingle of their prefix, where the small ones wait: they meet large sets only.
    """
    n = F.col("n")
    sets = sets.withColumn("s", (F.octet_length("members") / 8).cast("int"))
    light = sets.where(n <= small)
    pair = F.explode(
        F.when(
            n > 1,
            F.flatten(
                F.transform(
                    "prefix",
                    lambda x, i: F.transform(
                        F.slice("prefix", i + 2, F.size("prefix")),
                        lambda y: F.xxhash64(F.least(x, y), F.greatest(x, y)),
                    ),
                )
            ),
        ).otherwise(F.transform("prefix", lambda x: F.xxhash64(x)))
    )
    # A subset's place says nothing about single shingles: None stands for "no bound from it".
    subsets = light.select(
        pair.alias("tok"), "key", "n", "s", F.lit(None).cast("int").alias("at"), F.lit(0).alias("l"),
        F.lit(False).alias("waits"), *BITS,
    )
    scanned = sets.where(n * 100 >= small * PERCENT).withColumn("waits", n <= small)
    # The inverted lists need the prefix without its last shingle, unless the set has one shingle in it.
    first = F.when(n > 1, F.expr("slice(prefix, 1, greatest(size(prefix) - 1, 1))")).otherwise(F.col("prefix"))
    lists = scanned.select(
        F.posexplode(F.transform(first, lambda x: F.xxhash64(x, F.lit("list")))).alias("at", "tok"), "key", "n", "s", F.size(first).alias("l"), "waits", *BITS
    ).select("tok", "key", "n", "s", "at", "l", "waits", *BITS)
    # A list on which everyone waits, or with one set, joins nothing.
    alone = lists.unionByName(subsets)
    live = alone.groupBy("tok").agg(F.count("*").alias("m"), F.min("waits").alias("idle")).where("m > 1 and not idle")
    return alone.join(live.select("tok"), "tok")


def may_link(x: str, y: str):
    """Whether two sets that meet on a token could share enough, by sizes and places.

    No pair shares more than the smaller number of shared shingles; a shingle at
    places i and j leaves at most min(i, j) common ones before it and as many behind
    it as the shorter rest holds.
    """
    c = lambda side, name: F.col(f"{side}.{name}")
    most = F.least(c(x, "s"), c(y, "s"))
    here = F.least(c(x, "at"), c(y, "at")) + F.least(c(x, "s") - c(x, "at"), c(y, "s") - c(y, "at"))
    most = F.least(most, F.coalesce(here, most))
    # Whose prefix ends first in the order holds no shingle of the other beyond the
    # other's prefix; so its shingles outside the other's sketch are not shared.
    gone = lambda a, b: sum((F.bit_count(c(a, w).bitwiseAND(F.bitwise_not(c(b, w)))) for w in BITS), F.lit(0))
    most = F.least(most, F.greatest(c(x, "s") - gone(x, y), c(y, "s") - gone(y, x)))
    return most * (100 + PERCENT) >= (c(x, "n") + c(y, "n")) * PERCENT


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link."""

    def run(batches):
        for batch in batches:
            a, b = [], []
            cols = (batch.column(c).to_pylist() for c in ("a", "b", "na", "nb", "ma", "mb"))
            for x, y, na, nb, ma, mb in zip(*cols, strict=True):
                both = np.concatenate([np.frombuffer(ma, U64), np.frombuffer(mb, U64)])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= PERCENT * (na + nb - common):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    one = sets.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("members").alias("ma"))
    two = sets.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("members").alias("mb"))
    return pairs.join(one, "a").join(two, "b").mapInArrow(run, "a long, b long")


def _leaders(toks: DataFrame, turn: int) -> DataFrame:
    """One partner (a, b) for each set: the set that leads most of its lists.

    The leader of a list is one of its sets that do not wait, the same in all lists
    that hold it and another one each turn; sets of its own component and sets that
    cannot link to it are no partners.
    """
    lead = toks.where("not waits").groupBy("tok").agg(F.min(F.struct(F.xxhash64("key", F.lit(turn)).alias("o"), "n", "key", "comp", "s", "at", *BITS)).alias("l"))
    lead = lead.select("tok", "l.*").alias("l")
    met = toks.alias("x").join(lead, F.col("x.tok") == F.col("l.tok"))
    met = met.where(may_link("x", "l") & (F.col("x.comp") != F.col("l.comp")))
    votes = met.groupBy(F.col("x.key").alias("key"), F.col("l.key").alias("b")).agg(F.count("*").alias("v"))
    best = votes.groupBy("key").agg(F.max(F.struct("v", "b")).alias("m"))
    return best.select(F.least("key", "m.b").alias("a"), F.greatest("key", "m.b").alias("b")).distinct()


def _open(toks: DataFrame, comps: DataFrame) -> DataFrame:
    """Tokens on which several components meet, with each set's component."""
    own = toks.join(comps.withColumnRenamed("node", "key"), "key", "left").withColumn(
        "comp", F.coalesce("component", "key")
    ).drop("component")
    apart = own.groupBy("tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    return own.join(apart.where("lo != hi").select("tok"), "tok")


def links(sets: DataFrame) -> DataFrame:
    """(node, component) over set keys; sets without links do not appear."""
    small = boundary(cost_table(sets))
    toks = stored(tokens(sets, small))
    edges = sets.sparkSession.createDataFrame([], "a long, b long")
    comps = sets.sparkSession.createDataFrame([], "node long, component long")
    live = stored(_open(toks, comps))
    turn = 0
    while True:
        tried = stored(_leaders(live, turn))
        turn += 1
        found = stored(verified(tried, sets))
        hits = found.count()
        if hits == 0:
            break
        edges = edges.unionByName(found)
        comps = stored(connected_components(edges))
        live = stored(_open(toks, comps))
        if 8 * hits < tried.count():  # what is left links rarely: compare it pair by pair
            break
    last = stored(verified(_remaining(live), sets))
    if last.isEmpty():
        return comps
    return stored(connected_components(edges.unionByName(last)))


MET = "key long, partners binary, counts binary, needs binary"


def _meetings(batches):
    """Pairs of unconnected sets that meet in a cell: by the smaller set, its partners,
    how often they met and how often they must meet in all to link.

    Rows come sorted by cell; a cell that a batch cuts waits for the next one.
    """
    names = ["tok", "a", "b", "key", "comp", "n", "s", "at", "l", "block", "waits"]
    held = None

    def pairs(cols, first, size):
        tok_end = np.repeat(first + size, size)
        row = np.arange(len(tok_end))
        count = tok_end - row - 1
        upto = np.cumsum(count)
        at = 0
        while at < len(row):
            done = upto[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(upto, done + PAIRS_AT_ONCE, "right")))
            i = np.repeat(row[at:to], count[at:to])
            j = i + 1 + np.arange(len(i)) - np.repeat(upto[at:to] - count[at:to] - done, count[at:to])
            yield i, j
            at = to

    def emit(cols):
        cell = np.flatnonzero(
            np.append(True, (cols["tok"][1:] != cols["tok"][:-1]) | (cols["a"][1:] != cols["a"][:-1]) | (cols["b"][1:] != cols["b"][:-1]))
        )
        size = np.diff(np.append(cell, len(cols["tok"])))
        for i, j in pairs(cols, cell, size):
            n, s, at, left = cols["n"], cols["s"], cols["at"], cols["s"] - cols["l"]
            total = (n[i] + n[j]) * PERCENT
            both = np.minimum(s[i], s[j])
            here = np.minimum(at[i], at[j]) + np.minimum(s[i] - at[i], s[j] - at[j])
            single = at[i] >= 0  # met on one shingle, not on a subset
            most = np.where(single, np.minimum(both, here), both)
            ok = (cols["comp"][i] != cols["comp"][j]) & (most * (100 + PERCENT) >= total)
            ok &= ~(cols["waits"][i] & cols["waits"][j])
            ok &= (cols["a"][i] == cols["b"][i]) | (cols["block"][i] != cols["block"][j])
            i, j, single, total = i[ok], j[ok], single[ok], total[ok]
            if not len(i):
                continue
            swap = (n[j] < n[i]) | ((n[j] == n[i]) & (cols["key"][j] < cols["key"][i]))
            x, y = np.where(swap, j, i), np.where(swap, i, j)
            # Whose prefix ends first in the order shares nothing of its prefix but what the
            # other's prefix holds; the rest adds at most what is behind its prefix.
            need = np.where(single, -(-total // (100 + PERCENT)) - np.maximum(left[x], left[y]), 0)
            kx, ky = cols["key"][x], cols["key"][y]
            order = np.lexsort((ky, kx))
            kx, ky, need = kx[order], ky[order], need[order]
            new = np.flatnonzero(np.append(True, (kx[1:] != kx[:-1]) | (ky[1:] != ky[:-1])))
            met = np.diff(np.append(new, len(kx)))
            need = np.minimum.reduceat(need, new)
            kx, ky = kx[new], ky[new]
            own = np.flatnonzero(np.append(True, kx[1:] != kx[:-1]))
            per = np.diff(np.append(own, len(kx)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(kx[own]), binary_rows(ky, per), binary_rows(met.astype(np.int32), per),
                    binary_rows(need.astype(np.int32), per),
                ],
                ["key", "partners", "counts", "needs"],
            )

    for batch in batches:
        cols = {c: np.asarray(batch.column(c)) for c in names[:-1]} | {"waits": batch.column("waits").to_numpy(zero_copy_only=False)}
        if held is not None:
            cols = {c: np.concatenate([held[c], cols[c]]) for c in names}
        same = (cols["tok"] == cols["tok"][-1]) & (cols["a"] == cols["a"][-1]) & (cols["b"] == cols["b"][-1]) if len(cols["tok"]) else None
        if same is None:
            continue
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        held = {c: v[cut:] for c, v in cols.items()}
        if cut:
            yield from emit({c: v[:cut] for c, v in cols.items()})
    if held is not None:
        yield from emit(held)


def _enough(batches):
    """Pairs (a, b) that met often enough."""
    for batch in batches:
        a, b = [], []
        cols = (batch.column(c).to_pylist() for c in ("key", "partners", "counts", "needs"))
        for key, ks, cs, ns in zip(*cols, strict=True):
            partner = np.frombuffer(b"".join(ks), np.int64)
            met, need = np.frombuffer(b"".join(cs), np.int32), np.frombuffer(b"".join(ns), np.int32)
            who, back = np.unique(partner, return_inverse=True)
            total = np.bincount(back, met, len(who))
            least = np.full(len(who), np.iinfo(np.int32).max, np.int64)
            np.minimum.at(least, back, need)
            good = who[total >= least]
            a.append(np.full(len(good), key))
            b.append(good)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def _remaining(live: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets in different components that may link, each once.

    A list of more than ``CELL`` sets is cut into blocks, and each two blocks make a
    cell; pairs are counted inside the cells and never listed one by one.
    """
    sizes = live.groupBy("tok").agg(F.ceil(F.count("*") / CELL).cast("int").alias("g"))
    cells = (
        live.join(sizes, "tok")
        .withColumn("block", F.pmod(F.xxhash64("key"), F.col("g")).cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, g - 1)")))
        .select(
            "tok", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "key", "comp", "n", "s",
            F.coalesce("at", F.lit(-1)).alias("at"), "l", "block", "waits",
        )
    )
    parts = int(live.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cells.repartition(parts, "tok", "a", "b").sortWithinPartitions("tok", "a", "b")
    met = dealt.mapInArrow(_meetings, MET).groupBy("key").agg(
        *[F.collect_list(c).alias(c) for c in ("partners", "counts", "needs")]
    )
    return met.mapInArrow(_enough, "a long, b long")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): the class of each document.

    ``component_id`` is the smallest id reachable by links, the document's own
    included.  One row per input row: repeated rows and equal texts have equal
    sets and one class.  Null and empty texts have the empty set and stand alone;
    a null id never becomes a component's id unless all its ids are null.  Only
    the named columns are read.
    """
    own = stored(sized(docs, id_col, text_col))
    comps = links(linkable_sets(docs, text_col))
    firsts = own.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("first"))
    linked = firsts.join(comps.withColumnRenamed("node", "key"), "key").select("key", "component", "first")
    lowest = linked.groupBy("component").agg(F.min("first").alias("lowest"))
    far = linked.join(lowest, "component").select("key", "lowest")
    return (
        own.join(firsts, "key", "left")
        .join(far, "key", "left")
        .select("doc_id", "n_shingles", F.coalesce("lowest", "first", "doc_id").alias("component_id"))
    )


# --------------------------------------------------------------------------
# brute force, for tests
# --------------------------------------------------------------------------
def brute_force(docs: list[tuple]) -> list[tuple]:
    import re

    sets = []
    for _, text in docs:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        if len(w) >= SHINGLE:
            sets.append({tuple(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)})
        else:
            sets.append({tuple(w)} if w else set())
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= PERCENT * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    low: dict[int, object] = {}
    for i, (name, _) in enumerate(docs):
        r = root(i)
        if name is not None and (low.get(r) is None or name < low[r]):
            low[r] = name
    return [(name, len(sets[i]), low.get(root(i), name)) for i, (name, _) in enumerate(docs)]
