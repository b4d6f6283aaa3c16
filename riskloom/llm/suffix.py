"""Exact repeated-substring removal on Burrows-Wheeler transforms.

Every byte that lies in a 200-byte string occurring anywhere else is removed.

*Dealing.*  All 200-byte windows must be compared with all others, wherever they
are.  A window's key is the smallest hash of its 32-byte grams, so equal windows
have equal keys; neighbouring windows with the same such gram travel as one
stretch (199 bytes longer than its number of windows).  Keys of one stretch only
repeat nothing and go no further.  A key that very many texts share, such as that of
a frequent line, or whose different stretches take over ``KEY_BYTES`` in all, is
extended by the smallest hashes under further hash functions.  Keys still above the
bound after ``LEVELS`` such passes, such as the border of a passage in a large share of
the texts, are split by whole windows: each window goes under its own hash, so
such a key has one stretch.  No key gathers more than the bound in one transform.

*Comparing.*  Equal texts (xxhash64) and equal stretches (64-bit content hash) are
told by hash and repeat as a whole.  The different stretches of a bucket of keys are compared unless all of
a key's are known to repeat: the bytes under windows whose hash occurs at another place of the bucket form one text, whose
Burrows-Wheeler transform is built over suffixes sorted by at least 200 bytes.
Interval expansion then derives the longest common prefixes of neighbouring suffixes in
increasing order: the intervals of all strings of length l are extended backward
by one byte, and each interval whose right border is still open fixes the value
l there and is extended in the next round.  It stops at 200; borders still open
join suffixes that share at least 200 bytes.  Stretches that equal each other enter once,
with their number.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_CODES, STEP, U64, binary_rows, column_bytes, mix, pieces, powers, seeded, stored

LENGTH = 200
GRAM = 32
SEGMENT = 1 << 18  # bytes of one text handled at once
CHUNK_BYTES = 16 << 20
BUCKET_BYTES = 16 << 20  # text whose stretches one bucket of keys holds
LEAST_BUCKETS = 64
BWT_BYTES = 1 << 19  # stretch bytes of which the repeated windows are in one transform
HOT_SHARE, HOT_LEAST = 32, 64  # a key is split if a chunk has it in 1/32 of its texts, 64 at least
HOT_KEYS = 1 << 20
LEVELS = 2
KEY_BYTES = 1 << 20  # different stretches under one key; more are split
CHUNK_ROWS = 1 << 20  # stretches packed at once
LAST_BUCKETS = 32  # times the buckets of keys when windows go singly
EXTEND = 4  # hash functions that a split adds to a key
OPEN = 255


# --------------------------------------------------------------------------
# longest common prefixes up to a bound
# --------------------------------------------------------------------------
def suffix_order(text: np.ndarray, depth: int):
    """Suffixes sorted by their first ``depth`` symbols or more.

    Also returns the packed first symbols, their number and the bits of each.
    """
    n = len(text)
    width = max(1, int(n).bit_length())
    bits = max(1, int(text.max(initial=1)).bit_length())
    first = max(1, min(62 // bits, (63 - width) // bits))
    code = np.zeros(n, np.int64)
    for j in range(first):
        code <<= bits
        if j < n:
            code[: n - j] |= text[j:]
    key = (code << width) | np.arange(n)
    key.sort()
    order = key & ((1 << width) - 1)
    sorted_code = key >> width
    fresh = np.append(True, sorted_code[1:] != sorted_code[:-1])
    rank = np.empty(n, np.int64)
    starts = np.flatnonzero(fresh)
    rank[order] = np.repeat(starts, np.diff(np.append(starts, n)))
    alone = fresh & np.append(fresh[1:], True)
    active = np.flatnonzero(~alone)  # places in groups that are not yet told apart
    at = first
    while at < depth and len(active):
        own = order[active]
        ahead = own + at
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        if 3 * width + 1 <= 63:
            key = (((rank[own] << (width + 1)) | second) << width) | own
            key.sort()
            own = key & ((1 << width) - 1)
            pair = key >> width
        else:
            pair = (rank[own] << 32) | second
            by = np.argsort(pair, kind="stable")
            own, pair = own[by], pair[by]
        order[active] = own
        fresh = np.append(True, pair[1:] != pair[:-1])
        starts = np.flatnonzero(fresh)
        size = np.diff(np.append(starts, len(own)))
        rank[own] = np.repeat(active[starts], size)
        active = active[np.repeat(size > 1, size)]
        at *= 2
    return order, code, first, bits


def bounded_lcp(text: np.ndarray, bound: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): suffixes, and for each the common prefix with the one before.

    Values under ``bound`` are exact; ``OPEN`` stands for ``bound`` or more.
    ``bound`` must be less than ``OPEN``.
    """
    n = len(text)
    if n >= 1 << 31:
        raise ValueError("too many bytes in one transform")
    order, code, first, bits = suffix_order(text, bound)
    first = min(first, bound)
    before = text[order - 1].astype(np.uint16)  # the transform; the byte before the first is the last, a separator
    lf_order = np.argsort(before, kind="stable").astype(np.int32)
    lf = np.empty(n, np.int32)
    lf[lf_order] = np.arange(n, dtype=np.int32)
    # For each row the next and the last row before it with the same byte.
    same = before[lf_order[1:]] == before[lf_order[:-1]]
    later, earlier = np.full(n, n, np.int32), np.full(n, -1, np.int32)
    later[lf_order[:-1][same]] = lf_order[1:][same]
    earlier[lf_order[1:][same]] = lf_order[:-1][same]

    # The packed first symbols give all values under `first` at once.
    lcp = np.full(n + 1, OPEN, np.uint8)
    lcp[0] = lcp[n] = 0
    packed = code[order]
    differ = packed[1:] ^ packed[:-1]
    del code, packed, lf_order, same
    total = max(1, min(62 // bits, (63 - max(1, int(n).bit_length())) // bits)) * bits
    known = np.flatnonzero(differ)
    length = np.frexp(differ[known].astype(np.float64))[1]
    # Rounding up to the next power of two must not add a bit.
    length -= (differ[known] >> np.minimum(length - 1, 62)) == 0
    value = (total - length) // bits
    known, value = known[value < bound], value[value < bound]
    lcp[known + 1] = value
    edges = np.concatenate([[0], np.flatnonzero(lcp[1:n] < first) + 1, [n]])
    lo, hi = edges[:-1], edges[1:]
    pick = (hi < n) & (lcp[np.minimum(hi, n)] == first - 1)
    lo, hi = lo[pick], hi[pick]
    for level in range(first, bound):
        if not len(lo):
            break
        size = hi - lo
        start = np.cumsum(size) - size
        row = np.arange(int(size.sum())) + np.repeat(lo - start, size)
        # Rows of an interval with one byte go to consecutive rows: its backward extension.
        head = lf[row[earlier[row] < np.repeat(lo, size)]].astype(np.int64)
        tail = lf[row[later[row] >= np.repeat(hi, size)]].astype(np.int64) + 1
        head.sort()
        tail.sort()  # extensions are disjoint, so first and last rows pair up in order
        new = lcp[tail] == OPEN
        lo, hi = head[new], tail[new]
        lcp[hi] = level
    return order, lcp[:n]


def repeated_starts(data: np.ndarray, lens: np.ndarray, bound: int = LENGTH) -> np.ndarray:
    """Places of ``data`` (strings one after another) whose next ``bound`` bytes lie in
    their string and occur at another place too."""
    n = len(data) + len(lens)
    seen = np.zeros(256, bool)
    seen[data] = True
    number = np.cumsum(seen).astype(np.uint8) if seen.sum() < 256 else np.arange(256).astype(np.uint16) + 1
    text = np.zeros(n, np.int64)
    place = np.arange(len(data)) + np.repeat(np.arange(len(lens)), lens)
    text[place] = number[data]
    order, lcp = bounded_lcp(text, bound)
    alike = lcp == OPEN
    twice = alike | np.append(alike[1:], False)
    hit = np.zeros(n, bool)
    hit[order[twice]] = True
    ends = np.repeat(np.cumsum(lens), lens)
    return hit[place] & (np.arange(len(data)) + bound <= ends)


# --------------------------------------------------------------------------
# stretches
# --------------------------------------------------------------------------
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
BACK = U64(pow(int(STEP), -1, 1 << 64))


def _powers(n: int):
    size = max(SEGMENT + LENGTH, n, *_POWERS)
    if size not in _POWERS:
        _POWERS.clear()
        _POWERS[size] = powers(size + 1), powers(size + 1, BACK)
    return _POWERS[size]


PLACE_BITS = 24


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` consecutive values."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def _least_gram(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each window the smallest gram's hash (by its upper bits, the first of equals) and place."""
    low = U64((1 << PLACE_BITS) - 1)
    place = _least((code & ~low) | np.arange(len(code), dtype=U64), LENGTH - GRAM + 1) & low
    place = place.astype(np.int64)
    return code[place], place


def _one_of(code: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which codes are among sorted keys; most are told by their upper bits."""
    found = np.zeros(len(code), bool)
    if len(keys):
        upper = np.zeros(1 << 16, bool)
        upper[keys >> U64(48)] = True
        maybe = np.flatnonzero(upper[code >> U64(48)])
        near = np.minimum(np.searchsorted(keys, code[maybe]), len(keys) - 1)
        found[maybe[keys[near] == code[maybe]]] = True
    return found


def _windows_near(grams: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Windows that lie in one text and hold one of some grams, by place."""
    if not len(grams):
        return grams
    width = LENGTH - GRAM + 1
    cut = np.flatnonzero(np.append(True, grams[1:] > grams[:-1] + width))
    first = np.maximum(grams[cut] - width + 1, 0)
    size = grams[np.append(cut[1:], len(grams)) - 1] - first + 1
    own = np.arange(int(size.sum())) + np.repeat(first - (np.cumsum(size) - size), size)
    return own[own + LENGTH <= offsets[np.searchsorted(offsets, own, "right")]]


def _grams_of(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Only the grams of these windows: runs of windows, each with its further grams.

    Places of the grams, and of each window's first one among them.
    """
    if not len(own):
        return own, own
    run = np.flatnonzero(np.append(True, own[1:] != own[:-1] + 1))
    size = np.diff(np.append(run, len(own)))
    span = size + LENGTH - GRAM
    base = np.cumsum(span) - span
    these = np.arange(int(span.sum())) + np.repeat(own[run] - base, span)
    return these, np.arange(len(own)) + np.repeat(base - run, size)


def stretches(data: np.ndarray, offsets: np.ndarray, hot: list[np.ndarray]):
    """(key, content, text, at, windows) of the stretches of some texts.

    A stretch is a run of windows with the same smallest gram at the same place,
    so no window repeats inside one.  ``hot`` lists, by level, the keys to extend;
    with ``hot`` non-empty only windows whose keys are hot at every level but the
    last are returned.  The keys listed at the last level, behind ``LEVELS``, are
    replaced by the hash of the whole window, each window being a stretch.
    """
    empty = np.zeros(0, np.int64)
    none = empty.view(U64), empty.view(U64), empty, empty, empty
    if len(data) < LENGTH:
        return none
    if len(data) >= 1 << PLACE_BITS:
        raise ValueError("too many bytes at once")
    up, down = _powers(len(data))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, U64)
        np.cumsum(BYTE_CODES[data] * up[: len(data)], out=sums[1:])
        gram = mix((sums[GRAM:] - sums[:-GRAM]) * down[: len(data) - GRAM + 1])
        if hot:
            own = _windows_near(np.flatnonzero(_one_of(gram, hot[0])), offsets)
            these, spot = _grams_of(own)
            key, place = (x[spot] for x in _least_gram(gram[these]))
            fresh = np.append(True, place[1:] != place[:-1])[: len(own)]  # each run has places of its own
        else:
            key, place = _least_gram(gram)
            m = len(key)
            end = np.repeat(offsets[1:], np.diff(offsets))[:m]
            own = np.flatnonzero(np.arange(m) + LENGTH <= end)  # windows that lie in one text
            key = key[own]
            fresh = np.append(True, place[1:] != place[:-1])[own]
            fresh |= np.append(True, own[1:] != own[:-1] + 1)[: len(own)]
        for level, keys in enumerate(hot):
            keep = _one_of(key, keys)
            fresh = (fresh | ~np.append(False, keep[:-1])[: len(keep)])[keep]
            own, key = own[keep], key[keep]
            if not len(own):
                return none
            if level >= LEVELS:
                whole = mix((sums[own + LENGTH] - sums[own]) * down[own] + BYTE_CODES[9])
                key, fresh = mix(key + whole), np.ones(len(own), bool)
                continue
            these, spot = _grams_of(own)
            these = gram[these]
            for salt in seeded(EXTEND, level + 7):
                more, place = _least_gram(mix(these ^ salt))
                place = place[spot]
                fresh |= np.append(True, place[1:] != place[:-1])
                key = mix(key + more[spot])
        first = np.flatnonzero(fresh)
        if not len(first):
            return none
        at, key, size = own[first], key[first], np.diff(np.append(first, len(own)))
        length = size + LENGTH - 1
        content = mix((sums[at + length] - sums[at]) * down[at] + length.astype(U64) * BYTE_CODES[7])
    text = np.searchsorted(offsets, at, "right") - 1
    return key, content, text, at - offsets[text], size


def _groups(*cols: np.ndarray) -> np.ndarray:
    """Where the values of sorted columns change."""
    if not len(cols[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(cols[0]) - 1, bool)
    for c in cols:
        new |= c[1:] != c[:-1]
    return np.flatnonzero(np.append(True, new))


def _folded(key, content, who, at, size):
    """Equal stretches once: (key, content, who, at, size, many), and the places of all
    that occur several times as (who, at, size), side by side ones joined."""
    order = np.lexsort((at, who, content, key))
    key, content, who, at, size = (x[order] for x in (key, content, who, at, size))
    first = _groups(key, content)
    count = np.diff(np.append(first, len(key)))
    twice = np.flatnonzero(np.repeat(count > 1, count))
    w, a, n = who[twice], at[twice], size[twice]
    order = np.lexsort((a, w))
    w, a, n = w[order], a[order], n[order]
    if len(w):
        cut = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (a[1:] != a[:-1] + n[:-1])))
        n = np.add.reduceat(n, cut)
        w, a = w[cut], a[cut]
    return (key[first], content[first], who[first], at[first], size[first], np.minimum(count, 2)), (w, a, n)


def _segments(data: np.ndarray, offsets: np.ndarray):
    """Texts in parts of bounded size: (bytes, offsets, text numbers, places in the text).

    A long text is cut into segments that overlap by 199 bytes, so each window is in one.
    """
    size = np.diff(offsets)
    if size.max(initial=0) <= SEGMENT:
        yield data, offsets, np.arange(len(size)), np.zeros(len(size), np.int64)
        return
    for i, n in enumerate(size.tolist()):
        for at in range(0, max(n - LENGTH + 1, 1), SEGMENT):
            part = data[offsets[i] + at : offsets[i] + min(at + SEGMENT + LENGTH - 1, n)]
            yield part, np.array([0, len(part)]), np.array([i]), np.array([at])


BLOB = "bucket int, kind int, texts binary, keys binary, contents binary, who binary, at binary, windows binary, many binary"


def _collect(buckets: int, hot: list[np.ndarray], factor: int):
    """Stretches of a task's texts, packed by bucket of keys (kind 0).

    Equal texts of a chunk count once.  A stretch that occurs twice in a chunk is
    known to repeat: it goes on once, marked, and its places are passed on by text
    (kind 1).  Keys that a large share of the chunk's texts have are only named (kind 2).
    """

    def pack(held, passed, texts):
        key, content, who, at, size, many = (np.concatenate([h[i] for h in held]) for i in range(6))
        order = np.lexsort((at, who, content, key))
        key, content, who, at, size, many = (x[order] for x in (key, content, who, at, size, many))
        names = np.array(list(texts), np.int64)
        first = _groups(key, content)
        count = np.diff(np.append(first, len(key)))
        twice = np.repeat(np.add.reduceat(many, first) > 1, count) if len(first) else many > 1
        group = _groups(key[first])
        kinds = np.diff(np.append(group, len(first)))
        split = np.zeros(len(kinds), bool)
        if len(hot) <= LEVELS and len(kinds):
            split = np.add.reduceat(size[first] + LENGTH - 1, group) > KEY_BYTES * factor
        if len(hot) < LEVELS:
            split |= kinds > max(HOT_LEAST, len(names) // HOT_SHARE) * factor
        crowded = np.repeat(split, kinds)
        told = key[first[group][split]]
        # Places of stretches that meet only now, unless their key is split further.
        here = np.flatnonzero(np.repeat((count > 1) & ~crowded, count))
        send = first[~crowded]
        # One numbering for both: rows of the chunk, then places passed on before.
        done = [np.concatenate([p[i] for p in passed]) for i in range(3)]
        pass_on = np.concatenate([here, len(key) + np.arange(len(done[0]))])
        who, at, size = (np.concatenate([x, y]) for x, y in zip((who, at, size), done, strict=True))
        twice = np.append(twice, np.ones(len(done[0]), bool))
        out = []

        def blobs(kind, b, rows):
            order = np.argsort(b, kind="stable")
            b, rows = b[order], rows[order]
            cut = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else []
            for x, y in zip(cut, np.append(cut[1:], len(b)).astype(int), strict=True) if len(b) else ():
                own = rows[x:y]
                used, local = np.unique(who[own], return_inverse=True)
                out.append(
                    (
                        int(b[x]), kind, names[used].tobytes(),
                        key[own].tobytes() if kind == 0 else b"", content[own].tobytes() if kind == 0 else b"",
                        local.astype("<u2" if len(used) < 1 << 16 else "<u4").tobytes(), at[own].astype("<u4").tobytes(),
                        size[own].astype("<u4").tobytes(), twice[own].astype(np.uint8).tobytes(),
                    )
                )

        blobs(0, (key[send] % U64(buckets)).astype(np.int64), send)
        blobs(1, names[who[pass_on]].view(U64) % U64(buckets), pass_on)
        for k in told:
            out.append((int(k % U64(buckets)), 2, b"", k.tobytes(), b"", b"", b"", b"", b""))
        cols = list(zip(*out, strict=True)) or [()] * 9
        types = [pa.int32(), pa.int32(), *[pa.binary()] * 7]
        fields = [x.split()[0] for x in BLOB.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], fields)

    def run(batches):
        held, passed, texts, size, count = [], [], {}, 0, 0
        for batch in batches:
            for piece in pieces(batch, "t", SEGMENT):
                names = np.asarray(piece.column("dk"))
                fresh = [i for i, k in enumerate(names.tolist()) if k not in texts and not texts.update({k: len(texts)})]
                if not fresh:
                    continue
                piece = piece.take(pa.array(fresh))
                number = np.array([texts[k] for k in names[fresh].tolist()])
                data, off = column_bytes(piece.column("t"))
                for part, bounds, rows, base in _segments(data, off):
                    k, c, t, at, w = stretches(part, bounds, hot)
                    one, places = _folded(k, c, number[rows[t]], at + base[t], w)
                    held.append(one)
                    passed.append(places)
                    count += len(one[0])
                size += len(data)
                if size > CHUNK_BYTES or count > CHUNK_ROWS:
                    yield pack(held, passed, texts)
                    held, passed, texts, size, count = [], [], {}, 0, 0
        if held:
            yield pack(held, passed, texts)

    return run


FOUND = "kind int, key long, content long, dk long, at int, windows int, many int"


def _meet(table: pa.Table, bound: int | None = None) -> pa.Table:
    """One bucket of keys: stretches whose key occurs more than once (kind 0), places
    known to repeat (kind 1) and keys to split (kind 2), among them those whose
    different stretches take over ``bound`` bytes.

    A key under which each stretch occurs several times has nothing left to compare:
    its stretches are places known to repeat."""
    cols = [[], [], [], [], [], []]
    passed: list[list] = [[], [], []]
    told = [np.zeros(0, U64)]
    for kind, texts, k, c, who, at, w, many in zip(
        *(table.column(x).to_pylist() for x in ("kind", "texts", "keys", "contents", "who", "at", "windows", "many")),
        strict=True,
    ):
        if kind == 2:
            told.append(np.frombuffer(k, U64))
            continue
        names = np.frombuffer(texts, np.int64)
        dk = names[np.frombuffer(who, "<u2" if len(names) < 1 << 16 else "<u4")]
        at, w = np.frombuffer(at, "<u4").astype(np.int64), np.frombuffer(w, "<u4").astype(np.int64)
        if kind == 1:
            for x, v in zip(passed, (dk, at, w), strict=True):
                x.append(v)
        else:
            many = np.frombuffer(many, np.uint8).astype(np.int64) + 1
            for x, v in zip(cols, (np.frombuffer(k, U64), np.frombuffer(c, U64), dk, at, w, many), strict=True):
                x.append(v)
    told = np.unique(np.concatenate(told))
    none = np.zeros(0, np.int64)
    p = [np.concatenate(x) if x else none for x in passed]
    out = [(1, p[0] * 0, p[0] * 0, p[0], p[1], p[2], p[0] * 0 + 2)]
    if cols[0]:
        k, c, dk, at, w, many = map(np.concatenate, cols)
        keep = ~np.isin(k, told)
        k, c, dk, at, w, many = (x[keep] for x in (k, c, dk, at, w, many))
        order = np.lexsort((at, dk, c, k))
        k, c, dk, at, w, many = (x[order] for x in (k, c, dk, at, w, many))
        if len(k):
            key_at = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            key_n = np.diff(np.append(key_at, len(k)))
            shared = np.repeat(np.add.reduceat(many, key_at) > 1, key_n)
            text_at = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])))
            weight = np.repeat(np.add.reduceat(many, text_at), np.diff(np.append(text_at, len(k))))
            if bound is not None:
                fresh = np.zeros(len(k), np.int64)
                fresh[text_at] = w[text_at] + LENGTH - 1
                large = np.add.reduceat(fresh, key_at) > bound
                told = np.concatenate([told, k[key_at[large]]])
                shared &= ~np.repeat(large, key_n)
            # The same place of equal texts in several chunks: once is enough.
            once = np.append(True, (k[1:] != k[:-1]) | (c[1:] != c[:-1]) | (dk[1:] != dk[:-1]) | (at[1:] != at[:-1]))
            known = np.repeat(np.minimum.reduceat(weight, key_at) > 1, key_n)
            use = shared & once & known
            out.append((1, at[use] * 0, at[use] * 0, dk[use], at[use], w[use], at[use] * 0 + 2))
            use = shared & once & ~known
            out.append((0, k[use].view(np.int64), c[use].view(np.int64), dk[use], at[use], w[use], np.minimum(weight[use], 2)))
    t = told.view(np.int64)
    out.append((2, t, t * 0, t * 0, t * 0, t * 0, t * 0))
    arrays = [pa.array(np.concatenate([np.full(len(o[1]), o[0]) for o in out]), pa.int32())]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
    for i, kind in enumerate(kinds, 1):
        arrays.append(pa.array(np.concatenate([o[i] for o in out]).astype(np.int64)).cast(kind))
    return pa.table(arrays, names=[x.split()[0] for x in FOUND.split(", ")])


def _met(bound: int | None):
    return lambda table: _meet(table, bound)


def shared_stretches(texts: DataFrame) -> DataFrame:
    """Stretches of ``texts`` (dk, t) that may repeat, by the rules of ``_meet``.

    Passes over the texts until no key is shared by too many or holds too many bytes;
    after the first, a pass handles the windows of split keys only.
    """
    total = texts.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-total // BUCKET_BYTES))
    hot: list[np.ndarray] = []
    out = None
    factor = 1
    while True:
        last = len(hot) > LEVELS
        blobs = texts.mapInArrow(_collect(buckets * (LAST_BUCKETS if last else 1), hot, factor), BLOB)
        found = stored(blobs.groupBy("bucket").applyInArrow(_met(None if last else KEY_BYTES * factor), FOUND))
        named = found.where("kind = 2").select("key")
        keys = named.limit(HOT_KEYS + 1).collect()
        if len(keys) > HOT_KEYS:  # the list of split keys goes to all tasks, so it stays bounded
            factor *= 4
            continue
        good = found.where("kind < 2")
        out = good if out is None else out.unionByName(good)
        if not keys:
            return out
        hot.append(np.sort(np.array([r["key"] for r in keys], np.int64).view(U64)))


# --------------------------------------------------------------------------
# comparing and removing
# --------------------------------------------------------------------------
def _cut_out(batches):
    """Bytes of the stretches that a text is asked for."""
    for batch in batches:
        rows = []
        for text, asked in zip(batch.column("t").to_pylist(), batch.column("asked").to_pylist(), strict=True):
            raw = (text or "").encode()
            for a in asked:
                rows.append((a["bucket"], a["key"], a["content"], a["many"], raw[a["at"] : a["at"] + a["windows"] + LENGTH - 1]))
        cols = list(zip(*rows, strict=True)) or [()] * 5
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["bucket", "key", "content", "many", "raw"]
        )


def spans_of(flags: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, first, end) of the bytes covered by the flagged starts of strings."""
    hit = np.flatnonzero(flags)
    if not len(hit):
        return hit, hit, hit
    offsets = np.concatenate([[0], np.cumsum(lens)])
    row = np.searchsorted(offsets, hit, "right") - 1
    new = np.append(True, (row[1:] != row[:-1]) | (hit[1:] > hit[:-1] + LENGTH))
    first = hit[new]
    last = hit[np.append(new[1:], True)]
    row = row[new]
    return row, first - offsets[row], last - offsets[row] + LENGTH


def _again(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Starts of the windows whose hash occurs at another place of some strings too: all
    that can repeat."""
    lens = np.diff(off)
    starts = np.flatnonzero(np.arange(len(data)) + LENGTH <= np.repeat(off[1:], lens))
    up, down = _powers(len(data))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, U64)
        np.cumsum(BYTE_CODES[data] * up[: len(data)], out=sums[1:])
        whole = mix((sums[starts + LENGTH] - sums[starts]) * down[starts])
    order = np.argsort(whole)
    alike = whole[order[1:]] == whole[order[:-1]]
    return np.sort(starts[order[np.append(alike, False) | np.append(False, alike)]])


def _repeated(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """``repeated_starts`` of strings one after another.  Only the bytes under the windows
    that ``_again`` finds are compared, each stretch of them as a string of its own."""
    flags = np.zeros(len(data), bool)
    starts = _again(data, off)
    if len(starts):
        # Windows of two strings are LENGTH apart at least.
        run = np.flatnonzero(np.append(True, starts[1:] >= starts[:-1] + LENGTH))
        size = starts[np.append(run[1:], len(starts)) - 1] - starts[run] + LENGTH
        place = np.arange(int(size.sum())) + np.repeat(starts[run] - (np.cumsum(size) - size), size)
        flags[place[repeated_starts(data[place], size)]] = True
    return flags


def _compare(table: pa.Table) -> pa.Table:
    """One bucket: the covered bytes of each stretch, as pairs (first, end)."""
    key = np.asarray(table.column("key"))
    content = np.asarray(table.column("content"))
    order = np.lexsort((content, key))
    fresh = np.append(True, (key[order][1:] != key[order][:-1]) | (content[order][1:] != content[order][:-1]))
    own = order[fresh]
    table = table.take(pa.array(own))
    key, content = key[own], content[own]
    data, off = column_bytes(table.column("raw"))
    lens = np.diff(off)
    flags = _repeated(data, off)
    # A stretch that occurs several times repeats as a whole.
    several = np.repeat(np.asarray(table.column("many")) > 1, lens)
    flags |= several & (np.arange(len(data)) + LENGTH <= np.repeat(off[1:], lens))
    row, first, end = spans_of(flags, lens)
    count = np.bincount(row, minlength=len(lens))
    has = count > 0
    pairs = np.stack([first, end], 1).astype("<i4")
    return pa.table(
        [pa.array(key[has]), pa.array(content[has]), binary_rows(pairs.reshape(-1), 2 * count[has])],
        names=["key", "content", "spans"],
    )


def _covered(spans: list, size: int) -> list[tuple[int, int]]:
    """Maximal covered runs of a text."""
    pairs = [np.frombuffer(s["spans"], "<i4").reshape(-1, 2).astype(np.int64) + s["at"] for s in spans]
    if not pairs:
        return []
    p = np.concatenate(pairs)
    p = p[np.argsort(p[:, 0], kind="stable")]
    reach = np.maximum.accumulate(p[:, 1])
    new = np.append(True, p[1:, 0] > reach[:-1])
    return list(zip(p[new, 0].tolist(), reach[np.append(new[1:], True)].tolist(), strict=True))


def text_spans(found: DataFrame, compared: DataFrame, copies: DataFrame) -> DataFrame:
    """(dk, spans): the places of what repeats, for the texts that occur once.

    A text with copies repeats wholly.  Its places come once from each chunk that holds a copy,
    and each copy would get them all, which grows with the square of the copies.
    """
    by_content = found.where("kind = 0").join(compared, ["key", "content"]).select("dk", "at", "spans")
    known = found.where("kind = 1").select("dk", "at", "windows").mapInArrow(_whole, "dk long, at int, spans binary")
    several = copies.where("copies > 1").select("dk")
    return (
        by_content.unionByName(known).join(several, "dk", "left_anti")
        .groupBy("dk").agg(F.collect_list(F.struct("at", "spans")).alias("spans"))
    )


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, spans): the byte spans of each whole text that occur elsewhere.

    ``spans`` are maximal runs [first, end) of bytes covered by a 200-byte string
    that starts anywhere else, in the same text too.  One row per input row; texts
    of under 200 bytes, empty and null ones have no spans.  Rows that hold the same text
    repeat each other wholly.  Only the named columns are read.
    """
    src = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("t")).withColumn("dk", F.xxhash64("t"))
    enough = src.where(F.octet_length("t") >= LENGTH)
    found = shared_stretches(enough.select("dk", "t"))
    meet = found.where("kind = 0")
    contents = stored(
        meet.groupBy("key", "content").agg(F.min(F.struct("dk", "at", "windows")).alias("p"), F.max("many").alias("many"))
    )
    size = contents.agg(F.sum(F.col("p.windows") + LENGTH)).first()[0] or 0
    buckets = max(1, -(-size // BWT_BYTES))
    asked = contents.select(
        F.col("p.dk").alias("dk"),
        F.struct(
            F.pmod("key", F.lit(buckets)).cast("int").alias("bucket"),
            "key", "content", "many", F.col("p.at").alias("at"), F.col("p.windows").alias("windows"),
        ).alias("a"),
    ).groupBy("dk").agg(F.collect_list("a").alias("asked"))
    copies = stored(enough.groupBy("dk").agg(F.min("doc_id").alias("one"), F.count("*").alias("copies")))
    wanted = asked.join(copies, "dk").select("dk", "one", "asked")
    held = enough.join(wanted, "dk").where(F.col("doc_id").eqNullSafe(F.col("one")))
    raw = held.select("t", "asked").mapInArrow(
        _cut_out, "bucket int, key long, content long, many int, raw binary"
    )
    compared = raw.groupBy("bucket").applyInArrow(_compare, "key long, content long, spans binary")
    compared = stored(compared)
    info = copies.select("dk", "copies").join(text_spans(found, compared, copies), "dk", "left")
    return src.join(info, "dk", "left").select("doc_id", "t", "copies", "spans").mapInArrow(
        _spans, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, text string, spans array<struct<first:long,end:long>>"
    )


def _whole(batches):
    for batch in batches:
        w = np.asarray(batch.column("windows")).astype(np.int64)
        pairs = np.stack([np.zeros(len(w), np.int64), w + LENGTH - 1], 1).astype("<i4")
        yield pa.RecordBatch.from_arrays(
            [batch.column("dk"), batch.column("at"), binary_rows(pairs.reshape(-1), np.full(len(w), 2))],
            ["dk", "at", "spans"],
        )


SPAN_TYPE = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))


def _spans(batches):
    for batch in batches:
        for piece in pieces(batch, "t"):
            size = np.diff(column_bytes(piece.column("t"))[1]).tolist()
            out = []
            cols = (piece.column(c).to_pylist() for c in ("copies", "spans"))
            for n, copies, spans in zip(size, *cols, strict=True):
                runs = [(0, n)] if copies and copies > 1 else _covered(spans or [], n)
                out.append([{"first": a, "end": b} for a, b in runs])
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), piece.column("t"), pa.array(out, SPAN_TYPE)], ["doc_id", "text", "spans"]
            )


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of ``repeats``."""

    def run(batches):
        for batch in batches:
            data, off = column_bytes(batch.column("text"))
            raw = memoryview(data.tobytes())
            size, removed, count, sha = np.diff(off), [], [], []
            for at, n, spans in zip(off[:-1].tolist(), size.tolist(), batch.column("spans").to_pylist(), strict=True):
                h, last = hashlib.sha256(), 0
                for s in spans:
                    h.update(raw[at + last : at + s["first"]])
                    last = s["end"]
                h.update(raw[at + last : at + n])
                removed.append(sum(s["end"] - s["first"] for s in spans))
                count.append(len(spans))
                sha.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


def brute_force(docs: list[tuple], length: int = LENGTH) -> list[tuple]:
    """For tests: the digest by a table of all windows."""
    seen: dict[bytes, int] = {}
    raws = [(i, (t or "").encode()) for i, t in docs]
    for _, b in raws:
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for name, b in raws:
        cover = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                cover[i : i + length] = True
        kept = bytes(x for x, c in zip(b, cover[:-1].tolist(), strict=True) if not c)
        n_spans = int((cover[:-1] & ~np.append(False, cover[:-1])[: len(b)]).sum()) if len(b) else 0
        out.append((name, len(b), int(cover.sum()), n_spans, hashlib.sha256(kept).hexdigest()))
    return out
