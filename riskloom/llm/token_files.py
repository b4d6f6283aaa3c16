"""Token files: word BPE ids in ascending document order, entropy-coded.

Encoding uses an asymmetric numeral system with static frequencies (range
variant).  One *segment* holds whole documents, about ``SEGMENT_TOKENS`` ids, and
one frequency table counted over all of them.  Its ids are cut into blocks of
``BLOCK`` ids; a block is coded by ``LANES`` interleaved states and shares
nothing with other blocks but the table.  The block directory is a list of
checkpoints: stream offset, lane states and a CRC-32 of the block's ids, so any
block decodes on its own and damage is found.  Array operations run over all
blocks and lanes of a segment at once.

Layout of a segment (little endian): header ``<8sIIQQQ`` (magic, block length,
lanes, documents, ids, words), then symbols u4[k] preceded by k as u8,
frequencies u4[k], document ids i8, document lengths u4, per block stream offset
u8 and CRC-32 u4, states u8[blocks][lanes], words u4.  Segments are rows
(part, seq, n_docs, n_tokens, payload) of a Parquet folder, which any store that
Spark reaches can hold.  Order: part, then seq, then place in the segment.
"""

from __future__ import annotations

import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, pieces, scratch_dir

MAGIC = b"RLTOK01\0"
HEADER = "<8sIIQQQ"
BLOCK, LANES, SCALE = 16_384, 32, 20
LOW = U64(1 << 31)
SEGMENT_TOKENS = 2_000_000
END_ID = 2
WORD_BYTES = 8 << 20  # text whose new words are encoded together
CACHE_WORDS = 600_000  # of a generation; two are held
DEAL_CHARS = 64
NO_ID = -(1 << 63)  # stands for a null document id


# --------------------------------------------------------------------------
# tokenizer
# --------------------------------------------------------------------------
class WordEncoder:
    """The library's encoding, with a bounded cache of stretches between blanks.

    The tokenizer's pattern matches no white space, so no token spans it and the
    ids of a text are those of its stretches in turn.  Each different stretch of some
    texts is looked up once; their ids are then gathered as arrays.  New stretches are
    cut by the pattern here, so the library gets words and blanks and need not
    normalise.  Texts with characters whose normal form, case or class libraries may see
    differently, or with special strings, go to the library whole.
    """

    # The tokenizer file's own word pattern (fixed value), and what is left of it for lower-case ASCII.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+"
    PLAIN = regex.compile("[\t-\r -\x7e\xa1-įı-ɏ]*")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.library, self.by_blanks, self.ascii = (Tokenizer.from_file(path) for _ in range(3))
        for tokenizer in (self.library, self.by_blanks, self.ascii):
            tokenizer.no_truncation()
            tokenizer.no_padding()
        self.by_blanks.normalizer = self.ascii.normalizer = normalizers.Sequence([])
        blanks = pre_tokenizers.WhitespaceSplit()
        self.by_blanks.pre_tokenizer = pre_tokenizers.Sequence(
            [blanks, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.ascii.pre_tokenizer = blanks  # printable ASCII stands for itself at byte level
        # Ids that end a match of the pattern: they tell the matches of a line apart.
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for s, i in vocab.items() if s.endswith("</w>")]] = True
        self.pattern = regex.compile(self.PATTERN + "|\n")
        self.ascii_pattern = re.compile(self.ASCII_PATTERN + "|\n")
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ids(self, text: str, tokenizer=None) -> np.ndarray:
        got = (tokenizer or self.library).encode_batch_fast([text], add_special_tokens=False)
        return np.array(got[0].ids, "<u4")

    def _learn(self, new: list[str], tokenizer, pattern) -> None:
        for at in range(0, len(new), 4_000):
            part = new[at : at + 4_000]
            words = pattern.findall("\n".join(part) + "\n")
            ids = self._ids(" ".join(words), tokenizer)
            stops = np.append(0, np.flatnonzero(self.ends[ids]) + 1)
            lines = np.array([i for i, w in enumerate(words) if w == "\n"])
            upto = np.append(0, lines - np.arange(len(lines)))  # words before each line's end
            if len(lines) == len(part) and len(stops) == upto[-1] + 1 and stops[-1] == len(ids):
                raw, cut = ids.tobytes(), (stops[upto] * 4).tolist()
                self.cache.update(zip(part, (raw[x:y] for x, y in zip(cut, cut[1:], strict=False)), strict=True))
            else:
                self.cache.update((x, self._ids(x).tobytes()) for x in part)

    def _bodies(self, stretches: list[str]) -> list[bytes]:
        """The ids of each stretch; those not seen for a generation are let go."""
        if len(self.cache) > CACHE_WORDS:
            self.older, self.cache = self.cache, {}
        new = set(stretches).difference(self.cache)
        known = new.intersection(self.older)
        self.cache.update((x, self.older[x]) for x in known)
        new = sorted(new - known)
        self._learn([x for x in new if x.isascii()], self.ascii, self.ascii_pattern)
        self._learn([x for x in new if not x.isascii()], self.by_blanks, self.pattern)
        return list(map(self.cache.__getitem__, stretches))

    def encode_many(self, texts: list[str]) -> list[bytes]:
        plain = ["<|" not in t and self.PLAIN.fullmatch(t) is not None for t in texts]
        lower = [t.lower() for t, p in zip(texts, plain, strict=True) if p]
        split = pc.utf8_split_whitespace(pa.array(lower, pa.large_string()))
        words = split.flatten().dictionary_encode()
        # One text of all stretches, which hold no line breaks, becomes Python strings quickest.
        one = pa.ListArray.from_arrays([0, len(words.dictionary)], words.dictionary)
        joined = pc.binary_join(one, pa.scalar("\n", pa.large_string()))
        bodies = self._bodies(joined[0].as_py().split("\n") if len(words.dictionary) else [])
        size = np.fromiter(map(len, bodies), np.int64, len(bodies)) // 4
        ids = np.frombuffer(b"".join(bodies), "<u4")
        which = words.indices.to_numpy()
        n = size[which]
        ends = np.cumsum(n)
        first = (np.cumsum(size) - size)[which] - (ends - n)
        raw = ids[np.repeat(first, n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        upto = (np.append(0, ends)[split.offsets.to_numpy()] * 4).tolist()
        done = (raw[a:b] for a, b in zip(upto, upto[1:], strict=False))
        return [next(done) if p else self._ids(t).tobytes() for t, p in zip(texts, plain, strict=True)]


_LOADED: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    if path not in _LOADED:
        _LOADED[path] = WordEncoder(path)
    return _LOADED[path]


# --------------------------------------------------------------------------
# coder
# --------------------------------------------------------------------------
def frequencies(counts: np.ndarray) -> np.ndarray:
    """Scale counts to a sum of ``2**SCALE`` with every one at least 1."""
    total = 1 << SCALE
    f = np.maximum(1, counts * (total - len(counts)) // max(int(counts.sum()), 1)).astype(np.int64)
    f[np.argmax(f)] += total - f.sum()  # the floor leaves a rest, or ones took a little more
    return f


def encode_segment(doc_ids: np.ndarray, lens: np.ndarray, ids: np.ndarray) -> bytes:
    n = len(ids)
    symbols, place, counts = np.unique(ids, return_inverse=True, return_counts=True)
    freq = frequencies(counts) if n else np.zeros(0, np.int64)
    start = np.cumsum(freq) - freq
    blocks = -(-n // BLOCK)
    steps = BLOCK // LANES
    padded = np.zeros(blocks * BLOCK, np.int64)
    padded[:n] = place
    valid = (np.arange(blocks * BLOCK) < n).reshape(blocks, steps, LANES)
    padded = padded.reshape(blocks, steps, LANES)
    f_all, c_all = freq.astype(U64), start.astype(U64)
    x = np.full((blocks, LANES), LOW, U64)
    out = np.zeros((blocks, steps, LANES), np.uint32)
    sent = np.zeros((blocks, steps, LANES), bool)
    for s in range(steps - 1, -1, -1) if n else ():
        sym, ok = padded[:, s], valid[:, s]
        f, c = f_all[sym], c_all[sym]
        full = ok & (x >= f << U64(63 - SCALE))
        out[:, s], sent[:, s] = x.astype(np.uint32), full
        y = np.where(full, x >> U64(32), x)
        q = y // f
        x = np.where(ok, (q << U64(SCALE)) + (y - q * f) + c, x)
    words = out[sent]
    at = np.concatenate([[0], np.cumsum(sent.reshape(blocks, -1).sum(1))[:-1]]) if blocks else np.zeros(0)
    raw = ids.astype("<u4")
    crc = [zlib.crc32(raw[b * BLOCK : (b + 1) * BLOCK].tobytes()) for b in range(blocks)]
    return b"".join(
        [
            struct.pack(HEADER, MAGIC, BLOCK, LANES, len(doc_ids), n, len(words)),
            struct.pack("<Q", len(symbols)),
            symbols.astype("<u4").tobytes(),
            freq.astype("<u4").tobytes(),
            doc_ids.astype("<i8").tobytes(),
            lens.astype("<u4").tobytes(),
            at.astype("<u8").tobytes(),
            np.array(crc, "<u4").tobytes(),
            x.astype("<u8").tobytes(),
            words.astype("<u4").tobytes(),
        ]
    )


class Segment:
    """A segment opened for reading; ``ids()`` decodes all blocks or a range of them."""

    def __init__(self, payload: bytes):
        magic, self.block, self.lanes, docs, self.n, words = struct.unpack_from(HEADER, payload)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        at = struct.calcsize(HEADER)
        (k,) = struct.unpack_from("<Q", payload, at)
        at += 8
        self.blocks = -(-self.n // self.block)

        def take(kind, count):
            nonlocal at
            got = np.frombuffer(payload, kind, count, at)
            at += got.nbytes
            return got

        self.symbols, self.freq = take("<u4", k), take("<u4", k).astype(U64)
        self.doc_ids, self.lens = take("<i8", docs), take("<u4", docs).astype(np.int64)
        self.at, self.crc = take("<u8", self.blocks).astype(np.int64), take("<u4", self.blocks)
        self.states = take("<u8", self.blocks * self.lanes).reshape(self.blocks, self.lanes)
        self.words = take("<u4", words)

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        last = self.blocks if last is None else min(last, self.blocks)
        nb = last - first
        if nb <= 0:
            return np.zeros(0, "<u4")
        start = np.cumsum(self.freq) - self.freq
        slot = np.repeat(np.arange(len(self.freq)), self.freq.astype(np.int64))
        steps = self.block // self.lanes
        x, at = self.states[first:last].astype(U64), self.at[first:last].copy()
        end = min(last * self.block, self.n) - first * self.block
        out = np.zeros((nb, steps, self.lanes), np.int64)
        ok_all = (np.arange(nb * self.block) < end).reshape(nb, steps, self.lanes)
        words = np.append(self.words, 0).astype(U64)
        low = U64((1 << SCALE) - 1)
        for s in range(steps):
            ok = ok_all[:, s]
            r = x & low
            sym = slot[r.astype(np.int64)]
            out[:, s] = sym
            y = self.freq[sym] * (x >> U64(SCALE)) + r - start[sym]
            short = ok & (y < LOW)
            nth = np.cumsum(short, 1)
            where = np.minimum(at[:, None] + nth - 1, len(words) - 1)
            y = np.where(short, (y << U64(32)) | words[np.maximum(where, 0)], y)
            x = np.where(ok, y, x)
            at += nth[:, -1]
        got = self.symbols[out.reshape(-1)[:end]].astype("<u4")
        for b in range(nb):
            part = got[b * self.block : (b + 1) * self.block]
            if zlib.crc32(part.tobytes()) != int(self.crc[first + b]):
                raise ValueError(f"block {first + b}: checksum does not match")
        return got


# --------------------------------------------------------------------------
# Spark
# --------------------------------------------------------------------------
SEGMENT_SCHEMA = "part int, seq int, n_docs long, n_tokens long, payload binary"


def write_tokens(docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text and write segments to ``path`` in ascending id order.

    The texts are dealt by range of id and ``DEAL_CHARS`` first characters, which agrees
    with the order by id and text, so each task writes its own stretch and different
    texts under one id fill many tasks.  Each document ends with id 2; a null or empty
    text is that id alone.  Null ids come first; rows with equal ids are ordered by
    text, so repeated rows are interchangeable.  Ids must be integers.  An empty table gives no segments.
    """

    def run(batches):
        enc = word_encoder(vocabulary)
        part, seq = TaskContext.get().partitionId(), 0
        end = np.uint32(END_ID).tobytes()
        names: list = []
        bodies: list[bytes] = []
        size = 0

        def flush():
            nonlocal seq, size
            raw = np.frombuffer(b"".join(bodies), "<u4")
            lens = np.array([len(b) // 4 for b in bodies], np.int64)
            payload = encode_segment(np.array(names, np.int64), lens, raw)
            row = [[part], [seq], [len(names)], [len(raw)], [payload]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            names.clear()
            bodies.clear()
            seq, size = seq + 1, 0
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(row, types, strict=True)],
                ["part", "seq", "n_docs", "n_tokens", "payload"],
            )

        for batch in batches:
            for piece in pieces(batch, "t", WORD_BYTES):
                got = enc.encode_many([x or "" for x in piece.column("t").to_pylist()])
                for name, body in zip(piece.column("i").to_pylist(), got, strict=True):
                    names.append(NO_ID if name is None else name)
                    bodies.append(body + end)
                    size += len(body) // 4 + 1
                    if size >= SEGMENT_TOKENS:
                        yield flush()
        if names:
            yield flush()

    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    src = docs.select(docs[id_col].cast("long").alias("i"), docs[text_col].alias("t"))
    dealt = src.repartitionByRange(n, F.col("i"), F.substring("t", 1, DEAL_CHARS)).sortWithinPartitions("i", "t")
    dealt.mapInArrow(run, SEGMENT_SCHEMA).write.option("compression", "uncompressed").parquet(path)


def open_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEGMENT_SCHEMA).parquet(path)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from decoded files.

    ``start`` counts the ids of all documents before it.  Only the segments'
    counts, one small row for each two million ids, are summed ahead: by part in
    the driver (as many rows as partitions were written), by segment inside a part.
    """
    files = open_tokens(spark, path)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    before, at = {}, 0
    for row in totals:
        before[row["part"]] = at
        at += row["n"]
    ahead = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    earlier = files.select("part", "seq", F.sum("n_tokens").over(ahead).alias("before"))

    def run(batches):
        for batch in batches:
            cols = batch.to_pydict()
            for part, skip, payload in zip(cols["part"], cols["before"], cols["payload"], strict=True):
                seg = Segment(payload)
                ids = memoryview(seg.ids().tobytes())
                ends = np.cumsum(seg.lens)
                starts = ends - seg.lens
                crc = [zlib.crc32(ids[a * 4 : b * 4]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                names = pa.array(seg.doc_ids, mask=seg.doc_ids == NO_ID)
                yield pa.RecordBatch.from_arrays(
                    [
                        names,
                        pa.array(starts + before[part] + (skip or 0)),
                        pa.array(seg.lens),
                        pa.array(crc, pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return (
        files.join(earlier, ["part", "seq"], "left")
        .select("part", "before", "payload")
        .mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
    )


def tokens_digest(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Write the token files of ``docs`` to the shared folder, then index them."""
    spark = docs.sparkSession
    path = scratch_dir(spark)
    write_tokens(docs, path, vocabulary)
    return token_index(spark, path)
