"""Byte-level BPE by speculation and verification.

A text is cut into words by the tokenizer's own pattern.  Words seen before come
from a bounded cache.  New words are handled together on arrays:

1. *Speculate*: greedy longest match over the vocabulary proposes tokens.
2. *Verify*: a proposal is the BPE result exactly if each token encodes to itself
   and no merge crosses the border of two neighbours.  For the pair (a, b) that
   is a test over the tokens on a's right edge and b's left edge: the merge of
   (x, y) crosses if it comes before x and y are used up inside a and b.
3. Only words with a failing pair are merged step by step.

Vocabularies are read from the tokenizer file; nothing is trained.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import BYTE_CODES, U64, mix, pieces, powers

NONE = np.iinfo(np.int32).max
# Word pattern of byte-level BPE (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Characters whose class no library disputes: below U+0250, without the control
# characters that count as white space only in some libraries.
PLAIN = regex.compile("[\t-\r -\x7e\xa0-ɏ]*")
WORD_BYTES = 2 << 20  # text whose new words are encoded together
CACHE_WORDS = 800_000


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in of each byte in vocabulary files."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class HashTable:
    """Open addressing over uint64 keys in arrays; ``get`` works on whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 4))))
        self.shift, self.size = U64(64 - bits), 1 << bits
        self.keys = np.zeros(self.size, U64)
        self.values = np.full(self.size, NONE, np.int64)
        for k, v in zip(keys.tolist(), values.tolist(), strict=True):
            at = k >> (64 - bits)
            while self.values[at] != NONE:
                at = (at + 1) & (self.size - 1)
            self.keys[at], self.values[at] = k, v

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = (keys >> self.shift).astype(np.int64)
        out = np.full(len(keys), NONE, np.int64)
        left = np.arange(len(keys))
        while len(left):
            held = self.values[at]
            same = (held != NONE) & (self.keys[at] == keys[left])
            out[left[same]] = held[same]
            more = (held != NONE) & ~same
            left, at = left[more], (at[more] + 1) & (self.size - 1)
        return out


class ByteBPE:
    """Encoder and decoder for one byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_alphabet()
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        as_bytes = lambda s: bytes(to_byte[c] for c in s)
        size = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        self.token = [b""] * size
        for s, i in vocab.items():
            self.token[i] = as_bytes(s)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for s, i in self.special.items():
            self.token[i] = s.encode()
        self.special_cut = (
            regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
            if self.special
            else None
        )
        self.pattern = regex.compile(PATTERN)
        self.byte_id = np.full(256, -1, np.int64)
        for s, i in vocab.items():
            if len(s) == 1:
                self.byte_id[to_byte[s]] = i
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.merge = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in enumerate(pairs)}
        self.merged = np.array([c for _, c in self.merge.values()], np.int64)
        left, right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        rank = np.full(size, -1, np.int64)
        for (a, b), (r, c) in self.merge.items():
            if rank[c] < 0:
                left[c], right[c], rank[c] = a, b, r
        self._edges(size, left, right, rank)
        keys = [mix(np.array([(a << 32) | b], U64))[0] for a, b in self.merge]
        self.pair_rank = HashTable(np.array(keys, U64), np.array([r for r, _ in self.merge.values()], np.int64))
        # Vocabulary by hash; a token that merging its own bytes does not give is left out.
        own = [i for s, i in vocab.items() if len(self.token[i]) and self._merge(self.token[i]) == [i]]
        lens = np.array([len(self.token[i]) for i in own])
        flat = np.frombuffer(b"".join(self.token[i] for i in own), np.uint8)
        self.longest = int(lens.max())
        pw = powers(self.longest + 1)
        at = np.concatenate([[0], np.cumsum(lens)[:-1]])
        within = np.arange(len(flat)) - np.repeat(at, lens)
        with np.errstate(over="ignore"):
            h = np.add.reduceat(BYTE_CODES[flat] * pw[within], at)
            self.by_hash = HashTable(mix(h + lens.astype(U64)), np.array(own, np.int64))
        self.lengths = np.unique(lens)[::-1]
        self.cache: dict[str, bytes] = {}
        self._library = None
        self.path = path

    def _edges(self, size, left, right, rank) -> None:
        """For each token, its right and left edge: tokens and when each is used up."""

        def spine(child):
            cols_t, cols_r = [np.arange(size)], [np.full(size, NONE, np.int64)]
            while True:
                t = cols_t[-1]
                nxt = np.where(t >= 0, child[t], -1)
                if (nxt < 0).all():
                    break
                cols_r.append(np.where(nxt >= 0, rank[t], -1))
                cols_t.append(nxt)
            return np.stack(cols_t, 1), np.stack(cols_r, 1)

        self.right_edge, self.right_used = spine(right)
        self.left_edge, self.left_used = spine(left)

    def _merge(self, word: bytes) -> list[int]:
        """Exact merging of one word, lowest rank first, leftmost first."""
        ids = [int(self.byte_id[b]) for b in word]
        merge = self.merge
        while len(ids) > 1:
            best = None
            for pair in zip(ids, ids[1:], strict=False):
                m = merge.get(pair)
                if m and (best is None or m[0] < best[0]):
                    best = (*m, pair)
            if best is None:
                break
            _, new, (a, b) = best
            out, i = [], 0
            while i < len(ids):
                if i + 1 < len(ids) and ids[i] == a and ids[i + 1] == b:
                    out.append(new)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def _merge_many(self, raw: list[bytes]) -> list[bytes]:
        """Exact merging of many words at once: each round applies, in every
        word, its lowest-ranked merge from left to right."""
        lens = np.array([len(w) for w in raw], np.int64)
        word = np.repeat(np.arange(len(raw)), lens)
        ids = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        done_word, done_ids = [], []
        while len(ids):
            a = np.flatnonzero(word[1:] == word[:-1])
            rank = np.full(len(ids), NONE, np.int64)
            rank[a] = self.pair_rank.get(mix((ids[a].astype(U64) << U64(32)) | ids[a + 1].astype(U64)))
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            low = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(ids)))
            best = np.repeat(low, size)
            over = best == NONE
            done_word.append(word[over])
            done_ids.append(ids[over])
            hit = np.flatnonzero((rank == best) & ~over)
            # Of hits side by side (as in "aaa") every second one would overlap.
            head = np.append(True, (np.diff(hit) != 1) | (word[hit[1:]] != word[hit[:-1]])) if len(hit) else []
            at = np.flatnonzero(head)
            nth = np.arange(len(hit)) - np.repeat(at, np.diff(np.append(at, len(hit))))
            hit = hit[nth % 2 == 0]
            ids[hit] = self.merged[rank[hit]]
            keep = ~over
            keep[hit + 1] = False
            word, ids = word[keep], ids[keep]
        word, ids = np.concatenate(done_word), np.concatenate(done_ids)
        order = np.argsort(word, kind="stable")
        packed = ids[order].astype("<u4").tobytes()
        at = (np.searchsorted(word[order], np.arange(len(raw) + 1)) * 4).tolist()
        return [packed[x:y] for x, y in zip(at, at[1:], strict=False)]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether no merge crosses the border of each pair of tokens."""
        ok = np.ones(len(a), bool)
        for d in range(self.right_edge.shape[1]):
            rows = np.flatnonzero(self.right_edge[a, d] >= 0)
            if not len(rows):
                break
            for e in range(self.left_edge.shape[1]):
                rows = rows[self.left_edge[b[rows], e] >= 0]
                if not len(rows):
                    break
                x, y = self.right_edge[a[rows], d], self.left_edge[b[rows], e]
                r = self.pair_rank.get(mix((x.astype(U64) << U64(32)) | y.astype(U64)))
                # On equal ranks the leftmost pair merges first.
                bad = (r != NONE) & (r < self.right_used[a[rows], d]) & (r <= self.left_used[b[rows], e])
                ok[rows[bad]] = False
        return ok

    def _new_words(self, new: list[str]) -> None:
        """Encode words together and put them in the cache."""
        raw = [w.encode() for w in new]
        lens = np.array([len(w) for w in raw], np.int64)
        ends = np.cumsum(lens)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        n = len(flat)
        # Prefix hashes give the hash of any stretch of at most `longest` bytes.
        at, word = ends - lens, np.arange(len(raw))
        got_word, got_id, got_at = [], [], []
        pw = powers(self.longest + 1)
        code = BYTE_CODES[flat]
        while len(word):
            room = ends[word] - at
            h = np.zeros(len(word), U64)
            take, tok = np.zeros(len(word), np.int64), np.full(len(word), -1, np.int64)
            with np.errstate(over="ignore"):
                for size in range(1, min(int(room.max()), self.longest) + 1):
                    rows = np.flatnonzero(room >= size)
                    h[rows] += code[at[rows] + size - 1] * pw[size - 1]
                    found = self.by_hash.get(mix(h[rows] + U64(size)))
                    hit = found != NONE
                    take[rows[hit]], tok[rows[hit]] = size, found[hit]
            got_word.append(word)
            got_id.append(tok)
            got_at.append(at)
            at = at + take
            more = at < ends[word]
            at, word = at[more], word[more]
        if n == 0:
            return
        w, t, p = map(np.concatenate, (got_word, got_id, got_at))
        order = np.argsort(p, kind="stable")
        w, t = w[order], t[order]
        pair = np.flatnonzero(w[1:] == w[:-1])
        code_pair, back = np.unique((t[pair] << 32) | t[pair + 1], return_inverse=True)
        good = self.compatible(code_pair >> 32, code_pair & 0xFFFFFFFF)[back]
        failed = np.zeros(len(raw), bool)
        failed[w[pair[~good]]] = True
        packed = t.astype("<u4").tobytes()
        at = (np.searchsorted(w, np.arange(len(raw) + 1)) * 4).tolist()
        self.cache.update(zip(new, (packed[x:y] for x, y in zip(at, at[1:], strict=False)), strict=True))
        again = np.flatnonzero(failed).tolist()
        if again:
            exact = self._merge_many([raw[i] for i in again])
            self.cache.update(zip((new[i] for i in again), exact, strict=True))

    def _words(self, text: str) -> list[str]:
        if PLAIN.fullmatch(text):
            return self.pattern.findall(text)
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path).pre_tokenizer
        # The library's own split, for characters that libraries may class differently.
        cut = self._library.pre_tokenize_str(text)
        return [text[a:b] for _, (a, b) in cut]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Token ids of each text as little-endian unsigned 32-bit integers."""
        split: list[list] = []
        mixed: set[int] = set()
        for text in texts:
            parts = self.special_cut.split(text) if self.special_cut and "<" in text else [text]
            words: list = []
            for part in parts:
                if part in self.special:
                    words.append(self.special[part])
                    mixed.add(len(split))
                elif part:
                    words.extend(self._words(part))
            split.append(words)
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        new: set = set()
        for words in split:
            new.update(words)
        new.difference_update(self.cache)
        if mixed:
            new = {w for w in new if type(w) is str}
        if new:
            self._new_words(sorted(new))
        cache = self.cache
        return [
            b"".join([cache[w] if type(w) is str else np.uint32(w).tobytes() for w in words])
            if i in mixed
            else b"".join(map(cache.__getitem__, words))
            for i, words in enumerate(split)
        ]

    def decode(self, ids: bytes) -> str:
        token = self.token
        return b"".join([token[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


_LOADED: dict[str, ByteBPE] = {}


def tokenizer(path: str) -> ByteBPE:
    """One encoder per worker process."""
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary): little-endian unsigned 32-bit token ids of each whole text.

    One row per input row, repeated rows included.  A null or empty text has no
    ids (empty binary); a null id stays null.  Other columns are ignored.  The
    vocabulary's own special strings in a text become their special ids.
    """

    def run(batches):
        t = tokenizer(path)
        for batch in batches:
            for part in pieces(batch, "t", WORD_BYTES):
                texts = [x or "" for x in part.column("t").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("i"), pa.array(t.encode_many(texts), pa.binary())], ["doc_id", "ids"]
                )

    src = docs.select(docs[id_col].alias("i"), docs[text_col].alias("t"))
    return src.mapInArrow(run, f"doc_id {src.schema['i'].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) to (doc_id, text); invalid UTF-8 becomes U+FFFD; null ids give an empty text."""

    def run(batches):
        t = tokenizer(path)
        for batch in batches:
            out = [t.decode(x or b"") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def round_trip_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, n_tokens, text): the ids of each text and the text decoded from them.  Rows as in ``encode``."""

    def run(batches):
        t = tokenizer(path)
        for batch in batches:
            for part in pieces(batch, "t", WORD_BYTES):
                ids = t.encode_many([x or "" for x in part.column("t").to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("i"),
                        pa.array(ids, pa.binary()),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array(list(map(t.decode, ids)), pa.string()),
                    ],
                    ["doc_id", "ids", "n_tokens", "text"],
                )

    src = docs.select(docs[id_col].alias("i"), docs[text_col].alias("t"))
    kind = src.schema["i"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, ids binary, n_tokens long, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digest of encoding and decoding in one pass over each text.

    Columns: doc_id, n_tokens, ids_sha256, decoded_sha256.  Rows as in ``encode``.
    """

    def run(batches):
        t = tokenizer(path)
        for batch in batches:
            for part in pieces(batch, "t", WORD_BYTES):
                ids = t.encode_many([x or "" for x in part.column("t").to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("i"),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                        pa.array([hashlib.sha256(t.decode(x).encode()).hexdigest() for x in ids]),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    src = docs.select(docs[id_col].alias("i"), docs[text_col].alias("t"))
    kind = src.schema["i"].dataType.simpleString()
    return src.mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
