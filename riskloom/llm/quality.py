"""Quality score by a byte-level convolutional network, in numpy.

A text is read as bytes.  Each byte has a learned vector; learned filters of
``WIDTH`` bytes run over it every ``STRIDE`` bytes.  Overlapping chunks (512 bytes,
a new one every 256) cover the whole document; a chunk keeps each filter's
largest response.  The document's features are the largest and the mean response
over its chunks, and one logistic layer makes a probability of them.

Fitting uses a bounded sample of labelled rows (``SAMPLE_ROWS`` rows of at most
``SAMPLE_CHUNKS`` chunks each); scoring reads every byte of every document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_bytes, pieces

HALF, WIDTH, STRIDE = 256, 8, 4
DIM, FILTERS = 8, 32
AT_ONCE = 512  # half chunks convolved at once
SAMPLE_ROWS = 3_000
SAMPLE_CHUNKS = 16
EPOCHS, BATCH, RATE = 14, 64, 4e-3
THRESHOLD = 0.7


def halves(data: np.ndarray, offsets: np.ndarray):
    """Half chunks (with the bytes a filter needs beyond them) and their text numbers.

    Bytes beyond a text's end read as 0; an empty text has one half chunk of zeros.
    """
    size = np.diff(offsets)
    n = np.maximum(1, -(-size // HALF))
    row = np.repeat(np.arange(len(size)), n)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = (offsets[:-1][row] + nth * HALF)[:, None] + np.arange(HALF + WIDTH - STRIDE)
    inside = at < offsets[1:][row][:, None]
    if not len(data):
        return np.zeros(at.shape, np.uint8), row
    return np.where(inside, data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8), row


class ByteCNN:
    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        f4 = np.float32
        self.p = {
            "embed": rng.normal(0, 0.5, (256, DIM)).astype(f4),
            "filter": rng.normal(0, (WIDTH * DIM) ** -0.5, (WIDTH * DIM, FILTERS)).astype(f4),
            "bias": np.zeros(FILTERS, f4),
            "out": np.zeros(2 * FILTERS, f4),
            "shift": np.zeros(1, f4),
        }

    def responses(self, blocks: np.ndarray, places: bool = False):
        """Largest response of each filter in each half chunk, and where it is."""
        p, taps = self.p, WIDTH // STRIDE
        # Each stride of bytes times all filter parts, then the parts are added up.
        parts = np.concatenate(
            [p["filter"][j * STRIDE * DIM : (j + 1) * STRIDE * DIM] for j in range(taps)], 1
        )
        steps = HALF // STRIDE
        top = np.empty((len(blocks), FILTERS), np.float32)
        where = np.empty((len(blocks), FILTERS), np.int64) if places else None
        for at in range(0, len(blocks), AT_ONCE):
            b = blocks[at : at + AT_ONCE]
            x = p["embed"][b].reshape(len(b) * (steps + taps - 1), STRIDE * DIM)
            y = (x @ parts).reshape(len(b), steps + taps - 1, taps * FILTERS)
            z = y[:, :steps, :FILTERS].copy()
            for j in range(1, taps):
                z += y[:, j : j + steps, j * FILTERS : (j + 1) * FILTERS]
            top[at : at + AT_ONCE] = z.max(1)
            if places:
                where[at : at + AT_ONCE] = z.argmax(1)
        return np.maximum(top + p["bias"], 0), where

    @staticmethod
    def pooled(top: np.ndarray, row: np.ndarray):
        """Features of each text: largest and mean response over its chunks."""
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        # A chunk is a half and the next one of the same text; the last half of a longer text ends the one before.
        same = np.append(row[1:] == row[:-1], False)
        alone = np.append(True, row[1:] != row[:-1]) & ~same
        nxt = np.minimum(np.arange(len(row)) + 1, len(row) - 1)
        chunk = np.where(same[:, None], np.maximum(top, top[nxt]), top)
        use = same | alone
        total = np.add.reduceat(np.where(use[:, None], chunk, 0).astype(np.float64), first, 0)
        count = np.add.reduceat(use.astype(np.int64), first)
        return np.concatenate([np.maximum.reduceat(top, first, 0), total / count[:, None]], 1), use, count, first

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if len(offsets) < 2:
            return np.zeros(0)
        blocks, row = halves(data, offsets)
        feats, *_ = self.pooled(self.responses(blocks)[0], row)
        logit = feats @ self.p["out"].astype(np.float64) + float(self.p["shift"][0])
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))

    def gradients(self, blocks: np.ndarray, row: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        top, where = self.responses(blocks, places=True)
        feats, use, count, first = self.pooled(top, row)
        logit = feats @ p["out"] + p["shift"][0]
        d = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - label) / len(label)
        g = {"out": feats.T @ d + 1e-4 * p["out"], "shift": np.array([d.sum()])}
        df = d[:, None] * p["out"]
        dtop = np.zeros_like(top, dtype=np.float64)
        # the largest response: to the first half that has it
        best = feats[row, :FILTERS] == top
        nth = np.cumsum(best, 0)
        before = np.where(first[:, None] > 0, nth[np.maximum(first - 1, 0)], 0)
        best &= (nth - before[row]) == 1
        dtop += np.where(best, df[row, :FILTERS], 0)
        # the mean over chunks: to the larger half of each chunk
        share = df[row, FILTERS:] / count[row][:, None] * use[:, None]
        same = np.append(row[1:] == row[:-1], False)
        nxt = np.minimum(np.arange(len(row)) + 1, len(row) - 1)
        later = same[:, None] & (top[nxt] > top)
        dtop += np.where(later, 0, share)
        dtop[1:] += np.where(later, share, 0)[:-1]
        dtop[top <= 0] = 0
        i, f = np.nonzero(dtop)
        v = dtop[i, f].astype(np.float32)
        window = blocks[i[:, None], where[i, f][:, None] * STRIDE + np.arange(WIDTH)]
        x = p["embed"][window].reshape(len(i), WIDTH * DIM)
        gf = np.zeros_like(p["filter"])
        ge = np.zeros_like(p["embed"])
        for k in range(FILTERS):
            own = f == k
            gf[:, k] = x[own].T @ v[own]
        back = (v[:, None] * p["filter"][:, f].T).reshape(-1, DIM)
        flat = window.reshape(-1)
        for k in range(DIM):
            ge[:, k] = np.bincount(flat, back[:, k], 256)
        g |= {"filter": gf, "embed": ge, "bias": dtop.sum(0)}
        return g

    def fit(self, texts: list[bytes], label: np.ndarray, seed: int = 12) -> ByteCNN:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        share = float(np.clip(label.mean(), 0.01, 0.99))
        self.p["shift"][0] = np.log(share / (1 - share))
        self.p["out"][:] = rng.normal(0, 0.05, 2 * FILTERS)
        step, total = 0, EPOCHS * -(-len(texts) // BATCH)
        for _ in range(EPOCHS):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), BATCH):
                own = order[at : at + BATCH]
                off = np.concatenate([[0], np.cumsum([len(texts[i]) for i in own])])
                blocks, row = halves(np.frombuffer(b"".join(texts[i] for i in own), np.uint8), off)
                step += 1
                rate = RATE * min(1, 4 * (1 - step / (total + 1)))
                for k, v in self.gradients(blocks, row, label[own]).items():
                    v = v.astype(np.float32)
                    m[k] = 0.9 * m[k] + 0.1 * v
                    s[k] = 0.999 * s[k] + 0.001 * v * v
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
        return self


def sample_bytes(text: bytes) -> bytes:
    """A text for fitting: whole, or its bytes at evenly spaced chunks."""
    size, chunk = len(text), 2 * HALF
    if size <= SAMPLE_CHUNKS * chunk:
        return text
    at = [i * (size - chunk) // (SAMPLE_CHUNKS - 1) for i in range(SAMPLE_CHUNKS)]
    return b"".join(text[x : x + chunk] for x in at)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", rows: int = SAMPLE_ROWS) -> ByteCNN | None:
    """Fit on at most ``rows`` labelled documents, those whose ids hash lowest.

    ``docs`` (doc_id, text) and ``labels`` (doc_id, label) should hold training
    rows only.  Null labels and ids teach nothing; a null text counts as empty.
    Without any usable row the result is None.  The sample (at most 8 KiB a row)
    is the only thing that comes to the driver.
    """
    y = labels.select(F.col("doc_id").alias("k"), F.col(label_col).cast("int").alias("y"))
    y = y.where("k is not null and y is not null").orderBy(F.xxhash64("k"), "k", "y").limit(rows)
    text = docs.select(docs["doc_id"].alias("k"), docs["text"].alias("t"))

    def cut(batches):
        for batch in batches:
            data, off = column_bytes(batch.column("t"))
            raw = data.tobytes()
            out = [sample_bytes(raw[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("k").cast(pa.string()), pa.array(out, pa.binary()), batch.column("y")], ["k", "t", "y"]
            )

    got = text.join(F.broadcast(y), "k").select("k", "t", "y").mapInArrow(cut, "k string, t binary, y int").collect()
    got = sorted(((r["k"], bytes(r["t"]), r["y"]) for r in got), key=lambda r: (r[0], r[1], r[2]))[: 2 * rows]
    if not got:
        return None
    return ByteCNN().fit([r[1] for r in got], np.array([float(r[2] == 1) for r in got]))


def score(docs: DataFrame, model: ByteCNN | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text, one row per input row.

    A null text scores as an empty one.  Without a model every score is 0.5.
    Only the text is read.
    """

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "t"):
                data, off = column_bytes(piece.column("t"))
                s = model.score(data, off) if model else np.full(len(off) - 1, 0.5)
                yield pa.RecordBatch.from_arrays([piece.column("i"), pa.array(s)], ["doc_id", "score"])

    src = docs.select(docs[id_col].alias("i"), docs[text_col].alias("t"))
    return src.mapInArrow(run, f"doc_id {src.schema['i'].dataType.simpleString()}, score double")


def held_out() -> F.Column:
    """Whether a row is kept from training: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
