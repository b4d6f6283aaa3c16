"""Language identification by rank-order n-gram profiles.

A language's profile is its ``profile_size`` most frequent letter n-grams (1 to
3 letters, words padded with blanks) over all training texts.  A document's own
most frequent n-grams are ranked the same way; its distance to a language is the
sum of ``|rank in document - rank in profile|``, with ``profile_size`` for an
n-gram that the profile lacks ("out of place").  The nearest language wins.

An n-gram of up to three code points packs into 63 bits, so no hashing takes
place.  Counting is done on arrays over many documents at once.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces

PROFILE_SIZE = 300
MAX_N = 3
BITS = 21
PAD = 32  # blank before and after each word
RUN = 1 << 20  # letters handled at once; a longer text is counted in such parts
_LETTER: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _LETTER


def grams(texts: list[str], max_n: int = MAX_N, group: np.ndarray | None = None):
    """(row, gram, count) of the n-grams of some texts, sorted by row and gram.

    With ``group``, the texts of one group number count as one row.  Code points
    are numbered within the call, so row and n-gram share one integer key that
    sorts fast; the result holds true code points again.
    """
    empty = np.zeros(0, np.int64)
    lower = [t.lower() for t in texts]
    points = np.frombuffer("\n".join(lower).encode("utf-32-le", "replace"), np.uint32)
    if not len(points):
        return empty, empty, empty
    lens = np.fromiter(map(len, lower), np.int64, len(lower))
    # Each text ends with a separator, which also pads the next one.
    text = np.repeat(np.arange(len(lower)), np.append(lens[:-1] + 1, lens[-1:]))
    seen = np.zeros(sys.maxunicode + 1, bool)
    seen[points] = True
    alphabet = np.flatnonzero(seen & letters())
    number = np.ones(sys.maxunicode + 1, np.int32)  # 1: blank
    number[alphabet] = np.arange(2, len(alphabet) + 2)
    bits = int(len(alphabet) + 2).bit_length()
    rows = text if group is None else np.asarray(group, np.int64)[text]
    room = bits * max_n + int(rows.max()).bit_length()
    if room > 63 and len(texts) > 1 and group is None:
        half = len(texts) // 2
        one, two = grams(texts[:half], max_n), grams(texts[half:], max_n)
        return np.concatenate([one[0], two[0] + half]), *(
            np.concatenate([x, y]) for x, y in zip(one[1:], two[1:], strict=True)
        )
    code = number[points]
    blank = code == 1
    keep = ~blank | np.append(True, ~blank[:-1])  # of several blanks the first
    code, rows = code[keep].astype(np.int64), rows[keep]
    if code[0] != 1:
        code, rows = np.append(1, code), np.append(rows[0], rows)
    if code[-1] != 1:
        code, rows = np.append(code, 1), np.append(rows, rows[-1])
    blank = code == 1
    # A blank belongs to the letter beside it, also where that is the next text's.
    key_row = rows << (bits * max_n)
    keys = []
    solid = ~blank
    keys.append((key_row | code)[solid])
    if max_n > 1:
        two = (code[:-1] << bits) | code[1:]
        own = np.where(blank[:-1], key_row[1:], key_row[:-1])
        keys.append(own | two)  # of two neighbours one is a letter
        for n in range(3, max_n + 1):
            m = len(code) - n + 1
            if m <= 0:
                break
            longer = (two[:m] << bits) | code[n - 1 :]
            inside = np.ones(m, bool)
            for j in range(1, n - 1):
                inside &= solid[j : j + m]
            keys.append((key_row[1 : m + 1] | longer)[inside])
            two = longer
    key = np.concatenate(keys)
    if not len(key):
        return empty, empty, empty
    key.sort()
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    count = np.diff(np.append(at, len(key)))
    key = key[at]
    out_row = key >> (bits * max_n)
    packed = key & ((1 << (bits * max_n)) - 1)
    point = np.concatenate([[0, PAD], alphabet])  # number to code point
    gram = np.zeros(len(packed), np.int64)
    for j in range(max_n):
        gram |= point[(packed >> (bits * j)) & ((1 << bits) - 1)] << (BITS * j)
    return out_row, gram, count


def _parts(text: str):
    """A text in parts of about ``RUN`` characters, cut behind a word where there is one."""
    at = 0
    while len(text) - at > RUN:
        to = text.rfind(" ", at, at + RUN)
        to = at + RUN if to <= at else to
        yield text[at:to]
        at = to
    yield text[at:]


def counted(texts: list[str], max_n: int = MAX_N):
    """``grams`` for texts of any length in bounded memory."""
    if sum(map(len, texts)) <= 2 * RUN:
        return grams(texts, max_n)
    rows, found, times = [], [], []
    for i, text in enumerate(texts):
        g_all = c_all = np.zeros(0, np.int64)
        for part in _parts(text):
            _, g, c = grams([part], max_n)
            merged, back = np.unique(np.concatenate([g_all, g]), return_inverse=True)
            c_all = np.bincount(back, np.concatenate([c_all, c]), len(merged)).astype(np.int64)
            g_all = merged
        rows.append(np.full(len(g_all), i))
        found.append(g_all)
        times.append(c_all)
    return np.concatenate(rows), np.concatenate(found), np.concatenate(times)


def gram_counts(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", max_n: int = MAX_N) -> DataFrame:
    """(lang, gram, n): n-gram counts by language over all rows with a language and a text."""

    def run(batches):
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        waiting = 0

        def flush():
            for lang, (g, c) in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(g), pa.string()), pa.array(g), pa.array(c)], ["lang", "gram", "n"]
                )

        for batch in batches:
            for piece in pieces(batch, "t"):
                langs, texts = piece.column("l").to_pylist(), piece.column("t").to_pylist()
                names = sorted(set(langs))
                group = np.array([names.index(x) for x in langs])
                if sum(map(len, texts)) <= 2 * RUN and len(names) < 1000:
                    row, gram, times = grams(texts, max_n, group)
                    found = [(gram[row == j], times[row == j]) for j in range(len(names))]
                else:
                    found = [counted([t], max_n)[1:] for t in texts]
                    names = langs
                for lang, (g, c) in zip(names, found, strict=True):
                    if lang in held:
                        g, c = np.concatenate([held[lang][0], g]), np.concatenate([held[lang][1], c])
                    merged, back = np.unique(g, return_inverse=True)
                    held[lang] = merged, np.bincount(back, c, len(merged)).astype(np.int64)
                waiting = sum(len(g) for g, _ in held.values())
                if waiting > 2_000_000:
                    yield from flush()
                    held.clear()
        yield from flush()

    src = labelled.select(labelled[lang_col].cast("string").alias("l"), labelled[text_col].alias("t"))
    src = src.where("l is not null and t is not null")
    parts = src.mapInArrow(run, "lang string, gram long, n long")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(
    labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", profile_size: int = PROFILE_SIZE
) -> dict[str, list[int]]:
    """Profiles: language to its n-grams, most frequent first, ties by n-gram.

    All rows count.  Only the profiles, ``profile_size`` numbers for each
    language there is, come to the driver.  Rows with a null language or text
    teach nothing; a language without letters gets no profile.
    """
    counts = gram_counts(labelled, lang_col, text_col)
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= profile_size)
    profiles: dict[str, list[int]] = {}
    for row in top.orderBy("lang", "rank").select("lang", "gram").collect():
        profiles.setdefault(row["lang"], []).append(row["gram"])
    return profiles


def distances(texts: list[str], profiles: dict[str, list[int]], size: int = PROFILE_SIZE):
    """(distance of each text to each language, number of ranked n-grams of each text)."""
    langs = sorted(profiles)
    known = np.unique(np.array([g for p in profiles.values() for g in p], np.int64))
    rank = np.full((len(known) + 1, len(langs)), -1, np.int64)
    for j, lang in enumerate(langs):
        rank[np.searchsorted(known, profiles[lang]), j] = np.arange(len(profiles[lang]))
    r, g, c = counted(texts)
    # Most frequent first, ties by n-gram: row, count and place in one key.
    most, span = int(c.max(initial=0)), max(len(r), 1).bit_length()
    if len(texts).bit_length() + most.bit_length() + span <= 63:
        key = (((r << most.bit_length()) | (most - c)) << span) | np.arange(len(r))
        key.sort()
        order = key & ((1 << span) - 1)
    else:
        order = np.lexsort((g, -c, r))
    r, g = r[order], g[order]
    first = np.searchsorted(r, np.arange(len(texts)))
    place = np.arange(len(r)) - first[r]
    top = place < size
    r, g, place = r[top], g[top], place[top]
    at = np.minimum(np.searchsorted(known, g), max(len(known) - 1, 0))
    at = np.where(known[at] == g, at, len(known)) if len(known) else np.zeros(len(g), np.int64)
    held = rank[at]
    apart = np.where(held >= 0, np.minimum(np.abs(held - place[:, None]), size), size)
    total = np.stack(
        [np.bincount(r, apart[:, j], len(texts)) for j in range(len(langs))], 1
    ).astype(np.int64)
    return total, np.bincount(r, minlength=len(texts))


def predict(
    docs: DataFrame,
    profiles: dict[str, list[int]],
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = PROFILE_SIZE,
) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text; one row per input row.

    ``score`` is 1 less the nearest distance as a share of the largest possible
    one.  A null text, or one without a letter, is ``und`` with score 0, and so is
    every text if there are no profiles.  Equal distances: the language that sorts
    first.  Only the text is read; other columns, whatever their names, are not.
    """
    langs = sorted(profiles)

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "t"):
                texts = [x or "" for x in piece.column("t").to_pylist()]
                if langs:
                    far, n = distances(texts, profiles, size)
                    best = far.argmin(1)
                    score = 1 - far[np.arange(len(texts)), best] / np.maximum(n * size, 1)
                else:
                    best, n, score = np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts))
                named = [langs[b] if k else "und" for b, k in zip(best.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("i"), pa.array(named, pa.string()), pa.array(np.where(n > 0, score, 0.0))],
                    ["doc_id", "lang_pred", "score"],
                )

    src = docs.select(docs[id_col].alias("i"), docs[text_col].alias("t"))
    kind = src.schema["i"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows that profiles may learn from: crc32 of the id as text, mod 3, is not 1."""
    return docs.where(F.coalesce(F.crc32(docs["doc_id"].cast("string")) % 3, F.lit(0)) != 1)
