import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from riskloom.llm import bpe, token_files

from .conftest import pairs, rows

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def odd_texts():
    rnd = random.Random(1)
    out = [
        "", "  a  b\n\n c", "<|endoftext|>x<|endoftext|>", "a" * 50, "ab" * 300, "aaab" * 7, "日本語 テキスト привет мир 😀 é",
        "it's we'll THEY'RE 12345 $$$$ ----", "\x1c\x85\xa0 x", "İstanbul ΣΑΣ", "x\ty\r\n z", " ", "<|startoftext|> y", "² ¼ ½a",
    ]
    out += ["".join(rnd.choice("abcdefgh ethinros'1.\n\t") for _ in range(rnd.randint(1, 80))) for _ in range(800)]
    out += ["".join(rnd.choice("ab ") for _ in range(rnd.randint(1, 40))) for _ in range(300)]
    return out


def test_byte_bpe_equals_library(odd_texts):
    lib, own = Tokenizer.from_file(BYTE), bpe.ByteBPE(BYTE)
    got = own.encode_many(odd_texts)
    for text, ids in zip(odd_texts, got, strict=True):
        want = lib.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert own.decode(ids) == lib.decode(want, skip_special_tokens=False)


def test_pair_check_agrees_with_exact_merging():
    own = bpe.ByteBPE(BYTE)
    rnd = np.random.default_rng(3)
    a, b = rnd.integers(0, 3000, 4000), rnd.integers(0, 3000, 4000)
    good = own.compatible(a, b)
    for x, y, ok in zip(a.tolist(), b.tolist(), good.tolist(), strict=True):
        if own._merge(own.token[x]) == [x] and own._merge(own.token[y]) == [y]:
            assert (own._merge(own.token[x] + own.token[y]) == [x, y]) == ok


def test_bpe_over_odd_rows(odd_docs, no_docs):
    lib = Tokenizer.from_file(BYTE)
    want = []
    for i, t in pairs(odd_docs):
        ids = np.array(lib.encode(t or "", add_special_tokens=False).ids, "<u4")
        back = lib.decode(ids.tolist(), skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert rows(bpe.round_trip(odd_docs, BYTE)) == sorted(want, key=repr)
    assert bpe.decode(bpe.encode(odd_docs, BYTE), BYTE).count() == odd_docs.count()
    assert bpe.round_trip(no_docs, BYTE).count() == 0


def test_word_encoder_equals_library(odd_texts):
    lib, own = Tokenizer.from_file(WORD), token_files.WordEncoder(WORD)
    got = own.encode_many(odd_texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [lib.encode(t, add_special_tokens=False).ids for t in odd_texts]


@pytest.mark.parametrize("n", [0, 1, 5, 16_383, 16_384, 16_385, 70_000])
def test_segment_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 49_408).astype("<u4")
    seg = token_files.Segment(token_files.encode_segment(np.array([7]), np.array([n]), ids))
    assert np.array_equal(seg.ids(), ids)
    assert np.array_equal(seg.ids(1, 2), ids[16_384 : 2 * 16_384])  # any block alone


def test_damage_is_found():
    ids = np.arange(40_000, dtype="<u4") % 900
    raw = bytearray(token_files.encode_segment(np.array([1]), np.array([len(ids)]), ids))
    raw[-5_000] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        token_files.Segment(bytes(raw)).ids()


def test_token_files_over_odd_rows(odd_docs, no_docs):
    lib = Tokenizer.from_file(WORD)
    got = sorted(map(tuple, token_files.tokens_digest(odd_docs, WORD).collect()), key=lambda r: r[1])
    at, want = 0, []
    key = lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode())
    for i, t in sorted(pairs(odd_docs), key=key):
        ids = np.array(lib.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    assert token_files.tokens_digest(no_docs, WORD).count() == 0
