import collections

import numpy as np
import pytest

from riskloom.llm import langid, quality

from .conftest import rows

SF = "/root/testdata/sf0.01"


def brute_grams(text):
    out = collections.Counter()
    for w in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        w = f" {w} "
        for n in (1, 2, 3):
            for i in range(len(w) - n + 1):
                if w[i : i + n].strip():
                    out[w[i : i + n]] += 1
    return out


def unpacked(g):
    s = ""
    while g:
        s = chr(g & ((1 << langid.BITS) - 1)) + s
        g >>= langid.BITS
    return s


def test_grams_equal_brute_force():
    texts = ["", "a", "  ab c. d", "Éa İx b\n", "12", "日本 語x", "a b a", "x", "don't", "...", "end."]
    row, gram, count = langid.grams(texts)
    for i, t in enumerate(texts):
        got = {unpacked(int(g)): int(c) for g, c in zip(gram[row == i], count[row == i], strict=True)}
        assert got == dict(brute_grams(t)), t


def test_long_texts_count_alike(monkeypatch):
    texts = ["the quick brown fox " * 300, "x" * 500, "", "ab cd " * 99]
    whole = langid.grams(texts)
    monkeypatch.setattr(langid, "RUN", 700)
    parts = langid.counted(texts[:1] + texts[2:])
    keep = whole[0] != 1
    assert np.array_equal(parts[1], whole[1][keep]) and np.array_equal(parts[2], whole[2][keep])


def brute_predict(text, profiles, size):
    counts = brute_grams(text or "")
    code = lambda g: sum(ord(c) << (langid.BITS * (len(g) - 1 - i)) for i, c in enumerate(g))
    ranked = sorted(counts, key=lambda g: (-counts[g], code(g)))[:size]
    if not ranked:
        return "und", 0.0
    far = {
        lang: sum(min(abs(p.index(code(g)) - r), size) if code(g) in p else size for r, g in enumerate(ranked))
        for lang, p in profiles.items()
    }
    best = min(sorted(far), key=lambda x: far[x])
    return best, 1 - far[best] / (len(ranked) * size)


def test_prediction_equals_brute_force(spark, odd_docs, no_docs):
    profiles = langid.fit(odd_docs, profile_size=60)
    assert set(profiles) == {"en", "de", "ja"}
    got = rows(langid.predict(odd_docs, profiles, size=60).select("doc_id", "lang_pred", "score"))
    want = sorted([(r["doc_id"], *brute_predict(r["text"], profiles, 60)) for r in odd_docs.collect()], key=repr)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want])
    assert langid.fit(no_docs) == {}
    assert {r["lang_pred"] for r in langid.predict(odd_docs, {}).collect()} == {"und"}


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = langid.predict(docs, langid.fit(langid.training_rows(docs)))
    held = docs.subtract(langid.training_rows(docs)).join(out, "doc_id")
    assert held.count() > 200
    assert held.where("lang = lang_pred").count() / held.count() > 0.97


def test_gradients_match_differences():
    rng = np.random.default_rng(2)
    net = quality.ByteCNN()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.p["out"] = rng.normal(0, 0.3, net.p["out"].shape)
    texts = [bytes(rng.integers(32, 127, n).astype(np.uint8)) for n in (0, 5, 300, 900)]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    blocks, row = quality.halves(np.frombuffer(b"".join(texts), np.uint8), off)
    label = np.array([1.0, 0, 1, 0])

    def loss():
        feats, *_ = net.pooled(net.responses(blocks)[0].astype(np.float64), row)
        z = feats @ net.p["out"] + net.p["shift"][0]
        return np.mean(np.log1p(np.exp(z)) - label * z) + 5e-5 * (net.p["out"] ** 2).sum()

    g = net.gradients(blocks, row, label)
    for name, at in (("out", (3,)), ("out", (40,)), ("shift", (0,)), ("bias", (2,)), ("filter", (9, 4))):
        kept, eps = net.p[name][at], 1e-2
        net.p[name][at] = kept + eps
        up = loss()
        net.p[name][at] = kept - eps
        down = loss()
        net.p[name][at] = kept
        assert g[name][at] == pytest.approx((up - down) / (2 * eps), abs=2e-3)


def test_score_reads_every_byte():
    net = quality.ByteCNN()
    net.p["out"][:] = 0.01
    net.p["embed"][255] = 9 * np.sign(net.p["embed"][255])
    base = b"plain words here. " * 400
    off = np.array([0, len(base)])
    one = net.score(np.frombuffer(base, np.uint8), off)
    for at in (0, 255, 3_001, len(base) - 1):
        other = base[:at] + b"\xff" + base[at + 1 :]
        assert net.score(np.frombuffer(other, np.uint8), off) != one


def test_quality_held_out_accuracy(spark, odd_docs, no_docs):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels.where(~quality.held_out()))
    got = quality.score(docs, model).join(labels.where(quality.held_out()), "doc_id")
    right = got.where("(score >= 0.7) = (quality = 1)").count()
    assert right / got.count() > 0.9
    assert quality.score(odd_docs, model).where("score between 0 and 1").count() == odd_docs.count()
    assert quality.fit(no_docs, labels) is None
    assert quality.score(odd_docs, None).where("score = 0.5").count() == odd_docs.count()
    assert quality.score(no_docs, model).count() == 0
