import random

import numpy as np
import pytest

from riskloom.llm import common, ngram_join, rpforest, suffix

from .conftest import pairs, rows, words

SF = "/root/testdata/sf0.001"


def test_components_equal_union_find(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)]
    edges += [(5000, 5001 + i) for i in range(50)] + [(7, 7), (8, None)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = dict(map(tuple, common.connected_components(df).collect()))
    low = {}
    for a, b in edges:
        if b is not None and a != b:
            low.setdefault(a, a)
            low.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if b is None or a == b:
                continue
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    assert got == low
    assert common.connected_components(df.where("false")).count() == 0


def near_docs():
    rnd = random.Random(3)
    passage, out = words(rnd, 40, 90), []
    for _ in range(24):
        base = words(rnd, rnd.choice([1, 2, 3, 4, 5, 6, 8, 12, 20, 40, 80, 200]), 90).split()
        for _ in range(rnd.randint(1, 7)):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, len(w) // 25))):
                w[rnd.randrange(len(w))] = f"zz{rnd.randrange(9)}"
            out.append(" ".join(w) + (" " + passage if rnd.random() < 0.3 else ""))
    out += ["a a a a a", "a a a a a a a", "A A A A A", "", None]
    return [(3 * i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("common_from", [32, 2])
def test_jaccard_join_equals_brute_force(spark, monkeypatch, common_from):
    monkeypatch.setattr(ngram_join, "COMMON", common_from)
    docs = near_docs()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert rows(ngram_join.components(df)) == sorted(ngram_join.brute_force(docs), key=repr)


@pytest.mark.parametrize("small", [0, 10, 10_000])
def test_jaccard_boundary_does_not_change_links(spark, monkeypatch, small):
    monkeypatch.setattr(ngram_join, "boundary", lambda costs: small)
    docs = near_docs()[:70]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(ngram_join.components(df)) == sorted(ngram_join.brute_force(docs), key=repr)


def test_jaccard_join_over_odd_rows(odd_docs, no_docs):
    assert rows(ngram_join.components(odd_docs)) == sorted(ngram_join.brute_force(pairs(odd_docs)), key=repr)
    assert ngram_join.components(no_docs).count() == 0


def test_bounded_prefixes_find_repeats():
    for trial in range(120):
        rng = np.random.default_rng(trial)
        lens = rng.integers(1, 60, rng.integers(1, 12))
        bound = int(rng.integers(2, 14))
        data = rng.integers(65, 65 + rng.integers(1, 6), lens.sum()).astype(np.uint8)
        off = np.concatenate([[0], np.cumsum(lens)])
        seen, places = {}, []
        for a, b in zip(off, off[1:], strict=False):
            for j in range(a, b - bound + 1):
                w = data[j : j + bound].tobytes()
                seen[w] = seen.get(w, 0) + 1
                places.append((j, w))
        want = np.zeros(len(data), bool)
        for j, w in places:
            want[j] = seen[w] > 1
        assert np.array_equal(suffix.repeated_starts(data, lens, bound), want), trial


def repeat_docs():
    rnd = random.Random(5)
    shared, out = [words(rnd, 60) for _ in range(6)], []
    for i in range(90):
        t = words(rnd, rnd.randint(0, 120))
        for _ in range(rnd.choice([0, 0, 1, 2])):
            k = rnd.randint(0, len(t))
            t = t[:k] + rnd.choice(shared)[rnd.randint(0, 40) :] + t[k:]
        out.append((i, t))
    out += [(200, out[3][1]), (201, out[3][1]), (202, None), (203, ""), (204, "a" * 3000), (205, "ab" * 900 + "é" * 300)]
    return out + [(205, "Mentpa " * 200), (None, out[5][1]), (206, "x" * 199), (207, "y" * 200), (208, "y" * 200)]


@pytest.mark.parametrize("least", [64, 5])
def test_repeats_equal_brute_force(spark, monkeypatch, least):
    monkeypatch.setattr(suffix, "HOT_LEAST", least)  # 5: keys are split over several levels
    monkeypatch.setattr(suffix, "HOT_SHARE", 1000)
    docs = repeat_docs()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert rows(suffix.digest(suffix.repeats(df))) == sorted(suffix.brute_force(docs), key=repr)


def test_border_of_a_common_passage_is_split(spark, monkeypatch):
    rnd = random.Random(11)

    def noise(n):
        return "".join(rnd.choice("abcdefghij ") for _ in range(n))

    passage = noise(400)
    docs = [(i, noise(150) + passage + ("same tail of some " if i % 3 else "") + noise(150)) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(suffix, "KEY_BYTES", 3000)
    found = suffix.shared_stretches(df.selectExpr("xxhash64(text) as dk", "text as t")).where("kind = 0")
    keys = found.select("key", "content", "windows").distinct().selectExpr("key", "windows + 199 as n").groupBy("key").sum("n")
    assert keys.agg({"sum(n)": "max"}).first()[0] <= 3000
    assert rows(suffix.digest(suffix.repeats(df))) == sorted(suffix.brute_force(docs), key=repr)


def test_copies_of_a_text_get_no_places(spark):
    """Places of a text with copies come from each chunk and would go to each copy."""
    found = spark.createDataFrame(
        [(1, 0, 0, 7, 0, 5, 2), (1, 0, 0, 7, 0, 5, 2), (1, 0, 0, 8, 3, 5, 2), (0, 1, 2, 7, 9, 4, 1), (0, 1, 2, 9, 9, 4, 1)], suffix.FOUND
    )
    compared = spark.createDataFrame([(1, 2, b"12345678")], "key long, content long, spans binary")
    copies = spark.createDataFrame([(7, 1, 50), (8, 2, 1), (9, 3, 1)], "dk long, one long, copies long")
    got = suffix.text_spans(found, compared, copies).collect()
    assert sorted((r["dk"], [s["at"] for s in r["spans"]]) for r in got) == [(8, [3]), (9, [9])]


def test_keys_without_an_open_stretch_are_not_compared(spark):
    rnd = random.Random(12)
    passage = words(rnd, 200)
    docs = [(i, passage + " " + words(rnd, 80)) for i in range(6)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = suffix.shared_stretches(df.selectExpr("xxhash64(text) as dk", "text as t"))
    assert found.where("kind = 1").count() > 0
    least = found.where("kind = 0").groupBy("key").min("many").collect()
    assert all(r["min(many)"] == 1 for r in least)
    assert rows(suffix.digest(suffix.repeats(df))) == sorted(suffix.brute_force(docs), key=repr)


def test_only_windows_that_occur_again_are_transformed(monkeypatch):
    gen, whole, seen = np.random.default_rng(6), suffix.repeated_starts, []
    shared = gen.integers(97, 100, 260).astype(np.uint8)
    parts = [gen.integers(97, 100, 900).astype(np.uint8) for _ in range(6)]
    for i, p in enumerate(parts[:3]):
        p[99:361] = 65 + i  # neighbours differ
        p[100:360] = shared
    parts += [np.full(450, 97, np.uint8), np.zeros(0, np.uint8), shared[:199], shared[:200]]
    off = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    data = np.concatenate(parts)

    def counted(text, lens):
        seen.append(len(text))
        return whole(text, lens)

    monkeypatch.setattr(suffix, "repeated_starts", counted)
    got = suffix._repeated(data, off)
    assert np.array_equal(got, whole(data, np.diff(off)))
    assert got.sum() == 3 * 61 + 251 + 1
    assert seen == [3 * 260 + 450 + 200]
    # Every other window of a text occurs again: its bytes enter once, not once for each.
    text = gen.integers(97, 123, 1000).astype(np.uint8)
    cuts = [text[i : i + 200] for i in range(0, 800, 2)]
    off = np.concatenate([[0], np.cumsum([len(p) for p in [text, *cuts]])])
    got = suffix._repeated(np.concatenate([text, *cuts]), off)
    assert got.sum() == 800 and not got[1:800:2].any()
    assert seen[1] == 998 + 400 * 200


def test_later_passes_look_at_windows_near_split_grams_only():
    gen = np.random.default_rng(8)
    parts = [gen.integers(97, 123, n).astype(np.uint8) for n in (900, 0, 150, 200, 3000, 700)]
    parts[4][500:900] = parts[0][300:700]
    data, off = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    key, _, text, at, size = suffix.stretches(data, off, [])
    for hot in (np.sort(key[::7]), np.sort(key), np.zeros(0, np.uint64), np.arange(3, dtype=np.uint64)):
        pick = np.isin(key, hot)
        want = {(t, a + j) for t, a, n in zip(text[pick], at[pick], size[pick], strict=True) for j in range(n)}
        _, _, t2, a2, n2 = suffix.stretches(data, off, [hot])
        got = [(t, a + j) for t, a, n in zip(t2, a2, n2, strict=True) for j in range(n)]
        assert len(got) == len(set(got)) and set(got) == want


def test_long_texts_are_cut_alike(spark, monkeypatch):
    monkeypatch.setattr(suffix, "SEGMENT", 700)
    monkeypatch.setattr(suffix, "_POWERS", {})
    docs = repeat_docs()[:40]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    data = [t.encode() for _, t in docs]
    off = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    flat = np.frombuffer(b"".join(data), np.uint8)
    windows = sum(max(len(d) - suffix.LENGTH + 1, 0) for d in data)
    got = 0
    for part, bounds, _, _ in suffix._segments(flat, off):
        got += int(suffix.stretches(part, bounds, [])[4].sum())
    assert got == windows
    assert rows(suffix.digest(suffix.repeats(df))) == sorted(suffix.brute_force(docs), key=repr)


def test_repeats_over_odd_rows(odd_docs, no_docs):
    got = rows(suffix.digest(suffix.repeats(odd_docs)))
    assert [g[0] for g in got] == [i for i, _ in sorted(pairs(odd_docs), key=lambda x: repr(x[0]))] or len(got) == 12
    small = odd_docs.where("coalesce(length(text), 0) < 6000")
    assert rows(suffix.digest(suffix.repeats(small))) == sorted(suffix.brute_force(pairs(small)), key=repr)
    assert suffix.digest(suffix.repeats(no_docs)).count() == 0


def check_vectors(df, recall):
    got = {r["vec_id"]: r for r in rpforest.near_duplicates(df).collect()}
    want = rpforest.brute_force([(r["vec_id"], r["embedding"]) for r in df.collect()])
    links = sum(len(v) for v in want.values())
    assert all(r["n_links"] <= len(want.get(i, ())) for i, r in got.items())
    assert sum(r["n_links"] for r in got.values()) >= recall * links
    return got, want


def test_forest_recall(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(400, 32))
    near = base[rng.integers(0, 40, 1600)] + rng.normal(0, 0.05, (1600, 32))
    ball = base[:1] + rng.normal(0, 0.01, (900, 32))  # a third of the rows in one place
    x = np.concatenate([base, near, ball]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got, want = check_vectors(df, 0.9)
    assert got[2500]["n_links"] >= 900 * 0.9
    assert got[2500]["component_id"] == 0


def test_forest_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    vecs = [
        (1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, [0.0, 1.0, 0.0]), (4, None), (5, [0.0, 0.0, 0.0]), (6, [nan, 1.0, 0.0]),
        (7, [inf, 1.0, 0.0]), (8, [1.0, None, 0.0]), (9, []), (10, [1.0, 0.01, 0.0]), (10, [1.0, 0.01, 0.0]), (11, [1.0, 0.0]), (12, [-1.0, 0.0, 0.0]),
        (None, [0.0, 1.0, 0.01]), (13, [1e-30, 0.0, 0.0]),
    ]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<float>").selectExpr("*", "'x' as k", "'y' as v", "1 as leaf")
    got = rows(rpforest.near_duplicates(df))
    by = {}
    for r in got:
        by.setdefault(r[0], []).append(r[1:])
    assert len(got) == len(vecs)
    assert by[1] == [(4, 1, True)] and by[2] == [(4, 1, False)] and by[10] == [(4, 1, False)] * 2
    assert by[13] == [(4, 1, False)]
    assert by[3] == [(1, 3, True)] and by[None] == [(1, 3, True)] or by[None] == [(1, 3, False)]
    for i in (4, 5, 6, 7, 8, 9, 11, 12):
        assert by[i] == [(0, i, True)]
    assert rpforest.near_duplicates(df.where("false")).count() == 0
