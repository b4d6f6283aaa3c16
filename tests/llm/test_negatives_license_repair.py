import itertools
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import license_scan, negatives, repair

from .conftest import pairs, rows, words

VECTORS = "vec_id long, embedding array<double>, label int"


def mined(df, **more):
    return sorted(tuple(r) for r in negatives.mine(df, F.col("vec_id") % 5 == 0, **more).collect())


def of_pandas(spark, data):
    made = [(i, None if v is None else [None if x is None else float(x) for x in v], c) for i, c, v in data]
    return spark.createDataFrame(made, VECTORS)


def clustered(rnd, n, dim=6, labels=3):
    heads = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    out = []
    for i in range(n):
        h = rnd.choice(heads)
        out.append((i, rnd.randrange(labels), [x + rnd.gauss(0, 0.1) for x in h]))
    return out


def test_negatives_equal_brute_force(spark, monkeypatch):
    rnd = random.Random(3)
    data = clustered(rnd, 260)
    data += [(900 + i, i % 2, list(data[3][2])) for i in range(40)]  # equal vectors: ties by id
    data += [(5, data[5][1], list(data[5][2]))] * 3  # repeated rows count once
    data += [(10, 1, [0.5] * 6), (2000, 1, [0.25, 0.5]), (2001, 1, [0.25, 0.75]), (2005, 0, [0.25, 0.5]), (2010, 1, [])]
    data += [(2011, 0, []), (2012, 1, [])]
    data += [(4000, None, [1.0] * 6), (4005, 1, None), (4010, 1, [1.0, None, 1, 1, 1, 1]), (None, 1, [1.0] * 6)]
    data += [(4015, 1, [float("nan")] * 6), (4020, 1, [float("inf")] * 6), (0, 0, [0.0] * 6)]
    want = sorted(negatives.brute_force(data, lambda i: i % 5 == 0))
    assert mined(of_pandas(spark, data)) == want and len(want) > 100
    # Many small groups, blocks and stripes give the same.
    monkeypatch.setattr(negatives, "GROUP", 7)
    monkeypatch.setattr(negatives, "BLOCK", 20)
    monkeypatch.setattr(negatives, "STRIPE", 2)
    assert mined(of_pandas(spark, data)) == want


def test_negatives_large_components(spark):
    rnd = random.Random(4)
    data = [(i, i % 2, [float(rnd.randrange(-(2**22), 2**22)) for _ in range(3)]) for i in range(60)]
    got, want = mined(of_pandas(spark, data)), sorted(negatives.brute_force(data, lambda i: i % 5 == 0))
    assert all(abs(s) < 2**63 for *_, s in want) and any(abs(s) > 2**53 for *_, s in want)
    assert got == want and got
    huge = [(0, 1, [1e30, 1.0, 0.0]), (5, 1, [-1e300, 1.0, 0.0]), (6, 0, [3e15, 0.0, 0.0]), (7, 0, [-1e18, 2.0, 2.0])]
    got = mined(of_pandas(spark, data + huge))  # scores outside of long take its end
    assert all(-(2**63) < s < 2**63 for r in got for s in r[4:]) and {r[0] for r in got} >= {0, 5}
    assert negatives.products(np.full((1, 2), 1e200), np.full(2, 1e200), np.array([True])).tolist() == [2**63 - 1]


def test_negatives_empty_and_clashes(spark):
    none = spark.createDataFrame([], VECTORS)
    assert mined(none) == [] and negatives.mine(none, F.lit(None)).columns[0] == "anchor_id"
    data = clustered(random.Random(5), 60)
    df = of_pandas(spark, data)
    for c in ("i", "v", "tie", "blk", "grp", "dim", "score", "a", "x", "stripe", "is_anchor"):
        df = df.selectExpr("*", f"'x' as `{c}`")
    assert mined(df) == sorted(negatives.brute_force(data, lambda i: i % 5 == 0))
    assert mined(of_pandas(spark, [d for d in data if d[1] == 0])) == []


def test_tree_bounds_save_scores():
    """Bounds hold, the tree is one, and near anchors rescore few candidates."""
    rng = np.random.default_rng(1)
    heads = rng.normal(size=(20, 16)) * 4
    vec = np.floor(256 * (heads[rng.integers(0, 20, 400)] + rng.normal(size=(400, 16)) * 0.02))
    parent, edge = negatives.spanning_tree(vec[:100])
    assert (parent < 0).sum() == 1 and (edge[parent >= 0] > 0).all()
    for a, p in enumerate(parent):
        if p >= 0:
            gap = vec[:100][a] - vec[:100][p]
            assert edge[a] >= np.linalg.norm(gap)
    least = sum(sorted(np.linalg.norm(vec[:100][a] - vec[:100][p]) for a, p in enumerate(parent) if p >= 0))
    assert np.isclose(least, _kruskal(vec[:100]))
    pack = lambda v: (16, *(np.arange(len(v)).tobytes() for _ in range(3)), v.tobytes())
    tree = negatives.Tree(*pack(vec[:100]), parent=parent.tobytes(), edge=edge.tobytes())
    block, seen = negatives.Side(*pack(vec)), []
    want = vec[:100] @ vec.T

    def wants(a, low, high):
        assert (low <= want[a]).all() and (high >= want[a]).all()
        return high >= np.partition(want[a], -5)[-5]

    scored = negatives.sweep(tree, block, wants, lambda a, at, s: seen.append((a, at.tolist(), s.tolist())))
    assert scored < 0.5 * want.size
    for a, at, s in seen:
        assert s == want[a][at].tolist() and set(np.argsort(-want[a], kind="stable")[:5]) <= set(at)


def _kruskal(v):
    up = list(range(len(v)))

    def top(a):
        while up[a] != a:
            a = up[a]
        return a

    total = 0.0
    for d, a, b in sorted((np.linalg.norm(v[a] - v[b]), a, b) for a, b in itertools.combinations(range(len(v)), 2)):
        if top(a) != top(b):
            up[top(a)] = top(b)
            total += d
    return total


# --------------------------------------------------------------------------
def planted(rnd, templates, n):
    """Texts with whole, cut, shuffled and thinned templates."""
    out = []
    for i in range(n):
        ws = words(rnd, rnd.randint(0, 200), 400).split()
        for _ in range(rnd.randint(0, 2)):
            own = license_scan.cut(rnd.choice(list(templates.values())))
            own = [w for w in own if rnd.random() > rnd.choice([0, 0, 0.05, 0.15, 0.4])]
            if rnd.random() < 0.2:
                rnd.shuffle(own)
            at = rnd.randint(0, len(ws))
            ws[at:at] = own
        if rnd.random() < 0.3:
            at = rnd.randint(0, len(ws))
            ws[at:at] = rnd.choice(["CC BY", "General Public License", "all rights-reserved!", "all rights", "cc cc by"]).split()
        out.append((i, rnd.choice([" ", "\n", ", "]).join(ws)))
    return out


def test_license_scan_equals_brute_force(spark, odd_docs, no_docs):
    docs = planted(random.Random(11), license_scan.TEMPLATES, 150)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = rows(license_scan.digest(license_scan.scan(df)))
    assert got == sorted(license_scan.brute_force(docs), key=repr)
    assert len({r[6] for r in got}) > 10
    odd = rows(license_scan.digest(license_scan.scan(odd_docs)))
    assert odd == sorted(license_scan.brute_force(pairs(odd_docs)), key=repr)
    assert license_scan.digest(license_scan.scan(no_docs)).count() == 0


@pytest.mark.parametrize("share", [Fraction(1, 2), Fraction(4, 5), Fraction(1)])
def test_license_scan_thresholds_and_templates(spark, share):
    """Own templates of words that are frequent, so that every filter has much to do."""
    rnd = random.Random(12)
    templates = {f"t{n}": " ".join(rnd.choices("a b c d e f g h i j k l m".split(), k=n)) for n in (1, 2, 3, 5, 8, 9, 17, 30)}
    docs = [(i, " ".join(rnd.choices("a b c d e f g h i j k l m n o p q".split(), k=rnd.randint(0, 120)))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = license_scan.scan(df, templates=templates, phrases={"x": "a b"}, share=share)
    assert rows(license_scan.digest(found)) == sorted(license_scan.brute_force(docs, templates, {"x": "a b"}, share), key=repr)
    for r in found.collect():
        ws = dict(docs)[r["doc_id"]].split()
        for b in r["blocks"]:
            own = set(templates[b["label"]].split())
            assert b["share"] == len(own & set(ws[b["first"] : b["end"]])) / len(own) >= share
        assert all(ws[p["first"] : p["end"]] == ["a", "b"] for p in r["places"])


def test_license_scan_long_texts(spark, monkeypatch):
    """Stretches split neither words nor phrases nor blocks."""
    rnd = random.Random(13)
    text = " ".join(t for _, t in planted(rnd, license_scan.TEMPLATES, 30)) + " " + "x" * 500 + "é" * 300
    data, off = np.frombuffer(text.encode(), np.uint8), np.array([0, 7, 7, len(text.encode())])
    cut = list(license_scan.segments(data, off, 50))
    assert b"".join(d.tobytes() for _, d, _ in cut) == text.encode()
    with monkeypatch.context() as m:
        m.setattr(license_scan.segments, "__defaults__", (64,))
        scanner = license_scan.Scanner(license_scan.TEMPLATES, license_scan.PHRASES, license_scan.SHARE)
        import pyarrow as pa

        piece = pa.record_batch({"t": pa.array([text, None, text[:300], ""])})
        row, at, word, total = license_scan.known_words(piece, scanner.look)
        m.undo()
        whole = license_scan.known_words(piece, scanner.look)
    assert all((a == b).all() for a, b in zip((row, at, word, total), whole, strict=True))
    assert total.tolist() == [len(license_scan.cut(t)) for t in (text, "", text[:300], "")]


def test_license_templates_need_words():
    with pytest.raises(ValueError):
        license_scan.Scanner({"none": " - "}, {}, license_scan.SHARE)


# --------------------------------------------------------------------------
CONV = "conv_id long, turn long, role string, text string"


def talks(rnd, n, longest):
    out = []
    for c in range(n):
        for turn in range(rnd.randint(1, longest)):
            role = rnd.choice(["user", "assistant", "system", "user", "assistant", "tool", "", "umpire", None])
            text = rnd.choice(["Hi.", "Hi", "", " \t\n", "What? ", "ok!\r\n", "no", None, f"w{rnd.randrange(5)}.", "é", "a.b \x0b"])
            out.append((c, rnd.choice([turn, turn, turn, turn + 1, None]), role, text))
    return out


def repaired(df, **more):
    return sorted(map(tuple, repair.repair(df, **more).collect()), key=repr)


def test_repair_equals_brute_force(spark):
    data = talks(random.Random(21), 120, 12)
    data += [(None, 1, "user", "A."), (None, None, "assistant", "B."), (500, 3, "user", "x"), (501, 3, "user", "y.")]
    df = spark.createDataFrame(data, CONV)
    assert repaired(df) == sorted(repair.brute_force(data), key=repr)
    for c in ("c", "part", "place", "copies", "kind", "r", "t", "deal", "cost"):
        df = df.selectExpr("*", f"'x' as `{c}`")
    assert repaired(df.repartition(7)) == sorted(repair.brute_force(data), key=repr)
    assert repaired(spark.createDataFrame([], CONV)) == []
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    alone = repaired(spark.createDataFrame([(dropped, 0, "user", "Hi.")], CONV))
    empty = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert alone == [(dropped, 0, 0, 0, 0, 0, 0, "", empty)]


def test_repair_of_hot_conversations(spark, monkeypatch):
    """Conversations that span many partitions, with equal rows and runs of one symbol."""
    rnd = random.Random(22)
    data = talks(rnd, 3, 500) + [(7, 5, "user", "same.")] * 300 + [(8, t // 3, "user", f"{t}.") for t in range(400)]
    data += [(None, None, "assistant", f"x{t % 9}") for t in range(200)] + talks(rnd, 20, 4)
    monkeypatch.setattr(repair, "PART_BYTES", 3000)
    df = spark.createDataFrame(data, CONV)
    assert repaired(df) == sorted(repair.brute_force(data), key=repr)


def test_runs_by_binary_powers():
    """A run's power equals one step after the other, for every symbol and for mixed runs."""
    rnd = random.Random(23)
    symbols = [repair.symbol(i, f) for i in "sua" for f in range(4)] + [repair.symbol("t", f) for f in range(4)]
    for sym in symbols:
        costs = step = (5, 0, 9, 2)
        for n in range(1, 70):
            step = repair.advance(sym, 1, step)
            assert repair.advance(sym, n, costs) == step
    for _ in range(200):
        runs = [(rnd.choice(symbols), rnd.choice([1, 1, 2, 3, 7, 20])) for _ in range(rnd.randint(0, 6))]
        flat = [(s, 1) for s, n in runs for _ in range(n)]
        assert repair.solve(runs) == repair.solve(flat)
        m = repair.run_matrix(runs)
        assert repair.apply(m, repair.END) == repair.behind(flat, repair.END)[0]
