import math
import random

import pandas as pd
import pytest

from riskloom.operators import evaluate


def _brute_auc(y, s):
    pos = [si for yi, si in zip(y, s) if yi == 1]
    neg = [si for yi, si in zip(y, s) if yi != 1]
    if not pos or not neg:
        return None
    tot = sum((1.0 if p > q else 0.5 if p == q else 0.0) for p in pos for q in neg)
    return tot / (len(pos) * len(neg))


def _brute_ap(y, s):
    P = sum(y)
    if P == 0:
        return 0.0
    ap, prev_r = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        sel = [yi for yi, si in zip(y, s) if si >= t]
        tp = sum(sel)
        r = tp / P
        ap += (r - prev_r) * (tp / len(sel))
        prev_r = r
    return ap


def _frame(spark, y, s):
    rows = [("m", yi, si, i) for i, (yi, si) in enumerate(zip(y, s))]
    return spark.createDataFrame(rows, "model string, y long, score double, k long")


def test_auc_and_ap_with_ties(spark):
    rnd = random.Random(3)
    s = [round(rnd.random(), 1) for _ in range(400)]
    y = [1 if rnd.random() < si else 0 for si in s]
    out = evaluate.classification_metrics(_frame(spark, y, s), "y", "score", by=["model"]).first()
    assert out.roc_auc == pytest.approx(_brute_auc(y, s), abs=1e-12)
    assert out.pr_auc == pytest.approx(_brute_ap(y, s), abs=1e-8)


def test_single_class(spark):
    out = evaluate.classification_metrics(_frame(spark, [0, 0, 0], [0.1, 0.2, 0.3]), "y", "score", by=["model"]).first()
    assert out.roc_auc is None and out.pr_auc == 0.0


def test_confusion_and_zero_division(spark):
    df = _frame(spark, [1, 0, 1, 0], [0.1, 0.2, 0.3, 0.35])
    r = evaluate.confusion(df, "y", "score", 0.9, ["model"]).first()
    assert (r.true_positives, r.false_positives, r.true_negatives, r.false_negatives) == (0, 0, 2, 2)
    assert r.precision == 0.0 and r.recall == 0.0 and r.f1 == 0.0
    r = evaluate.confusion(df, "y", "score", 0.35, ["model"]).first()
    assert r.actioned_count == 1  # score >= threshold is inclusive


def test_threshold_sweep_matches_confusion(spark):
    rnd = random.Random(5)
    s = [rnd.random() for _ in range(300)]
    y = [int(rnd.random() < 0.3) for _ in s]
    df = _frame(spark, y, s)
    sweep = {r.threshold: r for r in evaluate.threshold_sweep(df, "y", "score", (0.2, 0.5), ["model"]).collect()}
    for t in (0.2, 0.5):
        c = evaluate.confusion(df, "y", "score", t, ["model"]).first()
        assert sweep[t].precision == c.precision and sweep[t].recall == c.recall and sweep[t].f1 == c.f1


def test_top_k_clipped_and_percent(spark):
    y = [1, 0, 1, 0, 1, 0, 0]
    s = [0.9, 0.8, 0.8, 0.3, 0.2, 0.1, 0.1]
    out = {r.segment: r for r in evaluate.top_k_capture(_frame(spark, y, s), "y", "score", ["k"], (2, 25), (0.05, 0.5), ["model"]).collect()}
    assert out["top_25"].selected_count == 7 and out["top_25"].captured_no_show == 3
    assert out["top_2"].captured_no_show == 1  # tie at 0.8 broken by key: row 1 (y=0) first
    assert out["top_5pct"].selected_count == 1
    assert out["top_50pct"].selected_count == math.ceil(7 * 0.5)


def _brute_bins(n, q):
    return [max(0, math.ceil((r - 1) * q / (n - 1)) - 1) for r in range(1, n + 1)]


@pytest.mark.parametrize("n", [2, 7, 10, 23])
def test_calibration_bins_small_n(spark, n):
    s = [i / n for i in range(n)]
    y = [i % 2 for i in range(n)]
    out = evaluate.calibration(_frame(spark, y, s), "y", "score", ["k"], 10, ["model"]).toPandas()
    expect = pd.Series(_brute_bins(n, min(10, n))).value_counts().sort_index()
    assert list(out.sort_values("bin")["sample_count"]) == list(expect.values)


def test_calibration_one_distinct_score(spark):
    out = evaluate.calibration(_frame(spark, [0, 1, 1], [0.4, 0.4, 0.4]), "y", "score", ["k"], 10, ["model"]).collect()
    assert len(out) == 1 and out[0].bin == 0 and out[0].sample_count == 3
