"""Score evaluation: confusion counts, ROC-AUC, average precision, threshold sweep,
top-K capture, calibration and model comparison.

All metrics are computed per ``by`` group (e.g. model) from distributed
aggregates.  One scan collapses rows into tie groups ``(by, score) -> (rows,
positives, negatives)``; distributed prefix sums over these groups
(:mod:`riskloom.operators.ranking`) give every curve metric.  Top-K cuts and
calibration borders come from a score histogram; single rows are ranked only
inside the bins that a cut or border crosses.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom import config
from riskloom.functions import safe_ratio
from riskloom.operators.ranking import global_rank, prefix_sums
from riskloom.session import stored

ROUND = 9  # order-dependent float sums are rounded so they do not depend on summation order


def _pos(label: str) -> Column:
    return F.col(label) == 1


def confusion(df: DataFrame, label: str, score: str, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    """tp/fp/tn/fn at ``score >= threshold`` (A15) + precision/recall/F1."""
    pred = F.col(score) >= threshold
    out = df.groupBy(*by).agg(
        F.count_if(pred & _pos(label)).cast("bigint").alias("true_positives"),
        F.count_if(pred & ~_pos(label)).cast("bigint").alias("false_positives"),
        F.count_if(~pred & ~_pos(label)).cast("bigint").alias("true_negatives"),
        F.count_if(~pred & _pos(label)).cast("bigint").alias("false_negatives"),
    )
    return out.withColumns(
        {
            "threshold": F.lit(float(threshold)),
            "actioned_count": F.col("true_positives") + F.col("false_positives"),
            "precision": safe_ratio("true_positives", F.col("true_positives") + F.col("false_positives")),
            "recall": safe_ratio("true_positives", F.col("true_positives") + F.col("false_negatives")),
            "f1": safe_ratio(
                2 * F.col("true_positives"),
                2 * F.col("true_positives") + F.col("false_positives") + F.col("false_negatives"),
            ),
        }
    )


def tie_groups(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, score) groups with their rows and their positive / negative counts.

    Null scores are a group of their own.  A partial hash aggregate makes them, so a
    score that very many rows share reaches the shuffle as one row for each task.
    """
    return df.groupBy(*by, score).agg(
        F.count(F.lit(1)).cast("bigint").alias("rows"),
        F.count_if(_pos(label)).cast("bigint").alias("pos"),
        F.count_if(~_pos(label)).cast("bigint").alias("neg"),
    )


def ranked_groups(df: DataFrame, label: str, score: str, by: Sequence[str]) -> DataFrame:
    """Tie groups with running sums from the lowest score up, and the group totals.

    The one expensive step of the curve metrics: one scan, one aggregate, one pass of
    prefix sums over the groups.  Null scores come last.
    ``*_le`` are sums up to and with a group; ``*_all`` those of its ``by`` group.
    """
    up = stored(prefix_sums(tie_groups(df, label, score, by), [(score, True)], ["rows", "pos", "neg"], by, "_le"))
    total = up.groupBy(*by).agg(
        *[F.sum(c).alias(f"{c}_all") for c in ("rows", "pos", "neg")],
        F.sum(F.when(F.col(score).isNull(), F.col("rows"))).alias("unscored"),
    )
    return null_safe_join(up, total, by)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that keeps the null group; ``keys`` appear once."""
    right = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = F.lit(True)
    for i, c in enumerate(keys):
        one = F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        cond = one if i == 0 else cond & one
    return left.join(right, cond, how).drop(*[f"_r_{c}" for c in keys])


def curve_sums(score: str) -> list[Column]:
    """Aggregates over ranked groups: ROC-AUC numerator, average precision, squared error.

    The AUC numerator is exact in decimal(38,0): 2*sum(pos*neg_below) + sum(pos*neg).
    """
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    scored = F.col(score).isNotNull()
    # Sums from the highest score down follow from those up; unscored rows are no part of a curve.
    pos_ge = F.col("pos_scored") - F.col("pos_le") + F.col("pos")
    neg_ge = F.col("neg_scored") - F.col("neg_le") + F.col("neg")
    err = F.col("pos") * (1 - F.col(score)) * (1 - F.col(score)) + F.col("neg") * F.col(score) * F.col(score)
    return [
        F.sum(F.when(scored, (2 * (exact("neg_le") - exact("neg")) + exact("neg")) * exact("pos"))).alias("_auc"),
        F.sum(F.when(scored & (F.col("pos") > 0), F.col("pos") * pos_ge / (pos_ge + neg_ge))).alias("_ap"),
        F.sum(F.when(scored, err)).alias("_err"),
        F.sum(F.when(scored, F.col("pos"))).alias("_p"),
        F.sum(F.when(scored, F.col("neg"))).alias("_n"),
    ]


METRIC_COLUMNS = (
    "roc_auc", "pr_auc", "precision", "recall", "f1", "brier_score", "threshold", "actioned_count",
    "true_positives", "false_positives", "true_negatives", "false_negatives",
)


def classification_metrics(
    df: DataFrame, label: str, score: str, threshold: float = config.ACTION_THRESHOLD, by: Sequence[str] = ()
) -> DataFrame:
    """Metric record per ``by`` group (A15-A20), all from one table of ranked tie groups.

    ROC-AUC is null with one class (A18), average precision 0 without positives (A19).
    """
    if not by:
        one = classification_metrics(df.withColumn("_all", F.lit("all")), label, score, threshold, ["_all"])
        return one.drop("_all")
    by = list(by)
    groups = ranked_groups(df, label, score, by)
    hidden = groups.where(F.col(score).isNull()).select(*by, F.col("pos").alias("_hp"), F.col("neg").alias("_hn"))
    groups = null_safe_join(groups, hidden, by, "left").withColumns(
        {
            "pos_scored": F.col("pos_all") - F.coalesce("_hp", F.lit(0)),
            "neg_scored": F.col("neg_all") - F.coalesce("_hn", F.lit(0)),
        }
    )
    above = F.col(score) >= threshold
    sums = groups.groupBy(*by).agg(
        *curve_sums(score),
        F.coalesce(F.sum(F.when(above, F.col("pos"))), F.lit(0)).alias("true_positives"),
        F.coalesce(F.sum(F.when(above, F.col("neg"))), F.lit(0)).alias("false_positives"),
        F.coalesce(F.sum(F.when(~above, F.col("neg"))), F.lit(0)).alias("true_negatives"),
        F.coalesce(F.sum(F.when(~above, F.col("pos"))), F.lit(0)).alias("false_negatives"),
    )
    both = (F.col("_p") > 0) & (F.col("_n") > 0)
    tp, fp, fn = (F.col(c) for c in ("true_positives", "false_positives", "false_negatives"))
    return sums.select(
        *by,
        F.when(both, F.col("_auc").cast("double") / (2.0 * F.col("_p").cast("double") * F.col("_n").cast("double")))
        .alias("roc_auc"),
        F.when(F.col("_p") > 0, F.round(F.col("_ap") / F.col("_p"), ROUND)).otherwise(F.lit(0.0)).alias("pr_auc"),
        safe_ratio(tp, tp + fp).alias("precision"),
        safe_ratio(tp, tp + fn).alias("recall"),
        safe_ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        F.round(F.try_divide(F.col("_err"), F.col("_p") + F.col("_n")), ROUND).alias("brier_score"),
        F.lit(float(threshold)).alias("threshold"),
        (tp + fp).alias("actioned_count"),
        "true_positives", "false_positives", "true_negatives", "false_negatives",
    )


def threshold_sweep(
    df: DataFrame, label: str, score: str, thresholds: Sequence[float] = config.THRESHOLDS, by: Sequence[str] = ()
) -> DataFrame:
    """Precision / recall / F1 / actioned count per threshold in one pass.

    Conditional counts per threshold, then ``stack`` into long form; no row
    is multiplied by the threshold list.
    """
    by = list(by)
    aggs = [F.count_if(_pos(label)).alias("_p")]
    for i, t in enumerate(thresholds):
        pred = F.col(score) >= t
        aggs.append(F.count_if(pred & _pos(label)).alias(f"_tp{i}"))
        aggs.append(F.count_if(pred).alias(f"_a{i}"))
    wide = df.groupBy(*by).agg(*aggs)
    stack = "stack({n}, {rows}) as (threshold, tp, actioned)".format(
        n=len(thresholds),
        rows=", ".join(f"CAST({t!r} AS DOUBLE), _tp{i}, _a{i}" for i, t in enumerate(thresholds)),
    )
    long = wide.selectExpr(*by, "_p", stack)
    fp = F.col("actioned") - F.col("tp")
    fn = F.col("_p") - F.col("tp")
    return long.select(
        *by,
        "threshold",
        safe_ratio("tp", "actioned").alias("precision"),
        safe_ratio("tp", "_p").alias("recall"),
        safe_ratio(2 * F.col("tp"), 2 * F.col("tp") + fp + fn).alias("f1"),
        F.col("actioned").cast("bigint").alias("actioned_count"),
    )


# --- cuts and borders by narrowing ----------------------------------------------------

_BINS = 1 << 13  # bins of a score histogram
_WINDOW_ROWS = 100_000  # rows of one bin that a single window may rank


def score_bin(score: Column) -> Column:
    """Histogram bin of a score: never falls as the score rises; NaN and null have bins of their own.

    Scores of [-2, 2) spread over the bins and others lie in the outer ones, which then
    hold many rows and are narrowed like any full bin.
    """
    inside = F.floor(F.least(F.greatest(score, F.lit(-2.0)), F.lit(2.0)) * (_BINS // 4)).cast("int")
    return F.when(score.isNull(), _BINS).when(F.isnan(score), _BINS - 1).otherwise(inside)


def score_histogram(df: DataFrame, label: str, score: str, by: Sequence[str]) -> DataFrame:
    """One row for each (by, bin) with rows: counts, running counts from the lowest score up, totals.

    One scan with a partial aggregate; at most ``_BINS + 2`` rows of a group reach the shuffle
    from a task, whatever the number of distinct scores.  Stored, as cuts and sums both read it.
    """
    bins = stored(
        df.groupBy(*by, score_bin(F.col(score).cast("double")).alias("_bin")).agg(
            F.count(F.lit(1)).cast("bigint").alias("rows"),
            F.count_if(_pos(label)).cast("bigint").alias("pos"),
            F.count(score).cast("bigint").alias("scored"),
            F.sum(score).alias("total"),
            F.min(score).alias("low"),
            F.max(score).alias("high"),
        )
    )
    w = Window.partitionBy(*by)  # at most _BINS + 2 rows
    up = w.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    return bins.select(
        "*",
        *[F.sum(c).over(up).alias(f"{c}_le") for c in ("rows", "pos")],
        *[F.sum(c).over(w).alias(f"{c}_all") for c in ("rows", "pos", "scored")],
        F.min("low").over(w).alias("least"),
        F.max("high").over(w).alias("most"),
    )


def ranked_in_bins(
    df: DataFrame, wanted: DataFrame, by: Sequence[str], score: str, order: Sequence[tuple[str, bool]], columns: Sequence[str]
) -> DataFrame:
    """Rows of the ``wanted`` (by, _bin) bins with their rank ``_r`` in ``order`` inside the bin.

    Only these rows leave the scan.  A bin of up to ``_WINDOW_ROWS`` rows is ranked by a
    window; if one holds more (very many equal scores), rows of all wanted bins are laid
    out over range partitions instead, with the same ranks.
    """
    rows = df.select(*by, score_bin(F.col(score).cast("double")).alias("_bin"), *columns)
    inside = null_safe_join(rows, wanted, [*by, "_bin"])
    largest = wanted.agg(F.max("rows")).first()[0] or 0
    if largest > _WINDOW_ROWS:
        return global_rank(inside, order, [*by, "_bin"], "_r")
    cols = [F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in order]
    return inside.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_bin").orderBy(*cols)))


def top_k_capture(
    df: DataFrame,
    label: str,
    score: str,
    tie_break: Sequence[str],
    top_k: Sequence[int] = config.TOP_K_VALUES,
    top_percent: Sequence[float] = config.TOP_PERCENT_VALUES,
    by: Sequence[str] = (),
) -> DataFrame:
    """Positives captured in the K highest scores and the top p%.

    K is clipped to n; the percent cut is ``max(1, ceil(n*p))``.  Rank ties are broken by
    ``tie_break`` (ascending) so the result is deterministic; unscored rows come last.

    A histogram tells in which bin each cut lies; bins above it count whole, and only rows
    of the cut bins are ranked.
    """
    if not by:
        return top_k_capture(
            df.withColumn("_all", F.lit("all")), label, score, tie_break, top_k, top_percent, ["_all"]
        ).drop("_all")
    by = list(by)
    names = [f"top_{k}" for k in top_k] + [f"top_{int(round(p * 100))}pct" for p in top_percent]
    # From the top: bins by falling score, then the unscored rows.
    hidden = F.col("_bin") == _BINS
    unscored = F.col("rows_all") - F.col("scored_all")
    upto = F.when(hidden, F.col("rows_all")).otherwise(F.col("rows_all") - unscored - F.col("rows_le") + F.col("rows"))
    bins = score_histogram(df, label, score, by).withColumns(
        {"_upto": upto, "_above": upto - F.col("rows"), "_n": F.col("rows_all"), "_p": F.col("pos_all")}
    )
    bins = bins.withColumn("_cut", F.expr(f"array({', '.join(_cut_sql(n) for n in names)})"))
    whole = bins.groupBy(*by, "_n", "_p").agg(
        *[F.sum(F.when(F.col("_upto") <= F.col("_cut")[i], F.col("pos")).otherwise(0)).alias(f"_w{i}") for i in range(len(names))]
    )
    is_cut = F.lit(False)
    for i in range(len(names)):
        is_cut = is_cut | ((F.col("_above") < F.col("_cut")[i]) & (F.col("_cut")[i] < F.col("_upto")))
    wanted = bins.where(is_cut).select(*by, "_bin", "rows", "_above", "_upto", "_cut")
    order = [(score, False), *[(c, True) for c in tie_break]]
    ranked = ranked_in_bins(df, wanted, by, score, order, [label, score, *tie_break])
    place = F.col("_above") + F.col("_r")
    # A bin that is whole for one cut and cut for another was counted above for the first.
    part = ranked.groupBy(*by).agg(
        *[
            F.count_if((F.col("_upto") > F.col("_cut")[i]) & (place <= F.col("_cut")[i]) & _pos(label)).alias(f"_s{i}")
            for i in range(len(names))
        ]
    )
    captured = null_safe_join(whole, part, by, "left").select(
        *by, "_n", "_p", *[(F.col(f"_w{i}") + F.coalesce(f"_s{i}", F.lit(0))).alias(f"_c{i}") for i in range(len(names))]
    )
    stack = "stack({n}, {rows}) as (segment, selected_count, captured_no_show)".format(
        n=len(names),
        rows=", ".join(f"'{name}', CAST({_cut_sql(name)} AS BIGINT), _c{i}" for i, name in enumerate(names)),
    )
    return captured.selectExpr(*by, "_p", stack).select(
        *by,
        "segment",
        F.col("selected_count").cast("bigint").alias("selected_count"),
        F.col("captured_no_show").cast("bigint").alias("captured_no_show"),
        F.col("_p").cast("bigint").alias("total_no_show"),
        safe_ratio("captured_no_show", "_p").alias("recall"),
    )


def _cut_sql(segment: str) -> str:
    if segment.endswith("pct"):
        p = int(segment[len("top_"):-len("pct")]) / 100.0
        return f"greatest(1, ceil(_n * {p!r}))"
    k = int(segment[len("top_"):])
    return f"least({k}, _n)"


def calibration(
    df: DataFrame,
    label: str,
    score: str,
    tie_break: Sequence[str],
    bins: int = config.CALIBRATION_BIN_COUNT,
    by: Sequence[str] = (),
) -> DataFrame:
    """Equal-frequency calibration table.

    Rank r (score ascending, ties by ``tie_break``) of n rows goes to bin
    ``max(0, ceil((r-1)*q/(n-1)) - 1)`` with ``q = min(bins, n)``; fewer than
    two distinct scores -> a single bin 0.
    """
    if not by:
        return calibration(df.withColumn("_all", F.lit("all")), label, score, tie_break, bins, ["_all"]).drop("_all")
    by = list(by)
    hist = score_histogram(df, label, score, by).withColumns(
        {"_first": F.col("rows_le") - F.col("rows") + 1, "_varied": F.coalesce(F.col("least") < F.col("most"), F.lit(False))}
    )
    n = F.col("rows_all")
    q = F.least(F.lit(bins), n)

    def bin_of(rank: Column) -> Column:
        num, den = (rank - 1) * q, n - 1
        ceil_div = F.when(den > 0, F.floor((num + den - 1) / den))
        return F.when(F.col("_varied"), F.greatest(F.lit(0), ceil_div - 1)).otherwise(F.lit(0)).cast("bigint")

    hist = hist.withColumns({"_lo": bin_of(F.col("_first")), "_hi": bin_of(F.col("rows_le"))})
    whole = hist.where("_lo = _hi").select(
        *by, F.col("_lo").alias("bin"), F.col("rows").alias("_k"), "pos", F.col("scored").alias("_ks"), F.col("total").alias("_s")
    )
    # Only rows of score bins that a border crosses are ranked one by one.
    wanted = hist.where("_lo < _hi").select(*by, "_bin", "rows", "_first", "rows_all", "_varied")
    order = [(score, True), *[(c, True) for c in tie_break]]
    ranked = ranked_in_bins(df, wanted, by, score, order, [label, score, *tie_break])
    scored = F.col(score).isNotNull()
    part = ranked.select(
        *by, bin_of(F.col("_first") + F.col("_r") - 1).alias("bin"), F.lit(1).cast("bigint").alias("_k"),
        F.when(_pos(label), 1).otherwise(0).cast("bigint").alias("pos"),
        F.when(scored, 1).otherwise(0).cast("bigint").alias("_ks"), F.col(score).alias("_s"),
    )
    return (
        whole.unionByName(part)
        .groupBy(*by, "bin")
        .agg(
            F.sum("_k").cast("bigint").alias("sample_count"),
            F.round(F.try_divide(F.sum("_s"), F.sum("_ks")), ROUND).alias("mean_predicted_probability"),
            (F.sum("pos") / F.sum("_k")).alias("observed_positive_rate"),
        )
        .orderBy(*by, "bin")
    )


def metrics_long(metrics: DataFrame, by: Sequence[str] = ("model_name",), names=config.PRIMARY_METRICS) -> DataFrame:
    """Metric record -> (name, value, status) rows; null value = 'pending'."""
    long = metrics.unpivot(list(by), list(names), "name", "value")
    return long.withColumn("status", F.when(F.col("value").isNull(), "pending").otherwise("available"))


def model_comparison(metrics: DataFrame) -> DataFrame:
    """Models ordered by PR-AUC desc, ROC-AUC desc with their rank."""
    # The comparison table has one row per model: a global window over it is tiny.
    w = Window.orderBy(F.col("pr_auc").desc_nulls_last(), F.col("roc_auc").desc_nulls_last(), F.col("model_name"))
    return metrics.select(
        "model_name", "roc_auc", "pr_auc", "precision", "recall", "f1", "brier_score", "threshold",
        F.row_number().over(w).cast("bigint").alias("comparison_rank"),
    )


def recommended_model(comparison: DataFrame) -> DataFrame:
    """Top model of the comparison + explanation string."""
    return comparison.filter(F.col("comparison_rank") == 1).select(
        F.col("model_name").alias("recommended_model"),
        F.col("threshold").alias("selected_threshold"),
        F.format_string(
            config.RECOMMENDATION_NOTE,
            F.col("pr_auc"),
        ).alias("recommendation_reason"),
    )
