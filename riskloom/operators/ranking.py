"""Distributed global ranks and prefix sums.

A window without ``partitionBy`` pulls every row into one task, and a window by
group pulls a large group into one.  Instead rows are range-partitioned by the
group and *all* order columns and sorted, and written once with the partition
number and the place in the partition.  Then

    rank = rows of the group in earlier partitions + place in this one.

The counts by partition and group are one row for each partition and one for
each further group in it; they are summed in partition order and joined back.
Groups and order values may be null; a value held by very many rows is split like
any other, because the remaining order columns divide it.  No row reaches the
driver, and there is no switch between plans.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import stored

_PLACE = (1 << 33) - 1  # bits of monotonically_increasing_id that count inside a partition


def _partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def _order_cols(order: Sequence[tuple[str, bool]]) -> list[Column]:
    return [F.col(c).asc_nulls_last() if asc else F.col(c).desc_nulls_last() for c, asc in order]


def laid_out(df: DataFrame, order: Sequence[tuple[str, bool]], by: Sequence[str], partitions: int) -> DataFrame:
    """``df`` in (group, order) sequence with ``_rk_part`` and ``_rk_place``, stored.

    What is read back is fixed, so a lost executor costs a re-read and never
    another layout.
    """
    keys = [*[F.col(c).asc_nulls_first() for c in by], *_order_cols(order)]
    mid = F.monotonically_increasing_id()
    return stored(
        df.repartitionByRange(partitions, *keys)
        .sortWithinPartitions(*keys)
        .select("*", mid.alias("_rk_mid"))
        .select("*", F.shiftright("_rk_mid", 33).alias("_rk_part"), F.col("_rk_mid").bitwiseAND(F.lit(_PLACE)).alias("_rk_place"))
        .drop("_rk_mid")
    )


def with_cells(rows: DataFrame, cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join per-cell values back on (partition, group), null groups included."""
    side = cells.select(*[F.col(c).alias(f"_rk_c_{c}") for c in by], F.col("_rk_part").alias("_rk_c_part"), *[
        c for c in cells.columns if c not in (*by, "_rk_part")
    ])
    cond = F.col("_rk_part") == F.col("_rk_c_part")
    for c in by:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_rk_c_{c}"))
    return rows.join(side, cond).drop("_rk_c_part", *[f"_rk_c_{c}" for c in by])


_BLOCK = 64  # partitions whose counts are summed together where there is no group


def _sums_before(cells: DataFrame, sums: dict[str, str], by: Sequence[str], partitions: int) -> DataFrame:
    """Cells with, for each column of ``sums``, its sum over earlier partitions (new name: value).

    Within a group that is a window over the group's cells.  Without one, blocks of
    partitions are summed in windows of their own, and block totals are dealt to
    all later blocks, so no step gathers all cells in one task.
    """
    earlier = lambda *keys: Window.partitionBy(*keys).orderBy("_rk_part").rowsBetween(Window.unboundedPreceding, -1)
    if by:
        w = earlier(*by)
        return cells.select("*", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(n) for c, n in sums.items()])
    blocks = partitions // _BLOCK + 1
    cells = cells.withColumn("_rk_block", F.floor(F.col("_rk_part") / _BLOCK).cast("int"))
    totals = cells.groupBy("_rk_block").agg(*[F.sum(c).alias(f"_rk_s_{c}") for c in sums])
    later = totals.withColumn("_rk_later", F.explode(F.sequence(F.col("_rk_block") + 1, F.lit(blocks))))
    ahead = later.groupBy(F.col("_rk_later").alias("_rk_block")).agg(
        *[F.sum(f"_rk_s_{c}").alias(f"_rk_e_{c}") for c in sums]
    )
    w = earlier("_rk_block")
    out = cells.join(ahead, "_rk_block", "left").select(
        *cells.columns,
        *[
            (F.coalesce(F.sum(c).over(w), F.lit(0)) + F.coalesce(f"_rk_e_{c}", F.lit(0))).alias(n)
            for c, n in sums.items()
        ],
    )
    return out.drop("_rk_block")


def global_rank(
    df: DataFrame,
    order: Sequence[tuple[str, bool]],
    by: Sequence[str] = (),
    rank_col: str = "rank",
    continuous: bool = False,
    partitions: int | None = None,
) -> DataFrame:
    """Add ``rank_col`` = 1-based ``row_number`` in ``order`` within each ``by`` group.

    ``order`` is a list of (column, ascending), nulls last; together with the group
    it must be total.  With ``continuous`` the numbering runs on across the groups
    in ascending group order (null group first) instead of restarting.
    """
    by = list(by)
    n = partitions or _partitions(df)
    rows = laid_out(df, order, by, n)
    group = [] if continuous else by
    cells = rows.groupBy("_rk_part", *group).agg(F.count(F.lit(1)).alias("_rk_n"), F.min("_rk_place").alias("_rk_first"))
    cells = _sums_before(cells, {"_rk_n": "_rk_before"}, group, n).drop("_rk_n")
    rank = F.col("_rk_before") + F.col("_rk_place") - F.col("_rk_first") + 1
    return with_cells(rows, cells, group).withColumn(rank_col, rank.cast("bigint")).drop(
        "_rk_part", "_rk_place", "_rk_first", "_rk_before"
    )


def prefix_sums(
    df: DataFrame,
    order: Sequence[tuple[str, bool]],
    sums: Sequence[str],
    by: Sequence[str] = (),
    suffix: str = "_cum",
    partitions: int | None = None,
) -> DataFrame:
    """Inclusive running sums of ``sums`` columns in a total ``order`` within ``by``.

    Rows must be unique in the order (aggregate tie groups first).
    """
    by = list(by)
    n = partitions or _partitions(df)
    rows = laid_out(df, order, by, n)
    cells = rows.groupBy("_rk_part", *by).agg(*[F.sum(c).alias(f"_rk_t_{c}") for c in sums])
    cells = _sums_before(cells, {f"_rk_t_{c}": f"_rk_o_{c}" for c in sums}, by, n).drop(*[f"_rk_t_{c}" for c in sums])
    local = Window.partitionBy("_rk_part", *by).orderBy("_rk_place").rowsBetween(Window.unboundedPreceding, 0)
    out = with_cells(rows.select("*", *[F.sum(c).over(local).alias(f"_rk_l_{c}") for c in sums]), cells, by)
    return out.select(*df.columns, *[(F.col(f"_rk_o_{c}") + F.col(f"_rk_l_{c}")).alias(f"{c}{suffix}") for c in sums])


def keys_below(key: Column, keys: Column, most: int) -> Column:
    """Number of values in the sorted array ``keys`` (at most ``most``) that lie below ``key``.

    A binary search by halving steps; a null key (or struct with nulls) sorts first.
    """
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, most).bit_length()))])

    def step(at: Column, by: Column) -> Column:
        return F.when(F.get(keys, at + by - 1) < key, at + by).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)
