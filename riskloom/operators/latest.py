"""Latest row per key (newest prediction per entity, latest action version)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(
    df: DataFrame,
    keys: Sequence[str],
    newest_first: Sequence[str],
    rank_col: str | None = None,
) -> DataFrame:
    """Keep the first row per ``keys`` ordered by ``newest_first`` (all descending).

    ``row_number() == 1`` lets Catalyst insert a partial ``WindowGroupLimit``
    before the shuffle, so even a key that owns a third of the rows reaches the
    exchange as one row per map task.
    """
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in newest_first])
    ranked = df.withColumn("_latest_rank", F.row_number().over(w)).filter(F.col("_latest_rank") == 1)
    return ranked.withColumnRenamed("_latest_rank", rank_col) if rank_col else ranked.drop("_latest_rank")
