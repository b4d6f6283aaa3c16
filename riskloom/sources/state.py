"""Stored current state: newest row per entity in bucketed tables, action state folded batch by batch.

Both spare the history.  A run's predictions are merged into the stored newest
rows, whose table is bucketed by entity like the entities themselves, so neither
the merge nor the reports' join shuffles the stored side.  Action updates are
folded into the buckets that hold their actions; other buckets are not read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.latest import latest_per_key
from riskloom.session import shared_path, stored
from riskloom.sources import files

BUCKETS = 64  # choose it so that a bucket is about one task's input


# --- newest rows in bucketed tables -------------------------------------------------------


def write_bucketed(df: DataFrame, name: str, keys: Sequence[str], buckets: int = BUCKETS, dealt: bool = False) -> str:
    """Write ``df`` as a table bucketed and sorted by ``keys``; the table's name.

    The files lie in the shared folder.  ``dealt`` says that each task holds whole
    buckets already, as after a join with such a table; otherwise rows are dealt first,
    so that each bucket is one file.
    """
    table = f"riskloom_{name}_{uuid.uuid4().hex}"
    rows = df if dealt else df.repartition(buckets, *keys)
    writer = rows.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", shared_path(df.sparkSession, name))
    writer.format("parquet").saveAsTable(table)
    return table


def store_latest(
    rows: DataFrame, keys: Sequence[str], newest_first: Sequence[str], buckets: int = BUCKETS, name: str = "latest"
) -> str:
    """Newest row per key of a history, bucketed by key.  Rows without a whole key have no entity and stay out."""
    return write_bucketed(latest_per_key(_keyed(rows, keys), keys, newest_first), name, keys, buckets)


def _keyed(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    return rows


def merged_latest(kept: DataFrame, rows: DataFrame, keys: Sequence[str], newest_first: Sequence[str]) -> DataFrame:
    """Stored newest rows with a run's ``rows`` merged in.

    The run is cut to its newest row per key before it is shuffled; the stored side
    stays in its buckets.  The larger of the two by ``newest_first`` wins (nulls lowest,
    as in ``latest_per_key``), so late rows change nothing, and a run that is merged
    twice counts once.
    """
    rest = [c for c in kept.columns if c not in keys]
    fresh = latest_per_key(_keyed(rows.select(*kept.columns), keys), keys, newest_first)
    old = kept.select(*keys, F.struct(*rest).alias("_old"))
    new = fresh.select(*keys, F.struct(*rest).alias("_new"))
    both = old.join(new, list(keys), "full_outer")
    order = lambda side: F.struct(*[F.col(f"{side}.{c}") for c in newest_first])
    newer = F.col("_old").isNull() | (F.col("_new").isNotNull() & (order("_new") > order("_old")))
    pick = F.when(newer, F.col("_new")).otherwise(F.col("_old"))
    return both.select(*keys, pick.alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def merge_latest(
    spark: SparkSession, table: str, rows: DataFrame, keys: Sequence[str], newest_first: Sequence[str],
    buckets: int = BUCKETS, name: str = "latest",
) -> str:
    """Write ``merged_latest`` as a new table of as many buckets; the old table stays as it was."""
    merged = merged_latest(spark.table(table), rows, keys, newest_first)
    return write_bucketed(merged, name, keys, buckets, dealt=True)


# --- action state, folded bucket by bucket ------------------------------------------------

FIELDS = ("action_status", "action_note")
PART = re.compile(r"/bucket=(\d+)/batch=(\d+)$")


def _bucket(column: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


def _parts(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(bucket, batch) of the stored partitions, from their folders' names."""
    found = (PART.search(f) for f in files.glob_paths(spark, f"{path.rstrip('/')}/bucket=*/batch=*"))
    return sorted((int(m[1]), int(m[2])) for m in found if m)


def _folder(path: str, bucket: int, batch: int) -> str:
    return f"{path.rstrip('/')}/bucket={bucket}/batch={batch}"


def read_state(spark: SparkSession, path: str, before: int | None = None, only: Sequence[int] | None = None) -> DataFrame | None:
    """Current state: of each bucket the newest batch, or the newest below ``before``.

    ``only`` names the buckets to read.  Other buckets and batches are not listed even.
    None if nothing is stored there.
    """
    newest: dict[int, int] = {}
    for bucket, batch in _parts(spark, path):
        if (before is None or batch < before) and (only is None or bucket in only):
            newest[bucket] = batch  # sorted: the last one stays
    if not newest:
        return None
    return spark.read.option("basePath", path).parquet(*[_folder(path, *part) for part in newest.items()])


def _folded(updates: DataFrame) -> DataFrame:
    """One row for each updated action: newest non-null value of each field with its place in order."""
    order = F.struct("updated_at", "update_id")
    parts = []
    for c in FIELDS:
        at = F.when(F.col(c).isNotNull(), order)
        parts += [F.max_by(c, at).alias(f"_new_{c}"), F.max(at).alias(f"_new_{c}_at")]
    return updates.groupBy("id").agg(
        *parts, F.count(F.lit(1)).alias("_n"), F.max("updated_at").alias("_last")
    )


def fold_batch(
    spark: SparkSession, path: str, batch: int, actions: DataFrame, updates: DataFrame, buckets: int = BUCKETS, keep: int = 2
) -> DataFrame:
    """Fold a batch of new actions and updates into the stored state (D2); the rejected updates.

    Only buckets with an action or update of the batch are read, and they are written
    as partitions of this batch beside the older ones.  So a batch that was cut short
    is run again as a whole: it reads what stood before it and rewrites its own partitions.
    Per action the newest non-null status and note win by ``(updated_at, update_id)``, also
    over batches that come out of order.  An id that is stored already keeps its row; an
    update needs an action of this batch or an earlier one, others (also with a null id)
    are rejected.  Of each bucket the last ``keep`` batches stay; a reader may be that far behind.
    """
    if batch < 0 or keep < 2:
        raise ValueError("batch must be 0 or more and keep 2 or more")
    if any(b > batch for _, b in _parts(spark, path)):
        raise ValueError(f"a batch after {batch} is folded in already")
    at = _bucket("id", buckets)
    touched = actions.select(at.alias("b")).unionByName(updates.select(at.alias("b"))).distinct()
    only = sorted(r.b for r in touched.collect())  # as many as buckets at most
    held = read_state(spark, path, before=batch, only=only)
    place = f"struct<updated_at:{updates.schema['updated_at'].dataType.simpleString()},update_id:bigint>"
    rows = actions.select(
        "*",
        F.lit(0).cast("bigint").alias("update_count"),
        F.lit(None).cast(updates.schema["updated_at"].dataType).alias("last_updated_at"),
        *[F.lit(None).cast(place).alias(f"{c}_at") for c in FIELDS],
    )
    if held is not None:
        held = held.select(*rows.columns)
        rows = held.unionByName(rows.join(held.select("id"), "id", "left_anti"))
    both = rows.join(_folded(updates.where("id is not null")), "id", "left")
    out = {"update_count": F.col("update_count") + F.coalesce("_n", F.lit(0)), "last_updated_at": F.greatest("last_updated_at", "_last")}
    for c in FIELDS:
        newer = F.col(f"_new_{c}_at").isNotNull() & (F.col(f"{c}_at").isNull() | (F.col(f"_new_{c}_at") > F.col(f"{c}_at")))
        out[c] = F.when(newer, F.col(f"_new_{c}")).otherwise(F.col(c))
        out[f"{c}_at"] = F.when(newer, F.col(f"_new_{c}_at")).otherwise(F.col(f"{c}_at"))
    state = both.select(*[out[c].alias(c) if c in out else F.col(c) for c in rows.columns], at.alias("bucket"), F.lit(batch).alias("batch"))
    writer = state.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("bucket", "batch").parquet(path)
    _drop_older(spark, path, set(only), keep)
    now = read_state(spark, path, only=only)
    unknown = updates if now is None else updates.join(now.select("id"), "id", "left_anti")
    return stored(unknown.select(*updates.columns).withColumn("rejection_reason", F.lit("unknown_action")))


def _drop_older(spark: SparkSession, path: str, buckets: set[int], keep: int) -> None:
    """Delete all but the last ``keep`` batches of each of the buckets."""
    batches: dict[int, list[int]] = {}
    for bucket, batch in _parts(spark, path):
        batches.setdefault(bucket, []).append(batch)
    for bucket in buckets & set(batches):
        for batch in batches[bucket][:-keep]:
            files.delete_folder(spark, _folder(path, bucket, batch))
