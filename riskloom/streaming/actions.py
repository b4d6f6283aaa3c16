"""Micro-batch ingestion of action requests into the append-only action log.

Each micro-batch goes through :func:`riskloom.operators.actions.create_actions`
(entity check, field validation, as-of prediction attach) and is appended to
the accepted / rejected Parquet tables.  Progress is kept in a checkpoint under
the shared ``spark.checkpoint.dir``; a replayed batch overwrites only its own
``ingest_batch_id`` partition, so output stays exactly-once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from riskloom.operators.actions import create_actions
from riskloom.session import ensure_checkpoint_dir, stored

REQUEST_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("reservation_id", T.LongType()),
        T.StructField("action_type", T.StringType()),
        T.StructField("action_status", T.StringType()),
        T.StructField("action_note", T.StringType()),
        T.StructField("acted_by", T.StringType()),
        T.StructField("payload", T.StringType()),
        T.StructField("acted_at", T.TimestampNTZType()),
    ]
)


def start_action_ingest(
    spark: SparkSession,
    request_dir: str,
    entities: DataFrame,
    predictions: DataFrame,
    accepted_dir: str,
    rejected_dir: str,
    prediction_ties: Sequence[str] = (),
    checkpoint: str | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Start the ingest stream over Parquet request files in ``request_dir``."""
    ckpt = checkpoint or f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/action_ingest"
    requests = spark.readStream.schema(REQUEST_SCHEMA).parquet(request_dir)

    def handle(batch: DataFrame, batch_id: int) -> None:
        # The batch is stored once, and of the history only its entities' rows are read on.
        rows = stored(batch)
        keys = rows.select("reservation_id").distinct()
        own = predictions.join(keys, "reservation_id", "left_semi")
        known = entities.join(keys, "reservation_id", "left_semi")
        accepted, rejected = create_actions(rows, known, own, prediction_ties)
        # Re-running a batch after a failure rewrites exactly that batch's partition.
        for df, path in ((accepted, accepted_dir), (rejected, rejected_dir)):
            (
                df.withColumn("ingest_batch_id", F.lit(batch_id))
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy("ingest_batch_id")
                .parquet(path)
            )

    writer = requests.writeStream.foreachBatch(handle).option("checkpointLocation", ckpt)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
