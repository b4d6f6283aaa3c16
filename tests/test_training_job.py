import os

import pytest

from tests.conftest import SMALL_SF


@pytest.mark.skipif(not os.path.isdir(SMALL_SF), reason="driver tables not present")
def test_training_run_writes_versioned_tree(spark, tmp_path):
    from riskloom import jobs
    from riskloom.sources import adapter, files

    raw = adapter.raw_reservations(spark, SMALL_SF)
    csv_dir = str(tmp_path / "raw")
    files.write_raw_csv_files(raw, csv_dir, "source_file", list(adapter.RAW_COLUMNS))
    run_dir = jobs.run_training(
        spark, "booking_time", csv_dir, str(tmp_path / "out"), run_id="20260101T000000Z",
        train_years=(1995, 1996, 1997, 1998, 1999), test_years=(2000, 2001), kinds=("logistic_regression",),
    )
    preds = spark.read.parquet(f"{run_dir}/predictions/predictions")
    assert preds.count() > 0
    assert preds.filter("score < 0 OR score > 1").count() == 0
    assert {r[0] for r in preds.select("scoring_run_id").distinct().collect()} == {"booking_time-20260101T000000Z"}
    metrics = spark.read.parquet(f"{run_dir}/reports/metrics").collect()
    assert len(metrics) == 1 and 0.0 <= metrics[0].roc_auc <= 1.0
    assert spark.read.parquet(f"{run_dir}/datasets/reservations_clean").count() == raw.count()
    assert spark.read.json(f"{run_dir}/reports/feature_list").first().feature_set_version == "booking_time_v1"
    summary = files.read_summary(spark, f"{run_dir}/reports/{files.SUMMARY}")
    assert summary["recommended_model"] == "logistic_regression" and summary["models"]["logistic_regression"]["metrics"]
    root = str(tmp_path / "out")
    assert files.latest_run(spark, root) == run_dir and files.artifacts_exist(spark, root)
    assert files.read_summary(spark, f"{run_dir}/reports/import_summary")["row_count_raw"] == raw.count()
    split = files.read_summary(spark, f"{run_dir}/reports/split_summary")
    assert split["test_row_count"] == preds.count() and split["train_years"]
    from pyspark.ml import PipelineModel

    assert PipelineModel.load(f"{run_dir}/models/logistic_regression") is not None


def _csv(spark, df, path):
    df.coalesce(1).write.option("header", "true").csv(str(path))
    return str(next(path.glob("part-*.csv")))


def _snapshots(spark, stage):
    """Rows of a snapshot stage: no optional columns, 170 countries, all agents missing."""
    from pyspark.sql import functions as F
    from tests.fixtures import snapshot_fixture

    base = snapshot_fixture(spark).where("final_outcome != 'Canceled'").drop(
        "booking_changes_as_of_cutoff", "days_in_waiting_list_as_of_cutoff"
    )
    many = base.crossJoin(spark.range(340).withColumnRenamed("id", "n"))
    row = (F.col("source_row_number").cast("long") * 1000 + F.col("n")).cast("string")
    return many.select(
        *[
            {
                "snapshot_stage": F.lit(stage).alias("snapshot_stage"),
                "country_code": F.concat(F.lit("C"), F.col("n") % 170).alias("country_code"),
                "source_row_number": row.alias("source_row_number"),
                "reservation_key": F.concat(F.lit("H1.csv:"), row).alias("reservation_key"),
                "final_outcome": F.when(F.col("n") % 3 == 0, "No-Show").otherwise("Check-Out").alias("final_outcome"),
                "is_active_at_snapshot": F.lit("true").alias("is_active_at_snapshot"),
                "adr": (F.col("n") % 90).cast("string").alias("adr"),
            }.get(c, F.col(c))
            for c in base.columns
        ]
    )


@pytest.mark.parametrize("stage", ["post_booking_day_1", "post_booking_day_4"])
def test_snapshot_stage_run(spark, tmp_path, stage):
    from riskloom import jobs
    from riskloom.operators.ml import GBTParams
    from riskloom.sources import files

    path = _csv(spark, _snapshots(spark, stage), tmp_path / "snap")
    run_dir = jobs.run_training(
        spark, stage, None, str(tmp_path / "out"), run_id="r1", snapshot_path=path, gbt=GBTParams(max_depth=2, max_iter=3)
    )
    assert f"/{stage}/" in run_dir
    preds = spark.read.parquet(f"{run_dir}/predictions/predictions")
    assert {r[0] for r in preds.select("model_name").distinct().collect()} == {"logistic_regression", "gbt"}
    assert preds.where("score between 0 and 1 and snapshot_stage is not null and days_to_arrival is not null").count() == preds.count()
    assert preds.select("prediction_id").distinct().count() == preds.count() > 0
    assert set(files.read_summary(spark, f"{run_dir}/reports/{files.SUMMARY}")["models"]) == {"logistic_regression", "gbt"}
    with pytest.raises(ValueError, match="layers"):
        jobs.run_training(spark, stage, None, str(tmp_path / "out"), snapshot_path=path, store=str(tmp_path / "store"))


def test_run_appends_layers(spark, tmp_path):
    from riskloom import jobs
    from riskloom.sources import files, layers
    from tests.fixtures import RAW_COLUMNS, raw_fixture

    cols = [c for c in RAW_COLUMNS if c not in ("source_file", "reservation_key")]
    rows = raw_fixture(spark)
    rows = rows.unionByName(rows.withColumn("source_row_number", rows["source_row_number"] + 10))
    files.write_raw_csv_files(rows.drop("source_row_number"), str(tmp_path / "raw"), "source_file", cols)
    store = str(tmp_path / "store")
    for run in ("r1", "r2", "r2"):  # a rerun replaces its own rows
        jobs.run_training(
            spark, "booking_time", str(tmp_path / "raw"), str(tmp_path / "out"), run_id=run,
            kinds=("logistic_regression",), store=store,
        )
    for name, count in zip(layers.LAYERS, (1, 8, 8, 8, 2), strict=True):
        got = layers.read_layer(spark, store, name)
        assert {r[0]: r[1] for r in got.groupBy("run_id").count().collect()} == {
            "booking_time-r1": count, "booking_time-r2": count
        }, name
    clean = layers.read_layer(spark, store, "reservations_clean").where("run_id like '%r1'")
    raw = layers.read_layer(spark, store, "reservations_raw").where("run_id like '%r1'")
    keys = raw.selectExpr("concat_ws(':', source_file, source_row_number) as raw_key")
    assert clean.join(keys, "raw_key").count() == 8
    assert files.latest_run(spark, str(tmp_path / "out")).endswith("/r2")
