"""CSV files as common writers make them: quotes, line breaks, column order, empty text."""

import pytest

from riskloom.sources import files, layers


def _write(path, text):
    path.write_text(text, encoding="utf-8", newline="")
    return str(path)


def test_quoted_fields_and_numbering(spark, tmp_path):
    one = _write(tmp_path / "H1.csv", 'a,"b, c",d\n1,"x ""q"" y, z",\n2,"two\nlines",  pad \n3,,end\n')
    got = sorted(tuple(r) for r in files.read_raw_csv(spark, [one]).select("source_row_number", "a", "`b, c`", "d").collect())
    assert got == [(1, "1", 'x "q" y, z', ""), (2, "2", "two\nlines", "  pad "), (3, "3", "", "end")]


def test_columns_meet_by_name(spark, tmp_path):
    one = _write(tmp_path / "H1.csv", "a,b,c\n1,2,3\n")
    two = _write(tmp_path / "H2.csv", "b,a,c\n20,10,30\n200,100,300\n")
    df = files.read_raw_csv(spark, [two, one])
    got = sorted((r.source_file, r.source_row_number, r.a, r.b, r.c) for r in df.collect())
    assert got == [("H1.csv", 1, "1", "2", "3"), ("H2.csv", 1, "10", "20", "30"), ("H2.csv", 2, "100", "200", "300")]


def test_written_text_reads_back(spark, tmp_path):
    texts = ['say "hi", now', "back\\slash", "two\nlines", "", " blanks ", "comma, comma", "'single'"]
    df = spark.createDataFrame([(str(i), t, "H1.csv") for i, t in enumerate(texts)], "k string, v string, source_file string")
    files.write_raw_csv_files(df, str(tmp_path / "out"))
    back = files.read_raw_csv(spark, [str(tmp_path / "out")], source_col="source_file")
    assert {r.k: r.v for r in back.collect()} == {str(i): t for i, t in enumerate(texts)}
    assert sorted(r.source_row_number for r in back.collect()) == list(range(1, len(texts) + 1))


def test_numbers_are_dense_over_many_splits(spark, tmp_path):
    spark.range(5000).selectExpr("cast(id as string) as k", "concat('H', id % 2) as source_file").repartition(7).createOrReplaceTempView("t")
    files.write_raw_csv_files(spark.table("t"), str(tmp_path / "out"))
    back = files.read_raw_csv(spark, [str(tmp_path / "out")], columns=["k"], source_col="source_file", multi_line=False)
    got = back.groupBy("source_file").agg({"source_row_number": "max", "k": "count"}).collect()
    assert sorted(tuple(r) for r in got) == [("H0", 2500, 2500), ("H1", 2500, 2500)]
    assert back.select("reservation_key").distinct().count() == 5000


def test_malformed_records_are_quarantined(spark, tmp_path):
    one = _write(tmp_path / "H1.csv", 'a,b,c\n1,2,3\n1,2,3,4\n"x, y","q ""z""",\n1,2\n\n5,6,7\n"p ""q"", r",s\n')
    two = _write(tmp_path / "H2.csv", "c,b,a\n3,2,1\n")
    for multi_line in (True, False):
        rows, errors = files.scan_raw_csv(spark, [one, two], multi_line=multi_line)
        got = sorted((r.source_file, r.source_row_number, r.a, r.b, r.c) for r in rows.collect())
        assert got == [("H1.csv", 1, "1", "2", "3"), ("H1.csv", 3, "x, y", 'q "z"', ""), ("H1.csv", 5, "5", "6", "7"), ("H2.csv", 1, "1", "2", "3")]
        assert rows.columns == ["a", "b", "c", "source_file", "source_row_number", "reservation_key"]
        bad = sorted((r.source_file, r.source_row_number, r.raw_record, r.error_code, r.error_message) for r in errors.collect())
        assert bad == [
            ("H1.csv", 2, "1,2,3,4", "too_many_fields", "expected 3 fields, found 4"),
            ("H1.csv", 4, "1,2", "too_few_fields", "expected 3 fields, found 2"),
            ("H1.csv", 6, '"p ""q"", r",s', "too_few_fields", "expected 3 fields, found 2"),
        ]
    with pytest.raises(ValueError, match="H1.csv record 2: expected 3 fields, found 4"):
        files.read_raw_csv(spark, [one, two])
    batch = layers.import_batch(rows, "test", "v1", errors).first()
    assert (batch.source_files, batch.row_count, batch.error_count) == ("H1.csv,H2.csv", 4, 3)
    kept = layers.error_layer(errors).orderBy("source_row_number").first()
    assert kept.raw_payload == '{"raw_record":"1,2,3,4"}' and kept.source_row_number == 2


def test_headers_without_a_job(spark, tmp_path):
    """Quoted line breaks, byte order mark, leading blank line, unnamed and repeated names."""
    path = _write(tmp_path / "H1.csv", '\ufeff"a\nb",,c,C\n1,2,3,4\n')
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup())
    before = jobs()
    assert files.header_columns(spark, path) == ["a\nb", "_c1", "c2", "C3"]
    assert jobs() == before
    blank = _write(tmp_path / "H2.csv", "\n  \na,b\n1,2\n")
    assert files.header_columns(spark, blank) == ["a", "b"]
    with pytest.raises(ValueError, match="Empty"):
        files.header_columns(spark, _write(tmp_path / "H3.csv", ""))
    with pytest.raises(ValueError, match="named"):
        files.scan_raw_csv(spark, [path], header=False)
    plain = _write(tmp_path / "H4.csv", "1,2\n3,4\n5\n")
    rows, errors = files.scan_raw_csv(spark, [plain], columns=["a", "b"], header=False)
    assert sorted((r.source_row_number, r.a, r.b) for r in rows.collect()) == [(1, "1", "2"), (2, "3", "4")]
    assert [(r.source_row_number, r.raw_record) for r in errors.collect()] == [(3, "5")]


def test_snapshot_folder_meets_by_name(spark, tmp_path):
    """Files with other column orders, another column, and the snapshot's own source_file."""
    _write(tmp_path / "s1.csv", "a,b,source_file\n10,20,H1\n")
    _write(tmp_path / "s2.csv", "b,a,source_file\n21,11,H2\n22,12,H2,surplus\n")
    _write(tmp_path / "s3.csv", "a,d,source_file\n13,40,H3\n")
    rows, errors = files.scan_snapshot_csv(spark, str(tmp_path))
    got = sorted((r.a, r.b, r.d, r.source_file) for r in rows.collect())
    assert got == [("10", "20", None, "H1"), ("11", "21", None, "H2"), ("13", None, "40", "H3")]
    assert [(r.source_file, r.source_row_number, r.error_code) for r in errors.collect()] == [("s2.csv", 2, "too_many_fields")]
    with pytest.raises(ValueError, match="s2.csv record 2"):
        files.read_snapshot_csv(spark, str(tmp_path))
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError, match="No CSV"):
        files.read_snapshot_csv(spark, str(tmp_path / "empty"))


def test_artifact_readers(spark, tmp_path):
    """Types come back from text, broken values as null."""
    text = 'reservation_key,arrival_date,scored_at,score,threshold_used,note\nk1,2016-07-01,2017-01-01T00:00:00,0.42,0.35,"a ""b"", c"\nk2,soon,never,high,,\n'
    preds = files.read_artifact_predictions(spark, _write(tmp_path / "p.csv", text))
    one, two = preds.orderBy("reservation_key").collect()
    assert (str(one.arrival_date), one.score, one.threshold_used, one.note) == ("2016-07-01", 0.42, 0.35, 'a "b", c')
    assert one.scored_at is not None and (two.arrival_date, two.scored_at, two.score, two.threshold_used) == (None,) * 4
    rows = [("k1", "2016-07-01", "1", None), ("k2", None, "x", True)]
    spark.createDataFrame(rows, "reservation_key string, arrival_date string, no_show_flag string, excluded_from_training boolean").write.parquet(
        str(tmp_path / "clean")
    )
    one, two = files.read_artifact_clean(spark, str(tmp_path / "clean")).orderBy("reservation_key").collect()
    assert (str(one.arrival_date), one.no_show_flag, one.excluded_from_training) == ("2016-07-01", 1.0, False)
    assert (two.arrival_date, two.no_show_flag, two.excluded_from_training) == (None, None, True)
    preds.write.parquet(str(tmp_path / "p"))
    assert files.read_artifact_predictions(spark, str(tmp_path / "p")).count() == 2
