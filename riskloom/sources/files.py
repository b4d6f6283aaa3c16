"""File sources and sinks: all-string CSV scans with per-file row numbers,
dataset / summary sinks, run-versioned output trees and the artifact store.

Paths may be local or any Hadoop file system; existence checks go through the
JVM ``FileSystem`` so they work the same on a cluster.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.session import stored


def _fs_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs_path(spark, path)
    return bool(fs.exists(p))


def glob_paths(spark: SparkSession, pattern: str) -> list[str]:
    fs, p = _fs_path(spark, pattern)
    return sorted(str(s.getPath().toString()) for s in fs.globStatus(p) or [])


def delete_folder(spark: SparkSession, path: str) -> None:
    fs, p = _fs_path(spark, path)
    fs.delete(p, True)


def list_files(spark: SparkSession, directory: str, suffix: str = ".csv") -> list[str]:
    fs, p = _fs_path(spark, directory)
    if not fs.exists(p):
        return []
    return sorted(str(s.getPath().toString()) for s in fs.listStatus(p) if s.getPath().getName().endswith(suffix))


def require_inputs(spark: SparkSession, paths: Iterable[str]) -> list[str]:
    """All inputs must exist; the error lists every missing one."""
    paths = list(paths)
    missing = [p for p in paths if not path_exists(spark, p)]
    if missing:
        raise FileNotFoundError(f"Missing required input files: {missing}")
    return paths


def all_string_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType(), True) for c in columns])


# Text fields as common CSV writers put them: quoted where needed, quotes doubled.
CSV_RULES = {"header": "true", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
# A value that no field holds: so no text reads as a missing value.
_NO_NULL = "\u0001no null\u0001"


# Holds the text of a record whose number of fields differs from the header's.
RECORD = "_record"
ERROR_COLUMNS = ("source_file", "source_row_number", "raw_record", "error_code", "error_message")


def _first_record(spark: SparkSession, path: str) -> str:
    """The first record that is not blank, with the line breaks its quotes hold."""
    fs, p = _fs_path(spark, path)
    jvm = spark.sparkContext._jvm
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(fs.open(p), "UTF-8"))
    try:
        record = ""
        while (line := reader.readLine()) is not None:
            record += line
            if record.strip() and record.count('"') % 2 == 0:
                break
            record = record + "\n" if record.strip() else ""
        return record.removeprefix("\ufeff")
    finally:
        reader.close()


def header_columns(spark: SparkSession, path: str) -> list[str]:
    """Column names of one CSV file: one read of its first record, no Spark job.

    An unnamed column gets its place as a name, a repeated name its place behind it.
    """
    names = next(csv.reader(io.StringIO(_first_record(spark, path))), [])
    if not names:
        raise ValueError(f"Empty CSV file: {path}")
    names = [n or f"_c{i}" for i, n in enumerate(names)]
    lower = [n.lower() for n in names]
    return [n if lower.count(n.lower()) == 1 else f"{n}{i}" for i, n in enumerate(names)]


def header_groups(spark: SparkSession, paths: Sequence[str]) -> dict[tuple[str, ...], list[str]]:
    """Files by their header; the headers are read side by side."""
    found = _csv_files(spark, paths)
    out: dict[tuple[str, ...], list[str]] = {}
    with ThreadPoolExecutor(16) as pool:
        for path, names in zip(found, pool.map(lambda f: header_columns(spark, f), found), strict=True):
            out.setdefault(tuple(names), []).append(path)
    return out


def _csv_files(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """The files under some paths: files as they are, folders by what they hold."""
    out: list[str] = []
    for path in paths:
        fs, p = _fs_path(spark, path)
        if fs.getFileStatus(p).isFile():
            out.append(path)
            continue
        it = fs.listFiles(p, True)
        while it.hasNext():
            found = it.next().getPath()
            if found.getName().endswith(".csv"):
                out.append(found.toString())
    return sorted(out)


def _text_scan(
    spark: SparkSession, paths: Sequence[str], columns: Sequence[str], multi_line: bool, base: str | None, header: bool = True
) -> DataFrame:
    """All columns as text, the text of malformed records, and each record's place."""
    reader = (
        spark.read.schema(all_string_schema([*columns, RECORD])).options(**CSV_RULES)
        .option("header", str(header).lower()).option("multiLine", str(multi_line).lower())
        .option("nullValue", _NO_NULL).option("emptyValue", "")
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", RECORD)
    )
    if base:
        reader = reader.option("basePath", base)
    df = reader.csv(list(paths)).withColumns(
        {"_file": F.col("_metadata.file_name"), "_path": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start")}
    )
    # The parser hands an empty field on as null; here it is the empty text.
    return df.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in columns}).withColumn("_fields", F.lit(len(columns)))


def _scan_groups(
    spark: SparkSession, groups: dict, multi_line: bool, base: str | None, source: str | None, header: bool = True
) -> DataFrame:
    """One stored scan for each header, joined by column name; malformed records included."""
    out = None
    for names, paths in groups.items():
        df = _text_scan(spark, paths, names, multi_line, base, header)
        df = df.select(
            *names,
            F.col(source or "_file").cast("string").alias("source_file"),
            RECORD, "_fields", "_path", "_block",
            F.monotonically_increasing_id().alias("_mid"),
        )
        df = stored(df)  # one scan fixes the rows, their places and what is malformed
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def _split_malformed(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of numbered records."""
    # Quoted stretches hold no separators; a doubled quote is two stretches side by side.
    bare = F.regexp_replace(RECORD, r'"[^"]*+"', "")
    found = F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1
    code = F.when(found < F.col("_fields"), "too_few_fields").when(found > F.col("_fields"), "too_many_fields").otherwise("unreadable")
    errors = numbered.where(F.col(RECORD).isNotNull()).select(
        "source_file",
        "source_row_number",
        F.rtrim(RECORD, F.lit("\r\n")).alias("raw_record"),
        code.alias("error_code"),
        F.format_string("expected %d fields, found %d", "_fields", found).alias("error_message"),
    )
    return numbered.where(F.col(RECORD).isNull()).drop(RECORD, "_fields"), errors


def require_well_formed(errors: DataFrame, shown: int = 5) -> None:
    """Raise if there is a malformed record; the error names the first ones by file and place."""
    first = errors.orderBy("source_file", "source_row_number").limit(shown).collect()
    if first:
        where = "; ".join(f"{r.source_file} record {r.source_row_number}: {r.error_message}" for r in first)
        raise ValueError(f"Malformed CSV records: {where}")


def scan_raw_csv(
    spark: SparkSession,
    paths: Sequence[str],
    columns: Sequence[str] | None = None,
    multi_line: bool = True,
    source_col: str | None = None,
    header: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of a CSV scan with every column as text.

    A record with more or fewer fields than its file's header is no row: it goes to
    ``errors`` with its file, its number, its text, a code and a message.  Records are
    numbered with the malformed ones among them, so a number is a place in the source.

    Quoted commas, doubled quotes and line breaks in fields read as they were
    written; an empty field is an empty text.  Files may order their columns
    differently: files with one header are one scan, and scans meet by column
    name.  ``columns`` skips the header pass when all files are known to agree;
    files without a header line need it, with ``header=False``.

    ``multi_line=False`` lets Spark split large files; it is right only for
    files whose fields hold no line breaks, which the caller must know.

    Adds ``source_file`` (the file's base name, or the value of ``source_col``
    when a source is a ``source_col=value`` folder of several files), a 1-based
    ``source_row_number`` per source (S2) and ``reservation_key``.
    """
    paths = require_inputs(spark, sorted(paths))
    if columns is None and not header:
        raise ValueError("files without a header need their columns named")
    groups = header_groups(spark, paths) if columns is None else {tuple(columns): list(paths)}
    base = paths[0] if source_col and len(paths) == 1 else None
    return _split_malformed(number_rows_per_file(_scan_groups(spark, groups, multi_line, base, source_col, header)))


def read_raw_csv(
    spark: SparkSession,
    paths: Sequence[str],
    columns: Sequence[str] | None = None,
    multi_line: bool = True,
    source_col: str | None = None,
    header: bool = True,
) -> DataFrame:
    """Rows of ``scan_raw_csv``; a malformed record is an error."""
    rows, errors = scan_raw_csv(spark, paths, columns, multi_line, source_col, header)
    require_well_formed(errors)
    return rows


def scan_snapshot_csv(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of a snapshot file or a folder of them: all text, own key columns.

    Files of a folder may order their columns differently; they meet by name, and a
    column that a file lacks is null there.  The numbers of ``errors`` count the records
    of a file; rows carry none.
    """
    (path,) = require_inputs(spark, [path])
    groups = header_groups(spark, [path])
    if not groups:
        raise ValueError(f"No CSV file in {path}")
    # A snapshot's own source_file column stays; the file's name is needed for errors only.
    own = "_own_source_file"
    out, bad = None, None
    for names, paths in groups.items():
        df = _text_scan(spark, paths, names, multi_line, None)
        columns = [F.col(n).alias(own) if n == "source_file" else F.col(n) for n in names]
        df = stored(
            df.select(
                *columns, F.col("_file").alias("source_file"), RECORD, "_fields", "_path", "_block",
                F.monotonically_increasing_id().alias("_mid"),
            )
        )
        rows = df.where(F.col(RECORD).isNull())
        rows = rows.select(*[F.col(own).alias(n) if n == "source_file" else F.col(n) for n in names])
        keep = df.select("source_file", RECORD, "_fields", "_path", "_block", "_mid")
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        bad = keep if bad is None else bad.unionByName(keep)
    return out, _split_malformed(number_rows_per_file(bad))[1]


def read_snapshot_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Rows of ``scan_snapshot_csv``; a malformed record is an error."""
    rows, errors = scan_snapshot_csv(spark, path, multi_line)
    require_well_formed(errors)
    return rows


def number_rows_per_file(df: DataFrame) -> DataFrame:
    """1-based row number per ``source_file`` from (``_path``, ``_block``, ``_mid``).

    Rows of one file split are contiguous in one task, so the place inside the
    split is ``_mid - min(_mid)``; the splits' row counts (one row for each split)
    are summed in (path, block) order per source and joined back.  The input must be
    stored, so that both uses see the same places.
    """
    cell = ["source_file", "_path", "_block"]
    splits = df.groupBy(*cell).agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    w = Window.partitionBy("source_file").orderBy("_path", "_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(*cell, "_first", F.coalesce(F.sum("_rows").over(w), F.lit(0)).alias("_before"))
    row = (F.col("_before") + F.col("_mid") - F.col("_first") + 1).cast("bigint")
    return df.join(offsets, cell).select(
        *[c for c in df.columns if c not in ("_path", "_block", "_mid")],
        row.alias("source_row_number"),
        F.concat(F.col("source_file"), F.lit(":"), row.cast("string")).alias("reservation_key"),
    )


def write_dataset(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Dataset sink (S6): Parquet by default, CSV with header on request."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.options(**CSV_RULES).option("emptyValue", "").csv(path)
    else:
        w.format(fmt).save(path)


def write_raw_csv_files(df: DataFrame, directory: str, file_col: str = "source_file", columns: Sequence[str] = ()) -> None:
    """Write one CSV directory per source value (``file_col=value/part-*.csv``).

    No repartition by source: every task writes its own part files, so a
    source holding a third of the rows is still written in parallel.
    """
    cols = list(columns) or [c for c in df.columns if c != file_col]
    (
        df.select(*cols, file_col).write.mode("overwrite").partitionBy(file_col)
        .options(**CSV_RULES)
        .option("emptyValue", "")
        .csv(directory)
    )


def write_summary(df: DataFrame, path: str) -> None:
    """One-row summary as JSON."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_policy(spark: SparkSession, policy_record: dict, path: str) -> None:
    """Feature policy sink (S24): version, feature lists and exclusion lists."""
    schema = T.StructType(
        [T.StructField(k, T.StringType() if isinstance(v, str) else T.ArrayType(T.StringType())) for k, v in policy_record.items()]
    )
    write_summary(spark.createDataFrame([tuple(policy_record.values())], schema), path)


def run_paths(root: str, run_id: str) -> dict[str, str]:
    """Run-versioned output tree (S8): models / reports / predictions / datasets."""
    base = f"{root.rstrip('/')}/{run_id}"
    return {k: f"{base}/{k}" for k in ("models", "reports", "predictions", "datasets")}


def read_artifact_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Prediction artifact scan + tolerant re-typing."""
    df = spark.read.options(**CSV_RULES).csv(path) if path.endswith(".csv") else spark.read.parquet(path)
    text = lambda c: F.col(c).cast("string")
    typed = {
        "arrival_date": lambda c: F.try_to_date(text(c)),
        "scored_at": lambda c: F.try_to_timestamp(text(c)),
        "score": lambda c: text(c).try_cast("double"),
        "threshold_used": lambda c: text(c).try_cast("double"),
    }
    return df.withColumns({c: read(c) for c, read in typed.items() if c in df.columns})


def read_artifact_clean(spark: SparkSession, path: str) -> DataFrame:
    """Clean artifact scan + re-typing; missing exclusion flag -> false."""
    df = spark.read.parquet(path)
    cols = {}
    if "arrival_date" in df.columns:
        cols["arrival_date"] = F.try_to_date(F.col("arrival_date").cast("string"))
    if "no_show_flag" in df.columns:
        cols["no_show_flag"] = F.col("no_show_flag").cast("string").try_cast("double")
    if "excluded_from_training" in df.columns:
        cols["excluded_from_training"] = F.coalesce(F.col("excluded_from_training").cast("boolean"), F.lit(False))
    return df.withColumns(cols)


def write_document(spark: SparkSession, document: dict, path: str) -> None:
    """A small JSON document as a folder with one text file, on any file system."""
    spark.createDataFrame([(json.dumps(document, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_summary(spark: SparkSession, path: str) -> dict:
    """A document of ``write_document`` (S12); empty if there is none."""
    if not path_exists(spark, path):
        return {}
    rows = spark.read.text(path).limit(1).collect()
    return json.loads(rows[0][0]) if rows else {}


def run_ids(spark: SparkSession, root: str) -> list[str]:
    """Finished runs under ``root``, oldest first: a run is finished once its summary stands."""
    fs, p = _fs_path(spark, root)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    return sorted(n for n in names if path_exists(spark, f"{root.rstrip('/')}/{n}/reports/{SUMMARY}"))


SUMMARY = "evaluation_summary"


def latest_run(spark: SparkSession, root: str) -> str | None:
    """Folder of the newest finished run: a view by name, no copy of its files."""
    ids = run_ids(spark, root)
    return f"{root.rstrip('/')}/{ids[-1]}" if ids else None


def recommended_model(summary: dict, default: str = "logistic_regression") -> tuple[str, str | None]:
    name = str(summary.get("recommended_model", default))
    return name, summary.get("models", {}).get(name, {}).get("model_version")


def artifacts_exist(spark: SparkSession, root: str) -> bool:
    """Whether a run under ``root`` left its summary and its clean dataset."""
    run = latest_run(spark, root)
    return run is not None and path_exists(spark, f"{run}/datasets/reservations_clean")
