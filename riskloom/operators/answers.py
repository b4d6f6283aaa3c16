"""Composed answers: dashboard, queue, labelled reports, benchmark document.

Each takes a resolved source and says which one served it.  One-row answers
hold a page (at most ``MAX_PAGE_SIZE`` items), counts and dimension values; rows
beyond a page never meet in one value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import config
from riskloom.operators import evaluate, queue, reports
from riskloom.session import stored
from riskloom.sources.resolver import Source

RISKY_FIELDS = ("reservation_id", "property_id", "arrival_date", "distribution_channel", "risk_class", "score", "model_version")
QUEUE_FIELDS = (
    "reservation_id", "property_id", "source_file", "arrival_date", "distribution_channel", "customer_type",
    "no_show_flag", "score", "risk_class", "model_name", "model_version", "scored_at",
)
RISKY_ITEMS = {config.STORE_SOURCE: 8, config.ARTIFACT_SOURCE: 12}


def labelled(report: DataFrame, source: Source) -> DataFrame:
    """A report's rows with the source that served them."""
    return report.withColumns(
        {"data_source": F.lit(source.label), "action_support_enabled": F.lit(source.writable)}
    )


def _zero_row(source: Source, names: Sequence[str], note: str) -> DataFrame:
    zero = lambda n: F.lit(0.0) if n.endswith("_rate") else F.lit(0).cast("bigint")
    one = source.rows.sparkSession.range(1)
    return one.select(*[zero(n).alias(n) for n in names], F.lit(note).alias("note"))


def operations_report(source: Source) -> DataFrame:
    """Operations summary of any source; zeros and a note while nothing is scored."""
    if source.label == config.BOOTSTRAP_SOURCE:
        out = _zero_row(source, reports.SUMMARY_COLUMNS, config.SUMMARY_NOTES[source.label])
    elif source.label == config.STORE_SOURCE:
        out = reports.operations_summary(source.rows, source.actions).withColumn("note", F.lit(None).cast("string"))
    else:
        out = reports.operations_summary(source.rows, None, store_rules=False)
    return labelled(out, source)


def _reported(source: Source) -> DataFrame:
    """Rows of the list reports; without scores these are empty."""
    return source.rows.limit(0) if source.label == config.BOOTSTRAP_SOURCE else source.rows


def trends_report(source: Source) -> DataFrame:
    return labelled(reports.trends(_reported(source), store_rules=source.label != config.ARTIFACT_SOURCE), source)


def breakdown_report(source: Source, dimension: str) -> DataFrame:
    rules = source.label != config.ARTIFACT_SOURCE
    return labelled(reports.dimension_breakdown(_reported(source), dimension, store_rules=rules), source)


def action_report(source: Source) -> DataFrame:
    """Action coverage with its breakdowns by status and type as ordered lists; one row."""
    none = F.lit(None).cast("array<struct<label:string,count:bigint>>")
    if source.label == config.STORE_SOURCE:
        out = reports.action_effectiveness(source.rows, source.actions)
        parts = [out]
        for by, name in (("action_status", "status_breakdown"), ("action_type", "type_breakdown")):
            counts = reports.action_breakdown(source.actions, by)
            order = F.struct((-F.col("count")).alias("o"), "label", "count")
            listed = F.transform(F.array_sort(F.collect_list(order)), lambda x: F.struct(x["label"], x["count"]))
            parts.append(counts.agg(listed.alias(name)))
        names = [*reports.EFFECTIVENESS_COLUMNS, "status_breakdown", "type_breakdown"]
        out = reports.one_row(parts, names).withColumn("note", F.lit(None).cast("string"))
    else:
        if source.label == config.ARTIFACT_SOURCE:
            # An entity is one row of the view, so its key stands for the id that a page would number.
            rows = source.rows.withColumn("reservation_id", F.struct("source_file", "source_row_number"))
            out = reports.action_effectiveness(rows, None)
        else:
            out = _zero_row(source, reports.EFFECTIVENESS_COLUMNS, config.ACTION_NOTES[source.label])
        out = out.withColumns({"status_breakdown": F.coalesce(none, F.array()), "type_breakdown": F.coalesce(none, F.array())})
        out = out.select(*reports.EFFECTIVENESS_COLUMNS, "status_breakdown", "type_breakdown", "note")
    return labelled(out, source)


def _items(page: DataFrame, order: Sequence[Column], fields: Sequence[str]) -> DataFrame:
    """A page as one row with a list of structs in ``order``; ``place`` counts from 1."""
    from pyspark.sql import Window

    placed = page.withColumn("_place", F.row_number().over(Window.orderBy(*order)))  # a page: at most MAX_PAGE_SIZE rows
    items = F.collect_list(F.struct(F.col("_place").alias("place"), *fields))
    return placed.agg(F.array_sort(items).alias("items"))


def dashboard_summary(source: Source, limit: int | None = None) -> DataFrame:
    """KPIs, the riskiest entities, and the status of scoring in one row."""
    limit = queue.check_page_size(limit or RISKY_ITEMS.get(source.label, 1))
    if source.label == config.ARTIFACT_SOURCE:
        kpis = reports.kpis_artifact(source.rows, source.model_name, source.model_version)
        kpis = kpis.withColumns({c: F.lit(0).cast("bigint") for c in reports.KPI_COLUMNS[4:]})
        view = source.rows.select(*RISKY_FIELDS[1:], "source_file", "source_row_number")
        page, order = queue.numbered_page(view, limit, F.col("risk_class").isin("high", "medium")), queue.artifact_order()
    else:
        latest = source.rows.where("score is not null") if source.latest is None else source.latest
        predictions = latest if source.predictions is None else source.predictions
        kpis = reports.kpis(source.entities, latest, predictions, source.actions)
        kpis = kpis.withColumns({c: F.lit(None).cast("string") for c in ("active_model_name", "active_model_version")})
        scored = source.rows.where("model_version is not null")  # inner join: entities with a prediction
        page = queue.risky_page(scored.select(*RISKY_FIELDS), limit, None, id_ascending=False, with_arrival=False)
        order = [F.col("score").desc_nulls_last(), F.col("reservation_id").desc()]
    names = [*reports.KPI_COLUMNS, "active_model_name", "active_model_version"]
    both = reports.one_row([kpis.select(F.struct(*names).alias("kpis")), _items(page, order, RISKY_FIELDS)], ["kpis", "items"])
    both = both.withColumn("scoring_status", F.lit(source.status))
    return labelled(both, source)


def queue_answer(source: Source, limit: int = queue.DEFAULT_PAGE_SIZE, **filters) -> DataFrame:
    """Total and page under one filter, and the choices of the filter form, in one row (R2).

    The choices come with an artifact only; a store answers with the fixed risk classes.
    """
    limit = queue.check_page_size(limit)
    rows = queue.apply_filters(source.rows, **filters)
    if source.label != config.ARTIFACT_SOURCE:
        rows = stored(rows.select(*QUEUE_FIELDS))  # for total and page alike; an artifact's page stores its view
    total = rows.agg(F.count(F.lit(1)).cast("bigint").alias("total"))
    classes = F.lit("high|medium|low")
    listed = lambda c: F.split(c, r"\|")
    if source.label == config.ARTIFACT_SOURCE:
        fields = [c for c in QUEUE_FIELDS if c not in ("reservation_id", "source_file")]
        view = source.rows.withColumn("no_show_flag", F.col("no_show_flag").cast("bigint"))
        view = view.select(*fields, "source_file", "source_row_number")
        page, order = queue.numbered_page(view, limit, queue.filter_condition(**filters)), queue.artifact_order()
        choices = queue.filter_option_rows(source.rows)  # distinct values first, so the lists hold no repeats
        choices = choices.agg(
            F.array_sort(F.collect_list(F.when(F.col("option") == "property_id", F.col("value")))).alias("property_ids"),
            F.array_sort(F.collect_list(F.when(F.col("option") == "distribution_channel", F.col("value")))).alias("distribution_channels"),
        )
        dates = source.rows.agg(F.min("arrival_date").alias("min_arrival_date"), F.max("arrival_date").alias("max_arrival_date"))
        form = reports.one_row([choices, dates], ["property_ids", "distribution_channels", "min_arrival_date", "max_arrival_date"])
    else:
        page, order = queue.queue_page(rows, limit), queue.queue_order()
        none = F.array().cast("array<string>")
        form = rows.sparkSession.range(1).select(
            none.alias("property_ids"), none.alias("distribution_channels"),
            F.lit(None).cast("date").alias("min_arrival_date"), F.lit(None).cast("date").alias("max_arrival_date"),
        )
    form = form.select(
        F.struct(
            "property_ids", "distribution_channels", listed(classes).alias("risk_classes"), "min_arrival_date", "max_arrival_date",
            F.lit(source.model_name).cast("string").alias("model_name"),
            F.lit(source.model_version).cast("string").alias("model_version"),
        ).alias("filters")
    )
    both = reports.one_row([total, _items(page, order, QUEUE_FIELDS), form], ["total", "items", "filters"])
    return labelled(both, source)


# --- benchmark document -----------------------------------------------------------------


def _by_model(long: DataFrame, fields: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """A long table as one map of model to its rows in order."""
    from pyspark.sql import Window

    w = Window.partitionBy("model_name").orderBy(*order)
    placed = long.withColumn("_place", F.row_number().over(w))
    lists = placed.groupBy("model_name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_place", F.struct(*fields).alias("row")))), lambda x: x["row"]).alias("rows")
    )
    return lists.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model_name", "rows")))).alias(name))


def benchmark_document(
    metrics: DataFrame, comparison: DataFrame, threshold_metrics: DataFrame, top_k_metrics: DataFrame,
    versions: DataFrame, split_text: str, threshold: float = config.ACTION_THRESHOLD,
) -> DataFrame:
    """One row: models with their metrics, comparison, recommendation, threshold and top-K tables.

    The tables hold a fixed number of rows for each model (thresholds and segments), so
    the document's size follows the number of models, not of scored rows.
    """
    long = evaluate.metrics_long(metrics)
    place = F.array_position(F.array(*[F.lit(n) for n in config.PRIMARY_METRICS]), F.col("name"))
    listed = F.array_sort(F.collect_list(F.struct(place.alias("place"), F.struct("name", "value", "status").alias("row"))))
    models = long.groupBy("model_name").agg(F.transform(listed, lambda x: x["row"]).alias("metrics")).join(versions, "model_name")
    note = F.format_string(config.VERSION_NOTE, "model_version").alias("notes")
    models = models.select(F.struct("model_name", F.lit("trained").alias("status"), note, "metrics").alias("model"))
    fields = [c for c in comparison.columns if c != "comparison_rank"]
    rank = F.struct("comparison_rank", F.struct(*fields).alias("row"))
    ordered = comparison.agg(F.transform(F.array_sort(F.collect_list(rank)), lambda x: x["row"]).alias("comparison"))
    best = evaluate.recommended_model(comparison).select("recommended_model", "recommendation_reason")
    parts = [
        ordered,
        best,
        models.agg(F.array_sort(F.collect_list("model")).alias("models")),
        _entries(_by_model(threshold_metrics, [c for c in threshold_metrics.columns if c != "model_name"], [F.col("threshold")], "m"), "thresholds"),
        _entries(_by_model(top_k_metrics, [c for c in top_k_metrics.columns if c != "model_name"], _segment_order(), "m"), "segments"),
    ]
    names = ["recommended_model", "recommendation_reason", "models", "comparison", "thresholds", "segments"]
    merged = reports.one_row(parts, names)  # entries are comparable, maps are not
    return merged.select(
        F.lit(split_text).alias("split_strategy"),
        F.array(*[F.lit(n) for n in config.PRIMARY_METRICS]).alias("primary_metrics"),
        "recommended_model",
        F.lit(float(threshold)).alias("selected_threshold"),
        "recommendation_reason", "models", "comparison",
        F.map_from_entries("thresholds").alias("threshold_tables"),
        F.map_from_entries("segments").alias("top_k_tables"),
    )


def _entries(one: DataFrame, name: str) -> DataFrame:
    return one.select(F.map_entries("m").alias(name))


def _segment_order() -> list[Column]:
    """Counts by rising K, then shares by rising percent, as they were asked for."""
    percent = F.col("segment").endswith("pct")
    return [percent, F.regexp_extract("segment", r"(\d+)", 1).cast("int")]


def document_rows(document: DataFrame) -> DataFrame:
    """The benchmark document as (section, model_name, place, name, value, text) rows."""
    number = lambda c: F.col(c).cast("double")
    text = lambda c: F.col(c).cast("string")

    def rows(section: str, model: Column, place: Column, name: Column, value: Column, note: Column) -> list[Column]:
        return [
            F.lit(section).alias("section"), model.cast("string").alias("model_name"), place.cast("bigint").alias("place"),
            name.cast("string").alias("name"), value.cast("double").alias("value"), note.cast("string").alias("text"),
        ]

    none = F.lit(None)
    models = document.select(F.explode("models").alias("m"))
    flat = models.select("m.model_name", "m.status", "m.notes", F.posexplode("m.metrics").alias("i", "x"))
    parts = [
        document.select(*rows("head", text("recommended_model"), F.lit(0), F.col("split_strategy"), number("selected_threshold"), F.col("recommendation_reason"))),
        document.select(F.posexplode("primary_metrics").alias("i", "n")).select(*rows("primary", none, F.col("i"), F.col("n"), none, none)),
        flat.select(*rows("metric", F.col("model_name"), F.col("i"), F.col("x.name"), F.col("x.value"), F.concat_ws("|", "status", "notes", "x.status"))),
    ]
    comparison = document.select(F.posexplode("comparison").alias("i", "x")).select("i", "x.*")
    names = [c for c in comparison.columns if c not in ("i", "model_name")]
    parts.append(_unpivoted(comparison, "comparison", names, rows))
    tables: Mapping[str, tuple[str, str]] = {"threshold": ("threshold_tables", "threshold"), "top_k": ("top_k_tables", "segment")}
    for section, (column, key) in tables.items():
        by = document.select(F.explode(column).alias("model_name", "t")).select("model_name", F.posexplode("t").alias("i", "x"))
        by = by.select("model_name", "i", "x.*")
        parts.append(_unpivoted(by, section, [c for c in by.columns if c not in ("model_name", "i", key)], rows, key))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _unpivoted(table: DataFrame, section: str, names: Sequence[str], rows, key: str | None = None) -> DataFrame:
    wide = table.select("model_name", "i", F.col(key).cast("string").alias("k") if key else F.lit(None).cast("string").alias("k"), *[
        F.col(n).cast("double").alias(n) for n in names
    ])
    long = wide.unpivot(["model_name", "i", "k"], list(names), "n", "v")
    return long.select(*rows(section, F.col("model_name"), F.col("i"), F.col("n"), F.col("v"), F.col("k")))
