"""DuckDB SQL of the composed answers (``plans/answers.py``), over the shared CTEs."""

from __future__ import annotations

from riskloom import config
from riskloom.plans.oracle import (
    ACTIONS, CANCELED_ART, CANCELED_STORE, FEATURE_SELECT, NOSHOW, PRED, QUEUE_COLS, RISKY_COLS, _breakdown, _rate, _trends, base_clean,
    base_view, with_ctes,
)
from riskloom.sources import adapter

# The store keeps prediction ids, not the line keys: ties of one time go to the larger id.
STORE_ROWS = """
latest AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY reservation_id ORDER BY scored_at DESC, prediction_id DESC) AS rn
    FROM pred) WHERE rn = 1
),
rows AS (
  SELECT c.*, p.prediction_id, p.model_name, p.model_version, p.score, p.risk_class, p.threshold_used, p.scored_at
  FROM clean c LEFT JOIN latest p ON c.reservation_id = p.reservation_id
)"""

ACTION_COUNTS = ", ".join(
    f"CAST(count(*) FILTER (WHERE action_status = '{s}') AS BIGINT) AS action_{n}_count"
    for s, n in (("open", "pending"), ("completed", "completed"), ("follow_up", "follow_up"))
)
ZERO_ACTIONS = ", ".join(f"CAST(0 AS BIGINT) AS action_{n}_count" for n in ("pending", "completed", "follow_up"))


def _label(source: str) -> str:
    return f"'{source}' AS data_source, {str(source == config.STORE_SOURCE).lower()} AS action_support_enabled"


STORE, ARTIFACT, BOOTSTRAP = (_label(s) for s in (config.STORE_SOURCE, config.ARTIFACT_SOURCE, config.BOOTSTRAP_SOURCE))


def _with_label(sql: str, label: str, more: str = "") -> str:
    return f"SELECT *, {more}{label} FROM ({sql})"


def _line() -> tuple[str, str]:
    """A raw row as quoted CSV text: whole, and without its last two fields."""
    fields = [f"""'"' || replace("{c}", '"', '""') || '"'""" for c in adapter.RAW_COLUMNS]
    return " || ',' || ".join(fields), " || ',' || ".join(fields[:-2])


def _hash_sum(text: str) -> str:
    return f"CAST(sum(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)) AS BIGINT)"


def _files() -> dict[str, str]:
    whole, cut = _line()
    n = len(adapter.RAW_COLUMNS)
    text = "concat(" + ", '|', ".join(f'"{c}"' for c in adapter.RAW_COLUMNS) + ")"
    lines = f"""
lines AS (
  SELECT source_file,
         CASE WHEN reservation_id % 61 = 0 THEN 'too_many_fields: expected {n} fields, found {n + 1}'
              WHEN reservation_id % 67 = 0 THEN 'too_few_fields: expected {n} fields, found {n - 2}' ELSE 'row' END AS kind,
         CASE WHEN reservation_id % 61 = 0 THEN {whole} || ',"more, than asked"'
              WHEN reservation_id % 67 = 0 THEN {cut} ELSE {text} END AS t
  FROM raw)"""
    return {
        "csv_quarantine": with_ctes(*base_clean(), lines, body=f"""
SELECT source_file, kind, CAST(count(*) AS BIGINT) AS record_count, {_hash_sum('t')} AS text_hash_sum,
       CAST(sum(count(*)) OVER (PARTITION BY source_file) AS BIGINT) AS last_number
FROM lines GROUP BY source_file, kind"""),
        "import_batch_quarantine": with_ctes(*base_clean(), lines, body="""
SELECT 'csv_lines' AS source_name, string_agg(DISTINCT source_file, ',' ORDER BY source_file) AS source_files,
       'completed' AS status, CAST(count(*) FILTER (WHERE kind = 'row') AS BIGINT) AS row_count,
       CAST(count(*) FILTER (WHERE kind <> 'row') AS BIGINT) AS error_count, 'booking_time_v1' AS feature_set_version
FROM lines"""),
    }


def _operations(src: str, canceled: str, actions: str, note: str, label: str) -> str:
    return f"""
SELECT total_reservations, scored_reservations, no_show_count, canceled_count,
       {_rate('no_show_count', 'total_reservations')} AS no_show_rate,
       {_rate('canceled_count', 'total_reservations')} AS cancellation_rate, high_risk_reservations,
       action_pending_count, action_completed_count, action_follow_up_count, {note} AS note, {label}
FROM (
  SELECT CAST(count(*) AS BIGINT) AS total_reservations,
         CAST(count(*) FILTER (WHERE score IS NOT NULL) AS BIGINT) AS scored_reservations,
         CAST(count(*) FILTER (WHERE {NOSHOW}) AS BIGINT) AS no_show_count,
         CAST(count(*) FILTER (WHERE {canceled}) AS BIGINT) AS canceled_count,
         CAST(count(*) FILTER (WHERE risk_class = 'high') AS BIGINT) AS high_risk_reservations FROM {src}) AS a,
  ({actions}) AS b"""


def _dashboard(kpis: str, page: str, order: str, limit: int, label: str, status: str) -> str:
    return f"""
, k AS ({kpis}),
i AS (SELECT row_number() OVER (ORDER BY {order}) AS place, {RISKY_COLS} FROM ({page}) ORDER BY {order} LIMIT {limit})
SELECT k.*, '{status}' AS scoring_status, {label}, CAST(i.place AS INTEGER) AS place, i.* EXCLUDE (place)
FROM k LEFT JOIN i ON true"""


def _cases() -> dict[str, str]:
    store = [*base_clean(), PRED, STORE_ROWS, ACTIONS]
    view = base_view()
    counts = f"SELECT {ACTION_COUNTS} FROM actions"
    out = {
        "operations_report_store": with_ctes(*store, body=_operations("rows", CANCELED_STORE, counts, "CAST(NULL AS VARCHAR)", STORE)),
        "operations_report_artifact": with_ctes(*view, body=_operations(
            "view", CANCELED_ART, f"SELECT {ZERO_ACTIONS}", f"'{config.SUMMARY_NOTES[config.ARTIFACT_SOURCE]}'", ARTIFACT)),
        "operations_report_bootstrap": with_ctes(*base_clean(), PRED, STORE_ROWS, body=_operations(
            "(SELECT * FROM rows WHERE false)", CANCELED_STORE, f"SELECT {ZERO_ACTIONS}",
            f"'{config.SUMMARY_NOTES[config.BOOTSTRAP_SOURCE]}'", BOOTSTRAP)),
        "trends_report_store": with_ctes(*store, body=_with_label(_trends("rows", CANCELED_STORE), STORE)),
        "trends_report_artifact": with_ctes(*view, body=_with_label(_trends("view", CANCELED_ART), ARTIFACT)),
        "channel_report_store": with_ctes(
            *store, body=_with_label(_breakdown("rows", "distribution_channel", True, CANCELED_STORE), STORE)),
        "channel_report_artifact": with_ctes(
            *view, body=_with_label(_breakdown("view", "distribution_channel", False, CANCELED_ART), ARTIFACT)),
    }
    listed = ", ".join(
        f"(SELECT string_agg({c} || '=' || n, '|' ORDER BY n DESC, {c}) FROM"
        f" (SELECT {c}, count(*) AS n FROM actions GROUP BY 1)) AS {c.split('_')[1]}_breakdown"
        for c in ("action_status", "action_type")
    )
    out["action_report_store"] = with_ctes(*store, body=f"""
SELECT (SELECT CAST(count(*) AS BIGINT) FROM actions) AS total_actions,
       (SELECT CAST(count(*) FILTER (WHERE action_status = 'open') AS BIGINT) FROM actions) AS open_actions,
       (SELECT CAST(count(*) FILTER (WHERE action_status = 'completed') AS BIGINT) FROM actions) AS completed_actions,
       (SELECT CAST(count(*) FILTER (WHERE action_status = 'follow_up') AS BIGINT) FROM actions) AS follow_up_actions,
       (SELECT CAST(count(*) AS BIGINT) FROM rows WHERE risk_class = 'high'
          AND reservation_id IN (SELECT reservation_id FROM actions)) AS high_risk_with_action_count,
       (SELECT CAST(count(*) AS BIGINT) FROM rows WHERE risk_class = 'high'
          AND reservation_id NOT IN (SELECT reservation_id FROM actions)) AS high_risk_without_action_count,
       {listed}, CAST(NULL AS VARCHAR) AS note, {STORE}""")
    zeros = ", ".join(
        f"CAST(0 AS BIGINT) AS {n}" for n in ("total_actions", "open_actions", "completed_actions", "follow_up_actions")
    )
    out["action_report_artifact"] = with_ctes(*view, body=f"""
SELECT {zeros}, CAST(0 AS BIGINT) AS high_risk_with_action_count, CAST(count(*) AS BIGINT) AS high_risk_without_action_count,
       '' AS status_breakdown, '' AS type_breakdown, '{config.ACTION_NOTES[config.ARTIFACT_SOURCE]}' AS note, {ARTIFACT}
FROM view WHERE risk_class = 'high'""")

    def kpis(scored: str, at: str, total: str, actions: str, name: str, version: str) -> str:
        return f"""
SELECT (SELECT CAST(count(*) AS BIGINT) FROM {total}) AS total_reservations,
       (SELECT CAST(count(*) FILTER (WHERE risk_class = 'high') AS BIGINT) FROM {scored}) AS high_risk_reservations,
       (SELECT CAST(count(*) FILTER (WHERE risk_class = 'medium') AS BIGINT) FROM {scored}) AS medium_risk_reservations,
       {at} AS latest_scored_at, c.*, {name} AS active_model_name, {version} AS active_model_version FROM ({actions}) AS c"""

    null = "CAST(NULL AS VARCHAR)"
    by_store, by_artifact = "score DESC NULLS LAST, reservation_id DESC", "score DESC NULLS LAST, arrival_date DESC NULLS LAST, reservation_id"
    status = config.SCORING_STATUS
    out["dashboard_answer_store"] = with_ctes(*store, body=_dashboard(
        kpis("latest", "(SELECT max(scored_at) FROM pred)", "clean", counts, null, null),
        "SELECT * FROM rows WHERE model_version IS NOT NULL", by_store, 8, STORE, status[config.STORE_SOURCE]))
    out["dashboard_answer_artifact"] = with_ctes(*view, body=_dashboard(
        kpis("view", "(SELECT max(scored_at) FROM view)", "view", f"SELECT {ZERO_ACTIONS}", "'logistic_regression'", "'logreg_v9'"),
        "SELECT * FROM view WHERE risk_class IN ('high', 'medium')", by_artifact, 12, ARTIFACT, status[config.ARTIFACT_SOURCE]))
    out["dashboard_answer_bootstrap"] = with_ctes(*store, body=_dashboard(
        kpis("(SELECT * FROM latest WHERE false)", "(SELECT max(scored_at) FROM pred WHERE false)", "clean", counts, null, null),
        "SELECT * FROM rows WHERE false", by_store, 1, BOOTSTRAP, status[config.BOOTSTRAP_SOURCE]))

    chosen = "property_id = 'CITY_H2' AND risk_class = 'high'"

    def answer(src: str, order: str, form: str, label: str) -> str:
        return f"""
, t AS (SELECT CAST(count(*) AS BIGINT) AS total FROM {src} WHERE {chosen}),
i AS (SELECT row_number() OVER (ORDER BY {order}) AS place, {QUEUE_COLS} FROM {src} WHERE {chosen} ORDER BY {order} LIMIT 50)
SELECT t.total, f.*, 'high|medium|low' AS risk_classes, {label}, CAST(i.place AS INTEGER) AS place, i.* EXCLUDE (place)
FROM t, ({form}) AS f LEFT JOIN i ON true"""

    out["queue_answer_store"] = with_ctes(*store, body=answer(
        "rows", "score DESC NULLS LAST, arrival_date DESC NULLS LAST, reservation_id DESC",
        f"SELECT '' AS property_ids, '' AS distribution_channels, CAST(NULL AS DATE) AS min_arrival_date, CAST(NULL AS DATE) AS max_arrival_date,"
        f" {null} AS filter_model_name, {null} AS filter_model_version", STORE))
    out["queue_answer_artifact"] = with_ctes(*view, body=answer(
        "view", by_artifact,
        "SELECT string_agg(DISTINCT property_id, '|' ORDER BY property_id) AS property_ids,"
        " string_agg(DISTINCT distribution_channel, '|' ORDER BY distribution_channel) AS distribution_channels,"
        " min(arrival_date) AS min_arrival_date, max(arrival_date) AS max_arrival_date,"
        " 'logistic_regression' AS filter_model_name, 'logreg_v9' AS filter_model_version FROM view", ARTIFACT))
    return out


def _document(known: dict[str, str]) -> str:
    """Rows of the benchmark document from the SQL of its tables."""
    order = "CASE name " + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(config.PRIMARY_METRICS)) + " END"
    primary = " UNION ALL ".join(
        f"SELECT 'primary' AS section, CAST(NULL AS VARCHAR) AS model_name, {i} AS place, '{n}' AS name, CAST(NULL AS DOUBLE) AS value,"
        " CAST(NULL AS VARCHAR) AS text" for i, n in enumerate(config.PRIMARY_METRICS)
    )

    def table(section: str, src: str, place: str, names: tuple[str, ...], key: str) -> str:
        return " UNION ALL ".join(
            f"SELECT '{section}' AS section, model_name, {place} AS place, '{n}' AS name, CAST({n} AS DOUBLE) AS value,"
            f" CAST({key} AS VARCHAR) AS text FROM {src}" for n in names
        )

    by_place = "row_number() OVER (PARTITION BY model_name ORDER BY {}) - 1"
    segment = "segment LIKE '%pct', CAST(regexp_extract(segment, '(\\d+)', 1) AS INTEGER)"
    parts = [
        """SELECT 'head' AS section, r.recommended_model AS model_name, 0 AS place,
       'time-based split: train on 1995-1999, test on 2000-2001' AS name, CAST(0.35 AS DOUBLE) AS value,
       r.recommendation_reason AS text FROM r""",
        primary,
        f"""SELECT 'metric' AS section, l.model_name, {order} AS place, name, CAST(value AS DOUBLE) AS value,
       'trained|Version ' || v.model_version || ' evaluated from latest artifact.|' || l.status AS text
FROM l JOIN (SELECT model_name, max_by(model_version, (scored_at, model_version)) AS model_version FROM {{pred}} GROUP BY 1) v USING (model_name)""",
        table("comparison", "c", "comparison_rank - 1", ("roc_auc", "pr_auc", "precision", "recall", "f1", "brier_score", "threshold"), "NULL"),
        table("threshold", "s", by_place.format("threshold"), ("precision", "recall", "f1", "actioned_count"), "threshold"),
        table("top_k", "k", by_place.format(segment), ("selected_count", "captured_no_show", "total_no_show", "recall"), "segment"),
    ]
    pred = "(SELECT CASE WHEN l_linestatus = 'O' THEN 'logistic_regression' ELSE 'gbt' END AS model_name," \
        " (CASE WHEN l_linestatus = 'O' THEN 'logreg' ELSE 'gbt' END) || '_v' || CAST(year(l_shipdate) - 1994 AS VARCHAR) AS model_version," \
        " l_shipdate AS scored_at FROM lineitem)"
    ctes = ", ".join(
        f"{n} AS ({known[q]})"
        for n, q in (("l", "metrics_long"), ("c", "model_comparison"), ("r", "recommended_model"), ("s", "threshold_sweep"), ("k", "topk_capture"))
    )
    body = " UNION ALL ".join(f"({p})" for p in parts).replace("{pred}", pred)
    return f"WITH {ctes} SELECT section, model_name, CAST(place AS BIGINT) AS place, name, value, text FROM ({body})"


def _stored(known: dict[str, str]) -> dict[str, str]:
    """What is kept as state equals what the whole history gives."""
    payload = ", ".join(c for c in FEATURE_SELECT.split(", ") if c not in ("reservation_key", "reservation_id"))
    return {
        "latest_prediction_merged": known["latest_prediction"],
        "queue_store_bucketed": known["queue_store"],
        "action_state_folded": known["action_latest_state"],
        "action_state_rejections": known["action_update_rejections"],
        "feature_payload_typed": f"SELECT {payload} FROM ({known['feature_dataset']})",
    }


def queries(known: dict[str, str]) -> dict[str, str]:
    return {**_files(), **_cases(), **_stored(known), "benchmark_document": _document(known)}
