"""Column expressions.  All JVM-side built-ins; no Python per row."""

from riskloom.functions.core import (  # noqa: F401
    bool_token,
    cleanse_text,
    date_from_parts,
    dimension_key,
    finite_or_null,
    lead_time_bucket,
    lookup,
    month_number,
    optional_flag,
    parse_date,
    property_for_file,
    risk_class,
    safe_ratio,
    safe_rate,
    strip_all,
    tolerant_number,
)
from riskloom.functions.presentation import (  # noqa: F401
    percent_text,
    property_label,
    segment_label,
)
