"""Display helpers: entity labels, segment labels and number formats.

Label texts are parameters; the defaults are plain English.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_PROPERTY_KINDS = {"CITY": "City Hotel", "RESORT": "Resort Hotel"}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def property_label(c: Column | str, kinds: Mapping[str, str] = DEFAULT_PROPERTY_KINDS) -> Column:
    """``CITY_H2`` -> ``City Hotel 2``; other ids: underscores become spaces; null -> ``-``."""
    x = F.trim(_col(c))
    up = F.upper(x)
    pattern = r"^(" + "|".join(kinds) + r")_H(\d+)$"
    kind = F.regexp_extract(up, pattern, 1)
    number = F.regexp_extract(up, pattern, 2)
    kind_text = None
    for key, text in kinds.items():
        kind_text = F.when(kind == key, text) if kind_text is None else kind_text.when(kind == key, text)
    return (
        F.when(x.isNull() | (x == ""), F.lit("-"))
        .when(kind != "", F.concat_ws(" ", kind_text, number))
        .otherwise(F.replace(x, F.lit("_"), F.lit(" ")))
    )


def segment_label(c: Column | str) -> Column:
    """``top_50`` -> ``Top 50``; ``top_5pct`` / ``top_5_percent`` -> ``Top 5%``."""
    x = _col(c)
    k = F.regexp_extract(x, r"^top_(\d+)$", 1)
    pct = F.regexp_extract(x, r"^top_(\d+)(pct|_percent)$", 1)
    return (
        F.when(k != "", F.concat(F.lit("Top "), k))
        .when(pct != "", F.concat(F.lit("Top "), pct, F.lit("%")))
        .otherwise(F.replace(x, F.lit("_"), F.lit(" ")))
    )


def percent_text(c: Column | str, decimals: int = 1) -> Column:
    """Ratio -> ``'12.3%'``."""
    return F.format_string(f"%.{decimals}f%%", _col(c) * 100.0)
