"""Scalar building blocks: cleansing, tolerant parsing, classes and rates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom import config

# pandas-style numeric literal: optional sign, digits with optional fraction or
# a bare fraction, optional exponent, or inf/infinity.  Spark's own cast also
# accepts suffixes such as "1.5d", which pandas rejects, hence the guard.
_NUMBER_PATTERN = r"^[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[iI]nf(inity)?)$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Whitespace set stripped from text fields: every code point for which
# Python's ``str.isspace`` holds (the rule the source's string strip uses).
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
_WHITESPACE_SQL = "'" + "".join(f"\\u{ord(ch):04x}" for ch in WHITESPACE) + "'"


def _sql_str(v: str) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def strip_all(c: Column | str) -> Column:
    """Remove leading and trailing Unicode whitespace (plain ``trim`` strips spaces only).

    ``trim(BOTH set FROM x)`` walks code points from both ends: no regex.
    """
    return F.trim(_col(c), F.lit(WHITESPACE))


# The SQL texts below name their value several times, so they are right for a plain column
# that a projection below them computes: that projection then runs once for each row.
# Comparisons with one-character texts test first characters by byte order.
_LAST = "substring({x}, -1, 1)"
_PLAIN_ENDS = f"{{x}} >= '!' AND {{x}} < '\\u007f' AND {_LAST} >= '!' AND {_LAST} < '\\u007f'"


def strip_sql(name: str) -> str:
    """SQL text of :func:`strip_all` for a column that plain ``trim`` has passed.

    Nearly all values then begin and end with a visible ASCII character and are done.
    """
    x = _ident(name)
    return f"CASE WHEN {_PLAIN_ENDS.format(x=x)} THEN {x} ELSE trim(BOTH {_WHITESPACE_SQL} FROM {x}) END"


def cleanse_text_sql(name: str, tokens: Sequence[str] = config.NULL_TOKENS) -> str:
    """SQL text that maps the null tokens of a stripped column to null."""
    x = _ident(name)
    return f"CASE WHEN {x} IN ({', '.join(_sql_str(t) for t in tokens)}) THEN CAST(NULL AS STRING) ELSE {x} END"


def tolerant_number_sql(name: str) -> str:
    """SQL text of :func:`tolerant_number` for a text column.

    A value that begins like a number, ends with a digit or point and holds no x (hexadecimal)
    casts exactly if the number pattern matches; only others are matched against it.
    """
    x = _ident(name)
    last = _LAST.format(x=x)
    # From '+' to '9' there are also a comma and a slash, which neither the cast nor the pattern takes.
    plain = f"{x} >= '+' AND {x} < ':' AND {last} >= '.' AND {last} < ':' AND NOT contains({x}, 'x') AND NOT contains({x}, 'X')"
    matches = f"{x} RLIKE {_sql_str(_NUMBER_PATTERN)}"
    return f"CASE WHEN ({plain}) OR {matches} THEN try_cast({x} AS DOUBLE) END"


def cleanse_text(c: Column | str, tokens: Sequence[str] = config.NULL_TOKENS) -> Column:
    """Strip, then map every null token to null."""
    stripped = strip_all(c)
    return F.when(stripped.isin(list(tokens)), F.lit(None).cast("string")).otherwise(stripped)


def tolerant_number(c: Column | str) -> Column:
    """String -> double; anything unparseable becomes null instead of an error."""
    s = _col(c).cast("string")
    return F.when(s.rlike(_NUMBER_PATTERN), s.try_cast("double"))


def lookup(c: Column | str, mapping: Mapping, default=None) -> Column:
    """Literal dictionary lookup (folded into the plan); missing key -> default."""
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    value = F.try_element_at(m, _col(c))
    return value if default is None else F.coalesce(value, F.lit(default))


def property_for_file(source_file: Column | str) -> Column:
    return lookup(source_file, config.SOURCE_FILE_TO_PROPERTY, config.UNKNOWN_PROPERTY)


def month_number(month_name: Column | str) -> Column:
    return lookup(month_name, config.MONTH_NUMBERS)


def date_from_parts(year: Column | str, month: Column | str, day: Column | str) -> Column:
    """Calendar date from numeric parts; missing, fractional or invalid -> null.

    ``make_date`` raises under ANSI mode, so the parts go through a tolerant
    string parse instead.
    """
    y, m, d = _col(year), _col(month), _col(day)
    whole = (y == F.floor(y)) & (m == F.floor(m)) & (d == F.floor(d))
    text = F.format_string("%d-%d-%d", y.cast("long"), m.cast("long"), d.cast("long"))
    ok = y.isNotNull() & m.isNotNull() & d.isNotNull() & whole & (y >= 1) & (y <= 9999)
    return F.when(ok, F.try_to_date(text, "y-M-d"))


def parse_date(c: Column | str, fmt: str = "yyyy-MM-dd") -> Column:
    return F.try_to_date(_col(c), fmt)


def bool_token(c: Column | str, true_tokens=("1", "true")) -> Column:
    """Token map to boolean; unknown tokens and nulls are false."""
    return F.coalesce(_col(c).isin(list(true_tokens)), F.lit(False))


def risk_class(
    score: Column | str,
    high: float = config.HIGH_RISK_THRESHOLD,
    medium: float = config.ACTION_THRESHOLD,
) -> Column:
    s = _col(score)
    return F.when(s >= high, "high").when(s >= medium, "medium").when(s.isNotNull(), "low")


def lead_time_bucket(days: Column | str) -> Column:
    """Right-closed bins; null stays null."""
    x = _col(days)
    expr = None
    for edge, label in zip(config.LEAD_TIME_EDGES, config.LEAD_TIME_LABELS):
        expr = F.when(x <= edge, label) if expr is None else expr.when(x <= edge, label)
    return expr.when(x.isNotNull() & ~F.isnan(x), config.LEAD_TIME_LABELS[-1])


def optional_flag(c: Column | str) -> Column:
    """Null in -> null out, otherwise 1 if positive else 0."""
    x = _col(c)
    return F.when(x.isNotNull(), (x > 0).cast("int"))


def finite_or_null(c: Column | str) -> Column:
    x = _col(c)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


def safe_rate(numerator: Column | str, denominator: Column | str) -> Column:
    """num / den as double, 0.0 when the denominator is not positive."""
    n, d = _col(numerator), _col(denominator)
    return F.when(d <= 0, F.lit(0.0)).otherwise(n.cast("double") / d.cast("double"))


def safe_ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Zero-division -> 0.0 (precision/recall convention)."""
    n, d = _col(numerator), _col(denominator)
    return F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(0.0))


def dimension_key(c: Column | str, trim: bool = True, fallback: str = "Unknown") -> Column:
    """Group key for a dimension: optional trim; null or empty -> fallback."""
    x = _col(c).cast("string")
    if trim:
        x = strip_all(x)
    return F.coalesce(F.nullif(x, F.lit("")), F.lit(fallback))
