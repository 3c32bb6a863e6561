"""Text forms of byte counts and durations, and the reverse for sizes.

The functions take a column name or SQL expression and give a column; the ``…_sql`` forms give SQL,
for use inside longer messages.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Decimal pattern of scaled byte counts, unit names, suffixes of size settings.
BYTE_PATTERN = "#.00"
BYTE_UNITS = ["KB", "MB", "GB", "TB"]
SIZE_SUFFIXES = ["b", "k", "m", "g", "t", "p"]
DURATION_UNITS = [(86400000, None, "day"), (3600000, 24, "hour"), (60000, 60, "mins"), (1000, 60, "secs")]


def fmt_bytes_sql(n: str) -> str:
    cases = [f"WHEN {n} < 1024 THEN concat({n}, ' B')"]
    for power, unit in enumerate(BYTE_UNITS, start=1):
        text = f"concat(format_number({n} / {1024**power}D, '{BYTE_PATTERN}'), ' {unit}')"
        last = unit == BYTE_UNITS[-1]
        cases.append(f"ELSE {text}" if last else f"WHEN {n} < {1024 ** (power + 1)} THEN {text}")
    return f"CASE {' '.join(cases)} END"


def fmt_bytes(n: str) -> Column:
    """``1536`` → ``1.50 KB``.  Below 1024 (negative values too) the plain number with `` B``.

    Rounds half to even, has no thousands separators and stops at TB.
    """
    return F.expr(fmt_bytes_sql(n))


def fmt_duration_sql(ms: str) -> str:
    words = []
    for size, wrap, unit in DURATION_UNITS:
        value = f"({ms} div {size})" + (f" % {wrap}" if wrap else "")
        words.append(f"if({value} > 0, concat({value}, ' {unit} '), '')")
    return f"if({ms} < 1000, concat({ms}, ' ms'), concat({', '.join(words)}))"


def fmt_duration(ms: str) -> Column:
    """``90061000`` → ``1 day 1 hour 1 mins 1 secs `` (each part has a trailing space).

    Below one second the milliseconds are given, above they are dropped; zero parts are left out.
    """
    return F.expr(fmt_duration_sql(ms))


def parse_size(text: str) -> Column:
    """Size setting to bytes: ``4g`` → 4294967296.  No suffix means bytes; bad text gives null."""
    parts = rf"lower(trim({text})), r'^(-?[0-9]+)([kmgtp]?b?)$'"
    suffix = f"substring(regexp_extract({parts}, 2), 1, 1)"
    factors = " ".join(f"WHEN '{s}' THEN {1024**power}L" for power, s in enumerate(SIZE_SUFFIXES))
    return F.expr(
        f"try_cast(nullif(regexp_extract({parts}, 1), '') AS bigint) * CASE {suffix} WHEN '' THEN 1L {factors} END"
    )
