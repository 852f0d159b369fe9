"""SQL fragments: ISO-8601 text to UTC timestamps, tolerant of garbage."""

from __future__ import annotations


def iso_timestamp(value: str) -> str:
    """Timestamp, naive text read in the session zone (UTC); NULL when it is not a full ISO date."""
    return f"IF({value} RLIKE r'^\\d{{4}}-\\d{{2}}-\\d{{2}}([T ].*)?$', try_cast({value} AS timestamp), NULL)"


def age_days(published: str, as_of: str) -> str:
    return f"((unix_micros(cast({as_of} AS timestamp)) - unix_micros({published})) / 86400e6D)"


def one_decimal(x: str) -> str:
    """Half-even text with one decimal and no grouping commas."""
    return f"replace(format_number({x}, 1), ',', '')"
