"""Small builders for SQL expression text.

Operators write their expressions as SQL text and let Spark parse them once; a Python
call per operator node costs far more driver time than the plan it describes.
"""

from __future__ import annotations

from collections.abc import Iterable


def text(value: str) -> str:
    """String literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def regex(pattern: str) -> str:
    """Raw string literal for a regular expression; a quote is written as its code point."""
    return "r'" + pattern.replace("'", r"\x27") + "'"


def texts(values: Iterable[str]) -> str:
    """Comma-separated string literals."""
    return ", ".join(text(v) for v in values)


def text_array(values: Iterable[str]) -> str:
    values = list(values)
    return f"array({texts(values)})" if values else "cast(array() AS array<string>)"


def number(value: object) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    return f"{value!r}D" if isinstance(value, float) else str(value)
