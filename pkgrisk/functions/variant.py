"""SQL fragments for tolerant JSON access: wrong types read as NULL instead of failing."""

from __future__ import annotations


def parse(text: str) -> str:
    """JSON text → VARIANT, NULL when malformed, also when anything follows the value.

    The built-in parser stops after the first value; a sentinel behind the text makes
    left-over characters visible.
    """
    wrapped = f"try_parse_json(concat('[', {text}, ',\"\\\\u0003end\"]'))"
    whole = "try_variant_get(w, '$[1]', 'string') = '\\u0003end'"
    return f"get(transform(array({wrapped}), w -> IF({whole}, try_variant_get(w, '$[0]', 'variant'), NULL)), 0)"


def kind(v: str) -> str:
    """OBJECT, ARRAY, STRING, BIGINT, DOUBLE, DECIMAL, BOOLEAN or VOID; NULL for no value."""
    return f"regexp_extract(schema_of_variant({v}), '^([A-Z]+)', 1)"


def node(v: str, path: str) -> str:
    return f"try_variant_get({v}, '{path}', 'variant')"


def is_string(v: str) -> str:
    return f"(schema_of_variant({v}) = 'STRING')"


def string_at(v: str, path: str) -> str:
    return f"IF({is_string(node(v, path))}, try_variant_get({v}, '{path}', 'string'), NULL)"


def object_at(v: str, path: str) -> str:
    """map<string,variant>; NULL when the value is not an object (the cast refuses other kinds)."""
    return f"try_variant_get({v}, '{path}', 'map<string,variant>')"


def array_at(v: str, path: str) -> str:
    """array<variant>; NULL when the value is not an array."""
    return f"try_variant_get({v}, '{path}', 'array<variant>')"


def is_object(v: str) -> str:
    return f"({object_at(v, '$')} IS NOT NULL)"


def is_array(v: str) -> str:
    return f"({array_at(v, '$')} IS NOT NULL)"


def number_at(v: str, path: str) -> str:
    kinds = "'BIGINT', 'DOUBLE', 'DECIMAL', 'FLOAT'"
    return f"IF({kind(node(v, path))} IN ({kinds}), try_variant_get({v}, '{path}', 'double'), NULL)"


def string_of(v: str) -> str:
    """A variant value itself, if it is a JSON string."""
    return f"IF({is_string(v)}, try_variant_get({v}, '$', 'string'), NULL)"


def strings_in_map(m: str) -> str:
    """String-valued entries of map<string,variant>."""
    return (
        f"transform_values(map_filter({m}, (k, x) -> {is_string('x')}), (k, x) -> try_variant_get(x, '$', 'string'))"
    )
