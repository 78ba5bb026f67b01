"""Text scalars that SQL has no function for, as Arrow UDFs; everything else is written with built-in functions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SHORT = {"\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def escape_controls(text: str | None) -> str | None:
    """Raw control characters inside JSON strings, escaped."""
    if text is None:
        return None
    out, inside, escaped = [], False, False
    for c in text:
        if inside and c < " ":
            out.append(_SHORT.get(c) or f"\\u{ord(c):04x}")
            escaped = False
            continue
        out.append(c)
        if escaped:
            escaped = False
        elif c == "\\" and inside:
            escaped = True
        elif c == '"':
            inside = not inside
    return "".join(out)


def close_json(text: str | None) -> str | None:
    """A truncated JSON text with its open strings, arrays and objects closed; null if that does not help."""
    if text is None:
        return None
    stack, inside, escaped = [], False, False
    for c in text:
        if escaped:
            escaped = False
        elif inside:
            escaped, inside = c == "\\", c != '"'
        elif c == '"':
            inside = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack and stack[-1] == c:
            stack.pop()
    body = text[:-1] if escaped else text
    body = (body + '"' if inside else body).rstrip()
    tail = "".join(reversed(stack))
    for cut in (body, body.rstrip(","), body + "null" if body.endswith(":") else body):
        try:
            json.loads(cut + tail)
            return cut + tail
        except ValueError:
            continue
    return None


@F.pandas_udf(T.StringType())
def escape_controls_udf(s: pd.Series) -> pd.Series:
    return s.map(escape_controls)


@F.pandas_udf(T.StringType())
def close_json_udf(s: pd.Series) -> pd.Series:
    return s.map(close_json)
