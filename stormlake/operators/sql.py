"""Operators as portable SQL over named tables.

``run`` gives a text to Spark with DataFrames in place of its ``{name}`` fields, so Catalyst sees one plan;
``oracle`` makes of the same text one that another engine runs over tables of those names. Numbers are written
with an exponent, as bare decimals are DECIMAL and change results. Five fields stand for what engines spell
differently: ``{gate:array:index}`` an array's element from 0 or null, ``{explode:array}`` a row for each element,
``{median:x}`` the exact median that averages the middle two, ``{pair:x:y}`` and ``{triple:x:y:z}`` what to order by.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

_FIELD = re.compile(r"\{(gate|explode|median|pair|triple):([^:}]+)(?::([^:}]+))?(?::([^}]+))?\}")
_SPARK = {"gate": "get({0}, {1})", "explode": "explode({0})", "median": "percentile({0}, 0.5e0)", "pair": "struct({0}, {1})", "triple": "struct({0}, {1}, {2})"}
_OTHER = {"gate": "CASE WHEN {1} IS NULL THEN NULL ELSE {0}[cast({1} AS int) + 1] END", "explode": "unnest({0})", "median": "median({0})", "pair": "row({0}, {1})", "triple": "row({0}, {1}, {2})"}


def _spell(text: str, dialect: dict[str, str]) -> str:
    return _FIELD.sub(lambda m: dialect[m[1]].format(m[2], m[3], m[4]), text)


def run(text: str, **frames: DataFrame) -> DataFrame:
    return next(iter(frames.values())).sparkSession.sql(_spell(text, _SPARK), **frames)


def oracle(text: str, **tables: str) -> str:
    """The text with each table of the given SQL as a common table expression."""
    heads = ", ".join(f"{name} AS ({body})" for name, body in tables.items())
    body = re.sub(r"\{(\w+)\}", r"\1", _spell(text, _OTHER)).strip()
    if not tables:
        return body
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(start):
            return f"{start}{heads}, {body[len(start):]}"
    return f"WITH {heads} {body}"
