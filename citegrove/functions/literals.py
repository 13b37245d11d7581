"""Literal maps and arrays of the rule tables as single expressions."""
from pyspark.sql import Column, functions as F


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _literal(value) -> str:
    if isinstance(value, str):
        return _text(value)
    if isinstance(value, (list, tuple)):
        return "array(" + ", ".join(_literal(v) for v in value) + ")"
    return repr(value)


def array_literal(values: list) -> Column:
    return F.expr(_literal(list(values)))


def map_literal(table: dict) -> Column:
    return F.expr("map(" + ", ".join(f"{_literal(k)}, {_literal(v)}" for k, v in table.items()) + ")")
