"""SQL spelling of literals, so that long expressions reach the JVM in one call."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def sql_str(value: str) -> str:
    if "${" in value:
        raise ValueError("would be taken for a SQL variable: " + value)
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_value(value) -> str:
    if isinstance(value, bytes):
        return f"X'{value.hex()}'"
    return sql_str(value) if isinstance(value, str) else repr(value)


def str_array(values) -> Column:
    return F.expr("array(" + ", ".join(sql_str(v) for v in values) + ")") if values \
        else F.expr("cast(array() as array<string>)")


def literal_map(values: dict) -> Column:
    return F.expr("map(" + ", ".join(f"{sql_value(k)}, {sql_value(v)}" for k, v in values.items()) + ")")
