"""The scalars as temporary SQL functions, and the table functions, for use from ``spark.sql``."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tallyloom.functions import tables
from tallyloom.functions.numbers import WHITE

SQL_FUNCTIONS = {
    "tl_positive_number": f"CREATE OR REPLACE TEMPORARY FUNCTION tl_positive_number(v STRING) RETURNS DOUBLE RETURN CASE WHEN replace(btrim(v, '{WHITE}'), ',', '.') RLIKE '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$' AND try_cast(replace(btrim(v, '{WHITE}'), ',', '.') AS DOUBLE) > 0 AND try_cast(replace(btrim(v, '{WHITE}'), ',', '.') AS DOUBLE) < double('Infinity') THEN try_cast(replace(btrim(v, '{WHITE}'), ',', '.') AS DOUBLE) END",
    "tl_direction": "CREATE OR REPLACE TEMPORARY FUNCTION tl_direction(c DOUBLE, t DOUBLE) RETURNS STRING RETURN CASE WHEN c IS NULL THEN NULL WHEN abs(c) < t THEN 'stable' WHEN c > 0 THEN 'up' ELSE 'down' END",
}


def register(spark: SparkSession) -> list[str]:
    for statement in SQL_FUNCTIONS.values():
        spark.sql(statement)
    return [*SQL_FUNCTIONS, *tables.register(spark)]
