"""JSON columns of any shape: parsed once to VARIANT, rows that are no JSON counted, values taken by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(df: DataFrame, column: str, name: str = "v") -> DataFrame:
    """df with a VARIANT of a JSON text, and <name>_bad for a text that is none. A null text has neither. What stands behind
    the first value of a text is not looked at."""
    v = F.try_parse_json(F.col(column))
    return df.withColumns({name: v, f"{name}_bad": F.col(column).isNotNull() & v.isNull()})


def value(v: Column | str, path: str, kind: str) -> Column:
    """The value at a path such as $.a.b[0]; null if it isn't there or isn't of that kind."""
    return F.try_variant_get(v, path, kind)


def quality(df: DataFrame, column: str = "v") -> DataFrame:
    """One row: rows, those without a text, those that are no JSON, and the schema of all others together, merged task by task."""
    n = lambda test: F.count(F.when(test, 1))
    return df.agg(F.count("*").alias("rows"), n(F.col(f"{column}_bad")).alias("bad"), n(F.col(column).isNull() & ~F.col(f"{column}_bad")).alias("missing"), F.schema_of_variant_agg(column).alias("schema"))


def facet(df: DataFrame, path: str, kind: str = "string", keys: tuple[str, ...] = (), column: str = "v", sums: dict[str, Column] | None = None) -> DataFrame:
    """(keys, value, n, sums): rows by the value at a path, with a row for those that have none."""
    return df.groupBy(*keys, value(F.col(column), path, kind).alias("value")).agg(F.count("*").alias("n"), *[F.sum(c).alias(k) for k, c in (sums or {}).items()])


def unnested(df: DataFrame, path: str, keys: tuple[str, ...], column: str = "v") -> DataFrame:
    """(keys, key, value): the fields of the object at a path, one row each; rows without such an object give none."""
    fields = F.try_variant_get(F.col(column), path, "map<string,variant>")
    return df.select(*keys, F.explode(fields).alias("key", "value"))
