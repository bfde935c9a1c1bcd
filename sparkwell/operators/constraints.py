"""Rules of a table, declared in its schema and checked on what is written or read.

A column that isn't nullable needs a value. The metadata of a field may have ``values`` (those allowed), ``unique`` (true) and
``references`` (the name of a parent table that must have the value in a column of the same name).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ConstraintError(ValueError):
    """Rows break a rule of their table."""


def column_error(field: T.StructField) -> Column:
    """Why a row's value of this column is refused, or null."""
    c, allowed = F.col(field.name), field.metadata.get("values")
    out = F.when(c.isNull(), f"no {field.name}") if not field.nullable else F.when(F.lit(False), "")
    return out.when(c.isNotNull() & ~c.isin(allowed), f"invalid {field.name}") if allowed else out


def row_errors(schema: T.StructType) -> Column:
    """The reasons for which a row alone is refused, in the order of the columns."""
    return F.array_compact(F.array(*[column_error(f) for f in schema]))


def violations(rows: DataFrame, schema: T.StructType, stored: DataFrame | None = None, parents: dict[str, DataFrame] | None = None, columns: list[str] | None = None) -> DataFrame:
    """reason and n (rows, or values that are repeated), a row per broken rule.

    ``stored`` are rows that stay beside ``rows``; ``columns`` are those that are new, all if it isn't given. Rows are read once for their
    own rules, and once per unique column or reference.
    """
    own = [f for f in schema if columns is None or f.name in columns]
    found = [rows.select(F.explode(row_errors(T.StructType(own))).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))]
    for f in own:
        one = rows.select(f.name).filter(F.col(f.name).isNotNull())
        if f.metadata.get("unique"):
            counted = one.withColumn("_own", F.lit(1))
            if stored is not None:
                # only values that the new rows have as well
                counted = counted.unionByName(stored.select(f.name).join(one.distinct(), f.name, "left_semi").withColumn("_own", F.lit(0)))
            many = counted.groupBy(f.name).agg(F.count(F.lit(1)).alias("_n"), F.max("_own").alias("_own")).filter("_n > 1 and _own = 1")
            found.append(many.groupBy(F.lit(f"repeated {f.name}").alias("reason")).agg(F.count(F.lit(1)).alias("n")))
        if (name := f.metadata.get("references")) and parents and name in parents:
            lost = one.join(parents[name].select(f.name), f.name, "left_anti")
            found.append(lost.groupBy(F.lit(f"unknown {f.name}").alias("reason")).agg(F.count(F.lit(1)).alias("n")))
    return reduce(DataFrame.unionByName, found)


def check(rows: DataFrame, schema: T.StructType, stored: DataFrame | None = None, parents: dict[str, DataFrame] | None = None, columns: list[str] | None = None) -> None:
    """Raises ConstraintError if a rule is broken, with all reasons; there are at most three per column."""
    broken = sorted((r["reason"], r["n"]) for r in violations(rows, schema, stored, parents, columns).collect())
    if broken:
        raise ConstraintError("; ".join(f"{reason} ({n})" for reason, n in broken))


def bad_rows(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Stored rows that break a rule of their own, with ``reasons``."""
    return rows.withColumn("reasons", row_errors(schema)).filter(F.size("reasons") > 0)
