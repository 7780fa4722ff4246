"""Data-quality checks for the integrity rules the reference declares in
its DDL (PRIMARY KEY / UNIQUE, NOT NULL, CHECK, REFERENCES, VARCHAR(n)),
which Spark does not enforce (SURVEY §2.11)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C


def unique_violations(df: DataFrame, cols: list[str]) -> DataFrame:
    """Key values occurring more than once; rows with a NULL in the key
    are exempt, as SQL UNIQUE allows repeated NULLs."""
    keyed = df.where(C.all_of([F.col(c).isNotNull() for c in cols]))
    return (keyed.groupBy(*cols).agg(F.count(F.lit(1)).alias("repeticiones"))
            .where(F.col("repeticiones") > 1))


def not_null_violations(df: DataFrame, cols: list[str]) -> DataFrame:
    """(columna, nulos) for each required column, counted in one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    pairs = ", ".join(f"'{c}', `{c}`" for c in cols)
    return counts.selectExpr(f"stack({len(cols)}, {pairs}) AS (columna, nulos)")


def check_violations(df: DataFrame, column: str, allowed: list) -> DataFrame:
    """Rows whose value is outside ``allowed``; NULL passes (SQL CHECK)."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(list(allowed)))


def fk_orphans(child: DataFrame, parent: DataFrame, on: str, parent_key: str | None = None) -> DataFrame:
    """Child rows with a non-NULL reference that has no parent row."""
    pk = parent_key or on
    keys = parent.select(F.col(pk).alias(on)).where(F.col(on).isNotNull()).distinct()
    return child.where(F.col(on).isNotNull()).join(keys, on, "left_anti")


def length_violations(df: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Rows with text longer than its declared length, with the list of
    offending columns in ``columnas``."""
    flags = F.array(*[F.when(F.length(F.col(c)) > n, F.lit(c)) for c, n in limits.items()])
    bad = F.filter(flags, lambda x: x.isNotNull())
    return df.withColumn("columnas", bad).where(F.size("columnas") > 0)
