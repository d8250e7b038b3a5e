"""Rules over children that stay in their own table: for parents with very many children."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def item_counts(parent: DataFrame, child: DataFrame, on: dict[str, str], predicate: Column, out: str = "n_items") -> DataFrame:
    """parent with the number of its child rows that meet predicate (null: not met); counted per task, then per key."""
    hits = child.groupBy(*[F.col(k).alias(f"__{k}") for k in on.values()]).agg(F.sum(F.coalesce(predicate, F.lit(False)).cast("long")).alias(out))
    joined = parent.join(hits, [parent[p] == hits[f"__{k}"] for p, k in on.items()], "left")
    return joined.withColumn(out, F.coalesce(F.col(out), F.lit(0).cast("long"))).drop(*[f"__{k}" for k in on.values()])


def unique_violations(df: DataFrame, fields: tuple[str, ...], ignore_none: bool = True) -> DataFrame:
    """Rows whose fields occur more than once; keys are counted before the rows are joined to the few that repeat."""
    rows = df.where(" AND ".join(f"`{f}` IS NOT NULL" for f in fields)) if ignore_none else df
    twice = rows.groupBy(*fields).agg(F.count("*").alias("__n")).where("__n > 1").select(*[F.col(f).alias(f"__{f}") for f in fields])
    return rows.join(twice, [rows[f].eqNullSafe(twice[f"__{f}"]) for f in fields], "left_semi")
