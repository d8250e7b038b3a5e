"""Keyed comparison of two frames, and projection from one model to another."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ApplyError


def duplicate_keys(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Keys that occur more than once, with their counts (summed per task first)."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def any_null(keys: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])


def unique_by(df: DataFrame, keys: tuple[str, ...], what: str) -> DataFrame:
    """df, which fails the job where a row has a null in its key or shares its key with another.  Rows are counted in a window over the keys, whose
    partitioning and order a join on them uses again; where keys are as they should be, no window holds more than a row."""
    n = "__n_of_key"
    counted = df.withColumn(n, F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    shown = F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), F.col(k).cast("string")) for k in keys])
    fail = lambda text: F.raise_error(text).cast("boolean")
    good = F.when(any_null(keys), fail(F.lit(f"{what} has no key"))).when(F.col(n) > 1, fail(F.concat(F.lit(f"{what} holds a key twice: "), shown))).otherwise(F.lit(True))
    return counted.where(good).drop(n)


def diff(old: DataFrame, new: DataFrame, keys: tuple[str, ...], unchanged: bool = False) -> DataFrame:
    """One row per key that differs: the keys, ``change_op`` (ADDED, DELETE, UPDATE) and ``changed`` (names of columns).

    Columns that only one side has are not compared: absent isn't null.  A null key in old, or a key twice on one side, fails the job; rows of new with a null
    key match nothing and are ADDED, without a shuffle.  One equi-join on the keys.
    """
    if missing := [k for k in keys if k not in old.columns or k not in new.columns]:
        raise ApplyError(f"no key {', '.join(missing)}")
    shared = [c for c in old.columns if c in new.columns and c not in keys]
    rest = F.struct(*[F.col(c) for c in shared] or [F.lit(1).alias("_")])
    o = unique_by(old.select(*[F.col(k).alias(f"o_{k}") for k in keys], rest.alias("o")), tuple(f"o_{k}" for k in keys), "the stored frame")
    named = new.select(*[F.col(k).alias(f"n_{k}") for k in keys], rest.alias("n"))
    new_keys = tuple(f"n_{k}" for k in keys)
    n = unique_by(named.where(~any_null(new_keys)), new_keys, "the new frame")
    both = o.join(n, [F.col(f"o_{k}") == F.col(f"n_{k}") for k in keys], "full_outer")
    names = F.filter(F.array(*[F.when(~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")), F.lit(c)) for c in shared] or [F.lit(None).cast("string")]), lambda x: x.isNotNull())
    op = F.when(F.col("o").isNull(), "ADDED").when(F.col("n").isNull(), "DELETE").when(F.size("changed") > 0, "UPDATE")
    out = both.withColumn("changed", F.when(F.col("o").isNotNull() & F.col("n").isNotNull(), names).otherwise(F.array().cast("array<string>"))).withColumn("change_op", op)
    out = out.select(*[F.coalesce(f"o_{k}", f"n_{k}").alias(k) for k in keys], "change_op", "changed")
    keyless = named.where(any_null(new_keys)).select(*[F.col(f"n_{k}").alias(k) for k in keys], F.lit("ADDED").alias("change_op"), F.array().cast("array<string>").alias("changed"))
    out = out.unionByName(keyless)
    return out if unchanged else out.where("change_op IS NOT NULL")


def added(old: DataFrame, new: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return new.join(old.select(*keys), list(keys), "left_anti")


def deleted(old: DataFrame, new: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return old.join(new.select(*keys), list(keys), "left_anti")


def project(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Records of one model as records of another: {target name: source column}."""
    return df.select(*[F.col(source).alias(target) for target, source in mapping.items()])
