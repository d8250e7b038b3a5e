"""Readers and writers over Spark's own formats, and the nesting of child tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("parquet", "orc", "json", "csv", "avro", "jdbc")


def read(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    if fmt not in FORMATS:
        raise ValueError(f"format {fmt} is none of {', '.join(FORMATS)}")
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", partition_by: tuple[str, ...] = (), **options: str) -> None:
    w = df.write.format(fmt).mode(mode).options(**options)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def nest(parent: DataFrame, child: DataFrame | Callable[[DataFrame], DataFrame], on: dict[str, str], name: str, order: tuple[str, ...] | None = None) -> DataFrame:
    """parent with ``name``: its child rows as a list of structs in a total order.  child may be a function of the parent
    frame (a read handler for all parents at once).  One shuffle of the children; parents without any get an empty list.

    A parent whose children don't fit a row is better served by :func:`veldspar.operators.flat.item_counts`.
    """
    if callable(child) and not isinstance(child, DataFrame):
        child = child(parent)
    key = list(on.values())
    first = list(order or ())
    rest = [c for c in child.columns if c not in first]
    items = child.groupBy(*[F.col(k).alias(f"__{k}") for k in key]).agg(F.sort_array(F.collect_list(F.struct(*first, *rest))).alias(name))
    kind = items.schema[name].dataType
    match = [parent[p] == items[f"__{k}"] for p, k in on.items()]
    return parent.join(items, match, "left").withColumn(name, F.coalesce(F.col(name), F.array().cast(kind))).drop(*[f"__{k}" for k in key])


def unnest(df: DataFrame, name: str, keep: tuple[str, ...]) -> DataFrame:
    return df.select(*keep, F.posexplode(name).alias("index0", "__x")).select(*keep, "index0", "__x.*")
