"""Mixing sources to target weights by Poisson replication, in native DataFrame operations.

A source's target rate is ``total * weight / size``: its share of the mix over its share of the corpus, where sizes count
UTF-8 bytes of text.  Each row draws its number of copies by inverting the Poisson distribution of that mean at a uniform
number taken from a keyed hash of (seed, doc_id, text hash), so a run is reproducible and rows draw independently whatever
the partitioning.  Rates above ``CHUNK`` are sums of independent draws of at most ``CHUNK`` each.  Copies are exploded
and shuffled globally by a second hash: partitions are random subsets and each is in random order.

weights: {source: weight}; sources left out get ``rest`` (0 by default, so they are dropped), and None stands for the null
source.  Without weights, weight is size ** ``temperature``.  Only the statistics of the sources move before the copies:
they are summed per partition first, so a hot source is no hot task.  They are broadcast while at most ``MAX_SOURCES``
sources exist; beyond that they are joined by shuffle with salted keys.

Null and empty texts count one byte, so that a source of such rows still has a rate.  Repeated rows draw alike.  Empty
tables give no rows.  Columns of any name pass through; only ``copy`` must be a new name, else ValueError.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import quoted, unused

CHUNK = 64.0
MAX_SOURCES = 10_000
#: Parts into which each source is cut where sources are joined by shuffle.
SALTS = 64
SEED = "mix-1"
#: Digits of a hash that make a uniform number: 13 hexadecimal ones, 52 bits.
_DIGITS, _SPAN = 13, float(1 << 52)


def uniform(*parts: Column) -> Column:
    """A uniform number in (0, 1) from a hash of the parts."""
    digest = F.md5(F.concat_ws("\x1f", *parts).cast("binary"))
    return (F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("double") + 0.5) / _SPAN


def poisson(rate: Column, *parts: Column) -> Column:
    """The Poisson quantile of ``uniform(parts)`` at ``rate`` (at most CHUNK): the number of k whose distribution function
    is below it.  The sum stops where terms no longer change a double."""
    top = int(CHUNK + 14 * math.sqrt(CHUNK) + 30)
    # the uniform number goes along, or it would be hashed again in each step
    start = F.struct(uniform(*parts).alias("u"), F.exp(-rate).alias("term"), F.exp(-rate).alias("total"), F.lit(0).alias("k"))

    def step(acc: Column, i: Column) -> Column:
        term = acc.term * rate / i
        return F.when(acc.total < acc.u, F.struct(acc.u.alias("u"), term.alias("term"), (acc.total + term).alias("total"), (acc.k + 1).alias("k"))).otherwise(acc)

    last = F.least(F.lit(top), F.ceil(rate + 14 * F.sqrt(rate) + 30).cast("int"))
    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc.k)


def _size(text: str) -> Column:
    return F.greatest(F.coalesce(F.octet_length(F.col(quoted(text))), F.lit(0)), F.lit(1)).cast("double")


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, rest: float = 0.0, temperature: float = 0.5, total: float = 1.0, source: str = "source", text: str = "text") -> DataFrame:
    """(source, rate) for every source of docs; total is the size of the mix against the corpus."""
    sizes = docs.groupBy(F.col(quoted(source)).alias("source")).agg(F.sum(_size(text)).alias("size"))
    if weights is None:
        weight = F.pow("size", F.lit(temperature))
    else:
        if any(w < 0 for w in [*weights.values(), rest]):
            raise ValueError("weights are not negative")
        weight = F.lit(float(rest))
        for name, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    sizes = sizes.withColumn("weight", weight)
    sums = sizes.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))
    share = F.try_divide(F.col("weight"), F.col("all_weight"))
    return sizes.crossJoin(F.broadcast(sums)).select("source", F.coalesce(F.lit(float(total)) * share * F.col("all_size") / F.col("size"), F.lit(0.0)).alias("rate"))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, rest: float = 0.0, temperature: float = 0.5, total: float = 1.0, seed: str = SEED, doc_id: str = "doc_id", source: str = "source", text: str = "text", copy: str = "copy") -> DataFrame:
    """The copies of docs, shuffled, with all columns and the number ``copy`` (from 0) of each copy of a row."""
    if copy.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"column {copy} is already there; name another")
    columns = docs.columns
    at = unused([*columns, copy])  # helper columns clash with none of the input
    names = {n: f"{at}_{n}" for n in ("id", "text", "source", "of", "rate", "salt", "want", "n", "order")}
    known = rates(docs, weights, rest, temperature, total, source, text).withColumnsRenamed({"source": names["of"], "rate": names["rate"]})
    spark = docs.sparkSession
    rows = known.limit(MAX_SOURCES + 1).collect()
    docs = docs.withColumns({names["id"]: F.col(quoted(doc_id)).cast("string"), names["text"]: F.md5(F.coalesce(F.col(quoted(text)), F.lit("")).cast("binary"))})
    key = F.col(quoted(source)).eqNullSafe(F.col(names["of"]))
    if len(rows) <= MAX_SOURCES:
        joined = docs.join(F.broadcast(spark.createDataFrame(rows, known.schema)), key, "left")
    else:
        spread = known.withColumn(names["salt"], F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = docs.withColumn(names["want"], F.pmod(F.xxhash64(names["id"], names["text"]), F.lit(SALTS))).join(spread, key & (F.col(names["want"]) == F.col(names["salt"])), "left")
    who = [F.lit(seed), F.coalesce(F.col(names["id"]), F.lit("-")), F.col(names["text"])]
    rate = F.col(names["rate"])
    whole = F.floor(rate / CHUNK)
    extra = F.when(whole > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(whole, F.lit(1).cast("long"))), F.lit(0), lambda s, i: s + poisson(F.lit(CHUNK), *who, i.cast("string")))).otherwise(0)
    part = F.when(rate - whole * CHUNK > 0, poisson(rate - whole * CHUNK, *who, F.lit("0"))).otherwise(0)
    counted = joined.withColumn(names["n"], part + extra).where(F.col(names["n"]) > 0)
    copies = counted.withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(names["n"]) - 1))).withColumn(names["order"], F.md5(F.concat_ws("\x1f", F.lit("order"), *who, F.col(quoted(copy)).cast("string")).cast("binary")))
    return copies.repartition(names["order"]).sortWithinPartitions(names["order"]).select(*map(quoted, [*columns, copy]))
