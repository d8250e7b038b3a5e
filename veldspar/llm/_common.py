"""Shared pieces: scratch tables in the cluster's shared folder, lineage cuts and connected components."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the word contracts define it, for JVM regular expressions.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``, qualified by Hadoop's default file system; a temporary one only where it
    is unset on a local master."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="veldspar-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    path = sc._jvm.org.apache.hadoop.fs.Path(root)
    whole = path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return whole.replace("file:/", "file:///", 1) if whole.startswith("file:/") and not whole.startswith("file://") else whole


_used: set[str] = set()


def new_folder(spark: SparkSession, label: str) -> str:
    """A new name below this application's part of the shared folder, which is deleted when the driver ends."""
    own = f"{scratch_root(spark).rstrip('/')}/veldspar-{spark.sparkContext.applicationId}"
    if own not in _used:
        if not _used:
            atexit.register(_clear)
        _used.add(own)
    return f"{own}/{label}-{uuid.uuid4().hex}"


def _clear() -> None:
    """At the end of the driver, when Spark may be gone already."""
    for own in _used:
        try:
            store, at = fs.FileSystem.from_uri(own)
            store.delete_dir(at)
        except (OSError, ValueError, pa.ArrowException):  # nothing was written there, or the store is gone
            continue


def table(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`table` that nothing reads any more, then the shuffle files of what made them."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    release(tables[0].sparkSession)


def cut(df: DataFrame) -> DataFrame:
    """An eager reliable checkpoint, for narrow data between rounds."""
    scratch_root(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let the context cleaner drop the shuffle files of finished steps."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def quoted(name: str) -> str:
    """A column name that may hold dots or backticks, for F.col."""
    return "`" + name.replace("`", "``") + "`"


def unused(names: list[str], stem: str = "_v") -> str:
    """A prefix with which no name begins, so that helper columns never clash with columns of the input."""
    low = [n.lower() for n in names]
    while any(n.startswith(stem) for n in low):
        stem += "v"
    return stem


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over one partition's edges; out goes one edge from each node to its root."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root and up != x:
            parent[x] = root
            x = up
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ra, rb = find(a), find(b)
            lo, hi = (ra, rb) if ra < rb else (rb, ra)
            parent[hi] = lo
            parent.setdefault(lo, lo)
    nodes = [x for x in parent if find(x) != x]
    for i in range(0, len(nodes), 65536):
        part = nodes[i : i + 65536]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], names=["v", "u"])


def components(edges: DataFrame) -> DataFrame:
    """(id, component_id) for every node of ``edges`` (two long columns): component_id is the smallest id reachable.

    Each round contracts every partition by union-find, then applies the large-star and small-star steps of Kiveris
    et al., so that long chains also end in a logarithmic number of rounds.  Only edge counts reach the driver.
    Empty edges give an empty table; self loops and repeated edges do no harm.
    """
    a, b = edges.columns[:2]
    e = edges.select(F.col(a).cast("long").alias("v"), F.col(b).cast("long").alias("u")).where("v <> u")
    e = cut(e.mapInArrow(_contract, "v long, u long").distinct())
    while True:
        chains = e.select(F.col("u").alias("x")).join(e.select(F.col("v").alias("x")), "x", "left_semi")
        forks = e.groupBy("v").count().where("count > 1")
        if not chains.limit(1).count() and not forks.limit(1).count():
            break
        both = e.unionByName(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.min("u").alias("m")).select(F.col("v").alias("k"), F.least("v", "m").alias("m"))
        large = both.join(low, both.v == low.k).where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        down = large.select(F.greatest("u", "v").alias("v"), F.least("u", "v").alias("u")).where("u <> v")
        low2 = down.groupBy("v").agg(F.min("u").alias("m")).withColumnRenamed("v", "k")
        pair = F.array(F.struct(F.col("u").alias("v"), F.col("m").alias("u")), F.struct(F.col("v").alias("v"), F.col("m").alias("u")))
        small = down.join(low2, down.v == low2.k).select(F.explode(pair).alias("e")).select("e.v", "e.u")
        e = cut(small.where("u <> v").distinct().mapInArrow(_contract, "v long, u long").distinct())
        release(edges.sparkSession)
    roots = e.select(F.col("u").alias("id")).distinct().select("id", F.col("id").alias("component_id"))
    return e.select(F.col("v").alias("id"), F.col("u").alias("component_id")).unionByName(roots)
