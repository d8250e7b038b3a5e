"""Near-duplicate vectors by NN-descent.

Vectors of one label are compared by cosine in double precision.  Null labels, and vectors that are null, zero or hold
null or non-finite components, link with nothing.

1. Equal vectors of a label (up to a positive factor, bit by bit after normalising) are one class, so exact copies are never compared.
2. Start: random hyperplane hashes put the vectors of a label into leaves, with as many planes as its size needs; large leaves are cut into chunks of about ``LEAF`` by a
   hash.  The ``k`` nearest vectors within the leaves make the first graph.  Labels of at most ``BLOCK`` vectors are one leaf, so
   all their pairs are compared.  There are so many hashes (``trees`` at least) that two vectors at the threshold without any other neighbour
   share a leaf of the largest label with probability ``MEET``.
3. Refinement: around each vector, its neighbours and the vectors that have it as a neighbour are compared with each other
   where one of them is new to the graph.  Hubs are cut into chunks of bounded size.  Lists keep the k nearest; rounds end when few lists change.
4. Saturation: a list whose k-th neighbour still reaches the threshold may hide links, but only to a vector whose list is full too.  Links found so
   far connect vectors into groups; the vectors of all groups with a full list are put into blocks by group and compared in pairs of blocks of a label, across
   groups as well, which return counts of links and one forest of links and not the links.  Blocks hold vectors of one side of several hyperplanes, and pairs of blocks that lie too far apart are left out: each block has a
   centre and an angle that holds its vectors.  Links between groups join them.
5. Audit: bounded samples of vectors, one for each class of label sizes (by powers of 16; labels of at most BLOCK need none), are compared with all vectors of their labels, and the true
   number of links with the number found.  With recall of any class below ``recall``, k is doubled and the search goes on; if it is still below at ``max_k``, all vectors of a label are compared in blocks.

Rows with a null vec_id link with nothing; of rows with one vec_id, the first by label and components counts, for all of them.  Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import components, cut, quoted, release, table

LEAF, HUB, BLOCK = 48, 64, 512
#: Blocks whose centres are compared at once.
CENTRES = 1024
#: Vectors of each sample.
AUDIT = 512
MEET = 0.995
SEED = 20_240_501


def _matrix(column: pa.Array) -> np.ndarray:
    rows = len(column)
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(rows, -1) if rows else np.zeros((0, 0))


def _normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for x in batch.column(2):
            one = None
            if x.is_valid:
                v = np.array([np.nan if c is None else c for c in x.as_py()], np.float64)
                if len(v) and np.isfinite(v).all() and (top := np.abs(v).max()) > 0:
                    v = v / top
                    one = (v / np.sqrt((v * v).sum()) + 0.0).tobytes()
            out.append(one)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["vec_id", "label", "unit"])


def _leaves(batches: Iterator[pa.RecordBatch], trees: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Rows (..., unit, bits): the leaf of each of ``trees`` hashes of at most ``bits`` planes each; the first alone for no bits."""
    planes: dict[int, np.ndarray] = {}
    powers = 1 << np.arange(bits, dtype=np.int64) if bits else np.zeros(0, np.int64)
    for batch in batches:
        units, own = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
        keys = np.zeros((len(units), trees), np.int64)
        by_size: dict[int, list[int]] = {}
        for i, u in enumerate(units):
            by_size.setdefault(len(u) // 8, []).append(i)
        for d, rows in by_size.items():
            if d not in planes:
                planes[d] = np.random.default_rng(SEED + d).standard_normal((d, trees * bits))
            x = np.frombuffer(b"".join(units[i] for i in rows), np.float64).reshape(len(rows), d)
            keys[rows] = ((x @ planes[d]).reshape(len(rows), trees, bits) > 0) @ powers
        keys = (keys & ((np.int64(1) << own.astype(np.int64)) - 1)[:, None]) * trees + np.arange(trees)
        leaves = [k if n else k[:1] for k, n in zip(keys, own.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(leaves, pa.list_(pa.int64()))], names=[*batch.schema.names[:-1], "leaves"])


def _bits(n: Column, size: int) -> Column:
    """Planes that cut n vectors into leaves of about size / 2; none for at most BLOCK."""
    return F.when(n <= BLOCK, 0).otherwise(F.least(F.lit(40), F.ceil(F.log2(n / size)) + 1)).cast("int")


_OUT = ["u", "v", "sim"]


def _edges(u: np.ndarray, v: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], names=_OUT)


def _local(batches: Iterator[pa.RecordBatch], k: int, fresh: bool) -> Iterator[pa.RecordBatch]:
    """Column 0: a list of (id, unit, bar, new).  Pairs of each list, both ways; with ``fresh``, only those that have a new member and
    pass the bar of the vector whose list they would enter.  At most k per vector and list."""
    for batch in batches:
        us, vs, ss, held = [], [], [], 0
        for group in batch.column(0):
            items = group.as_py()
            if len(items) < 2:
                continue
            ids = np.array([i["id"] for i in items])
            by_size: dict[int, list[int]] = {}
            for j, i in enumerate(items):
                by_size.setdefault(len(i["unit"]), []).append(j)
            for rows in by_size.values():
                x = np.frombuffer(b"".join(items[j]["unit"] for j in rows), np.float64).reshape(len(rows), -1)
                sims = x @ x.T
                np.fill_diagonal(sims, -2)
                if fresh:
                    new = np.array([items[j]["new"] for j in rows])
                    bar = np.array([items[j]["bar"] for j in rows])
                    sims[~(new[:, None] | new[None, :])] = -2
                    sims[sims <= bar[:, None]] = -2
                m = min(k, len(rows) - 1)
                if m < 1:
                    continue
                top = np.argpartition(-sims, m - 1, axis=1)[:, :m]
                a, b = np.repeat(np.arange(len(rows)), m), top.ravel()
                s = sims[a, b]
                ok = s > -2
                at = np.array(rows)
                us.append(ids[at[a[ok]]])
                vs.append(ids[at[b[ok]]])
                ss.append(s[ok])
                held += len(ss[-1])
            if held > 100_000:
                yield _edges(np.concatenate(us), np.concatenate(vs), np.concatenate(ss))
                us, vs, ss, held = [], [], [], 0
        if us:
            yield _edges(np.concatenate(us), np.concatenate(vs), np.concatenate(ss))


def _top(edges: DataFrame, k: int) -> DataFrame:
    """(u, v, sim, new): the k nearest of each u; a pair counts as new only if all its rows say so.  Every task cuts its lists
    to k before they move (a window group limit)."""
    once = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.col("sim").desc(), "v"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def _forest(hit: np.ndarray) -> list[tuple[int, int]]:
    """Row and column pairs that connect whatever the marks of a matrix connect."""
    out, rows_left, cols_left = [], hit.any(axis=1), np.ones(hit.shape[1], bool)
    for start in np.flatnonzero(rows_left):
        rows = np.array([start]) if rows_left[start] else np.zeros(0, np.int64)
        rows_left[start] = False
        while len(rows):
            part = hit[rows] & cols_left
            cols = np.flatnonzero(part.any(axis=0))
            if not len(cols):
                break
            out += zip(rows[part[:, cols].argmax(axis=0)].tolist(), cols.tolist(), strict=True)
            cols_left[cols] = False
            part = hit[:, cols] & rows_left[:, None]
            rows = np.flatnonzero(part.any(axis=1))
            out += zip(rows.tolist(), cols[part[rows].argmax(axis=1)].tolist(), strict=True)
            rows_left[rows] = False
    return out


def _blocks(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows (same, ids of a, units of a, ids of b, units of b): counts of links of each id across the two blocks, and (id, other) of a forest of links."""
    for batch in batches:
        for same, ai, au, bi, bu in zip(*[batch.column(i) for i in range(5)], strict=True):
            a, b = ai.as_py(), bi.as_py()
            x, y = (np.frombuffer(b"".join(z.as_py()), np.float64).reshape(len(w), -1) for z, w in ((au, a), (bu, b)))
            return_b = not same.as_py()
            hit = x @ y.T >= threshold
            if not return_b:
                np.fill_diagonal(hit, False)
            # the size of a class counts for its vectors
            wa, wb = np.array([i["n"] for i in a]), np.array([i["n"] for i in b])
            rows = [(i["id"], None, int(c)) for i, c in zip(a, hit @ wb, strict=True) if c]
            if return_b:
                rows += [(i["id"], None, int(c)) for i, c in zip(b, hit.T @ wa, strict=True) if c]
            rows += [(a[i]["id"], b[j]["id"], None) for i, j in _forest(hit)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["id", "other", "links"])


def _centres(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, label, dim, units): the centre of each block and the largest angle from it to a vector of the block."""
    for batch in batches:
        centres, angles = [], []
        for units in batch.column(3):
            x = np.frombuffer(b"".join(units.as_py()), np.float64).reshape(len(units), -1)
            c = x.sum(axis=0)
            c = c / norm if (norm := np.sqrt((c * c).sum())) > 1e-9 else x[0]
            centres.append(c.tobytes())
            angles.append(float(np.arccos(np.clip(x @ c, -1, 1)).max()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(centres, pa.binary()), pa.array(angles, pa.float64())], names=["key", "label", "dim", "centre", "angle"])


def _near(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows (same, blocks of a, blocks of b): pairs of blocks that may hold a link; angles on a sphere obey the triangle inequality."""
    reach = float(np.arccos(np.clip(threshold, -1, 1))) + 1e-6
    for batch in batches:
        for same, a, b in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
            (ka, x, ra), (kb, y, rb) = ((np.array([i["key"] for i in w]), np.frombuffer(b"".join(i["centre"] for i in w), np.float64).reshape(len(w), -1), np.array([i["angle"] for i in w])) for w in (a, b))
            ok = np.arccos(np.clip(x @ y.T, -1, 1)) <= ra[:, None] + rb[None, :] + reach
            i, j = np.nonzero(np.triu(ok) if same else ok)
            yield pa.RecordBatch.from_arrays([pa.array(ka[i], pa.int64()), pa.array(kb[j], pa.int64())], names=["a", "b"])


def _dense(members: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """All links among members (group, id, n, label, unit) of a label: (id, links), and edges (a, b) that connect what they connect."""
    spark = members.sparkSession
    members = members.withColumn("dim", F.octet_length("unit"))
    size = members.groupBy("label", "dim", "group").agg(_bits(F.count("*"), BLOCK).alias("bits"))
    most = size.agg(F.max("bits")).first()[0] or 0
    shape = "label long, dim int, group long, id long, n long, unit binary, leaves array<long>"
    leafed = members.join(size, ["label", "dim", "group"]).select("label", "dim", F.col("group").cast("long").alias("group"), "id", "n", "unit", "bits").mapInArrow(lambda it: _leaves(it, 1, most), shape).withColumn("leaf", F.col("leaves")[0])
    of_leaf = leafed.groupBy("label", "dim", "group", "leaf").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    blocked = table(
        leafed.join(of_leaf, ["label", "dim", "group", "leaf"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).groupBy("label", "dim", "group", "leaf", "block")
        .agg(F.sort_array(F.collect_list(F.struct("id", "n", "unit"))).alias("items")), "blocks",  # about BLOCK
    )
    parts = blocked.select(F.col("items")[0]["id"].alias("key"), "label", "dim", F.transform("items", lambda i: F.struct(i.id.alias("id"), i.n.alias("n"))).alias("ids"), F.transform("items", lambda i: i.unit).alias("units"))
    centres = cut(parts.select("key", "label", "dim", "units").mapInArrow(_centres, "key long, label long, dim int, centre binary, angle double"))
    chunks = centres.groupBy("label", "dim").agg(F.ceil(F.count("*") / CENTRES).alias("chunks"))
    lists = centres.join(chunks, ["label", "dim"]).withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks"))).groupBy("label", "dim", "chunks", "chunk").agg(F.sort_array(F.collect_list(F.struct("key", "centre", "angle"))).alias("items"))  # about CENTRES
    lists = table(lists, "centres")
    pairs = lists.select("label", "dim", "chunk", F.explode(F.sequence(F.col("chunk"), F.col("chunks") - 1)).alias("other"))
    both = pairs.join(lists.select("label", "dim", "chunk", F.col("items").alias("a")), ["label", "dim", "chunk"]).join(lists.select("label", "dim", F.col("chunk").alias("other"), F.col("items").alias("b")), ["label", "dim", "other"])
    near = cut(both.select((F.col("chunk") == F.col("other")).alias("same"), "a", "b").mapInArrow(lambda it: _near(it, threshold), "a long, b long"))
    left = parts.select(F.col("key").alias("a"), F.col("ids").alias("ai"), F.col("units").alias("au"))
    right = parts.select(F.col("key").alias("b"), F.col("ids").alias("bi"), F.col("units").alias("bu"))
    tiles = near.join(left, "a").join(right, "b").select((F.col("a") == F.col("b")).alias("same"), "ai", "au", "bi", "bu").repartition(max(8, spark.sparkContext.defaultParallelism * 2))
    found = table(tiles.mapInArrow(lambda it: _blocks(it, threshold), "id long, other long, links long"), "found")
    return found.where("links IS NOT NULL").groupBy("id").agg(F.sum("links").alias("links")), found.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b"))


def search(units: DataFrame, k: int, trees: int, rounds: int, settle: float, graph: DataFrame | None = None, threshold: float = 0.98) -> DataFrame:
    """(u, v, sim, new): k-nearest-neighbour lists of units (id, label, unit) by NN-descent, from ``graph`` or from leaves."""
    n = units.count()
    if graph is None:
        sizes = units.groupBy("label").agg(_bits(F.count("*"), LEAF).alias("bits"))
        bits = sizes.agg(F.max("bits")).first()[0] or 0
        side = (1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi) ** bits  # both on one side of all planes of a hash
        trees = max(trees, int(np.ceil(np.log(1 - MEET) / np.log1p(-side)))) if side < 1 else trees
        hashed = units.join(sizes, "label").select("id", "label", "unit", "bits").mapInArrow(lambda it: _leaves(it, trees, bits), "id long, label long, unit binary, leaves array<long>").select("id", "label", "unit", F.explode("leaves").alias("leaf"))
        counts = hashed.groupBy("label", "leaf").agg(F.count("*").alias("n")).where("n > 1")
        whole = sizes.where("bits = 0").select("label", F.lit(True).alias("whole"))
        placed = hashed.join(counts, ["label", "leaf"]).join(whole, "label", "left").withColumn("chunk", F.when(F.col("whole"), 0).otherwise(F.pmod(F.xxhash64("id", "leaf"), F.ceil(F.col("n") / LEAF))))
        lists = placed.groupBy("label", "leaf", "chunk").agg(F.collect_list(F.struct("id", "unit")).alias("items"))  # about LEAF, or BLOCK at most
        graph = cut(_top(lists.select("items").mapInArrow(lambda it: _local(it, k, False), "u long, v long, sim double").withColumn("new", F.lit(True)), k))
    for _ in range(rounds):
        around = graph.select(F.col("u").alias("c"), F.col("v").alias("m"), "new").unionByName(graph.select(F.col("v").alias("c"), F.col("u").alias("m"), "new"))
        around = around.groupBy("c", "m").agg(F.max("new").alias("new"))
        degree = around.groupBy("c").agg(F.count("*").alias("n"), F.max("new").alias("any")).where("any")
        chunked = around.join(degree, "c").withColumn("chunk", F.pmod(F.xxhash64("c", "m"), F.ceil(F.col("n") / HUB))).select("c", "chunk", "m", "new")
        bars = graph.groupBy("u").agg(F.when(F.count("*") >= k, F.min("sim")).otherwise(F.lit(-2.0)).alias("bar"))
        known = units.join(bars, units.id == bars.u, "left").select("id", "unit", F.coalesce("bar", F.lit(-2.0)).alias("bar"))
        lists = chunked.join(known, F.col("m") == F.col("id")).groupBy("c", "chunk").agg(F.collect_list(F.struct("id", "unit", "bar", "new")).alias("items"))  # about HUB
        found = lists.select("items").mapInArrow(lambda it: _local(it, k, True), "u long, v long, sim double").withColumn("new", F.lit(True))
        graph = cut(_top(graph.withColumn("new", F.lit(False)).unionByName(found), k))
        changed = graph.where("new").count()
        release(units.sparkSession)
        if changed <= settle * n * k:
            break
    return graph


def audit(units: DataFrame, counts: DataFrame, threshold: float) -> tuple[float, int]:
    """The least share, of all classes of label sizes, of the links of at most AUDIT vectors of units (id, label, n, unit), chosen by hash,
    that counts (id, links) hold; and how many links those vectors have."""
    kinds = units.groupBy("label").agg(F.count("*").alias("n_label")).where(F.col("n_label") > BLOCK).select("label", F.floor(F.log2("n_label") / 4).cast("int").alias("kind"))
    picked = []
    for row in kinds.select("kind").distinct().collect():  # sixteen at most
        some = units.join(kinds.where(F.col("kind") == row.kind), "label")
        picked += some.orderBy(F.xxhash64("id", F.lit(SEED))).limit(AUDIT).collect()
    if not picked:
        return 1.0, 0
    kind_of = {r.id: r.kind for r in picked}
    by: dict[tuple[int, int], list] = {}
    for r in picked:
        by.setdefault((r.label, len(r.unit)), []).append(r)
    queries = {key: (np.array([r.id for r in rows]), np.frombuffer(b"".join(bytes(r.unit) for r in rows), np.float64).reshape(len(rows), -1)) for key, rows in by.items()}

    def run(batches):
        for batch in batches:
            ids, labels, units_, sizes = (batch.column(i).to_pylist() for i in range(4))
            groups: dict[tuple[int, int], list[int]] = {}
            for i, (label, unit) in enumerate(zip(labels, units_, strict=True)):
                groups.setdefault((label, len(unit)), []).append(i)
            for key, rows in groups.items():
                if key in queries:
                    q, x = queries[key]
                    y = np.frombuffer(b"".join(units_[i] for i in rows), np.float64).reshape(len(rows), -1)
                    a, b = np.nonzero(x @ y.T >= threshold)
                    v, n = np.array([ids[i] for i in rows])[b], np.array([sizes[i] for i in rows])[b]
                    other = q[a] != v
                    yield pa.RecordBatch.from_arrays([pa.array(q[a[other]], pa.int64()), pa.array(n[other], pa.int64())], names=["id", "n"])

    true = units.select("id", "label", "unit", "n").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    have: dict[int, list[int]] = {}
    for row in true.join(counts, "id", "left").select("id", "n", F.coalesce("links", F.lit(0)).alias("links")).collect():  # of the samples
        sums = have.setdefault(kind_of[row.id], [0, 0])
        sums[0] += row.n
        sums[1] += min(row.links, row.n)
    return min((found / n for n, found in have.values()), default=1.0), sum(n for n, _ in have.values())


def _resolve(reps: DataFrame, graph: DataFrame, threshold: float, k: int) -> tuple[DataFrame, DataFrame]:
    """(id, links) and (id, component_id) from lists of k, with all links among the groups that have a full list."""
    close = cut(graph.where(F.col("sim") >= threshold).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct())
    group = components(close)
    full = graph.where(F.col("sim") >= threshold).groupBy("u").agg(F.count("*").alias("have")).where(F.col("have") >= k).select(F.col("u").alias("id"))
    saturated = cut(group.join(full, "id", "left_semi").select("component_id").distinct())
    sizes = reps.select("id", "n")
    both = close.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(close.select(F.col("b").alias("id"), F.col("a").alias("other")))
    counts = both.join(sizes.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.sum("n").alias("links"))
    if saturated.limit(1).count():
        members = group.join(saturated, "component_id", "left_semi").join(reps, "id").select(F.col("component_id").alias("group"), "id", "n", "label", "unit")
        dense, edges = _dense(members, threshold)
        counts = counts.join(members.select("id"), "id", "left_anti").unionByName(dense)
        group = components(close.unionByName(edges))
    return cut(counts), group


def links(vectors: DataFrame, threshold: float = 0.98, k: int = 12, trees: int = 6, rounds: int = 8, settle: float = 0.001, recall: float = 0.99, max_k: int = 96, vec_id: str = "vec_id", label: str = "label", embedding: str = "embedding", report: dict | None = None) -> DataFrame:
    """(vec_id, n_links, component_id) for every row.  report: gets the recall that the audit measured, on how many links, and the k in use
    (None where all vectors of a label were compared)."""
    rows = vectors.select(F.col(quoted(vec_id)).cast("long").alias("vec_id"), F.col(quoted(label)).cast("long").alias("label"), F.col(quoted(embedding)).alias("embedding"))
    unit = table(rows.mapInArrow(_normal, "vec_id long, label long, unit binary"), "units")
    sole = unit.where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min(F.struct("label", "unit")).alias("s")).select("vec_id", "s.*")
    sole = sole.withColumn("class_key", F.when(F.col("label").isNotNull() & F.col("unit").isNotNull(), F.sha2("unit", 256)))
    reps = table(sole.where("class_key IS NOT NULL").groupBy("label", "class_key").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.min("unit").alias("unit")), "reps")
    units = reps.select("id", "label", "unit")
    graph = search(units, k, trees, rounds, settle, threshold=threshold)
    counts, group = _resolve(reps, graph, threshold, k)
    while True:
        got, known = audit(reps, counts, threshold)
        if report is not None:
            report |= {"recall": got, "links": known, "k": k}
        if got >= recall:
            break
        if k >= max_k:
            counts, edges = _dense(reps.withColumn("group", F.lit(0)), threshold)
            group = components(edges)
            if report is not None:
                report |= {"recall": 1.0, "k": None}
            break
        k *= 2
        graph = search(units, k, trees, rounds, settle, cut(graph.withColumn("new", F.lit(True))))
        counts, group = _resolve(reps, graph, threshold, k)
    per_class = reps.select("label", "class_key", "id", "n").join(counts, "id", "left").join(group, "id", "left")
    per_class = per_class.select("label", "class_key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    each = sole.select("vec_id", "label", "class_key").join(per_class, ["label", "class_key"], "left").select("vec_id", "n_links", F.coalesce("component_id", "vec_id").alias("component_id"))
    return unit.select("vec_id").join(each, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "component_id")
