"""Near-duplicate documents by SuperMinHash signatures, banding, verification and union-find grouping.

Words are runs of bytes other than ASCII white space after lower-casing A-Z; a document's set holds its distinct shingles
of ``width`` words, as 64-bit hashes (with fewer words: the whole sequence as one; without words: empty, linked with
nothing).  Two documents are linked if 100 * intersection >= ``percent`` * union.

1. Documents with equal sets form one class, represented by its smallest doc_id; copies are not compared.
2. SuperMinHash (Ertl 2017): each element visits the slots in the order of its own random permutation, and slot p[j] takes
   the minimum of j + r_j.  Elements of a batch advance a rank at a time, and a document is done when all slots are taken,
   as later ranks can only be larger.
3. ``bands`` bands of ``rows`` slots give buckets.  A pair at similarity s is missed with (1 - s**rows)**bands; with the
   defaults that is 5e-7 at the limit of 0.8.
4. In every bucket each class is compared with one centre per component that is already known in that bucket, on the full
   sets; links found merge components (:func:`_common.components`), and rounds go on with the buckets that still span
   components.  Centres change from round to round.  After ``star_rounds`` rounds, all pairs that are left between
   different components of a bucket are verified, so that no link between components of a bucket is lost.

A group of n copies thus costs comparisons in proportion to n, not n * n.  After the first round, a bucket that still spans more than ``HOT``
components holds a crowd of unlike texts (a passage that they share fills a band).  Its documents move to finer buckets, one for each of
their rarest shingles (:func:`_prefixes`), which lose no pair, and rounds go on with those.

Null and empty texts stand alone.  Rows with a null doc_id are returned with a null class and kept by :func:`keep_one`.  Rows with one doc_id
more than once are one document, by the text whose set has the least digest; each of them is returned, with its own n_shingles.
Other columns are not carried by :func:`classes`; :func:`keep_one` carries columns of any name.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import components, cut, discard, quoted, release, table, unused

SEED = 0x5EED
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
#: Elements whose ranks advance together.
BATCH = 1 << 17
WORDS = 400_000
#: Components of one bucket beyond which its documents are looked up by their rarest shingles instead.
HOT = 200


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


@functools.lru_cache(maxsize=1)
def _words() -> _Words:
    return _Words()


def shingles(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a UTF-8 text."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words().__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = mix(out * _GOLD + h[k : k + n])
    return np.unique(out)


def signatures(sets: list[np.ndarray], slots: int, seed: int = SEED) -> np.ndarray:
    """One row of ``slots`` unsigned 64-bit values for each non-empty set: rank in the high 16 bits, then 48 random ones."""
    out = np.full((len(sets), slots), np.iinfo(np.uint64).max, np.uint64)
    first = 0
    while first < len(sets):
        last, total = first, 0
        while last < len(sets) and (total == 0 or total + len(sets[last]) <= BATCH):
            total += len(sets[last])
            last += 1
        if total > BATCH:  # one large set, in pieces: the minimum of its pieces
            whole = sets[first]
            for i in range(0, total, BATCH):
                np.minimum(out[first], _batch([whole[i : i + BATCH]], slots, seed)[0], out=out[first])
        else:
            out[first:last] = _batch(sets[first:last], slots, seed)
        first = last
    return out


def _batch(sets: list[np.ndarray], slots: int, seed: int) -> np.ndarray:
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    state = np.concatenate(sets) ^ np.uint64(seed) if sets else np.zeros(0, np.uint64)
    table_ = np.full(len(sets) * slots, np.iinfo(np.uint64).max, np.uint64)
    order = np.broadcast_to(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(owner), slots)).copy()
    for rank in range(slots):
        if not len(owner):
            break
        state = state + _GOLD
        r = mix(state)
        k = (rank + (r >> np.uint64(40)) * np.uint64(slots - rank) // np.uint64(1 << 24)).astype(np.int64)
        rows = np.arange(len(owner))
        slot = order[rows, k]
        order[rows, k] = order[rows, rank]
        low = mix(r + _M1) >> np.uint64(16)
        np.minimum.at(table_, owner * slots + slot, low | np.uint64(rank << 48))
        full = (table_.reshape(len(sets), slots) != np.iinfo(np.uint64).max).all(1)
        if full.any():
            live = ~full[owner]
            if not live.all():
                owner, state, order = owner[live], state[live], order[live]
    return table_.reshape(len(sets), slots)


def _binary(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _digest(shingles: bytes) -> bytes | None:
    """What names a set; none for the empty one."""
    return hashlib.blake2b(shingles, digest_size=16).digest() if shingles else None


def _describe(batches: Iterator[pa.RecordBatch], width: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_shingles", "set_id", "bands"]
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            sets = [shingles(t, width) for t in _binary(batch.column(1))]
            ids = [_digest(s.tobytes()) for s in sets]
            some = [i for i, s in enumerate(sets) if len(s)]
            sig = signatures([sets[i] for i in some], bands * rows).reshape(len(some), bands, rows)
            keys = np.full((len(some), bands), 7, np.uint64)
            for k in range(rows):
                keys = mix(keys * _GOLD + sig[:, :, k])
            keys = mix(keys + np.arange(bands, dtype=np.uint64))
            rows_out: list = [None] * len(sets)
            for i, row in zip(some, keys.astype(np.int64), strict=True):
                rows_out[i] = row
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.binary()), pa.array(rows_out, pa.list_(pa.int64()))], names=names)


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            sets = [shingles(t, width).tobytes() for t in _binary(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], names=["id", "set_id", "shingles"])


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if len(a) > len(b):
                a, b = b, a
            at = np.searchsorted(b, a)
            both = int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0
            ok.append(both > 0 and 100 * both >= percent * (len(a) + len(b) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], names=["a", "b", "linked"])


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of ``pairs`` that are linked, on their full sets."""
    left = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    both = left.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").select("a", "b", "x", "y")
    return both.mapInArrow(lambda it: _confirm(it, percent), "a long, b long, linked boolean").where("linked").select("a", "b")


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(bucket, rep): each document of ``sets`` (id, shingles) under the rarest of its shingles, as many as any set that it
    is linked with must share one of: two sets with 100 * intersection >= percent * union that are sorted in one order
    share a shingle among the first n - ceil(n * percent / 100) + 1 of each.  Shingles of many documents come last in the order,
    so what a crowd has in common makes no bucket.  Shingles of a single document make none either."""
    each = sets.mapInArrow(_explode, "rep long, shingle long")
    counts = each.groupBy("shingle").agg(F.count("*").alias("n"))
    order = F.sort_array(F.collect_list(F.struct("n", F.xxhash64("shingle").alias("h"), "shingle")))  # of one document
    ranked = each.join(counts, "shingle").groupBy("rep").agg(order.alias("s"))
    size = F.size("s")
    first = F.slice("s", F.lit(1), (size - F.floor((size * percent + 99) / 100) + 1).cast("int"))
    rare = ranked.select("rep", F.explode(first).alias("x")).where("x.n > 1")
    return rare.select(F.xxhash64(F.lit("shingle"), "x.shingle").alias("bucket"), "rep")


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            part = batch.slice(i, 64)
            sets = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), [len(x) for x in sets])), pa.array(np.concatenate(sets))], names=["rep", "shingle"])


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, bands: int = 32, rows: int = 4, star_rounds: int = 4) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs: component_id is the smallest doc_id reachable by links, null
    for a null doc_id."""
    spark = docs.sparkSession
    docs = docs.select(F.col(quoted(doc_id)).cast("long").alias("doc_id"), F.col(quoted(text)).alias("text"))
    described = table(docs.mapInArrow(lambda it: _describe(it, width, bands, rows), "doc_id long, n_shingles long, set_id binary, bands array<long>"), "signatures")
    # one set for each doc_id, then one representative for each set
    sole = described.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("set_id", "bands")).alias("s")).select("doc_id", "s.*")
    reps = table(sole.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.min("bands").alias("bands")), "classes")
    hits = reps.select("rep", F.explode("bands").alias("bucket"))
    shared = hits.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    members = table(hits.join(shared, "bucket").select("bucket", "rep"), "buckets")
    release(spark)
    candidates = members.select(F.col("rep").alias("doc_id")).distinct()
    texts = docs.join(candidates, "doc_id", "left_semi")
    sets = texts.mapInArrow(lambda it: _sets(it, width), "id long, set_id binary, shingles binary")
    sets = table(sets.groupBy("id").agg(F.min(F.struct("set_id", "shingles")).alias("s")).select("id", "s.shingles"), "sets")
    release(spark)

    group = members.select(F.col("rep").alias("id")).distinct().withColumn("component_id", F.col("id"))
    edges = tried = None
    scratch = [members]
    r = 0
    while True:
        placed = members.join(group.withColumnRenamed("id", "rep"), "rep")
        mixed = placed.groupBy("bucket").agg(F.min("component_id").alias("lo"), F.max("component_id").alias("hi"), F.count_distinct("component_id").alias("n")).where("lo <> hi").select("bucket", "n") if r == 1 else placed.groupBy("bucket").agg(F.min("component_id").alias("lo"), F.max("component_id").alias("hi")).where("lo <> hi").select("bucket")
        if r == 1:
            mixed = table(mixed, "mixed")
            scratch.append(mixed)
            hot = mixed.where(F.col("n") > HOT).select("bucket")
            if hot.limit(1).count():
                crowd = members.join(hot, "bucket", "left_semi").select(F.col("rep").alias("id")).distinct()
                finer = _prefixes(sets.join(crowd, "id", "left_semi"), percent)
                members = table(members.join(hot, "bucket", "left_anti").unionByName(finer), "buckets")
                scratch.append(members)
                placed = members.join(group.withColumnRenamed("id", "rep"), "rep")
                mixed = placed.groupBy("bucket").agg(F.min("component_id").alias("lo"), F.max("component_id").alias("hi")).where("lo <> hi").select("bucket")
        # a centre for each component of a bucket: by the smallest id first, then by a hash that changes
        if r == 0:
            centres = members.groupBy("bucket").agg(F.min("rep").alias("c")).withColumn("centre_component", F.col("c"))
        elif r < star_rounds:
            rank = F.struct(F.xxhash64("rep", F.lit(r)), F.col("rep"))
            centres = placed.groupBy("bucket", "component_id").agg(F.min(rank).alias("k")).select("bucket", F.col("component_id").alias("centre_component"), F.col("k.rep").alias("c"))
        else:
            centres = placed.select("bucket", F.col("component_id").alias("centre_component"), F.col("rep").alias("c"))
        pairs = placed.join(mixed, "bucket", "left_semi").join(centres, "bucket").where("component_id <> centre_component")
        pairs = pairs.select(F.least("rep", "c").alias("a"), F.greatest("rep", "c").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = table(pairs, "pairs")
        scratch.append(pairs)
        if not pairs.limit(1).count():
            if r >= star_rounds:
                break
            r = max(1, star_rounds) if r else 1  # nothing is left to try with these centres: on to all remaining pairs
            continue
        found = table(_verify(pairs, sets, percent), "links")
        scratch.append(found)
        tried = pairs if tried is None else tried.unionByName(pairs)
        if found.limit(1).count():
            edges = found if edges is None else edges.unionByName(found)
            merged = components(edges)
            group = table(group.select("id").join(merged, "id", "left").select("id", F.coalesce("component_id", "id").alias("component_id")), "groups")
        release(spark)
        if r >= star_rounds:
            break
        r += 1
    group = cut(group)
    discard(*scratch, sets)
    whole = reps.select("set_id", "rep").join(group.withColumnRenamed("id", "rep"), "rep", "left").select("set_id", F.coalesce("component_id", "rep").alias("component_id"))
    known = sole.select("doc_id", "set_id").join(whole, "set_id", "left").select("doc_id", F.coalesce("component_id", "doc_id").alias("component_id"))
    return described.select("doc_id", "n_shingles").join(known, "doc_id", "left")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its group; rows without doc_id stay."""
    gone = cut(classes(docs, doc_id, text, **how).where("component_id <> doc_id").select("doc_id").distinct())
    gone = gone.withColumnRenamed("doc_id", unused(docs.columns))
    return docs.join(gone, F.col(quoted(doc_id)) == F.col(gone.columns[0]), "left_anti")
