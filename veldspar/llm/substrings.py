"""Repeated byte strings across documents, by suffix arrays.

A byte is removed if it lies in a string of ``length`` bytes (a window) that also starts earlier: in a smaller doc_id, or
further left in the same document.  Windows are judged on the input.

1. Documents with equal texts form one class; copies of its smallest doc_id are removed whole (texts shorter than a window stay).
2. Anchors narrow the search without losing any repeat: equal windows contain equal minimizers, the least of the hashes of
   their ``GRAM``-byte strings.  Only windows whose minimizer occurs in two texts, or twice in one, can repeat.  Consecutive windows with one minimizer form a
   region; regions are sent to shards by that value, so equal windows always meet in one shard, and shards need nothing from one another.
3. Equal regions collapse to the first of them, before they move; the windows of the others repeat it.
4. Each shard sorts its suffixes by Larsson-Sadakane refinement: eight bytes first, then doubling, and only groups that are
   not yet sorted take part.  Kasai's algorithm gives the common prefixes of neighbours; runs of at least ``length`` are equal windows.
5. A minimizer with more than ``HOT`` bytes of different regions (the edge of a passage that very many documents share) is parted:
   equal windows hold it at one offset, so windows go by classes of offsets, and with each by the bytes that all windows of the class share.
   Equal regions collapse again.  This loses no repeat, and what is left of the crowd spreads over shards and tasks.
6. Regions of one minimizer that exceed a shard all the same are cut into several.  Each has its own suffix array, and windows of one
   are looked up in the others by binary search.

Null and empty texts have no windows.  A null doc_id comes before all others.  Rows that repeat (doc_id, text) get equal rows; different texts under
one doc_id are separate documents in order of their hash.  An empty table gives no rows; other columns are not carried.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, release, table
from .minhash import mix

GRAM = 24
#: Bytes of text in one suffix array, about.
SHARD = 1_500_000
#: Bytes of different regions around one minimizer beyond which its windows are parted by what is around it.
HOT = 3_000_000
_C = [pow(0x9E3779B97F4A7C15 | 1, 1 << i, 1 << 64) for i in range(5)]


# -- anchors


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM = 16 + 8 bytes at each place."""
    h = b.astype(np.uint64) + np.uint64(1)
    eight = h
    for i in range(4):
        step = 1 << i
        if step == 8:
            eight = h
        h = h[:-step] * np.uint64(_C[i]) + h[step:]
    both = h[: len(eight) - 16] * np.uint64(_C[3]) + eight[16:]
    return mix(both)


def _sliding(x: np.ndarray, width: int, least) -> np.ndarray:
    """least (np.minimum or np.maximum) over each ``width`` neighbours."""
    step = 1
    while step * 2 <= width:
        x = least(x[:-step], x[step:])
        step *= 2
    return least(x[: len(x) - (width - step)], x[width - step :]) if step < width else x


def minimizers(b: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each place, and the minimizer of each window."""
    h = gram_hashes(b)
    return h, _sliding(h, length - GRAM + 1, np.minimum)


def anchors(b: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct minimizers of a text, and whether each occurs at more than one place."""
    h, least = minimizers(b, length)
    width = length - GRAM + 1
    pad = np.zeros(width - 1, np.uint64)
    of_place = _sliding(np.concatenate([pad, least, pad]), width, np.maximum)
    values, counts = np.unique(h[h == of_place], return_counts=True)
    return values, counts > 1


# -- suffix arrays


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Places of text in order of their suffixes.  The order is full, without ties at some depth, since Kasai's bound on
    the common prefix of the next place holds only then."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    word = np.zeros(n, np.uint64)
    for i in range(8):
        word = word << np.uint64(8) | padded[i : i + n]
    sa = n - 1 - np.argsort(word[::-1], kind="stable")  # of equal words the shorter suffix first
    left = np.minimum(n - sa, 8)
    head = np.concatenate([[True], (word[sa[1:]] != word[sa[:-1]]) | (left[1:] != left[:-1])])
    rank = np.zeros(n + 1, np.int64)  # the number of a group is the place of its first suffix, 1 up; 0 is past the end
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0)) + 1
    h = 8
    while True:
        alone = head & np.concatenate([head[1:], [True]])
        todo = np.flatnonzero(~alone)
        if not len(todo):
            break
        part = sa[todo]
        key = rank[part] * np.int64(n + 2) + rank[np.minimum(part + h, n)]
        order = np.argsort(key)
        part, key = part[order], key[order]
        sa[todo] = part
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        head[todo] |= fresh
        start = np.maximum.accumulate(np.where(fresh, todo, 0))
        rank[part] = start + 1
        h *= 2
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray, cap: int, lanes: int = 4096) -> np.ndarray:
    """Kasai's common prefixes of each suffix with its predecessor in sa, up to ``cap``: the prefix at a place is at least
    that of the place before less one.  Lanes of places run side by side."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    padded = np.concatenate([text, np.zeros(cap + 8, np.uint8)])
    size = -(-n // lanes)
    place = np.arange(0, n, size)
    got = np.zeros(len(place), np.int64)
    out = np.zeros(n, np.int64)
    for _ in range(size):
        live = place < n
        place, got = place[live], got[live]
        other = before[place]
        got = np.where(other < 0, 0, np.maximum(got - 1, 0))
        open_ = np.flatnonzero(other >= 0)
        while len(open_):
            p, q, g = place[open_], other[open_], got[open_]
            more = (g < cap) & (np.maximum(p, q) + g < n)
            more &= padded[p + g] == padded[q + g]
            open_ = open_[more]
            got[open_] += 1
        out[place] = got
        place = place + 1
    return out[sa]


def _groups(text: np.ndarray, valid: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Valid places in suffix order, and for each the number of its group of equal windows."""
    sa = suffix_array(text)
    lcp = common_prefixes(text, sa, length)
    keep = np.flatnonzero(valid[sa])
    if not len(keep):
        return keep, keep
    low = np.minimum.reduceat(lcp, np.concatenate([[0], keep[:-1] + 1]))  # least prefix since the last valid place
    return sa[keep], np.cumsum(np.concatenate([[0], low[1:] < length])) if len(keep) > 1 else np.zeros(1, np.int64)


def _lookup(places: np.ndarray, text: np.ndarray, queries: np.ndarray, length: int) -> np.ndarray:
    """For each row of queries (windows as bytes), the position in ``places`` (sorted windows of text) of the first that is
    equal, or -1: binary search for all rows at once."""
    lo, hi = np.zeros(len(queries), np.int64), np.full(len(queries), len(places), np.int64)
    span = np.arange(length)

    def order(mid: np.ndarray, rows: np.ndarray) -> np.ndarray:
        there, here = text[places[mid][:, None] + span], queries[rows]
        differ = there != here
        at = differ.argmax(1)
        each = np.arange(len(rows))
        return np.where(differ.any(1), np.where(there[each, at] < here[each, at], -1, 1), 0)

    rows = np.flatnonzero(lo < hi)
    while len(rows):
        mid = (lo[rows] + hi[rows]) // 2
        less = order(mid, rows) < 0
        lo[rows] = np.where(less, mid + 1, lo[rows])
        hi[rows] = np.where(less, hi[rows], mid)
        rows = rows[lo[rows] < hi[rows]]
    out = np.full(len(queries), -1, np.int64)
    inside = np.flatnonzero(lo < len(places))
    if len(inside):
        hit = order(lo[inside], inside) == 0
        out[inside[hit]] = lo[inside[hit]]
    return out


class _Shard:
    """One suffix array over regions, with the earliest (region order, place) of each group of equal windows.  Regions come
    in order of (doc_id, text, start), so earlier means a smaller place in the joined text, but for overlapping windows of
    one document, which regions keep in order too."""

    def __init__(self, regions: list[np.ndarray], length: int):
        self.text = np.concatenate(regions)
        sizes = np.array([len(r) for r in regions])
        ends = np.cumsum(sizes)
        self.owner = np.repeat(np.arange(len(regions)), sizes)
        valid = np.arange(len(self.text)) <= (ends - length)[self.owner]
        self.starts = ends - sizes
        self.places, self.group = _groups(self.text, valid, length)
        n = int(self.group[-1]) + 1 if len(self.group) else 0
        self.first = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(self.first, self.group, self.places)
        self.repeats = np.zeros(len(self.text), bool)
        self.repeats[self.places] = self.places != self.first[self.group]
        self.heads = np.flatnonzero(np.concatenate([[True], self.group[1:] != self.group[:-1]])) if n else np.zeros(0, np.int64)

    def drop_known(self, earlier: _Shard, length: int, block: int = 8192) -> None:
        """Windows that an earlier shard of the same minimizer has repeat it."""
        known = np.zeros(len(self.first), bool)
        sorted_there = earlier.places[earlier.heads]
        for i in range(0, len(self.heads), block):
            rows = self.places[self.heads[i : i + block]]
            known[i : i + block] = _lookup(sorted_there, earlier.text, self.text[rows[:, None] + np.arange(length)], length) >= 0
        self.repeats[self.places[known[self.group]]] = True


def _spans(flags: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of True as (start, end) of the bytes that their windows cover."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge[::2], edge[1::2] + length - 1


def repeated(regions: list[tuple[int, np.ndarray]], length: int) -> list[tuple[int, int, int]]:
    """regions: (minimizer, bytes) sorted by minimizer, then by order of documents.  (region, start, end) of the bytes of
    each that windows with an earlier equal cover."""
    out = []

    def report(shard: _Shard, numbers: list[int]) -> None:
        for k, number in enumerate(numbers):
            end = shard.starts[k + 1] if k + 1 < len(numbers) else len(shard.text)
            out.extend((number, int(a), int(b)) for a, b in zip(*_spans(shard.repeats[shard.starts[k] : end], length), strict=True))

    i = 0
    pending: list[int] = []
    held = 0
    while i < len(regions):
        j, size = i, 0
        while j < len(regions) and regions[j][0] == regions[i][0]:
            size += len(regions[j][1])
            j += 1
        if size > 2 * SHARD:
            shards, at = [], i
            while at < j:
                last, part = at, 0
                while last < j and (part == 0 or part + len(regions[last][1]) <= SHARD):
                    part += len(regions[last][1])
                    last += 1
                shard = _Shard([r for _, r in regions[at:last]], length)
                for earlier in shards:
                    shard.drop_known(earlier, length)
                shards.append(shard)
                report(shard, list(range(at, last)))
                at = last
        else:
            pending.extend(range(i, j))
            held += size
            if held > SHARD:
                report(_Shard([regions[k][1] for k in pending], length), pending)
                pending, held = [], 0
        i = j
    if pending:
        report(_Shard([regions[k][1] for k in pending], length), pending)
    return out


# -- Spark


def _find_anchors(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, text_ids, values, multi, n = [], [], [], [], 0

        def ready() -> pa.RecordBatch:
            sizes = [len(v) for v in values]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(values).astype(np.int64)), pa.array(np.repeat(np.array(docs, np.int64), sizes)), pa.array(np.repeat(np.array(text_ids, np.int64), sizes)), pa.array(np.concatenate(multi))],
                names=["anchor", "doc_id", "text_id", "multi"],
            )

        for doc, text_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            raw = np.frombuffer(text.as_buffer() or b"", np.uint8) if text.is_valid else np.zeros(0, np.uint8)
            if len(raw) < length:
                continue
            v, m = anchors(raw, length)
            docs.append(doc)
            text_ids.append(text_id)
            values.append(v)
            multi.append(m)
            n += len(v)
            if n > 100_000:
                yield ready()
                docs, text_ids, values, multi, n = [], [], [], [], 0
        if n:
            yield ready()


def _find_regions(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    names = ["anchor", "multi", "digest", "doc_id", "text_id", "start", "n_bytes"]
    for batch in batches:
        rows, held = [], 0
        for doc, text_id, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
            raw = bytes(text.as_buffer())
            b = np.frombuffer(raw, np.uint8)
            h, least = minimizers(b, length)
            starts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
            ends = np.append(starts[1:], len(least))
            known = np.array(wanted.as_py(), np.int64).astype(np.uint64)
            for s, e in zip(*(x[np.isin(least[starts], known)] for x in (starts, ends)), strict=True):
                piece = raw[s : e + length - 1]
                twice = int((h[s : e + length - GRAM] == least[s]).sum()) > 1
                rows.append((int(np.int64(least[s].astype(np.int64))), twice, hashlib.md5(piece).digest(), doc, text_id, int(s), len(piece)))
                held += 1
            if held > 20_000:
                yield _columns(rows, names)
                rows, held = [], 0
        if rows:
            yield _columns(rows, names)


_KINDS = [pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]


def _columns(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=names)


def classes_of_windows(n: int, places: np.ndarray, length: int) -> list[tuple[int, int, int, int, int]]:
    """(first, last, from, to, class) of each run of windows of a region of n bytes that may equal each other only.

    places: where the minimizer occurs in the region.  Equal windows hold it at one offset, counted from its leftmost place in them.
    Offsets 0, 1, 2-3, 4-7 and so on are a class each; bytes from..to-1 of the region lie in all windows of the class around one
    place, so equal windows have those in common as well, whatever their class has on its outer sides."""
    starts = np.arange(n - length + 1)
    at = places[np.searchsorted(places, starts)]
    off = at - starts
    kind = np.zeros(len(starts), np.int64)
    some = off > 0
    kind[some] = np.frexp(off[some].astype(np.float64))[1]
    heads = np.flatnonzero(np.concatenate([[True], (kind[1:] != kind[:-1]) | (at[1:] != at[:-1])]))
    out = []
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(starts)], strict=True):
        k, p = int(kind[a]), int(at[a])
        low, high = (1 << k - 1, min((1 << k) - 1, length - GRAM)) if k else (0, 0)
        out.append((a, b - 1, p - low, p - high + length, k))
    return out


def _split(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_id, text, places) to regions of the classes of windows of each place; the anchor is a hash of the minimizer, the
    class and the bytes that all windows of the class have."""
    names = ["anchor", "multi", "digest", "doc_id", "text_id", "start", "n_bytes"]
    for batch in batches:
        rows = []
        for doc, text_id, text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
            raw = text.as_buffer()
            for p in places:
                piece = bytes(raw[p["start"] : p["start"] + p["n_bytes"]])
                found = np.flatnonzero(gram_hashes(np.frombuffer(piece, np.uint8)) == np.int64(p["anchor"]).astype(np.uint64))
                for first, last, a, b, kind in classes_of_windows(len(piece), found, length):
                    key = hashlib.md5(struct.pack("<qB", p["anchor"], kind) + piece[a:b]).digest()
                    part = piece[first : last + length]
                    rows.append((int.from_bytes(key[:8], "little", signed=True), False, hashlib.md5(part).digest(), doc, text_id, p["start"] + first, len(part)))
            if len(rows) > 20_000:
                yield _columns(rows, names)
                rows = []
        if rows:
            yield _columns(rows, names)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_id, text, places) to (anchor, doc_id, text_id, start, bytes) of each place."""
    names, kinds = ["anchor", "doc_id", "text_id", "start", "bytes"], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    for batch in batches:
        rows, held = [], 0
        for doc, text_id, text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
            raw = text.as_buffer()
            for p in places:
                rows.append((p["anchor"], doc, text_id, p["start"], bytes(raw[p["start"] : p["start"] + p["n_bytes"]])))
                held += p["n_bytes"]
            if held > 4_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _search(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (anchor, doc_id, text_id, start, bytes): spans of repeats.  Whole anchors are gathered up to a shard."""
    held: list[tuple] = []
    size = 0

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        found = repeated([(r[0], np.frombuffer(r[4], np.uint8)) for r in rows], length)
        return pa.RecordBatch.from_arrays([pa.array([rows[i][1] for i, _, _ in found], pa.int64()), pa.array([rows[i][2] for i, _, _ in found], pa.int64()), pa.array([rows[i][3] + a for i, a, _ in found], pa.int64()), pa.array([rows[i][3] + b for i, _, b in found], pa.int64())], names=["doc_id", "text_id", "start", "end"])

    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if size > SHARD and row[0] != held[-1][0]:
                yield flush(held)
                held, size = [], 0
            held.append(row)
            size += len(row[4])
    if held:
        yield flush(held)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_id, text, spans) to what is kept."""
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            n, removed, runs, kept = [], [], [], []
            for text, spans in zip(batch.column(2), batch.column(3), strict=True):
                raw = bytes(text.as_buffer())
                parts, last, gone, count = [], 0, 0, 0
                for s in sorted((x["start"], x["end"]) for x in spans.as_py()):
                    a, b = s
                    if not count or a > last:
                        parts.append(raw[last:a])
                        count += 1
                        gone += b - a
                        last = b
                    elif b > last:
                        gone += b - last
                        last = b
                parts.append(raw[last:])
                n.append(len(raw))
                removed.append(gone)
                runs.append(count)
                kept.append(b"".join(parts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "text_id", "n_removed", "n_spans", "kept"])


def _earliest(regions: DataFrame) -> DataFrame:
    """The first of equal regions of each anchor."""
    place = F.struct("doc_id", "text_id", "start")
    return regions.groupBy("anchor", "digest").agg(F.min(place).alias("at"), F.max("multi").alias("multi"), F.max("n_bytes").alias("n_bytes")).select("anchor", "multi", "n_bytes", "at.*")


def _copies(regions: DataFrame, earliest: DataFrame) -> DataFrame:
    return regions.select("doc_id", "text_id", "start", "n_bytes").join(earliest.select("doc_id", "text_id", "start"), ["doc_id", "text_id", "start"], "left_anti")


def remove(docs: DataFrame, length: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, whole_sha256) of every row; kept (binary) is null where the text stays
    whole, and whole_sha256 is of the input."""
    if length < 2 * GRAM:
        raise ValueError(f"length is at least {2 * GRAM}")
    full = F.coalesce(F.col(text), F.lit(""))
    digest = F.md5(full.cast("binary"))
    docs = docs.select(F.col(doc_id).cast("long").alias("given"), F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("text_id"), digest.alias("digest"), full.cast("binary").alias("text"))
    base = table(docs.select("given", "doc_id", "text_id", "digest", F.length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole_sha256")), "texts")
    least = base.groupBy("digest").agg(F.min("doc_id").alias("first_id"))

    marks = table(docs.select("doc_id", "text_id", "text").mapInArrow(lambda it: _find_anchors(it, length), "anchor long, doc_id long, text_id long, multi boolean"), "anchors")
    twice = marks.groupBy("anchor").agg(F.min("text_id").alias("lo"), F.max("text_id").alias("hi"), F.max("multi").alias("multi")).where("lo <> hi OR multi").select("anchor")
    firsts = base.join(least, "digest").where("doc_id = first_id").select("doc_id", "text_id").distinct()
    wanted = marks.join(twice, "anchor", "left_semi").groupBy("doc_id", "text_id").agg(F.collect_set("anchor").alias("anchors")).join(firsts, ["doc_id", "text_id"], "left_semi")
    wanted = table(wanted, "wanted")
    discard(marks)
    inputs = table(docs.select("doc_id", "text_id", "text").join(wanted, ["doc_id", "text_id"]).dropDuplicates(["doc_id", "text_id"]), "inputs")
    discard(wanted)
    schema = "anchor long, multi boolean, digest binary, doc_id long, text_id long, start long, n_bytes long"
    regions = table(inputs.mapInArrow(lambda it: _find_regions(it, length), schema), "regions")
    earliest = table(_earliest(regions), "earliest")
    release(docs.sparkSession)
    # a minimizer of many different regions: its windows part by their offset and the bytes around it
    hot = earliest.groupBy("anchor").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("size")).where((F.col("size") > HOT) & (F.col("n") > 1)).select("anchor")
    hot = table(hot, "hot")
    if hot.limit(1).count():
        crowd = earliest.join(hot, "anchor", "left_semi").groupBy("doc_id", "text_id").agg(F.collect_list(F.struct("anchor", "start", "n_bytes")).alias("places"))
        finer = table(inputs.select("doc_id", "text_id", "text").join(crowd, ["doc_id", "text_id"]).mapInArrow(lambda it: _split(it, length), schema), "finer")
        first = table(_earliest(finer), "earliest")
        cold = earliest.join(hot, "anchor", "left_anti").unionByName(first)
        release(docs.sparkSession)
    else:
        finer = first = None
        cold = earliest
    # an anchor with one region that holds it once has no repeat left
    open_ = cold.groupBy("anchor").agg(F.count("*").alias("n"), F.max("multi").alias("m")).where("n > 1 OR m").select("anchor")
    places = cold.join(open_, "anchor", "left_semi").groupBy("doc_id", "text_id").agg(F.collect_list(F.struct("anchor", "start", "n_bytes")).alias("places"))
    shards = inputs.select("doc_id", "text_id", "text").join(places, ["doc_id", "text_id"]).mapInArrow(_slices, "anchor long, doc_id long, text_id long, start long, bytes binary")
    found = shards.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "text_id", "start").mapInArrow(lambda it: _search(it, length), "doc_id long, text_id long, start long, end long")
    found = table(found, "found")
    release(docs.sparkSession)
    copies = _copies(regions, earliest)
    if finer is not None:
        copies = copies.unionByName(_copies(finer, first))
    spans = copies.select("doc_id", "text_id", "start", (F.col("start") + F.col("n_bytes")).alias("end")).unionByName(found)
    spans = table(spans.groupBy("doc_id", "text_id").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")
    discard(regions, earliest, hot, found, *([] if finer is None else [finer, first]))
    cut = inputs.select("doc_id", "text_id", "text").join(spans, ["doc_id", "text_id"]).mapInArrow(_cut, "doc_id long, text_id long, n_removed long, n_spans long, kept binary")
    rows = base.join(least, "digest").join(cut, ["doc_id", "text_id"], "left")
    copy = (F.col("doc_id") > F.col("first_id")) & (F.col("n_bytes") >= length)
    return rows.select(
        F.col("given").alias("doc_id"), "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", F.lit(0).cast("long"))).alias("n_spans"), F.when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept"), "whole_sha256",
    )
