"""Byte-level BPE encoding and decoding.

Each piece of a text (a match of the split pattern) is merged on its own.  A segment tree over the byte positions holds
the leftmost minimum pair rank; a merge takes the root, joins two live neighbours and updates three leaves, so a piece of
n bytes takes O(n log n) steps however long it is.  Encoded runs between white space are kept in a bounded table per
worker, since natural text repeats them; texts are encoded a few at a time, so that each new run of them is encoded once.
The table changes the speed, never the result.

Null and empty texts encode to no ids and decode to no bytes.  Repeated rows are encoded alike.  Columns other than the
text pass through; an output column that clashes with one of them raises ValueError before any job starts.
"""

from __future__ import annotations

import base64
import functools
import struct
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Unicode White_Space, spelled out because libraries differ on U+001C to U+001F.
_WS = r"\x09-\x0d\x20\x85\xa0  -     　"
#: Entries of a worker's table (about 150 MB at most), in two halves by age.
TABLE_ENTRIES = 1_000_000
#: Runs longer than this many characters are not kept in the table.
TABLE_RUN = 256
#: Texts are encoded, and ids decoded, together up to about this many characters or bytes.
IN_BYTES = 2_000_000


def explicit_spaces(pattern: str) -> str:
    """The pattern with \\s and \\S as the explicit White_Space class, inside and outside brackets."""
    out, depth, i = [], 0, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out.append(_WS if depth else f"[{_WS}]")
        elif two == r"\S" and not depth:
            out.append(f"[^{_WS}]")
        elif two[0] == "\\":
            out.append(two)
        else:
            depth += {"[": 1, "]": -1}.get(two[0], 0)
            out.append(two[0])
            i += 1
            continue
        i += 2
    return "".join(out)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the lowest-ranked adjacent pair, leftmost first, is merged until none is left."""
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    size = 1 << (n - 1).bit_length()
    none = 1 << 62
    tree = [none] * (2 * size)  # leaf i: rank of the pair that starts at byte i, then i; an inner node: its lesser child
    get = ranks.get
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r << 32 | i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    end = list(range(1, n + 1))  # end[i]: where the live token that starts at i ends
    start = list(range(-1, n))  # start[e]: where the live token that ends at e starts

    def put(i: int, value: int) -> None:
        i += size
        tree[i] = value
        while i > 1:
            i >>= 1
            a, b = tree[2 * i], tree[2 * i + 1]
            low = a if a < b else b
            if tree[i] == low:
                return
            tree[i] = low

    while (top := tree[1]) != none:
        i = top & 0xFFFFFFFF
        j = end[i]
        e = end[i] = end[j]
        start[e] = i
        put(j, none)
        r = get(piece[i : end[e]]) if e < n else None
        put(i, none if r is None else r << 32 | i)
        if i:
            p = start[i]
            r = get(piece[p:e])
            put(p, none if r is None else r << 32 | p)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class RunTable:
    """run of text -> ids as little-endian unsigned 32-bit integers.  Two generations of at most half of ``entries`` each, and what
    one batch adds: when the young one is full it becomes the old one, and what is found there moves to the young one again, so runs
    in use stay.  ``learn`` takes the young generation and runs that it hasn't, and puts them there."""

    def __init__(self, learn, entries: int):
        self.learn, self.entries = learn, entries
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        cut = [parts(t) if t else [] for t in texts]
        get = self.young.get
        found = [list(map(get, runs)) for runs in cut]
        gaps = [(i, [k for k, x in enumerate(ids) if x is None]) for i, ids in enumerate(found) if None in ids]
        fresh = {cut[i][k] for i, ks in gaps for k in ks}
        old = self.old
        known = [run for run in fresh if run in old] if old else ()
        self.young.update(zip(known, map(old.__getitem__, known), strict=True))
        if fresh := fresh.difference(known):
            self.learn(self.young, fresh)
        for i, ks in gaps:
            runs, ids = cut[i], found[i]
            for k in ks:
                ids[k] = get(runs[k])
        if any(len(run) > TABLE_RUN for run in fresh):
            for run in [r for r in self.young if len(r) > TABLE_RUN]:
                del self.young[run]
        if len(self.young) > self.entries // 2:
            self.old, self.young = self.young, {}
        return list(map(b"".join, found))


def plain_space(text: str) -> bool:
    """Whether all white space of a text is single blanks and line ends between visible characters (no other separator or
    control character is printable)."""
    line = text.replace("\n", " ")
    return line.isprintable() and "  " not in line and line[:1] != " " and line[-1:] != " "


def parts(text: str) -> list[str]:
    """text cut where no match of the pattern can cross: before each blank that a visible character follows, and in
    texts with plain white space around each line end too.  Some parts may be empty."""
    if plain_space(text):
        return text.replace(" ", "\x01 ").replace("\n", "\x01\n\x01").split("\x01")
    return _CUT.split(text)


_CUT = regex.compile(r"(?= [\p{L}\p{N}\p{P}\p{S}])", regex.V1)


class Codec:
    """Ranks and a split pattern, with what a worker keeps between batches."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.find = regex.compile(explicit_spaces(pattern)).findall
        self.runs = RunTable(self.learn, TABLE_ENTRIES)
        size = max(self.ranks.values()) + 1
        self.tokens: list[bytes | None] = [None] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token

    def learn(self, young: dict[str, bytes], new: set[str]) -> None:
        """Encode runs.  A comma or full stop after a letter is a match of its own, so such a run needs its word only."""
        find, piece = self.find, self.encode_piece
        for run in new:
            word = run[:-1]
            if run[-1:] in (",", ".") and word[-1:].isalpha():
                ids = young.get(word)
                if ids is None:
                    ids = young[word] = b"".join(map(piece, find(word)))
                young[run] = ids + piece(run[-1])
            elif run not in young:
                young[run] = b"".join(map(piece, find(run)))

    def encode_piece(self, piece: str) -> bytes:
        raw = piece.encode("utf-8")
        whole = self.ranks.get(raw)
        if whole is not None:
            return whole.to_bytes(4, "little")
        merged = merge(raw, self.ranks)
        return struct.pack(f"<{len(merged)}I", *merged)

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; none for null."""
        return self.runs.encode(texts)

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        try:
            return b"".join([tokens[i] for i in memoryview(ids).cast("I")])
        except (IndexError, TypeError) as e:
            raise ValueError("an id is not in the vocabulary") from e


@functools.lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    """One codec for each vocabulary and worker process."""
    return Codec(path, pattern)


def in_parts(batches: Iterator[pa.RecordBatch], at: int, work) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of batches with work(values of column ``at``), of about IN_BYTES each, so that memory stays bounded."""
    for batch in batches:
        values, held, done = [], 0, 0
        for i, x in enumerate(batch.column(at), 1):
            values.append(y := x.as_py())
            if y:
                held += len(y)
                if held > IN_BYTES:
                    yield batch.slice(done, i - done), work(values)
                    values, held, done = [], 0, i
        if values:
            yield batch.slice(done, batch.num_rows - done), work(values)


def per_row(batches: Iterator[pa.RecordBatch], column: str, out: str, work) -> Iterator[pa.RecordBatch]:
    """batches with column ``out`` = work(values of ``column``)."""
    for batch in batches:
        for part, values in in_parts([batch], batch.schema.get_field_index(column), work):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values, pa.binary())], names=[*part.schema.names, out])


def _schema(df: DataFrame, out: str) -> T.StructType:
    if out.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"column {out} is already there; name another")
    return T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType())])


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df with ``out``: the ids of ``text`` as little-endian unsigned 32-bit integers (binary; empty for null)."""
    schema = _schema(df, out)
    return df.mapInArrow(lambda it: per_row(it, text, out, lambda texts: codec(path, pattern).encode_all(texts)), schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with ``out``: the bytes of ``ids`` (empty for null).  An id outside the vocabulary fails the task."""
    schema = _schema(df, out)
    return df.mapInArrow(lambda it: per_row(it, ids, out, lambda ids: [codec(path, pattern).decode(x or b"") for x in ids]), schema)
