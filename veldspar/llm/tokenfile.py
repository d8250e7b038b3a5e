"""Token ids in compact files: canonical length-limited Huffman coding with global counts.

Steps of :func:`write`: texts are encoded with the tokenizers library (runs of text between blanks are kept in a bounded
table per worker), the end id is appended, and the ids go to a scratch table.  Counts of ids are summed per partition,
then over all; they give code lengths by package-merge and canonical codes, which are as many as the vocabulary has ids.
Rows are then range-partitioned by doc_id and each partition writes one file under its final name by a rename, so a
task that runs again leaves the same file.  Only one row per file reaches the driver.

A file holds blocks that decode on their own: ``HUFB``, the number of ids, of checkpoints and of payload bytes (three
unsigned 32-bit integers), the bit offset of every ``STEP``-th id (unsigned 32-bit each), then the code bits, most significant first.
After the blocks: doc_ids (signed 64-bit), whether each is null (a byte), ids per document (unsigned 64-bit), and a last
record with the number of documents, where their table starts, and ``HUFF``.  ``codebook.bin`` has the length of each code.

:func:`read` decodes all chunks of a block side by side with one table lookup per id.

Null and empty texts hold the end id alone.  Rows with a null doc_id come first; rows with equal doc_id are in order of
a checksum of their ids, then of their ids.  An empty table gives a codebook and no documents.  Other columns are not stored.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from ._common import discard, new_folder, quoted, table

STEP = 256
BLOCK = 1 << 18
MAX_BITS = 18
#: Ids of one file, about: the fewer while files are too few for all cores, the more (200 MB or so) beyond.
FILE_IDS, MAX_FILE_IDS = 4_000_000, 128_000_000
#: Rows read back go to the JVM once this many bytes are ready.
OUT_BYTES = 4_000_000


# -- codes


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n < 2:
        lengths[used] = 1
        return lengths
    limit = max(limit, int(n - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    levels, items = [], leaves
    is_leaf = np.ones(n, bool)
    for _ in range(limit):
        levels.append(is_leaf)
        pairs = items[: len(items) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        at = np.argsort(both, kind="stable")
        items, is_leaf = both[at], at < n
    take, by_rank = 2 * n - 2, np.zeros(n, np.int64)
    for is_leaf in reversed(levels):
        m = int(is_leaf[:take].sum())
        by_rank[:m] += 1
        take = 2 * (min(take, len(is_leaf)) - m)
    lengths[order] = by_rank
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id), as unsigned integers of their length."""
    codes = np.zeros(len(lengths), np.uint64)
    code = last = 0
    for i in np.lexsort((np.arange(len(lengths)), lengths)):
        if size := int(lengths[i]):
            code <<= size - last
            codes[i], last = code, size
            code += 1
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each value of the next ``bits`` bits: the id and the length of its code."""
    bits = max(1, int(lengths.max(initial=1)))
    ids, sizes = np.zeros(1 << bits, np.uint32), np.zeros(1 << bits, np.uint8)
    at = 0
    for i in np.lexsort((np.arange(len(lengths)), lengths)):
        if size := int(lengths[i]):
            span = 1 << (bits - size)
            ids[at : at + span], sizes[at : at + span] = i, size
            at += span
    return ids, sizes, bits


def pack_block(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> bytes:
    size = lengths[ids].astype(np.uint64)
    end = np.cumsum(size)
    start = end - size
    word = (start >> np.uint64(5)).astype(np.int64)
    value = codes[ids] << (np.uint64(64) - (start & np.uint64(31)) - size)
    words = np.zeros(int(end[-1] >> np.uint64(5)) + 2, np.uint64)
    heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))  # places grow, so codes of a word are neighbours
    at = word[heads]
    words[at] = np.add.reduceat(value >> np.uint64(32), heads)
    words[at + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), heads)
    payload = words.astype(">u4").tobytes()[: (int(end[-1]) + 7) // 8]
    marks = start[::STEP].astype("<u4")
    return struct.pack("<4sIII", b"HUFB", len(ids), len(marks), len(payload)) + marks.tobytes() + payload


def unpack_block(n: int, marks: np.ndarray, payload: bytes, lookup: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    ids, sizes, bits = lookup
    raw = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint32)
    four = raw[:-3] << np.uint32(24) | raw[1:-2] << np.uint32(16) | raw[2:-1] << np.uint32(8) | raw[3:]
    at, last = marks.astype(np.int64), len(payload) * 8
    out = np.empty((min(STEP, n), len(marks)), np.uint32)
    mask, room = np.uint32((1 << bits) - 1), 32 - bits
    for k in range(len(out)):
        next_bits = four[at >> 3] >> (room - (at & 7)).astype(np.uint32) & mask
        out[k] = ids[next_bits]
        at = np.minimum(at + sizes[next_bits], last)
    return out.T.reshape(-1)[:n] if n >= STEP else out[:, 0]


# -- encoding texts


#: How a byte-level vocabulary writes each byte that isn't a visible Latin-1 character.
_BYTES = {b: chr(256 + k) for k, b in enumerate([*range(33), *range(127, 161), 173])}
#: Entries of a worker's table of runs, some 150 bytes each.
TABLE_ENTRIES = 2_000_000


class _Table:
    """Texts -> ids as bytes, by the tokenizers library for each new run of text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # for runs of letters, or a blank and letters, which are one match each: written as bytes and cut at white space, instead of by the pattern
        self.words_only = Tokenizer.from_file(path)
        self.words_only.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        known = self.tokenizer.get_vocab()
        self.sizes = np.zeros(max(known.values()) + 1, np.int64)
        for token, i in known.items():
            self.sizes[i] = len(token)  # a byte-level vocabulary writes each byte as one character
        added = self.tokenizer.get_added_tokens_decoder()
        self.ids = {t.content: struct.pack("<I", i) for i, t in added.items()}
        #: Added tokens count wherever they stand in a text, and part it; those that look at what is around them go to the library with their text.
        self.plain = not any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values())
        self.special = re.compile("|".join(re.escape(t) for t in sorted(self.ids, key=len, reverse=True))) if added else None
        self.runs = bpe.RunTable(self.learn, TABLE_ENTRIES)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out = self.runs.encode([None if t and self.special and self.special.search(t) else t for t in texts])
        for i, t in enumerate(texts):
            if t and self.special and self.special.search(t):
                out[i] = self.with_special(t)
        return out

    def with_special(self, text: str) -> bytes:
        if not self.plain:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        between = self.runs.encode(self.special.split(text))
        found = [self.ids[t] for t in self.special.findall(text)]
        return b"".join([x for pair in zip(between, [*found, b""], strict=True) for x in pair])

    def learn(self, young: dict[str, bytes], new: set[str]) -> None:
        """Encode runs.  A comma or full stop after a letter is always a match of its own, so such a run needs its word only."""
        ends = [r for r in new if r[-1:] in (",", ".") and r[-2:-1].isalpha()]
        words = new.difference(ends)
        words.update([r[:-1] for r in ends], ",.")
        words = words.difference(young)
        # blank, then visible characters: no match crosses from one such run to the next, so they go as one text
        letters = [r for r in words if (r[1:] if r[:1] == " " else r).isalpha() and (r.isascii() or max(r) < "\u0500")]
        others = [r for r in words.difference(letters) if r[:1] == " " and r.rfind(" ") == 0 and r.isprintable() and len(r) > 1]
        for i in range(0, len(letters), 4096):
            part = letters[i : i + 4096]
            if self.learn_joined(young, part, self.words_only, " ".join([r.replace(" ", "\u0120") if r.isascii() else r.encode().decode("latin-1").translate(_BYTES) for r in part])):
                words.difference_update(part)
        for i in range(0, len(others), 4096):
            part = others[i : i + 4096]
            if self.learn_joined(young, part, self.tokenizer, "".join(part)):
                words.difference_update(part)
        alone = list(words)
        for run, e in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False), strict=True):
            young[run] = struct.pack(f"<{len(e.ids)}I", *e.ids)
        stops = {c: young[c] for c in ",."}
        for run in ends:
            young[run] = young[run[:-1]] + stops[run[-1]]

    def learn_joined(self, young: dict[str, bytes], runs: list[str], tokenizer, text: str) -> bool:
        """Encode runs, which make up text, in one call and part the ids by the bytes of their tokens; False, with nothing learnt, if they don't fit."""
        ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = np.cumsum([len(r) if r.isascii() else len(r.encode()) for r in runs])
        tokens = np.cumsum(self.sizes[ids])
        at = np.searchsorted(tokens, ends)
        if not len(tokens) or at[-1] >= len(tokens) or not (tokens[at] == ends).all():
            return False
        raw, to = ids.tobytes(), (4 * (at + 1)).tolist()
        young.update(zip(runs, map(raw.__getitem__, map(slice, [0, *to], to)), strict=True))
        return True


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str) -> _Table:
    return _Table(path)


def encode(df: DataFrame, path: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): ids of each text with ``end_id`` after them, as little-endian unsigned 32-bit integers."""
    return _encoded(df, path, end_id, doc_id, text, lambda doc_ids, ids: pa.RecordBatch.from_arrays([doc_ids, pa.array(ids, pa.binary())], names=["doc_id", "ids"]), "doc_id long, ids binary")


def _encoded(df: DataFrame, path: str, end_id: int, doc_id: str, text: str, shape, schema: str) -> DataFrame:
    """Texts encoded, and put into batches by shape(doc_ids, list of ids)."""
    end = struct.pack("<I", end_id)
    work = lambda texts: [ids + end for ids in _tokenizer(path).encode(texts)]
    rows = df.select(F.col(quoted(doc_id)).cast("long").alias("doc_id"), F.col(quoted(text)).alias("text"))

    def run(batches):
        for doc_ids, ids in bpe.in_parts(batches, 1, work):
            yield shape(doc_ids.column(0), ids)

    return rows.mapInArrow(run, schema)


def _narrow(doc_ids: pa.Array, ids: list[bytes]) -> pa.RecordBatch:
    """ids as W16 and 16 bits each where they all fit, else as W32 and 32 bits each: half the bytes to keep and to move.  tie orders
    rows of one doc_id without reading their ids."""
    out = []
    for raw in ids:
        one = np.frombuffer(raw, "<u4")
        out.append(b"W16" + one.astype("<u2").tobytes() if not len(one) or int(one.max()) < 65536 else b"W32" + raw)
    return pa.RecordBatch.from_arrays([doc_ids, pa.array([zlib.crc32(x) for x in out], pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "tie", "ids"])


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if raw[:3] == b"W16" else "<u4", offset=3)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        held = [_wide(x) for x in batch.column(0).to_pylist()]
        for some in ([x for x in held if x.itemsize == 2], [x for x in held if x.itemsize == 4]):
            if some:
                part = np.bincount(np.concatenate(some))
                if len(part) > len(total):
                    total = np.concatenate([total, np.zeros(len(part) - len(total), np.int64)])
                total[: len(part)] += part
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])


# -- files


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def write(df: DataFrame, folder: str, path: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> list[tuple[str, int, int]]:
    """Encode the texts of df and write them below ``folder``; returns (file, documents, ids) in order of doc_id."""
    spark = df.sparkSession
    ids = table(_encoded(df, path, end_id, doc_id, text, _narrow, "doc_id long, tie long, ids binary"), "ids")
    counts = ids.select("ids").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # at most one row per id of the vocabulary
    by_id = np.zeros(max([r.id for r in counts], default=0) + 1, np.int64)
    for r in counts:
        by_id[r.id] = r.n
    lengths = code_lengths(by_id)
    store, at = _open(folder)
    store.create_dir(at, recursive=True)
    with store.open_output_stream(f"{at}/codebook.bin") as f:
        f.write(lengths.tobytes())
    total = int(by_id.sum())
    files = max(1, -(-total // MAX_FILE_IDS), min(-(-total // FILE_IDS), 4 * spark.sparkContext.defaultParallelism))
    shared = spark.sparkContext.broadcast((lengths, canonical(lengths)))  # five and a half bytes an id of the vocabulary at most, whatever the input
    ordered = ids.repartitionByRange(files, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "ids").select("doc_id", "ids")
    made = ordered.mapInArrow(lambda it: _write_part(it, folder, *shared.value), "part int, docs long, n long").collect()
    discard(ids)
    return [(f"{folder}/part-{r.part:06d}.huf", r.docs, r.n) for r in sorted(made)]


def _write_part(batches: Iterator[pa.RecordBatch], folder: str, lengths: np.ndarray, codes: np.ndarray) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    part = context.partitionId()
    store, at = _open(folder)
    name, draft = f"{at}/part-{part:06d}.huf", f"{at}/.draft-{part:06d}-{context.taskAttemptId()}"
    keys, null, sizes, held, n_held, total = [], [], [], [], 0, 0
    with store.open_output_stream(draft) as f:

        def flush(least: int) -> None:
            nonlocal held, n_held
            if n_held >= least and n_held:
                one = np.concatenate(held)
                whole = len(one) // BLOCK * BLOCK if least > 1 else len(one)
                for i in range(0, whole, BLOCK):
                    f.write(pack_block(one[i : min(i + BLOCK, whole)], codes, lengths))
                held, n_held = [one[whole:]], len(one) - whole

        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                one = _wide(x)
                keys.append(k or 0)
                null.append(k is None)
                sizes.append(len(one))
                held.append(one)
                n_held += len(one)
                total += len(one)
                if n_held >= BLOCK:
                    flush(BLOCK)
        flush(1)
        where = f.tell()
        f.write(np.array(keys, "<i8").tobytes() + np.array(null, np.uint8).tobytes() + np.array(sizes, "<u8").tobytes())
        f.write(struct.pack("<QQ4s", len(keys), where, b"HUFF"))
    store.move(draft, name)
    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([total], pa.int64())], names=["part", "docs", "n"])


def read_file(uri: str, lookup) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of each document of one file, a block at a time."""
    store, at = _open(uri)
    with store.open_input_file(at) as f:
        f.seek(f.size() - 20)
        docs, where, magic = struct.unpack("<QQ4s", f.read(20))
        if magic != b"HUFF":
            raise ValueError(f"{uri} is not a token file")
        f.seek(where)
        keys = np.frombuffer(f.read(8 * docs), "<i8")
        null = np.frombuffer(f.read(docs), np.uint8)
        sizes = np.frombuffer(f.read(8 * docs), "<u8").astype(np.int64)
        f.seek(0)
        ready = np.zeros(0, np.uint32)
        for k, no_key, size in zip(keys.tolist(), null.tolist(), sizes.tolist(), strict=True):
            if len(ready) < size:
                got, n = [ready], len(ready)
                while n < size:
                    _, count, marks, length = struct.unpack("<4sIII", f.read(16))
                    bits = np.frombuffer(f.read(4 * marks), "<u4")
                    got.append(unpack_block(count, bits, f.read(length), lookup))
                    n += count
                ready = np.concatenate(got)
            yield None if no_key else k, ready[:size]
            ready = ready[size:]


def read(spark: SparkSession, folder: str, files: list[tuple[str, int, int]]) -> DataFrame:
    """(doc_id, start, ids) of all documents, from the files: start is the number of ids of all documents before it."""
    starts = [0, *np.cumsum([f[2] for f in files]).tolist()]
    listed = spark.createDataFrame([(f[0], s) for f, s in zip(files, starts, strict=False)], "name string, start long")

    def run(batches):
        lookup = None
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if lookup is None:
                    store, at = _open(folder)
                    with store.open_input_stream(f"{at}/codebook.bin") as f:
                        lookup = decode_table(np.frombuffer(f.read(), np.uint8))
                rows, held = [], 0
                for key, ids in read_file(name, lookup):
                    rows.append((key, start, ids.astype("<u4").tobytes()))
                    start += len(ids)
                    held += len(rows[-1][2])
                    if held > OUT_BYTES:
                        yield _rows(rows)
                        rows, held = [], 0
                yield _rows(rows)

    return listed.repartition(max(1, len(files)), "name").mapInArrow(run, "doc_id long, start long, ids binary")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    a, b, c = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.binary())], names=["doc_id", "start", "ids"])


def store_and_read(df: DataFrame, path: str, end_id: int) -> DataFrame:
    """Write the texts of df to a new folder of the shared scratch space and read them back."""
    folder = new_folder(df.sparkSession, "tokens")
    return read(df.sparkSession, folder, write(df, folder, path, end_id))
