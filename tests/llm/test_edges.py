"""Hot groups, salted joins, clashing names and repeated rows, against brute force; and the registered queries themselves."""

import hashlib
import json
import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
import tiktoken

from test_ops import DOCS, corpus, groups, removed
from veldspar.llm import bpe, chat, minhash, mixing, pii, quality, queries, substrings, vectors

SF = "/root/testdata/sf0.001"


def words(rng, n, letters="abcdefghij"):
    return [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(1)) for _ in range(n)]


# -- hot groups


def linked(sets, percent=80):
    return [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]


def test_minhash_crowd(spark, monkeypatch):
    """A passage that many unlike texts share fills buckets; near copies among them, and between groups of copies, are found all the same."""
    monkeypatch.setattr(minhash, "HOT", 5)
    rng = random.Random(6)
    passage = " ".join(words(rng, 60))
    rows = [(i, passage + " " + " ".join(words(rng, 30)) + f" own{i}", "en", "s", None) for i in range(120)]
    for i in range(40):
        base = rows[rng.randrange(100)][1].split()
        for _ in range(rng.randint(1, 5)):
            base[rng.randrange(len(base))] = "new"
        rows.append((200 + i, " ".join(base), "en", "s", None))
    sets = {i: set(minhash.shingles(t.encode(), 2).tolist()) for i, t, *_ in rows}
    want = groups(linked(sets), sets)
    used = []
    real = minhash._prefixes
    monkeypatch.setattr(minhash, "_prefixes", lambda *a: used.append(1) or real(*a))
    got = {r.doc_id: r.component_id for r in minhash.classes(spark.createDataFrame(rows, DOCS), width=2).collect()}
    assert got == want and used and len(set(want.values())) < len(rows)


def test_prefixes_lose_no_pair(spark):
    rng = random.Random(7)
    base = [set(rng.sample(range(60), rng.randint(1, 25))) for _ in range(60)]
    sets = {i: s for i, s in enumerate(base + [set(list(s)[: max(1, len(s) - 1)]) | {100 + k % 3} for k, s in enumerate(base)])}
    df = spark.createDataFrame([(i, bytearray(np.array(sorted(s), np.uint64).tobytes())) for i, s in sets.items()], "id long, shingles binary")
    by = {}
    for r in minhash._prefixes(df, 80).collect():
        by.setdefault(r.bucket, set()).add(r.rep)
    pairs = {(a, b) for group in by.values() for a in group for b in group if a < b}
    assert set(linked(sets)) <= pairs


def test_substrings_crowd(spark, monkeypatch):
    """The edges of a passage that all documents share: one minimizer with as many regions as documents, parted and merged."""
    monkeypatch.setattr(substrings, "HOT", 1)
    rng = random.Random(8)
    passage = " ".join(words(rng, 60))
    rows = [(i, " ".join(words(rng, 25)) + passage + " ".join(words(rng, 25)), None, None, None) for i in range(40)]
    rows += [(100 + i, "ab" * 200 + f"{i}" + passage[: 90 + i], None, None, None) for i in range(25)] + [(200, passage[20:150] * 3, None, None, None)]
    rows += [(300 + i, t, None, None, None) for i, (_, t, *_) in enumerate(corpus(3, 30))]
    for length in (100,):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.whole_sha256 if r.kept is None else hashlib.sha256(r.kept).hexdigest()) for r in substrings.remove(spark.createDataFrame(rows, DOCS), length).collect()}
        assert got == removed(rows, length)


def test_vectors_of_small_labels(spark):
    """One large label and many of two vectors: pairs that have no other neighbour, in both."""
    rng = np.random.default_rng(12)
    x = rng.standard_normal((1400, 32))
    pairs = x[:80] + 0.02 * rng.standard_normal((80, 32))
    rows = [(i, 0, v.tolist()) for i, v in enumerate(np.concatenate([x, pairs]))]
    for k in range(60):
        v = rng.standard_normal(32)
        rows += [(2000 + 2 * k, k + 1, v.tolist()), (2001 + 2 * k, k + 1, (v + 0.02 * rng.standard_normal(32)).tolist())]
    rows += [(None, 0, x[0].tolist()), (5, 0, x[5].tolist())]
    report = {}
    got = vectors.links(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), report=report).collect()
    assert len(got) == len(rows) and [(r.n_links, r.component_id) for r in got if r.vec_id is None] == [(0, None)]
    of = {r.vec_id: r for r in got}
    for i in range(80):
        assert (of[i].n_links, of[1400 + i].component_id) == (1, i)
    for k in range(60):
        assert of[2001 + 2 * k].component_id == 2000 + 2 * k
    assert report["recall"] >= 0.9


# -- salted joins and names that clash


def test_clashing_names(spark):
    rows = [(i, t, s or "s", lang, 777, 1, 2, "x") for i, t, lang, s, _ in corpus()]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, _n int, _rate int, `a.b` int, _v_found string").withColumnRenamed("_v_found", "_found")
    for n in ("_ok", "_source", "row", "n_words", "kept", "_v_x", "copy_"):
        df = df.selectExpr("*", f"42 AS {n}")
    mixed = mixing.mix(df, {"hot": 1.0, "b": 2.0, "s": 1.0})
    assert mixed.columns == [*df.columns, "copy"] and {(r._n, r._rate, r._ok, r._source) for r in mixed.collect()} == {(777, 1, 42, 42)}
    labels = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    kept = quality.keep(df, labels)
    assert kept.columns == df.columns and {(r._n, r.n_words, r.row, r["a.b"]) for r in kept.collect()} == {(777, 42, 42, 2)}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in quality.assess(df, labels).where("kept").collect())
    hidden = pii.replace(df)
    assert hidden.columns == df.columns and hidden.where("_found = 'x' AND `a.b` = 2").count() == len(rows)
    one = minhash.keep_one(df, width=2)
    assert one.columns == df.columns and 0 < one.count() < len(rows)


def test_salted_joins(spark, monkeypatch):
    df = spark.createDataFrame(corpus(2, 200), DOCS)
    labels = spark.createDataFrame([(i, 1) for i in range(100)], "doc_id long, quality int")
    few = sorted(mixing.mix(df).drop("text").collect(), key=repr)
    monkeypatch.setattr(mixing, "MAX_SOURCES", 1)
    assert sorted(mixing.mix(df).drop("text").collect(), key=repr) == few
    measured = quality.measures(df)
    cut = spark.createDataFrame([("en", "symbols", 0.0), ("de", "word_length", 0.1), (None, "repeats", -1.0)], "stratum string, rule string, cutoff double")
    plain = sorted(quality.verdict(measured, cut).select("doc_id", "kept", "failed_rules").collect())
    assert sorted(quality.verdict(measured, cut, max_strata=1).select("doc_id", "kept", "failed_rules").collect()) == plain
    assert any("repeats" in r.failed_rules for r in plain)
    kept = sorted(r.doc_id for r in quality.keep(df, labels).collect())
    monkeypatch.setattr(quality, "MAX_LABELS", 1)
    assert sorted(r.doc_id for r in quality.keep(df, labels).collect()) == kept


def test_repeated_rows(spark):
    call = {"id": "a", "type": "function", "function": {"name": "search", "arguments": {"query": "x"}}}
    rows = [(1, 1, "assistant", json.dumps({"tool_calls": [call]}))] * 2 + [(1, 2, "tool", json.dumps({"tool_call_id": "a", "content": "r"}))] * 3
    out = chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(out) == 5 and all((r.n_calls, r.n_answered, r.status) == (1, 1, "calls") and len(json.loads(r.json)["tool_calls"]) == 1 for r in out if r.turn == 1)
    assert all(r.status == "linked" for r in out if r.turn == 2)
    chain = [(7, i, "assistant", json.dumps({"tool_calls": [{**call, "id": f"c{i}", "depends_on": [f"c{i + 1}"] if i < 9 else []}]})) for i in range(10)]
    levels = {r.turn: r.level for r in chat.link(spark.createDataFrame(chain, "conv_id long, turn long, role string, text string")).collect()}
    assert levels == {i: 9 - i for i in range(10)}
    texts = [(1, "a b c d e f g h"), (1, "z y x w v u t s"), (2, "a b c d e f g h"), (3, "z y x w v u t s"), (None, "a b c d e f g h")]
    got = minhash.classes(spark.createDataFrame(texts, "doc_id long, text string"), width=2).collect()
    assert len(got) == 5 and sum(r.component_id == 1 for r in got) == 3  # both rows of 1, and one of the others


def test_binomial_bound(spark):
    from pyspark.sql import functions as F

    rows = [(n, k) for n in (1, 60, 400, 2000) for k in (0, 1, 5, 20) if k <= n]
    df = spark.createDataFrame(rows, "n long, k long")
    for share in (0.004, 0.02, 0.3):
        for level in (0.05, 0.0004):
            for r in df.withColumn("ok", quality._at_most(F.col("n"), F.col("k"), share, F.lit(level))).collect():
                p = sum(math.exp(math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(share) + (r.n - i) * math.log1p(-share)) for i in range(r.k + 1))
                assert r.ok == (p <= level), (r, share, level, p)


def test_pii_stays_apart(spark):
    """Many people of one surname, many short secrets and numbers: distinct ones stay distinct, equal ones equal, none stays itself."""
    rng = random.Random(3)
    names = [f"Mr {a.capitalize()} Smith" for a in {"".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randint(3, 8))) for _ in range(400)}]
    secrets = ["key=" + s for s in {"".join(rng.choice("abcdefgh12345678") for _ in range(8)) for _ in range(400)}]
    numbers = [f"{rng.randint(100, 999)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}" for _ in range(400)] + [f"10.{i}.{j}.7" for i in range(20) for j in range(10)]
    rows = [*names, *secrets, *sorted(set(numbers)), "key: ----------"]
    out = {r.doc_id: r.text for r in pii.replace(spark.createDataFrame([(i, f"a {t} b {t}!") for i, t in enumerate(rows)], "doc_id long, text string")).collect()}
    new = [re.fullmatch(r"a (.*) b (.*)!", out[i]).groups() for i in range(len(rows))]
    assert all(a == b for a, b in new) and len({a for a, _ in new}) == len(rows)
    assert all(a != t for (a, _), t in zip(new[:-1], rows)) and new[-1][0] == "key: ----------"
    assert len({a.split(" ")[-1] for a, _ in new[: len(names)]}) == 1
    every = [x for v in pii._FIRST.values() for x in v]
    assert not any(a != b and b.startswith(a) for s in ("latin", "cyrillic", "greek") for a in sum((pii._FIRST[s, g] for g in "fm"), []) for b in sum((pii._FIRST[s, g] for g in "fm"), [])) and every


# -- the registered queries


@pytest.fixture(scope="module")
def documents():
    return sorted(pq.read_table(f"{SF}/documents.parquet").to_pylist(), key=lambda r: r["doc_id"])


def run(spark, name):
    return sorted((r.asDict() for r in queries.QUERIES[name](spark, SF).collect()), key=lambda r: next(iter(r.values())))


def test_op2(spark, documents):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for r, d in zip(run(spark, "op2_bpe"), documents, strict=True):
        ids = enc.encode_ordinary(d["text"] or "")
        assert r == {"doc_id": d["doc_id"], "n_tokens": len(ids), "ids_sha256": hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), "decoded_sha256": hashlib.sha256((d["text"] or "").encode()).hexdigest()}


def test_op9(spark, documents):
    from tokenizers import Tokenizer

    t, start = Tokenizer.from_file(P.path("byte_bpe_50k.json")), 0
    for r, d in zip(run(spark, "op9_token_files"), documents, strict=True):
        ids = np.array([*t.encode(d["text"] or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        assert r == {"doc_id": d["doc_id"], "start": start, "n_tokens": len(ids) // 4, "ids_crc32": zlib.crc32(ids)}
        start += len(ids) // 4


def test_op6_op8(spark, documents):
    new = {r["doc_id"]: r for r in run(spark, "op6_pii")}
    for d in documents:
        found = re.findall(r"[\w.+-]+@[\w-]+\.[\w.]+\w", d["text"] or "")
        assert not any(x in new[d["doc_id"]]["text"] for x in found)
        if not new[d["doc_id"]]["n_entities"]:
            assert new[d["doc_id"]]["text"] == d["text"]
    talk = pq.read_table(f"{SF}/conversations.parquet").to_pylist()
    got = run(spark, "op8_chat")
    want = sorted((c["conv_id"], c["turn"], json.dumps({"content": c["text"], "role": c["role"]}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))) for c in talk)
    assert sorted((r["conv_id"], r["turn"], r["json"]) for r in got) == want and {r["status"] for r in got} == {"plain"}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = c.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(want, key=repr)
