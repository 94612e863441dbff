"""Importance resampling, byte-level BPE and whitening against plain versions."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palindra.llm import bpe, importance, whitening

from . import fixture

SF = "/root/testdata/sf0.001"
_FEATURES = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def buckets_of(value):
    return [zlib.crc32(w.encode()) % 10_000 for w in _FEATURES.findall((value or "").translate(_LOWER))]


def plain_importance(docs, target):
    """(doc_id, n_features, weight, score, rank) in plain Python."""
    s, t = [0] * 10_000, [0] * 10_000
    for texts, total in ((docs, s), (target, t)):
        for _, value in texts:
            for b in buckets_of(value):
                total[b] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + 10_000) / ((x + 1) * (sum(t) + 10_000)))) for x, y in zip(s, t)]
    rows = []
    for doc_id, value in docs:
        own = buckets_of(value)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    return rows, fit[: 10 * len(fit) // 100]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aBÉé09 \n\x00-_zZ中", max_size=40)), max_size=10))
def test_feature_buckets(texts):
    at, first = importance.hashed(pa.array(texts, pa.string()))
    assert [at[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == [buckets_of(t) for t in texts]


def test_importance(spark):
    rows = fixture.corpus()
    target = [(1, fixture.prose(random.Random(9), fixture.vocabulary()[:40], 300)), (2, None), (2, "")]
    got = importance.resampled(fixture.frame(spark, rows), spark.createDataFrame(target, "item_id long, text string"), percent=10).collect()
    want, taken = plain_importance([r[:2] for r in rows], target)
    assert sorted(tuple(r)[:4] for r in got if r.doc_id is not None) == sorted(map(tuple, (r for r in want if r[0] is not None)))
    assert len(got) == len(rows) and sum(r.doc_id is None for r in got) == 2
    assert [(r.rank, r.doc_id) for r in sorted((r for r in got if r.rank), key=lambda r: r.rank)] == [(k, r[0]) for k, r in enumerate(taken, 1)]


def test_importance_numbers_equal_rows_and_many_ranges(spark):
    text = " ".join(["word"] * 25)
    docs = spark.createDataFrame([(7, text)] * 300 + [(k, text + " more") for k in range(200)], "doc_id long, text string").repartition(16)
    got = importance.resampled(docs, docs, percent=60).collect()
    ranks = sorted(r.rank for r in got if r.rank)
    assert ranks == list(range(1, 301))
    by_rank = sorted((r for r in got if r.rank), key=lambda r: r.rank)
    assert [(-r.score, r.doc_id) for r in by_rank] == sorted((-r.score, r.doc_id) for r in got)[:300]


def test_importance_of_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, rank string")
    assert importance.resampled(empty, empty).collect() == []
    one = spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, rank string")
    assert [tuple(r)[:2] for r in importance.resampled(one, empty).collect()] == [(1, 2)]


def test_importance_equals_its_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    mine = importance.op11_importance(spark, SF)
    assert sorted(map(str, map(tuple, mine.select("doc_id", "n_features", "weight", "score", "rank").collect()))) == sorted(map(str, con.sql(f"SELECT doc_id, n_features, weight, score, rank FROM ({importance.OP11_SQL})").fetchall()))


TEXTS = st.text(alphabet=st.one_of(st.sampled_from("aabehtr 's'll\n\t  0123,.!éß中́▁🙂\x00 ՘꟒"), st.characters(exclude_categories=["Cs"])), max_size=60)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXTS, TEXTS.map(lambda t: t + "<|endoftext|>" + t + " <|endoftext|>  x")), max_size=6))
def test_ids_equal_the_library(library, texts):
    c = bpe.coder(bpe.default_vocabulary())
    ids, first = c.ids(pa.array(texts, pa.string()))
    lists = [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])]
    assert lists == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert c.texts(ids.astype(np.int64), first) == [library.decode(x, skip_special_tokens=False) for x in lists] == [t or "" for t in texts]


def test_every_character_is_cut_as_by_the_library(library):
    c = bpe.coder(bpe.default_vocabulary())
    for at in range(0, 0x110000, 0x400):
        letters = [chr(k) for k in range(at, at + 0x400) if not 0xD800 <= k < 0xE000]
        texts = [f"a{x}{x}b1{x}!{x} {x}" for x in letters]
        if at < 0x3000 or at % 0x4000 == 0:
            assert [[p for some in c.pieces(t) for p in some] for t in texts] == [[t[b:e] for _, (b, e) in library.pre_tokenizer.pre_tokenize_str(t)] for t in texts]


def test_parts_of_bytes_and_long_texts(library, monkeypatch):
    c = bpe.Coder(bpe.default_vocabulary())
    r = random.Random(4)
    long = ["a" * 3001, "ab" * 2000, "".join(r.choice("aeiouthsn") for _ in range(5000)), " ".join(fixture.vocabulary()) * 20, "=-" * 999 + " " * 700]
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 1000)
    monkeypatch.setattr(bpe, "_AT_ONCE", 50)
    monkeypatch.setattr(bpe, "_SYMBOLS", 64)
    monkeypatch.setattr(bpe, "_POOL", 500)
    ids, first = c.ids(pa.array(long))
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == [library.encode(t, add_special_tokens=False).ids for t in long]
    broken = [[0xE4 - 0xA1 + 94, 50256], [220, 10**6, 220], []]
    flat = np.array([x for b in broken for x in b], np.int64)
    got = c.texts(flat, np.array([0, 2, 5, 5]))
    assert got[0] == library.decode(broken[0], skip_special_tokens=False) and got[1:] == ["  ", ""]


def test_bpe_on_tables(spark, library):
    rows = fixture.corpus()
    got = bpe.decode(bpe.encode(fixture.frame(spark, rows))).collect()
    assert sorted((r.doc_id or -1, r.ids, r.text) for r in got) == sorted((r[0] or -1, library.encode(r[1] or "", add_special_tokens=False).ids, r[1] or "") for r in rows)
    assert bpe.decode(bpe.encode(fixture.frame(spark, rows).limit(0))).collect() == []
    odd = bpe.decode(spark.createDataFrame([(1, None), (2, [None, 220])], "doc_id long, ids array<int>")).collect()
    assert [(r.doc_id, r.text) for r in sorted(odd)] == [(1, ""), (2, " ")]


def test_bpe_query(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = bpe.op12_bpe(spark, SF).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def integers(vectors):
    return [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]


def exact_covariance(x):
    """V in exact fractions."""
    n, k = len(x), len(x[0])
    means = [Fraction(sum(r[j] for r in x), n) for j in range(k)]
    centred = [[r[j] - means[j] for j in range(k)] for r in x]
    return [[sum(r[i] * r[j] for r in centred) / n for j in range(k)] for i in range(k)]


def test_products_are_compensated():
    r = np.random.default_rng(1)
    x = np.rint(r.normal(size=(301, 5)) * np.array([1e12, 1, 3e5, 7e9, 2.0**52]))
    parts = [whitening.Products(5) for _ in range(3)]
    for k, p in enumerate(parts):
        p.add(x[k::3])
    total = whitening.Products.load(5, parts[0].merge(parts[1]).merge(parts[2]).dump())
    for i, j, high, low in zip(total.i, total.j, total.high, total.low):
        exact = sum(int(a) * int(b) for a, b in zip(x[:, i], x[:, j]))
        assert abs(int(high) + int(low) - exact) <= abs(exact) * 1e-29 + 1e-29 * sum(abs(int(a) * int(b)) for a, b in zip(x[:, i], x[:, j]))


def rows_of(seed=3, n=90, k=6):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n, k)) * np.array([40, 7, 3, 1, 0.5, 0.1]) @ np.linalg.qr(r.normal(size=(k, k)))[0] + 5
    rows = [(i, v.tolist(), "clash", 1.0) for i, v in enumerate(base)]
    inf, nan = float("inf"), float("nan")
    bad = [(900, None, "", 0.0), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0], "", 0.0), (902, [1.0, nan, 1.0, 1.0, 1.0, 1.0], "", 0.0), (903, [inf] * 6, "", 0.0), (904, [], "", 0.0), (905, [1.0, 2.0], "", 0.0), (906, [1e30] * 6, "", 0.0)]
    return [*rows, rows[0], (None, rows[1][1], "null id", 0.0), *bad], {900, 901, 902, 903, 904, 905, 906}


EMBEDDED = "vec_id long, embedding array<float>, whitened string, n double"


def test_whitening(spark):
    rows, bad = rows_of()
    got = whitening.whiten(spark.createDataFrame(rows, EMBEDDED).repartition(5), most=4).collect()
    kept = [r for r in rows if r[0] not in bad]
    x = integers([r[1] for r in kept])
    n, k = len(x), 6
    cov = exact_covariance(x)
    values, vectors = np.linalg.eigh(np.array([[float(c) for c in row] for row in cov]))
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == 4 * n and {r.n for r in got} == {n}
    total = [sum(r[j] for r in x) for j in range(k)]
    assert sorted((r.vec_id or -1, r.deviation) for r in got if r.component == 1) == sorted((r[0] if r[0] is not None and r[0] != 0 else (r[0] or -1), sum((n * c - s) ** 2 for c, s in zip(v, total))) for r, v in zip(kept, x))
    for c in range(1, 5):
        mine = {r.vec_id: r for r in got if r.component == c}
        want = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(v, total)] for v in x]) @ vectors[:, c - 1] / math.sqrt(values[c - 1])
        have = np.array([mine[r[0]].whitened for r in kept])
        assert np.allclose(have, want, atol=1e-9) or np.allclose(have, -want, atol=1e-9)
        assert math.isclose(mine[1].explained, values[c - 1] / float(sum(cov[j][j] for j in range(k))), rel_tol=1e-9)
    w = np.array([[r.whitened for r in got if r.component == c] for c in range(1, 5)])
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9
    assert np.abs(np.cov(w, bias=True) - np.eye(4)).max() < 1e-9


def test_whitening_without_spread(spark):
    same = spark.createDataFrame([(k, [0.5, -0.25], "", 0.0) for k in range(9)], EMBEDDED)
    assert whitening.whiten(same).collect() == [] and whitening.whiten(same.limit(0)).collect() == []
    assert whitening.whiten(same.limit(1)).collect() == []
    line = spark.createDataFrame([(k, [float(k), 2.0 * k], "", 0.0) for k in range(9)], EMBEDDED)
    assert {r.component for r in whitening.whiten(line).collect()} == {1}


def test_deviations_beyond_a_long():
    x = np.array([[2**52, 0], [0, 1], [5, -(2**52)]], np.int64)
    total = [int(c) for c in x.sum(0)]
    d = whitening.deviations(x, 3_000_000_000, [t * 1_000_000_000 for t in total])
    want = [[3_000_000_000 * int(c) - t * 1_000_000_000 for c, t in zip(row, total)] for row in x]
    assert d.tolist() == want
    assert whitening.squared(d) == [s if (s := sum(c * c for c in row)) < 2**63 else None for row in want]
