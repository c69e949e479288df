"""Phrase mining, whitening and packing by concatenation: brute-force versions and odd input."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxrisk.llm import concat, packing, phrases, whitening

SF_DIR = "/root/testdata/sf0.001"
BIG = (1 << 60) + 1


# --- phrases -----------------------------------------------------------------------
def brute_phrases(rows, min_count, max_words, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, max_words + 1):
                f.update((lang, tuple(words[i:i + k])) for i in range(len(words) - k + 1))
    out = {}
    for (lang, p), a in f.items():
        if len(p) < 2 or a < min_count:
            continue
        longer = [q for (other, q), b in f.items() if other == lang and len(q) > len(p) and 100 * b >= 100 * a and b >= min_count
                  and any(q[i:i + len(p)] == p for i in range(len(q)))]
        if longer:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)}


def random_texts(seed, n):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "New", "YORK", "é", "É", "state", "x\x0by", " ", "a\x1cb", "日本", "ß"] + [f"w{i}" for i in range(6)]
    ends = [" ", "  ", "\t", ". ", ",", "\n", "\r\n", "! ", " ;", ":"]
    rows = []
    for _ in range(n):
        words = rng.choices(vocabulary, k=rng.randrange(0, 40))
        if rng.random() < 0.5:
            words[3:3] = ["new", "york", "state", "of", "the"]
        rows.append((rng.choice(["en", "de", None, "und", ""]), "".join(w + rng.choices(ends, [9, 1, 1, 2, 1, 1, 1, 1, 1, 1])[0] for w in words)))
    return rows + [("en", None), ("en", ""), (None, " .\t"), ("fr", "one"), ("en", "new york " * 300)]


def mined(spark, rows, **given):
    df = spark.createDataFrame([(i, lang, text, 1, 2) for i, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string, n long, phrase long")
    out = phrases.mine_phrases(df.repartition(3), **given)
    return {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in out.collect()}


@pytest.mark.parametrize("shard", [1 << 20, 300])
def test_phrases(spark, monkeypatch, shard):
    monkeypatch.setattr(phrases, "SHARD_BYTES", shard)  # small shards split texts and sums
    rows = random_texts(shard, 120)
    got = mined(spark, rows, min_count=5, max_words=5, top=40)
    assert got == brute_phrases(rows, 5, 5, 40)


def test_phrases_ties_repeats_and_empty(spark):
    rows = [("en", "b a. a b. c d")] * 4
    assert mined(spark, rows, min_count=4, max_words=3, top=2) == brute_phrases(rows, 4, 3, 2)
    assert mined(spark, [], min_count=1) == set()
    assert mined(spark, [("en", None), (None, "")], min_count=1) == set()


def test_phrases_filters_need_not_be_sharp(spark, monkeypatch):
    """A filter that lets everything pass changes nothing but the work."""
    rows = random_texts(7, 60)
    monkeypatch.setattr(phrases, "_maybe", lambda hashes, lang, known: np.ones(len(hashes), bool))
    assert mined(spark, rows, min_count=5, max_words=4, top=30) == brute_phrases(rows, 5, 4, 30)


def test_index_extends_to_both_sides():
    rng = np.random.default_rng(4)
    text = np.append(rng.integers(0, 5, 400), 0).astype(np.int32)
    everything = np.full(phrases.MAP_WORDS, np.iinfo(np.uint64).max, np.uint64)
    words = [f"w{i}" for i in range(1, 5)]
    for length in (2, 3, 4, 5):
        found, size = phrases.grow(words, *phrases.index_shard(text, 5), "en", [everything] * 5, length)
        want = Counter(w for w in (tuple(text[i:i + length]) for i in range(len(text) - length + 1)) if 0 not in w)
        assert dict(zip(map(tuple, found.tolist()), size.tolist())) == {tuple(map(int, k)): v for k, v in want.items()}


def test_stable_order_of_large_numbers():
    keys = np.random.default_rng(2).integers(0, 200_000, 5000).astype(np.int32)
    assert (phrases._stable_order(keys) == np.argsort(keys, kind="stable")).all()


# --- whitening -----------------------------------------------------------------------
def brute_whitening(rows, k):
    usable = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in usable], object)
    n, s = len(x), x.sum(axis=0)
    deviation = ((n * x - s) ** 2).sum(axis=1)
    centred = ((n * x - s) / n).astype(float)
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return usable, deviation, centred, values, vectors, values / np.trace(cov)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1.0, 2) for i, v in rows], "vec_id long, embedding array<float>, component double, n long")


@pytest.mark.parametrize("n,d,k", [(300, 12, 32), (300, 40, 32), (50, 1, 32), (200, 20, 5)])
def test_whiten(spark, n, d, k):
    rng = np.random.default_rng(n + d)
    data = (rng.standard_normal((n, d)) * np.linspace(0.2, 3, d) + rng.standard_normal(d)).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(data)]
    rows += [(5, rows[5][1]), (None, rows[7][1]), (BIG, rows[8][1]), (900, None), (901, []), (902, [None] * d), (903, [math.nan] * d), (904, [math.inf] * d)]
    usable, deviation, centred, values, axes, explained = brute_whitening(rows, k)
    out = whitening.whiten(vectors(spark, rows).repartition(3), components=k).collect()
    assert len(out) == len(usable) * min(k, d) and {r.n for r in out} == {len(usable)}
    assert max(r.identity_error for r in out) < 1e-9
    by = {}
    for r in out:
        by.setdefault((r.vec_id, r.component), []).append(r)
    for row, (i, _) in enumerate(usable):
        if sum(j == i for j, _ in usable) > 1:
            continue
        for c in range(min(k, d)):
            (r,) = by[i, c + 1]
            assert r.deviation == deviation[row]
            assert r.explained == pytest.approx(explained[c], rel=1e-10)
            assert abs(r.whitened) == pytest.approx(abs(centred[row] @ axes[:, c]) / math.sqrt(values[c]), abs=1e-6)


def test_whiten_without_variance(spark):
    same = [(i, [1.0, 2.0]) for i in range(5)]
    assert whitening.whiten(vectors(spark, same)).count() == 0  # nothing to scale
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None), (2, [])])).count() == 0
    flat = [(i, [float(i), 3.0, 2.0 * i]) for i in range(10)]  # one constant and one dependent dimension
    assert {r.component for r in whitening.whiten(vectors(spark, flat)).collect()} == {1}
    with pytest.raises(ValueError):
        whitening.whiten(vectors(spark, [(1, [1.0]), (2, [1.0, 2.0])]))


def test_deviation_beyond_64_bits(spark):
    rows = [(i, [float(i * 1e9), float(-i)]) for i in range(300)]
    _, deviation, *_ = brute_whitening([(i, [float(np.float32(c)) for c in v]) for i, v in rows], 2)
    got = {r.vec_id: int(r.deviation) for r in whitening.whiten(vectors(spark, rows)).collect()}
    assert got == dict(enumerate(deviation)) and max(got.values()) > 1 << 63


def spectrum(values, seed=3):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    return q @ np.diag(values) @ q.T


@pytest.mark.parametrize("values", [
    np.linspace(1, 2, 40), [5.0] * 10 + [3.0] * 14 + [1.0] * 16, 10.0 ** -np.arange(20), np.r_[1 + 1e-12 * np.arange(12), np.full(20, 0.5)], [0.0] * 5, [2.0],
])
def test_principal_pairs(values):
    matrix = spectrum(np.array(values, float))
    matrix = (matrix + matrix.T) / 2
    got, axes = whitening.principal_pairs(matrix, 16)
    want = np.sort(values)[::-1][:16]
    assert (want > 1e-12).sum() <= len(got) <= (want > 1e-15).sum()  # zero is what rounding could have made
    assert np.allclose(got, want[:len(got)], rtol=1e-9, atol=1e-14)
    assert np.allclose(axes.T @ axes, np.eye(len(got)), atol=1e-13) and np.allclose(matrix @ axes, axes * got, atol=1e-12)


def test_count_above():
    a = np.random.default_rng(1).standard_normal((25, 25))
    a = a + a.T
    own = np.linalg.eigvalsh(a)
    for shift in np.linspace(-11, 11, 90):
        assert whitening.count_above(a, shift) == (own > shift).sum()
    assert whitening.count_above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1
    assert whitening.count_above(np.zeros((3, 3)), 0.0) == 0


# --- packing by concatenation ----------------------------------------------------------
def check_packed(rows, packed, capacity, end_id=1):
    encoder = packing._patient_encoder("byte_bpe_50k")
    ids = {i: [*encoder.encode(t or "", add_special_tokens=False).ids, end_id] for i, t in rows}
    windows, pieces = {}, {}
    for r in packed:
        part = np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4")
        assert len(part) == r.length > 0 and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
    fills = []
    for number, parts in sorted(windows.items()):
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        fills.append(at)
    full = sum(map(len, ids.values())) // capacity
    assert sorted(windows) == list(range(len(windows))) and fills[:full] == [capacity] * full and all(x & (x - 1) == 0 for x in fills)
    for i, parts in pieces.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == len(ids[i])
    assert set(pieces) == set(ids)


@pytest.mark.parametrize("capacity,parts", [(2048, 1), (64, 5), (8, 3), (1, 2)])
def test_concatenate(spark, monkeypatch, capacity, parts):
    monkeypatch.setattr(concat, "PARTS_PER_BLOCK", 2)
    rng = random.Random(capacity)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "été", "日本", "x" * 20, "  "]) for _ in range(rng.randrange(60)))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "word " * 3000), (BIG, "end"), (-5, "\U0001f600")]
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, n long, part long, ids long")
    check_packed(rows, concat.pack_concatenated(df.repartition(parts), capacity=capacity).collect(), capacity)


def test_concatenate_odd_rows(spark):
    schema = "doc_id long, text string"
    assert concat.pack_concatenated(spark.createDataFrame([], schema)).count() == 0
    same = concat.pack_concatenated(spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "a b"), (1, "a b")], schema)).collect()
    assert sum(r.length for r in same) == 4 * 3 and len({(r.sequence_id, r.offset) for r in same}) == len(same)


def test_white_space_without_end():
    from tokenizers import Tokenizer
    import public_tokenizers

    text = "a" + " " * 2_000_000 + "b"
    want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    assert packing.token_ids(text, "byte_bpe_50k").tolist() == want


def test_given_tables(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    check_packed([tuple(r) for r in docs.collect()], concat.pack_concatenated(docs).collect(), 2048)
    given = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    out = whitening.whiten(given)
    assert out.count() == given.count() * 32 and out.agg(F.max("identity_error")).first()[0] < 1e-9


# --- conversations without an id ---------------------------------------------------------
def test_conversations_without_an_id(spark, tmp_path):
    import duckdb

    from voxrisk.llm import queries

    rows = [(None, 0, "user", "a <b>"), (None, 1, "assistant", "c\\"), (3, 1, "assistant", None), (3, 0, "user", "q"), (4, None, "assistant", "x"), (4, 2, "user", "y")]
    path = f"{tmp_path}/conversations.parquet"
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(path)
    out = queries.QUERIES["op8_chat_formatting"](spark, str(tmp_path))
    with duckdb.connect() as duck:
        duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
        cursor = duck.execute(queries.ORACLES["op8_chat_formatting"])
        want = {tuple(zip((d[0] for d in cursor.description), row)) for row in cursor.fetchall()}
    got = {tuple((c, r[c]) for c in (n for n, _ in next(iter(want)))) for r in out.collect()}
    assert got == want and {dict(r)["conv_id"] for r in got} == {None, 3, 4, -7}
