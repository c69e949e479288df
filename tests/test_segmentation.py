"""Words of scripts without spaces against a plain-Python version."""

import math
import random
from collections import Counter

import pytest

from voxrisk.operators import segmentation as sg

WORDS = ["机器人", "视频", "水军", "认真", "喜欢", "评论区", "今天"]
FILLER = "的了是我你他她们这那都很也在有和"


def plain_words(texts, most=4, count=5, cohesion=20.0, entropy=0.8):
    f = Counter()
    for t in texts:
        framed = f"\x00{t}\x00"
        for k in range(1, most + 2):
            f.update(framed[i:i + k] for i in range(len(framed) - k + 1))
    inner = {g: n for g, n in f.items() if "\x00" not in g}
    total = sum(n for g, n in inner.items() if len(g) == 1)
    out = {g: n for g, n in inner.items() if len(g) == 1}

    def spread(counts):
        s = sum(counts)
        return math.log(s) - sum(c * math.log(c) for c in counts) / s if s else 0.0

    for g, n in inner.items():
        if 1 < len(g) <= most and n >= count:
            worst = min(n / (inner[g[:k]] * inner[g[k:]] / total) for k in range(1, len(g)))
            before = [m for h, m in f.items() if len(h) == len(g) + 1 and h[1:] == g]
            behind = [m for h, m in f.items() if len(h) == len(g) + 1 and h[:-1] == g]
            if worst >= cohesion and min(spread(before), spread(behind)) >= entropy:
                out[g] = n
    return {g: math.log(n / total) for g, n in out.items()}


def plain_split(run, weights, most=4):
    best = [(0.0, 0)]
    for end in range(1, len(run) + 1):
        best.append(max((best[end - k][0] + weights.get(run[end - k:end], -1000.0), -k) for k in range(1, min(end, most) + 1) if k == 1 or run[end - k:end] in weights))
    out, end = [], len(run)
    while end:
        k = -best[end][1]
        out.insert(0, run[end - k:end])
        end -= k
    return out


def sentences(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(WORDS) if rng.random() < 0.4 else rng.choice(FILLER) for _ in range(rng.randrange(3, 14))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    return sentences(1, 400)


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "ord long, content string")


def test_planted_words_are_found(spark, texts):
    found = sg.find_words(sg.runs(frame(spark, texts)))
    got = {r.word: r.weight for r in found.collect()}
    want = plain_words(texts)
    assert got.keys() == want.keys() and all(got[w] == pytest.approx(want[w]) for w in want)
    assert {w for w in got if len(w) > 1} == set(WORDS)


def test_best_split(spark, texts):
    found = sg.runs(frame(spark, texts))
    words = sg.find_words(found)
    weights = {r.word: r.weight for r in words.collect()}
    got = {r.run: r.words for r in sg.split_runs(found, words).collect()}
    assert len(got) == len(set(texts))
    for run, split in got.items():
        assert "".join(split) == run
        score = lambda s: sum(weights[w] for w in s)
        assert score(split) == pytest.approx(score(plain_split(run, weights)))


def test_split_prefers_the_heavier(spark):
    words = spark.createDataFrame([("ab", -1.0), ("bc", -1.5), ("a", -2.0), ("c", -0.1), ("abc", -5.0)], "word string, weight double")
    found = spark.createDataFrame([("abc", 1), ("bcx", 1), ("xy", 2)], "run string, n long")
    assert {r.run: r.words for r in sg.split_runs(found, words).collect()} == {"abc": ["ab", "c"], "bcx": ["bc", "x"], "xy": ["x", "y"]}


def test_segment_texts(spark):
    words = spark.createDataFrame([("视频", -1.0), ("\U00020000好", -1.0)], "word string, weight double")
    rows = [(0, "看视频 video, 视频!"), (1, None), (2, ""), (3, "only latin"), (4, "\U00020000好"), (4, "视频")]
    df = spark.createDataFrame(rows, "ord long, content string")
    got = {(r.ord, r.token): r.n for r in sg.segment(df, ["ord"], words=words).collect()}
    assert got == {(0, "看"): 1, (0, "视频"): 2, (4, "\U00020000好"): 1, (4, "视频"): 1}
    assert sg.segment(df.limit(0), ["ord"]).count() == 0


def test_best_split_of_a_long_run():
    """Time in proportion to the length; equal weights take the shorter last word, unknown characters stand alone."""
    weights = {"a": -1.0, "b": -1.0, "ab": -2.0, "ba": -1.5}
    assert sg.best_split("ab", weights, 4) == ["a", "b"] and sg.best_split("aba?", weights, 4) == ["a", "ba", "?"] and sg.best_split("", weights, 4) == []
    rng = random.Random(2)
    weights |= {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))): -rng.random() * 4 for _ in range(40)}
    run = "".join(rng.choice("abc\U00020000") for _ in range(5000))
    assert sg.best_split(run, weights, 4) == plain_split(run, weights)


def test_splits_are_made_in_batches(spark):
    words = spark.createDataFrame([("ab", -1.0), ("a", -2.0), ("b", None)], "word string, weight double")
    found = spark.createDataFrame([("ab", 1), ("b", 1)], "run string, n long")
    split = sg.split_runs(found, words)
    assert "ArrowEvalPython" in split._jdf.queryExecution().toString()
    assert {r.run: r.words for r in split.collect()} == {"ab": ["ab"], "b": ["b"]}
