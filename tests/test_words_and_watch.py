"""Word lists of any length, mergeable distinct counts and the spike watch with state."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.helpers import comment, frame
from voxrisk.functions import lexicon as lx
from voxrisk.operators import distinct, joins, sentiment, wordsearch
from voxrisk.operators.wordsearch import found_words, with_found, word_index
from voxrisk.streaming import spikes

ALPHABET = "abc谣言真相\U0001f600 é"


def texts_and_words(seed, n_texts, n_words):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(0, 60))) for _ in range(n_texts)]
    words = {"".join(rng.choice(ALPHABET) for _ in range(rng.choice([1, 2, 2, 3, 3, 4, 6]))) for _ in range(n_words)}
    return [*texts, None, "", "aaaa"], sorted(words - {""})


def words_table(spark, words):
    return spark.createDataFrame(list(enumerate(words)), "place int, word string")


@pytest.mark.parametrize("n_words", [3, 700])
def test_found_words(spark, n_words):
    texts, words = texts_and_words(n_words, 120, n_words)
    df = spark.createDataFrame(list(enumerate(texts)), "ord long, content string")
    listed = words_table(spark, [*words, "", None, words[0]])
    got = [tuple(r) for r in found_words(df, listed, ["ord"]).collect()]
    want = {(i, w) for i, t in enumerate(texts) if t for w in words if w in t}
    assert len(got) == len(set(got)) and set(got) == want
    lists = {r.ord: r.hits for r in with_found(df, words_table(spark, words), ["ord"], "hits").collect()}
    assert lists == {i: [w for w in words if t and w in t] for i, t in enumerate(texts)}


def test_every_word_once_under_its_rarest_pair(spark):
    df = spark.createDataFrame([(0, "abab"), (1, "abc"), (2, "bcd"), (3, "x")], "ord long, content string")
    index, singles = word_index(df, words_table(spark, ["abc", "bcd", "x", "zz", "ab"]))
    assert singles and {(r.gram, r.word) for r in index.collect()} == {("ab", "abc"), ("cd", "bcd"), ("x", "x"), ("ab", "ab")}


def test_two_hundred_thousand_words(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(200_000)]
    texts = [" ".join(rng.choices(words, k=12)) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "ord long, content string")
    got = {tuple(r) for r in found_words(df, spark.createDataFrame([(w,) for w in words], "word string"), ["ord"]).collect()}
    assert got == {(i, w) for i, t in enumerate(texts) for w in set(t.split())}  # eight letters without a blank stand nowhere else


def test_null_keys_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "ab"), (1, None), (2, "xab")], "ord long, content string")
    assert {tuple(r) for r in found_words(df, words_table(spark, ["ab"]), ["ord"]).collect()} == {(None, "ab"), (2, "ab")}
    assert [r.hits for r in with_found(df, words_table(spark, ["ab"]), ["ord"], "hits").orderBy("ord").collect()] == [["ab"], [], ["ab"]]
    assert found_words(df, words_table(spark, []), ["ord"]).count() == 0
    assert found_words(df.limit(0), words_table(spark, ["ab"]), ["ord"]).count() == 0


def test_words_are_found_where_the_texts_are(spark, monkeypatch):
    texts, words = texts_and_words(5, 60, 300)
    words += ["a b谣言", texts[3] + "x"]
    df = spark.createDataFrame(list(enumerate([*texts, "xa b谣言 " * 9])), "ord long, content string")
    listed = words_table(spark, words).withColumn("category", F.lit("k"))
    hits = found_words(df, listed, ["ord"])
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "Exchange" not in plan and "Join" not in plan  # no row moves
    here = sorted(map(tuple, hits.collect())), sorted(map(str, with_found(df, listed, ["ord"], "hits").collect()))
    monkeypatch.setattr(wordsearch, "MAX_HELD_WORDS", 0)
    assert here == (sorted(map(tuple, found_words(df, listed, ["ord"]).collect())), sorted(map(str, with_found(df, listed, ["ord"], "hits").collect())))
    monkeypatch.setattr(wordsearch._Search, "AT_ONCE", 50)  # texts looked at in many parts
    whose, which = wordsearch._Search(words).hits(texts)
    assert set(zip(whose.tolist(), which.tolist())) == {(i, k) for i, t in enumerate(texts) for k, w in enumerate(words) if t and w in t}


@pytest.mark.parametrize("profile", [lx.V1, lx.V2])
def test_long_lists_score_like_short_ones(spark, monkeypatch, profile):
    rng = random.Random(4)
    parts = [*profile.positive[:6], *profile.negative[:6], *(w for w, _ in profile.sensitive[:12]), "普通", "GOOD", " "]
    rows = [comment(i, content="".join(rng.choices(parts, k=rng.randrange(0, 6)))) for i in range(60)]
    df = frame(spark, rows)
    shown = ("ord", "sentiment", "sentiment_score", "sensitive_words", "sensitive_count", "risk_score", "risk_level")
    short = sorted(map(str, sentiment.analyze(df, profile).select(*shown).collect()))
    monkeypatch.setattr(sentiment, "MAX_INLINE_WORDS", 0)
    assert sorted(map(str, sentiment.analyze(df, profile).select(*shown).collect())) == short


def test_lists_beyond_the_plan_limit(spark):
    many = tuple((f"word{i:05d}", "k" if i % 2 else "l") for i in range(lx.MAX_INLINE_WORDS + 500))
    profile = lx.Profile("v2", tuple(f"good{i}" for i in range(lx.MAX_INLINE_WORDS + 1)), ("bad",), many, ())
    df = frame(spark, [comment(0, content="word00007 and word02400, good2000"), comment(1, content="bad")])
    got = {r.ord: ([w.word for w in r.sensitive_words], r.sensitive_categories, r.sentiment) for r in sentiment.analyze(df, profile).collect()}
    assert got[0][0] == ["word00007", "word02400"] and sorted(got[0][1]) == ["k", "l"] and got[0][2] == "positive"
    assert got[1] == ([], [], "negative")
    table = spark.createDataFrame(list(many), "word string, category string")
    assert {(r.ord, r.word, r.category) for r in joins.lexicon_join(df, table).collect()} == {(0, "word00007", "k"), (0, "word02400", "l")}


# --- distinct counts -------------------------------------------------------------------
def test_daily_sketches(spark):
    rng = random.Random(5)
    start = datetime(2024, 3, 1)
    rows = [(rng.choice("ab"), start + timedelta(hours=rng.randrange(24 * 6)), f"u{rng.randrange(4000)}") for _ in range(20_000)]
    rows += [("a", None, "nobody"), ("b", start, None)]
    df = spark.createDataFrame(rows, "scope string, at timestamp, who string")
    days = distinct.daily_sketches(df, ["scope"], "at", "who")
    first, last = date(2024, 3, 2), date(2024, 3, 4)
    got = {r.scope: r for r in distinct.distinct_over(days, ["scope"], first, last).collect()}
    for scope in "ab":
        inside = [w for s, t, w in rows if s == scope and t and first <= t.date() <= last]
        want = len(set(inside) - {None})
        assert got[scope].days == 3 and got[scope].rows == len(inside)
        assert abs(got[scope].distinct - want) <= distinct.error_bound() * want
    whole = distinct.distinct_over(days, [])
    assert abs(whole.first().distinct - 4001) <= distinct.error_bound() * 4001


def test_sketches_of_parts_merge_to_those_of_all(spark):
    rows = [("a", datetime(2024, 3, 1 + i % 3), f"u{i % 500}") for i in range(3000)]
    df = spark.createDataFrame(rows, "scope string, at timestamp, who string").withColumn("half", F.monotonically_increasing_id() % 2)
    sketch = lambda part: distinct.daily_sketches(part, ["scope"], "at", "who")
    merged = distinct.add_days(sketch(df.where("half = 0")), sketch(df.where("half = 1")), ["scope"])
    told = lambda s: {(r.scope, r.days, r.rows, r.distinct) for r in distinct.distinct_over(s, ["scope"]).collect()}
    assert told(merged) == told(sketch(df))
    twice = {r.distinct for r in distinct.distinct_over(distinct.add_days(sketch(df), sketch(df), ["scope"]), ["scope"]).collect()}
    assert twice == {r.distinct for r in distinct.distinct_over(sketch(df), ["scope"]).collect()}
    assert distinct.distinct_over(sketch(df.limit(0)), ["scope"]).count() == 0


# --- spike watch -----------------------------------------------------------------------
def plain_watch(batches, factor=3.0, least=3):
    seen, out = {}, {}
    for batch in batches:
        for scope, hour, n in sorted(batch, key=lambda r: (r[1], r[2])):
            count, total = seen.get(scope, (0, 0.0))
            mean = total / count if count else None
            out[scope, hour] = (n, mean, count, count >= least and n > factor * mean)
            seen[scope] = (count + 1, total + n)
    return out


def test_watch_keeps_its_state_over_a_restart(spark, tmp_path):
    rng = random.Random(6)
    start = datetime(2024, 3, 1)
    hours = [("a", start + timedelta(hours=i), rng.choice([5, 6, 7, 40])) for i in range(30)] + [("b", start + timedelta(hours=i), 3) for i in range(0, 30, 2)] + [(None, start, 9)]
    feed, out, progress = (str(tmp_path / x) for x in ("feed", "out", "progress"))
    schema = "platform string, hour_start timestamp, n long"
    batches = [[h for h in hours if h[1] < start + timedelta(hours=12)], [h for h in hours if h[1] >= start + timedelta(hours=12)]]
    for batch in batches:  # the second run goes on from the checkpoint of the first
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(feed)
        spikes.watch(spark.readStream.schema(schema).parquet(feed), out, progress).awaitTermination()
    got = {(r.platform, r.hour): (r.n, r["mean"], r.hours, r.is_spike) for r in spark.read.parquet(out).collect()}
    want = plain_watch(batches)
    assert got.keys() == want.keys() and any(v[3] for v in got.values())
    for key, (n, mean, count, spike) in want.items():
        assert got[key][0] == n and got[key][2:] == (count, spike) and (got[key][1] is None) == (mean is None)
        assert mean is None or got[key][1] == pytest.approx(mean)


def test_closing_row_lets_the_last_hours_out(spark, tmp_path):
    start = datetime(2024, 3, 1)
    rows = [("a", start + timedelta(minutes=20 * i)) for i in range(9)]
    schema = "platform string, publish_time timestamp"
    told = {}
    for name, close in (("open", None), ("closed", datetime(2024, 4, 1))):
        feed, hours, out = (str(tmp_path / f"{name}-{x}") for x in ("feed", "hours", "out"))
        spikes.closing_row(spark.createDataFrame(rows, schema), "publish_time", close).write.parquet(feed)
        hourly = spikes.hours_with_close(spark.readStream.schema(schema).parquet(feed), close)
        spikes.keep(hourly, hours, f"{hours}-progress").awaitTermination()
        spikes.watch(spark.readStream.schema("platform string, hour_start timestamp, n long").parquet(hours), out, f"{out}-progress").awaitTermination()
        told[name] = [(r.hour, r.n) for r in spark.read.parquet(out).orderBy("hour").collect()]
    assert told["closed"] == [(start + timedelta(hours=h), 3) for h in range(3)]
    assert len(told["open"]) < 3 and told["open"] == told["closed"][:len(told["open"])]
