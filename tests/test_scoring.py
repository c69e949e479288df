import pytest
from pyspark.sql import functions as F

from tests.helpers import comment, frame
from voxrisk.functions import lexicon as lx
from voxrisk.functions import scoring as sc
from voxrisk.operators import joins, sentiment


def analysed(spark, texts, profile):
    rows = sentiment.analyze(frame(spark, [comment(i, content=t) for i, t in enumerate(texts)]), profile)
    return {r.ord: r for r in rows.collect()}


def test_lists_have_the_documented_sizes():
    assert (len(lx.POSITIVE_V2), len(lx.NEGATIVE_V2)) == (20, 18)
    assert {k: len(v) for k, v in lx.SENSITIVE_V2.items()} == {lx.RUMOR: 12, lx.ATTACK: 17, lx.INCITEMENT: 10, lx.EXTREME: 10}
    assert len(lx.PROVINCE_EN) == 36


def test_v2_sentiment(spark):
    # "不好" also contains "好"
    out = analysed(spark, ["不好", "很好", "今天", "垃圾 恶心", ""], lx.V2)
    assert 4 not in out
    assert (out[0].sentiment_score, out[0].sentiment, out[0].confidence) == (0.5, "neutral", 0.4)
    assert (out[1].sentiment_score, out[1].sentiment) == (1.0, "positive")
    assert (out[2].sentiment_score, out[2].confidence) == (0.5, 0.0)
    assert (out[3].sentiment_score, out[3].sentiment) == (0.0, "negative")


def test_v2_risk(spark):
    out = analysed(spark, ["垃圾 恶心 谣言！！！", "顶", "今天天气不错 谣言"], lx.V2)
    words = {(w.word, w.category) for w in out[0].sensitive_words}
    assert words == {("垃圾", lx.ATTACK), ("恶心", lx.EXTREME), ("谣言", lx.RUMOR)}
    assert out[0].risk_factors.asDict() == {"sentiment": 40, "sensitive": 40, "text_features": 5}
    assert (out[0].risk_score, out[0].risk_level) == (85, "critical")
    assert (out[1].risk_score, out[1].risk_level) == (10, "low")
    assert out[2].risk_factors.sensitive == 23


def test_v1_risk(spark):
    out = analysed(spark, ["垃圾", "好", "x" * 501, "HELLO WORLD AGAIN", ""], lx.V1)
    assert out[0].risk_score == 30 + 10 + 15 and out[0].risk_level == "medium"
    assert out[1].risk_score == 15
    assert out[2].risk_score == 5
    assert out[3].risk_score == 5
    assert out[4].risk_score == 15  # empty rows are scored in v1


@pytest.mark.parametrize("score,expected", [(0.3499, "negative"), (0.35, "neutral"), (0.65, "neutral"), (0.6501, "positive")])
def test_label_bounds_are_strict(spark, score, expected):
    assert spark.range(1).select(sc.label(F.lit(score))).first()[0] == expected


@pytest.mark.parametrize("score,level", [(39, "low"), (40, "medium"), (59, "medium"), (60, "high"), (79, "high"), (80, "critical")])
def test_v2_levels(spark, score, level):
    assert spark.range(1).select(sc.risk_level_v2(F.lit(score))).first()[0] == level


def test_word_in_two_categories_takes_the_later():
    assert dict(lx.categorised({"a": ["w", "x"], "b": ["w"]})) == {"w": "b", "x": "a"}


def test_large_lexicon_join_equals_inline(spark):
    df = frame(spark, [comment(i, content=t) for i, t in enumerate(["谣言和真相", "带节奏的水军", "无", "谣言谣言"])])
    words = spark.createDataFrame(list(lx.V2.sensitive), "word STRING, category STRING")
    inline = {tuple(r) for r in joins.lexicon_join(df, words).select("ord", "word", "category").collect()}
    large = [tuple(r) for r in joins.indexed_join(df, words, ["ord"]).select("ord", "word", "category").collect()]
    assert set(large) == inline and len(large) == len(inline) == 5


def test_word_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# note\n谣言\n\n 真相 \n谣言\n", encoding="utf-8")
    assert lx.inline_words(lx.read_words(spark, str(tmp_path))) == ["真相", "谣言"]


def test_category_files_and_fallback(spark, tmp_path):
    (tmp_path / "a.txt").write_text("#x\n谣言\n共用\n", encoding="utf-8")
    (tmp_path / "b.txt").write_text("共用\n", encoding="utf-8")
    files = {"甲": str(tmp_path / "a.txt"), "乙": str(tmp_path / "b.txt"), "丙": str(tmp_path / "none.txt")}
    assert dict(lx.read_sensitive(spark, files)) == {"谣言": "甲", "共用": "乙"}
    assert lx.read_sensitive(spark, {"丙": str(tmp_path / "none.txt")}) == lx.categorised(lx.SENSITIVE_V2_FALLBACK)


def test_results_joined_back_last_wins(spark):
    comments = frame(spark, [comment(0), comment(1), comment(2)])
    results = spark.createDataFrame([("0", 0, "negative"), ("0", 5, "positive"), ("2", 1, "neutral")], "comment_id STRING, ord BIGINT, sentiment STRING")
    got = {r.comment_id: r.sentiment for r in joins.sentiment_back(comments, results, ["sentiment"]).collect()}
    assert got == {"0": "positive", "1": None, "2": "neutral"}


def test_histogram_keeps_empty_bins_and_the_upper_bound(spark):
    df = spark.createDataFrame([(0,), (5,), (100,)], "risk_score INT")
    bins = {r.bin: r.n for r in sentiment.histogram(df, "risk_score", 20, 0.0, 100.0).collect()}
    assert len(bins) == 20 and bins[0] == 1 and bins[1] == 1 and bins[19] == 1 and sum(bins.values()) == 3


def test_filter_does_not_search_the_text_again(spark):
    df = frame(spark, [comment(0, content="垃圾")])
    plan = sentiment.analyze(df, lx.V2).filter("risk_score >= 40").select("ord")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("烂") <= 1
