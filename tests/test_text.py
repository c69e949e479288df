import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxrisk.functions import text as tx

SAMPLES = [
    "", "  ", "　\t你好\n　", "<p>a</p> b<br/>c", "看 https://a.b/c?x=1 和 http://d", "@张三 @é张 @a_b @", "[doge][笑哭] [a b] []",
    "😀😀🚀 ok", "!!!", "!！？", "??", "ALL UPPER CASE!", "ALL UPPER ǅ CASE", "短", "a,b;c d。e!好 的", "x\x1cy\x85z", "a" * 600,
]


def py_clean(s):
    return re.sub(r"\s+", " ", re.sub(r"<[^>]+>", "", s)).strip()


def test_clean_content_matches_python(one):
    assert one(tx.clean_content, SAMPLES) == [py_clean(s) for s in SAMPLES]


def test_metadata_counts_before_blanks_are_collapsed(one):
    rows = one(tx.content_metadata, SAMPLES)
    for s, m in zip(SAMPLES, rows):
        bare = re.sub(r"<[^>]+>", "", s)
        assert m.length == len(py_clean(s))
        assert m.url_count == len(re.findall(r"https?://\S+", bare)) and m.has_url == (m.url_count > 0)
        assert m.mention_count == len(re.findall(r"@[\w一-龥]+", bare))
        assert m.emoji_count == len(re.findall(r"\[[\w一-龥]+\]", bare))


def test_null_content_is_empty(one):
    assert one(tx.clean_content, [None]) == [""]
    assert one(tx.content_metadata, [None])[0].length == 0


@pytest.mark.parametrize("pattern,measure", [
    (r"[!！?？]{3,}", tx.repeated_punct),
    (r"\[[\w一-龥]+\]{3,}", lambda c: tx.repeated_emoji(c, "v2")),
    ("[\U0001F600-\U0001F64F]{3,}", lambda c: tx.repeated_emoji(c, "v1")),
])
def test_patterns(one, pattern, measure):
    cases = SAMPLES + ["[x]]]", "[x][y][z]", "😀😀😀"]
    assert one(measure, cases) == [bool(re.search(pattern, s)) for s in cases]


def test_all_upper(one):
    assert one(tx.all_upper, SAMPLES) == [s.isupper() and len(s) > 10 for s in SAMPLES]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ab1 ,.。\t\n　\x1c<>@[]", max_size=30), min_size=20, max_size=40))
def test_tokens_and_strip_match_python(one, values):
    split = [[w for w in re.split(r"[\s\.,!?;:'\"()（），。！？；：、]+", s) if len(w) > 1] for s in values]
    assert one(tx.tokens, values) == split
    assert one(tx.strip, values) == [s.strip() for s in values]
    assert one(tx.clean_content, values) == [py_clean(s) for s in values]


def test_text_key_is_one_to_one(one):
    values = ["a", "b" * 64, "b" * 65, "b" * 66, "sha256:x"]
    keys = one(tx.text_key, values)
    assert len(set(keys)) == len(values) and max(map(len, keys)) <= 71


def test_human_counts(one):
    assert one(tx.parse_human_count, ["1.2w", "3m", "赞 57", "none", "", "7W"]) == [12000, 3000000, 57, 0, 0, 70000]


def test_ids_and_links(one):
    assert one(tx.bv_id, ["https://www.bilibili.com/video/BV1ab?p=1", "x"]) == ["BV1ab", None]
    assert one(tx.post_id, ["https://tieba.baidu.com/p/123?pn=1"]) == ["123"]
    assert one(tx.canonical_video_url, ["看 https://v.douyin.com/i_Ab-1/ 复制", "https://www.douyin.com/user?modal_id=77", "other"]) == [
        "https://v.douyin.com/i_Ab-1", "https://www.douyin.com/video/77", "other"]


def test_time_parts(one):
    assert one(tx.time_prefix, ["9:05 晴", "23:59", "25:00"]) == ["9:05", "23:59", None]
    assert one(lambda c: tx.shift_date(c, 3), ["2024-02-27 10:00", "bad"]) == ["2024-03-01", None]


def test_ip_prefix(one):
    assert one(tx.strip_ip_prefix, ["IP属地：安徽", "浙江", "", None]) == ["安徽", "浙江", None, None]
    assert one(lambda c: tx.strip_ip_prefix(c, "未知"), [None]) == ["未知"]


def test_cjk_tokens(one):
    assert one(tx.cjk_tokens, ["今天天气 good a"]) == [["今天", "天天", "天气", "good"]]


def test_percent_rounds_ties_to_even(spark):
    rows = spark.createDataFrame([(0.1225,), (0.1235,), (1.0,), (0.0,)], "x DOUBLE")
    assert [r[0] for r in rows.select(tx.percent(F.col("x"))).collect()] == ["12.2%", "12.4%", "100.0%", "0.0%"]
