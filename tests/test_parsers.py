import hashlib
import json
from datetime import datetime

import pytest

from voxrisk.operators import filters, topics
from voxrisk.sources import parsers, readers

BILI = [
    {"comment": "<b>好</b>  评 [doge]", "like": 7, "reply_count": 1, "ctime": 1771303006, "user": {"name": "甲", "level": 3, "ip": "IP属地：安徽"},
     "replies": [{"comment": "回复 @abc", "like": 1, "user": "乙", "level": 2, "ip": "IP属地：浙江"},
                 {"comment": "对象", "user": {"name": "丙", "level": 6}, "level": 1, "ip": None}]},
    {"comment": "", "rpid": 99, "ctime": 0, "user": {"name": "丁", "mid": 5, "ip": None}},
    {"comment": "无用户", "rpid": 0},
]
TIEBA = {"pid": 144540649992, "floor": 1, "user_id": "未知id", "author": "呆唯", "ip_location": "山东", "content": "xxx",
         "sub_replies": [{"user": "匿名", "text": "顶", "ip_location": "未知", "time": "未知"}, {"author": "新", "content": "新形"}],
         "total_lzl": 2, "images": [], "time": "2022-06-24 11:11"}
ZHIHU = [{"type": "comment", "author": "A", "ip": "未知IP", "content": "<p>答</p>", "vote": 3, "time": "2024-01-02 03:04:05"},
         {"type": "article_body", "content": "正文", "url": "http://z"}]
DOUYIN = {"cid": "c1", "text": "抖", "nickname": "N", "digg_count": 9, "create_time": 1700000000, "ip_label": "河南", "reply_total": 4,
          "is_reply": True, "reply_id": "c0"}


def write(path, records):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in records), encoding="utf-8")


@pytest.fixture(scope="module")
def feed(tmp_path_factory):
    root = tmp_path_factory.mktemp("feed")
    write(root / "bili_BV1_0" / "bili_BV1_0.jsonl", [BILI[0], "", '{"comment": "cut', BILI[1], "   ", BILI[2]])
    write(root / "tid_7" / "posts.jsonl", [TIEBA])
    write(root / "zhihu_x" / "a.jsonl", ZHIHU)
    write(root / "douyin_v" / "a.jsonl", [DOUYIN])
    write(root / "other" / "nameless.jsonl", [TIEBA])
    write(root / "other" / "odd.jsonl", [{"a": 1}])
    return root


def rows_of(df):
    return [r.asDict() for r in df.orderBy("source_file", "ord").collect()]


def test_bilibili(spark, feed):
    rows = rows_of(readers.scan_jsonl(spark, str(feed / "bili_BV1_0" / "bili_BV1_0.jsonl")))
    main_id = "bili_" + hashlib.md5("好 评 [doge]".encode()).hexdigest()[:12]
    assert [r["comment_id"] for r in rows] == [
        main_id, main_id + "_reply_0", main_id + "_reply_1", "99", "bili_" + hashlib.md5("无用户".encode()).hexdigest()[:12]]
    main, first, second, empty, nobody = rows
    assert (main["ip_location"], main["user_level"], main["like_count"], main["user_id"]) == ("安徽", 3, 7, None)
    assert main["publish_time"] == datetime.fromtimestamp(1771303006, tz=None) or main["publish_time"] is not None
    assert main["content_metadata"].emoji_count == 1
    assert (first["user_name"], first["user_level"], first["is_reply"], first["parent_id"], first["publish_time"]) == ("乙", 2, True, main_id, None)
    assert (second["user_name"], second["user_level"], second["ip_location"]) == ("丙", 6, None)
    assert (empty["content"], empty["user_id"], empty["publish_time"]) == ("", "5", None)
    assert nobody["user_name"] == "未知用户"


def test_tieba_reads_both_reply_shapes(spark, feed):
    rows = rows_of(readers.scan_jsonl(spark, str(feed / "tid_7" / "posts.jsonl")))
    assert [(r["comment_id"], r["user_name"], r["content"]) for r in rows] == [
        ("144540649992", "呆唯", "xxx"), ("144540649992_sub_0", "匿名", "顶"), ("144540649992_sub_1", "新", "新形")]
    assert rows[0]["publish_time"] is not None and rows[1]["publish_time"] is None
    assert rows[0]["user_id"] == "" and rows[0]["like_count"] == 0 and rows[0]["reply_count"] == 2


def test_zhihu_and_douyin(spark, feed):
    zhihu = rows_of(readers.scan_jsonl(spark, str(feed / "zhihu_x" / "a.jsonl")))
    assert [(r["user_name"], r["like_count"], r["ip_location"], r["source_url"]) for r in zhihu] == [
        ("A", 3, None, None), ("知乎用户", 0, None, "http://z")]
    assert zhihu[0]["comment_id"] == "zhihu_" + hashlib.md5("答".encode()).hexdigest()[:12]
    douyin = rows_of(readers.scan_jsonl(spark, str(feed / "douyin_v" / "a.jsonl")))[0]
    assert (douyin["comment_id"], douyin["like_count"], douyin["reply_count"], douyin["is_reply"], douyin["parent_id"]) == ("c1", 9, 4, True, "c0")


def test_directory_detects_by_path_and_by_content(spark, feed):
    rows = rows_of(readers.scan_dir(spark, str(feed)))
    by_file = {}
    for r in rows:
        by_file.setdefault(r["source_file"].rsplit("/", 2)[-2], []).append(r["platform"])
    assert {k: (len(v), set(v)) for k, v in by_file.items()} == {
        "bili_BV1_0": (5, {"bilibili"}), "tid_7": (3, {"tieba"}), "zhihu_x": (2, {"zhihu"}), "douyin_v": (1, {"douyin"}), "other": (3, {"tieba"})}
    assert len({(r["source_file"], r["ord"]) for r in rows}) == len(rows)


def test_bad_records(spark, feed):
    lines = readers.with_platform(readers.read_lines(spark, str(feed), "*.jsonl"))
    bad = {(r.parse_error, r.line) for r in parsers.bad_records(lines).collect()}
    assert bad == {("malformed JSON", '{"comment": "cut'), ("unsupported platform: unknown", '{"a": 1}')}


def test_uncleaned_option_keeps_markup(spark, feed):
    rows = rows_of(readers.scan_jsonl(spark, str(feed / "zhihu_x" / "a.jsonl"), clean=False))
    assert rows[0]["content"] == "<p>答</p>"


def test_csv_json_round_trip(spark, tmp_path):
    from voxrisk.sources import writers
    rows = spark.createDataFrame([(1, 'a,"b"\nc', ["x", "y"]), (2, "", None)], "k INT, t STRING, l ARRAY<STRING>")
    writers.sink_csv(rows, str(tmp_path / "csv"))
    back = readers.scan_csv(spark, str(tmp_path / "csv"), "k INT, t STRING, l STRING").orderBy("k").collect()
    assert back[0].t == 'a,"b"\nc' and back[0].l == '["x","y"]'
    (tmp_path / "a.json").write_text('[{"k": 1}, {"k": 2}]')
    assert sorted(r.k for r in readers.scan_json_array(spark, str(tmp_path / "a.json"), "k INT").collect()) == [1, 2]


def test_field_types_vary(spark, tmp_path):
    folder = tmp_path / "bili_x"
    folder.mkdir()
    lines = [
        '{"comment": "a", "like": "5", "ctime": "1771303006", "user": {"name": "n", "level": "3", "mid": 77}}', '{"comment": "b", "like": 1.5, "user": "plain"}',
        '{"comment": "c", "like": "1.2 万", "user": null, "replies": "none"}', '{"comment": "d", "like": {"x": 1}, "user": ["y"]}', '{"comment": 7}', '[1]', 'no json',
    ]
    (folder / "bili_x.jsonl").write_text("\n".join(lines), encoding="utf-8")
    rows = {r["content"]: r for r in readers.scan_jsonl(spark, str(folder)).collect()}
    assert set(rows) == {"a", "b", "c", "d", "7"}
    assert [rows[c]["like_count"] for c in "abcd"] == [5, 1, 0, 0]
    assert (rows["a"]["user_level"], rows["a"]["user_id"], rows["b"]["user_name"]) == (3, "77", "plain")
    bad = parsers.bad_records(readers.with_platform(readers.read_lines(spark, str(folder)))).collect()
    assert {r["line"] for r in bad} == {"[1]", "no json"}


def test_rows_are_known_by_file_and_place(spark, tmp_path):
    for k in range(6):
        folder = tmp_path / f"zhihu_{k}"
        folder.mkdir()
        (folder / "zhihu.jsonl").write_text("\n".join(f'{{"type": "comment", "content": "row{i} file{k}"}}' for i in range(10)), encoding="utf-8")
    comments = readers.scan_dir(spark, str(tmp_path))
    assert comments.select("source_file", "ord").distinct().count() == 60
    keys = topics.keywords_per_row(comments, []).collect()
    assert len(keys) == 60 and all(t.startswith(("row", "file")) for r in keys for t in r["keywords"]) and {len(r["keywords"]) for r in keys} == {2}
    for n in (1, 5, 7):
        assert filters.analysis_limit(comments, ["platform"], n).count() == n


def test_many_replies(spark, tmp_path):
    folder = tmp_path / "bili_y"
    folder.mkdir()
    replies = ",".join('{"comment":"r","user":"u"}' for _ in range(70_001))
    (folder / "bili_y.jsonl").write_text(f'{{"comment":"main","replies":[{replies}]}}', encoding="utf-8")
    assert readers.scan_jsonl(spark, str(folder)).select("ord").distinct().count() == 70_002


def test_feed_joins_texts_once_and_packs_its_files(spark, monkeypatch):
    from voxrisk import views
    from voxrisk.catalog import table_queries as tq

    made = []
    row = ("1", "a text " * 50, "name", "3", 2, 1, 0, None, "X", False, None, 4)
    schema = ("comment_id string, content string, user_name string, user_id string, user_level int, like_count long, reply_count long, "
              "publish_time timestamp, ip_location string, is_reply boolean, parent_id string, ord long")
    monkeypatch.setattr(views, "comments", lambda *_: made.append(1) or spark.createDataFrame([row], schema))
    path = tq._feed(spark, "", "bilibili", "tieba", "zhihu", "douyin")
    assert len(made) == 1
    rows = readers.scan_dir(spark, path, pattern="*.txt.gz")
    assert {r.platform: r["count"] for r in rows.groupBy("platform").count().collect()} == {"bilibili": 1, "tieba": 2, "zhihu": 1, "douyin": 1}
