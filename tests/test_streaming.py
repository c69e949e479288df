import json

from voxrisk.sources import readers
from voxrisk.streaming import streams


def feed(path, n=200):
    path.mkdir(parents=True)
    for part in range(4):
        lines = [json.dumps({"cid": f"{part}-{i}", "text": f" 第{i}条 <b>x</b>", "create_time": 1700000000 + i * 300 + part}) for i in range(n // 4)]
        (path / f"douyin_{part}.jsonl").write_text("\n".join([*lines, "{broken", ""]), encoding="utf-8")


def test_stream_equals_batch(spark, tmp_path):
    feed(tmp_path / "in")
    stream = streams.stream_clean(spark, str(tmp_path / "in"))
    streams.append_to(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    columns = ("comment_id", "platform", "content", "publish_time")
    live = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(*columns).collect()))
    batch = sorted(map(tuple, readers.scan_dir(spark, str(tmp_path / "in")).select(*columns).collect()))
    assert live == batch and len(live) == 200


def test_hours_close_and_spikes_are_kept(spark, tmp_path):
    feed(tmp_path / "in")
    hourly = streams.stream_hourly_volume(streams.stream_clean(spark, str(tmp_path / "in")), "10 minutes")
    streams.watch_spikes(hourly, str(tmp_path / "hours"), str(tmp_path / "alerts"), str(tmp_path / "ck"), factor=0.9).awaitTermination()
    hours = spark.read.parquet(str(tmp_path / "hours")).collect()
    assert 3 <= len(hours) <= 4 and all(h.n <= 48 for h in hours)
    assert spark.read.parquet(str(tmp_path / "alerts")).count() >= 1
