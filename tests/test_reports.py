import json

import pytest
from pyspark.sql import functions as F

from tests.helpers import comment, frame, random_rows
from voxrisk.functions import lexicon as lx
from voxrisk.operators import anomalies as an
from voxrisk.operators import risk
from voxrisk.plans import render, reports
from voxrisk.sources import writers

SCOPE = ["source_file"]


@pytest.fixture(scope="module")
def report(spark):
    return reports.report_v2(frame(spark, random_rows(300, 5)), SCOPE, lx.V2).persist()


def test_scores_are_bounded_and_ratios_sum_to_one(report):
    for r in report.collect():
        assert 0 <= r.overall_score <= 100
        assert r.positive_ratio + r.negative_ratio + r.neutral_ratio == pytest.approx(1)
        assert len(r.key_findings) <= 15 and r.recommendations


def test_union_of_files_equals_separate_runs(spark, report):
    rows = frame(spark, random_rows(300, 5))
    columns = ("source_file", "overall_score", "sentiment_part", "ip_part", "user_part", "key_findings")
    together = {r.source_file: tuple(r) for r in report.select(*columns).collect()}
    for source in ("s0", "s1"):
        alone = reports.report_v2(rows.filter(F.col("source_file") == source), [], lx.V2).select(*columns[1:]).collect()
        assert tuple(alone[0]) == together[source][1:]


def test_analysis_limit_only_touches_sentiment(spark, report):
    limited = reports.report_v2(frame(spark, random_rows(300, 5)), SCOPE, lx.V2, analysis_limit=10)
    full = {r.source_file: r for r in report.collect()}
    for r in limited.collect():
        assert r.analysed_comments == 10 and r.total_comments == full[r.source_file].total_comments
        assert r.ip_part == full[r.source_file].ip_part


def test_weights_without_region_data(spark):
    row = [("f", 0.6, 0.2, 50.0, False, 90, 40.0)]
    names = "source_file STRING, negative_ratio DOUBLE, high_risk_ratio DOUBLE, avg_risk_score DOUBLE, has_sufficient_ip BOOLEAN, ip_score INT, user_score DOUBLE"
    out = risk.overall_v2(spark.createDataFrame(row, names)).first()
    assert (out.sentiment_part, out.ip_part, out.user_part, out.overall_score) == (42, 0, 40, 41)
    with_ip = risk.overall_v2(spark.createDataFrame([("f", 0.6, 0.2, 50.0, True, 90, 40.0)], names)).first()
    assert with_ip.overall_score == int(42 * 0.4 + 90 * 0.3 + 40 * 0.3) and with_ip.overall_level == "medium"


def test_v1_report_handles_missing_bots_and_anomalies(spark):
    rows = [comment(i, content=f"这是一条独特而完整的评论内容 {i}", user_id=f"u{i}") for i in range(5)]
    r = reports.report_v1(frame(spark, rows), SCOPE, lx.V1).first()
    assert (r.account_risk, r.behavior_risk, r.content_risk) == (0, 0, 0)
    assert r.risk_level == "low" and r.recommendations == ["保持正常监测"] and r.warnings == []


def test_anomaly_thresholds_and_order(spark):
    rows = [comment(i, content="谣言", ip_location="a" if i % 3 else "b", publish_time=__import__("datetime").datetime(2024, 1, 1, i % 4)) for i in range(30)]
    scored = frame(spark, rows).withColumns({"sentiment": F.lit("negative"), "risk_score": F.lit(70)})
    found = an.anomalies(an.anomaly_features(scored, SCOPE), SCOPE)
    got = [(r.anomaly_type, r.severity, r.score, r.affected_count) for r in an.in_report_order(found, SCOPE).collect()]
    assert got == [
        ("negative_sentiment_spike", "critical", 100, 30), ("high_risk_content", "high", 60, 30), ("content_duplication", "high", 96, 29),
        ("night_activity", "medium", 100, 30), ("location_concentration", "medium", 66, 20), ("spam_short_content", "medium", 100, 30),
        ("sensitive_keyword_concentration", "medium", 100, 30)]
    summary = an.anomaly_summary(found, SCOPE).first()
    assert (summary.total_anomalies, summary.critical, summary.high, summary.has_critical) == (7, 1, 2, True)


def test_volume_spike_needs_three_hours(spark):
    hours = [(h, n) for h, n in ((0, 1), (1, 1), (2, 1), (3, 1), (4, 20))]
    rows = [(f"2024-01-01 0{h}:00:00", n) for h, n in hours]
    df = spark.createDataFrame(rows, "t STRING, n BIGINT").select(F.to_timestamp("t").alias("hour_start"), "n")
    r = an.volume_spike(df).first()
    assert (r.time_window, r.severity, r.score, r.affected_count) == ("2024-01-01 04:00", "medium", 63, 20)
    assert an.volume_spike(df.filter("n = 20")).count() == 0


def test_render_and_sink(spark, report, tmp_path):
    full = reports.with_report_fields(report, "http://x", "2024-01-01 00:00:00")
    row = full.select(*[render.FORMATS[k]().alias(k) for k in render.FORMATS]).first()
    body = json.loads(row.json)
    assert body["risk"]["breakdown"]["anomaly"] == 0 and body["basic"]["source_url"] == "http://x"
    assert "## 风险评估" in row.md and row.html.endswith("</html>") and "【情感分析】" in row.txt and "评分分解" in row.dashboard
    writers.sink_report(full, str(tmp_path / "out"), SCOPE, ["md", "txt"])
    back = spark.read.json(str(tmp_path / "out"))
    assert {r.format for r in back.collect()} == {"md", "txt"} and back.count() == 2 * report.count()


def test_v1_appendices(spark):
    rows = [comment(i, content=f"谣言 {i} " + "很长" * 80, user_id=f"u{i}") for i in range(70)]
    rows += [comment(100 + i, content="好", user_id="loud", user_name="Loud", publish_time=__import__("datetime").datetime(2024, 1, 1, 3, i)) for i in range(30)]
    out = reports.report_v1(frame(spark, rows), SCOPE, lx.V1, risky_from=0)
    listed = out.first()
    scored = {r["ord"]: (r["risk_score"], r["content"]) for r in reports.sentiment.with_risk(
        reports.sentiment.with_sensitive(reports.sentiment.with_sentiment(frame(spark, rows), lx.V1), lx.V1), lx.V1).collect()}
    want = sorted(scored, key=lambda i: (-scored[i][0], i))[:50]
    assert [(x["index"], x["risk_score"], x["content"]) for x in listed.sensitive_content] == [(i, scored[i][0], scored[i][1][:100]) for i in want]
    users = reports.bots.bot_scores(reports.row_features_v1(frame(spark, rows), SCOPE), SCOPE).where("risk_level = 'high'").collect()
    best = sorted(users, key=lambda r: (-r.overall_score, r.user))[:20]
    assert best and [(x.user_id, x.risk_score, x.total_comments, x.reasons) for x in listed.high_risk_accounts] == [
        (r.user, r.overall_score, r.total_comments, r.reasons) for r in best]
    text = reports.with_report_fields_v1(out, "feed", "2024-01-02 03:04:05").select(render.markdown_v1()).first()[0]
    assert "**报告ID**: RPT_20240102030405" in text and "**数据源**: feed" in text and f"### 高风险账号 (前 {len(best)} 个)" in text
    assert "**Loud** (风险: " in text and text.count('..."') == 10 and "### 敏感内容 (前 50 条)" in text
    plain = reports.report_v1(frame(spark, [comment(1, content="好")]), SCOPE, lx.V1).first()
    assert plain.high_risk_accounts == [] and plain.sensitive_content == []


def test_v1_record(spark):
    r = reports.report_row_v1(reports.report_v1(frame(spark, random_rows(120, 3)), SCOPE, lx.V1), SCOPE).first()
    assert set(json.loads(r.report)["risk_breakdown"]) == {"sentiment_risk", "account_risk", "behavior_risk", "content_risk"}
