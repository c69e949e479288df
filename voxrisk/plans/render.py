"""Report texts as string columns, one per scope row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxrisk.functions import text as tx

TITLE = "舆情安全分析报告"


def _s(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _pct(part: str, total: str = "total_comments") -> Column:
    return F.coalesce(tx.percent(F.try_divide(part, total)), F.lit("0.0%"))


def _bullets(name: str, numbered: bool = False) -> Column:
    """Array of lines as a list, empty text when there are none."""
    def line(x: Column, i: Column) -> Column:
        mark = F.concat((i + 1).cast("string"), F.lit(". ")) if numbered else F.lit("- ")
        return F.concat(mark, x)
    return F.array_join(F.transform(F.col(name), line), "\n")


def _section(title: str, body: Column) -> Column:
    """Heading and body, null (left out by concat_ws) when the body is empty."""
    return F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(f"\n## {title}\n"), body))


def _url() -> Column:
    return F.coalesce(F.nullif(F.col("source_url"), F.lit("")), F.lit("未提供"))


def markdown() -> Column:
    ip = F.when(F.col("gini").isNotNull(), F.concat(
        F.lit("- 基尼系数: "), tx.fixed(F.col("gini"), 3), F.lit("\n- 前3省份占比: "), tx.percent(F.col("top3_ratio"))))
    basic = F.concat_ws(
        "\n",
        F.concat(F.lit("- **分析时间**: "), _s("generated_at")),
        F.concat(F.lit("- **来源链接**: "), _url()),
        F.concat(F.lit("- **平台**: "), F.upper(_s("platform"))),
        F.concat(F.lit("- **总评论数**: "), _s("total_comments")),
        F.concat(F.lit("- **高风险评论**: "), _s("high_risk_comments")),
    )
    risk = F.concat(
        F.lit("- **评分**: "), _s("overall_score"), F.lit("/100\n- **等级**: "), F.upper(_s("overall_level")))
    mood = F.concat_ws("\n", *[
        F.concat(F.lit(f"- {name}: "), _s(col), F.lit(" ("), _pct(col), F.lit(")"))
        for name, col in (("正面", "positive"), ("负面", "negative"), ("中立", "neutral"))
    ])
    return F.concat_ws(
        "\n", F.lit(f"# {TITLE}"), _section("基本信息", basic), _section("风险评估", risk), _section("情感分析", mood),
        _section("IP地域分析", ip), _section("关键发现", _bullets("key_findings")),
        _section("建议措施", _bullets("recommendations", numbered=True)),
        F.concat(F.lit("\n---\n*报告生成时间: "), _s("generated_at"), F.lit("*")),
    )


def dashboard_markdown() -> Column:
    """The longer Markdown form with the score breakdown as a table."""
    table = F.concat_ws("\n", F.lit("| 指标 | 数值 |\n|------|------|"), *[
        F.concat(F.lit(f"| {name} | "), value, F.lit(" |")) for name, value in (
            ("综合风险评分", F.concat(_s("overall_score"), F.lit("/100"))),
            ("风险等级", F.concat(F.lit("**"), F.upper(_s("overall_level")), F.lit("**"))),
            ("总评论数", _s("total_comments")), ("高风险评论", _s("high_risk_comments")), ("可疑账号", _s("suspicious_users")),
        )
    ])
    parts = F.concat_ws("\n", *[
        F.concat(F.lit(f"- {name}: "), _s(col), F.lit("/100")) for name, col in (
            ("情感风险", "sentiment_part"), ("IP 地域", "ip_part"), ("用户画像", "user_part"), ("异常检测", "anomaly_part"))
    ])
    return F.concat_ws(
        "\n", F.lit(f"# {TITLE}"),
        F.concat(F.lit("\n**生成时间**: "), _s("generated_at"), F.lit("  \n**平台**: "), _s("platform")),
        _section("综合评分", table), _section("评分分解", parts), _section("关键发现", _bullets("key_findings")),
        _section("建议", _bullets("recommendations", numbered=True)),
    )


def html() -> Column:
    def card(title: str, *lines: Column) -> Column:
        body = F.concat_ws("\n", *[F.concat(F.lit("<p>"), line, F.lit("</p>")) for line in lines])
        return F.concat(F.lit(f'<div class="card"><h2>{title}</h2>\n'), body, F.lit("</div>"))

    return F.concat_ws(
        "\n",
        F.lit(f'<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>{TITLE}</title></head>\n<body><h1>{TITLE}</h1>'),
        card("基本信息", F.concat(F.lit("分析时间: "), _s("generated_at")), F.concat(F.lit("来源链接: "), _url()),
             F.concat(F.lit("平台: "), F.upper(_s("platform"))), F.concat(F.lit("总评论数: "), _s("total_comments"))),
        card("风险评估", F.concat(F.lit("评分: "), _s("overall_score"), F.lit("/100 | 等级: "), F.upper(_s("overall_level")))),
        card("情感分析", F.concat(F.lit("正面: "), _s("positive"), F.lit(" | 负面: "), _s("negative"), F.lit(" | 中立: "), _s("neutral"))),
        F.lit("</body></html>"),
    )


def txt() -> Column:
    bar = "=" * 40
    return F.concat_ws(
        "\n", F.lit(f"{bar}\n{TITLE}\n{bar}\n\n【基本信息】"),
        F.concat(F.lit("分析时间: "), _s("generated_at")), F.concat(F.lit("来源链接: "), _url()),
        F.concat(F.lit("平台: "), F.upper(_s("platform"))), F.concat(F.lit("总评论数: "), _s("total_comments")),
        F.concat(F.lit("\n【风险评估】\n评分: "), _s("overall_score"), F.lit("/100\n等级: "), F.upper(_s("overall_level"))),
        F.concat(F.lit("\n【情感分析】\n正面: "), _s("positive"), F.lit("\n负面: "), _s("negative"), F.lit("\n中立: "), _s("neutral")),
        F.lit(f"\n{bar}"),
    )


def report_record() -> Column:
    """The nested report record as JSON."""
    ip = F.when(F.col("gini").isNotNull(), F.struct(
        "provinces", "gini", F.col("top3_ratio").alias("top3"), F.col("ip_score").alias("suspicion")))
    return F.to_json(F.struct(
        F.struct("source_file", "generated_at", "source_url", "platform", "total_comments", "high_risk_comments", "suspicious_users").alias("basic"),
        F.struct(
            F.col("overall_score").alias("score"), F.col("overall_level").alias("level"),
            F.struct(F.col("sentiment_part").alias("sentiment"), F.col("ip_part").alias("ip"),
                     F.col("user_part").alias("user"), F.col("anomaly_part").alias("anomaly")).alias("breakdown"),
        ).alias("risk"),
        F.struct("positive", "negative", "neutral").alias("sentiment"),
        ip.alias("ip"), F.array().cast("array<string>").alias("anomalies"),
        F.col("key_findings").alias("findings"), "recommendations",
    ))


FORMATS = {"md": markdown, "json": report_record, "html": html, "txt": txt, "dashboard": dashboard_markdown}

# --- v1 ------------------------------------------------------------------------
LEVEL_MARK = {"low": "🟢", "medium": "🟡", "high": "🔴", "critical": "💀"}


#: Entries of each appendix that the text shows, and the characters of a text in it.
SHOWN, SHOWN_TEXT = 10, 50


def _appendices_v1() -> Column:
    def entries(name: str, show) -> Column:
        return F.array_join(F.transform(F.slice(name, 1, SHOWN), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), show(x))), "\n")

    def text(x: Column) -> Column:
        return F.coalesce(x.cast("string"), F.lit(""))

    accounts = entries("high_risk_accounts", lambda x: F.concat(
        F.lit("**"), text(x["user_name"]), F.lit("** (风险: "), text(x["risk_score"]), F.lit("/100)\n   - 评论数: "), text(x["total_comments"]),
        F.lit("\n   - 理由: "), F.array_join(x["reasons"], ", "), F.lit("\n")))
    contents = entries("sensitive_content", lambda x: F.concat(
        F.lit("风险 "), text(x["risk_score"]), F.lit('/100: "'), F.substring(text(x["content"]), 1, SHOWN_TEXT), F.lit('..."')))
    return F.concat(
        F.lit("### 高风险账号 (前 "), F.size("high_risk_accounts").cast("string"), F.lit(" 个)\n\n"), accounts,
        F.lit("\n### 敏感内容 (前 "), F.size("sensitive_content").cast("string"), F.lit(" 条)\n\n"), contents)


def markdown_v1() -> Column:
    """Text of a v1 report; id, time and source come from ``with_report_fields_v1``."""
    mark = F.lit("⚪")
    for level, sign in LEVEL_MARK.items():
        mark = F.when(F.col("risk_level") == level, sign).otherwise(mark)
    risks = F.concat_ws("\n", F.lit("| 维度 | 评分 |\n|------|------|"), *[
        F.concat(F.lit(f"| {name} | "), _s(col), F.lit("/100 |")) for name, col in (
            ("情感风险", "sentiment_risk"), ("账号风险", "account_risk"), ("行为风险", "behavior_risk"), ("内容风险", "content_risk"))
    ])
    mood = F.concat_ws("\n", *[
        F.concat(F.lit(f"- **{name}情感**: "), _s(col), F.lit(" ("), _pct(col), F.lit(")"))
        for name, col in (("正面", "positive"), ("负面", "negative"), ("中立", "neutral"))
    ])
    bots = F.concat_ws("\n", *[
        F.concat(F.lit(f"- **{name}**: "), _s(col)) for name, col in (
            ("总用户数", "bot_users"), ("高风险账号", "bot_high"), ("中风险账号", "bot_medium"), ("低风险账号", "bot_low"))
    ])
    odd = F.concat(F.lit("- **异常总数**: "), _s("total_anomalies"), F.lit("\n- **异常类型**: "),
                   F.coalesce(F.array_join("anomaly_types", ", "), F.lit("")))
    topics = F.concat(
        F.lit("- **舆论导向**: "), _s("orientation_label"), F.lit("\n- **热度评分**: "), tx.fixed(F.col("trending_score"), 1),
        F.lit("/100\n- **热门关键词**: "), F.coalesce(F.array_join("top_keywords", ", "), F.lit("无")))
    return F.concat_ws(
        "\n", F.lit("# 安全监测报告"),
        F.concat(F.lit("\n**报告ID**: "), _s("report_id"), F.lit("  \n**生成时间**: "), _s("generated_at"), F.lit("  \n**数据源**: "), _s("data_source"), F.lit("  ")),
        F.concat(F.lit("**平台**: "), _s("platform"), F.lit("  \n**总评论数**: "), _s("total_comments")),
        F.concat(F.lit("**时间范围**: "), _s("start"), F.lit(" ~ "), _s("end")),
        F.concat(F.lit("\n- **风险评分**: "), _s("overall_score"), F.lit("/100\n- **风险等级**: "), mark, F.lit(" "), F.upper(_s("risk_level"))),
        _section("风险分解", risks), _section("情感分析", mood), _section("机器人检测", bots), _section("异常检测", odd),
        _section("话题分析", topics), _section("预警信息", _bullets("warnings", numbered=True)),
        _section("建议措施", _bullets("recommendations", numbered=True)), _section("附录", _appendices_v1()),
    )
