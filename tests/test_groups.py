"""Grouped operators against plain Python on random rows with many ties."""

import pytest
from pyspark.sql import functions as F

from tests.helpers import as_dicts, comment, frame, gini, group, random_rows, regularity, thirds
from voxrisk.operators import bots, filters, prep, regions, scaling, topics, users

SCOPE = ["source_file"]


@pytest.fixture(scope="module", params=[1, 2])
def sample(request, spark):
    rows = random_rows(400, request.param)
    return as_dicts(rows), frame(spark, rows).repartition(5)


def user_of(r):
    return r["user_id"] or r["user_name"] or "unknown"


def test_time_regularity(sample):
    rows, df = sample
    got = {(r.source_file, r.platform, r.user): r.time_regularity
           for r in users.time_regularity(users.profile_features(df, SCOPE), SCOPE).collect()}
    want = {}
    for key, part in group(rows, "source_file", "platform", user_of).items():
        times = [r["publish_time"] for r in part if r["publish_time"]]
        if len(times) >= 2:
            want[key] = regularity(times)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) <= 0.001 for k in want)


def test_regularity_edges(spark):
    at = [None, "2024-01-01 00:00:00"]
    cases = {"same": [at[1]] * 4, "two": [at[1], "2024-01-02 00:00:00"],
             "even": [f"2024-01-01 0{h}:00:00" for h in range(5)], "one": [at[1]]}
    rows = [(name, t, i) for name, times in cases.items() for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "user STRING, t STRING, ord INT").select("user", F.lit("p").alias("platform"), F.to_timestamp("t").alias("publish_time"))
    got = {r.user: r.time_regularity for r in users.time_regularity(df).collect()}
    assert got == {"same": 1.0, "two": 0.0, "even": 1.0}


def test_user_profile(sample):
    rows, df = sample
    got = {(r.source_file, r.platform, r.user): r for r in users.user_profile(users.profile_features(df, SCOPE), SCOPE).collect()}
    want = {k: v for k, v in group(rows, "source_file", "platform", user_of).items() if len(v) >= 2}
    assert got.keys() == want.keys()
    for key, part in want.items():
        texts = [r["content"] for r in part]
        g = got[key]
        assert g.user_name == min(part, key=lambda r: r["ord"])["user_name"]
        assert g.unique_content_ratio == pytest.approx(len({t.strip() for t in texts if t.strip()}) / len(texts))
        assert g.short_content_ratio == pytest.approx(sum(len(t.strip()) < 5 for t in texts) / len(texts))
        levels = [r["user_level"] for r in part if r["user_level"] is not None]
        assert g.user_level == (int(sum(levels) / len(levels)) if key[1] == "bilibili" and levels else None)


def test_active_hours_rebuild_the_list(sample):
    rows, df = sample
    runs = users.active_hours(users.profile_features(df, SCOPE), SCOPE).orderBy("hour_start").collect()
    got = {}
    for r in runs:
        got.setdefault((r.source_file, r.platform, r.user), []).extend([r.hour] * r.n)
    want = {}
    for key, part in group(rows, "source_file", "platform", user_of).items():
        times = sorted(r["publish_time"] for r in part if r["publish_time"])
        if len(times) >= 2:
            want[key] = [t.hour for t in times]
    assert got == want


def test_bot_scores(sample):
    rows, df = sample
    got = {(r.source_file, r.user): r for r in bots.bot_scores(bots.bot_features(df, SCOPE), SCOPE).collect()}
    want = {k: v for k, v in group(rows, "source_file", user_of).items() if len(v) >= 3}
    assert got.keys() == want.keys()
    for key, part in want.items():
        g, n = got[key], len(part)
        times = sorted(r["publish_time"] for r in part if r["publish_time"])
        span = (times[-1] - times[0]).total_seconds() / 3600 if len(times) > 1 else None
        rate = 0.0 if span is None else (float(n) if span == 0 else n / span)
        assert g.avg_comments_per_hour == pytest.approx(rate)
        assert g.content_similarity == pytest.approx(1 - len({r["content"] for r in part}) / n)
        last = max(part, key=lambda r: r["ord"])
        assert (g.user_name, g.platform) == (last["user_name"], last["platform"])
        assert g.overall_score == int(g.frequency_score * 0.3 + g.repetition_score * 0.3 + g.account_score * 0.2 + g.behavior_score * 0.2)
        assert 0 <= g.overall_score <= 100


def test_regions(sample):
    rows, df = sample
    counts = regions.region_counts(df, SCOPE)
    got = {r.source_file: r for r in regions.concentration(counts, SCOPE).collect()}
    waves = {r.source_file: r for r in regions.wave_spread(df, SCOPE).collect()}
    for (source,), part in group(rows, "source_file").items():
        tally = {}
        for r in part:
            if r["ip_location"]:
                tally[r["ip_location"]] = tally.get(r["ip_location"], 0) + 1
        assert got[source].gini == pytest.approx(gini(list(tally.values())))
        assert 0 <= got[source].gini <= 1
        assert got[source].top3_ratio == pytest.approx(sum(sorted(tally.values())[-3:]) / sum(tally.values()))
        n, diversity = thirds(part)
        w = waves[source]
        assert (w.timed_rows, [w.regions_1, w.regions_2, w.regions_3]) == (n, diversity)


def test_wave_gate_and_pattern(spark):
    def rows(n, source, names):
        return [comment(i, source_file=source, ip_location=names(i), publish_time=__import__("datetime").datetime(2024, 1, 1, 0, i)) for i in range(n)]
    df = frame(spark, rows(9, "nine", lambda i: "a") + rows(10, "ten", lambda i: "a") + rows(12, "wave", lambda i: "a" if i < 4 else f"r{i}"))
    got = {r.source_file: (r.wave_detected, r.pattern) for r in regions.wave_spread(df, SCOPE).collect()}
    assert got == {"nine": (False, "unknown"), "ten": (False, "concentrated"), "wave": (True, "wave_spread")}


def test_region_gate_keeps_low_coverage_out(spark):
    df = frame(spark, [comment(i, ip_location="a" if i == 0 else None) for i in range(10)])
    row = regions.suspicion(df, SCOPE).first()
    assert not row.has_sufficient_ip and row.suspicion_score == 0 and row.gini is None
    assert row.findings == ["IP 属地覆盖率仅 10.0%（1/10 条），低于分析阈值 30%，跳过地域分析"]


@pytest.mark.parametrize("n", [1, 7, 1000, 1001, 1234, 5000])
def test_head_per_scope(spark, n):
    df = spark.range(3000).select((F.col("id") % 2).cast("string").alias("s"), (F.col("id") * 7919 % 3000 * 100003).alias("ord")).repartition(7)
    got = sorted((r.s, r.ord) for r in scaling.head_per_scope(df, ["s"], "ord", n).collect())
    want = []
    for s in ("0", "1"):
        want += sorted((str(i % 2), i * 7919 % 3000 * 100003) for i in range(3000) if str(i % 2) == s)[:n]
    assert got == sorted(want)


def test_rank_boundaries_with_all_times_equal(spark):
    df = spark.range(500).select(F.lit("x").alias("s"), F.lit("2024-01-01").cast("timestamp").alias("t"), (F.col("id") * 1000003 % 500).alias("ord"))
    cuts = scaling.rank_boundaries(df, ["s"], scaling.time_levels(F.col("t"), F.col("ord")), lambda n: [F.floor(n / 3), F.floor(2 * n / 3), n])
    assert {r.cut: r.l2 for r in cuts.collect()} == {0: 166, 1: 333}


def test_top_k_is_cut_per_task_before_the_shuffle(spark):
    df = spark.range(100000).select((F.col("id") % 3).alias("s"), F.xxhash64("id").alias("v"), "id")
    top = scaling.top_k(df, ["s"], [F.desc("v"), F.col("id")], 5, spread_on=["id"])
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.count("Exchange") == 2
    rows = df.collect()
    want = {(s, r.id) for s in range(3) for r in sorted((r for r in rows if r.s == s), key=lambda r: (-r.v, r.id))[:5]}
    assert {(r.s, r.id) for r in top.collect()} == want


def test_analysis_limit_none_keeps_all(sample):
    rows, df = sample
    assert filters.analysis_limit(df, SCOPE, None).count() == len(rows)


def test_results_do_not_depend_on_partitions(sample):
    _, df = sample
    def result(d):
        return sorted(map(tuple, regions.suspicion(d, SCOPE).select("source_file", "suspicion_score", "pattern", "top_region").collect()))
    assert result(df) == result(df.repartition(1)) == result(df.repartition(11, "ord"))


def test_one_scope_equals_separate_runs(sample):
    _, df = sample
    feats = bots.bot_features(df, SCOPE)
    together = {(r.source_file, r.user): r.overall_score for r in bots.bot_scores(feats, SCOPE).collect()}
    apart = {}
    for source in ("s0", "s1", "s2"):
        part = bots.bot_features(df.filter(F.col("source_file") == source))
        apart.update({(source, r.user): r.overall_score for r in bots.bot_scores(part).collect()})
    assert together == apart


def test_topic_clusters(spark):
    df = frame(spark, [comment(i, content=t) for i, t in enumerate(["aa bb", "bb aa", "aa", "cc", "zz", "aa bb cc dd"])])
    words = topics.keywords_count(df, [], ["zz"])
    assert [(r.token, r.n) for r in words.orderBy("rank").collect()] == [("aa", 4), ("bb", 3), ("cc", 2), ("dd", 1)]
    got = {r.topic: (r.n, round(r.ratio, 3)) for r in topics.topic_clusters(df, [], words).collect()}
    assert got == {"aa+bb": (2, 0.333), "aa": (1, 0.167), "cc": (1, 0.167), "其他": (1, 0.167), "aa+bb+cc": (1, 0.167)}


def test_interpolation_hits_known_points(spark):
    df = spark.createDataFrame([("a", 0.0, 0.0), ("a", 1.0, 10.0), ("a", 3.0, 0.0), ("b", 5.0, 1.0)], "s STRING, x DOUBLE, y DOUBLE")
    rows = prep.interpolate_linear(df, ["s"], "x", "y", n=2).orderBy("i").collect()
    assert [(round(r.x, 6), round(r.y, 6)) for r in rows] == [(0.0, 0.0), (0.6, 6.0), (1.2, 9.0), (1.8, 6.0), (2.4, 3.0), (3.0, 0.0)]


def test_fill_and_drop(spark):
    df = spark.createDataFrame([(1, "b", None, "k"), (None, "a", None, "k"), (4, None, None, "k"), (4, None, None, "k")],
                               "n INT, s STRING, e STRING, c STRING")
    rows = sorted(map(tuple, prep.clean_table(df).collect()))
    assert rows == [(1.0, "b"), (2.5, "a"), (4.0, "a")]


def test_tokens_counted_within_their_text(spark):
    texts = [(1, "ab cd ab, ab!"), (1, "cd x 你好你好 zz"), (2, None), (3, ""), (None, "ab ab"), (None, "the ab"), (4, " ".join(f"w{i % 700}" for i in range(5000)))]
    df = spark.createDataFrame(texts, "ord long, content string")
    for cjk in (False, True):
        rows = topics.token_rows(df, ["ord"], ["the"], cjk, counted=True)
        assert "token" not in "".join(x for x in rows._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in x)  # no task holds tokens to be grouped
        plain = topics.token_rows(df, ["ord"], ["the"], cjk).groupBy("ord", "token").agg(F.count("*").alias("n"))
        assert sorted(map(str, rows.select("ord", "token", "n").collect())) == sorted(map(str, plain.collect()))
    assert topics.token_rows(df.limit(0), ["ord"], counted=True).count() == 0
