"""Rows and plain-Python models of the formulas, written from the rules."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

COLUMNS = (
    "comment_id STRING, platform STRING, content STRING, user_name STRING, user_id STRING, user_level INT, like_count BIGINT, "
    "reply_count BIGINT, publish_time TIMESTAMP, ip_location STRING, is_reply BOOLEAN, parent_id STRING, source_file STRING, ord BIGINT"
)
START = datetime(2024, 3, 1)


def comment(ord_, **given):
    row = dict(
        comment_id=str(ord_), platform="bilibili", content="普通评论", user_name="甲", user_id=None, user_level=3, like_count=0,
        reply_count=0, publish_time=None, ip_location=None, is_reply=False, parent_id=None, source_file="f", ord=ord_,
    )
    row.update(given)
    return tuple(row.values())


def frame(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def random_rows(n, seed, sources=3, users=5, regions=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        timed = rng.random() < 0.9
        # coarse times, so that many rows share one
        at = START + timedelta(minutes=rng.randrange(0, 600), seconds=rng.choice([0, 0, 30])) if timed else None
        rows.append(comment(
            i, content=rng.choice(["顶", "顶", "好评 @a", "垃圾 [doge]", "这个视频讲得很清楚", "x" * rng.randrange(1, 12)]),
            user_id=f"u{rng.randrange(users)}", user_name=rng.choice(["user_1", "张三", "12345678"]), user_level=rng.choice([None, 0, 1, 5]),
            like_count=rng.randrange(10), publish_time=at, ip_location=rng.choice([None, "", *[f"省{k}" for k in range(regions)]]),
            platform=rng.choice(["bilibili", "tieba"]), is_reply=rng.random() < 0.3, source_file=f"s{rng.randrange(sources)}",
        ))
    return rows


def as_dicts(rows):
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    return [dict(zip(names, r)) for r in rows]


def group(rows, *keys):
    out = {}
    for r in rows:
        out.setdefault(tuple(k(r) if callable(k) else r[k] for k in keys), []).append(r)
    return out


def regularity(times):
    times = sorted(times)
    if len(times) < 3:
        return 0.0
    gaps = [(b - a).total_seconds() for a, b in zip(times, times[1:])]
    mean = sum(gaps) / len(gaps)
    if mean == 0:
        return 1.0
    std = (sum((g - mean) ** 2 for g in gaps) / len(gaps)) ** 0.5
    return round(max(0.0, 1.0 - min(std / mean, 2.0) / 2), 3)


def gini(counts):
    counts = sorted(counts)
    n, total = len(counts), sum(counts)
    if n <= 1:
        return 1.0
    return sum(v * (2 * i - n - 1) for i, v in enumerate(counts, 1)) / (n * total)


def thirds(rows):
    timed = sorted(((r["publish_time"], r["ord"], r["ip_location"].strip()) for r in rows
                    if r["publish_time"] and r["ip_location"] and r["ip_location"].strip()))
    n = len(timed)
    parts = timed[: n // 3], timed[n // 3: 2 * n // 3], timed[2 * n // 3:]
    return n, [len({ip for _, _, ip in p}) for p in parts]
