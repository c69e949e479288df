"""Counts per time step over long gaps."""

from collections import Counter
from datetime import datetime, timedelta

import pytest

from tests.helpers import comment, frame
from voxrisk.operators.quality import time_density


@pytest.mark.parametrize("unit,step", [("hour", timedelta(hours=1)), ("minute", timedelta(minutes=1)), ("day", timedelta(days=1))])
def test_time_density(spark, unit, step):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    start = datetime(2024, 2, 27, 21, 30)
    times = {"a": [start, start + timedelta(minutes=50), start + timedelta(hours=60)], "b": [start], "c": [None]}
    rows = [comment(i, publish_time=t, source_file=s) for i, (s, t) in enumerate((s, t) for s, ts in times.items() for t in ts)]
    cut = {"hour": dict(minute=0, second=0), "minute": dict(second=0), "day": dict(hour=0, minute=0, second=0)}[unit]
    want = {}
    for s, ts in times.items():
        counts = Counter(t.replace(**cut) for t in ts if t)
        at = min(counts, default=None)
        while counts and at <= max(counts):
            want[s, at] = counts[at]
            at += step
    assert {(r.source_file, r.bucket): r.n for r in time_density(frame(spark, rows), ["source_file"], unit).collect()} == want


def test_one_far_off_time(spark):
    rows = [comment(0, publish_time=datetime(2024, 1, 1)), comment(1, publish_time=datetime(2300, 1, 1))]
    out = time_density(frame(spark, rows))
    hours = (datetime(2300, 1, 1) - datetime(2024, 1, 1)) // timedelta(hours=1) + 1
    assert out.count() == hours and out.agg({"n": "sum"}).first()[0] == 2
