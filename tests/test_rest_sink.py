"""Requests through transports that fail: each has its effect once."""

import json
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F
from quarry.plans.derived import _Flaky
from quarry.sources import rest, rest_sink


class Dies(_Flaky):
    """Fails for good after some calls of a task."""

    def __init__(self, folder, calls):
        super().__init__(folder, 0.0)
        self.left = calls

    def __call__(self, *args):
        self.left -= 1
        if self.left < 0:
            raise SystemError("killed")
        return super().__call__(*args)


def effects(at):
    lines = [x for f in os.listdir(f"{at}/effects") for x in open(f"{at}/effects/{f}", encoding="utf-8")]
    return Counter(x.split("\t")[0] for x in lines)


def requests(spark, n=60):
    d = spark.range(n).withColumn("name", F.lit("x")).withColumn("text", F.concat(F.lit("text "), F.col("id").cast("string")))
    return d.select("name", rest.create_by_text(F.lit("d"), F.col("id").cast("string"), F.col("text")).alias("request"))


@pytest.mark.parametrize("group", [1, 7, 100])
def test_goes_on_after_a_failure(spark, tmp_path, group):
    at = str(tmp_path)
    q = requests(spark)
    q = q.unionByName(q.limit(5)).unionByName(q.limit(1).select("name", F.lit(None).cast(q.schema["request"].dataType).alias("request")))
    with pytest.raises(Exception, match="killed"):
        rest_sink.post(q, Dies(f"{at}/effects", 4), f"{at}/journal", parts=4, group=group, attempts=2, pause=0.001)
    first = sum(effects(at).values())
    assert 0 < first < 60
    rest_sink.post(q, _Flaky(f"{at}/effects"), f"{at}/journal", parts=4, group=group, attempts=30, pause=0.001)
    assert len(effects(at)) == 60 and set(effects(at).values()) == {1}
    done = rest_sink.journaled(spark, f"{at}/journal").collect()
    assert len(done) == 60 and {r.status for r in done} == {200}
    rest_sink.post(q, Dies(f"{at}/effects", 0), f"{at}/journal", parts=4, group=group)
    last = [json.load(open(f"{at}/journal/{f}")) for f in os.listdir(f"{at}/journal") if f.startswith("committed-")]
    assert {"calls": 0, "skipped": 60} in last


def test_statuses(tmp_path):
    journal = rest_sink.Journal(str(tmp_path), 0)
    row = {"name": "a", "method": "GET", "path": "/x", "body": None, "file": None}
    with pytest.raises(rest.RequestFailed, match="404"):
        rest_sink.Caller(lambda *a: 404, journal).run([row])
    answers = [503, 429, 200]
    c = rest_sink.Caller(lambda *a: answers.pop(0), journal, pause=0.001)
    c.run([row, row])
    assert c.calls == 3 and not answers
    assert rest_sink.Journal(str(tmp_path), 0).done == {"a": 200}
    with pytest.raises(rest.RequestFailed, match="after 2 attempts"):
        rest_sink.Caller(lambda *a: 500, rest_sink.Journal(str(tmp_path), 1), attempts=2, pause=0.001).run([row])


def test_rate_and_files(tmp_path, monkeypatch):
    slept, got = [], []
    monkeypatch.setattr(rest_sink.time, "sleep", slept.append)
    monkeypatch.setattr(rest_sink.time, "monotonic", lambda: 0.0)
    rows = [{"name": str(k), "method": "POST", "path": "/x", "body": "{}", "file": {"name": "f", "content": b"z"}} for k in range(3)]
    rest_sink.Caller(lambda *a: got.append(a) or 200, rest_sink.Journal(str(tmp_path), 0), gap=0.5).run(rows)
    assert slept == [0.5, 1.0]
    assert [a[3] for a in got] == [("f", b"z")] * 3


def test_names_and_empty(spark, tmp_path):
    q = requests(spark, 3)
    names = [r.n for r in q.select(rest_sink.request_name().alias("n")).collect()]
    assert len(set(names)) == 3 and names == [r.n for r in q.select(rest_sink.request_name().alias("n")).collect()]
    rest_sink.post(q.limit(0), _Flaky(str(tmp_path / "effects")), str(tmp_path / "journal"), parts=2)
    assert not os.path.exists(tmp_path / "effects")
