"""Rate limit and bursts: brute force, split probes, streams, restarts."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from limnos.operators.ordered import numbered, rate_limited
from limnos.streaming import runner, telemetry

SCHEMA = "ts timestamp, device long, sensor string, raw int"
START = datetime(2024, 1, 1)


@pytest.fixture
def many_shards(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def greedy(rows, limit):
    """Row by row: {(group, time)} that is accepted."""
    out, last = set(), {}
    for g, t in sorted((r for r in rows if r[1] is not None), key=lambda r: (str(r[0]), r[1])):
        if g not in last or t >= last[g] + limit:
            out.add((g, t))
            last[g] = t
    return out


@pytest.mark.parametrize("seed,limit", [(1, 1000), (2, 37), (3, 100_000), (4, 1)])
def test_rate_limit_against_row_by_row(spark, many_shards, seed, limit):
    rnd = random.Random(seed)
    rows = [("hot", rnd.randrange(400_000)) for _ in range(3000)] + [(f"p{k % 40}", rnd.randrange(9000)) for k in range(900)]
    rows += [("dense", t) for t in range(700)] + [("one", 5), (None, 3), (None, 4), (None, 5000), ("no time", None), ("hot", 1000), ("hot", 1000)]
    df = spark.createDataFrame(rows, "probe string, t long")
    got = [tuple(r) for r in rate_limited(df, ["probe"], "t", limit).collect()]
    assert len(got) == len(set(got)) and set(got) == greedy(rows, limit)


def test_rate_limit_edges(spark):
    df = spark.createDataFrame([], "probe string, t long")
    assert rate_limited(df, ["probe"], "t", 5).collect() == []
    with pytest.raises(ValueError):
        rate_limited(df, ["probe"], "t", 0)


def test_numbering_over_many_shards(spark, many_shards):
    rows = [("a", k) for k in range(2000)] + [("b", 1)] + [(f"c{k % 50}", k) for k in range(500)] + [(None, 7), (None, 8), ("same", 1), ("same", 1), ("same", 1)]
    df = spark.createDataFrame(rows, "g string, k long").orderBy(F.rand(3))
    got = sorted((tuple(r) for r in numbered(df, ["g"], [F.col("k")]).collect()), key=str)
    want, count = [], {}
    for g, k in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        count[g] = count.get(g, 0) + 1
        want.append((g, k, count[g]))
    assert got == sorted(want, key=str)


def readings(n, seed=1):
    rnd = random.Random(seed)
    out, at = [], START
    for k in range(n):
        at += timedelta(milliseconds=rnd.choice([0, 100, 300, 900, 2500]))
        out.append((at, k % 2 if k % 3 else 7, rnd.choice(["ph", "ec"]), rnd.randrange(1024)))
    return out


def stream_over(spark, tmp_path, parts, fn, name, keys=()):
    """One run a part, each new one a restart from the checkpoint."""
    folder, base = str(tmp_path / "in"), str(tmp_path / "run")
    out = None
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        out = runner.run_available_now(spark, fn(runner.file_stream(spark, folder, spark.createDataFrame([], SCHEMA).schema, 1)), name, keys=list(keys), base=base)
    return out


def test_rate_limit_stream_with_restarts(spark, tmp_path):
    rows = readings(400)
    out = stream_over(spark, tmp_path, [rows[:150], rows[150:160], rows[160:]], telemetry.rate_limit_stream, "limit").collect()
    batch = telemetry.rate_limit(spark.createDataFrame(rows, SCHEMA)).select("device", "sensor", F.unix_micros("ts").alias("us"), "raw").collect()
    assert not any(r.late for r in out)
    assert sorted((r.device, r.sensor, r.us) for r in out) == sorted((r.device, r.sensor, r.us) for r in batch)
    assert 0 < len(batch) < 400


def test_late_readings_are_handed_on(spark, tmp_path):
    rows = readings(60)
    out = stream_over(spark, tmp_path, [rows[30:], rows[:30]], telemetry.rate_limit_stream, "late").collect()
    assert sum(r.late for r in out) == 30


def test_bursts_stream_with_restarts(spark, tmp_path):
    rows = readings(437)
    keys = ("device", "sensor", "burst")
    out = stream_over(spark, tmp_path, [rows[:100], rows[100:103], rows[103:]], telemetry.bursts_stream, "bursts", keys).collect()
    batch = telemetry.bursts(spark.createDataFrame(rows, SCHEMA)).collect()
    as_rows = lambda rs: sorted((r.device, r.sensor, r.burst, r.n, r.complete, round(r.raw_avg, 9), r.ph is not None) for r in rs)
    assert as_rows(out) == as_rows(batch)
    assert {r.n for r in batch if r.complete} == {10} and any(not r.complete for r in batch)


def test_bursts_of_a_split_probe(spark, many_shards):
    rows = [(START + timedelta(seconds=k), 1, "ph", k % 1024) for k in range(1005)] + [(None, 1, "ph", 5), (START, 1, "ph", None)]
    got = {r.burst: r for r in telemetry.bursts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == 101 and got[100].n == 5 and not got[100].complete
    assert all(got[b].raw_avg == sum(k % 1024 for k in range(10 * b, 10 * b + 10)) / 10 for b in range(100))


def test_counts_of_a_probe_come_by_time_then_count():
    import pandas as pd
    from limnos.streaming import telemetry
    frames = [pd.DataFrame({"_us": [3, 1], "raw": [5, 9]}), pd.DataFrame({"_us": [1, 2], "raw": [7, 1]})]
    assert telemetry._counts_in_order(iter(frames)).tolist() == [7, 9, 1, 5]
