"""The stream operators against their batch twins; files arrive one by one."""

import random
from datetime import datetime, timedelta

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.plans import registry
from corpusloom.plans.ops import log
from corpusloom.streaming import logs

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, tokens long, failed boolean, code string, retryable boolean"


def events(seed: int, n: int = 600):
    rng = random.Random(seed)
    at = datetime(2024, 1, 1)
    out = []
    for k in range(n):
        at += timedelta(seconds=rng.randint(1, 900))
        failed = rng.random() < 0.5
        out.append((k, at, rng.randint(0, 6), rng.choice(["a", "b"]), float(rng.randint(0, 100)), rng.randint(1, 50), failed, rng.choice(["RATE_LIMITED", "OTHER", "OTHER"]), rng.random() < 0.8))
    return out


def replay(spark, tmp_path, rows, parts: int, operator, mode: str, name: str):
    """The operator over the rows in files, one in each batch, a last row far ahead closing the windows."""
    folder = str(tmp_path / name)
    step = -(-len(rows) // parts)
    for k in range(0, len(rows), step):
        spark.createDataFrame(rows[k : k + step], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    end = (10**6, datetime(2030, 1, 1), -1, "end", 0.0, 0, False, "", True)
    spark.createDataFrame([end], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    q = operator(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return spark.table(name)


SF = "/root/testdata/sf0.001"


def streamed(spark, tmp_path, operator, mode, name, order="event_id", parts=3, last="2030-01-01"):
    """The operator over the rows of ``events``, in files by the order given: what its batch twin has, it should have."""
    rows = log(spark, SF).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("part", F.ntile(parts).over(W.orderBy(F.expr(order), "event_id")))
    folder, schema = str(tmp_path / name), rows.drop("part").schema
    for k in range(1, parts + 1):
        rows.filter(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(folder)
    end = rows.drop("part").limit(1).withColumns({"event_id": F.lit(10**9), "user_id": F.lit(-1), "ts": F.lit(last).cast("timestamp")})
    for far in range(2):
        end.withColumn("ts", F.col("ts") + F.make_interval(mins=F.lit(far))).select(*schema.names).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = operator(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return spark.table(name)


def twin(spark, name):
    return registry.queries()[name](spark, SF)


def same(stream, batch):
    return sorted(map(tuple, stream.select(*batch.columns).collect())) == sorted(map(tuple, batch.collect()))


def test_quotas_equal_their_twin(spark, tmp_path):
    got = streamed(spark, tmp_path, logs.quotas, "append", "quotas_twin").filter("user_id >= 0")
    assert same(got, twin(spark, "k3_quota_per_minute"))


def test_spend_equals_its_twin(spark, tmp_path):
    got = streamed(spark, tmp_path, lambda df: logs.spend(df, "Asia/Shanghai", 100), "append", "spend_twin").filter("user_id >= 0")
    assert same(got, twin(spark, "k4_stream_spend"))


def test_incremental_equals_its_twin(spark, tmp_path):
    op = lambda df: logs.incremental(df.withColumns({"third": F.col("event_id") % 3, "arrival": F.col("event_id") * 37 % 1009}), ["user_id", "third"], ["arrival", "event_id"])
    got = streamed(spark, tmp_path, op, "append", "newer_twin", order="event_id * 37 % 1009").filter("user_id >= 0")
    assert same(got, twin(spark, "k1_stream_incremental"))


def test_seen_once_equals_its_twin(spark, tmp_path):
    op = lambda df: logs.seen_once(df.withColumn("day", F.date_format("ts", "yyyy-MM-dd")), "user_id", ["event_type", "day"], "event_id")
    got = streamed(spark, tmp_path, op, "append", "seen_twin").filter("user_id >= 0")
    assert same(got, twin(spark, "k2_stream_dedupe"))


def test_seen_once_forgets_the_oldest(spark, tmp_path):
    ids = [1, 2, 3, 1, 4, 1, 2, 5, 4, 3]
    rows = [(k, datetime(2024, 1, 1), 0, str(v), 0.0, v, False, "", True) for k, v in enumerate(ids)]
    op = lambda df: logs.seen_once(df, "user_id", ["tokens"], "event_id", 3)
    got = [r.event_id for r in replay(spark, tmp_path, rows, 3, op, "append", "bounded").filter("user_id >= 0").orderBy("event_id").collect()]
    known, want = [], []
    for k, v in enumerate(ids):
        if v not in known:
            known = [*known, v][-3:]
            want.append(k)
    assert got == want and len(want) < len(ids)


def test_retention_equals_its_twin(spark, tmp_path):
    got = streamed(spark, tmp_path, logs.expired, "append", "expired_twin", last="2024-01-31")
    gone, kept = {r.event_id for r in got.collect()}, {r.event_id for r in twin(spark, "k7_retention").collect()}
    every = {r.event_id for r in log(spark, SF).select("event_id").collect()}
    assert gone == every - kept and gone and kept


def test_quotas(spark, tmp_path):
    rows = events(1)
    got = {(r.user_id, r.begin_at): (r.calls, r.over_quota) for r in replay(spark, tmp_path, rows, 3, logs.quotas, "append", "quotas").filter("span = 'minute'").collect() if r.user_id >= 0}
    want: dict = {}
    for r in rows:
        key = (r[2], r[1].strftime("%Y-%m-%d %H:%M"))
        want[key] = want.get(key, 0) + 1
    assert got == {k: (n, n > 3) for k, n in want.items()}


def test_deduplicated(spark, tmp_path):
    rows = events(2)
    again = [r for r in rows for _ in range(2)]
    got = replay(spark, tmp_path, again, 3, logs.deduplicated, "append", "once")
    assert sorted(r.event_id for r in got.collect()) == [*range(len(rows)), 10**6]


def test_guarded(spark, tmp_path):
    rows = events(3, 50)
    moved = [(k, t + timedelta(days=4000) if k % 5 == 0 else t - timedelta(days=20000) if k % 5 == 1 else None if k % 5 == 2 else t, *rest) for k, t, *rest in rows]
    observed = datetime(2024, 2, 1)
    op = lambda df: logs.guarded(df.withColumn("observed_at", F.lit(observed)), "2024-01-31").select("event_id", "ts")
    got = {r.event_id: r.ts for r in replay(spark, tmp_path, moved, 2, op, "append", "guarded").collect()}
    assert all(got[k] == (t if k % 5 > 2 else observed) for k, t, *_ in rows)


def test_incremental(spark, tmp_path):
    rows = events(4, 60)
    late = [(900 + k, r[1] - timedelta(days=1), *r[2:]) for k, r in enumerate(rows[:20])]
    got = {r.event_id for r in replay(spark, tmp_path, rows + late, 4, lambda df: logs.incremental(df, ["user_id"], ["event_id"]), "append", "newer").collect()}
    assert got == {r[0] for r in rows} | {10**6}


def test_health(spark, tmp_path):
    rows = events(6, 400)
    got = {r.user_id: (r.failures, r.state) for r in replay(spark, tmp_path, rows, 4, logs.health, "update", "health").collect()}  # the last update counts
    want = {}
    for user in {r[2] for r in rows}:
        failures, since, told = 0, None, "ACTIVE"
        for r in [r for r in rows if r[2] == user]:
            since = since or r[1]
            if not r[6]:
                failures, since, told = 0, r[1], "ACTIVE"
                continue
            failures += 1
            if r[7] == "RATE_LIMITED":
                told = "RATE_LIMITED"
            elif not r[8]:
                told = "QUARANTINED"
            elif failures >= 3:
                told = "QUARANTINED" if r[1] - since >= timedelta(days=1) else "DEGRADED"
        want[user] = (failures, told)
    assert {u: v for u, v in got.items() if u >= 0} == want


def test_latency(spark, tmp_path):
    rows = events(7)
    got = {(r.begin_at, r.event_type): r.calls for r in replay(spark, tmp_path, rows, 3, logs.latency, "append", "slow").collect() if r.event_type != "end"}
    want: dict = {}
    for r in rows:
        hour = r[1].replace(minute=0, second=0)
        for begin in (hour, hour - timedelta(hours=1)):
            want[(begin, r[3])] = want.get((begin, r[3]), 0) + 1
    assert got == want
