import datetime
import random

import pytest
from pyspark.sql import functions as F

from basalt.operators import lookup as lk
from basalt.streaming import stateful as st

DAY0 = datetime.datetime(2024, 1, 1)
SCHEMA = "doc long, at timestamp, id long, status string"


@pytest.fixture
def batches(spark, tmp_path):
    """Files of rows, each some hours later than the last; the fifth has rows that are much too late."""
    rng = random.Random(1)
    files = []
    for n in range(6):
        rows = [(rng.choice([1, 1, 2, 3, 4 + n]), DAY0 + datetime.timedelta(hours=3 * n, minutes=rng.randrange(200)), 100 * n + k, rng.choice(["PASS", "fail", None])) for k in range(40)]
        if n == 4:
            rows += [(1, DAY0 - datetime.timedelta(days=3), 999, "PASS"), (77, DAY0 - datetime.timedelta(days=3), 998, "PASS")]
        files.append(rows)
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in"), files


def run(spark, df, tmp_path, mode):
    name = f"out{random.randrange(10**9)}"
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    assert q.awaitTermination(150)
    assert len([p for p in q.recentProgress if p["numInputRows"]]) >= 5  # several batches
    return spark.table(name)


def source(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def on_time(spark, files):
    return spark.createDataFrame([r for rows in files for r in rows if r[2] < 900], SCHEMA)


def test_windows_and_sessions_equal_the_batch(spark, tmp_path, batches):
    path, files = batches
    good = on_time(spark, files)
    got = run(spark, st.sliding_tallies(source(spark, path), "at"), tmp_path, "update")
    got = got.groupBy("window_start", "status").agg(F.max("n_checks").alias("n")).collect()  # the last update of each
    want = good.groupBy(F.window("at", "1 hour", "15 minutes").alias("w"), F.upper("status").alias("status")).count().select("w.start", "status", "count").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, want)))
    got = {(r.doc, r.started): (r.ended, r.n_rows) for r in run(spark, st.sessions(source(spark, path), "doc", "at"), tmp_path, "append").collect()}
    want = {(r.doc, r.w.start): (r.w.end, r["count"]) for r in good.groupBy("doc", F.session_window("at", "30 minutes").alias("w")).count().collect()}
    assert got and all(want[k] == v for k, v in got.items())
    closed = max(r[1] for rows in files for r in rows) - datetime.timedelta(hours=1)  # those that the watermark has passed
    assert {k for k, v in want.items() if v[0] < closed} == set(got)


def test_latest_of_each_key_with_late_rows_and_idle_keys(spark, tmp_path, batches):
    path, files = batches
    st.prepare(spark)
    try:
        out = run(spark, st.latest_stream(source(spark, path), "doc", "at", "id", ["status"], idle_seconds=4 * 3600), tmp_path, "append").collect()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    good = on_time(spark, files)
    want = {r.doc: (r.at, r.id, r.status) for r in lk.latest(good, "doc", "at").collect()}
    told = {}
    for r in out:
        told[r.doc] = max(told.get(r.doc, (DAY0,)), (r.at, r.id, r.status), key=lambda x: x[:2])
    assert told == want and 77 not in told
    last = max(r[1] for rows in files for r in rows) - datetime.timedelta(hours=1)
    forgotten = {r.doc for r in out if r.idle}
    assert forgotten and all(want[d][0] + datetime.timedelta(hours=4) <= last for d in forgotten if d > 3) and {4, 5} <= forgotten
