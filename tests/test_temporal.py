import datetime
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from basalt.operators import rollups as rl
from basalt.operators import temporal as tm
from basalt.sources.tables import open_table

DAY0 = datetime.datetime(2024, 1, 1)


def at(hours):
    return None if hours is None else DAY0 + datetime.timedelta(hours=hours)


@pytest.mark.parametrize("seconds", [600, 86_400, 10**9])
def test_as_of_against_the_definition(spark, seconds):
    rng = random.Random(seconds)
    hours = lambda: rng.choice([None, round(rng.uniform(-50, 200), 1), float(rng.randrange(100))])
    left = [(n, rng.choice([None, 1, 1, 1, 2, 3, 9]), at(hours())) for n in range(300)] * 2
    right = [(rng.choice([None, 1, 1, 2, 3, 4]), at(hours()), n, f"v{n}") for n in range(200)]
    l, r = spark.createDataFrame(left, "n int, k int, t timestamp"), spark.createDataFrame(right, "k int, t timestamp, id int, v string")
    for within in (None, 3600 * 5):
        got = sorted((str(tuple(x)) for x in tm.as_of(l, r, "k", "t", ["v"], tie="id", within=within, seconds=seconds).collect()))
        want = []
        for n, k, t in left:
            rows = [x for x in right if x[0] == k and t is not None and x[1] is not None and x[1] <= t]
            last = max(rows, key=lambda x: (x[1], x[2]), default=None)
            if last and within is not None and (t - last[1]).total_seconds() > within:
                last = None
            want.append(str((n, k, t, last and last[1], last and last[3])))
        assert got == sorted(want)
    assert tm.as_of(l, r.limit(0), "k", "t", ["v"]).where("v is not null").count() == 0 and tm.as_of(l.limit(0), r, "k", "t", ["v"]).count() == 0
    with pytest.raises(ValueError, match="k"):
        tm.as_of(l, r, "k", "t", ["k"])


@pytest.mark.parametrize("seconds", [3600, 86_400])
def test_overlapping_against_sql(spark, seconds):
    rng = random.Random(seconds)
    rows = lambda: [(n, rng.choice([None, 1, 1, 2, 3]), at(a := rng.choice([None, rng.randrange(60)])), at(None if a is None else a + rng.choice([-1, 0, 1, 5, 40]))) for n in range(150)]
    a, b = rows(), rows()
    names = "{0} int, k int, {1} timestamp, {2} timestamp"
    got = tm.overlapping(spark.createDataFrame(a, names.format("n", "s", "e")), spark.createDataFrame(b, names.format("m", "s2", "e2")), "k", "s", "e", ["m"], "s2", "e2", seconds).select("n", "m").collect()
    con = duckdb.connect()
    for t, x in (("a", a), ("b", b)):
        con.execute(f"CREATE TABLE {t} (n INT, k INT, s TIMESTAMP, e TIMESTAMP)")
        con.executemany(f"INSERT INTO {t} VALUES (?, ?, ?, ?)", x)
    want = con.execute("SELECT a.n, b.n FROM a JOIN b ON a.k = b.k AND a.s < b.e AND b.s < a.e WHERE a.s < a.e AND b.s < b.e").fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 100


def test_rollups_from_stored_batches(spark, tmp_path):
    rng = random.Random(9)
    rows = [(rng.choice([None, 1, 2]), rng.choice("ab"), rng.choice(["x", None]), rng.randrange(5000), round(rng.expovariate(0.01), 2)) for _ in range(12_000)]
    kind = "tender int, bidder string, type string, person int, amount double"
    keys = ("tender", "bidder", "type")
    kept = rl.StoredRollup(open_table(spark, str(tmp_path / "cells"), rl.cells_schema([("tender", "int"), ("bidder", "string"), ("type", "string")]), "cell", 4), keys)
    for n in range(4):
        kept.merge(n, spark.createDataFrame(rows[3000 * n : 3000 * n + 3000], kind), "person", "amount")
    kept.merge(3, spark.createDataFrame(rows[9000:], kind), "person", "amount")  # once more, as after a driver that was lost
    got = rl.read_off(kept.read()).collect()
    assert len(got) == 8 + 4 + 0 + 12 or len({(r.level, r.tender, r.bidder, r.type) for r in got}) == len(got)
    for r in got:
        mine = [x for x in rows if all(k not in r.level.split(",") or x[keys.index(k)] == r[k] for k in keys)]
        amounts, people = sorted(x[4] for x in mine), len({x[3] for x in mine})
        assert r.n == len(mine) and float(r.total) == pytest.approx(sum(amounts)) and (r.least, r.most) == (amounts[0], amounts[-1])
        assert abs(r.n_distinct / people - 1) < 0.06
        for q, v in ((0.5, r.q50), (0.9, r.q90)):
            below = sum(x <= v for x in amounts) / len(amounts)
            assert abs(below - q) < 0.04
    assert sum(r.n for r in got if r.level == "") == 12_000
    some = rl.grouping_sets(kept.table.read(), list(keys), [("tender",), ()])
    assert {r.level for r in some.collect()} == {"tender", ""} and some.count() == 4
