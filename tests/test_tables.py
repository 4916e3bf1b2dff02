import os
import random
import re

import pytest
from pyspark.sql import functions as F

from basalt.operators import lookup as lk
from basalt.sources import tables as tb


def many_partitions(spark, n=64):
    class Setting:
        def __enter__(self):
            self.before = spark.conf.get("spark.sql.shuffle.partitions")
            spark.conf.set("spark.sql.shuffle.partitions", n)

        def __exit__(self, *_):
            spark.conf.set("spark.sql.shuffle.partitions", self.before)

    return Setting()


def test_created_rows_all_come_back(spark, tmp_path):
    """Whatever is selected, with adaptive execution and many partitions: no row is lost, numbers have no gaps."""
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    with many_partitions(spark):
        old = spark.range(10).select("id", F.concat(F.lit("old"), "id").alias("company_name"), F.lit(None).cast("string").alias("gstin"))
        new = spark.range(300_000).select("id", F.concat(F.lit("new"), "id").alias("company_name"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("G"), "id")).alias("gstin")).repartition(37)
        out, rejected = lk.create(new, old, ["gstin"], ["id"])
        out.write.parquet(str(tmp_path / "out"))
        back = spark.read.parquet(str(tmp_path / "out"))
        assert back.count() == 300_010 and rejected.count() == 0
        row = back.agg(F.count_distinct("id").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"), F.count_distinct("company_name").alias("names")).first()
        assert tuple(row) == (300_010, 0, 300_009, 300_010)
        assert back.where("company_name like 'new%' and id <> cast(substr(company_name, 4) as long) + 10").isEmpty()  # in the order told
        assert out.select("gstin").where("gstin is not null").distinct().count() == 150_000
        assert out.select("company_name").union(out.select("company_name")).distinct().count() == 300_010
        assert out.exceptAll(back).isEmpty() and back.exceptAll(out).isEmpty()  # evaluated again, the same


def test_numbers_go_by_order_and_stay(spark):
    rows = spark.createDataFrame([(k, "b" if k % 3 else None, k * 1.0) for k in range(1000)], "k long, name string, x double").repartition(9)
    out = lk.numbered(rows, ["name", "x"], "id", 5)
    got = sorted(out.collect(), key=lambda r: r.id)
    assert [r.id for r in got] == list(range(6, 1006))
    assert [(r.name, r.k) for r in got] == sorted(((r.name, r.k) for r in got), key=lambda x: (x[0] is None, x[1]))
    assert lk.numbered(rows.limit(0), ["k"], "id").count() == 0
    same = spark.createDataFrame([(1,)] * 50, "v int")
    assert sorted(r.id for r in lk.numbered(same, [], "id").collect()) == list(range(1, 51))


def files_of(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) if "bucket=" in d for f in names if f.endswith(".parquet")}


@pytest.fixture
def table(spark, tmp_path):
    return tb.open_table(spark, str(tmp_path / "chunks"), "chunk_id string, text string, n int", "chunk_id", buckets=16)


def test_upsert_delete_and_patch_in_the_store(spark, table):
    want = {}
    rng = random.Random(4)
    for turn in range(4):
        rows = [(f"c{rng.randrange(400)}", f"t{turn}", k) for k in range(120)]
        table.upsert(spark.createDataFrame(rows, table.schema), ("n",))
        for k, t, n in sorted(rows, key=lambda r: r[2]):
            want[k] = (t, n)
        gone = [(f"c{rng.randrange(400)}",) for _ in range(20)] + [("nobody",)]
        table.delete(spark.createDataFrame(gone, "chunk_id string"))
        for (k,) in gone:
            want.pop(k, None)
        changes = [(f"c{k}", None, turn, ["text"] if k % 2 else ["text", "n"]) for k in rng.sample(range(400), 30)]
        table.patch(spark.createDataFrame(changes, "chunk_id string, text string, n int, set_fields array<string>"), ["text", "n"])
        for k, t, n, told in changes:
            if k in want:
                want[k] = (t, n if "n" in told else want[k][1])
        again = tb.open_table(spark, table.path, table.schema, "chunk_id")
        assert again.buckets == 16
        assert {r.chunk_id: (r.text, r.n) for r in again.read().collect()} == want and again.read().count() == len(want)


def test_only_touched_buckets_are_written(spark, table):
    table.upsert(spark.range(1000).select(F.concat(F.lit("c"), "id").alias("chunk_id"), F.lit("x").alias("text"), F.lit(0).alias("n")))
    before = files_of(table.path)
    touched = table.upsert(spark.createDataFrame([("c7", "new", 1)], table.schema))
    after = files_of(table.path)
    assert len(touched) == 1
    kept = {f: t for f, t in before.items() if f"bucket={touched[0]}/" not in f}
    assert kept and all(after.get(f) == t for f, t in kept.items())
    assert table.read().count() == 1000 and table.find(spark.createDataFrame([("c7",), ("none",)], "chunk_id string")).collect()[0].text == "new"
    plan = table.in_buckets(touched)._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^]]*bucket", plan)


def test_emptied_buckets_and_nothing_to_do(spark, table):
    rows = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], table.schema)
    table.upsert(rows)
    assert table.delete(rows.limit(0)) == [] and table.upsert(rows.limit(0)) == []
    table.delete(rows)
    assert table.read().count() == 0 and not files_of(table.path)
    table.upsert(rows)
    assert table.read().count() == 2
    with pytest.raises(ValueError, match="key"):
        tb.open_table(spark, table.path, "a string", "chunk_id")


def test_a_change_that_stopped_is_put_in_place_or_dropped(spark, table, monkeypatch):
    rows = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], table.schema)
    table.upsert(rows)

    def lost(*_):
        raise RuntimeError("the driver is gone")

    monkeypatch.setattr(tb.KeyedTable, "resume", lost)
    with pytest.raises(RuntimeError):
        table.delete(rows.limit(1))
    monkeypatch.undo()
    assert table.read().count() == 2  # the old rows stand
    again = tb.open_table(spark, table.path, table.schema, "chunk_id")
    assert again.read().count() == 1 and not os.path.exists(f"{table.path}/_aside")
    spark.range(3).write.parquet(f"{table.path}/_aside/rows")  # one that stopped earlier
    assert not again.resume() and again.read().count() == 1 and not os.path.exists(f"{table.path}/_aside")
