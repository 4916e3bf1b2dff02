import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from basalt.operators import assess as asm
from basalt.operators import attempts as at
from basalt.operators import incremental as inc
from basalt.operators import lookup as lk
from basalt.sources import collections as cs
from basalt.sources.tables import open_table
from tests.test_tables import files_of

TIME = datetime.datetime(2024, 1, 1)


def test_latest_of_ten_batches(spark, tmp_path):
    rng = random.Random(1)
    schema = "doc long, id long, status string, created_at timestamp"
    kept = inc.LatestRows(open_table(spark, str(tmp_path / "latest"), schema, "doc", 16))
    rows = []
    for n in range(10):
        # a hot document, one batch of few documents, equal and null times
        batch = [(rng.choice([None, 0, 0, 0, rng.randrange(60)]) if n else rng.randrange(60), 100 * n + k, f"s{n}", rng.choice([None, TIME + datetime.timedelta(hours=rng.randrange(30))])) for k in range(80)]
        rows += batch
        kept.merge(spark.createDataFrame(batch, schema))
    rng.shuffle(rows)
    kept.merge(spark.createDataFrame(rows[:100], schema))  # merged before: nothing changes
    want = lk.latest(spark.createDataFrame(rows, schema), "doc").collect()
    assert sorted(map(str, kept.table.read().collect())) == sorted(map(str, want))
    before = files_of(kept.table.path)
    touched = kept.merge(spark.createDataFrame([(5, 10_000, "new", TIME + datetime.timedelta(days=9))], schema))
    after = files_of(kept.table.path)
    assert len(touched) == 1 and all(after.get(f) == t for f, t in before.items() if f"bucket={touched[0]}/" not in f)
    assert kept.table.find(spark.createDataFrame([(5,)], "doc long")).first().status == "new"
    assert kept.merge(spark.createDataFrame([], schema)) == []


def test_tallies_of_ten_batches(spark, tmp_path):
    rng = random.Random(2)
    kept = inc.Tallies(open_table(spark, str(tmp_path / "tallies"), inc.tallies_schema("bid"), "bid", 16))
    now: dict[int, tuple] = {}
    for n in range(10):
        new = {rng.randrange(500): (rng.choice([None, 1, 1, 1, rng.randrange(40)]), rng.choice(["PASS", "pass", "Fail", "REVIEW", "pending", "odd", None])) for _ in range(70)}
        undone = [now[k] for k in new if k in now]
        now |= new
        frames = [spark.createDataFrame(x, "bid long, status string") for x in (list(new.values()), undone)]
        kept.merge(n, *frames)
        if n in (3, 9):
            kept.merge(n, *frames)  # the same once more, as after a driver that was lost
    want = asm.tally(spark.createDataFrame(list(now.values()), "bid long, status string"), "bid").select("bid", *inc.COUNTS).collect()
    assert sorted(map(str, kept.read().collect())) == sorted(map(str, want))


def test_attempts_survive_a_lost_process(spark, tmp_path):
    where = str(tmp_path / "attempts")
    docs = spark.range(30)

    def breaks(rows):
        return rows.withColumn("error_message", F.when(F.col("id") >= 0, F.raise_error(F.lit("lost"))).cast("string"))

    tried = at.Attempts(open_table(spark, where, at.SCHEMA, "id", 4))
    with pytest.raises(Exception, match="lost"):
        tried.run(docs, breaks, F.lit(TIME))
    again = at.Attempts(open_table(spark, where, at.SCHEMA, "id", 4))
    assert again.left_open().count() == 30 and again.left_open(F.lit(TIME)).count() == 0
    done = again.recover(docs, lambda rows: rows.withColumn("error_message", F.when(F.col("id") % 5 == 0, "unreadable")), at=F.lit(TIME))
    assert done.count() == 30 and again.left_open().count() == 0
    rows = {r.id: r for r in again.table.read().collect()}
    assert all(r.extraction_status == ("FAILED" if i % 5 == 0 else "COMPLETED") and r.tries == 2 and r.completed_at == TIME and (r.error_message == "unreadable") == (i % 5 == 0) for i, r in rows.items())
    assert again.take_up().count() == 0  # taken up once
    again.begin(docs)  # those that are there stay as they are
    assert {r.id: r for r in again.table.read().collect()} == rows


def test_attempts_left_open_too_often_fail(spark, tmp_path):
    tried = at.Attempts(open_table(spark, str(tmp_path / "attempts"), at.SCHEMA, "id", 4))
    tried.begin(spark.range(3).unionAll(spark.range(2)))
    tried.end(spark.createDataFrame([(0, None), (0, None), (9, "of nobody")], "id long, error_message string"))
    assert sorted(r.id for r in tried.take_up().collect()) == [1, 2]
    assert tried.take_up().count() == 0
    states = {r.id: (r.extraction_status, r.error_message, r.tries) for r in tried.table.read().collect()}
    gone = ("FAILED", at.GAVE_UP.format(2), 2)
    assert states == {0: ("COMPLETED", None, 1), 1: gone, 2: gone}


def test_collection_changes_in_the_store(spark, tmp_path):
    store = cs.open_collection(spark, str(tmp_path), "chunks", buckets=4)
    chunks = spark.createDataFrame([(f"{d}_{k}", "t", d, k) for d in ("a", "b") for k in range(5)], "chunk_id string, text string, source_document string, chunk_index int")
    vectors = spark.createDataFrame([(d, k, [float(k)]) for d in ("a", "b") for k in range(5) if (d, k) != ("b", 4)], "source_document string, chunk_index int, embedding array<float>")
    faults = store.add_embedded(chunks, vectors).collect()
    assert [(r.source_document, r.n_chunks, r.n_embeddings) for r in faults] == [("b", 5, 4)] and store.count() == 5
    shrunk = chunks.where("source_document = 'a' and chunk_index < 2").withColumns({"text": F.lit("new"), "embedding": F.array(F.lit(9.0)).cast("array<float>")})
    store.add(shrunk)
    assert sorted((r.chunk_id, r.text) for r in store.read().collect()) == [(f"a_{k}", "new" if k < 2 else "t") for k in range(5)]
    store.delete(chunks.where("chunk_index > 2").select("chunk_id"))
    store.delete(chunks.limit(0).select("chunk_id"))
    assert cs.open_collection(spark, str(tmp_path), "chunks").count() == 3
    assert os.path.exists(store.path)
