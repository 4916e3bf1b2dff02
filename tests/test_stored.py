import pytest
from pyspark.sql import functions as F

from basalt.functions import text as tx
from basalt.operators import lookup as lk
from basalt.operators import validate as va
from basalt.plans import pipelines as pl
from basalt.sources import collections as cs
from basalt.sources import providers as pv


def test_score_labels_go_by_the_exact_value(spark):
    want = {46.15: "46.1", 54.55: "54.5", 6.25: "6.3", 56.25: "56.3", 0.0: "0.0", 100.0: "100.0", 0.05: "0.1", 99.95: "100.0", 0.049: "0.0", -6.25: "-6.3", 46.15 + 1e-13: "46.2"}
    rows = spark.createDataFrame([(x,) for x in want], "x double").select("x", tx.score_label(F.col("x")).alias("s")).collect()
    assert {r.x: r.s for r in rows} == want


def test_strip_takes_time_in_proportion(spark):
    text = "a" + " " * 200_000 + "b  "
    row = spark.createDataFrame([(text,)], "t string").select(tx.strip(F.col("t")).alias("s"), tx.is_blank(F.col("t")).alias("b")).first()
    assert row.s == text[:-2] and not row.b


def test_upsert_keeps_one_row_of_a_key(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("b", 5), ("b", 4)], "k string, v int")
    assert sorted((r.k, r.v) for r in lk.upsert(old, new, "k", ("v",)).collect()) == [("a", 1), ("b", 5)]


def test_long_names_differ(spark):
    base = "The bidder must have " + "experience " * 40
    rows = pv.extract_requirements(spark.createDataFrame([("c", "s", base + "one. " + base + "two.")], "chunk_id string, source_document string, text string")).collect()
    names = [r.requirement_name for r in rows]
    assert len(set(names)) == 2 and all(len(n) <= 255 for n in names)


def test_settings_of_the_session(spark):
    spark.conf.set("basalt.top_k", "9")
    try:
        assert cs.Settings.of(spark).top_k == 9 and cs.Settings.of(spark).ocr_language == "eng"
    finally:
        spark.conf.unset("basalt.top_k")
    with pytest.raises(ValueError, match="name"):
        cs.open_collection(spark, "/tmp", " ")
    with pytest.raises(ValueError, match="unsupported"):
        pv.reply_schema("UNKNOWN")


def test_chunks_and_embeddings_of_long_texts(spark):
    """Pieces of a long text take time in proportion; embeddings are those of each word by itself."""
    import hashlib
    import time

    import numpy as np

    text = "".join(f"word{k} 😀é " for k in range(200_000))
    docs = spark.createDataFrame([("d", text)], "source_document string, text string")
    began = time.perf_counter()
    got = {r.chunk_index: r.text for r in tx.chunk(docs).collect()}
    assert time.perf_counter() - began < 30
    plain = " ".join(text.split())
    assert len(got) == -(-(len(plain) - 1000) // 800) + 1 and all(got[k] == plain[800 * k : 800 * k + 1000].strip() for k in got)
    rows = [(0, "A b  a"), (1, None), (2, " \t"), (3, "é " * 500), (4, "one")]
    for r in pv.embed(spark.createDataFrame(rows, "id int, text string"), dim=16).collect():
        words = (r.text or "").lower().split()
        v = np.zeros(16)
        for w in words:
            code = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
            for k in (0, 10, 20):
                v[(code >> k) % 16] += 1 if code >> k + 9 & 1 else -1
        assert r.embedding is None if not v.any() else np.allclose(r.embedding, v / np.sqrt(v @ v))
    assert pv.embed(spark.createDataFrame([], "text string")).count() == 0


def test_places_within_a_crowded_key(spark):
    rows = [(None if k % 50 == 0 else 7 if k % 3 else k % 5, k % 40, k) for k in range(3000)]
    df = spark.createDataFrame(rows, "k int, v int, id int").repartition(11)
    got = {}
    for r in lk.ranked(df, "k", ["v"]).collect():
        got.setdefault(r.k, []).append((r.nth, r.v, r.id))
    for k, mine in got.items():
        want = sorted((v, i) for key, v, i in rows if key == k)
        assert [(v, i) for _, v, i in sorted(mine)] == want and [n for n, _, _ in sorted(mine)] == list(range(1, len(want) + 1))


def test_provider_records(spark):
    rows = [
        (1, True, "GST", "27A", "VERIFIED", {"legal_name": "X"}, "done", None), (2, True, "GST", "27A", "NOT_FOUND", None, None, [" ", None]), (3, False, "GST", "27A", "ERROR", None, None, ["down"]),
        (4, None, " ", None, "VERIFIED", None, None, None), (5, False, "GST", "27A", "PENDING", {"a": "b"}, " ", []), (6, True, "GST", "27A", "ERROR", {}, None, ["odd"]),
    ]
    df = spark.createDataFrame(rows, "id int, success boolean, provider string, identifier string, verification_status string, data map<string,string>, message string, errors array<string>")
    got = {r.id: (r.record.asDict(), r.faults) for r in va.provider_record(df).collect()}
    assert got[1] == ({"success": True, "provider": "GST", "identifier": "27A", "verification_status": "VERIFIED", "data": {"legal_name": "X"}, "message": "done", "errors": []}, [])
    assert got[2][0]["data"] == {} and [got[k][1] for k in (2, 3)] == [[], []]
    assert got[4][1] == ["success", "provider", "identifier", "verification_status", "message"]
    assert got[5][1] == ["data", "message"] and got[6][1] == ["verification_status", "errors"]


def test_guards_of_documents_and_batches(spark):
    asked = spark.createDataFrame([(1, 0, "a.pdf"), (2, None, None), (3, 5, " \n"), (4, 5, "a.pdf")], "id int, bid_document_id int, file_path string")
    assert [r.error for r in pl.document_faults(asked).orderBy("id").collect()] == [pl.NO_DOCUMENT] * 2 + [pl.NO_PATH, None]
    texts = spark.createDataFrame([(None, "a"), (None, "b"), (1, "a"), (1, None), (2, "c"), (3, " ")], "k int, text string")
    good, bad = pl.embed_checked(texts, "k")
    assert sorted((r.k or 0, r.text) for r in good.collect()) == [(0, "a"), (0, "b"), (2, "c")] and good.where("embedding is null").count() == 0
    assert {(r.k, r.error) for r in bad.collect()} == {(1, pl.NO_TEXT), (3, pl.NO_TEXT)} and bad.count() == 3
    assert pl.embed_checked(texts.limit(0), "k")[0].count() == 0
