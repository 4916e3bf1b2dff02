import collections

import corpus_pipeline as cp
from basalt.llm.toxicity import fit_toxicity, score_toxicity
from tests.llm.test_joins import by_brute_force

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    """Each stage against what it must do with all that the one before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*cp.COLUMNS).cache()
    tables = [docs]
    for _, stage in cp.STAGES:
        tables.append(cp.materialise(stage(spark, tables[-1], SF), "test"))
        if len(tables) <= len(cp.STAGES):
            assert tables[-1].columns == cp.COLUMNS
    raw, clean, known, single, mixed, coded = ([r.asDict() for r in t.collect()] for t in tables)

    model = fit_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    toxic = {r.doc_id for r in score_toxicity(docs, model).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in clean} == {r["doc_id"] for r in raw} - toxic
    assert len(known) >= 0.99 * len(clean)
    groups = by_brute_force({r["doc_id"]: r["text"] for r in known}, cp.SHINGLE_WORDS, cp.SIMILAR_PERCENT)
    assert sorted(r["doc_id"] for r in single) == sorted({c for _, c in groups.values()})
    size = {r["doc_id"]: len(r["text"].split()) for r in single}
    times = collections.Counter(r["doc_id"] for r in mixed)
    assert max(times.values()) <= 3 and set(times) <= set(size)
    assert 0.7 < sum(size[k] * n for k, n in times.items()) / sum(size.values()) < 1.3
    assert collections.Counter(r["doc_id"] for r in coded) == times and all(r["round_trip"] for r in coded)


def test_run_is_the_stages(spark):
    out = cp.run(spark, SF)
    assert out.count() > 0 and "ids" in out.columns


def test_edges(spark):
    rows = [(1, "the cat sat on the mat today", "en", "a", 28), (1, "the cat sat on the mat today", "en", "a", 28), (2, None, None, None, None), (None, "the cat sat on a chair and slept", "en", "b", 30), (4, "", "en", "b", 0), (5, "7 8 9", "en", "c", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.limit(0)):
        for _, stage in cp.STAGES:
            assert stage(spark, table, SF).count() <= 3 * len(rows)
    assert sorted(r.doc_id or 0 for r in cp.keep_one_of_each(spark, docs, SF).collect()) == [0, 1, 2, 4, 5]


def test_null_and_repeated_ids_keep_their_texts(spark):
    texts = [f"text number {w} says that {w} and nothing but {w} is what it is about" for w in ("one", "two", "three", "four", "five")]
    rows = [(i, t, "en", "a", len(t or "")) for i, t in [(None, texts[0]), (None, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[2]), (7, texts[3]), (3, texts[4]), (7, texts[4]), (8, None), (8, ""), (9, " ")]]
    kept = cp.keep_one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), SF).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (3, texts[4]), (8, None), (8, ""), (9, " ")], key=str)


def test_mixed_documents_come_in_order_of_position(spark):
    # of 1200 words, a, b and c with weights 1, 2 and 3 get 200, 400 and 600: a quarter, twice and three times what they have
    rows = [(i, f"word{i} " * 20, "en", "a" * 40 + "b" * 10 + "c" * 10, 100) for i in range(60)]
    rows = [(i, text, lang, sources[i], n) for i, text, lang, sources, n in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mixed = cp.mix_sources(docs).collect()
    due = sorted((p, r.doc_id) for r in mixed if r["size"] for p in r.positions[: round(r.taken / r["size"])])
    out = cp.mix(spark, docs, SF).collect()
    assert [r.doc_id for r in out] == [d for _, d in due]
    times = collections.Counter(r.doc_id for r in out)
    assert all(times[i] == (2 if i < 50 else 3) for i in range(40, 60)) and sum(times[i] for i in range(40)) == 10
    assert {(r.doc_id, r.text) for r in out} <= {(r[0], r[1]) for r in rows}
    for r in mixed:
        assert r.positions == sorted(r.positions) and r.position == (r.positions or [None])[0] and r.last_position == (r.positions or [None])[-1]
        assert len(r.positions) == -(-r.taken // r["size"])
