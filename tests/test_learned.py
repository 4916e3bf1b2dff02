import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from basalt.operators import learned as ln
from basalt.plans import made
from basalt.plans import pipelines as pl


@pytest.fixture(scope="module")
def certificates(spark):
    customers = spark.range(600).select("id", F.concat(F.lit("Firm "), F.md5(F.col("id").cast("string"))).alias("name"), F.col("id").cast("string").alias("phone"))
    others = spark.range(600).select("id", F.concat_ws(" ", *[F.substring(F.sha2(F.concat("id", F.lit(str(k))), 256), 1, 3 + k % 5) for k in range(12)]).alias("text"))
    return made.certificates(customers, others)


def test_types_are_named_rejected_and_calibrated(spark, certificates):
    # a tenth of the labels is wrong: the confidence must say so
    kinds = ["GST_CERTIFICATE", "UDYAM_CERTIFICATE", "INCOME_TAX", "PAN", "UNKNOWN"]
    wrong = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.pmod(F.xxhash64("text"), F.lit(5)) + 1).cast("int"))
    noisy = certificates.withColumns({"truth": F.col("document_type"), "document_type": F.when(F.rand(3) < 0.1, wrong).otherwise(F.col("document_type"))})
    noisy.cache()
    model = ln.fit_types(noisy, features=1 << 12)
    out = model.scored(noisy.where(ln.held_out()))
    row = out.agg(F.avg((F.col("__type") == F.col("truth")).cast("double")), F.avg((F.col("__type") == F.col("document_type")).cast("double")), F.avg("__best")).first()
    assert row[0] > 0.95 and abs(row[1] - row[2]) < 0.06
    rows = spark.createDataFrame([(1, None), (2, " \n"), (3, "Registration certificate under the goods and services tax act. Legal name Firm x Constitution of business: partnership. GSTIN 5"), (4, "PAN card of goods and Udyam return act")], "id int, text string").withColumn("confidence", F.lit("clash"))
    got = {r.id: r for r in model.classify(rows).collect()}
    assert [got[k].error for k in (1, 2, 3, 4)] == ["text cannot be empty"] * 2 + [None] * 2
    assert got[1].document_type is None and got[3].document_type == "GST_CERTIFICATE" and 0 <= got[4].confidence <= 1
    assert (got[4].document_type == "UNKNOWN") or got[4].confidence >= model.limit
    assert model.classify(rows.limit(0)).count() == 0


def test_a_trained_provider_in_the_pipeline(spark, certificates):
    model = ln.fit_types(certificates, features=1 << 12)
    pages = spark.createDataFrame([(1, 1, "Permanent account number card.\nName A ABCDE1234F Signature below."), (2, 1, "zz9 yy8 xx7")], "document_id int, page_number int, text string")
    out = {r.document_id: r for r in pl.process_documents(pages, pages.limit(0), classify=model.classify).collect()}
    assert out[1].extraction_status == "COMPLETED" and "ABCDE1234F" in out[1].extracted_data
    assert out[2].extraction_status == "FAILED" and "unsupported" in out[2].error_message


def test_labels_that_are_missing(spark):
    rows = spark.createDataFrame([("a b", None), (" ", "X"), (None, "X")], "text string, document_type string")
    with pytest.raises(ValueError, match="labelled"):
        ln.fit_types(rows)
    with pytest.raises(ValueError, match="both kinds"):
        ln.fit_sentences(spark.createDataFrame([("a", 0, 1, True), ("b", 0, 1, None), (None, 0, 1, False)], "description string, ordinal int, n_sentences int, is_requirement boolean"))


TERMS = {
    "One two, THREE!": ["one", "two", "three", "one two", "two three"],
    " a.b\tc\n12,5 ": ["a", "b", "c", "12", "5", "a b", "b c", "c 12", "12 5"],
    "Ünï-çødé 漢字 x": ["ünï", "çødé", "漢字", "x", "ünï çødé", "çødé 漢字", "漢字 x"],
    "same same same": ["same", "same", "same", "same same", "same same"],
    "alone": ["alone"], "": [], " . ": [], None: [],
}


def test_terms(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(TERMS)], "k int, text string").select("k", ln.terms("text").alias("t")).collect()
    assert {r.k: r.t for r in rows} == dict(enumerate(TERMS.values()))


def raw_scores(spark, rows):
    return spark.createDataFrame([([float(x) for x in v], float(n)) for v, n in rows], "v array<double>, label double").select(array_to_vector("v").alias("rawPrediction"), "label").coalesce(1)


def test_scores_read_the_raw_ones_once(spark):
    rng = np.random.default_rng(2)
    raw = rng.normal(0, 4, (50, 7))
    label = [int(rng.choice(7, p=np.exp(r / 2) / np.exp(r / 2).sum())) for r in raw]
    rows = raw_scores(spark, zip(raw, label, strict=True))
    powers = lambda t: np.exp((raw - raw.max(1, keepdims=True)) / t)
    got = rows.select(ln.scores("rawPrediction", 1.7).alias("p"))
    assert np.allclose([r.p for r in got.collect()], powers(1.7) / powers(1.7).sum(1, keepdims=True), atol=1e-12)
    # named in a lambda of each class, the raw scores would be read, and all powers made, anew for each class
    assert got._jdf.queryExecution().analyzed().toString().count("UDF(rawPrediction") == 1
    loss = {t: np.mean([-np.log(p[n] / p.sum() + 1e-12) for p, n in zip(powers(t), label, strict=True)]) for t in ln.TEMPERATURES}
    assert ln.temperature_of(rows) == min(loss, key=loss.get) and ln.temperature_of(rows.limit(0)) == 1.0


@pytest.mark.parametrize("values", [[], [0.3], [0.95], [0.2, 0.99], [0.5, 0.91, 0.92, 0.93], [0.1] * 3 + [0.9] * 97, [k / 200 for k in range(201)], [0.91 + k / 10000 for k in range(300)]])
def test_the_limit_is_that_of_all_values(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "p double")
    for kept in (0.5, 0.9, 0.99):
        want = rows.agg(F.percentile("p", F.lit(1 - kept))).first()[0]
        assert ln.limit_of(rows, kept) == (pytest.approx(min(0.9, want), abs=1e-12) if values else 0.5)


def test_rows_of_one_file_are_dealt_and_features_are_made_once(spark, monkeypatch):
    words = F.concat_ws(" ", F.when(F.col("id") % 2 == 0, "even").otherwise("odd"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4000)), lambda k: F.md5(F.concat("id", k.cast("string"))).substr(1, 9)), " "))
    rows = spark.range(80).select(words.alias("text"), F.when(F.col("id") % 2 == 0, "X").otherwise("Y").alias("document_type")).coalesce(1)
    parts, keep = {}, ln.stored
    monkeypatch.setattr(ln, "stored", lambda df, name: parts.update({name: df.rdd.getNumPartitions()}) or keep(df, name))
    model = ln.fit_types(rows, features=1 << 10)
    assert parts["features"] >= 3  # 3.2 million letters, one file: a single task read and fitted them all
    table = keep(ln.featured(ln.dealt(rows), features=1 << 10), "rows")
    again = ln.fit_types(table, features=1 << 10, vectors="features")
    assert (again.types, again.temperature, again.limit) == (model.types, model.temperature, pytest.approx(model.limit, abs=1e-3))
    told = lambda out: sorted((r.text, r.document_type, round(r.confidence, 2)) for r in out.select("text", "document_type", "confidence").collect())
    assert told(again.classify(table, vectors="features")) == told(again.classify(rows)) and "features" in again.classify(table, vectors="features").columns


CASES = {
    "The bidder shall pay Rs. 500 to M/s. Rao & Co. by post. Dr. A. K. Sen signs (cf. Sec. 4). Is it so? Yes; No more.": ["The bidder shall pay Rs. 500 to M/s. Rao & Co. by post.", "Dr. A. K. Sen signs (cf. Sec. 4).", "Is it so?", "Yes;", "No more."],
    "Terms:\n1. Hold GST.\n2. Have e.g. PAN 3.5 years\n(a) first\n - second\n\nNext part": ["Terms:", "1. Hold GST.", "2. Have e.g. PAN 3.5 years", "(a) first", "- second", "Next part"],
    "no capital follows. it goes on. 12 do": ["no capital follows. it goes on.", "12 do"],
    "": [], " \n ": [], None: None,
}


def test_sentence_boundaries(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(CASES)], "k int, t string").select("k", ln.sentences(F.col("t")).alias("s")).collect()
    assert {r.k: r.s for r in rows} == dict(enumerate(CASES.values()))


def test_sentences_that_oblige(spark):
    names = spark.range(1500).select("id", F.substring(F.md5(F.col("id").cast("string")), 1, 6).alias("name"))
    model, told = ln.fit_sentences(made.tender_sentences(names), features=1 << 12)
    row = told.first()
    assert row.precision > 0.95 and row.recall > 0.95 and row.n > 200
    rng = random.Random(1)
    good = [f"The bidder {v} furnish an audited statement on zinc." for v in ("must", "shall", "needs to")]
    bad = ["The office will pay for the colours of zinc.", "The committee may publish a catalogue of 12 parts."]
    both = good + bad
    rng.shuffle(both)
    chunks = spark.createDataFrame([("c1", "s", " ".join(both)), ("c2", "s", None), ("c3", "s", " ")], "chunk_id string, source_document string, text string")
    out = model.extract(chunks).orderBy("ordinal").collect()
    assert [r.description for r in out] == [s for s in both if s in good] and all(r.chunk_id == "c1" and model.limit <= r.score <= 1 for r in out)
