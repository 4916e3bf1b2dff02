"""A corpus pipeline: toxicity, language, near-duplicates, mixing, encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; `docs` has the columns of documents and
is what the stage before kept. run() writes each stage's result as Parquet in the shared folder and reads
it again for the next, so a lost executor never costs more than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm.common import drop, materialise
from basalt.llm.language_id import fit_languages, identify
from basalt.llm.mixing import mix_sources
from basalt.llm.ngram_join import shingle_components
from basalt.llm.sentence_pieces import encode
from basalt.llm.toxicity import fit_toxicity, score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near-duplicates: words of a shingle, and percent of Jaccard similarity.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the model learns from the labels of the documents given.

    Null, empty and wordless texts stay, as clean ones do; rows with null ids are scored like others, repeated rows
    alike, long texts whole. Empty table: no rows. Columns of other names are dropped.
    """
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs.select(*COLUMNS), model, keep=tuple(COLUMNS)).where("predicted = 0").select(*COLUMNS)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters (null and empty ones too), and those unlike any learned language, go.

    Null languages and ids are no fault. Repeated rows fare alike, long texts are read whole. Empty table: no rows.
    """
    return identify(docs.select(*COLUMNS), fit_languages(docs), keep=tuple(COLUMNS)).where("accepted").select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays, one of the smallest doc_id, null last; of texts without words all.

    Rows are told apart by a 64-bit hash of id and text, so neither null nor repeated ids tie texts together. Fully
    equal rows leave one. Long texts are compared whole. Empty table: no rows.
    """
    keyed = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("key"))
    groups = shingle_components(keyed, SHINGLE_WORDS, SIMILAR_PERCENT, id_col="key").withColumnRenamed("doc_id", "key").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("first")
    kept = groups.join(keyed.select("key", "doc_id").distinct(), "key").groupBy("component_id").agg(first, F.max(F.col("n_shingles") == 0).alias("bare"))
    rows = keyed.join(kept.select("first.key", "bare"), "key")
    copies = rows.where(~F.col("bare")).dropDuplicates(["doc_id", "key"])
    return copies.union(rows.where("bare")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document appears as often as the mix takes it, in whole times, each at its position; one that isn't taken goes.

    Only hashes of the rows are mixed; texts join them once, and are sorted by position. Null ids and sources count as
    values; rows equal in all columns share their text. Long texts are joined whole. Empty table: no rows.
    """
    hashes = {"key_a": F.xxhash64(*COLUMNS), "key_b": F.xxhash64(F.lit("b"), *reversed(COLUMNS))}
    keyed = docs.select(*COLUMNS).withColumns(hashes)
    mixed = mix_sources(keyed, keep=tuple(hashes))
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    due = mixed.withColumn("times", times).where("times > 0").select(*hashes, F.explode(F.slice("positions", F.lit(1), F.col("times"))).alias("position"))
    return keyed.dropDuplicates(list(hashes)).join(due, list(hashes)).orderBy("position", "doc_id").select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_pieces, n_byte_pieces, ids_crc32, round_trip and the piece ids of every document.

    Null and empty texts have no ids; repeated rows come out as often. Empty table: no rows.
    """
    return encode(docs, keep=("doc_id", "source"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language ID", keep_known_languages),
    ("n-gram Jaccard join", keep_one_of_each),
    ("mixing sources", mix),
    ("SentencePiece encoding", encode_pieces),
]

#: The models of the stages can't be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    before = None
    for k, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"stage{k}")
        if before is not None:
            drop(before)
        before = docs
    return docs
