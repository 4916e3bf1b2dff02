"""Models fitted in Spark on labelled rows: types of documents, and sentences that oblige.

Both are linear over hashed words and fitted by Spark's own logistic regression on all labelled rows but a fold, which is told by a
hash of the text. On that fold a temperature is fitted that makes the confidence a probability, and the limit is set below which
nothing is said. Tables of texts are small for the work in them, so rows are dealt out by letters before they are read into words
and before they are fitted, whatever files they come in.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.functions.text import is_blank, strip
from basalt.sources.shared import stored

UNKNOWN = "UNKNOWN"
FOLDS = 5
TEMPERATURES = tuple(round(0.25 * 1.2**k, 4) for k in range(20))
#: The limit of confidence is never above this.
SUREST = 0.9
#: Letters of a task, about: no more than the first, and no fewer than the second just to busy more cores.
MOST_LETTERS, FEW_LETTERS = 1 << 25, 1 << 20
#: Rows are multiplied in blocks of so many MB; each block costs a pass over all coefficients besides.
BLOCK_MB = 16.0


def held_out(text: str = "text") -> Column:
    return F.pmod(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), F.lit(FOLDS)) == 0


def terms(text: str) -> Column:
    """Words in lower case and pairs of neighbours."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    # a pair is looked ahead for at the beginning of each word
    return F.concat(F.array_remove(F.split(plain, " "), ""), F.regexp_extract_all(plain, F.lit("(?<![^ ])(?=([^ ]++ [^ ]++))[^ ]++"), F.lit(1)))


def tasks_for(spark: SparkSession, letters: int) -> int:
    """Tasks over which rows of so many letters in all are dealt: whole rounds of the cores, which have equal shares."""
    cores, few = spark.sparkContext.defaultParallelism, max(1, -(-letters // FEW_LETTERS))
    return few if few < cores else cores * -(-letters // (MOST_LETTERS * cores))


def featured(documents: DataFrame, text: str = "text", features: int = 1 << 16, column: str = "features") -> DataFrame:
    """documents with a column of hashed terms, for fit_types and classify with as many features; a null text has none."""
    rows = HashingTF(inputCol="__terms", outputCol=column, numFeatures=features, binary=True).transform(documents.drop(column).withColumn("__terms", terms(text)))
    return rows.drop("__terms")


def dealt(documents: DataFrame, text: str = "text") -> DataFrame:
    """documents, dealt over tasks by the letters of all texts."""
    return documents.repartition(tasks_for(documents.sparkSession, documents.agg(F.sum(F.char_length(text))).first()[0] or 0))


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is computed once, however often `then` or a lambda in it names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def scores(raw: str, temperature: float) -> Column:
    """Probabilities from a model's raw scores at a temperature, in work linear in the classes."""
    scaled = F.transform(vector_to_array(raw), lambda x: x / temperature)
    powers = bound(scaled, lambda v: bound(F.array_max(v), lambda most: F.transform(v, lambda x: F.exp(x - most))))
    return bound(powers, lambda v: bound(F.aggregate(v, F.lit(0.0), lambda s, y: s + y), lambda total: F.transform(v, lambda x: x / total)))


def temperature_of(rows: DataFrame) -> float:
    """The temperature at which the labels of rows (rawPrediction, label) are likeliest; 1 without rows."""
    rows = rows.select(bound(vector_to_array("rawPrediction"), lambda v: bound(F.array_max(v), lambda most: F.transform(v, lambda x: x - most))).alias("below"), (F.col("label").cast("int") + 1).alias("nth"))
    rows = rows.select("below", F.element_at("below", F.col("nth")).alias("own"))
    chance = lambda t: F.exp(F.col("own") / t) / F.aggregate("below", F.lit(0.0), lambda s, x: s + F.exp(x / t))
    row = rows.agg(*[F.avg(-F.log(chance(t) + 1e-12)).alias(f"t{k}") for k, t in enumerate(TEMPERATURES)]).first()
    return min((x, t) for x, t in zip(row, TEMPERATURES, strict=True))[1] if row[0] is not None else 1.0


def limit_of(right: DataFrame, kept: float) -> float:
    """The limit that the share `kept` of rows (p) reaches, SUREST at most; 0.5 without rows.

    Values above SUREST count as the least of them, so that the exact percentile keeps few: the limit is the same.
    """
    above = right.agg(F.min(F.when(F.col("p") >= SUREST, F.col("p")))).first()[0]
    sure = right.agg(F.percentile(F.least("p", F.lit(above).cast("double")), F.lit(1 - kept))).first()[0]
    return min(SUREST, sure) if sure is not None else 0.5


@dataclass(frozen=True)
class TypeModel:
    """Types of documents by hashed words. Confidence is a probability; below `limit` the type is UNKNOWN."""

    linear: LogisticRegressionModel
    types: tuple[str, ...]
    features: int
    temperature: float
    limit: float

    def scored(self, documents: DataFrame, text: str = "text", vectors: str | None = None) -> DataFrame:
        rows = documents.withColumn("__features", F.col(vectors)) if vectors else featured(documents, text, self.features, "__features")
        rows = self.linear.transform(rows).withColumn("__p", scores("__raw", self.temperature))
        best = F.array_max("__p")
        named = F.element_at(F.array(*[F.lit(t) for t in self.types]), F.array_position("__p", best).cast("int"))
        return rows.withColumns({"__best": best, "__type": named}).drop("__features", "__raw", "__probability", "__prediction", "__p")

    def classify(self, documents: DataFrame, text: str = "text", vectors: str | None = None) -> DataFrame:
        """documents with document_type, confidence and error, as providers.classify gives them: a blank text is an error.

        Ties go to the type that comes first. Empty table: no rows. Columns of those names are replaced. `vectors` is the column
        that featured() made of the text, if it has been.
        """
        rows = self.scored(documents.drop("document_type", "confidence", "error"), text, vectors).withColumn("__blank", is_blank(F.col(text)))
        kind = F.when(F.col("__best") < self.limit, UNKNOWN).otherwise(F.col("__type"))
        told = {"error": F.when(F.col("__blank"), "text cannot be empty"), "document_type": F.when(~F.col("__blank"), kind), "confidence": F.when(~F.col("__blank"), F.col("__best"))}
        return rows.withColumns(told).drop("__best", "__type", "__blank")


def fit_types(labelled: DataFrame, text: str = "text", label: str = "document_type", features: int = 1 << 16, kept: float = 0.99, vectors: str | None = None) -> TypeModel:
    """A model of labelled documents, null labels and blank texts left out. UNKNOWN may be a label like others: of documents of no type.

    The limit lets the share `kept` of held-back documents that are named rightly pass. A label of few rows is learned
    as far as they go; with a single label everything is of that. Without any labelled document: an error. `vectors` is the column
    that featured() made of the text, with as many features, in a table that is read several times.
    """
    spark = labelled.sparkSession
    rows = labelled.where(F.col(label).isNotNull() & ~is_blank(F.col(text)))
    told = rows.groupBy(F.col(label).alias("type")).agg(F.sum(F.char_length(text)).alias("letters")).orderBy("type").collect()  # a row a type
    types = tuple(r.type for r in told)
    if not types:
        raise ValueError("there are no labelled documents to learn from")
    tasks = tasks_for(spark, sum(r.letters for r in told))
    if not vectors:
        rows = featured(rows.select(F.col(text).alias("text"), F.col(label).alias("document_type")).repartition(tasks), "text", features, "__features")
        text, label = "text", "document_type"
    rows = rows.select(F.col(vectors or "__features").alias("__features"), held_out(text).alias("held_out"), (F.array_position(F.array(*[F.lit(t) for t in types]), F.col(label)) - 1).cast("double").alias("label"))
    rows = rows if vectors else stored(rows, "features")
    fitted = rows.where("not held_out")
    fitted = rows if fitted.isEmpty() else fitted
    linear = LogisticRegression(featuresCol="__features", labelCol="label", rawPredictionCol="__raw", probabilityCol="__probability", predictionCol="__prediction", family="multinomial", regParam=0.001, maxIter=60, maxBlockSizeInMB=BLOCK_MB).fit(fitted.select("__features", "label").repartition(tasks))
    back = linear.transform(rows.where("held_out")).where(F.col("label") < linear.numClasses).select(F.col("__raw").alias("rawPrediction"), "label", "__prediction")
    back = stored(back, "judged")
    temperature = temperature_of(back)
    limit = limit_of(back.where(F.col("__prediction") == F.col("label")).select(F.array_max(scores("rawPrediction", temperature)).alias("p")), kept)
    return TypeModel(linear, types, features, temperature, limit)


# Abbreviations that don't end a sentence.
ABBREVIATIONS = ("No", "Nos", "Rs", "Dr", "Mr", "Mrs", "Ms", "M/s", "Sr", "St", "Fig", "Sec", "Cl", "Art", "Para", "viz", "vs", "etc", "e\\.g", "i\\.e", "approx", "cf", "Ltd", "Pvt", "Co", "Inc", "Govt", "Dept", "Ref")
#: What begins an item of a list: 1. 1.2 1) (a) (iv) - *
ITEM = r"(?:\d{1,3}(?:\.\d{1,3})*[.)]|\([0-9a-z]{1,4}\)|[-*•])\s"
#: Ends of sentences: marks before white space and a beginning, blank lines, and lines that begin an item.
ENDS = rf"(?<=[.!?;])(?<!\b(?:{'|'.join(ABBREVIATIONS)})\.)(?<!(?:^|[\s(])(?:\d{{1,3}}|[A-Za-z])\.)\s+(?=[\p{{Lu}}\p{{N}}(\[\"'“‘])|\s*\n\s*\n\s*|\s*\n\s*(?={ITEM})"


def sentences(text: Column) -> Column:
    """The sentences of a text, which abbreviations, numbers and initials don't end; an item of a list is one. Null: null."""
    return F.filter(F.transform(F.split(text, ENDS), strip), lambda s: s != "")


CUES = (r"\b(?:must|shall|mandatory|required|requires?|obliged|obligated)\b", r"\b(?:should|ought|needs? to|ha(?:s|ve) to|is to|are to)\b", r"\b(?:may|can|could|might|optional)\b", r"\b(?:not|no|never)\b", r"\d", r"\?\s*$", r"\b(?:bidder|tenderer|applicant|contractor|supplier|vendor|firm)s?\b", rf"^{ITEM}")


def sentence_features(sentence: str, nth: str, n: str) -> list[Column]:
    """Cues, length and place in the text, each about 0 to 1."""
    low = F.lower(F.col(sentence))
    return [*[F.when(low.rlike(c), 1.0).otherwise(0.0) for c in CUES], F.least(F.lit(1.0), F.char_length(sentence) / 300), F.col(nth) / F.greatest(F.col(n), F.lit(1)), F.when(F.col(nth) == 0, 1.0).otherwise(0.0)]


@dataclass(frozen=True)
class SentenceModel:
    """Whether a sentence states a requirement, by hashed words, cues and place."""

    linear: LogisticRegressionModel
    features: int
    temperature: float
    limit: float

    def scored(self, rows: DataFrame) -> DataFrame:
        """rows (description, ordinal, n_sentences) with score, a probability."""
        out = self.linear.transform(vectors(rows, self.features))
        return out.withColumn("score", F.element_at(scores("__raw", self.temperature), 2)).drop("__terms", "__words", "__cues", "__features", "__raw", "__probability", "__prediction")

    def extract(self, chunks: DataFrame) -> DataFrame:
        """chunk_id, source_document, ordinal, description, score of the sentences of chunks that state requirements. Blank and null texts have none."""
        rows = chunks.select("chunk_id", "source_document", sentences(F.col("text")).alias("s"))
        rows = rows.select("chunk_id", "source_document", F.size("s").alias("n_sentences"), F.posexplode("s").alias("ordinal", "description"))
        return self.scored(rows).where(F.col("score") >= self.limit).select("chunk_id", "source_document", "ordinal", "description", "score")


def vectors(rows: DataFrame, features: int) -> DataFrame:
    rows = rows.withColumns({"__terms": terms("description"), "__cues": array_to_vector(F.array(*sentence_features("description", "ordinal", "n_sentences")))})
    rows = HashingTF(inputCol="__terms", outputCol="__words", numFeatures=features, binary=True).transform(rows)
    return VectorAssembler(inputCols=["__words", "__cues"], outputCol="__features").transform(rows)


def fit_sentences(labelled: DataFrame, features: int = 1 << 14) -> tuple[SentenceModel, DataFrame]:
    """(a model of rows (description, ordinal, n_sentences, is_requirement); precision, recall, n on the fold held back).

    The limit is the one of 0.05, 0.1 ... 0.95 with the best F1 on that fold, of equal ones the nearest to 0.5. Null labels and
    sentences are left out; without both labels: an error.
    """
    rows = labelled.where("is_requirement is not null and description is not null").select("description", "ordinal", "n_sentences", F.col("is_requirement").cast("double").alias("label"), held_out("description").alias("held_out"))
    rows = stored(rows, "sentences")
    if rows.select("label").distinct().count() < 2:
        raise ValueError("sentences of both kinds are needed to learn from")
    linear = LogisticRegression(featuresCol="__features", labelCol="label", rawPredictionCol="__raw", probabilityCol="__probability", predictionCol="__prediction", family="multinomial", regParam=0.002, maxIter=60).fit(vectors(rows.where("not held_out"), features))
    back = linear.transform(vectors(rows.where("held_out"), features))
    temperature = temperature_of(back.withColumnRenamed("__raw", "rawPrediction"))
    judged = stored(SentenceModel(linear, features, temperature, 0.5).scored(rows.where("held_out")).select("label", "score"), "judged")
    limits = [round(0.05 * k, 2) for k in range(1, 20)]
    hits = judged.agg(F.sum("label").alias("all"), F.count(F.lit(1)).alias("n"), *[x for k, v in enumerate(limits) for x in (F.count_if(F.col("score") >= v).alias(f"n{k}"), F.sum(F.when(F.col("score") >= v, F.col("label")).otherwise(0.0)).alias(f"h{k}"))]).first()
    f1 = {v: 2 * (hits[f"h{k}"] or 0) / max(1, (hits["all"] or 0) + hits[f"n{k}"]) for k, v in enumerate(limits)}
    limit = min(f1, key=lambda v: (-f1[v], abs(v - 0.5)))
    told = judged.where(F.col("score") >= limit).agg(F.avg("label").alias("precision"), F.sum("label").alias("hits")).crossJoin(judged.agg(F.sum("label").alias("all"), F.count(F.lit(1)).alias("n")))  # a row each
    return SentenceModel(linear, features, temperature, limit), told.select("precision", (F.col("hits") / F.col("all")).alias("recall"), "n")
