"""Text expressions: white space as Unicode has it, chunks, page text, templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: White space: Java's \s, the separators U+001C to U+001F, NEL, and all Unicode separators.
BLANKS = r"[\s\x1c-\x1f\x85\p{Z}]"
SOLID = r"[^\s\x1c-\x1f\x85\p{Z}]"


def normalise(text: Column) -> Column:
    """Every run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{BLANKS}+", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANKS}++|(?<!{BLANKS}){BLANKS}++$", "")


def is_blank(text: Column) -> Column:
    """Null, empty or nothing but white space."""
    return ~F.coalesce(text.rlike(SOLID), F.lit(False))


def chunk(docs: DataFrame, text: str = "text", source: str = "source_document", size: int = 1000, overlap: int = 200) -> DataFrame:
    """chunk_id, text, source_document, chunk_index: overlapping pieces of `size` characters of the normalised text.

    Pieces begin size - overlap apart; the last is the first that reaches the end. Pieces are trimmed, and
    a piece of nothing but white space is left out, its index used up. Blank texts have no pieces.
    """
    if size <= 0:
        raise ValueError("chunk size must be greater than zero")
    if overlap < 0:
        raise ValueError("chunk overlap cannot be negative")
    if overlap >= size:
        raise ValueError("chunk overlap must be smaller than chunk size")
    step = size - overlap
    plain = docs.select(F.col(source).alias("source_document"), normalise(F.col(text)).alias("whole")).where("whole <> ''")
    # one pass over the text: a match takes a step, and looks ahead for the whole piece
    pieces = F.regexp_extract_all("whole", F.lit(f"(?s)(?=(.{{1,{size}}})).{{1,{step}}}"), F.lit(1))
    last = F.greatest(F.lit(0), F.ceil((F.char_length("whole") - size) / step)).cast("int")
    plain = plain.select("source_document", F.slice(pieces, F.lit(1), last + 1).alias("pieces"))
    return plain.select("source_document", F.posexplode("pieces").alias("chunk_index", "piece")).withColumn("text", F.trim("piece")).where("text <> ''").select(
        F.concat_ws(":chunk:", "source_document", F.col("chunk_index").cast("string")).alias("chunk_id"), "text", "source_document", "chunk_index"
    )


def combine_pages(pages: DataFrame, key: str = "document_id") -> DataFrame:
    """key, combined: page texts stripped, blank ones dropped, in page order, joined by a blank line."""
    ordered = F.array_sort(F.collect_list(F.struct("page_number", strip(F.col("text")).alias("text"))))
    return pages.groupBy(key).agg(ordered.alias("pages")).select(key, F.array_join(F.filter(F.transform("pages", lambda p: p["text"]), lambda t: t != ""), "\n\n").alias("combined"))


def page_totals(pages: DataFrame, key: str = "document_id") -> DataFrame:
    """key, total_pages, total_characters (of the raw text), has_text (some page isn't blank)."""
    return pages.groupBy(key).agg(F.count(F.lit(1)).alias("total_pages"), F.coalesce(F.sum(F.char_length("text")), F.lit(0)).alias("total_characters"), F.bool_or(~is_blank(F.col("text"))).alias("has_text"))


def choose_text(native: DataFrame, ocr: DataFrame, key: str = "document_id") -> DataFrame:
    """key, extraction_method, combined: native text where it has any, else the text of OCR."""
    a = combine_pages(native, key).withColumnRenamed("combined", "native_text")
    b = combine_pages(ocr, key).withColumnRenamed("combined", "ocr_text")
    own = F.coalesce(F.col("native_text"), F.lit("")) != ""
    return a.join(b, key, "full").select(key, F.when(own, "NATIVE_PDF").otherwise("OCR").alias("extraction_method"), F.when(own, F.col("native_text")).otherwise(F.coalesce("ocr_text", F.lit(""))).alias("combined"))


# The labels of a block and of what is missing in it.
BLOCK, SOURCE, CHUNK, TEXT, MISSING = "[CONTEXT ", "]\nSource document: ", "\nChunk ID: ", "\nChunk text:\n", "unknown"


def context_blocks(hits: DataFrame, key: str = "query_id", order: tuple[str, ...] = ("distance", "chunk_id")) -> DataFrame:
    """key, context: hits as numbered blocks in order, joined by a blank line."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    block = F.concat(
        F.lit(BLOCK), F.col("nth").cast("string"), F.lit(SOURCE), F.coalesce("source_document", F.lit(MISSING)),
        F.lit(CHUNK), F.coalesce("chunk_id", F.lit(MISSING)), F.lit(TEXT), F.coalesce("text", F.lit("")),
    )
    return hits.withColumn("nth", nth).select(key, "nth", block.alias("block")).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "block"))), lambda b: b["block"]), "\n\n").alias("context"))


def is_pdf(path: Column) -> Column:
    return F.coalesce(F.lower(path).rlike(r"[^/]\.pdf$"), F.lit(False))


def status_label(status: Column) -> Column:
    return F.replace(F.coalesce(F.when(status != "", status), F.lit("UNKNOWN")), F.lit("_"), F.lit(" "))


def percent_label(confidence: Column) -> Column:
    return F.when(confidence.isNull(), "—").otherwise(F.concat(F.floor(confidence * 100 + 0.5).cast("string"), F.lit("%")))


def score_label(score: Column) -> Column:
    """A score with one decimal, by its exact binary value, ties up: its fraction times 2^59 is a whole number."""
    size = F.abs(score)
    whole = F.floor(size).cast("bigint")
    part = ((size - whole) * F.lit(float(1 << 59))).cast("bigint")
    tenths = whole * 10 + F.shiftright(part * 10 + F.lit(1 << 58), 59)
    sign = F.when((score < 0) & (tenths > 0), "-").otherwise("")
    return F.when(score.isNull(), "—").otherwise(F.concat(sign, F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string")))


# The tag of each status, by what it is the status of; other statuses get the last one.
TAGS = {
    "document": ({"COMPLETED": "tag success", "UPLOADED": "tag success", "PROCESSING": "tag warning", "PENDING": "tag warning", "FAILED": "tag error"}, "tag"),
    "extraction": ({"COMPLETED": "tag success", "PROCESSED": "tag success", "FAILED": "tag error", "PROCESSING": "tag warning"}, "tag pending"),
    "tender": ({"OPEN": "tag success", "ACTIVE": "tag success", "CLOSED": "tag", "COMPLETED": "tag"}, "tag warning"),
    "submission": ({"SUBMITTED": "tag success", "UNDER_REVIEW": "tag success", "REJECTED": "tag error", "DISQUALIFIED": "tag error"}, "tag warning"),
}
#: Whose statuses count without case.
ANY_CASE = ("tender", "submission")


def status_tag(kind: str, status: Column) -> Column:
    tags, rest = TAGS[kind]
    value = F.upper(status) if kind in ANY_CASE else status
    out = F.lit(rest)
    for name, tag in tags.items():
        out = F.when(value == name, tag).otherwise(out)
    return out


def date_label(at: Column, missing: str = "—", time: bool = False) -> Column:
    """Month, day and year, with time also hours, minutes and seconds; a null is `missing`."""
    return F.coalesce(F.date_format(at, "M/d/yyyy, h:mm:ss a" if time else "M/d/yyyy"), F.lit(missing))


def listing(rows: DataFrame, json: str, keep: tuple[str, ...]) -> DataFrame:
    """The `keep` columns, position, key and value (text) of every member of a JSON object. Null or other JSON: no rows."""
    return rows.select(*keep, F.posexplode(F.map_entries(F.from_json(json, "map<string,string>"))).alias("position", "entry")).select(*keep, "position", "entry.key", "entry.value")


def prompt(question: Column, context: Column, instruction: str) -> Column:
    """What a model is asked: what to do, the question, and the text to answer from."""
    return F.concat(F.lit(instruction + "\n\nQuestion:\n"), question, F.lit("\n\nText:\n"), context)


def score_class(score: Column) -> Column:
    return F.when(score.isNull(), "unknown").when(score >= 80, "good").when(score >= 60, "warning").otherwise("danger")


def risk_class(risk: Column) -> Column:
    low = F.lower(risk)
    return F.when(low.contains("low"), "low").when(low.contains("medium") | low.contains("moderate"), "medium").when(low.contains("high") | low.contains("critical"), "high").otherwise("unknown")
