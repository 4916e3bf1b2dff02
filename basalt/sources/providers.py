"""Providers: what reads files, embeds and extracts. Each has a deterministic default; others plug in.

A provider takes a DataFrame and returns one, so that a model, an OCR engine or a remote service can stand
in for a default by mapInPandas, with one client for each partition.
"""

from __future__ import annotations

import functools
import hashlib
import importlib.util
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.functions.text import is_blank, is_pdf, normalise
from basalt.schemas import RECORD_FIELDS
from basalt.sources import pdf

# Words that tell document types and requirement types, and the patterns of fields.
DOCUMENT_WORDS = {
    "GST_CERTIFICATE": ("gstin", "goods and services tax", "gst registration"),
    "UDYAM_CERTIFICATE": ("udyam", "msme", "enterprise name"),
    "INCOME_TAX": ("income tax return", "assessment year", "acknowledgement number"),
    "PAN": ("permanent account number", "pan card"),
}
REQUIREMENT_WORDS = {"GST": r"\bgst", "UDYAM": r"\budyam|\bmsme", "INCOME_TAX": r"income.tax", "PAN": r"\bpan\b", "EPFO": r"\bepfo?\b|provident fund", "ESIC": r"\besic?\b", "EXPERIENCE": r"experience", "FINANCIAL": r"turnover|net worth", "BLACKLISTING": r"blacklist|debar"}
FIELD_PATTERNS = {
    "gstin": r"\b(\d{2}[A-Z]{5}\d{4}[A-Z][0-9A-Z]Z[0-9A-Z])\b", "udyam_number": r"\b(UDYAM-[A-Z]{2}-\d{2}-\d{7})\b", "pan_number": r"\b([A-Z]{5}\d{4}[A-Z])\b",
    "assessment_year": r"\b(\d{4}-\d{2})\b", "acknowledgement_number": r"\b(\d{15})\b",
    "legal_name": r"(?i)\blegal name[ :]+([^\n]+)", "trade_name": r"(?i)\btrade name[ :]+([^\n]+)", "registration_date": r"(?i)\bdate of registration[ :]+(\d{1,2}[-/.]\d{1,2}[-/.]\d{4})", "status": r"(?i)\bstatus[ :]+(active|inactive|cancelled|suspended)\b",
    "enterprise_name": r"(?i)\bname of enterprise[ :]+([^\n]+)", "organisation_type": r"(?i)\btype of organi[sz]ation[ :]+([^\n]+)", "major_activity": r"(?i)\bmajor activity[ :]+([^\n]+)", "name": r"(?i)\bname[ :]+([^\n]+)",
    "date_of_birth_or_incorporation": r"(?i)\bdate of (?:birth|incorporation)[ :]+(\d{1,2}[-/.]\d{1,2}[-/.]\d{4})", "filing_date": r"(?i)\bdate of filing[ :]+(\d{1,2}[-/.]\d{1,2}[-/.]\d{4})",
    "gross_total_income": r"(?i)\bgross total income[ :]+([0-9][0-9,.]*)", "total_income": r"(?i)(?:^|\n)total income[ :]+([0-9][0-9,.]*)",
}


def classify(documents: DataFrame, text: str = "text") -> DataFrame:
    """documents with document_type and confidence: the type with most of its words in the text, UNKNOWN without any.

    A blank text gives an error instead. A default that stands in for a model: the confidence is the share of three
    words found, no probability. The text is lower-cased once and each word looked for once.
    """
    rows = documents.withColumn("__low", F.lower(F.col(text)))
    rows = rows.withColumns({f"__{kind}": sum((F.col("__low").contains(w).cast("int") for w in words), F.lit(0)) for kind, words in DOCUMENT_WORDS.items()})
    rows = rows.withColumns({"__best": F.greatest(*[f"__{kind}" for kind in DOCUMENT_WORDS]), "__blank": is_blank(F.col(text))})
    kind = F.lit("UNKNOWN")
    for name in reversed(DOCUMENT_WORDS):
        kind = F.when((F.col(f"__{name}") == F.col("__best")) & (F.col("__best") > 0), name).otherwise(kind)
    blank, share = F.col("__blank"), F.when(F.col("__best") > 0, F.col("__best") / F.lit(3)).otherwise(0.0)
    rows = rows.withColumns({"error": F.when(blank, "text cannot be empty"), "document_type": F.when(~blank, kind), "confidence": F.when(~blank, share)})
    return rows.drop("__low", "__best", "__blank", *[f"__{kind}" for kind in DOCUMENT_WORDS])


def extract_fields(documents: DataFrame, text: str = "text") -> DataFrame:
    """documents with the fields that patterns find, null where they find nothing."""
    return documents.withColumns({name: F.nullif(F.regexp_extract(F.col(text), pattern, 1), F.lit("")) for name, pattern in FIELD_PATTERNS.items()})


def extract_requirements(chunks: DataFrame) -> DataFrame:
    """A row for each sentence of chunks that obliges: type by its words, name, whether it is mandatory, source.

    A default that stands in for a model. The name is the sentence, or if it is longer than the column allows its
    beginning and a digest of the whole, so that different sentences have different names.
    """
    sentences = F.split(F.col("text"), r"(?<=[.!?;])\s+")
    rows = chunks.select("chunk_id", "source_document", F.posexplode(sentences).alias("ordinal", "description"))
    rows = rows.where(F.lower("description").rlike(r"\b(must|shall|should|required|mandatory)\b"))
    kind: Column = F.lit("OTHER")
    plain = normalise(F.col("description"))
    for name in reversed(REQUIREMENT_WORDS):
        kind = F.when(F.lower("description").rlike(REQUIREMENT_WORDS[name]), name).otherwise(kind)
    return rows.select("source_document", "chunk_id", "ordinal", kind.alias("requirement_type"), F.when(F.char_length(plain) <= 255, plain).otherwise(F.concat(F.substring(plain, 1, 222), F.lit(" "), F.md5(plain))).alias("requirement_name"), "description", F.lower("description").rlike(r"\b(must|shall|required|mandatory)\b").alias("is_required"))


@functools.lru_cache(1 << 20)
def code_of(word: str) -> int:
    return int(hashlib.md5(word.encode(), usedforsecurity=False).hexdigest()[:8], 16)


def embed(rows: DataFrame, text: str = "text", dim: int = 64) -> DataFrame:
    """rows with embedding: words hashed with signs into three of `dim` places each, scaled to length one. Blank texts embed as null."""

    @F.arrow_udf("array<float>")
    def hashed(texts: pa.Array) -> pa.Array:
        words = pc.split_pattern(texts, " ")
        told = words.flatten().dictionary_encode()
        codes = np.array([code_of(w) for w in told.dictionary.to_pylist()], np.int64)[told.indices.to_numpy()] if len(told) else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(texts)), pc.list_value_length(words).to_numpy())
        codes, row = (x[pc.not_equal(told.cast(pa.string()), "").to_numpy(zero_copy_only=False)] for x in (codes, row))
        sums = sum(np.bincount(row * dim + (codes >> k) % dim, np.where(codes >> k + 9 & 1, 1.0, -1.0), len(texts) * dim) for k in (0, 10, 20)).reshape(-1, dim)
        length = np.sqrt((sums * sums).sum(1))
        scaled = (sums / np.where(length > 0, length, 1.0)[:, None]).astype(np.float32)
        return pa.ListArray.from_arrays(np.arange(0, (len(texts) + 1) * dim, dim, dtype=np.int32), scaled.ravel(), mask=pa.array(length == 0))

    return rows.withColumn("embedding", hashed(F.coalesce(F.lower(normalise(F.col(text))), F.lit(""))))


# What a record's fields hold, for the schema of a model's reply.
FIELD_NOTES = {"confidence": "how sure the reading is, from 0 to 1"}


def reply_schema(document_type: str) -> dict:
    """JSON schema of a reply about a document of that type: its fields as text or null, and a confidence from 0 to 1."""
    if document_type not in RECORD_FIELDS:
        raise ValueError(f"unsupported document type: {document_type}")
    fields = {f: {"type": ["string", "null"]} for f in RECORD_FIELDS[document_type]}
    return {"type": "object", "properties": {"fields": {"type": "object", "properties": fields, "additionalProperties": False}, "confidence": {"type": "number", "minimum": 0, "maximum": 1, "description": FIELD_NOTES["confidence"]}}, "required": ["fields", "confidence"], "additionalProperties": False}


def instruction(document_type: str) -> str:
    """What a model is told to do with a document of that type."""
    if document_type not in RECORD_FIELDS:
        raise ValueError(f"unsupported document type: {document_type}")
    return f"Read the {document_type} below and give its fields: {', '.join(RECORD_FIELDS[document_type])}. Leave out what it doesn't say. Reply in JSON with fields and confidence."


def page_faults(paths: DataFrame, files: DataFrame) -> DataFrame:
    """paths (path) with fault: not found, not a file, or no .pdf; null if it can be read. files: path, is_file."""
    known = files.select("path", "is_file").dropDuplicates(["path"]).withColumn("__there", F.lit(True))
    fault = F.when(F.col("__there").isNull(), F.concat(F.lit("PDF file not found: "), "path")).when(~F.col("is_file"), F.concat(F.lit("PDF path is not a file: "), "path")).when(~is_pdf(F.col("path")), "File must have a .pdf extension.")
    return paths.join(known, "path", "left").withColumn("fault", fault).drop("is_file", "__there")


PAGE_SCHEMA = "path string, page_number int, text string, error string"


def pdf_pages(spark: SparkSession, path: str, dpi: int | None = None, language: str = "eng") -> DataFrame:
    """path, page_number (from 1), text, error for every page of the PDFs under path; with dpi, by OCR.

    Files that can't be opened give a row with the error. Text is read natively; the libraries that OCR needs are optional.
    """
    if dpi is not None and dpi <= 0:
        raise ValueError("DPI must be greater than zero")
    if not language.strip():
        raise ValueError("OCR language cannot be empty")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", "true").load(path).select("path", "content")
    if dpi is None:
        return pdf.pages(files)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        has = importlib.util.find_spec("fitz")
        for batch in batches:
            out = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    if not has:
                        raise RuntimeError("no PDF library is installed")
                    out += [(name, k + 1, t, None) for k, t in enumerate(page_texts(content, dpi, language))]
                except Exception as e:  # a broken file is a row, not the end of the job
                    out.append((name, None, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "page_number", "text", "error"]).astype({"page_number": "Int32"})

    return files.mapInPandas(read, PAGE_SCHEMA)


def page_texts(content: bytes, dpi: int, language: str) -> list[str]:
    import fitz

    with fitz.open(stream=content, filetype="pdf") as file:
        import pytesseract
        from PIL import Image

        out = []
        for page in file:
            picture = page.get_pixmap(matrix=fitz.Matrix(dpi / 72, dpi / 72), alpha=False)
            out.append(pytesseract.image_to_string(Image.frombytes("RGB", (picture.width, picture.height), picture.samples), lang=language))
        return out
