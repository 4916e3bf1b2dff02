"""PDF files made of texts of the tables, for queries and tests that read them back."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def text_object(text: str, codes: dict[str, int]) -> bytes:
    shown = [b"<" + b"".join(b"%04X" % codes[c] for c in line) + b"> Tj" for line in text.split("\n")]
    return b"BT /F1 10 Tf 12 TL 72 720 Td\n" + b" T*\n".join(shown) + b"\nET"


def unicode_map(codes: dict[str, int]) -> bytes:
    pairs = [b"<%04X> <%s>" % (n, c.encode("utf-16-be").hex().encode()) for c, n in codes.items()]
    blocks = [b"%d beginbfchar\n%s\nendbfchar" % (len(pairs[a : a + 100]), b"\n".join(pairs[a : a + 100])) for a in range(0, len(pairs), 100)]
    return b"begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange\n" + b"\n".join(blocks) + b"\nendcmap"


def flate(data: bytes, more: bytes = b"") -> bytes:
    packed = zlib.compress(data)
    return b"<< /Filter /FlateDecode /Length %d %s>>\nstream\n%s\nendstream" % (len(packed), more, packed)


def pdf_of(pages: list[str], packed: bool = False) -> bytes:
    """A PDF with a page for each text, line by line; `packed` puts its objects in an object stream and its offsets in a stream."""
    codes = {c: n for n, c in enumerate(sorted({c for text in pages for c in text if c != "\n"}), 1)}
    kids = [6 + 2 * k for k in range(len(pages))]
    plain = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        2: b"<< /Type /Pages /Kids [%s] /Count %d /Resources << /Font << /F1 3 0 R >> >> >>" % (b" ".join(b"%d 0 R" % k for k in kids), len(kids)),
        3: b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode 4 0 R /DescendantFonts [] >>",
        **{k: b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (k + 1) for k in kids},
    }
    streams = {4: flate(unicode_map(codes)), **{k + 1: flate(text_object(text, codes)) for k, text in zip(kids, pages, strict=True)}}
    size = 6 + 2 * len(pages)
    out, at, within = bytearray(b"%PDF-1.7\n"), {}, {}
    if packed:
        bodies = list(plain.items())
        offsets, body = [], b""
        for n, x in bodies:
            offsets.append(b"%d %d" % (n, len(body)))
            body += x + b" "
        head = b" ".join(offsets) + b" "
        streams[5] = flate(head + body, b"/Type /ObjStm /N %d /First %d " % (len(bodies), len(head)))
        within = {n: k for k, (n, _) in enumerate(bodies)}
        plain = {}
    for n, x in sorted((plain | streams).items()):
        at[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, x)
    start = len(out)
    if packed:
        at[size] = start
        rows = [b"\x01" + at[n].to_bytes(4, "big") + b"\0\0" if n in at else b"\x02" + (5).to_bytes(4, "big") + within[n].to_bytes(2, "big") if n in within else bytes(7) for n in range(size + 1)]
        above, lines = bytes(7), []
        for row in rows:  # the PNG filter that most writers use: differences to the row above
            lines.append(b"\x02" + bytes((a - b) & 255 for a, b in zip(row, above, strict=True)))
            above = row
        out += b"%d 0 obj\n%s\nendobj\n" % (size, flate(b"".join(lines), b"/Type /XRef /Size %d /W [1 4 2] /Root 1 0 R /DecodeParms << /Predictor 12 /Columns 7 >> " % (size + 1)))
    else:
        out += b"xref\n0 %d\n" % size + b"".join(b"%010d 00000 n \n" % at[n] if n in at else b"0000000000 65535 f \n" for n in range(size)) + b"trailer << /Size %d /Root 1 0 R >>\n" % size
    return bytes(out) + b"startxref\n%d\n%%%%EOF\n" % start


def pdf_files(pages: DataFrame) -> DataFrame:
    """path, content: a PDF for each document of pages (document_id, page_number, text); every other one is packed."""
    told = pages.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "text"))).alias("pages"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [pdf_of([p["text"] for p in x.as_py()], n.as_py() % 2 == 0) for n, x in zip(batch.column(0), batch.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([f"document{n}.pdf" for n in batch.column(0)]), pa.array(made, pa.binary())], names=["path", "content"])

    return told.mapInArrow(run, "path string, content binary")


def certificates(customers: DataFrame, others: DataFrame) -> DataFrame:
    """id, document_type, text: certificates made of customers (id, name, phone: any text), of four types, and other texts (id, text) of none.

    The wording varies by a hash of the id, so that no single word tells a type.
    """
    nth = lambda n, m: F.pmod(F.xxhash64("id", F.lit(n)), F.lit(m))
    pick = lambda n, *of: F.element_at(F.array(*[F.lit(x) for x in of]), (nth(n, len(of)) + 1).cast("int"))
    bodies = {
        "GST_CERTIFICATE": F.concat_ws(" ", pick(1, "Registration certificate under the goods and services tax act.", "Form REG-06, Government of India.", "Certificate of registration, GST department."), pick(2, "Legal name", "Trade name"), F.col("name"), pick(3, "Constitution of business: partnership.", "Taxable person: regular.", "Date of liability is given below."), F.lit("GSTIN"), F.col("phone")),
        "UDYAM_CERTIFICATE": F.concat_ws(" ", pick(1, "Udyam registration certificate.", "Ministry of micro, small and medium enterprises.", "Certificate of an MSME."), pick(2, "Name of enterprise", "Enterprise"), F.col("name"), pick(3, "Major activity: services.", "Type of organisation: proprietary.", "Social category of entrepreneur: general."), F.col("phone")),
        "INCOME_TAX": F.concat_ws(" ", pick(1, "Indian income tax return acknowledgement.", "Return of income for the assessment year 2024-25.", "Form ITR-V, verification."), F.col("name"), pick(2, "Gross total income", "Total income", "Taxes paid"), F.col("phone"), pick(3, "Date of filing is stamped.", "Acknowledgement number below.", "Aggregate liability is nil.")),
        "PAN": F.concat_ws(" ", pick(1, "Permanent account number card.", "Income tax department, PAN.", "Allotment of a permanent account number."), pick(2, "Name", "Holder"), F.col("name"), pick(3, "Date of birth follows.", "Father's name follows.", "Signature below."), F.col("phone")),
    }
    made = F.lit(None).cast("string")
    for n, body in enumerate(bodies.values()):
        made = F.when(nth(0, 4) == n, body).otherwise(made)
    kind = F.element_at(F.array(*[F.lit(k) for k in bodies]), (nth(0, 4) + 1).cast("int"))
    return customers.select("id", kind.alias("document_type"), made.alias("text")).union(others.select("id", F.lit("UNKNOWN"), "text"))


def tender_sentences(rows: DataFrame) -> DataFrame:
    """id, description, ordinal, n_sentences, is_requirement: sentences of tenders made of rows (id, name): half oblige the bidder, half don't, whatever their verbs."""
    nth = lambda n, m: F.pmod(F.xxhash64("id", F.lit(n)), F.lit(m))
    pick = lambda n, *of: F.element_at(F.array(*[F.lit(x) for x in of]), (nth(n, len(of)) + 1).cast("int"))
    duty = F.concat_ws(" ", pick(1, "The bidder", "Every tenderer", "The applicant firm", "Each supplier", "The contractor"), pick(2, "must", "shall", "is required to", "has to", "should", "needs to", "is to"), pick(3, "submit", "furnish", "hold", "provide proof of", "possess", "enclose"), pick(4, "a valid certificate for", "two years of experience in", "an audited statement on", "samples of"), F.concat("name", F.lit(".")))
    other = F.concat_ws(" ", pick(1, "The authority", "The department", "This notice", "The committee", "The office"), pick(2, "must have been informed about", "may publish", "will pay for", "was founded to sell", "describes", "should soon open", "can cancel"), pick(3, "the parts named", "a catalogue of", "last year's", "the colours of"), F.concat("name", pick(4, ".", "!", " in 2023.", " as before.")))
    duty_next = nth(0, 2) == 0
    return rows.select("id", F.when(duty_next, duty).otherwise(other).alias("description"), nth(5, 12).cast("int").alias("ordinal"), F.lit(12).alias("n_sentences"), duty_next.alias("is_requirement"))
