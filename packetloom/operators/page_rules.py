"""Forms and packets by single phrases, unfilled forms, and the plain extractors.

These are the simple rules beside the cascade of `page_types`: a form is named by one phrase, a
packet by the first of six patterns, and a form is unfilled if too little of it is filled in.
Null texts hold nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases that name a form, and phrases that name it only together.
FORMS = {
    "Virtual Consent Form": (["virtual consent", "telehealth consent", "consent for telehealth"], ["telehealth", "video visit", "remote consultation"]),
    "VA Form 10-10172": (["10-10172", "request for services", "community care"], ["community care", "referral authorization", "request for services"]),
    "SEOC": (["episode of care", "seoc", "service episode"], []),
    "Consultation & Treatment Request": (["consultation request", "treatment request", "consultation & treatment"], []),
    "Letter of Medical Necessity": (["medical necessity", "lomn"], ["medically necessary", "required treatment", "supporting documentation"]),
    "MRI Report": (["mri", "findings", "impression", "radiology report"], []),
    "Clinical Notes": (["history of present illness", "assessment and plan", "clinical note", "provider notes"], []),
}
#: Patterns of packets, tried in this order.
PACKETS = {
    "VA Community Care Packet": r"community\s*care\s*authorization", "Consultation Packet": r"consultation\s*(?:and|&)?\s*treatment\s*request", "Request for Services Packet": r"request\s*for\s*services",
    "CMS1500 Billing Packet": r"cms[-\s]?1500", "LOMN Packet": r"letter\s*of\s*medical\s*necessity|lomn", "SEOC Packet": r"\bseoc\b|episode\s*of\s*care",
}
#: What shows that a consent form is filled in.
FILLED = (
    r"full name[^\n\r:]{0,40}:\s*(?!date of birth\b|state\b|street address\b|home phone\b|email\b|city\b|mobile phone\b|ssn\b|phone\b|zip\b|work phone\b)[a-z][a-z'\-]+(?:\s+[a-z][a-z'\-]+){1,3}",
    r"date of birth[^\n\r:]{0,40}:\s*\d{1,2}[/-]\d{1,2}[/-]\d{2,4}", r"street address[^\n\r:]{0,40}:\s*\d{1,6}\s+[a-z0-9.\- ]{3,}", r"phone[^\n\r:]{0,40}:\s*(?:\(?\d{3}\)?[- ]?\d{3}[- ]?\d{4}|\d{7,})",
    r"email(?: address)?[^\n\r:]{0,40}:\s*[\w.\-]+@[\w.\-]+\.\w+", r"\b(?:signature|signed)\b",
)

#: Marks of boxes; labels that may be broken over two lines.
BOXES = ("☐", "☑", "[ ]", "[x]", "( )", "(x)", "□", "■")
BROKEN_LABELS = (
    "authorization number", "patient name", "veteran name", "date of birth", "va claim number", "referral number", "ordering physician", "ordering doctor", "ordering provider", "referring physician", "referring doctor", "referring provider",
    "primary care provider", "consult requested by", "ordered by", "referred by",
)


def joined_labels(text: Column) -> Column:
    """The text with labels that were broken over two lines in one, single blanks and no blank lines."""
    halves = [(" ".join(words[:i]), " ".join(words[i:])) for words in map(str.split, BROKEN_LABELS) for i in range(1, len(words))]
    breaks = "|".join(rf"(?<=^{a})\n(?={b}$)|(?<=\n{a})\n(?={b}$)|(?<=^{a})\n(?={b}\n)|(?<=\n{a})\n(?={b}\n)" for a, b in halves)
    lines = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "\r", "\n"), r"[ \t]+", " "), r" ?\n ?", "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(lines, f"(?i){breaks}", " "), r"\n+", "\n"))


def layout_marks(pages: DataFrame) -> DataFrame:
    """(packet_id, page_index, table_lines, box_kinds, signed): lines that look like table rows, kinds of boxes, words of signing."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x).rlike(r"\||\t|\s{3,}"))
    boxes = reduce(lambda a, b: a + b, [F.col("text").contains(m).cast("int") for m in BOXES])
    return pages.where("text IS NOT NULL").select("packet_id", "page_index", F.size(lines).alias("table_lines"), boxes.alias("box_kinds"), F.lower("text").rlike("signature|signed").alias("signed"))


def benchmark_scores(cases: DataFrame) -> DataFrame:
    """cases(case_id, expected_documents, documents, expected_fields, fields, read) with the scores of documents, fields and reading.

    45 : 40 : 15; `read` is the mean reading confidence (full at 80), null counts 0. Nothing expected scores 0.
    """
    hit = lambda found, want: F.size(F.array_intersect(found, want)) / F.greatest(F.size(F.array_distinct(want)), F.lit(1))
    scored = cases.select("case_id", hit("documents", "expected_documents").alias("document_score"), hit("fields", "expected_fields").alias("field_score"), F.least(F.lit(1.0), F.coalesce(F.col("read") / 80, F.lit(0.0))).alias("read_score"))
    return scored.withColumn("score", F.round(0.45 * F.col("document_score") + 0.4 * F.col("field_score") + 0.15 * F.col("read_score"), 2))


def _single(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def forms(text: Column) -> Column:
    """Names of the forms that a text mentions, in the order listed."""
    t = _single(text)
    either = lambda words: reduce(lambda a, b: a | b, [t.contains(w) for w in words])
    together = lambda words: reduce(lambda a, b: a & b, [t.contains(w) for w in words]) if words else F.lit(False)
    return F.filter(F.array(*[F.when(either(words) | together(context), F.lit(name)) for name, (words, context) in FORMS.items()]), lambda f: f.isNotNull())


def packet_kind(text: Column) -> Column:
    """The first kind of packet whose pattern a text has."""
    low = F.lower(text)
    return F.coalesce(*[F.when(low.rlike(p), F.lit(name)) for name, p in PACKETS.items()], F.lit("Unknown Packet"))


def filled_signals(text: Column) -> Column:
    """How many of the six signs of a filled-in consent form a text shows."""
    t = _single(text)
    return reduce(lambda a, b: a + b, [t.rlike(p).cast("int") for p in FILLED])


def unfilled(doc_type: Column, text: Column) -> Column:
    """Whether a page is the empty form of its type."""
    t = _single(text)
    consent = t.rlike("virtual consent|telehealth consent|consent for treatment|consent form") & (filled_signals(text) < 2)
    blank = t.rlike(r"veteran name:\s*dob:\s*last four ssn:|va claim number:\s*referring va provider:")
    name = t.rlike(r"veteran name:\s*(?!dob:|last four ssn:|va claim number:|referring va provider:)[a-z][a-z'\-]+(?:\s+[a-z][a-z'\-]+){1,3}")
    filled = name & t.rlike(r"\bdob:\s*\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b") & t.rlike(r"referring va provider:\s*(?!evaluation\b|diagnoses\b|authorization\b)[a-z].{3,}")
    request = t.contains("consultation and treatment request") & blank & ~filled
    notes = t.contains("clinical documentation template") & t.rlike(r"pain severity\s*\(0.?10\)\s*:\s*iii\.|describe specific functional impact:\s*m conservative therapy history|mri date:\s*findings:\s*affected levels:|diagnosis:\s*primary:\s*secondary")
    return F.when(doc_type == "consent", consent).when(doc_type == "consult_request", request).when(doc_type == "clinical_notes", notes).otherwise(F.lit(False))


def plain_fields(pages: DataFrame) -> DataFrame:
    """(packet_id, page_index, authorization, dob, code, doctor): the plain extractors, first match of each."""
    text = F.coalesce("text", F.lit(""))
    first = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    return pages.select(
        "packet_id", "page_index",
        first(r"(?i)\b(?:authorization|auth|referral)\b[^\n\r0-9]{0,30}?([0-9]{2,12})\b").alias("authorization"), first(r"(?i)\b(?:dob|date of birth)\b\s*[:\-]?\s*([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})").alias("dob"),
        first(r"\b([A-TV-Z][0-9]{2}\.[0-9A-Z]{1,4})\b").alias("code"), first(r"\bDr\.?\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)").alias("doctor"),
    )
