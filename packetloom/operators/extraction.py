"""Codes, inferred findings, sections and judged observations of pages, as Column expressions.

Texts are read in the JVM: what is looked for are fixed phrases and labels, so every rule is one
expression over a page or one of its lines. Nothing here shuffles but the final choice per packet
and field.

Defined results: null pages have no lines, codes, findings or sections; a value that is blank after
the cut at a following label is no value.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Phrases that tell a finding, in the order in which findings are tried.
FINDINGS = {
    "diagnosis": {
        "degenerative disc disease": ["degenerative disc disease", "ddd"], "low back pain": ["low back pain", "lumbar pain", "back pain"], "migraine": ["migraine", "headache disorder"],
        "osteoarthritis": ["osteoarthritis", "degenerative joint disease", "djd"], "radiculopathy": ["radiculopathy", "radicular pain", "sciatica"], "neck pain": ["neck pain", "cervicalgia"],
    },
    "symptom": {
        "pain": ["pain", "ache", "aching"], "headache": ["headache", "head pain"], "numbness": ["numb"], "weakness": ["weak"], "tingling": ["tingling", "paresthesia"],
        "limited_range_of_motion": ["limited_range_of_motion", "limited range of motion", "reduced range of motion", "restricted motion"],
    },
    "medications": {
        "Acetaminophen": ["acetaminophen", "tylenol"], "Cyclobenzaprine": ["cyclobenzaprine", "flexeril"], "Gabapentin": ["gabapentin"], "Ibuprofen": ["ibuprofen", "motrin"],
        "Lidocaine": ["lidocaine"], "Meloxicam": ["meloxicam"], "Naproxen": ["naproxen", "aleve"], "Tramadol": ["tramadol"],
    },
}
#: Words that make a drug's name a medication; words of procedures, tried in this order.
MEDICATION_CONTEXT = ("medication", "current meds", "taking", "prescribed", "rx")
PROCEDURES = {"MRI": r"\b(?:mri|magnetic resonance imaging)\b", "CT": r"\b(?:cat scan|computed tomography)\b", "XRAY": r"\b(?:x[- ]?ray|radiograph)\b", "PHYSICAL_THERAPY": r"\b(?:physical therapy|pt evaluation)\b"}
REQUEST = r"(?:requested procedure|requested service|authorization is requested for|authorization requested for|plan includes|candidate for|procedures? performed)"
#: Codes that diagnoses imply, and the full writing of some codes.
IMPLIED_CODES = {"G43.909": ["migraine"], "M19.90": ["osteoarthritis", "degenerative joint disease", "djd"], "M54.2": ["neck pain", "cervicalgia"], "M54.50": ["low back pain", "lumbar pain", "back pain"]}
FULL_CODES = {"G43.9": "G43.909", "M19.9": "M19.90", "M54.5": "M54.50"}
ANY_CODE = r"\b([A-Z][0-9]{2}(?:\.[0-9A-Z]{1,4})?)\b"
CODE_LINE = r"(?i)(?:icd(?:-10)?(?: code)?s?|diagnosis codes?)\s*[:\-]\s*([^\n\r]+)"
#: Labels at which a value ends.
STOP_LABELS = (
    "dob", "date of birth", "birth date", "provider", "ordering physician", "ordered by", "requested by", "referring va provider", "referred by", "pcp", "facility", "location", "diagnosis", "assessment", "impression", "icd", "auth", "member id", "pob", "ssn",
    "reason for request", "reason for consult", "request rationale", "medical rationale", "clinical objective", "reason for referral", "chief complaint", "date of submission", "diagnoses", "clinical summary", "requested service", "requested procedure", "procedure", "cpt", "npi", "claim",
    "va icn", "icn", "integrated control number", "clinic", "practice name", "city", "state", "date of service", "dates of service", "service dates", "visit date", "dos", "medications", "current meds", "signature", "signed by", "phone", "fax", "address", "office staff", "submitting office", "reviewed",
    "scope of requested episode", "duration and scope of care", "continuity of care",
)
#: Headings of the roles a part of a page plays, and the order in which one role leads.
ROLES = {
    "request_intent": ["reason for consultation", "reason for request", "reason for referral", "chief complaint", "consultation and treatment request"],
    "diagnostic_basis": ["episode diagnosis", "primary diagnosis code", "diagnoses", "diagnosis"],
    "justification": ["letter of medical necessity", "medical necessity", "medical rationale"],
    "clinical_support": ["clinical summary", "history of present illness", "clinical notes", "assessment", "impression", "office visit notes", "prior conservative therapy documentation"],
    "request_scope": ["requested services", "scope of requested episode", "duration and scope of care", "authorization is requested for"],
    "routing_followup": ["continuity of care", "referring va provider", "follow-?up"],
    "consent_admin": ["telehealth virtual consent", "telehealth consent", "consent for medical care and treatment", "appointment confirmation method"],
    "imaging_support": ["mri report", "study date", "imaging findings"],
    "identity_admin": ["demographic information", "patient name", "veteran name", "date of submission", "submitting office", "office staff name", "documents included"],
}
#: Roles of a page type where no heading tells them.
DEFAULT_ROLES = {
    "cover_sheet": ["identity_admin"], "consent": ["consent_admin"], "consult_request": ["request_intent", "request_scope"], "seoc": ["diagnostic_basis", "request_scope", "routing_followup"], "lomn": ["justification", "diagnostic_basis"],
    "clinical_notes": ["clinical_support", "diagnostic_basis"], "imaging_report": ["imaging_support"], "conservative_care_summary": ["clinical_support"],
}
#: Headings of sections that end a window of following lines.
HEADINGS = ("clinical summary", "requested services", "medical rationale", "clinical goals include", "duration and scope of care", "continuity of care", "medical necessity", "diagnosis", "diagnoses", "episode diagnosis", "clinical objective", "reason for consultation", "reason for request", "reason for referral")


def _has(text: Column, phrases: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in phrases])


# Codes


def page_codes(text: Column) -> Column:
    """Codes of a page: of its code lines, else of the whole text, with those its diagnoses imply; sorted.

    Codes are written in full; codes of three characters name a family only and are dropped.
    """
    lines = F.regexp_extract_all(text, F.lit(CODE_LINE), F.lit(1))
    told = F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(ANY_CODE), F.lit(1))))
    anywhere = F.regexp_extract_all(text, F.lit(ANY_CODE), F.lit(1))
    low = F.lower(text)
    implied = F.filter(F.array(*[F.when(_has(low, words), code) for code, words in IMPLIED_CODES.items()]), lambda c: c.isNotNull())
    both = F.concat(F.when(F.size(told) > 0, told).otherwise(anywhere), implied)
    full = F.transform(both, lambda c: reduce(lambda x, kv: F.when(c == kv[0], kv[1]).otherwise(x), FULL_CODES.items(), c))
    return F.array_sort(F.array_distinct(F.filter(full, lambda c: c.contains("."))))


# Findings


def _first(text: Column, table: dict[str, list[str]]) -> Column:
    return F.coalesce(*[F.when(_has(text, words), F.lit(name)) for name, words in table.items()])


def requested(text: Column) -> Column:
    """What stands around the words of a request: 120 characters of the line behind and before each, in lower case."""
    low = F.lower(text)
    after = F.regexp_extract_all(low, F.lit(rf"{REQUEST}\s*[:\-]?\s*([^\n\r]{{0,120}})"), F.lit(1))
    before = F.regexp_extract_all(low, F.lit(r"([^\n\r]{0,120}?)\s*(?:requested procedure|requested service|authorization is requested for)"), F.lit(1))
    return F.array_join(F.concat(after, before), " ")


def findings(pages: DataFrame) -> DataFrame:
    """(packet_id, page_index, diagnosis, symptom, procedure, medications) that phrases of a page tell.

    Procedures count only near the words of a request, medications only beside words of taking them.
    """
    low = F.lower("text")
    asked = requested(F.col("text"))
    drugs = F.filter(F.array(*[F.when(_has(low, words), F.lit(name)) for name, words in FINDINGS["medications"].items()]), lambda d: d.isNotNull())
    procedure = F.coalesce(*[F.when(asked.rlike(p), F.lit(name)) for name, p in PROCEDURES.items()])
    return pages.where("text IS NOT NULL").select(
        "packet_id", "page_index", _first(low, FINDINGS["diagnosis"]).alias("diagnosis"), _first(low, FINDINGS["symptom"]).alias("symptom"), procedure.alias("procedure"),
        F.when(_has(low, MEDICATION_CONTEXT), F.array_join(drugs, ",")).otherwise("").alias("medications"),
    )


# Lines, sections, windows


def numbered_lines(pages: DataFrame) -> DataFrame:
    """(packet_id, page_index, line_no, line): the non-blank lines of pages, single-spaced, counted from 1."""
    lines = F.filter(F.transform(F.split("text", r"[\r\n]+"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    return pages.where("text IS NOT NULL").select("packet_id", "page_index", F.posexplode(lines).alias("at", "line")).select("packet_id", "page_index", (F.col("at") + 1).alias("line_no"), "line")


def is_heading(line: Column) -> Column:
    """Known headings, lines of up to eight words that end with a colon, and such in capitals."""
    low = F.regexp_replace(F.lower(line), r"^:+|:+$", "")
    short = F.size(F.split(line, r"\s+")) <= 8
    return low.isin(*HEADINGS) | (line.endswith(":") & short) | (line.rlike("[A-Za-z]") & (line == F.upper(line)) & short)


def section_roles(typed: DataFrame) -> DataFrame:
    """(packet_id, page_index, role, heading, inferred) of pages(packet_id, page_index, text, doc_type).

    A role is told by a line with one of its headings, bullets aside; roles of the page's type that no
    line tells are inferred.
    """
    found = F.filter(F.array(*[F.when(F.col("line").rlike(rf"(?i)\b(?:{'|'.join(words)})\b"), F.lit(role)) for role, words in ROLES.items()]), lambda r: r.isNotNull())
    told = numbered_lines(typed).where(~F.col("line").rlike(r"^[\x{2022}\x{25cf}\x{25cb}\x{2610}-\x{2612}*-]")).select("packet_id", "page_index", F.explode(found).alias("role"), F.col("line").alias("heading"))
    told = told.groupBy("packet_id", "page_index", "role", F.lower("heading").alias("low")).agg(F.min("heading").alias("heading")).drop("low")
    defaults = F.coalesce(*[F.when(F.col("doc_type") == t, F.array(*map(F.lit, roles))) for t, roles in DEFAULT_ROLES.items()])
    expected = typed.where("text IS NOT NULL").select("packet_id", "page_index", "doc_type", F.explode(defaults).alias("role"))
    inferred = expected.join(told.select("packet_id", "page_index", "role").distinct(), ["packet_id", "page_index", "role"], "left_anti")
    return told.withColumn("inferred", F.lit(False)).unionByName(inferred.select("packet_id", "page_index", "role", F.concat(F.lit("Inferred from "), "doc_type").alias("heading"), F.lit(True).alias("inferred")))


def leading_role(roles: Column) -> Column:
    """The first role of an array in the order of `ROLES`."""
    return F.coalesce(*[F.when(F.array_contains(roles, r), F.lit(r)) for r in ROLES])


def concept_windows(pages: DataFrame, anchors: dict[str, str], follow: int = 4) -> DataFrame:
    """(packet_id, page_index, concept, value): what stands behind the first line of an anchor, else on the lines below.

    `anchors`: concept -> pattern. Up to `follow` lines are taken, as far as the next heading. A window
    over the lines of one page, which are one row's text.
    """
    order = Window.partitionBy("packet_id", "page_index").orderBy("line_no").rowsBetween(1, follow)
    lines = numbered_lines(pages).withColumn("heading", is_heading(F.col("line"))).withColumn("below", F.collect_list(F.struct("heading", "line")).over(order))
    stop = F.array_position(F.transform("below", lambda x: x["heading"].cast("int")), 1).cast("int")
    below = F.array_join(F.transform(F.when(stop > 0, F.slice("below", 1, stop - 1)).otherwise(F.col("below")), lambda x: x["line"]), " ")
    found = F.array(*[F.when(F.col("line").rlike(f"(?i){p}"), F.struct(F.lit(c).alias("concept"), F.regexp_replace(F.regexp_extract("line", f"(?i)(?:{p})(.*)$", 1), r"^[ :\-]+|[ :\-]+$", "").alias("inline"))) for c, p in anchors.items()])
    values = lines.select("packet_id", "page_index", "line_no", below.alias("below"), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x"))
    values = values.select("packet_id", "page_index", "line_no", "x.concept", F.when(F.col("x.inline") != "", F.col("x.inline")).otherwise(F.col("below")).alias("value")).where("value <> ''")
    return values.groupBy("packet_id", "page_index", "concept").agg(F.min_by("value", "line_no").alias("value"))


# Values


def cut_at_label(value: Column) -> Column:
    """The value before the first label that stands behind its beginning."""
    places = F.filter(F.array(*[F.locate(label, F.lower(value), 2) for label in STOP_LABELS]), lambda p: p > 1)
    return F.trim(F.when(F.size(places) > 0, F.substring(value, F.lit(1), F.array_min(places) - 1)).otherwise(value))


def suspect_reason(field: Column, value: Column, snippet: Column) -> Column:
    """Why a value is hardly one of its field; null if nothing speaks against it."""
    both = F.lower(F.concat_ws(" ", value, snippet))
    provider = field.isin("provider", "ordering_provider", "referring_provider", "signed_by")
    words = F.regexp_extract_all(value, F.lit("([A-Za-z']+)"), F.lit(1))
    shout = F.exists(words, lambda w: (F.length(w) >= 3) & (w == F.upper(w))) & (value != F.upper(value))
    clinical = _has(both, ("injected", "fluoroscopic", "spinal nerve", "neural foramen"))
    return (
        F.when(value.rlike(r"(?i)\[[^\]]*(?:insert|enter|name|date|placeholder)[^\]]*\]|_{3,}"), "placeholder taken for a value")
        .when(provider & both.rlike(r"\byear[- ]old\b|\bmale\b|\bfemale\b"), "description of a person taken for a provider")
        .when(provider & both.contains("care team"), "care team taken for a provider")
        .when(provider & shout, "fragment of capitals in a provider's name")
        .when(provider & (F.size(words) > 4), "provider's name runs on into text")
        .when((field == "clinic_name") & (clinical | _has(both, ("revealed", "proximal spread", "needle", "contrast", "epidural"))), "procedure taken for a clinic")
        .when((field == "clinic_name") & (F.size(F.split(value, r"\s+")) > 8), "too long for a clinic's name")
        .when((field == "facility") & clinical, "procedure taken for a facility")
        .when((field == "reason_for_request") & F.lower(F.trim(value)).isin("patient's care team", "patients care team", "care team"), "care team taken for a reason")
    )


def confidence(field: Column, value: Column, low_text: Column, labelled: Column, zone: Column, read: Column, role: Column) -> Column:
    """Confidence of an observation.

    `labelled`: whether a label of the field stands on the page; `zone`: confidence (0 to 100) of the zone it
    came from, else null; `read`: confidence of the page's reading, else null; `role`: leading role of the page.
    """
    basis = role.isin("diagnostic_basis", "clinical_support", "justification")
    intent, scope = (field == "reason_for_request") & (role == "request_intent"), (field == "procedure") & (role == "request_scope")
    routed = (field == "facility") & role.isin("identity_admin", "routing_followup")
    from_zone = (
        F.when(field == "authorization_number", 0.99).when(field.isin("name", "dob", "va_icn"), 0.98).when(field.isin("ordering_provider", "referring_provider", "provider"), 0.97).otherwise(0.93)
        + F.when(zone >= 80, 0.02).when((zone > 0) & (zone < 55), -0.05).otherwise(0.0)
        + F.when(intent | ((field == "diagnosis") & basis), 0.01).otherwise(0.0)
    )
    authorized = (field == "authorization_number") & F.upper(F.trim(value)).startswith("VA")
    by_label = 0.95 + F.when(intent | ((field == "diagnosis") & basis) | scope, 0.02).when(routed, 0.01).otherwise(0.0)
    by_reading = F.greatest(F.lit(0.7), F.least(F.lit(0.95), 0.72 + read / 500)) + F.when(intent | ((field == "diagnosis") & basis), 0.03).when(routed, 0.02).otherwise(0.0)
    plain = 0.75 + F.when(intent | ((field == "diagnosis") & basis), 0.05).when(routed, 0.03).otherwise(0.0)
    return F.round(
        F.when(zone.isNotNull(), F.greatest(F.lit(0.75), F.least(F.lit(0.99), from_zone)))
        .when(authorized & low_text.rlike(r"\bref(?:\.|erral)?\b"), 0.99)
        .when(authorized & _has(low_text, ("community care", "10-10172", "request for service")), 0.97)
        .when(labelled, F.least(F.lit(0.99), by_label))
        .when(field.isin("symptom", "procedure"), F.least(F.lit(0.9), 0.8 + F.when(scope, 0.05).otherwise(0.0)))
        .when(read > 0, F.least(F.lit(0.97), by_reading))
        .otherwise(F.least(F.lit(0.9), plain)),
        2,
    )


def richest_codes(per_page: DataFrame) -> DataFrame:
    """(packet_id, page_index, codes): the code list that a packet keeps, of per_page(packet_id, page_index, codes, confidence).

    Pages come in order; a later one replaces the kept list if its confidence is not lower, or if it has
    more codes, which also lifts the kept confidence by 0.01. The order matters, so the pages of a packet
    are folded.
    """
    pages = F.array_sort(F.collect_list(F.struct("page_index", "codes", "confidence")))
    start = F.struct(F.lit(-1).alias("page_index"), F.array().cast("array<string>").alias("codes"), F.lit(-1.0).alias("confidence"))

    def step(kept: Column, page: Column) -> Column:
        richer = (kept["page_index"] >= 0) & (F.size(page["codes"]) > F.size(kept["codes"]))
        sure = F.when(richer, F.greatest(page["confidence"], kept["confidence"] + 0.01)).otherwise(page["confidence"])
        return F.when(sure >= kept["confidence"], F.struct(page["page_index"].alias("page_index"), page["codes"].alias("codes"), sure.alias("confidence"))).otherwise(kept)

    kept = per_page.where(F.size("codes") > 0).withColumn("confidence", F.col("confidence").cast("double")).groupBy("packet_id").agg(F.aggregate(pages, start, step).alias("kept"))
    return kept.select("packet_id", "kept.page_index", F.array_join("kept.codes", ",").alias("codes"), F.round("kept.confidence", 2).alias("confidence"))
