"""Page classification by counted phrases and a cascade of rules.

Phrases of each page type (fixed values below) are counted once per page: title phrases in the
first 500 characters, strong phrases, structure phrases, anchor groups and field hints in the
whole text. The cascade of cover sheet, title, strong phrases, structure, zone labels, anchors and
guarded keyword weights then is one `when` chain. Two types that lead by equal structure or anchors
decide nothing; other ties keep the order in which the types are listed. `supplemented` then reads
headers, `fill_context` the pages around.

Null and blank pages, and texts of less than 40 characters, are `unknown`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.operators.page_metadata import type_by_zones
from packetloom.session import materialize

_NOT_WORD = re.compile(r"[^a-z0-9]+")

#: Fixed values, in their natural order: phrases of each page type. A phrase matches as whole words.
TYPES: dict[str, dict] = {
    "cover_sheet": {
        "title": ["submission cover sheet", "community care submission cover sheet"],
        "strong": ["submission cover sheet", "documents included"],
        "structure": ["documents included", "date of submission", "primary diagnosis code", "submitting office", "office staff name", "date reviewed"],
        "anchors": [["submission cover sheet"], ["documents included", "check all"], ["date of submission", "primary diagnosis code"], ["submitting office", "office staff name", "date reviewed"], ["virtual consent form", "va form 10-10172", "clinical notes included", "letter of medical necessity"]],
        "expects": ["name", "dob", "ordering_provider", "facility", "clinic_name", "diagnosis", "signature_present"],
        "weights": {"submission cover sheet": 8, "documents included": 5, "date of submission": 4, "primary diagnosis code": 4},
        "least": 8,
    },
    "consent": {
        "title": ["telehealth virtual consent form", "virtual consent form", "telehealth consent"],
        "strong": ["telehealth virtual consent form", "virtual consent form", "consent for medical care and treatment", "telehealth consent"],
        "structure": ["consent for medical care and treatment", "telehealth consent", "appointment confirmation method", "emergency contact", "patient signature", "benefits and risks involved with telehealth technology"],
        "anchors": [["telehealth virtual consent form", "virtual consent form", "telehealth consent"], ["consent for medical care and treatment", "consent for care"], ["consent to participate in telehealth sessions", "benefits and risks involved with telehealth technology", "interactive video connection"], ["patient signature", "appointment confirmation method", "emergency contact"], ["full name", "date of birth", "home phone", "mobile phone"]],
        "expects": ["name", "dob", "signature_present"],
        "weights": {"virtual consent form": 6, "telehealth consent": 6, "consent for medical care and treatment": 6, "patient signature": 3},
        "least": 7,
    },
    "consult_request": {
        "title": ["consultation and treatment request", "consult and treatment request"],
        "strong": ["consultation and treatment request", "reason for consultation", "requested services", "medical rationale"],
        "structure": ["reason for consultation", "diagnoses", "clinical summary", "requested services", "medical rationale", "duration and scope of care", "authorization is requested for"],
        "anchors": [["consultation and treatment request", "consult and treatment request"], ["reason for consultation", "requested services"], ["medical rationale", "authorization is requested for"], ["duration and scope of care", "diagnostic confirmation and procedural planning"], ["referring va provider", "va claim number", "veteran name"]],
        "expects": ["name", "dob", "ordering_provider", "referring_provider", "authorization_number", "va_icn", "claim_number", "reason_for_request", "facility", "clinic_name", "location"],
        "weights": {"consultation and treatment request": 7, "reason for consultation": 5, "requested services": 5, "medical rationale": 4, "referring va provider": 4, "duration and scope of care": 4},
        "least": 7,
    },
    "seoc": {
        "title": ["single episode of care", "seoc"],
        "strong": ["single episode of care", "scope of requested episode", "estimated duration of episode"],
        "structure": ["episode diagnosis", "scope of requested episode", "estimated duration of episode", "clinical objective", "continuity of care", "procedure-based intervention"],
        "anchors": [["single episode of care", "seoc request", "seoc"], ["scope of requested episode", "estimated duration of episode"], ["episode diagnosis", "clinical objective"], ["continuity of care", "procedure-based intervention", "separate evaluation and authorization"]],
        "expects": ["name", "dob", "facility", "clinic_name", "location", "authorization_number", "service_date_range", "diagnosis"],
        "weights": {"single episode of care": 7, "seoc": 6, "scope of requested episode": 5, "estimated duration of episode": 5, "continuity of care": 4},
        "least": 7,
    },
    "lomn": {
        "title": ["letter of medical necessity", "medical necessity letter"],
        "strong": ["letter of medical necessity", "medical necessity", "medically reasonable and necessary"],
        "structure": ["to whom it may concern", "clinical summary", "medical necessity", "medically reasonable and necessary", "without appropriate interventional treatment", "failure of conservative"],
        "anchors": [["letter of medical necessity", "medical necessity letter"], ["to whom it may concern", "medical necessity"], ["clinical summary", "medical necessity"], ["medically reasonable and necessary", "without appropriate interventional treatment"], ["structured physical therapy", "activity modification", "home exercise program", "epidural steroid"]],
        "expects": ["name", "dob", "ordering_provider", "diagnosis", "reason_for_request", "facility", "signature_present"],
        "weights": {"letter of medical necessity": 8, "necessity": 5, "medical necessity": 5, "medically reasonable and necessary": 5, "clinical summary": 4, "to whom it may concern": 3},
        "least": 7,
    },
    "rfs": {
        "title": ["va form 10-10172", "10-10172", "request for service", "request for services"],
        "strong": ["va form 10-10172", "request for service", "va authorization number", "diagnosis codes (icd-10)"],
        "structure": ["request for service (rfs) submission requirements", "complete rfs form 10-10172", "section i: veteran & ordering provider information", "section ii: type of care request", "diagnosis codes (icd-10)", "reason for request", "ordering provider signature", "va authorization number"],
        "anchors": [["va form 10-10172", "10-10172", "request for service"], ["community care provider", "section i", "veteran & ordering provider information"], ["va authorization number", "ordering provider office name & address", "ordering provider npi"], ["type of care request", "diagnosis codes (icd-10)", "reason for request"], ["ordering provider signature", "today's date", "submission requirements"]],
        "expects": ["name", "dob", "ordering_provider", "referring_provider", "authorization_number", "va_icn", "claim_number", "service_date_range", "facility", "clinic_name", "location"],
        "weights": {"10-10172": 7, "10172": 6, "va form": 3, "request for service": 6, "va authorization number": 5, "diagnosis codes (icd-10)": 5, "community care provider": 4, "ordering provider signature": 4},
        "least": 7,
    },
    "clinical_notes": {
        "title": ["clinical note", "clinical notes", "progress note", "progress notes", "clinical documentation template"],
        "strong": ["clinical documentation template", "history of present illness", "assessment", "encounter performed and documented"],
        "structure": ["chief complaint", "history of present illness", "functional impairment", "conservative therapy history", "imaging findings", "assessment", "treatment plan", "physical exam", "encounter performed and documented"],
        "anchors": [["clinical documentation template", "clinical note", "clinical notes", "progress note"], ["chief complaint", "history of present illness"], ["functional impairment", "conservative therapy history", "imaging findings"], ["assessment", "treatment plan", "assessment and plan", "physical exam"], ["encounter performed and documented", "encounter reviewed & signed", "electronically signed"]],
        "expects": ["name", "dob", "provider", "ordering_provider", "referring_provider", "va_icn", "diagnosis", "symptom", "procedure", "icd_codes", "medications", "service_date_range", "facility", "clinic_name", "location", "signature_present"],
        "weights": {"clinical documentation template": 6, "history of present illness": 4, "chief complaint": 3, "assessment": 3, "treatment plan": 3, "physical exam": 3, "encounter performed and documented": 4},
        "least": 6,
    },
    "imaging_report": {
        "title": ["mri report", "lumbar spine mri report", "radiology report", "imaging report"],
        "strong": ["mri report", "lumbar spine mri report", "radiology report", "findings", "impression"],
        "structure": ["study date", "exam", "findings", "impression", "comparison", "clinical indication"],
        "anchors": [["mri report", "radiology report", "imaging report"], ["study date", "findings", "impression"], ["clinical indication", "comparison", "exam"]],
        "expects": [],
        "weights": {"mri report": 7, "lumbar spine mri report": 7, "radiology report": 6, "imaging report": 5, "findings": 3, "impression": 3, "study date": 2},
        "least": 7,
    },
    "conservative_care_summary": {
        "title": ["conservative care summary", "conservative treatment summary"],
        "strong": ["conservative care summary", "conservative treatment summary"],
        "structure": ["prior conservative therapy documentation", "structured physical therapy", "home exercise program", "activity modification", "oral anti-inflammatory", "epidural steroid", "treatment history"],
        "anchors": [["conservative care summary", "conservative treatment summary"], ["structured physical therapy", "home exercise program", "activity modification"], ["oral anti-inflammatory", "epidural steroid", "treatment history"]],
        "expects": [],
        "weights": {"conservative care summary": 7, "conservative treatment summary": 7, "prior conservative therapy documentation": 3},
        "least": 7,
    },
}
#: What names a field in a text.
HINTS = {
    "name": ["veteran name", "patient name", "full name", "member name"], "dob": ["date of birth", "birth date", "dob", "d.o.b."], "provider": ["provider name", "provider", "rendering provider", "treating provider"],
    "ordering_provider": ["ordering provider", "ordering physician", "ordered by", "requested by"], "referring_provider": ["referring provider", "referring va provider", "referred by", "ref provider", "pcp"],
    "authorization_number": ["authorization number", "auth number", "auth #", "referral number", "member id", "reference number", "tracking number"], "va_icn": ["va icn", "integrated control number", "icn"], "claim_number": ["claim number", "claim #", "va claim number", "last four ssn", "ssn ending"],
    "service_date_range": ["date of service", "dates of service", "service date", "visit date", "dos"], "reason_for_request": ["reason for request", "reason for referral", "chief complaint", "requested service", "requested procedure"],
    "facility": ["facility", "servicing facility", "treating facility", "requested facility", "facility name"], "clinic_name": ["submitting office", "office name", "practice name", "clinic name"], "location": ["office location", "clinic location", "facility location", "city/state", "city, state"],
    "diagnosis": ["diagnosis", "assessment", "impression", "clinical impression"], "icd_codes": ["icd", "icd-10", "diagnosis code"], "medications": ["medications", "current meds", "current medications"], "signature_present": ["signature", "signed by", "electronically signed"],
    "symptom": ["chief complaint", "history of present illness"], "procedure": ["requested procedure", "procedure", "cpt"],
}

#: Phrases that rule out a type where keyword weights decide.
RULED_OUT = {
    "cover_sheet": ["telehealth consent", "consent for medical care and treatment", "letter of medical necessity", "consultation and treatment request", "single episode of care", "request for service"],
    "consent": ["submission cover sheet", "letter of medical necessity", "consultation and treatment request", "single episode of care", "request for service", "encounter date", "chief complaint", "history of present illness"],
    "consult_request": ["letter of medical necessity", "single episode of care", "telehealth consent", "documents included", "request for service"],
    "seoc": ["letter of medical necessity", "consultation and treatment request", "telehealth consent", "documents included", "request for service"],
    "lomn": ["single episode of care", "consultation and treatment request", "telehealth consent", "documents included", "request for service"],
    "rfs": ["submission cover sheet", "documents included", "consultation and treatment request", "letter of medical necessity", "telehealth consent"],
    "clinical_notes": ["submission cover sheet", "consent for medical care and treatment", "letter of medical necessity", "consultation and treatment request", "single episode of care", "request for service"],
    "imaging_report": ["submission cover sheet", "telehealth consent", "consultation and treatment request", "letter of medical necessity", "clinical documentation template"],
    "conservative_care_summary": ["letter of medical necessity", "clinical documentation template", "consultation and treatment request", "request for service"],
}
#: Words of which a type needs some where keyword weights decide (for some types only below a weight).
NEEDED = {
    "consult_request": (["consultation", "consult", "treatment request", "referring va provider", "ordering provider", "requested service"], None),
    "lomn": (["medical necessity", "reason for request", "chief complaint", "requested service"], 8),
    "rfs": (["10-10172", "10172", "va form", "request for service", "authorization", "referral", "member id"], 8),
    "consent": (["telehealth consent", "consent for medical care and treatment", "consent to participate in telehealth sessions", "interactive video connection"], None),
}
CLINICAL = ["diagnosis", "icd", "assessment", "impression", "plan", "physical exam", "history of present illness"]
#: Phrases of headers, and how much a header's type counts against the page's own.
HEADERS = {
    "cover_sheet": ["submission cover sheet"], "consent": ["telehealth virtual consent form", "virtual consent form"], "consult_request": ["consultation and treatment request"], "seoc": ["single episode of care", "seoc"], "lomn": ["letter of medical necessity"],
    "rfs": ["request for service", "request for services", "10 10172", "1010172"], "clinical_notes": ["clinical documentation template", "clinical note", "clinical notes"], "imaging_report": ["mri report", "radiology report"], "conservative_care_summary": ["conservative care summary", "conservative treatment summary"],
}
PRIORITY = {"clinical_notes": 1, "consult_request": 2, "lomn": 2, "rfs": 2, "seoc": 2, "cover_sheet": 2, "consent": 2}


def page_text(raw: Column) -> Column:
    """Lower case, words joined over line ends, blanks single."""
    joined = F.regexp_replace(F.regexp_replace(raw, "\r", "\n"), r"(?<=\w)-\n(?=\w)", "")
    return F.trim(F.regexp_replace(F.lower(joined), r"\s+", " "))


def _spaced(text: str) -> str:
    """Words between single blanks, so that whole-word search is plain containment."""
    return f" {_NOT_WORD.sub(' ', text)} "


KINDS = ("title", "titleanchor", "titlehint", "strong", "structure", "anchor", "hint", "score")


def _fits(name: str, text: str, found: set[str], score: int) -> bool:
    """Whether the words of a page allow a type that keyword weights suggest."""
    if name == "cover_sheet":
        return all(w in text for w in ("submission", "cover", "sheet"))
    if name == "seoc":
        return "seoc" in text or all(w in text for w in ("single", "episode", "care"))
    if name == "clinical_notes":
        return sum(w in found for w in CLINICAL) >= 2 or "clinical" in text or "notes" in text
    words, enough = NEEDED.get(name, ((), None))
    return not words or (enough is not None and score >= enough) or any(w in found for w in words)


def _guarded(counts: list[int], text: str, found: set[str], zones: list[str], anchors: list[int], structure: list[int], hints: list[int]) -> list[int]:
    """Keyword weights of the types that no guard drops, lifted by what zone labels say."""
    out = list(counts)
    for i, name in enumerate(TYPES):
        supported = (anchors[i] >= 2 and (structure[i] or hints[i] >= 2)) or anchors[i] >= 3 or (name == "clinical_notes" and structure[i] >= 3 and hints[i] >= 2)
        if out[i] and not (supported and not any(p in found for p in RULED_OUT[name]) and _fits(name, text, found, out[i])):
            out[i] = 0
    at = list(TYPES).index
    if any("authorization" in z or "box 4" in z for z in zones):
        out[at("rfs")] += 3
    if any("reason for request" in z or "requested service" in z for z in zones):
        out[at("consult_request")] += 2
    return out


def _count_phrases(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each kind of phrase an array with the count of every type.

    Every distinct phrase is searched once per page; titles, anchors and hints of the head only among
    those that the page has at all. As expressions the searches outgrow one compiled method, so they
    run in Arrow batches.
    """
    types = list(TYPES.values())
    hints = [list(dict.fromkeys(h for f in t["expects"] for h in HINTS[f])) for t in types]
    words = {k: [[_spaced(p) for p in t[k]] for t in types] for k in ("title", "strong", "structure")}
    headers = {_spaced(p): t for t, phrases in HEADERS.items() for p in phrases}
    whole = sorted({p for lists in words.values() for x in lists for p in x} | set(headers))
    plain = sorted({p for t in types for g in t["anchors"] for p in g} | {h for x in hints for h in x} | {p for t in types for p in t["weights"]} | {p for x in RULED_OUT.values() for p in x} | {p for x, _ in NEEDED.values() for p in x} | set(CLINICAL))
    held = lambda found, phrases: sum(p in found for p in phrases)
    groups = lambda found, t: sum(any(p in found for p in g) for g in t["anchors"])
    for b in batches:
        out = []
        for packet, page, text, zones in zip(b["packet_id"], b["page_index"], b["normal"], b["zones"]):
            head, spaced = text[:500], _spaced(text)
            spaced_head = _spaced(head)
            found, found_whole = {p for p in plain if p in text}, {p for p in whole if p in spaced}
            top, top_whole = {p for p in found if p in head}, {p for p in found_whole if p in spaced_head}
            anchors, structure, hinted = [groups(found, t) for t in types], [held(found_whole, x) for x in words["structure"]], [held(found, h) for h in hints]
            zones = [] if zones is None else list(zones)
            score = _guarded([sum(w for p, w in t["weights"].items() if p in found) for t in types], text, found, zones, anchors, structure, hinted)
            first = min(((spaced_head.find(p), -PRIORITY.get(t, 0), t) for p, t in headers.items() if p in top_whole), default=(0, 0, None))[2]
            out.append((
                packet, page, text, zones, first,
                [held(top_whole, x) for x in words["title"]], [groups(top, t) for t in types], [held(top, h) for h in hints],
                [held(found_whole, x) for x in words["strong"]], structure, anchors, hinted, score,
            ))
        yield pd.DataFrame(out, columns=["packet_id", "page_index", "normal", "zones", "header_type", *KINDS])


def _best(*kinds: str) -> Column:
    """The type that leads by these counts in turn; the first listed on ties. Null if the first count is 0."""
    names = F.lit(list(TYPES))
    ranked = F.transform(F.sequence(F.lit(1), F.lit(len(TYPES))), lambda i: F.struct(*[F.element_at(k, i).alias(k) for k in kinds], (-i).alias("i"), F.element_at(names, i).alias("t")))
    top = F.array_max(ranked)
    return F.when(top[kinds[0]] > 0, top)


def _tied(chosen: Column, *kinds: str) -> Column:
    """Whether another type has the same counts as the chosen one."""
    same = F.filter(F.sequence(F.lit(1), F.lit(len(TYPES))), lambda i: F.array_min(F.array(*[(F.element_at(k, i) == chosen[k]).cast("int") for k in kinds])) == 1)
    return F.size(same) > 1


def _with_layout(confidence: Column, doc: Column) -> Column:
    """More for forms with many zones, and for a request whose zones name an authorization."""
    many = doc.isin("rfs", "consult_request", "seoc", "cover_sheet") & (F.size("zones") >= 4)
    named = (doc == "rfs") & F.exists("zones", lambda z: z.contains("authorization") | z.contains("box 4"))
    return confidence + F.when(many, 0.05).otherwise(0.0) + F.when(named, 0.06).otherwise(0.0)


def _of(kind: str, chosen: Column) -> Column:
    """The count of the chosen type; null of an unknown one."""
    at = F.array_position(F.lit(list(TYPES)), chosen).cast("int")
    return F.when(at > 0, F.element_at(kind, at))


def _supported(chosen: Column, titled: bool) -> Column:
    """Whether the page has the family's anchors beyond its title."""
    anchors, hints, structure = _of("anchor", chosen), _of("hint", chosen), _of("structure", chosen)
    plain = ((anchors >= 2) & ((structure >= 1) | (hints >= 2))) | (anchors >= 3) | ((chosen == "clinical_notes") & (structure >= 3) & (hints >= 2))
    return (anchors >= 1) | plain if titled else plain


def _with_hints(confidence: Column, hints: Column) -> Column:
    return F.when(hints >= 4, F.least(F.lit(0.99), confidence + 0.08)).when(hints >= 2, F.least(F.lit(0.98), confidence + 0.04)).when(hints == 1, F.least(F.lit(0.97), confidence + 0.02)).otherwise(F.greatest(F.lit(0.4), confidence - 0.03))


def _with_anchors(confidence: Column, anchors: Column) -> Column:
    return F.when(anchors >= 4, F.least(F.lit(0.99), confidence + 0.08)).when(anchors >= 2, F.least(F.lit(0.98), confidence + 0.05)).when(anchors == 1, F.least(F.lit(0.97), confidence + 0.02)).otherwise(confidence)


def classify(pages: DataFrame) -> DataFrame:
    """pages(packet_id, page_index, text, and zones if there are any) with doc_type, confidence, rule and the normalised text.

    `zones` are lower-case labels. The cascade itself stays in the JVM. The result is written, so that no
    later filter drags the whole cascade along.
    """
    zones = F.col("zones") if "zones" in pages.columns else F.array().cast("array<string>")
    text = pages.select("packet_id", "page_index", F.coalesce(page_text(F.col("text")), F.lit("")).alias("normal"), zones.alias("zones"))
    schema = "packet_id string, page_index int, normal string, zones array<string>, header_type string, " + ", ".join(f"{k} array<int>" for k in KINDS)
    counted = text.mapInPandas(_count_phrases, schema)
    title = _best("title", "titleanchor", "titlehint")
    strong = _best("strong", "anchor", "hint")
    built = _best("structure", "anchor", "hint")
    anchored = _best("anchor", "hint")
    weighted = _best("score")
    chosen = counted.select(
        "*",
        title.alias("by_title"),
        strong.alias("by_strong"),
        built.alias("by_structure"),
        anchored.alias("by_anchor"),
        weighted.alias("by_score"),
        F.array_max("strong").alias("most_strong"),
        type_by_zones(F.col("zones")).alias("by_zone"),
    )
    size = F.length("normal")
    cover = F.col("normal").contains("submission cover sheet") & _supported(F.lit("cover_sheet"), True)
    title_ok = F.col("by_title").isNotNull() & _supported(F.col("by_title.t"), True)
    structure_enough = (F.col("by_structure.structure") >= F.when(F.col("by_structure.t").isin("cover_sheet", "clinical_notes"), 2).otherwise(3)) | ((F.col("by_structure.structure") >= 2) & ((F.col("by_structure.hint") >= 3) | (F.col("by_structure.anchor") >= 2)))
    structure_ok = F.col("by_structure").isNotNull() & _supported(F.col("by_structure.t"), False) & structure_enough & ~_tied(F.col("by_structure"), "structure", "anchor", "hint")
    zone_ok = F.col("by_zone").isNotNull() & F.coalesce(_supported(F.col("by_zone.doc_type"), False), F.lit(False))
    anchor_ok = F.col("by_anchor").isNotNull() & _supported(F.col("by_anchor.t"), False) & ~_tied(F.col("by_anchor"), "anchor", "hint")
    least = F.element_at(F.lit([t["least"] for t in TYPES.values()]), -F.col("by_score.i"))
    score_ok = F.col("by_score").isNotNull() & (F.col("by_score.score") >= least)
    rule = F.when(size < 40, "short").when(cover, "cover").when(title_ok, "title").when(F.col("by_strong").isNotNull(), "strong").when(structure_ok, "structure").when(zone_ok, "zone").when(anchor_ok, "anchor").when(score_ok, "score").otherwise("none")
    doc = (
        F.when(F.col("rule") == "cover", "cover_sheet")
        .when(F.col("rule") == "title", F.col("by_title.t"))
        .when(F.col("rule") == "strong", F.col("by_strong.t"))
        .when(F.col("rule") == "structure", F.col("by_structure.t"))
        .when(F.col("rule") == "zone", F.col("by_zone.doc_type"))
        .when(F.col("rule") == "anchor", F.col("by_anchor.t"))
        .when(F.col("rule") == "score", F.col("by_score.t"))
        .otherwise("unknown")
    )
    hints, anchors = _of("hint", F.col("doc_type")), _of("anchor", F.col("doc_type"))
    confidence = (
        F.when(F.col("rule") == "cover", _with_hints(F.lit(0.96), hints))
        .when(F.col("rule") == "title", 0.88 + 0.02 * F.least(F.col("by_title.title"), F.lit(2)) + 0.02 * F.least(F.col("by_title.titleanchor"), F.lit(3)) + 0.01 * F.least(F.col("by_title.titlehint"), F.lit(3)))
        .when(F.col("rule") == "strong", _with_hints(_with_anchors(F.least(F.lit(0.99), 0.84 + 0.04 * F.col("most_strong")), anchors), hints))
        .when(F.col("rule") == "structure", 0.62 + 0.06 * F.least(F.col("by_structure.structure"), F.lit(4)) + 0.03 * F.least(F.col("by_structure.anchor"), F.lit(3)) + 0.02 * F.least(F.col("by_structure.hint"), F.lit(3)))
        .when(F.col("rule") == "zone", F.least(F.lit(0.94), 0.68 + 0.05 * F.least(F.col("by_zone.hits") - 2, F.lit(3)) + F.when(hints >= 2, 0.04).otherwise(0.0)))
        .when(F.col("rule") == "anchor", 0.64 + 0.05 * F.least(F.col("by_anchor.anchor"), F.lit(4)) + 0.02 * F.least(F.col("by_anchor.hint"), F.lit(3)))
        .when(F.col("rule") == "score", _with_hints(_with_anchors(F.least(F.lit(0.95), 0.58 + 0.04 * (F.col("by_score.score") - F.coalesce(least, F.lit(7)))), anchors), hints))
        .otherwise(F.when(size == 0, 0.1).when(size < 120, 0.2).otherwise(0.35))
    )
    typed = (
        chosen.withColumn("rule", rule)
        .withColumn("doc_type", doc)
        .withColumn("confidence", F.round(F.least(F.lit(0.99), F.when(F.col("doc_type") == "unknown", F.least(F.lit(0.55), confidence + F.when(F.size("zones") >= 4, 0.08).otherwise(0.0))).otherwise(_with_layout(confidence, F.col("doc_type")))), 2))
        .transform(supplemented)
        .select("packet_id", "page_index", "normal", F.size("zones").alias("zones"), "doc_type", "confidence", "rule")
    )
    return materialize(typed, "classified-pages")


def supplemented(typed: DataFrame) -> DataFrame:
    """A header's type replaces one of lower priority; unknown pages with the support of clinical notes or a request become such."""
    rank = lambda c: F.coalesce(*[F.when(c == t, F.lit(n)) for t, n in PRIORITY.items()], F.lit(0))
    doc, sure = F.col("doc_type"), F.col("confidence")
    headed = F.coalesce(rank(F.col("header_type")) > rank(doc), F.lit(False))
    known = F.when(headed, F.col("header_type")).otherwise(doc)
    open_ = (known == "unknown") & (F.length("normal") >= 120)
    clinical = open_ & _supported(F.lit("clinical_notes"), False)
    request = open_ & _supported(F.lit("rfs"), False) & ~F.col("normal").contains("submission cover sheet")
    return (
        typed.withColumn("_how", F.when(headed, "header").when(clinical, "clinical").when(request, "request"))
        .withColumn("doc_type", F.when(F.col("_how") == "header", F.col("header_type")).when(F.col("_how") == "clinical", "clinical_notes").when(F.col("_how") == "request", "rfs").otherwise(doc))
        .withColumn("confidence", F.when(F.col("_how") == "header", F.greatest(sure, F.lit(0.88))).when(F.col("_how") == "clinical", F.greatest(sure, F.lit(0.78))).when(F.col("_how") == "request", F.greatest(sure, F.lit(0.8))).otherwise(sure))
        .withColumn("rule", F.coalesce("_how", "rule"))
    )


def fill_context(typed: DataFrame, longest: int = 320, least_pages: int = 3) -> DataFrame:
    """Unknown runs of short pages with few zones between two pages of one type take that type, at confidence 0.64 or more.

    Windows run over the pages of one packet, which are the array of one input row.
    """
    order = Window.partitionBy("packet_id").orderBy("page_index")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    known = F.when(F.col("doc_type") != "unknown", F.col("doc_type"))
    t = (
        typed.withColumn("_before", F.last(known, ignorenulls=True).over(before))
        .withColumn("_after", F.first(known, ignorenulls=True).over(after))
        .withColumn("_run", F.count(known).over(order))
        .withColumn("_pages", F.count(F.lit(1)).over(Window.partitionBy("packet_id")))
    )
    crowded = F.when(F.col("zones") > 4, longest + 1).otherwise(F.length("normal"))
    long = F.max(F.when(F.col("doc_type") == "unknown", crowded)).over(Window.partitionBy("packet_id", "_run"))
    take = (F.col("doc_type") == "unknown") & (F.col("_before") == F.col("_after")) & (F.col("_long") <= longest) & (F.col("_pages") >= least_pages)
    return (
        t.withColumn("_long", long)
        .withColumn("filled", F.coalesce(take, F.lit(False)))
        .withColumn("doc_type", F.when(F.col("filled"), F.col("_before")).otherwise(F.col("doc_type")))
        .withColumn("confidence", F.when(F.col("filled"), F.greatest("confidence", F.lit(0.64))).otherwise(F.col("confidence")))
        .drop("_before", "_after", "_run", "_pages", "_long")
    )


def spans(typed: DataFrame) -> DataFrame:
    """Contiguous pages of one type in a packet: (packet_id, span, doc_type, first_page, last_page, pages)."""
    order = Window.partitionBy("packet_id").orderBy("page_index")
    turn = F.coalesce((F.lag("doc_type").over(order) != F.col("doc_type")).cast("int"), F.lit(1))
    return typed.withColumn("turn", turn).withColumn("span", F.sum("turn").over(order)).groupBy("packet_id", "span", "doc_type").agg(F.min("page_index").alias("first_page"), F.max("page_index").alias("last_page"), F.count(F.lit(1)).alias("pages"))


def confidence_model(typed: DataFrame, read: DataFrame, exact: DataFrame) -> DataFrame:
    """Per packet and type: pages, spans, mean confidence, pages of every band, and reliability.

    `read(packet_id, page_index, read)` is the reading confidence (0 to 100), `exact` the exact duplicates
    (packet_id, page_indices). Reliability is the mean confidence, raised by well read pages and lowered by
    badly read and repeated ones.
    """
    repeated = exact.select("packet_id", F.explode(F.split("page_indices", ",").cast("array<int>")).alias("page_index")).withColumn("repeated", F.lit(1))
    pages = typed.join(read, ["packet_id", "page_index"], "left").join(repeated, ["packet_id", "page_index"], "left")
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))
    sure, quality = F.col("confidence"), F.col("read") / 100
    per = pages.groupBy("packet_id", "doc_type").agg(
        F.count(F.lit(1)).alias("pages"), F.round(F.avg(sure), 2).alias("average_confidence"), count(sure >= 0.85).alias("high"), count((sure >= 0.6) & (sure < 0.85)).alias("medium"), count(sure < 0.6).alias("low"),
        count(quality >= 0.78).alias("good"), count(quality < 0.52).alias("poor"), F.count("repeated").alias("repeated"),
    )
    counted = spans(typed).groupBy("packet_id", "doc_type").agg(F.count(F.lit(1)).alias("spans"))
    score = F.round(F.greatest(F.lit(0.05), F.least(F.lit(0.99), F.col("average_confidence") + 0.04 * F.col("good") - 0.05 * F.col("poor") - 0.04 * F.col("repeated"))), 2)
    return per.join(counted, ["packet_id", "doc_type"]).withColumn("reliability", score).withColumn("band", F.when(score >= 0.8, "high").when(score >= 0.55, "medium").otherwise("low"))
