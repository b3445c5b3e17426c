"""Hand-worked values for the page operators, and the cases that every one of them must survive."""

import datetime

import pytest
from pyspark.sql import functions as F

from packetloom.functions import fields as fx
from packetloom.operators import duplicate_pages, extraction, outcomes, page_fields, page_metadata, page_order, page_rules, page_types

PAGES = "packet_id string, page_index int, text string"
NOTES = "Clinical Notes\nChief complaint: back pain. History of present illness: pain in the low back for weeks. Assessment: lumbar strain. Treatment plan: physical exam again. Diagnosis: strain, provider name, date of birth."


def pages(spark, *texts):
    return spark.createDataFrame([("p", i, t) for i, t in enumerate(texts)], PAGES)


# masking


def test_masks(spark):
    cases = {
        "SSN 123-45-6789 born 1/2/1950": "SSN ***-**-**** born [DOB_REDACTED]",
        "VA1234567890123456 and VA123456": "VA**************56 and VA****56",
        "1234567890V123456": "12*************56",
        "Member ID 99887766": "Member ID 99****66",
        "claim number: ABC1234567": "claim number: AB******67",
        "tracking number # 12345": "tracking number # 12*45",
        "auth: A-12345": "auth: A-123**",
        "mail a.b@c.d.org or (907) 555-0123, 907-555-0123": "mail [EMAIL_REDACTED] or [PHONE_REDACTED], [PHONE_REDACTED]",
        "John Smith came": "JS came",
        "": "",
        "nothing 42 here": "nothing 42 here",
    }
    df = spark.createDataFrame([(k,) for k in [*cases, None]], "t string")
    got = {r.t: r.m for r in df.select("t", fx.masked(F.col("t")).alias("m")).collect()}
    assert got.pop(None) is None and got == cases


# duplicates


def filler(n, *swap):
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(n)]
    for i in swap:
        words[i] = f"other{chr(97 + i % 26)}x"
    return " ".join(words)


def typed(spark, *rows):
    return spark.createDataFrame([("p", i, t, k) for i, (t, k) in enumerate(rows)], "packet_id string, page_index int, normal string, doc_type string")


def test_exact_duplicates(spark):
    t, short = filler(80), "few words only but more than eighty characters so that it could be compared at all"
    df = typed(spark, (t, "lomn"), (t, "unknown"), (filler(80, 3), "lomn"), (short, "rfs"), (short, "rfs"), ("", "rfs"), (None, "unknown"))
    assert [(r.page_indices, r.doc_type) for r in duplicate_pages.exact_groups(df.union(df)).collect()] == [("0,1", "lomn")]
    assert duplicate_pages.exact_groups(typed(spark, (t, "lomn"), (t, "rfs"))).count() == 0
    assert duplicate_pages.exact_groups(typed(spark, (t, "unknown"), (t, "unknown"))).count() == 0


def test_near_duplicates(spark):
    dated = filler(60) + " on 01/02/2024 under id ab12345 and 4711"
    df = typed(spark, (dated, "lomn"), (dated.replace("01/02", "11/12").replace("ab12345", "zz99999").replace("4711", "4712"), "lomn"), (filler(60, *range(0, 60, 2)), "lomn"), (dated + " x", "rfs"), (None, "lomn"))
    assert [(r.page_indices, r.doc_type) for r in duplicate_pages.near_groups(df).collect()] == [("0,1", "lomn")]
    assert duplicate_pages.near_groups(df.limit(0)).count() == 0


def test_near_pairs_against_all_pairs(spark):
    rnd = __import__("random").Random(3)
    base = filler(40).split()
    texts = [" ".join(w if rnd.random() > 0.02 * (i % 9) else rnd.choice(base) for w in base[: 40 - i % 5]) for i in range(40)]
    df = typed(spark, *[(t, "lomn") for t in texts]).select("packet_id", "page_index", "doc_type", F.length("normal").alias("size"), duplicate_pages.compared_words(F.col("normal")).alias("words"))
    got = {(r.a, r.b) for r in duplicate_pages.near_pairs(df).collect()}
    words = {r.page_index: r.words for r in df.collect()}
    want = set()
    for a in range(40):
        for b in range(a + 1, 40):
            x, y = " ".join(words[a]), " ".join(words[b])
            common = len(set(words[a]) & set(words[b]))
            if min(len(x), len(y)) >= 0.88 * max(len(x), len(y)) and common >= 12 and common >= 0.72 * max(len(set(words[a])), len(set(words[b]))) and __import__("difflib").SequenceMatcher(None, x, y).ratio() >= 0.94:
                want.add((a, b))
    assert got == want and want


def test_links_reach_the_smallest_page(spark):
    pairs = spark.createDataFrame([("p", i, i + 1) for i in range(20)] + [("p", 30, 31), ("q", 5, 9)], "packet_id string, a int, b int")
    got = {(r.packet_id, r.page_index): r.first for r in duplicate_pages.linked(pairs).collect()}
    assert got == {("p", i): 0 for i in range(21)} | {("p", 30): 30, ("p", 31): 30, ("q", 5): 5, ("q", 9): 5}


# classification


def types_of(spark, *texts, zones=None):
    df = pages(spark, *texts)
    if zones is not None:
        df = df.withColumn("zones", F.array(*map(F.lit, zones)))
    return [(r.doc_type, r.rule) for r in page_types.classify(df).orderBy("page_index").collect()]


def test_types(spark):
    cover = "Submission Cover Sheet\nDate of submission: today. Documents included: check all. Primary diagnosis code: X. Patient name: A."
    got = types_of(spark, cover, NOTES, None, "", "short", "The weather was fine and the train arrived without any delay at the station.")
    assert got[0] == ("cover_sheet", "cover") and got[1] == ("clinical_notes", "title") and [g[0] for g in got[2:]] == ["unknown"] * 4
    assert page_types.classify(pages(spark).limit(0)).count() == 0


def test_zones_decide_where_phrases_do_not(spark):
    text = "This page speaks of the office location and the clinic location. Veteran and ordering provider information, section i. Va authorization number. Reason for request."
    assert types_of(spark, text, zones=["10-10172 form", "request for service", "diagnosis codes"])[0][0] == "rfs"


def test_weights_need_the_words_of_their_type():
    names = list(page_types.TYPES)
    counts, anchors = [9] * len(names), [3] * len(names)
    left = page_types._guarded(counts, "the plan and the assessment", {"plan", "assessment"}, [], anchors, [1] * len(names), [2] * len(names))
    assert dict(zip(names, left)) == {"cover_sheet": 0, "consent": 0, "consult_request": 0, "seoc": 0, "lomn": 9, "rfs": 9, "clinical_notes": 9, "imaging_report": 9, "conservative_care_summary": 9}
    assert page_types._guarded(counts, "", {"letter of medical necessity"}, [], [0] * len(names), anchors, anchors)[names.index("rfs")] == 0
    assert page_types._guarded([0] * len(names), "", set(), ["authorization number"], anchors, anchors, anchors)[names.index("rfs")] == 3


def test_context_and_spans(spark):
    rows = [("p", i, n, 0, k, 0.9) for i, (n, k) in enumerate([("x", "lomn"), ("x", "unknown"), ("x", "lomn"), ("x" * 400, "unknown"), ("x", "lomn"), ("x", "rfs")])]
    filled = page_types.fill_context(spark.createDataFrame(rows, "packet_id string, page_index int, normal string, zones int, doc_type string, confidence double"))
    assert [r.doc_type for r in filled.orderBy("page_index").collect()] == ["lomn", "lomn", "lomn", "unknown", "lomn", "rfs"]
    assert [(r.doc_type, r.first_page, r.last_page) for r in page_types.spans(filled).orderBy("first_page").collect()] == [("lomn", 0, 2), ("unknown", 3, 3), ("lomn", 4, 4), ("rfs", 5, 5)]


def test_forms_packets_and_unfilled_ones(spark):
    df = pages(spark, "Request for Services and MRI", "telehealth video visit remote consultation", None, "letter of  medical\nnecessity", "seocx")
    got = [(r.f, r.k) for r in df.orderBy("page_index").select(page_rules.forms(F.col("text")).alias("f"), page_rules.packet_kind(F.col("text")).alias("k")).collect()]
    assert got == [(["VA Form 10-10172", "MRI Report"], "Request for Services Packet"), (["Virtual Consent Form"], "Unknown Packet"), ([], "Unknown Packet"), (["Letter of Medical Necessity"], "LOMN Packet"), (["SEOC"], "Unknown Packet")]
    texts = [("consent", "Virtual consent form. Full name: Date of birth: Signature"), ("consent", "Virtual consent form. Full name: Jane Roe Date of birth: 1/2/1950 signed"), ("consult_request", "Consultation and treatment request veteran name: dob: last four ssn: x"), ("clinical_notes", NOTES), ("unknown", None)]
    df = spark.createDataFrame(texts, "doc_type string, text string")
    assert [r.u for r in df.select(page_rules.unfilled(F.col("doc_type"), F.col("text")).alias("u")).collect()] == [True, False, True, False, False]


# extraction


def test_codes(spark):
    df = pages(spark, "ICD-10: M54.5, G43\nalso A12.34", "only A12.34 and M54 here", "migraine without a code", None, "")
    got = [r.c for r in df.orderBy("page_index").select(extraction.page_codes(F.col("text")).alias("c")).collect()]
    assert got == [["M54.50"], ["A12.34"], ["G43.909"], None, []]
    per_page = spark.createDataFrame([("p", 0, ["A1.1"], 0.95), ("p", 1, ["B1.1", "B2.2"], 0.75), ("p", 2, ["C1.1"], 0.95), ("q", 0, [], 0.9)], "packet_id string, page_index int, codes array<string>, confidence double")
    assert [tuple(r) for r in extraction.richest_codes(per_page).collect()] == [("p", 1, "B1.1,B2.2", 0.96)]


def test_windows_and_cuts(spark):
    df = pages(spark, "Reason for request:\nfirst line\nsecond line\nPLAN\nmore", "x Reason for request: inline value DOB: 1/1/1950", None, "")
    got = {r.page_index: r.value for r in extraction.concept_windows(df, {"reason": "reason for request"}).collect()}
    assert got == {0: "first line second line", 1: "inline value DOB: 1/1/1950"}
    cut = spark.createDataFrame([("inline value DOB: 1",), ("diagnosis first",), ("plain",), (None,)], "v string")
    assert [r.c for r in cut.select(extraction.cut_at_label(F.col("v")).alias("c")).collect()] == ["inline value", "diagnosis first", "plain", None]


def test_suspects_and_confidence(spark):
    rows = [("provider", "a 45 year old male", None), ("provider", "Jane Roe", ""), ("signed_by", "one two three four five", ""), ("clinic_name", "needle placed", ""), ("name", "[patient name]", ""), ("provider", "Jane ROE", ""), ("reason_for_request", "Care Team", "")]
    df = spark.createDataFrame(rows, "f string, v string, s string")
    got = [r.r is not None for r in df.select(extraction.suspect_reason(F.col("f"), F.col("v"), F.col("s")).alias("r")).collect()]
    assert got == [True, False, True, True, True, True, True]
    rows = [("name", "A", "", True, None, None, None, 0.95), ("authorization_number", "VA1", "ref. 1", True, None, None, None, 0.99), ("diagnosis", "x", "", True, None, None, "justification", 0.97), ("procedure", "x", "", False, None, None, "request_scope", 0.85), ("facility", "x", "", False, None, 78.0, None, 0.88), ("dob", "x", "", False, 50.0, None, None, 0.93), ("facility", "x", "", False, None, None, None, 0.75)]
    df = spark.createDataFrame(rows, "f string, v string, t string, l boolean, z double, o double, r string, want double")
    assert all(abs(r.c - r.want) < 1e-9 for r in df.select("want", extraction.confidence(*[F.col(c) for c in "fvtlzor"]).alias("c")).collect())


def test_observations(spark):
    df = pages(spark, "Patient Name: Jane Roe\nDOB: 01/02/1950\nOrdering Provider: Dr. Max Poe, MD", None, "", "Patient Name: Roe, Jane")
    got = {(r.page_index, r.field): (r.value, r.at, r.snippet) for r in page_fields.observations(df).collect()}
    assert got[0, "name"] == ("Jane Roe", 15, "Patient Name: Jane Roe DOB: 01/02/1950 Ordering Provider: Dr. Max Poe, MD") and got[0, "ordering_provider"][0] == "Max Poe" and got[0, "dob"][0] == "01/02/1950"
    chosen = {r.field: (r.value, r.page_index) for r in page_fields.selected(page_fields.observations(df)).collect()}
    assert chosen["name"] == ("Roe, Jane", 3)
    assert {r.field: r.conflict for r in page_fields.redundancy(page_fields.observations(df)).collect()}["name"] is False
    found = page_fields.authorizations(pages(spark, "Authorization Number: VA 0012345678", "authorization was given, see VA0012345678", "call VA0012345678", "none", None))
    assert sorted((r.page_index, r.authorization, r["rank"]) for r in found.collect()) == [(0, "VA0012345678", 1), (1, "VA0012345678", 3), (2, "VA0012345678", 5)]


# metadata and order


def test_summaries_of_every_shape(spark):
    import json

    page = {"scan_summary": {"pages": [{"page": 1, "ocr_confidence": 80.0, "segments": {"provider": "a", "zones": {"label": "DOB", "confidence": 0.5}}}, {"page": 2, "segments": [{"provider": "b"}, {"provider": "a", "zones": [{"label": "Name", "confidence": 0.7}, {"label": "name"}]}]}]}}
    at = datetime.datetime(2025, 1, 1)
    rows = [(1, "f", at, json.dumps(page)), (1, "f", at, json.dumps(page)), (2, "g", at, json.dumps(json.dumps(page))), (3, "h", at, '{"scan_summary": {"pages": [{"pa'), (4, "i", at, None), (5, None, at, json.dumps(page)), (6, "j", None, "[]")]
    got = {(r.file_name, r.page_index): (r.read, r.segments, r.engines, r.zones, r.zone_confidence) for r in page_metadata.summaries(spark.createDataFrame(rows, "id bigint, file_name string, analyzed_at timestamp, intel_summary_json string")).collect()}
    want = {0: (80.0, 1, ["a"], ["dob"], 0.5), 1: (None, 2, ["a", "b"], ["name"], 0.7)}
    assert got == {(f, i): v for f in "fg" for i, v in want.items()}


def test_merges(spark):
    kind = "file_name string, page_index int, read double, segments int, engines array<string>, zones array<string>, zone_confidence double"
    one, two = spark.createDataFrame([("f", 0, None, 1, ["a"], ["x"], 0.5)], kind), spark.createDataFrame([("f", 0, 70.0, 3, ["b"], ["x", "y"], None), ("g", 0, 1.0, 0, [], [], None)], kind)
    assert sorted(map(tuple, page_metadata.merged(one, two).collect())) == [("f", 0, 70.0, 3, ["a", "b"], ["x", "y"], 0.5), ("g", 0, 1.0, 0, [], [], None)]
    texts = spark.createDataFrame([("One\ntwo", "TWO\nthree\nthree", "One\ntwo\nthree"), (None, "a", "a"), ("a", None, "a"), ("", "", "")], "a string, b string, want string")
    assert all(r.m == r.want for r in texts.select("want", page_metadata.merged_text(F.col("a"), F.col("b")).alias("m")).collect())


@pytest.fixture(scope="module")
def described(spark):
    long = "\n".join(f"label {i}: the page has plenty of text about the diagnosis, the provider and the authorization of patient name" for i in range(8))
    rows = [("p", i, t, z) for i, (t, z) in enumerate([(long, ["a"] * 5), ("tiny", []), ("tiny", []), ("tiny", []), (None, []), (long + "x", [])])] + [("q", 0, long, ["a", "b"])]
    df = spark.createDataFrame(rows, f"{PAGES}, zones array<string>")
    return df.withColumns({"read": F.lit(80.0), "segments": F.size("zones"), "engines": F.array(F.lit("e")), "zone_confidence": F.lit(None).cast("double")})


def test_candidates_stand_for_pages_that_begin_alike(described):
    got = [(r.packet_id, r.position, r.page_index) for r in page_metadata.reading_candidates(described).orderBy("packet_id", "position").collect()]
    assert got == [("p", 1, 4), ("p", 2, 1), ("p", 3, 2), ("p", 4, 3), ("p", 5, 5)]


def test_reasons_and_summaries(spark, described):
    few = spark.createDataFrame([("p", 1)], "packet_id string, document_types int")
    got = {r.packet_id: (r.sparse_pages, r.reasons) for r in page_metadata.retry_reasons(described, described.where("packet_id = 'q'").select("packet_id"), few).collect()}
    assert got == {"p": (4, "no authorization number; many sparse pages"), "q": (0, "")}
    assert {r.packet_id: (r.pages, r.text_pages, r.mode) for r in page_metadata.intake(described).collect()} == {"p": (6, 5, "ocr_text"), "q": (1, 1, "ocr_text")}
    assert {r.packet_id: r.band for r in page_metadata.layout_summary(described).collect()} == {"p": "good", "q": "good"}


def test_page_order(spark):
    df = pages(spark, "Date of Service: 02/03/2024", "Signed on 2024-01-05\nDate of submission: 1/2/24", "no date", None, "Signature Date: 99/99/2024")
    got = {r.page_index: (r.kind, str(r.date)) for r in page_order.page_dates(df).collect()}
    assert got == {0: ("service", "2024-02-03"), 1: ("submission", "2024-01-02")}
    kinds = ["clinical_notes", "clinical_notes", "unknown", "rfs", "cover_sheet"]
    typed = df.join(spark.createDataFrame(list(enumerate(kinds)), "page_index int, doc_type string"), "page_index").join(page_order.page_dates(df), ["packet_id", "page_index"], "left")
    got = {r.page_index: (r.recommended, r.review) for r in page_order.page_order_of(typed).collect()}
    assert got == {4: (1, True), 3: (2, True), 1: (3, True), 0: (4, True), 2: (5, True)}


def test_reliability(spark):
    judged = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.1), (0, 0.3)], "label int, p double")
    r = outcomes.reliability(judged).first()
    assert (r.sample_size, r.brier, r.auc, r.ece) == (4, 0.0375, 1.0, 0.175) and r.reliability == round(0.4 * 4 / 80 + 0.25 + 0.2 * (1 - 0.175 / 0.3) + 0.15 * (1 - 0.0375 / 0.35), 2)


# packets of known kind, with invented names


CASES = {
    "rotated_rfs": (["VA Form 10-10172\n4. Authorization Number: VA0012345678\nPatient Name: Max Poe\nDate of Birth: 04/03/1992\nReferring Provider: Ann Roe\nOrdering Provider: Will Doe\nICN: 1012345678V123456\nRequested Service: MRI lumbar spine\nReason for Request: low back pain and radiculopathy\nDate of Service: 01/01/2025 to 03/19/2026"], ["rfs"], ["authorization_number", "name", "dob", "va_icn", "ordering_provider", "referring_provider"]),
    "noisy_clinical": (["Clinical Notes\nHistory of Present Illness\nPatient Name: Max Poe\nDOB: 04/03/1992\nProvider: Will Doe\nAssessment: lumbar radiculopathy and low back pain\nImpression: low back pain\nReason for Request: MRI lumbar spine\nICD-10: M54.16, M54.50\nSigned by: Will Doe"], ["clinical_notes"], ["name", "dob", "provider", "diagnosis", "reason_for_request", "icd_codes"]),
    "split_packet": (["Consultation and Treatment Request\nPatient Name: Max Poe\nDOB: 04/03/1992\nOrdering Provider: Will Doe\nReferring Provider: Ann Roe\nReason for Request: bilateral hip pain and low back pain\nRequested Procedure: MRI", "Letter of Medical Necessity\nPatient Name: Max Poe\nDOB: 04/03/1992\nDiagnosis: lumbar radiculopathy\nReason for Request: low back pain\nPatient failed physical therapy and ibuprofen\nSigned by: Will Doe"], ["consult_request", "lomn"], ["name", "dob", "ordering_provider", "referring_provider", "diagnosis", "reason_for_request"]),
    "synthetic_packet": (["Submission Cover Sheet\nPatient Name: Max Poe\nDOB: 04/03/1992\nOrdering Provider: Will Doe\nClinic Name: Elm Row Pain Management\nNPI: 1234567890", "Clinical Notes\nPatient Name: Max Poe\nDOB: 04/03/1992\nAssessment: lumbar radiculopathy\nICD-10: M54.16, M54.50\nSigned by: Will Doe"], ["cover_sheet", "clinical_notes"], ["name", "dob", "ordering_provider", "clinic_name", "npi", "diagnosis"]),
}


def test_benchmark_cases(spark):
    df = spark.createDataFrame([(c, i, t) for c, (texts, _, _) in CASES.items() for i, t in enumerate(texts)], PAGES)
    documents = {r.packet_id: r.d for r in page_types.classify(df).where("doc_type <> 'unknown'").groupBy("packet_id").agg(F.collect_set("doc_type").alias("d")).collect()}
    fields = {r.packet_id: r.f for r in page_fields.observations(df).groupBy("packet_id").agg(F.collect_set("field").alias("f")).collect()}
    for r in df.select("packet_id", extraction.page_codes(F.col("text")).alias("codes")).collect():
        fields[r.packet_id] += ["icd_codes"] if r.codes else []
    rows = [(c, want, documents.get(c, []), f, fields.get(c, []), 78.0) for c, (_, want, f) in CASES.items()]
    kinds = "case_id string, expected_documents array<string>, documents array<string>, expected_fields array<string>, fields array<string>, read double"
    scores = {r.case_id: r for r in page_rules.benchmark_scores(spark.createDataFrame([*rows, ("none", [], [], [], [], None)], kinds)).collect()}
    assert all(scores[c].document_score == 1.0 and scores[c].field_score == 1.0 and scores[c].score == 1.0 for c in CASES), (documents, fields)
    assert scores["none"].score == 0.0


def test_broken_labels_and_marks(spark):
    df = pages(spark, "Authorization\n Number\nPatient  Name\n\nordered\r\nx", "a | b\nc    d\n[ ] yes [x] no\nSigned", None, "")
    got = [r.j for r in df.orderBy("page_index").select(page_rules.joined_labels(F.col("text")).alias("j")).collect()]
    assert got == ["Authorization Number\nPatient Name\nordered\nx", "a | b\nc d\n[ ] yes [x] no\nSigned", None, ""]
    marks = {r.page_index: (r.table_lines, r.box_kinds, r.signed) for r in page_rules.layout_marks(df).collect()}
    assert marks == {0: (0, 0, False), 1: (2, 2, True), 3: (0, 0, False)}
    npi = spark.createDataFrame([("1234567893",), ("1234567890",), ("12345",), (None,)], "n string")
    assert [r.v for r in npi.select(fx.npi_valid(F.col("n")).alias("v")).collect()] == [True, False, False, None]
