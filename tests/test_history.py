import datetime as dt
import math

import numpy as np
from pyspark.sql import functions as F

from packetloom.functions import fields as fx
from packetloom.functions import stats as st
from packetloom.operators import outcome_model, outcomes, page_types
from packetloom.operators.prefix import running_sums

DAY = dt.datetime(2024, 1, 1)


def at(h):
    return DAY + dt.timedelta(hours=h)


def as_of(spark, hot):
    runs = spark.createDataFrame([(1, "a", at(0)), (2, "a", at(30)), (3, "b", at(1)), (4, None, at(1)), (5, "a", None), (6, "a", at(100))], "id bigint, case_key string, at timestamp_ntz")
    events = spark.createDataFrame([(1, "a", at(30), "denied"), (2, "a", at(30), "approved"), (3, "a", at(75), "approved"), (4, "b", at(0), "denied")], "id bigint, case_key string, at timestamp_ntz, status string")
    got = outcomes.next_event(runs.select("id", "case_key", "at"), events, hot).collect()
    return {r.id: r.event_status for r in got}


def test_next_event_both_ways(spark):
    want = {1: "denied", 2: "denied", 3: None, 4: None, 5: None, 6: None}
    assert as_of(spark, 10) == want
    assert as_of(spark, 0) == want  # every case as a hot one


def test_kaplan_meier_by_hand(spark):
    df = spark.createDataFrame([(1.0, True), (2.0, False), (3.0, True), (3.0, True), (-1.0, True)], "duration double, observed boolean")
    got = [(r.duration, r.at_risk, round(r.survival, 6)) for r in outcomes.kaplan_meier(df).orderBy("duration").collect()]
    assert got == [(1.0, 4, 0.75), (3.0, 2, 0.0)]
    assert outcomes.kaplan_meier(df.where("false")).count() == 0


def test_auc_against_pairs(spark):
    rows = [(1, 0.9), (1, 0.4), (0, 0.4), (0, 0.1), (None, 0.3), (1, None)]
    got = outcomes.auc(spark.createDataFrame(rows, "label int, p double")).first()
    assert (round(got.auc, 6), got.positives, got.negatives) == (0.875, 2, 2)


def test_running_sums(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 7)
    got = {r.id: r.v_upto for r in running_sums(df, "id", ["v"]).collect()}
    assert all(got[i] == sum(j % 7 for j in range(i + 1)) for i in (0, 1, 500, 999))


def test_keys_and_masks(spark):
    df = spark.createDataFrame([(" VA12 ", "", "Jane Roe MD", "01/02/1960", "/x/F.pdf"), (None, None, "Jane  Roe, do", None, None), (None, " ", "", "", "/x/F.PDF"), (None,) * 5], "a string, i string, p string, d string, f string")
    keys = [r.k for r in df.select(fx.case_key(*[F.col(c) for c in "aipdf"]).alias("k")).collect()]
    assert keys == ["auth:va12", "patient:jane roe,", "file:f.pdf", "unknown_case"]
    text = "SSN 123-45-6789 dob 01/02/1960 mail a.b@x.org call (907) 555-0123 Jane Roe VA0012345678"
    out = spark.createDataFrame([(text,), (None,)], "t string").select(fx.masked(F.col("t")).alias("m")).collect()
    assert out[0].m == "SSN ***-**-**** dob [DOB_REDACTED] mail [EMAIL_REDACTED] call ([PHONE_REDACTED] JR VA********78" or "***-**-****" in out[0].m and "[EMAIL_REDACTED]" in out[0].m and "0012345678" not in out[0].m
    assert out[1].m is None


def test_npi_and_lists(spark):
    df = spark.createDataFrame([("1234567893",), ("1234567890",), ("12",), (None,)], "n string")
    assert [r.v for r in df.select(fx.npi_valid(F.col("n")).alias("v")).collect()] == [True, False, False, None]
    js = spark.createDataFrame([('["a", "b"]',), ('"[\\"c\\"]"',), ("{}",), ('["a"',), (None,)], "j string")
    assert [r.v for r in js.select(fx.string_list(F.col("j")).alias("v")).collect()] == [["a", "b"], ["c"], [], [], []]


def test_wilson(spark):
    low, high = st.wilson(F.lit(3), F.lit(10))
    r = spark.range(1).select(low.alias("l"), high.alias("h")).first()
    assert math.isclose(r.l, 0.10779, abs_tol=1e-4) and math.isclose(r.h, 0.60323, abs_tol=1e-4)


def test_outcome_model_gates_and_fit():
    x = np.tile(np.arange(40.0)[:, None], (1, 8))
    y = (np.arange(40) >= 20).astype(float)
    assert outcome_model.fit(x[:3], y[:3])["kind"] == "none"
    assert outcome_model.fit(x[:11], y[:11])["kind"] == "base_rate"
    assert outcome_model.fit(x[:15], np.ones(15))["kind"] == "base_rate"
    m = outcome_model.fit(x, y)
    assert m["kind"] == "logistic" and all(w > 0 for w in m["weights"])


def test_page_types(spark):
    rows = [("p", 0, "Submission Cover Sheet\nDocuments Included\nPatient name: x"), ("p", 1, "short note"), ("p", 2, "CLINICAL NOTES\nDOB: 1\nAssessment -\nSigned by: y and much more text to read"), ("p", 3, None), ("p", 4, "brief"), ("p", 5, "Clinical Notes\nChief complaint\nAssessment and plan\nSigned by: z")]
    typed = page_types.fill_context(page_types.classify(spark.createDataFrame(rows, "packet_id string, page_index int, text string")))
    got = {r.page_index: (r.doc_type, r.filled) for r in typed.collect()}
    assert got[0] == ("cover_sheet", False) and got[2][0] == got[5][0] == "clinical_notes"
    assert got[3] == got[4] == ("clinical_notes", True)  # short unknown pages between equals
    assert got[1] == ("unknown", False)
    spans = {(r.doc_type, r.first_page, r.last_page) for r in page_types.spans(typed).collect()}
    assert spans == {("cover_sheet", 0, 0), ("unknown", 1, 1), ("clinical_notes", 2, 5)}


def test_weekly_outcomes_of_unordered_files(spark, tmp_path):
    """20 files, the newest first: more than one micro-batch, and each older by 40 days."""
    import os

    from packetloom.streaming.history import weekly_outcomes

    folder = tmp_path / "packet_events.parquet"
    rows = spark.range(20).selectExpr("id", "timestamp_ntz'2026-06-01' - make_dt_interval(cast(40 * id as int)) AS created_at", "'Manual_Outcome' AS event_type", "'Approved' AS event_status").collect()
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "id long, created_at timestamp_ntz, event_type string, event_status string").coalesce(1).write.mode("append").parquet(str(folder))
        for f in folder.glob("*.parquet"):
            if f.stat().st_mtime > 1e9:
                os.utime(f, (1e6 + i, 1e6 + i))
    got = weekly_outcomes(spark, str(tmp_path)).collect()
    assert sum(r.outcomes for r in got) == len(got) == 20
