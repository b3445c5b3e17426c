"""Page metadata: how each page of a packet was read, and what is decided from it.

A page's metadata are its reading confidence, the engines that read it and the zones found on it,
as the newest run of a file reports them (`summaries`), joined to the page texts (`described`).
From them come intake diagnostics, the reasons for a second reading, the pages chosen for it,
layout and lineage summaries, and the page type that zone labels tell.

Defined results: a file without a readable report has pages without zones, engines and confidence;
lone objects count as lists of one; repeated zones (same label in one segment) count once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions.fields import unwrapped
from packetloom.operators.page_fields import page_measures

#: Labels of zones that tell a page type, in the order of the types.
ZONE_LABELS = {
    "cover_sheet": ["submission cover sheet", "date of submission", "submission date", "primary diagnosis code", "documents included", "submitting office"],
    "consent": ["virtual consent", "telehealth consent", "consent for medical care and treatment", "appointment confirmation method", "patient signature"],
    "consult_request": ["consultation and treatment request", "referring va provider", "requested services", "reason for consultation", "medical rationale"],
    "seoc": ["single episode of care", "scope of requested episode", "estimated duration of episode", "continuity of care"],
    "lomn": ["letter of medical necessity", "medical necessity", "clinical summary", "medically reasonable and necessary"],
    "rfs": ["10-10172", "request for service", "va authorization number", "diagnosis codes", "ordering provider signature", "community care"],
    "clinical_notes": ["clinical documentation template", "chief complaint", "history of present illness", "physical exam", "assessment", "treatment plan"],
    "imaging_report": ["mri report", "radiology report", "study date", "findings", "impression"],
    "conservative_care_summary": ["conservative care summary", "conservative treatment summary", "home exercise program", "activity modification", "structured physical therapy"],
}
#: Words on a page that its fields can be read.
SIGNALS = ("authorization", "patient name", "veteran name", "date of birth", "dob", "provider", "diagnosis", "icd", "signature", "signed by", "request for service", "consent", "necessity", "clinical notes")
MOST_CANDIDATES, FINGERPRINT = 6, 240


def _listed(json: Column) -> Column:
    """JSON of a list; a lone object becomes a list of one."""
    return F.when(F.ltrim(json).startswith("{"), F.concat(F.lit("["), json, F.lit("]"))).otherwise(json)


def summaries(runs: DataFrame) -> DataFrame:
    """(file_name, page_index, read, segments, engines, zones, zone_confidence) of runs(id, file_name, analyzed_at, intel_summary_json).

    The newest run of a file with a readable report of its pages counts. `zones` are the distinct lower-case labels.
    """
    report = F.get_json_object(unwrapped(unwrapped(F.col("intel_summary_json"))), "$.scan_summary.pages")
    newest = runs.where("file_name IS NOT NULL").select("file_name", "analyzed_at", "id", _listed(unwrapped(report)).alias("report")).where(F.col("report").isNotNull())
    newest = newest.groupBy("file_name").agg(F.max_by("report", F.struct("analyzed_at", "id")).alias("report"))
    pages = newest.select("file_name", F.explode(F.from_json("report", "array<struct<page:int,ocr_confidence:double,segments:string>>")).alias("p")).select("file_name", "p.*").where("page >= 1")
    parts = F.from_json(_listed(F.col("segments")), "array<struct<provider:string,segment_reason:string,text_length:int,zones:string>>")
    parts = F.coalesce(F.filter(parts, lambda s: s.isNotNull()), F.array().cast("array<struct<provider:string,segment_reason:string,text_length:int,zones:string>>"))
    zones = F.flatten(F.transform(parts, lambda s: F.coalesce(F.from_json(_listed(s["zones"]), "array<struct<label:string,confidence:double>>"), F.array().cast("array<struct<label:string,confidence:double>>"))))
    zones = F.filter(zones, lambda z: z["label"].isNotNull())
    engines = F.array_sort(F.array_distinct(F.filter(F.transform(parts, lambda s: s["provider"]), lambda p: p.isNotNull())))
    return (
        pages.select("file_name", (F.col("page") - 1).alias("page_index"), F.col("ocr_confidence").alias("read"), F.size(parts).alias("segments"), engines.alias("engines"), zones.alias("all_zones"))
        .select("*", F.array_sort(F.array_distinct(F.transform("all_zones", lambda z: F.lower(F.trim(z["label"]))))).alias("zones"), F.aggregate("all_zones", F.lit(None).cast("double"), lambda a, z: F.greatest(a, z["confidence"])).alias("zone_confidence"))
        .drop("all_zones")
        .dropDuplicates(["file_name", "page_index"])
    )


def merged(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two sets of summaries as one: zones and engines united, the first's confidence before the second's, more segments win."""
    both = first.join(second.withColumnsRenamed({c: f"{c}_2" for c in second.columns if c not in ("file_name", "page_index")}), ["file_name", "page_index"], "full")
    none = F.array().cast("array<string>")
    united = lambda c: F.array_sort(F.array_distinct(F.concat(F.coalesce(c, none), F.coalesce(f"{c}_2", none)))).alias(c)
    return both.select("file_name", "page_index", F.coalesce("read", "read_2").alias("read"), F.greatest("segments", "segments_2").alias("segments"), united("engines"), united("zones"), F.greatest("zone_confidence", "zone_confidence_2").alias("zone_confidence"))


def merged_text(first: Column, second: Column) -> Column:
    """Lines of a page's own text, then those of a second reading that it has not yet, whatever their case."""
    own = F.split(F.coalesce(first, F.lit("")), "\n")
    seen = F.transform(own, lambda x: F.lower(F.trim(x)))
    new = F.filter(F.split(F.coalesce(second, F.lit("")), "\n"), lambda x: (F.trim(x) != "") & ~F.array_contains(seen, F.lower(F.trim(x))))
    return F.array_join(F.concat(F.filter(own, lambda x: F.trim(x) != ""), F.array_distinct(new)), "\n")


def described(pages: DataFrame, packets: DataFrame, reports: DataFrame) -> DataFrame:
    """pages(packet_id, page_index, text) with their metadata; packets(packet_id, file_name) joins the reports of files."""
    none = F.array().cast("array<string>")
    known = packets.select("packet_id", "file_name").join(reports, "file_name").drop("file_name")
    out = pages.join(known, ["packet_id", "page_index"], "left")
    return out.withColumns({"segments": F.coalesce("segments", F.lit(0)), "engines": F.coalesce("engines", none), "zones": F.coalesce("zones", none)})


def type_by_zones(zones: Column) -> Column:
    """(doc_type, hits): the type with most of its labels among the zones, two at least; the first listed on ties."""
    hits = {t: F.size(F.filter(F.array(*map(F.lit, labels)), lambda x: F.exists(zones, lambda z: z.contains(x)))) for t, labels in ZONE_LABELS.items()}
    best = F.array_max(F.array(*[F.struct(h.alias("hits"), F.lit(-i).alias("i"), F.lit(t).alias("doc_type")) for i, (t, h) in enumerate(hits.items())]))
    return F.when(best["hits"] >= 2, F.struct(best["doc_type"].alias("doc_type"), best["hits"].alias("hits")))


def intake(described_pages: DataFrame) -> DataFrame:
    """Per packet: pages with text, readings, zones and split segments, engines, mean confidence, mode of extraction."""
    text = (F.trim(F.coalesce("text", F.lit(""))) != "").cast("bigint")
    has = lambda c: F.sum((c > 0).cast("bigint"))
    per = described_pages.groupBy("packet_id").agg(
        F.count(F.lit(1)).alias("pages"), F.sum(text).alias("text_pages"), has(F.size("engines")).alias("read_pages"), has(F.size("zones")).alias("zone_pages"), F.sum((F.col("segments") > 1).cast("bigint")).alias("split_pages"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("engines")))), ",").alias("engines"), F.round(F.avg("read"), 2).alias("average_read"), F.round(F.min("read"), 2).alias("lowest_read"),
    )
    return per.withColumn("mode", F.when(F.col("read_pages") > 0, "ocr_text").when(F.col("zone_pages") > 0, "layout_ocr").otherwise("native_text"))


def retry_reasons(described_pages: DataFrame, authorized: DataFrame, typed: DataFrame) -> DataFrame:
    """(packet_id, pages, sparse_pages, reasons): why a packet should be read again; the empty string if there is no reason.

    `authorized(packet_id)`: packets with an authorization number; `typed(packet_id, document_types)`: number of page types
    found. A packet is well covered with text on 85 % of its pages and zones on half of them.
    """
    pages = described_pages.join(page_measures(described_pages).select("packet_id", "page_index", "sparse"), ["packet_id", "page_index"])
    flag = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))
    text = F.trim(F.coalesce("text", F.lit(""))) != ""
    per = pages.groupBy("packet_id").agg(F.count(F.lit(1)).alias("pages"), flag(F.col("sparse")).alias("sparse_pages"), flag(F.col("sparse") & (F.col("page_index") < 16)).alias("front"), flag(text).alias("text_pages"), flag(F.size("zones") > 0).alias("zone_pages"))
    per = per.join(authorized.select("packet_id").distinct().withColumn("authorized", F.lit(True)), "packet_id", "left").join(typed, "packet_id", "left")
    n, sparse = F.col("pages"), F.col("sparse_pages") / F.col("pages")
    covered = (F.col("text_pages") / n >= 0.85) & (F.col("zone_pages") / n >= 0.5)
    doubtful = ~covered | (F.col("front") >= 4) | (sparse >= 0.25)
    many = ((F.col("sparse_pages") >= F.greatest(F.lit(2), F.floor(n * 0.35))) & (F.col("text_pages") / n < 0.7)) | ((F.col("front") >= 4) & (sparse >= 0.2))
    reasons = F.array(
        F.when(F.col("authorized").isNull() & doubtful, "no authorization number"),
        F.when((n >= 8) & (F.coalesce("document_types", F.lit(0)) <= 2) & doubtful, "few document types"),
        F.when((n >= 3) & many, "many sparse pages"),
    )
    return per.select("packet_id", "pages", "sparse_pages", F.array_join(F.filter(reasons, lambda r: r.isNotNull()), "; ").alias("reasons"))


def reading_candidates(described_pages: DataFrame, most: int = MOST_CANDIDATES) -> DataFrame:
    """(packet_id, position, page_index, priority): the pages of a packet to be read again, `most` at most.

    Pages with little on them have priority. Pages that begin alike are represented by their first, middle
    and last one; groups come by their highest priority, then their first page. A window over the pages of one
    packet, which are one row's array.
    """
    pages = described_pages.join(page_measures(described_pages).select("packet_id", "page_index", "sparse"), ["packet_id", "page_index"])
    low = F.lower(F.coalesce("text", F.lit("")))
    signals = reduce(lambda a, b: a + b, [low.contains(s).cast("int") for s in SIGNALS])
    zones = F.size("zones")
    lines = F.size(F.filter(F.split(low, "\n"), lambda x: x.rlike(r"^[a-z][a-z /#()-]{1,30}:\s*\S")))
    headed = F.split(low, "\n")[0].rlike(r"\S")
    rules = [(F.col("sparse"), 5), (signals <= 1, 3), (zones <= 1, 3), ((zones <= 1) & (lines <= 1), 1), (~headed & (zones <= 2), 1)]
    priority = reduce(lambda a, b: a + b, [F.when(c, v).otherwise(0) for c, v in rules])
    priority = priority - F.when(headed & (zones >= 4) & (signals >= 2), 2).when((zones >= 4) & (lines >= 6), 1).otherwise(0)
    alike = F.substring(F.trim(F.regexp_replace(low, r"\s+", " ")), 1, FINGERPRINT)
    group = F.when(alike != "", F.sha1(alike)).otherwise(F.concat(F.lit("page "), "page_index"))
    chosen = pages.select("packet_id", "page_index", priority.alias("priority"), group.alias("alike")).where("priority > 0")
    same = Window.partitionBy("packet_id", "alike")
    placed = chosen.withColumn("at", F.row_number().over(same.orderBy("page_index"))).withColumn("n", F.count(F.lit(1)).over(same)).withColumn("top", F.max("priority").over(same)).withColumn("first", F.min("page_index").over(same))
    step = F.when(F.col("at") == 1, 0).when((F.col("n") >= 3) & (F.col("at") == F.floor(F.col("n") / 2) + 1), 1).when((F.col("n") >= 2) & (F.col("at") == F.col("n")), 2)
    order = Window.partitionBy("packet_id").orderBy(F.desc("top"), "first", "step")
    return placed.withColumn("step", step).where("step IS NOT NULL").withColumn("position", F.row_number().over(order)).where(F.col("position") <= most).select("packet_id", "position", "page_index", "priority")


def layout_summary(described_pages: DataFrame) -> DataFrame:
    """Per packet: mean reading quality and its band, pages read well and badly, pages and labels with zones."""
    quality = F.col("read") / 100
    per = described_pages.groupBy("packet_id").agg(
        F.round(F.coalesce(F.avg(quality), F.lit(0.0)), 2).alias("average_quality"), F.sum((quality >= 0.78).cast("bigint")).alias("good_pages"), F.sum((quality < 0.52).cast("bigint")).alias("poor_pages"),
        F.sum((F.size("zones") > 0).cast("bigint")).alias("zone_pages"), F.sum(F.size("zones")).alias("zone_labels"), F.round(F.avg("zone_confidence"), 3).alias("zone_confidence"),
    )
    per = per.na.fill(0, ["good_pages", "poor_pages"])
    return per.withColumn("band", F.when(F.col("average_quality") >= 0.78, "good").when(F.col("average_quality") >= 0.52, "fair").otherwise("poor"))


def lineage(observed: DataFrame, packets: DataFrame) -> DataFrame:
    """Per packet: values that were captured, those with a page and with a snippet, their share, mean confidence, pages they came from."""
    per = observed.groupBy("packet_id").agg(
        F.count(F.lit(1)).alias("captured"), F.count("page_index").alias("with_page"), F.count(F.when(F.col("snippet") != "", 1)).alias("with_snippet"),
        F.countDistinct("field").alias("fields"), F.countDistinct("page_index").alias("source_pages"), F.round(F.avg("confidence"), 3).alias("average_confidence"),
    )
    counts = ["captured", "with_page", "with_snippet", "fields", "source_pages"]
    return packets.select("packet_id").join(per, "packet_id", "left").na.fill(0, counts).withColumn("coverage", F.round(F.when(F.col("captured") > 0, F.col("with_page") / F.col("captured")).otherwise(0.0), 3))
