"""The order in which the pages of a packet should lie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Place of the page types; kinds of dates, the telling ones first, and what stands before them.
ORDER = {"cover_sheet": 10, "rfs": 20, "consult_request": 30, "seoc": 40, "lomn": 50, "consent": 60, "clinical_notes": 70}
DATES = {
    "submission": r"(?i)(?:date of submission|submission date|submitted(?: on| date)?)\s*[:\-]?\s*([^\n\r]+)",
    "service": r"(?i)(?:dates? of service|service dates?|service date range|visit dates?|clinical visit(?: date)?s?|dos)\s*[:\-]\s*([^\n\r]+)",
    "signature": r"(?i)(?:signed(?: on| date)?|electronically signed(?: on)?|signature date)\s*[:\-]?\s*([^\n\r]+)",
}
_DATE = r"\b([0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}|[0-9]{4}[/-][0-9]{1,2}[/-][0-9]{1,2})\b"


def parsed(date: Column) -> Column:
    """A date written month first or year first; null if it is none."""
    d = F.translate(date, "-", "/")
    return F.coalesce(*[F.when(d.rlike(p), F.try_to_date(d, f)) for p, f in (("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "M/d/yyyy"), ("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}$", "M/d/yy"), ("^[0-9]{4}/", "yyyy/M/d"))])


def page_dates(pages: DataFrame) -> DataFrame:
    """(packet_id, page_index, kind, date): the date that places every page: submission before service before signature, then the earliest."""
    def firsts(text: Column, pattern: str) -> Column:
        lines = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        return F.filter(F.transform(lines, lambda x: parsed(F.regexp_extract(x, _DATE, 1))), lambda d: d.isNotNull())

    found = F.coalesce(*[F.when(F.size(firsts(F.col("text"), p)) > 0, F.struct(F.lit(kind).alias("kind"), F.array_min(firsts(F.col("text"), p)).alias("date"))) for kind, p in DATES.items()])
    return pages.where("text IS NOT NULL").select("packet_id", "page_index", found.alias("x")).where("x IS NOT NULL").select("packet_id", "page_index", "x.*")


def page_order_of(typed: DataFrame) -> DataFrame:
    """typed(packet_id, page_index, doc_type, kind, date) with position, recommended place, and whether the packet needs a look.

    By type, then date (none last), then page; a packet needs a look if two known pages or more moved and it has
    three types or more. Windows run over the pages of one packet, which are one row's array.
    """
    place = F.coalesce(*[F.when(F.col("doc_type") == t, F.lit(n)) for t, n in ORDER.items()], F.lit(999))
    packet = Window.partitionBy("packet_id")
    ordered = typed.withColumn("recommended", F.row_number().over(packet.orderBy(place, F.col("date").asc_nulls_last(), "page_index")))
    known = F.col("doc_type") != "unknown"
    moved = F.sum((known & (F.col("recommended") != F.col("page_index") + 1)).cast("int")).over(packet)
    types = F.size(F.collect_set(F.when(known, F.col("doc_type"))).over(packet))
    return ordered.select("packet_id", "page_index", "doc_type", "kind", "date", "recommended", ((moved >= 2) & (types >= 3)).alias("review"))
