"""Readers of packet files and sinks of runs, events and reports."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from io import BytesIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions.fields import masked

#: Extensions that are packets (fixed values); the others give an error row.
TEXT, DOCUMENT, IMAGES, PDF = ("txt",), ("docx",), ("png", "jpg", "jpeg", "tif", "tiff", "bmp"), ("pdf",)


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, source_type, pages, error) of every file below a folder.

    TXT and DOCX are read to pages at form feeds, trailing empty pages dropped. Images, PDF and
    unknown types have no pages and say why in `error`; so do unreadable files. Nothing fails the job.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("source_type"), "content")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        for b in batches:
            out = []
            for name, kind, content in zip(b["file_name"], b["source_type"], b["content"]):
                pages, error = None, None
                try:
                    if kind in TEXT:
                        text = bytes(content).decode("utf-8", "replace")
                    elif kind in DOCUMENT:
                        xml = zipfile.ZipFile(BytesIO(bytes(content))).read("word/document.xml").decode("utf-8")
                        paragraphs = re.split(r"</w:p>", re.sub(r'<w:br w:type="page"/>', "\f", xml))
                        text = "\n".join(re.sub(r"<[^>]+>", "", p) for p in paragraphs).strip()
                    else:
                        raise ValueError("needs an OCR or PDF reader" if kind in IMAGES + PDF else f"unsupported type {kind!r}")
                    pages = text.split("\f")
                    while pages and not pages[-1].strip():
                        pages.pop()
                except Exception as e:  # noqa: BLE001 - a bad file is a row, not a failure
                    error = f"{type(e).__name__}: {e}"
                out.append((name, kind, pages, error))
            yield pd.DataFrame(out, columns=["file_name", "source_type", "pages", "error"])

    return named.mapInPandas(read, "file_name string, source_type string, pages array<string>, error string")


def read_code_list(spark: SparkSession, path: str) -> DataFrame:
    """(code): the distinct codes of the first column of a CSV file without header, in upper case."""
    return spark.read.csv(path).select(F.upper(F.trim("_c0")).alias("code")).where("code <> ''").distinct()


def append(df: DataFrame, path: str) -> None:
    """Append runs or events to their store; additional columns are merged on reading."""
    df.write.mode("append").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """A store of runs or events with the union of its columns."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def write_routed(runs: DataFrame, path: str) -> None:
    """Runs in one folder per status: 90 points or more approved, 70 or more needs_review, else rejected."""
    status = F.when(F.col("score") >= 90, "approved").when(F.col("score") >= 70, "needs_review").otherwise("rejected")
    runs.withColumn("route", status).write.mode("append").partitionBy("route").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """One CSV row per packet, with a header."""
    df.write.mode("overwrite").option("header", "true").csv(path)


def append_new(rows: DataFrame, store: DataFrame, path: str) -> None:
    """Append the rows whose ICN and authorization are both not yet in the store; nulls are never in it."""
    for key in ("va_icn", "authorization_number"):
        rows = rows.join(store.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
    rows.write.mode("append").parquet(path)


def write_audit(events: DataFrame, path: str) -> None:
    """Masked log lines `time | ACTION: ... | DETAILS: ...`."""
    line = F.concat_ws(" | ", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"), F.concat(F.lit("ACTION: "), F.coalesce("event_type", F.lit(""))), F.concat(F.lit("DETAILS: "), F.coalesce(masked(F.col("note")), F.lit(""))))
    events.select(line.alias("value")).write.mode("append").text(path)


def as_json(df: DataFrame) -> DataFrame:
    """One JSON object per row, null members left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))
