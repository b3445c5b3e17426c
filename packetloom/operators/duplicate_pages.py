"""Exact and near duplicates among the pages of a packet.

Exact ones share the hash of their normalised text. Near ones are of one type: a set-similarity join
on their words finds the pairs (two pages that share 72 % of the longer one's words meet in the
rare part of their word lists, so only that part is joined), and a sequence ratio of the words
verifies them. Linked pages become groups by passing the smallest page number along the links.

Only pages of substance count: long ones with many words, or ones with two or more phrases of their
type. Defined results: null, blank and short pages are no duplicates; pages of unknown type have
exact duplicates only beside one of a known type; repeated rows of a page count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.operators.page_types import TYPES
from packetloom.session import materialize

#: Least ratio of lengths, share of common words, common words, sequence ratio, length of the longer page.
LENGTH_RATIO, OVERLAP, COMMON, RATIO, LEAST = 0.88, 0.72, 12, 0.94, 220
#: Further phrases that show the substance of a type.
MARKERS = {
    "consent": ["telehealth", "consent", "treatment", "appointment", "signature", "emergency contact", "insurance"],
    "clinical_notes": ["history of present illness", "assessment", "treatment plan", "imaging", "conservative therapy"],
    "lomn": ["medical necessity", "medically reasonable", "conservative treatment", "intervention"],
    "consult_request": ["consultation", "requested services", "medical rationale", "reason for consultation"],
    "seoc": ["single episode of care", "scope of requested episode", "continuity of care", "estimated duration"],
    "cover_sheet": ["documents included", "date of submission", "primary diagnosis code", "submitting office"],
    "rfs": ["request for service", "type of care request", "diagnosis codes", "reason for request"],
}


def compared_words(normal: Column) -> Column:
    """Words of a page with what differs between copies made alike: dates, identifiers and long numbers become marks."""
    words = F.split(F.regexp_replace(normal, r"date of birth", "dob"), r"[^a-z0-9/.-]+")

    def alike(word: Column) -> Column:
        bare = F.regexp_replace(word, r"^[/.-]+|[/.-]+$", "")
        return (
            F.when(bare.rlike(r"^(?:[0-9]{1,4}[/.-]){2}[0-9]{1,4}$"), "<date>")
            .when(bare.rlike("^[0-9]{3,}$"), "<number>")
            .when(bare.rlike("[0-9]") & (F.length(bare) > 4), "<id>")
            .otherwise(F.regexp_replace(bare, "[^a-z0-9]", ""))
        )

    return F.filter(F.transform(words, alike), lambda w: w != "")


def _phrases_held(normal: Column, doc_type: Column, phrases: dict[str, list[str]]) -> Column:
    """How many phrases of the page's type it holds."""
    of_type = F.coalesce(*[F.when(doc_type == t, F.array(*map(F.lit, p))) for t, p in phrases.items() if p], F.array().cast("array<string>"))
    return F.size(F.filter(of_type, lambda p: F.contains(normal, p)))


def candidates(typed: DataFrame) -> DataFrame:
    """Pages of substance, long enough to be compared (80 characters, 250 of an unknown type), with their words."""
    size = F.length("normal")
    pages = typed.where((size >= 80) & ((F.col("doc_type") != "unknown") | (size >= 250))).dropDuplicates(["packet_id", "page_index"]).withColumn("words", compared_words(F.col("normal")))
    own = {t: sorted({p for p in [x for g in d["anchors"] for x in g] + d["structure"] if len(p) > 5}) for t, d in TYPES.items()}
    rich = (size >= 450) & (F.size(F.array_distinct("words")) >= 28)
    held = (_phrases_held(F.col("normal"), F.col("doc_type"), own) >= 2) | (_phrases_held(F.col("normal"), F.col("doc_type"), MARKERS) >= 2)
    return pages.withColumn("substance", rich | held)


def exact_groups(typed: DataFrame, least: int = LEAST) -> DataFrame:
    """(packet_id, fingerprint, page_indices, doc_type) of pages with one text, `least` characters or more, of one known type."""
    known = F.collect_set(F.when(F.col("doc_type") != "unknown", F.col("doc_type")))
    per_text = candidates(typed).groupBy("packet_id", F.sha1("normal").alias("fingerprint")).agg(
        F.array_sort(F.collect_list("page_index")).alias("pages"), known.alias("types"), F.max(F.length("normal")).alias("size"), F.min(F.col("substance")).alias("substance")
    )
    groups = per_text.where((F.size("pages") > 1) & (F.size("types") == 1) & (F.col("size") >= least) & F.col("substance"))
    return groups.select("packet_id", "fingerprint", F.array_join("pages", ",").alias("page_indices"), F.col("types")[0].alias("doc_type"))


def near_pairs(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(packet_id, a, b): near duplicates of pages(packet_id, page_index, doc_type, size, words)."""
    sets = pages.withColumn("distinct", F.array_distinct("words")).withColumn("n", F.size("distinct")).withColumn("chars", F.length(F.array_join("words", " ")))
    sets = materialize(sets.where(F.col("n") >= COMMON), "duplicate-words")
    # any order of words that is the same for all pages will do; long ones are rarer, so they come first
    ordered = F.transform(F.array_sort(F.transform("distinct", lambda w: F.struct((-F.length(w)).alias("l"), F.xxhash64(w).alias("h")))), lambda x: x["h"])
    prefix = F.slice(ordered, F.lit(1), (F.col("n") - F.ceil(F.col("n") * OVERLAP - 1e-9) + 1).cast("int"))
    entries = sets.select("packet_id", "doc_type", "page_index", "n", "chars", "size", F.explode(prefix).alias("entry"))
    other = entries.withColumnsRenamed({"page_index": "page_b", "n": "n_b", "chars": "chars_b", "size": "size_b"})
    alike_in_length = F.least("chars", "chars_b") >= F.greatest("chars", "chars_b") * LENGTH_RATIO
    met = (
        entries.join(other, ["packet_id", "doc_type", "entry"])
        .where((F.col("page_index") < F.col("page_b")) & alike_in_length & (F.greatest("size", "size_b") >= least) & (F.least("n", "n_b") >= F.greatest("n", "n_b") * OVERLAP))
        .select("packet_id", F.col("page_index").alias("a"), F.col("page_b").alias("b"))
        .distinct()
    )
    words = sets.select("packet_id", F.col("page_index").alias("a"), F.col("words").alias("words_a"), F.col("distinct").alias("set_a"))
    common = F.size(F.array_intersect("set_a", "set_b"))
    close = (
        met.join(words, ["packet_id", "a"])
        .join(words.withColumnsRenamed({"a": "b", "words_a": "words_b", "set_a": "set_b"}), ["packet_id", "b"])
        .where((common >= COMMON) & (common >= F.greatest(F.size("set_a"), F.size("set_b")) * OVERLAP))
        .select("packet_id", "a", "b", F.array_join("words_a", " ").alias("x"), F.array_join("words_b", " ").alias("y"))
    )

    def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            matcher = [SequenceMatcher(None, x, y) for x, y in zip(b["x"], b["y"])]
            keep = [m.real_quick_ratio() >= RATIO and m.quick_ratio() >= RATIO and m.ratio() >= RATIO for m in matcher]
            yield b.loc[keep, ["packet_id", "a", "b"]]

    return close.mapInPandas(verified, "packet_id string, a int, b int")


def linked(pairs: DataFrame) -> DataFrame:
    """(packet_id, page_index, first): the smallest page that every linked page leads to.

    The smallest number known is passed along all links until nothing changes; labels jump through
    their own label each time, so the rounds are few even for long chains.
    """
    pairs = materialize(pairs, "duplicate-links")
    both = pairs.select("packet_id", "a", "b").union(pairs.select("packet_id", F.col("b").alias("a"), F.col("a").alias("b")))
    label = materialize(both.groupBy("packet_id", "a").agg(F.least(F.min("b"), F.col("a")).alias("first")), "duplicate-labels")
    while True:
        heard = both.join(label.withColumnRenamed("a", "b"), ["packet_id", "b"]).groupBy("packet_id", "a").agg(F.min("first").alias("heard"))
        jumped = label.select("packet_id", F.col("a").alias("first"), F.col("first").alias("further"))
        after = label.join(heard, ["packet_id", "a"]).join(jumped, ["packet_id", "first"]).select("packet_id", "a", F.least("first", "heard", "further").alias("new"), "first")
        after = materialize(after, "duplicate-labels")
        label = after.select("packet_id", "a", F.col("new").alias("first"))
        if not after.where("new <> first").take(1):
            return label.withColumnRenamed("a", "page_index")


def near_groups(typed: DataFrame, least: int = LEAST) -> DataFrame:
    """(packet_id, page_indices, doc_type) of near duplicates that are no exact ones."""
    exact = exact_groups(typed, least).select("packet_id", F.explode(F.split("page_indices", ",").cast("array<int>")).alias("page_index"))
    pages = candidates(typed).where("doc_type <> 'unknown' AND substance").join(exact, ["packet_id", "page_index"], "left_anti")
    pages = pages.select("packet_id", "page_index", "doc_type", F.length("normal").alias("size"), "words")
    groups = linked(near_pairs(pages, least)).join(pages.select("packet_id", "page_index", "doc_type"), ["packet_id", "page_index"])
    return groups.groupBy("packet_id", "first", "doc_type").agg(F.array_join(F.array_sort(F.collect_list("page_index")), ",").alias("page_indices")).select("packet_id", "page_indices", "doc_type")
