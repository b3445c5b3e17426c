"""Mixing sources to target weights (problem 9).

Every document gets a hash-random key. The keys of a source are parted into equal ranges; range
totals are aggregated before anything is moved, and their prefix sums tell which range holds the
cut at the source's budget. Only the documents of that one range are ordered, so no source,
however large, is sorted in one task. A budget beyond one epoch repeats the whole source first.

The document that crosses the budget is skipped and the filling goes on: what is left, less than that
one document, is filled from the largest size downwards with further documents that fit. This needs
only the number of documents of each size (no more sizes than tokens left), not the documents.

Defined results: documents without tokens (null, empty) and documents of null or unlisted sources
are never used; listed sources without documents are reported with 0 tokens; equal keys are
ordered by document id; a document given twice (same id and text) counts once.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.session import materialize

#: Key ranges of a source; ten billion documents leave some 2.4 million in each.
RANGES_BITS = 12


def _budgets(sized: DataFrame, targets: DataFrame, total_tokens: int | None) -> DataFrame:
    """(source, target_share, max_repeats, available, documents, budget) of each listed source.

    Without a wanted total, the largest is taken at which no listed source that has documents
    falls short of its share.
    """
    supply = sized.groupBy("source").agg(F.sum("n_tokens").alias("available"), F.count(F.lit(1)).alias("documents"))
    listed = (
        targets.where(F.col("source").isNotNull())
        .select("source", F.col("target_share").cast("double"), F.greatest(F.coalesce(F.col("max_repeats").cast("long"), F.lit(1)), F.lit(0)).alias("max_repeats"))
        .join(supply, "source", "left")
        .na.fill(0, ["available", "documents"])
    )
    everything = Window.partitionBy(F.lit(0))  # one row per listed source
    reach = F.when((F.col("available") > 0) & (F.col("target_share") > 0), F.col("available") * F.col("max_repeats") / F.col("target_share"))
    total = F.lit(total_tokens).cast("double") if total_tokens is not None else F.coalesce(F.min(reach).over(everything), F.lit(0.0))
    wanted = F.floor(F.col("target_share") * F.col("total") + 1e-6).cast("long")
    return listed.withColumn("total", total).withColumn("wanted", wanted).withColumn("budget", F.least("wanted", F.col("available") * F.col("max_repeats")))


def _first_part(keyed: DataFrame, rest: DataFrame) -> DataFrame:
    """The documents, in the order of their keys, that fill the `rest` of their source as far as the one that crosses it.

    Documents larger than the rest are passed over. Sources are few, ranges at most 2^RANGES_BITS of each.
    """
    fitting = keyed.join(rest, "source").where("n_tokens <= rest")
    before = Window.partitionBy("source").orderBy("range")
    ranges = (
        fitting.groupBy("source", "range")
        .agg(F.sum("n_tokens").alias("in_range"))
        .withColumn("to", F.sum("in_range").over(before))
        .select("source", "range", "to", (F.col("to") - F.col("in_range")).alias("from"))
    )
    placed = fitting.join(ranges, ["source", "range"]).where(F.col("from") < F.col("rest"))
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = placed.where(F.col("to") > F.col("rest")).withColumn("upto", F.col("from") + F.sum("n_tokens").over(inside)).where(F.col("upto") <= F.col("rest"))
    columns = ["doc_id", "source", "n_tokens"]
    return placed.where(F.col("to") <= F.col("rest")).select(columns).unionByName(cut.select(columns))


def _largest_first(sizes: pd.DataFrame) -> pd.DataFrame:
    """How many documents of each size fill the rest of one source."""
    rest, out = int(sizes["rest"].iloc[0]), []
    for size, documents in sorted(zip(sizes["n_tokens"].tolist(), sizes["documents"].tolist()), reverse=True):
        take = min(documents, rest // size)
        if take:
            out.append((sizes["source"].iloc[0], size, take))
            rest -= take * size
    return pd.DataFrame(out, columns=["source", "n_tokens", "take"])


def mix(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """Chosen documents (doc_id, source, n_tokens, uses), and the report of each listed source.

    `sized` has doc_id, source and n_tokens; it is read several times, so pass a written table.
    """
    used = sized.select("doc_id", "source", "n_tokens").where("n_tokens > 0 AND source IS NOT NULL").dropDuplicates(["doc_id"])
    budgets = _budgets(used, targets, total_tokens)
    keyed = used.withColumn("key", F.xxhash64("doc_id", F.lit(seed))).withColumn("range", F.shiftrightunsigned("key", 64 - RANGES_BITS).cast("int"))
    plan = budgets.where("available > 0").select(
        "source",
        F.floor(F.col("budget") / F.col("available")).cast("long").alias("epochs"),
        (F.col("budget") % F.col("available")).alias("rest"),
    )
    keyed = materialize(keyed, "mix-keyed")
    rest = materialize(plan.where("rest > 0").select("source", "rest"), "mix-rest")
    first = materialize(_first_part(keyed, rest), "mix-first")
    left = rest.join(first.groupBy("source").agg(F.sum("n_tokens").alias("used")), "source", "left").select("source", (F.col("rest") - F.coalesce("used", F.lit(0))).alias("rest")).where("rest > 0")
    pool = keyed.join(first.select("doc_id"), "doc_id", "left_anti").join(left, "source").where("n_tokens <= rest")
    sizes = pool.groupBy("source", "rest", "n_tokens").agg(F.count(F.lit(1)).alias("documents"))
    wanted = sizes.groupBy("source").applyInPandas(_largest_first, "source string, n_tokens long, take long")
    by_key = Window.partitionBy("source", "n_tokens").orderBy("key", "doc_id")
    further = pool.join(wanted, ["source", "n_tokens"]).withColumn("n", F.row_number().over(by_key)).where("n <= take").select("doc_id")
    once_more = first.select("doc_id").unionByName(further).withColumn("more", F.lit(1))
    chosen = (
        used.join(plan.select("source", "epochs"), "source")
        .join(once_more, "doc_id", "left")
        .withColumn("uses", (F.col("epochs") + F.coalesce("more", F.lit(0))).cast("int"))
        .where("uses > 0")
        .select("doc_id", "source", "n_tokens", "uses")
    )
    reached = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.sum("uses").alias("copies"), F.max("uses").alias("most_uses"))
    report = (
        budgets.join(reached, "source", "left")
        .na.fill(0, ["tokens", "copies", "most_uses"])
        .withColumn("reached_share", F.coalesce(F.col("tokens") / F.sum("tokens").over(Window.partitionBy(F.lit(0))), F.lit(0.0)))
        .select("source", "target_share", "max_repeats", "documents", "available", F.col("wanted").alias("wanted_tokens"), "tokens", "copies", "most_uses", "reached_share")
    )
    return chosen, report
